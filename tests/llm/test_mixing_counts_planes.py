import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldcast.llm.common import tokenizer_path
from foldcast.llm.encoding import byte_level_coder
from foldcast.llm.id_planes import crc32_joined, document_digests, ids_of, planes, read_ids, write_ids
from foldcast.llm.mixing import measured, mix_sources, mixed_documents, permuted, source_targets
from foldcast.llm.token_counts import context_totals, length_histogram
from foldcast.session import fresh_path
from tests.llm.conftest import awkward_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes, weights=(5, 2, 1), total=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    full, goal = {}, total * sum(sizes.values())
    while True:
        rest = [s for s in names if s not in full]
        left = goal - sum(full.values())
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] > most * sizes[s] + 1e-9]
        if not over:
            return full | share
        full |= {s: most * sizes[s] for s in over}


def test_targets_match_filling_by_rounds(spark, awkward, small_docs):
    for docs in (awkward, small_docs):
        sizes = Counter()
        for r in docs.collect():
            sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
        want = brute_targets(sizes)
        got = {r["source"]: r for r in source_targets(measured(docs, "doc_id", "text", "source")).collect()}
        assert set(got) == set(want)
        for s in want:
            assert got[s]["source_size"] == sizes[s] and got[s]["target"] == pytest.approx(want[s])


@pytest.mark.parametrize("n", [1, 2, 7, 256, 1000])
def test_permutation_and_inverse(spark, n):
    df = spark.range(n).select(
        "id", permuted(F.col("id"), F.lit(n).cast("long"), False, F.lit(3), F.lit("x")).alias("p")
    ).withColumn("q", permuted(F.col("p"), F.lit(n).cast("long"), True, F.lit(3), F.lit("x")))
    rows = df.collect()
    assert sorted(r["p"] for r in rows) == list(range(n)) and all(r["q"] == r["id"] for r in rows)
    assert n < 200 or sum(r["p"] == r["id"] for r in rows) < n / 20


@pytest.mark.parametrize("block", [1, 16, 256])
def test_mix_meets_targets_and_takes_by_blocks(awkward, small_docs, block):
    for docs in (awkward, small_docs):
        rows = mix_sources(docs, block=block, shard=8).collect()
        assert len(rows) == docs.count()
        assert sorted(map(str, rows)) == sorted(map(str, mix_sources(docs, block=block, shard=8).collect()))
        taken = Counter()
        for r in rows:
            spans = Counter()
            for copy, a, b in r["takes"] or []:
                assert 0 <= a < b <= r["size"] and copy in (0, 1)
                spans.update(range(a, b))
            assert r["taken"] == sum(spans.values()) <= 2 * r["size"] and max(spans.values(), default=0) <= 2
            taken[r["source"]] += r["taken"]
        for r in rows:
            assert abs(taken[r["source"]] - r["target"]) <= 0.5 + 1e-6


def test_mixed_documents_hold_the_words_taken(clashing, small_docs, empty_docs):
    for docs in (clashing, small_docs):
        wanted = Counter()
        for r in mix_sources(docs, block=16).collect():
            wanted[r["key"]] += r["taken"]
        out = mixed_documents(docs, block=16)
        assert out.columns == docs.columns
        got = Counter()
        for r in out.collect():
            got[r["doc_id"]] += len(WORD.findall(r["text"]))
        if docs is small_docs:
            assert +got == +wanted
        else:
            assert set(+got) == set(+wanted)
    assert mix_sources(empty_docs).count() == 0 and mixed_documents(empty_docs).count() == 0


def test_shards_follow_the_weights(small_docs):
    from foldcast.llm.mixing import drawn_blocks, slot_counts

    counts = slot_counts(source_targets(measured(small_docs, "doc_id", "text", "source")), 7, 16)
    drawn = drawn_blocks(counts, 7, 16, 256).collect()
    assert len({(r["shard"], r["slot"]) for r in drawn}) == len(drawn) == sum(r["n_slots"] for r in counts.collect())
    used = Counter((r["no"], r["block"]) for r in drawn)
    assert max(used.values()) <= 2
    share = {r["no"]: r["n_slots"] / len(drawn) for r in counts.collect()}
    for r in counts.collect():
        first = sum(d["no"] == r["no"] for d in drawn if d["shard"] == 0)
        spread = (256 * share[r["no"]] * (1 - share[r["no"]])) ** 0.5
        assert abs(first - 256 * share[r["no"]]) < 5 * spread + 1


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))


def test_coder_equals_the_library(small_docs):
    texts = [r["text"] for r in small_docs.collect()] + [r[1] or "" for r in awkward_rows()] + [
        "  a  b \n c", "\t x\n\n  y", " ", " a ", "a<|endoftext|> b <|endoftext|>c", "x  y 　z", "it's  we'll 12 3",
        "a\r\n b", "foo.\nBar baz.,x q.\n\nz a.\n", "\x1c x\x1c y \x85 z", "a  b",
    ]
    ids, ends = byte_level_coder("byte_bpe_50k.json").rows(texts)
    for i, text in enumerate(texts):
        assert ids[ends[i] : ends[i + 1]].tolist() == library().encode(text, add_special_tokens=False).ids


def test_coder_learns_each_pre_token_once():
    stems = [a + b + c for a in ("bel", "tor", "Übe", "inß") for b in ("an", "or", "ich", "oné") for c in ("ta", "q", "ing")]
    texts = [f"{x}{mark} {x} {y}{mark}\n{x} ({y}) 12{mark}" for x, y in zip(stems, reversed(stems)) for mark in ".,;:!?"]
    coder = byte_level_coder("byte_bpe_50k.json")
    coder._forget()
    ids, ends = coder.rows(texts)
    plain = library()
    for i, text in enumerate(texts):
        assert ids[ends[i] : ends[i + 1]].tolist() == plain.encode(text, add_special_tokens=False).ids
    pieces = {p for text in texts for p, _ in plain.pre_tokenizer.pre_tokenize_str(text)}
    assert len(coder._slot) <= len(pieces) + 1  # and one without ids


def test_coder_equals_the_library_on_odd_texts():
    from foldcast.llm.encoding import PieceMemory

    rng = random.Random(7)
    atoms = [
        *" \n\t\r\x0b\x1c\x85\xa0\u1680\u2003\u2028\u3000\u200b\ufeff\x00\x7f", *[" ", "\n"] * 10, *"'''.,;(<|>_-", "'s", "'ll",
        "<|endoftext|>", "<|endof", "|>", "12", "\u0663", "\xbd", "foo", "Bar", "\xe9t\xe9", "\xdf", "\xd7", "\xf7", "\u024f", "\u0250",
        "e\u0301", "\u0338", "\u4e2d", "\U0001f600", "\xaa", "\u0130", "s", "re",
    ]
    texts = ["".join(rng.choices(atoms, k=rng.randrange(12))) for _ in range(3000)] + ["\n\n<|endoftext|>\n \n", "", "\n", " \n"]
    want = [coded.ids for coded in library().encode_batch(texts, add_special_tokens=False)]
    alone = PieceMemory(library())
    alone._border = None  # as where a model has no byte to spare
    for coder in (byte_level_coder("byte_bpe_50k.json"), PieceMemory(library(), limit=50), alone):
        for first in range(0, len(texts), 500):
            ids, ends = coder.rows(texts[first : first + 500])
            got = [ids[a:b].tolist() for a, b in zip(ends, ends[1:])]
            assert got == want[first : first + 500]


def test_token_counts_match_brute_force(awkward, empty_docs):
    sizes = [len(library().encode(r[1] or "", add_special_tokens=False).ids) for r in awkward_rows()]
    rows = {r["n_tokens"]: r for r in context_totals(length_histogram(awkward)).collect()}
    assert set(rows) == set(sizes)
    for n, r in rows.items():
        assert r["n_docs"] == sizes.count(n) and r["total_tokens"] == sum(sizes)
        assert r["docs_le"] == sum(s <= n for s in sizes) and r["docs_gt"] == sum(s > n for s in sizes)
        assert r["tokens_le"] == sum(s for s in sizes if s <= n) and r["tokens_gt"] == sum(s for s in sizes if s > n)
        assert r["truncated_total"] == sum(min(s, n) for s in sizes)
        assert r["share_le"] == pytest.approx(r["docs_le"] / len(sizes))
    assert context_totals(length_histogram(empty_docs)).count() == 0


@pytest.mark.parametrize("unit", ["byte", "bit"])
@pytest.mark.parametrize("n", [0, 1, 9, 1000])
def test_planes_round_trip(unit, n):
    ids = np.random.default_rng(5).integers(0, 2**32, n).astype("<u4")
    assert ids_of(planes(ids, unit), n).tolist() == ids.tolist()


def test_crc_of_joined_bytes():
    a, b = b"abc" * 100, b"xyz" * 77
    assert crc32_joined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
    assert crc32_joined(zlib.crc32(a), 0, 0) == zlib.crc32(a)


@pytest.mark.parametrize("unit,chunk", [("byte", 64), ("bit", 1000), ("byte", 1 << 16)])
def test_written_ids_match_brute_force(spark, awkward, unit, chunk):
    path = fresh_path(spark, "test-ids")
    write_ids(awkward, path, unit=unit, chunk=chunk)
    rows = sorted(((r[0], r[1] or "") for r in awkward_rows()), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    want, start = [], 0
    for key, text in rows:
        ids = [*library().encode(text, add_special_tokens=False).ids, 2]
        want.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = [tuple(r) for r in document_digests(spark, path).collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    streams = defaultdict(dict)
    for r in read_ids(spark, path).collect():
        streams[r["part"], r["doc_first"], r["doc_id"]].update(enumerate(r["ids"], r["at"]))
    assert sum(map(len, streams.values())) == start
    index = spark.read.parquet(f"{path}/index").collect()
    assert sum(r["n_ids"] for r in index) == start and all(r["n_ids"] <= chunk for r in index)


def test_written_empty_table(spark, empty_docs):
    path = fresh_path(spark, "test-ids")
    write_ids(empty_docs, path)
    assert document_digests(spark, path).count() == 0
