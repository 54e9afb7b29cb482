import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from foldcast.llm import packing
from foldcast.llm.common import tokenizer_path
from foldcast.llm.encoding import byte_letters, word_end_coder
from tests.llm.conftest import awkward_rows


def library_ids(texts):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    coder.no_truncation()
    coder.no_padding()
    return [[*coder.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]


def wanted_pieces(rows, capacity):
    out = []
    for (key, text), ids in zip(rows, library_ids([t for _, t in rows])):
        for n, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start : start + capacity]
            out.append((key, n, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return sorted(out, key=str)


def check_sequences(rows, capacity):
    """Every sequence is gapless from 0 and not too long; returns how many there are."""
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def pieces_of(rows):
    return sorted(((r["key"], r["piece"], r["start"], r["length"], r["crc"]) for r in rows), key=str)


@pytest.mark.parametrize("capacity", [7, 2048])
def test_awkward_rows_are_placed_once_each(awkward, clashing, capacity):
    want = wanted_pieces([(r[0], r[1]) for r in awkward_rows()], capacity)
    for docs in (awkward, clashing):
        rows = packing.pack_documents(docs, capacity=capacity, group_size=64, islands=2).collect()
        assert pieces_of(rows) == want
        assert check_sequences(rows, capacity) <= len(want)


def test_empty_table(empty_docs):
    assert packing.pack_documents(empty_docs).collect() == []


def test_documents_come_near_the_sum_of_their_lengths(small_docs):
    rows = packing.pack_documents(small_docs, group_size=50).collect()
    texts = small_docs.select("doc_id", "text").collect()
    assert pieces_of(rows) == wanted_pieces([tuple(r) for r in texts], 2048)
    n = check_sequences(rows, 2048)
    assert n <= -(-sum(r["length"] for r in rows) // 2048) + 2


def test_many_equal_rows_fill_groups_of_bounded_size(spark):
    docs = spark.createDataFrame([(1, "one two three")] * 3000 + [(None, None)] * 500, "doc_id long, text string")
    pieces = packing.document_pieces(docs)
    for ids, most in ((0, 256), (2000, 2000)):
        groups = packing._groups(pieces, 256, ids)
        assert max(r[0] for r in groups.selectExpr("size(item)").collect()) <= most
    rows = packing.pack_documents(docs, group_size=256, islands=2).collect()
    assert len(rows) == 3500 and check_sequences(rows, 2048) == -(-(3000 * 4 + 500) // 2048)


def test_children_are_packings_and_breeding_never_gets_worse():
    rng = np.random.default_rng(5)
    sizes = rng.integers(300, 900, 400)
    population = packing.first_packings(sizes, 2048, 6, rng)
    before = max(packing.fitness(sizes, p, 2048) for p in population)
    for a in population:
        for b in population:
            new = packing.child(sizes, a, b, 2048, rng)
            assert (new >= 0).all() and np.bincount(new, weights=sizes).max() <= 2048
            assert set(new) == set(range(new.max() + 1))
    out = packing.bred(sizes, population, 2048, 60, rng)
    assert packing.fitness(sizes, out[0], 2048) >= before


def test_breeding_beats_best_fit_where_that_wastes_room():
    """Triples that fill a sequence exactly; best-fit decreasing does not find them all."""
    rng = np.random.default_rng(2)
    a = rng.integers(380, 490, 40)
    b = rng.integers(250, 1000 - a - 249)
    sizes = np.concatenate([a, b, 1000 - a - b])
    population = packing.first_packings(sizes, 1000, 6, rng)
    first = packing.fitness(sizes, population[0], 1000)
    for _ in range(4):
        population = packing.bred(sizes, population, 1000, 100, rng)
    assert packing.fitness(sizes, population[0], 1000) > first


def test_best_packing_moves_from_island_to_island(spark):
    rng = np.random.default_rng(7)
    table = spark.createDataFrame(
        [(i, 0, 0, int(n), 0) for i, n in enumerate(rng.integers(380, 700, 120))],
        f"key long, {packing._PIECE}",
    )
    rows = packing.pack_pieces(table, 1000, group_size=40, islands=3, children=10, epochs=3, rounds=2).collect()
    assert sorted(r["key"] for r in rows) == list(range(120))
    check_sequences(rows, 1000)


def library():
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    coder.no_truncation()
    coder.no_padding()
    return coder


def test_coder_learns_each_stem_once():
    stems = [a + b + c for a in ("bel", "Tor", "Übe", "inß") for b in ("an", "or", "ich", "oné") for c in ("ta", "q", "ing")]
    texts = [f"{x}{mark} {x} {y}{mark}\n{x} ({y}) 12{mark}" for x, y in zip(stems, reversed(stems)) for mark in ".,;:!?"]
    coder = word_end_coder("word_bpe_49k.json")
    coder._forget()
    ids, ends = coder.rows(texts)
    plain = library()
    for i, text in enumerate(texts):
        assert ids[ends[i] : ends[i + 1]].tolist() == plain.encode(text, add_special_tokens=False).ids
    pieces = {p for text in texts for p, _ in plain.pre_tokenizer.pre_tokenize_str(text)}
    assert len(coder._slot) <= len(pieces)


def test_coder_equals_the_library_on_odd_texts():
    from foldcast.llm.encoding import StemMemory

    rng = random.Random(7)
    atoms = [
        *" \n\t\r\x0b\x1c\x85\xa0\u2003\u2028\u200b\x00\x7f", *[" ", "\n"] * 8, *"'''.,;(<|>_-", "'s", "'LL", "<|endoftext|>",
        "<|EndOfText|>", "<|endof", "|>", "12", "\u0663", "\xbd", "\xb2", "foo", "Bar", "BAZ", "\xe9t\xe9", "\xc9T", "\xdf", "\xd7",
        "\xf7", "\u023a", "\u024f", "\u0250", "e\u0301", "H\u0331", "\u0338", "\u4e2d", "\U0001f600", "\xaa", "\u0130", "I\u0307",
        "s", "re", "\u03a3", "</w>", "x</w", "\u212a",
    ]
    texts = ["".join(rng.choices(atoms, k=rng.randrange(12))) for _ in range(3000)] + ["", "\n", " \n"]
    texts += [f"7{c}7 !{c}! a{c}B{c}. {c}'s {c}\u0301" for c in map(chr, range(33, 0x250))]
    want = [coded.ids for coded in library().encode_batch(texts, add_special_tokens=False)]
    alone = StemMemory(library())
    assert alone._alone is not None
    alone._alone = None  # as where ``run_model`` gives none
    for coder in (word_end_coder("word_bpe_49k.json"), StemMemory(library(), limit=50), alone):
        for first in range(0, len(texts), 500):
            ids, ends = coder.rows(texts[first : first + 500])
            got = [ids[a:b].tolist() for a, b in zip(ends, ends[1:])]
            assert got == want[first : first + 500]


def test_words_run_together_only_where_no_merge_joins_them():
    from tokenizers import Tokenizer
    from tokenizers.models import BPE

    from foldcast.llm.encoding import run_model

    letters = [*byte_letters().values()]
    letters += [x + "</w>" for x in letters]
    for merges, fit in (
        ([("a", "b</w>")], True), ([("a", "b</w>"), ("ab</w>", "c")], False),
        ([("a", "<"), ("/", "w"), ("a<", "/w"), ("a</w", ">")], False),
    ):
        vocab = {x: n for n, x in enumerate(dict.fromkeys([*letters, *[a + b for a, b in merges]]))}
        model = BPE(vocab=vocab, merges=merges, end_of_word_suffix="</w>")
        assert (run_model(Tokenizer(model)) is not None) == fit
