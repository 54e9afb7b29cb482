import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from foldcast.llm import jaccard_join as jaccard_join_module
from foldcast.llm.common import by_filter, mark_filter
from foldcast.llm.components import components
from foldcast.llm.jaccard_join import drop_near_copies, jaccard_join
from foldcast.session import shared_folder
from tests.llm.conftest import awkward_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, n=3):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))


def brute(rows, percent, n=3):
    sets = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    return Counter((k, len(sets[i]), least.get(find(i))) for i, (k, _) in enumerate(rows))


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        at = rng.randrange(len(words) or 1)
        words[at : at + rng.randrange(2)] = [f"new{rng.randrange(10**6)}"] * rng.randrange(2)
    return " ".join(words)


@pytest.mark.parametrize("percent", [90, 60])
def test_join_matches_brute_force(spark, small_docs, percent):
    rng = random.Random(percent)
    rows = [(r["doc_id"], r["text"]) for r in small_docs.collect()] + [(r[0], r[1]) for r in awkward_rows()]
    at = 10_000
    for size in (1, 2, 3, 5, 11, 12, 20, 28, 42, 63, 64, 95, 200, 700):
        base = [f"w{rng.randrange(5000)}" for _ in range(size)]
        for edits in [0, 1, 1, 2, 3, 4, 6, 9, size // 30, size // 60]:
            rows.append((at, edited(rng, base, edits)))
            at += rng.randrange(1, 4)
    chain = [f"c{i}" for i in range(400)]  # neighbours reach the similarity, the ends do not
    for k in range(12):
        rows.append((at + k, " ".join(chain[5 * k : 5 * k + 300])))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = Counter((r["key"], r["n_shingles"], r["component"]) for r in jaccard_join(docs, percent=percent).collect())
    assert got == brute(rows, percent)


def test_group_of_copies_around_one_that_is_not_the_pivot(spark):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(140)]
    rows = [(k, edited(rng, base, 2)) for k in range(150)] + [(500, " ".join(base))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = Counter((r["key"], r["n_shingles"], r["component"]) for r in jaccard_join(docs).collect())
    assert got == brute(rows, 90)


def test_drop_near_copies(clashing, empty_docs):
    out = drop_near_copies(clashing)
    assert out.columns == clashing.columns
    left = Counter((r["doc_id"], r["text"]) for r in out.select("doc_id", "text").collect())
    assert left[1, awkward_rows()[0][1]] == 1 and not any(k == 2 for k, _ in left)
    assert sum(n for (_, t), n in left.items() if not shingles(t)) == 4
    assert not any(k == 7 for k, _ in left)
    assert drop_near_copies(empty_docs).count() == 0 and jaccard_join(empty_docs).count() == 0


def test_components_of_paths_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(200, 260)] + [(1, 2), (2, 3), (3, 1), (5, 5)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(100, 141)) and all(got[i] == 7 for i in range(200, 260))
    assert got[1] == got[2] == got[3] == 1 and 5 not in got


@pytest.mark.parametrize("turns", [1, 6])
@pytest.mark.parametrize("percent", [60, 80, 90])
def test_similar_sets_share_a_tile(monkeypatch, turns, percent):
    monkeypatch.setattr(jaccard_join_module, "TURNS", turns)
    rng = np.random.default_rng(percent + turns)
    for _ in range(300):
        common = int(rng.integers(1, 300)) if rng.random() < 0.7 else int(rng.integers(1, 12))
        apart = common * (100 - percent) // percent
        left = int(rng.integers(0, apart + 1))
        members = rng.integers(0, 1 << 63, common + apart, dtype=np.uint64)
        x, y = np.sort(members[: common + left]), np.sort(np.concatenate([members[:common], members[common + left :]]))
        if np.array_equal(x, y):
            continue
        keys, ends = jaccard_join_module.tile_keys(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]), percent)
        assert set(keys[: ends[1]].tolist()) & set(keys[ends[1] :].tolist())


def test_bitmaps_of_long_sets_tell_them_apart():
    rng = np.random.default_rng(3)
    sets = [np.sort(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (20_000, 18_000, 40, 3_000)]
    sets += [np.sort(np.concatenate([sets[0][:17_000], sets[1][:500]])), np.zeros(0, np.uint64)]
    maps, borders = jaccard_join_module.bitmaps(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])]))
    rows = [maps[a:b] for a, b in zip(borders[:-1], borders[1:])]

    def apart(i, j):
        n = min(len(rows[i]), len(rows[j]))
        x, y = (np.bitwise_xor.reduce(r.reshape(-1, n), axis=0) for r in (rows[i], rows[j]))
        return int(np.unpackbits((x ^ y).view(np.uint8)).sum())

    assert 80 * (20_000 + 18_000) > 180 * (20_000 + 18_000 - apart(0, 1)) // 2
    for i in range(len(sets)):
        for j in range(len(sets)):
            assert apart(i, j) <= len(np.setxor1d(sets[i], sets[j]))
    short = jaccard_join_module.folded(maps, borders)
    assert short.shape == (len(sets), jaccard_join_module.FOLDED)
    assert all((short[i] == np.bitwise_xor.reduce(rows[i].reshape(-1, jaccard_join_module.FOLDED), axis=0)).all() for i in range(len(sets)))


def test_bitmaps_of_unequal_length_in_sql(spark):
    rows = [([1, 2, 4, 8], [1 ^ 4, 2 ^ 8], 0), ([5, 6], [5, 7], 1), ([0, 0, 3, 0, 0, 0, 0, 0], [1, 0], 1)]
    for a, b, n in rows:
        df = spark.createDataFrame([((a,), (b,))], "x struct<bitmap: array<long>>, y struct<bitmap: array<long>>")
        for x, y in ("xy", "yx"):
            assert df.selectExpr(jaccard_join_module._bits_apart(x, y)).first()[0] == n


def test_similar_long_documents_whose_bitmaps_differ_in_length(spark):
    rng = random.Random(4)
    words = [f"w{rng.randrange(10**6)}" for _ in range(2200)]
    rows = [(1, " ".join(words[:2040])), (2, " ".join(words[:2070])), (3, " ".join(words)), (4, " ".join(words[150:]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = Counter((r["key"], r["n_shingles"], r["component"]) for r in jaccard_join(docs).collect())
    assert got == brute(rows, 90) and {c for _, _, c in got} == {1}


def test_texts_that_no_filter_holds_are_not_shuffled(spark, tmp_path):
    marks = spark.createDataFrame([(5,), (-7,), (1 << 40,), (5 + (1 << 18),)], "mark long")
    stored = mark_filter(marks)
    assert stored.count() == 3 and stored.schema.simpleString() == "struct<word:bigint,bits:bigint>"
    df = spark.createDataFrame([(m, "text") for m in (5, -7, 1 << 40, 5 + (1 << 18), 6, -8, 5 + (1 << 19), 1 << 41)], "m long, word string")
    may = by_filter(df, "m", stored, "left_semi")
    none = by_filter(df, "m", stored, "left_anti")
    assert sorted(r["m"] for r in may.collect()) == [-7, 5, 5 + (1 << 18), 1 << 40, 1 << 41]  # the last one shares a bit
    assert sorted(r["m"] for r in none.collect()) == [-8, 6, 5 + (1 << 19)] and none.columns == df.columns


def test_large_tables_go_when_the_join_is_done(spark, small_docs):
    folder = Path(shared_folder(spark), "foldcast")
    before = set(folder.glob("*")) if folder.exists() else set()
    out = drop_near_copies(small_docs, n=5, percent=80)
    kinds = {p.name.rsplit("-", 1)[0] for p in set(folder.glob("*")) - before}
    assert not kinds & {"sketches", "classes", "tiles", "sets", "pairs"}
    rows = [(r["doc_id"], r["text"]) for r in small_docs.collect()]
    least = {c for _, _, c in brute(rows, 80, 5)}
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(least)
