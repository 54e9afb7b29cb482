import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from foldcast.llm import periodic_runs as P
from foldcast.llm.queries import QUERIES
from tests.llm.conftest import SMALL, awkward_rows


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_runs(words, least_words=24, least_periods=3):
    """By the definition: maximal stretches of every period, of which the smallest counts."""
    smallest = {}
    n = len(words)
    for q in range(1, n // least_periods + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least_words, least_periods * q):
                smallest.setdefault((i, j + q - i), q)
            i = j
    return sorted((s, n_, q) for (s, n_), q in smallest.items())


def found(documents, **limits):
    names = {}
    numbers = [np.array([names.setdefault(w, len(names)) for w in d], np.int64) for d in documents]
    out = [[] for _ in documents]
    for d, s, n, q in zip(*(c.tolist() for c in P.runs_of(numbers, **limits))):
        out[d].append((s, n, q))
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in out]


def test_cover_meets_at_every_distance():
    assert {(a - b) % P.MODULUS for a in P.COVER for b in P.COVER} == set(range(P.MODULUS))


def test_common_extensions_equal_comparison():
    rng = np.random.default_rng(1)
    for sizes in ([300], [1], [40, 1, 0, 75, 13], [200, 200]):
        for letters in (1, 2, 5):
            words = rng.integers(0, letters, sum(sizes))
            owner = np.repeat(np.arange(len(sizes)), sizes)
            end = np.cumsum(sizes)[owner]
            index = P.CommonExtensions(words, owner, end)
            pairs = [(a, b) for a in range(len(words)) for b in range(a + 1, end[a]) if rng.random() < 0.2]
            if not pairs:
                continue
            a, b = np.array(pairs).T
            want = []
            for x, y in pairs:
                k = 0
                while y + k < end[x] and words[x + k] == words[y + k]:
                    k += 1
                want.append(k)
            assert index.common(a, b).tolist() == want


@pytest.mark.parametrize("letters", [1, 2, 3, 8])
def test_runs_equal_brute_force(letters):
    rng = np.random.default_rng(letters)
    documents = []
    for n in (0, 1, 23, 24, 25, 60, 150, 400):
        documents.append(rng.integers(0, letters, n).tolist())
        p = int(rng.integers(1, 40))
        documents.append(np.tile(rng.integers(0, letters, p), n // p + 1)[:n].tolist())
        documents.append([*rng.integers(0, 50, n // 3), *np.tile(rng.integers(0, letters, p), 7), *rng.integers(0, 50, 30)])
    assert found(documents) == [brute_runs(d) for d in documents]
    assert found(documents, least_words=6, least_periods=2) == [brute_runs(d, 6, 2) for d in documents]


def test_runs_in_parts_are_the_same(monkeypatch):
    rng = np.random.default_rng(3)
    documents = [rng.integers(0, 2, 500).tolist(), [1] * 700, rng.integers(0, 2, 90).tolist()]
    want = [brute_runs(d) for d in documents]
    monkeypatch.setattr(P, "PAIRS", 17)
    assert found(documents) == want


def test_a_long_repeat_is_found_fast():
    p = list(range(40_000))
    assert found([p * 4 + [7, 8]]) == [[(0, 160_000, 40_000)]]


def digests(key, text):
    words = words_of(text)
    n = len(words)
    h = zlib.crc32(str(key).encode()) if key is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = sorted(brute_runs(words), key=lambda r: (r[0], r[2]))
    gone = {i for s, k, q in runs for i in range(s + q, s + k)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    return (
        key, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
        hashlib.sha256("".join(f"{s},{k},{q}\n" for s, k, q in runs).encode()).hexdigest(),
        hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest(),
    )


def test_query_equals_brute_force(spark, small_docs):
    rows = sorted(map(tuple, QUERIES["op12_periodic_runs"](spark, SMALL).collect()))
    texts = {r["doc_id"]: r["text"] for r in small_docs.collect()}
    short = {k for k, t in texts.items() if len(words_of(t)) <= 1500}
    assert len(short) > 0.9 * len(texts) and [r[0] for r in rows] == sorted(texts)
    assert [r for r in rows if r[0] in short] == [digests(k, texts[k]) for k in sorted(short)]
    assert any(r[1] for r in rows)


def test_awkward_rows(awkward, clashing, empty_docs):
    for docs in (awkward, clashing):
        rows = P.periodic_runs(docs).collect()
        got = sorted((str(r["key"]), r["n_words"], r["collapsed"][:50], [tuple(x) for x in r["runs"]]) for r in rows)
        want = []
        for r in awkward_rows():
            words = words_of(r[1])
            runs = sorted(brute_runs(words[:400]) if len(words) > 400 else brute_runs(words), key=lambda x: (x[0], x[2]))
            want.append((str(r[0]), len(words), runs))
        assert [(g[0], g[1]) for g in got] == sorted((w[0], w[1]) for w in want)
        short = {w[0]: w[2] for w in want if w[1] <= 400}
        assert all(g[3] == short[g[0]] for g in got if g[0] in short and g[1] <= 400)
        planted = P.with_planted_repeats(docs).collect()
        assert len(planted) == len(awkward_rows())
    assert P.periodic_runs(empty_docs).collect() == [] and P.with_planted_repeats(empty_docs).collect() == []


def test_repeats_are_dropped(spark):
    docs = spark.createDataFrame([(1, "start " + "a b c " * 9 + "end"), (2, "x " * 30), (3, "  ")], "doc_id long, text string")
    rows = {r["key"]: r for r in P.periodic_runs(docs).collect()}
    assert rows[1]["collapsed"] == "start a b c end" and [tuple(r) for r in rows[1]["runs"]] == [(1, 27, 3)]
    assert rows[2]["collapsed"] == "x" and rows[3]["collapsed"] == "" and rows[3]["runs"] == []
