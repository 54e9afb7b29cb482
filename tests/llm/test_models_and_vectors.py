import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldcast.llm import language as language_module
from foldcast.llm import vector_dedup as vectors_module
from foldcast.llm.language import LanguageModel, Words, best_path, fit_languages, identify_languages, label_words
from foldcast.llm.toxicity import ToxicityModel, drop_toxic, fit_toxicity, judged, maximal_segments, toxic_passages
from foldcast.llm.vector_dedup import vector_dedup
from tests.llm.conftest import awkward_rows

MEDIUM = "/root/testdata/sf0.1"


def test_maximal_segments_match_their_definition():
    """Splitting at the best segment and going on left and right of it gives the same segments."""
    rng = random.Random(2)

    def brute(scores, low, high):
        best = max(
            ((sum(scores[a:b]), -(b - a), -a, a, b) for a in range(low, high) for b in range(a + 1, high + 1)), default=None
        )
        if best is None or best[0] <= 0:
            return []
        _, _, _, a, b = best
        return [*brute(scores, low, a), (a, b - 1, best[0]), *brute(scores, b, high)]

    for _ in range(200):
        n = rng.randrange(1, 14)
        hits = sorted(rng.sample(range(n), rng.randrange(1, n + 1)))
        scored = [(i, rng.choice([-1, 1]) * rng.random() * 3) for i in hits]
        scores = [dict(scored).get(i, -0.3) for i in range(n)]
        got = maximal_segments(scored, -0.3)
        want = brute(scores, 0, n)
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert all(math.isclose(g[2], w[2], abs_tol=1e-9) for g, w in zip(got, want))


def test_toxicity_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{MEDIUM}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxic_passages(docs, fit_toxicity(docs, labels)).where("held_out")
    rows = rows.join(labels.withColumnRenamed("doc_id", "key"), "key").select("toxic", "predicted", "score").collect()
    toxic, clean = ([r for r in rows if r["toxic"] == x] for x in (1, 0))
    assert sum(r["predicted"] for r in clean) <= 0.01 * len(clean)
    assert sum(r["predicted"] for r in toxic) >= 0.7 * len(toxic)


def test_toxic_passages_repeat_words_of_earlier_ones():
    model = ToxicityModel({"vile": 4.0, "foul": 4.0, "fine": -3.0})
    text = " ".join(["vile foul vile foul", *["plain"] * 400, "vile foul vile foul"])
    _, passages = judged(text, model)
    assert [p[:2] for p in passages] == [(0, 3), (404, 407)] and passages[0][2] == pytest.approx(passages[1][2])
    assert judged("fine " + "plain " * 400 + "vile vile vile", model)[1][0][:2] == (401, 403)


def test_toxicity_of_awkward_rows(spark, awkward, clashing, empty_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(1, 1, None), (None, 0, 1), (4, 0, 0), (4, 0, 0)], none.schema)
    for labels in (none, odd):
        model = fit_toxicity(awkward, labels)
        rows = toxic_passages(awkward, model).collect()
        assert len(rows) == len(awkward_rows()) and all(0 <= r["score"] < 0.7 and not r["passages"] for r in rows)
        assert drop_toxic(clashing, model).columns == clashing.columns
        assert drop_toxic(clashing, model).count() == len(awkward_rows())
        assert toxic_passages(empty_docs, model).count() == 0
    assert fit_toxicity(empty_docs, odd).words == {}


def test_viterbi_matches_all_paths():
    rng = np.random.default_rng(1)
    for _ in range(30):
        scores = rng.normal(size=(6, 3)) * 2
        paths = np.stack(np.meshgrid(*[range(3)] * 6), -1).reshape(-1, 6)
        value = scores[np.arange(6), paths].sum(axis=1) - 1.5 * (np.diff(paths, axis=1) != 0).sum(axis=1)
        got = best_path(scores, 1.5)
        assert math.isclose(value.max(), scores[np.arange(6), got].sum() - 1.5 * (np.diff(got) != 0).sum())


def plain_path(scores, switch):
    total, back = scores[0], []
    for row in scores[1:]:
        top = total.argmax()
        change = total[top] - switch > total
        back.append(np.where(change, top, np.arange(len(row))))
        total = np.where(change, total[top] - switch, total) + row
    path = [total.argmax()]
    for row in reversed(back):
        path.append(row[path[-1]])
    return path[::-1]


def test_texts_are_scanned_side_by_side_as_one_by_one():
    rng = np.random.default_rng(3)
    for turn in range(300):
        sizes = rng.integers(1, [4, 40][turn % 2], rng.integers(1, 9))
        scores = rng.integers(-3, 3, (sizes.sum(), rng.integers(1, 5))).astype(float)  # many ties
        switch = rng.choice([0.0, 1.0, 2.0, 5.0])
        first = np.cumsum(sizes) - sizes
        got = language_module.best_paths(scores, first, switch)
        assert got.tolist() == [x for text in np.split(scores, first[1:]) for x in plain_path(text, switch)]


def test_mixed_texts_cost_far_less_than_a_step_per_word(monkeypatch):
    """Array calls for each word of each mixed text cost most of the time of op6_language."""
    rng = np.random.default_rng(4)
    sizes = rng.integers(300, 700, 80)
    n = sizes.sum()
    scores = rng.normal(size=(n, 4)) * 3
    scores[np.arange(n), np.arange(n) // 60 % 4] += 6
    at = np.arange(n)
    made = Words(np.repeat(np.arange(80), sizes), at, at + 1, np.zeros(n, int), np.stack([at, at], axis=1))
    monkeypatch.setattr(language_module, "words_of", lambda texts: made)
    model = LanguageModel(["a", "b", "c", "d"], scores / 2, np.ones((1, 4), bool))
    begun = time.process_time()
    _, path, _ = label_words([""] * 80, model)
    took = time.process_time() - begun
    begun = time.process_time()
    want = [plain_path(text, 12.0) for text in np.split(scores, np.cumsum(sizes)[:-1])]
    plain = time.process_time() - begun
    assert path.tolist() == [x for text in want for x in text] and min(len(set(x)) for x in want) > 1
    assert took < plain / 3


def test_the_scan_is_spared_only_where_one_language_wins(monkeypatch):
    rng = np.random.default_rng(6)
    sizes = [2, *rng.integers(1, 7, 400)]
    scores = np.concatenate([[(0, 10, -30), (0, -30, 10)], *[rng.normal(size=(n, 3)) * rng.choice([3, 9]) for n in sizes[1:]]])
    n = len(scores)
    at = np.arange(n)
    made = Words(np.repeat(np.arange(len(sizes)), sizes), at, at + 1, np.zeros(n, int), np.stack([at, at], axis=1))
    monkeypatch.setattr(language_module, "words_of", lambda texts: made)
    model = LanguageModel(["a", "b", "c"], scores / 2, np.ones((1, 3), bool))
    _, path, got = label_words([""] * len(sizes), model)
    assert np.allclose(got, scores) and path[:2].tolist() == [1, 2]

    def worth(mine, way):
        return mine[np.arange(len(way)), way].sum() - 12 * (np.diff(way) != 0).sum()

    for i in range(len(sizes)):
        mine = made.text == i
        assert worth(scores[mine], path[mine]) == pytest.approx(worth(scores[mine], best_path(scores[mine], 12.0)))


def test_languages(spark, awkward, empty_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = fit_languages(docs)
    rows = identify_languages(docs, model).withColumnRenamed("key", "doc_id").join(docs.select("doc_id", "lang"), "doc_id")
    right = rows.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right >= 0.97
    texts = [r["text"] for r in docs.limit(150).collect()]
    words, path, scores = label_words(texts, model)
    for i in range(len(texts)):  # the bound that spares the scan does not change its result
        mine = words.text == i
        if mine.any():
            want = best_path(scores[mine], 12.0)
            assert (scores[mine][np.arange(mine.sum()), path[mine]].sum() - 12 * (np.diff(path[mine]) != 0).sum()
                    == pytest.approx(scores[mine][np.arange(mine.sum()), want].sum() - 12 * (np.diff(want) != 0).sum()))
    got = {(r["key"], r["lang_pred"], r["score"]) for r in identify_languages(awkward, model).collect()}
    assert {(3, "und", 0.0), (4, "und", 0.0), (5, "und", 0.0), (None, "und", 0.0)} <= got
    assert identify_languages(empty_docs, model).count() == 0
    nothing = fit_languages(empty_docs)
    assert {r["lang_pred"] for r in identify_languages(awkward, nothing).collect()} == {"und"}


def test_vectors_match_brute_force(spark):
    rng = np.random.default_rng(8)
    rows, at = [], 0
    for label in (1, 2, None):
        for size in (1, 1, 1, 2, 3, 9, 90):
            centre = rng.normal(size=16)
            for _ in range(size):
                rows.append((at, (centre + rng.normal(size=16) * 0.12).tolist(), label))
                at += 1
        rows += [(at, rows[-1][1], label), (at + 1, [2 * x for x in rows[-1][1]], label)]
        at += 2
    rows += [(at, None, 1), (at + 1, [0.0] * 16, 1), (at + 2, [float("nan")] * 16, 1), (at + 3, [None] * 16, 1), (None, rows[0][1], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    good = [v is not None and l is not None and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, l in rows]
    unit = [np.array(v) / np.linalg.norm(v) if g else None for (_, v, _), g in zip(rows, good)]
    links = [[j for j in range(len(rows)) if j != i and good[i] and good[j] and rows[i][2] == rows[j][2] and unit[i] @ unit[j] >= 0.98]
             for i in range(len(rows))]
    root = list(range(len(rows)))
    for _ in rows:
        for i, js in enumerate(links):
            root[i] = min([root[i], *[root[j] for j in js]])
    least = {}
    for i, (k, *_) in enumerate(rows):
        if k is not None:
            least[root[i]] = min(least.get(root[i], k), k)
    want = sorted((str(k), len(links[i]), least.get(root[i])) for i, (k, *_) in enumerate(rows))
    got = vector_dedup(df).collect()
    assert sorted((str(r["key"]), r["n_links"], r["component"]) for r in got) == want
    assert all(r["kept"] == (r["key"] == r["component"]) for r in got if r["key"] is not None)
    assert vector_dedup(df.where("false")).count() == 0


def near_groups(n, sizes, dim=64):
    """Random unit vectors, the first ones with ``sizes`` others around them at a cosine of 0.992."""
    rng = np.random.default_rng(4)
    points = rng.normal(size=(n, dim))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    out = [points]
    for centre, size in zip(points, sizes):
        apart = rng.normal(size=(size, dim))
        apart -= np.outer(apart @ centre, centre)
        out.append(0.992 * centre + math.sqrt(1 - 0.992**2) * apart / np.linalg.norm(apart, axis=1, keepdims=True))
    return np.concatenate(out)


def test_vectors_a_poor_graph_misses_are_compared_exactly(spark, monkeypatch):
    for name, value in (("PROJECTIONS", 1), ("AHEAD", 1), ("ROUNDS", 1), ("MOST_ROUNDS", 1)):
        monkeypatch.setattr(vectors_module, name, value)
    points = near_groups(500, [1] * 20 + [2, 5, 14, 20])
    cos = points @ points.T
    want = (cos >= 0.98).sum(axis=1) - 1
    df = spark.createDataFrame([(i, x.tolist(), 1) for i, x in enumerate(points)], "vec_id long, embedding array<double>, label int")
    rows = vector_dedup(df).collect()
    assert {r["key"]: r["n_links"] for r in rows} == dict(enumerate(want.tolist()))
    assert sum(r["kept"] for r in rows) == 500


def test_audit_meets_links_before_it_tells_recall(spark):
    points = near_groups(1500, [1])
    units = spark.createDataFrame([(i, 1, x.tolist(), 1) for i, x in enumerate(points)], "node long, label int, unit array<double>, copies long")
    none = spark.createDataFrame([], "a long, b long, cos double")
    pair = spark.createDataFrame([(0, 1500, 0.992)], none.schema)
    assert vectors_module.audit(none, units, 0.98) == 0.0
    assert vectors_module.audit(pair, units, 0.98) == 1.0
