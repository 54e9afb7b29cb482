import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldcast.llm import hard_negatives as H
from foldcast.llm.queries import QUERIES
from tests.llm.conftest import SMALL

SCHEMA = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("label", T.IntegerType()),
])


def brute(rows, every=50, shift=True):
    """By the definition, over (vec_id, embedding, label)."""
    good = {}
    for key, vector, label in rows:
        if key is None or label is None or vector is None:
            continue
        if any(x is None or not math.isfinite(x) for x in vector):
            continue
        label = (label + 1) % 10 if shift and key % 7 == 0 else label
        v = [math.floor(256 * x) for x in vector]
        good[key] = min(good.get(key, (label, v)), (label, v))
    out = []
    for a, (label, v) in good.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), b, own) for b, (own, w) in good.items() if b != a)
        for p, b, _ in [s for s in scored if s[2] == label][:5]:
            fitting = [s for s in scored if s[2] != label and 50 * -p <= 100 * -s[0] <= 95 * -p]
            out += [(a, b, n + 1, c, -p, -s) for n, (s, c, _) in enumerate(fitting[:3])]
    return sorted(out)


def found(frame):
    return sorted(map(tuple, frame.collect()))


@pytest.mark.parametrize("sf_dir", [SMALL, "/root/testdata/sf0.01"])
def test_query_equals_brute_force(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    want = brute(rows)
    assert want and found(QUERIES["op13_hard_negatives"](spark, sf_dir)) == want


def awkward(rng):
    rows = [(i, rng.normal(0, 1, 6).astype(np.float32).tolist(), int(rng.integers(0, 3))) for i in range(200)]
    rows += [(200 + i, rows[10][1], 0) for i in range(30)] + [(300 + i, rows[10][1], 1) for i in range(30)]  # ties
    rows += [(None, [1.0] * 6, 1), (401, None, 1), (402, [1.0, None], 1), (403, [float("nan")] * 6, 1),
             (404, [float("inf")] * 6, 1), (405, [1.0] * 6, None), (406, [], 2), (450, [], 2), (407, [0.5] * 3, 2),
             (500, [0.0] * 6, 1), (550, [0.5] * 9, 0), (5, rows[5][1], rows[5][2]), (50, rows[50][1], rows[50][2])]
    return rows


def test_awkward_rows_and_small_blocks(spark):
    rows = awkward(np.random.default_rng(1))
    table = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows, 10, False)
    assert want
    plain = H.hard_negatives(table, F.col("id") % 10 == 0, block=40)
    assert found(plain) == want
    for name in ("id", "v", "block", "score", "place", "means", "rank", "row", "a_v", "anchor_id", "n_v"):
        table = table.withColumn(name, F.lit(f"extra {name}"))
    assert found(H.hard_negatives(table, F.col("id") % 10 == 0)) == want


def test_empty_table_and_no_anchor(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert H.hard_negatives(empty, F.col("id") % 50 == 0).collect() == []
    one = spark.createDataFrame([(1, [1.0], 1), (2, [1.0], 2)], SCHEMA)
    assert H.hard_negatives(one, F.col("id") % 50 == 0).collect() == []


def test_components_beyond_the_scores_raise(spark):
    table = spark.createDataFrame([(50, [1e12] * 6, 1), (2, [1.0] * 6, 1)], SCHEMA)
    with pytest.raises(Exception, match="too large"):
        H.hard_negatives(table, F.col("id") % 50 == 0).collect()


def test_bounds_hold_and_spare_pairs():
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 60, (5, 64)) + rng.normal(0, 200, (5, 1))
    v = (centres[rng.integers(0, 5, 3000)] + rng.normal(0, 12, (3000, 64))).astype(np.int64)
    means, deviations = H.segment_summaries(v.astype(float))
    exact = (v @ v.T).astype(float)
    last = None
    for level in H.level_columns(64):
        middle, spread = means[:, level] @ means[:, level].T, deviations[:, level] @ deviations[:, level].T
        assert (exact <= middle + spread + 1e-3).all() and (exact >= middle - spread - 1e-3).all()
        assert last is None or (spread.sum() < last)  # finer segments bound more tightly
        last = spread.sum()
    table = {"ids": np.arange(3000), "labels": np.zeros(3000, int), "v": v, "means": means, "deviations": deviations}
    some = {c: x[:50] for c, x in table.items()}
    scored: list[int] = []
    wide = np.full((50, 1), 1 << 62)
    a, _, r, score = H.best_in_windows(some, table, -wide, wide, 5, True, H.level_columns(64), 500, scored)
    assert sum(scored) < 0.75 * 50 * 3000
    for i in range(50):
        order = sorted((-int(exact[i, j]), j) for j in range(3000) if j != i)[:5]
        assert [(-s, j) for s, j in zip(score[a == i].tolist(), r[a == i].tolist())] == order
