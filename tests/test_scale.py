import pytest
from pyspark.sql import functions as F

from foldcast.operators import scale
from foldcast.operators.scale import Stats
from foldcast.sources.moments import MomentStore


@pytest.fixture
def frame(spark):
    return spark.createDataFrame(
        [("a", 1.0, 5, None, "1"), ("a", 3.0, 5, None, "x"), ("b", 8.0, 5, None, "4")],
        "g string, v double, same int, gone double, text string",
    )


def test_std(frame):
    out = scale.scale_std(frame, ["v", "same", "gone", "absent"])
    row = out.agg(F.avg("v"), F.stddev_pop("v"), F.max("same"), F.count("gone")).head()
    assert row[0] == pytest.approx(0) and row[1] == pytest.approx(1)
    assert row[2] == 0.0 and row[3] == 0


def test_minmax(frame):
    out = scale.scale_minmax(frame, ["v", "same", "gone"])
    assert [r.v for r in out.orderBy("v").collect()] == pytest.approx([-1, -1 + 4 / 7, 1])
    assert out.where("same <> -1 OR gone IS NOT NULL").count() == 0
    unit = scale.scale_minmax(frame, ["v"], to=(0.0, 1.0))
    assert unit.agg(F.min("v"), F.max("v")).head() == (0.0, 1.0)


def test_learnt_values_are_matched_by_name(frame):
    learnt = {"same": Stats(mean=4.0, std=2.0), "v": Stats(1.0, 0.0, 0.0, 2.0)}
    out = scale.scale_std(frame, ["v", "same"], learnt).orderBy("v")
    assert [(r.v, r.same) for r in out.collect()] == [(0.0, 0.5), (2.0, 0.5), (7.0, 0.5)]
    beyond = scale.scale_minmax(frame, ["v"], learnt)  # not clipped
    assert beyond.agg(F.max("v")).head()[0] == 7.0
    with pytest.raises(ValueError, match="gone"):
        scale.scale_std(frame, ["gone"], learnt)


def test_text_that_is_no_number_becomes_null(frame):
    out = scale.scale_minmax(frame, ["text"], {"text": Stats(min=1.0, max=4.0)})
    assert sorted(r.text for r in out.collect() if r.text is not None) == [-1.0, 1.0]


def test_apply_equals_fit_and_apply(frame):
    learnt = scale.learn(frame, ["v"])
    both = scale.scale_std(frame, ["v"]).exceptAll(scale.scale_std(frame, ["v"], learnt))
    assert both.count() == 0


def test_merged_parts_equal_the_whole(spark):
    df = spark.range(1000).selectExpr(
        "id % 5 AS part", "1e6 + sin(id) * 10 AS v", "IF(id % 5 = 0, NULL, id) AS w"
    )
    whole = scale.group_stats(df, ["v", "w"]).head()
    parts = scale.group_stats(df, ["v", "w"], ["part"]).withColumn("all", F.lit(1))
    merged = scale.merge_stats(parts, ["v", "w"], ["all"]).head()
    for c in ("v", "w"):
        for s in ("n", "mean", "std", "std_samp", "min", "max"):
            assert merged[c][s] == pytest.approx(whole[c][s], rel=1e-9), (c, s)


def test_scale_by_group(frame):
    stats = scale.group_stats(frame, ["v"], ["g"])
    out = scale.scale_by_group(frame, stats, ["g"], std=["v"])
    assert sorted(r.v for r in out.collect()) == pytest.approx([-1, 0, 1])


def test_long_stats_and_upsert(spark, frame):
    stats = scale.long_stats(scale.group_stats(frame, ["v", "same"], ["g"]), ["v", "same"])
    assert stats.count() == 4
    stored = stats.select("g", "column", "mean", "max")
    fresh = spark.createDataFrame(
        [("a", "v", 9.0), ("c", "v", 1.0), ("b", "v", None)], "g string, column string, mean double"
    )
    got = {(r.g, r["column"]): r for r in
           scale.upsert_stats(stored, fresh, ["g", "column"]).collect()}
    assert len(got) == 5
    assert (got["a", "v"].mean, got["a", "v"].max) == (9.0, 3.0)
    assert (got["b", "v"].mean, got["c", "v"].max) == (8.0, None)


def moment_rows(df):
    return {(r["g"], r["column"]): tuple(r)[2:] for r in df.collect()}


def test_moment_store_keeps_up_with_all_rows(spark, tmp_path):
    rows = spark.range(3000).selectExpr(
        "IF(id < 1000, NULL, id % 7) AS g", "id % 4 AS batch", "1e8 + sin(id) AS v",
        "IF(id % 7 = 2 OR id % 4 = 3, NULL, CAST(id AS INT)) AS w",
    )
    store = MomentStore(str(tmp_path / "m"), ["g"], ["v", "w"])
    for n in (0, 1):
        store.add(rows.where(F.col("batch") == n), F.col("batch"))
    before = sorted((tmp_path / "m" / "_batch=0").glob("*.parquet"))
    store.add(rows.where("batch > 1"), F.nullif("batch", F.lit(3)))  # batch 3 has the name null
    store.add(rows.where("batch = 2"), F.col("batch"))  # repeated: counts once
    assert sorted((tmp_path / "m" / "_batch=0").glob("*.parquet")) == before  # not rewritten
    want = moment_rows(scale.long_stats(scale.group_stats(rows, ["v", "w"], ["g"]), ["v", "w"]))
    assert want[2, "w"] == (0, None, None, None, None, None)
    small = store.compact(spark, str(tmp_path / "c"), "all")
    for now in (store, small):
        got = moment_rows(now.read(spark))
        assert got.keys() == want.keys()
        for key, values in want.items():
            assert got[key] == (pytest.approx(values, rel=1e-6) if values[0] else values), key


def test_moments_merge_in_one_order(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 1, 4.0), ("a", 2, 9.0), ("b", 1, None)], "g string, p int, v double")
    parts = scale.moments(df, ["v"], ["g", "p"])
    got = {r.g: tuple(r)[2:] for r in scale.merge_moments(parts, ["g", "column"], ["p"]).collect()}
    assert got == {"a": (3, 5.0, 26.0, 2.0, 9.0), "b": (0, None, None, None, None)}
