import random
import statistics

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foldcast.operators.ranks import (
    at_or_after_rank, exact_medians, rank_key, values_at_ranks,
)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    values=st.lists(
        st.one_of(st.none(), st.integers(-5, 5).map(float), st.floats(-1e6, 1e6)),
        min_size=1, max_size=80,
    ),
    small=st.sampled_from([1, 3, 1000]),
)
def test_median_is_exact(spark, values, small):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    known = [v for v in values if v is not None]
    got = exact_medians(df, ["v"], small)
    assert got == ({"v": pytest.approx(statistics.median(known))} if known else {})


def test_narrowing_on_many_values_with_a_hot_one(spark):
    values = [float(i * i % 100_003) for i in range(20_000)] + [77.0] * 10_000
    random.Random(1).shuffle(values)
    df = spark.createDataFrame([(v, int(v)) for v in values], "v double, k bigint")
    expected = statistics.median(values)
    assert exact_medians(df, ["v", "k"], small=50) == {"v": expected, "k": expected}


def test_value_below_and_equal(spark):
    df = spark.createDataFrame([(v,) for v in (1, 2, 2, 2, 9)], "v int")
    hit = values_at_ranks(df, {"v": rank_key(df, "v")}, lambda n: [2, 4])["v"]
    assert hit == {"n": 5, "values": {2: (2, 1, 3), 4: (9, 4, 1)}}


@pytest.mark.parametrize("small", [1, 20, 10_000])
def test_boundary_is_exact_under_ties(spark, small):
    df = spark.range(2000).selectExpr(
        "date_add(DATE '2020-01-01', IF(id % 3 = 0, 5, CAST(id % 11 AS INT))) AS d", "id % 7 AS a",
        "id",
    )
    expected = {r.id for r in df.orderBy("d", "a", "id").collect()[1234:]}
    late = at_or_after_rank(df, ["d", "a", "id"], 1234, 2000, small)
    assert {r.id for r in df.where(late).collect()} == expected


@pytest.mark.parametrize("small", [1, 10_000])
def test_clock_times_keep_their_order_in_any_zone(spark, small):
    """Local times around the hour that clocks repeat, in a zone that does so."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.range(300).selectExpr(
            "TIMESTAMP_NTZ'2024-11-02 23:30:00.25' + make_dt_interval(0, 0, id) AS t", "id")
        late = at_or_after_rank(df, ["t"], 120, 300, small)
        assert sorted(r.id for r in df.where(late).collect()) == list(range(120, 300))
        key = df.select(rank_key(df, "t").alias("k")).orderBy("id").head().k
        assert key == 1_730_590_200_250_000
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_boundary_needs_a_unique_order(spark):
    df = spark.range(10).selectExpr("id % 2 AS a")
    with pytest.raises(ValueError):
        at_or_after_rank(df, ["a"], 2, 10)
    with pytest.raises(ValueError):
        at_or_after_rank(df, ["a"], 11, 10)


def test_text_has_no_rank(spark):
    with pytest.raises(ValueError):
        rank_key(spark.range(1).select(F.lit("a").alias("s")), "s")
