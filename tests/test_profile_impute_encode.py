import statistics

import pytest
from pyspark.sql import functions as F

from foldcast.operators import encode, impute, profile
from tests.conftest import rows_of


@pytest.fixture
def nulls(spark):
    return spark.createDataFrame(
        [(1, 1.0, None, None, "a"), (2, None, 4, None, None), (3, 5.0, 2, None, "b"),
         (4, 2.0, 9, None, "a")],
        "id int, some double, whole int, gone double, word string",
    )


def test_profile(nulls):
    for exact in (True, False):
        got = {r["column"]: r for r in
               profile.column_profile(nulls, ["some", "whole", "gone"], exact).collect()}
        assert got["some"].mean == pytest.approx(8 / 3)
        assert got["some"].std == pytest.approx(statistics.stdev([1, 5, 2]))
        assert (got["some"].min, got["some"].max) == (1.0, 5.0)
        assert (got["some"].cardinality, got["some"].nan_values) == (3, 1)
        assert (got["gone"].cardinality, got["gone"].nan_values, got["gone"].mean) == (0, 4, None)


def test_null_counts(nulls):
    row = profile.null_counts(nulls).head()
    assert (row.some, row.whole, row.gone, row.word, row.total) == (1, 1, 4, 1, 7)


def test_distinct_values_cap(nulls):
    assert profile.distinct_values(nulls, "word") == ["a", "b"]
    with pytest.raises(ValueError, match="id"):
        profile.distinct_values(nulls, "id", cap=3)


def test_dataset_stats(nulls):
    row = profile.dataset_stats(nulls, "some").head()
    assert row.mean == pytest.approx(8 / 3)


def test_mask_null_median(nulls):
    out = impute.mask_null_median(nulls)
    assert "id_mask" not in out.columns
    got = {r.id: r for r in out.collect()}
    assert (got[2].some, got[2].some_mask, got[1].some_mask) == (2.0, 1, 0)
    assert (got[1].whole, got[1].whole_mask) == (4.0, 1)
    assert (got[1].gone, got[1].gone_mask) == (None, 1)
    assert (got[2].word, got[2].word_mask) == (None, 1)


def test_median_from_training_rows(nulls):
    out = impute.mask_null_median(nulls, ["some"], learn_from=nulls.where("id = 3"))
    assert {r.id: r.some for r in out.collect()}[2] == 5.0


def test_median_between_two_integers(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    assert rows_of(impute.mask_null_median(df)) == [(1.0, 0), (1.5, 1), (2.0, 0)]


def test_mask_only(nulls):
    out = impute.mask_nulls(nulls, ["some", "id"])
    assert out.columns == [*nulls.columns, "some_mask"]
    assert out.where("some_mask = 1 AND some IS NULL").count() == 1


def test_fills(nulls):
    assert {r.id: r.some for r in impute.fill_mean(nulls, ["some", "absent"]).collect()}[2] == (
        pytest.approx(8 / 3)
    )
    assert {r.id: r.some for r in impute.fill_mean(nulls, ["some"], {"some": 7.0}).collect()}[2] == 7
    assert {r.id: r.whole for r in impute.fill_min(nulls, ["whole"]).collect()}[1] == 2
    assert {r.id: r.gone for r in impute.fill_min(nulls, ["gone"]).collect()}[1] is None
    zero = {r.id: r for r in impute.fill_zero(nulls).collect()}
    assert (zero[1].gone, zero[2].word) == (0.0, None)
    custom = impute.fill_nulls(nulls, F.max, ["some"])
    assert {r.id: r.some for r in custom.collect()}[2] == 5.0


def test_null_policy(nulls):
    got = {r.id: r for r in impute.null_policy(nulls, ["whole"], ["some"]).collect()}
    assert got[1].whole == 0
    assert got[2].some == pytest.approx(8 / 3)


def test_empty_and_single(spark):
    empty = spark.createDataFrame([], "k int, v double")
    assert impute.mask_null_median(empty).count() == 0
    assert encode.onehot(empty, ["k"])[0].columns == ["v"]
    single = spark.createDataFrame([(1, 2.0)], "k int, v double")
    assert rows_of(impute.mask_null_median(single)) == [(1, 2.0)]


def test_onehot(spark):
    df = spark.createDataFrame([("b", 1), ("a", 3), (None, 1)], "cat string, code int")
    hot, names = encode.onehot(df, ["cat"])
    assert names == {"cat": ["cat_a", "cat_b"]}
    assert rows_of(hot) == [(1, 0, 0), (1, 0, 1), (3, 1, 0)]
    sums = hot.select((F.col("cat_a") + F.col("cat_b")).alias("s"))
    assert set(r.s for r in sums.collect()) <= {0, 1}
    ranged, names = encode.onehot_range(df, {"code": (1, 4)})
    assert names == {"code": ["code_1", "code_2", "code_3"]}
    assert ranged.agg(F.sum("code_1"), F.sum("code_2"), F.sum("code_3")).head() == (2, 0, 1)
    with pytest.raises(ValueError):
        encode.onehot(df, ["absent"])


def test_onehot_of_all_null_column_leaves_nothing(spark):
    df = spark.createDataFrame([(None, 1)], "cat string, x int")
    hot, names = encode.onehot(df, ["cat"])
    assert hot.columns == ["x"] and names == {"cat": []}


def test_values_above_the_bound_are_an_error_before_they_are_listed(spark):
    many = spark.range(10_001).withColumnRenamed("id", "v")
    with pytest.raises(ValueError, match="v has more than 10000"):
        encode.onehot(many, ["v"])


def test_sparse_onehot_equals_the_dense_form(spark):
    df = spark.createDataFrame(
        [(1, "b", 2.5), (2, "a", None), (3, None, -1.0), (4, "b", 2.5), (5, None, None), (5, None, None)],
        "id int, cat string, num double",
    )
    tables, width = encode.value_dictionaries(df, ["cat", "num"])
    assert width == 4
    got = encode.sparse_onehot(df, tables)
    assert got.columns == ["id", "hot"]
    dense, names = encode.onehot(df, ["cat", "num"])
    flat = [n for new in names.values() for n in new]
    want = sorted((r["id"], [i for i, n in enumerate(flat) if r[n]]) for r in dense.collect())
    assert sorted((r["id"], r["hot"]) for r in got.collect()) == want
    later = spark.createDataFrame([(9, "zz", 2.5), (10, "a", None)], df.schema)  # a value not learnt has no place
    assert sorted(map(tuple, encode.sparse_onehot(later, tables).collect())) == [(9, [3]), (10, [0])]
    with pytest.raises(ValueError, match="hot"):
        encode.sparse_onehot(df.withColumnRenamed("id", "hot"), tables)


def test_sparse_onehot_of_a_key_and_of_nothing(spark):
    df = spark.range(5000).selectExpr("id", "concat('k', lpad(id, 5, '0')) AS key", "IF(id % 3 = 0, 'hot', 'cold') AS few")
    tables, width = encode.value_dictionaries(df, ["few", "key"])
    assert width == 5002
    rows = {r.id: r.hot for r in encode.sparse_onehot(df, tables).collect()}
    assert len(rows) == 5000 and all(hot == [int(i % 3 == 0), 2 + i] for i, hot in rows.items())
    empty = df.limit(0)
    tables, width = encode.value_dictionaries(empty, ["few"])
    assert width == 0 and encode.sparse_onehot(empty, tables).count() == 0
    assert encode.sparse_onehot(df, tables).where("size(hot) > 0").count() == 0
    assert encode.sparse_stats(empty, ["few"]).count() == 0


def test_sparse_stats_equal_those_of_the_indicators(spark):
    df = spark.createDataFrame([("b", "x"), ("a", "x"), (None, "x"), ("b", "x")], "cat string, one string")
    got = {(r["column"], r["value"]): r for r in encode.sparse_stats(df, ["cat", "one"]).collect()}
    hot, names = encode.onehot(df, ["cat", "one"])
    assert len(got) == 3
    for column, value in got:
        name = f"{column}_{value}"
        want = hot.agg(F.avg(name), F.stddev_samp(name), F.min(name), F.max(name)).head()
        assert tuple(got[column, value])[2:] == pytest.approx(tuple(want))
