import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window

from foldcast.operators.ordered import (
    dense_index, lag_rows, longest_key, sequence_blocks, series_block, series_blocks,
)
from tests.conftest import rows_of


def test_dense_index_equals_row_number(skewed):
    w = Window.partitionBy("key").orderBy("t")
    expected = skewed.withColumn("idx", (F.row_number().over(w) - 1).cast("bigint"))
    assert rows_of(dense_index(skewed, ["t"], ["key"])) == rows_of(expected)
    whole = dense_index(skewed, ["t"])
    assert [r.idx for r in whole.orderBy("t").collect()] == list(range(3000))


def test_index_of_null_keys(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 1)], "k string, t int")
    assert rows_of(dense_index(df, ["t"], ["k"])) == [(None, 1, 0), (None, 2, 1), ("a", 1, 0)]


def test_hot_key_is_spread(spark, tmp_path):
    """Range partitioning by key and order splits the key that holds a third."""
    rows = spark.range(90_000).selectExpr("IF(id < 30000, 0, 1 + id % 500) AS key", "id AS t")
    sizes = (
        rows.repartitionByRange(12, "key", "t").groupBy(F.spark_partition_id()).count().collect()
    )
    assert max(r["count"] for r in sizes) < 3 * 90_000 / 12


@pytest.mark.parametrize("chunk", [1, 7, 64, 100_000])
def test_chunked_lags_equal_one_window_per_key(skewed, chunk):
    shifts = [1, 3, -2]
    plain = lag_rows(skewed, ["v"], shifts, ["t"], ["key"], chunk_rows=None)
    chunked = lag_rows(skewed, ["v"], shifts, ["t"], ["key"], chunk_rows=chunk)
    assert rows_of(plain) == rows_of(chunked.select(*plain.columns))


def test_chunks_bound_the_window(skewed):
    """No group of the lag window is larger than the chunk and its margins."""
    indexed = dense_index(skewed, ["t"], ["key"], "_idx")
    sizes = indexed.groupBy("key", F.floor(F.col("_idx") / 100)).count()
    assert sizes.agg(F.max("count")).head()[0] == 100


def test_same_under_any_partitioning(skewed):
    one = lag_rows(skewed.coalesce(1), ["v"], [2], ["t"], ["key"], chunk_rows=50)
    many = lag_rows(skewed.repartition(8), ["v"], [2], ["t"], ["key"], chunk_rows=50)
    assert rows_of(one) == rows_of(many)


def test_lag_names_and_transformation(panel_small):
    out = lag_rows(panel_small, ["y"], [7], ["d"], ["entity"], "{col}.l{n}", F.log1p, None)
    assert out.columns[-1] == "y.l7"
    row = out.where("entity = 'e1' AND d = DATE '2020-01-09'").head()
    assert row["y.l7"] == pytest.approx(4.624972813)  # ln(1 + 101)
    with pytest.raises(ValueError, match="absent"):
        lag_rows(panel_small, ["absent"], [1], ["d"])
    assert lag_rows(panel_small, ["y"], [], ["d"]).columns == panel_small.columns


def test_entities_do_not_mix(panel_small):
    out = lag_rows(panel_small, ["y"], [1], ["d"], ["entity"], chunk_rows=5)
    assert out.where("y_l1 IS NULL").count() == 3
    assert out.where("y_l1 IS NOT NULL AND y_l1 <> y - 1").count() == 0


def test_blocks_concatenate_to_the_input(skewed):
    blocks = sequence_blocks(skewed, ["t", "v"], ["t"], 7, ["key"], batch_blocks=3)
    back = blocks.select("key", F.posexplode("records").alias("i", "r"), "block", "n", "batch")
    assert rows_of(back.select("key", "r.t", "r.v")) == rows_of(skewed.select("key", "t", "v"))
    assert back.where("batch <> floor(block / 3) OR i >= n OR n > 7").count() == 0
    ordered = back.withColumn(
        "before", F.lag("r.t").over(Window.partitionBy("key").orderBy("block", "i"))
    )
    assert ordered.where("before >= r.t").count() == 0
    full = sequence_blocks(skewed, ["t"], ["t"], 7, ["key"], drop_remainder=True)
    assert full.where("n <> 7").count() == 0
    assert full.count() == blocks.where("n = 7").count()
    with pytest.raises(ValueError):
        sequence_blocks(skewed, ["t"], ["t"], 0)


def test_series_block(panel_small):
    out = {r.entity: r for r in series_block(panel_small, ["y"], ["d"], ["entity"]).collect()}
    assert (out["e3"].n, out["e3"].records[0].y, out["e1"].n) == (30, 310, 40)
    with pytest.raises(ValueError):
        series_block(panel_small, ["y"], ["d"], [])
    with pytest.raises(ValueError, match="more than 39"):
        series_block(panel_small, ["y"], ["d"], ["entity"], most_rows=39)
    assert (longest_key(panel_small, ["entity"]), longest_key(panel_small)) == (40, 110)
    assert longest_key(panel_small.limit(0), ["entity"]) == 0


def test_series_of_any_length_in_blocks(spark):
    """One key is longer than a single block may be."""
    df = spark.range(0, 130_000, 1, 6).selectExpr("IF(id < 120000, NULL, id % 2) AS k", "130000 - id AS t", "id AS v")
    blocks, index = series_blocks(df, ["v"], ["t"], ["k"], block_rows=7000)
    lengths = {r.k: (r.n_rows, r.n_blocks, r.first_record.v, r.last_record.v) for r in index.collect()}
    assert lengths == {None: (120_000, 18, 119_999, 0), 0: (5000, 1, 129_998, 120_000), 1: (5000, 1, 129_999, 120_001)}
    series = [
        x.v for r in blocks.where("k IS NULL").orderBy("block").select("records").collect() for x in r.records
    ]
    assert series == list(range(119_999, -1, -1))
    assert blocks.agg(F.max("n")).head()[0] == 7000 and blocks.where("first <> block * 7000").count() == 0
    blocks, index = series_blocks(df.limit(0), ["v"], ["t"], ["k"])
    assert blocks.count() == 0 and index.count() == 0
