"""Folds, splits, fold statistics and the whole preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldcast.catalogue.common import (
    DAILY_SQL, FOLD_YEARS, FOLDS_SQL, daily, query, r, round_columns, rounded, table,
)
from foldcast.operators.folds import (
    assign_folds, fold_day_check, fold_table, folds_of_years, ordered_split as split_in_order, random_split as split_at_random,
    shuffled_copies,
)
from foldcast.operators.scale import group_stats, merge_stats, scale_by_group
from foldcast.plans import metadata as md
from foldcast.plans.metadata import ColumnSpec, ColumnTable
from foldcast.plans.preparation import prepare_folds
from foldcast.session import materialise, small_table


@query(
    "folds_by_year",
    f"WITH {DAILY_SQL}, {FOLDS_SQL} SELECT CAST(fold AS INTEGER) AS fold, split, "
    "count(*) AS n_days, CAST(sum(y) AS BIGINT) AS n_orders, min(d) AS first_day, "
    "max(d) AS last_day FROM daily JOIN folds ON year(d) = year GROUP BY 1, 2",
)
def folds_by_year(spark, sf_dir):
    df = daily(spark, sf_dir)
    year = F.year("d")
    return (
        assign_folds(df, fold_table(df, year, FOLD_YEARS, 1), year)
        .groupBy("fold", "split")
        .agg(
            F.count(F.lit(1)).alias("n_days"),
            F.sum("y").alias("n_orders"),
            F.min("d").alias("first_day"),
            F.max("d").alias("last_day"),
        )
    )


@query(
    "fold_continuity",
    f"""WITH {DAILY_SQL}, {FOLDS_SQL}, expected AS (
      SELECT fold, split, date_diff('day', make_date(min(year), 1, 1), make_date(max(year) + 1, 1, 1)) AS n_expected
      FROM folds GROUP BY 1, 2),
    present AS (SELECT fold, split, count(*) AS n_days, CAST(sum(y) AS BIGINT) AS n_rows
                FROM daily JOIN folds ON year(d) = year GROUP BY 1, 2)
    SELECT CAST(fold AS INTEGER) AS fold, split, n_days, n_rows, n_expected, n_days = n_expected AS complete
    FROM expected JOIN present USING (fold, split)""",
)
def fold_continuity(spark, sf_dir):
    df = daily(spark, sf_dir)
    return fold_day_check(df, fold_table(df, F.year("d"), FOLD_YEARS, 1), "d", count="y")


_SHIP_FOLDS_SQL = f"""years AS (
  SELECT year, row_number() OVER (ORDER BY year) AS k
  FROM (SELECT DISTINCT CAST(year(l_shipdate) AS INTEGER) AS year FROM lineitem)),
folds AS (
  SELECT fold, CASE WHEN k <= fold THEN 'train' ELSE 'valid' END AS split, year
  FROM years, (VALUES {', '.join(f'({n})' for n in FOLD_YEARS)}) f(fold) WHERE k <= fold + 1)"""


@query(
    "fold_normalise",
    f"""WITH {_SHIP_FOLDS_SQL}, rows AS (
      SELECT CAST(fold AS INTEGER) AS fold, split, l_orderkey, l_partkey, l_suppkey, l_quantity,
             l_extendedprice FROM lineitem JOIN folds ON year(l_shipdate) = year),
    s AS (SELECT fold, avg(l_extendedprice) AS m, stddev_pop(l_extendedprice) AS sd,
                 min(l_quantity) AS lo, max(l_quantity) AS hi
          FROM rows WHERE split = 'train' GROUP BY 1)
    SELECT rows.fold, split, l_orderkey, l_partkey, l_suppkey,
           {r('-1 + (l_quantity - lo) * 2 / (hi - lo)')} AS l_quantity,
           {r('(l_extendedprice - m) / sd')} AS l_extendedprice
    FROM rows JOIN s ON rows.fold = s.fold""",
)
def fold_normalise(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
        F.year("l_shipdate").alias("year"),
    )
    year, measured = F.col("year"), ["l_quantity", "l_extendedprice"]
    yearly = small_table(group_stats(df, measured, ["year"]))  # a row per year
    folds = folds_of_years(spark, sorted(r.year for r in yearly.collect()), FOLD_YEARS, 1)
    train = merge_stats(
        yearly.join(F.broadcast(folds.where("split = 'train'")), "year"), measured, ["fold"]
    )
    rows = assign_folds(df, folds, year).drop("year")
    scaled = scale_by_group(rows, F.broadcast(train), ["fold"], ["l_extendedprice"], ["l_quantity"])
    return round_columns(scaled, measured)


_LINE_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@query(
    "ordered_split",
    f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN "
    f"row_number() OVER (ORDER BY {', '.join(_LINE_ORDER)}) > "
    "count(*) OVER () - ceil(count(*) OVER () * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS split "
    "FROM lineitem",
)
def ordered_split(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(*_LINE_ORDER)
    return split_in_order(df, _LINE_ORDER, 0.2).drop("l_shipdate")


@query(
    "ordered_split_by_user",
    "SELECT event_id, user_id, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY ts, "
    "event_id) > count(*) OVER (PARTITION BY user_id) - ceil(count(*) OVER (PARTITION BY user_id) "
    "* 0.25::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM events",
)
def ordered_split_by_user(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return split_in_order(df, ["ts", "event_id"], 0.25, keys=["user_id"]).drop("ts")


_HASH_SQL = "('0x' || substr(md5(o_orderkey || '|{seed}'), 1, 13))::BIGINT"


@query(
    "random_split",
    f"SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY {_HASH_SQL.format(seed=42)}, "
    "o_orderkey) > count(*) OVER () - ceil(count(*) OVER () * 0.3::DOUBLE) THEN 'test' "
    "ELSE 'train' END AS split FROM orders",
)
def random_split(spark, sf_dir):
    return split_at_random(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], 0.3)


@query(
    "fake_features",
    "WITH own AS (SELECT o_orderkey, o_totalprice, o_custkey, "
    "row_number() OVER (ORDER BY o_orderkey) AS i FROM orders), "
    + ", ".join(
        f"h_{c} AS (SELECT {c} AS {c}_fake, row_number() OVER (ORDER BY "
        f"{_HASH_SQL.format(seed='7' + c)}, o_orderkey) AS i FROM orders)"
        for c in ("o_totalprice", "o_custkey")
    )
    + " SELECT o_orderkey, o_totalprice, o_custkey, o_totalprice_fake, o_custkey_fake FROM own "
    "JOIN h_o_totalprice USING (i) JOIN h_o_custkey USING (i)",
)
def fake_features(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_custkey")
    return shuffled_copies(df, ["o_totalprice", "o_custkey"], ["o_orderkey"], seed=7)


PREPARED_TABLE = ColumnTable.of(
    [
        ColumnSpec("d", operation=md.DATE, sort="asc1"),
        ColumnSpec("y", operation=md.TARGET, normalisation=md.STD),
        ColumnSpec("y_mask", operation=md.TARGET_MASK),
        ColumnSpec("excel_day", operation=md.REMOVE),
        ColumnSpec("revenue", normalisation=md.STD, null_value=md.MEAN),
        ColumnSpec("x_c_m", normalisation=md.MINMAX),
        ColumnSpec("x_c_q", operation="onetomany:1:5"),
        ColumnSpec("weekend", operation=md.ONE_TO_MANY),
    ]
)


def preparation_input(spark, sf_dir):
    return daily(spark, sf_dir).select(
        "d", "y", "y_mask", "excel_day",
        F.when(F.col("excel_day") % 17 != 0, rounded(F.col("revenue"), 2)).alias("revenue"),
        F.month("d").alias("x_c_m"),
        F.quarter("d").alias("x_c_q"),
        F.when(F.dayofweek("d").isin(1, 7), F.lit("yes")).otherwise(F.lit("no")).alias("weekend"),
    )


@query(
    "fold_preparation",
    f"""WITH {DAILY_SQL}, {FOLDS_SQL},
    raw AS (
      SELECT d, y, y_mask, CASE WHEN excel_day % 17 = 0 THEN NULL ELSE {r('revenue', 2)} END AS rev,
             month(d) AS m, quarter(d) AS q, dayofweek(d) IN (0, 6) AS weekend FROM daily),
    filled AS (
      SELECT d, y, y_mask, coalesce(rev, (SELECT median(rev) FROM raw)) AS rev,
             CASE WHEN rev IS NULL THEN 1 ELSE 0 END AS revenue_mask, m, q, weekend,
             lag(y, 7) OVER (ORDER BY d) AS lag7 FROM raw),
    ready AS (SELECT * REPLACE (coalesce(lag7, (SELECT avg(lag7) FROM filled)) AS lag7) FROM filled),
    rows AS (SELECT CAST(fold AS INTEGER) AS fold, split, ready.*
             FROM ready JOIN folds ON year(d) = year),
    s AS (
      SELECT fold, avg(y) AS ym, stddev_pop(y) AS ys, avg(rev) AS rm, stddev_pop(rev) AS rs,
             min(m) AS mlo, max(m) AS mhi, avg(lag7) AS lm, stddev_pop(lag7) AS ls
      FROM rows WHERE split = 'train' GROUP BY 1)
    SELECT rows.fold, split, d, y_mask, revenue_mask,
           {r('(y - ym) / ys')} AS y, {r('(rev - rm) / rs')} AS revenue,
           {r('-1 + (m - mlo) * 2.0::DOUBLE / (mhi - mlo)')} AS x_c_m,
           {', '.join(f"CASE WHEN q = {v} THEN 1 ELSE 0 END AS x_c_q_{v}" for v in range(1, 5))},
           CASE WHEN weekend THEN 0 ELSE 1 END AS weekend_no,
           CASE WHEN weekend THEN 1 ELSE 0 END AS weekend_yes,
           {r('(lag7 - lm) / ls')} AS y_l7
    FROM rows JOIN s ON rows.fold = s.fold""",
)
def fold_preparation(spark, sf_dir):
    # The daily table is kept, so that each step does not sum the orders again.
    days = materialise(preparation_input(spark, sf_dir), "daily")
    prepared = prepare_folds(days, PREPARED_TABLE, FOLD_YEARS, 1, lags=[7])
    return round_columns(prepared.rows, ["y", "revenue", "x_c_m", "y_l7"])
