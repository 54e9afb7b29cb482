"""Lags, running means, gaps, blocks and long series."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldcast.catalogue.common import (
    DAILY_SQL, LAGS, PANEL_SQL, daily, panel, query, r, round_columns,
    segment_days, table, with_mask,
)
from foldcast.operators import rows
from foldcast.operators.columns import complete_masks
from foldcast.operators.joins import join_on
from foldcast.operators.ordered import lag_rows, sequence_blocks, series_blocks
from foldcast.operators.profile import day_extent
from foldcast.operators.series import lag_days, long_series, running_mean
from foldcast.plans.preparation import lag_features as filled_lags
from foldcast.plans.preparation import with_year

_ROW_LAGS = [1, 7, -1]


def _row_lag_sql(n: int, column: str = "y") -> str:
    function, by = ("lag", n) if n >= 0 else ("lead", -n)
    return f"{function}({column}, {by}) OVER (PARTITION BY entity ORDER BY d)"


@query(
    "lag_features",
    f"WITH {PANEL_SQL} SELECT entity, d, y, "
    + ", ".join(f"{_row_lag_sql(n)} AS \"y_l{n}\"" for n in _ROW_LAGS)
    + f", {r('ln(1 + ' + _row_lag_sql(1) + ')')} AS y_log1 FROM panel",
)
def lag_features(spark, sf_dir):
    df = panel(spark, sf_dir).select("entity", "d", "y")
    out = lag_rows(df, ["y"], _ROW_LAGS, ["d"], ["entity"], chunk_rows=None)
    out = lag_rows(
        out, ["y"], [1], ["d"], ["entity"], "{col}_log{n}", F.log1p, chunk_rows=None
    )
    return round_columns(out, ["y_log1"])


@query(
    "lag_features_raw",
    "SELECT event_id, user_id, "
    + ", ".join(
        f"lag(value, {n}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS value_l{n}"
        if n >= 0 else
        f"lead(value, {-n}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS \"value_l{n}\""
        for n in _ROW_LAGS
    )
    + " FROM events",
)
def lag_features_raw(spark, sf_dir):
    """Lags on raw rows, where one user may have any number of them."""
    df = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    out = lag_rows(df, ["value"], _ROW_LAGS, ["ts", "event_id"], ["user_id"])
    return out.drop("ts", "value")


_LAGGED_SQL = (
    f"WITH {PANEL_SQL}, lagged AS (SELECT entity, d, y, "
    + ", ".join(f"{_row_lag_sql(n)} AS l{n}" for n in (1, 7)) + " FROM panel)"
)


@query(
    "lag_features_filled",
    _LAGGED_SQL + " SELECT entity, d, y, "
    + ", ".join(f"{r(f'coalesce(l{n}, (SELECT avg(l{n}) FROM lagged))')} AS y_l{n}" for n in (1, 7))
    + " FROM lagged",
)
def lag_features_filled(spark, sf_dir):
    df = panel(spark, sf_dir).select("entity", "d", "y")
    return round_columns(filled_lags(df, ["y"], [1, 7], ["d"], ["entity"]), ["y_l1", "y_l7"])


@query(
    "lag_normalised",
    _LAGGED_SQL + " SELECT entity, d, y, "
    + ", ".join(
        r(f"coalesce((l{n} - (SELECT avg(l{n}) FROM lagged)) / "
          f"(SELECT stddev_pop(l{n}) FROM lagged), 0.0)") + f" AS y_l{n}"
        for n in (1, 7)
    )
    + " FROM lagged",
)
def lag_normalised(spark, sf_dir):
    df = panel(spark, sf_dir).select("entity", "d", "y")
    out = filled_lags(df, ["y"], [1, 7], ["d"], ["entity"], normalised=True)
    return round_columns(out, ["y_l1", "y_l7"])


@query(
    "lag_days",
    f"WITH {PANEL_SQL} SELECT a.entity, a.d, a.y, b.y AS y_d7, c.y AS y_d365 FROM panel a "
    "LEFT JOIN panel b ON a.entity = b.entity AND a.d = b.d + 7 "
    "LEFT JOIN panel c ON a.entity = c.entity AND a.d = c.d + 365",
)
def calendar_lags(spark, sf_dir):
    df = panel(spark, sf_dir).select("entity", "d", "y")
    return lag_days(df, ["y"], [7, 365], "d", ["entity"])


@query(
    "running_mean_baseline",
    f"WITH {PANEL_SQL} SELECT entity, d, y, y_mask, "
    + r("avg(CASE WHEN y_mask = 0 THEN y END) OVER (PARTITION BY entity ORDER BY d "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    + " AS p FROM panel",
)
def running_mean_baseline(spark, sf_dir):
    df = complete_masks(with_mask(panel(spark, sf_dir)), ["y"])
    p = running_mean(F.col("y"), "d", ["entity"], F.col("y_mask"))
    return round_columns(df.select("entity", "d", "y", "y_mask", p.alias("p")), ["p"])


@query(
    "complete_masks",
    f"WITH {DAILY_SQL} SELECT 'y' AS target, y_mask AS mask, CAST(sum(y) AS BIGINT) AS orders, count(*) AS days "
    "FROM daily GROUP BY y_mask UNION ALL SELECT 'revenue', 0, CAST(sum(y) AS BIGINT), count(*) FROM daily",
)
def completed_masks(spark, sf_dir):
    """Days per target and mask; the revenue comes without a mask and counts on every day."""
    df = complete_masks(daily(spark, sf_dir), ["y", "revenue"])
    masks = F.array(*[
        F.struct(F.lit(t).alias("target"), F.col(f"{t}_mask").alias("mask")) for t in ("y", "revenue")
    ])
    return (
        df.select("y", F.explode(masks).alias("m")).groupBy("m.target", "m.mask")
        .agg(F.sum("y").alias("orders"), F.count(F.lit(1)).alias("days"))
    )


@query(
    "year_column",
    f"WITH {DAILY_SQL} SELECT excel_day, y, CAST(year(d) AS INTEGER) AS x_c_y FROM daily",
)
def year_column(spark, sf_dir):
    """The year of days that are held as spreadsheet day numbers."""
    return with_year(daily(spark, sf_dir).select("excel_day", "y"), "excel_day")


@query(
    "day_continuity",
    f"WITH {PANEL_SQL} SELECT entity, CAST(sum(y) AS BIGINT) AS n_rows, min(d) AS first_day, "
    "max(d) AS last_day, date_diff('day', min(d), max(d)) + 1 - count(*) AS n_missing, "
    "CAST(sum(y) - count(*) AS BIGINT) AS n_repeated, "
    "date_diff('day', min(d), max(d)) + 1 = sum(y) AS consecutive FROM panel GROUP BY 1",
)
def day_continuity(spark, sf_dir):
    return rows.day_continuity(segment_days(spark, sf_dir), "d", ["entity"], count="n")


@query(
    "missing_days",
    "WITH days AS (SELECT DISTINCT c_nationkey AS entity, CAST(o_orderdate AS DATE) AS d "
    "FROM orders JOIN customer ON o_custkey = c_custkey) "
    "SELECT entity, CAST(d AS DATE) AS d FROM (SELECT entity, "
    "unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS d FROM days GROUP BY entity) "
    "EXCEPT SELECT entity, d FROM days",
)
def missing_days(spark, sf_dir):
    nations = segment_days(spark, sf_dir, "c_nationkey").select("entity", "d")
    return rows.missing_days(nations, "d", ["entity"])


@query(
    "sequence_blocks",
    f"""WITH placed AS (
      SELECT user_id, event_id, value,
             row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events)
    SELECT user_id, i // 5 AS block, (i // 5) // 4 AS batch, CAST(count(*) AS INTEGER) AS n,
           arg_min(event_id, i) AS first_id, arg_max(event_id, i) AS last_id,
           {r('sum(value)', 4)} AS total
    FROM placed GROUP BY 1, 2, 3""",
)
def event_blocks(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    blocks = sequence_blocks(
        events.select("user_id", "ts", "event_id", "value"),
        ["event_id", "value"], ["ts", "event_id"], 5, ["user_id"], batch_blocks=4,
    )
    total = F.aggregate("records", F.lit(0.0), lambda acc, x: acc + x["value"])
    return round_columns(
        blocks.select(
            "user_id", "block", "batch", "n",
            F.element_at("records", 1)["event_id"].alias("first_id"),
            F.element_at("records", -1)["event_id"].alias("last_id"),
            total.alias("total"),
        ),
        ["total"], 4,
    )


_LINE_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@query(
    "series_blocks",
    f"""WITH placed AS (
      SELECT l_linestatus, l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_linestatus
             ORDER BY {', '.join(f'{c} NULLS FIRST' for c in _LINE_ORDER)}) - 1 AS i FROM lineitem),
    cut AS (
      SELECT l_linestatus, i // 10000 AS block, CAST(count(*) AS INTEGER) AS n, arg_min(l_orderkey, i) AS first_order,
             arg_max(l_orderkey, i) AS last_order, CAST(sum(l_partkey * (i + 1)) AS BIGINT) AS checksum
      FROM placed GROUP BY 1, 2)
    SELECT *, CAST(sum(n) OVER (PARTITION BY l_linestatus) AS BIGINT) AS n_rows,
           count(*) OVER (PARTITION BY l_linestatus) AS n_blocks FROM cut""",
)
def whole_series(spark, sf_dir):
    """The shipments of each status as one series: a few keys hold all rows."""
    lines = table(spark, sf_dir, "lineitem").select("l_linestatus", *_LINE_ORDER)
    blocks, index = series_blocks(lines, [], _LINE_ORDER, ["l_linestatus"])
    weighted = F.transform("records", lambda x, i: x["l_partkey"] * (F.col("first") + i + 1))
    return join_on(
        blocks.select(
            "l_linestatus", "block", "n",
            F.element_at("records", 1)["l_orderkey"].alias("first_order"),
            F.element_at("records", -1)["l_orderkey"].alias("last_order"),
            F.aggregate(weighted, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("checksum"),
        ),
        index.select("l_linestatus", "n_rows", "n_blocks"),
        ["l_linestatus"],
    )


_FIRST, _LAST = "1996-01-01", "1999-12-31"


@query(
    "series_long",
    f"WITH {DAILY_SQL}, preds AS ("
    + " UNION ALL ".join(
        f"SELECT 'lag {n}' AS series, a.d, CAST(b.y AS DOUBLE) AS value FROM daily a "
        f"JOIN daily b ON a.d = b.d + {n}" for n in LAGS
    )
    + ") SELECT * FROM (SELECT 'actual' AS series, d, CAST(y AS DOUBLE) AS value FROM daily "
    f"UNION ALL SELECT * FROM preds) WHERE d BETWEEN DATE '{_FIRST}' AND DATE '{_LAST}'",
)
def series_long(spark, sf_dir):
    df = daily(spark, sf_dir).select("d", "y")
    wide = lag_days(df, ["y"], LAGS, "d", template="lag {n}")
    predicted = long_series(wide, "d", {f"lag {n}": F.col(f"lag {n}") for n in LAGS})
    actual = long_series(df, "d", {"actual": F.col("y")})
    return rows.between_days(actual.unionByName(predicted), "d", _FIRST, _LAST)


@query(
    "series_extent",
    "SELECT min(d) AS first_day, max(d) AS last_day FROM ("
    "SELECT CAST(o_orderdate AS DATE) AS d FROM orders UNION ALL "
    "SELECT CAST(l_shipdate AS DATE) FROM lineitem)",
)
def series_extent(spark, sf_dir):
    ordered = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("d"))
    shipped = table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("d"))
    return day_extent(ordered.unionByName(shipped), "d")
