"""Profiles, nulls, one-hot, scaling, selection and text on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldcast.catalogue.common import (
    EXCEL_DAY_SQL, PANEL_SQL, PRICED_SQL, panel, priced_orders, query, r, round_columns, rounded,
    table, with_mask,
)
from foldcast.functions.dates import (
    display_day, first_of_year, from_excel_day, parse_day, to_excel_day,
)
from foldcast.functions.text import names_in_groups
from foldcast.operators import columns as cols
from foldcast.operators import encode, impute, profile, pseudonymise, rows, scale
from foldcast.operators.ordered import dense_index, lag_rows
from foldcast.plans import headers, metadata as md
from foldcast.plans.metadata import ColumnSpec, ColumnTable
from foldcast.plans.preparation import indicator_stats
from foldcast.session import fresh_path
from foldcast.sources.moments import MomentStore
from foldcast.sources.tables import read_csv, write_csv

MEASURES = ["l_quantity", "l_extendedprice", "l_discount"]


# --- profiles -------------------------------------------------------------------

_PROFILED = ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _profile_sql(column: str) -> str:
    return (
        f"SELECT '{column}' AS \"column\", {r(f'avg({column})', 4)} AS mean, "
        f"{r(f'stddev_samp({column})', 4)} AS std, CAST(min({column}) AS DOUBLE) AS min, "
        f"CAST(max({column}) AS DOUBLE) AS max, "
        f"CAST(count(*) - count({column}) AS BIGINT) AS nan_values, "
        f"CAST(count(DISTINCT {column}) AS BIGINT) AS cardinality FROM lineitem"
    )


@query("column_profile", " UNION ALL ".join(_profile_sql(c) for c in _PROFILED))
def column_profile(spark, sf_dir):
    out = profile.column_profile(table(spark, sf_dir, "lineitem"), _PROFILED)
    return round_columns(out, ["mean", "std"], 4)


@query(
    "null_count",
    f"WITH {PRICED_SQL} SELECT count(*) - count(price) AS price, "
    "count(*) - count(priority) AS priority, "
    "2 * count(*) - count(price) - count(priority) AS total FROM priced",
)
def null_count(spark, sf_dir):
    return profile.null_counts(priced_orders(spark, sf_dir), ["price", "priority"])


@query(
    "dataset_stats",
    f"WITH {PANEL_SQL} SELECT entity AS dataset, {r('avg(y)')} AS mean, "
    f"{r('stddev_samp(y)')} AS std FROM panel GROUP BY 1 UNION ALL "
    f"SELECT 'all', {r('avg(y)')}, {r('stddev_samp(y)')} FROM "
    "(SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS y FROM orders GROUP BY 1)",
)
def dataset_stats(spark, sf_dir):
    by_entity = panel(spark, sf_dir).select(F.col("entity").alias("dataset"), "d", "y")
    total = by_entity.groupBy("d").agg(F.sum("y").alias("y")).withColumn("dataset", F.lit("all"))
    both = by_entity.unionByName(total)
    return round_columns(profile.dataset_stats(both, "y", ["dataset"]), ["mean", "std"])


# --- nulls ----------------------------------------------------------------------


@query(
    "mask_null_median",
    f"WITH {PRICED_SQL} SELECT o_orderkey, o_custkey, "
    "coalesce(price, (SELECT median(price) FROM priced)) AS price, priority, "
    "CASE WHEN price IS NULL THEN 1 ELSE 0 END AS price_mask, "
    "CASE WHEN priority IS NULL THEN 1 ELSE 0 END AS priority_mask FROM priced",
)
def mask_null_median(spark, sf_dir):
    return impute.mask_null_median(priced_orders(spark, sf_dir))


@query(
    "mask_nulls",
    f"WITH {PRICED_SQL} SELECT *, CASE WHEN price IS NULL THEN 1 ELSE 0 END AS price_mask, "
    "CASE WHEN priority IS NULL THEN 1 ELSE 0 END AS priority_mask FROM priced",
)
def mask_nulls(spark, sf_dir):
    return impute.mask_nulls(priced_orders(spark, sf_dir))


@query("drop_masked", f"WITH {PRICED_SQL} SELECT * FROM priced")
def drop_masked(spark, sf_dir):
    return cols.drop_mask_columns(impute.mask_nulls(priced_orders(spark, sf_dir)))


def _filled_sql(value: str) -> str:
    return (
        f"WITH {PRICED_SQL} SELECT o_orderkey, o_custkey, "
        f"{r(f'coalesce(price, {value})')} AS price, priority FROM priced"
    )


@query("null_fill_zero", _filled_sql("0"))
def null_fill_zero(spark, sf_dir):
    return round_columns(impute.fill_zero(priced_orders(spark, sf_dir), ["price"]), ["price"])


@query("null_fill_mean", _filled_sql("(SELECT avg(price) FROM priced)"))
def null_fill_mean(spark, sf_dir):
    return round_columns(impute.fill_mean(priced_orders(spark, sf_dir), ["price"]), ["price"])


@query("null_fill_min", _filled_sql("(SELECT min(price) FROM priced)"))
def null_fill_min(spark, sf_dir):
    return round_columns(impute.fill_min(priced_orders(spark, sf_dir), ["price"]), ["price"])


@query(
    "null_policy",
    f"WITH {PRICED_SQL}, two AS (SELECT *, CASE WHEN o_orderkey % 5 = 0 THEN NULL "
    "ELSE o_custkey END AS customer FROM priced) SELECT o_orderkey, o_custkey, priority, "
    f"{r('coalesce(price, (SELECT avg(price) FROM priced))')} AS price, "
    "coalesce(customer, 0) AS customer FROM two",
)
def null_policy(spark, sf_dir):
    df = priced_orders(spark, sf_dir).withColumn(
        "customer", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey"))
    )
    columns = ColumnTable.of(
        [ColumnSpec("price", null_value=md.MEAN), ColumnSpec("customer", null_value=md.ZERO)]
    )
    out = impute.null_policy(df, columns.null_policy(md.ZERO), columns.null_policy(md.MEAN))
    return round_columns(out, ["price"])


@query(
    "make_numeric",
    """WITH t AS (SELECT event_id, props, regexp_extract(props, '[0-9]+') AS k FROM events)
    SELECT event_id, props, CAST(k AS DOUBLE) AS k,
           CASE WHEN event_id % 5 = 0 THEN NULL
                WHEN event_id % 5 = 1 THEN CAST(k AS DOUBLE) + 0.5
                ELSE CAST(k AS DOUBLE) END AS mixed
    FROM t""",
)
def make_numeric(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    part = F.col("event_id") % 5
    text = table(spark, sf_dir, "events").select(
        "event_id",
        "props",
        k.alias("k"),
        F.when(part == 0, F.concat(F.lit("x"), k))
        .when(part == 1, F.concat(F.lit(" "), k, F.lit(".5 ")))
        .otherwise(k)
        .alias("mixed"),
    )
    kept = cols.to_numeric(text, force=False)  # converts k; props and mixed stay text
    return cols.to_numeric(kept, ["mixed"], force=True)


# --- one-hot --------------------------------------------------------------------

_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_STATUSES = ["F", "O", "P"]


def _hot_sql(column: str, values, source: str | None = None) -> str:
    return ", ".join(
        f"CASE WHEN {source or column} = '{v}' THEN 1 ELSE 0 END AS \"{column}_{v}\"" for v in values
    )


@query(
    "onehot",
    f"WITH {PRICED_SQL} SELECT o_orderkey, {_hot_sql('priority', _PRIORITIES)} FROM priced",
)
def onehot(spark, sf_dir):
    df = priced_orders(spark, sf_dir).select("o_orderkey", "priority")
    return encode.onehot(df, ["priority"])[0]


def _hot_stats_sql(name: str, test: str, source: str) -> str:
    x = f"CASE WHEN {test} THEN 1 ELSE 0 END"
    return (
        f"SELECT '{name}' AS \"column\", {r(f'avg({x})')} AS mean, {r(f'stddev_samp({x})')} AS std, "
        f"CAST(min({x}) AS DOUBLE) AS min, CAST(max({x}) AS DOUBLE) AS max FROM {source}"
    )


@query(
    "onehot_stats",
    " UNION ALL ".join(
        [_hot_stats_sql(f"o_orderpriority_{v}", f"o_orderpriority = '{v}'", "orders")
         for v in _PRIORITIES]
        + [_hot_stats_sql(f"o_orderstatus_{v}", f"o_orderstatus = '{v}'", "orders")
           for v in _STATUSES]
    ),
)
def onehot_stats(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderstatus")
    hot, names = encode.onehot(df, ["o_orderpriority", "o_orderstatus"])
    created = [n for new in names.values() for n in new]
    return round_columns(indicator_stats(hot, created), ["mean", "std"])


@query(
    "onehot_sparse",
    f"""WITH {PRICED_SQL},
    priorities AS (SELECT priority, row_number() OVER (ORDER BY priority) - 1 AS code
                   FROM (SELECT DISTINCT priority FROM priced WHERE priority IS NOT NULL)),
    prices AS (SELECT price, row_number() OVER (ORDER BY price) - 1 + (SELECT count(*) FROM priorities) AS code
               FROM (SELECT DISTINCT price FROM priced WHERE price IS NOT NULL))
    SELECT o_orderkey, concat_ws(',', p.code, v.code) AS hot
    FROM priced LEFT JOIN priorities p USING (priority) LEFT JOIN prices v USING (price)""",
)
def onehot_sparse(spark, sf_dir):
    """One indicator per priority and per price; nearly every order has a price of its own."""
    df = priced_orders(spark, sf_dir).select("o_orderkey", "priority", "price")
    dictionaries, _ = encode.value_dictionaries(df, ["priority", "price"])
    hot = encode.sparse_onehot(df, dictionaries)
    return hot.select("o_orderkey", F.array_join(F.col("hot").cast("array<string>"), ",").alias("hot"))


@query(
    "onehot_sparse_stats",
    f"WITH {PRICED_SQL}, n AS (SELECT count(*) AS n FROM priced), ones AS ("
    "SELECT 'o_custkey' AS \"column\", CAST(o_custkey AS VARCHAR) AS value, count(*) AS k FROM priced "
    "WHERE o_custkey IS NOT NULL GROUP BY 2 UNION ALL "
    "SELECT 'priority', priority, count(*) FROM priced WHERE priority IS NOT NULL GROUP BY 2) "
    f"SELECT \"column\", value, {r('k / n', 9)} AS mean, {r('sqrt(k * (1 - k / n) / (n - 1))', 9)} AS std, "
    "CASE WHEN k = n THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS min, 1.0::DOUBLE AS max FROM ones, n",
)
def onehot_sparse_stats(spark, sf_dir):
    df = priced_orders(spark, sf_dir).select("o_custkey", "priority")
    return round_columns(encode.sparse_stats(df, ["o_custkey", "priority"]), ["mean", "std"], 9)


@query(
    "onehot_range",
    "SELECT l_orderkey, l_partkey, l_suppkey, "
    + ", ".join(
        f"CASE WHEN l_linenumber = {v} THEN 1 ELSE 0 END AS l_linenumber_{v}" for v in range(1, 9)
    )
    + " FROM lineitem",
)
def onehot_range(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"
    )
    spec = ColumnTable.of([ColumnSpec("l_linenumber", operation="onetomany:1:9")])
    return encode.onehot_range(df, spec.declared_ranges())[0]


# --- scaling --------------------------------------------------------------------

_LINE_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def _std_sql(c: str, where: str = "") -> str:
    f = f" FILTER (WHERE {where})" if where else ""
    return f"({c} - (SELECT avg({c}){f} FROM lineitem)) / (SELECT stddev_pop({c}){f} FROM lineitem)"


def _minmax_sql(c: str, where: str = "") -> str:
    f = f" FILTER (WHERE {where})" if where else ""
    low, high = f"(SELECT min({c}){f} FROM lineitem)", f"(SELECT max({c}){f} FROM lineitem)"
    return f"-1 + ({c} - {low}) * 2 / ({high} - {low})"


@query(
    "normalise_std",
    f"SELECT {', '.join(_LINE_KEYS)}, "
    + ", ".join(f"{r(_std_sql(c))} AS {c}" for c in MEASURES) + " FROM lineitem",
)
def normalise_std(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(*_LINE_KEYS, *MEASURES)
    return round_columns(scale.scale_std(df, MEASURES), MEASURES)


@query(
    "normalise_minmax",
    f"SELECT {', '.join(_LINE_KEYS)}, "
    + ", ".join(f"{r(_minmax_sql(c))} AS {c}" for c in MEASURES) + " FROM lineitem",
)
def normalise_minmax(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(*_LINE_KEYS, *MEASURES)
    return round_columns(scale.scale_minmax(df, MEASURES), MEASURES)


_LEARN = "year(l_shipdate) <= 1998"


@query(
    "normalise_learnt",
    f"SELECT {', '.join(_LINE_KEYS)}, {r(_std_sql('l_quantity', _LEARN))} AS l_quantity, "
    f"{r(_minmax_sql('l_extendedprice', _LEARN))} AS l_extendedprice "
    "FROM lineitem WHERE year(l_shipdate) >= 1999",
)
def normalise_learnt(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(*_LINE_KEYS, *MEASURES, "l_shipdate")
    # Bounds on the column itself reach the parquet scan; year(column) would not.
    train = df.where(F.col("l_shipdate") < F.lit("1999-01-01").cast("timestamp_ntz"))
    valid = df.where(F.col("l_shipdate") >= F.lit("1999-01-01").cast("timestamp_ntz"))
    learnt = scale.learn(train, ["l_quantity", "l_extendedprice"])
    out = scale.scale_std(valid, ["l_quantity"], learnt)
    out = scale.scale_minmax(out, ["l_extendedprice"], learnt)
    return round_columns(
        out.select(*_LINE_KEYS, "l_quantity", "l_extendedprice"),
        ["l_quantity", "l_extendedprice"],
    )


def _supplier_stats_sql(where: str) -> str:
    return " UNION ALL ".join(
        f"SELECT l_suppkey, '{c}' AS \"column\", count({c}) AS n, avg({c}) AS mean, "
        f"stddev_pop({c}) AS std, min({c}) AS min, max({c}) AS max "
        f"FROM lineitem WHERE {where} GROUP BY 1"
        for c in ("l_quantity", "l_extendedprice")
    )


@query(
    "stats_upsert",
    f"WITH stored AS ({_supplier_stats_sql(_LEARN)}), "
    f"fresh AS ({_supplier_stats_sql('year(l_shipdate) >= 1999')}) "
    "SELECT l_suppkey, \"column\", coalesce(fresh.n, stored.n) AS n, "
    + ", ".join(
        f"{r(f'coalesce(fresh.{s}, stored.{s})', 8 if s == 'mean' else 6)} AS {s}"
        for s in ("mean", "std", "min", "max")
    )
    + " FROM stored FULL OUTER JOIN fresh USING (l_suppkey, \"column\")",
)
def stats_upsert(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    measured = ["l_quantity", "l_extendedprice"]
    day = F.col("l_shipdate")

    def before(text):
        return day < F.lit(text).cast("timestamp_ntz")

    def stats(part):
        return scale.long_stats(scale.group_stats(part, measured, ["l_suppkey"]), measured).drop(
            "std_samp"
        )

    stored = stats(df.where(before("1999-01-01")))
    fresh = stats(df.where(~before("1999-01-01")))
    out = scale.upsert_stats(stored, fresh, ["l_suppkey", "column"])
    # A mean of cents over 32 rows and the like lies half way between two 6-digit values.
    return round_columns(round_columns(out, ["mean"], 8), ["std", "min", "max"])


@query("stats_merged", " UNION ALL ".join(
    f"SELECT l_suppkey, '{c}' AS \"column\", count({c}) AS n, {r(f'avg({c})', 8)} AS mean, "
    f"{r(f'stddev_pop({c})')} AS std, {r(f'stddev_samp({c})')} AS std_samp, min({c}) AS min, max({c}) AS max "
    "FROM lineitem GROUP BY 1"
    for c in ("l_quantity", "l_extendedprice")
))
def stats_merged(spark, sf_dir):
    """Statistics taken in two steps, a part per year of shipment, equal those of all rows."""
    df = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    store = MomentStore(fresh_path(spark, "moments"), ["l_suppkey"], ["l_quantity", "l_extendedprice"])
    early = F.col("l_shipdate") < F.lit("1999-01-01").cast("timestamp_ntz")
    store.add(df.where(early), F.year("l_shipdate"))
    store.add(df.where(~early | F.col("l_shipdate").isNull()), F.year("l_shipdate"))
    return round_columns(round_columns(store.read(spark), ["mean"], 8), ["std", "std_samp"])


# --- splits by value, dates, round trip -----------------------------------------

_SUPPLIER_SQL = "CASE WHEN l_orderkey % 17 = 0 THEN NULL ELSE l_suppkey END"


def _listed_suppliers(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.when(F.col("l_orderkey") % 17 != 0, F.col("l_suppkey")).alias("supplier"),
    )
    listed = table(spark, sf_dir, "supplier").where("s_acctbal < 1000").select("s_suppkey")
    return rows.split_by_values(df, "supplier", listed)


@query(
    "split_in",
    f"SELECT * FROM (SELECT l_orderkey, l_linenumber, l_partkey, {_SUPPLIER_SQL} AS supplier "
    "FROM lineitem) WHERE supplier IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 1000)",
)
def split_in(spark, sf_dir):
    return _listed_suppliers(spark, sf_dir)[0]


@query(
    "split_not_in",
    f"SELECT * FROM (SELECT l_orderkey, l_linenumber, l_partkey, {_SUPPLIER_SQL} AS supplier "
    "FROM lineitem) WHERE supplier IS NULL OR supplier NOT IN "
    "(SELECT s_suppkey FROM supplier WHERE s_acctbal < 1000)",
)
def split_not_in(spark, sf_dir):
    return _listed_suppliers(spark, sf_dir)[1]


@query(
    "excel_dates",
    f"""SELECT o_orderkey, {EXCEL_DAY_SQL.format(d='CAST(o_orderdate AS DATE)')} AS excel_day,
       CAST(o_orderdate AS DATE) AS d, strftime(o_orderdate, '%d %b %y') AS shown,
       CAST(date_trunc('year', o_orderdate) AS DATE) AS year_start FROM orders""",
)
def excel_dates(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    number = to_excel_day("o_orderdate")
    text = F.date_format("o_orderdate", "dd.MM.yyyy")
    back = orders.select("o_orderkey", number.alias("excel_day"), parse_day(text).alias("parsed"))
    return back.select(
        "o_orderkey",
        "excel_day",
        from_excel_day("excel_day").alias("d"),
        display_day("parsed").alias("shown"),
        first_of_year("parsed").alias("year_start"),
    )


@query(
    "scan_roundtrip",
    "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority "
    "FROM orders",
)
def scan_roundtrip(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    late = F.coalesce(F.col("o_orderdate") >= F.lit("1999-01-01").cast("timestamp_ntz"), F.lit(False))
    parts = []
    for name, part in (("early", orders.where(~late)), ("late", orders.where(late))):
        path = fresh_path(spark, f"csv-{name}")
        write_csv(part, path)
        parts.append(read_csv(spark, path, schema=orders.schema))
    return parts[0].unionByName(parts[1], allowMissingColumns=True)


# --- selection by the column table ----------------------------------------------

COLUMN_TABLE = ColumnTable.of(
    [
        ColumnSpec("entity", operation=md.BATCH, sort="asc10"),
        ColumnSpec("d", operation=md.DATE, sort="asc2"),
        ColumnSpec("y", operation=md.TARGET, normalisation=md.STD),
        ColumnSpec("y_mask", operation=md.TARGET_MASK),
        ColumnSpec("excel_day", operation=md.REMOVE),
        ColumnSpec("revenue", 0, normalisation=md.STD, null_value=md.MEAN, mean=0.0),
        ColumnSpec("x_c_m", 365, normalisation=md.MINMAX),
        ColumnSpec("x_c_wd", 365, operation=md.ONE_TO_MANY, sort="ASC1"),
        ColumnSpec("x_w_11_6003_l0", 1, null_value=md.ZERO),
        ColumnSpec("x_w_12_6003_l0", 7),
        ColumnSpec("x_v_summer", 365),
        ColumnSpec("x_ho_first", 365),
        ColumnSpec("y_l7", 7),
    ]
)
_WIDE_SQL = f"""WITH {PANEL_SQL}, wide AS (
  SELECT entity, d, y, y_mask, excel_day, {r('revenue', 2)} AS revenue,
         CAST(month(d) AS INTEGER) AS x_c_m, CAST(dayofweek(d) + 1 AS INTEGER) AS x_c_wd,
         y * 2 AS x_w_11_6003_l0, y + 1 AS x_w_12_6003_l0,
         CASE WHEN month(d) IN (7, 8) THEN 1 ELSE 0 END AS x_v_summer,
         CASE WHEN day(d) = 1 THEN 1 ELSE 0 END AS x_ho_first,
         lag(y, 7) OVER (PARTITION BY entity ORDER BY d) AS y_l7
  FROM panel)"""


def wide_panel(spark, sf_dir):
    df = with_mask(panel(spark, sf_dir))
    df = df.select(
        "entity", "d", "y", "y_mask", "excel_day",
        rounded(F.col("revenue"), 2).alias("revenue"),
        F.month("d").alias("x_c_m"),
        F.dayofweek("d").alias("x_c_wd"),
        (F.col("y") * 2).alias("x_w_11_6003_l0"),
        (F.col("y") + 1).alias("x_w_12_6003_l0"),
        F.month("d").isin(7, 8).cast("int").alias("x_v_summer"),
        (F.dayofmonth("d") == 1).cast("int").alias("x_ho_first"),
    )
    return lag_rows(df, ["y"], [7], ["d"], ["entity"], chunk_rows=None)


def _select_sql(names) -> str:
    return f"{_WIDE_SQL} SELECT {', '.join(names)} FROM wide"


_WIDE = [
    "entity", "d", "y", "y_mask", "excel_day", "revenue", "x_c_m", "x_c_wd", "x_w_11_6003_l0",
    "x_w_12_6003_l0", "x_v_summer", "x_ho_first", "y_l7",
]


@query("remove_columns", _select_sql([c for c in _WIDE if c != "excel_day"]))
def remove_columns(spark, sf_dir):
    return cols.remove_columns(
        wide_panel(spark, sf_dir), [*COLUMN_TABLE.with_operation(md.REMOVE), "not_there"]
    )


@query("reorder_columns", _select_sql(_WIDE))
def reorder_columns(spark, sf_dir):
    return cols.reorder_columns(
        wide_panel(spark, sf_dir),
        targets=COLUMN_TABLE.targets(),
        batch=COLUMN_TABLE.with_operation(md.BATCH),
        date=[COLUMN_TABLE.date_column()],
        target_masks=COLUMN_TABLE.with_operation(md.TARGET_MASK),
    )


@query(
    "select_features",
    _select_sql(
        ["entity", "d", "y", "revenue", "x_c_m", "x_c_wd", "x_w_11_6003_l0", "x_w_12_6003_l0",
         "x_v_summer", "x_ho_first", "y_l7"]
    ),
)
def select_features(spark, sf_dir):
    return wide_panel(spark, sf_dir).select(
        "entity", "d", *COLUMN_TABLE.targets(), *COLUMN_TABLE.features()
    )


@query(
    "sort_columns",
    f"{_WIDE_SQL} SELECT entity, d, x_c_wd, row_number() OVER (ORDER BY x_c_wd, d, entity) AS place "
    "FROM wide",
)
def sort_columns(spark, sf_dir):
    df = wide_panel(spark, sf_dir).select("entity", "d", "x_c_wd")
    keys = [c for c in COLUMN_TABLE.sort_columns() if c in df.columns]
    # The place in the sorted table shows the order; a file writer sorts the same way.
    return dense_index(df, keys, name="place").withColumn("place", F.col("place") + 1)


@query(
    "forecast_known_features",
    _select_sql(
        ["entity", "d", "x_c_m", "x_c_wd", "x_w_12_6003_l0", "x_v_summer", "x_ho_first", "y_l7"]
    ),
)
def forecast_known_features(spark, sf_dir):
    return wide_panel(spark, sf_dir).select("entity", "d", *COLUMN_TABLE.known_ahead(7))


@query(
    "feature_groups",
    _select_sql(
        ["entity", "d", "x_c_m", "x_c_wd", "x_w_11_6003_l0", "x_v_summer", "x_ho_first", "y_l7"]
    ),
)
def feature_groups(spark, sf_dir):
    chosen = names_in_groups(
        COLUMN_TABLE.features(), ["calendar", "basic_weather", "vacation", "holiday", "lagged"],
        explicit=["x_c_m"],
    )
    return wide_panel(spark, sf_dir).select("entity", "d", *chosen)


_HEADERS = [
    {"Column Header": name, "Public": public, "Pseudonymisation": "Column Header, Public",
     "Pseudonymisation_Header_Operation": operation}
    for name, public, operation in (
        ("entity", "Series", None),
        ("d", "Day", None),
        ("y", "Count", "replace,visits"),
        ("x_w_11_6003_l0", "Weather", headers.POSTCODE_INDEXING),
        ("x_v_summer", "Vacation", "replace, x_v_a"),
    )
]


@query(
    "rename_columns",
    f"{_WIDE_SQL} SELECT entity, d, y AS visits, x_w_11_6003_l0 AS x_w_11_Place0_l0, "
    "x_v_summer AS x_v_a FROM wide",
)
def rename_columns(spark, sf_dir):
    public = headers.pseudonymise(headers.read_headers(_HEADERS), salt="s")
    df = wide_panel(spark, sf_dir).select(*[row["Column Header"] for row in _HEADERS])
    return cols.rename_columns(df, headers.rename_map(public))


# --- text -----------------------------------------------------------------------

_SALT = "pepper"


@query(
    "pseudonymise_values",
    f"""WITH parts AS (
      SELECT doc_id, text, regexp_extract_all(text, '[0-9]{{4}}') AS codes,
             string_split_regex(text, '[0-9]{{4}}') AS between FROM documents),
    places AS (
      SELECT code, row_number() OVER (ORDER BY sha256(code || '{_SALT}')) - 1 AS idx
      FROM (SELECT DISTINCT unnest(codes) AS code FROM parts)),
    pieces AS (
      SELECT doc_id, i, between[i] || coalesce('Place' || idx, '') AS piece
      FROM (SELECT doc_id, between, codes, unnest(range(1, len(between) + 1)) AS i
            FROM parts WHERE len(codes) > 0) LEFT JOIN places ON code = codes[i])
    SELECT parts.doc_id, CAST(len(codes) AS INTEGER) AS n_codes,
           coalesce(new_text, text) AS text
    FROM parts LEFT JOIN
      (SELECT doc_id, string_agg(piece, '' ORDER BY i) AS new_text FROM pieces GROUP BY 1) n
      ON parts.doc_id = n.doc_id""",
)
def pseudonymise_values(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.size(F.regexp_extract_all("text", F.lit(pseudonymise.CODE), F.lit(0))).alias("n_codes"),
        "text",
    )
    return pseudonymise.pseudonymise_values(df, "text", _SALT)


@query(
    "pseudonymise_names",
    f"""WITH codes AS (
      SELECT code, row_number() OVER (ORDER BY sha256(code || '{_SALT}')) - 1 AS idx
      FROM (SELECT DISTINCT unnest(regexp_extract_all(c_name, '[0-9]{{4}}')) AS code FROM customer))
    SELECT c_custkey, 'Customer#Place' || a.idx || 'Place' || b.idx || substr(c_name, 18) AS c_name
    FROM customer JOIN codes a ON a.code = substr(c_name, 10, 4)
                  JOIN codes b ON b.code = substr(c_name, 14, 4)""",
)
def pseudonymise_names(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return pseudonymise.pseudonymise_values(df, "c_name", _SALT)
