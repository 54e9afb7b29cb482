"""The registry, the derived inputs, and the same inputs as SQL."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldcast.functions.dates import to_excel_day
from foldcast.operators.columns import quoted
from foldcast.operators.series import daily_series

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query, with the SQL that must give the same rows."""

    def register(function):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(value: Column, digits: int = 6) -> Column:
    """Rounded half to even, and never a negative zero, so that engines agree on the
    bits. ``round`` would go through a decimal for every value."""
    scale = F.lit(10.0**digits)
    return F.rint(value * scale) / scale + F.lit(0.0)


def round_columns(df: DataFrame, names, digits: int = 6) -> DataFrame:
    return df.select(
        *[rounded(quoted(c), digits).alias(c) if c in names else quoted(c) for c in df.columns]
    )


# --- derived inputs -------------------------------------------------------------

LAGS = (1, 7, 364, 365)
FOLD_YEARS = (3, 4, 5, 6)  # the last one validates on the seventh year, the last of the orders
MASK_EVERY = 13
NULL_EVERY = 17


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order day: (d, y, revenue, excel_day, y_mask)."""
    orders = table(spark, sf_dir, "orders")
    days = daily_series(
        orders,
        F.to_date("o_orderdate"),
        {"y": F.count(F.lit(1)).cast("bigint"), "revenue": F.sum("o_totalprice")},
    )
    return with_mask(days)


def segment_days(
    spark: SparkSession, sf_dir: str, entity: str = "c_mktsegment"
) -> DataFrame:
    """(entity, d, n, revenue): orders with the segment of their customer.

    Orders are first summed per customer and day, which shrinks a customer with
    very many orders to a row per day before the join moves it.
    """
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer").select("c_custkey", entity)
    per_customer = daily_series(
        orders,
        F.to_date("o_orderdate"),
        {"n": F.count(F.lit(1)), "revenue": F.sum("o_totalprice")},
        [F.col("o_custkey").alias("c_custkey")],
    )
    return per_customer.join(customers, "c_custkey").select(
        F.col(entity).alias("entity"), "d", "n", "revenue"
    )


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per market segment and order day: (entity, d, y, revenue)."""
    return daily_series(
        segment_days(spark, sf_dir),
        F.col("d"),
        {"y": F.sum("n").cast("bigint"), "revenue": F.sum("revenue")},
        ["entity"],
    )


def with_mask(df: DataFrame) -> DataFrame:
    day = to_excel_day("d")
    return df.withColumns(
        {"excel_day": day, "y_mask": (day % MASK_EVERY == 0).cast("int")}
    )


def priced_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with nulls put into the price and the priority."""
    injected = F.col("o_orderkey") % NULL_EVERY == 0
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        "o_custkey",
        F.when(~injected, F.col("o_totalprice")).alias("price"),
        F.when(F.col("o_orderkey") % 19 != 0, F.col("o_orderpriority")).alias("priority"),
    )


# --- the same as SQL ------------------------------------------------------------

EXCEL_DAY_SQL = "CAST(date_diff('day', DATE '1899-12-30', {d}) AS INTEGER)"
DAILY_SQL = f"""daily AS (
  SELECT d, y, revenue, {EXCEL_DAY_SQL.format(d='d')} AS excel_day,
         CASE WHEN {EXCEL_DAY_SQL.format(d='d')} % {MASK_EVERY} = 0 THEN 1 ELSE 0 END AS y_mask
  FROM (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS y, sum(o_totalprice) AS revenue
        FROM orders GROUP BY 1))"""
PANEL_SQL = f"""panel AS (
  SELECT entity, d, y, revenue, {EXCEL_DAY_SQL.format(d='d')} AS excel_day,
         CASE WHEN {EXCEL_DAY_SQL.format(d='d')} % {MASK_EVERY} = 0 THEN 1 ELSE 0 END AS y_mask
  FROM (SELECT c_mktsegment AS entity, CAST(o_orderdate AS DATE) AS d,
               CAST(count(*) AS BIGINT) AS y, sum(o_totalprice) AS revenue
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2))"""
PRICED_SQL = f"""priced AS (
  SELECT o_orderkey, o_custkey,
         CASE WHEN o_orderkey % {NULL_EVERY} = 0 THEN NULL ELSE o_totalprice END AS price,
         CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE o_orderpriority END AS priority
  FROM orders)"""
# (fold, split, year) for the order years
FOLDS_SQL = f"""years AS (
  SELECT year, row_number() OVER (ORDER BY year) AS k
  FROM (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS year FROM orders)),
folds AS (
  SELECT fold, CASE WHEN k <= fold THEN 'train' ELSE 'valid' END AS split, year
  FROM years, (VALUES {', '.join(f'({n})' for n in FOLD_YEARS)}) f(fold) WHERE k <= fold + 1)"""


def r(sql: str, digits: int = 6) -> str:
    scale = f"1e{digits}"
    return f"(round_even(({sql}) * {scale}, 0) / {scale} + 0.0)"


def metric_sql(
    y: str = "y", p: str = "p", offsets: Mapping[str, float] | None = None, pll: bool = False
) -> dict[str, str]:
    """Score name to SQL aggregate."""
    offsets = offsets or {}

    def at(name: str) -> str:
        return f"({p} + {offsets[name]})" if name in offsets else p

    def paired(name):
        return f"CASE WHEN {at(name)} IS NOT NULL THEN {y} END"

    out = {
        "RMSE": f"sqrt(avg(({y} - {at('RMSE')}) * ({y} - {at('RMSE')})))",
        "PRMS": f"sqrt(avg(({y} - {at('PRMS')}) * ({y} - {at('PRMS')}) / ({y} + 1.0::DOUBLE)))",
        "RdMAPE": f"avg(abs(({y} - {at('RdMAPE')}) / ({y} + 1.0::DOUBLE)))",
        "PdMAPE": f"avg(abs(({y} - {at('PdMAPE')}) / greatest({y}, 1.0::DOUBLE)))",
        "R2": (
            f"1 - sum(({y} - {at('R2')}) * ({y} - {at('R2')})) / "
            f"(var_pop({paired('R2')}) * count({paired('R2')}) + 1e-7)"
        ),
    }
    if pll:
        out["PLL"] = f"avg({y} * ln({at('PLL')}) - {at('PLL')} - lgamma({y} + 1.0::DOUBLE))"
    return out


def scores_sql(**options) -> str:
    """Rounded select list of all scores and the number of rows counted."""
    p = options.get("p", "p")
    y = options.get("y", "y")
    listed = [f"{r(sql)} AS \"{name}\"" for name, sql in metric_sql(**options).items()]
    return f"count(CASE WHEN {p} IS NOT NULL THEN {y} END) AS n, " + ", ".join(listed)


def ols_sql(source: str, features, y: str, out: str, by: str = "fold") -> str:
    """CTEs that end in ``out``: the rows of ``source`` with the least squares
    prediction ``p``, fitted per group on its training rows. Each feature is made
    orthogonal to the ones before it, so that only simple regressions are needed."""
    parts, rows = [], source
    for i, feature in enumerate(features):
        done = [f"e{j}" for j in range(i)]
        slopes = "".join(
            f", CASE WHEN var_pop({e}) > 1e-12 THEN regr_slope({feature}, {e}) ELSE 0 END AS s{j}"
            for j, e in enumerate(done)
        )
        minus = "".join(f" - s{j} * {e}" for j, e in enumerate(done))
        parts.append(
            f"{out}_f{i} AS MATERIALIZED (SELECT {by}, avg({feature}) AS m{slopes} FROM {rows} "
            f"WHERE split = 'train' GROUP BY 1)"
        )
        parts.append(
            f"{out}_r{i} AS MATERIALIZED (SELECT {rows}.*, {feature} - m{minus} AS e{i} "
            f"FROM {rows} JOIN {out}_f{i} USING ({by}))"
        )
        rows = f"{out}_r{i}"
    slopes = "".join(
        f", CASE WHEN var_pop(e{j}) > 1e-12 THEN regr_slope({y}, e{j}) ELSE 0 END AS c{j}"
        for j in range(len(features))
    )
    terms = "".join(f" + c{j} * e{j}" for j in range(len(features)))
    parts.append(
        f"{out}_fit AS MATERIALIZED (SELECT {by}, avg({y}) AS m{slopes} FROM {rows} "
        "WHERE split = 'train' GROUP BY 1)"
    )
    parts.append(
        f"{out} AS MATERIALIZED (SELECT {rows}.*, m{terms} AS p FROM {rows} "
        f"JOIN {out}_fit USING ({by}))"
    )
    return ", ".join(parts)
