"""The events table read as a stream and processed until nothing is left."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldcast.catalogue.common import query, r, round_columns, scores_sql, table
from foldcast.functions.metrics import SCORES
from foldcast.operators.scale import learn
from foldcast.streaming.lags import run_row_lags
from foldcast.streaming.scoring import learnt_features, run_available, windowed_scores

_NO_PLL = {k: v for k, v in SCORES.items() if k != "PLL"}


def event_stream(spark, sf_dir):
    """The pattern takes the table as one file or as a folder of files."""
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")


@query(
    "stream_metrics",
    f"""WITH e AS (SELECT date_trunc('day', ts) AS day, event_type, value AS y,
                  CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) / 5 AS p FROM events)
    SELECT strftime(day, '%Y-%m-%d') AS day, event_type, {scores_sql()}
    FROM e WHERE day < (SELECT max(day) FROM e) GROUP BY 1, 2""",
)
def stream_metrics(spark, sf_dir):
    """The last day stays open, so it is not in the output."""
    p = F.get_json_object("props", "$.k").cast("double") / 5
    scored = windowed_scores(
        event_stream(spark, sf_dir), "ts", F.col("value"), p, ["event_type"], metrics=_NO_PLL
    )
    out = run_available(scored, "stream_metrics")
    out = out.withColumn("day", F.date_format("window_start", "yyyy-MM-dd")).drop("window_start")
    return round_columns(out, list(_NO_PLL))


@query(
    "stream_normalise",
    f"""WITH e AS (SELECT event_id, value, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) % 6 AS k
                  FROM events)
    SELECT event_id, {r('(value - (SELECT avg(value) FROM e)) / (SELECT stddev_pop(value) FROM e)')}
             AS value, {', '.join(f'CASE WHEN k = {v} THEN 1 ELSE 0 END AS k_{v}' for v in range(5))}
    FROM e""",
)
def stream_normalise(spark, sf_dir):
    learnt = learn(table(spark, sf_dir, "events"), ["value"])
    stream = event_stream(spark, sf_dir).select(
        "event_id", "value",
        (F.get_json_object("props", "$.k").cast("int") % 6).alias("k"),
    )
    scaled = learnt_features(stream, std=learnt, ranges={"k": (0, 5)})
    return round_columns(run_available(scaled, "stream_normalise"), ["value"])


@query(
    "stream_lag",
    """SELECT event_id, user_id, value,
         lag(value, 1) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS value_l1,
         lag(value, 3) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS value_l3
    FROM events""",
)
def stream_lag(spark, sf_dir):
    stream = event_stream(spark, sf_dir).select("event_id", "user_id", "ts", "value")
    return run_row_lags(stream, ["value"], [1, 3], ["ts", "event_id"], ["user_id"]).drop("ts")
