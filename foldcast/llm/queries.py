"""One query per operator, with production parameters over the whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldcast.llm import (
    bpe,
    exact_dedup,
    hard_negatives,
    id_planes,
    jaccard_join,
    language,
    line_dedup,
    mixing,
    packing,
    periodic_runs,
    token_counts,
    toxicity,
    vector_dedup,
)
from foldcast.session import fresh_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, oracle: str | None = None):
    def register(function):
        QUERIES[name] = function
        if oracle:
            ORACLES[name] = oracle
        return function

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query(
    "op1_line_dedup",
    r"""
    WITH raw AS (
      SELECT doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
             generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
      FROM documents
    ), written AS (
      SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i, count(*) OVER (PARTITION BY doc_id) AS n
      FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
    ), windows AS (
      SELECT doc_id, i, least(n, 2) AS width,
             line || CASE WHEN n > 1 THEN chr(10) || lead(line) OVER (PARTITION BY doc_id ORDER BY i) ELSE '' END AS content
      FROM written
      UNION ALL
      SELECT doc_id, i, 1, line FROM written
      WHERE n > 1 AND len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= 10
    ), later AS (
      SELECT doc_id, i, width, row_number() OVER (PARTITION BY content ORDER BY doc_id, i) AS nth
      FROM windows WHERE content IS NOT NULL
    ), gone AS (
      SELECT DISTINCT doc_id, i + k AS i FROM later, (VALUES (0), (1)) v(k) WHERE nth > 1 AND k < width
    ), kept AS (
      SELECT r.doc_id, string_agg(r.line, chr(10) ORDER BY r.pos) AS clean
      FROM raw r LEFT JOIN (SELECT w.doc_id, w.pos FROM written w JOIN gone USING (doc_id, i)) g
        ON r.doc_id = g.doc_id AND r.pos = g.pos
      WHERE g.pos IS NULL GROUP BY r.doc_id
    )
    SELECT d.doc_id, CAST(coalesce(w.n, 0) AS INTEGER) AS n_lines, CAST(coalesce(g.n, 0) AS INTEGER) AS n_removed,
           sha256(coalesce(k.clean, '')) AS clean_sha256
    FROM documents d
    LEFT JOIN (SELECT doc_id, count(*) AS n FROM written GROUP BY doc_id) w USING (doc_id)
    LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g USING (doc_id)
    LEFT JOIN kept k USING (doc_id)
    """,
)
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that lie in runs of two or more lines, or lines of ten or more words, seen before go;
    digest of what stays."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.line_dedup(docs).select(
        "doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("clean_text", F.lit("")), 256).alias("clean_sha256")
    )


@_query("op3_mix_sources")
def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix_sources(docs).select(
        F.col("key").alias("doc_id"), "size", "source_size", "target", "taken", "first_shard"
    )


@_query("op4_token_counts")
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram of token counts and the totals at every length that occurs."""
    return token_counts.context_totals(token_counts.length_histogram(_table(spark, sf_dir, "documents")))


@_query("op7_id_planes")
def op7_id_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "ids")
    id_planes.write_ids(_table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return id_planes.document_digests(spark, path)


@_query(
    "op8_exact_dedup",
    """
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
)
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup.exact_dedup(docs).select(
        F.col("key").alias("doc_id"), F.col("keep_key").alias("keep_id"),
        F.col("copies").alias("group_size"), "kept", F.lower(F.hex("digest")).alias("text_sha256"),
    )


@_query("op10_bpe")
def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encoding_digests(docs).withColumnRenamed("key", "doc_id")


@_query("op2_toxicity")
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit_toxicity(docs, _table(spark, sf_dir, "labels"))
    return toxicity.toxic_passages(docs, model).select(
        F.col("key").alias("doc_id"), "held_out", "score", "predicted", F.size("passages").alias("n_passages")
    )


@_query("op6_language")
def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit_languages(docs)
    return language.identify_languages(docs, model).select(
        F.col("key").alias("doc_id"), "held_out", "lang_pred", "score", F.size("spans").alias("n_spans")
    )


@_query("op9_jaccard_join")
def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_join.jaccard_join(docs).select(
        F.col("key").alias("doc_id"), "n_shingles", F.col("component").alias("component_id")
    )


@_query("op5_vector_dedup")
def op5_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return vector_dedup.vector_dedup(vectors).select(
        F.col("key").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept", "recall"
    )


@_query("op11_best_fit_packing")
def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack_documents(docs).select(
        F.col("key").alias("doc_id"), "piece", "start", "length", F.col("crc").alias("ids_crc32"), "sequence_id", "offset"
    )


@_query("op12_periodic_runs")
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic_runs.with_planted_repeats(_table(spark, sf_dir, "documents"))
    found = periodic_runs.periodic_runs(docs, key="key")
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    # of exact length / period: a/b > c/d where a*d > c*b
    best = F.reduce(
        "runs", F.element_at("runs", 1),
        lambda x, r: F.when(r["length"] * x["period"] > x["length"] * r["period"], r).otherwise(x),
    )
    best = F.when(F.size("runs") > 0, best)
    return found.select("key", "runs", "collapsed", lines.alias("lines"), best.alias("best")).select(
        F.col("key").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"),
        F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("1000 * best.length DIV best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("lines", lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@_query(
    "op13_hard_negatives",
    """
    WITH good AS (
      SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
      FROM embeddings
      WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), scored AS (
      SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same,
             CAST(list_dot_product(CAST(a.v AS DOUBLE[]), CAST(r.v AS DOUBLE[])) AS BIGINT) AS score
      FROM good a JOIN good r ON a.vec_id <> r.vec_id WHERE a.vec_id % 50 = 0
    ), positives AS (
      SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
    )
    SELECT anchor_id, positive_id,
           CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
           vec_id AS negative_id, positive_score, score AS negative_score
    FROM positives JOIN scored USING (anchor_id)
    WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
    QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 3
    """,
)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors whose id is a multiple of 50 are the anchors; of ids that are multiples of 7 the label is shifted."""
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(_table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, label=shifted)
