"""A corpus from raw documents to token counts: toxic documents go, then exact copies, then near
copies; sources are mixed to their weights, and what is left is encoded.

Each stage takes the documents its predecessor kept, which are written and read again in between.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foldcast.llm import bpe, exact_dedup, jaccard_join, mixing, toxicity
from foldcast.session import materialise

#: Near copies: similarity in percent of sets of this many words.
NEAR_PERCENT, NEAR_WORDS = 80, 5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text scores below the threshold of the toxicity operator. Learnt from
    the labels of the same folder and the texts of ``docs``, without the held out third."""
    model = toxicity.fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are linked by similarity the one with the smallest id."""
    return jaccard_join.drop_near_copies(docs, n=NEAR_WORDS, percent=NEAR_PERCENT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them: some not at all, some in part, some twice."""
    mixed = mixing.mixed_documents(docs)
    if "n_chars" in mixed.columns:
        from pyspark.sql import functions as F

        mixed = mixed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return mixed


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every text."""
    return bpe.encoding_digests(docs).withColumnRenamed("key", "doc_id")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("drop_toxic", drop_toxic),
    ("drop_copies", drop_copies),
    ("drop_near_copies", drop_near_copies),
    ("mix_sources", mix_sources),
    ("encode", encode),
]

#: The mix and the encoding cannot be written in SQL; a test holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
