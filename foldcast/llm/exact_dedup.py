"""Exact duplicates by a tree merge of sorted digest runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldcast.llm.common import free_names, text_digest, whole
from foldcast.session import materialise

#: Runs that one merge of the tree takes in, as a power of two.
FAN_IN_BITS = 4


def digest_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One stored row per document, without its text: key, row number, the partition
    (``node``) it was found in, and three values that identify the text: its SHA-256, its
    length in bytes and a second, unrelated hash."""
    return materialise(
        docs.select(
            F.col(key).alias("key"),
            F.monotonically_increasing_id().alias("row"),
            F.spark_partition_id().alias("node"),
            text_digest(F.col(text)).alias("digest"),
            F.octet_length(whole(F.col(text))).cast("long").alias("n_bytes"),
            F.xxhash64(whole(F.col(text))).alias("check"),
        ),
        "digests",
    )


def merge_runs(rows: DataFrame, keep: str = "largest", fan_in_bits: int = FAN_IN_BITS) -> DataFrame:
    """Groups of equal texts: (digest, n_bytes, check, keep_key, keep_row, copies).

    A node starts with the sorted run of its own digests. In round ``r`` the nodes whose
    numbers agree without their lowest ``r * fan_in_bits`` bits exchange their runs: digests
    are dealt among them by hash, and each merges the sorted runs it receives, so that a
    group of copies shrinks to one row per exchanging set and round. After the last
    round all nodes belong to one set. A digest counts as verified when length and
    second hash agree as well; they are part of the key at every level.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError("keep is 'largest' or 'smallest'")
    best = F.max if keep == "largest" else F.min
    last = rows.agg(F.max("node")).first()[0] or 0
    rounds = max(1, -(-int(last).bit_length() // fan_in_bits))
    runs = rows.select(
        "node", "digest", "n_bytes", "check",
        F.struct("key", "row").alias("best"), F.lit(1).cast("long").alias("copies"),
    )
    for _ in range(rounds):
        runs = (
            runs.withColumn("node", F.shiftright("node", fan_in_bits))
            .groupBy("node", "digest", "n_bytes", "check")
            .agg(best("best").alias("best"), F.sum("copies").alias("copies"))
        )
    return runs.select(
        "digest", "n_bytes", "check",
        F.col("best.key").alias("keep_key"), F.col("best.row").alias("keep_row"), "copies",
    )


def exact_dedup(
    docs: DataFrame, key: str = "doc_id", text: str = "text", keep: str = "largest"
) -> DataFrame:
    """One row per document: (key, digest, keep_key, copies, kept).

    Of equal texts the row with the largest (or smallest) key is kept. Null texts equal the
    empty text. A null key counts as smaller than any other. Of rows that repeat both key
    and text exactly one is kept. Only these columns are read, so others may have any name;
    an empty table gives an empty result.
    """
    rows = digest_rows(docs, key, text)
    groups = merge_runs(rows, keep)
    return rows.join(groups, ["digest", "n_bytes", "check"]).select(
        "key", "digest", "keep_key", "copies", (F.col("row") == F.col("keep_row")).alias("kept")
    )


def drop_copies(
    docs: DataFrame, key: str = "doc_id", text: str = "text", keep: str = "largest"
) -> DataFrame:
    """``docs`` without the copies, with all of its columns. Of rows that repeat both key and
    text any one stays."""
    mark, its_key = free_names(docs, "text_mark", "kept_key")
    members = exact_dedup(docs, key, text, keep)
    kept = members.where("kept").select(
        F.col("key").alias(its_key), F.col("digest").alias("kept_digest")
    )
    tagged = docs.withColumn(mark, text_digest(F.col(text)))
    left = tagged.join(
        kept,
        (tagged[mark] == kept["kept_digest"]) & tagged[key].eqNullSafe(kept[its_key]),
        "left_semi",
    )
    twice = members.where("key <=> keep_key AND NOT kept")
    return (left if twice.isEmpty() else left.dropDuplicates([mark])).drop(mark)
