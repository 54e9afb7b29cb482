"""Token counts: the exact histogram of encoded lengths, and what its suffix sums answer."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldcast.llm.common import whole
from foldcast.llm.encoding import byte_level_coder, in_slices
from foldcast.session import materialise

#: Lengths of one running sum; longer histograms are summed in pieces of this many lengths.
PIECE = 1024


def length_histogram(docs: DataFrame, text: str = "text", tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """(n_tokens, n_docs): how many documents have each encoded length. Null texts count as empty
    ones, with 0 tokens; an empty table gives no rows. Only the text column is read."""

    def counted(batches):
        for batch in batches:
            texts = batch.column(0).to_pylist()
            sizes = [
                np.diff(byte_level_coder(tokenizer).rows(some)[1]) for _, some in in_slices(texts)
            ]
            if sizes:
                found, times = np.unique(np.concatenate(sizes), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found, pa.int64()), pa.array(times, pa.int64())], ["n_tokens", "n_docs"]
                )

    return (
        docs.select(whole(F.col(text)).alias("text"))
        .mapInArrow(counted, "n_tokens long, n_docs long")
        .groupBy("n_tokens")
        .agg(F.sum("n_docs").alias("n_docs"))
    )


def context_totals(histogram: DataFrame) -> DataFrame:
    """One row per length L that occurs: n_tokens (L), n_docs, and from suffix and prefix sums
    docs_le and share_le (documents of L tokens at most, so every quantile), docs_gt,
    tokens_le, tokens_gt, total_tokens, and truncated_total: the tokens left if all
    documents are cut to L. For a limit between two lengths L < c < L', the truncated
    total is tokens_le + c * docs_gt of the row of L. The histogram is stored first, since it
    is read twice and the texts are to be encoded once.
    """
    histogram = materialise(histogram, "lengths")
    piece = histogram.withColumn("piece", F.floor(F.col("n_tokens") / PIECE)).withColumn(
        "tokens", F.col("n_tokens") * F.col("n_docs")
    )
    sums = piece.groupBy("piece").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    earlier = Window.partitionBy(F.lit(1)).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1))
    before = sums.select(
        "piece",
        F.coalesce(F.sum("d").over(earlier), F.lit(0)).alias("d_before"),
        F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("t_before"),
        F.sum("d").over(every).alias("docs"),
        F.sum("t").over(every).alias("total_tokens"),
    )
    inside = Window.partitionBy("piece").orderBy("n_tokens")
    out = (
        piece.withColumn("d_in", F.sum("n_docs").over(inside))
        .withColumn("t_in", F.sum("tokens").over(inside))
        .join(before, "piece")
        .withColumn("docs_le", F.col("d_before") + F.col("d_in"))
        .withColumn("tokens_le", F.col("t_before") + F.col("t_in"))
    )
    docs_gt = F.col("docs") - F.col("docs_le")
    return out.select(
        "n_tokens", "n_docs", "docs_le", docs_gt.alias("docs_gt"),
        (F.col("docs_le") / F.col("docs")).alias("share_le"),
        "tokens_le", (F.col("total_tokens") - F.col("tokens_le")).alias("tokens_gt"),
        (F.col("tokens_le") + F.col("n_tokens") * docs_gt).alias("truncated_total"), "total_tokens",
    )
