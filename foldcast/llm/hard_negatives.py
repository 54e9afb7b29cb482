"""Hard negatives: rows of another label that score a little less than an anchor's best rows of its own.

Every vector is stored with the mean and the deviation of its segments, at several levels from the whole
vector to short segments. The product of two vectors' means, plus or minus that of their
deviations, bounds the part that a segment adds to the score, so pairs are set aside level by level, and
only the rest are scored exactly. Anchors are the stated query set: blocks of them meet blocks of all rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldcast.llm.common import discard_tables
from foldcast.session import materialise

#: Rows of a block on average, anchors of a block, and rows of a block that are compared at a time.
BLOCK, ANCHORS, PART = 8192, 1024, 2048
#: Segments of a vector at each level.
LEVELS = (1, 4, 16)
#: Largest sum of products that 64-bit integers are trusted with.
_LARGEST = 1 << 62


def whole_vectors(vectors: DataFrame, key: str, vector: str, label: Column | str, scale: float = 256) -> DataFrame:
    """(id, label, v): rows that have a key, a label and a vector of finite components; components times
    ``scale``, rounded down. Of rows that share a key the one with the smallest (label, vector) stays, so a
    row that repeats counts once. Labels are compared as text."""
    label = F.col(label) if isinstance(label, str) else label
    table = vectors.select(
        F.col(key).cast("long").alias("id"), label.cast("string").alias("label"), F.col(vector).alias("v")
    ).filter("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
    finite = F.forall("v", lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    scaled = F.transform("v", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    table = table.filter(finite).select("id", "label", scaled.alias("v"))
    return table.groupBy("id").agg(F.min(F.struct("label", "v")).alias("row")).select("id", "row.label", "row.v")


def segment_summaries(x: np.ndarray, levels: Sequence[int] = LEVELS) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of every row's segments, all levels side by side, both times the square root of the
    segment's length. A level never has more segments than there are components."""
    means, deviations = [], []
    for n in levels:
        for part in np.array_split(x, min(n, max(1, x.shape[1])), axis=1):
            mean = part.mean(axis=1, keepdims=True) if part.shape[1] else np.zeros((len(x), 1))
            means.append(mean[:, 0] * np.sqrt(part.shape[1]))
            deviations.append(np.sqrt(((part - mean) ** 2).sum(axis=1)))
    return np.stack(means, axis=1), np.stack(deviations, axis=1)


def level_columns(dimension: int, levels: Sequence[int] = LEVELS) -> list[slice]:
    """Which columns of the summaries each level has."""
    ends = np.cumsum([min(n, max(1, dimension)) for n in levels]).tolist()
    return [slice(a, b) for a, b in zip([0, *ends], ends)]


_BLOCK = ("ids array<long>, labels array<string>, v array<long>, means array<double>, deviations array<double>, "
          "n_v int")


def _packed(table: DataFrame, name: str, n_blocks: int, dimension: int, extra: Sequence[str] = ()) -> DataFrame:
    """A row per block of about as many rows as all others, with their vectors and summaries, by ascending id."""

    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id")
        lists = rows["v"].combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        v = np.zeros((len(rows), dimension), np.int64)  # a shorter vector ends in zeros
        of = np.repeat(np.arange(len(rows)), sizes)
        v[of, np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy()
        largest = int(np.abs(v).max(initial=0))
        if largest * largest * max(1, dimension) > _LARGEST:
            raise ValueError("vector components are too large for integer scores")
        means, deviations = segment_summaries(v.astype(np.float64))
        out = {
            name: pa.array([rows[name][0].as_py()], pa.int64()),
            "ids": pa.array([rows["id"].to_pylist()], pa.list_(pa.int64())),
            "labels": pa.array([rows["label"].to_pylist()], pa.list_(pa.string())),
            "v": pa.array([v.reshape(-1)], pa.list_(pa.int64())),
            "means": pa.array([means.reshape(-1)], pa.list_(pa.float64())),
            "deviations": pa.array([deviations.reshape(-1)], pa.list_(pa.float64())),
            "n_v": pa.array([len(rows)], pa.int32()),
        }
        for column in extra:
            out[column] = pa.array([rows[column].combine_chunks().flatten().to_numpy()], pa.list_(pa.int64()))
        return pa.table(out)

    more = "".join(f", {c} array<long>" for c in extra)
    number = F.pmod(F.xxhash64("id"), F.lit(n_blocks)).alias(name)
    return table.select("id", "label", "v", *extra, number).groupBy(name).applyInArrow(pack, f"{name} long, {_BLOCK}{more}")


def _best(owner: np.ndarray, score: np.ndarray, id_: np.ndarray, keep: int) -> np.ndarray:
    """Places of the first ``keep`` entries of each owner by falling score, then id."""
    order = np.lexsort((id_, -score, owner))
    new = np.ones(len(order), bool)
    new[1:] = owner[order][1:] != owner[order][:-1]
    start = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return order[np.arange(len(order)) - start < keep]


def best_in_windows(anchors: dict, rows: dict, low: np.ndarray, high: np.ndarray, keep: int, same_label: bool,
                    levels: Sequence[slice], part: int = PART, scored: list[int] | None = None):
    """For every anchor and window [low, high] of scores (two columns of numbers a window, int64) the ``keep`` best
    rows of its own label, itself left out, or of other labels: (anchor, window, row, score).

    ``anchors`` and ``rows`` have ids, labels (numbers), v, means, deviations. Rows are taken ``part`` at
    a time; what is found raises the lower ends of the windows for the next ones.
    """
    n, n_windows = low.shape
    floor = low.copy()
    window_of = np.zeros(0, np.int64)  # anchor * n_windows + window
    row_of, score_of = np.zeros(0, np.int64), np.zeros(0, np.int64)
    largest = int(np.abs(anchors["v"]).max(initial=0)) * int(np.abs(rows["v"]).max(initial=0)) * anchors["v"].shape[1]
    kind = np.float64 if largest < 1 << 53 else np.int64  # sums of whole numbers below 2^53 are exact
    av = anchors["v"].astype(kind)
    a_norm = np.sqrt((anchors["v"].astype(np.float64) ** 2).sum(axis=1))
    for start in range(0, len(rows["ids"]), part):
        at = np.arange(start, min(start + part, len(rows["ids"])))
        open_ = (anchors["labels"][:, None] == rows["labels"][at][None, :]) == same_label
        if same_label:
            open_ &= anchors["ids"][:, None] != rows["ids"][at][None, :]
        live = floor <= high
        least = np.where(live, floor, np.iinfo(np.int64).max).min(axis=1).astype(np.float64)
        most = np.where(live, high, np.iinfo(np.int64).min).max(axis=1).astype(np.float64)
        for level in levels:
            some = np.flatnonzero(open_.any(axis=0))
            if not len(some):
                break
            at, open_ = at[some], open_[:, some]
            middle = anchors["means"][:, level] @ rows["means"][at, level].T
            spread = anchors["deviations"][:, level] @ rows["deviations"][at, level].T
            # the bounds are rounded: leave them some room
            norm = np.sqrt((rows["v"][at].astype(np.float64) ** 2).sum(axis=1))
            spread += 1e-9 * (1 + a_norm[:, None] * norm[None, :])
            open_ &= (middle + spread >= least[:, None]) & (middle - spread <= most[:, None])
        some = np.flatnonzero(open_.any(axis=0))
        if not len(some):
            continue
        at, open_ = at[some], open_[:, some]
        if scored is not None:
            scored.append(int(open_.sum()))
        score = (av @ rows["v"][at].astype(kind).T).astype(np.int64)
        new_window, new_row, new_score = [window_of], [row_of], [score_of]
        for k in range(n_windows):
            inside = open_ & (score >= floor[:, [k]]) & (score <= high[:, [k]])
            if len(at) > keep:
                ranked = np.where(inside, score, np.iinfo(np.int64).min)
                inside &= score >= np.partition(ranked, len(at) - keep, axis=1)[:, [len(at) - keep]]
            i, j = np.nonzero(inside)
            new_window.append(i * n_windows + k)
            new_row.append(at[j])
            new_score.append(score[i, j])
        window_of, row_of, score_of = map(np.concatenate, (new_window, new_row, new_score))
        best = _best(window_of, score_of, rows["ids"][row_of], keep)
        window_of, row_of, score_of = window_of[best], row_of[best], score_of[best]
        full = np.bincount(window_of, minlength=n * n_windows) == keep
        worst = np.full(n * n_windows, np.iinfo(np.int64).max)
        np.minimum.at(worst, window_of, score_of)
        floor = np.where(full.reshape(n, -1), np.maximum(floor, worst.reshape(n, -1)), floor)
    return window_of // n_windows, window_of % n_windows, row_of, score_of


def _searched(anchors: DataFrame, blocks: DataFrame, n_blocks: int, dimension: int, keep: int, same_label: bool,
              windows: bool) -> DataFrame:
    """Every block of anchors against every block of rows: the best rows of each pair of blocks, a row each."""
    levels = level_columns(dimension)

    def table(row: dict, prefix: str) -> dict:
        n = row[f"{prefix}n_v"]
        out = {c: row[f"{prefix}{c}"].values.to_numpy().reshape(n, -1) for c in ("v", "means", "deviations")}
        out["v"] = out["v"].reshape(n, dimension)
        return out | {"ids": row[f"{prefix}ids"].values.to_numpy()}

    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                for c in ("a_n_v", "n_v"):
                    row[c] = row[c].as_py()
                queries, rows = table(row, "a_"), table(row, "")
                names = pa.concat_arrays([row["a_labels"].values, row["labels"].values]).dictionary_encode()
                numbers = names.indices.to_numpy()
                queries["labels"], rows["labels"] = numbers[: row["a_n_v"]], numbers[row["a_n_v"] :]
                n = row["a_n_v"]
                if windows:
                    low, high = (row[f"a_{c}"].values.to_numpy().reshape(n, -1) for c in ("low", "high"))
                else:
                    low, high = np.full((n, 1), -(1 << 62)), np.full((n, 1), 1 << 62)
                a, k, r, score = best_in_windows(queries, rows, low, high, keep, same_label, levels)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(queries["ids"][a]), pa.array(k.astype(np.int32)),
                        pa.array(rows["ids"][r]), pa.array(score),
                    ],
                    ["anchor_id", "place", "id", "score"],
                )

    tasks = max(1, n_blocks)
    named = anchors.select(
        *[F.col(c).alias(f"a_{c}") for c in anchors.columns], F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block")
    )
    named = named.withColumn("block", F.col("block").cast("long")).repartition(tasks, "block")
    met = named.join(blocks.repartition(tasks, "block").hint("shuffle_hash"), "block")
    found = met.mapInArrow(run, "anchor_id long, place int, id long, score long")
    order = Window.partitionBy("anchor_id", "place").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep)


def hard_negatives(vectors: DataFrame, anchors: Column, key: str = "vec_id", vector: str = "embedding",
                   label: Column | str = "label", n_positives: int = 5, n_negatives: int = 3, low_percent: int = 50,
                   high_percent: int = 95, scale: float = 256, block: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    A score is the inner product of two vectors' whole components. An anchor (a row for whose ``id`` the condition
    ``anchors`` holds) has as positives its ``n_positives`` best other rows of its label; for each of them, the
    first ``n_negatives`` rows of other labels follow whose score is from ``low_percent`` to
    ``high_percent`` of the positive's. Higher scores come first, then smaller ids; fewer rows give fewer.

    Rows without key, label or vector, or with a component that is null or not finite, take no part; see
    ``whole_vectors`` for rows that repeat. Vectors of different length are compared as if the shorter one ended in
    zeros. A positive score of zero admits zeros, a negative one nothing. Extra columns are not read, an
    empty table gives no rows, and components beyond the range of 64-bit scores raise. A label may hold any
    share of the rows: blocks are dealt by key.
    """
    table = materialise(whole_vectors(vectors, key, vector, label, scale), "vectors")
    n, dimension = table.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    n_blocks = max(1, -(-n // block))
    chosen = table.filter(F.coalesce(anchors, F.lit(False)))
    n_chosen = max(1, -(-chosen.count() // ANCHORS))
    blocks = materialise(_packed(table, "block", n_blocks, dimension), "blocks")
    queries = _packed(chosen, "anchor_block", n_chosen, dimension)
    positives = materialise(
        _searched(queries, blocks, n_blocks, dimension, n_positives, True, False), "positives"
    )
    # 100 * score within low_percent and high_percent of the positive's, in whole numbers
    scores = F.transform("found", lambda x: x["score"])
    per_anchor = positives.groupBy("anchor_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("found")
    ).select(
        F.col("anchor_id").alias("id"), F.size("found").alias("n"),
        F.transform(scores, lambda s: -F.floor(F.lit(-low_percent) * s / F.lit(100).cast("decimal(3,0)"))).alias("low"),
        F.transform(scores, lambda s: F.floor(F.lit(high_percent) * s / F.lit(100).cast("decimal(3,0)"))).alias("high"),
    )

    def padded(column: str, with_: int) -> Column:
        filled = F.concat(
            F.transform(column, lambda x: x.cast("long")), F.array_repeat(F.lit(with_).cast("long"), n_positives - F.col("n"))
        )
        return filled.alias(column)

    windows = per_anchor.select("id", padded("low", 1), padded("high", 0))
    queries = _packed(chosen.join(windows, "id"), "anchor_block", n_chosen, dimension, ("low", "high"))
    negatives = materialise(
        _searched(queries, blocks, n_blocks, dimension, n_negatives, False, True), "negatives"
    )
    discard_tables(table, blocks)
    return negatives.select(
        "anchor_id", (F.col("place") + 1).alias("turn"), "rank", F.col("id").alias("negative_id"),
        F.col("score").alias("negative_score"),
    ).join(
        positives.select(
            "anchor_id", F.col("rank").alias("turn"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")
        ),
        ["anchor_id", "turn"],
    ).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
