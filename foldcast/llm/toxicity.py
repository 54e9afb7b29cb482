"""Toxic passages: stretches of a text whose words' log-odds add up to more than chance explains."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldcast.llm.common import held_out, share_below, whole
from foldcast.session import materialise

#: About this many labelled documents of each class are learnt from at most, chosen by hash.
SAMPLE = 20_000
#: Prior count of each word in the symmetric Dirichlet prior of both classes.
PRIOR = 0.5
#: A word is kept if its log-odds are this many standard deviations from 0, and at most so many are.
MIN_Z, MAX_WORDS = 3.0, 100_000
#: Its score is its log-odds less so many standard deviations, and must be this large at least;
#: every other word scores ``OTHER``.
MARGIN, MIN_SCORE, OTHER = 1.0, 1.0, -0.05
#: Bounds for what few texts can say of the rate of chance passages, and of the log-odds of a
#: text without a significant one.
LOWEST_RATE, LOWEST_BASE, HIGHEST_BASE = -4.0, math.log(1e-2), math.log(3e-2)
#: A document is rejected from this score on.
THRESHOLD = 0.7

_WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class ToxicityModel:
    """``words``: log-odds of words that tell the classes apart; ``other``: of any other word.
    ``decay`` and ``log_rate``: in clean text, passages that score s or more per word of text
    come at the rate exp(log_rate - decay * s). ``base``: log-odds of a text without a
    significant passage."""

    words: dict[str, float] = field(default_factory=dict)
    other: float = -0.05
    decay: float = 1.0
    log_rate: float = 0.0
    base: float = math.log(1e-4)


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, size: int) -> DataFrame:
    """Stored (text, toxic): about ``size`` labelled documents per class at most, not of the held
    out third, each text once. The chosen labels are broadcast; ``size`` bounds them."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(F.col(key))).select(
        F.col(key).alias("key"), F.col(label).alias("toxic")
    )
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    shares = F.when(F.col("toxic") == 1, size / max(size, counts.get(1, 0))).otherwise(size / max(size, counts.get(0, 0)))
    chosen = known.where(share_below(F.col("key"), 11, shares)).groupBy("key").agg(F.max("toxic").alias("toxic"))
    texts = docs.where(~held_out(F.col(key))).select(F.col(key).alias("key"), whole(F.col(text)).alias("text"))
    return materialise(
        texts.join(F.broadcast(chosen), "key").groupBy("text").agg(F.max("toxic").alias("toxic")), "toxic-sample"
    )


def word_counts(sample: DataFrame) -> DataFrame:
    """(word, toxic_n, clean_n): in how many texts of each class a word occurs."""

    def counted(batches):
        for batch in batches:
            found = {0: Counter(), 1: Counter()}
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found[toxic].update(set(_WORD.findall(text.lower())))
            words = list(found[0].keys() | found[1].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(words, pa.string()), *[pa.array([found[c][w] for w in words], pa.int64()) for c in (1, 0)]],
                ["word", "toxic_n", "clean_n"],
            )

    return (
        sample.select("text", "toxic")
        .mapInArrow(counted, "word string, toxic_n long, clean_n long")
        .groupBy("word")
        .agg(F.sum("toxic_n").alias("toxic_n"), F.sum("clean_n").alias("clean_n"))
    )


def fit_toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
                 sample: int = SAMPLE) -> ToxicityModel:
    """Learn word log-odds, and how high passages of clean text score by chance.

    Log-odds compare in how many texts of each class a word occurs, under a symmetric Dirichlet
    prior of both rates. They count only where they are ``MIN_Z`` standard deviations from
    0, and then less ``MARGIN`` of these. Scores of that kind decay at the rate 1. Without
    labelled texts of both classes the model has no words and scores every text alike.
    """
    rows = labelled_sample(docs, labels, key, text, label, sample)
    counts = materialise(word_counts(rows), "toxic-words")
    classes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n_toxic, n_clean = classes.get(1, 0), classes.get(0, 0)
    if not n_toxic or not n_clean:
        return ToxicityModel()
    t, c = F.col("toxic_n") + PRIOR, F.col("clean_n") + PRIOR
    t_not, c_not = n_toxic - F.col("toxic_n") + PRIOR, n_clean - F.col("clean_n") + PRIOR
    odds = F.log(t / t_not) - F.log(c / c_not)
    error = F.sqrt(1 / t + 1 / t_not + 1 / c + 1 / c_not)
    telling = (
        counts.withColumn("odds", odds)
        .withColumn("z", F.col("odds") / error)
        .where(F.abs("z") >= MIN_Z)
        .withColumn("sure", F.signum("odds") * (F.abs("odds") - MARGIN * error))
        .where(F.abs("sure") >= MIN_SCORE)
    )
    kept = telling.orderBy(F.abs("z").desc(), "word").limit(MAX_WORDS).collect()
    words, other, decay = {r["word"]: r["sure"] for r in kept}, OTHER, 1.0
    plain = ToxicityModel(words, other, decay)

    def passages(batches):
        for batch in batches:
            out = []
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found, n = scored_passages(text, plain)
                out.append((toxic, n, sum(math.exp(min(50.0, decay * s)) >= n + 1 for *_, s in found)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int64()) for x in zip(*out)], ["toxic", "n", "high"]
            )

    seen = rows.select("text", "toxic").mapInArrow(passages, "toxic long, n long, high long")
    by_class = {
        r["toxic"]: r for r in seen.groupBy("toxic").agg(
            F.sum("high").alias("high"), F.sum((F.col("high") == 0).cast("long")).alias("without"),
            F.sum(F.col("n") / (F.col("n") + 1)).alias("expected"),
        ).collect()
    }
    # a clean text of n words has n * rate / (n + 1) passages that beat n + 1 by chance
    log_rate = math.log((by_class[0]["high"] + 0.5) / (by_class[0]["expected"] + 0.5))
    base = math.log((by_class[1]["without"] + 0.5) / (by_class[0]["without"] + 0.5))
    return ToxicityModel(
        words, other, decay, min(max(log_rate, LOWEST_RATE), 0.0), min(max(base, LOWEST_BASE), HIGHEST_BASE)
    )


def maximal_segments(hits: Sequence[tuple[int, float]], other: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score) of a row of scores that has ``hits`` at some
    places and the negative ``other`` in between (Ruzzo and Tompa's scan, linear in the hits).

    No extension or part of a maximal segment scores more, and none meets another. A stack
    holds candidates with the sums before and up to their end; one whose sum exceeds that
    of the nearest candidate with a lower start takes in all candidates from there on.
    """
    stack: list[tuple[int, int, float, float]] = []  # first, last, sum before, sum to the end
    total, at = 0.0, 0
    for place, score in hits:
        total += other * (place - at)
        at = place + 1
        before, total = total, total + score
        if score <= 0:
            continue
        first, low = place, before
        j = len(stack) - 1
        while True:
            while j >= 0 and stack[j][2] >= low:
                j -= 1
            if j < 0 or stack[j][3] >= total:
                break
            first, low = stack[j][0], stack[j][2]
            del stack[j:]
            j -= 1
        stack.append((first, place, low, total))
    return [(a, b, high - low) for a, b, low, high in stack]


def scored_passages(text: str, model: ToxicityModel) -> tuple[list[tuple[int, int, float]], int]:
    """The maximal segments of a text, in words counted from 0, and its number of words. Every
    occurrence of a word counts, wherever the word stood before."""
    words = _WORD.findall(text.lower())
    table = model.words
    return maximal_segments([(i, table[w]) for i, w in enumerate(words) if w in table], model.other), len(words)


def judged(text: str | None, model: ToxicityModel) -> tuple[float, list[tuple[int, int, float]]]:
    """The score of a text in [0, 1] and its significant passages.

    A passage that scores s is expected rate * n * exp(-decay * s) times in n words of clean
    text; it is significant if that is under 1, and the logarithm of the inverse is its
    evidence. The evidence of all passages and the base rate add up to the log-odds of
    the score.
    """
    found, n = scored_passages(text or "", model)
    chance = model.log_rate + math.log(n + 1)
    passages = [(a, b, model.decay * s - chance) for a, b, s in found if model.decay * s > max(chance, 0.0)]
    odds = model.base + sum(max(0.0, e) for *_, e in passages)
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, odds)))), passages


def toxic_passages(docs: DataFrame, model: ToxicityModel, key: str = "doc_id", text: str = "text",
                   threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: (key, held_out, score, predicted, passages).

    ``passages`` are (first_word, last_word, evidence), words being stretches of letters. Null and
    empty texts have none and the base score. A null key is never held out. Repeated rows come out
    as often; an empty table gives no rows; no other column is read.
    """
    kind = pa.list_(pa.struct([("first_word", pa.int32()), ("last_word", pa.int32()), ("evidence", pa.float64())]))

    def scored(batches):
        for batch in batches:
            out = [judged(t, model) for t in batch.column(2).to_pylist()]
            spans = [[{"first_word": a, "last_word": b, "evidence": e} for a, b, e in p] for _, p in out]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array([s for s, _ in out], pa.float64()),
                    pa.array([int(s >= threshold) for s, _ in out], pa.int32()), pa.array(spans, kind),
                ],
                ["key", "held_out", "score", "predicted", "passages"],
            )

    rows = docs.select(F.col(key).alias("key"), held_out(F.col(key)).alias("held_out"), whole(F.col(text)).alias("text"))
    return rows.mapInArrow(
        scored,
        f"key {rows.schema['key'].dataType.simpleString()}, held_out boolean, score double, predicted int, "
        "passages array<struct<first_word: int, last_word: int, evidence: double>>",
    )


def toxicity_score(text: Column, model: ToxicityModel) -> Column:
    """The score as a column expression."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([judged(t, model)[0] for t in texts], float))

    return score(whole(text))


def drop_toxic(docs: DataFrame, model: ToxicityModel, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents that score ``threshold`` or more."""
    return docs.where(toxicity_score(F.col(text), model) < threshold)
