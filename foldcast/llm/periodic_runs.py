"""Runs of words that repeat with a period, found by longest common extensions.

For a period q the places 0, g, 2g, ... are compared with those q further on, g being so small that
a run's stretch of equal pairs holds one of them; how far the words agree from there to
either side gives the run. Agreement is looked up in an index of a difference cover: only suffixes that
start at a place of the cover (4 of 13) are sorted, with the common lengths of neighbours in
a table of range minima. Two places are compared word by word until both stand on the cover, which
takes less than 13 words; most end before.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldcast.llm.common import slices, whole

#: A difference cover: every number modulo 13 is the difference of two of these (fixed values).
MODULUS, COVER = 13, (0, 1, 3, 9)
#: A run has this many words and periods at least.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Characters whose words are indexed together, and pairs of places that are compared together.
SLICE, PAIRS = 2_000_000, 1 << 19

_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def _meeting_steps() -> np.ndarray:
    """For places of residues a and b the steps until both stand on the cover."""
    on = np.isin(np.arange(2 * MODULUS) % MODULUS, COVER)
    return np.array([[next(d for d in range(MODULUS) if on[a + d] and on[b + d]) for b in range(MODULUS)]
                     for a in range(MODULUS)])


_STEPS = _meeting_steps()


class CommonExtensions:
    """Answers how many words agree from two places on, for many pairs at once.

    ``words`` are numbers of several documents one behind another; ``owner`` has each word's
    document and ``end`` where that document ends. Pairs lie within one document.
    """

    def __init__(self, words: np.ndarray, owner: np.ndarray, end: np.ndarray):
        n = len(words)
        # behind the end stand numbers that no word has, each once, so that nothing agrees with them
        self._words = np.concatenate([words, -1 - np.arange(MODULUS + 1)]).astype(np.int64)
        self._end = end
        sample = np.flatnonzero(np.isin(np.arange(n) % MODULUS, COVER))
        self._sample_at = np.full(n + 1, -1, np.int64)
        self._sample_at[sample] = np.arange(len(sample))
        self._next = np.full(len(sample), -1, np.int64)  # the sample one modulus further on in the document
        inside = sample + MODULUS < end[sample]
        self._next[inside] = self._sample_at[sample[inside] + MODULUS]
        rank, levels = self._sorted(sample, owner[sample])
        self._rank = rank
        self._minima = self._range_minima(self._common_of_neighbours(sample, owner[sample], rank, levels))

    def _word(self, at: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The words at places, -1 behind their document's end."""
        return np.where(at < end, self._words[np.minimum(at, len(self._words) - 1)], -1)

    def _sorted(self, sample: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Every sample's place in the order of (document, suffix), and the classes of samples that agree in
        their first 13, 26, 52, ... words. Only samples that are still tied are sorted on."""
        n = len(sample)
        end = self._end[sample]
        # a class is named by the first place that its members take in the order
        order = np.arange(n)
        name = np.zeros(n, np.int64)
        tied = order

        def refined(key: np.ndarray) -> np.ndarray:
            """Split the tied samples' classes by ``key``; returns the samples tied after that."""
            nonlocal tied
            if not len(tied):
                return tied
            by = np.lexsort((key, name[tied]))
            ordered, ordered_key, ordered_name = tied[by], key[by], name[tied][by]
            first = np.ones(len(by), bool)
            first[1:] = (ordered_name[1:] != ordered_name[:-1]) | (ordered_key[1:] != ordered_key[:-1])
            class_first = np.ones(len(by), bool)
            class_first[1:] = ordered_name[1:] != ordered_name[:-1]
            starts = np.maximum.accumulate(np.where(class_first, np.arange(len(by)), 0))
            place = ordered_name + np.arange(len(by)) - starts  # the place in the order of all
            name[ordered] = np.maximum.accumulate(np.where(first, place, -1))
            alone = first & np.append(first[1:], True)
            return ordered[~alone]

        tied = refined(owner)
        for step in range(MODULUS):
            tied = refined(self._word(sample[tied] + step, end[tied]))
        levels = [name.copy()]
        hop = self._next.copy()
        while len(tied):
            behind = np.where(hop[tied] >= 0, levels[-1][hop[tied]], -1)
            tied = refined(behind)
            levels.append(name.copy())
            hop = np.where(hop >= 0, hop[hop], -1)
        return name, levels

    def _common_of_neighbours(self, sample: np.ndarray, owner: np.ndarray, rank: np.ndarray,
                              levels: list[np.ndarray]) -> np.ndarray:
        """Words that each suffix in the order has in common with the one before it (0 between documents)."""
        n = len(sample)
        common = np.zeros(n, np.int64)
        if not n:
            return common
        by = np.empty(n, np.int64)
        by[rank] = np.arange(n)
        at = np.flatnonzero(owner[by[1:]] == owner[by[:-1]]) + 1
        a, b = by[at - 1], by[at]
        pa_, pb = sample[a], sample[b]
        hops = [self._next]
        for _ in levels[1:]:
            hops.append(np.where(hops[-1] >= 0, hops[-1][hops[-1]], -1))
        for level, hop in zip(reversed(levels), reversed(hops)):
            # the classes of a level agree in all their words, so neither ends before
            live = (a >= 0) & (b >= 0)
            same = np.zeros(len(a), bool)
            same[live] = (level[a[live]] == level[b[live]]) & (hop[a[live]] >= 0) & (hop[b[live]] >= 0)
            a, b = np.where(same, hop[a], a), np.where(same, hop[b], b)
        done = sample[a] - pa_
        end = self._end[pa_]
        open_ = np.ones(len(a), bool)
        for _ in range(2 * MODULUS):
            x, y = self._word(pa_ + done, end), self._word(pb + done, end)
            open_ &= (x == y) & (x >= 0)
            if not open_.any():
                break
            done[open_] += 1
        common[at] = done
        return common

    @staticmethod
    def _range_minima(values: np.ndarray) -> list[np.ndarray]:
        table = [values.astype(np.int32)]
        width = 1
        while 2 * width <= len(values):
            table.append(np.minimum(table[-1][:-width], table[-1][width:]))
            width *= 2
        return table

    def _of_samples(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        low = np.minimum(self._rank[a], self._rank[b]) + 1
        high = np.maximum(self._rank[a], self._rank[b]) + 1
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(a), np.int64)
        for k in np.unique(level).tolist():
            here = np.flatnonzero(level == k)
            row = self._minima[k]
            out[here] = np.minimum(row[low[here]], row[high[here] - (1 << k)])
        return out

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that agree from the places ``a`` and ``b`` on, ``a`` before ``b``."""
        end = self._end[a]
        steps = _STEPS[a % MODULUS, b % MODULUS]
        out = np.zeros(len(a), np.int64)
        left = np.arange(len(a))
        for step in range(MODULUS):
            meet = steps[left] == step
            inside = b[left] + step < end[left]
            at = left[meet & inside]
            if len(at):
                out[at] = step + self._of_samples(self._sample_at[a[at] + step], self._sample_at[b[at] + step])
            left = left[~meet & inside]
            left = left[self._words[a[left] + step] == self._words[b[left] + step]]
            out[left] = step + 1
            if not len(left):
                break
        return out


def grid_pairs(sizes: np.ndarray, least_words: int, least_periods: int):
    """The pairs of places to compare, in parts: (document, place, period). For each period q the places are
    a stretch apart that every run of this period has in equal pairs."""
    longest = int(sizes.max(initial=0)) // least_periods
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    held = 0
    by_size = np.argsort(-sizes, kind="stable")
    falling = -sizes[by_size]
    for q in range(1, longest + 1):
        grid = max(least_words - q, (least_periods - 1) * q)
        docs = by_size[: np.searchsorted(falling, -max(least_words, least_periods * q), side="right")]
        n = (sizes[docs] - q + grid - 1) // grid
        for low in range(0, int(n.max(initial=0)), PAIRS):  # a part of a very long document at a time
            some = np.minimum(n, low + PAIRS) - np.minimum(n, low)
            of = np.repeat(docs, some)
            place = (np.arange(some.sum()) - np.repeat(np.cumsum(some) - some, some) + low) * grid
            parts.append((of, place, np.full(len(of), q, np.int64)))
            held += len(of)
            if held >= PAIRS:
                yield tuple(np.concatenate(c) for c in zip(*parts))
                parts, held = [], 0
    if parts:
        yield tuple(np.concatenate(c) for c in zip(*parts))


def runs_of(documents: list[np.ndarray], least_words: int = LEAST_WORDS,
            least_periods: int = LEAST_PERIODS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All runs of documents given as numbers of words: (document, start, length, period), in this order."""
    sizes = np.fromiter(map(len, documents), np.int64, len(documents))
    begin = np.cumsum(sizes) - sizes
    words = np.concatenate([np.zeros(0, np.int64), *documents])
    n = len(words)
    owner = np.repeat(np.arange(len(documents)), sizes)
    forward = CommonExtensions(words, owner, (begin + sizes)[owner])
    turned = owner[::-1]
    backward = CommonExtensions(words[::-1], turned, (n - begin)[turned])
    found = []
    for doc, place, period in grid_pairs(sizes, least_words, least_periods):
        a = begin[doc] + place
        same = words[a] == words[a + period]
        doc, place, period, a = doc[same], place[same], period[same], a[same]
        after = forward.common(a, a + period)
        before = np.zeros(len(a), np.int64)
        inner = np.flatnonzero(place > 0)
        last = n - a[inner]  # of the word before, counted from the other end
        before[inner] = backward.common(last - period[inner], last)
        length = before + after + period
        long = length >= np.maximum(least_words, least_periods * period)
        found.append(np.stack([doc, place - before, length, period], axis=1)[long])
    if not found:
        return (np.zeros(0, np.int64),) * 4
    runs = np.concatenate(found)
    # a run is met at several places, and with multiples of its period: the smallest one stays
    runs = runs[np.lexsort((runs[:, 3], runs[:, 2], runs[:, 1], runs[:, 0]))]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:, :3] != runs[:-1, :3]).any(axis=1)
    runs = runs[new]
    runs = runs[np.lexsort((runs[:, 3], runs[:, 1], runs[:, 0]))]
    return runs[:, 0], runs[:, 1], runs[:, 2], runs[:, 3]


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS,
                  least_periods: int = LEAST_PERIODS) -> DataFrame:
    """(key, n_words, runs, collapsed) of every text.

    Words are stretches without ASCII white space, numbered from 0. A run is a stretch of words of smallest
    period q, of ``least_words`` words and ``least_periods`` periods at least, which no neighbouring
    word extends; ``runs`` has (start, length, period) by start, then period. ``collapsed`` are the words that
    are in no run or among a run's first q only, joined by single blanks. Null texts and those without words
    have no runs and an empty ``collapsed``; rows that repeat come out as often; extra columns
    are not read; an empty table gives no rows. A text is handled as a whole in one task, in memory in
    proportion to its length; nothing is shuffled.
    """

    def found(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for first, last in slices(texts, SLICE):
                words = [_WORDS.findall(t.encode()) for t in texts[first:last]]
                flat = pa.array([w for row in words for w in row], pa.large_binary())
                sizes = np.fromiter(map(len, words), np.int64, len(words))
                numbers = np.split(flat.dictionary_encode().indices.to_numpy(), np.cumsum(sizes)[:-1])
                doc, start, length, period = runs_of(numbers, least_words, least_periods)
                borders = np.searchsorted(doc, np.arange(len(words) + 1))
                collapsed = []
                for i, row in enumerate(words):
                    kept = row
                    if borders[i] < borders[i + 1]:
                        gone = np.zeros(len(row) + 1, np.int64)
                        here = slice(borders[i], borders[i + 1])
                        np.add.at(gone, start[here] + period[here], 1)
                        np.add.at(gone, start[here] + length[here], -1)
                        kept = [row[k] for k in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]
                    collapsed.append(b" ".join(kept))
                runs = pa.StructArray.from_arrays([pa.array(c) for c in (start, length, period)], ["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, last - first), pa.array(sizes),
                        pa.ListArray.from_arrays(pa.array(borders, pa.int32()), runs),
                        pa.array(collapsed, pa.binary()).cast(pa.string()),
                    ],
                    ["key", "n_words", "runs", "collapsed"],
                )

    table = docs.select(F.col(key).alias("key"), whole(F.col(text)).alias("text"))
    return table.mapInArrow(
        found,
        f"key {table.schema['key'].dataType.simpleString()}, n_words long, "
        "runs array<struct<start: long, length: long, period: long>>, collapsed string",
    )


def with_planted_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text): in texts whose key's crc32 is a multiple of 10, the words from place ``a`` on become repeats of
    the first p of them, with a and p from the rest of that number; other texts stay as they are."""
    number = F.crc32(F.col(key).cast("string"))
    table = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), number.alias("h"))
    g = F.floor(F.col("h") / 10).cast("long")
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    chosen = table.filter(F.coalesce(F.col("h") % 10 == 0, F.lit(False))).select(
        "key", words.alias("words"), g.alias("g"), F.size(words).alias("n")
    )
    rest = table.filter(F.coalesce(F.col("h") % 10 != 0, F.lit(True))).select("key", "text")
    a = (F.col("g") % F.greatest("n", F.lit(1))).cast("int")
    turns = (3 + F.col("g") % 8).cast("int")
    planted = chosen.select("key", "words", "n", a.alias("a"), turns.alias("turns")).select(
        "key", "words", "n", "a", (1 + F.floor((F.col("n") - F.col("a")) / F.col("turns"))).cast("int").alias("p"), "turns"
    )
    once = F.slice("words", F.col("a") + 1, F.col("p"))
    again = F.flatten(F.array_repeat(once, F.col("turns") + 1))
    changed = F.slice(F.concat(F.slice("words", F.lit(1), F.col("a")), again), F.lit(1), F.greatest("n", F.lit(0)))
    return rest.unionByName(planted.select("key", F.array_join(changed, " ").alias("text")))
