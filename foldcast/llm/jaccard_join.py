"""Documents whose sets of word n-grams have a high Jaccard similarity, found exactly."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldcast.llm.common import by_filter, discard_tables, free_names, mark_filter, whole
from foldcast.llm.components import components
from foldcast.llm.encoding import cuts_at_white_space, in_slices, mixed, words_of
from foldcast.session import materialise

#: Least and most bits of a document's bitmap, and the columns of 64 bits that it is folded to within tiles.
BITS, MOST_BITS, FOLDED = 2048, 1 << 18, 16
#: Ratio of the largest to the smallest size of a band.
BAND = 1.5
#: Unresolved tiles of more sets than this are tried with other pivots before all their pairs are.
LARGE = 64
#: Hashes by which sets with many empty ranges are dealt to ranges, one after another.
TURNS = 6

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def band_starts(largest: int) -> np.ndarray:
    """The smallest size of each band, up to one beyond ``largest``."""
    out = [1]
    while out[-1] <= largest:
        out.append(max(out[-1] + 1, int(out[-1] * BAND)))
    return np.array(out, np.int64)


def shingle_sets(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts' sets of n-gram hashes, each sorted, one after another, and their borders.

    Words are stretches without ASCII white space, A-Z in lower case. A text of fewer than
    ``n`` words has its whole sequence as its one shingle; one without words has none.
    """

    def lowered_cuts(data: np.ndarray) -> np.ndarray:
        data[:] = _LOWER[data]
        return cuts_at_white_space(data)

    words, before = words_of(texts, lowered_cuts)
    coded = words.dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    digests = b"".join(blake2b(w[1:], digest_size=8).digest() for w in distinct)
    places = coded.indices.to_numpy()
    written = np.fromiter(map(len, distinct), np.int64, len(distinct))[places] > 1
    words = np.frombuffer(digests, np.uint64)[places[written]]
    first = np.concatenate([[0], np.cumsum(written)])[before]  # each text's first word
    count = np.diff(first)
    full = np.maximum(count - n + 1, np.minimum(count, 1))  # shingles of each text
    at = np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(full)[:-1]]), full) + np.arange(full.sum())
    size = np.repeat(np.minimum(count, n), full)
    value = mixed(size.astype(np.uint64))
    for k in range(n):
        inside = k < size
        value[inside] = mixed(value[inside] * np.uint64(0x9E3779B97F4A7C15) + words[at[inside] + k])
    ends = np.concatenate([[0], np.cumsum(full)])
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
        value[a:b].sort()
    owner = np.repeat(np.arange(len(texts)), full)
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[new], np.concatenate([[0], np.cumsum(np.bincount(owner[new], minlength=len(texts)))])


def tile_keys(values: np.ndarray, ends: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the tiles each set belongs to, one after another, and their borders.

    In band b, whose largest size is h, two sets that reach ``percent`` differ in at most
    d = floor((100 - percent) * 2h / (100 + percent)) members. Hashes fall into
    d + 1 + s ranges; a member in which the sets differ spoils one range only, so at least
    1 + s ranges hold the same members in both. A tile is the sets of a band with the same members
    in one range that is not empty. Such a pair misses all tiles only if both sets have more than s
    empty ranges; sets of that kind are dealt to ranges again by another hash, where the same
    holds, and those left after ``TURNS`` hashes meet in their empty ranges. A set is also
    entered in every higher band that a partner may belong to.
    """
    sizes = np.diff(ends)
    starts = band_starts(int(sizes.max(initial=1)) * 100 // percent + 1)
    own = np.searchsorted(starts, sizes, side="right") - 1
    top = np.searchsorted(starts, sizes * 100 // percent, side="right") - 1
    keys, owners = [], []
    scrambled = mixed(values ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    for step in range(int((top - own).max(initial=0)) + 1):
        band = own + step
        differ = (100 - percent) * 2 * (starts[np.minimum(band + 1, len(starts) - 1)] - 1) // (100 + percent)
        slack = differ // 6
        ranges = differ + 1 + slack
        chosen = np.flatnonzero((sizes > 0) & (band <= top) & (differ > 0))
        for turn in range(TURNS):
            if not len(chosen):
                break
            span = sizes[chosen]
            of = np.repeat(chosen, span)
            at = np.repeat(ends[chosen] - np.concatenate([[0], np.cumsum(span)[:-1]]), span) + np.arange(span.sum())
            dealt = mixed(values[at] + np.uint64(turn)) if turn else values[at]
            part = ((dealt >> np.uint64(32)) * ranges[of].astype(np.uint64)) >> np.uint64(32)
            if turn:
                order = np.lexsort((part, of))
                at, part = at[order], part[order]
            new = np.ones(len(at), bool)
            new[1:] = (part[1:] != part[:-1]) | (of[1:] != of[:-1])
            new = np.flatnonzero(new)
            sums = np.add.reduceat(scrambled[at], new)
            label = mixed(mixed(band[of[new]].astype(np.uint64) << np.uint64(40) | part[new]) + np.uint64(turn))
            keys.append(mixed(sums + label))
            owners.append(of[new])
            filled = np.bincount(of[new], minlength=len(sizes))
            chosen = chosen[(ranges - filled)[chosen] > slack[chosen]]
        for i in chosen.tolist():
            held = part[new[np.searchsorted(of[new], i) : np.searchsorted(of[new], i, side="right")]]
            empty = np.setdiff1d(np.arange(ranges[i], dtype=np.uint64), held)
            keys.append(mixed(mixed(np.uint64(int(band[i])) << np.uint64(40) | empty)))
            owners.append(np.full(len(empty), i))
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(len(sizes) + 1, np.int64)
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(keys)[order], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(sizes)))])


def bitmaps(values: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sets' bitmaps one after another, as 64-bit numbers, and their borders: each bit is the parity of
    the members hashed to it. A bitmap has at least two bits a member, up to ``MOST_BITS``, and a power of
    two of them, so that a longer one folds to a shorter one's length. Two sets differ in at least as many
    members as their bitmaps do in bits."""
    sizes = np.diff(ends)
    bits = np.full(len(sizes), BITS)
    while (small := (bits < 2 * sizes) & (bits < MOST_BITS)).any():
        bits[small] *= 2
    borders = np.concatenate([[0], np.cumsum(bits)])
    low = values & np.repeat(bits - 1, sizes).astype(np.uint64)
    place = np.repeat(borders[:-1], sizes) + low.astype(np.int64)
    odd = (np.bincount(place, minlength=borders[-1]) & 1).astype(bool)
    return np.packbits(odd).view(np.int64), borders // 64


def folded(maps: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Each bitmap's parts laid over one another by exclusive or: bitmaps of parities again, of fewer
    bits, so with a weaker bound of the same kind."""
    if len(borders) == 1:
        return np.zeros((0, FOLDED), np.int64)
    return np.bitwise_xor.reduceat(maps.reshape(-1, FOLDED), borders[:-1] // FOLDED)


def sketches(docs: DataFrame, key: str, text: str, n: int, percent: int) -> DataFrame:
    """Stored, one row per document: (row, key, mark, n_shingles, h1, h2, bitmap, tiles, f0, f1, ...). ``row``
    numbers the rows; (n_shingles, h1, h2) stand for the set; f0 and so on are the folded bitmap."""
    parts = [f"f{i}" for i in range(FOLDED)]

    def sketched(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for start, some in in_slices(texts, 1_500_000):
                values, ends = shingle_sets(some, n)
                sizes = np.diff(ends)
                tiles, tile_ends = tile_keys(values, ends, percent)
                sums = [np.concatenate([[np.uint64(0)], np.cumsum(mixed(values ^ np.uint64(c)), dtype=np.uint64)]) for c in (1, 2)]
                h1, h2 = (s[ends[1:]] - s[ends[:-1]] for s in sums)
                maps, map_ends = bitmaps(values, ends)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, len(some)), batch.column(2).slice(start, len(some)),
                        pa.array(sizes), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(map_ends, pa.int32()), pa.array(maps)),
                        pa.ListArray.from_arrays(pa.array(tile_ends, pa.int32()), pa.array(tiles.view(np.int64))),
                        *map(pa.array, np.ascontiguousarray(folded(maps, map_ends).T)),
                    ],
                    ["key", "mark", "n_shingles", "h1", "h2", "bitmap", "tiles", *parts],
                )

    rows = docs.select(
        F.col(key).alias("key"), whole(F.col(text)).alias("text"), F.xxhash64(whole(F.col(text))).alias("mark")
    )
    kind = rows.schema["key"].dataType.simpleString()
    return materialise(
        rows.mapInArrow(
            sketched,
            f"key {kind}, mark long, n_shingles long, h1 long, h2 long, bitmap array<long>, tiles array<long>, "
            + ", ".join(f"{part} long" for part in parts),
        ).withColumn("row", F.monotonically_increasing_id()),
        "sketches",
    )


def _could_reach(percent: int, a: str, b: str, differ: str) -> str:
    """Condition on sizes and bitmaps of two sets: bits that differ stand for members that only one
    set has, which bounds the common members from above."""
    both = f"({a}.n_shingles + {b}.n_shingles)"
    common = f"least({a}.n_shingles, {b}.n_shingles, ({both} - {differ}) div 2)"
    return f"{100 + percent} * {common} >= {percent} * {both}"


def _sizes_could_reach(percent: int, a: str, b: str) -> str:
    return f"100 * least({a}.n_shingles, {b}.n_shingles) >= {percent} * greatest({a}.n_shingles, {b}.n_shingles)"


def _bits_apart(a: str, b: str) -> str:
    """The longer bitmap is folded to the length of the shorter one."""
    length = f"least(size({a}.bitmap), size({b}.bitmap))"

    def short(m: str) -> str:
        rest = f"sequence(i + {length}, size({m}) - 1, {length})"
        return (
            f"if(size({m}) = {length}, {m}, "
            f"transform(slice({m}, 1, {length}), (w, i) -> aggregate({rest}, w, (s, j) -> s ^ {m}[j])))"
        )

    return f"aggregate(zip_with({short(f'{a}.bitmap')}, {short(f'{b}.bitmap')}, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)"


def _folded_bits_apart(a: str, b: str) -> str:
    """As plain columns, which compiled joins compare much faster than arrays."""
    return "(" + " + ".join(f"bit_count({a}.f{i} ^ {b}.f{i})" for i in range(FOLDED)) + ")"


class _Join:
    """One run of the join over stored sketches."""

    def __init__(self, docs: DataFrame, key: str, text: str, n: int, percent: int):
        self.docs, self.key, self.text, self.n, self.percent = docs, key, text, n, percent
        self.sketches = sketches(docs, key, text, n, percent)
        filled = self.sketches.where("n_shingles > 0")
        self.classes = materialise(
            filled.groupBy("n_shingles", "h1", "h2").agg(F.min("row").alias("class"), F.count(F.lit(1)).alias("copies")),
            "classes",
        )
        self.passing: list[DataFrame] = []  # stored tables that only roots() needs
        self.maps = self.sketches.select("row", "n_shingles", "bitmap")
        self.repeated = not filled.groupBy("key", "mark").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").isEmpty()

    def tiles(self) -> DataFrame:
        """Stored (tile, row, pivot) of every tile with two sets or more; one row stands for equal sets."""
        one = self.classes.select(F.col("class").alias("row"))
        entries = self.sketches.join(one, "row", "left_semi").select("row", F.explode("tiles").alias("tile"))
        entries = entries.repartition("tile")  # one shuffle, read by the count and by the join
        shared = entries.groupBy("tile").agg(F.min("row").alias("pivot"), F.count(F.lit(1)).alias("sets")).where("sets > 1")
        return materialise(entries.join(shared.select("tile", "pivot"), "tile"), "tiles")

    def linked(self, pairs: DataFrame) -> DataFrame:
        """Stored (a, b) of those ``pairs`` that reach the similarity: by bitmaps first, then by
        intersecting the sorted sets, which are made again for the documents concerned only."""
        left = self.maps.select(F.col("row").alias("a"), F.struct("n_shingles", "bitmap").alias("x"))
        right = self.maps.select(F.col("row").alias("b"), F.struct("n_shingles", "bitmap").alias("y"))
        near = _could_reach(self.percent, "x", "y", _bits_apart("x", "y"))
        hopeful = materialise(
            pairs.join(left, "a").join(right, "b")
            .where(f"CASE WHEN {_sizes_could_reach(self.percent, 'x', 'y')} THEN {near} ELSE false END").select("a", "b"),
            "pairs",
        )
        wanted = hopeful.select(F.col("a").alias("row")).unionByName(hopeful.select(F.col("b").alias("row"))).distinct()
        n, percent = self.n, self.percent

        def sets(batches):
            for batch in batches:
                texts = batch.column(1).to_pylist()
                for start, some in in_slices(texts, 1_500_000):
                    values, ends = shingle_sets(some, n)
                    data = memoryview(values.astype("<u8").tobytes())
                    spans = zip((8 * ends[:-1]).tolist(), (8 * ends[1:]).tolist())
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(start, len(some)), pa.array([bytes(data[a:b]) for a, b in spans], pa.binary())],
                        ["row", "members"],
                    )

        def checked(batches):
            for batch in batches:
                good = []
                for x, y in zip(batch.column(2), batch.column(3)):
                    p, q = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                    at = np.minimum(np.searchsorted(q, p), len(q) - 1)
                    common = int((q[at] == p).sum())
                    good.append(100 * common >= percent * (len(p) + len(q) - common))
                yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

        who = materialise(self.sketches.select("row", "key", "mark").join(wanted, "row", "left_semi"), "wanted")
        marks = materialise(mark_filter(who), "filter")
        its_key, its_mark, its_row, mark = free_names(self.docs, "its_key", "its_mark", "its_row", "text_mark")
        its = who.toDF(its_row, its_key, its_mark)
        tagged = self.docs.select(
            F.col(self.key).alias(self.key), whole(F.col(self.text)).alias(self.text)
        ).withColumn(mark, F.xxhash64(F.col(self.text)))
        tagged = by_filter(tagged, mark, marks, "left_semi")  # other texts are not moved
        texts = tagged.join(
            its, (tagged[mark] == its[its_mark]) & tagged[self.key].eqNullSafe(its[its_key])
        ).select(F.col(its_row).alias("row"), F.col(self.text).alias("text"))
        made = texts.mapInArrow(sets, "row long, members binary")
        made = materialise(made.dropDuplicates(["row"]) if self.repeated else made, "sets")
        a = made.select(F.col("row").alias("a"), F.col("members").alias("x"))
        b = made.select(F.col("row").alias("b"), F.col("members").alias("y"))
        out = materialise(
            hopeful.join(a, "a").join(b, "b").select("a", "b", "x", "y").mapInArrow(checked, "a long, b long"), "links"
        )
        discard_tables(made, hopeful, who, marks)
        return out

    def roots(self) -> DataFrame:
        """(node, root) of the classes that have links.

        First every tile's members are compared with one of them, its pivot; that resolves tiles whose
        members end up in one component, however large. In the others all pairs that are not
        yet in one component are compared, tile by tile, folded bitmaps within the join. Tiles of
        more than ``LARGE`` sets, if they hold many pairs, are first tried with other pivots: the one
        with most links, then, where that resolved some, one at random.
        """
        tiles = self.tiles()
        self.passing.append(tiles)
        tried = materialise(_ordered(tiles.where("row <> pivot"), "pivot", "row"), "tried")
        links = self.linked(tried)
        n_rows = self.classes.count()
        before = float("inf")
        for round_ in range(3):
            found = materialise(components(links), "components")
            rooted = tiles.select("tile", "row").join(found.withColumnRenamed("node", "row"), "row", "left").withColumn(
                "root", F.coalesce("root", "row")
            )
            apart = rooted.groupBy("tile").agg(
                F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("sets")
            ).where("low <> high")
            open_ = materialise(rooted.join(apart.select("tile", "sets"), "tile"), "open")
            large = open_.where(F.col("sets") > LARGE)
            n_open, work = open_.agg(F.count(F.lit(1)), F.sum(F.expr(f"if(sets > {LARGE}, double(sets), 0D)"))).first()
            if not n_open:
                return found
            if work < 200 * n_rows or work > 0.9 * before or round_ == 2:
                break
            before = work
            degree = links.select(F.col("a").alias("row")).unionByName(links.select(F.col("b").alias("row"))).groupBy("row").agg(
                F.count(F.lit(1)).alias("degree")
            )
            ranked = large.join(degree, "row", "left").withColumn(
                "rank", F.struct(F.coalesce("degree", F.lit(0)) * (1 - round_), F.xxhash64("row", F.lit(round_)), "row")
            )
            other = ranked.groupBy("tile").agg(F.max("rank").alias("best")).select("tile", F.col("best.row").alias("pivot"))
            more = _ordered(large.join(other, "tile").where("row <> pivot"), "pivot", "row").join(tried, ["a", "b"], "left_anti")
            more = materialise(more, "tried")
            tried = tried.unionByName(more)
            links = links.unionByName(self.linked(more))
        folds = self.sketches.select("row", "n_shingles", *[f"f{i}" for i in range(FOLDED)])
        members = open_.select("tile", "row", "root").join(folds, "row")
        x, y = members.alias("x"), members.alias("y")
        pairs = x.join(
            y,
            F.expr(
                "x.tile = y.tile AND x.row < y.row AND x.root <> y.root AND "
                + _could_reach(self.percent, "x", "y", _folded_bits_apart("x", "y"))
            ),
        ).select(F.col("x.row").alias("a"), F.col("y.row").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
        return components(links.unionByName(self.linked(pairs)))


def _ordered(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def jaccard_join(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 3, percent: int = 90) -> DataFrame:
    """One row per document: (key, mark, n_shingles, component, first), documents linked when
    100 * |A and B| >= percent * |A or B| for their sets of n-word shingles.

    ``component`` is the smallest key of the documents reachable by links, the document's own included
    (null only if all are null); ``first`` is true for one document of each component: the smallest
    key, null last, then the smallest row. Documents without words (null and empty texts too) are linked
    with nothing. Rows that repeat a key or a text are documents of their own. An empty
    table gives no rows. No link is lost: tiles meet every pair that can reach the similarity.
    """
    join = _Join(docs, key, text, n, percent)
    roots = materialise(join.roots(), "roots")
    classed = join.sketches.select("row", "key", "mark", "n_shingles", "h1", "h2").join(
        join.classes.select("n_shingles", "h1", "h2", "class"), ["n_shingles", "h1", "h2"], "left"
    )
    labelled = materialise(
        classed.withColumn("class", F.coalesce("class", "row"))
        .join(roots.withColumnRenamed("node", "class"), "class", "left")
        .select("row", "key", "mark", "n_shingles", F.coalesce("root", "class").alias("root")),
        "labelled",
    )
    discard_tables(roots, join.sketches, join.classes, *join.passing)
    best = labelled.groupBy("root").agg(
        F.min("key").alias("component"), F.min(F.struct(F.col("key").isNull().alias("no_key"), "key", "row")).alias("least")
    )
    return labelled.join(best, "root").select(
        "key", "mark", "n_shingles", "component", (F.col("row") == F.col("least.row")).alias("first")
    )


def drop_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 3, percent: int = 90) -> DataFrame:
    """``docs`` with one document of each component, and all of its columns."""
    its_key, its_mark, mark = free_names(docs, "its_key", "its_mark", "text_mark")
    joined = jaccard_join(docs, key, text, n, percent)
    gone = joined.where(~F.col("first")).select("mark")
    marks = materialise(mark_filter(gone), "filter")
    tagged = docs.withColumn(mark, F.xxhash64(whole(F.col(text))))
    sure = by_filter(tagged, mark, marks, "left_anti").drop(mark)  # most documents: they stay where they are
    tagged = by_filter(tagged, mark, marks, "left_semi")
    kept = joined.where("first").select(F.col("key").alias(its_key), F.col("mark").alias(its_mark))
    left = tagged.join(kept, (tagged[mark] == kept[its_mark]) & tagged[key].eqNullSafe(kept[its_key]), "left_semi")
    twice = joined.groupBy("key", "mark").agg(F.count(F.lit(1)).alias("rows"), F.max("first").alias("kept")).where("rows > 1 AND kept")
    # rows that repeat key and text: one stays, or all if they have no words and so no links
    if twice.isEmpty():
        return sure.unionByName(left.drop(mark))
    has_words = F.col(text).rlike(r"[^\x20\x09-\x0D]")
    left = left.where(has_words).dropDuplicates([mark]).unionByName(left.where(~F.coalesce(has_words, F.lit(False))))
    return sure.unionByName(left.drop(mark))
