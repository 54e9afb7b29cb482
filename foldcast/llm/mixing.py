"""Mixing sources to target weights, in blocks of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldcast.llm.common import WORD, free_names, whole
from foldcast.session import materialise

#: Words of a block; the last block of a source may be shorter.
BLOCK = 256
#: Blocks of an output shard.
SHARD = 1024
#: Weights of the sources in code point order, repeated.
WEIGHTS = (5, 2, 1)
#: Rounds of the pseudorandom permutations.
ROUNDS = 24
#: Output slots that one task makes at a time, and documents of one running sum.
CHUNK = 4096


def permuted(x: Column, n: Column, inverse: bool, *keys: Column) -> Column:
    """``x`` in [0, n) under the pseudorandom permutation of [0, n) that ``keys`` name, or under
    its inverse. Swap-or-not: each round pairs ``x`` with (k - x) mod n and swaps the pair or
    not by a hash of its larger member, so every round is its own inverse and the
    domain may have any size."""

    def swap(x: Column, round_: Column) -> Column:
        other = F.pmod(F.xxhash64(F.lit("pair"), round_, *keys) - x, n)
        coin = F.xxhash64(F.lit("coin"), round_, *keys, F.greatest(x, other))
        return F.when(coin.bitwiseAND(F.lit(1)) == 1, other).otherwise(x)

    order = range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS)
    return F.aggregate(F.array(*[F.lit(i) for i in order]), x.cast("long"), swap)


def measured(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """Stored, without texts: (key, mark, source, size). ``mark`` tells documents of one key apart."""
    return materialise(
        docs.select(
            F.col(key).alias("key"), F.xxhash64(whole(F.col(text))).alias("mark"),
            F.col(source).alias("source"),
            F.regexp_count(whole(F.col(text)), F.lit(WORD)).cast("long").alias("size"),
        ),
        "sizes",
    )


def source_targets(sizes: DataFrame, weights=WEIGHTS, total: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per source: (no, source, source_size, target).

    Sources in code point order, null last, take the weights in turn and share ``total`` times
    all words by weight. None gets more than ``most`` times its own words; what it
    leaves is shared again by weight among the rest. With sources in order of
    most * size / weight, the first k are full for one k, and the rest get one common level
    times their weight.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    every = Window.partitionBy(F.lit(1))
    given = F.array(*[F.lit(float(w)) for w in weights])
    ranked = by_source.withColumn(
        "no", F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1
    ).withColumn("weight", F.element_at(given, (F.col("no") % len(weights) + 1).cast("int")))
    up = every.orderBy(F.col("source_size") / F.col("weight"), "no")
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    after = up.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (
        F.lit(total) * F.sum("source_size").over(every)
        - F.lit(most) * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    ) / F.sum("weight").over(after)
    # a source is full if the level would lift it above its bound while all before it are full
    full = F.min((level * F.col("weight") > F.lit(most) * F.col("source_size")).cast("int")).over(
        up.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    leveled = ranked.withColumn("level", level).withColumn("full", full).withColumn("at", F.row_number().over(up))
    # the common level is that of the first source that is not full
    common = F.min(F.when(F.col("full") == 0, F.struct("at", "level"))).over(every)["level"]
    return leveled.withColumn(
        "target",
        F.when(F.col("full") == 1, F.lit(most) * F.col("source_size")).otherwise(
            F.least(common * F.col("weight"), F.lit(most) * F.col("source_size"))
        ),
    ).select("no", "source", "source_size", "target")


def slot_counts(targets: DataFrame, seed: int, block: int = BLOCK) -> DataFrame:
    """Adds per source: ``n_blocks``, ``n_slots`` and ``cut``, the words that its last slot
    leaves out so that the words of all its slots are its target, rounded.

    Slots run through the blocks in one permutation per epoch, so k full epochs hold
    k times the source's words, and the rest of the target is a prefix of one more epoch.
    The source's short last block is found in that prefix by the inverse permutation.
    """
    size = F.col("source_size")
    out = (
        targets.withColumn("n_blocks", F.ceil(size / block))
        .withColumn("goal", F.round("target").cast("long"))
        .withColumn("epochs", F.when(size > 0, F.floor(F.col("goal") / size)).otherwise(F.lit(0)))
        .withColumn("rest", F.col("goal") - F.col("epochs") * size)
        .withColumn("short", F.col("n_blocks") * block - size)
        .withColumn(
            "short_at",
            F.when(
                size > 0,
                permuted(F.col("n_blocks") - 1, F.col("n_blocks"), True,
                         F.lit(seed), F.lit("block"), F.col("no"), F.col("epochs")),
            ),
        )
        .withColumn("plain", F.ceil(F.col("rest") / block))
        .withColumn("meets", F.coalesce(F.col("short_at") < F.col("plain"), F.lit(False)))
        .withColumn(
            "prefix",
            F.when(F.col("meets"), F.ceil((F.col("rest") + F.col("short")) / block)).otherwise(F.col("plain")),
        )
    )
    left_over = F.col("prefix") * block - F.when(F.col("meets"), F.col("short")).otherwise(F.lit(0))
    return out.select(
        "no", "source", "source_size", "target", "n_blocks",
        (F.col("epochs") * F.col("n_blocks") + F.col("prefix")).alias("n_slots"),
        (left_over - F.col("rest")).alias("cut"),
    )


def drawn_blocks(counts: DataFrame, seed: int, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """The mix: one row per output slot, (shard, slot, no, block, words).

    The slots of all sources are spread over the shards by one permutation of all slots, which
    draws the source counts of each shard from the multinomial of the targets, given that
    each source's slots add up to its target over all shards. (Independent draws per shard
    would miss small targets by their standard deviation.) The k-th slot of a source
    maps to a block through the source's permutation of its blocks, a new one per epoch.
    ``words`` is how many words the slot takes from the start of its block.
    """
    every = Window.partitionBy(F.lit(1))
    starts = (
        counts.where("n_slots > 0")
        .withColumn("start", F.sum("n_slots").over(every.orderBy("no")) - F.col("n_slots"))
        .withColumn("all_slots", F.sum("n_slots").over(every))
    )
    chunks = starts.withColumn(
        "chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("n_slots") - 1) / CHUNK)))
    ).repartition(int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "no", "chunk")
    slots = chunks.withColumn(
        "k",
        F.explode(
            F.sequence(
                F.col("chunk") * CHUNK, F.least((F.col("chunk") + 1) * CHUNK, F.col("n_slots")) - 1
            )
        ),
    )
    epoch = F.floor(F.col("k") / F.col("n_blocks"))
    length = F.least(F.lit(block), F.col("source_size") - F.col("block") * block)
    place = permuted(F.col("start") + F.col("k"), F.col("all_slots"), False, F.lit(seed), F.lit("slot"))
    return (
        slots.withColumn(
            "block",
            permuted(F.col("k") % F.col("n_blocks"), F.col("n_blocks"), False,
                     F.lit(seed), F.lit("block"), F.col("no"), epoch),
        )
        .withColumn("place", place)
        .select(
            F.floor(F.col("place") / shard).alias("shard"), (F.col("place") % shard).alias("slot"),
            "no", "block",
            (length - F.when(F.col("k") == F.col("n_slots") - 1, F.col("cut")).otherwise(F.lit(0))).alias("words"),
        )
    )


def packed(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Adds to each document its source's number, size and target, and ``start``: the words of
    its source before it, in order of (hash bucket, key, mark). The running sum is taken
    within buckets of some thousand documents and over the buckets' sums, so that no task
    sees a whole source."""
    buckets = max(1, sizes.count() // CHUNK)
    named = targets.withColumnRenamed("source", "its_source")
    placed = (
        sizes.join(named, sizes["source"].eqNullSafe(named["its_source"]))
        .drop("its_source")
        .withColumn("bucket", F.pmod(F.xxhash64("key", "mark"), F.lit(buckets)))
    )
    sums = placed.groupBy("no", "bucket").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("before", F.coalesce(F.sum("words").over(earlier), F.lit(0))).drop("words")
    inside = (
        Window.partitionBy("no", "bucket")
        .orderBy("key", "mark", "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        placed.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(offsets, ["no", "bucket"])
        .withColumn("start", F.col("before") + F.col("inside"))
        .drop("before", "inside", "bucket")
    )


def mix_sources(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
    weights=WEIGHTS, total: float = 1.5, seed: int = 7, block: int = BLOCK, shard: int = SHARD,
) -> DataFrame:
    """One row per document: (key, mark, size, source, source_size, target, start, taken,
    first_shard, takes).

    ``takes`` lists what the mix takes of the document: (copy, from_word, to_word), words counted
    from 0, copy 0 or 1. ``taken`` adds the words up. Per source ``taken`` adds up to the target, rounded to a word; no block
    is taken more than twice. Null or empty texts have no words and take nothing, null
    sources are a source of their own, rows that repeat are documents of their own, and
    an empty table gives no rows. All draws hash the seed, so reruns agree.
    """
    sizes = measured(docs, key, text, source)
    targets = materialise(slot_counts(source_targets(sizes, weights, total), seed, block), "targets")
    drawn = (  # a block is taken twice at most
        drawn_blocks(targets, seed, block, shard)
        .groupBy("no", "block")
        .agg(F.sort_array(F.collect_list("words"), asc=False).alias("lengths"), F.min("shard").alias("shard"))
    )
    spread = materialise(packed(sizes, targets.select("no", "source", "source_size", "target")), "packed")
    pieces = spread.where("size > 0").withColumn(
        "block",
        F.explode(
            F.sequence(
                F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
            )
        ),
    )
    from_word = F.greatest(F.col("block") * block - F.col("start"), F.lit(0))
    to_word = F.least(F.col("block") * block + F.col("words") - F.col("start"), F.col("size"))
    found = (
        pieces.join(drawn, ["no", "block"])
        .select("*", F.posexplode("lengths").alias("copy", "words"))
        .select("no", "start", "copy", from_word.alias("from_word"), to_word.alias("to_word"), "shard")
        .where("to_word > from_word")
        .groupBy("no", "start")
        .agg(
            F.sum(F.col("to_word") - F.col("from_word")).alias("taken"),
            F.min("shard").alias("first_shard"),
            F.sort_array(F.collect_list(F.struct("copy", "from_word", "to_word"))).alias("takes"),
        )
    )
    # a document with words is the only one with words that starts where it starts
    words, none = spread.where("size > 0"), spread.where("size = 0")
    out = words.join(found, ["no", "start"], "left").unionByName(none, allowMissingColumns=True)
    return out.select(
        "key", "mark", "size", "source", "source_size", "target", "start",
        F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_shard", "takes",
    )


def mixed_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
                    **options) -> DataFrame:
    """``docs`` as the mix takes them, with the same columns: a document the mix takes nothing
    of goes, one whose words are taken twice comes twice, and one of which only some blocks
    are taken keeps the words of those, joined by single spaces. A copy that takes all
    words keeps its text as it is. Rows that repeat key, text and source get the same blocks.
    """
    copy, mark, words = free_names(docs, "copy_no", "text_mark", "copy_words")
    takes = (
        mix_sources(docs, key, text, source, **options)
        .where("taken > 0")
        .groupBy(F.col("key").alias("its_key"), F.col("mark").alias("its_mark"), F.col("source").alias("its_source"))
        .agg(F.min_by("size", "start").alias("its_size"), F.min_by("takes", "start").alias("its_takes"))
    )
    renamed = free_names(docs, *takes.columns)
    takes = takes.toDF(*renamed)
    its_key, its_mark, its_source, its_size, its_takes = renamed
    tagged = docs.withColumn(mark, F.xxhash64(whole(F.col(text))))
    joined = tagged.join(
        takes,
        (tagged[mark] == takes[its_mark]) & tagged[key].eqNullSafe(takes[its_key])
        & tagged[source].eqNullSafe(takes[its_source]),
    ).withColumn(copy, F.explode(F.array_distinct(F.transform(its_takes, lambda t: t["copy"]))))
    spans = F.filter(its_takes, lambda t: t["copy"] == F.col(copy))
    n_words = F.aggregate(spans, F.lit(0).cast("long"), lambda n, t: n + t["to_word"] - t["from_word"])
    parts = F.regexp_extract_all(F.col(text), F.lit(f"({WORD})"), F.lit(1))
    cut = F.array_join(
        F.flatten(
            F.transform(
                spans,
                lambda t: F.slice(
                    parts, (t["from_word"] + 1).cast("int"), (t["to_word"] - t["from_word"]).cast("int")
                ),
            )
        ),
        " ",
    )
    return joined.withColumn(words, n_words).withColumn(
        text, F.when(F.col(words) == F.col(its_size), F.col(text)).otherwise(cut)
    ).select(*[F.col(f"`{c}`") for c in docs.columns])
