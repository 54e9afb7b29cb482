"""Best-fit packing of documents into sequences of a fixed length by a grouping genetic algorithm.

Pieces of documents are dealt into groups of a bounded number. For each group several islands, each a
row of a Spark table, breed packings of the same pieces: a child takes whole well-filled sequences of one
parent, loses the sequences of the other that hold any of their pieces, and best-fits what
those leave over. Between epochs each island sends its best packing to the next one. Sequences that
stay poorly filled are taken apart, their pieces are dealt into new groups across the
old ones, and bred again.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldcast.llm.common import discard_tables, whole
from foldcast.llm.encoding import in_slices, word_end_coder
from foldcast.session import materialise

#: A group is closed once it has this many pieces, and ids for this many sequences.
GROUP, GROUP_SEQUENCES = 4096, 16
#: Islands of a group, packings of an island.
ISLANDS, POPULATION = 3, 6
#: Children of an island in an epoch, and epochs between which the best packings move on.
CHILDREN, EPOCHS = 12, 2
#: Rounds in which poorly filled sequences are dealt anew; those with less free space than this
#: share of a sequence are left as they are.
ROUNDS, WELL_FILLED = 4, 1 / 256

_PIECE = "piece int, start long, length int, crc long"


def document_pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "word_bpe_49k.json",
                    end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """(key, piece, start, length, crc): every document's ids, ``end_id`` behind them, cut into pieces of
    ``capacity`` where longer; ``crc`` is the crc32 of a piece's ids as little-endian unsigned 32-bit numbers.

    Null texts are empty ones: one piece of one id. Rows that repeat come out as often; null keys stay.
    An empty table gives no rows."""

    def cut(batches):
        coder = word_end_coder(tokenizer)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for first, some in in_slices(texts):
                ids, ends = coder.rows(some)
                data = memoryview(np.insert(ids, ends[1:], end_id).astype("<u4").tobytes())
                sizes = np.diff(ends) + 1
                begins = np.cumsum(sizes) - sizes
                n = -(-sizes // capacity)
                of = np.repeat(np.arange(len(some)), n)
                piece = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(sizes[of] - start, capacity)
                at = 4 * (begins[of] + start)
                crc = [zlib.crc32(data[a:b]) for a, b in zip(at.tolist(), (at + 4 * length).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(first + of)), pa.array(piece.astype(np.int32)), pa.array(start),
                        pa.array(length.astype(np.int32)), pa.array(crc, pa.int64()),
                    ],
                    ["key", "piece", "start", "length", "crc"],
                )

    table = docs.select(F.col(key).alias("key"), whole(F.col(text)).alias("text"))
    return table.mapInArrow(cut, f"key {table.schema['key'].dataType.simpleString()}, {_PIECE}")


def best_fit(sizes: np.ndarray, items: np.ndarray, bins: np.ndarray, free: list[int], capacity: int) -> None:
    """Put ``items``, in their order, each into the fullest bin that has room, or a new one.
    ``free`` holds the free space of each bin; it and ``bins`` are brought up to date."""
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for number, room in enumerate(free):
        rooms[room].append(number)
        mask |= 1 << room
    for item, size in zip(items.tolist(), sizes[items].tolist()):
        fitting = mask >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            number = rooms[room].pop()
            if not rooms[room]:
                mask ^= 1 << room
        else:
            number, room = len(free), capacity
            free.append(capacity)
        free[number] = room = room - size
        rooms[room].append(number)
        mask |= 1 << room
        bins[item] = number


def repacked(sizes: np.ndarray, bins: np.ndarray, loose: np.ndarray, capacity: int, order: np.ndarray) -> np.ndarray:
    """``bins`` without the pieces marked ``loose``, which are best-fitted anew, largest by ``order`` first."""
    out = np.full(len(sizes), -1, np.int32)
    held = np.flatnonzero(~loose)
    _, out[held] = np.unique(bins[held], return_inverse=True)
    free = (capacity - np.bincount(out[held], weights=sizes[held]).astype(np.int64)).tolist() if len(held) else []
    items = np.flatnonzero(loose)
    best_fit(sizes, items[np.argsort(-order[items], kind="stable")], out, free, capacity)
    return out


def fitness(sizes: np.ndarray, bins: np.ndarray, capacity: int) -> tuple[int, float]:
    """Sequences (fewer is better), then the mean square of how full they are (more is better)."""
    fill = np.bincount(bins, weights=sizes)
    return -len(fill), float(np.mean((fill / capacity) ** 2))


def first_packings(sizes: np.ndarray, capacity: int, n: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Best-fit decreasing, and the same with sizes blurred by up to a fifth; none after one that
    needs no more sequences than the sum of all sizes."""
    all_, none = np.ones(len(sizes), bool), np.zeros(len(sizes), np.int32)
    out: list[np.ndarray] = []
    for k in range(n):
        out.append(repacked(sizes, none, all_, capacity, sizes * (1 + 0.2 * k / n * rng.random(len(sizes)))))
        if int(out[-1].max()) < -(-int(sizes.sum()) // capacity):
            break
    return out


def child(sizes: np.ndarray, giver: np.ndarray, taker: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Crossover: some of the giver's well-filled sequences go into the taker whole. The taker's sequences
    that hold any of their pieces go, as do a few of its emptiest ones (mutation), and
    the pieces without a place are best-fitted."""
    fill = np.bincount(giver, weights=sizes)
    well = np.flatnonzero(fill >= np.median(fill))
    injected = np.zeros(len(fill), bool)
    injected[well[rng.random(len(well)) < rng.uniform(0.2, 0.8)]] = True
    given = injected[giver]
    hit = np.zeros(int(taker.max()) + 1, bool)
    hit[taker[given]] = True
    room = np.bincount(taker, weights=sizes)
    emptiest = np.argsort(room)[: 1 + int(rng.integers(1 + len(room) // 16))]
    hit[emptiest] = True
    loose = hit[taker] & ~given
    joined = np.where(given, giver + len(hit), taker)
    return repacked(sizes, joined, loose, capacity, sizes * (1 + 0.05 * rng.random(len(sizes))))


def bred(sizes: np.ndarray, population: list[np.ndarray], capacity: int, children: int,
         rng: np.random.Generator) -> list[np.ndarray]:
    """The population after ``children`` crossovers, best first; a child takes the place of the worst
    packing if it is better. Ends early when a packing needs no more sequences than the sum of all sizes."""
    least = -(-int(sizes.sum()) // capacity)
    ranked = sorted(((fitness(sizes, p, capacity), n, p) for n, p in enumerate(population)), reverse=True)
    for n in range(children if len(ranked) > 1 else 0):
        if -ranked[0][0][0] <= least:
            break
        a, b = sorted(rng.choice(len(ranked), 2, replace=False))
        giver, taker = (a, b) if n % 2 else (b, a)
        new = child(sizes, ranked[giver][2], ranked[taker][2], capacity, rng)
        entry = (fitness(sizes, new, capacity), len(population) + n, new)
        if entry > ranked[-1] and all(entry[0] != r[0] for r in ranked):
            ranked = sorted([*ranked[:-1], entry], reverse=True)
    return [p for _, _, p in ranked]


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values))


def _groups(pieces: DataFrame, group_size: int, least_ids: int) -> DataFrame:
    """(grp, item array<struct<key, piece, start, length, crc>>): pieces dealt evenly to tasks, which cut what
    they get into groups. A group has ``group_size`` pieces, more only while it has fewer than
    ``least_ids`` ids; the last one of a task may be smaller."""
    kind = pieces.schema

    def cut(batches):
        number, held = 0, []

        def row(items: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal number
            number += 1
            column = pa.StructArray.from_arrays(items.columns, names=items.schema.names)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([(TaskContext.get().partitionId() << 24) + number - 1], pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, len(items)], pa.int32()), column),
                ],
                ["grp", "item"],
            )

        for batch in batches:
            held.append(batch)
            while sum(map(len, held)) >= group_size:
                table = pa.Table.from_batches(held).combine_chunks()
                ids = np.cumsum(table["length"].to_numpy().astype(np.int64))
                end = max(group_size, int(np.searchsorted(ids, least_ids)) + 1)
                if end > len(table):
                    held = table.to_batches()
                    break
                yield row(table.slice(0, end).combine_chunks().to_batches()[0])
                held = table.slice(end).to_batches()
        if sum(map(len, held)):
            yield row(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    fields = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in kind)
    n, ids = pieces.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    tasks = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pieces.repartition(max(1, min(tasks, -(-n // group_size), ids // least_ids if least_ids else tasks)))
    return dealt.mapInArrow(cut, f"grp long, item array<struct<{fields}>>")


def _evolved(islands: DataFrame, capacity: int, children: int, epoch: int, seed: int) -> DataFrame:
    """One epoch on every island. A row's packings may be none, then they are made; a packing that came
    from another island stands last among them."""

    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                grp, island = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                sizes = batch.column(2)[i].values.to_numpy()
                held = batch.column(3)[i].values
                population = [held[k].values.to_numpy() for k in range(len(held))]
                rng = np.random.default_rng([seed, epoch, grp, island])
                if not population:
                    population = first_packings(sizes, capacity, POPULATION, rng)
                out = bred(sizes, population, capacity, children, rng)[:POPULATION]
                lists = _lists(np.concatenate(out).astype(np.int32), np.full(len(out), len(sizes)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), batch.column(2).slice(i, 1),
                        pa.ListArray.from_arrays(pa.array([0, len(out)], pa.int32()), lists),
                        pa.array([int(out[0].max()) + 1], pa.int32()),
                        pa.array([fitness(sizes, out[0], capacity)[1]]),
                    ],
                    ["grp", "island", "size", "packings", "n", "filled"],
                )

    return islands.select("grp", "island", "size", "packings").mapInArrow(
        run, "grp long, island int, size array<int>, packings array<array<int>>, n int, filled double"
    )


def _best_packings(groups: DataFrame, capacity: int, islands: int, children: int, epochs: int, seed: int) -> DataFrame:
    """(grp, bins): the best packing that the islands of each group have found."""
    state = groups.select(
        "grp", F.explode(F.array(*map(F.lit, range(islands)))).alias("island"),
        F.col("item.length").alias("size"), F.array().cast("array<array<int>>").alias("packings"),
    ).repartition("grp", "island")
    tables = []
    for epoch in range(epochs):
        tables.append(materialise(_evolved(state, capacity, children, epoch, seed), "islands"))
        elites = tables[-1].select(
            "grp", ((F.col("island") + 1) % islands).alias("island"), F.slice("packings", 1, 1).alias("elite")
        )
        state = tables[-1].join(elites.hint("shuffle_hash"), ["grp", "island"]).withColumn(
            "packings", F.concat("packings", "elite")
        )
    last = tables[-1].select("grp", "n", "filled", F.col("packings")[0].alias("bins"))
    best = materialise(
        last.groupBy("grp").agg(F.min_by("bins", F.struct("n", -F.col("filled"))).alias("bins")), "packed"
    )
    discard_tables(*tables)
    return best


def _placed(packed: DataFrame, capacity: int, spare: int, round_no: int) -> DataFrame:
    """A row per piece: (key, piece, start, length, crc, sequence_id, offset, free), ``free`` being what its
    sequence has left, and ``poor`` where that is more than ``spare``."""
    kind = packed.schema["item"].dataType.elementType

    def unpacked(batches):
        for batch in batches:
            for i in range(len(batch)):
                grp = batch.column(0)[i].as_py()
                items = batch.column(1)[i].values
                bins = batch.column(2)[i].values.to_numpy()
                sizes = items.field("length").to_numpy().astype(np.int64)
                order = np.argsort(bins, kind="stable")
                run = np.cumsum(sizes[order]) - sizes[order]
                new = np.concatenate([[True], np.diff(bins[order]) > 0])
                offset = run - np.repeat(run[new], np.diff(np.append(np.flatnonzero(new), len(bins))))
                free = capacity - np.bincount(bins, weights=sizes).astype(np.int64)[bins[order]]
                number = (((round_no << 44) + grp) << 13) + bins[order].astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*items.take(pa.array(order)).flatten(), pa.array(number), pa.array(offset), pa.array(free > spare)],
                    [*kind.fieldNames(), "sequence_id", "offset", "poor"],
                )

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kind)
    return packed.select("grp", "item", "bins").mapInArrow(
        unpacked, f"{fields}, sequence_id long, offset long, poor boolean"
    )


def pack_pieces(pieces: DataFrame, capacity: int = 2048, group_size: int = GROUP, islands: int = ISLANDS,
                children: int = CHILDREN, epochs: int = EPOCHS, rounds: int = ROUNDS, seed: int = 11) -> DataFrame:
    """``pieces`` with (sequence_id, offset): which sequence each lies in, and where. Every piece of ``pieces``
    (columns as ``document_pieces`` gives them) is placed once, in sequences of at most ``capacity`` ids without gaps.

    Pieces of full length are sequences of their own. Work per piece does not depend on the size of the table: a
    task holds one group at a time. After the last round every sequence stays as it is, also a poor one.
    """
    columns = pieces.columns
    full = pieces.filter(F.col("length") >= capacity).withColumn(
        "sequence_id", -1 - F.monotonically_increasing_id()
    ).withColumn("offset", F.lit(0).cast("long"))
    out, left = [full], pieces.filter(F.col("length") < capacity)
    for round_no in range(rounds):
        groups = materialise(_groups(left, group_size, GROUP_SEQUENCES * capacity), "groups")
        n_groups = groups.count()
        best = _best_packings(groups, capacity, islands, children, epochs, seed + round_no)
        last = round_no == rounds - 1 or n_groups <= 1
        placed = materialise(
            _placed(groups.join(best.hint("shuffle_hash"), "grp"), capacity, int(capacity * WELL_FILLED), round_no),
            "placed",
        )
        discard_tables(groups, best)
        if last:
            out.append(placed.drop("poor"))
            break
        out.append(placed.filter(~F.col("poor")).drop("poor"))
        left = placed.filter("poor").select(columns)
    whole_table = out[0]
    for part in out[1:]:
        whole_table = whole_table.unionByName(part)
    return whole_table


def pack_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "word_bpe_49k.json",
                   end_id: int = 0, capacity: int = 2048, **settings) -> DataFrame:
    """(key, piece, start, length, crc, sequence_id, offset) of every document, packed into as few sequences of
    ``capacity`` ids as the search finds.

    Null texts count as empty ones; rows that repeat, or share a key, are placed each on their own; extra columns
    are not read; an empty table gives no rows.
    """
    pieces = materialise(document_pieces(docs, key, text, tokenizer, end_id, capacity), "pieces")
    return pack_pieces(pieces, capacity, **settings)
