"""Token ids as files of compressed byte or bit planes.

A written set is a folder with three tables: ``chunks`` (a block of ids per row: its planes,
each compressed with zstandard, and the documents it holds), ``index`` (a row per chunk:
where it lies, how many ids and bytes it has, and the checksum of its ids), and ``parts``.
Ids run in ascending order of document within a part and over the parts. Spark
writes and reads the tables, so a set can lie in any store that Spark reaches.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldcast.llm.common import whole
from foldcast.llm.encoding import byte_level_coder, in_slices

#: Ids of a chunk; the last chunk of a part may be shorter.
CHUNK = 1 << 16

_CHUNKS = (
    "part int, chunk int, first_id long, n_ids int, planes array<binary>, n_bytes long, crc long, "
    "doc_id array<long>, doc_row array<long>, doc_first array<long>, doc_n array<int>"
)


def planes(ids: np.ndarray, unit: str, level: int = 1) -> list[bytes]:
    """The ids' byte planes (lowest byte of each id, next byte, ...) or bit planes, compressed."""
    import zstandard

    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if unit == "byte":
        rows = [np.ascontiguousarray(raw[:, k]) for k in range(4)]
    elif unit == "bit":
        bits = np.unpackbits(raw, axis=1, bitorder="little")
        rows = [np.packbits(bits[:, k]) for k in range(32)]
    else:
        raise ValueError("unit is 'byte' or 'bit'")
    packer = zstandard.ZstdCompressor(level=level)
    return [packer.compress(row.tobytes()) for row in rows]


def ids_of(packed: list[bytes], n: int) -> np.ndarray:
    """The ``n`` ids of a chunk, from 4 byte planes or 32 bit planes."""
    import zstandard

    reader = zstandard.ZstdDecompressor()
    rows = [np.frombuffer(reader.decompress(p), np.uint8) for p in packed]
    if len(rows) == 4:
        return np.stack(rows, axis=1).reshape(-1).view("<u4")
    bits = np.stack([np.unpackbits(row, count=n) for row in rows], axis=1)
    return np.packbits(bits, axis=1, bitorder="little").reshape(-1).view("<u4")


def write_ids(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text",
              tokenizer: str = "byte_bpe_50k.json", end_id: int = 2, unit: str = "byte", chunk: int = CHUNK) -> None:
    """Encode all texts, each followed by ``end_id``, and write them to ``path`` in ascending order
    of ``key`` (null first; rows that repeat a key in order of their texts).

    Null texts are empty ones: their only id is ``end_id``. An empty table writes empty
    tables. Keys are stored as long integers. No task holds more than a batch of texts and a chunk of ids.
    """

    def encoded(batches):
        part, first, number, row = TaskContext.get().partitionId(), 0, 0, 0
        held: list[np.ndarray] = []  # ids not written yet
        n_held = 0
        open_docs: list[tuple] = []  # documents with ids in the next chunk

        def block(ids: np.ndarray) -> pa.RecordBatch:
            nonlocal first, number, open_docs
            last = first + len(ids)
            here = [d for d in open_docs if d[2] < last]
            open_docs = [d for d in open_docs if d[2] + d[3] > last]
            rows = planes(ids, unit)
            out = {
                "part": [part], "chunk": [number], "first_id": [first], "n_ids": [len(ids)], "planes": [rows],
                "n_bytes": [sum(map(len, rows))], "crc": [zlib.crc32(ids.astype("<u4").tobytes())],
                "doc_id": [[d[0] for d in here]], "doc_row": [[d[1] for d in here]],
                "doc_first": [[d[2] for d in here]], "doc_n": [[d[3] for d in here]],
            }
            first, number = last, number + 1
            return pa.RecordBatch.from_pydict(out, schema=_schema())

        at = 0
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for start, some in in_slices(texts):
                ids, ends = byte_level_coder(tokenizer).rows(some)
                held.append(np.insert(ids, ends[1:], end_id))
                n_held += len(held[-1])
                for k, n in zip(keys[start : start + len(some)], (np.diff(ends) + 1).tolist()):
                    open_docs.append((k, row, at, n))
                    at, row = at + n, row + 1
                if n_held >= chunk:
                    ids = np.concatenate(held)
                    full = len(ids) // chunk * chunk
                    for a in range(0, full, chunk):
                        yield block(ids[a : a + chunk])
                    held, n_held = [ids[full:]], len(ids) - full
        if n_held:
            yield block(np.concatenate(held))

    ordered = (
        docs.select(F.col(key).cast("long").alias("key"), whole(F.col(text)).alias("text"))
        .repartitionByRange("key")
        .sortWithinPartitions("key", "text")
    )
    ordered.mapInArrow(encoded, _CHUNKS).write.parquet(f"{path}/chunks")
    spark = docs.sparkSession
    index = spark.read.schema(_CHUNKS).parquet(f"{path}/chunks").select(
        "part", "chunk", "first_id", "n_ids", "n_bytes", "crc"
    )
    index.coalesce(1).write.parquet(f"{path}/index")
    earlier = Window.partitionBy(F.lit(1)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    stored = spark.read.schema("part int, chunk int, first_id long, n_ids int, n_bytes long, crc long")
    stored.parquet(f"{path}/index").groupBy("part").agg(F.sum("n_ids").alias("n_ids")).withColumn(
        "start", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0))
    ).write.parquet(f"{path}/parts")


def _schema() -> pa.Schema:
    ids, n = pa.list_(pa.int64()), pa.list_(pa.int32())
    return pa.schema([
        ("part", pa.int32()), ("chunk", pa.int32()), ("first_id", pa.int64()), ("n_ids", pa.int32()),
        ("planes", pa.list_(pa.binary())), ("n_bytes", pa.int64()), ("crc", pa.int64()),
        ("doc_id", ids), ("doc_row", ids), ("doc_first", ids), ("doc_n", n),
    ])


def crc32_joined(first: int, second: int, n_second: int) -> int:
    """The crc32 of two byte strings one after the other, from that of each and the second's
    length: ``first`` times x^(8 n) plus ``second`` in the polynomials modulo crc32's own,
    whose bits are stored lowest power first."""

    def times(a: int, b: int) -> int:
        out = 0
        for bit in range(31, -1, -1):
            if b >> bit & 1:
                out ^= a
            a = a >> 1 ^ (0xEDB88320 if a & 1 else 0)
        return out

    shift, power = 1 << 31, 1 << 23  # 1 and x^8
    while n_second:
        if n_second & 1:
            shift = times(shift, power)
        power, n_second = times(power, power), n_second >> 1
    return times(first, shift) ^ second


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Every document's stretch of every chunk: (part, doc_row, doc_id, doc_first, doc_n, at, ids),
    ids being the numbers from ``at`` on in the part's stream. Chunks are read alone, in any order;
    one whose ids do not meet the checksum raises."""

    def decoded(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = ids_of(row["planes"], row["n_ids"])
                if zlib.crc32(ids.tobytes()) != row["crc"]:
                    raise ValueError(f"chunk {row['chunk']} of part {row['part']} is damaged")
                first = np.array(row["doc_first"], np.int64)
                begin = np.maximum(first, row["first_id"])
                end = np.minimum(first + np.array(row["doc_n"], np.int64), row["first_id"] + len(ids))
                n = len(first)
                offsets = np.concatenate([[0], np.cumsum(end - begin)]).astype(np.int32)
                skip = int(begin[0] - row["first_id"]) if n else 0
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["part"]] * n, pa.int32()), pa.array(row["doc_row"], pa.int64()),
                        pa.array(row["doc_id"], pa.int64()), pa.array(first), pa.array(row["doc_n"], pa.int32()),
                        pa.array(begin),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids[skip : skip + offsets[-1]].astype(np.int64))),
                    ],
                    ["part", "doc_row", "doc_id", "doc_first", "doc_n", "at", "ids"],
                )

    return _chunks(spark, path).mapInArrow(
        decoded, "part int, doc_row long, doc_id long, doc_first long, doc_n int, at long, ids array<long>"
    )


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_CHUNKS).parquet(f"{path}/chunks")


def document_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document of a written set, from its files: (doc_id, start, n_tokens, ids_crc32)."""

    def pieces(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                ids = ids_of(row["planes"], row["n_ids"])
                data = memoryview(ids.tobytes())
                if zlib.crc32(data) != row["crc"]:
                    raise ValueError(f"chunk {row['chunk']} of part {row['part']} is damaged")
                low = row["first_id"]
                for key, number, first, n in zip(row["doc_id"], row["doc_row"], row["doc_first"], row["doc_n"]):
                    a, b = max(first, low), min(first + n, low + len(ids))
                    out.append((row["part"], number, key, first, n, a, b - a, zlib.crc32(data[4 * (a - low) : 4 * (b - low)])))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), [x.type for x in _PIECES])], schema=_PIECES
                )

    def joined(batches):
        for batch in batches:
            crcs = []
            for row in batch.column("pieces").to_pylist():
                head, *tail = sorted(row, key=lambda p: p["at"])
                crc = head["crc"]
                for p in tail:
                    crc = crc32_joined(crc, p["crc"], 4 * p["n"])
                crcs.append(crc)
            columns = [batch.column(c) for c in ("part", "doc_id", "doc_first", "doc_n")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(crcs, pa.int64())], ["part", "doc_id", "doc_first", "doc_n", "ids_crc32"])

    found = _chunks(spark, path).mapInArrow(
        pieces, "part int, doc_row long, doc_id long, doc_first long, doc_n int, at long, n int, crc long"
    )
    per_doc = found.groupBy("part", "doc_row", "doc_id", "doc_first", "doc_n").agg(
        F.collect_list(F.struct("at", "n", "crc")).alias("pieces")
    )
    parts = spark.read.schema("part int, n_ids long, start long").parquet(f"{path}/parts")
    whole_docs = per_doc.mapInArrow(joined, "part int, doc_id long, doc_first long, doc_n int, ids_crc32 long")
    return whole_docs.join(parts.select("part", "start"), "part").select(
        "doc_id", (F.col("start") + F.col("doc_first")).alias("start"),
        F.col("doc_n").cast("long").alias("n_tokens"), "ids_crc32",
    )


_PIECES = pa.schema([
    ("part", pa.int32()), ("doc_row", pa.int64()), ("doc_id", pa.int64()), ("doc_first", pa.int64()),
    ("doc_n", pa.int32()), ("at", pa.int64()), ("n", pa.int32()), ("crc", pa.int64()),
])
