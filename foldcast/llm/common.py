"""Small helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word: a longest stretch without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def tokenizer_path(name: str) -> str:
    """Where the public tokenizer file ``name`` is on this machine. Called where the file
    is opened, in the tasks, so that machines may keep it in different places."""
    import public_tokenizers

    return public_tokenizers.path(name)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that clash with no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def whole(text: Column) -> Column:
    """The text, or the empty text for null."""
    return F.coalesce(text, F.lit(""))


def text_digest(text: Column) -> Column:
    """SHA-256 of a text in UTF-8, as 32 bytes."""
    return F.unhex(F.sha2(whole(text).cast("binary"), 256))


def held_out(key: Column) -> Column:
    """Whether a row is kept from learning: crc32 of the key as text leaves 1 of 3."""
    return F.coalesce(F.crc32(key.cast("string")) % 3 == 1, F.lit(False))


#: Words of 64 bits of a filter of marks.
FILTER_WORDS = 1 << 18


def mark_filter(marks: DataFrame) -> DataFrame:
    """A filter of the 64-bit hashes in column ``mark``: (word, bits), the bits that occur in each
    word. It never has more than ``FILTER_WORDS`` rows, so it can always be broadcast."""
    bit = F.expr(f"shiftleft(1L, int(shiftrightunsigned(mark, {FILTER_WORDS.bit_length() - 1}) & 63))")
    return marks.groupBy(F.pmod("mark", F.lit(FILTER_WORDS)).alias("word")).agg(F.bit_or(bit).alias("bits"))


def by_filter(df: DataFrame, mark: str, stored: DataFrame, how: str) -> DataFrame:
    """Rows of ``df`` that a ``mark_filter`` may hold (``how`` = "left_semi"): all that it holds and some that it does not,
    or the others ("left_anti"), which it holds none of. A plain filter: no row is moved."""
    word, bits = free_names(df, "filter_word", "filter_bits")
    at = F.shiftrightunsigned(df[mark], FILTER_WORDS.bit_length() - 1).bitwiseAND(F.lit(63)).cast("int")
    held = F.call_function("shiftrightunsigned", F.col(bits), at).bitwiseAND(F.lit(1)) == 1
    return df.join(F.broadcast(stored.toDF(word, bits)), (F.pmod(df[mark], F.lit(FILTER_WORDS)) == F.col(word)) & held, how)


def share_below(key: Column, seed: int, share: Column | float) -> Column:
    """True for about this share of the keys, always the same ones."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 30)) < F.lit(share) * float(1 << 30)


def slices(texts: Sequence[str], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of about ``limit`` characters each, of one text at least and 4,000 at most."""
    start = held = 0
    for at, text in enumerate(texts):
        if held and (held + len(text) > limit or at - start == 4000):
            yield start, at
            start, held = at, 0
        held += len(text) + 1
    if start < len(texts):
        yield start, len(texts)


def discard_tables(*tables: DataFrame) -> None:
    """Delete stored tables that no later step reads."""
    for table in tables:
        files = table.inputFiles()
        if files:
            spark = table.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
