"""Replace four-digit codes in text values by numbered places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from foldcast.operators.columns import quoted

CODE = "[0-9]{4}"  # fixed value
CODE_SPACE = 10_000
PLACE = "Place"


def code_index(df: DataFrame, column: str, salt: str) -> DataFrame:
    """(code, idx): the distinct codes in the whole column, numbered in salted hash
    order so that the number tells nothing about the code. There are at most ten
    thousand codes, so the numbering is one small task."""
    codes = df.select(F.explode(F.regexp_extract_all(quoted(column), F.lit(CODE), F.lit(0))).alias("code"))
    order = Window.orderBy(F.sha2(F.concat("code", F.lit(salt)), 256))
    return codes.distinct().select("code", (F.row_number().over(order) - 1).alias("idx"))


def _lookup(index: DataFrame) -> Column:
    # Bounded by the code space; one array literal addressed by the code itself.
    known = {int(r.code): r.idx for r in index.collect()}
    text = ",".join(str(known.get(code, "")) for code in range(CODE_SPACE))
    return F.split(F.lit(text), ",")


def replace_codes(value: Column, places: Column) -> Column:
    """Every code in the text replaced; the text around the codes is unchanged."""
    between = F.split(value, CODE, -1)
    codes = F.regexp_extract_all(value, F.lit(CODE), F.lit(0))
    pieces = F.zip_with(
        between,
        codes,
        lambda text, code: F.concat(
            text,
            F.when(
                code.isNotNull(),
                F.concat(F.lit(PLACE), F.element_at(places, code.cast("int") + 1)),
            ).otherwise(""),
        ),
    )
    return F.when(value.rlike(CODE), F.array_join(pieces, "")).otherwise(value)


def pseudonymise_values(
    df: DataFrame, column: str, salt: str, index: DataFrame | None = None
) -> DataFrame:
    """Replace all codes in a text column. Equal codes get equal places."""
    places = _lookup(code_index(df, column, salt) if index is None else index)
    return df.select(
        *[
            replace_codes(quoted(c), places).alias(c) if c == column else quoted(c)
            for c in df.columns
        ]
    )
