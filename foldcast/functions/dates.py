"""Day numbers, calendar parts and date text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The day that spreadsheet day numbers count from, and text formats.
EXCEL_EPOCH = "1899-12-30"
INPUT_FORMAT = "dd.MM.yyyy"
DISPLAY_FORMAT = "dd MMM yy"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_excel_day(day: Column | str) -> Column:
    return F.datediff(_col(day).cast("date"), F.lit(EXCEL_EPOCH).cast("date"))


def from_excel_day(number: Column | str) -> Column:
    return F.date_add(F.lit(EXCEL_EPOCH).cast("date"), _col(number).cast("int"))


def parse_day(text: Column | str) -> Column:
    """``dd.mm.yyyy`` to date; text of another form gives null."""
    return F.try_to_timestamp(_col(text), F.lit(INPUT_FORMAT)).cast("date")


def display_day(day: Column | str) -> Column:
    return F.date_format(_col(day), DISPLAY_FORMAT)


def first_of_year(day: Column | str) -> Column:
    return F.make_date(F.year(_col(day)), F.lit(1), F.lit(1))


def day_range(first: Column, last: Column) -> Column:
    """All days from first to last, both included."""
    return F.sequence(first, last)
