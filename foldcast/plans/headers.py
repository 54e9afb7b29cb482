"""Pseudonyms for column names: from a private column table to a public one."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from foldcast.operators.pseudonymise import PLACE

# The operations a header can ask for.
POSTCODE_INDEXING = "Postcode-Indexing"
REPLACE = "replace"
STATISTICS = ("mean", "std", "min", "max", "cardinality", "nan_values")

_POSTCODE = re.compile(r"(.*)([0-9]{4})(.*)")


@dataclass(frozen=True)
class Header:
    """One column: its original and its public name and description."""

    original: str
    name: str
    description: str | None
    operation: str | None
    statistics: tuple[tuple[str, object], ...] = ()

    @property
    def operations(self) -> list[str]:
        return [p.strip() for p in (self.operation or "").split(",") if p.strip()]


def read_headers(
    rows: Iterable[Mapping[str, object]],
    pick: str = "Pseudonymisation",
    operation: str = "Pseudonymisation_Header_Operation",
) -> list[Header]:
    """Each row says, as a comma list, which two of its own fields hold the name and
    the description."""
    out = []
    for row in rows:
        chosen = [row[field.strip()] for field in str(row[pick]).split(",")]
        out.append(
            Header(
                original=str(chosen[0]),
                name=str(chosen[0]),
                description=None if len(chosen) < 2 or chosen[1] is None else str(chosen[1]),
                operation=row.get(operation) or None,
                statistics=tuple((s, row.get(s)) for s in STATISTICS),
            )
        )
    return out


def with_operation(headers: Sequence[Header], operation: str) -> list[Header]:
    return [h for h in headers if operation in h.operations]


def _renamed(header: Header, name: str) -> Header:
    return Header(header.original, name, header.description, header.operation, header.statistics)


def index_postcodes(headers: Sequence[Header], salt: str) -> list[Header]:
    """The last four digits of each name become a numbered place, numbered in salted
    hash order. Every name must hold one code, and none may be left over."""
    parts = {h.original: _POSTCODE.fullmatch(h.original) for h in headers}
    without = [name for name, match in parts.items() if match is None]
    if without:
        raise ValueError(f"names without a four-digit code: {without}")
    codes = {match[2] for match in parts.values()}
    ranked = sorted(codes, key=lambda c: hashlib.sha256((c + salt).encode()).hexdigest())
    place = {code: f"{PLACE}{i}" for i, code in enumerate(ranked)}
    out = []
    for h in headers:
        before, code, after = parts[h.original].groups()
        name = before + place[code] + after
        if _POSTCODE.fullmatch(name):
            raise ValueError(f"a code is left in {name}")
        out.append(_renamed(h, name))
    return out


def replace_names(headers: Sequence[Header]) -> list[Header]:
    """``replace,<new name>`` gives the new name."""
    return [_renamed(h, h.operations[1]) for h in headers]


def pseudonymise(headers: Sequence[Header], salt: str) -> list[Header]:
    """All headers with their public names; an error if an operation is unknown or a
    header asks for two of them."""
    coded, replaced = with_operation(headers, POSTCODE_INDEXING), with_operation(headers, REPLACE)
    plain = [h for h in headers if not h.operations]
    asked = [h.original for h in [*plain, *coded, *replaced]]
    twice = sorted({n for n in asked if asked.count(n) > 1})
    left = [h.original for h in headers if h.original not in asked]
    if twice or left:
        raise ValueError(f"headers in two operations: {twice}; in none: {left}")
    return [*plain, *index_postcodes(coded, salt), *replace_names(replaced)]


def rename_map(headers: Sequence[Header]) -> dict[str, str]:
    return {h.original: h.name for h in headers}


def public_view(headers: Sequence[Header]) -> list[dict[str, object]]:
    """Public name, description and statistics, without the originals."""
    return [
        {"ColumnName": h.name, "Description": h.description, **dict(h.statistics)}
        for h in headers
    ]
