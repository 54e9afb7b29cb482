"""Text helpers: weights from text, run names, name patterns."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Feature name prefixes and patterns.
GROUP_PATTERNS: dict[str, str] = {
    "calendar": r"^x_c_",
    "weather": r"^x_w_",
    "vacation": r"^x_v_",
    "event": r"^x_ev_",
    "holiday": r"^x_ho_",
    "lagged": r"[._]l-?\d+$",
    "basic_weather": r"^x_w_(11|21|41|51)_.{4}_l0$",
}
NUMBER = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity|nan))\s*$"


def names_in_groups(
    names: Sequence[str], groups: Sequence[str], explicit: Sequence[str] = ()
) -> list[str]:
    """Explicit names, then the members of the groups, once each, in that order."""
    unknown = [g for g in groups if g not in GROUP_PATTERNS]
    if unknown:
        raise ValueError(f"unknown feature groups: {unknown}")
    chosen = dict.fromkeys(explicit)
    for group in groups:
        pattern = re.compile(GROUP_PATTERNS[group])
        # "_l0" closes the names of basic weather columns, which are not lags.
        chosen.update(
            dict.fromkeys(
                n for n in names
                if pattern.search(n) and not (group == "lagged" and n.startswith("x_w_"))
            )
        )
    return list(chosen)


def weight_map(text: Column) -> Column:
    """``a=1,b=0.5`` to a map of doubles."""
    pairs = F.str_to_map(text, F.lit(","), F.lit("="))
    trimmed = F.transform_keys(pairs, lambda k, _: F.trim(k))
    return F.transform_values(trimmed, lambda _, v: F.trim(v).cast("double"))


def run_name(abbreviations: Mapping[str, str], **settings) -> str:
    """Short name of a run: null values are left out, true flags give the bare
    abbreviation, sequences are joined by ``x`` and the parts by ``_``."""
    parts = []
    for key, short in abbreviations.items():
        value = settings.get(key)
        if value is None or value is False:
            continue
        if value is True:
            parts.append(short)
        elif isinstance(value, (list, tuple, range)):
            parts.append(short + "x".join(map(str, value)))
        else:
            parts.append(f"{short}{value}")
    return "_".join(parts)


def run_name_column(abbreviations: Mapping[str, str]) -> Column:
    """``run_name`` over the columns of a parameter table."""
    return F.concat_ws(
        "_",
        *[
            F.when(F.col(key).isNotNull(), F.concat(F.lit(short), F.col(key).cast("string")))
            for key, short in abbreviations.items()
        ],
    )
