"""Partial dates (YYYY, YYYY-MM, YYYY-MM-DD) and their sentinels."""

from __future__ import annotations

import datetime as dt

from lodestar.functions.common import literals

# Texts that stand for "no date" and for "today".
PRESENT = "Present"
NOT_AVAILABLE = "Not Available; Indisponible"
NO_DATE = ("null", "not available; indisponible")


def is_no_date(text: str) -> str:
    return f"lower(trim({text})) IN ({literals(NO_DATE)})"


def partial_date(text: str, edge: str, today: dt.date | None = None) -> str:
    """First or last day that a partial date covers; unreadable text gives null.

    ``edge`` is ``"first"`` or ``"last"``; ``present`` becomes ``today`` when that is given.
    """
    if edge not in ("first", "last"):
        raise ValueError(f"edge must be 'first' or 'last', got {edge!r}")
    s = f"trim({text})"
    year_end = "-01-01" if edge == "first" else "-12-31"
    month = f"try_to_date(concat({s}, '-01'), 'yyyy-MM-dd')"
    month = month if edge == "first" else f"last_day({month})"
    present = "" if today is None else f"WHEN lower({s}) = 'present' THEN DATE'{today.isoformat()}' "
    return (
        f"CASE {present}WHEN {s} RLIKE '^[0-9]{{4}}$' THEN try_to_date(concat({s}, '{year_end}'), 'yyyy-MM-dd') "
        f"WHEN {s} RLIKE '^[0-9]{{4}}-[0-9]{{2}}$' THEN {month} "
        f"WHEN {s} RLIKE '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}' THEN try_to_date(substring({s}, 1, 10), 'yyyy-MM-dd') END"
    )
