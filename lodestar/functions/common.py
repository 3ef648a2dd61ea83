"""Building blocks of SQL expressions.

The functions of this package take and return SQL text. Text is joined in Python and parsed once by
Spark, where the same expression put together column by column costs a call into the JVM per node.
"""

from __future__ import annotations

NO_STRINGS = "CAST(array() AS array<string>)"


def literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def literals(texts) -> str:
    return ", ".join(literal(t) for t in texts)


def let(name: str, value: str, body: str) -> str:
    """Evaluate ``value`` once and use it as ``name`` inside ``body``.

    A lambda variable hides a column of the same name, so a ``body`` that contains SQL of the caller
    uses names ending in an underscore.
    """
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def run_lengths(values: str, key: str = "term", count: str = "tf") -> str:
    """Distinct elements of an array with their number of occurrences, without a shuffle.

    Sort, keep the positions where a run starts, and subtract neighbouring positions.
    """
    starts = "filter(sequence(0, size(srt) - 1), pos -> pos = 0 OR get(srt, pos) <> get(srt, pos - 1))"
    counted = (
        f"zip_with(st, concat(slice(st, 2, size(st)), array(size(srt))), "
        f"(a, b) -> named_struct('{key}', get(srt, a), '{count}', b - a))"
    )
    return let("srt", f"sort_array({values})", f"CASE WHEN size(srt) > 0 THEN {let('st', starts, counted)} END")
