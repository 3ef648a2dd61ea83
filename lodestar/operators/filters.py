"""Catalogue filters: static predicates for one request, column predicates for many.

For one request everything is a literal, so Spark pushes what it can into the scan. For a table
of requests the same rules read the request's columns, which :func:`parse_filters` prepares.
Predicates are SQL text, see ``functions.common``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql.types import ArrayType, StructType

from lodestar.functions.common import let, literal
from lodestar.functions.dates import NO_DATE, is_no_date, partial_date
from lodestar.functions.spatial import RELATIONS, box_relation, parse_bbox
from lodestar.schemas import FILTER_FIELDS

RINGS = "coordinates.coordinates"


def field_values(schema: StructType, path: str) -> str:
    """All texts under ``path`` as one array, whatever mix of structs and arrays leads there."""
    node, depth = schema, 0
    for part in path.split("."):
        while isinstance(node, ArrayType):
            node, depth = node.elementType, depth + 1
        node = node[part].dataType
    while isinstance(node, ArrayType):
        node, depth = node.elementType, depth + 1
    if depth == 0:
        return f"array({path})"
    return f"flatten({path})" if depth == 2 else path


def like_pattern(value: str) -> str:
    """A wildcard value as a LIKE pattern: ``*`` and ``?`` stay wildcards, the rest is literal."""
    out = value.lower()
    for ch in ("\\", "%", "_"):
        out = out.replace(ch, "\\" + ch)
    return "%" + out.replace("*", "%").replace("?", "_") + "%"


def split_values(values: str | None) -> list[str]:
    return [v.strip() for v in (values or "").split(",") if v.strip()]


def wildcard(schema: StructType, paths: list[str], values: str | None) -> str:
    """Any value is a case-insensitive substring of any element of any field; no values = no filter."""
    wanted = split_values(values)
    if not wanted:
        return "true"
    tests = [
        f"lower(el) LIKE {literal(like_pattern(v))}" if any(c in v for c in "*?")
        else f"contains(lower(el), {literal(v.lower())})"
        for v in wanted
    ]
    hit = " OR ".join(tests)
    return "(" + " OR ".join(f"coalesce(exists({field_values(schema, p)}, el -> {hit}), false)" for p in paths) + ")"


def _check_date(text: str) -> None:
    for layout in ("%Y-%m-%d", "%Y-%m", "%Y"):
        try:
            dt.datetime.strptime(text.strip()[:10], layout)
            return
        except ValueError:
            continue
    raise ValueError(f"unreadable date {text!r}")


def begin_filter(start: str | None) -> str:
    if not start or start.strip().lower() in NO_DATE:
        return "true"
    _check_date(start)
    return f"begin_date >= {partial_date(literal(start), 'first')}"


def end_filter(end: str | None, today: dt.date | None = None) -> str:
    if not end:
        return "true"
    if end.strip().lower() in NO_DATE:
        return "end_date IS NULL"
    if end.strip().lower() != "present":
        _check_date(end)
    return f"end_date <= {partial_date(literal(end), 'last', today)}"


def bbox_filter(bbox: str | None, relation: str | None = None) -> str:
    """The exact test, behind plain comparisons of the bounding box that reach the Parquet scan."""
    if not bbox:
        return "true"
    west, south, east, north = query = parse_bbox(bbox)
    relation = relation or "intersects"
    exact = box_relation(RINGS, query, relation)
    near = {
        "intersects": f"xmin <= {east!r}D AND xmax >= {west!r}D AND ymin <= {north!r}D AND ymax >= {south!r}D",
        "within": f"xmin >= {west!r}D AND xmax <= {east!r}D AND ymin >= {south!r}D AND ymax <= {north!r}D",
        "contains": f"xmin <= {west!r}D AND xmax >= {east!r}D AND ymin <= {south!r}D AND ymax >= {north!r}D",
    }.get(relation)
    return exact if near is None or west > east else f"{near} AND {exact}"


def predicate(schema: StructType, request: dict, today: dt.date | None = None) -> str:
    """The conjunction of all filters of one request (missing or empty = no filter)."""
    clauses = [
        wildcard(schema, paths, request.get(name)) for name, paths in FILTER_FIELDS.items() if request.get(name)
    ]
    clauses += [
        begin_filter(request.get("begin")),
        end_filter(request.get("end"), today),
        bbox_filter(request.get("bbox"), request.get("relation")),
    ]
    return " AND ".join(clauses)


# --- many requests -----------------------------------------------------------------------------

FILTER_COLUMNS = tuple(f"f_{n}" for n in FILTER_FIELDS) + ("f_begin", "f_end", "f_end_missing", "f_box", "f_relation")


def _parsed_values(text: str) -> str:
    """Comma list -> lower-cased, trimmed, non-empty values; absent or all blank -> null."""
    values = f"filter(transform(split(lower({text}), ','), v -> trim(v)), v -> v <> '')"
    return let("vs", values, "CASE WHEN size(vs) > 0 THEN array_sort(array_distinct(vs)) END")


def parse_filters(today: dt.date | None = None) -> dict[str, str]:
    """Expressions over the request columns for :data:`FILTER_COLUMNS`, plus ``reject``.

    ``reject`` is a reason why the request cannot run, or null.
    """
    begin, end, relation = "nullif(`begin`, '')", "nullif(`end`, '')", "coalesce(nullif(relation, ''), 'intersects')"
    box = "transform(filter(split(nullif(bbox, ''), ','), v -> trim(v) <> ''), v -> try_cast(trim(v) AS double))"
    first, last = partial_date(begin, "first"), partial_date(end, "last", today)
    out = {f"f_{n}": _parsed_values(f"`{n}`") for n in FILTER_FIELDS}
    out["f_begin"] = f"CASE WHEN NOT {is_no_date(begin)} THEN {first} END"
    out["f_end"] = f"CASE WHEN NOT {is_no_date(end)} THEN {last} END"
    out["f_end_missing"] = f"coalesce({is_no_date(end)}, false)"
    out["f_box"] = box
    out["f_relation"] = f"CASE WHEN nullif(bbox, '') IS NOT NULL THEN {relation} END"
    known = ", ".join(f"'{r}'" for r in RELATIONS)
    bad_box = (
        "CASE WHEN size(box_) <> 4 THEN 'bbox needs west, south, east, north' "
        "WHEN exists(box_, v -> v IS NULL) THEN 'bbox must be comma-separated numbers' "
        "WHEN exists(array(box_[0], box_[2]), v -> abs(v) > 180) THEN 'bbox longitudes must lie in [-180, 180]' "
        "WHEN exists(array(box_[1], box_[3]), v -> abs(v) > 90) THEN 'bbox latitudes must lie in [-90, 90]' "
        "WHEN box_[1] > box_[3] THEN 'bbox south lies above north' "
        f"WHEN {relation} NOT IN ({known}) THEN 'unsupported relation' END"
    )
    bad_date = (
        f"CASE WHEN (NOT {is_no_date(begin)} AND {first} IS NULL) OR (NOT {is_no_date(end)} AND {last} IS NULL) "
        "THEN 'unreadable date' END"
    )
    out["reject"] = f"coalesce(CASE WHEN nullif(bbox, '') IS NOT NULL THEN {let('box_', box, bad_box)} END, {bad_date})"
    return out


def _wildcard_columns(schema: StructType, paths: list[str], values: str) -> str:
    escaped = f"regexp_replace(value_, {literal('([' + chr(92) * 2 + '%_])')}, {literal(chr(92) * 2 + '$1')})"
    pattern = f"concat('%', translate({escaped}, '*?', '%_'), '%')"
    matches = f"CASE WHEN value_ RLIKE '[*?]' THEN lower(element_) LIKE {pattern} ELSE contains(lower(element_), value_) END"
    texts = [field_values(schema, p) for p in paths]
    every = f"concat({', '.join(texts)})" if len(texts) > 1 else texts[0]
    return f"exists({values}, value_ -> coalesce(exists({every}, element_ -> {matches}), false))"


def batch_predicate(catalogue_schema: StructType) -> str:
    """The filters of a row that holds catalogue columns next to parsed request columns."""
    clauses = [
        f"(f_{name} IS NULL OR {_wildcard_columns(catalogue_schema, paths, 'f_' + name)})"
        for name, paths in FILTER_FIELDS.items()
    ]
    query = [f"get(f_box, {i})" for i in range(4)]
    clauses += [
        "(f_begin IS NULL OR coalesce(begin_date >= f_begin, false))",
        "(f_end IS NULL OR coalesce(end_date <= f_end, false))",
        "(NOT f_end_missing OR end_date IS NULL)",
        f"(f_box IS NULL OR {box_relation(RINGS, query, 'f_relation', fixed=False)})",
    ]
    return " AND ".join(clauses)
