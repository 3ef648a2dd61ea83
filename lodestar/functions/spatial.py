"""Planar tests between polygon rings and boxes or other polygons, as SQL text.

A geometry is ``array<ring>``, a ring ``array<array<double>>`` of lon/lat points, first = last.
All shapes are closed sets, so touching counts as intersecting. The cheap bounding-box comparison
always runs first; ring tests run only for rows that it cannot decide.
"""

from __future__ import annotations

from lodestar.functions.common import let

RELATIONS = ("intersects", "disjoint", "within", "contains")
BOX = ("xmin", "ymin", "xmax", "ymax")


def bounds(rings: str) -> dict[str, str]:
    """Bounding box expressions ``xmin, ymin, xmax, ymax``."""
    xs = f"transform(flatten({rings}), pt -> get(pt, 0))"
    ys = f"transform(flatten({rings}), pt -> get(pt, 1))"
    return {"xmin": f"array_min({xs})", "ymin": f"array_min({ys})", "xmax": f"array_max({xs})", "ymax": f"array_max({ys})"}


def edges(rings: str) -> str:
    """All ring edges as ``struct<ax,ay,bx,by>``."""
    pair = "named_struct('ax', get(p1, 0), 'ay', get(p1, 1), 'bx', get(p2, 0), 'by', get(p2, 1))"
    n = "greatest(size(ring) - 1, 0)"
    return f"flatten(transform({rings}, ring -> zip_with(slice(ring, 1, {n}), slice(ring, 2, {n}), (p1, p2) -> {pair})))"


def _side(a: str, px: str, py: str) -> str:
    """Positive left of edge ``a``, negative right of it, zero on its line."""
    return f"(({a}.bx - {a}.ax) * ({py} - {a}.ay) - ({a}.by - {a}.ay) * ({px} - {a}.ax))"


def point_in(ring_edges: str, px: str, py: str) -> str:
    """Even-odd rule over all rings (holes included)."""
    crossing = (
        f"((seg_.ay > {py}) <> (seg_.by > {py})) AND "
        f"{px} < try_divide((seg_.bx - seg_.ax) * ({py} - seg_.ay), seg_.by - seg_.ay) + seg_.ax"
    )
    return f"size(filter({ring_edges}, seg_ -> {crossing})) % 2 = 1"


def _edge_meets_box(g: str, b: str, open_box: bool) -> str:
    """Separating-axis test of a segment against a box (its inside only when ``open_box``)."""
    corners = [(f"{b}.w", f"{b}.s"), (f"{b}.e", f"{b}.s"), (f"{b}.e", f"{b}.n"), (f"{b}.w", f"{b}.n")]
    sides = "array(" + ", ".join(_side(g, x, y) for x, y in corners) + ")"
    lt = "<" if open_box else "<="
    near = (
        f"least({g}.ax, {g}.bx) {lt} {b}.e AND {b}.w {lt} greatest({g}.ax, {g}.bx) AND "
        f"least({g}.ay, {g}.by) {lt} {b}.n AND {b}.s {lt} greatest({g}.ay, {g}.by)"
    )
    return f"({near} AND {let('sides_', sides, f'array_min(sides_) {lt} 0 AND 0 {lt} array_max(sides_)')})"


def _covered(b: str) -> str:
    return f"(xmin >= {b}.w AND xmax <= {b}.e AND ymin >= {b}.s AND ymax <= {b}.n)"


def _intersects(rings: str, b: str) -> str:
    exact = let("edges_", edges(rings), f"exists(edges_, edge_ -> {_edge_meets_box('edge_', b, False)}) OR {point_in('edges_', f'{b}.w', f'{b}.s')}")
    apart = f"xmin > {b}.e OR xmax < {b}.w OR ymin > {b}.n OR ymax < {b}.s"
    return f"CASE WHEN {apart} THEN false WHEN {_covered(b)} THEN true ELSE {exact} END"


def _contains(rings: str, b: str) -> str:
    middle = point_in("edges_", f"({b}.w + {b}.e) / 2", f"({b}.s + {b}.n) / 2")
    inside = let("edges_", edges(rings), f"NOT exists(edges_, edge_ -> {_edge_meets_box('edge_', b, True)}) AND {middle}")
    reaches = f"xmin <= {b}.w AND xmax >= {b}.e AND ymin <= {b}.s AND ymax >= {b}.n"
    return f"CASE WHEN {reaches} THEN {inside} ELSE false END"


def _boxes(w: str, s: str, e: str, n: str) -> str:
    """The query box as one box, or as two when it crosses the antimeridian."""

    def box(west: str, east: str) -> str:
        return f"named_struct('w', {west}, 's', {s}, 'e', {east}, 'n', {n})"

    return f"CASE WHEN {w} > {e} THEN array({box(w, '180D')}, {box('-180D', e)}) ELSE array({box(w, e)}) END"


def box_relation(rings: str, query, relation: str, fixed: bool = True) -> str:
    """Relation of the record geometry to the query box ``(west, south, east, north)``.

    The record's bounding box is read from the columns ``xmin, ymin, xmax, ymax``. Query values may
    be numbers or SQL; with ``fixed=False`` the relation is SQL as well, decided row by row.
    ``west > east`` crosses the antimeridian. A missing geometry fails every relation.
    """
    if fixed and relation not in RELATIONS:
        raise ValueError(f"unsupported relation {relation!r}, expected one of {RELATIONS}")
    query = [x if isinstance(x, str) else f"{float(x)!r}D" for x in query]
    tests = {
        "intersects": f"exists(boxes_, box_ -> {_intersects(rings, 'box_')})",
        "disjoint": f"NOT exists(boxes_, box_ -> {_intersects(rings, 'box_')})",
        "within": f"exists(boxes_, box_ -> {_covered('box_')})",
        "contains": f"forall(boxes_, box_ -> {_contains(rings, 'box_')})",
    }
    if fixed:
        decide = tests[relation]
    else:
        decide = (
            f"CASE {relation} WHEN 'within' THEN {tests['within']} WHEN 'contains' THEN {tests['contains']} "
            f"ELSE {tests['intersects']} <> ({relation} = 'disjoint') END"
        )
    return f"coalesce(xmin IS NOT NULL AND {let('boxes_', _boxes(*query), decide)}, false)"


def parse_bbox(text: str) -> tuple[float, float, float, float]:
    """``"west,south,east,north"`` checked as a request parameter."""
    try:
        values = [float(v) for v in text.split(",") if v.strip()]
    except ValueError as exc:
        raise ValueError(f"bbox must be comma-separated numbers: {text!r}") from exc
    if len(values) != 4:
        raise ValueError("bbox needs west, south, east, north")
    west, south, east, north = values
    if not all(-180 <= x <= 180 for x in (west, east)):
        raise ValueError("bbox longitudes must lie in [-180, 180]")
    if not all(-90 <= y <= 90 for y in (south, north)):
        raise ValueError("bbox latitudes must lie in [-90, 90]")
    if south > north:
        raise ValueError("bbox south lies above north")
    return west, south, east, north


def ring_literal(ring: list[tuple[float, float]]) -> str:
    """One query ring as a literal geometry; the ring is closed when it is not."""
    closed = list(ring) if tuple(ring[0]) == tuple(ring[-1]) else [*ring, ring[0]]
    return "array(array(" + ", ".join(f"array({float(x)!r}D, {float(y)!r}D)" for x, y in closed) + "))"


def _edges_meet(p: str, q: str) -> str:
    overlap = " AND ".join(
        f"least({u}.{a}, {u}.{b}) <= greatest({v}.{a}, {v}.{b})"
        for u, v in ((p, q), (q, p)) for a, b in (("ax", "bx"), ("ay", "by"))
    )
    crossed = f"{_side(p, f'{q}.ax', f'{q}.ay')} * {_side(p, f'{q}.bx', f'{q}.by')} <= 0"
    crossing = f"{_side(q, f'{p}.ax', f'{p}.ay')} * {_side(q, f'{p}.bx', f'{p}.by')} <= 0"
    return f"({overlap} AND {crossed} AND {crossing})"


def polygons_intersect(rings: str, query: str) -> str:
    """Whether the record polygon (bounding box in ``xmin…ymax``) and the query polygon share a point."""
    qb = bounds(query)
    near = f"xmin <= {qb['xmax']} AND xmax >= {qb['xmin']} AND ymin <= {qb['ymax']} AND ymax >= {qb['ymin']}"

    def start(shape: str) -> tuple[str, str]:
        return f"get(get(flatten({shape}), 0), 0)", f"get(get(flatten({shape}), 0), 1)"

    meets = (
        f"exists(edges_, edge_ -> exists(query_edges_, query_edge_ -> {_edges_meet('edge_', 'query_edge_')})) "
        f"OR {point_in('edges_', *start(query))} OR {point_in('query_edges_', *start(rings))}"
    )
    exact = let("edges_", edges(rings), let("query_edges_", edges(query), meets))
    return f"coalesce(CASE WHEN {near} THEN {exact} ELSE false END, false)"
