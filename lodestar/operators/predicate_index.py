"""Filters of many requests as equi-joins: every record and every filter combination gives keys.

A combination needs all of its clauses, so it is enough to meet the records of one: the clause whose
keys the fewest records have, by counted keys. Only those records are then checked against the whole
combination. Keys of a record:

* ``field:text`` for each text a wildcard clause looks at, and ``field:`` if it has one; the texts that hold
  a wanted value are looked up among the distinct texts of the field, by runs of characters;
* the years of its begin and end date, or that it has no end;
* cells of a grid for its bounding box. Cells halve from level to level; a record's level is the finest whose cells are
  as large as its box, so it has at most four there. It gives those, marked as its own, and their
  ancestors; a box gives the cells of its level and, for larger records, the ancestors to meet as own cells;
* ``*``, for a combination that none of these narrows: all its answers are records anyway.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestar.functions.common import let
from lodestar.operators.containment import holding
from lodestar.operators.filters import batch_predicate, field_values
from lodestar.schemas import FILTER_FIELDS
from lodestar.sources.tables import materialise

#: Grid levels; the finest cells are 360 / 2^8 degrees wide.
LEVELS = 9


def _own_level(w: str, s: str, e: str, n: str) -> str:
    sizes = "".join(f" WHEN greatest({e} - {w}, {n} - {s}) <= {360 / (1 << level)!r}D THEN {level}" for level in reversed(range(LEVELS)))
    return f"CASE{sizes} ELSE 0 END"


def _cells(w: str, s: str, e: str, n: str, level: int) -> str:
    """``x:y`` of the cells of one level that a box touches."""
    size = 360 / (1 << level)
    x = f"sequence(CAST(floor(({w} + 180) / {size!r}D) AS int), CAST(floor(({e} + 180) / {size!r}D) AS int))"
    y = f"sequence(CAST(floor(({s} + 90) / {size!r}D) AS int), CAST(floor(({n} + 90) / {size!r}D) AS int))"
    return f"flatten(transform({x}, x_ -> transform({y}, y_ -> concat('{level}:', x_, ':', y_))))"


def _box_keys(w: str, s: str, e: str, n: str, of_record: bool) -> str:
    """Grid keys of a box; ``own`` cells of a record meet coarser or equal boxes' ancestors, all its cells a finer level's."""
    parts = []
    for level in range(LEVELS):
        cells = _cells(w, s, e, n, level)
        marked = lambda mark: f"transform({cells}, c_ -> concat('{mark}:', c_))"  # noqa: B023, E731
        if of_record:
            parts += [f"CASE WHEN level_ = {level} THEN {marked('own')} ELSE array() END", f"CASE WHEN level_ >= {level} THEN {marked('cell')} ELSE array() END"]
        else:
            parts.append(f"CASE WHEN level_ = {level} THEN {marked('cell')} WHEN level_ > {level} THEN {marked('own')} ELSE array() END")
    return f"CASE WHEN {w} IS NOT NULL THEN {let('level_', _own_level(w, s, e, n), f'concat({', '.join(parts)})')} ELSE array() END"


def record_keys(schema: StructType) -> str:
    """All keys of a record, as one array."""
    parts = []
    for name, paths in FILTER_FIELDS.items():
        texts = ", ".join(f"coalesce({field_values(schema, p)}, array())" for p in paths)
        held = f"filter(concat({texts}), t_ -> t_ IS NOT NULL)"
        parts.append(let("ts_", held, f"CASE WHEN size(ts_) > 0 THEN array_append(transform(ts_, t_ -> concat('{name}:', lower(t_))), '{name}:') ELSE array() END"))
    parts.append("CASE WHEN begin_date IS NOT NULL THEN array(concat('begin:', year(begin_date))) ELSE array() END")
    parts.append("array(CASE WHEN end_date IS NULL THEN 'end:none' ELSE concat('end:', year(end_date)) END)")
    parts.append(_box_keys("xmin", "ymin", "xmax", "ymax", True))
    return f"array_distinct(concat(array('*'), {', '.join(parts)}))"


def _wanted(shapes: DataFrame, keys: DataFrame) -> DataFrame:
    """``(match_id, clause, key)``: the keys of which a record of each clause has one."""
    spans = keys.filter("key LIKE 'begin:%' OR key LIKE 'end:%' AND key <> 'end:none'").selectExpr("CAST(split_part(key, ':', 2) AS int) AS y").agg(F.min("y"), F.max("y")).first()
    first, last = (spans[0], spans[1]) if spans[0] is not None else (0, 0)
    years = lambda name, a, b: f"CASE WHEN {a} <= {b} THEN transform(sequence({a}, {b}), y_ -> concat('{name}:', y_)) ELSE array() END"
    boxes = (
        "CASE WHEN f_box[0] > f_box[2] THEN array(named_struct('w', f_box[0], 'e', 180D), named_struct('w', -180D, 'e', f_box[2])) "
        "ELSE array(named_struct('w', f_box[0], 'e', f_box[2])) END"
    )
    cells = f"flatten(transform({boxes}, b_ -> {_box_keys('b_.w', 'f_box[1]', 'b_.e', 'f_box[3]', False)}))"
    clauses = {
        "*": "array('*')",
        "begin": f"CASE WHEN f_begin IS NOT NULL THEN {years('begin', f'greatest(year(f_begin), {first})', last)} END",
        "end": f"CASE WHEN f_end IS NOT NULL THEN {years('end', first, f'least(year(f_end), {last})')} END",
        "missing": "CASE WHEN f_end_missing THEN array('end:none') END",
        "box": f"CASE WHEN f_box IS NOT NULL AND f_relation <> 'disjoint' THEN {cells} END",
    }
    plain = ", ".join(f"named_struct('clause', '{name}', 'ks', {expression})" for name, expression in clauses.items())
    out = shapes.selectExpr("match_id", f"explode(filter(array({plain}), c_ -> c_.ks IS NOT NULL)) AS c")
    # A clause that no record can satisfy keeps a key that none has.
    out = out.selectExpr("match_id", "c.clause", "explode(CASE WHEN size(c.ks) > 0 THEN array_distinct(c.ks) ELSE array('-') END) AS key")

    values = ", ".join(f"named_struct('field', '{name}', 'vs', f_{name})" for name in FILTER_FIELDS)
    asked = shapes.selectExpr("match_id", f"explode(filter(array({values}), c_ -> c_.vs IS NOT NULL)) AS c").selectExpr("match_id", "c.field", "explode(c.vs) AS value")
    # The longest run without a wildcard; a value of wildcards alone is met by any text.
    longest = "array_max(transform(split(value, '[*?]'), r_ -> named_struct('n', char_length(r_), 'run', r_))).run"
    asked = asked.selectExpr("match_id", "field", f"{longest} AS piece").distinct()
    texts = keys.selectExpr("key", "split_part(key, ':', 1) AS field").selectExpr("field", "substring(key, char_length(field) + 2) AS word")
    texts = texts.filter(F.col("field").isin(list(FILTER_FIELDS)) & (F.col("word") != ""))
    found = holding(texts, asked.filter("piece <> ''").select("field", "piece").distinct(), ("field",))
    met = asked.join(found, ["field", "piece"], "left").selectExpr(
        "match_id", "field AS clause", "CASE WHEN piece = '' THEN concat(field, ':') WHEN word IS NULL THEN '-' ELSE concat(field, ':', word) END AS key"
    )
    return out.unionByName(met.distinct())


def _anchors(rows: DataFrame, shapes: DataFrame) -> DataFrame:
    """``(match_id, key, n)``: the keys of each combination's rarest clause, and how many records have one of them at most."""
    keys = materialise(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")))
    wanted = materialise(_wanted(shapes, keys))
    cost = wanted.join(keys, "key", "left").groupBy("match_id", "clause").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    best = cost.groupBy("match_id").agg(F.min_by("clause", F.struct("n", "clause")).alias("clause"), F.min("n").alias("n"))
    return wanted.join(best, ["match_id", "clause"]).select("match_id", "key", "n")


def upper_bounds(catalogue: DataFrame, shapes: DataFrame) -> DataFrame:
    """``(match_id, n)``: no more than ``n`` records satisfy the combination."""
    rows = catalogue.selectExpr("id", f"explode({record_keys(catalogue.schema)}) AS key")
    return _anchors(rows, shapes).select("match_id", "n").distinct()


def indexed_matches(catalogue: DataFrame, shapes: DataFrame, but: DataFrame | None = None) -> DataFrame:
    """The rows of ``catalogue`` joined to the filter combinations ``shapes(match_id, f_…)`` that they satisfy, ``but`` for
    the pairs ``but(match_id, id)``.

    The catalogue is read twice, for its keys and for the rows found, however many combinations there are; no
    combination meets a record that has none of the keys of its rarest clause. What is shuffled is a row for each id
    with the numbers of its combinations; only behind that do records and combinations become pairs.
    """
    rows = catalogue.selectExpr("id", f"explode({record_keys(catalogue.schema)}) AS key")
    numbered = materialise(shapes.withColumn("_n", F.monotonically_increasing_id()))
    numbers = numbered.select("match_id", "_n")
    anchors = materialise(_anchors(rows, numbered).join(numbers, "match_id").groupBy("key").agg(F.collect_set("_n").alias("_of_key")))
    found = rows.join(anchors, "key").groupBy(F.col("id").alias("_id")).agg(F.array_distinct(F.flatten(F.collect_list("_of_key"))).alias("_asked"))
    if but is not None:
        held = but.join(numbers, "match_id").groupBy(F.col("id").alias("_but")).agg(F.collect_set("_n").alias("_held"))
        asked = F.when(F.col("_held").isNull(), F.col("_asked")).otherwise(F.array_except("_asked", "_held"))
        found = found.join(held, F.col("_id") == F.col("_but"), "left").select("_id", asked.alias("_asked"))
    met = catalogue.join(found, F.col("id").eqNullSafe(F.col("_id"))).select(*catalogue.columns, F.explode("_asked").alias("_n"))
    return met.join(numbered, "_n").drop("_n").filter(batch_predicate(catalogue.schema))
