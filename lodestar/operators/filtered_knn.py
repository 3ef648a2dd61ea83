"""Nearest neighbours among the records that a request's filters allow, for many requests at once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.vectors import dot, norm
from lodestar.operators.filters import batch_predicate
from lodestar.operators.knn import COS_DIGITS, Cells, _angles, _meet, cell_tree, unit_rows, usable
from lodestar.operators.predicate_index import indexed_matches, upper_bounds
from lodestar.operators.ranking import top_k
from lodestar.sources.tables import materialise

#: A combination that allows no more records, by its rarest clause, scores all of them.
DIRECT = 4096
#: Cells of the first round; each round looks into so many times more.
FIRST, MORE = 8, 4


def filtered_neighbours(
    catalogue: DataFrame, shapes: DataFrame, columns: list[str], k: int, matches: Callable[[DataFrame, DataFrame], DataFrame | None] = indexed_matches, direct: int = DIRECT,
) -> DataFrame:
    """``(match_id, id, cos)``: the ``k`` records nearest to the ``vector`` of each of ``shapes(match_id, vector, f_…)``
    among those that satisfy its filters, which read the catalogue's ``columns``. Ids are distinct.

    Combinations that allow few records, counted by keys, score them all, as ``matches(rows, shapes)`` finds them. For others the records lie in a
    tree of cells: rounds look into each combination's cells in order of the nearest that a member could be, a few
    first, and a combination is done when no cell that is left can hold a record nearer than its k-th. So what
    is scored is the cells around a request, not each of its records.
    """
    shapes = materialise(shapes)
    asked = materialise(usable(shapes, "match_id", "vector").select(F.col("id").alias("match_id"), F.col("v").alias("u"), F.expr(norm("v")).alias("u_norm")))
    shapes = materialise(shapes.drop("vector").join(asked, "match_id"))
    v = materialise(usable(catalogue, "id", "vector").withColumn("v_norm", F.expr(norm("v"))))
    # A zero vector has no direction, so such records are no neighbours.
    rows = v.join(catalogue.select("id", *[c for c in columns if c != "id"]), "id")
    n = v.count()
    few, many = shapes, None
    if n > direct:
        bounds = materialise(upper_bounds(rows, shapes))
        few = materialise(shapes.join(bounds.filter(F.col("n") <= direct).select("match_id"), "match_id", "left_semi"))
        many = materialise(shapes.join(bounds.filter(F.col("n") > direct).select("match_id"), "match_id", "left_semi"))
    met = matches(rows, few)
    found = None if met is None else top_k(_scored(met), ["match_id"], _order(), k).select("match_id", "id", "cos")
    if many is not None and not many.isEmpty():
        far = _in_rounds(cell_tree(v, n), rows, many, batch_predicate(rows.schema), k)
        found = far if found is None else found.unionByName(far)
    if found is None:
        kinds = [t.schema[c].dataType.simpleString() for t, c in ((shapes, "match_id"), (v, "id"))]
        return catalogue.sparkSession.createDataFrame([], "match_id {}, id {}, cos double".format(*kinds))
    return found


def _scored(pairs: DataFrame) -> DataFrame:
    kept = [c for c in ("least",) if c in pairs.columns]
    return pairs.selectExpr("match_id", "id", f"round({dot('v', 'u')} / (v_norm * u_norm), {COS_DIGITS}) AS cos", *kept)


def _by_reach(shapes: DataFrame, tree: Cells) -> DataFrame:
    """``(match_id, cell, low)``: the smallest angle at which a member of each cell can lie."""
    kind = shapes.schema["match_id"].dataType.simpleString()
    coarse = F.explode(F.array(*[F.lit(i) for i in range(len(tree.coarse))])).alias("coarse")

    def low(asked: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        apart = _angles(unit_rows(asked["v"]), unit_rows(own["centre"])) - own["radius"].to_numpy()[None, :]
        return pd.DataFrame({"match_id": asked["id"].repeat(len(own)), "cell": np.tile(own["cell"].to_numpy(), len(asked)), "low": apart.ravel()})

    return _meet(shapes.select(F.col("match_id").alias("id"), F.col("u").alias("v"), coarse), tree.small, low, f"match_id {kind}, cell bigint, low double")


def _in_rounds(tree: Cells, rows: DataFrame, shapes: DataFrame, allowed: str, k: int) -> DataFrame:
    members = materialise(tree.rows.select("id", "cell").join(rows, "id"))
    nearest_first = Window.partitionBy("match_id").orderBy("low", "cell")
    cells = materialise(_by_reach(shapes, tree).withColumn("place", F.row_number().over(nearest_first)))
    total = tree.small.count()
    best = bound = None
    a, b = 0, FIRST
    while a < total:
        # The margin covers the rounding of arccos near zero.
        due = cells.filter((F.col("place") > a) & (F.col("place") <= b)).select("match_id", "cell", "low")
        if bound is not None:
            due = due.join(bound, "match_id", "left").filter("bound IS NULL OR low <= bound + 2e-6D").drop("bound")
        # Dealt to all cores: if the members are small enough to be broadcast, it is these rows that the tasks work off.
        due = due.drop("low").repartition(4 * due.sparkSession.sparkContext.defaultParallelism, "match_id", "cell")
        met = _scored(members.join(due, "cell").join(shapes, "match_id").filter(allowed))
        if bound is not None:
            # What is farther than the k-th found so far goes before it is sorted.
            met = met.filter("least IS NULL OR cos IS NULL OR cos >= least").drop("least")
        met = top_k(met if best is None else met.unionByName(best), ["match_id"], _order(), k).select("match_id", "id", "cos")
        best = materialise(met)
        bound = best.groupBy("match_id").agg(F.count(F.lit(1)).alias("n"), F.min("cos").alias("cos")).filter(F.col("n") >= k)
        bound = materialise(bound.select("match_id", F.acos(F.least(F.greatest("cos", F.lit(-1.0)), F.lit(1.0))).alias("bound"), F.col("cos").alias("least")))
        left = cells.filter(F.col("place") > b).join(bound, "match_id", "left").filter("bound IS NULL OR low <= bound + 2e-6D")
        if left.isEmpty():
            break
        a, b = b, min(b * MORE, max(total, b + 1))
    return best


def _order() -> list:
    return [F.col("cos").desc(), F.col("id").asc()]
