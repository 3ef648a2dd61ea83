"""Nearest neighbours by cosine.

Three plans share one numpy kernel that never emits more than ``k`` rows per query and block:

* few queries (their number is checked): the query matrix goes to every task, the catalogue is
  scanned once and not shuffled;
* many queries, exact: the catalogue lies in a tree of cells, coarse ones and in each of those smaller
  ones, with a centre and a radius at both levels. A query first ranks its nearest small cells, which bounds
  its k-th neighbour. Angles between unit vectors obey the triangle inequality, so a coarse cell,
  and then a small one, is skipped only when no member can be nearer than that bound;
* approximate: the same tree, or given centres, and every query visits its ``nprobe`` nearest cells.

The number of cells grows with the rows: a table of n rows has about n^(1/4) coarse cells and n^(1/2) small ones of
n^(1/2) rows each. Cells are cut into slices of bounded size, whatever their population.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions.vectors import norm
from lodestar.operators.ranking import top_k
from lodestar.sources.tables import materialise

MAX_BROADCAST_QUERIES = 4096
SLICE_ROWS = 4096
# Catalogue rows multiplied with the query matrix at a time, which bounds the task's memory.
CHUNK = 1024
# Coarse cells at most, and rows for each that the centres are fitted on: a bounded sample, by a hash of the
# id. It only decides where cells lie; every row is put in a cell.
MAX_CELLS = 1024
COARSE_POOL, CELL_POOL = 32, 4
# Rows of a small cell at least where every vector meets whole cells: a product of so many rows costs less than a visit.
JOIN_CELL = 2048
# Rows at most of either side that meet in a task of the exact join.
JOIN_ROWS = 1 << 15
# Scores are compared after rounding, so that equal vectors tie and ids decide on every layout.
COS_DIGITS = 12


def score_of(cos: str, transform: str = "reciprocal") -> str:
    """Score of a cosine: ``1/(2-cos)``, or ``(1+cos)/2`` for ``linear``."""
    if transform == "reciprocal":
        return f"1D / (2D - {cos})"
    if transform == "linear":
        return f"(1D + {cos}) / 2D"
    raise ValueError(f"unknown score transform {transform!r}")


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Rows with a vector that is neither null nor all zero, as ``(id, v)``."""
    return df.selectExpr(f"{key} AS id", f"CAST({vector} AS array<double>) AS v").filter(
        f"v IS NOT NULL AND NOT exists(v, x -> x IS NULL) AND {norm('v')} > 0"
    )


def unit_rows(vectors) -> np.ndarray:
    m = np.concatenate(list(vectors)).astype("float64", copy=False).reshape(len(vectors), -1)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def id_places(ids) -> np.ndarray:
    """The place of each id in the order of all of them; nulls come last."""
    place = pd.factorize(ids, sort=True)[0]
    return np.where(place < 0, place.max(initial=-1) + 1, place)


def _no_rows(schema: str) -> pd.DataFrame:
    """No rows of ``schema``. Columns of objects become any Arrow type; empty lists would be floats, which become neither texts nor arrays."""
    return pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")}, dtype=object)


class _Best:
    """The k best catalogue rows of every query seen so far in one task."""

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, k: int):
        self.query_ids, self.queries, self.k = query_ids, queries, k
        self.cos = np.full((len(query_ids), k), -np.inf)
        self.ids = np.full((len(query_ids), k), None, object)

    def add(self, vectors: np.ndarray, ids: np.ndarray) -> None:
        for at in range(0, len(ids), CHUNK):
            self._add_chunk(vectors[at:at + CHUNK], ids[at:at + CHUNK])

    def _add_chunk(self, vectors: np.ndarray, ids: np.ndarray) -> None:
        """Old best rows and the chunk side by side; the k best of each query, equal scores by id."""
        new = np.round(self.queries @ vectors.T, COS_DIGITS)
        held = np.isfinite(self.cos)
        place = id_places(np.concatenate([self.ids[held], ids.astype(object)]))
        old_place = np.zeros(self.ids.shape, np.int64)
        old_place[held] = place[: int(held.sum())]
        cos = np.hstack([self.cos, new])
        places = np.hstack([old_place, np.broadcast_to(place[int(held.sum()):], new.shape)])
        # Rounded cosines as whole numbers leave room for the order of the ids.
        scaled = np.where(np.isfinite(cos), cos, -2.0) * 10.0**COS_DIGITS
        key = -(np.rint(scaled).astype(np.int64) << 21) + places
        best = np.argpartition(key, self.k - 1, axis=1)[:, : self.k]
        best = np.take_along_axis(best, np.take_along_axis(key, best, 1).argsort(1), 1)
        all_ids = np.hstack([self.ids, np.broadcast_to(ids.astype(object), new.shape)])
        self.cos, self.ids = np.take_along_axis(cos, best, 1), np.take_along_axis(all_ids, best, 1)

    def frame(self) -> pd.DataFrame:
        found = np.isfinite(self.cos)
        return pd.DataFrame({
            "qid": np.repeat(self.query_ids, found.sum(1)), "id": self.ids[found], "cos": self.cos[found],
        })


def _result_schema(queries: DataFrame, catalogue: DataFrame) -> str:
    qtype = queries.schema["id"].dataType.simpleString()
    ctype = catalogue.schema["id"].dataType.simpleString()
    return f"qid {qtype}, id {ctype}, cos double"


def _knn_scan(query_rows: list, catalogue: DataFrame, k: int, schema: str) -> DataFrame:
    """Catalogue scan against a bounded query matrix; k rows per query leave each task."""
    sc = catalogue.sparkSession.sparkContext
    shared = sc.broadcast((pd.Series([r["id"] for r in query_rows]).to_numpy(), unit_rows([r["v"] for r in query_rows])))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = _Best(*shared.value, k)
        for batch in batches:
            if len(batch):
                best.add(unit_rows(batch["v"]), batch["id"].to_numpy())
        yield best.frame()

    return catalogue.mapInPandas(scan, schema)


def _angles(unit: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit @ centres.T, -1.0, 1.0))


def assign_cells(df: DataFrame, centres: np.ndarray) -> DataFrame:
    """``(id, v, cell, angle)`` with the nearest centre of every vector."""
    shared = df.sparkSession.sparkContext.broadcast(centres)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            angles = _angles(unit_rows(batch["v"]), shared.value)
            cell = angles.argmin(axis=1)
            yield batch.assign(cell=cell.astype("int32"), angle=angles[np.arange(len(batch)), cell])

    idtype = df.schema["id"].dataType.simpleString()
    return df.select("id", "v").mapInPandas(assign, f"id {idtype}, v array<double>, cell int, angle double")


def _target_cells(queries: DataFrame, choose) -> DataFrame:
    """``(id, v, cell)``: one row per query and cell that ``choose(unit_matrix)`` (a mask) selects."""

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            row, cell = np.nonzero(choose(unit_rows(batch["v"])))
            yield batch.iloc[row].assign(cell=cell.astype("int32"))

    idtype = queries.schema["id"].dataType.simpleString()
    return queries.select("id", "v").mapInPandas(visit, f"id {idtype}, v array<double>, cell int")


def _block_join(visits: DataFrame, cells: DataFrame, k: int, schema: str) -> DataFrame:
    """Meet queries and catalogue rows of equal cell in blocks of bounded size.

    Both sides are cut into slices of about ``SLICE_ROWS`` rows per cell and every pair of slices
    is one group, so a cell holding a third of the table becomes many groups.
    """
    slices = lambda df, name: df.groupBy("cell").agg(
        F.ceil(F.count(F.lit(1)) / SLICE_ROWS).cast("int").alias(name)
    )
    counts = slices(visits, "n_q").join(slices(cells, "n_c"), "cell")

    def cut(df: DataFrame, mine: str, other: str, my_count: str, other_count: str) -> DataFrame:
        return df.join(counts, "cell").select(
            "id", "v", "cell",
            F.pmod(F.xxhash64("id"), F.col(my_count)).cast("int").alias(mine),
            F.explode(F.sequence(F.lit(0), F.col(other_count) - 1)).alias(other),
        )

    left = cut(visits, "q_slice", "c_slice", "n_q", "n_c")
    right = cut(cells.select("id", "v", "cell"), "c_slice", "q_slice", "n_c", "n_q")
    keys = ["cell", "q_slice", "c_slice"]

    def nearest(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return _no_rows(schema)
        best = _Best(q["id"].to_numpy(), unit_rows(q["v"]), k)
        best.add(unit_rows(c["v"]), c["id"].to_numpy())
        return best.frame()

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(nearest, schema)


def _finish(candidates: DataFrame, k: int, transform: str) -> DataFrame:
    ranked = top_k(candidates, ["qid"], [F.col("cos").desc(), F.col("id").asc_nulls_last()], k)
    return ranked.selectExpr("qid", "id", "cos", f"{score_of('cos', transform)} AS score", "rn")


def _empty(queries: DataFrame, catalogue: DataFrame, k: int, transform: str) -> DataFrame:
    schema = _result_schema(queries, catalogue)
    return _finish(queries.sparkSession.createDataFrame([], schema), k, transform)


def knn(queries: DataFrame, catalogue: DataFrame, k: int, transform: str = "reciprocal",
        query_key: str = "id", query_vector: str = "vector", key: str = "id", vector: str = "vector",
        max_broadcast: int = MAX_BROADCAST_QUERIES) -> DataFrame:
    """Exact ``(qid, id, cos, score, rn)`` with ``rn <= k``; picks the plan by the number of queries."""
    q, c = usable(queries, query_key, query_vector), usable(catalogue, key, vector)
    rows = q.limit(max_broadcast + 1).collect()
    if not rows:
        return _empty(q, c, k, transform)
    if len(rows) <= max_broadcast:
        return _finish(_knn_scan(rows, c, k, _result_schema(q, c)), k, transform)
    return knn_join(queries, catalogue, k, transform, query_key, query_vector, key, vector)


@dataclass
class Cells:
    """A catalogue in a tree of cells."""

    #: Unit centres of the coarse cells, at most ``MAX_CELLS``, and the largest angle of a member to each (-inf: none).
    coarse: np.ndarray
    reach: np.ndarray
    #: ``(cell, coarse, centre, radius, n)``, one row for each small cell with members.
    small: DataFrame
    #: ``(id, v, cell)``, every row of the catalogue.
    rows: DataFrame


def draw(salt: int, key: str = "id") -> str:
    """A number from 0 to 1 that a row's id decides, the same in any engine that has md5."""
    return f"CAST(conv(substring(md5(concat('{salt}:', coalesce(CAST({key} AS string), ''))), 1, 12), 16, 10) AS double) / {float(1 << 48)!r}D"


def _fitted(pool: np.ndarray, k: int) -> np.ndarray:
    """Centres: the first ``k`` rows, and then the mean of the rows nearest to each."""
    near = np.round(pool @ pool[:k].T, COS_DIGITS).argmax(1)
    means = [pool[near == i].mean(0) for i in range(min(k, len(pool))) if (near == i).any()]
    return unit_rows([m if np.linalg.norm(m) > 0 else pool[0] for m in means])


def _meet(rows: DataFrame, centres: DataFrame, each, schema: str) -> DataFrame:
    """``each(rows, centres)`` for the rows and centres of a coarse cell, the rows in slices of bounded size."""
    counts = rows.groupBy("coarse").agg(F.ceil(F.count(F.lit(1)) / SLICE_ROWS).cast("int").alias("slices"))
    left = rows.join(counts, "coarse").select(*rows.columns, F.pmod(F.xxhash64("id"), F.col("slices")).cast("int").alias("slice"))
    right = centres.join(counts, "coarse").select(*centres.columns, F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return each(a, b.sort_values("cell")) if len(a) and len(b) else _no_rows(schema)

    return left.groupBy("coarse", "slice").cogroup(right.groupBy("coarse", "slice")).applyInPandas(run, schema)


def cell_tree(catalogue: DataFrame, n: int, per_cell: int | None = None) -> Cells:
    """The tree of cells of ``catalogue(id, v)``, which has ``n`` rows.

    Coarse centres are the first rows by a draw over the ids, then the means of the pool rows nearest to each.
    In each coarse cell, that of a row being the nearest, small cells of about ``per_cell`` rows (the root of
    n) are fitted in the same way. A row's cell is the nearest small centre of its coarse cell.
    """
    per_cell = per_cell or int(np.ceil(np.sqrt(n)))
    k = min(MAX_CELLS, int(np.ceil(n**0.25)), int(np.ceil(n / per_cell)))
    kind = catalogue.schema["id"].dataType.simpleString()
    # At most 2^15 rows on the mean.
    first = catalogue.withColumn("draw", F.expr(draw(0))).filter(F.col("draw") < COARSE_POOL * k / n)
    pool = first.orderBy("draw", "id", "v").select("v").collect() or catalogue.orderBy(F.expr(draw(0)), "id", "v").limit(k).select("v").collect()
    coarse = _fitted(unit_rows([r["v"] for r in pool]), k)
    shared = catalogue.sparkSession.sparkContext.broadcast(coarse)

    def to_coarse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                cos = unit_rows(batch["v"]) @ shared.value.T
                cell = np.round(cos, COS_DIGITS).argmax(1)
                yield batch.assign(coarse=cell.astype("int32"), angle=np.arccos(np.clip(cos[np.arange(len(batch)), cell], -1, 1)))

    placed = materialise(catalogue.select("id", "v").mapInPandas(to_coarse, f"id {kind}, v array<double>, coarse int, angle double"))
    reach = np.full(len(coarse), -np.inf)
    held = placed.groupBy("coarse").agg(F.count(F.lit(1)).alias("m"), F.max("angle").alias("far")).withColumn("k", F.ceil(F.col("m") / per_cell))
    for r in held.collect():
        reach[r["coarse"]] = r["far"]

    # The pool of a coarse cell grows with its small cells, not with its rows.
    drawn = placed.withColumn("draw", F.expr(draw(1))).join(held, "coarse")
    least = drawn.groupBy("coarse").agg(F.min("draw").alias("least"))
    pool = drawn.join(least, "coarse").filter((F.col("draw") < CELL_POOL * F.col("k") / F.col("m")) | (F.col("draw") == F.col("least")))

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.assign(order=[tuple(v) for v in group["v"]]).sort_values(["draw", "id", "order"])
        centres = _fitted(unit_rows(group["v"]), int(group["k"].iloc[0]))
        number = int(group["coarse"].iloc[0])
        return pd.DataFrame({"coarse": number, "cell": (number << 32) + np.arange(len(centres)), "centre": list(centres)})

    centres = materialise(pool.select("coarse", "id", "v", "k", "draw").groupBy("coarse").applyInPandas(fit, "coarse int, cell bigint, centre array<double>"))

    def to_cell(rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        cos = unit_rows(rows["v"]) @ unit_rows(own["centre"]).T
        near = np.round(cos, COS_DIGITS).argmax(1)
        far = np.arccos(np.clip(cos[np.arange(len(rows)), near], -1, 1))
        return pd.DataFrame({"id": rows["id"], "v": rows["v"], "cell": own["cell"].to_numpy()[near], "angle": far})

    rows = materialise(_meet(placed.select("coarse", "id", "v"), centres, to_cell, f"id {kind}, v array<double>, cell bigint, angle double"))
    sizes = rows.groupBy("cell").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("n"))
    return Cells(coarse, reach, materialise(centres.join(sizes, "cell").select("cell", "coarse", "centre", "radius", "n")), rows.select("id", "v", "cell"))


def nearest_cells(queries: DataFrame, cells: Cells, nprobe: int, coarse_probes: int) -> DataFrame:
    """``(id, v, cell)``: the ``nprobe`` small cells with the nearest centres, of the ``coarse_probes`` nearest coarse cells."""
    shared = queries.sparkSession.sparkContext.broadcast((cells.coarse, cells.reach))
    kind = queries.schema["id"].dataType.simpleString()

    def near(unit: np.ndarray) -> np.ndarray:
        centres, reach = shared.value
        cos = np.where(np.isfinite(reach)[None, :], np.round(unit @ centres.T, COS_DIGITS), -2.0)
        mask = np.zeros(cos.shape, bool)
        np.put_along_axis(mask, np.argsort(-cos, axis=1, kind="stable")[:, :coarse_probes], True, axis=1)
        return mask & (cos > -2)

    def rank(rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        cos = np.round(unit_rows(rows["v"]) @ unit_rows(own["centre"]).T, COS_DIGITS)
        best = np.argsort(-cos, axis=1, kind="stable")[:, :nprobe]
        each = best.shape[1]
        return pd.DataFrame({
            "id": rows["id"].repeat(each), "v": rows["v"].repeat(each), "cell": own["cell"].to_numpy()[best].ravel(), "cos": np.take_along_axis(cos, best, 1).ravel(),
        })

    coarse = materialise(_target_cells(queries, near).withColumnRenamed("cell", "coarse"))
    ranked = _meet(coarse, cells.small, rank, f"id {kind}, v array<double>, cell bigint, cos double")
    return top_k(ranked, ["id"], [F.col("cos").desc(), F.col("cell").asc()], nprobe).select("id", "v", "cell")


def _near_coarse(queries: DataFrame, cells: Cells) -> DataFrame:
    """``(id, v, bound, coarse)``: the coarse cells that may hold a vector within the angle ``bound`` of ``queries(id, v, bound)``."""
    shared = queries.sparkSession.sparkContext.broadcast((cells.coarse, cells.reach))
    kind = queries.schema["id"].dataType.simpleString()

    def coarse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centres, reach = shared.value
        for batch in batches:
            if len(batch):
                row, cell = np.nonzero(_angles(unit_rows(batch["v"]), centres) - reach[None, :] <= batch["bound"].to_numpy()[:, None])
                yield batch.iloc[row].assign(coarse=cell.astype("int32"))

    return queries.select("id", "v", "bound").mapInPandas(coarse, f"id {kind}, v array<double>, bound double, coarse int")


def reachable_cells(queries: DataFrame, cells: Cells) -> DataFrame:
    """``(id, v, cell)``: all cells that may hold a vector within the angle ``bound`` of ``queries(id, v, bound)``."""
    kind = queries.schema["id"].dataType.simpleString()

    def small(rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        apart = _angles(unit_rows(rows["v"]), unit_rows(own["centre"])) - own["radius"].to_numpy()[None, :]
        row, cell = np.nonzero(apart <= rows["bound"].to_numpy()[:, None])
        return pd.DataFrame({"id": rows["id"].to_numpy()[row], "v": rows["v"].to_numpy()[row], "cell": own["cell"].to_numpy()[cell]})

    return _meet(materialise(_near_coarse(queries, cells)), cells.small, small, f"id {kind}, v array<double>, cell bigint")


def visited_share(visits: DataFrame, cells: Cells) -> DataFrame:
    """One row: ``pairs`` of query and row that ``visits`` compares, and ``rows`` of the catalogue."""
    per = visits.groupBy("cell").agg(F.count(F.lit(1)).alias("visits"))
    return cells.small.join(per, "cell", "left").agg(F.coalesce(F.sum(F.col("n") * F.col("visits")), F.lit(0)).alias("pairs"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))


def knn_join(queries: DataFrame, catalogue: DataFrame, k: int, transform: str = "reciprocal",
             query_key: str = "id", query_vector: str = "vector", key: str = "id", vector: str = "vector",
             cells: int | None = None) -> DataFrame:
    """Exact kNN of a large query table; only coarse centres are broadcast. ``cells`` small cells, if given."""
    q, c = usable(queries, query_key, query_vector), usable(catalogue, key, vector)
    schema = _result_schema(q, c)
    # Of equal vectors only the k smallest ids can be among k nearest, so a large group of copies
    # shrinks to k rows (each task drops its surplus before the shuffle) and no result changes.
    c = materialise(top_k(c, ["v"], [F.col("id").asc_nulls_last()], k).select("id", "v"))
    n = c.count()
    if n == 0:
        return _empty(q, c, k, transform)
    per_cell = int(np.ceil(n / cells)) if cells else max(int(np.ceil(np.sqrt(n))), JOIN_CELL)
    if n <= per_cell:  # a tree of one cell
        one = F.lit(0).cast("bigint").alias("cell")
        return _finish(_block_join(q.select("id", "v", one), c.select("id", "v", one), k, schema), k, transform)
    tree = cell_tree(c, n, per_cell)
    kinds = {t.schema[name].dataType.simpleString() for t, name in ((queries, query_vector), (catalogue, vector))}
    kind = "array<float>" if kinds == {"array<float>"} else "array<double>"
    return _finish(_coarse_join(bounded(q, tree, k, schema), tree, k, schema, kind), k, transform)


def bounded(queries: DataFrame, tree: Cells, k: int, schema: str, probes: int = 2) -> DataFrame:
    """``(id, v, bound)``: the angle within which the ``k`` nearest lie, of the k-th in the nearest cells; 4 where these hold fewer."""
    first = _block_join(materialise(nearest_cells(queries, tree, probes, probes)), tree.rows, k, schema)
    # The margin covers the rounding of arccos near zero.
    kth = top_k(first, ["qid"], [F.col("cos").desc(), F.col("id").asc()], k).groupBy("qid").agg(F.count(F.lit(1)).alias("found"), F.min("cos").alias("least"))
    kth = kth.filter(F.col("found") >= k).select("qid", (F.acos(F.least(F.greatest("least", F.lit(-1.0)), F.lit(1.0))) + 2e-6).alias("near"))
    return materialise(queries.join(kth, queries["id"].eqNullSafe(kth["qid"]), "left").select("id", "v", F.coalesce("near", F.lit(4.0)).alias("bound")))


def exact_visits(queries: DataFrame, tree: Cells, k: int, schema: str, probes: int = 2) -> DataFrame:
    """The cells that may hold one of the ``k`` nearest: a search of the nearest cells bounds the k-th, and the bound the cells."""
    return materialise(reachable_cells(bounded(queries, tree, k, schema, probes), tree))


def _coarse_join(queries: DataFrame, cells: Cells, k: int, schema: str, kind: str) -> DataFrame:
    """The ``k`` nearest in each coarse cell within the ``bound`` of a query; its small cells are looked at where they lie.

    A query is sent to a coarse cell once, not to each small one, and both sides are cut into slices of up to
    ``JOIN_ROWS`` rows. So what is shuffled grows with the coarse cells and the slices: where cells tell
    little and all pairs are compared, two blocks of that size are read for their product. ``kind`` holds the vectors.
    """
    n = queries.count()
    slices = max(1, -(-n // min(JOIN_ROWS, max(JOIN_CELL, -(-n // 8)))))
    held = cells.small.groupBy("coarse").agg(F.ceil(F.sum("n") / JOIN_ROWS).cast("int").alias("n_c"))
    asked = _near_coarse(queries, cells).join(held, "coarse").select(
        "id", F.col("v").cast(kind).alias("v"), "bound", "coarse", F.pmod(F.xxhash64("id"), F.lit(slices)).cast("int").alias("q_slice"),
        F.explode(F.sequence(F.lit(0), F.col("n_c") - 1)).alias("c_slice"),
    )
    rows = cells.rows.withColumn("coarse", F.shiftright("cell", 32).cast("int")).join(held, "coarse").select(
        "id", F.col("v").cast(kind).alias("v"), "cell", "coarse", F.pmod(F.xxhash64("id"), F.col("n_c")).cast("int").alias("c_slice"),
        F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("q_slice"),
    )
    keys = ["coarse", "q_slice", "c_slice"]

    def nearest(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return _no_rows(schema)
        c = c.sort_values("cell")
        return _within(q["id"].to_numpy(), unit_rows(q["v"]), q["bound"].to_numpy(), c["id"], unit_rows(c["v"]), c["cell"].to_numpy(), k)

    return asked.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInPandas(nearest, schema)


def _within(query_ids: np.ndarray, queries: np.ndarray, bound: np.ndarray, ids: pd.Series, vectors: np.ndarray, cell: np.ndarray, k: int) -> pd.DataFrame:
    """The ``k`` nearest ``vectors`` within the angle ``bound`` of each query, equal scores by id; ``cell`` is in order."""
    order = id_places(ids)
    starts = np.unique(np.concatenate([np.flatnonzero(np.diff(cell, prepend=cell[0] - 1)), np.arange(0, len(cell), JOIN_CELL)]))
    parts = []
    for a, b in zip(starts, [*starts[1:], len(cell)]):
        centre = vectors[a:b].mean(0)
        centre = centre / np.linalg.norm(centre) if np.linalg.norm(centre) > 0 else vectors[a]
        parts.append((a, b, centre, _angles(vectors[a:b], centre[None, :]).max()))
    # Scores are compared after rounding, so what is nearly as near is kept until then.
    slack = 10.0 ** (1 - COS_DIGITS)
    floor = np.where(bound < np.pi, np.cos(np.minimum(bound, np.pi)) - slack, -np.inf)
    out = []
    for at in range(0, len(queries), CHUNK):
        met = [[np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]]
        for a, b, centre, radius in parts:
            asking = at + np.flatnonzero(_angles(queries[at:at + CHUNK], centre[None, :])[:, 0] - radius <= bound[at:at + CHUNK])
            cos = queries[asking] @ vectors[a:b].T
            least = floor[asking]
            if b - a > k and not np.isfinite(least).all():
                least = np.maximum(least, np.partition(cos, b - a - k, axis=1)[:, b - a - k] - slack)
            row, col = np.nonzero(cos >= least[:, None])
            for held, more in zip(met, (asking[row], a + col, np.round(cos[row, col], COS_DIGITS))):
                held.append(more)
        row, col, cos = map(np.concatenate, met)
        by = np.lexsort((order[col], -cos, row))
        row, col, cos = row[by], col[by], cos[by]
        kept = np.arange(len(row)) - np.searchsorted(row, row) < k
        out.append(pd.DataFrame({"qid": query_ids[row[kept]], "id": ids.to_numpy()[col[kept]], "cos": cos[kept]}))
    return pd.concat(out, ignore_index=True)


def knn_tree(queries: DataFrame, catalogue: DataFrame, k: int, nprobe: int = 16, coarse_probes: int = 8, transform: str = "reciprocal",
             query_key: str = "id", query_vector: str = "vector", key: str = "id", vector: str = "vector") -> DataFrame:
    """Approximate kNN: every query looks into its ``nprobe`` nearest small cells, ranked exactly.

    A cell holds about the root of the rows, so what a query compares grows with the root of the table.
    """
    q, c = usable(queries, query_key, query_vector), materialise(usable(catalogue, key, vector))
    n = c.count()
    if n == 0:
        return _empty(q, c, k, transform)
    tree = cell_tree(c, n)
    visits = materialise(nearest_cells(q, tree, nprobe, coarse_probes))
    return _finish(_block_join(visits, tree.rows, k, _result_schema(q, c)), k, transform)


def kmeans_cells(catalogue: DataFrame, n_cells: int, key: str = "id", vector: str = "vector",
                 seed: int = 42) -> np.ndarray:
    """Unit k-means centres, trained on all rows; the fit is distributed and gives ``n_cells`` centres."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    c = usable(catalogue, key, vector)
    train = c.select(array_to_vector("v").alias("features"))
    model = KMeans(k=n_cells, seed=seed, distanceMeasure="cosine", maxIter=10).fit(train)
    return unit_rows(model.clusterCenters())


def knn_cells(queries: DataFrame, catalogue: DataFrame, centres: np.ndarray, k: int, nprobe: int = 8,
              transform: str = "reciprocal", query_key: str = "id", query_vector: str = "vector",
              key: str = "id", vector: str = "vector") -> DataFrame:
    """Approximate kNN: every query looks into its ``nprobe`` nearest cells only, ranked exactly."""
    q, c = usable(queries, query_key, query_vector), usable(catalogue, key, vector)
    shared = q.sparkSession.sparkContext.broadcast(centres)
    probes = min(nprobe, len(centres))

    def nearest_cells(unit: np.ndarray) -> np.ndarray:
        angles = _angles(unit, shared.value)
        chosen = np.argsort(angles, axis=1, kind="stable")[:, :probes]
        mask = np.zeros(angles.shape, dtype=bool)
        np.put_along_axis(mask, chosen, True, axis=1)
        return mask

    visits, cells = materialise(_target_cells(q, nearest_cells)), materialise(assign_cells(c, centres))
    return _finish(_block_join(visits, cells, k, _result_schema(q, c)), k, transform)
