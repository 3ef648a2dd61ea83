"""Approximate nearest neighbours by cosine: an NN-descent graph, searched greedily."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.frames import Scratch

#: Neighbours of a node, neighbours from the other side it is met by, and rounds of descent.
NEIGHBOURS, REVERSE, ROUNDS = 32, 32, 5
#: Tables of random planes that give the first neighbours, and the nodes a block of them aims at and may hold.
TABLES, BLOCK, LARGEST = 5, 128, 512
#: Nodes a query keeps, expands at once, and rounds of its search at most.
POOL, EXPAND, SEARCH = 160, 32, 12


def _rows(column: pa.Array, kind: type = np.float32) -> np.ndarray:
    """A column of lists of equal length as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """Each vector by a power of two, so that its largest component is near 1 and no square overflows or vanishes."""
    if not vectors.size:
        return vectors
    _, exponent = np.frexp(np.abs(vectors).max(1, keepdims=True))
    return np.ldexp(vectors, -exponent)


def _blobs(column: pa.Array) -> np.ndarray:
    """A column of binaries of equal length as a matrix of small integers."""
    joined = np.frombuffer(b"".join(x.as_py() for x in column), np.int8)
    return joined.reshape(len(column), -1)


def usable(vectors: DataFrame) -> DataFrame:
    """Rows ``(vec_id, embedding)`` that take part: an id, and finite components not all zero. Of a repeated
    id the first vector counts, vectors of another length than most have do not take part."""
    finite = vectors.where("vec_id IS NOT NULL AND size(embedding) > 0").where(
        "forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(embedding, x -> x <> 0)"
    )
    sizes = finite.groupBy(F.size("embedding").alias("n")).agg(F.count(F.lit(1)).alias("rows"))
    most = sizes.orderBy(F.desc("rows"), "n").limit(1).collect()
    finite = finite.where(F.size("embedding") == (most[0]["n"] if most else 0))
    return finite.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def _distinct(vectors: DataFrame, copies: int) -> DataFrame:
    """One node for each distinct vector: its smallest id, and its ``copies`` smallest ids. Of a vector
    however frequent each task passes on only so many rows."""
    place = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    few = vectors.withColumn("place", place).where(F.col("place") <= copies)
    return few.groupBy("embedding").agg(F.min("vec_id").alias("node"), F.sort_array(F.collect_list("vec_id")).alias("ids"))


def _coded(tables: int, bits: int, planes: np.ndarray):
    """Nodes with their vectors as small integers and their blocks in each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _scaled(_rows(batch.column("embedding"), np.float64))
            unit = (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)
            code = np.rint(unit / np.abs(unit).max(1, keepdims=True) * 127).astype(np.int8)
            signs = (unit @ planes > 0).reshape(len(unit), tables, bits)
            block = (signs << np.arange(bits)).sum(2) + (np.arange(tables) << bits)
            ends = np.arange(len(unit) + 1) * tables
            blocks = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(block.ravel().astype(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([c.tobytes() for c in code], pa.binary()), blocks], ["node", "code", "blocks"])

    return run


def _unit(codes: np.ndarray) -> np.ndarray:
    out = codes.astype(np.float32)
    return out / np.maximum(np.linalg.norm(out, axis=-1, keepdims=True), 1e-9)


_EDGES = "u bigint, w bigint, near double"


def _edges(u: np.ndarray, w: np.ndarray, near: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u.astype(np.int64)), pa.array(w.astype(np.int64)), pa.array(near.astype(np.float64))], ["u", "w", "near"])


def _in_block(best: int):
    """The nearest nodes of each node of a block."""

    def run(table: pa.Table) -> pa.Table:
        nodes = table.column("node").to_numpy()
        unit = _unit(_blobs(table.column("code").combine_chunks()))
        near = unit @ unit.T
        np.fill_diagonal(near, -2)
        k = min(best, len(nodes) - 1)
        if k <= 0:
            return pa.Table.from_batches([_edges(nodes[:0], nodes[:0], near[:0, 0])])
        found = np.argpartition(-near, k - 1, 1)[:, :k]
        rows = np.repeat(np.arange(len(nodes)), k)
        return pa.Table.from_batches([_edges(nodes[rows], nodes[found.ravel()], near[rows, found.ravel()])])

    return run


def _local_joins(best: int):
    """For all nodes met in one neighbourhood, their nearest others in it that are better than what they have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 512):
                met = whole.column("met").slice(a, 512)
                lengths = pa.compute.list_value_length(met).to_numpy(zero_copy_only=False).astype(np.int64)
                flat = met.flatten()
                width = int(lengths.max())
                inside = np.arange(width) < lengths[:, None]
                codes = _unit(_blobs(flat.field("code")))
                unit = np.zeros((len(lengths), width, codes.shape[1]), np.float32)
                unit[inside] = codes
                ids = np.full((len(lengths), width), -1)
                ids[inside] = flat.field("w").to_numpy(zero_copy_only=False)
                least = np.full((len(lengths), width), 2.0, np.float32)
                least[inside] = flat.field("least").to_numpy(zero_copy_only=False)
                fresh = np.zeros((len(lengths), width), bool)
                fresh[inside] = flat.field("fresh").to_numpy(zero_copy_only=False)
                near = unit @ unit.transpose(0, 2, 1)
                usable_ = inside[:, None, :] & (fresh[:, :, None] | fresh[:, None, :]) & (ids[:, :, None] != ids[:, None, :])
                near[~usable_ | (near <= least[:, :, None])] = -2
                k = min(best, width)
                found = np.argpartition(-near, k - 1, 2)[:, :, :k]
                value = np.take_along_axis(near, found, 2)
                g, i, j = np.nonzero(value > -2)
                yield _edges(ids[g, i], ids[g, found[g, i, j]], value[g, i, j])

    return run


def _best(edges: DataFrame, k: int) -> DataFrame:
    """Each node's ``k`` nearest."""
    one = edges.groupBy("u", "w").agg(F.max("near").alias("near"), F.min("fresh").alias("fresh"))
    place = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("near"), "w"))
    return one.withColumn("place", place).where(F.col("place") <= k).drop("place")


def build_graph(
    nodes: DataFrame, k: int = NEIGHBOURS, reverse: int = REVERSE, rounds: int = ROUNDS, tables: int = TABLES,
) -> DataFrame:
    """A graph of about the ``k`` nearest of each row of ``nodes(node, embedding)``: ``(node, code, others)``,
    with the node's vector in small integers.

    First neighbours come from blocks of nodes on the same side of some random planes. Then each
    round a node's neighbours, and a fixed number of those that have it as neighbour, meet each
    other where one of them is new; who is nearer than the worst neighbour of another becomes its
    neighbour. Vectors travel as bytes here. A round that changes less than one edge in 200 is the last.
    """
    spark = nodes.sparkSession
    scratch = Scratch(spark)
    count, first = nodes.count(), nodes.select(F.size("embedding").alias("n")).first()
    bits = max(0, int(np.ceil(np.log2(max(count, 1) / BLOCK))))
    dims = first["n"] if first else 1
    planes = np.random.default_rng(7).normal(size=(dims, tables * bits)).astype(np.float32)
    coded = scratch.table(nodes.select("node", "embedding").mapInArrow(_coded(tables, bits, planes), "node bigint, code binary, blocks array<bigint>"))
    placed = coded.select("node", "code", F.explode("blocks").alias("block"))
    sizes = placed.groupBy("block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LARGEST)
    split = F.pmod(F.xxhash64("node", "block"), F.coalesce(F.ceil(F.col("n") / LARGEST), F.lit(1)))
    dealt = placed.join(sizes, "block", "left").withColumn("part", split)
    edges = dealt.groupBy("block", "part").applyInArrow(_in_block(max(4, k // 2)), _EDGES)
    graph = scratch.table(_best(edges.withColumn("fresh", F.lit(True)), k))
    for _ in range(rounds):
        worst = graph.groupBy("u").agg(F.when(F.count(F.lit(1)) >= k, F.min("near")).otherwise(F.lit(-2.0)).alias("least"))
        state = coded.select("node", "code").join(worst, coded["node"] == worst["u"], "left").select("node", "code", F.coalesce("least", F.lit(-2.0)).cast("float").alias("least"))
        turn = F.row_number().over(Window.partitionBy("w").orderBy(F.desc("fresh"), F.xxhash64("u", "w")))
        back = graph.withColumn("turn", turn).where(F.col("turn") <= reverse).select(F.col("w").alias("v"), F.col("u").alias("w"), "fresh")
        both = graph.select(F.col("u").alias("v"), "w", "fresh").unionByName(back).groupBy("v", "w").agg(F.max("fresh").alias("fresh"))
        met = both.join(state, both["w"] == state["node"]).groupBy("v").agg(
            F.collect_list(F.struct("w", "code", "least", "fresh")).alias("met"), F.max("fresh").alias("any")
        ).where("any")
        better = met.select("met").mapInArrow(_local_joins(4), _EDGES).withColumn("fresh", F.lit(True))
        after = scratch.table(_best(graph.withColumn("fresh", F.lit(False)).unionByName(better), k))
        changed = after.where("fresh").count()
        scratch.drop(graph)
        graph = after
        if 200 * changed <= count * k:
            break
    linked = graph.select(F.col("u").alias("node"), F.col("w").alias("other")).unionByName(graph.select(F.col("w").alias("node"), F.col("u").alias("other")))
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.xxhash64("node", "other"), "other"))
    # Both directions; of those that many have as neighbour a fixed number.
    kept = graph.select(F.col("u").alias("node"), F.col("w").alias("other")).unionByName(
        linked.join(graph.select(F.col("u").alias("node"), F.col("w").alias("other")), ["node", "other"], "left_anti").withColumn("place", place).where(F.col("place") <= reverse).drop("place")
    )
    lists = kept.groupBy(F.col("node").alias("of")).agg(F.collect_set("other").alias("others"))
    out = scratch.table(coded.select("node", "code").join(lists, coded["node"] == lists["of"], "left").select("node", "code", "others"))
    scratch.drop(coded, graph)
    return out


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact cosines of queries and nodes, with the ids that each node stands for."""
    for batch in batches:
        x, y = (_scaled(_rows(batch.column(c), np.float64)) for c in ("target", "embedding"))
        near = np.einsum("ij,ij->i", x, y) / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y)))
        yield pa.RecordBatch.from_arrays([batch.column("query"), pa.array(near, pa.float64()), batch.column("ids")], ["query", "near", "ids"])


_STATE = "query bigint, code binary, nodes array<bigint>, near array<float>, done array<boolean>"


def _walked(state: pa.Table, met: pa.Table) -> pa.Table:
    """A query's nodes after a step: those expanded are done, those met join, the nearest stay."""
    if not state.num_rows:
        return state
    nodes, near, done = (state.column(c)[0].values.to_numpy(zero_copy_only=False).copy() for c in ("nodes", "near", "done"))
    done[np.flatnonzero(~done)[:EXPAND]] = True
    if met.num_rows:
        found = met.column("node").to_numpy()
        new = ~np.isin(found, nodes)
        codes = _unit(_blobs(met.column("code").combine_chunks()))[new]
        nodes = np.concatenate((nodes, found[new]))
        near = np.concatenate((near, codes @ _unit(_blobs(state.column("code").combine_chunks()))[0])).astype(np.float32)
        done = np.concatenate((done, np.zeros(int(new.sum()), bool)))
    best = np.lexsort((nodes, -near))[:POOL]
    return pa.table({
        "query": state.column("query"), "code": state.column("code"), "nodes": pa.array([nodes[best]], pa.list_(pa.int64())),
        "near": pa.array([near[best]], pa.list_(pa.float32())), "done": pa.array([done[best]], pa.list_(pa.bool_())),
    })


def search(
    vectors: DataFrame, queries, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", **graph_options,
) -> DataFrame:
    """The ``k`` nearest other rows by cosine of each row for which ``queries`` (a condition on the id) holds.

    Returns ``query_id``, ``rank`` (from 1, nearest first, ties to the smaller id), ``vec_id`` and ``score``
    (the cosine of the vectors as given, in double precision). Which neighbours are found is approximate,
    their scores and order are exact.

    Equal vectors are one node of the graph; a node stands for its ``k + 1`` smallest ids, which is all
    that a result can hold. A query starts at its own node and expands the nearest nodes it knows until the
    ``POOL`` nearest are expanded. Null ids, and vectors that are null, empty, zero or hold null or
    non-finite components take no part, as query or candidate. With fewer candidates than ``k`` all are
    returned if the graph reaches them, as it does on small tables. An empty table has no results. Other
    columns are not read.
    """
    scratch = Scratch(vectors.sparkSession)
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"))
    rows = usable(rows)
    rows = scratch.table(rows)
    nodes = scratch.table(_distinct(rows, k + 1))
    graph = build_graph(nodes, **graph_options)
    # Only the queries' own rows are joined by their vectors, to find their nodes.
    wanted = rows.where(queries).select(F.col("vec_id").alias("query"), "embedding")
    asked = wanted.join(nodes.select("embedding", "node"), "embedding").select("query", "node", F.col("embedding").alias("target"))
    asked = scratch.table(asked)
    state = scratch.table(asked.join(graph.select("node", "code"), "node").select(
        "query", "code", F.array("node").alias("nodes"), F.array(F.lit(1.0).cast("float")).alias("near"), F.array(F.lit(False)).alias("done")
    ))
    for _ in range(SEARCH):
        pairs = F.expr("slice(filter(arrays_zip(nodes, done), p -> NOT p.done), 1, " + str(EXPAND) + ")")
        open_ = state.select(F.col("query").alias("asker"), F.explode(pairs).alias("p")).select("asker", F.col("p.nodes").alias("node"))
        if open_.isEmpty():
            break
        reached = open_.join(graph.select("node", "others"), "node").select("asker", F.explode("others").alias("node")).distinct()
        met = reached.join(graph.select("node", "code"), "node").select("asker", "node", "code")
        after = scratch.table(state.groupBy("query").cogroup(met.groupBy("asker")).applyInArrow(_walked, _STATE))
        scratch.drop(state)
        state = after
    pool = state.select("query", F.explode("nodes").alias("node"))
    held = pool.join(nodes, "node").join(asked.select("query", "target"), "query").select("query", "target", "embedding", "ids")
    exact = held.mapInArrow(_measured, "query bigint, near double, ids array<bigint>")
    found = exact.select("query", F.explode("ids").alias("vec_id"), "near").where("vec_id <> query")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("near"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(
        F.col("query").alias("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", F.col("near").alias("score")
    )
