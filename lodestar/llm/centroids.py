"""Centroid clustering of whole-number vectors by a progressive search over Walsh-Hadamard coefficients."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.frames import Scratch

#: Whole components beyond this count as this, so that every distance fits in 64 bits.
LARGEST = 1 << 27
#: Vectors that are compared with the centroids at once.
BLOCK = 4096
_LONG = (1 << 63) - 1


def transform(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard coefficients of each row, those of few sign changes first.

    The rows' length is a power of two. Sums and differences only, so whole numbers stay exact, and the
    squared length of a difference is that of its coefficients divided by the row's length.
    """
    n, width = x.shape
    half = 1
    while half < width:
        pairs = x.reshape(n, width // (2 * half), 2, half)
        x = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), 2).reshape(n, width)
        half *= 2
    return x[:, _sequency(width)]


def restore(coefficients: np.ndarray) -> np.ndarray:
    """The rows of which ``transform`` made ``coefficients``; exact, as every quotient is whole."""
    width = coefficients.shape[1]
    plain = np.empty_like(coefficients)
    plain[:, _sequency(width)] = coefficients
    back = np.empty_like(coefficients)
    back[:, _sequency(width)] = transform(plain)
    return back // width


def _sequency(width: int) -> np.ndarray:
    """The natural index of the coefficient with 0, 1, 2, ... sign changes: its Gray code, bits reversed."""
    bits = width.bit_length() - 1
    gray = np.arange(width) ^ (np.arange(width) >> 1)
    out = np.zeros(width, np.int64)
    for b in range(bits):
        out |= ((gray >> b) & 1) << (bits - 1 - b)
    return out


def nearest(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row of coefficients (ties: the smaller number), and the squared distance times the width.

    Squared differences of coefficients are added from coarse to fine, in steps that double. After each
    step a row's leader, the centroid with the smallest sum so far, is measured over all coefficients;
    centroids whose sum is already larger than the smallest whole distance known are strictly worse and
    go. What stays is finished over all coefficients, so the result is exact. Where the sums might exceed
    64 bits they are made of unbounded whole numbers.
    """
    n, width = rows.shape
    largest = max(int(abs(rows).max(initial=0)), int(abs(centroids).max(initial=0)))
    if width * (2 * largest) ** 2 > _LONG:  # no vector is longer than its largest coefficient
        rows, centroids = rows.astype(object), centroids.astype(object)
    every = np.arange(n)
    sums = np.zeros((n, len(centroids)), rows.dtype)
    alive = np.ones(sums.shape, bool)
    known = np.zeros(sums.shape, bool)
    best = np.full(n, -1, rows.dtype)
    start, stop = 0, 1
    while start < width:
        row, number = np.nonzero(alive)
        step = rows[row, start:stop] - centroids[number, start:stop]
        sums[row, number] += (step * step).sum(1)
        if stop < width:
            most = sums.max() + 1 if n else 0
            leader = np.where(alive, sums, most).argmin(1)
            new = np.flatnonzero(~known[every, leader])
            known[new, leader[new]] = True
            whole = rows[new] - centroids[leader[new]]
            whole = (whole * whole).sum(1)
            best[new] = np.where((best[new] < 0) | (whole < best[new]), whole, best[new])
            alive &= sums <= best[:, None]
        start, stop = stop, min(2 * stop, width)
    most = sums.max() + 1 if n else 0
    winner = np.where(alive, sums, most).argmin(1)
    return winner, sums[every, winner]


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            part = batch.slice(start, BLOCK)
            yield part, part.column("coefficients").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _transformed(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, values in _blocks(batches, width):
            out = transform(values)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, width, dtype=np.int32)), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), lists], ["vec_id", "coefficients"])

    return run


def _sums(centroids: np.ndarray):
    """For each block, cluster and coefficient: the sum, and how many vectors it is of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, width = centroids.shape
        for _, rows in _blocks(batches, width):
            winner, _ = nearest(rows, centroids)
            totals = np.zeros((k, width), np.int64)
            np.add.at(totals, winner, rows)
            counts = np.bincount(winner, minlength=k)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.arange(k), width)), pa.array(np.tile(np.arange(width), k)), pa.array(totals.ravel()), pa.array(np.repeat(counts, width))],
                ["cluster", "place", "total", "n"],
            )

    return run


def _assigned(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = centroids.shape[1]
        for part, rows in _blocks(batches, width):
            winner, distance = nearest(rows, centroids)
            yield pa.RecordBatch.from_arrays(
                [part.column("vec_id"), pa.array(winner.astype(np.int32)), pa.array((distance // width).astype(np.int64))], ["vec_id", "cluster", "distance"]
            )

    return run


def whole_components(column: str, scale: int = 64) -> Column:
    """``floor(scale * x)`` of each component as a whole number, at most ``LARGEST`` either way."""
    return F.expr(f"transform(`{column}`, x -> CAST(greatest(least(floor({scale} * CAST(x AS double)), {LARGEST}), -{LARGEST}) AS bigint))")


def usable(column: str, width: int) -> Column:
    """Whether a vector has ``width`` components, none of them null or not finite."""
    return F.expr(
        f"`{column}` IS NOT NULL AND size(`{column}`) = {width} AND forall(`{column}`, x -> x IS NOT NULL AND NOT isnan(x) AND abs(CAST(x AS double)) < double('infinity'))"
    )


def cluster(
    vectors: DataFrame, k: int = 16, rounds: int = 3, width: int = 64, vec_id: str = "vec_id", column: str = "embedding", salt: str = "1",
) -> DataFrame:
    """Clusters of the vectors around ``k`` centroids after ``rounds`` rounds.

    Vectors of exactly ``width`` components (a power of two), none null or not finite, take part; each component x is
    ``floor(64 * x)``, and beyond 2^27 either way it counts as 2^27. Centroids start as the ``k`` vectors with the
    smallest sha256 of ``<salt>:<vec_id>``, in that order. Each round assigns every vector to its nearest
    centroid and replaces a centroid by the floor of its vectors' mean; empty ones stay.

    Returns one row for each such row of ``vectors``: ``vec_id``, ``cluster``, ``distance`` (squared), ``cluster_inertia`` and
    ``inertia`` (distance summed over the cluster and over all, at most 2^63 - 1) and ``centroid_sha256`` (of the
    final centroid's components, joined by commas). Other columns are not read, whatever their names.

    Repeated rows each take part and get a row. Vectors without an id come last among the first
    centroids; equal hashes are ordered by components. With fewer than ``k`` vectors each starts a centroid. A table without
    such vectors gives an empty table.

    Vectors are transformed once and stay in coefficients: sums of coefficients are the coefficients of sums.
    A round is one pass; each block of vectors leaves ``k`` times ``width`` sums, and only as many reach the driver.
    """
    scratch = Scratch(vectors.sparkSession)
    kind = vectors.schema[vec_id].dataType.simpleString()
    kept = vectors.where(usable(column, width)).select(F.col(f"`{vec_id}`").alias("vec_id"), whole_components(column).alias("coefficients"))
    coded = scratch.table(kept.mapInArrow(_transformed(width), f"vec_id {kind}, coefficients array<bigint>"))
    hashed = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    # Equal hashes are equal ids; their order by coefficients is fixed too.
    first = coded.orderBy(hashed.asc_nulls_last(), "coefficients").limit(k).select("coefficients").collect()
    empty = "vec_id {}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string".format(kind)
    if not first:
        return vectors.sparkSession.createDataFrame([], empty)
    centroids = np.array([r["coefficients"] for r in first], np.int64)
    for _ in range(rounds):
        sums = coded.mapInArrow(_sums(centroids), "cluster bigint, place bigint, total bigint, n bigint")
        sums = sums.groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).where("n > 0")
        totals = np.zeros(centroids.shape, object)
        counts = np.zeros(len(centroids), object)
        for r in sums.collect():
            totals[r["cluster"], r["place"]], counts[r["cluster"]] = int(r["total"]), r["n"]
        full = np.flatnonzero(counts)
        means = restore(totals[full]) // counts[full][:, None]
        centroids[full] = transform(means.astype(np.int64))
    found = scratch.table(coded.mapInArrow(_assigned(centroids), f"vec_id {kind}, cluster int, distance bigint"))
    per = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in restore(centroids).tolist()]
    scratch.drop(coded)
    whole = min(sum(per.values()), _LONG)
    # At most k entries each.
    inertia = F.element_at(F.array(*[F.lit(min(per.get(i, 0), _LONG)).cast("bigint") for i in range(len(centroids))]), F.col("cluster") + 1)
    digest = F.element_at(F.array(*[F.lit(d) for d in digests]), F.col("cluster") + 1)
    return found.select(
        F.col("vec_id").alias(vec_id), "cluster", "distance", inertia.alias("cluster_inertia"), F.lit(whole).cast("bigint").alias("inertia"), digest.alias("centroid_sha256")
    )
