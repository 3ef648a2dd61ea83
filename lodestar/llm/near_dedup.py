"""Near-duplicate documents by fast similarity sketches, banding and exact verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.frames import Scratch, large_list, mix, seeds, slices
from lodestar.llm.graph import components
from lodestar.llm.setlinks import finished, full_sets, likely, sets_of, verified

#: Bands and coordinates a band: a pair of similarity 0.8 shares no band once in some 3 million.
BANDS, ROWS = 64, 7
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def sketch(sets: np.ndarray, firsts: np.ndarray, size: int) -> np.ndarray:
    """Fast similarity sketches of many sets, one row of ``size`` coordinates for each.

    In round i every element is placed in one bin by the round's hash, with the value (i, hash); a
    bin keeps its least value. Rounds ``size`` and later place all elements in the one bin whose
    turn it is, so every coordinate is filled. A set takes part until its bins are full.
    """
    count = len(firsts) - 1
    out = np.full(count * size, _EMPTY)
    lengths = np.diff(firsts)
    active = np.flatnonzero(lengths)
    elements, owner = sets, np.repeat(np.arange(count), lengths)
    salts = seeds(2 * size, 3)
    for i in range(2 * size):
        if not len(active):
            break
        hashed = mix(elements ^ salts[i])
        bins = (hashed >> np.uint64(32)) * np.uint64(size) >> np.uint64(32) if i < size else np.uint64(i - size)
        value = np.uint64(i << 32) | hashed & np.uint64(0xFFFFFFFF)
        np.minimum.at(out, owner * size + np.asarray(bins).astype(np.int64), value)
        open_ = (out.reshape(count, size)[active] == _EMPTY).any(1)
        if not open_.all():
            active = active[open_]
            left = np.zeros(count, bool)
            left[active] = True
            keep = left[owner]
            elements, owner = elements[keep], owner[keep]
    return out.reshape(count, size)


def _bands(rows: np.ndarray, bands: int) -> np.ndarray:
    """One bucket for each band of each sketch; the bucket knows its band."""
    each = rows.reshape(len(rows), bands, -1)
    weights = seeds(each.shape[2], 4) | np.uint64(1)
    return mix((each * weights).sum(2, dtype=np.uint64) + seeds(bands, 5)[None, :]).view(np.int64)


def _sketches(size: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets, firsts = sets_of(part, size)
                buckets = _bands(sketch(sets, firsts, bands * rows), bands)
                lengths = np.diff(firsts)
                digests = [hashlib.blake2b(sets[a:b].tobytes(), digest_size=16).digest() for a, b in zip(firsts[:-1], firsts[1:])]
                ends = np.arange(len(lengths) + 1) * bands
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(lengths), pa.array(digests, pa.binary()), large_list(buckets.ravel(), ends, pa.int64())],
                    ["doc_id", "n_shingles", "digest", "buckets"],
                )

    return run


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80,
    bands: int = BANDS, rows: int = ROWS, star_rounds: int = 1,
) -> DataFrame:
    """Groups of documents linked by ``percent`` per cent or more shared word shingles.

    Returns one row for each row of ``docs``: ``doc_id``, ``n_shingles`` (distinct shingles),
    ``component_id`` (the smallest id reachable over links) and ``kept`` (whether that is the row's
    own id). Columns of other names, whatever they are called, are not read.

    * Equal sets form a class, found by their digest; only its smallest id goes on.
    * Classes meet in the buckets of their sketches' bands. In each bucket all are compared with one
      pivot first, the one that meets most documents over all bands, so a large group of copies
      costs a few comparisons a document. Buckets whose documents are not all in one component
      after ``star_rounds`` such rounds are finished exactly, in blocks of documents whose full sets
      meet in a task. No bucket is capped and no link between components lost.
    * All comparisons use the full sets.

    Null, empty and blank texts have no shingles and no links. A text of fewer than ``shingle`` words
    is one shingle. Rows that share an id are one document: links of any of them hold for all.
    Repeated rows get the same answer each. Rows without an id get a null component and are kept.
    An empty table gives an empty table.
    """
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    sketches = scratch.table(docs.mapInArrow(
        _sketches(shingle, bands, rows), f"doc_id {kind}, n_shingles bigint, digest binary, buckets array<bigint>"
    ))
    usable = sketches.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = scratch.table(usable.groupBy("digest").agg(F.min("doc_id").alias("rep")))
    reps = usable.join(classes, (usable["digest"] == classes["digest"]) & (usable["doc_id"] == classes["rep"]), "left_semi")
    placed = reps.select("doc_id", "n_shingles", F.explode("buckets").alias("bucket"))
    crowded = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = placed.join(crowded, "bucket")
    # How many documents a document meets over all bands: high in the middle of a group of copies.
    members = scratch.table(members.withColumn("met", F.sum("n").over(Window.partitionBy("doc_id"))))
    ids = members.select("doc_id").distinct()
    # Merged whatever its size, so that every run shuffles each text once and not more.
    sets = docs.join(ids.hint("merge"), "doc_id", "left_semi").mapInArrow(full_sets(shingle), f"doc_id {kind}, members binary, profile binary")
    sets = scratch.table(sets)

    own = usable.join(classes, "digest").select("doc_id", "rep")
    shared = own.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a <> z")
    links = [scratch.table(own.join(shared, "doc_id").select("a", F.col("rep").alias("b")))]
    labels = None if links[0].isEmpty() else components(scratch, links[0])
    for turn in range(star_rounds + 1):
        if labels is None:
            at = members.withColumn("label", F.col("doc_id"))
        else:
            at = members.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
        noise = F.pmod(F.xxhash64("doc_id", F.lit(turn)), F.lit(1 << 20))
        order = F.col("met") * (1 << 20) + noise if turn == 0 else noise
        centre = at.groupBy("bucket").agg(
            F.max_by("doc_id", order).alias("pivot"), F.max_by("label", order).alias("pivot_label"), F.max_by("n_shingles", order).alias("m"),
            F.min("label").alias("low"), F.max("label").alias("high"),
        ).where("low <> high")
        mixed = scratch.table(at.join(centre.drop("low", "high"), "bucket"))
        if mixed.isEmpty():
            scratch.drop(mixed)
            break
        if turn < star_rounds:
            met = mixed.where("label <> pivot_label").where(likely(percent, "n_shingles", "m"))
            pairs = scratch.table(met.select(F.least("doc_id", "pivot").alias("a"), F.greatest("doc_id", "pivot").alias("b")).distinct())
            links.append(verified(scratch, sets, pairs, percent))
            scratch.drop(pairs)
        else:
            links.append(finished(scratch, mixed.withColumnRenamed("bucket", "region"), sets, percent))
        scratch.drop(mixed)
        every = links[0]
        for more in links[1:]:
            every = every.unionByName(more)
        labels = components(scratch, every)
    scratch.drop(members, sets, *links)
    rows_ = sketches.select("doc_id", "n_shingles", "digest")
    found = classes.withColumn("label", F.col("rep")) if labels is None else classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    labelled = found.select(F.col("digest").alias("class_digest"), F.coalesce("label", "rep").alias("component"))
    joined = rows_.join(labelled, (rows_["digest"] == labelled["class_digest"]) & rows_["doc_id"].isNotNull(), "left")
    return joined.select(
        F.col("doc_id").alias(doc_id), "n_shingles", F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce(F.coalesce("component", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """``docs`` with one document of each group, the one with the smallest id; all columns stay.

    Rows without an id stay. Of rows that share the kept id each stays.
    """
    found = near_duplicates(docs, doc_id, **options)
    gone = found.where("NOT kept").select(F.col(doc_id).alias("__gone")).distinct()
    return docs.join(gone, docs[doc_id] == gone["__gone"], "left_anti")
