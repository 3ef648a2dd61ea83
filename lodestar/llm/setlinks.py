"""Links between documents by their whole sets: pairs confirmed, and regions of documents finished in blocks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.frames import Scratch, slices, text_bytes
from lodestar.llm.words import shingles, word_hashes

#: Documents and shingles of a block, on the mean; and shared shingles that one matrix product takes.
BLOCK_DOCS, BLOCK_SHINGLES, BLOCK_COLUMNS = 2048, 1 << 21, 4096
#: Classes of shingles that a profile counts.
PROFILE = 64


def sets_of(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text of ``batch``, sorted, and where each text's begin."""
    hashes, firsts = word_hashes(*text_bytes(batch.column("text")))
    return shingles(hashes, firsts, size)


def full_sets(size: int):
    """``(doc_id, text)`` as ``(doc_id, members, profile)``: the bytes of the sorted set, where it is not empty, and how many
    of each of ``PROFILE`` classes of shingles it holds. Two sets share no more than the smaller counts add up to.

    Of rows in a row with the same id and the same set the first is given; a merge join puts an id's rows in a row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, set()
        for batch in batches:
            for part in slices(batch, "text"):
                sets, firsts = sets_of(part, size)
                take, blobs, profiles = [], [], []
                for i, doc in enumerate(part.column("doc_id").to_pylist()):
                    if doc != last:
                        last, seen = doc, set()
                    blob = sets[firsts[i] : firsts[i + 1]].tobytes()
                    if blob and (digest := hashlib.blake2b(blob, digest_size=16).digest()) not in seen:
                        seen.add(digest)
                        take.append(i)
                        blobs.append(blob)
                        classes = (sets[firsts[i] : firsts[i + 1]] % np.uint64(PROFILE)).astype(np.int64)
                        profiles.append(np.bincount(classes, minlength=PROFILE).astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(take, pa.int64())), pa.array(blobs, pa.binary()), pa.array(profiles, pa.binary())], ["doc_id", "members", "profile"]
                )

    return run


def _confirmed(percent: int):
    """Keep the pairs whose full sets reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("set_a"), batch.column("set_b"))):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate((x, y))
                both.sort()
                same = int((both[1:] == both[:-1]).sum())
                linked[i] = 100 * same >= percent * (len(x) + len(y) - same)
            yield batch.select(["a", "b"]).filter(pa.array(linked))

    return run


def _profiles(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in column), "<u4").reshape(-1, PROFILE).astype(np.int64)


def may_link(same: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    return 100 * same >= percent * (n + m - same)


def _possible(percent: int):
    """Keep the pairs that may reach the similarity by their profiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = _profiles(batch.column("profile_a")), _profiles(batch.column("profile_b"))
            yield batch.select(["a", "b"]).filter(pa.array(may_link(np.minimum(x, y).sum(1), x.sum(1), y.sum(1), percent)))

    return run


def verified(scratch: Scratch, sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` that are links; whole sets are read for pairs that their profiles allow."""
    kind = sets.schema["doc_id"].dataType.simpleString()

    def both(pairs: DataFrame, column: str, name: str) -> DataFrame:
        sides = [sets.select(F.col("doc_id").alias(x), F.col(column).alias(f"{name}_{x}")) for x in "ab"]
        return pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", f"{name}_a", f"{name}_b")

    likely_pairs = scratch.table(both(pairs, "profile", "profile").mapInArrow(_possible(percent), f"a {kind}, b {kind}").distinct())
    links = scratch.table(both(likely_pairs, "members", "set").mapInArrow(_confirmed(percent), f"a {kind}, b {kind}"))
    scratch.drop(likely_pairs)
    return links


def likely(percent: int, n: str, m: str) -> str:
    """Sets whose sizes differ too much cannot be similar enough."""
    return f"100 * least({n}, {m}) >= {percent} * greatest({n}, {m})"


def intersections(rows: list[np.ndarray], columns: list[np.ndarray]) -> np.ndarray:
    """How many elements each of ``rows`` shares with each of ``columns``.

    Elements are numbered, those of one side only are left out, and so many of them at a time as a column of two
    narrow matrices are multiplied, so memory does not grow with the elements.
    """
    out = np.zeros((len(rows), len(columns)))
    flat = np.concatenate([*rows, *columns])
    edge = sum(map(len, rows))
    order = np.argsort(flat, kind="stable")
    new = np.concatenate(([True], flat[order][1:] != flat[order][:-1]))[: len(flat)]
    number = np.cumsum(new) - 1
    total = int(number[-1]) + 1 if len(flat) else 0
    left = order < edge
    both = (np.bincount(number[left], minlength=total) > 0) & (np.bincount(number[~left], minlength=total) > 0)
    keep = both[number]
    order, number = order[keep], (np.cumsum(both) - 1)[number[keep]]
    owner = np.repeat(np.arange(len(rows) + len(columns)), [*map(len, rows), *map(len, columns)])[order]
    left = order < edge
    for start in range(0, int(both.sum()), BLOCK_COLUMNS):
        a, b = np.searchsorted(number, (start, start + BLOCK_COLUMNS))
        sides = []
        for side, base, count in ((left[a:b], 0, len(rows)), (~left[a:b], len(rows), len(columns))):
            held = np.zeros((count, min(BLOCK_COLUMNS, int(both.sum()) - start)), np.float32)
            held[owner[a:b][side] - base, number[a:b][side] - start] = 1
            sides.append(held)
        out += sides[0] @ sides[1].T
    return out


def sides_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a group's two blocks; those of one block meet each other."""
    sides = table.column("side").to_numpy()
    rows = np.flatnonzero(sides == 0)
    return rows, np.flatnonzero(sides == 1) if sides.any() else rows


def labels_of(table: pa.Table) -> np.ndarray:
    return np.unique(table.column("label").to_numpy(zero_copy_only=False), return_inverse=True)[1]


def _with_partners(percent: int):
    """The documents of two blocks of a region that may be linked with one of another component, by their profiles."""

    def run(table: pa.Table) -> pa.Table:
        rows, columns = sides_of(table)
        labels, profiles = labels_of(table), _profiles(table.column("profile"))
        sizes = profiles.sum(1)
        found = np.zeros(table.num_rows, bool)
        for a in range(0, len(rows), BLOCK_DOCS // 4):
            own = rows[a : a + BLOCK_DOCS // 4]
            for c in range(0, len(columns), BLOCK_DOCS):
                other = columns[c : c + BLOCK_DOCS]
                same = np.zeros((len(own), len(other)), np.int64)
                for i in range(PROFILE):
                    same += np.minimum(profiles[own, i][:, None], profiles[other, i][None, :])
                may = may_link(same, sizes[own][:, None], sizes[other][None, :], percent) & (labels[own][:, None] != labels[other][None, :])
                found[own] |= may.any(1)
                found[other] |= may.any(0)
        return table.select(["region", "doc_id"]).filter(pa.array(found))

    return run


class Joined:
    """Components of labels that are joined by and by, and the pairs of documents that joined two."""

    def __init__(self, labels: np.ndarray):
        self.labels, self.parent = labels, np.arange(labels.max() + 1)
        self.found: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def apart(self, x: int, y: int) -> bool:
        return self.root(self.labels[x]) != self.root(self.labels[y])

    def join(self, x: int, y: int) -> None:
        p, q = self.root(self.labels[x]), self.root(self.labels[y])
        if p != q:
            self.parent[p] = q
            self.found.append((x, y))

    def links(self, table: pa.Table) -> pa.Table:
        doc = table.column("doc_id")
        return pa.table([doc.take(pa.array([p[k] for p in self.found], pa.int64())) for k in (0, 1)], ["a", "b"])


def _block_links(percent: int):
    """Links that connect the components of two blocks of a region, no more than connect them."""

    def run(table: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("members")]
        rows, columns = sides_of(table)
        sizes = np.array([len(s) for s in sets], np.float64)
        joined = Joined(labels_of(table))
        labels = joined.labels
        # A hash deals the blocks, so one may hold some more than the mean.
        for a in range(0, len(rows), BLOCK_DOCS):
            for c in range(0, len(columns), BLOCK_DOCS):
                own, other = rows[a : a + BLOCK_DOCS], columns[c : c + BLOCK_DOCS]
                same = intersections([sets[i] for i in own], [sets[i] for i in other])
                linked = may_link(same, sizes[own][:, None], sizes[other][None, :], percent)
                linked &= labels[own][:, None] != labels[other][None, :]
                for x, y in zip(*np.nonzero(linked)):
                    joined.join(own[x], other[y])
        return joined.links(table)

    return run


def blocks_of(mixed: DataFrame) -> DataFrame:
    """``mixed(region, doc_id, n_shingles, label)`` dealt into pairs of blocks ``(region, i, j)``, ``side`` telling which of two.

    A region's documents are dealt into blocks of bounded documents and shingles, those of its most frequent label
    apart, and every two blocks meet, unless both are of that label.
    """
    blocks = lambda n, w: F.greatest(F.ceil(F.col(n) / BLOCK_DOCS), F.ceil(F.col(w) / BLOCK_SHINGLES)).cast("int")
    held = mixed.groupBy("region", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("w"))
    held = held.groupBy("region").agg(
        F.max_by("label", "n").alias("most"), F.max("n").alias("n_most"), F.max_by("w", "n").alias("w_most"),
        F.sum("n").alias("n"), F.sum("w").alias("w"),
    ).withColumns({"n_rest": F.col("n") - F.col("n_most"), "w_rest": F.col("w") - F.col("w_most")}).where("n_rest > 0")
    held = held.select("region", "most", blocks("n_rest", "w_rest").alias("rest"), blocks("n_most", "w_most").alias("more"))
    draw = F.xxhash64("doc_id")
    dealt = mixed.join(held, "region").withColumn("is_most", F.col("label") == F.col("most"))
    dealt = dealt.withColumn("own", F.when(F.col("is_most"), F.col("rest") + F.pmod(draw, F.col("more"))).otherwise(F.pmod(draw, F.col("rest"))).cast("int"))
    last = F.when(F.col("is_most"), F.col("rest")).otherwise(F.col("rest") + F.col("more")) - 1
    dealt = dealt.select("region", "doc_id", "label", "own", F.explode(F.sequence(F.lit(0), last)).alias("other"))
    return dealt.select(
        "region", "doc_id", "label", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        (F.col("own") > F.col("other")).cast("int").alias("side"),
    )


def finished(scratch: Scratch, mixed: DataFrame, sets: DataFrame, percent: int, by_profile: bool = True) -> DataFrame:
    """All links between components inside the regions ``mixed(region, doc_id, n_shingles, label)``.

    Blocks of documents meet in a task: first ``by_profile``, which leaves the documents that may have
    a partner in their region, then by whole sets. No pair of documents becomes a row; a task returns links
    that connect components, fewer than documents.
    """
    kind = sets.schema["doc_id"].dataType.simpleString()
    keys = ("region", "i", "j")
    some = mixed = mixed.select("region", "doc_id", "n_shingles", "label")
    if by_profile:
        some = blocks_of(mixed).join(sets.select("doc_id", "profile"), "doc_id").groupBy(*keys).applyInArrow(_with_partners(percent), f"region bigint, doc_id {kind}")
        some = scratch.table(mixed.join(some.distinct(), ["region", "doc_id"]))
    met = blocks_of(some).join(sets.select("doc_id", "members"), "doc_id").groupBy(*keys).applyInArrow(_block_links(percent), f"a {kind}, b {kind}")
    links = scratch.table(met.distinct())
    scratch.drop(some)
    return links
