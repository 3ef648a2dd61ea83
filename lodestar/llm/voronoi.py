"""Exact n-gram Jaccard join: regions of documents around pivots, opened by the triangle inequality."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.frames import Scratch, large_list, mix, seeds, slices
from lodestar.llm.graph import components
from lodestar.llm.setlinks import BLOCK_DOCS, Joined, blocks_of, finished, full_sets, labels_of, may_link, sets_of, sides_of, verified

#: Pivots of a region that is split, the documents up to which a region is not, and documents measured in one task.
PIVOTS, SMALL, SLICE = 8, 1024, 512
#: Classes of shingles that a profile counts at least, and shingles of a set for each of them at most.
CLASSES, PER_CLASS = 64, 64
#: A region of which one cell keeps more than this share of the documents is finished without a split.
SHRINK = 0.7


def parts(sets: np.ndarray, firsts: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The parts of each set that are pivots of the first level, as 64-bit keys, and where each set's begin.

    The universe of shingles is halved again and again by the bits of their hashes. Two sets of similarity t have
    at least t in one of the two halves. So there is a way down on which they keep it, until they hold together so
    few shingles that one more or less would break t: there their parts are equal and not empty. Given are all
    parts of so few shingles whose half above holds enough of them to be above such a part.
    """
    few = -(-100 // (100 - percent)) - 1 if percent < 100 else 0
    enough = -(-percent * (few + 1) // 100)
    summed = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(sets ^ seeds(1, 11)[0]), dtype=np.uint64)))
    low, high = firsts[:-1].astype(np.int64), firsts[1:].astype(np.int64)
    owner = np.arange(len(low))
    keys, owners = [], []
    for depth in range(65):
        size = high - low
        give = (size > 0) & ((size <= few) if few else (depth == 0))
        keys.append(mix(summed[high[give]] - summed[low[give]] + seeds(65, 12)[depth]))
        owners.append(owner[give])
        open_ = size >= max(enough, 1)
        if depth == 64 or not few or not open_.any():
            break
        low, high, owner = low[open_], high[open_], owner[open_]
        ones = np.concatenate((np.zeros(1, np.int64), np.cumsum((sets >> np.uint64(63 - depth)) & np.uint64(1), dtype=np.int64)))
        middle = high - (ones[high] - ones[low])
        low, high, owner = np.concatenate((low, middle)), np.concatenate((middle, high)), np.concatenate((owner, owner))
    key, owner = np.concatenate(keys), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return key[order], np.searchsorted(owner[order], np.arange(len(firsts)))


def profile(members: np.ndarray) -> bytes:
    """How many shingles of a set fall in each of some classes, more classes for a larger set."""
    classes = CLASSES
    while len(members) > classes * PER_CLASS:
        classes *= 2
    return np.bincount((members % np.uint64(classes)).astype(np.int64), minlength=classes).astype("<u4").tobytes()


def _folded(profile: bytes, classes: int) -> np.ndarray:
    return np.frombuffer(profile, "<u4").astype(np.int64).reshape(-1, classes).sum(0)


def may_be_linked(x: bytes, y: bytes, percent: int) -> bool:
    """Two sets share no more than the smaller counts of their classes add up to."""
    classes = min(len(x), len(y)) // 4
    a, b = _folded(x, classes), _folded(y, classes)
    return bool(may_link(np.minimum(a, b).sum(), a.sum(), b.sum(), percent))


def _likely_pairs(percent: int):
    """Keep the pairs that may be links by their profiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("profile_a").to_pylist(), batch.column("profile_b").to_pylist()
            may = np.array([may_be_linked(p, q, percent) for p, q in zip(x, y)], bool)
            yield batch.select(["a", "b"]).filter(pa.array(may))

    return run


def _likely_links(percent: int):
    """Likely pairs that connect the components of two blocks of a region, no more than connect them."""

    def run(table: pa.Table) -> pa.Table:
        rows, columns = sides_of(table)
        joined = Joined(labels_of(table))
        profiles = table.column("profile").to_pylist()
        coarse = np.stack([_folded(p, CLASSES) for p in profiles])
        sizes, labels = coarse.sum(1), joined.labels
        for a in range(0, len(rows), BLOCK_DOCS // 4):
            own = rows[a : a + BLOCK_DOCS // 4]
            for c in range(0, len(columns), BLOCK_DOCS):
                other = columns[c : c + BLOCK_DOCS]
                same = np.zeros((len(own), len(other)), np.int64)
                for i in range(CLASSES):
                    same += np.minimum(coarse[own, i][:, None], coarse[other, i][None, :])
                may = may_link(same, sizes[own][:, None], sizes[other][None, :], percent) & (labels[own][:, None] != labels[other][None, :])
                for x, y in zip(*np.nonzero(may)):
                    if joined.apart(own[x], other[y]) and may_be_linked(profiles[own[x]], profiles[other[y]], percent):
                        joined.join(own[x], other[y])
        return joined.links(table)

    return run


def _coded(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets, firsts = sets_of(part, size)
                keys, begins = parts(sets, firsts, percent)
                digests = [hashlib.blake2b(sets[a:b].tobytes(), digest_size=16).digest() for a, b in zip(firsts[:-1], firsts[1:])]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(firsts)), pa.array(digests, pa.binary()),
                     pa.array([profile(sets[a:b]) for a, b in zip(firsts[:-1], firsts[1:])], pa.binary()), large_list(keys.view(np.int64), begins, pa.int64())],
                    ["doc_id", "n_shingles", "digest", "profile", "parts"],
                )

    return run


def distances(sets: list[np.ndarray], pivots: list[np.ndarray]) -> np.ndarray:
    """The Jaccard distance of each set to each pivot."""
    flat = np.concatenate(sets)
    begins = np.cumsum([0, *map(len, sets)])[:-1]
    sizes = np.array([len(s) for s in sets], float)
    out = np.empty((len(sets), len(pivots)))
    for j, pivot in enumerate(pivots):
        at = np.searchsorted(pivot, flat)
        at[at == len(pivot)] = 0
        same = np.add.reduceat((pivot[at] == flat).astype(np.int64), begins).astype(float)
        out[:, j] = 1 - same / (sizes + len(pivot) - same)
    return out


def _regions(percent: int):
    """A slice of a region with the region's pivots: the pivots' regions that each document is in, and its link to one."""
    # Somewhat wider than twice the distance of a link, for what floating point rounds off.
    window, edge = 2 * (1 - percent / 100) + 1e-9, (1 - percent / 100) + 1e-12

    def run(table: pa.Table) -> pa.Table:
        is_pivot = table.column("is_pivot").to_numpy(zero_copy_only=False)
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("members")]
        own, centre = np.flatnonzero(~is_pivot), np.flatnonzero(is_pivot)
        if not len(own):
            return table.select(["region", "doc_id"]).slice(0, 0).append_column("pivot", table.column("doc_id").slice(0, 0)).append_column("linked", pa.array([], pa.bool_()))
        far = distances([sets[i] for i in own], [sets[i] for i in centre])
        # In the region of the nearest pivot, and in those that a document so near could belong to.
        row, column = np.nonzero(far <= far.min(1)[:, None] + window)
        take = pa.array(own[row])
        return pa.table([table.column("region").take(take), table.column("doc_id").take(take), table.column("doc_id").take(pa.array(centre[column])), pa.array(far[row, column] <= edge)],
                        ["region", "doc_id", "pivot", "linked"])

    return run


def _split(scratch: Scratch, large: DataFrame, sets: DataFrame, percent: int, level: int) -> tuple[DataFrame, DataFrame]:
    """The regions ``large(region, n, doc_id, n_shingles, label)`` as regions around pivots of their own, with their ``parent``,
    and the likely links to pivots.

    Two documents with a link stand together in the region that is home to one of them: with o at home at p and q at
    home at r, d(o, r) <= d(q, r) + e <= d(q, p) + e <= d(o, p) + 2e, so o is also in the region of r.
    """
    kind = sets.schema["doc_id"].dataType.simpleString()
    drawn = large.groupBy("region").agg(*[F.min_by("doc_id", F.xxhash64("doc_id", F.lit(PIVOTS * level + i))).alias(f"p{i}") for i in range(PIVOTS)], F.max("n").alias("n"))
    drawn = drawn.select("region", "n", F.explode(F.array_distinct(F.array(*[f"p{i}" for i in range(PIVOTS)]))).alias("doc_id"))
    cut = F.ceil(F.col("n") / SLICE).cast("int")
    rows = large.select("region", "doc_id", F.pmod(F.xxhash64("doc_id", F.lit(level)), cut).cast("int").alias("slice"), F.lit(False).alias("is_pivot"))
    centres = drawn.select("region", "doc_id", F.explode(F.sequence(F.lit(0), cut - 1)).alias("slice"), F.lit(True).alias("is_pivot"))
    met = rows.unionByName(centres).join(sets.select("doc_id", "members"), "doc_id").groupBy("region", "slice").applyInArrow(_regions(percent), f"region bigint, doc_id {kind}, pivot {kind}, linked boolean")
    met = scratch.table(met.distinct())
    links = met.where("linked AND doc_id <> pivot").select(F.least("doc_id", "pivot").alias("a"), F.greatest("doc_id", "pivot").alias("b")).distinct()
    placed = met.select(F.col("region").alias("parent"), F.xxhash64("region", "pivot").alias("region"), "doc_id")
    return scratch.table(placed.join(large.select("doc_id", "n_shingles").distinct(), "doc_id")), links


def _counted(regions: DataFrame) -> DataFrame:
    """``regions(region, doc_id, …)`` with the number ``n`` of their documents."""
    return regions.join(regions.groupBy("region").agg(F.count(F.lit(1)).alias("n")), "region")


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, percent: int = 90) -> DataFrame:
    """Components of documents linked by ``percent`` per cent or more shared word shingles; exact, no link is missed.

    Returns one row for each row of ``docs``: ``doc_id``, ``n_shingles`` (distinct shingles) and ``component_id`` (the smallest
    id reachable over links). Columns of other names, whatever they are called, are not read. Shingles are compared by 64-bit hashes.

    * Equal sets form a class, found by their digest; only its smallest id goes on.
    * First level: texts that have nothing in common are all at distance 1 of each other and of any document that is
      a pivot, so the triangle inequality cannot part them. There the pivots are parts of sets: see ``parts``. Two
      linked documents hold an equal part, distance 0, and every other pivot there is farther than a link can span.
      Of regions with the same documents one stays.
    * In each region documents are compared by profiles, counts of their shingles in some classes, which bound what two
      sets share: first with the region's centre, then, in blocks, what that leaves apart. What likely pairs connect
      is one region from here on, so a document that met its copies in many regions is measured in one.
    * Regions are joined recursively. A larger region takes pivots, each document goes to the nearest (its Voronoi cell), and
      also to each pivot at most twice a link's distance farther; these regions are joined in turn. A region that is
      small, or did not shrink because all its documents lie in the windows, is finished by comparing whole
      sets in blocks of bounded size.

    Nothing is capped: every pair of documents that may be a link, and is not in one component yet, is compared.

    Null, empty and blank texts have no shingles and no links. A text of fewer than ``shingle`` words is one shingle. Rows
    that share an id are one document: links of any of them hold for all. Repeated rows get the same answer each.
    Rows without an id get a null component. An empty table gives an empty table.
    """
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    coded = scratch.table(docs.mapInArrow(_coded(shingle, percent), f"doc_id {kind}, n_shingles bigint, digest binary, profile binary, parts array<bigint>"))
    usable = coded.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = scratch.table(usable.groupBy("digest").agg(F.min("doc_id").alias("rep")))
    # Equal sets have equal parts, so of any number of repeated rows one goes on.
    reps = usable.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.min("n_shingles").alias("n_shingles"), F.min("parts").alias("parts"))
    placed = reps.select("doc_id", "n_shingles", F.explode("parts").alias("region"))
    # Regions with the same documents have the same number, sum and exclusive or of hashes.
    name = F.xxhash64("doc_id")
    cells = placed.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(name).alias("x"), F.sum(F.pmod(name, F.lit(1 << 31))).alias("s")).where("n > 1")
    cells = cells.groupBy("n", "x", "s").agg(F.min("region").alias("region")).select("region", "n")
    members = scratch.table(placed.join(cells, "region"))
    profiles = usable.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.min("profile").alias("profile")).select("doc_id", "profile").distinct()
    profiles = scratch.table(profiles.join(members.select("doc_id").distinct(), "doc_id", "left_semi"))

    def labelled(regions: DataFrame, labels: DataFrame | None) -> DataFrame:
        if labels is None:
            return regions.withColumn("label", F.col("doc_id"))
        return regions.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))

    def mixed(regions: DataFrame, labels: DataFrame | None) -> DataFrame:
        """Regions of more than one component."""
        at = labelled(regions, labels)
        some = at.groupBy("region").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("region")
        return scratch.table(at.join(some, "region"))

    # Likely pairs: of each region's documents with its centre, the one that meets most others, then those between what is still apart.
    meets = members.groupBy("doc_id").agg(F.sum("n").alias("met"))
    order = F.struct("met", F.xxhash64("doc_id"))
    centre = members.join(meets, "doc_id").groupBy("region").agg(F.max_by("doc_id", order).alias("pivot"))
    met = members.join(centre, "region").where("doc_id <> pivot")
    pairs = met.select(F.least("doc_id", "pivot").alias("a"), F.greatest("doc_id", "pivot").alias("b")).distinct()
    sides = [profiles.select(F.col("doc_id").alias(x), F.col("profile").alias(f"profile_{x}")) for x in "ab"]
    near = [scratch.table(pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "profile_a", "profile_b").mapInArrow(_likely_pairs(percent), f"a {kind}, b {kind}"))]
    # What was compared with all others of its region leaves it.
    rest = members.join(centre, "region").where("doc_id <> pivot AND n > 2").select("region", "doc_id", "n_shingles")
    first = components(scratch, near[0], True)
    apart = mixed(rest, first)
    near.append(scratch.table(
        blocks_of(apart).join(profiles, "doc_id").groupBy("region", "i", "j").applyInArrow(_likely_links(percent), f"a {kind}, b {kind}").distinct()
    ))
    groups = first if near[1].isEmpty() else components(scratch, near[0].unionByName(near[1]), True)
    groups = groups.withColumnRenamed("node", "doc_id")
    scratch.drop(apart, *near)

    own = usable.join(classes, "digest").select("doc_id", "rep")
    shared = own.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a <> z")
    links = [scratch.table(own.join(shared, "doc_id").select("a", F.col("rep").alias("b")))]
    labels = None if links[0].isEmpty() else components(scratch, links[0], True)

    def add(*more: DataFrame) -> DataFrame:
        links.extend(more)
        every = links[0]
        for x in links[1:]:
            every = every.unionByName(x)
        return components(scratch, every, True)

    # Documents that likely pairs connect are a region each; only their whole sets are needed, and each once.
    # Merged whatever its size, so that every run shuffles each text once and not more.
    sets = scratch.table(docs.join(groups.select("doc_id").hint("merge"), "doc_id", "left_semi").mapInArrow(full_sets(shingle), f"doc_id {kind}, members binary, profile binary"))
    sizes = members.select("doc_id", "n_shingles").groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles"))
    regions = groups.select(F.xxhash64("label").alias("region"), "doc_id").join(sizes, "doc_id")
    regions, level = scratch.table(_counted(regions)), 0
    while True:
        left = mixed(regions, labels)
        if left.isEmpty():
            break
        small, large = left.where(F.col("n") <= SMALL), left.where(F.col("n") > SMALL)
        found = finished(scratch, small, sets, percent, by_profile=False)
        if large.isEmpty():
            labels = add(found)
            break
        placed, near = _split(scratch, large, sets, percent, level)
        labels = add(found, verified(scratch, sets, near, percent))
        # Where the windows hold nearly all documents, the region is not split but finished.
        cells = placed.groupBy("parent", "region").agg(F.count(F.lit(1)).alias("n_cell"))
        parents = large.select("region", "n").distinct().withColumnRenamed("region", "parent")
        stuck = scratch.table(cells.join(parents, "parent").where(F.col("n_cell") > SHRINK * F.col("n")).select("parent").distinct())
        if not stuck.isEmpty():
            back = mixed(large.drop("label").join(stuck, F.col("region") == F.col("parent"), "left_semi"), labels)
            labels = add(finished(scratch, back, sets, percent, by_profile=False))
            scratch.drop(back)
        regions = scratch.table(_counted(placed.join(stuck, "parent", "left_anti").drop("parent")))
        scratch.drop(left, placed, stuck)
        level += 1
    scratch.drop(members, profiles, sets, *links)
    rows = coded.select("doc_id", "n_shingles", "digest")
    ends = scratch.spark.createDataFrame([], f"node {kind}, label {kind}") if labels is None else labels
    found = classes.join(ends.withColumnRenamed("node", "rep"), "rep", "left").select(F.col("digest").alias("class_digest"), F.coalesce("label", "rep").alias("component"))
    joined = rows.join(found, (rows["digest"] == found["class_digest"]) & rows["doc_id"].isNotNull(), "left")
    return joined.select(F.col("doc_id").alias(doc_id), "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
