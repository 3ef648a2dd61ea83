"""Ranked lexical search: sharded block indexes of word counts, searched by Block-Max MaxScore."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.frames import Scratch, slices, text_bytes
from lodestar.llm.words import word_hashes

#: Most bytes of text and documents of a shard (a document's number in it has 16 bits), and postings of a block.
SHARD_BYTES, SHARD_DOCS, BLOCK = 16 << 20, 1 << 16, 128
#: Documents of a shard that are ranked at once, and queries that search a shard in one task.
WINDOW, QUERY_BLOCK = 4096, 256

_TERM = np.ones(256, bool)
_TERM[:128] = [chr(i).isalnum() for i in range(128)]

#: One block of a list: its first and last document, postings, bytes of a gap and of a count, where its
#: bytes start, and the largest part of a score (without the term's weight) that one of its postings makes.
HEADER = np.dtype([("first", "<u4"), ("last", "<u4"), ("count", "<u4"), ("gap_bytes", "u1"), ("count_bytes", "u1"), ("start", "<u8"), ("top", "<i8")])


def term_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each term of the texts starts and ends: a longest run of ASCII letters and digits and of bytes
    beyond ASCII, inside one text."""
    inside = np.concatenate(([False], _TERM[data], [False]))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:] & (edge | ~inside[:-1]))
    ends = np.flatnonzero(inside[:-1] & (edge | ~inside[1:]))
    return starts, ends


def parts_of_score(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term's count ``tf`` in a document of length norm ``m`` makes of a score, before the term's weight."""
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def norms(n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """Length norms of documents of ``n`` terms, of ``docs`` documents with ``terms`` terms in all."""
    return 50 + 50 * n * docs // max(terms, 1)


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs = terms = 0
    for batch in batches:
        for part in slices(batch, "text"):
            data, offsets = text_bytes(part.column("text"))
            starts, _ = term_spans(data, offsets)
            n = np.diff(np.searchsorted(starts, offsets))
            docs += int((n > 0).sum())
            terms += int(n.sum())
    yield pa.RecordBatch.from_arrays([pa.array([docs]), pa.array([terms])], ["docs", "terms"])


class _Shard:
    """Documents gathered for one shard, as counts of each term in each document."""

    def __init__(self):
        self.ids: list[pa.Array] = []
        self.n: list[np.ndarray] = []
        self.terms: list[np.ndarray] = []
        self.docs: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.size = self.bytes = 0

    def add(self, part: pa.RecordBatch) -> None:
        data, offsets = text_bytes(part.column("text"))
        hashes, firsts = word_hashes(data, offsets, term_spans(data, offsets))
        n = np.diff(firsts)
        doc = np.repeat(np.arange(len(n)), n)
        order = np.lexsort((hashes, doc))
        hashes, doc = hashes[order], doc[order]
        new = np.flatnonzero(np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])))[: len(hashes)])
        self.ids.append(part.column("doc_id"))
        self.n.append(n)
        self.terms.append(hashes[new])
        self.docs.append(doc[new] + self.size)
        self.counts.append(np.diff(np.append(new, len(hashes))))
        self.size += part.num_rows
        self.bytes += len(data)

    def rows(self, shard: int, docs: int, terms: int) -> Iterator[pa.RecordBatch]:
        """One row of the shard's documents, then one for each of its terms."""
        n = np.concatenate(self.n)
        m = norms(n, docs, terms)
        ids = pa.concat_arrays(self.ids)
        kind = pa.list_(ids.type)
        yield pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int64()), pa.array([None], pa.int64()), pa.array([0], pa.int64()), pa.array([m.astype("<i8").tobytes()], pa.binary()),
             pa.array([None], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)], _INDEX)
        term, doc, count = (np.concatenate(x) for x in (self.terms, self.docs, self.counts))
        order = np.argsort(term, kind="stable")  # documents stay in order
        term, doc, count = term[order], doc[order], count[order]
        begins = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1]))[: len(term)])
        headers, blocks_of, payload, bytes_of = pack(doc, count, parts_of_score(count, m[doc]), begins)
        lists = len(begins)
        raw = headers.view(np.uint8).reshape(-1)
        for a in range(0, lists, SHARD_DOCS):
            b = min(a + SHARD_DOCS, lists)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(b - a, shard, np.int64)), pa.array(term[begins[a:b]].view(np.int64)),
                 pa.array(np.diff(np.append(begins, len(term))[a : b + 1]).astype(np.int64)),
                 _binaries(raw, blocks_of[a : b + 1] * HEADER.itemsize), _binaries(payload, bytes_of[a : b + 1]), pa.nulls(b - a, kind)], _INDEX)


_INDEX = ["shard", "term", "df", "blocks", "data", "ids"]


def _binaries(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    start = int(offsets[0])
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((offsets - start).astype(np.int32)), pa.py_buffer(data[start : int(offsets[-1])].tobytes())])


def pack(doc: np.ndarray, count: np.ndarray, parts: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lists of postings as blocks: headers, the first header of each list, bytes, and where each list's bytes begin.

    A block has the gaps between its documents and then its counts, each in as few bytes as its largest needs.
    """
    total = len(doc)
    sizes = np.diff(np.append(begins, total))
    per = -(-sizes // BLOCK)
    blocks_of = np.concatenate(([0], np.cumsum(per)))
    owner = np.repeat(np.arange(len(begins)), per)
    start = begins[owner] + (np.arange(len(owner)) - blocks_of[owner]) * BLOCK
    held = np.minimum(start + BLOCK, (begins + sizes)[owner]) - start
    gap = np.diff(doc, prepend=0)
    gap[start] = 0
    headers = np.zeros(len(start), HEADER)
    if not total:
        return headers, blocks_of, np.zeros(0, np.uint8), np.zeros(1, np.int64)
    width = lambda most: 1 + (most > 0xFF) + 2 * (most > 0xFFFF)
    headers["first"], headers["last"], headers["count"] = doc[start], doc[start + held - 1], held
    headers["gap_bytes"], headers["count_bytes"] = width(np.maximum.reduceat(gap, start)), width(np.maximum.reduceat(count, start))
    headers["top"] = np.maximum.reduceat(parts, start)
    size = held * (headers["gap_bytes"].astype(np.int64) + headers["count_bytes"])
    ends = np.cumsum(size)
    at = ends - size
    bytes_of = np.append(at, ends[-1])[blocks_of]
    headers["start"] = at - bytes_of[owner]
    payload = np.zeros(int(ends[-1]), np.uint8)
    block = np.repeat(np.arange(len(start)), held)
    place = np.arange(total) - start[block]
    for values, wide, base in ((gap, headers["gap_bytes"], at), (count, headers["count_bytes"], at + held * headers["gap_bytes"])):
        wide = wide.astype(np.int64)
        spot = base[block] + place * wide[block]
        for k in range(int(wide.max())):
            has = wide[block] > k
            payload[spot[has] + k] = (values[has] >> (8 * k)) & 0xFF
    return headers, blocks_of, payload, bytes_of


class Postings:
    """A term's list in a shard: block headers at hand, blocks decompressed when asked for."""

    def __init__(self, blocks: bytes, data: bytes, weight: int):
        self.headers = np.frombuffer(blocks, HEADER)
        self.data = np.concatenate((np.frombuffer(data, np.uint8), np.zeros(4, np.uint8)))
        self.weight = weight
        self.first, self.last = self.headers["first"].astype(np.int64), self.headers["last"].astype(np.int64)
        self.tops = self.headers["top"] * weight
        self.top = int(self.tops.max())
        self.decompressed = 0
        self._edge: tuple[int, tuple[np.ndarray, np.ndarray]] | None = None

    def between(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents a to b - 1 of the list, and their counts; asked for window after window."""
        start, stop = int(np.searchsorted(self.last, a)), int(np.searchsorted(self.first, b))
        if start >= stop:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        # A block that reaches into the next window is kept for it.
        parts = [self._edge[1]] if self._edge and self._edge[0] == start else []
        if start + len(parts) < stop:
            parts.append(self.decompress(np.arange(start + len(parts), stop)))
        doc, count = (np.concatenate(x) for x in zip(*parts))
        if self.last[stop - 1] >= b:
            held = int(self.headers["count"][stop - 1])
            self._edge = stop - 1, (doc[-held:], count[-held:])
        inside = (doc >= a) & (doc < b)
        return doc[inside], count[inside]

    def block_of(self, docs: np.ndarray) -> np.ndarray:
        """The only block that can hold each document, -1 where none can."""
        at = np.searchsorted(self.last, docs)
        out = np.minimum(at, len(self.last) - 1)
        return np.where((at < len(self.last)) & (self.first[out] <= docs), out, -1)

    def decompress(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(blocks):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.decompressed += len(blocks)
        h = self.headers[blocks]
        held = h["count"].astype(np.int64)
        ends = np.cumsum(held)
        block = np.repeat(np.arange(len(h)), held)
        place = np.arange(int(ends[-1])) - (ends - held)[block]
        gap_bytes, count_bytes, start = (h[c].astype(np.int64) for c in ("gap_bytes", "count_bytes", "start"))
        gap = self._read(start[block] + place * gap_bytes[block], gap_bytes, block)
        count = self._read((start + held * gap_bytes)[block] + place * count_bytes[block], count_bytes, block)
        run = np.cumsum(gap)
        return h["first"].astype(np.int64)[block] + run - run[ends - held][block], count

    def _read(self, spot: np.ndarray, wide: np.ndarray, block: np.ndarray) -> np.ndarray:
        out = self.data[spot].astype(np.int64)
        for k in range(1, int(wide.max())):
            out |= np.where(wide[block] > k, self.data[spot + k].astype(np.int64) << (8 * k), 0)
        return out


def best_documents(lists: list[Postings], m: np.ndarray, order: np.ndarray, k: int, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` documents of a shard with the largest scores above 0, best first, and their scores.

    ``m`` are the documents' length norms, ``order`` their places in the order that breaks ties. Lists are ordered
    by the most they can add. As long as ``k`` documents are known, the first lists, which together add less than
    the k-th score, are not essential: a document that stands only in those cannot enter. Documents
    are ranked window after window: the essential lists give candidates and what they score there; from
    list to list of the rest, a candidate goes if its score so far, its block's most and the most of the
    lists left cannot reach the k-th score; only blocks with candidates left are decompressed.
    """
    lists = sorted((x for x in lists if x.top > 0), key=lambda x: x.top)
    most = np.concatenate(([0], np.cumsum([x.top for x in lists]))).astype(np.int64)
    heap_doc, heap_score = np.zeros(0, np.int64), np.zeros(0, np.int64)
    need = 1
    for a in range(0, len(m), window):
        b = min(a + window, len(m))
        essential = int(np.searchsorted(most, need)) - 1  # the lists before it add less than is needed
        if essential >= len(lists):
            break
        sums, seen = np.zeros(b - a, np.int64), np.zeros(b - a, bool)
        for x in lists[essential:]:
            doc, count = x.between(a, b)
            sums[doc - a] += x.weight * parts_of_score(count, m[doc])
            seen[doc - a] = True
        doc = np.flatnonzero(seen) + a
        score = sums[doc - a]
        for i in range(essential - 1, -1, -1):
            x = lists[i]
            block = x.block_of(doc)
            can = score + np.where(block >= 0, x.tops[block], 0) + most[i] >= need
            doc, score, block = doc[can], score[can], block[can]
            if not len(doc):
                break
            here, count = x.decompress(np.unique(block[block >= 0]))
            at = np.searchsorted(here, doc)
            at[at == len(here)] = 0
            has = here[at] == doc if len(here) else np.zeros(len(doc), bool)
            score[has] += x.weight * parts_of_score(count[at[has]], m[doc[has]])
        keep = score >= need
        heap_doc, heap_score = np.concatenate((heap_doc, doc[keep])), np.concatenate((heap_score, score[keep]))
        if len(heap_doc) > k:
            best = np.lexsort((order[heap_doc], -heap_score))[:k]
            heap_doc, heap_score = heap_doc[best], heap_score[best]
        if len(heap_doc) == k:
            need = max(1, int(heap_score.min()))
    best = np.lexsort((order[heap_doc], -heap_score))
    return heap_doc[best], heap_score[best]


def _searched(k: int, names: list[str]):
    """Search one shard for one block of queries: its documents, and the lists of the queries' terms."""

    def run(table: pa.Table) -> pa.Table:
        documents = pa.compute.is_null(table.column("term"))
        own = table.filter(documents)
        lists = table.filter(pa.compute.invert(documents))
        ids = pa.concat_arrays([x.flatten() for x in own.column("ids").chunks])
        m = np.frombuffer(own.column("blocks")[0].as_py(), "<i8")
        order = np.empty(len(ids), np.int64)
        order[pa.compute.sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(len(ids))
        queries: dict[int, list[Postings]] = {}
        for blocks, data, weight, items in zip(lists.column("blocks"), lists.column("data"), lists.column("weight"), lists.column("queries")):
            postings = Postings(blocks.as_py(), data.as_py(), weight.as_py())
            for q in items.as_py():
                queries.setdefault(q, []).append(postings)
        number, found, scores = [], [], []
        for q, own_lists in queries.items():
            doc, score = best_documents(own_lists, m, order, k)
            number.append(np.full(len(doc), q, np.int64))
            found.append(doc)
            scores.append(score)
        take = np.concatenate([np.zeros(0, np.int64), *found])
        return pa.table([pa.array(np.concatenate([np.zeros(0, np.int64), *number])), ids.take(pa.array(take)), pa.array(np.concatenate([np.zeros(0, np.int64), *scores]))], names)

    return run


@dataclass
class LexicalIndex:
    """Shards of documents: ``lists`` has one row for each shard's documents (``term`` null: norms in ``blocks``, ids)
    and one for each term of a shard; ``docs`` documents hold ``terms`` terms."""

    lists: DataFrame
    docs: int
    terms: int


def build_index(scratch: Scratch, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> LexicalIndex:
    """An index over whole texts. A first pass counts documents and terms, which the block maxima need; a second
    writes the shards where the texts are read, so no text or posting is shuffled."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    n, terms = rows.select("text").mapInArrow(_lengths, "docs bigint, terms bigint").agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        shard = _Shard()
        for batch in batches:
            for part in slices(batch, "text"):
                if shard.size and (shard.size + part.num_rows > SHARD_DOCS or shard.bytes >= SHARD_BYTES):
                    yield from shard.rows(number, n, terms)
                    number, shard = number + 1, _Shard()
                shard.add(part)
        if shard.size:
            yield from shard.rows(number, n, terms)

    lists = rows.mapInArrow(shards, f"shard bigint, term bigint, df bigint, blocks binary, data binary, ids array<{kind}>")
    return LexicalIndex(scratch.table(lists), n, terms)


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            data, offsets = text_bytes(part.column("text"))
            hashes, firsts = word_hashes(data, offsets, term_spans(data, offsets))
            row = np.repeat(np.arange(part.num_rows), np.diff(firsts))
            yield pa.RecordBatch.from_arrays([part.column("query").take(pa.array(row)), pa.array(hashes.view(np.int64))], ["query", "term"])


def search(index: LexicalIndex, queries: DataFrame, scratch: Scratch, k: int = 50, query_id: str = "item_id", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The ``k`` documents with the highest scores for each query: ``query_id``, ``rank`` from 1, ``doc_id``, ``score``.

    Terms are longest runs of ASCII letters and digits and of characters beyond ASCII, with A-Z as a-z, compared by
    64-bit digests. A term's weight is floor(1000 ln((2N + 2) / (2 df + 1))) of N documents with a term; a
    document's score sums weight * ((10^9 tf) div (1000 tf + 20 m)) over the query's distinct terms, with m = 50 + (50 n N) div L
    of its n terms of L in all, in 64-bit whole numbers. Equal scores: the smaller id first, a null id last.

    Null and empty texts hold no term and are found by no query; a query without terms, or of terms that no
    document holds, has no rows. Rows of ``queries`` with the same id are one query with the terms of all; those without
    an id are one too. Documents in rows that repeat an id are ranked one by one. Empty tables give an empty table.

    A shard and a block of queries meet in one task, by their terms' lists; a task returns ``k`` rows for a query
    at most, and these are merged, also before they are shuffled.
    """
    asked = queries.select(F.col(f"`{query_id}`").alias("query"), F.col(f"`{text}`").alias("text"))
    kind, doc_kind = asked.schema["query"].dataType.simpleString(), index.lists.schema["ids"].dataType.elementType.simpleString()
    terms = asked.mapInArrow(_terms, f"query {kind}, term bigint").distinct()
    # Queries are numbered for the search, in blocks that a hash of the id deals evenly.
    names = scratch.table(asked.select("query").distinct().withColumn("number", F.monotonically_increasing_id()))
    count = names.count()
    blocks = max(1, -(-count // QUERY_BLOCK))
    terms = terms.join(names, terms["query"].eqNullSafe(names["query"])).select("term", "number", F.pmod(F.xxhash64("number"), F.lit(blocks)).alias("part"))
    terms = scratch.table(terms)
    asked_lists = index.lists.where("term IS NOT NULL").join(terms.select("term").distinct(), "term", "left_semi").select("shard", "term", "df", "blocks", "data")
    asked_lists = scratch.table(asked_lists)
    weight = F.floor(F.lit(1000.0) * F.log((F.lit(2.0 * index.docs + 2)) / (2 * F.col("df") + 1).cast("double"))).cast("bigint")
    weights = asked_lists.groupBy("term").agg(F.sum("df").alias("df")).select("term", weight.alias("weight"))
    wanted = terms.groupBy("part", "term").agg(F.collect_list("number").alias("queries")).join(weights, "term")
    nothing = lambda kind: F.lit(None).cast(kind)
    lists = asked_lists.join(wanted, "term").select("shard", "part", "term", "weight", "queries", "blocks", "data", nothing(f"array<{doc_kind}>").alias("ids"))
    own = index.lists.where("term IS NULL").select(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")).alias("part"), "term", nothing("bigint").alias("weight"),
        nothing("array<bigint>").alias("queries"), "blocks", "data", "ids",
    )
    found = lists.unionByName(own).groupBy("shard", "part").applyInArrow(_searched(k, ["number", "doc", "score"]), f"number bigint, doc {doc_kind}, score bigint")
    best = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.join(names, "number").select(F.col("query").alias(query_id), "rank", F.col("doc").alias(doc_id), "score")


def ranked_search(docs: DataFrame, queries: DataFrame, k: int = 50, doc_id: str = "doc_id", text: str = "text", query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """``search`` over an index of ``docs`` that is built for it."""
    scratch = Scratch(docs.sparkSession)
    index = build_index(scratch, docs, doc_id, text)
    return search(index, queries, scratch, k, query_id, query_text, doc_id)
