"""Passages that repeat across documents, by content-defined chunks and, around those, windows of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.frames import mix, seeds, slices, text_bytes

#: A passage goes if it holds so many words.
MIN_WORDS = 50
#: Bytes that the rolling hash sees, and words that hold as many, each with white space behind it.
REACH, REACH_WORDS = 16, 8
#: Words of the smallest chunk that is compared where there are others; shorter ones stand nearly everywhere and tell little.
LEAST = 3

_GEAR = seeds(256, 8).astype(np.uint16)
_BYTE = seeds(256, 9)
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_STEP = 1 << 20


class _Powers:
    """Powers of the digest's base and of its inverse."""

    up = down = np.zeros(0, np.uint64)

    @classmethod
    def to(cls, n: int) -> None:
        if len(cls.up) < n:
            one = np.ones(1, np.uint64)
            cls.up = np.concatenate((one, np.cumprod(np.full(n - 1, _BASE, np.uint64), dtype=np.uint64)))
            cls.down = np.concatenate((one, np.cumprod(np.full(n - 1, _BACK, np.uint64), dtype=np.uint64)))


def digests(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each chunk: a polynomial over random byte values, from running sums."""
    out, first = [], 0
    while first < len(ends):
        begin = int(ends[first - 1]) if first else 0
        last = max(int(np.searchsorted(ends, begin + _STEP, "right")), first + 1)
        part = data[begin : int(ends[last - 1])]
        _Powers.to(len(part) + 1)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[part] * _Powers.up[: len(part)], dtype=np.uint64)))
        stop = ends[first:last] - begin
        start = np.concatenate(([0], stop[:-1]))
        out.append(mix((total[stop] - total[start]) * _Powers.down[start] + (stop - start).astype(np.uint64)))
        first = last
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\r\x0b\x0c")] = True
_CORE = np.ones(256, bool)
_CORE[:128] = [chr(i).isalnum() for i in range(128)]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word starts and stops, as white space and the texts' edges part them."""
    space = _SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins = ~space
    begins[1:] &= space[:-1] | edge[1:-1]
    stops = ~space
    stops[:-1] &= space[1:] | edge[1:-1]
    return np.flatnonzero(begins), np.flatnonzero(stops) + 1


def gear(data: np.ndarray, at: np.ndarray, floor: np.ndarray) -> np.ndarray:
    """The gear hash of the ``REACH`` bytes before each place ``at``, of those from ``floor`` on where they are fewer.

    A byte's hash is doubled by every byte after it, and of 16 bits nothing is left after 16. The hash of all places at
    once: h over 2n bytes is h over the last n plus h over the n before, shifted.
    """
    rolled = _GEAR[data]
    for n in (1, 2, 4, 8):
        rolled[n:] = rolled[n:] + (rolled[:-n] << np.uint16(n))
    out = rolled[at - 1]
    few = np.flatnonzero(at - floor < REACH)
    short = np.zeros(len(few), np.uint16)
    for j in range(REACH):
        spot = at[few] - 1 - j
        short += np.where(spot >= floor[few], _GEAR[data[np.maximum(spot, 0)]] << np.uint16(j), np.uint16(0))
    out[few] = short
    return out


def spread(n: int) -> int:
    """Of so many places in a row one is a cut, so that n words always hold a whole chunk cut by nothing but them."""
    return (n - REACH_WORDS + 2) // 4


class Chunks:
    """Content-defined chunks of a block of texts: ``cut`` are the words before which a text is cut, ``digest`` those of the
    chunks from each to the next, ``inner`` tells whether that is a cut of the same text, ``large`` whether the chunk also has
    ``LEAST`` words, and ``compared`` are the large chunks and those of windows that hold no large one.

    Before each word the gear hash of the bytes before it is taken; the smallest of any ``spread(n)`` in a row is a
    cut. So what is cut inside a passage depends on the passage alone, wherever it stands, but for its first
    ``REACH_WORDS`` words and ``spread(n)`` words at both ends, and what is left of n words has two cuts.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, n: int):
        start, _ = word_bounds(data, offsets)
        self.row = np.searchsorted(offsets, start, "right") - 1
        self.first = np.searchsorted(start, offsets)
        inner = np.ones(len(start), bool)
        inner[self.first[:-1][np.diff(self.first) > 0]] = False
        hashed = np.zeros(len(start), np.uint64)
        at = np.flatnonzero(inner)
        if len(at):
            hashed[at] = gear(data, start[at], offsets[self.row[at]])
        self.cut = chosen(self.row, hashed, inner, spread(n))
        edges = np.unique(np.concatenate((start[self.cut], offsets)))
        at = np.searchsorted(edges, start[self.cut])
        self.digest = digests(data, edges[1:])[at] if len(self.cut) else np.zeros(0, np.uint64)
        same = np.zeros(len(self.cut), bool)
        same[:-1] = self.row[self.cut[1:]] == self.row[self.cut[:-1]]
        self.inner, self.words = same, np.where(same, np.diff(self.cut, append=0), 0)
        self.large = same & (self.words >= LEAST)
        _, a, b = self.windows(n)
        few = self._held(self.large, a, b) == 0
        marks = np.zeros(len(self.cut) + 1, np.int64)
        np.add.at(marks, a[few], 1)
        np.add.at(marks, b[few], -1)
        self.compared = self.large | (np.cumsum(marks)[:-1] > 0) & same

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The windows of n words of one text, and the chunks of each, from the first to before the last, between cuts that depend on it alone."""
        w = spread(n)
        i = np.arange(max(len(self.row) - n + 1, 0))
        i = i[self.row[i] == self.row[i + n - 1]]
        a = np.searchsorted(self.cut, i + REACH_WORDS + w - 1)
        return i, a, np.searchsorted(self.cut, i + n - w, "right") - 1

    @staticmethod
    def _held(flags: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flags)))
        return total[b] - total[a]

    def candidates(self, places: pa.Array, n: int) -> np.ndarray:
        """The windows of n words of which all large chunks, or all if none is, are among those at the ``places`` of their text;
        so all windows that stand in another document, if the places are of all compared chunks that do."""
        known = np.zeros(len(self.cut), bool)
        begins = np.searchsorted(self.cut, self.first)
        for row, found in enumerate(places):
            if found.is_valid:
                a, b = begins[row], begins[row + 1]
                at = np.searchsorted(self.cut, self.first[row] + found.values.to_numpy(zero_copy_only=False))
                known[a:b] = np.isin(self.digest[a:b], self.digest[at])
        i, a, b = self.windows(n)
        needed = np.where(self._held(self.large, a, b) > 0, self._held(self.large & ~known, a, b), self._held(self.inner & ~known, a, b))
        return i[needed == 0]


class Words:
    """The words of a block of texts, as white space parts them: the text of each and its bounds in the
    block's bytes, without the ASCII signs at its edges (``core``, ``end``), and digests of windows of them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        start, stop = word_bounds(data, offsets)
        self.row = np.searchsorted(offsets, start, "right") - 1
        self.first = np.searchsorted(start, offsets)
        tail = np.minimum(np.append(start[1:], len(data)), offsets[self.row + 1])
        at = np.flatnonzero(_CORE[data])
        core = np.append(at, len(data))[np.searchsorted(at, start)]
        end = np.append(at, -1)[np.searchsorted(at, stop) - 1] + 1
        bare = core >= stop
        self.core, self.end = np.where(bare, start, core), np.where(bare, stop, end)
        parts = digests(data, np.stack((start, self.core, self.end, tail), 1).ravel()).reshape(-1, 4)
        lead, mid, last = parts[:, 1], parts[:, 2], parts[:, 3]
        base = np.uint64(_BASE)
        self._head, self._tail = mix(mid * base + last), mix(lead * base + mid)
        self._whole = mix(lead * base + self._head)

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """A digest of the bytes from each word to the (n - 1)th after it, and whether that is of the same text."""
        size = len(self.row)
        good = np.zeros(size, bool)
        if size < n:
            return np.zeros(size, np.uint64), good
        good[: size - n + 1] = self.row[: size - n + 1] == self.row[n - 1 :]
        out = np.zeros(size, np.uint64)
        if n == 1:
            return mix(self._head ^ (self._tail * np.uint64(_BASE))), good
        # A polynomial over the words between the first and the last: of 2n words from those of n.
        inner, done, power, length, factor = np.zeros(size, np.uint64), 0, self._whole, 1, _BASE
        left = n - 2
        while left:
            if left & 1:
                inner = inner * np.uint64(factor) + _shift(power, done)
                done += length
            left >>= 1
            if left:
                power = power * np.uint64(factor) + _shift(power, length)
                factor = factor * factor & 0xFFFFFFFFFFFFFFFF
                length *= 2
        out = mix(self._head * np.uint64(_BASE) + mix(_shift(inner, 1)) + mix(_shift(self._tail, n - 1)) * np.uint64(_BACK))
        return out, good


def chosen(row: np.ndarray, digest: np.ndarray, good: np.ndarray, w: int) -> np.ndarray:
    """The places whose digest is the smallest of some ``w`` good ones in a row of one text."""
    most = np.uint64(0xFFFFFFFFFFFFFFFF)
    low = _slide(np.where(good, digest, most), w, np.minimum, most)
    whole = _slide(good, w, np.minimum, False) & _shift(good, w - 1) & (row == _shift(row, w - 1))
    # The largest of the smallest of the w rows of places that a place is in.
    high = _slide(np.where(whole, low, np.uint64(0))[::-1], w, np.maximum, np.uint64(0))[::-1]
    some = _slide(whole[::-1], w, np.maximum, False)[::-1]
    return np.flatnonzero(good & some & (high == digest))


def _shift(x: np.ndarray, n: int) -> np.ndarray:
    """``x[i + n]`` at i, zero beyond the end."""
    out = np.zeros_like(x)
    if n < len(x):
        out[: len(x) - n] = x[n:]
    return out


def _slide(x: np.ndarray, w: int, least, fill) -> np.ndarray:
    """The smallest or largest of ``x[i : i + w]`` at i."""
    x, have = x.copy(), 1
    while have < w:
        step = min(have, w - have)
        x[:-step] = least(x[:-step], x[step:]) if step < len(x) else x[:-step]
        have += step
    return x


def _rows(words: Words, digest: np.ndarray, places: np.ndarray, ids: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
    """One row for each window. Of equal windows of a block of texts only the first, by id, goes on to be
    compared (``deal`` is its digest); the others are known to repeat it and are dealt out evenly."""
    row = words.row[places]
    digest = digest[places].view(np.int64)
    place = places - words.first[row]
    ids, key = ids[row], key[row]
    order = np.lexsort((place, key, ids, digest))
    repeat = np.zeros(len(order), bool)
    repeat[1:] = digest[order][1:] == digest[order][:-1]
    head = np.maximum.accumulate(np.where(repeat, 0, np.arange(len(order))))
    first = np.empty(len(order), np.int64)
    first[order] = order[head]
    known = np.zeros(len(order), bool)
    known[order] = repeat
    # What repeats inside a document, or in a repeated row, repeats nothing of another document.
    same = known & (key == key[first]) & (ids == ids[first])
    known &= ~same
    # Of several equal windows of a later document one is enough.
    again = np.zeros(len(order), bool)
    again[order[1:]] = repeat[1:] & (ids[order][1:] == ids[order][:-1]) & (key[order][1:] == key[order][:-1])
    met = np.zeros(len(order), bool)
    met[first[known]] = True
    deal = np.where(known, mix((np.arange(len(row)) + (row << 32)).astype(np.uint64) ^ digest.view(np.uint64)).view(np.int64), digest)
    take = np.flatnonzero(~same & ~again)
    return pa.RecordBatch.from_arrays(
        [pa.array(x[take]) for x in (deal, known, met, ids, key, place, np.where(known, ids[first], 0))],
        ["deal", "known", "met", "order_id", "key", "place", "holder"],
    )


_WINDOW = "deal bigint, known boolean, met boolean, order_id bigint, key bigint, place bigint, holder bigint"


_CHUNK = ["deal", "known", "met", "key", "place"]


def _chunks(n: int):
    """The chunks of each text that are compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = Chunks(*text_bytes(part.column("text")), n)
                at = np.flatnonzero(found.compared)
                if len(at):
                    key = part.column("of_key").to_numpy()
                    digest = np.zeros(len(found.row), np.uint64)
                    digest[found.cut] = found.digest
                    yield _rows(found, digest, found.cut[at], key, key).select(_CHUNK)

    return run


def _flagged(words: Words, digest: np.ndarray, good: np.ndarray, found: pa.Array) -> np.ndarray:
    """The windows equal to those at the ``found`` places of each text, at all their places in it."""
    out = np.zeros(len(digest), bool)
    for row, places in enumerate(found):
        if places.is_valid:
            a, b = words.first[row], words.first[row + 1]
            out[a:b] = np.isin(digest[a:b], digest[a + places.values.to_numpy(zero_copy_only=False)]) & good[a:b]
    return out


def _all_near(n: int):
    """All windows of n words whose chunks another document has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = text_bytes(part.column("text"))
                places = Chunks(data, offsets, n).candidates(part.column("places"), n)
                if len(places):
                    words = Words(data, offsets)
                    digest, _ = words.windows(n)
                    yield _rows(words, digest, places, *(part.column(c).to_numpy() for c in ("of_id", "of_key")))

    return run


_FOUND = ["order_id", "key", "place", "holder"]


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in order of digest, then of document: those that repeat an earlier one, and its document."""
    yield from _matched(batches, False)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From chunks in order of digest, then of document: those that stand in two documents."""

    def wide() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            deal, known, met, key, place = batch.columns
            yield pa.RecordBatch.from_arrays([deal, known, met, key, key, place, key], ["deal", "known", "met", "order_id", "key", "place", "holder"])

    for found in _matched(wide(), True):
        yield found.select(["key", "place"])


def _matched(batches: Iterator[pa.RecordBatch], both: bool) -> Iterator[pa.RecordBatch]:
    last: tuple[int, int, int, int, bool] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        deal, known, met, ids, key, place, holder = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(7))
        free = np.flatnonzero(~known)
        extra = None
        if len(free):
            d = deal[free]
            begins = np.ones(len(d), bool)
            begins[1:] = d[1:] != d[:-1]
            carried = last is not None and last[0] == d[0]
            begins[0] = not carried
            head = np.maximum.accumulate(np.where(begins, np.arange(len(d)), 0))
            head_id, head_key, head_place = ids[free][head], key[free][head], place[free][head]
            if carried:
                old = np.cumsum(begins) == 0
                head_id[old], head_key[old], head_place[old] = last[1:4]
            known = known.copy()
            later = ~begins & ((head_id != ids[free]) | (head_key != key[free]))
            told = False
            if both:
                group = np.cumsum(begins)
                shared = np.zeros(group[-1] + 1, bool)
                shared[group[later | met[free]]] = True
                told = carried and last[4]
                if carried and shared[0] and not told:
                    extra = last[1:4]
                told = bool(shared[group[-1]] or told and group[-1] == 0)
                later |= begins & shared[group]
            known[free] = later
            holder = holder.copy()
            holder[free] = head_id
            last = (int(d[-1]), int(head_id[-1]), int(head_key[-1]), int(head_place[-1]), told)
        take = np.flatnonzero(known)
        yield pa.RecordBatch.from_arrays([pa.array(x[take]) for x in (ids, key, place, holder)], _FOUND)
        if extra is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (*extra, extra[0])], _FOUND)


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _cut_out(n: int):
    """Remove the windows that were found, and those equal to them, from each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = text_bytes(part.column("text"))
                words = Words(data, offsets) if part.column("places").null_count < len(part) else None
                digest, good = words.windows(n) if words else (None, None)
                texts, spans, holders, removed = [], [], [], []
                flagged = np.flatnonzero(_flagged(words, digest, good, part.column("places"))) if words else np.zeros(0, np.int64)
                for row, (text, held) in enumerate(zip(part.column("text"), part.column("holders"))):
                    at = flagged[slice(*np.searchsorted(flagged, words.first[row : row + 2]))] if words and held.is_valid else flagged[:0]
                    if not len(at):
                        texts.append(text.as_py())
                        spans.append([])
                        holders.append([])
                        removed.append(0)
                        continue
                    # Windows that share a word are one span; what stands between others was not compared.
                    new = np.flatnonzero(np.diff(at) >= n) + 1
                    first, last = at[np.concatenate(([0], new))], at[np.concatenate((new, [len(at)])) - 1] + n - 1
                    body = data[offsets[row] : offsets[row + 1]].tobytes()
                    kept, end, chars = [], 0, []
                    for a, b in zip((words.core[first] - offsets[row]).tolist(), (words.end[last] - offsets[row]).tolist()):
                        kept.append(body[end:a])
                        before = (chars[-1][1] if chars else 0) + len(kept[-1].decode())
                        chars.append((before, before + len(body[a:b].decode())))
                        end = b
                    texts.append(b"".join([*kept, body[end:]]).decode())
                    spans.append([{"start": a, "end": b} for a, b in chars])
                    holders.append(sorted(held.as_py()))
                    removed.append(int((last - first + 1).sum()))
                carried = [c for c in part.schema.names if c not in ("text", "of_id", "of_key", "places", "holders")]
                yield pa.RecordBatch.from_arrays(
                    [*map(part.column, carried), pa.array(texts, pa.string()), pa.array(spans, _SPANS), pa.array(holders, pa.list_(pa.int64())), pa.array(removed, pa.int64())],
                    [*carried, "text", "spans", "holders", "n_removed"],
                )

    return run


def substring_dedup(
    docs: DataFrame, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text", carry: list[str] | None = None,
) -> DataFrame:
    """Remove passages of ``min_words`` words or more that stand in an earlier document.

    Words are what white space parts. Every window of ``min_words`` words, from the first letter or digit
    of its first word to the last one of its last word, that stands byte for byte in an earlier document
    by id is removed, at all its places. Returns the columns of
    ``docs`` (or those in ``carry``, and the text) with the text as it is after removal, ``spans`` (character ranges of the
    original text that went), ``holders`` (ids of the first documents that hold these windows) and
    ``n_removed`` (words). Columns of these names are replaced.

    Ids are whole numbers. A null id sorts as 0. Null texts stay null, empty ones empty. Rows with the
    same id and text are one document and get the same answer; a copy under another id loses all its words
    if it has so many. Chunks and windows are compared by 64-bit digests. ``min_words`` is 10 or more.

    First texts are cut into chunks by content, and chunks are deduplicated by digest: any ``min_words`` words hold
    chunks that are cut alike wherever they stand. Then the windows whose chunks all stand in other
    documents are compared as a whole, so what goes is exact at both edges. Equal chunks and windows of a
    block of texts are made one before they are shuffled; so of one however frequent a task reads one row for each
    block. Texts are shuffled once.
    """
    if min_words < 10:
        raise ValueError("a passage has 10 words or more")
    order_id = F.coalesce(F.col(doc_id).cast("bigint"), F.lit(0))
    # What is the same document: id and text.
    key = F.xxhash64(order_id, F.xxhash64(F.col(text)))
    added = ("spans", "holders", "n_removed")
    names = [c for c in (docs.columns if carry is None else carry) if c not in (*added, text)]
    held = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], F.col(f"`{text}`").alias("text"), order_id.alias("of_id"), key.alias("of_key"))

    def met(found: DataFrame, how: str, *more: str) -> DataFrame:
        # Both joins read all columns, so that they read one shuffle of the texts.
        return held.join(found.hint("shuffle_merge"), "of_key", how).select(*held.columns, "places", *more)

    chunks = held.select("of_key", "text").mapInArrow(_chunks(min_words), "deal bigint, known boolean, met boolean, key bigint, place bigint")
    chunks = chunks.repartition("deal").sortWithinPartitions("deal", "key", "place").mapInArrow(_shared, "key bigint, place bigint")
    first = chunks.groupBy(F.col("key").alias("of_key")).agg(F.collect_list("place").alias("places"))
    windows = met(first, "inner").mapInArrow(_all_near(min_words), _WINDOW)
    windows = windows.repartition("deal").sortWithinPartitions("deal", "order_id", "key", "place").mapInArrow(_repeated, "order_id bigint, key bigint, place bigint, holder bigint")
    second = windows.groupBy(F.col("key").alias("of_key")).agg(F.collect_list("place").alias("places"), F.collect_set("holder").alias("holders"))
    schema = T.StructType([*held.schema.fields[: len(names)], *T.DataType.fromDDL(
        "text string, spans array<struct<start: bigint, end: bigint>>, holders array<bigint>, n_removed bigint").fields])
    out = met(second, "left", "holders").mapInArrow(_cut_out(min_words), schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], F.col("text").alias(text), *added)
