"""Byte-level BPE encoding and decoding with a given table of ranks."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.frames import slices

#: Most pieces whose ids a worker remembers, and pieces of a text that it holds at once.
MEMORY, PIECES = 250_000, 200_000
#: Cells of a padded matrix.
CELLS = 1 << 20
#: From this many symbols a row merges all occurrences of its pair in one round where that is the same.
LONG = 256
_NONE = np.int32(0x7FFFFFFF)


class PairTable:
    """Ranks of pairs of ids: open addressing over two numpy columns, looked up for whole arrays."""

    def __init__(self, keys: np.ndarray, ranks: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(len(keys), 1) * 2.5))))
        self._shift = np.uint64(64 - bits)
        self._keys = np.full(1 << bits, -1, np.int64)
        self._ranks = np.full(1 << bits, _NONE, np.int32)
        self._longest = 0
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            first = np.unique(slot, return_index=True)[1]
            take = first[self._keys[slot[first]] == -1]
            self._keys[slot[take]] = keys[left[take]]
            self._ranks[slot[take]] = ranks[left[take]]
            rest = np.ones(len(left), bool)
            rest[take] = False
            left, slot = left[rest], (slot[rest] + 1) & (len(self._keys) - 1)
            self._longest += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self._shift).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; the largest number where a pair is none or an id is -1."""
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        keys = np.where((left < 0) | (right < 0), np.int64(-2), keys).ravel()
        out = np.full(len(keys), _NONE, np.int32)
        open_, slot = np.arange(len(keys)), self._slot(keys)
        for _ in range(self._longest):
            held = self._keys[slot]
            found = held == keys[open_]
            out[open_[found]] = self._ranks[slot[found]]
            more = ~found & (held != -1)
            open_, slot = open_[more], (slot[more] + 1) & (len(self._keys) - 1)
            if not len(open_):
                break
        return out.reshape(left.shape)


class Codec:
    """Encoder and decoder for one table of ranks and one splitting pattern."""

    _made: dict[tuple, "Codec"] = {}

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = regex.compile(pattern)
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        lefts, rights, whole = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    lefts.append(a)
                    rights.append(b)
                    whole.append(rank)
        self.pairs = PairTable((np.array(lefts, np.int64) << 32) | np.array(rights, np.int64), np.array(whole, np.int32))
        size = max(ranks.values()) + 1
        self.length = np.zeros(size, np.int64)
        for token, rank in ranks.items():
            self.length[rank] = len(token)
        self.start = np.concatenate(([0], np.cumsum(self.length)))[:-1]
        self.tokens = np.frombuffer(b"".join(sorted(ranks, key=ranks.get)), np.uint8)
        self.known = {}

    @classmethod
    def of(cls, table: bytes, pattern: str) -> "Codec":
        """Built once in each worker process. ``table``: lines of a base64 token and its rank."""
        key = (hashlib.sha256(table).digest(), pattern)
        if key not in cls._made:
            cls._made.clear()
            cls._made[key] = cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, table.splitlines())}, pattern)
        return cls._made[key]

    def _merge(self, ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge the rows of a padded matrix until no pair has a rank; ``n`` has the rows' lengths.

        A round finds each row's leftmost pair of least rank, puts the merged id in its place, moves
        the rest one to the left and looks the two pairs beside it up anew. Finished rows leave.
        """
        out, lengths = ids.copy(), n.copy()
        rank = self.pairs.get(ids[:, :-1], ids[:, 1:])
        row = np.arange(len(ids))
        while len(row):
            at = rank.argmin(1)
            best = rank[np.arange(len(row)), at]
            done = best == _NONE
            if done.any():
                out[row[done]] = -1
                out[row[done], : ids.shape[1]] = ids[done]
                lengths[row[done]] = n[done]
                ids, n, rank, row, at, best = ids[~done], n[~done], rank[~done], row[~done], at[~done], best[~done]
                if not len(row):
                    break
            here = np.arange(len(row))
            width = ids.shape[1]
            place = np.arange(width - 1)
            source = place + (place > at[:, None])
            ids = np.take_along_axis(ids, source, 1)
            ids[here, at] = best
            n = n - 1
            if width == 2:
                rank = np.full((len(row), 1), _NONE, np.int32)
                ids = np.concatenate((ids, np.full((len(row), 1), -1, np.int32)), 1)
                continue
            source = place[:-1] + (place[:-1] > at[:, None])
            rank = np.take_along_axis(rank, source, 1)
            follow = at < width - 2
            rank[here[follow], at[follow]] = self.pairs.get(best[follow], ids[here[follow], at[follow] + 1])
            before = at > 0
            rank[here[before], at[before] - 1] = self.pairs.get(ids[here[before], at[before] - 1], best[before])
        return out, lengths

    def _merge_long(self, ids: np.ndarray) -> np.ndarray:
        """One long row. All occurrences of the least pair merge at once, left to right, as long as
        no merge before them makes a pair of lower or equal rank; so the order of merges is kept."""
        while len(ids) > 1:
            rank = self.pairs.get(ids[:-1], ids[1:])
            best = rank.min()
            if best == _NONE:
                break
            at = np.flatnonzero(rank == best)
            # In a run of overlapping occurrences every second one merges.
            run = np.cumsum(np.concatenate(([0], np.diff(at) != 1)))
            first = np.concatenate(([0], np.flatnonzero(np.diff(run)) + 1))
            at = at[(np.arange(len(at)) - first[run]) % 2 == 0]
            merged = ids.copy()
            merged[at] = best
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            place = np.cumsum(keep) - 1
            merged = merged[keep]
            new = self.pairs.get(merged[:-1], merged[1:])
            touched = np.zeros(len(merged), bool)
            touched[place[at]] = True
            early = np.flatnonzero((touched[:-1] | touched[1:]) & (new <= best)) if len(new) else new
            if len(early):
                merged = np.delete(ids, at[0] + 1)
                merged[at[0]] = best
            ids = merged
        return ids

    def encode_pieces(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """The ids of each piece as little-endian 32-bit numbers. Rows of like length share a matrix."""
        out: dict[bytes, bytes] = {}
        order = sorted(pieces, key=len)
        i = 0
        while i < len(order):
            longest = len(order[i]) + len(order[i]) // 4
            if len(order[i]) >= LONG:
                ids = self._merge_long(self.byte[np.frombuffer(order[i], np.uint8)])
                out[order[i]] = ids.astype("<u4").tobytes()
                i += 1
                continue
            rows = order[i : i + max(1, CELLS // max(longest, 1))]
            rows = rows[: next((k for k, p in enumerate(rows) if len(p) > longest), len(rows))]
            i += len(rows)
            n = np.array([len(p) for p in rows])
            width = max(int(n[-1]), 2)
            cells = np.full((len(rows), width), -1, np.int32)
            inside = np.arange(width) < n[:, None]
            cells[inside] = self.byte[np.frombuffer(b"".join(rows), np.uint8)]
            cells, n = self._merge(cells, n)
            flat = cells[np.arange(width) < n[:, None]].astype("<u4").tobytes()
            ends = np.cumsum(n) * 4
            out.update((p, flat[b - 4 * k : b]) for p, b, k in zip(rows, ends.tolist(), n.tolist()))
        return out

    def encode(self, text: str) -> np.ndarray:
        """The ids of a whole text."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of whole texts. Pieces not known yet are encoded together, in full matrices; of a
        text of many pieces a bounded number is held at once."""
        out = []
        split = [self.pattern.findall(t) if len(t) <= PIECES else None for t in texts]
        self._learn({p for pieces in split if pieces for p in pieces})
        for text, pieces in zip(texts, split):
            parts = [self._ids(pieces)] if pieces is not None else []
            if pieces is None:
                found = (m.group() for m in self.pattern.finditer(text))
                while pieces := list(islice(found, PIECES)):
                    parts.append(self._ids(pieces))
            out.append(np.frombuffer(b"".join(parts), "<u4"))
        return out

    def _learn(self, pieces: set[str]) -> None:
        missing = pieces.difference(self.known)
        if len(self.known) + len(missing) > MEMORY:
            self.known, missing = {}, pieces
        self.known.update((p.decode(), x) for p, x in self.encode_pieces([p.encode() for p in missing]).items())

    def _ids(self, pieces: list[str]) -> bytes:
        try:
            return b"".join(map(self.known.__getitem__, pieces))
        except KeyError:
            self._learn(set(pieces))
            return b"".join(map(self.known.__getitem__, pieces))

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of a row of ids, gathered from all tokens' bytes laid end to end."""
        parts = []
        for a in range(0, len(ids), PIECES):
            own = ids[a : a + PIECES]
            n = self.length[own]
            shift = np.repeat(self.start[own] - (np.cumsum(n) - n), n)
            parts.append(self.tokens[shift + np.arange(int(n.sum()))].tobytes())
        return b"".join(parts)


def read_ranks(path: str) -> bytes:
    """The lines of a file of ranks, by way of the driver; a vocabulary is some MB at most."""
    with open(path, "rb") as file:
        return file.read()


def _encoded(shared, then):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(*shared.value)
        for batch in batches:
            for part in slices(batch, "text"):
                ids = codec.encode_all([t or "" for t in part.column("text").to_pylist()])
                arrays, names = then(codec, ids)
                carried = [c for c in part.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*map(part.column, carried), *arrays], [*carried, *names])

    return run


def as_ids(codec: Codec, ids: list[np.ndarray]) -> tuple[list[pa.Array], list[str]]:
    """``token_ids`` and ``n_tokens``."""
    ends = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
    flat = pa.array(np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32))
    return [pa.ListArray.from_arrays(pa.array(ends), flat), pa.array([len(x) for x in ids], pa.int64())], ["token_ids", "n_tokens"]


def as_digests(codec: Codec, ids: list[np.ndarray]) -> tuple[list[pa.Array], list[str]]:
    """``n_tokens``, and SHA-256 of the ids as little-endian 32-bit numbers and of the decoded bytes."""
    digest = lambda data: hashlib.sha256(data).hexdigest()
    return [
        pa.array([len(x) for x in ids], pa.int64()), pa.array([digest(x.tobytes()) for x in ids], pa.string()),
        pa.array([digest(codec.decode(x)) for x in ids], pa.string()),
    ], ["n_tokens", "ids_sha256", "decoded_sha256"]


def as_all(codec: Codec, ids: list[np.ndarray]) -> tuple[list[pa.Array], list[str]]:
    """Ids, their count and both digests."""
    arrays, names = as_digests(codec, ids)
    return [as_ids(codec, ids)[0][0], *arrays], ["token_ids", *names]


#: What ``encode`` may return, by name: what makes it of a text's ids, and its columns.
RESULTS = {
    "ids": (as_ids, "token_ids array<int>, n_tokens bigint"),
    "digests": (as_digests, "n_tokens bigint, ids_sha256 string, decoded_sha256 string"),
    "all": (as_all, "token_ids array<int>, n_tokens bigint, ids_sha256 string, decoded_sha256 string"),
}


def encode(
    docs: DataFrame, ranks: bytes, pattern: str, text: str = "text", carry: list[str] | None = None, result: str = "ids",
) -> DataFrame:
    """Encode whole texts: each match of ``pattern`` separately, without special tokens.

    Returns the columns of ``docs`` (or those in ``carry``) with those that ``result`` names in
    ``RESULTS``: the ids, or digests of the ids and of the bytes decoded from them, so that neither
    has to travel, or all. Null texts count as empty and have no tokens; a
    text may be of any length. Input columns of the added names are replaced. Nothing is shuffled;
    the rank table, a fixed file, is broadcast.
    """
    then, fields = RESULTS[result]
    fields = T.DataType.fromDDL(fields).fields
    added = [f.name for f in fields]
    names = [c for c in (docs.columns if carry is None else carry) if c not in added]
    held = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], F.col(f"`{text}`").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast((ranks, pattern))
    schema = T.StructType([*held.schema.fields[:-1], *fields])
    out = held.mapInArrow(_encoded(shared, then), schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], *added)


def decode(encoded: DataFrame, ranks: bytes, pattern: str, ids: str = "token_ids") -> DataFrame:
    """Add ``decoded`` (binary) to rows of ids. Null ids give no bytes; an unknown id is an error."""
    shared = encoded.sparkSession.sparkContext.broadcast((ranks, pattern))
    names = [c for c in encoded.columns if c != "decoded"]
    held = encoded.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], F.col(f"`{ids}`").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(*shared.value)
        for batch in batches:
            rows = [codec.decode(np.asarray(x.as_py() or [], np.int64)) for x in batch.column("ids")]
            carried = [c for c in batch.schema.names if c != "ids"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, carried), pa.array(rows, pa.binary())], [*carried, "decoded"])

    out = held.mapInArrow(run, T.StructType([*held.schema.fields[:-1], T.StructField("decoded", T.BinaryType())]))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], "decoded")
