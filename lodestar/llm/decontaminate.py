"""Benchmark passages inside documents, found by one Aho-Corasick automaton."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.frames import Scratch, slices

#: Most characters of benchmark in one automaton; more are searched in blocks, one scan each.
MAX_CHARS = 8_000_000

# Bytes of words as they are compared: A-Z as a-z, all other ASCII but digits and letters a gap.
_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def normal_words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class Windows:
    """The windows of some benchmark items as an automaton over word numbers."""

    _built: dict[str, "Windows"] = {}

    def __init__(self, items: list[tuple[str | None, bytes]], size: int):
        self.number: dict[bytes, int] = {}
        lengths: dict[tuple[int, ...], int] = {}
        owners: dict[tuple[int, ...], set] = {}
        for item, text in items:
            words = tuple(self.number.setdefault(w, len(self.number) + 1) for w in normal_words(text))
            for i in range(max(len(words) - size + 1, min(len(words), 1))):
                window = words[i : i + size]
                lengths[window] = len(window)
                owners.setdefault(window, set()).add(item)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for window, length in lengths.items():
            self.automaton.add_word(window, (length, tuple(owners[window])))
        self.empty = not lengths
        if not self.empty:
            self.automaton.make_automaton()

    @classmethod
    def of(cls, key: str, items: list[tuple[str | None, bytes]], size: int) -> "Windows":
        """Built once in each worker process."""
        if key not in cls._built:
            cls._built.clear()
            cls._built[key] = cls(items, size)
        return cls._built[key]

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Word ranges that windows cover, overlapping ones as one, and the items they come from."""
        spans: list[tuple[int, int]] = []
        items: set = set()
        if self.empty or not words:
            return spans, items
        get = self.number.get
        for end, (length, owners) in self.automaton.iter(tuple([get(w, 0) for w in words])):
            items.update(owners)
            start = end - length + 1
            while spans and spans[-1][1] >= start:
                start = min(start, spans.pop()[0])
            spans.append((start, end + 1))
        return spans, items


def _offsets(text: bytes, spans: list[tuple[int, int]]) -> list[dict]:
    """Ranges of words as ranges of characters of the original text."""
    data = np.frombuffer(text.translate(_TABLE), np.uint8)
    inside = np.concatenate(([False], data != 32, [False]))
    starts, ends = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
    char = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
    return [{"start": int(char[starts[a]]), "end": int(char[ends[b - 1]])} for a, b in spans]


_RANGES = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _union(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _scan(shared, size: int, last: bool):
    """Add what one automaton finds to the ranges and items of the scans before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows.of(*shared.value, size)
        for batch in batches:
            for part in slices(batch, "text"):
                before = zip(part.column("ranges").to_pylist(), part.column("items").to_pylist()) if "ranges" in part.schema.names else None
                counts, hits, ranges_, spans, found = [], [], [], [], []
                for value in part.column("text"):
                    text = value.as_buffer().to_pybytes() if value.is_valid else b""
                    words = normal_words(text)
                    ranges, owners = windows.find(words)
                    if before is not None:
                        old, listed = next(before)
                        ranges, owners = _union([*ranges, *((r["a"], r["b"]) for r in old)]), owners | set(listed)
                    counts.append(len(words))
                    hits.append(sum(b - a for a, b in ranges))
                    ranges_.append([{"a": a, "b": b} for a, b in ranges])
                    spans.append(_offsets(text, ranges) if last and ranges else [])
                    found.append(sorted(x for x in owners if x is not None))
                carried = [c for c in part.schema.names if c not in ("ranges", "items", *(["text"] if last else []))]
                results = [pa.array(counts, pa.int64()), pa.array(hits, pa.int64()), pa.array(spans, _SPANS)] if last else [pa.array(ranges_, _RANGES)]
                names = ["n_words", "n_hit", "spans"] if last else ["ranges"]
                yield pa.RecordBatch.from_arrays(
                    [*map(part.column, carried), *results, pa.array(found, pa.list_(pa.string()))], [*carried, *names, "items"]
                )

    return run


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, size: int = 10, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    carry: list[str] | None = None, max_chars: int = MAX_CHARS,
) -> DataFrame:
    """Mark the words of ``docs`` that stand in a window of ``size`` consecutive words of a benchmark item.

    Returns the columns of ``docs`` (or those in ``carry``) with ``n_words``, ``n_hit`` (words inside
    some window), ``spans`` (character ranges of the original text, overlapping windows as one) and
    ``items`` (ids of the items found, as sorted strings). Input columns of these names are replaced.

    An item of fewer words is one window; items without words, null or empty, find nothing. Null and
    empty texts have no words. Items without an id mark words but are not listed; repeated ids count
    once, repeated rows of ``docs`` get the same answer each. Either table may be empty.

    One automaton is sent to all tasks and whole texts are scanned once, without a shuffle. The
    benchmark's size is measured first: one of more than ``max_chars`` characters is dealt by item
    into blocks below that bound, with one automaton and one scan each, and the same result. Each scan is a job of
    its own and its result is stored, so a task never holds two automata.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.coalesce(F.col(item_text), F.lit("")).alias("text")).distinct()
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = 1 + 2 * total // max_chars if total > max_chars else 1
    added = ("n_words", "n_hit", "spans", "items")
    names = [c for c in (docs.columns if carry is None else carry) if c not in added]
    held = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], F.col(f"`{text}`").alias("text"))
    own = held.schema.fields[:-1]
    for k in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
        rows = sorted(((r["item"], r["text"].encode()) for r in part.toLocalIterator()), key=repr)
        shared = spark.sparkContext.broadcast((hashlib.sha256(repr((rows, size)).encode()).hexdigest(), rows))
        last = k == blocks - 1
        more = "n_words bigint, n_hit bigint, spans array<struct<start: bigint, end: bigint>>" if last else "text string, ranges array<struct<a: bigint, b: bigint>>"
        scanned = held.mapInArrow(_scan(shared, size, last), T.StructType([*own, *T.DataType.fromDDL(more + ", items array<string>").fields]))
        if not last:
            scanned = scratch.table(scanned)
            scratch.drop(held)
        held = scanned
    return held.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], *added)


def remove_spans(marked: DataFrame, text: str = "text") -> DataFrame:
    """``marked`` without the text inside its ``spans``; a null text stays null."""
    pieces = F.transform(
        F.arrays_zip(
            F.concat(F.array(F.lit(0).cast("bigint")), F.col("spans.end")).alias("a"),
            F.concat(F.col("spans.start"), F.array(F.char_length(text).cast("bigint"))).alias("b"),
        ),
        lambda s: F.substring(F.col(text), (s["a"] + 1).cast("int"), (s["b"] - s["a"]).cast("int")),
    )
    return marked.withColumn(text, F.when(F.size("spans") == 0, F.col(text)).otherwise(F.array_join(pieces, "")))
