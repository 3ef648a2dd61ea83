"""Toxic texts, by a linear classifier over character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.frames import Scratch, large_list, seeds, slices, text_bytes

#: Bytes of an n-gram. Texts are lower-cased in ASCII, runs of white space become one space.
SIZES = (3, 4, 5, 6)
#: n-grams are hashed into 2 ** LOG_BUCKETS features.
LOG_BUCKETS = 20
#: Most labelled rows the classifier is fitted on, the first by a hash of their id; all others are only scored.
MAX_LABELLED = 30_000
#: Most weighted features, over all texts of the sample, that the fit takes; no text has more than 2 ** LOG_BUCKETS.
MAX_FEATURES = 1 << 24
#: n-grams in fewer texts of the sample, or whose log-count ratio is closer to 0, carry no weight.
MIN_TEXTS, MIN_RATIO = 5, 1.0
#: Strength of the ridge penalty.
RIDGE = 0.1

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[9:14] = 32
_WEIGHTS = (seeds(max(SIZES), 6) | np.uint64(1)).astype(np.uint32)


def _features(text: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The distinct features of a text, sorted. ``seen`` is working memory, false everywhere.

    Long texts are taken in pieces that overlap by the longest n-gram but one byte.
    """
    folded = _FOLD[text]
    space = folded == 32
    keep = ~(space & np.concatenate(([True], space[:-1]))) if len(space) else space
    folded = np.concatenate(([32], folded[keep], [32])).astype(np.uint32) * np.uint32(0x9E3779B1)
    step, longest = 1 << 18, max(SIZES)
    for a in range(0, len(folded), step):
        piece = folded[a : a + step + longest - 1]
        total = np.zeros(len(piece), np.uint32)
        for j in range(longest):
            total = total[: len(piece) - j] + piece[j:] * _WEIGHTS[j] if len(piece) > j else total[:0]
            if j + 1 in SIZES:
                mixed = (total ^ (total >> np.uint32(15))) * np.uint32(0x2C1B3C6D + 2 * j)
                seen[mixed >> np.uint32(32 - LOG_BUCKETS)] = True
    found = np.flatnonzero(seen)
    seen[found] = False
    return found


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Iterator[np.ndarray]]]:
    """Parts of the batches with the features of their texts, one text at a time."""
    seen = np.zeros(1 << LOG_BUCKETS, bool)
    for batch in batches:
        for part in slices(batch, "text"):
            data, offsets = text_bytes(part.column("text"))
            yield part, (_features(data[a:b], seen) for a, b in zip(offsets[:-1], offsets[1:]))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many texts of either class each feature occurs, and how many texts there are (-1)."""
    for part, rows in _each(batches):
        toxic = part.column("toxic").to_numpy(zero_copy_only=False)
        both = np.zeros((2, 1 << LOG_BUCKETS), np.int32)
        for label, features in zip(toxic, rows):
            both[label][features] += 1
        found = np.flatnonzero(both.any(0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(found, -1)), *(pa.array(np.append(both[k][found], (toxic == k).sum()).astype(np.int64)) for k in (0, 1))],
            ["feature", "clean", "toxic"],
        )


def _examples(shared):
    """Labels and the kept features of the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = shared.value
        for part, rows in _each(batches):
            own = [f[f >= 0] for f in (place[f] for f in rows)]
            ends = np.concatenate(([0], np.cumsum([len(f) for f in own])))
            flat = np.concatenate(own) if own else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic"), large_list(flat, ends, pa.int32())], ["doc_id", "toxic", "features"])

    return run


@dataclass
class Model:
    """``weights`` by feature, 0 for all without weight, and the log-odds of a text with none of them."""

    weights: np.ndarray
    bias: float

    def score(self, features: np.ndarray) -> float:
        z = self.bias + float(self.weights[features].sum(dtype=np.float64))
        return float(1 / (1 + np.exp(-min(max(z, -500.0), 500.0))))


#: Features of the sample that the fit works on at once.
_AT_ONCE = 1 << 20


def _logistic(flat: np.ndarray, ends: np.ndarray, ratio: np.ndarray, y: np.ndarray, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Ridge logistic regression on features of value ``ratio``, by accelerated gradient steps.

    ``flat`` has the features of all rows, row i those from ``ends[i]`` to ``ends[i + 1]``.
    """
    n = len(y)
    cuts = [0]
    while cuts[-1] < n:
        cuts.append(max(int(np.searchsorted(ends, ends[cuts[-1]] + _AT_ONCE, "right")) - 1, cuts[-1] + 1))
    parts = [(a, b, flat[ends[a] : ends[b]], np.repeat(np.arange(b - a, dtype=np.int32), np.diff(ends[a : b + 1]))) for a, b in zip(cuts, cuts[1:])]

    def rows_of(by_feature: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(row, by_feature[own], b - a) for a, b, own, row in parts])

    norms = rows_of(ratio * ratio) + 1
    step = 4 / (norms.mean() + np.quantile(norms, 0.99) + RIDGE / n)
    w, b = np.zeros(len(ratio)), float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    v, c = w.copy(), b
    for k in range(1, rounds + 1):
        error = 1 / (1 + np.exp(-np.clip(c + rows_of(ratio * v), -500, 500))) - y
        slope = np.zeros(len(ratio))
        for first, last, own, row in parts:
            slope += np.bincount(own, error[first:last][row], len(ratio))
        w_next = v - step * (ratio * slope / n + RIDGE / n * v)
        b_next = c - step * error.mean()
        v, c = w_next + (k - 1) / (k + 2) * (w_next - w), b_next + (k - 1) / (k + 2) * (b_next - b)
        w, b = w_next, b_next
    return w, b


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_features: int = MAX_FEATURES) -> Model:
    """Fit on the texts of ``docs(doc_id, text)`` that ``labels(doc_id, toxic)`` marks 0 or 1.

    At most ``max_labelled`` ids take part, the first by a hash of the id, and of their texts the first of the same order
    that together have at most ``max_features`` weighted features, so the fit's memory is bounded however long texts are. Only their ids are
    broadcast; feature counts are summed by Spark into one row a feature, and the driver gets these
    counts and the sample's few weighted features. Rows with a null id, label or text teach
    nothing; of contrary labels of an id the larger holds. With one class only, or no rows, every
    text scores the share of toxic rows (one half without rows).
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    texts = docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "text", "toxic")
    texts = scratch.table(texts)
    counts = texts.mapInArrow(_counts, "feature bigint, clean bigint, toxic bigint").groupBy("feature").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")
    )
    counts = counts.where(f"feature < 0 OR clean + toxic >= {MIN_TEXTS}").toPandas().sort_values("feature")
    weights = np.zeros(1 << LOG_BUCKETS, np.float64)
    totals = counts[counts["feature"] < 0][["clean", "toxic"]].sum()
    if totals["clean"] == 0 or totals["toxic"] == 0:
        scratch.drop(texts)
        share = (totals["toxic"] + 0.5) / (totals.sum() + 1)
        return Model(weights, float(np.log(share / (1 - share))))
    counts = counts[counts["feature"] >= 0]
    feature = counts["feature"].to_numpy()
    ratio = np.log((counts["toxic"].to_numpy() + 1) / (totals["toxic"] + 2)) - np.log((counts["clean"].to_numpy() + 1) / (totals["clean"] + 2))
    kept = np.abs(ratio) >= MIN_RATIO
    feature, ratio = feature[kept], ratio[kept]
    place = np.full(1 << LOG_BUCKETS, -1, np.int32)
    place[feature] = np.arange(len(feature))
    shared = spark.sparkContext.broadcast(place)
    examples = scratch.table(texts.mapInArrow(_examples(shared), T.StructType([
        docs.schema["doc_id"], T.StructField("toxic", T.IntegerType()), T.StructField("features", T.ArrayType(T.IntegerType()))
    ])))
    shared.unpersist()
    draw = F.xxhash64("doc_id")
    # One row for each text of the sample.
    sizes = examples.select(draw.alias("draw"), F.size("features").alias("n")).groupBy("draw").agg(F.sum("n").alias("n")).toPandas().sort_values("draw")
    within = sizes[(sizes["n"].cumsum() <= max_features) | (sizes["draw"] == sizes["draw"].min())]
    if len(within) < len(sizes):
        examples = examples.where(draw <= int(within["draw"].max()))
    rows = examples.toArrow().sort_by([("doc_id", "ascending")])
    scratch.drop(texts)
    lists = rows.column("features").combine_chunks()
    ends = np.concatenate(([0], np.cumsum(pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False))))
    w, bias = _logistic(lists.flatten().to_numpy(), ends, ratio, rows.column("toxic").to_numpy().astype(float))
    weights[feature] = w * ratio
    return Model(weights, bias)


def _scores(shared, carried: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for part, rows in _each(batches):
            score = pa.array([model.score(features) for features in rows], pa.float64())
            yield pa.RecordBatch.from_arrays([*map(part.column, carried), score], [*carried, "score"])

    return run


def score(docs: DataFrame, model: Model, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns of ``docs`` (or those in ``carry``) with ``score``, 0 to 1: higher is likelier toxic.

    The whole text is read, in one pass without a shuffle. Null texts score like empty ones. An
    input column named ``score`` is replaced.
    """
    names = [c for c in (docs.columns if carry is None else carry) if c != "score"]
    held = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], F.col(f"`{text}`").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*held.schema.fields[:-1], T.StructField("score", T.DoubleType())])
    out = held.mapInArrow(_scores(shared, [f"c{i}" for i in range(len(names))]), schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], "score")
