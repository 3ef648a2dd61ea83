"""A hidden Markov language model: latent states emit word classes, classes emit words.

The most frequent words are classes of their own, all others share a fixed number of classes by
their first and last letters. So the states' tables have a fixed size whatever the vocabulary, while
a word's share of its class comes from exact counts over the whole training corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.frames import Scratch, large_list, mix, slices, text_bytes
from lodestar.llm.words import LOWER, word_hashes, word_spans

#: Latent states and rounds of Baum-Welch.
STATES, ROUNDS = 8, 6
#: Words that are classes of their own, and classes that all other words share. Class 0 is the end.
OWN, SHARED = 2048, 2048
CLASSES = 1 + OWN + SHARED
#: Frequent words whose counts go to all tasks; the counts of all others are joined.
FREQUENT = 65_536
#: Tokens of texts that go through the recursions together, and of a segment of a long text.
PACK, SEGMENT = 1 << 17, 1024
_END = 0
_MERGE = 1 << 21


def _tokens(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Words as numbers, text after text, and the place of each text's first word.

    A number is the word's hash with the word's shared class as its lowest digits.
    """
    data, offsets = text_bytes(part.column("text"))
    starts, ends = word_spans(data, offsets)
    hashes, firsts = word_hashes(data, offsets, (starts, ends))
    letters = np.zeros(len(starts), np.uint64)
    for at in (starts, np.minimum(starts + 1, ends - 1), np.maximum(ends - 2, starts), ends - 1):
        letters = letters << np.uint64(8) | LOWER[data[at]].astype(np.uint64)
    return hashes // np.uint64(SHARED) * np.uint64(SHARED) + mix(letters) % np.uint64(SHARED), firsts


def _summed(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(words)
    words, counts = words[order], counts[order]
    head = np.flatnonzero(np.concatenate(([True], words[1:] != words[:-1])))
    return words[head], np.add.reduceat(counts, head)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the words of training texts, added up in the task until they are many."""

    held: list[tuple[np.ndarray, np.ndarray]] = []

    def out() -> pa.RecordBatch:
        words, counts = _summed(*(np.concatenate(x) for x in zip(*held)))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts)], ["word", "n"])

    for batch in batches:
        for part in slices(batch, "text"):
            words, _ = _tokens(part)
            if len(words):
                held.append(np.unique(words, return_counts=True))
            if sum(len(w) for w, _ in held) > _MERGE:
                yield out()
    if held:
        yield out()


@dataclass
class Vocabulary:
    """Counts of frequent words (sorted by hash), their own class or -1, and the classes' norms."""

    words: np.ndarray
    counts: np.ndarray
    own: np.ndarray
    log_norm: np.ndarray
    ends: int

    def look_up(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each word, -1 for one that is not frequent."""
        if not len(self.words):
            return np.full(len(hashes), -1)
        place = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[place] == hashes, place, -1)


def _prepared(shared):
    """Each text as classes, with what its frequent words add to its score, and its other words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        log_counts = np.log10(vocabulary.counts + 0.5)
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, firsts = _tokens(part)
                classes = (hashes % np.uint64(SHARED)).astype(np.int16)
                place = vocabulary.look_up(hashes)
                frequent = place >= 0
                own = np.where(frequent, vocabulary.own[place], -1) if len(vocabulary.own) else place
                log_c = np.where(frequent, log_counts[place], 0.0) if len(log_counts) else np.zeros(len(place))
                within = np.where(own < 0, log_c - vocabulary.log_norm[classes], 0.0)
                symbol = np.where(own < 0, classes + np.int16(1 + OWN), own).astype(np.int16)
                texts = len(firsts) - 1
                row = np.repeat(np.arange(texts), np.diff(firsts))
                add = lambda x: np.bincount(row, x, texts).astype(np.float64)
                rare = np.flatnonzero(~frequent)
                order = rare[np.lexsort((hashes[rare], row[rare]))]
                new = np.ones(len(order), bool)
                new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (row[order][1:] != row[order][:-1])
                head = np.flatnonzero(new)
                times = np.diff(np.append(head, len(order)))
                ends = np.searchsorted(row[order][head], np.arange(texts + 1))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("row", "doc_id", "train")), pa.array(np.diff(firsts) + 1),
                     pa.array(add(frequent).astype(np.int64) + (vocabulary.ends > 0)), pa.array(add(log_c) + np.log10(vocabulary.ends + 0.5)), pa.array(add(within)),
                     large_list(hashes[order][head].view(np.int64), ends, pa.int64()), large_list(times.astype(np.int32), ends, pa.int32()),
                     pa.array([symbol[a:b].tobytes() for a, b in zip(firsts[:-1], firsts[1:])], pa.binary())],
                    ["row", "doc_id", "train", "n_tokens", "known", "log_counts", "within", "rare", "times", "symbols"],
                )

    return run


@dataclass
class Model:
    """Start, transition and emission probabilities."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # class x state


def _packs(texts: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Texts of like length as columns of one matrix, longest first; with their numbers and lengths."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    i = 0
    while i < len(order):
        longest = len(texts[order[i]])
        own = order[i : i + max(1, PACK // longest)]
        i += len(own)
        lengths = np.array([len(texts[k]) for k in own])
        symbols = np.zeros((longest, len(own)), np.int16)
        for column, k in enumerate(own):
            symbols[: lengths[column], column] = texts[k]
        yield np.array(own), lengths, symbols


def _forward(model: Model, alpha: np.ndarray, emitted: np.ndarray, active: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """Scaled forward recursion from ``alpha`` (before the first step). ``keep`` gets every step's state
    shares; returns every step's scales."""
    scales = np.ones(emitted.shape[:2], emitted.dtype)
    move = model.move.astype(emitted.dtype)
    for t, n in enumerate(active):
        now = alpha[:n] @ move if t else alpha[:n]
        now = now * emitted[t, :n]
        total = now.sum(1)
        scales[t, :n] = total
        np.divide(now, total[:, None], out=alpha[:n])
        keep[t, :n] = alpha[:n]
    return scales


#: Steps between two normalisations where only the likelihood is wanted; 64-bit numbers allow for it.
_STEPS = 8
#: Segments of long texts that go through the recursion together.
_TOGETHER = 128


def _plain_log(model: Model, symbols: np.ndarray, active: np.ndarray) -> np.ndarray:
    """Log-likelihoods of the columns of ``symbols``, longest first, of which ``active`` go on at each step."""
    alpha = np.tile(model.start, (symbols.shape[1], 1))
    logs = np.zeros(symbols.shape[1])
    for t, n in enumerate(active):
        alpha[:n] = (alpha[:n] @ model.move if t else alpha[:n]) * model.emit[symbols[t, :n]]
        if t % _STEPS == _STEPS - 1:
            size = alpha[:n].sum(1)
            logs[:n] += np.log(size)
            alpha[:n] /= size[:, None]
    return logs + np.log(alpha.sum(1))


def _segments(model: Model, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``symbols``, a segment, and each state before it: the states' shares after it, and
    the log-likelihood of the segment."""
    many, states = len(symbols), len(model.start)
    flow = np.tile(model.move, (many, 1, 1))
    logs = np.zeros((many, states))
    for t in range(symbols.shape[1]):
        if t:
            flow = (flow.reshape(many * states, states) @ model.move).reshape(many, states, states)
        flow *= model.emit[symbols[:, t]][:, None, :]
        if t % _STEPS == _STEPS - 1 or t == symbols.shape[1] - 1:
            size = flow.sum(2)
            flow /= size[:, :, None]
            logs += np.log(size)
    return flow, logs


def log_likelihood(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    """The exact natural log-likelihood of each sequence of classes.

    A long text is cut into segments. Each takes one recursion for every state it may begin in, those
    of all long texts together; a text's segments are then multiplied in order, which is the same sum.
    """
    out = np.zeros(len(texts))
    short = np.array([i for i, t in enumerate(texts) if len(t) <= 2 * SEGMENT], np.int64)
    for own, lengths, symbols in _packs([texts[i] for i in short]):
        active = (lengths[None, :] > np.arange(len(symbols))[:, None]).sum(1)
        out[short[own]] = _plain_log(model, symbols, active)
    # First symbol, then whole segments, then what is left.
    cuts = [(i, a) for i, t in enumerate(texts) if len(t) > 2 * SEGMENT for a in range(1, len(t) - SEGMENT + 1, SEGMENT)]
    state: dict[int, np.ndarray] = {}
    for k in range(0, len(cuts), _TOGETHER):
        part = cuts[k : k + _TOGETHER]
        flow, logs = _segments(model, np.stack([texts[i][a : a + SEGMENT] for i, a in part]))
        for (i, a), matrix, scale in zip(part, flow, logs):
            now = state[i] if a > 1 else model.start * model.emit[texts[i][0]]
            top = scale.max()
            now = (now * np.exp(scale - top)) @ matrix
            size = now.sum()
            out[i] += top + np.log(size)
            state[i] = now / size
    for i, now in state.items():
        rest = texts[i][1 + (len(texts[i]) - 1) // SEGMENT * SEGMENT :]
        for symbol in rest:
            now = (now @ model.move) * model.emit[symbol]
            size = now.sum()
            out[i] += np.log(size)
            now /= size
    return out


def _sequences(part: pa.RecordBatch) -> list[np.ndarray]:
    """Each text's classes with the end after them."""
    return [np.append(np.frombuffer(x.as_buffer(), np.int16), np.int16(_END)) for x in part.column("symbols")]


def _last_shares(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    """The states' shares after each whole sequence."""
    out = np.zeros((len(texts), len(model.start)))
    for own, lengths, symbols in _packs(texts):
        active = (lengths[None, :] > np.arange(len(symbols))[:, None]).sum(1)
        alpha = np.tile(model.start, (len(own), 1))
        for t, n in enumerate(active):
            alpha[:n] = (alpha[:n] @ model.move if t else alpha[:n]) * model.emit[symbols[t, :n]]
            alpha[:n] /= alpha[:n].sum(1, keepdims=True)
        out[own] = alpha
    return out


@dataclass
class Piece:
    """A text or a segment of a long one: the states' shares ``before`` it (none at a text's start), and
    how likely what follows is ``after`` it from each state, up to a factor."""

    symbols: np.ndarray
    before: np.ndarray | None
    after: np.ndarray


def _pieces(model: Model, texts: list[np.ndarray]) -> list[Piece]:
    """Texts as pieces that the recursions can take side by side, with the same counts as whole texts.

    A long text is cut into segments behind a first piece. All segments' flows from state to state are
    taken together; one walk over a text's flows forward gives the shares before each segment, one back the likelihoods after it.
    """
    ones = np.ones(len(model.start))
    out = [Piece(t, None, ones) for t in texts if len(t) <= 2 * SEGMENT]
    long = [t for t in texts if len(t) > 2 * SEGMENT]
    starts = [(len(t) - 1) % SEGMENT + 1 for t in long]
    shares = _last_shares(model, [t[:a] for t, a in zip(long, starts)])
    segments = [(i, k) for i, t in enumerate(long) for k in range(starts[i], len(t), SEGMENT)]
    flows = []
    for k in range(0, len(segments), _TOGETHER):
        flow, logs = _segments(model, np.stack([long[i][c : c + SEGMENT] for i, c in segments[k : k + _TOGETHER]]))
        flows.append(flow * np.exp(logs - logs.max(1, keepdims=True))[:, :, None])
    flow = np.concatenate(flows) if flows else np.zeros((0, len(ones), len(ones)))
    first = np.searchsorted([i for i, _ in segments], np.arange(len(long) + 1))
    for i, t in enumerate(long):
        own = range(first[i], first[i + 1])
        before, after = {}, {}
        now = shares[i]
        for k in own:
            before[k] = now
            now = now @ flow[k]
            now = now / now.sum()
        back = ones
        for k in reversed(own):
            after[k] = back
            back = flow[k] @ back
            back = back / back.max()
        out.append(Piece(t[: starts[i]], None, back))
        out += [Piece(t[segments[k][1] : segments[k][1] + SEGMENT], before[k], after[k]) for k in own]
    return out


def _expected(shared):
    """Expected counts of one round over a task's texts, as one row for each class and state.

    Key -1 - k has the moves out of state k, key -1 - STATES the starts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        states = len(model.start)
        emit, move = model.emit.astype(np.float32), model.move.astype(np.float32)
        emissions, moves, starts = np.zeros((CLASSES, states)), np.zeros((states, states)), np.zeros(states)
        for batch in batches:
            for part in slices(batch, "symbols", 1 << 20):
                pieces = _pieces(model, _sequences(part))
                for own, lengths, symbols in _packs([p.symbols for p in pieces]):
                    active = (lengths[None, :] > np.arange(len(symbols))[:, None]).sum(1)
                    emitted = emit[symbols]
                    kept = np.zeros_like(emitted)
                    begins = np.array([pieces[i].before is None for i in own])
                    before = np.stack([model.start if pieces[i].before is None else pieces[i].before for i in own])
                    alpha = np.where(begins[:, None], before, before @ model.move).astype(np.float32)
                    scales = _forward(model, alpha, emitted, active, kept)
                    # Now alpha has the shares after each piece.
                    beta = np.stack([pieces[i].after for i in own]).astype(np.float32)
                    beta /= (alpha * beta).sum(1, keepdims=True)
                    for t in range(len(symbols) - 1, -1, -1):
                        n = active[t]
                        after = emitted[t, :n] * beta[:n] / scales[t, :n, None]
                        kept[t, :n] *= beta[:n]
                        if t:
                            # kept[t - 1] still has alpha: it takes part before its own turn.
                            moves += move * (kept[t - 1, :n].T @ after)
                            beta[:n] = after @ move.T
                        else:
                            moves += model.move * (before[~begins].T @ after[~begins])
                    starts += kept[0, begins].sum(0)
                    inside = np.arange(len(symbols))[:, None] < lengths[None, :]
                    flat, weight = symbols[inside], kept[inside]
                    for k in range(states):
                        emissions[:, k] += np.bincount(flat, weight[:, k], CLASSES)
        rows = np.concatenate((emissions, moves, starts[None, :]))
        keys = np.concatenate((np.arange(CLASSES), -1 - np.arange(states), [-1 - states]))
        yield pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(rows[:, k]) for k in range(states))], ["key", *(f"s{k}" for k in range(states))])

    return run


def _first_model(marginal: np.ndarray, states: int) -> Model:
    """States that last, and emissions near the corpus's with fixed noise to tell them apart."""
    noise = mix(np.arange(1, CLASSES * states + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) / 2.0**64 - 0.5
    emit = (marginal + 1e-7)[:, None] * np.exp(noise.reshape(CLASSES, states))
    move = np.full((states, states), 0.05 / max(states - 1, 1))
    np.fill_diagonal(move, 0.95)
    return Model(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def train(texts: DataFrame, marginal: np.ndarray, states: int = STATES, rounds: int = ROUNDS) -> Model:
    """Baum-Welch over all rows of ``texts(symbols)``. A round's counts are summed by Spark, one row
    for each class, move and start; only these sums, of fixed number, come to the driver."""
    model = _first_model(marginal, states)
    spark = texts.sparkSession
    names = [f"s{k}" for k in range(states)]
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model)
        sums = texts.select("symbols").mapInArrow(_expected(shared), "key bigint, " + ", ".join(f"{n} double" for n in names))
        got = sums.groupBy("key").agg(*(F.sum(n).alias(n) for n in names)).toPandas().set_index("key").sort_index()
        shared.unpersist()
        if got.empty or not got.to_numpy().sum():
            break
        counts = got.to_numpy()
        starts, moves, emissions = counts[0], counts[states:0:-1], counts[states + 1 :]
        emissions = emissions + 0.5 * (marginal + 1e-7)[:, None]
        model = Model((starts + 1) / (starts + 1).sum(), (moves + 1) / (moves + 1).sum(1, keepdims=True), emissions / emissions.sum(0))
    return model


def _scored(shared, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "symbols", 1 << 20):
                score = log_likelihood(shared.value, _sequences(part)) / np.log(10)
                yield pa.RecordBatch.from_arrays([*map(part.column, names), pa.array(score)], [*names, "hmm"])

    return run


def _frequent(counts: DataFrame) -> DataFrame:
    """The most frequent words, at most ``FREQUENT``: all from some count on, found by the counts' logarithms."""
    steps = counts.select(F.floor(F.log("n") * 64).alias("step")).groupBy("step").agg(F.count(F.lit(1)).alias("words"))
    least, total = None, 0
    for row in steps.orderBy(F.desc("step")).collect():
        total += row["words"]
        if total > FREQUENT:
            break
        least = row["step"]
    return counts.where(F.floor(F.log("n") * 64) >= least) if least is not None else counts.limit(0)


def score_texts(
    docs: DataFrame, training, doc_id: str = "doc_id", text: str = "text", states: int = STATES, rounds: int = ROUNDS,
) -> DataFrame:
    """Score every text by a hidden Markov model trained on those rows where ``training`` holds.

    Returns one row for each row of ``docs``: ``doc_id``, ``training``, ``n_tokens`` (words and one end),
    ``n_known`` (tokens seen in training), ``train_tokens``, ``base_score`` (log10 probability under the
    smoothed word frequencies of the training texts) and ``score`` (log10 probability under the model).

    A null or empty text is its end alone. Rows where ``training`` is null do not train. With no
    training rows the base score is 0 and the model is even. Repeated rows are scored alike, and
    train as often as they stand in the table. Other columns are not read.

    Words are counted over all training texts. The most frequent ones are sent to all tasks; every
    other word of a text is joined with its count, so a frequent word never crowds a task and the
    vocabulary is never held in one place.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.coalesce(training, F.lit(False)).alias("train"))
    trained = docs.where("train")
    counts = trained.select("text").mapInArrow(_word_counts, "word bigint, n bigint")
    counts = scratch.table(counts.groupBy("word").agg(F.sum("n").alias("n")).withColumn("shared", F.pmod("word", F.lit(SHARED)).cast("int")))
    ends = trained.count()
    top = _frequent(counts).toPandas().sort_values(["n", "word"], ascending=[False, True])
    own = spark.createDataFrame([(int(w),) for w in top["word"].head(OWN)], "word bigint")
    rest = counts.join(F.broadcast(own), "word", "left_anti")
    by_class = rest.groupBy("shared").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).toPandas()
    size, kinds = np.zeros(SHARED), np.zeros(SHARED)
    at = by_class["shared"].to_numpy(np.int64)
    size[at], kinds[at] = by_class["n"], by_class["v"]
    everything = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    n_all, v_all = everything["n"] + ends, everything["v"] + (ends > 0)
    classes = np.full(len(top), -1, np.int16)
    classes[: min(OWN, len(top))] = 1 + np.arange(min(OWN, len(top)))
    marginal = np.zeros(CLASSES)
    marginal[_END] = ends
    marginal[1 : 1 + min(OWN, len(top))] = top["n"].head(OWN)
    marginal[1 + OWN :] = size
    marginal = (marginal + 0.5) / (marginal + 0.5).sum()
    hashes = top["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    vocabulary = Vocabulary(
        hashes[order], top["n"].to_numpy(np.float64)[order], classes[order], np.log10(size + 0.5 * (kinds + 1)), ends
    )
    frequent = spark.createDataFrame([(int(w),) for w in top["word"]], "word bigint")

    shared = spark.sparkContext.broadcast(vocabulary)
    rows = docs.withColumn("row", F.monotonically_increasing_id()).mapInArrow(_prepared(shared), T.StructType([
        T.StructField("row", T.LongType()), docs.schema["doc_id"], *T.DataType.fromDDL(
            "train boolean, n_tokens bigint, known bigint, log_counts double, within double, rare array<bigint>, times array<int>, symbols binary"
        ).fields
    ]))
    rows = scratch.table(rows)
    model = train(rows.where("train"), marginal, states, rounds)
    words = rows.select("row", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("row", F.col("w.rare").alias("word"), F.col("w.times").alias("times"))
    seen = words.join(counts.join(F.broadcast(frequent), "word", "left_anti").select("word", "n"), "word", "left")
    log_c = F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.5))
    added = seen.groupBy(F.col("row").alias("of")).agg(
        F.sum(log_c).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more_known")
    )
    kept = ["row", "doc_id", "train", "n_tokens", "known", "log_counts", "within"]
    scored = rows.select(*kept, "symbols").mapInArrow(_scored(spark.sparkContext.broadcast(model), kept), T.StructType(
        [*(rows.schema[c] for c in kept), T.StructField("hmm", T.DoubleType())]
    ))
    total = float(np.log10(n_all + 0.5 * (v_all + 1)))
    more = F.coalesce("more", F.lit(0.0))
    return scored.join(added, scored["row"] == added["of"], "left").select(
        F.col("doc_id").alias(doc_id), F.col("train").alias("training"), "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(int(n_all)).cast("bigint").alias("train_tokens"),
        (F.col("log_counts") + more - F.col("n_tokens") * F.lit(total)).alias("base_score"),
        (F.col("hmm") + F.col("within") + more).alias("score"),
    )
