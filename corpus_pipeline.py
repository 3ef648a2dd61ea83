"""A training corpus out of the table ``documents``, in five stages."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import bpe, decontaminate, line_dedup, near_dedup, toxicity
from lodestar.llm.frames import Scratch
from lodestar.session import ship_package
from lodestar.sources.tables import read_table


#: Columns that stages read; all others pass by under other names, so that no operator's own columns meet them.
READ = ("doc_id", "text", "source")


def _passing(docs: DataFrame, run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``run(docs)`` with the columns of ``docs``, whatever they are called."""
    held = {c: c if c in READ else f"__held_{i}" for i, c in enumerate(docs.columns)}
    out = run(docs.select(*[F.col(f"`{c}`").alias(name) for c, name in held.items()]))
    return out.select(*[F.col(name).alias(c) for c, name in held.items()])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half by a classifier fitted on the labelled ones.

    Null and empty texts are scored and stay or go like others; repeated rows are scored alike; rows without an id
    teach nothing. An empty table gives an empty table. Other columns stay as they are.
    """
    ship_package(spark)
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    return _passing(docs, lambda held: toxicity.score(held, model).where("score < 0.5"))


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand on many sites stay at their first place only; every document stays, a null text as null.

    ``n_chars`` is counted anew where a line went. Repeated rows are documents of their own, the first of which by id and
    text holds a line. Other columns stay as they are.
    """
    ship_package(spark)

    def run(held: DataFrame) -> DataFrame:
        found = line_dedup.line_dedup(held)
        if "n_chars" not in docs.columns:
            return found
        own = f"__held_{docs.columns.index('n_chars')}"
        length = F.when(F.col("n_removed") > 0, F.char_length("text").cast("bigint")).otherwise(F.col(own))
        return found.withColumn(own, length)

    return _passing(docs, run)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 80 per cent of its shingles of five words, that of the smallest id.

    Null, empty and blank texts and rows without an id stay; rows that share the kept id all stay. Other columns stay as they are.
    """
    ship_package(spark)
    return _passing(docs, near_dedup.one_of_each)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without ten consecutive words of a benchmark item; null and empty texts stay, repeated rows alike.

    Other columns stay as they are. An empty benchmark drops nothing.
    """
    ship_package(spark)
    return _passing(docs, lambda held: decontaminate.decontaminate(held, read_table(spark, sf_dir, "benchmark")).where("n_hit = 0"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, their number, and digests of the ids and of the bytes they decode to; a null text has
    none, each row its own."""
    ship_package(spark)
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.encode(docs, ranks, public_tokenizers.PATTERN, carry=["doc_id"], result="all")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_common_lines),
    ("minhash_near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("byte_bpe", encode),
]

#: The classifier and the encoding have no SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written and read again by the next."""
    scratch = Scratch(spark)
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, scratch.table(stage(spark, docs, sf_dir))
        scratch.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
