"""Preference pairs of conversations as prompt and masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What stands around a turn.
OPEN, AFTER_ROLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def _rendered(turns: Column) -> Column:
    """Each turn as text."""
    return F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(AFTER_ROLE), t["text"], F.lit(CLOSE)))


def _spans(turns: Column, trained: str) -> Column:
    """Character ranges, in the rendered turns, of the text and end mark of turns of the trained role."""
    ends = F.aggregate(
        turns,
        F.lit(None).cast("array<struct<start: bigint, end: bigint, role: string>>"),
        lambda done, t: F.concat(
            F.coalesce(done, F.array().cast("array<struct<start: bigint, end: bigint, role: string>>")),
            F.array(F.struct(
                (_last(done) + F.lit(len(OPEN) + len(AFTER_ROLE)) + F.char_length(t["role"])).cast("bigint").alias("start"),
                (_last(done) + F.lit(len(OPEN) + len(AFTER_ROLE) + len(CLOSE)) + F.char_length(t["role"]) + F.char_length(t["text"])).cast("bigint").alias("end"),
                t["role"].alias("role"),
            )),
        ),
    )
    return F.coalesce(
        F.transform(F.filter(ends, lambda s: s["role"] == trained), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))),
        F.array().cast("array<struct<start: bigint, end: bigint>>"),
    )


def _last(done: Column) -> Column:
    return F.when(F.coalesce(F.size(done), F.lit(0)) > 0, F.element_at(done, -1)["end"]).otherwise(F.lit(0).cast("bigint"))


def preference_pairs(turns: DataFrame, trained: str = "assistant") -> DataFrame:
    """Format ``turns(pair_id, side, turn, role, text)``, ``side`` being ``chosen`` or ``rejected``.

    Returns one row for each pair: ``pair_id``; ``n_common``, the turns of the longest common prefix;
    ``prompt``, these turns rendered once; ``chosen`` and ``rejected``, the rest of each conversation; and
    ``chosen_mask`` and ``rejected_mask``, the character ranges of these that are trained on: text and end mark of
    turns of the role ``trained``.

    Turns are in the order of their number, null first, equal numbers by role and text, so repeated rows
    are turns of their own. Turns are common if role and text are equal; the numbers may differ. A null
    role or text counts as empty. A pair with one side only has no common turns and an empty text on the
    other. Equal conversations are all prompt. Rows without a pair, or with another side, belong to no
    pair and are left out. Other columns are not read; an empty table gives an empty one.

    One shuffle, by pair, brings a pair's turns together, and they are one row of the result anyway;
    a frequent conversation or first turn is spread over its pairs.
    """
    known = turns.where("pair_id IS NOT NULL AND side IN ('chosen', 'rejected')").select(
        "pair_id", "side", F.struct(
            F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
        ).alias("t"),
    )
    sides = known.groupBy("pair_id").agg(*(
        F.array_sort(F.collect_list(F.when(F.col("side") == side, F.col("t"))), _in_order).alias(side) for side in ("chosen", "rejected")
    ))
    shorter = F.least(F.size("chosen"), F.size("rejected"))
    differs = F.filter(
        F.sequence(F.lit(1), F.greatest(shorter, F.lit(1))),
        lambda i: (i > shorter) | (F.get("chosen", i - 1)["role"] != F.get("rejected", i - 1)["role"]) | (F.get("chosen", i - 1)["text"] != F.get("rejected", i - 1)["text"]),
    )
    split = sides.withColumn("n_common", F.coalesce(F.get(differs, F.lit(0)) - 1, shorter))
    rest = split.select(
        "pair_id", "n_common", F.slice("chosen", F.lit(1), F.col("n_common")).alias("common"),
        *(F.slice(s, F.col("n_common") + 1, F.greatest(F.size(s) - F.col("n_common"), F.lit(0))).alias(s) for s in ("chosen", "rejected")),
    )
    return rest.select(
        "pair_id", F.col("n_common").cast("bigint").alias("n_common"), F.array_join(_rendered(F.col("common")), "").alias("prompt"),
        *(F.array_join(_rendered(F.col(s)), "").alias(s) for s in ("chosen", "rejected")),
        *(_spans(F.col(s), trained).alias(f"{s}_mask") for s in ("chosen", "rejected")),
    )


def _in_order(a: Column, b: Column) -> Column:
    def compare(x: Column, y: Column, otherwise: Column) -> Column:
        return F.when(x.isNull() & y.isNotNull(), -1).when(x.isNotNull() & y.isNull(), 1).when(x < y, -1).when(x > y, 1).otherwise(otherwise)

    return compare(a["turn"], b["turn"], compare(a["role"], b["role"], compare(a["text"], b["text"], F.lit(0))))
