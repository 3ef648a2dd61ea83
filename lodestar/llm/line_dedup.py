"""Boilerplate lines across sites, by HyperLogLog sketches of each line's sites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.frames import Scratch

#: log2 of the registers of a sketch: a standard error of 1.6 per cent.
LG_REGISTERS = 12
#: Relative distance from the threshold, about six standard errors, within which counts are exact.
MARGIN = 0.1

# White space that does not count at a line's ends.
_BLANK = r" \t\r\u000b\f"


def _lines(docs: DataFrame) -> DataFrame:
    """One row for each line that is not blank: its document's key, its place and its 64-bit hash."""
    return docs.select("key", "doc_id", "site", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("pos", "line")).select(
        "key", "doc_id", "site", "pos", F.expr(f"xxhash64(trim(BOTH '{_BLANK}' FROM line))").alias("line")
    ).where(F.col("line") != F.expr("xxhash64('')"))


def boilerplate_lines(lines: DataFrame, min_sites: int) -> DataFrame:
    """The hashes of lines that stand on ``min_sites`` distinct sites or more.

    A sketch of each line's sites is built where the lines are read and merged by the aggregation.
    Estimates clear of the threshold decide; the others are counted exactly, one row for each line
    and site.
    """
    scratch = Scratch(lines.sparkSession)
    low, high = min_sites - max(1.0, MARGIN * min_sites), min_sites + max(1.0, MARGIN * min_sites)
    spread = lines.where("site IS NOT NULL").groupBy("line").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_REGISTERS))).alias("sites")
    ).where(F.col("sites") >= low)
    spread = scratch.table(spread)
    near = spread.where(F.col("sites") <= high).select("line")
    exact = lines.where("site IS NOT NULL").join(near, "line", "left_semi").select("line", "site").distinct()
    sure = spread.where(F.col("sites") > high).select("line")
    return sure.unionByName(exact.groupBy("line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_sites).select("line"))


def line_dedup(docs: DataFrame, min_sites: int = 10, doc_id: str = "doc_id", text: str = "text", site: str = "source") -> DataFrame:
    """Remove lines that stand on ``min_sites`` distinct sites or more, but for their first holder.

    Lines are split at line feeds and compared without white space at their ends; blank lines are
    never removed. A boilerplate line stays at its first place only: that of the smallest id, then
    of the smallest text digest, then first in the text. Returns all columns of ``docs`` with
    ``text`` as it is after removal, and ``n_lines`` and ``n_removed``.

    A null text has no lines and stays null. Rows without a site do not add to any line's spread
    but lose boilerplate lines like others; an id of null comes after all others. Repeated rows get
    the same text each. A document all of whose lines go keeps an empty text; no row is dropped.
    Columns named ``n_lines`` or ``n_removed`` are replaced.

    Every shuffle but the last moves a hash and a place for each line; frequent lines are summed up
    before it. The last brings each text together with the places of its lines to go.
    """
    scratch = Scratch(docs.sparkSession)
    key = F.md5(F.concat_ws("|", F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit(""))))
    lines = _lines(docs.select(
        key.alias("key"), F.col(doc_id).alias("doc_id"), F.col(site).cast("string").alias("site"), F.col(text).alias("text")
    ))
    common = scratch.table(boilerplate_lines(lines, min_sites))
    places = scratch.table(lines.join(common, "line").select("line", "key", "pos", F.col("doc_id").isNull().alias("unnamed"), "doc_id"))
    first = places.groupBy("line").agg(F.min(F.struct("unnamed", "doc_id", "key", "pos")).alias("first"))
    first = scratch.table(first.select("line", F.col("first.key").alias("first_key"), F.col("first.pos").alias("first_pos")))
    gone = places.join(first, "line").where("key <> first_key OR pos <> first_pos")
    gone = gone.groupBy(F.col("key").alias("gone_key")).agg(F.collect_set("pos").alias("gone"))

    row = docs.select(F.struct("*").alias("row"), key.alias("key"))
    whole = F.col(f"row.`{text}`")
    kept = F.filter(F.split(whole, "\n", -1), lambda line, i: ~F.array_contains("gone", i))
    cleaned = F.when(F.col("gone").isNull(), whole).otherwise(F.array_join(kept, "\n"))
    count = F.when(whole.isNull(), 0).otherwise(F.size(F.split(whole, "\n", -1))).cast("bigint")
    removed = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("bigint")
    columns = [cleaned.alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")]
    met = row.join(gone, row["key"] == gone["gone_key"], "left")
    return met.select(*columns, count.alias("n_lines"), removed.alias("n_removed"))
