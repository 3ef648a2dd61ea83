"""Top-k per group, sorting and paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.sources.tables import materialise

# Up to this k Spark itself drops surplus rows before the shuffle (window group limit).
GROUP_LIMIT = 1000
# Scores are ranked after rounding, so that rows of equal score are ordered by id in every run.
SCORE_DIGITS = 10
#: More rows than Spark's limit counts are never skipped or shown.
MAX_ROWS = 2**31 - 1
# Sort fields and orders of a request.
SORT_FIELDS = ("_score", "date", "popularity", "title", "relevancy")
ORDERS = ("asc", "desc")


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, spread_by: str = "id", slices: int = 64, rank: str = "rn") -> DataFrame:
    """The first ``k`` rows of every group, with their rank.

    For a small ``k`` every task keeps ``k`` rows per group before the shuffle. For a large one the
    groups are first cut in slices (by hash of ``spread_by``), so that no group is sorted whole in
    one task; the slices' first rows are then ranked again.
    """
    if k > GROUP_LIMIT:
        df = df.withColumn("_slice", F.pmod(F.xxhash64(spread_by), F.lit(slices)))
        within = Window.partitionBy(*keys, "_slice").orderBy(*order)
        df = df.withColumn("_r", F.row_number().over(within)).filter(F.col("_r") <= k).drop("_r", "_slice")
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col(rank) <= k)


def sort_spec(sort: str | None, order: str | None, lang: str = "en") -> tuple[str, str]:
    """Checked ``(column, asc|desc)`` of one request."""
    field = (sort or "relevancy").lower()
    if field not in SORT_FIELDS:
        raise ValueError(f"unsupported sort field {sort!r}, expected one of {SORT_FIELDS}")
    direction = (order or ("asc" if field == "title" else "desc")).lower()
    if direction not in ORDERS:
        raise ValueError(f"sort order must be one of {ORDERS}, got {order!r}")
    if field in ("_score", "relevancy"):
        return "score", "desc"
    if field == "title":
        return ("title_fr" if lang == "fr" else "title_en"), direction
    return ("published" if field == "date" else "popularity"), direction


def order_columns(sort: str | None, order: str | None, lang: str = "en", key: str = "id") -> list[Column]:
    """Nulls last in both directions, ties by id."""
    column, direction = sort_spec(sort, order, lang)
    c = rank_score() if column == "score" else F.col(column)
    return [c.asc_nulls_last() if direction == "asc" else c.desc_nulls_last(), F.col(key).asc()]


def page(df: DataFrame, order: list[Column], size: int = 10, start: int = 0) -> DataFrame:
    """One page of a sorted table with 1-based ``row_num``; only ``start + size`` rows are ever kept."""
    size, start = min(size, MAX_ROWS), min(start, MAX_ROWS)
    rows = df.orderBy(*order).offset(start).limit(size) if start else df.orderBy(*order).limit(size)
    # The page is bounded by its size, so numbering it in one window is safe.
    return rows.withColumn("row_num", F.row_number().over(Window.orderBy(*order)))


def rank_score(column: str = "score") -> Column:
    return F.round(column, SCORE_DIGITS)


def batch_order() -> list[Column]:
    """Ordering of rows that carry their own ``sort`` and ``order`` (see ``normalise_requests``)."""
    number = f"CASE sort WHEN '_score' THEN round(score, {SCORE_DIGITS}) WHEN 'popularity' THEN double(popularity) END"
    text = "CASE sort WHEN 'date' THEN published WHEN 'title' THEN IF(lang = 'fr', title_fr, title_en) END"
    return [
        F.expr(f"IF(`order` = 'asc', {number}, -({number}))").asc_nulls_last(),
        F.expr(f"CASE WHEN `order` = 'asc' THEN {text} END").asc_nulls_last(),
        F.expr(f"CASE WHEN `order` <> 'asc' THEN {text} END").desc_nulls_last(),
        F.col("id").asc(),
    ]


#: The last row of a page, whatever its start and size.
LAST_ROW = f"coalesce(try_add(`from`, size), {2**63 - 1})"


def pages(matches: DataFrame, keys: list[str], depths: dict[str, int]) -> DataFrame:
    """The page every request asks for. ``matches`` carries ``size`` and ``from``.

    ``depths`` has the largest last row of shallow pages (up to ``GROUP_LIMIT``) and of deep ones. They
    are ranked apart, so one deep page does not make all others rank as deep.
    """
    out = None
    for name, wanted in (("shallow", f"{LAST_ROW} <= {GROUP_LIMIT}"), ("deep", f"{LAST_ROW} > {GROUP_LIMIT}")):
        if depths[name] <= 0:
            continue
        rows = matches.filter(wanted)
        ranked = top_k(rows, keys, batch_order(), depths[name]) if name == "shallow" else ranked_by_range(rows, keys, batch_order(), f"`from` < {LAST_ROW}", "`from`", LAST_ROW)
        inside = ranked.filter(f"rn > `from` AND rn <= {LAST_ROW}").withColumn("row_num", F.expr("int(rn - `from`)")).drop("rn")
        out = inside if out is None else out.unionByName(inside)
    return matches.withColumn("row_num", F.lit(0)).filter(F.lit(False)) if out is None else out


def ranked_by_range(df: DataFrame, keys: list[str], order: list[Column], wanted: str, first: str, last: str) -> DataFrame:
    """Rows that are ``wanted`` with their rank ``rn`` in their group, those at least whose rank is above ``first`` and up to ``last``.

    Rows are dealt by ranges of group and order, whose bounds Spark samples, and stored with the number of their range.
    A range's rows of a group are counted, the counts of the ranges before it add up to where it starts, and
    only ranges that hold a wanted rank are ranked, each by itself. So no group is sorted in one task, however deep.
    """
    stored = materialise(df.filter(wanted).repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))
    counts = stored.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"), F.first(F.expr(first)).alias("_first"), F.first(F.expr(last)).alias("_last"))
    # One row for each group and range.
    upto = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_range"))
    starts = counts.withColumn("_before", upto - F.col("_n")).filter("_before < _last AND _before + _n > _first").select(*keys, "_range", "_before")
    inside = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order))
    return stored.join(starts, [*keys, "_range"]).withColumn("rn", F.col("_before") + inside).drop("_range", "_before")


def page_depths(asked: DataFrame) -> dict[str, int]:
    """The largest last row of shallow and of deep pages, 0 where there are none."""
    last = F.expr(LAST_ROW)
    row = asked.agg(
        F.max(F.when(last <= GROUP_LIMIT, last)).alias("shallow"), F.max(F.when(last > GROUP_LIMIT, last)).alias("deep")
    ).first()
    return {"shallow": row["shallow"] or 0, "deep": row["deep"] or 0}
