"""Ranking quality and table summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.functions.common import let, literal
from lodestar.operators.containment import holding
from lodestar.sources.tables import materialise


def first_relevant(results: DataFrame, judged: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """``(req_id, rank)``: rank of the first judged hit among the first ``k``, null when there is none."""
    relevant = results.filter(F.col("rank") <= k).join(judged.select("req_id", "id").distinct(), ["req_id", "id"])
    best = relevant.groupBy("req_id").agg(F.min("rank").alias("rank"))
    return queries.select("req_id").distinct().join(best, "req_id", "left")


def mrr_at_k(ranks: DataFrame) -> DataFrame:
    return ranks.agg(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("mrr"))


def acc_at_k(ranks: DataFrame) -> DataFrame:
    return ranks.agg(F.avg(F.col("rank").isNotNull().cast("double")).alias("acc"))


#: Distinct passages, and characters of them in all, that are looked for in every text directly.
MAX_SCANNED, MAX_SCANNED_CHARS = 256, 1 << 20
#: Candidates are sent to the texts, not the texts to them, up to so many bytes of them (measured).
MAX_CANDIDATE_BYTES = 64 << 20


def judged_pairs(documents: DataFrame, passages: DataFrame, n_words: int = 5) -> DataFrame:
    """``(req_id, id)``: documents that contain a passage.

    A few passages (their number is checked) are looked for in each text, in one scan without a shuffle. More are found by
    equi-joins on parts of them. The words of a passage except its first and last stand between blanks in both texts. A passage of
    ``n_words`` more than these two is found by the run of words after its first one; one of three words or
    more by the inner word that the fewest documents hold. A shorter passage stands inside one word, or at the
    end of one and the start of the next: its longer piece is looked up among the distinct words of
    all documents, by their runs of a few characters, and the words that hold it find the documents.
    So texts are read word by word, each kind of passage only if there is one, and no step
    looks at a text character by character. Candidates are checked against the whole text.
    Null and empty passages judge nothing.
    """
    blank = literal(r"\s+")
    asked = passages.filter("passage <> ''").select("req_id", "passage").distinct()
    distinct = materialise(asked.select("passage").distinct())
    measured = distinct.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.char_length("passage")), F.lit(0)).alias("chars")).first()
    if measured["n"] <= MAX_SCANNED and measured["chars"] <= MAX_SCANNED_CHARS:
        few = [r["passage"] for r in distinct.collect()]
        held = F.filter(F.array(*map(F.lit, few)), lambda passage: F.contains(F.col("text"), passage)) if few else F.array().cast("array<string>")
        return documents.select("id", F.explode(held).alias("passage")).join(asked, "passage").select("req_id", "id").distinct()
    p = distinct.selectExpr("passage", f"split(passage, {blank}) AS ws")
    is_long, is_inner, is_short = f"size(ws) >= {n_words + 2}", f"size(ws) BETWEEN 3 AND {n_words + 1}", "size(ws) < 3"
    kinds = p.agg(*[F.coalesce(F.expr(f"bool_or({c})"), F.lit(False)) for c in (is_long, is_inner, is_short)]).first()
    pairs = documents.sparkSession.createDataFrame([], f"passage string, id {documents.schema['id'].dataType.simpleString()}")
    sure = pairs
    if kinds[0]:
        run = f"xxhash64(array_join(slice(ws, {{}}, {n_words}), ' '))"
        runs = f"CASE WHEN size(ws) >= {n_words} THEN transform(sequence(1, size(ws) - {n_words} + 1), i -> {run.format('i')}) END"
        held = documents.selectExpr("id", f"explode({let('ws', f'split(text, {blank})', runs)}) AS run")
        pairs = pairs.unionByName(held.join(p.filter(is_long).selectExpr("passage", f"{run.format(2)} AS run"), "run").select("passage", "id"))
    if kinds[1] or kinds[2]:
        # A text with a blank also holds a word that stands for all its blanks.
        every = f"array_distinct(concat(split(text, {blank}), CASE WHEN text rlike {blank} THEN array(' ') ELSE array() END))"
        words = documents.selectExpr("id", f"explode({every}) AS word")
        inner = p.filter(is_inner).selectExpr("passage", "explode(slice(ws, 2, size(ws) - 2)) AS word")
        short = p.filter(is_short).selectExpr(
            "passage", "size(ws) = 1 AS one",
            "CASE WHEN ws = array('', '') THEN ' ' WHEN size(ws) = 1 OR char_length(ws[0]) >= char_length(ws[1]) THEN ws[0] ELSE ws[1] END AS piece",
        )
        inside = materialise(holding(words.select("word").distinct(), short.select("piece").distinct()))
        wanted = inside.select("word").unionByName(inner.select("word")).distinct()
        hits = materialise(words.join(wanted, "word"))
        rarest = inner.join(hits.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "word", "left")
        rarest = rarest.groupBy("passage").agg(F.min_by("word", F.struct(F.coalesce("n", F.lit(0)), "word")).alias("word"))
        pairs = pairs.unionByName(hits.join(rarest, "word").select("passage", "id"))
        near = hits.join(inside, "word").select("piece", "id").distinct().join(short, "piece")
        # What has no blank and stands in a word stands in the text.
        sure = near.filter("one").select("passage", "id")
        pairs = pairs.unionByName(near.filter("NOT one").select("passage", "id"))
    pairs = materialise(pairs.distinct())
    size = pairs.agg(F.sum(F.octet_length("passage") + F.octet_length(F.col("id").cast("string")) + 64)).first()[0]
    if (size or 0) <= MAX_CANDIDATE_BYTES:
        pairs = F.broadcast(pairs)
    checked = documents.select("id", "text").join(pairs, "id").filter(F.contains("text", "passage")).select("passage", "id")
    return asked.join(checked.unionByName(sure), "passage").select("req_id", "id").distinct()


def summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: count, mean, standard deviation, extremes and quartiles."""
    tall = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns
    ])))
    rows = tall.groupBy("column").agg(
        F.count("value").alias("n"),
        F.avg("value").alias("mean"),
        F.stddev("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    return rows.join(quartiles(tall), "column", "left").select("column", "n", "mean", "std", "min", "q25", "q50", "q75", "max")


def quartiles(tall: DataFrame, parts: int = 256) -> DataFrame:
    """Exact quartiles ``(column, q25, q50, q75)`` of ``tall(column, value)``: the values of rank ceil(p * n).

    Values are counted, dealt by range of their rank among approximate quantiles and added up by part;
    only the parts that hold a quartile are then ranked, so no task sorts a whole column.
    """
    counts = tall.filter("value IS NOT NULL").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    edges = counts.groupBy("column").agg(F.percentile_approx("value", [i / parts for i in range(1, parts)], 10 * parts).alias("edges"))
    placed = counts.join(F.broadcast(edges), "column").withColumn("part", F.size(F.filter("edges", lambda e: e < F.col("value")))).drop("edges")
    sums = placed.groupBy("column", "part").agg(F.sum("n").alias("held"))
    # One row for each column and part.
    before = Window.partitionBy("column").orderBy("part")
    sums = sums.select(
        "column", "part", (F.sum("held").over(before) - F.col("held")).alias("before"), F.sum("held").over(before).alias("upto"),
        F.sum("held").over(Window.partitionBy("column")).alias("total"),
    )
    wanted = sums.select("*", F.explode(F.array(*[F.struct(F.lit(c).alias("q"), F.ceil(F.col("total") * p).alias("rank")) for c, p in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75))])).alias("w"))
    wanted = wanted.select("column", "part", "before", "w.q", "w.rank").join(sums.select("column", "part", "upto"), ["column", "part"]).filter("rank > before AND rank <= upto")
    inside = placed.join(F.broadcast(wanted), ["column", "part"])
    running = F.sum("n").over(Window.partitionBy("column", "q").orderBy("value"))
    found = inside.withColumn("upto", running + F.col("before")).filter("upto >= rank")
    return found.groupBy("column").pivot("q", ["q25", "q50", "q75"]).agg(F.min("value"))
