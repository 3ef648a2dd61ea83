"""BM25 over catalogue fields.

The text index is four tables: ``doc_terms`` (one row per record and field, terms with their
frequency kept in the row), and, derived from it, ``postings``, ``term_stats`` and ``field_stats``.
Building ``doc_terms`` needs no shuffle; the statistics are partially aggregated before theirs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from lodestar.functions.common import let, run_lengths
from lodestar.functions.text import analyse
from lodestar.schemas import B, K1
from lodestar.sources.tables import materialise

# Above this many fields the per-field sums become rows instead of columns.
MAX_FIELD_COLUMNS = 24
# Pairs of a posting and a query that a task makes on the mean.
TASK_PAIRS = 1 << 18


def field_text(schema: StructType, path: str) -> str:
    """The text of a field; the elements of an array field are joined by blanks."""
    node = schema
    for part in path.split("."):
        node = node[part].dataType
    return f"array_join({path}, ' ')" if isinstance(node, ArrayType) else f"CAST({path} AS string)"


@dataclass
class TextIndex:
    """Text statistics of a catalogue for a fixed list of fields."""

    doc_terms: DataFrame
    fields: list[str]

    @property
    def postings(self) -> DataFrame:
        """``(field, id, dl, term, tf)``."""
        return self.doc_terms.select("field", "id", "dl", F.inline("terms"))

    @property
    def doc_lengths(self) -> DataFrame:
        return self.doc_terms.select("field", "id", "dl")

    @property
    def field_stats(self) -> DataFrame:
        """``(field, n_docs, avgdl)`` over records with at least one token in the field."""
        return self.doc_terms.groupBy("field").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))

    @property
    def term_stats(self) -> DataFrame:
        """``(field, term, df)``."""
        return self.postings.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))

    def materialise(self) -> "TextIndex":
        """Tokenise once: write ``doc_terms`` to the shared folder and continue from there."""
        return TextIndex(materialise(self.doc_terms), self.fields)

    def postings_of(self, terms: DataFrame) -> DataFrame:
        """A superset of the postings of ``terms(term)``; here all of them."""
        return self.postings

    def frequencies_of(self, terms: DataFrame) -> DataFrame:
        """``(field, term, df)`` of the given terms."""
        wanted = terms.select("term").distinct()
        kept = self.postings.select("field", "term").join(wanted, "term", "left_semi")
        return kept.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))

    def narrowed(self, fields: list[str]) -> "TextIndex":
        return TextIndex(self.doc_terms.filter(F.col("field").isin(fields)), fields)

    def save(self, path: str, buckets: int = 1024) -> None:
        """Write postings and statistics by field and word bucket, see :class:`SavedIndex`.

        The rebalance hint splits the partition of a frequent word and joins small ones.
        """
        by_bucket = f"pmod(xxhash64(term), {buckets}) AS bucket"
        for name, table in (("postings", self.postings), ("term_stats", self.term_stats)):
            rows = table.selectExpr("*", by_bucket).hint("rebalance", "field", "bucket")
            writer = rows.sortWithinPartitions("field", "bucket", "term").write.mode("overwrite")
            writer.partitionBy("field", "bucket").parquet(f"{path}/{name}")
        self.field_stats.selectExpr("*", f"{buckets} AS buckets").write.mode("overwrite").parquet(f"{path}/field_stats")


class SavedIndex:
    """A text index on disk. A query reads only the buckets its words fall in."""

    def __init__(self, spark: SparkSession, path: str, fields: list[str]):
        self.spark, self.path, self.fields = spark, path, fields

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}").filter(F.col("field").isin(self.fields))

    @property
    def field_stats(self) -> DataFrame:
        return self._read("field_stats").drop("buckets")

    def _in_buckets_of(self, name: str, terms: DataFrame) -> DataFrame:
        total = self._read("field_stats").first()["buckets"]
        # At most ``buckets`` numbers come to the driver; as literals they prune partitions.
        needed = terms.selectExpr(f"pmod(xxhash64(term), {total}) AS bucket").distinct().collect()
        return self._read(name).filter(F.col("bucket").isin([r["bucket"] for r in needed])).drop("bucket")

    def postings_of(self, terms: DataFrame) -> DataFrame:
        return self._in_buckets_of("postings", terms)

    def frequencies_of(self, terms: DataFrame) -> DataFrame:
        return self._in_buckets_of("term_stats", terms).join(terms.select("term").distinct(), "term", "left_semi")

    def narrowed(self, fields: list[str]) -> "SavedIndex":
        return SavedIndex(self.spark, self.path, fields)


def build_index(catalogue: DataFrame, fields: list[str], key: str = "id") -> TextIndex:
    """Tokenise ``fields`` of every record and count terms inside the row."""
    texts = ", ".join(f"named_struct('field', '{f}', 'text', {field_text(catalogue.schema, f)})" for f in fields)
    counted = f"named_struct('dl', size(toks_), 'terms', {run_lengths('toks_')})"
    one_or_none = let("toks_", analyse("text"), f"IF(size(toks_) > 0, array({counted}), array())")
    # The outer generator with the filter behind it: a filter on the expression itself would be
    # pushed below the projection and tokenise every text a second time.
    doc_terms = (
        catalogue.selectExpr(f"{key} AS id", f"inline(array({texts}))")
        .filter("text <> ''")
        .selectExpr("id", "field", f"inline_outer({one_or_none})")
        .filter("dl IS NOT NULL")
    )
    return TextIndex(doc_terms, fields)


def query_terms(queries: DataFrame, text: str = "q") -> DataFrame:
    """``(q, term, qtf)`` for every distinct query text."""
    distinct = queries.selectExpr(f"{text} AS q").filter("q <> ''").distinct()
    counted = distinct.selectExpr("q", f"inline_outer({run_lengths(analyse('q'), 'term', 'qtf')})")
    return counted.filter("term IS NOT NULL")


def term_weights(terms: DataFrame, index: TextIndex, boosts: dict[str, float], k1: float = K1, b: float = B,
                 found: DataFrame | None = None) -> DataFrame:
    """``(q, field, term, weight, c0, c1, df)`` such that a posting scores ``weight*tf/(tf+c0+c1*dl)``.

    Document frequencies are counted only for words that some query has, in ``found``, all postings of
    these words, if that is given.
    """
    frequencies = index.frequencies_of(terms) if found is None else found.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))
    boost = "CASE field " + " ".join(f"WHEN '{f}' THEN {float(x)!r}D" for f, x in boosts.items()) + " END"
    # field_stats has one row per field of a fixed field list, so broadcasting it is bounded.
    return (
        terms.join(frequencies, "term")
        .join(F.broadcast(index.field_stats), "field")
        .selectExpr(
            "q", "field", "term",
            f"qtf * ln(1 + (n_docs - df + 0.5D) / (df + 0.5D)) * {k1 + 1!r}D * {boost} AS weight",
            f"{k1 * (1 - b)!r}D AS c0",
            f"{k1 * b!r}D / avgdl AS c1", "df",
        )
    )


def _hits(queries: DataFrame, index: TextIndex, boosts: dict[str, float], text: str, also: DataFrame | None = None) -> DataFrame:
    narrowed = index.narrowed([f for f in index.fields if f in boosts])
    terms = materialise(query_terms(queries, text))
    # The postings are read once; what the queries' words have is small and gives counts and scores.
    found = materialise(narrowed.postings_of(terms).join(terms.select("term").distinct(), "term", "left_semi"))
    # Written, the weights have a measured size: the planner broadcasts them when it is small, and
    # otherwise joins on (field, term), where the postings of frequent words are split at run time.
    weights = term_weights(terms, narrowed, boosts, found=found)
    if also is not None:
        # Such a pair is a posting without a score, of a field without a name.
        none = lambda table, **given: [f"CAST({given.get(c.name, 'NULL')} AS {c.dataType.simpleString()}) AS {c.name}" for c in table.schema]
        found = found.unionByName(also.selectExpr(*none(found, field="''", id="id", term="q")))
        weights = weights.unionByName(also.select("q").distinct().selectExpr(*none(weights, q="q", field="''", term="q", df="0")))
    weights = materialise(weights)
    # A record's postings lie in one task before each meets its queries: they are far fewer than the pairs they make, and
    # these are summed, and joined by id, where they are made. The number of tasks is given, as only the pairs tell it.
    pairs = weights.agg(F.sum("df")).first()[0] or 0
    found = found.repartition(max(found.sparkSession.sparkContext.defaultParallelism, -(-pairs // TASK_PAIRS)), "id")
    return found.join(weights, ["field", "term"]).selectExpr(
        "q", "id", "field", "weight * tf / (tf + c0 + c1 * dl) AS part"
    )


def field_scores(queries: DataFrame, index: TextIndex, boosts: dict[str, float] | None = None, text: str = "q", also: DataFrame | None = None) -> DataFrame:
    """``(q, id, field, score)``: BM25 sum over the query's words, any word may match."""
    boosts = boosts or {f: 1.0 for f in index.fields}
    return _hits(queries, index, boosts, text, also).groupBy("q", "id", "field").agg(F.sum("part").alias("score"))


def best_fields(queries: DataFrame, index: TextIndex, boosts: dict[str, float] | None = None, text: str = "q", also: DataFrame | None = None) -> DataFrame:
    """``(q, id, score)``: the highest boosted field score; the pairs ``also(q, id)`` have a row too, without a score if no word matches.

    One shuffle of the postings by ``id``: the sum of every field is a column of the same aggregation. While the words'
    weights are small enough to be broadcast, the result is dealt by ``id`` and a join on it shuffles only the other side.
    """
    boosts = boosts or {f: 1.0 for f in index.fields}
    fields = [f for f in index.fields if f in boosts]
    if len(fields) > MAX_FIELD_COLUMNS:
        return field_scores(queries, index, boosts, text, also).groupBy("q", "id").agg(F.max("score").alias("score"))
    hits = _hits(queries, index, boosts, text, also)
    sums = ", ".join(f"sum(part) FILTER (WHERE field = '{f}')" for f in fields)
    best = f"greatest({sums})" if len(fields) > 1 else sums
    return hits.groupBy("q", "id").agg(F.expr(best).alias("score"))
