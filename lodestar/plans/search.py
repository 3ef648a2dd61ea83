"""Batch search: a table of requests against a catalogue table.

Work is done per distinct *match shape* (text + filters) and per distinct *view* (order + page), and
only joined to the requests at the end. A request with a text meets the catalogue through equi-joins
(words, nearest neighbours); its filters are checked on those candidates. A request without a text
has only filters: a few distinct combinations are checked against each catalogue row in one scan, more
are joined on the keys of their rarest clause, see ``operators.predicate_index``.
"""

from __future__ import annotations

import datetime as dt
import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions.text import analyse, highlight
from lodestar.functions.vectors import embed
from lodestar.operators.bm25 import SavedIndex, TextIndex, best_fields, build_index
from lodestar.operators.facets import facet_columns, facet_counts
from lodestar.operators.filtered_knn import filtered_neighbours
from lodestar.operators.filters import FILTER_COLUMNS, batch_predicate, predicate
from lodestar.operators.ingest import expand_patterns
from lodestar.operators.knn import knn, score_of
from lodestar.operators.predicate_index import indexed_matches
from lodestar.operators.ranking import order_columns, page, page_depths, pages, rank_score, top_k
from lodestar.plans.requests import normalise_requests, with_shapes
from lodestar.schemas import (
    FLAG_BOOST,
    HYBRID_PATTERNS,
    KEYWORD_PATTERNS,
    MIN_SCORE,
    SERVICE_K,
    TEXT_BOOST,
)
from lodestar.sources.tables import materialise

# Distinct filter combinations that one catalogue scan checks row by row; more are indexed.
MAX_BROADCAST_SHAPES = 32
NARROW = (
    "id", "published", "popularity", "title_en", "title_fr", "mappable", "options", "organisation",
    "systemName", "eoCollection", "topicCategory", "theme",
)
FILTERED = ("type", "foundational", "eoFilters", "begin_date", "end_date", "coordinates", "xmin", "ymin", "xmax", "ymax")


@dataclass
class SearchResult:
    """``hits(req_id, row_num, score, id)``, ``totals(req_id, total_hits)``,
    ``facets(req_id, facet, value, doc_count, rn, sum_other)``."""

    hits: DataFrame
    totals: DataFrame
    facets: DataFrame
    requests: DataFrame


def flag_weight(catalogue: DataFrame, mode: str = "bm25") -> float:
    """Score of the mappable flag: BM25 of a one-word field, or the flat boost.

    Two counts of one column; a number is needed while the plan is built, because it decides
    whether flag-only records can pass the score cut at all.
    """
    if mode == "constant":
        return FLAG_BOOST
    row = catalogue.agg(
        F.count("mappable").alias("n"), F.count_if(F.col("mappable") == "true").alias("hits")
    ).first()
    return FLAG_BOOST * math.log(1 + (row["n"] - row["hits"] + 0.5) / (row["hits"] + 0.5)) if row["hits"] else 0.0


def flag_clause(mappable: str, weight: float) -> str:
    return f"CASE WHEN {mappable} = 'true' THEN {weight!r}D END"


def search_index(catalogue: DataFrame, patterns: dict[str, float]) -> tuple[TextIndex, dict[str, float]]:
    """Index over every field that the patterns select, and the fields' boosts."""
    boosts = expand_patterns(catalogue.schema, patterns)
    return build_index(catalogue, list(boosts)), boosts


def text_index(catalogue: DataFrame, index: TextIndex | SavedIndex | None = None) -> TextIndex | SavedIndex:
    """The given index, or one over the fields of both kinds of search, tokenised once and written."""
    if index is not None:
        return index
    fields = {**expand_patterns(catalogue.schema, HYBRID_PATTERNS), **expand_patterns(catalogue.schema, KEYWORD_PATTERNS)}
    return build_index(catalogue, list(fields)).materialise()


def text_parts(queries: DataFrame, index: TextIndex, boosts: dict[str, float], also: DataFrame | None = None) -> DataFrame:
    """``(q, id, text_score)`` of the records with a word of the text, and of the pairs ``also(q, id)``, null where no word matches."""
    return best_fields(queries, index, boosts, also=also).select("q", "id", F.col("score").alias("text_score"))


def knn_parts(queries: DataFrame, catalogue: DataFrame, k: int, encoder=None, dim: int = 64) -> DataFrame:
    """``(q, id, knn_score)``: the k nearest of the whole catalogue for every distinct text."""
    texts = queries.select("q").filter(F.col("q") != "").distinct()
    encoded = embed(texts, "q", encoder, "vector", dim)
    found = knn(encoded, catalogue, k, query_key="q", query_vector="vector", key="id", vector="vector")
    return found.select(F.col("qid").alias("q"), "id", F.col("score").alias("knn_score"))


def theta_matches(catalogue: DataFrame, shapes: DataFrame, but: DataFrame | None = None) -> DataFrame | None:
    """Catalogue rows per filter combination, ``but`` for the pairs ``but(match_id, id)``. A few combinations (counted) are
    sent to one catalogue scan and checked there; more meet the catalogue by the keys of their clauses. The pairs to leave
    out meet the records, as a list for each id, before these are joined to combinations."""
    n = shapes.count()
    if n == 0:
        return None
    if n > MAX_BROADCAST_SHAPES:
        return indexed_matches(catalogue, shapes, but)
    allowed = batch_predicate(catalogue.schema)
    if but is None:
        return catalogue.join(F.broadcast(shapes), F.expr(allowed))
    held = but.groupBy("id").agg(F.collect_set("match_id").alias("_held"))
    free = "NOT coalesce(array_contains(_held, match_id), false)"
    return catalogue.join(held, "id", "left").join(F.broadcast(shapes), F.expr(f"{free} AND {allowed}")).drop("_held")


# Missing parts count as nothing.
TEXT_AND_NEAR = f"{TEXT_BOOST!r}D * coalesce(text_score, 0D) + coalesce(knn_score, 0D)"


def combined_score(flag: float) -> str:
    return f"{TEXT_AND_NEAR} + coalesce({flag_clause('mappable', flag)}, 0D)"


def hybrid_matches(shapes: DataFrame, catalogue: DataFrame, index: TextIndex, boosts: dict[str, float],
                   k: int = SERVICE_K, min_score: float | None = MIN_SCORE, flag: float | None = None,
                   prefilter: bool = False, encoder=None, dim: int = 64) -> DataFrame:
    """``(match_id, id, score, …)`` for shapes that have a text.

    score = text + flag + neighbour, each 0 when absent, at least one present; then the cut at
    ``min_score``. Candidates that cannot reach the cut even with the flag are dropped before the
    catalogue is joined.
    """
    flag = flag_weight(catalogue) if flag is None else flag
    narrow = catalogue.select(*NARROW, *FILTERED)
    queries = shapes.select("q").distinct()
    if prefilter:
        return _prefiltered(shapes, catalogue, narrow, lambda also: text_parts(queries, index, boosts, also), k, min_score, flag, encoder, dim)

    cut = -math.inf if min_score is None else min_score
    # The neighbours are few, so they are joined where the text scores lie, which have a row for each of them.
    near = materialise(knn_parts(queries, catalogue, k, encoder, dim))
    parts = text_parts(queries, index, boosts, near.select("q", "id")).join(near, ["q", "id"], "left")
    if cut > -math.inf:
        # The slack covers the rounding of sums taken in another order.
        parts = parts.filter(f"{TEXT_AND_NEAR} + {max(flag, 0.0)!r}D >= {cut - 1e-9!r}D")
    scored = parts.join(narrow, "id").join(shapes, "q").filter(batch_predicate(catalogue.schema))
    scored = scored.withColumn("score", F.expr(combined_score(flag)))
    return _with_flag_only(scored, parts.join(shapes.select("q", "match_id"), "q").select("match_id", "id"), shapes, narrow, min_score, flag)


def _with_flag_only(scored: DataFrame, have: DataFrame, shapes: DataFrame, narrow: DataFrame, min_score: float | None, flag: float) -> DataFrame:
    """Add the records that the flag alone makes a hit, and cut. ``have(match_id, id)`` are the pairs with a part, whether
    the filters allow them or not: a record that they allow has its pair among the scored ones exactly if it is one of these."""
    cut = -math.inf if min_score is None else min_score
    if flag >= cut and flag > 0:
        only = theta_matches(narrow.filter(F.col("mappable") == "true"), shapes, have)
        if only is not None:
            scored = scored.unionByName(only.withColumn("score", F.lit(flag)), allowMissingColumns=True)
    return scored.filter(F.col("score") >= cut) if cut > -math.inf else scored


def _prefiltered(shapes, catalogue, narrow, text_with, k, min_score, flag, encoder, dim) -> DataFrame:
    """Neighbours are searched among the records that the filters allow, cells in order of distance. ``text_with(also)`` are the text scores."""
    encoded = embed(shapes.select("match_id", "q"), "q", encoder, "vector", dim).select("match_id", "vector")
    asked = shapes.select("match_id", *FILTER_COLUMNS).join(encoded, "match_id")
    near = filtered_neighbours(catalogue, asked, [*NARROW, *FILTERED], k, theta_matches)
    near = materialise(near.selectExpr("match_id", "id", f"{score_of('cos')} AS knn_score", "true AS _near"))
    texts = shapes.select("match_id", "q")
    text = text_with(near.join(texts, "match_id").select("q", "id")).join(texts, "q").drop("q")
    # A text's pair without a word is there for the combinations only of which it is a neighbour.
    parts = text.join(near, ["match_id", "id"], "left").filter("text_score IS NOT NULL OR _near").drop("_near")
    scored = parts.join(narrow, "id").join(shapes, "match_id").filter(batch_predicate(catalogue.schema))
    scored = scored.withColumn("score", F.expr(combined_score(flag)))
    return _with_flag_only(scored, parts.select("match_id", "id"), shapes, narrow, min_score, flag)


def browse_matches(shapes: DataFrame, catalogue: DataFrame) -> DataFrame | None:
    """Matches of shapes without a text; no score."""
    found = theta_matches(catalogue.select(*NARROW, *FILTERED), shapes)
    return None if found is None else found.withColumn("score", F.lit(None).cast("double"))


def _answer(matches: DataFrame, asked: DataFrame) -> SearchResult:
    """Totals, facets and pages of a match table, joined to the requests that asked for them."""
    totals = matches.groupBy("match_id").agg(F.count(F.lit(1)).alias("total_hits"))
    facets = facet_columns(matches.schema, "en")
    french = facet_columns(matches.schema, "fr")["unique_org"]
    facets["unique_org"] = f"IF(org_lang = 'en', {facets['unique_org']}, {french})"
    counted = facet_counts(matches, facets, ["match_id"])

    views = asked.select("view_id", "match_id", "lang", "sort", "order", "size", "from").distinct()
    columns = matches.select("match_id", "id", "score", "published", "popularity", "title_en", "title_fr")
    paged = pages(columns.join(views, "match_id"), ["view_id"], page_depths(views))

    keys = asked.select("req_id", "match_id", "view_id")
    hits = keys.join(paged.selectExpr("view_id", "row_num", "id", "score", "CASE WHEN sort = '_score' THEN score END AS relevancy"), "view_id")
    return SearchResult(
        hits=hits.select("req_id", "row_num", "id", "score", "relevancy"),
        totals=keys.join(totals, "match_id", "left").select("req_id", F.coalesce("total_hits", F.lit(0)).cast("bigint").alias("total_hits")),
        facets=keys.join(counted, "match_id").select("req_id", "facet", "value", "doc_count", "rn", "sum_other"),
        requests=asked,
    )


def semantic_search(requests: DataFrame, catalogue: DataFrame, today: dt.date | None = None,
                    index: TextIndex | SavedIndex | None = None, **options) -> SearchResult:
    """The hybrid search for requests with a text and browsing for those without.

    Give a saved ``index`` to search without tokenising the catalogue.
    """
    asked = materialise(with_shapes(normalise_requests(requests, today)).filter(F.col("reject").isNull()))
    return _semantic(asked, catalogue, text_index(catalogue, index), **options)


def _semantic(asked: DataFrame, catalogue: DataFrame, index: TextIndex | SavedIndex, **options) -> SearchResult:
    boosts = expand_patterns(catalogue.schema, HYBRID_PATTERNS)
    shapes = asked.select("match_id", "org_lang", "q", *FILTER_COLUMNS).distinct()
    with_text = F.col("q") != ""
    scored = materialise(
        hybrid_matches(shapes.filter(with_text), catalogue, index, boosts, **options).select(
            "match_id", "org_lang", "score", *NARROW
        )
    )
    ranked = _answer(scored, asked.filter(with_text))
    browsed = browse_matches(shapes.filter(~with_text).drop("q"), catalogue)
    if browsed is None:
        return SearchResult(ranked.hits, ranked.totals, ranked.facets, asked)
    # Stored once: totals, facets and pages each read the matches, not the catalogue again.
    browsed = materialise(browsed.select("match_id", "org_lang", "score", *NARROW))
    listed = _answer(browsed, asked.filter(~with_text))
    return SearchResult(
        hits=ranked.hits.unionByName(listed.hits),
        totals=ranked.totals.unionByName(listed.totals),
        facets=ranked.facets.unionByName(listed.facets),
        requests=asked,
    )


def keyword_search(requests: DataFrame, catalogue: DataFrame, k: int = SERVICE_K, apply_filters: bool = False,
                   index: TextIndex | SavedIndex | None = None) -> SearchResult:
    """Best-field text search, first ``k`` hits; filters, sort and paging play no part unless
    ``apply_filters``. Facets are empty."""
    asked = materialise(with_shapes(normalise_requests(requests)))
    if index is None:
        index = search_index(catalogue, KEYWORD_PATTERNS)[0].materialise()
    return _keyword(asked, catalogue, index, k, apply_filters)


def _keyword(asked: DataFrame, catalogue: DataFrame, index: TextIndex | SavedIndex, k: int = SERVICE_K, apply_filters: bool = False) -> SearchResult:
    scored = best_fields(asked.select("q"), index, expand_patterns(catalogue.schema, KEYWORD_PATTERNS))
    key = "q"
    if apply_filters:
        shapes = asked.filter(F.col("reject").isNull()).select("match_id", "q", *FILTER_COLUMNS).distinct()
        scored = (
            scored.join(catalogue.select(*NARROW, *FILTERED), "id").join(shapes, "q")
            .filter(batch_predicate(catalogue.schema)).select("match_id", "id", "score")
        )
        key = "match_id"
    scored = materialise(scored)
    top = top_k(scored, [key], [rank_score().desc(), F.col("id").asc()], k, rank="row_num")
    totals = scored.groupBy(key).agg(F.count(F.lit(1)).alias("total_hits"))
    hits = asked.select("req_id", key).join(top, key)
    spark = asked.sparkSession
    facets = "req_id string, facet string, value string, doc_count bigint, rn int, sum_other bigint"
    return SearchResult(
        hits=hits.select("req_id", "row_num", "id", "score", F.col("score").alias("relevancy")),
        totals=asked.select("req_id", key).join(totals, key, "left").select(
            "req_id", F.coalesce("total_hits", F.lit(0)).cast("bigint").alias("total_hits")
        ),
        facets=spark.createDataFrame([], facets),
        requests=asked,
    )


def highlighted(result: SearchResult, catalogue: DataFrame, column: str = "description_en") -> DataFrame:
    """The hits' description with the query's words marked."""
    texts = result.hits.join(result.requests.select("req_id", "q"), "req_id").join(catalogue.select("id", column), "id")
    return texts.withColumn("highlight", F.expr(highlight(column, analyse("q")))).drop(column, "q")


def search(requests: DataFrame, catalogue: DataFrame, today: dt.date | None = None,
           index: TextIndex | SavedIndex | None = None, **options) -> SearchResult:
    """Dispatch by method: ``SemanticSearch`` is hybrid, every other method is a keyword search. Both use one index."""
    asked = materialise(with_shapes(normalise_requests(requests, today)).filter(F.col("reject").isNull()))
    semantic = F.col("method") == "SemanticSearch"
    index = text_index(catalogue, index)
    a = _semantic(asked.filter(semantic), catalogue, index, **options)
    b = _keyword(asked.filter(~semantic), catalogue, index)
    return SearchResult(
        hits=a.hits.unionByName(b.hits), totals=a.totals.unionByName(b.totals),
        facets=a.facets.unionByName(b.facets), requests=asked,
    )


def browse(catalogue: DataFrame, request: dict, today: dt.date | None = None) -> DataFrame:
    """One request without a text: static filters, sort, page."""
    sort = "popularity" if not request.get("q") else request.get("sort")
    order = order_columns(sort, request.get("order"), request.get("lang") or "en")
    rows = catalogue.filter(predicate(catalogue.schema, request, today))
    return page(rows, order, int(request.get("size") or 10), int(request.get("from") or 0))
