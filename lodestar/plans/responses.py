"""Responses: nested GeoJSON per request, flat rows, plain result table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.plans.search import SearchResult
from lodestar.schemas import JSON_FIELDS

HIDDEN = ("vector", "coordinates", "load_seq", "begin_date", "end_date", "xmin", "ymin", "xmax", "ymax")


def feature_collection(fields: list[str]) -> Column:
    """One hit as a one-feature collection; geometry apart, everything else a property."""
    properties = F.struct("row_num", "relevancy", *fields)
    feature = F.struct(
        F.lit("Feature").alias("type"), F.col("coordinates").alias("geometry"), properties.alias("properties")
    )
    return F.struct(F.lit("FeatureCollection").alias("type"), F.array(feature).alias("features"))


def response_items(result: SearchResult, catalogue: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """``(req_id, row_num, item)``. Only the hits of the pages fetch their catalogue columns."""
    whole = {f"{c}_json": c for c in JSON_FIELDS if f"{c}_json" in catalogue.columns}
    fields = fields or [c for c in catalogue.columns if c not in HIDDEN and c not in whole]
    # A response shows the JSON fields as they were sent, not only the parts that are searched.
    shown = {c: j for j, c in whole.items()}
    columns = [F.col(shown.get(c, c)).alias(c) for c in dict.fromkeys(["id", "coordinates", *fields])]
    joined = result.hits.join(catalogue.select(*columns), "id")
    return joined.select("req_id", "row_num", feature_collection(fields).alias("item"))


def geojson_responses(result: SearchResult, catalogue: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """One row per request: method, total and returned hits, facets, items in page order."""
    items = response_items(result, catalogue, fields)
    pages = items.groupBy("req_id").agg(
        F.array_sort(F.collect_list(F.struct("row_num", F.to_json("item").alias("item")))).alias("_items"),
        F.count(F.lit(1)).cast("int").alias("returned_hits"),
    )
    buckets = result.facets.groupBy("req_id", "facet").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rn", "value", "doc_count"))),
            lambda b: F.struct(b["value"].alias("key"), b["doc_count"].alias("doc_count")),
        ).alias("buckets")
    )
    aggs = buckets.groupBy("req_id").agg(F.map_from_entries(F.collect_list(F.struct("facet", "buckets"))).alias("aggs"))
    return (
        result.requests.select("req_id", "method")
        .join(result.totals, "req_id")
        .join(pages, "req_id", "left")
        .join(aggs, "req_id", "left")
        .select(
            "req_id", "method",
            F.struct(
                "total_hits",
                F.coalesce("returned_hits", F.lit(0)).alias("returned_hits"),
                "aggs",
                F.coalesce(F.transform("_items", lambda i: i["item"]), F.array().cast("array<string>")).alias("items"),
            ).alias("response"),
        )
    )


def flat_responses(result: SearchResult, catalogue: DataFrame, fields: list[str]) -> DataFrame:
    """One row per hit with ``row_num``, ``relevancy`` and ``total`` (rows on the page)."""
    per_page = Window.partitionBy("req_id")
    return (
        result.hits.withColumn("total", F.count(F.lit(1)).over(per_page))
        .join(catalogue.select(*dict.fromkeys(["id", *fields])), "id")
        .select("req_id", "row_num", "relevancy", "total", *dict.fromkeys(["id", *fields]))
    )


def result_table(hits: DataFrame, catalogue: DataFrame, title: str = "title_en") -> DataFrame:
    """``(_id, score, title, id)`` of the hits."""
    return hits.join(catalogue.select("id", F.col(title).alias("title")), "id").select(
        F.col("id").alias("_id"), "score", "title", "id"
    )
