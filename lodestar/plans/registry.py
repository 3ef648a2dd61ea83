"""The registered queries: one per operator, each over whole tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import json_fields as J
from lodestar.functions import text as T
from lodestar.functions import vectors as V
from lodestar.functions.spatial import polygons_intersect, ring_literal
from lodestar.operators import bm25, enrich, evaluate, ingest, knn
from lodestar.operators import filters as fl
from lodestar.operators.facets import facet_columns, facet_counts
from lodestar.operators.ranking import order_columns, sort_spec, top_k
from lodestar.plans import fixtures as X
from lodestar.plans import responses, search
from lodestar.plans.requests import normalise_requests, rejected_requests
from lodestar.schemas import CONTACT, FACET_FIELDS, FILTER_FIELDS, CatalogueSpec
from lodestar.sources import catalogue, tables
from lodestar.streaming import logs

Query = Callable[[SparkSession, str], DataFrame]
P = X.P
REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def _joined(c: str | Column) -> Column:
    return F.array_join(c, "|", "<null>")


def _raw(spark, sf):
    return ingest.null_sentinels(ingest.select_columns(X.raw_records(spark, sf)))


def _r6(c: str | Column, name: str) -> Column:
    return F.round(c, 6).alias(name)


# --- sources and catalogue maintenance -------------------------------------------------------------


@query
def scan_union_dedupe(spark, sf):
    """A collection and a reload of it, read as one table; the row loaded last of each id."""
    reload = tables.read_table(spark, sf, "documents").select("doc_id", (F.col("n_chars") + 1).alias("n_chars"), F.lit("reload").alias("note"))
    path = tables.work_dir(spark)
    tables.replace_table(reload, path)
    both = tables.read_records(spark, f"{sf}/documents.parquet", path)
    return ingest.last_per_id(both.select("doc_id", "n_chars", "load_seq", "note"), "doc_id")


@query
def upsert(spark, sf):
    """Labelled documents are loaded again, twice in one load; the later row holds."""
    old = ingest.to_catalogue(X.raw_records(spark, sf)).select("id", "popularity")
    labels = tables.read_table(spark, sf, "labels")
    new = labels.select(F.concat(F.lit("doc-"), F.col("doc_id")).alias("id"), (F.col("quality") + 5000).cast("int").alias("popularity"))
    twice = new.withColumn("load_seq", F.lit(1)).unionByName(new.select("id", (F.col("popularity") - 1).alias("popularity"), F.lit(0).alias("load_seq")))
    return ingest.upsert(old, twice, order="load_seq").select("id", F.col("popularity").cast("bigint").alias("popularity"))


@query
def catalogue_load(spark, sf):
    """The stored catalogue after two loads, the second one with other numbers for some records, each twice."""
    path = tables.work_dir(spark)
    spec = CatalogueSpec(vector_dim=64)
    raw = X.raw_records(spark, sf)
    catalogue.load(raw, path, spec, X.theme_tags(spark, sf), X.foundational_tags(spark, sf))
    labels = tables.read_table(spark, sf, "labels").select(F.concat(F.lit("doc-"), F.col("doc_id")).alias(P + "id"), "quality")
    again = raw.join(labels, P + "id").withColumn("load_seq", F.lit(0))
    later = again.withColumn("features_popularity", (F.col("quality") + 5000).cast("string")).withColumn("load_seq", F.lit(1))
    catalogue.load(again.unionByName(later).drop("quality"), path, spec, X.theme_tags(spark, sf), X.foundational_tags(spark, sf))
    return catalogue.read(spark, path, spec).select("id", F.col("popularity").cast("bigint").alias("popularity"), F.size("vector").cast("bigint").alias("dim"))


@query
def upsert_repeated(spark, sf):
    """Three loads of the stored catalogue: all, labelled records three times each, and of these every third again."""
    path, spec = tables.work_dir(spark), CatalogueSpec(vector_dim=64)
    raw = X.raw_records(spark, sf)
    catalogue.load(raw, path, spec, buckets=8)
    labels = tables.read_table(spark, sf, "labels").select(F.concat(F.lit("doc-"), F.col("doc_id")).alias(P + "id"), F.col("doc_id").alias("n"))
    again = raw.join(labels, P + "id").withColumn("load_seq", F.explode(F.array(F.lit(2), F.lit(0), F.lit(1))))
    catalogue.load(again.withColumn("features_popularity", (F.col("load_seq") + 7000).cast("string")).drop("n"), path, spec)
    catalogue.load(again.where("n % 3 = 0 AND load_seq = 0").withColumn("features_popularity", F.lit("8000")).drop("n", "load_seq"), path, spec)
    return catalogue.read(spark, path, spec).select("id", F.col("popularity").cast("bigint").alias("popularity"))


@query
def count_check(spark, sf):
    path = tables.work_dir(spark)
    tables.replace_table(ingest.to_catalogue(X.raw_records(spark, sf)).select("id"), path)
    return tables.count_check(spark, path)


@query
def append_table(spark, sf):
    """Two loads without ids keep every row of both."""
    path = tables.work_dir(spark)
    rows = ingest.to_catalogue(X.raw_records(spark, sf)).select("id", "systemName")
    tables.create_if_absent(spark, path, rows.schema)
    tables.append_table(rows, path)
    tables.append_table(rows, path)
    return spark.read.parquet(path).groupBy("systemName").agg(F.count(F.lit(1)).alias("n"))


@query
def clear_table(spark, sf):
    path = tables.work_dir(spark)
    tables.replace_table(ingest.to_catalogue(X.raw_records(spark, sf)).select("id", "systemName"), path)
    removed = tables.clear_table(spark, path)
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("left"), F.lit(removed).cast("bigint").alias("removed"))


@query
def tag_scan(spark, sf):
    """Key-value export written as JSON lines, read back and unwrapped."""
    path = tables.work_dir(spark)
    wrapped = X.theme_tags(spark, sf).select(
        F.struct(F.col("uuid").alias("S")).alias("uuid"), F.struct(F.col("tag").alias("S")).alias("tag")
    )
    wrapped.write.json(path)
    return tables.read_tags(spark, path, "tag")


@query
def quarantine(spark, sf):
    good, bad = ingest.split_bad_rows(X.raw_records(spark, sf))
    return good.select(F.col(P + "id").alias("id"), F.lit("good").alias("part")).unionByName(
        bad.select(F.col(P + "id").alias("id"), F.lit("bad").alias("part"))
    )


@query
def lookup_by_id(spark, sf):
    c = ingest.to_catalogue(X.raw_records(spark, sf))
    return c.filter(F.col("id") == "doc-42").select("id", "title_en", "systemName")


@query
def head(spark, sf):
    return ingest.to_catalogue(X.raw_records(spark, sf)).orderBy("id").limit(20).select("id", "title_en")


@query
def match_all(spark, sf):
    return ingest.to_catalogue(X.raw_records(spark, sf)).select("id")


# --- projections -----------------------------------------------------------------------------------


@query
def select_sentinel_struct(spark, sf):
    return ingest.build_extent(_raw(spark, sf)).select(
        F.col(P + "id").alias("id"),
        F.col("temporalExtent.begin").alias("extent_begin"),
        F.col("temporalExtent.end").alias("extent_end"),
        F.col(P + "date_published_date").alias("published"),
        F.col(P + "date_created_date").alias("created"),
    )


@query
def embedding_text(spark, sf):
    return _raw(spark, sf).select(F.col(P + "id").alias("id"), F.expr(ingest.embedding_text()).alias("text"))


@query
def embedding_text_bilingual(spark, sf):
    return _raw(spark, sf).select(F.col(P + "id").alias("id"), F.expr(ingest.embedding_text_bilingual()).alias("text"))


@query
def null_concat(spark, sf):
    return _raw(spark, sf).select(F.col(P + "id").alias("id"), F.expr(ingest.all_text()).alias("text"))


@query
def organisation_first(spark, sf):
    return _raw(spark, sf).select(
        F.col(P + "id").alias("id"),
        F.expr(J.organisation_first(P + "contact")).alias("contact_en"),
        F.expr(J.organisation_first(P + "cited")).alias("cited_en"),
    )


@query
def organisation_segment(spark, sf):
    org = F.expr(J.organisation_segment(P + "cited", P + "contact"))
    return _raw(spark, sf).select(F.col(P + "id").alias("id"), org.alias("o")).select(
        "id", F.col("o.en").alias("org_en"), F.col("o.fr").alias("org_fr")
    )


@query
def source_default(spark, sf):
    return _raw(spark, sf).select(
        F.col(P + "id").alias("id"), F.expr(ingest.source_system(P + "sourceSystemName")).alias("system")
    )


@query
def partial_dates(spark, sf):
    c = ingest.to_catalogue(X.raw_records(spark, sf))
    return c.select("id", F.col("begin_date").cast("string").alias("begin_date"), F.col("end_date").cast("string").alias("end_date"))


@query
def mappable_flag(spark, sf):
    return _raw(spark, sf).select(
        F.col(P + "id").alias("id"), F.expr(J.mappable_flag(J.options_of(P + "options"))).alias("mappable")
    )


@query
def resource_types(spark, sf):
    return _raw(spark, sf).select(
        F.col(P + "id").alias("id"), _joined(F.expr(J.resource_types(J.options_of(P + "options")))).alias("types")
    )


@query
def safe_json(spark, sf):
    """Contacts that do not parse, or are missing, become an empty list."""
    contacts = F.expr(J.safe_json(P + "contact", CONTACT.simpleString()))
    return _raw(spark, sf).select(F.col(P + "id").alias("id"), F.size(contacts).cast("bigint").alias("n_contacts"))


@query
def document_projection(spark, sf):
    c = X.catalogue(spark, sf)
    return c.select(
        "id", "title_en", "title_fr", "published", "created", "language",
        _joined("keywords_en").alias("keywords_en"), _joined("keywords_fr").alias("keywords_fr"),
        _joined("topicCategory").alias("topics"), _joined("theme").alias("theme"), _joined("type").alias("type"),
        _joined("options.protocol").alias("protocols"),
        F.expr("variant_get(options_json, '$[1].url', 'string')").alias("option_url"), F.expr("variant_get(options_json, '$[1].name.en', 'string')").alias("option_name"),
        F.expr("variant_get(contact_json, '$[0].email.en', 'string')").alias("contact_email"), F.size("contact").cast("bigint").alias("n_contact"),
        F.size("cited").cast("bigint").alias("n_cited"),
        "mappable", "foundational", F.col("popularity").cast("bigint").alias("popularity"), "systemName", "eoCollection",
        _joined(F.flatten("eoFilters.polarizations")).alias("polarizations"),
        _joined("eoFilters.orbitState").alias("orbits"),
    )


@query
def polygon_build(spark, sf):
    c = ingest.to_catalogue(X.raw_records(spark, sf))
    return c.select(
        "id", F.col("coordinates.type").alias("geom_type"), F.size(F.flatten("coordinates.coordinates")).cast("bigint").alias("n_points"),
        "xmin", "ymin", "xmax", "ymax",
    )


@query
def theme_bins(spark, sf):
    return _raw(spark, sf).select(F.col(P + "id").alias("id"), _joined(F.expr(J.theme_bins(P + "topicCategory"))).alias("themes"))


@query
def comma_arrays(spark, sf):
    return _raw(spark, sf).select(
        F.col(P + "id").alias("id"),
        *[_joined(F.expr(J.comma_array(P + c))).alias(c) for c in ("topicCategory", "keywords_en", "keywords_fr")],
    )


@query
def topic_rewrite(spark, sf):
    """Topics of the EO collections are spelled the special way, the others kept."""
    topic = f"CASE WHEN {P}eoCollection = 'sentinel-1' THEN 'Earth Observation; Synthetic Aperature Radar' ELSE {P}topicCategory END"
    return _raw(spark, sf).selectExpr(f"{P}id AS id", f"{topic} AS topic").select("id", F.expr(ingest.topic_rewrite("topic")).alias("topic"))


@query
def theme_join_append(spark, sf):
    c = ingest.to_catalogue(X.raw_records(spark, sf)).select("id", "theme")
    return ingest.join_tags(c, X.theme_tags(spark, sf), allowed=ingest.THEME_TAGS).select("id", _joined("theme").alias("theme"))


@query
def foundational_flag(spark, sf):
    c = X.catalogue(spark, sf)
    return c.select("id", _joined("theme").alias("theme"), "foundational")


@query
def id_override(spark, sf):
    """Documents labelled toxic get a fixed organisation in their first contact."""
    labels = tables.read_table(spark, sf, "labels").filter("toxic = 1")
    overrides = labels.select(
        F.concat(F.lit("doc-"), F.col("doc_id")).alias("id"),
        F.struct(F.lit("Override;Office").alias("en"), F.lit("Bureau").alias("fr")).alias("organisation"),
    )
    c = ingest.override_organisation(ingest.to_catalogue(X.raw_records(spark, sf)).select("id", "contact"), "contact", overrides)
    first = F.get("contact", 0)
    return c.select("id", first["organisation"]["en"].alias("org_en"), first["organisation"]["fr"].alias("org_fr"))


@query
def localised_fields(spark, sf):
    """French records are the translations; the others show the fall-back texts."""
    c = X.catalogue(spark, sf)
    french = c.filter(F.col("title_fr").isNotNull()).select(
        "id", F.col("title_fr").alias("title"), F.col("description_fr").alias("description"), _joined("keywords_fr").alias("keywords")
    )
    return enrich.localise(c.select("id"), french)


# --- text and vectors ------------------------------------------------------------------------------


@query
def tokens_standard(spark, sf):
    return X.documents(spark, sf).select("doc_id", F.expr(T.analyse("text")).alias("t")).select(
        "doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.array_join("t", " ").alias("tokens")
    )


@query
def clean_text(spark, sf):
    return X.documents(spark, sf).select("doc_id", T.clean_text("text", stemmed=False).alias("clean"))


@query
def clean_text_stemmed(spark, sf):
    return X.documents(spark, sf).select("doc_id", T.clean_text("text").alias("clean"))


@query
def stem_vocabulary(spark, sf):
    tokens = F.explode_outer(F.expr(T.clean_tokens("text", T.long_stopwords())))
    words = X.documents(spark, sf).select(tokens.alias("word")).filter("word IS NOT NULL").distinct()
    return words.select("word", T.stem("word").alias("stem"))


@query
def highlight(spark, sf):
    c = X.catalogue(spark, sf)
    return search.highlighted(search.keyword_search(X.requests(spark, sf), c), c).select("req_id", "id", "highlight")


def _docs(spark, sf):
    return X.documents(spark, sf).select(F.concat(F.lit("doc-"), F.col("doc_id")).alias("id"), "text")


@query
def bm25_stats(spark, sf):
    index = bm25.build_index(_docs(spark, sf), ["text"]).materialise()
    return index.term_stats.join(F.broadcast(index.field_stats), "field").select(
        "field", "term", "df", "n_docs", _r6("avgdl", "avgdl")
    )


def _queries(spark, sf):
    return X.requests(spark, sf).select("q")


@query
def match_single_field(spark, sf):
    index = bm25.build_index(_docs(spark, sf), ["text"]).materialise()
    return bm25.field_scores(_queries(spark, sf), index).select("q", "id", _r6("score", "score"))


@query
def multi_match(spark, sf):
    index, boosts = search.search_index(X.catalogue(spark, sf), dict.fromkeys(search.KEYWORD_PATTERNS, 1.0))
    return bm25.best_fields(_queries(spark, sf), index.materialise(), boosts).select("q", "id", _r6("score", "score"))


@query
def multi_match_boosted(spark, sf):
    patterns = {"keywords*": 2.0, "description*": 1.5, "title*": 1.5, "topicCategory": 1.0, "organisation*": 1.0, "systemName": 1.0}
    index, boosts = search.search_index(X.catalogue(spark, sf), patterns)
    return bm25.best_fields(_queries(spark, sf), index.materialise(), boosts).select("q", "id", _r6("score", "score"))


@query
def mean_pool(spark, sf):
    """Vectors of a label pooled; a negative first component masks a vector out."""
    v = X.vectors(spark, sf).withColumn("mask", F.when(F.get("embedding", 0) >= 0, 1).otherwise(0))
    pooled = V.mean_pool(v, "label", "embedding", "mask")
    return pooled.select(F.col("label").cast("bigint").alias("label"), F.posexplode("vector").alias("dim", "value")).select(
        "label", F.col("dim").cast("bigint").alias("dim"), _r6("value", "value")
    )


@query
def l2_normalise(spark, sf):
    v = X.vectors(spark, sf).select("vec_id", F.expr(V.l2_normalise("transform(embedding, y -> double(y) * 3)")).alias("v"))
    return v.select("vec_id", F.posexplode("v").alias("dim", "value")).select(
        "vec_id", F.col("dim").cast("bigint").alias("dim"), _r6("value", "value")
    )


@query
def vector_quality(spark, sf):
    q = V.vector_quality(X.catalogue(spark, sf, True))
    return q.select(*[F.col(c).cast("bigint").alias(c) for c in q.columns])


@query
def embed_hashing(spark, sf):
    v = V.embed(X.documents(spark, sf), "text")
    return v.select("doc_id", F.posexplode_outer("vector").alias("dim", "value")).filter("value <> 0").select(
        "doc_id", F.col("dim").cast("bigint").alias("dim"), F.round(F.col("value").cast("double"), 6).alias("value")
    )


def _centroids(spark, sf):
    v = X.vectors(spark, sf).withColumn("mask", F.lit(1))
    return V.mean_pool(v, "label", "embedding", "mask")


def _neighbours(found):
    return found.select(
        F.col("qid").cast("bigint").alias("qid"), F.col("id").cast("bigint").alias("id"),
        F.col("rn").cast("bigint").alias("rn"), _r6("score", "score"),
    )


@query
def knn_exact(spark, sf):
    """The 20 vectors nearest to the mean vector of every label."""
    return _neighbours(knn.knn(_centroids(spark, sf), X.vectors(spark, sf), 20, query_key="label", key="vec_id", vector="embedding"))


@query
def knn_scored(spark, sf):
    found = knn.knn(_centroids(spark, sf), X.vectors(spark, sf), 10, "linear", "label", "vector", "vec_id", "embedding")
    return _neighbours(found)


@query
def knn_join(spark, sf):
    """The 5 nearest vectors of every vector."""
    v = X.vectors(spark, sf)
    return _neighbours(knn.knn_join(v, v, 5, query_key="vec_id", query_vector="embedding", key="vec_id", vector="embedding"))


@query
def knn_cells(spark, sf):
    """The 5 nearest vectors of every vector in the 6 cells nearest to it; the means of the labels are the centres."""
    v = X.vectors(spark, sf)
    means = _centroids(spark, sf).orderBy("label").toPandas()
    centres = knn.unit_rows(means["vector"])
    return _neighbours(
        knn.knn_cells(v, v, centres, 5, 6, query_key="vec_id", query_vector="embedding", key="vec_id", vector="embedding")
    )


@query
def knn_tree(spark, sf):
    """The 5 nearest vectors of every vector in its 8 nearest cells, of the 4 nearest coarse cells; cells grow with the rows."""
    v = X.vectors(spark, sf)
    return _neighbours(knn.knn_tree(v, v, 5, 8, 4, query_key="vec_id", query_vector="embedding", key="vec_id", vector="embedding"))


# --- filters ---------------------------------------------------------------------------------------

FILTER_VALUES = {
    "type": "service, api",
    "protocol": "w?s, esri",
    "theme": "ENVIRON, econ",
    "topic_category": "waters",
    "org": "org 1, cited",
    "foundational": "true",
    "source_system": "ccmeo*dms, cube",
    "mappable": "true",
    "eo_collection": "rcm",
    "polarization": "vh",
    "orbit_direction": "desc",
}


def _filtered(request: dict) -> Query:
    def run(spark, sf):
        c = X.catalogue(spark, sf)
        return c.filter(fl.predicate(c.schema, request, X.TODAY)).select("id")

    return run


for _name in FILTER_FIELDS:
    REGISTRY[f"filter_{_name}"] = _filtered({_name: FILTER_VALUES[_name]})

REGISTRY["filter_begin"] = _filtered({"begin": "2005"})
REGISTRY["filter_end"] = _filtered({"end": "2015-02"})
REGISTRY["filter_range"] = _filtered({"begin": "1995-06", "end": "2015"})
REGISTRY["filter_end_null"] = _filtered({"end": "null"})
REGISTRY["filter_end_present"] = _filtered({"end": "present"})
REGISTRY["filter_conjunction"] = _filtered({"theme": "environment", "mappable": "true", "begin": "2000", "bbox": "-130,45,-80,75"})
BBOX = "-120.0, 49.0, -100.0, 60.0"
REGISTRY["bbox_intersects"] = _filtered({"bbox": BBOX})
REGISTRY["bbox_disjoint"] = _filtered({"bbox": BBOX, "relation": "disjoint"})
REGISTRY["bbox_within"] = _filtered({"bbox": BBOX, "relation": "within"})
REGISTRY["bbox_contains"] = _filtered({"bbox": "-100,50,-99,50.5", "relation": "contains"})
REGISTRY["bbox_antimeridian"] = _filtered({"bbox": "100,40,-120,70"})

SHAPE = [(-110.0, 45.0), (-90.0, 45.0), (-90.0, 62.0), (-110.0, 62.0)]


@query
def polygon_intersects(spark, sf):
    c = X.catalogue(spark, sf)
    return c.filter(polygons_intersect(fl.RINGS, ring_literal(SHAPE))).select("id")


@query
def keyword_and_shape(spark, sf):
    c = X.catalogue(spark, sf)
    inside = c.filter(polygons_intersect(fl.RINGS, ring_literal(SHAPE))).select("id")
    index, boosts = search.search_index(c, search.KEYWORD_PATTERNS)
    return bm25.best_fields(_queries(spark, sf), index.materialise(), boosts).join(inside, "id", "left_semi").select(
        "q", "id", _r6("score", "score")
    )


# --- ranking, facets, search -----------------------------------------------------------------------


def _paged(request: dict) -> Query:
    def run(spark, sf):
        rows = search.browse(X.catalogue(spark, sf), request, X.TODAY)
        return rows.select(F.col("row_num").cast("bigint").alias("row_num"), "id", F.col("popularity").cast("bigint").alias("popularity"), "title_en", "published")

    return run


REGISTRY["browse_popularity"] = _paged({"q": "", "topic_category": "inlandWaters", "size": "5"})
REGISTRY["page_2"] = _paged({"q": "", "size": "10", "from": "10"})
REGISTRY["sort_title"] = _paged({"q": "x", "sort": "title", "size": "25"})
REGISTRY["sort_date"] = _paged({"q": "x", "sort": "date", "order": "desc", "size": "25"})


def _facet(name: str) -> Query:
    def run(spark, sf):
        c = X.catalogue(spark, sf).withColumn("k", F.lit("all"))
        chosen = {name: facet_columns(c.schema)[name]}
        return facet_counts(c, chosen, ["k"]).select("value", "doc_count", "sum_other")

    return run


for _name in FACET_FIELDS:
    REGISTRY["facet_" + _name.removeprefix("unique_")] = _facet(_name)


def _stored(spark, sf):
    """The catalogue as a written table: a search reads it several times, a few columns each."""
    return tables.materialise(X.catalogue(spark, sf, True))


def _hybrid(spark, sf, **options):
    return search.semantic_search(X.requests(spark, sf), _stored(spark, sf), X.TODAY, **options)


def _hits(result):
    return result.hits.select(
        "req_id", F.col("row_num").cast("bigint").alias("row_num"), "id", _r6("score", "score"), _r6("relevancy", "relevancy")
    )


@query
def hybrid_search(spark, sf):
    return _hits(_hybrid(spark, sf))


@query
def saved_index_search(spark, sf):
    """The hybrid search over a stored index; only the buckets of the requests' words are read."""
    c, path = _stored(spark, sf), tables.work_dir(spark)
    index = search.text_index(c)
    index.save(path, 64)
    return _hits(search.semantic_search(X.requests(spark, sf), c, X.TODAY, bm25.SavedIndex(spark, path, index.fields)))


@query
def hybrid_min_score(spark, sf):
    """A stricter cut than the default."""
    return _hits(_hybrid(spark, sf, min_score=0.65))


@query
def hybrid_no_cut(spark, sf):
    """Without a cut every mappable record is a hit, so flag-only rows are listed as well."""
    return _hybrid(spark, sf, min_score=None).totals


@query
def hybrid_prefilter(spark, sf):
    return _hits(_hybrid(spark, sf, prefilter=True))


@query
def hybrid_prefilter_no_cut(spark, sf):
    return _hybrid(spark, sf, prefilter=True, min_score=None).totals


@query
def flag_clause(spark, sf):
    c = X.catalogue(spark, sf)
    weight = search.flag_weight(c)
    return c.select("id", _r6(F.expr(f"coalesce({search.flag_clause('mappable', weight)}, 0D)"), "score"))


@query
def facets_all(spark, sf):
    return _hybrid(spark, sf).facets.select("req_id", "facet", "value", "doc_count", "sum_other")


@query
def total_hits(spark, sf):
    return _hybrid(spark, sf).totals


@query
def keyword_search(spark, sf):
    return _hits(search.keyword_search(X.requests(spark, sf), X.catalogue(spark, sf)))


@query
def keyword_search_filtered(spark, sf):
    return _hits(search.keyword_search(X.requests(spark, sf), X.catalogue(spark, sf), apply_filters=True))


@query
def method_dispatch(spark, sf):
    return _hits(search.search(X.requests(spark, sf), _stored(spark, sf), X.TODAY))


@query
def normalised_requests(spark, sf):
    r = normalise_requests(X.requests(spark, sf), X.TODAY)
    return r.select(
        "req_id", "q", "lang", "sort", "order", F.col("size").cast("bigint").alias("size"), F.col("from").cast("bigint").alias("from"),
        _joined("f_org").alias("f_org"), F.col("f_begin").cast("string").alias("f_begin"), F.col("f_end").cast("string").alias("f_end"),
        "f_relation", F.get("f_box", 0).alias("west"),
    )


@query
def requests_rejected(spark, sf):
    """Every request with one parameter spoiled, depending on its language and order."""
    bad = X.requests(spark, sf).withColumn(
        "bbox", F.when(F.col("lang") == "en", "1,2,3").when(F.col("lang") == "fr", "200,0,0,0").otherwise("0,0,1,1")
    )
    return rejected_requests(normalise_requests(bad, X.TODAY))


@query
def geojson_response(spark, sf):
    """Hits flattened again out of the nested responses."""
    c = _stored(spark, sf)
    result = search.semantic_search(X.requests(spark, sf), c, X.TODAY)
    r = responses.geojson_responses(result, c, ["id", "title_en", "mappable", "options", "contact"])
    item = F.explode("response.items").alias("item")
    flat = r.select("req_id", "method", "response.total_hits", "response.returned_hits", F.size("response.aggs").alias("n_facets"), item)

    def at(path):
        return F.get_json_object("item", "$.features[0]." + path)

    return flat.select(
        "req_id", "method", "total_hits", F.col("returned_hits").cast("bigint").alias("returned_hits"),
        F.get_json_object("item", "$.type").alias("item_type"), at("geometry.type").alias("geometry_type"),
        at("geometry.coordinates[0][0][0]").cast("double").alias("west"),
        at("properties.row_num").cast("bigint").alias("row_num"), at("properties.id").alias("id"),
        at("properties.title_en").alias("title_en"), at("properties.mappable").alias("mappable"),
        at("properties.options[1].url").alias("option_url"), at("properties.contact[0].role").alias("contact_role"),
    )


@query
def flat_response(spark, sf):
    c = X.catalogue(spark, sf)
    r = responses.flat_responses(search.keyword_search(X.requests(spark, sf), c), c, ["title_en", "systemName"])
    return r.select(
        "req_id", F.col("row_num").cast("bigint").alias("row_num"), _r6("relevancy", "relevancy"), "total", "id", "title_en", "systemName"
    )


@query
def result_table(spark, sf):
    c = X.catalogue(spark, sf)
    hits = search.keyword_search(X.requests(spark, sf), c).hits
    return responses.result_table(hits, c).select("_id", _r6("score", "score"), "title", "id")


@query
def sort_columns(spark, sf):
    """The checked sort column of every request, decided row by row."""
    r = normalise_requests(X.requests(spark, sf), X.TODAY)
    allowed = {s: sort_spec(s, None)[0] for s in ("relevancy", "date", "popularity", "title")}
    mapped = F.when(F.col("sort") == "_score", allowed["relevancy"])
    for name in ("date", "popularity", "title"):
        mapped = mapped.when(F.col("sort") == name, allowed[name])
    return r.select("req_id", mapped.alias("sort_column"), "order")


# --- logs and addresses ----------------------------------------------------------------------------


@query
def client_address(spark, sf):
    c = X.clients(spark, sf)
    return c.select("event_id", F.expr(enrich.client_address("ip_address", "ip_address_forward")).alias("ip"))


@query
def geo_point(spark, sf):
    b = X.ip_blocks(spark, sf).select("start_ip", "end_ip", F.expr(enrich.geo_point("location")).alias("p"))
    return b.select("start_ip", "end_ip", F.col("p.lat").alias("lat"), F.col("p.lon").alias("lon"))


@query
def ip_to_place(spark, sf):
    c = X.clients(spark, sf).withColumn("ip", F.expr(enrich.client_address("ip_address", "ip_address_forward")))
    placed = enrich.add_place(c, X.ip_blocks(spark, sf), "ip")
    return placed.select("event_id", "ip", "country_name", F.col("location.lat").alias("lat"), F.col("location.lon").alias("lon"))


@query
def slow_log_parse(spark, sf):
    return logs.parse_slow_log(X.slow_log(spark, sf))


@query
def log_streams(spark, sf):
    return logs.list_streams(X.slow_log(spark, sf))


NOW = dt.datetime(2024, 1, 1, 2, 30, tzinfo=dt.timezone.utc)


@query
def log_time_window(spark, sf):
    return logs.recent(X.slow_log(spark, sf), NOW, 60).select("stream", "timestamp")


@query
def log_stream_exclude(spark, sf):
    return logs.without_test_streams(X.slow_log(spark, sf)).select("stream", "timestamp")


@query
def log_etl_batch(spark, sf):
    """The log delivered twice: repeated events are written once."""
    log = X.slow_log(spark, sf)
    return logs.slow_log_etl(log.unionByName(log))


@query
def log_etl_stream(spark, sf):
    """The same as a stream, JSON files in, Parquet out: the newer half first, then all of it, so that the
    second run over the same checkpoint meets events that are old and events it has seen."""
    base = tables.work_dir(spark)
    source, sink, checkpoint = f"{base}/in", f"{base}/out", f"{base}/checkpoint"
    log = X.slow_log(spark, sf)
    for part in (log.filter("timestamp % 2000 = 0"), log):
        part.write.mode("append").json(source)
        logs.start_stream(spark, source, sink, checkpoint).awaitTermination()
    return spark.read.parquet(sink).select("timestamp", "filters_applied", "search_string")


@query
def log_etl_late(spark, sf):
    """Loads that overlap, late ones and one repeated, some events without a time: each distinct event once."""
    sink = tables.work_dir(spark)
    log = X.slow_log(spark, sf).withColumn("timestamp", F.expr("CASE WHEN timestamp % 5000 <> 0 THEN timestamp END"))
    for part in (log.filter("timestamp IS NULL OR timestamp % 2000 = 0"), log, log):
        logs.load_new_events(part, sink)
    return spark.read.parquet(sink).select("timestamp", "filters_applied", "search_string")


@query
def request_log(spark, sf):
    """Requests with the address of the event of the same number."""
    c = X.clients(spark, sf).select(
        F.col("event_id").cast("string").alias("req_id"), "ip_address", "ip_address_forward",
        (F.lit(1704067200000) + F.col("event_id") * 1000).cast("string").alias("timestamp"),
    )
    r = X.requests(spark, sf).join(c, "req_id")
    path = tables.work_dir(spark)
    logs.append_request_log(logs.request_log(r, X.ip_blocks(spark, sf)), path)
    out = spark.read.parquet(path)
    return out.select(
        "req_id", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("ts"), "lang", "q", "sort_param", "order_param",
        "organization_filter", "relation", F.col("size").cast("bigint").alias("size"), F.col("from").cast("bigint").alias("from"),
        F.col("ip2geo.country_name").alias("country"), F.col("ip2geo.location.lat").alias("lat"),
    )


# --- evaluation ------------------------------------------------------------------------------------


@query
def judged_pairs(spark, sf):
    return X.judged(spark, sf)


def _ranks(spark, sf):
    """Text ranking of the documents for every request, all hits ranked up to 5."""
    index = bm25.build_index(_docs(spark, sf), ["text"]).materialise()
    requests = X.requests(spark, sf).select("req_id", "q")
    scored = bm25.best_fields(requests.select("q"), index)
    top = top_k(scored, ["q"], order_columns("relevancy", "desc"), 5, rank="rank")
    return evaluate.first_relevant(requests.join(top, "q").select("req_id", "id", "rank"), X.judged(spark, sf), requests, 5)


@query
def mrr_at_5(spark, sf):
    return evaluate.mrr_at_k(_ranks(spark, sf)).select(_r6("mrr", "mrr"))


@query
def acc_at_5(spark, sf):
    return evaluate.acc_at_k(_ranks(spark, sf)).select(_r6("acc", "acc"))


@query
def summary(spark, sf):
    c = ingest.to_catalogue(X.raw_records(spark, sf)).withColumn("n_chars", F.length("description_en"))
    s = evaluate.summary(c, ["popularity", "n_chars"])
    return s.select("column", "n", *[_r6(x, x) for x in ("mean", "std", "min", "q25", "q50", "q75", "max")])


