"""Catalogue, tags, requests, logs and addresses derived from the given tables.

The given tables hold documents, passages, vectors and events rather than metadata records, so the
record fields are computed from their columns. Every row of a table is used.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.vectors import embed
from lodestar.operators.ingest import embedding_text, normalise
from lodestar.sources.tables import read_table, spread

TODAY = dt.date(2024, 6, 1)
P = "features_properties_"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read_table(spark, sf_dir, "documents"), "doc_id")


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = documents(spark, sf_dir).selectExpr(
        "doc_id", "lang", "n_chars", "text", "replace(text, chr(10), ' ') AS t",
        "-141 + (doc_id * 37) % 80 AS x0", "42 + (doc_id * 17) % 38 AS y0",
        "-141 + (doc_id * 37) % 80 + 1 + doc_id % 9 AS x1", "42 + (doc_id * 17) % 38 + 1 + doc_id % 5 AS y1",
    )
    return s.selectExpr(
        "concat('doc-', CAST(doc_id AS STRING)) AS features_properties_id",
        "concat('[[[', x0, ',', y0, '],[', x1, ',', y0, '],[', x1, ',', y1, '],[', x0, ',', y1, '],[', x0, ',', y0, ']]]')"
        " AS features_geometry_coordinates",
        "concat(split_part(t, ' ', 1), ' ', split_part(t, ' ', 2), ' ', split_part(t, ' ', 3)) AS features_properties_title_en",
        "CASE WHEN lang = 'fr' THEN concat(split_part(t, ' ', 1), ' ', split_part(t, ' ', 2)) END AS features_properties_title_fr",
        "text AS features_properties_description_en",
        "CASE WHEN lang = 'fr' THEN text END AS features_properties_description_fr",
        "concat(split_part(t, ' ', 4), ', ', split_part(t, ' ', 5)) AS features_properties_keywords_en",
        "CASE WHEN lang = 'fr' THEN split_part(t, ' ', 4) END AS features_properties_keywords_fr",
        """CASE doc_id % 4
             WHEN 0 THEN '[7,{"protocol":"OGC:WMS","url":"https://maps.example/wms","name":{"en":"Map"},"description":{"en":"Service;WMS;eng","fr":"Service;WMS;fra"}},{"protocol":"HTTPS","description":{"en":"Dataset;CSV;eng"}}]'
             WHEN 1 THEN '[{"protocol":" ESRI REST: Map Service ","description":{"en":"API; ESRI;eng"}},{"protocol":"HTTPS","description":{"en":"API;JSON;eng"}}]'
             WHEN 2 THEN '{"protocol":"HTTPS","description":{"en":"Dataset;CSV;eng"}}'
             ELSE CASE WHEN doc_id % 8 = 3 THEN 'not json' ELSE '[{"protocol":"HTTPS"}]' END END AS features_properties_options""",
        """CASE WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 13 = 1 THEN '{bad'
             ELSE concat('[{"role":"owner","email":{"en":"x@example.org"},"organisation":{"en":"Government;Org ', CAST(doc_id % 11 AS STRING), ' ;Branch","fr":"Gouvernement;Org F', CAST(doc_id % 11 AS STRING), '"}}]')
             END AS features_properties_contact""",
        """CASE doc_id % 5 WHEN 0 THEN '[]' WHEN 1 THEN '[null]' WHEN 2 THEN NULL
             WHEN 3 THEN '[{"organisation":{"en":"Government;Cited","fr":"Gouvernement"}}]' ELSE '{bad' END AS features_properties_cited""",
        """CASE doc_id % 7 WHEN 0 THEN 'boundaries, society' WHEN 1 THEN 'farming' WHEN 2 THEN 'inlandWaters,oceans'
             WHEN 3 THEN 'imageryBaseMapsEarthCover' WHEN 4 THEN 'transport' WHEN 5 THEN 'unknownTopic' END AS features_properties_topicCategory""",
        """CASE WHEN doc_id % 10 = 0 THEN 'Not Available; Indisponible'
             ELSE concat(CAST(1990 + doc_id % 30 AS STRING), '-0', CAST(1 + doc_id % 9 AS STRING)) END AS features_properties_temporalExtent_begin""",
        """CASE WHEN doc_id % 6 = 0 THEN 'Present' WHEN doc_id % 6 = 1 THEN 'Not Available; Indisponible'
             ELSE concat(CAST(2000 + doc_id % 25 AS STRING), '-02') END AS features_properties_temporalExtent_end""",
        """CASE WHEN doc_id % 12 = 0 THEN 'Not Available; Indisponible'
             ELSE concat('20', CAST(10 + doc_id % 15 AS STRING), '-01-15') END AS features_properties_date_published_date""",
        "CAST(n_chars % 1000 AS STRING) AS features_popularity",
        "CASE doc_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'cgp' WHEN 2 THEN 'ccmeo-datacube' WHEN 3 THEN 'ccmeo-eodms' ELSE 'geo-ca' END"
        " AS features_properties_sourceSystemName",
        "CASE doc_id % 6 WHEN 2 THEN 'rcm-ard' WHEN 3 THEN 'sentinel-1' END AS features_properties_eoCollection",
        """CASE doc_id % 6 WHEN 2 THEN '[{"polarizations":["VV","VH"],"orbitState":"ascending"}]'
             WHEN 3 THEN '[{"polarizations":["HH"],"orbitState":"descending"}]' END AS features_properties_eoFilters""",
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "embeddings")


def theme_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tag per label from its quality, a second one for toxic documents."""
    labels = read_table(spark, sf_dir, "labels")
    return labels.selectExpr(
        "concat('doc-', CAST(doc_id AS STRING)) AS uuid",
        "explode(array(CASE WHEN quality = 1 THEN 'legal' ELSE 'economy' END, CASE WHEN toxic = 1 THEN 'emergency' END)) AS tag",
    ).filter("tag IS NOT NULL")


def foundational_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read_table(spark, sf_dir, "labels")
    return labels.filter("quality = 1").selectExpr("concat('doc-', CAST(doc_id AS STRING)) AS uuid", "'foundational' AS tag")


def catalogue(spark: SparkSession, sf_dir: str, with_vectors: bool = False) -> DataFrame:
    """The complete catalogue; every record's text goes through the encoder that queries go through."""
    raw = raw_records(spark, sf_dir)
    if with_vectors:
        raw = embed(raw.withColumn("_text", F.expr(embedding_text())), "_text")
    return normalise(raw, theme_tags(spark, sf_dir), foundational_tags(spark, sf_dir))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = read_table(spark, sf_dir, "benchmark").selectExpr("item_id", "replace(text, chr(10), ' ') AS t")
    return b.selectExpr(
        "CAST(item_id AS STRING) AS req_id",
        "CASE WHEN item_id % 4 = 3 THEN 'KeywordSearch' ELSE 'SemanticSearch' END AS method",
        "CASE WHEN item_id % 5 = 4 THEN '' ELSE concat(split_part(t, ' ', 1), ' ', split_part(t, ' ', 3), ' ', split_part(t, ' ', 5)) END AS q",
        "CASE item_id % 3 WHEN 0 THEN '-120.0, 49.0, -100.0, 60.0' WHEN 1 THEN '' END AS bbox",
        "CASE item_id % 8 WHEN 0 THEN 'disjoint' WHEN 3 THEN 'within' ELSE '' END AS relation",
        "CASE WHEN item_id % 6 = 1 THEN '2000' ELSE '' END AS begin",
        "CASE WHEN item_id % 6 = 2 THEN '2015-02' ELSE '' END AS end",
        "CASE WHEN item_id % 7 = 0 THEN 'org 1, cited' ELSE '' END AS org",
        "CASE WHEN item_id % 2 = 0 THEN 'en' WHEN item_id % 9 = 1 THEN '' ELSE 'fr' END AS lang",
        "CASE item_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'title' WHEN 2 THEN 'date' ELSE 'relevancy' END AS sort",
        "'' AS order",
        "CASE WHEN item_id % 20 = 11 THEN '5000000000' WHEN item_id % 20 = 13 THEN '99999999999999999999' WHEN item_id % 3 = 0 THEN '5'"
        " WHEN item_id % 3 = 1 THEN 'abc' ELSE '' END AS size",
        "CASE WHEN item_id % 20 = 6 THEN '3000000000' WHEN item_id % 20 = 13 THEN '2147483647' WHEN item_id % 5 = 2 THEN '5' ELSE '' END AS `from`",
    )


def slow_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Engine messages: some without a body, some with a broken one."""
    return read_table(spark, sf_dir, "events").selectExpr(
        "CASE WHEN user_id % 10 = 0 THEN 'es-test-log-stream' ELSE concat('node-', CAST(user_id % 3 AS STRING)) END AS stream",
        "1704067200000 + event_id * 1000 AS timestamp",
        """CASE WHEN event_id % 7 = 0 THEN 'slow query without body'
                WHEN event_id % 11 = 0 THEN 'took[2ms], source[{"query":{]}], id[]'
                ELSE concat('took[2ms], source[{"query":{"bool":{"must":[{"term":{"k":1}},{"match_all":{"_name":"', event_type, '"}}]}},"size":10}], id[]')
                END AS message""",
    )


def clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events").selectExpr(
        "event_id",
        "concat('10.0.', CAST(user_id % 256 AS STRING), '.', CAST(event_id % 256 AS STRING)) AS ip_address",
        "CASE WHEN event_id % 3 = 0 THEN concat('10.1.', CAST(user_id % 256 AS STRING), '.7, 10.0.0.1') ELSE '' END AS ip_address_forward",
    )


def ip_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested blocks (the narrowest must win) and one unreadable location."""
    n = read_table(spark, sf_dir, "nation").selectExpr("CAST(n_nationkey AS BIGINT) AS n")
    small = n.selectExpr(
        "167772160 + n * 4096 AS start_ip", "167772160 + n * 4096 + 4095 AS end_ip",
        "concat('C', CAST(n AS STRING)) AS country_name",
        "CASE WHEN n = 3 THEN 'bad' ELSE concat(CAST(40 + n AS STRING), '.5,-', CAST(70 + n AS STRING), '.25') END AS location",
    )
    wide = spark.createDataFrame(
        [(167772160, 167772160 + 65535, "WIDE", "0,0"), (167837696, 167837696 + 65535, "FWD", "1,1")],
        "start_ip bigint, end_ip bigint, country_name string, location string",
    )
    return small.unionByName(wide)


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark passage are relevant for its request."""
    from lodestar.operators.evaluate import judged_pairs

    docs = documents(spark, sf_dir).select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("id"), "text")
    # Some passages are two words, one word or two letters long.
    passages = read_table(spark, sf_dir, "benchmark").selectExpr(
        "CAST(item_id AS STRING) AS req_id",
        "CASE item_id % 10 WHEN 3 THEN concat(split_part(text, ' ', 2), ' ', split_part(text, ' ', 3)) WHEN 4 THEN split_part(text, ' ', 2)"
        " WHEN 5 THEN substring(text, 2, 2) ELSE text END AS passage",
    )
    return judged_pairs(docs, passages)
