"""From raw metadata records to the typed catalogue table."""

from __future__ import annotations

import fnmatch

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from lodestar.functions import json_fields as J
from lodestar.functions.common import NO_STRINGS, literals
from lodestar.functions.dates import NOT_AVAILABLE, PRESENT, partial_date
from lodestar.functions.spatial import bounds
from lodestar.schemas import JSON_FIELDS, NESTED_TEXT_FIELDS, RAW_COLUMNS, TEXT_FIELDS

P = "features_properties_"
# The only tags of the theme table that become themes.
THEME_TAGS = ("emergency", "legal")
DEFAULT_SYSTEM, RENAMED_SYSTEM = "geo-ca", "cgp"
SPECIAL_TOPIC = ("earthobservation;syntheticaperatureradar", "imageryBaseMapsEarthCover")


def select_columns(raw: DataFrame, columns=RAW_COLUMNS) -> DataFrame:
    """Keep the known raw columns; a column the source lacks is an empty string."""
    have = set(raw.columns)
    extra = [c for c in ("load_seq", "vector") if c in have]
    return raw.selectExpr(*[c if c in have else f"'' AS {c}" for c in columns], *extra)


def null_sentinels(raw: DataFrame) -> DataFrame:
    """Sentinel texts in extents and dates become null."""
    extent = [P + "temporalExtent_begin", P + "temporalExtent_end"]
    dates = [P + "date_published_date", P + "date_created_date"]
    dates = [c for c in dates if c in raw.columns]
    return raw.replace([PRESENT, NOT_AVAILABLE], None, subset=extent).replace([NOT_AVAILABLE], None, subset=dates)


def build_extent(raw: DataFrame) -> DataFrame:
    """The two extent columns become one struct."""
    begin, end = P + "temporalExtent_begin", P + "temporalExtent_end"
    return raw.withColumn("temporalExtent", F.struct(F.col(begin).alias("begin"), F.col(end).alias("end"))).drop(begin, end)


def _part(name: str) -> str:
    return f"coalesce({P}{name}, '')"


NEW_LINE = "chr(10)"


def embedding_text() -> str:
    """Title, description and keywords for the English encoder; missing parts are empty."""
    return f"concat({_part('title_en')}, {NEW_LINE}, {_part('description_en')}, {NEW_LINE}, 'keywords:', {_part('keywords_en')})"


def embedding_text_bilingual() -> str:
    lines = [_part(f) for f in ("title_en", "title_fr", "description_en", "description_fr")]
    lines += [f"concat('keywords:', {_part(f)})" for f in ("keywords_en", "keywords_fr")]
    return f"concat({f', {NEW_LINE}, '.join(lines)})"


def all_text() -> str:
    """Six fields joined by blanks; one null makes the whole text empty."""
    fields = ("title_en", "description_en", "keywords_en", "title_fr", "description_fr", "keywords_fr")
    parts = ", ' ', ".join(P + f for f in fields)
    return f"coalesce(concat({parts}), '')"


def source_system(name: str) -> str:
    return f"CASE WHEN {name} IS NULL OR {name} = '{RENAMED_SYSTEM}' THEN '{DEFAULT_SYSTEM}' ELSE {name} END"


def topic_rewrite(topic: str) -> str:
    """The one special topic text is rewritten, everything else kept."""
    bare, replacement = SPECIAL_TOPIC
    return f"CASE WHEN lower(replace({topic}, ' ', '')) = '{bare}' THEN '{replacement}' ELSE {topic} END"


def override_organisation(df: DataFrame, contacts: str, overrides: DataFrame, key: str = "id") -> DataFrame:
    """Replace the organisation of the first contact for the ids of ``overrides(id, organisation)``."""
    joined = df.join(overrides.select(F.col("id").alias(key), F.col("organisation").alias("_override")), key, "left")
    replaced = F.transform(
        F.col(contacts),
        lambda c, i: F.when((i == 0) & F.col("_override").isNotNull(), c.withField("organisation", F.col("_override"))).otherwise(c),
    )
    return joined.withColumn(contacts, replaced).drop("_override")


def tags_per_id(tags: DataFrame) -> DataFrame:
    """All tags of a record as one sorted array, so that a join never repeats a record."""
    return tags.groupBy("uuid").agg(F.array_sort(F.collect_set("tag")).alias("_tags"))


def append_tags(themes: str, tags: str, allowed=None) -> str:
    """Tags not yet among the themes, appended; with ``allowed`` only those."""
    listed = f" AND tag IN ({literals(allowed)})" if allowed else ""
    usable = f"filter(coalesce({tags}, {NO_STRINGS}), tag -> tag <> ''{listed})"
    return f"concat({themes}, array_except({usable}, {themes}))"


def join_tags(df: DataFrame, tags: DataFrame, themes: str = "theme", key: str = "id", allowed=None) -> DataFrame:
    """Left join of aggregated tags; the planner broadcasts them when they are small."""
    usable = tags.filter(F.col("tag").isin(list(allowed))) if allowed else tags
    per_id = tags_per_id(usable).withColumnRenamed("uuid", key)
    return (
        df.join(per_id, key, "left")
        .withColumn(themes, F.expr(append_tags(themes, "_tags", allowed)))
        .drop("_tags")
    )


def foundational_flag(themes: str) -> str:
    return f"CAST(coalesce(array_contains(transform({themes}, th -> lower(trim(th))), 'foundational'), false) AS string)"


# Catalogue column -> expression over the raw columns.
DOCUMENT = {
    "id": P + "id",
    "_rings": J.rings_of("features_geometry_coordinates"),
    "title_en": P + "title_en",
    "title_fr": P + "title_fr",
    "description_en": P + "description_en",
    "description_fr": P + "description_fr",
    "published": P + "date_published_date",
    "keywords_en": J.comma_array(P + "keywords_en"),
    "keywords_fr": J.comma_array(P + "keywords_fr"),
    "options": J.options_of(P + "options"),
    "contact": J.contacts_of(P + "contact"),
    "cited": J.contacts_of(P + "cited"),
    **{f"{c}_json": J.whole_json(P + c) for c in JSON_FIELDS},
    "topicCategory": J.comma_array(P + "topicCategory"),
    "created": P + "date_created_date",
    "spatialRepresentation": P + "spatialRepresentation",
    "temporalExtent": "temporalExtent",
    "graphicOverview": f"coalesce({J.json_items(P + 'graphicOverview')}, {NO_STRINGS})",
    "language": P + "language",
    "organisation": J.organisation_segment(P + "cited", P + "contact"),
    "theme": J.theme_bins(P + "topicCategory"),
    "popularity": "coalesce(try_cast(features_popularity AS int), 0)",
    "systemName": source_system(P + "sourceSystemName"),
    "eoCollection": P + "eoCollection",
    "eoFilters": J.eo_filters_of(P + "eoFilters"),
}
# Columns derived from catalogue columns.
DERIVED = {
    "type": J.resource_types("options"),
    "mappable": J.mappable_flag("options"),
    "foundational": foundational_flag("theme"),
    "begin_date": partial_date("temporalExtent.begin", "first"),
    "end_date": partial_date("temporalExtent.end", "last"),
    **bounds("_rings"),
}


def to_catalogue(raw: DataFrame) -> DataFrame:
    """Raw records to catalogue rows in two projections (no shuffle).

    ``raw`` may carry ``vector`` and ``load_seq``. Themes are complete after :func:`enrich_themes`.
    """
    source = build_extent(null_sentinels(select_columns(raw)))
    kept = [c for c in ("vector", "load_seq") if c in source.columns]
    base = source.selectExpr(*[f"{e} AS {name}" for name, e in DOCUMENT.items()], *kept)
    return base.selectExpr(
        "id",
        "named_struct('type', 'Polygon', 'coordinates', _rings) AS coordinates",
        *[c for c in DOCUMENT if c not in ("id", "_rings")],
        *[f"{e} AS {name}" for name, e in DERIVED.items()],
        *kept,
    )


def enrich_themes(catalogue: DataFrame, theme: DataFrame | None = None, foundational: DataFrame | None = None) -> DataFrame:
    """Add the tags of the two tag tables and refresh the foundational flag."""
    out = catalogue
    if theme is not None:
        out = join_tags(out, theme, allowed=THEME_TAGS)
    if foundational is not None:
        out = join_tags(out, foundational)
    return out.withColumn("foundational", F.expr(foundational_flag("theme")))


def normalise(raw: DataFrame, theme: DataFrame | None = None, foundational: DataFrame | None = None) -> DataFrame:
    return enrich_themes(to_catalogue(raw), theme, foundational)


def last_per_id(df: DataFrame, key: str = "id", order: str = "load_seq") -> DataFrame:
    """The row loaded last of every id; ``rn <= 1`` lets each task keep one row per id before the shuffle."""
    newest = Window.partitionBy(key).orderBy(F.col(order).desc())
    return df.withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") <= 1).drop("_rn")


def distinct_ids(df: DataFrame, key: str = "id") -> DataFrame:
    """``df``, failing where an id is repeated: nothing tells which of its rows is the last."""
    number = F.row_number().over(Window.partitionBy(key).orderBy(F.lit(0)))
    error = f"raise_error(concat('id ', coalesce(CAST(`{key}` AS string), '?'), ' is repeated, and no order tells which row is the last'))"
    return df.withColumn("_rn", number).filter(F.expr(f"CASE WHEN _rn = 1 THEN true ELSE CAST({error} AS boolean) END")).drop("_rn")


def upsert(old: DataFrame, new: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
    """Rows of ``new`` replace rows of ``old`` with the same id; of repeated ids in ``new`` the row that
    comes last by ``order`` holds. Without ``order`` an id that is repeated in ``new`` fails the job."""
    new = last_per_id(new, key, order) if order is not None else distinct_ids(new, key)
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def split_bad_rows(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good and quarantined rows for the strict load: JSON columns must parse, popularity be a number."""
    json_columns = ("features_geometry_coordinates", P + "options", P + "contact", P + "graphicOverview", P + "eoFilters")
    checks = [
        f"({c} IS NOT NULL AND {c} <> '' AND try_parse_json({c}) IS NULL)" for c in json_columns if c in raw.columns
    ]
    if "features_popularity" in raw.columns:
        checks.append("(features_popularity IS NOT NULL AND try_cast(features_popularity AS int) IS NULL)")
    bad = " OR ".join(checks)
    return raw.filter(f"NOT ({bad})"), raw.filter(bad)


def expand_patterns(schema: StructType, patterns: dict[str, float], nested: bool = False) -> dict[str, float]:
    """Field patterns with boosts -> fields with boosts; a field keeps its highest boost.

    A pattern matches a text field by its path or, for struct fields, by its top-level name.
    """
    candidates = TEXT_FIELDS + (NESTED_TEXT_FIELDS if nested else ())
    names = set(schema.fieldNames())
    out: dict[str, float] = {}
    for path in candidates:
        top = path.split(".")[0]
        if top not in names:
            continue
        for pattern, boost in patterns.items():
            if fnmatch.fnmatchcase(path, pattern) or ("." in path and not nested and fnmatch.fnmatchcase(top, pattern)):
                out[path] = max(boost, out.get(path, 0.0))
    return out
