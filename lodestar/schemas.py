"""Record, catalogue, request and log schemas, and the fixed values of the data model."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

_S = T.StringType()

# The raw record columns that are kept (nested parts are JSON text).
RAW_COLUMNS = (
    "features_properties_id",
    "features_geometry_coordinates",
    "features_properties_title_en",
    "features_properties_title_fr",
    "features_properties_description_en",
    "features_properties_description_fr",
    "features_properties_date_published_date",
    "features_properties_keywords_en",
    "features_properties_keywords_fr",
    "features_properties_options",
    "features_properties_contact",
    "features_properties_cited",
    "features_properties_topicCategory",
    "features_properties_date_created_date",
    "features_properties_spatialRepresentation",
    "features_properties_type",
    "features_properties_temporalExtent_begin",
    "features_properties_temporalExtent_end",
    "features_properties_graphicOverview",
    "features_properties_language",
    "features_popularity",
    "features_properties_sourceSystemName",
    "features_properties_eoCollection",
    "features_properties_eoFilters",
)

RAW = T.StructType([T.StructField(c, _S) for c in RAW_COLUMNS])

LOCALISED = T.StructType([T.StructField("en", _S), T.StructField("fr", _S)])
OPTION = T.StructType([T.StructField("protocol", _S), T.StructField("description", LOCALISED)])
CONTACT = T.StructType([T.StructField("organisation", LOCALISED)])
EO_FILTER = T.StructType([T.StructField("polarizations", T.ArrayType(_S)), T.StructField("orbitState", _S)])
# Catalogue columns whose JSON is kept whole beside the typed parts.
JSON_FIELDS = ("options", "contact", "cited", "eoFilters")
RINGS = T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType())))

# Filter name -> catalogue paths it searches.
FILTER_FIELDS = {
    "type": ["type"],
    "protocol": ["options.protocol"],
    "theme": ["theme"],
    "topic_category": ["topicCategory"],
    "org": ["organisation.en", "organisation.fr"],
    "foundational": ["foundational"],
    "source_system": ["systemName"],
    "mappable": ["mappable"],
    "eo_collection": ["eoCollection"],
    "polarization": ["eoFilters.polarizations"],
    "orbit_direction": ["eoFilters.orbitState"],
}

# Facet name -> catalogue path; the organisation facet follows the language.
FACET_FIELDS = {
    "unique_mappable": "mappable",
    "unique_protocol": "options.protocol",
    "unique_org": "organisation",
    "unique_source_system": "systemName",
    "unique_eo_collection": "eoCollection",
    "unique_topic_category": "topicCategory",
    "unique_theme": "theme",
}
FACET_SIZE = 100

# Request parameters, all strings, empty = absent.
REQUEST_COLUMNS = (
    "req_id", "method", "q", "bbox", "relation", "begin", "end",
    "org", "type", "protocol", "mappable", "theme", "topic_category", "foundational",
    "source_system", "eo_collection", "polarization", "orbit_direction",
    "lang", "sort", "order", "size", "from",
    "ip_address", "ip_address_forward", "timestamp", "user_agent", "http_method", "body",
)

# Scoring parameters of the hybrid search.
K1, B = 1.2, 0.75
TEXT_BOOST, FLAG_BOOST, MIN_SCORE = 0.007, 0.15, 0.55
SERVICE_K = 10
HYBRID_PATTERNS = {
    "*topicCategory*": 1.0, "*keywords*": 5.0, "*description*": 15.0, "*title*": 10.0,
    "*organisation*": 1.0, "*systemName*": 1.0, "*id*": 5.0,
}
KEYWORD_PATTERNS = {
    "topicCategory": 1.0, "keywords*": 1.0, "description*": 1.0, "title*": 1.0,
    "organisation*": 1.0, "systemName": 1.0,
}
# Text columns of the catalogue that a field pattern may select.
TEXT_FIELDS = (
    "id", "title_en", "title_fr", "description_en", "description_fr", "keywords_en", "keywords_fr",
    "topicCategory", "theme", "type", "organisation.en", "organisation.fr", "systemName",
    "eoCollection", "language", "spatialRepresentation",
)
NESTED_TEXT_FIELDS = ("options.protocol", "contact.organisation.en", "contact.organisation.fr")

SLOW_LOG = T.StructType([
    T.StructField("stream", _S), T.StructField("timestamp", T.LongType()), T.StructField("message", _S),
])
PARSED_LOG = T.StructType([
    T.StructField("timestamp", _S), T.StructField("filters_applied", _S), T.StructField("search_string", _S),
])
PARSED_EVENT = T.StructType([*PARSED_LOG.fields, T.StructField("event", _S), T.StructField("day", _S)])
GEO_POINT = T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())])
PLACE = T.StructType(
    [T.StructField(c, _S) for c in
     ("continent_name", "region_iso_code", "city_name", "country_iso_code", "country_name", "region_name")]
    + [T.StructField("location", GEO_POINT), T.StructField("time_zone", _S)]
)
SEARCH_LOG = T.StructType(
    [T.StructField("req_id", _S), T.StructField("timestamp", T.TimestampType())]
    + [T.StructField(c, _S) for c in
       ("lang", "q", "user_agent", "http_method", "sort_param", "order_param", "organization_filter",
        "metadata_source_filter", "theme_filter", "topicCategory_filter", "type_filter", "protocol_filter",
        "mappable_filter", "relation")]
    + [T.StructField("size", T.LongType()), T.StructField("from", T.LongType()),
       T.StructField("ip2geo", PLACE)]
)


@dataclass(frozen=True)
class CatalogueSpec:
    """What a catalogue table is declared with: analysed fields, similarity, vector size."""

    vector_dim: int = 768
    k1: float = K1
    b: float = B
    text_fields: tuple[str, ...] = TEXT_FIELDS
    space: str = "cosine"
    geometry: str = "coordinates"
    filters: dict = field(default_factory=lambda: dict(FILTER_FIELDS))
