"""Fields taken out of JSON text, one bad element never spoiling its neighbours."""

from __future__ import annotations

from lodestar.functions.common import NO_STRINGS, let, literal, literals
from lodestar.schemas import CONTACT, EO_FILTER, OPTION, RINGS

# Protocols that can be drawn on a map.
MAPPABLE_PROTOCOLS = "esri|ogc"
# Texts that mean "nothing cited".
EMPTY_CITED = ("[]", "[null]")

# ISO topic (lower case) -> theme.
THEME_OF_TOPIC = {
    "boundaries": "administration",
    "planningcadastre": "administration",
    "location": "administration",
    "transportation": "administration",
    "economy": "economy",
    "farming": "economy",
    "biota": "environment",
    "environment": "environment",
    "elevation": "environment",
    "inlandwaters": "environment",
    "oceans": "environment",
    "climatologymeteorologyatmosphere": "environment",
    "imagerybasemapsearthcover": "imagery",
    "earthobservation;syntheticaperatureradar": "imagery",
    "structure": "infrastructure",
    "transport": "infrastructure",
    "utilitiescommunication": "infrastructure",
    "geoscientificinformation": "science",
    "health": "society",
    "society": "society",
    "intelligencemilitary": "society",
}


def json_items(text: str) -> str:
    """Elements of a JSON array as JSON texts; one object counts as a one-element array."""
    s = f"trim({text})"
    return f"from_json(CASE WHEN startswith({s}, '{{') THEN concat('[', {s}, ']') ELSE {s} END, 'array<string>')"


def json_objects(text: str, schema) -> str:
    """The objects inside :func:`json_items`, parsed; unreadable text gives an empty array."""
    kind = schema.simpleString()
    parsed = f"transform(filter({json_items(text)}, el -> startswith(ltrim(el), '{{')), el -> from_json(el, '{kind}'))"
    return f"coalesce({parsed}, CAST(array() AS array<{kind}>))"


def safe_json(text: str, kind: str) -> str:
    """JSON text as an array of ``kind``, empty when it is missing or unreadable."""
    return f"coalesce(from_json({text}, 'array<{kind}>'), CAST(array() AS array<{kind}>))"


def whole_json(text: str) -> str:
    """JSON text as a variant array with every key and element; one object counts as an array of one,
    unreadable text as an empty one."""
    s = f"trim({text})"
    return f"coalesce(try_parse_json(CASE WHEN startswith({s}, '{{') THEN concat('[', {s}, ']') ELSE {s} END), parse_json('[]'))"


def options_of(text: str) -> str:
    return json_objects(text, OPTION)


def contacts_of(text: str) -> str:
    return json_objects(text, CONTACT)


def eo_filters_of(text: str) -> str:
    return json_objects(text, EO_FILTER)


def rings_of(text: str) -> str:
    return f"from_json({text}, '{RINGS.simpleString()}')"


def organisation_first(text: str, lang: str = "en") -> str:
    """Organisation of the first contact that names one in ``lang``, even if that name is null."""
    organisations = f"transform({json_items(text)}, el -> from_json(el, 'organisation map<string,string>').organisation)"
    named = f"filter({organisations}, org -> org IS NOT NULL AND map_contains_key(org, '{lang}'))"
    return f"try_element_at(get({named}, 0), '{lang}')"


def _second_segment(name: str) -> str:
    return f"trim(try_element_at(split({name}, ';'), 2))"


def organisation_segment(cited: str, contact: str) -> str:
    """``struct<en,fr>``: the part after the first ``;`` of the cited (else contact) organisation."""
    source = f"trim(CASE WHEN {cited} IS NULL OR {cited} IN ({literals(EMPTY_CITED)}) THEN {contact} ELSE {cited} END)"
    items = f"CASE WHEN startswith({source}, '[') THEN {json_items(source)} END"
    blank = literal(r"^\s*\{\s*\}\s*$")
    objects = f"filter({items}, el -> startswith(ltrim(el), '{{') AND NOT el RLIKE {blank})"
    first = f"from_json(get({objects}, 0), '{CONTACT.simpleString()}').organisation"
    parts = f"named_struct('en', {_second_segment('org.en')}, 'fr', {_second_segment('org.fr')})"
    return let("org", first, parts)


def mappable_flag(options: str) -> str:
    """``"true"`` when any option's protocol is one that can be drawn on a map."""
    drawn = f"exists({options}.protocol, pr -> coalesce(lower(pr) RLIKE '{MAPPABLE_PROTOCOLS}', false))"
    return f"CAST(coalesce({drawn}, false) AS string)"


def resource_types(options: str) -> str:
    """Distinct English option descriptions up to the first ``;``, sorted."""
    english = f"filter(transform({options}, op -> op.description.en), d -> d IS NOT NULL)"
    return f"array_sort(array_distinct(transform({english}, d -> trim(substring_index(d, ';', 1)))))"


def comma_array(text: str) -> str:
    """``"a, b"`` to ``[a, b]``; null gives an empty array."""
    return f"coalesce(transform(split({text}, ','), part -> trim(part)), {NO_STRINGS})"


def theme_bins(topics: str) -> str:
    """Themes of a comma-separated topic list, distinct and sorted."""
    table = "map(" + ", ".join(f"{literal(k)}, {literal(v)}" for k, v in THEME_OF_TOPIC.items()) + ")"
    themes = f"transform({comma_array(topics)}, topic -> try_element_at({table}, lower(topic)))"
    return f"array_sort(array_distinct(filter({themes}, th -> th IS NOT NULL)))"
