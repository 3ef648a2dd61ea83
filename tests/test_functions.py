import datetime as dt
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestar.functions import dates, spatial, text, vectors
from lodestar.functions import json_fields as J
from lodestar.functions.porter import porter_stem
from lodestar.operators import enrich, ingest
from lodestar.streaming import logs


def s(v):
    return ("string", v)


@pytest.mark.parametrize("raw,want", [
    ('[{"x":1},{"organisation":{"en":"A;B"}}]', "A;B"),
    ('{"organisation":{"fr":"F"}}', None),
    ("{bad", None),
    (None, None),
    ('[{"organisation":{"en":null}},{"organisation":{"en":"later"}}]', None),
])
def test_organisation_first(value, raw, want):
    assert value(J.organisation_first("c"), c=s(raw)) == want


@pytest.mark.parametrize("cited,contact,want", [
    ("[null]", '[{"organisation":{"en":"G; O ;B","fr":"X"}}]', ("O", None)),
    ("{bad", '[{"organisation":{"en":"G;O","fr":"X;Y"}}]', (None, None)),
    (None, '[{},{"organisation":{"en":"G;O","fr":"X;Y"}}]', ("O", "Y")),
    ('{"organisation":{"en":"G;O"}}', "[]", (None, None)),
])
def test_organisation_segment(value, cited, contact, want):
    out = value(J.organisation_segment("a", "b"), a=s(cited), b=s(contact))
    assert (None, None) == want if out is None else (out["en"], out["fr"]) == want


@pytest.mark.parametrize("raw,want", [
    ('[{"protocol":" OGC:WMS "}]', "true"),
    ('[{"protocol":"HTTPS"}]', "false"),
    ("not json", "false"),
    (None, "false"),
    ('[{"protocol":null},{"protocol":"ESRI REST: Map Service"}]', "true"),
    ('{"protocol":"ogc"}', "true"),
    ('[{"protocol":"ogc"},7]', "true"),
])
def test_mappable(value, raw, want):
    assert value(J.mappable_flag(J.options_of("c")), c=s(raw)) == want


def test_resource_types(value):
    raw = '[{"description":{"en":"API; x"}},{"description":{"en":"API;y"}},{"description":{"en":"Dataset"}},{"description":null}]'
    assert value(J.resource_types(J.options_of("c")), c=s(raw)) == ["API", "Dataset"]
    assert value(J.resource_types(J.options_of("c")), c=s("{bad")) == []


@pytest.mark.parametrize("raw,want", [
    ("boundaries, Society", ["administration", "society"]),
    ("transport,transportation", ["administration", "infrastructure"]),
    ("unknown", []),
    (None, []),
])
def test_theme_bins(value, raw, want):
    assert value(J.theme_bins("c"), c=s(raw)) == want


def test_small_projections(value):
    assert value(J.comma_array("c"), c=s("a, b,c")) == ["a", "b", "c"]
    assert value(J.comma_array("c"), c=s(None)) == []
    assert [value(ingest.source_system("c"), c=s(x)) for x in ("cgp", None, "ccmeo-eodms")] == ["geo-ca", "geo-ca", "ccmeo-eodms"]
    themes = ("array<string>", ["economy"])
    tags = ("array<string>", ["legal", "economy", "other"])
    assert value(ingest.append_tags("a", "b", ingest.THEME_TAGS), a=themes, b=tags) == ["economy", "legal"]
    assert value(ingest.append_tags("a", "b"), a=themes, b=("array<string>", None)) == ["economy"]
    assert value(ingest.foundational_flag("a"), a=("array<string>", ["Foundational "])) == "true"
    assert value(ingest.foundational_flag("a"), a=("array<string>", [])) == "false"
    cols = {ingest.P + c: s(None) for c in ("title_en", "title_fr", "description_en", "description_fr", "keywords_en", "keywords_fr")}
    cols[ingest.P + "title_en"] = s("t")
    assert value(ingest.all_text(), **cols) == ""
    cols[ingest.P + "keywords_en"] = s("k")
    assert value(ingest.embedding_text(), **cols) == "t\n\nkeywords:k"


@pytest.mark.parametrize("raw,first,last", [
    ("2020", "2020-01-01", "2020-12-31"),
    ("2020-02", "2020-02-01", "2020-02-29"),
    ("2020-02-10", "2020-02-10", "2020-02-10"),
    ("2020-13", None, None),
    ("nonsense", None, None),
    (None, None, None),
])
def test_partial_date(value, raw, first, last):
    got = [value(dates.partial_date("c", edge), c=s(raw)) for edge in ("first", "last")]
    assert [d and d.isoformat() for d in got] == [first, last]


def test_present_is_today(value):
    today = dt.date(2024, 6, 1)
    assert value(dates.partial_date("c", "last", today), c=s("Present")) == today


@pytest.mark.parametrize("raw,want", [("45.5,-73.5", (45.5, -73.5)), ("bad", None), ("1,2,3", None), (None, None)])
def test_geo_point(value, raw, want):
    out = value(enrich.geo_point("c"), c=s(raw))
    assert (out and (out["lat"], out["lon"])) == want


def test_addresses(value):
    f = enrich.client_address("a", "b")
    assert value(f, a=s("9.9.9.9"), b=s("1.1.1.1, 2.2.2.2")) == "1.1.1.1"
    assert value(f, a=s("9.9.9.9"), b=s("")) == "9.9.9.9"
    assert value(enrich.ip_number("a"), a=s("10.0.1.2")) == 167772160 + 258
    assert [value(enrich.ip_number("a"), a=s(x)) for x in ("1.2.3", "1.2.3.x", "1.2.3.256", None)] == [None] * 4


def test_text(value):
    assert value(text.analyse("c"), c=s("The River-Ice events in 2020")) == ["river", "ice", "events", "2020"]
    assert value(text.analyse("c"), c=s("don't l’été a.b. é")) == ["don't", "l’été", "a.b", "é"]
    tokens = value(text.clean_tokens("c", text.long_stopwords()), c=s("The Dog's running, fast!"))
    assert tokens == ["dogs", "running", "fast"]
    marked = value(text.highlight("c", text.analyse("q")), c=s("Fire, wildfire and FIRE's l'été fire."), q=s("fire été"))
    assert marked == "<em>Fire</em>, wildfire and FIRE's l'été <em>fire</em>."


@pytest.mark.parametrize("word,stem", [
    # Examples of the published algorithm.
    ("caresses", "caress"), ("ponies", "poni"), ("ties", "ti"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"),
    ("plastered", "plaster"), ("bled", "bled"), ("motoring", "motor"), ("sing", "sing"), ("conflated", "conflat"),
    ("troubled", "troubl"), ("sized", "size"), ("hopping", "hop"), ("tanned", "tan"), ("falling", "fall"),
    ("hissing", "hiss"), ("fizzed", "fizz"), ("failing", "fail"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"),
    ("relational", "relat"), ("conditional", "condit"), ("rational", "ration"), ("digitizer", "digit"),
    ("operator", "oper"), ("feudalism", "feudal"), ("decisiveness", "decis"), ("hopefulness", "hope"),
    ("triplicate", "triplic"), ("formative", "form"), ("formalize", "formal"), ("electrical", "electr"),
    ("goodness", "good"), ("revival", "reviv"), ("allowance", "allow"), ("adjustable", "adjust"),
    ("replacement", "replac"), ("adoption", "adopt"), ("communism", "commun"), ("activate", "activ"),
    ("effective", "effect"), ("probate", "probat"), ("rate", "rate"), ("cease", "ceas"), ("controll", "control"),
    ("roll", "roll"), ("generalizations", "gener"), ("oscillators", "oscil"),
])
def test_porter(word, stem):
    assert porter_stem(word) == stem


def test_stem_batches(spark):
    df = spark.createDataFrame([("a", ["running", "cats", "running"]), ("b", []), ("c", None)], "k string, t array<string>")
    got = {r["k"]: r["x"] for r in df.select("k", text.stem_tokens("t").alias("x")).collect()}
    assert got["a"] == ["run", "cat", "run"] and got["b"] == []


def test_stems_are_made_in_arrow_buffers():
    tokens = pa.array([["running", "cats"] * 500] * 2000 + [None, [], [None, "ponies"]])
    tracemalloc.start()
    got = text._stem_arrays(tokens)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got[0].as_py() == ["run", "cat"] * 500 and got[2000:].to_pylist() == [[], [], [None, "poni"]]
    assert peak < 1 << 20  # a Python object for each token would be 16 MB of references alone


def test_vectors(spark, value):
    rows = [(1, [1.0, 0.0], 1), (1, [3.0, 4.0], 1), (1, [9.0, 9.0], 0), (2, [5.0, 5.0], 0)]
    df = spark.createDataFrame(rows, "id int, v array<double>, m int")
    got = {r["id"]: r["vector"] for r in vectors.mean_pool(df, "id", "v", "m").collect()}
    assert got[1] == pytest.approx([2.0, 2.0]) and got[2] == pytest.approx([0.0, 0.0])
    assert value(vectors.l2_normalise("v"), v=("array<double>", [3.0, 4.0])) == pytest.approx([0.6, 0.8])
    assert value(vectors.l2_normalise("v"), v=("array<double>", [0.0, 0.0])) == [0.0, 0.0]
    unit = value(vectors.hash_embed("c"), c=s("river ice river"))
    assert sum(x * x for x in unit) == pytest.approx(1.0)
    assert value(vectors.hash_embed("c"), c=s("the of")) == [0.0] * 64


def test_encoder_plug_in(spark):
    df = spark.createDataFrame([("ab",), ("abcd",), (None,)], "t string")
    out = vectors.embed(df, "t", lambda texts: [[float(len(x)), 1.0] for x in texts])
    assert sorted(r["vector"] for r in out.collect()) == [[0.0, 1.0], [2.0, 1.0], [4.0, 1.0]]


SQUARE = [[[0, 0], [10, 0], [10, 10], [0, 10], [0, 0]]]
TRIANGLE = [[[0, 0], [10, 0], [0, 10], [0, 0]]]
HOLED = SQUARE + [[[4, 4], [6, 4], [6, 6], [4, 6], [4, 4]]]


def relations(spark, rings, box):
    df = spark.createDataFrame([([[[float(x) for x in p] for p in r] for r in rings],)], "g array<array<array<double>>>")
    df = df.selectExpr("g", *[f"{e} AS {n}" for n, e in spatial.bounds("g").items()])
    row = df.selectExpr(*[f"{spatial.box_relation('g', box, r)} AS {r}" for r in spatial.RELATIONS]).first()
    w, south, e, n = box
    batch = df.selectExpr("*", f"array({w}D, {south}D, {e}D, {n}D) AS b")
    query = [f"b[{i}]" for i in range(4)]
    for r in spatial.RELATIONS:
        again = batch.selectExpr("*", f"'{r}' AS rel").selectExpr(f"{spatial.box_relation('g', query, 'rel', fixed=False)} AS x")
        assert again.first()["x"] == row[r]
    return {r for r in spatial.RELATIONS if row[r]}


@pytest.mark.parametrize("rings,box,want", [
    (SQUARE, (5, 5, 15, 15), {"intersects"}),
    (SQUARE, (10, 10, 20, 20), {"intersects"}),
    (SQUARE, (-1, -1, 11, 11), {"intersects", "within"}),
    (SQUARE, (2, 2, 3, 3), {"intersects", "contains"}),
    (SQUARE, (20, 20, 30, 30), {"disjoint"}),
    (SQUARE, (0, 0, 10, 10), {"intersects", "within", "contains"}),
    (TRIANGLE, (8, 8, 9, 9), {"disjoint"}),
    (TRIANGLE, (1, 1, 2, 2), {"intersects", "contains"}),
    (TRIANGLE, (4, 4, 9, 9), {"intersects"}),
    (HOLED, (4.5, 4.5, 5.5, 5.5), {"disjoint"}),
    (HOLED, (3, 3, 7, 7), {"intersects"}),
    ([[[175, 0], [179, 0], [179, 5], [175, 5], [175, 0]]], (170, -10, -170, 10), {"intersects", "within"}),
    ([[[-179, 0], [-175, 0], [-175, 5], [-179, 5], [-179, 0]]], (170, -10, -170, 10), {"intersects", "within"}),
])
def test_box_relation(spark, rings, box, want):
    assert relations(spark, rings, box) == want


def test_polygons(spark):
    df = spark.createDataFrame([([[[float(x) for x in p] for p in TRIANGLE[0]]],)], "g array<array<array<double>>>")
    df = df.selectExpr("g", *[f"{e} AS {n}" for n, e in spatial.bounds("g").items()])

    def meets(ring):
        return df.selectExpr(f"{spatial.polygons_intersect('g', spatial.ring_literal(ring))} AS x").first()["x"]

    assert meets([(8, 8), (9, 8), (9, 9)]) is False
    assert meets([(5, 5), (9, 8), (9, 9)]) is True
    assert meets([(1, 1), (2, 1), (2, 2)]) is True
    assert meets([(-50, -50), (50, -50), (50, 50), (-50, 50)]) is True


@pytest.mark.parametrize("bad", ["1,2,3", "a,b,c,d", "200,0,0,0", "0,-100,1,1", "0,5,1,4"])
def test_bad_boxes(bad):
    with pytest.raises(ValueError):
        spatial.parse_bbox(bad)


def test_bad_relation():
    with pytest.raises(ValueError):
        spatial.box_relation("g", (0, 0, 1, 1), "near")


def test_slow_log(spark):
    body = '{"query":{"bool":{"must":[{"term":{}},{"match_all":{"_name":"fire"}}]}}}'
    rows = [("s", 1704067200000, f"x source[{body}] y"), ("s", 1704067200500, "no body"), ("s", 0, "source[{bad}]")]
    df = spark.createDataFrame(rows, "stream string, timestamp bigint, message string")
    out = [tuple(r) for r in logs.parse_slow_log(df).collect()]
    assert out[0] == ("s", "2024-01-01T00:00:00", '[{"term":{}},{"match_all":{"_name":"fire"}}]', "fire")
    assert out[1] == ("s", "2024-01-01T00:00:00.500000", None, None)
    assert out[2] == ("s", "1970-01-01T00:00:00", None, None)


def test_run_lengths_match_group_by(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    from lodestar.functions.common import run_lengths

    a = docs.selectExpr("doc_id", f"inline({run_lengths(text.analyse('text'))})")
    b = docs.selectExpr("doc_id", f"explode({text.analyse('text')}) AS term").groupBy("doc_id", "term").agg(F.count("*").cast("int").alias("tf"))
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
