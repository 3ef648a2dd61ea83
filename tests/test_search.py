import json
import os
import time

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestar.operators import filters
from lodestar.plans import fixtures as X
from lodestar.plans import responses, search
from lodestar.sources import tables


@pytest.fixture(scope="module")
def catalogue(spark, sf):
    return tables.materialise(X.catalogue(spark, sf, True))


@pytest.fixture(scope="module")
def result(spark, sf, catalogue):
    return search.semantic_search(X.requests(spark, sf), catalogue, X.TODAY)


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_single_request_equals_batch(spark, sf, catalogue, result):
    one = search.semantic_search(X.requests(spark, sf).filter("req_id = '5'"), catalogue, X.TODAY)
    batch = result.hits.filter("req_id = '5'")
    assert rows(one.hits, "row_num") == rows(batch, "row_num") != []


def test_repeated_requests_share_their_answer(spark, sf, catalogue, result):
    copies = X.requests(spark, sf).filter("req_id = '5'").withColumn("req_id", F.explode(F.array(F.lit("a"), F.lit("b"))))
    got = search.semantic_search(copies, catalogue, X.TODAY).hits
    a = rows(got.filter("req_id = 'a'").drop("req_id"), "row_num")
    assert a == rows(got.filter("req_id = 'b'").drop("req_id"), "row_num") == rows(result.hits.filter("req_id = '5'").drop("req_id"), "row_num")


def test_a_record_without_an_id_stops_no_search(spark, sf, catalogue):
    odd = catalogue.withColumn("id", F.expr("CASE WHEN id <> 'doc-7' THEN id END"))
    got = search.semantic_search(X.requests(spark, sf).filter("q <> ''"), odd, X.TODAY).hits
    assert not got.isEmpty() and got.filter("id IS NULL").isEmpty()


def test_facets_do_not_exceed_total(result):
    joined = result.facets.join(result.totals, "req_id")
    assert joined.filter("doc_count > total_hits").isEmpty() and not joined.isEmpty()


def test_page_sizes(result):
    asked = result.requests.select("req_id", "size", "from")
    bad = result.hits.groupBy("req_id").agg(F.count("*").alias("n"), F.max("row_num").alias("last")).join(asked, "req_id")
    assert bad.filter("n > size OR last <> n").isEmpty()


def test_pruning_changes_nothing(spark, sf, catalogue):
    """The early cut on candidates must not lose a match that passes the final cut."""
    plain = search.semantic_search(X.requests(spark, sf), catalogue, X.TODAY, min_score=None)
    cut = search.semantic_search(X.requests(spark, sf), catalogue, X.TODAY, min_score=0.0)
    assert rows(plain.totals, "req_id") == rows(cut.totals, "req_id")


def test_flag_only_rows_when_the_flag_passes_the_cut(spark, sf, catalogue):
    r = X.requests(spark, sf).filter("q <> ''").withColumn("bbox", F.lit("")).withColumn("org", F.lit("")).withColumn("begin", F.lit("")).withColumn("end", F.lit(""))
    weight = search.flag_weight(catalogue)
    got = search.semantic_search(r, catalogue, X.TODAY, min_score=weight)
    n = catalogue.filter("mappable = 'true'").count()
    assert got.totals.filter(F.col("total_hits") < n).isEmpty()


def test_many_shapes_are_indexed_with_the_same_result(spark, sf, catalogue, monkeypatch, result):
    monkeypatch.setattr(search, "MAX_BROADCAST_SHAPES", 0)
    again = search.semantic_search(X.requests(spark, sf), catalogue, X.TODAY)
    assert rows(again.totals, "req_id") == rows(result.totals, "req_id")


def test_index_finds_what_the_predicate_does(spark, catalogue):
    """Every kind of clause, alone and together, against one check of each record and combination."""
    asked = [
        {}, {"type": "api"}, {"type": "s*v?ce, nothing"}, {"protocol": "*"}, {"theme": "??"}, {"org": "org 1"}, {"org": "z" * 9}, {"theme": "ENVIRON, econ", "mappable": "true"},
        {"begin": "2005"}, {"end": "2015-06"}, {"end": "null"}, {"begin": "9999"}, {"begin": "2001", "end": "2030", "source_system": "cube"},
        {"bbox": "-180,-90,180,90"}, {"bbox": "-100,40,-60,60", "relation": "within"}, {"bbox": "-75,45,-75,45"}, {"bbox": "-75.1,45,-75,45.2", "relation": "contains"},
        {"bbox": "170,-90,-100,90"}, {"bbox": "-100,40,-60,60", "relation": "disjoint"}, {"bbox": "0,0,5,5", "type": "a"},
    ]
    names = ["req_id", "method", "q", "lang", *filters.FILTER_FIELDS, "begin", "end", "bbox", "relation"]
    table = spark.createDataFrame([(str(i), "SemanticSearch", "", "en", *[r.get(n, "") for n in names[4:]]) for i, r in enumerate(asked)], ", ".join(f"`{n}` string" for n in names))
    shapes = tables.materialise(search.with_shapes(search.normalise_requests(table, X.TODAY)).select("match_id", *search.FILTER_COLUMNS).distinct())
    narrow = catalogue.select(*search.NARROW, *search.FILTERED)
    found = search.indexed_matches(narrow, shapes)
    plain = narrow.join(F.broadcast(shapes), F.expr(filters.batch_predicate(narrow.schema)))
    got = rows(found.select("match_id", "id"), "match_id", "id")
    assert got == rows(plain.select("match_id", "id"), "match_id", "id") and len(got) > 100
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan and "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()


def test_filtered_neighbours_in_rounds_are_those_of_all_allowed(spark, sf, catalogue, monkeypatch):
    from lodestar.operators import filtered_knn

    monkeypatch.setattr(filtered_knn, "FIRST", 1)
    asked = search.with_shapes(search.normalise_requests(X.requests(spark, sf), X.TODAY)).filter("reject IS NULL").select("match_id", *search.FILTER_COLUMNS).distinct()
    vectors = catalogue.select("vector").withColumn("n", F.row_number().over(Window.orderBy("vector")))
    shapes = tables.materialise(asked.withColumn("n", F.row_number().over(Window.orderBy("match_id"))).join(vectors, "n").drop("n"))
    columns = [*search.NARROW, *search.FILTERED]
    want, got = (rows(filtered_knn.filtered_neighbours(catalogue, shapes, columns, 5, search.theta_matches, direct), "match_id", "cos", "id") for direct in (10**9, -1))
    assert got == want and len(want) > 50


def test_rounds_of_filtered_neighbours_use_all_cores(spark, sf, catalogue, monkeypatch):
    from lodestar.operators import filtered_knn

    tasks, scored = [], filtered_knn._scored
    monkeypatch.setattr(filtered_knn, "_scored", lambda pairs: tasks.append(pairs.rdd.getNumPartitions()) or scored(pairs))
    shapes = search.with_shapes(search.normalise_requests(X.requests(spark, sf), X.TODAY)).filter("reject IS NULL AND q <> ''").select("match_id", "q", *search.FILTER_COLUMNS).distinct()
    shapes = search.embed(shapes, "q").drop("q")
    filtered_knn.filtered_neighbours(catalogue, shapes, [*search.NARROW, *search.FILTERED], 5, search.theta_matches, -1).count()
    # The first entry is that of the combinations that score all their records.
    assert len(tasks) > 1 and min(tasks[1:]) >= spark.sparkContext.defaultParallelism


def _text_shapes(spark, sf):
    asked = search.with_shapes(search.normalise_requests(X.requests(spark, sf), X.TODAY)).filter("reject IS NULL AND q <> ''")
    return tables.materialise(asked.select("match_id", "org_lang", "q", *search.FILTER_COLUMNS).distinct())


def _without_cut(spark, sf, catalogue, prefilter):
    index = search.text_index(catalogue)
    boosts = search.expand_patterns(catalogue.schema, search.HYBRID_PATTERNS)
    return search.hybrid_matches(_text_shapes(spark, sf), catalogue, index, boosts, min_score=None, prefilter=prefilter)


def test_pairs_of_request_and_record_are_not_shuffled(spark, sf, catalogue, monkeypatch):
    """Postings are dealt by record before they meet the queries, and records before they meet the combinations."""
    for few in (1000, 0):
        monkeypatch.setattr(search, "MAX_BROADCAST_SHAPES", few)
        found = _without_cut(spark, sf, catalogue, False)
        plan = found._jdf.queryExecution().executedPlan().toString()
        dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
        by_pair = [x for x in dealt if any(f"{name}#" in x.split("hashpartitioning(")[1].split(")")[0] for name in ("q", "match_id"))]
        # The distinct texts or combinations themselves may be, as they are few.
        assert dealt and not [x for x in by_pair if "id#" in x.split("hashpartitioning(")[1].replace("match_id#", "")], plan


@pytest.mark.parametrize("few", [1000, 0])
def test_matches_leave_out_given_pairs(spark, catalogue, monkeypatch, few):
    """As an anti join does it, where ids are repeated or null too."""
    monkeypatch.setattr(search, "MAX_BROADCAST_SHAPES", few)
    names = ["method", "lang", "bbox", "org"]
    table = spark.createDataFrame([("SemanticSearch", "en", *r) for r in (("", ""), ("-100,40,-60,60", ""), ("", "org 1"), ("0,0,1,1", ""))], names)
    shapes = tables.materialise(search.with_shapes(search.normalise_requests(table, X.TODAY)).select("match_id", *search.FILTER_COLUMNS).distinct())
    narrow = catalogue.select(*search.NARROW, *search.FILTERED).filter("substr(id, -1) IN ('1', '2', '3', '4')")
    odd = narrow.withColumn("id", F.expr("CASE substr(id, -1) WHEN '1' THEN NULL WHEN '2' THEN 'twice' ELSE id END"))
    every = search.theta_matches(odd, shapes)
    but = tables.materialise(every.filter("id IS NULL OR id = 'twice' OR id LIKE '%3'").select("match_id", "id"))
    # Those of one combination stay, and what is no match takes nothing away.
    one = shapes.first()["match_id"]
    but = but.filter(F.col("match_id") != one).union(but.selectExpr("match_id", "'none' AS id"))
    columns = ["match_id", "id", "title_en", "xmin", "ymin"]
    got = rows(search.theta_matches(odd, shapes, but).select(columns), *columns)
    want = rows(every.join(but, ["match_id", "id"], "left_anti").select(columns), *columns)
    assert got == want and any(r[1] is None for r in got) and 0 < len(got) < every.count()


def test_stored_tables_leave_no_shuffle_files(spark):
    import glob

    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    written = lambda: {f for d in folders for f in glob.glob(f"{d}/*/shuffle_*.data")}
    before, setting = written(), spark.conf.get(tables.DROP_SHUFFLES)
    stored = tables.materialise(spark.range(1000).repartition(5, "id").groupBy(F.col("id") % 7).count())
    for _ in range(50):  # they go in the background
        if not (left := written() - before):
            break
        time.sleep(0.1)
    assert not left and spark.conf.get(tables.DROP_SHUFFLES) == setting
    assert len(stored.collect()) == 7


def test_rounds_rank_only_what_may_be_among_the_nearest(spark, sf, catalogue, monkeypatch):
    from lodestar.operators import filtered_knn

    given, top_k = [], filtered_knn.top_k
    monkeypatch.setattr(filtered_knn, "FIRST", 1)
    monkeypatch.setattr(filtered_knn, "top_k", lambda df, *rest: given.append(df.select("match_id", "cos").collect()) or top_k(df, *rest))
    shapes = search.embed(_text_shapes(spark, sf).orderBy("match_id").limit(6), "q").drop("q", "org_lang")
    filtered_knn.filtered_neighbours(catalogue, shapes, [*search.NARROW, *search.FILTERED], 5, search.theta_matches, -1)
    held, farther = {}, 0
    for seen in given:  # the best of the rounds before among them
        farther += sum(r["cos"] < held[r["match_id"]][4] for r in seen if len(held.get(r["match_id"], ())) == 5)
        held = {m: sorted((r["cos"] for r in seen if r["match_id"] == m), reverse=True)[:5] for m in {r["match_id"] for r in seen}}
    assert len(given) > 1 and any(len(cos) == 5 for cos in held.values()) and farther == 0


def test_deep_pages_are_those_of_one_sort(spark, sf, catalogue, monkeypatch, result):
    from lodestar.operators import ranking

    monkeypatch.setattr(ranking, "GROUP_LIMIT", 2)
    deep = search.semantic_search(X.requests(spark, sf), catalogue, X.TODAY)
    assert rows(deep.hits, "req_id", "row_num") == rows(result.hits, "req_id", "row_num")


def test_browse_equals_batch(catalogue, result):
    for r in result.requests.filter("q = ''").limit(3).collect():
        raw = {k: r[k] for k in ("bbox", "relation", "begin", "end", "org")}
        want = catalogue.filter(filters.predicate(catalogue.schema, raw, X.TODAY)).count()
        assert result.totals.filter(F.col("req_id") == r["req_id"]).first()["total_hits"] == want


def test_rejected_requests_are_kept_out(spark, sf, catalogue):
    bad = X.requests(spark, sf).withColumn("bbox", F.lit("1,2,3"))
    assert search.search(bad, catalogue, X.TODAY).totals.isEmpty()


def test_responses(catalogue, result):
    nested = responses.geojson_responses(result, catalogue, ["id", "title_en"])
    bad = nested.filter("response.returned_hits <> size(response.items)")
    assert bad.isEmpty() and nested.count() == result.requests.count()
    whole = responses.geojson_responses(result, catalogue).filter("size(response.items) > 0").first()["response"]["items"][0]
    shown = json.loads(whole)["features"][0]["properties"]
    assert isinstance(shown["options"], list) and "vector" not in shown and "options_json" not in shown
    first = nested.filter("size(response.items) > 0").first()["response"]["items"][0]
    assert '"FeatureCollection"' in first and '"row_num":1' in first


def test_one_deep_request_among_shallow_ones(spark, sf, catalogue):
    base = X.requests(spark, sf).filter("method = 'SemanticSearch' AND req_id IN ('0', '1')")
    deep = base.withColumn("req_id", F.concat(F.lit("deep"), "req_id")).withColumn("size", F.lit("99999999999999999999")).withColumn("from", F.lit("3"))
    none = base.withColumn("req_id", F.concat(F.lit("none"), "req_id")).withColumn("from", F.lit("9223372036854775807"))
    result = search.semantic_search(base.unionByName(deep).unionByName(none), catalogue, X.TODAY)
    rows = {}
    for r in result.hits.collect():
        rows.setdefault(r["req_id"], []).append(r["row_num"])
    total = {r["req_id"]: r["total_hits"] for r in result.totals.collect()}
    for i in "01":
        assert sorted(rows.get("deep" + i, [])) == list(range(1, max(total["deep" + i] - 3, 0) + 1))
        assert "none" + i not in rows and total["none" + i] == total[i]
