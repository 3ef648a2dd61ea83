import datetime as dt
import json
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestar.functions import json_fields as J
from lodestar.operators import bm25, enrich, evaluate, facets, filters, ingest, knn, ranking
from lodestar.plans import fixtures as X
from lodestar.plans import search
from lodestar.plans.requests import normalise_requests
from lodestar.schemas import CatalogueSpec
from lodestar.sources import catalogue as store
from lodestar.sources import tables
from lodestar.streaming import logs


@pytest.fixture(scope="module")
def catalogue(spark, sf):
    return tables.materialise(X.catalogue(spark, sf, True))


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def keep(catalogue, **request):
    return ids(catalogue.filter(filters.predicate(catalogue.schema, request, X.TODAY)))


def test_wildcards(spark):
    df = spark.createDataFrame([("a", ["OGC:WMS"]), ("b", ["x%y", None]), ("c", None)], "id string, f array<string>")

    def hit(values):
        return ids(df.filter(filters.wildcard(df.schema, ["f"], values)))

    assert hit("wms, xyz") == ["a"] and hit("w?s") == ["a"] and hit("o*s") == ["a"]
    assert hit(" , ") == ["a", "b", "c"] and hit("x%") == ["b"] and hit("_") == []


def test_dates(spark):
    rows = [("a", None, dt.date(2015, 2, 28)), ("b", None, None), ("c", dt.date(2001, 1, 1), dt.date(2016, 1, 1))]
    df = spark.createDataFrame(rows, "id string, begin_date date, end_date date")
    assert ids(df.filter(filters.end_filter("2015-02"))) == ["a"]
    assert ids(df.filter(filters.end_filter("2020"))) == ["a", "c"]
    assert ids(df.filter(filters.end_filter("null"))) == ["b"]
    assert ids(df.filter(filters.begin_filter("2001"))) == ["c"]
    assert ids(df.filter(filters.begin_filter("null"))) == ["a", "b", "c"]
    with pytest.raises(ValueError):
        filters.begin_filter("soon")


def test_spatial_partition(catalogue):
    box = "-120,49,-100,60"
    meets, apart = keep(catalogue, bbox=box), keep(catalogue, bbox=box, relation="disjoint")
    assert sorted(meets + apart) == ids(catalogue)
    assert set(keep(catalogue, bbox=box, relation="within")) <= set(meets)


def test_filters_reach_the_scan(spark, catalogue):
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    request = {"begin": "2000", "end": "2015-02", "bbox": "-120,49,-100,60"}
    found = catalogue.filter(filters.predicate(catalogue.schema, request, X.TODAY)).select("id")
    plan = found._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = plan.split("PushedFilters:")[1].split("]")[0]
    assert all(f in pushed for f in ("GreaterThanOrEqual(begin_date", "LessThanOrEqual(end_date", "(xmin,-100.0", "(ymax,49.0"))
    assert "description_en" not in plan.split("ReadSchema:")[1]


def test_batch_filters_equal_single(spark, catalogue):
    wanted = [
        {"req_id": "1", "org": "org 1, cited"}, {"req_id": "2", "theme": "environ*t"}, {"req_id": "3", "protocol": "w?s"},
        {"req_id": "4", "begin": "2000", "end": "2015"}, {"req_id": "5", "end": "null"}, {"req_id": "6", "end": "present"},
        {"req_id": "7", "bbox": "-120,49,-100,60", "relation": "within"}, {"req_id": "8", "polarization": "vh", "mappable": "true"},
        {"req_id": "9", "bbox": "100,40,-120,70"}, {"req_id": "10", "source_system": "cube", "eo_collection": "rcm"},
        {"req_id": "11", "bbox": "-100,50,-99,50.5", "relation": "contains"}, {"req_id": "12", "type": "100%"},
    ]
    names = sorted({k for r in wanted for k in r})
    df = spark.createDataFrame([[r.get(n, "") for n in names] for r in wanted], names)
    parsed = normalise_requests(df, X.TODAY)
    assert parsed.filter("reject IS NOT NULL").isEmpty()
    got = catalogue.select(*search.NARROW, *search.FILTERED).join(
        F.broadcast(parsed.select("req_id", *filters.FILTER_COLUMNS)), F.expr(filters.batch_predicate(catalogue.schema))
    )
    found = {}
    for r in got.select("req_id", "id").collect():
        found.setdefault(r["req_id"], []).append(r["id"])
    for r in wanted:
        assert sorted(found.get(r["req_id"], [])) == keep(catalogue, **{k: v for k, v in r.items() if k != "req_id"}), r


def test_normalise(spark):
    rows = [("1", "", "", "", "", "abc", "", ""), ("2", "x", "title", "", "fr", "0", "7", ""), ("3", "x", "relevancy", "asc", "en", "3", "", ""),
            ("4", "x", "size", "", "", "", "", ""), ("5", "x", "date", "up", "", "", "", ""), ("6", "x", "", "", "", "", "", "1,2,3")]
    df = spark.createDataFrame(rows, ["req_id", "q", "sort", "order", "lang", "size", "from", "bbox"])
    got = {r["req_id"]: r for r in normalise_requests(df).collect()}
    a = got["1"]
    assert (a["size"], a["from"], a["lang"], a["sort"], a["order"]) == (10, 0, "en", "popularity", "desc")
    assert (got["2"]["order"], got["2"]["size"], got["2"]["from"]) == ("asc", 0, 7)
    assert (got["3"]["sort"], got["3"]["order"]) == ("_score", "desc")
    assert [k for k, r in sorted(got.items()) if r["reject"]] == ["4", "5", "6"]


def test_sort_spec():
    assert ranking.sort_spec("title", "", "fr") == ("title_fr", "asc")
    assert ranking.sort_spec("", "asc") == ("score", "desc")
    for bad in (("size", ""), ("date", "up")):
        with pytest.raises(ValueError):
            ranking.sort_spec(*bad)


def test_post_text(spark):
    df = spark.createDataFrame([("1", "postText", '{"text":"river ice"}')], ["req_id", "method", "body"])
    assert normalise_requests(df).first()["q"] == "river ice"


def test_pages_concatenate(catalogue):
    full = ids(catalogue)
    seen = []
    for start in range(0, len(full), 70):
        got = search.browse(catalogue, {"q": "", "size": "70", "from": str(start)}).orderBy("row_num").collect()
        assert [r["row_num"] for r in got] == list(range(1, len(got) + 1))
        seen += [r["id"] for r in got]
    order = catalogue.orderBy(*ranking.order_columns("popularity", "desc"))
    assert seen == [r["id"] for r in order.select("id").collect()]


def test_top_k_large_k_is_sliced(spark):
    df = spark.range(5000).selectExpr("id", "CAST(id % 2 AS int) AS g", "pmod(hash(id), 97) AS v")
    small = ranking.top_k(df, ["g"], [F.col("v").desc(), F.col("id").asc()], 1000)
    large = ranking.top_k(df, ["g"], [F.col("v").desc(), F.col("id").asc()], 1500)
    assert large.count() == 3000
    assert large.filter("rn <= 1000").select("g", "id", "rn").exceptAll(small.select("g", "id", "rn")).isEmpty()


def test_facets(spark):
    df = spark.createDataFrame([("1", ["a", "a", "b"]), ("2", ["a"]), ("3", []), ("4", None)], "id string, theme array<string>")
    got = facets.facet_counts(df.withColumn("k", F.lit(1)), {"theme": "array_distinct(array_compact(theme))"}, ["k"])
    assert [(r["value"], r["doc_count"]) for r in got.orderBy("rn").collect()] == [("a", 2), ("b", 1)]
    cut = facets.facet_counts(df.withColumn("k", F.lit(1)), {"theme": "array_distinct(array_compact(theme))"}, ["k"], 1)
    assert [(r["value"], r["sum_other"]) for r in cut.collect()] == [("a", 1)]


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([("1", "ice ice river"), ("2", "ice"), ("3", "forest fire"), ("4", "")], ["id", "text"])
    index = bm25.build_index(docs, ["text"])
    got = {r["id"]: r["score"] for r in bm25.field_scores(spark.createDataFrame([("Ice fire ice",)], ["q"]), index).collect()}
    n, avgdl = 3, 2.0

    def w(df_, tf, dl, qtf):
        return qtf * np.log(1 + (n - df_ + 0.5) / (df_ + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))

    assert got == pytest.approx({"1": w(2, 2, 3, 2), "2": w(2, 1, 1, 2), "3": w(1, 1, 2, 1)})


def test_field_patterns(catalogue):
    boosts = ingest.expand_patterns(catalogue.schema, search.HYBRID_PATTERNS)
    assert boosts["description_fr"] == 15 and boosts["id"] == 5 and boosts["organisation.en"] == 1
    assert "options.protocol" not in boosts


def test_saved_index(spark, sf, catalogue, tmp_path):
    index = bm25.build_index(catalogue, ["title_en", "description_en", "systemName"])
    index.save(str(tmp_path / "index"), buckets=16)
    saved = bm25.SavedIndex(spark, str(tmp_path / "index"), index.fields)
    queries = X.requests(spark, sf).select("q")
    boosts = {"title_en": 2.0, "description_en": 1.0}

    def scores(i):
        return {(r["q"], r["id"]): round(r["score"], 9) for r in bm25.best_fields(queries, i, boosts).collect()}

    assert scores(saved) == scores(index) != {}
    one = saved.postings_of(spark.createDataFrame([("geo",)], ["term"]))
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1].split("]")[0]


def brute(q, c, k):
    qn, cn = q / np.linalg.norm(q, axis=1, keepdims=True), c / np.linalg.norm(c, axis=1, keepdims=True)
    cos = np.round(qn @ cn.T, 12)
    return {i: [int(j) for j in np.lexsort((np.arange(len(c)), -cos[i]))[:k]] for i in range(len(q))}


def as_lists(df):
    out = {}
    for r in df.orderBy("qid", "rn").collect():
        out.setdefault(r["qid"], []).append(r["id"])
    return out


def vector_table(spark, m):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id bigint, vector array<double>")


def test_knn_plans_agree(spark, monkeypatch):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 8)) * 3
    c = np.concatenate([rng.normal(size=(300, 8)) + centres[rng.integers(0, 6, 300)], np.tile(centres[0], (150, 1))])
    q = rng.normal(size=(40, 8)) + centres[rng.integers(0, 6, 40)]
    want = brute(q, c, 7)
    qs, cs = vector_table(spark, q), vector_table(spark, c)
    assert as_lists(knn.knn(qs, cs, 7)) == want
    monkeypatch.setattr(knn, "SLICE_ROWS", 32)
    assert as_lists(knn.knn(qs, cs, 7, max_broadcast=5)) == want
    assert as_lists(knn.knn_join(qs, cs, 7, cells=3)) == want


def clustered(rng, n, dim=16, per=40):
    middle = rng.normal(size=(max(n // per, 1), dim))
    return middle[rng.integers(0, len(middle), n)] + 0.15 * rng.normal(size=(n, dim))


def test_the_join_skips_cells_and_finds_all(spark):
    rng = np.random.default_rng(11)
    c, q = clustered(rng, 3000), clustered(rng, 200)
    cs, qs = vector_table(spark, c), vector_table(spark, np.concatenate([c[:150], q[:50]]))
    want = brute(np.concatenate([c[:150], q[:50]]), c, 4)
    assert as_lists(knn.knn_join(qs, cs, 4, cells=60)) == want
    u, v = (tables.materialise(knn.usable(t, "id", "vector")) for t in (qs, cs))
    tree = knn.cell_tree(v, 3000, 50)
    sizes = [r["n"] for r in tree.small.collect()]
    assert sum(sizes) == tree.rows.count() == 3000 and len(sizes) >= 40 and len(tree.coarse) <= 8
    visits = knn.exact_visits(u, tree, 4, "qid bigint, id bigint, cos double")
    share = knn.visited_share(visits, tree).first()
    assert share["rows"] == 3000 and share["pairs"] < 0.5 * 200 * 3000


def test_the_join_sends_a_query_to_few_cells_where_cells_tell_nothing(spark, monkeypatch):
    rng = np.random.default_rng(5)
    c = rng.normal(size=(1500, 12))
    c[700:1400:2] = c[1400]  # more copies than are looked for, and equal scores
    q = np.concatenate([c[:60], c[1390:1410], rng.normal(size=(20, 12))])
    sent, join = [], knn._block_join
    monkeypatch.setattr(knn, "_block_join", lambda visits, *rest: sent.append(visits.count()) or join(visits, *rest))
    monkeypatch.setattr(knn, "JOIN_ROWS", 200)
    assert as_lists(knn.knn_join(vector_table(spark, q), vector_table(spark, c), 6, cells=60)) == brute(q, c, 6)
    assert 0 < sum(sent) <= 2 * len(q)


def test_the_k_nearest_of_a_block_without_bounds():
    rng = np.random.default_rng(6)
    c, q = (knn.unit_rows(list(rng.normal(size=(n, 8)))) for n in (900, 30))
    c[100:140] = c[99]
    ids = rng.permutation(900)
    got = knn._within(np.arange(30), q, np.full(30, 4.0), pd.Series(ids), c, np.arange(900) // 250, 5)
    cos = np.round(q @ c.T, knn.COS_DIGITS)
    want = [(i, ids[j]) for i in range(30) for j in sorted(range(900), key=lambda j: (-cos[i, j], ids[j]))[:5]]
    assert list(zip(got["qid"], got["id"])) == want


@pytest.mark.parametrize("n", [1000, 9000])
def test_tree_recall_and_work(spark, n):
    """Recall at 10 on clustered vectors, and what a query compares, at two sizes: the root of the rows for each cell it visits."""
    rng = np.random.default_rng(n)
    c = clustered(rng, n)
    picked = rng.choice(n, 100, replace=False)
    cs = vector_table(spark, c)
    qs = spark.createDataFrame([(int(i), [float(x) for x in c[i]]) for i in picked], "id bigint, vector array<double>")
    unit = c / np.linalg.norm(c, axis=1, keepdims=True)
    got = as_lists(knn.knn_tree(qs, cs, 10))
    recall = np.mean([len(set(got[i]) & set(np.argsort(-(unit[i] @ unit.T), kind="stable")[:10])) / 10 for i in picked.tolist()])
    assert recall >= 0.9
    u, v = (tables.materialise(knn.usable(t, "id", "vector")) for t in (qs, cs))
    tree = knn.cell_tree(v, n)
    share = knn.visited_share(knn.nearest_cells(u, tree, 16, 8), tree).first()
    assert share["pairs"] <= 100 * 16 * 4 * n**0.5


def test_knn_null_and_zero(spark):
    c = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, None)], "id bigint, vector array<double>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "id bigint, vector array<double>")
    got = [(r["id"], r["score"]) for r in knn.knn(q, c, 4).orderBy("rn").collect()]
    assert got == [(1, 1.0), (2, 0.5)]
    assert knn.knn(q.filter("id > 5"), c, 3).isEmpty()
    assert as_lists(knn.knn_join(q, c, 4)) == {0: [1, 2]}


@pytest.mark.parametrize("cells", [None, 6])
def test_knn_takes_rows_without_an_id(spark, cells):
    """A null id is a row as any other; of equal scores it comes last."""
    rng = np.random.default_rng(8)
    m = rng.normal(size=(60, 8))
    m[10:14] = m[14]
    names = [None if i in (10, 12, 40) else f"r{i:02}" for i in range(60)]
    c = spark.createDataFrame([(n, [float(x) for x in v]) for n, v in zip(names, m)], "id string, vector array<double>").repartition(3)
    q = spark.createDataFrame([(i, [float(x) for x in m[i]]) for i in (10, 40, 55)], "id bigint, vector array<double>")
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    cos = np.round(unit @ unit.T, knn.COS_DIGITS)
    for k in (3, 7):
        want = {i: [names[j] for j in sorted(range(60), key=lambda j: (-cos[i, j], names[j] is None, names[j] or ""))[:k]] for i in (10, 40, 55)}
        found = knn.knn(q, c, k) if cells is None else knn.knn_join(q, c, k, cells=cells)
        assert as_lists(found) == want


def test_knn_scans_parts_without_rows(spark):
    """Parquet files longer than a split leave tasks without rows; these give none, whatever kind the ids are."""
    q = spark.createDataFrame([("a", [1.0, 0.0])], "id string, vector array<double>")
    texts = spark.createDataFrame([("x", [1.0, 0.1]), ("y", [0.0, 1.0])], "id string, vector array<double>")
    numbers = spark.createDataFrame([(2**60 + 1, [1.0, 0.1]), (None, [0.0, 1.0])], "id bigint, vector array<double>")
    assert as_lists(knn.knn(q, texts.repartition(8), 2)) == {"a": ["x", "y"]}
    assert as_lists(knn.knn(q, numbers.repartition(8, "id"), 2)) == {"a": [2**60 + 1, None]}


def test_join_meets_slices_without_rows(spark, monkeypatch):
    """Rows of equal id, null here, lie in one slice of their cell, so the other slices are empty."""
    monkeypatch.setattr(knn, "SLICE_ROWS", 2)
    rng = np.random.default_rng(9)
    m = rng.normal(size=(24, 8))
    names = [f"r{i:02}" if i < 4 else None for i in range(24)]
    c = spark.createDataFrame([(n, [float(x) for x in v]) for n, v in zip(names, m)], "id string, vector array<double>")
    q = c.filter("id IS NOT NULL")
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    cos = np.round(unit @ unit.T, knn.COS_DIGITS)
    want = {names[i]: [names[j] for j in np.argsort(-cos[i])[:5]] for i in range(4)}
    for cells in (1, 4):
        assert as_lists(knn.knn_join(q, c, 5, cells=cells)) == want


def test_cells_recall(spark, sf):
    v = X.vectors(spark, sf).selectExpr("vec_id AS id", "embedding AS vector")
    exact = as_lists(knn.knn(v, v, 5))
    near = as_lists(knn.knn_cells(v, v, knn.kmeans_cells(v, 16), 5, 8))
    recall = np.mean([len(set(near[i]) & set(exact[i])) / 5 for i in exact])
    assert recall >= 0.8
    assert as_lists(knn.knn_cells(v, v, knn.kmeans_cells(v, 16), 5, 16)) == exact


def test_places(spark):
    blocks = spark.createDataFrame([(0, 2**32 - 1, "all", "0,0"), (100, 199, "mid", "1,1"), (150, 150, "one", "bad"), (300, 300, "last", "2,2")],
                                   "start_ip bigint, end_ip bigint, country_name string, location string")
    rng = np.random.default_rng(0)
    nums = [int(x) for x in rng.integers(0, 400, 60)] + [99, 100, 150, 199, 200, 300, 2**32 - 1]
    ips = spark.createDataFrame([(f"{n >> 24}.{n >> 16 & 255}.{n >> 8 & 255}.{n & 255}", n) for n in nums] + [("x", -1)], "ip string, n bigint")
    for r in enrich.add_place(ips, blocks, "ip").collect():
        n = r["n"]
        want = None if n < 0 else "one" if n == 150 else "last" if n == 300 else "mid" if 100 <= n <= 199 else "all"
        assert r["country_name"] == want


def test_localise_and_override(spark):
    df = spark.createDataFrame([("1",), ("2",)], ["id"])
    tr = spark.createDataFrame([("1", "t", "d", None)], "id string, title string, description string, keywords string")
    got = {r["id"]: tuple(r)[1:] for r in enrich.localise(df, tr).collect()}
    assert got["1"] == ("t", "d", enrich.NO_KEYWORDS) and got["2"][0] == enrich.NO_TITLE_FR


def test_mrr_and_acc(spark):
    ranks = spark.createDataFrame([("a", 1), ("b", 4), ("c", 7)], "req_id string, rank int")
    queries = spark.createDataFrame([(x,) for x in "abcd"], ["req_id"])
    results = ranks.withColumn("id", F.col("req_id"))
    first = evaluate.first_relevant(results, results.select("req_id", "id"), queries, 5)
    assert evaluate.mrr_at_k(first).first()["mrr"] == pytest.approx(0.3125)
    assert evaluate.acc_at_k(first).first()["acc"] == pytest.approx(0.5)


@pytest.mark.parametrize("scanned", [256, 0])
def test_judged_pairs(spark, monkeypatch, scanned):
    monkeypatch.setattr(evaluate, "MAX_SCANNED", scanned)
    docs = spark.createDataFrame([("1", "xx one two three four five six seven yy"), ("2", "one two three"), ("3", "zone two threes")], ["id", "text"])
    passages = spark.createDataFrame([("p", "x one two three four five six seven"), ("s", "one two three")], ["req_id", "passage"])
    got = sorted(map(tuple, evaluate.judged_pairs(docs, passages).collect()))
    assert got == [("p", "1"), ("s", "1"), ("s", "2"), ("s", "3")]
    short = spark.createDataFrame([("a", "two"), ("b", "e tw"), ("c", "o"), ("d", "zo"), ("e", ""), ("f", None), ("g", "nine")], ["req_id", "passage"])
    texts = {r["id"]: r["text"] for r in docs.collect()}
    want = sorted((p["req_id"], i) for p in short.collect() for i, t in texts.items() if p["passage"] and p["passage"] in t)
    assert sorted(map(tuple, evaluate.judged_pairs(docs, short).collect())) == want


@pytest.mark.parametrize("scanned", [256, 0])
def test_judged_pairs_of_long_texts_and_odd_passages(spark, monkeypatch, scanned):
    """Texts of 400,000 characters, with and without blanks, take no step for each pair of their characters."""
    monkeypatch.setattr(evaluate, "MAX_SCANNED", scanned)
    rng = np.random.default_rng(5)
    long = " ".join("".join(chr(97 + x) for x in rng.integers(0, 26, 5)) for _ in range(70_000))
    texts = {"a": long, "b": long.replace(" ", ""), "c": "é\tö  ü", "d": "", "e": " lead", "f": "日本 語\n", "g": None}
    words = long.split()
    asked = ["é\tö", "ö  ü", "ö ü", " lead", "lead", "d", " ", "\t", "本 語", "語\n", "日", " ".join(words[500:509]), " ".join(words[40:44]), words[7][1:] + " " + words[8][:2], long[90:93], "nowhere to be", ""]
    docs = spark.createDataFrame(list(texts.items()), "id string, text string")
    passages = spark.createDataFrame([(str(i), p) for i, p in enumerate(asked)] + [("0", asked[0]), ("1", asked[0]), ("x", None)], "req_id string, passage string")
    want = sorted({(r, i) for r, p in [(str(i), p) for i, p in enumerate(asked)] + [("1", asked[0])] for i, t in texts.items() if p and t and p in t})
    start = time.perf_counter()
    assert sorted(map(tuple, evaluate.judged_pairs(docs, passages).collect())) == want
    assert time.perf_counter() - start < 120


def test_quartiles_are_exact(spark):
    values = [float((i * 7919) % 1009) for i in range(1009)] + [5.0] * 400
    df = spark.createDataFrame([(v, None if i % 3 else -v) for i, v in enumerate(values)], "a double, b double")
    got = {r["column"]: r for r in evaluate.summary(df, ["a", "b"]).collect()}
    for name, column in (("a", values), ("b", [-v for i, v in enumerate(values) if i % 3 == 0])):
        ranked = sorted(column)
        assert [got[name][q] for q in ("q25", "q50", "q75")] == [ranked[-int(-len(ranked) * p // 1) - 1] for p in (0.25, 0.5, 0.75)]
    assert evaluate.summary(df.limit(0), ["a"]).count() == 0


def test_whole_json_is_kept(spark):
    rows = [("1", '[{"url":"u","name":{"en":"n"}},7,[1]]'), ("2", '{"a":1}'), ("3", "bad"), ("4", None)]
    out = spark.createDataFrame(rows, ["id", "t"]).select("id", F.expr(f"to_json({J.whole_json('t')})").alias("j"))
    got = {r["id"]: json.loads(r["j"]) for r in out.collect()}
    assert got == {"1": [{"url": "u", "name": {"en": "n"}}, 7, [1]], "2": [{"a": 1}], "3": [], "4": []}


def test_last_per_id_and_upsert(spark):
    a = spark.createDataFrame([("1", "x"), ("2", "y")], ["id", "v"])
    b = spark.createDataFrame([("2", "z"), ("3", "w")], ["id", "v"])
    both = tables.union_collections([a, b])
    assert sorted((r["id"], r["v"]) for r in ingest.last_per_id(both).collect()) == [("1", "x"), ("2", "z"), ("3", "w")]
    assert sorted((r["id"], r["v"]) for r in ingest.upsert(a, b).collect()) == [("1", "x"), ("2", "z"), ("3", "w")]
    twice = spark.createDataFrame([("2", "late", 9), ("2", "early", 1), ("3", "w", 1)], ["id", "v", "n"])
    assert sorted((r["id"], r["v"]) for r in ingest.upsert(a, twice, order="n").collect()) == [("1", "x"), ("2", "late"), ("3", "w")]


def test_upsert_of_repeated_ids_needs_an_order(spark):
    a, b = (spark.createDataFrame(rows, "id string, v string") for rows in ([("1", "x")], [("2", "y"), ("2", "z")]))
    with pytest.raises(Exception, match="id 2 is repeated"):
        ingest.upsert(a, b).collect()


def bucket_files(path):
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in path.rglob("*.parquet")}


def test_a_load_rewrites_its_buckets_only(spark, sf, tmp_path):
    path, spec = tmp_path / "catalogue", CatalogueSpec(vector_dim=64)
    raw = tables.materialise(X.raw_records(spark, sf))
    store.load(raw, str(path), spec, buckets=16)
    before = bucket_files(path)
    assert len({f.split("/")[0] for f in before}) == 16
    one = raw.limit(1).withColumn("features_popularity", F.lit("77"))
    key = one.first()["features_properties_id"]
    store.load(one, str(path), spec)
    after = bucket_files(path)
    changed = {f.split("/")[0] for f in before.keys() ^ after.keys()} | {f.split("/")[0] for f in before if f in after and before[f] != after[f]}
    assert len(changed) == 1 and len(list(path.parent.iterdir())) == 1
    assert store.read(spark, str(path), spec).where(F.col("id") == key).first()["popularity"] == 77
    with pytest.raises(Exception, match="is repeated"):
        store.load(one.unionByName(one), str(path), spec)
    assert store.read(spark, str(path), spec).count() == raw.count()


def test_a_load_that_broke_off_is_finished_later(spark, sf, tmp_path):
    path, spec = tmp_path / "catalogue", CatalogueSpec(vector_dim=64)
    raw = tables.materialise(X.raw_records(spark, sf).limit(60))
    store.load(raw, str(path), spec, buckets=16)
    stored = spark.read.parquet(str(path))
    column, _ = store._bucketing(stored)
    # A complete replacement of two buckets that was not put in place yet, one bucket renamed aside already.
    chosen = [r[0] for r in stored.select(column).distinct().orderBy(column).limit(2).collect()]
    held = stored.where(F.col(column).isin(chosen)).count()
    store._stage(stored.where(F.col(column).isin(chosen)).withColumn("popularity", F.lit(5)), str(path), column)
    (path / f"{column}={chosen[0]}").rename(path / f".replaced-{column}={chosen[0]}")
    got = store.read(spark, str(path), spec)
    assert got.count() == 60 and got.where("popularity = 5").count() >= held > 0
    # An incomplete one is not used.
    store._stage(spark.read.parquet(str(path)).withColumn("popularity", F.lit(6)), str(path), column)
    (path.parent / "catalogue.pending" / "_SUCCESS").unlink()
    assert store.read(spark, str(path), spec).where("popularity = 6").isEmpty()


def test_events_without_a_time_are_loaded_once(spark, tmp_path):
    log = spark.createDataFrame([("a", None, "m"), ("a", None, "m"), ("c", 5, None), ("b", 86_400_000, "x")], "stream string, timestamp bigint, message string")
    for _ in range(3):
        logs.load_new_events(log, str(tmp_path / "sink"))
    got = spark.read.parquet(str(tmp_path / "sink"))
    assert sorted(r["day"] for r in got.collect()) == ["1970-01-01", "1970-01-02", "unknown"]


def test_catalogue_load(spark, sf, tmp_path):
    path, spec = str(tmp_path / "catalogue"), CatalogueSpec(vector_dim=64)
    raw = X.raw_records(spark, sf).cache()
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "20")
    try:
        store.load(raw, path, spec)
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    stored = store.read(spark, path, spec)
    assert stored.count() == raw.count() and stored.where("vector IS NULL").isEmpty()
    # A filter on place can skip most files by their smallest and largest values.
    edges = stored.groupBy(F.input_file_name()).agg(F.min("xmin").alias("a"), F.max("xmax").alias("b"))
    assert edges.where("a <= -130 AND b >= -135").count() < 0.7 * edges.count()
    one = raw.limit(1).withColumn("features_popularity", F.lit("77")).cache()
    key = one.first()["features_properties_id"]
    store.load(one, path, spec)
    again = store.read(spark, path, spec)
    assert again.count() == raw.count() and again.where(F.col("id") == key).first()["popularity"] == 77
    with pytest.raises(Exception, match="declared: 32"):
        store.write(again, path, CatalogueSpec(vector_dim=32))
    assert store.read(spark, path, spec).count() == raw.count()
    spark.range(1).write.parquet(str(tmp_path / "other"))
    with pytest.raises(ValueError, match="lacks"):
        store.read(spark, str(tmp_path / "other"), spec)


def test_a_load_embeds_each_record_once(spark, sf, tmp_path):
    path, spec = str(tmp_path / "catalogue"), CatalogueSpec(vector_dim=2)
    raw = X.raw_records(spark, sf).limit(30).cache()
    rows = raw.withColumn("load_seq", F.explode(F.array(F.lit(1), F.lit(2), F.lit(0)))).withColumn("features_popularity", F.col("load_seq").cast("string"))
    embedded = spark.sparkContext.accumulator(0)

    def encoder(texts):
        embedded.add(len(texts))
        return np.ones((len(texts), 2))

    store.load(rows, path, spec, encoder=encoder)
    assert embedded.value == 30 == raw.count()
    store.load(rows.withColumn("features_popularity", F.concat("features_popularity", F.lit("0"))), path, spec, encoder=encoder)
    assert embedded.value == 60
    got = store.read(spark, path, spec)
    assert got.count() == 30 and got.where("popularity <> 20").isEmpty() and "load_seq" not in got.columns
    assert [f.name for f in tmp_path.iterdir()] == ["catalogue"]


def test_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("1",), ("2",)], ["id"])
    assert tables.create_if_absent(spark, path, df.schema) is True
    assert tables.create_if_absent(spark, path, df.schema) is False
    tables.append_table(df, path)
    tables.append_table(df, path)
    assert spark.read.parquet(path).count() == 4
    assert tables.clear_table(spark, path) == 4
    assert spark.read.parquet(path).columns == ["id"] and spark.read.parquet(path).count() == 0


def test_recent(spark):
    now = dt.datetime(2024, 1, 1, 3, 0, tzinfo=dt.timezone.utc)
    ms = int(now.timestamp() * 1000)
    log = spark.createDataFrame([("a", ms - 119 * 60000), ("b", ms - 121 * 60000), ("c", ms + 1)], "stream string, timestamp bigint")
    assert [r["stream"] for r in logs.recent(log, now).collect()] == ["a"]
    assert [r["stream"] for r in logs.recent(log, now, 130).orderBy("stream").collect()] == ["a", "b"]


def test_stream_is_idempotent(spark, sf, tmp_path):
    src, out, chk = (str(tmp_path / x) for x in ("in", "out", "chk"))
    log = X.slow_log(spark, sf)
    log.write.json(src)
    for _ in range(2):
        logs.start_stream(spark, src, out, chk).awaitTermination()
    batch = logs.slow_log_etl(log)
    got = spark.read.parquet(out).select(batch.columns)
    assert got.count() == batch.count() and got.exceptAll(batch).isEmpty()
    # The same events delivered again in new files add nothing.
    log.write.mode("append").json(src)
    logs.start_stream(spark, src, out, chk).awaitTermination()
    assert spark.read.parquet(out).count() == batch.count()
    # An event of months ago still comes in, once.
    old = spark.createDataFrame([("node-1", 1600000000000, "slow"), ("node-1", 1600000000000, "slow")], log.schema)
    for _ in range(2):
        old.write.mode("append").json(src)
        logs.start_stream(spark, src, out, chk).awaitTermination()
    assert spark.read.parquet(out).count() == batch.count() + 1
