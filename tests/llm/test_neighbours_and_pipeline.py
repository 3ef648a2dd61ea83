"""Nearest neighbours against brute force, and the pipeline against its stages done plainly."""

import math

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from lodestar.llm import decontaminate, neighbours

VECTORS = "vec_id bigint, embedding array<float>, label int"


def brute(rows, queries, k):
    good = {i: np.array(v, float) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in queries:
        if q in good:
            near = sorted((-float(good[q] @ v / (np.linalg.norm(good[q]) * np.linalg.norm(v))), i) for i, v in good.items() if i != q)
            out[q] = [(i, -s) for s, i in near[:k]]
    return out


def test_neighbours_reach_the_recall(spark):
    rng = np.random.default_rng(3)
    data = rng.normal(size=(3000, 24)).astype(np.float32).tolist()
    rows = [(i, v) for i, v in enumerate(data)]
    table = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS)
    got = neighbours.search(table, F.col("vec_id") % 50 == 0).collect()
    want = brute([(i, np.float32(v).tolist()) for i, v in rows], range(0, 3000, 50), 5)
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(found) == set(want) and all(len(v) == 5 for v in found.values())
    recall = np.mean([len({i for i, _ in found[q]} & {i for i, _ in want[q]}) / 5 for q in want])
    assert recall >= 0.9
    for q, near in found.items():
        exact = dict(brute([(q, rows[q][1]), *((i, rows[i][1]) for i, _ in near)], [q], 5)[q])
        assert all(abs(s - exact[i]) < 1e-12 for i, s in near)
        assert near == sorted(near, key=lambda x: (-x[1], x[0]))


def test_copies_ties_and_unusable_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(i, [1.0, 2.0]) for i in range(0, 40)] + [(50, [2.0, 1.0]), (51, None), (52, []), (53, [0.0, 0.0]), (54, [None, 1.0]), (100, [nan, 1.0]), (55, [inf, 1.0])]
    rows += [(None, [1.0, 1.0]), (56, [-1.0, 3.0]), (150, [1.0, 1.0, 1.0]), (0, [1.0, 2.0])]
    table = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS).withColumn("node", F.lit(1)).withColumn("rank", F.lit(1))
    got = neighbours.search(table, F.col("vec_id") % 50 == 0).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append(r.vec_id)
    assert found == {0: [1, 2, 3, 4, 5], 50: [0, 1, 2, 3, 4]}


def test_very_long_and_very_short_vectors_keep_their_neighbours(spark):
    rng = np.random.default_rng(4)
    data = rng.normal(size=(600, 8)) * np.array([1e-30, 1.0, 1e30])[np.arange(600) % 3][:, None]
    rows = [(i, v) for i, v in enumerate(data.astype(np.float32).tolist())]
    wide = [(i, [x * 1e-170 if i % 2 else x * 1e170 for x in v]) for i, v in rows]
    for kind, given in (("float", rows), ("double", wide)):
        table = spark.createDataFrame(given, f"vec_id bigint, embedding array<{kind}>")
        found = {}
        for r in neighbours.search(table, F.col("vec_id") % 20 == 0).collect():
            found.setdefault(r.query_id, set()).add(r.vec_id)
        want = brute([(i, (np.array(v) / np.abs(v).max()).tolist()) for i, v in given], range(0, 600, 20), 5)
        assert set(found) == set(want) and all(len(v) == 5 for v in found.values())
        assert np.mean([len(found[q] & {i for i, _ in want[q]}) / 5 for q in want]) >= 0.9


def test_few_or_no_candidates(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [1.0, 1.0], 1)]
    table = spark.createDataFrame(rows, VECTORS)
    got = neighbours.search(table, F.col("vec_id") == 0).collect()
    assert [(r.rank, r.vec_id) for r in sorted(got, key=lambda r: r.rank)] == [(1, 2), (2, 1)]
    assert neighbours.search(table.limit(1), F.lit(True)).count() == 0
    assert neighbours.search(table.limit(0), F.lit(True)).count() == 0


def test_stages_keep_the_columns_and_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    first = docs
    counts = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf).toPandas(), first.schema)
        assert docs.columns == names
        counts.append(docs.count())
    assert counts[1] < counts[0] and counts[2] == counts[1] and counts[3] < counts[2] and counts[4] <= counts[3]
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    assert decontaminate.decontaminate(docs, bench).where("n_hit > 0").count() == 0
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    want = {r.doc_id: r.d for r in docs.select("doc_id", F.sha2("text", 256).alias("d")).collect()}
    assert {r.doc_id: r.decoded_sha256 for r in out.collect()} == want


def test_pipeline_gives_what_its_stages_give(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "token_ids", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert 0 < out.count() < spark.read.parquet(f"{sf}/documents.parquet").count()


def test_pipeline_gives_what_plain_rules_give(spark, sf):
    """From what the classifier leaves on: lines and windows by SQL over all rows, groups by all pairs, ids by the library."""
    import base64
    import hashlib

    import duckdb
    import public_tokenizers
    import tiktoken
    from test_pairs_and_lines import expected_groups

    from lodestar.llm.queries import ORACLE_SQL

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{sf}/benchmark.parquet'")
    left = corpus_pipeline.drop_toxic(spark, docs, sf).toPandas()
    db.register("documents", left)
    lines = dict(db.execute(f"SELECT doc_id, text FROM ({ORACLE_SQL['op4_line_dedup']})").fetchall())
    group = expected_groups([(i, t, "") for i, t in lines.items()], 5, 80)
    kept = {i: t for i, t in lines.items() if group[i] == i}
    db.unregister("documents")
    left = left[left["doc_id"].isin(kept)].assign(text=lambda d: d["doc_id"].map(kept))
    db.register("documents", left)
    clean = [i for i, bad in db.execute(f"SELECT doc_id, contaminated FROM ({ORACLE_SQL['op9_benchmark_decontamination']})").fetchall() if not bad]
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}
    library = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = lambda text: hashlib.sha256(np.array(library.encode_ordinary(text), "<u4").tobytes()).hexdigest()
    assert {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, sf).collect()} == {i: ids(kept[i]) for i in clean}


def test_stages_keep_columns_of_any_name(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(30)
    odd = ["score", "n_hit", "n_words", "spans", "items", "n_lines", "n_removed", "kept", "component_id", "gone", "key"]
    given = docs.unionByName(docs.limit(3)).unionByName(docs.limit(1).withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.lit(None).cast("bigint")))
    given = given.select("*", *[F.concat(F.lit(f"{c} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c) for c in odd])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, given, sf)
        assert out.columns == given.columns
        for r in out.collect():
            assert all(r[c] == f"{c} {'none' if r.doc_id is None else r.doc_id}" for c in odd)
    assert corpus_pipeline.encode(spark, given, sf).count() == 34


def test_stages_of_nothing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0


def test_toxic_documents_go_and_clean_ones_stay(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    left = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, sf).select("doc_id").collect()}
    clean = {r.doc_id for r in labels.where("toxic = 0").collect()}
    assert clean <= left
    toxic = {r.doc_id for r in labels.where("toxic = 1").collect()}
    assert len(toxic - left) >= 0.8 * len(toxic)


def test_all_and_the_pipeline_are_registered():
    names = entry.queries()
    assert "pipeline" in names
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
