"""Ranked search, centroid clustering and the Jaccard join against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from test_pairs_and_lines import DOCS, expected_groups, sentence, shingle_set, table

from lodestar.llm import centroids, lexical, setlinks, voronoi
from lodestar.llm.frames import Scratch

# --- ranked search -----------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def terms_of(text):
    return TERM.findall((text or "").translate(LOWER))


def ranked_plainly(docs, items, k):
    """``[(item, rank, doc, score)]`` by scoring every document; documents are ``(id, text)``."""
    counts = [(i, Counter(terms_of(t))) for i, t in docs]
    held = [sum(c.values()) for _, c in counts]
    n_docs, n_terms = sum(n > 0 for n in held), sum(held)
    df = Counter(t for _, c in counts for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms_of(text))
    out = []
    for item, terms in asked.items():
        scored = []
        for place, ((i, c), n) in enumerate(zip(counts, held)):
            score = 0
            for t in terms & c.keys():
                m = 50 + (50 * n * n_docs) // n_terms
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0, place))
        for rank, (score, missing, i, _) in enumerate(sorted(scored)[:k], 1):
            out.append((item, rank, None if missing else i, -score))
    return sorted(out, key=repr)


def search_rows(spark, docs, items, k):
    d = spark.createDataFrame([(i, t, "x", 1.0) for i, t in docs], "doc_id bigint, text string, term string, score double")
    q = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id bigint, text string, rank int")
    got = lexical.ranked_search(d, q, k=k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, got.collect()), key=repr)


def test_search_ranks_as_scoring_every_document_does(spark):
    rng = random.Random(5)
    words = [sentence(rng, 1) for _ in range(60)] + ["été", "naïve", "X1"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.randint(1, 80)))) for i in range(400)]
    docs[7] = (7, docs[8][1])  # a tie
    docs += [(8, docs[8][1]), (500, None), (501, ""), (502, " .;-\n"), (None, docs[3][1]), (503, "  ÉTÉ été-X1x1 " * 3), (504, "the " * 70_000)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(30)]
    items += [(40, None), (41, ""), (42, "nowhere"), (43, "the THE x1"), (3, "été"), (None, words[0]), (None, words[1])]
    for k in (5, 1000):
        assert search_rows(spark, docs, items, k) == ranked_plainly(docs, items, k)


def test_search_of_nothing(spark):
    assert search_rows(spark, [], [(1, "a")], 5) == []
    assert search_rows(spark, [(1, "a"), (2, None)], [], 5) == []
    assert search_rows(spark, [(1, None), (2, "")], [(1, "a")], 5) == []
    assert search_rows(spark, [(1, "a b")], [(1, "a")], 5) == ranked_plainly([(1, "a b")], [(1, "a")], 5)


def test_shards_and_blocks_of_queries_do_not_change_the_result(spark, monkeypatch):
    rng = random.Random(6)
    words = [sentence(rng, 1) for _ in range(40)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(1, 30)))) for i in range(300)]
    items = [(i, " ".join(rng.choices(words, k=6))) for i in range(40)]
    want = ranked_plainly(docs, items, 10)
    monkeypatch.setattr(lexical, "QUERY_BLOCK", 7)
    d = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(9)
    q = spark.createDataFrame(items, "item_id bigint, text string")
    scratch = Scratch(spark)
    index = lexical.build_index(scratch, d)
    assert index.lists.select("shard").distinct().count() == 9
    assert sorted(map(tuple, lexical.search(index, q, scratch, k=10).collect()), key=repr) == want


def random_lists(rng, size, n_lists):
    m = lexical.norms(rng.integers(1, 2000, size), size, 1000 * size)
    lists, dense = [], np.zeros(size, np.int64)
    for i in range(n_lists):
        df = int(size * rng.random() ** 4) + 1
        doc = np.sort(rng.choice(size, df, replace=False))
        count = np.where(rng.random(df) < 0.01, rng.integers(200, 100_000, df), rng.integers(1, 6, df))
        weight = math.floor(1000 * math.log((2 * size + 2) / (2 * df + 1)))
        headers, blocks_of, payload, bytes_of = lexical.pack(doc, count, lexical.parts_of_score(count, m[doc]), np.array([0]))
        assert list(blocks_of) == [0, -(-df // lexical.BLOCK)] and list(bytes_of) == [0, len(payload)]
        postings = lexical.Postings(headers.tobytes(), payload.tobytes(), weight)
        back = postings.decompress(np.arange(len(headers)))
        assert (back[0] == doc).all() and (back[1] == count).all()
        postings.decompressed = 0
        lists.append(postings)
        dense[doc] += weight * lexical.parts_of_score(count, m[doc])
    return lists, m, dense


@pytest.mark.parametrize("seed", range(6))
def test_block_max_search_skips_blocks_and_loses_nothing(seed):
    rng = np.random.default_rng(seed)
    size = 20_000
    lists, m, dense = random_lists(rng, size, 12)
    order = rng.permutation(size)
    for k, window in ((10, 512), (50, 4096), (30_000, 1000)):
        for x in lists:
            x.decompressed = 0
        doc, score = lexical.best_documents(lists, m, order, k, window)
        want = np.lexsort((order, -dense))
        want = want[dense[want] > 0][:k]
        assert (doc == want).all() and (score == dense[want]).all()
        if k == 10:
            assert sum(x.decompressed for x in lists) < sum(len(x.headers) for x in lists)


# --- clustering --------------------------------------------------------------------------------------

VECTORS = "vec_id bigint, embedding array<double>, cluster int, distance string"


def clustered_plainly(rows, k=16, rounds=3, width=64, most=2**27):
    kept = [(i, [max(-most, min(most, math.floor(64 * x))) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    hashed = sorted((i is None, hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept)
    centres = [v for *_, v in hashed[:k]]
    near = lambda v: min((sum((x - y) ** 2 for x, y in zip(v, c)), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        for j, vs in groups.items():
            centres[j] = [sum(c) // len(vs) for c in zip(*vs)]
    found = [(i, *near(v)) for i, v in kept]
    top = 2**63 - 1
    per = Counter()
    for _, d, j in found:
        per[j] += d
    return sorted(((i, j, d, min(per[j], top), min(sum(per.values()), top), hashlib.sha256(",".join(map(str, centres[j])).encode()).hexdigest()) for i, d, j in found), key=repr)


def cluster_rows(spark, rows, **options):
    got = centroids.cluster(spark.createDataFrame([(i, v, 3, "x") for i, v in rows], VECTORS), **options)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted(map(tuple, got.collect()), key=repr)


def test_clusters_are_those_of_plain_whole_numbers(spark):
    rng = np.random.default_rng(2)
    middle = rng.normal(size=(9, 64))
    rows = [(i, (middle[i % 9] * 0.3 + rng.normal(size=64) * 0.2).tolist()) for i in range(300)]
    rows += [(3, rows[3][1]), (None, rows[4][1]), (400, None), (401, []), (402, [1.0] * 63), (403, [None] + [1.0] * 63), (404, [math.nan] + [1.0] * 63), (405, [math.inf] * 64), (406, [0.0] * 64)]
    assert cluster_rows(spark, rows) == clustered_plainly(rows)


def test_clusters_of_huge_and_equal_vectors_and_of_none(spark):
    rng = np.random.default_rng(3)
    huge = [(i, (rng.normal(size=64) * 10.0 ** rng.integers(0, 9)).tolist()) for i in range(40)] + [(77, [1e300] * 64), (78, [-1e300] * 64)]
    assert cluster_rows(spark, huge) == clustered_plainly(huge)
    equal = [(i, [0.5] * 64) for i in range(20)]
    assert cluster_rows(spark, equal) == clustered_plainly(equal)
    few = [(i, rng.normal(size=64).tolist()) for i in range(5)]
    assert cluster_rows(spark, few) == clustered_plainly(few)
    assert cluster_rows(spark, []) == cluster_rows(spark, [(1, None)]) == []
    small = [(i, rng.normal(size=8).tolist()) for i in range(50)]
    assert cluster_rows(spark, small, width=8, k=4, rounds=5) == clustered_plainly(small, 4, 5, 8)


def test_the_transform_is_exact_and_coarse_first():
    rng = np.random.default_rng(4)
    x = rng.integers(-1000, 1000, (50, 64))
    t = centroids.transform(x)
    assert (centroids.restore(t) == x).all() and ((t**2).sum(1) == 64 * (x**2).sum(1)).all()
    changes = [int((np.diff(np.sign(centroids.restore(64 * row[None])[0])) != 0).sum()) for row in np.eye(64, dtype=np.int64)]
    assert changes == list(range(64))


def test_the_search_leaves_centroids_out_and_loses_nothing():
    rng = np.random.default_rng(5)
    middle = rng.integers(-60, 60, (16, 64))
    x = np.concatenate([middle[rng.integers(0, 16, 500)] + rng.integers(-9, 9, (500, 64)), middle[:2], (middle[:1] + middle[1:2]) // 2])
    winner, whole = centroids.nearest(centroids.transform(x), centroids.transform(middle))
    d = ((x[:, None] - middle[None]) ** 2).sum(2)
    assert (winner == d.argmin(1)).all() and (whole == 64 * d.min(1)).all()


# --- Jaccard join ------------------------------------------------------------------------------------


def check_components(spark, rows, shingle=3, percent=90):
    want = expected_groups(rows, shingle, percent)
    got = voronoi.jaccard_components(table(spark, rows), shingle=shingle, percent=percent).collect()
    assert len(got) == len(rows)
    sizes = Counter((i, len(shingle_set(t, shingle))) for i, t, _ in rows)
    assert Counter((r.doc_id, r.n_shingles) for r in got) == sizes
    for r in got:
        assert r.component_id == (None if r.doc_id is None else want[r.doc_id])


def near_copies(rng, base, n, most):
    """Chains of copies, each with some words other than the one before."""
    out, words = [], base.split()
    for _ in range(n):
        words = list(words)
        for _ in range(rng.randint(0, most)):
            words[rng.randrange(len(words))] = sentence(rng, 1)
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("shingle, percent", [(3, 90), (2, 50), (3, 100)])
def test_components_are_those_of_all_pairs(spark, shingle, percent):
    rng = random.Random(shingle * percent)
    texts = [sentence(rng, rng.randint(1, 60)) for _ in range(60)]
    for length in (4, 12, 30, 150):
        texts += near_copies(rng, sentence(rng, length), 12, 2)
    words = [sentence(rng, 1) for _ in range(6)]
    texts += [" ".join(rng.choices(words, k=rng.randint(1, 9))) for _ in range(40)]
    rng.shuffle(texts)
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    rows += [(900, None, "s"), (901, "", "s"), (902, " \n\t", "s"), (5, texts[6], "s"), (5, texts[5], "s"), (5, texts[5], "s"), (903, texts[5].upper(), "s")]
    check_components(spark, rows, shingle, percent)


def test_regions_are_split_around_pivots(spark, monkeypatch):
    monkeypatch.setattr(voronoi, "SMALL", 30)
    monkeypatch.setattr(voronoi, "SHRINK", 0.95)
    monkeypatch.setattr(voronoi, "SLICE", 16)
    monkeypatch.setattr(voronoi, "may_be_linked", lambda *a: True)
    splits = []
    plain = voronoi._split
    monkeypatch.setattr(voronoi, "_split", lambda *a: splits.append(a[1].count()) or plain(*a))
    rng = random.Random(9)
    # One common passage with many different ends, so that regions are large and not near.
    passage = sentence(rng, 60)
    texts = []
    for i in range(16):
        texts += near_copies(rng, f"{passage} {sentence(rng, rng.choice((10, 40, 80)))}", 6, 2)
    check_components(spark, [(i, t, "s") for i, t in enumerate(texts)])
    assert splits


def test_components_of_nothing(spark):
    assert voronoi.jaccard_components(spark.createDataFrame([], DOCS)).collect() == []
    check_components(spark, [(1, None, "s"), (2, "", "s")])
    clash = spark.createDataFrame([(1, "a b c d", 2, 3), (2, "a B c d", 2, 3)], "doc_id bigint, text string, n_shingles int, region int")
    assert [tuple(r) for r in voronoi.jaccard_components(clash).orderBy("doc_id").collect()] == [(1, 2, 1), (2, 2, 1)]
    missing = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (4, "a b c d")], "doc_id bigint, text string")
    assert Counter(map(tuple, voronoi.jaccard_components(missing).collect())) == Counter([(None, 2, None), (None, 2, None), (4, 2, 4)])


def test_linked_sets_hold_an_equal_part():
    rng = np.random.default_rng(7)
    for percent in (50, 80, 90, 95):
        for size in (1, 3, 9, 10, 11, 40, 300):
            base = rng.integers(0, 1 << 63, size, dtype=np.uint64)
            for _ in range(20):
                change = int(rng.integers(0, size + 1))
                other = np.concatenate((base[: size - change], rng.integers(0, 1 << 63, int(rng.integers(0, 2 * change + 1)), dtype=np.uint64)))
                a, b = np.unique(base), np.unique(other)
                if not len(b) or 100 * len(np.intersect1d(a, b)) < percent * len(np.union1d(a, b)):
                    continue
                keys, begins = voronoi.parts(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)]), percent)
                assert np.intersect1d(keys[: begins[1]], keys[begins[1] :]).size


def test_profiles_bound_what_sets_share():
    rng = np.random.default_rng(9)
    for size in (1, 5, 80, 5000, 9000, 40_000):
        a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
        for share in (0.5, 0.85, 0.93, 1.0):
            b = np.unique(np.concatenate((a[: int(size * share)], rng.integers(0, 1 << 63, size - int(size * share) + size // 20, dtype=np.uint64))))
            linked = 100 * len(np.intersect1d(a, b)) >= 90 * len(np.union1d(a, b))
            may = voronoi.may_be_linked(voronoi.profile(a), voronoi.profile(b), 90)
            assert may or not linked
            if size > 50 and share == 0.5:
                assert not may


def test_intersections_are_counted_in_column_blocks(monkeypatch):
    monkeypatch.setattr(setlinks, "BLOCK_COLUMNS", 7)
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40))).astype(np.uint64) for _ in range(20)]
    got = setlinks.intersections(sets[:8], sets[8:])
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets[8:]] for a in sets[:8]]
    alone = setlinks.intersections([np.array([1], np.uint64)], [np.array([2], np.uint64)])
    assert alone.tolist() == [[0]]
