"""Near duplicates, line dedup, substring dedup and components against plain Python."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from lodestar.llm import graph, line_dedup, near_dedup, setlinks, substring_dedup, words
from lodestar.llm.frames import Scratch

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOCS)


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def shingle_set(text, size):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def expected_groups(rows, size, percent):
    sets = {}
    for i, t, _ in rows:
        sets.setdefault(i, []).append(shingle_set(t, size))
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        for x, y in itertools.product(sets[a], sets[b]):
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return {i: root(i) for i in sets}


def edited(rng, text, share):
    return " ".join(w if rng.random() > share else sentence(rng, 1) for w in text.split())


@pytest.fixture(scope="module")
def near_rows():
    rng = random.Random(5)
    rows, base = [], sentence(rng, 120)
    # A large group whose members are mostly linked by way of others only.
    rows += [(i, edited(rng, base, rng.choice([0.0, 0.01, 0.03, 0.05])), "s") for i in range(60)]
    rows += [(100 + i, sentence(rng, rng.randint(1, 60)), "s") for i in range(40)]
    rows += [(200 + i, rows[70 + i][1], "s") for i in range(10)]
    rows += [(300, None, "s"), (301, "", "s"), (302, " \t\n", "s"), (303, "Two words", "s"), (304, "two  WORDS", "s"), (305, "two words more", "s")]
    rows += [(306, sentence(rng, 30_000), "s"), (307, rows[0][1], "s"), (307, sentence(rng, 80), "s")]
    rows += [(308, rows[-1][1], "s"), (None, base, "s"), (None, None, "s"), (5, rows[5][1], "s")]
    return rows


def test_near_duplicates_match_all_pairs(spark, near_rows):
    got = near_dedup.near_duplicates(table(spark, near_rows), shingle=4).collect()
    want = expected_groups([r for r in near_rows if r[0] is not None], 4, 80)
    assert len(got) == len(near_rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.kept) == (want[r.doc_id], want[r.doc_id] == r.doc_id), r
    sizes = sorted((r.doc_id or -1, r.n_shingles) for r in got)
    assert sizes == sorted((i or -1, len(shingle_set(t, 4))) for i, t, _ in near_rows)


def test_near_duplicates_finish_without_stars(spark, near_rows):
    """The exact pass alone finds the same components."""
    got = near_dedup.near_duplicates(table(spark, near_rows), shingle=4, star_rounds=0)
    want = expected_groups([r for r in near_rows if r[0] is not None], 4, 80)
    assert {r.doc_id: r.component_id for r in got.collect() if r.doc_id is not None} == want


def test_near_duplicates_in_many_blocks(spark, near_rows, monkeypatch):
    monkeypatch.setattr(setlinks, "BLOCK_DOCS", 7)
    got = near_dedup.near_duplicates(table(spark, near_rows), shingle=4, star_rounds=0)
    want = expected_groups([r for r in near_rows if r[0] is not None], 4, 80)
    assert {r.doc_id: r.component_id for r in got.collect() if r.doc_id is not None} == want


def test_one_of_each_keeps_columns(spark, near_rows):
    docs = table(spark, near_rows).withColumn("component_id", F.lit("x")).withColumn("kept", F.lit("y"))
    out = near_dedup.one_of_each(docs, shingle=4)
    assert out.columns == docs.columns
    want = expected_groups([r for r in near_rows if r[0] is not None], 4, 80)
    assert sorted(r.doc_id for r in out.where("doc_id IS NOT NULL").collect()) == sorted(i for i, _, _ in near_rows if i is not None and want[i] == i)
    assert out.where("doc_id IS NULL").count() == 2


def test_near_duplicates_of_nothing(spark):
    assert near_dedup.near_duplicates(table(spark, [])).collect() == []
    assert near_dedup.one_of_each(table(spark, [(1, None, "a")])).count() == 1


def test_sketch_fills_and_estimates():
    import numpy as np

    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2**63, 900).astype(np.uint64))
    b = np.concatenate((a[:700], np.unique(rng.integers(0, 2**63, 200).astype(np.uint64))))
    one = a[:1]
    sets, firsts = np.concatenate((a, b, one)), np.cumsum([0, len(a), len(b), 1])
    out = near_dedup.sketch(sets, firsts, 448)
    assert (out != near_dedup._EMPTY).all()
    true = 700 / (len(a) + len(b) - 700)
    assert abs((out[0] == out[1]).mean() - true) < 0.1


def test_word_hashes_follow_words():
    import numpy as np

    texts = ["A b\tc", "", "  ", "é x Ünd", "a", "x" * 3000 + " b"]
    blobs = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, blobs)])
    hashes, firsts = words.word_hashes(np.frombuffer(b"".join(blobs), np.uint8), offsets)
    seen = {}
    for i, b in enumerate(blobs):
        for w, h in zip(b.lower().split(), hashes[firsts[i] : firsts[i + 1]].tolist(), strict=True):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200, 260)] + [(7, 7), (3, 9), (9, 4)], "a bigint, b bigint")
    got = {r.node: r.label for r in graph.components(Scratch(spark), links).collect()}
    assert {k: v for k, v in got.items() if k >= 200} == {i: 200 for i in range(200, 261)}
    assert got[9] == got[4] == 3


# --- lines --------------------------------------------------------------------------------------------


def test_lines_go_but_for_their_first_place(spark):
    rows = [(i, f"own {i}\n common line \n\nend {i}", f"s{i}") for i in range(1, 13)]
    rows += [(50, "common line\r\ncommon line", "s1"), (51, "few\nx", "s1"), (52, "few", "s2"), (53, None, "s3"), (54, "", "s4"), (55, "common line", None), (None, "common line", "s2")]
    rows += [(60 + i, "same site", "s1") for i in range(30)]
    got = {}
    for r in line_dedup.line_dedup(table(spark, rows)).collect():
        got[r.doc_id] = r
    assert got[1].text == rows[0][1] and got[1].n_removed == 0
    assert got[2].text == "own 2\n\nend 2" and (got[2].n_lines, got[2].n_removed) == (4, 1)
    assert got[50].text == "" and got[50].n_removed == 2
    assert got[51].text == "few\nx" and got[53].text is None and got[53].n_lines == 0 and got[54].text == ""
    assert got[55].text == "" and got[None].text == ""
    assert all(got[60 + i].text == "same site" for i in range(30))


def test_lines_near_the_threshold_are_exact(spark):
    rows = []
    for spread in range(5, 30):
        rows += [(spread * 100 + k, f"line {spread}", f"s{k % spread}") for k in range(2 * spread)]
    for least in (8, 10, 20):
        out = line_dedup.line_dedup(table(spark, rows), min_sites=least).where("n_removed > 0")
        assert {r.doc_id // 100 for r in out.collect()} == set(range(least, 30))


def test_lines_with_clashing_columns_and_repeats(spark):
    rows = [(1, "c", "a")] * 2 + [(i, "c", f"s{i}") for i in range(2, 14)]
    docs = table(spark, rows).withColumn("key", F.lit(1)).withColumn("gone", F.lit(2)).withColumn("row", F.lit(3)).withColumn("n_lines", F.lit("old"))
    out = line_dedup.line_dedup(docs)
    assert sorted(out.columns) == sorted(docs.columns + ["n_removed"])
    assert sorted((r.doc_id, r.text) for r in out.collect())[:3] == [(1, "c"), (1, "c"), (2, "")]
    assert line_dedup.line_dedup(table(spark, [])).count() == 0


# --- passages -----------------------------------------------------------------------------------------


def test_planted_passages_are_found_and_others_left(spark):
    rng = random.Random(8)
    clean = {i: sentence(rng, rng.randint(20, 400)) for i in range(120)}
    passages = [sentence(rng, rng.randint(55, 120)) for _ in range(12)]
    rows = [(i, t, "s") for i, t in clean.items()]
    for k in range(60):
        a, b = sentence(rng, rng.randint(0, 90)), sentence(rng, rng.randint(0, 90))
        rows.append((1008 + k, f"{a} {passages[k % 12]} {b}".strip(), "s"))
    got = {r.doc_id: r for r in substring_dedup.substring_dedup(table(spark, rows)).collect()}
    assert {i for i, r in got.items() if r.n_removed} == set(range(1020, 1068))
    text = dict((i, t) for i, t, _ in rows)
    for i, r in got.items():
        if i < 1020:
            assert r.text == text[i]
            continue
        assert r.holders and all(h < i and h % 12 == i % 12 for h in r.holders)
        at, kept = 0, []
        for s in r.spans:
            kept.append(text[i][at : s.start])
            at = s.end
        assert "".join(kept) + text[i][at:] == r.text
        # Words beside the passage may be equal by chance; what goes is what an earlier document has too.
        assert any(text[i][r.spans[0].start : r.spans[0].end] in text[h] for h in r.holders)


def test_passage_edge_cases(spark):
    rng = random.Random(3)
    body = "çé ñ日本 " * 3 + sentence(rng, 300)
    rows = [(1, body, "s"), (1, body, "s"), (2, body, "s"), (3, None, "s"), (4, "", "s"), (5, "A " * 200_000, "s"), (6, "b", "s"), (7, "b", "s"), (None, sentence(rng, 80), "s")]
    docs = table(spark, rows).withColumn("spans", F.lit("old")).withColumn("key", F.lit(1))
    got = substring_dedup.substring_dedup(docs)
    assert sorted(got.columns) == sorted([*docs.columns, "holders", "n_removed"])
    out = [(r.doc_id, r.text, r.n_removed) for r in got.collect()]
    by = dict((i, (t, n)) for i, t, n in out)
    assert [t for i, t, _ in out if i == 1] == [body, body]
    assert by[2][1] > 250 and len(by[2][0]) < len(body) / 10
    assert by[3] == (None, 0) and by[4] == ("", 0) and by[5] == (rows[5][1], 0) and by[7] == ("b", 0)
    assert substring_dedup.substring_dedup(table(spark, [])).count() == 0


def windows_of(text, n=50):
    """Windows of n words of a text with single spaces, without the signs at both ends."""
    w = text.split()
    return [" ".join(w[i : i + n]).strip("(.,)") for i in range(len(w) - n + 1)]


def test_passages_are_exactly_those_of_fifty_words(spark):
    rng = random.Random(5)

    def short(n):
        return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 4))) for _ in range(n))

    # Passages of 48 to 52 short words between others; one in brackets; a line repeated in one text, three
    # times in an earlier one; a text made of parts of two others; half copies.
    passages = [short(n) for n in (48, 49, 50, 50, 51, 51, 52) for _ in range(12)]
    rows = [(i, f"{short(9)} {p} {short(9)}", "s") for i, p in enumerate(passages)]
    rows += [(1000 + i, f"{short(9)} ({p}), {short(9)}", "s") for i, p in enumerate(passages)]
    rows += [(2000, f"{short(60)} " + "repeated " * 3 + short(60), "s"), (2001, "repeated " * 40 + short(60), "s")]
    parts = short(200).split(), short(200).split()
    rows += [(2010, " ".join(parts[0]), "s"), (2011, " ".join(parts[1]), "s"), (2012, " ".join(parts[0][20:60] + parts[1][20:60]), "s")]
    rows += [(2013, " ".join(parts[0][:120] + parts[1][:49] + parts[0][150:]), "s"), (2014, " ".join(["x"] * 70), "s"), (2015, " ".join(["x"] * 60 + ["y"]), "s")]
    got = {r.doc_id: r for r in substring_dedup.substring_dedup(table(spark, rows)).collect()}
    seen: dict[str, int] = {}
    for i, text, _ in rows:
        words, found = windows_of(text), set()
        gone = set()
        for at, w in enumerate(words):
            if w in seen:
                gone |= set(range(at, at + 50))
                found.add(seen[w])
        assert (got[i].n_removed, got[i].holders) == (len(gone), sorted(found)), i
        for w in words:
            seen.setdefault(w, i)
    assert sum(r.n_removed > 0 for r in got.values()) >= 62 and got[2001].n_removed == got[2012].n_removed == 0
    assert not any(p in got[1000 + i].text for i, p in enumerate(passages) if len(p.split()) >= 50)


def test_passages_just_over_fifty_words_are_found_at_any_word_length(spark):
    rng = random.Random(11)

    def text(n, low, high):
        return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(low, high))) for _ in range(n))

    for low, high in ((1, 4), (2, 8)):
        passages = [text(51, low, high) for _ in range(300)]
        rows = [(1000 * k + i, f"{text(30, low, high)} {p} {text(30, low, high)}", "s") for k in range(2) for i, p in enumerate(passages)]
        got = {r.doc_id: r for r in substring_dedup.substring_dedup(table(spark, rows)).where("n_removed > 0").collect()}
        assert set(got) == set(range(1000, 1300)) and all(r.n_removed >= 51 and passages[i - 1000] not in r.text for i, r in got.items())


def test_repeats_are_matched_across_batches():
    import pyarrow as pa

    rows = [(5, 1), (5, 1), (5, 2), (7, 3), (9, 4), (9, 4), (9, 6), (9, 7)]
    cols = ["deal", "known", "met", "order_id", "key", "place", "holder"]
    for size in (1, 2, 3, 8):
        batches = [
            pa.RecordBatch.from_pylist([dict(zip(cols, (d, False, d == 7, i, 0, 10 * i, 0))) for d, i in rows[a : a + size]], pa.schema(
                [(c, pa.bool_() if c in ("known", "met") else pa.int64()) for c in cols])) for a in range(0, 8, size)]
        later, both = ({(r["order_id"], r["place"], r["holder"]) for b in substring_dedup._matched(iter(batches), all_) for r in b.to_pylist()} for all_ in (False, True))
        assert later == {(2, 20, 1), (6, 60, 4), (7, 70, 4)}
        assert {r[:2] for r in both} == {(1, 10), (2, 20), (3, 30), (4, 40), (6, 60), (7, 70)}


def block_of(texts):
    import numpy as np

    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def test_chunks_do_not_shift():
    rng = random.Random(2)
    text = sentence(rng, 2000)
    words = text.split()
    # Whatever stands before, behind or in another text of the block, the chunks of the passage are the same.
    changed = " ".join([*words[:900], "inserted", *words[900:]])
    found = substring_dedup.Chunks(*block_of([text, "some words before " + text, "x", changed, ""]), 50)
    of = [set(found.digest[found.row[found.cut] == i].tolist()) for i in range(5)]
    assert len(of[0]) > 250 and not of[2] and not of[4]
    assert len(of[0] & of[1]) >= len(of[0]) - 3 and len(of[0] & of[3]) >= len(of[0]) - 6
    sizes = found.words[found.words > 0]
    assert sizes.max() <= substring_dedup.spread(50) and 4 < sizes.mean() < 7


def test_any_fifty_words_hold_a_chunk_that_they_alone_cut():
    rng = random.Random(3)
    for low, high in ((1, 1), (1, 3), (2, 8)):
        short = lambda n: " ".join("".join(rng.choice("ab") for _ in range(rng.randint(low, high))) for _ in range(n))  # noqa: E731, B023
        for _ in range(40):
            passage, before = short(50), [rng.randint(0, 30) for _ in range(2)]
            texts = [f"{short(n)} {passage} {short(rng.randint(0, 30))}".strip() for n in before]
            found = substring_dedup.Chunks(*block_of(texts), 50)
            w, inner = substring_dedup.spread(50), []
            for row, n in enumerate(before):
                place = found.cut[found.row[found.cut] == row] - found.first[row] - n
                inner.append(place[(place >= substring_dedup.REACH_WORDS + w - 1) & (place <= 50 - w)].tolist())
            assert inner[0] == inner[1] and len(inner[0]) > 1


def test_the_gear_hash_rolls():
    import numpy as np

    data, offsets = block_of(["first text of some length", "second"])
    at = np.array([5, 10, 20, 25, 28])
    floor = np.array([0, 0, 0, 0, 25])
    got = substring_dedup.gear(data, at, floor)
    for place, start, h in zip(at, floor, got):
        plain = 0
        for byte in data[start:place]:
            plain = (2 * plain + int(substring_dedup._GEAR[byte])) % 65536
        assert h == plain

