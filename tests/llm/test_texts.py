"""BPE, decontamination, extraction, chat formatting, the language model and the classifier."""

import base64
import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from lodestar.llm import bpe, chat, decontaminate, hmm, html_text, queries, toxicity

DOCS = "doc_id bigint, text string"


def table(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


# --- encoding -----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def test_ids_are_those_of_the_library(spark, ranks):
    rng = random.Random(4)
    texts = ["", None, "a", "  ", "\n\n \t x", "A" * 3000, "ab" * 700, "<|endoftext|>", "日本語" * 200, "😀" * 100, "\x00\x01é́", "don't we'll 12345  x"]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x80, 0x800), rng.randrange(0x4E00, 0x9FFF)])) for _ in range(rng.randrange(1, 300))) for _ in range(40)]
    texts += ["".join(rng.choice("abcdeinorst") for _ in range(rng.randrange(1, 1500))) for _ in range(40)]
    table_ = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table_, special_tokens={})
    docs = table(spark, list(enumerate(texts))).withColumn("n_tokens", F.lit("old"))
    encoded = bpe.encode(docs, ranks, public_tokenizers.PATTERN)
    got = {r.doc_id: r for r in bpe.decode(encoded, ranks, public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(texts):
        assert got[i].token_ids == own.encode_ordinary(t or "") and got[i].n_tokens == len(got[i].token_ids)
        assert bytes(got[i].decoded) == (t or "").encode()
    assert bpe.encode(table(spark, []), ranks, public_tokenizers.PATTERN).count() == 0


def test_bounded_memory_gives_the_same_ids(ranks, monkeypatch):
    rng = random.Random(5)
    text = sentence(rng, 3000)
    want = bpe.Codec.of(ranks, public_tokenizers.PATTERN).encode(text).tolist()
    monkeypatch.setattr(bpe, "MEMORY", 50)
    monkeypatch.setattr(bpe, "PIECES", 64)
    monkeypatch.setattr(bpe, "LONG", 4)
    small = bpe.Codec({base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}, public_tokenizers.PATTERN)
    assert small.encode(text).tolist() == want


# --- decontamination ----------------------------------------------------------------------------------


def naive_hits(text, items, size):
    words = decontaminate.normal_words((text or "").encode())
    hit, found = set(), set()
    for item, body in items:
        own = decontaminate.normal_words((body or "").encode())
        windows = [own[i : i + size] for i in range(len(own) - size + 1)] if len(own) >= size else [own] if own else []
        for w in windows:
            for i in range(len(words) - len(w) + 1):
                if words[i : i + len(w)] == w:
                    hit.update(range(i, i + len(w)))
                    found.add(item)
    return len(words), len(hit), sorted(str(x) for x in found if x is not None)


@pytest.mark.parametrize("max_chars", [decontaminate.MAX_CHARS, 200])
def test_windows_match_a_plain_search(spark, max_chars):
    rng = random.Random(6)
    items = [(i, sentence(rng, rng.randint(1, 25))) for i in range(10)] + [(11, None), (12, ""), (13, "!!"), (None, sentence(rng, 12)), (3, sentence(rng, 14))]
    rows = []
    for k in range(40):
        body = items[rng.randrange(10)][1].split()
        part = body[rng.randrange(0, 3) :]
        rows.append((k, f"{sentence(rng, rng.randint(0, 9))}, {'-'.join(part).upper()}. {sentence(rng, 5)} É {items[13][1] if k % 7 == 0 else ''}"))
    rows += [(50, None), (51, ""), (52, "..."), (1, rows[1][1]), (None, items[0][1])]
    docs = table(spark, rows).withColumn("items", F.lit("old"))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.decontaminate(docs, bench, max_chars=max_chars).collect()
    assert len(got) == len(rows)
    want = sorted((i if i is not None else -1, *naive_hits(t, items, 10)) for i, t in rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_hit, r.items) for r in got) == want
    for r in got:
        words = [w for s in r.spans for w in decontaminate.normal_words(r.text[s.start : s.end].encode())]
        assert len(words) == r.n_hit


def test_spans_can_be_removed_and_tables_be_empty(spark):
    docs = table(spark, [(1, "é one two three four end"), (2, None)])
    bench = spark.createDataFrame([(1, "Two, three")], "item_id bigint, text string")
    marked = decontaminate.decontaminate(docs, bench)
    assert {r.doc_id: r.text for r in decontaminate.remove_spans(marked).collect()} == {1: "é one  four end", 2: None}
    assert decontaminate.decontaminate(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.decontaminate(docs.limit(0), bench).count() == 0


# --- extraction ---------------------------------------------------------------------------------------

LONG = "A paragraph, with commas, that is long enough to be taken for prose, and then a little more of it."


@pytest.mark.parametrize("page, text", [
    ("", ""),
    ("<html><body><nav><a href=x>Home</a></nav></body></html>", ""),
    ("plain words only", "plain words only"),
    (f"<body><header><h1>Site</h1></header><article><h1>T &amp; U</h1><p>{LONG}<p>Two<br>lines &lt;x&gt; &am</article><footer>f</footer>", f"T & U\n\n{LONG}\n\nTwo lines <x> &am"),
    (f"<article><p>{LONG}</p><div class='reader-comments'><p>{LONG}</p></div><aside>x</aside><p>short</p>", f"{LONG}\n\nshort"),
    (f"<body class=has-sidebar><div id=cookie-notice>{LONG}</div><div class=post><h2>T</h2><p>{LONG}</p><p>b</p></div><div class=sidebar><p>{LONG}</p></div></body>", f"T\n\n{LONG}\n\nb"),
    (f"<div class=ad><p>{LONG}</p></div><main><section><p>{LONG} 1</p></section><section><p>{LONG} 2</p></section></main>", f"{LONG} 1\n\n{LONG} 2"),
    (f"<script>var a='<p>{LONG}</p>'</script><style>p{{}}</style><p>{LONG}<!-- {LONG}", LONG),
    (f"<form><p>{LONG}</p></form><div><p>{LONG}</p><ul><li>one<li>two</ul></div>", f"{LONG}\n\none\n\ntwo"),
    (f"<div class='menu'><article><p>{LONG}</p></article></div>", LONG),
    ("<article><p>tiny</p></article><footer>foot</footer>", "tiny"),
])
def test_pages(page, text):
    assert html_text.extract(page) == text


@pytest.mark.parametrize("page, text", [
    (f"<article class='post category-social tag-search'><h2 id=related-work>R</h2><p>{LONG}</p></article>", f"R\n\n{LONG}"),
    (f"<body><article><p>{LONG}</p><section id=discussion><h2>D</h2><p>{LONG} 2</p></section><p class=notice>N</p></article>", f"{LONG}\n\nD\n\n{LONG} 2\n\nN"),
    (f"<body><section id=related-work><h2 class=banner>R</h2><p>{LONG}</p><p class=notice>N</p></section>", f"R\n\n{LONG}\n\nN"),
    (f"<article><p>{LONG} <a class=related href=x>see</a> <span class=tag-search>this</span></p><ol class=references><li><a href=a>One</a><li><a href=b>Two</a></ol><div><a href=c>Three</a></div>",
     f"{LONG} see this\n\nOne\n\nTwo\n\nThree"),
    (f"<article><p>{LONG}</p><div class='share-bar'>s</div><ul class=related-posts><li>r</ul><div id=comments>c</div><section class=newsletterSignup>n</section><div class='alert'>a</div>", LONG),
    *((f"<article><p>{LONG}</p><{tag} class='{name}'>placed</{tag}><p>end</p></article>", f"{LONG}\n\nend") for tag in ("p", "div") for name in ("ad", "advertisement", "x cookie-notice", "Sponsored")),
    *((f"<article><p>{LONG}</p><div class={name}>placed</div><p class={name}>end</p></article>", f"{LONG}\n\nend") for name in ("notice", "banner", "alert")),
    (f"<div><p>{LONG}</p><p>an <span class=ad>placed</span> word</p><p class=ad-hoc>ad hoc</p></div>", f"{LONG}\n\nan word\n\nad hoc"),
    (f"<article><p>{LONG}</p></article><div class=comments><article class=comment><p>c</p></article></div>", LONG),
    (f"<article><p>{LONG}</p><div class=related-posts><article><p>{LONG} 2</p></article></div></article>", LONG),
    *((f"<div><p>{LONG}</p><{tag} a=b><p>{LONG} 2</p><{tag}>x</{tag}><p>end</p></div>", f"{LONG}\n\n{LONG} 2\n\nend") for tag in ("svg", "iframe", "select", "object")),
    (f"<div><p>{LONG}</p><svg><svg>a</svg>b</svg><p>end</p><script>var a = 1; <p>{LONG}</p>", f"{LONG}\n\nend"),
])
def test_names_drop_no_article_text(page, text):
    assert html_text.extract(page) == text


def test_many_unclosed_elements_take_no_longer():
    assert html_text.extract("<svg>" * 100_000 + f"<p>{LONG}</p>") == LONG


@pytest.mark.parametrize("page", [
    f"<div><p>{LONG}" * 50_000, "<a>" * 50_000 + f"<div>{LONG}</p></div>" * 10_000, "<ul><li>" * 50_000 + f"<p>{LONG}", "<div>" * 50_000 + "</span></p></li>" * 50_000 + LONG,
    "<div>" * 30_000 + f"<main><p>{LONG}</p></main>" * 10_000, "<table><tr><td>" * 30_000 + LONG, f"<body><div></body><p>{LONG}</div>" * 20_000, f"<section><h2>T<p>{LONG}</section></p>" * 20_000,
])
def test_time_grows_with_the_page(page):
    start = time.process_time()
    html_text.extract(page)
    assert time.process_time() - start < 15


def extract_plainly(page):
    """The same rules, every sum and search done over again for each element."""
    h = html_text
    found = h.blocks(h.parse(page))
    nodes, top = {}, None
    chain = lambda n: [n, *chain(n.parent)] if n is not None else []
    for node, _, _ in found:
        for n in chain(node):
            nodes[id(n)] = n
            top = n
    if top is None:
        return ""
    below = lambda n: [(len(t), k) for node, t, k in found if any(x is n for x in chain(node))]
    density = lambda n: sum(k for _, k in below(n)) / max(sum(c for c, _ in below(n)), 1)

    def points(n):
        total = 0.0
        for node, t, k in found:
            if len(t) >= 25 and node.tag not in h.HEADINGS and 2 * k <= len(t):
                first = chain(node)[1:] if node.tag in ("p", "pre", "blockquote", "li", "td", "dd") else chain(node)
                for level, up in enumerate(first[: h.LEVELS]):
                    if up is n:
                        total += (1 + sum(t.count(c) for c in ",、،，") + min(len(t) // 100, 3)) / (1 if level == 0 else 2 if level == 1 else 3 * level)
        return total

    value = lambda n: points(n) * (1 - density(n)) * (1.25 if n.names & h.GOOD or n.tag in ("article", "main") else 1)
    order = {}
    for node, t, k in found:
        if len(t) >= 25 and node.tag not in h.HEADINGS and 2 * k <= len(t):
            for up in chain(node)[1:] if node.tag in ("p", "pre", "blockquote", "li", "td", "dd") else chain(node):
                order.setdefault(id(up), up)
    best = max(order.values(), key=value) if order else next((n for n, _, _ in found if n.tag in ("article", "main")), top)
    whole = next((n for n in chain(best) if n.tag == "article"), None) or next((n for n in chain(best) if n.tag == "main"), None)
    if whole is not None:
        kept = [(h._only_article(whole) or whole) if whole.tag != "article" else whole]
    else:
        kept = [best]
        for other in best.parent.children if best.parent is not None else []:
            if isinstance(other, str) or other is best or other.dropped:
                continue
            size = sum(c for c, _ in below(other))
            prose = other.tag in ("p", "pre", "blockquote", "ul", "ol", "table", "figure") and density(other) < 0.25 and (size >= 80 or other.tag == "p" and size > 0)
            if id(other) in order and value(other) >= max(2.0, 0.2 * value(best)) or prose or other.tag in h.HEADINGS and density(other) < 0.5:
                kept.append(other)
    out = []
    for node, t, k in found:
        up = next((n for n in chain(node) if any(n is x for x in kept)), None)
        loose = up is not None and up.tag in ("html", "body") and node.tag in ("li", "div", "ul", "nav")
        if up is not None and not (loose and k and 10 * k >= 9 * len(t)):
            out.append(t)
    return "\n\n".join(out)


def test_scores_are_those_of_plain_sums():
    rng = random.Random(12)
    tags = ["div", "div", "section", "p", "p", "ul", "li", "h2", "a", "span", "article", "main", "td", "table", "body", "blockquote"]
    names = ["", "", "", " class=content", " class=comments", " class='ad'", " id=sidebar", " class=post"]
    for _ in range(300):
        page = []
        for _ in range(rng.randint(1, 40)):
            tag = rng.choice(tags)
            page.append(rng.choice([f"<{tag}{rng.choice(names)}>", f"</{tag}>", f"{sentence(rng, rng.randint(1, 30))}, ", f"<p>{LONG}</p>", "<a href=x>link text</a>"]))
        page = "".join(page)
        assert html_text.extract(page) == extract_plainly(page), page


def test_pages_cut_anywhere_do_not_fail():
    page = f"<html><body><div class=\"x'y\"><p title=\"a>b\">{LONG}</p><table><tr><td>a<td>b</table><p>{LONG}</p></div></body></html>"
    for n in range(len(page)):
        html_text.extract(page[:n])
    assert html_text.extract("<div>" * 20_000 + LONG) == LONG
    assert html_text.extract("<p>" + "word " * 300_000).count("word") == 300_000


def test_pages_table(spark):
    pages = spark.createDataFrame([(1, "u", f"<p>{LONG}"), (1, "u", f"<p>{LONG}"), (2, None, None), (None, "v", "")], "page_id bigint, url string, html string")
    out = html_text.extract_text(pages.withColumn("text", F.lit("old")))
    assert out.columns == ["page_id", "url", "text"]
    assert sorted((r.page_id or 0, r.text) for r in out.collect()) == [(0, ""), (1, LONG), (1, LONG), (2, "")]
    assert html_text.extract_text(pages.limit(0)).count() == 0


# --- preference pairs ---------------------------------------------------------------------------------


def test_preference_pairs(spark):
    rows = [
        (1, "chosen", 0, "system", "s"), (1, "chosen", 1, "user", "q"), (1, "chosen", 2, "assistant", "good é"),
        (1, "rejected", 5, "system", "s"), (1, "rejected", 6, "user", "q"), (1, "rejected", 7, "assistant", "bad"), (1, "rejected", 8, "user", "?"),
        (2, "chosen", 0, "user", "a"), (3, "chosen", 0, "user", "a"), (3, "rejected", 0, "user", "a"),
        (4, "chosen", None, None, None), (4, "rejected", None, "", ""), (4, "rejected", None, "", ""),
        (5, "chosen", 0, "assistant", "x"), (5, "rejected", 0, "user", "x"),
        (None, "chosen", 0, "user", "a"), (6, "other", 0, "user", "a"),
    ]
    turns = spark.createDataFrame(rows, "pair_id bigint, side string, turn bigint, role string, text string").withColumn("prompt", F.lit(1))
    got = {r.pair_id: r for r in chat.preference_pairs(turns).collect()}
    assert set(got) == {1, 2, 3, 4, 5}
    show = lambda role, text: f"<|im_start|>{role}\n{text}<|im_end|>\n"
    assert got[1].prompt == show("system", "s") + show("user", "q") and got[1].n_common == 2
    assert got[1].chosen == show("assistant", "good é") and got[1].rejected == show("assistant", "bad") + show("user", "?")
    assert [got[1].chosen[m.start : m.end] for m in got[1].chosen_mask] == ["good é<|im_end|>\n"]
    assert [got[1].rejected[m.start : m.end] for m in got[1].rejected_mask] == ["bad<|im_end|>\n"]
    assert (got[2].n_common, got[2].prompt, got[2].rejected, got[2].chosen_mask) == (0, "", "", [])
    assert got[3].n_common == 1 and got[3].chosen == got[3].rejected == ""
    assert got[4].n_common == 1 and got[4].rejected == show("", "")
    assert got[5].n_common == 0 and len(got[5].chosen_mask) == 1 and got[5].rejected_mask == []
    assert chat.preference_pairs(turns.limit(0)).count() == 0


def test_preference_pairs_use_expressions_only(spark, sf):
    pairs = queries.op2_chat_formatting(spark, sf)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
    assert plan.count("Exchange hashpartitioning") == 1


# --- language model -----------------------------------------------------------------------------------


def model_of(rng, states, classes):
    norm = lambda x: x / x.sum(-1, keepdims=True)
    return hmm.Model(norm(rng.random(states)), norm(rng.random((states, states))), norm(rng.random((states, classes))).T)


def naive_log(model, sequence):
    state, total = model.start * model.emit[sequence[0]], 0.0
    for s in sequence[1:]:
        size = state.sum()
        total, state = total + math.log(size), (state / size) @ model.move * model.emit[s]
    return total + math.log(state.sum())


def test_forward_is_exact(monkeypatch):
    monkeypatch.setattr(hmm, "SEGMENT", 16)
    rng = np.random.default_rng(2)
    model = model_of(rng, 4, 9)
    texts = [rng.integers(0, 9, n).astype(np.int16) for n in (1, 2, 5, 31, 32, 33, 34, 48, 49, 50, 700, 1)]
    got = hmm.log_likelihood(model, texts)
    assert np.allclose(got, [naive_log(model, t) for t in texts], rtol=1e-10)
    # All sequences of one length sum to one.
    every = [np.array([a, b, c], np.int16) for a in range(9) for b in range(9) for c in range(9)]
    assert abs(np.exp(hmm.log_likelihood(model, every)).sum() - 1) < 1e-9


def test_baum_welch_counts_are_those_of_whole_texts(monkeypatch):
    """Expected counts of one round against a plain forward-backward pass over each whole text, long ones too."""
    import types

    import pyarrow as pa

    monkeypatch.setattr(hmm, "SEGMENT", 16)
    rng = np.random.default_rng(4)
    model = model_of(rng, 3, hmm.CLASSES)
    texts = [rng.integers(1, hmm.CLASSES, n).astype(np.int16) for n in (0, 1, 2, 30, 31, 32, 33, 47, 48, 64, 65, 500)]
    emissions, moves, starts = np.zeros((hmm.CLASSES, 3)), np.zeros((3, 3)), np.zeros(3)
    for text in texts:
        x = np.append(text, 0)
        alpha = [model.start * model.emit[x[0]]]
        alpha[0] /= alpha[0].sum()
        for symbol in x[1:]:
            now = alpha[-1] @ model.move * model.emit[symbol]
            alpha.append(now / now.sum())
        beta = np.ones(3)
        for t in range(len(x) - 1, -1, -1):
            share = alpha[t] * beta / (alpha[t] * beta).sum()
            emissions[x[t]] += share
            if t:
                both = alpha[t - 1][:, None] * model.move * (model.emit[x[t]] * beta)[None, :]
                moves += both / both.sum()
                beta = model.move @ (model.emit[x[t]] * beta)
                beta /= beta.sum()
            else:
                starts += share
    batch = pa.RecordBatch.from_arrays([pa.array([t.tobytes() for t in texts], pa.binary())], ["symbols"])
    (got,) = hmm._expected(types.SimpleNamespace(value=model))(iter([batch]))
    rows = np.stack([got.column(f"s{k}").to_numpy() for k in range(3)], 1)
    assert np.allclose(rows[: hmm.CLASSES], emissions, atol=1e-4)
    assert np.allclose(rows[hmm.CLASSES : hmm.CLASSES + 3], moves, rtol=1e-4)
    assert np.allclose(rows[hmm.CLASSES + 3], starts, rtol=1e-4) and abs(starts.sum() - len(texts)) < 1e-9


def test_language_model_scores(spark):
    rng = random.Random(9)
    vocabularies = [[sentence(rng, 1) + end for _ in range(60)] for end in ("ing", "tion", "é")]
    rows = [(i, " ".join(rng.choice(vocabularies[i % 3]) for _ in range(rng.randint(5, 60)))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, "Unseen words HERE"), (0, rows[0][1]), (None, rows[1][1]), (203, " ".join(rng.choice(vocabularies[0]) for _ in range(5000)))]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    training = ~F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))
    got = hmm.score_texts(table(spark, rows).withColumn("row", F.lit(1)).withColumn("score", F.lit("x")), training, rounds=4).collect()
    tokens = lambda t: [*(t or "").encode().lower().split(), "end"]
    c = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    base = lambda t: sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t))
    want = sorted((i if i is not None else -1, held(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(base(t), 6)) for i, t in rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, not r.training, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    known = [r for r in got if r.n_tokens > 10]
    assert sum(r.score for r in known) > sum(r.base_score for r in known) + 0.2 * sum(r.n_tokens for r in known)


def test_language_model_without_training(spark):
    got = hmm.score_texts(table(spark, [(1, "a b"), (2, None)]), F.lit(False), rounds=1).collect()
    assert {r.n_tokens: (r.base_score, r.n_known, r.train_tokens) for r in got} == {3: (0.0, 0, 0), 1: (0.0, 0, 0)}
    assert all(np.isfinite(r.score) for r in got)
    assert hmm.score_texts(table(spark, []), F.lit(True), rounds=1).count() == 0


# --- toxicity -----------------------------------------------------------------------------------------


def test_classifier_separates_held_out_texts(spark):
    rng = random.Random(10)
    rows, labels = [], []
    for i in range(400):
        words, toxic = sentence(rng, rng.randint(20, 120)).split(), i % 5 == 0
        for _ in range(rng.randint(2, 5) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["scum", "Idiot,", "worthlessly", "vequxx"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    rows += [(900, None), (901, ""), (902, "x " * 100_000), (3, rows[3][1]), (None, "scum idiot scum idiot")]
    labels += [(None, 1), (3, None), (5, 0), (5, 1)]
    marks = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    docs = table(spark, rows).withColumn("score", F.lit("old"))
    model = toxicity.fit(docs, marks.where("doc_id % 4 <> 0"))
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows)
    held = [(r.score, r.doc_id % 5 == 0) for r in got if r.doc_id is not None and r.doc_id < 400 and r.doc_id % 4 == 0]
    assert all((s >= 0.5) == t for s, t in held)
    assert all(0 <= r.score <= 1 for r in got)
    empty = {r.doc_id: r.score for r in got if r.doc_id in (900, 901)}
    assert empty[900] == empty[901] < 0.5


def plain_features(text):
    """Distinct buckets of the 3- to 6-byte runs of a text, one run at a time."""
    t = toxicity
    folded = b" " + b" ".join(text.encode().lower().split()) + b" "
    out = set()
    for size in t.SIZES:
        for i in range(len(folded) - size + 1):
            h = 0
            for j, byte in enumerate(folded[i : i + size]):
                h = (h + (byte * 0x9E3779B1 & 0xFFFFFFFF) * int(t._WEIGHTS[j])) & 0xFFFFFFFF
            h = ((h ^ h >> 15) * (0x2C1B3C6D + 2 * (size - 1))) & 0xFFFFFFFF
            out.add(h >> 32 - t.LOG_BUCKETS)
    return out


def test_weights_are_those_of_plain_counts(spark):
    """Log-count ratios by counting each text, and a fit whose slope vanishes there; a bound on features takes the first texts by hash."""
    rng = random.Random(31)
    rows, labels = [], []
    for i in range(120):
        words = sentence(rng, rng.randint(5, 30)).split()
        if i % 3 == 0:
            words.insert(rng.randrange(len(words)), rng.choice(["vile", "nasty"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 3 == 0)))
    marks, docs = spark.createDataFrame(labels, "doc_id bigint, toxic int"), table(spark, rows)
    features = [plain_features(t) for _, t in rows]
    seen = np.zeros(1 << toxicity.LOG_BUCKETS, bool)
    for (_, t), own in zip(rows, features):
        assert set(toxicity._features(np.frombuffer(t.encode(), np.uint8), seen).tolist()) == own

    def check(model, chosen):
        n = [sum(labels[i][1] == k for i in range(120)) for k in (0, 1)]
        every = [Counter(f for i in range(120) if labels[i][1] == k for f in features[i]) for k in (0, 1)]
        ratio = {f: math.log((every[1][f] + 1) / (n[1] + 2)) - math.log((every[0][f] + 1) / (n[0] + 2)) for f in every[0] | every[1] if every[0][f] + every[1][f] >= toxicity.MIN_TEXTS}
        ratio = {f: r for f, r in ratio.items() if abs(r) >= toxicity.MIN_RATIO}
        assert set(np.flatnonzero(model.weights)) <= set(ratio)
        order = sorted(ratio)
        r = np.array([ratio[f] for f in order])
        x = np.array([[f in features[i] for f in order] for i in chosen], float) * r
        y = np.array([labels[i][1] for i in chosen], float)
        w = model.weights[order] / r
        error = 1 / (1 + np.exp(-(x @ w + model.bias))) - y
        slope = x.T @ error / len(y) + toxicity.RIDGE / len(y) * w
        assert np.abs(slope).max() < 2e-3 and abs(error.mean()) < 2e-3
        return order

    order = check(toxicity.fit(docs, marks), range(120))
    drawn = [r.doc_id for r in marks.orderBy(F.xxhash64("doc_id")).collect()]
    sizes = np.cumsum([sum(f in features[i] for f in order) for i in drawn])
    check(toxicity.fit(docs, marks, max_features=int(sizes[60])), drawn[:61])


def test_classifier_without_a_second_class(spark):
    docs = table(spark, [(1, "a b c"), (2, None)])
    marks = spark.createDataFrame([(1, 0)], "doc_id bigint, toxic int")
    assert all(r.score < 0.5 for r in toxicity.score(docs, toxicity.fit(docs, marks)).collect())
    assert all(r.score == 0.5 for r in toxicity.score(docs, toxicity.fit(docs, marks.limit(0))).collect())
    assert toxicity.score(docs.limit(0), toxicity.fit(docs, marks)).count() == 0
