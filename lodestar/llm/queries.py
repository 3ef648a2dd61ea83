"""The operators as queries over the given tables, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import (
    bpe, centroids, chat, decontaminate, hmm, html_text, lexical, line_dedup, near_dedup, neighbours, substring_dedup, toxicity, voronoi,
)
from lodestar.sources.tables import read_table


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read_table(spark, sf_dir, "documents"), shingle=4)


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2k and 2k + 1 are a pair, the first of them chosen."""
    turns = read_table(spark, sf_dir, "conversations").select(
        F.floor(F.col("conv_id") / 2).alias("pair_id"), F.when(F.pmod("conv_id", F.lit(2)) == 0, "chosen").otherwise("rejected").alias("side"),
        "turn", "role", "text",
    )
    mask = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
    return chat.preference_pairs(turns).select(
        "pair_id", "n_common", "prompt", "chosen", "rejected", mask("chosen_mask").alias("chosen_mask"), mask("rejected_mask").alias("rejected_mask")
    )


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.encode(read_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, carry=["doc_id"], result="digests")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.line_dedup(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "text", "n_lines", "n_removed")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract_text(read_table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))
    scored = hmm.score_texts(read_table(spark, sf_dir, "documents"), ~held_out)
    return scored.select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    model = toxicity.fit(docs, labels.where(~held_out))
    scored = toxicity.score(docs, model, carry=["doc_id"])
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(
        read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), carry=["doc_id"]
    )
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(read_table(spark, sf_dir, "documents"), carry=["doc_id"])


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked_search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(read_table(spark, sf_dir, "embeddings"))


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voronoi.jaccard_components(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_line_dedup": op4_line_dedup,
    "op5_html_extraction": op5_html_extraction,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_toxicity": op7_toxicity,
    "op8_nearest_neighbours": op8_nearest_neighbours,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_ranked_search": op11_ranked_search,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_jaccard_join": op13_jaccard_join,
}

#: DuckDB SQL by query.
ORACLE_SQL: dict[str, str] = {}

# All pairs of sets with a common shingle, then the closure of the links.
def _components(size: int, percent: int, columns: str) -> str:
    shingle = " || ' ' || ".join(["ws[i]", *[f"ws[i + {j}]" for j in range(1, size)]])
    return rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {size} THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - {size - 2}), lambda i: {shingle}) END) AS g
  FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), f AS (
  SELECT g FROM s GROUP BY g HAVING count(*) > 1
), r AS (
  SELECT s.doc_id, s.g FROM s SEMI JOIN f USING (g)
), c AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM r x JOIN r y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL
), e AS (
  SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= {percent} * (p.n + q.n - k)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b
), m AS (
  SELECT a, min(b) AS component_id FROM reach GROUP BY a
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id{columns}
FROM documents d JOIN m ON m.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""


ORACLE_SQL["op1_minhash_near_dedup"] = _components(4, 80, ", d.doc_id = m.component_id AS kept")
ORACLE_SQL["op13_jaccard_join"] = _components(3, 90, "")

# Every score of every document and item.
ORACLE_SQL["op11_ranked_search"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS place, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws
  FROM documents
), t AS (
  SELECT place, doc_id, term, count(*) AS tf FROM (SELECT place, doc_id, unnest(ws) AS term FROM d) GROUP BY ALL
), s AS (
  SELECT count(*) AS n_docs, sum(len(ws))::BIGINT AS n_terms FROM d WHERE len(ws) > 0
), w AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM t GROUP BY term), s
), m AS (
  SELECT place, 50 + (50 * len(ws) * n_docs) // n_terms AS m FROM d, s WHERE len(ws) > 0
), q AS (
  SELECT DISTINCT item_id, term FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark)
), scored AS (
  SELECT q.item_id, t.place, any_value(t.doc_id) AS doc_id, sum(w.w * ((1000000000 * tf) // (1000 * tf + 20 * m.m)))::BIGINT AS score
  FROM q JOIN t ON t.term = q.term JOIN w ON w.term = q.term JOIN m ON m.place = t.place GROUP BY q.item_id, t.place
)
SELECT item_id, rank, doc_id, score FROM (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0
) WHERE rank <= 50
"""


# All squared distances in every round.
def _clustered(rounds: int) -> str:
    steps = [r"""
WITH kept AS (
  SELECT row_number() OVER () AS place, vec_id, list_transform(embedding, lambda x: greatest(least(floor(64 * x::DOUBLE), 134217728), -134217728)::BIGINT) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), x AS MATERIALIZED (
  SELECT place, unnest(range(64)) AS i, unnest(v) AS x FROM kept
), c0 AS MATERIALIZED (
  SELECT (h - 1)::INTEGER AS cluster, unnest(range(64)) AS i, unnest(v) AS c
  FROM (SELECT v, row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, v) AS h FROM kept) WHERE h <= 16
)"""]
    for r in range(rounds + 1):
        steps.append(rf"""a{r} AS MATERIALIZED (
  SELECT place, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS distance
  FROM (SELECT place, cluster, sum((x - c) * (x - c))::BIGINT AS d FROM x JOIN c{r} USING (i) GROUP BY place, cluster) GROUP BY place
)""")
        if r < rounds:
            steps.append(rf"""m{r} AS (
  SELECT cluster, i, sum(x)::BIGINT AS s, count(*) AS n FROM a{r} JOIN x USING (place) GROUP BY cluster, i
), c{r + 1} AS MATERIALIZED (
  SELECT cluster, i, CASE WHEN n IS NULL THEN c ELSE (s - ((s % n) + n) % n) // n END AS c FROM c{r} LEFT JOIN m{r} USING (cluster, i)
)""")
    return ",\n".join(steps) + rf""", p AS (
  SELECT cluster, sum(distance)::BIGINT AS cluster_inertia FROM a{rounds} GROUP BY cluster
), h AS (
  SELECT cluster, sha256(string_agg(c::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY cluster
)
SELECT vec_id, cluster, distance, cluster_inertia, (SELECT sum(distance)::BIGINT FROM a{rounds}) AS inertia, centroid_sha256
FROM kept JOIN a{rounds} USING (place) JOIN p USING (cluster) JOIN h USING (cluster)
"""


ORACLE_SQL["op12_centroid_clustering"] = _clustered(3)

# Exact counts of sites everywhere; the first holder keeps its line.
ORACLE_SQL["op4_line_dedup"] = r"""
WITH l AS (
  SELECT doc_id, source, md5(doc_id || '|' || text) AS k, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents
), t AS (
  SELECT doc_id, source, k, line, pos, trim(line, E' \t\r\x0b\f') AS t FROM l
), b AS (
  SELECT t FROM t WHERE t <> '' GROUP BY t HAVING count(DISTINCT source) >= 10
), m AS (
  SELECT t.doc_id, t.pos, row_number() OVER (PARTITION BY t.t ORDER BY t.doc_id, t.k, t.pos) AS place FROM t JOIN b ON b.t = t.t
), g AS (
  SELECT doc_id, pos FROM m WHERE place > 1
)
SELECT t.doc_id, coalesce(string_agg(t.line, chr(10) ORDER BY t.pos) FILTER (WHERE g.pos IS NULL), '') AS text,
  count(*) AS n_lines, count(g.pos) AS n_removed
FROM t LEFT JOIN g ON g.doc_id = t.doc_id AND g.pos = t.pos GROUP BY t.doc_id
"""

# Every window of the documents of a length that some item's window has, joined on its words.
ORACLE_SQL["op9_benchmark_decontamination"] = r"""
WITH low AS (
  SELECT 'd' AS kind, doc_id AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
  UNION ALL
  SELECT 'b', item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark
), w AS (
  SELECT kind, id, list_filter(regexp_split_to_array(t, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM low
), iw AS (
  SELECT DISTINCT id AS item_id, least(len(ws), 10) AS n, unnest(list_transform(range(1, greatest(len(ws) - 9, 1) + 1), lambda i: array_to_string(ws[i : i + 9], ' '))) AS win
  FROM w WHERE kind = 'b' AND len(ws) > 0
), dw AS (
  SELECT id AS doc_id, n, unnest(range(1, len(ws) - n + 2)) AS i, unnest(list_transform(range(1, len(ws) - n + 2), lambda i: array_to_string(ws[i : i + n - 1], ' '))) AS win
  FROM w CROSS JOIN (SELECT DISTINCT n FROM iw) WHERE kind = 'd' AND len(ws) >= n
), hit AS (
  SELECT dw.doc_id, dw.i, dw.n, iw.item_id FROM dw JOIN iw ON iw.win = dw.win AND iw.n = dw.n
), words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hit) GROUP BY doc_id
)
SELECT w.id AS doc_id, len(w.ws) AS n_words, coalesce(words.n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(words.n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN words ON words.doc_id = w.id LEFT JOIN items ON items.doc_id = w.id WHERE w.kind = 'd'
"""

# Position by position: the first turn that differs ends the prompt.
ORACLE_SQL["op2_chat_formatting"] = r"""
WITH t AS (
  SELECT conv_id // 2 AS pair_id, conv_id % 2 AS side, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
    coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), p AS (
  SELECT pair_id, least(count(*) FILTER (WHERE side = 0), count(*) FILTER (WHERE side = 1)) AS shorter FROM t GROUP BY pair_id
), d AS (
  SELECT a.pair_id, min(a.pos) AS pos FROM t a JOIN t b ON a.pair_id = b.pair_id AND a.pos = b.pos AND a.side = 0 AND b.side = 1
  WHERE a.role <> b.role OR a.text <> b.text GROUP BY a.pair_id
), c AS (
  SELECT p.pair_id, coalesce(d.pos - 1, p.shorter) AS n_common FROM p LEFT JOIN d USING (pair_id)
), r AS (
  SELECT t.*, c.n_common, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS shown FROM t JOIN c USING (pair_id)
), o AS (
  SELECT *, coalesce(sum(length(shown)) OVER (PARTITION BY pair_id, side ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM r WHERE pos > n_common
), m AS (
  SELECT pair_id,
    string_agg((off + 13 + length(role))::BIGINT || '-' || (off + length(shown))::BIGINT, ',' ORDER BY pos) FILTER (WHERE side = 0 AND role = 'assistant') AS chosen_mask,
    string_agg((off + 13 + length(role))::BIGINT || '-' || (off + length(shown))::BIGINT, ',' ORDER BY pos) FILTER (WHERE side = 1 AND role = 'assistant') AS rejected_mask
  FROM o GROUP BY pair_id
), s AS (
  SELECT pair_id, any_value(n_common) AS n_common, string_agg(shown, '' ORDER BY pos) FILTER (WHERE side = 0 AND pos <= n_common) AS prompt,
    string_agg(shown, '' ORDER BY pos) FILTER (WHERE side = 0 AND pos > n_common) AS chosen,
    string_agg(shown, '' ORDER BY pos) FILTER (WHERE side = 1 AND pos > n_common) AS rejected
  FROM r GROUP BY pair_id
)
SELECT s.pair_id, n_common::BIGINT AS n_common, coalesce(prompt, '') AS prompt, coalesce(chosen, '') AS chosen, coalesce(rejected, '') AS rejected,
  coalesce(chosen_mask, '') AS chosen_mask, coalesce(rejected_mask, '') AS rejected_mask
FROM s LEFT JOIN m ON m.pair_id = s.pair_id
"""
