"""The registered queries as SQL for DuckDB: an independent statement of the same results.

Every query is put together from common table expressions over the given tables.
"""

from __future__ import annotations

from lodestar.schemas import FACET_FIELDS

# Fixed values, stated again and not taken from the code under test: short stopword list, topics by theme.
STOPWORDS = """
a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to
was will with
""".split()
TOPICS_OF_THEME = {
    "administration": "boundaries planningcadastre location transportation",
    "economy": "economy farming",
    "environment": "biota environment elevation inlandwaters oceans climatologymeteorologyatmosphere",
    "imagery": "imagerybasemapsearthcover earthobservation;syntheticaperatureradar",
    "infrastructure": "structure transport utilitiescommunication",
    "science": "geoscientificinformation",
    "society": "health society intelligencemilitary",
}
# The long English stopword list.
LONG_STOPWORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers
herself it its itself they them their theirs themselves what which who whom this that these those am is are
was were be been being have has had having do does did doing a an the and but if or because as until while of
at by for with about against between into through during before after above below to from up down in out on
off over under again further then once here there when where why how all any both each few more most other
some such no nor not only own same so than too very s t can will just don should now i'll you'll he'll she'll
we'll they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're they're i've we've you've
they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't shouldn't
mustn't can't couldn't cannot could here's how's let's ought that's there's what's when's where's who's why's
would
""".split()

TOKEN = r"[\p{L}\p{M}\p{N}_]+(?:[''’.][\p{L}\p{M}\p{N}_]+)*"
TODAY = "DATE '2024-06-01'"


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


RAW = """
raw AS MATERIALIZED (
SELECT 'doc-' || doc_id AS id, doc_id AS id_number,
  '[[[' || x0 || ',' || y0 || '],[' || x1 || ',' || y0 || '],[' || x1 || ',' || y1 || '],[' || x0 || ',' || y1 || '],[' || x0 || ',' || y0 || ']]]' AS geometry,
  CAST(x0 AS DOUBLE) AS xmin, CAST(y0 AS DOUBLE) AS ymin, CAST(x1 AS DOUBLE) AS xmax, CAST(y1 AS DOUBLE) AS ymax,
  split_part(t, ' ', 1) || ' ' || split_part(t, ' ', 2) || ' ' || split_part(t, ' ', 3) AS title_en,
  CASE WHEN lang = 'fr' THEN split_part(t, ' ', 1) || ' ' || split_part(t, ' ', 2) END AS title_fr,
  text AS description_en,
  CASE WHEN lang = 'fr' THEN text END AS description_fr,
  split_part(t, ' ', 4) || ', ' || split_part(t, ' ', 5) AS keywords_en,
  CASE WHEN lang = 'fr' THEN split_part(t, ' ', 4) END AS keywords_fr,
  CASE doc_id % 4
    WHEN 0 THEN '[7,{"protocol":"OGC:WMS","url":"https://maps.example/wms","name":{"en":"Map"},"description":{"en":"Service;WMS;eng","fr":"Service;WMS;fra"}},{"protocol":"HTTPS","description":{"en":"Dataset;CSV;eng"}}]'
    WHEN 1 THEN '[{"protocol":" ESRI REST: Map Service ","description":{"en":"API; ESRI;eng"}},{"protocol":"HTTPS","description":{"en":"API;JSON;eng"}}]'
    WHEN 2 THEN '{"protocol":"HTTPS","description":{"en":"Dataset;CSV;eng"}}'
    ELSE CASE WHEN doc_id % 8 = 3 THEN 'not json' ELSE '[{"protocol":"HTTPS"}]' END END AS options,
  CASE WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 13 = 1 THEN '{bad'
    ELSE '[{"role":"owner","email":{"en":"x@example.org"},"organisation":{"en":"Government;Org ' || (doc_id % 11) || ' ;Branch","fr":"Gouvernement;Org F' || (doc_id % 11) || '"}}]' END AS contact,
  CASE doc_id % 5 WHEN 0 THEN '[]' WHEN 1 THEN '[null]' WHEN 2 THEN NULL
    WHEN 3 THEN '[{"organisation":{"en":"Government;Cited","fr":"Gouvernement"}}]' ELSE '{bad' END AS cited,
  CASE doc_id % 7 WHEN 0 THEN 'boundaries, society' WHEN 1 THEN 'farming' WHEN 2 THEN 'inlandWaters,oceans'
    WHEN 3 THEN 'imageryBaseMapsEarthCover' WHEN 4 THEN 'transport' WHEN 5 THEN 'unknownTopic' END AS topics,
  CASE WHEN doc_id % 10 = 0 THEN NULL ELSE (1990 + doc_id % 30) || '-0' || (1 + doc_id % 9) END AS extent_begin,
  CASE WHEN doc_id % 6 <= 1 THEN NULL ELSE (2000 + doc_id % 25) || '-02' END AS extent_end,
  CASE WHEN doc_id % 12 = 0 THEN NULL ELSE '20' || (10 + doc_id % 15) || '-01-15' END AS published,
  n_chars % 1000 AS popularity,
  CASE doc_id % 6 WHEN 2 THEN 'ccmeo-datacube' WHEN 3 THEN 'ccmeo-eodms' ELSE 'geo-ca' END AS "systemName",
  CASE doc_id % 6 WHEN 2 THEN 'rcm-ard' WHEN 3 THEN 'sentinel-1' END AS "eoCollection",
  CASE doc_id % 6 WHEN 2 THEN ['VV', 'VH'] WHEN 3 THEN ['HH'] ELSE CAST([] AS VARCHAR[]) END AS polarizations,
  CASE doc_id % 6 WHEN 2 THEN ['ascending'] WHEN 3 THEN ['descending'] ELSE CAST([] AS VARCHAR[]) END AS orbits
FROM (SELECT doc_id, lang, n_chars, text, replace(text, chr(10), ' ') AS t,
             -141 + (doc_id * 37) % 80 AS x0, 42 + (doc_id * 17) % 38 AS y0,
             -141 + (doc_id * 37) % 80 + 1 + doc_id % 9 AS x1, 42 + (doc_id * 17) % 38 + 1 + doc_id % 5 AS y1
      FROM documents) s)"""

_THEME_CASE = "CASE lower(trim(t)) " + " ".join(
    f"WHEN '{topic}' THEN '{theme}'" for theme, topics in TOPICS_OF_THEME.items() for topic in topics.split()
) + " END"


def _objects(c: str) -> str:
    return (
        f"CASE WHEN {c} IS NULL OR NOT json_valid({c}) THEN CAST([] AS JSON[]) "
        f"WHEN json_type(CAST({c} AS JSON)) = 'OBJECT' THEN [CAST({c} AS JSON)] "
        f"ELSE list_filter(CAST(json_extract({c}, '$[*]') AS JSON[]), lambda x: json_type(x) = 'OBJECT') END"
    )


def _segment(lang: str) -> str:
    name = f"json_extract_string(org_source[1], '$.organisation.{lang}')"
    return f"CASE WHEN len(string_split({name}, ';')) >= 2 THEN trim(string_split({name}, ';')[2]) END"


def _commas(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN CAST([] AS VARCHAR[]) ELSE list_transform(string_split({c}, ','), lambda x: trim(x)) END"


TAGS = """
theme_tags AS (
SELECT 'doc-' || doc_id AS uuid, CASE WHEN quality = 1 THEN 'legal' ELSE 'economy' END AS tag FROM labels
UNION ALL SELECT 'doc-' || doc_id, 'emergency' FROM labels WHERE toxic = 1),
foundational_tags AS (SELECT DISTINCT 'doc-' || doc_id AS uuid FROM labels WHERE quality = 1),
tags_per_id AS (SELECT uuid, list_sort(list(DISTINCT tag)) AS tags FROM theme_tags WHERE tag IN ('emergency', 'legal') GROUP BY uuid)"""

BASE = RAW + f""",
base AS MATERIALIZED (
SELECT * EXCLUDE (keywords_en, keywords_fr, options, org_source),
  {_commas('keywords_en')} AS keywords_en, {_commas('keywords_fr')} AS keywords_fr, {_commas('topics')} AS topic_list,
  options AS options_text,
  list_transform(options, lambda o: json_extract_string(o, '$.protocol')) AS protocols,
  list_sort(list_distinct(list_transform(list_filter(list_transform(options, lambda o: json_extract_string(o, '$.description.en')), lambda d: d IS NOT NULL), lambda d: trim(split_part(d, ';', 1))))) AS types,
  CASE WHEN len(list_filter(options, lambda o: regexp_matches(lower(json_extract_string(o, '$.protocol')), 'esri|ogc'))) > 0 THEN 'true' ELSE 'false' END AS mappable,
  {_segment('en')} AS org_en, {_segment('fr')} AS org_fr,
  CASE WHEN topics IS NULL THEN CAST([] AS VARCHAR[]) ELSE
    list_sort(list_distinct(list_filter(list_transform(string_split(topics, ','), lambda t: {_THEME_CASE}), lambda t: t IS NOT NULL))) END AS bins,
  try_strptime(extent_begin || '-01', '%Y-%m-%d')::DATE AS begin_date,
  last_day(try_strptime(extent_end || '-01', '%Y-%m-%d')::DATE) AS end_date
FROM (SELECT * REPLACE ({_objects('options')} AS options),
        {_objects('contact')} AS contact_objects, {_objects('cited')} AS cited_objects,
        CASE WHEN cited IS NULL OR cited IN ('[]', '[null]') THEN
               CASE WHEN json_valid(contact) THEN {_objects('contact')} ELSE CAST([] AS JSON[]) END
             ELSE {_objects('cited')} END AS org_source
      FROM raw))"""

CAT = BASE + "," + TAGS + """,
cat AS MATERIALIZED (
SELECT b.* EXCLUDE (bins), f.uuid IS NOT NULL AS is_foundational,
  CASE WHEN f.uuid IS NOT NULL THEN 'true' ELSE 'false' END AS foundational,
  bins || coalesce(list_filter(t.tags, lambda x: NOT list_contains(bins, x)), CAST([] AS VARCHAR[]))
       || CASE WHEN f.uuid IS NOT NULL THEN ['foundational'] ELSE CAST([] AS VARCHAR[]) END AS theme
FROM base b LEFT JOIN tags_per_id t ON t.uuid = b.id LEFT JOIN foundational_tags f ON f.uuid = b.id)"""

REQUESTS = """
requests AS MATERIALIZED (
SELECT CAST(item_id AS VARCHAR) AS req_id,
  CASE WHEN item_id % 4 = 3 THEN 'KeywordSearch' ELSE 'SemanticSearch' END AS method,
  CASE WHEN item_id % 5 = 4 THEN '' ELSE split_part(t, ' ', 1) || ' ' || split_part(t, ' ', 3) || ' ' || split_part(t, ' ', 5) END AS q,
  coalesce(CASE item_id % 3 WHEN 0 THEN '-120.0, 49.0, -100.0, 60.0' WHEN 1 THEN '' END, '') AS bbox,
  CASE item_id % 8 WHEN 0 THEN 'disjoint' WHEN 3 THEN 'within' ELSE '' END AS relation,
  CASE WHEN item_id % 6 = 1 THEN '2000' ELSE '' END AS begin_text,
  CASE WHEN item_id % 6 = 2 THEN '2015-02' ELSE '' END AS end_text,
  CASE WHEN item_id % 7 = 0 THEN 'org 1, cited' ELSE '' END AS org,
  CASE WHEN item_id % 2 = 0 THEN 'en' WHEN item_id % 9 = 1 THEN '' ELSE 'fr' END AS lang_text,
  CASE item_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'title' WHEN 2 THEN 'date' ELSE 'relevancy' END AS sort_text,
  CASE WHEN item_id % 20 = 11 THEN '5000000000' WHEN item_id % 20 = 13 THEN '99999999999999999999' WHEN item_id % 3 = 0 THEN '5'
    WHEN item_id % 3 = 1 THEN 'abc' ELSE '' END AS size_text,
  CASE WHEN item_id % 20 = 6 THEN '3000000000' WHEN item_id % 20 = 13 THEN '2147483647' WHEN item_id % 5 = 2 THEN '5' ELSE '' END AS from_text
FROM (SELECT item_id, replace(text, chr(10), ' ') AS t FROM benchmark) b),
asked AS MATERIALIZED (
SELECT *, CASE WHEN lang_text = '' THEN 'en' ELSE lang_text END AS lang,
  CASE WHEN q = '' THEN 'popularity' WHEN sort_text IN ('', 'relevancy') THEN '_score' ELSE sort_text END AS sort_by,
  CASE WHEN q <> '' AND sort_text = 'title' THEN 'asc' ELSE 'desc' END AS direction,
  least(CASE WHEN size_text IN ('', 'abc') THEN 10 ELSE CAST(size_text AS HUGEINT) END, 9223372036854775807) AS page_size,
  CASE WHEN from_text = '' THEN 0 ELSE CAST(from_text AS HUGEINT) END AS page_from,
  list_filter(list_transform(string_split(lower(org), ','), lambda v: trim(v)), lambda v: v <> '') AS orgs,
  CASE WHEN begin_text <> '' THEN DATE '2000-01-01' END AS begin_from,
  CASE WHEN end_text <> '' THEN DATE '2015-02-28' END AS end_to,
  CASE WHEN bbox <> '' THEN CASE WHEN relation = '' THEN 'intersects' ELSE relation END END AS rel,
  TRY_CAST(trim(split_part(bbox, ',', 1)) AS DOUBLE) AS w, TRY_CAST(trim(split_part(bbox, ',', 2)) AS DOUBLE) AS s,
  TRY_CAST(trim(split_part(bbox, ',', 3)) AS DOUBLE) AS e, TRY_CAST(trim(split_part(bbox, ',', 4)) AS DOUBLE) AS n
FROM requests)"""

MEETS = "(c.xmin <= {e} AND c.xmax >= {w} AND c.ymin <= {n} AND c.ymax >= {s})"
INSIDE = "(c.xmin >= {w} AND c.xmax <= {e} AND c.ymin >= {s} AND c.ymax <= {n})"
_R = {"w": "a.w", "s": "a.s", "e": "a.e", "n": "a.n"}
FILTERS = f"""
(len(a.orgs) = 0 OR len(list_filter(a.orgs, lambda v: contains(lower(coalesce(c.org_en, '')), v) OR contains(lower(coalesce(c.org_fr, '')), v))) > 0)
AND (a.begin_from IS NULL OR c.begin_date >= a.begin_from)
AND (a.end_to IS NULL OR c.end_date <= a.end_to)
AND (a.rel IS NULL OR (a.rel = 'intersects' AND {MEETS.format(**_R)}) OR (a.rel = 'disjoint' AND NOT {MEETS.format(**_R)})
     OR (a.rel = 'within' AND {INSIDE.format(**_R)}))"""

_TEXT_OF = {
    "id": "id", "title_en": "title_en", "title_fr": "title_fr", "description_en": "description_en",
    "description_fr": "description_fr", "keywords_en": "array_to_string(keywords_en, ' ')",
    "keywords_fr": "array_to_string(keywords_fr, ' ')", "topicCategory": "array_to_string(topic_list, ' ')",
    "organisation.en": "org_en", "organisation.fr": "org_fr", "systemName": '"systemName"',
}
HYBRID_BOOSTS = {
    "topicCategory": 1, "keywords_en": 5, "keywords_fr": 5, "description_en": 15, "description_fr": 15,
    "title_en": 10, "title_fr": 10, "organisation.en": 1, "organisation.fr": 1, "systemName": 1, "id": 5,
}
KEYWORD_BOOSTS = {k: 1 for k in HYBRID_BOOSTS if k != "id"}


def tokens(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '{TOKEN}')"


def bm25(boosts: dict[str, float], source: str = "cat", texts: dict[str, str] = _TEXT_OF, queries: str = "requests") -> str:
    union = " UNION ALL ".join(f"SELECT id, '{f}' AS field, {texts[f]} AS text FROM {source}" for f in boosts)
    boost = "CASE field " + " ".join(f"WHEN '{f}' THEN {float(b)!r}" for f, b in boosts.items()) + " END"
    return f"""
tok AS (SELECT id, field, unnest({tokens('text')}) AS term FROM ({union}) u),
tf AS MATERIALIZED (SELECT field, id, term, count(*) AS tf FROM tok WHERE term NOT IN ({quoted(STOPWORDS)}) GROUP BY ALL),
dl AS (SELECT field, id, sum(tf) AS dl FROM tf GROUP BY ALL),
fs AS (SELECT field, count(*) AS n_docs, avg(dl) AS avgdl FROM dl GROUP BY ALL),
df AS (SELECT field, term, count(*) AS df FROM tf GROUP BY ALL),
qt AS (SELECT q, term, count(*) AS qtf FROM (SELECT q, unnest({tokens('q')}) AS term FROM (SELECT DISTINCT q FROM {queries}) d) t
       WHERE term NOT IN ({quoted(STOPWORDS)}) GROUP BY ALL),
field_score AS (
SELECT q, id, field, sum({boost} * qtf * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
FROM qt JOIN tf USING (term) JOIN df USING (field, term) JOIN fs USING (field) JOIN dl USING (field, id) GROUP BY q, id, field),
text_score AS MATERIALIZED (SELECT q, id, max(score) AS score FROM field_score GROUP BY q, id)"""


def code(token: str) -> str:
    return f"CAST('0x' || substr(md5({token}), 1, 8) AS BIGINT) % 64"


def embedded(source: str, key: str, text: str) -> str:
    """``(key, dim, value)`` of the hashing encoder, as 32-bit floats, non-zero values only."""
    return f"""
SELECT k AS {key}, dim, CAST(CAST(value / sqrt(sum(value * value) OVER (PARTITION BY k)) AS FLOAT) AS DOUBLE) AS value
FROM (SELECT k, {code('term')} AS dim, CAST(sum(CASE WHEN substr(md5(term), 9, 1) >= '8' THEN -1 ELSE 1 END) AS DOUBLE) AS value
      FROM (SELECT {key} AS k, unnest({tokens(text)}) AS term FROM {source}) t
      WHERE term NOT IN ({quoted(STOPWORDS)}) GROUP BY ALL) b
WHERE value <> 0"""


_EMBEDDED_TEXT = "(SELECT id, title_en || chr(10) || description_en || chr(10) || 'keywords:' || array_to_string(keywords_en, ', ') AS text FROM cat)"
VEC = f"""
vec AS MATERIALIZED ({embedded(_EMBEDDED_TEXT, 'id', 'text')}),
vsize AS (SELECT id, sqrt(sum(value * value)) AS size FROM vec GROUP BY id)"""

QVEC = f"""
qvec AS MATERIALIZED ({embedded("(SELECT DISTINCT q FROM requests WHERE q <> '')", 'q', 'q')}),
qsize AS (SELECT q, sqrt(sum(value * value)) AS size FROM qvec GROUP BY q),
dots AS (SELECT q, id, sum(qvec.value * vec.value) AS dot FROM qvec JOIN vec USING (dim) GROUP BY q, id),
cosine AS MATERIALIZED (
SELECT qsize.q, vsize.id, round(coalesce(dot, 0) / (qsize.size * vsize.size), 12) AS cos
FROM qsize CROSS JOIN vsize LEFT JOIN dots ON dots.q = qsize.q AND dots.id = vsize.id),
near AS MATERIALIZED (
SELECT q, id, 1 / (2 - cos) AS score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY cos DESC, id) AS rn FROM cosine) WHERE rn <= 10)"""

FLAG = """
flag AS (SELECT 0.15 * ln(1 + (count(*) - count(*) FILTER (mappable = 'true') + 0.5) / (count(*) FILTER (mappable = 'true') + 0.5)) AS weight FROM cat)"""

_SCORE = "0.007 * coalesce(t.score, 0) + CASE WHEN c.mappable = 'true' THEN flag.weight ELSE 0 END + coalesce(k.score, 0)"


def hybrid(cut: float | None, prefilter: bool = False) -> str:
    near = "near k ON k.q = a.q AND k.id = c.id"
    extra = ""
    if prefilter:
        extra = f"""
near_in AS MATERIALIZED (
SELECT req_id, id, 1 / (2 - cos) AS score FROM (
  SELECT a.req_id, c.id, cos, row_number() OVER (PARTITION BY a.req_id ORDER BY cos DESC, c.id) AS rn
  FROM asked a JOIN cosine x ON x.q = a.q JOIN cat c ON c.id = x.id WHERE a.q <> '' AND {FILTERS}) r WHERE rn <= 10),"""
        near = "near_in k ON k.req_id = a.req_id AND k.id = c.id"
    present = "" if cut is None else f"AND {_SCORE} >= {cut}"
    return f"""
WITH {CAT}, {REQUESTS}, {bm25(HYBRID_BOOSTS)}, {VEC}, {QVEC}, {FLAG}, {extra}
matched AS MATERIALIZED (
SELECT a.req_id, c.id, {_SCORE} AS score
FROM asked a CROSS JOIN cat c CROSS JOIN flag
LEFT JOIN text_score t ON t.q = a.q AND t.id = c.id LEFT JOIN {near}
WHERE a.q <> '' AND (t.score IS NOT NULL OR k.score IS NOT NULL OR c.mappable = 'true') {present} AND {FILTERS}
UNION ALL SELECT a.req_id, c.id, NULL FROM asked a CROSS JOIN cat c WHERE a.q = '' AND {FILTERS}),
ranked AS MATERIALIZED (
SELECT m.*, a.sort_by, a.page_size, a.page_from, row_number() OVER (PARTITION BY m.req_id ORDER BY
    CASE a.sort_by WHEN '_score' THEN round(m.score, 10) WHEN 'popularity' THEN c.popularity END DESC NULLS LAST,
    CASE WHEN a.sort_by = 'title' THEN CASE WHEN a.lang = 'fr' THEN c.title_fr ELSE c.title_en END END ASC NULLS LAST,
    CASE WHEN a.sort_by = 'date' THEN c.published END DESC NULLS LAST, m.id) AS rn
FROM matched m JOIN asked a USING (req_id) JOIN cat c USING (id)),
pages AS MATERIALIZED (
SELECT req_id, CAST(rn - page_from AS BIGINT) AS row_num, id, round(score, 6) AS score,
  CASE WHEN sort_by = '_score' THEN round(score, 6) END AS relevancy
FROM ranked WHERE rn > page_from AND rn <= page_from + page_size)"""


PAGE_COLUMNS = "SELECT req_id, row_num, id, score, relevancy FROM"
KEYWORD = f"""
WITH {CAT}, {REQUESTS}, {bm25(KEYWORD_BOOSTS)},
hits AS MATERIALIZED (
SELECT req_id, row_num, id, round(score, 6) AS score, round(score, 6) AS relevancy, q FROM (
  SELECT a.req_id, a.q, t.id, t.score, row_number() OVER (PARTITION BY a.req_id ORDER BY round(t.score, 10) DESC, t.id) AS row_num
  FROM asked a JOIN text_score t USING (q)) r WHERE row_num <= 10)"""

ORACLE: dict[str, str] = {}

# --- sources ---------------------------------------------------------------------------------------
ORACLE["scan_union_dedupe"] = """
SELECT doc_id, n_chars, load_seq, note FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY load_seq DESC) AS rn FROM (
    SELECT doc_id, n_chars, CAST(0 AS BIGINT) AS load_seq, NULL AS note FROM documents
    UNION ALL SELECT doc_id, n_chars + 1, 1, 'reload' FROM documents)) WHERE rn = 1"""
ORACLE["upsert"] = """
SELECT 'doc-' || d.doc_id AS id, CAST(CASE WHEN l.doc_id IS NULL THEN n_chars % 1000 ELSE quality + 5000 END AS BIGINT) AS popularity
FROM documents d FULL JOIN labels l ON l.doc_id = d.doc_id"""
ORACLE["catalogue_load"] = """
SELECT 'doc-' || d.doc_id AS id, CAST(CASE WHEN l.doc_id IS NULL THEN n_chars % 1000 ELSE quality + 5000 END AS BIGINT) AS popularity, CAST(64 AS BIGINT) AS dim
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"""
ORACLE["upsert_repeated"] = """
SELECT 'doc-' || d.doc_id AS id, CAST(CASE WHEN l.doc_id IS NULL THEN n_chars % 1000 WHEN d.doc_id % 3 = 0 THEN 8000 ELSE 7002 END AS BIGINT) AS popularity
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"""
ORACLE["count_check"] = "SELECT count(*) AS n_rows FROM documents"
ORACLE["append_table"] = f'WITH {RAW} SELECT "systemName", 2 * count(*) AS n FROM raw GROUP BY 1'
ORACLE["clear_table"] = 'SELECT CAST(0 AS BIGINT) AS "left", count(*) AS removed FROM documents'
ORACLE["tag_scan"] = f"WITH {TAGS} SELECT uuid, tag FROM theme_tags"
ORACLE["quarantine"] = f"""
WITH {RAW} SELECT id, CASE WHEN options = 'not json' OR contact = '{{bad' THEN 'bad' ELSE 'good' END AS part FROM raw"""
ORACLE["lookup_by_id"] = f"""WITH {RAW} SELECT id, title_en, "systemName" FROM raw WHERE id = 'doc-42'"""
ORACLE["head"] = f"WITH {RAW} SELECT id, title_en FROM raw ORDER BY id LIMIT 20"
ORACLE["match_all"] = "SELECT 'doc-' || doc_id AS id FROM documents"

# --- projections -----------------------------------------------------------------------------------
ORACLE["select_sentinel_struct"] = f"WITH {RAW} SELECT id, extent_begin, extent_end, published, '' AS created FROM raw"
ORACLE["embedding_text"] = f"WITH {RAW} SELECT id, title_en || chr(10) || description_en || chr(10) || 'keywords:' || keywords_en AS text FROM raw"
ORACLE["embedding_text_bilingual"] = f"""
WITH {RAW} SELECT id, title_en || chr(10) || coalesce(title_fr, '') || chr(10) || description_en || chr(10) || coalesce(description_fr, '')
  || chr(10) || 'keywords:' || keywords_en || chr(10) || 'keywords:' || coalesce(keywords_fr, '') AS text FROM raw"""
ORACLE["null_concat"] = f"""
WITH {RAW} SELECT id, coalesce(title_en || ' ' || description_en || ' ' || keywords_en || ' ' || title_fr || ' ' || description_fr || ' ' || keywords_fr, '') AS text FROM raw"""
ORACLE["organisation_first"] = f"""
WITH {BASE} SELECT id, json_extract_string(contact_objects[1], '$.organisation.en') AS contact_en,
  json_extract_string(cited_objects[1], '$.organisation.en') AS cited_en FROM base"""
ORACLE["organisation_segment"] = f"WITH {BASE} SELECT id, org_en, org_fr FROM base"
ORACLE["source_default"] = f'WITH {RAW} SELECT id, "systemName" AS system FROM raw'
ORACLE["partial_dates"] = f"WITH {BASE} SELECT id, CAST(begin_date AS VARCHAR) AS begin_date, CAST(end_date AS VARCHAR) AS end_date FROM base"
ORACLE["mappable_flag"] = f"WITH {BASE} SELECT id, mappable FROM base"
ORACLE["resource_types"] = f"WITH {BASE} SELECT id, array_to_string(types, '|') AS types FROM base"
ORACLE["safe_json"] = f"""
WITH {RAW} SELECT id, CAST(CASE WHEN contact IS NULL OR NOT json_valid(contact) THEN 0 ELSE json_array_length(contact) END AS BIGINT) AS n_contacts FROM raw"""
ORACLE["document_projection"] = f"""
WITH {CAT} SELECT id, title_en, title_fr, published, '' AS created, '' AS language,
  array_to_string(keywords_en, '|') AS keywords_en, array_to_string(keywords_fr, '|') AS keywords_fr,
  array_to_string(topic_list, '|') AS topics, array_to_string(theme, '|') AS theme, array_to_string(types, '|') AS type,
  array_to_string(protocols, '|') AS protocols,
  CASE WHEN id_number % 4 = 0 THEN 'https://maps.example/wms' END AS option_url, CASE WHEN id_number % 4 = 0 THEN 'Map' END AS option_name,
  CASE WHEN id_number % 13 > 1 THEN 'x@example.org' END AS contact_email, CAST(len(contact_objects) AS BIGINT) AS n_contact, CAST(len(cited_objects) AS BIGINT) AS n_cited,
  mappable, foundational, CAST(popularity AS BIGINT) AS popularity, "systemName", "eoCollection",
  array_to_string(polarizations, '|') AS polarizations, array_to_string(orbits, '|') AS orbits FROM cat"""
ORACLE["polygon_build"] = f"WITH {RAW} SELECT id, 'Polygon' AS geom_type, CAST(5 AS BIGINT) AS n_points, xmin, ymin, xmax, ymax FROM raw"
ORACLE["theme_bins"] = f"WITH {BASE} SELECT id, array_to_string(bins, '|') AS themes FROM base"
ORACLE["comma_arrays"] = f"""
WITH {BASE} SELECT id, array_to_string(topic_list, '|') AS "topicCategory", array_to_string(keywords_en, '|') AS keywords_en,
  array_to_string(keywords_fr, '|') AS keywords_fr FROM base"""
ORACLE["topic_rewrite"] = f"""
WITH {RAW} SELECT id, CASE WHEN "eoCollection" = 'sentinel-1' THEN 'imageryBaseMapsEarthCover' ELSE topics END AS topic FROM raw"""
ORACLE["theme_join_append"] = f"""
WITH {BASE}, {TAGS} SELECT id, array_to_string(bins || coalesce(list_filter(tags, lambda x: NOT list_contains(bins, x)), CAST([] AS VARCHAR[])), '|') AS theme
FROM base LEFT JOIN tags_per_id ON uuid = id"""
ORACLE["foundational_flag"] = f"WITH {CAT} SELECT id, array_to_string(theme, '|') AS theme, foundational FROM cat"
ORACLE["id_override"] = f"""
WITH {BASE} SELECT b.id,
  CASE WHEN len(contact_objects) > 0 THEN CASE WHEN l.id IS NOT NULL THEN 'Override;Office' ELSE json_extract_string(contact_objects[1], '$.organisation.en') END END AS org_en,
  CASE WHEN len(contact_objects) > 0 THEN CASE WHEN l.id IS NOT NULL THEN 'Bureau' ELSE json_extract_string(contact_objects[1], '$.organisation.fr') END END AS org_fr
FROM base b LEFT JOIN (SELECT 'doc-' || doc_id AS id FROM labels WHERE toxic = 1) l ON l.id = b.id"""
ORACLE["localised_fields"] = f"""
WITH {CAT} SELECT id, coalesce(title_fr, 'Title not available in French.') AS title,
  CASE WHEN title_fr IS NULL THEN 'Description not available.' ELSE description_fr END AS description,
  CASE WHEN title_fr IS NULL THEN 'Keyword not available.' ELSE array_to_string(keywords_fr, '|') END AS keywords FROM cat"""

# --- text and vectors ------------------------------------------------------------------------------
ORACLE["tokens_standard"] = f"""
SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, array_to_string(t, ' ') AS tokens FROM (
  SELECT doc_id, list_filter({tokens('text')}, lambda x: x NOT IN ({quoted(STOPWORDS)})) AS t FROM documents)"""
_PUNCTUATION = r"""[!"#$%&''()*+,\-./:;<=>?@\[\\\]^_`{|}~]"""
_CLEAN = f"""list_filter(string_split_regex(regexp_replace(lower(text), '{_PUNCTUATION}', '', 'g'), '\\s+'),
  lambda x: x <> '' AND x NOT IN ({quoted(LONG_STOPWORDS)}))"""
ORACLE["clean_text"] = f"SELECT doc_id, array_to_string({_CLEAN}, ' ') AS clean FROM documents"


def _shape(word: str) -> str:
    """``c`` and ``v`` for the letters of a word."""
    return (
        f"list_reduce(list_concat([''], regexp_extract_all({word}, '(?s).')), "
        "lambda a, x: a || CASE WHEN x IN ('a', 'e', 'i', 'o', 'u') OR (x = 'y' AND right(a, 1) = 'c') THEN 'v' ELSE 'c' END)"
    )


def _measured(shape: str) -> str:
    return f"len(regexp_extract_all({shape}, 'v+c+'))"


def _step(name: str, source: str, expression: str) -> str:
    return f"{name} AS MATERIALIZED (SELECT word, s, {_shape('s')} AS h FROM (SELECT word, {expression} AS s FROM {source}))"


def _suffixes(rules: str, least: int, also: str = "") -> str:
    """The longest matching suffix decides; ``rules``: lines of suffix and replacement."""
    pairs = sorted((line.split() + [""] for line in rules.strip().splitlines()), key=lambda p: -len(p[0]))
    cases = " ".join(
        f"WHEN s LIKE '%{a}' THEN CASE WHEN {_measured(f'left(h, length(s) - {len(a)})')} > {least} {also if a == 'ion' else ''} "
        f"THEN left(s, length(s) - {len(a)}) || '{b}' ELSE s END"
        for a, b, *_ in pairs
    )
    return f"CASE {cases} ELSE s END"


# The suffixes of the paper's steps.
_STEP_2 = """
ational ate
tional tion
enci ence
anci ance
izer ize
abli able
alli al
entli ent
eli e
ousli ous
ization ize
ation ate
ator ate
alism al
iveness ive
fulness ful
ousness ous
aliti al
iviti ive
biliti ble
"""
_STEP_3 = """
icate ic
ative
alize al
iciti ic
ical ic
ful
ness
"""
_STEP_4 = "\n".join("al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split())
_CVC = "(right(h, 3) = 'cvc' AND right(s, 1) NOT IN ('w', 'x', 'y'))"
_CVC_CUT = "(right(left(h, length(s) - 1), 3) = 'cvc' AND right(left(s, length(s) - 1), 1) NOT IN ('w', 'x', 'y'))"
_WORDS = f"words AS (SELECT DISTINCT unnest({_CLEAN}) AS word FROM documents)"
STEMS = ", ".join([
    _WORDS,
    _step("p0", "words WHERE length(word) > 2", "word"),
    _step("p1", "p0", "CASE WHEN s LIKE '%sses' OR s LIKE '%ies' THEN left(s, length(s) - 2) WHEN s LIKE '%ss' THEN s WHEN s LIKE '%s' THEN left(s, length(s) - 1) ELSE s END"),
    f"""p2 AS MATERIALIZED (SELECT word, s, {_shape('s')} AS h, cut FROM (SELECT word,
      CASE WHEN s LIKE '%eed' THEN CASE WHEN {_measured('left(h, length(s) - 3)')} > 0 THEN left(s, length(s) - 1) ELSE s END
           WHEN cut THEN left(s, length(s) - CASE WHEN s LIKE '%ed' THEN 2 ELSE 3 END) ELSE s END AS s, cut
      FROM (SELECT *, s NOT LIKE '%eed' AND ((s LIKE '%ed' AND contains(left(h, length(s) - 2), 'v')) OR (s LIKE '%ing' AND contains(left(h, length(s) - 3), 'v'))) AS cut FROM p1)))""",
    _step("p3", "p2", f"""CASE WHEN NOT cut THEN s WHEN s LIKE '%at' OR s LIKE '%bl' OR s LIKE '%iz' THEN s || 'e'
      WHEN length(s) > 1 AND right(s, 1) = left(right(s, 2), 1) AND right(h, 1) = 'c' AND right(s, 1) NOT IN ('l', 's', 'z') THEN left(s, length(s) - 1)
      WHEN {_measured('h')} = 1 AND {_CVC} THEN s || 'e' ELSE s END"""),
    _step("p4", "p3", "CASE WHEN s LIKE '%y' AND contains(left(h, length(s) - 1), 'v') THEN left(s, length(s) - 1) || 'i' ELSE s END"),
    _step("p5", "p4", _suffixes(_STEP_2, 0)),
    _step("p6", "p5", _suffixes(_STEP_3, 0)),
    _step("p7", "p6", _suffixes(_STEP_4, 1, "AND right(left(s, length(s) - 3), 1) IN ('s', 't')")),
    _step("p8", "p7", f"""CASE WHEN s LIKE '%e' AND ({_measured('left(h, length(s) - 1)')} > 1 OR ({_measured('left(h, length(s) - 1)')} = 1 AND NOT {_CVC_CUT}))
      THEN left(s, length(s) - 1) ELSE s END"""),
    f"stems AS (SELECT word, CASE WHEN s LIKE '%ll' AND {_measured('h')} > 1 THEN left(s, length(s) - 1) ELSE s END AS stem FROM p8"
    " UNION ALL SELECT word, word FROM words WHERE length(word) <= 2)",
])
ORACLE["stem_vocabulary"] = f"WITH {STEMS} SELECT word, stem FROM stems"
ORACLE["clean_text_stemmed"] = f"""
WITH {STEMS}, t AS (SELECT doc_id, unnest(c) AS word, generate_subscripts(c, 1) AS i FROM (SELECT doc_id, {_CLEAN} AS c FROM documents))
SELECT d.doc_id, coalesce(string_agg(stem, ' ' ORDER BY i), '') AS clean FROM documents d LEFT JOIN t ON t.doc_id = d.doc_id LEFT JOIN stems USING (word) GROUP BY d.doc_id"""
_WORD = r"[\p{L}\p{M}\p{N}_]"
ORACLE["highlight"] = f"""
{KEYWORD}, words AS (SELECT q, list(term) AS terms FROM qt GROUP BY q)
SELECT req_id, h.id, array_to_string(list_transform(
    regexp_extract_all(description_en, '{TOKEN}|[^\\p{{L}}\\p{{M}}\\p{{N}}_]+'),
    lambda x: CASE WHEN list_contains(terms, lower(x)) THEN '<em>' || x || '</em>' ELSE x END), '') AS highlight
FROM hits h JOIN words USING (q) JOIN cat c ON c.id = h.id"""
_DOCS = "docs AS (SELECT 'doc-' || doc_id AS id, text FROM documents)"
_DOC_BM25 = bm25({"text": 1}, "docs", {"text": "text"})
ORACLE["bm25_stats"] = f"""
WITH {_DOCS}, {REQUESTS}, {_DOC_BM25} SELECT field, term, df, n_docs, round(avgdl, 6) AS avgdl FROM df JOIN fs USING (field)"""
ORACLE["match_single_field"] = f"WITH {_DOCS}, {REQUESTS}, {_DOC_BM25} SELECT q, id, round(score, 6) AS score FROM text_score"
ORACLE["multi_match"] = f"WITH {CAT}, {REQUESTS}, {bm25(KEYWORD_BOOSTS)} SELECT q, id, round(score, 6) AS score FROM text_score"
ORACLE["multi_match_boosted"] = f"""
WITH {CAT}, {REQUESTS}, {bm25({**KEYWORD_BOOSTS, 'keywords_en': 2, 'keywords_fr': 2, 'description_en': 1.5, 'description_fr': 1.5, 'title_en': 1.5, 'title_fr': 1.5})}
SELECT q, id, round(score, 6) AS score FROM text_score"""
_LONG = "SELECT vec_id, label, unnest(range(64)) AS dim, unnest(CAST(embedding AS DOUBLE[])) AS value, embedding[1] >= 0 AS mask FROM embeddings"
ORACLE["mean_pool"] = f"""
SELECT CAST(label AS BIGINT) AS label, dim, round(coalesce(sum(value) FILTER (mask), 0) / greatest(count(*) FILTER (mask), 1e-9), 6) AS value
FROM ({_LONG}) GROUP BY ALL"""
ORACLE["l2_normalise"] = f"""
SELECT vec_id, dim, round(value / sqrt(sum(value * value) OVER (PARTITION BY vec_id)), 6) AS value FROM (
  SELECT vec_id, dim, value * 3 AS value FROM ({_LONG}))"""
ORACLE["vector_quality"] = """
SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_null, CAST(0 AS BIGINT) AS n_null_element, CAST(64 AS BIGINT) AS min_dim, CAST(64 AS BIGINT) AS max_dim
FROM documents"""
ORACLE["embed_hashing"] = f"SELECT doc_id, dim, round(value, 6) AS value FROM ({embedded('documents', 'doc_id', 'text')})"
_CENTROIDS = f"""
pooled AS MATERIALIZED (SELECT label, list(value ORDER BY dim) AS u FROM (SELECT label, dim, avg(value) AS value FROM ({_LONG}) GROUP BY ALL) GROUP BY label),
v AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"""


def _ranked_vectors(left: str, key: str, vector: str, k: int, score: str) -> str:
    cos = f"list_dot_product(l.{vector}, v.v) / sqrt(list_dot_product(l.{vector}, l.{vector}) * list_dot_product(v.v, v.v))"
    return f"""
SELECT CAST(qid AS BIGINT) AS qid, vec_id AS id, rn, round({score}, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY cos DESC, vec_id) AS rn FROM (
    SELECT l.{key} AS qid, v.vec_id, round({cos}, 12) AS cos FROM {left} l CROSS JOIN v)) WHERE rn <= {k}"""


ORACLE["knn_exact"] = f"WITH {_CENTROIDS} {_ranked_vectors('pooled', 'label', 'u', 20, '1 / (2 - cos)')}"
ORACLE["knn_scored"] = f"WITH {_CENTROIDS} {_ranked_vectors('pooled', 'label', 'u', 10, '(1 + cos) / 2')}"
ORACLE["knn_join"] = f"WITH {_CENTROIDS} {_ranked_vectors('v', 'vec_id', 'v', 5, '1 / (2 - cos)')}"
_COS = "list_dot_product({a}, {b}) / sqrt(list_dot_product({a}, {a}) * list_dot_product({b}, {b}))"
ORACLE["knn_cells"] = f"""
WITH {_CENTROIDS}, far AS MATERIALIZED (
SELECT vec_id, label, row_number() OVER (PARTITION BY vec_id ORDER BY {_COS.format(a='u', b='v')} DESC, label) AS place FROM v CROSS JOIN pooled),
cell AS (SELECT vec_id, label FROM far WHERE place = 1)
SELECT CAST(qid AS BIGINT) AS qid, id, rn, round(1 / (2 - cos), 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY cos DESC, id) AS rn FROM (
    SELECT f.vec_id AS qid, c.vec_id AS id, round({_COS.format(a='q.v', b='w.v')}, 12) AS cos
    FROM far f JOIN cell c USING (label) JOIN v q ON q.vec_id = f.vec_id JOIN v w ON w.vec_id = c.vec_id WHERE f.place <= 6)) WHERE rn <= 5"""


def _fit(name: str, rows: str, group: str, k: str) -> str:
    """Centres of each group of ``rows(vec_id, u, r)``: the first k, then the mean of the rows nearest to each."""
    return f"""
{name}_near AS MATERIALIZED (
SELECT {group} AS g, p.u, s.r AS seed, row_number() OVER (PARTITION BY {group}, p.vec_id ORDER BY round(list_dot_product(p.u, s.u), 12) DESC, s.r) AS place
FROM {rows} p JOIN (SELECT {group} AS h, u, r FROM {rows} p WHERE r <= {k}) s ON s.h = {group}),
{name}_mean AS (
SELECT g, seed, list(x ORDER BY dim) AS x FROM (
  SELECT g, seed, dim, avg(x) AS x FROM (SELECT g, seed, unnest(range(len(u))) AS dim, unnest(u) AS x FROM {name}_near WHERE place = 1) GROUP BY ALL) GROUP BY g, seed),
{name} AS MATERIALIZED (SELECT g, seed, list_transform(x, lambda y: y / sqrt(list_dot_product(x, x))) AS c FROM {name}_mean)"""


_DRAW = "CAST(('0x' || substr(md5('{0}:' || vec_id), 1, 12)) AS BIGINT)::DOUBLE / 281474976710656"
ORACLE["knn_tree"] = f"""
WITH {_CENTROIDS}, size AS (SELECT count(*)::DOUBLE AS n, ceil(sqrt(count(*))) AS per_cell, least(ceil(pow(count(*), 0.25)), ceil(count(*) / ceil(sqrt(count(*))))) AS k FROM v),
d AS MATERIALIZED (
SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u, {_DRAW.format(0)} AS first_draw, {_DRAW.format(1)} AS draw FROM v),
pool AS MATERIALIZED (SELECT vec_id, u, k, row_number() OVER (ORDER BY first_draw, vec_id) AS r FROM d, size WHERE first_draw < 32 * k / n),
{_fit('coarse', 'pool', '0', 'p.k')},
placed AS MATERIALIZED (SELECT * FROM (
  SELECT d.*, seed AS coarse, row_number() OVER (PARTITION BY vec_id ORDER BY round(list_dot_product(u, c), 12) DESC, seed) AS place FROM d CROSS JOIN coarse) WHERE place = 1),
held AS (SELECT coarse, count(*) AS m, ceil(count(*) / any_value(per_cell)) AS k, min(draw) AS least FROM placed, size GROUP BY coarse),
own AS MATERIALIZED (
SELECT vec_id, u, coarse, k, row_number() OVER (PARTITION BY coarse ORDER BY draw, vec_id) AS r FROM placed JOIN held USING (coarse) WHERE draw < 4 * k / m OR draw = least),
{_fit('small', 'own', 'p.coarse', 'p.k')},
inside AS MATERIALIZED (SELECT * FROM (
  SELECT vec_id, coarse, seed, row_number() OVER (PARTITION BY vec_id ORDER BY round(list_dot_product(u, c), 12) DESC, seed) AS place FROM placed JOIN small ON g = coarse) WHERE place = 1),
probed AS (SELECT * FROM (
  SELECT vec_id, u, seed AS coarse, row_number() OVER (PARTITION BY vec_id ORDER BY round(list_dot_product(u, c), 12) DESC, seed) AS place
  FROM d CROSS JOIN coarse WHERE seed IN (SELECT coarse FROM held)) WHERE place <= 4),
visited AS (SELECT * FROM (
  SELECT vec_id, coarse, seed, row_number() OVER (PARTITION BY vec_id ORDER BY round(list_dot_product(u, c), 12) DESC, coarse, seed) AS place FROM probed JOIN small ON g = coarse) WHERE place <= 8)
SELECT CAST(qid AS BIGINT) AS qid, id, rn, round(1 / (2 - cos), 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY cos DESC, id) AS rn FROM (
    SELECT f.vec_id AS qid, c.vec_id AS id, round({_COS.format(a='q.v', b='w.v')}, 12) AS cos
    FROM visited f JOIN inside c USING (coarse, seed) JOIN v q ON q.vec_id = f.vec_id JOIN v w ON w.vec_id = c.vec_id)) WHERE rn <= 5"""

# --- filters ---------------------------------------------------------------------------------------
_ANY = "len(list_filter({f}, lambda x: {c})) > 0"


def _filter(condition: str) -> str:
    return f"WITH {CAT} SELECT c.id FROM cat c WHERE {condition}"


def _any(field: str, *values: str) -> str:
    tests = " OR ".join(f"lower(x) LIKE '%{v}%'" for v in values)
    return f"len(list_filter({field}, lambda x: {tests})) > 0"


ORACLE["filter_type"] = _filter(_any("types", "service", "api"))
ORACLE["filter_protocol"] = _filter(_any("protocols", "w_s", "esri"))
ORACLE["filter_theme"] = _filter(_any("theme", "environ", "econ"))
ORACLE["filter_topic_category"] = _filter(_any("topic_list", "waters"))
ORACLE["filter_org"] = _filter(_any("[org_en, org_fr]", "org 1", "cited"))
ORACLE["filter_foundational"] = _filter("foundational LIKE '%true%'")
ORACLE["filter_source_system"] = _filter(_any('["systemName"]', "ccmeo%dms", "cube"))
ORACLE["filter_mappable"] = _filter("mappable LIKE '%true%'")
ORACLE["filter_eo_collection"] = _filter(_any('["eoCollection"]', "rcm"))
ORACLE["filter_polarization"] = _filter(_any("polarizations", "vh"))
ORACLE["filter_orbit_direction"] = _filter(_any("orbits", "desc"))
ORACLE["filter_begin"] = _filter("begin_date >= DATE '2005-01-01'")
ORACLE["filter_end"] = _filter("end_date <= DATE '2015-02-28'")
ORACLE["filter_range"] = _filter("begin_date >= DATE '1995-06-01' AND end_date <= DATE '2015-12-31'")
ORACLE["filter_end_null"] = _filter("end_date IS NULL")
ORACLE["filter_end_present"] = _filter(f"end_date <= {TODAY}")
_AREA = {"w": -120, "s": 49, "e": -100, "n": 60}
ORACLE["filter_conjunction"] = _filter(
    _any("theme", "environment") + " AND mappable = 'true' AND begin_date >= DATE '2000-01-01' AND "
    + MEETS.format(w=-130, s=45, e=-80, n=75)
)
ORACLE["bbox_intersects"] = _filter(MEETS.format(**_AREA))
ORACLE["bbox_disjoint"] = _filter("NOT " + MEETS.format(**_AREA))
ORACLE["bbox_within"] = _filter(INSIDE.format(**_AREA))
ORACLE["bbox_contains"] = _filter("xmin <= -100 AND xmax >= -99 AND ymin <= 50 AND ymax >= 50.5")
ORACLE["bbox_antimeridian"] = _filter(MEETS.format(w=100, s=40, e=180, n=70) + " OR " + MEETS.format(w=-180, s=40, e=-120, n=70))
_SHAPE = MEETS.format(w=-110, s=45, e=-90, n=62)
ORACLE["polygon_intersects"] = _filter(_SHAPE)
ORACLE["keyword_and_shape"] = f"""
WITH {CAT}, {REQUESTS}, {bm25(KEYWORD_BOOSTS)} SELECT q, id, round(score, 6) AS score FROM text_score JOIN cat c USING (id) WHERE {_SHAPE}"""

# --- ranking, facets, search -----------------------------------------------------------------------


def _page(condition: str, order: str, size: int, start: int = 0) -> str:
    return f"""
WITH {CAT} SELECT rn - {start} AS row_num, id, CAST(popularity AS BIGINT) AS popularity, title_en, published FROM (
  SELECT *, row_number() OVER (ORDER BY {order}, id) AS rn FROM cat WHERE {condition}) WHERE rn > {start} AND rn <= {start + size}"""


ORACLE["browse_popularity"] = _page(_any("topic_list", "inlandwaters"), "popularity DESC NULLS LAST", 5)
ORACLE["page_2"] = _page("true", "popularity DESC NULLS LAST", 10, 10)
ORACLE["sort_title"] = _page("true", "title_en ASC NULLS LAST", 25)
ORACLE["sort_date"] = _page("true", "published DESC NULLS LAST", 25)
_FACET_VALUES = {
    "unique_mappable": "[mappable]", "unique_protocol": "protocols", "unique_org": "[org_en]",
    "unique_source_system": '["systemName"]', "unique_eo_collection": '["eoCollection"]',
    "unique_topic_category": "topic_list", "unique_theme": "theme",
}
assert set(_FACET_VALUES) == set(FACET_FIELDS)


def _facet_ranks(pairs: str, keys: str) -> str:
    """Counts per value, the first 100 values of a group, and how much the others hold."""
    group = f"PARTITION BY {keys}"
    return f"""
SELECT *, total - sum(doc_count) OVER ({group}) AS sum_other FROM (
  SELECT *, row_number() OVER ({group} ORDER BY doc_count DESC, value) AS rn, sum(doc_count) OVER ({group}) AS total FROM (
    SELECT {keys}, value, count(*) AS doc_count FROM ({pairs}) p WHERE value IS NOT NULL GROUP BY ALL)) WHERE rn <= 100"""


for _name, _values in _FACET_VALUES.items():
    _pairs = f"SELECT 1 AS k, unnest(list_distinct({_values})) AS value FROM cat"
    ORACLE["facet_" + _name.removeprefix("unique_")] = f"""
WITH {CAT} SELECT value, doc_count, CAST(sum_other AS BIGINT) AS sum_other FROM ({_facet_ranks(_pairs, 'k')})"""

ORACLE["hybrid_search"] = f"{hybrid(0.55)} {PAGE_COLUMNS} pages"
ORACLE["saved_index_search"] = ORACLE["hybrid_search"]
ORACLE["hybrid_min_score"] = f"{hybrid(0.65)} {PAGE_COLUMNS} pages"
ORACLE["hybrid_prefilter"] = f"{hybrid(0.55, True)} {PAGE_COLUMNS} pages"
_TOTALS = "SELECT a.req_id, count(m.id) AS total_hits FROM asked a LEFT JOIN matched m USING (req_id) GROUP BY a.req_id"
ORACLE["hybrid_prefilter_no_cut"] = f"{hybrid(None, True)} {_TOTALS}"
ORACLE["hybrid_no_cut"] = f"{hybrid(None)} {_TOTALS}"
ORACLE["total_hits"] = f"{hybrid(0.55)} {_TOTALS}"
_FACET_PAIRS = " UNION ALL ".join(
    f"SELECT m.req_id, '{n}' AS facet, unnest(list_distinct("
    + ("CASE WHEN a.lang = 'en' THEN [org_en] ELSE [org_fr] END" if n == "unique_org" else v)
    + ")) AS value FROM matched m JOIN cat c USING (id) JOIN asked a USING (req_id)"
    for n, v in _FACET_VALUES.items()
)
ORACLE["facets_all"] = f"""
{hybrid(0.55)} SELECT req_id, facet, value, doc_count, CAST(sum_other AS BIGINT) AS sum_other FROM ({_facet_ranks(_FACET_PAIRS, 'req_id, facet')})"""
ORACLE["flag_clause"] = f"""
WITH {CAT}, {FLAG} SELECT id, round(CASE WHEN mappable = 'true' THEN weight ELSE 0.0 END, 6) AS score FROM cat CROSS JOIN flag"""
ORACLE["keyword_search"] = f"{KEYWORD} {PAGE_COLUMNS} hits"
ORACLE["keyword_search_filtered"] = f"""
{KEYWORD} {PAGE_COLUMNS} (
  SELECT req_id, row_num, id, round(score, 6) AS score, round(score, 6) AS relevancy FROM (
    SELECT a.req_id, t.id, t.score, row_number() OVER (PARTITION BY a.req_id ORDER BY round(t.score, 10) DESC, t.id) AS row_num
    FROM asked a JOIN text_score t USING (q) JOIN cat c ON c.id = t.id WHERE {FILTERS}) r WHERE row_num <= 10)"""
_KEYWORD_PART = f"""
kw_field AS (SELECT q, id, field, score / CASE field {' '.join(f"WHEN '{f}' THEN {float(b)!r}" for f, b in HYBRID_BOOSTS.items())} END AS score
             FROM field_score WHERE field <> 'id'),
kw AS (SELECT q, id, max(score) AS score FROM kw_field GROUP BY q, id),
kw_hits AS (SELECT req_id, row_num, id, round(score, 6) AS score, round(score, 6) AS relevancy FROM (
  SELECT a.req_id, k.id, k.score, row_number() OVER (PARTITION BY a.req_id ORDER BY round(k.score, 10) DESC, k.id) AS row_num
  FROM asked a JOIN kw k USING (q) WHERE a.method <> 'SemanticSearch') r WHERE row_num <= 10)"""
ORACLE["method_dispatch"] = f"""
{hybrid(0.55)}, {_KEYWORD_PART}
{PAGE_COLUMNS} pages JOIN asked USING (req_id) WHERE method = 'SemanticSearch' UNION ALL {PAGE_COLUMNS} kw_hits"""
ORACLE["normalised_requests"] = f"""
WITH {REQUESTS} SELECT req_id, q, lang, sort_by AS sort, direction AS "order", CAST(page_size AS BIGINT) AS size, CAST(page_from AS BIGINT) AS "from",
  CASE WHEN len(orgs) > 0 THEN array_to_string(list_sort(orgs), '|') END AS f_org, CAST(begin_from AS VARCHAR) AS f_begin,
  CAST(end_to AS VARCHAR) AS f_end, rel AS f_relation, w AS west FROM asked"""
ORACLE["requests_rejected"] = f"""
WITH {REQUESTS} SELECT req_id, CASE lang_text WHEN 'en' THEN 'bbox needs west, south, east, north' ELSE 'bbox longitudes must lie in [-180, 180]' END AS reject
FROM asked WHERE lang_text <> ''"""
ORACLE["sort_columns"] = f"""
WITH {REQUESTS} SELECT req_id, CASE sort_by WHEN '_score' THEN 'score' WHEN 'date' THEN 'published' WHEN 'title' THEN 'title_en' ELSE sort_by END AS sort_column,
  direction AS "order" FROM asked"""
ORACLE["geojson_response"] = f"""
{hybrid(0.55)}
SELECT p.req_id, a.method, t.total_hits, r.returned_hits, 'FeatureCollection' AS item_type, 'Polygon' AS geometry_type, c.xmin AS west,
  p.row_num, p.id, c.title_en, c.mappable, CASE WHEN c.id_number % 4 = 0 THEN 'https://maps.example/wms' END AS option_url,
  CASE WHEN c.id_number % 13 > 1 THEN 'owner' END AS contact_role
FROM pages p JOIN asked a USING (req_id) JOIN ({_TOTALS}) t USING (req_id)
JOIN (SELECT req_id, count(*) AS returned_hits FROM pages GROUP BY req_id) r USING (req_id) JOIN cat c ON c.id = p.id"""
ORACLE["flat_response"] = f"""
{KEYWORD} SELECT req_id, row_num, relevancy, count(*) OVER (PARTITION BY req_id) AS total, h.id, title_en, "systemName"
FROM hits h JOIN cat c ON c.id = h.id"""
ORACLE["result_table"] = f"{KEYWORD} SELECT h.id AS _id, score, title_en AS title, h.id FROM hits h JOIN cat c ON c.id = h.id"

# --- logs and addresses ----------------------------------------------------------------------------
LOG = """
slow_log AS (
SELECT CASE WHEN user_id % 10 = 0 THEN 'es-test-log-stream' ELSE 'node-' || (user_id % 3) END AS stream,
  1704067200000 + event_id * 1000 AS timestamp,
  CASE WHEN event_id % 7 = 0 THEN 'slow query without body'
       WHEN event_id % 11 = 0 THEN 'took[2ms], source[{"query":{]}], id[]'
       ELSE 'took[2ms], source[{"query":{"bool":{"must":[{"term":{"k":1}},{"match_all":{"_name":"' || event_type || '"}}]}},"size":10}], id[]' END AS message
FROM events),
parsed AS (
SELECT stream, strftime(epoch_ms(timestamp), '%Y-%m-%dT%H:%M:%S') AS timestamp,
  CASE WHEN json_valid(body) THEN CAST(json_extract(body, '$.query.bool.must') AS VARCHAR) END AS filters_applied,
  CASE WHEN json_valid(body) THEN list_filter(json_extract_string(body, '$.query.bool.must[*].match_all._name'), lambda x: x IS NOT NULL)[1] END AS search_string
FROM (SELECT *, nullif(regexp_extract(message, 'source\\[(\\{.*\\})\\]', 1), '') AS body FROM slow_log))"""
ORACLE["slow_log_parse"] = f"WITH {LOG} SELECT stream, timestamp, filters_applied, search_string FROM parsed"
ORACLE["log_streams"] = f"WITH {LOG} SELECT stream, max(timestamp) AS last_event FROM slow_log GROUP BY stream"
ORACLE["log_time_window"] = f"""
WITH {LOG} SELECT stream, timestamp FROM slow_log
WHERE timestamp BETWEEN epoch_ms(TIMESTAMP '2024-01-01 01:30:00') AND epoch_ms(TIMESTAMP '2024-01-01 02:30:00')"""
ORACLE["log_stream_exclude"] = f"WITH {LOG} SELECT stream, timestamp FROM slow_log WHERE stream NOT IN ('es-test-log-stream', 'cust-test-log-stream')"
_ETL = f"WITH {LOG} SELECT timestamp, filters_applied, search_string FROM parsed WHERE stream <> 'es-test-log-stream'"
ORACLE["log_etl_batch"] = _ETL
ORACLE["log_etl_stream"] = _ETL
_LATE = LOG.replace("AS body FROM slow_log", "AS body FROM late").replace("parsed AS (", """late AS (
SELECT DISTINCT stream, CASE WHEN timestamp % 5000 <> 0 THEN timestamp END AS timestamp, message FROM slow_log WHERE stream <> 'es-test-log-stream'),
parsed AS (""")
ORACLE["log_etl_late"] = f"WITH {_LATE} SELECT timestamp, filters_applied, search_string FROM parsed"
PLACES = """
client AS (
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '10.1.' || (user_id % 256) || '.7' ELSE '10.0.' || (user_id % 256) || '.' || (event_id % 256) END AS ip FROM events),
blocks AS (
SELECT 167772160 + n * 4096 AS start_ip, 167772160 + n * 4096 + 4095 AS end_ip, 'C' || n AS country_name,
  CASE WHEN n <> 3 THEN 40.5 + n END AS lat, CASE WHEN n <> 3 THEN -70.25 - n END AS lon FROM (SELECT CAST(n_nationkey AS BIGINT) AS n FROM nation)
UNION ALL SELECT 167772160, 167772160 + 65535, 'WIDE', 0, 0
UNION ALL SELECT 167837696, 167837696 + 65535, 'FWD', 1, 1),
placed AS (
SELECT event_id, ip, country_name, CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon FROM (
  SELECT c.*, b.country_name, b.lat, b.lon, row_number() OVER (PARTITION BY event_id ORDER BY end_ip - start_ip, start_ip) AS rn
  FROM (SELECT *, CAST(split_part(ip, '.', 1) AS BIGINT) * 16777216 + CAST(split_part(ip, '.', 2) AS BIGINT) * 65536
               + CAST(split_part(ip, '.', 3) AS BIGINT) * 256 + CAST(split_part(ip, '.', 4) AS BIGINT) AS num FROM client) c
  LEFT JOIN blocks b ON c.num BETWEEN b.start_ip AND b.end_ip) WHERE rn = 1)"""
ORACLE["client_address"] = f"WITH {PLACES} SELECT event_id, ip FROM client"
ORACLE["geo_point"] = f"WITH {PLACES} SELECT start_ip, end_ip, CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon FROM blocks"
ORACLE["ip_to_place"] = f"WITH {PLACES} SELECT event_id, ip, country_name, lat, lon FROM placed"
ORACLE["request_log"] = f"""
WITH {PLACES}, {REQUESTS}
SELECT req_id, strftime(epoch_ms(1704067200000 + event_id * 1000), '%Y-%m-%d %H:%M:%S') AS ts, lang, q,
  CASE WHEN q = '' THEN 'popularity' ELSE sort_text END AS sort_param, '' AS order_param, org AS organization_filter, relation,
  CAST(page_size AS BIGINT) AS size, CAST(page_from AS BIGINT) AS "from", country_name AS country, lat
FROM asked JOIN placed ON req_id = CAST(event_id AS VARCHAR)"""

# --- evaluation ------------------------------------------------------------------------------------
JUDGED = """
judged AS MATERIALIZED (SELECT CAST(item_id AS VARCHAR) AS req_id, 'doc-' || doc_id AS id FROM (
  SELECT item_id, CASE item_id % 10 WHEN 3 THEN split_part(text, ' ', 2) || ' ' || split_part(text, ' ', 3) WHEN 4 THEN split_part(text, ' ', 2)
    WHEN 5 THEN substr(text, 2, 2) ELSE text END AS passage FROM benchmark) b JOIN documents d ON passage <> '' AND contains(d.text, passage))"""
ORACLE["judged_pairs"] = f"WITH {JUDGED} SELECT req_id, id FROM judged"
_RANKS = f"""
WITH {_DOCS}, {REQUESTS}, {JUDGED}, {_DOC_BM25},
top AS (SELECT * FROM (SELECT r.req_id, t.id, row_number() OVER (PARTITION BY r.req_id ORDER BY round(t.score, 10) DESC, t.id) AS rank
                       FROM requests r JOIN text_score t USING (q)) WHERE rank <= 5),
first_hit AS (SELECT req_id, min(rank) AS rank FROM top JOIN judged USING (req_id, id) GROUP BY req_id)"""
ORACLE["mrr_at_5"] = f"{_RANKS} SELECT round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr FROM requests LEFT JOIN first_hit USING (req_id)"
ORACLE["acc_at_5"] = f"{_RANKS} SELECT round(avg(CASE WHEN rank IS NULL THEN 0.0 ELSE 1.0 END), 6) AS acc FROM requests LEFT JOIN first_hit USING (req_id)"
_SUMMARY = """count(value) AS n, round(avg(value), 6) AS mean, round(stddev(value), 6) AS std, round(min(value), 6) AS min,
  round(quantile_disc(value, 0.25), 6) AS q25, round(quantile_disc(value, 0.5), 6) AS q50, round(quantile_disc(value, 0.75), 6) AS q75, round(max(value), 6) AS max"""
ORACLE["summary"] = f"""
SELECT "column", {_SUMMARY} FROM (
  SELECT 'popularity' AS "column", CAST(n_chars % 1000 AS DOUBLE) AS value FROM documents
  UNION ALL SELECT 'n_chars', CAST(length(text) AS DOUBLE) FROM documents) GROUP BY "column\""""
