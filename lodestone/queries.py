"""Queries over the given tables for the library's own operators, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geometry, text
from .operators import analysis, anchors, blocks, brief, catalog, context, dedup, export, generation, parse, qa, register, search, spans
from .plans import adapters as A
from .schema import HEURISTIC_QUESTION, NO_NOTES, NOTE_TEMPLATE, OUTLINE_LABEL, violations
from .sources import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# The adapters again, in SQL.
_STATUS = "['unread','reading','read','recheck'][doc_id % 4 + 1]"
_SRC = f"""src AS (SELECT doc_id, 'd' || doc_id AS id, left(split_part(text, chr(10), 1), 80) AS title, '["' || source || '"]' AS authors, lang, sha256(text) AS content_hash,
  {_STATUS} AS reading_status, left(text, 150) AS one_line_summary, '{A.STARTED}' AS updated_at, e.last_opened_at
  FROM documents LEFT JOIN (SELECT user_id, strftime(max(ts), '%Y-%m-%dT%H:%M:%S+00:00') AS last_opened_at FROM events WHERE event_type = 'view' GROUP BY user_id) e ON e.user_id = doc_id)"""
_TAGS = "tags AS (SELECT 'd' || doc_id AS source_id, unnest([source, lang]) AS name FROM documents)"
_KN = f"""kn AS (SELECT 'k' || d.doc_id AS id, 'd' || (d.doc_id - d.doc_id % 10) AS source_id,
  CASE WHEN toxic = 1 THEN 'questions' WHEN d.doc_id % 3 = 0 THEN 'method' WHEN d.doc_id % 3 = 1 THEN 'insights' ELSE 'own thoughts' END AS section_key,
  CASE WHEN d.doc_id % 2 = 0 THEN left(text, 30) END AS title, left(text, 120) AS content, CASE WHEN quality = 1 THEN 'user' ELSE 'auto_extract' END AS origin,
  CASE WHEN toxic = 1 THEN 'open_question' ELSE 'fact' END AS info_type, d.doc_id::DOUBLE AS sort_order, '{A.STARTED}' AS created_at, '2024-01-' || lpad((d.doc_id % 28 + 1)::VARCHAR, 2, '0') AS updated_at
  FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"""
_QU = "qu AS (SELECT 'c' || conv_id || '-' || turn AS id, 'd' || conv_id AS source_id, text AS question_text, lpad(turn::VARCHAR, 6, '0') AS created_at FROM conversations WHERE role = 'user')"
_AN = """an AS (SELECT 'c' || conv_id || '-' || turn AS id, 'c' || conv_id || '-' || asked AS question_id, text AS content FROM
  (SELECT *, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS asked FROM conversations WHERE role <> 'system') WHERE role = 'assistant' AND asked IS NOT NULL)"""
_BL = """bl AS (SELECT doc_id, 'v' || doc_id AS version_id, (i - 1)::BIGINT AS idx, CASE WHEN (i - 1) % 7 = 0 THEN 'heading' ELSE 'para' END AS kind,
  CASE WHEN (i - 1) % 7 = 0 THEN ((i - 1) % 3 + 1)::INT END AS level, l[i] AS text FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))"""
_UP, _LOW = text._UPPER, text._LOWER


def _fold(x: str) -> str:
    return f"translate({x}, '{_UP}', '{_LOW}')"


def _like(x: str, q: str) -> str:
    return f"coalesce({_fold(x)} LIKE '%{q.lower()}%', false)"


def _snip(x: str, q: str, width: int = 60) -> str:
    at = f"(instr(lower({x}), '{q}') - 1)"
    end = f"least(length({x}), greatest(0, {at} - {width // 2}) + {width})"
    begin = f"greatest(0, {end} - {width})"
    trim = lambda s: f"trim({s}, ' ' || chr(9) || chr(10) || chr(13))"
    return f"CASE WHEN coalesce({x}, '') = '' THEN '' WHEN {at} < 0 THEN {trim(f'left({x}, {width})')} ELSE {trim(f'substr({x}, {begin} + 1, {end} - {begin})')} END"


def _hay(t: str, o: str, q: str) -> str:
    return f"CASE WHEN coalesce(contains(lower({t}), '{q}'), false) AND {t} <> '' THEN {t} ELSE coalesce({o}, '') END"


def query(name: str, sql: str | None = None):
    """Register a query, and its SQL where SQL can express it."""

    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


def _long(*cols: str):
    return [F.col(c).cast("long").alias(c) for c in cols]


# --- search ---
_Q = "haon"


@query(
    "cross_search",
    f"""WITH {_SRC}, {_KN}, {_QU}, {_AN}, hits AS (
  SELECT 0 AS kind_rank, 'source' AS kind, id AS source_id, title AS source_title, {_hay("title", "one_line_summary", _Q)} AS h, id AS ref_id FROM src WHERE {_like("title", _Q)} OR {_like("one_line_summary", _Q)}
  UNION ALL SELECT 1, 'knowledge', s.id, s.title, {_hay("k.title", "k.content", _Q)}, k.id FROM kn k JOIN src s ON s.id = k.source_id WHERE {_like("k.title", _Q)} OR {_like("k.content", _Q)}
  UNION ALL SELECT 2, 'question', s.id, s.title, q.question_text, q.id FROM qu q JOIN src s ON s.id = q.source_id WHERE {_like("q.question_text", _Q)}
  UNION ALL SELECT 3, 'answer', s.id, s.title, a.content, a.id FROM an a JOIN qu q ON q.id = a.question_id JOIN src s ON s.id = q.source_id WHERE {_like("a.content", _Q)})
SELECT kind_rank, kind, source_id, source_title, {_snip("h", _Q)} AS snippet, ref_id FROM hits ORDER BY kind_rank, ref_id LIMIT 50""",
)
def cross_search(spark, sf):
    return search.cross_search(A.sources(spark, sf, False), A.knowledge(spark, sf), A.questions(spark, sf), A.answers(spark, sf), _Q)


@query(
    "in_document_search",
    f"""WITH {_BL}, h AS (SELECT doc_id, idx FROM bl WHERE contains(lower(regexp_replace(text, '[ \\t\\r]+', ' ', 'g')), 'the and'))
SELECT doc_id, idx, row_number() OVER w AS hit, coalesce(lead(idx) OVER w, min(idx) OVER (PARTITION BY doc_id)) AS next_idx, coalesce(lag(idx) OVER w, max(idx) OVER (PARTITION BY doc_id)) AS prev_idx FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY idx)""",
)
def in_document_search(spark, sf):
    return search.in_document(A.blocks(spark, sf), "The  AND")


# --- library ---
_LIB = f"""WITH {_SRC}, {_TAGS}, {_KN}, {_QU} SELECT s.id, s.title, s.reading_status,
  (SELECT count(*) FROM kn k WHERE k.source_id = s.id AND k.origin <> 'auto_extract') AS knowledge_count,
  (SELECT count(*) FROM kn k WHERE k.source_id = s.id AND k.info_type = 'open_question') AS open_question_count,
  (SELECT count(*) FROM qu WHERE qu.source_id = s.id) AS question_count,
  (SELECT string_agg(name, ',' ORDER BY name) FROM (SELECT DISTINCT name FROM tags t WHERE t.source_id = s.id)) AS tags, coalesce(s.last_opened_at, s.updated_at) AS order_at FROM src s"""


def _library(spark, sf, **kw):
    return catalog.library(A.sources(spark, sf), A.knowledge(spark, sf), A.questions(spark, sf), A.source_tags(spark, sf), **kw)


@query("library_list", _LIB)
def library_list(spark, sf):
    return _library(spark, sf).orderBy(F.desc("order_at"), "id")


@query("library_filter_q", f"{_LIB} WHERE {_like('s.title', 'thea')} OR {_like('s.authors', 'thea')} OR {_like('s.one_line_summary', 'thea')}")
def library_filter_q(spark, sf):
    return _library(spark, sf, q="THEa")


@query("library_filter_status", f"{_LIB} WHERE s.reading_status = 'reading'")
def library_filter_status(spark, sf):
    return _library(spark, sf, status="reading")


@query("library_filter_tag", f"{_LIB} WHERE s.id IN (SELECT source_id FROM tags WHERE name = 'fr')")
def library_filter_tag(spark, sf):
    return _library(spark, sf, tag="fr")


@query("tag_options", f"WITH {_TAGS} SELECT DISTINCT name FROM tags")
def tag_options(spark, sf):
    return catalog.tag_options(A.source_tags(spark, sf))


_TEMPLATE = "template AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{k}', '{v}')" for i, (k, v) in enumerate(NOTE_TEMPLATE)) + ") t(ord, key, label))"


@query(
    "note_view",
    f"""WITH {_SRC}, {_KN}, {_TEMPLATE}, g AS (SELECT source_id, section_key, string_agg(id, ',' ORDER BY sort_order, created_at, id) AS items, count(*) AS n FROM kn GROUP BY ALL)
SELECT s.id AS source_id, t.ord, t.key, t.label, coalesce(g.items, '') AS items, coalesce(g.n, 0) AS n FROM src s, template t LEFT JOIN g ON g.source_id = s.id AND g.section_key = t.key
UNION ALL SELECT source_id, 99, section_key, section_key, items, n FROM g WHERE section_key NOT IN (SELECT key FROM template) AND source_id IN (SELECT id FROM src)""",
)
def note_view(spark, sf):
    return catalog.note_view(A.sources(spark, sf, False), A.knowledge(spark, sf))


@query(
    "note_digest",
    f"""WITH {_SRC}, {_KN}, {_TEMPLATE}, k AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY updated_at DESC, id DESC) AS n FROM kn),
l AS (SELECT source_id, n, '- [' || coalesce(t.label, section_key) || '] ' || replace(left(CASE WHEN coalesce(title, '') <> '' THEN title ELSE content END, 120), chr(10), ' ') AS line FROM k LEFT JOIN template t ON t.key = section_key WHERE n <= 12)
SELECT s.id AS source_id, coalesce(string_agg(line, chr(10) ORDER BY n), '{NO_NOTES}') AS digest FROM src s LEFT JOIN l ON l.source_id = s.id GROUP BY s.id""",
)
def note_digest(spark, sf):
    return context.note_digest(A.sources(spark, sf, False), A.knowledge(spark, sf))


def _saved_items(spark, sf):
    """Every third answer has been kept in the notes; one in six with another question's id."""
    a = A.answers(spark, sf).withColumn("h", F.length("content"))
    kept = a.filter("h % 3 = 0").select(F.col("id").alias("answer_id"), F.when(F.col("h") % 6 == 0, F.lit("other")).otherwise(F.col("question_id")).alias("question_id"))
    return A.knowledge(spark, sf).select("id", "question_id", "answer_id").unionByName(kept.select(F.concat(F.lit("s"), "answer_id").alias("id"), "question_id", "answer_id"))


@query(
    "question_list_saved",
    f"WITH {_QU}, {_AN} SELECT q.id AS question_id, q.source_id, q.question_text, a.id AS answer_id, a.content AS answer, CASE WHEN a.id IS NOT NULL THEN length(a.content) % 3 = 0 AND length(a.content) % 6 <> 0 END AS saved FROM qu q LEFT JOIN an a ON a.question_id = q.id",
)
def question_list_saved(spark, sf):
    return catalog.question_list(A.questions(spark, sf), A.answers(spark, sf), _saved_items(spark, sf))


@query(
    "question_answers",
    f"WITH {_QU}, {_AN} SELECT q.id AS question_id, q.source_id, q.question_text, a.id AS answer_id, a.content AS answer, CASE WHEN a.id IS NOT NULL THEN false END AS saved FROM qu q LEFT JOIN an a ON a.question_id = q.id",
)
def question_answers(spark, sf):
    return catalog.question_list(A.questions(spark, sf), A.answers(spark, sf), A.knowledge(spark, sf))


@query("cascade_delete", f"WITH {_KN} SELECT id, source_id FROM kn WHERE source_id NOT IN (SELECT 'd' || doc_id FROM documents WHERE doc_id % 4 = 0)")
def cascade_delete(spark, sf):
    gone = table(spark, sf, "documents").filter("doc_id % 4 = 0").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"))
    return catalog.cascade_delete({"knowledge": A.knowledge(spark, sf)}, gone)["knowledge"].select("id", "source_id")


@query(
    "item_patch",
    f"WITH {_KN} SELECT id, section_key, CASE WHEN sort_order % 6 = 0 THEN 'new' ELSE title END AS title, CASE WHEN sort_order % 3 = 0 THEN content ELSE content END AS content, CASE WHEN origin = 'user' AND sort_order % 3 = 0 THEN 'llm_edited' WHEN origin = 'user' THEN 'llm' ELSE origin END AS origin FROM kn",
)
def item_patch(spark, sf):
    items = A.knowledge(spark, sf).withColumn("origin", F.when(F.col("origin") == "user", "llm").otherwise(F.col("origin")))
    patches = items.filter(F.col("sort_order") % 3 == 0).select("id", F.lit(None).cast("string").alias("section_key"), F.when(F.col("sort_order") % 6 == 0, "new").alias("title"), "content", F.lit(None).cast("string").alias("info_type"), F.lit(None).cast("string").alias("verification"))
    return catalog.patched_items(items, patches).select("id", "section_key", "title", "content", "origin")


@query("source_retag", f"WITH {_TAGS} SELECT source_id, name FROM tags WHERE source_id NOT IN (SELECT 'd' || doc_id FROM documents WHERE doc_id % 5 = 0) UNION ALL SELECT 'd' || doc_id, unnest(['x', lang]) FROM documents WHERE doc_id % 5 = 0")
def source_retag(spark, sf):
    p = table(spark, sf, "documents").filter("doc_id % 5 = 0").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("source_id"), F.array(F.lit(" x "), F.lit(""), "lang", F.lit("x")).alias("tags"))
    return catalog.retagged(A.source_tags(spark, sf), p)


@query("section_neighbours", f"WITH {_KN} SELECT id, lag(id) OVER w AS prev_id, lead(id) OVER w AS next_id FROM kn WINDOW w AS (PARTITION BY source_id, section_key ORDER BY sort_order, id)")
def section_neighbours(spark, sf):
    return catalog.neighbours(A.knowledge(spark, sf), ["source_id", "section_key"], [F.col("sort_order"), F.col("id")]).select("id", "prev_id", "next_id")


@query("sort_order_append", f"WITH {_KN} SELECT 'n' || doc_id AS id, coalesce((SELECT max(sort_order) FROM kn WHERE source_id = 'd' || (doc_id - doc_id % 10) AND section_key = 'method'), 0) + row_number() OVER (PARTITION BY doc_id - doc_id % 10 ORDER BY doc_id) AS sort_order FROM documents")
def sort_order_append(spark, sf):
    new = table(spark, sf, "documents").select(F.concat(F.lit("n"), F.col("doc_id").cast("string")).alias("id"), F.concat(F.lit("d"), (F.col("doc_id") - F.col("doc_id") % 10).cast("string")).alias("source_id"), F.lit("method").alias("section_key"), F.col("doc_id").alias("seq"))
    return catalog.next_order(A.knowledge(spark, sf), new).select("id", "sort_order")


@query("translate_cache", "SELECT 'd' || doc_id AS source_id, doc_id::VARCHAR AS block_id, CASE WHEN doc_id % 2 = 0 THEN 'known ' || doc_id ELSE upper(left(source, 3)) END AS translated_text, doc_id % 2 = 0 AS cached FROM documents")
def translate_cache(spark, sf):
    d = table(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("source_id"), F.col("doc_id").cast("string").alias("block_id"), "source", "doc_id")
    known = d.filter("doc_id % 2 = 0").select("source_id", "block_id", F.concat(F.lit("known "), "block_id").alias("translated_text"), F.lit("t").alias("updated_at"))
    return catalog.translated(d, known, F.upper(F.left("source", F.lit(3))))


# --- duplicates and identity ---
@query("exact_duplicates", "SELECT sha256(text) AS content_hash, 'd' || min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark, sf):
    d = table(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.min("doc_id").alias("m"), F.count("*").alias("n")).filter("n > 1")
    return d.select("content_hash", F.concat(F.lit("d"), F.col("m").cast("string")).alias("first_id"), "n")


_PAGE_URL = "regexp_replace(url, '[?#].*$', '')"


@query(
    "duplicate_groups",
    f"""WITH k AS (SELECT 'd' || doc_id AS id, 'content_hash' AS key_type, sha256(text) AS key FROM documents
  UNION SELECT 'w' || page_id, 'url', url FROM pages UNION SELECT 'w' || page_id, 'url', {_PAGE_URL} FROM pages)
SELECT key_type, key, min(id) AS first_id, count(*) AS n FROM k GROUP BY key_type, key HAVING count(*) > 1""",
)
def duplicate_groups(spark, sf):
    none = F.lit(None).cast("string")
    cols = ["id", "content_hash", "doi", "arxiv_id", "url", "canonical_url"]
    d = A.sources(spark, sf, False).select(*cols)
    w = table(spark, sf, "pages").select(F.concat(F.lit("w"), F.col("page_id").cast("string")).alias("id"), none.alias("content_hash"), none.alias("doi"), none.alias("arxiv_id"), "url", F.regexp_replace("url", "[?#].*$", "").alias("canonical_url"))
    return dedup.duplicate_groups(d.unionByName(w))


_TK = "trim(regexp_replace(lower({}), '[^a-z0-9_]+', ' ', 'g'))"


@query(
    "identity_match",
    f"""WITH s AS (SELECT 'd' || doc_id AS id, {_TK.format("source || ' ' || doc_id % 50")} AS tk, 2000 + doc_id % 5 AS year, {_TK.format("source")} AS names, CASE WHEN doc_id % 7 = 0 THEN '10.1234/' || doc_id % 100 ELSE '' END AS dk, sha256(text) AS hk FROM documents),
i AS (SELECT 'i' || doc_id AS i, {_TK.format("source || ' ' || doc_id % 60")} AS tk, 2000 + doc_id % 3 AS year, {_TK.format("source")} AS names, CASE WHEN doc_id % 14 = 0 THEN '10.1234/' || doc_id % 100 ELSE '' END AS dk, CASE WHEN doc_id % 11 = 0 THEN sha256(text) ELSE '' END AS hk FROM documents),
h AS (SELECT i, 1 AS p, id, i.dk AS a, s.dk AS b FROM i JOIN s ON i.hk = s.hk AND i.hk <> '' UNION ALL SELECT i, 2, id, i.dk, s.dk FROM i JOIN s ON i.dk = s.dk AND i.dk <> ''
  UNION ALL SELECT i, 4, id, i.dk, s.dk FROM i JOIN s ON i.tk = s.tk AND i.year = s.year AND i.names = s.names UNION ALL SELECT i, 5, id, i.dk, s.dk FROM i JOIN s ON i.tk = s.tk),
g AS (SELECT i, p, count(*) AS n, count(*) FILTER (a <> '' AND b <> '' AND a <> b) AS c, min(id) AS sid FROM h GROUP BY i, p),
m AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY i ORDER BY p) = 1)
SELECT i.i AS identity_id, CASE WHEN p IS NULL THEN 'unmatched' WHEN n = 1 THEN 'matched' ELSE 'ambiguous' END AS status, ['content_hash','doi','arxiv_id','title_authors_year','title'][p] AS method,
  CASE WHEN p <= 3 THEN 'strong' WHEN p IS NOT NULL THEN 'weak' END AS strength, coalesce(n, 0) AS n_candidates, coalesce(c, 0) AS contradictions, CASE WHEN p <= 3 AND n = 1 AND c = 0 THEN sid END AS source_id, NOT coalesce(p <= 3 AND n = 1 AND c = 0, false) AS manual_selection_required
FROM i LEFT JOIN m ON m.i = i.i""",
)
def identity_match(spark, sf):
    d, none = table(spark, sf, "documents"), F.lit(None).cast("string")

    def make(prefix, name, many, years, dois, hash_):
        return d.select(F.concat(F.lit(prefix), F.col("doc_id").cast("string")).alias(name), F.concat("source", F.lit(" "), (F.col("doc_id") % many).cast("string")).alias("title"), F.array("source").alias("authors"), (2000 + F.col("doc_id") % years).alias("year"), F.when(F.col("doc_id") % dois == 0, F.concat(F.lit("https://doi.org/10.1234/"), (F.col("doc_id") % 100).cast("string"))).alias("doi"), none.alias("arxiv_id"), hash_)

    s = make("d", "id", 50, 5, 7, F.sha2("text", 256).alias("content_hash"))
    i = make("i", "identity_id", 60, 3, 14, F.when(F.col("doc_id") % 11 == 0, F.sha2("text", 256)).alias("source_hash"))
    return dedup.identity_match(i, s, key=text.ascii_title_key)


@query("identity_match_unicode")
def identity_match_unicode(spark, sf):
    d, none = table(spark, sf, "documents"), F.lit(None).cast("string")
    title = F.substring_index("text", "\n", 1)
    i = d.select(F.concat(F.lit("i"), F.col("doc_id").cast("string")).alias("identity_id"), F.upper(title).alias("title"), F.array("source").alias("authors"), F.lit(2020).alias("year"), none.alias("doi"), none.alias("arxiv_id"), none.alias("source_hash"))
    s = d.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), title.alias("title"), F.array("source").alias("authors"), F.lit(2020).alias("year"), none.alias("doi"), none.alias("arxiv_id"), none.alias("content_hash"))
    return dedup.identity_match(i, s)


# --- parsing ---
@query("doc_lines", "SELECT doc_id, (i - 1)::BIGINT AS pos, l[i] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE NOT (i = len(l) AND l[i] = '')")
def doc_lines(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.posexplode(text.lines(F.col("text"))).alias("pos", "line")).select("doc_id", F.col("pos").cast("long").alias("pos"), "line")


_MD = r"""md AS (SELECT doc_id, i - 1 AS pos, m[i] AS line FROM (SELECT doc_id, m, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, string_split(string_agg(
    ['# ', '', '## ', '- ', '> ', '', '1. ', '### '][(idx + doc_id) % 8 + 1] || text || CASE WHEN idx % 5 = 4 THEN chr(10) || chr(10) || '```' || chr(10) || 'code x' || chr(10) || '```' ELSE '' END, chr(10) ORDER BY idx), chr(10)) AS m FROM bl GROUP BY doc_id))),
m1 AS (SELECT *, regexp_matches(line, '^(```|~~~)') AS fence, sum(CASE WHEN regexp_matches(line, '^(```|~~~)') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS fences FROM md),
m2 AS (SELECT *, CASE WHEN fence AND fences % 2 = 0 THEN 'close' WHEN fence THEN 'open' WHEN fences % 2 = 1 THEN 'code' WHEN regexp_matches(line, '^#{1,6}\s+') THEN 'heading'
  WHEN regexp_matches(line, '^[-*+] ') OR regexp_matches(line, '^\d+\.\s') THEN 'list' WHEN line LIKE '>%' THEN 'quote' WHEN trim(line) = '' THEN 'blank' ELSE 'para' END AS k FROM m1),
m3 AS (SELECT *, max(CASE WHEN k IN ('open', 'heading', 'list', 'quote') OR (k = 'para' AND before <> 'para') THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM (SELECT *, coalesce(lag(k) OVER (PARTITION BY doc_id ORDER BY pos), '') AS before FROM m2)),
mb AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY b) - 1)::BIGINT AS idx, CASE WHEN k = 'open' THEN 'code' ELSE k END AS kind, level, text FROM (
  SELECT doc_id, b, arg_min(k, pos) AS k, max(CASE WHEN k = 'heading' THEN length(regexp_extract(line, '^#{1,6}')) END)::INT AS level,
    coalesce(string_agg(CASE k WHEN 'heading' THEN trim(regexp_extract(line, '^#{1,6}\s+(.*)$', 1)) WHEN 'list' THEN trim(regexp_replace(line, '^[-*+ ]+', '')) WHEN 'quote' THEN trim(regexp_replace(line, '^[> ]+', '')) WHEN 'para' THEN trim(line) WHEN 'code' THEN line END,
      CASE WHEN k = 'para' THEN ' ' ELSE chr(10) END ORDER BY pos) FILTER (k NOT IN ('open', 'close')), '') AS text FROM m3 WHERE k <> 'blank' GROUP BY doc_id, b))"""
_MD = _MD.replace("CASE WHEN k = 'para' THEN ' ' ELSE chr(10) END ORDER BY pos", "'\x01' ORDER BY pos").replace("SELECT doc_id, (row_number()", "SELECT doc_id, (row_number()").replace("level, text FROM (\n", "level, replace(text, '\x01', CASE WHEN k = 'para' THEN ' ' ELSE chr(10) END) AS text FROM (\n").replace("'\x01'", "chr(1)")


@query("doc_blocks", f"WITH {_BL}, {_MD} SELECT doc_id, idx, kind, level, text FROM mb")
def doc_blocks(spark, sf):
    return parse.markdown_blocks(A.markdown_docs(spark, sf))


@query("doc_title", f"WITH {_BL}, {_MD} SELECT d.doc_id, coalesce((SELECT arg_min(text, idx) FROM mb WHERE mb.doc_id = d.doc_id AND kind = 'heading'), (SELECT left(arg_min(text, idx), 80) FROM mb WHERE mb.doc_id = d.doc_id), 'Untitled') AS title FROM documents d")
def doc_title(spark, sf):
    d = A.markdown_docs(spark, sf)
    return parse.titles(d, parse.markdown_blocks(d))


@query("html_blocks")
def html_blocks(spark, sf):
    return parse.html_blocks(table(spark, sf, "pages"))


@query("html_metadata")
def html_metadata(spark, sf):
    return parse.html_metadata(table(spark, sf, "pages")).withColumn("authors", F.array_join("authors", ", "))


def _spans(spark, sf):
    """Positioned spans: the whole lines of documents, broken between words at 60 characters, on as many two-column pages of sixteen lines as they need."""
    cut = lambda x: F.regexp_extract_all(x, F.lit(r"(?s)\S.{0,59}(?!\S)|\S+"), F.lit(0))
    parts = F.transform(F.split("text", "\n", -1), lambda x, i: F.transform(F.when(x.rlike(r"\S"), cut(x)).otherwise(F.array(F.lit(""))), lambda t, j: F.struct((((i % 8) == 0) & (j == 0)).alias("big"), t.alias("text"))))
    b = table(spark, sf, "documents").select("doc_id", F.posexplode(F.flatten(parts)).alias("at", "part"))
    n = F.col("at") % 16
    x0 = F.when(n < 8, 50.0).otherwise(320.0)
    y0 = 80.0 + (n % 8) * 20.0
    return b.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("source_id"), (F.col("at") / 16).cast("int").alias("p"), n.cast("int").alias("n"), "part.text", x0.alias("x0"), y0.alias("y0"), "part.big").select(
        "source_id", (F.col("p") + 1).alias("page"), F.lit(612.0).alias("page_width"), F.lit(792.0).alias("page_height"), F.col("n").alias("block_no"), F.lit(0).alias("line_no"), F.lit(0).alias("span_no"), "text", F.when(F.col("big"), 18.0).otherwise(10.0).alias("size"), "x0", "y0", (F.col("x0") + 230.0).alias("x1"), (F.col("y0") + 11.0).alias("y1"))


@query("span_blocks")
def span_blocks(spark, sf):
    return spans.span_blocks(_spans(spark, sf)).withColumn("rect", F.array_join("rect", ","))


@query("span_metadata")
def span_metadata(spark, sf):
    info = table(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("source_id"), F.lit(None).cast("string").alias("title"), F.concat_ws("; ", "source", "lang").alias("author"))
    return spans.span_metadata(spans.span_blocks(_spans(spark, sf)), info).withColumn("authors", F.array_join("authors", ", "))


@query("register_texts", f"WITH {_BL}, {_MD}, md0 AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS content FROM md GROUP BY doc_id) SELECT CASE WHEN doc_id % 3 = 0 THEN 'markdown' ELSE 'text' END AS type, coalesce((SELECT arg_min(text, idx) FROM mb WHERE mb.doc_id = m.doc_id AND kind = 'heading'), CASE WHEN doc_id % 3 = 0 THEN doc_id || '.md' END, (SELECT left(arg_min(text, idx), 80) FROM mb WHERE mb.doc_id = m.doc_id)) AS title, sha256(content) AS content_hash, (SELECT count(*) FROM mb WHERE mb.doc_id = m.doc_id) AS n_blocks FROM md0 m WHERE doc_id % 4 <> 0")
def register_texts(spark, sf):
    d = A.markdown_docs(spark, sf).select("doc_id", F.when(F.col("doc_id") % 4 == 0, " ").otherwise(F.col("text")).alias("content"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).alias("filename"), F.lit(None).cast("string").alias("title"))
    r = register.texts(d, at=F.lit("t"))
    n = r.blocks.groupBy(F.col("source_id").alias("_s")).agg(F.count("*").alias("n_blocks"))
    return r.sources.join(n, F.col("id") == F.col("_s"), "left").select("type", "title", "content_hash", F.coalesce("n_blocks", F.lit(0)).cast("long").alias("n_blocks"))


@query("register_pages")
def register_pages(spark, sf):
    return register.pages(table(spark, sf, "pages"), at=F.lit("t")).sources


# --- sequences ---
@query("block_ids", f"WITH {_BL}, d AS (SELECT *, sha256(concat_ws(chr(31), kind, text, '', '', '')) AS g FROM bl) SELECT doc_id, idx, sha256(version_id || ':' || g || ':' || (row_number() OVER (PARTITION BY version_id, g ORDER BY idx) - 1)) AS id FROM d")
def block_ids(spark, sf):
    return blocks.block_ids(A.blocks(spark, sf)).select("doc_id", "idx", "id")


def _path_sql(src: str) -> str:
    cols = ", ".join(f"coalesce(max(CASE WHEN kind = 'heading' AND level = {n} THEN idx END) OVER w, -1) AS p{n}, last_value(CASE WHEN kind = 'heading' AND level = {n} THEN trim(text) END IGNORE NULLS) OVER w AS t{n}" for n in range(1, 7))
    parts = ", ".join(f"CASE WHEN p{n} >= 0" + (f" AND p{n} > greatest({', '.join(f'p{m}' for m in range(1, n))})" if n > 1 else "") + f" THEN t{n} END" for n in range(1, 7))
    return f"hp AS (SELECT doc_id, idx, kind, level, text, concat_ws(' > ', {parts}) AS heading_path FROM (SELECT *, {cols} FROM {src} WINDOW w AS (PARTITION BY doc_id ORDER BY idx ROWS UNBOUNDED PRECEDING)))"


@query("heading_paths", f"WITH {_BL}, {_path_sql('bl')} SELECT doc_id, idx, heading_path FROM hp")
def heading_paths(spark, sf):
    return blocks.heading_paths(A.blocks(spark, sf)).select("doc_id", "idx", "heading_path")


_SEC = """sec AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY first) AS section_no, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS ref FROM
  (SELECT *, min(idx) OVER (PARTITION BY doc_id, section_path) AS first FROM (SELECT *, coalesce(nullif(heading_path, ''), '(front matter)') AS section_path FROM hp)))"""


@query(
    "sections",
    f"""WITH {_BL}, {_path_sql("bl")}, {_SEC} SELECT doc_id, idx, section_path, 'S' || lpad(section_no::VARCHAR, 4, '0') AS section_id, 'B' || lpad(ref::VARCHAR, 6, '0') AS reference_id,
  CASE WHEN contains(section_path, ' > ') THEN array_to_string(string_split(section_path, ' > ')[:-2], ' > ') ELSE '' END AS parent_path FROM sec""",
)
def sections(spark, sf):
    return blocks.sections(blocks.heading_paths(A.blocks(spark, sf))).select("doc_id", "idx", "section_path", "section_id", "reference_id", "parent_path")


@query("caption_labels", r"SELECT item_id, nullif(regexp_extract('Fig. ' || item_id || 'a: ' || text, '^(?i:Figure|Fig\.|Table)\s*(?:\d+[A-Za-z]?)\b'), '') AS label FROM benchmark")
def caption_labels(spark, sf):
    b = table(spark, sf, "benchmark")
    return b.select("item_id", blocks.caption_label(F.concat(F.lit("Fig. "), F.col("item_id").cast("string"), F.lit("a: "), "text")).alias("label"))


@query("doc_text", "SELECT doc_id, text FROM documents")
def doc_text(spark, sf):
    return blocks.doc_text(A.blocks(spark, sf))


_EXC = """x AS (SELECT *, length(t) AS n, count(*) OVER (PARTITION BY doc_id) AS c, row_number() OVER (PARTITION BY doc_id ORDER BY idx DESC) AS back, sum(length(t)) OVER (PARTITION BY doc_id ORDER BY idx) AS upto
  FROM (SELECT doc_id, idx, CASE WHEN kind = 'heading' THEN '## ' || text ELSE text END AS t FROM bl)),
y AS (SELECT *, coalesce(max(CASE WHEN upto <= {head} THEN upto END) OVER (PARTITION BY doc_id), 0) AS used, sum(CASE WHEN back <= 8 THEN n ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY idx) AS tail FROM x),
z AS (SELECT doc_id, list(t ORDER BY idx) FILTER (upto <= {head}) AS h, list(t ORDER BY idx) FILTER (back <= 8 AND c > 16 AND used + tail <= {most}) AS l FROM y GROUP BY doc_id)
SELECT doc_id, array_to_string(list_concat(list_concat(coalesce(h, []), CASE WHEN l IS NULL THEN [] ELSE [chr(10) || '...(中略)...' || chr(10)] END), coalesce(l, [])), chr(10) || chr(10)) AS excerpt FROM z"""


@query("doc_excerpt", f"WITH {_BL}, " + _EXC.format(head=19200, most=24000))
def doc_excerpt(spark, sf):
    return blocks.excerpt(A.blocks(spark, sf))


@query("doc_excerpt_small", f"WITH {_BL}, " + _EXC.format(head=1600, most=2000))
def doc_excerpt_small(spark, sf):
    return blocks.excerpt(A.blocks(spark, sf), most=2000)


@query(
    "surrounding_context",
    f"""WITH {_BL} SELECT doc_id, idx, right(concat_ws(chr(10), lag(text, 2) OVER w, lag(text) OVER w), 4000) AS before, left(concat_ws(chr(10), lead(text) OVER w, lead(text, 2) OVER w), 4000) AS after, '' AS heading_path FROM bl WINDOW w AS (PARTITION BY doc_id ORDER BY idx)""",
)
def surrounding_context(spark, sf):
    return context.surrounding(A.blocks(spark, sf))


def _ordered(spark, sf, stage):
    b = blocks.sections(blocks.heading_paths(A.blocks(spark, sf)))
    return context.section_order(b, stage)


@query(
    "section_round_robin",
    f"""WITH {_BL}, {_path_sql("bl")}, {_SEC}, p AS (SELECT *, CASE WHEN regexp_matches(section_path, '(?i)abstract|front matter') THEN 0 WHEN regexp_matches(section_path, '(?i)introduction|conclu') THEN 1 ELSE 2 END AS priority, row_number() OVER (PARTITION BY doc_id, section_no ORDER BY idx) AS turn FROM sec)
SELECT doc_id, idx, row_number() OVER (PARTITION BY doc_id ORDER BY turn, priority, section_no) AS place FROM p""",
)
def section_round_robin(spark, sf):
    return _ordered(spark, sf, "classify").select("doc_id", "idx", "place")


@query(
    "context_packing",
    f"""WITH RECURSIVE {_BL}, {_path_sql("bl")}, {_SEC}, p AS (SELECT *, CASE WHEN regexp_matches(section_path, '(?i)abstract|front matter') THEN 0 WHEN regexp_matches(section_path, '(?i)introduction|conclu') THEN 1 ELSE 2 END AS priority, row_number() OVER (PARTITION BY doc_id, section_no ORDER BY idx) AS turn FROM sec),
o AS MATERIALIZED (SELECT doc_id, length(text) + 120 AS cost, row_number() OVER (PARTITION BY doc_id ORDER BY turn, priority, section_no) AS place FROM p),
r AS (SELECT doc_id, 0::BIGINT AS place, 0::BIGINT AS used, true AS kept FROM documents
  UNION ALL SELECT o.doc_id, o.place, CASE WHEN used + cost <= 3000 THEN used + cost ELSE used END, used + cost <= 3000 FROM r JOIN o ON o.doc_id = r.doc_id AND o.place = r.place + 1)
SELECT doc_id, place, kept FROM r WHERE place > 0""",
)
def context_packing(spark, sf):
    return context.packed(_ordered(spark, sf, "classify").withColumn("cost", F.length("text") + 120), 3000)


@query("select_context")
def select_context(spark, sf):
    o = _ordered(spark, sf, "extract").withColumn("block_id", F.concat("version_id", F.lit("-"), F.col("idx").cast("string")))
    return context.select_context(o, "extract")


@query("context_coverage")
def context_coverage(spark, sf):
    return context.coverage(select_context(spark, sf))


@query("latest_versions", "SELECT 'd' || doc_id AS source_id, 'd' || doc_id || '-' || CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 3 END AS id FROM documents")
def latest_versions(spark, sf):
    d = table(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("source_id"), "doc_id", F.explode(F.array(*map(F.lit, [1, 2, 3]))).alias("seq"))
    v = d.select("source_id", F.concat("source_id", F.lit("-"), F.col("seq").cast("string")).alias("id"), "seq", F.when((F.col("seq") == 2) & (F.col("doc_id") % 2 == 0), "2024-02").otherwise("2024-01").alias("fetched_at"))
    return blocks.latest_versions(v).select("source_id", "id")


@query("document_view", f"WITH {_BL} SELECT 'd' || doc_id AS source_id, version_id, idx, kind, text, CASE WHEN idx % 3 = 0 THEN 't' || idx END AS translated_text FROM bl")
def document_view(spark, sf):
    b = A.blocks(spark, sf).select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("source_id"), "version_id", F.concat("version_id", F.lit("-"), F.col("idx").cast("string")).alias("id"), "idx", "kind", "text")
    v = table(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("source_id"), F.concat(F.lit("v"), F.col("doc_id").cast("string")).alias("id"), F.lit("2024").alias("fetched_at"), F.lit(1).alias("seq"))
    t = b.filter("idx % 3 = 0").select("source_id", F.col("id").alias("block_id"), F.concat(F.lit("t"), F.col("idx").cast("string")).alias("translated_text"), F.lit("u").alias("updated_at"))
    return catalog.document_view(v, b, t)


# --- analysis ---
_HEUR = f"""WITH {_BL}, {_MD}, b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS n FROM mb QUALIFY n <= 200),
g AS (SELECT doc_id, arg_min(text, idx) FILTER (kind = 'para' AND length(text) > 80) AS para, list(text ORDER BY idx) FILTER (kind = 'heading') AS heads FROM b GROUP BY doc_id),
t AS (SELECT d.doc_id, coalesce((SELECT arg_min(text, idx) FROM mb WHERE mb.doc_id = d.doc_id AND kind = 'heading'), (SELECT left(arg_min(text, idx), 80) FROM mb WHERE mb.doc_id = d.doc_id), 'Untitled') AS title FROM documents d),
h AS (SELECT t.doc_id, CASE WHEN para IS NOT NULL THEN left(para, 150) || '…' ELSE title END AS one_line_summary, para AS background, CASE WHEN len(heads) > 0 THEN '{OUTLINE_LABEL}' || array_to_string(heads[1:12], ' / ') END AS method, '{HEURISTIC_QUESTION}' AS open_question FROM t LEFT JOIN g USING (doc_id))"""


def _heuristic(spark, sf):
    d = A.markdown_docs(spark, sf)
    b = parse.markdown_blocks(d)
    return analysis.heuristic(parse.titles(d, b), b)


@query("heuristic_extraction", f"{_HEUR} SELECT * FROM h")
def heuristic_extraction(spark, sf):
    return _heuristic(spark, sf)


@query(
    "store_extraction",
    f"""{_HEUR}, {_KN}, n AS (SELECT 'd' || doc_id AS source_id, unnest(list_filter([{{'s': 'background', 'i': 'llm_summary', 'c': background}}, {{'s': 'method', 'i': 'llm_summary', 'c': method}}, {{'s': 'questions', 'i': 'open_question', 'c': open_question}}], lambda x: x.c <> '')) AS x, generate_subscripts(list_filter([background, method, open_question], lambda y: y <> ''), 1) AS k FROM h)
SELECT source_id, section_key, title, content, origin, info_type, sort_order FROM kn WHERE NOT (origin = 'auto_extract' AND source_id IN (SELECT 'd' || doc_id FROM h))
UNION ALL SELECT source_id, x.s, NULL, x.c, 'auto_extract', x.i, k::DOUBLE FROM n""",
)
def store_extraction(spark, sf):
    h = _heuristic(spark, sf)
    e = h.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("source_id"), "background", "method", F.array("open_question").alias("open_questions"))
    return analysis.stored(A.knowledge(spark, sf), e).drop("id")


_KINDS = "['critique','apply','translate','math','explain']"


@query(
    "save_target",
    f"""WITH {_AN}, a AS (SELECT id AS answer_id, {_KINDS}[length(content) % 5 + 1] AS p, content FROM an)
SELECT answer_id, CASE p WHEN 'critique' THEN 'limitations' WHEN 'apply' THEN 'applications' WHEN 'translate' THEN 'terms' WHEN 'math' THEN 'method' ELSE 'insights' END AS section_key,
  CASE p WHEN 'apply' THEN 'idea' WHEN 'translate' THEN 'translation' ELSE 'llm_interpretation' END AS info_type, left(coalesce(list_filter(list_transform(string_split(content, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1], ''), 30) AS title FROM a""",
)
def save_target(spark, sf):
    kinds = F.array(*map(F.lit, ["critique", "apply", "translate", "math", "explain"]))
    a = A.answers(spark, sf).select(F.col("id").alias("answer_id"), F.element_at(kinds, F.length("content") % 5 + 1).alias("prompt_type"), "content")
    return analysis.save_target(a)


# --- evidence ---
def _anchor_inputs(spark, sf):
    """Benchmark passages as quotes on one version that holds every document as a block."""
    d = table(spark, sf, "documents").select(F.lit("all").alias("version_id"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.col("doc_id").alias("idx"), "text")
    a = table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("anchor_id"), F.lit("all").alias("version_id"), F.col("text").alias("quote"))
    return a, d, spark.createDataFrame([("all", None)], "id string, content_hash string")


_NORM = "trim(regexp_replace({}, '[ \\t\\n\\r]+', ' ', 'g'))"


@query(
    "anchor_resolution",
    f"""WITH b AS (SELECT doc_id, {_NORM.format("text")} AS t FROM documents), q AS (SELECT item_id, {_NORM.format("text")} AS q FROM benchmark),
n AS (SELECT item_id, doc_id, len(list_filter(range(1, length(t) - length(q) + 2), lambda i: substr(t, i, length(q)) = q)) AS n FROM q JOIN b ON contains(t, q)),
g AS (SELECT item_id, sum(n) AS total, min(doc_id) AS d, string_agg('d' || doc_id, ',' ORDER BY doc_id) AS ids FROM n GROUP BY item_id)
SELECT item_id::VARCHAR AS anchor_id, CASE WHEN total = 1 THEN 'resolved' WHEN total > 1 THEN 'candidates' ELSE 'unresolved' END AS status, CASE WHEN total = 1 THEN 'quote' END AS method, CASE WHEN total > 1 THEN 'ambiguous_quote' WHEN total IS NULL THEN 'no_match' END AS reason,
  CASE WHEN total = 1 THEN 'd' || d END AS block_id, CASE WHEN total > 1 THEN ids ELSE '' END AS candidates FROM q LEFT JOIN g USING (item_id)""",
)
def anchor_resolution(spark, sf):
    a, b, v = _anchor_inputs(spark, sf)
    r = anchors.resolve(a, b, v)
    return r.select("anchor_id", "status", "method", "reason", F.col("block.id").alias("block_id"), F.array_join("candidates", ",").alias("candidates"))


@query("anchor_context_gate", f"WITH b AS (SELECT doc_id, {_NORM.format('text')} AS t FROM documents), q AS (SELECT item_id, {_NORM.format('text')} AS q FROM benchmark), g AS (SELECT item_id, count(*) AS n, min(doc_id) AS d, min((length(t) - length(replace(t, q, ''))) // length(q)) AS c FROM q JOIN b ON contains(t, q) GROUP BY item_id) SELECT item_id::VARCHAR AS anchor_id, CASE WHEN n = 1 AND c = 1 THEN d END AS idx FROM q LEFT JOIN g USING (item_id)")
def anchor_context_gate(spark, sf):
    a, b, _ = _anchor_inputs(spark, sf)
    return anchors.context_index(a, b)


@query(
    "portable_evidence",
    f"""WITH b AS (SELECT doc_id, {_NORM.format("text")} AS t FROM documents), q AS (SELECT item_id, {_NORM.format("text")} AS q FROM benchmark WHERE item_id % 2 = 0),
n AS (SELECT item_id, doc_id, len(list_filter(range(1, length(t) - length(q) + 2), lambda i: substr(t, i, length(q)) = q)) AS n FROM q JOIN b ON contains(t, q)),
g AS (SELECT item_id, sum(n) AS total, min(doc_id) AS d FROM n GROUP BY item_id)
SELECT m.item_id::VARCHAR AS anchor_id, CASE WHEN m.item_id % 2 = 1 OR total = 1 THEN 'resolved' WHEN total > 1 THEN 'candidates' ELSE 'unresolved' END AS status, CASE WHEN m.item_id % 2 = 1 THEN 'label' WHEN total = 1 THEN 'quote' END AS method,
  CASE WHEN m.item_id % 2 = 1 OR total = 1 THEN NULL WHEN total > 1 THEN 'ambiguous_quote' ELSE 'no_match' END AS reason, CASE WHEN m.item_id % 2 = 1 THEN 'd5' WHEN total = 1 THEN 'd' || d END AS block_id FROM benchmark m LEFT JOIN g USING (item_id)""",
)
def portable_evidence(spark, sf):
    a, b, v = _anchor_inputs(spark, sf)
    none = F.lit(None).cast("string")
    e = a.select("anchor_id", "version_id", F.when(F.col("anchor_id").cast("long") % 2 == 0, F.col("quote")).alias("quote"), none.alias("prefix"), none.alias("suffix"), F.lit(None).cast("int").alias("page"), none.alias("bbox"), none.alias("source_hash"), F.when(F.col("anchor_id").cast("long") % 2 == 1, "Figure 3").alias("figure_label"), none.alias("table_label"))
    label = F.when(F.col("idx") == 5, F.concat(F.lit("Figure  3: "), "text")).otherwise(F.col("text"))
    r = anchors.resolve_portable(e, b.withColumn("text", label), v)
    return r.select("anchor_id", "status", "method", "reason", F.col("block.id").alias("block_id"))


@query(
    "evidence_status_counts",
    f"""WITH b AS (SELECT doc_id, {_NORM.format("text")} AS t FROM documents), q AS (SELECT item_id, {_NORM.format("text")} AS q FROM benchmark),
p AS (SELECT item_id, len(list_filter(range(1, length(t) - length(q) + 2), lambda i: substr(t, i, length(q)) = q)) AS n FROM q JOIN b ON contains(t, q)), g AS (SELECT q.item_id, coalesce(sum(n), 0) AS n FROM q LEFT JOIN p ON p.item_id = q.item_id GROUP BY q.item_id)
SELECT item_id % 4 AS part, count(*) FILTER (n = 1) AS resolved, count(*) FILTER (n > 1) AS candidates, 0::BIGINT AS page_only, count(*) FILTER (n = 0) AS unresolved FROM g GROUP BY 1""",
)
def evidence_status_counts(spark, sf):
    a, b, v = _anchor_inputs(spark, sf)
    return brief.evidence_counts(anchors.resolve(a, b, v).withColumn("part", F.col("anchor_id").cast("long") % 4), ["part"])


@query("made_anchors", f"WITH {_BL} SELECT doc_id || '-' || idx AS block_id, left(substr(text, 71, 40), 500) AS quote, substr(text, 11, 60) AS prefix, substr(text, 111, 60) AS suffix FROM bl WHERE length(text) > 150")
def made_anchors(spark, sf):
    s = A.blocks(spark, sf).filter("length(text) > 150").select(F.concat(F.col("doc_id").cast("string"), F.lit("-"), F.col("idx").cast("string")).alias("block_id"), "text", F.lit(70).alias("start"), F.lit(110).alias("end"))
    return anchors.made(s)


@query("rect_overlap", "SELECT a.doc_id AS id, greatest(0.0::DOUBLE, least(10.0 + doc_id % 7, 12.0) - greatest((doc_id % 7)::DOUBLE, 4.0)) * greatest(0.0::DOUBLE, least(5.0, 6.0) - greatest(0.0, 1.0)) / least(50.0, 40.0)::DOUBLE AS overlap FROM documents a")
def rect_overlap(spark, sf):
    d, k = table(spark, sf, "documents"), (F.col("doc_id") % 7).cast("double")
    a = F.array(k, F.lit(0.0), k + 10.0, F.lit(5.0))
    b = F.array(F.lit(4.0), F.lit(1.0), F.lit(12.0), F.lit(6.0))
    return d.select(F.col("doc_id").alias("id"), geometry.overlap(a, b).alias("overlap"))


# --- briefs ---
def _fields(spark, sf, shift: int, part: int):
    """Three fields of each document but those whose number leaves ``part`` by 5 (5: of all)."""
    names = F.array(*map(F.lit, ["problem", "method", "results"]))
    d = table(spark, sf, "documents").filter(F.col("doc_id") % 5 != part).select("doc_id", F.explode(names).alias("field_name"))
    h = F.col("doc_id") + F.length("field_name")
    return d.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("source_id"), "field_name", F.concat(F.lit('"'), ((h + (shift * (F.col("doc_id") % 2))).cast("string")), F.lit('"')).alias("value_json"), F.lit("confirmed").alias("status"), F.lit("[]").alias("evidence_json"), F.when(h % 6 == 0, "user").otherwise("llm").alias("origin"), (h % 4 == 0).alias("user_edited"), F.lit("{}").alias("provenance_json"))


def _fields_sql(name: str, shift: int, part: int) -> str:
    return f"""{name} AS (SELECT 'd' || doc_id AS source_id, f AS field_name, '"' || (h + {shift} * (doc_id % 2)) || '"' AS value_json, CASE WHEN h % 6 = 0 THEN 'user' ELSE 'llm' END AS origin, h % 4 = 0 AS user_edited
      FROM (SELECT doc_id, f, doc_id + length(f) AS h FROM documents, (SELECT unnest(['problem', 'method', 'results']) AS f) WHERE doc_id % 5 <> {part}))"""


_BRIEF = f"WITH {_fields_sql('c', 0, 1)}, {_fields_sql('n', 7, 2)}"


@query("brief_merge", f"""{_BRIEF} SELECT coalesce(n.source_id, c.source_id) AS source_id, coalesce(n.field_name, c.field_name) AS field_name, CASE WHEN w THEN n.value_json ELSE c.value_json END AS value_json, CASE WHEN w THEN n.origin ELSE c.origin END AS origin, w AS written
FROM (SELECT n, c, n.field_name IS NOT NULL AND NOT (c.field_name IS NOT NULL AND (c.origin = 'user' OR c.user_edited)) AS w FROM n FULL JOIN c ON n.source_id = c.source_id AND n.field_name = c.field_name)""")
def brief_merge(spark, sf):
    return brief.merged(_fields(spark, sf, 0, 1), _fields(spark, sf, 7, 2)).select("source_id", "field_name", "value_json", "origin", "written")


@query("brief_import_actions", f"""{_BRIEF} SELECT n.source_id, n.field_name, CASE WHEN n.field_name = 'results' THEN 'excluded' WHEN c.field_name IS NULL THEN 'add' WHEN c.origin = 'user' OR c.user_edited THEN 'preserve_user' ELSE 'update' END AS action,
CASE WHEN c.user_edited THEN 'user_edited' WHEN c.origin = 'user' THEN 'user_origin' WHEN c.field_name IS NOT NULL THEN 'existing_field' END AS conflict FROM n LEFT JOIN c ON n.source_id = c.source_id AND n.field_name = c.field_name""")
def brief_import_actions(spark, sf):
    return brief.import_actions(_fields(spark, sf, 0, 1), _fields(spark, sf, 7, 2), ["results"])


@query("brief_regeneration", f"""{_BRIEF} SELECT n.source_id, n.field_name, CASE WHEN c.field_name IS NULL THEN 'new_field' WHEN c.origin = 'user' OR c.user_edited THEN 'preserve_user' WHEN c.value_json = n.value_json THEN 'unchanged' ELSE 'generated_update' END AS action FROM n LEFT JOIN c ON n.source_id = c.source_id AND n.field_name = c.field_name""")
def brief_regeneration(spark, sf):
    return brief.regeneration_actions(_fields(spark, sf, 0, 1), _fields(spark, sf, 7, 2))


@query("brief_revisions", "SELECT 'd' || doc_id AS source_id, CASE WHEN doc_id % 5 = 2 THEN 3 WHEN doc_id % 5 = 1 THEN 1 ELSE 4 END AS revision FROM documents")
def brief_revisions(spark, sf):
    old = _fields(spark, sf, 0, 1).select("source_id").distinct().withColumn("revision", F.lit(3))
    return brief.revisions(old, _fields(spark, sf, 7, 2))


@query("brief_effective_status", "SELECT 'd' || doc_id AS source_id, 'problem' AS field_name, CASE WHEN doc_id % 3 = 1 THEN 'confirmed' ELSE 'uncertain' END AS effective FROM documents")
def brief_effective_status(spark, sf):
    d = table(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("source_id"), "doc_id")
    f = d.select("source_id", F.lit("problem").alias("field_name"), F.lit("confirmed").alias("status"), F.when(F.col("doc_id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("a"), F.lit("b"))).alias("refs"))
    r = d.select("source_id", F.lit("a").alias("evidence_id"), F.lit("resolved").alias("status")).unionByName(d.select("source_id", F.lit("b").alias("evidence_id"), F.when(F.col("doc_id") % 3 == 2, "candidates").otherwise("resolved").alias("status")))
    return brief.effective_status(f, r).select("source_id", "field_name", "effective")


@query(
    "import_preview",
    f"""{_BRIEF}, a AS (SELECT n.source_id, count(*) FILTER (c.field_name IS NULL OR NOT (c.origin = 'user' OR c.user_edited)) AS selected, count(c.field_name) AS conflicts FROM n LEFT JOIN c ON n.source_id = c.source_id AND n.field_name = c.field_name GROUP BY 1)
SELECT source_id, i % 9 <> 0 AND selected > 0 AS can_commit, concat_ws(',', CASE WHEN i % 2 = 1 THEN 'evidence_needs_review' END, CASE WHEN conflicts > 0 THEN 'field_conflicts' END, CASE WHEN i % 9 = 0 THEN 'duplicate_import' END, CASE WHEN selected = 0 THEN 'no_writable_fields' END) AS review_reasons, selected FROM (SELECT *, substr(source_id, 2)::BIGINT AS i FROM a)""",
)
def import_preview(spark, sf):
    inc = _fields(spark, sf, 7, 2)
    act = brief.import_actions(_fields(spark, sf, 0, 1), inc)
    ids = inc.select("source_id").distinct()
    counts = ids.select("source_id", F.lit(1).alias("resolved"), (F.substring("source_id", 2, 20).cast("long") % 2).alias("candidates"), F.lit(0).alias("page_only"), F.lit(0).alias("unresolved"))
    targets = ids.select("source_id", F.lit(True).alias("matched"), F.lit(False).alias("manual"), F.lit(0).alias("warnings"))
    return brief.import_preview(act, counts, targets, ids.filter(F.substring("source_id", 2, 20).cast("long") % 9 == 0))


@query(
    "brief_snapshot",
    f"""WITH {_fields_sql("c", 0, 5)} SELECT source_id, sha256(string_agg(j, chr(10) ORDER BY j)) AS digest FROM (SELECT source_id, '{{"field_name":"' || field_name || '","value_json":"' || replace(value_json, '"', '\\"') || '","status":"confirmed","origin":"' || origin || '"}}' AS j FROM c) GROUP BY source_id""",
)
def brief_snapshot(spark, sf):
    return brief.snapshot_hash(_fields(spark, sf, 0, 5), "source_id", ["field_name", "value_json", "status", "origin"])


@query(
    "brief_quick_view",
    f"""WITH {_fields_sql("c", 0, 5)} SELECT i.source_id, v.ord, v.name AS field_name, c.value_json, CASE WHEN c.field_name IS NOT NULL THEN 'confirmed' END AS status FROM (SELECT DISTINCT source_id FROM c) i, (VALUES {", ".join(f"({n}, '{x}')" for n, x in enumerate([*brief.QUICK, *brief.BY_TYPE[""]]))}) v(ord, name) LEFT JOIN c ON c.source_id = i.source_id AND c.field_name = v.name""",
)
def brief_quick_view(spark, sf):
    return brief.quick_view(_fields(spark, sf, 0, 5))


# --- questions and generation ---
@query("asked_questions")
def asked_questions(spark, sf):
    none = F.lit(None).cast("string")
    q = A.questions(spark, sf).select(F.col("id").alias("question_id"), "source_id", "question_text", F.lit("explain").alias("prompt_type"), none.alias("selection_text"), none.alias("quote"), none.alias("prefix"), none.alias("suffix"), F.concat(F.lit("v"), F.substring("source_id", 2, 20)).alias("source_version"), none.alias("block_id"), F.lit(1).cast("long").alias("block_idx"))
    v = table(spark, sf, "documents").select(F.concat(F.lit("v"), F.col("doc_id").cast("string")).alias("id"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("source_id"))
    b = blocks.heading_paths(A.blocks(spark, sf)).withColumn("id", F.concat("version_id", F.lit("-"), F.col("idx").cast("string")))
    return qa.asked(q, A.sources(spark, sf, False), v, b, A.knowledge(spark, sf), {"explain": "?"})


def _literal(x: str) -> str:
    return "'" + x.replace("\n", "' || chr(10) || '") + "'"


@query("mock_answers", f"SELECT doc_id, {_literal(qa.MOCK_NOTE + '選択箇所:' + chr(10) * 2 + '> ')} || 'pick ' || doc_id || {_literal(chr(10) * 2 + qa.MOCK_END)} AS answer, '【モック翻訳】pick ' || doc_id AS translation FROM documents")
def mock_answers(spark, sf):
    p = F.concat(F.lit("a ---SELECTION--- pick "), F.col("doc_id").cast("string"), F.lit(" --- b"))
    return table(spark, sf, "documents").select("doc_id", qa.mock_answer(p).alias("answer"), qa.mock_translation(p).alias("translation"))


@query("prompt_files", "SELECT 'p' || doc_id AS id, '2' AS version, 'Body ' || doc_id AS body FROM documents")
def prompt_files(spark, sf):
    s = F.col("doc_id").cast("string")
    return qa.prompts(table(spark, sf, "documents").select(F.lit("file").alias("name"), F.concat(F.lit("---\nid: p"), s, F.lit("\nversion: 2\n---\n\nBody "), s, F.lit("\n")).alias("value")))


@query("commit_decisions", "SELECT 'p' || doc_id AS preview_id, CASE WHEN doc_id % 2 = 0 THEN 'already_committed' WHEN doc_id % 3 = 0 THEN 'expired' WHEN doc_id % 5 = 0 THEN 'duplicate_import' WHEN doc_id % 7 = 0 THEN 'stale' WHEN doc_id % 11 = 0 THEN 'not_writable' ELSE 'commit' END AS decision FROM documents")
def commit_decisions(spark, sf):
    d, s = table(spark, sf, "documents"), F.col("doc_id").cast("string")
    n = lambda k: F.col("doc_id") % k == 0
    p = d.select(F.concat(F.lit("p"), s).alias("preview_id"), F.concat(F.lit("k"), s).alias("package_id"), F.sha2(s, 256).alias("payload_hash"), s.alias("digest"), F.when(n(3), "2024-01-01").otherwise("2024-03-01").alias("expires_at"), F.when(n(2), "2024-01-01").alias("committed_at"))
    f = d.select(F.concat(F.lit("p"), s).alias("preview_id"), F.when(n(7), "x").otherwise(s).alias("fresh_digest"), (~n(11)).alias("can_commit"))
    ledger = d.filter("doc_id % 5 = 0").select(F.lit("other").alias("package_id"), F.sha2(s, 256).alias("payload_hash"))
    return generation.commit_decisions(p, f, ledger, F.lit("2024-02-01"))


@query("job_recovery", "SELECT 'j' || doc_id AS job_id, CASE WHEN doc_id % 3 = 0 AND doc_id % 2 = 0 THEN 'failed' WHEN doc_id % 3 = 0 THEN 'generating' ELSE 'preview' END AS state, CASE WHEN doc_id % 3 = 0 AND doc_id % 2 = 0 THEN 'interrupted' END AS error FROM documents")
def job_recovery(spark, sf):
    j = table(spark, sf, "documents").select(F.concat(F.lit("j"), F.col("doc_id").cast("string")).alias("job_id"), F.when(F.col("doc_id") % 3 == 0, "generating").otherwise("preview").alias("state"), F.lit(None).cast("string").alias("error"), F.when(F.col("doc_id") % 2 == 0, "2024-01-01").otherwise("2024-03-01").alias("updated_at"))
    return generation.recovered(j, F.lit("2024-02-01"), F.lit("2024-02-02")).select("job_id", "state", "error")


# --- export ---
_PARTS = ["versions", "blocks", "questions", "answers", "knowledge_items", "highlights", "translations", "tags"]
_HELD = {"versions": "1", "blocks": "(SELECT count(*) FROM bl WHERE bl.doc_id = src.doc_id)", "questions": "(SELECT count(*) FROM qu WHERE qu.source_id = src.id)", "answers": "(SELECT count(*) FROM an JOIN qu ON qu.id = an.question_id WHERE qu.source_id = src.id)", "knowledge_items": "(SELECT count(*) FROM kn WHERE kn.source_id = src.id)", "highlights": "(SELECT count(*) FROM bl WHERE bl.doc_id = src.doc_id AND idx % 7 = 2)", "translations": "(SELECT count(*) FROM bl WHERE bl.doc_id = src.doc_id AND idx % 3 = 0)", "tags": "(SELECT count(DISTINCT name) FROM tags WHERE tags.source_id = src.id)"}


@query("export_json_counts", f"WITH {_SRC}, {_KN}, {_QU}, {_AN}, {_BL}, {_TAGS} SELECT id, " + ", ".join(f"{x}::BIGINT AS {n}" for n, x in _HELD.items()) + ", (SELECT coalesce(string_agg(text, '|' ORDER BY idx), '') FROM bl WHERE bl.doc_id = src.doc_id AND idx % 7 = 2) AS quotes FROM src")
def export_json_counts(spark, sf):
    """How much of each part every source's document holds, and its highlights' quotes in their order."""
    schema = ", ".join(f"{n} array<struct<{'quote' if n == 'highlights' else 'source_id'}:string>>" for n in _PARTS[:-1]) + ", tags array<string>"
    j = _export(spark, sf).select("id", F.from_json("json", schema).alias("p"))
    return j.select("id", *[F.size(f"p.{n}").cast("long").alias(n) for n in _PARTS], F.array_join("p.highlights.quote", "|").alias("quotes"))


def _export(spark, sf):
    d = table(spark, sf, "documents")
    b = A.blocks(spark, sf).select(F.concat("version_id", F.lit("-"), F.col("idx").cast("string")).alias("id"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("source_id"), "version_id", "idx", "kind", "level", "text")
    when = F.lpad(F.col("idx").cast("string"), 9, "0").alias("created_at")
    return export.full(
        A.sources(spark, sf, False),
        A.source_tags(spark, sf),
        versions=d.select(F.concat(F.lit("v"), F.col("doc_id").cast("string")).alias("id"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("source_id"), F.lit("2024").alias("fetched_at"), F.sha2("text", 256).alias("content_hash")),
        blocks=b,
        questions=A.questions(spark, sf),
        answers=A.answers(spark, sf),
        knowledge_items=A.knowledge(spark, sf),
        highlights=b.filter("idx % 7 = 2").select(F.concat(F.lit("h"), "id").alias("id"), "source_id", F.col("id").alias("block_id"), F.col("text").alias("quote"), when),
        translations=b.filter("idx % 3 = 0").select("source_id", F.col("id").alias("block_id"), F.concat(F.lit("t"), F.col("idx").cast("string")).alias("translated_text")),
    )


@query("export_json")
def export_json(spark, sf):
    return _export(spark, sf)


_MARK = f"""WITH {_SRC}, {_KN}, {_QU}, {_AN}, {_TAGS}, {_TEMPLATE},
k AS (SELECT kn.*, coalesce(t.ord, {len(NOTE_TEMPLATE)}) AS ord, coalesce(t.label, section_key) AS label,
  replace('- ' || CASE WHEN coalesce(title, '') <> '' THEN '**' || title || '** — ' ELSE '' END || content, chr(10), chr(10) || '  ') || chr(10) || '  - _出所: ' || CASE origin WHEN 'user' THEN 'ユーザー' ELSE 'AI自動抽出' END || ' / 種別: ' || CASE info_type WHEN 'fact' THEN '事実' ELSE '未解決' END || '_' || chr(10) AS line FROM kn LEFT JOIN template t ON t.key = section_key),
s AS (SELECT source_id, ord, section_key, '## ' || label || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY sort_order, created_at, id) AS t FROM k GROUP BY source_id, ord, section_key, label),
ss AS (SELECT source_id, string_agg(t, chr(10) ORDER BY ord, section_key) AS t FROM s GROUP BY source_id),
h AS (SELECT q.source_id, string_agg('### Q: ' || question_text || chr(10) || coalesce(chr(10) || '**A** _(AI回答 / mock)_:' || chr(10) || chr(10) || a.content, '') || chr(10), chr(10) ORDER BY q.created_at, q.id, a.id NULLS FIRST) AS t FROM qu q LEFT JOIN an a ON a.question_id = q.id GROUP BY q.source_id),
g AS (SELECT source_id, string_agg(DISTINCT name, ', ' ORDER BY name) AS t FROM tags GROUP BY source_id)
SELECT src.id, regexp_replace(concat_ws(chr(10), '---', 'title: ' || nullif(title, ''), 'type: text', 'authors: [' || (authors::JSON ->> 0) || ']', 'tags: [' || g.t || ']', 'reading_status: ' || reading_status, 'created: ' || updated_at, 'updated: ' || updated_at, '---', '', '# ' || title, '', '> **一言要約**: ' || one_line_summary || chr(10), ss.t, '## 質問と回答の履歴' || chr(10) || chr(10) || h.t), '[ \\n\\t]+$', '') || chr(10) AS markdown
FROM src LEFT JOIN ss ON ss.source_id = src.id LEFT JOIN h ON h.source_id = src.id LEFT JOIN g ON g.source_id = src.id"""


@query("export_markdown", _MARK)
def export_markdown(spark, sf):
    return export.markdown(A.sources(spark, sf, False), A.knowledge(spark, sf), A.questions(spark, sf), A.answers(spark, sf), A.source_tags(spark, sf))


# --- functions and checks ---
@query("snippets", f"SELECT doc_id, {_snip('text', 'the')} AS snippet FROM documents")
def snippets(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.snippet(F.col("text"), "the").alias("snippet"))


@query(
    "identifiers",
    r"""SELECT doc_id, '2401.' || lpad((doc_id % 90000)::VARCHAR, 5, '0') AS arxiv_id, '10.1234/ab.' || doc_id AS doi, '10.1234/ab.' || doc_id AS doi_key, '2401.' || lpad((doc_id % 90000)::VARCHAR, 5, '0') AS arxiv_key, left('a_b_' || doc_id, 100) AS filename FROM documents""",
)
def identifiers(spark, sf):
    d = table(spark, sf, "documents")
    s, n = F.col("doc_id").cast("string"), F.lpad((F.col("doc_id") % 90000).cast("string"), 5, "0")
    line = F.concat(F.lit("see https://arXiv.org/abs/2401."), n, F.lit("v2 and doi:10.1234/ab."), s, F.lit(")., end"))
    return d.select(
        "doc_id",
        text.arxiv_id(line).alias("arxiv_id"),
        text.doi(line).alias("doi"),
        text.doi_key(F.concat(F.lit(" https://dx.doi.org/10.1234/AB."), s)).alias("doi_key"),
        text.arxiv_key(F.concat(F.lit("arXiv: 2401."), n, F.lit("v3.pdf"))).alias("arxiv_key"),
        text.safe_filename(F.concat(F.lit(" a:b?"), s, F.lit(". "))).alias("filename"),
    )


@query("reply_text", "SELECT doc_id, '{\"n\": ' || doc_id || '}' AS reply, 'chosen ' || doc_id AS selection, '2' || lpad((doc_id % 100)::VARCHAR, 3, '0') LIKE '20%' AS has_year FROM documents")
def reply_text(spark, sf):
    d, s = table(spark, sf, "documents"), F.col("doc_id").cast("string")
    fenced = F.concat(F.lit('```json\n{"n": '), s, F.lit("}\n```"))
    prompt = text.render("x ---SELECTION--- {sel} --- {other}", {"sel": F.concat(F.lit("chosen "), s)})
    return d.select("doc_id", text.strip_json_fences(fenced).alias("reply"), text.selection_of(prompt).alias("selection"), text.year(F.concat(F.lit("in 2"), F.lpad((F.col("doc_id") % 100).cast("string"), 3, "0"))).isNotNull().alias("has_year"))


@query("integrity_violations", f"WITH {_KN} SELECT 'knowledge' AS tbl, 'parent source_id' AS rule, count(*) AS n FROM kn WHERE source_id NOT IN (SELECT 'd' || doc_id FROM documents WHERE doc_id % 20 <> 0) HAVING count(*) > 0")
def integrity_violations(spark, sf):
    parents = A.sources(spark, sf, False).filter("doc_id % 20 <> 0")
    return violations(A.knowledge(spark, sf), "knowledge", unique=["id"], required=["content"], enums={"origin": ["user", "auto_extract"]}, parents=[("source_id", parents, "id")])


@query("folded_turns", "SELECT conv_id::VARCHAR AS session_id, '0' AS turn_id, CASE WHEN conv_id % 3 = 0 OR conv_id % 5 = 0 THEN NULL ELSE string_agg(text, '' ORDER BY turn) END AS text, CASE WHEN conv_id % 5 = 0 THEN 'cancelled' WHEN conv_id % 3 = 0 THEN 'incomplete_turn' END AS error FROM conversations GROUP BY conv_id")
def folded_turns(spark, sf):
    from .streaming import fold_turns

    c = table(spark, sf, "conversations")
    sid = F.col("conv_id").cast("string")
    d = c.select(sid.alias("session_id"), F.lit("0").alias("turn_id"), F.col("turn").cast("long").alias("seq"), F.lit("delta").alias("kind"), "text")
    ids = c.select("conv_id").distinct()
    row = lambda cond, kind: ids.filter(cond).select(sid.alias("session_id"), F.lit("0").alias("turn_id"), F.lit(1 << 30).cast("long").alias("seq"), F.lit(kind).alias("kind"), F.lit("").alias("text"))
    return fold_turns(d.unionByName(row("conv_id % 3 <> 0", "completed")).unionByName(row("conv_id % 5 = 0", "cancelled")))


@query("stream_ingest_status")
def stream_ingest_status(spark, sf):
    from .session import scratch_folder
    from .streaming import ingest_status

    base = scratch_folder(spark, "stream")
    table(spark, sf, "documents").write.parquet(f"{base}/in")
    return ingest_status(spark, f"{base}/in", "doc_id long, text string, lang string, source string, n_chars long", f"{base}/out", f"{base}/state")


@query("packages")
def packages(spark, sf):
    """Packages made of a few documents, one of them damaged, read back from their bytes."""
    from .sources.package import packages as read
    from .sources.package import write_package

    rows = []
    for n in range(6):
        field = {"value": None, "status": "not_reported", "evidence": []}
        names = ["paper_type", "one_line_summary", "research_objective", "background", "problem", "target_task", "target_domain"]
        manifest = {"kgpack_schema_version": "kgpack-0.1", "package_id": f"p{n}", "generated_at": "2024-01-01T00:00:00Z", "generated_by": "test", "source_identity": {"title": f"t{n % 3}", "authors": [], "year": None}, "paper_brief_schema_version": "paper-brief-0.1", "provenance_notice": "n", "payloads": ["paper_brief.json", "evidence_refs.json"]}
        data = write_package({"manifest": manifest, "paper_brief": {"schema_version": "paper-brief-0.1", **{k: field for k in names}}, "evidence_refs": []})
        rows.append((f"p{n}", bytearray(data if n else data[:-1])))
    return read(spark.createDataFrame(rows, "path string, content binary"))


from . import study_queries  # noqa: E402,F401  registers its queries here
