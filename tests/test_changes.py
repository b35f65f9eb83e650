"""Merges, edits, exports and streams on small literal tables."""

import json

from pyspark.sql import functions as F

from lodestone import schema
from lodestone.operators import analysis, brief, catalog, dedup, export
from lodestone.streaming import fold_turns

FIELDS = "source_id string, field_name string, value_json string, status string, evidence_json string, origin string, user_edited boolean, provenance_json string"


def field(spark, *rows):
    return spark.createDataFrame([(s, f, v, "confirmed", "[]", o, u, "{}") for s, f, v, o, u in rows], FIELDS)


def test_automatic_writes_leave_the_users_fields(spark):
    cur = field(spark, ("s", "a", "1", "llm", False), ("s", "b", "1", "user", False), ("s", "c", "1", "llm", True), ("s", "d", "1", "llm", False))
    inc = field(spark, ("s", "a", "2", "llm", False), ("s", "b", "2", "llm", False), ("s", "c", "2", "llm", False), ("s", "e", "2", "llm", False))
    got = {r["field_name"]: (r["value_json"], r["written"]) for r in brief.merged(cur, inc).collect()}
    assert got == {"a": ("2", True), "b": ("1", False), "c": ("1", False), "d": ("1", False), "e": ("2", True)}
    by_hand = {r["field_name"]: r["value_json"] for r in brief.merged(cur, inc, automatic=False).collect()}
    assert by_hand["b"] == "2"
    act = {r["field_name"]: r["action"] for r in brief.regeneration_actions(cur, inc.unionByName(field(spark, ("s", "d", "1", "llm", False)))).collect()}
    assert act == {"a": "generated_update", "b": "preserve_user", "c": "preserve_user", "d": "unchanged", "e": "new_field"}


def test_confirmed_needs_every_reference(spark):
    f = spark.createDataFrame([("s", "a", "confirmed", []), ("s", "b", "confirmed", ["x", "y"]), ("s", "c", "confirmed", ["x"]), ("s", "d", "derived", []), ("s", "e", "confirmed", ["gone"])], "source_id string, field_name string, status string, refs array<string>")
    r = spark.createDataFrame([("s", "x", "resolved"), ("s", "y", "candidates")], "source_id string, evidence_id string, status string")
    assert {x["field_name"]: x["effective"] for x in brief.effective_status(f, r).collect()} == {"a": "uncertain", "b": "uncertain", "c": "confirmed", "d": "derived", "e": "uncertain"}
    v = spark.sql("SELECT 'confirmed' AS s, array(named_struct('status', 'uncertain', 'evidence', array('a', 'b')), named_struct('status', 'confirmed', 'evidence', array('a'))) AS v")
    assert v.select(brief.result_downgrade(F.col("s"), F.col("v"))).first()[0] == "uncertain"
    assert v.select(brief.nested_refs(F.col("v"))).first()[0] == ["a", "b"]


def test_stored_replaces_only_what_was_extracted(spark):
    cols = "id string, source_id string, section_key string, title string, content string, origin string, info_type string, sort_order double"
    items = spark.createDataFrame([("1", "s", "misc", None, "mine", "user", "fact", 1.0), ("2", "s", "misc", None, "old", "auto_extract", "fact", 1.0), ("3", "t", "misc", None, "other", "auto_extract", "fact", 1.0)], cols)
    e = spark.createDataFrame([("s", "bg", "", [("term", None), ("", "x")], ["q", ""])], "source_id string, background string, method string, terms array<struct<term:string,definition:string>>, open_questions array<string>")
    got = sorted((r["source_id"], r["section_key"], r["title"], r["content"], r["sort_order"]) for r in analysis.stored(items, e).select("source_id", "section_key", F.coalesce("title", F.lit("")).alias("title"), "content", "sort_order").collect())
    assert got == [("s", "background", "", "bg", 1.0), ("s", "misc", "", "mine", 1.0), ("s", "questions", "", "q", 3.0), ("s", "terms", "term", "", 2.0), ("t", "misc", "", "other", 1.0)]


def test_duplicates_meet_across_address_columns(spark):
    cols = "id string, content_hash string, doi string, arxiv_id string, url string, canonical_url string"
    old = spark.createDataFrame([("a", "h1", None, "", "u1", "u2"), ("b", "h2", "d", None, None, None)], cols)
    new = spark.createDataFrame([("x", "h9", None, "", "u2", None), ("y", "h2", "d", None, None, None), ("z", None, "", "", "", None)], cols)
    assert sorted(map(tuple, dedup.find_duplicates(new, old).collect())) == [("x", "a"), ("y", "b")]


def test_tags_and_order(spark):
    t = spark.createDataFrame([("s", "old"), ("t", "kept")], "source_id string, name string")
    p = spark.createDataFrame([("s", [" a ", "a", " ", "b"])], "source_id string, tags array<string>")
    assert sorted(map(tuple, catalog.retagged(t, p).collect())) == [("s", "a"), ("s", "b"), ("t", "kept")]


def test_violations(spark):
    df = spark.createDataFrame([("1", "x", "p"), ("1", None, "gone")], "id string, v string, parent string")
    parents = spark.createDataFrame([("p",)], "id string")
    got = {r["rule"]: r["n"] for r in schema.violations(df, "t", unique=["id"], required=["v"], enums={"v": ["y"]}, parents=[("parent", parents, "id")]).collect()}
    assert got == {"unique id": 1, "required v": 1, "enum v": 1, "parent parent": 1}


def test_export(spark):
    s = spark.createDataFrame([("s", "Title", "text", '["A","B"]', 0, None, None, None, "unread", "c", "u", "sum")], "id string, title string, type string, authors string, year int, url string, doi string, arxiv_id string, reading_status string, created_at string, updated_at string, one_line_summary string")
    anchor = json.dumps({"page": 3, "headingPath": "H", "quote": "q" * 90})
    k = spark.createDataFrame([("1", "s", "method", "t", "line1\nline2", "llm", "fact", "verified", anchor, 1.0, "c"), ("2", "s", "own", None, "x", "user", "idea", "unverified", None, 1.0, "c")], "id string, source_id string, section_key string, title string, content string, origin string, info_type string, verification string, anchor string, sort_order double, created_at string")
    q = spark.createDataFrame([("q", "s", "why?", None, "chosen", "c")], "id string, source_id string, question_text string, anchor string, selection_text string, created_at string")
    a = spark.createDataFrame([("a", "q", "because", None)], "id string, question_id string, content string, model string")
    t = spark.createDataFrame([("s", "x")], "source_id string, name string")
    md = export.markdown(s, k, q, a, t).first()["markdown"]
    want = "---\ntitle: Title\ntype: text\nauthors: [A, B]\nyear: 0\ntags: [x]\nreading_status: unread\ncreated: c\nupdated: u\n---\n\n# Title\n\n> **一言要約**: sum\n\n## 提案手法\n\n- **t** — line1\n  line2\n  - _出所: AI回答 / 種別: 事実 / 検証: verified_\n  - _原文: p.3 | H | “" + "q" * 80 + "…”_\n\n## own\n\n- x\n  - _出所: ユーザー / 種別: アイデア_\n\n## 質問と回答の履歴\n\n### Q: why?\n> chosen\n\n**A** _(AI回答 / ?)_:\n\nbecause\n"
    assert md == want


def test_full_export_round_trip(spark):
    s = spark.createDataFrame([("s", "T \"x\"", None), ("r", None, None)], "id string, title string, year int")
    tags = spark.createDataFrame([("s", "b"), ("s", "a"), ("s", "a")], "source_id string, name string")
    q = spark.createDataFrame([("q1", "s", "2"), ("q2", "s", "1")], "id string, source_id string, created_at string")
    a = spark.createDataFrame([("a1", "q1", None), ("a2", "gone", None)], "id string, question_id string, content string")
    got = {r["id"]: json.loads(r["json"]) for r in export.full(s, tags, questions=q, answers=a).collect()}
    none = {n: [] for n in (*export.PARTS, "tags")}
    assert got["r"] == {"source": {"id": "r", "title": None, "year": None}, **none}
    assert got["s"] == {**none, "source": {"id": "s", "title": 'T "x"', "year": None}, "tags": ["a", "b"], "questions": [{"id": "q2", "source_id": "s", "created_at": "1"}, {"id": "q1", "source_id": "s", "created_at": "2"}], "answers": [{"id": "a1", "question_id": "q1", "content": None}]}
    line = json.loads(export.envelopes(export.full(s, tags), F.lit('t"')).filter("value LIKE '%\"r\"%'").first()["value"])
    assert line == {"exported_at": 't"', "source": got["r"]}


def test_turns(spark):
    rows = [("s", "1", 1, "delta", "a"), ("s", "1", 0, "delta", "b"), ("s", "1", 2, "completed", ""), ("s", "2", 0, "delta", "x"), ("s", "3", 0, "cancelled", "")]
    got = {r["turn_id"]: (r["text"], r["error"]) for r in fold_turns(spark.createDataFrame(rows, "session_id string, turn_id string, seq long, kind string, text string")).collect()}
    assert got == {"1": ("ba", None), "2": (None, "incomplete_turn"), "3": (None, "cancelled")}


def test_turns_fail_by_what_comes_first(spark):
    big = "x" * (1 << 20)
    rows = [("s", "1", 0, "delta", "a"), ("s", "1", 1, "cancelled", ""), ("s", "1", 2, "delta", big)]
    rows += [("s", "2", 0, "delta", "a"), ("s", "2", 1, "delta", big), ("s", "2", 2, "cancelled", ""), ("s", "3", 0, "delta", big), ("s", "3", 1, "completed", None)]
    got = {r["turn_id"]: (r["text"], r["error"]) for r in fold_turns(spark.createDataFrame(rows, "session_id string, turn_id string, seq long, kind string, text string")).collect()}
    assert got == {"1": (None, "cancelled"), "2": (None, "output_too_large"), "3": (big, None)}


def test_context_of_positioned_documents(spark):
    from lodestone.operators import context

    one = lambda i, path, text, **more: {"doc_id": 1, "place": i, "priority": 0, "section_no": 1 if path == "Abstract" else 2, "section_id": f"S{1 if path == 'Abstract' else 2:04d}", "section_path": path, "parent_path": "", "reference_id": f"B{i:06d}", "block_id": f"b{i}", "kind": "para", "text": text, "candidate_label": None, "page": None, "role": None, "level": None, "bbox": None, "metadata": None, **more}
    rows = [one(1, "Abstract", "short"), one(2, "Abstract", "é" * 3000, page=2, role="figure_caption", level=1, bbox='{"rect":[0,0,1,1],"spans":[1]}'), one(3, "Rest", "z")]
    schema = "doc_id long, place long, priority int, section_no int, section_id string, section_path string, parent_path string, reference_id string, block_id string, kind string, text string, candidate_label string, page int, role string, level int, bbox string, metadata string"
    df = spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows], schema)
    got = {r["place"]: r for r in context.select_context(df, "extract").collect()}
    item = {"reference_id": "B000002", "block_id": "b2", "page": 2, "heading_path": "Abstract", "kind": "para", "role": "figure_caption", "bbox": {"rect": [0, 0, 1, 1]}, "text": "é" * 2000, "text_truncated": True, "candidate_label": None, "section_id": "S0001"}
    assert got[2]["cost"] == len(context.canonical(item)) + 1 and got[2]["truncated"] and got[2]["abstract"] and not got[3]["abstract"]
    cover = context.coverage(context.select_context(df, "extract")).first()
    assert (cover["total_blocks"], cover["truncated_blocks"], cover["omitted_sections"], cover["metadata_truncated"]) == (3, 1, 0, False)
    m, cut = context.bounded_metadata({"title": "t" * 5000, "authors": ["\n" * 300] * 40, "year": None})
    assert cut and len(context.canonical(m)) <= 3000 and m["title"] == "t" * 1000


def test_context_of_many_documents_is_one_pass(spark, monkeypatch):
    """documents pass Python as a stream; what is sent equals a plain walk, with hierarchies cut section by section."""
    import random

    from lodestone.operators import context

    r = random.Random(5)
    rows = []
    for doc in range(60):
        many = r.choice([1, 3, 40, 200])
        paths = ["".join(r.choices("ab é\"\\", k=r.choice([5, 200, 400]))) for _ in range(many)]
        for i in range(r.choice([1, 20, 300])):
            no = r.randrange(many)
            rows.append((doc, i + 1, no % 3, no + 1, f"S{no:04d}", paths[no] + ("Abstract" if no == 1 else ""), paths[0], f"B{i:06d}", f"b{i}", "para", r.choice(["x", "é" * 900, "y" * 2001]), None))
    cols = "doc_id long, place long, priority int, section_no int, section_id string, section_path string, parent_path string, reference_id string, block_id string, kind string, text string, candidate_label string"
    names = [c.split()[0] for c in cols.split(", ")]
    df = spark.createDataFrame(rows, cols).repartition(5)
    got = context.select_context(df, "extract")
    assert "MapInArrow" in got._jdf.queryExecution().toString() and "FlatMapGroups" not in got._jdf.queryExecution().toString()
    want = set()
    for doc in range(60):
        mine = [dict(zip(names, x)) for x in rows if x[0] == doc]
        firsts = {}
        for x in mine:
            firsts.setdefault(x["section_no"], x)
        heads = sorted(firsts.values(), key=lambda x: (x["priority"], x["section_no"]))[:160]
        shown = [{"id": x["section_id"], "heading_path": x["section_path"][:300], "level": None, "parent_path": x["parent_path"][:300]} for x in heads]
        frame = {"stage": "extract", "metadata": {}, "section_hierarchy": shown, "abstract_candidates": [], "blocks": [], "coverage": {}}
        while shown and len(context.canonical(frame)) > 16000:
            shown.pop()
        used, sent = len(context.canonical(frame)) + 600, []
        for x in mine:
            item = {"reference_id": x["reference_id"], "block_id": x["block_id"], "page": None, "heading_path": x["section_path"][:300], "kind": "para", "role": None, "bbox": None, "text": x["text"][:2000], "text_truncated": len(x["text"]) > 2000, "candidate_label": None, "section_id": x["section_id"]}
            cost = len(context.canonical(item)) + 1
            fits = used + cost <= 46000
            used += cost * fits
            sent.append((x["place"], fits, cost, item["text_truncated"], "abstract" in item["heading_path"].lower()))
        chosen = [x[0] for x in sent if x[1] and x[4]][:8] or [x[0] for x in sent if x[1]][:3]
        want |= {(doc, *x[:4], x[0] in chosen, len(firsts) - len(shown), False) for x in sent}
    assert {tuple(x) for x in got.collect()} == want
    assert context.coverage(got).count() == 60


def test_stream_equals_batch(spark, sf):
    from lodestone.queries import QUERIES
    from lodestone.streaming import analysed

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    batch = sorted(map(tuple, analysed(docs).collect()))
    assert sorted(map(tuple, QUERIES["stream_ingest_status"](spark, sf).collect())) == batch
