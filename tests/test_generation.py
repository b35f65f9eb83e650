import pytest

from lodestone.operators import brief, generation, qa
from lodestone.sources.store import HistoryError, StaleWrite, Store, pending


def test_rejections_in_their_order(spark):
    base = ("f", ["e1"], ["r1"], False, [])
    rows = {"ok": base, "dup": base, "unk": ("f", ["nope"], [], False, []), "res": ("f", ["e1"], ["r", "r"], False, []), "plain": ("f", ["e1"], [], True, []), "quote": base, "cap": ("f", ["e1"], [], False, [("Table 1", ["e1"])]), "cap_ok": ("f", ["e1"], [], False, [("figure 2", ["e1"])]), "blk": base}
    fields = spark.createDataFrame([(j, *r) for j, r in rows.items()], "job_id string, field_name string, refs array<string>, result_ids array<string>, plain_items boolean, labels array<struct<label:string,refs:array<string>>>")
    ev = [(j, "e1", "B1", None, None, None) for j in rows if j not in ("quote", "blk")]
    ev += [("quote", "e1", "B1", "other words", None, None), ("blk", "e1", "B9", None, None, None), ("dup", "e1", "B1", None, None, None)]
    evidence = spark.createDataFrame(ev, "job_id string, evidence_id string, block_ref string, quote string, prefix string, suffix string")
    context = spark.createDataFrame([(j, "B1", "Figure 2. A  plot") for j in rows], "job_id string, reference_id string, text string")
    got = {r["job_id"]: r["code"] for r in generation.rejected(fields, evidence, context).collect()}
    assert got == {"dup": "invalid_evidence", "unk": "unknown_evidence", "res": "duplicate_result", "plain": "structured_visual_reference_required", "quote": "block_quote_mismatch", "cap": "visual_caption_mismatch", "blk": "unknown_block_reference"}


def test_jobs(spark):
    jobs = spark.createDataFrame([("a", "s", "generating", "x"), ("b", "t", "preview", "x"), ("c", "u", "generating", "x")], "job_id string, source_id string, state string, snapshot string")
    r = spark.createDataFrame([("n1", "s"), ("n2", "t"), ("n3", "t")], "job_id string, source_id string")
    assert {x["job_id"]: x["allowed"] for x in generation.startable(r, jobs).collect()} == {"n1": False, "n2": True, "n3": False}
    now = spark.createDataFrame([("s", "x"), ("u", "y")], "source_id string, current string")
    assert {x["job_id"]: (x["state"], x["error"]) for x in generation.published(jobs, now).collect()} == {"a": ("preview", None), "b": ("preview", None), "c": ("failed", "source_changed")}


def test_user_edits_reuse_evidence(spark):
    e = spark.createDataFrame([("s", "a", ["x"]), ("s", "b", ["y"]), ("s", "c", [])], "source_id string, field_name string, refs array<string>")
    k = spark.createDataFrame([("s", "a", "x"), ("s", "a", "y")], "source_id string, field_name string, evidence_id string")
    assert {r["field_name"]: r["allowed"] for r in generation.user_edits(e, k).collect()} == {"a": True, "b": False, "c": True}


def test_store(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    assert s.version("t") == 0
    assert s.write("t", spark.range(2), expected=0) == 1
    assert s.write("t", spark.range(3)) == 2 and s.read("t").count() == 3
    with pytest.raises(StaleWrite):
        s.write("t", spark.range(1), expected=1)
    assert s.read("t").count() == 3
    known = [(1, "base"), (2, "more")]
    have = lambda *rows: spark.createDataFrame(list(rows), "version int, name string")
    assert pending(have(), known) == known and pending(have((1, "base")), known) == [(2, "more")]
    for bad in (have((2, "more")), have((1, "other")), have((1, "base"), (2, "more"), (3, "new"))):
        with pytest.raises(HistoryError):
            pending(bad, known)


def test_asked(spark):
    s = spark.createDataFrame([("s", "T")], "id string, title string")
    v = spark.createDataFrame([("v", "s")], "id string, source_id string")
    b = spark.createDataFrame([("v", f"b{i}", i, f"text {i}", "H") for i in range(5)], "version_id string, id string, idx long, text string, heading_path string")
    k = spark.createDataFrame([], "id string, source_id string, section_key string, title string, content string, updated_at string")
    q = spark.createDataFrame([("1", "s", "critique", "critique", "picked", "text 2", "v", "b2", None), ("2", "s", "why?", "critique", None, "gone", None, None, None)], "question_id string, source_id string, question_text string, prompt_type string, selection_text string, quote string, source_version string, block_id string, block_idx long")
    got = {r["question_id"]: r for r in qa.asked(q, s, v, b, k, {"critique": "What is weak?"}).collect()}
    assert got["1"]["question"] == "What is weak?" and "text 0\ntext 1\n---SELECTION---\npicked\n---\ntext 3\ntext 4" in got["1"]["prompt"]
    assert "> picked" in got["1"]["answer"] and '"before_chars":13' in got["1"]["context_summary"]
    assert got["2"]["question"] == "why?" and qa.NOTHING in got["2"]["prompt"] and qa.NO_PLACE in got["2"]["prompt"]


def test_quick_view_follows_the_paper_type(spark):
    f = spark.createDataFrame([("s", "paper_type", '"survey"', "derived"), ("s", "problem", '"p"', "derived"), ("t", "problem", '"p"', "derived")], "source_id string, field_name string, value_json string, status string")
    rows = brief.quick_view(f).orderBy("source_id", "ord").collect()
    assert [r["field_name"] for r in rows if r["source_id"] == "s"] == [*brief.QUICK, *brief.BY_TYPE["survey"]]
    assert [r["field_name"] for r in rows if r["source_id"] == "t"] == [*brief.QUICK, *brief.BY_TYPE[""]]
    assert sum(r["status"] is not None for r in rows) == 3
