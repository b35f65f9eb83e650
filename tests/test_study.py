"""Full-text search, versions, maps of documents, citations, reviews, selections, streams and two-stage generation on small hard inputs."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F


# --- versions ---
def plain_rows(a, b):
    """The whole table, and the walk back that the module describes."""
    n, m = len(a), len(b)
    p = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n):
        for j in range(m):
            p[i + 1][j + 1] = p[i][j] + 1 if a[i] == b[j] else max(p[i][j + 1], p[i + 1][j])
    i, j, out = n, m, []
    while p[i][j]:
        v = p[i][j]
        j = min(k for k in range(m + 1) if p[i][k] == v)
        i = min(k for k in range(n + 1) if p[k][j] == v)
        out.append((i - 1, j - 1))
        i, j = i - 1, j - 1
    return out[::-1]


def test_common_rows_equal_the_plain_table():
    from lodestone.operators.versions import common_rows

    r = random.Random(1)
    for _ in range(1500):
        k = r.randint(1, 6)
        a, b = ([r.randint(0, k) for _ in range(r.randint(0, 14))] for _ in range(2))
        assert common_rows(a, b) == plain_rows(a, b)
    long = [r.randint(0, 50) for _ in range(8000)]
    kept = common_rows(long, [x for x in long if r.random() > 0.1])
    assert all(x < y and v < w for (x, v), (y, w) in zip(kept, kept[1:])) and len(kept) > 7000


def test_version_diff_of_hard_blocks(spark):
    from lodestone.operators.versions import carried, version_diff

    cols = "source_id string, id string, idx long, kind string, text string"
    old = spark.createDataFrame([("s", "a", 0, "para", "x"), ("s", "b", 1, "para", None), ("s", "c", 2, None, ""), ("s", "d", 3, "para", "old"), ("s", "e", 4, "para", "y"), ("gone", "g", 0, "para", "x")], cols)
    new = spark.createDataFrame([("s", "e2", 0, "para", "y"), ("s", "a2", 1, "para", "x"), ("s", "b2", 2, "para", ""), ("s", "c2", 3, "", ""), ("s", "d2", 4, "para", "new"), ("s", "f2", 5, "code", "z"), ("came", "h", 0, "para", None)], cols)
    diff = version_diff(old, new)
    got = {(r["source_id"], r["change"], r["old_id"], r["new_id"]) for r in diff.collect()}
    assert got == {("s", "kept", "a", "a2"), ("s", "kept", "b", "b2"), ("s", "kept", "c", "c2"), ("s", "edited", "d", "d2"), ("s", "moved", "e", "e2"), ("s", "added", None, "f2"), ("gone", "removed", "g", None), ("came", "added", None, "h")}
    anchors = spark.createDataFrame([("1", "s", "d"), ("2", "s", "zz"), ("3", "gone", "g"), ("4", "s", None)], "anchor_id string, source_id string, block_id string")
    assert {(r["anchor_id"], r["carry"], r["new_block_id"]) for r in carried(anchors, diff).collect()} == {("1", "edited", "d2"), ("2", "lost", None), ("3", "lost", None), ("4", "lost", None)}
    assert version_diff(old.limit(0), new.limit(0)).count() == 0


# --- full text ---
def test_index_of_hard_units(spark, tmp_path):
    from lodestone.operators.fulltext import Index, build

    cols = "unit_id string, kind string, source_id string, text string"
    build(spark.createDataFrame([("u1", "block", "s", "The cat, the CAT; the dog"), ("u2", "block", "s", None), ("u3", "note", "s", ""), ("u4", "note", "t", "éa ÉA 12"), ("u5", "note", "t", "a a a a")], cols), str(tmp_path))
    index = Index(spark, str(tmp_path))
    found = lambda i, q: {(r["unit_id"], r["n_hits"], r["first"]) for r in i.phrase(q).collect()}
    assert found(index, "the  Cat") == {("u1", 2, 0)}
    assert found(index, "a a") == {("u5", 3, 0)}
    assert found(index, "Éa éa 12") == {("u4", 1, 0)}
    assert found(index, "cat dog") == set() == found(index, "...") == found(index, "absent")
    build(spark.createDataFrame([("u9", "note", "t", "more of the cat")], cols), str(tmp_path))
    index, notes = Index(spark, str(tmp_path)), Index(spark, str(tmp_path), ["note"])
    assert found(index, "the cat") == {("u1", 2, 0), ("u9", 1, 2)} and found(notes, "the cat") == {("u9", 1, 2)}
    asked = spark.createDataFrame([(1, "the cat"), (2, "zzz"), (3, None)], "query_id long, text string")
    assert {(r["query_id"], r["unit_id"], r["n_hits"]) for r in index.phrases(asked).collect()} == {(1, "u1", 2), (1, "u9", 1)}
    best = index.bm25(asked, most=1).collect()
    assert [(r["query_id"], r["rank"], r["unit_id"]) for r in best] == [(1, 1, "u1")]


def test_index_is_smaller_than_its_texts(spark, sf, tmp_path):
    """positions are a byte or two each, and are dealt over the files as such."""
    from lodestone.operators.fulltext import Index, build, decoded, encoded

    r = random.Random(3)
    for many in (0, 1, 500):
        numbers = [r.randrange(1 << r.randrange(1, 33)) for _ in range(many)]
        data, ends = encoded(__import__("numpy").array(numbers, "int64"))
        assert decoded(data.tobytes()).tolist() == numbers and len(ends) == many
    d = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").cast("string").alias("unit_id"), F.lit("text").alias("kind"), F.col("source").alias("source_id"), "text")
    build(d, str(tmp_path))
    size = sum(p.stat().st_size for p in tmp_path.rglob("*.parquet"))
    texts = d.agg(F.sum(F.octet_length("text"))).first()[0]
    assert size < texts, (size, texts)
    assert Index(spark, str(tmp_path)).postings.agg(F.sum("n")).first()[0] == d.agg(F.sum(F.size(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), 0)))).first()[0]


def test_ranked_search_equals_plain_sums_over_many_shards(spark, tmp_path, monkeypatch):
    """scores are added shard by shard; shards, kinds and parts change no score, and ties go to the smaller id."""
    import math

    from lodestone.operators import fulltext

    monkeypatch.setattr(fulltext, "SHARD_UNITS", 7)
    r = random.Random(4)
    words = ["a", "b", "c", "d", "straße", "x1", "longer"]
    units = [(f"u{k}", r.choice(["block", "note"]), "s", " ".join(r.choices(words, [9, 7, 5, 3, 2, 1, 1], k=r.randint(0, 9)))) for k in range(150)]
    fulltext.build(spark.createDataFrame(units, "unit_id string, kind string, source_id string, text string").repartition(3), str(tmp_path))
    asked = [(k, " ".join(r.choices(words, k=r.randint(1, 4)))) for k in range(20)]
    queries = spark.createDataFrame(asked, "query_id long, text string")
    for kinds in (None, ["note"]):
        index = fulltext.Index(spark, str(tmp_path), kinds)
        own = {u: t.split() for u, kind, _, t in units if kinds is None or kind in kinds}
        df = Counter(w for t in own.values() for w in set(t))
        mean = sum(map(len, own.values())) / len(own)
        want, hits = set(), set()
        for q, text in asked:
            score = {u: sum(math.log(1 + (len(own) - df[w] + 0.5) / (df[w] + 0.5)) * t.count(w) * 2.2 / (t.count(w) + 1.2 * (0.25 + 0.75 * len(t) / mean)) for w in sorted(set(text.split())) if w in t) for u, t in own.items() if set(text.split()) & set(t)}
            best = sorted((-math.floor(x * 1e6 + 0.5), u) for u, x in score.items())[:10]
            want |= {(q, n, u, -x / 1e6) for n, (x, u) in enumerate(best, 1)}
            p = text.split()
            for u, t in own.items():
                at = [i for i in range(len(t)) if t[i : i + len(p)] == p]
                hits |= {(q, u, len(at), at[0])} if at else set()
        assert {(x["query_id"], x["rank"], x["unit_id"], x["score"]) for x in index.bm25(queries).collect()} == want
        assert {(x["query_id"], x["unit_id"], x["n_hits"], x["first"]) for x in index.phrases(queries).collect()} == hits


def test_search_reads_only_folders_of_its_terms(spark, sf, tmp_path):
    from lodestone.operators.fulltext import Index, build

    d = spark.read.parquet(f"{sf}/documents.parquet")
    build(d.select(F.col("doc_id").cast("string").alias("unit_id"), F.lit("text").alias("kind"), "source", "text").withColumnRenamed("source", "source_id"), str(tmp_path))
    q = Index(spark, str(tmp_path)).phrase("the and")
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket#", "[bucket#") or re.search(r"PartitionFilters: \[.*bucket#\d+ IN|PartitionFilters: \[.*bucket#", plan)
    assert re.search(r"PushedFilters: \[[^\]]*term", plan)
    want = {str(r["doc_id"]): len(re.findall(r"(?=(?<![^\W_])the[\W_]+and(?![^\W_]))", r["text"].lower())) for r in d.collect()}
    assert {r["unit_id"]: r["n_hits"] for r in q.collect()} == {k: n for k, n in want.items() if n}


# --- maps ---
def test_outline_of_skipped_and_missing_levels(spark):
    from lodestone.operators.outline import figures, outline

    rows = [(1, 0, "para", None, "front"), (1, 1, "heading", 2, "A"), (1, 2, "para", None, "xx"), (1, 3, "heading", 4, "B"), (1, 4, "heading", 3, "C"), (1, 5, "heading", None, " D "), (1, 6, "para", None, None), (1, 7, "heading", 9, "E"), (2, 0, "para", None, "none")]
    b = spark.createDataFrame(rows, "doc_id long, idx long, kind string, level int, text string")
    got = {r["title"]: r.asDict() for r in outline(b).collect()}
    tree = {k: (v["depth"], v["parent_idx"], v["lft"], v["rgt"], v["end_idx"], v["blocks"], v["characters"]) for k, v in got.items()}
    assert tree == {"A": (0, None, 1, 6, 5, 4, 5), "B": (1, 1, 2, 3, 4, 1, 1), "C": (1, 1, 4, 5, 5, 1, 1), "D": (0, None, 7, 10, 8, 3, 4), "E": (1, 5, 8, 9, 8, 1, 1)}
    marks = spark.createDataFrame([(1, 2, 3, 0), (1, 7, 1, 2)], "doc_id long, idx long, notes long, anchors long")
    assert {r["title"]: (r["notes"], r["anchors"]) for r in outline(b, marks).collect()} == {"A": (3, 0), "B": (0, 0), "C": (0, 0), "D": (1, 2), "E": (1, 2)}
    c = spark.createDataFrame([(1, 0, "para", " Fig. 2 x"), (1, 1, "heading", "H"), (1, 2, "para", "table 3b y"), (1, 3, "para", "Figures"), (1, 4, "para", None)], "doc_id long, idx long, kind string, text string")
    assert [tuple(r)[1:] for r in figures(c).orderBy("idx").collect()] == [("Fig. 2", "figure", 1, 0, "Fig. 2 x", None), ("table 3b", "table", 1, 2, "table 3b y", 1)]


# --- citations ---
def test_citations_in_any_spelling(spark):
    from lodestone.operators.citations import cocited, edges, ranked

    known = spark.createDataFrame([("a", "10.1000/X1", None), ("b", None, "https://arxiv.org/abs/2401.00001v3"), ("c", "doi: 10.1000/x3", ""), ("d", "", None)], "id string, doi string, arxiv_id string")
    texts = spark.createDataFrame([("a", "see https://doi.org/10.1000/x3, and 10.1000/x1."), ("b", "arXiv:2401.00001 (10.1000/x1) 10.1000/x1"), ("c", None), ("d", "http://arxiv.org/pdf/2401.00001v1 10.1000/x1; 10.1000/X3.")], "id string, text string")
    e = edges(texts, known)
    assert {tuple(r) for r in e.collect()} == {("a", "c"), ("b", "a"), ("d", "b"), ("d", "a"), ("d", "c")}
    wanted = known.filter("id IN ('a', 'd')").select("id")
    assert [tuple(r) for r in cocited(e, wanted).orderBy("rank").collect()] == [("a", 1, "b", 1), ("a", 2, "c", 1)]
    rank = {r["id"]: r["rank"] for r in ranked(e, known.select("id"), rounds=30).collect()}
    assert abs(sum(rank.values()) - 1) < 1e-6 and max(rank, key=rank.get) == "c"
    out = {"a": ["c"], "b": ["a"], "c": [], "d": ["a", "b", "c"]}
    r = dict.fromkeys(out, 0.25)
    for _ in range(30):
        loose = r["c"]
        r = {k: 0.15 / 4 + 0.85 * (sum(r[s] / len(t) for s, t in out.items() if k in t) + loose / 4) for k in out}
    assert all(abs(rank[k] - r[k]) < 1e-8 for k in r)


# --- reviews ---
def test_reviews_equal_a_plain_fold(spark):
    from lodestone.operators.reviews import folded

    r = random.Random(6)
    rows = [(f"s{r.randint(0, 5)}", f"2024-01-{r.randint(1, 28):02d} 00:00:00", n, r.randint(-1, 7)) for n in range(120)] + [(None, "2024-01-01 00:00:00", 999, 3), ("s0", None, 998, 3), ("s0", "2024-01-01 00:00:00", 997, None)]
    df = spark.createDataFrame(rows, "source_id string, at string, seq long, grade int").withColumn("at", F.to_timestamp("at"))
    want = {}
    for s, at, n, grade in sorted((x for x in rows if None not in x), key=lambda x: (x[1], x[2])):
        g = min(5, max(0, grade))
        ease, reps, days, lapses, seen = want.get(s, (2500, 0, 0, 0, 0))
        reps = reps + 1 if g >= 3 else 0
        days = 1 if g < 3 or reps == 1 else 6 if reps == 2 else min(36500, (days * ease + 500) // 1000)
        want[s] = (max(1300, ease + 100 - (5 - g) * (80 + (5 - g) * 20)), reps, days, lapses + (g < 3), seen + 1)
    got = {x["source_id"]: (x["ease"], x["days"], x["lapses"], x["n_reviews"]) for x in folded(df).collect()}
    assert got == {s: (e, d, l, n) for s, (e, _, d, l, n) in want.items()}


# --- selections ---
@pytest.mark.parametrize("turn", [0, 90, 180, 270])
def test_selections_return_to_where_they_were_drawn(spark, turn):
    """A rectangle of the page is drawn as it is shown, turned, and found again."""
    from lodestone.functions.geometry import selection, valid

    w, h, scale, left, top = 600.0, 800.0, 1.5, 7.0, 9.0
    x0, y0, x1, y1 = 30.0, 50.0, 130.0, 62.0
    corners = {0: lambda x, y: (x, y), 90: lambda x, y: (h - y, x), 180: lambda x, y: (w - x, h - y), 270: lambda x, y: (y, w - x)}[turn]
    (a, b), (c, d) = corners(x0, y0), corners(x1, y1)
    shown = (w, h) if turn % 180 == 0 else (h, w)
    on_screen = [left + min(a, c) * scale, top + min(b, d) * scale, left + max(a, c) * scale, top + max(b, d) * scale]
    bounds = [left, top, left + shown[0] * scale, top + shown[1] * scale]
    rows = spark.createDataFrame([([on_screen, [1.0, 1.0, 1.0, 5.0]],), ([[bounds[0] - 50, bounds[1] - 50, bounds[2] + 50, bounds[3] + 50]],), ([[5.0, 5.0, 5.0, 9.0]],), ([],)], "r array<array<double>>")
    g = selection(F.col("r"), F.array(*map(F.lit, bounds)), F.array(*map(F.lit, [100.0, 200.0, 700.0, 1000.0])), F.lit(turn))
    got = rows.select(g.alias("g")).select("g", valid(F.col("g")).alias("ok")).collect()
    assert all(abs(p - q) < 1e-9 for p, q in zip(got[0]["g"]["rect"], [x0, y0, x1, y1])) and got[0]["ok"] and got[0]["g"]["rotation"] == turn
    assert got[1]["g"]["rect"] == [0.0, 0.0, w, h] and got[2]["g"] is None and got[3]["g"] is None


# --- activity ---
def test_the_last_event_of_a_highlight_counts(spark):
    from lodestone.operators.catalog import highlighted_view, living_highlights, opened

    cols = "id string, source_id string, block_id string, action string, color string, comment string, at string, seq int"
    log = spark.createDataFrame([("h1", "s", "b", "add", "yellow", None, "1", 0), ("h1", "s", "b", "edit", None, "why", "2", 0), ("h2", "s", "b", "add", "red", None, "1", 1), ("h2", "s", "b", "delete", None, None, "1", 2), ("h3", "s", "c", "delete", None, None, "1", 0), ("h3", "s", "c", "add", "blue", None, "2", 0)], cols)
    view = spark.createDataFrame([("b", 0), ("x", 1), (None, 2), ("c", 3)], "id string, idx int")
    got = {r["idx"]: [tuple(h) for h in r["highlights"]] for r in highlighted_view(view, living_highlights(log)).collect()}
    assert got == {0: [("h1", "yellow", "why")], 1: [], 2: [], 3: [("h3", "blue", None)]}
    opens = spark.createDataFrame([("s", "open", "1"), ("s", "open", "3"), ("s", "close", "9"), ("t", "close", "1")], "source_id string, action string, at string")
    assert [tuple(r) for r in opened(opens).collect()] == [("s", "3")]


# --- web pages ---
def test_main_content_by_text_density(spark, sf):
    from lodestone import queries as Q

    want, got = (Counter(tuple(r) for r in Q.QUERIES[name](spark, sf).collect()) for name in ("html_blocks", "html_density"))
    prose = {r[0] for r in want if len(r[4]) >= 25}  # an article without prose can't be told from a note
    assert len(prose) > 40
    assert Counter({r: n for r, n in got.items() if r[0] in prose}) == Counter({r: n for r, n in want.items() if r[0] in prose})


def test_density_on_labelled_pages():
    from lodestone.operators.parse import read_page

    prose = "<p>A long enough sentence, with commas, that speaks for its container, and more of it follows here.</p>"
    links = "".join(f'<li><a href="/{i}">A link with a rather long text, of the kind that menus have</a></li>' for i in range(30))
    texts = lambda html: [t for _, t in read_page(html)[1]]
    page = f"<body><div><ul>{links}</ul></div><div id=x><h2>Head</h2>{prose}{prose[:-4]} Again.</p></div><div><p>Footer words of some length, here.</p></div></body>"
    assert [t[:6] for t in texts(page)] == ["Head", "A long", "A long"]
    assert texts("<p>Short.</p><li>one</li>") == ["Short.", "one"]  # no prose: all outside menus
    assert texts("") == [] == texts("plain")


def test_containers_equal_a_plain_tree_walk():
    """Points added from the leaves of a tree that the test builds by itself."""
    from lodestone.operators.parse import PROSE, _Page, main_container

    r = random.Random(9)
    for _ in range(200):
        def node(depth):
            if depth == 0 or r.random() < 0.3:
                n = r.choice([5, 30, 130])
                return ("p", "".join(r.choice("ab ,") for _ in range(n)).strip(" ,") or "x")
            return ("a" if r.random() < 0.2 else "div", [node(depth - 1) for _ in range(r.randint(1, 3))])

        tree = ("div", [node(3) for _ in range(3)])
        html = lambda t: f"<{t[0]}>{t[1] if isinstance(t[1], str) else ''.join(map(html, t[1]))}</{t[0]}>"
        page = _Page()
        page.feed(html(tree))
        page.close()
        order, parents, chars, linked, points = [], {}, {}, {}, {}

        def walk(t, parent, in_link):
            me = len(order)
            order.append(t)
            parents[me] = parent
            in_link = in_link or t[0] == "a"
            if isinstance(t[1], str):
                chars[me] = len(t[1].strip())
                linked[me] = chars[me] if in_link else 0
                text = re.sub(r"\s+", " ", t[1]).strip()
                if len(text) >= PROSE:
                    given = 1 + text.count(",") + min(3, len(text) // 100)
                    for up, share in ((parent, 1), (parents.get(parent, -1), 0.5)):
                        if up >= 0:
                            points[up] = points.get(up, 0) + given * share
            else:
                below = [walk(c, me, in_link) for c in t[1]]
                chars[me], linked[me] = sum(chars[c] for c in below), sum(linked[c] for c in below)
            return me

        walk(tree, -1, False)
        best = max(points, key=lambda i: (points[i] * (1 - linked[i] / max(1, chars[i])), -i), default=-1)
        if best >= 0 and linked[best] == chars[best]:
            best = -1
        assert main_container(page.nodes, [b for b in page.blocks if b["leaf"]]) == best


# --- streams ---
def _events(spark, rows):
    return spark.createDataFrame(rows, "session_id string, turn_id string, seq long, kind string, text string, at long").select("session_id", "turn_id", "seq", "kind", "text", F.timestamp_seconds("at").alias("ts"))


def test_turns_by_state_in_small_feeds(spark, tmp_path):
    """Each feed is a run of its own from the checkpoint; results equal the fold of all events, and no state is left of closed turns."""
    from lodestone.streaming import fold_turns
    from lodestone.streaming.turns import fold_feed

    r = random.Random(2)
    turns = []
    for t in range(14):
        rows = [("s", str(t), n, "delta", r.choice(["a", "", None, "bc"]), 0) for n in range(r.randint(1, 6))]
        end = t % 4
        if end in (0, 1):
            rows.append(("s", str(t), 100, "completed", None, 0))
        if end in (1, 2):
            rows.append(("s", str(t), 100, "cancelled", None, 0))
        turns.append(rows)
    every = [e for rows in turns for e in rows]
    feeds = [[(*e[:5], 10 * (k + 1)) for e in every if (0 if e[2] < 2 else 1 if e[2] < 100 else 2) == k] for k in range(3)]
    feeds.append([("clock", "0", 0, "delta", "", 100_000)])
    base = str(tmp_path)
    for n, feed in enumerate(feeds):
        _events(spark, feed).write.parquet(f"{base}/in/feed={n}")
        stream = spark.readStream.schema("session_id string, turn_id string, seq long, kind string, text string, ts timestamp").parquet(f"{base}/in").drop("feed")
        fold_feed(stream, f"{base}/out", f"{base}/state")
    plain = lambda df: sorted(tuple("~" if v is None else v for v in x) for x in df.select("session_id", "turn_id", "text", "error").collect())
    got = plain(spark.read.parquet(f"{base}/out"))
    assert got == plain(fold_turns(_events(spark, [(*e[:4], e[4] or "", 0) for e in every])))
    state = spark.read.format("statestore").option("path", f"{base}/state").option("stateVarName", "turn").load().select("key.turn_id", "value.closed").collect()
    assert [tuple(x) for x in state] == [("0", False)]  # the clock's own turn alone


def test_states_of_poisoned_and_repeated_documents(spark, tmp_path):
    from lodestone.streaming.states import current, ingest_states

    def analyse(text):
        if "poison" in text:
            raise RuntimeError("x" * 900)
        return text.upper()

    base = str(tmp_path)
    cols = "source_id string, text string, at long"
    feeds = [[("a", "fine", 0), ("b", "poison", 0), ("c", None, 0), (None, "no id", 0), ("a", "fine", 1)], [("a", "fine", 5), ("b", "poison", 6), ("d", "later", 7)], [("a", "changed", 9)]]
    before = None
    for n, feed in enumerate(feeds):
        spark.createDataFrame(feed, cols).select("source_id", "text", F.timestamp_seconds(F.col("at") + 1_704_067_200).alias("sent_at")).write.parquet(f"{base}/in/feed={n}")
        for _ in range(2):  # the second run finds nothing new
            stream = spark.readStream.schema("source_id string, text string, sent_at timestamp").parquet(f"{base}/in")
            ingest_states(stream, f"{base}/log", f"{base}/state", analyse).awaitTermination()
        before = {r["source_id"]: (r["state"], r["one_line_summary"], r["n_states"]) for r in current(spark, f"{base}/log").collect()}
        if n == 1:
            assert before == {"a": ("done", "FINE", 3), "b": ("failed", None, 3), "c": ("done", "", 3), "d": ("done", "LATER", 3)}
    assert before["a"] == ("done", "CHANGED", 6)
    assert [len(r["error"]) for r in current(spark, f"{base}/log").filter("state = 'failed'").collect()] == [500]


# --- two stages ---
def test_two_stages_ask_again_only_where_needed(spark):
    from lodestone.operators.two_stage import generated

    blocks = spark.createDataFrame([(j, "T", 0, "B1", "S1", "heading", "T") for j in "abcd"] + [(j, "T", 1, "B2", "S2", "para", "body text") for j in "abcd"], "job_id string, title string, place int, reference_id string, section_id string, kind string, text string")
    asked = []
    field = '{"fields":[{"name":"paper_type","value":"v","status":"confirmed","evidence":["%s"]}],"section_ids":[%s]}'

    def provider(requests):
        rows = requests.collect()
        asked.extend((r["job_id"], r["stage"], r["attempt"], "not valid" in r["instructions"]) for r in rows)
        out = []
        for r in rows:
            if r["stage"] == "classify":
                reply = {"a": field % ("B2", ""), "b": field % ("B1", '"S2"'), "c": "[]" if r["attempt"] == 1 else field % ("B9", ""), "d": None}[r["job_id"]]
                out.append((r["job_id"], reply, r["job_id"] == "d"))
            else:
                assert r["job_id"] != "b" or "S1" not in r["context"]
                out.append((r["job_id"], '{"fields":[{"name":"method","value":"m","status":"confirmed","evidence":[]}]}', None))
        return spark.createDataFrame(out, "job_id string, reply string, failed boolean")

    fields, tries, outcome = generated(blocks, provider, ["paper_type", "method", "results"])
    assert {tuple(r) for r in outcome.collect()} == {("a", "preview"), ("b", "preview"), ("c", "invalid_output"), ("d", "runtime_failed")}
    assert {tuple(r) for r in tries.collect()} == {("a", "classify", 1, None), ("b", "classify", 1, None), ("c", "classify", 1, "invalid_json"), ("c", "classify", 2, "unknown_evidence"), ("d", "classify", 1, "runtime_failed"), ("a", "extract", 1, None), ("b", "extract", 1, None)}
    assert {(r["job_id"], r["field_name"], r["status"]) for r in fields.collect()} == {("a", "paper_type", "confirmed"), ("b", "paper_type", "uncertain"), *[(j, n, s) for j in "ab" for n, s in (("method", "uncertain"), ("results", "not_reported"))]}
    assert set(asked) == {(j, "classify", 1, False) for j in "abcd"} | {("c", "classify", 2, True), ("a", "extract", 1, False), ("b", "extract", 1, False)}


# --- imports and edits ---
_EVIDENCE = "quote string, prefix string, suffix string, page int, bbox string, source_hash string, figure_label string, table_label string"


def test_previews_of_packages_in_each_state(spark):
    from lodestone.operators.imports import preview

    ident = "title string, authors array<string>, year int, doi string, arxiv_id string"
    packages = spark.createDataFrame([("p1", "h1", None, "x", [], None, "10.1000/a", None, None), ("p2", "h2", "nowhere", "x", [], None, "10.1000/a", None, None), ("p3", "h3", "b", "y", None, None, None, None, None), ("p4", "h4", None, "z", [], None, None, None, None)], f"package_id string, payload_hash string, chosen string, {ident}, source_hash string")
    sources = spark.createDataFrame([("a", "A", ["n"], 2000, "10.1000/A", None, None), ("b", "B", ["n"], 2001, None, None, None)], f"id string, {ident}, content_hash string")
    versions = spark.createDataFrame([("a1", "a", "2023", 1, None), ("a2", "a", "2024", 1, None), ("b1", "b", "2024", 1, None)], "id string, source_id string, fetched_at string, seq int, content_hash string")
    blocks = spark.createDataFrame([("a1", "x0", 0, "old words here"), ("a2", "y0", 0, "new words here"), ("a2", "y1", 1, "twice twice"), ("b1", "z0", 0, "of the other")], "version_id string, id string, idx long, text string")
    none = (None,) * 7
    evidence = spark.createDataFrame([("p1", "e1", "new  words here", *none), ("p1", "e2", "twice", *none), ("p1", "e3", "old words here", *none), ("p2", "e1", "new words here", *none), ("p3", "e1", "of the other", *none)], f"package_id string, evidence_id string, {_EVIDENCE}")
    rest = ("[]", "chatgpt_import", False, "{}")
    fields = spark.createDataFrame([("p1", "problem", ["e1"], '"v"', "confirmed", *rest), ("p1", "method", ["e1", "e2"], '"v"', "confirmed", *rest), ("p1", "results", ["e3"], '"v"', "derived", *rest), ("p2", "problem", ["e1"], '"v"', "confirmed", *rest), ("p3", "problem", ["e1"], '"v"', "confirmed", *rest), ("p4", "problem", [], '"v"', "not_reported", *rest)], "package_id string, field_name string, refs array<string>, value_json string, status string, evidence_json string, origin string, user_edited boolean, provenance_json string")
    current = spark.createDataFrame([("a", "problem", '"w"', "confirmed", "[]", "user", False, "{}")], "source_id string, field_name string, value_json string, status string, evidence_json string, origin string, user_edited boolean, provenance_json string")
    ledger = spark.createDataFrame([("q", "h3")], "package_id string, payload_hash string")
    p = preview(packages, fields, evidence, sources, versions, blocks, current, ledger)
    got = {r["package_id"]: (r["source_id"], r["method"], r["can_commit"], r["review_reasons"], r["selected"], r["warnings"], r["resolved"], r["candidates"], r["unresolved"]) for r in p.packages.collect()}
    assert got == {
        "p1": ("a", "doi", True, "evidence_needs_review,field_conflicts", 2, 1, 1, 1, 1),
        "p2": (None, "doi", False, "manual_source_selection_required,evidence_needs_review", 1, 1, 0, 0, 1),
        "p3": ("b", None, False, "duplicate_import,manual_source_selection", 1, 0, 1, 0, 0),
        "p4": (None, None, False, "manual_source_selection_required", 1, 0, 0, 0, 0),
    }
    assert {(r["package_id"], r["field_name"], r["status"], r["action"]) for r in p.fields.filter("package_id = 'p1'").collect()} == {("p1", "problem", "confirmed", "preserve_user"), ("p1", "method", "uncertain", "add"), ("p1", "results", "derived", "add")}
    assert {r["reason"] for r in p.evidence.filter("package_id = 'p2'").collect()} == {"source_not_selected"}


def test_edits_count_on_the_latest_version(spark):
    from lodestone.operators.generation import edited

    versions = spark.createDataFrame([("v1", "s", "2023", 1, None), ("v2", "s", "2024", 1, None)], "id string, source_id string, fetched_at string, seq int, content_hash string")
    blocks = spark.createDataFrame([("v1", "a", 0, "gone since then"), ("v2", "b", 0, "here to stay")], "version_id string, id string, idx long, text string")
    known = spark.createDataFrame([("s", "f", "old", "gone since then", *(None,) * 7), ("s", "f", "new", "here to stay", *(None,) * 7), ("s", "g", "new", "here to stay", *(None,) * 7), ("t", "f", "x", "here to stay", *(None,) * 7)], f"source_id string, field_name string, evidence_id string, {_EVIDENCE}")
    edits = spark.createDataFrame([("s", "f", '"1"', "confirmed", ["old", "new"]), ("s", "g", '"2"', "confirmed", ["new"]), ("s", "h", '"3"', "confirmed", ["new"]), ("s", "i", '"4"', "derived", []), ("t", "f", '"5"', "confirmed", ["x"])], "source_id string, field_name string, value_json string, status string, refs array<string>")
    got = {(r["source_id"], r["field_name"]): (r["status"], r["refused"]) for r in edited(edits, known, versions, blocks).collect()}
    assert got == {("s", "f"): ("uncertain", None), ("s", "g"): ("confirmed", None), ("s", "h"): (None, "unknown_evidence"), ("s", "i"): ("derived", None), ("t", "f"): ("uncertain", None)}
