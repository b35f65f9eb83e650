"""Closed vocabularies, the note template and integrity checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Vocabularies, labels and limits that results depend on.
SOURCE_TYPES = ["pdf", "web", "text", "markdown"]
READING_STATUS = ["unread", "reading", "read", "recheck"]
ANALYSIS_STATUS = ["pending", "running", "done", "error", "skipped"]
BLOCK_KINDS = ["heading", "para", "code", "quote", "list", "table", "figure"]
ORIGINS = ["source_quote", "llm", "llm_edited", "user", "auto_extract"]
INFO_TYPES = ["fact", "claim", "result", "llm_summary", "llm_interpretation", "user_thought", "open_question", "idea", "term", "action", "translation"]
VERIFICATIONS = ["unverified", "verified", "disputed"]
BRIEF_STATUS = ["confirmed", "derived", "uncertain", "not_reported", "not_applicable"]
BRIEF_ORIGINS = ["source", "llm", "auto_extract", "chatgpt_import", "user"]
RESOLUTIONS = ["resolved", "candidates", "page_only", "unresolved"]
NOTE_TEMPLATE = [
    ("background", "研究背景・課題"),
    ("method", "提案手法"),
    ("experiments", "実験・結果"),
    ("novelty", "新規性・既存研究との差分"),
    ("limitations", "制約・弱点"),
    ("terms", "用語"),
    ("insights", "自分の考察"),
    ("applications", "応用・実装アイデア"),
    ("questions", "未解決の疑問"),
    ("actions", "次のアクション"),
    ("misc", "その他"),
]
ORIGIN_LABELS = {"source_quote": "原文", "auto_extract": "AI自動抽出", "llm": "AI回答", "llm_edited": "AI回答(ユーザー編集済)", "user": "ユーザー"}
INFO_LABELS = {
    "fact": "事実",
    "claim": "著者の主張",
    "result": "実験結果",
    "llm_summary": "AI要約",
    "llm_interpretation": "AI解釈",
    "user_thought": "考察",
    "open_question": "未解決",
    "idea": "アイデア",
    "term": "用語",
    "action": "アクション",
    "translation": "翻訳",
}
SAVE_TARGETS = {"critique": ("limitations", "llm_interpretation"), "apply": ("applications", "idea"), "translate": ("terms", "translation"), "math": ("method", "llm_interpretation")}
DEFAULT_TARGET = ("insights", "llm_interpretation")
FIELD_SECTIONS = ["background", "method", "experiments", "novelty", "limitations"]
NO_NOTES = "(まだノートはありません)"
OUTLINE_LABEL = "見出し構成: "
HEURISTIC_QUESTION = "(自動抽出はヒューリスティックで実行されました。AI未接続でも原文・ノート・Importを利用できます)"
EXCERPT_GAP = "\n...(中略)...\n"
HISTORY_TITLE = "質問と回答の履歴"


def labelled(column, labels: dict[str, str]):
    """A value's label, or the value where it has none."""
    pairs = [F.lit(x) for kv in labels.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[column], column)


def violations(df: DataFrame, name: str, unique=(), required=(), enums=None, parents=()) -> DataFrame:
    """Rows (tbl, rule, n) of what breaks a rule: unique keys, required values, closed vocabularies, parents.

    parents: (column, parent DataFrame, its column). A write goes ahead only if this is empty.
    """
    found = []
    for key in unique:
        cols = [key] if isinstance(key, str) else list(key)
        found.append(df.groupBy(*cols).count().filter("count > 1").agg(F.count("*").alias("n")).select(F.lit("unique " + ",".join(cols)).alias("rule"), "n"))
    for c in required:
        found.append(df.filter(F.col(c).isNull()).agg(F.count("*").alias("n")).select(F.lit(f"required {c}").alias("rule"), "n"))
    for c, allowed in (enums or {}).items():
        found.append(df.filter(~F.col(c).isin(allowed)).agg(F.count("*").alias("n")).select(F.lit(f"enum {c}").alias("rule"), "n"))
    for c, parent, key in parents:
        orphans = df.filter(F.col(c).isNotNull()).join(parent.select(F.col(key).alias("_parent")), F.col(c) == F.col("_parent"), "left_anti")
        found.append(orphans.agg(F.count("*").alias("n")).select(F.lit(f"parent {c}").alias("rule"), "n"))
    return reduce(DataFrame.unionByName, found).filter("n > 0").select(F.lit(name).alias("tbl"), "rule", F.col("n").cast("long").alias("n"))
