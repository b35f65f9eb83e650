"""Questions to a provider: prompts, bounded context, an offline provider, and what was sent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import selection_of, strip
from ..schema import NO_NOTES
from .anchors import context_index
from .context import note_digest, surrounding

# Texts of the offline provider and of empty context.
MOCK_NOTE = "> ⚠️ **モック回答**: 開発・テスト用の回答です。実際のAI回答を使う場合は、Codexをインストールし、AI状態メニューの「ChatGPTで接続」から認証してください。\n\n"
MOCK_END = "モックプロバイダーは選択箇所と文脈を受け取り、この位置に回答を生成します。保存・アンカー・ノート機能はこの回答でもすべて動作します。"
NOTHING, NO_SELECTION, NO_PLACE = "(なし)", "(選択なし — 資料全体への質問)", "(位置不明)"
#: Names that a template may use.
TEMPLATE = "{title} / {heading_path}\n{context_before}\n---SELECTION---\n{selection}\n---\n{context_after}\n{note_digest}\n{question}"


def prompts(files: DataFrame) -> DataFrame:
    """id, version, body of prompt files (name, value): front matter between lines of three dashes, then the body."""
    front = F.regexp_extract("value", r"^---\s*\n([\s\S]*?)\n---\s*\n", 1)
    body = strip(F.regexp_replace("value", r"^---\s*\n[\s\S]*?\n---\s*\n", ""))
    key = lambda k: F.nullif(strip(F.regexp_extract(front, rf"(?m)^\s*{k}\s*:(.*)$", 1)), F.lit(""))
    return files.select(F.coalesce(key("id"), "name").alias("id"), F.coalesce(key("version"), F.lit("1")).alias("version"), body.alias("body"))


def mock_answer(prompt: Column) -> Column:
    """The offline provider's answer: marked as such, with the selection."""
    return F.concat(F.lit(MOCK_NOTE + "選択箇所:\n\n> "), F.left(selection_of(prompt), F.lit(400)), F.lit("\n\n" + MOCK_END))


def mock_translation(prompt: Column) -> Column:
    return F.concat(F.lit("【モック翻訳】"), selection_of(prompt))


def question_text(text: Column, kind: Column, canned: dict[str, str]) -> Column:
    """The question, or the standard one of its kind where nothing but the kind was asked."""
    out = text
    for k, v in canned.items():
        out = F.when((kind == k) & (strip(text).isin("", k)), F.lit(v)).otherwise(out)
    return out


def asked(questions: DataFrame, sources: DataFrame, versions: DataFrame, blocks: DataFrame, knowledge: DataFrame, canned: dict[str, str] | None = None, template: str = TEMPLATE, provider: Callable[[Column], Column] = mock_answer) -> DataFrame:
    """question_id, source_id, question, prompt, answer, context_summary for many questions at once.

    questions: question_id, source_id, question_text, prompt_type, selection_text and an anchor's quote,
    prefix, suffix, source_version, block_id, block_idx. versions: id, source_id (the latest ones).
    blocks: version_id, id, idx, text, heading_path. Surroundings are computed once a block.
    """
    v = versions.select(F.col("id").alias("version_id"), F.col("source_id").alias("_s"))
    q = questions.join(v, F.col("source_id") == F.col("_s"), "left").drop("_s")
    place = context_index(q.withColumn("anchor_id", F.col("question_id")), blocks).select(F.col("anchor_id").alias("_q"), F.col("idx").alias("at"))
    near = surrounding(blocks, "version_id").select(F.col("version_id").alias("_v"), F.col("idx").alias("_i"), "before", "after", "heading_path")
    q = q.join(place, F.col("question_id") == F.col("_q"), "left").join(near, (F.col("version_id") == F.col("_v")) & (F.col("at") == F.col("_i")), "left")
    notes = note_digest(sources, knowledge).select(F.col("source_id").alias("_n"), "digest")
    q = q.join(notes, F.col("source_id") == F.col("_n"), "left").join(sources.select(F.col("id").alias("_t"), "title"), F.col("source_id") == F.col("_t"))
    filled = lambda c, other: F.when(F.coalesce(c, F.lit("")) == "", F.lit(other)).otherwise(F.col(c))
    question = question_text(F.col("question_text"), F.col("prompt_type"), canned or {})
    q = q.withColumn("question", question).withColumn("heading", filled("heading_path", NO_PLACE))
    values = {"title": F.col("title"), "heading_path": F.col("heading"), "context_before": filled("before", NOTHING), "context_after": filled("after", NOTHING), "selection": filled("selection_text", NO_SELECTION), "note_digest": F.coalesce("digest", F.lit(NO_NOTES)), "question": F.col("question")}
    prompt = F.lit(template)
    for name, value in values.items():
        prompt = F.replace(prompt, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    n = lambda c: F.length(F.coalesce(c, F.lit("")))
    sent = F.to_json(F.struct(F.col("heading"), n("selection_text").alias("selection_chars"), n("before").alias("before_chars"), n("after").alias("after_chars"), (F.coalesce("digest", F.lit(NO_NOTES)) != NO_NOTES).alias("note_digest_used")))
    q = q.withColumn("prompt", prompt).withColumn("context_summary", sent)
    return q.select("question_id", "source_id", "question", "prompt", provider(F.col("prompt")).alias("answer"), "context_summary")
