"""Documents on their way through an analysis: pending, running, then done or failed, as a log that is appended to.

Each micro-batch writes its states into a folder of its own, one step after the other; a batch that
runs again replaces its folder, and so changes nothing. A document whose analysis raises an error ends
as failed, with the error, and none but it. A source that is sent again with the same content within
the watermark's delay is not analysed again. The current state of a source is the last one in the log.

Nulls: a null text is analysed as an empty one. Rows without source_id are ignored, as are those that come
later than the watermark's delay.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STEPS = ["pending", "running", "done", "failed"]
#: Characters of an error that are kept.
ERROR_CHARS = 500
_LOG = "source_id string, content_hash string, step int, state string, one_line_summary string, error string"


def first_summary(text: str) -> str:
    """The first line's beginning; texts of fewer than 20 words can't be analysed."""
    if len(text.split()) < 20:
        raise ValueError("fewer than 20 words")
    return text.split("\n", 1)[0][:150]


def attempted(docs: DataFrame, analyse: Callable[[str], str]) -> DataFrame:
    """docs (source_id, content_hash, text) as the last step of each: done with its summary, or failed with its error."""

    def one(text):
        try:
            return "done", analyse(text or ""), None
        except Exception as e:  # whatever a document does to its analysis, the others go on
            return "failed", None, (str(e) or type(e).__name__)[:ERROR_CHARS]

    def run(batches):
        for b in batches:
            found = [one(t) for t in b["text"]]
            yield pd.DataFrame({"source_id": b["source_id"], "content_hash": b["content_hash"], "step": 2, "state": [x[0] for x in found], "one_line_summary": [x[1] for x in found], "error": [x[2] for x in found]})

    return docs.select("source_id", "content_hash", "text").mapInPandas(run, _LOG)


def ingest_states(stream: DataFrame, log: str, checkpoint: str, analyse: Callable[[str], str] = first_summary, delay: str = "1 hour"):
    """Analyse a stream of sources (source_id, text, sent_at) and write their states to ``log``, until what is there has been taken."""
    s = stream.filter(F.col("source_id").isNotNull()).withColumn("content_hash", F.sha2(F.coalesce("text", F.lit("")), 256))
    s = s.withWatermark("sent_at", delay).dropDuplicatesWithinWatermark(["source_id", "content_hash"])

    def batch(df: DataFrame, n: int) -> None:
        df.persist()  # what the stream's state lets through is read three times
        none = F.lit(None).cast("string")
        for step, state in enumerate(STEPS[:2]):
            rows = df.select("source_id", "content_hash", F.lit(step).alias("step"), F.lit(state).alias("state"), none.alias("one_line_summary"), none.alias("error"))
            rows.write.mode("overwrite").parquet(f"{log}/batch={n}/part={step}")
        attempted(df, analyse).write.mode("overwrite").parquet(f"{log}/batch={n}/part=2")
        df.unpersist()

    return s.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, log: str) -> DataFrame:
    """source_id, state, one_line_summary, error, n_states of every source: the last step of its last batch."""
    rows = spark.read.schema(f"{_LOG}, batch long, part int").parquet(log)
    w = Window.partitionBy("source_id")
    last = F.row_number().over(w.orderBy(F.desc("batch"), F.desc("step"), "content_hash"))
    rows = rows.withColumn("last", last).withColumn("n_states", F.count("*").over(w)).filter("last = 1")
    return rows.select("source_id", "state", "one_line_summary", "error", "n_states")
