"""Incremental ingest and analysis, and the folding of event streams into turns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.analysis import heuristic
from ..operators.parse import markdown_blocks, titles

MOST_OUTPUT = 1 << 20


def analysed(docs: DataFrame) -> DataFrame:
    """doc_id, analysis_status, one_line_summary of a batch of documents (doc_id, text)."""
    blocks = markdown_blocks(docs)
    titled = titles(docs, blocks)
    found = heuristic(titled, blocks)
    return found.select("doc_id", F.lit("done").alias("analysis_status"), "one_line_summary")


def ingest(stream: DataFrame, sink: str, checkpoint: str, analyse: Callable[[DataFrame], DataFrame] = analysed):
    """Analyse every micro-batch and append its statuses to ``sink``; a batch that runs again replaces itself.

    The stream ends when what is there now has been taken (availableNow).
    """

    def batch(df: DataFrame, n: int) -> None:
        analyse(df).write.mode("overwrite").parquet(f"{sink}/batch={n}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_status(spark: SparkSession, folder: str, schema: str, sink: str, checkpoint: str) -> DataFrame:
    """Run ingest() over a folder of Parquet files and return what it wrote."""
    stream = spark.readStream.schema(schema).parquet(folder)
    ingest(stream.select("doc_id", "text"), sink, checkpoint).awaitTermination()
    return spark.read.parquet(sink).drop("batch")


def fold_turns(events: DataFrame) -> DataFrame:
    """session_id, turn_id, text, error: the deltas of a turn in order of seq, or why there is no text.

    Of a text that exceeds MOST_OUTPUT characters and a cancellation, what comes first in the stream is
    the error; a turn with neither that has no end is incomplete. No more than MOST_OUTPUT characters
    of a turn are gathered.
    """
    delta = F.col("kind") == "delta"
    so_far = Window.partitionBy("session_id", "turn_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    e = events.withColumn("_upto", F.sum(F.when(delta, F.length("text")).otherwise(0)).over(so_far))
    fits = F.col("_upto") <= MOST_OUTPUT
    parts = F.array_sort(F.collect_list(F.when(delta & fits, F.struct("seq", "text"))))
    g = e.groupBy("session_id", "turn_id").agg(
        F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"),
        F.max((F.col("kind") == "completed").cast("int")).alias("ended"),
        F.min(F.when(F.col("kind") == "cancelled", F.col("seq"))).alias("cancelled"),
        F.min(F.when(delta & ~fits, F.col("seq"))).alias("large"),
    )
    first = F.coalesce(F.col("large") < F.col("cancelled"), F.col("cancelled").isNull())
    error = F.when(F.col("large").isNotNull() & first, "output_too_large").when(F.col("cancelled").isNotNull(), "cancelled").when(F.col("ended") == 0, "incomplete_turn")
    return g.select("session_id", "turn_id", F.when(error.isNull(), F.col("text")).alias("text"), error.alias("error"))
