"""Versioned tables with one pointer each: a write is a new folder, then the pointer moves.

Readers follow the pointer and never see half a write. A write that expects a version is refused
if another has come between (one writer at a time moves the pointer). Works on any file system
that Spark reads, through its own file API.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession


class StaleWrite(RuntimeError):
    """The table is at another version than the write expects."""


class HistoryError(RuntimeError):
    """The schema history is unknown, newer or has gaps."""


class Store:
    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def version(self, name: str) -> int:
        """The current version of a table; 0 if it has none."""
        fs, p = self._fs(f"{self.base}/{name}/_current")
        if not fs.exists(p):
            return 0
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())["version"]
        finally:
            stream.close()

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.base}/{name}/v={self.version(name)}")

    def write(self, name: str, df: DataFrame, expected: int | None = None) -> int:
        """Write a new version and move the pointer to it; returns its number."""
        now = self.version(name)
        if expected is not None and expected != now:
            raise StaleWrite(f"{name} is at version {now}, not {expected}")
        df.write.mode("overwrite").parquet(f"{self.base}/{name}/v={now + 1}")
        if self.version(name) != now:
            raise StaleWrite(f"{name} was written by another")
        fs, p = self._fs(f"{self.base}/{name}/_current")
        out = fs.create(p, True)
        try:
            out.write(bytearray(json.dumps({"version": now + 1}).encode()))
        finally:
            out.close()
        return now + 1


def pending(history: DataFrame, known: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """The schema steps still to be applied; refuses a history that isn't the beginning of ``known``."""
    if [v for v, _ in known] != list(range(1, len(known) + 1)):
        raise HistoryError("steps must be numbered from 1 without gaps")
    done = sorted((r["version"], r["name"]) for r in history.select("version", "name").collect())
    if done != known[: len(done)]:
        raise HistoryError("unknown, newer or incomplete history")
    return known[len(done) :]
