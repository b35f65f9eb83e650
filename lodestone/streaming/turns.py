"""Event streams folded into turns as they come, by state kept for each open turn.

Events: session_id, turn_id, seq (long), kind (delta, completed, cancelled), text, ts. The events of a turn come in
the order of seq from one micro-batch to the next; within one they may come in any order. A turn's
result goes out with its first closing event (a cancellation, an end, or more text than MOST_OUTPUT), and the text kept for it
is dropped. A turn without an event for ``patience`` of event time goes out as incomplete. What
comes to a closed turn is ignored as long as its mark is kept: for the same patience.

Results are those of fold_turns() over the same events, if a turn has no event after its closing one
but a later cancellation is none.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from . import MOST_OUTPUT

#: Spark's state store that timers and lists need.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KEYS = ["session_id", "turn_id"]
RESULT = "session_id string, turn_id string, text string, error string"


class Turn(StatefulProcessor):
    """One turn: its parts in order, how long they are, and whether it is closed."""

    def __init__(self, patience_ms: int, most: int = MOST_OUTPUT):
        self.patience, self.most = patience_ms, most

    def init(self, handle) -> None:
        self.handle = handle
        self.turn = handle.getValueState("turn", "length long, closed boolean")
        self.parts = handle.getListState("parts", "text string")

    def _out(self, key, error: str | None) -> Row:
        text = None if error else "".join(p[0] or "" for p in self.parts.get())
        self.parts.clear()
        return Row(session_id=key[0], turn_id=key[1], text=text, error=error)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        length, closed = self.turn.get() if self.turn.exists() else (0, False)
        last, new = 0, []
        # a cancellation comes before an end of the same place
        for r in sorted(rows, key=lambda r: (r.seq, r.kind != "cancelled")):
            last = max(last, int(r.ts.timestamp() * 1000))
            if closed:
                continue
            if r.kind == "delta":
                length += len(r.text or "")
                if length > self.most:
                    closed, new = True, []
                    yield self._out(key, "output_too_large")
                else:
                    new.append((r.text,))
            elif r.kind in ("cancelled", "completed"):
                for part in new:
                    self.parts.appendValue(part)
                closed, new = True, []
                yield self._out(key, "cancelled" if r.kind == "cancelled" else None)
        for part in new:
            self.parts.appendValue(part)
        self.turn.update((length, closed))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(last + self.patience)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        closed = self.turn.exists() and self.turn.get()[1]
        if not closed:
            yield self._out(key, "incomplete_turn")
        self.turn.clear()

    def close(self) -> None:
        pass


def folded(events: DataFrame, delay: str = "1 minute", patience_ms: int = 600_000) -> DataFrame:
    """session_id, turn_id, text, error of turns as they close; events: a stream. Needs PROVIDER as the session's state store."""
    late = events.select(*KEYS, F.col("seq").cast("long").alias("seq"), "kind", "text", "ts").withWatermark("ts", delay)
    return late.groupBy(*KEYS).transformWithState(Turn(patience_ms), outputStructType=RESULT, outputMode="Append", timeMode="EventTime")


def fold_feed(stream: DataFrame, sink: str, checkpoint: str, **options):
    """Fold what has come so far (availableNow) and append the turns that closed to ``sink``; a batch that runs again replaces itself."""
    spark = stream.sparkSession
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, PROVIDER)

    def batch(df: DataFrame, n: int) -> None:
        df.write.mode("overwrite").parquet(f"{sink}/batch={n}")

    try:
        q = folded(stream, **options).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
        return q
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
