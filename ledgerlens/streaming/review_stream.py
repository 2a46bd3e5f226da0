"""Streams: decisions as they arrive, each item's latest kept as state, and findings by window."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: What a decision is, and what the stream says of an item: its latest decision, whether an older one stood before, and whether no later one can come in time.
DECISION = "item_id string, decision string, ts timestamp, event_id string"
STATE = "item_id string, decision string, ts timestamp, event_id string, seen bigint, settled boolean"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def decision_stream(spark: SparkSession, path: str, schema: str, watermark: str = "1 hour") -> DataFrame:
    """Decisions from a growing folder of Parquet files, each event once within the watermark."""
    stream = spark.readStream.schema(schema).parquet(path)
    return stream.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["event_id"])


def counts_by_window(stream: DataFrame, width: str = "1 day") -> DataFrame:
    return stream.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"))


class LatestDecision(StatefulProcessor):
    """State of an item: its latest decision by (ts, event_id). The same event again changes nothing, and an older one does not take its place, in whatever order they come.

    A row is given out whenever the decision changes. A timer at the decision's time plus `settle_ms` gives it out once more as settled and drops the state, so state is held for open items alone.
    """

    def __init__(self, settle_ms: int | None):
        self.settle_ms = settle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", "decision string, ts timestamp, event_id string, seen bigint")

    def _row(self, key, state, settled: bool) -> pd.DataFrame:
        decision, ts, event_id, seen = state
        return pd.DataFrame({"item_id": [key[0]], "decision": [decision], "ts": pd.to_datetime([ts]), "event_id": [event_id], "seen": [seen], "settled": [settled]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = tuple(self.latest.get()) if self.latest.exists() else None
        best, seen = held, held[3] if held else 0
        for batch in rows:
            seen += len(batch)
            for decision, ts, event_id in zip(batch["decision"], batch["ts"], batch["event_id"], strict=True):
                if best is None or (ts, event_id) > (pd.Timestamp(best[1]), best[2]):
                    best = (decision, ts.to_pydatetime(), event_id, seen)
        state = (best[0], best[1], best[2], seen)
        self.latest.update(state)
        if held is None or best[1:3] != held[1:3]:
            if self.settle_ms is not None:
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(int(pd.Timestamp(best[1]).timestamp() * 1000) + self.settle_ms)
            yield self._row(key, state, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.latest.exists():
            state = tuple(self.latest.get())
            self.latest.clear()
            yield self._row(key, state, True)

    def close(self) -> None:
        pass


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Queries that are started within keep their state in RocksDB, which state with timers needs; the session's own setting comes back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def latest_decisions(stream: DataFrame, watermark: str = "7 days", settle_ms: int | None = None) -> DataFrame:
    """Changes of each item's latest decision (STATE's columns), of a stream of decisions (item_id, decision, ts, event_id); start it within `rocks`.

    A decision older than the watermark (`watermark` behind the latest time seen by the batch before) is late and left out; with `settle_ms` items whose decision is older than that, by the watermark, are settled and leave
    the state. Null items are left out; a null time counts as the first second of 1970 (late, unless the watermark reaches back so far).
    """
    rows = stream.where("item_id is not null").select(
        F.col("item_id").cast("string").alias("item_id"), F.col("decision").cast("string").alias("decision"), F.coalesce(F.col("ts").cast("timestamp"), F.timestamp_seconds(F.lit(1))).alias("ts"), F.coalesce(F.col("event_id").cast("string"), F.lit("")).alias("event_id")
    ).withWatermark("ts", watermark)
    return rows.groupBy("item_id").transformWithStateInPandas(statefulProcessor=LatestDecision(settle_ms), outputStructType=STATE, outputMode="Update", timeMode="EventTime")


def decision_sink(changes: DataFrame, target: str, checkpoint: str):
    """Starts the stream of latest_decisions over what is there now; each micro-batch is written under its number, so that a batch run twice replaces its own output."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    with rocks(changes.sparkSession):
        return changes.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def decisions_of(spark: SparkSession, target: str) -> DataFrame:
    """item_id, decision, ts, event_id, settled: the latest of what decision_sink has written."""
    at = F.struct("ts", "event_id", "batch")
    return spark.read.schema(STATE + ", batch int").parquet(target).groupBy("item_id").agg(
        F.max_by("decision", at).alias("decision"), F.max("ts").alias("ts"), F.max_by("event_id", at).alias("event_id"), F.max_by("settled", at).alias("settled")
    )


def latest_of(decisions: DataFrame) -> DataFrame:
    """The same of a table of decisions, as a batch: item_id, decision, ts, event_id."""
    at = F.struct("ts", "event_id")
    return decisions.where("item_id is not null").groupBy("item_id").agg(F.max_by("decision", at).alias("decision"), F.max("ts").alias("ts"), F.max_by("event_id", at).alias("event_id"))


def upsert_sink(stream: DataFrame, target: str, checkpoint: str):
    """Writes each micro-batch's latest decision of each item under its batch number, so that a batch run twice replaces its own output."""

    def write(batch: DataFrame, number: int) -> None:
        latest = batch.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("decision"), F.max("ts").alias("ts"))
        latest.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
