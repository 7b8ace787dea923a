"""Polled items as streams, each equal to its batch query once all input is in."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from brightloom.plans.shared import shared_dir


def run_to_end(stream: DataFrame, spark: SparkSession, mode: str = "append", base: str | None = None) -> DataFrame:
    """Write all that a stream has into the shared folder and read it back; with ``base``, go on from the last run there."""
    base = base or f"{shared_dir(spark)}/brightloom/stream-{uuid.uuid4().hex[:12]}"
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def live_stream(items: DataFrame, activated: DataFrame, now: str, lookback_days: int = 30, forget_after: str | None = None) -> DataFrame:
    """Items of a stream marked live or backfill by their source's activation; an id counts once.

    Late items are kept: they are backfill. Unless ``forget_after`` is set, the
    state has every id ever seen, as the batch query has. With it, an id is
    forgotten once items are that much later, and one that comes again after
    that counts again.
    """
    from brightloom.operators.polls import is_live

    if forget_after is None:
        once = items.dropDuplicates(["event_id"])
    else:
        clock = items.withColumn("__at", F.col("ts").cast("timestamp")).withWatermark("__at", forget_after)
        once = clock.dropDuplicatesWithinWatermark(["event_id"]).drop("__at")
    rows = once.join(activated, "user_id")
    live = is_live(F.col("ts"), F.col("activated_at"), F.lit(now).cast("timestamp_ntz"), lookback_days)
    return rows.select("event_id", "user_id", F.when(live, F.lit("live")).otherwise(F.lit("backfill")).alias("status"))


def change_stream(items: DataFrame) -> DataFrame:
    """``user_id, event_id, change_type`` where a user's event type differs from the one before, state kept by user.

    Within a batch, a user's items are put in order before the state sees them.
    An item that comes in a later batch than a later item of its user is
    reported as ``late`` and leaves the state as it is: what was told about the
    items after it cannot be taken back.
    """

    def step(key, batches, state: GroupState):
        last, at, seen = state.get if state.exists else (None, pd.Timestamp.min, -1)
        rows = pd.concat(batches).sort_values(["ts", "event_id"])
        out = []
        for event, kind, ts in zip(rows["event_id"], rows["event_type"], rows["ts"]):
            if (ts, event) <= (at, seen):
                out.append((key[0], event, "late"))
                continue
            if kind != last:
                out.append((key[0], event, "created" if last is None else "updated"))
            last, at, seen = kind, ts, event
        state.update((last, at, seen))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "change_type"])

    kind = dict(items.dtypes)["ts"]
    return items.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, change_type string", f"last string, at {kind}, seen long", "append", GroupStateTimeout.NoTimeout)


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STORE = "spark.sql.streaming.stateStore.providerClass"


class _Refresh(StatefulProcessor):
    """Last content and time of a resource, until a timer finds that it was not seen for long enough.

    A resource has one timer. It is not moved when the resource is seen again,
    but looks, when it is due, whether that was so, and is set again.
    """

    def __init__(self, forget_ms: int, names: list[str]):
        self.forget, self.row = forget_ms, Row(*names)

    def init(self, handle):
        self.handle = handle
        self.last = handle.getValueState("last", "content string, seen long")

    def handleInputRows(self, key, rows, timerValues):
        before = self.last.get()
        content, seen = before or (None, None)
        for row in sorted(rows, key=lambda r: (r.at_ms, r.event_id)):
            if seen is not None and row.at_ms < seen:
                continue  # an earlier sight of what was told already
            if seen is None or row.at_ms - seen > self.forget:
                yield self.row(*key, row.event_id, "new")
            elif row.content != content:
                yield self.row(*key, row.event_id, "refresh")
            content, seen = row.content, row.at_ms
        if (content, seen) != before:
            self.last.update((content, seen))
        if before is None:
            self.handle.registerTimer(int(seen + self.forget + 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        due = self.last.get()[1] + self.forget + 1
        if due <= timerValues.getCurrentWatermarkInMs():
            self.last.clear()
        else:
            self.handle.registerTimer(int(due))
        return iter([])

    def close(self):
        pass


def refresh_stream(items: DataFrame, resource: list[str], at: str, content: Column, forget: str) -> DataFrame:
    """``resource, event_id, kind`` as ``polls.refreshes`` tells them, from a stream.

    A resource's state goes once the stream's time is ``forget`` past its last
    sight; needs the RocksDB state store (``refresh_to_end`` sets it).
    """
    clock = items.withColumn("__at", F.col(at).cast("timestamp")).withWatermark("__at", "0 seconds")
    rows = clock.select(*resource, "event_id", "__at", F.unix_millis("__at").alias("at_ms"), content.cast("string").alias("content"))
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in (*resource, "event_id")) + ", kind string"
    step = _Refresh(_millis(items.sparkSession, forget), [*resource, "event_id", "kind"])
    return rows.groupBy(*resource).transformWithState(step, schema, "Append", "EventTime")


def _millis(spark: SparkSession, span: str) -> int:
    zero = "TIMESTAMP '1970-01-01 00:00:00Z'"
    return spark.sql(f"SELECT unix_millis({zero} + INTERVAL {span}) AS ms").first().ms


def refresh_to_end(stream: DataFrame, spark: SparkSession, base: str | None = None) -> DataFrame:
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    try:
        return run_to_end(stream, spark, base=base)
    finally:
        spark.conf.set(STORE, before)
