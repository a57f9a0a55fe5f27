"""Streams over files of rows.  Each function takes a streaming frame and
returns one, or starts a query that ends when all files are read."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.relational import upsert

LEASES = "job long, at timestamp, event string, place long"
#: Timers and typed state need this provider of state.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def arrivals(spark: SparkSession, path: str, schema, files_per_batch: int = 100) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def first_arrivals(stream: DataFrame, keys: list[str], ts: str, delay: str = "7 days") -> DataFrame:
    """Content dedup on arrival, with state bounded by the watermark."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def rolling_budget(stream: DataFrame, ts: str, metered) -> DataFrame:
    """Calls in windows of seven days, one each day."""
    w = F.window(ts, "7 days", "1 day")
    return stream.withWatermark(ts, "1 day").groupBy(w).agg(F.count("*").alias("calls"), F.count_if(metered).alias("metered")).select("window.start", "calls", "metered")


def daily_usage(stream: DataFrame, ts: str, model: str, tokens) -> DataFrame:
    w = F.window(ts, "1 day")
    return stream.withWatermark(ts, "1 day").groupBy(w, model).agg(F.count("*").alias("calls"), F.sum(tokens).alias("tokens")).select(F.col("window.start").alias("day"), model, "calls", "tokens")


def review_sessions(stream: DataFrame, ts: str, actor: str, gap: str = "30 minutes") -> DataFrame:
    w = F.session_window(ts, gap)
    return stream.withWatermark(ts, "1 hour").groupBy(w, actor).agg(F.count("*").alias("actions")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), actor, "actions")


class LeaseProcessor(StatefulProcessor):
    """Emits a reclaim for each claim whose lease runs out before the job's next
    event.  Claims and ends (job, at, event, place) come keyed by job, in order
    of at and place; the lease is an event-time timer."""

    seconds = 120

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "until long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = until = int(self.until.get()[0]) if self.until.exists() else None
        expired = []
        for r in pd.concat(rows).sort_values(["at", "place"]).itertuples():
            at = r.at.value // 1_000_000
            if until is not None and at > until:
                expired.append(until)
            until = at + self.seconds * 1000 if r.event == "claim" else None
        if before is not None and until != before:
            self.handle.deleteTimer(before)
        if until is None:
            self.until.clear()
        elif until != before:
            self.until.update((until,))
            self.handle.registerTimer(until)
        if expired:
            yield pd.DataFrame({"job": [int(key[0])] * len(expired), "expired_at": pd.to_datetime(expired, unit="ms")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.until.clear()
        yield pd.DataFrame({"job": [int(key[0])], "expired_at": [pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms")]})

    def close(self) -> None:
        pass


def expired_leases(stream: DataFrame, ts: str = "at") -> DataFrame:
    """(job, expired_at) of leases that nobody ended; needs the RocksDB state store."""
    keyed = stream.withWatermark(ts, "1 second").groupBy("job")
    return keyed.transformWithStateInPandas(LeaseProcessor(), "job long, expired_at timestamp", "Append", "EventTime")


def upsert_batches(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """Each micro-batch of produced findings goes through ``apply``, which
    writes the next snapshot; re-run batches are recognised by their number."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def finding_snapshots(stream: DataFrame, existing: DataFrame, keys: Sequence[str], out: str, scope: Sequence[str] = ()) -> DataFrame:
    """Upsert each micro-batch of produced findings against the snapshot that the
    batch before it left, and return the last one: (keys, before, after, action).
    A batch that is run again overwrites its own snapshot.  With ``scope`` (some
    of the keys, such as the dossier) a batch only speaks for what it names."""
    spark = stream.sparkSession
    fields = [existing.schema[k] for k in keys]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["before string", "after string", "action string"])
    last: list[int] = []

    def apply(batch: DataFrame, number: int) -> None:
        before = existing
        if number:
            before = spark.read.schema(schema).parquet(f"{out}/snapshots/{number - 1}").select(*keys, F.col("after").alias("status"))
        upsert(batch, before, keys, batch.select(*scope) if scope else None).write.mode("overwrite").parquet(f"{out}/snapshots/{number}")
        last.append(number)

    upsert_batches(stream, apply, f"{out}/checkpoint").awaitTermination()
    if not last:
        return upsert(existing.where("false"), existing, keys, existing.select(*keys).where("false"))
    return spark.read.schema(schema).parquet(f"{out}/snapshots/{max(last)}")


def drained(frame: DataFrame, out: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there and return its rows: every batch is
    a folder under ``out``; a complete result is that of the last batch."""
    written: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/rows/batch={number}")
        written.append(number)

    q = frame.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    if not written:
        return frame.sparkSession.createDataFrame([], frame.schema)
    chosen = written if mode == "append" else [max(written)]
    return frame.sparkSession.read.schema(frame.schema).parquet(*[f"{out}/rows/batch={n}" for n in chosen])
