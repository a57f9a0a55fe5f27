"""Requests that may be sent twice, and files that arrive, as streams.

A key of a request is *reserved* by the first that brings it, *in flight* until it is
completed or released, and *replayed* once completed; another body under the same key is a
*conflict*; a released key can be reserved again.  The state of a key is one value, which
may be forgotten after a while (``ttl_ms``).  The same processor runs over streams and
over tables.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources import files

OUTCOMES = "key string, endpoint string, seq bigint, action string, outcome string"


def outcome(held: tuple[str, str] | None, action: str, fingerprint: str | None) -> tuple[str, tuple[str, str] | None]:
    """What a request meets, and what is held after it: (fingerprint, IN_FLIGHT or DONE)."""
    if action == "RESERVE":
        if held is None:
            return "RESERVED", (fingerprint, "IN_FLIGHT")
        if held[0] != fingerprint:
            return "CONFLICT", held
        return ("IN_FLIGHT" if held[1] == "IN_FLIGHT" else "REPLAYED"), held
    if held is None or held[1] != "IN_FLIGHT":
        return "IGNORED", held
    return ("COMPLETED", (held[0], "DONE")) if action == "COMPLETE" else ("RELEASED", None)


class Requests(StatefulProcessor):
    def __init__(self, ttl_ms: int | None) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "fingerprint string, state string", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        now = tuple(self.held.get()) if self.held.exists() else None
        before = now
        for r in sorted(rows, key=lambda r: r["seq"]):
            told, now = outcome(now, r["action"], r["fingerprint"])
            yield Row(key=key[0], endpoint=key[1], seq=r["seq"], action=r["action"], outcome=told)
        if now is None:
            self.held.clear()
        elif now != before or self.ttl_ms:
            self.held.update(now)

    def close(self) -> None:
        pass


def idempotent_requests(requests: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Outcome of each request (key, endpoint, seq, action, fingerprint), in order of ``seq``
    within a key; those of a later batch come after those of an earlier one.  A session
    needs the RocksDB state store for it."""
    _ = requests.sparkSession.streams  # starts what coordinates state, which a table's query doesn't
    return requests.groupBy("key", "endpoint").transformWithState(Requests(ttl_ms), OUTCOMES, "append", "ProcessingTime" if ttl_ms else "None")


def arriving_files(spark: SparkSession, folder: str) -> DataFrame:
    """The intake of files as they arrive: each file once, refused ones as rows with a reason."""
    found = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("recursiveFileLookup", "true").load(folder)
    return files.intake(found)


def take_arrivals(spark: SparkSession, folder: str, out: str, checkpoint: str) -> None:
    """Take what has arrived since the last call into the table ``out``."""
    stream = arriving_files(spark, folder).writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True)
    stream.start(out).awaitTermination()
