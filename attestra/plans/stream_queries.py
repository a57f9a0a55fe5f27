"""Streams over the driver tables, with the batch result as their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import shared_folder
from ..streaming import streams as S
from .registry import query
from .relational import UPSERT_SQL


def _checkpoint(t) -> str:
    return f"{shared_folder(t.spark)}/streams/{uuid.uuid4().hex}"


def _stream(t, name: str):
    """A driver table as a stream; event time needs a timestamp with zone (UTC)."""
    schema = getattr(t, name).schema
    source = t.spark._jvm.org.apache.hadoop.fs.Path(f"{t.sf_dir}/{name}.parquet")
    folder = source.getFileSystem(t.spark._jsc.hadoopConfiguration()).getFileStatus(source).isDirectory()
    reader = t.spark.readStream.schema(schema)
    # a stream watches a folder: the table's own, or that of a single file
    rows = reader.parquet(f"{t.sf_dir}/{name}.parquet") if folder else reader.option("pathGlobFilter", f"{name}.parquet").parquet(f"{t.sf_dir}/")
    plain = [f.name for f in schema.fields if f.dataType.simpleString() == "timestamp_ntz"]
    return rows.withColumns({c: F.col(c).cast("timestamp") for c in plain})


def _run(t, frame, mode="complete"):
    return S.drained(frame, _checkpoint(t), mode)


@query("strs1_intake", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def _(t):
    return _run(t, _stream(t, "events").groupBy("event_type").agg(F.count("*").alias("n")))


@query("strs2_content_dedup", "SELECT count(DISTINCT user_id || event_type) AS n FROM events")
def _(t):
    kept = S.first_arrivals(_stream(t, "events"), ["user_id", "event_type"], "ts", "365 days")
    return _run(t, kept.select("user_id", "event_type"), "append").agg(F.count("*").alias("n"))


@query("strs4_rolling_budget", """
SELECT d AS start, count(*) AS calls, count(CASE WHEN event_type <> 'view' THEN 1 END) AS metered FROM events, (SELECT DISTINCT (ts::DATE - k::INT)::TIMESTAMP AS d FROM events, range(0, 7) r(k)) WHERE ts >= d AND ts < d + INTERVAL 7 DAY GROUP BY 1""")
def _(t):
    return _run(t, S.rolling_budget(_stream(t, "events"), "ts", F.col("event_type") != "view"))


@query("strs5_daily_usage", "SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS calls, sum((props::JSON ->> 'k')::BIGINT)::BIGINT AS tokens FROM events GROUP BY 1, 2")
def _(t):
    return _run(t, S.daily_usage(_stream(t, "events"), "ts", "event_type", F.from_json("props", "k long")["k"]))


@query("strs6_review_sessions", """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, count(*) AS actions, min(ts) AS start FROM s GROUP BY user_id, k""")
def _(t):
    return _run(t, S.review_sessions(_stream(t, "events"), "ts", "user_id")).drop("end")


@query("strs7_finding_upsert", UPSERT_SQL)
def _(t):
    """The upsert applied to each micro-batch: here all files are one batch."""
    k = F.col("o_orderkey")
    status = F.when(k % 4 == 0, "ACCEPTED").when(k % 4 == 1, "RESOLVED").when(k % 7 == 2, "DISMISSED").otherwise("OPEN")
    existing = t.orders.where(k % 3 != 0).select(k.alias("k"), status.alias("status"))
    return S.finding_snapshots(_stream(t, "orders").where("o_totalprice > 150000").select(k.alias("k")), existing, ["k"], _checkpoint(t))


@query("strs3_expired_leases", """
WITH e AS (SELECT user_id AS job, date_trunc('millisecond', ts) + INTERVAL 120 SECOND AS until, event_type = 'view' AS claim, lead(date_trunc('millisecond', ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS following FROM events)
SELECT job, until::TIMESTAMP AS expired_at FROM e WHERE claim AND CASE WHEN following IS NULL THEN until <= (SELECT max(ts) - INTERVAL 1 SECOND FROM events) ELSE following > until END""")
def _(t):
    """A view claims a lease of two minutes, any other event ends it; timers
    count milliseconds."""
    t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", S.STATE_STORE)
    event = F.when(F.col("event_type") == "view", "claim").otherwise("end")
    return _run(t, S.expired_leases(_stream(t, "events").select(F.col("user_id").alias("job"), F.col("ts").alias("at"), event.alias("event"), F.col("event_id").alias("place"))), "append")
