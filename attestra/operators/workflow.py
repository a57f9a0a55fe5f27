"""Workflow as frames: states, review decisions, jobs and stored snapshots.

There is no MERGE here: an upsert is a full outer join that yields the next
snapshot, and a log is folded onto a snapshot with ordered aggregates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates
from .relational import first_per

# Allowed transitions of a dossier.
EDGES = {
    "DRAFT": ("INGESTED", "FAILED"),
    "INGESTED": ("INGESTED", "QUEUED", "FAILED"),
    "QUEUED": ("PROCESSING", "FAILED"),
    "PROCESSING": ("NEEDS_REVIEW", "FAILED"),
    "NEEDS_REVIEW": ("QUEUED", "NEEDS_REVIEW", "APPROVED", "REJECTED", "FAILED"),
    "REJECTED": ("INGESTED",),
    "APPROVED": (),
    "FAILED": ("QUEUED", "INGESTED"),
}
MAX_ATTEMPTS, BACKOFF_SECONDS, LEASE_SECONDS = 3, 5, 120


def allowed(before: Column, after: Column, edges=EDGES) -> Column:
    """Whether a transition is in the table."""
    pairs = F.create_map(*[x for k, v in edges.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]) if v else F.array().cast("array<string>"))])
    return F.coalesce(F.array_contains(F.try_element_at(pairs, before), after), F.lit(False))


def illegal_moves(log: DataFrame, key: str, order: Sequence[str], state: str, edges=EDGES) -> DataFrame:
    """Steps of a state log that the table doesn't allow."""
    w = Window.partitionBy(key).orderBy(*order)
    steps = log.withColumn("before", F.lag(state).over(w)).where("before is not null")
    return steps.where(~allowed(F.col("before"), F.col(state), edges))


def transition(snapshot: DataFrame, requests: DataFrame, key: str) -> DataFrame:
    """Compare and set: a request (key, expected version, to) moves a row only
    if its version is the expected one and the move is allowed."""
    r = requests.select(key, F.col("version").alias("_v"), F.col("to").alias("_to"))
    j = snapshot.join(r, key, "left")
    ok = F.col("_v").eqNullSafe(F.col("version")) & allowed(F.col("status"), F.col("_to"))
    return j.select(key, F.when(ok, F.col("_to")).otherwise(F.col("status")).alias("status"), (F.col("version") + F.when(ok, 1).otherwise(0)).alias("version"), F.when(F.col("_to").isNotNull(), ok).alias("moved"))


def approvable(dossiers: DataFrame, findings: DataFrame, extractions: DataFrame, key: str) -> DataFrame:
    """Dossiers without an open or accepted blocker and without a field to review."""
    blocked = findings.where("severity = 'BLOCKER' and status in ('OPEN', 'ACCEPTED')").select(key)
    waiting = extractions.where("status = 'NEEDS_REVIEW'").select(key)
    return dossiers.join(blocked, key, "left_anti").join(waiting, key, "left_anti")


def upsert_extractions(existing: DataFrame, produced: DataFrame, key: str) -> DataFrame:
    """Next snapshot (key, value, status): corrected and confirmed readings keep
    their value; readings no longer produced stay."""
    p = produced.select(key, F.col("value").alias("_v"), F.col("status").alias("_s"))
    j = existing.join(p, key, "full_outer")
    keep = F.col("status").isin("CORRECTED", "CONFIRMED") | F.col("_s").isNull()
    return j.select(key, F.when(keep, F.col("value")).otherwise(F.col("_v")).alias("value"), F.when(keep, F.col("status")).otherwise(F.col("_s")).alias("status"))


def upsert_chunks(existing: DataFrame, produced: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Next snapshot of chunks: what isn't produced any more is dropped; an
    unchanged text keeps its embedding."""
    old = existing.select(*keys, F.col("text").alias("_t"), F.col("embedding").alias("_e"))
    j = produced.join(old, list(keys), "left")
    return j.select(*keys, "text", F.when(F.col("_t") == F.col("text"), F.col("_e")).alias("embedding"))


def intake(arrivals: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """Same bytes are one document: the first arrival, with the other names."""
    w = Window.partitionBy(*keys)
    first = arrivals.withColumn("_n", F.row_number().over(w.orderBy(*order))).withColumn("_names", F.array_sort(F.collect_set(name).over(w)))
    return first.where("_n = 1").withColumn("alternates", F.array_except("_names", F.array(name))).drop("_n", "_names")


def idempotent(requests: DataFrame, keys: Sequence[str], order: Sequence[Column], fingerprint: str) -> DataFrame:
    """Outcome of each request: the first reserves its key, equal ones replay
    it, others conflict."""
    w = Window.partitionBy(*keys).orderBy(*order)
    first = F.first(fingerprint).over(w)
    n = F.row_number().over(w)
    return requests.withColumn("outcome", F.when(n == 1, "RESERVED").when(F.col(fingerprint) == first, "REPLAYED").otherwise("CONFLICT"))


def fold_decisions(extractions: DataFrame, decisions: DataFrame, key: str, order: str) -> DataFrame:
    """Extractions after review: the last decision sets the status, the last
    correction the value; the first original is kept; revision counts decisions."""
    c = F.struct(order, "new_value")
    g = decisions.groupBy(key).agg(F.max(F.struct(order, "action")).alias("_last"), F.max(F.when(F.col("action") == "CORRECT", c)).alias("_fix"), F.count("*").alias("_n"))
    j = extractions.join(g, key, "left")
    fixed = F.col("_fix").isNotNull()
    status = F.when(F.col("_last.action") == "CORRECT", "CORRECTED").when(F.col("_last.action") == "CONFIRM", "CONFIRMED").otherwise(F.col("status"))
    return j.select(key, F.when(fixed, F.col("_fix.new_value")).otherwise(F.col("value")).alias("value"), F.when(fixed, F.col("value")).alias("original"), status.alias("status"), F.when(fixed, 1.0).otherwise(F.col("confidence")).alias("confidence"), F.coalesce("_n", F.lit(0)).alias("revision"))


def resolve_findings(findings: DataFrame, decisions: DataFrame, key: str, order: str) -> DataFrame:
    """Findings after decisions; a decision without a reason doesn't count."""
    d = decisions.where("reason is not null and trim(reason) != ''")
    last = d.groupBy(key).agg(F.max(F.struct(order, "action")).alias("_last"))
    to = F.when(F.col("_last.action") == "ACCEPT", "ACCEPTED").when(F.col("_last.action") == "DISMISS", "DISMISSED").otherwise(F.col("status"))
    return findings.join(last, key, "left").withColumn("status", to).drop("_last")


def enqueue(jobs: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return first_per(jobs, keys, order)


def claimable(jobs: DataFrame, now: Column, slots: int, order: Sequence[Column]) -> DataFrame:
    """The next pending jobs for a number of free workers."""
    return jobs.where((F.col("status") == "PENDING") & (F.col("available_at") <= now)).orderBy(*order).limit(slots)


def after_failure(status: Column, retryable: Column, attempts: Column, most: int = MAX_ATTEMPTS) -> Column:
    """Struct of the next status and the wait in seconds."""
    again = retryable & (attempts < most)
    state = F.when(status != "RUNNING", status).when(again, "PENDING").when(retryable, "DEAD_LETTER").otherwise("FAILED")
    return F.struct(state.alias("status"), F.when((status == "RUNNING") & again, dates.backoff_seconds(attempts, BACKOFF_SECONDS)).alias("wait"))


def reclaim(jobs: DataFrame, now: Column, most: int = MAX_ATTEMPTS) -> DataFrame:
    """Running jobs whose lease has expired, with their next status."""
    late = jobs.where((F.col("status") == "RUNNING") & (F.col("leased_until") < now))
    return late.withColumn("status", F.when(F.col("attempts") >= most, "DEAD_LETTER").otherwise("PENDING"))


def fenced(jobs: DataFrame, heartbeats: DataFrame, key: str) -> DataFrame:
    """Heartbeats (key, worker, at) count only from the worker that holds the job."""
    h = heartbeats.select(key, "worker", "at")
    held = jobs.where("status = 'RUNNING'").select(key, F.col("leased_by").alias("worker"))
    last = h.join(held, [key, "worker"]).groupBy(key).agg(F.max("at").alias("_at"))
    j = jobs.join(last, key, "left")
    until = F.col("_at") + F.make_dt_interval(secs=F.lit(LEASE_SECONDS))
    return j.withColumn("leased_until", F.greatest("leased_until", until)).drop("_at")
