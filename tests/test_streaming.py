from datetime import datetime

from attestra.operators import relational as R
from attestra.streaming import streams as S


def test_finding_upsert_per_batch_equals_the_batch(spark, tmp_path):
    src = tmp_path / "in"
    for k in range(3):
        spark.createDataFrame([(f"k{k}",), ("same",)], "fingerprint string").coalesce(1).write.mode("append").parquet(str(src))
    state = {"snapshot": spark.createDataFrame([("old", "OPEN"), ("kept", "ACCEPTED")], "fingerprint string, status string")}

    def apply(batch, number):
        out = R.upsert(batch.unionByName(state["snapshot"].where("status != 'OPEN' or fingerprint != 'old'").select("fingerprint")), state["snapshot"], "fingerprint")
        path = str(tmp_path / f"snap{number}")
        out.select("fingerprint", out["after"].alias("status")).write.mode("overwrite").parquet(path)
        state["snapshot"] = spark.read.parquet(path)

    q = S.upsert_batches(S.arrivals(spark, str(src), "fingerprint string", 1), apply, str(tmp_path / "c"))
    q.awaitTermination()
    got = {tuple(r) for r in state["snapshot"].collect()}
    assert got == {("k0", "OPEN"), ("k1", "OPEN"), ("k2", "OPEN"), ("same", "OPEN"), ("old", "RESOLVED"), ("kept", "ACCEPTED")}


def test_expired_leases(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    t = lambda m, s=0: datetime(2025, 1, 1, 0, m, s)
    src = tmp_path / "in"
    for rows in ([(1, t(0), "claim", 1), (2, t(0), "claim", 2), (5, t(0), "claim", 3), (5, t(9), "end", 4)], [(2, t(1), "end", 5)], [(3, t(30), "claim", 6)], [(4, t(31), "claim", 7)]):
        spark.createDataFrame(rows, S.LEASES).coalesce(1).write.mode("append").parquet(str(src))
    out = S.drained(S.expired_leases(S.arrivals(spark, str(src), S.LEASES, 1)), str(tmp_path / "out"))
    assert {(r["job"], r["expired_at"]) for r in out.collect()} == {(1, t(2)), (5, t(2))}


def test_snapshots_follow_each_other(spark, tmp_path):
    src, form = tmp_path / "in", "dossier string, fingerprint string"
    for rows in ([("A", "f"), ("A", "g")], [("B", "f")], [("A", "g")]):
        spark.createDataFrame(rows, form).coalesce(1).write.mode("append").parquet(str(src))
    existing = spark.createDataFrame([("A", "old", "OPEN"), ("B", "old", "ACCEPTED"), ("C", "old", "OPEN")], form + ", status string")
    out = S.finding_snapshots(S.arrivals(spark, str(src), form, 1), existing, ["dossier", "fingerprint"], str(tmp_path / "out"), ["dossier"])
    got = {(r["dossier"], r["fingerprint"]): r["after"] for r in out.collect()}
    assert out.count() == len(got) == 6
    assert got == {("A", "f"): "RESOLVED", ("A", "g"): "OPEN", ("A", "old"): "RESOLVED", ("B", "f"): "OPEN", ("B", "old"): "ACCEPTED", ("C", "old"): "OPEN"}
