import hashlib
import random

from attestra.llm import suffix_dedup as sd


def brute(rows, length=100):
    first = {}
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        if i is not None:
            for p in range(len(b) - length + 1):
                w = b[p : p + length]
                first[w] = min(first.get(w, (i, p)), (i, p))
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        if i is not None:
            for p in range(len(b) - length + 1):
                if first[b[p : p + length]] < (i, p):
                    gone[p : p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for p, g in enumerate(gone) if g and (p == 0 or not gone[p - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def cases():
    rnd = random.Random(4)

    def text(n, letters="abcdefgh éß"):
        return "".join(rnd.choice(letters) for _ in range(n))

    passages = [text(n) for n in (99, 100, 101, 150, 260, 700)]
    rows = []
    for i in range(60):
        parts = [text(rnd.randint(0, 120))]
        for _ in range(rnd.randint(0, 3)):
            p = rnd.choice(passages)
            a = rnd.randint(0, 30)
            parts += [p[a : len(p) - rnd.randint(0, 30)], text(rnd.randint(0, 60))]
        rows.append((i, "".join(parts)))
    rows += [(100, None), (101, ""), (102, "a" * 99), (103, "a" * 100), (104, "a" * 101), (105, "ab" * 400), (106, "xyz" + "ab" * 70), (107, rows[3][1]), (107, rows[3][1]), (None, rows[3][1]), (108, "q" + rows[5][1])]
    return rows


def test_small_cases_against_brute_force(spark):
    rows = cases()
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, g int")
    want = sorted(map(str, brute(rows)))
    for size in (sd.GROUP_BYTES, 700):
        got = sorted(map(str, (tuple(r) for r in sd.dedup(docs, group_bytes=size).collect())))
        assert got == want
    kept = {r["doc_id"]: bytes(r["kept"]) for r in sd.dedup(docs.where("doc_id in (103, 104)"), keep_bytes=True).collect()}
    assert kept == {103: b"a" * 100, 104: b""}
    assert sd.dedup(docs.where("false")).count() == 0


def test_driver_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(tuple(r) for r in sd.dedup(docs, group_bytes=100_000).collect()) == sorted(brute(rows))
