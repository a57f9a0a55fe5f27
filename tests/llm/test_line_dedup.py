import hashlib
import random

from attestra.llm import line_dedup as ld

from . import naive


def brute(rows):
    first = {}
    for i, t in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    reps = sorted({v: k for k, v in first.items()}.items())
    hashed = {i: ld.line_hashes(t) for i, t in reps}
    holder = {}
    for i, _ in reps:
        for h, w in zip(*hashed[i], strict=True):
            if w >= ld.LINE_WORDS:
                holder.setdefault(h, i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        if i is None:
            gone = set()
        elif first[t or ""] < i:
            gone = set(range(len(lines))) if len((t or "").split()) >= ld.BLOCK_WORDS else set()
        else:
            h, w = hashed[i]
            gone = set()
            for f in {holder[x] for x, n in zip(h, w, strict=True) if n >= ld.LINE_WORDS and holder[x] < i}:
                gone |= set(ld.common_blocks(hashed[f][0], h, w))
        kept = "" if len(gone) == len(lines) else "\n".join(x for k, x in enumerate(lines) if k not in gone)
        out.append((i, len(lines), len(gone), len(kept.encode()), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_patience_alignment():
    assert ld.align([1, 2, 3, 4, 5], [9, 2, 3, 8, 5]) == [(1, 1), (2, 2), (4, 4)]
    assert ld.align([], [1]) == [] == ld.align([1], [])
    assert ld.align([1, 1, 2, 1, 1], [1, 1, 2, 1, 1]) == [(k, k) for k in range(5)]
    a, b = [1, 2, 3, 4, 5, 6], [4, 5, 6, 1, 2, 3]
    assert len(ld.align(a, b)) == 3
    rnd = random.Random(2)
    for _ in range(200):
        a = [rnd.randrange(12) for _ in range(rnd.randrange(30))]
        b = [rnd.randrange(12) for _ in range(rnd.randrange(30))]
        m = ld.align(a, b)
        assert all(a[i] == b[j] for i, j in m)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(m, m[1:], strict=False))


def test_small_cases(spark):
    para = [f"this is paragraph number {k} with a few more words in it" for k in range(12)]
    rows = [
        (1, "\n".join(para[:5])), (2, "\n".join(["own line", *para[1:4], "tail"])), (3, "\n".join(para[:5])), (4, None), (5, ""), (None, "\n".join(para[:5])),
        (6, "\n".join([para[4], para[0]])), (7, "short\nlines\nonly"), (8, "short\nlines\nonly"), (9, "\n".join(["x", para[2], "one two three four five"])), (10, "one two three four five"),
        (3, "\n".join(para[:5])), (11, "\n".join(para[5:] * 300)), (12, "\n".join(para[5:] * 200 + ["z"])),
    ]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, words string")
    assert sorted(map(str, (tuple(r) for r in ld.line_report(docs).collect()))) == sorted(map(str, brute(rows)))
    kept = ld.without_common_blocks(docs)
    assert kept.columns == docs.columns
    got = {r["doc_id"]: r["text"] for r in kept.where("doc_id in (1, 2, 4, 10)").collect()}
    assert got == {1: rows[0][1], 2: "own line\ntail", 4: None, 10: "one two three four five"}
    assert ld.line_report(docs.where("false")).count() == 0


def test_driver_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(tuple(r) for r in ld.line_report(docs).collect()) == sorted(brute(rows))


def test_passages_repeated_in_either_text():
    p, x = [1, 2, 3], [8]
    for first, later, gone in (
        (p + x + p, [20, *p, 21], [1, 2, 3]),
        (p, [20, *p, 21, *p, 22], [1, 2, 3]),
        (p + x + p, [20, *p, 21, *p, 22], [1, 2, 3, 5, 6, 7]),
        ([30, *p, 31, 3, 32, *p], [40, *p, 41], [1, 2, 3]),
    ):
        assert ld.common_blocks(first, later, [5] * len(later)) == gone
        assert ld.common_blocks(first, later, [3] * len(later)) == []
    assert ld.common_blocks([1] * 3000 + [2], [1] * 2000 + [3], [9] * 2001) == list(range(2000))
    rnd = random.Random(5)
    for _ in range(300):
        a, b = ([rnd.randrange(4) for _ in range(rnd.randrange(25))] for _ in range(2))
        w = [rnd.randrange(8) for _ in b]
        m = ld.align(a, b, w, ld.BLOCK_WORDS)
        assert all(a[i] == b[j] for i, j in m) and all(s[0] < t[0] and s[1] < t[1] for s, t in zip(m, m[1:], strict=False))


def test_a_first_holder_that_repeats_a_passage(spark):
    p = "\n".join(f"line {k} of a passage that stands twice in its first holder" for k in range(3))
    docs = spark.createDataFrame([(1, f"{p}\nbetween\n{p}"), (2, f"a\n{p}\nb"), (3, f"c\n{p}\nd")], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in ld.without_common_blocks(docs).collect()} == {1: f"{p}\nbetween\n{p}", 2: "a\nb", 3: "c\nd"}


def all_pairs(rows):
    """Lines deleted from each distinct text by aligning it with all earlier ones."""
    first = {}
    for i, t in rows:
        first[t] = min(first.get(t, i), i)
    reps = [(i, *ld.line_hashes(t)) for i, t in sorted((i, t) for t, i in first.items())]
    return {(i, k) for i, h, w in reps for f, g, _ in reps if f < i and not set(g).isdisjoint(h) for k in ld.common_blocks(g, h, w)}


def deleted(spark, rows):
    found = ld.deletions(spark.createDataFrame(rows, "doc_id long, text string")).where("not copy").collect()
    return {(r["doc_id"], k) for r in found for k in r["gone"]}


def test_blocks_that_no_first_holder_has(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(7)) for x in "abc")
    p, q = f"{a} x y z", f"{b} x y z"
    rows = [
        (1, f"{a}\none"), (2, f"{b}\ntwo"), (3, f"three\n{a}\n{b}"), (5, f"{a}\n{b}\nfive"),
        (10, f"{p}\nten\n{q}"), (11, f"{q}\neleven\n{p}"), (12, f"{q}\ntwelve\n{p}"), (13, f"{c}\n{p}\n{p}"), (14, f"{p}\nx\n{p}\n{c}\n{p}"),
    ]
    got = deleted(spark, rows)
    assert got == all_pairs(rows)
    assert {(5, 0), (5, 1), (12, 0), (12, 2)} <= got


def test_all_pairs(spark):
    rnd = random.Random(8)
    lines = [" ".join(f"w{k}" for k in range(j * 20, j * 20 + rnd.randrange(5, 13))) for j in range(14)]
    rows = [(i, "\n".join(rnd.choice(lines) if rnd.random() < 0.7 else f"own {i} {k}" for k in range(rnd.randrange(1, 9)))) for i in range(600)]
    assert deleted(spark, rows) == all_pairs(rows)


def test_passages_of_short_lines(spark):
    verse = "\n".join(f"verse {k} here" for k in range(6))
    rows = [(1, f"one\n{verse}"), (2, f"{verse}\ntwo"), (3, f"three\n{verse}\nfour"), (4, "verse 1 here\nverse 2 here\n\nverse 3 here")]
    assert deleted(spark, rows) == all_pairs(rows) == {(2, k) for k in range(6)} | {(3, k) for k in range(1, 7)}
    rnd = random.Random(9)
    lines = ["", *(" ".join(f"w{j}" for _ in range(rnd.randrange(1, 7))) for j in range(9))]
    rows = [(i, "\n".join(rnd.choice(lines) if rnd.random() < 0.9 else f"own {i} {k}" for k in range(rnd.randrange(1, 12)))) for i in range(500)]
    assert deleted(spark, rows) == all_pairs(rows)


def naively(rows):
    return sorted((i, n, gone, len(kept.encode()), hashlib.sha256(kept.encode()).hexdigest()) for i, kept, n, gone in naive.without_lines(rows))


def test_against_a_naive_version(spark):
    rnd = random.Random(21)
    lines = ["", *(" ".join(f"w{k}x{n}" for n in range(rnd.randrange(1, 9))) for k in range(16))]
    rows = [(i, "\n".join(rnd.choice(lines) if rnd.random() < 0.8 else f"own {i} {k}" for k in range(rnd.randrange(1, 14)))) for i in range(250)]
    long = [" ".join(f"v{k}y{n}" for n in range(6)) for k in range(3)]
    rows += [(1001, f"a\n{long[0]}"), (1002, f"b\n{long[1]}"), (1003, f"x\n{long[0]}\n{long[1]}\nz"), (1004, f"w\n{long[0]}\n{long[1]}\nv"), (1004, f"w\n{long[0]}\n{long[1]}\nv"), (1004, f"{long[2]}\n{long[2]}")]
    got = sorted(tuple(r) for r in ld.line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == naively(rows)
    assert [r[2] for r in got if r[0] == 1004].count(2) == 2


def test_driver_table_against_a_naive_version(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").where("n_chars < 4000")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(tuple(r) for r in ld.line_report(docs).collect()) == naively(rows)


def test_clashing_columns_are_kept(spark):
    text = " ".join(f"w{k}" for k in range(12))
    docs = spark.createDataFrame([(1, text, "a", 1), (2, f"{text}\nown", "b", 2)], "doc_id long, text string, kept_text string, Gone_Id int")
    kept = ld.without_common_blocks(docs)
    assert kept.columns == docs.columns and sorted(tuple(r) for r in kept.collect()) == [(1, text, "a", 1), (2, "own", "b", 2)]
