import random
import zlib

import numpy as np

from attestra.llm import toxicity as tx

BAD = ("idiot", "scumbag", "vilea", "vileb", "vilec")


def corpus(n=900):
    rnd = random.Random(8)
    vocab = [f"w{k}{rnd.choice('abcdefgh')}" for k in range(400)]
    docs, labels = [], []
    for i in range(n):
        words = [rnd.choice(vocab) for _ in range(rnd.randint(20, 80))]
        toxic = int(rnd.random() < 0.15)
        if toxic:
            for _ in range(rnd.randint(2, 5)):
                words.insert(rnd.randrange(len(words)), rnd.choice(BAD))
        docs.append((i, " ".join(words)))
        if i % 3:
            labels.append((i, toxic))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    d = spark.createDataFrame([(i, t, 5.0) for i, t in docs], "doc_id long, text string, score double")
    got = {r["doc_id"]: r for r in tx.toxicity(d, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert len(got) == len(docs)
    held = [(got[i]["predicted"], y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _ in docs)
    assert sum(p == y for p, y in held) / len(held) > 0.95
    assert sum(1 for p, y in held if p and not y) <= 3
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "stupid idiot moron scum"), (3, "stupid idiot moron scum"), (None, "fine words"), (4, "x " * 60_000)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = [tuple(r) for r in tx.toxicity(d, none).collect()]
    assert len(got) == 6
    by = {r[0]: r for r in got}
    assert by[3][3] == 1 and by[2][3] == 0 and by[1][2] == by[2][2] and by[None][1] is False
    kept = tx.without_toxic(d, none)
    assert kept.columns == d.columns and kept.where("doc_id = 3").count() == 0 and kept.count() == 4
    assert tx.toxicity(d.where("false"), none).count() == 0


def vote_rows(n=4000):
    rnd = random.Random(3)
    rows = []
    for _ in range(n):
        y = rnd.random() < 0.2
        mask = sum(1 << k for k, (a, b) in enumerate([(0.8, 0.02), (0.6, 0.01), (0.7, 0.05)]) if rnd.random() < (a if y else b))
        mask |= (mask & 1) << 3  # a voter that repeats the first
        rows.append((mask, int(y) if rnd.random() < 0.1 else -1, 1))
    return rows


def test_label_model_finds_accuracies_and_correlations(spark):
    m = tx.LabelModel(4).fit(spark.createDataFrame(vote_rows(), "mask long, label int, n long"))
    assert abs(m.share - 0.2) < 0.05 and abs(m.fire[1][1] - 0.6) < 0.08 and m.fire[0][1] < 0.05
    assert m.parent[3] == 0 or m.parent[0] == 3
    # the repeated voter adds next to nothing: its vote follows from the first one's
    v = 3 if m.parent[3] == 0 else 0
    assert abs(np.log(m.given[1, v, 1] / m.given[0, v, 1])) < 0.3 and abs(np.log((1 - m.given[1, v, 0]) / (1 - m.given[0, v, 0]))) < 0.3
    assert np.log(m.fire[1, v] / m.fire[0, v]) > 2


def test_label_model_against_brute_force(spark):
    """Expectation maximisation row by row, for voters taken as independent."""
    rows = [(x & 7, y) for x, y, _ in vote_rows(1500)]
    known = [y for _, y in rows if y >= 0]
    weight = len(known) / (len(rows) - len(known))
    share, fire = 0.1, [[0.02] * 3, [0.2] * 3]
    for _ in range(3):
        size, hits = [0.0, 0.0], [[0.0] * 3, [0.0] * 3]
        for x, y in rows:
            like = [1 - share, share]
            for c in (0, 1):
                for k in range(3):
                    like[c] *= fire[c][k] if x >> k & 1 else 1 - fire[c][k]
            p = like[1] / sum(like) if y < 0 else y
            for c, q in ((0, 1 - p), (1, p)):
                q *= weight if y < 0 else 1
                size[c] += q
                for k in range(3):
                    hits[c][k] += q * (x >> k & 1)
        share = (sum(known) + 1) / (len(known) + 2)
        fire = [[min(max((hits[c][k] + (0.01, 0.1)[c]) / (size[c] + 1), 1e-5), 1 - 1e-5) for k in range(3)] for c in (0, 1)]
    m = tx.LabelModel(3)
    m.tree = lambda size, second: np.full(3, -1)
    m.fit(spark.createDataFrame([(x, y, 1) for x, y in rows], "mask long, label int, n long"), rounds=3)
    assert np.allclose(m.fire, fire) and abs(m.share - share) < 1e-9


def test_scores_come_from_the_votes(spark, monkeypatch):
    """A label model that says nothing leaves nothing to learn."""
    docs, labels = corpus(400)
    d, known = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    truth = dict(labels)

    def right():
        return sum(r["predicted"] == truth[r["doc_id"]] for r in tx.toxicity(d, known).collect() if r["doc_id"] in truth) / len(truth)

    assert right() > 0.95

    def silent(self, patterns):
        self.share, self.given = 0.5, np.full_like(self.given, 0.1)
        return self

    monkeypatch.setattr(tx.LabelModel, "fit", silent)
    assert right() < 0.5


def test_contradicting_labels_and_clashing_columns(spark):
    labels = spark.createDataFrame([(1, 0), (1, 1), (6, None), (None, 1), (8, 0)], "doc_id long, toxic int")
    got = {r["doc_id"]: r["toxic"] for r in tx.train_labels(labels, (0, 1, 2, 3, 4)).collect()}
    assert got == {1: 1, 8: 0}
    docs = spark.createDataFrame([(1, "fine words", 3, 0.25), (2, None, 4, None)], "doc_id long, text string, Toxic_Score int, score double")
    kept = tx.without_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 2
