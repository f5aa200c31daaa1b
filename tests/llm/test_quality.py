"""Gradients by differences, learning from bags, held-out accuracy, nulls."""

import random

import numpy as np
from pyspark.sql import functions as F

from rankloom.llm import quality


def test_gradients_are_those_of_the_loss():
    r = np.random.default_rng(0)
    x = r.standard_normal((9, quality.WIDTH))
    bag, y = np.array([0, 2, 3, 9]), np.array([1.0, 0.0, 1.0])
    m = quality.Model()

    def loss():
        p = m.forward(x, bag)["y"]
        return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())

    grads = m.gradients(x, bag, y)
    for name, w in m.weights.items():
        for at in [tuple(r.integers(0, s) for s in w.shape) for _ in range(4)]:
            kept, step = w[at].copy(), 1e-5
            w[at] = kept + step
            up = loss()
            w[at] = kept - step
            down = loss()
            w[at] = kept
            assert abs((up - down) / (2 * step) - grads[name][at]) < 1e-6


def texts(seed, n):
    r = random.Random(seed)
    out = []
    for k in range(n):
        y = r.random() < 0.6
        words = [r.choice(["alpha", "beta", "gamma", "delta", "of"]) for _ in range(r.choice([5, 60, 400]))]
        if not y:  # one bad passage in an ordinary text
            at = r.randrange(len(words))
            words[at:at + 40] = ["BUY!!"] * 40
        out.append((k, " ".join(words), int(y)))
    return out


def test_held_out_quality(spark):
    rows = texts(1, 400)
    docs = spark.createDataFrame([(i, t, 9.0) for i, t, _ in rows] + [(900, None, 0.0), (901, "", 0.0), (None, "alpha", 0.0), (1, rows[1][1], 0.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(5, None), (None, 1), (7, 8), (999, 1)], "doc_id long, quality int")
    model = quality.train(docs, labels.where(F.col("doc_id") % 2 == 0))
    out = quality.score(docs, model).collect()
    assert len(out) == 404 and all(0 <= r["score"] <= 1 for r in out)
    truth = {i: y for i, _, y in rows}
    held = [(r["score"] >= 0.3) == truth[r["doc_id"]] for r in out if r["doc_id"] in truth and r["doc_id"] % 2]
    assert sum(held) >= 0.95 * len(held)


def test_attention_weights_add_up_and_passages_cover_texts():
    raw = [b"", b"one", b" ".join(b"w%d" % k for k in range(1000)), b"\n\n"]
    x, bag = quality.passages(raw)
    assert np.diff(bag).tolist() == [1, 1, 16, 1] and (x[0] == 0).all()
    w = quality.Model().forward(x, bag)["weight"]
    assert np.allclose(np.add.reduceat(w, bag[:-1]), 1)


def test_no_labels_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "text")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.train(docs, none) is None
    assert quality.score(docs, None).first()["score"] == 0.5
    assert quality.score(docs.limit(0), None).count() == 0
