"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of up to 64 words. Every passage is encoded (its bytes' frequencies and a few amounts,
through a learned layer), a gated attention gives it a weight, and the weighted mean of the encodings is scored. Only
documents carry labels; encoder, gates and scorer are learned together from them by Adam on the log loss.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import hash_words, hashed_below, slices, stored

PASSAGE_WORDS = 64
#: Bound of the labelled rows that the model is fitted on.
SAMPLE_DOCS = 3000
EXTRAS = 6
WIDTH = 256 + EXTRAS
HIDDEN, GATE = 32, 16
STEPS, BATCH, RATE, DECAY = 500, 200, 0.01, 1e-4

_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_SIGN = np.array([b < 128 and not chr(b).isalnum() and not chr(b).isspace() for b in range(256)])


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, and the offsets of each text's; a text without words has one passage of zeros."""
    data = b"\n".join(texts)
    words, starts = hash_words(data)
    lengths = np.array([len(t) + 1 for t in texts])
    offsets = np.concatenate(([0], np.searchsorted(starts, np.cumsum(lengths))))
    n = np.diff(offsets)
    count = np.maximum(1, -(-n // PASSAGE_WORDS))
    bag = np.concatenate(([0], np.cumsum(count)))
    doc = np.repeat(np.arange(len(n)), n)
    of_word = bag[doc] + (np.arange(len(words)) - offsets[doc]) // PASSAGE_WORDS
    total = int(bag[-1])
    x = np.zeros((total, WIDTH), dtype=np.float32)
    if len(words):
        raw = np.frombuffer(data, dtype=np.uint8)
        first = np.concatenate(([True], of_word[1:] != of_word[:-1]))
        full, begin = of_word[first], starts[first]
        doc_end = (np.cumsum(lengths) - 1)[np.searchsorted(bag, full, side="right") - 1]
        size = np.minimum(np.append(begin[1:], len(raw)), doc_end) - begin
        of_byte = np.repeat(full, size)
        raw = raw[np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())]
        histogram = np.bincount(of_byte * 256 + raw, minlength=total * 256).reshape(total, 256).astype(np.float32)
        total_bytes = histogram.sum(axis=1)
        nbytes = np.maximum(total_bytes, 1)
        x[:, :256] = np.sqrt(histogram / nbytes[:, None])
        nwords = np.bincount(of_word, minlength=total)
        order = np.lexsort((words, of_word))
        w, p = words[order], of_word[order]
        new = np.concatenate(([True], (w[1:] != w[:-1]) | (p[1:] != p[:-1])))
        repeated = np.bincount(of_word[1:][(words[1:] == words[:-1]) & (of_word[1:] == of_word[:-1])], minlength=total)
        many = np.maximum(nwords, 1)
        x[:, 256:] = np.stack([
            nwords / PASSAGE_WORDS, np.bincount(p[new], minlength=total) / many, total_bytes / many / 10, repeated / many,
            histogram[:, _UPPER].sum(axis=1) / nbytes, histogram[:, _SIGN].sum(axis=1) / nbytes], axis=1)
    return x, bag


class Model:
    """Encoder (w, b), gates (v, u, a) and scorer (c, d); features are centred and scaled by the sample's."""

    def __init__(self, seed: int = 11) -> None:
        r = np.random.default_rng(seed)
        init = lambda *s: r.standard_normal(s) / np.sqrt(s[0])
        self.weights = {"w": init(WIDTH, HIDDEN), "b": np.zeros(HIDDEN), "v": init(HIDDEN, GATE), "u": init(HIDDEN, GATE), "a": init(GATE), "c": init(HIDDEN), "d": np.zeros(())}
        self.mean, self.scale = np.zeros(WIDTH), np.ones(WIDTH)

    def forward(self, x: np.ndarray, bag: np.ndarray) -> dict[str, np.ndarray]:
        p = self.weights
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ p["w"] + p["b"])
        t, s = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        e = (t * s) @ p["a"]
        n = np.diff(bag)
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, bag[:-1]), n))
        weight = e / np.repeat(np.add.reduceat(e, bag[:-1]), n)
        z = np.add.reduceat(h * weight[:, None], bag[:-1])
        return {"x": x, "h": h, "t": t, "s": s, "weight": weight, "z": z, "y": 1 / (1 + np.exp(-(z @ p["c"] + p["d"])))}

    def gradients(self, x: np.ndarray, bag: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss."""
        p, f = self.weights, self.forward(x, bag)
        n = np.diff(bag)
        dy = (f["y"] - y) / len(y)
        dz = np.repeat(dy[:, None] * p["c"], n, axis=0)
        dh = dz * f["weight"][:, None]
        dweight = (dz * f["h"]).sum(axis=1)
        de = f["weight"] * (dweight - np.repeat(np.add.reduceat(dweight * f["weight"], bag[:-1]), n))
        dts = de[:, None] * p["a"]
        dt, ds = dts * f["s"] * (1 - f["t"] ** 2), dts * f["t"] * f["s"] * (1 - f["s"])
        dh += dt @ p["v"].T + ds @ p["u"].T
        dx = dh * (1 - f["h"] ** 2)
        return {"w": f["x"].T @ dx, "b": dx.sum(axis=0), "v": f["h"].T @ dt, "u": f["h"].T @ ds, "a": (f["t"] * f["s"]).T @ de, "c": f["z"].T @ dy, "d": dy.sum()}

    def fit(self, x: np.ndarray, bag: np.ndarray, y: np.ndarray, steps: int = STEPS, seed: int = 5) -> Model:
        r = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(axis=0, dtype=float), np.maximum(x.std(axis=0, dtype=float), 1e-3)
        first, second = ({k: np.zeros_like(v) for k, v in self.weights.items()} for _ in range(2))
        for step in range(1, steps + 1):
            docs = np.sort(r.choice(len(y), min(BATCH, len(y)), replace=False))
            n = np.diff(bag)[docs]
            rows = np.repeat(bag[docs] - np.cumsum(n) + n, n) + np.arange(n.sum())
            grads = self.gradients(x[rows], np.concatenate(([0], np.cumsum(n))), y[docs])
            rate = RATE * min(1, 2 * (1 - step / (steps + 1)))
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g**2
                self.weights[k] = self.weights[k] * (1 - rate * DECAY) - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        return self


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Model | None:
    """A model of ``sample`` labelled documents at most, chosen by the hash of their id; None if none is labelled.

    Labels other than 0 and 1 and null ones are left out; a document with several labels counts once for each.
    """
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels[label].cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    known = known.distinct()
    picked = stored(known.where(hashed_below(F.col("doc_id"), known.count(), sample)).orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample), "sample")
    src = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")).join(picked, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw in slices(batches, "text"):
            x, bag = passages(raw)
            yield pa.RecordBatch.from_arrays([part["doc_id"], part["y"], pa.array([x[a:b].tobytes() for a, b in zip(bag[:-1], bag[1:], strict=True)], pa.binary())], ["doc_id", "y", "x"])

    rows = src.mapInArrow(run, "doc_id long, y int, x binary").orderBy("doc_id", "y", "x").limit(2 * sample).collect()
    if not rows:
        return None
    bags = [np.frombuffer(r["x"], dtype=np.float32).reshape(-1, WIDTH) for r in rows]
    return Model().fit(np.concatenate(bags), np.concatenate(([0], np.cumsum([len(b) for b in bags]))), np.array([r["y"] for r in rows], dtype=float))


def score(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, n_passages, top_passage, top_weight): one row per input row.

    ``top_passage`` is the passage of most weight, from 0. A null or empty text is one passage of zeros and is scored
    as such; without a model every score is 0.5.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw in slices(batches, "text"):
            x, bag = passages(raw)
            n = np.diff(bag)
            if model is None:
                y, weight = np.full(len(n), 0.5), np.repeat(1 / n, n)
            else:
                f = model.forward(x, bag)
                y, weight = f["y"], f["weight"]
            top = [int(weight[a:b].argmax()) for a, b in zip(bag[:-1], bag[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], pa.array(y), pa.array(n.astype(np.int64)), pa.array(top, pa.int64()), pa.array(weight[bag[:-1] + np.array(top, dtype=np.int64)])],
                ["doc_id", "score", "n_passages", "top_passage", "top_weight"])

    src = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, score double, n_passages long, top_passage long, top_weight double")
