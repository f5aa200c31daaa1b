"""The backoff model against dictionaries, and that every history's probabilities add up to one."""

import collections
import math
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rankloom.llm import katz


class Brute:
    def __init__(self, rows):
        tokens = [[*(t or "").encode().lower().split(), None] for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 10]
        self.words, self.pairs, self.starts = collections.Counter(), collections.Counter(), len(tokens)
        for doc in tokens:
            self.words.update(doc)
            self.pairs.update(zip(["<s>", *doc], doc))
        self.total = sum(self.words.values())
        counts = lambda c: np.bincount(np.minimum(list(c.values()) or [0], 7), minlength=8)[:7].astype(float) * ([0] + [1] * 6)
        self.d1, self.d2 = katz.Discounts.of(counts(self.words)), katz.Discounts.of(counts(self.pairs))
        kept = sum(self.cut(self.d1, c) for c in self.words.values())
        self.n = self.total if self.total and kept < self.total else self.total + 1
        self.unknown = 1 - kept / self.n
        self.after = collections.defaultdict(dict)
        for (h, w), c in self.pairs.items():
            self.after[h][w] = c

    @staticmethod
    def cut(d, c):
        return c * d.d[min(c, katz.RELIABLE + 1)]

    def p(self, w):
        return self.cut(self.d1, self.words[w]) / self.n if w in self.words else self.unknown

    def history(self, h):
        seen, c = self.after[h], self.starts if h == "<s>" else self.words.get(h, 0)
        if not c:
            return 1, 1.0
        kept = sum(self.cut(self.d2, x) for x in seen.values())
        total = c if c - kept > 1e-9 * max(c, 1) else c + 1
        return total, (1 - kept / total) / (1 - sum(self.p(w) for w in seen))

    def pair(self, h, w):
        total, alpha = self.history(h)
        return self.cut(self.d2, self.pairs[h, w]) / total if (h, w) in self.pairs else alpha * self.p(w)

    def score(self, text):
        doc = [*(text or "").encode().lower().split(), None]
        base = sum(math.log10((self.words.get(w, 0) + 0.1) / (self.total + 0.1 * (len(self.words) + 1))) for w in doc)
        return len(doc), sum(w in self.words for w in doc), base, sum(math.log10(self.pair(h, w)) for h, w in zip(["<s>", *doc], doc))


def made(n, seed):  # n of 3 at least
    r = random.Random(seed)
    rows = [(k, " ".join("T%d" % min(int(r.expovariate(0.2)), 60) for _ in range(r.randrange(0, 60)))) for k in range(n)]
    return [*rows, (900, None), (901, ""), (902, "never seen words \x1c here"), (None, "t1 t2"), (2, rows[2][1]), (1, "other text of a repeated id")]


@pytest.mark.parametrize("n,block", [(200, 1 << 20), (200, 700), (3, 1 << 20), (0, 1 << 20)])
def test_scores(spark, monkeypatch, n, block):
    monkeypatch.setattr(katz, "BLOCK_BYTES", block)
    rows = made(n, 4) if n else [(902, "only one, held out or not"), (10, "")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_tokens string").repartition(2)
    brute = Brute(rows)
    got = katz.score(df).collect()
    want = sorted(((i, *brute.score(t)) for i, t in rows), key=lambda x: (x[0] is None, x))
    got.sort(key=lambda r: (r["doc_id"] is None, (r["doc_id"], r["n_tokens"], r["n_known"], r["base_score"])))
    assert len(got) == len(rows)
    for r, (i, tokens, known, base, score) in zip(got, want):
        assert (r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (i, tokens, known, brute.total)
        assert r["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 10 == 0)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and math.isclose(r["score"], score, rel_tol=1e-9)


@pytest.mark.parametrize("n", [3, 30, 400])
def test_probabilities_add_up(n):
    brute = Brute(made(n, 8))
    for h in ["<s>", *list(brute.words)[:30], b"unknown"]:
        total = sum(brute.pair(h, w) for w in brute.words) + brute.history(h)[1] * brute.unknown
        assert math.isclose(total, 1, rel_tol=1e-9)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=7, max_size=7))
def test_discounts_lie_between_none_and_all(n):
    d = katz.Discounts.of(np.array(n, dtype=float)).d
    assert len(d) == katz.RELIABLE + 2 and (d > 0).all() and (d <= 1).all() and d[-1] == 1 and d[1] < 1


def test_packing():
    a, b = np.array([0, -5, 2**62]), np.array([0.5, -1e300, 3.0])
    x, y = katz.unpack(katz.pack(a, b), 3, "id")
    assert (x == a).all() and (y == b).all()
    assert [len(z) for z in katz.unpack(katz.pack(a[:0]), 0, "i")] == [0]


def test_empty_table(spark):
    assert katz.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0
