"""Runs of repeated words against a plain search over all periods."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.llm import periodic


def plain(words, min_length=24, min_periods=3):
    """Every run, by comparing the words with themselves at every distance."""
    n, best = len(words), {}
    for q in range(1, n // min_periods + 1):
        i = 0
        while i + q < n:
            if words[i] == words[i + q]:
                j = i
                while j + q < n and words[j] == words[j + q]:
                    j += 1
                if j + q - i >= max(min_length, min_periods * q):
                    best.setdefault((i, j + q), q)
                i = j + 1
            else:
                i += 1
    return sorted((s, e - s, q) for (s, e), q in best.items())


def some_words(rng):
    k = rng.choice([1, 2, 2, 3, 5])
    n = rng.randrange(160)
    if rng.random() < 0.25:
        return [rng.randrange(k) for _ in range(n)]
    words = []
    while len(words) < n:
        p = [rng.randrange(k) for _ in range(rng.randrange(1, 14))]
        p = p * rng.randrange(1, 5) + [rng.randrange(k) for _ in range(rng.randrange(3))]
        words += p * rng.randrange(1, 7) + [rng.randrange(k) for _ in range(rng.randrange(9))]
    return words * rng.choice([1, 1, 3])


@pytest.mark.parametrize("seed", range(8))
def test_runs_are_those_of_a_plain_search(seed):
    rng = random.Random(seed)
    for _ in range(60):
        words, least = some_words(rng), rng.choice([24, 24, 10, 40])
        got = list(zip(*[x.tolist() for x in periodic.find_runs(np.array([*words, 99]), least)], strict=True))
        assert got == plain(words, least)


def test_successor():
    rng = np.random.default_rng(3)
    values = rng.permutation(300)
    tree = periodic.WaveletTree(values)
    lo = rng.integers(0, 300, 500)
    hi = lo + rng.integers(0, 300 - lo + 1)
    at = rng.integers(0, 310, 500)
    for a, b, x, got in zip(lo, hi, at, tree.successor(lo, hi, at), strict=True):
        rest = [v for v in values[a:b] if v >= x]
        assert got == (min(rest) if rest else 300)


def expected(doc_id, text):
    words = [w.decode() for w in (text or "").encode().split()]
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain(words)
    drop = {i for s, ln, q in runs for i in range(s + q, s + ln)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (
        doc_id, len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None,
        sha("".join("%d,%d,%d\n" % r for r in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in drop)),
    )


def query(docs):
    out = periodic.collapse_runs(periodic.planted(docs))
    return [tuple(r) for r in out.select("doc_id", *periodic.digests(out)).collect()]


def test_query_equals_plain_python(spark):
    rng = random.Random(11)
    texts = [None, "", " \t\n ", "a", "é b " * 40, "x " * 3000, "no run at all"]
    texts += [" ".join(f"w{x}" for x in some_words(rng)) for _ in range(60)]
    rows = list(enumerate(texts)) + [(None, "ab ab " * 20), (7, "other\vtext " * 9), (7, "other\vtext " * 9)]
    got = query(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(str, got)) == sorted(str(expected(i, t)) for i, t in rows)


def test_empty_table_and_clashing_names(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert query(none) == []
    odd = spark.createDataFrame([(1, "go on " * 15, "r", 2)], "doc_id long, text string, runs string, `_c0` int")
    out = periodic.collapse_runs(odd)
    assert sorted(out.columns) == ["_c0", "collapsed", "doc_id", "runs", "text"]
    row = out.first()
    assert row["_c0"] == 2 and row["collapsed"] == "go on" and [tuple(r) for r in row["runs"]] == [(0, 30, 2)]
    assert row["text"] == "go on " * 15


def test_one_very_long_text(spark):
    words = [f"w{i % 997}" for i in range(250_000)]
    row = query(spark.createDataFrame([(3, " ".join(words))], "doc_id long, text string"))[0]
    assert row[1] == 1 and row[3:5] == (250_000, 997)


def test_refuses_what_the_method_cannot_give():
    with pytest.raises(ValueError):
        periodic.find_runs(np.array([1, 2, 3]), 24, 2)


def test_planting_leaves_others_alone(spark):
    docs = spark.createDataFrame([(i, f"a{i}  b c") for i in range(50)], "doc_id long, text string")
    kept = periodic.planted(docs).join(docs.withColumnRenamed("text", "was"), "doc_id").where(F.col("text") == F.col("was")).count()
    assert kept == sum(zlib.crc32(str(i).encode()) % 10 != 0 for i in range(50))
