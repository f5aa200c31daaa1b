"""Words, components and written tables."""

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rankloom.llm import common


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aAbé \n\t\x0b\x1c\x85-", max_size=40), max_size=6))
def test_words_are_what_bytes_split_gives(texts):
    raw = [t.encode() for t in texts]
    hashes, offsets = common.words_of(raw)
    seen = {}
    for k, t in enumerate(raw):
        words = t.lower().split()
        own = hashes[offsets[k]:offsets[k + 1]].tolist()
        assert len(words) == len(own)
        for w, h in zip(words, own):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_chunks_do_not_change_words(monkeypatch):
    text = b" ".join(b"w%d" % (k % 97) for k in range(3000)) + b" " + b"x" * 500
    whole, starts = common.hash_words(text)
    monkeypatch.setattr(common, "_CHUNK", 64)
    parts, at = common.hash_words(text)
    assert (whole == parts).all() and (starts == at).all()


def test_slices_keep_rows_and_order():
    batch = pa.RecordBatch.from_pydict({"k": list(range(7)), "text": ["a" * 10, None, "", "b" * 50, "c", "d" * 30, "e"]})
    got = list(common.slices(iter([batch]), "text", 32))
    assert [k for part, _ in got for k in part["k"].to_pylist()] == list(range(7))
    assert [len(t) for _, raw in got for t in raw] == [10, 0, 0, 50, 1, 30, 1]


def brute(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {x: root(x) for x in parent}


@pytest.mark.parametrize("limit", [500_000, 3])
@pytest.mark.parametrize("kind", ["path", "star", "random", "none"])
def test_components(spark, kind, limit, monkeypatch):
    monkeypatch.setattr(common, "LINKS_PER_TASK", limit)
    r = random.Random(kind)
    edges = {
        "path": [(k, k + 1) for k in range(300)], "star": [(0, k) for k in range(1, 300)],
        "random": [(r.randrange(400), r.randrange(400)) for _ in range(220)], "none": [],
    }[kind]
    r.shuffle(edges)
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    got = {x["id"]: x["root"] for x in common.components(df).collect()}
    want = brute([e for e in edges if e[0] != e[1]])
    assert set(got) == set(want)
    pairs = {(got[k], want[k]) for k in got}
    assert len(pairs) == len(set(got.values())) == len(set(want.values()))
    assert all(got[got[k]] == got[k] for k in got)


def test_stored_table_can_be_deleted(spark):
    df = common.stored(spark.range(5).select(F.col("id")), "five")
    assert df.count() == 5
    common.forget(df)
    assert np.all([not spark._jvm.java.io.File(df._stored_path.removeprefix("file://")).exists()])
