"""Ranked search against the plain formula over all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from oracle import compare, connect
from rankloom.llm import queries as Q
from rankloom.llm import ranked

TERM = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
ASCII = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def terms(text):
    return TERM.findall((text or "").translate(ASCII))


def plain(docs, items, k):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    n_docs = sum(1 for _, b in bags if b)
    n_terms = sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        wanted, hits = set(terms(text)), []
        for doc, bag in bags:
            m = 100 - 50 + (50 * sum(bag.values()) * n_docs) // max(1, n_terms)
            score = 0
            for t in wanted & set(bag):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * ((10**9 * bag[t]) // (1000 * bag[t] + 20 * m))
            if score > 0:
                hits.append((-score, doc is None, doc or 0, doc))
        hits.sort(key=lambda h: h[:3])
        out += [(item, r + 1, h[3], -h[0]) for r, h in enumerate(hits[:k])]
    return out


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"t{int(rng.paretovariate(0.6)) % 300}" for _ in range(400)]
    return [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 60)))) for i in range(n)]


@pytest.mark.parametrize("shard_bytes, k", [(300, 3), (4000, 10), (8 << 20, 50)])
def test_equals_the_plain_formula(spark, shard_bytes, k):
    docs = corpus(5, 700)
    docs += [(1000 + i, docs[3][1]) for i in range(80)] + [(2000, None), (2001, ""), (2002, " .-_ "), (None, "T1 t2 T3"), (2003, "Été t1; ÉTÉ été")]
    items = [(i, docs[i * 7][1].replace(" ", ", ").upper()) for i in range(25)] + [(90, None), (91, "..."), (92, "nowhereseen"), (93, "été ÉTÉ"), (None, "t1 t2")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    q = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r) for r in ranked.search(d, q, k, shard_bytes=shard_bytes).collect()]
    assert sorted(got, key=str) == sorted(plain(docs, items, k), key=str)


def test_blocks_of_queries_give_the_same_rows(spark):
    docs, items = corpus(8, 200), [(i, t) for i, t in corpus(9, 30)]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole, cut = (sorted(map(tuple, ranked.search(d, q, 5, block_bytes=b).collect())) for b in (1 << 20, 900))
    assert whole == cut


def test_blocks_are_rejected_before_decompression():
    """A list whose block maxima cannot lift a candidate stays packed."""
    n = 6400
    rng = np.random.default_rng(1)
    rare = np.sort(rng.choice(n, 200, replace=False))
    common = np.arange(n)
    term = np.concatenate([np.zeros(len(rare), int), np.ones(n, int)])
    doc = np.concatenate([rare, common])
    tf = np.concatenate([rng.integers(1, 30, len(rare)), np.ones(n, int)])
    shard = ranked.Shard(term, doc, tf, np.full(n, 100), np.array([5000, 10]))
    found, score = shard.search(np.array([0, 1]), 10, 1)
    whole = shard.decompressed
    assert whole == 100 + 4
    least = int(np.sort(score)[-10])
    shard.decompressed = 0
    again, value = shard.search(np.array([0, 1]), 10, least)
    assert set(zip(again[value >= least], value[value >= least])) == set(zip(found[score >= least], score[score >= least]))
    assert shard.decompressed < whole / 2


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked.search(docs, items.where("false")).count() == 0
    assert ranked.search(docs.where("false"), items).count() == 0
    assert [tuple(r)[:3] for r in ranked.search(docs.withColumn("score", docs.doc_id), items.withColumn("rank", items.item_id)).collect()] == [(1, 1, 1)]


def test_a_long_text_in_pieces(monkeypatch):
    text = ("Ab1 é-" * 50 + "x" * 700 + " end").encode()
    whole = [t for part in ranked.terms_of(text) for t in part]
    monkeypatch.setattr(ranked, "_PIECE", 64)
    assert [t for part in ranked.terms_of(text) for t in part] == whole


def test_query_matches_sql(spark):
    sf = "/root/testdata/sf0.001"
    ok, message = compare(spark, connect(sf), "op12_ranked_search", Q.op12_ranked_search, ranked.SQL, sf)
    assert ok, message
