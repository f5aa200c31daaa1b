"""Planted copies, edited copies and clean documents; the alignment against a plain one."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from rankloom.llm import decontaminate as d


def plain_alignment(item, window):
    best = 0
    h = [[0] * (len(window) + 1) for _ in range(len(item) + 1)]
    for i, a in enumerate(item, 1):
        for j, b in enumerate(window, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (d.MATCH if a == b else d.MISMATCH), h[i - 1][j] + d.GAP, h[i][j - 1] + d.GAP)
            best = max(best, h[i][j])
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=12), st.lists(st.integers(0, 4), max_size=20))
def test_alignment(item, window):
    score, end = d.align(np.array(item, dtype=np.int64), np.array(window, dtype=np.int64))
    assert score == plain_alignment(item, window)
    assert score == plain_alignment(item, window[:end])


def corpus():
    r = random.Random(2)
    word = lambda: "v%d" % int(r.expovariate(0.01))
    text = lambda n: [word() for _ in range(n)]
    items = [(k, " ".join(text(r.randrange(15, 60)))) for k in range(12)] + [(50, None), (51, ""), (52, "two words"), (None, " ".join(text(20)))]
    docs, leaks = [], set()
    for k in range(60):
        body = text(r.randrange(5, 300))
        if k % 3 == 0:
            i = r.randrange(12)
            copy = items[i][1].split()
            if k % 2:  # an edited copy: words replaced, dropped and added, case and signs changed
                for _ in range(len(copy) // 6):
                    at = r.randrange(len(copy))
                    r.choice([lambda: copy.__setitem__(at, "new%d" % at), lambda: copy.pop(at), lambda: copy.insert(at, "more")])()
                copy = [w.upper() + "!" if r.random() < 0.3 else w for w in copy]
            at = r.randrange(len(body))
            body[at:at] = copy
            leaks.add((k, i))
        docs.append((k, " ".join(body)))
    return items, docs, leaks


def found(spark, docs, items, **more):
    df = spark.createDataFrame([(i, t, 3) for i, t in docs], "doc_id long, text string, item_id int").repartition(3)
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    return d.contaminated(df, bench, **more)


def test_planted_copies_and_no_others(spark):
    items, docs, leaks = corpus()
    docs += [(100, None), (101, ""), (None, items[3][1]), (102, items[4][1] + " " + items[5][1]), (102, items[4][1]), (103, "two words")]
    rows = found(spark, docs, items).collect()
    got = {(r["doc_id"], r["item_id"]) for r in rows if r["doc_id"] is not None and r["doc_id"] < 100}
    assert got == leaks
    assert sorted((r["doc_id"], r["item_id"]) for r in rows if r["doc_id"] == 102) == [(102, 4), (102, 4), (102, 5)]
    assert [r["item_id"] for r in rows if r["doc_id"] is None] == [3]
    for r in rows:
        words = "".join(c if c.isalnum() else " " for c in dict(docs)[r["doc_id"]]).lower().split() if r["doc_id"] != 102 else None
        if words:
            assert 0 <= r["begin_word"] < r["end_word"] <= len(words)


def test_blocks_of_the_benchmark_give_the_same_rows(spark, monkeypatch):
    items, docs, _ = corpus()
    whole = sorted(tuple(r) for r in found(spark, docs, items).collect())
    monkeypatch.setattr(d, "BLOCK_BYTES", 1000)
    assert sorted(tuple(r) for r in found(spark, docs, items).collect()) == whole


def test_a_copy_in_most_documents_is_found_in_all(spark):
    items, _, _ = corpus()
    docs = [(k, f"begin{k} {items[0][1]} end{k}") for k in range(50)]
    assert {r["doc_id"] for r in found(spark, docs, items).collect()} == set(range(50))


def test_clean_documents_and_empty_tables(spark):
    items, docs, leaks = corpus()
    df = spark.createDataFrame([*docs, (None, "clean")], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {r["doc_id"] for r in d.clean_documents(df, bench).collect()} == {i for i, _ in docs} - {i for i, _ in leaks} | {None}
    assert found(spark, docs, []).count() == 0
    assert d.contaminated(df.limit(0), bench).count() == 0


def test_single_edited_copies_and_an_excerpt(spark):
    r = random.Random(8)
    items = [(k, [f"w{r.randrange(400)}" for _ in range(r.choice([20, 40]))]) for k in range(80)]
    docs = []
    for k, words in items:  # one copy of each, 20 to 25 % of its words replaced
        copy = [*words]
        for at in r.sample(range(len(copy)), int(len(copy) * r.choice([0.2, 0.25]))):
            copy[at] = f"new{at}"
        docs.append((k, [f"f{k}x{j}" for j in range(20)] + copy))
    long = [f"long{j}" for j in range(400)]
    items.append((80, long))
    docs.append((80, ["before", *long[170:220], "behind"]))
    grams = lambda words: set(zip(words, words[1:], words[2:], strict=False))
    expect = {k for (k, words), (_, text) in zip(items[:80], docs[:80], strict=True) if plain_alignment(words, text) >= len(words) and grams(words) & grams(text)}
    assert len(expect) > 60
    # a common passage that leaves one item only common trigrams: a full copy's rarer ones must not hide an edited one's
    docs += [(100 + k, items[1][1][: len(items[1][1]) * 2 // 3] + [f"g{k}"]) for k in range(20)] + [(200, items[1][1])]
    got = found(spark, [(i, " ".join(t)) for i, t in docs], [(i, " ".join(t)) for i, t in items]).collect()
    assert {(x["doc_id"], x["item_id"]) for x in got if x["doc_id"] < 80} == {(k, k) for k in expect}
    assert [x["score"] for x in got if x["doc_id"] == 80] == [1.0]
    assert {x["doc_id"] for x in got if x["doc_id"] >= 100} == {*range(100, 120), 200}


def test_a_large_benchmark_without_words(spark):
    """Blocks of items without a word still give a result."""
    items = spark.createDataFrame([(k, "... --- !!! " * 350) for k in range(1200)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "some words stand here")], "doc_id long, text string")
    assert d.contaminated(docs, items).count() == 0
    assert d.clean_documents(docs, items).count() == 1
