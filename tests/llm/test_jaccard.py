"""The Jaccard join against brute force, with and without its hot and chunked roads."""

import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rankloom.llm import jaccard


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if rows[a][0] is None or rows[b][0] is None or not sets[a] or not sets[b]:
            continue
        if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return sorted(((i, len(sets[k]), least.get(root(k)) if i is not None else None) for k, (i, _) in enumerate(rows)), key=str)


def made_rows(seed):
    """Groups of near copies that chain, shared passages, exact copies, short, empty and null texts."""
    r = random.Random(seed)
    word = lambda: "w%d" % min(int(r.expovariate(0.02)), 400)
    passage = " ".join(word() for _ in range(30))
    rows, k = [], 0
    for _ in range(14):
        base = [word() for _ in range(r.randrange(20, 90))]
        for _ in range(r.choice([1, 1, 2, 6])):
            rows.append((k := k + 1, " ".join(base)))
            if r.random() < 0.7:
                base[r.randrange(len(base))] = word()
            if r.random() < 0.3:
                base.append(word())
    rows += [(k + n, f"{passage} x{n} y{n} z{n}") for n in range(1, 12)] + [(k + 20 + n, f"a{n} b{n} {passage} " + " ".join(word() for _ in range(40))) for n in range(8)]
    rows += [(900, None), (901, ""), (902, " \n\t"), (903, "one two"), (904, "ONE  two"), (905, "two one"), (None, "one two"), (None, None), (5, rows[4][1]), (6, "another text for a repeated id")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("hot", [False, True])
def test_join_is_brute_force(spark, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(jaccard, "CHUNK", 2)
        monkeypatch.setattr(jaccard, "POST_BYTES", 2000)
    rows = made_rows(3 + hot)
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, cls int, rep string").repartition(3)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.join(df).collect()), key=str)
    assert got == brute(rows)


def test_empty_table(spark):
    assert jaccard.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_threshold_is_exact():
    for a in range(1, 60):
        for b in range(1, 60):
            need = jaccard.needed_overlap(a, b)
            for o in range(0, min(a, b) + 1):
                assert (o >= need) == (100 * o >= 75 * (a + b - o))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sets(st.integers(0, 30), max_size=20), max_size=12), st.integers(1, 8))
def test_divide_skip_counts(lists, need):
    lists = [sorted(x) for x in lists]
    want = {v: n for v in range(31) if (n := sum(v in x for x in lists)) >= need}
    assert jaccard.t_occurrences(lists, need) == want
    assert jaccard.t_occurrences(lists, need, weight=5.0) == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcdefg"), max_size=14), max_size=6))
def test_shingle_sets(texts):
    raw = [" ".join(t).encode() for t in texts]
    h, offsets = jaccard.shingle_sets(raw)
    seen = {}
    for k, t in enumerate(raw):
        own = h[offsets[k]:offsets[k + 1]]
        assert (np.diff(own.astype(object)) > 0).all() if len(own) > 1 else True
        assert len(own) == len(shingles(t.decode()))
        assert seen.setdefault(frozenset(shingles(t.decode())), own.tolist()) == own.tolist()


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 2**63), max_size=300), st.sets(st.integers(0, 2**63), max_size=60), st.sets(st.integers(0, 2**63), max_size=300))
def test_parities_never_drop_a_link(a, both, b):
    a, b = a | both, b | both
    pack = lambda x: jaccard.parity(np.array(sorted(x), dtype=np.uint64))
    if 7 * len(a ^ b) <= len(a) + len(b):
        assert jaccard.may_link(pack(a), pack(b), len(a) + len(b))
    assert jaccard.may_link(pack(a), pack(a), 2 * len(a))


def test_large_group_takes_few_pairs(spark, monkeypatch):
    """Near copies around one text, many of them not linked with one another: pairs grow with the group, not its square."""
    r = random.Random(11)
    base = ["b%d" % k for k in range(150)]
    rows = []
    for k in range(300):
        text = list(base)
        for at in r.sample(range(150), r.choice([1, 2, 3, 3, 4, 4, 4, 5, 5, 6])):
            text[at] = "u%d" % r.randrange(10**9)
        rows.append((k, " ".join(text)))
    made = []

    def counted(pairs, reps, f=jaccard.sieved):
        made.append(pairs.count())
        return f(pairs, reps)

    monkeypatch.setattr(jaccard, "sieved", counted)
    got = sorted(((x["doc_id"], x["n_shingles"], x["component_id"]) for x in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == brute(rows)
    assert sum(made) < 5 * len(rows)
