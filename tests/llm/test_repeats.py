"""Removal of repeated strings against a count of all strings."""

import random
from collections import Counter

import numpy as np
import pytest

from oracle import compare, connect
from rankloom.llm import queries as Q
from rankloom.llm import repeats


def expected(texts):
    """(spans, kept) of every text by counting every 200-byte string."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i:i + 200] for d in data for i in range(len(d) - 199))
    out = []
    for d in data:
        spans = []
        for i in range(len(d) - 199):
            if seen[d[i:i + 200]] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], i + 200)
                else:
                    spans.append((i, i + 200))
        cuts = [0, *[x for s in spans for x in s], len(d)]
        out.append((spans, b"".join(d[a:b] for a, b in zip(cuts[0::2], cuts[1::2]))))
    return out


def some_texts(seed, n=40):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 9)))
    pool = [" ".join(word() for _ in range(rng.randrange(20, 90))) for _ in range(6)]
    texts = [None, "", "short", "z" * 199, "z" * 200, "q" * 900, "ab" * 300, pool[0], pool[0]]
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            p = rng.choice(pool)
            a = rng.randrange(len(p))
            parts.append(rng.choice([p, p[a:], p[:a], " ".join(word() for _ in range(rng.randrange(1, 40)))]))
        texts.append(" ".join(parts))
    return texts


def run(spark, texts, **how):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    rows = {r["doc_id"]: r for r in repeats.remove_repeats(df, **how).collect()}
    assert len(rows) == len(texts)
    return [([tuple(s) for s in rows[i]["spans"]], bytes(rows[i]["kept"])) for i in range(len(texts))]


@pytest.mark.parametrize("seed", range(2))
def test_equals_a_count_of_all_strings(spark, seed):
    texts = some_texts(seed)
    assert run(spark, texts) == expected(texts)


def test_keys_of_too_many_pieces_are_halved(spark):
    """A passage shorter than a string, in many surroundings, brings more pieces to its key than a task may take."""
    rng = random.Random(4)
    stem = "".join(rng.choice("abcdefgh") for _ in range(150))
    noise = lambda n: "".join(rng.choice("ijklmnop") for _ in range(n))
    texts = [noise(90) + stem + noise(90) for _ in range(60)]
    texts += [t[:r] + noise(40) for t, r in zip(texts[:12], range(200, 320, 10))] + [noise(40) + t[60:] for t in texts[20:26]]
    want = expected(texts)
    assert sum(bool(s) for s, _ in want) > 20
    assert run(spark, texts, sort_bytes=3000) == want


def test_a_long_text_in_parts(spark, monkeypatch):
    rng = random.Random(9)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(400))
    long = "".join(rng.choice("abcdefgh ") for _ in range(1_100_000))
    at = (1 << 20) - 150
    texts = [long[:at] + passage + long[at:], "x" + passage, long[at - 300:at + 10]]
    assert run(spark, texts) == expected(texts)


def test_empty_table_and_clashing_names(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert repeats.remove_repeats(none).count() == 0
    df = spark.createDataFrame([(1, "k" * 250, 3, "s"), (None, "k" * 250, 4, None)], "doc_id long, text string, h int, spans string")
    out = repeats.remove_repeats(df)
    assert out.columns == ["doc_id", "text", "h", "spans", "kept"]
    assert sorted((r["h"], bytes(r["kept"]), [tuple(s) for s in r["spans"]]) for r in out.collect()) == [(3, b"", [(0, 250)]), (4, b"", [(0, 250)])]


@pytest.mark.parametrize("alphabet", [1, 2, 3, 250])
def test_suffixes_are_in_order(alphabet):
    rng = np.random.default_rng(alphabet)
    for n in (1, 5, 400, 3000):
        buf = np.tile(rng.integers(0, alphabet, max(1, n // 3), dtype=np.uint8), 3)
        raw = buf.tobytes()
        whole = [i for i in repeats.suffix_array(buf, 200) if i + 200 <= len(raw)]
        assert sorted(whole) == list(range(max(0, len(raw) - 199)))
        strings = [raw[i:i + 200] for i in whole]
        assert strings == sorted(strings)
        shared = repeats.adjacent_prefixes(buf, np.array(whole, dtype=np.int64), 200)
        for a, b, got in zip(strings, strings[1:], shared[1:], strict=False):
            assert got == next((k for k in range(200) if a[k] != b[k]), 200)


def test_only_wanted_suffixes_are_sorted():
    rng = np.random.default_rng(2)
    buf = np.tile(rng.integers(97, 100, 700, dtype=np.uint8), 2)
    wanted = np.zeros(len(buf), bool)
    wanted[100:300] = True
    order = repeats.suffix_array(buf, 200, wanted)
    assert len(order) < 330
    mine = order[wanted[order]]
    raw = buf.tobytes()
    assert [raw[i:i + 200] for i in mine] == sorted(raw[i:i + 200] for i in range(100, 300))


def test_query_matches_sql(spark):
    sf = "/root/testdata/sf0.001"
    ok, message = compare(spark, connect(sf), "op13_suffix_dedup", Q.op13_suffix_dedup, repeats.SQL, sf)
    assert ok, message
