"""Languages of made words are told apart on held-out texts; nulls, letterless and close texts."""

import random

from rankloom.llm import language

SYLLABLES = {"aa": ["ka", "mo", "ti", "ru"], "bb": ["sch", "ein", "ung", "ber"], "cc": ["éa", "ou", "tion", "le"]}


def text(lang, r, n):
    words = ["".join(r.choice(SYLLABLES[lang]) for _ in range(r.randrange(1, 4))) for _ in range(n)]
    return " ".join(w.upper() if r.random() < 0.1 else w for w in words) + "!! 12 ###"


def rows(seed, n=120):
    r = random.Random(seed)
    return [(k, text(lang := r.choice(list(SYLLABLES)), r, r.choice([3, 20, 2000])), lang) for k in range(n)]


def test_held_out_texts(spark):
    learn = spark.createDataFrame([*rows(1), (500, None, "aa"), (501, "words", None), (502, "", "dd")], "doc_id long, text string, lang string")
    known = language.train(learn)
    assert set(known) == {"aa", "bb", "cc"}
    made = rows(2)
    more = [(900, None, "x"), (901, "", "x"), (902, " 12 ## \n", "x"), (None, "kamo tiru kamo", "x"), (1, made[1][1], "x")]
    df = spark.createDataFrame([(i, t, g, 0.5) for i, t, g in made + more], "doc_id long, text string, lang string, score double")
    got = language.identify(df, known, keep=("doc_id", "lang", "text"))
    assert got.columns == ["doc_id", "lang_pred", "score", "margin", "rejected", "doc_id", "lang", "text"]
    out = [tuple(x) for x in got.collect()]
    assert len(out) == len(made) + len(more)
    told = [x for x in out if x[6] != "x"]
    assert sum(x[1] == x[6] for x in told) >= 0.98 * len(told)
    for x in out:
        assert 0 <= x[2] <= 1 and x[0] == x[5]
        if x[0] in (900, 901, 902):
            assert x[1] == "und" and x[4]
        elif x[6] == "x":
            assert x[1] != "und"


def test_dictionaries_are_bounded_and_repeatable(spark):
    df = spark.createDataFrame(rows(3), "doc_id long, text string, lang string")
    a, b = language.train(df, texts=5, size=300), language.train(df.repartition(5), texts=5, size=300)
    assert a == b and all(0 < len(x) <= 300 for x in a.values())


def test_pieces_cover_the_whole_text():
    for t in (b"", b"x" * 10_000, b" ".join(b"word%d" % k for k in range(5000))):
        assert b"".join(language._pieces(t)) == t


def test_nothing_learned_and_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert language.train(empty) == {}
    got = language.identify(spark.createDataFrame([(1, "text")], "doc_id long, text string"), {}).first()
    assert got["lang_pred"] == "und" and got["rejected"]
    assert language.identify(empty, {"aa": b"kamo"}).count() == 0
    one = language.identify(spark.createDataFrame([(1, "kamo")], "doc_id long, text string"), {"aa": b"kamo"}).first()
    assert one["lang_pred"] == "aa" and not one["rejected"]
