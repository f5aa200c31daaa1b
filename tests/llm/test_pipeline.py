"""The pipeline's stages against plain Python on a small corpus, and the registered queries' shape."""

import random

import corpus_pipeline
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__
from rankloom.llm import jaccard, pii, queries

SF = "/root/testdata/sf0.001"


def corpus(spark, tmp_path):
    r = random.Random(6)
    syllables = {"aa": ["ka", "mo", "ti", "ru"], "bb": ["sch", "ein", "ung", "ber"]}
    text = lambda g, n: " ".join("".join(r.choice(syllables[g]) for _ in range(r.randrange(1, 5))) for _ in range(n))
    items = [(k, text("aa", 25)) for k in range(4)]
    rows = []
    for k in range(80):
        g = r.choice(["aa", "bb"])
        rows.append((k, text(g, r.choice([30, 60, 400])), g, "s"))
    for k in range(10):  # near copies, leaks and personal data
        rows.append((100 + k, rows[k][1] + " end", rows[k][2], "s"))
        rows.append((200 + k, rows[20 + k][1] + " " + items[k % 4][1], rows[20 + k][2], "s"))
        rows.append((300 + k, f"{text('aa', 30)}\nmail me{k}@corp.example or +49 (30) 12345{k}7", "aa", "s"))
    rows += [(400, "123 ### !!", "aa", "s"), (401, None, None, None), (402, "", "bb", "s"), (None, text("aa", 50), "aa", None), (300, None, "aa", "s")]
    docs = spark.createDataFrame([(i, t, g, s, len(t or "")) for i, t, g, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return rows, items


def test_stages(spark, tmp_path):
    rows, items = corpus(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    at = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        at[name] = docs.collect()
        if name != "bpe":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = {n: sorted((r["doc_id"] for r in x), key=lambda i: (i is None, i)) for n, x in at.items()}
    has_letters = [i for i, t, _, _ in rows if any(c.isalpha() for c in t or "")]
    assert ids["language_id"] == sorted(has_letters, key=lambda i: (i is None, i))
    copies = {100 + k for k in range(10)}
    near = {200 + k for k in range(10) if len(rows[20 + k][1].split()) > 90}
    assert set(ids["jaccard_join"]) == set(has_letters) - copies - near
    assert set(ids["decontamination"]) == set(ids["jaccard_join"]) - {200 + k for k in range(10)}
    masked = {r["doc_id"]: r["text"] for r in at["pii"]}
    for i, t, _, _ in rows:
        if i in masked and (i or 0) < 300:
            assert masked[i] == t
        elif i in masked and t:
            assert masked[i].endswith("mail [EMAIL] or [PHONE]") and not pii.base_spans(masked[i])
    assert all(r["n_chars"] == len(r["text"]) for r in at["pii"])
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in at["bpe"]:
        assert r["n_tokens"] == len(library.encode(masked[r["doc_id"]], add_special_tokens=False).ids)
    assert sorted(r["doc_id"] or -1 for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted(r["doc_id"] or -1 for r in at["bpe"])


def test_one_row_stays_of_repeated_ids(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g", "x"), (1, "a b c d e f g", "x"), (2, "a b c d e f g", "y"), (3, "other words", "z")], "doc_id long, text string, lang string")
    got = corpus_pipeline.jaccard_join(spark, docs, "")
    assert sorted(r["doc_id"] for r in got.collect()) == [1, 3]
    assert jaccard.join(docs).count() == 4


def test_rows_of_one_id_are_judged_each(spark):
    copied, alone, other = "a b c d e f g", "rows of another text under the same id", "one more text of the seventh id"
    rows = [(3, copied), (7, copied), (7, alone), (7, other), (7, other), (8, "q r s t u v w x y z 1 2 3 4 5 6 7 8 9"), (8, "q r s t u v w x y z 1 2 3 4 5 6 7 8 9 0"), (9, ""), (9, None), (None, copied)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, lang string").repartition(3)
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.jaccard_join(spark, docs, "").collect()]
    assert sorted(x for x in got if x[0] in (3, 7)) == [(3, copied), (7, other), (7, alone)]
    assert sum(x[0] == 8 for x in got) == 1 and {x[1] for x in got if x[0] == 9} == {"", None} and (None, copied) in got and len(got) == 7


def test_contaminated_rows_take_no_other_rows_along(spark, tmp_path):
    item = " ".join(f"item{k}" for k in range(20))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, "before " + item), (None, "clean"), (5, item), (5, "clean too"), (6, None)]
    docs = spark.createDataFrame([(t, i, 3) for i, t in rows], "text string, doc_id long, n int")
    got = corpus_pipeline.decontamination(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    assert {(r["doc_id"], r["text"]) for r in got.collect()} == {(None, "clean"), (5, "clean too"), (6, None)}


def test_registered():
    names = set(__spark_entry__.queries())
    assert set(queries.queries()) <= names and "pipeline" in names
    assert {n.split("_")[0] for n in queries.queries()} == {f"op{k}" for k in range(1, 11)}


TABLES = {**{f"op{k}": "documents" for k in (3, 4, 5, 6, 7, 9)}, "op2": "embeddings", "op8": "pages", "op10": "pages"}


@pytest.mark.parametrize("name", [n for n in queries.queries() if n.split("_")[0] in TABLES])
def test_a_row_for_each_row(spark, name):
    table = spark.read.parquet(f"{SF}/{TABLES[name.split('_')[0]]}.parquet")
    key = table.columns[0]
    got = queries.queries()[name](spark, SF)
    assert sorted(r[key] for r in got.select(key).collect()) == sorted(r[key] for r in table.select(key).collect())
