"""The encoder against the public library, round trips, nulls and extra columns."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rankloom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
VOCAB = bpe.vocabulary(PATH)
LIBRARY = Tokenizer.from_file(PATH)
LIBRARY.no_truncation()
LIBRARY.no_padding()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text_as_the_library_does(text):
    ids = VOCAB.encode([text])[0]
    assert ids.tolist() == LIBRARY.encode(text, add_special_tokens=False).ids
    assert VOCAB.decode(ids) == LIBRARY.decode(ids.tolist(), skip_special_tokens=False) == text


@pytest.mark.parametrize("text", [
    "", " ", "aaaaaaaaaaaaaaaaaaaaaaaaa", "a" * 5000, "x<|endoftext|>y <|endoftext|><|endoftext|>", "\x1c \x85 ", "it's we'll I'M", "  \n\n  a", "ééé 日本 🙂",
    "0123456789 ٣٤", "https://a.b/c?d=e&f", "\u2028\u00a0x\u3000",
])
def test_hard_texts(text):
    assert VOCAB.encode([text])[0].tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_words_are_forgotten_within_bounds(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_WORDS", 10)
    texts = [f"word{k} other{k * 7}" for k in range(50)]
    for t in texts:
        assert VOCAB.encode([t, t])[1].tolist() == LIBRARY.encode(t, add_special_tokens=False).ids


def test_unknown_ids_decode_with_replacement():
    half = [i for i, b in enumerate(VOCAB.bytes_of) if b == b"\xe6"][0]
    assert VOCAB.decode(np.array([half])) == LIBRARY.decode([half], skip_special_tokens=False)


def test_query_rows(spark):
    rows = [(1, "hello  world", "x"), (2, None, None), (3, "", "y"), (3, "again", "y"), (None, "no id", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.digests(bpe.encode(df, PATH)).collect()
    assert len(got) == 5
    for r, (doc, text, _) in zip(sorted(got, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"])), [rows[0], rows[1], rows[2], rows[3], rows[4]]):
        ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
        assert r["doc_id"] == doc and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.digests(bpe.encode(df.limit(0), PATH)).count() == 0
