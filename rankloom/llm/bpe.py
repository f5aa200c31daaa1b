"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

The distinct words of a slice of texts lie in one flat array of symbols. In each round every word finds the
adjacent pair of lowest rank (binary search over the sorted pair keys) and merges all its occurrences; words
without a mergeable pair leave. Merging all occurrences at once gives the same result as one at a time if every
symbol is made by one merge only and parts are made before wholes, which ``Vocabulary`` checks.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from rankloom.llm.common import slices

#: Fixed value: the split pattern of this kind of vocabulary.
PIECES = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself if printable, else the next one from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


#: Distinct words whose ids a task keeps between slices; beyond it starts anew, so memory stays bounded.
KEPT_WORDS = 400_000


class Vocabulary:
    """Pair keys sorted for binary search, and the bytes of every id."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids: dict[str, int] = spec["model"]["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        left, right = (np.array([ids[m[k]] for m in merges], dtype=np.int64) for k in (0, 1))
        made = np.array([ids[a + b] for a, b in merges], dtype=np.int64)
        self.size = max(ids.values()) + 1
        rank = np.full(self.size, -1, dtype=np.int64)
        rank[made] = np.arange(len(made))
        if len(set(made.tolist())) != len(made) or (rank[left] >= np.arange(len(made))).any() or (rank[right] >= np.arange(len(made))).any():
            raise ValueError("a symbol is made by several merges or used before it is made; rounds would not be exact")
        keys = left * self.size + right
        order = np.argsort(keys)
        self.keys, self.ranks, self.made = keys[order], np.arange(len(made))[order], made
        letters = byte_letters()
        self.byte_id = np.array([ids[c] for c in letters], dtype=np.int64)
        back = {c: b for b, c in enumerate(letters)}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of: list[bytes] = [b""] * max(self.size, *(i + 1 for i in self.special.values())) if self.special else [b""] * self.size
        for text, i in ids.items():
            self.bytes_of[i] = bytes(back[c] for c in text) if all(c in back for c in text) else text.encode()
        for text, i in self.special.items():
            self.bytes_of[i] = text.encode()
        self._forget()
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def _forget(self) -> None:
        self.index: dict[str | int, int] = {}
        self.flat, self.begin, self.count = (np.empty(0, np.int64) for _ in range(3))

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and the offsets of each word."""
        raw = [w.encode() for w in words]
        lengths = np.array([len(w) for w in raw], dtype=np.int64)
        symbols = self.byte_id[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        word = np.repeat(np.arange(len(raw)), lengths)
        done_symbols, done_words = [], []
        while len(symbols):
            pair = symbols[:-1] * self.size + symbols[1:]
            at = np.searchsorted(self.keys, pair)
            at[at == len(self.keys)] = 0
            hit = (self.keys[at] == pair) & (word[:-1] == word[1:])
            rank = np.where(hit, self.ranks[at], len(self.made))
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            lowest = np.minimum.reduceat(np.append(rank, len(self.made)), first)
            of_word = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(symbols))))
            alive = (lowest < len(self.made))[of_word]
            if not alive.all():
                done_symbols.append(symbols[~alive])
                done_words.append(word[~alive])
            merge = np.append(hit & (rank == lowest[of_word][:-1]), False) & alive
            merge = self._leftmost(merge, symbols)
            symbols = np.where(merge, self.made[np.minimum(np.append(rank, 0), len(self.made) - 1)], symbols)
            keep = alive & ~np.concatenate(([False], merge[:-1]))
            symbols, word = symbols[keep], word[keep]
        if not done_words:
            return np.empty(0, np.int64), np.zeros(len(raw) + 1, np.int64)
        symbols, word = np.concatenate(done_symbols), np.concatenate(done_words)
        order = np.argsort(word, kind="stable")
        return symbols[order], np.concatenate(([0], np.cumsum(np.bincount(word, minlength=len(raw)))))

    @staticmethod
    def _leftmost(merge: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Of overlapping merges (a run of one symbol) keeps each second one, from the left."""
        over = merge & np.concatenate(([False], merge[:-1]))
        if not over.any():
            return merge
        at = np.arange(len(merge))
        start = np.maximum.accumulate(np.where(merge & ~over, at, 0))
        return merge & ((at - start) % 2 == 0)

    def pieces(self, text: str) -> list[str | int]:
        """Words of a text; a special token is its id."""
        if self.split is None or not self.split.search(text):
            return PIECES.findall(text)
        out: list[str | int] = []
        at = 0
        for m in self.split.finditer(text):
            out += PIECES.findall(text[at:m.start()])
            out.append(self.special[m[0]])
            at = m.end()
        return out + PIECES.findall(text[at:])

    def _add(self, words: list[str | int]) -> None:
        """Encodes words not met before and appends them to the table of words."""
        ids, offsets = self.encode_words([w if isinstance(w, str) else "" for w in words])
        special = [(k, w) for k, w in enumerate(words) if not isinstance(w, str)]
        begin, count = offsets[:-1] + len(self.flat), np.diff(offsets)
        for n, (k, w) in enumerate(special):
            begin[k], count[k] = len(self.flat) + len(ids) + n, 1
        self.flat = np.concatenate([self.flat, ids, np.array([w for _, w in special], dtype=np.int64)])
        self.begin, self.count = np.append(self.begin, begin), np.append(self.count, count)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. Words met before are kept, up to ``KEPT_WORDS`` of them."""
        if len(self.index) > KEPT_WORDS:
            self._forget()
        index, known = self.index, len(self.index)
        docs = []
        for t in texts:
            pieces = self.pieces(t)
            docs.append(np.fromiter((index.setdefault(p, len(index)) for p in pieces), dtype=np.int64, count=len(pieces)))
        if len(index) > known:
            self._add(list(islice(index, known, None)))
        out = []
        for d in docs:
            n = self.count[d]
            ends = np.cumsum(n)
            out.append(self.flat[np.repeat(self.begin[d] - ends + n, n) + np.arange(ends[-1])] if len(d) else np.empty(0, np.int64))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; invalid UTF-8 becomes U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, decoded string): one row per input row; a null or empty text has no ids.

    ``path`` is the vocabulary file, present on every machine. Texts are encoded whole; memory is bounded by a
    slice of about 2 MB of text or one text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for part, raw in slices(batches, "text"):
            ids = vocab.encode([t.decode("utf-8", "replace") for t in raw])
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
            flat = np.concatenate(ids).astype(np.int32) if ids else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array([vocab.decode(x) for x in ids], pa.string())],
                ["doc_id", "ids", "decoded"],
            )

    src = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of ``encode``'s rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, at = b["ids"].values.to_numpy(zero_copy_only=False), b["ids"].offsets.to_numpy()
            ids = [hashlib.sha256(flat[i:j].astype("<u4").tobytes()).hexdigest() for i, j in zip(at[:-1], at[1:], strict=True)]
            decoded = [hashlib.sha256(t.encode()).hexdigest() for t in b["decoded"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], pa.array(np.diff(at).astype(np.int64)), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return encoded.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
