"""Benchmark decontamination: n-gram seeds find passages near test items, Smith-Waterman alignment scores them.

Words are lower-cased, ASCII signs count as space. Every word trigram of an item is a seed. Where a document holds
one, the words around it are aligned with the item (match +2, mismatch -1, gap -1); the best local score, as a part of
a full copy's, decides. Edited and paraphrased copies keep some seed and most of the score. No seed is left out for
being common: what common ones find is dropped by two upper bounds of the score, words of the item that the document
holds and the best run of such words in the window, so few places are aligned and none that could reach the threshold
is lost.

The test items are put on every machine in blocks of at most ``BLOCK_BYTES`` of text, one pass over the documents for
each block, so a benchmark of any size is compared whole. Memory is bounded by a block and a slice of documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import hash_words, slices, stored

SEED_WORDS = 3
BLOCK_BYTES = 8 << 20
#: Longer items count as found where this many words of them are.
FULL_WORDS = 50
MATCH, MISMATCH, GAP = 2, -1, -1

_PLAIN = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()


def plain_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts and the offsets of each text's words."""
    cleaned = [t.translate(_PLAIN) for t in texts]
    hashes, starts = hash_words(b"\n".join(cleaned))
    ends = np.cumsum([len(t) + 1 for t in cleaned])
    return hashes, np.concatenate(([0], np.searchsorted(starts, ends)))


@dataclass
class Items:
    """A block of test items as word numbers, and where each trigram stands."""

    ids: list[int]
    words: list[np.ndarray]
    vocabulary: np.ndarray
    grams: np.ndarray
    gram_item: np.ndarray
    gram_start: np.ndarray
    maybe: np.ndarray

    @property
    def full(self) -> np.ndarray:
        """The score of a full copy of each item."""
        return np.array([MATCH * min(len(w), FULL_WORDS) for w in self.words], dtype=np.int64)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word in the items' vocabulary, -1 if it has none."""
        out = np.full(len(hashes), -1, dtype=np.int64)
        if not len(self.vocabulary):
            return out
        some = np.flatnonzero(self.maybe[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.vocabulary, hashes[some]), len(self.vocabulary) - 1)
        found = self.vocabulary[at] == hashes[some]
        out[some[found]] = at[found]
        return out

    def keys(self, numbers: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Trigram keys of places whose three words are known and stand in one document, and the places."""
        size = len(self.vocabulary) + 1
        n = SEED_WORDS
        if len(numbers) < n:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        good = doc[: len(doc) - n + 1] == doc[n - 1:]
        key = np.zeros(len(good), dtype=np.int64)
        for k in range(n):
            w = numbers[k: len(numbers) - n + 1 + k]
            good &= w >= 0
            key = key * size + w
        at = np.flatnonzero(good)
        return key[at], at


def make_items(rows: list[tuple[int, str]]) -> Items:
    hashes, offsets = plain_words([t.encode() for _, t in rows])
    vocabulary = np.unique(hashes)
    maybe = np.zeros(1 << 16, dtype=bool)
    maybe[(vocabulary & np.uint64(0xFFFF)).astype(np.int64)] = True
    empty = np.empty(0, np.int64)
    items = Items([i for i, _ in rows], [], vocabulary, empty, empty, empty, maybe)
    numbers = items.numbers(hashes)
    items.words = [numbers[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    doc = np.repeat(np.arange(len(rows)), np.diff(offsets))
    key, at = items.keys(numbers, doc)
    where = np.unique(np.stack([key, doc[at]]), axis=1) if len(key) else np.empty((2, 0), np.int64)
    items.grams, items.gram_start = np.unique(where[0], return_index=True)
    items.gram_start = np.append(items.gram_start, where.shape[1])
    items.gram_item = where[1]
    return items


def _places(offsets: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def could(items: Items, numbers: np.ndarray, offsets: np.ndarray, doc: np.ndarray, item: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Which (document, item) pairs, ordered by document, hold as many words of the item as a score of ``need`` takes."""
    size = np.array([len(w) for w in items.words], dtype=np.int64)
    begin = np.cumsum(size) - size
    words = np.concatenate([*items.words, np.empty(0, np.int64)])
    held = np.zeros(len(items.vocabulary) + 1, dtype=bool)
    out = np.zeros(len(item), dtype=bool)
    edge = np.concatenate(([0], np.flatnonzero(doc[1:] != doc[:-1]) + 1, [len(doc)]))
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        if a == b:
            continue
        own = numbers[offsets[doc[a]]:offsets[doc[a] + 1]]
        held[own] = True
        held[-1] = False  # words of no item
        n = size[item[a:b]]
        start = np.cumsum(n) - n
        of = words[np.arange(n.sum()) + np.repeat(begin[item[a:b]] - start, n)]
        out[a:b] = MATCH * np.add.reduceat(held[of].astype(np.int64), start) >= need[item[a:b]]
        held[own] = False
    return out


def bound(inside: np.ndarray) -> int:
    """The most an alignment with a window can score: its words gain where the item has them and cost where not."""
    total = np.concatenate(([0], np.cumsum(np.where(inside, MATCH, max(MISMATCH, GAP)))))
    return int((total - np.minimum.accumulate(total)).max())


def align(item: np.ndarray, window: np.ndarray) -> tuple[int, int]:
    """Best local score of two word sequences, and where in the window that alignment ends (exclusive)."""
    row = np.zeros(len(window) + 1, dtype=np.int64)
    slope = np.arange(len(window) + 1) * -GAP
    best, end = 0, 0
    for w in item:
        new = np.zeros_like(row)
        new[1:] = np.maximum(np.maximum(row[:-1] + np.where(window == w, MATCH, MISMATCH), row[1:] + GAP), 0)
        row = np.maximum.accumulate(new + slope) - slope
        k = int(row.argmax())
        if row[k] > best:
            best, end = int(row[k]), k
    return best, end


def held(raw: list[bytes], items: Items, threshold: float) -> dict[tuple[int, int], tuple[int, int, int]]:
    """For each text and item it holds: the best score, and the words where that place begins and ends."""
    full = items.full
    hashes, offsets = plain_words(raw)
    doc = _places(offsets)
    numbers = items.numbers(hashes)
    key, at = items.keys(numbers, doc)
    g = np.searchsorted(items.grams, key)
    g[g == len(items.grams)] = 0
    known = items.grams[g] == key if len(items.grams) else np.zeros(len(key), bool)
    g, at = g[known], at[known]
    n = items.gram_start[g + 1] - items.gram_start[g]
    rank = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    item, place = items.gram_item[np.repeat(items.gram_start[g], n) + rank], np.repeat(at, n)
    order = np.lexsort((place, item, doc[place]))
    item, place = item[order], place[order]
    pair = np.append(True, (item[1:] != item[:-1]) | (doc[place][1:] != doc[place][:-1])) if len(item) else np.zeros(0, bool)
    some = could(items, numbers, offsets, doc[place[pair]], item[pair], threshold * full)[np.cumsum(pair) - 1]
    item, place = item[some], place[some]
    inside = np.zeros(len(items.vocabulary) + 1, dtype=bool)
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    k = 0
    while k < len(item):  # a run of seeds of one item that stand near each other
        i, d, size = int(item[k]), int(doc[place[k]]), len(items.words[item[k]])
        j = k + 1
        while j < len(item) and item[j] == i and doc[place[j]] == d and place[j] - place[j - 1] <= 2 * size:
            j += 1
        lo, hi = max(offsets[d], place[k] - 2 * size), min(offsets[d + 1], place[j - 1] + 2 * size)
        window = numbers[lo:hi]
        need = threshold * full[i]
        inside[items.words[i]] = True
        most = bound(inside[window])
        inside[items.words[i]] = False
        if most >= need:
            score, end = align(items.words[i], window)
            if score >= need and score > best.get((d, i), (0,))[0]:
                _, back = align(items.words[i][::-1], window[:end][::-1])
                best[d, i] = score, int(lo + end - back - offsets[d]), int(lo + end - offsets[d])
        k = j
    return best


def search(docs: DataFrame, items: Items, threshold: float) -> DataFrame:
    full = items.full

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw in slices(batches, "text"):
            ids = part["doc_id"].to_pylist()
            rows = [(ids[d], items.ids[i], b[0] / float(full[i]), b[1], b[2]) for (d, i), b in held(raw, items, threshold).items()]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "item_id", "score", "begin_word", "end_word"])

    return docs.mapInArrow(run, "doc_id long, item_id long, score double, begin_word long, end_word long")


def blocks_of(benchmark: DataFrame, item_id: str = "item_id", item_text: str = "text") -> Iterator[tuple[Items, int]]:
    """The test items in blocks of about half of ``BLOCK_BYTES``, with the number of blocks."""
    test = benchmark.select(benchmark[item_id].cast("long").alias("item_id"), benchmark[item_text].cast("string").alias("text")).where("text is not null")
    size = test.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # half of the bound on average; items are spread by their hash
    blocks = 1 + int(2 * size // BLOCK_BYTES)
    for k in range(blocks):
        block = test if blocks == 1 else test.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        items = make_items(sorted(((r["item_id"], r["text"]) for r in block.toLocalIterator()), key=lambda r: (r[0] is None, r)))
        if sum(map(len, items.words)) or k == blocks - 1:  # the last one always, so that there is a result
            yield items, blocks


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, doc_id: str = "doc_id", text: str = "text",
                 item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, score, begin_word, end_word): documents that hold a copy of a test item, edited or not.

    ``score`` is the alignment's part of a full copy's (of ``FULL_WORDS`` words for longer items), the best place's if
    there are several; it may exceed 1 for items longer than that. Null or empty texts match nothing, nor do items of
    fewer than three words. Repeated rows give repeated pairs; rows without an id keep the null.
    """
    src = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    out = None
    for items, blocks in blocks_of(benchmark, item_id, item_text):
        found = search(src, items, threshold)
        found = stored(found, "contaminated") if blocks > 1 else found
        out = found if out is None else out.union(found)
    return out


def clean_documents(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any others) that hold no test item, each judged by its own text."""
    names = [f"c{k}" for k in range(len(docs.columns))]
    at = docs.columns.index("text")
    kind = ", ".join(f"`{n}` {t}" for n, (_, t) in zip(names, docs.dtypes, strict=True))
    out = docs.toDF(*names)
    for items, _ in blocks_of(benchmark):

        def run(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for part, raw in slices(batches, names[at]):
                bad = {d for d, _ in held(raw, items, threshold)}
                yield part.filter(pa.array([d not in bad for d in range(len(raw))], pa.bool_()))

        out = out.mapInArrow(run, kind)
    return out.toDF(*docs.columns)
