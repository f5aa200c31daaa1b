"""Katz backoff word bigrams with Good-Turing discounts, learned and evaluated over tables partitioned by key.

Tasks read documents into blocks of some megabytes. A block asks the partitions of the word table for the count and
the number of each of its distinct words, then the partitions of the bigram table for the count of each of its
distinct (history, word) pairs and for what its histories' backoff weights need. What a partition is asked by training
documents is also what it counts, so each table is built and read in one shuffle of distinct keys; tokens themselves
never move. Histories that hold a large share of all tokens are spread over all partitions by their second word.

p(w | h) is d(c) c(h w) / c(h) for pairs seen c times, else alpha(h) p(w); p(w) is d(c) c(w) / N for known words, and
what the discounts leave is the probability of the one symbol that stands for every unknown word. alpha(h) divides
what the pairs of h leave by what their words leave in p, so that each history's probabilities add up to one.
A text starts from a history of its own and closes with an end token.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import mix, parts_for, signed, slices, stored, words_of

BLOCK_BYTES = 10 << 20
#: Counts above it are not discounted.
RELIABLE = 5
ENTRIES_PER_PART = 1_500_000
#: Number of the history before the first word; words have numbers from 1 on.
START = 0
#: Hash that stands for the end token among the words'.
END = np.uint64(0x5BF03635C1A9E2D7)


def pack(*arrays: np.ndarray) -> bytes:
    """Whole numbers or doubles of equal length, byte by byte place, compressed."""
    n = len(arrays[0])
    raw = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(n, 8).T.tobytes() for a in arrays)
    return zstandard.compress(raw, 3)


def unpack(data: bytes, n: int, kinds: str) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(data), dtype=np.uint8).reshape(len(kinds), 8, n) if n else None
    return [np.ascontiguousarray(raw[k].T).view(np.dtype(t)).reshape(n) if n else np.empty(0, np.dtype(t)) for k, t in enumerate({"i": "<i8", "d": "<f8"}[c] for c in kinds)]


@dataclass
class Discounts:
    """Good-Turing discounts of one order: ``d[r]`` for counts r up to ``RELIABLE``."""

    d: np.ndarray

    @staticmethod
    def of(n: np.ndarray) -> Discounts:
        """From n[r], the number of keys seen r times. Where the estimate is no discount for some r (too few data),
        the bound is lowered; if none is left, each count loses n1 / (n1 + 2 n2) (a half without n1)."""
        for k in range(RELIABLE, 0, -1):
            r = np.arange(1, k + 1)
            if (n[1: k + 2] <= 0).any():
                continue
            cut = (k + 1) * n[k + 1] / n[1]
            if cut >= 1:
                continue
            d = ((r + 1) * n[r + 1] / (r * n[r]) - cut) / (1 - cut)
            if (d > 0).all() and (d < 1).all():
                return Discounts(np.concatenate(([1.0], d, np.ones(RELIABLE - k), [1.0])))
        off = n[1] / (n[1] + 2 * n[2]) if n[1] > 0 else 0.5
        off = min(max(off, 0.1), 0.9)
        r = np.arange(1, RELIABLE + 1)
        return Discounts(np.concatenate(([1.0], (r - off) / r, [1.0])))

    def counted(self, c: np.ndarray) -> np.ndarray:
        """Discounted counts."""
        return c * self.d[np.minimum(c, RELIABLE + 1)]


class WordModel:
    """The unigram level: discounts, and the mass left for the unknown symbol."""

    def __init__(self, n: np.ndarray, tokens: int, kept_large: int) -> None:
        self.tokens = tokens
        self.discounts = Discounts.of(n)
        r = np.arange(RELIABLE + 1)
        known = float((self.discounts.counted(r) * n[: RELIABLE + 1]).sum()) + kept_large
        # where no count is small enough to be discounted, one more token is taken as unknown
        self.total = tokens if tokens and known < tokens else tokens + 1
        self.unknown = 1 - known / self.total

    def p(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.discounts.counted(c) / self.total, self.unknown)


def _blocks(parts: int):
    names = ["block", "docs", "entries", "tokens", "places", "part", "n", "asked"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, count = TaskContext.get().partitionId(), 0
        held: list[tuple[list, np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal count, size
            if not held:
                return
            ids = [i for x, _, _ in held for i in x]
            hashes = np.concatenate([h for _, h, _ in held])
            lengths = np.concatenate([n for _, _, n in held])
            held.clear()
            size = 0
            training = np.array([i is not None and zlib.crc32(str(i).encode()) % 10 != 0 for i in ids])
            words, local, seen = np.unique(hashes, return_inverse=True, return_counts=True)
            order = np.argsort(-seen, kind="stable")  # frequent words get small numbers, which pack well
            rank = np.empty(len(order), dtype=np.int64)
            rank[order] = np.arange(len(order))
            words, local = words[order], rank[local]
            to = (mix(words) % np.uint64(parts)).astype(np.int64)
            learned = np.bincount(local[np.repeat(training, lengths)], minlength=len(words))
            block = task << 24 | count
            count += 1
            none = pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary())
            docs = pa.array([[{"doc_id": i, "n": int(n), "training": bool(t)} for i, n, t in zip(ids, lengths, training, strict=True)]], DOCS)
            yield pa.RecordBatch.from_arrays([pa.array([block]), docs, pa.array([len(words)]), pa.array([pack(local)], pa.binary()), pa.array([pack(to)], pa.binary()), *none], names)
            order = np.argsort(to, kind="stable")
            cuts = np.searchsorted(to[order], np.arange(parts + 1))
            asked = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            full = [k for k, x in enumerate(asked) if len(x)]
            m = len(full)
            yield pa.RecordBatch.from_arrays(
                [pa.array([block] * m, pa.int64()), pa.nulls(m, DOCS), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary()), pa.array(full, pa.int32()),
                 pa.array([len(asked[k]) for k in full], pa.int64()), pa.array([pack(signed(words[asked[k]]), learned[asked[k]]) for k in full], pa.binary())], names)

        for part, raw in slices(batches, "text"):
            hashes, offsets = words_of(raw)
            n = np.diff(offsets)
            held.append((part["doc_id"].to_pylist(), np.insert(hashes, offsets[1:], END), n + 1))
            size += sum(map(len, raw))
            if size >= BLOCK_BYTES:
                yield from flush()
        yield from flush()

    return run


DOCS = pa.list_(pa.struct([("doc_id", pa.int64()), ("n", pa.int64()), ("training", pa.bool_())]))
BLOCK_SCHEMA = "block long, docs array<struct<doc_id:long,n:long,training:boolean>>, entries long, tokens binary, places binary, part int, n long, asked binary"
#: kind: answer (to a block), stat (counts of counts and the like), hot (sums of a spread history), table (the part itself)
ANSWER = "kind string, block long, part int, n long, data binary"


def _rows(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) or [[]] * 5
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
    return pa.table({n: pa.array(c, t) for n, c, t in zip(("kind", "block", "part", "n", "data"), cols, kinds, strict=True)})


def _word_part(parts: int):
    def run(asked: pa.Table) -> pa.Table:
        blocks, sizes, part = asked["block"].to_pylist(), asked["n"].to_pylist(), asked["part"][0].as_py()
        got = [unpack(d, n, "ii") for d, n in zip(asked["asked"].to_pylist(), sizes, strict=True)]
        keys, at = np.unique(np.concatenate([k for k, _ in got]), return_inverse=True)
        count = np.bincount(at, weights=np.concatenate([c for _, c in got]), minlength=len(keys)).astype(np.int64)
        number = np.arange(len(keys)) * parts + part + 1
        rows = [("table", None, part, len(keys), pack(keys, number, count))]
        small = np.bincount(count[count <= RELIABLE + 1], minlength=RELIABLE + 2)
        large = count[count > RELIABLE]
        rows.append(("stat", None, part, 0, pack(np.concatenate((small, [count.sum(), (count > 0).sum(), large.sum()])))))
        ends = np.cumsum(sizes)
        for b, n, e in zip(blocks, sizes, ends, strict=True):
            w = at[e - n: e]
            rows.append(("answer", b, part, n, pack(number[w], count[w])))
        return _rows(rows)

    return run


class Block:
    """A block's tokens with the answers for its words; its pairs and the partitions they belong to."""

    def __init__(self, row: dict, answers: dict[int, list[np.ndarray]], pair_parts: int, hot: int) -> None:
        self.docs = row["docs"]
        m = row["entries"]
        self.lengths = np.array([d["n"] for d in self.docs], dtype=np.int64)
        self.training = np.array([d["training"] for d in self.docs], dtype=bool)
        self.local = unpack(row["tokens"], int(self.lengths.sum()), "i")[0]
        places = unpack(row["places"], m, "i")[0]
        order = np.argsort(places, kind="stable")  # as the block asked: by partition, within it in its own order
        self.number, self.count = np.zeros(m + 1, np.int64), np.zeros(m + 1, np.int64)
        for k, column in enumerate((self.number, self.count)):
            column[order] = np.concatenate([answers[p][k] for p in sorted(answers)])
        self.number[m] = START
        first = np.cumsum(self.lengths) - self.lengths
        history = np.roll(self.local, 1)
        history[first] = m
        key, pair = np.unique(history * (m + 1) + self.local, return_inverse=True)
        del history
        self.pair = pair.astype(np.int32)
        del pair
        self.h, self.w = (key // (m + 1)).astype(np.int32), (key % (m + 1)).astype(np.int32)
        self.learned = np.bincount(self.pair[np.repeat(self.training, self.lengths)], minlength=len(key)).astype(np.int64)
        self.is_hot = (self.count[self.h] > hot) | (self.h == m)
        code = mix(self.number[self.h].view(np.uint64))
        code = np.where(self.is_hot, mix(code ^ self.number[self.w].view(np.uint64)), code)
        part = (code % np.uint64(pair_parts)).astype(np.int64)
        self.order = np.argsort(part, kind="stable")
        self.cuts = np.searchsorted(part[self.order], np.arange(pair_parts + 1))


def _answers(table: pa.Table, kinds: str) -> dict[int, list[np.ndarray]]:
    return {p: unpack(d, n, kinds) for p, n, d in zip(table["part"].to_pylist(), table["n"].to_pylist(), table["data"].to_pylist(), strict=True)}


def _ask_pairs(pair_parts: int, hot: int):
    """A block's pairs for each partition: history and word numbers, times learned, count of the word."""

    def run(block: pa.Table, words: pa.Table) -> pa.Table:
        out = {"block": [], "part": [], "n": [], "asked": []}
        if block.num_rows:
            b = Block(block.to_pylist()[0], _answers(words, "ii"), pair_parts, hot)
            for part, (i, j) in enumerate(zip(b.cuts[:-1], b.cuts[1:], strict=True)):
                if j > i:
                    e = b.order[i:j]
                    out["block"].append(block["block"][0].as_py())
                    out["part"].append(part)
                    out["n"].append(int(j - i))
                    out["asked"].append(pack(b.number[b.h[e]], b.number[b.w[e]], b.learned[e], b.count[b.w[e]], b.is_hot[e].astype(np.int64)))
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), (pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)})

    return run


#: What a history's backoff weight needs of its pairs: how many were seen 1 .. RELIABLE times, the sum of larger counts,
#: and the probability of their words.
SUMS = RELIABLE + 2


def _history_sums(h: np.ndarray, count: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct histories, and a row of sums for each."""
    who, at = np.unique(h, return_inverse=True)
    out = np.zeros((len(who), SUMS))
    for r in range(1, RELIABLE + 1):
        out[:, r - 1] = np.bincount(at[count == r], minlength=len(who))
    large = count > RELIABLE
    out[:, RELIABLE] = np.bincount(at[large], weights=count[large], minlength=len(who))
    out[:, RELIABLE + 1] = np.bincount(at, weights=p, minlength=len(who))
    return who, out


def _pair_part(words: WordModel):
    def run(asked: pa.Table) -> pa.Table:
        sizes, part = asked["n"].to_pylist(), asked["part"][0].as_py()
        got = [unpack(d, n, "iiiii") for d, n in zip(asked["asked"].to_pylist(), sizes, strict=True)]
        h, w, learned, word_count, is_hot = (np.concatenate([g[k] for g in got]) for k in range(5))
        order = np.lexsort((w, h))
        new = np.concatenate(([True], (h[order][1:] != h[order][:-1]) | (w[order][1:] != w[order][:-1])))
        type_of = np.empty(len(h), dtype=np.int64)
        type_of[order] = np.cumsum(new) - 1
        first = order[new]
        count = np.bincount(type_of, weights=learned, minlength=len(first)).astype(np.int64)
        seen = count > 0
        rows = [("stat", None, part, 0, pack(np.bincount(np.minimum(count[seen], RELIABLE + 2), minlength=RELIABLE + 3)[: RELIABLE + 2]))]
        rows.append(("table", None, part, int(seen.sum()), pack(h[first[seen]], w[first[seen]], count[seen])))
        who, sums = _history_sums(h[first[seen]], count[seen], words.p(word_count[first[seen]]))
        spread = np.isin(who, np.unique(h[is_hot > 0]))
        if spread.any():
            rows.append(("hot", None, part, int(spread.sum()), pack(who[spread], *sums[spread].T)))
        at = 0
        for b, n in zip(asked["block"].to_pylist(), sizes, strict=True):
            e = slice(at, at + n)
            at += n
            rows.append(("answer", b, part, n, pack(count[type_of[e]])))
            own = np.unique(h[e][is_hot[e] == 0])
            if len(own):
                k = np.searchsorted(who, own)
                k[k == len(who)] = 0
                known = who[k] == own if len(who) else np.zeros(len(own), bool)
                table = np.where(known[:, None], sums[k] if len(who) else 0.0, 0.0)
                rows.append(("sums", b, part, len(own), pack(own, *(table[:, c].astype(np.int64) for c in range(SUMS - 1)), table[:, -1])))
        return _rows(rows)

    return run


def backoff(count: np.ndarray, sums: np.ndarray, pairs: Discounts) -> tuple[np.ndarray, np.ndarray]:
    """(total, alpha) of histories: what a pair's discounted count is divided by, and the backoff weight.

    An unknown history backs off with weight 1. Where no count of a history is discounted, one more is added to its
    total, so that unseen words keep some probability.
    """
    r = np.arange(1, RELIABLE + 1)
    kept = sums[:, :RELIABLE] @ pairs.counted(r) + sums[:, RELIABLE]
    count = count.astype(float)
    total = np.where(count - kept > 1e-9 * np.maximum(count, 1), count, count + 1)
    alpha = (1 - kept / total) / np.maximum(1 - sums[:, RELIABLE + 1], 1e-300)
    return total, np.where(count > 0, alpha, 1.0)


def _score(pair_parts: int, hot: int, words: WordModel, pairs: Discounts, starts: int, hot_sums: dict[int, np.ndarray], vocabulary: int):
    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        out = {n: [] for n in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")}
        if block.num_rows:
            kind = answers["kind"].to_pylist()
            pick = lambda k: answers.filter(pa.array([x == k for x in kind]))
            b = Block(block.to_pylist()[0], _answers(pick("word"), "ii"), pair_parts, hot)
            counts = _answers(pick("answer"), "i")
            c = np.zeros(len(b.h), dtype=np.int64)
            c[b.order] = np.concatenate([counts[p][0] for p in sorted(counts)])
            own = _answers(pick("sums"), "i" * SUMS + "d")
            number = np.concatenate([x[0] for x in own.values()] + [np.array(list(hot_sums), dtype=np.int64)])
            table = np.concatenate([np.stack(x[1:], axis=1) for x in own.values()] + [np.array(list(hot_sums.values())).reshape(-1, SUMS)])
            order = np.argsort(number)
            number, table = number[order], table[order]
            h_number = b.number
            at = np.minimum(np.searchsorted(number, h_number), max(len(number) - 1, 0))
            known = number[at] == h_number if len(number) else np.zeros(len(h_number), bool)
            sums = np.where(known[:, None], table[at] if len(number) else 0.0, 0.0)
            seen = b.count.copy()
            seen[-1] = starts
            total, alpha = backoff(seen, sums, pairs)
            p_word = words.p(b.count)
            p = np.where(c > 0, pairs.counted(c) / total[b.h], alpha[b.h] * p_word[b.w])
            doc = np.repeat(np.arange(len(b.lengths)), b.lengths)
            n = len(b.lengths)
            base = np.log10((b.count + 0.1) / (words.tokens + 0.1 * (vocabulary + 1)))
            out["doc_id"] = [d["doc_id"] for d in b.docs]
            out["held_out"] = [d["doc_id"] is not None and not d["training"] for d in b.docs]
            out["n_tokens"] = b.lengths
            out["n_known"] = np.bincount(doc, weights=b.count[b.local] > 0, minlength=n).astype(np.int64)
            out["train_tokens"] = np.full(n, words.tokens)
            out["base_score"] = np.bincount(doc, weights=base[b.local], minlength=n)
            out["score"] = np.bincount(doc, weights=np.log10(p)[b.pair], minlength=n)
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), kinds, strict=True)})

    return run


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score): one row per input row.

    Documents whose crc32 of the id (as text) modulo 10 is not 0 are learned from; the others are held out. A row
    without an id is scored, but not learned from, and is not called held out. A null or empty text is its end token.
    ``base_score`` is the log10 of add-0.1 word probabilities, ``score`` of the backoff model's. Without any training
    document all words are unknown. Repeated rows count again, each is scored.
    """
    spark = docs.sparkSession
    src = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    parts = parts_for(spark, src.agg(F.sum(F.octet_length("text"))).first()[0] or 0, 24e6)
    read = stored(src.mapInArrow(_blocks(parts), BLOCK_SCHEMA), "blocks")
    blocks = read.where("docs is not null").select("block", "docs", "entries", "tokens", "places")
    asked = read.where("docs is null").select("block", "part", "n", "asked")
    words = stored(asked.groupBy("part").applyInArrow(_word_part(parts), ANSWER), "words")
    n = np.zeros(RELIABLE + 2 + 3, dtype=np.int64)
    for r in words.where("kind = 'stat'").select("data").toLocalIterator():
        n += unpack(r["data"], len(n), "i")[0]
    tokens, vocabulary, large = (int(x) for x in n[-3:])
    model = WordModel(n[:-3].astype(float), tokens, large)
    starts = int(blocks.select(F.explode("docs").alias("d")).where("d.training").count())

    hot = max(1000, tokens // (8 * parts))
    word_answers = words.where("kind = 'answer'").select(F.lit("word").alias("kind"), "block", "part", "n", "data")
    pairs_asked = blocks.groupBy("block").cogroup(word_answers.select("block", "part", "n", "data").groupBy("block")).applyInArrow(
        _ask_pairs(parts, hot), "block long, part int, n long, asked binary")
    pairs = stored(pairs_asked.groupBy("part").applyInArrow(_pair_part(model), ANSWER), "pairs")
    n = np.zeros(RELIABLE + 2, dtype=np.int64)
    for r in pairs.where("kind = 'stat'").select("data").toLocalIterator():
        n += unpack(r["data"], len(n), "i")[0]
    hot_sums: dict[int, np.ndarray] = {}
    for r in pairs.where("kind = 'hot'").select("n", "data").toLocalIterator():  # at most 8 parts + 1 histories in each
        cols = unpack(r["data"], r["n"], "i" + "d" * SUMS)
        for k, x in zip(cols[0].tolist(), np.stack(cols[1:], axis=1), strict=True):
            hot_sums[k] = hot_sums.get(k, 0) + x
    got = word_answers.union(pairs.where("kind in ('answer', 'sums')").select("kind", "block", "part", "n", "data"))
    return blocks.groupBy("block").cogroup(got.groupBy("block")).applyInArrow(
        _score(parts, hot, model, Discounts.of(n.astype(float)), starts, hot_sums, vocabulary), SCORES)
