"""Ranked lexical search: the best documents for each of many queries, by Block-Max MaxScore over shards.

One pass counts documents, terms and the document frequencies of the queries' terms. A second pass makes shards: a run
of texts becomes an inverted index in blocks of postings (gaps and counts in narrow numbers) with the greatest score of
every block. A query splits its lists by their greatest scores: those whose sum stays below the score of its k-th
document so far are not essential. Essential lists are read whole; on the others a candidate is first bounded by the
maxima of the blocks it would lie in, and only blocks that hold a candidate still in reach are decompressed, the list
of greatest bound first. What a shard finds goes into the task's heaps, whose k-th scores are the next shard's bounds;
the heaps of all tasks are merged in two steps, so that no step sorts more than k rows a task of its share.

Everything is integer arithmetic but the logarithm of a term's weight. Queries are held in blocks of ``block_bytes``
of text, each of which is one more pass over the documents; the documents are never collected or capped.

Terms are maximal matches of ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased. Null and empty texts
have none and are never found. Every row of either table stands for itself: equal documents are all ranked, equal
queries all answered. Equal scores are in order of doc_id, null last. Without documents or queries the result is empty.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.common import slices

BLOCK = 64
SHARD_BYTES = 8 << 20
QUERY_BYTES = 2 << 20
_PIECE = 1 << 20
#: ASCII letters and digits and all bytes from 0x80 on belong to terms.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms_of(data: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in runs of bounded length."""
    at = 0
    while at < len(data):
        end = min(len(data), at + _PIECE)
        piece = data[at:end].translate(_TABLE)
        while end < len(data) and piece[-1] != 32:  # a piece ends behind a term
            more = data[end:end + _PIECE].translate(_TABLE)
            gap = more.find(32)
            piece += more[:gap + 1] if gap >= 0 else more
            end += gap + 1 if gap >= 0 else len(more)
        yield piece.split()
        at = end


def _query_blocks(queries: DataFrame, block_bytes: int) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """(item_id, distinct terms) of the queries, in lists of about ``block_bytes`` of text."""
    block, held = [], 0
    for row in queries.toLocalIterator():
        terms = dict.fromkeys(t for part in terms_of((row[1] or "").encode()) for t in part)
        if terms:
            block.append((row[0], list(terms)))
            held += len(row[1])
        if held >= block_bytes:
            yield block
            block, held = [], 0
    if block:
        yield block


def _counted(number: dict[bytes, int], texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms a text), and (term, text, occurrences) of the numbered terms by term, then text."""
    length = np.zeros(len(texts), np.int64)
    keys = []
    for i, data in enumerate(texts):
        for terms in terms_of(data):
            length[i] += len(terms)
            met = np.fromiter((number.get(t, -1) for t in terms), np.int64, len(terms))
            keys.append(met[met >= 0] * len(texts) + i)
    key, tf = np.unique(np.concatenate(keys) if keys else np.empty(0, np.int64), return_counts=True)
    return length, key // max(1, len(texts)), key % max(1, len(texts)), tf


def _statistics(docs: DataFrame, number: dict[bytes, int]) -> tuple[int, int, np.ndarray]:
    """Documents with a term, terms of all documents, documents of each numbered term."""
    many = len(number)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(many + 2, np.int64)
        for _, texts in slices(batches, "text"):
            length, term, _, _ = _counted(number, texts)
            total[:many] += np.bincount(term, minlength=many)
            total[many:] += (np.count_nonzero(length), int(length.sum()))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"term": pa.array(at, pa.int64()), "n": pa.array(total[at], pa.int64())})

    sums = docs.select("text").mapInArrow(work, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    out = np.zeros(many + 2, np.int64)
    for row in sums.collect():  # one row a query term
        out[row["term"]] = row["n"]
    return int(out[many]), int(out[many + 1]), out[:many]


class Shard:
    """An inverted index of a run of documents, in compressed blocks with their greatest scores."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, tf: np.ndarray, norm: np.ndarray, weight: np.ndarray):
        self.norm, self.weight = norm, weight
        many = len(weight)
        count = np.bincount(term, minlength=many)
        self.first = np.concatenate(([0], np.cumsum(-(-count // BLOCK))))  # first block of every term
        place = np.arange(len(term)) - np.repeat(np.cumsum(count) - count, count)
        opens = np.flatnonzero(place % BLOCK == 0)
        self.start = np.append(opens, len(term))
        self.base = doc[opens]
        gap = np.diff(doc, prepend=0)
        gap[opens] = 0
        self.gap = gap.astype(np.min_scalar_type(int(gap.max(initial=0))))
        self.tf = tf.astype(np.min_scalar_type(int(tf.max(initial=0))))
        ends = self.start[1:] - 1
        self.last = doc[ends] + np.repeat(np.arange(many), np.diff(self.first)) * len(norm)  # by (term, document)
        score = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * norm[doc]))
        self.top = np.maximum.reduceat(score, opens) if len(opens) else np.empty(0, np.int64)
        self.bound = np.zeros(many, np.int64)
        np.maximum.at(self.bound, np.repeat(np.arange(many), np.diff(self.first)), self.top)
        self.decompressed = 0

    def read(self, blocks: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document, score) of the postings in ``blocks``; ``weight`` is that of each block's term."""
        self.decompressed += len(blocks)
        size = self.start[blocks + 1] - self.start[blocks]
        begin = np.cumsum(size) - size
        at = np.repeat(self.start[blocks] - begin, size) + np.arange(int(size.sum()))
        run = np.cumsum(self.gap[at].astype(np.int64))
        doc = run + np.repeat(self.base[blocks] - run[begin], size)
        tf = self.tf[at].astype(np.int64)
        return doc, np.repeat(weight, size) * ((1_000_000_000 * tf) // (1000 * tf + 20 * self.norm[doc]))

    def search(self, terms: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(document, score) of all documents that can be among the k best, where scores below ``least`` cannot."""
        terms = terms[self.bound[terms] > 0]
        terms = terms[np.argsort(self.bound[terms], kind="stable")]
        essential = int(np.searchsorted(np.cumsum(self.bound[terms]), least))
        whole, rest = terms[essential:], terms[:essential][::-1]
        if not len(whole):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        many = np.diff(self.first)[whole]
        blocks = np.concatenate([np.arange(self.first[t], self.first[t + 1]) for t in whole])
        doc, score = self.read(blocks, np.repeat(self.weight[whole], many))
        total = np.bincount(doc, weights=score, minlength=len(self.norm)).astype(np.int64)  # exact below 2^53
        doc = np.flatnonzero(total)
        have = total[doc]
        # per list the block each candidate would lie in, and what it could bring
        where, brings = [], []
        for t in rest:
            b = np.searchsorted(self.last[self.first[t]:self.first[t + 1]], doc + t * len(self.norm)) + self.first[t]
            inside = b < self.first[t + 1]
            b = np.where(inside, b, self.first[t])
            inside &= self.base[b] <= doc
            where.append(np.where(inside, b, -1))
            brings.append(np.where(inside, self.top[b], 0))
        reach = have + sum(brings) if brings else have
        found, scores = [], []
        best = np.argsort(-reach, kind="stable")
        for part in (best[:k], best[k:]):  # the likeliest first: their scores bound the others
            part = part[reach[part] >= least]
            now, left = have[part].copy(), reach[part].copy()
            for t, w, b in zip(rest, where, brings, strict=True):
                at, bring = w[part], b[part]
                need = np.unique(at[at >= 0])
                left -= bring
                if len(need):
                    d, s = self.read(need, np.full(len(need), self.weight[t]))
                    slot = np.minimum(np.searchsorted(d, doc[part]), len(d) - 1)
                    add = np.where(d[slot] == doc[part], s[slot], 0)
                    now += add
                    left += add
                keep = left >= least
                part, now, left = part[keep], now[keep], left[keep]
            found.append(doc[part])
            scores.append(now)
            if len(now) >= k:
                least = max(least, int(np.partition(now, len(now) - k)[len(now) - k]))
        return np.concatenate(found), np.concatenate(scores)


def _best(score: np.ndarray, doc: np.ndarray, null: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((doc, null, -score))[:k]


def search(docs: DataFrame, queries: DataFrame, k: int = 50, block_bytes: int = QUERY_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The ``k`` best documents of every query: (item_id, rank from 1, doc_id, score), scores above 0 only.

    With N documents that have terms, L terms in all, n in the document, df documents of a term and tf occurrences,
    the weight w of a term is floor(1000 ln((2N+2) / (2df+1))), a document's m is 50 + (50 n N) div L, and its score
    sums w ((10^9 tf) div (1000 tf + 20 m)) over the query's distinct terms.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    queries = queries.select(F.col("item_id"), F.col("text").cast("string").alias("text"))
    id_type = queries.schema["item_id"].dataType
    out = None
    for block in _query_blocks(queries, block_bytes):
        part = _search_block(docs, block, k, shard_bytes)
        if part is not None:
            names = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(block)], f"query int, item_id {id_type.simpleString()}")
            part = part.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")
            out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], f"item_id {id_type.simpleString()}, rank int, doc_id long, score long")
    return out


def _search_block(docs: DataFrame, block: list[tuple[int | None, list[bytes]]], k: int, shard_bytes: int) -> DataFrame | None:
    number: dict[bytes, int] = {}
    wanted = [np.array([number.setdefault(t, len(number)) for t in terms]) for _, terms in block]
    n_docs, n_terms, df = _statistics(docs, number)
    if not n_docs:
        return None
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool))] * len(wanted)
        for part, texts in slices(batches, "text", shard_bytes):
            ids = part.column(0)
            null = np.asarray(ids.is_null().to_numpy(zero_copy_only=False))
            ids = np.asarray(ids.fill_null(0))
            length, term, doc, tf = _counted(number, texts)
            shard = Shard(term, doc, tf, 50 + (50 * length * n_docs) // n_terms, weight)
            for q, terms in enumerate(wanted):
                score, name, empty = heaps[q]
                least = int(score[-1]) if len(score) >= k else 1
                found, value = shard.search(terms, k, least)
                if len(found):
                    score, name, empty = (np.concatenate(x) for x in ((score, value), (name, ids[found]), (empty, null[found])))
                    best = _best(score, name, empty, k)
                    heaps[q] = score[best], name[best], empty[best]
        for q, (score, name, empty) in enumerate(heaps):
            if len(score):
                yield pa.RecordBatch.from_pydict({
                    "query": pa.array(np.full(len(score), q), pa.int32()), "doc_id": pa.array(name, pa.int64(), mask=empty), "score": pa.array(score, pa.int64()),
                })

    heaps = docs.mapInArrow(work, "query int, doc_id long, score long").withColumn("_share", F.pmod(F.spark_partition_id(), F.lit(64)))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    shares = heaps.withColumn("rank", F.row_number().over(Window.partitionBy("query", "_share").orderBy(*order))).where(F.col("rank") <= k).drop("rank")
    merged = shares.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order)))
    return merged.where(F.col("rank") <= k).select("query", "rank", "doc_id", "score")


SQL = r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ts FROM documents),
 q AS (SELECT DISTINCT i, item_id, t FROM (SELECT row_number() OVER () AS i, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS t FROM benchmark)),
 s AS (SELECT count(*) FILTER (WHERE len(ts) > 0) AS n_docs, CAST(sum(len(ts)) AS BIGINT) AS n_terms FROM d),
 p AS (SELECT r, doc_id, n, t, count(*) AS tf FROM (SELECT r, doc_id, len(ts) AS n, unnest(ts) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY r, doc_id, n, t),
 w AS (SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY t, n_docs),
 c AS (SELECT i, item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // n_terms)))) AS BIGINT) AS score
   FROM q JOIN p USING (t) JOIN w USING (t), s GROUP BY i, item_id, r, doc_id)
SELECT item_id, CAST(k AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS k FROM c WHERE score > 0) WHERE k <= 50"""
