"""N-gram Jaccard join: T-occurrence search over inverted lists (DivideSkip), for any number and size of copies.

A document is the set of its distinct 5-word shingles. Two documents link when 100 |x n y| >= 75 |x u y|, which
needs an overlap of T(x, y) = ceil(3 (|x| + |y|) / 7). All links between different sets are reflected in the result:

1. Documents with one set form a class; everything below works on classes.
2. Pivots: of classes that agree in a least hash the least is their pivot, and each class is compared with the pivot
   it agrees with most often. This joins most members of a group of near copies with a number of comparisons that
   grows with its members, not with their square.
3. Prefixes: two sets that link share one of the n - ceil(0.75 n) + 1 first shingles of each in any common order,
   and at the first they share both have T shingles left; here the seldom ones come first, by a sketch of counts. Shingles whose lists hold a single component are done. In
   the others first one member of each component is compared with the list's hub, the member with the fewest seldom
   shingles, in rounds while that joins any; at last each pair of classes that still lie in different components is,
   so no link is missed.
   Pairs whose shingles' parities by bucket show too large a difference fall out before their texts move.
4. Comparison: each query class searches the lists of its candidates for those that occur T times. The longest lists
   are set aside, the short ones merged with a heap that skips what cannot reach T, and who remains is looked up in
   the long ones by binary search.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import bounded_batches, components, forget, mix, parts_for, signed, slices, stored, words_of

WORDS = 5
PIVOT_SEEDS = tuple(np.uint64(x) for x in (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89))
#: The sketch counts shingles by their leading bits; its size does not depend on the data.
SKETCH_BITS = 18
SKETCH_BLOCKS = 64
#: Lists of shingles this often in the sketch do not go to one task.
HOT_FACTOR = 8
#: Buckets of document ids that let most texts be left behind before the exact join.
FILTER_BUCKETS = 1 << 20
#: Rounds in which each component of a list sends one member only, to the list's hub.
HUB_ROUNDS = 3
#: 64-bit numbers of a signature.
SIGN_LONGS = 8
#: Candidates of a query that one search takes.
CHUNK = 256
#: Text whose postings a task sends off together.
POST_BYTES = 4 << 20
#: Postings that one task indexes.
POSTINGS_PER_TASK = 1_500_000

LIST_COLUMNS = ["key", "cls", "n", "reach"]

_PLACE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64)


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each text, ascending, and each text's offsets."""
    words, offsets = words_of(texts)
    n = np.diff(offsets)
    full = np.maximum(n - WORDS + 1, 0)
    at = np.repeat(offsets[:-1] - np.cumsum(full) + full, full) + np.arange(full.sum())
    h = np.zeros(max(0, len(words) - WORDS + 1), dtype=np.uint64)
    for k in range(WORDS):
        h += words[k: k + len(h)] * _PLACE[k]
    h = mix(h[at] + np.uint64(WORDS))
    few = np.flatnonzero((n > 0) & (n < WORDS))
    if len(few):  # the whole sequence is one shingle
        one = np.array([np.sum(words[a: a + m] * _PLACE[:m], dtype=np.uint64) + np.uint64(m) for a, m in zip(offsets[few], n[few], strict=True)], dtype=np.uint64)
        h = np.insert(h, np.cumsum(full)[few], mix(one))
    count = full + ((n > 0) & (n < WORDS))
    ends = np.cumsum(count)
    for a, b in zip((ends - count).tolist(), ends.tolist(), strict=True):  # many small sorts are faster than a large one by two keys
        h[a:b].sort()
    doc = np.repeat(np.arange(len(n)), count)
    first = np.ones(len(h), dtype=bool)
    first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[first], np.concatenate(([0], np.cumsum(np.bincount(doc[first], minlength=len(n)))))


def _by_doc(ufunc: np.ufunc, values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """``ufunc`` over each text's values; texts without values get 0."""
    out = np.zeros(len(offsets) - 1, dtype=values.dtype)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        out[full] = ufunc.reduceat(values, offsets[full])
    return out


def classes(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set, alike for equal sets."""
    total = _by_doc(np.add, mix(h ^ np.uint64(0x452821E638D01377)), offsets)
    return signed(mix(total + np.diff(offsets).astype(np.uint64) * _PLACE[0]))


def parity(h: np.ndarray) -> bytes:
    """For each of 256 or more buckets (the power of two from the set's size on) whether it holds an odd number."""
    size = 1 << max(8, int(len(h) - 1).bit_length())
    return np.packbits((np.bincount((h & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).astype(np.uint8), bitorder="little").tobytes()


def signatures(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per set, for 64 * ``SIGN_LONGS`` buckets, whether each holds an odd number, as 64-bit numbers."""
    many, size = len(offsets) - 1, 64 * SIGN_LONGS
    doc = np.repeat(np.arange(many), np.diff(offsets))
    odd = np.bincount(doc * size + (h & np.uint64(size - 1)).astype(np.int64), minlength=many * size) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(many, SIGN_LONGS)


def may_link(a: bytes, b: bytes, n: int) -> bool:
    """Whether two sets of together ``n`` shingles can differ by n / 7 at most, which links do: each bucket of
    different parity holds a shingle that only one of them has. The larger of two tables is folded."""
    if len(a) < len(b):
        a, b = b, a
    x, y = int.from_bytes(a, "little"), int.from_bytes(b, "little")
    bits = 8 * len(a)
    while bits > 8 * len(b):
        bits //= 2
        x = x >> bits ^ x & (1 << bits) - 1
    return 7 * (x ^ y).bit_count() <= n


def _sieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = [may_link(*x) for x in zip(b["pq"].to_pylist(), b["pc"].to_pylist(), b["n"].to_pylist(), strict=True)]
        part = b.filter(pa.array(keep, pa.bool_()))
        yield pa.RecordBatch.from_arrays([part["q"], part["c"]], ["q", "c"])


def sieved(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs whose parities allow a link: nearly all others fall out before any text moves."""
    one = lambda name: reps.select(F.col("cls").alias(name), F.col("n").alias(f"n{name}"), F.col("parity").alias(f"p{name}"))
    both = pairs.join(one("c"), "c").join(one("q"), "q").select("q", "c", "pq", "pc", (F.col("nq") + F.col("nc")).alias("n"))
    return both.mapInArrow(_sieve, "q long, c long")


def _sketch_bin(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document; at the end of the task, rows with its part of the sketch."""
    names = ["doc_id", "n", "cls", "least", "sign", "parity", "block", "counts", "key"]
    sketch = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
    for part, raw in slices(batches, "text"):
        h, offsets = shingle_sets(raw)
        sketch += np.bincount(_sketch_bin(h), minlength=len(sketch))
        n = np.diff(offsets)
        least = np.stack([signed(_by_doc(np.minimum, mix(h ^ s), offsets)) for s in PIVOT_SEEDS], axis=1).reshape(-1)
        ends = pa.array(np.arange(len(n) + 1, dtype=np.int32) * len(PIVOT_SEEDS))
        longs = pa.array(np.arange(len(n) + 1, dtype=np.int32) * SIGN_LONGS)
        nothing = pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())
        yield pa.RecordBatch.from_arrays(
            [part["doc_id"], pa.array(n.astype(np.int64)), pa.array(classes(h, offsets), mask=n == 0), pa.ListArray.from_arrays(ends, pa.array(least)),
             pa.ListArray.from_arrays(longs, pa.array(signatures(h, offsets).reshape(-1))),
             pa.array([parity(h[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], pa.binary()), *nothing, part["key"]], names)
    blocks = [x.tobytes() for x in np.split(sketch, SKETCH_BLOCKS)]
    none = [pa.nulls(SKETCH_BLOCKS, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())]
    yield pa.RecordBatch.from_arrays([*none, pa.array(range(SKETCH_BLOCKS), pa.int32()), pa.array(blocks, pa.binary()), pa.nulls(SKETCH_BLOCKS, pa.int64())], names)


def _sum_sketch(rows: DataFrame) -> np.ndarray:
    """The sketch of all documents, in two steps so that no task gets every other task's."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, dtype=np.int64) for x in pdf["counts"])
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "counts": [total.tobytes()]})

    kind = "block int, counts binary"
    half = rows.select("block", "counts").groupBy("block", F.pmod(F.xxhash64("counts"), F.lit(32))).applyInPandas(add, kind)
    got = {r["block"]: r["counts"] for r in half.groupBy("block").applyInPandas(add, kind).collect()}
    empty = bytes(8 * (1 << SKETCH_BITS) // SKETCH_BLOCKS)
    return np.frombuffer(b"".join(got.get(k, empty) for k in range(SKETCH_BLOCKS)), dtype=np.int64)


def prefixes(h: np.ndarray, offsets: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first n - ceil(0.75 n) + 1 shingles of each text, seldom ones first; the text of each, and its place in the order."""
    n = np.diff(offsets)
    rank = (level[_sketch_bin(h)].astype(np.uint64) << np.uint64(58)) | (mix(h) >> np.uint64(6))
    size = np.where(n > 0, n - (3 * n + 3) // 4 + 1, 0)
    picked = [a + np.argsort(rank[a:b])[:k] for a, b, k in zip(offsets[:-1].tolist(), offsets[1:].tolist(), size.tolist(), strict=True) if k]
    at = np.concatenate(picked) if picked else np.empty(0, np.int64)
    return h[at], np.repeat(np.arange(len(n)), size), np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)


def needed_overlap(a: int, b: int) -> int:
    return -(-3 * (a + b) // 7)


def t_occurrences(lists: list[list[int]], need: int, weight: float = 0.01) -> dict[int, int]:
    """Ids that occur in at least ``need`` of the ascending lists, with their number of lists (DivideSkip)."""
    lists = sorted((x for x in lists if x), key=len)
    if len(lists) < need or need < 1:
        return {}
    longest = len(lists[-1])
    aside = min(need - 1, int(need / (weight * math.log2(longest) + 1))) if longest > 1 else 0
    short, long_ = lists[: len(lists) - aside], lists[len(lists) - aside:]
    least = need - aside
    heap = [(x[0], k) for k, x in enumerate(short)]
    heapq.heapify(heap)
    at = [0] * len(short)
    out = {}
    while len(heap) >= least:
        top = heap[0][0]
        popped = []
        while heap and heap[0][0] == top:
            popped.append(heapq.heappop(heap)[1])
        if len(popped) >= least:
            total = len(popped)
            for k, x in enumerate(long_):
                if total + len(long_) - k < need:
                    break
                i = bisect_left(x, top)
                total += i < len(x) and x[i] == top
            if total >= need:
                out[top] = total
            for k in popped:
                at[k] += 1
                if at[k] < len(short[k]):
                    heapq.heappush(heap, (short[k][at[k]], k))
        else:  # nothing below the new top can reach the number
            while heap and len(popped) < least - 1:
                popped.append(heapq.heappop(heap)[1])
            if not heap:
                break
            new = heap[0][0]
            for k in popped:
                at[k] = bisect_left(short[k], new, at[k])
                if at[k] < len(short[k]):
                    heapq.heappush(heap, (short[k][at[k]], k))
    return out


def search(query: np.ndarray, candidates: list[np.ndarray]) -> list[int]:
    """Candidates that link with the query: a T-occurrence search over lists of the query's shingles."""
    if not candidates:
        return []
    sizes = [len(c) for c in candidates]
    flat = np.concatenate(candidates)
    at = np.minimum(np.searchsorted(query, flat), len(query) - 1)
    hit = query[at] == flat
    who = np.repeat(np.arange(len(sizes)), sizes)[hit]
    order = np.lexsort((who, at[hit]))
    place, who = at[hit][order], who[order]
    cuts = np.flatnonzero(np.diff(place)) + 1
    lists = [x.tolist() for x in np.split(who, cuts)] if len(who) else []
    need = min(needed_overlap(len(query), s) for s in sizes)
    found = t_occurrences(lists, need)
    return sorted(k for k, n in found.items() if n >= needed_overlap(len(query), sizes[k]))


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links among rows (q, chunk, member, cls, text) in that order: a chunk's first row is its query."""
    now: tuple[int, int] | None = None
    query = np.empty(0, np.uint64)
    for batch in batches:
        out_a, out_b = [], []
        q, chunk, member = (batch[c].to_numpy(zero_copy_only=False) for c in ("q", "chunk", "member"))
        cls = batch["cls"].to_numpy()
        new = np.concatenate(([True], (q[1:] != q[:-1]) | (chunk[1:] != chunk[:-1]), [True]))
        cuts = np.flatnonzero(new)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            part = batch.slice(a, b - a)
            if now != (q[a], chunk[a]):
                now, query = (q[a], chunk[a]), np.empty(0, np.uint64)
            asks = int((~member[a:b]).sum())
            if asks:  # a repeated id may give the query twice
                query = shingle_sets([part["text"][0].as_py().encode()])[0]
            at = a + asks
            for rows, raw in slices(iter([part.slice(asks)]), "text"):
                h, offsets = shingle_sets(raw)
                sets = [h[i:j] for i, j in zip(offsets[:-1], offsets[1:], strict=True)]
                got = [at + k for k in search(query, sets)] if len(query) else []
                at += rows.num_rows
                out_a += [int(q[a])] * len(got)
                out_b += cls[got].tolist()
        yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])


def _runs(values: np.ndarray) -> list[slice]:
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(values)) + 1, [len(values)]))
    return [slice(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]


def links_of(pairs: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (q, c) of classes that link, as (a, b).

    Each text moves twice: to the join that picks it out, and to the queries it is a candidate of. A query with many
    candidates meets them in chunks of about ``CHUNK`` in different tasks.
    """
    chunks = pairs.groupBy("q").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    chunks = stored(chunks, "chunks")
    members = pairs.join(chunks, "q").select("q", F.pmod(F.xxhash64("c"), F.col("chunks")).cast("int").alias("chunk"), F.lit(True).alias("member"), F.col("c").alias("cls"))
    queries = chunks.select("q", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(False).alias("member"), F.col("q").alias("cls"))
    need = stored(members.union(queries).join(reps.select("cls", F.col("rep").alias("doc_id")), "cls"), "need")
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BUCKETS))
    wanted = need.select(bucket.alias("bucket")).distinct()  # at most FILTER_BUCKETS rows
    some = docs.withColumn("bucket", bucket).join(F.broadcast(wanted), "bucket", "left_semi").drop("bucket")

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw in slices(batches, "text"):
            yield part.filter(pa.array(classes(*shingle_sets(raw)) == part["cls"].to_numpy()))

    kind = "q long, chunk int, member boolean, cls long, text string"
    # an id may stand on rows of other texts: only the class's own text is taken
    rows = some.join(need, "doc_id").select("q", "chunk", "member", "cls", "text").mapInArrow(same, kind)
    rows = rows.repartition("q", "chunk").sortWithinPartitions("q", "chunk", "member")
    out = stored(rows.mapInArrow(_compare, "a long, b long"), "links")
    forget(need, chunks)
    return out


def shared_keys(docs: DataFrame, sketch: np.ndarray, postings: float) -> DataFrame:
    """(key, cls, n, reach): prefix shingles that stand in more than one class, with those classes.

    ``reach`` is how many of the class's shingles stand at this one or behind it, in the common order: at the first
    shingle two sets share, neither can share more.

    A task indexes the lists of its keys in memory; keys that the sketch counts very often never come together in one
    task, they are listed as they are.
    """
    spark = docs.sparkSession
    level = np.minimum(63, np.log2(np.maximum(sketch, 1)) * 2).astype(np.int64)
    hot = sketch > HOT_FACTOR * max(64.0, float(sketch.mean()))
    parts = parts_for(spark, postings, POSTINGS_PER_TASK)

    def packed(key: np.ndarray, doc: np.ndarray, place: np.ndarray, cls: np.ndarray, n: np.ndarray) -> bytes:
        """Keys by class: classes and sizes once, then how many keys each has, then the keys and their places."""
        who, count = np.unique(doc, return_counts=True)
        numbers = b"".join(x.astype(np.int64).tobytes() for x in (np.array([len(who)]), count, cls[who], n[who], signed(key)))
        return numbers + place.astype(np.int32).tobytes()

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> pa.RecordBatch:
            key, doc, place, cls, n = (np.concatenate([h[k] for h in held]) for k in range(5))
            held.clear()
            to = (mix(key) % np.uint64(parts)).astype(np.int64)
            is_hot = hot[_sketch_bin(key)]
            # a key met very often stays with its block of documents, and is only listed
            to[is_hot] = parts + int(mix(cls[:1].view(np.uint64))[0] % np.uint64(parts)) if len(cls) else 0
            order = np.argsort(to, kind="stable")
            cuts = np.searchsorted(to[order], np.arange(2 * parts + 1))
            full = [(k, order[a:b]) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
            return pa.RecordBatch.from_arrays(
                [pa.array([k % parts for k, _ in full], pa.int32()), pa.array([k >= parts for k, _ in full], pa.bool_()),
                 pa.array([packed(key[x], doc[x], place[x], cls, n) for _, x in full], pa.binary())], ["part", "hot", "packed"])

        size = docs_held = 0
        for _, raw in slices(batches, "text"):
            h, offsets = shingle_sets(raw)
            key, doc, place = prefixes(h, offsets, level)
            held.append((key, doc + docs_held, place, classes(h, offsets), np.diff(offsets)))
            docs_held += len(raw)
            size += sum(map(len, raw))
            if size > POST_BYTES:
                yield flush()
                size = docs_held = 0
        if held:
            yield flush()

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def rows(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(columns[0]), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[at: at + 100_000]) for x in columns], LIST_COLUMNS)

        for b in batches:
            for is_hot, x in zip(b["hot"].to_pylist(), b["packed"].to_pylist(), strict=True):
                m = int(np.frombuffer(x, dtype=np.int64, count=1)[0])
                count = np.frombuffer(x, dtype=np.int64, count=m, offset=8)
                total = int(count.sum())
                of_class = np.frombuffer(x, dtype=np.int64, count=2 * m, offset=8 * (1 + m))
                key = np.frombuffer(x, dtype=np.int64, count=total, offset=8 * (1 + 3 * m))
                place = np.frombuffer(x, dtype=np.int32, offset=8 * (1 + 3 * m + total))
                cls, n = (np.repeat(v, count) for v in (of_class[:m], of_class[m:]))
                columns = [key, cls, n, n - place]
                if is_hot:
                    yield from rows(columns)
                else:
                    held.append(columns)
        if held:
            columns = [np.concatenate(x) for x in zip(*held, strict=True)]
            order = np.lexsort((columns[1], columns[0]))
            key, cls = columns[0][order], columns[1][order]
            new_key = np.concatenate(([True], key[1:] != key[:-1]))
            new = new_key | np.concatenate(([True], cls[1:] != cls[:-1]))
            many = (np.bincount((np.cumsum(new_key) - 1)[new]) > 1)[np.cumsum(new_key) - 1] & new
            yield from rows([x[order[many]] for x in columns])

    posted = docs.select("text").mapInArrow(post, "part int, hot boolean, packed binary").repartition(parts, "part")
    return stored(posted.select("hot", "packed").mapInArrow(index, ", ".join(f"{c} long" for c in LIST_COLUMNS)), "lists")


def _mixed(lists: DataFrame, root: DataFrame) -> DataFrame:
    """(key, cls, n, root) of the keys whose lists hold more than one component."""
    named = stored(lists.select(*LIST_COLUMNS).join(root.withColumnRenamed("id", "cls"), "cls", "left").select(*LIST_COLUMNS, F.coalesce("root", "cls").alias("root")), "named")
    mixed = stored(named.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key"), "mixed")
    out = stored(named.join(mixed, "key", "left_semi"), "mixed-lists")
    forget(named, mixed)
    return out


def _paired(left: DataFrame, right: DataFrame, order: str, more: str = "") -> DataFrame:
    """The pairs (q, c) of one list, of different components (``order`` compares their roots), whose sizes and places can link.

    Two sets that link do so at the first shingle they share too, where what stands behind it in either has to hold
    the overlap; so a passage that many texts hold as their most frequent part pairs none of them.
    """
    fits = F.expr(f"l.key = r.key and l.root {order} r.root and 4 * least(l.n, r.n) >= 3 * greatest(l.n, r.n)"
                  f" and 7 * least(l.reach, r.reach) >= 3 * (l.n + r.n){more}")
    return left.alias("l").join(right.alias("r"), fits).select(F.col("l.cls").alias("q"), F.col("r.cls").alias("c")).distinct()


def _to_hubs(mixed: DataFrame, turn: int) -> DataFrame:
    """The pairs (q, c) of one member of each component of a list and the list's hub: no more than rows of lists.

    Seldom shingles come first, so who has fewest of them ahead of the list's own has fewest that the others lack: it
    stands nearest to the middle of a group of near copies and links with what any member links with, mostly. It is
    the first turn's hub; later turns take others, in the same order of hashes in all lists.
    """
    h = F.xxhash64("cls", F.lit(turn)) if turn else F.col("n") - F.col("reach")
    members = mixed.groupBy("key", "root").agg(F.min(F.struct(h.alias("h"), *LIST_COLUMNS[1:])).alias("m")).select("key", "root", "m.*")
    # of the lists as they are stored, by key, so that most is combined before it moves
    hubs = mixed.groupBy("key").agg(F.min(F.struct(h.alias("h"), *LIST_COLUMNS[1:], "root")).alias("m")).select("key", "m.*")
    return _paired(hubs, members, "<>")


def _across(lists: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs (q, c) of one list, of different components, whose sizes, places and signatures can link.

    Every bucket of different parity holds a shingle of only one set, and links differ by a seventh at most.
    """
    signed_lists = lists.join(reps.select("cls", "sign"), "cls")
    odd = " + ".join(f"bit_count(l.sign[{k}] ^ r.sign[{k}])" for k in range(SIGN_LONGS))
    return _paired(signed_lists, signed_lists, "<", f" and 7 * ({odd}) <= l.n + r.n")


def text_key(text: str) -> Column:
    """What tells rows of one id apart."""
    return F.xxhash64(F.col(text), F.octet_length(text))


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", members: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id): one row per input row.

    ``component_id`` is the least id reachable by links, itself included. A null, empty or blank text has no shingles
    and links with nothing; texts of fewer than five words are one shingle. A row with a null id links with nothing
    and has a null component. Equal sets link (repeated rows too). ``members`` adds ``root``, which names the row's own
    component (null where it can link with nothing), and ``key``, the ``text_key`` of its text.
    """
    bounded_batches(docs.sparkSession)
    src = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")).withColumn("key", text_key("text"))
    rows = stored(src.mapInArrow(_summaries, "doc_id long, n long, cls long, least array<long>, sign array<long>, parity binary, block int, counts binary, key long"), "summaries")
    known = rows.where("block is null").select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("cls")).alias("cls"), "least", "sign", "parity", "key")
    sketch = _sum_sketch(rows.where("block is not null"))
    reps = stored(known.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("least").alias("least"), F.first("sign").alias("sign"), F.first("parity").alias("parity")), "classes")

    spots = reps.select("cls", F.posexplode("least").alias("k", "value"))
    pivot = stored(spots.groupBy("k", "value").agg(F.min("cls").alias("q"), F.max("cls").alias("most")).where("q <> most").drop("most"), "pivots")
    votes = spots.join(pivot, ["k", "value"]).where("cls <> q").groupBy("cls", "q").agg(F.count(F.lit(1)).alias("votes"))
    best = votes.groupBy("cls").agg(F.max(F.struct("votes", F.bitwise_not("q").alias("q"))).alias("m"))
    near = stored(sieved(best.select(F.bitwise_not(F.col("m.q")).alias("q"), F.col("cls").alias("c")), reps), "near")
    links = links_of(near, reps, src)
    first = components(links)

    total = reps.agg(F.sum("n")).first()[0] or 0
    lists = shared_keys(src, sketch, total / 4)
    root, found = first, [links]
    for turn in range(HUB_ROUNDS):
        # components only grow: a list of one component stays one, the next round reads the mixed ones alone
        mixed = _mixed(lists, root)
        forget(lists)
        lists = mixed
        pairs = stored(sieved(_to_hubs(mixed, turn), reps), "pairs")
        more = links_of(pairs, reps, src)
        forget(pairs)
        if more.isEmpty():
            break
        found.append(more)
        root = components(reduce(DataFrame.union, found))
    mixed = _mixed(lists, root)
    rest = stored(sieved(_across(mixed, reps), reps), "rest")
    forget(lists, mixed)
    if not rest.isEmpty():
        found.append(links_of(rest, reps, src))
        root = components(reduce(DataFrame.union, found))
    of_class = stored(reps.select("cls", "rep").join(root.withColumnRenamed("id", "cls"), "cls", "left").select("cls", "rep", F.coalesce("root", "cls").alias("root")), "roots")
    least = stored(of_class.groupBy("root").agg(F.min("rep").alias("component_id")), "least")
    answer = stored(of_class.join(least, "root").select("cls", "component_id", "root"), "answer")
    thin = known.select("doc_id", "n", "cls", "key").join(answer, "cls", "left")
    return thin.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), *(["root", "key"] if members else []))
