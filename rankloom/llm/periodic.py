"""Runs of repeated words: maximal stretches in which the words recur with a period, three times or more.

Internal pattern matching over the suffix array of a slice of texts. Prefix doubling sorts the suffixes and leaves,
for every power of two, the class of the words that follow each place; a class is an interval of the suffix array.
For every dyadic block a wavelet tree over the suffix array gives the block's next occurrences in the neighbouring
window (range successor). In a window shorter than two blocks three or more occurrences are an arithmetic progression;
such a progression lies in one stretch of its difference, and a longer period must carry one end of the block's
stretch to an end of theirs, so it gives two candidate periods. One or two occurrences are candidates themselves.
Candidates are extended both ways by comparing classes.

Why no run is missed: a run has three periods q at least, so for 2^k <= q < 2^(k+1) it holds the first aligned block of
2^k words behind its start and that block's copy q further on; periods below the smallest block are covered by that
block, since a run has three times its length at least.

Every row is worked on by itself: nothing is shuffled. Null and empty texts have no words and no runs; equal rows give
equal results; other columns pass through and may have any names. A slice holds about ``SLICE_BYTES`` of text, one text
at least, and needs about 8 bytes a word for every doubling up to its longest repeated stretch.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import slices

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def suffix_classes(words: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array of ``words``, and per doubling k the class of the 2^k words from every place on.

    A class is named by the first slot of its interval of the suffix array. A word that occurs once has to end
    ``words``, so that no stretch that occurs twice reaches the end. The last doubling has classes of one place only.
    """
    n = len(words)
    slots = np.arange(n)
    order = np.argsort(words, kind="stable")
    ranked = words[order]
    rank = np.empty(n, np.int32)
    classes: list[np.ndarray] = []
    active = slots
    step = 0
    while True:
        fresh = np.concatenate(([True], ranked[1:] != ranked[:-1]))
        first = np.maximum.accumulate(np.where(fresh, np.arange(len(active)), 0))
        rank = rank.copy()
        rank[order[active]] = active[first]
        classes.append(rank)
        alone = fresh & np.append(fresh[1:], True)
        active = active[~alone]
        if not len(active):
            return order, classes
        step = 2 * step or 1
        places = order[active]
        pair = rank[places].astype(np.int64) * n + rank[places + step]
        by = np.argsort(pair, kind="stable")
        order[active] = places[by]
        ranked = pair[by]


class WaveletTree:
    """Wavelet tree, level by level, of an array of distinct numbers below ``n``."""

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        self.levels: list[tuple[int, np.ndarray, int]] = []
        for bit in reversed(range(max(1, int(self.n - 1).bit_length()))):
            one = (values >> bit) & 1 == 1
            zeros = np.concatenate(([0], np.cumsum(~one))).astype(np.int32)
            self.levels.append((bit, zeros, int(zeros[-1])))
            values = np.concatenate((values[~one], values[one]))

    def successor(self, lo: np.ndarray, hi: np.ndarray, at_least: np.ndarray) -> np.ndarray:
        """Per query the least value >= ``at_least`` in the slots [lo, hi); ``n`` where there is none."""
        left, right = lo.copy(), hi.copy()
        smaller = np.zeros(len(lo), np.int64)
        for bit, zeros, total in self.levels:
            a, b = zeros[left], zeros[right]
            up = (at_least >> bit) & 1 == 1
            smaller += np.where(up, b - a, 0)
            left, right = np.where(up, total + left - a, a), np.where(up, total + right - b, b)
        smaller[at_least >= self.n] = self.n
        out = np.full(len(lo), self.n, np.int64)
        found = np.flatnonzero(smaller < hi - lo)
        left, right, rest = lo[found], hi[found], smaller[found]
        value = np.zeros(len(found), np.int64)
        for bit, zeros, total in self.levels:
            a, b = zeros[left], zeros[right]
            up = rest >= b - a
            rest = np.where(up, rest - (b - a), rest)
            value += np.where(up, 1 << bit, 0)
            left, right = np.where(up, total + left - a, a), np.where(up, total + right - b, b)
        out[found] = value
        return out


def _ahead(classes: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words agree from i and from j on (i and j differ)."""
    i, j = i.copy(), j.copy()
    start = i.copy()
    for k in reversed(range(len(classes))):
        step = (classes[k][i] == classes[k][j]).astype(np.int64) << k
        i += step
        j += step
    return i - start


def _behind(classes: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words agree before i and before j (i < j)."""
    i, j = i.copy(), j.copy()
    start = i.copy()
    for k in reversed(range(len(classes))):
        size = 1 << k
        inside = i >= size
        back = np.where(inside, size, 0)
        step = np.where(inside & (classes[k][i - back] == classes[k][j - back]), size, 0)
        i -= step
        j -= step
    return start - i


def find_runs(words: np.ndarray, min_length: int = 24, min_periods: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, least period) of every run of ``words``, by start, then period.

    ``words`` are numbers; every text ends with one that occurs nowhere else, which no run can hold.
    """
    if min_periods < 3 or min_length < 3:
        raise ValueError("runs have three periods and three words at least")
    n = len(words)
    none = np.empty(0, np.int64)
    if not n:
        return none, none, none
    order, classes = suffix_classes(words)
    tree = WaveletTree(order.astype(np.int64))
    smallest = (min_length // 3).bit_length() - 1
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for k in range(smallest, len(classes) - 1):
        size = 1 << k
        block = np.arange(0, n, size)
        members = np.bincount(classes[k], minlength=n)
        lo = classes[k][block].astype(np.int64)
        many = members[lo] > 1
        block, lo = block[many], lo[many]
        hi = lo + members[lo]
        for near, far in (((1, size + 1), (size + 1, 2 * size)) if k == smallest else ((size, 2 * size),)):
            end = np.minimum(block + far, n)
            one = tree.successor(lo, hi, block + near)
            met = one < end
            b, low, high, stop, one = (x[met] for x in (block, lo, hi, end, one))
            two = tree.successor(low, high, one + 1)
            found.append((b, one - b))
            met = two < stop
            b, low, high, stop, one, two = (x[met] for x in (b, low, high, stop, one, two))
            found.append((b, two - b))
            met = tree.successor(low, high, two + 1) < stop
            b, one, two = b[met], one[met], two[met]
            gap = two - one
            for shift in (
                _ahead(classes, one, two) + one - b - _ahead(classes, b, b + gap),
                one - _behind(classes, one, two) - b + _behind(classes, b, b + gap),
            ):
                keep = (shift > 0) & (b + shift < n)
                found.append((b[keep], shift[keep]))
    if not found:
        return none, none, none
    at, period = (np.concatenate(x) for x in zip(*found, strict=True))
    start = at - _behind(classes, at, at + period)
    end = at + period + _ahead(classes, at, at + period)
    long = end - start >= np.maximum(min_length, min_periods * period)
    start, end, period = start[long], end[long], period[long]
    # of one stretch the least period is the run's; the others are multiples of it
    by = np.lexsort((period, end, start))
    start, end, period = start[by], end[by], period[by]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[first], end[first], period[first]
    by = np.lexsort((period, start))
    return start[by], (end - start)[by], period[by]


def collapse_runs(docs: DataFrame, text: str = "text", min_length: int = 24, min_periods: int = 3) -> DataFrame:
    """``docs`` with ``runs`` (by start, then period) and ``collapsed``, the text without what runs repeat.

    Words are ``[^\\x20\\x09-\\x0D]+``; a word goes if a run holds it behind the run's first period, kept words are
    joined by one space. Columns named ``runs`` or ``collapsed`` are replaced.
    """
    others = [c for c in docs.columns if c not in ("runs", "collapsed")]
    src = docs.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{text}`").cast("string").alias("_text"))
    src = src.toDF(*[f"_c{i}" for i in range(len(others))], "_text")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in src.schema.fields[:-1])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "_text"):
            split = [t.split() for t in texts]  # bytes are split at just these six characters
            base = np.concatenate(([0], np.cumsum([len(w) + 1 for w in split])))
            numbers: dict[bytes, int] = {}
            ids = np.empty(base[-1], np.int64)
            for i, ws in enumerate(split):
                ids[base[i]:base[i + 1] - 1] = [numbers.setdefault(w, len(numbers)) for w in ws]
            # words of different texts never agree
            ids += np.repeat(np.arange(len(split)) * (len(numbers) + 1), np.diff(base))
            ids[base[1:] - 1] = np.arange(1, len(split) + 1) * (len(numbers) + 1) - 1
            start, length, period = find_runs(ids, min_length, min_periods)
            edge = np.zeros(len(ids) + 1, np.int64)
            np.add.at(edge, start + period, 1)
            np.add.at(edge, start + length, -1)
            kept = np.cumsum(edge[:-1]) == 0
            cuts = np.searchsorted(start, base)
            collapsed = [
                b" ".join(ws if cuts[i] == cuts[i + 1] else compress(ws, kept[base[i]:base[i + 1] - 1].tolist()))
                for i, ws in enumerate(split)
            ]
            own = start - base[np.searchsorted(base, start, side="right") - 1]
            runs = pa.ListArray.from_arrays(
                pa.array(cuts, pa.int32()),
                pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (own, length, period)], ["start", "length", "period"]),
            )
            keep = part.select(part.schema.names[:-1])
            yield pa.RecordBatch.from_arrays(
                [*keep.columns, runs, pa.array(collapsed, pa.binary()).cast(pa.string())],
                names=[*keep.schema.names, "runs", "collapsed"],
            )

    out = src.mapInArrow(work, ", ".join(x for x in (schema, f"runs {RUNS}", "collapsed string") if x))
    return out.toDF(*others, "runs", "collapsed")


def digests(out: DataFrame) -> list[Column]:
    """Columns that describe ``runs`` and ``collapsed``: number, the run of most periods, digests of both."""
    best = F.expr(
        "reduce(runs, cast(null as struct<start:bigint,length:bigint,period:bigint>),"
        " (a, r) -> if(a is null or r.length * a.period > a.length * r.period, r, a))"
    )
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    return [
        F.size("runs").cast("long").alias("n_runs"),
        *[best.getField(c).alias(c) for c in ("start", "length", "period")],
        F.floor(1000 * best.getField("length") / best.getField("period")).cast("long").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    ]


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of ``documents`` where every tenth document, by the checksum of its id, ends in a repetition.

    With h the checksum, g = floor(h / 10) and n words: from word a = g % n on the text repeats the
    p = 1 + floor((n - a) / (3 + g % 8)) words at a. Words are then joined by one space. A null id plants nothing.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = "filter(split(text, '[\\\\x20\\\\x09-\\\\x0D]+'), w -> w <> '')"
    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), h.alias("_h"))
    chosen = F.coalesce(F.col("_h") % 10 == 0, F.lit(False))
    w = rows.where(chosen).select("doc_id", "text", F.expr("_h div 10").alias("_g"), F.expr(words).alias("_w"))
    w = w.withColumn("_n", F.size("_w")).withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")))
    w = w.withColumn("_p", F.expr("1 + (_n - _a) div (3 + _g % 8)"))
    new = F.expr("array_join(transform(_w, (x, i) -> if(i < _a, x, _w[int(_a + (i - _a) % _p)])), ' ')")
    w = w.select("doc_id", F.when(F.col("_n") > 0, new).otherwise(F.col("text")).alias("text"))
    return rows.where(~chosen).select("doc_id", "text").unionByName(w)
