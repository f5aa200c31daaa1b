"""Embedding near-duplicates by cross-polytope hashing.

A vector is turned by fast Hadamard rotations (signs and transform, three times); the axis it then lies closest to,
with its sign, is its hash. Three such hashes name a bucket; each of eight tables has its own rotations, and each vector
is put into the three buckets that fit it best, so that neighbours on either side of a border meet. At cosine 0.98 a
pair meets in some bucket with a probability above 0.9999 (simulated, 64 dimensions). Pairs that meet are verified in
double precision, in blocks of at most 2 x ``BLOCK`` vectors, and are counted in the first bucket that they share.

Equal vectors of a label are one class with a size, and only buckets that hold several classes carry vectors, so
single vectors cost a few numbers each. No list of pairs is made: blocks yield counts and forests of links.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import components, mix, signed, stored

TABLES = 8
HASHES = 3
PROBES = 3
ROUNDS = 3
BLOCK = 256


def hadamard(x: np.ndarray) -> np.ndarray:
    """The orthonormal Walsh-Hadamard transform of each row; the width is a power of two."""
    shape, h = x.shape, 1
    while h < shape[-1]:
        y = x.reshape(*shape[:-1], -1, 2, h)
        x = np.stack([y[..., 0, :] + y[..., 1, :], y[..., 0, :] - y[..., 1, :]], axis=-2).reshape(shape)
        h *= 2
    return x / np.sqrt(shape[-1])


@lru_cache(maxsize=8)
def _signs(width: int) -> np.ndarray:
    return np.random.default_rng(1729).choice(np.array([-1.0, 1.0]), (TABLES, HASHES, ROUNDS, width))


def buckets(x: np.ndarray) -> np.ndarray:
    """The bucket numbers of each row, ``PROBES`` for each table."""
    width = max(2, 1 << int(x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    near = min(PROBES, width)
    out = np.empty((len(x), TABLES, PROBES), dtype=np.uint64)
    for t in range(TABLES):
        loss, code = [], []
        for k in range(HASHES):
            y = x
            for s in _signs(width)[t, k]:
                y = hadamard(y * s)
            size = np.abs(y)
            at = np.argsort(-size, axis=1, kind="stable")[:, :near]
            top = np.take_along_axis(size, at, 1)
            loss.append(top[:, :1] - top)
            code.append((at * 2 + (np.take_along_axis(y, at, 1) < 0)).astype(np.uint64))
        ways = list(itertools.product(range(near), repeat=HASHES))
        total = np.stack([sum(loss[k][:, w[k]] for k in range(HASHES)) for w in ways], axis=1)
        best = np.argsort(total, axis=1, kind="stable")[:, :PROBES]
        name = np.full((len(x), len(ways)), t + 1, dtype=np.uint64)
        for k in range(HASHES):
            name = name * np.uint64(2 * width) + np.stack([code[k][:, w[k]] for w in ways], axis=1)
        out[:, t, :] = mix(np.take_along_axis(name, best, 1))
    return out.reshape(len(x), -1)


def _matrix(col: pa.Array, width: int) -> np.ndarray:
    return np.asarray(col.flatten(), dtype=float).reshape(-1, width)


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets of each class; the label and the width are part of a bucket's name."""
    for batch in batches:
        width = np.asarray(pc.list_value_length(batch["embedding"]))
        for w in np.unique(width):
            part = batch.filter(pa.array(width == w))
            for at in range(0, part.num_rows, 2048):
                rows = part.slice(at, 2048)
                x = _matrix(rows["embedding"], int(w))
                top = np.abs(x).max(axis=1, keepdims=True)
                x = x / top  # no overflow or underflow in what follows
                label = mix(rows["label"].to_numpy().astype(np.int64).view(np.uint64) * np.uint64(2654435761) + np.uint64(w))
                b = signed(mix(buckets(x / np.linalg.norm(x, axis=1, keepdims=True)) ^ label[:, None]))
                ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * b.shape[1])
                yield pa.RecordBatch.from_arrays([rows["rep"], pa.ListArray.from_arrays(ends, pa.array(b.reshape(-1)))], ["rep", "buckets"])


def _first_shared(a: np.ndarray, b: np.ndarray, bucket: int) -> np.ndarray:
    """Whether ``bucket`` is the first that each pair shares, in the order of tables and then of numbers."""
    a, b = a.reshape(len(a), TABLES, PROBES), b.reshape(len(b), TABLES, PROBES)
    same = a[:, :, :, None] == b[:, :, None, :]
    hit = same.any(axis=3)  # by pair, table and probe of a
    table = hit.any(axis=2).argmax(axis=1)
    row = np.arange(len(a))
    least = np.where(hit[row, table], a[row, table], np.iinfo(np.int64).max).min(axis=1)
    return least == bucket


def block_links(x: np.ndarray, part: np.ndarray, i: int, j: int, codes: np.ndarray, bucket: int, size: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Of the vectors of parts ``i`` and ``j`` of a bucket: links counted for each, and the root of each in a forest.

    Within one part all pairs are compared, between two parts those that stand in different ones.
    """
    x = x / np.abs(x).max(axis=1, keepdims=True)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= least
    np.fill_diagonal(linked, False)
    if i != j:
        linked &= part[:, None] != part[None, :]
    counted = np.zeros(len(x), dtype=np.int64)
    a, b = np.nonzero(np.triu(linked))
    for at in range(0, len(a), 20_000):
        p, q = a[at: at + 20_000], b[at: at + 20_000]
        first = _first_shared(codes[p], codes[q], bucket)
        np.add.at(counted, p[first], size[q[first]])
        np.add.at(counted, q[first], size[p[first]])
    root = np.arange(len(x))
    while True:
        new = np.minimum(root, np.where(linked, root[None, :], len(x)).min(axis=1))
        new = new[new]
        if (new == root).all():
            return counted, root
        root = new


def _verify(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["rep", "n", "a", "b"]

        def links(rows: pa.RecordBatch) -> pa.RecordBatch:
            width = rows["embedding"][0].values
            reps = rows["rep"].to_numpy()
            counted, root = block_links(
                _matrix(rows["embedding"], len(width)), rows["own"].to_numpy(), rows["i"][0].as_py(), rows["j"][0].as_py(),
                np.asarray(rows["buckets"].flatten()).reshape(len(reps), -1), rows["bucket"][0].as_py(), rows["size"].to_numpy(), least)
            some, joined = counted > 0, root != np.arange(len(root))
            k, m = int(some.sum()), int(joined.sum())
            return pa.RecordBatch.from_arrays(
                [pa.concat_arrays([pa.array(reps[some]), pa.nulls(m, pa.int64())]), pa.concat_arrays([pa.array(counted[some]), pa.nulls(m, pa.int64())]),
                 pa.concat_arrays([pa.nulls(k, pa.int64()), pa.array(reps[joined])]), pa.concat_arrays([pa.nulls(k, pa.int64()), pa.array(reps[root[joined]])])], names)

        left: pa.RecordBatch | None = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            if left is not None:
                batch = pa.Table.from_batches([left, batch]).combine_chunks().to_batches()[0]
            key = [batch[c].to_numpy() for c in ("bucket", "i", "j")]
            new = np.zeros(batch.num_rows, dtype=bool)
            for k in key:
                new[1:] |= k[1:] != k[:-1]
            cuts = np.concatenate(([0], np.flatnonzero(new)))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                yield links(batch.slice(int(a), int(b - a)))
            left = batch.slice(int(cuts[-1]))
        if left is not None:
            yield links(left)

    return run


def near_duplicates(vectors: DataFrame, least: float = 0.98, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per input row.

    Vectors of one label and one length link when their cosine is at least ``least``. A null, empty or zero vector,
    one with a null or non-finite component, and one without a label or an id link with nothing. Repeated rows are
    vectors of their own and link with each other; ``kept`` marks rows whose id is the least of their component.
    """
    src = vectors.select(vectors[vec_id].cast("long").alias("vec_id"), vectors[embedding].cast("array<double>").alias("embedding"), vectors[label].cast("long").alias("label"))
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.forall("embedding", finite) & F.exists("embedding", lambda v: v != 0)
    good = F.coalesce(good, F.lit(False))
    keyed = src.where(good).select("vec_id", "embedding", "label", F.xxhash64("label", "embedding").alias("h1"), F.xxhash64("embedding", F.lit(17), "label").alias("h2"))
    grouped = keyed.groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("size"), F.min(F.struct("vec_id", "label", "embedding")).alias("m"))
    # two classes may have one least id where an id repeats, so classes get a number of their own
    kinds = stored(grouped.select("h1", "h2", F.xxhash64("h1", "h2").alias("rep"), F.col("rep").alias("id"), "size", "m.label", "m.embedding"), "classes")

    codes = stored(kinds.select("rep", "label", "embedding").mapInArrow(_probe, "rep long, buckets array<long>"), "buckets")
    spots = codes.select("rep", F.explode("buckets").alias("bucket"))
    many = stored(spots.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("bucket", F.ceil(F.col("m") / BLOCK).cast("int").alias("parts")), "many")
    own = F.pmod(F.xxhash64("rep", "bucket"), F.col("parts")).cast("int")
    met = spots.join(many, "bucket").withColumn("own", own)
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = stored(met.select("rep", "bucket", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")), "met")
    full = met.join(codes, "rep").join(kinds.select("rep", "size", "embedding"), "rep")
    full = full.select("bucket", "i", "j", "own", "rep", "size", "buckets", "embedding").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    found = stored(full.mapInArrow(_verify(least), "rep long, n long, a long, b long"), "links")

    counts = found.where("rep is not null").groupBy("rep").agg(F.sum("n").alias("n"))
    root = components(found.where("a is not null").select("a", "b"))
    named = stored(kinds.select("h1", "h2", "rep", "id", "size").join(root.withColumnRenamed("id", "rep"), "rep", "left").join(counts, "rep", "left").select(
        "h1", "h2", "id", F.coalesce("root", "rep").alias("root"), (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("n_links")), "named")
    lowest = stored(named.groupBy("root").agg(F.min("id").alias("component_id")), "least")
    answer = stored(named.join(lowest, "root").select("h1", "h2", "n_links", "component_id"), "answer")
    h = [F.when(good, c) for c in (F.xxhash64("label", "embedding"), F.xxhash64("embedding", F.lit(17), "label"))]
    rows = stored(src.select("vec_id", h[0].alias("h1"), h[1].alias("h2")), "rows")
    component = F.coalesce("component_id", "vec_id")
    return rows.join(answer, ["h1", "h2"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
