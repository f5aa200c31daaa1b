"""Shared pieces of the operators: written tables, text slices, hashed words, connected components.

A document id may be repeated (each row is then judged on its own) and any column may be null.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Rows go to Python in batches of about ``size`` bytes, however long their texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for intermediate data; a local one only where a local session names none."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = f"file://{tempfile.mkdtemp(prefix='rankloom-llm-')}"
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts lineage and gives the optimiser true sizes."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes stored tables that no later read needs."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._stored_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def parts_for(spark: SparkSession, amount: float, per_part: float) -> int:
    """Partitions so that each holds about ``per_part`` of ``amount``, at least the session's own number."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(amount / per_part) + 1)


def hashed_below(rows: Column, count: Column | int, wanted: int) -> Column:
    """Whether a 64-bit hash is among about the 2 x ``wanted`` least of ``count``: what a sample is then cut from.

    Tasks drop all else by themselves, so what meets in one place does not grow with their number.
    """
    share = F.least(F.lit(1.0), F.lit(2.0 * wanted + 16) / F.greatest(F.lit(1.0), F.lit(count) if isinstance(count, int) else count))
    return F.pmod(F.xxhash64(rows), F.lit(1 << 30)) <= share * (1 << 30)


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Rows in runs of about ``limit`` bytes of text (one row at least), with the texts as bytes, null as empty.

    At the end of a task its memory goes back to the system: workers live on, and what each kind of task has needed
    would add up in them.
    """
    try:
        yield from _slices(batches, text, limit)
    finally:
        give_back()


def give_back() -> None:
    """Returns freed memory of Arrow and of the C library to the system, where they can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def _slices(batches: Iterator[pa.RecordBatch], text: str, limit: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(text))
        if pa.types.is_null(col.type):
            col = col.cast(pa.string())
        sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0)).astype(np.int64)
        at = 0
        total = np.cumsum(sizes)
        while at < batch.num_rows:
            base = int(total[at - 1]) if at else 0
            end = max(at + 1, int(np.searchsorted(total, base + limit, side="right")))
            part = batch.slice(at, end - at)
            yield part, [x or b"" for x in col.slice(at, end - at).cast(pa.binary()).to_pylist()]
            at = end


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[128:] ^= np.uint64(6)
_BASE = 0x9E3779B97F4A7C15 | 1
_CHUNK = 1 << 19


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for b in (_BASE, inverse):
        p = np.empty(n, dtype=np.uint64)
        p[0] = 1
        k = 1
        while k < n:
            step = np.uint64(pow(b, k, 1 << 64))
            m = min(k, n - k)
            p[k:k + m] = p[:m] * step
            k += m
        out.append(p)
    return out[0], out[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of ``data``, and where each starts."""
    hashes, starts = [], []
    buf = np.frombuffer(data, dtype=np.uint8)
    at = 0
    while at < len(buf):
        end = min(len(buf), at + _CHUNK)
        while end < len(buf) and not _SPACE[buf[end - 1]]:  # a chunk ends behind white space
            gap = np.flatnonzero(_SPACE[buf[end:end + _CHUNK]])
            end = min(len(buf), end + (int(gap[0]) + 1 if len(gap) else _CHUNK))
        part = buf[at:end]
        inside = np.concatenate(([False], ~_SPACE[part], [False]))
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        first, last = edge[0::2], edge[1::2]
        n = 1 << max(10, int(len(part) - 1).bit_length())
        power, inverse = _powers(n)
        prefix = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[part] * power[:len(part)], out=prefix[1:])
        hashes.append(mix((prefix[last] - prefix[first]) * inverse[first] + (last - first).astype(np.uint64)))
        starts.append(first + at)
        at = end
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts)


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts (A-Z lower-cased), and the offsets at which each text's words begin and end."""
    lowered = [t.lower() for t in texts]
    hashes, starts = hash_words(b"\n".join(lowered))
    ends = np.cumsum([len(t) + 1 for t in lowered])
    return hashes, np.concatenate(([0], np.searchsorted(starts, ends)))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


#: Links that one task joins by itself; more are first contracted by many.
LINKS_PER_TASK = 500_000


def _forest(batches: Iterator[pa.RecordBatch], roots: bool = False) -> Iterator[pa.RecordBatch]:
    """The edges of this task as a forest: each node with the root of its tree; ``roots`` adds the roots themselves."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (p := parent.setdefault(top, top)) != top:
            top = p
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    def flush() -> pa.RecordBatch:
        nodes = list(parent)
        out = pa.RecordBatch.from_pydict({"a": pa.array(nodes, pa.int64()), "b": pa.array([root(x) for x in nodes], pa.int64())})
        parent.clear()
        return out if roots else out.filter(pc.not_equal(out["a"], out["b"]))

    for batch in batches:
        for x, y in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), strict=True):
            rx, ry = root(x), root(y)
            if rx != ry:
                parent[max(rx, ry)] = min(rx, ry)
        if len(parent) > 2 * LINKS_PER_TASK:  # bounded memory; what stays apart meets again in the next round
            yield flush()
    if parent:
        yield flush()


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _forest(batches, True)


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every node of the links (a, b): equal roots for connected nodes; the root is one of them.

    Rounds of contraction: each task replaces its links by a forest, every node takes the neighbour (or itself)
    of least hash, and links are relabelled by what was taken. Hashes change by round, so long chains shrink by a
    constant factor; a hub with very many links costs one combined minimum and a join that Spark can split. Once no
    more than ``LINKS_PER_TASK`` links are left, one task joins them.
    """
    spark = edges.sparkSession
    left = stored(edges.where("a <> b").select("a", "b").mapInArrow(_forest, "a long, b long"), "links")
    maps = []
    while left.count() > LINKS_PER_TASK:
        seed = len(maps)
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(seed)).alias("h"), F.col(c).alias("v"))  # noqa: B023, E731
        least = both.groupBy("a").agg(F.min(order("b")).alias("m"))
        taken = stored(least.select("a", F.least(F.col("m"), order("a"))["v"].alias("p")), "taken")
        maps.append(taken)
        joined = left.join(taken, "a").select(F.col("p").alias("pa"), "b").join(taken.select(F.col("a").alias("b"), "p"), "b")
        after = joined.select(F.col("pa").alias("a"), F.col("p").alias("b")).where("a <> b").distinct()
        after = stored(after.mapInArrow(_forest, "a long, b long"), "links")
        forget(left)
        left = after
    out = left.coalesce(1).mapInArrow(_whole, "a long, b long").select(F.col("a").alias("id"), F.col("b").alias("root"))
    if not maps:
        return stored(out, "roots")
    for taken in reversed(maps):
        up = stored(out, "roots")
        out = taken.join(up.withColumnRenamed("id", "p"), "p", "left").select(F.col("a").alias("id"), F.coalesce("root", "p").alias("root"))
    return stored(out, "roots")
