"""Row splits: by date range, by time fraction, by hashed sample and fold."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions.hashing import hash32
from rankloom.operators.ordering import DEFAULT_SKEW, Prefix, Skew, ordered_prefix


def date_split(df: DataFrame, ranges: Mapping[str, tuple[int, int]], date: str = "date") -> DataFrame:
    """Name the inclusive date range of each row and drop rows outside all of them."""
    name = F.lit(None).cast("string")
    for split, (lo, hi) in ranges.items():
        name = F.when(F.col(date).between(lo, hi), F.lit(split)).otherwise(name)
    return df.withColumn("split", name).where(F.col("split").isNotNull())


def pool_of(df: DataFrame, lo: int, hi: int, date: str = "date") -> DataFrame:
    """The statistics pool given by an inclusive date window."""
    return df.where(F.col(date).between(lo, hi))


def time_fraction_split(
    df: DataFrame, keys: Sequence[str], fraction: float, ties: Sequence[str], skew: Skew = DEFAULT_SKEW
) -> DataFrame:
    """First ``floor(n * fraction)`` rows by time are 'valid', the rest 'test'."""
    ranked = ordered_prefix(df, keys, "time_us", ties, Prefix(number="_no", total="_all"), skew)
    cut = F.floor(F.col("_all") * F.lit(fraction))
    return ranked.withColumn("part", F.when(F.col("_no") <= cut, "valid").otherwise("test")).drop("_no", "_all")


def seeded_sample(df: DataFrame, n: int, seed: int, row_id: str = "row_id") -> DataFrame:
    """Exactly n rows (all, if fewer), the same ones for the same seed: those of least hash, ties by row id.

    A histogram of the hash's leading bits, summed map-side, names the bucket the
    n-th row lies in.  Rows of lower buckets pass by a filter; only that one
    bucket, about a 65536th of the rows, is put in order.
    """
    hashed = df.withColumn("_h", hash32(seed, row_id))
    bucket = F.floor(F.col("_h") / 65536)
    sizes = hashed.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("c")).collect()  # 65536 rows at most
    below, edge = 0, None
    for r in sorted(sizes, key=lambda r: r["b"]):
        if below + r["c"] > n:
            edge = r["b"]
            break
        below += r["c"]
    if edge is None:
        return df
    whole = hashed.where(bucket < edge)
    part = hashed.where(bucket == edge).orderBy("_h", row_id).limit(n - below)
    return whole.unionByName(part).drop("_h")


def fold_of(df: DataFrame, folds: int, seed: int, unit: str = "row_id", out: str = "fold") -> DataFrame:
    """Fold number by hash of the row (default) or of the user."""
    return df.withColumn(out, F.pmod(hash32(seed, unit), F.lit(folds)).cast("int"))
