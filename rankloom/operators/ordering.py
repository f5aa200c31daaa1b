"""Ordered prefixes over groups of any size.

A plain ``Window.partitionBy(key).orderBy(...)`` puts each key into one task.
That is the right plan for ordinary keys and the wrong one for a key that holds
a third of the log.  Every ordered operator here therefore asks first, with one
map-side-combined count, how large the largest key is:

* if all keys fit a task, the plan is the plain window (one shuffle);
* otherwise the few large keys are split off, range-partitioned by (key, order,
  ties) in the columns' own types, and written to the checkpoint folder with the
  number of their partition; rows are windowed per (key, partition), and a small
  table of per-partition totals carries the prefix from one to the next.

Both roads yield the same values; floating-point sums may differ in rounding.
A null key is a key like any other.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from rankloom.session import checkpoint_dir


@dataclass(frozen=True)
class Skew:
    """When to split a key; segments hold about ``rows_per_task`` rows each."""

    rows_per_task: int = 2_000_000


DEFAULT_SKEW = Skew()
# Large keys are broadcast up to this many (some tens of megabytes).
MAX_BROADCAST_KEYS = 1_000_000


@dataclass(frozen=True)
class Prefix:
    """What to compute along the order; every map is ``{output: input column}``."""

    number: str | None = None  # 1-based position
    sums: Mapping[str, str] = field(default_factory=dict)  # of strictly earlier rows
    maxes: Mapping[str, str] = field(default_factory=dict)  # up to and with this row
    previous: Mapping[str, str] = field(default_factory=dict)  # value one row earlier
    total: str | None = None  # rows in the group
    totals: Mapping[str, str] = field(default_factory=dict)  # sums over the group
    # derives columns that a later Prefix in the same chain reads
    then: Callable[[DataFrame], DataFrame] | None = None


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join by keys that may be null; the keys are taken from ``left``."""
    names = {k: f"_right_{i}" for i, k in enumerate(keys)}
    renamed = right.withColumnsRenamed(names)
    on = [left[k].eqNullSafe(renamed[r]) for k, r in names.items()]
    return left.join(renamed, on, how).drop(*names.values())


def by_weight(
    df: DataFrame,
    keys: Sequence[str],
    light: Callable[[DataFrame], DataFrame],
    heavy: Callable[[DataFrame], DataFrame],
    skew: Skew | None = DEFAULT_SKEW,
    probe: DataFrame | None = None,
) -> DataFrame:
    """Run ``light`` on ordinary keys and ``heavy`` on the large ones.

    The probe brings back a single number.  Fewer than ``rows / rows_per_task``
    keys can be large; they are counted, broadcast up to ``MAX_BROADCAST_KEYS``
    and joined by shuffle beyond.  ``skew=None``
    states that groups are small by construction and skips the probe.
    ``probe`` may name a cheaper table with the same keys and row counts, such
    as the log that ``df`` added columns to.
    """
    if skew is None:
        return light(df)
    sizes = (df if probe is None else probe).groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    largest = sizes.agg(F.max("_rows")).first()[0]
    if largest is None or largest <= skew.rows_per_task:
        return light(df)
    checkpoint_dir(df.sparkSession)
    hot = sizes.where(F.col("_rows") > skew.rows_per_task).select(*keys).checkpoint()
    if hot.count() <= MAX_BROADCAST_KEYS:
        hot = F.broadcast(hot)
    return light(null_safe_join(df, hot, keys, "left_anti")).unionByName(heavy(null_safe_join(df, hot, keys, "left_semi")))


def _window_columns(df: DataFrame, keys: Sequence[str], w: WindowSpec, p: Prefix) -> DataFrame:
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*keys)
    new: dict[str, Column] = {}
    if p.number:
        new[p.number] = F.row_number().over(w).cast("long")
    for out, col in p.sums.items():
        new[out] = F.coalesce(F.sum(col).over(before), F.lit(0))
    for out, col in p.maxes.items():
        new[out] = F.max(col).over(upto)
    for out, col in p.previous.items():
        new[out] = F.lag(col).over(w)
    if p.total:
        new[p.total] = F.count(F.lit(1)).over(whole)
    for out, col in p.totals.items():
        new[out] = F.sum(col).over(whole)
    return df.withColumns(new)


def with_segments(
    df: DataFrame, keys: Sequence[str], order: str, ties: Sequence[str], skew: Skew
) -> DataFrame:
    """Rows with ``_seg``, which does not fall along (order, ties) within a key.

    Segments are the partitions of a range partitioning, so any orderable type
    and any number of rows per key will do.  They are checkpointed: the numbers
    have to be the same wherever the rows are read.
    """
    checkpoint_dir(df.sparkSession)
    parts = max(2, -(-df.count() // skew.rows_per_task))
    ranged = df.repartitionByRange(parts, *keys, order, *ties)
    return ranged.withColumn("_seg", F.spark_partition_id()).checkpoint()


def carry_prefix(
    df: DataFrame, keys: Sequence[str], order: str, ties: Sequence[str], p: Prefix, base: DataFrame | None = None
) -> DataFrame:
    """One Prefix over rows that already carry ``_seg``.

    ``base`` is where the per-segment totals are read from: the same rows before
    columns were added that this Prefix does not need, which keeps plans of
    several independent prefixes small.
    """
    cells = [*keys, "_seg"]
    w = Window.partitionBy(*cells).orderBy(order, *ties)
    aggs = [F.count(F.lit(1)).alias("__cell_rows")]
    aggs += [F.sum(c).alias(f"_s_{o}") for o, c in p.sums.items()]
    aggs += [F.max(c).alias(f"_m_{o}") for o, c in p.maxes.items()]
    aggs += [F.max_by(c, F.struct(order, *ties)).alias(f"_l_{o}") for o, c in p.previous.items()]
    aggs += [F.sum(c).alias(f"_t_{o}") for o, c in p.totals.items()]
    # a row per key and partition from here on
    seg = Window.partitionBy(*keys).orderBy("_seg")
    before = seg.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    carried = {"__carry_no": F.coalesce(F.sum("__cell_rows").over(before), F.lit(0))}
    carried |= {f"_c_{o}": F.coalesce(F.sum(f"_s_{o}").over(before), F.lit(0)) for o in p.sums}
    carried |= {f"_c_{o}": F.max(f"_m_{o}").over(before) for o in p.maxes}
    carried |= {f"_c_{o}": F.lag(f"_l_{o}").over(seg) for o in p.previous}
    if p.total:
        carried[f"_c_{p.total}"] = F.sum("__cell_rows").over(whole)
    carried |= {f"_c_{o}": F.sum(f"_t_{o}").over(whole) for o in p.totals}
    offsets = (df if base is None else base).groupBy(*cells).agg(*aggs).withColumns(carried).select(*cells, *carried)

    local = Prefix(number="__at", sums=p.sums, maxes=p.maxes, previous=p.previous)
    rows = null_safe_join(_window_columns(df, cells, w, local), offsets, cells)
    new: dict[str, Column] = {}
    if p.number:
        new[p.number] = F.col("__at") + F.col("__carry_no")
    new |= {o: F.col(o) + F.col(f"_c_{o}") for o in p.sums}
    new |= {o: F.greatest(F.col(o), F.col(f"_c_{o}")) for o in p.maxes}
    new |= {o: F.when(F.col("__at") == 1, F.col(f"_c_{o}")).otherwise(F.col(o)) for o in p.previous}
    if p.total:
        new[p.total] = F.col(f"_c_{p.total}")
    new |= {o: F.col(f"_c_{o}") for o in p.totals}
    return rows.withColumns(new).drop("__at", *carried)


def segmented_prefix(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    ties: Sequence[str],
    steps: Sequence[Prefix],
    skew: Skew = DEFAULT_SKEW,
) -> DataFrame:
    """The heavy road on its own: every key of ``df`` is cut into segments."""
    out = with_segments(df, keys, order, ties, skew)
    for p in steps:
        out = carry_prefix(out, keys, order, ties, p)
        if p.then:
            out = p.then(out)
    return out.drop("_seg")


def windowed_prefix(
    df: DataFrame, keys: Sequence[str], order: str, ties: Sequence[str], steps: Sequence[Prefix]
) -> DataFrame:
    """The light road on its own: all steps share one shuffle and one sort."""
    w = Window.partitionBy(*keys).orderBy(order, *ties)
    for p in steps:
        df = _window_columns(df, keys, w, p)
        if p.then:
            df = p.then(df)
    return df


def ordered_prefix(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    ties: Sequence[str] = (),
    steps: Sequence[Prefix] | Prefix = (),
    skew: Skew | None = DEFAULT_SKEW,
    probe: DataFrame | None = None,
) -> DataFrame:
    """Positions, running sums, maxima and lags by key, safe for keys of any size.

    ``order`` is read ascending (negate a number for descending), nulls first;
    (``order``, ``ties``) must be unique within a key for a repeatable result.
    """
    chain = [steps] if isinstance(steps, Prefix) else list(steps)
    return by_weight(
        df,
        keys,
        lambda d: windowed_prefix(d, keys, order, ties, chain),
        lambda d: segmented_prefix(d, keys, order, ties, chain, skew),
        skew,
        probe,
    )


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], skew: Skew | None = DEFAULT_SKEW
) -> DataFrame:
    """Linear-interpolated quantiles by key: one row per key with array ``quantiles``.

    Values are counted first, so a repeated value costs one row, and only the
    two order statistics around each requested position reach the last stage.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_cnt"))
    ranked = ordered_prefix(
        counts, keys, value, (), Prefix(sums={"_before": "_cnt"}, totals={"_all": "_cnt"}), skew
    )
    pos = F.col("_p") * (F.col("_all") - 1)
    near = (
        ranked.withColumn("_p", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
        .withColumns({"_pos": pos, "_f": F.floor(pos)})
        .withColumn("_c", F.least(F.col("_f") + 1, F.col("_all") - 1))
        .where((F.col("_before") <= F.col("_c")) & (F.col("_before") + F.col("_cnt") > F.col("_f")))
    )

    def holds(at: str) -> Column:
        return (F.col("_before") <= F.col(at)) & (F.col("_before") + F.col("_cnt") > F.col(at))

    v = F.col(value).cast("double")
    points = near.groupBy(*keys, "_p").agg(
        F.max(F.when(holds("_f"), v)).alias("_lo"),
        F.max(F.when(holds("_c"), v)).alias("_hi"),
        F.max(F.col("_pos") - F.col("_f")).alias("_w"),
    )
    q = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_w")
    # len(probs) elements per key
    return points.groupBy(*keys).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("_p", q.alias("_q")))), lambda s: s["_q"]
        ).alias("quantiles")
    )
