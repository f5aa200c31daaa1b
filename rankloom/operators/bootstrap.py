"""Paired user bootstrap of two scored systems."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions.hashing import uniform_numbers
from rankloom.operators.ordering import DEFAULT_SKEW, Prefix, Skew, exact_quantiles, ordered_prefix
from rankloom.session import checkpoint_dir

METRICS = ("gauc", "ndcg_at_5", "primary_score")


# Users of one block.
USERS_PER_BLOCK = 1024
# Blocks of about so many users share a task's group: what it holds is their pieces, and a count a resample and block.
USERS_PER_GROUP = 2048
# Draws of the first level made by one row, and of either level by one task.
SPAN = 1 << 22
DRAWS_PER_TASK = 1 << 23
# Draws of the second level in memory at once.
_AT_ONCE = 1 << 18


def _first_level(by: Sequence[str], block: int):
    """Counts by block of a span of draws: rows (by, _all, rep, _span) to (by, rep, _b, _c)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                n, rep, span = (batch.column(c)[k].as_py() for c in ("_all", "rep", "_span"))
                sums = np.zeros(-(-n // block), dtype=np.int64)
                for lo in range(span * SPAN, min(n, (span + 1) * SPAN), _AT_ONCE):
                    i = np.arange(lo, min(n, (span + 1) * SPAN, lo + _AT_ONCE))
                    hit = np.floor(uniform_numbers(rep, i) * n).astype(np.int64) // block
                    sums += np.bincount(hit, minlength=len(sums))
                b = np.flatnonzero(sums)
                keys = [batch.column(c).take(pa.array(np.full(len(b), k))) for c in by]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(np.full(len(b), rep)), pa.array(b), pa.array(sums[b])], names=[*by, "rep", "_b", "_c"])

    return run


def _second_level(keys: Sequence[str], block: int, per_group: int, width: int):
    """Sums of the pieces that a group's draws hit: (group, counts, users) to (group, rep, users, sums)."""

    def run(key: tuple, counts: pa.Table, users: pa.Table) -> pa.Table:
        names = [*keys, "rep", "_users", *[f"_{i}" for i in range(width)]]
        if users.num_rows == 0 or counts.num_rows == 0:
            empty = [pa.array([], x.type) for x in key]
            return pa.Table.from_arrays([*empty, pa.array([], pa.int64()), *[pa.array([], pa.float64())] * (width + 1)], names=names)
        n, first = users.column("_all")[0].as_py(), key[-1].as_py() * per_group
        cells = np.zeros((per_group * block, width + 1))  # the last column tells that the number has a user
        at = users.column("_no").to_numpy() - 1 - first * block
        cells[at, :width] = users.column("_cell").combine_chunks().flatten().to_numpy().reshape(-1, width)
        cells[at, width] = 1.0
        # a resample's count of a block may come in several spans
        rep, b, c = (counts.column(x).to_numpy() for x in ("rep", "_b", "_c"))
        order = np.lexsort((b, rep))
        rep, b, c = rep[order], b[order], c[order]
        new = np.flatnonzero(np.append(True, (rep[1:] != rep[:-1]) | (b[1:] != b[:-1])))
        rep, b, c = rep[new], b[new], np.add.reduceat(c, new)
        reps, place = np.unique(rep, return_inverse=True)
        sums = np.zeros((len(reps), width + 1))
        ends = np.cumsum(c)
        for lo in range(0, int(ends[-1]), _AT_ONCE):
            draw = np.arange(lo, min(int(ends[-1]), lo + _AT_ONCE))
            cell = np.searchsorted(ends, draw, side="right")
            j = draw - (ends[cell] - c[cell])
            size = np.minimum(block, n - b[cell] * block)
            hit = (b[cell] - first) * block + np.floor(uniform_numbers(rep[cell], b[cell], j) * size).astype(np.int64)
            low, high = place[cell[0]], place[cell[-1]] + 1
            for i in range(width + 1):
                sums[low:high, i] += np.bincount(place[cell] - low, weights=cells[hit, i], minlength=high - low)
        same = [pa.array([x.as_py()] * len(reps), x.type) for x in key]
        return pa.Table.from_arrays([*same, pa.array(reps, pa.int64()), pa.array(sums[:, width]), *[pa.array(sums[:, i]) for i in range(width)]], names=names)

    return run


def paired_resamples(
    pieces: DataFrame, by: Sequence[str], user: str, reps: int, block: int = USERS_PER_BLOCK, skew: Skew = DEFAULT_SKEW
) -> DataFrame:
    """Protocol of systems 'a' and 'b' on ``reps`` resamples of the users.

    ``pieces`` holds one row per (by, system, user).  A resample of n users makes
    n draws in two levels.  First a block of users is drawn n times per resample,
    by the share of each; those draws need n alone, so any task can make those of
    any resample, and only counts by (resample, block) move.  Then a group of
    blocks meets its counts in one task, which draws inside the blocks and sums
    the pieces of both systems it hits: one row per (resample, group) leaves it.
    Draws are hashed from (rep, i) and (rep, block, j).  The pieces are
    checkpointed, since the users are numbered from them and the blocks are made
    of them.  The number of tasks follows the draws, not the few bytes they start from.
    """
    spark = pieces.sparkSession
    checkpoint_dir(spark)
    by = list(by)
    pieces = pieces.checkpoint()
    users = pieces.where("system = 'a'").select(*by, user)
    sizes = users.groupBy(*by).agg(F.count(F.lit(1)).alias("_all"))
    total = sizes.agg(F.sum("_all")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total * reps // DRAWS_PER_TASK))
    types = {f.name: f.dataType.simpleString() for f in pieces.schema.fields}
    text = "".join(f"`{c}` {types[c]}, " for c in by)
    spans = (
        sizes.select(*by, "_all", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
        .withColumn("_span", F.explode(F.sequence(F.lit(0), F.floor((F.col("_all") - 1) / SPAN))))
        .repartition(parts)
    )
    counts = spans.mapInArrow(_first_level(by, block), text + "rep bigint, _b bigint, _c bigint")
    mixed = (F.col("npos") > 0) & (F.col("npos") < F.col("n"))
    terms = [F.when(mixed, F.col("npos") * F.col("auc")).otherwise(0.0), F.when(mixed, F.col("npos")).otherwise(0), F.col("ndcg"), F.col("n")]
    sides = [F.max(F.when(F.col("system") == s, t.cast("double"))) for s in ("a", "b") for t in terms]
    cells = pieces.groupBy(*by, user).agg(F.array(*[F.coalesce(s, F.lit(0.0)) for s in sides]).alias("_cell"))
    ranked = ordered_prefix(users, by, user, (), Prefix(number="_no", total="_all"), skew)
    per_group = max(1, USERS_PER_GROUP // block)
    keys = [*by, "_g"]
    groups = ranked.join(cells, [*by, user]).select(*by, F.floor((F.col("_no") - 1) / (block * per_group)).alias("_g"), "_all", "_no", "_cell")
    counts = counts.withColumn("_g", F.floor(F.col("_b") / per_group))
    got = (
        counts.repartition(parts, *keys).groupBy(*keys)
        .cogroup(groups.repartition(parts, *keys).groupBy(*keys))
        .applyInArrow(
            _second_level(keys, block, per_group, len(sides)),
            text + "_g bigint, rep bigint, _users double, " + ", ".join(f"_{i} double" for i in range(len(sides))),
        )
    )
    sums = got.groupBy(*by, F.col("rep").cast("int").alias("rep")).agg(
        F.sum("_users").cast("long").alias("users"), *[F.sum(f"_{i}").alias(f"_{i}") for i in range(len(sides))])
    per_system = F.explode(F.array(*[
        F.struct(F.lit(s).alias("system"), *[F.col(f"_{4 * k + i}").alias(n) for i, n in enumerate(("ga", "gp", "nd", "rows"))])
        for k, s in enumerate(("a", "b"))
    ]))
    flat = sums.select(*by, "rep", "users", per_system.alias("_x")).select(*by, "rep", "users", "_x.*")
    gauc = F.when(F.col("gp") > 0, F.col("ga") / F.col("gp")).otherwise(0.5)
    ndcg = F.col("nd") / F.col("users")
    return flat.select(
        *by, "rep", "system", gauc.alias("gauc"), ndcg.alias("ndcg_at_5"), ((gauc + ndcg) / 2).alias("primary_score"),
        "users", F.col("rows").cast("long").alias("row_count"),
    )


def paired_deltas(resamples: DataFrame, by: Sequence[str]) -> DataFrame:
    """``(by, rep, metric, delta)``, delta = system b minus system a."""
    signed = [
        F.sum(F.when(F.col("system") == "b", F.col(m)).otherwise(-F.col(m))).alias(m) for m in METRICS
    ]
    wide = resamples.groupBy(*by, "rep").agg(*signed)
    pairs = F.create_map(*[x for m in METRICS for x in (F.lit(m), F.col(m))])
    return wide.select(*by, "rep", F.explode(pairs).alias("metric", "delta"))


# Differences of equal metrics may carry this much rounding.
ROUNDING = 1e-12


def summarise(deltas: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean, 2.5 and 97.5 percentile and share of resamples at or below zero."""
    keys = [*by, "metric"]
    flat = deltas.groupBy(*keys).agg(
        F.avg("delta").alias("mean"),
        F.avg((F.col("delta") <= ROUNDING).cast("double")).alias("p_le_0"),
        F.count(F.lit(1)).alias("reps"),
    )
    # one value per resample and metric
    q = exact_quantiles(deltas, keys, "delta", [0.025, 0.975], skew=None)
    return flat.join(q, keys).select(
        *keys, "mean", F.col("quantiles")[0].alias("lo95"), F.col("quantiles")[1].alias("hi95"), "p_le_0", "reps"
    )
