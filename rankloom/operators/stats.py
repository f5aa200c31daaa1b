"""History statistics that never see the row's own label.

Statistics come from a pool (the train split unless told otherwise).  Rows
outside the pool's split read the whole pool.  Train rows read one of

* ``past``      only strictly earlier days,
* ``loo``       everything but the row itself,
* ``insample``  everything (kept for comparison, never the default).

Every key is aggregated once for all its value columns, with map-side combine,
and joined back by key; no raw row enters a window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.scalars import CROSS_PRIOR, PRIOR, mean_or, smooth
from rankloom.operators.ordering import null_safe_join

# Stands for "after the last day" in the past-only lookup.
AFTER_ALL = 2_147_483_647
MODES = ("past", "loo", "insample")


def pool_mean(pool: DataFrame, value: str, where: Column | None = None) -> Column:
    """Mean over the pool as a scalar subquery: computed once, inlined as a constant."""
    df = pool if where is None else pool.where(where)
    return df.agg(F.avg(value).alias("m")).scalar()


def pool_means(pool: DataFrame, values: Mapping[str, str]) -> dict[str, Column]:
    """Means of several columns over the pool from one scalar subquery."""
    if not values:
        return {}
    one = pool.agg(F.struct(*[F.avg(c).alias(o) for o, c in values.items()]).alias("m")).scalar()
    return {o: one.getField(o) for o in values}


def totals_by_key(pool: DataFrame, keys: Sequence[str], values: Mapping[str, str]) -> DataFrame:
    return pool.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_c"), *[F.sum(v).alias(f"_s_{o}") for o, v in values.items()]
    )


def prefix_by_day(
    pool: DataFrame, keys: Sequence[str], values: Mapping[str, str], day: str = "dayord"
) -> DataFrame:
    """Sums and counts of strictly earlier days by ``(keys, day)``, plus one
    ``AFTER_ALL`` row per key holding the whole pool."""
    daily = totals_by_key(pool, [*keys, day], values)
    names = ["_c", *[f"_s_{o}" for o in values]]
    # as many rows per key as the pool has days
    w = Window.partitionBy(*keys).orderBy(day)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = daily.withColumns({f"{n}_in": F.sum(n).over(upto) for n in names}).withColumn(
        "_next", F.lead(day).over(w)
    )
    earlier = F.struct(F.col(day), *[(F.col(f"{n}_in") - F.col(n)).alias(n) for n in names])
    whole = F.struct(F.lit(AFTER_ALL).alias(day), *[F.col(f"{n}_in").alias(n) for n in names])
    cells = F.when(F.col("_next").isNull(), F.array(earlier, whole)).otherwise(F.array(earlier))
    return run.select(*keys, F.explode(cells).alias("_cell")).select(*keys, "_cell.*")


def attach_counts(
    rows: DataFrame,
    pool: DataFrame,
    keys: Sequence[str],
    values: Mapping[str, str],
    mode: str = "past",
    count: str = "cnt",
    is_train: Column | None = None,
    day: str = "dayord",
) -> DataFrame:
    """Add ``count`` and one sum per entry of ``values`` (``{output: column}``).

    ``is_train`` marks the rows that belong to the pool's own split.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    own = F.col("split") == "train" if is_train is None else is_train
    if mode == "past":
        lookup = prefix_by_day(pool, keys, values, day).withColumnRenamed(day, "_day")
        at = F.when(own, F.col(day)).otherwise(F.lit(AFTER_ALL))
        out = rows.withColumn("_day", at).join(lookup, [*keys, "_day"], "left").drop("_day")
        less = {o: F.lit(0) for o in values}
        one = F.lit(0)
    else:
        out = rows.join(totals_by_key(pool, keys, values), list(keys), "left")
        if mode == "loo":
            less = {o: F.when(own, F.col(v)).otherwise(F.lit(0)) for o, v in values.items()}
            one = F.when(own, F.lit(1)).otherwise(F.lit(0))
        else:
            less = {o: F.lit(0) for o in values}
            one = F.lit(0)
    new = {count: F.coalesce(F.col("_c"), F.lit(0)) - one}
    new |= {o: F.coalesce(F.col(f"_s_{o}"), F.lit(0)) - less[o] for o in values}
    return out.withColumns(new).drop("_c", *[f"_s_{o}" for o in values])


def attach_rates(
    rows: DataFrame,
    pool: DataFrame,
    keys: Sequence[str],
    rates: Mapping[str, str],
    means: Mapping[str, str] | None = None,
    mode: str = "past",
    count: str = "cnt",
    prior: float = PRIOR,
) -> DataFrame:
    """Smoothed rates and plain means by one key, from a single aggregate.

    Both fall back to the mean over the whole pool, future days included.
    """
    means = means or {}
    values = {f"_v{i}": c for i, c in enumerate([*rates.values(), *means.values()])}
    out = attach_counts(rows, pool, keys, values, mode, count)
    new: dict[str, Column] = {}
    mean = pool_means(pool, values)
    for i, name in enumerate(rates):
        new[name] = smooth(F.col(f"_v{i}"), F.col(count), mean[f"_v{i}"], prior)
    for i, name in enumerate(means, start=len(rates)):
        new[name] = mean_or(F.col(f"_v{i}"), F.col(count), mean[f"_v{i}"])
    return out.withColumns(new).drop(*values)


def positive_mean(
    rows: DataFrame, pool: DataFrame, keys: Sequence[str], value: str, label: str, out: str, mode: str = "past"
) -> DataFrame:
    """Mean of ``value`` over the key's positives, else over all positives of the pool."""
    masked = F.col(value) * F.col(label)
    got = attach_counts(
        rows.withColumn("_masked", masked), pool.withColumn("_masked", masked), keys,
        {"_sum": "_masked", "_pos": label}, mode, "_all",
    )
    fallback = pool_mean(pool, value, F.col(label) == 1)
    return got.withColumn(out, mean_or(F.col("_sum"), F.col("_pos"), fallback)).drop(
        "_masked", "_sum", "_pos", "_all"
    )


def cross_rate(
    rows: DataFrame,
    pool: DataFrame,
    keys: Sequence[str],
    label: str,
    own_rate: str,
    rate: str,
    count: str,
    mode: str = "past",
    prior: float = CROSS_PRIOR,
) -> DataFrame:
    """Rate by (user, bucket), shrunk to the user's own rate."""
    got = attach_counts(rows, pool, keys, {"_pos": label}, mode, count)
    return got.withColumn(rate, smooth(F.col("_pos"), F.col(count), F.col(own_rate), prior)).drop("_pos")


def tag_affinity(
    rows: DataFrame,
    pool: DataFrame,
    row_keys: Sequence[str],
    user: str,
    tags: str,
    label: str,
    own_rate: str,
    mode: str = "past",
    prior: float = CROSS_PRIOR,
    day: str = "dayord",
) -> DataFrame:
    """Mean over an item's tags of the user's rate on each tag: ``utags_lv_rate``, ``utags_cnt``.

    Returns ``row_keys`` and the two features for rows that have a tag or not;
    a row without tags gets the user's own rate and count 0.
    """
    slim = rows.select(*dict.fromkeys([*row_keys, user, day, "split", label, own_rate, tags]))
    e = slim.withColumn("_tag", F.explode_outer(tags)).drop(tags)
    p = pool.select(user, day, "split", label, F.explode(tags).alias("_tag"))
    got = attach_counts(e, p, [user, "_tag"], {"_pos": label}, mode, "_cnt")
    has = F.col("_tag").isNotNull()
    rate = smooth(F.col("_pos"), F.col("_cnt"), F.col(own_rate), prior)
    return got.groupBy(*row_keys).agg(
        F.coalesce(F.avg(F.when(has, rate)), F.max(own_rate)).alias("utags_lv_rate"),
        F.coalesce(F.avg(F.when(has, F.col("_cnt"))), F.lit(0.0)).alias("utags_cnt"),
    )


def _item_counts(pool: DataFrame, item: str, label: str) -> tuple[DataFrame, Column]:
    """Positives and rows by item, and the pool mean taken from the same aggregate."""
    g = pool.groupBy(item).agg(F.sum(label).alias("_s"), F.count(F.lit(1)).alias("_c"))
    return g, g.agg((F.sum("_s") / F.sum("_c")).alias("m")).scalar()


def popularity(pool: DataFrame, item: str, label: str, prior: float = PRIOR) -> DataFrame:
    """Smoothed positive rate by item."""
    g, mean = _item_counts(pool, item, label)
    return g.select(item, smooth(F.col("_s"), F.col("_c"), mean, prior).alias("pop_score"))


def score_popularity(
    rows: DataFrame, pool: DataFrame, item: str, label: str, score: str = "score", prior: float = PRIOR
) -> DataFrame:
    """Popularity of the row's item; unseen items get the pool mean."""
    g, mean = _item_counts(pool, item, label)
    rate = smooth(F.coalesce("_s", F.lit(0)), F.coalesce("_c", F.lit(0)), mean, prior)
    return rows.join(g, item, "left").withColumn(
        score, F.when(F.col("_c").isNull(), mean).otherwise(rate)
    ).drop("_s", "_c")


def history_maps(
    rows: DataFrame, train: DataFrame, user: str, item: str, label: str, prior: float = PRIOR
) -> DataFrame:
    """Train-fitted rates and log counts by item, user, user-author and user-hour.

    The row's own label is part of a train row's statistics (mode ``insample``).
    """
    out = rows
    mean = pool_mean(train, label)
    for keys, rate, cnt in (
        ([item], "item_ctr", "item_n"),
        ([user], "user_ctr", "user_n"),
        ([user, "author_id"], "user_author_ctr", None),
        ([user, "hour"], "user_hour_ctr", None),
    ):
        out = attach_counts(out, train, keys, {"_pos": label}, "insample", "_cnt")
        out = out.withColumn(rate, smooth(F.col("_pos"), F.col("_cnt"), mean, prior))
        if cnt:
            out = out.withColumn(cnt, F.log1p(F.col("_cnt")))
        out = out.drop("_pos", "_cnt")
    return out


def tag_popularity(items: DataFrame, item: str, tags: str) -> DataFrame:
    """Each item's most frequent tag over the catalogue; the earlier tag wins ties."""
    e = items.select(item, F.posexplode(tags).alias("pos", "tag"))
    freq = e.groupBy("tag").agg(F.count(F.lit(1)).alias("tag_cnt"))
    return e.join(freq, "tag").groupBy(item).agg(
        F.max_by("tag", F.struct("tag_cnt", -F.col("pos"))).alias("tag_pop"),
        F.max("tag_cnt").alias("tag_pop_cnt"),
    )


def mixed_weight(rows: DataFrame, keys: Sequence[str], label: str, weight: float) -> DataFrame:
    """1 for rows whose (user, day) list has both classes, ``weight`` for the rest."""
    g = rows.groupBy(*keys).agg(F.sum(label).alias("_s"), F.count(F.lit(1)).alias("_c"))
    mixed = (F.col("_s") > 0) & (F.col("_s") < F.col("_c"))
    return null_safe_join(rows, g, keys).withColumn("weight", F.when(mixed, 1.0).otherwise(weight)).drop("_s", "_c")


def group_totals(rows: DataFrame, keys: Sequence[str], *aggs: Column) -> DataFrame:
    """Attach aggregates of a row's group; any key may be hot, as nothing is sorted."""
    return null_safe_join(rows, rows.groupBy(*keys).agg(*aggs), keys)
