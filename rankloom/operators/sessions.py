"""Exposure features: sessions, gaps, repeats, recency and last-N histories.

They read ids and timestamps only, never a label of the scored window (the
history operator reads labels of the train pool alone).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.operators.ordering import (
    DEFAULT_SKEW,
    Prefix,
    Skew,
    by_weight,
    carry_prefix,
    ordered_prefix,
    windowed_prefix,
    with_segments,
)

# Silence that ends a session, and the recency of a key never seen.
SESSION_GAP_US = 30 * 60 * 1_000_000
NEVER_SEEN_DAYS = 99


def _session_steps() -> list[Prefix]:
    """Gap to the previous impression, then the latest session and day starts."""

    def starts(d: DataFrame) -> DataFrame:
        first = F.col("_prev_t").isNull()
        new_day = first | (F.col("_prev_d") != F.col("date"))
        gap = F.col("time_us") - F.col("_prev_t")
        new_session = new_day | (gap > SESSION_GAP_US)
        return d.withColumns(
            {
                "gap_prev_ms": F.log1p(gap / 1000),
                "_sess": F.when(new_session, F.col("_no")),
                "_day": F.when(new_day, F.col("_no")),
            }
        )

    def positions(d: DataFrame) -> DataFrame:
        return d.withColumns(
            {"sess_pos": F.col("_no") - F.col("_sess0"), "impr_idx_day": F.col("_no") - F.col("_day0")}
        ).drop("_no", "_prev_t", "_prev_d", "_sess", "_day", "_sess0", "_day0")

    return [
        Prefix(number="_no", previous={"_prev_t": "time_us", "_prev_d": "date"}, then=starts),
        Prefix(maxes={"_sess0": "_sess", "_day0": "_day"}, then=positions),
    ]


def session_features(
    df: DataFrame,
    user: str = "user_id",
    seen: dict[str, str] | None = None,
    skew: Skew = DEFAULT_SKEW,
) -> DataFrame:
    """``gap_prev_ms``, ``sess_pos``, ``impr_idx_day`` and seen-today counters.

    ``seen`` maps an output to the key column it counts within (user, date).
    A session breaks on user, day or 30 minutes of silence; splits are separate
    streams.  For ordinary users everything shares the one shuffle on
    (split, user).
    """
    seen = seen or {}
    keys = ["split", user]
    steps = _session_steps()

    def counter(out: str) -> Prefix:
        return Prefix(number=out, then=lambda d: d.withColumn(out, F.col(out) - 1))

    def light(d: DataFrame) -> DataFrame:
        d = windowed_prefix(d, keys, "time_us", ["row_id"], steps)
        for out, key in seen.items():
            d = windowed_prefix(d, [*keys, "date", key], "time_us", ["row_id"], [counter(out)])
        return d

    def heavy(d: DataFrame) -> DataFrame:
        # segments of the user's time line are segments of any finer key as well
        base = out = with_segments(d, keys, "time_us", ["row_id"], skew)
        for p in steps:
            out = p.then(carry_prefix(out, keys, "time_us", ["row_id"], p))
        for name, key in seen.items():
            p = counter(name)
            out = p.then(carry_prefix(out, [*keys, "date", key], "time_us", ["row_id"], p, base))
        return out.drop("_seg")

    return by_weight(df, keys, light, heavy, skew)


def last_seen(log: DataFrame, pool: DataFrame, key: str, day: str = "dayord", out: str = "last_day") -> DataFrame:
    """Strict backward as-of join: the latest day before the row's on which the pool has its key, else null."""
    days = pool.select(key, F.col(day).alias("_day")).where(F.col(key).isNotNull()).distinct()
    asked = log.select(key, F.col(day).alias("_day")).distinct()
    # one row per key and day on both sides, so a key is as long as its days
    both = days.select(key, "_day", F.col("_day").alias("_seen")).unionByName(asked.select(key, "_day", F.lit(None).cast("int").alias("_seen")))
    cell = both.groupBy(key, "_day").agg(F.max("_seen").alias("_seen"))
    before = Window.partitionBy(key).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    found = cell.withColumn(out, F.max("_seen").over(before)).select(F.col(key), F.col("_day").alias(day), out)
    return log.join(found, [key, day], "left")


def days_since(
    rows: DataFrame, train: DataFrame, key: str, out: str, day: str = "dayord", exposures: DataFrame | None = None
) -> DataFrame:
    """Days since the key was last seen on a strictly earlier day, 99 if never.

    ``exposures`` is the plain log behind ``rows``; naming it keeps the columns
    ``rows`` has gained out of the look-up table's plan.

    Train rows look into train; rows of another split look into train and into
    their own split.  The as-of join runs over distinct (split, key, day)
    triples, so a key contributes at most one row per day.
    """
    log = rows if exposures is None else exposures
    others = log.where("split <> 'train'").select("split").distinct()
    seen = train.select(key, day).distinct()
    # one copy of the train days per other split; the split table has a handful of rows
    names = others.agg(F.collect_set("split").alias("s")).scalar()
    pool = seen.select(F.explode(F.concat(F.array(F.lit("train")), names)).alias("split"), key, day)
    stream = pool.unionByName(log.select("split", key, day)).distinct()
    w = Window.partitionBy("split", key).orderBy(day)
    last = stream.withColumn("_last", F.lag(day).over(w))
    return (
        rows.join(last, ["split", key, day], "left")
        .withColumn(out, F.coalesce(F.col(day) - F.col("_last"), F.lit(NEVER_SEEN_DAYS)))
        .drop("_last")
    )


def last_n_history(
    rows: DataFrame,
    pool: DataFrame,
    n: int,
    user: str = "user_id",
    item: str = "video_id",
    label: str = "long_view",
    skew: Skew = DEFAULT_SKEW,
) -> DataFrame:
    """``row_id, hist_len, history``: the user's last n positives before the row.

    ``history`` is most recent first and holds pool positives with a strictly
    smaller timestamp.  Positives are numbered per user and stored in chunks of
    n together with the chunk before, so each row needs one equi-join on
    (user, chunk) and no array exceeds 2n entries.
    """
    # impressions sort before positives of the same instant: only earlier ones count
    shown = rows.select(user, "time_us", F.lit(0).alias("_kind"), "row_id", F.lit(None).cast("int").alias("_item"))
    liked = pool.where(F.col(label) == 1).select(
        user, "time_us", F.lit(1).alias("_kind"), "row_id", F.col(item).alias("_item")
    )
    both = shown.unionByName(liked)
    ranked = ordered_prefix(both, [user], "time_us", ["_kind", "row_id"], Prefix(sums={"_cnt": "_kind"}), skew)
    pos = F.col("_cnt")
    chunks = (
        ranked.where("_kind = 1")
        .select(user, pos.alias("_pos"), "_item")
        # a positive serves its own chunk and, as the tail, the next one
        .withColumn("_chunk", F.explode(F.array(F.floor(F.col("_pos") / n), F.floor(F.col("_pos") / n) + 1)))
        .groupBy(user, "_chunk")
        .agg(F.collect_list(F.struct("_pos", "_item")).alias("_items"))
    )
    at = ranked.where("_kind = 0").select(user, "row_id", pos.alias("_cnt"))
    at = at.withColumn("_chunk", F.floor((F.col("_cnt") - 1) / n))
    recent = F.filter(
        "_items", lambda x: (x["_pos"] < F.col("_cnt")) & (x["_pos"] >= F.col("_cnt") - n)
    )
    newest_first = F.reverse(F.array_sort(recent))
    joined = at.join(chunks, [user, "_chunk"], "left")
    history = F.coalesce(F.transform(newest_first, lambda x: x["_item"]), F.array().cast("array<int>"))
    return joined.select("row_id", F.size(history).alias("hist_len"), history.alias("history"))


def time_rank_z(df: DataFrame, keys: Sequence[str], skew: Skew = DEFAULT_SKEW) -> DataFrame:
    """Position of the row in its user's time order, and its time as a z-score."""
    from rankloom.operators.ranks import zscore

    ranked = ordered_prefix(df, keys, "time_us", ["row_id"], Prefix(number="time_rank"), skew)
    return zscore(ranked, keys, "time_us", "time_z")
