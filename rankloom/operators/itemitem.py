"""Item-item similarity from co-occurring positives, and history scores.

The similarity matrix stays in coordinate form ``(item_i, item_j, w)``; nothing
is densified or brought to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Item pairs one task may combine per batch of a user slice (memory bound, not a cut-off).
PAIR_BATCH = 2_000_000


def distinct_pairs(pool: DataFrame, label: str, user: str = "user_id", item: str = "video_id") -> DataFrame:
    """Distinct (user, item) positives."""
    return pool.where(F.col(label) == 1).select(user, item).distinct()


def _combine_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Co-occurrence counts of the (user, cell) groups in one task.

    Groups arrive contiguous and sorted.  In a cell of one block each item meets
    the items from its own position on (half of the symmetric matrix); in a cell
    of two blocks each item of one meets all of the other.  Counts are added up
    by item pair before anything is emitted.
    """
    sums: dict[str, np.ndarray] = {}

    def add(i: np.ndarray, j: np.ndarray, c: np.ndarray) -> None:
        if sums:
            i, j, c = (np.concatenate([sums[k], v]) for k, v in (("i", i), ("j", j), ("c", c)))
        order = np.lexsort((j, i))
        i, j, c = i[order], j[order], c[order]
        new = np.ones(len(i), dtype=bool)
        new[1:] = (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        at = np.flatnonzero(new)
        sums.update(i=i[at], j=j[at], c=np.add.reduceat(c, at) if len(at) else c)

    def flush() -> pd.DataFrame:
        out = pd.DataFrame({"item_i": sums["i"], "item_j": sums["j"], "co": sums["c"]})
        sums.clear()
        return out

    def count(block: pd.DataFrame) -> None:
        """All groups of ``block`` are complete."""
        if block.empty:
            return
        item = block["item"].to_numpy()
        left = block["is_left"].to_numpy()
        two = block["two_blocks"].to_numpy()
        g = block["user"].to_numpy(), block["cell"].to_numpy()
        new = np.ones(len(item), dtype=bool)
        new[1:] = (g[0][1:] != g[0][:-1]) | (g[1][1:] != g[1][:-1])
        starts = np.flatnonzero(new)
        ends = np.repeat(np.append(starts[1:], len(item)), np.diff(np.append(starts, len(item))))
        for lo in starts[two[starts]]:
            hi = ends[lo]
            mine = left[lo:hi]
            a, b = item[lo:hi][mine], item[lo:hi][~mine]
            step = max(1, PAIR_BATCH // max(1, len(b)))
            for at in range(0, len(a), step):
                x, y = np.repeat(a[at:at + step], len(b)), np.tile(b, len(a[at:at + step]))
                add(np.minimum(x, y), np.maximum(x, y), np.ones(len(x), dtype=np.int64))
        rows = np.flatnonzero(~two)
        width = ends[rows] - rows  # partners at or after the row; items are sorted in a group
        todo = np.cumsum(width)
        lo = 0
        while lo < len(rows):
            done = todo[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(todo, done + PAIR_BATCH, side="right")))
            r, w = rows[lo:hi], width[lo:hi]
            i = np.repeat(item[r], w)
            step = np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w)
            j = item[np.repeat(r, w) + step]
            add(i, j, np.ones(len(i), dtype=np.int64))
            lo = hi

    rest: pd.DataFrame | None = None
    for pdf in batches:
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        # the last group may go on in the next batch
        last = (pdf["user"] == pdf["user"].iloc[-1]) & (pdf["cell"] == pdf["cell"].iloc[-1])
        count(pdf[~last].reset_index(drop=True))
        rest = pdf[last].reset_index(drop=True)
        if sums and len(sums["c"]) > PAIR_BATCH:
            yield flush()
    if rest is not None:
        count(rest)
    if sums:
        yield flush()


def cooccurrence(
    pairs: DataFrame, user: str = "user_id", item: str = "video_id", items_per_block: int = 2_000
) -> DataFrame:
    """``(item_i, item_j, co)``: users who hold both items; the diagonal is the item's count.

    ``pairs`` must be distinct.  The items of a user with more than
    ``items_per_block`` are dealt to blocks, and every pair of blocks is a cell of
    its own: a group never holds more than two blocks, so no task owns a heavy
    user's square.  An item goes to as many cells as there are blocks.  Pair
    counts are combined inside the task and once more by the shuffle; single
    pairs never move.
    """
    sizes = pairs.groupBy(user).agg(F.ceil(F.count(F.lit(1)) / items_per_block).cast("int").alias("_blocks"))
    placed = pairs.join(sizes, user).withColumn("_own", F.pmod(F.xxhash64(item), F.col("_blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_other")
    lo, hi = F.least("_own", "_other"), F.greatest("_own", "_other")
    cells = placed.select(user, item, "_blocks", "_own", other).select(
        F.col(user).cast("long").alias("user"),
        (lo.cast("long") * F.col("_blocks") + hi).alias("cell"),
        F.col(item).cast("long").alias("item"),
        (F.col("_own") == lo).alias("is_left"),
        (F.col("_own") != F.col("_other")).alias("two_blocks"),
    )
    # a cell of two blocks gets the items of both
    placed = cells.repartition("user", "cell").sortWithinPartitions("user", "cell", "item")
    half = (
        placed.mapInPandas(_combine_pairs, "item_i long, item_j long, co long")
        .groupBy("item_i", "item_j")
        .agg(F.sum("co").alias("co"))
    )
    # the other half of the symmetric matrix
    both = F.when(
        F.col("item_i") == F.col("item_j"), F.array(F.struct("item_i", "item_j"))
    ).otherwise(
        F.array(F.struct("item_i", "item_j"), F.struct(F.col("item_j").alias("item_i"), F.col("item_i").alias("item_j")))
    )
    return half.select(F.explode(both).alias("_p"), "co").select("_p.*", "co")


def item_norms(pairs: DataFrame, item: str = "video_id") -> DataFrame:
    """``(item, ninv)`` with ninv = 1 / sqrt(users holding the item)."""
    return pairs.groupBy(F.col(item).cast("long").alias("item")).agg(
        (1 / F.sqrt(F.count(F.lit(1)))).alias("ninv")
    )


def cosine(pairs: DataFrame, user: str = "user_id", item: str = "video_id") -> DataFrame:
    """``(item_i, item_j, w)`` cosine similarity, diagonal 1."""
    norms = item_norms(pairs, item)
    co = cooccurrence(pairs, user, item)
    return (
        co.join(norms.select(F.col("item").alias("item_i"), F.col("ninv").alias("_a")), "item_i")
        .join(norms.select(F.col("item").alias("item_j"), F.col("ninv").alias("_b")), "item_j")
        .select("item_i", "item_j", "co", (F.col("co") * F.col("_a") * F.col("_b")).alias("w"))
    )


# A user whose candidates times history exceed this is scored by expanding the history instead.
PRODUCT = 10_000_000


def history_score(
    rows: DataFrame, pairs: DataFrame, sim: DataFrame, user: str = "user_id", item: str = "video_id",
    product: int = PRODUCT,
) -> DataFrame:
    """Add ``cf_sum``, ``cf_mean`` and ``u_hist_cnt``.

    cf_sum adds the similarity of the row's item to every item of the user's
    history.  Rows are first reduced to distinct (user, item) candidates.  They
    are looked up against the user's history, a product that no task may own
    where both are long: the histories of users whose product exceeds ``product``
    are expanded by the stored similarities of the items they are candidates
    for, joined by item, summed by (user, item) map-side, and met by key.
    """
    cand = rows.select(user, item).distinct()
    history = pairs.select(user, F.col(item).cast("long").alias("item_j"))
    weights = sim.select("item_i", "item_j", "w")

    def looked_up(c: DataFrame) -> DataFrame:
        return (
            c.join(history, user)
            .withColumn("item_i", F.col(item).cast("long"))
            .join(weights, ["item_i", "item_j"])
            .groupBy(user, item)
            .agg(F.sum("w").alias("cf_sum"))
        )

    def expanded(c: DataFrame) -> DataFrame:
        keyed = c.withColumn("item_i", F.col(item).cast("long"))
        mine = history.join(c.select(user).distinct(), user, "left_semi")
        asked = weights.join(keyed.select("item_i").distinct(), "item_i", "left_semi")
        summed = mine.join(asked, "item_j").groupBy(user, "item_i").agg(F.sum("w").alias("cf_sum"))
        return keyed.join(summed, [user, "item_i"]).select(user, item, "cf_sum")

    sizes = cand.groupBy(user).agg(F.count(F.lit(1)).alias("_c")).join(pairs.groupBy(user).agg(F.count(F.lit(1)).alias("_h")), user)
    wide = sizes.where(F.col("_c") * F.col("_h") > product).select(user)
    if wide.isEmpty():
        found = looked_up(cand)
    else:
        found = looked_up(cand.join(wide, user, "left_anti")).unionByName(expanded(cand.join(wide, user, "left_semi")))
    sizes = pairs.groupBy(user).agg(F.count(F.lit(1)).alias("u_hist_cnt"))
    out = rows.join(found, [user, item], "left").join(sizes, user, "left")
    out = out.withColumns(
        {"cf_sum": F.coalesce("cf_sum", F.lit(0.0)), "u_hist_cnt": F.coalesce("u_hist_cnt", F.lit(0))}
    )
    return out.withColumn("cf_mean", F.col("cf_sum") / F.greatest("u_hist_cnt", F.lit(1)))


def leave_user_out(
    scored: DataFrame, pairs: DataFrame, label: str, user: str = "user_id", item: str = "video_id"
) -> DataFrame:
    """Remove a positive row's own user from its cosine score.

    Such a row meets itself (1) and adds one to every co-count with the user's
    history, which is worth ``ninv_v * (sum ninv - ninv_v)``.
    """
    norms = item_norms(pairs, item)
    total = (
        pairs.withColumn("item", F.col(item).cast("long")).join(norms, "item")
        .groupBy(user).agg(F.sum("ninv").alias("_sum"))
    )
    own = F.col(label).cast("double")
    known = norms.select(F.col("item").alias("_item"), F.col("ninv").alias("_ninv"))
    j = scored.join(known, F.col(item).cast("long") == F.col("_item"), "left").join(total, user, "left")
    ni = F.coalesce("_ninv", F.lit(0.0))
    has_history = F.col("_sum").isNotNull()
    fixed = F.when(
        has_history, F.col("cf_sum") - own * (1 + ni * (F.col("_sum") - ni))
    ).otherwise(F.col("cf_sum"))
    size = F.when(has_history, F.col("u_hist_cnt") - own).otherwise(F.col("u_hist_cnt"))
    out = j.withColumns({"cf_sum": fixed, "u_hist_cnt": size})
    return out.withColumn("cf_mean", F.col("cf_sum") / F.greatest("u_hist_cnt", F.lit(1.0))).drop(
        "_item", "_ninv", "_sum"
    )


def middle_day(pool: DataFrame, day: str = "date"):
    """The middle of the distinct days (not of the rows), as a scalar subquery."""
    days = F.sort_array(F.collect_set(day))  # bounded by the calendar
    return pool.agg(F.element_at(days, F.floor(F.size(days) / 2).cast("int") + 1).alias("cut")).scalar()


def two_phase_scores(rows: DataFrame, train: DataFrame, label: str, similarities, day: str = "date") -> dict[str, DataFrame]:
    """History scores that never see a train row's own period, per similarity.

    ``similarities`` maps distinct pairs to ``{name: (item_i, item_j, w)}``, once
    per phase.  The matrix of days before the middle day scores train rows from
    that day on, earlier train rows get 0; the whole train matrix scores the
    other splits.
    """
    cut = middle_day(train, day)
    early = distinct_pairs(train.where(F.col(day) < cut), label)
    full = distinct_pairs(train, label)
    own = F.col("split") == "train"
    late_train = rows.where(own & (F.col(day) >= cut))
    first_train = rows.where(own & (F.col(day) < cut)).withColumns(
        {"cf_sum": F.lit(0.0), "u_hist_cnt": F.lit(0).cast("long"), "cf_mean": F.lit(0.0)}
    )
    of_early, of_full = similarities(early), similarities(full)
    return {
        name: history_score(late_train, early, of_early[name])
        .unionByName(first_train)
        .unionByName(history_score(rows.where(~own), full, of_full[name]))
        for name in of_full
    }


def two_phase_score(rows: DataFrame, train: DataFrame, label: str, similarity, day: str = "date") -> DataFrame:
    """``two_phase_scores`` for one similarity: distinct pairs -> ``(item_i, item_j, w)``."""
    return two_phase_scores(rows, train, label, lambda p: {"w": similarity(p)}, day)["w"]
