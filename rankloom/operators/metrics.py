"""Within-user ranking metrics.

Two protocols share the per-user pieces computed here: the official one (every
user counts, no positive means nDCG 0) and the older click protocol (users
without a positive are skipped).  Labels are 0/1, so the gain 2^y - 1 is y.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.operators.ordering import DEFAULT_SKEW, Prefix, Skew, by_weight, ordered_prefix, segmented_prefix


def _discount(position: Column) -> Column:
    return F.lit(1.0) / F.log2(position + 1)


def _ideal(npos: Column, k: int) -> Column:
    """Ideal DCG of a 0/1 list with npos positives."""
    best = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(npos, F.lit(k)).cast("int"))), _discount)
    return F.when(npos > 0, F.aggregate(best, F.lit(0.0), lambda a, x: a + x)).otherwise(F.lit(0.0))


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def top_k(
    df: DataFrame, keys: Sequence[str], score: str, ties: Sequence[str], k: int, position: str = "position"
) -> DataFrame:
    """The k best rows by key; Spark trims each map task to k rows before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc(), *ties)
    return df.withColumn(position, F.row_number().over(w)).where(F.col(position) <= k)


def average_rank(df: DataFrame, keys: Sequence[str], score: str, skew: Skew = DEFAULT_SKEW) -> DataFrame:
    """``(keys, score)`` groups with ``n`` rows and their tied average rank ``avg_rank``."""
    groups = df.groupBy(*keys, score).agg(F.count(F.lit(1)).alias("n"))
    ranked = ordered_prefix(groups, keys, score, (), Prefix(sums={"_before": "n"}), skew)
    return ranked.withColumn("avg_rank", F.col("_before") + (F.col("n") + 1) / 2).drop("_before")


def user_pieces(
    df: DataFrame,
    keys: Sequence[str],
    label: str,
    score: str,
    ties: Sequence[str],
    k: int = 5,
    skew: Skew = DEFAULT_SKEW,
    probe: DataFrame | None = None,
) -> DataFrame:
    """One row per list: ``n, npos, auc`` (null for a single class) and ``ndcg``.

    ``keys`` is what identifies a list: the user plus the split, the model or
    the grid point.  Ordinary lists take one shuffle, in which the tie-corrected
    ranks and the top-k positions come from the same sort.  Heavy lists are
    aggregated by score before they move and are ranked in segments.
    """
    keys = list(keys)
    df = df.select(*dict.fromkeys([*keys, score, label, *ties]))
    y = F.col(label)

    def light(d: DataFrame) -> DataFrame:
        best_first = Window.partitionBy(*keys).orderBy(F.col(score).desc(), *ties)
        by_score = Window.partitionBy(*keys).orderBy(F.col(score).desc())
        peers = by_score.rangeBetween(Window.unboundedPreceding, Window.currentRow)
        d = d.withColumn("_at", F.row_number().over(best_first)).withColumns(
            {"_first": F.rank().over(by_score), "_last": F.count(F.lit(1)).over(peers)}
        )
        return d.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(y).cast("long").alias("npos"),
            F.sum(y * (F.col("_first") + F.col("_last")) / 2).alias("_ranks"),
            F.sum(F.when(F.col("_at") <= k, y * _discount(F.col("_at"))).otherwise(0.0)).alias("_dcg"),
        )

    def heavy(d: DataFrame) -> DataFrame:
        groups = (
            d.groupBy(*keys, score)
            .agg(F.count(F.lit(1)).alias("_n"), F.sum(y).alias("_pos"))
            .withColumn("_down", -F.col(score))
        )
        ranked = segmented_prefix(groups, keys, "_down", (), [Prefix(sums={"_before": "_n"})], skew)
        ranks = ranked.groupBy(*keys).agg(
            F.sum("_n").alias("n"),
            F.sum("_pos").cast("long").alias("npos"),
            F.sum(F.col("_pos") * (F.col("_before") + (F.col("_n") + 1) / 2)).alias("_ranks"),
        )
        dcg = (
            top_k(d, keys, score, ties, k, "_at")
            .groupBy(*keys)
            .agg(F.sum(y * _discount(F.col("_at"))).alias("_dcg"))
        )
        return ranks.join(dcg, keys)

    n, npos = F.col("n"), F.col("npos")
    # ranks were counted from the best score down; Mann-Whitney wants them from the worst up
    u = npos * (n + 1) - F.col("_ranks") - npos * (npos + 1) / 2
    return by_weight(df, keys, light, heavy, skew, probe).select(
        *keys,
        "n",
        "npos",
        F.when((npos > 0) & (npos < n), u / (npos * (n - npos))).alias("auc"),
        _ratio(F.col("_dcg"), _ideal(npos, k)).alias("ndcg"),
    )


def protocol_columns(weight: Column | None = None, k: int = 5) -> list[Column]:
    """Aggregates turning per-list pieces into GAUC, nDCG, primary, users, rows.

    ``weight`` counts how often a list was drawn (bootstrap); default once.
    """
    m = F.lit(1) if weight is None else weight
    mixed = F.col("auc").isNotNull()
    den = F.sum(F.when(mixed, m * F.col("npos")))
    gauc = F.coalesce(F.sum(F.when(mixed, m * F.col("npos") * F.col("auc"))) / den, F.lit(0.5))
    ndcg = F.sum(m * F.col("ndcg")) / F.sum(m)
    return [
        gauc.alias("gauc"),
        ndcg.alias(f"ndcg_at_{k}"),
        ((gauc + ndcg) / 2).alias("primary_score"),
        F.sum(m).cast("long").alias("users"),
        F.sum(m * F.col("n")).cast("long").alias("row_count"),
    ]


def evaluate(
    df: DataFrame,
    by: Sequence[str],
    user: str,
    label: str,
    score: str,
    ties: Sequence[str],
    k: int = 5,
    skew: Skew = DEFAULT_SKEW,
    probe: DataFrame | None = None,
) -> DataFrame:
    """The official protocol, one row per combination of ``by``.

    ``probe`` is a cheaper table with the lists' keys and sizes (see ``by_weight``).
    """
    pieces = user_pieces(df, [*by, user], label, score, ties, k, skew, probe)
    return pieces.groupBy(*by).agg(*protocol_columns(k=k))


def fast_evaluate(
    df: DataFrame,
    by: Sequence[str],
    user: str,
    label: str,
    score: str,
    ties: Sequence[str],
    k: int = 5,
    skew: Skew = DEFAULT_SKEW,
    probe: DataFrame | None = None,
) -> DataFrame:
    """Same protocol with ranks broken by row order instead of averaged."""
    keys = [*by, user]
    y = F.col(label)
    up = ordered_prefix(df, keys, score, ties, Prefix(number="_rank"), skew, probe).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(y).cast("long").alias("npos"),
        F.sum(y * F.col("_rank")).alias("_ranks"),
    )
    dcg = top_k(df, keys, score, ties, k, "_at").groupBy(*keys).agg(
        F.sum(y * _discount(F.col("_at"))).alias("_dcg")
    )
    n, npos = F.col("n"), F.col("npos")
    u = F.col("_ranks") - npos * (npos + 1) / 2
    pieces = up.join(dcg, keys).select(
        *keys,
        "n",
        "npos",
        F.when((npos > 0) & (npos < n), u / (npos * (n - npos))).alias("auc"),
        _ratio(F.col("_dcg"), _ideal(npos, k)).alias("ndcg"),
    )
    return pieces.groupBy(*by).agg(*protocol_columns(k=k))


def _click_shares(d: DataFrame, k: int, k_small: int, k_recall: int) -> DataFrame:
    npos = F.col("npos")
    return d.withColumns(
        {
            "ndcg": _ratio(F.col("_dcg"), _ideal(npos, k)),
            "ndcg_small": _ratio(F.col("_dcg_small"), _ideal(npos, k_small)),
            "recall": _ratio(F.col("_hits"), npos),
        }
    ).drop("_dcg", "_dcg_small", "_hits")


def _click_sums(label: str, k: int, k_small: int, k_recall: int) -> list[Column]:
    y, at = F.col(label), F.col("_at")
    return [
        F.sum(F.when(at <= k, y * _discount(at)).otherwise(0.0)).alias("_dcg"),
        F.sum(F.when(at <= k_small, y * _discount(at)).otherwise(0.0)).alias("_dcg_small"),
        F.sum(F.when(at <= k_recall, y).otherwise(0)).alias("_hits"),
    ]


def _list_sizes(label: str) -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), F.sum(label).cast("long").alias("npos")]


def click_windowed(
    d: DataFrame, keys: Sequence[str], label: str, score: str, ties: Sequence[str], k: int = 10, k_small: int = 5,
    k_recall: int = 50,
) -> DataFrame:
    """Click pieces of ordinary lists: one shuffle for positions and sums."""
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc(), *ties)
    d = d.withColumn("_at", F.row_number().over(w))
    sums = d.groupBy(*keys).agg(*_list_sizes(label), *_click_sums(label, k, k_small, k_recall))
    return _click_shares(sums, k, k_small, k_recall)


def click_trimmed(
    d: DataFrame, keys: Sequence[str], label: str, score: str, ties: Sequence[str], k: int = 10, k_small: int = 5,
    k_recall: int = 50,
) -> DataFrame:
    """Click pieces of heavy lists: sizes and tops are reduced before they move."""
    sizes = d.groupBy(*keys).agg(*_list_sizes(label))
    best = top_k(d, keys, score, ties, max(k, k_small, k_recall), "_at")
    sums = best.groupBy(*keys).agg(*_click_sums(label, k, k_small, k_recall))
    return _click_shares(sizes.join(sums, list(keys)), k, k_small, k_recall)


def click_pieces(
    df: DataFrame,
    keys: Sequence[str],
    label: str,
    score: str,
    ties: Sequence[str],
    k: int = 10,
    k_small: int = 5,
    k_recall: int = 50,
    skew: Skew = DEFAULT_SKEW,
    probe: DataFrame | None = None,
) -> DataFrame:
    """Per-list ``n, npos, ndcg, ndcg_small, recall`` of the click protocol."""
    keys = list(keys)
    args = (keys, label, score, ties, k, k_small, k_recall)
    slim = df.select(*dict.fromkeys([*keys, score, label, *ties]))
    return by_weight(
        slim, keys, lambda d: click_windowed(d, *args), lambda d: click_trimmed(d, *args), skew, probe
    )


def click_metrics(
    df: DataFrame, by: Sequence[str], user: str, label: str, score: str, ties: Sequence[str],
    skew: Skew = DEFAULT_SKEW, probe: DataFrame | None = None,
) -> DataFrame:
    """nDCG@10, nDCG@5, recall@50 over users with a positive, and their mix."""
    pieces = click_pieces(df, [*by, user], label, score, ties, skew=skew, probe=probe)
    return pieces.groupBy(*by).agg(*click_columns())


def click_columns() -> list[Column]:
    scored = F.col("npos") > 0
    ndcg = F.coalesce(F.avg(F.when(scored, F.col("ndcg"))), F.lit(0.0))
    small = F.coalesce(F.avg(F.when(scored, F.col("ndcg_small"))), F.lit(0.0))
    recall = F.coalesce(F.avg(F.when(scored, F.col("recall"))), F.lit(0.0))
    return [
        ndcg.alias("ndcg_at_10"),
        small.alias("ndcg_at_5"),
        recall.alias("recall_at_50"),
        (0.5 * ndcg + 0.5 * recall).alias("score"),
        F.count(F.lit(1)).alias("users"),
        F.count(F.when(scored, 1)).alias("scored_users"),
    ]


def global_auc(
    df: DataFrame, by: Sequence[str], label: str, score: str, skew: Skew = DEFAULT_SKEW
) -> DataFrame:
    """AUC over all rows of each ``by`` combination, tied scores at their average rank."""
    groups = df.groupBy(*by, score).agg(F.count(F.lit(1)).alias("_n"), F.sum(label).alias("_pos"))
    ranked = ordered_prefix(groups, by, score, (), Prefix(sums={"_before": "_n"}), skew)
    n, npos = F.sum("_n"), F.sum("_pos")
    ranks = F.sum(F.col("_pos") * (F.col("_before") + (F.col("_n") + 1) / 2))
    auc = F.when((npos > 0) & (npos < n), (ranks - npos * (npos + 1) / 2) / (npos * (n - npos)))
    return ranked.groupBy(*by).agg(
        n.alias("row_count"), npos.cast("long").alias("positives"), auc.alias("auc")
    )


def list_profile(df: DataFrame, by: Sequence[str], user: str, skew: Skew = DEFAULT_SKEW) -> DataFrame:
    """Sizes of the impression lists: users, rows, p50, p90, max, share up to 10 and 50."""
    from rankloom.operators.ordering import exact_quantiles

    sizes = df.groupBy(*by, user).agg(F.count(F.lit(1)).alias("size"))
    q = exact_quantiles(sizes, by, "size", [0.5, 0.9], skew)
    flat = sizes.groupBy(*by).agg(
        F.count(F.lit(1)).alias("users"),
        F.sum("size").cast("long").alias("row_count"),
        F.max("size").alias("list_len_max"),
        F.avg((F.col("size") <= 10).cast("double")).alias("frac_le_10"),
        F.avg((F.col("size") <= 50).cast("double")).alias("frac_le_50"),
    )
    return flat.join(q, list(by)).select(
        *by, "users", "row_count",
        F.col("quantiles")[0].alias("list_len_p50"), F.col("quantiles")[1].alias("list_len_p90"),
        "list_len_max", "frac_le_10", "frac_le_50",
    )


def label_composition(df: DataFrame, by: Sequence[str], user: str, label: str) -> DataFrame:
    """Rows, users, positive rate, and users whose list is all negative or all positive."""
    per_user = df.groupBy(*by, user).agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("npos"))
    none, every = F.col("npos") == 0, F.col("npos") == F.col("n")
    return per_user.groupBy(*by).agg(
        F.sum("n").cast("long").alias("row_count"),
        F.count(F.lit(1)).alias("users"),
        (F.sum("npos") / F.sum("n")).alias("positive_rate"),
        F.count(F.when(none, 1)).alias("users_no_positive"),
        F.avg(none.cast("double")).alias("share_no_positive"),
        F.count(F.when(every, 1)).alias("users_all_positive"),
        F.avg(every.cast("double")).alias("share_all_positive"),
    )


def metric_delta(metrics: DataFrame, baseline: DataFrame, by: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Long table of each metric, its baseline and the difference."""
    def long(df: DataFrame, value: str) -> DataFrame:
        return df.select(
            *by, F.explode(F.create_map(*[x for c in names for x in (F.lit(c), F.coalesce(F.col(c), F.lit(0.0)))]))
            .alias("metric", value)
        )

    return long(metrics, "value").join(long(baseline, "baseline"), [*by, "metric"], "left").select(
        *by, "metric", "value", F.coalesce("baseline", F.lit(0.0)).alias("baseline"),
        (F.col("value") - F.coalesce("baseline", F.lit(0.0))).alias("delta"),
    )


def range_position(primary: Column, low: Column, high: Column) -> Column:
    """Where a score lies between the random and the label-perfect reference."""
    return (primary - low) / (high - low)
