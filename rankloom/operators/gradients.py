"""Ranking objectives: per-row gradients and Hessians for boosting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions.hashing import uniform
from rankloom.operators.ordering import DEFAULT_SKEW, Prefix, Skew, ordered_prefix


def lambda_gradients(
    df: DataFrame,
    keys: Sequence[str],
    label: str,
    score: str,
    ties: Sequence[str],
    truncation: int = 30,
    normalise: bool = True,
    skew: Skew = DEFAULT_SKEW,
) -> DataFrame:
    """``keys, ties, lambda, hessian`` of the truncated pairwise nDCG objective.

    A pair counts when its labels differ and its better-placed row is among the
    first ``truncation``.  Every row therefore meets at most ``truncation``
    partners: the list's head travels once per row as a bounded array, and the
    pair terms are summed per row with map-side combine.
    """
    keys, ties = list(keys), list(ties)
    placed = ordered_prefix(
        df.select(*dict.fromkeys([*keys, *ties, label, score])).withColumn("_down", -F.col(score)),
        keys, "_down", ties, Prefix(number="_at"), skew,
    )
    y, s = F.col(label), F.col(score)
    totals = placed.groupBy(*keys).agg(
        F.sum(y).alias("_npos"), F.max(s).alias("_best"), F.min(s).alias("_worst"),
        # at most `truncation` entries
        F.collect_list(
            F.when(F.col("_at") <= truncation, F.struct("_at", y.alias("y"), s.alias("s"), F.struct(*ties).alias("id")))
        ).alias("_head"),
    )
    ideal = F.aggregate(
        F.transform(
            F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.col("_npos"), F.lit(truncation)).cast("int"))),
            lambda r: 1 / F.log2(r + 1),
        ),
        F.lit(0.0), lambda a, x: a + x,
    )
    totals = totals.withColumn("_inv", F.when(F.col("_npos") > 0, 1 / ideal).otherwise(0.0))
    pairs = (
        placed.join(totals, keys)
        .withColumn("_h", F.explode("_head"))
        .where((F.col("_h._at") < F.col("_at")) & (F.col("_h.y") != y))
    )
    # the head row is the better-placed one; which side is relevant decides the signs
    head_up = F.col("_h.y") > y
    ds = F.when(head_up, F.col("_h.s") - s).otherwise(s - F.col("_h.s"))
    delta = F.abs(1 / F.log2(F.col("_h._at") + 1) - 1 / F.log2(F.col("_at") + 1)) * F.col("_inv")
    if normalise:
        delta = F.when(F.col("_best") != F.col("_worst"), delta / (0.01 + F.abs(ds))).otherwise(delta)
    p = 1 / (1 + F.exp(ds))
    pairs = pairs.withColumns({"_l": p * delta, "_w": p * (1 - p) * delta, "_sign": F.when(head_up, 1).otherwise(-1)})
    sides = F.array(
        F.struct(F.col("_h.id").alias("id"), (-F.col("_l") * F.col("_sign")).alias("g")),
        F.struct(F.struct(*ties).alias("id"), (F.col("_l") * F.col("_sign")).alias("g")),
    )
    terms = pairs.select(*keys, "_l", "_w", F.explode(sides).alias("_e"))
    grads = terms.groupBy(*keys, *[F.col(f"_e.id.{t}").alias(t) for t in ties]).agg(
        F.sum("_e.g").alias("_g"), F.sum("_w").alias("_hs")
    )
    out = df.select(*dict.fromkeys([*keys, *ties])).join(grads, list(dict.fromkeys([*keys, *ties])), "left")
    if normalise:
        mass = pairs.groupBy(*keys).agg((2 * F.sum("_l")).alias("_mass"))
        out = out.join(mass, keys, "left")
        scale = F.when(F.col("_mass") > 0, F.log2(1 + F.col("_mass")) / F.col("_mass")).otherwise(1.0)
    else:
        scale = F.lit(1.0)
    return out.select(
        *dict.fromkeys([*keys, *ties]),
        F.coalesce(F.col("_g") * scale, F.lit(0.0)).alias("lambda"),
        F.coalesce(F.col("_hs") * scale, F.lit(0.0)).alias("hessian"),
    )


def xendcg_gradients(
    df: DataFrame, keys: Sequence[str], label: str, score: str, row_id: str = "row_id", seed: int = 0
) -> DataFrame:
    """``keys, row_id, lambda, hessian`` of the listwise cross-entropy objective.

    Lists enter only through sums, so each is an aggregate joined back by key:
    softmax mass, target mass, and the two correction sums.
    """
    keys = list(keys)
    base = df.select(*keys, row_id, label, score)
    base = base.withColumn("_phi", F.pow(F.lit(2.0), F.col(label)) - uniform(seed, row_id))
    first = base.groupBy(*keys).agg(F.max(score).alias("_max"), F.sum("_phi").alias("_target"), F.count(F.lit(1)).alias("_n"))
    d = base.join(first, keys).withColumn("_e", F.exp(F.col(score) - F.col("_max")))
    d = d.join(d.groupBy(*keys).agg(F.sum("_e").alias("_z")), keys)
    rho = F.col("_e") / F.col("_z")
    d = d.withColumn("_rho", rho).withColumn("_t1", F.col("_rho") - F.col("_phi") / F.col("_target"))
    d = d.withColumn("_q", F.when(F.col("_n") > 1, 1 / (1 - F.col("_rho"))))
    d = d.withColumn("_p1", F.col("_t1") * F.col("_q"))
    sums = d.groupBy(*keys).agg(
        F.sum("_p1").alias("_s1"),
        F.sum(F.col("_rho") * F.col("_q")).alias("_sq"),
        F.sum(F.col("_rho") * F.col("_p1") * F.col("_q")).alias("_sp"),
    )
    d = d.join(sums, keys)
    # second-order sum over the list: sum rho (s1 - p1) / (1 - rho)
    s2 = F.col("_s1") * F.col("_sq") - F.col("_sp")
    t2 = F.col("_rho") * (F.col("_s1") - F.col("_p1"))
    t3 = F.col("_rho") * (s2 - t2 * F.col("_q"))
    single = F.col("_n") <= 1
    return d.select(
        *keys,
        row_id,
        F.when(single, 0.0).otherwise(F.col("_t1") + t2 + t3).alias("lambda"),
        F.when(single, 0.0).otherwise(F.col("_rho") * (1 - F.col("_rho"))).alias("hessian"),
    )
