"""Blends of scored models in rank space, and the searches over their weights.

Scores travel in long form ``(split, user, row_id, label, model, score)``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.operators.metrics import click_columns, click_trimmed, click_windowed, evaluate, protocol_columns, user_pieces
from rankloom.operators.ordering import DEFAULT_SKEW, Skew, by_weight
from rankloom.operators.ranks import rank01, zscores
from rankloom.session import checkpoint_dir

# The greedy search's weight grid and gain threshold, the blend
# weights swept on validation, and the two re-rank coefficient grids.
GREEDY_WEIGHTS = [round(0.05 * i, 2) for i in range(1, 20)]
GREEDY_GAIN = 1e-5
SWEEP_WEIGHTS = (0.5, 0.6, 0.7, 0.8, 0.9, 1.0)
TIME_COEFS = [round(-0.5 + 0.1 * i, 1) for i in range(11)]
POP_COEFS = [round(-0.2 + 0.05 * i, 2) for i in range(9)]


def weighted(a: Column, b: Column, w: Column) -> Column:
    return w * a + (1 - w) * b


def rank_average(scores: DataFrame, keys: Sequence[str], ranked: str = "rank01", out: str = "score") -> DataFrame:
    """Equal-weight mean of the ranks a row has in the models."""
    return scores.groupBy(*keys).agg(F.avg(ranked).alias(out))


def rank_blend(
    scores: DataFrame, keys: Sequence[str], weights: Mapping[str, float], ranked: str = "rank01", out: str = "score"
) -> DataFrame:
    """Weighted mean of ranks, weights normalised by their sum."""
    w = F.element_at(F.create_map(*[F.lit(x) for m, v in weights.items() for x in (m, float(v))]), F.col("model"))
    used = scores.where(F.col("model").isin(list(weights)))
    return used.groupBy(*keys).agg((F.sum(w * F.col(ranked)) / F.lit(float(sum(weights.values())))).alias(out))


def grid_click_metrics(
    df: DataFrame,
    by: Sequence[str],
    user: str,
    label: str,
    grid: Column,
    score: Column,
    ties: Sequence[str],
    skew: Skew = DEFAULT_SKEW,
    probe: DataFrame | None = None,
) -> DataFrame:
    """Click metrics of every point of a parameter grid, one row per ``by`` and ``g``.

    ``grid`` is an array of structs, ``score`` reads its fields as ``g.*``.  Rows
    are spread by user before they are multiplied by the grid, so the shuffle
    carries each row once; a heavy user's rows stay where they are and are cut
    to the top of the list per grid point before they move.
    """
    keys = [*by, user, "g"]
    cols = list(dict.fromkeys([*by, user, label, *ties]))

    def points(d: DataFrame) -> DataFrame:
        scored = d.withColumn("g", F.explode(grid)).withColumn("_score", score)
        return scored.select(*cols, "g", "_score")

    # a row stands for as many as the grid has points
    points_per_row = max(1, df.sparkSession.range(1).select(F.size(grid)).first()[0])
    if skew is not None:
        skew = Skew(max(1, skew.rows_per_task // points_per_row))
    pieces = by_weight(
        df,
        [*by, user],
        lambda d: click_windowed(points(d.repartition(*by, user)), keys, label, "_score", ties),
        lambda d: click_trimmed(points(d), keys, label, "_score", ties),
        skew,
        probe,
    )
    return pieces.groupBy(*by, "g").agg(*click_columns())


def weight_sweep(
    df: DataFrame, by: Sequence[str], user: str, label: str, a: str, b: str, ties: Sequence[str],
    skew: Skew = DEFAULT_SKEW, probe: DataFrame | None = None,
) -> DataFrame:
    """Click metrics of ``w a + (1 - w) b`` on raw and per-user z scores, plus both pure ends."""
    z = zscores(df, [*by, user], {"_za": a, "_zb": b})
    points = [("user_z", w) for w in SWEEP_WEIGHTS] + [("raw", w) for w in SWEEP_WEIGHTS]
    points += [(f"{a}_only", 1.0), (f"{b}_only", 0.0)]
    grid = F.array(*[F.struct(F.lit(m).alias("mode"), F.lit(float(w)).alias("w")) for m, w in points])
    w = F.col("g.w")
    score = F.when(F.col("g.mode") == "user_z", weighted(F.col("_za"), F.col("_zb"), w)).otherwise(
        weighted(F.col(a), F.col(b), w)
    )
    m = grid_click_metrics(z, by, user, label, grid, score, ties, skew, df if probe is None else probe)
    return m.select(*by, "g.mode", "g.w", *[c for c in m.columns if c not in (*by, "g")])


def rerank_grid(
    df: DataFrame, by: Sequence[str], user: str, label: str, base: str, pop: str, time_rank: str,
    ties: Sequence[str], skew: Skew = DEFAULT_SKEW, probe: DataFrame | None = None,
) -> DataFrame:
    """Click metrics of ``base_z + a time_z + b pop_z`` over the two coefficient grids."""
    z = zscores(df, [*by, user], {"_zb": base, "_zp": pop, "_zt": time_rank})
    grid = F.array(*[
        F.struct(F.lit(a).alias("time_coef"), F.lit(b).alias("pop_coef")) for a in TIME_COEFS for b in POP_COEFS
    ])
    score = F.col("_zb") + F.col("g.time_coef") * F.col("_zt") + F.col("g.pop_coef") * F.col("_zp")
    m = grid_click_metrics(z, by, user, label, grid, score, ties, skew, df if probe is None else probe)
    return m.select(*by, "g.time_coef", "g.pop_coef", *[c for c in m.columns if c not in (*by, "g")])


def best_point(grid: DataFrame, by: Sequence[str], metric: str, order: Sequence[str]) -> DataFrame:
    """The best grid point; the first in grid order wins ties."""
    key = F.struct(F.col(metric), *[-F.col(c) for c in order])
    best = F.max_by(F.struct(*[c for c in grid.columns if c not in by]), key)
    return grid.groupBy(*by).agg(best.alias("_b")).select(*by, "_b.*") if by else grid.agg(best.alias("_b")).select("_b.*")


def leaderboard(
    scores: DataFrame, user: str, label: str, score: str, ties: Sequence[str], by: Sequence[str] = ("model",)
) -> DataFrame:
    """Protocol of every model."""
    return evaluate(scores, list(by), user, label, score, ties)


def greedy_blend(
    ranks: DataFrame,
    models: Sequence[str],
    user: str,
    label: str,
    row_id: str = "row_id",
    weights: Sequence[float] = tuple(GREEDY_WEIGHTS),
    gain: float = GREEDY_GAIN,
    skew: Skew = DEFAULT_SKEW,
) -> tuple[dict[str, float], float, DataFrame]:
    """Greedy forward selection over rank columns, one column per model.

    Each step scores every (model, weight) candidate in one plan and brings
    back one number per candidate.  Scan order is models, then weights, and a
    candidate replaces the best so far only by more than ``gain``.  Users whose
    list times the candidates fits a task are spread by user and multiplied
    there; the lists of the others are dealt out per candidate and ranked in
    segments, so a user with a third of the log is nobody's single task.
    """
    checkpoint_dir(ranks.sparkSession)
    cols = [user, row_id, label, *models]

    def scores_of(df: DataFrame, candidates: list[tuple[str, float]]) -> list[float]:
        """Primary metric per candidate, rows spread by user before they multiply."""
        cand = F.array(*[
            F.struct(
                F.lit(i).alias("c"),
                ((1 - F.lit(float(w))) * F.col("_cur") + F.lit(float(w)) * F.col(m)).alias("_s"),
            )
            for i, (m, w) in enumerate(candidates)
        ])

        def pieces(d: DataFrame, how: Skew | None) -> DataFrame:
            long = d.select(user, row_id, label, F.explode(cand).alias("_x")).select(user, row_id, label, "_x.c", "_x._s")
            return user_pieces(long, ["c", user], label, "_s", [row_id], skew=how)

        per_user = Skew(max(1, skew.rows_per_task // len(candidates)))
        both = by_weight(df, [user], lambda d: pieces(d.repartition(user), None), lambda d: pieces(d, skew), per_user)
        got = both.groupBy("c").agg(*protocol_columns()).select("c", "primary_score").collect()
        return [v for _, v in sorted((r["c"], r["primary_score"]) for r in got)]

    base = ranks.select(*cols).withColumn("_cur", F.lit(0.0)).checkpoint()
    singles = scores_of(base, [(m, 1.0) for m in models])
    best = max(range(len(models)), key=lambda i: singles[i])
    mix, current = {models[best]: 1.0}, singles[best]
    df = base.withColumn("_cur", F.col(models[best]))
    grid = [(m, w) for m in models for w in weights]
    while True:  # every step gains more than ``gain`` on a bounded metric
        chosen = None
        for (m, w), s in zip(grid, scores_of(df, grid)):
            if s > current + gain:
                current, chosen = s, (m, w)
        if chosen is None:
            break
        m, w = chosen
        df = df.withColumn("_cur", (1 - F.lit(w)) * F.col("_cur") + F.lit(w) * F.col(m)).checkpoint()
        mix = {k: v * (1 - w) for k, v in mix.items()}
        mix[m] = mix.get(m, 0.0) + w
    return mix, current, df.select(user, row_id, label, F.col("_cur").alias("score"))


def ranked_models(scores: DataFrame, within_user: bool = False, user: str = "user_id") -> DataFrame:
    """Rank transform of every (split, model), over the split or inside each user's list."""
    keys = ["split", "model", user] if within_user else ["split", "model"]
    return rank01(scores, keys, "score", ["row_id"])
