"""Experiment records: compiled iterations, outcome tags, running best, stop rule."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.operators.ordering import Prefix, ordered_prefix

# Outcome words searched for in a record's text.
OUTCOME_TAGS = ["ERROR", "RECOVERY", "CONFIRMED", "NEGATIVE", "NEUTRAL", "DECLINED", "ABANDONED"]

METRIC_STRUCT = "struct<GAUC:double,`nDCG@5`:double,primary:double,users:bigint,rows:bigint>"
RUN_SCHEMA = (
    f"name string, features string, objective string, best_iter bigint, valid {METRIC_STRUCT}, "
    f"test {METRIC_STRUCT}, params map<string,string>, wall_seconds double"
)
ATTEMPT_SCHEMA = (
    "iter bigint, id string, role string, hypothesis string, why string, model string, "
    "metrics map<string,double>, delta_vs_baseline map<string,double>, error string, recovery string, "
    "human_interventions bigint, gpu_hours double, cpu_wall_seconds double, device string, ts string"
)


def compile_iterations(plan: DataFrame, runs: DataFrame) -> DataFrame:
    """One row per planned iteration: its best run, total wall time, missing runs.

    ``plan`` is ``(iter, hypothesis, name)`` and may carry ``no``, the place of a run in it; ``runs`` has ``name,
    primary, wall_seconds``.  Of equally good runs the first in the plan wins (by name where there is no ``no``).
    """
    if "no" not in plan.columns:
        order = Window.partitionBy("iter").orderBy("name")
        plan = plan.withColumn("no", F.row_number().over(order))
    j = plan.join(runs, "name", "left")
    return j.groupBy("iter", "hypothesis").agg(
        F.max_by("name", F.struct("primary", -F.col("no"))).alias("best_run"),
        F.max("primary").alias("primary"),
        F.round(F.sum("wall_seconds"), 1).alias("wall_seconds_total"),
        F.count(F.lit(1)).alias("sub_runs"),
        F.count(F.when(F.col("primary").isNull(), 1)).alias("missing"),
    )


def outcome(*texts: Column | str) -> Column:
    """Outcome words found in the texts, in fixed order, joined by ' / '."""
    parts = [F.coalesce(F.col(t) if isinstance(t, str) else t, F.lit("")) for t in texts]
    text = F.upper(F.concat_ws(" ", *parts))
    tags = F.array(*[F.lit(t) for t in OUTCOME_TAGS])
    return F.array_join(F.filter(tags, lambda t: F.contains(text, t)), " / ")


def primary_of(*candidates: Column) -> Column:
    """First metric present along a fallback chain."""
    return F.coalesce(*candidates)


def running_best(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Best value of earlier rows and the difference to it; null on the first row."""
    # an experiment series is as long as the number of iterations run
    with_prev = ordered_prefix(df, keys, order, (), [
        Prefix(maxes={"_upto": value}),
        Prefix(previous={"best_before": "_upto"}),
    ], skew=None)
    return with_prev.withColumn("delta", F.col(value) - F.col("best_before")).drop("_upto")


def run_log(plan: DataFrame, runs: DataFrame, records: DataFrame, series: str | None = None) -> DataFrame:
    """The log of an experiment, one row per planned iteration, in one table.

    ``plan`` and ``runs`` are those of ``compile_iterations``; ``records`` holds
    ``name`` and any of ``hypothesis_text, note, error, recovery``.  A run's metric
    is ``primary``, else ``valid_primary``, else ``test_primary``, of those its
    table has.  Columns: iter, hypothesis, best_run, primary, best_before, delta,
    is_best, sub_runs, missing, wall_seconds_total, outcome.  ``series`` names a
    column of ``plan`` that tells several experiments apart.
    """
    metrics = [c for c in ("primary", "valid_primary", "test_primary") if c in runs.columns]
    known = runs.select("name", "wall_seconds", primary_of(*[F.col(c) for c in metrics]).alias("primary"))
    keys = [series] if series else []
    base = plan if series else plan.withColumn("_series", F.lit("all"))
    own = base.select("iter", *(keys or ["_series"])).distinct()
    compiled = compile_iterations(plan.drop(*keys), known).join(own, "iter")
    texts = [c for c in ("hypothesis_text", "note", "error", "recovery") if c in records.columns]
    tagged = records.select(F.col("name").alias("best_run"), outcome(*texts).alias("outcome"))
    ranked = running_best(compiled, keys or ["_series"], "iter", "primary")
    out = ranked.join(tagged, "best_run", "left").withColumn("is_best", F.coalesce(F.col("primary") > F.coalesce("best_before", F.lit(float("-inf"))), F.lit(False)))
    return out.select(
        *keys, "iter", "hypothesis", "best_run", "primary", "best_before", "delta", "is_best", "sub_runs", "missing", "wall_seconds_total",
        F.coalesce("outcome", F.lit("")).alias("outcome"),
    )


def converged(
    df: DataFrame, keys: Sequence[str], order: str, value: str, eps: float, window: int, floor: int = 0
) -> DataFrame:
    """Windowed stop rule: best of the last ``window`` minus best before <= eps.

    ``df`` has one row per counted iteration; ``stop`` is set from iteration
    ``max(floor, window + 1)`` on.  Keys are experiment series, whose length is
    the number of iterations run.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    recent = F.max(value).over(w.rowsBetween(-(window - 1), Window.currentRow))
    before = F.max(value).over(w.rowsBetween(Window.unboundedPreceding, -window))
    n = F.row_number().over(w)
    stop = before.isNotNull() & (recent - before <= eps) & (n >= F.greatest(F.lit(floor), F.lit(window + 1)))
    return df.withColumns({"n": n, "recent": recent, "before": before, "stop": stop})


def stale_runs(df: DataFrame, keys: Sequence[str], order: str, value: str, eps: float) -> DataFrame:
    """Iterations since the last gain above ``eps`` over the best before (gaps and islands)."""
    best = running_best(df, keys, order, value)
    gain = F.col("best_before").isNull() | (F.col(value) > F.col("best_before") + eps)
    w = Window.partitionBy(*keys).orderBy(order)
    marked = best.withColumn("_at", F.row_number().over(w)).withColumn("_gain", F.when(gain, F.col("_at")))
    return marked.withColumn("stale", F.col("_at") - F.max("_gain").over(w)).drop("_at", "_gain")
