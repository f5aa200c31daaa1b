import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rankloom.operators import blend as B
from rankloom.operators import bootstrap as T
from rankloom.operators import metrics as M
from rankloom.operators.ordering import Skew
from rankloom.operators.ranks import rank01, zscore

SMALL = Skew(rows_per_task=5)


def test_rank_inside_user(spark):
    df = spark.createDataFrame(pd.DataFrame({"u": [0, 0, 0, 1, 1, 2], "x": [10, 30, 20, 0.1, 0.2, 5.0], "id": range(6)}))
    got = [r["rank01"] for r in rank01(df, ["u"], "x", ["id"]).orderBy("id").collect()]
    assert got == [0, 1, 0.5, 0, 1, 0]


def test_global_rank_is_argsort(spark):
    r = np.random.default_rng(1)
    x = r.integers(0, 9, 80).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"s": "valid", "x": x, "id": range(80)}))
    want = np.argsort(np.argsort(x, kind="stable"), kind="stable") / 79
    for skew in (SMALL, Skew()):
        got = [v["rank01"] for v in rank01(df, ["s"], "x", ["id"], skew=skew).orderBy("id").collect()]
        assert np.allclose(got, want)


def test_zscore_has_zero_mean_and_guards_flat_lists(spark):
    df = spark.createDataFrame(pd.DataFrame({"u": [1, 1, 1, 2, 2, 3], "x": [1.0, 2, 3, 10, 12, 7]}))
    z = zscore(df, ["u"], "x", "z").groupBy("u").agg(F.avg("z").alias("m")).collect()
    assert all(abs(r["m"]) < 1e-12 for r in z)


def scored(spark, n_users=30, seed=0):
    r = np.random.default_rng(seed)
    u = np.repeat(np.arange(n_users), 6)
    y = r.integers(0, 2, len(u))
    cols = {m: np.round((y * s + r.normal(size=len(u))).argsort().argsort() / (len(u) - 1), 9)
            for m, s in (("a", 0.2), ("b", 0.8), ("c", 0.5))}
    return spark.createDataFrame(pd.DataFrame({"user_id": u, "row_id": range(len(u)), "y": y, **cols}))


def primary(spark, pdf, s):
    df = spark.createDataFrame(pdf.assign(s=s, g="x"))
    return M.evaluate(df, ["g"], "user_id", "y", "s", ["row_id"]).first()["primary_score"]


def test_greedy_blend_never_loses_to_a_single_model(spark):
    df = scored(spark)
    mix, best, blend = B.greedy_blend(df, ["a", "b", "c"], "user_id", "y", weights=(0.25, 0.5))
    pdf = df.toPandas()
    singles = {m: primary(spark, pdf, pdf[m]) for m in "abc"}
    assert best >= max(singles.values())
    assert sum(mix.values()) == pytest.approx(1.0)
    got = blend.toPandas().sort_values("row_id").reset_index(drop=True)
    assert primary(spark, pdf, got["score"]) == pytest.approx(best)
    # first step by brute force: the best (model, weight) in scan order
    start = max(singles, key=singles.get)
    cur = singles[start]
    choice = None
    for m in "abc":
        for w in (0.25, 0.5):
            s = primary(spark, pdf, (1 - w) * pdf[start] + w * pdf[m])
            if s > cur + 1e-5:
                cur, choice = s, (m, w)
    assert (choice is None) == (len(mix) == 1 and best == singles[start])


def test_weight_sweep_ends_equal_the_models(spark):
    df = scored(spark).withColumn("split", F.lit("valid"))
    m = {(r["mode"], r["w"]): r["ndcg_at_10"] for r in B.weight_sweep(df, ["split"], "user_id", "y", "a", "b", ["row_id"]).collect()}
    assert len(m) == 14
    assert m[("raw", 1.0)] == pytest.approx(m[("a_only", 1.0)], abs=1e-12)
    heavy = {(r["mode"], r["w"]): r["ndcg_at_10"]
             for r in B.weight_sweep(df, ["split"], "user_id", "y", "a", "b", ["row_id"], skew=SMALL).collect()}
    assert heavy == pytest.approx(m, abs=1e-12)


def test_best_point_prefers_grid_order(spark):
    g = spark.createDataFrame([(1.0, 0.5), (2.0, 0.9), (3.0, 0.9)], "p double, m double")
    assert B.best_point(g, [], "m", ["p"]).first()["p"] == 2.0


def pieces(spark, copies=1):
    df = scored(spark, 20)
    parts = []
    for c in range(copies):
        for system, m in (("a", "a"), ("b", "b")):
            parts.append(df.select((F.col("user_id") + 1000 * c).alias("user_id"), "row_id", "y", F.col(m).alias("s"),
                                   F.lit(system).alias("system"), F.lit("test").alias("split")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return M.user_pieces(out, ["split", "system", "user_id"], "y", "s", ["row_id"])


def test_bootstrap_pieces_agree_with_evaluate_and_duplication(spark):
    def full(p):
        return {r["system"]: r["primary_score"] for r in p.groupBy("system").agg(*M.protocol_columns()).collect()}

    once, twice = full(pieces(spark)), full(pieces(spark, 2))
    for s in once:
        assert once[s] == pytest.approx(twice[s], abs=1e-12)


def test_bootstrap_draws_every_rep_n_users_and_pairs_systems(spark):
    rs = T.paired_resamples(pieces(spark), ["split"], "user_id", 5).collect()
    assert len(rs) == 10 and {r["users"] for r in rs} == {20}
    d = T.paired_deltas(T.paired_resamples(pieces(spark), ["split"], "user_id", 5), ["split"])
    s = T.summarise(d, ["split"]).collect()
    assert {r["metric"] for r in s} == set(T.METRICS)
    assert all(r["lo95"] <= r["mean"] <= r["hi95"] and r["reps"] == 5 for r in s)


def test_bootstrap_draws_are_those_of_plain_python(spark):
    """Both levels of draws, with blocks smaller than the users."""
    import hashlib

    p = pieces(spark)
    rows = {(r["system"], r["user_id"]): r for r in p.collect()}
    users = sorted({u for _, u in rows})
    n, block = len(users), 7
    u = lambda *parts: int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16) / 2**32
    got = {(r["rep"], r["system"]): r for r in T.paired_resamples(p, ["split"], "user_id", 4, block=block).collect()}
    for rep in range(4):
        hit = [int(u(rep, i) * n) // block for i in range(n)]
        drawn = [users[b * block + int(u(rep, b, j) * min(block, n - b * block))] for b in set(hit) for j in range(hit.count(b))]
        assert len(drawn) == n
        for s in ("a", "b"):
            mine = [rows[s, x] for x in drawn]
            mixed = [r for r in mine if 0 < r["npos"] < r["n"]]
            gauc = sum(r["npos"] * r["auc"] for r in mixed) / sum(r["npos"] for r in mixed)
            assert got[rep, s]["gauc"] == pytest.approx(gauc, abs=1e-12)
            assert got[rep, s]["ndcg_at_5"] == pytest.approx(sum(r["ndcg"] for r in mine) / n, abs=1e-12)
            assert got[rep, s]["row_count"] == sum(r["n"] for r in mine)


def test_greedy_blend_with_a_hot_user_takes_the_other_road(spark):
    """Two steps by brute force, and the same result when every user is too large for a task."""
    df = scored(spark)
    kinds = [B.greedy_blend(df, ["a", "b", "c"], "user_id", "y", weights=(0.25, 0.5), skew=s) for s in (B.DEFAULT_SKEW, B.Skew(rows_per_task=6))]
    assert kinds[0][0] == pytest.approx(kinds[1][0]) and kinds[0][1] == pytest.approx(kinds[1][1], abs=1e-12)
    pdf = df.toPandas()
    singles = {m: primary(spark, pdf, pdf[m]) for m in "abc"}
    start = max(singles, key=singles.get)
    cur, best, mix = pdf[start], singles[start], {start: 1.0}
    while True:
        chosen = None
        for m in "abc":
            for w in (0.25, 0.5):
                s = primary(spark, pdf, (1 - w) * cur + w * pdf[m])
                if s > best + 1e-5:
                    best, chosen = s, (m, w)
        if chosen is None:
            break
        m, w = chosen
        cur, mix = (1 - w) * cur + w * pdf[m], {k: v * (1 - w) for k, v in mix.items()}
        mix[m] = mix.get(m, 0.0) + w
    assert kinds[0][1] == pytest.approx(best, abs=1e-9) and kinds[0][0] == pytest.approx(mix)


def test_draws_made_in_tasks_are_those_of_the_columns(spark):
    """Numbers of every length hash alike in numpy and in Spark."""
    from rankloom.functions.hashing import hash32, hash32_numbers

    numbers = sorted({10**k + d for k in range(12) for d in (-1, 0, 7)})
    want = spark.createDataFrame([(a, b) for a in numbers for b in (0, 9, 10, 1999)], "a long, b long").withColumn("h", hash32("a", "b")).toPandas()
    assert (hash32_numbers(want["a"].to_numpy(), want["b"].to_numpy()) == want["h"].to_numpy()).all()
    assert (hash32_numbers(5, want["a"].to_numpy(), want["b"].to_numpy())[:2] == [r["h"] for r in spark.createDataFrame(
        [(5, 0, 0), (5, 0, 9)], "x long, a long, b long").select(hash32("x", "a", "b").alias("h")).collect()]).all()


def test_bootstrap_spreads_draws_over_tasks_and_spans(spark, monkeypatch):
    """Few bytes of users make many draws: both levels run in as many tasks as draws ask for, whatever their spans."""
    want = {tuple(r) for r in T.paired_resamples(pieces(spark), ["split"], "user_id", 5, block=3).collect()}
    for name, value in (("SPAN", 7), ("DRAWS_PER_TASK", 10), ("USERS_PER_GROUP", 6), ("_AT_ONCE", 4)):
        monkeypatch.setattr(T, name, value)
    cut = T.paired_resamples(pieces(spark), ["split"], "user_id", 5, block=3)
    got = {tuple(r) for r in cut.collect()}
    assert [r[:3] for r in sorted(got)] == [r[:3] for r in sorted(want)]
    for a, b in zip(sorted(got), sorted(want)):
        assert a[3:] == pytest.approx(b[3:], abs=1e-12)
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") >= 3  # not merged by the size of what they read
