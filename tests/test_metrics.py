import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rankloom.operators import metrics as M
from rankloom.operators.ordering import Skew

SMALL = Skew(rows_per_task=6)


def frame(spark, users, y, s):
    return spark.createDataFrame(
        pd.DataFrame({"u": users, "y": y, "s": np.asarray(s, float), "id": range(len(users)), "g": "all"})
    )


def brute(pdf, k=5):
    """The protocol by pair counting."""
    num = den = 0.0
    nd = []
    for _, d in pdf.groupby("u"):
        pos, neg = d[d.y == 1].s, d[d.y == 0].s
        if len(pos) and len(neg):
            wins = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg)
            num += len(pos) * wins / (len(pos) * len(neg))
            den += len(pos)
        top = d.sort_values(["s", "id"], ascending=[False, True]).y.to_list()[:k]
        ideal = sorted(d.y, reverse=True)[:k]
        gain = lambda ls: sum(v / math.log2(i + 2) for i, v in enumerate(ls))
        nd.append(gain(top) / gain(ideal) if gain(ideal) else 0.0)
    gauc = num / den if den else 0.5
    return gauc, float(np.mean(nd))


def lists(seed, ties):
    r = np.random.default_rng(seed)
    users = np.concatenate([np.repeat(u, r.integers(1, 12)) for u in range(25)] + [np.repeat(99, 150)])
    s = r.integers(0, 3, len(users)) if ties else r.permutation(len(users))
    return users, r.integers(0, 2, len(users)), s


@pytest.mark.parametrize("ties", [False, True])
@pytest.mark.parametrize("skew", [SMALL, Skew()])
def test_protocol_matches_pair_counting(spark, ties, skew):
    df = frame(spark, *lists(3, ties))
    r = M.evaluate(df, ["g"], "u", "y", "s", ["id"], skew=skew).first()
    gauc, ndcg = brute(df.toPandas())
    assert r["gauc"] == pytest.approx(gauc, abs=1e-12)
    assert r["ndcg_at_5"] == pytest.approx(ndcg, abs=1e-12)
    assert r["users"] == 26 and r["row_count"] == df.count()


def test_fast_equals_full_without_ties(spark):
    df = frame(spark, *lists(5, False))
    a = M.evaluate(df, ["g"], "u", "y", "s", ["id"]).first()
    b = M.fast_evaluate(df, ["g"], "u", "y", "s", ["id"], skew=SMALL).first()
    for c in ("gauc", "ndcg_at_5", "primary_score"):
        assert a[c] == pytest.approx(b[c], abs=1e-9)


def test_edge_lists(spark):
    df = frame(spark, [0, 0, 0, 1, 1, 2, 2], [0, 0, 0, 1, 0, 1, 1], [0.9, 0.5, 0.1, 0.8, 0.2, 0.7, 0.3])
    r = M.evaluate(df, ["g"], "u", "y", "s", ["id"]).first()
    assert r["gauc"] == 1.0 and r["ndcg_at_5"] == pytest.approx(2 / 3)


def test_no_mixed_list_gives_half(spark):
    df = frame(spark, [0, 0], [1, 1], [0.1, 0.2])
    assert M.evaluate(df, ["g"], "u", "y", "s", ["id"]).first()["gauc"] == 0.5


def test_click_protocol_skips_users_without_clicks(spark):
    df = frame(spark, [1, 1, 2, 2, 3], [1, 0, 0, 1, 0], [0.9, 0.1, 0.9, 0.1, 0.5])
    r = M.click_metrics(df, ["g"], "u", "y", "s", ["id"]).first()
    assert (r["users"], r["scored_users"]) == (3, 2)
    assert r["recall_at_50"] == 1.0
    assert r["ndcg_at_10"] == pytest.approx((1 + 1 / math.log2(3)) / 2)


def test_ndcg_perfect_and_recall_at_2(spark):
    df = frame(spark, [1] * 4, [1, 1, 0, 0], [4, 3, 2, 1])
    assert M.click_metrics(df, ["g"], "u", "y", "s", ["id"]).first()["ndcg_at_10"] == 1.0
    df = frame(spark, [1] * 4, [1, 0, 1, 0], [4, 3, 2, 1])
    two = M.click_pieces(df, ["u"], "y", "s", ["id"], k=2, k_small=2, k_recall=2).first()
    assert two["recall"] == 0.5


def test_global_auc_with_ties(spark):
    df = frame(spark, *lists(8, True))
    pdf = df.toPandas()
    pos, neg = pdf[pdf.y == 1].s, pdf[pdf.y == 0].s
    want = np.mean([(p > q) + 0.5 * (p == q) for p in pos for q in neg])
    assert M.global_auc(df, ["g"], "y", "s", SMALL).first()["auc"] == pytest.approx(want)


def test_profile(spark):
    df = frame(spark, [1, 1, 2, 2, 2], [0] * 5, [0] * 5)
    r = M.list_profile(df, ["g"], "u").first()
    assert r["list_len_p50"] == 2.5 and r["list_len_max"] == 3 and r["frac_le_10"] == 1.0


def test_original_user_id_groups_lists(spark):
    """Cold users that share an encoded id stay apart when the original id is the key."""
    df = frame(spark, [10, 10, 11, 11], [1, 0, 1, 0], [0.9, 0.8, 0.2, 0.1]).withColumn("enc", F.lit(0))
    assert M.evaluate(df, ["g"], "u", "y", "s", ["id"]).first()["gauc"] == 1.0
    assert M.evaluate(df, ["g"], "enc", "y", "s", ["id"]).first()["gauc"] < 1.0


def test_top_k_is_trimmed_before_the_shuffle(spark):
    df = frame(spark, *lists(1, False))
    plan = M.top_k(df, ["u"], "s", ["id"], 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
