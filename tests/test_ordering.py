"""The segmented road gives what the plain window gives, on hot keys and heavy ties."""

import numpy as np
import pandas as pd
import pytest

from rankloom.operators.ordering import Prefix, Skew, exact_quantiles, ordered_prefix

SMALL = Skew(rows_per_task=20)
HUGE = Skew(rows_per_task=10**9)


def log(spark, seed=0, n=600):
    """One key holds two thirds of the rows; most of its order values are equal."""
    r = np.random.default_rng(seed)
    key = np.where(r.random(n) < 0.66, 7, r.integers(0, 6, n))
    order = np.where(r.random(n) < 0.6, 3.0, r.integers(0, 12, n)).astype(float)
    pdf = pd.DataFrame({"k": key, "o": order, "id": r.permutation(n), "v": r.integers(0, 5, n)})
    return spark.createDataFrame(pdf)


def collect(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()))


STEP = Prefix(number="no", sums={"s": "v"}, maxes={"m": "v"}, previous={"p": "v"}, total="n", totals={"t": "v"})


@pytest.mark.parametrize("seed", [0, 1])
def test_segments_equal_window(spark, seed):
    df = log(spark, seed)
    a = ordered_prefix(df, ["k"], "o", ["id"], STEP, SMALL)
    b = ordered_prefix(df, ["k"], "o", ["id"], STEP, HUGE)
    assert collect(a) == collect(b)


def test_segments_split_heavy_ties(spark):
    from rankloom.operators.ordering import with_segments

    df = log(spark).where("k = 7")
    sizes = [r["count"] for r in with_segments(df, ["k"], "o", ["id"], SMALL).groupBy("_seg").count().collect()]
    assert len(sizes) > 4 and max(sizes) < df.count() / 3


def test_prefix_matches_pandas(spark):
    df = log(spark)
    got = ordered_prefix(df, ["k"], "o", ["id"], STEP, SMALL).toPandas().sort_values(["k", "o", "id"])
    want = df.toPandas().sort_values(["k", "o", "id"])
    g = want.groupby("k")["v"]
    assert (got["no"].to_numpy() == g.cumcount().to_numpy() + 1).all()
    assert (got["s"].to_numpy() == (g.cumsum() - want["v"]).to_numpy()).all()
    assert (got["m"].to_numpy() == g.cummax().to_numpy()).all()
    assert (got["n"].to_numpy() == g.transform("size").to_numpy()).all()


def test_exact_quantiles(spark):
    df = log(spark)
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    for skew in (SMALL, HUGE):
        got = {r["k"]: r["quantiles"] for r in exact_quantiles(df, ["k"], "o", probs, skew).collect()}
        for k, part in df.toPandas().groupby("k"):
            assert np.allclose(got[k], np.quantile(part["o"], probs))


def test_longs_beyond_double_precision(spark):
    df = spark.range(200).selectExpr("1 AS k", "1152921504606846976L + (id * 37) % 200 AS o", "id", "id AS v")
    a = ordered_prefix(df, ["k"], "o", ["id"], STEP, SMALL)
    b = ordered_prefix(df, ["k"], "o", ["id"], STEP, HUGE)
    assert collect(a) == collect(b)


def test_text_order_and_text_ties(spark):
    df = spark.range(300).selectExpr("7 AS k", "CAST(id % 3 AS STRING) AS o", "concat('u', id) AS id", "id AS v")
    a = ordered_prefix(df, ["k"], "o", ["id"], STEP, SMALL)
    b = ordered_prefix(df, ["k"], "o", ["id"], STEP, HUGE)
    assert collect(a) == collect(b)


def null_last(rows):
    return sorted(rows, key=lambda r: [(x is None, x) for x in r])


def test_a_null_key_may_be_hot(spark):
    df = spark.range(400).selectExpr("CASE WHEN id % 4 > 0 THEN NULL ELSE id % 5 END AS k", "id % 11 AS o", "id", "id AS v")
    a = ordered_prefix(df, ["k"], "o", ["id"], STEP, SMALL)
    b = ordered_prefix(df, ["k"], "o", ["id"], STEP, HUGE)
    assert null_last(map(tuple, a.select(sorted(a.columns)).collect())) == null_last(map(tuple, b.select(sorted(b.columns)).collect()))
    parts = ordered_prefix(df, ["k"], "o", ["id"], STEP, SMALL).rdd.glom().map(len).collect()
    assert sum(parts) == 400


def test_vocabulary_of_many_texts(spark):
    from rankloom.operators.encode import fit_vocab

    df = spark.range(300).selectExpr("id AS row_id", "concat('u', id % 200) AS user", "id % 3 AS tab")
    heavy, light = (fit_vocab(df, ["user", "tab"], skew=s) for s in (SMALL, HUGE))
    assert collect(heavy) == collect(light)


def test_zscores_keep_null_keys(spark):
    from rankloom.operators.ranks import zscore
    from rankloom.operators.stats import group_totals, mixed_weight
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(None, 1.0, 1), (None, 3.0, 0), (2, 5.0, 1)], "k int, v double, y int")
    assert sorted(round(r["z"], 4) for r in zscore(df, ["k"], "v", "z").collect()) == [-0.7071, 0.0, 0.7071]
    assert group_totals(df, ["k"], F.sum("v").alias("t")).count() == 3
    assert mixed_weight(df, ["k"], "y", 0.5).count() == 3
