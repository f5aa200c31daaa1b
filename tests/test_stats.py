import pandas as pd
import pytest
from pyspark.sql import functions as F

from rankloom.operators import stats as S
from rankloom.sources.views import impressions

SF = "/root/testdata/sf0.001"


def small(spark):
    pdf = pd.DataFrame({"row_id": range(6), "item": list("aaaabb"), "dayord": [1, 1, 2, 3, 1, 2], "y": [1, 0, 1, 0, 1, 1],
                        "split": "train"})
    return spark.createDataFrame(pdf)


def test_past_only_counts(spark):
    df = small(spark)
    got = S.attach_counts(df, df, ["item"], {"s": "y"}, "past", "c").orderBy("row_id").collect()
    assert [r["s"] for r in got] == [0, 0, 1, 2, 0, 1]
    assert [r["c"] for r in got] == [0, 0, 2, 3, 0, 1]


def test_leave_one_out_counts(spark):
    pdf = pd.DataFrame({"row_id": range(4), "item": list("aaab"), "dayord": 1, "y": [1, 0, 1, 1], "split": "train"})
    df = spark.createDataFrame(pdf)
    got = S.attach_counts(df, df, ["item"], {"s": "y"}, "loo", "c").orderBy("row_id").collect()
    assert [r["s"] for r in got] == [1, 2, 1, 0]
    assert [r["c"] for r in got] == [2, 2, 2, 0]


def test_other_splits_read_the_whole_pool(spark):
    df = small(spark)
    new = spark.createDataFrame([(9, "a", 0, 0, "valid"), (10, "z", 9, 0, "valid")], "row_id int, item string, dayord int, y int, split string")
    for mode in S.MODES:
        got = {r["row_id"]: (r["s"], r["c"]) for r in S.attach_counts(new, df, ["item"], {"s": "y"}, mode, "c").collect()}
        assert got == {9: (2, 4), 10: (0, 0)}


def test_unknown_mode_is_refused(spark):
    with pytest.raises(ValueError):
        S.attach_counts(small(spark), small(spark), ["item"], {}, "future")


def features(spark, rows):
    from rankloom.plans.features import build_features

    groups = ("item", "user", "ua", "uv", "utags", "sess")
    return build_features(rows, rows.where("split = 'train'"), groups)


def test_label_flip_outside_train_changes_no_feature(spark):
    rows = impressions(spark, SF).withColumn("is_hate", F.expr("CAST(play_time_ms < 3000 AS INT)"))
    flip = rows.withColumn("long_view", F.when(F.col("split") != "train", 1 - F.col("long_view")).otherwise(F.col("long_view")))
    a = features(spark, rows).drop("long_view").toPandas().sort_values("row_id").reset_index(drop=True)
    b = features(spark, flip).drop("long_view").toPandas().sort_values("row_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b)


def test_future_rows_change_no_past_count(spark):
    rows = impressions(spark, SF).where("split = 'train'")
    cut = 8
    cols = ["row_id", "uv_cnt", "uv_lv_cnt", "v_imp", "u_imp"]

    def counts(d):
        got = S.attach_counts(d, d, ["user_id", "video_id"], {"uv_lv_cnt": "long_view"}, "past", "uv_cnt")
        got = S.attach_counts(got, d, ["video_id"], {}, "past", "v_imp")
        got = S.attach_counts(got, d, ["user_id"], {}, "past", "u_imp")
        return got.where(F.col("dayord") < cut).select(cols).toPandas().sort_values("row_id").reset_index(drop=True)

    pd.testing.assert_frame_equal(counts(rows), counts(rows.where(F.col("dayord") < cut)))


def test_mixed_weight(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "a", 0), (3, "b", 1)], "row_id int, k string, y int")
    assert sorted((r["row_id"], r["weight"]) for r in S.mixed_weight(df, ["k"], "y", 0.2).collect()) == [(1, 1.0), (2, 1.0), (3, 0.2)]


def test_features_that_cannot_be_built_are_named(spark):
    from rankloom.plans.features import build_features

    rows = impressions(spark, SF)
    with pytest.raises(ValueError, match="v_hate_rate"):
        build_features(rows, rows.where("split = 'train'"), ("item",))
    with pytest.raises(ValueError, match="video_type"):
        build_features(rows, rows.where("split = 'train'"), ("vside",), items=rows.select("video_id").distinct())
