"""Groups of the feature table that come from models, vectors and raw side columns."""

import pytest
from pyspark.sql import functions as F

from rankloom.operators import fm
from rankloom.plans.features import build_features
from rankloom.sources.views import impressions, item_vectors, table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def log(spark):
    return impressions(spark, SF).where("row_id % 3 = 0"), impressions(spark, SF, ["train"]).where("row_id % 3 = 0")


def test_machine_scores_are_out_of_fold_features(log):
    rows, train = log
    how = fm.Machine(factors=2, steps=1)
    build = lambda r, t: {x["row_id"]: (x["split"], x["fm_score"]) for x in build_features(r, t, ("fm",), machine=how).collect()}
    got = build(rows, train)
    assert len(got) == rows.count() and all(0 < s < 1 for _, s in got.values())
    # a train row's label changes no score of its own fold, so not its own either
    one = min(i for i, (split, _) in got.items() if split == "train")
    turn = lambda d: d.withColumn("long_view", F.when(F.col("row_id") == one, 1 - F.col("long_view")).otherwise(F.col("long_view")))
    again = build(turn(rows), turn(train))
    assert abs(again[one][1] - got[one][1]) < 1e-12
    assert any(abs(again[i][1] - got[i][1]) > 1e-9 for i in got)


def test_sequence_group_needs_vectors_and_holds_the_pool(spark, log):
    rows, train = log
    with pytest.raises(ValueError, match="vectors"):
        build_features(rows, train, ("seq",))
    vectors = item_vectors(spark, SF)
    got = build_features(rows, train, ("seq",), vectors=vectors)
    assert got.count() == rows.count() and got.where("seq_score is null").count() == 0
    assert got.where("seq_score <> 0").count() > 0


def test_raw_side_columns_give_aspect_and_age(spark, log):
    rows, train = log
    items = table(spark, SF, "part", "p_partkey", "p_size").select(
        F.col("p_partkey").cast("int").alias("video_id"), F.lit("a").alias("video_type"), F.lit(1).alias("upload_type"), F.lit(1).alias("visible_status"),
        F.lit(2).alias("music_type"), F.col("p_size").alias("server_width"), (F.col("p_partkey") % 2).alias("server_height"), F.lit(9).alias("video_duration"),
        F.when(F.col("p_partkey") % 5 > 0, "2023-12-30").otherwise("no date").alias("upload_dt"))
    got = build_features(rows, train, ("base", "vside"), items=items).collect()
    sizes = {r["video_id"]: r for r in items.collect()}
    from datetime import datetime

    assert got
    for r in got:
        s = sizes.get(r["video_id"])
        if s is None:
            assert r["aspect"] is None and r["upload_age"] is None
            continue
        assert r["aspect"] == s["server_width"] / max(1, s["server_height"])
        age = (datetime.strptime(str(r["date"]), "%Y%m%d") - datetime(2023, 12, 30)).days if s["video_id"] % 5 else None
        assert r["upload_age"] == age


def exchanges(plan):
    """(partitioning, columns) of every exchange below a plan node."""
    if plan.nodeName() == "AdaptiveSparkPlan":
        plan = plan.initialPlan()
    own = [(plan.outputPartitioning().toString(), plan.output().size())] if plan.nodeName() == "Exchange" else []
    children = plan.children()
    return own + [x for i in range(children.size()) for x in exchanges(children.apply(i))]


def test_columns_of_a_group_move_by_row_id_alone(spark):
    """No exchange by a user's or an item's key carries what other groups have made."""
    from rankloom.catalog import queries

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        table = queries()["feature_table"](spark, SF)
        moved = exchanges(table._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    by_key = [n for how, n in moved if how.startswith("hashpartitioning") and not how.startswith("hashpartitioning(row_id")]
    assert len(by_key) > 20 and max(by_key) <= 16
