import hashlib
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from rankloom.operators import checks as C
from rankloom.operators import encode as E
from rankloom.operators import runs as R
from rankloom.operators import splits as P
from rankloom.plans import features as X
from rankloom.sources import logs, sinks
from rankloom.operators.ordering import Skew

HEADER = "user_id,video_id,date,hourmin,time_ms,is_click,is_like,is_follow,is_comment,is_forward,is_hate,long_view," \
         "play_time_ms,duration_ms,profile_stay_time,comment_stay_time,is_profile_enter,is_rand,tab\n"


@pytest.fixture(scope="module")
def raw(tmp_path_factory):
    d = tmp_path_factory.mktemp("raw")
    (d / "a.csv").write_text(HEADER + "1,10,20220408,930,1,1,0,0,0,0,0,1,9000,8000,,0,0,0,1\n")
    (d / "b.csv").write_text(HEADER + "2,11,20220422,2359,2,0,0,0,0,0,0,0,10,8000,3.5,0,0,0,0\n")
    (d / "items.csv").write_text("video_id,author_id\n10,77\n")
    return d


def test_csv_union_prunes_columns_and_defaults(spark, raw):
    df = logs.impression_log(spark, [str(raw / "a.csv"), str(raw / "b.csv")])
    got = {r["user_id"]: r for r in df.collect()}
    assert tuple(df.columns) == logs.LOG_COLUMNS
    assert got[1]["profile_stay_time"] == 0.0 and got[2]["profile_stay_time"] == 3.5
    items = logs.csv_scan(spark, str(raw / "items.csv"), "video_id BIGINT, author_id BIGINT")
    a = {r["user_id"]: r["author_id"] for r in logs.with_author(df, items, F.lit(-1)).collect()}
    assert a == {1: 77, 2: -1}
    ranges = {"train": (20220408, 20220421), "valid": (20220422, 20220428)}
    assert {r["split"] for r in P.date_split(df, ranges).collect()} == {"train", "valid"}


def test_text_log(spark, raw):
    got = {r["user_id"]: r for r in logs.text_log(spark, [str(raw / "a.csv"), str(raw / "b.csv")], str(raw / "items.csv")).collect()}
    assert (got["1"]["author_id"], got["1"]["long_view"]) == ("77", 1)
    assert (got["2"]["author_id"], got["2"]["long_view"]) == ("UNK", 0)


def test_optional_source(spark, raw):
    df = spark.createDataFrame([(10,), (12,)], "video_id long")
    d = {"author_id": F.lit(0)}
    there = logs.optional_join(spark, df, str(raw / "items.csv"), "video_id BIGINT, author_id BIGINT", "video_id", d)
    gone = logs.optional_join(spark, df, str(raw / "none.csv"), "video_id BIGINT, author_id BIGINT", "video_id", d)
    assert {r["video_id"]: r["author_id"] for r in there.collect()} == {10: 77, 12: 0}
    assert {r["author_id"] for r in gone.collect()} == {0}


def test_feature_sink_clusters_users_and_spreads_a_heavy_one(spark, tmp_path):
    pdf = pd.DataFrame({"user_id": [1] * 50 + [2, 3], "split": "train", "x": 0.5, "row_id": range(52)})
    path = str(tmp_path / "f")
    # tiny partitions would be merged again
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    sinks.write_features(spark.createDataFrame(pdf), path, salts=4, skew=Skew(rows_per_task=10))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    back = spark.read.parquet(path)
    assert back.count() == 52 and dict(back.dtypes)["x"] == "float"
    files = back.withColumn("f", F.input_file_name()).groupBy("user_id").agg(F.countDistinct("f").alias("n"))
    n = {r["user_id"]: r["n"] for r in files.collect()}
    assert n[2] == n[3] == 1 and n[1] > 1


def test_prepared_output_is_reused(spark, tmp_path):
    path, calls = str(tmp_path / "p"), []

    def build():
        calls.append(1)
        return spark.createDataFrame([(1, "train"), (2, "valid")], "user_id int, split string")

    for _ in range(2):
        assert sinks.ensure_prepared(spark, path, ["train", "valid"], build).count() == 2
    assert len(calls) == 1
    sinks.ensure_prepared(spark, path, ["train", "valid"], build, force=True)
    assert len(calls) == 2


def test_score_sink_replaces_only_its_folders(spark, tmp_path):
    path = str(tmp_path / "s")
    schema = "model string, split string, row_id int, score double"
    sinks.write_scores(spark.createDataFrame([("m", "valid", 1, 0.1), ("k", "valid", 1, 0.3)], schema), path)
    sinks.write_scores(spark.createDataFrame([("m", "valid", 1, 0.2)], schema), path)
    assert sinks.read_scores(spark, path, "m", "valid").first()["score"] == 0.2
    assert sinks.read_scores(spark, path, "k", "valid").first()["score"] == 0.3


def test_misaligned_scores_are_refused(spark):
    rows = spark.createDataFrame([(1,), (2,)], "row_id int")
    good = spark.createDataFrame([(1, 0.5), (2, 0.6)], "row_id int, s double")
    assert C.attach_scores(rows, good, "s").count() == 2
    bad = good.where("row_id = 1")
    with pytest.raises(Exception, match="do not align"):
        C.attach_scores(rows, bad, "s").collect()
    assert [tuple(r) for r in C.misaligned(rows, bad).collect()] == [(2, "rows")]


def test_digest_ignores_order_and_sees_changes(spark):
    df = spark.createDataFrame([(1, 0), (2, 1), (3, None)], "a int, b int")
    d = C.content_digest(df, ["a", "b"]).first()
    assert C.content_digest(df.orderBy(F.desc("a")), ["a", "b"]).first() == d
    assert C.content_digest(df.na.fill(0), ["a", "b"]).first() != d


def test_table_diff_counts_copies(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "x int")
    b = spark.createDataFrame([(1,), (2,), (3,)], "x int")
    assert sorted(map(tuple, C.table_diff(a, b).collect())) == [(1, "stored", 1), (3, "recomputed", 1)]


def test_metric_drift(spark):
    e = spark.createDataFrame([("m", 0.5), ("n", 0.1)], "k string, v double")
    a = spark.createDataFrame([("m", 0.5 + 4e-7), ("o", 0.1)], "k string, v double")
    assert {r["k"]: r["drifted"] for r in C.metric_drift(e, a, ["k"], "v").collect()} == {"m": False, "n": True, "o": True}


def test_leak_guard():
    C.assert_no_leak(["v_imp", "tab"])
    with pytest.raises(ValueError, match="play_time_ms"):
        C.assert_no_leak(["v_imp", "play_time_ms"])
    assert len(X.feature_columns(list(X.GROUPS))) == 115
    assert X.inlist_features("res") == ["server_width", "server_height", "aspect"]


def test_file_digests(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"abc")
    r = sinks.file_digests(spark, str(tmp_path)).first()
    assert r["md5"] == hashlib.md5(b"abc").hexdigest() and r["sha256"] == hashlib.sha256(b"abc").hexdigest()


def test_vocabulary(spark, tmp_path):
    train = spark.createDataFrame([(0, 10), (1, 11), (2, 10)], "row_id int, video_id int")
    vocab = E.fit_vocab(train, ["video_id"])
    sinks.write_vocab(vocab, str(tmp_path / "v"))
    vocab = spark.read.parquet(str(tmp_path / "v"))
    rows = spark.createDataFrame([(0, 10), (1, 99), (2, 11)], "row_id int, video_id int")
    got = [r["video_id_idx"] for r in E.encode_vocab(rows, vocab, ["video_id"]).orderBy("row_id").collect()]
    assert got == [1, 0, 2]
    assert E.field_dims(vocab).first()["dims"] == 3


def test_run_records_and_iterations(spark, tmp_path):
    for name, p, wall in (("r1", 0.60, 10.04), ("r2", 0.61, 5.0)):
        doc = {"name": name, "valid": {"primary": p, "GAUC": 0.6, "nDCG@5": 0.5}, "wall_seconds": wall, "params": {"seed": 0}}
        (tmp_path / f"{name}.json").write_text(json.dumps(doc, indent=2))
    runs = logs.run_records(spark, str(tmp_path)).select("name", F.col("valid.primary").alias("primary"), "wall_seconds")
    plan = spark.createDataFrame([(1, "h", "r1"), (1, "h", "r2"), (2, "g", "r9")], "iter int, hypothesis string, name string")
    got = {r["iter"]: r for r in R.compile_iterations(plan, runs).collect()}
    assert (got[1]["best_run"], got[1]["primary"], got[1]["wall_seconds_total"], got[1]["missing"]) == ("r2", 0.61, 15.0, 0)
    assert (got[2]["primary"], got[2]["missing"]) == (None, 1)


def test_append_and_outcome_and_fallback(spark, tmp_path):
    path = str(tmp_path / "log")
    for i in (1, 2):
        sinks.append_record(spark, path, {"iter": i, "id": "a", "error": None if i == 1 else "x"}, "iter long, id string, error string")
    back = logs.json_lines(spark, path, R.ATTEMPT_SCHEMA)
    assert back.count() == 2 and back.where("ts IS NULL").count() == 0
    t = spark.createDataFrame([("Negative, then recovery", None)], "a string, b string")
    assert t.select(R.outcome("a", "b").alias("o")).first()["o"] == "RECOVERY / NEGATIVE"
    m = spark.createDataFrame([(None, 0.2, 0.3), (None, None, None)], "a double, b double, c double")
    assert [r[0] for r in m.select(R.primary_of(F.col("a"), F.col("b"), F.col("c"))).collect()] == [0.2, None]


def test_running_best_and_stop_rule(spark):
    rows = [(i, v) for i, v in enumerate([0.1, 0.3, 0.2, 0.3001, 0.3, 0.3002])]
    df = spark.createDataFrame(rows, "i int, v double").withColumn("k", F.lit("s"))
    b = [r["best_before"] for r in R.running_best(df, ["k"], "i", "v").orderBy("i").collect()]
    assert b == [None, 0.1, 0.3, 0.3, 0.3001, 0.3001]
    c = [r["stop"] for r in R.converged(df, ["k"], "i", "v", 0.0005, 3).orderBy("i").collect()]
    assert c == [False, False, False, False, True, True]
    assert [r["stop"] for r in R.converged(df, ["k"], "i", "v", 0.0005, 3, floor=6).orderBy("i").collect()][-2:] == [False, True]
    assert [r["stale"] for r in R.stale_runs(df, ["k"], "i", "v", 0.0005).orderBy("i").collect()] == [0, 0, 1, 2, 3, 4]


def test_csv_binds_by_name_and_refuses_missing_columns(spark, tmp_path):
    (tmp_path / "x.csv").write_text("video_id,user_id\n11,1\nbad,2\n")
    schema = "user_id BIGINT, video_id BIGINT"
    got = {r["user_id"]: r["video_id"] for r in logs.csv_scan(spark, str(tmp_path / "x.csv"), schema).collect()}
    assert got == {1: 11, 2: None}
    with pytest.raises(ValueError, match="author_id"):
        logs.csv_scan(spark, str(tmp_path / "x.csv"), "author_id BIGINT")


def test_alignment_holds_when_the_score_is_not_read(spark):
    rows = spark.createDataFrame([(1,), (2,)], "row_id long")
    scores = spark.createDataFrame([(2, 0.5), (3, 0.1)], "row_id long, s double")
    with pytest.raises(Exception, match="do not align"):
        C.attach_scores(rows, scores, "s").count()
    with pytest.raises(Exception, match="do not align"):
        C.attach_scores(rows, scores, "s").select("row_id").collect()
    assert C.attach_scores(rows, spark.createDataFrame([(2, 0.5), (1, 0.2)], "row_id long, s double"), "s").count() == 2


def test_a_stale_prepared_table_is_built_again(spark, tmp_path):
    """Other columns, mode, pool or sources make a stored table stale; the same ones do not."""
    source = f"{tmp_path}/source"
    spark.range(3).write.parquet(source)
    path, built = f"{tmp_path}/features", []

    def build(columns=("x",)):
        def run():
            built.append(1)
            return spark.range(4).selectExpr("id AS row_id", "id AS user_id", *[f"id AS {c}" for c in columns], "if(id < 2, 'train', 'valid') AS split")
        return run

    def ensure(columns=("x",), mode="past", pool=(1, 9)):
        m = sinks.manifest_of(spark, columns, mode, pool, [source])
        return sinks.ensure_prepared(spark, path, ["train", "valid"], build(columns), manifest=m)

    assert ensure().count() == 4 and len(built) == 1
    assert ensure().count() == 4 and len(built) == 1
    ensure(mode="loo")
    ensure(mode="loo", pool=(1, 8))
    assert "y" in ensure(("x", "y"), "loo", (1, 8)).columns and len(built) == 4
    ensure(("x", "y"), "loo", (1, 8))
    assert len(built) == 4
    spark.range(9).write.mode("overwrite").parquet(source)
    ensure(("x", "y"), "loo", (1, 8))
    assert len(built) == 5
    assert sinks.read_manifest(spark, f"{tmp_path}/none") is None


def test_run_log_joins_metrics_outcomes_and_the_best_before(spark):
    from rankloom.operators.runs import run_log

    plan = spark.createDataFrame([(1, "h1", "a", 1), (2, "h2", "b", 1), (2, "h2", "c", 2), (3, "h3", "d", 1)], "iter int, hypothesis string, name string, no int")
    runs = spark.createDataFrame([("a", None, 0.5, 10.0), ("b", 0.6, 0.1, 20.0), ("c", 0.6, None, 5.0)], "name string, primary double, valid_primary double, wall_seconds double")
    records = spark.createDataFrame([("a", "a negative result", None), ("b", "confirmed", "ERROR then recovery")], "name string, note string, error string")
    got = {r["iter"]: r for r in run_log(plan, runs, records).collect()}
    assert [got[i]["best_run"] for i in (1, 2, 3)] == ["a", "b", "d"]
    assert got[1]["primary"] == 0.5 and got[1]["best_before"] is None and got[1]["outcome"] == "NEGATIVE"
    assert got[2]["best_before"] == 0.5 and got[2]["is_best"] and got[2]["wall_seconds_total"] == 25.0
    assert got[2]["outcome"] == "ERROR / RECOVERY / CONFIRMED"
    assert got[3]["missing"] == 1 and not got[3]["is_best"] and got[3]["outcome"] == ""
