from pyspark.sql import functions as F

from rankloom.operators.sessions import session_features
from rankloom.sources.views import impressions, table
from rankloom.streaming import exposures as X

SF = "/root/testdata/sf0.001"


def replay(spark, tmp_path, build):
    """Write the log as several files plus one far-future event that moves the watermark."""
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    e = table(spark, SF, "events")
    e.repartitionByRange(3, "ts").write.parquet(src)
    far = e.limit(1).withColumn("ts", F.expr("TIMESTAMP_NTZ'2030-01-01 00:00:00'")).withColumn("user_id", F.lit(-1).cast("long"))
    far.write.mode("append").parquet(src)
    stream = X.event_stream(spark, src, files_per_trigger=100)
    # the second run has no new data but lets the watermark close what is open
    for _ in range(2):
        X.append_to(build(stream), out, str(tmp_path / "ck")).awaitTermination()
    return spark.read.parquet(out).where("user_id >= 0")


def test_stream_sessions_equal_batch(spark, tmp_path):
    got = replay(spark, tmp_path, X.stream_sessions)
    rows = impressions(spark, SF).withColumn("split", F.lit("all"))
    starts = session_features(rows).where("sess_pos = 0").count()
    assert got.count() == starts
    assert got.agg(F.sum("impressions")).first()[0] == rows.count()


def test_stream_daily_totals_equal_batch(spark, tmp_path):
    got = replay(spark, tmp_path, lambda s: X.stream_daily_totals(s, ["user_id"], {"v": "value"}))
    want = table(spark, SF, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("cnt"))
    assert got.select("user_id", "day", "cnt").exceptAll(want).count() == 0
    assert got.count() == want.count()
