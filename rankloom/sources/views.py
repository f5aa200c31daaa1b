"""Parquet scans and the two impression views every operator runs on.

``impressions`` reads the event log as exposures of items to users;
``order_impressions`` reads order lines the same way.  Both are projections
(plus, for orders, equi-joins), so column pruning and date filters reach the
Parquet scan.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# First day of the event log and the inclusive day ranges of its splits.
EPOCH = dt.date(2024, 1, 1)
SPLIT_DAYS = {"train": (0, 13), "valid": (14, 20), "test": (21, 29)}
# First day and year ranges of the order log.
ORDER_EPOCH = dt.date(1995, 1, 1)
ORDER_SPLIT_YEARS = {"train": (1995, 1998), "valid": (1999, 1999), "test": (2000, 2001)}


# Schemas of the driver tables in use; stating them saves a footer-reading job per scan.
SCHEMAS = {
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
              "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
                "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, "
                "l_shipdate TIMESTAMP_NTZ",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "embeddings": "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "pages": "page_id BIGINT, url STRING, html STRING",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
}


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Column-pruned Parquet scan."""
    reader = spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else spark.read
    df = reader.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


# Epoch microseconds of a wall-clock timestamp, whatever the session zone.
MICROS = (
    "CAST(datediff(to_date({0}), DATE'1970-01-01') AS BIGINT) * 86400000000 + CAST(hour({0}) AS BIGINT) * 3600000000"
    " + CAST(minute({0}) AS BIGINT) * 60000000 + CAST(date_part('SECOND', {0}) * 1000000 AS BIGINT)"
)


def split_case(day: str, ranges: dict[str, tuple[int, int]]) -> str:
    """SQL text naming the inclusive range a day falls in; null outside all of them."""
    whens = " ".join(f"WHEN {day} BETWEEN {lo} AND {hi} THEN '{name}'" for name, (lo, hi) in ranges.items())
    return f"CASE {whens} END"


def impressions(spark: SparkSession, sf_dir: str, splits: Sequence[str] | None = None) -> DataFrame:
    """The event log as impressions.

    ``splits`` keeps only the named splits by a range filter on the stored
    timestamp, which Parquet row groups can be skipped on.
    """
    e = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value", "props")
    if splits is not None:
        spans = []
        for s in splits:
            lo, hi = SPLIT_DAYS[s]
            first, after = EPOCH + dt.timedelta(days=lo), EPOCH + dt.timedelta(days=hi + 1)
            spans.append(f"(ts >= TIMESTAMP_NTZ'{first} 00:00:00' AND ts < TIMESTAMP_NTZ'{after} 00:00:00')")
        e = e.where(" OR ".join(spans))
    e = e.selectExpr(
        "*",
        "CAST(get_json_object(props, '$.k') AS INT) AS video_id",
        f"datediff(to_date(ts), DATE'{EPOCH}') AS dayord",
    )
    return e.selectExpr(
        "event_id AS row_id",
        "user_id",
        "video_id",
        "video_id % 20 AS author_id",
        "array(video_id % 8, 100 + video_id % 5) AS tags",
        "event_type AS tab",
        MICROS.format("ts") + " AS time_us",
        "dayord",
        "CAST(date_format(ts, 'yyyyMMdd') AS INT) AS date",
        "hour(ts) AS hour",
        "weekday(ts) AS dow",
        "6000 + 540 * video_id AS duration_ms",
        "value * 1000 AS play_time_ms",
        "CAST(value >= 50 AS INT) AS long_view",
        "CAST(value >= 20 AS INT) AS is_click",
        split_case("dayord", SPLIT_DAYS) + " AS split",
    )


# Columns that order an order line among the lines of one user.
ORDER_TIES = ["order_id", "line", "video_id", "author_id", "price"]


def order_impressions(spark: SparkSession, sf_dir: str, with_tags: bool = False, splits: Sequence[str] | None = None) -> DataFrame:
    """Order lines as impressions; ``ORDER_TIES`` is the row order within a user.

    ``splits`` keeps only the named splits by a range filter on the stored order
    date, which reaches the scan.

    Both joins are on keys whose build side Spark sizes from the Parquet
    footers: broadcast while small, sort-merge with skew splitting beyond.
    """
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    if splits is not None:
        spans = [f"(o_orderdate >= TIMESTAMP_NTZ'{lo}-01-01 00:00:00' AND o_orderdate < TIMESTAMP_NTZ'{hi + 1}-01-01 00:00:00')" for lo, hi in (ORDER_SPLIT_YEARS[x] for x in splits)]
        o = o.where(" OR ".join(spans))
    line = table(
        spark, sf_dir, "lineitem",
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag",
    )
    j = line.join(o, line.l_orderkey == o.o_orderkey)
    if with_tags:
        p = table(spark, sf_dir, "part", "p_partkey", "p_name")
        j = j.join(p, j.l_partkey == p.p_partkey).withColumn("tags", F.split("p_name", " "))
    return j.selectExpr(
        "o_custkey AS user_id",
        "l_partkey AS video_id",
        "l_suppkey AS author_id",
        "o_orderpriority AS tab",
        "l_orderkey AS order_id",
        "l_linenumber AS line",
        "l_extendedprice AS price",
        "CAST(date_format(o_orderdate, 'yyyyMMdd') AS INT) AS date",
        f"datediff(to_date(o_orderdate), DATE'{ORDER_EPOCH}') AS dayord",
        "l_quantity AS duration",
        "CAST(l_returnflag = 'R' AS INT) AS long_view",
        split_case("year(o_orderdate)", ORDER_SPLIT_YEARS) + " AS split",
        *(["tags"] if with_tags else []),
    )


def item_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item embeddings keyed like ``impressions.video_id``."""
    return table(spark, sf_dir, "embeddings", "vec_id", "embedding").select(
        F.col("vec_id").cast("int").alias("video_id"), F.col("embedding").cast("array<double>").alias("vec")
    )
