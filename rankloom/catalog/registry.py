"""Registered queries, each with the SQL text that must give the same rows.

A query takes ``(spark, sf_dir)`` and returns a DataFrame.  Doubles that two
engines may sum in different orders go through ``r6`` on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.session import tune

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

IMP = """imp AS (
  SELECT *, CASE WHEN dayord BETWEEN 0 AND 13 THEN 'train' WHEN dayord BETWEEN 14 AND 20 THEN 'valid'
                 WHEN dayord BETWEEN 21 AND 29 THEN 'test' END AS split
  FROM (SELECT event_id AS row_id, user_id, k AS video_id, k % 20 AS author_id, [k % 8, 100 + k % 5] AS tags,
               event_type AS tab, epoch_us(ts) AS time_us,
               CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS dayord,
               CAST(strftime(ts, '%Y%m%d') AS INTEGER) AS date, CAST(hour(ts) AS INTEGER) AS hour,
               CAST(isodow(ts) - 1 AS INTEGER) AS dow, 6000 + 540 * k AS duration_ms,
               value * 1000 AS play_time_ms, CAST(value >= 50 AS INTEGER) AS long_view,
               CAST(value >= 20 AS INTEGER) AS is_click
        FROM (SELECT *, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS k FROM events)))"""

ORD = """ord_imp AS (
  SELECT o_custkey AS user_id, l_partkey AS video_id, l_suppkey AS author_id, o_orderpriority AS tab,
         l_orderkey AS order_id, l_linenumber AS line, l_extendedprice AS price,
         CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS date,
         CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS dayord,
         l_quantity AS duration, CAST(l_returnflag = 'R' AS INTEGER) AS long_view,
         string_split(p_name, ' ') AS tags,
         CASE WHEN year(o_orderdate) BETWEEN 1995 AND 1998 THEN 'train' WHEN year(o_orderdate) = 1999 THEN 'valid'
              WHEN year(o_orderdate) BETWEEN 2000 AND 2001 THEN 'test' END AS split
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""


def r6(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6) + F.lit(0.0)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(n) for n in names})


def with_ctes(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body if ctes else body


def query(name: str, sql: str | None = None, ctes: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(tune(spark), sf_dir)

        run.__doc__ = fn.__doc__
        run.__name__ = fn.__name__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_ctes(sql, *ctes)
        return fn

    return register
