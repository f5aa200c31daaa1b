"""CSV log and dimension scans with stated schemas, and JSON run records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rankloom.functions.scalars import label_of
from rankloom.operators.runs import RUN_SCHEMA

LOG_SCHEMA = (
    "user_id BIGINT, video_id BIGINT, date INT, hourmin INT, time_ms BIGINT, is_click INT, is_like INT, "
    "is_follow INT, is_comment INT, is_forward INT, is_hate INT, long_view INT, play_time_ms BIGINT, "
    "duration_ms BIGINT, profile_stay_time DOUBLE, comment_stay_time DOUBLE, is_profile_enter INT, "
    "is_rand INT, tab INT"
)
LOG_COLUMNS = (
    "user_id", "video_id", "date", "hourmin", "time_ms", "is_click", "is_hate", "is_like", "is_comment",
    "is_forward", "is_profile_enter", "profile_stay_time", "long_view", "play_time_ms", "duration_ms", "tab",
)


def csv_scan(spark: SparkSession, paths: str | Sequence[str], schema: str, columns: Sequence[str] = ()) -> DataFrame:
    """CSV bound by the header's names; only the named columns are parsed.  Several paths are one union.

    A column that the header lacks raises; text that is no value of the stated type is null.
    """
    kinds = {f.name: f.dataType for f in StructType.fromDDL(schema).fields}
    wanted = list(columns) or list(kinds)
    out = None
    for path in [paths] if isinstance(paths, str) else paths:
        text = spark.read.csv(path, header=True)
        if missing := [c for c in wanted if c not in text.columns]:
            raise ValueError(f"{path} has no column {missing}")
        df = text.select(*[F.col(c).try_cast(kinds[c]).alias(c) for c in wanted])
        out = df if out is None else out.unionByName(df)
    return out


def impression_log(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Union of log files, feedback time defaulted to 0."""
    parts = [csv_scan(spark, p, LOG_SCHEMA, LOG_COLUMNS) for p in paths]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("profile_stay_time", F.coalesce("profile_stay_time", F.lit(0.0)))


def with_author(log: DataFrame, items: DataFrame, default: Column) -> DataFrame:
    """Author of each item; items without one get ``default``."""
    return log.join(items.select("video_id", "author_id"), "video_id", "left").withColumn(
        "author_id", F.coalesce("author_id", default)
    )


def text_log(spark: SparkSession, paths: Sequence[str], items: str, label: str = "long_view") -> DataFrame:
    """All-text read: string ids, author or 'UNK', label 1 for anything but '0'."""
    cols = ["date", "user_id", "video_id", "tab", "duration_ms", label]
    header = spark.read.csv(list(paths), header=True).select(*cols)
    authors = spark.read.csv(items, header=True).select("video_id", "author_id")
    return with_author(header, authors, F.lit("UNK")).select(
        F.col("date").cast("int").alias("date"), "user_id", "video_id", "author_id", "tab",
        F.col("duration_ms").cast("double").alias("duration_ms"), label_of(label).alias(label),
    )


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on the session's file system."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def optional_join(
    spark: SparkSession, rows: DataFrame, path: str, schema: str, key: str, defaults: Mapping[str, Column]
) -> DataFrame:
    """Left join a side table if its file is there; otherwise its columns are the defaults."""
    if not exists(spark, path):
        return rows.withColumns(dict(defaults))
    side = csv_scan(spark, path, schema, [key, *defaults])
    joined = rows.join(side, key, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), d) for c, d in defaults.items()})


def run_records(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document per run; the file's name identifies the run."""
    df = spark.read.schema(RUN_SCHEMA).json(path, multiLine=True)
    base = F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)
    return df.withColumn("name", F.coalesce("name", base))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)
