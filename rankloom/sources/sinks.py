"""Feature, score, vocabulary and record sinks, and file digests."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators.ordering import DEFAULT_SKEW, Skew, by_weight
from rankloom.sources.logs import exists


def write_features(
    df: DataFrame, path: str, columns: Sequence[str] | None = None, user: str = "user_id", salts: int = 64,
    skew: Skew = DEFAULT_SKEW,
) -> None:
    """Parquet partitioned by split, rows of a user together and sorted.

    Features are stored as 32-bit floats.  A heavy user is spread over ``salts``
    files; everyone else stays in one.
    """
    out = df.select(*columns) if columns else df
    out = out.withColumns({n: F.col(n).cast("float") for n, t in out.dtypes if t == "double"})
    spread = by_weight(
        out, ["split", user],
        lambda d: d.withColumn("_salt", F.lit(0)),
        lambda d: d.withColumn("_salt", F.pmod(F.xxhash64(*d.columns), F.lit(salts)).cast("int")),
        skew,
    )
    spread.repartition("split", user, "_salt").sortWithinPartitions("split", user).drop("_salt").write.mode(
        "overwrite"
    ).partitionBy("split").parquet(path)


def write_scores(scores: DataFrame, path: str) -> None:
    """``(model, split, row_id, score)``, one folder per model and split.

    Only the folders present in ``scores`` are replaced.
    """
    scores.select("model", "split", "row_id", "score").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("model", "split").parquet(path)


def read_scores(spark: SparkSession, path: str, model: str, split: str) -> DataFrame:
    return spark.read.parquet(path).where((F.col("model") == model) & (F.col("split") == split))


def write_vocab(vocab: DataFrame, path: str) -> None:
    vocab.write.mode("overwrite").partitionBy("field").parquet(path)


def append_record(spark: SparkSession, path: str, record: dict, schema: str) -> None:
    """Append one record to a JSON-lines log, stamped with the current time."""
    row = spark.createDataFrame([record], schema)
    row.withColumn("ts", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")).coalesce(1).write.mode(
        "append"
    ).json(path)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """``(file, bytes, md5, sha256)`` of every file under a path."""
    f = spark.read.format("binaryFile").load(path)
    return f.select(
        F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.col("length").alias("bytes"),
        F.md5("content").alias("md5"), F.sha2("content", 256).alias("sha256"),
    )


def write_meta(df: DataFrame, path: str) -> None:
    """Small metadata table (row counts, rates, dimensions) as JSON."""
    df.coalesce(1).write.mode("overwrite").json(path)


def source_state(spark: SparkSession, path: str) -> str:
    """Digest of the names, lengths and times of the files under a path: it changes when any is rewritten.

    Only the listing is read, by the session's own file system.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found, files = fs.listFiles(hadoop, True), []
    while found.hasNext():
        f = found.next()
        name = f.getPath().toString()
        if not f.getPath().getName().startswith(("_", ".")):
            files.append(f"{name}:{f.getLen()}:{f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(files)).encode()).hexdigest()


def manifest_of(spark: SparkSession, columns: Sequence[str], mode: str, pool: Sequence[int], sources: Sequence[str]) -> dict:
    """What a prepared table was made of: its columns, statistics mode and pool, and the state of its sources."""
    return {"columns": sorted(columns), "mode": mode, "pool": list(pool), "sources": {p: source_state(spark, p) for p in sorted(sources)}}


def _manifest_file(path: str) -> str:
    return f"{path}/_manifest"  # hidden from readers of the table


def read_manifest(spark: SparkSession, path: str) -> dict | None:
    """The manifest stored with a table, or None."""
    if not exists(spark, _manifest_file(path)):
        return None
    rows = spark.read.text(f"{_manifest_file(path)}/part-*").collect()
    return json.loads(rows[0][0]) if rows else None


def is_prepared(spark: SparkSession, path: str, splits: Sequence[str], manifest: dict | None = None) -> bool:
    """A complete feature table: the job's success marker and a folder per split.

    With ``manifest``, it also has to be the one stored with the table, and its
    columns have to be in the files: a table of other columns, mode, pool or
    sources is stale.
    """
    if not (exists(spark, f"{path}/_SUCCESS") and all(exists(spark, f"{path}/split={s}") for s in splits)):
        return False
    if manifest is None:
        return True
    return read_manifest(spark, path) == manifest and set(manifest["columns"]) <= set(spark.read.parquet(path).columns)


def ensure_prepared(
    spark: SparkSession, path: str, splits: Sequence[str], build, force: bool = False, manifest: dict | None = None
) -> DataFrame:
    """Read the prepared table, building it first where it is missing, incomplete or stale."""
    if force or not is_prepared(spark, path, splits, manifest):
        write_features(build(), path)
        if manifest is not None:
            spark.createDataFrame([(json.dumps(manifest),)], "manifest string").coalesce(1).write.mode("overwrite").text(_manifest_file(path))
    return spark.read.parquet(path)
