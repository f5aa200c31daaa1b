"""Session settings for tests, the bench and stand-alone jobs."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "rankloom") -> SparkSession:
    """Single-JVM session; a cluster brings its own settings."""
    # the Arrow workers run one numpy kernel each; more threads only fight for cores
    os.environ.setdefault("OMP_NUM_THREADS", "1")
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        # call-site capture for every Column costs more than building the plan
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    tune(spark)
    return spark


def tune(spark: SparkSession) -> SparkSession:
    """Run-time SQL settings every plan in this package relies on."""
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    # a hot join key is split even where that costs one more exchange downstream
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that iterative jobs cut their lineage in.

    A cluster names it in ``spark.checkpoint.dir``; only where that is unset
    (tests, a laptop) is a folder of our own chosen.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current is not None:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        import tempfile

        master = spark.sparkContext.master
        if not master.startswith("local") or "cluster" in master:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")

        named = tempfile.mkdtemp(prefix="spark-")
    spark.sparkContext.setCheckpointDir(named)
    return named
