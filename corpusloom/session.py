"""Session factory and table access shared by queries, tests and the benchmark."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "6g") -> SparkSession:
    """A local session with the settings the queries are tested under."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("corpusloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def data_dir(scale: str) -> str:
    return os.path.join(os.environ.get("TESTDATA", "/root/testdata"), scale)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; set here only where a local session has none (tests)."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known is None:
        if not held.isDefined() and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        known = held.get() if held.isDefined() else "file://" + tempfile.mkdtemp(prefix="corpusloom-")
    if not held.isDefined():
        spark.sparkContext.setCheckpointDir(known)
    return known.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The same rows read from the shared checkpoint folder: lineage ends here and survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
