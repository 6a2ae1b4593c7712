"""Sessions and where Python workers find this package."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings that queries here rely on; a cluster's own values win where they are set.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(master: str | None = None, name: str = "siltstone", **more: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for k, v in {**SETTINGS, **more}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return on_executors(spark)


def on_executors(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from where the driver has it (on a cluster: ship it with --py-files)."""
    home, env = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    if home not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH", ""), home]))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return on_executors(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.  Only a local master, whose executors are the
    driver itself, may do without it; elsewhere each executor would write to a disk of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir is not set: it has to name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="siltstone-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def _hadoop(spark: SparkSession, path: str):  # noqa: ANN202
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at  # noqa: SLF001


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the application's folder of the shared one, which goes when the driver's process ends."""
    home = f"{shared_dir(spark)}/siltstone-{spark.sparkContext.applicationId}"
    fs, at = _hadoop(spark, home)
    if not fs.exists(at):
        fs.mkdirs(at)
        fs.deleteOnExit(at)
    return f"{home}/{name}-{uuid.uuid4().hex}"


def removed(spark: SparkSession, *paths: str) -> None:
    """Deletes intermediate tables that nothing reads any more."""
    for path in paths:
        fs, at = _hadoop(spark, path)
        fs.delete(at, True)
