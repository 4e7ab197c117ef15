"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str, master: str | None = None, **settings: str) -> SparkSession:
    """Session with the library's settings; keyword names take `__` for a dot."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    named = {k.replace("__", "."): v for k, v in settings.items()}
    for key, value in {**SETTINGS, **named}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@cache
def _own_folder() -> str:
    """One temporary folder for this process, of a local session only."""
    return tempfile.mkdtemp(prefix="pelagrid-")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one the cluster names in spark.checkpoint.dir.

    Only a local session may go without that setting: its executors share the
    driver's disk, and it gets a temporary folder. No setting is changed.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = _own_folder()
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def written(frame: DataFrame, path: str | None = None) -> DataFrame:
    """The frame computed once into the shared folder, a new one below it unless named, and read back. It cuts the
    lineage, survives the loss of executors, and scans by column afterwards."""
    path = path or shared_folder(frame.sparkSession)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Removes a folder of tables that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
