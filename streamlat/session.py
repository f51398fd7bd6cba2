"""Session settings and the shared folder used for checkpoints and written results."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings the results depend on. Partition counts, memory and parallelism are
# left to whoever submits the job.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def build_session(app: str, *, master: str | None = None, parallelism: int | None = None,
                  **settings: str) -> SparkSession:
    """A session with the fixed settings; `parallelism` sets the shuffle width."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = {**SETTINGS, **settings}
    if parallelism:
        conf["spark.sql.shuffle.partitions"] = str(parallelism)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def apply_settings(spark: SparkSession) -> SparkSession:
    """Put the fixed settings on a session somebody else built."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by `spark.checkpoint.dir`.

    In local mode an unset value falls back to a fresh temporary folder; on a
    cluster that would be a folder only one machine sees, so it is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    return tempfile.mkdtemp(prefix="streamlat-")


def new_dir(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path."""
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(context._jsc.hadoopConfiguration()), target


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """The folders in `path`, which need not be there, as `path/name`."""
    files, target = file_system(spark, path)
    if not files.exists(target):
        return []
    return sorted(f"{path}/{status.getPath().getName()}" for status in files.listStatus(target) if status.isDirectory())


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders with what is in them."""
    for path in paths:
        files, target = file_system(spark, path)
        files.delete(target, True)
