"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

SESSION_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A skewed join may add a shuffle rather than leave one task with a third of the rows.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.ui.enabled": "false",
}


_local_folders: dict[str, str] = {}
_made: dict[str, list[str]] = {}


def build_session(master: str | None = None, app_name: str = "civigrade", **settings: str) -> SparkSession:
    """A session with the settings the library is written for; ``settings`` win."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A new folder name below the shared folder named by ``spark.checkpoint.dir``.

    Only a local session (unit tests, a laptop) may go without: it gets a temporary folder.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or _local_folder(spark)
    path = f"{shared.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clear_scratch(spark: SparkSession) -> int:
    """Delete the folders this application has made so far; returns their number.

    For the end of a job: tables that were not yet computed or written elsewhere still read from them.
    """
    paths = _made.pop(spark.sparkContext.applicationId, [])
    configuration = spark._jsc.hadoopConfiguration()
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(configuration).delete(place, True)
    return len(paths)


def _local_folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    if context.applicationId not in _local_folders:
        _local_folders[context.applicationId] = tempfile.mkdtemp(prefix="civigrade-")
    return _local_folders[context.applicationId]


def materialise(df, label: str):
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = scratch_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
