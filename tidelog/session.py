"""Session settings the library relies on, and the shared scratch folder."""

from __future__ import annotations

import posixpath
import tempfile
import uuid

from pyspark.sql import SparkSession

# Runtime SQL settings: event times are UTC, and attribute keys that collide
# after lower-casing keep the last value instead of failing the row.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}

# With this setting a query's shuffle files go when it ends, not when the driver next collects garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_LOCAL_SCRATCH: dict[str, str] = {}


def prepare(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a temporary folder,
    since a driver-local path cannot be seen by the executors of a cluster.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_SCRATCH:
        _LOCAL_SCRATCH[app] = tempfile.mkdtemp(prefix="tidelog-")
    return _LOCAL_SCRATCH[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path under the scratch folder; nothing is ever overwritten."""
    return posixpath.join(scratch_root(spark), f"{label}-{uuid.uuid4().hex}")


def _write_and_read(df, path: str):
    spark = df.sparkSession
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def materialize(df, label: str = "step"):
    """Write ``df`` to the shared scratch folder and read it back.

    Cuts the lineage so that iterative jobs keep small plans and a lost
    executor re-reads files rather than recomputing every earlier step.
    The shuffle files behind ``df`` are freed once it is written.
    """
    return _write_and_read(df, scratch_path(df.sparkSession, label))


def delete(spark: SparkSession, folder: str) -> None:
    """Delete a folder of any file system, if it is there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Intermediate tables of one job, which can be freed before the session ends.

    A table must not be dropped while a DataFrame that reads it is still to
    be run: write what outlives the job with ``materialize``, then ``close``.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root, self._count = spark, scratch_path(spark, label), 0

    def put(self, df, name: str = "step"):
        """As ``materialize``; several tables may share a name."""
        self._count += 1
        return _write_and_read(df, f"{self.root}/{name}/{self._count}")

    def drop(self, *names: str) -> None:
        """Delete all tables of these names."""
        for name in names:
            delete(self.spark, f"{self.root}/{name}")

    def close(self) -> None:
        delete(self.spark, self.root)
