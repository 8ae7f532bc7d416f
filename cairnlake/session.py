"""Session factory, table access and durable intermediate tables."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "cairnlake", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with the settings the engine relies on; a cluster's own settings win where they are given."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, unless they find it by PYTHONPATH or the working folder as the driver does."""
    home = Path(__file__).resolve().parent
    found = [Path.cwd(), *map(Path, os.environ.get("PYTHONPATH", "").split(os.pathsep))]
    app = spark.sparkContext.applicationId
    if app in _SHIPPED or any(p.resolve() == home.parent for p in found):
        return
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="cairnlake-"), "cairnlake"), "zip", home.parent, home.name)
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of the dataset in ``sf_dir``, opened by Spark's own reader."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for intermediate results: ``spark.checkpoint.dir``, or the checkpoint folder the session was given.

    On a local master that has neither, a temporary folder is set; on a cluster, whose machines don't share one, that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="cairnlake-")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, kind: str = "table") -> str:
    """A new path under the shared folder, in the application's own part of it."""
    return os.path.join(checkpoint_root(spark), f"cairnlake-{spark.sparkContext.applicationId}", f"{kind}-{uuid.uuid4().hex}")


def durable(df: DataFrame, *sort: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back.

    This cuts the lineage: a lost executor costs only the tasks that ran on it, and later readers prune columns. The
    table lasts until :func:`discard` or :func:`clear_scratch`.
    """
    path = scratch_path(df.sparkSession)
    out = df.sortWithinPartitions(*sort) if sort else df
    out.write.parquet(path)
    held = df.sparkSession.read.schema(df.schema).parquet(path)
    held._scratch = path
    return held


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system that Spark knows."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def lean_shuffles(spark: SparkSession) -> Iterator[None]:
    """Remove the shuffle files of each action in the block once it ends, for steps that go on from written tables."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def discard(*frames: DataFrame) -> None:
    """Delete tables of :func:`durable` that no later action reads; other frames are left alone."""
    for df in frames:
        if path := getattr(df, "_scratch", None):
            remove(df.sparkSession, path)


def clear_scratch(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application, once its results are written."""
    remove(spark, os.path.dirname(scratch_path(spark)))
