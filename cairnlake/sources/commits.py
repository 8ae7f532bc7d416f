"""A cache filled in commits: each is whole or absent, readers see it at once, and a killed run goes on behind the last one."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlake.operators.order import placed, same_keys
from cairnlake.session import durable, remove


def _files(spark: SparkSession, path: str) -> tuple[object, Callable[[str], object]]:
    place = spark._jvm.org.apache.hadoop.fs.Path
    return place(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def commits(spark: SparkSession, path: str) -> list[str]:
    """Names of the committed batches, the first one first."""
    files, place = _files(spark, path)
    log = place(f"{path}/commits")
    return sorted(s.getPath().getName() for s in files.listStatus(log)) if files.exists(log) else []


def read_commits(spark: SparkSession, path: str) -> DataFrame | None:
    """All committed rows with the name of their ``commit``; None before the first one. Batches without a commit are not read."""
    names = commits(spark, path)
    if not names:
        return None
    rows = spark.read.parquet(*(f"{path}/batches/{n}" for n in names))
    return rows.withColumn("commit", F.regexp_extract(F.input_file_name(), r"/batches/([^/]+)/", 1))


def fill(fresh: DataFrame, path: str, key: list[str], make: Callable[[DataFrame], DataFrame], rows_a_commit: int = 100_000, jobs: int = 32) -> int:
    """Add ``make`` of the rows whose key is not committed yet, ``rows_a_commit`` by key order at a time; the number of commits made.

    ``make`` may be costly (a call of a model a row) and returns the key: a run that ends at any point has lost one job at
    most, and repeating it asks for nothing that is committed. A job is one commit; of more than ``jobs`` commits, a
    ``jobs``-th part of them, which are written together and committed one after the other. Of rows that repeat a key one
    is taken. A commit is the creation of one empty file, which succeeds once.
    """
    spark = fresh.sparkSession
    files, place = _files(spark, path)
    held = read_commits(spark, path)
    new = fresh.dropDuplicates(key)
    if held is not None:
        new = new.join(held.select(*key), key, "left_anti")
    rows = durable(placed(durable(new), [], key, place="__place", size="__size"), "__place")
    n, done = rows.count(), len(commits(spark, path))
    made = -(-n // rows_a_commit)
    names = [f"{done + i:012d}-{uuid.uuid4().hex}" for i in range(made)]
    each = max(1, -(-made // jobs))
    for first in range(0, made, each):
        own = names[first : first + each]
        begin = first * rows_a_commit
        part = rows.where(F.col("__place").between(begin, begin + each * rows_a_commit - 1))
        if each == 1:
            make(part.drop("__place", "__size")).write.parquet(f"{path}/batches/{own[0]}")
        else:
            whose = part.select(*key, F.floor((F.col("__place") - begin) / rows_a_commit).cast("long").alias("__commit"))
            fresh_rows = same_keys(make(part.drop("__place", "__size")), whose, key)
            staged = f"{path}/staged/{own[0]}"
            fresh_rows.repartition("__commit").write.partitionBy("__commit").parquet(staged)
            for i, name in enumerate(own):
                _moved(files, place, f"{staged}/__commit={i}", f"{path}/batches/{name}")
            remove(spark, staged)
        for name in own:
            if not files.createNewFile(place(f"{path}/commits/{name}")):
                raise FileExistsError(name)
    return made


def _moved(files: object, place: Callable[[str], object], source: str, target: str) -> None:
    files.mkdirs(place(target).getParent())
    if not files.rename(place(source), place(target)):
        raise OSError(f"{source} can't be renamed to {target}")
