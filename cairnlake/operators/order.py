"""Places of rows in a total order, without a window or a task that holds a group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnlake.session import durable


def same_keys(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner", extra: Column | None = None) -> DataFrame:
    """Join of two tables on ``keys`` where null meets null; the keys of ``b`` go."""
    right = b.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    on = extra
    for k in keys:
        one = a[k].eqNullSafe(right[f"__r_{k}"])
        on = one if on is None else on & one
    return a.join(right, on, how).drop(*(f"__r_{k}" for k in keys))


def placed(rows: DataFrame, groups: list[str], order: list[str], place: str = "place", size: str = "group_size", part: str | None = None) -> DataFrame:
    """``rows`` with ``place``, from 0 in each group by ``order`` (ascending, nulls first), and the group's ``size``.

    Rows are dealt by range over (groups, order), so a group of any size spreads over many tasks; each task numbers its own
    rows, and one row a group and task (a count) gives the shift. Rows that are equal in groups and order are dealt by a salt,
    too, and take their places in any order. An empty table gives an empty one. The result reads a written table. ``part``
    keeps the number of the range a row was dealt to; ranges ascend with places.
    """
    keys = [*groups, *order]
    ranged = rows.withColumn("__salt", F.monotonically_increasing_id()).repartitionByRange(*keys, "__salt").sortWithinPartitions(*keys, "__salt").drop("__salt")
    held = durable(ranged.withColumn("__at", F.monotonically_increasing_id()))
    own = F.shiftright("__at", 33)
    counts = held.groupBy(*groups, own.alias("__part")).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    whole = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("__n").over(whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = counts.select(*groups, "__part", (before - F.col("__first")).alias("__shift"), F.sum("__n").over(whole).alias(size))
    joined = same_keys(held.withColumn("__part", own), shifts, [*groups, "__part"])
    out = joined.withColumn(place, F.col("__at") + F.col("__shift")).drop("__at", "__shift")
    return out.withColumnRenamed("__part", part) if part else out.drop("__part")


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    done = 0
    for batch in batches:
        sizes = np.asarray(batch.column("__n"), np.int64)
        upto = done + np.cumsum(sizes)
        done = int(upto[-1]) if len(upto) else done
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(upto - sizes)], names=[*batch.schema.names, "__before"])


def laid_out(rows: DataFrame, order: list[str], size: Column, start: str = "start") -> tuple[DataFrame, int]:
    """``rows`` with ``start``, the sum of ``size`` over all rows before them by ``order``, and the sum over all rows.

    Each range adds up its own rows as they pass; the shift of a range comes from one row a range.
    """
    from pyspark.sql.types import LongType, StructType

    ranged = rows.withColumn("__n", F.coalesce(size.cast("long"), F.lit(0))).withColumn("__salt", F.monotonically_increasing_id())
    ranged = ranged.repartitionByRange(*order, "__salt").sortWithinPartitions(*order, "__salt").withColumn("__salt", F.monotonically_increasing_id())
    held = durable(ranged.mapInArrow(_running, StructType([*ranged.schema.fields]).add("__before", LongType())))
    own = F.shiftright("__salt", 33)
    parts = held.groupBy(own.alias("__part")).agg(F.sum("__n").alias("__sum"))
    before = F.sum("__sum").over(Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    shifts = parts.select("__part", F.coalesce(before, F.lit(0)).alias("__shift"))
    total = parts.agg(F.sum("__sum").alias("n")).first()["n"] or 0
    joined = held.withColumn("__part", own).join(F.broadcast(shifts), "__part")
    return joined.withColumn(start, F.col("__before") + F.col("__shift")).drop("__n", "__salt", "__part", "__before", "__shift"), total
