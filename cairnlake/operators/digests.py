"""Ordered digests: a hash tree over the rows of a table in an order, so that a change, or a swap of two rows, changes it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnlake.operators.order import placed
from cairnlake.session import durable

#: Vector components are digested as multiples of 2^-60: exact for float32 from a magnitude of 2^-36 on.
UNIT = 2.0**60


def row_text(schema: T.StructType, columns: list[str]) -> Column:
    """The columns of a row as one string that tells null from blank and where each value ends.

    Each value is its length in bytes, a colon and its text; null is ``-``. A vector is its components' multiples of 2^-60.
    """
    parts = []
    for name in columns:
        value, kind = F.col(name), schema[name].dataType
        if isinstance(kind, T.ArrayType):
            text = F.array_join(F.transform(value, lambda x: F.floor(x.cast("double") * UNIT).cast("decimal(38,0)").cast("string")), " ", "-")
        else:
            text = value.cast("string")
        parts.append(F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    return F.concat(*parts)


def ordered_digest(rows: DataFrame, order: list[str], columns: list[str], fan: int = 256) -> tuple[int, str]:
    """(rows, digest): sha256 of each row, of every ``fan`` consecutive digests joined, and so on until one is left.

    No task holds more than its share of rows or ``fan`` digests. ``order`` must tell the rows apart, else equal ones may
    swap. An empty table has the digest of the empty text.
    """
    hashed = rows.select(*dict.fromkeys(order), F.sha2(row_text(rows.schema, columns), 256).alias("__node"))
    level = placed(durable(hashed), [], order, place="__place", size="__size").select("__place", "__node", "__size")
    n = level.agg(F.max("__size").alias("n")).first()["n"] or 0
    left = n
    while left > 1:
        runs = level.groupBy(F.floor(F.col("__place") / fan).cast("long").alias("__place")).agg(F.array_sort(F.collect_list(F.struct(F.col("__place").alias("at"), "__node"))).alias("own"))
        level = durable(runs.select("__place", F.sha2(F.array_join(F.transform("own", lambda x: x["__node"]), ""), 256).alias("__node")))
        left = -(-left // fan)
    top = level.first()
    return n, top["__node"] if top else "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
