"""Deterministic samples: rows are ordered by md5 of a seed and their id, so a sample is the same in every run and engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ticket(seed: int, *ids: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(i.cast("string") for i in ids)))


def uniform(seed: int, *ids: Column) -> Column:
    """A number in (0, 1) from the first twelve hex digits of the ticket."""
    return (F.conv(F.substring(ticket(seed, *ids), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def without_replacement(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows in random order, or all if there are fewer."""
    return rows.orderBy(ticket(seed, F.col(key)), key).limit(n)


def per_group(rows: DataFrame, group: str, key: str, n: int | Column, seed: int) -> DataFrame:
    """At most ``n`` random rows of each group."""
    order = Window.partitionBy(group).orderBy(ticket(seed, F.col(group), F.col(key)), key)
    return rows.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= n).drop("__n")


def numbered(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """(key, place): places 0, 1, ... in the order of the tickets.

    Ranks are taken inside 4096 slices of the ticket and shifted by the sizes of the slices before, so no window holds all rows.
    """
    own = rows.select(key, ticket(seed, F.col(key)).alias("__t")).withColumn("__s", F.substring("__t", 1, 3))
    sizes = own.groupBy("__s").agg(F.count("*").alias("__c"))
    before = Window.orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("__s", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__o"))
    inside = F.row_number().over(Window.partitionBy("__s").orderBy("__t", key)) - 1
    return own.withColumn("__r", inside).join(F.broadcast(sizes), "__s").select(key, (F.col("__o") + F.col("__r")).cast("long").alias("place"))


def with_replacement(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """(draw, key): ``n`` independent draws of a place in the order of the tickets."""
    total = rows.count()
    draws = rows.sparkSession.range(n).select(F.col("id").alias("draw"), F.floor(uniform(seed, F.lit("draw"), F.col("id")) * total).cast("long").alias("place"))
    return draws.join(numbered(rows, key, seed), "place").select("draw", key)


def matched(rows: DataFrame, reference: DataFrame, key: str, size: str, n: int, seed: int) -> DataFrame:
    """``n`` rows whose ``size`` follows the reference's histogram: weights by bin, keys ln(u) / weight, the greatest first.

    Rows in bins that the reference lacks have no weight and are never drawn.
    """
    bins = reference.groupBy(size).agg(F.count("*").alias("__w"))
    own = rows.groupBy(size).agg(F.count("*").alias("__c"))
    weighted = rows.join(bins.join(own, size), size).withColumn("__key", F.round(F.ln(uniform(seed, F.col(key))) * F.col("__c") / F.col("__w"), 9))
    return weighted.orderBy(F.desc("__key"), key).limit(n).drop("__w", "__c", "__key")


def stratified(rows: DataFrame, stratum: str, key: str, n: int, seed: int) -> DataFrame:
    """About ``n`` rows with the strata's shares; each share is rounded with halves to the even neighbour."""
    shares = rows.groupBy(stratum).agg(F.count("*").alias("__c"))
    total = shares.agg(F.sum("__c").alias("__t"))
    sized = rows.join(shares.crossJoin(F.broadcast(total)).select(stratum, F.bround(n * F.col("__c") / F.col("__t")).alias("__k")), stratum)
    return per_group(sized, stratum, key, F.col("__k"), seed).drop("__k")


def happens(p: float, seed: int, *ids: Column) -> Column:
    """A switch that is on with probability ``p``."""
    return uniform(seed, *ids) < p


def picked(pool: list[str], seed: int, *ids: Column) -> Column:
    """One of the pool's phrases."""
    return F.element_at(F.array(*map(F.lit, pool)), (F.floor(uniform(seed, *ids) * len(pool)) + 1).cast("int"))
