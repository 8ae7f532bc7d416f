"""User profiles from ratings: favourite values, sample titles, long- and short-term tastes, and the catalogue's clean-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnlake.operators import sampling


def top_values(rows: DataFrame, user: str, value: str, order: list[str], k: int = 8, separator: str | None = ",") -> DataFrame:
    """(user, rank, value, n): the ``k`` commonest values of each user, ties by first appearance.

    ``separator`` parts a field of several values; blanks are left out. Counts and first places combine before the shuffle.
    """
    parts = F.split(F.col(value), separator) if separator else F.array(F.col(value))
    each = rows.select(user, *order, F.posexplode(parts).alias("__pos", "__value")).withColumn("__value", F.trim("__value")).where("__value <> ''")
    counted = each.groupBy(user, "__value").agg(F.count("*").alias("n"), F.min(F.struct(*order, "__pos")).alias("__first"))
    rank = F.row_number().over(Window.partitionBy(user).orderBy(F.desc("n"), "__first"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= k).select(user, "rank", F.col("__value").alias("value"), "n")


def sample_titles(rows: DataFrame, user: str, title: str, item: str, k: int = 8) -> DataFrame:
    """(user, titles): the first ``k`` distinct rated items' titles in catalogue order, joined by bars."""
    once = rows.where(F.col(title).isNotNull()).select(user, item, title).distinct()
    ranked = once.withColumn("n", F.row_number().over(Window.partitionBy(user).orderBy(item))).where(F.col("n") <= k)
    return ranked.groupBy(user).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", title))), lambda x: x[title]), "|").alias("titles"))


def taste_windows(rows: DataFrame, user: str, ts: str, value: str, asof: Column, days: int) -> DataFrame:
    """(user, n_long, n_short, mean_long, mean_short, fallback): all rows and those of the last ``days``.

    Without recent rows the short-term taste is the long-term one and ``fallback`` is true.
    """
    recent = F.col(ts) >= asof - F.make_interval(days=F.lit(days))
    seen = rows.groupBy(user).agg(F.count("*").alias("n_long"), F.count_if(recent).alias("n_short"), F.avg(value).alias("mean_long"), F.avg(F.when(recent, F.col(value))).alias("__short"))
    return seen.select(user, "n_long", "n_short", "mean_long", F.coalesce("__short", "mean_long").alias("mean_short"), (F.col("n_short") == 0).alias("fallback"))


def parsed_timestamps(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with ts: seconds since 1970 if any value of the column is a number, else ISO text; bad values are null."""
    number = F.col(column).cast("string").try_cast("double")
    numeric = rows.agg(F.max(number.isNotNull())).first()[0]
    return rows.withColumn("ts", F.timestamp_seconds(number) if numeric else F.try_to_timestamp(F.col(column).cast("string")))


def rescaled_rating(rating: Column) -> Column:
    """1 to 10 as 1 to 5, halves to the even neighbour."""
    return F.greatest(F.lit(1), F.bround(rating / 2).cast("int"))


def iso_date(text: Column) -> Column:
    """``16 January 2005`` as 2005-01-16; null if it is no date."""
    return F.date_format(F.try_to_timestamp(text, F.lit("d MMMM yyyy")), "yyyy-MM-dd")


def active(rows: DataFrame, user: str, least: int = 3) -> DataFrame:
    return rows.groupBy(user).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def merged_products(rows: DataFrame, name: str, variant: str, key: str, first: list[str]) -> DataFrame:
    """One row of each name: its distinct variants sorted and joined, and the other fields of the row with the least key."""
    return rows.groupBy(name).agg(F.array_join(F.array_sort(F.collect_set(variant)), ", ").alias("variants"), F.count("*").alias("n"), F.min(key).alias(key), *(F.min_by(c, key).alias(c) for c in first))


def rated_exclusions(ratings: DataFrame, targets: DataFrame) -> DataFrame:
    """(user, target, n_excluded): how many distinct items each user has rated besides the target."""
    both = targets.join(ratings.select("user", "item").distinct(), "user", "left")
    return both.groupBy("user", "target").agg(F.count_if(F.col("item") != F.col("target")).alias("n_excluded"))


def excluded_items(ratings: DataFrame, targets: DataFrame) -> DataFrame:
    """(user, target, excluded): the distinct items each user has rated besides the target, sorted; ids as the ratings spell them."""
    both = targets.join(ratings.select("user", "item").distinct(), "user", "left")
    return both.groupBy("user", "target").agg(F.array_sort(F.collect_list(F.when(F.col("item") != F.col("target"), F.col("item")))).alias("excluded"))


def fresh_targets(users: DataFrame, items: DataFrame, history: DataFrame, seed: int) -> DataFrame:
    """(user, target): an item of the catalogue that each user has no history with, the first in the user's seeded order.

    Every user tries as many places of the items' seeded order as it has items in its history and one more, so that one
    is fresh; users without a fresh item are left out.
    """
    n = items.count()
    tries = users.select("user").join(history.groupBy("user").agg(F.countDistinct("item").alias("__n")), "user", "left")
    tries = tries.withColumn("__k", F.explode(F.sequence(F.lit(0), F.least(F.coalesce("__n", F.lit(0)), F.lit(n - 1)))))
    start = F.floor(sampling.uniform(seed, F.col("user")) * n).cast("long")
    placed = tries.withColumn("place", F.pmod(start + F.col("__k"), F.lit(n))).join(sampling.numbered(items, "item", seed), "place")
    fresh = placed.join(history.select("user", "item").distinct(), ["user", "item"], "left_anti")
    return fresh.groupBy("user").agg(F.min_by("item", "__k").alias("target"))
