"""Tasks of a simulation run: who talks about which item, by one of four strategies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlake.operators import sampling
from cairnlake.operators.filters import usable_ids


def named_or_first(rows: DataFrame, *names: str) -> Column:
    """The first of ``names`` that ``rows`` has, else its first column."""
    return F.col(next((n for n in names if n in rows.columns), rows.columns[0]))


def optional(rows: DataFrame, *names: str) -> Column:
    """The first of ``names`` that ``rows`` has, else null."""
    return next((F.col(n) for n in names if n in rows.columns), F.lit(None))


def _tasks(rows: DataFrame) -> DataFrame:
    """(dialogue_id, user_id, target_id, copy) with ids as text; the dialogue's id is a digest of the other three."""
    text = rows.select(F.col("user_id").cast("string").alias("user_id"), F.col("target_id").cast("string").alias("target_id"), F.col("copy").cast("int").alias("copy"))
    return text.select(F.md5(F.concat_ws(":", F.coalesce("user_id", F.lit("")), F.coalesce("target_id", F.lit("")), "copy")).alias("dialogue_id"), "*")


def pairs(rows: DataFrame, per_pair: int = 1) -> DataFrame:
    """``per_pair`` dialogues of each row; users from user_id or userid, items from item_id or product_id, null where absent."""
    each = rows.select(optional(rows, "user_id", "userid").alias("user_id"), optional(rows, "item_id", "product_id").alias("target_id"))
    return _tasks(each.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(per_pair - 1)))))


def item_list(rows: DataFrame, users: DataFrame | None, per_item: int, seed: int) -> DataFrame:
    """``per_item`` dialogues of each listed item, with as many different random users, or without user where there are none.

    Items come from item_id or the first column, nulls left out. A listed item that repeats draws the same users again.
    Users are drawn by places in a seeded order that is shifted for each item, so items and users are never crossed.
    """
    listed = rows.select(named_or_first(rows, "item_id").cast("string").alias("target_id")).where("target_id IS NOT NULL")
    n = users.count() if users is not None else 0
    copies = listed.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(min(per_item, n) - 1 if n else per_item - 1))))
    if not n:
        return _tasks(copies.withColumn("user_id", F.lit(None).cast("string")))
    return _tasks(_drawn(copies, users.select(F.col("user_id").cast("string").alias("user_id")), "target_id", "user_id", n, seed))


def user_guest(rows: DataFrame, items: DataFrame, per_user: int, seed: int) -> DataFrame:
    """``per_user`` dialogues of each user about as many different random items; users from user_id or the first column."""
    listed = rows.select(named_or_first(rows, "user_id").cast("string").alias("user_id")).where("user_id IS NOT NULL")
    n = items.count()
    if not n:
        return _tasks(listed.select("user_id", F.lit(None).alias("target_id"), F.lit(0).alias("copy")).limit(0))
    copies = listed.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(min(per_user, n) - 1))))
    return _tasks(_drawn(copies, items.select(F.col("item_id").cast("string").alias("target_id")), "user_id", "target_id", n, seed))


def random_items(items: DataFrame, dialogues: int, seed: int) -> DataFrame:
    """``dialogues`` dialogues without user, each about a random item; items may repeat, unusable ids are left out."""
    drawn = sampling.with_replacement(usable_ids(items, "item_id").select(F.col("item_id").cast("string").alias("item_id")), "item_id", dialogues, seed)
    return _tasks(drawn.select(F.lit(None).alias("user_id"), F.col("item_id").alias("target_id"), F.col("draw").alias("copy")))


def _drawn(copies: DataFrame, pool: DataFrame, key: str, drawn: str, n: int, seed: int) -> DataFrame:
    """Each key's copies meet places ``(start of the key + copy) mod n`` of the pool's seeded order."""
    start = F.floor(sampling.uniform(seed, F.col(key)) * n).cast("long")
    placed = sampling.numbered(pool, drawn, seed)
    return copies.withColumn("place", F.pmod(start + F.col("copy"), F.lit(n))).join(placed, "place").drop("place")


def interleaved(rows: DataFrame, flag: str, key: str, seed: int, first: int = 3) -> DataFrame:
    """(key, flag, place): ``first`` rows with the flag, then one without, and so on, each side in its seeded order.

    Where one side is used up the other goes on without gaps. Places are counted in slices; no window holds a whole side.
    """
    sides = [sampling.numbered(rows.where(c), key, seed).withColumn(flag, F.lit(v)) for c, v in ((F.col(flag), True), (~F.col(flag), False))]
    a, b = (s.agg(F.count("*").alias(n)) for s, n in zip(sides, ("__a", "__b"), strict=True))
    both = sides[0].unionByName(sides[1]).crossJoin(F.broadcast(a.crossJoin(b)))
    p = F.col("place")
    place = F.when(F.col(flag), p + F.least(F.floor(p / first), F.col("__b"))).otherwise(p + F.least((p + 1) * first, F.col("__a")))
    return both.select(key, flag, place.cast("long").alias("place"))
