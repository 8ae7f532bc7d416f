"""Fuzzy title lookup by the indel ratio 200 LCS / (|a| + |b|)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from cairnlake.session import durable


def comparable(title: Column) -> Column:
    """Lower case, everything but letters and digits as one space each, trimmed."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"[^\p{L}\p{N}]", " "))


@F.pandas_udf(DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Longest common subsequence with a row of bits for each character; 100 for two empty texts."""

    def ratio(x: str, y: str) -> float:
        where: dict[str, int] = {}
        for i, c in enumerate(x):
            where[c] = where.get(c, 0) | 1 << i
        full = (1 << len(x)) - 1
        row = full
        for c in y:
            both = row & where.get(c, 0)
            row = ((row + both) | (row - both)) & full
        return 200.0 * (len(x) - row.bit_count()) / (len(x) + len(y)) if x or y else 100.0

    return pd.Series([ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def numbered_pairs(text: Column) -> Column:
    """Neighbouring characters of a text, each pair with the number of its occurrence, so that all are different."""
    size = F.char_length(text)
    pairs = F.when(size > 1, F.transform(F.sequence(F.lit(1), F.greatest(size - 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    return F.transform(pairs, lambda p, i: F.concat(p, F.size(F.filter(F.slice(pairs, F.lit(1), i + 1), lambda q: q == p)).cast("string")))


def best_titles(lookups: DataFrame, titles: DataFrame, cutoff: float = 80.0) -> DataFrame:
    """(lookup_id, item_id, ratio) of the best title of each lookup with at least ``cutoff``, ties the smaller item_id.

    A ratio of ``cutoff`` bounds the lengths of a pair and, for each length, how many neighbouring characters both share:
    a character left out breaks two pairs of the lookup, one put in breaks one. So it is enough to meet the titles that
    have one of the lookup's rarest pairs, of as many as can't all be missing. Where no pair need be shared (texts of up to
    two characters, or of three beside two) titles meet by length alone. Lookups without letters and digits find nothing.
    """
    least = cutoff / (200 - cutoff)
    want = lookups.select("lookup_id", comparable(F.col("title")).alias("a"))
    have = durable(titles.select("item_id", comparable(F.col("title")).alias("b")).withColumn("size", F.char_length("b")))
    grams = have.select("item_id", "size", F.explode(numbered_pairs(F.col("b"))).alias("gram"))
    n = F.char_length("a")
    want = want.where(n > 0).withColumn("n", n)
    common = F.ceil(F.lit(cutoff) * (F.col("n") + F.col("size")) / 200 - 1e-9)
    shared = (F.col("n") - 1) - 2 * (F.col("n") - common) - (F.col("size") - common)
    sized = want.withColumn("size", F.explode(F.sequence(F.ceil(n * least).cast("int"), F.floor(n / least).cast("int")))).withColumn("shared", shared)
    often = grams.groupBy("gram").agg(F.count("*").alias("df"))
    ranked = want.select("lookup_id", F.explode(numbered_pairs(F.col("a"))).alias("gram")).join(often, "gram", "left")
    ranked = ranked.withColumn("r", F.row_number().over(Window.partitionBy("lookup_id").orderBy(F.coalesce("df", F.lit(0)), "gram")))
    asked = sized.where("shared > 0").join(ranked, "lookup_id").where(F.col("r") <= F.col("n") - F.col("shared"))
    met = asked.join(grams, ["gram", "size"]).select("lookup_id", "item_id").distinct()
    short = sized.where("shared <= 0").join(have, "size").select("lookup_id", "item_id")
    pairs = met.unionByName(short).join(want.select("lookup_id", "a"), "lookup_id").join(have.select("item_id", "b"), "item_id")
    scored = pairs.withColumn("ratio", indel_ratio("a", "b")).where(F.col("ratio") >= cutoff)
    order = Window.partitionBy("lookup_id").orderBy(F.col("ratio").desc(), "item_id")
    return scored.withColumn("n", F.row_number().over(order)).where("n = 1").select("lookup_id", "item_id", "ratio")
