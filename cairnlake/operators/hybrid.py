"""Hybrid retrieval: filters, exact neighbours, BM25 on the candidates, profile-aware fusion, gate and final ranking."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnlake.functions import vectors as V
from cairnlake.operators import bm25
from cairnlake.operators.knn import Mask, nearest
from cairnlake.session import durable


@dataclass(frozen=True)
class Weights:
    """Parameters of a retrieval call; the defaults are those the engine ships with."""

    bm25: float = 0.3
    base: float = 0.7
    short: float = 0.3
    threshold: float = 0.3
    k: int = 10


def candidates(index: bm25.TextIndex, queries: DataFrame, items: DataFrame, weights: Weights = Weights(), mask: Mask | None = None) -> DataFrame:
    """(query_id, item_id, knn_rank, cos_score, bm25_norm, base_score) of the 3 k nearest admitted items of each query.

    queries: (query_id, vector, text, ...); BM25 never adds an item, and is scaled over its hits among the candidates.
    The neighbours are written once, at most 3 k rows a query.
    """
    return rated(index, queries, neighbours(queries, items, weights, mask), weights)


def neighbours(queries: DataFrame, items: DataFrame, weights: Weights = Weights(), mask: Mask | None = None) -> DataFrame:
    """(query_id, item_id, knn_rank, cos_score) of the 3 k nearest admitted items of each query, a written table."""
    return durable(nearest(queries, items, 3 * weights.k, mask).withColumnRenamed("rank", "knn_rank"))


def rated(index: bm25.TextIndex, queries: DataFrame, near: DataFrame, weights: Weights = Weights()) -> DataFrame:
    """``near`` with bm25_norm and base_score."""
    hits = bm25.scaled(bm25.scores(index, queries, near))
    both = near.join(hits, ["query_id", "item_id"], "left").withColumn("bm25_norm", F.coalesce("bm25_norm", F.lit(0.0)))
    return both.select("query_id", "item_id", "knn_rank", "cos_score", "bm25_norm", (weights.bm25 * F.col("bm25_norm") + (1 - weights.bm25) * F.col("cos_score")).alias("base_score"))


def with_profiles(found: DataFrame, queries: DataFrame, items: DataFrame, weights: Weights = Weights()) -> DataFrame:
    """``found`` with score: the base blended with the similarity to the long and short profile of the query.

    queries: (query_id, long_profile, short_profile); without a long profile the base counts alone, without a short one the long.
    """
    rows = found.join(queries.select("query_id", "long_profile", "short_profile"), "query_id").join(items.select("item_id", "vector"), "item_id")
    long = V.as_share(V.cosine(F.col("vector"), F.col("long_profile")))
    short = V.as_share(V.cosine(F.col("vector"), F.col("short_profile")))
    taste = F.when(F.col("short_profile").isNull(), long).otherwise(weights.short * short + (1 - weights.short) * long)
    score = F.when(F.col("long_profile").isNull(), F.col("base_score")).otherwise(weights.base * F.col("base_score") + (1 - weights.base) * taste)
    return rows.withColumn("score", score).drop("vector", "long_profile", "short_profile")


def gated(found: DataFrame, threshold: float) -> DataFrame:
    """The candidates of queries whose greatest base score reaches the threshold."""
    return found.withColumn("__max", F.max("base_score").over(Window.partitionBy("query_id"))).where(F.col("__max") >= threshold).drop("__max")


def status(found: DataFrame, queries: DataFrame, threshold: float) -> DataFrame:
    """(query_id, n_candidates, max_base_score, exit_path) of every query."""
    seen = found.groupBy("query_id").agg(F.count("*").alias("n_candidates"), F.max("base_score").alias("max_base_score"))
    path = F.when(F.col("vector").isNull(), "no_embedding").when(F.coalesce("max_base_score", F.lit(-1.0)) < threshold, "gate_failed").otherwise("gate_passed")
    return queries.select("query_id", "vector").join(seen, "query_id", "left").select("query_id", F.coalesce("n_candidates", F.lit(0)).cast("long").alias("n_candidates"), "max_base_score", path.alias("exit_path"))


def ranked(scored: DataFrame, k: int) -> DataFrame:
    """The ``k`` best by score to nine places; ties keep the neighbours' order."""
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "knn_rank")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(index: bm25.TextIndex, queries: DataFrame, items: DataFrame, weights: Weights = Weights(), mask: Mask | None = None) -> DataFrame:
    """One retrieval call for each query: (query_id, rank, item_id, score, base_score, cos_score, bm25_norm)."""
    checked_dimension(queries, items)
    found = gated(candidates(index, queries, items, weights, mask), weights.threshold)
    out = ranked(with_profiles(found, queries, items, weights), weights.k)
    return out.select("query_id", "rank", "item_id", "score", "base_score", "cos_score", "bm25_norm")


def first_items(queries: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, item_id): the first ``k`` items in catalogue order for queries without an embedding.

    items hold the columns query_id (null admits every query) or are already filtered; the list is the same ``k`` rows for
    each query, so those alone are joined.
    """
    head = items.orderBy("item_id").limit(k).withColumn("rank", F.row_number().over(Window.orderBy("item_id")))
    return queries.select("query_id").join(F.broadcast(head.select("rank", "item_id")))


def overlap(queries: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """(query_id, jaccard) of two result lists (query_id, item_id); 1 for a query without a hit in either."""
    a, b = (d.select("query_id", "item_id", F.lit(True).alias(n)) for d, n in ((first, "__a"), (second, "__b")))
    met = a.join(b, ["query_id", "item_id"], "full_outer").groupBy("query_id").agg((F.count_if(F.col("__a") & F.col("__b")) / F.count("*")).alias("jaccard"))
    return queries.select("query_id").distinct().join(met, "query_id", "left").select("query_id", F.coalesce("jaccard", F.lit(1.0)).alias("jaccard"))


def checked_dimension(queries: DataFrame, items: DataFrame, vector: str = "vector") -> int:
    """The one length of all vectors of both tables; an error names the lengths if there are several, or none."""
    sizes = queries.select(F.size(vector).alias("n"), F.lit("queries").alias("side")).unionAll(items.select(F.size(vector), F.lit("items")))
    seen = sizes.where("n >= 0").groupBy("side").agg(F.min("n").alias("low"), F.max("n").alias("high")).collect()
    found = {n for r in seen for n in (r["low"], r["high"])}
    if len(found) != 1:
        raise ValueError(f"vectors of queries and items differ in length: {sorted((r['side'], r['low'], r['high']) for r in seen)}")
    return found.pop()


def offered(results: DataFrame, refused: DataFrame, keys: list[str], item: str, order: list[str], n: int) -> DataFrame:
    """(keys, item, place) of the first ``n`` results of each key that were not refused; of an item that repeats, the first."""
    kept = results.join(refused.select(*keys, item).distinct(), [*keys, item], "left_anti")
    once = kept.groupBy(*keys, item).agg(F.min(F.struct(*order)).alias("__first"))
    return once.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("__first"))).where(F.col("place") <= n).drop("__first")
