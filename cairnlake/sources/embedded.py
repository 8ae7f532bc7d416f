"""Catalogues with vectors: from a column of theirs, or computed through a cache that outlives the run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlake.functions.vectors import checked_size
from cairnlake.operators.metrics import embedding_plan
from cairnlake.operators.providers import EmbeddingProvider, hashed_embedding, with_embedding
from cairnlake.session import durable
from cairnlake.sources.commits import fill, read_commits
from cairnlake.sources.readers import parsed_vectors

KEY = ["item_key", "text_sha256", "model"]


class EmbeddingsNeeded(ValueError):
    """More texts are missing from the cache than the caller allows to embed; ``plan`` says what it would take."""

    def __init__(self, plan: dict[str, int], most: int) -> None:
        super().__init__(f"{plan['misses']} of {plan['n_rows']} items are not in the cache ({plan['requests']} requests, about {plan['tokens']} tokens), {most} may be embedded")
        self.plan = plan


def computed_vectors(items: DataFrame, cache: str, model: str, make: Callable[[], EmbeddingProvider] = hashed_embedding, most: int | None = 0, text: str = "search_text", item_id: str = "item_id", name: str = "vector", rows_a_commit: int = 100_000) -> DataFrame:
    """``items`` with the vector of their text from ``cache``, after those that it lacks were embedded.

    A vector belongs to (item, text, model): a changed text asks again. ``most``: None for no limit, else how many texts may
    be embedded, checked before the first call. Texts are embedded and committed ``rows_a_commit`` at a time, so that a run
    that fails keeps what it has. Null texts count as empty. A provider that returns nothing usable is an error.
    """
    spark = items.sparkSession
    keyed = items.withColumns({"item_key": F.col(item_id).cast("string"), "__text": F.coalesce(text, F.lit(""))}).withColumns({"text_sha256": F.sha2("__text", 256), "model": F.lit(model)})
    wanted = durable(keyed.select(*KEY, F.col("__text").alias("text")).dropDuplicates(KEY))
    held = read_commits(spark, cache)
    known = held.select(*KEY) if held is not None else wanted.select(*KEY).limit(0)
    plan = embedding_plan(wanted, known, KEY).first().asDict()
    if most is not None and plan["misses"] > most:
        raise EmbeddingsNeeded(plan, most)

    def embed(rows: DataFrame) -> DataFrame:
        bad = F.col("v").isNull() | (F.size("v") == 0) | F.exists("v", lambda x: x.isNull() | F.isnan(x))
        checked = F.when(bad, F.raise_error(F.lit("the provider returned no usable vector"))).otherwise(F.col("v"))
        return with_embedding(rows, "text", "v", make).select(*KEY, checked.cast("array<double>").alias("cached"))

    fill(wanted, cache, KEY, embed, rows_a_commit)
    filled = read_commits(spark, cache)
    if filled is None:  # an empty catalogue
        return keyed.withColumn(name, F.lit(None).cast("array<double>")).drop("__text", *KEY)
    return keyed.join(filled.select(*KEY, F.col("cached").alias(name)), KEY).drop("__text", *KEY)


def with_vectors(items: DataFrame, column: str | None, cache: str, model: str, **more: object) -> DataFrame:
    """``items`` with vectors of one length: those of ``column`` (rows that don't parse are dropped), else computed ones."""
    if column is not None and column in items.columns:
        out = parsed_vectors(items, column) if items.schema[column].dataType.simpleString() == "string" else items
        checked_size(out, column)
        return out
    out = durable(computed_vectors(items, cache, model, **more))
    checked_size(out, str(more.get("name", "vector")))
    return out
