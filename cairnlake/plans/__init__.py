"""Registered queries of the engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = tuple[Callable[[SparkSession, str], DataFrame], str | None]


def registry() -> dict[str, Query]:
    """Every query by name, with its DuckDB SQL or None."""
    from cairnlake.plans import analytics, corpora, dialogues, lookup, preferences, retrieval, runs

    return {**retrieval.QUERIES, **preferences.QUERIES, **analytics.QUERIES, **dialogues.QUERIES, **runs.QUERIES, **corpora.QUERIES, **lookup.QUERIES}
