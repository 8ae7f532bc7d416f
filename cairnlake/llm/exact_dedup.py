"""Exact duplicates by a heavy-hitter split.

Misra-Gries summaries, one per partition, name the digests that may be frequent. Their exact counts and winners are
computed with map-side partial aggregation and broadcast (at most ``counters`` rows), so rows of a huge group are
decided where they lie. All other digests are light (fewer than ``rows / counters`` rows each); their winners are aggregated
with partial combination and joined back. Texts are never shuffled here.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlake.session import durable

#: Deleted before texts are compared.
WHITE_SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_SPACE, "")


def frequent_candidates(digests: DataFrame, column: str, counters: int) -> DataFrame:
    """At most ``counters`` values of ``column``, among them each that makes up more than 1 / ``counters`` of the rows.

    Every partition keeps a Misra-Gries summary; a summary undercounts by at most its rows / (counters + 1), and so does
    their sum. Nulls are no candidates. An empty table gives no rows.
    """

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.Series(dtype="int64")
        for batch in batches:
            held = held.add(batch[column].value_counts(), fill_value=0).astype("int64")
            if len(held) > counters:
                held = held - held.nlargest(counters + 1).iloc[-1]
                held = held[held > 0]
        yield pd.DataFrame({column: held.index.to_numpy(dtype=object), "seen": held.to_numpy()})

    parts = digests.select(column).mapInPandas(summarise, f"{column} binary, seen long")
    return parts.groupBy(column).agg(F.sum("seen").alias("seen")).where("seen > 1").orderBy(F.desc("seen"), column).limit(counters).select(column)


def _decided(docs: DataFrame, text: str, doc_id: str, counters: int) -> DataFrame:
    """doc_id, digest, size, row, best (the winner's rank) and group_size, a row for each row of ``docs``."""
    size = F.char_length(F.coalesce(F.col(text), F.lit("")))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.unhex(F.sha2(normalised(F.col(text)), 256)).alias("digest"), size.alias("size"))
    digests = durable(rows.withColumn("row", F.monotonically_increasing_id()))
    rank = F.struct((-F.col("size")).alias("size"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("doc_id"), F.col("row").alias("row"))

    candidates = frequent_candidates(digests, "digest", counters)
    winners = durable(digests.join(F.broadcast(candidates), "digest", "left_semi").groupBy("digest").agg(F.min(rank).alias("best"), F.count("*").alias("group_size")))
    heavy = digests.join(F.broadcast(winners), "digest")
    rest = digests.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    light = rest.join(rest.groupBy("digest").agg(F.min(rank).alias("best"), F.count("*").alias("group_size")), "digest")
    return heavy.select(*light.columns).unionAll(light).withColumn("kept", F.col("best.row") == F.col("row"))


def exact_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", counters: int = 1000) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are equal without the characters of ``[\\x20\\x09-\\x0D]``; null counts as empty. Of equal
    texts the longest original (code points) stays, then the smallest doc_id; a null doc_id comes after all others.
    Rows that repeat both id and text are one group like any other and exactly one of them is kept. Empty texts form one
    group. An empty table gives an empty result. Other columns of ``docs``, whatever their names, are not read.
    """
    return _decided(docs, text, doc_id, counters).select("doc_id", F.col("best.doc_id").alias("keep_id"), F.col("group_size").cast("long"), "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", counters: int = 1000) -> DataFrame:
    """The rows of ``docs`` that :func:`exact_duplicates` keeps, with all their columns.

    Rows that repeat a doc_id with different texts are decided each by its own text; of rows that repeat both, one stays.
    The join carries each text through one shuffle; its key holds id, digest and length, and nulls in it compare equal.
    """
    key = next(n for n in ("__key", *(f"__key{i}" for i in range(len(docs.columns) + 1))) if n not in docs.columns)
    stay = _decided(docs, text, doc_id, counters).where("kept").select(F.struct("doc_id", "digest", "size").alias(key))
    own = F.struct(F.col(doc_id).alias("doc_id"), F.unhex(F.sha2(normalised(F.col(text)), 256)).alias("digest"), F.char_length(F.coalesce(F.col(text), F.lit(""))).alias("size"))
    return docs.withColumn(key, own).join(stay, key, "left_semi").dropDuplicates([key]).select(*docs.columns)
