"""Conflict-constrained best-fit packing of token sequences into bins of a fixed capacity.

Documents are dealt evenly over packing groups of a bounded number of rows (by a hash, so that a hot source is spread
over all of them), and each group is packed by best fit, longest first. Open bins are ordered by residual space and carry
bitmaps of their sources and duplicate clusters; from the first bin with room the search goes on to the next larger residual
until a bin without a conflict is found, which is the tightest compatible one.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlake.llm.exact_dedup import normalised
from cairnlake.session import durable


def best_fit(lengths: list[int], sources: list[int], clusters: list[int], capacity: int) -> tuple[list[int], list[int], int]:
    """(bin, offset) of each piece in the given order, and the number of bins; no bin gets a source or a cluster twice.

    sources and clusters are small numbers, -1 for none. Every length is in 1 .. capacity.
    """
    open_bins: list[tuple[int, int]] = []  # (residual, bin)
    in_source, in_cluster, left = [], [], []
    bins, offsets = [], []
    for length, source, cluster in zip(lengths, sources, clusters, strict=True):
        s, c = (1 << x if x >= 0 else 0 for x in (source, cluster))
        at = bisect_left(open_bins, (length, -1))
        while at < len(open_bins) and (in_source[open_bins[at][1]] & s or in_cluster[open_bins[at][1]] & c):
            at += 1
        if at < len(open_bins):
            b = open_bins.pop(at)[1]
        else:
            b = len(left)
            left.append(capacity)
            in_source.append(0)
            in_cluster.append(0)
        bins.append(b)
        offsets.append(capacity - left[b])
        left[b] -= length
        in_source[b] |= s
        in_cluster[b] |= c
        if left[b]:
            insort(open_bins, (left[b], b))
    return bins, offsets, len(left)


def pack(rows: DataFrame, capacity: int = 2048, group_rows: int = 4096) -> DataFrame:
    """Bins for rows of (doc_id, n_tokens, source, cluster): group, bin, doc_id, piece, first_token, length, bin_offset.

    Rows longer than ``capacity`` are cut into pieces of that length and a rest; every token of every row is in exactly one
    piece. Rows that are null or not positive in n_tokens give no piece, null sources and clusters conflict with nothing,
    and the pieces of one row conflict with each other only by its source and cluster. Rows that repeat an id are packed
    each. Nothing is dropped to fill bins: a group's last bins may be part empty. Other columns are not read.

    One shuffle of narrow rows. A group holds about ``group_rows`` pieces whatever the input.
    """
    need = F.col("n_tokens").cast("long")
    cut = durable(rows.select("doc_id", "source", "cluster", need.alias("n_tokens")).where("n_tokens > 0"))
    pieces = cut.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_tokens") - 1) / capacity))))
    pieces = pieces.select("doc_id", "piece", (F.col("piece") * capacity).alias("first_token"), F.least(F.lit(capacity).cast("long"), F.col("n_tokens") - F.col("piece") * capacity).alias("length"), "source", "cluster")
    groups = max(1, -(-pieces.count() // group_rows))
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "length"), F.lit(groups)))
    full = dealt.where(F.col("length") == capacity)
    part = dealt.where(F.col("length") < capacity)

    def numbers(values: pd.Series) -> list[int]:
        return pd.factorize(values)[0].tolist()

    def fill(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values(["length", "doc_id", "piece", "cluster", "source"], ascending=[False, True, True, True, True], kind="stable")
        bins, offsets, _ = best_fit(batch["length"].tolist(), numbers(batch["source"]), numbers(batch["cluster"]), capacity)
        names = batch["group"].astype(str) + "-" + pd.Series(bins, index=batch.index).astype(str)
        return batch.assign(bin=names, bin_offset=np.array(offsets, np.int64))[["group", "bin", "doc_id", "piece", "first_token", "length", "bin_offset"]]

    def consume(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by group; a group is packed once the next begins."""
        held: pd.DataFrame | None = None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch])
            if not len(held):
                continue
            last = held["group"].iloc[-1]
            for _, group in held[held["group"] != last].groupby("group", sort=False):
                yield fill(group)
            held = held[held["group"] == last]
        if held is not None and len(held):
            yield fill(held)

    schema = "group long, bin string, doc_id long, piece long, first_token long, length long, bin_offset long"
    packed = part.select("group", F.col("doc_id").cast("long").alias("doc_id"), "piece", "first_token", "length", F.col("source").cast("string").alias("source"), F.col("cluster").cast("string").alias("cluster"))
    packed = packed.repartition("group").sortWithinPartitions("group").mapInPandas(consume, schema)
    alone = full.select("group", F.concat_ws("-", F.lit("full"), F.col("doc_id").cast("string"), F.col("piece").cast("string")).alias("bin"), F.col("doc_id").cast("long").alias("doc_id"), "piece", "first_token", "length", F.lit(0).cast("long").alias("bin_offset"))
    return packed.unionAll(alone)


def word_lengths(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_tokens, the words of the text and an end mark; a null text has the end mark alone."""
    words = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    return docs.withColumn("n_tokens", (words + 1).cast("long"))


def pack_documents(docs: DataFrame, capacity: int = 2048, text: str = "text") -> DataFrame:
    """Pack documents by word counts; texts that are equal without white space are one duplicate cluster."""
    cluster = F.when(F.col(text).isNotNull(), F.xxhash64(normalised(F.col(text)))).alias("cluster")
    return pack(word_lengths(docs.select("doc_id", "source", text, cluster), text), capacity)
