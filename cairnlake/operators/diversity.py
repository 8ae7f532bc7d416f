"""Lexical diversity, entropy and spread of vectors, over groups of texts."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnlake.functions.text import ngrams
from cairnlake.functions.vectors import dot, doubles
from cairnlake.operators.order import placed


def distinct_n(rows: DataFrame, keys: list[str], tokens: str, n: int) -> DataFrame:
    """(keys, total, different, ratio) of n-grams that don't cross rows."""
    grams = rows.select(*keys, F.explode(ngrams(F.col(tokens), n)).alias("gram")).groupBy(*keys, "gram").agg(F.count("*").alias("c"))
    return _ratio(grams, keys)


def _ratio(counted: DataFrame, keys: list[str]) -> DataFrame:
    return counted.groupBy(*keys).agg(F.sum("c").alias("total"), F.count("*").alias("different"), (F.count("*") / F.sum("c")).alias("ratio"))


def stream_bigrams(rows: DataFrame, doc: str, place: str, tokens: str) -> DataFrame:
    """(gram, c) of bigrams of the whole stream, rows by (doc, place); those across rows count too.

    Inside rows they are local. Across rows only first and last tokens matter: rows get their places in the stream and
    meet the next one by it.
    """
    inside = rows.select(F.explode(ngrams(F.col(tokens), 2)).alias("gram"))
    ends = rows.where(F.size(tokens) > 0).select(doc, place, F.get(F.col(tokens), 0).alias("first"), F.element_at(tokens, -1).alias("last"))
    held = placed(ends, [], [doc, place], place="__line", size="__lines")
    across = held.select("__line", "last").join(held.select((F.col("__line") - 1).alias("__line"), F.col("first").alias("next")), "__line")
    return inside.unionAll(across.select(F.concat_ws(" ", "last", "next").alias("gram"))).groupBy("gram").agg(F.count("*").alias("c"))


def type_token(rows: DataFrame, keys: list[str], tokens: str) -> DataFrame:
    """(keys, n_tokens, n_types, ttr, root_ttr, log_ttr, maas): V/N, V/sqrt N, ln V/ln N and (ln N - ln V)/ln^2 N."""
    counted = _ratio(rows.select(*keys, F.explode(tokens).alias("gram")).groupBy(*keys, "gram").agg(F.count("*").alias("c")), keys)
    n, v = F.col("total"), F.col("different")
    return counted.select(*keys, n.alias("n_tokens"), v.alias("n_types"), (v / n).alias("ttr"), (v / F.sqrt(n)).alias("root_ttr"), F.when(n > 1, F.ln(v) / F.ln(n)).alias("log_ttr"), F.when(n > 1, (F.ln(n) - F.ln(v)) / (F.ln(n) * F.ln(n))).alias("maas"))


def _one_way(codes: list[int], seen: list[int], stamp: int, threshold: float) -> tuple[float, int]:
    """Length over the number of factors; a factor ends where the running type-token ratio falls to the threshold.

    ``seen`` holds, for each code, the last factor that met it; factors are numbered on from ``stamp``.
    """
    factors, n, types = 0.0, 0, 0
    stamp += 1
    for code in codes:
        n += 1
        if seen[code] != stamp:
            seen[code] = stamp
            types += 1
        if types / n <= threshold:
            factors, n, types = factors + 1, 0, 0
            stamp += 1
    factors += (1 - types / n) / (1 - threshold) if n else 0.0
    return (len(codes) / factors if factors > 0 else float(len(codes))), stamp


def mtld(tokens: Column, threshold: float = 0.72) -> Column:
    """Mean of both directions; 0 for under ten tokens. A task walks over numbers of its tokens, in time linear in them."""

    @F.arrow_udf("double")
    def both_ways(arrays: pa.Array) -> pa.Array:
        coded = arrays.flatten().dictionary_encode("encode")
        codes, seen, stamp, at, out = np.asarray(coded.indices), [0] * len(coded.dictionary), 0, 0, []
        for size in pc.list_value_length(arrays).to_pylist():
            own = codes[at : at + (size or 0)].tolist()
            at += len(own)
            there, stamp = _one_way(own, seen, stamp, threshold)
            back, stamp = _one_way(own[::-1], seen, stamp, threshold)
            out.append(None if size is None else (there + back) / 2)
        return pa.array(out, pa.float64())

    return F.when(F.size(tokens) < 10, F.lit(0.0)).otherwise(both_ways(tokens))


def hdd(rows: DataFrame, keys: list[str], tokens: str, draws: int = 42) -> DataFrame:
    """(keys, hdd): expected types in ``draws`` tokens; 0 if there are fewer. Types are summed by their count."""
    types = rows.select(*keys, F.explode(tokens).alias("w")).groupBy(*keys, "w").agg(F.count("*").alias("c"))
    sizes = types.groupBy(*keys, "c").agg(F.count("*").alias("m")).withColumn("n", F.sum(F.col("c") * F.col("m")).over(Window.partitionBy(*keys)))
    missed = reduce(lambda a, k: a * (F.col("n") - F.col("c") - k) / (F.col("n") - k), range(draws), F.lit(1.0))
    seen = F.when(F.col("n") < draws, 0.0).when(F.col("c") > F.col("n") - draws, F.col("m").cast("double")).otherwise(F.col("m") * (1 - missed))
    return sizes.groupBy(*keys).agg(F.sum(seen).alias("hdd"))


def window_ttr(tokens: Column, size: int = 50) -> tuple[Column, Column]:
    """(mattr, msttr): mean type-token ratio of all windows of ``size`` tokens, and of the consecutive segments.

    A shorter text has one window, itself; segments leave the rest out.
    """
    ratio = lambda i: F.size(F.array_distinct(F.slice(tokens, i, size))) / F.lit(float(size))
    short = F.size(F.array_distinct(tokens)) / F.size(tokens)
    mean = lambda step: F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(tokens) - size + 1), F.lit(step)), ratio), F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")), lambda a, x: F.struct((a["s"] + x).alias("s"), (a["n"] + 1).alias("n")), lambda a: a["s"] / a["n"])
    return tuple(F.when(F.size(tokens) == 0, F.lit(None)).when(F.size(tokens) < size, short).otherwise(mean(step)) for step in (1, size))


def entropy(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, n, entropy): Shannon entropy of the values, in bits."""
    counted = rows.groupBy(*keys, value).agg(F.count("*").alias("c"))
    total = counted.groupBy(*keys).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log2("c")).alias("s"))
    return total.select(*keys, "n", (F.log2("n") - F.col("s") / F.col("n")).alias("entropy"))


def mentioned_items(text: Column) -> Column:
    """Item ids in parentheses."""
    return F.regexp_extract_all(text, F.lit(r"\(((?U)\w[\w\-]*)\)"), 1)


def cosine_diversity(rows: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """(keys, n, diversity): 1 less the mean cosine of all pairs of unit vectors, from the length of their sum."""
    total = rows.select(*keys, F.posexplode(doubles(F.col(vector))).alias("i", "x")).groupBy(*keys, "i").agg(F.sum("x").alias("x")).groupBy(*keys).agg(F.sum(F.col("x") * F.col("x")).alias("s"))
    own = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(dot(F.col(vector), F.col(vector))).alias("own"))
    both = own.join(total, keys)
    return both.select(*keys, "n", F.when(F.col("n") > 1, 1 - (F.col("s") - F.col("own")) / (F.col("n") * (F.col("n") - 1))).otherwise(0.0).alias("diversity"))


def sampled_cosine_diversity(rows: DataFrame, keys: list[str], vector: str, order: list[str], n: int = 200, seed: int | None = None) -> DataFrame:
    """:func:`cosine_diversity` of ``n`` rows of each group: the first ones by ``order``, or with a seed those of the least hash.

    Each task ranks its own rows first, so a group of any size sends ``n`` rows a task at most.
    """
    by = [F.md5(F.concat_ws(":", F.lit(str(seed)), *order)), *order] if seed is not None else order
    ranked = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*by)))
    return cosine_diversity(ranked.where(F.col("__n") <= n).drop("__n"), keys, vector)
