"""Vector functions as column expressions over arrays, in double precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """a / |a|; null for a zero vector."""
    length = norm(a)
    return F.when(length > 0, F.transform(doubles(a), lambda x: x / length))


def stored_unit(a: Column) -> Column:
    """The unit vector in single precision, as an index stores it."""
    return unit(a).cast("array<float>")


def cosine(a: Column, b: Column) -> Column:
    """Cosine by both norms; 0 if either is zero."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def as_share(similarity: Column) -> Column:
    """From [-1, 1] to [0, 1]."""
    return (similarity + 1) / 2


def blend(query: Column, reference: Column, weight: float = 0.3) -> Column:
    """(1 - weight) query + weight reference; the query where there is no reference."""
    mixed = F.zip_with(doubles(query), doubles(reference), lambda x, y: (1 - weight) * x + weight * y)
    return F.when(reference.isNotNull(), mixed).otherwise(doubles(query))


def shortened(a: Column, size: int) -> Column:
    """The first ``size`` components, as a unit vector."""
    return unit(F.slice(a, 1, size))


def mean_vectors(rows: DataFrame, keys: list[str], vector: str, name: str) -> DataFrame:
    """Mean vector of each key: components are averaged one by one, with partial sums before the shuffle."""
    parts = rows.select(*keys, F.posexplode(doubles(F.col(vector))).alias("i", "x"))
    means = parts.groupBy(*keys, "i").agg(F.avg("x").alias("x"))
    return means.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias(name))


def checked_size(items: DataFrame, vector: str) -> int:
    """The one length that all vectors have; an error if they differ or one is zero or missing."""
    seen = items.agg(F.min(F.size(vector)).alias("a"), F.max(F.size(vector)).alias("b"), F.count_if(F.col(vector).isNull() | (norm(F.col(vector)) == 0)).alias("bad")).first()
    if seen["bad"] or seen["a"] != seen["b"]:
        raise ValueError(f"vectors differ in length ({seen['a']} to {seen['b']}) or {seen['bad']} are zero or missing")
    return seen["a"]


def single_square(vector: Column) -> Column:
    """Squared length in single precision, added up one component after the other."""
    single = F.transform(vector, lambda x: x.cast("float"))
    return F.aggregate(single, F.lit(0.0).cast("float"), lambda a, x: (a + x * x).cast("float"))


def lane_square(vector: Column, lanes: int = 8) -> Column:
    """Squared length in single precision as a processor adds it up with ``lanes`` lanes in four registers.

    Each lane takes every fourth of its register's components by fused multiply and add (products are exact in double
    precision); what is left of four registers goes to the first, the registers are added in pairs, then the lanes
    from the first to the last, then the rest one by one. Up to two lanes' widths all go one by one.
    """
    single = F.transform(vector, lambda x: x.cast("float"))
    zero, n, four = F.lit(0.0).cast("float"), F.size(single), 4 * lanes
    limit = F.when(n > 2 * lanes, n - n % lanes).otherwise(0)
    unrolled = F.greatest(F.lit(0), F.ceil((limit - 3 * lanes) / four)).cast("int") * four
    at = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: i < n)
    fused = lambda begin, where: F.aggregate(F.filter(at, where), begin, lambda a, i: (F.get(single, i).cast("double") * F.get(single, i).cast("double") + a.cast("double")).cast("float"))

    def lane(k: Column, register: int) -> Column:
        own = lambda i: (i % lanes == k) & (i < unrolled) & (F.floor(i / lanes) % 4 == register)
        return fused(zero, (lambda i: own(i) | ((i % lanes == k) & (i >= unrolled) & (i < limit))) if register == 0 else own)

    def added(total: Column, k: Column) -> Column:
        a, b, c, d = (lane(k, r) for r in range(4))
        return (total + ((a + b).cast("float") + (c + d).cast("float")).cast("float")).cast("float")

    whole = F.aggregate(F.sequence(F.lit(0), F.lit(lanes - 1)), zero, added)
    return fused(whole, lambda i: i >= limit)


def stored_unless_unit(vector: Column, slack: float = 1e-4) -> Column:
    """The vector in single precision, normalised only where its squared length is more than ``slack`` off one."""
    single = F.transform(vector, lambda x: x.cast("float"))
    square = single_square(vector).cast("double")
    return F.when(F.abs(square - 1) > slack, stored_unit(single)).otherwise(single)
