"""Request admission by a sliding window: who starts when, if at most N requests start in any S seconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnlake.operators.order import placed, same_keys
from cairnlake.session import durable


def admitted(requests: DataFrame, gates: list[str], arrival: str, order: list[str], most: int, seconds: float) -> DataFrame:
    """``requests`` with ``start_us`` and ``wait_us``: microseconds of their start and of their wait.

    Each gate serves its requests by (arrival, order); one starts on arrival, unless ``most`` others started in the ``seconds``
    before, then when the oldest of those leaves the window: t(i) = max(arrival(i), t(i - most) + seconds). So every
    ``most``-th request of a gate is one chain, and t is m * seconds plus the running maximum of arrival(k) - k * seconds over
    the chain's first m members. A gate of any size is spread over ranges of its requests: the maximum runs inside a
    range, and between ranges over one row a chain and range. Requests without arrival are left out; requests of
    equal arrival and order take any order. ``most`` < 1 or ``seconds`` <= 0 is an error.
    """
    if most < 1 or seconds <= 0:
        raise ValueError(f"a gate admits at least one request in a positive time, got {most} in {seconds}")
    span = round(seconds * 1_000_000)
    timed = requests.withColumn("__us", F.unix_micros(F.col(arrival).cast("timestamp"))).where("__us IS NOT NULL")
    held = placed(timed, gates, ["__us", *order], place="__place", size="__size", part="__part")
    chained = held.withColumn("__chain", F.col("__place") % most).withColumn("__m", F.floor(F.col("__place") / most).cast("long"))
    slack = F.col("__us") - F.col("__m") * span
    chain = [*gates, "__chain"]
    ends = chained.groupBy(*chain, "__part").agg(F.max(slack).alias("__most"))
    earlier = Window.partitionBy(*chain).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*chain, "__part", F.max("__most").over(earlier).alias("__before"))
    inside = Window.partitionBy(*chain, "__part").orderBy("__m").rowsBetween(Window.unboundedPreceding, 0)
    both = same_keys(chained.withColumn("__own", F.max(slack).over(inside)), carried, [*chain, "__part"])
    start = F.greatest("__own", "__before") + F.col("__m") * span
    return both.withColumn("start_us", start).withColumn("wait_us", F.col("start_us") - F.col("__us")).drop(*(c for c in both.columns if c.startswith("__")))


def parse_rate(value: str | int | None) -> tuple[int, float] | None:
    """(requests, seconds) of ``N/S``; S is 60 if it is not given; None for no gate ("0", "none", "null", "~", "off", blank)."""
    text = "" if value is None else str(value).strip().lower()
    if text in ("", "0", "none", "null", "~", "off"):
        return None
    n, _, s = text.partition("/")
    most, seconds = int(n), float(s or 60)
    if most < 1 or seconds <= 0:
        raise ValueError(f"a rate is N/S with N >= 1 and S > 0, got {value!r}")
    return most, seconds


def waits(rows: DataFrame, keys: list[str], wait: Column) -> DataFrame:
    """requests, delayed ones, and the sum and the most of their waits in microseconds.

    Waits at a full gate add up with the square of its requests, so they are summed in decimals. The sum is a long while each
    group's fits one, and decimal(38,0) if one doesn't.
    """
    seen = rows.groupBy(*keys).agg(F.count("*").alias("requests"), F.count_if(wait > 0).alias("delayed"), F.sum(wait.cast("decimal(28,0)")).alias("total_wait_us"), F.max(wait).alias("most_wait_us"))
    held = durable(seen)
    fits = held.where(F.abs("total_wait_us") > F.lit(2**63 - 1)).isEmpty()
    return held.withColumn("total_wait_us", F.col("total_wait_us").cast("long")) if fits else held
