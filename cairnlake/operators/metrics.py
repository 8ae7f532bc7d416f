"""Statistics over dialogues, judge scores, runs and request rates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnlake.functions.text import words


def described(column: str, digits: int = 6) -> list[Column]:
    """n, mean, sample std, min, q1, median, q3 and max of a column; quantiles interpolate between neighbours."""
    q = F.percentile(column, F.array(*map(F.lit, (0.25, 0.5, 0.75))))
    short = lambda c, name: F.round(c, digits).alias(name)
    return [F.count(column).alias("n"), short(F.avg(column), "mean"), short(F.stddev_samp(column), "std"), F.min(column).cast("double").alias("min"), short(q[0], "q1"), short(q[1], "median"), short(q[2], "q3"), F.max(column).cast("double").alias("max")]


def turns_per_dialogue(lines: DataFrame) -> DataFrame:
    return lines.groupBy("conv_id").agg(F.count("*").alias("turns"))


def speaker_stats(lines: DataFrame, speaker: str = "role", text: str = "text") -> DataFrame:
    """(speaker, utterances, mean_words, sum_words, per_dialogue); utterances of a speaker over all dialogues."""
    counted = lines.withColumn("__words", F.size(words(F.col(text))))
    total = lines.agg(F.countDistinct("conv_id").alias("__d"))
    out = counted.groupBy(speaker).agg(F.count("*").alias("utterances"), F.avg("__words").alias("mean_words"), F.sum("__words").alias("sum_words"))
    return out.crossJoin(F.broadcast(total)).select(speaker, "utterances", "mean_words", "sum_words", (F.col("utterances") / F.col("__d")).alias("per_dialogue"))


def side_stats(rows: DataFrame, keys: list[str]) -> DataFrame:
    """n, aborted, succeeded, completion rate over all rows, mean turns and attempts over the completed ones.

    rows: (completed, succeeded, turns), and if there are any (attempts, reason); reasons are counted as ``reason:n``, sorted.
    """
    done = F.col("completed")
    more = [F.avg(F.when(done, F.col("attempts"))).alias("mean_attempts")] if "attempts" in rows.columns else []
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(~done).alias("aborted"), F.count_if(done & F.col("succeeded")).alias("succeeded"), F.avg((done & F.col("succeeded")).cast("int")).alias("completion_rate"), F.avg(F.when(done, F.col("turns"))).alias("mean_turns"), *more)
    if "reason" not in rows.columns:
        return out
    each = rows.groupBy(*keys, "reason").agg(F.count("*").alias("__n")).groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "reason", "__n"))), ",").alias("reasons"))
    return out.join(each, keys)


def conversation_stats(rows: DataFrame, keys: list[str], percent: bool = False) -> DataFrame:
    """n, mean of succeed, turns and attempts of (succeed, turns, attempts); ``percent`` gives succeed in hundredths to one digit."""
    rate = F.round(100 * F.avg("succeed"), 1) if percent else F.avg("succeed")
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), rate.alias("success"), F.avg("turns").alias("mean_turns"), F.avg("attempts").alias("mean_attempts"))


def paired_difference(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Pairs, missing partners, mean turn difference where both completed, and the first side's standard error in points."""
    a = first.select(key, F.col("completed").alias("c1"), F.col("succeeded").alias("s1"), F.col("turns").alias("t1"))
    b = second.select(key, F.col("completed").alias("c2"), F.col("succeeded").alias("s2"), F.col("turns").alias("t2"))
    both = a.join(b, key, "full_outer")
    pair, p = F.col("c1").isNotNull() & F.col("c2").isNotNull(), F.avg(F.when(F.col("c1").isNotNull() & F.col("c2").isNotNull(), (F.col("c1") & F.col("s1")).cast("int")))
    seen = both.agg(F.count_if(pair).alias("pairs"), F.count_if(F.col("c1").isNull()).alias("only_second"), F.count_if(F.col("c2").isNull()).alias("only_first"), F.count_if(pair & ((F.col("c1") & F.col("s1")) != (F.col("c2") & F.col("s2")))).alias("outcome_differs"), F.avg(F.when(pair & F.col("c1") & F.col("c2"), F.col("t2") - F.col("t1"))).alias("turn_diff"), p.alias("rate"))
    return seen.withColumn("se_points", 100 * F.sqrt(F.col("rate") * (1 - F.col("rate")) / F.col("pairs")))


def side_by_side(rows: DataFrame, side: str, dimensions: list[str], names: tuple[str, str]) -> DataFrame:
    """(dimension, mean_a, mean_b, delta): means of both sides and the rounded difference of the unrounded ones."""
    long = rows.unpivot([side], dimensions, "dimension", "value").groupBy("dimension").pivot(side, list(names)).agg(F.avg("value"))
    a, b = (F.col(f"`{n}`") for n in names)
    return long.select("dimension", F.round(a, 3).alias("mean_a"), F.round(b, 3).alias("mean_b"), F.round(a - b, 3).alias("delta"))


def rate_windows(events: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """``events`` with in_window: events of the key in the ``seconds`` up to and with each event.

    Time is cut into buckets of that length, and each bucket also gets the rows of the one before it, so that a key with
    very many events is spread over its buckets.
    """
    span = seconds * 1_000_000
    timed = events.withColumn("__t", F.unix_micros(F.col(ts).cast("timestamp")))
    bucket = F.floor(F.col("__t") / span)
    both = timed.withColumn("__own", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn("__b", F.when(F.col("__own"), bucket).otherwise(bucket + 1))
    window = Window.partitionBy(key, "__b").orderBy("__t").rangeBetween(-span, 0)
    return both.withColumn("in_window", F.count("*").over(window)).where("__own").drop("__t", "__b", "__own")


def embedding_plan(texts: DataFrame, cache: DataFrame, key: list[str], batch: int = 100) -> DataFrame:
    """n_rows, hits, misses, requests of ``batch`` misses, and tokens at four characters each."""
    missing = texts.join(cache.select(*key).distinct(), key, "left_anti")
    all_rows = texts.agg(F.count("*").alias("n_rows"))
    seen = missing.agg(F.count("*").alias("misses"), F.coalesce(F.sum(F.char_length("text")), F.lit(0)).alias("chars"))
    both = all_rows.crossJoin(seen)
    return both.select("n_rows", (F.col("n_rows") - F.col("misses")).alias("hits"), "misses", F.ceil(F.col("misses") / batch).cast("long").alias("requests"), F.floor(F.col("chars") / 4).cast("long").alias("tokens"))


def run_counters(events: DataFrame, keys: list[str]) -> DataFrame:
    """Calls, fallbacks and errors of each key from call rows (site, error_type, used_fallback)."""
    return events.groupBy(*keys).agg(F.count("*").alias("calls"), F.count_if("used_fallback").alias("fallbacks"), F.count("error_type").alias("errors"))


def exit_code(counters: DataFrame, failed_profiles: int = 0, unfinished: int = 0) -> int:
    """3 after any replaced call, failed profile or unfinished dialogue, else 0; counters: (fallbacks, ...)."""
    seen = counters.agg(F.coalesce(F.sum("fallbacks"), F.lit(0)).alias("n")).first()["n"]
    return 3 if seen + failed_profiles + unfinished else 0


def content_digest(rows: DataFrame, columns: list[str]) -> DataFrame:
    """n and an order-free digest of rows: the sum of the leading 12 hex digits of each row's md5.

    The sum is taken in decimals: 65,000 rows are enough to pass 64 bits.
    """
    text = F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))
    return rows.agg(F.count("*").alias("n"), F.sum(F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("decimal(28,0)")).cast("string").alias("digest"))


def each_or_all(rows: DataFrame, key: str, stats: Callable[[DataFrame, list[str]], DataFrame]) -> DataFrame:
    """``stats`` of each value of ``key`` and, under ``all``, of all rows."""
    return stats(rows, [key]).unionByName(stats(rows.withColumn(key, F.lit("all")), [key]))
