"""Writers of the index, caches, dialogues and reports."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairnlake.functions.text import field_text
from cairnlake.functions.vectors import checked_size, stored_unit
from cairnlake.operators.bm25 import build_index
from cairnlake.operators.order import laid_out
from cairnlake.session import durable


def write_index(items: DataFrame, path: str, fields: list[str], vector: str = "vector", tokenizer: str = "unicode61") -> None:
    """Write items (item_id, ..., vector as stored unit vectors) and the text index over their fields under ``path``."""
    checked_size(items, vector)
    present = list(dict.fromkeys(f for f in fields if f in items.columns))
    own = durable(items.withColumns({vector: stored_unit(F.col(vector)), "search_text": field_text([F.col(f) for f in present])}))
    index = build_index(own.select(F.col("item_id").alias("doc_id"), F.col("search_text").alias("text")), tokenizer)
    own.write.mode("overwrite").parquet(f"{path}/items")
    for name in ("postings", "doc_len", "term_df", "corpus"):
        getattr(index, name).write.mode("overwrite").parquet(f"{path}/{name}")


def append_to_cache(fresh: DataFrame, cache: DataFrame, path: str, key: list[str], batch: int = 100) -> None:
    """Append rows whose key the cache lacks; repeating a run adds nothing.

    Files hold ``batch`` rows at most, so that a reader of the folder sees whole batches while the job runs.
    """
    new = fresh.dropDuplicates(key).join(cache.select(*key).distinct(), key, "left_anti")
    new.write.mode("append").option("maxRecordsPerFile", batch).parquet(path)


def write_report(rows: DataFrame, path: str) -> None:
    """One CSV table with a header."""
    rows.write.mode("overwrite").csv(path, header=True)


def write_call_log(calls: DataFrame, path: str) -> None:
    """Calls (site, error_type, used_fallback, ...) as JSON lines, appended; nulls are written too."""
    calls.write.mode("append").option("ignoreNullFields", "false").json(path)


def replace_folder(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Let ``write`` fill a new folder beside ``path`` and rename it, so that readers see the old data or all of the new."""
    fresh = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}"
    write(fresh)
    target, source = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, fresh))
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.delete(target, True)
    if not files.rename(source, target):
        raise OSError(f"{fresh} can't be renamed to {path}")


def write_conversation_texts(lines: DataFrame, path: str, shard_bytes: int = 64 << 20) -> None:
    """Lines ``Speaker: text`` of all conversations (conv_id, turn, role, text) in text shards, and where each one's are.

    Shards under ``text`` are cut every ``shard_bytes`` bytes of the whole in order, whatever the conversations' number
    or lengths; ``index`` has (conv_id, shard, first_byte, n_bytes, n_lines), a row for each shard a conversation is
    in. Both appear at once, under a folder that replaces the old one.
    """
    spark = lines.sparkSession
    speaker = F.when(F.col("role") == "user", "User").when(F.col("role") == "system", "System").otherwise("Bot")
    said = lines.select("conv_id", "turn", F.concat_ws(": ", speaker, F.coalesce("text", F.lit(""))).alias("value"))
    placed, _ = laid_out(said, ["conv_id", "turn", "value"], F.octet_length("value") + 1, start="byte")
    placed = durable(placed.withColumn("shard", F.floor(F.col("byte") / shard_bytes).cast("long")))
    own = F.octet_length("value") + 1
    parts = placed.groupBy("conv_id", "shard").agg(F.min("byte").alias("first"), F.sum(own).cast("long").alias("n_bytes"), F.count("*").alias("n_lines"))
    begins = placed.groupBy("shard").agg(F.min("byte").alias("begin"))
    index = parts.join(begins, "shard").select("conv_id", "shard", (F.col("first") - F.col("begin")).alias("first_byte"), "n_bytes", "n_lines")

    def write(fresh: str) -> None:
        placed.repartition("shard").sortWithinPartitions("shard", "byte").select("shard", "value").write.partitionBy("shard").text(f"{fresh}/text")
        index.write.parquet(f"{fresh}/index")

    replace_folder(spark, path, write)


def write_pairs(pairs: dict[str, DataFrame], path: str) -> None:
    """Lists of (user_id, item_id), a folder each, and ``selection``, a JSON row with their sizes."""
    sizes = None
    for name, rows in sorted(pairs.items()):
        write_report(rows.select("user_id", "item_id"), f"{path}/{name}")
        own = rows.agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        sizes = own if sizes is None else sizes.unionAll(own)
    if sizes is not None:
        sizes.write.mode("overwrite").json(f"{path}/selection")


def rewrite_texts(source: DataFrame, path: str, column: str, change: Callable[[Column], Column]) -> None:
    """The rows of ``source`` with a changed text column, as a new dataset; the old one stays as it is."""
    source.withColumn(column, change(F.col(column))).write.mode("overwrite").parquet(path)


def write_unless_failed(rows: DataFrame, path: str, failed: Column) -> int:
    """Write a CSV only if no row failed; the number of failed rows."""
    held = durable(rows.withColumn("__failed", failed))
    bad = held.where("__failed").count()
    if not bad:
        held.drop("__failed").write.mode("overwrite").csv(path, header=True)
    return bad


def file_names(dialogues: DataFrame, base: list[str], ts: str) -> DataFrame:
    """``dialogues`` with file_name: parts joined by dashes and a time stamp, a second later for each one that is taken."""
    name = F.concat_ws("-", *(F.col(c).cast("string") for c in base))
    n = F.row_number().over(Window.partitionBy(*base, ts).orderBy("dialogue_id")) - 1
    stamp = F.date_format(F.timestamp_seconds(F.unix_timestamp(ts) + n), "yyyyMMddHHmmss")
    return dialogues.withColumn("file_name", F.concat(name, F.lit("-"), stamp, F.lit(".txt")))


def write_transcripts(dialogues: DataFrame, path: str, text: str = "transcript") -> None:
    """One text row of each dialogue, in folders by outcome; the folder appears when all of it is written."""
    rows = dialogues.select("status", F.col(text).alias("value"))
    replace_folder(dialogues.sparkSession, path, lambda fresh: rows.write.partitionBy("status").text(fresh))


def run_summary(counters: DataFrame, failed_profiles: int = 0, unfinished: int = 0) -> DataFrame:
    """One JSON row of counters (site, calls, fallbacks, errors), their totals and the exit code of the run."""
    each = F.map_from_entries(F.array_sort(F.collect_list(F.struct("site", F.struct("calls", "fallbacks", "errors")))))
    total = F.coalesce(F.sum("fallbacks"), F.lit(0)) + failed_profiles + unfinished
    return counters.agg(F.to_json(F.struct(each.alias("sites"), F.sum("errors").alias("errors"), F.when(total > 0, 3).otherwise(0).alias("exit_code"))).alias("summary"))
