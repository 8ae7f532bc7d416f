"""Registered queries on runs: tasks, files, reports, call sites and settings, each with its DuckDB counterpart.

Queries of readers and writers write under the scratch folder and return what is read back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlake.functions import text as T
from cairnlake.functions import vectors as V
from cairnlake.operators import bm25, calls, filters, hybrid, metrics, profiles, strategies
from cairnlake.operators import sampling as S
from cairnlake.operators.providers import hashed_embedding, with_embedding
from cairnlake.session import durable, scratch_path, table
from cairnlake.sources import readers, writers


def _ratings(spark, sf_dir) -> DataFrame:
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("user"), F.col("l_partkey").alias("item"), F.col("o_orderdate").alias("ts"))


# --- tasks ------------------------------------------------------------------------------------------------------------


def strategy_pairs(spark, sf_dir) -> DataFrame:
    """Two dialogues of each line's customer and part, the ids under their other names."""
    rows = _ratings(spark, sf_dir).select(F.col("user").alias("userid"), F.col("item").alias("product_id")).distinct()
    return strategies.pairs(rows, 2).select("user_id", "target_id", "copy", "dialogue_id")


def strategy_item_list(spark, sf_dir) -> DataFrame:
    """Three dialogues of each part, listed in the first column, with random customers."""
    listed = table(spark, sf_dir, "part").select("p_partkey")
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    return strategies.item_list(listed, users, 3, 2025).select("user_id", "target_id", "copy")


def strategy_user_guest(spark, sf_dir) -> DataFrame:
    """Four dialogues of each customer about random parts."""
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_name")
    return strategies.user_guest(users, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id")), 4, 7).select("user_id", "target_id", "copy")


def strategy_items(spark, sf_dir) -> DataFrame:
    """Forty dialogues of guests about random parts with a usable id."""
    ids = F.when(F.col("p_partkey") % 11 == 0, " NaN ").when(F.col("p_partkey") % 13 == 0, "").otherwise(F.col("p_partkey").cast("string"))
    return strategies.random_items(table(spark, sf_dir, "part").select(ids.alias("item_id")), 40, 2025).select("user_id", "target_id", "copy")


def usable_items(spark, sf_dir) -> DataFrame:
    ids = F.when(F.col("p_partkey") % 11 == 0, " NaN ").when(F.col("p_partkey") % 13 == 0, "  ").when(F.col("p_partkey") % 17 != 0, F.col("p_partkey").cast("string"))
    return filters.usable_ids(table(spark, sf_dir, "part").select(ids.alias("item_id"), "p_name"), "item_id")


def user_exclusions(spark, sf_dir) -> DataFrame:
    own = _ratings(spark, sf_dir)
    found = profiles.excluded_items(own, own.groupBy("user").agg(F.min("item").alias("target")))
    return found.select("user", "target", F.size("excluded").cast("long").alias("n"), F.md5(F.array_join("excluded", ",")).alias("excluded_md5"))


def fresh_target(spark, sf_dir) -> DataFrame:
    """A part for each customer that the customer never ordered."""
    items = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"))
    return profiles.fresh_targets(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user")), items, _ratings(spark, sf_dir), 3)


def conversation_lookup(spark, sf_dir) -> DataFrame:
    """The lines of thirty sampled conversations."""
    lines = table(spark, sf_dir, "conversations")
    chosen = S.without_replacement(lines.select("conv_id").distinct(), "conv_id", 30, 5)
    return lines.join(chosen, "conv_id").select("conv_id", "turn", "role", F.md5("text").alias("text_md5"))


def bernoulli_switches(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").groupBy(S.happens(0.3, 9, F.col("c_custkey")).alias("happens"), S.picked(["a", "b", "c"], 4, F.col("c_custkey")).alias("phrase")).agg(F.count("*").alias("n"))


def near_lengths(spark, sf_dir) -> DataFrame:
    """Conversations by their turns: in a range with slack, up to the cap, and all where too few are left."""
    turns = metrics.turns_per_dialogue(table(spark, sf_dir, "conversations"))
    cases = [("range", 3, 5, 1, 6), ("cap", 500, 600, 1, 7), ("all", 500, 600, 10**9, 4), ("open", 500, 600, 1, None)]
    out = None
    for name, low, high, least, cap in cases:
        own = filters.near_length(turns, "turns", low, high, least, cap=cap).select(F.lit(name).alias("bounds"), "conv_id", "turns")
        out = own if out is None else out.unionAll(own)
    return out


def empty_filter_columns(spark, sf_dir) -> DataFrame:
    """Why a search finds nothing: each case's structurally empty filters."""
    items = table(spark, sf_dir, "part").select(F.col("p_name").alias("category"), F.col("p_size").alias("year"))
    genres = lambda *g: F.array(*map(F.lit, g))
    cases = [("both", F.lit(900), F.lit(999), genres("no such", "nor this")), ("years", F.lit(900), F.lit(None).cast("int"), F.lit(None).cast("array<string>")), ("none", F.lit(1), F.lit(99), genres("ring"))]
    out = None
    for name, low, high, required in cases:
        own = filters.empty_filters(items, low, high, required).select(F.lit(name).alias("case"), "reason", "value", "column")
        out = own if out is None else out.unionAll(own)
    return out


def first_shown(spark, sf_dir) -> DataFrame:
    """What a round shows: results without the refused ones, once each, the first two by rank."""
    ranked = _ratings(spark, sf_dir).withColumn("rank", F.xxhash64("ts", "item") * 0 + F.col("item") % 97)
    refused = ranked.where("item % 3 = 0").select("user", "item").distinct()
    return hybrid.offered(ranked, refused, ["user"], "item", ["rank", "item"], 2)


def unset_settings(spark, sf_dir) -> DataFrame:
    value = F.element_at(F.array(*map(F.lit, ["none", " NULL ", "~", "", "no", "0"]), F.lit(None).cast("string")), (F.col("p_partkey") % 7 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", T.unset(value).alias("unset"))


# --- statistics -------------------------------------------------------------------------------------------------------


def _scored(spark, sf_dir) -> DataFrame:
    turns = metrics.turns_per_dialogue(table(spark, sf_dir, "conversations"))
    third = F.col("conv_id") % 3
    return turns.select("conv_id", third.alias("kind"), (F.col("turns") % 2).alias("succeed"), "turns", (F.col("turns") % 5).alias("attempts"), (F.col("conv_id") % 7 != 0).alias("completed"), F.when(third == 0, "success").when(third == 1, "max_total_rounds").otherwise("incomplete").alias("reason"))


def conversation_stats(spark, sf_dir) -> DataFrame:
    """Means of each kind, the success as a share and in hundredths."""
    rows = _scored(spark, sf_dir)
    both = [metrics.conversation_stats(rows, ["kind"], p).withColumn("percent", F.lit(p)) for p in (False, True)]
    return both[0].unionByName(both[1]).withColumns({n: F.round(n, 6) for n in ("success", "mean_turns", "mean_attempts")})


def side_reasons(spark, sf_dir) -> DataFrame:
    rows = _scored(spark, sf_dir).withColumn("succeeded", F.col("succeed") == 1)
    return metrics.side_stats(rows, ["kind"]).withColumns({n: F.round(n, 6) for n in ("completion_rate", "mean_turns", "mean_attempts")})


def missing_partners(spark, sf_dir) -> DataFrame:
    """Conversations that one side lacks."""
    turns = metrics.turns_per_dialogue(table(spark, sf_dir, "conversations")).select("conv_id")
    first, second = turns.where("conv_id % 4 <> 0"), turns.where("conv_id % 6 <> 0")
    return first.join(second, "conv_id", "left_anti").withColumn("only", F.lit("first")).unionByName(second.join(first, "conv_id", "left_anti").withColumn("only", F.lit("second")))


def pooled_folders(spark, sf_dir) -> DataFrame:
    """Lines of three folders as one bag."""
    lines, root = table(spark, sf_dir, "conversations"), scratch_path(spark, "pool")
    for k in range(3):
        lines.where(F.col("conv_id") % 4 != k).select(F.coalesce("text", F.lit("")).alias("text")).write.parquet(f"{root}/{k}")
    pool = spark.read.parquet(*(f"{root}/{k}" for k in range(3)))
    return pool.agg(F.count("*").alias("n"), F.sum(F.char_length("text")).alias("chars"))


def conditional_norm(spark, sf_dir) -> DataFrame:
    """Vectors stored as they are if nearly of length one, and normalised if not."""
    own = table(spark, sf_dir, "embeddings").withColumn("v", F.transform("embedding", lambda x: x * F.when(F.col("vec_id") % 2 == 0, 1.0).otherwise(2.5)))
    return own.select("vec_id", F.round(V.norm(V.stored_unless_unit(F.col("v"))), 4).alias("norm"))


# --- call sites -------------------------------------------------------------------------------------------------------


def _counting():
    """A provider that answers with the prompt's length and fails for prompts about the number seven."""

    def answer(prompts: list[str]) -> list[str]:
        if any("#7" in p for p in prompts):
            raise TimeoutError("too slow")
        return [f"<think>hm</think> K{len(p)}" for p in prompts]

    return answer


def _grading():
    """A provider whose scores follow the prompt's length, fenced; every third answer can't be read."""

    def answer(prompts: list[str]) -> list[str]:
        return ["no idea" if len(p) % 3 == 0 else f'```json\n{{"Fluency": {len(p) % 5 + 1}, "informativeness": {len(p) % 4 + 1}, "coherence": 3}}\n```' for p in prompts]

    return answer


def _brands(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_brand").alias("text"))


def expanded_queries(spark, sf_dir) -> DataFrame:
    found = calls.expanded_query(_brands(spark, sf_dir), _counting)
    return found.select("p_partkey", "query", "reply_call.error_type", "reply_call.used_fallback")


def call_counters(spark, sf_dir) -> DataFrame:
    """Calls, fallbacks and errors of two sites, and the run's exit code."""
    rows = durable(_brands(spark, sf_dir))
    described = calls.described_chat(rows.select("p_partkey", F.col("text").alias("chat"), F.col("text").alias("user_text")).where("p_partkey % 2 = 0"), _counting)
    log = durable(calls.call_log(calls.expanded_query(rows, _counting), described))
    counters = metrics.run_counters(log, ["site"])
    return counters.withColumn("exit_code", F.lit(metrics.exit_code(counters)))


def chat_titles(spark, sf_dir) -> DataFrame:
    found = calls.titled_chat(_brands(spark, sf_dir).withColumnRenamed("text", "chat"), _counting)
    return found.select("p_partkey", "title")


def _listing():
    return lambda prompts: ['["Colour", "P-Type", "details"]' if "ring" in p else "[]" for p in prompts]


def asked_attributes(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("category"))
    return calls.proposed_attributes(rows, ["p_type", "year"], ["price"], _listing).select("p_partkey", F.array_join("asks", ",").alias("asks"))


def _telling():
    return lambda prompts: ['It is {"value": "blue"}' if "blue" in p else '{"value": "Not mentioned"}' if "red" in p else "who knows" for p in prompts]


def attribute_values(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.lit("colour").alias("attribute"), F.col("p_name").alias("details"), F.when(F.col("p_partkey") % 3 == 0, "nan").when(F.col("p_partkey") % 3 == 1, " own ").alias("own"))
    return calls.attribute_value(rows, F.col("own"), _telling).select("p_partkey", "value")


def profile_summaries(spark, sf_dir) -> DataFrame:
    """A summary of each customer's segment, empty for some and failed for others; written only if none failed."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 5 == 0, "").otherwise(F.concat(F.lit("#"), F.col("c_custkey").cast("string"))).alias("ratings"))
    found = durable(calls.summarised_profiles(rows, _counting))
    failed = writers.write_unless_failed(found, scratch_path(spark, "profiles"), F.col("failed"))
    return found.agg(F.count("*").alias("n"), F.count_if(F.col("summary") == "").alias("blank"), F.sum(F.length("summary")).alias("chars")).withColumn("failed", F.lit(failed).cast("long"))


def judged_dialogues(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("dialogue"))
    return calls.judged(rows, _grading).select("conv_id", "turn", "role", "fluency", "informativeness", "overall_score", "overall_quality")


def judge_means(spark, sf_dir) -> DataFrame:
    """Means of the scores, and how many dialogues have each quality."""
    held = durable(judged_dialogues(spark, sf_dir))
    return held.groupBy("overall_quality").agg(F.count("*").alias("n"), *(F.round(F.avg(c), 6).alias(c) for c in ("fluency", "informativeness", "overall_score")))


def embedded_texts(spark, sf_dir) -> DataFrame:
    """Dimension and length of the default provider's vectors."""
    found = with_embedding(_brands(spark, sf_dir), "text", "vector", hashed_embedding)
    return found.select("p_partkey", F.size("vector").cast("long").alias("size"), F.round(V.norm(F.col("vector")), 6).alias("norm"))


# --- files ------------------------------------------------------------------------------------------------------------


def csv_round_trip(spark, sf_dir) -> DataFrame:
    """Parts written as a CSV with spoilt prices and an index column, and read back as a catalogue."""
    path = scratch_path(spark, "csv")
    price = F.when(F.col("p_partkey") % 4 == 0, "n/a").otherwise(F.col("p_retailprice").cast("string"))
    writers.write_report(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("Unnamed: 0"), "p_partkey", F.concat(F.lit(" "), F.col("p_name"), F.lit(" ")).alias("p_name"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_brand")).alias("p_brand"), price.alias("price")), path)
    return readers.read_csv(spark, path, numeric=("price",), bad=0.0)


def renamed_csv(spark, sf_dir) -> DataFrame:
    path = scratch_path(spark, "csv")
    writers.write_report(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey"), path)
    return readers.read_table_csv(spark, path, {"c_custkey": "user_id", "c_name": "name"}, ("user_id",))


def vector_csv(spark, sf_dir) -> DataFrame:
    """Vectors written as list literals, some spoilt, read back and checked for one length."""
    path = scratch_path(spark, "csv")
    literal = F.when(F.col("vec_id") % 9 == 0, "[bad").otherwise(F.to_json("embedding"))
    writers.write_report(table(spark, sf_dir, "embeddings").select("vec_id", literal.alias("vector")), path)
    held = readers.parsed_vectors(readers.read_csv(spark, path), "vector")
    size = hybrid.checked_dimension(held, held)
    return held.select(F.col("vec_id").cast("long").alias("vec_id"), F.round(F.get("vector", 0).cast("float").cast("double"), 6).alias("first")).withColumn("size", F.lit(size).cast("long"))


def ratings_text(spark, sf_dir) -> DataFrame:
    path = scratch_path(spark, "text")
    orders = table(spark, sf_dir, "orders")
    line = F.when(F.col("o_orderkey") % 10 == 0, "broken,line").otherwise(F.concat_ws(",", F.concat(F.lit("u"), F.col("o_custkey")), F.col("o_orderkey").cast("string"), (1 + F.col("o_orderkey") % 10).cast("string"), F.date_format("o_orderdate", "d MMMM yyyy")))
    orders.select(line.alias("value")).write.text(path)
    read = readers.read_ratings_text(spark, path)
    return read.select("user", "item", profiles.rescaled_rating(F.col("rating").cast("int")).alias("rating"), profiles.iso_date(F.col("day")).alias("day"))


def title_csv(spark, sf_dir) -> DataFrame:
    path = scratch_path(spark, "csv")
    name = F.concat(F.col("p_name"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" ("), (1900 + F.col("p_size")).cast("string"), F.lit(")"))).otherwise(""))
    writers.write_report(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("movieId"), name.alias("movieName")), path)
    return readers.read_titles(spark, path, "movieId", "movieName")


def conversation_json(spark, sf_dir) -> DataFrame:
    """Conversations as JSON lines with mentions of parts, read back with titles from both tables, and their targets."""
    path = scratch_path(spark, "json")
    orders = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    said = F.concat(F.lit("see @"), (F.col("o_custkey") % 50).cast("string"), F.lit(" or @"), key.cast("string"), F.lit(" @ 9"))
    message = lambda text, sender: F.struct(text.alias("text"), sender.cast("long").alias("senderWorkerId"))
    mentions = F.create_map((F.col("o_custkey") % 50).cast("string"), F.lit("Own (1999)"))
    orders.select(key.cast("string").alias("conversationId"), F.array(message(said, F.lit(1)), message(F.lit("ok"), F.lit(2)), message(F.lit("hm"), F.lit(0))).alias("messages"), F.to_json(mentions).alias("movieMentions"), F.lit(1).alias("initiatorWorkerId"), F.lit(2).alias("respondentWorkerId")).write.json(path)
    titles = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title"))
    return readers.read_conversations(spark, path, titles, zero_is_user=True).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")


def _files(spark, sf_dir) -> DataFrame:
    """(path) of dialogue files named by four rules, in runs by year."""
    orders, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    stamp = F.date_format("o_orderdate", "yyyyMMddHHmmss")
    counts = F.concat_ws("-", (key % 9).cast("string"), (key % 4).cast("string"), (key % 2).cast("string"), stamp)
    name = F.when(key % 4 == 0, F.concat_ws("-", F.concat(F.lit("u"), F.col("o_custkey")), F.concat(F.lit("i"), key), counts)).when(key % 4 == 1, F.concat_ws("-", F.concat(F.lit("i"), key), counts)).when(key % 4 == 2, counts).otherwise(F.concat_ws("-", F.lit("free"), key.cast("string"), F.lit("tmp"), stamp, F.lit("0a1b2c3d")))
    folder = F.concat(F.lit("/out/"), F.when(key % 3 == 0, "a").otherwise("b"), F.lit("/"), F.date_format("o_orderdate", "yyyyMM"), F.lit("/"))
    return orders.select(key.alias("key"), F.concat(folder, name, F.lit(".txt")).alias("path"))


def file_names(spark, sf_dir) -> DataFrame:
    """What each parser of file names reads."""
    path = F.col("path")
    flat = lambda s, name, fields: [F.coalesce(s[f].cast("string"), F.lit("-")).alias(f"{name}_{f}") for f in fields]
    fields = ["turns", "attempts", "succeed"]
    return _files(spark, sf_dir).select("key", *flat(readers.loose_dialogue_name(path), "loose", ["user", "item", *fields]), *flat(readers.dialogue_score(path), "score", fields), *flat(readers.tagged_name(path), "tagged", ["prefix", *fields]), F.coalesce(readers.outcome_flag(path).cast("string"), F.lit("-")).alias("flag"), readers.time_stamp(path).alias("stamp"), readers.in_progress(path).alias("in_progress"))


def file_order(spark, sf_dir) -> DataFrame:
    """The first hundred names, and the files of the latest run of each folder."""
    files = _files(spark, sf_dir).select("path")
    first = readers.first_files(files, 100).withColumn("what", F.lit("first"))
    return first.unionByName(readers.latest_run(files).select("path").withColumn("what", F.lit("latest")))


def resumed_run(spark, sf_dir) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return readers.not_yet_done(orders, orders.where("o_orderkey % 3 = 0"), "o_orderkey")


def named_files(spark, sf_dir) -> DataFrame:
    """File names of dialogues that end in the same second, a second later each."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("dialogue_id"), (F.col("o_custkey") % 5).alias("user"), F.lit("2024-01-01 00:00:58").cast("timestamp").alias("ts"))
    return writers.file_names(rows.where("dialogue_id % 10 = 0"), ["user"], "ts").select("dialogue_id", "file_name")


def interaction_order(spark, sf_dir) -> DataFrame:
    """Ratings by user and time, as a file of them is written: the place of each row."""
    path = scratch_path(spark, "csv")
    writers.write_report(_ratings(spark, sf_dir).repartitionByRange("user").sortWithinPartitions("user", "ts", "item").withColumn("row", F.monotonically_increasing_id()), path)
    held = spark.read.csv(path, header=True, schema="user long, item long, ts timestamp, row long")
    return held.groupBy("user").agg(F.count("*").alias("n"), F.min_by("ts", "row").alias("first_ts"), F.max_by("ts", "row").alias("last_ts"))


def index_round_trip(spark, sf_dir) -> DataFrame:
    """An index written with a tokenizer, read back and searched."""
    path = scratch_path(spark, "index")
    items = table(spark, sf_dir, "part").where("p_partkey < 100000000").select(F.col("p_partkey").alias("item_id"), "p_name", "p_type", F.array(F.col("p_size").cast("double"), F.lit(1.0)).alias("vector"))
    writers.write_index(items, path, ["p_name", "p_type", "p_name"], tokenizer="ascii")
    held, index = readers.read_index(spark, path)
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.lit("small ring").alias("text")).where("query_id < 3")
    found = bm25.best(bm25.scores(index, queries), 5)
    return found.join(held.select("item_id", F.round(F.get("vector", 1).cast("double"), 5).alias("second")), "item_id").select("query_id", "rank", "item_id", F.round("bm25_raw", 6).alias("bm25_raw"), "second")


def cache_upsert(spark, sf_dir) -> DataFrame:
    """A cache filled twice with overlapping rows."""
    path, docs = scratch_path(spark, "cache"), table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    docs.where("doc_id % 3 = 0").write.parquet(path)
    for rest in (1, 1, 2):
        writers.append_to_cache(docs.where(F.col("doc_id") % 3 <= rest), spark.read.schema(docs.schema).parquet(path), path, ["doc_id", "sha"])
    return spark.read.schema(docs.schema).parquet(path).agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("ids"))


def log_round_trip(spark, sf_dir) -> DataFrame:
    """Calls appended to a log of JSON lines in two runs, and the run's summary."""
    path = scratch_path(spark, "log")
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("site"), F.when(F.col("value") > 60, "timeout").alias("error_type"), (F.col("value") > 40).alias("used_fallback"))
    for _ in range(2):
        writers.write_call_log(events, path)
    counters = metrics.run_counters(spark.read.schema(events.schema).json(path), ["site"])
    summary = F.from_json("summary", "sites map<string, struct<calls: long, fallbacks: long, errors: long>>, errors long, exit_code int")
    each = writers.run_summary(counters).select(summary.alias("s")).select(F.explode("s.sites").alias("site", "c"), F.col("s.errors").alias("all_errors"), "s.exit_code")
    return each.select("site", "c.calls", "c.fallbacks", "c.errors", "all_errors", "exit_code")


def text_files(spark, sf_dir) -> DataFrame:
    """Every conversation as a text of its own, read back."""
    path = scratch_path(spark, "texts")
    writers.write_conversation_texts(table(spark, sf_dir, "conversations"), path)
    held = readers.read_conversation_texts(spark, path).select("conv_id", F.explode(F.split("text", "\n")).alias("value"))
    return held.where("value <> ''").groupBy("conv_id").agg(F.count("*").alias("lines"), F.sum(F.char_length("value")).alias("chars"))


def pair_lists(spark, sf_dir) -> DataFrame:
    """Two lists of pairs with their selection, read back."""
    path = scratch_path(spark, "pairs")
    own = _ratings(spark, sf_dir).select(F.col("user").alias("user_id"), F.col("item").alias("item_id"))
    writers.write_pairs({"odd": own.where("user_id % 2 = 1"), "even": own.where("user_id % 2 = 0")}, path)
    read = [spark.read.csv(f"{path}/{n}", header=True, schema="user_id long, item_id long").agg(F.lit(n).alias("name"), F.count("*").alias("rows"), F.sum("item_id").alias("items")) for n in ("odd", "even")]
    return read[0].unionAll(read[1]).join(spark.read.schema("name string, n long").json(f"{path}/selection"), "name")


def rewritten_texts(spark, sf_dir) -> DataFrame:
    """A new dataset of the lines with their credentials masked and labels repaired."""
    path = scratch_path(spark, "texts")
    lines = table(spark, sf_dir, "conversations").withColumn("text", F.concat(F.lit("token: abc; "), F.coalesce("text", F.lit(""))))
    writers.rewrite_texts(lines, path, "text", lambda c: T.repaired_labels(T.without_secrets(c)))
    return spark.read.schema(lines.schema).parquet(path).select("conv_id", "turn", "role", F.md5("text").alias("text_md5"))


R = "r AS (SELECT o_custkey AS u, l_partkey AS i, o_orderdate AS ts FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
TURNS = "tu AS (SELECT conv_id, count(*) AS turns FROM conversations GROUP BY conv_id)"
SCORED = TURNS + ", s AS (SELECT conv_id, conv_id % 3 AS kind, turns % 2 AS succeed, turns, turns % 5 AS attempts, conv_id % 7 <> 0 AS completed, CASE conv_id % 3 WHEN 0 THEN 'success' WHEN 1 THEN 'max_total_rounds' ELSE 'incomplete' END AS reason FROM tu)"
_uniform = lambda seed, key: f"((('0x' || substr(md5('{seed}:' || {key}), 1, 12))::BIGINT + 0.5::DOUBLE) / (1::BIGINT << 48)::DOUBLE)"
_placed = lambda seed, key, name: f"SELECT {key} AS x, row_number() OVER (ORDER BY md5('{seed}:' || {key}), {key}::VARCHAR) - 1 AS place FROM {name}"
PROMPT = "length('Expand this wish into 15 to 20 search keywords, parted by commas: ') + length(text)"
BRANDS = "b AS (SELECT p_partkey, p_name || ' ' || p_brand AS text FROM part)"
GRADED = "g AS (SELECT conv_id, turn, role, length('Grade this dialogue from 1 to 5 for fluency, informativeness and coherence, as JSON. ' || coalesce(text, '')) AS k FROM conversations), j AS (SELECT conv_id, turn, role, CASE WHEN k % 3 <> 0 THEN k % 5 + 1 END::DOUBLE AS fluency, CASE WHEN k % 3 <> 0 THEN k % 4 + 1 END::DOUBLE AS informativeness FROM g), o AS (SELECT *, round((fluency + informativeness + 3) / 3, 2) AS overall_score FROM j), q AS (SELECT *, CASE WHEN overall_score >= 4.5 THEN 'excellent' WHEN overall_score >= 3.5 THEN 'good' WHEN overall_score >= 2.5 THEN 'average' WHEN overall_score >= 1.5 THEN 'bad' WHEN overall_score IS NOT NULL THEN 'very_bad' END AS overall_quality FROM o)"
FILES = "f AS (SELECT o_orderkey AS key, strftime(o_orderdate, '%Y%m%d%H%M%S') AS stamp, o_orderkey % 9 AS t, o_orderkey % 4 AS a, o_orderkey % 2 AS k, o_custkey AS c, '/out/' || CASE WHEN o_orderkey % 3 = 0 THEN 'a' ELSE 'b' END AS parent, strftime(o_orderdate, '%Y%m') AS run FROM orders), n AS (SELECT *, CASE key % 4 WHEN 0 THEN 'u' || c || '-i' || key || '-' || t || '-' || a || '-' || k || '-' || stamp WHEN 1 THEN 'i' || key || '-' || t || '-' || a || '-' || k || '-' || stamp WHEN 2 THEN t || '-' || a || '-' || k || '-' || stamp ELSE 'free-' || key || '-tmp-' || stamp || '-0a1b2c3d' END || '.txt' AS name FROM f)"
_or = lambda test, value: f"CASE WHEN {test} THEN {value}::VARCHAR ELSE '-' END"

QUERIES = {
    "strategy_pairs": (strategy_pairs, f"WITH {R} SELECT u::VARCHAR AS user_id, i::VARCHAR AS target_id, c::INT AS copy, md5(u || ':' || i || ':' || c) AS dialogue_id FROM (SELECT DISTINCT u, i FROM r), range(2) t(c)"),
    "strategy_item_list": (strategy_item_list, f"WITH p AS ({_placed(2025, 'c_custkey', 'customer')}), n AS (SELECT count(*) AS n FROM customer), k AS (SELECT p_partkey::VARCHAR AS target_id, c::INT AS copy, (floor({_uniform(2025, 'p_partkey')} * n)::BIGINT + c) % n AS place FROM part, range(3) t(c), n) SELECT x::VARCHAR AS user_id, target_id, copy FROM k JOIN p USING (place)"),
    "strategy_user_guest": (strategy_user_guest, f"WITH p AS ({_placed(7, 'p_partkey', 'part')}), n AS (SELECT count(*) AS n FROM part), k AS (SELECT c_custkey::VARCHAR AS user_id, c::INT AS copy, (floor({_uniform(7, 'c_custkey')} * n)::BIGINT + c) % n AS place FROM customer, range(4) t(c), n) SELECT user_id, x::VARCHAR AS target_id, copy FROM k JOIN p USING (place)"),
    "strategy_items": (strategy_items, f"WITH u AS (SELECT p_partkey::VARCHAR AS id FROM part WHERE p_partkey % 11 <> 0 AND p_partkey % 13 <> 0), p AS ({_placed(2025, 'id', 'u')}), d AS (SELECT d::INT AS copy, floor({_uniform('2025:draw', 'd')} * (SELECT count(*) FROM u))::BIGINT AS place FROM range(40) t(d)) SELECT NULL::VARCHAR AS user_id, x AS target_id, copy FROM d JOIN p USING (place)"),
    "usable_items": (usable_items, "SELECT p_partkey::VARCHAR AS item_id, p_name FROM part WHERE p_partkey % 11 <> 0 AND p_partkey % 13 <> 0 AND p_partkey % 17 <> 0"),
    "user_exclusions": (user_exclusions, f"WITH {R}, m AS (SELECT u, min(i) AS t FROM r GROUP BY u), x AS (SELECT u, t, list(DISTINCT i) FILTER (i <> t) AS l FROM r JOIN m USING (u) GROUP BY ALL) SELECT u AS \"user\", t AS target, coalesce(len(l), 0) AS n, md5(coalesce(array_to_string(list_sort(l), ','), '')) AS excluded_md5 FROM x"),
    "fresh_target": (fresh_target, f"WITH {R}, h AS (SELECT DISTINCT u, i FROM r), p AS ({_placed(3, 'p_partkey', 'part')}), n AS (SELECT count(*) AS n FROM part), c AS (SELECT c_custkey AS u, x, (place - floor({_uniform(3, 'c_custkey')} * n)::BIGINT + n) % n AS k FROM customer, p, n), f AS (SELECT c.* FROM c LEFT JOIN h ON c.u = h.u AND c.x = h.i WHERE h.u IS NULL) SELECT u AS \"user\", arg_min(x, k) AS target FROM f GROUP BY u"),
    "conversation_lookup": (conversation_lookup, "WITH c AS (SELECT conv_id FROM (SELECT DISTINCT conv_id FROM conversations) ORDER BY md5('5:' || conv_id), conv_id LIMIT 30) SELECT conv_id, turn, role, md5(text) AS text_md5 FROM conversations WHERE conv_id IN (FROM c)"),
    "bernoulli_switches": (bernoulli_switches, f"SELECT {_uniform(9, 'c_custkey')} < 0.3 AS happens, ['a', 'b', 'c'][floor({_uniform(4, 'c_custkey')} * 3)::INT + 1] AS phrase, count(*) AS n FROM customer GROUP BY ALL"),
    "near_lengths": (near_lengths, f"WITH {TURNS} SELECT 'range' AS bounds, conv_id, turns FROM tu WHERE turns BETWEEN 1 AND 6 UNION ALL SELECT 'cap', conv_id, turns FROM tu WHERE turns <= 7 UNION ALL SELECT 'all', conv_id, turns FROM tu UNION ALL SELECT 'open', conv_id, turns FROM tu"),
    "empty_filter_columns": (empty_filter_columns, "SELECT * FROM (VALUES ('both', 'year_range', '900-999', 'year'), ('both', 'require_any_genre', 'no such,nor this', 'category'), ('years', 'year_range', '900-', 'year')) t(\"case\", reason, value, \"column\") WHERE (SELECT count(*) FROM part WHERE p_size >= 900) = 0"),
    "first_shown": (first_shown, f"WITH {R}, k AS (SELECT DISTINCT u, i, i % 97 AS rank FROM r WHERE i % 3 <> 0) SELECT u AS \"user\", i AS item, row_number() OVER (PARTITION BY u ORDER BY rank, i)::INT AS place FROM k QUALIFY place <= 2"),
    "unset_settings": (unset_settings, "SELECT p_partkey, p_partkey % 7 NOT IN (4, 5) AS unset FROM part"),
    "conversation_stats": (conversation_stats, f"WITH {SCORED} SELECT kind, count(*) AS n, round(CASE WHEN percent THEN round(100 * avg(succeed), 1) ELSE avg(succeed) END, 6) AS success, round(avg(turns), 6) AS mean_turns, round(avg(attempts), 6) AS mean_attempts, percent FROM s, (VALUES (true), (false)) t(percent) GROUP BY kind, percent"),
    "side_reasons": (side_reasons, f"WITH {SCORED} SELECT kind, count(*) AS n, count_if(NOT completed) AS aborted, count_if(completed AND succeed = 1) AS succeeded, round(avg((completed AND succeed = 1)::INT), 6) AS completion_rate, round(avg(turns) FILTER (completed), 6) AS mean_turns, round(avg(attempts) FILTER (completed), 6) AS mean_attempts, any_value(reason) || ':' || count(*) AS reasons FROM s GROUP BY kind"),
    "missing_partners": (missing_partners, f"WITH {TURNS} SELECT conv_id, CASE WHEN conv_id % 6 = 0 THEN 'first' ELSE 'second' END AS only FROM tu WHERE (conv_id % 4 <> 0) <> (conv_id % 6 <> 0)"),
    "pooled_folders": (pooled_folders, "SELECT count(*) AS n, sum(length(coalesce(text, '')))::BIGINT AS chars FROM conversations, range(3) t(k) WHERE conv_id % 4 <> k"),
    "conditional_norm": (conditional_norm, "SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 4) ELSE 1.0 END AS norm FROM embeddings"),
    "expanded_queries": (expanded_queries, f"WITH {BRANDS} SELECT p_partkey, CASE WHEN contains(text, '#7') THEN text ELSE text || ' K' || ({PROMPT}) END AS query, CASE WHEN contains(text, '#7') THEN 'TimeoutError' END AS error_type, contains(text, '#7') AS used_fallback FROM b"),
    "call_counters": (call_counters, f"WITH {BRANDS}, c AS (SELECT 'expand_query' AS site, text FROM b UNION ALL SELECT 'describe_chat', text FROM b WHERE p_partkey % 2 = 0) SELECT site, count(*) AS calls, count_if(contains(text, '#7')) AS fallbacks, count_if(contains(text, '#7')) AS errors, CASE WHEN (SELECT count_if(contains(text, '#7')) FROM c) > 0 THEN 3 ELSE 0 END AS exit_code FROM c GROUP BY site"),
    "chat_titles": (chat_titles, f"WITH {BRANDS} SELECT p_partkey, CASE WHEN contains(text, '#7') THEN 'item' ELSE 'K' || (length('Name the item that this chat is about, the title only: ') + length(text)) END AS title FROM b"),
    "asked_attributes": (asked_attributes, "SELECT p_partkey, CASE WHEN contains(p_name, 'ring') THEN 'Colour,P-Type,year' ELSE 'price,p_type,year' END AS asks FROM part"),
    "attribute_values": (attribute_values, "SELECT p_partkey, CASE WHEN p_partkey % 3 = 1 THEN 'own' WHEN contains(p_name, 'blue') THEN 'blue' END AS value FROM part"),
    "profile_summaries": (profile_summaries, "SELECT count(*) AS n, count_if(c_custkey % 5 = 0) AS blank, sum(CASE WHEN c_custkey % 5 <> 0 AND NOT starts_with(c_custkey::VARCHAR, '7') THEN length('K' || (length('Summarise the taste behind these ratings in a paragraph: #') + length(c_custkey::VARCHAR))) ELSE 0 END)::BIGINT AS chars, count_if(c_custkey % 5 <> 0 AND starts_with(c_custkey::VARCHAR, '7')) AS failed FROM customer"),
    "judged_dialogues": (judged_dialogues, f"WITH {GRADED} SELECT * FROM q"),
    "judge_means": (judge_means, f"WITH {GRADED} SELECT overall_quality, count(*) AS n, round(avg(fluency), 6) AS fluency, round(avg(informativeness), 6) AS informativeness, round(avg(overall_score), 6) AS overall_score FROM q GROUP BY overall_quality"),
    "embedded_texts": (embedded_texts, "SELECT p_partkey, 64::BIGINT AS size, 1.0::DOUBLE AS norm FROM part"),
    "csv_round_trip": (csv_round_trip, "SELECT p_partkey::VARCHAR AS p_partkey, p_name, CASE WHEN p_partkey % 3 <> 0 THEN p_brand ELSE '' END AS p_brand, CASE WHEN p_partkey % 4 = 0 THEN 0.0 ELSE p_retailprice END AS price FROM part"),
    "renamed_csv": (renamed_csv, "SELECT c_custkey::VARCHAR AS user_id, c_name AS name, c_nationkey::INT AS c_nationkey FROM customer"),
    "vector_csv": (vector_csv, "SELECT vec_id, round(embedding[1]::DOUBLE, 6) AS first, 64::BIGINT AS size FROM embeddings WHERE vec_id % 9 <> 0"),
    "ratings_text": (ratings_text, "SELECT 'u' || o_custkey AS \"user\", o_orderkey::VARCHAR AS item, greatest(1, round_even((1 + o_orderkey % 10) / 2, 0)::INT)::INT AS rating, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE o_orderkey % 10 <> 0"),
    "title_csv": (title_csv, "SELECT p_partkey::VARCHAR AS item_id, p_name AS title, p_name || CASE WHEN p_partkey % 2 = 0 THEN ' (' || (1900 + p_size) || ')' ELSE '' END AS \"full\" FROM part"),
    "conversation_json": (conversation_json, "SELECT o_orderkey AS conv_id, t AS turn, CASE WHEN t = 1 THEN 'assistant' ELSE 'user' END AS role, CASE t WHEN 0 THEN 'see Own (1999) or ' || CASE WHEN o_orderkey = o_custkey % 50 THEN 'Own (1999)' ELSE coalesce(p_name, 'movie#' || o_orderkey) END || ' @ 9' WHEN 1 THEN 'ok' ELSE 'hm' END AS text FROM orders LEFT JOIN part ON p_partkey = o_orderkey, range(3) s(t)"),
    "file_names": (file_names, f"WITH {FILES} SELECT key, {_or('key % 4 = 0', chr(39) + 'u' + chr(39) + ' || c')} AS loose_user, {_or('key % 4 < 2', chr(39) + 'i' + chr(39) + ' || key')} AS loose_item, {_or('key % 4 < 2', 't')} AS loose_turns, {_or('key % 4 < 2', 'a')} AS loose_attempts, {_or('key % 4 < 2', 'k')} AS loose_succeed, {_or('key % 4 < 2', 't')} AS score_turns, {_or('key % 4 < 2', 'a')} AS score_attempts, {_or('key % 4 < 2', 'k')} AS score_succeed, CASE key % 4 WHEN 0 THEN 'u' || c || '-i' || key WHEN 1 THEN 'i' || key ELSE '' END AS tagged_prefix, {_or('key % 4 < 3', 't')} AS tagged_turns, {_or('key % 4 < 3', 'a')} AS tagged_attempts, {_or('key % 4 < 3', 'k')} AS tagged_succeed, {_or('key % 4 < 3', 'k')} AS flag, CASE WHEN key % 4 < 3 THEN stamp ELSE '' END AS stamp, key % 4 = 3 AS in_progress FROM n"),
    "file_order": (file_order, f"WITH {FILES}, p AS (SELECT parent || '/' || run || '/' || name AS path, parent, run, key FROM n), l AS (SELECT parent, max(run) AS run FROM p WHERE key % 4 < 3 GROUP BY parent) (SELECT path, 'first' AS what FROM p ORDER BY path LIMIT 100) UNION ALL SELECT path, 'latest' FROM p JOIN l USING (parent, run) WHERE key % 4 < 3"),
    "resumed_run": (resumed_run, "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 3 <> 0"),
    "named_files": (named_files, "SELECT o_orderkey AS dialogue_id, (o_custkey % 5) || '-' || strftime(TIMESTAMP '2024-01-01 00:00:58' + to_seconds(row_number() OVER (PARTITION BY o_custkey % 5 ORDER BY o_orderkey) - 1), '%Y%m%d%H%M%S') || '.txt' AS file_name FROM orders WHERE o_orderkey % 10 = 0"),
    "interaction_order": (interaction_order, f"WITH {R} SELECT u AS \"user\", count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM r GROUP BY u"),
    "index_round_trip": (index_round_trip, "WITH d AS (SELECT p_partkey, p_size, string_split(lower(p_name || ' ' || p_type), ' ') AS t FROM part), x AS (SELECT p_partkey, p_size, len(t) AS dl, t FROM d), st AS (SELECT count(*) AS n, avg(dl) AS avgdl, count_if(list_contains(t, 'small')) AS d1, count_if(list_contains(t, 'ring')) AS d2 FROM x), h AS (SELECT x.*, list_sum(list_transform([[len(list_filter(t, lambda w: w = 'small')), d1], [len(list_filter(t, lambda w: w = 'ring')), d2]], lambda e: greatest(CASE WHEN ln((n - e[2] + 0.5) / (e[2] + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - e[2] + 0.5) / (e[2] + 0.5)) END, 0) * (e[1] * 2.2 / (e[1] + 1.2 * (0.25 + 0.75 * dl / avgdl))))) AS raw FROM x, st WHERE list_has_any(t, ['small', 'ring'])), r AS (SELECT *, row_number() OVER (ORDER BY round(raw, 8) DESC, p_partkey) AS rank FROM h QUALIFY rank <= 5) SELECT query_id, rank::INT AS rank, p_partkey AS item_id, round(raw, 6) AS bm25_raw, round((1 / sqrt(p_size * p_size + 1))::FLOAT::DOUBLE, 5) AS second FROM r, (SELECT item_id AS query_id FROM benchmark WHERE item_id < 3)"),
    "cache_upsert": (cache_upsert, "SELECT count(*) AS n, count(DISTINCT doc_id) AS ids FROM documents"),
    "log_round_trip": (log_round_trip, "SELECT event_type AS site, 2 * count(*) AS calls, 2 * count_if(value > 40) AS fallbacks, 2 * count_if(value > 60) AS errors, (SELECT 2 * count_if(value > 60) FROM events) AS all_errors, CASE WHEN (SELECT count_if(value > 40) FROM events) > 0 THEN 3 ELSE 0 END AS exit_code FROM events GROUP BY event_type"),
    "text_files": (text_files, "WITH l AS (SELECT conv_id, unnest(string_split(CASE role WHEN 'user' THEN 'User' WHEN 'system' THEN 'System' ELSE 'Bot' END || ': ' || coalesce(text, ''), chr(10))) AS value FROM conversations) SELECT conv_id, count(*) AS lines, sum(length(value))::BIGINT AS chars FROM l WHERE value <> '' GROUP BY conv_id"),
    "pair_lists": (pair_lists, f"WITH {R} SELECT CASE WHEN u % 2 = 1 THEN 'odd' ELSE 'even' END AS name, count(*) AS rows, sum(i)::BIGINT AS items, count(*) AS n FROM r GROUP BY 1"),
    "rewritten_texts": (rewritten_texts, "SELECT conv_id, turn, role, md5('token: ***; ' || coalesce(text, '')) AS text_md5 FROM conversations"),
}
