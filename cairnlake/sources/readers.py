"""Readers of catalogues, interactions, dialogues and the engine's own index."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlake.functions.text import title_without_year
from cairnlake.operators.bm25 import TextIndex


def read_csv(spark: SparkSession, path: str, numeric: tuple[str, ...] = (), bad: float | None = None) -> DataFrame:
    """A CSV with a header: nulls of text columns become empty, ``numeric`` columns doubles, ``bad`` where they don't parse.

    Columns without a name (written by an index) are dropped and texts are trimmed.
    """
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    named = [c for c in raw.columns if c and not c.startswith(("_c", "Unnamed"))]
    return raw.select(*(F.coalesce(F.col(c).try_cast("double"), F.lit(bad)).alias(c) if c in numeric else F.trim(F.coalesce(c, F.lit(""))).alias(c) for c in named))


def parsed_vectors(items: DataFrame, column: str) -> DataFrame:
    """``items`` with the list literals of a column as vectors; rows that don't parse are dropped."""
    vector = F.from_json(F.col(column), "array<double>")
    return items.withColumn(column, vector).where(F.col(column).isNotNull() & F.forall(column, lambda x: x.isNotNull()))


def read_ratings_text(spark: SparkSession, path: str) -> DataFrame:
    """(user, item, rating, day) of lines ``user,item,rating,day``; lines with fewer parts are dropped."""
    parts = F.split(F.col("value"), ",", 4)
    return spark.read.text(path).select(parts.alias("p")).where(F.size("p") == 4).select(*(F.trim(F.col("p")[i]).alias(n) for i, n in enumerate(("user", "item", "rating", "day"))))


def read_titles(spark: SparkSession, path: str, item_id: str, name: str) -> DataFrame:
    return spark.read.csv(path, header=True).select(F.col(item_id).cast("string").alias("item_id"), title_without_year(F.col(name)).alias("title"), F.col(name).alias("full"))


CONVERSATION = "conversationId string, messages array<struct<text: string, senderWorkerId: long>>, movieMentions string, respondentQuestions string, initiatorWorkerId long, respondentWorkerId long"


def read_conversations(spark: SparkSession, path: str, titles: DataFrame | None = None, zero_is_user: bool = False) -> DataFrame:
    """(conv_id, turn, role, text) of a JSON-lines file of conversations.

    Mentions ``@id`` become the title that the conversation lists, else that of ``titles`` (item_id, title), else ``movie#id``.
    The initiator is the user and anyone else the assistant; with ``zero_is_user`` the sender 0 is the user, too.
    """
    raw = spark.read.schema(CONVERSATION).json(path)
    mentions = F.coalesce(F.from_json("movieMentions", "map<string,string>"), F.create_map().cast("map<string,string>"))
    each = raw.select("conversationId", "initiatorWorkerId", "respondentWorkerId", mentions.alias("names"), F.posexplode("messages").alias("turn", "m"))
    sender = F.col("m.senderWorkerId")
    role = F.when((sender == F.col("initiatorWorkerId")) | (F.lit(zero_is_user) & (sender == 0) & (F.col("respondentWorkerId") != 0)), "user").otherwise("assistant")
    if titles is not None:
        asked = each.select("conversationId", "turn", F.explode(F.regexp_extract_all("m.text", F.lit(r"@(\d+)"), 1)).alias("item_id")).distinct()
        known = asked.join(titles.select(F.col("item_id").cast("string").alias("item_id"), "title"), "item_id").groupBy("conversationId", "turn").agg(F.map_from_entries(F.collect_list(F.struct("item_id", "title"))).alias("more"))
        each = each.join(known, ["conversationId", "turn"], "left")
        own = F.coalesce("more", F.create_map().cast("map<string,string>"))
        each = each.withColumn("names", F.map_concat(F.map_filter(own, lambda k, _: ~F.map_contains_key("names", k)), "names"))
    pieces = F.regexp_extract_all("m.text", F.lit(r"(@\d+|[^@]+|@)"), 1)
    named = F.array_join(F.transform(pieces, lambda x: F.when(x.rlike(r"^@\d+$"), F.coalesce(F.try_element_at("names", F.substring(x, 2, 20)), F.concat(F.lit("movie#"), F.substring(x, 2, 20)))).otherwise(x)), "")
    return each.select(F.col("conversationId").alias("conv_id"), "turn", role.alias("role"), named.alias("text"))


def read_dialogues(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text) of finished dialogue files under a folder; files in progress are left out."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").option("wholetext", "true").text(folder)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")).where(~in_progress(F.col("path")))


def in_progress(path: Column) -> Column:
    return path.rlike(r"-tmp-\d{14}-[0-9a-f]{8}\.txt$")


def dialogue_name(path: Column) -> Column:
    """(user, item, turns, attempts, succeed, ts) of ``user-item-turns-attempts-succeed-ts.txt``; ids may hold dashes."""
    pattern = r"([^/]*?)-([^/]*)-(\d+)-(\d+)-([01])-(\d{14})\.txt$"
    return F.struct(*(F.regexp_extract(path, pattern, i).alias(n) for i, n in ((1, "user"), (2, "item"))), *(F.regexp_extract(path, pattern, i).try_cast("int").alias(n) for i, n in ((3, "turns"), (4, "attempts"), (5, "succeed"))), F.regexp_extract(path, pattern, 6).alias("ts"))


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, TextIndex]:
    """Items and text index as :func:`cairnlake.sources.writers.write_index` left them; row numbers must be complete."""
    parts = {n: spark.read.parquet(f"{path}/{n}") for n in ("items", "postings", "doc_len", "term_df", "corpus")}
    seen = parts["items"].agg(F.count("*").alias("n"), F.countDistinct("item_id").alias("d")).first()
    if seen["n"] != seen["d"] or seen["n"] != parts["corpus"].first()["n"]:
        raise ValueError("the index is not complete: item numbers repeat or its tables differ in size")
    return parts.pop("items"), TextIndex(**parts)


def not_yet_done(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a run that is taken up again still has to do."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def loose_dialogue_name(path: Column) -> Column:
    """(user, item, turns, attempts, succeed) of a name split at its dashes into six parts, or five for one without user."""
    parts = F.split(F.regexp_replace(F.regexp_extract(path, r"([^/]*)\.txt$", 1), r"-\d{14}$", "-ts"), "-")
    known = F.when(F.size(parts) == 6, parts).when(F.size(parts) == 5, F.concat(F.array(F.lit(None).cast("string")), parts))
    fields = [known[0].alias("user"), known[1].alias("item"), *(known[i].try_cast("int").alias(n) for i, n in ((2, "turns"), (3, "attempts"), (4, "succeed")))]
    numbers = [known[i].try_cast("int").isNotNull() for i in (2, 3, 4)]
    return F.when(numbers[0] & numbers[1] & numbers[2], F.struct(*fields))


def dialogue_score(path: Column) -> Column:
    """(turns, attempts, succeed) of any name that ends in these three and a time stamp, whatever stands before."""
    pattern = r"-(\d+)-(\d+)-([01])-\d{14}\.txt$"
    return F.struct(*(F.regexp_extract(path, pattern, i).try_cast("int").alias(n) for i, n in ((1, "turns"), (2, "attempts"), (3, "succeed"))))


def outcome_flag(path: Column) -> Column:
    """The last but one part of a name, as a number."""
    return F.try_element_at(F.split(path, "-"), F.lit(-2)).try_cast("int")


def time_stamp(path: Column) -> Column:
    """The fourteen digits that end a name."""
    return F.regexp_extract(path, r"(\d{14})\.txt$", 1)


def conversation_targets(spark: SparkSession, path: str) -> DataFrame:
    """(conv_id, n_suggested, n_liked, target, accepted) of a JSON-lines file: the first liked suggestion, else the first one."""
    raw = spark.read.schema(CONVERSATION).json(path)
    asked = F.map_entries(F.from_json("respondentQuestions", "map<string,struct<suggested: int, liked: int>>"))
    suggested = F.filter(F.coalesce(asked, F.array().cast("array<struct<key: string, value: struct<suggested: int, liked: int>>>")), lambda e: e["value"]["suggested"] == 1)
    liked = F.filter(suggested, lambda e: e["value"]["liked"] == 1)
    return raw.select(F.col("conversationId").alias("conv_id"), F.size(suggested).alias("n_suggested"), F.size(liked).alias("n_liked"), F.coalesce(F.get(liked, 0)["key"], F.get(suggested, 0)["key"]).alias("target"), (F.size(liked) > 0).alias("accepted"))


def tagged_name(path: Column) -> Column:
    """(prefix, turns, attempts, succeed) of a name whose part before the three numbers may be missing."""
    pattern = r"(?:^|/)(?:([^/]*)-)?(\d+)-(\d+)-([01])-\d{14}\.txt$"
    return F.struct(F.regexp_extract(path, pattern, 1).alias("prefix"), *(F.regexp_extract(path, pattern, i).try_cast("int").alias(n) for i, n in ((2, "turns"), (3, "attempts"), (4, "succeed"))))


def first_files(files: DataFrame, limit: int, path: str = "path") -> DataFrame:
    """The first ``limit`` rows by name."""
    return files.orderBy(path).limit(limit)


def latest_run(files: DataFrame, path: str = "path") -> DataFrame:
    """The finished dialogue files of each parent folder's latest run, the greatest folder name that holds any."""
    parts = r"^(.*)/([^/]+)/([^/]+\.txt)$"
    each = files.withColumns({"parent": F.regexp_extract(path, parts, 1), "run": F.regexp_extract(path, parts, 2)}).where(~in_progress(F.col(path)) & (F.regexp_extract(path, parts, 3) != ""))
    return each.join(each.groupBy("parent").agg(F.max("run").alias("run")), ["parent", "run"], "left_semi")


def read_table_csv(spark: SparkSession, path: str, names: dict[str, str], text_ids: tuple[str, ...] = ()) -> DataFrame:
    """A CSV whose columns are renamed by ``names`` (its name: ours), those of ``text_ids`` as text; other columns stay."""
    raw = spark.read.csv(path, header=True, inferSchema=True, multiLine=True, escape='"')
    renamed = raw.select(*(F.col(f"`{c}`").alias(names.get(c, c)) for c in raw.columns))
    return renamed.withColumns({c: F.col(c).cast("string") for c in text_ids if c in renamed.columns})


def merged_settings(*layers: dict) -> dict:
    """Settings of several files, later ones over earlier ones; null layers change nothing."""
    out: dict = {}
    for layer in layers:
        out.update(layer or {})
    return out


def read_conversation_texts(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """(conv_id, shard, text) of the shards :func:`cairnlake.sources.writers.write_conversation_texts` wrote.

    ``wanted`` (conv_id) reads the shards that hold these alone; a task holds a shard and cuts each conversation's bytes out of it.
    """
    index = spark.read.parquet(f"{path}/index")
    if wanted is not None:
        index = index.join(wanted.select("conv_id").distinct(), "conv_id", "left_semi")
    shards = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(f"{path}/text")
    held = shards.select(F.regexp_extract("path", r"shard=(\d+)", 1).cast("long").alias("shard"), "content")

    if wanted is not None:
        held = held.join(index.select("shard").distinct(), "shard", "left_semi")

    def cut(content: pa.Table, own: pa.Table) -> pa.Table:
        own = own if content.num_rows else own.slice(0, 0)
        whole = memoryview(content["content"][0].as_buffer()) if own.num_rows else memoryview(b"")
        texts = [str(whole[b : b + n], "utf-8", "replace") for b, n in zip(own["first_byte"].to_pylist(), own["n_bytes"].to_pylist(), strict=True)]
        return pa.table({"conv_id": own["conv_id"], "shard": own["shard"], "text": pa.array(texts, pa.string())})

    kind = index.schema["conv_id"].dataType.simpleString()
    return held.groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(cut, f"conv_id {kind}, shard long, text string")
