"""Readers, writers, samples, providers, streams and the dialogue loop on small inputs."""

import json

import pytest
from pyspark.sql import functions as F

from cairnlake.operators import bm25, dialogue, metrics, profiles, sampling
from cairnlake.operators.providers import hashed_embedding, template_text, with_embedding, with_text
from cairnlake.sources import readers, writers
from cairnlake.streaming.preferences import preference_windows


def test_csv_and_vectors(spark, tmp_path):
    (tmp_path / "items.csv").write_text('Unnamed: 0,id,title,price,vec\n0, 7 ,Alien,12.5,"[0.6, 0.8]"\n1,8,,x,"[bad"\n')
    items = readers.read_csv(spark, str(tmp_path / "items.csv"), numeric=("price",))
    assert [tuple(r) for r in items.collect()] == [("7", "Alien", 12.5, "[0.6, 0.8]"), ("8", "", None, "[bad")]
    assert [r["vec"] for r in readers.parsed_vectors(items, "vec").collect()] == [[0.6, 0.8]]


def test_ratings_text(spark, tmp_path):
    (tmp_path / "r.txt").write_text("u1,i1,7,16 January 2005\nbroken,line\nu2,i2,5,no day\n")
    rows = readers.read_ratings_text(spark, str(tmp_path / "r.txt")).withColumn("r", profiles.rescaled_rating(F.col("rating").cast("int"))).withColumn("d", profiles.iso_date(F.col("day")))
    assert sorted((r["user"], r["r"], r["d"]) for r in rows.collect()) == [("u1", 4, "2005-01-16"), ("u2", 2, None)]


def test_conversations_and_names(spark, tmp_path):
    line = {"conversationId": "9", "initiatorWorkerId": 1, "respondentWorkerId": 2, "movieMentions": {"11": "Heat (1995)"}, "respondentQuestions": {}, "messages": [{"text": "I like @11 and @12", "senderWorkerId": 1}, {"text": "ok", "senderWorkerId": 2}]}
    (tmp_path / "c.jsonl").write_text(json.dumps(line) + "\n")
    raw = spark.read.schema("movieMentions string").json(str(tmp_path / "c.jsonl")).first()[0]
    assert json.loads(raw) == {"11": "Heat (1995)"}
    rows = readers.read_conversations(spark, str(tmp_path / "c.jsonl")).orderBy("turn").collect()
    assert [(r["role"], r["text"]) for r in rows] == [("user", "I like Heat (1995) and movie#12"), ("assistant", "ok")]


def test_targets(spark, tmp_path):
    asked = [{"1": {"suggested": 0, "liked": 1}, "9": {"suggested": 1, "liked": 2}, "3": {"suggested": 1, "liked": 1}}, {"5": {"suggested": 1, "liked": 0}}, []]
    (tmp_path / "c.jsonl").write_text("\n".join(json.dumps({"conversationId": str(i), "respondentQuestions": q}) for i, q in enumerate(asked)))
    rows = readers.conversation_targets(spark, str(tmp_path / "c.jsonl")).orderBy("conv_id").collect()
    assert [(r["n_suggested"], r["n_liked"], r["target"], r["accepted"]) for r in rows] == [(2, 1, "3", True), (1, 0, "5", False), (0, 0, None, False)]


@pytest.mark.parametrize(("name", "loose", "score", "flag", "stamp"), [("/d/u-i-5-2-1-20250101120000.txt", ("u", "i", 5, 2, 1), (5, 2, 1), 1, "20250101120000"), ("i-5-2-0-20250101120000.txt", (None, "i", 5, 2, 0), (5, 2, 0), 0, "20250101120000"), ("a-b-c-d-5-2-1-20250101120000.txt", None, (5, 2, 1), 1, "20250101120000")])
def test_name_parsers(spark, name, loose, score, flag, stamp):
    row = spark.createDataFrame([(name,)], "p string").select(readers.loose_dialogue_name(F.col("p")).alias("a"), readers.dialogue_score(F.col("p")).alias("b"), readers.outcome_flag(F.col("p")).alias("c"), readers.time_stamp(F.col("p")).alias("d")).first()
    assert (row["a"] and tuple(row["a"]), tuple(row["b"]), row["c"], row["d"]) == (loose, score, flag, stamp)


def test_dialogue_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "u-tmp3-i-9-5-2-1-20250101120000.txt").write_text("Bot: hi")
    (tmp_path / "a" / "u-i-tmp-20250101120000-0a1b2c3d.txt").write_text("Bot: hi")
    rows = readers.read_dialogues(spark, str(tmp_path)).select(readers.dialogue_name(F.col("path")).alias("n")).collect()
    assert [(r["n"]["turns"], r["n"]["attempts"], r["n"]["succeed"], r["n"]["ts"]) for r in rows] == [(5, 2, 1, "20250101120000")]


def test_index_round_trip(spark, tmp_path):
    items = spark.createDataFrame([(1, "red ring", "x", [3.0, 4.0]), (2, "blue", None, [0.0, 2.0])], "item_id long, title string, note string, vector array<double>")
    writers.write_index(items, str(tmp_path / "ix"), ["title", "note", "title", "absent"])
    held, index = readers.read_index(spark, str(tmp_path / "ix"))
    assert {r["item_id"]: r["search_text"] for r in held.collect()} == {1: "red ring x", 2: "blue "}
    assert held.where("item_id = 1").first()["vector"] == pytest.approx([0.6, 0.8])
    assert index.corpus.first()["n"] == 2
    with pytest.raises(ValueError):
        writers.write_index(items.withColumn("vector", F.array(F.lit(0.0))), str(tmp_path / "bad"), ["title"])


def test_cache_failures_and_names(spark, tmp_path):
    cache = spark.createDataFrame([(1, "a")], "id long, sha string")
    writers.append_to_cache(spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id long, sha string"), cache, str(tmp_path / "c"), ["id", "sha"])
    assert spark.read.parquet(str(tmp_path / "c")).count() == 1
    assert writers.write_unless_failed(cache, str(tmp_path / "w"), F.col("sha") == "a") == 1
    assert not (tmp_path / "w").exists()
    rows = spark.createDataFrame([("d1", "u", "2025-01-01 00:00:00"), ("d2", "u", "2025-01-01 00:00:00")], "dialogue_id string, user string, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert sorted(r["file_name"] for r in writers.file_names(rows, ["user"], "ts").collect()) == ["u-20250101000000.txt", "u-20250101000001.txt"]


def test_samples(spark):
    rows = spark.range(200).withColumnRenamed("id", "k").withColumn("g", F.col("k") % 4)
    assert sampling.without_replacement(rows, "k", 500, 1).count() == 200
    assert sampling.per_group(rows, "g", "k", 3, 1).groupBy("g").count().where("count = 3").count() == 4
    places = sorted(r["place"] for r in sampling.numbered(rows, "k", 1).collect())
    assert places == list(range(200))
    assert sampling.with_replacement(rows, "k", 50, 1).count() == 50
    assert sampling.stratified(rows, "g", "k", 20, 1).groupBy("g").count().where("count = 5").count() == 4
    drawn = sampling.matched(rows, rows.where("g = 2"), "k", "g", 10, 1)
    assert {r["g"] for r in drawn.collect()} == {2}


def test_providers(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, None)], "id long, t string")
    a, b = (with_embedding(rows, "t", "v").orderBy("id").collect() for _ in range(2))
    assert a == b and len(a[0]["v"]) == 64

    def failing():
        def write(prompts):
            if any("a" in p for p in prompts):
                raise TimeoutError
            return template_text(["<{}>"])(prompts)

        return write

    got = with_text(rows, "t", "x", failing, fallback="sorry").orderBy("id").collect()
    assert [tuple(r["x"]) for r in got] == [("sorry", "TimeoutError", True), ("<>", None, False)]


def test_taste_falls_back(spark):
    rows = spark.createDataFrame([("a", "2001-07-20", 1.0), ("a", "1999-01-01", 3.0), ("b", "1999-01-01", 5.0)], "user string, ts string, value double").withColumn("ts", F.to_timestamp("ts"))
    out = {r["user"]: r for r in profiles.taste_windows(rows, "user", "ts", "value", F.lit("2001-08-01").cast("timestamp"), 30).collect()}
    assert (out["a"]["mean_long"], out["a"]["mean_short"], out["a"]["fallback"]) == (2.0, 1.0, False)
    assert (out["b"]["mean_short"], out["b"]["fallback"]) == (5.0, True)


def test_dialogues_end_by_every_rule(spark):
    words = ["red ring of gold", "blue bolt of iron", "green gear of brass", "old anvil of steel"]
    items = with_embedding(spark.createDataFrame([(i, t.split(" of ")[0], t) for i, t in enumerate(words)], "item_id long, title string, text string"), "text", "vector").cache()
    index = bm25.build_index(items.select(F.col("item_id").alias("doc_id"), "text"))
    tasks = spark.createDataFrame([("d1", 1, 0), ("d2", 1, 3), ("d3", 2, 99)], "dialogue_id string, user_id long, target_id long")
    out = {r["dialogue_id"]: r for r in dialogue.simulate(tasks, items, index).collect()}
    assert out["d1"]["status"] == out["d2"]["status"] == "success" and out["d3"]["status"] == "target_not_found"
    assert out["d1"]["turns"] == 1 + out["d1"]["rounds"] + out["d1"]["shown"]
    strict = dialogue.simulate(tasks.limit(1), items, index, dialogue.hybrid.Weights(threshold=2.0), dialogue.Rules(max_rounds=3)).first()
    assert (strict["status"], strict["shown"], strict["rounds"]) == ("max_rounds", 0, 3)


def test_rates(spark):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:30"), (1, "2024-01-01 00:02:00")], "k long, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert sorted(r["in_window"] for r in metrics.rate_windows(rows, "k", "ts", 60).collect()) == [1, 1, 2]


def test_stream_of_preferences(spark, sf, tmp_path):
    source = spark.read.parquet(f"{sf}/events.parquet")
    stream = spark.readStream.schema(source.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    query = preference_windows(stream).writeStream.format("memory").queryName("prefs").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("prefs").agg(F.sum("n")).first()[0] == source.count()


def test_conversation_shards_and_their_index(spark, tmp_path):
    from cairnlake.sources import readers, writers

    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"Zeile {t} é\nmore" * (1 + c % 3)) for c in range(25) for t in range(c % 7)] + [(90, 0, "system", None)]
    path = str(tmp_path / "texts")
    lines = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for size in (200, 10_000_000):  # the second one replaces the first
        writers.write_conversation_texts(lines, path, shard_bytes=size)
        parts = {}
        for r in readers.read_conversation_texts(spark, path).collect():
            parts.setdefault(r["conv_id"], []).append((r["shard"], r["text"]))
        names = {"user": "User", "assistant": "Bot", "system": "System"}
        want = {}
        for c, _, role, text in rows:
            want[c] = want.get(c, "") + f"{names[role]}: {text or ''}\n"
        assert {c: "".join(t for _, t in sorted(p)) for c, p in parts.items()} == want
    assert len({s for p in parts.values() for s, _ in p}) == 1
    some = readers.read_conversation_texts(spark, path, spark.createDataFrame([(3,), (90,)], "conv_id long")).collect()
    assert {r["conv_id"] for r in some} == {3, 90}
    assert not [p for p in tmp_path.iterdir() if "new-" in p.name]


def test_cache_goes_on_behind_its_last_commit(spark, tmp_path):
    from pyspark.sql import functions as F

    from cairnlake.sources import commits

    path, asked = str(tmp_path / "cache"), []
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(25)] + [(3, "t3")], "i long, t string")

    def make(part, fail_at=None):
        asked.append(sorted(r["i"] for r in part.collect()))
        if len(asked) == fail_at:
            raise RuntimeError("killed")
        return part.select("i", F.upper("t").alias("v"))

    assert commits.read_commits(spark, path) is None
    with pytest.raises(RuntimeError):
        commits.fill(rows, path, ["i"], lambda part: make(part, 3), 10)
    assert commits.read_commits(spark, path).count() == 20
    spark.createDataFrame([(99, "x")], "i long, v string").write.parquet(f"{path}/batches/000000000002-dead")  # written, never committed
    assert commits.fill(rows, path, ["i"], make, 10) == 1
    assert commits.fill(rows, path, ["i"], make, 10) == 0
    held = commits.read_commits(spark, path).collect()
    assert sorted((r["i"], r["v"]) for r in held) == [(i, f"T{i}") for i in range(25)]
    assert asked == [list(range(10)), list(range(10, 20)), list(range(20, 25)), list(range(20, 25))]
    assert len(commits.commits(spark, path)) == 3


def test_vectors_through_the_cache(spark, tmp_path):
    from cairnlake.sources import commits
    from cairnlake.sources.embedded import EmbeddingsNeeded, computed_vectors, with_vectors

    cache, log = str(tmp_path / "cache"), tmp_path / "asked"

    def provider(fail=False):
        def make():
            def embed(texts):
                with log.open("a") as f:
                    f.writelines(t + "\n" for t in texts)
                if fail and any("5" in t for t in texts):
                    raise RuntimeError("no answer")
                return [[float(len(t)), 1.0] for t in texts]

            return embed

        return make

    rows = [(i, f"text {i}") for i in range(9)] + [(9, None)]
    items = spark.createDataFrame(rows, "item_id long, search_text string")
    with pytest.raises(EmbeddingsNeeded) as error:
        computed_vectors(items, cache, "m", provider(), most=9)
    assert error.value.plan["misses"] == 10 and not log.exists()
    with pytest.raises(Exception, match="no answer"):
        computed_vectors(items, cache, "m", provider(fail=True), most=None, rows_a_commit=3)
    kept = commits.read_commits(spark, cache).count()
    assert kept == 3
    log.unlink()
    got = {r["item_id"]: r["vector"] for r in computed_vectors(items, cache, "m", provider(), most=10, rows_a_commit=3).collect()}
    assert got == {i: [float(len(t or "")), 1.0] for i, t in rows}
    assert len(log.read_text().splitlines()) == 10 - kept
    log.unlink()
    changed = spark.createDataFrame([*rows[:8], (8, "another text")], "item_id long, search_text string")
    assert with_vectors(changed, "absent", cache, "m", make=provider(), most=1).count() == 9
    assert log.read_text() == "another text\n"
    with pytest.raises(EmbeddingsNeeded):
        computed_vectors(items, cache, "another model", provider())
    own = spark.createDataFrame([(1, "[1.0, 2.0]"), (2, "none")], "item_id long, v string")
    assert with_vectors(own, "v", cache, "m").count() == 1


def test_settings_are_merged():
    from cairnlake.sources.readers import merged_settings

    low, high = {"a": 1, "b": {"x": 1, "y": 2}}, {"a": 2, "c": None}
    assert merged_settings(low, high) == {"a": 2, "b": {"x": 1, "y": 2}, "c": None}
    assert merged_settings() == {} and low == {"a": 1, "b": {"x": 1, "y": 2}}
