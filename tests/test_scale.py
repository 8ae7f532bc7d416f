"""What larger tables asked for: wide sums, many commits, large blocks and repeated texts, against plain results."""

import hashlib
import time

import pyarrow as pa
from pyspark.sql import functions as F

from cairnlake.functions import text
from cairnlake.functions.porter import stem
from cairnlake.operators import admission, bm25, dialogue, edits, knn, metrics
from cairnlake.operators.providers import with_embedding
from cairnlake.sources import commits, readers, writers


def test_content_digest_passes_64_bits(spark):
    n = 140_000
    got = metrics.content_digest(spark.range(n), ["id"]).first()
    whole = sum(int(hashlib.md5(str(i).encode()).hexdigest()[:12], 16) for i in range(n))
    assert whole > 2**63 and (got["n"], got["digest"]) == (n, str(whole))


def test_waits_pass_64_bits(spark):
    rows = [("a", 2**62), ("a", 2**62), ("a", 0), ("b", 5), (None, None)]
    got = {r["gate"]: tuple(r)[1:] for r in admission.waits(spark.createDataFrame(rows, "gate string, w long"), ["gate"], F.col("w")).collect()}
    assert got == {"a": (3, 2, 2**63, 2**62), "b": (1, 1, 5, 5), None: (1, 0, None, None)}
    small = admission.waits(spark.createDataFrame(rows[1:], "gate string, w long"), ["gate"], F.col("w"))
    assert small.schema["total_wait_us"].dataType.simpleString() == "bigint"
    assert {r["gate"]: r["total_wait_us"] for r in small.collect()} == {"a": 2**62, "b": 5, None: None}


def _repeated(spark):
    rows = [(i, [float(i % 7), float(i % 3), 1.0]) for i in range(300)]
    unit = F.transform("v", lambda x: x / F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, y: a + y * y)))
    return spark.createDataFrame(rows, "item_id long, v array<double>").select("item_id", unit.alias("vector"))


def test_neighbours_of_classes_and_of_stripes(spark):
    items = _repeated(spark)
    queries = items.where("item_id % 10 = 0").withColumnRenamed("item_id", "query_id")
    held = {r["item_id"]: r["vector"] for r in items.collect()}
    cos = lambda a, b: round((1 + sum(x * y for x, y in zip(a, b, strict=True))) / 2, 9)
    for k in (1, 10, 40):
        want = {q: sorted(held, key=lambda i: (-cos(held[q], held[i]), i))[:k] for q in range(0, 300, 10)}
        for own in (items, knn.alike(items, k)):
            got = {}
            for r in sorted(knn.nearest(queries, own, k, query_block=17, item_block=50).collect(), key=lambda r: r["rank"]):
                got.setdefault(r["query_id"], []).append(r["item_id"])
            assert got == want


def test_dialogues_that_share_searches_equal_lone_ones(spark):
    texts = [(i, f"Title {i % 9}", f"thing {['red', 'blue', 'green'][i % 3]} made of {['iron', 'wood'][i % 2]} size {i % 4}") for i in range(90)]
    items = with_embedding(spark.createDataFrame(texts, "item_id long, title string, text string"), "text", "vector").cache()
    index = bm25.build_index(items.selectExpr("item_id AS doc_id", "text"))
    tasks = spark.range(60).selectExpr("concat('d', id) AS dialogue_id", "id AS user_id", "id * 7 % 90 AS target_id")
    rules = dialogue.Rules(max_questions=2, max_shown=4, max_rounds=5)
    shared = dialogue.simulate(tasks, items, index, rules=rules).collect()
    lone = dialogue.simulate(tasks.withColumn("excluded_ids", F.array(-F.col("user_id") - 1)), items, index, rules=rules).collect()
    assert len(shared) == 60 and sorted(map(tuple, shared)) == sorted(map(tuple, lone))


def test_dialogues_search_once_in_any_order_of_refusals(spark, monkeypatch):
    texts = [(i, f"Title {i}", f"thing {['red', 'blue', 'green'][i % 3]} size {i % 4}", ["red", "blue", "green"][i % 3]) for i in range(90)]
    items = with_embedding(spark.createDataFrame(texts, "item_id long, title string, text string, colour string"), "text", "vector").cache()
    index = bm25.build_index(items.selectExpr("item_id AS doc_id", "text"))
    rounds, neighbours = [], dialogue.hybrid.neighbours
    monkeypatch.setattr(dialogue.hybrid, "neighbours", lambda q, *rest: rounds.append([" ".join(sorted(r["text"].split())) for r in q.collect()]) or neighbours(q, *rest))
    tasks = spark.range(120).selectExpr("concat('d', id) AS dialogue_id", "id AS user_id", "id * 7 % 90 AS target_id")
    rules = dialogue.Rules(mode="static", max_shown=4, attributes={"colour": "colour"})
    got = dialogue.simulate(tasks, items, index, rules=rules).collect()
    assert len(got) == 120 and len(rounds) == 4
    assert all(len(texts) == len(set(texts)) for texts in rounds) and len(rounds[0]) == 3


def test_tasks_of_repeated_lines(spark):
    lines = spark.range(4000).selectExpr("id % 20 AS user_id", "id % 20 * 7 + id DIV 20 % 5 AS item_id")
    items = spark.range(100).withColumnRenamed("id", "item_id")
    drawn = lambda u: sorted((i for i in range(u * 7, u * 7 + 5) if i < 100), key=lambda i: hashlib.md5(f"5:{u}:{i}".encode()).hexdigest())[:2]
    want = [(u, i) for u in range(20) for i in drawn(u)]
    got = dialogue.tasks(lines, items, 2, 5).collect()
    assert sorted((r["user_id"], r["target_id"]) for r in got) == sorted(want)


def test_neighbours_keep_ties_over_stripes(spark, monkeypatch):
    monkeypatch.setattr(knn, "STRIPES", (4, 16))
    items = _repeated(spark)
    queries = items.where("item_id % 10 = 0").withColumnRenamed("item_id", "query_id")
    held = {r["item_id"]: r["vector"] for r in items.collect()}
    cos = lambda a, b: round((1 + sum(x * y for x, y in zip(a, b, strict=True))) / 2, 9)
    odd = lambda q, i: (q["query_id"].to_numpy()[:, None] + i["item_id"].to_numpy()) % 3 > 0
    got = {}
    for r in sorted(knn.nearest(queries, items, 7, odd).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append(r["item_id"])
    assert got == {q: sorted((i for i in held if (q + i) % 3), key=lambda i: (-cos(held[q], held[i]), i))[:7] for q in range(0, 300, 10)}


def test_many_commits_share_jobs(spark, tmp_path):
    path, jobs = f"file://{tmp_path}/cache", []
    rows = spark.range(1000).selectExpr("id * 3 AS k", "concat('v', id) AS v")

    def make(part):
        jobs.append(1)
        return part.select("k", F.md5("v").alias("d"))

    assert commits.fill(rows, path, ["k"], make, 10, jobs=8) == 100 and len(jobs) == 8
    held = commits.read_commits(spark, path)
    assert held.columns == ["k", "d", "commit"]
    got = sorted((int(r["commit"][:12]), r["k"], r["d"]) for r in held.collect())
    assert got == [(i // 10, i * 3, hashlib.md5(f"v{i}".encode()).hexdigest()) for i in range(1000)]
    assert commits.fill(rows, path, ["k"], make, 10) == 0 and len(jobs) == 8
    assert commits.fill(spark.range(1000, 1015).selectExpr("id * 3 AS k", "'x' AS v"), path, ["k"], make, 10) == 2
    assert commits.read_commits(spark, path).where("k >= 3000").count() == 15


def test_texts_of_a_large_shard(spark, tmp_path):
    """A shard of 64 MB isn't copied for each of its conversations."""
    path = f"file://{tmp_path}/texts"
    lines = spark.range(4000).selectExpr("id AS conv_id", "1 AS turn", "'user' AS role", "concat(id, repeat('é', 6000)) AS text")
    writers.write_conversation_texts(lines.repartition(4), path)
    begin = time.monotonic()
    held = readers.read_conversation_texts(spark, path).selectExpr("conv_id", "text = concat('User: ', conv_id, repeat('é', 6000), char(10)) AS same").collect()
    assert sorted(r["conv_id"] for r in held) == list(range(4000)) and all(r["same"] for r in held)
    assert time.monotonic() - begin < 30
    assert [r["text"] for r in readers.read_conversation_texts(spark, path, spark.range(7, 8).toDF("conv_id")).collect()] == [f"User: 7{'é' * 6000}\n"]


def test_stems_leave_tokens_in_arrow():
    rows = [["running", "runs", "running"], [], None, ["ponies", "cats"]]
    got = text._stems.func(pa.array([["left", "out"], *rows], pa.list_(pa.string()))[1:])
    assert got.to_pylist() == [r if r is None else [stem(t) for t in r] for r in rows]


def test_equal_lookups_share_a_search(spark, monkeypatch):
    index = bm25.build_index(spark.createDataFrame([(1, "red ring"), (2, "red ring"), (3, "blue bolt")], "doc_id long, text string"))
    searched, scores = [], edits.title_scores
    monkeypatch.setattr(edits, "title_scores", lambda i, asked: searched.extend(r["text"] for r in asked.collect()) or scores(i, asked))
    lookups = [(q, ["erd ring", "lbue bolt", None][q % 3]) for q in range(30)]
    got = edits.best_title(index, spark.createDataFrame(lookups, "query_id long, text string")).collect()
    assert sorted(searched, key=str) == [None, "erd ring", "lbue bolt"]
    assert sorted((r["query_id"], r["item_id"]) for r in got) == [(q, [1, 3][q % 3]) for q in range(30) if q % 3 < 2]
