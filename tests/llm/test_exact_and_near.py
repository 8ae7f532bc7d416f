"""Exact, near and embedding duplicates against brute force, and their odd cases."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnlake.llm import components, embedding_dedup, exact_dedup, minhash
from cairnlake.llm.queries import ORACLE_SQL, QUERIES
from tests.conftest import same

DOCS = "doc_id long, text string, digest int, size string"


def groups(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_exact_query_equals_sql(spark, sf, duck):
    same(QUERIES["op1_exact_dedup"](spark, sf), duck, ORACLE_SQL["op1_exact_dedup"])


def test_exact_odd_cases(spark):
    rows = [(1, "a b", 1, "x"), (1, "a b", 1, "x"), (2, "ab  ", 3, None), (None, None, 0, "y"), (None, "", 0, "z"), (3, "x", 2, ""), (3, "y", 2, "")]
    docs = spark.createDataFrame(rows, DOCS)
    found = exact_dedup.exact_duplicates(docs, counters=2).collect()
    assert len(found) == 7
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in found if r["doc_id"]) == [(1, 2, 3, False), (1, 2, 3, False), (2, 2, 3, True), (3, 3, 1, True), (3, 3, 1, True)]
    assert sum(r["kept"] for r in found if r["doc_id"] is None) == 1
    kept = exact_dedup.drop_exact_duplicates(docs, counters=2)
    assert kept.columns == docs.columns
    assert sorted((r["text"] or "") for r in kept.collect()) == ["", "ab  ", "x", "y"]
    assert exact_dedup.exact_duplicates(docs.limit(0)).count() == 0


def test_frequent_values_are_found_in_any_partitioning(spark):
    rng = random.Random(1)
    values = [b"hot"] * 400 + [bytes([rng.randrange(256), rng.randrange(256)]) for _ in range(600)]
    rng.shuffle(values)
    for parts in (1, 3, 7):
        frame = spark.createDataFrame([(v,) for v in values], "digest binary").repartition(parts)
        found = [bytes(r["digest"]) for r in exact_dedup.frequent_candidates(frame, "digest", 5).collect()]
        assert b"hot" in found and len(found) <= 5


def shingles(text, width):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else ({tuple(words)} if words else set())


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, width, percent):
    rng = random.Random(width)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 4)))
    texts = []
    for _ in range(12):
        base = [word() for _ in range(rng.choice([4, 30, 80, 200]))]
        for _ in range(rng.choice([1, 3, 12])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 12))):
                copy[rng.randrange(len(copy))] = word()
            texts.append(rng.choice([" ", "\t", " \n"]).join(copy))
    texts += [None, "", "  \n", "A", "a", "a b", "A  B", texts[0].upper(), texts[0]]
    docs = spark.createDataFrame([(i, t, 0, "") for i, t in enumerate(texts)], DOCS)
    sets = [shingles(t, width) for t in texts]
    linked = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    want = groups(linked, range(len(texts)))
    got = {r["doc_id"]: r for r in minhash.near_duplicates(docs, width, percent).collect()}
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (len(sets[i]), want[i], want[i] == i) for i in range(len(texts))}


def test_near_duplicates_odd_cases(spark):
    empty = spark.createDataFrame([], DOCS)
    assert minhash.near_duplicates(empty).count() == 0
    rows = [(None, "one two three four five six", 0, ""), (7, "one two three four five six", 0, ""), (None, "lone words", 0, ""), (7, "one two three four five six", 0, "")]
    found = minhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in found) == [("7", "7", True), ("7", "7", True), ("None", "7", False), ("None", "None", True)]
    kept = minhash.drop_near_duplicates(spark.createDataFrame(rows, DOCS))
    assert kept.columns == ["doc_id", "text", "digest", "size"]


def test_a_crowded_region_is_met_whole(spark):
    """More near copies than a block holds: all within one edit of the base, so one component."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(700):
        copy = list(base)
        copy[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(copy), 0, ""))
    found = minhash.near_duplicates(spark.createDataFrame(rows, DOCS), 3, 85)
    assert found.where("component_id = 0").count() == 700


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(50)] + [(5, 5), (None, 3)]
    for hub in (3, 1_000):
        found = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long"), hub).collect()}
        assert found == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(50)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("least", [0, 5, 1_000])
def test_hot_keys_meet_as_in_a_join(spark, least):
    rows = [(k, i) for k in range(8) for i in range(k)] + [(9, i) for i in range(300)] + [(None, 1)]
    frame = spark.createDataFrame(rows, "k int, i int")
    keyed = frame.where("k IS NULL OR k <> 4").groupBy("k").agg(F.max("i").alias("m"), F.count("*").alias("n"))
    found = components.met_by_key(frame, keyed, "k", len(rows), least, 50)
    want = sorted((k, i, 299 if k == 9 else k - 1) for k, i in rows if k is not None and k != 4)
    assert found.columns == ["k", "i", "m"] and sorted(map(tuple, found.collect())) == want
    assert components.met_by_key(frame.limit(0), keyed.limit(0), "k", 0, least).count() == 0


@pytest.mark.parametrize("size", [3, 64])
def test_embedding_links_equal_brute_force(spark, size):
    rng = random.Random(size)
    rows = []
    for _ in range(30):
        centre = [rng.gauss(0, 1) for _ in range(size)]
        for _ in range(rng.choice([1, 2, 15])):
            rows.append([c + rng.gauss(0, 0.12) for c in centre])
    rows += [rows[0], [2 * x for x in rows[1]]]
    vectors = list(enumerate(rows)) + [(900, None), (901, [0.0] * size), (902, [math.nan] * size), (903, [None] * size), (904, []), (905, [1e200] * size), (906, [math.inf] * size), (907, [1.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_vectors(spark.createDataFrame(vectors, "vec_id long, embedding array<double>")).collect()}
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
    unit = [[x / max(map(abs, v)) for x in v] for v in [*rows, [1e200] * size]]
    ids = [*range(len(rows)), 905]
    links = [(ids[i], ids[j]) for i in range(len(unit)) for j in range(i) if cosine(unit[i], unit[j]) >= 0.95]
    want = groups(links, [*ids, 900, 901, 902, 903, 904, 906, 907])
    degree = {i: sum(i in p for p in links) for i in want}
    exact = sum(got[i] == (degree[i], want[i], want[i] == i) for i in want)
    assert exact == len(want)


def test_embedding_odd_cases(spark):
    schema = "vec_id long, embedding array<float>, id string"
    assert embedding_dedup.near_vectors(spark.createDataFrame([], schema)).count() == 0
    found = embedding_dedup.near_vectors(spark.createDataFrame([(None, [1.0, 0.0], ""), (4, [1.0, 0.0], ""), (None, [0.0, 1.0], ""), (5, None, "")], schema)).collect()
    assert sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in found) == [("4", 1, "4", True), ("5", 0, "5", True), ("None", 0, "None", True), ("None", 1, "4", False)]


def test_a_large_bucket_is_split_and_counted_once(spark):
    rng = random.Random(2)
    centre = [rng.gauss(0, 1) for _ in range(16)]
    rows = [(i, [c + rng.gauss(0, 0.02) for c in centre]) for i in range(1500)]
    found = embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).agg(F.min("n_links").alias("a"), F.max("n_links").alias("b"), F.max("component_id").alias("c")).first()
    assert (found["a"], found["b"], found["c"]) == (1499, 1499, 0)


@pytest.mark.parametrize(("count", "size"), [(1500, 1), (20, 3500)])
def test_families_of_a_hot_template_are_met(spark, count, size):
    """Pairs just over the threshold with distant ids among rows just under it, more than a block holds, or very long."""
    rng = random.Random(count)
    texts = []
    for f in range(count):
        slots = rng.sample(range(1, 99), 10)
        base = [f"t{i}" + "x" * size for i in range(300)]
        for k in slots[:2]:
            base[3 * k] = f"f{f}w{k}"
        for member in (slots[2:6], slots[6:]):
            texts.append(" ".join(f"m{f}w{k}" if (k := i // 3) in member and i % 3 == 0 else w for i, w in enumerate(base)))
    rng.shuffle(texts)
    sets = [shingles(t, 3) for t in texts]
    place = {}
    for x in sets:
        for s in x:
            place.setdefault(s, len(place))
    seen = np.zeros((len(sets), len(place)), bool)
    for i, x in enumerate(sets):
        seen[i, [place[s] for s in x]] = True
    often = seen[:, seen.sum(axis=0) > 1].astype(np.float32)
    both, n = often @ often.T, np.array([len(x) for x in sets])
    want = groups(np.argwhere(np.tril(100 * both >= 85 * (n[:, None] + n[None, :] - both), -1)).tolist(), range(len(sets)))
    docs = spark.createDataFrame([(i, t, 0, "") for i, t in enumerate(texts)], DOCS).repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs, 3, 85).collect()}
    assert sum(got[i] != want[i] for i in want) == 0


@pytest.mark.parametrize(("size", "vertices"), [(64, 1), (64, 2), (64, 3), (64, 5), (64, 7), (16, 4), (16, 7)])
def test_recall_of_pairs_at_the_threshold(size, vertices):
    rng = np.random.default_rng(3)
    x, z = (rng.normal(size=(400, size)) for _ in range(2))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    y = 0.95 * x + math.sqrt(1 - 0.95**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    met = np.zeros(len(x), bool)
    for t in range(embedding_dedup.tables_for(vertices, size)):
        a, b = (embedding_dedup.codes(v, vertices, t) for v in (x, y))
        met |= (b == a[:, :1]).any(axis=1) | (a == b[:, :1]).any(axis=1)
    assert met.mean() >= 0.99


def test_columns_that_clash_and_long_texts(spark):
    rows = [(1, "a b c d e f g", "k", "g"), (2, "a b c d e f g ", "k", "g"), (3, "w " * 200_000, "k", "g"), (4, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __key string, __gone string")
    assert sorted(r["doc_id"] for r in exact_dedup.drop_exact_duplicates(docs).collect()) == [2, 3, 4]
    near = minhash.drop_near_duplicates(docs)
    assert near.columns == docs.columns and sorted(r["doc_id"] for r in near.collect()) == [1, 3, 4]


def test_probes_are_the_best_of_all_choices():
    """The beam over vertices gives the names that all choices of three a vertex would give, least loss first."""
    import itertools

    rng = np.random.default_rng(8)
    for size, vertices in ((1, 1), (2, 2), (5, 3), (64, 4)):
        unit = rng.normal(size=(20, size))
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        full = max(2, 1 << (size - 1).bit_length())
        near, losses = [], []
        for k in range(vertices):
            y = np.zeros((20, full))
            y[:, :size] = unit
            for s in embedding_dedup._signs(full, 3, k):
                y = embedding_dedup._hadamard(y * s)
            both = np.concatenate([y, -y], axis=1)
            order = np.argsort(-both, axis=1, kind="stable")[:, :3]
            near.append(order)
            losses.append((both.max(axis=1, keepdims=True) - np.take_along_axis(both, order, axis=1)) ** 2)
        got = embedding_dedup.codes(unit, vertices, 3)
        for r in range(20):
            every = sorted((sum(losses[k][r, c] for k, c in enumerate(choice)), choice) for choice in itertools.product(range(3), repeat=vertices))
            names = []
            for _, choice in every[: got.shape[1]]:
                code = 0
                for k, c in enumerate(choice):
                    code = code * 2 * full + int(near[k][r, c])
                names.append(code)
            assert got.shape[1] == min(11, 3**vertices) and got[r, 0] == names[0]
            if size > 2:
                assert sorted(names) == sorted(got[r].tolist())


def test_few_dimensions_and_mixed_lengths(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=d).tolist()) for i, d in enumerate([1] * 40 + [2] * 60 + [3] * 60 + [4] * 60)]
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    linked = met = 0
    for i, x in rows:
        want = sum(1 for j, y in rows if i != j and len(x) == len(y) and np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y) >= 0.95)
        assert got[i] <= want
        linked, met = linked + want, met + got[i]
    assert met >= 0.99 * linked
    for d in (1, 2, 4):
        assert embedding_dedup.codes(np.ones((1000, d)), embedding_dedup.vertices_for(10**9, d), 0).shape[1] <= 11


def test_only_links_across_groups_run_rounds_of_components(spark, monkeypatch):
    ran = []
    monkeypatch.setattr(minhash, "components", lambda edges: (ran.append(sorted(map(tuple, edges.collect()))), components.components(edges))[1])
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 3), (5, 5), (6, 6)], "id long, grp long")
    links = lambda *pairs: spark.createDataFrame(list(pairs), "a long, b long")
    assert sorted(minhash.regrouped(labels, links((1, 2), (3, 4))).collect()) == sorted(labels.collect()) and not ran
    found = dict(minhash.regrouped(labels, links((4, 2), (1, 3), (5, 4), (6, 6))).collect())
    assert found == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 6} and ran == [[(1, 3), (3, 5)]]
