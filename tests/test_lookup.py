"""Bounded top-k search, quantised lengths and words within edits against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from cairnlake.operators import bm25, edits


def long_to_byte(n):
    """One byte for a length and back: exact below 24, then four leading bits of the rest."""
    if n < 24:
        return n
    rest, shift = n - 24, max(0, (n - 24).bit_length() - 4)
    return 24 + (rest >> shift << shift)


def test_quantised_lengths(spark):
    rows = [(n,) for n in [*range(300), 999, 4096, 123_456, 2_000_000_000]]
    got = spark.createDataFrame(rows, "dl long").select("dl", bm25.quantised_length(F.col("dl")).alias("q")).collect()
    assert all(r["q"] == long_to_byte(r["dl"]) for r in got)


@pytest.mark.parametrize("scorer", [bm25.PLAIN, bm25.QUANTISED])
def test_bounded_search_equals_the_whole_one(spark, scorer):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(200)]
    weights = [1 / (i + 1) for i in range(200)]
    text = lambda n: " ".join(rng.choices(vocabulary, weights, k=n))
    docs = [(i, text(rng.randrange(0, 60)) if i % 17 else None) for i in range(400)] + [(i, "w0 w1 w2 rare") for i in range(400, 420)]
    queries = [(q, text(rng.randrange(1, 25))) for q in range(30)] + [(30, "w0"), (31, "absent"), (32, ""), (33, None), (34, "rare rare w0"), (35, "w199 absent")]
    index = bm25.build_index(spark.createDataFrame(docs, "doc_id long, text string"))
    asked = spark.createDataFrame(queries, "query_id long, text string")
    for k in (1, 5, 50):
        want = bm25.best(bm25.scores(index, asked, scorer=scorer), k).collect()
        got = bm25.best(bm25.top_k(index, asked, k, scorer), k).collect()
        key = lambda rows: sorted((r["query_id"], r["rank"], r["item_id"], round(r["bm25_raw"], 8)) for r in rows)
        assert key(got) == key(want)


def test_index_is_opened_once(spark, tmp_path):
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame([(1, "a b"), (2, "b")], "doc_id long, text string").write.parquet(path)
    read = lambda: spark.read.parquet(path)
    first = bm25.opened_index(read(), path)
    assert bm25.opened_index(read(), path) is first
    spark.createDataFrame([(3, "c")], "doc_id long, text string").write.mode("append").parquet(path)
    assert bm25.opened_index(read(), path).corpus.first()["n"] == 3


def osa(a, b):
    d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_near_words_equal_all_pairs(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randrange(1, 9)))
    asked, terms = sorted({word() for _ in range(150)}), sorted({word() for _ in range(300)} | {"語言", "語", "ab"})
    frame = lambda values, name: spark.createDataFrame([(v,) for v in values], f"{name} string")
    got = {(r["word"], r["term"]): r["edits"] for r in edits.near_words(frame(asked, "word"), frame(terms, "term")).collect()}
    allowed = lambda w: 0 if len(w) < 3 else 1 if len(w) < 6 else 2
    assert got == {(a, t): osa(a, t) for a in asked for t in terms if osa(a, t) <= allowed(a)}


def test_titles(spark):
    docs = [(1, "The Silent River"), (2, "Silent Night"), (3, None), (4, ""), (5, "River Song"), (6, "River Song")]
    index = bm25.build_index(spark.createDataFrame(docs, "doc_id long, text string"))
    asked = spark.createDataFrame([(1, "silnet nihgt"), (2, "rivers sogn"), (3, "zzz"), (4, None), (5, "silent silent")], "query_id long, text string")
    assert {r["query_id"]: r["item_id"] for r in edits.best_title(index, asked).collect()} == {1: 2, 2: 5, 5: 2}


def plain_words(text):
    """Word boundaries one character at a time."""
    import unicodedata

    def kind(c):
        if c in "'.‘’․﹒＇．":
            return "both"
        if c in ":··՟״‧︓﹕：":
            return "letter mark"
        if c in ",;;։،؍٬߸⁄︐︔﹐﹔，；":
            return "number mark"
        if c in "☃©":
            return "alone"
        category = unicodedata.category(c)
        if category in ("Mn", "Mc", "Me", "Cf"):
            return "extend"
        if category == "Pc" or c == "\u202f":
            return "joint"
        if category == "Nd":
            return "digit"
        if "\u30a0" <= c <= "\u30ff" and c != "\u30fb":
            return "kana"
        if "\u3040" <= c <= "\u309f" or "\u4e00" <= c <= "\u9fff":
            return "alone"
        return "letter" if category[0] == "L" or category == "Nl" else "other"

    units = []  # (kind, characters with what extends them)
    for c in text:
        if kind(c) == "extend" and units:
            units[-1] = (units[-1][0], units[-1][1] + c)
        else:
            units.append((kind(c) if kind(c) != "extend" else "other", c))
    out, held = [], []

    def close():
        if any(k in ("letter", "digit", "kana") for k, _ in held):
            word = "".join(u for _, u in held)
            out.extend(word[i : i + 255].lower() for i in range(0, len(word), 255))
        held.clear()

    for i, (k, u) in enumerate(units):
        last = held[-1][0] if held else None
        after = units[i + 1][0] if i + 1 < len(units) else None
        if k == "alone":
            close()
            out.append(u.lower())
        elif k in ("letter", "digit"):
            if last == "kana":
                close()
            held.append((k, u))
        elif k == "kana":
            if last not in (None, "kana", "joint"):
                close()
            held.append((k, u))
        elif k == "joint":
            held.append((k, u))
        elif last == after == "letter" and k in ("both", "letter mark") or last == after == "digit" and k in ("both", "number mark"):
            held.append((last, u))
        else:
            close()
    close()
    return out


def test_standard_words_equal_a_plain_scan(spark):
    from cairnlake.functions import text as T

    rng = random.Random(3)
    signs = "aZé_'.:,;7٣ ・カー東ひ☃\u0301\u200d-’"
    rows = ["".join(rng.choice(signs) for _ in range(rng.randrange(1, 25))) for _ in range(1500)]
    rows += ["x" * 700, "ab." * 4000 + "c", "a" * 200_000, "1,2" * 3000, "_" * 5000, ""]
    got = spark.createDataFrame(list(enumerate(rows)), "i long, t string").select("i", T.standard_tokens(F.col("t")).alias("w")).collect()
    for r in got:
        assert r["w"] == plain_words(rows[r["i"]]), repr(rows[r["i"]])[:80]


def test_single_precision_sums_keep_their_order(spark):
    import numpy as np

    from cairnlake.functions import vectors as V

    f32 = np.float32
    fused = lambda x, a: f32(np.float64(x) * np.float64(x) + np.float64(a))

    def in_lanes(v, lanes=8):
        n, i, out = len(v), 0, f32(0)
        if n > 2 * lanes:
            limit, acc = n - n % lanes, np.zeros((4, lanes), f32)
            while i < limit - 3 * lanes:
                for r in range(4):
                    for k in range(lanes):
                        acc[r, k] = fused(v[i + r * lanes + k], acc[r, k])
                i += 4 * lanes
            while i < limit:
                for k in range(lanes):
                    acc[0, k] = fused(v[i + k], acc[0, k])
                i += lanes
            for k in range(lanes):
                out = f32(out + f32(f32(acc[0, k] + acc[1, k]) + f32(acc[2, k] + acc[3, k])))
        for x in v[i:]:
            out = fused(x, out)
        return out

    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=n).astype(f32).tolist()) for i, n in enumerate([0, 1, 8, 16, 17, 24, 31, 40, 41, 64, 65, 100, 128, 130])]
    got = spark.createDataFrame(rows, "i long, v array<float>").select("i", V.single_square(F.col("v")).alias("a"), V.lane_square(F.col("v")).alias("b")).collect()
    for r in got:
        v = np.array(rows[r["i"]][1], f32)
        total = f32(0)
        for x in v:
            total = f32(total + f32(x * x))
        assert f32(r["a"]) == total and f32(r["b"]) == in_lanes(v), r["i"]


def test_fuzzy_titles_equal_all_pairs(spark):
    from cairnlake.operators import fuzzy

    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("ab c") for _ in range(n))
    titles = [(i, word(rng.randrange(0, 14))) for i in range(250)]
    lookups = [(i, word(rng.randrange(0, 14))) for i in range(60)] + [(100 + i, t[:2] + t[3:] + rng.choice("ab")) for i, t in titles[:60]]

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    clean = lambda t: t.strip()
    for cutoff in (80.0, 60.0):
        want = {}
        for q, a in lookups:
            best = [(-200 * lcs(clean(a), clean(b)) / (len(clean(a)) + len(clean(b))), i) for i, b in titles if clean(a) and clean(b)]
            best = [x for x in best if -x[0] >= cutoff]
            if best:
                want[q] = min(best)[1]
        got = fuzzy.best_titles(spark.createDataFrame(lookups, "lookup_id long, title string"), spark.createDataFrame(titles, "item_id long, title string"), cutoff)
        assert {r["lookup_id"]: r["item_id"] for r in got.collect()} == want
