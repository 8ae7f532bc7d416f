"""Small cases of the text, vector and retrieval functions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cairnlake.functions import text as T
from cairnlake.functions import vectors as V
from cairnlake.operators import bm25, filters, fuzzy
from cairnlake.operators.diversity import mtld
from cairnlake.operators.knn import nearest


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, (str, type(None))) else 'array<string>' if isinstance(v, list) else 'double'}" for k, v in values.items())) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def test_search_tokens(spark):
    assert one(spark, T.search_tokens(F.col("t")), t="foo_bar 3.14 日本語 café AND \"x*\"") == ["foo", "bar", "3", "14", "日本語", "café", "and", "x"]
    assert one(spark, T.search_tokens(F.col("t")), t=None) == []


def test_trigrams_and_ascii(spark):
    assert one(spark, T.trigram_tokens(F.col("t")), t="日本語版") == ["日本語", "本語版"]
    assert one(spark, T.trigram_tokens(F.col("t")), t="ab") == []
    assert one(spark, T.ascii_tokens(F.col("t")), t="Ab-c É") == ["ab", "c", "É"]


def test_metric_tokens_need_free_words(spark):
    assert one(spark, T.metric_tokens(F.col("t")), t="Don't café tion_x ok") == ["don", "t", "ok"]


def test_category_words(spark):
    assert one(spark, T.category_tokens(F.col("t")), t="Bon appétit, sci_fi rock'n") == ["bon", "appétit", "sci_fi", "rock", "n"]


@pytest.mark.parametrize(("wanted", "hit"), [(["science", "fiction"], True), (["fiction", "science"], False), ([], False), (["a", "b", "c", "d"], False)])
def test_contains_sequence(spark, wanted, hit):
    row = spark.createDataFrame([(["x", "science", "fiction"], wanted)], "t array<string>, w array<string>")
    assert row.select(T.contains_sequence(F.col("t"), F.col("w")).alias("x")).first()["x"] is hit


def test_message_rules(spark):
    assert one(spark, T.cut_message(F.col("t"), 20), t="One. Two three four five six") == "One."
    assert one(spark, T.cut_message(F.col("t"), 10), t="abc def ghi jkl") == "abc def…"
    assert one(spark, T.complete_sentences(F.col("t")), t="Yes. And then...") == "Yes."
    assert one(spark, T.visible_reply(F.col("t")), t="<think>a</think> Hi") == "Hi"
    assert one(spark, T.visible_reply(F.col("t")), t="<think>a") is None
    assert one(spark, T.visible_reply(F.col("t")), t="a</think> Hi") == "Hi"


def test_lists_and_scores_from_replies(spark):
    assert one(spark, T.attribute_list(F.col("t")), t='```json\n["a", "b"]\n```') == ["a", "b"]
    assert one(spark, T.attribute_list(F.col("t")), t="['a', 'b']") == ["a", "b"]
    assert one(spark, T.attribute_list(F.col("t")), t="- a\n• b; c") == ["a", "b", "c"]
    assert one(spark, T.attribute_list(F.col("t")), t="""["it's", 'b "x"', 'c\\'d', ]""") == ["it's", 'b "x"', "c'd"]
    assert one(spark, T.attribute_list(F.col("t")), t="[]") == []
    assert one(spark, T.quality_band(F.col("t").cast("double")), t=None) is None
    assert one(spark, T.clean_line(F.col("t"), F.lit("user"), show_note=True), t="Hi (Note: x)") == "Hi (Note: x)"
    assert one(spark, T.clean_line(F.col("t"), F.lit("bot"), show_tag=True), t="[chit-chat] Hi") == "[chit-chat] Hi"
    assert one(spark, T.distinct_by_name(F.col("t")), t=["Brand", "brand", "price_range", "Price Range"]) == ["Brand", "price_range"]
    assert one(spark, T.json_scores(F.col("t"), {"score": "double", "why": "string"}), t='ok {"Score": 4.5, "WHY": "x"}').asDict() == {"score": 4.5, "why": "x"}


def test_lines_of_replaced_calls(spark):
    text = "Bot: <FALLBACK>\n  System: <FALLBACK> fallbacks=3 sites=a:3\nSystem: <FALLBACK>\nUser: no"
    assert one(spark, T.fallback_count(F.col("t")), t=text) == 4
    assert one(spark, T.without_fallback(F.col("t")), t=text) == "Bot: <FALLBACK>\nUser: no"
    assert one(spark, T.without_fallback(F.col("t")), t="a\nSystem: <FALLBACK> fallbacks=1") == "a\n"
    assert one(spark, T.fallback_count(F.col("t")), t=None) == 0


@pytest.mark.parametrize(("text", "shown"), [("a sk-abcdef12\nBearer x.y-z", "a sk-*** Bearer ***"), ("api_key=abc token: q;w, Authorization = z", "api_key=*** token: ***;w, Authorization = ***"), ("mail a@b.c sk-abc", "mail a@b.c sk-abc"), (None, ""), ("x" * 400, "x" * 297 + "...")])
def test_masked(spark, text, shown):
    assert one(spark, T.masked(F.col("t")), t=text) == shown


@pytest.mark.parametrize(("text", "role", "clean"), [("[chit-chat] Hi (Note: x)", "bot", "Hi (Note: x)"), ("[chit-chat] Hi (Note: x) ", "user", "[chit-chat] Hi"), ("so [chit-chat] (Note: y)", "bot", "so [chit-chat] (Note: y)"), ("(Note: y)", "system", "(Note: y)")])
def test_clean_line(spark, text, role, clean):
    assert one(spark, T.clean_line(F.col("t"), F.col("r")), t=text, r=role) == clean


@pytest.mark.parametrize(("text", "whole"), [("Yes. No… ……", "Yes."), ("Yes. No... ...", "Yes."), ("Yes....", "Yes."), ("Yes. No... …", "Yes. No..."), ("... ...", ""), (None, ""), ("no end", ""), ("Ok! ", "Ok!")])
def test_complete_sentences(spark, text, whole):
    assert one(spark, T.complete_sentences(F.col("t")), t=text) == whole


def test_category_parts(spark):
    wearer, kind = T.category_parts(F.col("c"))
    rows = spark.createDataFrame([("ladies_t-shirts_tops",), ("sportswear",), ("divided__x",), (None,)], "c string").select(wearer, kind).collect()
    assert [tuple(r) for r in rows] == [("Women", "T-Shirts Tops"), ("Sportswear", ""), ("Divided", " X"), ("", "")]


def test_porter_equals_the_full_text_index(spark):
    """The stemmer against the porter tokenizer of the full-text index that Python's sqlite has."""
    import random
    import sqlite3

    from cairnlake.functions.porter import STEP2, STEP3, STEP4, stem

    con = sqlite3.connect(":memory:")
    try:
        con.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize='porter unicode61 remove_diacritics 0')")
    except sqlite3.OperationalError:
        pytest.skip("this sqlite has no full-text index")
    rng = random.Random(1)
    roots = ["hop", "hopp", "agre", "fly", "sky", "yes", "relat", "condit", "a", "tr", "bl", "fizz", "fall", "create", "oscillat", "rat", "naïv", "über", "x1", "toy"]
    ends = [*STEP2, *STEP3, *STEP4, "sses", "ies", "s", "ss", "eed", "ed", "ing", "y", "e", "ll", "lly", "er", ""]
    words = sorted({rng.choice(roots) + rng.choice(ends) + rng.choice(["", rng.choice(ends)]) for _ in range(4000)} | {"caresses", "ponies", "feed", "motoring", "happy", "controll", "ion", "adoption", "sses"})
    con.execute("INSERT INTO t VALUES (?)", (" ".join(words),))
    con.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, 'instance')")
    want = [r[0] for r in con.execute("SELECT term FROM v ORDER BY offset")]
    assert [w for w, x in zip(words, want, strict=True) if stem(w) != x] == []
    assert one(spark, T.porter_tokens(F.col("t")), t="Hopping ponies, the Relational!") == ["hop", "poni", "the", "relat"]


def test_catalogue_text(spark):
    assert one(spark, T.title_without_year(F.col("t")), t="Alien (1979) ") == "Alien"
    assert one(spark, T.field_text([F.col("a"), F.col("b"), F.col("a")]), a="x", b=None) == "x  x"
    assert one(spark, T.renamed_columns(F.col("t"), {"item_type": "kind", "item": "thing"}), t="Item_Type of item, items") == "kind of thing, items"


def test_vectors(spark):
    row = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, z array<double>")
    assert row.select(V.unit(F.col("a")).alias("x")).first()["x"] == [0.6, 0.8]
    assert row.select(V.unit(F.col("z")).alias("x")).first()["x"] is None
    assert row.select(V.cosine(F.col("a"), F.col("z")).alias("x")).first()["x"] == 0.0
    assert row.select(V.blend(F.col("a"), F.col("z"), 0.5).alias("x")).first()["x"] == [1.5, 2.0]
    with pytest.raises(ValueError, match="zero"):
        V.checked_size(row, "z")


def movies(spark):
    rows = [("tt1", "Science Fiction", 1990), ("", "Fiction, Science Fiction", 1995), ("tt3", "Fiction Science", None), ("tt4", "Drama", 2001)]
    return spark.createDataFrame(rows, "item_id string, category string, year int")


def ids(df):
    return sorted(r["item_id"] for r in df.collect())


def test_filters(spark):
    items, strings = movies(spark), lambda *v: F.array(*map(F.lit, v))
    assert ids(items.where(filters.admitted(items, excluded=strings("")))) == ["tt1", "tt3", "tt4"]
    assert ids(items.where(filters.admitted(items, genres=strings("Science!")))) == ["tt4"]
    assert ids(items.where(filters.admitted(items, required=strings("Science Fiction")))) == ["", "tt1"]
    assert ids(items.where(filters.admitted(items, required=strings("?")))) == []
    assert ids(items.where(filters.admitted(items, low=F.lit(1990), high=F.lit(1995)))) == ["", "tt1"]
    assert ids(items.where(filters.admitted(items))) == ["", "tt1", "tt3", "tt4"]
    bare = items.drop("year")
    assert ids(bare.where(filters.admitted(bare, low=F.lit(1990)))) == []


def test_bm25_scale(spark):
    rows = [(1, 1, 1.0), (1, 2, 3.0), (1, 3, 2.0), (2, 1, 3.2), (3, 1, 2.0), (3, 2, 2.0)]
    found = bm25.scaled(spark.createDataFrame(rows, "query_id long, item_id long, bm25_raw double"))
    assert {(r["query_id"], r["item_id"]): r["bm25_norm"] for r in found.collect()} == {(1, 1): 0, (1, 2): 1, (1, 3): 0.5, (2, 1): 0, (3, 1): 0, (3, 2): 0}


def test_bm25_counts_repeats_and_floors_idf(spark):
    docs = spark.createDataFrame([(1, "crime and crime"), (2, "other"), (3, "crime")], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "crime"), (2, "crime crime")], "query_id long, text string")
    score = {(r["query_id"], r["item_id"]): r["bm25_raw"] for r in bm25.scores(bm25.build_index(docs), queries).collect()}
    assert score[2, 1] == pytest.approx(2 * score[1, 1])
    assert 0 < score[1, 3] < 1e-5


@pytest.mark.parametrize(("a", "b", "ratio"), [("Alpah", "Alpha", 80.0), ("", "", 100.0), ("abc", "abc", 100.0), ("abc", "xyz", 0.0)])
def test_indel_ratio(spark, a, b, ratio):
    row = spark.createDataFrame([(a, b)], "a string, b string")
    assert row.select(fuzzy.indel_ratio("a", "b").alias("x")).first()["x"] == ratio


def test_nearest_equals_brute_force_in_many_blocks(spark):
    rng = random.Random(3)
    items = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(60)]
    items = [(i, [x / math.sqrt(sum(y * y for y in v)) for x in v]) for i, v in items]
    frame = spark.createDataFrame(items, "item_id long, vector array<double>")
    found = nearest(frame.withColumnRenamed("item_id", "query_id"), frame, 5, query_block=7, item_block=11)
    got = {}
    for r in found.collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["item_id"]))
    for q, v in items:
        want = sorted(((-round((1 + sum(a * b for a, b in zip(v, w))) / 2, 9), i) for i, w in items))[:5]
        assert [i for _, i in sorted(got[q])] == [i for _, i in want]


def test_mtld_equals_a_loop(spark):
    rng = random.Random(5)
    texts = [[rng.choice("abcdefghijkl") for _ in range(n)] for n in (3, 10, 50, 200)]

    def one_way(tokens):
        f, n, types = 0.0, 0, set()
        for t in tokens:
            n += 1
            types.add(t)
            if len(types) / n <= 0.72:
                f, n, types = f + 1, 0, set()
        f += (1 - len(types) / n) / (1 - 0.72) if n else 0
        return len(tokens) / f if f > 0 else len(tokens)

    found = spark.createDataFrame(list(enumerate(texts)), "i int, t array<string>").select("i", mtld(F.col("t")).alias("m"))
    for r in found.collect():
        t = texts[r["i"]]
        assert r["m"] == pytest.approx(0 if len(t) < 10 else (one_way(t) + one_way(t[::-1])) / 2)
