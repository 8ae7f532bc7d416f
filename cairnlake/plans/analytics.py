"""Registered queries on dialogues, lexical diversity, scores, rates and samples, each with its DuckDB counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlake.functions import text as T
from cairnlake.operators import diversity as D
from cairnlake.operators import metrics as M
from cairnlake.operators import sampling as S
from cairnlake.operators.strategies import interleaved
from cairnlake.session import table


def lines(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def line_tokens(spark, sf_dir, *by: str) -> DataFrame:
    """Tokens of the lines of users and assistants, dealt by columns first if some are given."""
    own = lines(spark, sf_dir).where("role <> 'system'")
    return (own.repartition(*by) if by else own).select("conv_id", "turn", "role", T.metric_tokens(F.col("text")).alias("tokens"))


def doc_tokens(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", T.metric_tokens(F.col("text")).alias("tokens"))


def _r(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def _joined(spark, sf_dir) -> DataFrame:
    """One token array a conversation, lines by turn. Lines are dealt by conversation before they are tokenized, as text is smaller."""
    held = line_tokens(spark, sf_dir, "conv_id").groupBy("conv_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "tokens"))), lambda x: x["tokens"])).alias("tokens"))
    return held


def utterance_stats(spark, sf_dir):
    return _r(M.speaker_stats(lines(spark, sf_dir)), "mean_words", "per_dialogue")


def dialogue_stats(spark, sf_dir):
    return M.turns_per_dialogue(lines(spark, sf_dir)).agg(*M.described("turns"))


def distinct_1(spark, sf_dir):
    return _r(D.distinct_n(doc_tokens(spark, sf_dir), ["lang"], "tokens", 1), "ratio")


def distinct_2_within(spark, sf_dir):
    return _r(D.distinct_n(line_tokens(spark, sf_dir), ["role"], "tokens", 2), "ratio")


def distinct_2_stream(spark, sf_dir):
    grams = D.stream_bigrams(line_tokens(spark, sf_dir).withColumn("place", F.struct("turn", "role")), "conv_id", "place", "tokens")
    return grams.agg(F.sum("c").alias("total"), F.count("*").alias("different"), F.round(F.count("*") / F.sum("c"), 6).alias("ratio"))


def ttr_family(spark, sf_dir):
    return _r(D.type_token(doc_tokens(spark, sf_dir), ["lang"], "tokens"), "ttr", "root_ttr", "log_ttr", "maas")


def mtld(spark, sf_dir):
    return _joined(spark, sf_dir).select("conv_id", F.size("tokens").cast("long").alias("n_tokens"), F.round(D.mtld(F.col("tokens")), 6).alias("mtld"))


def hdd(spark, sf_dir):
    return _r(D.hdd(doc_tokens(spark, sf_dir), ["lang"], "tokens"), "hdd")


def mattr_msttr(spark, sf_dir):
    mattr, msttr = D.window_ttr(F.col("tokens"))
    return _joined(spark, sf_dir).select("conv_id", F.round(mattr, 6).alias("mattr"), F.round(msttr, 6).alias("msttr"))


def item_entropy(spark, sf_dir):
    """Entropy of ordered parts by return flag."""
    return _r(D.entropy(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_partkey"), "entropy")


def event_entropy(spark, sf_dir):
    """Entropy of event types, the ids read from lines as a transcript mentions them."""
    said = table(spark, sf_dir, "events").select("user_id", F.concat(F.lit("You may like it ("), F.col("event_type"), F.lit(") or (k"), F.get_json_object("props", "$.k"), F.lit(")")).alias("line"))
    return _r(D.entropy(said.select("user_id", F.explode(D.mentioned_items(F.col("line"))).alias("item")), ["user_id"], "item"), "entropy")


def cosine_diversity(spark, sf_dir):
    return _r(D.cosine_diversity(table(spark, sf_dir, "embeddings"), ["label"], "embedding"), "diversity")


def scores(spark, sf_dir) -> DataFrame:
    """(doc_id, lang, score 1 to 5) of the labelled documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return table(spark, sf_dir, "labels").join(docs, "doc_id").withColumn("score", (1 + 2 * F.col("quality") + 2 * (1 - F.col("toxic"))).cast("double"))


def judge_describe(spark, sf_dir):
    return scores(spark, sf_dir).groupBy("lang").agg(*M.described("score"))


def judge_compare(spark, sf_dir):
    rows = scores(spark, sf_dir).withColumns({"side": F.when(F.col("lang") == "en", "english").otherwise("other"), "quality": F.col("quality").cast("double"), "clean": (1 - F.col("toxic")).cast("double")})
    return M.side_by_side(rows, "side", ["score", "quality", "clean"], ("english", "other"))


def quality_bands(spark, sf_dir):
    return scores(spark, sf_dir).groupBy(T.quality_band(F.col("score")).alias("band")).agg(F.count("*").alias("n"))


def corpus_gap(spark, sf_dir):
    """Words a line of users against assistants, and how they differ."""
    rows = lines(spark, sf_dir).where("role <> 'system'").withColumns({"words": F.size(T.words(F.col("text"))).cast("double"), "chars": F.char_length("text").cast("double")})
    return M.side_by_side(rows, "role", ["words", "chars"], ("user", "assistant"))


def _sides(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    turns = M.turns_per_dialogue(lines(spark, sf_dir))
    first = turns.select("conv_id", "turns", (F.col("conv_id") % 7 != 0).alias("completed"), (F.col("turns") % 2 == 0).alias("succeeded"))
    second = turns.where("conv_id % 10 <> 9").select("conv_id", (F.col("turns") + F.col("conv_id") % 3).alias("turns"), (F.col("conv_id") % 5 != 0).alias("completed"), (F.col("turns") % 3 != 0).alias("succeeded"))
    return first, second


def completion_sides(spark, sf_dir):
    first, second = _sides(spark, sf_dir)
    return _r(M.side_stats(first.withColumn("side", F.lit("first")).unionByName(second.withColumn("side", F.lit("second"))), ["side"]), "completion_rate", "mean_turns")


def completion_paired(spark, sf_dir):
    return _r(M.paired_difference(*_sides(spark, sf_dir), "conv_id"), "turn_diff", "rate", "se_points")


def embed_cache_plan(spark, sf_dir):
    texts = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("sha", F.sha2("text", 256))
    return M.embedding_plan(texts, texts.where("doc_id % 3 = 0"), ["doc_id", "sha"])


def rate_window_check(spark, sf_dir):
    seen = M.rate_windows(table(spark, sf_dir, "events"), "user_id", "ts", 6 * 3600)
    return seen.groupBy("user_id").agg(F.max("in_window").alias("most"), F.count_if(F.col("in_window") > 2).alias("violations"))


def run_counters(spark, sf_dir):
    calls = table(spark, sf_dir, "events").select(F.col("event_type").alias("site"), F.when(F.col("value") > 60, "timeout").alias("error_type"), (F.col("value") > 40).alias("used_fallback"))
    return M.each_or_all(calls, "site", M.run_counters)


def content_digest(spark, sf_dir):
    return M.content_digest(table(spark, sf_dir, "part"), ["p_partkey", "p_name", "p_brand", "p_type", "p_size"])


def guest_sample(spark, sf_dir):
    return S.without_replacement(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey", 50, 2025)


def user_item_sample(spark, sf_dir):
    """Three parts of every customer's own."""
    own = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_partkey").distinct()
    return S.per_group(own, "o_custkey", "l_partkey", 3, 2025)


def items_with_replacement(spark, sf_dir):
    return S.with_replacement(table(spark, sf_dir, "part"), "p_partkey", 500, 2025)


def matched_sample(spark, sf_dir):
    """Conversations drawn to the turn histogram of those with an odd id."""
    turns = M.turns_per_dialogue(lines(spark, sf_dir))
    return S.matched(turns.where("conv_id % 2 = 0"), turns.where("conv_id % 2 = 1"), "conv_id", "turns", 30, 7)


def stratified_sample(spark, sf_dir):
    return S.stratified(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "toxic", "doc_id", 60, 11)


def interleave(spark, sf_dir):
    """Three profiled customers, then one without profile, and so on, over all of them."""
    own = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 5 != 3).alias("profiled"))
    return interleaved(own, "profiled", "c_custkey", 2025)


def message_cut(spark, sf_dir):
    """Every line cut to 250 characters, and to its complete sentences."""
    return lines(spark, sf_dir).select("conv_id", "turn", "role", T.cut_message(F.col("text")).alias("cut"), F.md5(T.complete_sentences(F.concat("text", F.when(F.col("turn") % 3 == 0, "... ...").when(F.col("turn") % 3 == 1, " …… ").otherwise("")))).alias("sentences"))


def category_words(spark, sf_dir):
    """How often each Unicode word occurs in all documents."""
    own = table(spark, sf_dir, "documents").select(F.explode(T.category_tokens(F.col("text"))).alias("word"))
    return own.groupBy("word").agg(F.count("*").alias("n"))


def tokenizer_variants(spark, sf_dir):
    """Tokens of every document by each index tokenizer."""
    return table(spark, sf_dir, "documents").select("doc_id", *(F.size(T.TOKENIZERS[n](F.col("text"))).cast("long").alias(n) for n in ("unicode61", "ascii", "porter", "trigram")))


TOK = r"list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+'), lambda t: regexp_full_match(t, '[a-z]+'))"
DOCS = f"d AS (SELECT doc_id, lang, {TOK} AS t FROM documents)"
LINES = f"l AS (SELECT conv_id, turn, role, {TOK} AS t FROM conversations WHERE role <> 'system')"
JOINED = LINES + ", j AS (SELECT conv_id, flatten(list(t ORDER BY turn, role)) AS t FROM l GROUP BY conv_id)"
GRAMS = "list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])"
ONE_WAY = "list_reduce(list_prepend({{'f': 0.0::DOUBLE, 'n': 0::BIGINT, 't': []::VARCHAR[]}}, list_transform({0}, lambda x: {{'f': 0.0::DOUBLE, 'n': 0::BIGINT, 't': [x]}})), lambda a, b: CASE WHEN len(CASE WHEN list_contains(a.t, b.t[1]) THEN a.t ELSE list_append(a.t, b.t[1]) END) / (a.n + 1) <= 0.72::DOUBLE THEN {{'f': a.f + 1, 'n': 0::BIGINT, 't': []::VARCHAR[]}} ELSE {{'f': a.f, 'n': a.n + 1, 't': CASE WHEN list_contains(a.t, b.t[1]) THEN a.t ELSE list_append(a.t, b.t[1]) END}} END)"
FACTORS = "({0}.f + CASE WHEN {0}.n > 0 THEN (1 - len({0}.t) / {0}.n) / (1 - 0.72::DOUBLE) ELSE 0 END)"
DESCRIBED = "count({0}) AS n, round(avg({0}), 6) AS mean, round(stddev_samp({0}), 6) AS std, min({0})::DOUBLE AS min, round(quantile_cont({0}, 0.25), 6)::DOUBLE AS q1, round(quantile_cont({0}, 0.5), 6)::DOUBLE AS median, round(quantile_cont({0}, 0.75), 6)::DOUBLE AS q3, max({0})::DOUBLE AS max"
SCORES = "s AS (SELECT doc_id, lang, quality, toxic, (1 + 2 * quality + 2 * (1 - toxic))::DOUBLE AS score FROM labels JOIN documents USING (doc_id))"
TURNS = "tu AS (SELECT conv_id, count(*) AS turns FROM conversations GROUP BY conv_id)"
SIDES = TURNS + ", a AS (SELECT conv_id, turns, conv_id % 7 <> 0 AS completed, turns % 2 = 0 AS succeeded FROM tu), b AS (SELECT conv_id, turns + conv_id % 3 AS turns, conv_id % 5 <> 0 AS completed, turns % 3 <> 0 AS succeeded FROM tu WHERE conv_id % 10 <> 9)"
_hex = "('0x' || substr({0}, 1, 12))::BIGINT"
_WORDS = r"CASE WHEN trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')) END"
_SIDE = "round(avg({0}) FILTER ({1}), 3) AS mean_a, round(avg({0}) FILTER ({2}), 3) AS mean_b, round(avg({0}) FILTER ({1}) - avg({0}) FILTER ({2}), 3) AS delta"

QUERIES = {
    "utterance_stats": (utterance_stats, f"SELECT role, count(*) AS utterances, round(avg(w), 6) AS mean_words, sum(w)::BIGINT AS sum_words, round(count(*) / (SELECT count(DISTINCT conv_id) FROM conversations), 6) AS per_dialogue FROM (SELECT role, {_WORDS} AS w FROM conversations) GROUP BY role"),
    "dialogue_stats": (dialogue_stats, f"WITH {TURNS} SELECT {DESCRIBED.format('turns')} FROM tu"),
    "distinct_1": (distinct_1, f"WITH {DOCS}, g AS (SELECT lang, unnest(t) AS g FROM d) SELECT lang, count(*) AS total, count(DISTINCT g) AS different, round(count(DISTINCT g) / count(*), 6) AS ratio FROM g GROUP BY lang"),
    "distinct_2_within": (distinct_2_within, f"WITH {LINES}, g AS (SELECT role, unnest({GRAMS}) AS g FROM l) SELECT role, count(*) AS total, count(DISTINCT g) AS different, round(count(DISTINCT g) / count(*), 6) AS ratio FROM g GROUP BY role"),
    "distinct_2_stream": (distinct_2_stream, f"WITH {LINES}, e AS (SELECT conv_id, turn, role, unnest(t) AS w, generate_subscripts(t, 1) AS k FROM l), g AS (SELECT w || ' ' || lead(w) OVER (ORDER BY conv_id, turn, role, k) AS g FROM e) SELECT count(g) AS total, count(DISTINCT g) AS different, round(count(DISTINCT g) / count(g), 6) AS ratio FROM g"),
    "ttr_family": (ttr_family, f"WITH {DOCS}, g AS (SELECT lang, unnest(t) AS g FROM d), c AS (SELECT lang, count(*) AS n, count(DISTINCT g) AS v FROM g GROUP BY lang) SELECT lang, n AS n_tokens, v AS n_types, round(v / n, 6) AS ttr, round(v / sqrt(n), 6) AS root_ttr, round(ln(v) / ln(n), 6) AS log_ttr, round((ln(n) - ln(v)) / (ln(n) * ln(n)), 6) AS maas FROM c"),
    "mtld": (mtld, f"WITH {JOINED}, m AS (SELECT conv_id, t, {ONE_WAY.format('t')} AS a, {ONE_WAY.format('list_reverse(t)')} AS b FROM j) SELECT conv_id, len(t) AS n_tokens, CASE WHEN len(t) < 10 THEN 0 ELSE round((CASE WHEN {FACTORS.format('a')} > 0 THEN len(t) / {FACTORS.format('a')} ELSE len(t) END + CASE WHEN {FACTORS.format('b')} > 0 THEN len(t) / {FACTORS.format('b')} ELSE len(t) END) / 2, 6) END AS mtld FROM m"),
    "hdd": (hdd, f"WITH {DOCS}, w AS (SELECT lang, w, count(*) AS c FROM (SELECT lang, unnest(t) AS w FROM d) GROUP BY ALL), s AS (SELECT *, sum(c) OVER (PARTITION BY lang)::DOUBLE AS n FROM w), u AS (SELECT lang, c, n, count(*) AS m FROM s GROUP BY ALL) SELECT lang, round(sum(CASE WHEN n < 42 THEN 0 WHEN c > n - 42 THEN m ELSE m * (1 - list_aggregate(list_transform(range(42), lambda k: (n - c - k) / (n - k)), 'product')) END), 6) AS hdd FROM u GROUP BY lang"),
    "mattr_msttr": (mattr_msttr, f"WITH {JOINED} SELECT conv_id, round(CASE WHEN len(t) < 50 THEN len(list_distinct(t)) / len(t) ELSE list_avg(list_transform(range(1, len(t) - 48), lambda i: len(list_distinct(t[i:i + 49])) / 50)) END, 6) AS mattr, round(CASE WHEN len(t) < 50 THEN len(list_distinct(t)) / len(t) ELSE list_avg(list_transform(range(1, len(t) - 48, 50), lambda i: len(list_distinct(t[i:i + 49])) / 50)) END, 6) AS msttr FROM j"),
    "item_entropy": (item_entropy, "SELECT l_returnflag, sum(c)::BIGINT AS n, round(log2(sum(c)) - sum(c * log2(c)) / sum(c), 6) AS entropy FROM (SELECT l_returnflag, l_partkey, count(*) AS c FROM lineitem GROUP BY ALL) GROUP BY l_returnflag"),
    "event_entropy": (event_entropy, "WITH i AS (SELECT user_id, event_type AS item FROM events UNION ALL SELECT user_id, 'k' || json_extract_string(props, '$.k') FROM events), c AS (SELECT user_id, item, count(*) AS c FROM i GROUP BY ALL) SELECT user_id, sum(c)::BIGINT AS n, round(log2(sum(c)) - sum(c * log2(c)) / sum(c), 6) AS entropy FROM c GROUP BY user_id"),
    "cosine_diversity": (cosine_diversity, "WITH p AS (SELECT a.label, 1 - avg(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS x FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY a.label) SELECT e.label, count(*) AS n, round(coalesce(any_value(x), 0), 6) AS diversity FROM embeddings e LEFT JOIN p USING (label) GROUP BY e.label"),
    "judge_describe": (judge_describe, f"WITH {SCORES} SELECT lang, {DESCRIBED.format('score')} FROM s GROUP BY lang"),
    "judge_compare": (judge_compare, f"WITH {SCORES} " + " UNION ALL ".join(f"SELECT '{n}' AS dimension, {_SIDE.format(e, chr(119) + 'here lang = ' + repr('en'), 'where lang <> ' + repr('en'))} FROM s" for n, e in (("score", "score"), ("quality", "quality"), ("clean", "1 - toxic")))),
    "quality_bands": (quality_bands, f"WITH {SCORES} SELECT CASE WHEN score >= 4.5 THEN 'excellent' WHEN score >= 3.5 THEN 'good' WHEN score >= 2.5 THEN 'average' WHEN score >= 1.5 THEN 'bad' ELSE 'very_bad' END AS band, count(*) AS n FROM s GROUP BY band"),
    "corpus_gap": (corpus_gap, f"WITH w AS (SELECT role, {_WORDS} AS words, length(text) AS chars FROM conversations WHERE role <> 'system') " + " UNION ALL ".join(f"SELECT '{n}' AS dimension, {_SIDE.format(n, 'where role = ' + repr('user'), 'where role = ' + repr('assistant'))} FROM w" for n in ("words", "chars"))),
    "completion_sides": (completion_sides, f"WITH {SIDES}, u AS (SELECT 'first' AS side, * FROM a UNION ALL SELECT 'second', * FROM b) SELECT side, count(*) AS n, count_if(NOT completed)::BIGINT AS aborted, count_if(completed AND succeeded)::BIGINT AS succeeded, round(avg((completed AND succeeded)::INT), 6) AS completion_rate, round(avg(turns) FILTER (WHERE completed), 6) AS mean_turns FROM u GROUP BY side"),
    "completion_paired": (completion_paired, f"WITH {SIDES}, j AS (SELECT a.conv_id AS i, b.conv_id AS k, a.completed AND a.succeeded AS s1, b.completed AND b.succeeded AS s2, a.completed AND b.completed AS done, b.turns - a.turns AS diff FROM a FULL JOIN b USING (conv_id)), g AS (SELECT count_if(i IS NOT NULL AND k IS NOT NULL)::BIGINT AS pairs, count_if(i IS NULL)::BIGINT AS only_second, count_if(k IS NULL)::BIGINT AS only_first, count_if(i IS NOT NULL AND k IS NOT NULL AND s1 <> s2)::BIGINT AS outcome_differs, avg(diff) FILTER (WHERE done) AS turn_diff, avg(s1::INT) FILTER (WHERE i IS NOT NULL AND k IS NOT NULL) AS rate FROM j) SELECT pairs, only_second, only_first, outcome_differs, round(turn_diff, 6) AS turn_diff, round(rate, 6) AS rate, round(100 * sqrt(rate * (1 - rate) / pairs), 6) AS se_points FROM g"),
    "embed_cache_plan": (embed_cache_plan, "WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), m AS (SELECT * FROM d WHERE doc_id % 3 <> 0) SELECT (SELECT count(*) FROM d) AS n_rows, (SELECT count(*) FROM d) - count(*) AS hits, count(*) AS misses, ceil(count(*) / 100)::BIGINT AS requests, floor(sum(length(text)) / 4)::BIGINT AS tokens FROM m"),
    "rate_window_check": (rate_window_check, "WITH w AS (SELECT user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 21600000000 PRECEDING AND CURRENT ROW) AS n FROM events) SELECT user_id, max(n) AS most, count_if(n > 2)::BIGINT AS violations FROM w GROUP BY user_id"),
    "run_counters": (run_counters, "WITH c AS (SELECT event_type AS site, value FROM events), u AS (SELECT * FROM c UNION ALL SELECT 'all', value FROM c) SELECT site, count(*) AS calls, count_if(value > 40)::BIGINT AS fallbacks, count_if(value > 60)::BIGINT AS errors FROM u GROUP BY site"),
    "content_digest": (content_digest, f"SELECT count(*) AS n, sum({_hex.format('md5(concat_ws(chr(31), p_partkey, p_name, p_brand, p_type, p_size))')})::VARCHAR AS digest FROM part"),
    "guest_sample": (guest_sample, "SELECT p_partkey, p_name FROM part ORDER BY md5('2025:' || p_partkey), p_partkey LIMIT 50"),
    "user_item_sample": (user_item_sample, "WITH o AS (SELECT DISTINCT o_custkey, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey) SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY md5(concat_ws(':', '2025', o_custkey, l_partkey)), l_partkey) <= 3"),
    "items_with_replacement": (items_with_replacement, f"WITH p AS (SELECT p_partkey, row_number() OVER (ORDER BY md5('2025:' || p_partkey), p_partkey) - 1 AS place FROM part), d AS (SELECT draw, floor(({_hex.format(chr(109) + 'd5(concat_ws(' + repr(':') + ', ' + repr('2025') + ', ' + repr('draw') + ', draw))')} + 0.5::DOUBLE) / (1::BIGINT << 48)::DOUBLE * (SELECT count(*) FROM part))::BIGINT AS place FROM range(500) t(draw)) SELECT draw, p_partkey FROM d JOIN p USING (place)"),
    "matched_sample": (matched_sample, f"WITH {TURNS}, o AS (SELECT * FROM tu WHERE conv_id % 2 = 0), w AS (SELECT turns, count(*) AS w FROM tu WHERE conv_id % 2 = 1 GROUP BY turns), c AS (SELECT turns, count(*) AS c FROM o GROUP BY turns) SELECT conv_id, turns FROM o JOIN w USING (turns) JOIN c USING (turns) ORDER BY round(ln(({_hex.format('md5(concat_ws(chr(58), 7, conv_id))')} + 0.5::DOUBLE) / (1::BIGINT << 48)::DOUBLE) * c / w, 9) DESC, conv_id LIMIT 30"),
    "stratified_sample": (stratified_sample, "WITH c AS (SELECT toxic, count(*) AS c FROM labels GROUP BY toxic) SELECT doc_id, l.toxic FROM labels l JOIN c ON l.toxic = c.toxic QUALIFY row_number() OVER (PARTITION BY l.toxic ORDER BY md5(concat_ws(':', '11', l.toxic, doc_id)), doc_id) <= round_even(60 * c / (SELECT count(*) FROM labels), 0)"),
    "interleave": (interleave, "WITH n AS (SELECT c_custkey, c_custkey % 5 <> 3 AS p, row_number() OVER (PARTITION BY c_custkey % 5 <> 3 ORDER BY md5('2025:' || c_custkey), c_custkey) - 1 AS n, count_if(c_custkey % 5 <> 3) OVER () AS a, count_if(c_custkey % 5 = 3) OVER () AS b FROM customer) SELECT c_custkey, p AS profiled, CASE WHEN p THEN n + least(n // 3, b) ELSE n + least((n + 1) * 3, a) END::BIGINT AS place FROM n"),
    "message_cut": (message_cut, r"WITH h AS (SELECT *, substr(text, 1, 250) AS h, regexp_replace(regexp_replace(regexp_replace(text || CASE turn % 3 WHEN 0 THEN '... ...' WHEN 1 THEN ' …… ' ELSE '' END, '\s+$', ''), '\s*(\.\.\.\s*)+$', ''), '\s*(…\s*)+$', '') AS w FROM conversations), m AS (SELECT *, regexp_extract(h, '(?s)^(.*[.!?])', 1) AS s, regexp_extract(h, '(?s)^(.*) ', 1) AS k FROM h) SELECT conv_id, turn, role, CASE WHEN length(text) <= 250 THEN text WHEN s <> '' THEN s WHEN k <> '' THEN k || '…' ELSE h END AS cut, md5(regexp_extract(w, '(?s)^(.*[.!?])', 1)) AS sentences FROM m"),
    "category_words": (category_words, r"SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{M}\p{N}\p{Pc}]+')) AS word FROM documents) GROUP BY word"),
    "tokenizer_variants": (tokenizer_variants, r"SELECT doc_id, len(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}\p{Co}]+')) AS unicode61, len(regexp_extract_all(coalesce(text, ''), '[a-zA-Z0-9\x{80}-\x{10FFFF}]+')) AS ascii, len(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}\p{Co}]+')) AS porter, greatest(0, length(lower(coalesce(text, ''))) - 2) AS trigram FROM documents"),
}
