"""Registered queries of the quantised scorer and of title lookup by words within a few edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlake.functions import text as T
from cairnlake.functions import vectors as V
from cairnlake.operators import bm25
from cairnlake.operators.edits import best_title
from cairnlake.plans.retrieval import STEP, TOKENS, text_index, text_queries
from cairnlake.session import table


def bm25_quantised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark text by BM25 with quantised lengths."""
    found = bm25.best(bm25.top_k(text_index(spark, sf_dir), text_queries(spark, sf_dir), 10, bm25.QUANTISED), 10)
    return found.select("query_id", "rank", "item_id", F.round("bm25_raw", 6).alias("bm25_raw"))


def fuzzy_title_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best part for the names of every 50th one, the first two letters of which are swapped."""
    parts = table(spark, sf_dir, "part")
    name = F.col("p_name")
    swapped = F.concat(F.substring(name, 2, 1), F.substring(name, 1, 1), F.substring(name, F.lit(3), F.char_length(name)))
    lookups = parts.where(F.col("p_partkey") % STEP == 0).select(F.col("p_partkey").alias("query_id"), swapped.alias("text"))
    index = bm25.build_index(parts.select(F.col("p_partkey").alias("doc_id"), name.alias("text")))
    return best_title(index, lookups).select("query_id", "item_id", F.round("score", 6).alias("score"))


def standard_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document by Unicode's word boundaries: their number, the different ones, and a digest of them in order."""
    own = table(spark, sf_dir, "documents").select("doc_id", T.standard_tokens(F.col("text")).alias("t"))
    return own.select("doc_id", F.size("t").cast("long").alias("words"), F.size(F.array_distinct("t")).cast("long").alias("different"), F.md5(F.array_join("t", " ")).alias("digest"))


def single_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squared lengths of all vectors, tripled, in single precision: in order, in eight lanes, and the same of their first 45 components."""
    own = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: (x * 3).cast("float")).alias("v"))
    short = F.slice("v", 1, 45)
    sums = {"in_order": V.single_square(F.col("v")), "in_lanes": V.lane_square(F.col("v")), "short_in_order": V.single_square(short), "short_in_lanes": V.lane_square(short)}
    return own.select("vec_id", *(F.round(c.cast("double"), 9).alias(n) for n, c in sums.items()))


_LENGTH = "CASE WHEN dl < 24 THEN dl ELSE 24 + (((dl - 24) >> greatest(0, length(bin(dl - 24)) - 4)) << greatest(0, length(bin(dl - 24)) - 4)) END"
_PART = f"tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * ({_LENGTH}) / avgdl))"
_IDF = "ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))"
_WORDS = "unnest(regexp_extract_all(lower(coalesce({0}, '')), '[\\p{{L}}\\p{{N}}\\p{{Co}}]+'))"

_STANDARD = "flatten(list_transform(regexp_extract_all(coalesce(text, ''), '" + T.word_pattern("").replace("'", "''") + "'), lambda t: list_transform(range(0, (length(t) + 254) // 255), lambda k: lower(substr(t, k * 255 + 1, 255)))))"

def _fused(values: str, begin: str = "0::FLOAT") -> str:
    return f"list_reduce(list_prepend({begin}, {values}), lambda a, x: (x::DOUBLE * x::DOUBLE + a::DOUBLE)::FLOAT)"


def _lanes(v: str, n: int) -> str:
    """Eight lanes of a vector of ``n`` components, more than 16."""
    limit = n - n % 8
    unrolled = max(0, -(-(limit - 24) // 32)) * 32
    at = lambda k, r: [32 * t + 8 * r + k for t in range(unrolled // 32)] + ([i for i in range(unrolled, limit) if i % 8 == k] if r == 0 else [])
    register = lambda k, r: _fused(f"list_select({v}, {[i + 1 for i in at(k, r)]}::BIGINT[])")
    whole = "0::FLOAT"
    for k in range(8):
        whole = f"({whole} + (({register(k, 0)} + {register(k, 1)})::FLOAT + ({register(k, 2)} + {register(k, 3)})::FLOAT)::FLOAT)::FLOAT"
    return _fused(f"{v}[{limit + 1}:]", whole) if limit < n else whole


_ORDERED = "list_reduce(list_prepend(0::FLOAT, {0}), lambda a, x: (a + (x * x)::FLOAT)::FLOAT)"
SQUARES = f"""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: (x::FLOAT * 3::FLOAT)::FLOAT) AS v FROM embeddings)
    SELECT vec_id, round({_ORDERED.format('v')}::DOUBLE, 9) AS in_order, round(({_lanes('v', 64)})::DOUBLE, 9) AS in_lanes,
        round({_ORDERED.format('v[1:45]')}::DOUBLE, 9) AS short_in_order, round(({_lanes('v[1:45]', 45)})::DOUBLE, 9) AS short_in_lanes FROM e"""

QUERIES = {
    "single_squares": (single_squares, SQUARES),
    "standard_words": (standard_words, f"WITH s AS (SELECT doc_id, {_STANDARD} AS t FROM documents) SELECT doc_id, len(t) AS words, len(list_distinct(t)) AS different, md5(array_to_string(t, ' ')) AS digest FROM s"),
    "bm25_quantised": (
        bm25_quantised,
        f"""WITH {TOKENS}, own AS (SELECT count(*) AS n, sum(dl) / count(*) AS avgdl FROM dl WHERE dl > 0),
        qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, {_WORDS.format('text')} AS term FROM benchmark) GROUP BY ALL),
        hits AS (SELECT query_id, doc_id AS item_id, sum(qtf * {_IDF} * {_PART}) AS raw FROM qt JOIN post USING (term) JOIN dfs USING (term) JOIN dl USING (doc_id), own GROUP BY ALL)
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 8) DESC, item_id)::INT AS rank, item_id, round(raw, 6) AS bm25_raw FROM hits QUALIFY rank <= 10""",
    ),
    "fuzzy_title_words": (
        fuzzy_title_words,
        f"""WITH tok AS (SELECT p_partkey AS doc_id, {_WORDS.format('p_name')} AS term FROM part),
        post AS (SELECT term, doc_id, count(*) AS tf FROM tok GROUP BY ALL), dl AS (SELECT doc_id, count(*) AS dl FROM tok GROUP BY doc_id),
        dfs AS (SELECT term, count(*) AS d FROM post GROUP BY term), own AS (SELECT count(*) AS n, sum(dl) / count(*) AS avgdl FROM dl),
        qt AS (SELECT query_id, word, count(*) AS qtf FROM (SELECT p_partkey AS query_id, {_WORDS.format("substr(p_name, 2, 1) || substr(p_name, 1, 1) || substr(p_name, 3)")} AS word FROM part WHERE p_partkey % 50 = 0) GROUP BY ALL),
        w AS (SELECT DISTINCT word FROM qt),
        near AS (SELECT word, term, d, 1 - damerau_levenshtein(word, term) / least(length(word), length(term)) AS weight FROM w, dfs WHERE damerau_levenshtein(word, term) <= CASE WHEN length(word) < 3 THEN 0 WHEN length(word) < 6 THEN 1 ELSE 2 END),
        wide AS (SELECT word, term, weight, max(d) OVER (PARTITION BY word) AS df FROM (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY word ORDER BY weight DESC, term) <= 50)),
        hits AS (SELECT query_id, doc_id AS item_id, sum(qtf * weight * {_IDF} * {_PART}) AS score FROM qt JOIN wide USING (word) JOIN post USING (term) JOIN dl USING (doc_id), own GROUP BY ALL)
        SELECT query_id, item_id, round(score, 6) AS score FROM hits QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 8) DESC, item_id) = 1""",
    ),
}
