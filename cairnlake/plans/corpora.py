"""Registered queries over whole ordered corpora: pooled diversity, request admission and ordered digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlake.functions import text as T
from cairnlake.functions.vectors import norm
from cairnlake.operators import bm25
from cairnlake.operators.admission import admitted, parse_rate, waits
from cairnlake.operators.calls import evaluated
from cairnlake.operators.digests import ordered_digest
from cairnlake.operators.diversity import sampled_cosine_diversity
from cairnlake.operators.streams import Stream, pooled_diversity, stream_of
from cairnlake.plans.analytics import FACTORS, LINES, ONE_WAY, line_tokens
from cairnlake.session import scratch_path, table
from cairnlake.sources import commits
from cairnlake.sources.embedded import with_vectors
from cairnlake.sources.readers import read_index
from cairnlake.sources.writers import write_index

RATE = "3/7200"


def spoken(spark: SparkSession, sf_dir: str) -> Stream:
    """The tokens of all lines of users and assistants, conversation after conversation."""
    return stream_of(line_tokens(spark, sf_dir), ["conv_id", "turn", "role"], "tokens")


def pooled_mtld(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations as one stream: a row of its measures."""
    found = pooled_diversity(spoken(spark, sf_dir))
    row = tuple(round(v, 6) if isinstance(v, float) else v for v in found.values())
    return spark.createDataFrame([row], "n_tokens long, mtld double, mattr double, msttr double, mtld_ma_bid double, mtld_ma_wrap double")


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "event_type", "ts")


def rate_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each event could start if every event type is a gate of its own."""
    most, seconds = parse_rate(RATE)
    found = admitted(_requests(spark, sf_dir), ["event_type"], "ts", ["event_id"], most, seconds)
    return found.select("event_id", "event_type", "start_us", "wait_us")


def rate_waits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waits at one gate for all events, of two in ten minutes."""
    found = admitted(_requests(spark, sf_dir), [], "ts", ["event_id"], 2, 600)
    return waits(found, ["event_type"], F.col("wait_us"))


def index_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of a catalogue's rows in order, of its vocabulary with documents and occurrences, and of its vectors."""
    vocabulary = bm25.vocabulary(table(spark, sf_dir, "documents").select("doc_id", "text"), T.category_tokens)
    parts = {
        "items": ordered_digest(table(spark, sf_dir, "part"), ["p_partkey"], ["p_partkey", "p_name", "p_brand", "p_type", "p_size"]),
        "vocabulary": ordered_digest(vocabulary, ["term"], ["term", "docs", "occurrences"]),
        "vectors": ordered_digest(table(spark, sf_dir, "embeddings"), ["vec_id"], ["vec_id", "embedding"]),
    }
    return spark.createDataFrame([(name, n, digest) for name, (n, digest) in parts.items()], "part string, n long, digest string")


def evaluator_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested evaluator replies about the labelled documents, some fenced, some without an aspect."""
    own = table(spark, sf_dir, "labels")
    aspect = lambda name, value: F.format_string(f'"{name}": {{"score": %d, "reason": "so"}}', value.cast("int"))
    middle = F.when(F.col("doc_id") % 7 == 0, '"informativeness": {"reason": "none"}').otherwise(aspect("informativeness", F.col("doc_id") % 5 + 1))
    body = F.concat(F.lit("{"), F.concat_ws(", ", aspect("fluency", 1 + 4 * F.col("quality")), middle, aspect("coherence", 5 - 3 * F.col("toxic"))), F.lit("}"))
    reply = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    return evaluated(own.select("doc_id", reply.alias("reply"))).drop("reply")


def cosine_diversity_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spread of each label's first 20 vectors, and of 20 drawn with a seed."""
    own = table(spark, sf_dir, "embeddings")
    both = [sampled_cosine_diversity(own, ["label"], "embedding", ["vec_id"], 20, seed).withColumn("drawn", F.lit(seed is not None)) for seed in (None, 42)]
    return both[0].unionByName(both[1]).select("label", "drawn", "n", F.round("diversity", 6).alias("diversity"))


def cache_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache of all documents' digests filled in commits of 400, first the even ids, then all: rows and ids of each commit."""
    path = scratch_path(spark, "cache")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    digest = lambda rows: rows.select("doc_id", F.md5("text").alias("digest"))
    commits.fill(docs.where("doc_id % 2 = 0"), path, ["doc_id"], digest, 400)
    commits.fill(docs, path, ["doc_id"], digest, 400)
    held = commits.read_commits(spark, path).groupBy("commit").agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.min("digest").alias("least"))
    return held.select(F.substring("commit", 1, 12).cast("long").alias("commit"), "n", "low", "high", "least")


def catalogue_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose vectors come through the cache, written as an index and read again: each item's text, vector and document length."""
    path = scratch_path(spark, "catalogue")
    items = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title"), F.col("p_type").alias("category"))
    texts = items.withColumn("search_text", F.concat_ws(" ", "title", "category"))
    write_index(with_vectors(texts, None, f"{path}/cache", "hash", most=None, rows_a_commit=5_000), f"{path}/index", ["title", "category"])
    held, index = read_index(spark, f"{path}/index")
    both = held.join(index.doc_len.withColumnRenamed("doc_id", "item_id"), "item_id")
    return both.select("item_id", "title", F.size("vector").cast("long").alias("size"), F.round(norm(F.col("vector")), 4).alias("norm"), "dl")


_STREAM = LINES + """,
    tok AS (SELECT row_number() OVER (ORDER BY conv_id, turn, role, k) - 1 AS i, w FROM (SELECT conv_id, turn, role, unnest(t) AS w, generate_subscripts(t, 1) AS k FROM l)),
    size AS (SELECT count(*) AS n FROM tok),
    whole AS (SELECT list(w ORDER BY i) AS t FROM tok)"""


def _moving(name: str, turned: str) -> str:
    """First factor from every position of the circular stream, all positions a token at a time."""
    return f"""
    {name}_c AS (SELECT {turned} AS i, w FROM tok, size UNION ALL SELECT {turned} + n, w FROM tok, size),
    {name}_p AS (SELECT i, coalesce(lag(i) OVER (PARTITION BY w ORDER BY i), -1) AS before FROM {name}_c),
    {name}_b AS (SELECT list(before ORDER BY i) AS b FROM {name}_p),
    {name}_f AS (
        SELECT i, 1 AS l, 1 AS v, false AS done FROM {name}_p, size WHERE i < n
        UNION ALL
        SELECT i, l + 1, w, w / (l + 1) < 0.72::DOUBLE AND l >= 9 FROM (SELECT i, l, v + (b[i + l + 1] < i)::INT AS w FROM {name}_f, {name}_b, size WHERE NOT done AND l < n)),
    {name}_d AS (SELECT i, l FROM {name}_f WHERE done)"""


_ONE = f"CASE WHEN {FACTORS} > 0 THEN n / {FACTORS} ELSE n END"
_MA = "coalesce((SELECT avg(l) FROM {0}_d, size WHERE i + l <= n), 0)"
POOLED = f"""WITH RECURSIVE {_STREAM}, {_moving('o', 'i')}, {_moving('b', 'n - 1 - i')},
    w50 AS (SELECT i, list_sum(list_transform(range(50), lambda k: (b[i + k + 1] < i)::INT)) / 50 AS ratio FROM o_p, o_b, size WHERE i <= n - 50),
    m AS (SELECT t, len(t) AS n, {ONE_WAY.format('t')} AS a, {ONE_WAY.format('list_reverse(t)')} AS b FROM whole)
    SELECT n AS n_tokens, round(({_ONE.format('a')} + {_ONE.format('b')}) / 2, 6) AS mtld,
        (SELECT round(avg(ratio), 6) FROM w50) AS mattr, (SELECT round(avg(ratio), 6) FROM w50 WHERE i % 50 = 0) AS msttr,
        round(({_MA.format('o')} + {_MA.format('b')}) / 2, 6) AS mtld_ma_bid, round(coalesce((SELECT avg(l) FROM o_d), 0), 6) AS mtld_ma_wrap
    FROM m"""


def _served(gate: str, most: int, seconds: int) -> str:
    """Each request waits for the ``most``-th one before it."""
    return f"""WITH RECURSIVE q AS (SELECT event_id, event_type, {gate} AS gate, epoch_us(ts) AS us, row_number() OVER (PARTITION BY {gate} ORDER BY ts, event_id) - 1 AS place FROM events WHERE ts IS NOT NULL),
    s AS (
        SELECT event_id, event_type, gate, us, place, us AS start_us FROM q WHERE place < {most}
        UNION ALL
        SELECT q.event_id, q.event_type, q.gate, q.us, q.place, greatest(q.us, s.start_us + {seconds} * 1000000::BIGINT) FROM s JOIN q ON q.gate = s.gate AND q.place = s.place + {most})"""


def _tree(name: str, rows: str) -> str:
    """Hash tree of fan 256 over (place, node)."""
    return f"""{name}_t AS (
        SELECT 0 AS level, place, node, size FROM ({rows})
        UNION ALL
        SELECT level + 1, place // 256, sha256(string_agg(node, '' ORDER BY place)), (size + 255) // 256 FROM {name}_t WHERE size > 1 GROUP BY level, place // 256, size),
    {name}_r AS (SELECT (SELECT count(*) FROM {name}_t WHERE level = 0) AS n, (SELECT node FROM {name}_t WHERE size = 1) AS digest)"""


_field = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0} END"
_row = lambda order, *names: f"row_number() OVER (ORDER BY {order}) - 1 AS place, sha256(concat({', '.join(_field.format(n) for n in names)})) AS node, count(*) OVER () AS size"
_VECTOR = "list_aggregate(list_transform(embedding, lambda x: floor(x::DOUBLE * 1152921504606846976)::HUGEINT::VARCHAR), 'string_agg', ' ')"
DIGESTS = f"""WITH RECURSIVE {_tree('i', 'SELECT ' + _row('p_partkey', 'p_partkey', 'p_name', 'p_brand', 'p_type', 'p_size') + ' FROM part')},
    w AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{M}}\\p{{N}}\\p{{Pc}}]+')) AS term FROM documents),
    v AS (SELECT term, count(DISTINCT doc_id) AS docs, count(*) AS occurrences FROM w GROUP BY term),
    {_tree('v', 'SELECT ' + _row('term', 'term', 'docs', 'occurrences') + ' FROM v')},
    e AS (SELECT vec_id, {_VECTOR} AS embedding FROM embeddings),
    {_tree('e', 'SELECT ' + _row('vec_id', 'vec_id', 'embedding') + ' FROM e')}
    SELECT 'items' AS part, n, digest FROM i_r UNION ALL SELECT 'vocabulary', n, digest FROM v_r UNION ALL SELECT 'vectors', n, digest FROM e_r"""

_SAMPLE = "SELECT {0} AS drawn, label, vec_id, embedding::DOUBLE[] AS v FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY {1}) <= 20"
SAMPLED = f"""WITH s AS ({_SAMPLE.format('false', 'vec_id')} UNION ALL {_SAMPLE.format('true', "md5('42:' || vec_id), vec_id")}),
    p AS (SELECT a.label, a.drawn, 1 - avg(list_dot_product(a.v, b.v)) AS x FROM s a JOIN s b ON a.label = b.label AND a.drawn = b.drawn AND a.vec_id < b.vec_id GROUP BY ALL)
    SELECT label, drawn, count(*) AS n, round(coalesce(any_value(x), 0), 6) AS diversity FROM s LEFT JOIN p USING (label, drawn) GROUP BY label, drawn"""
EVALUATED = """WITH a AS (SELECT doc_id, (1 + 4 * quality)::DOUBLE AS fluency, CASE WHEN doc_id % 7 <> 0 THEN (doc_id % 5 + 1)::DOUBLE END AS informativeness, (5 - 3 * toxic)::DOUBLE AS coherence FROM labels),
    o AS (SELECT *, round((fluency + informativeness + coherence) / 3, 1) AS overall_score FROM a)
    SELECT *, CASE WHEN overall_score >= 4.5 THEN 'excellent' WHEN overall_score >= 3.5 THEN 'good' WHEN overall_score >= 2.5 THEN 'average' WHEN overall_score >= 1.5 THEN 'bad' WHEN overall_score IS NOT NULL THEN 'very_bad' END AS overall_quality FROM o"""

COMMITS = """WITH d AS (SELECT doc_id, md5(coalesce(text, '')) AS digest, doc_id % 2 AS odd, row_number() OVER (PARTITION BY doc_id % 2 ORDER BY doc_id) - 1 AS place FROM documents),
    c AS (SELECT *, place // 400 + CASE WHEN odd = 1 THEN (SELECT ceil(count(*) / 400)::BIGINT FROM d WHERE odd = 0) ELSE 0 END AS commit FROM d)
    SELECT commit, count(*) AS n, min(doc_id) AS low, max(doc_id) AS high, min(digest) AS least FROM c GROUP BY commit"""

CATALOGUE = r"""SELECT p_partkey AS item_id, p_name AS title, 64::BIGINT AS size, 1.0::DOUBLE AS norm, len(regexp_extract_all(lower(p_name || ' ' || p_type), '[\p{L}\p{N}\p{Co}]+')) AS dl FROM part"""

QUERIES = {
    "catalogue_index": (catalogue_index, CATALOGUE),
    "cache_commits": (cache_commits, COMMITS),
    "evaluator_scores": (evaluator_scores, EVALUATED),
    "cosine_diversity_sampled": (cosine_diversity_sampled, SAMPLED),
    "pooled_mtld": (pooled_mtld, POOLED),
    "rate_admission": (rate_admission, _served("event_type", 3, 7200) + " SELECT event_id, event_type, start_us, start_us - us AS wait_us FROM s"),
    "rate_waits": (rate_waits, _served("1", 2, 600) + " SELECT event_type, count(*) AS requests, count_if(start_us > us)::BIGINT AS delayed, sum(start_us - us)::BIGINT AS total_wait_us, max(start_us - us) AS most_wait_us FROM s GROUP BY event_type"),
    "index_digest": (index_digest, DIGESTS),
}
