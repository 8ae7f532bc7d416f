"""Registered retrieval queries, each with its DuckDB counterpart.

Query sets are whole: every vector whose id is a multiple of 50, and every benchmark text. Scores are ranked to nine
places (BM25: eight) with ids for ties, and shown to six.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlake.functions import vectors as V
from cairnlake.operators import bm25, hybrid
from cairnlake.operators.knn import nearest
from cairnlake.session import durable, table

STEP = 50


def _round6(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), V.doubles(F.col("embedding")).alias("vector"), "label")


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).where(F.col("item_id") % STEP == 0).withColumnRenamed("item_id", "query_id")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def text_index(spark: SparkSession, sf_dir: str) -> bm25.TextIndex:
    return bm25.opened_index(texts(spark, sf_dir), f"{sf_dir}/documents.parquet")


def text_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def hybrid_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query vectors with a benchmark text each, and the profiles of their label."""
    own = items(spark, sf_dir)
    first = own.groupBy("label").agg(F.min("item_id").alias("a"))
    ordered = own.join(first, "label").withColumn("n", F.expr("row_number() OVER (PARTITION BY label ORDER BY item_id)")).where("n <= 3")
    long = V.mean_vectors(own, ["label"], "vector", "long_profile")
    short = V.mean_vectors(ordered, ["label"], "vector", "short_profile")
    text = text_queries(spark, sf_dir).select((F.col("query_id") * STEP).alias("query_id"), "text")
    return vector_queries(spark, sf_dir).join(text, "query_id", "left").join(long, "label").join(short, "label")


def _found(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    own, queries = items(spark, sf_dir), hybrid_queries(spark, sf_dir)
    index = text_index(spark, sf_dir)
    return durable(hybrid.candidates(index, queries, own)), queries, own


def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nearest(vector_queries(spark, sf_dir), items(spark, sf_dir), 30)
    return _round6(found, "cos_score")


def knn_filtered_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    def mask(q, i):  # another label, and not the query itself
        return (q["label"].to_numpy()[:, None] != i["label"].to_numpy()[None, :]) & (q["query_id"].to_numpy()[:, None] != i["item_id"].to_numpy()[None, :])

    return _round6(nearest(vector_queries(spark, sf_dir), items(spark, sf_dir), 30, mask), "cos_score")


def vector_l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "embeddings").select("vec_id", V.stored_unit(F.transform("embedding", lambda x: x * 3)).alias("u"))
    return own.select("vec_id", F.round(V.norm(F.col("u")), 5).alias("norm"), F.round(F.get("u", F.lit(0)).cast("double"), 5).alias("first"))


def vector_cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of every vector with the mean of its label."""
    own = items(spark, sf_dir)
    both = own.join(V.mean_vectors(own, ["label"], "vector", "mean"), "label")
    return _round6(both.select("item_id", V.cosine(F.col("vector"), F.col("mean")).alias("cosine"), V.as_share(V.cosine(F.col("vector"), F.col("mean"))).alias("share")), "cosine", "share")


def reference_blend_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of queries blended with the mean of their label."""
    own = items(spark, sf_dir)
    queries = vector_queries(spark, sf_dir).join(V.mean_vectors(own, ["label"], "vector", "mean"), "label")
    return _round6(nearest(queries.withColumn("vector", V.blend(F.col("vector"), F.col("mean"))), own, 10), "cos_score")


def truncate_renorm(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = items(spark, sf_dir).select("item_id", V.shortened(F.col("vector"), 16).alias("v"))
    return _round6(own.select("item_id", F.size("v").cast("long").alias("size"), V.norm(F.col("v")).alias("norm"), F.get("v", F.lit(0)).alias("first")), "norm", "first")


def bm25_doc_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.doc_lengths(texts(spark, sf_dir))


def bm25_term_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.document_frequencies(texts(spark, sf_dir))


def bm25_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bm25.best(bm25.top_k(text_index(spark, sf_dir), text_queries(spark, sf_dir), 10), 10)
    return _round6(found.select("query_id", "rank", "item_id", "bm25_raw"), "bm25_raw")


def bm25_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bm25.best(bm25.top_k(text_index(spark, sf_dir), text_queries(spark, sf_dir), 30), 30)
    return _round6(bm25.scaled(found).select("query_id", "item_id", "bm25_norm"), "bm25_norm")


def hybrid_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _, _ = _found(spark, sf_dir)
    return _round6(found, "cos_score", "bm25_norm", "base_score")


def hybrid_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, queries, own = _found(spark, sf_dir)
    out = hybrid.ranked(hybrid.with_profiles(hybrid.gated(found, 0.3), queries, own), 10)
    return _round6(out.select("query_id", "rank", "item_id", "score", "base_score"), "score", "base_score")


def hybrid_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exit path of every query at the shipped threshold and at a higher one that some miss."""
    found, queries, _ = _found(spark, sf_dir)
    both = [hybrid.status(found, queries, t).withColumn("threshold", F.lit(t)) for t in (0.3, 0.72)]
    return _round6(both[0].unionByName(both[1]), "max_base_score")


def hybrid_fallback_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid.first_items(vector_queries(spark, sf_dir), items(spark, sf_dir), 10)


def jaccard_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of each query's ten nearest items, plain against blended, among those of another label than 0."""
    own = items(spark, sf_dir)
    queries = vector_queries(spark, sf_dir).join(V.mean_vectors(own, ["label"], "vector", "mean"), "label")
    plain = nearest(queries, own, 10)
    mixed = nearest(queries.withColumn("vector", V.blend(F.col("vector"), F.col("mean"))), own.where("label > 0"), 10).where("query_id % 100 <> 0")
    return _round6(hybrid.overlap(queries, plain, mixed), "jaccard")


VECTORS = """
    i AS (SELECT vec_id AS item_id, embedding::DOUBLE[] AS v, label FROM embeddings),
    q AS (SELECT item_id AS query_id, v AS qv, label AS qlabel FROM i WHERE item_id % 50 = 0)"""
MEANS = """
    parts AS (SELECT label, item_id, unnest(v) AS x, generate_subscripts(v, 1) AS k FROM i),
    long AS (SELECT label, list(x ORDER BY k) AS mean FROM (SELECT label, k, avg(x) AS x FROM parts GROUP BY ALL) GROUP BY label)"""
COS = "(1 + list_dot_product(v, qv) / sqrt(list_dot_product(qv, qv))) / 2"
TOKENS = r"""
    tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}\p{Co}]+')) AS term FROM documents),
    post AS (SELECT term, doc_id, count(*) AS tf FROM tok GROUP BY ALL),
    dl AS (SELECT d.doc_id, count(t.term) AS dl FROM documents d LEFT JOIN tok t ON d.doc_id = t.doc_id GROUP BY d.doc_id),
    dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
    st AS (SELECT count(*) AS n, sum(dl) / count(*) AS avgdl FROM dl)"""


def _bm25_sql(queries: str, extra: str = "") -> str:
    """CTEs qt and hits: scores of (query_id, item_id) for the rows (query_id, text) of ``queries``."""
    return TOKENS + rf""",
    qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}\p{{Co}}]+')) AS term FROM {queries}) GROUP BY ALL),
    hits AS (SELECT query_id, p.doc_id AS item_id, sum(qtf * CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)))) AS raw
             FROM qt JOIN dfs USING (term) JOIN post p USING (term) JOIN dl USING (doc_id), st {extra} GROUP BY ALL)"""


HYBRID = rf"""WITH {VECTORS}, {MEANS},
    short AS (SELECT label, list(x ORDER BY k) AS mean FROM (SELECT label, k, avg(x) AS x FROM (SELECT *, dense_rank() OVER (PARTITION BY label ORDER BY item_id) AS n FROM parts) WHERE n <= 3 GROUP BY ALL) GROUP BY label),
    near AS (SELECT query_id, qlabel, item_id, v, {COS} AS cos, row_number() OVER (PARTITION BY query_id ORDER BY round({COS}, 9) DESC, item_id) AS knn_rank FROM q, i QUALIFY knn_rank <= 30),
    qtext AS (SELECT item_id * 50 AS query_id, text FROM benchmark WHERE item_id * 50 IN (SELECT query_id FROM q)),
    {_bm25_sql("qtext", "WHERE (query_id, p.doc_id) IN (SELECT (query_id, item_id) FROM near)")},
    normed AS (SELECT query_id, item_id, CASE WHEN max(raw) OVER w = min(raw) OVER w THEN 0 ELSE (raw - min(raw) OVER w) / (max(raw) OVER w - min(raw) OVER w) END AS norm FROM hits WINDOW w AS (PARTITION BY query_id)),
    base AS (SELECT near.*, coalesce(norm, 0)::DOUBLE AS bm25_norm, 0.3 * coalesce(norm, 0)::DOUBLE + 0.7 * cos AS base_score FROM near LEFT JOIN normed USING (query_id, item_id))"""

QUERIES = {
    "knn_topk": (knn_topk, f"WITH {VECTORS} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round({COS}, 9) DESC, item_id)::INT AS rank, item_id, round({COS}, 6) AS cos_score FROM q, i QUALIFY rank <= 30"),
    "knn_filtered_topk": (knn_filtered_topk, f"WITH {VECTORS} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round({COS}, 9) DESC, item_id)::INT AS rank, item_id, round({COS}, 6) AS cos_score FROM q, i WHERE label <> qlabel AND item_id <> query_id QUALIFY rank <= 30"),
    "vector_l2_normalize": (vector_l2_normalize, "WITH u AS (SELECT vec_id, [x * 3 FOR x IN embedding]::DOUBLE[] AS t FROM embeddings), n AS (SELECT vec_id, list_transform(t, lambda x: (x / sqrt(list_dot_product(t, t)))::FLOAT)::DOUBLE[] AS u FROM u) SELECT vec_id, round(sqrt(list_dot_product(u, u)), 5) AS norm, round(u[1], 5) AS first FROM n"),
    "vector_cosine_pairs": (vector_cosine_pairs, f"WITH {VECTORS}, {MEANS} SELECT item_id, round(list_cosine_similarity(v, mean), 6) AS cosine, round((1 + list_cosine_similarity(v, mean)) / 2, 6) AS share FROM i JOIN long USING (label)"),
    "reference_blend_knn": (reference_blend_knn, f"WITH {VECTORS}, {MEANS}, b AS (SELECT query_id, list_transform(list_zip(qv, mean), lambda p: 0.7::DOUBLE * p[1] + 0.3::DOUBLE * p[2]) AS qv FROM q JOIN long ON qlabel = long.label) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round({COS}, 9) DESC, item_id)::INT AS rank, item_id, round({COS}, 6) AS cos_score FROM b, i QUALIFY rank <= 10"),
    "truncate_renorm": (truncate_renorm, f"WITH {VECTORS}, s AS (SELECT item_id, v[1:16] AS t FROM i), u AS (SELECT item_id, list_transform(t, lambda x: x / sqrt(list_dot_product(t, t))) AS u FROM s) SELECT item_id, len(u) AS size, round(sqrt(list_dot_product(u, u)), 6) AS norm, round(u[1], 6) AS first FROM u"),
    "bm25_doc_stats": (bm25_doc_stats, f"WITH {TOKENS} SELECT doc_id, dl FROM dl"),
    "bm25_term_df": (bm25_term_df, f"WITH {TOKENS} SELECT term, df FROM dfs"),
    "bm25_scores": (bm25_scores, f"WITH bq AS (SELECT item_id AS query_id, text FROM benchmark), {_bm25_sql('bq')} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 8) DESC, item_id)::INT AS rank, item_id, round(raw, 6) AS bm25_raw FROM hits QUALIFY rank <= 10"),
    "bm25_minmax": (bm25_minmax, f"WITH bq AS (SELECT item_id AS query_id, text FROM benchmark), {_bm25_sql('bq')}, top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 8) DESC, item_id) AS rank FROM hits QUALIFY rank <= 30) SELECT query_id, item_id, CASE WHEN max(raw) OVER w = min(raw) OVER w THEN 0.0 ELSE round((raw - min(raw) OVER w) / (max(raw) OVER w - min(raw) OVER w), 6) END AS bm25_norm FROM top WINDOW w AS (PARTITION BY query_id)"),
    "hybrid_base": (hybrid_base, HYBRID + " SELECT query_id, item_id, knn_rank::INT AS knn_rank, round(cos, 6) AS cos_score, round(bm25_norm, 6) AS bm25_norm, round(base_score, 6) AS base_score FROM base"),
    "hybrid_profile": (hybrid_profile, HYBRID + ", ok AS (SELECT * FROM base QUALIFY max(base_score) OVER (PARTITION BY query_id) >= 0.3), s AS (SELECT ok.*, 0.7::DOUBLE * base_score + (1 - 0.7::DOUBLE) * (0.3::DOUBLE * (1 + list_cosine_similarity(v, short.mean)) / 2 + (1 - 0.3::DOUBLE) * (1 + list_cosine_similarity(v, long.mean)) / 2) AS score FROM ok JOIN long ON long.label = qlabel JOIN short ON short.label = qlabel) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, knn_rank)::INT AS rank, item_id, round(score, 6) AS score, round(base_score, 6) AS base_score FROM s QUALIFY rank <= 10"),
    "hybrid_gate": (hybrid_gate, HYBRID + ", m AS (SELECT query_id, count(*) AS n_candidates, max(base_score) AS top FROM base GROUP BY query_id) SELECT query_id, n_candidates, round(top, 6) AS max_base_score, CASE WHEN top < threshold THEN 'gate_failed' ELSE 'gate_passed' END AS exit_path, threshold::DOUBLE AS threshold FROM m, (VALUES (0.3), (0.72)) t(threshold)"),
    "hybrid_fallback_order": (hybrid_fallback_order, f"WITH {VECTORS} SELECT query_id, rank::INT AS rank, item_id FROM q, (SELECT item_id, row_number() OVER (ORDER BY item_id) AS rank FROM i QUALIFY rank <= 10)"),
    "jaccard_at_k": (jaccard_at_k, f"WITH {VECTORS}, {MEANS}, a AS (SELECT query_id, item_id FROM q, i QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round({COS}, 9) DESC, item_id) <= 10), b0 AS (SELECT query_id, list_transform(list_zip(qv, mean), lambda p: 0.7::DOUBLE * p[1] + 0.3::DOUBLE * p[2]) AS qv FROM q JOIN long ON qlabel = long.label), b AS (SELECT query_id, item_id FROM b0, i WHERE label > 0 AND query_id % 100 <> 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round({COS}, 9) DESC, item_id) <= 10), o AS (SELECT query_id, count_if(a.item_id IS NOT NULL AND b.item_id IS NOT NULL) / count(*) AS j FROM a FULL JOIN b USING (query_id, item_id) GROUP BY query_id) SELECT query_id, round(coalesce(j, 1), 6) AS jaccard FROM q LEFT JOIN o USING (query_id)"),
}
