"""The registered queries of this subpackage and, where SQL can express them, their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlake.llm import compression, embedding_dedup, exact_dedup, html_text, lempel_ziv, merkle, minhash, packing, pieces, repair, secrets, token_files
from cairnlake.session import durable, remove, scratch_path, table


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file on this machine; every executor has the same package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_main_text(table(spark, sf_dir, "pages"))


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(durable(secrets.scan(table(spark, sf_dir, "documents"))))
    of_kind = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == secrets.KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(of_kind, ("assign", "access", "hex")), F.sha2(secrets.listed(F.col("base")), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, vocabulary("byte_bpe_50k.json"))
    found = token_files.token_statistics(token_files.read_token_files(spark, path))  # measured: the files are no longer read
    remove(spark, path)
    return found


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"), least=0.95)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_pieces(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", compression.fold(F.col("doc_id"), 5) == 0)
    return compression.identify_language(docs, compression.learn_languages(docs.where("NOT held_out")))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", compression.fold(F.col("doc_id"), 3) == 1)
    return compression.score_toxicity(docs, compression.learn_toxicity(docs, table(spark, sf_dir, "labels").where(compression.fold(F.col("doc_id"), 3) != 1)))


def op11_lempel_ziv_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lempel_ziv.edited_likeness(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified_proofs(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_damaged(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_html_extraction": op2_html_extraction,
    "op3_secret_scans": op3_secret_scans,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_token_files": op5_token_files,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_embedding_near_dedup": op7_embedding_near_dedup,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_language_id": op9_language_id,
    "op10_toxicity": op10_toxicity,
    "op11_lempel_ziv_fingerprint": op11_lempel_ziv_fingerprint,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_conversation_repair": op13_conversation_repair,
}

_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0} END"
_LEAF = "sha256(concat(" + ", ".join(map(_FIELD.format, ("doc_id", "source", "lang", "n_chars", "{0}"))) + "))"
#: crc32, bit by bit: each character and seven zeros.
_CRC = "(4294967295 - list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, strlen({0}) + 1), lambda i: list_prepend(ascii(substr({0}, i, 1))::BIGINT, [0::BIGINT, 0, 0, 0, 0, 0, 0])))), lambda a, x: xor(xor(a, x) >> 1, CASE WHEN xor(a, x) & 1 = 1 THEN 3988292384 ELSE 0 END)))"

ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": r"""
        WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256, length(coalesce(text, '')) AS size FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size, row_number() OVER w = 1 AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY size DESC, doc_id NULLS LAST)
    """,
    "op12_merkle_manifest": f"""
        WITH RECURSIVE d AS (
            SELECT doc_id, source, {_LEAF.format("text")} AS leaf,
                   CASE WHEN {_CRC.format("doc_id::VARCHAR")} % 5 = 0 THEN {_LEAF.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS other
            FROM documents),
        l AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY source) AS size FROM d),
        t AS (
            SELECT source, 0 AS level, place, leaf AS node, size FROM l
            UNION ALL
            SELECT source, level + 1, place // 16, sha256(string_agg(node, '' ORDER BY place)), (size + 15) // 16 FROM t WHERE size > 1 GROUP BY source, level, place // 16, size),
        r AS (SELECT source, node AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS size FROM t WHERE size = 1),
        u AS (
            SELECT 0 AS level, place, subroot AS node, size FROM r
            UNION ALL
            SELECT level + 1, place // 16, sha256(string_agg(node, '' ORDER BY place)), (size + 15) // 16 FROM u WHERE size > 1 GROUP BY level, place // 16, size),
        n AS (SELECT source, false AS up, * EXCLUDE (source) FROM t UNION ALL SELECT NULL, true, * FROM u),
        f AS (
            SELECT l.doc_id, l.source, l.place AS own, l.leaf, r.subroot, r.place AS top, false AS up, 0 AS level, l.place, l.size, coalesce(l.other, l.leaf) AS folded, '' AS proof
            FROM l JOIN r ON l.source IS NOT DISTINCT FROM r.source
            UNION ALL
            SELECT f.doc_id, f.source, own, f.leaf, subroot, top, f.up OR f.size = 1, CASE WHEN f.size = 1 THEN 0 ELSE f.level + 1 END, CASE WHEN f.size = 1 THEN top ELSE f.place // 16 END,
                   CASE WHEN f.size = 1 THEN (SELECT count(*) FROM r) ELSE (f.size + 15) // 16 END,
                   CASE WHEN f.size = 1 THEN folded ELSE sha256(string_agg(CASE WHEN n.place = f.place THEN folded ELSE n.node END, '' ORDER BY n.place)) END,
                   CASE WHEN f.size = 1 THEN proof ELSE proof || coalesce(string_agg(n.node, '' ORDER BY n.place) FILTER (n.place <> f.place), '') END
            FROM f JOIN n ON n.up = f.up AND (f.up OR n.source IS NOT DISTINCT FROM f.source) AND n.level = f.level AND n.place // 16 = f.place // 16
            WHERE NOT (f.up AND f.size = 1)
            GROUP BY f.doc_id, f.source, own, f.leaf, subroot, top, f.up, f.level, f.place, f.size, folded, proof)
        SELECT doc_id, leaf, subroot, (SELECT node FROM u WHERE size = 1) AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = (SELECT node FROM u WHERE size = 1) AS verified
        FROM f WHERE up AND size = 1
    """,
}
