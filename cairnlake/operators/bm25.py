"""BM25 as an index of four tables and a probe by term joins."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnlake.functions.text import TOKENIZERS, token_counts
from cairnlake.session import durable, exists

#: Term saturation and length normalisation, and the least idf.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


#: Lengths up to here are kept as they are by :func:`quantised_length`.
EXACT_LENGTH = 24


def quantised_length(dl: Column) -> Column:
    """A length as an index holds it in one byte: exact below 24, beyond that 24 and the rest's four leading bits."""
    rest = F.greatest(dl.cast("long") - EXACT_LENGTH, F.lit(0).cast("long"))
    unit = F.pow(F.lit(2.0), F.greatest(F.length(F.bin(rest)) - 4, F.lit(0))).cast("long")
    return F.when(dl < EXACT_LENGTH, dl.cast("long")).otherwise(EXACT_LENGTH + F.floor(rest / unit).cast("long") * unit)


@dataclass(frozen=True)
class Scorer:
    """Two BM25 rules over one index: the plain one, and ``quantised``, whose lengths are rounded, whose statistics leave out
    documents without tokens, and whose idf ln(1 + (n - df + 0.5) / (df + 0.5)) is never negative."""

    quantised: bool = False

    def corpus(self, index: TextIndex) -> DataFrame:
        if not self.quantised:
            return index.corpus
        own = index.doc_len.where("dl > 0")
        return own.agg(F.count("*").alias("n"), (F.sum("dl") / F.count("*")).alias("avgdl"))

    def norm(self) -> Column:
        """What a document's length comes to; the same for all its terms."""
        dl = quantised_length(F.col("dl")) if self.quantised else F.col("dl")
        return 1 - B + B * dl / F.col("avgdl")

    def part(self, norm: Column | None = None) -> Column:
        return F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (self.norm() if norm is None else norm))

    def idf(self, n: Column, df: Column) -> Column:
        return F.ln(1 + (n - df + 0.5) / (df + 0.5)) if self.quantised else idf(n, df)


PLAIN, QUANTISED = Scorer(), Scorer(True)


@dataclass
class TextIndex:
    """postings (term, doc_id, tf, dl), doc_len (doc_id, dl), term_df (term, df) and corpus (n, avgdl), one row.

    ``by_doc`` (doc_id, dl, terms) holds the postings a row a document, where an index has them so.
    """

    postings: DataFrame
    doc_len: DataFrame
    term_df: DataFrame
    corpus: DataFrame
    tokenizer: str = "unicode61"
    by_doc: DataFrame | None = None

    def of(self, items: DataFrame) -> TextIndex:
        """The postings of the documents that ``items`` (item_id) names; the statistics stay those of all."""
        own = items.select(F.col("item_id").alias("doc_id")).distinct()
        return replace(self, postings=self.postings.join(own, "doc_id", "left_semi"), by_doc=None if self.by_doc is None else self.by_doc.join(own, "doc_id", "left_semi"))

    def parts(self, scorer: Scorer) -> DataFrame:
        """(term, item_id, part) of all postings; lengths are worked out once a document."""
        held = (self.by_doc if self.by_doc is not None else self.postings).withColumnRenamed("doc_id", "item_id")
        normed = held.crossJoin(F.broadcast(scorer.corpus(self))).withColumn("norm", scorer.norm())
        if self.by_doc is not None:
            normed = normed.select("item_id", "norm", F.explode("terms").alias("t")).select("t.term", "item_id", "t.tf", "norm")
        return normed.select("term", "item_id", scorer.part(F.col("norm")).alias("part"))


def _tokens(docs: DataFrame, tokenizer: str) -> DataFrame:
    if tokenizer not in TOKENIZERS:
        raise ValueError(f"no tokenizer is called {tokenizer!r}; there are {', '.join(TOKENIZERS)}")
    return docs.select("doc_id", TOKENIZERS[tokenizer](F.col("text")).alias("tokens"))


def _counted(tokens: DataFrame) -> DataFrame:
    """(doc_id, dl, terms) of (doc_id, tokens): the number of tokens, and term and tf of each different one."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, sizes, words, row, word, tf in token_counts(batch.column(1)):
                pairs = pa.StructArray.from_arrays([words.take(pa.array(word)), pa.array(tf)], ["term", "tf"])
                starts = pa.array(np.searchsorted(row, np.arange(len(sizes) + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(sizes)), pa.array(sizes), pa.ListArray.from_arrays(starts, pairs)], ["doc_id", "dl", "terms"])

    return tokens.mapInArrow(count, f"doc_id {tokens.schema['doc_id'].dataType.simpleString()}, dl long, terms array<struct<term string, tf long>>")


def vocabulary(docs: DataFrame, tokenizer: Callable[[Column], Column]) -> DataFrame:
    """(term, docs, occurrences) of (doc_id, text): documents that hold a term and its number in all; rows of one doc_id are one document.

    Texts are dealt by doc_id, and a task adds up a part of its documents before it passes a row for each term on.
    ``tokenizer`` must part words at line ends.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, words, _, word, tf in token_counts(batch.column(0)):
                sums = np.bincount(word, tf, len(words)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([words, pa.array(np.bincount(word, minlength=len(words))), pa.array(sums)], ["term", "docs", "occurrences"])

    tokens = docs.groupBy("doc_id").agg(F.array_join(F.collect_list("text"), "\n").alias("text")).select(tokenizer(F.col("text")).alias("tokens"))
    return tokens.mapInArrow(count, "term string, docs long, occurrences long").groupBy("term").agg(F.sum("docs").alias("docs"), F.sum("occurrences").alias("occurrences"))


def doc_lengths(docs: DataFrame, tokenizer: str = "unicode61") -> DataFrame:
    return _tokens(docs, tokenizer).select("doc_id", F.size("tokens").cast("long").alias("dl"))


def document_frequencies(docs: DataFrame, tokenizer: str = "unicode61") -> DataFrame:
    """(term, df): distinct terms are taken inside each document, so only counts are shuffled."""
    return _tokens(docs, tokenizer).select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def build_index(docs: DataFrame, tokenizer: str = "unicode61") -> TextIndex:
    """Index (doc_id, text); null texts have no tokens and count as documents. doc_id is unique.

    Texts are dealt by doc_id and tokenized once; the equal tokens of a document are counted where it lies, so that no posting
    is shuffled. That table, a row a document, is written; the other tables are read from it.
    """
    counted = durable(_counted(_tokens(docs.select("doc_id", "text").repartition("doc_id"), tokenizer)))
    doc_len = counted.select("doc_id", "dl")
    postings = counted.select("doc_id", "dl", F.explode("terms").alias("t")).select("t.term", "doc_id", "t.tf", "dl")
    doc_len._scratch = postings._scratch = counted._scratch
    term_df = postings.groupBy("term").agg(F.count("*").alias("df"))
    corpus = doc_len.agg(F.count("*").alias("n"), (F.sum("dl") / F.count("*")).alias("avgdl"))
    return TextIndex(postings, doc_len, term_df, corpus, tokenizer, counted)


_OPEN: dict[tuple[object, ...], TextIndex] = {}


def opened_index(docs: DataFrame, source: str, tokenizer: str = "unicode61") -> TextIndex:
    """The index of ``docs`` (doc_id, text), the table at ``source``: built on first use, then the written one again.

    An application builds it anew when the table's files have changed in number, size or time, or when its scratch folder has
    been cleared.
    """
    spark = docs.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(source)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    held = files.getContentSummary(place)
    key = (spark.sparkContext.applicationId, source, tokenizer, held.getLength(), held.getFileCount(), files.getFileStatus(place).getModificationTime())
    index = _OPEN.get(key)
    if index is None or not all(exists(spark, t._scratch) for t in (index.postings, index.doc_len)):
        _OPEN[key] = index = build_index(docs, tokenizer)
    return index


def query_terms(queries: DataFrame, tokenizer: str = "unicode61") -> DataFrame:
    """(query_id, term, qtf) of (query_id, text); a repeated token counts each time."""
    return queries.select("query_id", F.explode(TOKENIZERS[tokenizer](F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def idf(n: Column, df: Column) -> Column:
    value = F.ln((n - df + 0.5) / (df + 0.5))
    return F.when(value <= 0, F.lit(LEAST_IDF)).otherwise(value)


def scores(index: TextIndex, queries: DataFrame, candidates: DataFrame | None = None, scorer: Scorer = PLAIN) -> DataFrame:
    """(query_id, item_id, bm25_raw) of the documents that hold a query term; of ``candidates`` (query_id, item_id) only, if given.

    Statistics are those of the whole corpus either way. Candidates meet the terms of their query first and then the
    postings by document and term, so that a common term gathers nothing. Without candidates postings are cut to
    the queries' terms, and a document's scores are added up where its matches lie.
    """
    terms = query_terms(queries, index.tokenizer)
    terms = terms.join(index.term_df.join(terms.select("term").distinct(), "term", "left_semi"), "term")
    postings = index.postings.withColumnRenamed("doc_id", "item_id")
    if candidates is not None:
        hits = candidates.select("query_id", "item_id").join(terms, "query_id").join(postings, ["item_id", "term"])
    else:
        hits = postings.join(terms, "term").repartition("item_id")
    placed = hits.crossJoin(F.broadcast(scorer.corpus(index)))
    return placed.groupBy("query_id", "item_id").agg(F.sum(F.col("qtf") * scorer.idf(F.col("n"), F.col("df")) * scorer.part()).alias("bm25_raw"))


def top_k(index: TextIndex, queries: DataFrame, k: int, scorer: Scorer = PLAIN, slack: float = 1e-6) -> DataFrame:
    """(query_id, item_id, bm25_raw) of documents that hold all of each query's ``k`` best, as :func:`scores` would give them.

    A term adds at most its greatest part over all documents. Sums over a query's rarest terms name ``k`` documents, whose whole
    scores give one that ``k`` documents reach; the terms whose greatest parts together stay below half of it can't lift a document
    there alone, and only few documents have the other half. So only documents with one of the other terms are gathered, only those whose sum may still reach the ``k``-th are
    kept, and the common terms are looked up for these alone. Nothing is skipped that could be among the best or tie with
    them (``slack`` is more than the rounding of scores).
    """
    words = query_terms(queries, index.tokenizer)
    own = durable(index.parts(scorer).join(words.select("term").distinct(), "term", "left_semi"))
    known = own.groupBy("term").agg(F.count("*").alias("df"), F.max("part").alias("most")).crossJoin(F.broadcast(scorer.corpus(index).select("n")))
    weight = F.col("qtf") * scorer.idf(F.col("n"), F.col("df"))
    terms = words.join(known, "term").select("query_id", "term", "df", weight.alias("weight"), (weight * F.col("most")).alias("bound"))
    rare = Window.partitionBy("query_id").orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1)
    terms = durable(terms.withColumn("seed", F.coalesce(F.sum("df").over(rare), F.lit(0)) < 50 * k))

    def sums(chosen: DataFrame) -> DataFrame:
        hits = own.join(chosen.select("query_id", "term", "weight"), "term")
        return hits.groupBy("query_id", "item_id").agg(F.sum(F.col("weight") * F.col("part")).alias("s"))

    def leading(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.col("s").desc(), "item_id")
        return found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)

    def reached(found: DataFrame) -> DataFrame:
        """The score that ``k`` documents of a query have at least; queries with fewer have none."""
        return leading(found).where(F.col("r") == k).select("query_id", F.col("s").alias("reached"))

    def completed(some: DataFrame, chosen: DataFrame) -> DataFrame:
        """(query_id, item_id, more): what the terms of ``chosen`` add to the documents of ``some``; those without one have no row."""
        postings = own.join(some.select("item_id").distinct(), "item_id", "left_semi")
        common = some.select("query_id", "item_id").join(chosen.select("query_id", "term", "weight"), "query_id").join(postings, ["item_id", "term"])
        return common.groupBy("query_id", "item_id").agg(F.sum(F.col("weight") * F.col("part")).alias("more"))

    seeds = durable(leading(sums(terms.where("seed"))))
    first = reached(completed(seeds, terms).withColumnRenamed("more", "s"))
    low = terms.join(first, "query_id", "left")
    light = Window.partitionBy("query_id").orderBy("bound", "term")
    split = durable(low.withColumn("needed", F.sum("bound").over(light) >= F.coalesce("reached", F.lit(0.0)) / 2 - slack))
    rest = split.groupBy("query_id").agg(F.coalesce(F.sum(F.when(~F.col("needed"), F.col("bound"))), F.lit(0.0)).alias("rest"), F.coalesce(F.first("reached"), F.lit(0.0)).alias("reached"))
    found = durable(sums(split.where("needed")))
    better = reached(found).withColumnRenamed("reached", "better")
    least = F.greatest(F.col("reached"), F.coalesce("better", F.lit(0.0))) - slack
    alive = durable(found.join(rest, "query_id").join(better, "query_id", "left").where(F.col("s") + F.col("rest") >= least).select("query_id", "item_id", "s"))
    more = completed(alive, split.where("NOT needed"))
    return alive.join(more, ["query_id", "item_id"], "left").select("query_id", "item_id", (F.col("s") + F.coalesce("more", F.lit(0.0))).alias("bm25_raw"))


def scaled(hits: DataFrame) -> DataFrame:
    """``hits`` with bm25_norm: least to greatest of the query's hits as 0 to 1; a lone hit and equal hits have 0."""
    query = Window.partitionBy("query_id")
    low, high = F.min("bm25_raw").over(query), F.max("bm25_raw").over(query)
    return hits.withColumns({"__low": low, "__high": high}).withColumn("bm25_norm", F.when(F.col("__high") == F.col("__low"), F.lit(0.0)).otherwise((F.col("bm25_raw") - F.col("__low")) / (F.col("__high") - F.col("__low")))).drop("__low", "__high")


def best(hits: DataFrame, k: int) -> DataFrame:
    """The ``k`` best hits of each query by the score to eight places, ties by item_id, with their rank."""
    order = Window.partitionBy("query_id").orderBy(F.round("bm25_raw", 8).desc(), "item_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
