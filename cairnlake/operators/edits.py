"""Title lookup by words within a few edits: an index of deletions finds the words, BM25 over them the title.

Two words within k edits (insertions, deletions, replacements and swaps of neighbours) have a common form after at most k
deletions each, so words meet on those forms, and a banded check decides.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from cairnlake.operators.bm25 import B, K1, QUANTISED, TextIndex, query_terms, quantised_length
from cairnlake.session import durable

#: Most words that a query's word is widened to.
EXPANSIONS = 50


def edits_allowed(word: Column) -> Column:
    """0 under three characters, 1 under six, else 2."""
    size = F.char_length(word)
    return F.when(size < 3, 0).when(size < 6, 1).otherwise(2)


def _without_one(word: Column) -> Column:
    n = F.char_length(word)
    cut = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, n)))
    return F.when(n > 0, cut).otherwise(F.array().cast("array<string>"))


def forms(word: Column, edits: Column) -> Column:
    """The word after up to ``edits`` (0, 1 or 2) deletions, each form once."""
    one = F.when(edits > 0, _without_one(word)).otherwise(F.array().cast("array<string>"))
    two = F.when(edits > 1, F.flatten(F.transform(one, _without_one))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(word), one, two))


@F.pandas_udf(IntegerType())
def edit_distance(a: pd.Series, b: pd.Series, most: pd.Series) -> pd.Series:
    """Edits from one word to the other where no part is edited twice; ``most`` + 1 if there are more."""

    def distance(x: str, y: str, k: int) -> int:
        far = k + 1
        if abs(len(x) - len(y)) > k:
            return far
        rows: list[dict[int, int]] = [{j: j for j in range(min(len(y), k) + 1)}]
        for i, c in enumerate(x, 1):
            row: dict[int, int] = {}
            for j in range(max(0, i - k), min(len(y), i + k) + 1):
                best = rows[-1].get(j, far) + 1
                if j:
                    best = min(best, row.get(j - 1, far) + 1, rows[-1].get(j - 1, far) + (c != y[j - 1]))
                    if i > 1 and j > 1 and c == y[j - 2] and x[i - 2] == y[j - 1]:
                        best = min(best, rows[-2].get(j - 2, far) + 1)
                row[j] = min(best, far)
            rows = [rows[-1], row]
        return rows[-1].get(len(y), far)

    return pd.Series([distance(x, y, k) for x, y, k in zip(a, b, most, strict=True)], dtype="int32")


def near_words(asked: DataFrame, words: DataFrame) -> DataFrame:
    """(word, term, edits) of all pairs of ``asked`` (word) and ``words`` (term), each distinct, within the edits the asked word allows.

    A word that allows k edits meets the forms of terms whose length differs by k at most; terms are expanded for each k > 0
    only where some word of such a length can ask for it.
    """
    want = asked.select("word", edits_allowed(F.col("word")).alias("k"))
    want = want.select("word", "k", F.explode(forms(F.col("word"), F.col("k"))).alias("form"))
    size = F.char_length("term")
    kinds = F.filter(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda k: (k == 0) | ((k == 1) & size.between(2, 6)) | ((k == 2) & (size >= 4)))
    have = words.select("term", F.explode(kinds).alias("k")).select("term", "k", F.explode(forms(F.col("term"), F.col("k"))).alias("form"))
    met = want.join(have, ["k", "form"]).where(F.abs(F.char_length("word") - F.char_length("term")) <= F.col("k")).select("word", "term", "k").distinct()
    return met.withColumn("edits", edit_distance("word", "term", "k")).where(F.col("edits") <= F.col("k")).select("word", "term", "edits")


def title_scores(index: TextIndex, lookups: DataFrame) -> DataFrame:
    """(query_id, item_id, score) of every title with a word within the edits of a word of the lookup (query_id, text).

    A word is widened to its ``EXPANSIONS`` nearest terms, nearest by 1 - edits / shorter length, then by term; that number
    is each term's weight, and all share the greatest document frequency among them. Scores are BM25 with quantised lengths,
    summed over the lookup's words, repeated ones each time. Lookups without words and terms out of reach give no row.
    """
    asked = query_terms(lookups, index.tokenizer).withColumnRenamed("term", "word")
    found = near_words(asked.select("word").distinct(), index.term_df.select("term"))
    weight = 1 - F.col("edits") / F.least(F.char_length("term"), F.char_length("word"))
    ranked = found.withColumn("weight", weight).withColumn("r", F.row_number().over(Window.partitionBy("word").orderBy(F.col("weight").desc(), "term"))).where(F.col("r") <= EXPANSIONS)
    shared = ranked.join(index.term_df, "term").withColumn("df", F.max("df").over(Window.partitionBy("word"))).select("word", "term", "weight", "df")
    wide = durable(asked.join(shared, "word"))
    hits = index.postings.withColumnRenamed("doc_id", "item_id").join(wide, "term").crossJoin(F.broadcast(QUANTISED.corpus(index)))
    part = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * quantised_length(F.col("dl")) / F.col("avgdl")))
    return hits.groupBy("query_id", "item_id").agg(F.sum(F.col("qtf") * F.col("weight") * QUANTISED.idf(F.col("n"), F.col("df")) * part).alias("score"))


def best_title(index: TextIndex, lookups: DataFrame, digits: int = 8) -> DataFrame:
    """(query_id, item_id, score) of each lookup's best title; ties go to the lower item. Lookups of equal text share a search."""
    order = Window.partitionBy("query_id").orderBy(F.round("score", digits).desc(), "item_id")
    asked = durable(lookups.groupBy("text").agg(F.min("query_id").alias("query_id")))
    best = title_scores(index, asked).withColumn("r", F.row_number().over(order)).where("r = 1").select(F.col("query_id").alias("__asked"), "item_id", "score")
    own = lookups.select("query_id", "text").join(asked.withColumnRenamed("query_id", "__asked"), "text")
    return own.join(best, "__asked").select("query_id", "item_id", "score")
