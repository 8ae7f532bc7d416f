"""Tokens counted where their document lies, against plain loops."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from cairnlake.functions.text import category_tokens, token_counts
from cairnlake.operators import bm25

TEXTS = ["a b a c", None, "", "b", "a " * 50 + "é", "?!", "c c b a"]


def loop(text):
    return Counter((text or "").split()) if text != "?!" else Counter()


@pytest.mark.parametrize("most", [1, 3, 1 << 20])
def test_parts_of_any_size_count_the_same(most):
    arrays = [["x", "y", "x"], [], None, ["y"], ["x"] * 7, [], ["z", "y"]]
    found, sizes = {}, {}
    for at, n, words, row, word, number in token_counts(pa.array(arrays, pa.list_(pa.string())), most):
        sizes |= {at + i: int(k) for i, k in enumerate(n)}
        for i, w, k in zip(row, word, number, strict=True):
            found.setdefault(at + int(i), {})[words[int(w)].as_py()] = int(k)
        assert (np.diff(row) >= 0).all()
    assert found == {i: dict(Counter(a)) for i, a in enumerate(arrays) if a}
    assert sizes == {i: len(a or []) for i, a in enumerate(arrays)}


def test_index_is_written_once_and_shuffles_no_posting(spark, monkeypatch):
    plans = []
    real = bm25.durable
    monkeypatch.setattr(bm25, "durable", lambda df, *a: (plans.append(df._jdf.queryExecution().executedPlan().toString()), real(df, *a))[1])
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    index = bm25.build_index(docs)
    assert len(plans) == 1 and plans[0].count("hashpartitioning") == 1 and "hashpartitioning(doc_id" in plans[0]
    want = {(w, i): (k, sum(loop(t).values())) for i, t in enumerate(TEXTS) for w, k in loop(t).items()}
    assert {(r["term"], r["doc_id"]): (r["tf"], r["dl"]) for r in index.postings.collect()} == want
    assert dict(index.doc_len.collect()) == {i: sum(loop(t).values()) for i, t in enumerate(TEXTS)}
    assert dict(index.term_df.collect()) == Counter(w for w, _ in want)


def test_best_documents_read_the_postings_once(spark, monkeypatch):
    plans = []
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    index = bm25.build_index(docs)
    real, name = bm25.durable, index.postings._scratch.rsplit("/", 1)[-1]
    monkeypatch.setattr(bm25, "durable", lambda df, *a: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), real(df, *a))[1])
    queries = spark.createDataFrame([(1, "a c"), (2, "b"), (3, "")], "query_id long, text string")
    found = {(r[0], r[1]): r[2] for r in bm25.top_k(index, queries, 10).collect()}
    assert found == pytest.approx({(r[0], r[1]): r[2] for r in bm25.scores(index, queries).collect()})
    assert name and sum("explode(terms" in p for p in plans) == 1


def test_vocabulary_counts_each_document_once(spark):
    rows = [(1, "a_b A_B c"), (1, "c"), (2, "c d"), (3, None), (4, ""), (5, "Σοφός c")]
    found = bm25.vocabulary(spark.createDataFrame(rows, "doc_id long, text string"), category_tokens)
    assert {r["term"]: (r["docs"], r["occurrences"]) for r in found.collect()} == {"a_b": (1, 2), "c": (3, 4), "d": (1, 1), "σοφός": (1, 1)}
    assert not bm25.vocabulary(spark.createDataFrame([], "doc_id long, text string"), category_tokens).collect()


def test_digest_of_the_vocabulary_shuffles_no_pair_of_term_and_document(spark, sf, monkeypatch):
    from cairnlake.plans import corpora

    plans = []
    monkeypatch.setattr(corpora, "ordered_digest", lambda df, *a: (plans.append(df._jdf.queryExecution().executedPlan().toString()), (0, ""))[1])
    corpora.index_digest(spark, sf)
    assert sum("hashpartitioning(term" in p for p in plans) == 1
    assert not any(re.search(r"hashpartitioning\(term#\d+, doc_id", p) for p in plans)


def test_quantised_best_documents_read_the_postings_once(spark, monkeypatch):
    plans = []
    index = bm25.build_index(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"))
    real = bm25.durable
    monkeypatch.setattr(bm25, "durable", lambda df, *a: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), real(df, *a))[1])
    queries = spark.createDataFrame([(1, "a c"), (2, "b")], "query_id long, text string")
    found = {(r[0], r[1]): r[2] for r in bm25.top_k(index, queries, 10, bm25.QUANTISED).collect()}
    assert found == pytest.approx({(r[0], r[1]): r[2] for r in bm25.scores(index, queries, scorer=bm25.QUANTISED).collect()})
    assert sum("explode(terms" in p for p in plans) == 1


def test_whole_scores_of_the_first_documents_bound_the_search(spark, monkeypatch):
    """One document holds all terms of a query and 1,200 others hold one each: by the score of the rarest alone most of them would be gathered."""
    names = [f"m{i:02}" for i in range(20)]
    rows = [(0, " ".join(["r", *names]))] + [(1 + i, " ".join([names[i % 20], *(f"z{i}n{j}" for j in range(20))])) for i in range(1200)]
    index = bm25.build_index(spark.createDataFrame(rows, "doc_id long, text string"))
    queries = spark.createDataFrame([(1, rows[0][1])], "query_id long, text string")
    gathered, real = [], bm25.durable
    monkeypatch.setattr(bm25, "durable", lambda df, *a: (gathered.append((df.columns, df.count())), real(df, *a))[1])
    found = bm25.best(bm25.top_k(index, queries, 1, bm25.QUANTISED), 1).collect()
    assert [(r["item_id"], round(r["bm25_raw"], 6)) for r in found] == [(r["item_id"], round(r["bm25_raw"], 6)) for r in bm25.best(bm25.scores(index, queries, scorer=bm25.QUANTISED), 1).collect()]
    assert next(n for columns, n in gathered if columns == ["query_id", "item_id", "s"]) < 750
