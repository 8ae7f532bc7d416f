"""Phrase fingerprints against a plain LZ78 parse, and the order of neighbours against a sorted list."""

import hashlib
import random

import numpy as np

from cairnlake.llm import lempel_ziv as L


def plain_phrases(text, most=L.MOST_PHRASES):
    """All phrases of a text, character by character."""
    seen, out, phrase = set(), set(), ""
    for c in text:
        phrase += c
        if phrase not in seen:
            seen.add(phrase)
            out.add(phrase)
            if len(seen) >= most:
                seen.clear()
            phrase = ""
    return out


def texts():
    rng = random.Random(4)
    yield from ("", "a", "aa", "aaa", "abab" * 50, "a" * 3000, "é😀" * 40)
    for n in (5, 60, 700, 5000):
        yield "".join(rng.choice("ab c") for _ in range(n))
        yield " ".join(rng.choice(["the", "of", "lamp", "été", "語言"]) for _ in range(n))


def test_parse_equals_a_plain_one():
    for text in texts():
        for most in (L.MOST_PHRASES, 7):
            ends, rest = L.parse(text, 0, len(text), set(), most)
            got = {text[a:b] for a, b in zip([0, *ends], ends)}
            assert got == plain_phrases(text, most)
            assert rest == (ends[-1] if ends else 0) or rest == len(text)


def test_hashes_depend_on_phrases_alone(monkeypatch):
    for text in texts():
        bounds = L._bounds(0, L.parse(text, 0, len(text), set())[0])
        one = lambda p: int(L._hashes(p, *L._bounds(0, [len(p)]))[0])
        assert L.signature(text).tolist() == sorted(map(one, plain_phrases(text)))[: L.SIGNATURE]
        whole = L._hashes(text, *bounds)
        monkeypatch.setattr(L, "SPAN", 64)
        assert (L._hashes(text, *bounds) == whole).all()
        monkeypatch.undo()
        assert (L.read(L.spelled(L.signature(text))) == L.signature(text)).all()


def test_both_signatures_equal_two_parses():
    all_texts = list(texts())
    for text, other in zip(all_texts, [*all_texts[1:], all_texts[0]]):
        half = len(text) // 2
        own, edited = L.both_signatures(text, other[:half])
        assert (own == L.signature(text)).all()
        assert (edited == L.signature(text[: len(text) - half] + other[:half])).all()


def test_likeness_is_exact_for_small_sets_and_close_for_large_ones():
    rng = np.random.default_rng(1)
    a, b = np.arange(40, dtype=np.uint64), np.arange(20, 60, dtype=np.uint64)
    assert L.likeness(a, b) == 20 / 60 and L.likeness(a, a) == 1 and L.likeness(a, a[:0]) == 0 and L.likeness(a[:0], a[:0]) == 1
    errors = []
    for _ in range(50):
        pool = rng.integers(0, 1 << 40, 9000, dtype=np.uint64)
        x, y = np.unique(pool[:6000]), np.unique(pool[3000:])
        errors.append(L.likeness(x[: L.SIGNATURE], y[: L.SIGNATURE]) - 1 / 3)
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.06


def brute(rows):
    """rows: (doc_id, text); each beside the next lower id, texts of one id in any order."""
    held = sorted(((d, "" if t is None else t) for d, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for (doc, text), (_, following) in zip(held, [*held[1:], held[0]]):
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        own, other, after = L.signature(text), L.signature(edited), L.signature(following)
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), L.spelled(own), L.spelled(other), L.likeness(own, other), L.likeness(own, after)))
    return sorted(out, key=str)


def test_whole_table(spark, sf):
    import __spark_entry__ as entry

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    got = entry.queries()["op11_lempel_ziv_fingerprint"](spark, sf).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute([tuple(r) for r in docs.collect()])
    assert np.mean([r["near_edited"] > r["near_next"] for r in got]) > 0.85
    assert all((L.read(r["fingerprint"]) == L.read(r["fingerprint"])).all() for r in got[:5])


def test_odd_tables(spark):
    schema = "doc_id long, text string, lang string, bucket long, extra boolean"
    frame = lambda rows: spark.createDataFrame([(d, t, "x", 7, True) for d, t in rows], schema)
    assert L.edited_likeness(frame([])).collect() == []
    for rows in ([(3, "a lone row")], [(None, None), (4, ""), (5, "one two three"), (-9, "x" * 300_000)], [(1, "same")] * 9, [(None, "same")] * 9, [(i, f"text {i} of many") for i in range(40)]):
        got = sorted((tuple(r) for r in L.edited_likeness(frame(rows)).collect()), key=str)
        assert got == brute(rows)


def test_ties_of_ids_go_by_hash(spark):
    rows = [(1, f"text {i}") for i in range(7)] + [(None, f"none {i}") for i in range(30)] + [(2, "two")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    order = [r["text"] for r in df.selectExpr("doc_id", "text", "xxhash64(text) AS h").orderBy("doc_id", "h").orderBy(df.doc_id.desc_nulls_last(), "h").collect()]
    want = {hashlib.sha256((a[: len(a) - len(a) // 2] + b[: len(a) // 2]).encode()).hexdigest() for a, b in zip(order, [*order[1:], order[0]])}
    assert {r["edited_sha256"] for r in L.edited_likeness(df).collect()} == want


def test_plain_fingerprints(spark):
    df = spark.createDataFrame([(1, "abc abc"), (2, None), (3, "abc abc")], "doc_id long, text string")
    got = {r["doc_id"]: r["fingerprint"] for r in L.fingerprints(df).collect()}
    assert got[1] == got[3] == L.spelled(L.signature("abc abc")) and got[2] == ""
