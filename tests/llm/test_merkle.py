"""The Merkle manifest against a plain tree, source by source."""

import hashlib
import zlib

from cairnlake.llm import merkle as M

H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()
FIELD = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def tree(nodes):
    """All levels, up to the one node that remains."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def siblings(levels, place):
    """(left, right) of each level but the last."""
    for level in levels[:-1]:
        start = place - place % 16
        yield level[start:place], level[place + 1 : start + 16]
        place //= 16


def brute(rows):
    leaf = lambda d, t, la, s, n: H(*map(FIELD, (d, s, la, n, t)))
    by_source = {}
    for row in rows:
        by_source.setdefault(row[3], []).append((row[0], leaf(*row), row))
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    for own in by_source.values():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = {s: tree([x[1] for x in by_source[s]]) for s in names}
    top = tree([trees[s][-1][0] for s in names])
    out = []
    for at, s in enumerate(names):
        for place, (doc, digest, (d, t, *rest)) in enumerate(by_source[s]):
            path = [*siblings(trees[s], place), *siblings(top, at)]
            hit = d is not None and zlib.crc32(str(d).encode()) % 5 == 0 and t is not None
            folded = leaf(d, "".join(c.lower() if "A" <= c <= "Z" else c for c in t), *rest) if hit else digest
            for left, right in path:
                folded = H(*left, folded, *right)
            out.append((doc, digest, trees[s][-1][0], top[-1][0], H(*(x for left, right in path for x in (*left, *right))), folded, folded == top[-1][0]))
    return sorted(out, key=str)


def check(spark, rows):
    got = sorted((tuple(r) for r in M.verified_proofs(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == brute(rows)


def test_whole_table(spark, sf, duck):
    import __spark_entry__ as entry

    from tests.conftest import same

    same(entry.queries()["op12_merkle_manifest"](spark, sf), duck, entry.oracle_sql()["op12_merkle_manifest"])
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    got = entry.queries()["op12_merkle_manifest"](spark, sf).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)
    assert 0 < sum(not r["verified"] for r in got) < len(got)


def test_sizes_around_the_fan(spark):
    """Sources of 1, 16, 17, 257 and 300 leaves, null and odd names, and 19 sources in all."""
    sizes = {None: 17, "": 16, "é": 1, "Z": 257, "z": 300, "-": 2, **{f"s{i}": 1 for i in range(13)}}
    rows, n = [], 0
    for s, count in sizes.items():
        for _ in range(count):
            rows.append((n * 7 % 1009, f"Text {n} É ß" if n % 11 else None, None if n % 5 == 0 else "en", s, n if n % 3 else None))
            n += 1
    check(spark, rows)


def test_shuffled_lookup_of_large_levels(spark, monkeypatch):
    monkeypatch.setattr(M, "BROADCAST_NODES", 3)
    check(spark, [(i, f"Text {i}", "en", f"s{i % 5}" if i % 3 else "s0", i) for i in range(700)])


def test_odd_rows(spark):
    check(spark, [(1, "A", "en", "x", 1)])
    check(spark, [(5, None, None, None, None), (None, "B", "en", None, 1), (None, "B", "en", None, 1), (7, "", "", "", 0), (7, "", "", "", 0), (8, "Q" * 200_000, "en", "", 3)])
    check(spark, [(3, "Same.", "en", "x", 5)] * 40)


def test_empty_table_and_clashing_columns(spark):
    assert M.verified_proofs(spark.createDataFrame([], SCHEMA)).collect() == []
    df = spark.createDataFrame([(i, f"T{i}", "en", "x", i, "a", 1, 2, 3, "n", "l") for i in range(3)], SCHEMA + ", tree string, place long, size long, run long, node string, leaf string")
    assert sorted(tuple(r) for r in M.verified_proofs(df).collect()) == brute([(i, f"T{i}", "en", "x", i) for i in range(3)])
