"""What near-dedup leaves in scratch, and that its setting ends with it."""

from cairnlake.llm import minhash
from cairnlake.session import exists


def test_only_the_signatures_of_classes_stay(spark, monkeypatch):
    held, name = [], "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, real = spark.conf.get(name, "false"), minhash.durable

    def kept(df, *a):
        assert spark.conf.get(name) == "true"
        held.append(real(df, *a))
        return held[-1]

    monkeypatch.setattr(minhash, "durable", kept)
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text), (2, text), (3, text + " more"), (4, "other words of one text"), (5, None)], "doc_id long, text string")
    found = {r["doc_id"]: (r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs, 3, 85).collect()}
    assert found == {1: (1, True), 2: (1, False), 3: (1, False), 4: (4, True), 5: (5, True)}
    assert [t.columns for t in held if "signature" in t.columns and exists(spark, t._scratch)] == [["key", "id", "signature"]]
    assert spark.conf.get(name, "false") == before
