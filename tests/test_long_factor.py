"""MTLD of a text whose factor never ends."""

import pytest
from pyspark.sql import functions as F

from cairnlake.operators.diversity import mtld


def test_a_long_factor_takes_no_copy_of_its_types_for_each_token(spark):
    long = [f"w{i}" for i in range(50_000)]
    rows = [(1, long), (2, long[:9]), (3, []), (4, None), (5, ["a"] * 12)]
    held = spark.createDataFrame(rows, "i int, t array<string>").select("i", mtld(F.col("t")).alias("m"))
    assert "array_append" not in held._jdf.queryExecution().optimizedPlan().toString()
    found = {r["i"]: r["m"] for r in held.collect()}
    assert found[1] == 50_000 and found[2] == found[3] == 0.0 and found[4] is None
    assert found[5] == pytest.approx(2.0)  # a factor of two tokens each time
