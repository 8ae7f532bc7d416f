"""Pooled measures, admission, places and digests against plain loops."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from cairnlake.operators import streams as S
from cairnlake.operators.admission import admitted, parse_rate
from cairnlake.operators.digests import ordered_digest
from cairnlake.operators.order import laid_out, placed


def one_way(tokens):
    factors, seen, n = 0, set(), 0
    for t in tokens:
        n += 1
        seen.add(t)
        if len(seen) / n <= 0.72:
            factors, seen, n = factors + 1, set(), 0
    if n:
        factors += (1 - len(seen) / n) / (1 - 0.72)
    return len(tokens) / factors if factors else float(len(tokens))


def moving(tokens, wrap):
    lengths = []
    for i in range(len(tokens)):
        rest, seen = (tokens[i:] + tokens[:i] if wrap else tokens[i:]), set()
        for k, t in enumerate(rest, 1):
            seen.add(t)
            if len(seen) / k < 0.72 and k >= 10:
                lengths.append(k)
                break
    return sum(lengths) / len(lengths) if lengths else 0.0


def plain(tokens):
    n, width = len(tokens), min(50, len(tokens))
    ratios = [len(set(tokens[i : i + width])) / width for i in range(n - width + 1)]
    return {
        "n_tokens": n,
        "mtld": (one_way(tokens) + one_way(tokens[::-1])) / 2 if n >= 10 else 0.0,
        "mattr": sum(ratios) / len(ratios),
        "msttr": sum(ratios[:: 50]) / len(ratios[:: 50]) if n >= 50 else ratios[0],
        "mtld_ma_bid": (moving(tokens, False) + moving(tokens[::-1], False)) / 2,
        "mtld_ma_wrap": moving(tokens, True),
    }


def text(kind, n, rng):
    if kind == "distinct":
        return [f"w{i}" for i in range(n)]
    if kind == "mixed":  # long stretches without repeats between dull ones
        return [f"w{i}" if (i // 90) % 2 else rng.choice("abc") for i in range(n)]
    return [f"w{int(rng.paretovariate(0.8))}" for _ in range(n)]


@pytest.mark.parametrize(("kind", "n"), [("words", 700), ("words", 9), ("words", 10), ("words", 49), ("mixed", 500), ("distinct", 130), ("words", 1)])
def test_pooled_measures_equal_loops(spark, kind, n):
    rng = random.Random(n)
    tokens = text(kind, n, rng)
    rows, at = [], 0
    while at < n:
        size = rng.choice([0, 1, 3, 40])
        rows.append((len(rows) // 3, len(rows) % 3, tokens[at : at + size]))
        at += size
    rng.shuffle(rows)
    stream = S.stream_of(spark.createDataFrame(rows, "conv long, turn long, tokens array<string>"), ["conv", "turn"], "tokens")
    want = plain(tokens)
    for block, ahead in ((50, 10), (10_000, 1_000)):
        got = S.pooled_diversity(stream, block, ahead)
        assert got == pytest.approx(want), (block, ahead)


def test_chain_over_many_maps(spark, monkeypatch):
    rng = random.Random(2)
    tokens = text("mixed", 900, rng)
    stream = S.stream_of(spark.createDataFrame([(i, [t]) for i, t in enumerate(tokens)], "i long, tokens array<string>"), ["i"], "tokens")
    rows = S.measured(stream, True, 50, 200)
    assert stream.size / S.factors(stream, rows, 50, fan=3) == pytest.approx(one_way(tokens))


def test_empty_stream(spark):
    stream = S.stream_of(spark.createDataFrame([(1, None), (2, [])], "i long, tokens array<string>"), ["i"], "tokens")
    assert S.pooled_diversity(stream)["mtld"] == 0.0 and S.pooled_diversity(stream)["mattr"] is None


def served(rows, most, seconds):
    out, starts = {}, {}
    for gate, us, i in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2])):
        own = starts.setdefault(gate, [])
        start = max(us, own[-most] + seconds * 1_000_000) if len(own) >= most else us
        own.append(start)
        out[i] = start
    return out


@pytest.mark.parametrize("most", [1, 3, 7])
def test_admission_equals_a_queue(spark, most):
    rng = random.Random(most)
    rows = [(rng.choice(["hot", "hot", "hot", "cold", None]), rng.randrange(3000) * 1_000_000, i) for i in range(600)]
    df = spark.createDataFrame(rows, "gate string, us long, i long").withColumn("ts", F.timestamp_micros("us"))
    got = {r["i"]: (r["start_us"], r["wait_us"]) for r in admitted(df, ["gate"], "ts", ["i"], most, 60).collect()}
    want = served(rows, most, 60)
    assert got == {i: (want[i], want[i] - us) for _, us, i in rows}
    starts = {}
    for gate, _, i in rows:
        starts.setdefault(gate, []).append(got[i][0])
    for own in starts.values():
        own.sort()
        assert all(b - a >= 60_000_000 for a, b in zip(own, own[most:]))


def test_rates():
    assert parse_rate("95/600") == (95, 600.0) and parse_rate("5") == (5, 60.0) and parse_rate(7) == (7, 60.0)
    assert all(parse_rate(v) is None for v in (None, "", "0", "None", " off ", "~", "null"))
    for bad in ("0/5", "3/-1", "x/2"):
        with pytest.raises(ValueError):
            parse_rate(bad)


def test_empty_and_null_arrivals(spark):
    df = spark.createDataFrame([("a", None, 1)], "gate string, ts timestamp, i long")
    assert admitted(df, ["gate"], "ts", ["i"], 2, 5).count() == 0
    assert admitted(df.where("false"), [], "ts", ["i"], 2, 5).count() == 0


def test_places_with_a_hot_group_and_ties(spark):
    rng = random.Random(1)
    rows = [(rng.choice([1, 1, 1, 2, None]), rng.choice([None, 3, 4, 4]), i) for i in range(500)]
    got = placed(spark.createDataFrame(rows, "g long, o long, i long"), ["g"], ["o"]).collect()
    assert sorted((r["g"], r["o"], r["i"]) for r in got if r["g"] and r["o"]) == sorted((g, o, i) for g, o, i in rows if g and o)
    for g in {r[0] for r in rows}:
        own = sorted((r for r in got if r["g"] == g), key=lambda r: r["place"])
        assert [r["place"] for r in own] == list(range(len(own))) and {r["group_size"] for r in own} == {len(own)}
        assert [r["o"] or 0 for r in own] == sorted(r["o"] or 0 for r in own)


def test_running_sums(spark):
    rows = [(i, i % 4) for i in range(100)]
    held, total = laid_out(spark.createDataFrame(rows[::-1], "i long, n long"), ["i"], F.col("n"))
    assert total == sum(n for _, n in rows)
    assert {r["i"]: r["start"] for r in held.collect()} == {i: sum(n for _, n in rows[:i]) for i, _ in rows}


def test_digest_sees_order_values_and_nulls(spark):
    rows = [(i, f"name {i}", [i / 7, -1.0]) for i in range(40)]
    schema = "i long, name string, v array<float>"
    of = lambda held: ordered_digest(spark.createDataFrame(held, schema), ["i"], ["name", "v"], fan=4)
    whole = of(rows)
    assert whole == of(rows[::-1]) and whole[0] == 40
    swapped = [*rows[:5], (5, *rows[6][1:]), (6, *rows[5][1:]), *rows[7:]]
    assert of(swapped)[1] != whole[1]
    assert of([*rows[:5], (5, None, rows[5][2]), *rows[6:]])[1] != of([*rows[:5], (5, "-", rows[5][2]), *rows[6:]])[1]
    assert of(rows[:1])[1] == hashlib.sha256(b"6:name 021:0 -1152921504606846976"[:0] + f"6:name 0{len('0 -1152921504606846976')}:0 -1152921504606846976".encode()).hexdigest()
    assert of([]) == (0, hashlib.sha256(b"").hexdigest())
