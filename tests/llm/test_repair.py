"""Conversation repair against exhaustive search and against a plain loop over whole conversations."""

import hashlib
import itertools
import re
import zlib

from cairnlake.llm import repair as R

BLANK = " \t\n\x0b\x0c\r"
GRAMMAR = re.compile(r"(s?(ua)+)?\Z")


def exhaustive(pattern, most_inserts=4):
    """Least (cost, edits) over all edit strings of few insertions, each checked by spelling out its roles."""
    best = None
    for inserts in range(most_inserts + 1):
        for edits in itertools.product("DIKR", repeat=len(pattern) + inserts):
            if edits.count("I") != inserts:
                continue
            choices, cost, i = [], 0, 0
            for e in edits:
                if e == "I":
                    choices.append("ua")
                    cost += 5
                    continue
                row = pattern[i]
                i += 1
                if e == "D":
                    cost += 2
                elif row == "d":
                    break
                else:
                    cost += (e == "R") + 5 * row.isupper()
                    choices.append("ua" if e == "R" else row.lower() if row.lower() in "sua" else "x")
            else:
                if any(GRAMMAR.match("".join(c)) for c in itertools.product(*choices)):
                    best = min(best or (cost, "".join(edits)), (cost, "".join(edits)))
    return best


def test_search_equals_all_edit_strings():
    for n in range(4):
        for pattern in map("".join, itertools.product("suaodSUA", repeat=n)):
            ((_, cost, edits),) = R.search(pattern, 0, True)
            assert (cost, edits) == exhaustive(pattern, 3 if n < 3 else 2), pattern


def test_pieces_give_the_way_of_the_whole():
    import random

    rng = random.Random(3)
    for _ in range(300):
        pattern = "".join(rng.choice("suaaudoUAS") for _ in range(rng.randrange(1, 40)))
        cuts = sorted(rng.sample(range(len(pattern) + 1), min(len(pattern), rng.randrange(0, 6))))
        parts = [pattern[a:b] for a, b in zip([0, *cuts], [*cuts, len(pattern)])]
        mats = [R.matrix(p) for p in parts]
        whole = mats[0]
        for m in mats[1:]:
            whole = R.compose(whole, m)
        _, _, end = min((whole[0][t] + 5 * len(R.CLOSING[t]), whole[1][t], t) for t in range(4))
        half = len(parts) // 2  # any bracketing gives the same matrix
        if half:
            left, right = mats[0], mats[half]
            for m in mats[1:half]:
                left = R.compose(left, m)
            for m in mats[half + 1 :]:
                right = R.compose(right, m)
            assert R.compose(left, right) == whole
        states = R.route(mats, 0, end)
        got = "".join(e for p, a, b in zip(parts, states, states[1:]) for s, _, e in R.search(p, a, False) if s == b) + R.CLOSING[end]
        ((_, cost, edits),) = R.search(pattern, 0, True)
        assert got == edits and whole[0][end] + 5 * len(R.CLOSING[end]) == cost


def by_steps(pattern):
    """Least (cost, edits) row by row; insertions before every row and at the end."""
    following = {0: 2, 1: 2, 2: 3, 3: 2}

    def grow(ways):
        best = dict(ways)
        for state, (cost, edits) in ways.items():
            for k in range(1, 4):
                state = following[state]
                way = (cost + 5 * k, edits + "I" * k)
                best[state] = min(best.get(state, way), way)
        return best

    ways = {0: (0, "")}
    for row in pattern:
        after = {}
        for state, (cost, edits) in grow(ways).items():
            options = [(2, "D", state)]
            if row != "d":
                extra = 5 * row.isupper()
                options += [(extra, "K", t) for t, ok in ((1, row in "sS" and state == 0), (2, row in "uU" and state != 2), (3, row in "aA" and state == 2)) if ok]
                options.append((1 + extra, "R", 3 if state == 2 else 2))
            for c, e, t in options:
                after[t] = min(after.get(t, (cost + c, edits + e)), (cost + c, edits + e))
        ways = after
    ways = grow(ways)
    return min(ways[s] for s in (0, 3) if s in ways)


def brute(lines):
    """The contract, conversation by conversation; lines: (conv_id, turn, role, text)."""
    held = {}
    for conv, turn, role, text in lines:
        rows = held.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        rows += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv, rows in held.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, pattern, counts = set(), "", {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in rows:
            body = text.strip(BLANK)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
            if fault:
                counts[fault] += 1
            letter = role[:1] if role[:1] and role[:1] in "sua" else "o"
            pattern += "d" if fault in ("blank", "duplicate") else letter.upper() if fault else letter
            seen.add((role, text))
        turns = [t for t, _, _ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, edits = by_steps(pattern)
        done, i = [], 0
        for e in edits:
            expected = "assistant" if done and done[-1].startswith("u") else "user"
            if e == "I":
                done.append(expected + ":")
                continue
            if e in "KR":
                done.append((rows[i][1] if e == "K" else expected) + ":" + rows[i][2])
            i += 1
        out[conv] = (gaps, *counts.values(), illegal, cost, edits, hashlib.sha256("\n".join(done).encode()).hexdigest())
    return out


def check(spark, lines, **sizes):
    df = spark.createDataFrame(lines, "conv_id long, turn long, role string, text string")
    got = R.repair(R.damaged(df), **sizes).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == brute(lines)
    assert len(got) == len({x[0] for x in lines})


def test_whole_table(spark, sf):
    import __spark_entry__ as entry

    lines = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = entry.queries()["op13_conversation_repair"](spark, sf)
    assert got.columns[:9] == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {r[0]: tuple(r)[1:9] for r in got.collect()} == brute(lines)


def test_long_conversation_in_pieces_of_a_few_rows(spark):
    import random

    rng = random.Random(5)
    said = ["Hello.", "Yes!", "no", "", "Why?", " \t", "tail", "A longer line, cut", "Fine."]
    lines = [(c, t, rng.choice(["user", "assistant", "user", "assistant", "system", "tool"]), rng.choice(said) + rng.choice(["", f" {t}."])) for c, n in ((1, 700), (2, 3), (3, 90), (4, 1)) for t in range(n)]
    check(spark, lines, max_rows=7, max_chars=60, fan=3)


def test_odd_rows(spark):
    rows = [(None, None, None, None), (None, 1, "user", "Hi."), (5, None, "user", "Same."), (5, None, "user", "Same."), (5, 3, "user", "Same."), (5, 2, None, "None."), (6, 0, "", "No role."), (7, 9, "assistant", "\n"), (8, 4, "umpire", "x" * 200_000), (8, 5, "agent", "ok."), (8, 7, "assistant", "é…")]
    dropped = next(c for c in range(100, 1000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    check(spark, [*rows, (dropped, 1, "user", "Gone.")])
    got = {r["conv_id"]: r for r in R.repair(R.damaged(spark.createDataFrame([(dropped, 1, "user", "Gone.")], "conv_id long, turn long, role string, text string"))).collect()}[dropped]
    assert got["audit"] == "" and got["cost"] == got["gaps"] == 0 and got["repaired_sha256"] == hashlib.sha256(b"").hexdigest()


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert R.repair_damaged(empty).collect() == []
    more = spark.createDataFrame([(1, 0, "user", "Hi.", "x", True, 9, 4)], "conv_id long, turn long, role string, text string, pattern string, live boolean, at long, cost long")
    assert [r["conv_id"] for r in R.repair_damaged(more).collect()] == [1]
