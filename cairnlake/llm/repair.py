"""Conversation structure repair: the cheapest edits of each conversation's rows, by A* on the edit lattice.

The lattice has a node for each row and each state of the role grammar ``(s?(ua)+)?``. Conversations that lie whole in a
task's sorted rows are repaired there. Others (those that a range partition cuts, or that are too long for one piece) are cut
into pieces of bounded size: each piece is searched from every state to every state, a tree of pieces says through which
states the cheapest way goes, and each piece then gives its part of it.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlake.operators.order import placed, same_keys
from cairnlake.session import durable

SPACE = " \t\n\x0b\x0c\r"
NAMES = {"u": "user", "a": "assistant"}
#: State after nothing, a system row, a user row, an assistant row; the letter that may follow; what closes the grammar.
FOLLOWS = "uuau"
CLOSING = ("", "II", "I", "")
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
FAR = 1 << 60


# --- one piece --------------------------------------------------------------------------------------------------------


@lru_cache(maxsize=20_000)
def search(pattern: str, begin: int, whole: bool) -> tuple[tuple[int, int, str], ...]:
    """(state, cost, edits) of the cheapest ways through the rows of ``pattern``; of equal costs the ASCII-least edits.

    A row is ``d`` if it must go, else its role's initial (``o`` for others), in upper case if it is truncated. ``whole``
    ends at the first goal, a closed grammar after the last row; else every state that can be reached after the last row is
    given, with no insertion after that row. A* is keyed (cost plus heuristic, edits). The heuristic is the suffix sum of
    mandatory deletions and of what a truncated row costs at least, deleted or kept: it never overestimates, and one edit never
    lowers the sum of both by more than it costs, so a node's first visit is its best, by edits, too.
    """
    least = [0] * (len(pattern) + 1)
    for i in range(len(pattern) - 1, -1, -1):
        charge = DELETE if pattern[i] == "d" else min(DELETE, TRUNCATED) if pattern[i].isupper() else 0
        least[i] = least[i + 1] + charge
    heap = [(least[0], "", 0, begin)]
    seen: set[tuple[int, int]] = set()
    found = []
    while heap:
        total, edits, i, state = heapq.heappop(heap)
        if (i, state) in seen:
            continue
        seen.add((i, state))
        cost = total - least[i]
        if i == len(pattern):
            if not whole:
                found.append((state, cost, edits))
                continue
            if state in (0, 3):
                return ((state, cost, edits),)
        letter = FOLLOWS[state]
        heapq.heappush(heap, (total + INSERT, edits + "I", i, NEXT[state, letter]))
        if i == len(pattern):
            continue
        row, rest = pattern[i], cost + least[i + 1]
        heapq.heappush(heap, (rest + DELETE, edits + "D", i + 1, state))
        if row != "d":
            extra = TRUNCATED if row.isupper() else 0
            if (after := NEXT.get((state, row.lower()))) is not None:
                heapq.heappush(heap, (rest + extra, edits + "K", i + 1, after))
            heapq.heappush(heap, (rest + extra + REROLE, edits + "R", i + 1, NEXT[state, letter]))
    return tuple(sorted(found))


def replay(edits: str, rows: list[tuple[str, str]], state: int) -> Iterator[str]:
    """The repaired lines ``role:text``."""
    i = 0
    for edit in edits:
        if edit == "D":
            i += 1
            continue
        letter = rows[i][0][:1] if edit == "K" else FOLLOWS[state]
        if edit == "I":
            yield NAMES[letter] + ":"
        else:
            yield (rows[i][0] if edit == "K" else NAMES[letter]) + ":" + rows[i][1]
            i += 1
        state = NEXT[state, letter]


def mark(role: str, text: str, again: bool) -> str:
    """The row's sign in a pattern; blank rows and repeated ones must go."""
    body = text.rstrip(SPACE)
    if not body.lstrip(SPACE) or again:
        return "d"
    letter = role[:1] if role[:1] in ("s", "u", "a") else "o"
    return letter if body[-1] in ".!?" else letter.upper()


def facts(rows: list[tuple[int | None, str, str]], again: list[bool]) -> dict[str, object]:
    """What a piece adds to the counts of its conversation; rows: (turn, role, text), repeated ones marked."""
    blank = [not t.strip(SPACE) for _, _, t in rows]
    pattern = "".join(mark(r, t, a) for (_, r, t), a in zip(rows, again, strict=True))
    initials = [r[:1] for _, r, _ in rows]
    turns = [t for t, _, _ in rows if t is not None]
    return {
        "pattern": pattern,
        "blank": sum(blank),
        "duplicate": sum(a and not b for a, b in zip(again, blank, strict=True)),
        "truncated": sum(c.isupper() for c in pattern),
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)),
        "first": initials[0] if rows else None,
        "last": initials[-1] if rows else None,
        "n_turns": len(set(turns)),
        "low": turns[0] if turns else None,
        "high": turns[-1] if turns else None,
    }


class Totals:
    """Counts, edits and the hash of a conversation, fed with its pieces in order."""

    def __init__(self) -> None:
        self.blank = self.duplicate = self.truncated = self.illegal = self.n_turns = self.cost = 0
        self.last: str | None = None
        self.low: int | None = None
        self.high: int | None = None
        self.edits: list[str] = []
        self.hash, self.lines = hashlib.sha256(), False

    def count(self, piece: dict) -> None:
        for name in ("blank", "duplicate", "truncated", "illegal", "n_turns"):
            setattr(self, name, getattr(self, name) + piece[name])
        if piece["first"] is not None:
            if self.last is not None and self.last + piece["first"] not in ("su", "ua", "au"):
                self.illegal += 1
            self.last = piece["last"]
        if piece["low"] is not None:
            self.n_turns -= self.high == piece["low"]
            self.low, self.high = piece["low"] if self.low is None else self.low, piece["high"]

    def repair(self, cost: int, edits: str, lines: Iterator[str]) -> None:
        self.cost += cost
        self.edits.append(edits)
        for line in lines:
            self.hash.update((("\n" if self.lines else "") + line).encode(errors="surrogatepass"))
            self.lines = True

    def row(self, conv_id: object) -> dict[str, object]:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.n_turns
        return {"conv_id": conv_id, "gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal, "cost": self.cost, "audit": "".join(self.edits), "repaired_sha256": self.hash.hexdigest()}


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
PIECE = "pattern string, blank long, duplicate long, truncated long, illegal long, first string, last string, n_turns long, low long, high long"


def digest(role: str, text: str) -> bytes:
    """Name of a row's role and text; two rows of one name are taken as equal (128 bits)."""
    return hashlib.blake2b(f"{len(role)}:{role}{text}".encode(errors="surrogatepass"), digest_size=16).digest()


def repeated(rows: list[tuple[int | None, str, str]]) -> list[bool]:
    """Which rows have the role and text of an earlier one."""
    seen: set[tuple[str, str]] = set()
    out = []
    for _, role, text in rows:
        out.append((role, text) in seen)
        seen.add((role, text))
    return out


# --- damage and the common case ---------------------------------------------------------------------------------------


def damaged(lines: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, live) of ``lines`` after the damage that crc32 of ``conv_id:turn`` names, modulo 20.

    0 drops a row (it stays as one that is not live, so that its conversation is known), 1 empties its text, 2 takes its
    ``[.!?]``, 3 repeats it next to itself and 4 makes it a user's. A null counts as one space.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.col("__kind")
    rows = lines.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), (F.crc32(F.concat_ws(":", space("conv_id"), space("turn")).cast("binary")) % 20).alias("__kind"))
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.sequence(F.lit(1), F.when(kind == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (kind != 0).alias("live"), copies.alias("__copy")).drop("__copy")


def _struct_rows() -> pa.DataType:
    return pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]))


def _result_fields() -> list[tuple[str, pa.DataType]]:
    return [(part.split()[0], pa.string() if part.endswith("string") else pa.int64()) for part in RESULT.split(", ")]


def cutter(max_rows: int, max_chars: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From sorted rows to repaired conversations and to pieces of those that this task may not hold whole.

    The first and the last conversation of a task may go on in another one; those of more than ``max_rows`` rows or
    ``max_chars`` characters are cut. All others are repaired here, in memory of that size at most (a single longer
    row makes a piece of its own).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        rows: list[tuple[int | None, str, str]] = []
        conv, at, chars, open_, begun = None, 0, 0, True, False
        schema: pa.Schema | None = None

        def give_piece() -> None:
            names = list({digest(r, t) for _, r, t in rows if t.strip(SPACE)})
            out.append({"conv_id": conv, "closed": False, "at": at, "rows": [{"turn": a, "role": b, "text": c} for a, b, c in rows], "names": names})

        def give_whole() -> None:
            total = Totals()
            piece = facts(rows, repeated(rows))
            total.count(piece)
            ((_, cost, edits),) = search(piece["pattern"], 0, True)
            total.repair(cost, edits, replay(edits, [r[1:] for r in rows], 0))
            out.append({**total.row(conv), "closed": True})

        for batch in batches:
            if schema is None:
                schema = pa.schema([("conv_id", batch.schema.field("conv_id").type), *_result_fields(), ("closed", pa.bool_()), ("at", pa.int64()), ("rows", _struct_rows()), ("names", pa.list_(pa.binary()))])
            columns = [batch.column(n).to_pylist() for n in ("conv_id", "turn", "role", "text", "live", "at")]
            for key, turn, role, text, live, here in zip(*columns, strict=True):
                if not begun or key != conv:
                    if begun:
                        give_piece() if open_ else give_whole()
                        open_ = False
                    conv, at, rows, chars, begun = key, here, [], 0, True
                if not live:
                    continue
                if rows and (len(rows) == max_rows or chars + len(text) > max_chars):
                    give_piece()
                    at, rows, chars, open_ = here, [], 0, True
                rows.append((turn, role, text))
                chars += len(text)
            yield pa.RecordBatch.from_pylist(out, schema=schema)
            out.clear()
        if begun:
            give_piece()
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


# --- conversations in pieces ------------------------------------------------------------------------------------------


def matrix(pattern: str) -> tuple[list[int], list[int]]:
    """Cost from each state to each state, flat, and the place of each end among those of its begin, by edits."""
    cost, rank = [FAR] * 16, [4] * 16
    for begin in range(4):
        ways = search(pattern, begin, False)
        for place, (state, spent, _) in enumerate(sorted(ways, key=lambda w: w[2])):
            cost[4 * begin + state], rank[4 * begin + state] = spent, place
    return cost, rank


def compose(first: tuple[list[int], list[int]], second: tuple[list[int], list[int]]) -> tuple[list[int], list[int]]:
    """The matrix of two pieces in a row.

    Pieces hold as many rows whichever way is taken and end in a row's edit, so no way's edits begin another's: the order of two
    ways is that of their first parts, or of their second parts if these are one.
    """
    cost, rank = [FAR] * 16, [4] * 16
    for begin in range(4):
        ways = []
        for end in range(4):
            spent, place, middle = min((min(FAR, first[0][4 * begin + m] + second[0][4 * m + end]), first[1][4 * begin + m], m) for m in range(4))
            if spent < FAR:
                cost[4 * begin + end] = spent
                ways.append((place, second[1][4 * middle + end], end))
        for place, (_, _, end) in enumerate(sorted(ways)):
            rank[4 * begin + end] = place
    return cost, rank


def route(pieces: list[tuple[list[int], list[int]]], begin: int, end: int) -> list[int]:
    """States between the pieces on the best way from ``begin`` to ``end``, both included."""
    held = {begin: (0, ())}
    back: list[dict[int, int]] = []
    for cost, rank in pieces:
        ways = {}
        for state in range(4):
            options = [(spent + cost[4 * s + state], order, s) for s, (spent, order) in held.items() if cost[4 * s + state] < FAR]
            if options:
                ways[state] = min(options)
        ordered = sorted(ways, key=lambda t: (held[ways[t][2]][1], rank[4 * ways[t][2] + t]))
        back.append({t: w[2] for t, w in ways.items()})
        held = {t: (ways[t][0], (i,)) for i, t in enumerate(ordered)}
    states = [end]
    for step in reversed(back):
        states.append(step[states[-1]])
    return states[::-1]


def _summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for rows, fresh in zip(batch.column("rows").to_pylist(), batch.column("fresh").to_pylist(), strict=True):
            unseen, again = set(fresh or ()), []
            for r in rows:
                name = digest(r["role"], r["text"])
                again.append(name not in unseen)
                unseen.discard(name)
            piece = facts([(r["turn"], r["role"], r["text"]) for r in rows], [a and bool(r["text"].strip(SPACE)) for a, r in zip(again, rows, strict=True)])
            cost, rank = matrix(piece["pattern"])
            out.append({**piece, "cost": cost, "rank": rank})
        kinds = [(p.split()[0], pa.string() if p.endswith("string") else pa.int64()) for p in PIECE.split(", ")]
        added = pa.RecordBatch.from_pylist(out, schema=pa.schema([*kinds, ("cost", pa.list_(pa.int64())), ("rank", pa.list_(pa.int64()))]))
        kept = [n for n in batch.schema.names if n not in ("fresh",)]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), *added.columns], names=[*kept, *added.schema.names])


def _pairs(own: list[dict]) -> list[tuple[list[int], list[int]]]:
    return [(list(x["cost"]), list(x["rank"])) for x in own]


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = []
        for own in batch.column("own").to_pylist():
            parts = _pairs(own)
            whole = parts[0]
            for part in parts[1:]:
                whole = compose(whole, part)
            made.append(whole)
        arrays = [pa.array([m[k] for m in made], pa.list_(pa.int64())) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, "cost", "rank"])


def _routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for conv, own, begin, end in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "own", "begin", "end")), strict=True):
            states = route(_pairs(own), begin, end)
            out += [{"conv_id": conv, "place": x["at"], "begin": a, "end": b} for x, a, b in zip(own, states, states[1:], strict=False)]
        schema = pa.schema([("conv_id", batch.schema.field("conv_id").type), ("place", pa.int64()), ("begin", pa.int64()), ("end", pa.int64())])
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Totals of conversations whose pieces come in order."""
    conv, total, end, begun, schema, out = None, Totals(), 0, False, None, []

    def close() -> None:
        total.repair(INSERT * len(CLOSING[end]), CLOSING[end], replay(CLOSING[end], [], end))
        out.append(total.row(conv))

    for batch in batches:
        if schema is None:
            schema = pa.schema([("conv_id", batch.schema.field("conv_id").type), *_result_fields()])
        for piece in batch.to_pylist():
            if not begun or piece["conv_id"] != conv:
                if begun:
                    close()
                conv, total, begun = piece["conv_id"], Totals(), True
            total.count(piece)
            end = piece["end"]
            (cost, edits), = ((c, e) for s, c, e in search(piece["pattern"], piece["begin"], False) if s == end)
            total.repair(cost, edits, replay(edits, [(r["role"], r["text"]) for r in piece["rows"]], piece["begin"]))
        yield pa.RecordBatch.from_pylist(out, schema=schema)
        out.clear()
    if begun:
        close()
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def _in_pieces(pieces: DataFrame, conv_type: str, fan: int) -> DataFrame:
    """Repair conversations given as pieces (conv_id, at, rows, names).

    A name's first piece is a minimum, combined before its shuffle, and goes back to that piece only: no row meets all rows of
    its name. A node of the tree over a conversation's pieces has ``fan`` children. Only the last step takes a
    conversation to one task, piece after piece, as its hash must be taken in order; it holds one batch of pieces.
    """
    keys = placed(pieces.select("conv_id", "at"), ["conv_id"], ["at"], size="size")
    fresh = pieces.select("conv_id", "at", F.explode("names").alias("name")).groupBy("conv_id", "name").agg(F.min("at").alias("at")).groupBy("conv_id", "at").agg(F.collect_list("name").alias("fresh"))
    known = same_keys(same_keys(pieces.drop("names"), keys, ["conv_id", "at"]), fresh, ["conv_id", "at"], "left")
    rows_type, numbers = pieces.schema["rows"].dataType.simpleString(), "cost array<bigint>, rank array<bigint>"
    held = durable(known.select("conv_id", "place", "size", "rows", "fresh").mapInArrow(_summarise, f"conv_id {conv_type}, place long, size long, rows {rows_type}, {PIECE}, {numbers}"))
    most = held.agg(F.max("size").alias("n")).first()["n"] or 0
    level, blocks = held.select("conv_id", "place", "size", "cost", "rank"), []
    while most > 1:
        own = F.array_sort(F.collect_list(F.struct(F.col("place").alias("at"), "cost", "rank"))).alias("own")
        grouped = level.groupBy("conv_id", F.floor(F.col("place") / fan).cast("long").alias("place")).agg(F.ceil(F.max("size") / fan).cast("long").alias("size"), own)
        blocks.append(durable(grouped.mapInArrow(_composed, f"conv_id {conv_type}, place long, size long, own array<struct<at:bigint,cost:array<bigint>,rank:array<bigint>>>, {numbers}")))
        level, most = blocks[-1].drop("own"), -(-most // fan)
    ends = F.array_min(F.array(*(F.struct((F.col("cost")[t] + INSERT * len(CLOSING[t])).alias("c"), F.col("rank")[t].alias("r"), F.lit(t).cast("long").alias("end")) for t in range(4))))
    way = level.select("conv_id", "place", F.lit(0).cast("long").alias("begin"), ends["end"].alias("end"))
    for block in reversed(blocks):
        both = same_keys(block.select("conv_id", "place", "own"), way, ["conv_id", "place"])
        way = both.select("conv_id", "own", "begin", "end").mapInArrow(_routed, f"conv_id {conv_type}, place long, begin long, end long")
    full = same_keys(held.drop("cost", "rank", "size"), way, ["conv_id", "place"])
    return full.repartition("conv_id").sortWithinPartitions("conv_id", "place").mapInArrow(_joined, f"conv_id {conv_type}, {RESULT}")


def repair(rows: DataFrame, max_rows: int = 512, max_chars: int = 1 << 20, fan: int = 256) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of each conversation.

    rows: (conv_id, turn, role, text, live); those that are not live only name their conversation. A conversation's rows
    are taken by turn (null first), rows of one turn by role and text, so repeated rows stand together. All null ids
    are one conversation. Conversations without live rows get zeros, no edits and the hash of nothing; an empty table
    gives none. Rows are dealt by range over conversation and turn, so a conversation of any length spreads over tasks; its
    pieces hold ``max_rows`` rows and ``max_chars`` characters at most, or one longer row.
    """
    conv_type = rows.schema["conv_id"].dataType.simpleString()
    order = ("conv_id", "turn", "role")
    ranged = rows.repartitionByRange(*order, F.substring("text", 1, 64)).sortWithinPartitions(*order, "text")
    shape = f"conv_id {conv_type}, {RESULT}, closed boolean, at long, rows array<struct<turn:bigint,role:string,text:string>>, names array<binary>"
    held = durable(ranged.select(*order, "text", "live", F.monotonically_increasing_id().alias("at")).mapInArrow(cutter(max_rows, max_chars), shape))
    whole = held.where("closed").select("conv_id", *(p.split()[0] for p in RESULT.split(", ")))
    return whole.unionByName(_in_pieces(held.where("NOT closed").select("conv_id", "at", "rows", "names"), conv_type, fan))


def repair_damaged(lines: DataFrame) -> DataFrame:
    """:func:`repair` of ``lines`` (conv_id, turn, role, text; other columns are not read) after :func:`damaged`."""
    return repair(damaged(lines))
