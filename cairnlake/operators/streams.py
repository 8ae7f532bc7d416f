"""Lexical diversity of one ordered stream of tokens, such as all utterances of a corpus, however long it is.

The stream is cut into blocks of bounded size; each also gets the tokens ahead of it, so that windows and factors that begin
in a block are measured there. A factor longer than that takes a further round with more tokens ahead for its block alone.
The chain of factors of the original measure is followed by maps: a block says for each of its positions where a chain that
enters there leaves it, and after how many factors; maps of blocks are composed in a tree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlake.operators.order import laid_out
from cairnlake.session import durable

THRESHOLD, LEAST, WINDOW = 0.72, 10, 50


@dataclass
class Stream:
    """pieces: (start, tokens) in order; ``size`` tokens in all."""

    pieces: DataFrame
    size: int

    def backwards(self) -> Stream:
        turned = self.pieces.select((self.size - F.col("start") - F.size("tokens")).alias("start"), F.reverse("tokens").alias("tokens"))
        return Stream(turned, self.size)


def stream_of(rows: DataFrame, order: list[str], tokens: str) -> Stream:
    """The tokens of all rows by ``order``; rows without tokens add none, ties of the order may come either way."""
    held = rows.select(*order, F.col(tokens).alias("tokens")).where(F.size("tokens") > 0)
    pieces, size = laid_out(held, order, F.size("tokens"))
    return Stream(durable(pieces.select("start", "tokens")), size)


def blocks_of(stream: Stream, block: int, ahead: int, only: DataFrame | None = None) -> DataFrame:
    """(block, tokens): the tokens of each block and the next ``ahead`` ones of the stream, which goes on from its beginning.

    ``only``: (block) names the blocks wanted.
    """
    n = stream.size
    ahead = min(ahead, n)
    last = -(-n // block) - 1
    turns = F.explode(F.array(F.lit(0).cast("long"), F.lit(n).cast("long"))).alias("turn")
    virtual = stream.pieces.select("start", "tokens", turns).select((F.col("start") + F.col("turn")).alias("a"), "tokens").where(F.col("a") < n + ahead)
    end = F.col("a") + F.size("tokens")
    lowest = F.greatest(F.lit(0), F.least(F.lit(last), F.floor((F.col("a") - ahead) / block) - 1))
    spread = virtual.select("a", "tokens", F.explode(F.sequence(lowest.cast("long"), F.least(F.lit(last), F.floor((end - 1) / block)).cast("long"))).alias("block"))
    begin = F.col("block") * block
    stop = F.least(begin + block, F.lit(n)) + ahead
    low, high = F.greatest(begin, F.col("a")), F.least(stop, F.col("a") + F.size("tokens"))
    if only is not None:
        spread = spread.join(only, "block", "left_semi")
    cut = spread.where(low < high).select("block", low.alias("a"), F.slice("tokens", (low - F.col("a") + 1).cast("int"), (high - low).cast("int")).alias("t"))
    return cut.groupBy("block").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("a", "t"))), lambda x: x["t"])).alias("tokens"))


def factor_ends(codes: np.ndarray, starts: int, limit: int, least: int, strict: bool) -> tuple[np.ndarray, np.ndarray]:
    """(length of the first factor, types in it) from each of the first ``starts`` positions of ``codes``; -1 if none ends.

    A factor ends where its type-token ratio falls to the threshold (``strict``: below it) with ``least`` tokens at least;
    none has more than ``limit`` tokens. All positions go on by one token at a time: a token is a new type to those that begin after
    its last occurrence. Where no factor ends, the types of all tokens at hand are given.
    """
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    before = np.full(n, -1)
    same = codes[order[1:]] == codes[order[:-1]]
    before[order[1:][same]] = order[:-1][same]
    live, types = np.arange(starts), np.zeros(starts, np.int64)
    length, seen = np.full(starts, -1), np.zeros(starts, np.int64)
    for size in range(1, limit + 1):
        inside = live + size - 1 < n
        if not inside.all():
            seen[live[~inside]] = types[~inside]
            live, types = live[inside], types[inside]
        if not len(live):
            break
        types = types + (before[live + size - 1] < live)
        ratio = types / size
        ends = ((ratio < THRESHOLD) if strict else (ratio <= THRESHOLD)) & (size >= least)
        if ends.any():
            length[live[ends]], seen[live[ends]] = size, types[ends]
            live, types = live[~ends], types[~ends]
    seen[live] = types
    return length, seen


def _measure(size: int, block: int, chain: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From (block, tokens) to window sums, moving-average factor sums, and the block's map of factor chains."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for number, tokens in zip(batch.column("block").to_pylist(), batch.column("tokens").to_pylist(), strict=True):
                start = number * block
                own = min(block, size - start)
                codes = np.unique(np.array(tokens, object).astype(str), return_inverse=True)[1]
                room = size - start - np.arange(own)  # tokens up to the stream's end
                more = len(codes) - own < size  # further tokens can be fetched
                row = {"block": number}
                moving, _ = factor_ends(codes, own, size, LEAST, True)
                row["moving_open"] = bool(more and (moving < 0).any())
                straight = (moving > 0) & (moving <= room)
                row |= {"straight": int(moving[straight].sum()), "n_straight": int(straight.sum()), "wrapped": int(moving[moving > 0].sum()), "n_wrapped": int((moving > 0).sum())}
                width = min(WINDOW, size)
                whole = room >= width
                segment = whole & ((start + np.arange(own)) % WINDOW == 0)
                window = _window_types(codes, own, width)
                row |= {"types": int(window[whole].sum()), "n_windows": int(whole.sum()), "segment_types": int(window[segment].sum()), "n_segments": int(segment.sum())}
                if chain:
                    straight_codes = codes[: size - start]
                    ends, _ = factor_ends(straight_codes, own, size, 1, False)
                    row["chain_open"] = bool(len(straight_codes) < size - start and (ends < 0).any())
                    leaves, count = _leaves(ends, own, start)
                    row |= {"leaves": leaves.tolist(), "count": count.tolist()}
                out.append(row)
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema(_FIELDS))

    return run


_FIELDS = [(n, pa.int64()) for n in ("block", "straight", "n_straight", "wrapped", "n_wrapped", "types", "n_windows", "segment_types", "n_segments")] + [("moving_open", pa.bool_()), ("chain_open", pa.bool_()), ("leaves", pa.list_(pa.int64())), ("count", pa.list_(pa.int64()))]
_SHAPE = "block long, straight long, n_straight long, wrapped long, n_wrapped long, types long, n_windows long, segment_types long, n_segments long, moving_open boolean, chain_open boolean, leaves array<long>, count array<long>"


def _window_types(codes: np.ndarray, own: int, width: int) -> np.ndarray:
    """Types among the ``width`` tokens from each position; positions too near the end count what is there."""
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    before = np.full(n + width, n + width)
    before[:n] = -1
    same = codes[order[1:]] == codes[order[:-1]]
    before[order[1:][same]] = order[:-1][same]
    at = np.arange(own)
    return sum(((before[at + k] < at).astype(np.int64) for k in range(width)), np.zeros(own, np.int64))


def _leaves(ends: np.ndarray, own: int, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Where a chain that is at each position leaves the block, and after how many factors; -1 - position where it ends for good."""
    leaves, count = np.empty(own, np.int64), np.empty(own, np.int64)
    for i in range(own - 1, -1, -1):
        after = i + ends[i]
        if ends[i] < 0:
            leaves[i], count[i] = -1 - (start + i), 0
        elif after >= own:
            leaves[i], count[i] = start + after, 1
        else:
            leaves[i], count[i] = leaves[after], count[after] + 1
    return leaves, count


def _compose(width: int, size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From (block, own: maps of ``width`` tokens each by number) to the map of the whole, for entries into its first ``len`` positions.

    A chain that enters a map beyond the positions it knows stays where it is: the caller goes on from there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for number, own in zip(batch.column("block").to_pylist(), batch.column("own").to_pylist(), strict=True):
                maps = [(m["at"] * width, np.array(m["leaves"], np.int64), np.array(m["count"], np.int64)) for m in own]
                first = maps[0]
                at, done = first[0] + np.arange(len(first[1])), np.zeros(len(first[1]), np.int64)
                for start, leaves, count in maps:
                    here = np.flatnonzero((at >= start) & (at < start + len(leaves)))
                    done[here] += count[at[here] - start]
                    at[here] = leaves[at[here] - start]
                out.append({"block": number, "leaves": at.tolist(), "count": done.tolist()})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([_FIELDS[0], *_FIELDS[-2:]]))

    return run


def measured(stream: Stream, chain: bool, block: int = 10_000, ahead: int = 1_000, grow: int = 8) -> DataFrame:
    """One row a block of :func:`_measure`; blocks in which a factor goes on beyond the tokens ahead are measured again with more."""
    ahead = max(ahead, WINDOW)
    rows = durable(blocks_of(stream, block, ahead).mapInArrow(_measure(stream.size, block, chain), _SHAPE))
    while ahead < stream.size and rows.where("moving_open OR coalesce(chain_open, false)").first() is not None:
        ahead *= grow
        opened = rows.where("moving_open OR coalesce(chain_open, false)").select("block")
        again = blocks_of(stream, block, ahead, opened).mapInArrow(_measure(stream.size, block, chain), _SHAPE)
        rows = durable(rows.where("NOT (moving_open OR coalesce(chain_open, false))").unionByName(again))
    return rows


def factors(stream: Stream, rows: DataFrame, block: int = 10_000, fan: int = 64) -> float:
    """Factors of the stream from its first token on, the last one in part."""
    levels, width = [(rows.select("block", "leaves", "count"), block)], block
    while width < stream.size:
        own = F.array_sort(F.collect_list(F.struct(F.col("block").alias("at"), "leaves", "count"))).alias("own")
        grouped = levels[-1][0].groupBy(F.floor(F.col("block") / fan).cast("long").alias("block")).agg(own)
        levels.append((durable(grouped.mapInArrow(_compose(width, stream.size), "block long, leaves array<long>, count array<long>")), width * fan))
        width *= fan
    at, done = 0, 0
    while 0 <= at < stream.size:
        for table, wide in reversed(levels):
            # a chain that jumped over the positions a map knows is looked up one level below
            found = table.where(F.col("block") == at // wide).select(F.get("leaves", F.lit(at % wide)).alias("to"), F.get("count", F.lit(at % wide)).alias("n")).first()
            if found is not None and found["to"] is not None and found["to"] != at:
                at, done = found["to"], done + found["n"]
                break
        else:
            raise AssertionError("no block holds the position")
    if at < 0:
        begin = -1 - at
        rest = stream.pieces.where(F.col("start") + F.size("tokens") > begin).select(F.explode(F.slice("tokens", (F.greatest(F.lit(begin), F.col("start")) - F.col("start") + 1).cast("int"), F.size("tokens"))).alias("t"))
        types = rest.agg(F.countDistinct("t").alias("n")).first()["n"]
        return done + (1 - types / (stream.size - begin)) / (1 - THRESHOLD)
    return float(done)


def pooled_diversity(stream: Stream, block: int = 10_000, ahead: int = 1_000) -> dict[str, float | int | None]:
    """n_tokens, mtld, mattr, msttr, mtld_ma_bid and mtld_ma_wrap of a whole stream.

    mtld: mean of both directions, tokens over factors (all tokens if there are none), 0 under ten tokens. mattr and
    msttr: mean ratio of all windows of 50 tokens, and of the consecutive ones; a shorter stream is one window. The moving
    averages take the mean length of the first factor (ratio below 0.72, ten tokens at least) from every position: wrapped
    goes on from the stream's beginning, bidirectional is the mean of both directions without that; 0 where no factor
    ends. An empty stream gives None but for mtld, 0.
    """
    n = stream.size
    if not n:
        return {"n_tokens": 0, "mtld": 0.0, "mattr": None, "msttr": None, "mtld_ma_bid": None, "mtld_ma_wrap": None}
    sums, lengths = {}, []
    for name, way in (("on", stream), ("back", stream.backwards())):
        rows = measured(way, n >= 10, block, ahead)
        sums[name] = rows.agg(*(F.sum(c).alias(c) for c in ("straight", "n_straight", "wrapped", "n_wrapped", "types", "n_windows", "segment_types", "n_segments"))).first()
        if n >= 10:
            count = factors(way, rows, block)
            lengths.append(n / count if count else float(n))
    on, back = sums["on"], sums["back"]
    mean = lambda total, count: total / count if count else 0.0
    width = min(WINDOW, n)
    return {
        "n_tokens": n,
        "mtld": sum(lengths) / 2 if n >= 10 else 0.0,
        "mattr": on["types"] / on["n_windows"] / width,
        "msttr": (on["segment_types"] / on["n_segments"] if n >= WINDOW else on["types"]) / width,
        "mtld_ma_bid": (mean(on["straight"], on["n_straight"]) + mean(back["straight"], back["n_straight"])) / 2,
        "mtld_ma_wrap": mean(on["wrapped"], on["n_wrapped"]),
    }
