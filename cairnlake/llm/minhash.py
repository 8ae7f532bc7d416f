"""Near duplicates by an LSH forest over MinHash signatures.

Equal shingle sets are first collapsed to one representative. Each of several trees sorts the representatives by a short
sequence of MinHash values; a range shuffle spreads even one hot prefix over many tasks. Rows next to each other in that
order share the longest prefixes: where few rows share the first ``DEPTH`` values all of them are compared, and in crowded
regions first those within half a ``BLOCK`` (the second time, a whole one) of each other, which share longer ones. Of the pairs whose sketches look alike each
block passes on a spanning forest, best first, never all pairs; those are confirmed on the full sets. Pairs that fail may have
stood for others, so documents of groups with a failed pair meet once more with their texts, in the same order, and each
block compares all their full sets by one product of incidence matrices; it returns the edges of a spanning forest.

Rows of runs that no block held whole meet by an exact join on full sets instead: two linked sets share one of their rarest
shingles, whatever the order of rarity, so the documents of each such shingle are paired, in squares of bounded size where
they are many, unless they are in one group already. Pairs whose sketches look alike are confirmed on the full sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlake.llm.components import components, met_by_key
from cairnlake.session import discard, durable, lean_shuffles

#: Trees, MinHash values in each, and the values that compared rows share at least.
TREES, VALUES, DEPTH = 12, 6, 2
#: Rows compared together in a crowded region; half of them overlap with the next block.
BLOCK = 256
#: Of rows in larger runs: documents whose shingles are counted to rank all by rarity, shingles ranked, documents of one
#: shingle compared together, and bytes of texts confirmed together.
SAMPLE, RANKED, CROWD, CHUNK = 2048, 1 << 16, 1024, 1 << 20
#: Share of equal sketch bytes, below the link threshold, from which a pair is confirmed: over five standard errors.
SLACK = 0.2

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
FACTOR = 0x9E3779B97F4A7C15
INVERSE = pow(FACTOR, -1, 1 << 64)
_RANDOM = np.random.default_rng(20250101)
MULTIPLY = _RANDOM.integers(1, 1 << 63, TREES * VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _RANDOM.integers(0, 1 << 63, TREES * VALUES, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Shingler:
    """64-bit hashes of the distinct word shingles of texts, many texts at a time.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the UTF-8 text with A-Z lowered. A text of fewer than ``width`` words has its whole
    word sequence as one shingle, one without words has none.
    """

    def __init__(self, width: int) -> None:
        self.width = width
        self.up = self.down = np.zeros(0, np.uint64)

    def sets(self, texts: list[bytes]) -> list[np.ndarray]:
        data = np.frombuffer(b"\n".join([t.translate(LOWER) for t in texts]) + b"\n", np.uint8)
        if len(data) > len(self.up):
            self.up, self.down = _powers(FACTOR, 2 * len(data)), _powers(INVERSE, 2 * len(data))
        inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
        edges = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
        starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)])])
        words = _mix((sums[ends] - sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        limits = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)]))
        rows = max(0, len(words) - self.width + 1)
        chained = np.zeros(rows, np.uint64)
        for i in range(self.width):
            chained = _mix(chained * np.uint64(FACTOR) + words[i : i + rows])
        out = []
        for a, b in zip(limits, limits[1:], strict=False):
            if b - a >= self.width:
                out.append(np.unique(chained[a : b - self.width + 1]))
            elif b > a:
                short = np.zeros(1, np.uint64)
                for w in words[a:b]:
                    short = _mix(short * np.uint64(FACTOR) + w)
                out.append(short + np.uint64(b - a))
            else:
                out.append(np.zeros(0, np.uint64))
        return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values, a row of TREES x VALUES for each set; none of the sets is empty."""
    flat, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), TREES * VALUES), np.uint32)
    for k, (a, b) in enumerate(zip(MULTIPLY, ADD, strict=True)):
        out[:, k] = np.minimum.reduceat((flat * a + b) >> np.uint64(32), starts)
    return out


def _slices(texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Position and texts of parts of about ``most`` bytes; null texts as empty."""
    at, held, size = 0, [], 0
    for i, t in enumerate(texts):
        held.append(t.as_buffer().to_pybytes() if t.is_valid else b"")
        size += len(held[-1])
        if size >= most:
            yield at, held
            at, held, size = i + 1, [], 0
    if held:
        yield at, held


def signed(docs: DataFrame, width: int, text: str, doc_id: str) -> DataFrame:
    """doc_id, n_shingles, key (digest of the set) and signature, both null for empty sets."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in batches:
            for at, texts in _slices(batch.column(1)):
                sets = shingler.sets(texts)
                full = [s for s in sets if len(s)]
                rows = iter(signatures(full)) if full else iter(())
                keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                marks = [next(rows).tobytes() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(marks, pa.binary())], ["doc_id", "n_shingles", "key", "signature"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(sign, "doc_id long, n_shingles long, key binary, signature binary")


# --- the forest -------------------------------------------------------------------------------------------------------


def _forest(ids: np.ndarray, sketch: np.ndarray, least: float) -> list[tuple[int, int]]:
    """A spanning forest of the alike pairs of a block, best first, equals by the smaller ids (so that trees agree)."""
    alike = (sketch[:, None, :] == sketch[None, :, :]).mean(axis=2)
    a, b = np.nonzero(np.triu(alike >= least, 1))
    low, high = np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b])
    order = np.lexsort((high, low, -np.minimum(alike[a, b], 0.92)))
    root, parts, out = list(range(len(ids))), len(ids), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, j, x, y in zip(*(v[order].tolist() for v in (a, b, low, high)), strict=True):
        if parts == 1:
            break
        i, j = find(i), find(j)
        if i != j:
            root[j] = i
            parts -= 1
            out.append((x, y))
    return out


def _shared_counts(sets: list[np.ndarray], columns: int = 1 << 14) -> np.ndarray:
    """Sizes of all intersections, by products of incidence matrices over the elements that occur more than once."""
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, place, count = np.unique(flat, return_inverse=True, return_counts=True)
    often = count > 1
    number = np.cumsum(often) - 1
    row, place = row[often[place]], number[place[often[place]]]
    out = np.zeros((len(sets), len(sets)))
    order = np.argsort(place, kind="stable")
    row, place = row[order], place[order]
    total = int(often.sum())
    for at in range(0, total, columns):
        i, j = np.searchsorted(place, (at, at + columns))
        part = np.zeros((len(sets), min(columns, total - at)), np.float32)
        part[row[i:j], place[i:j] - at] = 1
        out += part @ part.T
    return out


def _linked(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """(least id, id) for each set of a block that links, directly or over others, reach."""
    both = _shared_counts(sets)
    size = np.array([len(x) for x in sets], float)
    a, b = np.nonzero(np.triu(100 * both >= percent * (size[:, None] + size[None, :] - both), 1))
    rank = np.argsort(np.argsort(ids))
    lead = rank.copy()
    while True:
        new = lead.copy()
        np.minimum.at(new, a, lead[b])
        np.minimum.at(new, b, lead[a])
        if (new == lead).all():
            break
        lead = new
    by_rank = np.sort(ids)
    return [(int(by_rank[lead[i]]), int(ids[i])) for i in np.flatnonzero(lead != rank)]


def _in_order(rows: DataFrame, *carried: str) -> DataFrame:
    """A row for each tree of (id, signature, carried), in the order of the tree's values."""
    width = 4 * VALUES
    spread = rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1)))).withColumn("prefix", F.expr(f"substring(signature, tree * {width} + 1, {width})"))
    return spread.select("tree", "prefix", "id", *carried).repartitionByRange("tree", "prefix", "id").sortWithinPartitions("tree", "prefix", "id")


def _blocks(batches: Iterator[pa.RecordBatch], rows: int = BLOCK, most_bytes: int = 1 << 25) -> Iterator[tuple[pa.Table, list[tuple[int, int]], list[tuple[int, int]]]]:
    """Tables with the bounds of blocks in them: rows that share tree and first values, overlapping by half where they are many.

    A block has ``rows`` rows at most, and no more once it holds ``most_bytes``. Rows of a run that goes on in the next batch are
    held back, of a long one the overlap only. The last list bounds the rows of runs that no block holds whole: runs of several
    blocks, and those at an edge of the partition, which may go on in the next one.
    """

    def cut(table: pa.Table, last: bool, begun: bool) -> tuple[list[tuple[int, int]], list[tuple[int, int]], int, bool]:
        n = table.num_rows
        prefix = np.frombuffer(b"".join(table["prefix"].to_pylist()), np.uint8).reshape(n, 4 * VALUES)[:, : 4 * DEPTH]
        tree = table["tree"].to_numpy()
        starts = np.flatnonzero(np.append(True, (tree[1:] != tree[:-1]) | (prefix[1:] != prefix[:-1]).any(axis=1)))
        ends = np.append(starts[1:], n)
        rest = n if last else int(starts[-1])
        runs = [(a, b) for a, b in zip(starts.tolist(), ends.tolist(), strict=True) if b <= rest]
        goes_on = n - rest > 2 * rows
        if goes_on:
            runs.append((rest, n))
            rest = n - rows // 2
        step = max(2, min(rows, most_bytes * n // max(1, table.nbytes)))
        bounds = [(at, min(b, at + step)) for a, b in runs if b - a > 1 for at in range(a, max(a + 1, b - step // 2), step // 2)]
        partial = [(a, b) for a, b in runs if b - a > step or (begun and a == 0) or b == n]
        return bounds, partial, rest, goes_on or (begun and rest == 0)

    held: pa.Table | None = None
    begun = True
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        held = (table if held is None else pa.concat_tables([held, table])).combine_chunks()
        bounds, partial, rest, begun = cut(held, False, begun)
        yield held, bounds, partial
        held = held.slice(rest)
    if held is not None and held.num_rows:
        held = held.combine_chunks()
        yield held, *cut(held, True, begun)[:2]


def _edges(pairs: set[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*pairs, strict=True) if pairs else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def candidate_pairs(rows: DataFrame, least: float) -> DataFrame:
    """Distinct (a, b), a < b, to be confirmed, from rows of (id, signature, sketch); (a, a) marks rows of runs not met whole."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds, partial in _blocks(batches):
            ids = table["id"].to_numpy()
            pairs = {(x, x) for a, b in partial for x in ids[a:b].tolist()}
            if bounds:
                sketch = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(table.num_rows, -1)
                two = np.array([a for a, b in bounds if b - a == 2], int)
                fine = two[(sketch[two] == sketch[two + 1]).mean(axis=1) >= least] if len(two) else two
                pairs.update(zip(np.minimum(ids[fine], ids[fine + 1]).tolist(), np.maximum(ids[fine], ids[fine + 1]).tolist(), strict=True))
                for a, b in bounds:
                    if b - a > 2:
                        pairs.update(_forest(ids[a:b], sketch[a:b], least))
            yield _edges(pairs)

    return _in_order(rows, "sketch").mapInArrow(read, "a long, b long").distinct()


def links_within(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """Distinct edges (a, b) that join what is linked in each block of (id, signature, text), from full sets; (a, a) as above."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for table, bounds, partial in _blocks(batches, 2 * BLOCK):
            ids = table["id"].to_numpy()
            pairs = {(x, x) for a, b in partial for x in ids[a:b].tolist()}
            for a, b in bounds:
                sets = [x for _, part in _slices(table["text"].slice(a, b - a).combine_chunks()) for x in shingler.sets(part)]
                pairs.update(_linked(ids[a:b], sets, percent))
            yield _edges(pairs)

    return _in_order(rows, "text").mapInArrow(read, "a long, b long").distinct()


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b, linked) of pairs, from the full shingle sets of ``texts`` (id, text)."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in batches:
            for at, left in _slices(batch.column(2)):
                right = [t.as_buffer().to_pybytes() for t in batch.column(3).slice(at, len(left))]
                linked = []
                for x, y in zip(shingler.sets(left), shingler.sets(right), strict=True):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    linked.append(100 * both >= percent * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(left)), batch.column(1).slice(at, len(left)), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    left = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("x")), "a")
    both = left.join(texts.select(F.col("id").alias("b"), F.col("text").alias("y")), "b").select("a", "b", "x", "y")
    return both.mapInArrow(check, "a long, b long, linked boolean")


def _common_shingles(texts: DataFrame, width: int) -> np.ndarray:
    """Shingles that documents of a sample repeat, sorted, with their counts: two rows."""
    every = max(1, texts.count() // SAMPLE)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in batches:
            for _, part in _slices(batch.column(0)):
                found, n = np.unique(np.concatenate(shingler.sets(part)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found[n > 1].view(np.int64)), pa.array(n[n > 1])], ["shingle", "n"])

    sample = texts.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).select("text")
    most = sample.mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "shingle").limit(RANKED)
    found = np.array([(r["shingle"], r["n"]) for r in most.collect()], np.int64).reshape(-1, 2).T
    shingle, n = np.ascontiguousarray(found).view(np.uint64)
    order = np.argsort(shingle)
    return np.vstack([shingle[order], n[order]])


def _rarest(texts: DataFrame, common: np.ndarray, width: int, percent: int) -> DataFrame:
    """(shingle, id, grp, size, left): of each of (id, grp, text) so many of its rarest shingles that linked sets share one.

    ``left`` counts the shingle and those behind it in the order of rarity: no more are shared by sets that share none before it.
    """
    held = texts.sparkSession.sparkContext.broadcast(common)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, (known, counts) = Shingler(width), held.value
        for batch in batches:
            for at, part in _slices(batch.column(2)):
                sets = shingler.sets(part)
                rare = []
                for x in sets:
                    place = np.minimum(np.searchsorted(known, x), max(0, len(known) - 1))
                    often = np.where(known[place] == x, counts[place], np.uint64(0)) if len(known) else np.zeros(len(x), np.uint64)
                    rare.append(x[np.lexsort((x, often))[: len(x) + percent * len(x) // -100 + 1]])
                row = np.repeat(np.arange(at, at + len(sets)), [len(x) for x in rare])
                size = np.repeat([len(x) for x in sets], [len(x) for x in rare])
                left = size - np.concatenate([np.arange(len(x)) for x in rare])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rare).view(np.int64)), batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(size), pa.array(left)], ["shingle", "id", "grp", "size", "left"])

    return texts.select("id", "grp", "text").mapInArrow(read, "shingle long, id long, grp long, size long, left long")


def _met(rare: DataFrame, nodes: DataFrame, least: float, percent: int) -> DataFrame:
    """Distinct (a, b), a < b, of different groups that share one of ``rare`` and look alike, from nodes (id, sketch).

    Documents of a shingle are dealt by their ids into parts of about ``CROWD``; each part meets each other in a task's group.
    A shingle of many documents brings its number to them by broadcast.
    """
    shared = rare.groupBy("shingle").agg(F.count("*").alias("n"), F.min("grp").alias("lo"), F.max("grp").alias("hi")).where("lo < hi")
    parts = F.ceil(F.col("n") / CROWD).cast("int")
    own = F.pmod(F.xxhash64("id"), parts).cast("int")
    counted = met_by_key(rare, shared.select("shingle", "n", F.col("n").alias("of")), "shingle", rare.count()).withColumnRenamed("of", "n")
    rows = counted.withColumns({"own": own, "other": F.explode(F.sequence(F.lit(0), parts - 1))})
    rows = rows.select("shingle", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id", "grp", "size", "left", "own").join(nodes.select("id", "sketch"), "id")

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in (*batches, None):
            if batch is not None and not batch.num_rows:
                continue
            if batch is not None:
                table = pa.Table.from_batches([batch])
                held = (table if held is None else pa.concat_tables([held, table])).combine_chunks()
            if held is None or not held.num_rows:
                continue
            key = np.column_stack([held[c].to_numpy() for c in ("shingle", "i", "j")])
            starts = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(axis=1)))
            ends = np.append(starts[1:], len(key))
            rest = len(key) if batch is None else int(starts[-1])
            ids, grp, size, left, own = (held[c].to_numpy() for c in ("id", "grp", "size", "left", "own"))
            sketch = np.frombuffer(b"".join(held["sketch"].to_pylist()), np.uint8).reshape(len(ids), -1)
            found = [np.zeros((0, 2), np.int64)]
            for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                if b > rest or b - a < 2:
                    continue
                across = key[a, 1] != key[a, 2]
                for at in range(a, b):
                    span = slice(a if across else at + 1, b)
                    near = (grp[span] != grp[at]) & ((100 + percent) * np.minimum(left[span], left[at]) >= percent * (size[span] + size[at]))
                    if across:
                        near &= own[span] > own[at]
                    to = np.flatnonzero(near) + span.start
                    if len(to):
                        to = to[(sketch[to] == sketch[at]).mean(axis=1) >= least]
                        found.append(np.column_stack([np.minimum(ids[to], ids[at]), np.maximum(ids[to], ids[at])]))
            pairs = np.concatenate(found)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])
            held = held.slice(rest)

    dealt = rows.repartition("shingle", "i", "j").sortWithinPartitions("shingle", "i", "j")
    return dealt.select("shingle", "i", "j", "id", "grp", "size", "left", "own", "sketch").mapInArrow(pair, "a long, b long").distinct()


def _links_of(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The linked ones of pairs (a, b), from the full sets of texts (id, text).

    Texts are dealt by their ids into chunks of about ``CHUNK`` bytes; a group compares the pairs of two chunks, with each of their texts
    that has such a pair once.
    """
    chunks = 1 + (texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // CHUNK
    number = lambda c: F.pmod(F.xxhash64(c), F.lit(chunks)).cast("int")
    placed = durable(pairs.select("a", "b", F.least(number("a"), number("b")).alias("i"), F.greatest(number("a"), number("b")).alias("j")))
    ends = placed.select(F.col("i").alias("p"), F.col("j").alias("q"), F.explode(F.array("a", "b")).alias("id")).distinct().join(texts.select("id", "text"), "id")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        shingler, sets = Shingler(width), {}
        ids = right["id"].to_pylist()
        for at, part in _slices(right["text"].combine_chunks()):
            sets.update(zip(ids[at : at + len(part)], shingler.sets(part), strict=True))
        a, b = left["a"].to_numpy(), left["b"].to_numpy()
        if len(sets) <= 2 * CROWD and len(a) > 16 * len(sets):
            place = {x: i for i, x in enumerate(sets)}
            i, j, size = [place[x] for x in a.tolist()], [place[x] for x in b.tolist()], np.array([len(x) for x in sets.values()])
            both = _shared_counts(list(sets.values()), 1 << 12)[i, j]
            linked = 100 * both >= percent * (size[i] + size[j] - both)
            return pa.table({"a": a[linked], "b": b[linked]})
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        linked = np.zeros(len(a), bool)
        starts = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else np.zeros(0, int)
        for at, end in zip(starts.tolist(), [*starts[1:].tolist(), len(a)], strict=False):
            own = sets[int(a[at])]
            for k in range(at, end, 256):
                others = [sets[int(x)] for x in b[k : min(end, k + 256)]]
                flat, size = np.concatenate(others), np.array([len(x) for x in others])
                place = np.minimum(np.searchsorted(own, flat), len(own) - 1)
                both = np.add.reduceat((own[place] == flat).astype(np.int64), np.cumsum([0, *size[:-1]]))
                linked[k : k + len(others)] = 100 * both >= percent * (size + len(own) - both)
        return pa.table({"a": a[linked], "b": b[linked]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return placed.groupBy("i", "j").cogroup(ends.groupBy("p", "q")).applyInArrow(compare, "a long, b long")


def exact_links(texts: DataFrame, nodes: DataFrame, width: int, percent: int) -> DataFrame:
    """All links (a, b) between different groups of texts (id, grp, text), met by their rarest shingles; nodes: (id, sketch)."""
    rare = durable(_rarest(texts, _common_shingles(texts, width), width, percent))
    return _links_of(_met(rare, nodes, percent / 100 - SLACK, percent), texts, width, percent)


def regrouped(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (id, grp), grp being the least id of its group, once links (a, b) between their ids have joined groups.

    Only links across groups go into the rounds of components, as edges between the groups; where there are none, nothing runs.
    """
    end = lambda c: labels.select(F.col("id").alias(c), F.col("grp").alias(f"{c}_grp"))
    met = links.select("a", "b").join(end("a"), "a").join(end("b"), "b").where("a_grp <> b_grp")
    across = durable(met.select(F.least("a_grp", "b_grp").alias("a"), F.greatest("a_grp", "b_grp").alias("b")).distinct())
    if across.isEmpty():
        return labels
    joined = components(across)
    return durable(labels.join(joined, F.col("grp") == F.col("node"), "left").select("id", F.coalesce("component", "grp").alias("grp")))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id, kept, a row for each row.

    Documents are linked whose sets of ``width``-word shingles have 100 * intersection >= ``percent`` * union; component_id is
    the smallest doc_id reachable and kept marks its bearer. Null, empty and wordless texts have no shingles and are linked
    with nothing. A null doc_id can be nobody's component: such rows carry the component of their set, null if no row
    with an id has that set, and are kept only then. Rows that repeat an id are one document in the link graph. An empty table gives no rows.
    Other columns are not read.

    A pair at the threshold j is met in no tree with probability (1 - j ** DEPTH) ** TREES at most, 5e-6 for 0.8 and 2e-7
    for 0.85; documents that share prefixes with more than a block of others meet by an exact join of their rarest shingles.
    """
    with lean_shuffles(docs.sparkSession):
        return _near_duplicates(docs, width, percent, text, doc_id)


def _near_duplicates(docs: DataFrame, width: int, percent: int, text: str, doc_id: str) -> DataFrame:
    signatures_of = durable(signed(docs, width, text, doc_id))
    classes = durable(signatures_of.where("key IS NOT NULL AND doc_id IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("id"), F.first("signature").alias("signature")))
    rows = durable(signatures_of.select("doc_id", "n_shingles", "key"))
    discard(signatures_of)  # those of the classes are all that is read on
    bytes_of = F.concat(*(F.expr(f"substring(signature, {4 * k + 1}, 1)") for k in range(TREES * VALUES)))
    nodes = classes.select("id", "signature", bytes_of.alias("sketch"))
    pairs = durable(candidate_pairs(nodes, percent / 100 - SLACK))
    needed = pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id"))).distinct()
    own = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    texts = durable(own.join(needed, "id").groupBy("id").agg(F.max("text").alias("text")))
    crowded = pairs.where("a = b").select(F.col("a").alias("node"))
    tested = durable(confirmed(pairs.where("a <> b"), texts, width, percent))
    groups = components(tested.where("linked").select("a", "b"))
    failed = tested.where("NOT linked").select(F.explode(F.array("a", "b")).alias("node")).distinct()
    # groups are found on ids alone; texts meet them by their ids, which are unique, and only where they are read
    labels = durable(texts.select("id").join(groups, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("grp")))
    if not failed.isEmpty():
        marked = labels.join(failed, F.col("id") == F.col("node"), "left").groupBy("grp")
        open_groups = marked.agg(F.count("node").alias("failed")).where("failed > 0").select("grp")
        again = texts.join(labels.join(open_groups, "grp", "left_semi").select("id"), "id").join(nodes.select("id", "signature"), "id")
        more = durable(links_within(again, width, percent))
        crowded = crowded.unionAll(more.where("a = b").select(F.col("a").alias("node"))).distinct()
        labels = regrouped(labels, more.where("a <> b"))
    if not crowded.isEmpty():
        few = texts.join(labels.join(crowded, F.col("id") == F.col("node"), "left_semi"), "id").select("id", "grp", "text")
        labels = regrouped(labels, exact_links(few, nodes, width, percent))
    by_key = classes.select("key", "id").join(labels, "id", "left").select("key", F.coalesce("grp", "id").alias("component_id"))
    out = rows.select("doc_id", "n_shingles", "key").join(by_key, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One document of each component of :func:`near_duplicates`, with all its columns; rows without an id stay."""
    decided = near_duplicates(docs, width, percent, text, doc_id).where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("kept").alias("kept"))
    name = next(n for n in ("__gone", *(f"__gone{i}" for i in range(len(docs.columns) + 1))) if n not in docs.columns)
    gone = decided.where("NOT kept").select(F.col("doc_id").alias(name))
    return docs.join(gone, F.col(doc_id) == F.col(name), "left_anti")
