"""Near duplicates among embeddings by cross-polytope hashing.

Equal vectors are first collapsed. Each of several tables hashes a unit vector by a few pseudo-random rotations (three rounds
of sign flips and a fast Hadamard transform) to the nearest vertices of the cross-polytope; besides its own bucket a vector
probes those of the next nearest vertices. Candidates that meet are verified by their cosine. Buckets are compared in
blocks of a bounded size, a large bucket as pairs of blocks in separate tasks. A link found in several buckets counts in the first one
alone; blocks return each vector's number of links and the edges of a spanning forest, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlake.llm.components import components
from cairnlake.session import durable

PROBES, BLOCK = 10, 1024
#: Numbers from here on stand for vectors without an id.
NO_ID = 1 << 62


@cache
def _signs(size: int, table: int, vertex: int) -> np.ndarray:
    return np.random.default_rng((77, table, vertex)).choice([-1.0, 1.0], (3, size))


def _hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, whose length is a power of two."""
    step = 1
    while step < x.shape[-1]:
        y = x.reshape(*x.shape[:-1], -1, 2, step)
        x = np.stack([y[..., 0, :] + y[..., 1, :], y[..., 0, :] - y[..., 1, :]], axis=-2).reshape(x.shape)
        step *= 2
    return x / math.sqrt(x.shape[-1])


def unit_rows(data: list[bytes], size: int) -> np.ndarray:
    """Unit vectors in double precision from vectors stored as little-endian doubles."""
    x = np.frombuffer(b"".join(data), "<f8").reshape(len(data), size)
    scaled = x / np.abs(x).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def codes(unit: np.ndarray, vertices: int, table: int) -> np.ndarray:
    """Buckets of each vector in a table: rows x (1 + PROBES) at most, the own one first; a bucket names ``vertices`` vertices.

    Probes change one or several vertices to the second or third nearest, least loss of projection first.
    """
    n, d = unit.shape
    size = max(2, 1 << (d - 1).bit_length())
    padded = np.zeros((n, size))
    padded[:, :d] = unit
    total, code = np.zeros((n, 1)), np.zeros((n, 1), np.int64)
    for k in range(vertices):
        y = padded
        for s in _signs(size, table, k):
            y = _hadamard(y * s)
        both = np.concatenate([y, -y], axis=1)
        top3 = np.sort(np.argpartition(-both, 2, axis=1)[:, :3], axis=1)
        top = np.take_along_axis(both, top3, axis=1)
        order = np.argsort(-top, axis=1, kind="stable")
        near, top = np.take_along_axis(top3, order, axis=1), np.take_along_axis(top, order, axis=1)
        # a name among the best has a beginning among the best beginnings, so no others need be kept
        spent = (total[:, :, None] + ((top[:, :1] - top) ** 2)[:, None, :]).reshape(n, -1)
        named = (code[:, :, None] * (2 * size) + near[:, None, :]).reshape(n, -1)
        best = np.argsort(spent, axis=1, kind="stable")[:, : 1 + PROBES]
        total, code = np.take_along_axis(spent, best, axis=1), np.take_along_axis(named, best, axis=1)
    return code


def vertices_for(rows: int, size: int) -> int:
    """Vertices of a bucket name, so that a bucket holds few unrelated vectors whatever the number of rows.

    A name needs no more bits than it takes to tell the caps of 18 degrees apart, about 1.7 a dimension: in few dimensions
    more rows are truly near each other, which no finer bucket changes.
    """
    bits = math.log2(2 * max(2, 1 << (size - 1).bit_length()))
    return max(1, min(math.ceil(math.log2(max(2, rows)) / bits), math.ceil((1.7 * size + 1) / bits)))


def tables_for(vertices: int, size: int, missed: float = 1e-3) -> int:
    """Tables, so that a pair at cosine 0.95 meets in none with a chance of about ``missed``.

    The chance to meet in one table falls with the bits of a bucket's name; exp(-bits ** 2 / 1200) lies below what was
    measured for 5 to 49 bits in 16 and 64 dimensions.
    """
    bits = vertices * math.log2(2 * max(2, 1 << (size - 1).bit_length()))
    return max(3, math.ceil(math.log(missed) / math.log1p(-min(0.999, math.exp(-(bits**2) / 1200)))))


def packed(vectors: DataFrame, vector: str, vec_id: str) -> DataFrame:
    """vec_id and the vector as little-endian doubles, null where it is null, empty, zero or holds null or non-finite components."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            values, ends, valid = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy(), lists.is_valid().to_numpy(zero_copy_only=False)
            fine = [bool(ok) and b > a and bool(np.isfinite(x := values[a:b]).all()) and bool(x.any()) for a, b, ok in zip(ends, ends[1:], valid, strict=False)]
            data = [values[a:b].astype("<f8").tobytes() if ok else None for a, b, ok in zip(ends, ends[1:], fine, strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], ["vec_id", "vector"])

    return vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector")).mapInArrow(pack, "vec_id long, vector binary")


def _block(ids: np.ndarray, weight: np.ndarray, side: np.ndarray, own: np.ndarray, unit: np.ndarray, table: int, bucket: int, vertices: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(id, links) and (a, b) of a run: pairs of a probing or own row with an own row; side 0 or 1 are two blocks, 2 is one."""
    cosine = unit @ unit.T
    pairs = np.triu(cosine >= least, 1) & (own[:, None] | own[None, :]) & ((side[:, None] != side[None, :]) | (side[:, None] == 2))
    a, b = np.nonzero(pairs)
    empty = np.zeros(0, np.int64)
    if not len(a):
        return empty, empty, empty, empty
    first = np.ones(len(a), bool)
    for t in range(table + 1):  # most pairs have met in the first tables, so few rows are hashed again for the later ones
        live = np.flatnonzero(first)
        if not len(live):
            break
        used, at = np.unique(np.concatenate([a[live], b[live]]), return_inverse=True)
        code = codes(unit[used], vertices, t)
        x, y = code[at[: len(live)]], code[at[len(live) :]]
        in_y, in_x = (y == x[:, :1]).any(axis=1), (x == y[:, :1]).any(axis=1)
        if t < table:
            first[live] = ~(in_x | in_y)
        else:
            far = np.iinfo(np.int64).max
            first[live] = np.minimum(np.where(in_y, x[:, 0], far), np.where(in_x, y[:, 0], far)) == bucket
    links = np.zeros(len(ids), np.int64)
    np.add.at(links, a[first], weight[b[first]])
    np.add.at(links, b[first], weight[a[first]])
    lead = np.arange(len(ids))
    while True:
        new = lead.copy()
        np.minimum.at(new, a, lead[b])
        np.minimum.at(new, b, lead[a])
        new = new[new]
        if (new == lead).all():
            break
        lead = new
    hit, edge = np.flatnonzero(links), np.flatnonzero(lead != np.arange(len(ids)))
    return ids[hit], links[hit], ids[lead[edge]], ids[edge]


def linked_vectors(classes: DataFrame, counts: dict[int, int], least: float) -> DataFrame:
    """Rows (id, links) with the links of classes that were met, and rows (id, other) with edges, from (id, copies, vector, size).

    counts: rows of each vector length; vectors meet only those of their length.
    """
    plan = {size: ((v := vertices_for(n, size)), tables_for(v, size)) for size, n in counts.items()}

    def hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                piece = batch.slice(at, BLOCK)
                all_ids, vectors, sizes = piece.column(0).to_numpy(), piece.column(1).to_pylist(), piece.column(2).to_numpy()
                for size in np.unique(sizes).tolist():
                    rows = np.flatnonzero(sizes == size)
                    unit, ids = unit_rows([vectors[r] for r in rows], size), all_ids[rows]
                    vertices, tables = plan[size]
                    for t in range(tables):
                        code = codes(unit, vertices, t)
                        n, p = code.shape
                        own = np.tile(np.arange(p) == 0, n)
                        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, p)), pa.array(np.full(n * p, size, np.int32)), pa.array(np.full(n * p, t, np.int32)), pa.array(code.reshape(-1)), pa.array(own)], ["id", "size", "tab", "bucket", "own"])

    name = ["size", "tab", "bucket"]
    places = durable(classes.select("id", "vector", "size").mapInArrow(hash_rows, "id long, size int, tab int, bucket long, own boolean"))
    live = places.groupBy(*name).agg(F.count("*").alias("n"), F.max("own").alias("any_own")).where("n > 1 AND any_own").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).drop("n", "any_own")
    met = places.join(live, name).withColumn("mine", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    tasks = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tasks = tasks.select("id", *name, "own", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), F.when(F.col("mine") == F.col("other"), 2).otherwise((F.col("mine") > F.col("other")).cast("int")).alias("side"))
    key = ["size", "tab", "bucket", "i", "j"]
    together = tasks.join(classes.drop("size"), "id").select(*key, "id", "copies", "side", "own", "vector").repartition(*key).sortWithinPartitions(*key)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table]).combine_chunks()
            out, rest = runs(held, False)
            held = held.slice(rest)
            yield out
        if held is not None and held.num_rows:
            yield runs(held.combine_chunks(), True)[0]

    def runs(table: pa.Table, last: bool) -> tuple[pa.RecordBatch, int]:
        keys = np.column_stack([table[k].to_numpy().astype(np.int64) for k in key])
        starts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1)))
        ends = np.append(starts[1:], len(keys))
        ids, weight, side, own = table["id"].to_numpy(), table["copies"].to_numpy(), table["side"].to_numpy(), table["own"].to_numpy(zero_copy_only=False)
        vectors = table["vector"].to_pylist()
        found: list[tuple[np.ndarray, ...]] = []
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            if b - a > 1 and (last or b < len(keys)):
                size, tab, bucket = keys[a, :3].tolist()
                found.append(_block(ids[a:b], weight[a:b], side[a:b], own[a:b], unit_rows(vectors[a:b], size), tab, bucket, plan[size][0], least))
        who, links, x, y = (np.concatenate(c) for c in zip(*found, strict=True)) if found else [np.zeros(0, np.int64)] * 4
        pad = lambda v, before, after: pa.array(np.concatenate([np.zeros(before, np.int64), v, np.zeros(after, np.int64)]), mask=np.concatenate([np.ones(before, bool), np.zeros(len(v), bool), np.ones(after, bool)]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([who, x])), pad(links, 0, len(x)), pad(y, len(who), 0)], ["id", "links", "other"]), len(keys) if last else int(starts[-1])

    return together.mapInArrow(compare, "id long, links long, other long")


def near_vectors(vectors: DataFrame, least: float = 0.95, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """vec_id, n_links, component_id and kept, a row for each row.

    Two rows are linked if their cosine in double precision is at least ``least`` (above 0.8) and they meet in a bucket; equal
    vectors always are. n_links counts a row's linked rows, component_id is the least vec_id reachable, kept marks its
    bearer. Vectors that are null, empty, zero or hold null or non-finite components are linked with nothing; so are
    vectors of different lengths. A null vec_id counts among the links of others but can be nobody's component: such a row
    carries its vector's component, null if none of the rows with its vector has an id. Rows that repeat an id with
    other vectors are joined under it. An empty table gives no rows. Other columns are not read.
    The driver learns how many vectors there are of each length, and nothing else.
    """
    rows = durable(packed(vectors, vector, vec_id))
    classes = rows.where("vector IS NOT NULL").groupBy("vector").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"))
    # vectors without an id get a number above all ids, which is nobody's component
    classes = durable(classes.select("vector", "copies", F.coalesce("id", F.shiftrightunsigned(F.xxhash64("vector"), 2) + F.lit(NO_ID)).alias("id"), (F.length("vector") / 8).cast("int").alias("size")))
    counts = {r["size"]: r["count"] for r in classes.groupBy("size").count().collect()}
    if not counts:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = linked_vectors(classes, counts, least)
    found = durable(found)
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    groups = components(found.where("other IS NOT NULL").select(F.col("id").alias("a"), F.col("other").alias("b")))
    decided = classes.join(links, "id", "left").join(groups.withColumnRenamed("node", "id"), "id", "left")
    component = F.coalesce("component", "id")
    decided = decided.select("vector", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.when(component < NO_ID, component).alias("component_id"))
    out = rows.join(decided, "vector", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("vector").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
