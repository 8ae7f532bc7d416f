"""Merkle manifest of a dataset: a hash tree a source, a tree over the sources, and inclusion proofs by coordinates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlake.operators.order import placed, same_keys
from cairnlake.session import durable

FAN = 16
#: Levels of more nodes are looked up by a shuffled join, smaller ones by a broadcast of the nodes.
BROADCAST_NODES = 10_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TOP = ""


@dataclass
class Manifest:
    """runs: (tree, run, size, leaves) with up to 16 leaves each; nodes: (tree, level, place, node, size) above the leaves.

    trees: (tree, subroot, top_place), a row a source; the tree over all sources is the tree ``TOP`` in ``nodes``, with
    the subroots as its level 0. ``root`` is None for an empty dataset.
    """

    runs: DataFrame
    nodes: DataFrame
    trees: DataFrame
    n_trees: int
    root: str | None


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 bytes' number, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(text: Column | None = None) -> Column:
    """Digest of a document, or of the document with another text."""
    return digest(*(field(text if name == "text" and text is not None else F.col(name)) for name in FIELDS))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def height(size: Column) -> Column:
    """Levels above ``size`` nodes until one remains."""
    return sum((F.when(size > FAN**k, 1).otherwise(0) for k in range(1, 15)), F.when(size > 1, 1).otherwise(0))


def levels_above(size: int) -> int:
    n = 0
    while size > 1:
        size, n = -(-size // FAN), n + 1
    return n


def _joined(nodes: Column) -> Column:
    return F.array_join(nodes, "")


def _grow(first: DataFrame, size: int) -> list[DataFrame]:
    """(tree, level, place, node, size) of this and all levels above; each is written, so a lost executor costs one level."""
    levels = [first]
    for _ in range(levels_above(size)):
        below = levels[-1].where("size > 1")
        runs = below.groupBy("tree", "level", F.shiftright("place", 4).alias("place")).agg(F.array_sort(F.collect_list(F.struct(F.col("place").alias("at"), "node"))).alias("own"), F.max("size").alias("size"))
        levels.append(durable(runs.select("tree", (F.col("level") + 1).alias("level"), "place", digest(_joined(F.transform("own", lambda x: x["node"]))).alias("node"), F.ceil(F.col("size") / FAN).cast("long").alias("size"))))
    return levels


def build_manifest(docs: DataFrame, tampered_text: Column | None = None) -> Manifest:
    """The hash trees over ``docs`` (doc_id, source, lang, n_chars, text; other columns are not read).

    Per source leaves ascend by doc_id (null first; rows of one id by their digest, so repeated rows are leaves of equal
    digest); every 16 consecutive nodes become their digest until one remains, and sources, null first and then
    bytewise, make the tree above. ``tampered_text`` gives a second digest of each leaf, for checks; null where it
    does not apply. Texts are read once, whole; later steps hold digests only. Places come from a range partitioning, so
    a source of any size spreads over all tasks. An empty table has no root.
    """
    source = F.col("source")
    tree = F.when(source.isNull(), "-").otherwise(F.concat(F.lit("="), source)).alias("tree")
    other = F.lit(None).cast("string") if tampered_text is None else F.when(tampered_text.isNotNull(), leaf(tampered_text))
    leaves = durable(docs.select("doc_id", tree, leaf().alias("leaf"), other.alias("tampered")))
    ranked = placed(leaves, ["tree"], ["doc_id", "leaf"], size="size")
    own = F.array_sort(F.collect_list(F.struct("place", "doc_id", "leaf", "tampered"))).alias("leaves")
    runs = durable(ranked.groupBy("tree", F.shiftright("place", 4).alias("run")).agg(F.max("size").alias("size"), own))
    most = runs.agg(F.max("size").alias("n")).first()["n"] or 0
    whole = F.transform("leaves", lambda x: x["leaf"])
    first = runs.select("tree", F.lit(1).alias("level"), F.col("run").alias("place"), F.when(F.col("size") > 1, digest(_joined(whole))).otherwise(whole[0]).alias("node"), F.ceil(F.col("size") / FAN).cast("long").alias("size"))
    below = _grow(first, -(-most // FAN))
    subroots = below[0].where("size = 1")
    for level in below[1:]:
        subroots = subroots.unionAll(level.where("size = 1"))
    trees = durable(placed(durable(subroots.select("tree", F.col("node").alias("subroot"))), [], ["tree"], place="top_place", size="n_trees"))
    n_trees = trees.count()
    above = _grow(trees.select(F.lit(TOP).alias("tree"), F.lit(0).alias("level"), F.col("top_place").alias("place"), F.col("subroot").alias("node"), F.col("n_trees").alias("size")), n_trees)
    root = above[-1].where("size = 1").first()
    nodes = below[0]
    for level in [*below[1:], *above]:
        nodes = nodes.unionAll(level)
    return Manifest(runs, nodes, trees.drop("n_trees"), n_trees, root["node"] if root else None)


def _siblings(place: Column, size: Column, level: Column, step: Column, tree: Column) -> Column:
    """Coordinates of the other nodes of the run that holds ``place``, on a level of ``size`` nodes."""
    start = place - place % FAN
    others = F.filter(F.sequence(start, F.least(start + FAN, size) - 1), lambda p: p != place)
    return F.transform(others, lambda p: F.struct(tree.alias("tree"), level.cast("int").alias("level"), p.alias("place"), step.cast("int").alias("step"), (p < place).alias("before")))


def proofs(manifest: Manifest) -> DataFrame:
    """doc_id, tree, leaf, tampered, subroot, first (digest after the leaf's own run, from the tampered leaf where there is one),
    beside (the leaf's siblings there) and path: array of (left, right), a pair of joined siblings a further level.

    The leaves of a run need the same nodes above it and ask for them once: each run explodes the coordinates of the siblings
    that follow from its place and the number of nodes on each level, joins the node table, orders what it found and
    concatenates it. A node of level k is asked for by at most 16^k runs: levels of more than ``BROADCAST_NODES`` nodes
    take a shuffled join, in which no node has more than 16 x 16 / ``BROADCAST_NODES`` of the rows; the others are
    broadcast, as their number is bounded.
    """
    tall = F.col("tall")
    known = F.broadcast(manifest.trees) if manifest.n_trees <= BROADCAST_NODES else manifest.trees
    runs = manifest.runs.join(known, "tree").withColumn("tall", height(F.col("size")))
    top = levels_above(manifest.n_trees)
    at_level = lambda level: F.shiftright(F.col("size") + (FAN**level - 1), 4 * level)
    held = manifest.nodes.select("tree", "level", "place", "node")
    sizes = {(r["up"], r["level"]): r["n"] for r in manifest.nodes.groupBy((F.col("tree") == TOP).alias("up"), "level").agg(F.count("*").alias("n")).collect()}

    def lookup(large: bool) -> DataFrame | None:
        levels = {up: [level for (u, level), n in sizes.items() if u == up and (n > BROADCAST_NODES) == large] for up in (False, True)}
        below = [k for k in levels[False] if k > 0]
        over = [_siblings(F.shiftright("top_place", 4 * k), F.lit(-(-manifest.n_trees // FAN**k)).cast("long"), F.lit(k), tall + k, F.lit(TOP)) for k in levels[True] if k < top]
        if not below and not over:
            return None
        inside = [F.when(tall > k, _siblings(F.shiftright("run", 4 * (k - 1)), at_level(k), F.lit(k), F.lit(k), F.col("tree"))).otherwise(F.array()) for k in below]
        asked = runs.select(F.col("tree").alias("of_tree"), "run", F.explode(F.concat(*inside, *over)).alias("c")).select("of_tree", "run", "c.*")
        wanted = held.where((F.when(F.col("tree") == TOP, F.col("level").isin(levels[True])).otherwise(F.col("level").isin(levels[False]))))
        return asked.join(wanted.hint("shuffle_merge") if large else F.broadcast(wanted), ["tree", "level", "place"])

    found = [x for x in map(lookup, (False, True)) if x is not None]
    found = found[0].unionByName(found[1]) if len(found) > 1 else found[0] if found else None
    none = F.array().cast("array<struct<step:int,place:bigint,before:boolean,node:string>>").alias("above")
    if found is None:
        both = runs.withColumn("above", none)
    else:
        above = found.groupBy(F.col("of_tree").alias("tree"), "run").agg(F.array_sort(F.collect_list(F.struct("step", "place", "before", "node"))).alias("above"))
        both = runs.join(above, ["tree", "run"], "left").withColumn("above", F.coalesce("above", none))
    side = lambda s, before: _joined(F.transform(F.filter("above", lambda u: (u["step"] == s) & (u["before"] == before)), lambda u: u["node"]))
    steps = F.filter(F.sequence(F.lit(0), F.lit(30)), lambda s: (s >= F.when(tall > 0, 1).otherwise(0)) & (s < tall + top))
    lined = both.withColumn("path", F.transform(steps, lambda s: F.struct(side(s, True).alias("left"), side(s, False).alias("right"))))
    each = lined.select("tree", "subroot", "tall", "path", "leaves", F.explode("leaves").alias("x"))
    own, start = F.col("x.place"), F.coalesce("x.tampered", "x.leaf")
    beside = _joined(F.transform(F.filter("leaves", lambda y: y["place"] != own), lambda y: y["leaf"]))
    run = _joined(F.transform("leaves", lambda y: F.when(y["place"] == own, start).otherwise(y["leaf"])))
    return each.select("x.doc_id", "tree", "x.leaf", "x.tampered", "subroot", F.when(tall > 0, digest(run)).otherwise(start).alias("first"), beside.alias("beside"), "path")


def verified_proofs(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of each row, with a fifth of the texts tampered.

    Where 5 divides crc32 of the id in decimals, the text's A-Z are lower-cased before its leaf is folded with the
    original siblings (null texts and null ids are left as they are). Null values count as ``-``.
    """
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    manifest = build_manifest(docs, F.when(hit, ascii_lower(F.col("text"))))
    tail = _joined(F.transform("path", lambda p: F.concat(p["left"], p["right"])))
    folded = F.aggregate("path", F.col("first"), lambda acc, p: digest(p["left"], acc, p["right"]))
    root = F.lit(manifest.root)
    out = proofs(manifest).select("doc_id", "leaf", "subroot", root.alias("root"), digest(F.col("beside"), tail).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
