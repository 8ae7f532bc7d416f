"""Document fingerprints from Lempel-Ziv phrases: the least hashes of the set of phrases that LZ78 cuts a text into.

Two texts that help to compress each other share phrases; the share of common hashes among the least ones of both sets estimates
the Jaccard likeness of the sets, and is exact for sets that are no larger than a signature.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases a dictionary holds before it starts afresh; bounds the memory of a text of any length.
MOST_PHRASES = 1 << 16
SIGNATURE = 128
DIGITS = 10
#: Characters hashed at once.
SPAN = 1 << 17
_BASE = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


POWER, BACK = _powers(_BASE, SPAN + 1), _powers(pow(_BASE, -1, 1 << 64), SPAN + 1)


def parse(text: str, begin: int, end: int, known: set[str], most: int = MOST_PHRASES) -> tuple[list[int], int]:
    """Ends of the phrases of ``text[begin:end]``, and where a rest that is itself a known phrase begins (else ``end``).

    A phrase is the longest known one and a further character; it is added to ``known``, which is emptied when it holds
    ``most``.
    """
    ends: list[int] = []
    add, ended, phrase = known.add, ends.append, ""
    for at, char in enumerate(text[begin:end], begin + 1):
        phrase += char
        if phrase not in known:
            add(phrase)
            ended(at)
            phrase = ""
            if len(known) >= most:
                known.clear()
    return ends, end - len(phrase)


def _least(hashes: np.ndarray) -> np.ndarray:
    return np.unique(hashes)[:SIGNATURE]


def _hashes(text: str, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Hash of each phrase ``text[start:stop]``, which depends on the phrase alone; starts ascend."""
    out, i = np.empty(len(stops), np.uint64), 0
    while i < len(stops):
        first = int(starts[i])
        j = len(stops) if len(text) - first <= SPAN else max(i + 1, int(np.searchsorted(stops, first + SPAN, side="right")))
        codes = np.frombuffer(text[first : int(stops[j - 1])].encode("utf-32-le", errors="surrogatepass"), np.uint32) + np.uint64(1)
        total = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * POWER[: len(codes)], out=total[1:])
        a, b = starts[i:j] - first, stops[i:j] - first
        x = (total[b] - total[a]) * BACK[a] + (b - a).astype(np.uint64)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        out[i:j] = (x ^ (x >> np.uint64(31))) >> np.uint64(64 - 4 * DIGITS)
        i = j
    return out


def _bounds(begin: int, ends: list[int]) -> tuple[np.ndarray, np.ndarray]:
    bounds = np.array([begin, *ends], np.int64)
    return bounds[:-1], bounds[1:]


def signature(text: str) -> np.ndarray:
    """Sorted least hashes of a text's phrases; an empty text has none."""
    return _least(_hashes(text, *_bounds(0, parse(text, 0, len(text), set())[0])))


def both_signatures(text: str, tail: str) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of ``text`` and of the text whose last ``floor(n / 2)`` characters are replaced by ``tail``.

    Both begin alike, so the common phrases are found once.
    """
    same = len(text) - len(text) // 2
    known: set[str] = set()
    ends, at = parse(text, 0, same, known)
    common, further = len(ends), set(known)
    ends += parse(text, at, len(text), further)[0]
    edited = text[at:same] + tail
    starts, stops = _bounds(0, ends)
    more_starts, more_stops = _bounds(len(text), [len(text) + e for e in parse(edited, 0, len(edited), known)[0]])
    hashes = _hashes(text + edited, np.append(starts, more_starts), np.append(stops, more_stops))
    return _least(hashes[: len(ends)]), _least(np.append(hashes[:common], hashes[len(ends) :]))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of common hashes among the least ones of both; 1 for two empty signatures."""
    both = np.sort(np.append(a, b))
    if not len(both):
        return 1.0
    again = both[1:] == both[:-1]
    rank = np.arange(1, len(both)) - np.cumsum(again)  # of each hash but the first one among the different ones, from 0
    least = min(SIGNATURE, len(both) - int(again.sum()))
    return float((again & (rank < least)).sum() / least)


def spelled(hashes: np.ndarray) -> str:
    return hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - DIGITS // 2 :].tobytes().hex()


def read(fingerprint: str) -> np.ndarray:
    """The signature that :func:`spelled` wrote."""
    return np.array([int(fingerprint[i : i + DIGITS], 16) for i in range(0, len(fingerprint), DIGITS)], np.uint64)


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fingerprint) of each row's whole text; null counts as empty, whose fingerprint is the empty string."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([spelled(signature(t)) for t in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(run, f"doc_id {kind}, fingerprint string")


# --- each document beside the next ------------------------------------------------------------------------------------


def _bucket(edges: list[int], doc_id: Column, tie: Column) -> Column:
    """Number of the id's bucket in descending order: ids between two of the sorted ``edges`` share one, null ids come last.

    Null ids are all equal; they are dealt over 16 buckets by the leading bits of ``tie``.
    """
    width = max(1, int(len(edges) ** 0.5))
    groups = [edges[i : i + width] for i in range(0, len(edges), width)]
    no_edge = F.lit(0)
    if not edges:
        return F.when(doc_id.isNull(), 1 + 8 + F.shiftright(tie, 60)).otherwise(no_edge).cast("int")
    below = lambda sorted_edges: F.size(F.filter(sorted_edges, lambda e: e <= doc_id))
    firsts = F.array(*(F.lit(g[0]).cast("long") for g in groups))
    lists = F.array(*(F.array(*(F.lit(e).cast("long") for e in g)) for g in groups))
    group = below(firsts)
    up = F.when(group == 0, 0).otherwise((group - 1) * width + below(F.element_at(lists, F.greatest(group, F.lit(1)))))
    return F.when(doc_id.isNull(), len(edges) + 1 + 8 + F.shiftright(tie, 60)).otherwise(len(edges) - up).cast("int")


FIELDS = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]


def _beside_next(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by bucket in descending order; the last of a bucket is the head of the next one and not described itself."""
    schema = pa.schema(FIELDS)
    waiting: dict | None = None  # described but for near_next
    text, row = None, (None, None)
    for batch in batches:
        out = []
        for bucket, doc_id, extra, now in zip(*(batch.column(n).to_pylist() for n in ("bucket", "doc_id", "extra", "text")), strict=True):
            if text is not None and row[0] == bucket:
                half = len(text) // 2
                tail = now[:half]
                own, edited = both_signatures(text, tail)
                if waiting is not None:
                    out.append({**waiting, "near_next": likeness(waiting.pop("own"), own)})
                sha = hashlib.sha256((text[: len(text) - half] + tail).encode(errors="surrogatepass")).hexdigest()
                waiting = {"doc_id": row[1], "n_chars": len(text), "edited_sha256": sha, "fingerprint": spelled(own), "edited_fingerprint": spelled(edited), "near_edited": likeness(own, edited), "own": own}
            text, row = now, (bucket, doc_id)
            if extra and waiting is not None:
                out.append({**waiting, "near_next": likeness(waiting.pop("own"), signature(now))})
                waiting, text = None, None
        for x in out:
            x.pop("own", None)
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def edited_likeness(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of each row of ``docs``.

    The next document is the next lower id, null ids last, after the last one the first; rows of one id go by a hash of
    their texts and then the texts. The edited text has its last floor(n / 2) characters replaced by the next document's
    first as many, or all it has. Null texts count as empty; two empty texts have likeness 1. A lone row is its own next
    document. An empty table gives none; other columns are not read.

    Texts are shuffled once, into buckets between quantiles of the ids, and each task goes through its sorted buckets with two
    texts in hand. A bucket also gets the first row of the next one: a row a bucket, whose number is that of the shuffle
    partitions and 16 more. Rows that repeat one id that is not null share a bucket, whose task reads them one after the other.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    cuts = own.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], F.lit(100 * parts)).alias("cuts")).first()["cuts"]
    tie = F.xxhash64("text")
    placed = own.select(_bucket(sorted(set(cuts or [])), F.col("doc_id"), tie).alias("bucket"), "doc_id", tie.alias("tie"), "text")
    tops = placed.groupBy("bucket").agg(F.max("doc_id").alias("top"), F.min(F.when(F.col("doc_id").isNull(), F.col("tie"))).alias("tie")).orderBy("bucket").collect()
    if not tops:
        return spark.createDataFrame([], "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    numbers = [r["bucket"] for r in tops]
    wanted = F.broadcast(spark.createDataFrame([(r["bucket"], r["top"], r["tie"], numbers[i - 1]) for i, r in enumerate(tops)], "bucket int, top long, least long, target int"))
    heads = placed.join(wanted, "bucket").where("doc_id <=> top AND (doc_id IS NOT NULL OR tie = least)").groupBy("target").agg(F.min(F.struct("tie", "text", "doc_id")).alias("h"))
    rows = placed.withColumn("extra", F.lit(False)).unionByName(heads.select(F.col("target").alias("bucket"), "h.doc_id", "h.tie", "h.text", F.lit(True).alias("extra")))
    dealt = rows.repartitionById(max(numbers) + 1, "bucket").sortWithinPartitions("bucket", "extra", F.desc_nulls_last("doc_id"), "tie", "text")
    return dealt.select("bucket", "doc_id", "extra", "text").mapInArrow(_beside_next, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
