"""Secret scans: fixed patterns, and a randomness battery over long runs of key-like characters.

Each candidate run is read in the encoding its characters suggest and tested against uniform random symbols of that
encoding: chi-squared uniformity of the alphabet, runs about the alphabet's middle, and lag-one serial correlation. The
least of the three p-values, times three, is uniform or larger for random runs and near zero for ordinary ones. Counts
over the whole corpus, for each encoding and length class, then give the least p-value at which the estimated share of
ordinary runs among the accepted ones stays within ``rate``: short runs, whose tests are weak, need more.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in the order in which spans with equal starts are listed.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
RUN = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
BINS, FLOOR = 200, 0.001

#: Characters at which a run is also read in parts, the least length of a run or part, and the least bits of a key.
SEPARATOR, SHORTEST, KEY_BITS = re.compile(r"[/_+-]+"), 20, 100 - 1e-9
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Alphabets in the order of their symbols' values; a run is read in the first that holds all its characters.
ENCODINGS = {"digits": DIGITS, "lower": LOWER, "upper": UPPER, "hex": DIGITS + "abcdef", "HEX": DIGITS + "ABCDEF", "base32": UPPER + "234567", "base36": DIGITS + LOWER, "BASE36": DIGITS + UPPER, "letters": UPPER + LOWER, "base62": UPPER + LOWER + DIGITS, "base64": UPPER + LOWER + DIGITS + "+/", "base64url": UPPER + LOWER + DIGITS + "-_", "base64mixed": UPPER + LOWER + DIGITS + "+/-_"}
VALUES = {name: {c: i for i, c in enumerate(alphabet)} for name, alphabet in ENCODINGS.items()}


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in order; of each kind the leftmost matches that do not overlap."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def battery(run: str) -> tuple[str, float] | None:
    """Encoding and combined p-value of a run; None if no encoding holds its characters, or if it is too short for a key in it.

    A key has 100 bits at least: 20 characters of base32 and up, but 22 of one case of letters and 31 digits.
    """
    run = run.rstrip("=")
    name = next((n for n, v in VALUES.items() if set(run) <= v.keys()), None)
    if name is None or len(run) * math.log2(len(ENCODINGS[name])) < KEY_BITS:
        return None
    values, n, size = np.array([VALUES[name][c] for c in run], float), len(run), len(ENCODINGS[name])
    counts = np.bincount(values.astype(int), minlength=size)
    chi = float(((counts - n / size) ** 2).sum() * size / n)
    uniform = _tail((chi - (size - 1)) / math.sqrt(2 * (size - 1) * (n - 1) / n))
    high = values >= size / 2
    a = int(high.sum())
    b = n - a
    runs, mean = 1 + int((high[1:] != high[:-1]).sum()), 1 + 2 * a * b / n
    spread = (mean - 1) * (mean - 2) / (n - 1)
    turns = 2 * _tail(abs(runs - mean) / math.sqrt(spread)) if spread > 0 else 0.0
    centred = values - values.mean()
    power = float((centred**2).sum())
    serial = 2 * _tail(abs(float((centred[1:] * centred[:-1]).sum()) / power + 1 / n) * math.sqrt(n)) if power else 0.0
    return name, min(1.0, 3 * min(uniform, turns, serial))


def stratum(name: str, n: int) -> str:
    """Encoding and length class; classes widen by a quarter."""
    return f"{name}:{int(math.log(n / 20) / math.log(1.25))}"


def _covered(base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The base spans, in order of their starts, as disjoint ones."""
    out: list[tuple[int, int]] = []
    for start, _, end in base:
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _free_parts(begin: int, end: int, covered: list[tuple[int, int]], at: int) -> tuple[list[tuple[int, int]], int]:
    """What of a run is not covered, and the first covered span that may matter to later runs."""
    while at < len(covered) and covered[at][1] <= begin:
        at += 1
    out, i = [], at
    while i < len(covered) and covered[i][0] < end:
        if covered[i][0] > begin:
            out.append((begin, covered[i][0]))
        begin = max(begin, covered[i][1])
        i += 1
    return [*out, (begin, end)] if begin < end else out, at


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, str, float]]:
    """(start, end, stratum, p) of runs, or of what base spans leave of them, in one sweep over both.

    A run with separators is also read in the parts between them; the parts count if one of them looks more random than the
    whole, as a key behind a path does.
    """
    out, at, covered = [], 0, _covered(base)
    for m in RUN.finditer(text):
        parts, at = _free_parts(m.start(), m.end(), covered, at)
        for begin, end in parts:
            if end - begin < SHORTEST:
                continue
            cuts = [begin, *(x for s in SEPARATOR.finditer(text, begin, end) for x in s.span()), end]
            pieces = [(a, b) for a, b in zip(cuts[::2], cuts[1::2], strict=True) if b - a >= SHORTEST]
            tested = [[(a, b, *found) for a, b in some if (found := battery(text[a:b]))] for some in ([(begin, end)], pieces)]
            best = max(tested, key=lambda t: max((x[3] for x in t), default=-1.0))
            out += [(a, b, stratum(name, b - a), p) for a, b, name, p in best]
    return out


SPAN = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
CANDIDATE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("stratum", pa.string()), ("p", pa.float64())]))


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, base and candidates of each row; a null text has neither."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            base = [base_spans(t) for t in texts]
            runs = [candidates(t, b) for t, b in zip(texts, base, strict=True)]
            spans = pa.array([[dict(zip(("start", "kind", "end"), x, strict=True)) for x in b] for b in base], SPAN)
            found = pa.array([[dict(zip(("start", "end", "stratum", "p"), x, strict=True)) for x in r] for r in runs], CANDIDATE)
            yield pa.RecordBatch.from_arrays([batch.column(0), spans, found], ["doc_id", "base", "candidates"])

    schema = "doc_id long, base array<struct<start: int, kind: int, end: int>>, candidates array<struct<start: int, end: int, stratum: string, p: double>>"
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(read, schema)


def acceptance(scanned: DataFrame, rate: float = 0.05) -> dict[str, float]:
    """The least accepted p-value of each stratum, from a histogram over all candidates (strata x bins rows at most).

    Random runs have uniform p-values, so twice the number above one half (plus one) estimates how many there are; the
    accepted runs beyond those are taken as ordinary. Strata of few candidates are judged by those next to them, too.
    """
    each = scanned.select(F.explode("candidates").alias("c")).select("c.stratum", F.least(F.floor(F.col("c.p") * BINS), F.lit(BINS - 1)).cast("int").alias("bin"))
    counts: dict[str, np.ndarray] = {}
    for r in each.groupBy("stratum", "bin").count().collect():
        counts.setdefault(r["stratum"], np.zeros(BINS))[r["bin"]] = r["count"]
    out = {}
    for name in counts:
        bins = _pooled(name, counts)
        total, random = bins.sum(), min(bins.sum(), 2 * bins[BINS // 2 :].sum() + 1)
        above = bins[::-1].cumsum()[::-1]
        expected = random * (1 - np.arange(BINS) / BINS)
        fine = np.flatnonzero((total > 0) & (above > 0) & (above - expected <= rate * above))
        out[name] = max(FLOOR, fine[0] / BINS) if len(fine) else 2.0
    return out


def _pooled(name: str, counts: dict[str, np.ndarray], least: int = 50) -> np.ndarray:
    """Counts of a stratum with those of the next length classes of its encoding, and at last all, until there are ``least``."""
    encoding, own = name.split(":")
    classes = {int(n.split(":")[1]): c for n, c in counts.items() if n.split(":")[0] == encoding}
    for reach in range(max(classes) - min(classes) + 1):
        bins = sum(c for k, c in classes.items() if abs(k - int(own)) <= reach)
        if bins.sum() >= least:
            return bins
    return sum(counts.values())


def _accepted(thresholds: dict[str, float]) -> Column:
    """Accepted candidates as spans of kind ``random``."""
    limits = F.create_map(*(F.lit(x) for pair in (thresholds or {"": 2.0}).items() for x in pair))
    kept = F.filter("candidates", lambda c: c["p"] >= F.coalesce(limits[c["stratum"]], F.lit(2.0)))
    return F.transform(kept, lambda c: F.struct(c["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), c["end"].alias("end")))


def listed(spans: Column) -> Column:
    """kind:start:end of spans by start, then kind, joined by commas."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(scanned: DataFrame, rate: float = 0.05) -> DataFrame:
    """doc_id, base and spans (base and accepted ones) from a materialised :func:`scan`, which is read twice."""
    return scanned.select("doc_id", "base", F.concat("base", _accepted(acceptance(scanned, rate))).alias("spans"))


def redact_secrets(docs: DataFrame, text: str = "text", rate: float = 0.05, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each secret span of ``text`` (touching spans as one) replaced by ``mark``; all columns and rows stay.

    Two passes over the texts, the first for the thresholds, and no shuffle of texts. Null texts stay null.
    """
    thresholds = acceptance(scan(docs.select(F.lit(0).alias("doc_id"), F.col(text).alias("text"))), rate)
    at = docs.columns.index(text)

    def clean(value: str | None) -> str | None:
        if not value:
            return value
        base = base_spans(value)
        spans = sorted([(s, e) for s, _, e in base] + [(s, e) for s, e, k, p in candidates(value, base) if p >= thresholds.get(k, 2.0)])
        out, done = [], 0
        for s, e in spans:
            if s >= done:
                out += [value[done:s], mark]
            done = max(done, e)
        return "".join([*out, value[done:]])

    def redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([clean(t) for t in batch.column(at).to_pylist()], batch.column(at).type)
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], texts, *batch.columns[at + 1 :]], schema=batch.schema)

    return docs.mapInArrow(redact, docs.schema)
