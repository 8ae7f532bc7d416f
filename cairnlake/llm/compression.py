"""Text classes by zstandard dictionaries: language by whole-text length, toxicity by windows."""

from __future__ import annotations

import math
import re
import sys
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Word characters that are numbers but no decimal digits, such as "½" and "Ⅷ": letters are the other word characters but digits.
NUMBERS = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
LETTER = re.compile(rf"[^\W\d_{NUMBERS}]")
NO_LETTER = re.compile(rf"[\W\d_{NUMBERS}]+")
SPACES = re.compile("  +")
WORD = re.compile(r"[^\W\d_]{3,}")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def compressor(data: bytes, size: int, match: int, kind: int = zstandard.DICT_TYPE_AUTO) -> zstandard.ZstdCompressor:
    """A compressor of pieces of ``size`` bytes with the dictionary ``data``; no match is shorter than ``match`` bytes.

    Its frames carry neither size, checksum nor dictionary id.
    """
    settings = zstandard.ZstdCompressionParameters.from_level(3, source_size=size, dict_size=len(data), min_match=match, write_content_size=False, write_dict_id=False)
    dictionary = zstandard.ZstdCompressionDict(data, dict_type=kind)
    dictionary.precompute_compress(compression_params=settings)
    return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=settings)


def sample_of_classes(rows: DataFrame, label: str, size: int, parts: int = 64) -> DataFrame:
    """At most ``size`` rows of each label, those with the least hash of their id.

    They are ranked in ``parts`` parts of each label first, so that no more than ``parts`` x ``size`` rows of a label meet in a
    task, however many there are.
    """
    placed = rows.withColumn("__part", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % parts)
    for keys in ([label, "__part"], [label]):
        order = Window.partitionBy(*keys).orderBy(F.xxhash64("doc_id"), "doc_id")
        placed = placed.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= size).drop("__n")
    return placed.drop("__part")


# --- language ---------------------------------------------------------------------------------------------------------


class Letters(dict):
    """What each character stands for, by its code: itself for a letter, else a space."""

    def __missing__(self, code: int) -> int:
        self[code] = code if chr(code).isalpha() else 32
        return self[code]


LETTERS = Letters()


def letters(text: str) -> bytes:
    """The lower-cased words of a text as UTF-16, where a literal costs more than its share of a match."""
    return SPACES.sub(" ", text.lower().translate(LETTERS)).encode("utf-16-le", errors="surrogatepass")


def learn_languages(docs: DataFrame, lang: str = "lang", text: str = "text", per_language: int = 256, snippet: int = 512) -> dict[str, bytes]:
    """A raw-content dictionary of each language: ``snippet`` characters from the middle of ``per_language`` documents at most.

    Rows without text, without a letter or without language teach nothing. The result holds at most
    languages x per_language x snippet characters.
    """
    rows = docs.select("doc_id", F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang IS NOT NULL AND text RLIKE '\\\\p{L}'")
    keys = sample_of_classes(rows.select("doc_id", "lang"), "lang", per_language).distinct()
    begin = F.greatest(F.lit(1), F.floor((F.char_length("text") - snippet) / 2).cast("int"))
    texts = rows.join(F.broadcast(keys), ["doc_id", "lang"], "left_semi").select("doc_id", "lang", F.substring("text", begin, F.lit(snippet)).alias("text"))
    found = sample_of_classes(texts, "lang", per_language).groupBy("lang").agg(F.array_sort(F.collect_list("text")).alias("texts")).collect()
    return {r["lang"]: b"".join(map(letters, r["texts"])) for r in sorted(found, key=lambda r: r["lang"])}


def identify_language(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", block: int = 4096, narrow: float = 0.01) -> DataFrame:
    """doc_id and held_out of ``docs`` with lang_pred, score and rejected, a row for each row.

    The letters of the whole text are compressed in blocks of ``block`` bytes with each language's dictionary; the smallest
    sum wins, ties go to the first name. margin = (second - best) / second and score = 1 - exp(-50 margin); rejected
    marks margins under ``narrow``, whose guess a caller should not trust. Texts that are null or without a letter, and all
    texts if nothing was learnt, get ``und`` with score 0 and are rejected. With one language learnt the margin is 1.
    """
    held = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packers = [(name, compressor(data, block, 6, zstandard.DICT_TYPE_RAWCONTENT)) for name, data in held.value.items()]
        for batch in batches:
            out = []
            for t in batch["text"]:
                if t is None or not packers or not LETTER.search(t):
                    out.append(("und", 0.0, True))
                    continue
                data = letters(t)
                sizes = sorted((sum(len(p.compress(data[at : at + block])) for at in range(0, len(data), block)), name) for name, p in packers)
                margin = (sizes[1][0] - sizes[0][0]) / sizes[1][0] if len(sizes) > 1 else 1.0
                out.append((sizes[0][1], 1 - math.exp(-50 * margin), margin < narrow))
            names, scores, rejected = zip(*out, strict=True) if out else ((), (), ())
            yield batch[["doc_id", "held_out"]].assign(lang_pred=names, score=np.array(scores, float), rejected=np.array(rejected, bool))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("held_out"), F.col(text).alias("text"))
    return rows.mapInPandas(predict, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


# --- toxicity ---------------------------------------------------------------------------------------------------------


def context_counts(texts: list[str], most: int = 1 << 18) -> Counter[str]:
    """How many distinct contexts (itself with the words before and after it, if any) each word of ``texts`` has.

    A word is held once and a context as three numbers, which are made distinct each time ``most`` have come.
    """
    number: dict[str, int] = {"": 0}
    seen, fresh = np.zeros((0, 3), np.int32), array("i")

    def merged() -> np.ndarray:
        return np.unique(np.concatenate([seen, np.frombuffer(fresh, np.int32).reshape(-1, 3)]), axis=0)

    for t in texts:
        before = middle = 0
        for m in WORD.finditer(t.lower()):
            after = number.setdefault(m.group(), len(number))
            if middle:
                fresh.extend((before, middle, after))
            before, middle = middle, after
        if middle:
            fresh.extend((before, middle, 0))
        if len(fresh) >= 3 * max(most, len(seen)):
            seen = merged()
            fresh = array("i")
    words, n = np.unique(merged()[:, 1], return_counts=True)
    names = list(number)
    return Counter({names[w]: k for w, k in zip(words.tolist(), n.tolist(), strict=True)})


def telling_segments(toxic: list[str], ordinary: list[str], size: int = 1024, least_gain: float = 40.0) -> list[str]:
    """Substrings of words that tell toxic texts from ordinary ones, the strongest first, of ``size`` characters in all.

    Counted are distinct contexts (the word with its two neighbours), so copies of a text count once. The gain of a substring
    is the log-likelihood ratio of its contexts; longer ones win between equals, and each takes the words it covers
    out of the count for the rest.
    """
    seen = [context_counts(texts) for texts in (toxic, ordinary)]
    n, m = (sum(c.values()) + 1 for c in seen)

    def gain(a: int, b: int) -> float:
        if a / n <= 4 * (b + 0.5) / m:
            return 0.0
        p = (a + b) / (n + m)
        return 2 * (a * math.log(a / n / p) + (b * math.log(b / m / p) if b else 0.0))

    def parts(word: str) -> set[str]:
        framed = f" {word} "
        return {framed[i:j] for i in range(len(framed) - 3) for j in range(i + 4, min(len(framed), i + 12) + 1)}

    live = {w: a for w, a in seen[0].items() if a >= 2 and gain(a, seen[1][w])}
    with_part: dict[str, list[str]] = {}
    for w in live:
        for x in parts(w):
            with_part.setdefault(x, []).append(w)
    inside = {x: sum(live[w] for w in words) for x, words in with_part.items()}
    held = {x for x, a in inside.items() if a >= 4}
    outside: Counter[str] = Counter()
    for w, b in seen[1].items():
        for x in parts(w) & held:
            outside[x] += b
    out: list[str] = []
    while sum(map(len, out)) < size:
        value = {x: g * (min(len(x), 8) - 2) for x in held if (g := gain(inside[x], outside[x])) > least_gain}
        if not value:
            break
        out.append(max(value, key=lambda x: (value[x], len(x), x)))
        for w in with_part[out[-1]]:
            if a := live.pop(w, 0):
                for x in parts(w):
                    inside[x] -= a
        held = {x for x in value if inside[x] >= 4}
    return out


class ToxicityModel:
    """Two zstandard dictionaries, one of ordinary text and one that ends in segments of toxic text.

    The segments are chosen by a likelihood ratio, so the toxic dictionary is in effect a list of learnt word parts behind
    the base that both share: dictionaries that zstandard trains from toxic and from ordinary windows alone hold mostly
    the same common words, and told held-out texts apart much worse (figures in the README).

    Text is compressed in overlapping windows of UTF-16 code units: a literal then costs more than its share of a match,
    so that one telling word changes a window's length by bytes. Both dictionaries share a trained base (its entropy tables,
    and ordinary content at equal distances), so ordinary windows get nearly equal lengths. A window's evidence is its
    length with the ordinary dictionary less that with the toxic one; its threshold is a quantile over ordinary windows.
    The score is a logistic function of the mean and greatest evidence, of the sum beyond the threshold and of the number of
    windows. Half of the labelled sample makes the dictionaries, the other half calibrates.
    """

    def __init__(self, window: int = 160, overlap: int = 24, base: int = 16_384, tail: int = 1_024) -> None:
        self.window, self.step, self.base, self.tail = window, window - overlap, base, tail
        self.ordinary = self.toxic = b""
        self.threshold, self.weights, self.rate = 0.0, None, 0.0
        self._packers = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_packers": None}

    def windows(self, text: str) -> list[bytes]:
        data = text.lower().encode("utf-16-le", errors="surrogatepass")
        return [data[at : at + 2 * self.window] for at in range(0, max(1, len(data) - 2 * (self.window - self.step)), 2 * self.step)]

    def evidence(self, text: str) -> np.ndarray:
        if self._packers is None:
            self._packers = tuple(compressor(data, 2 * self.window, 7) for data in (self.ordinary, self.toxic))
        a, b = (p.compress for p in self._packers)
        return np.array([len(a(w)) - len(b(w)) for w in self.windows(text)], float)

    def features(self, evidence: np.ndarray) -> list[float]:
        beyond = evidence[evidence > self.threshold]
        return [1.0, evidence.mean(), evidence.max(), math.log1p(float((beyond - self.threshold).sum())), math.log1p(len(evidence))]

    def fit(self, rows: list[tuple[str, int]]) -> ToxicityModel:
        """rows: (text, label) in a fixed order. Without rows of both labels every score is the share of label 1."""
        self.rate = sum(y for _, y in rows) / len(rows) if rows else 0.0
        half = [[r for i, r in enumerate(rows) if i % 2 == k] for k in (0, 1)]
        if any(len({y for _, y in h}) < 2 for h in half):
            return self
        toxic, ordinary = ([t for t, y in half[0] if y == k] for k in (1, 0))
        pieces = [w for t in ordinary for w in self.windows(t)]
        try:
            base = zstandard.train_dictionary(self.base, pieces, level=3).as_bytes()
        except zstandard.ZstdError:  # too few windows to train on
            base = b"".join(pieces)[: self.base]
        tail = "".join(reversed(telling_segments(toxic, ordinary, self.tail))).encode("utf-16-le")
        self.toxic, self.ordinary = base + tail, base + bytes(1 + 7 * i % 8 for i in range(len(tail)))  # control characters match nothing
        found = [(self.evidence(t), y) for t, y in half[1]]
        self.threshold = float(np.quantile(np.concatenate([e for e, y in found if not y]), 0.99))
        x, y = np.array([self.features(e) for e, _ in found]), np.array([y for _, y in found], float)
        weights = np.zeros(x.shape[1])
        for _ in range(50):  # Newton's method with a ridge
            p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
            hess = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(x.shape[1])
            step = np.linalg.solve(hess, x.T @ (y - p) - 0.05 * weights)
            weights += step
            if np.abs(step).max() < 1e-6:
                break
        self.weights = weights
        return self

    def score(self, text: str | None) -> float:
        if self.weights is None:
            return self.rate
        return 1 / (1 + math.exp(-min(30.0, max(-30.0, float(np.dot(self.features(self.evidence(text or "")), self.weights))))))


def learn_toxicity(docs: DataFrame, labels: DataFrame, per_label: int = 2500, longest: int = 16_384, **settings: int) -> ToxicityModel:
    """Fit on at most ``per_label`` rows of each label, of documents of at most ``longest`` characters.

    A document with several labels counts once, with the highest. Null labels, ids and texts teach nothing.
    """
    label = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    fitting = docs.select("doc_id", F.char_length("text").alias("size")).where(F.col("size") <= longest)
    keys = sample_of_classes(label.join(fitting, "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "toxic", per_label)
    rows = docs.select("doc_id", "text").where(F.char_length("text") <= longest).join(F.broadcast(keys), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    found = sorted((r["doc_id"], r["text"], int(r["toxic"] > 0)) for r in rows.collect())
    return ToxicityModel(**settings).fit([(t, y) for _, t, y in found])


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", limit: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from ``limit`` on), a row for each row; null texts are scored as empty."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = held.value
        for batch in batches:
            scores = np.array([own.score(t) for t in batch["text"]], float)
            yield batch[["doc_id", "held_out"]].assign(score=scores, predicted=(scores >= limit).astype("int32"))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("held_out"), F.col(text).alias("text"))
    return rows.mapInPandas(score, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: ToxicityModel, text: str = "text", limit: float = 0.7) -> DataFrame:
    """The rows of ``docs`` with a score under ``limit``, with all their columns; no shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in batches:
            yield batch.filter(pa.array([own.score(t) < limit for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
