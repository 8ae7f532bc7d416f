"""Token ids as Parquet list columns: encode, write in doc_id order, read selectively.

Ids are stored as ``array<int>`` with dictionary pages (a vocabulary fits one dictionary), ids of documents and row numbers
with delta encoding (format v2), row groups of a fixed size and small pages, whose page indexes let a reader of a few
doc_ids skip the rest of the token column.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairnlake.session import durable

#: Parquet writer settings of a token file: dictionary pages for the ids, delta encoding for the ascending columns.
LAYOUT = {
    "compression": "zstd",
    "parquet.writer.version": "v2",
    "parquet.enable.dictionary": "true",
    **{f"parquet.enable.dictionary#{c}": "false" for c in ("doc_id", "shard", "row")},
    "parquet.block.size": str(64 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "512",
}

#: Texts in which the tokenizer's pattern may take white space as one run, or that hold any but spaces and line ends.
_ODD_SPACE = "".join(f"\\x{{{ord(c):x}}}" for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")
IRREGULAR = rf"  |\n\n| \n|\n |[{_ODD_SPACE}]| \z"
#: Letters of Latin scripts with signs of ASCII behind them (no apostrophe, which may begin a contraction): two pretokens.
LATIN = r"[A-Za-z\x{aa}\x{b5}\x{ba}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]+"
SIGNED = rf"\A(?P<stem>{LATIN})(?P<signs>[!-&(-/:-@\[-`{{-~]+)\z"


def _in_turn(data: np.ndarray, size: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries ``code`` one after the other, and their ends; ``data`` holds entries of ``size`` numbers."""
    length = size[code]
    ends = np.cumsum(length)
    return data[np.repeat((np.cumsum(size) - size)[code] - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)], ends


class Encoder:
    """A byte-level BPE file of the ``tokenizers`` library, called once for each distinct word of many texts.

    In a text whose white space is single spaces and line ends, each of these begins a pretoken: a space belongs to the word
    behind it and a line end stands alone. Such texts are split and their words numbered by Arrow, signs behind letters
    are cut off the distinct words, what is left goes to the library, and numpy puts the ids together; other texts go to
    the library whole. Nothing is remembered from call to call.
    """

    def __init__(self, path: str, end_id: int) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism; threads of the library cost memory
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id = Tokenizer.from_file(path), end_id
        self.model = Tokenizer(self.tokenizer.model)  # takes pretokens, whose bytes are spelt by the characters of ``spelling``
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        space = self.tokenizer.pre_tokenizer.pre_tokenize_str(" ")[0][0]
        self.spaced = np.zeros(max(names.values()) + 1, bool)
        self.spaced[[i for name, i in names.items() if name.startswith(space)]] = True
        #: Characters behind which some token holds a space; only behind these could a merge cross into the next word.
        self.clinging = sorted({a for name in names for a, b in pairwise(name) if b == space and a != space})
        self.spelling = np.zeros(256, "<u2")
        for char in map(chr, range(0x250)):
            self.spelling[list(char.encode())] = [ord(c) for c in self.tokenizer.pre_tokenizer.pre_tokenize_str(char)[0][0]]

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and how many each has."""
        data, size = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for at in range(0, len(texts), 256):  # the library's results take many times the room of the ids
            found = [e.ids for e in self.tokenizer.encode_batch_fast(texts[at : at + 256], add_special_tokens=False)]
            data.append(np.fromiter(chain.from_iterable(found), np.int32))
            size.append(np.fromiter(map(len, found), np.int64, len(found)))
        return np.concatenate(data), np.concatenate(size)

    def _behind_spaces(self, words: pa.Array, latin: bool) -> tuple[np.ndarray, np.ndarray]:
        """The same of words behind a space each: joined calls, cut at the tokens that begin with a space.

        Words of Latin letters are pretokens and go to the library's model as such, many in a row where no token of the
        vocabulary could reach from one into the space of the next.
        """
        ids = [np.zeros(0, np.int32)]
        for at in range(0, len(words), 4096):
            part = words.slice(at, 4096)
            joined = " " + pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part), " ")[0].as_py()
            if latin:
                spelt, space = self.spelling[np.frombuffer(joined.encode(), np.uint8)].tobytes().decode("utf-16-le"), chr(self.spelling[32])
                for end in self.clinging:
                    spelt = spelt.replace(end + space, f"{end}\n{space}")
                found = self.model.encode_batch_fast([spelt.split("\n")], is_pretokenized=True, add_special_tokens=False)
            else:
                found = self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)
            ids.append(np.array(found[0].ids, np.int32))
        data = np.concatenate(ids)
        return data, np.diff(np.append(np.flatnonzero(self.spaced[data]), len(data)))

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same of distinct words behind a space each; a word that begins with a line end stands behind that instead."""
        latin = pc.match_substring_regex(words, rf"\A{LATIN}\z").to_numpy(zero_copy_only=False)
        begun = pc.starts_with(words, "\n").to_numpy(zero_copy_only=False)
        kinds = [latin, begun, ~(latin | begun)]
        own = [words.filter(pa.array(k)) for k in kinds]
        found = [self._behind_spaces(own[0], True), self._plain(own[1].to_pylist()), self._behind_spaces(own[2], False)]
        code = np.zeros(len(words), np.int64)
        code[np.concatenate([np.flatnonzero(k) for k in kinds])] = np.arange(len(words))
        size = np.concatenate([s for _, s in found])
        return _in_turn(np.concatenate([d for d, _ in found]), size, code)[0], size[code]

    def _distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same, with the signs behind letters apart."""
        parts = pc.extract_regex(words, SIGNED)
        held = pc.is_valid(parts)
        signed = held.to_numpy(zero_copy_only=False)
        stems = pc.dictionary_encode(pc.if_else(held, pc.struct_field(parts, "stem"), words))
        signs = pc.dictionary_encode(pc.struct_field(parts, "signs").filter(held))
        (data, size), (more, more_size) = self._words(stems.dictionary), self._plain(signs.dictionary.to_pylist())
        code = np.full(len(words) + int(signed.sum()), -1, np.int64)
        code[np.flatnonzero(signed) + np.arange(1, signed.sum() + 1)] = len(size) + signs.indices.to_numpy()
        code[code < 0] = stems.indices.to_numpy()
        size = np.append(size, more_size)
        begins = np.arange(len(words)) + np.cumsum(signed) - signed
        return _in_turn(np.append(data, more), size, code)[0], np.add.reduceat(size[code], begins) if len(words) else size[:0]

    def encode(self, texts: pa.Array, most: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of texts one after the other, each with the end id, and the bounds of the texts, about ``most`` words at a time.

        Null texts are empty.
        """
        texts = pc.fill_null(texts.cast(pa.string()), "")
        n, odd = len(texts), pc.match_substring_regex(texts, IRREGULAR)
        split = pc.split_pattern(pc.replace_substring(pc.if_else(odd, "", texts), "\n", " \n"), " ")
        bounds, flat = split.offsets.to_numpy() - (split.offsets[0].as_py() if n else 0), split.flatten()
        leads = np.zeros(len(flat), bool)
        leads[bounds[:-1]] = True
        first = pc.if_else(odd, texts, flat.filter(pa.array(leads)))  # a text's first word, or all of an irregular text
        numbered = pc.dictionary_encode(flat.filter(pa.array(~leads)))
        (data, size), (more, more_size) = self._distinct(numbered.dictionary), self._plain(first.to_pylist())
        # entries: the distinct words, the texts' beginnings, and the end id
        code = np.full(len(flat) + n, -1, np.int32)
        code[bounds[:-1] + np.arange(n)] = len(size) + np.arange(n)
        code[bounds[1:] + np.arange(n)] = len(size) + n
        code[code < 0] = numbered.indices.to_numpy()
        data, size = np.concatenate([data, more, [self.end_id]]).astype(np.int32), np.concatenate([size, more_size, [1]])
        bounds = bounds + np.arange(n + 1)
        cuts = np.flatnonzero(np.diff(bounds[1:] // most, prepend=0)) + 1
        for at, end in pairwise(np.unique([0, *cuts, n]).tolist()):
            ids, ends = _in_turn(data, size, code[bounds[at] : bounds[end]])
            yield ids, np.append(0, ends[bounds[at + 1 : end + 1] - bounds[at] - 1])


#: Bytes of texts encoded together, about; a longer text is encoded alone.
SLICE = 9 << 20

#: One encoder a Python worker, kept for its next tasks.
ENCODERS: dict[tuple[str, int], Encoder] = {}


def encode_documents(docs: DataFrame, vocabulary: str, end_id: int = 0, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and ids (``array<int>``, end id included) of each row; null texts count as empty."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ENCODERS.get((vocabulary, end_id)) or Encoder(vocabulary, end_id)
        ENCODERS[vocabulary, end_id] = encoder
        for batch in batches:
            size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            cuts = np.flatnonzero(np.diff(size // SLICE, prepend=0)) + 1
            for at, end in pairwise(np.unique([0, *cuts, batch.num_rows]).tolist()):
                for ids, bounds in encoder.encode(batch.column(1).slice(at, end - at)):
                    lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(lists)), lists], ["doc_id", "ids"])
                    at += len(lists)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(encode, "doc_id long, ids array<int>")


def write_token_files(docs: DataFrame, path: str, vocabulary: str, end_id: int = 0, text: str = "text", doc_id: str = "doc_id") -> None:
    """Write the ids of ``docs`` to ``path`` in ascending doc_id order (nulls first; rows that repeat an id stay, next to each other).

    Columns: doc_id, shard (number of the file in id order), row (ascends in the order of all files) and ids. One range
    shuffle of texts; an empty table gives files without rows. Only the two named columns of ``docs`` are read.
    """
    ordered = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ids = encode_documents(ordered, vocabulary, end_id)
    ids.select("doc_id", F.spark_partition_id().alias("shard"), F.monotonically_increasing_id().alias("row"), "ids").write.options(**LAYOUT).parquet(path)


def read_token_files(spark: SparkSession, path: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """The rows of a token file with ``low <= doc_id < high``; the bounds reach the scan's row groups and pages."""
    rows = spark.read.schema("doc_id long, shard int, row long, ids array<int>").parquet(path)
    rows = rows if low is None else rows.where(F.col("doc_id") >= low)
    return rows if high is None else rows.where(F.col("doc_id") < high)


def token_statistics(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each row of a whole token file.

    start counts the ids of all rows before it: a running sum inside each shard, and the shards' totals (a row a file).
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            ends, values = lists.offsets.to_numpy(), memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<i4")).cast("B")
            crc = np.array([zlib.crc32(values[4 * a : 4 * b]) for a, b in zip(ends, ends[1:], strict=False)], np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(ends).astype(np.int64)), pa.array(crc)], ["doc_id", "shard", "row", "n_tokens", "ids_crc32"])

    rows = durable(tokens.select("doc_id", "shard", "row", "ids").mapInArrow(measure, "doc_id long, shard int, row long, n_tokens long, ids_crc32 long"))
    files = rows.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("shard", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return placed.join(F.broadcast(files), "shard").select("doc_id", (F.col("offset") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
