"""SentencePiece BPE by vectorised merge rounds.

A text is cut before each run of spaces (no piece of the vocabulary holds a space mark behind another character, which is
checked), and the distinct words of a batch are encoded together: one flat array of symbols, in each round the best rank
of every word by a segmented minimum, all merges of that rank at once from left to right, then compaction; words
without a mergeable pair leave the arrays. Two generations of short words are remembered between batches, each bounded by
its characters; long words are encoded where they occur and forgotten with their group of texts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
WORDS = re.compile(r" +[^ ]*")
#: Characters of the longest word that is remembered, of the words of a generation, and of the texts encoded together.
LONGEST, REMEMBER, TOGETHER = 48, 3_000_000, 1 << 20
NONE = np.iinfo(np.int64).max


class PieceModel:
    """Vocabulary of a SentencePiece BPE file with byte fallback, identity normalisation and a dummy prefix."""

    def __init__(self, path: str, remember: int = REMEMBER) -> None:
        import sentencepiece

        table = sentencepiece.SentencePieceProcessor(model_file=path)
        size = table.get_piece_size()
        names = [table.id_to_piece(i) for i in range(size)]
        self.bytes_of = [b""] * size
        self.byte_id, pieces = [0] * 256, {}
        for i, name in enumerate(names):
            if table.is_byte(i):
                value = int(name[3:5], 16)
                self.byte_id[value], self.bytes_of[i] = i, bytes([value])
            elif not (table.is_control(i) or table.is_unknown(i) or table.is_unused(i)):
                pieces[name], self.bytes_of[i] = i, name.replace(MARK, " ").encode()
        if any(MARK in name.lstrip(MARK) for name in pieces):
            raise ValueError("a piece holds a space mark behind another character")
        # A symbol is a piece, or a character that occurs in pieces without being one; others get numbers as they come.
        self.symbols = dict(pieces)
        for name in pieces:
            for char in name:
                self.symbols.setdefault(char, size + len(self.symbols))
        self.pieces, self.base = size, 2 * size + len(self.symbols)
        order = {s: r for r, s in enumerate(sorted({table.get_score(i) for i in pieces.values()}, reverse=True))}
        pairs = sorted((self.symbols[name[:k]] * self.base + self.symbols[name[k:]], order[table.get_score(i)], i) for name, i in pieces.items() for k in range(1, len(name)) if name[:k] in self.symbols and name[k:] in self.symbols)
        self.keys, self.ranks, self.merged = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        self.end, self.remember, self.ids, self.surface, self.old, self.held = table.eos_id(), remember, {}, {}, ({}, {}), 0

    def _spell(self, symbol: int, char: str) -> list[int]:
        return [symbol] if symbol < self.pieces else [self.byte_id[b] for b in char.encode()]

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE if the pair is no piece) and piece of each pair."""
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE), self.merged[at]

    def _rounds(self, words: list[str]) -> list[list[int]]:
        """Ids of words, each with its space marks, whatever their lengths.

        A round merges the best pair of every word wherever it stands, from left to right without overlap. Where one of
        these merges makes a pair that is as good or better, which one merge after the other would take before the
        rest, that word takes only its leftmost merge in this round.
        """
        if not words:
            return []
        sizes = np.array([len(w) for w in words])
        chars = "".join(words)
        symbol = np.array([self.symbols.get(c, self.base - 1) for c in chars], np.int64)
        origin, word = np.arange(len(chars)), np.repeat(np.arange(len(words)), sizes)
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rank, piece = self._look_up(symbol, np.append(symbol[1:], 0))
        rank[np.append(word[1:] != word[:-1], True)] = NONE
        while len(word):
            begins = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            length = np.diff(np.append(begins, len(word)))
            least = np.repeat(np.minimum.reduceat(rank, begins), length)
            over = least == NONE
            if over.any():
                kept.append((word[over], origin[over], symbol[over]))
                symbol, origin, word, rank, piece, least = (x[~over] for x in (symbol, origin, word, rank, piece, least))
                if not len(word):
                    break
            at = np.flatnonzero(rank == least)
            starts = np.append(True, np.diff(at) > 1)
            run = np.flatnonzero(starts)[np.cumsum(starts) - 1]
            hit = at[(np.arange(len(at)) - run) % 2 == 0]  # of merges that overlap in a row every other one, from the left
            first = np.append(True, word[hit[1:]] != word[hit[:-1]])[: len(hit)]
            merged = self._merged(symbol, word, rank, piece, least, hit)
            if not first.all() and (early := merged[-1]).any():
                hit = hit[first | ~np.isin(word[hit], merged[1][early])]
                merged = self._merged(symbol, word, rank, piece, least, hit)
            stay = merged[-2]
            symbol, word, rank, piece, origin = *merged[:4], origin[stay]
        w, o, s = (np.concatenate(x) for x in zip(*kept, strict=True))
        order = np.lexsort((o, w))
        out: list[list[int]] = [[] for _ in words]
        for a, b, c in zip(w[order].tolist(), o[order].tolist(), s[order].tolist(), strict=True):
            if c < self.pieces:
                out[a].append(c)
            else:
                out[a] += self._spell(c, chars[b])
        return out

    def _merged(self, symbol: np.ndarray, word: np.ndarray, rank: np.ndarray, piece: np.ndarray, least: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, ...]:
        """symbol, word, rank and piece after the merges at ``hit``, which rows stay, and where a new pair is as good as the old."""
        symbol = symbol.copy()
        symbol[hit] = piece[hit]
        stay, changed = np.ones(len(word), bool), np.zeros(len(word), bool)
        stay[hit + 1] = False
        changed[hit] = True
        symbol, word, rank, piece, least, changed = (x[stay] for x in (symbol, word, rank, piece, least, changed))
        changed[:-1] |= changed[1:]
        where = np.flatnonzero(changed)
        follows = np.minimum(where + 1, len(word) - 1)
        new, made = self._look_up(symbol[where], symbol[follows])
        new[(where + 1 >= len(word)) | (word[follows] != word[where])] = NONE
        early = np.zeros(len(word), bool)
        early[where] = new <= least[where]
        rank[where], piece[where] = new, made
        return symbol, word, rank, piece, stay, early

    def decode(self, ids: list[int]) -> str:
        """Text of ids: control ids are silent, bytes that are no UTF-8 become U+FFFD, and the dummy prefix goes."""
        text = b"".join(map(self.bytes_of.__getitem__, ids)).decode(errors="replace")
        return text[1:] if text[:1] == " " else text

    def encoded(self, words: list[str]) -> Iterator[tuple[str, str, bytes]]:
        """Each word, which begins with its spaces, with its ids and its surface."""
        for w, ids in zip(words, self._rounds([w.replace(" ", MARK) for w in words]), strict=True):
            yield w, " ".join(map(str, ids)), b"".join(map(self.bytes_of.__getitem__, ids))

    def words(self, text: str) -> list[str]:
        return WORDS.findall(" " + text.replace(MARK, " ")) if text else []

    def encode_batch(self, texts: list[str]) -> Iterator[tuple[str, str]]:
        """Decimal ids with the end id, joined by spaces, and the decoded text of each text.

        Texts are taken in groups of ``TOGETHER`` characters (a longer text is a group of its own), which bounds what the
        merge rounds and the long words of a group hold.
        """
        group, size = [], 0
        for text in texts:
            if group and size + len(text) > TOGETHER:
                yield from self._encode_group(group)
                group, size = [], 0
            group.append(text)
            size += len(text)
        yield from self._encode_group(group)

    def _encode_group(self, texts: list[str]) -> Iterator[tuple[str, str]]:
        if self.held > self.remember:
            self.old, self.ids, self.surface, self.held = (self.ids, self.surface), {}, {}, 0
        split = [self.words(t) for t in texts]
        long_ids: dict[str, str] = {}
        long_surface: dict[str, bytes] = {}
        fresh = []
        for w in set().union(*split):
            if w in self.ids:
                continue
            if w in self.old[0]:
                self.ids[w], self.surface[w] = self.old[0][w], self.old[1][w]
                self.held += len(w)
            else:
                fresh.append(w)
        for w, ids, surface in self.encoded(fresh):
            if len(w) > LONGEST:
                long_ids[w], long_surface[w] = ids, surface
            else:
                self.ids[w], self.surface[w] = ids, surface
                self.held += len(w)
        if long_ids:
            ids_of, surface_of = lambda w: self.ids.get(w) or long_ids[w], lambda w: self.surface[w] if w in self.surface else long_surface[w]
        else:
            ids_of, surface_of = self.ids.__getitem__, self.surface.__getitem__
        for own in split:
            decoded = b"".join(map(surface_of, own))
            yield " ".join([*map(ids_of, own), str(self.end)]), (decoded[1:] if decoded[:1] == b" " else decoded).decode(errors="replace")


#: One model a Python worker, kept for its next tasks.
MODELS: dict[str, PieceModel] = {}


def encode_pieces(docs: DataFrame, model: str, text: str = "text", doc_id: str = "doc_id", with_text: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row; ``with_text`` adds ids (``array<int>``) and decoded.

    ids are those of the SentencePiece library with an end id and no sampling. A null text counts as empty and has the end
    id alone. Rows are independent: repeated ids or rows, and other columns of ``docs``, change nothing.
    """
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * with_text

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = MODELS.get(model) or PieceModel(model)
        MODELS[model] = own
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                rows = [(ids.count(" ") + 1, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), *([list(map(int, ids.split(" "))), decoded] if with_text else [])) for ids, decoded in own.encode_batch([t or "" for t in piece.column(1).to_pylist()])]
                columns = [piece.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()], strict=False))]
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_text
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(encode, schema)
