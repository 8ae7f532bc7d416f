"""Text and embedding providers behind batched columns; the defaults work offline and always give the same answers."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

TextProvider = Callable[[list[str]], list[str]]
EmbeddingProvider = Callable[[list[str]], list[list[float]]]


def hashed_embedding(size: int = 64) -> EmbeddingProvider:
    """Mean of a pseudo-random unit vector for each word, so that texts that share words are near; empty texts get one too."""

    def word_vector(word: str) -> np.ndarray:
        seed = int.from_bytes(hashlib.md5(word.encode()).digest()[:8], "big")
        v = np.random.default_rng(seed).normal(size=size)
        return v / np.linalg.norm(v)

    def embed(texts: list[str]) -> list[list[float]]:
        known: dict[str, np.ndarray] = {}
        out = []
        for t in texts:
            words = t.lower().split() or [""]
            total = sum(known.setdefault(w, word_vector(w)) if w not in known else known[w] for w in words)
            out.append((total / max(np.linalg.norm(total), 1e-12)).tolist())
        return out

    return embed


def template_text(templates: list[str]) -> TextProvider:
    """A template chosen by the md5 of the prompt, with the prompt in place of ``{}``."""

    def write(prompts: list[str]) -> list[str]:
        return [templates[int(hashlib.md5(p.encode()).hexdigest(), 16) % len(templates)].replace("{}", p) for p in prompts]

    return write


def with_embedding(rows: DataFrame, text: str, name: str, make: Callable[[], EmbeddingProvider] = hashed_embedding) -> DataFrame:
    """``rows`` with the embedding of a text column; the provider is made once a task and called a batch at a time."""

    def embed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = make()
        for batch in batches:
            yield batch.assign(**{name: provider(batch[text].fillna("").tolist())})

    return rows.mapInPandas(embed, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), f"`{name}` array<double>"]))


def with_text(rows: DataFrame, prompt: str, name: str, make: Callable[[], TextProvider], on_error: str = "fallback", fallback: str = "") -> DataFrame:
    """``rows`` with a struct (value, error_type, used_fallback) of the provider's answer to a prompt column.

    If a batch fails its rows are tried one by one; a row that fails has ``fallback`` and the error's name, or raises if
    ``on_error`` is ``fail``.
    """

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = make()
        for batch in batches:
            prompts, out = batch[prompt].fillna("").tolist(), []
            try:
                out = [(v, None, False) for v in provider(prompts)]
            except Exception:
                for p in prompts:
                    try:
                        out.append((provider([p])[0], None, False))
                    except Exception as error:
                        if on_error == "fail":
                            raise
                        out.append((fallback, type(error).__name__, True))
            yield batch.assign(**{name: [{"value": v, "error_type": e, "used_fallback": u} for v, e, u in out]})

    return rows.mapInPandas(answer, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), f"`{name}` struct<value: string, error_type: string, used_fallback: boolean>"]))
