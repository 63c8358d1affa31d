"""What calls an outside service, behind small interfaces, with offline stand-ins that always give the same answer."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import text as tx

# Limits of one request.
MOST_ITEMS, MOST_CHARS = 1000, 250_000


class EmbeddingProvider(Protocol):
    width: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class TextGenerator(Protocol):
    def generate(self, system: str, prompt: str) -> str: ...


class PageReader(Protocol):
    def transcribe(self, image: bytes) -> str: ...


class HashingEmbedder:
    """Words hashed to signed buckets, length one; no model and no network."""

    def __init__(self, width: int = 64):
        self.width = width

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.width))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                out[i, h % self.width] += 1.0 if h >> 63 else -1.0
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(n > 0, n, 1)).tolist()


ENGINES = {"hashing": HashingEmbedder}


def embedder(engine: str = "hashing", **options) -> EmbeddingProvider:
    if engine not in ENGINES:
        raise ValueError(f"unknown engine {engine!r}")
    return ENGINES[engine](**options)


def batches(sizes: list[int], most_items: int = MOST_ITEMS, most_size: int = MOST_CHARS) -> Iterator[slice]:
    """Slices of a list of sizes that keep both limits; an item over the limit stands alone."""
    start = used = 0
    for i, s in enumerate(sizes):
        if i > start and (i - start >= most_items or used + s > most_size):
            yield slice(start, i)
            start, used = i, 0
        used += s
    if start < len(sizes):
        yield slice(start, len(sizes))


def embeddable(chunks: DataFrame) -> DataFrame:
    """Chunks with a text layer and text, none over the limit of a request."""
    return chunks.where(F.col("has_text_layer") & (tx.strip(F.col("text")) != "") & (F.length("text") <= MOST_CHARS))


def with_embeddings(df: DataFrame, provider: EmbeddingProvider, key: str, text: str = "text") -> DataFrame:
    """(key, embedding): each Arrow batch goes out in requests that keep the limits. Null texts get no row."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            texts, found = pdf[text].tolist(), []
            for s in batches([len(t) for t in texts]):
                found += provider.embed(texts[s])
            yield pd.DataFrame({key: pdf[key], "embedding": found})

    return df.select(key, text).where(F.col(text).isNotNull()).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, embedding array<double>")
