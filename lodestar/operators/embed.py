"""Embedding: a pluggable model over pending papers, in Arrow batches."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import document_text
from ..functions.vectors import half
from ..schema import DIM, EMBED_BATCH, QUERY_INSTRUCTION


class Embedder(Protocol):
    model: str
    dim: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Signed feature hashing of words: deterministic and offline, a stand-in for a model and not its equal."""

    def __init__(self, dim: int = 64, model: str = "hashing"):
        self.dim, self.model = dim, model

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for i, text in enumerate(texts):
            for w in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                out[i, h % self.dim] += 1 if h >> 63 else -1
        return out


def retried(embed: Callable[[list[str]], np.ndarray], texts: list[str], dim: int, retries: int = 4, sleep=time.sleep) -> np.ndarray:
    """embed(texts) with waits of 1, 2, 4 ... seconds between attempts; the shape must be (texts, dim)."""
    if not texts:
        return np.zeros((0, dim), np.float32)
    for attempt in range(retries):
        try:
            found = np.asarray(embed(texts), np.float32)
            break
        except Exception:
            if attempt == retries - 1:
                raise
            sleep(2**attempt)
    if found.shape != (len(texts), dim):
        raise ValueError(f"{found.shape} embeddings for {len(texts)} texts of {dim} dimensions")
    return found


def embed_query(embedder: Embedder) -> Callable[[str], np.ndarray]:
    """The query side, with its instruction."""
    return lambda query: retried(embedder.embed, [f"Instruct: {QUERY_INSTRUCTION}\nQuery: {query.strip()}"], embedder.dim)[0]


def available(embedder: Embedder) -> bool:
    try:
        return len(retried(embedder.embed, ["ready"], embedder.dim, retries=1)) == 1
    except Exception:
        return False


def embed_papers(pending: DataFrame, embedder: Embedder) -> DataFrame:
    """id, embedding (unit length, rounded through half precision) of the papers."""
    size = getattr(embedder, "dim", DIM)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a in range(0, len(pdf), EMBED_BATCH):
                part = pdf.iloc[a : a + EMBED_BATCH]
                yield pd.DataFrame({"id": part["id"], "embedding": list(half(retried(embedder.embed, part["text"].tolist(), size)))})

    texts = pending.select("id", document_text(F.col("title"), F.col("abstract")).alias("text"))
    return texts.mapInPandas(run, "id string, embedding array<float>")
