"""The second stage: a pluggable scorer over a shortlist, with a way on when it fails."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import rerank_text
from ..schema import MOST_K, RERANK_BATCH
from .scratch import scratch_path


class Reranker(Protocol):
    """Picklable; loads what it needs at its first score() in a worker."""

    def available(self) -> bool: ...

    def score(self, query: str, documents: list[str]) -> list[float]: ...


class OverlapReranker:
    """Share of the query's words that a document holds, all of it: deterministic, no model, no claim to neural quality. A
    model behind the protocol has its own limit, RERANK_MAX_TOKENS."""

    def available(self) -> bool:
        return True

    def score(self, query: str, documents: list[str]) -> list[float]:
        wanted = set(query.lower().split())
        return [len(wanted & set(d.lower().split())) / (len(wanted) or 1) for d in documents]


def margin(logits: list[float]) -> float:
    """One number from a classifier's outputs: the logit itself, or the second less the first."""
    return logits[0] if len(logits) == 1 else logits[1] - logits[0]


class Sticky:
    """A reranker that is not tried again once it has failed."""

    def __init__(self, inner: Reranker):
        self._inner, self.failure = inner, ""

    def available(self) -> bool:
        return not self.failure and self._inner.available()

    def score(self, query: str, documents: list[str]) -> list[float]:
        if self.failure:
            raise RuntimeError(self.failure)
        try:
            return self._inner.score(query, documents)
        except Exception as error:
            self.failure = str(error)
            raise


def rerank_frame(hits: DataFrame, query: str, reranker: Reranker, most: int = MOST_K) -> DataFrame:
    """hits (most rows, or fewer) with rerank_margin and vector_score, and score set to the margin; best first, ties in vector order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf["text"].astype(object).where(pdf["text"].notna(), "")
            order = out.str.len().argsort(kind="stable").to_numpy()  # texts of a length share a batch
            scores = pd.Series(0.0, index=range(len(out)))
            for a in range(0, len(order), RERANK_BATCH):
                part = order[a : a + RERANK_BATCH]
                scores.iloc[part] = reranker.score(query, out.iloc[part].tolist())
            yield pd.DataFrame({"id": pdf["id"].to_numpy(), "rerank_margin": scores.to_numpy()})

    texts = hits.select("id", rerank_text(F.col("title"), F.col("abstract")).alias("text"))
    scored = texts.mapInPandas(run, "id string, rerank_margin double")
    both = hits.withColumnRenamed("score", "vector_score").join(F.broadcast(scored) if most <= MOST_K else scored, "id")
    return both.withColumn("score", F.col("rerank_margin")).orderBy(F.desc("rerank_margin"), F.desc("vector_score"), "id")


def rerank(hits: DataFrame, query: str, reranker: Reranker, most: int = MOST_K) -> tuple[DataFrame, str | None]:
    """(reranked hits, None), or (hits, what went wrong). hits, of which there are `most` or fewer, are scored at once, so a
    failure shows here: a shortlist comes to the driver, and more than MOST_K go into a written table."""
    if not reranker.available():
        return hits, "the reranker is not available"
    spark = hits.sparkSession
    try:
        done = rerank_frame(hits, query, reranker, most)
        if most <= MOST_K:
            scored = spark.createDataFrame(done.collect(), done.schema)
        else:
            path = scratch_path(spark, "reranked")
            done.write.parquet(path)
            scored = spark.read.schema(done.schema).parquet(path)
    except Exception as error:
        return hits, f"reranking failed: {str(error).splitlines()[0]}"
    return scored.orderBy(F.desc("rerank_margin"), F.desc("vector_score"), "id"), None
