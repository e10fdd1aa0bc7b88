"""A quality classifier that learns from preferences: Bradley-Terry pairwise ranking.

A document's strength is a linear function of features of its whole text. Of a pair, the document labelled better wins
with the logistic of the difference of strengths, so the loss is logistic over differences of features. Pairs are joined
by Spark, each preferred row with a few others, and Newton's steps sum gradient and curvature over blocks of pairs by a
tree of partial sums. The threshold is a quantile of the strengths of labelled rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scratch import scratch_path
from ..operators.store import number_rows
from .common import cut, table

#: Labelled rows of each class that pairs are made of, at most: those with the smallest hash of their id.
MAX_LABELLED = 100_000
#: Pairs that a row of the larger class is in.
PAIRS_A_ROW = 4
#: Weight of the penalty on squared coefficients, as a share of the number of pairs.
RIDGE = 1e-3
#: Newton's steps, at most.
STEPS = 25
#: Standardised features are held within this.
FURTHEST = 8.0
#: What the score is at the threshold.
THRESHOLD = 0.7

_SYMBOLS = frozenset("#*$%&|<>{}[]~^_=+\\/@")
_STOPS = ".!?…"
FEATURES = (
    "log_words", "mean_word", "long_words", "symbols", "symbol_words", "digits", "upper", "alphabetic", "distinct_words", "top_word",
    "repeats", "repeated_trigrams", "repeated_lines", "short_lines", "stopped_lines", "stops", "commas", "bars", "entropy", "links",
)


def features(text: str | None) -> list[float]:
    """FEATURES of a whole text; zeros for one without words."""
    text = text or ""
    words = text.split()
    n, chars = len(words), len(text)
    if not n:
        return [0.0] * len(FEATURES)
    counts = Counter(words)
    numbers = {w: i for i, w in enumerate(counts)}
    ids = np.fromiter(map(numbers.__getitem__, words), np.int64, n)
    _, pairs = np.unique(ids[:-1] * len(numbers) + ids[1:], return_inverse=True)
    _, trigrams = np.unique(pairs[:-1] * len(numbers) + ids[2:], return_counts=True)
    letters = Counter(text)
    symbols = sum(letters[c] for c in _SYMBOLS)
    digits = upper = alphabetic = 0
    for c, k in letters.items():
        digits += k * c.isdigit()
        upper += k * c.isupper()
        alphabetic += k * c.isalpha()
    lines = [x.strip() for x in text.split("\n")]
    lines = [x for x in lines if x]
    return [
        math.log1p(n),
        sum(len(w) * k for w, k in counts.items()) / n,
        sum(k for w, k in counts.items() if len(w) > 20) / n,
        symbols / chars,
        sum(k for w, k in counts.items() if not _SYMBOLS.isdisjoint(w)) / n,
        digits / chars,
        upper / chars,
        alphabetic / chars,
        len(counts) / n,
        max(counts.values()) / n,
        float(np.mean(ids[1:] == ids[:-1])) if n > 1 else 0.0,
        float(trigrams[trigrams > 1].sum()) / n,
        1 - len(set(lines)) / len(lines),
        sum(len(x) < 30 for x in lines) / len(lines),
        sum(x[-1] in _STOPS for x in lines) / len(lines),
        sum(letters[c] for c in _STOPS) / n,
        letters[","] / n,
        letters["|"] / n,
        -sum(k / n * math.log(k / n) for k in counts.values()) / math.log(n + 1),
        text.count("http") / n,
    ]


@dataclass(frozen=True)
class Model:
    """strength = coefficients . standardised features, held within FURTHEST; the score is THRESHOLD at `at`."""

    mean: np.ndarray
    spread: np.ndarray
    coefficients: np.ndarray
    at: float = 0.0

    def strengths(self, x: np.ndarray) -> np.ndarray:
        return _standard(x, self.mean, self.spread) @ self.coefficients


def _standard(x: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    return np.clip((x - mean) / spread, -FURTHEST, FURTHEST)


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id's text leaves 2 modulo 4; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def featured(docs: DataFrame) -> DataFrame:
    """doc_id and x (FEATURES of the whole text) for every row, from a written table: texts are read once."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = [features(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64()))], names=["doc_id", "x"])

    return cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, x array<double>"))


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """x, preferred (label 1 against 0) of the featured rows that are labelled and not held out, from a written table."""
    known = labels.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("quality").isin(0, 1))
    return cut(rows.join(known.select("doc_id", (F.col("quality") == 1).alias("preferred")).distinct(), "doc_id"))


def preferences(known: DataFrame, most: int = MAX_LABELLED, each: int = PAIRS_A_ROW) -> DataFrame:
    """better, worse: features of pairs of a preferred and a rejected row. Rows of the larger class meet `each` others, at
    places that go round the smaller class, so every row of both is in a pair; no class is joined with all of the other."""
    spark = known.sparkSession
    order = F.struct(F.xxhash64("doc_id").alias("h"), "doc_id", "x")
    sides, sizes = {}, {}
    for preferred in (True, False):
        own = known.where(F.col("preferred") == preferred).select("doc_id", "x", order.alias("_order"))
        sides[preferred] = number_rows(own, "_order", 0, "at", scratch_path(spark, "preferences")).where(F.col("at") < most).select("at", "x")
        sizes[preferred] = sides[preferred].count()
    larger = sizes[True] >= sizes[False]
    small = max(sizes[not larger], 1)
    turns = F.explode(F.sequence(F.lit(0), F.lit(min(each, small) - 1)))
    many = sides[larger].select(F.col("x").alias("x1"), "at", turns.alias("turn"))
    many = many.select("x1", ((F.col("at") + F.col("turn") * (small // min(each, small))) % small).alias("at"))
    pairs = many.join(sides[not larger].withColumnRenamed("x", "x2"), "at")
    return pairs.select(F.col("x1" if larger else "x2").alias("better"), F.col("x2" if larger else "x1").alias("worse"))


def _climb(blocks: RDD, n: int, size: int, steps: int = STEPS) -> np.ndarray:
    """Coefficients with the least logistic loss over blocks of differences, by Newton's method: of each block its
    gradient and curvature, summed along a tree."""
    context, w = blocks.context, np.zeros(size)

    def added(total, block):
        own = shared.value
        lost = 1 / (1 + np.exp(np.clip(block @ own, -30, 30)))
        found = block.T @ lost, (block * (lost * (1 - lost))[:, None]).T @ block
        return found if total is None else (total[0] + found[0], total[1] + found[1])

    def merged(a, b):
        return (a[0] + b[0], a[1] + b[1]) if a and b else a or b

    for _ in range(steps):
        shared = context.broadcast(w)
        gradient, curvature = blocks.treeAggregate(None, added, merged)
        step = np.linalg.solve(curvature + RIDGE * n * np.eye(size), gradient - RIDGE * n * w)
        w = w + step
        shared.destroy()
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(known: DataFrame, most: int = MAX_LABELLED) -> Model:
    """Coefficients from pairs of labelled(x, preferred), and the threshold: the quantile of all labelled strengths that
    is the share of rejected rows. Without rows of both classes there is no preference, and all strengths are 0."""
    size = len(FEATURES)
    moments = known.agg(F.count_if("preferred").alias("n1"), F.count_if(~F.col("preferred")).alias("n0"), *(f(F.col("x")[i]).alias(f"{f.__name__}{i}") for f in (F.avg, F.stddev_pop) for i in range(size))).first()
    n1, n0 = moments["n1"], moments["n0"]
    if not n1 or not n0:
        return Model(np.zeros(size), np.ones(size), np.zeros(size))
    mean = np.array([moments[f"avg{i}"] for i in range(size)])
    spread = np.array([moments[f"stddev_pop{i}"] for i in range(size)])
    spread = np.where(spread < 1e-9, 1.0, spread)

    def differences(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            apart = _standard(_matrix(batch.column(0)), mean, spread) - _standard(_matrix(batch.column(1)), mean, spread)
            yield pa.RecordBatch.from_arrays([pa.array([apart.tobytes()])], names=["data"])

    pairs = cut(preferences(known, most))
    blocks = pairs.mapInArrow(differences, "data binary").rdd.map(lambda r: np.frombuffer(r["data"]).reshape(-1, size)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        model = Model(mean, spread, _climb(blocks, pairs.count(), size))
    finally:
        blocks.unpersist()
    strengths = cut(_strengths(known, model))
    at = strengths.agg(F.percentile_approx("strength", n0 / (n0 + n1), 10_000)).first()[0]
    s = F.col("strength")
    low, high = strengths.agg(F.max(F.when(s <= at, s)), F.min(F.when(s > at, s))).first()
    return Model(mean, spread, model.coefficients, low if high is None else (low + high) / 2)


def _strengths(rows: DataFrame, model: Model) -> DataFrame:
    """doc_id, strength of rows(doc_id, x)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.strengths(_matrix(batch.column(1))))], names=["doc_id", "strength"])

    return rows.select("doc_id", "x").mapInArrow(run, "doc_id long, strength double")


def score(rows: DataFrame, model: Model) -> DataFrame:
    """doc_id, strength, score of featured rows: the logistic of how far a strength lies over the threshold, THRESHOLD
    there. Null and empty texts have features of zeros and a score like others; repeated rows and null ids stay."""
    up = F.col("strength") - F.lit(model.at) + F.lit(math.log(THRESHOLD / (1 - THRESHOLD)))
    return _strengths(rows, model).withColumn("score", 1 / (1 + F.exp(-up)))


def op11_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by strengths fitted on the labelled rows that are not held out; cases as in score and fit."""
    rows = featured(table(spark, sf_dir, "documents"))
    scored = score(rows, fit(labelled(rows, table(spark, sf_dir, "labels"))))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "strength")
