"""Exact cosine search, browsing and similar items.

Scores come from a pass over slim rows; a top-k is kept per partition before any row moves, and the full rows are
fetched for the winners only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot, packed_rows, rows_of, unpack
from ..schema import DEFAULT_K, MOST_K, QUERY_CACHE, SHORTLIST
from .filters import embedded, narrow

#: Query vectors scored in one block; more take further blocks over the same vectors.
QUERY_BLOCK = 256
#: Bytes of query vectors, about, that a task holds at once; more make further groups.
QUERY_BYTES = 64_000_000
#: Vectors packed into one row, by number and bytes.
VECTOR_BLOCK = 8_192
VECTOR_BYTES = 8_000_000
#: Packed vectors that are widened at once.
PACKED_ROWS = 4_096


def check_k(k: int) -> int:
    if k < 1:
        raise ValueError("k must be at least 1")
    return k


def clamp_k(k: int) -> int:
    """k as a server takes it."""
    return max(1, min(k, MOST_K))


def score_native(vectors: DataFrame, query: list[float], id_col: str = "id") -> DataFrame:
    """id and score in double, without Python: for narrow vectors and exact sums."""
    q = F.array(*(F.lit(float(x)) for x in query))
    return vectors.select(id_col, dot(F.col("embedding"), q).alias("score"))


def top_k(scored: DataFrame, k: int, id_col: str = "id") -> DataFrame:
    """Highest scores; ties by id. One partial top-k per partition, then k rows of each meet."""
    return scored.orderBy(F.desc("score"), id_col).limit(check_k(k))


def batch_top_k(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "id", query_col: str = "query_id", exclude_self: bool = True, slices: int | None = None) -> DataFrame:
    """query_id, id, score, rank: for each query vector its k best among all vectors, ties by id.

    queries(query_id long, embedding) are a stated set, of any size. Both sides are packed into blocks on the executors,
    the vectors in one scan. Blocks of vectors are dealt over slices, and those of queries over groups of QUERY_BYTES or
    so; a group meets a slice in one place, where its queries come first and the vectors stream past, each block
    multiplied with each. k rows a query leave each slice, so what meets is k * slices rows a query and not all pairs. The
    driver learns only how many queries there are. Vectors of another length than the queries' are refused; a null vector
    is skipped."""
    check_k(k)
    spark = vectors.sparkSession
    asked = queries.where(F.col("embedding").isNotNull())
    size = F.size("embedding")
    about = asked.agg(F.count("*").alias("n"), F.min(size).alias("low"), F.max(size).alias("dim")).first()
    if not about["n"]:
        return spark.createDataFrame([], f"{query_col} long, {id_col} long, score double, rank int")
    if about["low"] != about["dim"]:
        raise ValueError("queries of unequal dimensions")
    groups = -(-about["n"] * about["dim"] * 8 // QUERY_BYTES)
    slices = slices or spark.sparkContext.defaultParallelism
    to_all = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n: F.pmod(F.xxhash64("ids"), F.lit(n)).cast("int")
    few = _packed(asked, query_col, QUERY_BLOCK).select(dealt(groups).alias("g"), to_all(slices).alias("slice"), F.lit(0).alias("kind"), "ids", "data")
    many = _packed(vectors.where(F.col("embedding").isNotNull()), id_col, VECTOR_BLOCK).select(to_all(groups).alias("g"), dealt(slices).alias("slice"), F.lit(1).alias("kind"), "ids", "data")
    met = few.unionByName(many).repartition(groups * slices, "g", "slice").sortWithinPartitions("g", "slice", "kind")
    found = met.mapInArrow(_best_of_slice(about["dim"], k, exclude_self), "q long, id long, score double")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select(F.col("q").alias(query_col), F.col("id").alias(id_col), "score", "rank")


def _packed(vectors: DataFrame, id_col: str, rows: int) -> DataFrame:
    """ids and data of blocks of vectors: 64-bit ids, and the matrix in double precision."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            matrix = rows_of(batch.column(1)).astype(np.float64)
            own = batch.column(0).to_numpy()
            step = max(1, min(rows, VECTOR_BYTES // max(matrix.shape[1] * 8, 1)))
            at = range(0, len(own), step)
            yield pa.RecordBatch.from_arrays([pa.array([own[i : i + step].tobytes() for i in at], pa.binary()), pa.array([matrix[i : i + step].tobytes() for i in at], pa.binary())], names=["ids", "data"])

    return vectors.select(F.col(id_col).cast("long").alias("id"), "embedding").where(F.col("id").isNotNull()).mapInArrow(run, "ids binary, data binary")


class _Best:
    """The k best of what a block of queries has met."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int, exclude_self: bool):
        self._ids, self._queries, self._k, self._exclude = ids, queries, k, exclude_self
        self._at, self._found, self._scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def meet(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        scores = self._queries @ vectors.T
        if self._exclude:
            scores[self._ids[:, None] == ids[None, :]] = -np.inf
        if len(ids) > self._k:  # all that tie with the k-th stay, so that ids can settle it
            least = np.partition(scores, len(ids) - self._k, axis=1)[:, len(ids) - self._k]
            at, of = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
        else:
            at, of = np.nonzero(scores > -np.inf)
        at, found, score = np.r_[self._at, at], np.r_[self._found, ids[of]], np.r_[self._scores, scores[at, of]]
        order = np.lexsort((found, -score, at))
        at = at[order]
        first = np.searchsorted(at, at)  # where each query's begin
        kept = np.arange(len(at)) - first < self._k
        self._at, self._found, self._scores = at[kept], found[order][kept], score[order][kept]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self._ids[self._at], self._found, self._scores


def _best_of_slice(dim: int, k: int, exclude_self: bool) -> Callable[[Iterator], Iterator]:
    """Over rows sorted by group, slice and kind: the k best of each query in each slice."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def out(held: list[_Best]):
            columns = zip(*(b.rows() for b in held))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], names=["q", "id", "score"])

        place, held = None, []
        for batch in batches:
            for g, slice_, kind, ids, data in zip(*(batch.column(i) for i in range(5))):
                if (g, slice_) != place:
                    if held:
                        yield out(held)
                    place, held = (g, slice_), []
                own = np.frombuffer(ids.as_buffer(), np.int64)
                matrix = np.frombuffer(data.as_buffer(), np.float64).reshape(len(own), -1)
                if matrix.shape[1] != dim:
                    raise ValueError(f"vectors of {matrix.shape[1]} dimensions and queries of {dim}")
                if kind.as_py() == 0:
                    held.append(_Best(own, matrix, k, exclude_self))
                else:
                    for block in held:
                        block.meet(own, matrix)
        if held:
            yield out(held)

    return run


def score_arrow(vectors: DataFrame, query: Iterable[float], id_col: str = "id") -> DataFrame:
    """id and score by single-precision products over Arrow batches: for wide vectors."""
    q = np.asarray(list(query), np.float32)
    kind = dict(vectors.dtypes)[id_col]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            m = rows_of(batch.column(1))
            scores = (m.astype(np.float32) @ q).astype(np.float64) if len(m) else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=[id_col, "score"])

    return vectors.select(id_col, "embedding").mapInArrow(run, f"`{id_col}` {kind}, score double")


def score_packed(view: DataFrame, query: Iterable[float], id_col: str = "id") -> DataFrame:
    """id and score of a view(id, packed) in half precision, which is read where Arrow has it; products are summed in
    double, some thousand rows at a time."""
    q = np.asarray(list(query), np.float64)
    kind = dict(view.dtypes)[id_col]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            m = packed_rows(batch.column(1))
            scores = [m[i : i + PACKED_ROWS].astype(np.float64) @ q for i in range(0, len(m), PACKED_ROWS)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores) if scores else np.empty(0))], names=[id_col, "score"])

    return view.select(id_col, "packed").mapInArrow(run, f"`{id_col}` {kind}, score double")


@dataclass(frozen=True)
class Found:
    """hits, the order they stand in, and a warning if a stage had to be skipped."""

    hits: DataFrame
    ranked: str
    reranked: bool = False
    warning: str | None = None


def vectors_of(papers: DataFrame, vectors: DataFrame) -> DataFrame:
    """id and embedding of the embedded papers."""
    return embedded(papers).select("id", "row").join(vectors.select("slot", "embedding"), F.col("row") == F.col("slot")).select("id", "embedding")


def with_rows(top: DataFrame, papers: DataFrame, k: int = MOST_K) -> DataFrame:
    """Full rows of the winners, best first. top has k rows at most; it goes to every task only if k is small."""
    return papers.join(F.broadcast(top) if k <= MOST_K else top, "id").orderBy(F.desc("score"), "id")


def browse(papers: DataFrame, k: int = DEFAULT_K, categories=None, since_date=None, author=None) -> DataFrame:
    """Newest first (null dates last, ties by id), pending ones too; score is null."""
    found = narrow(papers, categories, since_date, author)
    return found.orderBy(F.desc("update_date"), "id").limit(check_k(k)).withColumn("score", F.lit(None).cast("double"))


def count_matching(papers: DataFrame, categories=None, since_date=None, author=None) -> int:
    return narrow(papers, categories, since_date, author).count()


def cached_embedding(embed_query: Callable[[str], Iterable[float]]) -> Callable[[str], tuple[float, ...]]:
    """embed_query with unit length and a memory of the last QUERY_CACHE texts."""

    @lru_cache(maxsize=QUERY_CACHE)
    def unit(text: str) -> tuple[float, ...]:
        v = np.asarray(list(embed_query(text)), np.float32)
        return tuple((v / (np.linalg.norm(v) or 1)).tolist())

    return unit


def search(papers: DataFrame, vectors: DataFrame, query: str | None, embed_query, k: int = DEFAULT_K, categories=None, since_date=None, author=None, reranker=None, score: Callable[..., DataFrame] = score_arrow) -> Found:
    """Semantic search with filters before scoring; without a query the newest papers that match."""
    check_k(k)
    text = (query or "").strip()
    if not text:
        return Found(browse(papers, k, categories, since_date, author), "date")
    want = _wanted(k, reranker)
    found = narrow(embedded(papers), categories, since_date, author)
    top = top_k(score(vectors_of(found, vectors), embed_query(text)), want)
    return _finish(with_rows(top, papers, want), text, k, reranker)


def search_view(view: DataFrame, rows_of_ids: Callable[[list[str]], DataFrame], text: str, embed_query, k: int = DEFAULT_K, categories=None, since_date=None, author=None, reranker=None) -> Found:
    """Semantic search over a view(id, filter columns, packed), which needs no join; k is held under MOST_K. The winners'
    ids come to the driver, and rows_of_ids gives their papers."""
    want = min(_wanted(check_k(k), reranker), MOST_K)
    top = top_k(score_packed(narrow(view, categories, since_date, author), embed_query(text.strip())), want).collect()
    return _finish(_rows_of_winners(top, rows_of_ids, view), text.strip(), min(k, MOST_K), reranker)


def similar_in_view(view: DataFrame, rows_of_ids: Callable[[list[str]], DataFrame], id_: str, k: int = DEFAULT_K, reranker=None) -> Found:
    """similar() over a view, as search_view."""
    from ..functions.text import rerank_text

    own = view.where(F.col("id") == id_).select("packed").first()
    if own is None:
        raise KeyError(f"{id_} is unknown or has no vector yet")
    want = min(_wanted(check_k(k), reranker), MOST_K)
    top = top_k(score_packed(view.where(F.col("id") != id_), unpack(own["packed"])), want).collect()
    text = rows_of_ids([id_]).select(rerank_text(F.col("title"), F.col("abstract"))).first()[0] if reranker else ""
    return _finish(_rows_of_winners(top, rows_of_ids, view), text, min(k, MOST_K), reranker)


def _rows_of_winners(top: list, rows_of_ids: Callable[[list[str]], DataFrame], view: DataFrame) -> DataFrame:
    scores = view.sparkSession.createDataFrame([(r["id"], r["score"]) for r in top], "id string, score double")
    return with_rows(scores, rows_of_ids([r["id"] for r in top]))


def _wanted(k: int, reranker) -> int:
    return max(k, SHORTLIST) if reranker else k


def _finish(hits: DataFrame, text: str, k: int, reranker) -> Found:
    from .rerank import rerank

    plain = hits.withColumn("vector_score", F.lit(None).cast("double")).withColumn("rerank_margin", F.lit(None).cast("double"))
    if reranker is None:
        return Found(plain.limit(k), "relevance")
    done, warning = rerank(hits, text, reranker, _wanted(k, reranker))
    if warning:
        return Found(plain.limit(k), "relevance", False, warning)
    return Found(done.limit(k), "relevance", True)


def similar(papers: DataFrame, vectors: DataFrame, id_: str, k: int = DEFAULT_K, reranker=None, score: Callable[..., DataFrame] = score_arrow) -> Found:
    """Nearest neighbours of a stored item, itself left out; reranked against its own text."""
    from ..functions.text import rerank_text

    own = vectors_of(papers.where(F.col("id") == id_), vectors).first()
    if own is None:
        raise KeyError(f"{id_} is unknown or has no vector yet")
    want = _wanted(check_k(k), reranker)
    others = vectors_of(papers.where(F.col("id") != id_), vectors)
    hits = with_rows(top_k(score(others, own["embedding"]), want), papers, want)
    text = papers.where(F.col("id") == id_).select(rerank_text(F.col("title"), F.col("abstract"))).first()[0] if reranker else ""
    return _finish(hits, text, k, reranker)


def recall_at(ranks: DataFrame, ks: Iterable[int] = (1, 5)) -> DataFrame:
    """One row over ranks(rank, null if not found): recall at each k, and the mean reciprocal rank."""
    hit: list[Column] = [F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)).alias(f"recall_at_{k}") for k in ks]
    return ranks.agg(*hit, F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("mrr"))
