import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import embed, filters, search
from lodestar.operators.rerank import OverlapReranker, Sticky, margin
from lodestar.plans.papers import papers, table, vectors


class Broken:
    def available(self):
        return True

    def score(self, query, documents):
        raise RuntimeError("no model")


@pytest.fixture(scope="module")
def index(spark):
    sf = "/root/testdata/sf0.001"
    return papers(spark, sf).cache(), vectors(spark, sf).cache()


def near(spark):
    return table(spark, "/root/testdata/sf0.001", "embeddings").where("vec_id = 0").first()["embedding"]


def test_scorers_agree(spark, index):
    own, v = index
    pairs = search.vectors_of(own, v)
    a = {r[0]: r[1] for r in search.score_native(pairs, near(spark)).collect()}
    b = {r[0]: r[1] for r in search.score_arrow(pairs, near(spark)).collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-5 for k in a)


def test_similar(spark, index):
    own, v = index
    id_ = own.where("doc_id = 0").first()["id"]
    hits = search.similar(own, v, id_, 10).hits.collect()
    assert len(hits) == 10 and id_ not in {h["id"] for h in hits}
    assert [h["score"] for h in hits] == sorted((h["score"] for h in hits), reverse=True)
    assert search.similar(own, v, id_, 10_000).hits.count() == filters.embedded(own).count() - 1
    with pytest.raises(KeyError):
        search.similar(own, v, "none")


def test_empty_query_browses(spark, index):
    own, v = index
    found = search.search(own, v, "  ", None, 5, author="Hardy")
    rows = found.hits.collect()
    assert found.ranked == "date" and all(r["score"] is None for r in rows)
    assert [r["update_date"] for r in rows] == sorted((r["update_date"] for r in rows), reverse=True)


def test_filters(spark, index):
    own, v = index
    assert search.count_matching(own, ["none"]) == 0
    assert search.count_matching(own, author=", ;") == own.count()
    assert own.where(filters.in_categories(["math.CO"], F.lit("math.COX"))).count() == 0
    assert own.where(filters.in_scope(F.lit("x\tmath.CO"))).count() == own.count()
    assert filters.known_categories(["x", "math.CO"]) == ["math.CO"]
    assert search.clamp_k(0) == 1 and search.clamp_k(900) == 500
    with pytest.raises(ValueError):
        filters.valid_date("1 May")
    with pytest.raises(ValueError):
        search.browse(own, 0)


def test_rerank(spark, index):
    own, v = index
    embedding = near(spark)
    found = search.search(own, v, "the of and", lambda _: embedding, 5, reranker=OverlapReranker())
    rows = found.hits.collect()
    assert found.reranked and len(rows) == 5
    assert [r["rerank_margin"] for r in rows] == sorted((r["rerank_margin"] for r in rows), reverse=True)
    assert all(r["score"] == r["rerank_margin"] for r in rows)


def test_rerank_failure_keeps_vector_order(spark, index):
    own, v = index
    embedding = near(spark)
    plain = [r["id"] for r in search.search(own, v, "q", lambda _: embedding, 5).hits.collect()]
    found = search.search(own, v, "q", lambda _: embedding, 5, reranker=Broken())
    assert [r["id"] for r in found.hits.collect()] == plain and "no model" in found.warning or found.warning
    sticky = Sticky(Broken())
    with pytest.raises(RuntimeError):
        sticky.score("q", ["d"])
    assert not sticky.available()
    assert margin([2.0]) == 2.0 and margin([1.0, 3.0]) == 2.0


def test_batch_top_k_matches_full_sort(spark):
    rng = np.random.default_rng(1)
    m = rng.integers(-2, 3, (60, 3)).astype(float)  # many ties
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)]
    v = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(5)
    q = spark.createDataFrame(rows[::7], "query_id long, embedding array<float>")
    got = {(r["query_id"], r["rank"]): r["id"] for r in search.batch_top_k(v, q, 4).collect()}
    for i in range(0, 60, 7):
        order = sorted((j for j in range(60) if j != i), key=lambda j: (-float(m[i] @ m[j]), j))[:4]
        assert [got[i, n + 1] for n in range(4)] == order
    assert search.batch_top_k(v, q.limit(0), 4).count() == 0


def test_embed_helpers():
    e = embed.HashingEmbedder(8)
    assert embed.retried(e.embed, [], 8).shape == (0, 8)
    with pytest.raises(ValueError):
        embed.retried(lambda t: np.zeros((1, 3)), ["a"], 8)
    waits = []
    with pytest.raises(RuntimeError):
        embed.retried(lambda t: (_ for _ in ()).throw(RuntimeError()), ["a"], 8, sleep=waits.append)
    assert waits == [1, 2, 4]
    unit = search.cached_embedding(embed.embed_query(e))
    assert abs(np.linalg.norm(unit("rings")) - 1) < 1e-6


@pytest.mark.parametrize("k,slices,query_bytes,exclude", [(4, None, 64_000_000, True), (4, 3, 100, True), (1, 7, 250, False), (100, 2, 64_000_000, True)])
def test_batch_top_k_in_groups_and_slices(spark, monkeypatch, k, slices, query_bytes, exclude):
    monkeypatch.setattr(search, "QUERY_BYTES", query_bytes)
    monkeypatch.setattr(search, "QUERY_BLOCK", 3)
    monkeypatch.setattr(search, "VECTOR_BLOCK", 5)
    rng = np.random.default_rng(2)
    m = rng.integers(-2, 3, (70, 4)).astype(float)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(90, None), (None, [1.0] * 4)]
    v = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(6)
    q = spark.createDataFrame(rows[::3], "query_id long, embedding array<float>").repartition(4)
    got = {}
    for r in search.batch_top_k(v, q, k, exclude_self=exclude, slices=slices).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["score"]))
    for i in range(0, 70, 3):
        order = sorted((j for j in range(70) if j != i or not exclude), key=lambda j: (-float(m[i] @ m[j]), j))[:k]
        assert sorted(got.pop(i)) == [(n + 1, j, float(m[i] @ m[j])) for n, j in enumerate(order)]
    assert not got


def test_query_vectors_stay_off_the_driver(spark, index, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    _, v = index
    many = v.select(F.col("slot").alias("id"), "embedding")
    brought = []
    for name in ("collect", "toLocalIterator", "toPandas", "toArrow"):
        real = getattr(DataFrame, name)
        monkeypatch.setattr(DataFrame, name, lambda self, *a, _f=real, **b: brought.append(self.columns) or _f(self, *a, **b))
    found = search.batch_top_k(many, many.withColumnRenamed("id", "query_id"), 3)
    assert all("embedding" not in columns and "data" not in columns for columns in brought)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    brought.clear()
    assert found.count() == 3 * many.count()


def test_batch_top_k_refuses_other_dimensions(spark):
    v = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "id long, embedding array<float>")
    with pytest.raises(Exception, match="dimensions"):
        search.batch_top_k(v, v.withColumnRenamed("id", "query_id"), 1)
    with pytest.raises(Exception, match="dimensions"):
        search.batch_top_k(v, v.where("id = 1").withColumnRenamed("id", "query_id"), 1).collect()
