import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.functions.vectors import unpack
from lodestar.operators import derived, search
from lodestar.operators.embed import HashingEmbedder
from lodestar.operators.layout import touched
from lodestar.operators.rerank import OverlapReranker
from lodestar.operators.store import Store

from .test_store import batch, paper

DIM = 8


def author(id_, authors, **more):
    row = list(paper(id_, **more))
    row[4] = authors
    return tuple(row)


@pytest.fixture
def store(spark, tmp_path):
    """64 papers in 16 parts, 50 of them with vectors."""
    found = Store(spark, f"file://{tmp_path}/index", "hashing", DIM, part_rows=4)
    found.upsert(batch(spark, *(author(f"p{k}", ["Emmy Noether", "G. H. Hardy, J. E. Littlewood", r"P. Erd\H{o}s", None][k % 4], title=f"title {k}", date=f"20{k % 20 + 10}-01-01", categories=["math.CO", "math.AG math.CO", "cs.X"][k % 3]) for k in range(64))))
    rng = np.random.default_rng(3)
    rows = [(f"p{k}", rng.normal(size=DIM).tolist()) for k in range(50)]
    found.append_vectors(spark.createDataFrame(rows, "id string, embedding array<double>"))
    return found


def joined(store):
    """The view by a plain join."""
    both = store.papers().join(store.vectors(), F.col("row") == F.col("slot"))
    return sorted(map(tuple, both.select(*derived.VIEW.fieldNames()[:-1], "embedding").collect()))


def read(store):
    """The view with its vectors unpacked: they are exact."""
    rows = list(map(tuple, derived.SEARCH_VIEW.read(store).collect()))
    assert all(len(r[-1]) == 2 * DIM for r in rows)
    return sorted((*r[:-1], unpack(r[-1]).astype(float).tolist()) for r in rows)


def changed(store, before):
    after = store.state()["derived"]["view"]
    return {int(p) for p in after if after[p] != before.get(p)}


def parts_of(spark, store, *ids):
    return set(touched(spark.createDataFrame([(i,) for i in ids], "id string"), store.state()["parts"]))


def test_view_equals_the_join_at_every_step(spark, store):
    assert read(store) == joined(store)  # nothing is written yet
    assert derived.SEARCH_VIEW.refresh(store) == sorted(int(p) for p in store.state()["papers"])
    assert derived.SEARCH_VIEW.refresh(store) == [] and read(store) == joined(store)
    store.upsert(batch(spark, paper("p3", title="other"), author("p7", "Someone", title="title 7"), paper("new")))
    assert read(store) == joined(store)  # some parts are stale
    before = store.state()["derived"]["view"]
    own = parts_of(spark, store, "p3", "p7", "new")
    assert set(derived.SEARCH_VIEW.refresh(store)) == own == changed(store, before)
    assert read(store) == joined(store)
    store.embed_pending(HashingEmbedder(DIM))
    assert read(store) == joined(store)
    derived.SEARCH_VIEW.refresh(store)
    assert len(read(store)) == 65 and read(store) == joined(store)


def test_slots_that_come_again_are_not_carried_over(spark, store):
    derived.SEARCH_VIEW.refresh(store)
    last = store.papers().where("row = 49").first()["id"]
    store.upsert(batch(spark, paper(last, title="revised")))
    store.compact()
    store.append_vectors(spark.createDataFrame([(last, [1.0] * DIM)], "id string, embedding array<double>"))
    assert store.papers().where("row = 49").first()["id"] == last
    assert read(store) == joined(store)
    derived.SEARCH_VIEW.refresh(store)
    assert read(store) == joined(store)


def test_parts_that_double(spark, store):
    derived.SEARCH_VIEW.refresh(store)
    store.upsert(batch(spark, *(paper(f"q{k}") for k in range(70))))
    assert store.state()["parts"] == 32 and read(store) == joined(store)
    derived.SEARCH_VIEW.refresh(store)
    assert read(store) == joined(store)
    assert len(list(store._fs.listStatus(store._path(f"{store.path}/view")))) <= 2


def test_only_new_vectors_are_read_for_a_refresh(spark, store, monkeypatch):
    derived.SEARCH_VIEW.refresh(store)
    store.upsert(batch(spark, paper("p60", title="x"), paper("p1", title="y")))
    store.append_vectors(spark.createDataFrame([("p60", [1.0] * DIM), ("p1", [2.0] + [0.0] * (DIM - 1))], "id string, embedding array<double>"))
    seen = []
    vectors = store.vectors
    monkeypatch.setattr(store, "vectors", lambda since=0, state=None: seen.append(vectors(since, state)) or seen[-1])
    derived.SEARCH_VIEW.refresh(store)
    assert len(seen) == 1 and seen[0].count() == 2


def test_a_search_has_no_exchange_and_no_join(spark, store):
    derived.SEARCH_VIEW.refresh(store)
    view = derived.SEARCH_VIEW.read(store)
    scored = search.score_packed(search.narrow(view, ["math.CO"], "2012-01-01", "hardy"), [1.0] * DIM)
    for held in (view, view.persist()):
        plan = search.top_k(scored, 5)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Exchange|Join", plan)
    view.unpersist()


def same_hits(a, b):
    """Equal rows in order, scores to six places."""
    plain = lambda df: [{k: round(v, 6) if isinstance(v, float) else v for k, v in r.asDict().items()} for r in df.collect()]
    return plain(a) == plain(b)


def test_packed_rows_are_a_view_of_the_buffer():
    import pyarrow as pa

    from lodestar.functions.vectors import half, pack, packed_rows

    m = half(np.random.default_rng(0).normal(size=(9, 5)))
    column = pa.array(pack(m), pa.binary())
    found = packed_rows(column.slice(2, 6))
    assert (found.astype(np.float32) == m[2:8]).all() and not found.flags.owndata and packed_rows(column.slice(0, 0)).shape == (0, 0)
    for bad in ([b"ab", b"abcd"], [b"ab", None]):
        with pytest.raises(ValueError):
            packed_rows(pa.array(bad, pa.binary()))


@pytest.mark.parametrize("asked", [{}, {"categories": ["math.AG"]}, {"since_date": "2015-01-01", "author": "erdős"}, {"author": "nobody"}])
def test_search_by_view_equals_search_by_tables(spark, store, asked):
    derived.SEARCH_VIEW.refresh(store)
    rng = np.random.default_rng(1)
    query = rng.normal(size=DIM).tolist()
    for reranker in (None, OverlapReranker()):
        plain = search.search(store.papers(), store.vectors(), "title 7", lambda _: query, 6, reranker=reranker, score=search.score_native, **asked)
        found = search.search_view(derived.SEARCH_VIEW.read(store), store.lookup, "title 7", lambda _: query, 6, reranker=reranker, **asked)
        assert same_hits(found.hits, plain.hits)
    if not asked:
        near = search.similar_in_view(derived.SEARCH_VIEW.read(store), store.lookup, "p5", 4).hits
        assert same_hits(near, search.similar(store.papers(), store.vectors(), "p5", 4, score=search.score_native).hits) and near.count() == 4
        with pytest.raises(KeyError):
            search.similar_in_view(derived.SEARCH_VIEW.read(store), store.lookup, "p60", 4)


def test_winners_beyond_the_broadcast_bound(spark, store, monkeypatch):
    monkeypatch.setattr(search, "MOST_K", 3)
    monkeypatch.setattr("lodestar.operators.rerank.MOST_K", 3)
    query = [1.0] * DIM
    found = search.search(store.papers(), store.vectors(), "title 7", lambda _: query, 10, reranker=OverlapReranker())
    assert found.reranked and found.hits.count() == 10
    assert search.search_view(derived.SEARCH_VIEW.read(store), store.lookup, "title 7", lambda _: query, 10).hits.count() == 3


NAMES = ["Emmy Noether", "G. H. Hardy, J. E. Littlewood", r"P. Erd\H{o}s", None, "", "Xy", r"Stra\ss er", "Øystein Ore, 華 羅庚", "aaaa", "A. A"]


def named_papers(spark, path):
    found = Store(spark, f"file://{path}/index", "hashing", DIM, part_rows=25)
    found.upsert(batch(spark, *(author(f"p{k}", NAMES[k % len(NAMES)], date=None if k % 11 == 0 else f"20{k % 20 + 10}-0{k % 9 + 1}-01", categories=["math.CO", "math.AG math.CO", "cs.X"][k % 3]) for k in range(100))))
    return found


@pytest.fixture
def named(spark, tmp_path):
    return named_papers(spark, tmp_path)


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """An index that no test changes, with its derived tables."""
    found = named_papers(spark, tmp_path_factory.mktemp("kept"))
    derived.AUTHOR_GRAMS.refresh(found)
    derived.refresh_listing(found, 10)
    return found


@pytest.fixture(scope="module")
def changed_since(spark, tmp_path_factory):
    """One whose listing was made before its last commit."""
    found = named_papers(spark, tmp_path_factory.mktemp("changed"))
    derived.refresh_listing(found, 10)
    found.upsert(batch(spark, paper("p5", date="2031-01-01"), paper("late", date=None), paper("p6", date="1999-01-01")))
    return found


def test_author_index_equals_contains(spark, kept):
    papers, grams = kept.papers().cache(), derived.AUTHOR_GRAMS.read(kept).cache()
    for asked in ["noether", "Hardy, little", "h. hardy, j.", "xy", "x", "a", "aaa", "aaaa", "aaaaa", "erdős", "strasse", "華 羅", "羅庚", "er, oet", "nobody", ",", "her l"]:
        found = derived.with_author(papers, grams, asked)
        assert sorted(r["id"] for r in found.collect()) == sorted(r["id"] for r in search.narrow(papers, author=asked).collect()), asked


def test_author_index_follows_changes_and_reads_the_grams_only(spark, named):
    derived.AUTHOR_GRAMS.refresh(named)
    named.upsert(batch(spark, author("p0", "Carl Hardy"), author("new", "Hardyman"), author("p1", "No One")))
    want = sorted(r["id"] for r in search.narrow(named.papers(), author="hardy").collect())
    for _ in range(2):
        found = derived.with_author(named.papers(), derived.AUTHOR_GRAMS.read(named), "hardy")
        assert sorted(r["id"] for r in found.collect()) == want and {"p0", "new"} <= set(want) and "p1" not in want
        derived.AUTHOR_GRAMS.refresh(named)
    plan = found._jdf.queryExecution().executedPlan().toString()
    grams = derived.AUTHOR_GRAMS.read(named).where(F.col("gram").isin(derived.query_grams("hardy")))
    assert "PushedFilters: [In(gram" in grams._jdf.queryExecution().executedPlan().toString() and "Python" not in plan


ASKS = [(1, {}), (7, {}), (95, {"categories": ["math.AG"]}), (30, {"since_date": "2020-01-01"}), (300, {"author": "hardy"}), (5, {"categories": ["none"]}), (7, {"since_date": "2026-01-01", "author": "noether"}), (102, {})]


def test_listing_equals_browse(kept, changed_since):
    for store in (kept, changed_since):
        papers = store.papers().cache()
        for k, asked in ASKS:
            want = search.browse(papers, k, **asked).select("id", "update_date", "score").collect()
            assert derived.newest(store, k, **asked)[0].select("id", "update_date", "score").collect() == want, asked


def test_browse_opens_few_files(spark, named):
    assert derived.newest(named, 5)[1] == 0  # no listing yet
    assert derived.refresh_listing(named, 10) and not derived.refresh_listing(named, 10)
    files = named.state()["listing"]["files"]
    dates = [f["newest"] for f in files if f["newest"] is not None]
    assert len(files) >= 8 and dates == sorted(dates, reverse=True)
    assert derived.newest(named, 2)[1] == 1 and derived.newest(named, 25)[1] <= 7
    assert derived.newest(named, 100)[1] == len(files)
    assert derived.newest(named, 100, since_date="2028-01-01")[1] < len(files) / 2
    derived.refresh_all(named)
    named.upsert(batch(spark, paper("x")))
    named.upsert(batch(spark, paper("y")))
    assert derived.newest(named, 3)[0].count() == 3  # the listing's files are named by the newest commit still
