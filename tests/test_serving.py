import json
import threading
from urllib.request import urlopen

import pytest

from lodestar.functions import registered
from lodestar.operators.embed import HashingEmbedder
from lodestar.operators.rerank import OverlapReranker
from lodestar.operators.store import Store
from lodestar.serving import Ask, ResidentView, answer, server

from .test_store import batch, paper


@pytest.fixture(scope="module")
def view(spark, tmp_path_factory):
    store = Store(spark, f"file://{tmp_path_factory.mktemp('serving')}/index", "hashing", 8)
    store.upsert(batch(spark, paper("a", title="rings"), paper("b", title="graphs"), paper("c", title="rings and graphs", categories="math.AG")))
    store.embed_pending(HashingEmbedder(8))
    store.upsert(batch(spark, paper("p", date="2024-05-05", categories="math.AC")))
    found = ResidentView(store, HashingEmbedder(8), OverlapReranker())
    yield found
    found.close()


def test_ask():
    assert Ask.of("k=9999").k == 500 and Ask.of("k=-3").k == 1 and Ask.of("k=x").k == 20 and Ask.of("").k == 20
    assert Ask.of("cat=math.CO&cat=none").categories == ["math.CO"] and Ask.of("cat=none").empty
    assert Ask.of("q=+rings+").text == "rings" and Ask.of("rerank=yes").rerank and not Ask.of("rerank=0").rerank
    assert Ask.of("since=2024-1-5").since == "2024-01-05"
    with pytest.raises(ValueError):
        Ask.of("since=yesterday")


def test_search(view):
    code, found = answer(view, "/api/search", "q=rings&k=2")
    assert code == "200 OK" and len(found["results"]) == 2 and found["ranked"] == "relevance" and not found["reranked"]
    assert answer(view, "/api/search", "q=rings&rerank=1")[1]["reranked"]
    code, listed = answer(view, "/api/search", "cat=math.AC")
    assert [r["id"] for r in listed["results"]] == ["p"] and listed["ranked"] == "date" and "hint" not in listed
    assert not answer(view, "/api/search", "cat=math.CO&rerank=1")[1]["reranked"]
    code, none = answer(view, "/api/search", "q=rings&cat=math.AC")
    assert code == "200 OK" and none["results"] == [] and none["hint"].startswith("1 papers")
    assert "hint" not in answer(view, "/api/search", "q=rings&author=nobody")[1]


def test_faults(view):
    for path, given, code in (
        ("/api/search", "", "400"),
        ("/api/search", "q=x&since=2024-13-01", "400"),
        ("/api/similar", "id=p", "404"),
        ("/api/similar", "id=none", "404"),
        ("/api/bibtex", "id=none", "404"),
        ("/api/other", "", "404"),
    ):
        got, content = answer(view, path, given)
        assert got.startswith(code) and content["error"]


def test_similar_stats_and_cite(view):
    assert sorted(r["id"] for r in answer(view, "/api/similar", "id=a")[1]["results"]) == ["b", "c"]
    stats = answer(view, "/api/stats")[1]
    assert (stats["papers"], stats["pending"], stats["categories"]["math.CO"]) == (4, 1, 2)
    assert answer(view, "/api/bibtex", "id=a")[1]["entry"].startswith("@online{")


def test_a_commit_is_seen(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/index", "hashing", 8)
    view = ResidentView(store, HashingEmbedder(8))
    assert view.status()["papers"] == 0
    for n in (1, 2, 3):  # the tables that the view first read are gone by now
        store.upsert(batch(spark, paper(f"p{n}")))
        assert view.status()["papers"] == n
    view.close()


def test_server(view):
    with server(view, port=0) as running:
        thread = threading.Thread(target=running.serve_forever)
        thread.start()
        try:
            with urlopen(f"http://127.0.0.1:{running.server_port}/api/stats", timeout=60) as reply:
                assert json.load(reply)["papers"] == 4
        finally:
            running.shutdown()
            thread.join()


def test_registered_functions(spark):
    assert "dot" in registered.register(spark)
    got = spark.sql("SELECT dot(array(1, 2), array(3, 4)) AS d, l2_normalise(array(0, 0)) AS z, l2_normalise(array(3, 4)) AS u, cite_key(null) AS k, dot(null, array(1)) AS n").first()
    assert got["d"] == 11 and got["z"] == [0, 0] and got["u"] == [0.6, 0.8] and got["k"].endswith(":") and got["n"] is None


def test_citations_in_sql_equal_the_columns(spark):
    from lodestar.functions import cite

    assert {"arxiv_year", "biblatex"} <= set(registered.register(spark))
    rows = [
        ("math/0605123", r"On  $x$ {a} } {", "A. One and B. Two, and ", "math.CO cs.X", "2006-05-01", "10.1/{x", " J.  1 "),
        ("9013.1", "", None, None, "1999-01-01", None, None),
        ("alg-geom/9202001", None, "and", " ", None, "", ""),
        ("x", "}{{a}b}", "X, Y & Z, &", "\tmath.AG", "soon", "d", None),
    ]
    papers = spark.createDataFrame(rows, "id string, title string, authors string, categories string, update_date string, doi string, journal_ref string")
    papers.createOrReplaceTempView("cited")
    shown = spark.sql("SELECT id, arxiv_year(id, update_date) AS year, biblatex(id, title, authors, categories, update_date, doi, journal_ref) AS entry, balance_braces(title) AS title FROM cited")
    from pyspark.sql import functions as F

    wanted = papers.select("id", cite.id_year(F.col("id"), F.col("update_date")).alias("year"), cite.biblatex().alias("entry"), cite.balance_braces(F.col("title")).alias("title"))
    assert sorted(map(tuple, shown.collect())) == sorted(map(tuple, wanted.collect()))
