import math
import zlib

import numpy as np
import pytest

from lodestar import llm
from lodestar.llm import ranking

from . import cases


def of(text):
    return dict(zip(ranking.FEATURES, ranking.features(text)))


def test_features_by_hand():
    f = of("One one, two.\none, two. three\none, two. three |\n\nhttp://x/9 #")
    assert math.isclose(f["log_words"], math.log(13))
    assert f["distinct_words"] == 7 / 12 and f["top_word"] == 3 / 12 and f["repeats"] == 0.0
    assert f["repeated_trigrams"] == 2 / 12  # "one, two. three"
    assert f["bars"] == 1 / 12 and f["links"] == 1 / 12 and f["stopped_lines"] == 1 / 4 and f["repeated_lines"] == 0.0
    assert of("a a a a")["repeats"] == 1.0 and of("a a a a")["repeated_trigrams"] == 0.5
    assert of("a\nb\na\n\n")["repeated_lines"] == 1 - 2 / 3
    for empty in (None, "", " \n\t"):
        assert ranking.features(empty) == [0.0] * len(ranking.FEATURES)


def test_features_are_finite_for_any_text(spark):
    rows = cases.TEXTS + [(50, "x" * 1_000_000), (51, "a b " * 300_000), (52, "\n".join("line" for _ in range(100_000)))]
    found = ranking.featured(cases.documents(spark, rows)).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in found) == sorted((d is None, d or 0) for d, _ in rows)
    assert all(len(r["x"]) == len(ranking.FEATURES) and np.isfinite(r["x"]).all() for r in found)


def table(spark, n1, n0, seed=0):
    """Labelled rows whose features 0 and 1 lean with the label; ids repeat."""
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n1 + n0):
        x = rng.normal(size=len(ranking.FEATURES))
        x[0] += 1.2 * (k < n1)
        x[1] -= 0.8 * (k < n1)
        rows.append((int(k // 2), x.tolist(), bool(k < n1)))
    return rows, spark.createDataFrame(rows, "doc_id long, x array<double>, preferred boolean").repartition(5)


@pytest.mark.parametrize("n1,n0,most", [(60, 9, 1000), (9, 60, 1000), (5, 2, 1000), (1, 30, 1000), (40, 40, 12)])
def test_every_row_is_in_a_pair(spark, n1, n0, most):
    rows, known = table(spark, n1, n0)
    pairs = [(tuple(r["better"]), tuple(r["worse"])) for r in ranking.preferences(known, most).collect()]
    better, worse = {tuple(x) for _, x, p in rows if p}, {tuple(x) for _, x, p in rows if not p}
    assert len(pairs) == len(set(pairs)) == max(min(n1, most), min(n0, most)) * min(ranking.PAIRS_A_ROW, n1, n0, most)
    assert {a for a, _ in pairs} <= better and {b for _, b in pairs} <= worse
    assert len({a for a, _ in pairs}) == min(n1, most) and len({b for _, b in pairs}) == min(n0, most)


def test_coefficients_have_the_least_pairwise_loss(spark):
    rows, known = table(spark, 150, 60)
    model = ranking.fit(known)
    x = np.array([r[1] for r in rows])
    assert np.allclose(model.mean, x.mean(0)) and np.allclose(model.spread, x.std(0))
    pairs = [(r["better"], r["worse"]) for r in ranking.preferences(known).collect()]
    standard = lambda v: np.clip((np.array(v) - x.mean(0)) / x.std(0), -8, 8)
    apart = np.array([standard(a) - standard(b) for a, b in pairs])

    def loss(w):
        return np.logaddexp(0, -(apart @ w)).sum() + ranking.RIDGE * len(apart) / 2 * (w @ w)

    least = loss(model.coefficients)
    rng = np.random.default_rng(1)
    for size in (1e-1, 1e-2, 1e-3):
        assert all(loss(model.coefficients + size * rng.normal(size=len(model.coefficients))) > least for _ in range(30))
    strengths = np.sort(model.strengths(x))
    assert math.isclose(model.at, (strengths[59] + strengths[60]) / 2)


def test_without_preferences_all_texts_are_alike(spark):
    for n1, n0 in ((0, 0), (5, 0), (0, 5)):
        model = ranking.fit(table(spark, n1, n0)[1])
        rows = ranking.featured(cases.documents(spark))
        scores = {r["score"] for r in ranking.score(rows, model).collect()}
        assert len(scores) == 1 and math.isclose(scores.pop(), ranking.THRESHOLD)
    assert ranking.score(ranking.featured(cases.empty(spark)), ranking.fit(table(spark, 9, 3)[1])).count() == 0


def test_held_out_rows_do_not_train(spark):
    docs = cases.documents(spark, [(i, f"text {i}") for i in range(40)])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in [*range(40), *range(40), 99]] + [(None, 1, 0), (3, None, 0), (5, 7, 0)], "doc_id long, quality int, toxic int")
    known = ranking.labelled(ranking.featured(docs), labels)
    kept = [i for i in range(40) if zlib.crc32(str(i).encode()) % 4 != 2]
    assert sorted((r["doc_id"], r["preferred"]) for r in known.collect()) == [(i, i % 2 == 1) for i in kept]


def test_query_ranks_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.01"
    found = llm.queries()["op11_quality_ranking"](spark, sf_dir)
    assert found.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    rows = found.join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").where("held_out").collect()
    assert all(r["predicted"] == int(r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in rows)
    good, bad = ([r["score"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert np.mean([a > b for a in good for b in bad]) > 0.98
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.95
