import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestar.llm import jaccard

from . import cases


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def expected(rows):
    return sorted(((d, *c) for (d, _), c in zip(rows, cases.components(rows))), key=repr)


def test_awkward_table(spark):
    docs = cases.documents(spark)
    assert found(jaccard.similarity_components(docs)) == expected(cases.TEXTS)
    assert jaccard.similarity_components(cases.empty(spark)).count() == 0


def group(seed, n, base_words=60, edits=3):
    """Near copies of one text, some of which link only through others."""
    rng = np.random.default_rng(seed)
    base = [f"b{seed}_{i}" for i in range(base_words)]
    rows = []
    for k in range(n):
        ws = list(base)
        for at in rng.integers(0, base_words, rng.integers(0, edits + 1)):
            ws[at] = f"e{rng.integers(0, 4)}"
        rows.append(" ".join(ws))
    return rows


@pytest.mark.parametrize("frequent", [1, 32])
def test_groups(spark, monkeypatch, frequent):
    """Large groups of near copies, boilerplate that many share, and short texts; also with all tokens frequent."""
    monkeypatch.setattr(jaccard, "MIN_FREQUENT", frequent)
    texts = [t for seed in range(6) for t in group(seed, 25, 40 + 20 * seed)]
    line = " ".join(f"line{i}" for i in range(30))
    texts += [f"{line} {' '.join(f'u{k}_{i}' for i in range(k % 9))}" for k in range(60)]
    texts += ["same words here for all of us"] * 40
    rows = list(enumerate(texts))
    assert found(jaccard.similarity_components(cases.documents(spark, rows))) == expected(rows)


@given(st.integers(2, 60), st.floats(0, 1), st.integers(0, 2**32), st.integers(1, 14))
@settings(max_examples=200, deadline=None)
def test_similar_sets_share_a_key(n, share, seed, edits):
    rng = np.random.default_rng(seed)
    pool = np.sort(rng.choice(2**62, 2 * n + 40, replace=False).astype(np.uint64))
    x = np.sort(rng.choice(pool, n, replace=False))
    drop = rng.choice(n, min(n - 1, rng.integers(0, edits)), replace=False)
    y = np.unique(np.r_[np.delete(x, drop), rng.choice(pool, rng.integers(0, edits))])
    frequent = {int(t) for t in pool if rng.random() < share}
    both = len(np.intersect1d(x, y))
    if 100 * both < 80 * (len(x) + len(y) - both) or np.array_equal(x, y):
        return
    keys = [set(np.concatenate(jaccard.prefix_keys(s, np.array([int(t) in frequent for t in s]))).tolist()) for s in (x, y)]
    assert keys[0] & keys[1]


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["label"] for r in jaccard.components(edges).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}
    assert jaccard.components(edges.limit(0)).count() == 0


@pytest.mark.parametrize("frequent", [1, 32])
def test_link_counts(spark, monkeypatch, frequent):
    """Every link inside groups of near copies and of copies, against all pairs."""
    monkeypatch.setattr(jaccard, "MIN_FREQUENT", frequent)
    texts = group(0, 40, 60) + group(1, 30, 90) + ["same words here for all of us"] * 20 + ["", None, "one"]
    rows = list(enumerate(texts)) + [(d if d is None else d + 1000, t) for d, t in cases.TEXTS]
    sets = [cases.shingle_set(t) for _, t in rows]
    alike = lambda x, y: bool(x) and 100 * len(x & y) >= 80 * len(x | y)
    want = [(d, sum(alike(x, y) for y in sets) - bool(x)) for (d, _), x in zip(rows, sets)]
    assert found(jaccard.link_counts(cases.documents(spark, rows))) == sorted(want, key=repr)
    assert jaccard.link_counts(cases.empty(spark)).count() == 0


def test_close_lists(spark, monkeypatch):
    """One list of sets that no sweep has joined, in blocks of three: widths of bitmaps, strays and homes of all sizes."""
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 3)
    texts = [t for seed in range(3) for t in group(seed, 20, 40 + 90 * seed, 6)] + ["one", "two words"]
    rows = list(enumerate(dict.fromkeys(texts)))
    docs = cases.documents(spark, rows)
    measured = jaccard._measure(docs)
    sets = measured.groupBy("a").agg(F.min("doc_id").alias("first"), F.max("n").alias("n"), F.max("bits").alias("bits"))
    members = sets.select(F.lit(7).cast("long").alias("key"), "a")
    pairs = members.join(members.toDF("key", "b"), "key").where("a < b AND a % 3 = 0 AND b % 3 = 0").select("a", "b")
    some = jaccard.components(jaccard._similar(pairs, docs, sets))
    for labels in (some, some.limit(0)):
        closed = {r["node"]: r["label"] for r in jaccard._close_lists(members, labels, docs, sets).collect()}
        of = {r["doc_id"]: closed.get(r["a"], r["a"]) for r in measured.collect()}
        want = {d: c for (d, _), (_, c) in zip(rows, cases.components(rows))}
        assert len(set(zip(of.values(), (want[d] for d in of)))) == len(set(of.values())) == len(set(want.values()))


def test_large_group(spark):
    """Some hundreds of near copies, many of them with no link at all, over several posting lists."""
    rows = list(enumerate(group(9, 400, 70, 9)))
    want = expected(rows)
    assert len({c for *_, c in want}) > 40
    assert found(jaccard.similarity_components(cases.documents(spark, rows))) == want


@given(st.integers(1, 300), st.integers(0, 2**32), st.integers(0, 120))
@settings(max_examples=200, deadline=None)
def test_bitmaps_rule_out_no_link(n, seed, edits):
    rng = np.random.default_rng(seed)
    x = np.unique(rng.integers(0, 2**63, n, np.uint64))
    y = np.unique(np.r_[rng.choice(x, max(1, len(x) - edits), replace=False), rng.integers(0, 2**63, rng.integers(0, edits + 1), np.uint64)])
    both = len(np.intersect1d(x, y))
    bits = [np.frombuffer(jaccard.bitmap(s), np.uint64) for s in (x, y)]
    if 100 * both >= 80 * (len(x) + len(y) - both):
        assert jaccard.may_be_similar(bits[0], len(x), bits[1][None], np.array([len(y)]))[0]


def test_keep_one(spark):
    """Each component keeps one row, also where other rows carry its id; what has no id or no words stays."""
    rows = [*cases.TEXTS, (20, "alpha beta"), (21, "alpha beta"), (21, "gamma delta"), (22, "gamma delta"), (22, None), (22, None)]
    docs = cases.documents(spark, rows)
    left = jaccard.keep_one(docs)
    assert left.columns == docs.columns
    groups = []  # of one text each, joined while two of them link
    for d, t in rows:
        own = [(d, t, cases.shingle_set(t))]
        for g in [g for g in groups if any(s and 100 * len(s & own[0][2]) >= 80 * len(s | own[0][2]) for *_, s in g)]:
            groups.remove(g)
            own += g
        groups.append(own)
    want = [(d, t) for d, t in rows if d is None or not cases.words(t)]
    for g in groups:
        want += sorted({(d, t) for d, t, s in g if d is not None and s})[:1]
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=repr) == sorted(want, key=repr)
    assert jaccard.keep_one(cases.empty(spark)).count() == 0


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert found(jaccard.op1_ngram_jaccard(spark, sf_dir)) == expected(rows)
