import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestar.llm import hashing, repeats

from . import cases


def found(df):
    return sorted(((r["doc_id"], *r["repeats"]) for r in df.collect()), key=repr)


def expected(rows, window=35):
    return sorted(((d, *k) for (d, _), k in zip(rows, cases.kept_words(rows, window))), key=repr)


@pytest.mark.parametrize("hot", [1, 2000])
def test_awkward_table(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT_ANCHOR", hot)
    docs = cases.documents(spark)
    got = repeats.mark_repeats(docs)
    assert got.columns == [*docs.columns, "repeats"]
    assert found(got) == expected(cases.TEXTS)
    assert repeats.mark_repeats(cases.empty(spark)).count() == 0


@pytest.mark.parametrize("hot", [3, 2000])
def test_shared_passages(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT_ANCHOR", hot)
    rng = np.random.default_rng(3)
    passages = [[f"p{k}_{i}" for i in range(n)] for k, n in enumerate((34, 35, 36, 50, 120))] + [["z"] * 90, ["x", "y"] * 40]
    rows = []
    for d in range(60):
        ws = [f"d{d}_{i}" for i in range(rng.integers(0, 30))]
        for k in rng.integers(0, len(passages), rng.integers(0, 4)):
            cut = rng.integers(0, 3)
            ws += passages[k][cut:] + [f"d{d}_{k}"] * int(rng.integers(0, 2))
        rows.append((d, " ".join(ws)))
    assert found(repeats.mark_repeats(cases.documents(spark, rows))) == expected(rows)


@given(st.lists(st.lists(st.sampled_from("abc"), max_size=60), min_size=1, max_size=4), st.integers(2, 12))
@settings(max_examples=150, deadline=None)
def test_anchors_hang_on_the_window_alone(texts, window):
    flat, n = hashing.word_hashes([" ".join(t) for t in texts])
    assert n.tolist() == [len(t) for t in texts]
    first = np.cumsum(n) - n
    starts, name, _ = repeats.anchors(flat, np.repeat(np.arange(len(n)), n), first, first + n - 1, window)
    seen = {}
    for s, a in zip(starts.tolist(), name.tolist()):
        assert seen.setdefault(flat[s : s + window].tobytes(), a) == a
    assert len(starts) == sum(max(0, k - window + 1) for k in n)


@given(st.lists(st.text(alphabet="aAb \t\x0b\u00e9\u2003\x1c", max_size=20), max_size=5), st.booleans())
@settings(max_examples=200, deadline=None)
def test_word_hashes_name_words(texts, lower):
    flat, n = hashing.word_hashes(texts, lower)
    words = [hashing.split(t, lower) for t in texts]
    assert n.tolist() == [len(w) for w in words]
    every = [w for ws in words for w in ws]
    assert len(set(zip(every, flat.tolist()))) == len(set(every)) == len(set(flat.tolist()))


@given(st.lists(st.integers(0, 2**64 - 1), max_size=80), st.integers(1, 40))
@settings(max_examples=100, deadline=None)
def test_window_hashes(values, k):
    words = np.array(values, np.uint64)
    got = hashing.window_hashes(words, k)
    assert len(got) == max(0, len(words) - k + 1)
    base = hashing.mix(words)
    for i in range(len(got)):
        total = np.zeros(1, np.uint64)
        for x in base[i : i + k]:
            total = total * hashing.power(1) + x
        assert got[i] == hashing.mix(total)[0]


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    want = sorted((d, n, m, hashlib.sha256(t.encode()).hexdigest()) for d, n, m, t in expected(rows))
    assert sorted(tuple(r) for r in repeats.op3_substring_dedup(spark, sf_dir).collect()) == want
