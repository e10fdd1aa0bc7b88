import hashlib
import math
import random
from collections import defaultdict

import pytest

from lodestar.llm import codes


SCHEMA = "vec_id long, embedding array<double>, label int, error long, code string, _label int, _n int"


def plain(rows, parts, entries, rounds):
    """((vec_id, code, error, label_error) sorted, digest of the codebooks)."""
    kept = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return [], hashlib.sha256(b"").hexdigest()
    first = {}
    for i, v, _ in kept:
        first[i] = min(v, first.get(i, v))
    seeds = [first[i] for i in sorted(first, key=lambda i: (i is None, i or 0))[:entries]]
    w = len(seeds[0]) // parts
    cut = lambda v, p: v[p * w : p * w + w]
    books = [[cut(v, p) for v in seeds] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            groups = defaultdict(list)
            for _, v, _ in kept:
                groups[near(cut(v, p), book)[1]].append(cut(v, p))
            books[p] = [[sum(x) // len(groups[k]) for x in zip(*groups[k])] if k in groups else c for k, c in enumerate(book)]
    found = [[near(cut(v, p), books[p]) for p in range(parts)] for _, v, _ in kept]
    errors = [sum(d for d, _ in f) for f in found]
    sums = defaultdict(int)
    for (_, _, label), e in zip(kept, errors):
        sums[label] += e
    most = (1 << 63) - 1
    out = [(i, "".join(f"{k:02x}" for _, k in f), min(e, most), min(sums[label], most)) for (i, _, label), f, e in zip(kept, found, errors)]
    return out, hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()


def made(n, dim, scale=1.0, seed=0):
    rng = random.Random(seed)
    rows = [(i * 3, [rng.gauss(0, scale) for _ in range(dim)], rng.choice([None, 0, 1, 1, 1])) for i in range(n)]
    bad = [(1, None, 1), (2, [math.nan] * dim, 1), (4, [1.0] * (dim - 1) + [math.inf], 0), (5, [None] + [0.0] * (dim - 1), None)]
    return rows + bad + [rows[n // 2]] * 3 + [(None, [0.5] * dim, 7), (3, [0.25] * dim, 1), (3, [-0.25] * dim, 2)]


def check(spark, rows, parts, entries, rounds):
    vectors = spark.createDataFrame([(*r, 9, "z", 1, 2) for r in rows], SCHEMA).repartition(5)
    coded, books = codes.compress(vectors, parts, entries, rounds)
    got = codes.with_label_errors(codes.cut(coded)).select("vec_id", "code", "error", "label_error")
    expected, digest = plain(rows, parts, entries, rounds)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(expected, key=repr)
    assert codes.digest(books) == digest


@pytest.mark.parametrize("n,dim,parts,entries,rounds", [(150, 8, 4, 16, 6), (80, 6, 2, 5, 3), (40, 3, 1, 1, 2), (3, 8, 8, 16, 6)])
def test_codes(spark, n, dim, parts, entries, rounds):
    check(spark, made(n, dim), parts, entries, rounds)


def test_large_components_are_exact(spark):
    check(spark, made(60, 8, 30_000.0), 4, 8, 3)
    check(spark, made(60, 8, 2e5), 4, 8, 3)


def test_small_blocks_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(codes, "BLOCK_ROWS", 7)
    check(spark, made(90, 8), 4, 16, 4)


def test_labels_of_all_shares_are_summed(spark, monkeypatch):
    for share in (0.0, 0.3, 1.0):
        monkeypatch.setattr(codes, "HOT_SHARE", share)
        check(spark, made(60, 4), 2, 4, 1)


def test_empty_and_refused(spark):
    for rows in ([], [(1, None, 1), (2, [math.nan] * 8, 2)]):
        check(spark, rows, 4, 16, 2)
    huge = spark.createDataFrame([(1, [1e30] * 8, 1), (2, [-1e30] * 8, 1), (3, [1e30] * 8, 1)], "vec_id long, embedding array<double>, label int")
    assert {r["error"] for r in codes.compress(huge, 8, 1, 1)[0].collect()} == {(1 << 63) - 1}
    ragged = spark.createDataFrame([(1, [1.0] * 8, 1), (2, [1.0] * 16, 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(Exception, match="components"):
        codes.compress(ragged)
