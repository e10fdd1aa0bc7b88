import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from lodestar.llm import resampling

from . import cases

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text, longest):
    ws = WORDS.findall((text or "").translate(cases.UPPER))
    return ws, [" ".join(ws[i : i + n]) for n in range(1, longest + 1) for i in range(len(ws) - n + 1)]


def plain(rows, targets, longest, buckets):
    """(doc_id, words, features, weight) of each row."""
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    own = [grams(t, longest) for _, t in rows]
    s = Counter(bucket(g) for _, gs in own for g in gs)
    t = Counter(bucket(g) for x in targets for g in grams(x, longest)[1])
    up, down = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * up / ((s[b] + 1) * down)))
    return [(d, len(ws), len(gs), sum(gain(bucket(g)) for g in gs) // len(gs) if gs else 0) for (d, _), (ws, gs) in zip(rows, own)]


def plain_draw(weighed, percent, least, seed):
    scores = []
    for d, n_words, n, weight in weighed:
        h = None if d is None else int(hashlib.sha256(f"{seed}:{d}".encode()).hexdigest()[:8], 16)
        scores.append(None if h is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))))
    can = sorted((i for i, x in enumerate(weighed) if scores[i] is not None and x[1] >= least), key=lambda i: (-scores[i], weighed[i][0]))
    ranks = {i: k + 1 for k, i in enumerate(can[: len(can) * percent // 100])}
    return [(*x, scores[i], ranks.get(i)) for i, x in enumerate(weighed)]


ROWS = [*cases.TEXTS, *((100 + i, f"Mixed-case WORDS no.{i % 7} and words_and {'more ' * (i % 5)}é{i} " * (i % 9)) for i in range(120))]
TARGETS = ["and more words of é1", None, "", "mixed case no 3 3 3", "x " * 40]


@pytest.mark.parametrize("longest,buckets,block_words", [(1, 10_000, 1 << 21), (1, 7, 50), (3, 50, 200), (2, 10_000, 1)])
def test_weights_and_draw(spark, longest, buckets, block_words):
    target = spark.createDataFrame([(i, t) for i, t in enumerate(TARGETS)], "item_id int, text string")
    weighed = resampling.weigh(cases.documents(spark, ROWS), target, longest, buckets, block_words)
    expected = plain(ROWS, TARGETS, longest, buckets)
    assert sorted(map(tuple, weighed.collect()), key=repr) == sorted(expected, key=repr)
    drawn = resampling.draw(weighed, 35, 3, 7)
    assert sorted(map(tuple, drawn.collect()), key=repr) == sorted(plain_draw(expected, 35, 3, 7), key=repr)


def test_empty_tables(spark):
    target = spark.createDataFrame([(1, "a b c")], "item_id int, text string")
    assert resampling.draw(resampling.weigh(cases.empty(spark), target)).count() == 0
    weighed = resampling.weigh(cases.documents(spark, ROWS), target.limit(0))
    assert sorted(map(tuple, weighed.collect()), key=repr) == sorted(plain(ROWS, [], 1, 10_000), key=repr)
    nothing = cases.documents(spark, [(1, None), (2, ""), (3, "--")])
    assert {tuple(r) for r in resampling.weigh(nothing, target).collect()} == {(d, 0, 0, 0) for d in (1, 2, 3)}
