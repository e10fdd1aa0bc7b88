from collections import Counter

import numpy as np

from lodestar.llm import decontaminate as D

from . import cases


def holds(text, item):
    """An item stands word for word in the text, case and outer punctuation aside."""
    a, b = D.terms(text), D.terms(item)
    return bool(b) and any(a[i : i + len(b)] == b for i in range(len(a) - len(b) + 1))


def items_of(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


ITEMS = [
    (1, "What grows in spring when rain comes early?\nGrass and clover grow first."),
    (2, " ".join(f"q{i}" for i in range(200)) + "\n" + " ".join(f"a{i}" for i in range(9))),
    (3, None),
    (4, ""),
    (5, "brief"),
    (6, "What grows in spring when rain comes early?\nGrass and clover grow first."),
]


def test_find_and_remove(spark):
    filler = " ".join(f"f{i}" for i in range(500))
    rows = [
        (1, f"{filler} {ITEMS[0][1].upper()} {filler}"),
        (2, f"{filler} {ITEMS[1][1]}"),
        (3, f"{filler} {filler}"),
        (4, ITEMS[0][1].replace("early", "soon")),
        (5, "What grows in spring? Nobody says that grass comes early, or first."),
        *cases.TEXTS,
    ]
    rows = [(d if d is None else d + (100 if k > 4 else 0), t) for k, (d, t) in enumerate(rows)]
    docs, items = cases.documents(spark, rows), items_of(spark, ITEMS)
    got = sorted((r["doc_id"], r["item_id"]) for r in D.find(docs, items).collect())
    assert got == [(1, 1), (1, 6), (2, 2), (4, 1), (4, 6)]
    left = D.remove(docs, items)
    assert left.columns == docs.columns
    assert Counter(r["doc_id"] for r in left.collect()) == Counter(d for d, _ in rows) - Counter([1, 2, 4])
    assert D.find(cases.empty(spark), items).count() == 0
    assert D.find(docs, items.limit(0)).count() == 0
    assert D.remove(docs, items_of(spark, ITEMS[2:4])).count() == len(rows)


def test_parts_of_items(spark):
    """A question without its longer answer, a long answer without its question, and a passage of a longer item."""
    filler = " ".join(f"f{i}" for i in range(300))
    question, answer = "Which herbs grow beside the old mill in May?", " ".join(f"z{i}" for i in range(40))
    long = [f"l{i}" for i in range(600)]
    items = items_of(spark, [(1, f"{question}\n{answer}"), (2, " ".join(long)), (3, "Why not?\n" + " ".join(f"y{i}" for i in range(30)))])
    rows = [
        (1, f"{filler} {question} {filler}"),
        (2, f"{filler} {answer} {filler}"),
        (3, f"{filler} {' '.join(long[130:290])} {filler}"),
        (4, f"{filler} {' '.join(long[130:150])} {filler}"),
        (5, f"{filler} why not? {filler}"),
        (6, f"{question} {answer}"),
    ]
    docs = cases.documents(spark, rows)
    got = {(r["doc_id"], r["item_id"]): (r["question_overlap"], r["answer_overlap"]) for r in D.find(docs, items).collect()}
    assert sorted(got) == [(1, 1), (2, 1), (3, 2), (6, 1)]
    assert got[1, 1] == (1.0, 0.0) and got[2, 1] == (0.0, 1.0) and got[6, 1] == (1.0, 1.0)
    assert sorted(r["doc_id"] for r in D.remove(docs, items).collect()) == [4, 5]


def test_shards_find_the_same(spark):
    docs, items = cases.documents(spark, [(1, ITEMS[0][1]), (2, ITEMS[1][1]), (3, "x")]), items_of(spark, ITEMS)
    whole = sorted(tuple(r) for r in D.find(docs, items).collect())
    shards = list(D.indexes(items, 300))
    assert len(shards) > 1
    found = [(d, *x) for d, t in ((1, ITEMS[0][1]), (2, ITEMS[1][1]), (3, "x")) for s in shards for x in D.Searcher(s.value).find(t)]
    assert sorted(found) == whole


def test_pruned_retrieval_equals_full_scoring():
    """All passages and chunks at or above the threshold, and no others, against BM25 without any bound."""
    rng = np.random.default_rng(5)
    vocabulary = [f"t{i}" for i in range(120)]
    weights = 1 / np.arange(1, 121)
    draw = lambda n: list(rng.choice(vocabulary, n, p=weights / weights.sum()))
    rows = [(i, " ".join(draw(rng.integers(3, 90)))) for i in range(40)]
    df = Counter(t for _, x in rows for t in set(D.terms(x)))
    index = D.Index.build(rows, df, len(rows), sum(len(D.terms(x)) for _, x in rows) / len(rows))
    searcher = D.Searcher(index)
    for _ in range(60):
        ws = draw(rng.integers(1, 500))
        if rng.random() < 0.5:
            ws[3:3] = D.terms(rows[rng.integers(0, 40)][1])
        numbers = searcher.numbers([w.encode() for w in ws])
        got = {(p, c): round(s, 9) for p, c, s in searcher.passages(numbers)}
        want = {}
        for p in range(max(-(-len(ws) // D.CHUNK) - 1, 1)):
            held = {index.vocabulary[w] for w in ws[p * D.CHUNK : (p + 2) * D.CHUNK] if w in index.vocabulary}
            score = Counter()
            for t in held:
                score.update(index.scored[t])
            want |= {(p, c): round(s, 9) for c, s in score.items() if s >= D.MIN_SCORE - 1e-9}
        assert got == want


def test_query(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = {(r["doc_id"], r["item_id"]) for r in D.op8_decontamination(spark, sf_dir).collect()}
    assert got == {(d, i) for d, t in docs for i, x in items if holds(t, x)}


def test_forty_shards_read_the_items_once(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(2**60 + i, " ".join(f"w{x}" for x in rng.integers(0, 400, 30))) for i in range(200)] + [(None, "an item without an id that has ten words in it")]

    def seen(batches):
        for batch in batches:
            with open(tmp_path / "reads", "a") as f:
                f.write("x" * batch.num_rows)
            yield batch

    items = items_of(spark, rows).coalesce(1).mapInArrow(seen, "item_id long, text string")
    assert D.build_indexes(items, 500).count() > 40
    assert len((tmp_path / "reads").read_text()) == len(rows)
    docs = cases.documents(spark, [(k, f"before {t} after") for k, (_, t) in enumerate(rows)])
    real = D._passes
    monkeypatch.setattr(D, "_passes", lambda items: real(items, 500))
    monkeypatch.setattr(D, "PASS_INDEXES", 60)
    whole = sorted((r["doc_id"], r["item_id"]) for r in D.find(docs, items_of(spark, rows)).collect())
    assert whole == [(k, i) for k, (i, _) in enumerate(rows)]
    few = items_of(spark, rows[:30])
    monkeypatch.setattr(D, "PASS_INDEXES", 2)  # passes whose results are written before the next
    passes = [more for _, more in real(few, 500)]
    assert sorted((r["doc_id"], r["item_id"]) for r in D.find(docs, few).collect()) == whole[:30]
    assert sorted(r["doc_id"] for r in D.remove(docs, few).collect()) == list(range(30, len(rows)))
    assert len(passes) > 2 and passes == [True] * (len(passes) - 1) + [False]
