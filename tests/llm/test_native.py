"""Lines, quality rules, licences and preferences: DataFrame functions only, held against plain versions."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lodestar import llm
from lodestar.llm import licences, lines, preferences, quality

from . import cases
from ..compare import assert_same

NATIVE = ["op5_license_scan", "op6_line_dedup", "op9_preference_format", "op10_quality_rules"]


@pytest.mark.parametrize("name", NATIVE)
def test_no_python_in_the_plan(spark, sf_dir, name):
    plan = llm.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_sql(spark, sf_dir, name):
    assert_same(llm.queries()[name](spark, sf_dir), sf_dir, llm.oracle_sql()[name])


def plain_lines(rows, sites, most):
    on = defaultdict(set)
    for (_, t), s in zip(rows, sites):
        for line in (t or "").split("\n"):
            if cases.words(line) and s is not None:
                on[line].add(s)
    out = []
    for d, t in rows:
        ls = (t or "").split("\n")
        gone = [len(on[x]) >= most and bool(cases.words(x)) for x in ls]
        clean = None if t is None else "\n".join(x for x, g in zip(ls, gone) if not g)
        out.append((d, sum(bool(cases.words(x)) for x in ls), sum(gone), clean))
    return sorted(out, key=repr)


@pytest.mark.parametrize("most", [1, 2, 5, 30])
def test_line_spread(spark, most):
    rows = list(cases.TEXTS) + [(100 + i, f"line {i % 3}\nnext {i % 11}\n\nown {i}\nline {i % 3}") for i in range(60)]
    sites = [None if i % 13 == 0 else f"s{i % 40}" for i in range(len(rows))]
    docs = cases.documents(spark, rows, sites.__getitem__)
    got = lines.mark_lines(docs, most)
    assert got.columns == [*docs.columns, "line_dedup"]
    assert sorted(((r["doc_id"], *r["line_dedup"]) for r in got.collect()), key=repr) == plain_lines(rows, sites, most)
    assert lines.mark_lines(cases.empty(spark)).count() == 0
    assert lines.dedup_lines(docs).columns == docs.columns


def test_near_threshold_lines_are_counted_exactly(spark):
    rows = [(i, f"line {k}") for k in range(50, 150, 7) for i in range(k)]
    sites = [f"s{i}" for i, _ in rows]
    got = lines.mark_lines(cases.documents(spark, rows, sites.__getitem__), 100)
    assert sorted(((r["doc_id"], *r["line_dedup"]) for r in got.collect()), key=repr) == plain_lines(rows, sites, 100)


def test_quality(spark):
    docs = cases.documents(spark)
    got = quality.score(docs)
    assert got.columns == [*docs.columns, "quality"]
    plain = []
    for d, t in cases.TEXTS:
        ws, t_ = cases.words(t), t or ""
        grams = Counter(tuple(ws[i : i + 3]) for i in range(len(ws) - 2))
        covered = {i + k for i in range(len(ws) - 2) if grams[tuple(ws[i : i + 3])] > 1 for k in range(3)}
        ls = [x for x in t_.split("\n") if cases.words(x)]
        failed = len(ws) < 50 or 100 * len(covered) > 50 * len(ws)
        plain.append((d, len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t_), len(ls) - len(set(ls)), len(covered), failed))
    names = "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed".split()
    assert sorted(((r["doc_id"], *(r["quality"][n] for n in names)) for r in got.collect()), key=repr) == sorted(plain, key=repr)
    assert quality.score(cases.empty(spark)).count() == 0
    assert all(not (r["quality"]["kept"] and r["quality"]["base_failed"]) for r in got.collect())


def test_columns_with_the_operators_own_names_survive(spark):
    docs = cases.documents(spark, [(1, " ".join(f"Word{i} follows word{i} here." for i in range(30))), (2, None), (3, "x")])
    docs = docs.withColumns({"quality": F.lit("mine"), "line_dedup": F.lit("own"), "with.dot": F.lit(7)})
    for kept, n in ((quality.clean(docs), 1), (lines.dedup_lines(docs), 3)):
        assert kept.schema.simpleString() == docs.schema.simpleString()
        got = kept.select("quality", "line_dedup", "`with.dot`", "found", "row").collect()
        assert [tuple(r) for r in got] == [("mine", "own", 7, "f", "q")] * n


@pytest.mark.parametrize("made", [quality.clean, quality.score])
def test_rules_are_evaluated_once(spark, made):
    plan = made(cases.documents(spark)).select("doc_id")  # also where only few columns are asked for
    for df in (plan, made(cases.documents(spark))):
        assert df._jdf.queryExecution().executedPlan().toString().count("xxhash64") <= 1


def test_quality_lines(spark):
    good = " ".join(f"Word{i} follows word{i} here." for i in range(30))
    bad = "Home | About | News | Contact | More " * 12
    rows = [(1, good), (2, f"{good}\n{bad[:60]}"), (3, f"{good[:200]}\n{bad}\n{bad}x"), (4, f"{good}\nSKIP TO CONTENT NOW")]
    docs = cases.documents(spark, rows)
    kept = {r["doc_id"]: r["text"] for r in quality.clean(docs).collect()}
    assert kept == {1: good, 2: good, 4: good}
    assert quality.clean(docs).columns == docs.columns


def plain_base(text):
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(cases.UPPER))
    places = [(i, label) for p, label in licences.PHRASES.items() for n in [len(p.split())] for i in range(len(ws) - n + 1) if ws[i : i + n] == p.split()]
    return ws, sorted(places)


LICENSED = [
    (20, "Licensed under CC-BY 4.0, and again: licensed under cc by nc 4.0"),
    (21, "GENERAL PUBLIC LICENSE general public license all rights reserved ALL RIGHTS RESERVED"),
    (22, "We say: Permission is hereby freely granted, free of charge, to any person obtaining a copy of this software and associated documentation."),
    (23, "licensed under the license of cc and by rights all reserved"),
    (24, "cc byte accc by general publics license"),
]


def test_licences(spark):
    rows = [*cases.TEXTS, *LICENSED]
    got = licences.scan(cases.documents(spark, rows)).collect()
    plain = []
    for d, t in rows:
        ws, places = plain_base(t)
        plain.append((d, len(ws), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({x for _, x in places}))))
    assert sorted((tuple(r)[:6] for r in got), key=repr) == sorted(plain, key=repr)
    by = {r["doc_id"]: r for r in got}
    assert by[20]["labels"] == "cc-by,cc-by-nc" and by[22]["labels"] == "mit" and 0.6 <= by[22]["score"] < 1
    assert by[23]["labels"] == by[24]["labels"] == "" and by[23]["score"] == 0
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) for r in got)
    assert licences.scan(cases.empty(spark)).count() == 0


def test_templates_may_hold_quotes(spark):
    got = licences.template_grams(spark, [("o'label", "the author's own \\ work")]).collect()
    assert [(r["gram"], r["label"]) for r in got] == [("the author's own", "o'label"), ("author's own \\", "o'label"), ("own \\ work", "o'label")]


def test_spans(spark):
    notice = licences.TEMPLATES[3][1]
    broken = notice.replace(" source ", " source or other ").replace(" the following", " following")
    rows = [(1, f"a b c {notice} d {notice}"), (2, f"x {broken}"), (3, notice[:40])]
    measured = licences.measure(cases.documents(spark, rows))
    got = licences.spans(measured).join(measured.select("_row", "doc_id"), "_row").collect()
    size = len(notice.split())
    assert sorted((r["doc_id"], r["label"], r["first"], r["last"]) for r in got if r["doc_id"] == 1) == [(1, "bsd", 3, 2 + size), (1, "bsd", 4 + size, 3 + 2 * size)]
    assert [r["label"] for r in got if r["doc_id"] == 2] == ["bsd"] and not [r for r in got if r["doc_id"] == 3]


TURNS = [
    (1, True, 0, "user", "hi"), (1, True, 1, "assistant", "yes"), (1, True, 2, "assistant", "more"),
    (1, False, 0, "user", "hi"), (1, False, 1, "assistant", "no"),
    (2, True, 0, "user", "a"), (2, False, 0, "user", "a"),
    (3, True, 0, None, None), (3, True, None, "system", ""),
    (4, False, 0, "assistant", "x"),
    (5, True, 0, "user", "p"), (5, True, 1, "assistant", "q"), (5, False, 0, "user", "p"),
    (None, True, 0, "user", "lost"), (6, None, 0, "user", "lost"),
    (7, True, 0, "user", "d"), (7, True, 0, "user", "d"), (7, False, 0, "user", "d"),
]


def test_preferences(spark):
    turns = spark.createDataFrame([(*t, 1, "z") for t in TURNS], "pair_id long, chosen boolean, turn long, role string, text string, a long, _pair string")
    got = {r["pair_id"]: r for r in preferences.format_pairs(turns).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 7}
    one = got[1]
    assert (one["n_chosen"], one["n_rejected"], one["n_common"]) == (3, 2, 1)
    assert one["prompt"] == "<|user|>\nhi<|end|>\n"
    assert one["chosen_completion"] == "<|assistant|>\nyes<|end|>\n<|assistant|>\nmore<|end|>\n"
    learned = [one["chosen_completion"][s["start"] : s["end"]] for s in one["chosen_loss"]]
    assert learned == ["yes<|end|>\n", "more<|end|>\n"]
    assert [one["rejected_completion"][s["start"] : s["end"]] for s in one["rejected_loss"]] == ["no<|end|>\n"]
    assert got[2]["n_common"] == 1 and got[2]["chosen_completion"] == "" == got[2]["rejected_completion"]
    assert got[3]["rejected_completion"] is None and got[3]["chosen_completion"].startswith("<|system|>\n<|end|>")
    assert got[4]["chosen_completion"] is None and got[4]["prompt"] == ""
    assert got[5]["n_common"] == 1 and got[5]["rejected_completion"] == ""
    assert got[7]["n_chosen"] == 2 and got[7]["n_common"] == 1
    assert preferences.format_pairs(turns.limit(0)).count() == 0
    assert hashlib.sha256(b"").hexdigest()
