import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestar.functions import cite, text
from pyspark.sql import functions as F

FOLDS = [
    (r"Poincar\'e", "poincare"),
    (r"M\"obius", "mobius"),
    (r"{\O}re", "ore"),
    (r"Erd\H{o}s", "erdos"),
    (r"\L ojasiewicz", "lojasiewicz"),
    (r"Garc\'{\i}a", "garcia"),
    (r"\AA ngstr\"om", "angstrom"),
    (r"Noether (Universit\"at G\"ottingen)", "noether"),
    ("A (B (C) D) E", "a (b d) e"),
    ("Þór", "thor"),
    (r"Stra\ss e", "strasse"),
    (r"\v S", r"\v s"),
    ("", ""),
    (None, ""),
]


@pytest.mark.parametrize("raw, folded", FOLDS)
def test_fold(raw, folded):
    assert text.fold_text(raw) == folded


def test_fold_column_equals_scalar(spark):
    df = spark.createDataFrame([(a,) for a, _ in FOLDS], "t string")
    assert [r[0] for r in df.select(text.fold("t")).collect()] == [b for _, b in FOLDS]


@given(st.text(alphabet="abcXYZ éøŁß'", max_size=30))
@settings(max_examples=60, deadline=None)
def test_fold_is_idempotent(s):
    assert text.fold_text(text.fold_text(s)) == text.fold_text(s)


def test_latex_to_unicode(spark):
    cases = {r"Poincar\'e": "Poincaré", r"{\O}re": "Øre", r"\Omega": r"\Omega", r"\'{\i}": "í", r"\c{c}a": "ça", r"\o\ss": "øß", r"\O\ae": "Øæ", r"\l\aa{}x": "łåx", r"\oe\o\i": "œøı", r"\'\i\\j": "í\\ȷ", r"\"{o}\'e\H{u}": "öéű"}
    df = spark.createDataFrame([(a,) for a in cases], "t string")
    assert [r[0] for r in df.select(text.latex_to_unicode("t")).collect()] == list(cases.values())


def test_terms():
    assert text.fold_terms("Hardy, Littlewood") == ["hardy", "littlewood"]
    assert text.fold_terms(r"Hardy and Littlewood; P\'olya") == ["hardy", "littlewood", "polya"]
    assert text.fold_terms("Anderson") == ["anderson"]
    assert text.fold_terms(", ;") == [] == text.fold_terms(None)


def test_matches_terms(spark):
    df = spark.createDataFrame([("godfrey h. hardy",)], "a string")
    assert df.where(text.matches_terms(F.col("a"), ["godfrey", "hardy"])).count() == 1
    assert df.where(text.matches_terms(F.col("a"), [])).count() == 1


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"`{k}` string" for k in values))
    return row.select(column).first()[0]


def test_templates(spark):
    assert one(spark, text.document_text(F.col("a"), F.col("b")), a="A\n  b", b="  c  d") == "A b\n\nc d"
    assert one(spark, text.rerank_text(F.col("a"), F.col("b")), a="A\n  b", b="  c  d") == "A b. c d"
    assert one(spark, text.query_text(F.col("a")), a=" x ").endswith("\nQuery: x")


def test_display(spark):
    raw = r"\emph{On} {\it rings} \cite{x} A\&B --- c--d"
    assert one(spark, text.display_text(F.col("a")), a=raw) == "On rings A&B — c–d"
    assert one(spark, text.escape_html(F.col("a")), a='<a "&">') == "&lt;a &quot;&amp;&quot;&gt;"


@pytest.mark.parametrize("id_, year", [("math/0605123", 2006), ("0704.0002", 2007), ("2401.12345", 2024), ("alg-geom/9202001", 1992), ("9013.1", 1999), ("x", 1999)])
def test_year(spark, id_, year):
    assert one(spark, cite.id_year(F.col("a"), F.col("b")), a=id_, b="1999-01-01") == year
    if year == 1999:
        assert one(spark, cite.id_year(F.col("a")), a=id_) is None


@pytest.mark.parametrize(
    "raw, names",
    [("Emmy Noether and Bernhard Riemann", ["Emmy Noether", "Bernhard Riemann"]), ("Hardy, And John Littlewood", ["Hardy", "John Littlewood"]),
     ("Godfrey Hardy and and John Littlewood", ["Godfrey Hardy", "John Littlewood"]), ("and, &", []), (None, [])],
)
def test_authors(spark, raw, names):
    assert one(spark, cite.split_authors(F.col("a")), a=raw) == names


@pytest.mark.parametrize("raw, kept", [("a{b", "ab"), ("a}b{c}", "ab{c}"), ("}{", ""), ("{x}", "{x}"), ("{{a}", "{a}"), ("{a}}{", "{a}")])
def test_braces(raw, kept):
    assert cite.balanced(raw) == kept


@given(st.text(alphabet="{}a", max_size=12))
@settings(deadline=None)
def test_braces_balance(s):
    depth = 0
    for ch in cite.balanced(s):
        depth += (ch == "{") - (ch == "}")
        assert depth >= 0
    assert depth == 0


def test_biblatex(spark):
    row = {"id": "math/0605123", "title": "A {b\n c", "authors": "X Y and Z", "categories": "math.AG math.CO", "update_date": "2008-01-01", "doi": None, "journal_ref": "J. 1"}
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} string" for k in row))
    entry = df.select(cite.biblatex()).first()[0]
    assert entry.splitlines() == [
        "@online{arxiv:math_0605123,",
        "  title       = {A b c},",
        "  author      = {X Y and Z},",
        "  year        = {2006},",
        "  eprint      = {math/0605123},",
        "  eprinttype  = {arxiv},",
        "  eprintclass = {math.AG},",
        "  note        = {J. 1},",
        "  url         = {https://arxiv.org/abs/math/0605123},",
        "}",
    ]


def random_tex(n, seed=11):
    """Strings of TeX commands, accents, braces, blanks of all kinds, and letters of several scripts."""
    import random

    rng = random.Random(seed)
    bits = ["\\" + c for c in text.TEX_LETTERS] + ["\\" + m for m in text._SYMBOLS + text._NAMES] + list("{}{}() \t\n\\ab12_eiouAZxyqss")
    bits += ["é", "ø", "Ł", "ß", "Þ", "ﬁ", "Å", "é", "̣", "ı", "ȷ", "İ", "ς", "Σ", "가", "漢", "²", "Ⅳ", " ", " ", "\x1c", "\x85", "ि", "क", "ẞ", "ŉ", "😀", "{\\", "\\'", "\\\"{", "\\c{c}", "\\v s", "and ", ", "]
    return ["".join(rng.choices(bits, k=rng.randrange(14))) for _ in range(n)] + [None, "", "\\", "\\\\", "{", "(a(b)c)"]


def test_columns_equal_the_scalar_rules_on_random_tex(spark):
    import pandas as pd

    raw = random_tex(6000)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(raw)], "i int, t string").repartition(4)
    shown = df.select("i", text.display_accents("t").alias("a"), text.latex_to_unicode("t").alias("b"), text.fold("t").alias("c"))
    got = {r["i"]: tuple(r)[1:] for r in shown.collect()}
    series = pd.Series(raw, dtype=object)
    want = list(zip(text.tex_accents(series.fillna("")), text._unicode(series), text.fold_series(series)))
    assert [(raw[i], got[i], w) for i, w in enumerate(want) if got[i] != w] == []


def test_no_python_in_text_functions(spark):
    df = spark.createDataFrame([("a", "b", "c", "d", "e", "f", "g")], "id string, title string, authors string, categories string, update_date string, doi string, journal_ref string")
    shown = df.select(text.fold("authors"), text.latex_to_unicode("title"), text.display_accents("title"), cite.biblatex(), cite.balance_braces(F.col("title")))
    plan = shown._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_braces_on_the_jvm_equal_the_scan(spark):
    import random

    rng = random.Random(5)
    raw = ["".join(rng.choices("{}{}ab \\", k=rng.randrange(18))) for _ in range(4000)] + ["", "{" * 50 + "x" + "}" * 60, "}" * 30 + "{" * 30, None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(raw)], "i int, t string").repartition(4)
    got = {r["i"]: r["b"] for r in df.select("i", cite.balance_braces(F.col("t")).alias("b")).collect()}
    assert [(t, got[i]) for i, t in enumerate(raw) if got[i] != (t and cite.balanced(t))] == []


def test_marks_are_told_apart_for_all_characters(spark):
    import sys
    import unicodedata

    named = spark.range(sys.maxunicode + 1).where("id NOT BETWEEN 55296 AND 57343 AND id <> 65279")  # no surrogates, nor the mark that decode() takes off
    char = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
    gone = named.where(F.regexp_replace(char, text._combining(), "") == "")
    assert {r["id"] for r in gone.collect()} == {n for n in range(sys.maxunicode + 1) if unicodedata.combining(chr(n))}


def test_marks_cost_little_in_long_texts(spark):
    """Taking the marks off costs about what a class of one range does, not a search through all ranges a character."""
    import time

    long = spark.range(400).select(F.repeat(F.lit("Straße, où l'été "), 2000).alias("t")).localCheckpoint()

    def seconds(pattern):
        started = time.perf_counter()
        long.agg(F.sum(F.length(F.regexp_replace("t", pattern, "")))).collect()
        return time.perf_counter() - started

    seconds(r"[\x{300}-\x{36f}]")
    assert min(seconds(text._combining()) for _ in range(2)) < 3 * min(seconds(r"[\x{300}-\x{36f}]") for _ in range(3))
