"""Quality rules, line first: judge each line, drop the failures, then judge what a document lost.

Native: DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANK, NOT_BLANK, let, table, words

#: Characters that count as symbols (fixed values).
SYMBOLS = "#*$%&|<>"
#: Phrases that mark a boilerplate line in English, French, German and Spanish (fixed values, lower case).
BOILERPLATE = (
    "accept all cookies",
    "click here to",
    "enable javascript",
    "privacy policy",
    "sign in to",
    "skip to content",
    "subscribe to our newsletter",
    "terms of service",
    "accepter tous les cookies",
    "cliquez ici",
    "politique de confidentialité",
    "abonnez-vous à notre newsletter",
    "alle cookies akzeptieren",
    "hier klicken",
    "datenschutzerklärung",
    "zum inhalt springen",
    "aceptar todas las cookies",
    "haga clic aquí",
    "política de privacidad",
    "suscríbete a nuestro boletín",
)


MEASURES = "n_words word_chars n_symbols n_dup_lines n_repeat_words n_lines n_bad_lines lost_chars clean_text".split()


@dataclass(frozen=True)
class Rules:
    """min_words, max_repeat_percent: base rules. The others belong to the lines: a line with at least
    nav_bars separators, more than symbol_percent symbols, or shouted throughout fails; so does one of at
    least punctuated_words words in which no sentence ends. A document is rejected when its failing
    lines hold more than max_lost_percent of its word characters."""

    min_words: int = 50
    max_repeat_percent: int = 50
    nav_bars: int = 3
    symbol_percent: int = 10
    shout_letters: int = 12
    punctuated_words: int = 12
    max_lost_percent: int = 50


def line_fails(line: Column, r: Rules = Rules()) -> Column:
    """True for a line that a rule rejects. Blank lines pass. Rules, in order: navigation bars, symbol
    share, shouting (many letters, none in lower case), no sentence end anywhere in a
    long line, boilerplate phrases."""
    letters = F.regexp_replace(line, f"{BLANK}+", "")
    n_symbols = F.length(line) - F.length(F.translate(line, SYMBOLS, ""))
    bars = F.length(line) - F.length(F.translate(line, "|»", ""))
    shouted = (line == F.upper(line)) & (F.length(F.regexp_replace(line, r"[^A-Z]+", "")) >= r.shout_letters)
    long = F.length(line) - F.length(F.translate(line, " ", "")) >= r.punctuated_words - 1
    ends = line.rlike(r"[.!?…][\"'”’»)\]]*([\x20\x09-\x0D]|$)")
    boiler = F.lower(line).rlike("|".join(BOILERPLATE))
    return (
        (bars >= r.nav_bars)
        | (n_symbols * 100 > F.length(letters) * r.symbol_percent)
        | shouted
        | (long & ~ends)
        | boiler
    )


def _repeat_words(ws: Column) -> Column:
    """Words that stand in a 3-word window found twice or more. Windows are sorted by hash inside the row, so
    equal ones are neighbours; no group leaves its document."""
    grams = F.transform(
        F.sequence(F.lit(0), F.size(ws) - 3),
        lambda i: F.struct(F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)).alias("h"), i.alias("i")),
    )

    def repeated(s: Column) -> Column:
        twice = F.filter(s, lambda x, i: (x["h"] == F.get(s, i + 1)["h"]) | (x["h"] == F.get(s, i - 1)["h"]))
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    def if_any(g: Column) -> Column:
        distinct = F.size(F.array_distinct(F.transform(g, lambda x: x["h"])))
        return F.when(distinct == F.size(g), F.lit(0)).otherwise(let(F.sort_array(g), repeated))

    return F.when(F.size(ws) < 4, F.lit(0)).otherwise(let(grams, if_any))


def _verdicts(text: Column, r: Rules) -> Column:
    """An array of one struct: what the rules find in a text. Each step is bound once and read by the next."""
    t = F.coalesce(text, F.lit(""))
    ls = F.split(t, "\n")
    parts = F.struct(
        words(t).alias("ws"),
        ls.alias("ls"),
        F.filter(ls, lambda x: x.rlike(NOT_BLANK)).alias("filled"),
        F.transform(ls, lambda x: x.rlike(NOT_BLANK) & line_fails(x, r)).alias("bad"),
    )
    chars = lambda x: F.length(F.regexp_replace(x, f"{BLANK}+", ""))

    def measured(v: Column) -> Column:
        lost = F.zip_with(v["ls"], v["bad"], lambda x, b: F.when(b, chars(x)).otherwise(0))
        left = F.filter(v["ls"], lambda _, i: ~F.get(v["bad"], i))
        return F.struct(
            F.size(v["ws"]).cast("long").alias("n_words"),
            F.aggregate(v["ws"], F.lit(0).cast("long"), lambda n, w: n + F.length(w)).alias("word_chars"),
            (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            (F.size(v["filled"]) - F.size(F.array_distinct(v["filled"]))).cast("long").alias("n_dup_lines"),
            _repeat_words(v["ws"]).cast("long").alias("n_repeat_words"),
            F.size(v["filled"]).cast("long").alias("n_lines"),
            F.size(F.filter(v["bad"], lambda x: x)).cast("long").alias("n_bad_lines"),
            F.aggregate(lost, F.lit(0).cast("long"), lambda n, x: n + x).alias("lost_chars"),
            F.when(~F.exists(v["bad"], lambda x: x), text).otherwise(F.array_join(left, "\n")).alias("clean_text"),
        )

    def judged(q: Column) -> Column:
        failed = (q["n_words"] < r.min_words) | (100 * q["n_repeat_words"] > r.max_repeat_percent * q["n_words"])
        kept = ~failed & (100 * q["lost_chars"] <= r.max_lost_percent * q["word_chars"])
        *counts, last = (q[n].alias(n) for n in MEASURES)
        return F.struct(*counts, last, failed.alias("base_failed"), kept.alias("kept"))

    return F.transform(F.transform(F.array(parts), measured), judged)


def score(docs: DataFrame, r: Rules = Rules(), text: str = "text") -> DataFrame:
    """docs with a struct column `quality`: MEASURES (n_lines counts lines with a word), base_failed and kept.

    A null or empty text has no words and fails the base rules; clean_text is then null or empty. Repeated
    rows are judged alike; an empty table stays empty. Any other column passes through; one named `quality` is
    replaced."""
    return docs.withColumn("quality", _verdicts(F.col(text), r)[0])


def clean(docs: DataFrame, r: Rules = Rules(), text: str = "text") -> DataFrame:
    """The documents kept, with failing lines gone; the columns of docs, whatever their names.

    Null, empty and rejected texts go; of repeated rows all stay or none. The rows that go are those whose array of
    verdicts is empty, so no filter can be pushed below the rules and make them run again."""
    found = F.filter(_verdicts(F.col(text), r), lambda q: q["kept"])
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.explode(found).alias("found"))
    return rows.select(*((F.col("found.clean_text") if c == text else F.col("row")[c]).alias(c) for c in docs.columns))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base counts and the verdict of every document; cases as in score."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    names = "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept n_lines n_bad_lines lost_chars"
    return score(docs).select("doc_id", *(f"quality.{n}" for n in names.split()))


#: DuckDB SQL for op10_quality_rules, with the default Rules.
OP10_SQL = rf"""
WITH split AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{NOT_BLANK}+') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{NOT_BLANK}')) AS filled FROM documents
), judged AS (
  SELECT *, list_filter(filled, lambda x: length(x) - length(translate(x, '|»', '')) >= 3
    OR 100 * (length(x) - length(translate(x, '{SYMBOLS}', ''))) > 10 * length(regexp_replace(x, '{BLANK}+', '', 'g'))
    OR (x = upper(x) AND length(regexp_replace(x, '[^A-Z]+', '', 'g')) >= 12)
    OR (length(x) - length(translate(x, ' ', '')) >= 11 AND NOT regexp_matches(x, '[.!?…]["''”’»)\]]*({BLANK}|$)'))
    OR regexp_matches(lower(x), '{"|".join(BOILERPLATE)}')) AS bad FROM split
), places AS (SELECT rid, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM split),
grams AS (SELECT rid, i, word || ' ' || lead(word) OVER t || ' ' || lead(word, 2) OVER t AS gram FROM places WINDOW t AS (PARTITION BY rid ORDER BY i)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM grams WHERE gram IS NOT NULL) WHERE n > 1),
again AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY 1),
counted AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(translate(t, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols, CAST(len(filled) - len(list_distinct(filled)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, CAST(len(filled) AS BIGINT) AS n_lines, CAST(len(bad) AS BIGINT) AS n_bad_lines,
    CAST(length(regexp_replace(array_to_string(bad, ''), '{BLANK}+', '', 'g')) AS BIGINT) AS lost_chars
  FROM judged LEFT JOIN again USING (rid)
), failed AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted)
SELECT *, NOT base_failed AND 100 * lost_chars <= 50 * word_chars AS kept FROM failed
"""
