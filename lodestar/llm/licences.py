"""License scans by diagonal voting.

All rolling word 3-grams of a text meet the 3-grams of notice templates by hash; a hit at word i of the text and
word p of a template votes for diagonal i - p. Neighbouring diagonals are merged, as a word put in or left out
shifts the rest by one, and a span counts when its verified grams cover enough of the template.
Native: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, cut, let, table

GRAM = 3
MIN_COVERAGE = 0.6
MAX_SHIFT = 2
_SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Base phrases and their labels (fixed values).
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

#: Notices that the method looks for, in words, with their labels (fixed values: well-known public texts).
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "released under the mit license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("public-domain", "this work has been released into the public domain"),
    ("reserved", "all rights reserved no part of this publication may be reproduced distributed or transmitted in any form or by any means"),
)


def license_words(text: Column) -> Column:
    """Runs of digits, ASCII letters in lower case and characters beyond ASCII; none for a null text."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _SEPARATOR), "")


def template_grams(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """gram, h, template (number), label, p (its word), size (words of the template): a fixed, small table."""
    rows = []
    for number, (label, text) in enumerate(templates):
        ws = text.split()
        rows += [(" ".join(ws[p : p + GRAM]), number, label, p, len(ws)) for p in range(len(ws) - GRAM + 1)]
    quoted = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    values = ", ".join(f"({quoted(g)}, {n}, {quoted(lb)}, {p}, {s})" for g, n, lb, p, s in rows)
    return spark.sql(f"SELECT gram, xxhash64(gram) AS h, template, label, p, size FROM VALUES {values} AS t(gram, template, label, p, size)")


def _grams(ws: Column) -> Column:
    """All rolling grams; the last two are shorter and equal none of a template."""
    return F.transform(ws, lambda w, i: F.concat_ws(" ", w, F.get(ws, i + 1), F.get(ws, i + 2)))


def _places(text: Column, ws: Column) -> Column:
    """Base places as struct(label, i), in no order."""
    named = F.when(F.lit(False), F.lit(""))

    def at(w: Column, i: Column) -> Column:
        found = named
        for phrase, label in PHRASES.items():
            first, *rest = phrase.split()
            test = w == first
            for k, x in enumerate(rest, 1):
                test = test & (F.get(ws, i + k) == x)
            found = found.when(test, F.lit(label))
        return F.struct(found.alias("label"), i.alias("i"))

    may = ascii_lower(F.coalesce(text, F.lit(""))).rlike("|".join(p.replace(" ", _SEPARATOR) for p in PHRASES))
    none = F.lit([]).cast("array<struct<label:string,i:int>>")
    return F.when(may, F.filter(F.transform(ws, at), lambda x: x["label"].isNotNull())).otherwise(none)


def measure(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """A written table: _row (unique), id_col, n_words, places, words. One pass over the texts."""
    row = let(license_words(F.col(text)), lambda ws: F.struct(F.size(ws).cast("long").alias("n_words"), _places(F.col(text), ws).alias("places"), ws.alias("words")))
    measured = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col), row.alias("_m"))
    return cut(measured.select("_row", id_col, "_m.*"))


def spans(measured: DataFrame, templates=TEMPLATES, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """Verified notices: _row, label, first (word), last (word), coverage (share of the template's words).

    Every gram of every text meets the templates in a broadcast join, in the stage that makes it; hits alone are
    shuffled."""
    rolling = measured.select("_row", F.posexplode(_grams(F.col("words"))).alias("i", "gram"))
    hits = rolling.select("_row", "i", "gram", F.xxhash64("gram").alias("h"))
    known = F.broadcast(template_grams(measured.sparkSession, templates))  # a few hundred rows, fixed
    votes = hits.join(known, ["h", "gram"]).select("_row", "label", "template", "size", "p", "i", (F.col("i") - F.col("p")).alias("diagonal"))
    diagonals = votes.groupBy("_row", "template", "label", "size", "diagonal").agg(F.collect_set("p").alias("ps"), F.min("i").alias("first"), F.max("i").alias("last"))
    ordered = Window.partitionBy("_row", "template").orderBy("diagonal")  # the diagonals of one text
    apart = (F.col("diagonal") - F.lag("diagonal").over(ordered)) > MAX_SHIFT
    merged = diagonals.withColumn("_new", F.coalesce(apart, F.lit(False)).cast("int")).withColumn("cluster", F.sum("_new").over(ordered))
    found = merged.groupBy("_row", "template", "label", "size", "cluster").agg(F.flatten(F.collect_list("ps")).alias("ps"), F.min("first").alias("first"), (F.max("last") + GRAM - 1).alias("last"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("ps", lambda p: F.array(*(p + k for k in range(GRAM)))))))
    return found.withColumn("coverage", covered / F.col("size")).where(F.col("coverage") >= min_coverage).select("_row", "label", "first", "last", "coverage")


def scan(docs: DataFrame, templates=TEMPLATES, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: id_col, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Base labels come from phrases, further ones from spans(). score is 1 where a base phrase stands, else the best
    coverage among the spans, else 0. A null or empty text has no words, empty labels and score 0; repeated rows
    give repeated results; other columns are ignored."""
    measured = measure(docs, id_col, text)
    found = spans(measured, templates).groupBy("_row").agg(F.collect_set("label").alias("more"), F.max("coverage").alias("best"))
    base = F.transform("places", lambda x: x["label"])
    starts = F.transform("places", lambda x: x["i"].cast("long"))
    none = F.lit([]).cast("array<string>")
    return measured.join(found, "_row", "left").select(
        id_col,
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.coalesce("more", none))), ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, base places and labels of every document; cases as in scan."""
    return scan(table(spark, sf_dir, "documents"))
