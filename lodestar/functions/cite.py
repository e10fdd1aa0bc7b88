"""Citations: year, names, keys and entries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import ABSTRACT_URL, EPRINT_TYPE, KEY_PREFIX
from .text import squash


def abs_url(id_: Column) -> Column:
    return F.concat(F.lit(ABSTRACT_URL), id_)


def cite_key(id_: Column) -> Column:
    return F.concat(F.lit(KEY_PREFIX), F.replace(F.coalesce(id_, F.lit("")), F.lit("/"), F.lit("_")))


def id_year(id_: Column, fallback: Column | None = None) -> Column:
    """Year in an identifier's leading YYMM (91 and later: last century), else the fallback's first four digits."""
    tail = F.substring_index(F.coalesce(id_, F.lit("")), "/", -1)
    yymm = F.regexp_extract(tail, r"^([0-9]{2}(?:0[1-9]|1[0-2]))", 1)
    yy = F.substring(yymm, 1, 2).try_cast("int")
    given = F.lit(None).cast("string") if fallback is None else fallback
    other = F.regexp_extract(given, r"^([0-9]{4})", 1).try_cast("int")
    return F.when(yymm != "", yy + F.when(yy >= 91, 1900).otherwise(2000)).otherwise(other)


def split_authors(raw: Column) -> Column:
    """Array of names. `and` separates like a comma; one left over at a name's end, or alone, goes."""
    text = F.regexp_replace(squash(F.coalesce(raw, F.lit(""))), r"(?i)\s+and\s+", ", ")
    names = F.transform(F.split(text, ","), lambda p: F.trim(F.regexp_replace(F.trim(p), r"(?i)^(?:and\s+)+|(?:\s+and)+$", "")))
    return F.filter(names, lambda p: ~F.lower(p).isin("", "and", "&"))


def balanced(text: str) -> str:
    """text without braces that have no partner: depth from the left tells stray closing ones, from the right opening."""
    out, depth = [], 0
    for ch in text:
        depth += (ch == "{") - (ch == "}")
        if depth < 0:
            depth = 0
        else:
            out.append(ch)
    left, depth = [], 0
    for ch in reversed(out):
        depth += (ch == "}") - (ch == "{")
        if depth < 0:
            depth = 0
        else:
            left.append(ch)
    return "".join(reversed(left))


#: Characters that no text may hold stand for matched braces meanwhile.
_OPEN, _CLOSE = "\ufdd0", "\ufdd1"


def balance_braces(c: Column) -> Column:
    """balanced on the JVM. Pairs with no brace between them are marked, again and again from the inside outwards, which
    takes as many rounds as braces are nested; what is left has no partner."""
    deepest = F.least(F.regexp_count(c, F.lit(r"\{")), F.regexp_count(c, F.lit(r"\}")))
    rounds = F.sequence(F.lit(1), deepest)
    marked = F.aggregate(rounds, c, lambda t, _: F.regexp_replace(t, r"\{([^{}]*)\}", f"{_OPEN}$1{_CLOSE}"))
    paired = F.when(deepest > 0, marked).otherwise(c)
    return F.when(c.rlike("[{}]"), F.translate(F.translate(paired, "{}", ""), _OPEN + _CLOSE, "{}")).otherwise(c)


def citation_fields() -> list[tuple[str, Column]]:
    """Names and values of an entry's fields in order; absent ones are null or empty."""
    categories = F.split(F.trim(F.coalesce("categories", F.lit(""))), r"(?U)\s+")
    return [
        ("title", squash(F.coalesce("title", F.lit("")))),
        ("author", F.array_join(split_authors(F.col("authors")), " and ")),
        ("year", id_year(F.col("id"), F.col("update_date")).cast("string")),
        ("eprint", F.col("id")),
        ("eprinttype", F.lit(EPRINT_TYPE)),
        ("eprintclass", F.get(categories, F.lit(0))),
        ("doi", F.col("doi")),
        ("note", squash(F.col("journal_ref"))),
        ("url", abs_url(F.col("id"))),
    ]


_ALWAYS = ("title", "eprint", "eprinttype", "url")


def biblatex(balance: bool = True) -> Column:
    """An @online entry from the columns of papers. balance: braces without a partner go."""
    lines, widths = [], []
    for name, value in citation_fields():
        present = (F.coalesce(value, F.lit("")) != "") | F.lit(name in _ALWAYS)
        own = balance_braces(value) if balance and name in ("title", "author", "doi", "note") else value
        widths.append(F.when(present, len(name)))
        lines.append((name, present, own))
    width = F.greatest(*widths)
    shown = [F.when(present, F.concat(F.lit("  "), F.rpad(F.lit(name), width, F.lit(" ")), F.lit(" = {"), own, F.lit("}"))) for name, present, own in lines]
    return F.concat(F.lit("@online{"), cite_key(F.col("id")), F.lit(",\n"), F.array_join(F.array(*shown), ",\n"), F.lit(",\n}"))
