"""Predicates and filters over papers."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold, fold_terms, matches_terms
from ..schema import SCOPE


def categories_of(c: Column) -> Column:
    return F.filter(F.split(c, r"(?U)\s+"), lambda x: x != "")


def in_categories(wanted: Iterable[str], c: Column | None = None) -> Column:
    """Any of the document's categories is wanted; an exact match of whole names."""
    return F.arrays_overlap(categories_of(F.col("categories") if c is None else c), F.array(*map(F.lit, wanted)))


def in_scope(c: Column | None = None, scope: Iterable[str] = SCOPE) -> Column:
    return in_categories(scope, c)


def since(date: str, c: Column | None = None) -> Column:
    """A comparison of text, as dates are stored; null dates are out."""
    return (F.col("update_date") if c is None else c) >= F.lit(date)


def valid_date(text: str) -> str:
    """The date as it is stored, which 2024-1-5 is not; ValueError for what is no date."""
    return dt.datetime.strptime(text, "%Y-%m-%d").date().isoformat()


def known_categories(wanted: Iterable[str] | None, scope: Iterable[str] = SCOPE) -> list[str]:
    return [c for c in wanted or () if c in tuple(scope)]


def has_author(query: str) -> Column | None:
    """All terms of the query in the folded authors; None if it has no usable term."""
    terms = fold_terms(query)
    return matches_terms(F.col("authors_folded"), terms) if terms else None


def search_ready(papers: DataFrame) -> DataFrame:
    """papers with authors_folded, which belongs in a stored table: the UDF then runs once per document."""
    return papers if "authors_folded" in papers.columns else papers.withColumn("authors_folded", fold("authors"))


def narrow(papers: DataFrame, categories: Iterable[str] | None = None, since_date: str | None = None, author: str | None = None) -> DataFrame:
    """All given filters at once. The cheap ones come first, so folding sees what they left."""
    found = papers
    if categories := list(categories or ()):
        found = found.where(in_categories(categories))
    if since_date:
        found = found.where(since(since_date))
    if author and fold_terms(author):
        found = search_ready(found).where(has_author(author))
    return found


def embedded(papers: DataFrame) -> DataFrame:
    return papers.where(F.col("row").isNotNull())


def pending(papers: DataFrame) -> DataFrame:
    return papers.where(F.col("row").isNull())
