"""The snapshot source: one JSON object per line."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.filters import in_scope
from ..schema import SCOPE, SNAPSHOT


def mentions(value: Column, scope: Iterable[str] = SCOPE) -> Column:
    """Whether the raw line holds a category's name anywhere; cheap, and never wrong in refusing."""
    return reduce(or_, (value.contains(c) for c in scope))


def to_papers(records: DataFrame) -> DataFrame:
    """Records of the snapshot as rows to merge, with any `_order`. The last version counts; a record without a required
    field fails."""

    def required(name: str) -> Column:
        return F.coalesce(F.col(name), F.raise_error(F.lit(f"a record lacks {name}")).cast("string")).alias(name)

    return records.select(
        *(c for c in records.columns if c == "_order"),
        required("id"),
        F.try_element_at("versions", F.lit(-1))["version"].alias("version"),
        required("title"),
        required("abstract"),
        "authors",
        required("categories"),
        "update_date",
        "doi",
        F.col("`journal-ref`").alias("journal_ref"),
    )


def scan_snapshot(spark: SparkSession, path: str, scope: Iterable[str] = SCOPE) -> DataFrame:
    """Papers in scope, in the lines' order as `_order`. Lines without a category's name are dropped before they are
    parsed; a line that passes and is no JSON object fails the scan."""
    lines = spark.read.text(path).where(mentions(F.col("value"), scope))
    parsed = lines.select(F.monotonically_increasing_id().alias("_order"), F.from_json("value", SNAPSHOT, {"mode": "FAILFAST"}).alias("r"))
    kept = parsed.where(F.col("r.categories").isNull() | in_scope(F.col("r.categories"), scope))
    return to_papers(kept.select("_order", "r.*"))
