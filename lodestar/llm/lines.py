"""Line deduplication by spread over distinct sites.

A HyperLogLog sketch of sites per line hash is merged by aggregation; lines whose estimate is near the threshold
get an exact distinct count; lines on enough sites are boilerplate and leave their documents.
Native: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NOT_BLANK, cut, let, table

MIN_SITES = 10
LOG_K = 11
#: Relative half-width of the band around the threshold that is counted exactly: about five standard errors of a
#: sketch of 2^11 registers, so that an estimate outside it settles the matter.
BAND = 0.12


def _key(line: Column) -> Column:
    return F.md5(line)


def spread_lines(docs: DataFrame, min_sites: int = MIN_SITES, site: str = "source", text: str = "text") -> DataFrame:
    """Hashes (line_key) of the lines found on at least min_sites distinct sites. Lines are split at \\n and compared
    as they stand; lines without a word are never counted. Null sites count for nothing."""
    line = F.explode(F.filter(F.split(F.col(text), "\n"), lambda x: x.rlike(NOT_BLANK))).alias("line")
    seen = docs.where(F.col(site).isNotNull()).select(F.col(site).cast("string").alias("site"), line)
    seen = seen.select(F.unhex(_key(F.col("line"))).alias("line_key"), "site")
    # a line on many sites has many rows: the count goes with the sketch, in one aggregation with map-side merging
    spread = seen.groupBy("line_key").agg(F.count("*").alias("n"), F.hll_sketch_agg("site", LOG_K).alias("sketch"))
    spread = cut(spread.where(F.col("n") >= min_sites).select("line_key", F.hll_sketch_estimate("sketch").alias("sites")))
    low, high = min_sites * (1 - BAND), min_sites * (1 + BAND) + 1
    near = spread.where((F.col("sites") >= low) & (F.col("sites") <= high)).select("line_key")
    exact = seen.join(near, "line_key", "left_semi").groupBy("line_key").agg(F.count_distinct("site").alias("sites"))
    sure = spread.where(F.col("sites") > high)
    return cut(sure.select("line_key").union(exact.where(F.col("sites") >= min_sites).select("line_key")))


def _found(docs: DataFrame, min_sites: int, id_col: str, site: str, text: str) -> DataFrame:
    """row (all columns of docs) and found: struct(n_lines, n_removed, clean_text)."""
    spread = spread_lines(docs, min_sites, site, text)
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))  # no column can clash with ours
    id_, body = F.col("row")[id_col], F.col("row")[text]
    lines = packed.select(id_.alias("id"), F.xxhash64(body).alias("text_hash"), F.posexplode(F.split(body, "\n")).alias("at", "line"))
    lines = lines.where(F.col("line").rlike(NOT_BLANK)).select("id", "text_hash", "at", F.unhex(_key(F.col("line"))).alias("line_key"))
    gone = lines.join(spread, "line_key", "left_semi").groupBy("id", "text_hash").agg(F.collect_set("at").alias("gone"))
    joined = packed.join(gone, id_.eqNullSafe(F.col("id")) & (F.xxhash64(body) == F.col("text_hash")), "left")
    parts = F.split(body, "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("gone"))  # by hash, so linear in the lines
    left = F.when(F.col("gone").isNull(), body).otherwise(let(parts, lambda ls: F.array_join(F.transform(stay, lambda i: F.get(ls, i)), "\n")))
    found = F.struct(
        F.coalesce(F.size(F.filter(parts, lambda x: x.rlike(NOT_BLANK))), F.lit(0)).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"),
        left.alias("clean_text"),
    )
    return joined.select("row", found.alias("found"))


def mark_lines(docs: DataFrame, min_sites: int = MIN_SITES, id_col: str = "doc_id", site: str = "source", text: str = "text") -> DataFrame:
    """docs with a column `line_dedup`: struct(n_lines, n_removed, clean_text).

    n_lines counts lines with a word; those on at least min_sites sites go, whatever the site of the document.
    clean_text is the rest, joined by \\n; a null text stays null, with no lines. Rows with equal id_col and
    equal text are cleaned alike; other columns pass through; one named `line_dedup` is replaced. An empty table stays
    empty."""
    found = _found(docs.drop("line_dedup"), min_sites, id_col, site, text)
    return found.select("row.*", F.col("found").alias("line_dedup"))


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """The documents without boilerplate lines; the columns of docs, whatever their names. Cases as in mark_lines."""
    found = _found(docs, min_sites, "doc_id", "source", "text")
    return found.select(*((F.col("found.clean_text") if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, lines removed and text left of every document; cases as in mark_lines."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mark_lines(docs).select("doc_id", "line_dedup.n_lines", "line_dedup.n_removed", F.sha2("line_dedup.clean_text", 256).alias("kept_sha256"))


def lines_sql(source: str, min_sites: int = MIN_SITES) -> str:
    """DuckDB SQL: the rows of mark_lines over the relation `source`, with clean_text."""
    return f"""
WITH l AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k
  FROM {source}),
f AS (SELECT * FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
s AS (SELECT line FROM f GROUP BY line HAVING count(DISTINCT source) >= {min_sites}),
g AS (
  SELECT doc_id, count(*) FILTER (line IN (FROM f SELECT line)) AS n_lines, count(*) FILTER (line IN (FROM s)) AS n_removed,
         string_agg(line, chr(10) ORDER BY k) FILTER (line NOT IN (FROM s)) AS kept
  FROM l GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
       CASE WHEN d.text IS NOT NULL THEN coalesce(kept, '') END AS clean_text
FROM {source} d LEFT JOIN g USING (doc_id)"""


OP6_SQL = f"SELECT doc_id, n_lines, n_removed, sha256(clean_text) AS kept_sha256 FROM ({lines_sql('documents')})"
