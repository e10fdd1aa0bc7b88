"""The papers view over the test tables, once per dialect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Authors by doc_id modulo 8, categories by language.
AUTHORS = (
    r"Henri Poincar\'e",
    r"August M\"obius and Emmy Noether",
    r"{\O}ystein {\O}re, G. H. Hardy",
    r"P. Erd\H{o}s",
    r"Emmy Noether (Universit\"at G\"ottingen)",
    r"G. H. Hardy, J. E. Littlewood",
    r"\L ojasiewicz",
    r"Stra\ss er",
)
BY_LANGUAGE = {"en": "math.AG", "fr": "math.AC", "de": "math.CO", "es": "cs.CG"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("slot"), F.lit("test").alias("model"), "embedding", "label")


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    lead = F.coalesce(*(F.when(F.col("lang") == k, v) for k, v in BY_LANGUAGE.items()))
    padded = lambda x, n: F.lpad(x.cast("string"), n, "0")
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row"))
    return (
        table(spark, sf_dir, "documents")
        .join(rows, d == F.col("row"), "left")
        .select(
            F.concat(padded(d * 7 % 25, 2), padded(d % 12 + 1, 2), F.lit("."), padded(d, 5)).alias("id"),
            "row",
            F.concat(F.lit("v"), (d % 3 + 1).cast("string")).alias("version"),
            F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
            F.col("text").alias("abstract"),
            F.element_at(F.array(*map(F.lit, AUTHORS)), (d % 8 + 1).cast("int")).alias("authors"),
            F.concat(lead, F.when((d % 5 == 0) & (F.col("lang") != "de"), " math.CO").otherwise("")).alias("categories"),
            F.date_add(F.lit("1995-01-01").cast("date"), (d * 37 % 700).cast("int")).cast("string").alias("update_date"),
            F.when(d % 4 == 0, F.concat(F.lit("10.0000/"), d.cast("string"))).alias("doi"),
            F.when(d % 6 == 0, F.concat(F.lit("J. Test "), d.cast("string"))).alias("journal_ref"),
            F.lit(None).cast("string").alias("embedded_at"),
            "doc_id",
        )
    )


_NAMES = ", ".join("'" + a.replace("'", "''") + "'" for a in AUTHORS)
_LEADS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in BY_LANGUAGE.items())
PAPERS_SQL = f"""
papers AS (
  SELECT lpad(CAST(doc_id * 7 % 25 AS VARCHAR), 2, '0') || lpad(CAST(doc_id % 12 + 1 AS VARCHAR), 2, '0') || '.' || lpad(CAST(doc_id AS VARCHAR), 5, '0') AS id,
    vec_id AS "row", 'v' || CAST(doc_id % 3 + 1 AS VARCHAR) AS version, split_part(text, chr(10), 1) AS title, text AS abstract,
    ([{_NAMES}])[doc_id % 8 + 1] AS authors,
    CASE lang {_LEADS} END || CASE WHEN doc_id % 5 = 0 AND lang <> 'de' THEN ' math.CO' ELSE '' END AS categories,
    CAST(CAST(DATE '1995-01-01' + CAST(doc_id * 37 % 700 AS INTEGER) AS DATE) AS VARCHAR) AS update_date,
    CASE WHEN doc_id % 4 = 0 THEN '10.0000/' || CAST(doc_id AS VARCHAR) END AS doi,
    CASE WHEN doc_id % 6 = 0 THEN 'J. Test ' || CAST(doc_id AS VARCHAR) END AS journal_ref, doc_id
  FROM documents LEFT JOIN embeddings ON vec_id = doc_id)"""
