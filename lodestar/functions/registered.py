"""The engine's functions under names for spark.sql."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..schema import ABSTRACT_URL, EPRINT_TYPE, KEY_PREFIX
from .cite import _CLOSE, _OPEN
from .text import BATCHED

#: name, parameters, result and body of the functions that SQL can say itself; Catalyst inlines them.
SQL_FUNCTIONS = (
    ("dot", "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"),
    ("l2_norm", "v ARRAY<DOUBLE>", "DOUBLE", "sqrt(aggregate(v, 0D, (s, x) -> s + x * x))"),
    (
        "l2_normalise",
        "v ARRAY<DOUBLE>",
        "ARRAY<DOUBLE>",
        "transform(array(sqrt(aggregate(v, 0D, (s, x) -> s + x * x))), n -> transform(v, x -> x / if(n = 0, 1D, n)))[0]",
    ),
    ("cite_key", "id STRING", "STRING", f"concat('{KEY_PREFIX}', replace(coalesce(id, ''), '/', '_'))"),
    (
        "arxiv_year",
        "id STRING, fallback STRING",
        "INT",
        r"""transform(array(regexp_extract(substring_index(coalesce(id, ''), '/', -1), r'^([0-9]{2}(?:0[1-9]|1[0-2]))', 1)), yymm -> CASE
        WHEN yymm <> '' THEN int(left(yymm, 2)) + if(int(left(yymm, 2)) >= 91, 1900, 2000) ELSE try_cast(regexp_extract(fallback, r'^([0-9]{4})', 1) AS INT) END)[0]""",
    ),
    ("squash", "c STRING", "STRING", r"trim(regexp_replace(c, r'(?U)\s+', ' '))"),
    (
        "author_names",
        "raw STRING",
        "ARRAY<STRING>",
        r"""filter(transform(split(regexp_replace(squash(coalesce(raw, '')), r'(?i)\s+and\s+', ', '), ','), p -> trim(regexp_replace(trim(p), r'(?i)^(?:and\s+)+|(?:\s+and)+$', ''))),
        p -> lower(p) NOT IN ('', 'and', '&'))""",
    ),
    (
        "balance_braces",
        "c STRING",
        "STRING",
        rf"""if(rlike(c, '[{{}}]'), translate(translate(if(least(regexp_count(c, r'\{{'), regexp_count(c, r'\}}')) > 0, aggregate(sequence(1, least(regexp_count(c, r'\{{'), regexp_count(c, r'\}}'))), c,
        (t, i) -> regexp_replace(t, r'\{{([^{{}}]*)\}}', '{_OPEN}$1{_CLOSE}')), c), '{{}}', ''), '{_OPEN}{_CLOSE}', '{{}}'), c)""",
    ),
    (
        "biblatex",
        "id STRING, title STRING, authors STRING, categories STRING, update_date STRING, doi STRING, journal_ref STRING",
        "STRING",
        rf"""transform(array(filter(array(
          struct('title' AS n, squash(coalesce(title, '')) AS v, balance_braces(squash(coalesce(title, ''))) AS shown, true AS must),
          struct('author' AS n, array_join(author_names(authors), ' and ') AS v, balance_braces(array_join(author_names(authors), ' and ')) AS shown, false AS must),
          struct('year' AS n, string(arxiv_year(id, update_date)) AS v, string(arxiv_year(id, update_date)) AS shown, false AS must),
          struct('eprint' AS n, id AS v, id AS shown, true AS must),
          struct('eprinttype' AS n, '{EPRINT_TYPE}' AS v, '{EPRINT_TYPE}' AS shown, true AS must),
          struct('eprintclass' AS n, get(split(trim(coalesce(categories, '')), r'(?U)\s+'), 0) AS v, get(split(trim(coalesce(categories, '')), r'(?U)\s+'), 0) AS shown, false AS must),
          struct('doi' AS n, doi AS v, balance_braces(doi) AS shown, false AS must),
          struct('note' AS n, squash(journal_ref) AS v, balance_braces(squash(journal_ref)) AS shown, false AS must),
          struct('url' AS n, concat('{ABSTRACT_URL}', id) AS v, concat('{ABSTRACT_URL}', id) AS shown, true AS must)), f -> f.must OR coalesce(f.v, '') <> '')),
        fs -> concat('@online{{', cite_key(id), ',\n', array_join(transform(fs, f -> concat('  ', rpad(f.n, array_max(transform(fs, g -> length(g.n))), ' '), ' = {{', f.shown, '}}')), ',\n'), ',\n}}'))[0]""",
    ),
)
#: Functions that need Unicode tables; they run on whole Arrow batches.
BATCH_FUNCTIONS = BATCHED


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to the session; returns their names. A null array or id gives what the body says of
    null: no product, no norm, the bare prefix."""
    for name, takes, gives, body in SQL_FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({takes}) RETURNS {gives} RETURN {body}")
    for name, function in BATCH_FUNCTIONS.items():
        spark.udf.register(name, function)
    return [f[0] for f in SQL_FUNCTIONS] + list(BATCH_FUNCTIONS)
