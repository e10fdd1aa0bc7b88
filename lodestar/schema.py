"""Schemas, constants and error types of the document index."""

from __future__ import annotations

from pyspark.sql import types as T

# Scope, names, templates and limits that decide results.
SCOPE = ("math.AC", "math.AG", "math.CO")
MODEL = "qwen3-embedding:4b"
DIM = 2560
QUERY_INSTRUCTION = "Given a research question, retrieve relevant arXiv paper abstracts"
ABSTRACT_URL = "https://arxiv.org/abs/"
KEY_PREFIX = "arxiv:"
EPRINT_TYPE = "arxiv"
SHORTLIST = 50
RERANK_BATCH = 16
RERANK_MAX_TOKENS = 2048
EMBED_BATCH = 64
QUERY_CACHE = 512
PAGE_SIZE = 200
MAX_PAGES = 500
EMPTY_RETRIES = 3
REQUEST_DELAY = 3.0
OVERLAP_MINUTES = 15
CURSOR_KEY = "arxiv_cursor"
FIRST_CURSOR = "1991-01-01T00:00:00+00:00"
DEFAULT_K, SERVED_K, MOST_K = 10, 20, 500

_S = T.StringType()

PAPERS = T.StructType(
    [T.StructField("id", _S, False), T.StructField("row", T.LongType())]
    + [T.StructField(n, _S) for n in ("version", "title", "abstract", "authors", "categories", "update_date", "doi", "journal_ref", "embedded_at")]
)
#: papers as stored: the authors are folded once, when they come in.
STORED = T.StructType([*PAPERS.fields, T.StructField("authors_folded", _S)])
METADATA = tuple(f.name for f in PAPERS if f.name not in ("id", "row", "embedded_at"))
VECTORS = T.StructType([T.StructField("slot", T.LongType(), False), T.StructField("model", _S, False), T.StructField("embedding", T.ArrayType(T.FloatType(), False), False)])

#: One record of the snapshot.
SNAPSHOT = T.StructType(
    [T.StructField("id", _S), T.StructField("versions", T.ArrayType(T.StructType([T.StructField("version", _S)])))]
    + [T.StructField(n, _S) for n in ("title", "abstract", "authors", "categories", "update_date", "doi", "journal-ref")]
)

_TERM = T.StructType([T.StructField("_term", _S)])
#: One entry of the feed; `updated` stays text, as its first ten characters are the date.
FEED_ENTRY = T.StructType(
    [T.StructField(n, _S) for n in ("id", "updated", "title", "summary")]
    + [
        T.StructField("author", T.ArrayType(T.StructType([T.StructField("name", _S)]))),
        T.StructField("category", T.ArrayType(_TERM)),
        T.StructField("arxiv:primary_category", _TERM),
        T.StructField("arxiv:doi", _S),
        T.StructField("arxiv:journal_ref", _S),
    ]
)


class IndexError_(RuntimeError):
    """What makes the index unusable for an operation."""


class ModelMismatch(IndexError_):
    """Stored vectors come from another model than the one configured."""


class DanglingSlot(IndexError_):
    """A paper points to a vector that does not exist."""


class MissingField(ValueError):
    """A snapshot record lacks a required field."""
