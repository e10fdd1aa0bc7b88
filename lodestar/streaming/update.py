"""Incremental update: a cursor, a bounded re-read before it, and keyed merges that make replays harmless.

Files of records can also be followed as a stream; each micro-batch goes through the same merge.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.filters import in_scope
from ..operators.store import Store, change_status
from ..schema import CURSOR_KEY, FIRST_CURSOR, MAX_PAGES, OVERLAP_MINUTES, SCOPE, SNAPSHOT
from ..sources.feed import http_page, walk
from ..sources.snapshot import to_papers


def resolve_cursor(store: Store) -> dt.datetime:
    """The stored cursor, else midnight of the newest stored date, else the feed's beginning. What can't be read as a
    time counts as missing."""
    newest = store.status()["newest"]
    for found in (store.meta(CURSOR_KEY), newest and f"{newest}T00:00:00+00:00"):
        try:
            return dt.datetime.fromisoformat(found)
        except (TypeError, ValueError):
            continue
    return dt.datetime.fromisoformat(FIRST_CURSOR)


def in_window(stamp: Column, cursor: Column) -> Column:
    """Changed since the cursor less the overlap; what has no readable stamp is taken in."""
    return stamp.isNull() | (stamp >= cursor - F.make_interval(mins=F.lit(OVERLAP_MINUTES)))


def update(store: Store, embedder, fetch=http_page, max_pages: int = MAX_PAGES, sleep=None) -> dict:
    """One round: walk, merge, embed, and move the cursor only if the walk was complete. Returns the tallies."""
    store.check_model()
    window = walk(resolve_cursor(store), fetch, max_pages, **({"sleep": sleep} if sleep else {}))
    tally: dict = {"complete": window.complete, "records": len(window.records), "embedded": 0}
    if window.records:
        rows = [(i, *(r[c] for c in _FIELDS)) for i, r in enumerate(reversed(window.records))]  # oldest first
        batch = store.spark.createDataFrame(rows, "_order long, " + ", ".join(f"{c} string" for c in _FIELDS))
        tally |= {r["status"]: r["n"] for r in change_status(store.papers(), batch).collect()}
        store.upsert(batch)
    tally["embedded"] = store.embed_pending(embedder)
    if window.complete and window.newest:
        store.set_meta(CURSOR_KEY, window.newest.isoformat())
    return tally


_FIELDS = ("id", "version", "title", "abstract", "authors", "categories", "update_date", "doi", "journal_ref")


def follow(store: Store, path: str, checkpoint: str, embedder=None, scope=SCOPE) -> DataStreamWriter:
    """A stream over a folder of snapshot lines. A batch that is run again merges to the same state, so the sink needs no
    more than the stream's own checkpoint. Start it with .start() or a trigger of choice."""

    def merge_batch(batch: DataFrame, _: int) -> None:
        store.upsert(to_papers(batch))
        if embedder is not None:
            store.embed_pending(embedder)

    spark: SparkSession = store.spark
    lines = spark.readStream.schema(SNAPSHOT).option("mode", "FAILFAST").json(path)
    return lines.where(in_scope(F.col("categories"), scope)).writeStream.foreachBatch(merge_batch).option("checkpointLocation", checkpoint)
