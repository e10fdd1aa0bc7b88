"""The feed as a stateful stream: per id the newest record is remembered, and only what is newer passes on.

Records may come late, twice, or in any order: what the index holds in the end is what one batch of them all would give.
There is no watermark, so nothing is ever too late, and the state holds one small row per id. It lives with the stream's
checkpoint and survives a restart.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from ..operators.filters import in_scope
from ..operators.store import Store
from ..schema import METADATA, SCOPE, SNAPSHOT
from ..sources.snapshot import to_papers

#: What the state needs, which stream readers hold in memory-mapped files and not in the heap.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_RANK = T.StructType([T.StructField("number", T.LongType()), T.StructField("date", T.StringType()), T.StructField("digest", T.StringType())])
_RECORD = T.StructType([T.StructField(c, T.StringType()) for c in ("id", *METADATA)])


def rank() -> Column:
    """What orders the records of an id: the number of the version, then the date, then a hash of all that it says, so two
    different records never tie. What is absent comes first."""
    number = F.coalesce(F.regexp_extract("version", r"(\d{1,18})$", 1).try_cast("long"), F.lit(0))
    digest = F.sha2(F.to_json(F.struct(*METADATA)).cast("binary"), 256)
    return F.struct(number.alias("number"), F.coalesce("update_date", F.lit("")).alias("date"), digest.alias("digest"))


def newest_records(records: DataFrame) -> DataFrame:
    """The newest record of each id, by rank: what a stream of the records ends with."""
    best = records.groupBy("id").agg(F.max_by(F.struct(*METADATA), rank()).alias("m"))
    return best.select("id", "m.*")


class NewestRecord(StatefulProcessor):
    """Passes an id's record on if it is newer than all that came before, and remembers its rank."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._newest = handle.getValueState("newest", _RANK)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        best = max(rows, key=_order)  # one at a time: a group is never held
        if not self._newest.exists() or _order(best) > tuple(self._newest.get()):
            self._newest.update(_order(best))
            yield Row(**{c: best[c] for c in _RECORD.fieldNames()})

    def close(self) -> None:
        pass


def _order(row: Row) -> tuple:
    return row["number"], row["date"], row["digest"]


def changes(records: DataFrame) -> DataFrame:
    """The records(id, metadata) of a stream that are newer than what their id had. Needs STATE_STORE in the session."""
    ranked = records.select(*_RECORD.fieldNames(), rank().alias("r")).select(*_RECORD.fieldNames(), "r.*")
    return ranked.groupBy("id").transformWithState(statefulProcessor=NewestRecord(), outputStructType=_RECORD, outputMode="Update", timeMode="None")


def follow_changes(store: Store, path: str, checkpoint: str, embedder=None, scope=SCOPE, files_at_once: int = 1_000) -> DataStreamWriter:
    """follow() with a memory: a stream over a folder of snapshot lines, of which only news reach the index. A batch that
    is run again has the same news, and merges to the same state. Sets STATE_STORE."""

    def merge_batch(batch: DataFrame, _: int) -> None:
        store.upsert(batch)
        if embedder is not None:
            store.embed_pending(embedder)

    store.spark.conf.set(*STATE_STORE)
    lines = store.spark.readStream.schema(SNAPSHOT).option("mode", "FAILFAST").option("maxFilesPerTrigger", files_at_once).json(path)
    news = changes(to_papers(lines.where(in_scope(F.col("categories"), scope))))
    return news.writeStream.outputMode("update").foreachBatch(merge_batch).option("checkpointLocation", checkpoint)
