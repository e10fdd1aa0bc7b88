"""Tables derived from the papers, part by part, and kept beside them.

A derived table remembers of which papers' files each of its parts was made. A commit that rewrites a part of the papers
leaves the derived part stale; refresh() makes the stale ones anew, and no other. A reader needs no refresh to be right:
what is stale is derived from the papers of now while it reads.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import fold_terms
from ..functions.vectors import pack, rows_of
from ..schema import MOST_K
from .filters import embedded, narrow
from .layout import part_of, read_parts, write_parts
from .search import browse, check_k
from .store import Store

_S = T.StringType()
#: What a search filters and scores: one row per paper with a vector, which is packed in half precision.
VIEW = T.StructType(
    [T.StructField("id", _S), T.StructField("row", T.LongType())]
    + [T.StructField(n, _S) for n in ("categories", "update_date", "authors_folded")]
    + [T.StructField("packed", T.BinaryType())]
)


@dataclass(frozen=True)
class Derivation:
    """make(store, state, parts): the rows for some parts of that state's papers, with a column id. sort: the order inside
    files, by which a reader's filter skips row groups."""

    name: str
    schema: T.StructType
    make: Callable[[Store, dict, list[int]], DataFrame]
    sort: str | None = None

    def stale(self, state: dict) -> list[int]:
        """The parts of the papers whose derived part is missing or of other files."""
        own = state["derived"].get(self.name, {})
        return sorted(int(p) for p, path in state["papers"].items() if own.get(p, {}).get("of") != path)

    def kept(self, state: dict, parts: Iterable[int] | None = None) -> dict[str, str]:
        """The files of the derived parts, fresh or not."""
        wanted = None if parts is None else {str(p) for p in parts}
        own = state["derived"].get(self.name, {})
        return {p: x["path"] for p, x in own.items() if x["path"] and (wanted is None or p in wanted)}

    def read(self, store: Store, state: dict | None = None) -> DataFrame:
        """The whole table as of the state (the newest if None): fresh parts from their files, stale ones made now."""
        state = state or store.state()
        stale = self.stale(state)
        fresh = [int(p) for p in state["papers"] if int(p) not in set(stale)]
        found = read_parts(store.spark, self.kept(state, fresh), self.schema)
        return found.unionByName(self.make(store, state, stale).select(*self.schema.fieldNames())) if stale else found

    def refresh(self, store: Store) -> list[int]:
        """Writes the stale parts anew, in one commit; returns them."""
        before = store.state()
        stale = self.stale(before)
        if stale:
            made = self.make(store, before, stale).select(*self.schema.fieldNames())
            fresh = write_parts(made, f"{store.path}/{self.name}", before["parts"], stale, self.sort)
            own = {p: x for p, x in before["derived"].get(self.name, {}).items() if p in before["papers"]}
            own |= {str(p): {"path": fresh.get(str(p)), "of": before["papers"][str(p)]} for p in stale}
            store.commit(before, derived=before["derived"] | {self.name: own})
        return stale


def _make_view(store: Store, state: dict, parts: list[int]) -> DataFrame:
    """Papers with a vector, and the vector. What a stale part already holds under the same slot is carried over; for the
    rest only tables of vectors that reach so far are read."""
    own = embedded(store.papers(parts, state)).select(*VIEW.fieldNames()[:-1])
    held = read_parts(store.spark, SEARCH_VIEW.kept(state, parts), VIEW).select("id", "row", "packed")
    carried = own.join(held, ["id", "row"])
    missing = own.join(held, ["id", "row"], "left_anti")
    first = missing.agg(F.min("row")).first()[0]
    if first is None:
        return carried
    vectors = store.vectors(first, state).select(F.col("slot").alias("row"), "embedding")
    found = missing.join(vectors, "row").select(*VIEW.fieldNames()[:-1], "embedding")
    return carried.unionByName(found.mapInArrow(_pack, VIEW))


def _pack(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        *others, column = batch.columns
        yield pa.RecordBatch.from_arrays([*others, pa.array(pack(rows_of(column)), pa.binary())], names=VIEW.fieldNames())


SEARCH_VIEW = Derivation("view", VIEW, _make_view, sort="update_date")


#: Letters of a gram of the author index.
GRAM = 3
GRAMS = T.StructType([T.StructField("gram", _S), T.StructField("id", _S)])


def grams_of(papers: DataFrame) -> DataFrame:
    """gram, id for each distinct run of GRAM letters in a paper's folded authors; shorter and null ones have none."""
    text = F.col("authors_folded")
    starts = F.sequence(F.lit(1), F.length(text) - (GRAM - 1))
    runs = F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(GRAM))))
    return papers.where(F.length(text) >= GRAM).select(F.explode(runs).alias("gram"), "id")


AUTHOR_GRAMS = Derivation("grams", GRAMS, lambda store, state, parts: grams_of(store.papers(parts, state)), sort="gram")


def query_grams(author: str) -> list[str]:
    """The grams that the authors must have for every term of the query to stand in them; none if all terms are shorter."""
    return sorted({t[i : i + GRAM] for t in fold_terms(author) for i in range(len(t) - GRAM + 1)})


def with_author(papers: DataFrame, grams: DataFrame, author: str) -> DataFrame:
    """narrow(papers, author=author) by the index: the postings of the query's grams alone are read and intersected, and
    what is left is verified letter by letter. A query of short terms only has no grams, and all papers are looked at."""
    wanted = query_grams(author)
    if wanted:
        held = grams.where(F.col("gram").isin(wanted)).groupBy("id").agg(F.count("*").alias("n"))
        papers = papers.join(held.where(F.col("n") == len(wanted)), "id", "left_semi")
    return narrow(papers, author=author)


#: Rows of a file of the listing, about.
LISTING_ROWS = 100_000
_LISTED = T.StructType([T.StructField(n, _S) for n in ("id", "update_date", "categories", "authors_folded")])


def _newest_first() -> list:
    return [F.desc_nulls_last("update_date"), F.asc("id")]


def refresh_listing(store: Store, rows: int = LISTING_ROWS) -> bool:
    """Writes the listing anew unless it is of the papers of now: all papers by date, newest first and none last, ties by
    id, in files that follow each other in that order; their bounds are kept with the commit. Whether it did."""
    before = store.state()
    if not before["papers"] or before.get("listing", {}).get("of") == before["papers"]:
        return False
    folder = f"{store.path}/listing/v={uuid.uuid4().hex}"
    files = -(-store.status(before)["papers"] // rows)
    slim = store.papers(state=before).select(*_LISTED.fieldNames())
    slim.repartitionByRange(files, *_newest_first()).sortWithinPartitions(*_newest_first()).write.parquet(folder)
    written = store.spark.read.schema(_LISTED).parquet(folder).select(F.col("_metadata.file_name").alias("file"), "update_date")
    bounds = written.groupBy("file").agg(F.max("update_date").alias("newest")).orderBy("file").collect()  # a row a file, whose name has its number
    files = [{"path": f"{folder}/{r['file']}", "newest": r["newest"]} for r in bounds]
    store.commit(before, listing={"folder": folder, "of": before["papers"], "parts": before["parts"], "files": files})
    return True


def newest(store: Store, k: int, categories=None, since_date=None, author=None, state: dict | None = None) -> tuple[DataFrame, int]:
    """(the rows of browse(), files of the listing that were opened for them).

    Files are opened from the newest on, twice as many each time, until k rows stand; those that end before since_date are
    not. Papers of parts that have changed since the listing was made are taken from the parts. Without a listing, or for
    more than MOST_K rows, all papers are sorted."""
    state = state or store.state()
    listing = state.get("listing") or {"of": {}, "parts": 0, "files": []}
    if check_k(k) > MOST_K or listing["parts"] != state["parts"]:
        return browse(store.papers(state=state), k, categories, since_date, author), 0

    def best(rows: DataFrame) -> list:
        return narrow(rows, categories, since_date, author).orderBy(*_newest_first()).limit(k).select("id", "update_date").collect()

    changed = sorted(int(p) for p, path in state["papers"].items() if listing["of"].get(p) != path)
    late = best(store.papers(changed, state).select(*_LISTED.fieldNames())) if changed else []
    files = [f for f in listing["files"] if not since_date or (f["newest"] is not None and f["newest"] >= since_date)]
    found, opened = [], 0
    while len(found) < k and opened < len(files):
        some = files[opened : 2 * opened + 1]
        rows = store.spark.read.schema(_LISTED).parquet(*(f["path"] for f in some))
        if changed:
            rows = rows.where(~part_of(state["parts"]).isin(changed))
        found += best(rows)
        opened += len(some)
    order = sorted(found + late, key=lambda r: r["id"])
    order.sort(key=lambda r: (r["update_date"] is not None, r["update_date"] or ""), reverse=True)
    return browse(store.lookup([r["id"] for r in order[:k]], state), k), opened


def refresh_all(store: Store) -> None:
    """Brings every derived table up to the papers of now."""
    SEARCH_VIEW.refresh(store)
    AUTHOR_GRAMS.refresh(store)
    refresh_listing(store)
