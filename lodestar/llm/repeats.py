"""Substring deduplication by recompression.

Texts are strings over word hashes. Each round names runs of equal symbols, then pairs of neighbours, a left and a
right one by a coin that hangs on the symbol alone. A name is a hash of what it stands for, so it is global without
a dictionary and equal substrings get equal interior symbols in every document. With each symbol goes its context,
the words that settled its making; a symbol whose context lies in a window is made wherever that window stands.

A window's anchor is the first such symbol of the highest level that has one. Anchors are counted over the corpus;
only windows of repeated anchors can be repeated, and only those are hashed and matched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitfilter
from .common import cut, table
from .hashing import blocks, mix, power, split, window_hashes, word_hashes

WINDOW = 35
ROUNDS = 8
#: Rounds from one naming of runs to the next.
RUN_EVERY = 8
#: An anchor found this often has its windows dealt over SALTS tasks.
HOT_ANCHOR = 2_000
SALTS = 64
#: Groups of equal texts that are told apart by a table on the executors: at most so many, namely all with more copies
#: than this goes into the number of rows. Of such a group one document stands for all in the search for windows.
MAX_COPY_GROUPS = 100_000

#: Turns word hashes into others, for the second hash of a window. The 32 bits kept of it and the 64 of the first tell
#: windows apart: 10^13 windows give fewer than one chance pair in a thousand corpora.
_CHECK = np.uint64(0x2545F4914F6CDD1D)
_RUN, _PAIR, _LEVEL = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25), 0xD6E8FEB86659FD93


def _salt(level: int) -> np.uint64:
    return np.uint64((level + 1) * _LEVEL & (1 << 64) - 1)


class Symbols:
    """One level: symbols in order with their documents and contexts [low, high] in words of the block."""

    def __init__(self, name: np.ndarray, doc: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.name, self.doc, self.low, self.high = name, doc, low, high

    def joined(self, starts: np.ndarray, name: np.ndarray, low: np.ndarray, high: np.ndarray) -> Symbols:
        return Symbols(name, self.doc[starts], low, high)


def _edges(s: Symbols, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Contexts of the symbols before and after each: beyond a document's edge lies a word that no window holds."""
    n = len(s.name)
    before = np.where(np.r_[True, s.doc[1:] != s.doc[:-1]], first[s.doc] - 1, s.low[np.maximum(np.arange(n) - 1, 0)])
    after = np.where(np.r_[s.doc[1:] != s.doc[:-1], True], last[s.doc] + 1, s.high[np.minimum(np.arange(n) + 1, n - 1)])
    return before, after


def runs(s: Symbols, first: np.ndarray, last: np.ndarray) -> Symbols:
    """Maximal runs of equal symbols become one; what ends a run belongs to its context, also of a run of one."""
    n = len(s.name)
    starts = np.flatnonzero(np.r_[True, (s.name[1:] != s.name[:-1]) | (s.doc[1:] != s.doc[:-1])])
    ends = np.r_[starts[1:], n] - 1
    size = (ends - starts + 1).astype(np.uint64)
    before, after = _edges(s, first, last)
    name = np.where(size > 1, mix(s.name[starts] + size * _RUN), s.name[starts])
    return s.joined(starts, name, np.minimum(s.low[starts], before[starts]), np.maximum(s.high[ends], after[ends]))


def pairs(s: Symbols, first: np.ndarray, last: np.ndarray, level: int) -> Symbols:
    """A left symbol before a right one becomes a pair. A symbol that stays alone has the neighbour that it might have
    joined in its context; a pair needs no more than its halves."""
    n = len(s.name)
    left = (mix(s.name + _salt(level)) & np.uint64(1)).astype(bool)
    met = np.r_[left[:-1] & ~left[1:] & (s.doc[1:] == s.doc[:-1]), False]
    second = np.r_[False, met[:-1]]
    before, after = _edges(s, first, last)
    low = np.where(left, s.low, np.minimum(s.low, before))
    high = np.where(left, np.maximum(s.high, after), s.high)
    follow = np.minimum(np.arange(n) + 1, n - 1)
    low, high = np.where(met, s.low, low), np.where(met, s.high[follow], high)
    name = np.where(met, mix(s.name * power(3) + s.name[follow] + _PAIR), s.name)
    starts = np.flatnonzero(~second)
    return s.joined(starts, name[starts], low[starts], high[starts])


def anchors(words: np.ndarray, doc: np.ndarray, first: np.ndarray, last: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window starts, names of their anchors, place of the anchors): words of a block of documents, doc the number
    of each word's document, first and last its words. Only starts of whole windows are returned."""
    if not len(words):
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    at = np.arange(len(words))
    level = Symbols(words, doc, at, at)
    levels = [level]
    for k in range(ROUNDS):
        if k % RUN_EVERY == 0:  # a run's context reaches beyond it, so naming runs each time would cost long symbols
            level = runs(level, first, last)
        level = pairs(level, first, last, k)
        levels.append(level)
    starts = at[at + window - 1 <= last[doc]]
    name, place = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.int64)
    open_ = np.arange(len(starts))
    for k in range(ROUNDS, -1, -1):
        s = levels[k]
        j = np.searchsorted(s.low, starts[open_])  # the first symbol whose context begins in the window
        safe = (j < len(s.low)) & (s.high[np.minimum(j, len(s.low) - 1)] < starts[open_] + window)
        got = open_[safe]
        name[got] = mix(s.name[j[safe]] + _salt(k))
        place[got] = s.low[j[safe]] * (ROUNDS + 1) + k
        open_ = open_[~safe]
    return starts, name, place


class Parser:
    """Texts of an Arrow batch in blocks of bounded size, as arrays."""

    def __init__(self, window: int):
        self._window = window

    def parse(self, texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(number of the block's first text, first word of each text, word hashes, window starts, documents of the
        starts, anchor names, anchor places)."""
        sizes = [len(t or "") // 5 for t in texts]
        for a, b in blocks(sizes):
            flat, n = word_hashes(texts[a:b])
            first = np.cumsum(n) - n
            doc = np.repeat(np.arange(b - a), n)
            starts, name, place = anchors(flat, doc, first, first + n - 1, self._window)
            yield a, first, flat, starts, doc[starts] if len(starts) else starts, name, place


def _count_anchors(docs: DataFrame, window: int) -> DataFrame:
    """anchor, n: places where each anchor stands."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        parser = Parser(window)
        for batch in batches:
            for _, _, _, starts, owner, name, place in parser.parse(batch.column(0).to_pylist()):
                if len(starts):
                    new = np.r_[True, (place[1:] != place[:-1]) | (name[1:] != name[:-1]) | (owner[1:] != owner[:-1])]
                    seen, n = np.unique(name[new], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(seen.view(np.int64)), pa.array(n, pa.int64())], names=["anchor", "n"])

    return docs.select("text").mapInArrow(run, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))


def _key(text: str | None) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest((text or "").encode("utf-8", "surrogatepass")) >> 33


def copy_groups(docs: DataFrame) -> dict[int, int]:
    """Hash of the text and first document of each group of equal texts beyond the size that MAX_COPY_GROUPS allows."""
    keyed = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("key"))
    groups = keyed.groupBy("key").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    groups = cut(groups.where("copies > 1 AND first < last"))
    rows = groups.agg(F.sum("copies")).first()[0] or 0
    found = groups.where(F.col("copies") > 1 + rows // MAX_COPY_GROUPS).toArrow()
    return dict(zip(found["key"].to_pylist(), found["first"].to_pylist()))


def _windows(docs: DataFrame, window: int, known, hot, groups) -> DataFrame:
    """hash and check (a second one), doc_id, tag (of the text), start, salt (0 unless the anchor is hot) of the windows
    that may be repeated."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        parser = Parser(window)
        for batch in batches:
            own_first = [groups.value.get(key, doc) == doc for key, doc in zip(batch.column(2).to_pylist(), batch.column(0).to_pylist())]
            batch = batch.filter(pa.array(own_first, pa.bool_()))
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, first, flat, starts, owner, name, _ in parser.parse(texts):
                may = bitfilter.has(known.value, name) if len(starts) else np.zeros(0, bool)
                if not may.any():
                    continue
                starts, owner, name = starts[may], owner[may], name[may]
                docs_here, which = np.unique(owner, return_inverse=True)
                tags = np.array([_key(texts[a + d]) for d in docs_here], np.int32)[which]
                own = pa.array([ids[a + d] for d in docs_here], pa.int64()).take(pa.array(which))
                hashes, checks = window_hashes(flat, window)[starts], window_hashes(mix(flat ^ _CHECK), window)[starts]
                salt = np.where(bitfilter.has(hot.value, name), 1 + tags % SALTS, 0).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes.view(np.int64)), pa.array((checks >> np.uint64(32)).astype(np.uint32).view(np.int32)), own, pa.array(tags), pa.array((starts - first[owner]).astype(np.int32)), pa.array(salt)],
                    names=["hash", "check", "doc_id", "tag", "start", "salt"],
                )

    return docs.select("doc_id", "text", F.xxhash64("text").alias("key")).mapInArrow(run, "hash long, check int, doc_id long, tag int, start int, salt int")


_MATCHED = "hash long, check int, doc_id long, tag int, start int, salt int, n long"


def _match(batches: Iterator) -> Iterator:
    """Rows sorted by (hash, check, salt) in; with n, the rows of their group, out. A group is only counted as it goes by:
    rows are held one batch long, and a group that goes on has n >= 2 from its second row."""
    import pyarrow as pa

    held = None  # the last row of the batch before, whose group may go on

    def emit(table: pa.Table, n: np.ndarray) -> Iterator:
        keep = (n > 1) | (table.column("salt").to_numpy() > 0)
        # only rows of salted groups are looked up by hash again
        hashes = pa.array(table.column("hash").to_numpy(), mask=table.column("salt").to_numpy() == 0)
        table = table.set_column(0, "hash", hashes).append_column("n", pa.array(n, pa.int64()))
        yield from table.filter(pa.array(keep)).to_batches()

    before = None  # key of the group that the held row continues
    for batch in batches:
        part = pa.Table.from_batches([batch])
        data = part if held is None else pa.concat_tables([held, part])
        key = [data.column(c).to_numpy() for c in ("hash", "check", "salt")]
        same = np.logical_and.reduce([k[1:] == k[:-1] for k in key])
        again = np.r_[before is not None and before == tuple(k[0] for k in key), same]
        n = 1 + (again | np.r_[same, False]).astype(np.int64)
        before = tuple(k[-1] for k in key) if again[-1] else None
        yield from emit(data.slice(0, len(data) - 1), n[:-1])
        held = data.slice(len(data) - 1)
        held_n = n[-1:]
    if held is not None:
        yield from emit(held, held_n)


def find_repeats(docs: DataFrame, window: int, groups) -> DataFrame:
    """doc_id, tag, starts: for each text with repeated windows their first words, ascending. Of the broadcast groups of
    equal texts only the first documents take part; that all windows of those texts are repeated is known.

    tag is a 31-bit hash of the text, so rows that share an id but not a text stay apart; rows that share both are two
    places of every window of theirs. Null texts have no words."""
    spark = docs.sparkSession
    counts = cut(_count_anchors(docs, window).where(F.col("n") > 1))
    known = spark.sparkContext.broadcast(bitfilter.build(counts, "anchor", bitfilter.bits_for(counts.count())))
    often = counts.where(F.col("n") >= HOT_ANCHOR)
    hot = spark.sparkContext.broadcast(bitfilter.build(often, "anchor", bitfilter.bits_for(often.count())))
    found = _windows(docs, window, known, hot, groups)
    sorted_ = found.repartition("hash", "salt").sortWithinPartitions("hash", "check", "salt")
    matched = cut(sorted_.mapInArrow(_match, _MATCHED))
    sure = matched.where(F.col("n") > 1).select("doc_id", "tag", "start")
    # a window that is alone under its salt is repeated if its hash stands under another salt, or without one
    lone = matched.where(F.col("n") == 1)
    others = matched.where(F.col("salt") > 0).groupBy("hash", "check").agg(F.count_distinct("salt").alias("salts")).where(F.col("salts") > 1).select("hash", "check")
    late = lone.join(others, ["hash", "check"], "left_semi").select("doc_id", "tag", "start")
    return sure.unionByName(late).groupBy("doc_id", "tag").agg(F.sort_array(F.collect_set("start")).alias("starts"))


def mark_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with a column `repeats`: struct(n_words, n_removed, kept_text), n_removed the words in windows of `window`
    words that also start elsewhere in the corpus, kept_text the others joined by one space.

    A null or empty text has no words and an empty kept_text. Other columns pass through; `repeats` is replaced."""
    own = docs.drop("repeats")
    groups = docs.sparkSession.sparkContext.broadcast(copy_groups(docs))
    found = find_repeats(docs, window, groups).select(F.col("doc_id").alias("id"), "tag", "starts")

    @F.pandas_udf("int")
    def tag(texts):
        return texts.map(_key, na_action=None).astype("int32")

    @F.pandas_udf("n_words long, n_removed long, kept_text string")
    def apply(texts, keys, starts):
        import pandas as pd

        rows = []
        for text, key, s in zip(texts, keys, starts):
            ws = split(text)
            if len(ws) >= window and key in groups.value:
                rows.append((len(ws), len(ws), ""))
                continue
            if s is None or not len(s):
                rows.append((len(ws), 0, b" ".join(ws).decode("utf-8", "replace")))
                continue
            edge = np.zeros(len(ws) + 1, np.int32)
            np.add.at(edge, np.asarray(s), 1)
            np.add.at(edge, np.asarray(s) + window, -1)
            gone = np.cumsum(edge[:-1]) > 0
            kept = b" ".join(w for w, g in zip(ws, gone.tolist()) if not g)
            rows.append((len(ws), int(gone.sum()), kept.decode("utf-8", "replace")))
        return pd.DataFrame(rows, columns=["n_words", "n_removed", "kept_text"])

    packed = own.select(F.struct(*(F.col(f"`{c}`") for c in own.columns)).alias("row"))  # no column can clash with ours
    tagged = packed.withColumn("own_tag", tag("row.text"))
    joined = tagged.join(found, F.col("row.doc_id").eqNullSafe(F.col("id")) & (F.col("own_tag") == F.col("tag")), "left")
    return joined.select("row", apply("row.text", F.xxhash64("row.text"), "starts").alias("repeats")).select("row.*", "repeats")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words removed and left of every document; cases as in mark_repeats."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return mark_repeats(docs).select("doc_id", "repeats.n_words", "repeats.n_removed", F.sha2("repeats.kept_text", 256).alias("kept_sha256"))


#: DuckDB SQL for op3_substring_dedup: every window as text (of 2, 4, 8, 16, 32 and then 35 words), counted over the corpus.
OP3_SQL = r"""
WITH split AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), places AS (SELECT rid, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM split),
w2 AS (SELECT *, word || ' ' || lead(word) OVER t AS g2 FROM places WINDOW t AS (PARTITION BY rid ORDER BY i)),
w4 AS (SELECT *, g2 || ' ' || lead(g2, 2) OVER t AS g4 FROM w2 WINDOW t AS (PARTITION BY rid ORDER BY i)),
w8 AS (SELECT *, g4 || ' ' || lead(g4, 4) OVER t AS g8 FROM w4 WINDOW t AS (PARTITION BY rid ORDER BY i)),
w16 AS (SELECT *, g8 || ' ' || lead(g8, 8) OVER t AS g16 FROM w8 WINDOW t AS (PARTITION BY rid ORDER BY i)),
w35 AS (
  SELECT rid, i, word, g16 || ' ' || lead(g16, 16) OVER t || ' ' || lead(g2, 32) OVER t || ' ' || lead(word, 34) OVER t AS win
  FROM w16 WINDOW t AS (PARTITION BY rid ORDER BY i)
), often AS (SELECT win FROM w35 WHERE win IS NOT NULL GROUP BY 1 HAVING count(*) > 1),
marked AS (
  SELECT rid, i, word, max(CASE WHEN o.win IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone
  FROM w35 p LEFT JOIN often o ON p.win = o.win
), left_over AS (SELECT rid, CAST(sum(gone) AS BIGINT) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM marked GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM split LEFT JOIN left_over USING (rid)
"""
