"""Best-fit packing by minimum bin slack.

Documents become token pieces; the histogram of piece lengths (at most `capacity` rows) goes to the driver, where
a subset-sum over bitsets finds, bin after bin, the fullest feasible combination of lengths. A combination is
used as often as the counts allow, so the plan has a few thousand rows whatever the corpus holds. Executors then
give every piece its place from its rank among the pieces of its length.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

CAPACITY = 1024
END_ID = 2
#: The special token of the vocabulary (fixed value); its id follows those of the others.
SPECIAL = "<|endoftext|>"
_MEMO_ENTRIES = 400_000
_SPACED = re.compile(r"\s (?:\s|\Z)")
#: Runs of Unicode's white space that are encoded by themselves: looking ahead over a run costs the matcher stack.
_LONG = 1_000
_LONG_RUN = re.compile(f"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{{{_LONG},}}")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder:
    """Byte-level BPE ids as little-endian unsigned 32-bit bytes, remembered by blank-separated chunk.

    The vocabulary's special token is one id wherever its string stands in a text; what lies between is encoded by itself.

    The pre-tokenizer never joins text across a single space that follows a non-blank, so chunks that begin at such
    a space can be encoded alone. Texts with other runs of blanks around a space are encoded whole, but for long
    runs: the pre-tokenizer takes a run up to its last blank, or whole at the end of a text, for one token to be split."""

    def __init__(self, path: str):
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._bpe = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._run = tiktoken.Encoding("run", pat_str="(?s).+", mergeable_ranks=ranks, special_tokens={})
        self._memo = _Memo(self._plain)
        self._special = array("I", [len(ranks)]).tobytes()

    def _plain(self, text: str) -> bytes:
        if len(text) < _LONG:
            return array("I", self._bpe.encode_ordinary(text)).tobytes()
        ids, at = array("I"), 0
        for run in _LONG_RUN.finditer(text):
            end = run.end() if run.end() == len(text) else run.end() - 1
            ids.extend(self._bpe.encode_ordinary(text[at : run.start()]))
            ids.extend(self._run.encode_ordinary(text[run.start() : end]))
            at = end
        ids.extend(self._bpe.encode_ordinary(text[at:]))
        return ids.tobytes()

    def encode(self, text: str) -> bytes:
        return self._special.join(map(self._between, text.split(SPECIAL)))

    def _between(self, text: str) -> bytes:
        if _SPACED.search(text):
            return self._plain(text)
        first, *rest = text.split(" ")
        if len(self._memo) > _MEMO_ENTRIES:
            self._memo.clear()
        return self._plain(first) + b"".join(map(self._memo.__getitem__, rest))


class _Memo(dict):
    def __init__(self, encode):
        self._encode = encode

    def __missing__(self, chunk: str) -> bytes:
        self[chunk] = found = self._encode(" " + chunk)
        return found


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, if asked for, ids (binary, 4 bytes each).

    A null text is empty: its one piece is end_id. Repeated rows give repeated pieces. A document of more than
    `capacity` ids is cut so that all pieces but the first are full."""
    vocabulary = vocabulary or default_vocabulary()
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        enc, end = encoder(vocabulary), array("I", [end_id]).tobytes()
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = enc.encode(text.as_py() or "") + end
                total = len(ids) // 4
                at, k = 0, 0
                while at < total:
                    length = capacity if k else (total % capacity or capacity)
                    part = ids[4 * at : 4 * (at + length)]
                    out.append((doc, k, at, length, zlib.crc32(part), part)[: 5 + with_ids])
                    at, k = at + length, k + 1
            columns = list(zip(*out)) or [()] * (5 + with_ids)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], schema=None, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


@dataclass(frozen=True)
class Segment:
    """`times` bins from number `first` on each take `copies` pieces of `length`, placed from `offset`."""

    length: int
    rank: int
    copies: int
    times: int
    first: int
    offset: int


def _fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of available lengths with the largest sum up to room; among equals, long pieces first.

    Bit s of `reach` tells whether sum s can be made from the lengths seen so far; a length with c copies is
    added in doubling bundles, so a length costs log(c) shifts."""
    mask, reach, layers = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, bundle = min(counts[length], room // length), 1
        while left:
            take = min(bundle, left)
            grown = (reach | reach << (take * length)) & mask
            if grown != reach:
                layers.append((length, take, reach))
                reach = grown
            left, bundle = left - take, bundle * 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, take, before in reversed(layers):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + take
            total -= take * length
    return chosen


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Segment]:
    """Bins for a histogram of lengths. Each combination holds the longest piece left and what fills it best."""
    counts = {x: n for x, n in histogram.items() if n}
    used: dict[int, int] = {}
    found, first = [], 0
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        chosen = _fullest({x: n for x, n in counts.items() if n}, capacity - longest)
        counts[longest] += 1
        chosen[longest] = chosen.get(longest, 0) + 1
        times, offset = min(counts[x] // k for x, k in chosen.items()), 0
        for x, k in sorted(chosen.items(), reverse=True):
            found.append(Segment(x, used.get(x, 0), k, times, first, offset))
            used[x] = used.get(x, 0) + k * times
            counts[x] -= k * times
            if not counts[x]:
                del counts[x]
            offset += k * x
        first += times
    return found


def _ranked(rows: DataFrame, bucket_rows: int) -> DataFrame:
    """rows with `rank`: a dense number from 0 within each length. Rows are dealt by hash into buckets and ranked
    there; a bucket starts where the smaller ones end, so a length that most rows share stays spread out."""
    buckets = max(1, -(-rows.count() // bucket_rows), rows.sparkSession.sparkContext.defaultParallelism)
    dealt = rows.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    starts = dealt.groupBy("length", "_bucket").count()
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("length", "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_bucket", "length").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("_n", F.row_number().over(inside) - 1)
    return ranked.join(starts, ["length", "_bucket"]).withColumn("rank", F.col("_start") + F.col("_n")).drop("_bucket", "_start", "_n")


def pack(cut_pieces: DataFrame, capacity: int = CAPACITY, bucket_rows: int = 1_000_000) -> DataFrame:
    """The pieces (from a written table, as they are read three times) with sequence_id and offset.

    Every piece is placed once; offsets in a sequence run gapless from 0. An empty table gives no rows."""
    histogram = {r["length"]: r["count"] for r in cut_pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    segments = sorted(plan(histogram, capacity), key=lambda s: (s.length, s.rank))
    import numpy as np

    keys = np.array([s.length << 48 | s.rank for s in segments], np.int64)  # ranks stay under 2^48
    cols = np.array([(s.rank, s.copies, s.first, s.offset) for s in segments], np.int64).reshape(-1, 4)

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        size, number = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        start, copies, first, offset = cols[np.searchsorted(keys, size << 48 | number, "right") - 1].T
        turn = number - start
        return pd.DataFrame({"sequence_id": first + turn // copies, "offset": offset + turn % copies * size})

    placed = _ranked(cut_pieces, bucket_rows).withColumn("_at", place("length", "rank"))
    return placed.select(*cut_pieces.columns, "_at.sequence_id", "_at.offset")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places; cases as in pieces and pack."""
    return pack(cut(pieces(table(spark, sf_dir, "documents"))))
