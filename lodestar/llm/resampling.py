"""Importance resampling towards a target distribution, with an integer dictionary of words.

Distinct words get integer ids, n-grams are tuples of ids, and only a distinct tuple is turned back into words and
hashed. Texts are read in blocks of many documents: a block names its words and n-grams by small numbers of its own, so
that what is joined with the dictionary is a row per block and distinct word, and not a row per word of the corpus. No
word is a hot key, for a block holds it once. The gains of the tuples come back to the blocks the same way.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scratch import scratch_path
from ..operators.store import number_rows
from .common import cut, table

BUCKETS = 10_000
LONGEST = 1
SEED = 2024
MIN_WORDS = 20
PERCENT = 10
#: Words after which a block ends, at the end of a document.
BLOCK_WORDS = 1 << 21

#: Bytes of words (digits, letters, all of other scripts) in lower case, blanks for the rest.
_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_BLOCK = "block long, words array<string>, heads array<int>, tails array<int>, counts array<long>, doc_ids array<long>, features array<int>, sizes array<int>, refs binary"
_TUPLES = "block long, feature int, tuple array<long>, n long"


def split_words(text: str | None) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` in UTF-8, after A-Z became a-z; a null text has none."""
    return (text or "").encode().translate(_WORD_BYTES).split()


class _Numbers(dict):
    """Numbers from 0 for what is looked up, in the order of its first coming."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def _grams(ids: np.ndarray, sizes: np.ndarray, n_words: int, longest: int) -> tuple[np.ndarray, ...]:
    """(heads, tails, features of all documents in order, number of features of each) of texts given by word numbers.

    Features below n_words are the words; feature n_words + i is feature heads[i] followed by word tails[i]."""
    doc = np.repeat(np.arange(len(sizes)), sizes)
    none = np.zeros(0, np.int64)
    levels, docs, heads, tails = [ids], [doc], [none], [none]
    before, known = ids, n_words  # before[i]: the feature of the n - 1 words from place i on
    for n in range(2, longest + 1):
        places = np.flatnonzero(doc[n - 1 :] == doc[: max(len(doc) - n + 1, 0)])
        found, at = np.unique(before[places] * n_words + ids[places + n - 1], return_inverse=True)
        heads.append(found // max(n_words, 1)), tails.append(found % max(n_words, 1))
        levels.append(known + at), docs.append(doc[places])
        before = np.zeros(len(doc), np.int64)
        before[places] = known + at
        known += len(found)
    owner = np.concatenate(docs)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(heads), np.concatenate(tails), np.concatenate(levels)[order], np.bincount(owner, minlength=len(sizes))


def _blocks(texts: DataFrame, longest: int, block_words: int = BLOCK_WORDS) -> DataFrame:
    """A written row per block of texts(doc_id, text): its words, its longer n-grams (heads, tails), how often each of
    these features stands there, and of each document its id, its number of features and words, and in refs (compressed)
    its features in order. A task that runs again draws other block numbers; those of the written table stay."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        names = [c.split()[0] for c in _BLOCK.split(", ")]
        kinds = [pa.int64(), pa.list_(pa.string()), *[pa.list_(pa.int32())] * 2, *[pa.list_(pa.int64())] * 2, *[pa.list_(pa.int32())] * 2, pa.binary()]
        numbers, parts, doc_ids, held = _Numbers(), [], [], 0

        def block():
            sizes = np.array([len(p) for p in parts], np.int64)
            heads, tails, refs, features = _grams(np.concatenate(parts), sizes, len(numbers), longest)
            counts = np.bincount(refs, minlength=len(numbers) + len(heads))
            row = (uuid.uuid4().int >> 65, [w.decode() for w in numbers], heads, tails, counts, doc_ids, features, sizes, zstandard.compress(refs.astype("<i4").tobytes(), 3))
            return pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(row, kinds)], names=names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.fromiter(map(numbers.__getitem__, split_words(text.as_py())), np.int64)
                parts.append(ids), doc_ids.append(doc_id)
                held += len(ids) + 1
                if held >= block_words:
                    yield block()
                    numbers, parts, doc_ids, held = _Numbers(), [], [], 0
        if parts:
            yield block()

    return cut(texts.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _BLOCK))


def _dictionary(*blocks: DataFrame) -> DataFrame:
    """word, id: an integer for each distinct word, held fast by the written table."""
    words = [b.select(F.explode("words").alias("word")) for b in blocks]
    for more in words[1:]:
        words[0] = words[0].unionByName(more)
    return cut(words[0].distinct().select("word", F.monotonically_increasing_id().alias("id")))


def _tuples(blocks: DataFrame, dictionary: DataFrame, longest: int) -> DataFrame:
    """block, feature, tuple of word ids, n (times in the block) for each feature of each block."""
    words = blocks.select("block", F.posexplode(F.arrays_zip("words", F.expr("slice(counts, 1, size(words))").alias("n"))).alias("feature", "w"))
    known = words.select("block", "feature", F.col("w.words").alias("word"), F.col("w.n").alias("n")).join(dictionary, "word")
    single = known.select("block", "feature", F.array("id").alias("tuple"), "n")
    if longest < 2:
        return single

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for block, ids, heads, tails, counts in zip(*(batch.column(i).to_pylist() for i in range(5))):
                tuples = [(x,) for x in ids]
                for head, tail in zip(heads, tails):  # a head comes before what it heads
                    tuples.append((*tuples[head], ids[tail]))
                n = len(ids)
                columns = [pa.array([block] * len(heads), pa.int64()), pa.array(range(n, len(tuples)), pa.int32()), pa.array(tuples[n:], pa.list_(pa.int64())), pa.array(counts[n:], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["block", "feature", "tuple", "n"])

    ordered = F.transform(F.array_sort(F.collect_list(F.struct("feature", "id"))), lambda x: x["id"])
    ids = known.groupBy("block").agg(ordered.alias("ids"))  # a block's words, so bounded
    longer = blocks.where(F.size("heads") > 0).join(ids, "block").select("block", "ids", "heads", "tails", "counts")
    return single.unionByName(longer.mapInArrow(run, _TUPLES))


def _hashed(counted: DataFrame, dictionary: DataFrame, buckets: int) -> DataFrame:
    """counted(tuple, ...) with `bucket`: the crc32 of each tuple's words, joined by one space, modulo buckets."""
    spelt = counted.select("tuple", F.posexplode("tuple").alias("at", "id")).join(dictionary, "id")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ")
    bucket = (F.crc32(text.cast("binary")) % buckets).cast("int")
    return counted.join(spelt.groupBy("tuple").agg(bucket.alias("bucket")), "tuple")


def _gains(hashed: DataFrame, buckets: int) -> DataFrame:
    """bucket, gain of each bucket in use: at most `buckets` rows."""
    by = hashed.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    total = hashed.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("s"), F.coalesce(F.sum("t"), F.lit(0)).alias("t")).first()
    up = (F.col("t") + 1).cast("double") * F.lit(float(total["s"] + buckets))
    down = (F.col("s") + 1).cast("double") * F.lit(float(total["t"] + buckets))
    return by.select("bucket", F.floor(F.lit(1000.0) * F.log(up / down)).alias("gain"))


def weigh(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_features, weight for every row of docs: the floored mean gain of its 1- to longest-grams under
    the hashed bag models of docs and target. Null and empty texts have no features and weight 0; repeated rows and null
    ids stay rows of their own; empty tables give no rows or, of target, a model without counts."""
    blocks = _blocks(docs, longest, block_words)
    wanted = _blocks(target.select(F.lit(None).alias("doc_id"), "text"), longest, block_words)
    dictionary = _dictionary(blocks, wanted)
    tuples = cut(_tuples(blocks, dictionary, longest))
    theirs = _tuples(wanted, dictionary, longest)
    both = tuples.select("tuple", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(theirs.select("tuple", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    hashed = cut(_hashed(both.groupBy("tuple").agg(F.sum("s").alias("s"), F.sum("t").alias("t")), dictionary, buckets))
    gained = hashed.join(F.broadcast(_gains(hashed, buckets)), "bucket").select("tuple", "gain")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("feature", "gain"))), lambda x: x["gain"])
    back = tuples.select("block", "feature", "tuple").join(gained, "tuple").groupBy("block").agg(ordered.alias("gains"))  # a block's features

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        for batch in batches:
            for i in range(batch.num_rows):
                doc_ids, features, sizes, gains = (batch.column(k)[i].values for k in range(4))
                refs = np.frombuffer(zstandard.decompress(batch.column(4)[i].as_py()), "<i4")
                n = features.to_numpy().astype(np.int64)
                own = gains.to_numpy() if gains is not None else np.zeros(0, np.int64)
                sums, ends = np.r_[0, np.cumsum(own[refs])], np.cumsum(n)
                weight = (sums[ends] - sums[ends - n]) // np.maximum(n, 1)
                yield pa.RecordBatch.from_arrays([doc_ids, pa.array(sizes.to_numpy().astype(np.int64)), pa.array(n), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    whole = blocks.join(back, "block", "left").select("doc_ids", "features", "sizes", "gains", "refs")
    return whole.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def draw(weighed: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """weighed with `score` (its weight and noise that hangs on seed and id) and `rank`: 1, 2, 3... for the highest
    percent of the documents of min_words or more, else null. Ties go to the smaller id. A row without an id has no
    score, is not drawn and not counted. Rows are numbered where they lie in ranges of the order, so no task sorts all."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")).cast("binary"), 256), 1, 8)
    share = (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log(share)))
    scored = cut(weighed.withColumn("score", F.col("weight") + noise))
    enough = F.coalesce(F.col("n_words") >= min_words, F.lit(False)) & F.col("score").isNotNull()
    n = scored.where(enough).count() * percent // 100
    order = F.struct((-F.col("score")).alias("a"), F.col("doc_id").alias("b"), F.col("n_features").alias("c"), F.col("weight").alias("d"))
    numbered = number_rows(scored.where(enough).withColumn("_order", order), "_order", 1, "rank", scratch_path(scored.sparkSession, "ranks")).drop("_order")
    ranked = numbered.withColumn("rank", F.when(F.col("rank") <= n, F.col("rank")))
    return ranked.unionByName(scored.where(~enough).withColumn("rank", F.lit(None).cast("long")))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of all documents towards the benchmark, and the tenth drawn by them; cases as in weigh and draw."""
    weighed = weigh(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return draw(weighed).select("doc_id", "n_features", "weight", "score", "rank")


_CRC_TABLE = "list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i))"
_CRC = "xor(list_reduce(bytes, lambda c, b: xor(c >> 8, crc[CAST(xor(c, b) & 255 AS BIGINT) + 1]), CAST(4294967295 AS BIGINT)), 4294967295)"
_SPLIT = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP12_SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_SPLIT} AS ws FROM documents),
w AS (SELECT r, unnest(ws) AS word FROM d), b AS (SELECT unnest({_SPLIT}) AS word FROM benchmark),
tables AS (SELECT {_CRC_TABLE} AS crc),
spelt AS (SELECT word, list_transform(range(CAST(length(hex(encode(word))) // 2 AS BIGINT)), lambda i: CAST('0x' || substr(hex(encode(word)), 2 * i + 1, 2) AS BIGINT)) AS bytes FROM (SELECT word FROM w UNION SELECT word FROM b)),
hashed AS (SELECT word, {_CRC} % {BUCKETS} AS bucket FROM spelt, tables),
s AS (SELECT bucket, count(*) AS s FROM w JOIN hashed USING (word) GROUP BY 1), t AS (SELECT bucket, count(*) AS t FROM b JOIN hashed USING (word) GROUP BY 1),
gains AS (SELECT bucket, CAST(floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST((SELECT count(*) FROM w) + {BUCKETS} AS DOUBLE) / (CAST(coalesce(s, 0) + 1 AS DOUBLE) * CAST((SELECT count(*) FROM b) + {BUCKETS} AS DOUBLE)))) AS BIGINT) AS gain FROM s FULL JOIN t USING (bucket)),
weighed AS (SELECT r, count(*) AS n_features, CAST(floor(CAST(sum(gain) AS DOUBLE) / count(*)) AS BIGINT) AS weight FROM w JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY 1),
scored AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{SEED}:' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM d LEFT JOIN weighed USING (r)),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_features >= {MIN_WORDS})
SELECT s.doc_id, s.n_features, s.weight, s.score, k.rank FROM scored s LEFT JOIN (SELECT * FROM ranked WHERE rank <= (SELECT count(*) * {PERCENT} // 100 FROM ranked)) k USING (doc_id)"""
