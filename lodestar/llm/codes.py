"""Product quantisation in integers: a tree of partial sums over columnar blocks.

Vectors become integers and lie in blocks of columns, one array per dimension. A round accumulates distances dimension
by dimension, adds every part to the sum and count of its nearest entry (np.add.at on integer tensors of a fixed size),
and merges the tensors of all blocks by treeAggregate: tasks pass on one tensor each, whatever they read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
#: Rows of a columnar block at most.
BLOCK_ROWS = 65_536
#: Labels with more than this share of all rows, a thousand at most, are joined by a table on every task.
HOT_SHARE = 0.001
_LONG = (1 << 63) - 1


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding, label of the rows whose vector is there and has finite components only."""
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col("embedding").isNotNull() & good).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")


def _integers(column, dim: int) -> np.ndarray:
    """floor(SCALE * x) of an Arrow list column, a row per vector: 64-bit integers, or Python's for huge ones."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(flat) != dim * len(column) or set(np.diff(column.offsets.to_numpy())) - {dim}:
        raise ValueError(f"all vectors must have {dim} components, in {PARTS} equal parts")
    scaled = np.floor(flat * SCALE)
    if not len(scaled) or np.abs(scaled).max() < 1 << 62:
        return scaled.astype(np.int64).reshape(-1, dim)
    return np.array([int(x) for x in scaled], object).reshape(-1, dim)


def _columns(matrix: np.ndarray, wide: bool) -> np.ndarray:
    """[dimension, row]; int32 where that holds all values, as blocks are kept between rounds."""
    turned = np.ascontiguousarray(matrix.T)
    return turned.astype(object) if wide else turned.astype(np.int32)


def _work_type(columns: np.ndarray):
    return object if columns.dtype == object else np.int64


def nearest(columns: np.ndarray, codebooks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) by part and row: the nearest entry of each part's codebook, ties to the lower index.
    columns[dimension, row], codebooks[part, entry, position]."""
    parts, entries, width = codebooks.shape
    kind = _work_type(columns)
    index, least = [], []
    for p in range(parts):
        distance = np.zeros((entries, columns.shape[1]), kind)
        for j in range(width):
            off = columns[p * width + j].astype(kind) - codebooks[p, :, j, None]
            distance += off * off
        best = np.argmin(distance, axis=0)
        index.append(best), least.append(distance[best, np.arange(len(best))])
    return np.array(index).reshape(parts, -1), np.array(least, kind).reshape(parts, -1)


def _added(total: tuple | None, columns: np.ndarray, codebooks: np.ndarray) -> tuple:
    """total with the sums and counts of a block: [part, entry, position] and [part, entry]."""
    parts, entries, width = codebooks.shape
    sums, counts = total or (np.zeros(codebooks.shape, codebooks.dtype), np.zeros((parts, entries), np.int64))
    index, _ = nearest(columns, codebooks)
    for p in range(parts):
        np.add.at(counts[p], index[p], 1)
        for j in range(width):
            np.add.at(sums[p, :, j], index[p], columns[p * width + j].astype(codebooks.dtype))
    return sums, counts


def _merged(a: tuple | None, b: tuple | None) -> tuple | None:
    return (a[0] + b[0], a[1] + b[1]) if a and b else a or b


def _seeds(kept: DataFrame, dim: int, parts: int, entries: int) -> np.ndarray:
    """[part, entry, position] of the vectors with the smallest ids; of rows with one id the least vector, a null id last."""
    first = kept.groupBy("vec_id").agg(F.min("embedding").alias("embedding")).orderBy(F.col("vec_id").asc_nulls_last()).limit(entries).toArrow()
    ints = _integers(first["embedding"].combine_chunks(), dim)
    return ints.reshape(len(ints), parts, dim // parts).swapaxes(0, 1).copy()


def train(blocks: RDD, codebooks: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks after the rounds, each a pass over the blocks and a tree of merges. An entry without parts stays."""
    context = blocks.context
    for _ in range(rounds):
        shared = context.broadcast(codebooks)  # of a fixed size: entries times dimensions
        sums, counts = blocks.treeAggregate(None, lambda total, block: _added(total, block, shared.value), _merged)
        used = counts > 0
        codebooks = np.where(used[:, :, None], sums // np.maximum(counts, 1)[:, :, None], codebooks)
        shared.destroy()
    return codebooks


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, label, code, error) of every usable vector, the final codebooks [part, entry, position]).

    Rows without a vector, or with a null, infinite or NaN component, go. Repeated rows and null ids are encoded like
    others. Fewer usable ids than entries give as many entries; none give no rows. Vectors of unequal lengths, or that
    do not divide into the parts, are refused. Where a component is so large that 64 bits might not hold a distance, all
    is reckoned with Python's integers, and an error past 64 bits is given as the largest."""
    spark = vectors.sparkSession
    kept = cut(usable(vectors))
    size = kept.agg(F.max(F.size("embedding")).alias("dim"), F.max(F.array_max(F.transform("embedding", F.abs))).alias("most")).first()
    schema = f"vec_id long, label {dict(vectors.dtypes)['label']}, code string, error long"
    if size["dim"] is None:
        return spark.createDataFrame([], schema), np.zeros((parts, 0, 0), np.int64)
    dim = size["dim"]
    if dim % parts:
        raise ValueError(f"all vectors must have {dim} components, in {parts} equal parts")
    # below this, int64 holds a sum of dim squared differences, and of 2^32 components
    wide = (size["most"] or 0) * SCALE >= min(1 << 31, int((_LONG / max(dim, 1)) ** 0.5) // 2)
    codebooks = _seeds(kept, dim, parts, entries).astype(object if wide else np.int64)

    def to_blocks(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                matrix = _integers(part.column(0), dim)
                data = b"" if wide else _columns(matrix, False).tobytes()
                text = [str(x) for x in matrix.T.ravel()] if wide else []
                yield pa.RecordBatch.from_arrays([pa.array([data]), pa.array([text], pa.list_(pa.string()))], names=["data", "text"])

    def to_array(row) -> np.ndarray:
        if wide:
            return np.array([int(x) for x in row["text"]], object).reshape(dim, -1)
        return np.frombuffer(row["data"], np.int32).reshape(dim, -1)

    blocks = kept.select("embedding").mapInArrow(to_blocks, "data binary, text array<string>").rdd.map(to_array).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        codebooks = train(blocks, codebooks, rounds)
    finally:
        blocks.unpersist()
    shared = spark.sparkContext.broadcast(codebooks)
    digits = np.array([f"{i:02x}" for i in range(max(entries, 1))])

    def encode(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            index, error = nearest(_columns(_integers(batch.column(1), dim), wide), shared.value)
            codes = pa.array(["".join(x) for x in digits[index.T]], pa.string())
            errors = pa.array([min(int(x), _LONG) for x in error.sum(axis=0)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), codes, errors], names=["vec_id", "label", "code", "error"])

    return kept.select("vec_id", "embedding", "label").mapInArrow(encode, schema), codebooks


def with_label_errors(coded: DataFrame) -> DataFrame:
    """coded (a written table) with label_error: the sum of errors over equal labels, nulls together.

    Sums are made map-side first. Labels of more than HOT_SHARE of the rows, of which there are few by that bound, go to
    every task; the others are joined by a shuffle in which none of them is large. Beyond 64 bits the sum is the largest."""
    whole = F.sum(F.col("error").cast("decimal(38,0)"))
    sums = cut(coded.groupBy(F.col("label").alias("_label")).agg(F.least(whole, F.lit(_LONG).cast("decimal(38,0)")).cast("long").alias("label_error"), F.count("*").alias("_n")))
    total = sums.agg(F.sum("_n")).first()[0] or 0
    hot = sums.where(F.col("_n") > HOT_SHARE * total).drop("_n")
    rest = sums.where(F.col("_n") <= HOT_SHARE * total).drop("_n")
    same = F.col("label").eqNullSafe(F.col("_label"))
    return coded.join(F.broadcast(hot), same).drop("_label").unionByName(coded.join(F.broadcast(hot), same, "left_anti").join(rest, same).drop("_label"))


def digest(codebooks: np.ndarray) -> str:
    """Hex SHA-256 of all components in decimal by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and errors of all embeddings; cases as in compress and with_label_errors."""
    coded, codebooks = compress(table(spark, sf_dir, "embeddings"))
    found = with_label_errors(cut(coded)).select("vec_id", "code", "error", "label_error")
    return found.withColumn("codebooks_sha256", F.lit(digest(codebooks)))


def _sql() -> str:
    """The rounds written one after the other."""
    ctes = [
        f"""k AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, len(embedding) // {PARTS} AS w, list_transform(embedding, lambda x: CAST(floor(x::DOUBLE * {SCALE}) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)""",
        f"p AS MATERIALIZED (SELECT r, p, v[p * w + 1 : p * w + w] AS x FROM k, (SELECT unnest(range({PARTS})) AS p))",
        "s AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS e, r FROM (SELECT min(r) AS r, vec_id FROM k GROUP BY 2 ORDER BY 2 LIMIT " + str(ENTRIES) + "))",
        "c0 AS MATERIALIZED (SELECT p, e, x FROM p JOIN s USING (r))",
    ]
    best = "SELECT p.r, p.p, min(struct_pack(d := list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), e := c.e)) AS b FROM p JOIN {c} c ON p.p = c.p GROUP BY 1, 2"
    for n in range(ROUNDS):
        ctes += [
            f"a{n} AS MATERIALIZED ({best.format(c=f'c{n}')})",
            f"m{n} AS (SELECT p, e, list(m ORDER BY i) AS x FROM (SELECT p, e, i, CAST(floor(sum(y) / count(*)) AS BIGINT) AS m FROM (SELECT a.p, a.b.e AS e, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM a{n} a JOIN p USING (r, p)) GROUP BY 1, 2, 3) GROUP BY 1, 2)",
            f"c{n + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.x, c.x) AS x FROM c{n} c LEFT JOIN m{n} m USING (p, e))",
        ]
    ctes += [
        f"a AS ({best.format(c=f'c{ROUNDS}')})",
        "f AS MATERIALIZED (SELECT r, string_agg(lpad(lower(hex(b.e)), 2, '0'), '' ORDER BY p) AS code, CAST(sum(b.d) AS BIGINT) AS error FROM a GROUP BY 1)",
        f"h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{ROUNDS})",
    ]
    return "WITH " + ",\n".join(ctes) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM k JOIN f USING (r), h"


OP13_SQL = _sql()
