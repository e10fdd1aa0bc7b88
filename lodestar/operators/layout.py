"""Tables in parts by the hash of the id: what is touched is rewritten, the files of the other parts stay.

A table in parts is a mapping from part number to the folder that holds the part; a part without rows has none. The
number of parts is a power of two that doubles with the rows, so the rewriting that this takes adds up to a few copies
of the table however long it grows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a part, on the average, beyond which the number of parts doubles.
PART_ROWS = 250_000


def part_of(parts: int, id_: str = "id") -> Column:
    """The part that an id belongs to."""
    return F.pmod(F.xxhash64(id_), F.lit(parts)).cast("int")


def parts_for(rows: int, now: int, part_rows: int = PART_ROWS) -> int:
    """The number of parts for so many rows: never fewer than now."""
    while rows > now * part_rows:
        now *= 2
    return now


def touched(ids: DataFrame, parts: int) -> list[int]:
    """The parts that the rows of ids(id) fall in: at most `parts` numbers."""
    return sorted(r[0] for r in ids.select(part_of(parts).alias("part")).distinct().collect())


def dealt(df: DataFrame, parts: int, of: Iterable[int] | None = None) -> DataFrame:
    """df(id, ...) with its part, each of the parts `of` (all if None) in one task: what write_parts moves no more, and
    what needs no exchange by part and id."""
    n = parts if of is None else max(len(set(of)), 1)
    return df.withColumn("part", part_of(parts)).repartition(n, "part")


def write_parts(df: DataFrame, folder: str, parts: int, of: Iterable[int] | None = None, sort: str | None = None) -> dict[str, str]:
    """Writes df(id, ...), all of whose rows fall in the parts `of` (all parts if None), into a new folder, a file or more
    for each part; returns the parts that have rows. sort: the order inside a file, for readers that skip by bounds. What
    has a column part already is dealt."""
    path = f"{folder}/v={uuid.uuid4().hex}"
    rows = df if "part" in df.columns else dealt(df, parts, of)
    if sort:
        rows = rows.sortWithinPartitions("part", sort)
    rows.write.partitionBy("part").parquet(path)
    spark = df.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)
    names = [x.getPath().getName() for x in found]
    return {n.removeprefix("part="): f"{path}/{n}" for n in names if n.startswith("part=")}


def read_parts(spark: SparkSession, table: dict[str, str], schema: T.StructType, of: Iterable[int] | None = None) -> DataFrame:
    """The rows of a table in parts, or of some of its parts."""
    wanted = None if of is None else {str(p) for p in of}
    paths = [path for part, path in sorted(table.items()) if wanted is None or part in wanted]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema).where(F.lit(False))  # known to be empty, so joins go
