"""Category masks over slots: a bitmap per category and bucket of slots, by Spark's bitmap aggregates.

A mask has a bit per slot, so the masks of a scope are far smaller than the category strings; they are combined by or and
and without a look at a paper, and counted without one too.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import SCOPE
from .filters import categories_of, embedded, narrow, pending

#: Bytes of a combined mask that go to every task; a larger one is joined by bucket.
MASK_BYTES = 64_000_000
_BUCKET_BYTES = 4_096


def bucket_of(slot: Column) -> Column:
    return F.bitmap_bucket_number(slot + 1)


def position_of(slot: Column) -> Column:
    return F.bitmap_bit_position(slot + 1)


def category_masks(papers: DataFrame, scope: Iterable[str] = SCOPE) -> DataFrame:
    """category, bucket, bits over the slots of the embedded papers. A paper counts in each of its categories of the scope;
    papers without a slot or category are in none. A bucket has 32,768 slots, so no aggregate grows beyond its bitmap."""
    each = embedded(papers).select("row", F.explode(F.array_distinct(categories_of(F.col("categories")))).alias("category"))
    known = each.where(F.col("category").isin(list(scope)))
    return known.groupBy("category", bucket_of(F.col("row")).alias("bucket")).agg(F.bitmap_construct_agg(position_of(F.col("row"))).alias("bits"))


def any_of(masks: DataFrame, categories: Iterable[str]) -> DataFrame:
    """bucket, bits of the slots with any of the categories."""
    return masks.where(F.col("category").isin(list(categories))).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def all_of(masks: DataFrame, categories: Iterable[str]) -> DataFrame:
    """bucket, bits of the slots with all of the categories: a bucket in which one of them has no mask has none."""
    wanted = sorted(set(categories))
    both = masks.where(F.col("category").isin(wanted)).groupBy("bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("n"))
    return both.where(F.col("n") == len(wanted)).select("bucket", "bits")


def count(mask: DataFrame) -> DataFrame:
    """One row: n, the slots in a mask."""
    return mask.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("n"))


def count_matching(papers: DataFrame, masks: DataFrame, categories: Iterable[str]) -> int:
    """The papers with any of the categories: those with a vector by the masks, and of the others those that match."""
    wanted = list(categories)
    return count(any_of(masks, wanted)).first()["n"] + narrow(pending(papers), wanted).count()


def _bit(bits: Column, position: Column) -> Column:
    """Whether the bit at a position is set: the lowest bit of a byte comes first."""
    byte = F.conv(F.hex(F.substring(bits, (position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (position % 8).cast("int")) == 1


def masked(rows: DataFrame, mask: DataFrame, slots: int) -> DataFrame:
    """rows(row, ...) whose slot is in the mask over so many slots. The mask goes to every task if it is small; a larger one
    meets the rows by bucket, of which no side holds many more rows than a bucket has slots."""
    own = mask.withColumnsRenamed({"bucket": "_bucket", "bits": "_bits"})
    small = -(-(slots + 1) // (8 * _BUCKET_BYTES)) * _BUCKET_BYTES <= MASK_BYTES
    met = rows.join(F.broadcast(own) if small else own, bucket_of(F.col("row")) == F.col("_bucket"))
    return met.where(_bit(F.col("_bits"), position_of(F.col("row")))).drop("_bucket", "_bits")
