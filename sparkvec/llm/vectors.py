"""Usable vectors: one row for each id, as the newest of its usable rows has it.

A row is usable if its id isn't null and its vector has ``dim`` finite numbers. Of equal ``ts`` (a null one is the oldest) the
greatest vector holds. Only ids that may have several rows are shuffled with their vectors: they are told by a bitmap of fixed
size (``BITS`` bits, so at most 1 MB is broadcast) over the hashes of the ids that do; where the bitmap fills up, more rows
are shuffled, with the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIM = 48
BITS = 1 << 23
PAGE = 32768  # bits of one value of bitmap_construct_agg


def is_usable(vector: Column, dim: int = DIM) -> Column:
    # NULL, not false, if it isn't found among nulls; unlike a lambda it's compiled
    none = [~F.array_contains(vector, F.lit(float(x)).cast("float")) for x in ("nan", "inf", "-inf")]
    return F.coalesce((F.size(vector) == dim) & none[0] & none[1] & none[2], F.lit(False))


def marks(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``rows`` with ``marked``: true for every row whose id is among ``ids``, and by chance for a few others.

    What is broadcast is a bitmap of ``BITS`` bits over the ids' hashes, whatever their number.
    """
    place = F.pmod(F.xxhash64("id"), F.lit(BITS))
    pages = ids.select(place.alias("p")).groupBy(F.bitmap_bucket_number(F.col("p") + 1).alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("p") + 1)).alias("bits"))
    at = F.bitmap_bit_position(place + 1)
    byte = F.conv(F.hex(F.substring(F.col("bits"), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    out = rows.withColumn("page", F.bitmap_bucket_number(place + 1)).join(F.broadcast(pages), "page", "left").withColumn("byte", byte).withColumn("bit", (at % 8).cast("int"))
    return out.withColumn("marked", F.coalesce(F.expr("shiftright(byte, bit) & 1") == 1, F.lit(False))).drop("page", "bits", "byte", "bit")


def having(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose id is among ``ids (id)``; most others are left out before anything is shuffled."""
    return marks(rows, ids).where("marked").drop("marked").join(ids.select("id").distinct(), "id", "left_semi")


def newest(df: DataFrame, dim: int = DIM) -> DataFrame:
    """``(id, vector)``, one row for each usable id."""
    rows = df.select("id", "ts", "vector").where(F.col("id").isNotNull() & (F.size("vector") == dim))
    repeated = df.where(F.col("id").isNotNull()).groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    marked = marks(rows, repeated).withColumnRenamed("marked", "several")
    once = marked.where("not several").where(is_usable(F.col("vector"), dim)).select("id", "vector")
    several = marked.where("several").where(is_usable(F.col("vector"), dim)).groupBy("id").agg(F.max(F.struct("ts", "vector"))["vector"].alias("vector"))
    return once.unionByName(several)
