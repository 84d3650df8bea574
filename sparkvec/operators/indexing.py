"""Sets of row ids: bitmaps, inverted indexes, Bloom filters.

A bitmap is a table ``(bucket, bits)`` of 32,768 bits per row, built by a map-side combined aggregate. Ids are non-negative.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE = 32_768


def bitmap(df: DataFrame, id_col: str = "id") -> DataFrame:
    i = F.col(id_col) + 1
    return df.where(F.col(id_col) >= 0).groupBy(F.bitmap_bucket_number(i).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(i)).alias("bits"))


def count(bits: DataFrame) -> DataFrame:
    return bits.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("n"))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    both = a.join(b.select("bucket"), "bucket", "left_semi").unionByName(b.join(a.select("bucket"), "bucket", "left_semi"))
    return both.groupBy("bucket").agg(F.bitmap_and_agg("bits").alias("bits"))


def of(spark: SparkSession, *numbers: int) -> DataFrame:
    """The bitmap of some ids."""
    return bitmap(spark.createDataFrame([(int(n),) for n in numbers], "id bigint"))


def added(bits: DataFrame, more: DataFrame) -> DataFrame:
    """With the ids of ``more (id)`` set."""
    return union(bits, bitmap(more))


def removed(bits: DataFrame, less: DataFrame) -> DataFrame:
    """With the ids of ``less`` (a bitmap) cleared: only pages that hold some of them are taken apart."""
    there = bits.join(less.select("bucket"), "bucket", "left_semi")
    rest = bitmap(ids(there).join(ids(less), "id", "left_anti"))
    return bits.join(less.select("bucket"), "bucket", "left_anti").unionByName(rest)


def between(bits: DataFrame, first: int, last: int) -> DataFrame:
    """The ids from ``first`` up to ``last``; pages outside are never read."""
    pages = bits.where((F.col("bucket") > first // PAGE) & (F.col("bucket") <= last // PAGE + 1))
    return ids(pages).where((F.col("id") >= first) & (F.col("id") <= last))


def contains(rows: DataFrame, bits: DataFrame, id_col: str = "id") -> DataFrame:
    """The rows whose id is set."""
    at, byte = F.col(id_col) % PAGE, F.conv(F.substring(F.hex("bits"), (F.floor(F.col(id_col) % PAGE / 8) * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("bigint")
    hit = rows.where(F.col(id_col) >= 0).withColumn("bucket", F.bitmap_bucket_number(F.col(id_col) + 1)).join(bits, "bucket")
    return hit.where(F.floor(byte / F.pow(F.lit(2), at % 8)) % 2 == 1).select(*rows.columns)


def ids(bits: DataFrame) -> DataFrame:
    """The ids of a bitmap, one row each."""
    hexed = F.hex("bits")
    byte = bits.select("bucket", F.posexplode(F.sequence(F.lit(0), F.lit(PAGE // 8 - 1))).alias("p", "_s"), hexed.alias("h")).select("bucket", "p", F.conv(F.substring(F.col("h"), F.col("p") * 2 + 1, F.lit(2)), 16, 10).cast("int").alias("b")).where("b > 0")
    bit = byte.select("bucket", "p", "b", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("i")).where(F.expr("(shiftright(b, i) & 1) = 1"))
    return bit.select(((F.col("bucket") - 1) * PAGE + F.col("p") * 8 + F.col("i")).cast("bigint").alias("id"))


def inverted(df: DataFrame, id_col: str, *columns: str) -> DataFrame:
    """``(field, value, bucket, bits)``: for each value of each column the bitmap of its rows; null values aren't indexed."""
    cells = df.select(F.col(id_col).alias("id"), F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select("id", "x.*").where("value is not null and id >= 0")
    i = F.col("id") + 1
    return cells.groupBy("field", "value", F.bitmap_bucket_number(i).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(i)).alias("bits"))


def lookup(index: DataFrame, criteria: dict[str, str]) -> DataFrame:
    """The bitmap of the rows that meet all equalities; an unknown field or value gives none."""
    out = None
    for f, v in criteria.items():
        one = index.where((F.col("field") == f) & (F.col("value") == v)).select("bucket", "bits")
        out = one if out is None else intersection(out, one)
    return out


def unindexed(index: DataFrame, gone: DataFrame) -> DataFrame:
    """An inverted index without the ids of ``gone (id)``."""
    less = bitmap(gone).select("bucket", F.col("bits").alias("_less"))
    keys = ["field", "value", "bucket"]
    hit = index.join(less.select("bucket"), "bucket", "left_semi")
    page = hit.select(*keys, F.posexplode(F.sequence(F.lit(0), F.lit(PAGE // 8 - 1))).alias("p", "_s"), F.hex("bits").alias("h")).select(*keys, "p", F.conv(F.substring(F.col("h"), F.col("p") * 2 + 1, F.lit(2)), 16, 10).cast("int").alias("b")).where("b > 0")
    bit = page.select(*keys, "p", "b", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("i")).where(F.expr("(shiftright(b, i) & 1) = 1")).select(*keys, ((F.col("bucket") - 1) * PAGE + F.col("p") * 8 + F.col("i")).cast("bigint").alias("id"))
    rest = bit.join(gone.select("id").distinct(), "id", "left_anti").groupBy(*keys).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("id") + 1)).alias("bits"))
    return index.join(less.select("bucket"), "bucket", "left_anti").unionByName(rest)


def index_stats(index: DataFrame) -> DataFrame:
    """``(field, values, entries)`` of an inverted index."""
    return index.groupBy("field").agg(F.count_distinct("value").alias("values"), F.sum(F.bitmap_count("bits")).alias("entries"))


def bloom(df: DataFrame, key: str, bits: int = 1 << 20, hashes: int = 4) -> DataFrame:
    """A Bloom filter of the column as a bitmap of ``bits`` bits; its size is the parameter, whatever the rows."""
    at = df.where(F.col(key).isNotNull()).select(F.explode(places(F.col(key), bits, hashes)).alias("id")).distinct()
    return bitmap(at)


def places(c: Column, bits: int, hashes: int) -> Column:
    a, b = F.xxhash64(c), F.xxhash64(c, F.lit(1)).bitwiseOR(F.lit(1))
    return F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: F.pmod(a % bits + i * (b % bits), F.lit(bits)))


def may_contain(df: DataFrame, key: str, filter_: DataFrame, bits: int = 1 << 20, hashes: int = 4) -> DataFrame:
    """The rows of ``df`` whose key may be in the filter; the filter (at most ``bits`` / 8 bytes) is broadcast."""
    whole = filter_.agg(F.map_from_entries(F.collect_list(F.struct("bucket", F.hex("bits").alias("h")))).alias("pages")).scalar()

    def is_set(p: Column) -> Column:
        at = p % PAGE
        page = F.element_at(F.col("_pages"), F.floor(p / PAGE) + 1)
        byte = F.conv(F.substring(page, (F.floor(at / 8) * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")
        return F.coalesce(F.floor(byte / F.pow(F.lit(2), at % 8)) % 2 == 1, F.lit(False))

    return df.where(F.col(key).isNotNull()).withColumn("_pages", whole).where(F.forall(places(F.col(key), bits, hashes), is_set)).drop("_pages")
