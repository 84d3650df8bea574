"""Numbering and running sums within groups of any size, without gathering a group in one task.

Rows of a group are spread over ranges of a hash; ranges are summed, the sums of a group's ranges are accumulated (one small
row per range), and only rows of one range meet in a window.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RANGE_ROWS = 100_000


def running(df: DataFrame, keys: list[str], amount: Column, order: list[str], rows: int, name: str = "before") -> DataFrame:
    """``df`` with ``name``: the sum of ``amount`` over the rows before it in its group, in the order of a hash of ``order``.

    ``order`` must tell the rows of a group apart for a repeatable result; ``rows`` is a rough number of all rows. Null keys
    form a group of their own.
    """
    parts = max(1, math.ceil(rows / RANGE_ROWS))
    h = F.xxhash64(*order)
    spread = df.withColumn("_h", h).withColumn("_part", F.floor((F.col("_h").cast("double") / 2.0**64 + 0.5) * parts)).withColumn("_amount", amount)
    sums = spread.groupBy(*keys, "_part").agg(F.sum("_amount").alias("_sum"))
    carry = sums.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), F.coalesce(F.sum("_sum").over(W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_carry"))
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col("_part") == F.col("_p")]
    within = F.coalesce(F.sum("_amount").over(W.partitionBy(*keys, "_part").orderBy("_h", *order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    out = spread.join(carry, on).withColumn(name, (within + F.col("_carry")).cast("bigint"))
    return out.drop("_h", "_part", "_amount", "_p", "_carry", *[f"_k{i}" for i in range(len(keys))])
