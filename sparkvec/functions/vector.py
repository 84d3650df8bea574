"""Distances, bounds and codes of vectors as column expressions.

Everything is summed in double. A null vector gives null; vectors of different lengths give null from the sums (a missing
element is null), so they never rank. Vectors of any numeric type are cast.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("euclidean", "cosine", "dot_product")


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def l2_squared(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(l2_squared(a, b))


def cosine(a: Column, b: Column) -> Column:
    """1 - cos; 1 if either vector has no length."""
    norms = dot(a, a) * dot(b, b)
    return F.when(norms == 0, F.lit(1.0)).otherwise(1.0 - dot(a, b) / F.sqrt(norms))


def distance(a: Column, b: Column, metric: str = "euclidean") -> Column:
    if metric == "euclidean":
        return l2(a, b)
    if metric == "cosine":
        return cosine(a, b)
    if metric == "dot_product":
        return -dot(a, b)
    raise ValueError(f"metric must be one of {METRICS}")


def score(d: Column, metric: str = "euclidean") -> Column:
    return -d if metric == "dot_product" else 1.0 / (1.0 + d)


def complex_l2(a: Column, b: Column) -> Column:
    """Distance of complex vectors stored as real and imaginary parts in turn: the same sum over all parts."""
    return l2(a, b)


def complex_dot_real(a: Column, b: Column) -> Column:
    """Real part of the sum of products: even places count plus, odd places minus."""
    part = F.zip_with(doubles(a), doubles(b), lambda x, y: x * y)
    return _sum(F.transform(part, lambda x, i: F.when(i % 2 == 0, x).otherwise(-x)))


def half(v: Column) -> Column:
    """The vector rounded to 16-bit floats."""

    @F.pandas_udf("array<float>")
    def rounded(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else np.asarray(x, np.float16).astype(np.float32))

    return rounded(v.cast("array<float>"))


#: fixed values: the bounds of the integer types
INTEGERS = {"int8": (-128, 127), "int16": (-32768, 32767), "int32": (-(2**31), 2**31 - 1), "int64": (-(2**63), 2**63 - 1), "uint8": (0, 255), "uint16": (0, 65535), "uint32": (0, 2**32 - 1)}


def integers(v: Column, kind: str = "int8") -> Column:
    """The vector's numbers without their fractions, held within the type's bounds; of Spark's narrowest type that has room."""
    lo, hi = INTEGERS[kind]
    spark_type = {"int8": "tinyint", "int16": "smallint", "uint8": "smallint", "int32": "int", "uint16": "int"}.get(kind, "bigint")
    held = lambda x: F.when(x >= F.lit(float(hi)), F.lit(hi)).when(x <= F.lit(float(lo)), F.lit(lo)).otherwise(F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)))
    return F.transform(doubles(v), lambda x: held(x).cast(spark_type))


def bounds(v: Column) -> Column:
    return F.struct(F.array_min(doubles(v)).alias("lo"), F.array_max(doubles(v)).alias("hi"))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two arrays of 64-bit words."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("bigint")), F.lit(0).cast("bigint"), lambda s, x: s + x)


def sub_vector(v: Column, part: int, size: int) -> Column:
    return F.slice(v, part * size + 1, size)
