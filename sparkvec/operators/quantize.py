"""Scalar, binary and product quantization of vectors.

Codes are made by column expressions or in Arrow batches. Bounds (two numbers a dimension) are passed as literals, codebooks (M x 256
centroids) go with the functions that use them. Null vectors stay null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkvec.functions import vector as V
from sparkvec.operators import knn

WORD = 64


# ---------------------------------------------------------------- 8-bit scalars
def sq8_train(df: DataFrame, vector_col: str) -> DataFrame:
    """``(dim, lo, hi)`` of each dimension (from 0); a flat one is widened by 1e-7."""
    x = df.select(F.posexplode(V.doubles(F.col(vector_col))).alias("dim", "x"))
    t = x.groupBy("dim").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    return t.withColumn("hi", F.when(F.col("hi") == F.col("lo"), F.col("lo") + 1e-7).otherwise(F.col("hi")))


def sq8_bounds(df: DataFrame, vector_col: str) -> tuple[list[float], list[float]]:
    """The model for the functions below: as many numbers as a vector has dimensions."""
    rows = sorted(sq8_train(df, vector_col).collect())
    return [r["lo"] for r in rows], [r["hi"] for r in rows]


def sq8_global(df: DataFrame, vector_col: str) -> DataFrame:
    """``(lo, hi)`` over all dimensions, as an index with one scale uses."""
    v = V.doubles(F.col(vector_col))
    return df.agg(F.min(F.array_min(v)).alias("lo"), F.max(F.array_max(v)).alias("hi"))


def _lit(values: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def sq8_encode(v: Column, lo: list[float], hi: list[float]) -> Column:
    span = F.arrays_zip(V.doubles(v).alias("v"), _lit(lo).alias("lo"), _lit(hi).alias("hi"))
    return F.transform(span, lambda s: F.floor((F.least(F.greatest(s["v"], s["lo"]), s["hi"]) - s["lo"]) * 255.0 / (s["hi"] - s["lo"])).cast("int"))


def sq8_decode(codes: Column, lo: list[float], hi: list[float]) -> Column:
    span = F.arrays_zip(codes.alias("c"), _lit(lo).alias("lo"), _lit(hi).alias("hi"))
    return F.transform(span, lambda s: s["lo"] + s["c"] * (s["hi"] - s["lo"]) / 255.0)


def sq8_code_l2(a: Column, b: Column) -> Column:
    """Squared distance of raw codes."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y).cast("bigint") * (x - y).cast("bigint")), F.lit(0).cast("bigint"), lambda s, x: s + x)


def sq8_code_cosine(a: Column, b: Column) -> Column:
    """Cosine distance of raw codes."""
    return V.cosine(a, b)


def sq8_encode_scale(v: Column, lo: float, hi: float) -> Column:
    """Codes under one scale for all dimensions, as of :func:`sq8_global`; values outside are held at its ends."""
    span = hi - lo if hi > lo else 1e-7
    return F.transform(V.doubles(v), lambda x: F.floor((F.least(F.greatest(x, F.lit(lo)), F.lit(hi)) - lo) * 255.0 / span).cast("int"))


def sq8_decode_scale(codes: Column, lo: float, hi: float) -> Column:
    return F.transform(codes, lambda c: lo + c * (hi - lo) / 255.0)


# ---------------------------------------------------------------- plain conversions
def as_bytes(v: Column) -> Column:
    """Numbers without their fractions, held within 0 and 255."""
    return V.integers(v, "uint8")


def as_signs(v: Column) -> Column:
    """One word: bit i says whether the i-th of the first 64 numbers is above 0."""
    return bq_encode(F.when(F.size(v) >= WORD, v).otherwise(F.concat(V.doubles(v), F.array_repeat(F.lit(0.0), WORD - F.size(v)))), WORD)


# ---------------------------------------------------------------- bits
def bq_encode(v: Column, dim: int) -> Column:
    """Words of 64 bits; bit i of a word says whether its number is above 0."""
    words = []
    for w in range(-(-dim // WORD)):
        part = F.transform(F.slice(V.doubles(v), w * WORD + 1, WORD), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint")))
        words.append(F.aggregate(part, F.lit(0).cast("bigint"), lambda s, x: s.bitwiseOR(x)))
    return F.when(F.size(v) >= dim, F.array(*words))


def bq_decode(code: Column, dim: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.when(F.call_function("shiftright", F.get(code, F.floor(i / WORD).cast("int")), (i % WORD).cast("int")).bitwiseAND(F.lit(1)) == 1, 1.0).otherwise(-1.0))


def bq_similarity(a: Column, b: Column, dim: int) -> Column:
    return 1.0 - V.hamming(a, b) / float(dim)


def bq_search(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """``(query_id, id, hamming, rank)``: the k rows ``(id, code)`` with the fewest differing bits for each of ``(query_id, code)``.

    Queries go to the rows' tasks in blocks; every task keeps its own k best for each query.
    """
    parts = []
    for block in knn.blocks(queries.select(F.col("query_id").alias("q"), F.col("code").alias("v")).where("code is not null")):
        q = np.array([r["v"] for r in block], np.int64).view(np.uint64)

        def search(batches: Iterator[pa.RecordBatch], q: np.ndarray = q) -> Iterator[pa.RecordBatch]:
            best = knn.Best(len(q), k)
            for b in batches:
                code = b.column("code")
                keep = np.flatnonzero(np.asarray(pc.list_value_length(code).fill_null(0)) == q.shape[1])
                for a in range(0, len(keep), knn.ROWS):
                    at = pa.array(keep[a : a + knn.ROWS])
                    x = code.take(at).flatten().to_numpy().view(np.uint64).reshape(-1, q.shape[1])
                    for i in range(0, len(q), knn.QUERIES):
                        d = np.bitwise_count(q[i : i + knn.QUERIES, None, :] ^ x[None]).sum(2, dtype=np.int64).astype(float)
                        r, c = best.candidates(d, i, 0.0)
                        best.add(i + r, b.column("id").take(at).take(pa.array(c)), d[r, c])
            yield from best.batches()

        parts.append(knn.ranked(rows.select("id", "code").mapInArrow(search, f"n int, id {dict(rows.dtypes)['id']}, distance double"), block, queries, k))
    if not parts:
        return queries.sparkSession.createDataFrame([], f"query_id {dict(queries.dtypes)['query_id']}, id {dict(rows.dtypes)['id']}, hamming bigint, rank bigint")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("query_id", "id", F.col("distance").cast("bigint").alias("hamming"), "rank")


# ---------------------------------------------------------------- products
def default_parts(dim: int) -> int:
    return dim // 8 if dim % 8 == 0 else dim // 4 if dim % 4 == 0 else 1


def k_means(x: np.ndarray, k: int, iterations: int = 20, seed: int = 0) -> np.ndarray:
    """Centroids; stops when fewer than 0.1 % of the rows move; an empty centroid is put on the row farthest from its own."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    label = np.full(len(x), -1)
    for _ in range(iterations):
        d = (x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * x @ c.T
        new = d.argmin(1)
        moved = int((new != label).sum())
        label = new
        for j in range(len(c)):
            own = label == j
            if own.any():
                c[j] = x[own].mean(0)
            else:
                far = int(d[np.arange(len(x)), label].argmax())
                c[j], label[far] = x[far], j
        if moved < 0.001 * len(x):
            break
    return c


def pq_train(df: DataFrame, vector_col: str, parts: int | None = None, k: int = 256, sample: int = 20_000, seed: int = 0) -> np.ndarray:
    """Codebook (parts, k, dim / parts), learned on at most ``sample`` vectors: those with the smallest hashes."""
    v = V.doubles(F.col(vector_col))
    rows = df.select(v.alias("v")).where("v is not null").orderBy(F.xxhash64("v")).limit(sample).collect()
    x = np.array([r["v"] for r in rows])
    m = parts or default_parts(x.shape[1])
    if x.shape[1] % m:
        raise ValueError("the dimensions must be divisible by the parts")
    if len(x) < k:
        raise ValueError(f"at least {k} vectors are needed")
    size = x.shape[1] // m
    return np.stack([k_means(x[:, i * size : (i + 1) * size], k, seed=seed + i) for i in range(m)])


def pq_encode(df: DataFrame, vector_col: str, book: np.ndarray, out: str = "code") -> DataFrame:
    """``df`` with the number of the nearest centroid of each part."""
    m, _, size = book.shape
    square = (book * book).sum(2)

    @F.pandas_udf("array<int>")
    def encode(s: pd.Series) -> pd.Series:
        keep = s.map(lambda v: v is not None and len(v) == m * size)
        x = np.array(s[keep].tolist(), float).reshape(-1, m, size)
        code = np.stack([(square[i] - 2 * x[:, i] @ book[i].T).argmin(1) for i in range(m)], 1) if len(x) else np.zeros((0, m), int)
        r = pd.Series([None] * len(s), index=s.index, dtype=object)
        r[keep] = pd.Series(list(code.astype(np.int32)), index=s.index[keep], dtype=object)
        return r

    return df.withColumn(out, encode(V.doubles(F.col(vector_col))))


def pq_decode(code: Column, book: np.ndarray) -> Column:
    @F.pandas_udf("array<double>")
    def decode(s: pd.Series) -> pd.Series:
        keep = s.map(lambda c: c is not None)
        c = np.array(s[keep].tolist(), int).reshape(-1, len(book))
        r = pd.Series([None] * len(s), index=s.index, dtype=object)
        r[keep] = pd.Series(list(book[np.arange(len(book)), c].reshape(len(c), -1)), index=s.index[keep], dtype=object)
        return r

    return decode(code)


def save_book(spark: SparkSession, book: np.ndarray, path: str) -> None:
    rows = [(i, j, c) for i, part in enumerate(book.tolist()) for j, c in enumerate(part)]
    spark.createDataFrame(rows, "part int, code int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(path)


def load_book(spark: SparkSession, path: str) -> np.ndarray:
    rows = spark.read.parquet(path).orderBy("part", "code").collect()  # parts x 256 centroids
    m = max(r["part"] for r in rows) + 1
    return np.array([r["centroid"] for r in rows]).reshape(m, len(rows) // m, -1)


def adc_table(query: list[float], book: np.ndarray) -> np.ndarray:
    """(parts, k) squared distances of the query's parts to the centroids."""
    m, _, size = book.shape
    q = np.asarray(query, float).reshape(m, 1, size)
    return ((book - q) ** 2).sum(2)


def adc_distance(code: Column, table: np.ndarray) -> Column:
    """Root of the sum of the table's entries that the code names."""

    @F.pandas_udf("double")
    def measured(s: pd.Series) -> pd.Series:
        keep = s.map(lambda c: c is not None)
        c = np.array(s[keep].tolist(), int).reshape(-1, len(table))
        r = pd.Series(np.full(len(s), np.nan), index=s.index, dtype="Float64")
        r[:] = None
        r[keep] = np.sqrt(table[np.arange(len(table)), c].sum(1))
        return r

    return measured(code)
