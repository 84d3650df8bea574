"""Approximate search by cells: k-means centroids, an inverted list for each, the nearest lists probed.

Centroids are fitted on a bounded sample (a parameter); every row is indexed. The index is a table partitioned by cell, kept with its
centroids and counts in a folder and opened again from there. Every query goes to its own nearest cells only; a cell of more than
``PART_ROWS`` rows is searched in parts by a hash of the id, so a hot cell is no hot task. Queries with fewer than k results are asked
again with twice the cells. Nothing about queries or rows is collected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from sparkvec.functions import vector as V
from sparkvec.operators import knn
from sparkvec.operators.quantize import k_means
from sparkvec.session import cut

EXACT_BELOW = 1_000
PART_ROWS = 100_000


@dataclass(frozen=True)
class Ivf:
    centroids: np.ndarray
    rows: np.ndarray
    path: str
    id_col: str
    vector_col: str


def build(df: DataFrame, path: str, cells: int, id_col: str = "id", vector_col: str = "vector", sample: int = 50_000, seed: int = 0) -> Ivf:
    """Fit, assign every row to its cell, write lists and centroids to ``path``. Rows without a vector aren't indexed."""
    v = V.doubles(F.col(vector_col))
    rows = df.where(F.col(vector_col).isNotNull()).orderBy(F.xxhash64(id_col)).limit(sample).select(v.alias("v")).collect()
    c = k_means(np.array([r["v"] for r in rows]), cells, seed=seed) if rows else np.zeros((0, 1))

    @F.pandas_udf("int")
    def cell(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in it:
            x = np.array(s.tolist(), float)
            yield pd.Series(((c * c).sum(1) - 2 * x @ c.T).argmin(1) if len(x) else [], dtype="int32")

    df.where(F.col(vector_col).isNotNull()).withColumn("_cell", cell(v)).write.mode("overwrite").partitionBy("_cell").parquet(f"{path}/rows")
    spark = df.sparkSession
    counts = dict(spark.read.parquet(f"{path}/rows").groupBy("_cell").count().collect()) if len(c) else {}  # one row a cell
    saved = [(i, x.tolist(), int(counts.get(i, 0)), id_col, vector_col) for i, x in enumerate(c)]
    spark.createDataFrame(saved, "cell int, centroid array<double>, rows bigint, id_col string, vector_col string").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
    return opened(spark, path)


def opened(spark: SparkSession, path: str) -> Ivf:
    """An index that :func:`build` wrote."""
    r = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()  # one row a cell
    return Ivf(np.array([x["centroid"] for x in r]), np.array([x["rows"] for x in r], np.int64), path, r[0]["id_col"] if r else "id", r[0]["vector_col"] if r else "vector")


def search(spark: SparkSession, index: Ivf, queries: DataFrame, k: int, probes: int = 8, metric: str = "euclidean", condition: str | None = None) -> DataFrame:
    """The k nearest of the probed cells for every row of ``queries (query_id, vector)``."""
    knn.check_k(k)
    c, dim = index.centroids, index.centroids.shape[1]
    parts = np.maximum(1, -(-index.rows // PART_ROWS))
    table = spark.read.parquet(f"{index.path}/rows")
    if condition:
        table = table.where(condition)
    id_type, q_type = dict(table.dtypes)[index.id_col], dict(queries.dtypes)["query_id"]
    spread = F.element_at(F.lit([int(n) for n in parts]), F.col("_cell") + 1)
    rows = table.select("_cell", F.pmod(F.xxhash64(index.id_col), spread).alias("_part"), F.col(index.id_col).alias("id"), V.doubles(F.col(index.vector_col)).alias("v"))
    open_ = cut(queries.select("query_id", V.doubles(F.col("vector")).alias("v")).where(F.size("v") == dim))

    def asked(n: int):  # noqa: ANN202
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                q = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                if len(q):
                    near = np.argsort(((c * c).sum(1) - 2 * q @ c.T), 1, kind="stable")[:, :n]
                    times = parts[near].sum(1)
                    cells = np.repeat(near.ravel(), parts[near].ravel())
                    own = np.concatenate([np.arange(m) for m in parts[near].ravel()])
                    at = pa.array(np.repeat(np.arange(len(q)), times))
                    yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(own), b.column("query_id").take(at), b.column("v").take(at)], names=["_cell", "_part", "query_id", "v"])

        return run

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "id", "distance"]
        if not len(left) or not len(right):
            return pa.table([left.column("query_id").slice(0, 0), right.column("id").slice(0, 0), pa.array([], pa.float64())], names=names)
        q = left.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        ids, x = right.column("id").combine_chunks(), right.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        best = knn.near(knn.Best(len(q), k), q, [(ids, x)], metric)
        qi, near, d = best.kept()
        return pa.table([left.column("query_id").combine_chunks().take(pa.array(qi)), near, pa.array(d)], names=names)

    out, n = None, min(probes, len(c))
    while True:
        probed = open_.mapInArrow(asked(n), f"_cell int, _part bigint, query_id {q_type}, v array<double>")
        hits = probed.groupBy("_cell", "_part").cogroup(rows.where(F.size("v") == dim).groupBy("_cell", "_part")).applyInArrow(compare, f"query_id {q_type}, id {id_type}, distance double")
        top = hits.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("distance", "id")).cast("bigint")).where(F.col("rank") <= k)
        top = cut(top.select("query_id", "id", "distance", V.score(F.col("distance"), metric).alias("score"), "rank"))
        full = top.where(F.col("rank") == k).select("query_id")
        done = n >= len(c)
        out = (top if done else top.join(full, "query_id", "left_semi")) if out is None else out.unionByName(top if done else top.join(full, "query_id", "left_semi"))
        if done:
            return out
        open_ = cut(open_.join(full, "query_id", "left_anti"))
        if open_.isEmpty():
            return out
        n = min(2 * n, len(c))


def adaptive(spark: SparkSession, df: DataFrame, queries: DataFrame, k: int, path: str, cells: int = 64, **how: object) -> DataFrame:
    """Exact below ``EXACT_BELOW`` rows; above by the index at ``path``, which is built once if there is none."""
    if df.limit(EXACT_BELOW).count() < EXACT_BELOW:
        return knn.batch(queries, df, k)
    try:
        index = opened(spark, path)
    except AnalysisException:
        index = build(df, path, cells)
    return search(spark, index, queries, k, **how)
