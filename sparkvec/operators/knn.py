"""Exact nearest neighbours of given query vectors, in blocks.

The query side is read in blocks of at most ``BLOCK_BYTES`` of vectors (a documented bound; 64,000 queries of 64 dimensions), each of
which goes to every task with the code; a task keeps its k best for each query while its rows stream through, so what is shuffled
is tasks x queries x k triples, never rows x queries, and the rows are read once for each block. Within a task, rows and queries meet
in a matrix product; what it puts among a query's k best, up to its rounding, is measured again by differences in doubles. Filters belong
before the search: they are pushed down to the scan.

Results are ``(query_id, id, distance, score, rank)``, ordered by distance, then id. A null or differently sized vector isn't ranked.
Null ids are ranked like others. An empty side gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkvec.functions import vector as V

BLOCK_BYTES = 32 << 20
ROWS = 4096
QUERIES = 512
HELD = 1 << 20  # candidates that a task holds before it cuts them to the k best


class DimensionError(ValueError):
    pass


def check_k(k: int) -> None:
    if k < 1:
        raise ValueError("a search needs k of 1 or more")


def check_dimension(vectors: DataFrame, vector_col: str, dim: int) -> DataFrame:
    """``vectors`` with an error at run time for a row whose vector has another length."""
    ok = F.assert_true(F.coalesce(F.size(vector_col) == dim, F.lit(True)), F.lit(f"vector must have {dim} numbers"))
    return vectors.where(ok.isNull())


def _distances(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """Approximate (by a matrix product) for the choice of candidates; queries x rows."""
    p = q @ x.T
    if metric == "dot_product":
        return -p
    if metric == "cosine":
        n = np.sqrt((q * q).sum(1))[:, None] * np.sqrt((x * x).sum(1))
        return np.where(n == 0, 1.0, 1 - np.divide(p, n, out=np.zeros_like(p), where=n != 0))
    return (q * q).sum(1)[:, None] + (x * x).sum(1) - 2 * p


def _measured(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """Exact, for pairs of rows."""
    if metric == "euclidean":
        return np.sqrt(((x - q) ** 2).sum(-1))
    p = (x * q).sum(-1)
    if metric == "dot_product":
        return -p
    n = (x * x).sum(-1) * (q * q).sum(-1)
    return np.where(n == 0, 1.0, 1 - np.divide(p, np.sqrt(n), out=np.zeros_like(p), where=n != 0))


def blocks(queries: DataFrame) -> Iterator[list[Row]]:
    """The rows ``(q, v)`` in blocks of one length of v each, of at most ``BLOCK_BYTES``."""
    held: dict[int, list[Row]] = {}
    for r in queries.toLocalIterator():
        own = held.setdefault(len(r["v"]), [])
        own.append(r)
        if len(own) * 8 * max(1, len(r["v"])) >= BLOCK_BYTES:
            yield held.pop(len(r["v"]))
    yield from held.values()


class Best:
    """The k smallest values of each query, with their ids; ties go to the smaller id."""

    def __init__(self, queries: int, k: int):
        self.k, self.limit = k, np.full(queries, np.inf)
        self.parts: list[tuple[np.ndarray, pa.Array, np.ndarray]] = []
        self.held = 0

    def candidates(self, d: np.ndarray, first: int, slack: np.ndarray | float) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) places of ``d`` that may be among the best; ``slack`` is the rounding of ``d``."""
        limit = self.limit[first : first + len(d)]
        if d.shape[1] > self.k:
            limit = np.minimum(limit, np.partition(d, self.k - 1, axis=1)[:, self.k - 1])
        return np.nonzero((d <= (limit + slack)[:, None]) & (d < np.inf))

    def add(self, q: np.ndarray, ids: pa.Array, d: np.ndarray) -> None:
        self.parts.append((q, ids, d))
        self.held += len(q)
        if self.held > HELD:
            self.cut()

    def cut(self) -> None:
        if not self.parts:
            self.parts = [(np.zeros(0, np.int64), pa.array([], pa.int64()), np.zeros(0))]
        q, d = (np.concatenate([p[i] for p in self.parts]) for i in (0, 2))
        ids = pa.concat_arrays([p[1] for p in self.parts])
        order = np.lexsort((pc.rank(ids, "ascending", null_placement="at_start", tiebreaker="dense").to_numpy(), d, q))
        start = np.searchsorted(q[order], np.arange(len(self.limit)))
        place = np.arange(len(order)) - start[q[order]]
        kept = order[place < self.k]
        last = order[place == self.k - 1]
        self.limit[q[last]] = d[last]
        self.parts, self.held = [(q[kept], ids.take(pa.array(kept)), d[kept])], len(kept)

    def kept(self) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        self.cut()
        return self.parts[0]

    def batches(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            q, ids, d = self.kept()
            yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), ids, pa.array(d)], names=["n", "id", "distance"])


def ranked(found: DataFrame, block: list[Row], queries: DataFrame, k: int) -> DataFrame:
    """``(query_id, id, distance, rank)``: the best k of what the tasks found for a block."""
    top = found.withColumn("rank", F.row_number().over(W.partitionBy("n").orderBy("distance", "id")).cast("bigint")).where(F.col("rank") <= k)
    kind = next(f.dataType.simpleString() for f in queries.schema.fields if f.name == "query_id")
    names = top.sparkSession.createDataFrame([(i, r["q"]) for i, r in enumerate(block)], f"n int, query_id {kind}")
    return top.join(F.broadcast(names), "n").select("query_id", "id", "distance", "rank")  # one block's names


def batch(queries: DataFrame, vectors: DataFrame, k: int, metric: str = "euclidean", query_id: str = "query_id", query_vector: str = "vector", id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """The k nearest rows of ``vectors`` for every row of ``queries``."""
    check_k(k)
    if metric not in V.METRICS:
        raise ValueError(f"metric must be one of {V.METRICS}")
    asked = queries.select(F.col(query_id).alias("query_id"), V.doubles(F.col(query_vector)).alias("v")).where("v is not null")
    base = vectors.select(F.col(id_col).alias("id"), V.doubles(F.col(vector_col)).alias("v")).where("v is not null")
    id_type = dict(base.dtypes)["id"]
    out = None
    for block in blocks(asked.select(F.col("query_id").alias("q"), "v")):
        part = ranked(_near(block, base, k, metric, id_type), block, asked, k)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return vectors.sparkSession.createDataFrame([], f"query_id {dict(asked.dtypes)['query_id']}, id {id_type}, distance double, score double, rank bigint")
    return out.select("query_id", "id", "distance", V.score(F.col("distance"), metric).alias("score"), "rank")


def near(best: Best, q: np.ndarray, rows: Iterator[tuple[pa.Array, np.ndarray]], metric: str) -> Best:
    """``best`` after chunks ``(ids, vectors)`` of rows."""
    size = (q * q).sum(1)
    for ids, whole in rows:
        for a in range(0, len(whole), ROWS):
            x = whole[a : a + ROWS]
            high = float(np.nan_to_num((x * x).sum(1)).max(initial=0))
            for i in range(0, len(q), QUERIES):
                own = q[i : i + QUERIES]
                d = np.nan_to_num(_distances(x, own, metric), nan=np.inf)  # what isn't a number is nowhere near
                slack = np.full(len(own), 1e-9) if metric == "cosine" else 1e-9 * (size[i : i + QUERIES] + high + 1e-9)
                measured, best.limit = best.limit, best.limit**2 if metric == "euclidean" else best.limit  # the product gives squares
                r, c = best.candidates(d, i, slack)
                best.limit = measured
                best.add(i + r, ids.take(pa.array(a + c)), _measured(x[c], own[r], metric))
    return best


def _near(block: list[Row], base: DataFrame, k: int, metric: str, id_type: str) -> DataFrame:
    q = np.array([r["v"] for r in block], np.float64)
    dim = q.shape[1]

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
        for b in batches:
            v = b.column("v")
            keep = pa.array(np.flatnonzero(pc.list_value_length(v).to_numpy(zero_copy_only=False) == dim))
            yield b.column("id").take(keep), v.take(keep).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from near(Best(len(q), k), q, chunks(batches), metric).batches()

    return base.mapInArrow(search, f"n int, id {id_type}, distance double")


def single(vectors: DataFrame, query: list[float], k: int, metric: str = "euclidean", id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """``(id, distance, score)`` of one query by columns alone: partial and final top-k without a shuffle of rows."""
    check_k(k)
    q = F.array(*[F.lit(float(x)) for x in query])
    d = V.distance(F.col(vector_col), q, metric)
    rows = vectors.where(F.size(vector_col) == len(query)).select(F.col(id_col).alias("id"), d.alias("distance")).where("distance is not null")
    return rows.withColumn("score", V.score(F.col("distance"), metric)).orderBy("distance", "id").limit(k)


def filtered(vectors: DataFrame, condition: Column, queries: DataFrame, k: int, **how: str) -> DataFrame:
    """Nearest among the rows that meet a condition, which is applied before the search."""
    return batch(queries, vectors.where(condition), k, **how)


def within(vectors: DataFrame, ids: DataFrame, queries: DataFrame, k: int, id_col: str = "id", **how: str) -> DataFrame:
    """Nearest among the rows whose id is in ``ids`` (one column of that name)."""
    return batch(queries, vectors.join(ids.select(id_col).distinct(), id_col, "left_semi"), k, id_col=id_col, **how)


def by_id(vectors: DataFrame, ids: DataFrame, k: int, id_col: str = "id", vector_col: str = "vector", **how: str) -> DataFrame:
    """Nearest of the stored vectors with these ids; the item itself comes first. Unknown ids give no rows."""
    q = vectors.join(ids.select(id_col).distinct(), id_col, "left_semi").select(F.col(id_col).alias("query_id"), F.col(vector_col).alias("vector"))
    return batch(q, vectors, k, id_col=id_col, vector_col=vector_col, **how)


def with_vectors(results: DataFrame, vectors: DataFrame, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    return results.join(vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")), "id")


def merged(k: int, *lists: DataFrame, by: str = "distance", descending: bool = False) -> DataFrame:
    """The best k of several result lists ``(query_id, id, <by>)``; an id in several lists keeps its best entry."""
    rows = lists[0].select("query_id", "id", by)
    for other in lists[1:]:
        rows = rows.unionByName(other.select("query_id", "id", by))
    best = rows.groupBy("query_id", "id").agg((F.max if descending else F.min)(by).alias(by))
    w = W.partitionBy("query_id").orderBy(F.desc(by) if descending else F.asc(by), "id")
    return best.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """``(query_id, recall)``: the share of the exact neighbours that were found."""
    hit = exact.select("query_id", "id").join(found.select("query_id", "id").withColumn("hit", F.lit(1)), ["query_id", "id"], "left")
    return hit.groupBy("query_id").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
