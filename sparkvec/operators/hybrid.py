"""Fusing dense and keyword results, and hybrid search.

Lists are ``(query_id, id, score)`` with larger scores better. All fusions work on every query at once; ties are ordered by id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkvec.operators import graph, knn, text_search

#: fixed value: the constant of reciprocal rank fusion
RRF_K = 60


def by_query(order: Column) -> W:
    return W.partitionBy("query_id").orderBy(order, "id")


def cut(scored: DataFrame, k: int) -> DataFrame:
    return scored.withColumn("rank", F.row_number().over(by_query(F.desc("score"))).cast("bigint")).where(F.col("rank") <= k)


def rrf(k: int, *lists: DataFrame, constant: int = RRF_K) -> DataFrame:
    """The sum over lists of ``1 / (constant + rank)``, ranks from 1."""
    c = constant if constant > 0 else RRF_K
    parts = [x.select("query_id", "id", (1.0 / (c + F.row_number().over(by_query(F.desc("score"))))).alias("part")) for x in lists]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return cut(rows.groupBy("query_id", "id").agg(F.sum("part").alias("score")), k)


def linear(k: int, dense: DataFrame, sparse: DataFrame, alpha: float) -> DataFrame:
    """``alpha * dense + (1 - alpha) * sparse``, each divided by its query's maximum (1e-4 at least)."""
    if not 0 <= alpha <= 1:
        raise ValueError("alpha must be within 0 and 1")
    scaled = lambda x, w: x.select("query_id", "id", (w * F.col("score") / F.greatest(F.max("score").over(W.partitionBy("query_id")), F.lit(1e-4))).alias("part"))
    rows = scaled(dense, alpha).unionByName(scaled(sparse, 1 - alpha))
    return cut(rows.groupBy("query_id", "id").agg(F.sum("part").alias("score")), k)


def cascade(k: int, sparse: DataFrame, dense: DataFrame, keep: DataFrame | None = None) -> DataFrame:
    """First the keyword results, then the dense ones not among them, all within ``keep`` (a column ``id``) if given; the first k in
    that order, then ordered by score. An empty ``keep`` gives no rows."""
    inside = (lambda x: x) if keep is None else (lambda x: x.join(keep.select("id").distinct(), "id", "left_semi"))
    a = inside(sparse).select("query_id", "id", "score", F.lit(0).alias("stage"))
    b = inside(dense).join(sparse.select("query_id", "id"), ["query_id", "id"], "left_anti").select("query_id", "id", "score", F.lit(1).alias("stage"))
    place = F.row_number().over(W.partitionBy("query_id").orderBy("stage", F.desc("score"), "id"))
    return cut(a.unionByName(b).withColumn("place", place).where(F.col("place") <= k).drop("place", "stage"), k)


def best_of(*lists: DataFrame) -> DataFrame:
    """Each id once with its greatest score."""
    rows = lists[0].select("query_id", "id", "score")
    for x in lists[1:]:
        rows = rows.unionByName(x.select("query_id", "id", "score"))
    return rows.groupBy("query_id", "id").agg(F.max("score").alias("score"))


def auto_alpha(tokens: Column) -> Column:
    """By the number of the text's pieces between white space (fixed values): fewer than 3 -> 0.3, up to 5 -> 0.5, more -> 0.8."""
    return F.when(tokens < 3, 0.3).when(tokens <= 5, 0.5).otherwise(0.8)


def auto_alpha_of(text: str) -> float:
    n = len(text.split())
    return 0.3 if n < 3 else 0.5 if n <= 5 else 0.8


def reranked(results: DataFrame, score: Callable[[pd.DataFrame], pd.Series], columns: list[str]) -> DataFrame:
    """Results with the scores that a function gives to batches of rows (``columns``, with query_id and id)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[["query_id", "id"]].assign(score=score(b).astype(float))

    kinds = dict(results.dtypes)
    names = list(dict.fromkeys(["query_id", "id", *columns]))
    return results.select(*names).mapInPandas(run, f"query_id {kinds['query_id']}, id {kinds['id']}, score double")


def search(queries: DataFrame, vectors: DataFrame, docs: DataFrame, k: int, alpha: float | None = 0.5, metric: str = "euclidean", id_col: str = "id", vector_col: str = "vector", graph_alpha: float = 0.0, edges: DataFrame | None = None, keep: DataFrame | None = None) -> DataFrame:
    """Hybrid search of ``queries (query_id, vector, text)`` over vectors and ``text_search.documents``.

    alpha 1 ranks by vectors, 0 by text, anything between by reciprocal ranks of both (2k of each); a negative one, or None, is
    taken from the number of terms (which only decides that both count). ``keep`` (a column ``id``) is applied before either
    ranking is cut. With ``graph_alpha`` > 0 the edges' one-hop boost follows.
    """
    knn.check_k(k)
    dense = sparse = None
    if alpha != 0:
        base = vectors if keep is None else vectors.join(keep.select(F.col("id").alias(id_col)).distinct(), id_col, "left_semi")
        dense = knn.batch(queries.where("vector is not null"), base, k if alpha == 1 else 2 * k, metric, "query_id", "vector", id_col, vector_col).select("query_id", "id", "score")
    if alpha != 1:
        sparse = text_search.bm25(docs, queries.select("query_id", "text"), k if alpha == 0 else 2 * k, keep).select("query_id", "id", "score")
    out = cut(dense if sparse is None else sparse, k) if dense is None or sparse is None else rrf(k, dense, sparse)
    if graph_alpha > 0 and edges is not None:
        out = cut(graph.rerank(out, edges, graph_alpha), k)
    return out


def pipeline(queries: DataFrame, vectors: DataFrame, docs: DataFrame, k: int, fusion: str = "rrf", alpha: float = 0.5, metric: str = "euclidean", keep: DataFrame | None = None, rerank: Callable[[pd.DataFrame], pd.Series] | None = None, columns: tuple[str, ...] = (), depth: int = 2) -> DataFrame:
    """Both legs (``depth * k`` each), fused by ``rrf``, ``linear`` (weight ``alpha`` for vectors) or ``cascade`` (texts first), cut to k, and
    scored anew by ``rerank`` if one is given; ``keep`` restricts both legs before they are cut."""
    knn.check_k(k)
    if fusion not in ("rrf", "linear", "cascade"):
        raise ValueError("fusion must be rrf, linear or cascade")
    base = vectors if keep is None else vectors.join(keep.select("id").distinct(), "id", "left_semi")
    dense = knn.batch(queries.where("vector is not null"), base, depth * k, metric).select("query_id", "id", "score")
    sparse = text_search.bm25(docs, queries.select("query_id", "text"), depth * k, keep).select("query_id", "id", "score")
    out = rrf(k, dense, sparse) if fusion == "rrf" else linear(k, dense, sparse, alpha) if fusion == "linear" else cascade(k, sparse, dense)
    return out if rerank is None else cut(reranked(out, rerank, list(columns)), k)
