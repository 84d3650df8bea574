"""Keyword ranking: BM25, relative term frequency, TF-IDF.

One row is one document; several text columns are joined by blanks. Counts and lengths cover all documents. Queries are read in
blocks of bounded size that go to every task with the code: a task scores its own documents for all queries of the block at once and
keeps its k best for each, so neither postings nor pairs of documents and queries are ever shuffled, however common a term is.
Documents without terms aren't counted; documents without any of a query's terms aren't returned; equal scores are ordered by id.

:class:`TextIndex` keeps the split documents and the running counts in a folder, so that texts are split once and searches read
no statistics from the documents; documents are added and deleted in batches.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from sparkvec.functions.text import document, has_terms, tokenize
from sparkvec.operators import knn

#: fixed values of BM25
K1, B = 1.2, 0.75
BLOCK_TERMS = 200_000  # terms of the queries of one block
CELLS = 1 << 22  # documents x queries that are scored at once

Weight = Callable[[np.ndarray, np.ndarray, np.ndarray, float, float], np.ndarray]
Statistics = tuple[int, float, dict[str, int]]


def documents(df: DataFrame, id_col: str, *text_cols: str) -> DataFrame:
    """``(id, terms, len)`` of every document with at least one term."""
    text = document(*[F.col(c) for c in text_cols])
    rows = df.where(has_terms(text)).select(F.col(id_col).alias("id"), tokenize(text).alias("terms"))  # a filter by the length would split texts again
    return rows.withColumn("len", F.size("terms").cast("bigint"))


def query_terms(queries: DataFrame, distinct: bool = True) -> DataFrame:
    """``(query_id, term, times)`` of ``(query_id, text)``."""
    t = queries.select("query_id", F.explode(tokenize(F.col("text"))).alias("term"))
    return t.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times")).withColumn("times", F.lit(1).cast("bigint") if distinct else F.col("times"))


def idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1.0)


def totals(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avgdl"))


def statistics(docs: DataFrame, terms: list[str]) -> Statistics:
    """(documents, mean length, documents of each of the terms)."""
    names = pa.array(sorted(set(terms)), pa.string())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, docs_, length = np.zeros(len(names), np.int64), 0, 0
        for b in batches:
            _, term, _ = counted(b.column("terms"), names)
            n += np.bincount(term, minlength=len(names))
            docs_ += b.num_rows
            length += pc.sum(b.column("len")).as_py() or 0
        at = np.flatnonzero(n)
        # numbers below 0 are the totals
        yield pa.record_batch({"term": pa.array(np.concatenate([[-1, -2], at]).astype(np.int64)), "n": pa.array(np.concatenate([[docs_, length], n[at]]).astype(np.int64))})

    rows = docs.select("terms", "len").mapInArrow(count, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()  # the block's terms
    got = {r["term"]: r["n"] for r in rows}
    n = got.pop(-1, 0)
    length = got.pop(-2, 0)
    return n, length / n if n else 0.0, {names[i].as_py(): m for i, m in got.items()}


def counted(terms: pa.Array, names: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, times) of the named terms in a batch of documents."""
    at = pc.index_in(terms.flatten(), value_set=names)
    here = at.is_valid().to_numpy(zero_copy_only=False)
    key = pc.list_parent_indices(terms).to_numpy(zero_copy_only=False)[here].astype(np.int64) * max(1, len(names)) + at.drop_null().to_numpy()
    key, times = np.unique(key, return_counts=True)
    return key // max(1, len(names)), key % max(1, len(names)), times


def _blocks(queries: DataFrame) -> Iterator[list[Row]]:
    held, terms = [], 0
    for r in queries.select(F.col("query_id").alias("q"), tokenize(F.col("text")).alias("v")).where("v is not null").toLocalIterator():
        held.append(r)
        terms += len(r["v"])
        if terms >= BLOCK_TERMS:
            yield held
            held, terms = [], 0
    if held:
        yield held


def scored(docs: DataFrame, queries: DataFrame, k: int, weight: Weight, distinct: bool = True, ids: DataFrame | None = None, known: Callable[[list[str]], Statistics] | None = None) -> DataFrame:
    """``(query_id, id, score, rank)``: the k documents ``(id, terms, len)`` with the greatest sum of ``weight(times in the document,
    documents of the term, length, all documents, mean length)`` over the query's terms; ``ids`` restricts what is returned."""
    knn.check_k(k)
    id_type = dict(docs.dtypes)["id"]
    rows = (docs if ids is None else docs.join(ids.select("id").distinct(), "id", "left_semi")).select("id", "terms", "len")
    out = None
    for block in _blocks(queries):
        own = [sorted(set(r["v"])) if distinct else sorted(r["v"]) for r in block]
        words = sorted({t for ts in own for t in ts})
        n, mean, df = known(words) if known else statistics(docs, words)
        at = {t: i for i, t in enumerate(words)}
        pair, times = np.unique([at[t] * len(block) + i for i, ts in enumerate(own) for t in ts], return_counts=True) if words else (np.zeros(0, np.int64), np.zeros(0))
        first = np.searchsorted(pair, np.arange(len(words) + 1) * len(block))  # the queries of each term
        asks, many = pair % max(1, len(block)), np.diff(first)
        freq = np.array([df.get(t, 0) for t in words], np.int64)

        def search(batches: Iterator[pa.RecordBatch], words: list[str] = words, freq: np.ndarray = freq, first: np.ndarray = first, asks: np.ndarray = asks, many: np.ndarray = many, times: np.ndarray = times, n: int = n, mean: float = mean, size: int = len(block)) -> Iterator[pa.RecordBatch]:
            names, best = pa.array(words, pa.string()), knn.Best(size, k)
            step = max(1, CELLS // size)
            for b in batches:
                lens = b.column("len").to_numpy(zero_copy_only=False)
                doc, term, tf = counted(b.column("terms"), names)
                w = weight(tf, freq[term], lens[doc], n, mean) if len(doc) else np.zeros(0)
                for a in range(0, b.num_rows, step):
                    x, y = np.searchsorted(doc, [a, a + step])
                    t = term[x:y]
                    if not len(t):
                        continue
                    place = np.repeat(first[t] - (np.cumsum(many[t]) - many[t]), many[t]) + np.arange(int(many[t].sum()))
                    docs_ = min(step, b.num_rows - a)
                    cell = asks[place] * docs_ + np.repeat(doc[x:y] - a, many[t])
                    s = np.bincount(cell, np.repeat(w[x:y], many[t]) * times[place], size * docs_).reshape(size, docs_)
                    d = np.where(s > 0, -s, np.inf)
                    r, c = best.candidates(d, 0, np.zeros(size))
                    best.add(r, b.column("id").take(pa.array(a + c)), d[r, c])
            yield from best.batches()

        part = knn.ranked(rows.mapInArrow(search, f"n int, id {id_type}, distance double"), block, queries, k)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return docs.sparkSession.createDataFrame([], f"query_id {dict(queries.dtypes)['query_id']}, id {id_type}, score double, rank bigint")
    return out.select("query_id", "id", (-F.col("distance")).alias("score"), "rank")


def _idf(n: float, df: np.ndarray) -> np.ndarray:
    return np.log((n - df + 0.5) / (df + 0.5) + 1.0)


def bm25_weight(k1: float = K1, b: float = B) -> Weight:
    return lambda tf, df, length, n, mean: _idf(n, df) * tf * (k1 + 1) / np.maximum(tf + k1 * (1 - b + b * length / (mean or 1.0)), 1e-4)


def bm25(docs: DataFrame, queries: DataFrame, k: int, ids: DataFrame | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """``(query_id, id, score, rank)``; ``ids`` (a column ``id``) restricts the results, not the statistics."""
    return docs.search(queries, k, ids, k1, b) if isinstance(docs, TextIndex) else scored(docs, queries, k, bm25_weight(k1, b), ids=ids)


def term_frequency(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Score: the sum of each query term's share of the document; a repeated term counts again."""
    return scored(docs, queries, k, lambda tf, df, length, n, mean: tf / length, distinct=False)


def tf_idf(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Score: the sum of ``(1 + ln tf) * (1 + idf)``."""
    return scored(docs, queries, k, lambda tf, df, length, n, mean: (1 + np.log(tf)) * (1 + _idf(n, df)))


def document_frequencies(docs: DataFrame) -> DataFrame:
    """``(term, df, idf)`` of every term."""
    flat = docs.select(F.explode(F.array_distinct("terms")).alias("term"))
    return flat.groupBy("term").agg(F.count(F.lit(1)).alias("df")).withColumn("idf", idf(totals(docs).select("n").scalar(), F.col("df")))


class TextIndex:
    """Split documents and running counts in a folder: ``docs``, ``deleted``, ``counts`` (by term) and ``totals``.

    Adding a document whose id is known, and not deleted, counts it twice: delete it first. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.parquet(f"{self.path}/{name}")
        except AnalysisException:
            return self.spark.createDataFrame([], schema)

    def _count(self, docs: DataFrame, sign: int) -> None:
        docs.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg((F.count(F.lit(1)) * sign).alias("n")).write.mode("append").parquet(f"{self.path}/counts")
        docs.agg((F.count(F.lit(1)) * sign).alias("n"), (F.coalesce(F.sum("len"), F.lit(0)) * sign).alias("len")).coalesce(1).write.mode("append").parquet(f"{self.path}/totals")

    def add(self, docs: DataFrame) -> None:
        """Append :func:`documents`."""
        batch = uuid.uuid4().hex
        docs.select("id", "terms", "len", F.lit(batch).alias("batch")).write.mode("append").parquet(f"{self.path}/docs")
        self._count(self._read("docs", "").where(F.col("batch") == batch), 1)

    def delete(self, ids: DataFrame) -> None:
        """Take documents out; unknown ids are ignored. The same id may be added again."""
        own = self.documents().join(ids.select("id").distinct(), "id", "left_semi")
        batches = own.select("id", "batch")
        self._count(own, -1)
        batches.write.mode("append").parquet(f"{self.path}/deleted")

    def documents(self) -> DataFrame:
        docs = self._read("docs", "id bigint, terms array<string>, len bigint, batch string")
        return docs.join(self._read("deleted", f"id {dict(docs.dtypes)['id']}, batch string"), ["id", "batch"], "left_anti")

    def frequencies(self) -> DataFrame:
        """``(term, df)`` of every term."""
        return self._read("counts", "term string, n bigint").groupBy("term").agg(F.sum("n").alias("df")).where("df > 0")

    def statistics(self, terms: list[str]) -> Statistics:
        t = self._read("totals", "n bigint, len bigint").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("len")).first()
        names = self.spark.createDataFrame([(x,) for x in terms], "term string")
        df = self._read("counts", "term string, n bigint").join(F.broadcast(names), "term").groupBy("term").agg(F.sum("n").alias("n")).collect()  # one block's terms
        return t["n"], t["len"] / t["n"] if t["n"] else 0.0, {r["term"]: r["n"] for r in df}

    def search(self, queries: DataFrame, k: int, ids: DataFrame | None = None, k1: float = K1, b: float = B) -> DataFrame:
        return scored(self.documents(), queries, k, bm25_weight(k1, b), ids=ids, known=self.statistics)
