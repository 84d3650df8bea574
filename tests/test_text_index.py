import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkvec.functions import text as T
from sparkvec.functions import vector as V
from sparkvec.operators import knn, text_search
from sparkvec.operators import quantize as Q

DOCS = [(1, "alpha beta beta"), (2, "beta gamma"), (3, "alpha alpha delta"), (4, None), (5, " .. "), (6, "beta")]


def docs(spark, rows=DOCS):
    return text_search.documents(spark.createDataFrame(rows, "id bigint, text string"), "id", "text")


def asks(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id bigint, text string")


def rows(df):
    return sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 9)) for r in df.collect())


def test_index_equals_documents_after_adds_and_deletes(spark, tmp_path):
    index = text_search.TextIndex(spark, f"file://{tmp_path}/i")
    q = asks(spark, "beta alpha", "delta", "nothing", "", "beta beta")
    assert index.search(q, 3).count() == 0
    index.add(docs(spark, DOCS[:3]))
    index.add(docs(spark, DOCS[3:]))
    assert rows(index.search(q, 3)) == rows(text_search.bm25(docs(spark), q, 3))
    index.delete(spark.createDataFrame([(1,), (77,)], "id bigint"))
    assert rows(index.search(q, 3)) == rows(text_search.bm25(docs(spark, DOCS[1:]), q, 3))
    index.add(docs(spark, DOCS[:1]))
    assert rows(index.search(q, 3)) == rows(text_search.bm25(docs(spark), q, 3))
    assert {r["term"]: r["df"] for r in index.frequencies().collect()} == {"alpha": 2, "beta": 3, "gamma": 1, "delta": 1}
    kept = spark.createDataFrame([(3,)], "id bigint")
    assert {x[2] for x in rows(index.search(q, 3, kept))} == {3}


def test_blocks_of_queries_and_documents(spark, monkeypatch):
    r = np.random.default_rng(0)
    many = [(i, " ".join(f"w{w}" for w in r.integers(0, 30, r.integers(1, 40)))) for i in range(300)]
    q = asks(spark, *[" ".join(f"w{w}" for w in r.integers(0, 35, 5)) for _ in range(20)])
    want = rows(text_search.bm25(docs(spark, many), q, 7))
    monkeypatch.setattr(text_search, "BLOCK_TERMS", 12)
    monkeypatch.setattr(text_search, "CELLS", 50)
    monkeypatch.setattr(knn, "HELD", 10)
    assert rows(text_search.bm25(docs(spark, many), q, 7)) == want and len(want) == 140


def test_best_keeps_ties_by_id():
    b = knn.Best(2, 2)
    b.add(np.array([0, 0, 0, 1]), pa.array([5, 3, 4, 9]), np.array([1.0, 1.0, 1.0, 7.0]))
    b.add(np.array([0, 1]), pa.array([2, None], pa.int64()), np.array([1.0, 7.0]))
    q, ids, d = b.kept()
    assert list(zip(q.tolist(), ids.to_pylist(), d.tolist())) == [(0, 2, 1.0), (0, 3, 1.0), (1, None, 7.0), (1, 9, 7.0)]
    assert knn.Best(1, 3).kept()[0].size == 0


def fnv(b):
    h = 14695981039346656037
    for x in b:
        h = (h ^ x) * 1099511628211 % 2**64
    return h - 2**64 if h >= 2**63 else h


def test_hashes(spark):
    texts = ["", "a", "foobar", "Größe", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.fnv1a(F.col("t")).alias("f"), T.crc32(F.col("t")).alias("c"), T.clean(F.concat("t", F.lit("\x00 "))).alias("k"))
    for r in df.collect():
        if r["t"] is None:
            assert r["f"] is None and r["c"] is None
        else:
            assert r["f"] == fnv(r["t"].encode()) and r["c"] == zlib.crc32(r["t"].encode()) and r["k"] == r["t"]
    assert fnv(b"a") == 0xAF63DC4C8601EC8C - 2**64
    assert spark.range(1).select(F.length(T.clean(F.repeat(F.lit("x"), 9000)))).first()[0] == 9000


def test_conversions(spark):
    v = [1.9, -1.9, 300.0, -300.0, 0.0]
    r = spark.createDataFrame([(v,), (None,)], "v array<double>").select(V.integers(F.col("v")).alias("i"), V.integers(F.col("v"), "uint8").alias("u"), V.half(F.col("v")).alias("h"), Q.as_signs(F.col("v")).alias("s")).collect()
    assert r[0]["i"] == [1, -1, 127, -128, 0] and r[0]["u"] == [1, 0, 255, 0, 0] and r[0]["s"] == [0b101]
    assert np.allclose(r[0]["h"], np.array(v, np.float16)) and r[1]["i"] is None and r[1]["h"] is None


def test_search_needs_k(spark):
    with pytest.raises(ValueError):
        text_search.bm25(docs(spark), asks(spark, "beta"), 0)
