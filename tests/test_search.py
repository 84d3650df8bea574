import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkvec.functions import text as T
from sparkvec.functions import vector as V
from sparkvec.operators import hybrid, ivf, knn, quantize, text_search


@pytest.fixture(scope="module")
def x():
    return np.random.default_rng(0).normal(size=(500, 16))


@pytest.fixture(scope="module")
def vectors(spark, x):
    return spark.createDataFrame([(i, v.tolist(), i % 5) for i, v in enumerate(x)], "id bigint, vector array<double>, label int").repartition(5).cache()


@pytest.fixture(scope="module")
def queries(vectors):
    return vectors.where("id % 100 = 0").select(F.col("id").alias("query_id"), "vector")


def brute(x, q, metric):
    d = np.sqrt(((x - q) ** 2).sum(1)) if metric == "euclidean" else -(x @ q) if metric == "dot_product" else 1 - x @ q / np.sqrt((x * x).sum(1) * (q @ q))
    return sorted(zip(d.tolist(), range(len(x))))


@pytest.mark.parametrize("metric", V.METRICS)
def test_batch_and_single(vectors, queries, x, metric):
    got = {(r["query_id"], r["rank"]): r for r in knn.batch(queries, vectors, 7, metric).collect()}
    assert len(got) == 35
    for q in range(0, 500, 100):
        for rank, (d, i) in enumerate(brute(x, x[q], metric)[:7]):
            r = got[q, rank + 1]
            assert r["id"] == i and abs(r["distance"] - d) < 1e-9
            assert abs(r["score"] - (-d if metric == "dot_product" else 1 / (1 + d))) < 1e-9
    one = knn.single(vectors, x[0].tolist(), 7, metric).collect()
    assert [r["id"] for r in one] == [i for _, i in brute(x, x[0], metric)[:7]]


def test_ties_nulls_dimensions_and_empty(spark):
    v = spark.createDataFrame([(3, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (4, None), (5, [1.0]), (6, [0.0, 0.0])], "id bigint, vector array<float>").repartition(3)
    q = spark.createDataFrame([(9, [1.0, 0.0]), (8, None)], "query_id bigint, vector array<float>")
    assert [r["id"] for r in knn.batch(q, v, 2).orderBy("rank").collect()] == [1, 2]
    assert [r["id"] for r in knn.batch(q, v, 9).orderBy("rank").collect()] == [1, 2, 3, 6]
    zero = knn.batch(q, v.where("id = 6"), 1, "cosine").collect()[0]
    assert zero["distance"] == 1.0
    assert knn.batch(q.where("false"), v, 2).count() == 0 and knn.batch(q, v.where("false"), 2).count() == 0
    with pytest.raises(ValueError):
        knn.batch(q, v, 0)
    with pytest.raises(ValueError):
        knn.batch(q, v, 1, "manhattan")
    with pytest.raises(Exception, match="vector must have 2"):
        knn.check_dimension(v, "vector", 2).collect()


def test_string_ids_and_blocks(spark, vectors, queries, monkeypatch):
    monkeypatch.setattr(knn, "BLOCK_BYTES", 2 * 8 * 4)
    named = vectors.withColumn("id", F.concat(F.lit("v"), "id"))
    got = knn.batch(queries, named, 1).collect()
    assert {(r["query_id"], r["id"]) for r in got} == {(i, f"v{i}") for i in range(0, 500, 100)}


def test_filtered_within_by_id_merge_recall(vectors, queries, x):
    f = knn.filtered(vectors, F.col("label") == 2, queries, 3)
    assert all(r["id"] % 5 == 2 for r in f.collect()) and f.count() == 15
    w = knn.within(vectors, vectors.where("id < 10").select("id"), queries, 20)
    assert w.count() == 50
    b = knn.by_id(vectors, vectors.where("id in (7, 8)").select("id"), 2).where("rank = 1").collect()
    assert {(r["query_id"], r["id"]) for r in b} == {(7, 7), (8, 8)}
    parts = [knn.batch(queries, vectors.where(F.col("label") == i), 5) for i in range(5)]
    whole = knn.batch(queries, vectors, 5)
    key = lambda df: sorted((r["query_id"], r["rank"], r["id"]) for r in df.collect())
    assert key(knn.merged(5, *parts)) == key(whole)
    assert {r["recall"] for r in knn.recall(parts[0], whole).collect()} <= {i / 5 for i in range(6)}
    assert knn.with_vectors(whole, vectors).count() == 25


def test_cells(spark, vectors, queries, tmp_path):
    index = ivf.build(vectors, f"{tmp_path}/ivf", 10)
    exact = knn.batch(queries, vectors, 10)
    recall = lambda r: knn.recall(r, exact).agg(F.avg("recall")).first()[0]
    assert recall(ivf.search(spark, index, queries, 10, probes=10)) == 1.0
    assert recall(ivf.search(spark, index, queries, 10, probes=7)) >= 0.9
    rare = ivf.search(spark, index, queries, 5, probes=1, condition="label = 1")
    assert rare.count() == 25  # widened until every query has five
    assert ivf.adaptive(spark, vectors, queries, 3, f"{tmp_path}/a").count() == 15


def test_vector_functions(spark):
    r = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0], [2.0, 2.0, 1.0, 0.0])], "a array<float>, b array<float>").select(
        V.l2_squared(F.col("a"), F.col("b")), V.complex_l2(F.col("a"), F.col("b")), V.complex_dot_real(F.col("a"), F.col("b")), V.bounds(F.col("a")), V.sub_vector(F.col("a"), 1, 2), V.hamming(F.array(F.lit(5)), F.array(F.lit(-1)))
    ).first()
    assert r[0] == 21 and abs(r[1] - math.sqrt(21)) < 1e-12 and r[2] == 2 - 4 + 3 - 0 and tuple(r[3]) == (1, 4) and r[4] == [3, 4] and r[5] == 62


def test_quantizers(spark, vectors, x, tmp_path):
    lo, hi = quantize.sq8_bounds(vectors, "vector")
    assert np.allclose(lo, x.min(0)) and np.allclose(hi, x.max(0))
    q = vectors.withColumn("c", quantize.sq8_encode(F.col("vector"), lo, hi)).withColumn("d", quantize.sq8_decode(F.col("c"), lo, hi))
    rows = q.collect()
    step = (np.array(hi) - lo) / 255
    assert all((np.abs(np.array(r["d"]) - r["vector"]) <= step + 1e-9).all() and min(r["c"]) >= 0 and max(r["c"]) <= 255 for r in rows)
    flat = spark.createDataFrame([([1.0, 2.0],), ([1.0, 3.0],), (None,)], "vector array<double>")
    assert quantize.sq8_bounds(flat, "vector") == ([1.0, 2.0], [1.0 + 1e-7, 3.0])
    b = spark.createDataFrame([([1.0, -1.0] * 50,)], "v array<double>").select(quantize.bq_encode(F.col("v"), 100).alias("c")).select("c", quantize.bq_decode(F.col("c"), 100).alias("d"), quantize.bq_similarity(F.col("c"), F.col("c"), 100).alias("s")).first()
    assert len(b["c"]) == 2 and b["d"] == [1.0, -1.0] * 50 and b["s"] == 1.0
    book = quantize.pq_train(vectors, "vector", 4, 32)
    quantize.save_book(spark, book, f"{tmp_path}/book")
    assert np.allclose(quantize.load_book(spark, f"{tmp_path}/book"), book)
    e = quantize.pq_encode(vectors, "vector", book).withColumn("back", quantize.pq_decode(F.col("code"), book))
    err = e.agg(F.avg(V.l2_squared(F.col("vector"), F.col("back")))).first()[0]
    assert err < 0.7 * (x**2).sum(1).mean()
    t = quantize.adc_table(x[0].tolist(), book)
    r = e.withColumn("adc", quantize.adc_distance(F.col("code"), t)).withColumn("want", V.l2(F.col("back"), F.array(*[F.lit(float(v)) for v in x[0]]))).collect()
    assert all(abs(a["adc"] - a["want"]) < 1e-9 for a in r)
    with pytest.raises(ValueError):
        quantize.pq_train(vectors, "vector", 4, 1000)
    assert [quantize.default_parts(d) for d in (64, 12, 7)] == [8, 3, 1]


DOCS = [(1, "The quick brown fox", "x"), (2, "the lazy dog, the dog!", None), (3, None, "fox"), (4, "", None), (5, "quick quick quick", "")]


@pytest.fixture(scope="module")
def docs(spark):
    return text_search.documents(spark.createDataFrame(DOCS, "id bigint, a string, b string"), "id", "a", "b")


def test_bm25(spark, docs):
    q = spark.createDataFrame([(1, "quick FOX quick"), (2, "dog"), (3, "none"), (4, None)], "query_id bigint, text string")
    words = {i: [w for w in " ".join(t for t in (a, b) if t).lower().replace(",", "").replace("!", "").split()] for i, a, b in DOCS}
    words = {i: w for i, w in words.items() if w}
    n, avg = len(words), np.mean([len(w) for w in words.values()])

    def score(i, terms):
        s = 0
        for t in terms:
            df = sum(t in w for w in words.values())
            tf = words[i].count(t)
            s += math.log((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words[i]) / avg))
        return s

    got = {(r["query_id"], r["id"]): r["score"] for r in text_search.bm25(docs, q, 10).collect()}
    want = {(qq, i): score(i, t) for qq, t in ((1, {"quick", "fox"}), (2, {"dog"})) for i in words if any(w in words[i] for w in t)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    kept = text_search.bm25(docs, q, 10, spark.createDataFrame([(1,)], "id bigint")).collect()
    assert [(r["query_id"], r["id"]) for r in kept] == [(1, 1)] and abs(kept[0]["score"] - want[1, 1]) < 1e-9
    tf = {(r["query_id"], r["id"]): r["score"] for r in text_search.term_frequency(docs, q, 10).collect()}
    assert abs(tf[1, 5] - 2.0) < 1e-9  # the repeated term counts twice
    assert text_search.tf_idf(docs, q, 1).count() == 2
    assert text_search.bm25(docs.where("false"), q, 3).count() == 0


def test_text_functions(spark):
    r = spark.createDataFrame([("a/b/c",), ("x",), ("/x",), ("",), (None,)], "p string").select(T.namespace(F.col("p")).alias("n")).collect()
    assert [tuple(x["n"]) for x in r] == [("a", "b/c"), ("default", "x"), ("default", "x"), ("default", ""), ("default", "")]
    c = spark.createDataFrame([(" a\x00b\x07 ",)], "t string").select(T.clean(F.col("t")), T.clean(F.col("t"), 1), T.tokenize(F.lit("(A) b.c,  !")), T.digest(F.lit(1), F.lit("x"))).first()
    assert c[0] == "ab" and c[1] == "a" and c[2] == ["a", "b.c"] and len(c[3]) == 64


def lists(spark, rows):
    return spark.createDataFrame(rows, "query_id bigint, id bigint, score double")


def test_fusions(spark):
    dense, sparse = lists(spark, [(1, 1, 0.9), (1, 2, 0.8), (1, 3, 0.1)]), lists(spark, [(1, 3, 10.0), (1, 4, 5.0)])
    r = {x["id"]: x["score"] for x in hybrid.rrf(10, dense, sparse).collect()}
    assert abs(r[3] - (1 / 63 + 1 / 61)) < 1e-12 and abs(r[1] - 1 / 61) < 1e-12
    assert [x["id"] for x in hybrid.rrf(1, dense, sparse).collect()] == [3]
    lin = {x["id"]: x["score"] for x in hybrid.linear(10, dense, sparse, 0.5).collect()}
    assert abs(lin[3] - (0.5 * 0.1 / 0.9 + 0.5)) < 1e-12 and abs(lin[4] - 0.25) < 1e-12
    assert sorted(x["id"] for x in hybrid.cascade(3, sparse, dense).collect()) == [1, 3, 4]
    assert [x["id"] for x in hybrid.cascade(3, sparse, dense, spark.createDataFrame([(2,)], "id bigint")).collect()] == [2]
    assert hybrid.cascade(3, sparse, dense, spark.createDataFrame([], "id bigint")).count() == 0
    assert {x["id"]: x["score"] for x in hybrid.best_of(dense, sparse).collect()}[3] == 10.0
    with pytest.raises(ValueError):
        hybrid.linear(1, dense, sparse, 2)
    again = hybrid.reranked(dense, lambda p: -pd.Series(p["id"]), []).orderBy("score").collect()
    assert [x["id"] for x in again] == [3, 2, 1]
    assert [hybrid.auto_alpha_of(t) for t in ("a b", "a b c", "a b c d e f")] == [0.3, 0.5, 0.8]


def test_hybrid_search(spark, vectors, x):
    docs = text_search.documents(spark.createDataFrame([(i, f"doc {i} word{i % 7}") for i in range(500)], "id bigint, t string"), "id", "t")
    q = spark.createDataFrame([(1, x[3].tolist(), "word3 doc")], "query_id bigint, vector array<double>, text string")
    for alpha in (0.0, 0.5, 1.0, None, -1.0):
        assert hybrid.search(q, vectors, docs, 5, alpha).count() == 5
    assert hybrid.search(q, vectors, docs, 5, 1.0).where("rank = 1").first()["id"] == 3
    keep = vectors.where("label = 1").select("id")
    assert all(r["id"] % 5 == 1 for r in hybrid.search(q, vectors, docs, 5, 0.5, keep=keep).collect())
    edges = spark.createDataFrame([(3, "p", 9999, 1.0)], "subject bigint, predicate string, object bigint, weight double")
    got = hybrid.search(q, vectors, docs, 5, 1.0, graph_alpha=0.9, edges=edges).collect()
    assert 9999 in {r["id"] for r in got}
