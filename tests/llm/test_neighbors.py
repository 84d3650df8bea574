import numpy as np
import pyarrow as pa
import pytest

from sparkvec.llm import neighbors as N
from sparkvec.llm import vectors as V

SCHEMA = "id bigint, vector array<float>, ts timestamp, page string, n string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def clustered(n, dim=48, seed=0, centres=40):
    r = np.random.default_rng(seed)
    return (r.normal(size=(centres, dim))[r.integers(0, centres, n)] * 4 + r.normal(size=(n, dim)) * 0.3).astype(np.float32)


def brute(x, k):
    d = np.sqrt(((x[:, None, :] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    return np.argsort(d, 1, kind="stable")[:, :k], np.sort(d, 1)[:, :k]


def test_newest_usable_rows(spark):
    import datetime as dt

    t = [dt.datetime(2024, 1, i + 1) for i in range(9)]
    good, bad = [1.0] * 4, [1.0, float("nan"), 2.0, 3.0]
    rows = [
        (1, good, t[0]), (1, [2.0] * 4, t[2]), (1, bad, t[3]), (1, [9.0] * 4, None), (2, None, t[0]), (3, [1.0], t[0]), (None, good, t[0]),
        (4, [float("inf")] * 4, t[0]), (5, good, t[1]), (5, good, t[1]), (6, [1.0, None, 1.0, 1.0], t[1]), (7, [3.0] * 4, t[5]), (7, [4.0] * 4, t[5]),
    ]
    got = {r["id"]: list(r["vector"]) for r in V.newest(table(spark, rows), 4).collect()}
    assert got == {1: [2.0] * 4, 5: good, 7: [4.0] * 4}


def test_bitmap_full_gives_the_same(spark, monkeypatch):
    import datetime as dt

    rows = [(i % 50, [float(i), 1.0], dt.datetime(2024, 1, 1 + i // 50)) for i in range(200)]
    a = sorted(map(tuple, ((r["id"], tuple(r["vector"])) for r in V.newest(table(spark, rows), 2).collect())))
    monkeypatch.setattr(V, "BITS", 2)
    b = sorted(map(tuple, ((r["id"], tuple(r["vector"])) for r in V.newest(table(spark, rows), 2).collect())))
    assert a == b and len(a) == 50


@pytest.mark.parametrize("cap", [100, 100_000])
def test_recall(spark, cap):
    x = clustered(1500)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, vector array<float>")
    got = {r["id"]: r["neighbors"] for r in N.knn(df, 10, cap=cap, exact=True).collect()}
    want, _ = brute(x, 10)
    recall = np.mean([len(set(got[i]) & set(want[i].tolist())) / 10 for i in range(len(x))])
    assert len(got) == len(x) and recall >= (0.9 if cap == 100 else 0.999)


def test_exact_distances_and_ranks(spark):
    x = clustered(300, seed=3)
    df = table(spark, [(i, v.tolist(), None) for i, v in enumerate(x)])
    got = {(r["id"], r["rank"]): r["distance"] for r in N.nearest_ids(df, 5).collect()}
    _, d = brute(x, 5)
    assert len(got) == 1500
    assert all(abs(got[i, j + 1] - d[i, j]) < 1e-3 for i in range(300) for j in range(5))


def test_tight_rings(spark):
    r = np.random.default_rng(1)
    x = clustered(400, seed=5)
    ring = x[7] + 20 + r.normal(size=(6, 48)).astype(np.float32) * 0.05
    rows = [(i, v.tolist(), None) for i, v in enumerate(np.concatenate([x, ring]))]
    got = {(a, b) for a, b in N.tight_rings(table(spark, rows)).collect()}
    allx = np.concatenate([x, ring])
    i, d = brute(allx, 6)
    want = {(min(a, b), max(a, b)) for a in range(len(allx)) if d[a, 4] <= 0.6 * d[a, 5] and d[a, 5] > 0 for b in i[a, :5].tolist()}
    assert got == want and len(want) >= 15


def test_small_and_empty(spark):
    assert N.nearest_ids(table(spark, []), 3).count() == 0
    assert N.tight_rings(table(spark, [])).count() == 0
    assert N.nearest_ids(table(spark, [(1, [1.0] * 48, None)]), 3).count() == 0
    assert N.nearest_ids(table(spark, [(1, [1.0] * 48, None), (2, [1.0] * 48, None)]), 3).count() == 2


def test_copies_above_the_cap_find_copies(spark):
    rows = [(i, [1.0] * 48, None) for i in range(300)] + [(1000 + i, v.tolist(), None) for i, v in enumerate(clustered(200))]
    got = N.nearest_ids(table(spark, rows), 3, cap=60).where("id < 300").collect()
    assert len(got) == 900 and all(r["distance"] == 0 for r in got)


def test_codes_differ_little_for_near_vectors():
    x = clustered(500)
    w, t = N.learn(x, 4, 24)
    bits = (x @ w) > t
    i, _ = brute(x, 1)
    near = (bits != bits[i[:, 0]]).sum(1).mean()
    far = (bits != bits[::-1]).sum(1).mean()
    assert w.shape == (48, 96) and near < far / 2


def rings_in_a_dense_place(groups=400, away=1200, dim=48, seed=3):
    """Tight rings of six in one place, on one side of the thresholds of all others, and the others."""
    r = np.random.default_rng(seed)
    x = np.repeat(r.normal(size=(groups, dim)), 6, 0) + r.normal(size=(groups * 6, dim)) * 0.05
    return np.concatenate([x * 0.01 + 50, r.normal(size=(away, dim)) * 20 - 50]).astype(np.float32)


def test_dense_place_is_split_by_its_own_codes(spark):
    x = rings_in_a_dense_place(300, 3800)
    df = table(spark, [(i, v.tolist(), None) for i, v in enumerate(x)]).select("id", "vector").cache()
    got = {r["id"]: set(r["neighbors"]) for r in N.knn(df, 5, cap=100, sample=1000).collect()}
    assert len(got) == len(x)
    assert np.mean([got[i] == set(range(i // 6 * 6, i // 6 * 6 + 6)) - {i} for i in range(1800)]) > 0.97
    index = N.fit(df, 48, 4, 24, 100, 1000)
    assert index.below and all(index.size[p] <= 200 for p in range(len(index.size)) if p not in index.below)


def test_what_no_code_splits_is_compared_in_full(spark, monkeypatch):
    monkeypatch.setattr(N.Index, "split", lambda *a: False)
    x = rings_in_a_dense_place(100, 300)
    df = table(spark, [(i, v.tolist(), None) for i, v in enumerate(x)]).select("id", "vector").cache()
    got = {r["id"]: list(r["neighbors"]) for r in N.knn(df, 5, cap=50, sample=1000, exact=True).collect()}
    want = brute(x.astype(np.float64), 5)[0]
    assert N.fit(df, 48, 4, 24, 50, 1000).pieces
    assert all(set(got[i]) == set(want[i].tolist()) for i in range(600))


def test_copies_above_the_cap_find_each_other_and_no_one_twice(spark):
    x = np.concatenate([np.ones((700, 48)), clustered(300)]).astype(np.float32)
    df = table(spark, [(i, v.tolist(), None) for i, v in enumerate(x)]).select("id", "vector").cache()
    got = {r["id"]: r for r in N.knn(df, 6, cap=50, sample=1000).collect()}
    assert all(len(set(got[i]["neighbors"])) == 6 and max(got[i]["neighbors"]) < 700 and i not in got[i]["neighbors"] for i in range(700))


def test_every_code_within_the_radius_shares_a_bucket(spark):
    """Pigeonhole: codes that differ in at most tables - 1 bits meet, whatever the vectors' distance."""
    x = clustered(3000, seed=5)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, vector array<float>")
    index = N.fit(df, 48, N.TABLES, N.BITS, 150, N.SAMPLE)
    assert index.depth <= N.BITS and not index.below
    code = (x @ index.w) > index.t
    parts = index.parts(x)
    assert np.bincount(parts[:, 0]).max() < 3000 / 2
    hamming = (code[:, None, :] != code[None]).sum(2)
    near = hamming < N.TABLES
    meet = (parts[:, None, :] == parts[None]).any(2)
    assert near.sum() > 2 * len(x) and meet[near].all()


def test_recall_in_a_dense_cloud(spark):
    """A third of all rows lie in one place that no threshold of the whole table cuts; they are no copies."""
    r = np.random.default_rng(8)
    cloud = r.normal(size=(12_000, 48)) * 0.05 + np.repeat(r.normal(size=(600, 48)) * 0.1, 20, 0)
    x = np.concatenate([cloud + 30, r.normal(size=(24_000, 48)) * 4]).astype(np.float32)
    df = spark.createDataFrame(pa.table({"id": np.arange(len(x)), "vector": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 48).cast(pa.list_(pa.float32()))}))
    got = {row["id"]: row["neighbors"] for row in N.knn(df, 10, cap=2000).where("id < 12000 and id % 20 = 0").collect()}
    hit = 0
    for i, own in got.items():
        d = ((x[:12_000] - x[i]) ** 2).sum(1)
        d[i] = np.inf
        hit += len(set(np.argpartition(d, 10)[:10].tolist()) & set(own))
    assert len(got) == 600 and hit / 6000 >= 0.9


@pytest.mark.parametrize("n", [1, 2, 7, 95, 96, 97, 113, 1000, 1537])
@pytest.mark.parametrize("exact", [False, True])
def test_nearest_of_any_number_of_rows(n, exact):
    x = np.random.default_rng(n).normal(size=(n, 8)).astype(np.float32)
    pos, dist = N.nearest(x, np.arange(n), 6, exact)
    d = np.sqrt(((x[:, None, :].astype(float) - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    k = min(6, n - 1)
    assert pos.shape == dist.shape == (n, k)
    assert np.abs(np.sort(dist, 1) - np.sort(d, 1)[:, :k]).max(initial=0) < 1e-3
    assert all(len(set(p)) == k and i not in p for i, p in enumerate(pos.tolist()))


def test_usable_vectors_are_told_by_compiled_code(spark):
    from pyspark.sql import functions as F

    # p1_found and p4_found: a lambda ran for every number of every vector
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), None]), (5, [1.0, float("-inf")]), (6, None), (7, [1.0]), (8, [None, None])], "id bigint, vector array<float>")
    usable = rows.where(V.is_usable(F.col("vector"), 2))
    assert [r["id"] for r in usable.collect()] == [1]
    assert [r["id"] for r in rows.withColumn("vector", F.col("vector").cast("array<double>")).where(V.is_usable(F.col("vector"), 2)).collect()] == [1]
    assert "lambda" not in usable._jdf.queryExecution().executedPlan().toString()
