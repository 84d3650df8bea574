import datetime as dt

import pytest
from pyspark.sql import functions as F

from sparkvec.operators import indexing as I
from sparkvec.operators import lifecycle as L
from sparkvec.operators.prefix import running

T = [dt.datetime(2024, 1, d) for d in range(1, 10)]


def test_last_writer(spark):
    df = spark.createDataFrame([(1, T[0], "a", 1), (1, T[2], "b", 2), (1, T[2], "c", 3), (2, None, "d", 4), (2, T[0], "e", 5), (None, T[0], "f", 6)], "k bigint, ts timestamp, v string, n int")
    assert {(r["k"], r["v"]) for r in L.last_writer(df, "k", "ts", "n").collect()} == {(1, "b"), (2, "e"), (None, "f")}
    base, new = df.where("n in (1, 5)"), df.where("n in (2, 4)").drop("n")
    assert {(r["k"], r["v"]) for r in L.upserted(base, new, "k", "ts").collect()} == {(1, "b"), (2, "e")}
    same = L.upserted(df.where("n = 2"), df.where("n = 3"), "k", "ts").collect()
    assert [r["v"] for r in same] == ["b"]  # equal timestamps keep what is there


def test_schema_evolution(spark):
    a, b = spark.createDataFrame([(1, 2.0)], "id int, x double"), spark.createDataFrame([(2, "n")], "id int, note string")
    assert L.evolved(a, b).columns == ["id", "x", "note"] and L.evolved(a, b).count() == 2
    with pytest.raises(L.SchemaError):
        L.evolved(a, spark.createDataFrame([(1, "x")], "id int, x string"))
    with pytest.raises(L.SchemaError):
        L.evolved(a, b, dropped=["note"])


def test_expiry_victims_eviction(spark):
    df = spark.createDataFrame([(1, T[0], 86400), (2, T[0], 0), (3, T[0], None), (4, T[0], 86400 * 3), (5, T[1], 86400)], "id int, c timestamp, ttl int")
    now = F.lit(T[2])
    assert sorted(r["id"] for r in L.live(df, F.col("c"), F.col("ttl"), now).collect()) == [2, 3, 4, 5]
    acc = spark.createDataFrame([(1, T[0]), (1, T[5]), (2, T[1]), (3, T[1])], "id int, ts timestamp")
    assert [r["id"] for r in L.victims(acc, 2).collect()] == [2, 3]
    assert [r["id"] for r in L.victims(acc, 3, "lfu").collect()] == [2, 3, 1]
    with pytest.raises(ValueError):
        L.victims(acc, 1, "random")
    d = spark.createDataFrame([("a", 50, T[0], T[3]), ("b", 30, T[1], T[2]), ("c", 40, T[2], T[1])], "name string, bytes bigint, last_access timestamp, created timestamp")
    names = lambda **k: [r["name"] for r in L.evicted(d, **k).collect()]
    assert sorted(names(target=60)) == ["a", "b"] and names(target=200) == [] and names(target=100, policy="oldest") == ["c"]
    assert names(target=100, policy="largest") == ["a"] and names(target=100, policy="largest", written="a") == ["c"]


def test_density_and_tombstones(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(10)], "id int, batch int")
    dead = spark.createDataFrame([(0,), (2,), (4,), (4,), (None,), (77,)], "id int")
    assert L.without_deleted(df, dead).count() == 7
    got = {r["batch"]: (r["size"], r["deleted"], r["density"]) for r in L.density(df, dead, "batch").collect()}
    assert got == {0: (5, 3, 0.4), 1: (5, 0, 1.0)}
    assert [r["batch"] for r in L.density(df, dead, "batch", threshold=0.5).collect()] == [0]


def test_digests(spark):
    a = spark.createDataFrame([(i, T[i % 9]) for i in range(200)], "id bigint, ts timestamp")
    b = a.repartition(7).orderBy(F.desc("id"))
    c = a.where("id <> 5").unionByName(spark.createDataFrame([(5, T[8])], "id bigint, ts timestamp"))
    root = lambda d: L.digest_root(d).first()["digest"]
    assert root(a) == root(b) != root(c)
    assert L.differing_leaves(L.digest_leaves(a), L.digest_leaves(c)).count() == 1
    assert L.digest_root(a.where("false")).count() == 0


def test_clocks_quorum_ring(spark):
    df = spark.createDataFrame([({"a": 1}, {"a": 1}), ({"a": 1}, {"a": 2}), ({"a": 2, "b": 1}, {"a": 2}), ({"a": 1, "b": 0}, {"b": 1}), ({}, {})], "x map<string,bigint>, y map<string,bigint>")
    assert [r[0] for r in df.select(L.clock_order(F.col("x"), F.col("y"))).collect()] == ["equal", "before", "after", "concurrent", "equal"]
    assert df.select(L.clock_merge(F.col("x"), F.col("y")).alias("m")).collect()[3]["m"] == {"a": 1, "b": 1}
    assert [L.quorum(x, 5) for x in ("one", "QUORUM", "all")] == [1, 3, 5]
    keys = spark.range(500)
    o = {r["id"]: r["owners"] for r in L.owners(keys, "id", ["a", "b", "c", "d"], 2).collect()}
    fewer = {r["id"]: r["owners"] for r in L.owners(keys, "id", ["a", "b", "c"], 2).collect()}
    assert all(len(set(v)) == 2 for v in o.values())
    assert all(o[k][0] == fewer[k][0] for k in o if o[k][0] != "d")  # only the lost node's keys move


def test_routing(spark):
    r = spark.createDataFrame([([0.0, 0.0], 1.0, "a"), ([3.0, 0.0], 1.0, "b"), ([0.0, 1.0], 1.0, "a"), ([0.0, 0.0], 1.0, None), (None, 1.0, "c"), ([0.0, 0.0], float("nan"), "d"), ([0.0], 1.0, "e")], "centroid array<float>, radius float, owner_id string")
    q = spark.createDataFrame([(1, [1.6, 0.0])], "query_id bigint, vector array<float>")
    assert [(x["owner_id"], x["rank"]) for x in L.routed(q, r, 5).orderBy("rank").collect()] == [("b", 1)]
    assert L.routed(q, r, 5, slack=2.0).count() == 2


def test_bitmaps_and_filters(spark):
    a, b = I.bitmap(spark.range(0, 100_000, 3)), I.bitmap(spark.range(0, 100_000, 5))
    assert I.count(a).first()["n"] == 33334
    both = sorted(r["id"] for r in I.ids(I.intersection(a, b)).collect())
    assert both == list(range(0, 100_000, 15))
    assert I.count(I.union(a, b)).first()["n"] == 33334 + 20000 - len(both)
    df = spark.createDataFrame([(1, "x", "p"), (2, "x", None), (3, "y", "p")], "id bigint, f string, g string")
    ix = I.inverted(df, "id", "f", "g")
    look = lambda **c: sorted(r["id"] for r in I.ids(I.lookup(ix, c)).collect())
    assert look(f="x") == [1, 2] and look(f="x", g="p") == [1] and look(f="z") == [] and look(h="x") == []
    f = I.bloom(spark.range(1000), "id", 1 << 16)
    got = {r["id"] for r in I.may_contain(spark.range(20_000), "id", f, 1 << 16).collect()}
    assert set(range(1000)) <= got and len(got) < 2000


def test_running_sums(spark, monkeypatch):
    from sparkvec.operators import prefix

    monkeypatch.setattr(prefix, "RANGE_ROWS", 7)
    df = spark.createDataFrame([("g" if i % 3 else None, i, i % 5) for i in range(100)], "k string, id int, n int")
    rows = running(df, ["k"], F.col("n"), ["id"], 100).collect()
    for k in ("g", None):
        own = sorted((r["before"], r["n"]) for r in rows if r["k"] == k)
        at = 0
        for before, n in own:
            assert before == at or n == 0 or before == at
            at = max(at, before + n)
        assert at == sum(n for _, n in own)
    assert len(rows) == 100 and rows[0].asDict().keys() == {"k", "id", "n", "before"}
