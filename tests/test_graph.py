import numpy as np
import pytest

from sparkvec.operators import graph as G

SCHEMA = "subject bigint, predicate string, object bigint, weight double"


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(1, "owns", 2, 1.0), (1, "likes", 3, 0.8), (4, "owns", 5, 1.0), (2, "owns", 4, 0.5), (3, "likes", 1, 0.5), (None, "x", 1, 1.0)], SCHEMA)


def starts(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "start bigint")


def test_lookups_and_stats(edges):
    assert G.by_subject(edges, 1).count() == 2 and G.by_object(edges, 1).count() == 2 and G.by_predicate(edges, "likes").count() == 2
    s = G.stats(edges).first()
    assert (s["edge_count"], s["community_count"], s["predicates"]) == (6, 4, ["likes", "owns", "x"])
    p = G.properties(edges).first()
    assert (p["nodes"], p["edges"], p["avg_degree"]) == (4, 5, 1.25) and abs(p["density"] - 5 / 12) < 1e-12
    e = G.properties(edges.where("false")).first()
    assert tuple(e) == (0, 0, 0.0, 0.0)


def test_traverse(spark, edges):
    got = {tuple(r["nodes"]): r["score"] for r in G.traverse(starts(spark, 1), edges, 3).collect()}
    assert got == {(1, 2): 0.5, (1, 3): 0.4, (1, 2, 4): 0.125, (1, 2, 4, 5): 0.0625}
    back = {tuple(r["nodes"]): r["score"] for r in G.traverse(starts(spark, 1), edges, 1, "in", weighted=False, decay=0.3).collect()}
    assert back == {(1, 3): 0.3}
    both = G.traverse(starts(spark, 1), edges, 1, "both").collect()
    assert sorted(r["nodes"][1] for r in both) == [2, 3, 3]
    assert G.traverse(starts(spark, 1), edges, 0).count() == 3  # two hops by default
    assert G.traverse(starts(spark, 99), edges).count() == 0
    with pytest.raises(ValueError):
        G.traverse(starts(spark, 1), edges, direction="up")


def test_rerank_and_spread(spark, edges):
    r = spark.createDataFrame([(1, 1, 1.0), (1, 3, 0.5)], "query_id bigint, id bigint, score double")
    got = {x["id"]: x["score"] for x in G.rerank(r, edges, 0.5).collect()}
    assert got == {1: 1.25, 3: 1.0, 2: 0.5}
    assert G.rerank(r, edges, 0).count() == 2
    sp = {x["id"]: x["score"] for x in G.spread(r, edges, 0.5, 1).collect()}
    assert abs(sp[2] - 0.25) < 1e-12 and abs(sp[3] - (0.25 + 0.2)) < 1e-12


def test_pagerank(spark, edges):
    r = {x["node"]: x["rank"] for x in G.pagerank(edges, tolerance=1e-10, iterations=200).collect()}
    nodes = [1, 2, 3, 4, 5]
    out = {1: [2, 3], 2: [4], 3: [1], 4: [5]}
    v = np.full(5, 0.2)
    for _ in range(300):
        n = np.full(5, 0.15 / 5) + 0.85 * v[4] / 5
        for a, b in out.items():
            for t in b:
                n[t - 1] += 0.85 * v[a - 1] / len(b)
        v = n
    assert abs(sum(r.values()) - 1) < 1e-9 and all(abs(r[k] - v[k - 1]) < 1e-6 for k in nodes)
    star = spark.createDataFrame([(i, "p", 0, 1.0) for i in range(1, 6)], SCHEMA)
    s = {x["node"]: x["rank"] for x in G.pagerank(star).collect()}
    assert max(s, key=s.get) == 0
    assert G.pagerank(edges.where("false")).count() == 0


def test_labels_and_components(spark):
    clique = [(a, "e", b, 1.0) for g in ((1, 2, 3), (10, 11, 12)) for a in g for b in g if a != b]
    e = spark.createDataFrame(clique, SCHEMA)
    label = {x["node"]: x["label"] for x in G.label_propagation(e, 20).collect()}
    assert label.keys() == {1, 2, 3, 10, 11, 12} and {label[1], label[2], label[3]} & {label[10], label[11], label[12]} == set()
    c = {x["node"]: x["component"] for x in G.components(e).collect()}
    assert c == {1: 1, 2: 1, 3: 1, 10: 10, 11: 10, 12: 10}
    chain = spark.createDataFrame([(i, "e", i + 1, 1.0) for i in range(40)], SCHEMA)
    assert {x["component"] for x in G.components(chain).collect()} == {0}


def test_paths(spark, edges):
    p = spark.createDataFrame([(1, 5), (1, 1), (5, 1), (1, 3)], "start bigint, target bigint")
    got = {(r["start"], r["target"]): (r["hops"], r["path"]) for r in G.paths(p, edges, 4).collect()}
    assert got == {(1, 5): (3, [1, 2, 4, 5]), (1, 1): (0, [1]), (1, 3): (1, [1, 3])}
    assert {(r["start"], r["target"]) for r in G.paths(p, edges, 2).collect()} == {(1, 1), (1, 3)}


def test_proximity(spark):
    n = spark.createDataFrame([(1, 1, 0.0), (1, 2, 1.0)], "query_id bigint, id bigint, distance double")
    assert [tuple(r) for r in G.proximity(n).collect()] == [(1, "near", 2, 0.5)]
