import math
import random

from sparkvec.llm import fusion as X

REQ = "query_id bigint, dataset_name string, text_query string, alpha double, graph_alpha double, k int, metric string, requested_at timestamp, total string"
RES = "query_id bigint, id bigint, distance float, text_score double, graph_score double, shard_id int, n string"


def tables(spark, req, res):
    return spark.createDataFrame([(q, "d", t, a, g, k, "m", None, "x") for q, t, a, g, k in req], REQ), spark.createDataFrame([(*r, 0, "x") for r in res], RES)


def brute(req, res):
    out = {}
    for q, t, a, g, _ in set(req):
        a = 0.5 if a is None else a
        use = [a != 0, bool(t and t.strip()) and a != 1, g is not None and g > 0]
        items = {}
        for qq, i, *s in res:
            if qq == q and i is not None:
                s = [None if v is None or math.isnan(v) else v for v in s]
                bad = [s[0], None if s[1] is None else -s[1], None if s[2] is None else -s[2]]
                old = items.get(i, [None] * 3)
                items[i] = [b if o is None else o if b is None else min(o, b) for o, b in zip(old, bad)]
        key = lambda v: math.inf if v is None else v
        for i, v in items.items():
            ranks = [1 + sum(key(w[c]) < key(v[c]) for w in items.values()) if use[c] else None for c in range(3)]
            out[q, i] = (*ranks, sum(1 / (60 + r) for r in ranks if r))
    return out


def data(seed=0):
    r = random.Random(seed)
    pick = lambda *v: r.choice(v)
    req = [(q, pick("some text", "  ", None, "x"), pick(None, 0.0, 1.0, 0.4, -1.0), pick(None, 0.0, 0.3), 2) for q in range(12)]
    req += req[:3]
    res = [(pick(*range(14)), r.randrange(25), pick(r.random(), float("nan"), None, 0.5, 1e30), pick(None, r.random() * 100, 3.0), pick(None, r.random(), float("nan"))) for _ in range(500)]
    return req, res + [(None, 1, 0.1, 1.0, 1.0), (1, None, 0.1, 1.0, 1.0)]


def test_ranks_and_totals(spark):
    req, res = data()
    want = brute(req, res)
    for hot in (10**9, 5):
        got = {(r["query_id"], r["id"]): r for r in X.ranked(*tables(spark, req, res), hot_rows=hot).collect()}
        assert got.keys() == want.keys()
        for k, v in want.items():
            r = got[k]
            assert (r["rank_distance"], r["rank_text_score"], r["rank_graph_score"]) == v[:3]
            assert abs(r["total"] - v[3]) < 1e-12


def test_fused_order(spark):
    req, res = data(1)
    want = brute(req, res)
    for hot in (10**9, 5):
        got = {(r["query_id"], r["fused_rank"]): r["id"] for r in X.fused(*tables(spark, req, res), hot_rows=hot).collect()}
        for q in {k[0] for k in want}:
            order = sorted((-v[3], i) for (qq, i), v in want.items() if qq == q)
            assert [got[q, j + 1] for j in range(len(order))] == [i for _, i in order]


def test_scale_does_not_matter(spark):
    req = [(1, "t", 0.5, 0.0, 1)]
    res = [(1, i, float(i), float(i) * 1e9, None) for i in range(10)]
    same = [(1, i, float(i) * 1e6, float(i), None) for i in range(10)]
    a, b = (sorted((r["id"], r["fused_rank"]) for r in X.fused(*tables(spark, req, x)).collect()) for x in (res, same))
    assert a == b


def test_found(spark):
    req = [(1, "t", 0.5, 0.0, 2), (2, "t", 1.0, None, 1), (3, "t", None, None, 2)]
    res = [(q, i, float(i), float(-i), None) for q in (1, 2, 3) for i in range(10)]
    res[3] = (1, 3, 3.0, -30.0, None)
    # 1: ids 0 and 1 stand apart, but 2 is within the best third; 3: the same
    assert X.found(*tables(spark, req, res)).count() == 0
    res = [(1, i, float(i), float(-i if i < 2 else i), None) for i in range(10)]
    res = [(q, i, d, 100.0 - i if i < 2 else float(i), g) for q, i, d, _, g in res]
    assert sorted(tuple(r) for r in X.found(*tables(spark, req[:1], res)).collect()) == [(1, 0), (1, 1)]


def test_empty(spark):
    for f in (X.ranked, X.fused, X.found):
        assert f(*tables(spark, [], [])).count() == 0
        assert f(*tables(spark, [(1, None, None, None, None)], [])).count() == 0
    # a query that uses no score
    got = X.fused(*tables(spark, [(1, None, 0.0, None, 1)], [(1, 5, 0.1, 1.0, 1.0), (1, 3, 0.2, 1.0, 1.0)])).orderBy("fused_rank").collect()
    assert [r["id"] for r in got] == [3, 5]


def test_found_is_drawn_by_the_total(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(X, "cut", lambda df: seen.append(df._jdf.queryExecution().optimizedPlan().toString()) or df)
    X.found(*tables(spark, *data()))
    assert "(60.0 + cast(rank_distance" in seen[-1]  # the reciprocal sum decides which rows are looked at
