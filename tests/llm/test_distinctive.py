import math
from collections import Counter

from sparkvec.llm import distinctive as D

SCHEMA = "doc_id bigint, text string, tf string, term string, n string"
P = ".,!?;:()[]{}'\"><"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA)


def brute(rows):
    once = {r for r in rows if r[0] is not None and r[1] is not None}
    tf = Counter((i, w) for i, t in once for w in (p.strip(P) for p in t.lower().split()) if w)
    n, r, c, df = sum(tf.values()), Counter(), Counter(), Counter()
    for (i, w), x in tf.items():
        r[i] += x
        c[w] += x
        df[w] += 1
    out = {}
    for (i, w), x in tf.items():
        e = r[i] * c[w] / n
        s = e * (1 - r[i] / n) * (1 - c[w] / n)
        out[i, w] = (x, r[i], df[w], c[w], (x - e) / math.sqrt(s) if s > 0 else 0.0)
    return out


ROWS = [
    (1, "Alpha beta, (beta) gamma! beta"), (2, "alpha alpha 'delta'"), (3, None), (4, ""), (5, "  \n\t "), (None, "alpha beta"), (2, "alpha alpha 'delta'"),
    (6, "x" * 200_000 + " " + "long words " * 5000), (7, "... !!! ()"), (8, "Ünïcode space here"), (9, "alpha"), (9, "beta other text"),
]


def test_scores_against_brute_force(spark):
    want = brute(ROWS)
    for hot in (10_000, 3):  # with and without terms that are joined by shuffle
        got = {(r["doc_id"], r["term"]): (r["tf"], r["doc_len"], r["doc_freq"], r["coll_freq"], r["score"]) for r in D.residuals(docs(spark, ROWS), hot_terms=hot).collect()}
        assert got.keys() == want.keys()
        for k, v in want.items():
            assert got[k][:4] == v[:4] and abs(got[k][4] - v[4]) < 1e-9


def test_found(spark):
    rows = [(i, "common words here") for i in range(20)] + [(100, "rare rare rare and more"), (101, "rare thing"), (102, "only only only"), (103, "rare " * 3 + "pad " * 200)]
    want = {k for k, v in brute(rows).items() if v[0] >= 3 and v[0] * 40 >= v[1] and 2 <= v[2] <= 6}
    assert {tuple(r) for r in D.found(docs(spark, rows)).collect()} == want == {(100, "rare")}


def test_top_terms_and_empty(spark):
    got = D.top_terms(docs(spark, ROWS), 1).collect()
    assert {r["doc_id"] for r in got} == {1, 2, 6, 8, 9}
    assert D.residuals(docs(spark, [])).count() == 0
    one = D.residuals(docs(spark, [(1, "word word")])).collect()
    assert [(r["tf"], r["score"]) for r in one] == [(2, 0.0)]


def test_found_is_drawn_by_the_score(spark):
    plan = D.found(docs(spark, ROWS))._jdf.queryExecution().optimizedPlan().toString()
    assert "SQRT" in plan.upper()
    alone = [(i, "a a a") for i in range(3)]  # one term is all there is: no variance, score 0
    assert {tuple(r) for r in D.found(docs(spark, alone)).collect()} == {(i, "a") for i in range(3)}


def test_top_terms_of_a_hot_record(spark):
    rows = [(1, " ".join(f"t{i}" for i in range(5000)) + " t7 t7"), (2, "t7 t8")]
    got = sorted((r["rank"], r["term"]) for r in D.top_terms(docs(spark, rows), 3).where("doc_id = 1").collect())
    scores = {k[1]: v[4] for k, v in brute(rows).items() if k[0] == 1}
    want = sorted(scores, key=lambda t: (-round(scores[t], 9), t))[:3]
    assert [t for _, t in got] == want
