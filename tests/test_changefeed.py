import json
import random

from sparkvec.operators import changefeed as C

SCHEMA = "segment_no bigint, dataset_name string, seq bigint, entry_ts bigint, op string, record_json string, rec_id string, kind string, version string"


def feed(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)


def brute(rows, state=None):
    best = {}
    for seg, ds, seq, ts, op, rec in rows:
        if seq is None or rec is None:
            continue
        try:
            v = json.loads(rec)
        except ValueError:
            continue
        if v is None:
            continue
        c = (float("-inf") if ts is None else ts, float("-inf") if seg is None else seg)
        if (ds, seq) not in best or c > best[ds, seq][0]:
            best[ds, seq] = (c, op, v)
    alive = dict(state or {})
    for (ds, seq), (_, op, v) in sorted(best.items(), key=lambda x: x[0][1]):
        i = v.get("id") if isinstance(v, dict) else None
        try:
            if isinstance(i, bool) or float(i) != int(float(i)):
                continue
            i = int(float(i))
        except (TypeError, ValueError):
            continue
        o = (op or "").strip().lower()
        if o in ("insert", "put"):
            alive[ds, i] = (seq, dict(v))
        elif o in ("update", "patch") and (ds, i) in alive:
            alive[ds, i] = (seq, {**alive[ds, i][1], **v})
        elif o in ("delete", "tombstone"):
            alive.pop((ds, i), None)
    return alive


def data(n=600, seed=0):
    r = random.Random(seed)
    ops = ["insert", "PUT", "update", "patch ", "Delete", "tombstone", "other", None]
    out = []
    for k in range(n):
        i = 0 if r.random() < 0.4 else r.randrange(8)  # one hot record
        rec = r.choice([json.dumps({"id": i, "a": k}), json.dumps({"id": str(i), "b": k}), json.dumps({"id": float(i), "a": None}), json.dumps({"id": i}), '{"id": 1, "a', None, "null", "[1]", json.dumps({"a": 1}), json.dumps({"id": 1.5})])
        out.append((k, r.choice(["d1", "d2", None]), r.choice([None, *[r.randrange(n // 2)] * 9]), k * 10 + 1 if r.random() < 0.9 else None, r.choice(ops), rec))
    return out + out[:50]


def test_against_brute_force_in_any_order_and_block(spark):
    rows = data()
    want = {(d, i): s for (d, i), (s, _) in brute(rows).items()}
    for block in (10**6, 7):
        random.Random(1).shuffle(rows)
        got = {(r["dataset_name"], r["rec_id"]): r["seq"] for r in C.apply_changes(feed(spark, rows), block=block).collect()}
        assert got == want and len(want) > 5


def test_signed_sums_cancel(spark):
    e = C.deduplicated(feed(spark, data(seed=2)))
    total = C.signed_images(e).groupBy("dataset_name", "rec_id").agg(C.F.sum("weight").alias("w")).collect()
    assert {r["w"] for r in total} <= {0, 1}


def test_base_takes_part(spark):
    base = spark.createDataFrame([("d1", 100, -5), ("d1", 3, -4)], "dataset_name string, rec_id bigint, seq bigint")
    rows = [(1, "d1", 1, 1, "update", '{"id": 100}'), (1, "d1", 2, 1, "delete", '{"id": 3}'), (1, "d1", 3, 1, "update", '{"id": 4}')]
    assert [tuple(r) for r in C.apply_changes(feed(spark, rows), base).collect()] == [("d1", 100, 1)]


def test_record_contents(spark):
    rows = data(seed=4)
    want = brute(rows)
    got = {(r["dataset_name"], r["rec_id"]): r for r in C.current_records(feed(spark, rows)).collect()}
    assert got.keys() == want.keys()
    for k, (seq, fields) in want.items():
        assert got[k]["seq"] == seq
        plain = {f: None if v is None else str(v) for f, v in fields.items()}
        assert dict(got[k]["record"]) == plain


def test_empty_and_long(spark):
    assert C.apply_changes(feed(spark, [])).count() == 0
    assert C.current_records(feed(spark, [])).count() == 0
    long = json.dumps({"id": 1, "t": "x" * 500_000})
    assert C.apply_changes(feed(spark, [(1, "d", 1, 1, "put", long)])).count() == 1


def test_text_after_a_value_is_no_json(spark):
    good = ['{"id": 1}', ' {"id": 1, "a": [1, [2]], "b": "x] ["} ', '{"id": 1, "a": [] }', '[{"id": 1}]', "7", '"x"']
    bad = ['12 65.4, "a": 1', '{"id": 1} x', '{"id": 1}, {"id": 2}', '{"id": 1}] , [2', '{"id": 1}}, {"b": 2', "", " ", "null", "{", '{"id": 1', None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)], "i int, t string")
    got = {r["i"] for r in df.where(C.json_or_null(df["t"]).isNotNull()).collect()}
    assert got == set(range(len(good)))
    rows = [(1, "d", 1, 5, "insert", '{"id": 1}'), (2, "d", 1, 9, "insert", '99 "rev": 1'), (1, "d", 2, 6, "update", '{"id": 1, "x": 2}')]
    assert [tuple(r) for r in C.apply_changes(feed(spark, rows)).collect()] == [("d", 1, 2)]
