import json

from sparkvec.operators import schema_drift as S

VERSIONS = "dataset_name string, schema_version bigint, fields_json string, created_at timestamp, name string, type string"
ROWS = "file_name string, dataset_name string, schema_version bigint, row_no int, written_at timestamp, payload_json string, v string, m string"


def tables(spark, versions, rows):
    v = spark.createDataFrame([(d, n, f if isinstance(f, str) or f is None else json.dumps(f), None, "x", "y") for d, n, f in versions], VERSIONS)
    r = spark.createDataFrame([(f"{d}-{n}", d, n, i, None, p if isinstance(p, str) or p is None else json.dumps(p), "x", "y") for i, (d, n, p) in enumerate(rows)], ROWS)
    return v, r


def changed(spark, versions, rows):
    return {tuple(r)[:4] for r in S.changes(*tables(spark, versions, rows)).collect()}


def test_notations_and_spellings_are_no_change(spark):
    v = [
        ("d", 1, [{"name": "id", "type": "Int64"}, {"name": "t", "type": "timestamp[ns]"}, {"name": "s", "type": "utf8"}]),
        ("d", 2, {"s": "large_utf8", "id": "bigint", "t": "Timestamp"}),
        ("d", 3, "id: long, t: timestamp[us], s: STRING"),
    ]
    assert changed(spark, v, []) == set()


def test_added_removed_retyped(spark):
    v = [("d", 1, "id: int64, a: int32, b: utf8"), ("d", 2, "id: int64, a: double, c: list<item: int32, x>"), ("d", 3, "id: int64, a: double, c: list<item: int32, x>")]
    assert changed(spark, v, []) == {("d", 2, "a", "retyped"), ("d", 2, "b", "removed"), ("d", 2, "c", "added")}


def renaming(value=lambda i: i * 1.5):
    v = [("d", 1, "id: int64, old: double"), ("d", 2, "id: int64, new: double")]
    rows = [("d", 1, {"id": i, "old": i * 1.5}) for i in range(10)] + [("d", 2, {"id": str(i), "new": value(i)}) for i in range(10)]
    return v, rows


def test_renamed_if_values_live_on(spark):
    assert changed(spark, *renaming()) == {("d", 2, "new", "renamed")}
    assert changed(spark, *renaming(lambda i: str(i * 1.5))) == {("d", 2, "new", "renamed")}
    assert changed(spark, *renaming(lambda i: i * 2.5 + 1)) == {("d", 2, "new", "added"), ("d", 2, "old", "removed")}
    v, rows = renaming()
    assert changed(spark, v, []) == {("d", 2, "new", "added"), ("d", 2, "old", "removed")}


def test_versions_without_declaration(spark):
    v = [("d", 1, "id: int64, a: int64"), ("d", 2, None), ("d", 3, "id: int64, a: double, n: bool")]
    rows = [("d", 2, {"id": 1, "a": 2, "n": None}), ("d", 2, {"id": 2})]
    assert changed(spark, v, rows) == {("d", 2, "n", "added"), ("d", 3, "a", "retyped")}


def test_dirt(spark):
    v = [("d", 1, "id: int64, a: int64"), ("d", 1, "id: int64, a: int64"), ("d", 2, '[{"name": "id"'), ("d", 3, "id: int64"), (None, 1, "id: int64"), ("d", None, "x: int64"), ("d", 4, "[]")]
    rows = [("d", 2, {"id": 1, "a": 1}), ("d", 2, '{"id": 1, "b'), ("d", 2, None), (None, 2, {"q": 1}), ("e", 1, {"id": 1})]
    assert changed(spark, v, rows) == {("d", 3, "a", "removed")}
    assert changed(spark, [], []) == set()


def test_unified_follows_names_and_types(spark):
    v = [("d", 1, "id: int64, a: int64"), ("d", 2, "id: int64, b: int64"), ("d", 3, "id: int64, c: string")]
    rows = [("d", n, {"id": i, name: i * 7}) for n, name in ((1, "a"), (2, "b"), (3, "c")) for i in range(1, 6)]
    got = S.unified(*tables(spark, v, rows + rows[:2])).collect()
    # c of version 3 is b of version 2, which is a of version 1
    assert {k for r in got for k in r["cells"]} == {"id", "c"}
    one = next(r for r in got if r["schema_version"] == 1)["cells"]["c"]
    assert one["tag"] == "int64" and one["as_long"] is not None and one["canonical"] == str(one["as_long"])
    alt = {(r["column_name"], r["type"], r["first_version"], r["last_version"]) for r in S.alternatives(*tables(spark, v, rows)).collect()}
    assert ("c", "int64", 1, 2) in alt or ("c", "int64", 1, 3) in alt
    assert S.unified(*tables(spark, [], [])).count() == 0


def test_wide(spark):
    u = S.unified(*tables(spark, *renaming()))
    w = S.wide(u, "d", ["id", "new"]).collect()
    assert len(w) == 20 and all(r["new"] is not None for r in w)


def test_a_name_whose_best_partner_is_taken_chooses_again(spark):
    v = [("d", 1, "id: int64, a: int64, b: int64"), ("d", 2, "id: int64, x: int64, y: int64")]
    y = lambda i: i if i % 20 else i + 1000
    rows = [("d", 1, {"id": i, "a": i, "b": y(i) if i % 10 != 3 else i + 5000}) for i in range(100)] + [("d", 2, {"id": i, "x": i, "y": y(i)}) for i in range(100)]
    assert changed(spark, v, rows) == {("d", 2, "x", "renamed"), ("d", 2, "y", "renamed")}
