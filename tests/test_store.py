import datetime as dt
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkvec.api import Client, frame
from sparkvec.operators.filters import leaf
from sparkvec.operators.lifecycle import SchemaError
from sparkvec.plans import request as Q
from sparkvec.sources.store import NotFound, Store, split_path


@pytest.fixture
def client(spark, root):
    c = Client(spark, root)
    c.insert("docs", [{"id": i, "vector": [float(i), 1.0], "text": f"note {i} {'even' if i % 2 == 0 else 'odd'}", "meta": {"n": i}} for i in range(10)])
    return c


def ids(df):
    return [r["id"] for r in df.collect()]


def test_insert_scan_delete(client):
    assert client.info("docs")["rows"] == 10
    client.insert("docs", [{"id": 10, "vector": [10.0, 1.0], "text": "new", "meta": {}, "extra": 1.5}])
    assert "extra" in client.download("docs").columns and client.download("docs").where("extra is null").count() == 10
    client.delete("docs", [3, 4])
    client.delete("docs", [3])
    assert sorted(ids(client.download("docs", (leaf("id", "<", 6),)))) == [0, 1, 2, 5]
    client.insert("docs", [{"id": 3, "vector": [3.0, 1.0], "text": "again", "meta": {}, "extra": 0.0}])
    assert sorted(ids(client.download("docs", (leaf("id", "<", 4),)))) == [0, 1, 2, 3]
    assert len(ids(client.download("docs", limit=2))) == 2 and len(list(client.stream("docs"))) == 10
    client.store.compact("docs")
    assert client.download("docs").count() == 10 and client.store.tombstones("docs") is None
    with pytest.raises(NotFound):
        client.download("nothing")


def test_schema_versions(client, spark):
    s = client.store
    with pytest.raises(SchemaError):
        client.insert("docs", [{"id": "x", "vector": [1.0, 1.0], "text": "t", "meta": {}}])
    s.drop_column("docs", "meta")
    assert "meta" not in s.scan("docs").columns and "meta" in s.schema("docs", 4).names
    with pytest.raises(SchemaError):
        client.insert("docs", [{"id": 1, "vector": [1.0, 1.0], "text": "t", "meta": {}}])


def test_search(client):
    assert ids(client.search("docs", vector=[2.2, 1.0], k=2)) == [2, 3] or sorted(ids(client.search("docs", vector=[2.2, 1.0], k=2))) == [2, 3]
    assert set(ids(client.search("docs", vector=[2.2, 1.0], k=3, filters=[{"field": "id", "op": ">", "value": "5"}]))) == {6, 7, 8}
    assert set(ids(client.search("docs", text_query="7", k=3))) == {7}
    assert len(ids(client.search("docs", vector=[0.0, 1.0], text_query="odd note", k=4, alpha=0.5))) == 4
    assert client.search("docs", vectors=[[0.0, 1.0], [9.0, 1.0]], k=1).count() == 2
    assert "vector" in client.search("docs", vector=[1.0, 1.0], k=1, include_vectors=True).columns
    by = client.search_by_id("docs", 5, 1)
    assert ids(by) == [5]
    client.delete("docs", [5])
    with pytest.raises(NotFound):
        client.search_by_id("docs", 5)
    client.add_edge("docs", 2, "near", 777)
    assert 777 in ids(client.search("docs", vector=[2.0, 1.0], k=3, graph_alpha=0.9))
    assert client.traverse("docs", 2, max_hops=1).count() == 1 and client.graph_stats("docs").first()["edge_count"] == 1


def test_tickets(client):
    assert client.ticket("docs").count() == 10
    t = json.dumps({"name": "docs", "limit": 3, "filters": [{"field": "id", "op": ">=", "value": 4}], "unknown": 1, "search": None})
    assert len(ids(client.ticket(t))) == 3
    s = json.dumps({"search": {"dataset": "docs", "vector": [1, 1], "k": 2}})
    assert client.ticket(s).count() == 2
    for bad in ({"vector": [1.0], "nope": 1}, {"vector": [float("nan")]}, {"vector": [1.0], "k": 0}, {}, {"vector": [1.0], "alpha": 2}):
        with pytest.raises(Q.RequestError):
            Q.parse_search(bad)
    with pytest.raises(Q.RequestError):
        Q.parse_ticket("{bad")
    a = lambda **k: Q.effective_alpha(Q.parse_search(k))
    assert [a(vector=[1]), a(text_query="x"), a(vector=[1], text_query="x"), a(vector=[1], text_query="x", alpha=-1), a(vector=[1], text_query="x", alpha=0.7)] == [1.0, 0.0, 0.5, 0.3, 0.7]


def test_namespaces_lists_snapshots(client, spark, root):
    client.create_namespace("team")
    client.insert("team/a/b", [{"id": 1, "vector": [1.0]}])
    assert split_path("team/a/b") == ("team", "a/b") and split_path("/x") == ("default", "x") and split_path("") == ("default", "")
    assert client.namespaces() == ["default", "team"]
    assert [r["name"] for r in client.list_datasets(more_than=5).collect()] == ["docs"]
    assert client.list_datasets(name_contains="zzz").count() == 0 and client.list_datasets(exactly=10).count() == 1 and client.list_datasets(at_most=9).count() == 0
    client.add_edge("docs", 1, "p", 2)
    client.delete("docs", [0])
    client.snapshot("docs", f"{root}-snap")
    client.drop("docs")
    client.restore("docs", f"{root}-snap")
    assert client.download("docs").count() == 9 and client.graph_stats("docs").first()["edge_count"] == 1
    client.delete_namespace("team")
    with pytest.raises(ValueError):
        client.delete_namespace("default")
    with pytest.raises(NotFound):
        client.delete_namespace("team")


def test_latest_ttl_changes(spark, root):
    s = Store(spark, root)
    rows = lambda *r: spark.createDataFrame(r, "id bigint, ts timestamp, v string").withColumn("ts", F.col("ts"))
    t = [dt.datetime(2024, 1, d) for d in range(1, 5)]
    s.insert("d", rows((1, t[0], "a"), (2, t[0], "b")))
    s.upsert("d", rows((1, t[1], "c"), (2, t[0], "late")))
    assert {(r["id"], r["v"]) for r in s.scan("d", latest=("id", "ts")).collect()} == {(1, "c"), (2, "b")}
    assert s.scan("d", ttl=(F.col("ts"), F.lit(3600), F.lit(t[1]))).count() == 1
    assert s.changes("d", 1).count() == 2 and s.changes("d", 2).count() == 0


def test_frames(spark):
    df = frame(spark, pd.DataFrame({"id": [1], "vector": [[1 + 2j, 3]], "tags": [["a", "b"]], "m": [{"k": 1}]}))
    r = df.first()
    assert r["vector"] == [1.0, 2.0, 3.0, 0.0] and r["tags"] == '["a", "b"]' and r["m"] == '{"k": 1}'


def test_a_crash_between_rows_and_commit_leaves_nothing(spark, root, monkeypatch):
    s = Store(spark, root)
    first, second = (spark.createDataFrame([(i, float(i))], "id bigint, x double") for i in (1, 2))
    s.insert("d", first, "feed", 0)

    def dies(*_):
        raise RuntimeError("lost")

    for step in (lambda: s.insert("d", second, "feed", 1), lambda: s.compact("d")):
        monkeypatch.setattr(Store, "_commit", dies)
        with pytest.raises(RuntimeError):
            step()
        monkeypatch.undo()
        assert ids(s.scan("d")) == [1] and s.applied("d", "feed") == 0
    assert s.insert("d", second, "feed", 1)["status"] == "ok"
    assert s.insert("d", second, "feed", 1)["status"] == "repeated"
    assert sorted(ids(s.scan("d"))) == [1, 2]
    s.delete("d", spark.createDataFrame([(1,)], "id bigint"))
    s.compact("d")
    assert ids(s.scan("d")) == [2] and [r["id"] for r in s.changes("d", 1).collect()] == [2] and s.changes("d", 2).count() == 0


def test_a_snapshot_cut_short_does_not_count(spark, root, tmp_path, monkeypatch):
    s, to = Store(spark, root), f"file://{tmp_path}/snap"
    s.insert("d", spark.createDataFrame([(1,)], "id bigint"))
    s.snapshot("d", to)
    s.insert("d", spark.createDataFrame([(2,)], "id bigint"))

    def dies(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(Store, "_write_text", dies)
    with pytest.raises(RuntimeError):
        s.snapshot("d", to)
    monkeypatch.undo()
    s.restore("e", to)
    assert ids(s.scan("e")) == [1]
    s.snapshot("d", to)
    s.restore("e", to)
    assert sorted(ids(s.scan("e"))) == [1, 2]
    with pytest.raises(NotFound):
        s.restore("e", f"file://{tmp_path}/nothing")


def test_delete_tells_what_was_there(client):
    assert client.delete("docs", [1, 2, 99]) == {"status": "ok", "deleted": 2, "unknown": 1}
    assert client.delete("docs", [1]) == {"status": "ok", "deleted": 0, "unknown": 1}
    assert client.count_datasets() == 1
