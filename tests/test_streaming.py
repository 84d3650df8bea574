import datetime as dt

import pytest
from pyspark.sql import functions as F

from sparkvec.sources.store import Store
from sparkvec.streaming import ingest as S

SCHEMA = "id bigint, user string, ts timestamp, value double, text string"
T = dt.datetime(2024, 1, 1)


@pytest.fixture
def source(spark, tmp_path):
    rows = [(i % 40, f"u{i % 3}", T + dt.timedelta(minutes=i), float(i), f"word{i % 4} more") for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    folder = f"{tmp_path}/in"
    for k in range(3):
        df.where((F.col("value") >= k * 20) & (F.col("value") < (k + 1) * 20)).coalesce(1).write.mode("append").parquet(folder)
    return folder, df


def run(stream, mode, name, spark):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_ingest_once_with_acks(spark, source, tmp_path, root):
    folder, df = source
    store, acks = Store(spark, root), []
    S.into(S.files(spark, folder, df.schema), store, "d", f"{tmp_path}/cp", acks.append, min_rows=100).awaitTermination()
    assert store.scan("d").count() == 60 and sum(a["rows"] for a in acks) == 60 and {a["status"] for a in acks} == {"ok"}
    # the same stream from a lost checkpoint: batches that were written are skipped
    again = []
    S.into(S.files(spark, folder, df.schema), store, "d", f"{tmp_path}/cp2", again.append).awaitTermination()
    assert store.scan("d").count() == 60 and {a["status"] for a in again} == {"repeated"}
    assert S.replay(store, "d", "copy", 1) == 3 and store.scan("copy").count() == 40


def test_windows_match_batch(spark, source):
    folder, df = source
    got = run(S.window_counts(S.files(spark, folder, df.schema), "ts", "user", "value", "10 minutes"), "complete", "w1", spark)
    want = S.window_counts(df, "ts", "user", "value", "10 minutes")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    slide = S.window_counts(df, "ts", "user", "value", "10 minutes", "5 minutes")
    assert slide.agg(F.sum("n")).first()[0] == 120
    assert S.sessions(df, "ts", "user", "2 minutes").count() == 60 and S.sessions(df, "ts", "user", "1 hour").count() == 3


def test_dedupe_latest_terms(spark, source):
    folder, df = source
    assert run(S.deduplicated(S.files(spark, folder, df.schema), ["id"], "ts"), "append", "d1", spark).count() == 40
    last = run(S.latest(S.files(spark, folder, df.schema), "id", "ts", "value"), "update", "l1", spark)
    best = {r["id"]: r["value"] for r in last.groupBy("id").agg(F.max_by("value", "ts").alias("value")).collect()}
    want = {r["id"]: r["value"] for r in df.groupBy("id").agg(F.max_by("value", "ts").alias("value")).collect()}
    assert best == want
    t = {r["term"]: r["n"] for r in run(S.term_counts(S.files(spark, folder, df.schema), "text"), "complete", "t1", spark).collect()}
    assert t["more"] == 60 and t["word1"] == 15


def test_a_crash_in_a_batch_writes_it_once(spark, source, tmp_path, root, monkeypatch):
    folder, df = source
    store, real, calls = Store(spark, root), Store._commit, []

    def dies_once(self, at, meta):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        real(self, at, meta)

    monkeypatch.setattr(Store, "_commit", dies_once)
    q = S.into(S.files(spark, folder, df.schema), store, "d", f"{tmp_path}/cp")
    with pytest.raises(Exception):
        q.awaitTermination()
    S.into(S.files(spark, folder, df.schema), store, "d", f"{tmp_path}/cp").awaitTermination()
    assert store.scan("d").count() == 60
    assert S.replay(store, "d", "copy") == 3 and S.replay(store, "d", "copy") == 3 and store.scan("copy").count() == 60
