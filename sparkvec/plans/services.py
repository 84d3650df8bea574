"""Queries that go through the store, streams, requests and the client, with the SQL that must give the same rows.

Each works in a new folder of its own in the shared checkpoint folder, over whole tables.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkvec.api import Client
from sparkvec.functions import vector as V
from sparkvec.operators import hybrid, ivf, knn, lifecycle, quantize, text_search
from sparkvec.operators.filters import leaf
from sparkvec.plans import catalog
from sparkvec.plans.catalog import Query
from sparkvec.plans.request import RequestError, parse_search
from sparkvec.session import scratch, table
from sparkvec.sources.store import Store
from sparkvec.streaming import ingest

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
query = catalog.adder(QUERIES, SQL)
EVENTS = "event_id AS id, user_id, event_type, value"


def _events(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select(F.col("event_id").alias("id"), "user_id", "event_type", "value")


def _loaded(s: SparkSession, d: str) -> Store:
    """The events in two batches, one for clicks, with those below 10 deleted in between."""
    store, e = Store(s, scratch(s, "store")), _events(s, d)
    store.insert("events", e.where("event_type = 'click'"))
    store.delete("events", e.where("value < 10").select("id"))
    store.insert("events", e.where("event_type <> 'click'").withColumn("late", F.lit(True)))
    return store


LEFT = "(event_type <> 'click' OR NOT value < 10)"
query("store_scan", f"SELECT {EVENTS} FROM events WHERE {LEFT} AND value >= 5 AND user_id < 100")(lambda s, d: _loaded(s, d).scan("events", (leaf("value", ">=", 5), leaf("user_id", "<", 100)), ["id", "user_id", "event_type", "value"]))
query("store_info", f"SELECT count(*) AS rows, true AS stored FROM events WHERE {LEFT}")(lambda s, d: (lambda r: s.createDataFrame([(r[0], r[1] > 0)], "rows bigint, stored boolean"))(_loaded(s, d).info("events")))
query("store_delete_report", "SELECT count(*) FILTER (event_type = 'click' AND value < 10) AS deleted, count(*) FILTER (event_type <> 'click' AND value < 10) AS unknown FROM events")(lambda s, d: _delete_report(s, d))
query("store_compact", f"SELECT {EVENTS}, event_type <> 'click' AS late FROM events WHERE {LEFT}")(lambda s, d: _compacted(s, d))
query("store_snapshot", f"SELECT {EVENTS}, event_type <> 'click' AS late FROM events WHERE {LEFT}")(lambda s, d: _restored(s, d))
query("store_changes", f"SELECT {EVENTS} FROM events WHERE event_type <> 'click'")(lambda s, d: _loaded(s, d).changes("events", 1).select("id", "user_id", "event_type", "value"))
query("store_versions", "SELECT * FROM (VALUES (4, 'id,user_id,event_type,value'), (5, 'id,user_id,event_type,value,late'), (6, 'id,user_id,event_type,late')) t(version, fields)")(lambda s, d: _versions(s, d))
query("store_list", "SELECT * FROM (SELECT 'customer' AS name, count(*) AS rows FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'region', count(*) FROM region) WHERE rows > 100 AND contains(name, 'o')")(lambda s, d: _listed(s, d))
query("store_namespaces", "SELECT * FROM (VALUES ('default', 1), ('other', 1)) t(namespace, datasets)")(lambda s, d: _namespaces(s, d))
query("store_drop", "SELECT 'customer' AS name FROM (SELECT 1)")(lambda s, d: _dropped(s, d))
query("store_edges", "SELECT l_returnflag AS predicate, count(*) AS edges, round(sum(1 - l_discount), 4) AS weight FROM lineitem GROUP BY 1")(lambda s, d: _stored_edges(s, d).groupBy("predicate").agg(F.count(F.lit(1)).alias("edges"), F.round(F.sum("weight"), 4).alias("weight")))
query("store_upsert", "SELECT user_id AS id, max(ts) AS ts FROM events GROUP BY 1")(lambda s, d: _upserted(s, d))


def _delete_report(s: SparkSession, d: str) -> DataFrame:
    store, e = Store(s, scratch(s, "store")), _events(s, d)
    store.insert("events", e.where("event_type = 'click'"))
    r = store.delete("events", e.where("value < 10").select("id"))
    return s.createDataFrame([(r["deleted"], r["unknown"])], "deleted bigint, unknown bigint")


def _compacted(s: SparkSession, d: str) -> DataFrame:
    store = _loaded(s, d)
    store.compact("events")
    return store.scan("events").withColumn("late", F.coalesce("late", F.lit(False)))


def _restored(s: SparkSession, d: str) -> DataFrame:
    store, to = _loaded(s, d), scratch(s, "snapshot")
    store.snapshot("events", to)
    store.drop("events")
    store.restore("copy", to)
    return store.scan("copy").withColumn("late", F.coalesce("late", F.lit(False)))


def _versions(s: SparkSession, d: str) -> DataFrame:
    store = _loaded(s, d)
    store.drop_column("events", "value")
    return s.createDataFrame([(v, ",".join(store.schema("events", v).names)) for v in (4, 5, 6)], "version int, fields string")


def _filled(s: SparkSession, d: str, *paths: str) -> Store:
    store = Store(s, scratch(s, "store"))
    for p in paths:
        store.insert(p, table(s, d, p.split("/")[-1]))
    return store


def _listed(s: SparkSession, d: str) -> DataFrame:
    return _filled(s, d, "customer", "orders", "region").list(name_contains="o", more_than=100).select("name", "rows")


def _namespaces(s: SparkSession, d: str) -> DataFrame:
    store = _filled(s, d, "region", "other/nation", "gone/region")
    store.delete_namespace("gone")
    return s.createDataFrame([(n, len(store.datasets(n))) for n in store.namespaces()], "namespace string, datasets int")


def _dropped(s: SparkSession, d: str) -> DataFrame:
    store = _filled(s, d, "customer", "region")
    store.drop("region")
    return store.list().select("name")


def _stored_edges(s: SparkSession, d: str) -> DataFrame:
    store = _filled(s, d, "region")
    store.add_edges("region", catalog._edges(s, d))
    return store.edges("region")


def _upserted(s: SparkSession, d: str) -> DataFrame:
    store, e = Store(s, scratch(s, "store")), table(s, d, "events").select(F.col("user_id").alias("id"), "ts", "event_id")
    store.upsert("u", e.where("event_id % 2 = 0"))
    store.upsert("u", e.where("event_id % 2 = 1"))
    return store.scan("u", columns=["id", "ts"], latest=("id", "ts"))


# ---------------------------------------------------------------- requests and the client
def _vectors(s: SparkSession, d: str) -> Client:
    c = Client(s, scratch(s, "store"))
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label").join(table(s, d, "documents").select(F.col("doc_id").alias("id"), "text"), "id")
    c.store.insert("notes", e)
    return c


def _first(s: SparkSession, d: str) -> list[float]:
    return list(table(s, d, "embeddings").where("vec_id = 0").first()["embedding"])


NOTES = "notes AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label, text FROM embeddings JOIN documents ON doc_id = vec_id)"
query("ticket_filter", f"WITH {NOTES} SELECT id, label FROM notes WHERE label >= 3 AND label <> 5")(
    lambda s, d: _vectors(s, d).ticket(json.dumps({"name": "notes", "filters": [{"field": "label", "op": ">=", "value": 3}, {"field": "label", "op": "!=", "value": "5"}], "unknown": 1})).select("id", "label")
)
query("ticket_search", f"WITH {NOTES}, n AS (SELECT a.id, list_distance(a.v, b.embedding::DOUBLE[]) AS d FROM notes a, (SELECT embedding FROM embeddings WHERE vec_id = 0) b WHERE label < 6) SELECT id, round(d, 6) AS distance FROM n ORDER BY round(d, 9), id LIMIT 8")(
    lambda s, d: _vectors(s, d).ticket(json.dumps({"search": {"dataset": "notes", "vector": _first(s, d), "k": 8, "filters": [{"field": "label", "op": "<", "value": 6}]}})).select("id", F.round("distance", 6).alias("distance"))
)
query("ticket_vectors", f"WITH {NOTES}, n AS (SELECT a.id, a.v, list_distance(a.v, b.embedding::DOUBLE[]) AS d FROM notes a, (SELECT embedding FROM embeddings WHERE vec_id = 0) b) SELECT id, round(list_sum(v), 5) AS total FROM n ORDER BY round(d, 9), id LIMIT 4")(
    lambda s, d: _vectors(s, d).search("notes", vector=_first(s, d), k=4, include_vectors=True).select("id", F.round(F.aggregate(V.doubles(F.col("vector")), F.lit(0.0), lambda a, x: a + x), 5).alias("total"))
)
query("client_by_id", f"WITH {NOTES}, n AS (SELECT a.id, list_distance(a.v, b.embedding::DOUBLE[]) AS d FROM notes a, (SELECT embedding FROM embeddings WHERE vec_id = 3) b) SELECT id, row_number() OVER (ORDER BY round(d, 9), id) AS rank FROM n QUALIFY rank <= 6")(
    lambda s, d: _vectors(s, d).search_by_id("notes", 3, 6).select("id", "rank")
)
query("client_by_ids", catalog.knn_sql(k=4, rows="vec_id IN (SELECT doc_id FROM documents)", queries="vec_id % 100 = 0 AND vec_id IN (SELECT doc_id FROM documents)"))(
    lambda s, d: (lambda c: catalog._rounded(c.search_by_ids("notes", c.download("notes").where("id % 100 = 0").select("id"), 4)))(_vectors(s, d))
)
query("client_download", f"WITH {NOTES} SELECT id, label FROM notes WHERE label = 2 AND id NOT IN (SELECT id FROM notes WHERE id % 7 = 0)")(lambda s, d: _downloaded(s, d))
query("client_digest", catalog.SQL["digest_root"])(lambda s, d: (lambda c: (c.insert("e", table(s, d, "events")), c.digest("e", "event_id"))[1])(Client(s, scratch(s, "store"))))


def _downloaded(s: SparkSession, d: str) -> DataFrame:
    c = _vectors(s, d)
    c.store.delete("notes", c.download("notes").where("id % 7 = 0"))
    return c.download("notes", (leaf("label", "=", 2),)).select("id", "label")


# ---------------------------------------------------------------- hybrid pipelines
def _legs_sql(n: int) -> str:
    return f"""WITH {catalog.DOCS}, ask AS (SELECT vec_id AS query_id, text FROM embeddings JOIN documents ON doc_id = vec_id WHERE vec_id % 100 = 0), qt AS (SELECT DISTINCT query_id, term FROM (SELECT query_id, unnest({catalog.TOK}) AS term FROM ask)), {catalog.POST},
    dn AS (SELECT query_id, id, 1 / (1 + distance) AS score FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, list_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS distance FROM embeddings q, embeddings e WHERE q.vec_id IN (SELECT query_id FROM ask)) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), id) <= {n}),
    sp AS (SELECT query_id, id, score FROM (SELECT query_id, id, sum({catalog.BM}) AS score FROM post JOIN df USING (term) JOIN qt USING (term), tot GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) <= {n})"""


def _mixed(s: SparkSession, d: str, **how: object) -> DataFrame:
    e = catalog._emb(s, d)
    q = e.where("id % 100 = 0").join(table(s, d, "documents").select(F.col("doc_id").alias("id"), "text"), "id").select(F.col("id").alias("query_id"), "vector", "text")
    return catalog._short(hybrid.pipeline(q, e, catalog._docs(s, d), 10, **how))


CUT = catalog.CUT
query("pipeline_linear", f"""{_legs_sql(20)}, p AS (SELECT query_id, id, 0.3 * score / greatest(max(score) OVER (PARTITION BY query_id), 1e-4) AS part FROM dn UNION ALL SELECT query_id, id, 0.7 * score / greatest(max(score) OVER (PARTITION BY query_id), 1e-4) FROM sp),
f AS (SELECT query_id, id, sum(part) AS score FROM p GROUP BY ALL) {CUT.format(t="f")}""")(lambda s, d: _mixed(s, d, fusion="linear", alpha=0.3))
query("pipeline_cascade", f"""{_legs_sql(20)}, a AS (SELECT query_id, id, score, 0 AS stage FROM sp UNION ALL SELECT query_id, id, score, 1 FROM dn WHERE (query_id, id) NOT IN (SELECT (query_id, id) FROM sp)),
c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY stage, score DESC, id) AS place FROM a QUALIFY place <= 10) {CUT.format(t="c")}""")(lambda s, d: _mixed(s, d, fusion="cascade"))
query("pipeline_rerank", f"""{_legs_sql(20)}, r AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM dn UNION ALL SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) FROM sp),
g AS (SELECT query_id, id, sum(1.0::DOUBLE / (60 + r)) AS s FROM r GROUP BY ALL), k AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, id) <= 10), f AS (SELECT query_id, id, (1000000 - id)::DOUBLE AS score FROM k) {CUT.format(t="f")}""")(lambda s, d: _mixed(s, d, rerank=lambda b: 1000000.0 - b["id"]))

# ---------------------------------------------------------------- codebooks and checks of requests
query("pq_saved_book", "SELECT vec_id AS id, true AS same FROM embeddings")(lambda s, d: _saved_book(s, d))
query("request_checks", "SELECT * FROM (VALUES ('alpha above 1', false), ('an unknown key', false), ('k of 0', false), ('no question', false), ('not a number', false), ('plain', true), ('text only', true)) t(request, accepted)")(lambda s, d: _checks(s))
query("quorum_sizes", "SELECT n_nationkey::INT AS n, n_nationkey // 2 + 1 AS majority, n_nationkey::INT AS whole FROM nation WHERE n_nationkey > 0")(
    lambda s, d: s.createDataFrame([(n, lifecycle.quorum("quorum", n), lifecycle.quorum("all", n)) for (n,) in table(s, d, "nation").where("n_nationkey > 0").select("n_nationkey").collect()], "n int, majority int, whole int")
)
query("dimension_check", "SELECT vec_id FROM embeddings")(lambda s, d: knn.check_dimension(table(s, d, "embeddings"), "embedding", 64).select("vec_id"))


def _saved_book(s: SparkSession, d: str) -> DataFrame:
    e, at = catalog._emb(s, d), scratch(s, "book")
    book = quantize.pq_train(e, "vector", 8, 16)
    quantize.save_book(s, book, at)
    both = quantize.pq_encode(quantize.pq_encode(e, "vector", book), "vector", quantize.load_book(s, at), "again")
    return both.select("id", (F.col("code") == F.col("again")).alias("same"))


def _checks(s: SparkSession) -> DataFrame:
    asked = {
        "alpha above 1": {"vector": [1.0], "alpha": 2}, "an unknown key": {"vector": [1.0], "nope": 1}, "k of 0": {"vector": [1.0], "k": 0}, "no question": {}, "not a number": {"vector": [float("nan")]},
        "plain": {"vector": [1.0], "alpha": None, "k": 3}, "text only": {"text_query": "a", "alpha": -1},
    }

    def accepted(r: dict) -> bool:
        try:
            parse_search(r)
        except RequestError:
            return False
        return True

    return s.createDataFrame([(n, accepted(r)) for n, r in asked.items()], "request string, accepted boolean")


# ---------------------------------------------------------------- approximate search by cells
query("ivf_all_cells", catalog.knn_sql())(lambda s, d: (lambda e: catalog._rounded(ivf.search(s, ivf.build(e, scratch(s, "ivf"), 16), catalog._asked(e), 10, probes=16)))(catalog._emb(s, d)))
query("ivf_recall", "SELECT vec_id AS query_id, true AS enough FROM embeddings WHERE vec_id % 100 = 0")(
    lambda s, d: (lambda e: knn.recall(ivf.search(s, ivf.build(e, scratch(s, "ivf"), 16), catalog._asked(e), 10, probes=8), knn.batch(catalog._asked(e), e, 10)).select("query_id", (F.col("recall") >= 0.6).alias("enough")))(catalog._emb(s, d))
)
query("ivf_filtered", catalog.knn_sql(rows="label = 1", k=5))(lambda s, d: (lambda e: catalog._rounded(ivf.search(s, ivf.build(e, scratch(s, "ivf"), 8), catalog._asked(e), 5, probes=8, condition="label = 1")))(catalog._emb(s, d)))


# ---------------------------------------------------------------- keyword index
def _indexed(s: SparkSession, d: str) -> text_search.TextIndex:
    """All documents, added in two batches, the second one of which is deleted and added again."""
    index, docs = text_search.TextIndex(s, scratch(s, "index")), catalog._docs(s, d)
    index.add(docs.where("id % 3 <> 0"))
    index.add(docs.where("id % 3 = 0"))
    index.delete(docs.where("id % 3 = 0").select("id"))
    index.add(docs.where("id % 3 = 0"))
    return index


query("index_search", catalog.SQL["bm25_topk"])(lambda s, d: catalog._short(text_search.bm25(_indexed(s, d), catalog._asks(s, d), 10)))
query("index_frequencies", f"WITH {catalog.DOCS} SELECT term, count(DISTINCT id) AS df FROM (SELECT id, unnest(terms) AS term FROM d) GROUP BY term")(lambda s, d: _indexed(s, d).frequencies())
query("index_delete", f"WITH {catalog.DOCS} SELECT term, count(DISTINCT id) AS df FROM (SELECT id, unnest(terms) AS term FROM d WHERE id % 4 <> 0) GROUP BY term")(lambda s, d: (lambda i: (i.delete(catalog._docs(s, d).where("id % 4 = 0").select("id")), i.frequencies())[1])(_indexed(s, d)))
query("index_hybrid", catalog.SQL["hybrid_sparse_only"])(lambda s, d: _index_hybrid(s, d))


def _index_hybrid(s: SparkSession, d: str) -> DataFrame:
    e = catalog._emb(s, d)
    q = e.where("id % 100 = 0").join(table(s, d, "documents").select(F.col("doc_id").alias("id"), "text"), "id").select(F.col("id").alias("query_id"), "vector", "text")
    return catalog._short(hybrid.search(q, e, _indexed(s, d), 10, 0))


# ---------------------------------------------------------------- streams
def _parts(s: SparkSession, d: str, n: int = 3) -> tuple[str, DataFrame]:
    """The events as files in a new folder."""
    at, e = scratch(s, "files"), _events(s, d).join(table(s, d, "events").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts")), "id")
    for i in range(n):
        e.where(F.col("id") % n == i).coalesce(1).write.mode("append").parquet(at)
    return at, e


def _acked(s: SparkSession, d: str, times: int) -> tuple[Store, list[dict]]:
    at, e = _parts(s, d)
    store, acks = Store(s, scratch(s, "store")), []
    for _ in range(times):  # every time from a checkpoint of its own, as after its loss
        ingest.into(ingest.files(s, at, e.schema), store, "events", scratch(s, "state"), acks.append).awaitTermination()
    return store, acks


query("stream_acks", "SELECT 'ok' AS status, 3::BIGINT AS batches, count(*)::BIGINT AS rows FROM events UNION ALL SELECT 'repeated', 3, count(*) FROM events")(
    lambda s, d: s.createDataFrame(_acked(s, d, 2)[1], "status string, batch_id bigint, rows bigint").groupBy("status").agg(F.count(F.lit(1)).alias("batches"), F.sum("rows").alias("rows"))
)
query("stream_ingest_once", f"SELECT {EVENTS} FROM events")(lambda s, d: _acked(s, d, 2)[0].scan("events").drop("ts"))
query("stream_replay", f"SELECT {EVENTS} FROM events")(lambda s, d: _replayed(s, d).drop("ts"))
query("stream_dedupe", "SELECT DISTINCT user_id FROM events")(lambda s, d: (lambda at, e: _run(s, ingest.deduplicated(ingest.files(s, at, e.schema), ["user_id"], "ts", "365 days"), "append").select("user_id"))(*_parts(s, d)))
query("stream_latest", "SELECT user_id, max(ts) AS ts FROM events GROUP BY 1")(
    lambda s, d: (lambda at, e: _run(s, ingest.latest(ingest.files(s, at, e.schema), "user_id", "ts", "value", "365 days", 365 * 86400), "update").groupBy("user_id").agg(F.max("ts").cast("timestamp_ntz").alias("ts")))(*_parts(s, d))
)
query("stream_terms", f"SELECT term, count(*) AS n FROM (SELECT unnest({catalog.TOK}) AS term FROM documents WHERE text IS NOT NULL) GROUP BY 1")(
    lambda s, d: _run(s, ingest.term_counts(s.readStream.schema(table(s, d, "documents").schema).parquet(f"{d}/documents.parquet*"), "text"), "complete")
)
query("stream_index", catalog.SQL["bm25_topk"])(lambda s, d: _stream_indexed(s, d))


def _run(s: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    at = scratch(s, "rows").replace("file://", "")
    name = "rows_" + at[-32:]
    stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
    return s.table(name)


def _replayed(s: SparkSession, d: str) -> DataFrame:
    store, _ = _acked(s, d, 1)
    ingest.replay(store, "events", "copy", 0)
    ingest.replay(store, "events", "copy", 0)  # as after a crash before the number was noted elsewhere
    return store.scan("copy")


def _stream_indexed(s: SparkSession, d: str) -> DataFrame:
    index = text_search.TextIndex(s, scratch(s, "index"))
    rows = s.readStream.schema(table(s, d, "documents").schema).parquet(f"{d}/documents.parquet*")
    ingest.indexed(rows, index, "doc_id", ["text"], scratch(s, "state")).awaitTermination()
    return catalog._short(index.search(catalog._asks(s, d), 10))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
