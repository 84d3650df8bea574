"""All queries of the core with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkvec.functions import text as T
from sparkvec.functions import vector as V
from sparkvec.operators import changefeed, filters, graph, hybrid, indexing, knn, lifecycle, quantize, schema_drift, text_search
from sparkvec.operators.filters import both, either, leaf, negated
from sparkvec.session import table
from sparkvec.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def adder(queries: dict[str, Query], sql: dict[str, str]) -> Callable[..., Callable[[Query], Query]]:
    """``query(name, sql)``, which registers a query and its SQL."""

    def query(name: str, text: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            queries[name] = f
            if text:
                sql[name] = text
            return f

        return add

    return query


query = adder(QUERIES, SQL)


# ---------------------------------------------------------------- change feed and schema drift
P2_SQL = """
WITH valid AS (
  SELECT dataset_name, seq, entry_ts, segment_no, lower(trim(op)) AS op, record_json,
    TRY_CAST(json_extract_string(record_json, '$.id') AS DECIMAL(38, 6)) AS rid
  FROM wal_entries WHERE seq IS NOT NULL AND record_json IS NOT NULL AND json_valid(record_json)
), one AS (
  SELECT dataset_name, seq, arg_max(struct_pack(op, rid, record_json), struct_pack(t := coalesce(entry_ts, -1), s := segment_no, op)) AS e FROM valid GROUP BY ALL
), e AS (
  SELECT dataset_name, seq, e.rid::BIGINT AS rec_id, e.record_json AS record,
    CASE WHEN e.op IN ('insert', 'put') THEN 'I' WHEN e.op IN ('update', 'patch') THEN 'U' WHEN e.op IN ('delete', 'tombstone') THEN 'D' END AS kind
  FROM one WHERE e.rid IS NOT NULL AND e.rid = floor(e.rid)
), last AS (
  SELECT dataset_name, rec_id, max(seq) FILTER (kind = 'I') AS i, max(seq) FILTER (kind = 'U') AS u, max(seq) FILTER (kind = 'D') AS d FROM e GROUP BY ALL
)
SELECT dataset_name, rec_id, greatest(i, u) AS seq FROM last WHERE i IS NOT NULL AND (d IS NULL OR i > d)
"""
P2_FIELDS_SQL = P2_SQL.split("SELECT dataset_name, rec_id, greatest(i, u)")[0] + """, alive AS (SELECT dataset_name, rec_id, greatest(i, u) AS seq, i AS born FROM last WHERE i IS NOT NULL AND (d IS NULL OR i > d)
), f AS (SELECT a.dataset_name, a.rec_id, a.seq, e.seq AS nr, unnest(json_keys(e.record)) AS field, e.record FROM alive a JOIN e ON e.dataset_name IS NOT DISTINCT FROM a.dataset_name AND e.rec_id = a.rec_id AND e.seq >= a.born AND e.kind IN ('I', 'U')
), l AS (SELECT dataset_name, rec_id, seq, field, arg_max(coalesce(json_extract_string(record, '$."' || field || '"'), ''), nr) AS value FROM f GROUP BY ALL)
SELECT dataset_name, rec_id, seq, count(*) AS n_fields, nullif(max(value) FILTER (field = 'category'), '') AS category, round(TRY_CAST(max(value) FILTER (field = 'score') AS DOUBLE), 4) AS score FROM l GROUP BY ALL
"""

P3_SQL = """
WITH given AS (
  SELECT dataset_name AS ds, schema_version AS v, arg_max(fields_json, coalesce(created_at, TIMESTAMP '1970-01-01')) AS f
  FROM schema_versions WHERE fields_json IS NOT NULL AND dataset_name IS NOT NULL AND schema_version IS NOT NULL GROUP BY ALL
), lists AS (SELECT ds, v, unnest(from_json(f, '[{"name":"VARCHAR","type":"VARCHAR"}]')) AS x FROM given WHERE left(f, 1) = '['
), maps AS (SELECT ds, v, f, unnest(json_keys(f)) AS k FROM given WHERE left(f, 1) = '{'
), texts AS (SELECT ds, v, unnest(string_split(f, ',')) AS p FROM given WHERE left(f, 1) NOT IN ('[', '{')
), declared AS (
  SELECT ds, v, x.name AS name, lower(x.type) AS t FROM lists
  UNION ALL SELECT ds, v, k, lower(json_extract_string(f, '$."' || k || '"')) FROM maps
  UNION ALL SELECT ds, v, trim(split_part(p, ':', 1)), lower(trim(split_part(p, ':', 2))) FROM texts
), known AS (
  SELECT ds, v, name, CASE WHEN t LIKE 'timestamp%' THEN 'timestamp' WHEN t IN ('int64', 'long', 'bigint') THEN 'int64' WHEN t IN ('int32', 'int') THEN 'int32'
    WHEN t IN ('float64', 'double') THEN 'float64' WHEN t IN ('float32', 'float') THEN 'float32' WHEN t IN ('utf8', 'large_utf8', 'string') THEN 'string' WHEN t IN ('bool', 'boolean') THEN 'bool' ELSE t END AS t FROM declared
), cells AS (
  SELECT ds, v, k AS name, coalesce(TRY_CAST(json_extract_string(p, '$.id') AS DECIMAL(38, 10))::VARCHAR, json_extract_string(p, '$.id')) AS rec,
    coalesce(TRY_CAST(json_extract_string(p, '$."' || k || '"') AS DECIMAL(38, 10))::VARCHAR, json_extract_string(p, '$."' || k || '"')) AS val
  FROM (SELECT dataset_name AS ds, schema_version AS v, payload_json AS p, unnest(json_keys(payload_json)) AS k FROM batch_rows)
), fields AS (SELECT * FROM known UNION ALL SELECT DISTINCT ds, v, name, NULL FROM cells WHERE (ds, v) NOT IN (SELECT (ds, v) FROM known)
), versions AS (SELECT ds, v, row_number() OVER (PARTITION BY ds ORDER BY v) AS o FROM (SELECT DISTINCT ds, v FROM fields)
), f AS (SELECT *, o - row_number() OVER (PARTITION BY ds, name ORDER BY o) AS life FROM fields JOIN versions USING (ds, v)
), typed AS (
  SELECT *, coalesce(last_value(t IGNORE NULLS) OVER (PARTITION BY ds, name, life ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    first_value(t IGNORE NULLS) OVER (PARTITION BY ds, name, life ORDER BY o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS ty FROM f
), steps AS (SELECT b.ds, b.v, a.v AS pv FROM versions a JOIN versions b ON a.ds = b.ds AND b.o = a.o + 1
), new AS (SELECT s.*, name FROM steps s JOIN fields USING (ds, v) WHERE NOT EXISTS (SELECT 1 FROM fields g WHERE g.ds = s.ds AND g.v = s.pv AND g.name = fields.name)
), gone AS (SELECT s.*, name FROM steps s JOIN fields ON fields.ds = s.ds AND fields.v = s.pv WHERE NOT EXISTS (SELECT 1 FROM fields g WHERE g.ds = s.ds AND g.v = s.v AND g.name = fields.name)
), pairs AS (
  SELECT gone.ds, gone.v, gone.name AS old, new.name, x.rec, max((x.val = y.val)::INT) AS same
  FROM gone JOIN new USING (ds, v) JOIN cells x ON x.ds = gone.ds AND x.v = gone.pv AND x.name = gone.name AND x.val IS NOT NULL
  JOIN cells y ON y.ds = new.ds AND y.v = new.v AND y.name = new.name AND y.val IS NOT NULL AND y.rec = x.rec GROUP BY ALL
), ren AS (SELECT ds, v, old, name FROM pairs GROUP BY ALL HAVING sum(same) >= 0.8 * count(*))
SELECT ds AS dataset_name, v AS schema_version, name AS column_name, 'renamed' AS change_kind FROM ren
UNION ALL SELECT ds, v, name, 'added' FROM new WHERE (ds, v, name) NOT IN (SELECT (ds, v, name) FROM ren)
UNION ALL SELECT ds, v, name, 'removed' FROM gone WHERE (ds, v, name) NOT IN (SELECT (ds, v, old) FROM ren)
UNION ALL SELECT ds, v, name, 'retyped' FROM (SELECT *, lag(ty) OVER (PARTITION BY ds, name, life ORDER BY o) AS before FROM typed) WHERE before <> ty
"""

P3_ROWS_SQL = P3_SQL.split("), versions AS (SELECT ds, v, row_number()")[0] + """), r AS (SELECT DISTINCT dataset_name AS ds, file_name, row_no, schema_version AS v, written_at, payload_json AS p FROM batch_rows WHERE payload_json IS NOT NULL AND json_valid(payload_json)
), k AS (SELECT r.*, unnest(json_keys(p)) AS name FROM r)
SELECT ds AS dataset_name, v AS schema_version, count(*) AS rows, sum(n)::BIGINT AS cells FROM (SELECT ds, v, file_name, row_no, written_at, p, count(f.name) AS n FROM k LEFT JOIN (SELECT DISTINCT ds, v, name FROM fields) f USING (ds, v, name) WHERE (ds, v) IN (SELECT (ds, v) FROM fields) GROUP BY ALL) GROUP BY ALL
"""


def _drift(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return table(s, d, "schema_versions"), table(s, d, "batch_rows")


query("p2_found", P2_SQL)(lambda s, d: changefeed.apply_changes(table(s, d, "wal_entries")))
query("p2_records")(lambda s, d: changefeed.current_records(table(s, d, "wal_entries")))
query("p2_fields", P2_FIELDS_SQL)(
    lambda s, d: changefeed.current_records(table(s, d, "wal_entries")).select("dataset_name", "rec_id", "seq", "n_fields", F.nullif(F.col("record")["category"], F.lit("")).alias("category"), F.round(F.col("record")["score"].try_cast("double"), 4).alias("score"))
)
query("p3_found", P3_SQL)(lambda s, d: schema_drift.changes(*_drift(s, d)).drop("detail"))
query("p3_unified")(lambda s, d: schema_drift.unified(*_drift(s, d)))
query("p3_unified_rows", P3_ROWS_SQL)(lambda s, d: schema_drift.unified(*_drift(s, d)).groupBy("dataset_name", "schema_version").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.size("cells")).alias("cells")))
query("p3_alternatives")(lambda s, d: schema_drift.alternatives(*_drift(s, d), table(s, d, "column_metadata")))


# ---------------------------------------------------------------- scans and filters
def _filtered(name: str, tab: str, columns: str, where: str, *tree: filters.Filter) -> None:
    cols = columns.split(", ")
    query(name, f"SELECT {columns} FROM {tab} WHERE {where}")(lambda s, d: filters.apply(table(s, d, tab), tree).select(*cols))


LI = "l_orderkey, l_linenumber, l_quantity"
_filtered("filter_eq_str", "lineitem", LI, "l_returnflag = 'A'", leaf("l_returnflag", "eq", "A"))
_filtered("filter_neq_str", "lineitem", LI, "l_linestatus <> 'O'", leaf("l_linestatus", "<>", "O"))
_filtered("filter_ordered_int", "lineitem", LI, "l_partkey > 100 AND l_linenumber <= 3", leaf("l_partkey", "gt", 100), leaf("l_linenumber", "<=", 3))
_filtered("filter_ordered_float", "lineitem", LI, "l_discount >= 0.05 AND l_quantity < 24", leaf("l_discount", ">=", 0.05), leaf("l_quantity", "lt", "24"))
_filtered("filter_str_range", "orders", "o_orderkey, o_orderpriority", "o_orderpriority >= '2' AND o_orderpriority < '4'", leaf("o_orderpriority", "ge", "2"), leaf("o_orderpriority", "<", "4"))
_filtered("filter_and_list", "lineitem", LI, "l_returnflag = 'R' AND l_quantity >= 30 AND l_discount < 0.07", leaf("l_returnflag", "=", "R"), leaf("l_quantity", ">=", 30), leaf("l_discount", "<", 0.07))
_filtered("filter_or_tree", "lineitem", LI, "l_returnflag = 'R' OR l_quantity > 48", either(leaf("l_returnflag", "==", "R"), leaf("l_quantity", ">", 48)))
_filtered("filter_not", "lineitem", LI, "NOT (nullif(l_returnflag, 'A') = 'N')", negated(leaf("l_returnflag", "=", "N")))
QUERIES["filter_not"] = lambda s, d: filters.apply(table(s, d, "lineitem").withColumn("l_returnflag", F.nullif("l_returnflag", F.lit("A"))), [negated(leaf("l_returnflag", "=", "N"))]).select(*LI.split(", "))
_filtered("filter_nested", "lineitem", LI, "(l_returnflag = 'A' AND NOT (l_quantity < 10 OR l_linenumber = 2)) OR l_tax = 0.08", either(both(leaf("l_returnflag", "=", "A"), negated(either(leaf("l_quantity", "<", 10), leaf("l_linenumber", "=", 2)))), leaf("l_tax", "=", 0.08)))
_filtered("filter_in", "orders", "o_orderkey, o_orderstatus", "o_orderstatus IN ('F', 'P')", leaf("o_orderstatus", "IN", "F, P"))
_filtered("filter_not_in", "part", "p_partkey, p_size", "p_size NOT IN (1, 5, 7)", leaf("p_size", "not in", "1,5,x,7"))
_filtered("filter_contains", "part", "p_partkey, p_type", "contains(p_type, 'SMALL') OR contains(p_type, 'ON')", either(leaf("p_type", "LIKE", "SMALL"), leaf("p_type", "contains", "ON")))
_filtered("filter_timestamp", "events", "event_id, user_id", "ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-01-20 12:00:00'", leaf("ts", ">=", "2024-01-10T00:00:00Z"), leaf("ts", "<", "2024-01-20T12:00:00Z"))
_filtered("filter_unknown_field", "events", "event_id, user_id", "event_type = 'click'", leaf("no_such", "=", "1"), leaf("event_type", "=", "click"))

_filtered("filter_bool", "lineitem", LI, "(l_quantity > 40) = true", leaf("big", "=", "true"))
QUERIES["filter_bool"] = lambda s, d: filters.apply(table(s, d, "lineitem").withColumn("big", F.col("l_quantity") > 40), [leaf("big", "=", "true")]).select(*LI.split(", "))
query("filter_float32", "SELECT vec_id FROM embeddings WHERE embedding[1] > 0.1::FLOAT AND embedding[2] <= 0.25::FLOAT")(
    lambda s, d: filters.apply(table(s, d, "embeddings").select("vec_id", F.col("embedding")[0].alias("a"), F.col("embedding")[1].alias("b")), [leaf("a", ">", 0.1), leaf("b", "<=", "0.25")]).select("vec_id")
)
query("scan_limit_ordered", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")(lambda s, d: table(s, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50).select("o_orderkey", "o_totalprice"))
query("tombstone_scan", "SELECT event_id, user_id FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE value < 10)")(
    lambda s, d: lifecycle.without_deleted(table(s, d, "events"), table(s, d, "events").where("value < 10").select("event_id"), "event_id").select("event_id", "user_id")
)
query("schema_align_union", "SELECT event_id, user_id, value, NULL::VARCHAR AS props FROM events WHERE event_type = 'click' UNION ALL SELECT event_id, user_id, NULL::DOUBLE, props FROM events WHERE event_type <> 'click'")(
    lambda s, d: lifecycle.evolved(table(s, d, "events").where("event_type = 'click'").select("event_id", "user_id", "value"), table(s, d, "events").where("event_type <> 'click'").select("event_id", "user_id", "props"))
)


# ---------------------------------------------------------------- nearest neighbours
SCALED = "list_transform(embedding::DOUBLE[], lambda x: x * (1 + label))"
DIST = {"euclidean": "list_distance({a}, {b})", "cosine": "list_cosine_distance({a}, {b})", "dot_product": "-list_inner_product({a}, {b})"}


def knn_sql(metric: str = "euclidean", k: int = 10, vec: str = "embedding::DOUBLE[]", rows: str = "TRUE", queries: str = "vec_id % 100 = 0") -> str:
    d = DIST[metric].format(a="q.v", b="r.v")
    score = "-distance" if metric == "dot_product" else "1 / (1 + distance)"
    return f"""WITH e AS (SELECT *, {vec} AS v FROM embeddings),
    d AS (SELECT q.vec_id AS query_id, r.vec_id AS id, {d} AS distance FROM (SELECT * FROM e WHERE {queries}) q, (SELECT * FROM e WHERE {rows}) r),
    n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), id) AS rank FROM d)
    SELECT query_id, id, round(distance, 6) AS distance, round({score}, 6) AS score, rank FROM n WHERE rank <= {k}"""


def _rounded(r: DataFrame) -> DataFrame:
    return r.select("query_id", "id", F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"), "rank")


def _emb(s: SparkSession, d: str, scaled: bool = False) -> DataFrame:
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), V.doubles(F.col("embedding")).alias("vector"), "label")
    return e.withColumn("vector", F.transform("vector", lambda x: x * (1 + F.col("label")))) if scaled else e


def _asked(e: DataFrame) -> DataFrame:
    return e.where("id % 100 = 0").select(F.col("id").alias("query_id"), "vector")


for _m, _n in (("euclidean", "l2"), ("cosine", "cosine"), ("dot_product", "dot")):
    query(f"knn_{_n}", knn_sql(_m, vec=SCALED))(lambda s, d, m=_m: _rounded(knn.batch(_asked(_emb(s, d, True)), _emb(s, d, True), 10, m)))
query("knn_filtered", knn_sql(rows="label <> 0 AND label < 7"))(lambda s, d: _rounded(knn.filtered(_emb(s, d), (F.col("label") != 0) & (F.col("label") < 7), _asked(_emb(s, d)), 10)))
query("knn_bitmap", knn_sql(rows="vec_id IN (SELECT doc_id FROM documents WHERE lang = 'en')"))(
    lambda s, d: _rounded(knn.within(_emb(s, d), table(s, d, "documents").where("lang = 'en'").select(F.col("doc_id").alias("id")), _asked(_emb(s, d)), 10))
)
query("knn_by_id", knn_sql(k=5))(lambda s, d: _rounded(knn.by_id(_emb(s, d), _emb(s, d).where("id % 100 = 0").select("id"), 5)))
query("tombstone_knn", knn_sql(rows="label <> 3"))(lambda s, d: _rounded(knn.batch(_asked(_emb(s, d)), lifecycle.without_deleted(_emb(s, d), _emb(s, d).where("label = 3").select("id")), 10)))
COMPLEX_SQL = """SELECT a.vec_id AS id, round(list_distance(a.v, b.v), 6) AS distance, round(list_sum(list_transform(list_zip(a.v, b.v, range(64)), lambda z: CASE WHEN z[3] % 2 = 0 THEN z[1] * z[2] ELSE -z[1] * z[2] END)), 6) AS dot_real
FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) a, (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0) b"""


def _complex(s: SparkSession, d: str) -> DataFrame:
    e = _emb(s, d).withColumn("q", _emb(s, d).where("id = 0").select("vector").scalar())
    return e.select("id", V.complex_l2(F.col("vector"), F.col("q")).alias("distance"), F.round(V.complex_dot_real(F.col("vector"), F.col("q")), 6).alias("dot_real"))


query("complex_functions", COMPLEX_SQL)(lambda s, d: _complex(s, d).withColumn("distance", F.round("distance", 6)))
query("knn_complex_interleaved", f"SELECT * FROM ({COMPLEX_SQL}) ORDER BY distance, id LIMIT 7")(lambda s, d: _complex(s, d).orderBy("distance", "id").limit(7).withColumn("distance", F.round("distance", 6)))
query("knn_single", "SELECT a.vec_id AS id, round(list_distance(a.v, b.v), 6) AS distance FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) a, (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0) b ORDER BY distance, id LIMIT 12")(
    lambda s, d: knn.single(_emb(s, d), list(_emb(s, d).where("id = 0").first()["vector"]), 12).select("id", F.round("distance", 6).alias("distance"))
)
query("knn_merge_scores", knn_sql("dot_product").replace("SELECT query_id, id, round(distance, 6) AS distance, round(-distance, 6) AS score, rank", "SELECT query_id, id, round(-distance, 6) AS score, rank"))(
    lambda s, d: knn.merged(10, *[knn.batch(_asked(_emb(s, d)), _emb(s, d).where(F.pmod(F.xxhash64("id"), F.lit(3)) == i), 10, "dot_product") for i in range(3)], by="score", descending=True).select("query_id", "id", F.round("score", 6).alias("score"), "rank")
)
query("knn_zero_norm", knn_sql("cosine", vec="list_transform(embedding::DOUBLE[], lambda x: CASE WHEN label = 3 THEN 0 ELSE x END)").replace("list_cosine_distance(q.v, r.v)", "CASE WHEN list_sum(q.v) = 0 AND list_max(q.v) = 0 OR list_max(r.v) = 0 AND list_min(r.v) = 0 THEN 1 ELSE list_cosine_distance(q.v, r.v) END"))(
    lambda s, d: (lambda e: _rounded(knn.batch(_asked(e), e, 10, "cosine")))(_emb(s, d).withColumn("vector", F.transform("vector", lambda x: F.when(F.col("label") == 3, 0.0).otherwise(x))))
)
for _kind, _hi, _lo in (("int16", 32767, -32768), ("uint8", 255, 0), ("int32", 2**31 - 1, -(2**31))):
    query(f"vector_as_{_kind}", f"SELECT vec_id AS id, list_sum(list_transform(embedding::DOUBLE[], lambda x: least(greatest(trunc(x * 100000), {_lo}), {_hi})))::BIGINT AS total FROM embeddings")(
        lambda s, d, kind=_kind: _emb(s, d).select("id", F.aggregate(V.integers(F.transform("vector", lambda x: x * 100000), kind), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))
    )
query("vector_as_float16")(lambda s, d: _emb(s, d).select("id", F.round(V.l2(F.col("vector"), V.half(F.col("vector"))), 6).alias("error")))
query("recall_of_shard", f"WITH f AS ({knn_sql(rows='vec_id % 2 = 0')}), e AS ({knn_sql()}) SELECT e.query_id, round(avg((f.id IS NOT NULL)::INT), 6) AS recall FROM e LEFT JOIN f ON e.query_id = f.query_id AND e.id = f.id GROUP BY e.query_id")(
    lambda s, d: knn.recall(knn.batch(_asked(_emb(s, d)), _emb(s, d).where("id % 2 = 0"), 10), knn.batch(_asked(_emb(s, d)), _emb(s, d), 10)).select("query_id", F.round("recall", 6).alias("recall"))
)
INT8 = "list_transform(embedding::DOUBLE[], lambda x: CAST(floor(x * 127 + 0.5) AS DOUBLE))"
query("knn_int8_cast", knn_sql(vec=INT8))(
    lambda s, d: (lambda e: _rounded(knn.batch(_asked(e), e, 10)))(_emb(s, d).withColumn("vector", F.transform("vector", lambda x: F.floor(x * 127 + 0.5).cast("tinyint"))))
)
query("knn_sharded_merge", f"SELECT query_id, id, distance, rank FROM ({knn_sql()})")(
    lambda s, d: knn.merged(10, *[knn.batch(_asked(_emb(s, d)), _emb(s, d).where(F.pmod(F.xxhash64("id"), F.lit(4)) == i), 10) for i in range(4)]).select("query_id", "id", F.round("distance", 6).alias("distance"), "rank")
)
query("knn_include_vectors", f"SELECT k.query_id, k.id, k.rank, round(list_inner_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS norm FROM ({knn_sql()}) k JOIN embeddings e ON e.vec_id = k.id")(
    lambda s, d: knn.with_vectors(knn.batch(_asked(_emb(s, d)), _emb(s, d), 10), _emb(s, d)).select("query_id", "id", "rank", F.round(V.dot(F.col("vector"), F.col("vector")), 6).alias("norm"))
)
query("vector_functions", """SELECT a.vec_id AS id, round(list_distance(a.v, b.v), 6) AS l2, round(list_distance(a.v, b.v) ** 2, 6) AS l2_squared, round(list_cosine_distance(a.v, b.v), 6) AS cosine, round(list_inner_product(a.v, b.v), 6) AS dot, round(list_min(a.v), 6) AS lo, round(list_max(a.v), 6) AS hi
FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) a, (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0) b""")(
    lambda s, d: (lambda e, q: e.withColumn("q", q).select("id", F.round(V.l2(F.col("vector"), F.col("q")), 6).alias("l2"), F.round(V.l2_squared(F.col("vector"), F.col("q")), 6).alias("l2_squared"), F.round(V.cosine(F.col("vector"), F.col("q")), 6).alias("cosine"), F.round(V.dot(F.col("vector"), F.col("q")), 6).alias("dot"), F.round(V.bounds(F.col("vector"))["lo"], 6).alias("lo"), F.round(V.bounds(F.col("vector"))["hi"], 6).alias("hi")))(
        _emb(s, d), _emb(s, d).where("id = 0").select("vector").scalar()
    )
)

# ---------------------------------------------------------------- quantization
query("sq8_train", "SELECT (i - 1)::INT AS dim, min(x) AS lo, CASE WHEN max(x) = min(x) THEN min(x) + 1e-7 ELSE max(x) END AS hi FROM (SELECT unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY i")(lambda s, d: quantize.sq8_train(_emb(s, d), "vector"))
query("sq8_global", "SELECT min(list_min(embedding::DOUBLE[])) AS lo, max(list_max(embedding::DOUBLE[])) AS hi FROM embeddings")(lambda s, d: quantize.sq8_global(_emb(s, d), "vector"))


def _sq8(s: SparkSession, d: str) -> DataFrame:
    e = _emb(s, d)
    lo, hi = quantize.sq8_bounds(e, "vector")
    c = e.withColumn("code", quantize.sq8_encode(F.col("vector"), lo, hi))
    return c.select("id", F.aggregate("code", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("code_sum"), F.round(V.l2(F.col("vector"), quantize.sq8_decode(F.col("code"), lo, hi)), 6).alias("error"))


query("sq8_roundtrip_error", """WITH x AS (SELECT vec_id AS id, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
b AS (SELECT i, min(x) AS lo, CASE WHEN max(x) = min(x) THEN min(x) + 1e-7 ELSE max(x) END AS hi FROM x GROUP BY i),
c AS (SELECT id, x, lo, hi, floor((least(greatest(x, lo), hi) - lo) * 255.0::DOUBLE / (hi - lo)) AS q FROM x JOIN b USING (i))
SELECT id, sum(q)::BIGINT AS code_sum, round(sqrt(sum((x - (lo + q * (hi - lo) / 255.0::DOUBLE)) ** 2)), 6) AS error FROM c GROUP BY id""")(_sq8)


def _bq(s: SparkSession, d: str) -> DataFrame:
    e = _emb(s, d).select("id", quantize.bq_encode(F.col("vector"), 64).alias("code"))
    return quantize.bq_search(e.where("id % 100 = 0").select(F.col("id").alias("query_id"), "code"), e, 10)


query("bq_hamming_knn", """WITH q AS (SELECT vec_id AS query_id, embedding AS a FROM embeddings WHERE vec_id % 100 = 0),
h AS (SELECT query_id, vec_id AS id, list_sum(list_transform(list_zip(a, embedding), lambda z: ((z[1] > 0) <> (z[2] > 0))::INT))::BIGINT AS hamming FROM q, embeddings),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hamming, id) AS rank FROM h) SELECT * FROM n WHERE rank <= 10""")(_bq)


def _adc(s: SparkSession, d: str) -> DataFrame:
    import numpy as np

    rows = sorted(_emb(s, d).where("id % 100 = 0").select("id", "vector").collect())  # the codebook: the stated set
    book = np.array([r["vector"] for r in rows]).reshape(len(rows), 8, 8).transpose(1, 0, 2)
    code = quantize.pq_encode(_emb(s, d), "vector", book)
    return code.select("id", F.round(quantize.adc_distance(F.col("code"), quantize.adc_table(rows[0]["vector"], book)), 6).alias("distance"))


query("adc_fixed_codebook", """WITH parts AS (SELECT vec_id AS id, p, list_slice(embedding::DOUBLE[], p * 8 + 1, p * 8 + 8) AS v FROM embeddings, range(8) t(p)),
book AS (SELECT * FROM parts WHERE id % 100 = 0),
c AS (SELECT a.id, a.p, arg_min(b.id, struct_pack(d := round(list_distance(a.v, b.v) ** 2, 9), i := b.id)) AS c FROM parts a JOIN book b ON a.p = b.p GROUP BY a.id, a.p),
t AS (SELECT b.p, b.id AS c, list_distance(b.v, q.v) ** 2 AS d FROM book b JOIN parts q ON q.p = b.p AND q.id = 0)
SELECT c.id, round(sqrt(sum(t.d)), 6) AS distance FROM c JOIN t ON t.p = c.p AND t.c = c.c GROUP BY c.id""")(_adc)

SIGNS = "list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END)"
query("bq_decode", f"SELECT vec_id AS id, list_sum({SIGNS})::BIGINT AS total, round(1 - list_sum(list_transform(list_zip({SIGNS}, (SELECT {SIGNS} FROM embeddings WHERE vec_id = 0)), lambda z: (z[1] <> z[2])::INT)) / 64.0::DOUBLE, 6) AS similarity FROM embeddings")(
    lambda s, d: (lambda e, q: e.withColumn("q", q).select("id", F.aggregate(quantize.bq_decode(F.col("code"), 64), F.lit(0.0), lambda a, x: a + x).cast("bigint").alias("total"), F.round(quantize.bq_similarity(F.col("code"), F.col("q"), 64), 6).alias("similarity")))(
        *(lambda e: (e, e.where("id = 0").select("code").scalar()))(_emb(s, d).select("id", quantize.bq_encode(F.col("vector"), 64).alias("code")))
    )
)
query("sign_words", f"SELECT vec_id AS id, list_sum(list_transform({SIGNS}, lambda x: (x > 0)::INT))::BIGINT AS ones FROM embeddings")(lambda s, d: _emb(s, d).select("id", F.bit_count(quantize.as_signs(F.col("vector"))[0]).cast("bigint").alias("ones")))
query("byte_vectors", "SELECT vec_id AS id, list_sum(list_transform(embedding::DOUBLE[], lambda x: trunc(least(greatest(x * 1000, 0), 255))))::BIGINT AS total FROM embeddings")(
    lambda s, d: _emb(s, d).select("id", F.aggregate(quantize.as_bytes(F.transform("vector", lambda x: x * 1000)), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))
)
SCALE = "b AS (SELECT min(list_min(embedding::DOUBLE[])) AS lo, max(list_max(embedding::DOUBLE[])) AS hi FROM embeddings), c AS (SELECT vec_id AS id, list_transform(embedding::DOUBLE[], lambda x: floor((x - lo) * 255.0::DOUBLE / (hi - lo))) AS code, lo, hi, embedding::DOUBLE[] AS v FROM embeddings, b)"


def _scale(s: SparkSession, d: str) -> tuple[DataFrame, float, float]:
    lo, hi = quantize.sq8_global(_emb(s, d), "vector").first()
    return _emb(s, d).withColumn("code", quantize.sq8_encode_scale(F.col("vector"), lo, hi)), lo, hi


query("sq8_one_scale", f"WITH {SCALE} SELECT id, list_sum(code)::BIGINT AS code_sum, round(list_distance(v, list_transform(code, lambda q: lo + q * (hi - lo) / 255.0::DOUBLE)), 6) AS error FROM c")(
    lambda s, d: (lambda c, lo, hi: c.select("id", F.aggregate("code", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("code_sum"), F.round(V.l2(F.col("vector"), quantize.sq8_decode_scale(F.col("code"), lo, hi)), 6).alias("error")))(*_scale(s, d))
)
query("sq8_code_distances", f"WITH {SCALE}, q AS (SELECT code AS q FROM c WHERE id = 0) SELECT id, round(list_distance(code, q) ** 2)::BIGINT AS l2_squared, round(list_cosine_distance(code, q), 6) AS cosine FROM c, q")(
    lambda s, d: (lambda c: c.withColumn("q", c.where("id = 0").select("code").scalar()).select("id", quantize.sq8_code_l2(F.col("code"), F.col("q")).alias("l2_squared"), F.round(quantize.sq8_code_cosine(F.col("code"), F.col("q")), 6).alias("cosine")))(_scale(s, d)[0])
)
query("sq8_knn", f"WITH {SCALE}, d AS (SELECT q.id AS query_id, r.id, list_distance(q.code, r.code) AS distance FROM c q, c r WHERE q.id % 100 = 0), n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), id) AS rank FROM d) SELECT query_id, id, round(distance, 6) AS distance, round(1 / (1 + distance), 6) AS score, rank FROM n WHERE rank <= 10")(
    lambda s, d: (lambda c: _rounded(knn.batch(c.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("code").alias("vector")), c.select("id", F.col("code").alias("vector")), 10)))(_scale(s, d)[0])
)


def _pq(s: SparkSession, d: str) -> DataFrame:
    e = _emb(s, d)
    book = quantize.pq_train(e, "vector", 8, 64)
    c = quantize.pq_encode(e, "vector", book)
    near = V.l2(F.col("vector"), quantize.pq_decode(F.col("code"), book))
    own = c.select("id", F.round(near, 6).alias("error"), (near <= 0.8 * V.l2(F.col("vector"), F.transform("vector", lambda x: x * 0))).alias("near"))
    return own.select("id", F.col("error").isNotNull().alias("decoded"), "near")


query("pq_train_decode", "SELECT vec_id AS id, true AS decoded, true AS near FROM embeddings")(_pq)

# ---------------------------------------------------------------- keyword search
TOK = "list_filter(list_transform(string_split_regex(lower(text), '\\s+'), lambda x: trim(x, '.,!?;:()[]{}''\"><')), lambda x: x <> '')"
DOCS = f"docs AS (SELECT doc_id AS id, {TOK} AS terms FROM documents WHERE text IS NOT NULL), d AS (SELECT *, len(terms) AS len FROM docs WHERE len(terms) > 0), tot AS (SELECT count(*) AS n, avg(len) AS avgdl FROM d)"
ASK = f"ask AS (SELECT DISTINCT query_id, text_query AS text FROM search_requests WHERE query_id % 100 = 0 AND text_query IS NOT NULL), qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({TOK}) AS term FROM ask) GROUP BY ALL)"
POST = "flat AS (SELECT id, len, unnest(terms) AS term FROM d), post AS (SELECT id, len, term, count(*) AS tf FROM flat WHERE term IN (SELECT term FROM qt) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM post GROUP BY ALL)"
IDF = "ln((n - df + 0.5) / (df + 0.5) + 1.0)"
BM = f"{IDF} * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / avgdl))"


def _ranked_sql(score: str, k: int = 10, where: str = "TRUE") -> str:
    return f"""WITH {DOCS}, {ASK}, {POST}, s AS (SELECT query_id, id, sum({score}) AS score FROM post JOIN df USING (term) JOIN qt USING (term), tot WHERE {where} GROUP BY ALL),
    n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM s) SELECT query_id, id, round(score, 6) AS score, rank FROM n WHERE rank <= {k}"""


def _docs(s: SparkSession, d: str) -> DataFrame:
    return text_search.documents(table(s, d, "documents"), "doc_id", "text")


def _asks(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "search_requests").where("query_id % 100 = 0 and text_query is not null").select("query_id", F.col("text_query").alias("text")).distinct()


def _short(r: DataFrame) -> DataFrame:
    return r.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


query("tokenize_counts", f"WITH {DOCS} SELECT id, len(terms)::BIGINT AS terms, len(list_distinct(terms))::BIGINT AS distinct_terms FROM d")(
    lambda s, d: _docs(s, d).select("id", F.size("terms").cast("bigint").alias("terms"), F.size(F.array_distinct("terms")).cast("bigint").alias("distinct_terms"))
)
query("bm25_df_idf", f"WITH {DOCS}, f AS (SELECT term, count(DISTINCT id) AS df FROM (SELECT id, unnest(terms) AS term FROM d) GROUP BY term) SELECT term, df, round({IDF}, 6) AS idf FROM f, tot")(lambda s, d: text_search.document_frequencies(_docs(s, d)).select("term", "df", F.round("idf", 6).alias("idf")))
query("bm25_topk", _ranked_sql(BM))(lambda s, d: _short(text_search.bm25(_docs(s, d), _asks(s, d), 10)))
query("bm25_filtered", _ranked_sql(BM, where="id IN (SELECT doc_id FROM documents WHERE source = 'runbook')"))(
    lambda s, d: _short(text_search.bm25(_docs(s, d), _asks(s, d), 10, table(s, d, "documents").where("source = 'runbook'").select(F.col("doc_id").alias("id"))))
)
query("tf_topk", _ranked_sql("times * tf / len"))(lambda s, d: _short(text_search.term_frequency(_docs(s, d), _asks(s, d), 10)))
query("tfidf_topk", _ranked_sql(f"(1 + ln(tf)) * (1 + {IDF})"))(lambda s, d: _short(text_search.tf_idf(_docs(s, d), _asks(s, d), 10)))

# ---------------------------------------------------------------- fusion
LEGS = """dense AS (SELECT query_id, id, -distance::DOUBLE AS score FROM search_results WHERE distance IS NOT NULL AND NOT isnan(distance)),
dn AS (SELECT query_id, id, max(score) AS score FROM dense GROUP BY ALL),
sp AS (SELECT query_id, id, max(text_score) AS score FROM search_results WHERE text_score IS NOT NULL AND NOT isnan(text_score) GROUP BY ALL)"""


def _legs(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    r = table(s, d, "search_results")
    dense = r.where("distance is not null and not isnan(distance)").select("query_id", "id", (-F.col("distance").cast("double")).alias("score"))
    sparse = r.where("text_score is not null and not isnan(text_score)").select("query_id", "id", F.col("text_score").alias("score"))
    return hybrid.best_of(dense), hybrid.best_of(sparse)


CUT = "SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, id) AS rank FROM {t} QUALIFY rank <= 10"
query("rrf_fusion", f"""WITH {LEGS}, p AS (SELECT query_id, id, 1.0::DOUBLE / (60 + row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)) AS part FROM dn UNION ALL SELECT query_id, id, 1.0::DOUBLE / (60 + row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)) FROM sp),
f AS (SELECT query_id, id, sum(part) AS score FROM p GROUP BY ALL) {CUT.format(t="f")}""")(lambda s, d: _short(hybrid.rrf(10, *_legs(s, d))))
query("linear_fusion", f"""WITH {LEGS}, p AS (SELECT query_id, id, 0.3 * score / greatest(max(score) OVER (PARTITION BY query_id), 1e-4) AS part FROM dn UNION ALL SELECT query_id, id, 0.7 * score / greatest(max(score) OVER (PARTITION BY query_id), 1e-4) FROM sp),
f AS (SELECT query_id, id, sum(part) AS score FROM p GROUP BY ALL) {CUT.format(t="f")}""")(lambda s, d: _short(hybrid.linear(10, *_legs(s, d), 0.3)))
query("cascade_fusion", f"""WITH {LEGS}, a AS (SELECT query_id, id, score, 0 AS stage FROM sp WHERE id % 3 <> 0 UNION ALL SELECT query_id, id, score, 1 FROM dn WHERE id % 3 <> 0 AND (query_id, id) NOT IN (SELECT (query_id, id) FROM sp)),
c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY stage, score DESC, id) AS place FROM a QUALIFY place <= 10) {CUT.format(t="c")}""")(
    lambda s, d: _short(hybrid.cascade(10, _legs(s, d)[1], _legs(s, d)[0], table(s, d, "vectors").where("id % 3 <> 0").select("id").unionByName(table(s, d, "search_results").where("id % 3 <> 0").select("id"))))
)
query("dedupe_max", f"WITH {LEGS} SELECT query_id, id, round(max(score), 6) AS score FROM (SELECT * FROM dn UNION ALL SELECT * FROM sp) GROUP BY ALL")(lambda s, d: hybrid.best_of(*_legs(s, d)).select("query_id", "id", F.round("score", 6).alias("score")))
query("auto_alpha", "WITH q AS (SELECT DISTINCT query_id, len(list_filter(string_split_regex(text_query, '\\s+'), lambda x: x <> '')) AS n FROM search_requests WHERE text_query IS NOT NULL) SELECT query_id, CASE WHEN n < 3 THEN 0.3::DOUBLE WHEN n <= 5 THEN 0.5::DOUBLE ELSE 0.8::DOUBLE END AS alpha FROM q")(
    lambda s, d: table(s, d, "search_requests").where("text_query is not null").select("query_id", hybrid.auto_alpha(T.fields(F.col("text_query"))).alias("alpha")).distinct()
)


def _hybrid(s: SparkSession, d: str, alpha: float, keep: DataFrame | None = None) -> DataFrame:
    e = _emb(s, d)
    q = e.where("id % 100 = 0").join(table(s, d, "documents").select(F.col("doc_id").alias("id"), "text"), "id").select(F.col("id").alias("query_id"), "vector", "text")
    return _short(hybrid.search(q, e, _docs(s, d), 10, alpha, keep=keep))


def _hybrid_sql(alpha: float, rows: str = "TRUE", docs: str = "TRUE") -> str:
    n = 10 if alpha in (0, 1) else 20
    dense = f"SELECT query_id, id, 1 / (1 + distance) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), id) AS r FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, list_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS distance FROM embeddings q, embeddings e WHERE q.vec_id IN (SELECT query_id FROM ask) AND e.vec_id IN (SELECT vec_id FROM embeddings WHERE {rows})) QUALIFY r <= {n}"
    sparse = f"SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS r FROM (SELECT query_id, id, sum({BM}) AS score FROM post JOIN df USING (term) JOIN (SELECT DISTINCT query_id, term FROM qt) USING (term), tot WHERE {docs} GROUP BY ALL) QUALIFY r <= {n}"
    ask = ASK.replace("SELECT DISTINCT query_id, text_query AS text FROM search_requests WHERE query_id % 100 = 0 AND text_query IS NOT NULL", "SELECT vec_id AS query_id, text FROM embeddings JOIN documents ON doc_id = vec_id WHERE vec_id % 100 = 0")
    fused = {1: "SELECT query_id, id, score FROM dn", 0: "SELECT query_id, id, score FROM sp"}.get(alpha, "SELECT query_id, id, sum(1.0::DOUBLE / (60 + r)) AS score FROM (SELECT * FROM dn UNION ALL SELECT * FROM sp) GROUP BY ALL")
    return f"WITH {DOCS}, {ask}, {POST}, dn AS ({dense}), sp AS ({sparse}), f AS ({fused}) {CUT.format(t='f')}"


query("hybrid_alpha_half", _hybrid_sql(0.5))(lambda s, d: _hybrid(s, d, 0.5))
query("hybrid_dense_only", _hybrid_sql(1))(lambda s, d: _hybrid(s, d, 1))
query("hybrid_sparse_only", _hybrid_sql(0))(lambda s, d: _hybrid(s, d, 0))
query("hybrid_filtered", _hybrid_sql(0.5, "label < 5", "id IN (SELECT vec_id FROM embeddings WHERE label < 5)"))(lambda s, d: _hybrid(s, d, 0.5, _emb(s, d).where("label < 5").select("id")))

# ---------------------------------------------------------------- graph
EDGES = "e AS (SELECT l_suppkey AS subject, l_returnflag AS predicate, 1000000 + l_partkey AS object, round(1 - l_discount, 2) AS weight FROM lineitem)"


def _edges(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").select(F.col("l_suppkey").alias("subject"), F.col("l_returnflag").alias("predicate"), (F.col("l_partkey") + 1000000).alias("object"), F.round(1 - F.col("l_discount"), 2).alias("weight"))


def _near(s: SparkSession, d: str) -> DataFrame:
    e = _emb(s, d)
    return graph.proximity(knn.batch(e.select(F.col("id").alias("query_id"), "vector"), e, 6).where("query_id <> id").where("rank <= 6"))


NEAR = """nn AS (SELECT a.vec_id AS s, b.vec_id AS t, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d FROM embeddings a, embeddings b),
nk AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY round(d, 9), t) AS r FROM nn QUALIFY r <= 6),
e AS (SELECT s AS subject, 'near' AS predicate, t AS object, 1 / (1 + d) AS weight FROM nk WHERE s <> t)"""

query("graph_stats", f"WITH {EDGES} SELECT count(*) AS edge_count, count(DISTINCT subject) AS community_count, array_to_string(list_sort(list(DISTINCT predicate)), ',') AS predicates FROM e")(lambda s, d: graph.stats(_edges(s, d)).withColumn("predicates", F.array_join("predicates", ",")))
query("edges_by_predicate", f"WITH {EDGES} SELECT subject, object, weight FROM e WHERE predicate = 'R'")(lambda s, d: graph.by_predicate(_edges(s, d), "R").select("subject", "object", "weight"))
query("edges_by_subject_object", f"WITH {EDGES} SELECT subject, object, predicate FROM e WHERE subject = 7 UNION ALL SELECT subject, object, predicate FROM e WHERE object = 1000011")(lambda s, d: graph.by_subject(_edges(s, d), 7).unionByName(graph.by_object(_edges(s, d), 1000011)).select("subject", "object", "predicate"))
query("graph_properties", f"WITH {EDGES}, g AS (SELECT count(DISTINCT subject) AS nodes, count(*) AS edges FROM e) SELECT nodes, edges, round(edges / nodes, 6) AS avg_degree, round(edges / (nodes * (nodes - 1)), 6) AS density FROM g")(
    lambda s, d: graph.properties(_edges(s, d)).select("nodes", "edges", F.round("avg_degree", 6).alias("avg_degree"), F.round("density", 6).alias("density"))
)


def _traverse_sql(edges: str, hops: int, direction: str, step: str, starts: str) -> str:
    ways = {"out": "SELECT subject AS a, object AS b, weight AS w FROM e", "in": "SELECT object AS a, subject AS b, weight AS w FROM e"}
    link = f"{ways['out']} UNION ALL {ways['in']}" if direction == "both" else ways[direction]
    levels = ", ".join(f"l{h} AS (SELECT start, list_append(nodes, b) AS nodes, score * {step} AS score FROM l{h - 1} JOIN k ON k.a = nodes[-1] WHERE NOT list_contains(nodes, b))" for h in range(1, hops + 1))
    rows = " UNION ALL ".join(f"SELECT start, array_to_string(nodes, '>') AS path, {h}::BIGINT AS hops, round(score, 6) AS score FROM l{h}" for h in range(1, hops + 1))
    return f"WITH {edges}, k AS ({link}), l0 AS (SELECT a AS start, [a] AS nodes, 1.0::DOUBLE AS score FROM (SELECT DISTINCT a FROM k WHERE {starts})), {levels} {rows}"


def _traversed(e: DataFrame, starts: DataFrame, **how: object) -> DataFrame:
    return graph.traverse(starts, e, **how).select("start", F.array_join("nodes", ">").alias("path"), "hops", F.round("score", 6).alias("score"))


query("traverse_out_2hop", _traverse_sql(NEAR, 2, "out", "w * 0.5", "a % 100 = 0"))(lambda s, d: (lambda e: _traversed(e, e.where("subject % 100 = 0").select(F.col("subject").alias("start")), max_hops=2))(_near(s, d)))
query("traverse_unweighted", _traverse_sql(NEAR, 3, "out", "0.5", "a % 100 = 0"))(lambda s, d: (lambda e: _traversed(e, e.where("subject % 100 = 0").select(F.col("subject").alias("start")), max_hops=3, weighted=False))(_near(s, d)))
query("traverse_in", _traverse_sql(EDGES, 1, "in", "w * 0.5", "a % 100 = 0"))(lambda s, d: (lambda e: _traversed(e, e.where("object % 100 = 0").select(F.col("object").alias("start")), max_hops=1, direction="in"))(_edges(s, d)))
query("traverse_both", _traverse_sql(NEAR, 2, "both", "w * 0.7", "a % 100 = 0"))(
    lambda s, d: (lambda e: _traversed(e, e.where("subject % 100 = 0").select(F.col("subject").alias("start")).unionByName(e.where("object % 100 = 0").select(F.col("object").alias("start"))), max_hops=2, direction="both", decay=0.7))(_near(s, d))
)


def _seeds(s: SparkSession, d: str) -> DataFrame:
    return knn.batch(_asked(_emb(s, d)), _emb(s, d), 5).select("query_id", "id", "score")


SEEDS = "seeds AS (SELECT q.vec_id AS query_id, b.vec_id AS id, list_distance(q.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_distance(q.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9), b.vec_id) AS r FROM embeddings q, embeddings b WHERE q.vec_id % 100 = 0 QUALIFY r <= 5)"
query("graph_rerank", f"WITH {NEAR}, {SEEDS}, p AS (SELECT query_id, id, 1 / (1 + d) AS s FROM seeds UNION ALL SELECT query_id, object, 0.4 / (1 + d) FROM seeds JOIN e ON subject = id) SELECT query_id, id, round(sum(s), 6) AS score FROM p GROUP BY ALL")(
    lambda s, d: graph.rerank(_seeds(s, d), _near(s, d), 0.4).select("query_id", "id", F.round("score", 6).alias("score"))
)
query("graph_spread", f"""WITH {NEAR}, {SEEDS}, l0 AS (SELECT query_id, id, 1.0::DOUBLE / r AS m FROM seeds), l1 AS (SELECT query_id, object AS id, sum(m * weight / 2) AS m FROM l0 JOIN e ON subject = id GROUP BY ALL), l2 AS (SELECT query_id, object AS id, sum(m * weight / 3) AS m FROM l1 JOIN e ON subject = id GROUP BY ALL)
SELECT query_id, id, round(sum(s), 6) AS score FROM (SELECT query_id, id, 0.4 * m AS s FROM l0 UNION ALL SELECT query_id, id, 0.6 * m FROM l1 UNION ALL SELECT query_id, id, 0.6 * m FROM l2) GROUP BY ALL""")(
    lambda s, d: graph.spread(_seeds(s, d), _near(s, d), 0.6, 2).select("query_id", "id", F.round("score", 6).alias("score"))
)


def _pagerank_sql(rounds: int) -> str:
    steps = ", ".join(
        f"r{i} AS MATERIALIZED (SELECT v.node, 0.15 / n.n + 0.85 * (coalesce((SELECT sum(rank) FROM r{i - 1} WHERE node NOT IN (SELECT subject FROM e)), 0) / n.n + coalesce(f.flow, 0)) AS rank FROM v CROSS JOIN n LEFT JOIN (SELECT object, sum(rank / deg) AS flow FROM e JOIN r{i - 1} ON node = subject JOIN g USING (subject) GROUP BY object) f ON f.object = v.node)"
        for i in range(1, rounds + 1)
    )
    return f"WITH {EDGES}, v AS (SELECT DISTINCT node FROM (SELECT subject AS node FROM e UNION ALL SELECT object FROM e)), n AS (SELECT count(*)::DOUBLE AS n FROM v), g AS (SELECT subject, count(*) AS deg FROM e GROUP BY ALL), r0 AS (SELECT node, 1 / n.n AS rank FROM v, n), {steps} SELECT node, round(rank, 9) AS rank FROM r{rounds}"


query("pagerank_k", _pagerank_sql(20))(lambda s, d: graph.pagerank(_edges(s, d), iterations=20, tolerance=0).select("node", F.round("rank", 9).alias("rank")))


def _lpa_sql(rounds: int) -> str:
    steps = ", ".join(f"b{i} AS MATERIALIZED (SELECT subject AS node, arg_max(label, struct_pack(n := n, l := label)) AS label FROM (SELECT e.subject, x.label, count(*) AS n FROM e JOIN a{i - 1} x ON x.node = e.object GROUP BY ALL) GROUP BY subject), a{i} AS MATERIALIZED (SELECT p.node, coalesce(b.label, p.label) AS label FROM a{i - 1} p LEFT JOIN b{i} b USING (node))" for i in range(1, rounds + 1))
    return f"WITH {NEAR}, a0 AS (SELECT DISTINCT subject AS node, subject AS label FROM e), {steps} SELECT node, label FROM a{rounds}"


query("lpa_k", _lpa_sql(10))(lambda s, d: graph.label_propagation(_near(s, d), 10))
query("components", "SELECT event_id AS node, min(event_id) OVER (PARTITION BY event_id % 9) AS component FROM events")(
    lambda s, d: (lambda e: graph.components(e.join(e.select(F.col("subject").alias("object")), F.col("subject") + 9 == F.col("object")).withColumn("predicate", F.lit("next")).withColumn("weight", F.lit(1.0))))(table(s, d, "events").select(F.col("event_id").alias("subject")))
)
WALKS = f"""WITH {NEAR}, p AS (SELECT s.vec_id AS start, t.vec_id AS target FROM embeddings s JOIN embeddings t ON t.vec_id = s.vec_id + 50 WHERE s.vec_id % 100 = 0),
l0 AS (SELECT DISTINCT start, start AS node, [start] AS path, 0.0::DOUBLE AS d FROM p), {", ".join(f"l{h} AS (SELECT start, object AS node, list_append(path, object) AS path, d + (1 / weight - 1) AS d FROM l{h - 1} JOIN e ON subject = node)" for h in range(1, 5))},
a AS ({" UNION ALL ".join(f"SELECT *, {h}::BIGINT AS h FROM l{h}" for h in range(5))})
"""


def _pairs(s: SparkSession, d: str) -> DataFrame:
    e = _emb(s, d)
    return e.where("id % 100 = 0").select(F.col("id").alias("start"), (F.col("id") + 50).alias("target")).join(e.select(F.col("id").alias("target")), "target")


query("bfs_path_hops", WALKS + "SELECT p.start, p.target, min(h) AS hops FROM p JOIN a ON a.start = p.start AND a.node = p.target GROUP BY ALL")(lambda s, d: graph.paths(_pairs(s, d), _near(s, d), 4).select("start", "target", "hops"))
query("bfs_path", WALKS + "SELECT p.start, p.target, array_to_string(arg_min(path, struct_pack(h, path)), '>') AS path FROM p JOIN a ON a.start = p.start AND a.node = p.target GROUP BY ALL")(lambda s, d: graph.paths(_pairs(s, d), _near(s, d), 4).select("start", "target", F.array_join("path", ">").alias("path")))
query("directed_path", WALKS + "SELECT p.start, p.target, min(h) AS hops, array_to_string(arg_min(path, struct_pack(h, d := round(d, 9), path)), '>') AS path, round(arg_min(d, struct_pack(h, d := round(d, 9), path)), 6) AS length FROM p JOIN a ON a.start = p.start AND a.node = p.target GROUP BY ALL")(
    lambda s, d: graph.directed_paths(_pairs(s, d), _near(s, d), _emb(s, d), 4).select("start", "target", "hops", F.array_join("path", ">").alias("path"), F.round(F.aggregate("distances", F.lit(0.0), lambda a, x: a + x), 6).alias("length"))
)
query("planned_path_hops", WALKS + "SELECT p.start, p.target, min(h) AS hops FROM p JOIN a ON a.start = p.start AND a.node = p.target GROUP BY ALL UNION ALL SELECT DISTINCT start, start, 0::BIGINT FROM p")(
    lambda s, d: (lambda p: graph.planned_paths(p.unionByName(p.select("start", F.col("start").alias("target"))), _near(s, d), _emb(s, d), 4).select("start", "target", "hops"))(_pairs(s, d))
)
query("orphans", f"WITH {NEAR} SELECT vec_id AS id FROM embeddings WHERE vec_id NOT IN (SELECT object FROM e)")(lambda s, d: _emb(s, d).select("id").join(_near(s, d).select(F.col("object").alias("id")), "id", "left_anti"))

# ---------------------------------------------------------------- lifecycle
query("lww_latest", "SELECT user_id, arg_max(event_id, struct_pack(ts, e := -event_id)) AS event_id, arg_max(value, struct_pack(ts, e := -event_id)) AS value FROM events GROUP BY user_id")(lambda s, d: lifecycle.last_writer(table(s, d, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "value"))
query("lww_upsert", "WITH b AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'click'), x AS (SELECT *, 0 AS n FROM b UNION ALL SELECT user_id, ts, event_id, 1 FROM events WHERE event_type <> 'click') SELECT user_id, max(ts) AS ts FROM x GROUP BY user_id")(
    lambda s, d: (lambda e: lifecycle.upserted(e.where("event_type = 'click'"), e.where("event_type <> 'click'"), "user_id", "ts").select("user_id", "ts"))(table(s, d, "events").select("user_id", "ts", "event_id", "event_type"))
)
query("ttl_live", "SELECT event_id FROM events WHERE user_id % 7 * 86400 <= 0 OR epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(ts) <= user_id % 7 * 86400")(lambda s, d: lifecycle.live(table(s, d, "events"), F.col("ts"), F.col("user_id") % 7 * 86400, F.to_timestamp(F.lit("2024-01-31 00:00:00"))).select("event_id"))
query("lru_victims", "SELECT user_id AS id, max(ts) AS last_access, count(*) AS accesses FROM events GROUP BY 1 ORDER BY 2, 1 LIMIT 20")(lambda s, d: lifecycle.victims(table(s, d, "events"), 20, "lru", "user_id"))
query("lfu_victims", "SELECT user_id AS id, max(ts) AS last_access, count(*) AS accesses FROM events GROUP BY 1 ORDER BY 3, 1 LIMIT 20")(lambda s, d: lifecycle.victims(table(s, d, "events"), 20, "lfu", "user_id"))
query("fragmentation_density", "SELECT event_type, count(*) AS size, sum((value < 10)::INT)::BIGINT AS deleted, round(1 - sum((value < 10)::INT) / count(*), 6) AS density FROM events GROUP BY 1")(
    lambda s, d: lifecycle.density(table(s, d, "events"), table(s, d, "events").where("value < 10").select("event_id"), "event_type", "event_id").select("event_type", "size", "deleted", F.round("density", 6).alias("density"))
)
query("memory_evict_prefix", "WITH c AS (SELECT n_name AS name, sum(length(c_name)) AS bytes, max(c_custkey) AS created FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1), o AS (SELECT *, coalesce(sum(bytes) OVER (ORDER BY bytes DESC, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(bytes) OVER () AS t FROM c) SELECT name, bytes::BIGINT AS bytes FROM o WHERE t - b > 10000")(
    lambda s, d: lifecycle.evicted(table(s, d, "customer").join(table(s, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).groupBy(F.col("n_name").alias("name")).agg(F.sum(F.length("c_name")).alias("bytes"), F.max("c_custkey").alias("created")), 10000, "largest").select("name", "bytes")
)
WORD = "('0x' || substr(sha256({x}), {at}, 15))::BIGINT"
XORS = ", ".join(f"bit_xor({WORD.format(x='event_id::VARCHAR || chr(124) || epoch_us(ts)::VARCHAR', at=1 + 15 * i)}) AS x{i}" for i in range(4))
LEAVES = f"l0 AS (SELECT {WORD.format(x='event_id::VARCHAR', at=1)} % 65536 AS leaf, {XORS}, count(*) AS rows FROM events GROUP BY 1), d0 AS (SELECT leaf, sha256(concat_ws('|', x0, x1, x2, x3)) AS digest, rows FROM l0)"
UP = ", ".join(f"d{i} AS (SELECT leaf // 16 AS leaf, sha256(string_agg(leaf::VARCHAR || ':' || digest, '|' ORDER BY leaf)) AS digest, sum(rows)::BIGINT AS rows FROM d{i - 1} GROUP BY 1)" for i in range(1, 5))
query("digest_leaves", f"WITH {LEAVES} SELECT * FROM d0")(lambda s, d: lifecycle.digest_leaves(table(s, d, "events"), "event_id"))
query("digest_root", f"WITH {LEAVES}, {UP} SELECT digest, rows FROM d4")(lambda s, d: lifecycle.digest_root(table(s, d, "events"), "event_id"))
query("digest_differing", f"WITH {LEAVES}, gone AS (SELECT DISTINCT {WORD.format(x='event_id::VARCHAR', at=1)} % 65536 AS leaf FROM events WHERE value < 10) SELECT leaf FROM gone")(
    lambda s, d: (lambda e: lifecycle.differing_leaves(lifecycle.digest_leaves(e, "event_id"), lifecycle.digest_leaves(e.where("value >= 10"), "event_id")))(table(s, d, "events"))
)
query("ring_owners", """WITH p AS (SELECT n, ('0x' || substr(md5(n || '#' || i::VARCHAR), 1, 15))::BIGINT AS p FROM unnest(['n1', 'n2', 'n3', 'n4', 'n5']) x(n), range(64) t(i)),
k AS (SELECT c_custkey, ('0x' || substr(md5(c_custkey::VARCHAR), 1, 15))::BIGINT AS place FROM customer),
f AS (SELECT c_custkey, n, min(CASE WHEN p >= place THEN p - place ELSE p - place + 1152921504606846976 END) AS way FROM k, p GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY way) AS o FROM f QUALIFY o <= 3) SELECT c_custkey, string_agg(n, ',' ORDER BY o) AS owners FROM r GROUP BY c_custkey""")(
    lambda s, d: lifecycle.owners(table(s, d, "customer").select("c_custkey"), "c_custkey", ["n1", "n2", "n3", "n4", "n5"], 3).withColumn("owners", F.array_join("owners", ","))
)
query("region_route", """WITH r AS (SELECT owner_id, centroid::DOUBLE[] AS c, radius::DOUBLE AS radius FROM mesh_regions WHERE owner_id IS NOT NULL AND centroid IS NOT NULL AND len(centroid) = 48 AND radius > 0 AND NOT isnan(radius)),
q AS (SELECT id AS query_id, max(vector)::DOUBLE[] AS v FROM vectors WHERE id IS NOT NULL AND len(vector) = 48 AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND id % 100 = 0 GROUP BY id),
n AS (SELECT query_id, owner_id, min(list_distance(v, c)) AS distance FROM q, r WHERE list_distance(v, c) <= 3 * radius GROUP BY ALL)
SELECT query_id, owner_id, round(distance, 6) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), owner_id) AS rank FROM n QUALIFY rank <= 5""")(
    lambda s, d: (lambda q: lifecycle.routed(q, table(s, d, "mesh_regions"), 5, 3.0).select("query_id", "owner_id", F.round("distance", 6).alias("distance"), "rank"))(
        table(s, d, "vectors").where("id % 100 = 0 and size(vector) = 48 and forall(vector, x -> x is not null and not isnan(x) and abs(x) <> double('infinity'))").groupBy(F.col("id").alias("query_id")).agg(F.max("vector").alias("vector"))
    )
)
query("evict_lru", "WITH c AS (SELECT user_id::VARCHAR AS name, count(*) * 100 AS bytes, max(ts) AS last_access, min(ts) AS created FROM events GROUP BY 1), o AS (SELECT *, coalesce(sum(bytes) OVER (ORDER BY last_access, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, (SELECT sum(bytes) FROM c) AS t FROM c WHERE name <> '7') SELECT name, bytes FROM o WHERE t - b > 20000")(
    lambda s, d: lifecycle.evicted(table(s, d, "events").groupBy(F.col("user_id").cast("string").alias("name")).agg((F.count(F.lit(1)) * 100).alias("bytes"), F.max("ts").alias("last_access"), F.min("ts").alias("created")), 20000, "lru", "7").select("name", "bytes")
)
CLOCKS = "c AS (SELECT user_id, map_from_entries(list((event_type, n))) AS m FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id)"
query("vector_clock_order", """WITH n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), t AS (SELECT DISTINCT event_type FROM events), u AS (SELECT DISTINCT user_id FROM events),
p AS (SELECT u.user_id, coalesce(a.n, 0) - coalesce(b.n, 0) AS x FROM u CROSS JOIN t LEFT JOIN n a ON a.user_id = u.user_id AND a.event_type = t.event_type LEFT JOIN n b ON b.user_id = 0 AND b.event_type = t.event_type)
SELECT user_id, CASE WHEN min(x) < 0 AND max(x) > 0 THEN 'concurrent' WHEN min(x) < 0 THEN 'before' WHEN max(x) > 0 THEN 'after' ELSE 'equal' END AS clock_order FROM p GROUP BY user_id""")(
    lambda s, d: (lambda c: c.withColumn("other", c.where("user_id = 0").select("m").scalar()).select("user_id", lifecycle.clock_order(F.col("m"), F.coalesce("other", F.create_map().cast("map<string,bigint>"))).alias("clock_order")))(
        table(s, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n")).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    )
)

query("clock_merge", """WITH n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), z AS (SELECT * FROM n WHERE user_id = 0), u AS (SELECT DISTINCT user_id FROM n),
m AS (SELECT user_id, event_type, max(n) AS n FROM (SELECT * FROM n UNION ALL SELECT u.user_id, z.event_type, z.n FROM u, z) GROUP BY ALL) SELECT user_id, sum(n)::BIGINT AS total FROM m GROUP BY user_id""")(
    lambda s, d: (lambda c: c.withColumn("other", c.where("user_id = 0").select("m").scalar()).select("user_id", F.aggregate(F.map_values(lifecycle.clock_merge(F.col("m"), F.coalesce("other", F.create_map().cast("map<string,bigint>")))), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total")))(
        table(s, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n")).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    )
)

# ---------------------------------------------------------------- indexes
query("bitmap_removed", "SELECT event_id AS id FROM events WHERE event_type = 'click' AND NOT user_id < 50")(lambda s, d: (lambda e: indexing.ids(indexing.removed(indexing.bitmap(e.where("event_type = 'click'"), "event_id"), indexing.bitmap(e.where("user_id < 50"), "event_id"))))(table(s, d, "events")))
query("bitmap_between", "SELECT event_id AS id FROM events WHERE event_type = 'click' AND event_id BETWEEN 100 AND 4000")(lambda s, d: indexing.between(indexing.bitmap(table(s, d, "events").where("event_type = 'click'"), "event_id"), 100, 4000))
query("bitmap_contains", "SELECT event_id, user_id FROM events WHERE user_id IN (SELECT event_id FROM events WHERE event_type = 'click')")(
    lambda s, d: (lambda e: indexing.contains(e.select("event_id", "user_id"), indexing.bitmap(e.where("event_type = 'click'"), "event_id"), "user_id"))(table(s, d, "events"))
)
query("inverted_removed", "SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'F' AND NOT o_totalprice > 200000")(
    lambda s, d: (lambda o: indexing.ids(indexing.lookup(indexing.unindexed(indexing.inverted(o, "o_orderkey", "o_orderstatus"), o.where("o_totalprice > 200000").select(F.col("o_orderkey").alias("id"))), {"o_orderstatus": "F"})))(table(s, d, "orders"))
)
query("inverted_stats", "SELECT 'o_orderstatus' AS field, count(DISTINCT o_orderstatus) AS values, count(o_orderstatus) AS entries FROM orders UNION ALL SELECT 'o_orderpriority', count(DISTINCT o_orderpriority), count(o_orderpriority) FROM orders")(
    lambda s, d: indexing.index_stats(indexing.inverted(table(s, d, "orders"), "o_orderkey", "o_orderstatus", "o_orderpriority"))
)
query("bloom_rate", "SELECT 0::BIGINT AS missed, true AS few_false FROM (SELECT 1)")(
    lambda s, d: (lambda o, l: indexing.may_contain(l, "l_orderkey", indexing.bloom(o, "o_orderkey")).join(o.select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("own")), "l_orderkey", "left").agg(
        (l.join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").agg(F.count(F.lit(1))).scalar() - F.count("own")).alias("missed"), ((F.count(F.lit(1)) - F.count("own")) * 100 <= l.agg(F.count(F.lit(1))).scalar()).alias("few_false")
    ))(table(s, d, "orders").where("o_totalprice > 300000").select("o_orderkey"), table(s, d, "lineitem").select("l_orderkey"))
)
query("text_hashes", """WITH b AS (SELECT p_partkey, p_name, list_transform(range(1, length(p_name) + 1), lambda i: ascii(substr(p_name, i, 1))::UHUGEINT) AS c FROM part),
h AS (SELECT *, list_reduce(c, lambda h, x: (xor(h, x) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT, 14695981039346656037::UHUGEINT) AS f FROM b)
SELECT p_partkey, sha256(p_name || '|' || p_partkey::VARCHAR) AS sha, (CASE WHEN f >= 9223372036854775808::UHUGEINT THEN f::HUGEINT - 18446744073709551616::HUGEINT ELSE f::HUGEINT END)::BIGINT AS fnv FROM h""")(
    lambda s, d: table(s, d, "part").select("p_partkey", T.digest(F.col("p_name"), F.col("p_partkey")).alias("sha"), T.fnv1a(F.col("p_name")).alias("fnv"))
)
query("text_clean", "SELECT doc_id, length(trim(regexp_replace(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g'), ' ')) AS n FROM documents WHERE text IS NOT NULL")(lambda s, d: table(s, d, "documents").where("text is not null").select("doc_id", F.length(T.clean(F.col("text"))).cast("bigint").alias("n")))
query("bitmap_and", "SELECT event_id AS id FROM events WHERE event_type = 'click' AND user_id < 50")(lambda s, d: (lambda e: indexing.ids(indexing.intersection(indexing.bitmap(e.where("event_type = 'click'"), "event_id"), indexing.bitmap(e.where("user_id < 50"), "event_id"))))(table(s, d, "events")))
query("bitmap_or_count", "SELECT count(*) AS n FROM events WHERE event_type = 'click' OR user_id < 50")(lambda s, d: (lambda e: indexing.count(indexing.union(indexing.bitmap(e.where("event_type = 'click'"), "event_id"), indexing.bitmap(e.where("user_id < 50"), "event_id"))))(table(s, d, "events")))
query("inverted_lookup", "SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")(lambda s, d: indexing.ids(indexing.lookup(indexing.inverted(table(s, d, "orders"), "o_orderkey", "o_orderstatus", "o_orderpriority"), {"o_orderstatus": "F", "o_orderpriority": "1-URGENT"})))
query("bloom_semi_join", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 300000)")(
    lambda s, d: (lambda o: indexing.may_contain(table(s, d, "lineitem"), "l_orderkey", indexing.bloom(o, "o_orderkey")).join(o.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi").select("l_orderkey", "l_linenumber"))(table(s, d, "orders").where("o_totalprice > 300000"))
)
query("namespace_paths", "SELECT doc_id, CASE WHEN instr(p, '/') > 1 THEN split_part(p, '/', 1) ELSE 'default' END AS namespace, CASE WHEN instr(p, '/') = 0 THEN p ELSE substr(p, instr(p, '/') + 1) END AS name FROM (SELECT doc_id, coalesce(source, '') || CASE doc_id % 3 WHEN 0 THEN '/' || coalesce(lang, '') || '/x' WHEN 1 THEN '' ELSE '/' END AS p FROM documents)")(
    lambda s, d: table(s, d, "documents").select("doc_id", T.namespace(F.concat(F.coalesce("source", F.lit("")), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("/"), F.coalesce("lang", F.lit("")), F.lit("/x"))).when(F.col("doc_id") % 3 == 1, "").otherwise("/"))).alias("n")).select("doc_id", "n.*")
)

# ---------------------------------------------------------------- windows
query("window_counts", "SELECT time_bucket(INTERVAL '1 day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")(lambda s, d: ingest.window_counts(table(s, d, "events"), "ts", "event_type", "value").withColumn("total", F.round("total", 4)))
query("stream_window_counts", SQL["window_counts"])(lambda s, d: _streamed(s, d))
query("session_counts", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '6 hours' THEN 0 ELSE 1 END AS new FROM events), k AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '6 hours' AS "end", count(*) AS n FROM k GROUP BY user_id, no""")(lambda s, d: ingest.sessions(table(s, d, "events"), "ts", "user_id", "6 hours"))


def _streamed(s: SparkSession, d: str) -> DataFrame:
    """The windows of the same table read as a stream, all of it, in complete mode."""
    name = f"windows_{abs(hash(d)) % 10**9}"
    rows = s.readStream.schema(table(s, d, "events").schema).parquet(f"{d}/events.parquet*")
    q = ingest.window_counts(rows, "ts", "event_type", "value").writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return s.table(name).withColumn("total", F.round("total", 4))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
