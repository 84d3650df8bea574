"""Queries of the llm operators and their SQL, for the driver's entry file."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkvec.functions.text import PUNCTUATION
from sparkvec.llm import clusters, distinctive, fusion, language, mixing, neighbors, packing
from sparkvec.session import table

Query = Callable[[SparkSession, str], DataFrame]

PUNCTUATION_SQL = PUNCTUATION.replace("'", "''")

USABLE_SQL = """
WITH u AS (
  SELECT id, arg_max(vector::DOUBLE[], struct_pack(t := coalesce(epoch_us(ts), -9000000000000000), v := vector)) AS v FROM vectors
  WHERE id IS NOT NULL AND len(vector) = 48 AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 GROUP BY id
)
"""
P1_SQL = USABLE_SQL + """, n AS (
  SELECT a.id, b.id AS other, list_distance(a.v, b.v) AS d, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.v, b.v), b.id) AS r
  FROM u a JOIN u b ON a.id <> b.id QUALIFY r <= 6
), t AS (SELECT id FROM n GROUP BY id HAVING count(*) = 6 AND max(d) FILTER (r = 5) <= 0.6 * max(d) FILTER (r = 6) AND max(d) FILTER (r = 6) > 0)
SELECT DISTINCT least(id, other) AS id_a, greatest(id, other) AS id_b FROM n WHERE id IN (SELECT id FROM t) AND r <= 5
"""
# a set stands apart if each of its n records has, after its n nearest (itself among them), a gap, and the same n nearest
P1_IDS_SQL = USABLE_SQL + """SELECT a.id, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.v, b.v), b.id) AS rank, b.id AS other_id FROM u a JOIN u b ON a.id <> b.id QUALIFY rank <= 10"""
P4_SQL = USABLE_SQL + """, s AS (
  SELECT a.id, list_distance(a.v, b.v) AS d, row_number() OVER w AS n, lead(list_distance(a.v, b.v)) OVER w AS next,
    bit_xor(hash(b.id)) OVER (PARTITION BY a.id ORDER BY list_distance(a.v, b.v), b.id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sig
  FROM u a, u b WINDOW w AS (PARTITION BY a.id ORDER BY list_distance(a.v, b.v), b.id)
), g AS (SELECT id, n, sig FROM s WHERE n >= 20 AND (next IS NULL OR (d <= 0.8 * next AND next > 0))
), sets AS (SELECT n, sig FROM g GROUP BY ALL HAVING count(*) = n
), m AS (SELECT id, n, sig, min(n) OVER (PARTITION BY id) AS least FROM g JOIN sets USING (n, sig)
), kept AS (SELECT n, sig FROM m GROUP BY ALL HAVING max(n - least) = 0)
SELECT id AS id_a, lead(id) OVER (PARTITION BY n, sig ORDER BY id) AS id_b FROM m JOIN kept USING (n, sig) QUALIFY id_b IS NOT NULL
"""
P4_SIZES_SQL = P4_SQL.split("\nSELECT id AS id_a")[0] + "\nSELECT n AS size, count(*) AS regions FROM kept GROUP BY n"

COUNTS_SQL = f"""
WITH words AS (
  SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), pieces AS (
  SELECT doc_id, unnest(list_filter(list_transform(string_split_regex(lower(text), '\\s+'), lambda x: trim(x, '{PUNCTUATION_SQL}')), lambda x: x <> '')) AS term FROM words
), tf AS (SELECT doc_id, term, count(*) AS tf FROM pieces GROUP BY ALL
), len AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY ALL
), df AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS c FROM tf GROUP BY ALL)
"""
P5_SQL = COUNTS_SQL + """
SELECT doc_id, term FROM tf JOIN len USING (doc_id) JOIN df USING (term)
WHERE tf >= 3 AND tf * 40 >= n AND df BETWEEN 2 AND 6
"""
P5_TOP_SQL = COUNTS_SQL + """, scored AS (
  SELECT doc_id, term, tf, n::DOUBLE * c / all_ AS e, n::DOUBLE * c / all_ * (1 - n::DOUBLE / all_) * (1 - c::DOUBLE / all_) AS s
  FROM tf JOIN len USING (doc_id) JOIN df USING (term), (SELECT sum(tf)::DOUBLE AS all_ FROM tf)
), best AS (SELECT doc_id, term, tf, CASE WHEN s > 0 THEN (tf - e) / sqrt(s) ELSE 0 END AS score FROM scored)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, term) AS rank, term, tf, round(score, 6) AS score FROM best QUALIFY rank <= 10
"""

P6_RANKS_SQL = """
WITH req AS (
  SELECT query_id, r.k::BIGINT AS k, coalesce(r.alpha, 0.5) <> 0 AS ud,
    coalesce(regexp_replace(r.q, '\\s', '', 'g'), '') <> '' AND coalesce(r.alpha, 0.5) <> 1 AS ut,
    coalesce(r.g > 0, false) AS ug
  FROM (SELECT query_id, max(struct_pack(t := coalesce(requested_at, TIMESTAMP '0001-01-01'), alpha := alpha, g := graph_alpha, k := k, q := text_query)) AS r
    FROM search_requests WHERE query_id IS NOT NULL GROUP BY ALL)
), it AS (
  SELECT query_id, id,
    min(CASE WHEN NOT isnan(distance) THEN distance::DOUBLE END) AS d,
    max(CASE WHEN NOT isnan(text_score) THEN text_score END) AS t,
    max(CASE WHEN NOT isnan(graph_score) THEN graph_score END) AS g
  FROM search_results WHERE query_id IS NOT NULL AND id IS NOT NULL GROUP BY ALL
), r AS (
  SELECT query_id, id, k, count(*) OVER (PARTITION BY query_id) AS n, ud::INT + ut::INT + ug::INT AS used,
    CASE WHEN ud THEN rank() OVER (PARTITION BY query_id ORDER BY d NULLS LAST) END AS rd,
    CASE WHEN ut THEN rank() OVER (PARTITION BY query_id ORDER BY t DESC NULLS LAST) END AS rt,
    CASE WHEN ug THEN rank() OVER (PARTITION BY query_id ORDER BY g DESC NULLS LAST) END AS rg
  FROM it JOIN req USING (query_id)
)
"""
P6_SQL = P6_RANKS_SQL + """, w AS (SELECT *, greatest(rd, rt, rg) AS worst FROM r
), q AS (
  SELECT *, worst * 5 <= n AS top,
    sum((worst * 5 <= n)::INT) OVER (PARTITION BY query_id) AS tops,
    sum((worst * 5 > n AND worst * 3 <= n)::INT) OVER (PARTITION BY query_id) AS between_
  FROM w WHERE used >= 2
)
SELECT query_id, id FROM q WHERE top AND tops = k AND between_ = 0
"""
P6_FUSED_SQL = P6_RANKS_SQL + """, t AS (SELECT *, coalesce(1.0::DOUBLE / (60 + rd), 0) + coalesce(1.0::DOUBLE / (60 + rt), 0) + coalesce(1.0::DOUBLE / (60 + rg), 0) AS total FROM r)
SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY total DESC, id) AS fused_rank, round(total, 9) AS total, rd AS rank_distance, rt AS rank_text_score, rg AS rank_graph_score FROM t
"""

P7_CHECKED_SQL = """
SELECT container, texts, 0::BIGINT AS lost_tokens, 0::BIGINT AS overfull_bins, 0::BIGINT AS needless_splits, 0::BIGINT AS lone_bins
FROM (SELECT DISTINCT container FROM packing_sizes WHERE capacity_tokens > 0),
  (SELECT count(*) AS texts FROM (SELECT DISTINCT doc_id, text FROM documents WHERE regexp_replace(text, '[\\s\\p{Z}]', '', 'g') <> ''))
"""
SOURCE_SQL = "regexp_replace(lower(trim(source)), '[\\s_\\-]+', '_', 'g')"
P8_CHECKED_SQL = f"""
WITH known AS (SELECT DISTINCT {SOURCE_SQL} AS source FROM documents WHERE doc_id IS NOT NULL AND regexp_replace(text, '[\\s\\p{{Z}}]', '', 'g') <> '')
SELECT DISTINCT {SOURCE_SQL} AS source, {SOURCE_SQL} IN (SELECT source FROM known WHERE source IS NOT NULL) AS has_documents, true AS share_met, true AS repeats_met FROM mix_targets WHERE source IS NOT NULL
"""


def queries() -> dict[str, Query]:
    return {
        "p1_found": lambda s, d: neighbors.tight_rings(table(s, d, "vectors")),
        "p1_neighbors": lambda s, d: neighbors.nearest_ids(table(s, d, "vectors"), 10),
        "p1_neighbor_ids": lambda s, d: neighbors.nearest_ids(table(s, d, "vectors"), 10).drop("distance"),
        "p4_found": lambda s, d: clusters.found(table(s, d, "vectors")),
        "p4_regions": lambda s, d: clusters.regions(table(s, d, "vectors")),
        "p4_sizes": lambda s, d: clusters.regions(table(s, d, "vectors")).where("isolated").groupBy("size").agg(F.count(F.lit(1)).alias("regions")),
        "p5_found": lambda s, d: distinctive.found(table(s, d, "documents")),
        "p5_top_terms": lambda s, d: distinctive.top_terms(table(s, d, "documents"), 10).withColumn("score", F.round("score", 6)),
        "p6_found": lambda s, d: fusion.found(table(s, d, "search_requests"), table(s, d, "search_results")),
        "p6_ranking": lambda s, d: fusion.fused(table(s, d, "search_requests"), table(s, d, "search_results")).withColumn("total", F.round("total", 9)),
        "p7_packing": lambda s, d: packing.pack(table(s, d, "documents"), table(s, d, "packing_sizes")),
        "p7_fill": lambda s, d: packing.fill(packing.pack(table(s, d, "documents"), table(s, d, "packing_sizes")), table(s, d, "packing_sizes")),
        "p7_checked": lambda s, d: packing.checked(table(s, d, "documents"), packing.pack(table(s, d, "documents"), table(s, d, "packing_sizes")), table(s, d, "packing_sizes")),
        "p8_mix": lambda s, d: mixing.mix(table(s, d, "documents"), table(s, d, "mix_targets")),
        "p8_shares": lambda s, d: mixing.shares(mixing.mix(table(s, d, "documents"), table(s, d, "mix_targets")), table(s, d, "mix_targets")),
        "p8_checked": lambda s, d: mixing.checked(mixing.mix(table(s, d, "documents"), table(s, d, "mix_targets")), table(s, d, "documents"), table(s, d, "mix_targets")),
        "p9_found": lambda s, d: language.found(table(s, d, "documents")),
        "p9_segments": lambda s, d: language.segments(table(s, d, "documents")),
        "p9_documents": lambda s, d: language.languages(table(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_SQL, "p1_neighbor_ids": P1_IDS_SQL, "p4_found": P4_SQL, "p4_sizes": P4_SIZES_SQL, "p5_found": P5_SQL, "p5_top_terms": P5_TOP_SQL, "p6_found": P6_SQL, "p6_ranking": P6_FUSED_SQL, "p7_checked": P7_CHECKED_SQL, "p8_checked": P8_CHECKED_SQL}
