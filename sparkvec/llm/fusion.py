"""One ranking from several differently-scaled scores: reciprocal rank fusion per query.

Items are ranked separately by each score that the query uses; an item's total is the sum over those scores of
``1 / (constant + rank)``. Only ranks enter, so no score dominates by its range. Which scores a query uses follows from its
request: ``distance`` unless ``alpha`` is 0; ``text_score`` if the text isn't blank and ``alpha`` is not 1; ``graph_score`` if
``graph_alpha`` is above 0 (a null ``alpha`` is 0.5).

Ranks are exact for groups of any size. A query with at most ``hot_rows`` items is ranked by a window. A larger one is ranked
by its distinct values: counted per value, cut into ranges at approximate quantiles, ranked within ranges with the counts of
the ranges before added; so neither its items nor a value that many of them share meet in one task.

Defined cases
    Repeated requests count once; if they differ, the one with the newest ``requested_at``, then the greatest values, holds.
    An item listed several times counts once with its best value of each score. Null and NaN are worst and share the last
    rank; equal values share the better rank. Ties of the total are broken by ``id``. Results of unknown queries, and rows
    with a null ``query_id`` or ``id``, are left out, as are requests without results. A query that uses no score has its
    items ranked by ``id`` with a total of 0. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkvec.session import cut

CONSTANT = 60.0
HOT_ROWS = 200_000
RANGES = 256
SCORES = ("distance", "text_score", "graph_score")


def requests_in_use(requests: DataFrame) -> DataFrame:
    """``(query_id, k, use_distance, use_text_score, use_graph_score)``, one row for each query."""
    values = F.struct("requested_at", "alpha", "graph_alpha", "k", "text_query")
    r = requests.where(F.col("query_id").isNotNull()).groupBy("query_id").agg(F.max(values).alias("r")).select("query_id", "r.*")
    alpha = F.coalesce(F.when(F.isnan("alpha"), None).otherwise(F.col("alpha")), F.lit(0.5))
    return r.select(
        "query_id", F.col("k").cast("bigint").alias("k"),
        (alpha != 0).alias("use_distance"),
        (F.coalesce(F.regexp_replace("text_query", r"(?U)\s", ""), F.lit("")).__ne__("") & (alpha != 1)).alias("use_text_score"),
        F.coalesce((F.col("graph_alpha") > 0) & ~F.isnan("graph_alpha"), F.lit(False)).alias("use_graph_score"),
    )


def items(results: DataFrame) -> DataFrame:
    """``(query_id, id, badness of each score)``: smaller is better, null is worst; each item once."""
    value = lambda c: F.when(~F.isnan(c), F.col(c).cast("double"))
    rows = results.where(F.col("query_id").isNotNull() & F.col("id").isNotNull())
    return rows.groupBy("query_id", "id").agg(
        F.min(value("distance")).alias("distance"), (-F.max(value("text_score"))).alias("text_score"), (-F.max(value("graph_score"))).alias("graph_score"),
    )


def _rank_small(df: DataFrame) -> DataFrame:
    out = df
    for s in SCORES:
        out = out.withColumn(f"rank_{s}", F.when(F.col(f"use_{s}"), F.rank().over(W.partitionBy("query_id").orderBy(F.col(s).asc_nulls_last())).cast("bigint")))
    return out


def _rank_large(df: DataFrame) -> DataFrame:
    """The same ranks without a window over a whole query: see the module's text."""
    long = df.select("query_id", F.explode(F.array(*[F.struct(F.lit(s).alias("score"), F.col(s).alias("v")) for s in SCORES if s in df.columns])).alias("x")).select("query_id", "x.score", "x.v")
    counts = long.groupBy("query_id", "score", "v").agg(F.count(F.lit(1)).alias("n"))
    cuts = counts.groupBy("query_id", "score").agg(F.percentile_approx("v", [i / RANGES for i in range(1, RANGES)], 10_000).alias("cuts"))
    placed = counts.join(cuts, ["query_id", "score"]).withColumn("part", F.when(F.col("v").isNull(), RANGES + 1).otherwise(F.size(F.filter("cuts", lambda c: c < F.col("v")))))
    sizes = placed.groupBy("query_id", "score", "part").agg(F.sum("n").alias("part_n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("part_n").over(W.partitionBy("query_id", "score").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("part_n")
    inside = F.coalesce(F.sum("n").over(W.partitionBy("query_id", "score", "part").orderBy(F.col("v").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = placed.drop("cuts").withColumn("inside", inside).join(before, ["query_id", "score", "part"]).select("query_id", "score", "v", (F.col("before") + F.col("inside") + 1).alias("rank"))
    out = df
    for s in SCORES:
        # one row for each distinct value; a value many items share is on the small side once, so AQE splits the other side
        r = ranked.where(F.col("score") == s).select(F.col("query_id").alias("_q"), F.col("v").alias("_v"), F.col("rank").alias("_r"))
        out = out.join(r, (F.col("query_id") == F.col("_q")) & F.col(s).eqNullSafe(F.col("_v")), "left").withColumn(f"rank_{s}", F.when(F.col(f"use_{s}"), F.col("_r"))).drop("_q", "_v", "_r")
    return out


def _both(requests: DataFrame, results: DataFrame, constant: float, hot_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """Ranked items of the queries up to ``hot_rows`` items, and of those above if there are any."""
    it = items(results).join(requests_in_use(requests), "query_id")
    sizes = cut(it.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")))  # written once; asked for again below
    it = it.join(sizes, "query_id")

    def with_total(ranks: DataFrame) -> DataFrame:
        part = lambda s: F.coalesce(1.0 / (F.lit(constant) + F.col(f"rank_{s}")), F.lit(0.0))
        return ranks.withColumn("total", sum((part(s) for s in SCORES[1:]), part(SCORES[0])))

    # above hot_rows items there are at most (all items / hot_rows) queries; only they take the second way
    hot = not sizes.where(F.col("n") > hot_rows).isEmpty()
    return with_total(_rank_small(it.where(F.col("n") <= hot_rows))), with_total(_rank_large(it.where(F.col("n") > hot_rows))) if hot else None


def ranked(requests: DataFrame, results: DataFrame, constant: float = CONSTANT, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every item with ``n`` (items of its query), ``k``, its rank on each used score, and its ``total``."""
    small, big = _both(requests, results, constant, hot_rows)
    return small if big is None else small.unionByName(big)


def fused(requests: DataFrame, results: DataFrame, constant: float = CONSTANT, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``(query_id, id, fused_rank, total, rank_distance, rank_text_score, rank_graph_score)``: the one ranking of each query."""
    small, big = _both(requests, results, constant, hot_rows)
    small = small.withColumn("fused_rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("total"), "id")).cast("bigint"))
    cols = ["query_id", "id", "fused_rank", "total", *[f"rank_{s}" for s in SCORES]]
    out = small.select(*cols)
    if big is not None:
        # position = items in better ranges of (total, id) + position within the range
        cuts = big.groupBy("query_id").agg(F.percentile_approx((-F.col("total")), [i / RANGES for i in range(1, RANGES)], 10_000).alias("cuts"))
        placed = big.join(cuts, "query_id").withColumn("part", F.size(F.filter("cuts", lambda c: c < -F.col("total"))))
        sizes = placed.groupBy("query_id", "part").agg(F.count(F.lit(1)).alias("m"))
        before = sizes.withColumn("before", F.coalesce(F.sum("m").over(W.partitionBy("query_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("m")
        pos = F.row_number().over(W.partitionBy("query_id", "part").orderBy(F.desc("total"), "id"))
        out = out.unionByName(placed.join(before, ["query_id", "part"]).withColumn("fused_rank", (F.col("before") + pos).cast("bigint")).select(*cols))
    return out


def found(requests: DataFrame, results: DataFrame, constant: float = CONSTANT) -> DataFrame:
    """Items within the best fifth on every used score, where exactly ``k`` stand apart from all others (p6_found).

    Candidates are drawn by the fused total: an item that ranks within the best third of ``n`` on each of ``m`` scores has a
    total of at least ``m / (constant + n / 3)``. Those are all items that can be a case, or that stand between a query's cases
    and the others; the ranks of each are then checked.
    """
    r = ranked(requests, results, constant)
    used = sum((F.col(f"use_{s}").cast("int") for s in SCORES[1:]), F.col("use_distance").cast("int"))
    least = used / (F.lit(constant) + F.col("n") / 3.0)
    worst = F.greatest(*[F.col(f"rank_{s}") for s in SCORES])  # ignores the scores not in use
    r = r.where((used >= 2) & (F.col("total") >= least * (1 - 1e-9)))  # the margin is for rounding
    r = cut(r.select("query_id", "id", "k", (worst * 5 <= F.col("n")).alias("top"), (worst * 3 > F.col("n")).alias("apart")))
    ok = r.groupBy("query_id").agg(F.sum(F.col("top").cast("bigint")).alias("tops"), F.sum((~F.col("top") & ~F.col("apart")).cast("bigint")).alias("between"), F.first("k").alias("want"))
    ok = ok.where("tops = want and between = 0 and tops > 0").select("query_id")
    return r.where("top").join(ok, "query_id", "left_semi").select("query_id", "id")
