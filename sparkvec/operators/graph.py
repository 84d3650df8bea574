"""Property graph operators on ``edges (subject, predicate, object, weight)``.

Iterative operators are loops of joins and aggregates whose state is cut by checkpoint() in the shared folder, so a lost executor
costs one step. Only convergence numbers and counts reach the driver. Null ends of an edge are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkvec.functions import vector as V
from sparkvec.session import cut

CUT_EVERY = 4


def directed(edges: DataFrame, direction: str = "out") -> DataFrame:
    """Edges as ``(src, dst, predicate, weight)`` followed outwards, inwards or both ways."""
    out = edges.where("subject is not null and object is not null").select(F.col("subject").alias("src"), F.col("object").alias("dst"), "predicate", F.coalesce(F.col("weight").cast("double"), F.lit(1.0)).alias("weight"))
    back = out.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "predicate", "weight")
    if direction == "out":
        return out
    if direction == "in":
        return back
    if direction == "both":
        return out.unionByName(back)
    raise ValueError("direction must be out, in or both")


def by_subject(edges: DataFrame, subject: object) -> DataFrame:
    return edges.where(F.col("subject") == F.lit(subject))


def by_object(edges: DataFrame, obj: object) -> DataFrame:
    return edges.where(F.col("object") == F.lit(obj))


def by_predicate(edges: DataFrame, predicate: str) -> DataFrame:
    return edges.where(F.col("predicate") == predicate)


def stats(edges: DataFrame) -> DataFrame:
    """``(edge_count, community_count, predicates)``: communities are the distinct subjects."""
    return edges.agg(F.count(F.lit(1)).alias("edge_count"), F.countDistinct("subject").alias("community_count"), F.sort_array(F.collect_set("predicate")).alias("predicates"))


def properties(edges: DataFrame) -> DataFrame:
    """``(nodes, edges, avg_degree, density)``; nodes are those with an edge that leaves them."""
    t = directed(edges).groupBy("src").agg(F.count(F.lit(1)).alias("d")).agg(F.count(F.lit(1)).alias("nodes"), F.coalesce(F.sum("d"), F.lit(0)).alias("edges"))
    n, e = F.col("nodes"), F.col("edges")
    return t.select("nodes", "edges", F.when(n > 0, e / n).otherwise(0.0).alias("avg_degree"), F.when(n > 1, e / (n * (n - 1))).otherwise(0.0).alias("density"))


def traverse(starts: DataFrame, edges: DataFrame, max_hops: int = 2, direction: str = "out", weighted: bool = True, decay: float = 0.5) -> DataFrame:
    """``(start, nodes, predicates, hops, score)``: every simple path of 1 to ``max_hops`` edges from ``starts (start)``.

    The score is the product of ``weight * decay`` over the path's edges, or of ``decay`` alone; parallel edges give paths of their
    own. Paths grow with the degree to the power of the hops: it is the hops that must stay few.
    """
    hops = max_hops if max_hops > 0 else 2
    by = decay if decay else 0.5
    e = directed(edges, direction)
    step = F.col("weight") * by if weighted else F.lit(by)
    level = starts.select("start", F.array("start").alias("nodes"), F.array().cast("array<string>").alias("predicates"), F.lit(1.0).alias("score")).distinct()
    out = None
    for h in range(1, hops + 1):
        at = level.withColumn("src", F.element_at("nodes", -1))
        level = at.join(e, "src").where(~F.array_contains("nodes", F.col("dst"))).select("start", F.concat("nodes", F.array("dst")).alias("nodes"), F.concat("predicates", F.array("predicate")).alias("predicates"), (F.col("score") * step).alias("score"))
        rows = level.withColumn("hops", F.lit(h).cast("bigint"))
        out = rows if out is None else out.unionByName(rows)
    return out.select("start", "nodes", "predicates", "hops", "score")


def rerank(results: DataFrame, edges: DataFrame, alpha: float) -> DataFrame:
    """``(query_id, id, score)``: the results' scores plus alpha times the score of each result with an edge to the node."""
    seeds = results.select("query_id", "id", "score")
    if alpha <= 0:
        return seeds
    moved = seeds.join(directed(edges), F.col("id") == F.col("src")).select("query_id", F.col("dst").cast(seeds.schema["id"].dataType).alias("id"), (F.col("score") * alpha).alias("score"))
    return seeds.unionByName(moved).groupBy("query_id", "id").agg(F.sum("score").alias("score"))


def spread(results: DataFrame, edges: DataFrame, alpha: float, max_hops: int = 2) -> DataFrame:
    """Spreading activation: a seed's mass ``1 / rank`` flows along edges, times ``weight / (depth + 1)`` at each hop;
    ``(1 - alpha) * mass + alpha * activation`` is the score of ``(query_id, id, score)``."""
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    level = results.select("query_id", "id", (1.0 / F.row_number().over(w)).alias("m"))
    parts = level.select("query_id", "id", ((1 - alpha) * F.col("m")).alias("score"))
    e = directed(edges)
    for depth in range(1, max_hops + 1):
        level = level.join(e, F.col("id") == F.col("src")).groupBy("query_id", F.col("dst").alias("id")).agg(F.sum(F.col("m") * F.col("weight") / (depth + 1)).alias("m"))
        parts = parts.unionByName(level.select("query_id", "id", (alpha * F.col("m")).alias("score")))
    return parts.groupBy("query_id", "id").agg(F.sum("score").alias("score"))


def pagerank(edges: DataFrame, damping: float = 0.85, iterations: int = 20, tolerance: float = 1e-4) -> DataFrame:
    """``(node, rank)``: mass of nodes without outgoing edges is spread evenly; stops when the total change is below tolerance
    (a tolerance of 0 runs all iterations)."""
    e = directed(edges).select("src", "dst")
    degree = e.groupBy("src").agg(F.count(F.lit(1)).alias("deg"))
    nodes = e.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node"))).distinct()
    base = cut(nodes.join(degree, F.col("node") == F.col("src"), "left").select("node", "deg"))
    n = base.count()
    if not n:
        return base.select("node", F.lit(0.0).alias("rank"))
    links = cut(e.join(degree, "src").groupBy("src", "dst").agg((F.count(F.lit(1)) / F.first("deg")).alias("share")))
    r = base.withColumn("rank", F.lit(1.0 / n))
    for i in range(iterations):
        loose = r.where("deg is null").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("loose")).scalar()
        flow = r.join(links, F.col("node") == F.col("src")).groupBy("dst").agg(F.sum(F.col("rank") * F.col("share")).alias("flow"))
        new = F.lit((1 - damping) / n) + damping * (F.col("loose") / n + F.coalesce("flow", F.lit(0.0)))
        r = r.join(flow, F.col("node") == F.col("dst"), "left").withColumn("loose", loose).select("node", "deg", new.alias("rank"), F.col("rank").alias("old"))
        last = i == iterations - 1
        if tolerance > 0 or last or i % CUT_EVERY == CUT_EVERY - 1:
            r = cut(r)
            if tolerance > 0 and r.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0] < tolerance:
                break
        r = r.drop("old")
    return r.select("node", "rank")


def label_propagation(edges: DataFrame, iterations: int = 10) -> DataFrame:
    """``(node, label)``: every node with outgoing edges takes, all at once, the label most frequent among the nodes it points
    to, the greater one of ties. A node whose neighbours have no labels keeps its own."""
    e = cut(directed(edges).select("src", "dst"))
    label = e.select(F.col("src").alias("node"), F.col("src").alias("label")).distinct()
    for i in range(iterations):
        votes = e.join(label, F.col("dst") == F.col("node")).groupBy("src", "label").agg(F.count(F.lit(1)).alias("n"))
        best = votes.groupBy("src").agg(F.max(F.struct("n", "label"))["label"].alias("new"))
        label = label.join(best, F.col("node") == F.col("src"), "left").select("node", F.coalesce("new", "label").alias("label"), (F.coalesce("new", "label") != F.col("label")).alias("moved"))
        label = cut(label)
        done = label.where("moved").isEmpty()
        label = label.drop("moved")
        if done:
            break
    return label


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)``: connected components, named by their smallest node; orphans of a proximity graph are those alone.

    Every round a node takes the least label around it and then the label of that label, so paths halve.
    """
    e = cut(directed(edges, "both").select("src", "dst").distinct())
    c = cut(e.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.first("src")).alias("component")))
    while True:
        around = e.join(c, F.col("dst") == F.col("node")).groupBy("src").agg(F.min("component").alias("least"))
        hop = c.join(around, F.col("node") == F.col("src"), "left").select("node", F.col("component").alias("old"), F.least("component", F.coalesce("least", "component")).alias("component"))
        up = c.select(F.col("node").alias("component"), F.col("component").alias("up"))
        new = cut(hop.join(up, "component", "left").select("node", "old", F.least("component", F.coalesce("up", "component")).alias("component")))
        done = new.where("old <> component").isEmpty()
        c = new.select("node", "component")
        if done:
            return c


def paths(pairs: DataFrame, edges: DataFrame, max_hops: int = 4) -> DataFrame:
    """``(start, target, hops, path)`` of each reachable pair: the path with the fewest edges, of these the smallest.

    A frontier keeps one path for each (start, node): what was reached before isn't followed again.
    """
    e = cut(directed(edges).select("src", "dst").distinct())
    pairs = pairs.select("start", "target").distinct()
    level = pairs.select("start", F.col("start").alias("node"), F.array("start").alias("path")).distinct()
    seen = level
    out = pairs.join(level, ["start"]).where("target = node").select("start", "target", F.lit(0).cast("bigint").alias("hops"), "path")
    for h in range(1, max_hops + 1):
        nxt = level.join(e, F.col("node") == F.col("src")).groupBy("start", F.col("dst").alias("node")).agg(F.min(F.concat("path", F.array("dst"))).alias("path"))
        level = cut(nxt.join(seen.select("start", "node"), ["start", "node"], "left_anti"))
        if level.isEmpty():
            break
        seen = cut(seen.unionByName(level))
        out = out.unionByName(pairs.join(level, "start").where("target = node").select("start", "target", F.lit(h).cast("bigint").alias("hops"), "path"))
    return out


def directed_paths(pairs: DataFrame, edges: DataFrame, positions: DataFrame, max_hops: int = 4) -> DataFrame:
    """``(start, target, hops, path, distances)``: of the paths with the fewest edges the one with the least summed distance between
    the ``positions (id, vector)`` of its nodes, of these the smallest.

    A whole level is expanded at once, so an estimate of what is left decides nothing; a pair that is reached is no longer followed,
    and of the ways to a node only the best is.
    """
    at = positions.select(F.col("id"), "vector")
    e = directed(edges).select("src", "dst").distinct()
    e = e.join(at.select(F.col("id").alias("src"), F.col("vector").alias("a")), "src").join(at.select(F.col("id").alias("dst"), F.col("vector").alias("b")), "dst")
    e = cut(e.select("src", "dst", V.l2(F.col("a"), F.col("b")).alias("d")))
    open_ = pairs.select("start", "target").distinct()
    level = open_.select("start", F.col("start").alias("node"), F.array("start").alias("path"), F.array().cast("array<double>").alias("distances"), F.lit(0.0).alias("sum")).distinct()
    seen, out = level.select("start", "node"), None
    for h in range(max_hops + 1):
        if h:
            nxt = level.join(e, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"), F.concat("distances", F.array("d")).alias("distances"), (F.col("sum") + F.col("d")).alias("sum"))
            best = nxt.join(seen, ["start", "node"], "left_anti").groupBy("start", "node").agg(F.min(F.struct(F.round("sum", 9).alias("r"), "path", "distances", "sum")).alias("x"))
            level = cut(best.join(open_.select("start").distinct(), "start", "left_semi").select("start", "node", "x.path", "x.distances", "x.sum"))
            seen = cut(seen.unionByName(level.select("start", "node")))
        got = open_.join(level, "start").where("target = node").select("start", "target", F.lit(h).cast("bigint").alias("hops"), "path", "distances")
        out = got if out is None else out.unionByName(got)
        open_ = cut(open_.join(got.select("start", "target"), ["start", "target"], "left_anti"))
        if open_.isEmpty():
            break
    return out


def strategy(has_target: bool, max_hops: int) -> str:
    """How a path is looked for: towards a target by distance; far explorations level by level in parallel; others level by level."""
    return "directed" if has_target else "parallel" if max_hops > 4 else "levels"


def planned_paths(pairs: DataFrame, edges: DataFrame, positions: DataFrame | None = None, max_hops: int = 4) -> DataFrame:
    """``(start, target, hops, path)``: by distance (see :func:`strategy`) where start and target differ and positions are known."""
    if positions is None:
        return paths(pairs, edges, max_hops)
    away = pairs.where("start <> target")
    return directed_paths(away, edges, positions, max_hops).drop("distances").unionByName(paths(pairs.where("start = target"), edges, 0))


def proximity(neighbors: DataFrame) -> DataFrame:
    """Edges of a nearest-neighbour graph from ``(query_id, id, distance)``: weight ``1 / (1 + distance)``; no edge to itself."""
    return neighbors.where("query_id <> id").select(F.col("query_id").alias("subject"), F.lit("near").alias("predicate"), F.col("id").alias("object"), (1.0 / (1.0 + F.col("distance"))).alias("weight"))
