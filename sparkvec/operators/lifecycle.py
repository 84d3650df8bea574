"""Life of a dataset's rows: deletion marks, last writer wins, expiry, victims, density, digests, clocks, routing."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkvec.functions import vector as V
from sparkvec.operators import knn


class SchemaError(ValueError):
    pass


def without_deleted(df: DataFrame, tombstones: DataFrame, id_col: str = "id") -> DataFrame:
    """The rows whose id isn't marked as deleted; marks with a null id delete nothing."""
    return df.join(tombstones.select(id_col).distinct(), id_col, "left_anti")


def last_writer(df: DataFrame, key: str, ts: str, tie: str | None = None) -> DataFrame:
    """One row for each key: the one with the greatest timestamp (a null one is the earliest). Of equal ones the first holds,
    by the smallest ``tie``. An aggregate with a map-side combine, so a key written very often is no hot task."""
    cols = df.columns
    order = [F.col(ts)] + ([-F.col(tie)] if tie else [])
    best = df.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_r"))
    return best.select(*[F.col("_r")[c].alias(c) for c in cols])


def upserted(base: DataFrame, changes: DataFrame, key: str, ts: str) -> DataFrame:
    """Base with the changes that are newer: equal timestamps keep the base's row."""
    both = base.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return last_writer(both, key, ts, "_new").drop("_new")


def evolved(base: DataFrame, extra: DataFrame, dropped: Iterable[str] = ()) -> DataFrame:
    """Rows of both, aligned by name: new columns are added, missing ones null. A changed type or a dropped name is an error."""
    gone = set(dropped)
    for f in extra.schema.fields:
        if f.name in gone:
            raise SchemaError(f"column {f.name!r} was dropped and can't be used again")
        if f.name in base.columns and base.schema[f.name].dataType != f.dataType:
            raise SchemaError(f"column {f.name!r} is {base.schema[f.name].dataType.simpleString()}, not {f.dataType.simpleString()}")
    return base.unionByName(extra, allowMissingColumns=True)


def live(df: DataFrame, created: Column, ttl_seconds: Column, now: Column) -> DataFrame:
    """Rows that aren't expired: a ttl of 0 or null never expires."""
    seconds = lambda t: t.cast("timestamp").cast("double")
    age = seconds(now) - seconds(created)
    return df.where(F.coalesce(ttl_seconds <= 0, F.lit(True)) | (age <= ttl_seconds))


def victims(accesses: DataFrame, n: int, policy: str = "lru", id_col: str = "id", ts: str = "ts") -> DataFrame:
    """``(id, last_access, accesses)`` of the n to evict first: longest unused (lru) or least used (lfu); ties by id."""
    use = accesses.groupBy(F.col(id_col).alias("id")).agg(F.max(ts).alias("last_access"), F.count(F.lit(1)).alias("accesses"))
    if policy not in ("lru", "lfu"):
        raise ValueError("policy must be lru or lfu")
    return use.orderBy("last_access" if policy == "lru" else "accesses", "id").limit(n)


def evicted(datasets: DataFrame, target: int, policy: str = "lru", written: str | None = None) -> DataFrame:
    """The datasets ``(name, bytes, last_access, created)`` to evict, in order, until no more than ``target`` bytes remain.

    One row per dataset, so a window over all of them is small. The one being written is never evicted.
    """
    order = {"lru": [F.col("last_access")], "oldest": [F.col("created")], "largest": [F.desc("bytes")]}[policy]
    total = datasets.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("t")).scalar()
    cand = datasets.where(F.col("name") != F.lit(written)) if written else datasets
    before = F.coalesce(F.sum("bytes").over(W.orderBy(*order, "name").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return cand.withColumn("_before", before).where(total - F.col("_before") > target).drop("_before")


def density(rows: DataFrame, tombstones: DataFrame, by: str, id_col: str = "id", threshold: float | None = None) -> DataFrame:
    """``(<by>, size, deleted, density)``: the share of rows not deleted in each batch; those below the threshold need compaction."""
    t = tombstones.select(F.col(id_col)).distinct().withColumn("_dead", F.lit(1))
    d = rows.join(t, id_col, "left").groupBy(by).agg(F.count(F.lit(1)).alias("size"), F.count("_dead").alias("deleted"))
    d = d.withColumn("density", 1.0 - F.col("deleted") / F.col("size"))
    return d if threshold is None else d.where(F.col("density") < threshold)


WORDS = 4  # of 60 bits


def _words(text: Column) -> Column:
    """240 bits of the SHA-256 of a text as four numbers."""
    h = F.sha2(text, 256)
    return F.array(*[F.conv(F.substr(h, F.lit(1 + 15 * i), F.lit(15)), 16, 10).cast("bigint") for i in range(WORDS)])


def digest_leaves(df: DataFrame, id_col: str = "id", ts: str = "ts", fanout: int = 16, depth: int = 4) -> DataFrame:
    """``(leaf, digest, rows)``: ids fall into fanout**depth leaves by their SHA-256; a leaf's digest is the SHA-256 of the XOR of its
    rows' (of id and time in microseconds), so it doesn't depend on order and is combined on the map side."""
    row = F.concat_ws("|", F.col(id_col).cast("string"), F.unix_micros(F.col(ts).cast("timestamp")).cast("string"))
    x = df.select((_words(F.col(id_col).cast("string"))[0] % fanout**depth).alias("leaf"), _words(row).alias("w"))
    sums = x.groupBy("leaf").agg(*[F.bit_xor(F.col("w")[i]).alias(f"x{i}") for i in range(WORDS)], F.count(F.lit(1)).alias("rows"))
    return sums.select("leaf", F.sha2(F.concat_ws("|", *[F.col(f"x{i}").cast("string") for i in range(WORDS)]), 256).alias("digest"), "rows")


def digest_level(leaves: DataFrame, fanout: int = 16) -> DataFrame:
    """The level above: each parent's digest is the SHA-256 of its children's, in order (at most ``fanout`` of them)."""
    g = leaves.groupBy(F.floor(F.col("leaf") / fanout).alias("leaf"))
    children = F.transform(F.sort_array(F.collect_list(F.struct("leaf", "digest"))), lambda c: F.concat_ws(":", c["leaf"].cast("string"), c["digest"]))
    return g.agg(F.sha2(F.concat_ws("|", children), 256).alias("digest"), F.sum("rows").alias("rows"))


def digest_root(df: DataFrame, id_col: str = "id", ts: str = "ts", fanout: int = 16, depth: int = 4) -> DataFrame:
    level = digest_leaves(df, id_col, ts, fanout, depth)
    for _ in range(depth):
        level = digest_level(level, fanout)
    return level.select("digest", "rows")


def differing_leaves(a: DataFrame, b: DataFrame) -> DataFrame:
    """Leaves whose digests differ between two :func:`digest_leaves`."""
    x, y = a.select("leaf", F.col("digest").alias("da")), b.select("leaf", F.col("digest").alias("db"))
    return x.join(y, "leaf", "full").where(~F.col("da").eqNullSafe(F.col("db"))).select("leaf")


def clock_merge(a: Column, b: Column) -> Column:
    """Greatest entry of each node of two clocks (maps from node to count)."""
    return F.map_zip_with(a, b, lambda _, x, y: F.greatest(x, y))


def clock_order(a: Column, b: Column) -> Column:
    """equal, before, after or concurrent; a missing node counts 0."""
    both = F.map_values(F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, F.lit(0)).cast("bigint") - F.coalesce(y, F.lit(0)).cast("bigint")))
    less, more = F.exists(both, lambda d: d < 0), F.exists(both, lambda d: d > 0)
    return F.when(less & more, "concurrent").when(less, "before").when(more, "after").otherwise("equal")


def quorum(level: str, n: int) -> int:
    return {"ONE": 1, "QUORUM": n // 2 + 1, "ALL": n}[level.upper()]


def routed(queries: DataFrame, regions: DataFrame, limit: int, slack: float = 1.5) -> DataFrame:
    """``(query_id, owner_id, distance, rank)``: owners of the regions within ``slack`` radii of each query, nearest first, each once.

    ``queries (query_id, vector)`` go to the regions' tasks in blocks; regions without a usable centroid or radius, or without an
    owner, are skipped.
    """
    r = regions.where(F.col("owner_id").isNotNull() & F.col("centroid").isNotNull() & (F.col("radius") > 0) & ~F.isnan("radius"))
    r = r.select("owner_id", F.col("radius").cast("double").alias("radius"), V.doubles(F.col("centroid")).alias("c"))
    kind = dict(queries.dtypes)["query_id"]
    out = queries.sparkSession.createDataFrame([], f"query_id {kind}, owner_id string, distance double")
    for block in knn.blocks(queries.select(F.col("query_id").alias("q"), V.doubles(F.col("vector")).alias("v")).where("v is not null")):
        q = np.array([x["v"] for x in block], np.float64)
        names = pa.array([x["q"] for x in block])

        def near(batches: Iterator[pa.RecordBatch], q: np.ndarray = q, names: pa.Array = names) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = pa.array(np.flatnonzero(pc.list_value_length(b.column("c")).to_numpy(zero_copy_only=False) == q.shape[1]))
                c = b.column("c").take(keep).flatten().to_numpy(zero_copy_only=False).reshape(-1, q.shape[1])
                reach, owner = b.column("radius").take(keep).to_numpy() * slack, b.column("owner_id").take(keep)
                for i in range(0, len(q), 256):
                    d = np.sqrt(((q[i : i + 256, None, :] - c[None]) ** 2).sum(2))
                    a, z = np.nonzero(d <= reach[None])
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(i + a)), owner.take(pa.array(z)), pa.array(d[a, z])], names=["query_id", "owner_id", "distance"])

        out = out.unionByName(r.mapInArrow(near, f"query_id {kind}, owner_id string, distance double"))
    own = out.groupBy("query_id", "owner_id").agg(F.min("distance").alias("distance"))
    w = W.partitionBy("query_id").orderBy("distance", "owner_id")
    return own.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= limit)


def ring(nodes: list[str], virtual: int = 64) -> list[tuple[int, str]]:
    """Points of a consistent-hash ring: ``virtual`` for each node, at 60 bits of the MD5 of name and number."""
    return sorted((int(hashlib.md5(f"{n}#{i}".encode()).hexdigest()[:15], 16), n) for n in nodes for i in range(virtual))


def owners(df: DataFrame, key: str, nodes: list[str], replicas: int = 1, virtual: int = 64) -> DataFrame:
    """``df`` with ``owners``: the first ``replicas`` distinct nodes clockwise from the key's place on the ring."""
    points = ring(nodes, virtual)
    names = [n for _, n in points]
    prefer = [list(dict.fromkeys(names[i:] + names[:i]))[:replicas] for i in range(len(points))]
    place = F.conv(F.substr(F.md5(F.col(key).cast("string")), F.lit(1), F.lit(15)), 16, 10).cast("bigint")

    @F.pandas_udf("array<string>")
    def clockwise(at: pd.Series) -> pd.Series:
        i = np.searchsorted([p for p, _ in points], at.to_numpy(), "left") % len(points)
        return pd.Series([prefer[x] for x in i], index=at.index)

    return df.withColumn("owners", clockwise(place))
