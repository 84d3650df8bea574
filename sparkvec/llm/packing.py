"""Filling containers of fixed capacity with items: harmonic packing.

Lengths fall into reciprocal-capacity classes: class k holds lengths above ``capacity / (k + 1)`` and up to ``capacity / k``,
of which exactly k fit into one bin. Items are spread over shards by a hash, and each worker fills the bins of every class of its
shard by itself: first each bin of class k gets k items of that class, from the largest class (k = 1) on; then the rests of those
bins are filled with items of the classes of smaller lengths, the largest that fits first; the items that are left go on to
bins of their own class. Nothing is planned for all shards together: a shard leaves at most one bin of each class short of its count.

Plan: one pass sizes the texts, one shuffle takes repeated rows out, one brings a shard's ids and sizes (never texts) together.
A shard has about ``SHARD`` documents, however many there are, and a hot key's documents are spread by their hash.

Defined cases
    Null and blank texts aren't packed. Rows that repeat an id and its text are packed once; a null id is an id like any
    other. A text longer than the capacity is cut into pieces that fill a bin each and a rest that is packed like an item;
    nothing else is split. Equal capacities under several names are packed for each name. Containers with a null, zero or
    negative capacity are ignored. Empty tables give no rows. Bins are numbered within a container, with gaps between shards.
    Other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkvec.llm import tokens

SHARD = 50_000
PACKED = "container string, bin bigint, bin_class bigint, doc_id bigint, text_hash bigint, part bigint, start_token bigint, n_tokens bigint"


def fill_bins(size: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin of every item, class of every bin) of one shard; sizes are within 1 and the capacity."""
    order = np.argsort(-size, kind="stable")
    s = size[order]
    kind = capacity // np.maximum(s, 1)
    left = np.bincount(s, minlength=capacity + 1)  # items of each length without a bin
    first = np.searchsorted(-s, -np.arange(capacity + 1), "left")  # where a length's items begin; used ones are its first
    used = np.zeros(capacity + 1, np.int64)
    present = np.flatnonzero(left)
    below = np.full(capacity + 1, -1, np.int64)  # the greatest length up to this one that may have items
    below[present] = present
    below = np.maximum.accumulate(below).tolist()
    place = np.empty(len(s), np.int64)
    classes: list[np.ndarray] = []
    bins = 0

    def largest(room: int) -> int:
        at = below[room]
        while at > 0 and not left[at]:
            at = below[at - 1]
        below[room] = at
        return at

    for k in np.unique(kind).tolist():
        lengths = present[(capacity // np.maximum(present, 1) == k) & (left[present] > 0)][::-1]
        if not len(lengths):
            continue
        # a class's own bins: k items each, of neighbouring lengths
        own = np.concatenate([np.arange(first[x] + used[x], first[x] + used[x] + left[x]) for x in lengths])
        used[lengths] += left[lengths]
        left[lengths] = 0
        n = -(-len(own) // k)
        at = np.arange(len(own)) // k
        place[own] = bins + at
        rooms: dict[int, list[np.ndarray]] = {}
        room = capacity - np.bincount(at, s[own], n).astype(np.int64)
        for r in np.unique(room).tolist():
            rooms[r] = [bins + np.flatnonzero(room == r)]
        bins += n
        classes.append(np.full(n, k, np.int64))
        # their rests: the largest item that fits, for all bins with the same room at once
        heap = [-r for r in rooms]
        heapq.heapify(heap)
        while heap:
            r = -heapq.heappop(heap)
            open_ = np.concatenate(rooms.pop(r))
            while len(open_) and (x := largest(r)) > 0:
                take = min(len(open_), int(left[x]))
                begin = first[x] + used[x]
                place[begin : begin + take] = open_[:take]
                used[x] += take
                left[x] -= take
                if r > x:
                    if r - x not in rooms:
                        rooms[r - x] = []
                        heapq.heappush(heap, x - r)
                    rooms[r - x].append(open_[:take])
                open_ = open_[take:]
    out = np.empty(len(s), np.int64)
    out[order] = place
    return out, np.concatenate(classes) if classes else np.zeros(0, np.int64)


def containers(packing_sizes: DataFrame) -> list[tuple[str, int]]:
    """A table of settings, one row each."""
    rows = packing_sizes.select("container", F.col("capacity_tokens").cast("bigint").alias("c")).where("c > 0").distinct().collect()
    return sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[1], str(r[0])))


def texts_of(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", "text").where(F.regexp_replace("text", r"(?U)\s", "") != "")


def pack(documents: DataFrame, packing_sizes: DataFrame, path: str = tokens.TOKENIZER, shard: int = SHARD) -> DataFrame:
    """``(container, bin, bin_class, doc_id, text_hash, part, start_token, n_tokens)``: where every document, or piece of one, goes."""
    spark: SparkSession = documents.sparkSession
    full = containers(packing_sizes)
    if not full:
        return spark.createDataFrame([], PACKED)
    shards = max(1, -(-documents.count() // shard))
    sized = tokens.sizes(texts_of(documents), ["doc_id"], path=path).distinct()
    placed = sized.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(shards)))

    def fill_shard(group: pa.Table) -> pa.Table:
        out = []
        t = group.sort_by([("n_tokens", "descending"), ("doc_id", "ascending"), ("text_hash", "ascending")])
        doc, h, n, own = t.column("doc_id"), t.column("text_hash"), t.column("n_tokens").to_numpy(), t.column("shard")[0].as_py()
        for name, c in full:
            pieces = -(-n // c)
            at = np.repeat(np.arange(len(n)), pieces)
            part = np.arange(len(at)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            size = np.minimum(n[at] - part * c, c)
            bin_, kind = fill_bins(size, c)
            take = pa.array(at)
            out.append(pa.table([
                pa.array([name] * len(at), pa.string()), pa.array(own << 32 | bin_), pa.array(kind[bin_]), doc.take(take), h.take(take), pa.array(part), pa.array(part * c), pa.array(size),
            ], names=[x.split()[0] for x in PACKED.split(", ")]))
        return pa.concat_tables(out)

    return placed.groupBy("shard").applyInArrow(fill_shard, PACKED)


def fill(packed: DataFrame, packing_sizes: DataFrame) -> DataFrame:
    """``(container, capacity_tokens, bin_class, bins, documents, tokens, fullest, used_share)``: how full each class's bins are."""
    per_bin = packed.groupBy("container", "bin", "bin_class").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("d"))
    total = per_bin.groupBy("container", "bin_class").agg(F.count(F.lit(1)).alias("bins"), F.sum("d").alias("documents"), F.sum("t").alias("tokens"), F.max("t").alias("fullest"))
    sizes = packing_sizes.select("container", F.col("capacity_tokens").cast("bigint").alias("capacity_tokens")).distinct()
    return total.join(sizes, total["container"].eqNullSafe(sizes["container"])).select(total["container"], "capacity_tokens", "bin_class", "bins", "documents", "tokens", "fullest", (F.col("tokens") / (F.col("bins") * F.col("capacity_tokens"))).alias("used_share"))


def checked(documents: DataFrame, packed: DataFrame, packing_sizes: DataFrame, path: str = tokens.TOKENIZER) -> DataFrame:
    """``(container, texts, lost_tokens, overfull_bins, needless_splits, lone_bins)``: what must hold of a packing; all but ``texts`` are 0.

    ``lost_tokens`` are those of texts that aren't covered once from end to end, ``lone_bins`` bins with fewer items than their class
    beyond one in each shard and class.
    """
    sized = tokens.sizes(texts_of(documents), ["doc_id"], path=path).distinct().withColumnRenamed("n_tokens", "size")
    caps = packing_sizes.select("container", F.col("capacity_tokens").cast("bigint").alias("capacity")).where("capacity > 0").distinct()
    own = packed.groupBy("container", "doc_id", "text_hash").agg(F.sum("n_tokens").alias("placed"), F.count(F.lit(1)).alias("pieces"), F.max(F.col("start_token") + F.col("n_tokens")).alias("reach"), F.count_distinct("start_token").alias("starts"))
    want = sized.join(F.broadcast(caps))  # a table of settings
    both = want.join(own, [want["container"].eqNullSafe(own["container"]), want["doc_id"].eqNullSafe(own["doc_id"]), want["text_hash"] == own["text_hash"]], "left")
    whole = (F.col("placed") == F.col("size")) & (F.col("reach") == F.col("size")) & (F.col("starts") == F.col("pieces"))
    texts = both.groupBy(want["container"].alias("container")).agg(
        F.count(F.lit(1)).alias("texts"), F.coalesce(F.sum(F.when(~F.coalesce(whole, F.lit(False)), F.col("size"))), F.lit(0)).cast("bigint").alias("lost_tokens"),
        F.coalesce(F.sum(F.when(F.col("pieces") != F.ceil(F.col("size") / F.col("capacity")), 1)), F.lit(0)).cast("bigint").alias("needless_splits"),
    )
    per_bin = packed.groupBy("container", "bin", "bin_class").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("d")).join(F.broadcast(caps), "container")
    short = per_bin.groupBy("container", "bin_class", F.shiftright("bin", 32).alias("shard")).agg(F.sum(F.when(F.col("t") > F.col("capacity"), 1).otherwise(0)).alias("over"), F.sum(F.when(F.col("d") < F.col("bin_class"), 1).otherwise(0)).alias("few"))
    bins = short.groupBy("container").agg(F.sum("over").cast("bigint").alias("overfull_bins"), F.sum(F.greatest(F.col("few") - 1, F.lit(0))).cast("bigint").alias("lone_bins"))
    return texts.join(bins, "container").select("container", "texts", "lost_tokens", "overfull_bins", "needless_splits", "lone_bins")
