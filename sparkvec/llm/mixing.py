"""Mixing sources to target weights.

Every source's texts are laid end to end, in the order of a hash, and cut into blocks of ``block`` tokens. The output is
a sequence of shards of ``shard_blocks`` slots. How many of a shard's slots each source gets is drawn multinomially with the
target weights, shard by shard and for any number of shards alike. All drawn slots of a source are mapped through a pseudorandom
permutation of their indices, and those numbers, up to the source's quota, through another one for each repetition to its
blocks: all blocks are used once before any is used again, and none more than ``max_repeats`` times. What chance drew above a
source's quota (about the square root of its slots, spread over all shards by the permutation) goes to the sources that it
drew too rarely, so the totals are met exactly. Blocks are joined by (source, index).

Totals. Without ``total_blocks`` the selection is as large as it can be while every source that has documents reaches its
share: the sources without documents leave theirs to the others in proportion. With ``total_blocks`` sources that run short give
all they may, and the others share the rest in proportion to their targets.

Scale. Draws are made by the workers in runs of ``RUN`` shards, each from a seed of its own, so a lost task draws the same again;
there are as many tasks as runs ask for. A run's first slot numbers and the documents' positions come from running sums that
don't gather a source in one task (``operators.prefix``); the driver sees one total for each source. A document is joined only
through its blocks, at most one more than its tokens fill.

Defined cases
    Sources are compared in lower case with blanks, hyphens and underscores alike. Documents with a null source, or one
    without a target, take no part; nor do null and blank texts. Rows that repeat an id and its text count once. Targets that
    are null, zero or negative count as 0, a null ``max_repeats`` as 1; if a source has several targets the greatest holds. The
    last block of a source may be shorter. Without documents or targets the result is empty. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkvec.llm import tokens
from sparkvec.operators.prefix import running
from sparkvec.session import cut

BLOCK = 256
SHARD_BLOCKS = 1024
SEED = 11
RUN = 16
TASK_RUNS = 64
SELECTION = "shard bigint, slot bigint, source string, block bigint, repeat bigint"


def source_name(c: str) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.col(c))), r"[\s_\-]+", "_")


def targets(mix_targets: DataFrame) -> dict[str, tuple[float, int]]:
    """Each source's share and repeats; a table of settings, one row per source."""
    t = mix_targets.select(source_name("source").alias("s"), "target_share", "max_repeats").where("s is not null").groupBy("s").agg(F.max("target_share"), F.max("max_repeats")).collect()
    clean = {r[0]: (float(r[1]) if r[1] is not None and r[1] > 0 and np.isfinite(r[1]) else 0.0, max(0, int(r[2])) if r[2] is not None else 1) for r in t}
    return dict(sorted(clean.items()))


def quotas(share: np.ndarray, most: np.ndarray, total: int | None) -> np.ndarray:
    """Blocks of each source: shares of ``total`` (or of the largest total that all can serve), none above ``most``."""
    open_ = (share > 0) & (most > 0)
    if not open_.any():
        return np.zeros(len(share), np.int64)
    if total is None:
        p = np.where(open_, share, 0) / share[open_].sum()
        total = int(np.floor((most[open_] / p[open_]).min()))
        return np.minimum(np.rint(p * total), most).astype(np.int64)
    out = np.zeros(len(share))
    while open_.any():
        rest = total - out[~open_].sum()
        want = np.where(open_, share, 0) / share[open_].sum() * rest
        short = open_ & (want >= most)
        if not short.any():
            out[open_] = want[open_]
            break
        out[short], open_ = most[short], open_ & ~short
    return np.minimum(np.rint(out), most).astype(np.int64)


def permutation(n: int, turn: int, seed: int) -> tuple[int, int]:
    """(a, b) of the permutation i -> (a * i + b) mod n of 0 .. n - 1."""
    r = np.random.default_rng([seed, turn, n])
    a = int(r.integers(1, max(2, n)))
    while gcd(a, n) != 1:
        a = a % max(2, n) + 1
    return a, int(r.integers(0, n))


def drawn(run: int, shards: int, total: int, shard_blocks: int, p: np.ndarray, seed: int) -> np.ndarray:
    """(shards of the run, sources): how many slots of each of its shards every source gets."""
    first = run * RUN
    own = np.arange(first, min(first + RUN, shards))
    slots = np.minimum(total - own * shard_blocks, shard_blocks)
    return np.random.default_rng([seed, 0, run]).multinomial(slots, p)


class Slots:
    """Where the drawn slots of every source lead: to (source, number) below the source's quota."""

    def __init__(self, got: np.ndarray, quota: np.ndarray, seed: int):
        self.got, self.quota = got, quota
        self.mix = [permutation(int(n), 0, seed + 1000 + i) if n else (1, 0) for i, n in enumerate(got)]
        over, under = np.maximum(got - quota, 0), np.maximum(quota - got, 0)
        self.over_first, self.under_end = np.cumsum(over) - over, np.cumsum(under)
        self.under_first = self.under_end - under

    def place(self, s: int, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        j = permuted(index, *self.mix[s], int(self.got[s]))
        src = np.full(len(j), s)
        over = np.flatnonzero(j >= self.quota[s])
        if len(over):
            u = self.over_first[s] + j[over] - self.quota[s]
            src[over] = np.searchsorted(self.under_end, u, "right")
            j[over] = self.got[src[over]] + u - self.under_first[src[over]]
        return src, j


def permuted(i: np.ndarray, a: int, b: int, n: int) -> np.ndarray:
    # products of numbers below 2**31 fit; beyond, Python's integers are used
    return ((a * (i if n < 2**31 else i.astype(object)) + b) % n).astype(np.int64)


def positions(documents: DataFrame, names: list[str], path: str) -> DataFrame:
    """``(source, doc_id, text_hash, n_tokens, before)``: each document's place in its source's sequence of tokens."""
    texts = documents.select(source_name("source").alias("source"), "doc_id", "text").where(F.col("source").isin(names) & (F.regexp_replace("text", r"(?U)\s", "") != ""))
    sized = cut(tokens.sizes(texts, ["source", "doc_id"], path=path).distinct().where("n_tokens > 0"))
    return running(sized, ["source"], F.col("n_tokens"), ["doc_id", "text_hash"], sized.count())


def mix(documents: DataFrame, mix_targets: DataFrame, block: int = BLOCK, shard_blocks: int = SHARD_BLOCKS, total_blocks: int | None = None, seed: int = SEED, path: str = tokens.TOKENIZER) -> DataFrame:
    """``(shard, slot, source, block, repeat, doc_id, text_hash, start_token, n_tokens)``: the pieces of every slot's block.

    ``start_token`` counts within the document; a block that spans several documents has several rows.
    """
    spark = documents.sparkSession
    wanted = targets(mix_targets)
    names = list(wanted)
    placed = cut(positions(documents, names, path))
    # one row for each source of the settings
    have = {r[0]: -(-int(r[1]) // block) for r in placed.groupBy("source").agg(F.max(F.col("before") + F.col("n_tokens"))).collect()}
    blocks = np.array([have.get(s, 0) for s in names], np.int64)
    quota = quotas(np.array([wanted[s][0] for s in names]), blocks * np.array([wanted[s][1] for s in names]), total_blocks)
    total = int(quota.sum())
    shards = -(-total // shard_blocks)
    if not total:
        return spark.createDataFrame([], SELECTION + ", doc_id bigint, text_hash bigint, start_token bigint, n_tokens bigint")
    turns = [[permutation(int(b), t, seed + i) for t in range(-(-int(q) // int(b)))] if b and q else [] for i, (b, q) in enumerate(zip(blocks, quota, strict=True))]
    p = quota / total
    runs = -(-shards // RUN)
    numbers = spark.range(0, runs, 1, max(-(-runs // TASK_RUNS), min(runs, spark.sparkContext.defaultParallelism)))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("id").to_numpy()
            n = [drawn(int(r), shards, total, shard_blocks, p, seed).sum(0) for r in ids]
            if n:
                yield pa.record_batch({"run": pa.array(np.repeat(ids, len(p))), "s": pa.array(np.tile(np.arange(len(p)), len(ids))), "n": pa.array(np.concatenate(n))})

    per_run = numbers.mapInArrow(counted, "run bigint, s bigint, n bigint")
    begins = cut(running(per_run, ["s"], F.col("n"), ["run"], runs * len(p), "begin"))
    got = np.zeros(len(p), np.int64)
    for r in begins.groupBy("s").agg(F.sum("n").alias("n")).collect():  # one row for each source
        got[r["s"]] = r["n"]
    where = Slots(got, quota, seed)

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for run, own in zip(b.column("run").to_pylist(), b.column("begins").to_pylist(), strict=True):
                begin = np.array([x["begin"] for x in own], np.int64)
                for i, n in enumerate(drawn(run, shards, total, shard_blocks, p, seed)):
                    shard = run * RUN + i
                    src, number = (np.concatenate(x) for x in zip(*[where.place(s, np.arange(begin[s], begin[s] + n[s])) for s in range(len(n))], strict=True))
                    begin = begin + n
                    blk, rep = np.zeros(len(src), np.int64), np.zeros(len(src), np.int64)
                    for s in np.unique(src).tolist():
                        at = np.flatnonzero(src == s)
                        rep[at] = number[at] // blocks[s]
                        for turn in np.unique(rep[at]).tolist():
                            x = at[rep[at] == turn]
                            blk[x] = permuted(number[x] % blocks[s], *turns[s][turn], int(blocks[s]))
                    order = np.random.default_rng([seed, 1, shard]).permutation(len(src))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(src), shard)), pa.array(np.arange(len(src))), pa.array([names[s] for s in src[order]], pa.string()), pa.array(blk[order]), pa.array(rep[order]),
                    ], names=["shard", "slot", "source", "block", "repeat"])

    # a run has one entry for each source
    chosen = begins.groupBy("run").agg(F.sort_array(F.collect_list(F.struct("s", "begin"))).alias("begins")).mapInArrow(slots, SELECTION)
    first, last = F.floor(F.col("before") / block), F.floor((F.col("before") + F.col("n_tokens") - 1) / block)
    pieces = placed.select("source", "doc_id", "text_hash", "before", "n_tokens", F.explode(F.sequence(first, last)).alias("block"))
    at = F.greatest(F.col("before"), F.col("block") * block)
    end = F.least(F.col("before") + F.col("n_tokens"), (F.col("block") + 1) * block)
    pieces = pieces.select("source", "block", "doc_id", "text_hash", (at - F.col("before")).alias("start_token"), (end - at).alias("n_tokens"))
    return chosen.join(pieces, ["source", "block"]).select("shard", "slot", "source", "block", "repeat", "doc_id", "text_hash", "start_token", "n_tokens")


def shares(selection: DataFrame, mix_targets: DataFrame) -> DataFrame:
    """``(source, target_share, max_repeats, selected_tokens, actual_share)`` of a selection of :func:`mix`."""
    t = mix_targets.select(source_name("source").alias("source"), "target_share", "max_repeats").where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    got = selection.groupBy("source").agg(F.sum("n_tokens").alias("selected_tokens"), (F.max("repeat") + 1).alias("repeats"))
    out = t.join(got, "source", "left").withColumn("selected_tokens", F.coalesce("selected_tokens", F.lit(0)))
    total = got.agg(F.sum("selected_tokens")).scalar()
    return out.select("source", "target_share", "max_repeats", "repeats", "selected_tokens", F.coalesce(F.col("selected_tokens") / total, F.lit(0.0)).alias("actual_share"))


def checked(selection: DataFrame, documents: DataFrame, mix_targets: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """``(source, has_documents, share_met, repeats_met)``: what must hold of a selection as large as it can be.

    A share is met if it is within ``tolerance`` of the target's part of the targets of all sources with documents.
    """
    known = documents.where("doc_id is not null").select(source_name("source").alias("source"), "text").where(F.regexp_replace("text", r"(?U)\s", "") != "").select("source").distinct().withColumn("has_documents", F.lit(True))
    s = shares(selection, mix_targets).join(known, "source", "left").withColumn("has_documents", F.coalesce("has_documents", F.lit(False)))
    whole = s.where("has_documents").agg(F.sum("target_share")).scalar()
    due = F.when(F.col("has_documents"), F.col("target_share") / whole).otherwise(0.0)
    return s.select("source", "has_documents", (F.abs(F.col("actual_share") - due) <= tolerance).alias("share_met"), (F.coalesce("repeats", F.lit(0)) <= F.col("max_repeats")).alias("repeats_met"))
