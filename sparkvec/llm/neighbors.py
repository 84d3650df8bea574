"""Most similar vectors for every vector: multi-index hashing with learned rotated binary codes.

Codes. Rotations are learned on a bounded sample (``SAMPLE`` ids with the smallest hashes): principal axes, then an iterated
orthogonal rotation that brings the sample nearest to the corners of a cube; a bit says on which side of the sample's median a
coordinate lies. The code of ``tables * bits`` bits is split into one substring per table.

Index. Every vector is entered into every table under its substring. Substrings are read to an adaptive length: a histogram
over *all* rows extends a prefix, bit by bit, until its bucket holds at most ``cap`` rows, so buckets stay the same size
however many vectors there are, in dense places too. A substring that runs out is continued with the bits of the next tables.

Probing. Two codes that differ in at most ``tables - 1`` bits agree in at least one substring (pigeonhole), so looking into a
vector's bucket in each table retrieves every code within that Hamming radius, and by the adaptive prefixes many beyond.
What is retrieved is ranked by the distance of the vectors themselves, in blocks by a matrix product: all of a bucket, not only
the codes nearest by Hamming distance, for that choice was measured to cost half as much again and to lose neighbours of vectors
that lie in no group. A pair that already shares a bucket in an earlier table isn't sent again.

Scale. A bucket is one task's work and of bounded size; the work is rows x tables x cap. Vectors cross the network once per
table, packed in binary rows (16-bit steps of each vector's own range, or 32-bit floats with ``exact=True``); results cross
it as packed triples. Nothing about single rows reaches the driver: only the sample and the histogram, of at most
``tables * 2**depth`` counts.

Dense places. A bucket above ``2 * cap`` rows at the greatest depth lies on one side of the thresholds. Codes are learned anew on
a sample of its own rows, each table taking its own substring of them, and split it by a histogram of all its rows; so again for
what is still too large. What no code learned from it splits (copies, mostly) is compared in full: pieces of ``cap`` rows by a
hash of the id, every piece with every other, which takes rows x rows of that bucket.

Defined cases
    Unusable rows and repeated ids: see ``vectors``. Ties of the distance go to the smaller id. With fewer than k other ids
    the lists are shorter; a single id has an empty list, an empty table no rows. Columns other than those named are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkvec.llm.vectors import DIM, newest

SAMPLE = 10_000
CAP = 8_000
TABLES = 5
WIDE = 24_000  # rows a bucket where the ten nearest of every id are asked for, also of those in no group
BITS = 24
MAX_DEPTH = 22
SEED = 7
FLUSH = 1 << 17
GROUP = 64
LEAST_GROUP = 4
EXTRA = 6


# ---------------------------------------------------------------- codes
def learn(sample: np.ndarray, tables: int, bits: int, rounds: int = 12, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(projection, thresholds) of ``tables * bits`` bits."""
    d = sample.shape[1]
    if len(sample) < 2:
        return np.zeros((d, tables * bits), np.float32), np.zeros(tables * bits, np.float32)
    mean = sample.mean(0)
    centred = (sample - mean).astype(np.float64)
    _, axes = np.linalg.eigh(np.cov(centred.T))
    y = centred @ axes
    out = []
    for turn in range(-(-tables * bits // d)):
        r = np.linalg.qr(np.random.default_rng(seed + turn).normal(size=(d, d)))[0]
        for _ in range(rounds):
            u, _, vt = np.linalg.svd(np.sign(y @ r).T @ y)
            r = (u @ vt).T
        out.append(axes @ r)
    w = np.concatenate(out, 1)[:, : tables * bits]
    return w.astype(np.float32), np.median(sample @ w, 0).astype(np.float32)


class Index:
    """The codes' parameters and, for each table, the bucket of every prefix."""

    def __init__(self, w: np.ndarray, t: np.ndarray, tables: int, bits: int, depth: int, cap: int):
        self.w, self.t, self.tables, self.bits, self.depth, self.cap = w, t, tables, bits, depth, cap
        self.bucket: list[np.ndarray] = []
        self.first: list[int] = []
        self.pieces: list[np.ndarray] = []

    def prefixes(self, x: np.ndarray) -> np.ndarray:
        """(rows, tables) prefixes of ``depth`` bits."""
        side = (x @ self.w) > self.t
        out = np.empty((len(x), self.tables), np.int64)
        weights = 1 << np.arange(self.depth - 1, -1, -1)
        for j in range(self.tables):
            order = (j * self.bits + np.arange(self.depth)) % side.shape[1]
            out[:, j] = side[:, order] @ weights
        return out

    def fit(self, counts: list[np.ndarray]) -> None:
        """Cut each table's prefixes into buckets of at most ``cap`` rows."""
        sizes = []
        for c in counts:
            label, size = leaves(c, self.depth, self.cap)
            self.bucket.append(label)
            self.first.append(sum(map(len, sizes)))
            sizes.append(size)
        self.size = np.concatenate(sizes)
        self.table = np.repeat(np.arange(self.tables), [len(x) for x in sizes])
        self.top = np.arange(len(self.size))
        self.below: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, int]] = {}
        self.pieces: dict[int, int] = {}

    def split(self, part: int, w: np.ndarray, t: np.ndarray, counts: np.ndarray) -> bool:
        """Cut a bucket by codes of its own; False if they leave it nearly whole."""
        label, size = leaves(counts, len(t), self.cap)
        if size.max() > 0.9 * self.size[part]:
            return False
        self.below[part] = w, t, label, len(self.size)
        self.size = np.concatenate([self.size, size])
        self.table = np.concatenate([self.table, np.full(len(size), self.table[part])])
        self.top = np.concatenate([self.top, np.full(len(size), self.top[part])])
        return True

    def parts(self, x: np.ndarray) -> np.ndarray:
        """(rows, tables) numbers of the buckets, all tables counted through."""
        p = self.prefixes(x)
        out = np.stack([self.first[j] + self.bucket[j][p[:, j]] for j in range(self.tables)], 1).astype(np.int64)
        for part, (w, t, label, first) in self.below.items():  # a bucket comes before those it is split into
            rows = np.flatnonzero(out[:, self.table[part]] == part)
            if len(rows):
                out[rows, self.table[part]] = first + label[side_numbers(x[rows], w, t)]
        return out

    def number(self) -> None:
        """Give the pieces numbers of their own, after those of the buckets."""
        self.base: dict[int, int] = {}
        for part, n in self.pieces.items():
            self.base[part] = len(self.table)
            self.table = np.concatenate([self.table, np.full(n, self.table[part])])
            self.top = np.concatenate([self.top, np.full(n, self.top[part])])

    def pieced(self, x: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """(rows, tables) numbers of the buckets or, where no code splits them, of their pieces."""
        out = self.parts(x)
        for part, first in self.base.items():
            j = self.table[part]
            rows = np.flatnonzero(out[:, j] == part)
            out[rows, j] = first + self.piece(part, ids[rows], int(j))
        return out

    def cuts(self) -> np.ndarray:
        """Into how many buckets or pieces the prefixes' bucket of each one is cut."""
        last = ~np.isin(np.arange(len(self.top)), [*self.below, *self.pieces])
        return np.bincount(self.top[last], minlength=len(self.top))[self.top]

    def piece(self, part: int, ids: np.ndarray, salt: int = 0) -> np.ndarray:
        """The piece of each id of a bucket that no code splits."""
        return (mixed(ids, salt) % np.uint64(self.pieces[part])).astype(np.int64)

    def tasks(self, parts: np.ndarray, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, keys): where rows of one table's buckets are searched; both pieces of every two meet under one key."""
        whole = ~np.isin(parts, list(self.pieces))
        yield np.flatnonzero(whole), parts[whole] << 32
        for part in np.unique(parts[~whole]):
            rows = np.flatnonzero(parts == part)
            own, n = self.piece(part, ids[rows]), self.pieces[part]
            for other in range(n):
                at = own != other
                yield rows[at], part << 32 | np.minimum(own[at], other) * n + np.maximum(own[at], other)


def leaves(c: np.ndarray, depth: int, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every prefix, rows of every bucket) from the rows of every prefix."""
    label = np.zeros(len(c), np.int32)
    done = np.zeros(len(c), bool)
    sizes, n = [], 0
    for level in range(depth + 1):
        span = 1 << (depth - level)
        total = c.reshape(-1, span).sum(1)
        free = ~done[::span]
        leaf = free & ((total <= cap) | (level == depth))
        ids = np.flatnonzero(leaf)
        number = np.zeros(len(total), np.int32)
        number[ids] = n + np.arange(len(ids))
        spread = np.repeat(leaf, span)
        label[spread] = np.repeat(number, span)[spread]
        done |= spread
        sizes.append(total[ids])
        n += len(ids)
    return label, np.concatenate(sizes)


def side_numbers(x: np.ndarray, w: np.ndarray, t: np.ndarray) -> np.ndarray:
    return ((x @ w) > t) @ (1 << np.arange(len(t) - 1, -1, -1))


def mixed(ids: np.ndarray, salt: int = 0) -> np.ndarray:
    """31 bits of a hash of each id."""
    h = (ids.astype(np.uint64) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h >> np.uint64(33)


def matrix(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """ids and vectors of a batch whose vectors all have ``dim`` numbers."""
    flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False)
    return batch.column("id").to_numpy(zero_copy_only=False).astype(np.int64), flat.astype(np.float32, copy=False).reshape(-1, dim)


def fit(vectors: DataFrame, dim: int, tables: int, bits: int, cap: int, sample: int) -> Index:
    """Learn the codes on a bounded sample and the buckets on all rows of ``(id, vector)``."""
    some = vectors.select("vector", F.xxhash64("id").alias("h")).orderBy("h").limit(sample).select("vector").toArrow()
    x = some.column("vector").combine_chunks()
    x = (x.flatten().to_numpy(zero_copy_only=False) if len(some) else np.zeros(0)).astype(np.float32).reshape(-1, dim)
    w, t = learn(x, tables, bits)
    # finest prefixes that are counted: deep enough for any number of rows up to cap * 2**(depth - 4)
    n = vectors.count() if len(x) >= sample else len(x)
    depth = min(MAX_DEPTH, tables * bits, max(4, int(np.ceil(np.log2(max(1, n / cap)))) + 5))
    index = Index(w, t, tables, bits, depth, cap)

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(1 << depth, np.int64) for _ in range(tables)]
        for b in batches:
            if b.num_rows:
                p = index.prefixes(matrix(b, dim)[1])
                for j in range(tables):
                    sums[j] += np.bincount(p[:, j], minlength=1 << depth)
        for j in range(tables):
            at = np.flatnonzero(sums[j])
            yield pa.record_batch({"t": pa.array(np.full(len(at), j, np.int32)), "p": pa.array(at.astype(np.int64)), "n": pa.array(sums[j][at])})

    counts = [np.zeros(1 << depth, np.int64) for _ in range(tables)]
    if n <= cap:
        for c in counts:
            c[0] = n
    else:
        got = vectors.select("id", "vector").mapInArrow(histogram, "t int, p long, n long").groupBy("t", "p").agg(F.sum("n").alias("n")).toArrow()
        t_, p_, n_ = (got.column(c).to_numpy().astype(np.int64) for c in ("t", "p", "n"))
        for j in range(tables):
            counts[j][p_[t_ == j]] = n_[t_ == j]
    index.fit(counts)
    index.n = n
    refine(index, vectors, dim, sample)
    index.number()
    return index


def refine(index: Index, vectors: DataFrame, dim: int, sample: int) -> None:
    """Split the buckets above ``2 * cap`` rows; those that can't be split get ``pieces``."""
    tables, bits, cap = index.tables, index.bits, index.cap
    while large := [int(p) for p in np.flatnonzero(index.size > 2 * cap) if p not in index.below and p not in index.pieces]:
        share = {p: min(1.0, sample / int(index.size[p])) * (1 << 31) for p in large}
        depths = {p: min(MAX_DEPTH, tables * bits, max(4, int(np.ceil(np.log2(index.size[p] / cap))) + 5)) for p in large}

        def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    ids, x = matrix(b, dim)
                    parts, h = index.parts(x), mixed(ids, 1)
                    for p in share:
                        rows = np.flatnonzero((parts[:, index.table[p]] == p) & (h < share[p]))
                        if len(rows):
                            yield by_key(np.full(len(rows), p), x[rows], "part")

        def codes(group: pa.Table) -> pa.Table:
            part = group.column("part")[0].as_py()
            x = np.frombuffer(b"".join(sorted(group.column("rows").to_pylist())), np.float32).reshape(-1, dim)
            w, t = learn(x, tables, bits)
            order = (index.table[part] * bits + np.arange(depths[part])) % w.shape[1]
            w, t = w[:, order], t[order]
            t = t + np.float32(1e-5) * np.abs(x @ w).max(0, initial=0)  # copies at the median stay on one side, however sums are rounded
            return pa.table({"part": pa.array([part], pa.int64()), "w": pa.array([w.astype(np.float32).tobytes()], pa.binary()), "t": pa.array([t.astype(np.float32).tobytes()], pa.binary())})

        got = vectors.select("id", "vector").mapInArrow(some, "part long, rows binary").groupBy("part").applyInArrow(codes, "part long, w binary, t binary").toArrow().to_pylist()
        learned = {g["part"]: (np.frombuffer(g["w"], np.float32).reshape(dim, -1), np.frombuffer(g["t"], np.float32)) for g in got}

        def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = {p: np.zeros(1 << depths[p], np.int64) for p in learned}
            for b in batches:
                if b.num_rows:
                    x = matrix(b, dim)[1]
                    parts = index.parts(x)
                    for p, (w, t) in learned.items():
                        sums[p] += np.bincount(side_numbers(x[parts[:, index.table[p]] == p], w, t), minlength=1 << depths[p])
            for p, c in sums.items():
                at = np.flatnonzero(c)
                yield pa.record_batch({"part": pa.array(np.full(len(at), p, np.int64)), "p": pa.array(at.astype(np.int64)), "n": pa.array(c[at])})

        rows = vectors.select("id", "vector").mapInArrow(histogram, "part long, p long, n long").groupBy("part", "p").agg(F.sum("n").alias("n")).toArrow()
        part_, p_, n_ = (rows.column(c).to_numpy().astype(np.int64) for c in ("part", "p", "n"))
        for p in large:
            counts = np.zeros(1 << depths[p], np.int64)
            counts[p_[part_ == p]] = n_[part_ == p]
            if p not in learned or not index.split(p, *learned[p], counts):
                index.pieces[p] = -(-int(index.size[p]) // cap)


# ---------------------------------------------------------------- packed rows
def entry_type(dim: int, tables: int, exact: bool) -> np.dtype:
    return np.dtype([("id", "<i8"), ("parts", "<i4", (tables,)), *([("v", "<f4", (dim,))] if exact else [("scale", "<f4"), ("v", "<i2", (dim,))])])


def pack(x: np.ndarray, ids: np.ndarray, parts: np.ndarray, kind: np.dtype) -> np.ndarray:
    out = np.empty(len(x), kind)
    out["id"], out["parts"] = ids, parts
    if "scale" in kind.names:
        scale = np.abs(x).max(1, initial=0) / 32767
        scale[scale == 0] = 1
        out["scale"], out["v"] = scale, np.rint(x / scale[:, None])
    else:
        out["v"] = x
    return out


def unpack(e: np.ndarray) -> np.ndarray:
    v = e["v"].astype(np.float32)
    return v * e["scale"][:, None] if "scale" in e.dtype.names else v


def by_key(keys: np.ndarray, rows: np.ndarray, name: str) -> pa.RecordBatch:
    """One row for each key with the bytes of its rows."""
    order = np.argsort(keys, kind="stable")
    k, r = keys[order], rows[order]
    cut = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])[: len(k)])
    ends = np.append(cut[1:], len(k))[: len(cut)]
    return pa.record_batch({name: pa.array(k[cut].astype(np.int64)), "rows": pa.array([r[a:b].tobytes() for a, b in zip(cut, ends, strict=True)], pa.binary())})


def nearest(x: np.ndarray, ids: np.ndarray, k: int, exact: bool) -> tuple[np.ndarray, np.ndarray]:
    """(positions, distances) of each row's k nearest other rows; (n, min(k, n - 1)).

    With ``exact`` a few more are taken from the matrix product, measured by differences in doubles, and ties go to the smaller position.
    """
    n = len(x)
    least, k = min(k, n - 1), min(k + (EXTRA if exact else 0), n - 1)
    if k <= 0:
        return np.zeros((n, 0), np.int64), np.zeros((n, 0), np.float32)
    x = x - x.mean(0)
    square = (x * x).sum(1)
    pos, dist = np.empty((n, least), np.int64), np.empty((n, least), np.float32)
    whole = x.astype(np.float64) if exact else x
    many = -(-n // GROUP) > 4 * k
    size = GROUP if many else max(1, math.isqrt(n // k))
    groups, grouped = -(-n // size), size >= LEAST_GROUP
    padded = np.zeros((groups * size if grouped else n, x.shape[1]), np.float32)
    padded[:n] = -2 * x
    half = np.full(len(padded), np.inf, np.float32)
    half[:n] = square
    step = max(1, min(512, (1 << 22) // len(padded)))
    for a in range(0, n, step):
        q = x[a : a + step]
        d = q @ padded.T
        d += half
        rows = np.arange(len(q))
        d[rows, a + rows] = np.inf
        if grouped:
            # the k smallest lie in the k groups with the smallest minima; small groups have every groups-th column, which is faster for them
            low = d.reshape(len(q), groups, size).min(2) if many else d.reshape(len(q), size, groups).min(1)
            best = np.argpartition(low, k - 1, axis=1)[:, :k, None]
            cand = (best * size + np.arange(size) if many else best + groups * np.arange(size)).reshape(len(q), -1)
            sub = np.take_along_axis(d, cand, 1)
            p = np.argpartition(sub, k - 1, axis=1)[:, :k]
            p = np.take_along_axis(cand, p, 1)
        else:
            p = np.argpartition(d, k - 1, axis=1)[:, :k]
        if exact:
            p = np.sort(p, axis=1)
            diff = whole[p] - whole[a : a + step, None, :]
            s = np.einsum("ijk,ijk->ij", diff, diff)
            order = np.argsort(s, axis=1, kind="stable")[:, :least]
            p, s = np.take_along_axis(p, order, 1), np.take_along_axis(s, order, 1)
        else:
            s = np.maximum(np.take_along_axis(d, p, 1) + square[a : a + step, None], 0)
        pos[a : a + step], dist[a : a + step] = p, np.sqrt(s)
    return pos, dist


TRIPLE = np.dtype([("id", "<i8"), ("other", "<i8"), ("d", "<f4")])


def knn(vectors: DataFrame, k: int, dim: int = DIM, tables: int = TABLES, bits: int = BITS, cap: int = CAP, sample: int = SAMPLE, exact: bool = False) -> DataFrame:
    """``(id, neighbors array<long>, distances array<float>)``: the k nearest other ids of every id of ``(id, vector)``.

    ``vectors`` has one usable row for each id (see ``vectors.newest``). It is read three times: to learn, to count, to index.
    """
    index = fit(vectors, dim, tables, bits, cap, sample)
    kind = entry_type(dim, tables, exact)
    shards = max(1, int(np.ceil(index.n / 20_000)))

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            rows = np.concatenate(held)
            held.clear()
            for j in range(tables):
                for at, keys in index.tasks(rows["parts"][:, j].astype(np.int64), rows["id"]):
                    if len(at):
                        yield by_key(keys, rows[at], "part")

        n = 0
        for b in batches:
            if b.num_rows:
                ids, x = matrix(b, dim)
                held.append(pack(x, ids, index.parts(x), kind))
                n += len(ids)
                if n >= FLUSH:
                    yield from flush()
                    n = 0
        if held:
            yield from flush()

    def search(group: pa.Table) -> pa.Table:
        part = group.column("part")[0].as_py() >> 32
        e = np.frombuffer(b"".join(group.column("rows").to_pylist()), kind)
        e = e[np.argsort(e["id"], kind="stable")]
        j = int(index.table[part])
        pos, dist = nearest(unpack(e), e["id"], k, exact)
        new = np.ones(pos.shape, bool)
        for i in range(j):
            new &= e["parts"][:, i][pos] != e["parts"][:, i][:, None]
        out = np.empty(int(new.sum()), TRIPLE)
        out["id"], out["other"], out["d"] = np.broadcast_to(e["id"][:, None], pos.shape)[new], e["id"][pos][new], dist[new]
        if j == 0:  # each id at least once, also one without neighbours
            alone = np.empty(len(e), TRIPLE)
            alone["id"], alone["other"], alone["d"] = e["id"], -1, np.inf
            out = np.concatenate([out, alone[~new.any(1)]])
        return pa.Table.from_batches([by_key(np.abs(out["id"]) % shards, out, "shard")])

    def merge(group: pa.Table) -> pa.Table:
        t = np.frombuffer(b"".join(group.column("rows").to_pylist()), TRIPLE)
        if index.pieces:  # two of one piece meet once for every other piece
            t = t[np.lexsort((t["d"], t["other"], t["id"]))]
            t = t[np.concatenate([[True], (t["id"][1:] != t["id"][:-1]) | (t["other"][1:] != t["other"][:-1])])]
        t = t[np.lexsort((t["other"], t["d"], t["id"]))]
        start = np.flatnonzero(np.concatenate([[True], t["id"][1:] != t["id"][:-1]]))
        rank = np.arange(len(t)) - np.repeat(start, np.diff(np.append(start, len(t))))
        ids = t["id"][start]
        t = t[(rank < k) & (t["d"] != np.inf)]
        n = np.searchsorted(t["id"], ids, "right") - np.searchsorted(t["id"], ids, "left")
        ends = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
        return pa.table({"id": pa.array(ids), "neighbors": pa.ListArray.from_arrays(ends, pa.array(t["other"])), "distances": pa.ListArray.from_arrays(ends, pa.array(t["d"]))})

    entered = vectors.select("id", "vector").mapInArrow(enter, "part long, rows binary")
    found_ = entered.groupBy("part").applyInArrow(search, "shard long, rows binary")
    return found_.groupBy("shard").applyInArrow(merge, "id long, neighbors array<long>, distances array<float>")


def nearest_ids(table: DataFrame, k: int = 10, dim: int = DIM, cap: int = WIDE, **how: object) -> DataFrame:
    """``(id, rank, other_id, distance)`` over the usable ids of a dirty table."""
    lists = knn(newest(table, dim), k, dim, cap=cap, exact=True, **how)
    out = lists.select("id", F.posexplode(F.arrays_zip("neighbors", "distances")).alias("p", "x"))
    return out.select("id", (F.col("p") + 1).cast("bigint").alias("rank"), F.col("x.neighbors").alias("other_id"), F.col("x.distances").cast("double").alias("distance"))


def tight_rings(table: DataFrame, dim: int = DIM, ratio: float = 0.6, **how: object) -> DataFrame:
    """Pairs of an id in a tight ring and one of its five nearest, each once (p1_found)."""
    lists = knn(newest(table, dim), 6, dim, **how)
    d = F.col("distances")
    rings = lists.where((F.size("neighbors") == 6) & (d[4] <= ratio * d[5]) & (d[5] > 0))
    pairs = rings.select("id", F.explode(F.slice("neighbors", 1, 5)).alias("other"))
    return pairs.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()
