from collections import defaultdict

import numpy as np
import pytest

from sparkvec.llm import packing as P
from sparkvec.llm import tokens

DOCS = "doc_id bigint, text string, lang string, container string, bin string"
SIZES = "container string, capacity_tokens int, doc_id string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "en", "c", "b") for r in rows], DOCS)


def sizes(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], SIZES)


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(0)
    out = [(i, "word " * int(n)) for i, n in enumerate(r.integers(1, 120, 400))]
    return out + [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "long " * 1000), (None, "no id"), out[5], (7, "other text"), (1004, "a" * 50_000)]


def test_everything_is_placed_once_and_fits(spark, rows):
    got = P.pack(docs(spark, rows), sizes(spark, [("s", 64), ("m", 256), ("same", 256), ("none", None), ("zero", 0)])).collect()
    want = {(i, t) for i, t in rows if t and t.strip()}
    need = defaultdict(int)
    for i, t in want:
        need[i] += tokens.count(t, tokens.TOKENIZER)
    for name, cap in (("s", 64), ("m", 256), ("same", 256)):
        own = [r for r in got if r["container"] == name]
        bins, total, parts = defaultdict(int), defaultdict(int), defaultdict(list)
        for r in own:
            bins[r["bin"]] += r["n_tokens"]
            total[r["doc_id"]] += r["n_tokens"]
            parts[r["doc_id"], r["text_hash"]].append((r["part"], r["start_token"], r["n_tokens"]))
        assert total == need
        assert max(bins.values()) <= cap
        for p in parts.values():
            p.sort()
            size = sum(x[2] for x in p)
            assert len(p) == (1 if size <= cap else -(-size // cap)) and [x[1] for x in p] == [i * cap for i in range(len(p))]
        assert sum(bins.values()) / (len(bins) * cap) > 0.9
    assert {r["container"] for r in got} == {"s", "m", "same"}


def test_fill_report(spark, rows):
    s = sizes(spark, [("m", 256)])
    packed = P.pack(docs(spark, rows), s).cache()
    got = P.fill(packed, s).collect()
    assert sum(r["tokens"] for r in got) / sum(r["bins"] * r["capacity_tokens"] for r in got) > 0.9 and max(r["fullest"] for r in got) <= 256
    assert len({r["bin_class"] for r in got}) == len(got) > 3
    assert [tuple(r)[2:] for r in P.checked(docs(spark, rows), packed, s).collect()] == [(0, 0, 0, 0)]
    lost = packed.where("doc_id <> 5")
    assert P.checked(docs(spark, rows), lost, s).collect()[0]["lost_tokens"] > 0


def test_a_bin_has_as_many_as_its_class_before_its_rest():
    r = np.random.default_rng(1)
    for cap in (1, 7, 100, 513):
        size = np.minimum(np.maximum(1, r.lognormal(3, 1, 3000).astype(int)), cap)
        bins, kind = P.fill_bins(size, cap)
        load = np.bincount(bins, size)
        assert load.max() <= cap and len(load) == len(kind) and load.min() > 0
        own = np.bincount(bins, (cap // size) == kind[bins])  # items of the bin's class
        short = own < kind
        assert len(set(kind[short])) == short.sum()  # at most one of each class
        assert (own <= kind).all() and load.sum() / (len(load) * cap) > 0.97
    assert [len(x) for x in P.fill_bins(np.zeros(0, int), 5)] == [0, 0]


def test_shards(spark, rows):
    s = sizes(spark, [("m", 256)])
    packed = P.pack(docs(spark, rows), s, shard=50).cache()
    assert packed.select(P.F.shiftright("bin", 32)).distinct().count() > 5
    assert [tuple(r)[2:] for r in P.checked(docs(spark, rows), packed, s).collect()] == [(0, 0, 0, 0)]


def test_empty(spark):
    s = sizes(spark, [("m", 256)])
    assert P.pack(docs(spark, []), s).count() == 0
    assert P.pack(docs(spark, [(1, "x")]), sizes(spark, [])).count() == 0
