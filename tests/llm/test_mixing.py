from collections import Counter, defaultdict

import numpy as np
import pytest

from sparkvec.llm import mixing as M

DOCS = "doc_id bigint, text string, source string, shard string, slot string"
TARGETS = "source string, target_share double, max_repeats int, block string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], DOCS)


def targets(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], TARGETS)


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(0)
    out = [(i, "tok " * int(r.integers(5, 60)), ["big", "Big", "mid_one", "Mid-One", "small"][min(4, int(r.exponential(1.2)))]) for i in range(600)]
    return out + [(900, None, "big"), (901, " ", "big"), (902, "text", None), (903, "text", "unwanted"), out[0], (904, "w " * 3000, "mid one")]


T = [("big", 0.4, 1), ("mid_one", 0.3, 2), ("small", 0.25, 4), ("absent", 0.05, 2), ("null", None, None)]


def test_shares_repeats_and_blocks(spark, rows):
    got = M.mix(docs(spark, rows), targets(spark, T), block=32, shard_blocks=16).collect()
    by = Counter()
    slots = defaultdict(list)
    for r in got:
        by[r["source"]] += r["n_tokens"]
        slots[r["shard"], r["slot"]].append(r)
    total = sum(by.values())
    for s, share, _ in T[:3]:
        assert abs(by[s] / total - share / 0.95) < 0.02
    uses = Counter()
    for own in slots.values():
        assert len({(r["source"], r["block"], r["repeat"]) for r in own}) == 1
        n = sum(r["n_tokens"] for r in own)
        assert n <= 32
        uses[own[0]["source"], own[0]["block"]] += 1
    for s, _, most in T[:3]:
        own = [n for (src, _), n in uses.items() if src == s]
        assert max(own) <= most and max(own) - min(own) <= 1
    sizes = Counter(shard for shard, _ in slots)
    assert all(n == 16 for shard, n in sizes.items() if shard < max(sizes))


def test_blocks_tile_the_documents(spark, rows):
    p = M.mix(docs(spark, rows), targets(spark, [("small", 1.0, 1)]), block=16).collect()
    spans = defaultdict(list)
    for r in p:
        spans[r["doc_id"]].append((r["start_token"], r["n_tokens"]))
    for s in spans.values():
        s.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(s, s[1:])) and s[0][0] == 0


def test_total_beyond_what_there_is(spark, rows):
    got = M.mix(docs(spark, rows), targets(spark, T), block=32, total_blocks=10**6)
    r = {x["source"]: x for x in M.shares(got, targets(spark, T)).collect()}
    assert r["big"]["repeats"] == 1 and r["small"]["repeats"] == 4 and r["absent"]["selected_tokens"] == 0


def test_quotas():
    share, most = np.array([0.5, 0.3, 0.2]), np.array([100, 100, 10])
    assert M.quotas(share, most, None).tolist() == [25, 15, 10]
    assert M.quotas(share, most, 100).tolist() == [56, 34, 10]
    assert M.quotas(share, most, 10**6).tolist() == most.tolist()
    assert M.quotas(np.zeros(2), np.ones(2, int), None).tolist() == [0, 0]


def test_permutations():
    for n in (1, 2, 7, 1000):
        for turn in range(3):
            a, b = M.permutation(n, turn, 5)
            assert sorted((a * i + b) % n for i in range(n)) == list(range(n))


def test_draws_are_multinomial():
    p = np.array([0.5, 0.3, 0.2])
    n = np.concatenate([M.drawn(r, 2000, 2000 * 64 - 10, 64, p, 3) for r in range(125)])
    assert n.shape == (2000, 3) and (n.sum(1)[:-1] == 64).all() and n[-1].sum() == 54
    assert (M.drawn(7, 2000, 2000 * 64 - 10, 64, p, 3) == n[112:128]).all()  # a lost task draws the same
    assert abs(n[:, 0].var() - 64 * 0.25) < 2  # not narrowed by the totals


def test_slots_meet_the_quotas():
    got, quota = np.array([510, 290, 0, 200]), np.array([500, 300, 5, 195])
    where = M.Slots(got, quota, 1)
    pairs = []
    for s, n in enumerate(got):
        pairs += list(zip(*[x.tolist() for x in where.place(s, np.arange(n))]))
    assert len(set(pairs)) == 1000
    assert all(sorted(j for s, j in pairs if s == t) == list(range(q)) for t, q in enumerate(quota))


def test_checked(spark, rows):
    big = rows + [(i, "more words " * 20, ["big", "mid_one", "small"][i % 3]) for i in range(10_000, 10_600)]
    got = M.checked(M.mix(docs(spark, big), targets(spark, T[:4]), block=8, shard_blocks=16), docs(spark, big), targets(spark, T[:4])).collect()
    assert {tuple(r) for r in got} == {("big", True, True, True), ("mid_one", True, True, True), ("small", True, True, True), ("absent", False, True, True)}


def test_empty(spark):
    assert M.mix(docs(spark, []), targets(spark, T)).count() == 0
    assert M.mix(docs(spark, [(1, "a b", "big")]), targets(spark, [])).count() == 0
    assert M.shares(M.mix(docs(spark, []), targets(spark, T)), targets(spark, T)).count() == 5
