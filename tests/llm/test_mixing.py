import math
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from martflow.llm import mixing as M

SF = "/root/testdata/sf0.01"


def test_targets():
    assert M.targets([100, 100, 100], [3, 1, 2]) == [200, 250 / 3, 500 / 3]
    assert M.targets([100, 1000], [3, 1]) == [200, 1450]
    assert M.targets([0, 10], [3, 1]) == [0, 15]
    assert M.targets([], []) == []
    got = M.targets([5, 7, 1000, 3, 800], [3, 1, 2, 3, 1])
    assert abs(sum(got) - 1.5 * 1815) < 1e-6 and all(t <= 2 * n for t, n in zip(got, [5, 7, 1000, 3, 800]))


@pytest.mark.parametrize("shards", [1, 2, 5, 64])
def test_tree_is_exact_and_even(shards):
    q = np.array([0, 1, 1000, 37, 5000])
    t = M.tree(q, shards, 3)
    assert t.sum(1).tolist() == q.tolist()
    assert t.min() >= 0 and np.ptp(t.sum(0)) <= 1
    assert (M.tree(q, shards, 3) == t).all()
    if shards == 64:  # a random, not a proportional split
        assert 0 < t[4].std() < 12


def test_large_counts_split_whole():
    counts = np.array([3_000_000_000, 1, 2_000_000_000], np.int64)
    s = M.split(counts, 2_500_000_001, np.random.default_rng(1))
    assert s.sum() == 2_500_000_001 and (s >= 0).all() and (s <= counts).all() and abs(s[0] - 1.5e9) < 2e5


def test_draws_of_large_urns_are_exact():
    """Above 10^9 the sampler is that of the same distribution: its probabilities against exact fractions, its draws against them."""
    for good, bad, take in ((9, 5, 7), (40, 1000, 30), (300, 200, 450)):
        p, q = take / (good + bad), (good + bad - take) / (good + bad)
        for k in range(max(0, take - bad), min(good, take) + 1):
            exact = math.comb(good, k) * math.comb(bad, take - k) / math.comb(good + bad, take)
            got = math.exp(M._log_binomial(k, good, p, q) + M._log_binomial(take - k, bad, p, q) - M._log_binomial(take, good + bad, p, q))
            assert abs(got - exact) < 1e-11 * exact
    rng = np.random.default_rng(3)
    good, bad, take = 6, 2 * 10**9, 7 * 10**8  # nearly binomial: a third of six
    draws = Counter(M.hypergeometric(good, bad, take, rng) for _ in range(4000))
    for k in range(7):
        want = 4000 * math.comb(6, k) * 0.35**k * 0.65 ** (6 - k)
        assert abs(draws[k] - want) < 5 * want**0.5 + 5
    x = np.array([M.hypergeometric(10**12, 3 * 10**12, 10**9, rng) for _ in range(2000)])
    spread = (10**9 * 0.25 * 0.75 * (1 - 10**9 / (4 * 10**12))) ** 0.5
    assert abs(x.mean() - 2.5e8) < 5 * spread / 2000**0.5 and 0.93 < x.std() / spread < 1.07
    assert M.hypergeometric(10**10, 0, 5, rng) == 5 and M.hypergeometric(0, 10**10, 5, rng) == 0


def plain_targets(sizes, weights):
    """Targets by bisection: the level at which capped shares use up all there is to share."""
    whole, cap = Fraction(3, 2) * sum(sizes), [2 * n for n in sizes]
    if whole == 0:
        return [0.0] * len(sizes)
    lo, hi = Fraction(0), Fraction(2 * sum(sizes) + 1)
    for _ in range(200):
        level = (lo + hi) / 2
        lo, hi = (level, hi) if sum(min(level * w, c) for w, c in zip(weights, cap)) < whole else (lo, level)
    return [float(min(hi * w, c)) for w, c in zip(weights, cap)]


def check(rows, words):
    by, target, size = Counter(), {}, Counter()
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by[r["source"]] += r["taken"]
        size[r["source"]] += r["size"]
        target[r["source"]] = (r["target"], r["source_size"])
    order = sorted(size, key=lambda s: (s is None, s or ""))
    want = plain_targets([size[s] for s in order], [(3, 1, 2)[i % 3] for i in range(len(order))])
    for s, w in zip(order, want):
        assert target[s] == (pytest.approx(w), size[s])
        assert abs(by[s] - w) <= M.BLOCK


def test_query_sizes_and_targets(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = M.op10_mixing(spark, SF).collect()
    assert len(rows) == len(docs)
    assert all(r.size == len(re.findall(r"[^\x20\x09-\x0D]+", docs[r.doc_id].text or "")) for r in rows)
    check([r.asDict() | {"source": docs[r.doc_id].source} for r in rows], None)
    assert sorted(M.op10_mixing(spark, SF).collect()) == sorted(rows)


def test_draws_are_disjoint_and_mixture_agrees(spark):
    data = [
        (i, " ".join(f"d{i}w{j}" for j in range(n)), s, "x") for i,
        (n, s) in enumerate([(0, "a"), (1, "a"), (700, "a"), (64, "b"), (65, None), (3000, "b"), (10, "c"), (200, "c")])
    ]
    data += [
        (50, None, "a", None), (50, None, None, None), (51, "twice the same row", "b", "l"), (51, "twice the same row", "b", "l"),
        (None, "no id", "c", "")
    ]
    df = spark.createDataFrame(data, "doc_id long, text string, source string, size string")
    plan = M.mix_plan(df).collect()
    assert len(plan) == len(data)
    check([r.asDict() for r in plan], None)
    for r in plan:
        assert sum(d.words for d in r.draws) == r.taken
        for p in {d["pass"] for d in r.draws}:
            at = [w for d in r.draws if d["pass"] == p for w in range(d["first"], d["first"] + d["words"])]
            assert len(at) == len(set(at)) and (not at or max(at) < r.size)
    out = M.mixture(df).collect()
    taken, got = Counter(), Counter()
    for r in plan:
        taken[r.doc_id] += r.taken
    for r in out:
        assert set(r.text.split()) <= set(next(t for i, t, *_ in data if i == r.doc_id and t).split())
        got[r.doc_id] += len(r.text.split())
    assert +got == +taken
    assert M.mixture(df).columns == ["doc_id", "text", "source", "size", "mix_shard", "mix_place"]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert M.mix_plan(df).count() == 0
    assert M.mixture(df).count() == 0


def test_rows_that_differ_elsewhere_and_clashing_names(spark):
    """Rows alike in id, text and source keep their other columns; columns with names of the operator's own stay whole."""
    text = " ".join(f"w{i}" for i in range(100))
    data = [
        (1, text, "a", "one", 1, 2, "m", "s", "t"), (1, text, "a", "two", 3, 4, "m", "s", "t"), (1, text, "a", "two", 3, 4, "m", "s", "t"),
        (2, "other " * 50, "b", None, None, None, None, None, None)
    ]
    df = spark.createDataFrame(data, "doc_id long, text string, source string, extra string, draws int, k1 int, m2 string, m1 string, mix_shard string")
    out = M.mixture(df)
    assert out.columns == ["doc_id", "text", "source", "extra", "draws", "k1", "m2", "m1", "mix_shard", "mix_place"]
    plan = Counter()
    for r in M.mix_plan(df).collect():
        plan[r.doc_id] += len({d["pass"] for d in r.draws})
    rows = out.collect()
    assert Counter(r.doc_id for r in rows) == +plan
    assert {(r.extra, r.draws, r.k1, r.m2, r.m1) for r in rows} <= {("one", 1, 2, "m", "s"), ("two", 3, 4, "m", "s"), (None, None, None, None, None)}
    assert {r.extra for r in rows if r.doc_id == 1} == {"one", "two"}


def test_a_third_of_all_rows_alike(spark, monkeypatch):
    monkeypatch.setattr(M, "PER_BUCKET", 7)
    data = [
        (i, f"a{i} b c d e f g" * (i % 4), f"s{i % 3}") for i in range(120)
    ] + [(500, "the same row again " * 9, "s1")] * 90 + [(None, "no id " * 9, None)] * 30
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    rows = [r.asDict() for r in M.mix_plan(df).collect()]
    assert len(rows) == len(data)
    check(rows, None)
    key = lambda r: (str(r["doc_id"]), r["size"], r["taken"], str(r["draws"]))
    again = [r.asDict() for r in M.mix_plan(df.repartition(5)).collect()]
    assert sorted(map(key, rows)) == sorted(map(key, again))  # whichever of the rows alike took them
    got, taken = Counter(), Counter()
    for r in rows:
        taken[r["doc_id"]] += r["taken"]
    for r in M.mixture(df).collect():
        got[r.doc_id] += len(r.text.split())
    assert +got == +taken


def test_very_long_text(spark):
    df = spark.createDataFrame([(1, "word " * 300_000, "a"), (2, "few words", "b")], "doc_id long, text string, source string")
    check([r.asDict() for r in M.mix_plan(df).collect()], None)
