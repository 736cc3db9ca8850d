import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from martflow.llm import jaccard_join as J
from martflow.llm import shared
from martflow.llm.components import components
from martflow.llm.shared import text_blocks

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def brute_set(text, n):
    ws = WORD.findall(lower(text or ""))
    return {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)} if len(ws) >= n else {tuple(ws)} if ws else set()


def brute(rows, n, percent):
    """[(id, size, component)] of [(id, text)], by all pairs that share an element."""
    sets = [brute_set(t, n) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    holders = {}
    for i, s in enumerate(sets):
        for e in s:
            holders.setdefault(e, []).append(i)
    for a, b in {p for h in holders.values() for p in combinations(h, 2)}:
        common = len(sets[a] & sets[b])
        if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
            up[root(a)] = root(b)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[root(i)] = min(least.get(root(i), k), k)
    return sorted(((k, len(s), least.get(root(i))) for i, ((k, _), s) in enumerate(zip(rows, sets))), key=str)


def corpus(seed, docs=150, vocabulary=400):
    rng = random.Random(seed)
    shared = [f"s{i}" for i in range(30)]
    out = []
    for i in range(docs):
        if out and rng.random() < 0.55:
            ws = list(rng.choice(out))
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                j = rng.randrange(len(ws) + 1)
                ws[j : j + rng.choice([0, 1])] = [f"w{rng.randrange(vocabulary)}"] * rng.choice([0, 1])
        else:
            ws = [f"w{rng.randrange(vocabulary)}" for _ in range(rng.choice([1, 2, 3, 5, 8, 20, 60, 200]))]
            if rng.random() < 0.4:
                ws[len(ws) // 2 : 0] = shared
        out.append(ws)
    return [(i * 3 + 1, " ".join(w.upper() if i % 7 == 0 else w for w in ws)) for i, ws in enumerate(out)]


@pytest.mark.parametrize("percent", [80, 85, 90])
def test_signatures_lose_no_link(percent):
    """Every two different sets that link share a signature, at all sizes and at the very threshold."""
    rng = np.random.default_rng(percent)
    for size in [*range(5, 60), 100, 101, 333, 1000, 4001]:
        for _ in range(3):
            common = int(rng.integers(-(-size * percent // 100), size + 1))
            extra = 0
            while 100 * common >= percent * (size + extra + 1):
                extra += 1
            e = rng.integers(0, 2**63, size + extra, dtype=np.uint64)
            a, b = np.sort(e[:size]), np.sort(np.concatenate([e[:common], e[size:]]))
            assert 100 * common >= percent * (len(a) + len(b) - common)
            if common == size and not extra:
                continue
            s, at = J.signatures(np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)]), 2, percent)
            assert set(s[at == 0].tolist()) & set(s[at == 1].tolist()), (size, common, extra)


def test_sets_match_brute_force():
    texts = [None, "", " \n", "a", "A a", "a b c", "A b C d", "a b c d a b c d a", "É é B", "x " * 4000]
    for i, j, raw, off in text_blocks(pa.array(texts)):
        g, row = J.shingles(raw, off, 4)
        assert np.bincount(row, minlength=j - i).tolist() == [len(brute_set(t, 4)) for t in texts[i:j]]


@pytest.mark.parametrize(("seed", "n", "percent"), [(1, 4, 85), (2, 5, 80), (3, 2, 80)])
def test_components_match_brute_force(spark, seed, n, percent):
    rows = [
        *corpus(seed), (9001, None), (9002, ""), (9003, " "), (4, "the text of a repeated id"), (None, "w1 w2 w3 w4 w5 w6 w7"),
        (None, "no id here at all"), (9004, "w1 w2 w3 w4 w5 w6 w7")
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, `class` string")
    got = sorted(map(tuple, J.jaccard_components(df, n, percent).collect()), key=str)
    assert got == brute(rows, n, percent)


def test_null_ids_link(spark):
    """Texts without ids link with near copies, with or without ids, and bridge documents that have ids."""
    ws = [[f"{g}{i}" for i in range(60)] for g in "abcd"]
    rows = [
        (1, " ".join(ws[0])), (None, " ".join([*ws[0], "z"])), (None, " ".join(ws[1])), (None, " ".join([*ws[1], "z"])),
        (None, " ".join(ws[1])), (None, " ".join(ws[2])), (8, "")
    ]
    rows += [
        (10, " ".join(ws[3])), (None, " ".join([*ws[3][4:], "p0", "p1", "p2", "p3"])),
        (12, " ".join([*ws[3][8:], "p0", "p1", "p2", "p3", "p4", "p5", "p6", "p7"]))
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, J.jaccard_components(df, 1, 85).collect()), key=str)
    assert got == brute(rows, 1, 85)
    assert [r[2] for r in got if r[0] in (1, 10, 12)] == [1, 10, 10] and sum(r[0] is None and r[2] == 1 for r in got) == 1


def test_chain_and_hub(spark):
    base = [f"w{i}" for i in range(100)]
    rows = [(1000 - i, " ".join(base[i:] + [f"x{j}" for j in range(i)])) for i in range(30)]  # a chain: only near ones link
    rows += [(2000 + i, " ".join([*base, f"y{i}"])) for i in range(300)]  # a hub
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, J.jaccard_components(df, 1, 85).collect()), key=str) == brute(rows, 1, 85)


def test_a_third_of_all_rows_in_one_class(spark, monkeypatch):
    """Hot classes, leaders and roots are dealt apart; the result is the same."""
    monkeypatch.setattr(shared, "HOT_ROWS", 5)
    monkeypatch.setattr(shared, "HOT", 16)
    monkeypatch.setattr(J, "FOLLOWERS", 4)
    base = [f"w{i}" for i in range(60)]
    rows = [*corpus(7, 60), *[(3000 + i, " ".join(base)) for i in range(60)], *[(4000 + i, " ".join([*base, f"y{i}"])) for i in range(40)]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, J.jaccard_components(df, 2, 85).collect()), key=str) == brute(rows, 2, 85)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert J.jaccard_components(df, 4, 85).count() == 0


def test_contraction(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1090)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want, left = {}, set(near)
    while left:
        group, todo = set(), [min(left)]
        while todo:
            x = todo.pop()
            if x not in group:
                group.add(x)
                todo += near[x]
        want |= dict.fromkeys(group, min(group))
        left -= group
    assert got == want


def test_query(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    assert sorted(map(tuple, J.op4_jaccard_join(spark, d).collect()), key=str) == brute(rows, 4, 85)


def test_stage(spark):
    a = " ".join(f"w{i}" for i in range(50))
    df = spark.createDataFrame(
        [(5, a, None), (3, a + " z", None), (3, a + " z", None), (9, "other words", None), (None, a, None), (7, None, None)],
        "doc_id long, text string, lang string"
    )
    assert sorted(r.doc_id for r in J.unique_stage(spark, df, "").collect()) == [3, 7, 9]  # the row without an id is a copy too


def test_stage_keeps_one_row_a_group(spark):
    a, b, c = (" ".join(f"{g}{i}" for i in range(50)) for g in "abc")
    rows = [(1, a), (2, a + " z"), (2, b), (2, b), (4, b), (None, c), (None, c), (None, c + " z"), (None, "other words without id"), (9, None)]
    got = sorted(((r.doc_id, r.text) for r in J.unique_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()), key=str)
    assert [g for g in got if g[0] is not None] == [(1, a), (2, b), (9, None)]  # b stays, though 2 holds a near copy of a too
    alone = [t for k, t in got if k is None]
    assert len(alone) == 2 and "other words without id" in alone
