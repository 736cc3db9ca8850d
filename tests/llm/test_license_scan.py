import random
from collections import defaultdict

import duckdb
import pytest

from martflow.llm import license_scan as L

SF = "/root/testdata/sf0.01"


def brute(rows):
    """{(key, unit, place, license): dice} without any bound."""
    sets = {n: L.bigrams(t) for n, t in L.TEMPLATES.items()}
    out = defaultdict(list)
    for key, text in rows:
        if text is None:
            continue
        units = [("line", i + 1, x) for i, x in enumerate(text.split("\n"))] + ([("text", 0, text)] if "\n" in text else [])
        for unit, place, body in units:
            g = L.bigrams(body)
            for n, t in sets.items():
                if g and (d := 2 * len(g & t) / (len(g) + len(t))) >= L.LEAST - 1e-9:
                    out[key, unit, place, n].append(round(d, 9))
    return {k: sorted(v) for k, v in out.items()}


def got(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r.doc_id, r.unit, r.place, r.license].append(round(r.dice, 9))
    return {k: sorted(v) for k, v in out.items()}


def test_anchors_are_necessary():
    rng = random.Random(1)
    sets = [L.bigrams(t) for t in L.TEMPLATES.values()]
    words, grams = L.anchors(sets, L.LEAST)
    assert 0 < len(words) < 25
    held = lambda x: x in grams or any(w in x for w in words)
    for g in sets:
        without = {x for x in g if not held(x)}
        assert all(2 * len(without) / (len(without) + n + len(g)) < L.LEAST for n in range(5))
        for _ in range(20):
            some = set(rng.sample(sorted(g), rng.randint(1, len(g))))
            if 2 * len(some) / (len(some) + len(g)) >= L.LEAST:
                assert any(map(held, some))


def test_matches_brute_force(spark):
    rng = random.Random(2)
    rows = [
        (1, None), (2, ""), (3, "x"), (4, "RELEASED under the MIT license!"),
        (5, "text\nLicensed under the Apache License, Version 2.0.\nmore"),
        (5, "text\nLicensed under the Apache License, Version 2.0.\nmore"), (None, "Released under the MIT License."),
        (6, "É Licensed under CC BY NC 4 0"), (7, "Licensed under CC-BY-NC 4.0. " * 3)
    ]
    for i, t in enumerate(L.TEMPLATES.values()):
        ws = t.split()
        rows.append((100 + i, "\n".join(" ".join(ws[j : j + 12]) for j in range(0, len(ws), 12))))
        for k in range(6):
            own = [w for w in ws if rng.random() > 0.03 * k] + ["extra"] * rng.randint(0, k)
            rows.append((1000 + 10 * i + k, " ".join(own)))
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, license string")
    assert got(L.license_matches(df)) == brute(rows)
    assert L.license_matches(df.limit(0)).count() == 0


def brute_runs(rows):
    """{(key, "run", place, license): dice}: the best runs of words that share none with each other, nor with a matching line."""
    out = defaultdict(list)
    words = lambda t: L.re.sub(r"[^a-z0-9]+", " ", lower(t)).split()
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    dice = lambda g, t: 2 * len(g & t) / (len(g) + len(t))
    for key, text in rows:
        ws = words(text or "")
        gs = [f"{a} {b}" for a, b in zip(ws, ws[1:])]
        for name, template in L.TEMPLATES.items():
            t, taken, at = L.bigrams(template), [], 0
            if "\n" in (text or "") and dice(set(gs), t) >= L.LEAST - 1e-9:
                continue
            for line in (text or "").split("\n"):
                n = len(words(line))
                if dice(L.bigrams(line), t) >= L.LEAST - 1e-9:
                    taken.append((at, at + n - 1))
                at += n
            most, found = int(len(t) * (2 - L.LEAST) / L.LEAST + 1e-9), []
            for i in range(len(gs)):
                for j in range(i, min(len(gs), i + most)):
                    if (d := dice(set(gs[i : j + 1]), t)) >= L.LEAST - 1e-9 and gs[i] in t and gs[j] in t:
                        found.append((-d, i, j + 1))
            for d, i, j in sorted(found):
                if all(i > b or j < a for a, b in taken):
                    taken.append((i, j))
                    out[key, "run", i + 1, name].append(round(-d, 9))
    return {k: sorted(v) for k, v in out.items()}


def test_runs_match_brute_force(spark):
    rng = random.Random(3)
    prose = lambda n: [f"p{rng.randrange(50)}" for _ in range(n)]
    rows = [
        (1, None), (2, ""), (3, "x"), (4, "This is a library. Released under the MIT License."),
        (5, "By A. Author. Licensed under the Apache License, Version 2.0. All rights reserved."),
        (6, "Released under the MIT License.\nmore words here\nit is released under the MIT\nlicense. And on"),
        (None, "a b. Released under the MIT License. c d")
    ]
    rows.append((7, "x y " + "Licensed under CC BY-NC 4.0. a b c d e f g h " * 3))
    for i, t in enumerate(L.TEMPLATES.values()):
        ws = [w for w in t.split() if rng.random() > 0.04]
        for k, body in enumerate((t.split(), ws)):
            all_words = prose(60) + body + prose(60)
            rows.append((100 + 10 * i + k, "\n".join(" ".join(all_words[j : j + 11]) for j in range(0, len(all_words), 11))))
        rows.append((102 + 10 * i, "\n".join([" ".join(prose(9)), t, " ".join(prose(9))])))
    got_runs = got(L.license_runs(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got_runs == brute_runs(rows)
    found = {(k[0], k[3]) for k in got_runs}
    assert {(4, "mit-notice"), (5, "apache-2.0-notice"), (None, "mit-notice")} <= found
    assert all((100 + 10 * i, n) in found for i, n in enumerate(L.TEMPLATES))


def test_query_finds_runs(spark, tmp_path):
    ws = [f"a{i}" for i in range(150)] + L.TEMPLATES["mit"].split() + [f"b{i}" for i in range(150)]
    text = "\n".join(" ".join(ws[j : j + 11]) for j in range(0, len(ws), 11))
    spark.createDataFrame(
        [(1, text), (2, "This is a library. Released under the MIT License.")], "doc_id long, text string"
    ).write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, L.op5_license_scan(spark, str(tmp_path)).collect())) == [(1, "mit", 1, 1.0), (2, "mit-notice", 1, 1.0)]


def test_query_matches_oracle_and_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert got(L.license_matches(spark.read.parquet(f"{SF}/documents.parquet"))) == brute(rows)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = sorted(con.sql(L.oracle()).fetchall())
    mine = sorted(map(tuple, L.op5_license_scan(spark, SF).collect()))
    assert [w[:3] for w in want] == [m[:3] for m in mine] and [w[3] for w in want] == pytest.approx([m[3] for m in mine])
    assert len(mine) > 5


def test_plan_is_native(spark):
    plan = L.op5_license_scan(spark, SF)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
