import zlib
from collections import Counter

import numpy as np

from martflow.llm import language_id as L
from martflow.llm.shared import threshold

SF = "/root/testdata/sf0.01"


def brute_grams(text):
    low = "".join(c if c.isalpha() else " " for c in text.lower())
    out = []
    for word in low.split():
        w = f" {word} "
        for n in L.N:
            out += [w[i : i + n] for i in range(len(w) - n + 1)]
    return [g for g in out if " " not in g[1:-1] and g.strip()]


def test_grams_count_matches_brute_force():
    texts = ["", "a", "ab cd, ef!", "Ünïcode straße 12x", "..", "x" * 50, "İstanbul"]
    h, row, lettered = L.grams(texts)
    assert np.bincount(row, minlength=len(texts)).tolist() == [len(brute_grams(t)) for t in texts]
    assert lettered.tolist() == [False, True, True, True, False, True, True]
    assert len(set(h.tolist())) == len({g for t in texts for g in brute_grams(t)})


def test_filters_answer_all_languages_and_correct_false_positives(monkeypatch):
    monkeypatch.setattr(L, "SLOTS", 1 << 10)  # crowded slots: many false positives
    monkeypatch.setattr(L, "RARE", 0.0)
    words = {"aa": ["alpha beta gamma delta"], "bb": ["uno dos tres cuatro"], "cc": ["alpha uno zzz yyy"]}
    f = L.fit(words)
    h, row, _ = L.grams([w[0] for w in words.values()])
    counts = f.counts(h, row, 3)
    sets = {k: set(brute_grams(v[0])) for k, v in words.items()}
    for i, t in enumerate(words.values()):
        g = brute_grams(t[0])
        for j, name in enumerate(f.languages):
            assert abs(counts[i, j] - sum(x in sets[name] for x in g)) <= 3
    assert [f.languages[i] for i in f.predict(["alpha beta", "dos tres", "zzz yyy"])[0]] == ["aa", "bb", "cc"]


def test_many_languages():
    f = L.fit({f"l{i:03d}": [f"{chr(97 + i % 26)}{chr(97 + i // 26)}q{chr(97 + i % 7)} " * 5] for i in range(130)})
    assert f.bits.shape[0] == 3
    assert f.languages[f.predict(["zeqd " * 3])[0][0]] == "l129"


def test_edges(spark):
    schema = "doc_id long, text string, lang string, score string"
    df = spark.createDataFrame(
        [(1, None, "en", "x"), (2, "", None, None), (3, "12 !", "en", None), (4, "the the", "en", None), (4, "the the", "en", None), (5, "日本", None, None)],
        schema
    )
    f = L.train(df)
    got = [(r.doc_id, r.lang_pred, r.score) for r in L.language_id(df, f).collect()]
    assert got[:3] == [(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0)]
    assert got[3] == got[4] and got[3][1] == "en" and got[3][2] > 0.9
    assert got[5] == (5, "en", 0.0)
    empty = df.limit(0)
    assert L.language_id(empty, L.train(empty)).count() == 0
    assert L.language_id(df, L.train(empty)).first().lang_pred == "und"


def test_query_held_out_accuracy(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = L.op1_language_id(spark, SF).collect()
    assert len(rows) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r.lang_pred == docs[r.doc_id].lang for r in rows if r.held_out]
    assert np.mean(held) > 0.97


def test_brute_force_counts_sets(spark):
    """The prediction is that of plain sets of n-grams, but for the few false positives that the correction leaves."""
    rows = [r for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r.text and r.lang]
    train, rest = rows[::2], rows[1::2]
    samples = {}
    for r in train:
        samples.setdefault(r.lang, []).append(r.text)
    f = L.fit(samples)
    rate = {}
    for name, texts in samples.items():
        n = Counter(g for t in texts for g in brute_grams(t))
        top = n.most_common(L.TOP)
        rate[name] = {g: c / sum(n.values()) for g, c in top}
    sets = {a: {g for g, x in ra.items() if x >= L.RARE * max(rb.get(g, 0) for rb in rate.values())} for a, ra in rate.items()}
    own = {a: sum(rate[a][g] for g in s) for a, s in sets.items()}
    want = []
    for r in rest:
        grams = brute_grams(r.text)
        want.append(max(sorted(sets), key=lambda a: sum(g in sets[a] for g in grams) / max(len(grams), 1) / own[a]))
    got = [f.languages[i] for i in f.predict([r.text for r in rest])[0]]
    lettered = [any(c.isalpha() for c in r.text) for r in rest]
    assert np.mean([a == b for a, b, ok in zip(got, want, lettered) if ok]) > 0.995


def test_samples_at_any_size():
    for n in (10, 10_000, 8 * 10**8, 10**11, 10**15):
        below = threshold(n, L.PER_LANGUAGE)
        assert 0 < below < 2**63 and min(n, 1.9 * L.PER_LANGUAGE) <= n * (below + 1) / 2**63 <= max(n, 2.1 * L.PER_LANGUAGE)


def test_samples_are_bounded(spark, monkeypatch):
    """One repeated key, or no key, makes the sample no larger; a language of any size keeps its sample; long texts count by their length."""
    seen = {}
    monkeypatch.setattr(L, "fit", lambda samples, rows=None: seen.update(samples=samples, rows=rows))
    many = spark.range(5000).selectExpr("cast(null as bigint) doc_id", "concat('text ', id) text", "'aa' lang")
    same = spark.range(3000).selectExpr("7 doc_id", "'the same text' text", "'bb' lang")
    L.train(many.unionByName(same), per_language=80)
    assert len(seen["samples"]["aa"]) == 80 and seen["samples"]["bb"] == ["the same text"] and seen["rows"] == {"aa": 5000, "bb": 3000}
    first = seen["samples"]["aa"]
    L.train(many.repartition(7).unionByName(same), per_language=80)
    assert seen["samples"]["aa"] == first
    monkeypatch.setattr(L, "CHARS", 1000)
    L.train(spark.range(50).selectExpr("id doc_id", "concat(repeat('x', 300), id) text", "'cc' lang"), per_language=80)
    assert len(seen["samples"]["cc"]) == 3
    monkeypatch.setattr(L, "LANGUAGES", 2)
    L.train(spark.range(60).selectExpr("id doc_id", "cast(id as string) text", "concat('l', least(id % 20, 3)) lang"))
    assert sorted(seen["samples"]) == ["l0", "l3"] or len(seen["samples"]) == 2


def test_very_long_and_mixed_texts(spark):
    long = "alpha beta gamma delta " * 40_000
    df = spark.createDataFrame(
        [(1, long, "aa"), (2, "uno dos tres cuatro " * 40_000, "bb"), (3, "beta", None), (4, "dos", None)],
        "doc_id long, text string, lang string"
    )
    got = {r.doc_id: r.lang_pred for r in L.language_id(df, L.train(df)).collect()}
    assert got == {1: "aa", 2: "bb", 3: "aa", 4: "bb"}
