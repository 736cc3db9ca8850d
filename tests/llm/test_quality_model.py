import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from martflow.llm import quality_model as Q
from martflow.llm.shared import BASE, BYTE_CODE, text_blocks

SF = "/root/testdata/sf0.01"


def brute_count(text):
    ws = text.split()
    pieces = [f" {w} ".encode() for w in ws]
    grams = sum(1 for p in pieces for n in Q.N for i in range(len(p) - n + 1) if b" " not in p[i + 1 : i + n - 1])
    return len(ws) + grams + max(len(ws) - 1, 0)


def test_feature_counts_match_brute_force():
    texts = ["", "a", "ab cd", "straße  und\tmehr\nso", " x ", "word " * 40]
    (i, j, raw, off), = text_blocks(pa.array(texts, pa.large_string()))
    f, at = Q.features(raw, off)
    assert np.bincount(at, minlength=j).tolist() == [brute_count(t) for t in texts]
    assert f.min() >= 0 and f.max() < 1 << Q.BITS


def test_block_size_does_not_matter():
    texts = [" ".join(random.Random(i).choices(["aa", "bb", "ccc", "dé"], k=i)) for i in range(50)]
    m = np.random.default_rng(1).normal(size=1 << Q.BITS)
    whole = Q.scores(m, pa.array(texts, pa.large_string()))
    assert np.allclose(whole, [Q.scores(m, pa.array([t], pa.large_string()))[0] for t in texts])


def test_learns_words_subwords_and_repetition():
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    good = [" ".join(word() for _ in range(60)) for _ in range(150)]
    junk = [" ".join(word() + "!!" for _ in range(60)) for _ in range(75)] + [" ".join([word()] * 30 + [word()] * 30) for _ in range(75)]
    m = Q.fit(good[:100] + junk[::2], [1] * 100 + [0] * 75)
    s, t = Q.scores(m, pa.array(good[100:])), Q.scores(m, pa.array(junk[1::2]))
    assert (s >= 0.5).mean() > 0.95 and (t < 0.5).mean() > 0.95


def test_edges(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, " \n", None), (4, "a b", None), (4, "a b", None)], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(4, 1, "t"), (None, 0, None), (1, None, None)], "doc_id long, quality int, text string")
    m = Q.train(df, labels)
    assert [(r.score, r.predicted) for r in Q.quality_scores(df, m).collect()] == [(0.5, 0)] * 5
    assert Q.quality_scores(df.limit(0), m).count() == 0
    assert not Q.train(df, labels.limit(0)).any()


def test_query_held_out(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = Q.op9_quality_model(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.7) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    assert np.mean([p == q for p, q in held]) > 0.9


def _mix(x):
    m = 2**64 - 1
    for _ in range(2):
        x ^= x >> 32
        x = x * 0xD6E8FEB86659FD93 & m
    return x ^ x >> 32


def test_scores_match_a_plain_reading():
    """Features and scores again, a word and a byte at a time, with Python's own integers."""
    base, code = int(BASE), [int(c) for c in BYTE_CODE]
    margins = np.random.default_rng(2).normal(size=1 << Q.BITS).astype(np.float32)
    texts = ["", "one", "one two one two", "straße  und\tmehr", "a bb ccc dddd a bb", "x " * 30]
    for text, got in zip(texts, Q.scores(margins, pa.array(texts, pa.large_string()))):
        words = [w.encode() for w in text.split()]
        hashes = [_mix((sum(code[b] * pow(base, i, 2**64) for i, b in enumerate(w)) + len(w)) % 2**64) for w in words]
        rows = [_mix((h + 1) % 2**64) >> 64 - Q.BITS for h in hashes]
        for w in words:
            edged = b" " + w + b" "
            for n in Q.N:
                for i in range(len(edged) - n + 1):
                    acc = 0
                    for b in edged[i : i + n]:
                        acc = (acc * base + code[b]) % 2**64
                    rows.append(_mix((acc + n) % 2**64) >> 64 - Q.BITS)
        seen = set()
        for pair in zip(hashes, hashes[1:]):
            rows.append(int(pair in seen))
            seen.add(pair)
        mean = sum(float(margins[r]) for r in rows) / max(len(rows), 1)
        assert abs(got - 1 / (1 + np.exp(-mean))) < 1e-6, text


def test_samples_are_bounded(spark, monkeypatch):
    """A key with many texts gives one of them, a repeated label counts once, large classes keep their sample."""
    seen = {}
    monkeypatch.setattr(Q, "fit", lambda texts, labels: seen.update(texts=texts, labels=labels))
    docs = spark.range(4000).selectExpr("id doc_id", "concat('text ', id) text").unionByName(
        spark.range(3000).selectExpr("9000 doc_id", "concat('again ', id) text")
    )
    labels = spark.range(4000).selectExpr("id doc_id", "cast(id % 2 as int) quality").unionByName(spark.range(2000).selectExpr("9000 doc_id", "1 quality"))
    Q.train(docs, labels, per_class=100)
    assert sorted(Counter(seen["labels"]).items()) == [(0, 100), (1, 100)] and len(set(seen["texts"])) == 200 and sum(
        t.startswith("again") for t in seen["texts"]
    ) <= 1
    first = seen["texts"]
    Q.train(docs.repartition(5), labels.repartition(3), per_class=100)
    assert seen["texts"] == first
    Q.train(docs, labels.filter("doc_id = 9000 or quality = 0"), per_class=100)
    assert Counter(seen["labels"]) == {0: 100, 1: 1}


def test_very_long_text(spark):
    m = np.random.default_rng(1).normal(size=1 << Q.BITS).astype(np.float32)
    df = spark.createDataFrame([(1, "word another " * 100_000), (2, "word another " * 2)], "doc_id long, text string")
    a, b = (r.score for r in Q.quality_scores(df, m).orderBy("doc_id").collect())
    assert 0 <= a <= 1 and 0 <= b <= 1
