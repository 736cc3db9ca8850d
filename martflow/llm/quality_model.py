"""Operator 9: quality classifier of supervised subword embeddings.

A text's features are its words, the character (byte) n-grams of each word with its edges, and its word pairs by whether
the text had the same pair before; each is hashed to a row of one embedding matrix. The average of the rows, over all features
of the text, goes through a softmax of two classes. Rows and output are learned by stochastic gradient descent in numpy,
a text a step, with a falling rate.

The output is linear in the average, so a fitted model folds each row into one number, its margin between the classes; a
text's score is the logistic function of its mean margin. That is the same score at a tenth of the reads, and the model
to ship is one array of 2 ** BITS floats.

Fitting takes at most PER_CLASS labelled keys of each class, those least by a hash of the key, one text a key (of several
the one with the least hash), and at most CHARS characters, half a class: documented bounds, exact at any number of rows.
Everything else reads all rows. Scoring is a narrow map over whole texts.

Defined results: a null or empty text, or one of white space only, has no features, so its average is zero and it scores
0.5. A key with several labels counts with each of them. Without labelled rows of both classes every text scores 0.5.
Repeated rows repeat.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martflow.llm.language_id import remainder
from martflow.llm.shared import BASE, BYTE_CODE, SPACE, Words, annotate, content_hash, mix64, sampled, table, text_blocks, threshold

BITS = 18
N = (3, 4)
DIM = 12
EPOCHS, RATE = 6, 0.5
PER_CLASS, CHARS = 2500, 1 << 26
LEAST = 0.7


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(embedding row, text) of every feature of a block of texts."""
    rows = len(offsets) - 1
    w = Words(raw, offsets)
    h = w.hashes()
    last = np.uint64(64 - BITS)
    found, at = [(mix64(h + np.uint64(1)) >> last).astype(np.int32)], [w.row]
    # every byte, with one more space after each text
    row = np.repeat(np.arange(rows), np.diff(offsets))
    padded = np.full(len(raw) + rows + 1, 32, np.uint8)
    place = np.arange(len(raw)) + row + 1
    padded[place] = raw
    of = np.zeros(len(padded), np.int64)
    of[place] = row
    space = SPACE[padded]
    padded[space] = 32
    code = BYTE_CODE[padded]
    acc = np.zeros(len(code), np.uint64)
    for n in range(1, max(N) + 1):
        m = len(code) - n + 1
        if m <= 0:
            break
        acc = acc[:m] * BASE + code[n - 1 :]
        if n not in N:
            continue
        inner = ~space[1 : m + 1]
        for j in range(2, n - 1):
            inner &= ~space[j : j + m]
        s = np.flatnonzero(inner)
        found.append((mix64(acc[s] + np.uint64(n)) >> last).astype(np.int32))
        at.append(of[s + 1])
    if len(h) > 1:
        pair = np.flatnonzero(w.row[1:] == w.row[:-1])
        g = h[pair] * BASE + h[pair + 1] + mix64(w.row[pair].astype(np.uint64) + np.uint64(9))
        _, first = np.unique(g, return_index=True)
        again = np.ones(len(g), np.int32)
        again[first] = 0
        found.append(again)  # rows 0 and 1: a new pair, a pair seen before
        at.append(w.row[pair])
    return np.concatenate(found), np.concatenate(at)


def fit(texts: list[str], labels: list[int], seed: int = 5) -> np.ndarray:
    """The folded margins of a model trained on texts labelled 0 or 1."""
    size = 1 << BITS
    if len(set(labels)) < 2:
        return np.zeros(size, np.float32)
    docs = []
    for i, j, raw, off in text_blocks(pa.array(texts, pa.large_string())):
        f, at = features(raw, off)
        key, n = np.unique((at.astype(np.int64) << BITS) | f, return_counts=True)
        cut = np.searchsorted(key, np.arange(j - i + 1, dtype=np.int64) << BITS)
        for a, b in zip(cut[:-1], cut[1:]):
            c = n[a:b].astype(np.float32)
            docs.append(((key[a:b] & (size - 1)).astype(np.int32), c / max(c.sum(), 1)))
    rng = np.random.default_rng(seed)
    rows = rng.uniform(-1 / DIM, 1 / DIM, (size, DIM)).astype(np.float32)
    out = np.zeros((2, DIM), np.float32)
    y = np.eye(2, dtype=np.float32)[labels]
    steps, done = EPOCHS * len(docs), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(docs)):
            f, share = docs[i]
            rate = RATE * (1 - done / steps)
            done += 1
            if not len(f):
                continue
            mean = share @ rows[f]
            z = out @ mean
            p = np.exp(z - z.max())
            wrong = p / p.sum() - y[i]
            back = wrong @ out
            out -= rate * np.outer(wrong, mean)
            rows[f] -= (rate * share * len(f) ** 0.5)[:, None] * back
    return rows @ (out[1] - out[0])


def scores(margins: np.ndarray, texts: pa.Array) -> np.ndarray:
    parts = []
    for i, j, raw, off in text_blocks(texts):
        f, at = features(raw, off)
        n = np.bincount(at, minlength=j - i)
        mean = np.bincount(at, margins[f], j - i) / np.maximum(n, 1)
        parts.append(1 / (1 + np.exp(-np.clip(mean, -60, 60))))
    return np.concatenate(parts)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", per_class: int = PER_CLASS) -> np.ndarray:
    """Fit on the rows of docs that labels marks 0 or 1: one text of every key of a class, or of per_class of them."""
    marks = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).filter("k is not null and y in (0, 1)").withColumn("h", content_hash("k"))
    totals = {r.y: r.n for r in marks.groupBy("y").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not totals:
        return fit([], [])
    wanted = F.lit(False)
    for y, n in totals.items():  # two at most
        wanted = wanted | ((F.col("y") == y) & (F.col("h") <= F.lit(threshold(n, per_class))))
    few = F.broadcast(marks.filter(wanted).distinct())  # about 2 * per_class keys a class
    texts = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).filter("t is not null").join(few, "k")
    one = texts.groupBy("y", "h", "k").agg(F.min(F.struct(F.xxhash64("t").alias("g"), "t")).alias("one")).select("y", "h", F.col("one.t").alias("t"))
    got = sampled(one, "y", totals, per_class, CHARS // 2).select("h", "y", "t").toArrow()
    rows = sorted(zip(*(got.column(c).to_pylist() for c in ("h", "y", "t"))))
    return fit([t for _, _, t in rows], [y for _, y, _ in rows])


def quality_scores(docs: DataFrame, margins: np.ndarray, text: str = "text", least: float = LEAST) -> DataFrame:
    """docs with score and predicted."""
    shipped = docs.sparkSession.sparkContext.broadcast(margins)

    def make(col: pa.Array):
        s = scores(shipped.value, col)
        return [s, (s >= least).astype(np.int32)]

    return annotate(docs, text, [("score", "double"), ("predicted", "int")], make)


def op9_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    margins = train(docs, table(spark, sf_dir, "labels").filter(remainder("doc_id", 4) != 2))
    rows = docs.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "text")
    return quality_scores(rows, margins).drop("text")
