"""Operator 1: language identification by language-bitmask n-gram filters.

One bit-sliced Bloom filter serves every language: slot p holds one bit per language, and the AND of the K slots of an
n-gram is the mask of all languages whose filter contains it. Per text the masks' bits are counted by language, the
expected false positives are taken out (hits = true + (n - true) * rate), each count is set against the share that the
language's own training texts reach, and the largest decides.

N-grams are N consecutive letters of the lower-cased text within a word, with one space for each word edge; anything
that is not a letter is an edge. The filters hold the TOP most frequent n-grams of each language that are not
foreign to it (RARE).

Fitting counts the rows of every language over the whole table, then reads the texts of about PER_LANGUAGE distinct rows
of each, those least by a hash of the text, up to CHARS characters in all, an equal part a language: documented bounds, exact at any number of
rows, so the model's cost does not grow with the corpus. Where the labels name more than LANGUAGES languages, the most
frequent are learned. Prediction reads the text alone, whole, whatever its length, in a narrow map; the filter (2 MB for
each 64 languages) travels as a broadcast variable.

Defined results: `und` with score 0 where the text is null or has no letter. A text with letters but no n-gram that any
filter knows takes the language with the most training rows (ties: the first by name), score 0. Other ties go to the
language that sorts first. Without any training rows every text is `und`. Repeated rows repeat.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from martflow.llm.shared import annotate, content_hash, kept_rows, mix64, sampled, table

N = (2, 3, 4)
K = 3
SLOTS = 1 << 18
TOP = 20_000
#: A language holds an n-gram if it is at least so frequent there as a share of where it is most frequent: foreign
#: passages within a language's texts do not enter its filter.
RARE = 0.5
PER_LANGUAGE, CHARS, LANGUAGES = 800, 1 << 26, 1024
UNKNOWN = "und"
#: The pipeline rejects texts whose best language covers less of their n-grams than this.
LEAST_SCORE = 0.3
_FACTORS = mix64(np.arange(1, 9, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Whether each code point is a letter; made once in each process."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n-gram hashes, row of each, whether each row has a letter)."""
    rows = len(texts)
    low = [t.lower() for t in texts]
    lens = np.fromiter(map(len, low), np.int64, rows) + 1
    points = np.frombuffer((" ".join(low) + " ").encode("utf-32-le", "replace"), np.uint32)
    letter = _letters()[points]
    row = np.repeat(np.arange(rows), lens)
    lettered = np.bincount(row[letter], minlength=rows) > 0
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one edge after each word
    points, letter, row = np.where(letter, points, 32)[keep].astype(np.uint64), letter[keep], row[keep]
    points = np.concatenate([[np.uint64(32)], points])  # and one before the first
    letter = np.concatenate([[False], letter])
    row = np.concatenate([row[:1], row])
    found, at = [], []
    for n in N:
        m = len(points) - n + 1
        if m <= 0:
            continue
        whole = np.ones(m, bool)
        for j in range(1, n - 1):
            whole &= letter[j : j + m]
        if n == 2:
            whole &= letter[:m] | letter[1 : m + 1]
        whole = np.flatnonzero(whole)
        h = np.full(len(whole), _FACTORS[7] * np.uint64(n), np.uint64)
        for j in range(n):
            h += points[whole + j] * _FACTORS[j]
        found.append(mix64(h))
        at.append(np.where(letter[whole], row[whole], row[whole + 1]))  # an edge goes with the word after it
    return np.concatenate(found) if found else np.zeros(0, np.uint64), np.concatenate(at) if at else np.zeros(0, np.int64), lettered


def _slots(h: np.ndarray, k: int) -> np.ndarray:
    return ((h >> np.uint64(20 * k)) & np.uint64(SLOTS - 1)).astype(np.int64)


@dataclass
class Filters:
    """languages in sorted order; bits[w, slot]: word w of a slot's language bits."""

    languages: list[str]
    bits: np.ndarray
    false_rate: np.ndarray
    own_share: np.ndarray
    fallback: int

    def counts(self, h: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        """Corrected number of n-grams of each language in each row: [rows, languages]."""
        n = np.bincount(row, minlength=rows)
        out = np.zeros((rows, len(self.languages)))
        slots = [_slots(h, k) for k in range(K)]
        for w, words in enumerate(self.bits):
            mask = words[slots[0]]
            for s in slots[1:]:
                mask &= words[s]
            some = mask != 0
            mask, at = mask[some], row[some]
            for i in range(64 * w, min(64 * w + 64, len(self.languages))):
                out[:, i] = np.bincount(at[(mask >> np.uint64(i % 64)) & np.uint64(1) != 0], minlength=rows)
        return np.maximum(0, (out - n[:, None] * self.false_rate) / (1 - self.false_rate))

    def predict(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The index of each text's language (-1: und), and its score."""
        rows = len(texts)
        if not self.languages:
            return np.full(rows, -1), np.zeros(rows)
        h, row, lettered = grams([t or "" for t in texts])
        n = np.bincount(row, minlength=rows)
        share = self.counts(h, row, rows) / np.maximum(n, 1)[:, None] / self.own_share
        best = share.argmax(1)
        top = np.minimum(share.max(1), 1.0)
        best = np.where(top > 0, best, self.fallback)
        return np.where(lettered, best, -1), np.where(lettered, top, 0.0)


def fit(samples: dict[str, list[str]], rows: dict[str, int] | None = None) -> Filters:
    """Filters of the languages named in samples, from the texts of each; rows: how many training rows each has."""
    languages = sorted(samples)
    tops: list[tuple[np.ndarray, np.ndarray]] = []
    for name in languages:
        seen, times = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for part in _chunks(samples[name]):
            h, c = np.unique(grams(part)[0], return_counts=True)
            both, inverse = np.unique(np.concatenate([seen, h]), return_inverse=True)
            times = np.bincount(inverse, np.concatenate([times, c]), len(both)).astype(np.int64)
            seen = both
        top = np.sort(np.lexsort((seen, -times))[:TOP])
        tops.append((seen[top], times[top] / max(times.sum(), 1)))
    every, inverse = np.unique(np.concatenate([h for h, _ in tops] or [np.zeros(0, np.uint64)]), return_inverse=True)
    most = np.zeros(len(every))
    np.maximum.at(most, inverse, np.concatenate([r for _, r in tops] or [np.zeros(0)]))
    bits = np.zeros(((len(languages) + 63) // 64, SLOTS), np.uint64)
    own = np.zeros(len(languages))
    for i, (h, rate) in enumerate(tops):
        held = rate >= RARE * most[np.searchsorted(every, h)]
        own[i] = rate[held].sum()
        for k in range(K):
            bits[i // 64, _slots(h[held], k)] |= np.uint64(1) << np.uint64(i % 64)
    full = np.array([((bits[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(languages))])
    sizes = [(rows or {}).get(x, len(samples[x])) for x in languages]
    return Filters(languages, bits, full**K, np.maximum(own, 1e-9), int(np.argmax(sizes)) if sizes else 0)


def _chunks(texts: list[str], most: int = 1 << 16):
    """Runs of texts of at most `most` characters, or one longer text."""
    part: list[str] = []
    size = 0
    for t in texts:
        if part and size + len(t) > most:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def remainder(key: str, of: int) -> Column:
    """crc32 of a column's text, modulo `of`; a null counts as an empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % of


def train(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = PER_LANGUAGE) -> Filters:
    """Fit on rows of docs that have text and lang: all distinct texts of a language, or per_language of them."""
    rows = docs.select(F.col(lang).alias("l"), F.col(text).alias("t")).filter("l is not null and t is not null").withColumn("h", content_hash("t"))
    by = rows.groupBy("l").agg(F.count("*").alias("n"), F.approx_count_distinct("h").alias("d"))
    totals = by.orderBy(F.desc("n"), "l").limit(LANGUAGES).collect()
    if not totals:
        return fit({})
    picked = sampled(rows, "l", {r.l: r.d for r in totals}, per_language, CHARS // len(totals)).select("l", "h", "t").toArrow()
    samples: dict[str, list[tuple]] = {}
    for name, h, t in zip(*(picked.column(c).to_pylist() for c in ("l", "h", "t"))):
        samples.setdefault(name, []).append((h, t))
    return fit({name: [t for _, t in sorted(found)] for name, found in samples.items()}, {r.l: r.n for r in totals})


def language_id(docs: DataFrame, filters: Filters, text: str = "text") -> DataFrame:
    """docs with lang_pred and score."""
    shipped = docs.sparkSession.sparkContext.broadcast(filters)

    def make(col: pa.Array):
        f, best, score = shipped.value, [], []
        for i in range(0, len(col), 512):
            for part in _chunks([t or "" for t in col.slice(i, 512).to_pylist()]):
                b, s = f.predict(part)
                best.append(b)
                score.append(s)
        names = pa.array([*f.languages, UNKNOWN], pa.string())
        return [names.take(pa.array(np.concatenate(best) % len(names))), np.concatenate(score)]

    return annotate(docs, text, [("lang_pred", "string"), ("score", "double")], make)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    filters = train(docs.filter(remainder("doc_id", 5) != 0))
    rows = docs.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "text")
    return language_id(rows, filters).drop("text")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the rows of docs in a language that their labels teach."""
    filters = train(docs.filter(remainder("doc_id", 5) != 0))
    known = (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE)
    return kept_rows(docs, "text", lambda df, text: language_id(df, filters, text), known)
