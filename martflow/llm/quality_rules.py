"""Operator 7: quality rules by repetition coverage.

Every text becomes an array of 64-bit word hashes (numpy over Arrow's UTF-8 bytes; nothing is decoded). For each of
several n, the rolling hash of every n-word window is sorted within its text; windows whose hash occurs twice or more
mark their words, and the code points of marked words against those of all words are the coverage of that n. Lines that
repeat an earlier line of the text give a coverage of their own. A text is kept if it passes the base rules and no
coverage exceeds its limit.

Defined results: a null or empty text, or one of white space only, has no words, so it fails the base rule on length
and is not kept. Rows are independent of each other: repeated rows give repeated results. A text of any length is worked
on whole; memory follows the longest single text. Hashes are 64-bit, so a chance collision within a text is the only
source of error (about 1e-12 for a text of 10,000 words).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martflow.llm.shared import BASE, BYTE_CODE, Words, annotate, kept_rows, mix64, powers, table, text_blocks, windows

#: Words of a window: largest share of code points that duplicated windows of that length may cover.
COVERAGE = {3: 0.30, 5: 0.25, 8: 0.20, 10: 0.20}
#: The same for lines that repeat an earlier one.
LINE_COVERAGE = 0.30
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
BASE_WINDOW, LEAST_WORDS, MOST_REPEAT = 5, 10, 20
FIELDS = [
    ("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"),
    ("base_failed", "boolean"), ("kept", "boolean"), ("worst_coverage", "double")
]


def _in_duplicates(h: np.ndarray, row: np.ndarray, salt: np.ndarray, n: int) -> np.ndarray:
    """Which words lie in an n-word window that its row has twice or more."""
    g, at = windows(h, row, n)
    if len(g) < 2:
        return np.zeros(len(h), bool)
    g = g + salt[row[at]]
    s = np.sort(g)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return np.zeros(len(h), bool)
    twice = twice[np.concatenate([[True], twice[1:] != twice[:-1]])]
    k = np.searchsorted(twice, g)
    at = at[twice[np.minimum(k, len(twice) - 1)] == g]
    edge = np.zeros(len(h) + 1, np.int32)
    edge += np.bincount(at, minlength=len(h) + 1).astype(np.int32)
    edge -= np.bincount(at + n, minlength=len(h) + 1)[: len(h) + 1].astype(np.int32)
    return np.cumsum(edge[:-1]) > 0


def _repeated_lines(w: Words, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of every line that holds a word and equals an earlier line of its row."""
    raw, off = w.raw, w.offsets
    breaks = np.flatnonzero(raw == 10)
    begin = np.union1d(off[:-1], breaks + 1)
    begin = begin[begin < len(raw)]
    if not len(begin):
        return (np.zeros(0, np.int64),) * 3
    row = np.searchsorted(off, begin, "right") - 1
    end = np.minimum(np.append(begin[1:], len(raw)), off[row + 1])
    lens = end - begin
    body = BYTE_CODE[raw[begin[0] : end[-1]]] * powers(int(lens.max()))[np.arange(begin[0], end[-1]) - np.repeat(begin, lens)]
    broken = end - 1
    closed = raw[np.maximum(broken, 0)] == 10  # the line break itself is not part of the line
    h = np.add.reduceat(body, begin - begin[0])
    h -= np.where(closed, BYTE_CODE[10] * powers(int(lens.max()))[lens - 1], np.uint64(0))
    h = mix64(h + (lens - closed).astype(np.uint64)) + salt[row]
    worded = np.searchsorted(w.starts, end) > np.searchsorted(w.starts, begin)
    h, row, begin, end = h[worded], row[worded], begin[worded], end[worded]
    _, first = np.unique(h, return_index=True)
    again = np.ones(len(h), bool)
    again[first] = False
    return row[again], begin[again], end[again]


def measure(texts: pa.Array) -> list[np.ndarray]:
    parts = []
    for i, j, raw, off in text_blocks(texts):
        rows = j - i
        w = Words(raw, off)
        salt = mix64(np.arange(1, rows + 1, dtype=np.uint64) * BASE)
        h = w.hashes()
        points = np.concatenate([[0], np.cumsum(w.inside & ((raw & 0xC0) != 0x80))])
        chars = points[w.ends] - points[w.starts]
        word_chars = points[off[1:]] - points[off[:-1]]
        marks = np.concatenate([[0], np.cumsum(SYMBOLS[raw])])
        symbols = marks[off[1:]] - marks[off[:-1]]
        whole = np.maximum(word_chars, 1)
        worst = np.zeros(rows)
        repeat = np.zeros(rows, np.int64)
        for n, limit in COVERAGE.items():
            dup = _in_duplicates(h, w.row, salt, n)
            if n == BASE_WINDOW:
                repeat = np.bincount(w.row, dup, rows).astype(np.int64)
            worst = np.maximum(worst, np.bincount(w.row, chars * dup, rows) / whole / limit)
        row, begin, end = _repeated_lines(w, salt)
        lines = np.bincount(row, minlength=rows)
        worst = np.maximum(worst, np.bincount(row, points[end] - points[begin], rows) / whole / LINE_COVERAGE)
        failed = (w.n < LEAST_WORDS) | (100 * repeat > MOST_REPEAT * w.n)
        parts.append([w.n, word_chars, symbols, lines, repeat, failed, ~failed & (worst <= 1), worst])
    return [np.concatenate(x) for x in zip(*parts)]


def quality_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the counts, base_failed, kept and worst_coverage (the largest coverage as a multiple of its limit)."""
    return annotate(docs, text, FIELDS, measure)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text", "worst_coverage")


def kept_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the rows of docs whose text is kept."""
    return kept_rows(docs, "text", quality_rules, F.col("kept"))
