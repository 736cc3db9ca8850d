import re

import pyarrow as pa
import pytest

from martflow.llm.quality_rules import COVERAGE, LINE_COVERAGE, measure, op7_quality_rules, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    ws = WORD.findall(t)

    def dup(n):
        grams = [tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)]
        seen, marked = {}, [False] * len(ws)
        for g in grams:
            seen[g] = seen.get(g, 0) + 1
        for i, g in enumerate(grams):
            if seen[g] > 1:
                marked[i : i + n] = [True] * n
        return marked

    chars = sum(map(len, ws))
    earlier, lines, line_chars = set(), 0, 0
    for line in t.split("\n"):
        if WORD.search(line):
            if line in earlier:
                lines += 1
                line_chars += sum(map(len, WORD.findall(line)))
            earlier.add(line)
    rep = sum(dup(5))
    failed = len(ws) < 10 or 100 * rep > 20 * len(ws)
    worst = max(
        [sum(len(w) for w, m in zip(ws, dup(n)) if m) / max(chars, 1) / lim for n, lim in COVERAGE.items()] + [line_chars / max(chars, 1) / LINE_COVERAGE]
    )
    return [len(ws), chars, len(re.findall(r"[#*$%&|<>]", t)), lines, rep, failed, not failed and worst <= 1]


TEXTS = [
    None, "", " \n\t ", "a", "a b c d e f g h i j", "x\n\nx\nx\n y\n y", "é ü 日本 # $ | <b>" * 3, "one two three four five " * 9, "a b c\x0bd\x1fe",
    "The line is here\nOther words come now and they differ a lot from it\nThe line is here", "\n\n", "same\r\nsame\r\nsame\n", "w" * 5000 + " " + "v" * 3, "a b c d e a b c d e f g h i j k l m n o p q r s t u v",
]


def test_matches_brute_force():
    got = list(zip(*[x.tolist() for x in measure(pa.array(TEXTS))[:7]]))
    assert [list(x) for x in got] == [brute(t) for t in TEXTS]


def test_sliced_and_long(spark):
    long = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
    arr = pa.array(["zzz", *TEXTS, long, long + " " + long])[1:]
    got = list(zip(*[x.tolist() for x in measure(arr)[:7]]))
    assert [list(x) for x in got] == [brute(t) for t in [*TEXTS, long, long + " " + long]]


def test_frame_edges(spark):
    df = spark.createDataFrame([(1, None, "k"), (1, None, "k"), (None, "a b", None)], "doc_id long, text string, kept string")
    assert [(r.doc_id, r.n_words, r.kept) for r in quality_rules(df).collect()] == [(1, 0, False), (1, 0, False), (None, 2, False)]
    assert quality_rules(df.limit(0)).count() == 0


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op7_quality_rules(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept] == brute(docs[r.doc_id])
