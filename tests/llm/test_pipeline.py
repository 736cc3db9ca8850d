import hashlib
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

import corpus_pipeline
from martflow.llm import bpe, language_id, mixing
from tests.llm.test_jaccard_join import brute as brute_components
from tests.llm.test_quality_rules import brute as brute_quality

SF = "/root/testdata/sf0.001"


def test_run_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    sample = {}
    for r in docs:
        if zlib.crc32(str(r.doc_id).encode()) % 5 and r.lang is not None and r.text is not None:
            sample.setdefault(r.lang, []).append(r.text)
    filters = language_id.fit(sample)  # all of it: fewer rows than the bound
    best, score = filters.predict([r.text for r in docs])
    docs = [r for r, b, s in zip(docs, best, score) if b >= 0 and s >= language_id.LEAST_SCORE]
    docs = [r for r in docs if brute_quality(r.text)[-1]]
    head = {k for k, _, c in brute_components([(r.doc_id, r.text) for r in docs], 5, 80) if k == c}
    docs = [r for r in docs if r.doc_id in head]
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} <= head and max(Counter(r.doc_id for r in rows).values()) <= 2
    # the mixture takes its targets, and the codes are those of what it takes
    mixed = mixing.mixture(spark.createDataFrame(docs, spark.read.parquet(f"{SF}/documents.parquet").schema)).collect()
    lib = Tokenizer.from_file(bpe.default_path())
    want = Counter()
    for r in mixed:
        ids = np.array(lib.encode(r.text, add_special_tokens=False).ids, "<u4")
        want[r.doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()] += 1
    assert Counter(map(tuple, rows)) == want
    size, taken = Counter(), Counter()
    for r in docs:
        size[r.source] += len(r.text.split())
    for r in mixed:
        taken[r.source] += len(r.text.split())
    order = sorted(size)
    for s, t in zip(order, mixing.targets([size[x] for x in order], [mixing.WEIGHTS[i % 3] for i in range(len(order))])):
        assert abs(taken[s] - t) <= mixing.BLOCK


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_rules", "jaccard_join", "mixing", "bpe"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).schema.names == docs.schema.names
    odd = docs.limit(20).selectExpr(
        "cast(null as bigint) doc_id", "text", "cast(null as string) lang", "source", "n_chars", "'x' score", "1 as class", "true kept"
    )
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, odd, SF).collect()
        stage(spark, docs.limit(0), SF).collect()


def test_columns_of_documents_go_through(spark):
    """Columns under the names that the stages use themselves keep their values."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("*", "'x' score", "1 as class", "doc_id + 5 kept", "'l' lang_pred", "2 n_words", "3 m1", "4 draws", "5 mark", "6 no")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        rows = out.selectExpr("score", "class", "kept - doc_id", "lang_pred", "n_words", "m1", "draws", "mark", "no").distinct().collect()
        assert [tuple(r) for r in rows] == [("x", 1, 5, "l", 2, 3, 4, 5, 6)], name
