import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from martflow.llm import bpe

PATH = bpe.default_path()


@pytest.fixture(scope="module")
def both():
    with open(PATH, "rb") as f:
        ours = bpe.ByteBPE(f.read())
    return ours, Tokenizer.from_file(PATH)


TEXTS = [
    "", " ", "  ", "a", "Hello world", "  lead and trail  ", "tab\tand\nline\r\n\r\nend\n", "x\n\ny", "don't we'll I'm you've they'd it's we're", "É ü 日本語 🙂👍🏽 ‍", "\x00\x01\x1c\x1d\x1e\x1f\x85",
    "<|endoftext|>", "a<|endoftext|>b <|endoftext|> c", "<|endoftext|><|endoftext|>", "<|endoftex", "12345 67 ①②", "!!!###$$$ a!b?c", "word " * 50, "a b  c", "é", "a\x1cb c", " \n a", "a \nb", "a\n b", "a\tb c\td", "﻿x", "a" * 3000,
]


@pytest.mark.parametrize("text", TEXTS)
def test_same_as_library(both, text):
    ours, theirs = both
    want = theirs.encode(text, add_special_tokens=False).ids
    assert ours.encode(text).tolist() == want
    assert ours.decode(want) == theirs.decode(want, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'abcthe<|>s"), st.characters(codec="utf-8")), max_size=60))
def test_property(both, text):
    ours, theirs = both
    assert ours.encode(text).tolist() == theirs.encode(text, add_special_tokens=False).ids
    assert ours.decode(ours.encode(text)) == text


def test_cache_bound(both, monkeypatch):
    ours, theirs = both
    monkeypatch.setattr(bpe, "CACHE", 5)
    text = " ".join(f"word{i % 17} thing{i}" for i in range(300))
    assert ours.encode(text).tolist() == theirs.encode(text, add_special_tokens=False).ids


def test_query(spark):
    d = "/root/testdata/sf0.001"
    theirs = Tokenizer.from_file(PATH)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = bpe.op6_bpe(spark, d).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = theirs.encode(docs[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(theirs.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_frames(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, "a b", None), (2, "a b", None)], "doc_id long, text string, ids string")
    enc = bpe.bpe_encode(df)
    assert [(r.n_tokens, len(r.ids)) for r in enc.collect()] == [(0, 0), (2, 8), (2, 8)]
    assert [r.decoded for r in bpe.bpe_decode(enc).collect()] == ["", "a b", "a b"]
    assert bpe.bpe_digests(df.limit(0)).count() == 0
