import json

import numpy as np
import pytest
from tokenizers import Tokenizer

from martflow.llm import token_shards as T
from martflow.llm.bpe import default_path

SF = "/root/testdata/sf0.001"


def rebuilt(out, rows):
    """{(key, first slot of piece 0): ids} by reading every slot in order."""
    with open(out / "index.json") as f:
        n = json.load(f)["sequences"]
    whole = T.read_slots(out, 0, n)
    texts = {}
    for r in sorted(rows, key=lambda r: (str(r[0]), r.piece)):
        texts.setdefault(r[0], []).append(whole[r.slot][: r.n_ids])
    return {k: np.concatenate(v).tolist() for k, v in texts.items()}, whole


def test_round_trip(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = T.write_shards(docs, str(tmp_path / "a"), length=64, per_shard=100).collect()
    got, whole = rebuilt(tmp_path / "a", rows)
    lib = Tokenizer.from_file(default_path())
    for r in docs.collect():
        assert got[r.doc_id] == [*lib.encode(r.text or "", add_special_tokens=False).ids, T.PAD]
    assert sorted(r.slot for r in rows) == list(range(len(whole)))
    assert all(r.shard == r.slot // 100 and r.offset == r.slot % 100 * 128 for r in rows)
    # resumable: any start gives the same order
    for start in (0, 1, 99, 100, 101, len(whole) - 3):
        assert (T.read_slots(str(tmp_path / "a"), start, 5) == whole[start : start + 5]).all()
    # a second run leaves the same bytes
    T.write_shards(docs, str(tmp_path / "b"), length=64, per_shard=100)
    for p in sorted((tmp_path / "a").glob("shard-*")):
        assert p.read_bytes() == (tmp_path / "b" / p.name).read_bytes()


def test_edges(spark, tmp_path):
    data = [
        (1, None, "x"), (2, "", "y"), (3, "  two  spaces\n\n ", None), (None, "no key", None), (5, "a" * 5000, None),
        (6, "tab\there\r\nand there", None), (6, "again", None)
    ]
    df = spark.createDataFrame(data, "doc_id long, text string, shard string").coalesce(2)
    path = str(tmp_path / "in")
    df.write.parquet(path)
    rows = T.write_shards(spark.read.parquet(path), str(tmp_path / "out"), length=16, per_shard=8).collect()
    lib = Tokenizer.from_file(default_path())
    got, _ = rebuilt(tmp_path / "out", [r for r in rows if r[0] != 6])
    assert got == {k: [*lib.encode(t or "", add_special_tokens=False).ids, T.PAD] for k, t, _ in data if k != 6}
    assert sum(r[0] == 6 for r in rows) == 2
    empty = spark.read.parquet(path).filter("false")
    assert T.write_shards(empty, str(tmp_path / "none")).count() == 0
    assert len(T.read_slots(str(tmp_path / "none"), 0, 3)) == 0


def test_a_changed_reading_fails(spark, tmp_path):
    import os

    from pyspark.sql import functions as F

    words = F.udf(lambda i: "word " * int.from_bytes(os.urandom(2), "big")).asNondeterministic()
    unstable = spark.range(50).select(F.col("id").alias("doc_id"), words("id").alias("text"))
    with pytest.raises(Exception, match="changed between"):
        T.write_shards(unstable, str(tmp_path / "bad"), length=16, per_shard=64).collect()


def test_query(spark):
    rows = T.op3_token_shards(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert len({r.doc_id for r in rows}) == docs and sorted(r.slot for r in rows) == list(range(len(rows)))


def test_names_of_stores(tmp_path):
    for name in (f"{tmp_path}", f"file:{tmp_path}", f"file://{tmp_path}"):
        assert T._store(name)[1] == str(tmp_path)
    names = {
        "s3a://bucket/a/b": "s3://bucket/a/b", "hdfs://node:9000/a": "hdfs://node:9000/a", "gcs://bucket/a": "gs://bucket/a",
        "abfss://c@account/a": "abfs://c@account/a"
    }
    assert {k: T._uri(k) for k in names} == names
