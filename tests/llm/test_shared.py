import numpy as np
from pyspark.sql import functions as F

from martflow.llm import shared as S


def test_spread_join_equals_the_plain_join(spark, monkeypatch):
    monkeypatch.setattr(S, "HOT_ROWS", 10)
    monkeypatch.setattr(S, "HOT", 8)
    left = spark.range(1000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 97 == 0, None).otherwise(F.col("id") % 50 + 100).alias("k"), "id")
    right = spark.range(0, 130).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left"):
        got = S.spread_join(left, right, "k", how)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, left.join(right, "k", how).collect()), key=str)
    assert "BroadcastHashJoin" in S.spread_join(left, right, "k")._jdf.queryExecution().explainString(S_mode(spark))


def S_mode(spark):
    return spark.sparkContext._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")


def test_row_marks_tell_rows_apart(spark):
    df = spark.createDataFrame(
        [(1, None, "a", {"x": 1}), (None, 1, "a", {"x": 1}), (1, None, "a", {"x": 2}), (1, None, None, None)],
        "a int, b int, c string, d map<string,int>"
    )
    marks = [tuple(r) for r in df.select(*S.row_marks(df)).collect()]
    assert marks[0] == marks[2] and len(set(marks)) == 3  # a map is no part of the mark
    assert all(a != b for a, b in marks)


def test_scratch_tables_go_with_their_readers(spark):
    s = S.Scratch(spark)
    a, b = s.written(spark.range(3), "a"), s.written(spark.range(4), "b")
    paths = [p for p, _ in s.paths.values()]
    s.free(a)
    out = s.result(b, "c")
    assert out.count() == 4
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(paths[0]).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    assert not any(fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)) for p in paths)


def test_mix64_is_a_bijection_on_a_sample():
    x = np.arange(100_000, dtype=np.uint64)
    assert len(np.unique(S.mix64(x))) == len(x)
