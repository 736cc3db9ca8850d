"""Session helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
import threading
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from martflow.sources.scratch import checkpoint_dir

#: A key with more than one row in HOT of a table, in a table of over HOT_ROWS rows, travels by broadcast in spread_join.
HOT, HOT_ROWS = 4096, 1 << 14


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_path(spark: SparkSession, what: str) -> str:
    """A new path in the folder of spark.checkpoint.dir, which all executors reach."""
    return f"{checkpoint_dir(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a table in the shared folder: its lineage ends there, and a lost executor costs one read."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables in the shared folder, each removed with its last reader, all of them when the result has been written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def written(self, df: DataFrame, what: str) -> DataFrame:
        path = new_path(self.spark, what)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def free(self, *tables: DataFrame) -> None:
        """Remove tables that written() gave and that nothing reads any more."""
        for t in tables:
            if found := self.paths.pop(id(t), None):
                drop_table(self.spark, found[0])

    def result(self, df: DataFrame, what: str) -> DataFrame:
        """df as a table that stays; the others go, and with them the shuffle files of the jobs that made them."""
        out = written(df, what)
        for path, _ in self.paths.values():
            drop_table(self.spark, path)
        self.paths.clear()
        release(self.spark)
        return out


#: Tables that lazily read results of stages still need; clear_left() removes them once those results are written.
LEFT: list[Scratch] = []


def clear_left() -> None:
    for s in LEFT:
        s.free(*[t for _, t in s.paths.values()])
    LEFT.clear()


def _hashable(kind: DataType) -> bool:
    if isinstance(kind, StructType):
        return all(_hashable(f.dataType) for f in kind.fields)
    return _hashable(kind.elementType) if isinstance(kind, ArrayType) else not isinstance(kind, MapType) and kind.typeName() != "variant"


def row_marks(df: DataFrame) -> tuple[Column, Column]:
    """Two 64-bit hashes of a row, m1 and m2: of all columns that Spark can hash, and which of them are null."""
    columns = [F.col(f"`{f.name}`") for f in df.schema.fields if _hashable(f.dataType)]
    parts = [x for c in columns for x in (c, c.isNull())]
    return F.xxhash64(F.lit(1), *parts).alias("m1"), F.xxhash64(F.lit(2), *parts).alias("m2")


#: Hashes that samples go by lie in 0 .. 2^63 - 1.
MOST_HASH = 2**63


def threshold(distinct: int, wanted: int) -> int:
    """The hash below which about twice `wanted` of so many distinct values lie; all of them where they are fewer."""
    return MOST_HASH - 1 if distinct <= 2 * wanted else MOST_HASH * 2 * wanted // distinct


def content_hash(*columns: Column) -> Column:
    return F.xxhash64(*columns).bitwiseAND(F.lit(MOST_HASH - 1))


def sampled(rows: DataFrame, group: str, groups: dict, wanted: int, most_chars: int, text: str = "t") -> DataFrame:
    """Of each group, the `wanted` rows with the least hash h, as long as their texts hold most_chars characters together.

    rows: group, h, text; groups: {group: its distinct hashes, about}. Rows with one hash count once, so neither a
    repeated row nor a repeated key makes the sample larger. Only about twice `wanted` rows of a group are ever compared:
    a threshold on the hash leaves out the others in the scan, at any number of rows. The first row of a group always
    counts.
    """
    spark = rows.sparkSession
    limits = spark.createDataFrame(
        [(g, threshold(n, wanted)) for g, n in groups.items()], rows.select(F.col(group), F.lit(0).cast("long").alias("_below")).schema
    )
    few = rows.join(F.broadcast(limits), group).filter(F.col("h") <= F.col("_below")).drop("_below").dropDuplicates([group, "h"])
    first = W.partitionBy(group).orderBy("h")
    few = few.withColumns({"_rank": F.row_number().over(first), "_chars": F.sum(F.length(text)).over(first.rowsBetween(W.unboundedPreceding, W.currentRow))})
    return few.filter(f"_rank = 1 OR _rank <= {int(wanted)} AND _chars <= {int(most_chars)}").drop("_rank", "_chars")


def spread_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", rows: int | None = None) -> DataFrame:
    """left.join(right, key, how), for a right side with one row a key, where a few keys may hold most rows of left.

    Rows of keys with more than one row in HOT stay where they are: those keys' rows of right, at most HOT, are broadcast.
    A table of up to HOT_ROWS rows is joined as it is, as none of its keys can overload a task. rows: left's number, or a bound of it, if known.
    """
    n = left.count() if rows is None else rows
    if n <= HOT_ROWS:
        return left.join(right, key, how)
    hot = [r[0] for r in left.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > n // HOT).select(key).collect()]
    if not hot:
        return left.join(right, key, how)
    keys = F.broadcast(left.sparkSession.createDataFrame([(k,) for k in hot], left.select(key).schema))
    few = F.broadcast(right.join(keys, key, "left_semi"))
    return left.join(keys, key, "left_semi").join(few, key, how).unionByName(left.join(keys, key, "left_anti").join(right, key, how))


def text_blocks(col: pa.Array, most: int = 1 << 16) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, UTF-8 bytes, row offsets) of runs of rows with at most `most` bytes, or of one longer row.

    A null counts as an empty text. The bytes are those of Arrow's own buffer: no text is decoded.
    """
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string()) if col.type != pa.large_string() else col
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    if not n:
        return
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, np.int64)[col.offset : col.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        j = min(j, n)
        yield i, j, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


_SEED = np.random.default_rng(20240229)
BYTE_CODE = _SEED.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit (xor, shift, multiply)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def powers(n: int, base: np.uint64 = BASE) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


#: The separators of `[^\x20\x09-\x0D]+`.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of a block of rows: starts and ends (bytes), row of each, first word of each row."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        self.raw, self.offsets = raw, offsets
        inside = ~SPACE[raw]
        before = np.empty_like(inside)
        before[:1] = False
        before[1:] = inside[:-1]
        at = offsets[:-1][offsets[:-1] < len(raw)]
        before[at] = False
        self.starts = np.flatnonzero(inside & ~before)
        after = np.empty_like(inside)
        after[-1:] = False
        after[:-1] = inside[1:]
        last = offsets[1:] - 1
        after[last[last >= 0]] = False
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.inside = inside
        self.first = np.searchsorted(self.starts, offsets)
        self.n = np.diff(self.first)
        self.row = np.repeat(np.arange(len(self.n)), self.n)

    def hashes(self, fold: np.ndarray | None = None) -> np.ndarray:
        """A 64-bit polynomial hash of each word; fold: a table of 256 bytes applied first."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        lens = self.ends - self.starts
        at = np.cumsum(lens) - lens
        pos = np.arange(int(lens.sum())) - np.repeat(at, lens)
        code = BYTE_CODE if fold is None else BYTE_CODE[fold]
        body = code[self.raw[self.inside]]
        body *= powers(int(lens.max()))[pos]
        return mix64(np.add.reduceat(body, at) + lens.astype(np.uint64))


def windows(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The rolling hash of every n-word window that stays within a row, and where each starts."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(row[:m] == row[n - 1 :])
    acc = np.zeros(m, np.uint64)
    for j in range(n):
        acc *= BASE
        acc += h[j : j + m]
    return mix64(acc[at]), at


_STATE: dict[str, object] = {}


def held(owner: str, build):
    """What build() made for owner in this process. One owner's state is kept at a time: Python workers serve every stage
    of a session in turn, and what an earlier stage has cached must not stay in memory beside the next one's."""
    if owner not in _STATE:
        _STATE.clear()
        _STATE[owner] = build()
    return _STATE[owner]


def drop_state(owner: str) -> None:
    """Let go of what other owners hold; owners begin with their module's name."""
    for k in [k for k in _STATE if not k.startswith(owner)]:
        del _STATE[k]


def annotate(df: DataFrame, column: str, fields: list[tuple[str, str]], make) -> DataFrame:
    """df with new columns: make(array of `column`) gives one Arrow array for each of fields, [(name, Spark type)].

    A narrow, Arrow-batched map: no shuffle, memory bounded by a batch. Where df has a column of a new name, the new one takes its place.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructField, StructType, _parse_datatype_string

    new = [StructField(n, _parse_datatype_string(t)) for n, t in fields]
    names = {n.lower() for n, _ in fields}
    kept = [f for f in df.schema.fields if f.name.lower() not in names]
    schema = StructType(kept + new)
    arrow = to_arrow_schema(StructType(new))
    kept_names = [f.name for f in kept]

    def run(batches):
        drop_state(make.__module__)
        for b in batches:
            out = make(b.column(column)) if b.num_rows else [pa.array([], f.type) for f in arrow]
            out = [x if isinstance(x, pa.Array) else pa.array(x) for x in out]
            arrays = [b.column(n) for n in kept_names] + [x.cast(f.type) if x.type != f.type else x for x, f in zip(out, arrow)]
            yield pa.RecordBatch.from_arrays(arrays, names=kept_names + [n for n, _ in fields])

    source = df if column in kept_names else df.withColumnRenamed(column, column)
    return source.mapInArrow(run, schema)


def kept_rows(docs: DataFrame, text: str, mark, condition: Column) -> DataFrame:
    """The rows of docs, as they are, whose marks meet a condition; mark(frame, text column) adds columns of any names."""
    names = [f"_{i}" for i in range(len(docs.columns))]
    plain = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)])
    found = mark(plain, names[docs.columns.index(text)]).filter(condition)
    return found.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names)])


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """Python gets batches of at most so many rows from what is planned within: for rows that hold several texts each."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def drop_table(spark: SparkSession, path: str) -> None:
    """Remove a table that written() made and nothing reads any more."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Seconds between Python's and the JVM's collections in release(), twice.
PAUSE = 0.25
_RELEASING: list[threading.Thread] = []


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished jobs that nothing refers to any more, beside what comes next.

    Python's references reach the JVM a moment after they end, so the collector is asked twice. One thread does so at a time.
    """

    def run():
        try:
            for _ in range(2):
                time.sleep(PAUSE)
                spark.sparkContext._jvm.System.gc()
                time.sleep(PAUSE)
        except (Py4JError, OSError, AttributeError):  # the session has ended, and its files with it
            pass

    for t in _RELEASING:
        t.join()
    gc.collect()
    _RELEASING[:] = [threading.Thread(target=run, daemon=True)]
    _RELEASING[0].start()
