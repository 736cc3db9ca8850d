"""Operator 3: token ids in training order, as fixed-stride binary shards.

Every text becomes its token ids and an end mark, cut into sequences of LENGTH ids, the last one padded. The sequences of
the corpus are numbered 0 .. n - 1 in the order of the input's partitions and rows, and a keyed Feistel permutation of
0 .. n - 1 with cycle-walking gives each its slot in the training order: a bijection that any task computes by itself,
without a sort or a table. Shard s holds slots s * PER_SHARD and up, each LENGTH little-endian unsigned 16-bit ids, so slot
k stands at byte (k % PER_SHARD) * LENGTH * 2 of shard k // PER_SHARD, and a reader can start or resume at any slot.

The input is read twice: once to count the sequences of each partition (one integer a partition goes to the driver), once
to send packed records to their shards' tasks. Ids are never stored but in the shards. A shard's task checks that every
slot of its range came once, writes under a name of its own and renames, so tasks that run again leave the same files.
The input should be a plain scan, as of written(): both readings must see the same partitions, and the check fails otherwise.

Tokens are those of a public vocabulary file (a parameter), encoded by tiktoken; the end mark and padding is PAD.

Defined results: a null text counts as an empty one, and has one sequence with the end mark alone. A text of any length
is taken whole. Repeated rows have sequences, and slots, of their own. A null key is written as null. An empty table
gives no shard. A reading that differs from the count fails the job.
"""

from __future__ import annotations

import base64
import json
import os
import zlib
from math import ceil

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martflow.llm.feistel import Feistel
from martflow.llm.shared import held as kept
from martflow.llm.shared import new_path, release, table, written

LENGTH = 512
PER_SHARD = 1 << 14
PAD = 50_256
KEY = 20240229
#: Records that a map task gathers before it sends them.
GATHERED = 1 << 14


class Tokens:
    """A byte-level vocabulary of tiktoken's file form, with ids below 2 ** 16."""

    def __init__(self, content: bytes):
        import public_tokenizers
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(text)


def _tokens(content: bytes) -> Tokens:
    return kept(f"{__name__} {zlib.crc32(content)}", lambda: Tokens(content))


def _record(length: int) -> np.dtype:
    return np.dtype([("at", "<u4"), ("ids_held", "<u4"), ("piece", "<u4"), ("named", "<u4"), ("key", "<i8"), ("ids", "<u2", (length,))])


def _texts(col: pa.Array):
    for i in range(0, len(col), 256):
        for t in col.slice(i, 256).to_pylist():
            yield t or ""


#: Hadoop's names of object stores, and Arrow's.
SCHEMES = {"s3a": "s3", "s3n": "s3", "gcs": "gs", "abfss": "abfs"}


def _uri(out: str) -> str:
    """A folder's URI as Arrow names it, from Hadoop's name or Arrow's; without a scheme it is a path of this machine."""
    scheme, mark, rest = out.partition("://")
    if not mark:
        return "file:///" + out.removeprefix("file:").lstrip("/")
    return f"{SCHEMES.get(scheme, scheme)}://{rest}"


def _store(out: str):
    """(file system, path) of a folder."""
    return fs.FileSystem.from_uri(_uri(out))


def _put(uri: str, name: str, data: bytes) -> None:
    """Write a file whole or not at all."""
    store, path = _store(uri)
    store.create_dir(path, recursive=True)
    part = f"{path}/.{name}.{os.getpid()}.{os.urandom(4).hex()}"
    with store.open_output_stream(part) as f:
        f.write(data)
    store.move(part, f"{path}/{name}")


def write_shards(
    docs: DataFrame, out: str, key: str = "doc_id", text: str = "text", path: str | None = None, length: int = LENGTH,
    per_shard: int = PER_SHARD, seed: int = KEY
) -> DataFrame:
    """Write docs' sequences under out and return (key, piece, n_ids, slot, shard, offset, crc32) of each of them.

    out is a path that Arrow's file systems and all executors reach; Hadoop's names (s3a://) are understood. out/index.json tells readers the shape.
    """
    spark = docs.sparkSession
    uri = os.fspath(out)
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        shipped = spark.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    record = _record(length)

    def count(batches):
        n = 0
        for b in batches:
            t = _tokens(shipped.value)
            n += sum((len(t.ids(x)) + length) // length for x in _texts(b.column("text")))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([n], pa.int64())], names=["part", "n"])

    counts = dict(map(tuple, rows.mapInArrow(count, "part int, n long").collect()))
    n = sum(counts.values())
    sizes = np.array([counts.get(p, 0) for p in range(max(counts, default=-1) + 1)], np.int64)
    firsts = spark.sparkContext.broadcast(np.cumsum(sizes) - sizes)  # one integer a partition
    shards = ceil(n / per_shard)
    _put(
        uri, "index.json",
        json.dumps({"sequences": n, "length": length, "per_shard": per_shard, "shards": shards, "dtype": "<u2", "pad": PAD, "key": seed}).encode()
    )

    def send(batches):
        order = Feistel(max(n, 1), seed)
        part = TaskContext.get().partitionId()
        start, held, gathered = int(firsts.value[part]) if part < len(firsts.value) else n, 0, []

        def sent():
            nonlocal start, held, gathered
            whole = np.concatenate(gathered)
            slot = order.permute(np.arange(start, start + held)).astype(np.int64)
            start, held, gathered = start + held, 0, []
            shard, whole["at"] = slot // per_shard, slot % per_shard
            by = np.argsort(shard, kind="stable")
            whole, shard = whole[by], shard[by]
            cut = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]])
            return pa.RecordBatch.from_arrays(
                [pa.array(shard[cut[:-1]], pa.int32()), pa.array([whole[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary())],
                names=["shard", "records"]
            )

        for b in batches:
            t = _tokens(shipped.value)
            for k, x in zip(b.column("key").to_pylist(), _texts(b.column("text"))):
                ids = t.ids(x)
                many = (len(ids) + length) // length
                r = np.zeros(many, record)
                body = np.full(many * length, PAD, "<u2")
                body[: len(ids)] = np.array(ids, "<u2")
                r["ids"] = body.reshape(many, length)
                r["piece"] = np.arange(many)
                r["ids_held"] = np.minimum(length, len(ids) + 1 - r["piece"] * length)
                r["key"], r["named"] = k or 0, k is not None
                gathered.append(r)
                held += many
                if held >= GATHERED:
                    yield sent()
        if held:
            yield sent()

    def write(batches):
        parts: dict[int, list] = {}
        for b in batches:
            for s, blob in zip(b.column("shard").to_pylist(), b.column("records")):
                parts.setdefault(s, []).append(np.frombuffer(blob.as_buffer(), record))
        for s in sorted(parts):
            r = np.concatenate(parts.pop(s))
            r = r[np.argsort(r["at"], kind="stable")]
            if not np.array_equal(r["at"], np.arange(min(per_shard, n - s * per_shard))):
                raise ValueError(f"the sequences of shard {s} are not those counted: the input changed between its two readings")
            body = np.ascontiguousarray(r["ids"])
            _put(uri, f"shard-{s:08d}.bin", body.tobytes())
            at = r["at"].astype(np.int64)
            sums = [zlib.crc32(x) for x in body]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(r["key"], mask=r["named"] == 0), pa.array(r["piece"].astype(np.int32)),
                    pa.array(r["ids_held"].astype(np.int32)), pa.array(at + s * per_shard), pa.array(np.full(len(r), s, np.int32)),
                    pa.array(at * length * 2), pa.array(sums, pa.int64())
                ],
                names=[key, "piece", "n_ids", "slot", "shard", "offset", "crc32"],
            )

    packed = rows.mapInArrow(send, "shard int, records binary")
    done = packed.repartitionById(max(1, shards), "shard").mapInArrow(write, f"{key} long, piece int, n_ids int, slot long, shard int, offset long, crc32 long")
    return written(done, "sequences")


def read_slots(out: str, start: int, n: int) -> np.ndarray:
    """Sequences start .. start + n - 1 of the training order: [n, length]."""
    out = os.fspath(out)
    store, path = _store(out)
    with store.open_input_stream(f"{path}/index.json") as f:
        shape = json.loads(f.read())
    n = max(0, min(n, shape["sequences"] - start))
    parts = [np.zeros((0, shape["length"]), "<u2")]
    while n:
        s, at = divmod(start, shape["per_shard"])
        now = min(n, shape["per_shard"] - at)
        with store.open_input_file(f"{path}/shard-{s:08d}.bin") as f:
            parts.append(np.frombuffer(f.read_at(now * shape["length"] * 2, at * shape["length"] * 2), "<u2").reshape(now, -1))
        start, n = start + now, n - now
    return np.concatenate(parts)


def op3_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = write_shards(table(spark, sf_dir, "documents"), new_path(spark, "shards"))
    release(spark)
    return out
