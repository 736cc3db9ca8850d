"""Operator 8: nearest neighbours by inner product with an adaptive dimension scan over probed lists.

Inner product becomes distance: with M the largest norm, a vector x gets one more coordinate sqrt(M^2 - |x|^2), a query
gets 0, and the nearest point is the one with the largest product. All are turned by one random rotation, after which any
leading part of the coordinates estimates the whole distance. Lists are the cells of k-means centres, about the square root
of the number of vectors, up to MOST_LISTS; every vector is assigned to a list. A query scans the lists nearest to it. How
many is fitted: the share that holds TARGET of the K nearest of held-out sample vectors. Within the sample neighbours are
further away, and more spread, than within all vectors, so the share errs to the safe side. A scan goes by blocks of BLOCK
coordinates: after d of D of them a candidate is abandoned if partial * D / d > bound * (1 + EPSILON / sqrt(d))^2, a test
of the hypothesis that its distance is within the bound, which is the query's 2 * K-th distance within the sample. What
survives all blocks is scored exactly, in double precision, on the original vectors.

The sample has SAMPLE vectors, or PER_LIST for each list where that is more: those least by a hash of the row, exactly so
many at any number of rows, a documented bound. Clustered vectors need few lists; vectors without any structure (equally
spread over a sphere) need half of them for a recall of 0.9, and then work grows with queries times vectors.

Neighbouring lists form bundles of about BUNDLE vectors, a longer list several; queries form turns of about TURN by the
bundle they lie in, a crowded bundle's several. A bundle meets a turn in one task group if any of its queries probes it;
a query travels once to such a bundle with the lists it probes there. So memory is bounded, and a vector that a third of
all rows repeat only makes more bundles. Each group returns at most K rows a query.

Defined results: rows with a null id, or a vector that is null, zero, of another length than most, or holds a null or
non-finite component, take no part. A query's own row, and any row of its id, is no candidate; of several query rows with one
id the least vector asks. Rows repeated among candidates each count. Fewer candidates than K give fewer rows.
"""

from __future__ import annotations

from math import ceil, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from martflow.llm.shared import Scratch, content_hash, table, threshold

K = 20
SAMPLE, PER_LIST = 16_384, 16
MOST_LISTS = 4096
TARGET, HELD_OUT = 0.95, 512
BLOCK = 16
EPSILON = 2.1
BUNDLE, TURN = 8192, 2048


class Index:
    """The rotation, the centres of the lists and the sample, as numpy arrays of bounded size."""

    def __init__(self, ids: np.ndarray, sample: np.ndarray, largest: float, lists: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.largest = largest
        d = sample.shape[1] + 1
        self.rotation = np.linalg.qr(rng.normal(size=(d, d)))[0]
        self.ids, self.sample = ids, self.stored(sample)
        self.centres = self._fit(lists, rng)
        self.cells = self.nearest(self.sample)
        self._plain = sample

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_plain"}

    def stored(self, x: np.ndarray) -> np.ndarray:
        extra = np.sqrt(np.maximum(self.largest - (x * x).sum(1), 0))
        return np.column_stack([x, extra]) @ self.rotation

    def asked(self, q: np.ndarray) -> np.ndarray:
        return np.column_stack([q, np.zeros(len(q))]) @ self.rotation

    def distances(self, x: np.ndarray, to: np.ndarray) -> np.ndarray:
        return np.maximum((x * x).sum(1)[:, None] + (to * to).sum(1) - 2 * (x @ to.T), 0)

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """The list of each stored vector."""
        parts = [self.distances(x[i : i + 1024], self.centres).argmin(1) for i in range(0, len(x), 1024)]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    def _fit(self, lists: int, rng) -> np.ndarray:
        s = self.sample
        self.centres = c = s[rng.choice(len(s), min(lists, len(s)), replace=False)]
        for _ in range(8):
            near = self.nearest(s)
            n = np.bincount(near, minlength=len(c))
            total = np.zeros_like(c)
            np.add.at(total, near, s)
            self.centres = c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
        # neighbouring lists get neighbouring numbers, along the direction in which the centres differ most
        middle = c - c.mean(0)
        return c[np.argsort(middle @ np.linalg.svd(middle, full_matrices=False)[2][0], kind="stable")]

    def fitted(self, k: int, target: float = TARGET, held_out: int = HELD_OUT) -> float:
        """The least share of the lists that holds `target` of the k nearest of held-out sample vectors."""
        n = len(self.sample)
        if n <= 2 * k:
            return 1.0
        at = np.random.default_rng(7).choice(n, min(held_out, n), replace=False)
        ranks = []
        for part in np.array_split(at, ceil(len(at) / 128)):
            q = self.asked(self._plain[part])
            d = self.distances(q, self.sample)
            d[self.ids[part][:, None] == self.ids[None, :]] = np.inf
            near = np.argpartition(d, k, axis=1)[:, :k]
            order = np.argsort(self.distances(q, self.centres), axis=1)
            rank = np.empty_like(order)
            np.put_along_axis(rank, order, np.broadcast_to(np.arange(order.shape[1]), order.shape), axis=1)
            ranks.append(np.take_along_axis(rank, self.cells[near], axis=1))
        return float(np.quantile(np.concatenate(ranks), target, method="higher") + 1) / len(self.centres)

    def probes(self, q: np.ndarray, held: np.ndarray, share: float, k: int) -> np.ndarray:
        """[queries, lists]: the share of lists nearest to each query, and as many more as it takes to hold 2 * k vectors."""
        order = np.argsort(self.distances(q, self.centres), axis=1)
        before = np.cumsum(held[order], axis=1) - held[order]
        first = np.arange(order.shape[1]) < max(1, ceil(share * order.shape[1]))
        out = np.zeros(order.shape, bool)
        np.put_along_axis(out, order, first | (before < 2 * k), axis=1)
        return out

    def bounds(self, q: np.ndarray, ids: np.ndarray, probed: np.ndarray, k: int) -> np.ndarray:
        """The 2 * k-th least distance of each query to the sample within its lists, without its own id; inf if there are fewer.

        A scan within this bound meets 2 * k vectors of the sample at least, so that the odd one it abandons wrongly
        leaves no query short of k.
        """
        d = self.distances(q, self.sample)
        d[(ids[:, None] == self.ids[None, :]) | ~probed[:, self.cells]] = np.inf
        return np.partition(d, 2 * k - 1, axis=1)[:, 2 * k - 1] if d.shape[1] >= 2 * k else np.full(len(q), np.inf)


def scan(q: np.ndarray, x: np.ndarray, bound: np.ndarray, block: int = BLOCK, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (query, candidate) that the adaptive scan does not abandon."""
    dims = q.shape[1]
    if np.isinf(bound).all():
        return tuple(a.ravel() for a in np.indices((len(q), len(x))))
    a, b = q[:, :block], x[:, :block]
    part = (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T)
    d = min(block, dims)
    limit = bound * (1 + epsilon / np.sqrt(d)) ** 2 * d / dims if d < dims else bound
    qi, xi = np.nonzero(part <= limit[:, None] + 1e-9)
    part = part[qi, xi]
    while d < dims:
        e = min(d + block, dims)
        part = part + ((q[qi, d:e] - x[xi, d:e]) ** 2).sum(1)
        d = e
        limit = bound * (1 + epsilon / np.sqrt(d)) ** 2 * d / dims if d < dims else bound * (1 + 1e-9)
        stay = part <= limit[qi] + 1e-9
        qi, xi, part = qi[stay], xi[stay], part[stay]
    return qi, xi


def bundled(lengths: list[int], most: int) -> tuple[np.ndarray, np.ndarray]:
    """(first bundle, bundles) of each list: consecutive lists share a bundle of up to `most` vectors, a longer list has several."""
    first, count = np.zeros(len(lengths), np.int64), np.ones(len(lengths), np.int64)
    now, held = 0, 0
    for c, n in enumerate(lengths):
        if held and held + n > most:
            now, held = now + 1, 0
        first[c] = now
        if n > most:
            count[c] = -(-n // most)
            now, held = now + int(count[c]), 0
        else:
            held += n
    return first, count


def _matrix(col) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), -1)


def nearest(vectors: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K, probed: float | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates among vectors with the largest inner product with each query.

    probed: the share of the lists that a query scans; fitted where it is not given.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession)
    good = F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall(
        "v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    ) & F.exists("v", lambda x: x != 0)
    take = lambda df: df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter(good)
    rows = take(vectors).withColumn("h", content_hash("id", "v"))
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    shapes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.approx_count_distinct("h").alias("u"), F.max(norm).alias("m"))
    most = shapes.orderBy(F.desc("n"), "d").limit(1).collect()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not most:
        return empty
    dims, n, unlike, largest = most[0]
    right = F.size("v") == dims
    rows = rows.filter(right)
    asking = take(queries).filter(right).groupBy("id").agg(F.min("v").alias("v"))
    lists = max(1, min(MOST_LISTS, isqrt(n)))
    size = max(SAMPLE, PER_LIST * lists)
    picked = rows.filter(F.col("h") <= F.lit(threshold(unlike, size))).dropDuplicates(["h"])
    got = picked.orderBy("h").limit(size).toArrow()
    order = np.argsort(ids := got.column("id").to_numpy(), kind="stable")
    index = Index(ids[order], _matrix(got.column("v"))[order], largest, max(1, min(lists, got.num_rows // 8)))
    share = index.fitted(k) if probed is None else probed
    shipped = spark.sparkContext.broadcast(index)

    def assign(batches):
        for b in batches:
            if b.num_rows:
                near = shipped.value.nearest(shipped.value.stored(_matrix(b.column("v"))))
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(near, pa.int32())], names=["id", "v", "cell"])

    # the number of a row deals out a list that is longer than a bundle, whatever its rows hold
    stored = scratch.written(
        rows.select("id", "v").mapInArrow(assign, "id long, v array<double>, cell int").withColumn("no", F.monotonically_increasing_id()),
        "lists"
    )
    cells = len(index.centres)
    held = {r.cell: r.n for r in stored.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    lengths = np.array([held.get(c, 0) for c in range(cells)])
    first, count = bundled(lengths.tolist(), BUNDLE)

    def probe(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, 128):
                b, ix = whole.slice(i, 128), shipped.value
                q = ix.asked(_matrix(b.column("v")))
                near = ix.probes(q, lengths, share, k)
                bound = ix.bounds(q, b.column("id").to_numpy(), near, k)
                home = first[ix.distances(q, ix.centres).argmin(1)]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("id"), b.column("v"), pa.array(bound), pa.array(home, pa.int32()),
                        pa.array([np.flatnonzero(x).astype(np.int32) for x in near], pa.list_(pa.int32()))
                    ],
                    names=["id", "v", "bound", "home", "cells"]
                )

    asked = scratch.written(asking.mapInArrow(probe, "id long, v array<double>, bound double, home int, cells array<int>"), "probes")
    turns = {r.home: ceil(r.n / TURN) for r in asked.groupBy("home").agg(F.count("*").alias("n")).collect()}

    def spread(batches):
        """A row for each bundle in which a query probes lists, with those lists."""
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                b = whole.slice(i, 256)
                at, bundle, lists = [], [], []
                for j, probed_cells in enumerate(b.column("cells").to_pylist()):
                    by: dict[int, list[int]] = {}
                    for c in probed_cells:
                        for x in range(first[c], first[c] + count[c]):
                            by.setdefault(x, []).append(c)
                    at += [j] * len(by)
                    bundle += by
                    lists += by.values()
                if at:
                    part = b.select(["id", "v", "bound", "home"]).take(pa.array(at))
                    yield pa.RecordBatch.from_arrays(
                        [*part.columns, pa.array(bundle, pa.int32()), pa.array(lists, pa.list_(pa.int32()))],
                        names=["id", "v", "bound", "home", "bundle", "cells"]
                    )

    several = F.get(F.lit([turns.get(h, 1) for h in range(int((first + count).max()))]).cast("array<int>"), F.col("home"))
    ask = asked.mapInArrow(spread, "id long, v array<double>, bound double, home int, bundle int, cells array<int>")
    ask = ask.withColumn("turn", F.struct("home", F.pmod(F.xxhash64("id"), several).cast("int").alias("part"))).drop("home")
    meet = ask.select(F.col("bundle").alias("at"), F.col("turn").alias("met")).distinct()
    of = lambda values: F.get(F.lit(values.tolist()).cast("array<bigint>"), F.col("cell"))
    left = stored.withColumn(
        "bundle", (of(first) + F.pmod(F.col("no"), of(count))).cast("int")
    ).drop("no").join(meet, F.col("bundle") == F.col("at")).drop("at")

    def scanned(x: pa.Table, q: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not x.num_rows or not q.num_rows:
            return schema.empty_table()
        ix = shipped.value
        xs, qs, xid, qid, bound = _matrix(x.column("v")), _matrix(q.column("v")), x.column("id").to_numpy(), q.column("id").to_numpy(), q.column("bound").to_numpy()
        turned, cell = ix.stored(xs), x.column("cell").to_numpy()
        lists = q.column("cells").combine_chunks()
        probing = np.repeat(np.arange(len(qs)), lists.value_lengths().to_numpy())
        probes = lists.flatten().to_numpy()
        out = []
        here = [(np.flatnonzero(cell == c), np.sort(probing[probes == c])) for c in np.unique(cell)]
        for i in range(0, len(qs), 256):
            pairs = []
            whole = ix.asked(qs[i : i + 256])
            for xi_of, qi_of in here:
                mine = qi_of[(qi_of >= i) & (qi_of < i + 256)]
                if len(mine) and len(xi_of):
                    qi, xi = scan(whole[mine - i], turned[xi_of], bound[mine])
                    pairs.append((mine[qi], xi_of[xi]))
            if not pairs:
                continue
            qi, xi = (np.concatenate(p) for p in zip(*pairs))
            other = qid[qi] != xid[xi]
            qi, xi = qi[other], xi[other]
            score = (qs[qi] * xs[xi]).sum(1)
            order = np.lexsort((xid[xi], -score, qi))
            qi, xi, score = qi[order], xi[order], score[order]
            best = np.arange(len(qi)) - np.searchsorted(qi, qi) < k
            out.append(pa.table([qid[qi[best]], xid[xi[best]], score[best]], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    found = left.groupBy("bundle", "met").cogroup(ask.groupBy("bundle", "turn")).applyInArrow(scanned, "query_id long, vec_id long, score double")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scratch.result(
        found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"),
        "neighbours"
    )


def op8_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.filter(F.col("vec_id") % 20 == 0))
