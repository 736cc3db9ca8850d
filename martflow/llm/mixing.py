"""Operator 10: mixing sources to target weights by a multivariate-hypergeometric splitting tree.

The words of a source, in a fixed order of its rows, form a stream of blocks of BLOCK words. A source's target gives
its quota: whole passes over all blocks, then a number of blocks of one more pass. A tree halves the output shards again
and again; at each node a multivariate-hypergeometric draw splits the node's exact quotas of all sources between its
halves, so every leaf (shard) holds a random yet exact part of each quota and the parts add up. A keyed permutation of
each source's blocks, one a pass, puts its draws in order; a shard takes the next run of that order, so draws are disjoint
within a pass. Within a shard, draws are ordered by a keyed hash.

Only sizes travel: the texts are read once to count words (a JVM expression), and again where texts are put out. A row's
place in its source's stream is a prefix sum in two levels, within buckets of about PER_BUCKET rows and over the bucket
totals, so that a source with a third of all rows is spread like any other. Rows alike, where they are more than a
bucket holds, have buckets of their own, as many as it takes: which of them stands where makes no difference. The driver
holds one row for each source, and the quotas by source and shard, at most MOST_QUOTAS of them: shards grow with the corpus.
Draws are exact at any size: below 10^9 blocks by numpy, above by rejection from the same distribution.

Targets: sources in code point order (null last) weigh WEIGHTS in turn and share `share` times all words by weight; a
source stops at `cap` times its own words, and what it leaves is shared by weight among the others until none is above.

Defined results: a null or empty text has size 0 and takes 0; a source without words has target 0; a null source is a
source of its own. A source's taken words differ from its target by at most BLOCK. Repeated rows are rows of their
own. Draws depend on the rows and SEED alone, so reruns agree.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from math import ceil, exp, lgamma, log, log1p, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from martflow.llm.feistel import Feistel
from martflow.llm.shared import BASE, LEFT, Scratch, drop_state, mix64, row_marks, table, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE, CAP = 1.5, 2.0
BLOCK = 32
SHARD_BLOCKS = 1 << 16
MOST_QUOTAS = 1 << 22
PER_BUCKET = 4096
SEED = 20240229
DRAWS = "array<struct<shard:int,place:long,pass:int,first:long,words:long>>"


def targets(sizes: list[int], weights: list[float], share: float = SHARE, cap: float = CAP) -> list[float]:
    """What each source gets of share * sum(sizes), by weight, none above cap times its size."""
    out = [0.0] * len(sizes)
    left, free = share * sum(sizes), [i for i, n in enumerate(sizes) if n > 0]
    while free:
        whole = sum(weights[i] for i in free)
        above = [i for i in free if left * weights[i] / whole > cap * sizes[i]]
        if not above:
            for i in free:
                out[i] = left * weights[i] / whole
            break
        for i in above:
            out[i] = cap * sizes[i]
        left -= sum(out[i] for i in above)
        free = [i for i in free if i not in set(above)]
    return out


def _stirling(n: float) -> float:
    """log(n!) less Stirling's approximation of it, n > 0."""
    if n < 16:
        return lgamma(n + 1) - (n + 0.5) * log(n) + n - 0.5 * log(2 * pi)
    m = 1 / (n * n)
    return (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - m / 1188) * m) * m) * m) / n


def _deviance(x: float, mean: float) -> float:
    """x log(x / mean) + mean - x, without cancellation where x is near mean."""
    if abs(x - mean) < 0.1 * (x + mean):
        v = (x - mean) / (x + mean)
        total, term, j = (x - mean) * v, 2 * x * v, 1
        while True:
            term *= v * v
            more = total + term / (2 * j + 1)
            if more == total:
                return total
            total, j = more, j + 1
    return (x * log(x / mean) if x > 0 else 0.0) + mean - x


def _log_binomial(x: int, n: int, p: float, q: float) -> float:
    """The logarithm of the binomial probability, as accurate at 10^15 as at 10 (saddle-point expansion)."""
    if x == 0:
        return n * log1p(-p) if p < 0.5 else n * log(q)
    if x == n:
        return n * log(p) if p < 0.5 else n * log1p(-q)
    out = _stirling(n) - _stirling(x) - _stirling(n - x) - _deviance(x, n * p) - _deviance(n - x, n * q)
    return out + 0.5 * log(n / (2 * pi * x * (n - x)))


def hypergeometric(good: int, bad: int, take: int, rng: np.random.Generator) -> int:
    """How many of `take` draws without return are good: exact at any size.

    Below 10^9 by numpy. Above, by rejection from a flat top with exponential tails, which lies over every log-concave
    distribution with the same mode; about three trials a draw. Probabilities are good to about 1e-12.
    """
    total = good + bad
    if total < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, take))
    low, high = max(0, take - bad), min(good, take)
    if low == high:
        return low
    p, q = take / total, (total - take) / total
    mass = lambda k: _log_binomial(k, good, p, q) + _log_binomial(take - k, bad, p, q)
    mode = min(max((take + 1) * (good + 1) // (total + 2), low), high)
    top = mass(mode)
    peak = exp(top - _log_binomial(take, total, p, q))
    width = 1 + peak / 2
    while True:
        u, w = rng.random(), rng.random()
        y = rng.random() * width / peak if u <= width / (1 + width) else (width + rng.standard_exponential()) / peak
        k = mode + (1 if rng.random() < 0.5 else -1) * round(y)
        if low <= k <= high and w * min(1.0, exp(width - peak * y)) <= exp(mass(k) - top):
            return k


def split(counts: np.ndarray, take: int, rng: np.random.Generator) -> np.ndarray:
    """A draw of `take` from an urn that holds counts, by kind: each kind's part in turn, given those before it."""
    total = int(counts.sum())
    if total < 1_000_000_000:
        return rng.multivariate_hypergeometric(counts, take, method="marginals")
    out = np.zeros_like(counts)
    for i, c in enumerate(counts.tolist()):
        out[i] = hypergeometric(c, total - c, take, rng)
        take -= int(out[i])
        total -= c
    return out


def tree(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """[sources, shards]: how many draws of each source go to each shard; shards are of equal size, or differ by one."""
    out = np.zeros((len(quotas), shards), np.int64)
    total = int(quotas.sum())
    edge = [total * i // shards for i in range(shards + 1)]
    todo = [(0, shards, quotas.astype(np.int64))]
    while todo:
        lo, hi, counts = todo.pop()
        if hi - lo == 1:
            out[:, lo] = counts
            continue
        mid = (lo + hi) // 2
        left = split(counts, edge[mid] - edge[lo], np.random.default_rng([seed, lo, hi]))
        todo += [(lo, mid, left), (mid, hi, counts - left)]
    return out


@dataclass
class Source:
    size: int
    target: float
    blocks: int
    passes: int
    extra: int
    number: int
    until: np.ndarray  # draws of the shards up to each


def _order(number: int, turn: int, blocks: int, seed: int) -> Feistel:
    """The order in which one pass over a source draws its blocks."""
    return Feistel(blocks, seed + 1_000_003 * number + turn)


def _extra(number: int, size: int, words: float, turn: int, blocks: int, block: int, seed: int) -> int:
    """How many blocks of the last, partial pass come nearest to `words`; the last block of the stream may be short."""
    if not blocks or words <= 0:
        return 0
    short, last = blocks * block - size, int(_order(number, turn, blocks, seed).permute([blocks - 1])[0])
    near = range(max(0, int(words // block) - 1), min(blocks, int(words // block) + 3) + 1)
    return min(near, key=lambda r: abs(r * block - short * (last < r) - words))


def plan_sources(
    rows: list[tuple[str | None, int]], weights=WEIGHTS, share: float = SHARE, cap: float = CAP, block: int = BLOCK, seed: int = SEED
) -> dict[str | None, Source]:
    """Targets, quotas and shards from (source, words) of every source."""
    order = sorted(rows, key=lambda r: (r[0] is None, (r[0] or "").encode()))
    sizes = [n for _, n in order]
    wanted = targets(sizes, [weights[i % len(weights)] for i in range(len(order))], share, cap)
    counts = [-(-n // block) for n in sizes]
    passes = [int(t // n) if n else 0 for n, t in zip(sizes, wanted)]
    extra = [_extra(i, n, t - p * n, p, b, block, seed) for i, (n, t, p, b) in enumerate(zip(sizes, wanted, passes, counts))]
    quotas = np.array([p * b + x for p, b, x in zip(passes, counts, extra)], np.int64)
    per = max(SHARD_BLOCKS, ceil(int(quotas.sum()) * max(len(order), 1) / MOST_QUOTAS))
    shards = max(1, ceil(int(quotas.sum()) / per))
    until = np.cumsum(tree(quotas, shards, seed), axis=1) if len(order) else np.zeros((0, 1), np.int64)
    return {s: Source(n, t, b, p, x, i, until[i]) for i, ((s, _), n, t, b, p, x) in enumerate(zip(order, sizes, wanted, counts, passes, extra))}


def _draws(sources: list[Source], which: np.ndarray, start: np.ndarray, size: np.ndarray, block: int, seed: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The draws that fall on words start .. start + size - 1 of each row's source: (row of each, the fields of DRAWS)."""
    first = start // block
    n = np.where(size > 0, (start + size - 1) // block - first + 1, 0)
    found: list[list[np.ndarray]] = []
    for i in np.unique(which):
        src, rows = sources[i], np.flatnonzero((which == i) & (n > 0))
        if not len(rows):
            continue
        row = np.repeat(rows, n[rows])
        j = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(n[rows]) - n[rows], n[rows])
        lo, hi = np.maximum(j * block, start[row]), np.minimum((j + 1) * block, start[row] + size[row])
        for p in range(src.passes + (src.extra > 0)):
            place = _order(src.number, p, src.blocks, seed).permute(j).astype(np.int64)
            d = slice(None) if p < src.passes else place < src.extra
            draw = p * src.blocks + place[d]
            key = (mix64(draw.astype(np.uint64) * BASE + np.uint64(seed + src.number)) >> np.uint64(1)).astype(np.int64)
            found.append([row[d], np.searchsorted(src.until, draw, "right"), key, np.full(len(draw), p), (lo - start[row])[d], (hi - lo)[d]])
    if not found:
        return np.zeros(0, np.int64), [np.zeros(0, np.int64)] * 5
    row, *fields = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((fields[3], fields[2], row))
    return row[order], [f[order] for f in fields]


def _named(source: str) -> Column:
    return F.when(F.col(source).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(source)))


def mix_plan(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, share: float = SHARE,
    cap: float = CAP, block: int = BLOCK, seed: int = SEED, scratch: Scratch | None = None
) -> DataFrame:
    """(key, m1, m2, size, source, source_size, target, taken, draws) of each row of docs; m1 and m2 are its row_marks.

    draws lists what the mixture takes of the row: output shard, sort key within it, pass, first word, words.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), _named(source).alias("name"), F.col(text).alias("t"), *row_marks(docs))
    counted = rows.select(
        "key", "name", F.coalesce(F.regexp_count("t", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("t").alias("mark"),
        "m1", "m2"
    )
    sized = (scratch.written if scratch else written)(counted.withColumn("no", F.monotonically_increasing_id()), "sizes")
    totals = [(r.name[1:] if r.name[0] == "+" else None, r.size) for r in sized.groupBy("name").agg(F.sum("size").alias("size")).collect()]
    sources = spark.sparkContext.broadcast(plan_sources(totals, weights, share, cap, block, seed))
    many = ceil(sized.count() / PER_BUCKET) or 1
    dealt = sized.withColumns({"bucket": F.pmod(F.xxhash64("key", "mark"), F.lit(many)), "part": F.lit(0).cast("long")})
    if (dealt.groupBy("bucket").count().agg(F.max("count").alias("n")).first().n or 0) > 2 * PER_BUCKET:
        # at most one group in PER_BUCKET rows is so large; it follows its bucket's other rows
        alike = dealt.groupBy("key", "mark", "name").agg(F.count("*").alias("copies")).filter(F.col("copies") > PER_BUCKET)
        parts = alike.select(
            F.struct("key").alias("k"), F.col("mark").alias("_mark"), F.col("name").alias("_name"),
            F.ceil(F.col("copies") / PER_BUCKET).alias("_parts")
        )
        hot = F.struct("key").eqNullSafe(F.col("k")) & (F.col("mark") == F.col("_mark")) & (F.col("name") == F.col("_name"))
        own = F.concat_ws(":", F.lpad(F.col("bucket").cast("string"), 19, "0"), F.hex("mark"), F.coalesce(F.col("key").cast("string"), F.lit("")))
        dealt = dealt.join(parts, hot, "left").select(*dealt.columns, "_parts")
        dealt = dealt.withColumns(
            {
                "part": F.coalesce(F.pmod("no", F.col("_parts")), F.lit(0).cast("long")),
                "bucket": F.when(F.col("_parts").isNull(), F.lpad(F.col("bucket").cast("string"), 19, "0")).otherwise(own)
            }
        ).drop("_parts")
    starts = dealt.groupBy("name", "bucket", "part").agg(F.sum("size").alias("n"))
    starts = starts.select("name", "bucket", "part", (F.sum("n").over(W.partitionBy("name").orderBy("bucket", "part")) - F.col("n")).alias("base"))
    inner = F.sum("size").over(
        W.partitionBy("name", "bucket", "part").orderBy("key", "mark", "m1", "m2").rowsBetween(W.unboundedPreceding, W.currentRow)
    ) - F.col("size")
    placed = dealt.withColumn("inner", inner).join(starts, ["name", "bucket", "part"]).select(
        "key", "mark", "name", "size", "m1", "m2", (F.col("base") + F.col("inner")).alias("start")
    )

    def run(batches):
        drop_state(__name__)
        known = list(sources.value.items())
        number = {s: i for i, (s, _) in enumerate(known)}
        plans = [x for _, x in known]
        fields = [("shard", pa.int32()), ("place", pa.int64()), ("pass", pa.int32()), ("first", pa.int64()), ("words", pa.int64())]
        for b in batches:
            if not b.num_rows:
                continue
            coded = b.column("name").dictionary_encode()
            names = [x[1:] if x[0] == "+" else None for x in coded.dictionary.to_pylist()]
            which = np.array([number[x] for x in names])[coded.indices.to_numpy()]
            row, columns = _draws(plans, which, b.column("start").to_numpy(), b.column("size").to_numpy(), block, seed)
            taken = np.bincount(row, columns[4], b.num_rows).astype(np.int64)
            struct = pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields)], fields=[pa.field(f, t) for f, t in fields])
            draws = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(b.num_rows + 1)), pa.int32()), struct)
            source = pa.array([known[i][0] for i in range(len(known))], pa.string()).take(pa.array(which))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("key"), b.column("m1"), b.column("m2"), b.column("size"), source,
                    pa.array(np.array([p.size for p in plans])[which]), pa.array(np.array([p.target for p in plans])[which]),
                    pa.array(taken), draws
                ],
                names=["key", "m1", "m2", "size", "source", "source_size", "target", "taken", "draws"],
            )

    kind = dict(docs.dtypes)[key]
    return placed.mapInArrow(
        run, f"key {kind}, m1 long, m2 long, size long, source string, source_size long, target double, taken long, draws {DRAWS}"
    ).withColumnRenamed("key", key)


def pieces(text: str, draws: list[dict]) -> list[str]:
    """What one pass takes of a text: runs of its words as they stand, joined by line breaks; the whole text as it is."""
    spans = [m.span() for m in re.finditer(WORD, text)]
    runs: list[list[int]] = []
    for d in sorted(draws, key=lambda d: d["first"]):
        if runs and runs[-1][1] == d["first"]:
            runs[-1][1] += d["words"]
        else:
            runs.append([d["first"], d["first"] + d["words"]])
    if runs == [[0, len(spans)]]:
        return [text]
    return [text[spans[a][0] : spans[b - 1][1]] for a, b in runs]


def mixture(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """The mixed corpus: docs' columns, one row for each pass that takes of a row, with text as taken, in shard order.

    Added columns: mix_shard and mix_place of the row's first draw; columns of docs with these names give way. The texts
    shuffle once, to their rows' draws. Rows alike in all columns share one text, sent once by each map task.
    """
    docs = docs.drop("mix_shard", "mix_place")
    names = [f"_{i}" for i in range(len(docs.columns))]
    plan = mix_plan(docs, key, text, source, **how).filter(F.size("draws") > 0).select("m1", "m2", "draws")
    m1, m2 = row_marks(docs)
    mine = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)], m1, m2)

    def one_a_task(batches):
        drop_state(__name__)
        seen: set[tuple[int, int]] = set()
        for b in batches:
            take = []
            for i, pair in enumerate(zip(b.column("m1").to_pylist(), b.column("m2").to_pylist())):
                if pair not in seen:
                    if len(seen) >= 1 << 20:
                        seen.clear()
                    seen.add(pair)
                    take.append(i)
            yield b.take(pa.array(take, pa.int64())) if len(take) < b.num_rows else b

    mine = mine.mapInArrow(one_a_task, mine.schema)
    mine = mine.withColumn("n", F.row_number().over(W.partitionBy("m1", "m2").orderBy(F.lit(0)))).filter("n = 1").drop("n")
    both = mine.join(plan, ["m1", "m2"]).drop("m1", "m2")
    both = both.select(*names, "draws", F.explode(F.array_distinct(F.transform("draws", lambda d: d["pass"]))).alias("mix_pass"))
    both = both.withColumn("draws", F.filter("draws", lambda d: d["pass"] == F.col("mix_pass")))
    both = both.withColumns({"mix_shard": F.col("draws")[0]["shard"], "mix_place": F.col("draws")[0]["place"]})
    where = docs.columns.index(text)

    def run(batches):
        for b in batches:
            kind = b.schema.field(where).type
            texts = pa.array(["\n".join(pieces(t, d)) for t, d in zip(b.column(where).to_pylist(), b.column("draws").to_pylist())], kind)
            yield b.set_column(where, b.schema.field(where), texts)

    cut = both.mapInArrow(run, both.schema)
    return cut.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names)], "mix_shard", "mix_place")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    plan = mix_plan(table(spark, sf_dir, "documents"), scratch=scratch)
    return scratch.result(plan.select("doc_id", "size", "source_size", "target", "taken"), "mixed")


def mixed_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the mixture of docs; a row for each pass over a row, its text as taken, n_chars of that text."""
    LEFT.append(Scratch(spark))
    return mixture(docs, scratch=LEFT[-1]).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)
