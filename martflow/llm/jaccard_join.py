"""Operator 4: exact Jaccard self-join of word n-gram sets by PartEnum signatures, and its connected components.

A text's set holds the 64-bit hashes of its word n-grams. Equal sets are one class, known by a 128-bit fingerprint; copies of any number cost one class. Sizes fall into bands so that two sets that link lie in the same band
or in neighbouring ones; a set takes part in its own band and in the next. Within a band with largest size r, sets that
link differ in at most k = floor(2 r (1 - t) / (1 + t)) elements. The element domain is cut into n1 parts of N2 pieces by
a hash. At most k elements differ, so at least SLACK + 1 of the n1 parts have at most one piece that differs, and the
subset that leaves this piece out agrees. Every subset of N2 - 1 pieces of every part is thus a signature of the set:
(band, part, piece left out, sum of the hashes in the other pieces). A set then leaves out its SLACK least signatures, by
(elements covered, hash): two sets that link share SLACK + 1 signatures, and the greatest of those cannot be among the
SLACK least of either. So hardly any signature covers next to nothing, and no link is lost.

Signatures travel packed: a map task sends each fine range of hashes one array, not a row for each signature. Fine ranges
hold about RANGE signatures each, however many texts there are; a task takes a run of them, sorted by Spark, and holds one
at a time. It finds hashes that several classes share, and returns their classes as buckets, each distinct bucket once.
  1. Every class is compared with the most central class that leads one of its buckets (one pair a class). The text of a
     class travels once, to its leader's group; a leader with many followers is dealt to several groups.
  2. Components of these links close most buckets: a pair within one component needs no comparison, it cannot change the
     result. Among the classes of buckets that still hold several components, pairs that share an element of their
     prefixes, rare elements first, and have different components are compared.
Compared sets are exact; a pair links when 100 * intersection >= percent * union. Only texts of classes in a bucket are
fetched: a bitmap of their ids and classes, sized by their number up to MOST_BITS, spares the others their way to a join;
what it lets through too much costs time, not correctness.

Defined results: a null or empty text, or one of white space only, has an empty set, links with nothing and is its own
component. A text with fewer words than n has its whole word sequence as its only element. Repeated rows form a class
like any copies. A row with a null doc_id takes part like any other; null is a component id only where the whole component
has no other. Texts are worked on whole. Classes are known by 128 bits and elements by 64: at 5e10 texts the chance that any
two classes fall together is below 1e-17.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martflow.llm.components import components
from martflow.llm.shared import BASE, Scratch, Words, annotate, drop_state, mix64, release, row_marks, small_batches, spread_join, table, text_blocks, windows

N2 = 3
#: Packed signatures (11 bytes each) that a map task gathers before it sends them.
GATHERED = 1 << 19
#: Signatures of a fine range; a task holds one range at a time.
RANGE = 1 << 20
#: Tasks, of one fine range each; where there are more ranges, a task goes through several.
MOST_TASKS = 1 << 15
#: Bits for each entry of the bitmap of wanted texts, and its largest size (128 MB).
BITS_EACH, MOST_BITS = 8, 1 << 30
#: Followers of a leader that are compared in one group.
FOLLOWERS = 256
#: Counters of the sketch that orders elements from rare to common.
COUNTERS = 1 << 19
#: A signature as it travels: the lower 48 bits of its hash (its range holds upper ones) and 40 of its class.
#: Classes with the same 40 bits are all looked up again, so that a bucket may name one too many but never one too few.
SENT = np.dtype([("low", "<u4"), ("high", "<u2"), ("class_low", "<u4"), ("class_high", "u1")])
_SHORT = (1 << 40) - 1
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20


def shingles(raw: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(element hashes, row of each) of a block of rows: distinct within a row, rows in order, hashes in order within."""
    w = Words(raw, offsets)
    h = w.hashes(_FOLD)
    g, at = windows(h, w.row, n)
    row = w.row[at]
    few = np.flatnonzero((w.n > 0) & (w.n < n))
    if len(few):
        acc = np.zeros(len(few), np.uint64)
        for j in range(n - 1):
            has = w.n[few] > j
            acc[has] = acc[has] * BASE + h[w.first[few[has]] + j]
        g, row = np.concatenate([g, mix64(acc + w.n[few].astype(np.uint64))]), np.concatenate([row, few])
    salt = mix64(np.arange(1, len(w.n) + 1, dtype=np.uint64) * BASE)
    _, first = np.unique(g + salt[row], return_index=True)
    g, row = g[first], row[first]
    order = np.lexsort((g, row))
    return g[order], row[order]


class Bands:
    """Bands of set sizes for a threshold in percent: band t holds sizes start[t] .. start[t + 1] - 1."""

    def __init__(self, percent: int, most: int):
        start = [1]
        while start[-1] <= most:
            start.append(start[-1] * 100 // percent + 1)
        start.append(start[-1] * 100 // percent + 1)
        start.append(start[-1] * 100 // percent + 1)
        self.start = np.array(start)
        largest = self.start[1:] - 1
        self.k = 2 * largest * (100 - percent) // (100 + percent)
        parts = self.k // 2 + 1  # at most floor(k / 2) parts have two pieces or more that differ
        self.slack = np.select([parts < 4, parts < 16, parts < 40], [0, 1, 2], 3 + parts // 40)
        self.parts = np.where(self.k == 0, 0, parts + self.slack)  # without differences, only equal sets link

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.start, sizes, "right") - 1


def signatures(g: np.ndarray, row: np.ndarray, rows: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(signature hashes, row of each) of the sets of a block."""
    sizes = np.bincount(row, minlength=rows)
    if not len(g):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    bands = Bands(percent, int(sizes.max()))
    out, at = [], []
    low, high = (g & np.uint64(0xFFFFFFFF)).astype(np.float64), (g >> np.uint64(32)).astype(np.float64)
    place = mix64(g ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(11)
    for next_band in (0, 1):
        band = np.maximum(bands.of(sizes), 0) + next_band
        parts = np.where(sizes > 0, bands.parts[band], 0)
        used = parts[row] > 0
        if not used.any():
            continue
        base = np.cumsum(parts * N2) - parts * N2
        total = int((parts * N2).sum())
        bins = base[row[used]] + (place[used] % (parts * N2)[row[used]].astype(np.uint64)).astype(np.int64)
        count = np.bincount(bins, minlength=total).reshape(-1, N2)
        s = np.bincount(bins, low[used], total).astype(np.uint64) + (np.bincount(bins, high[used], total).astype(np.uint64) << np.uint64(32))
        s = s.reshape(-1, N2)
        covered = count.sum(1, keepdims=True) - count
        s = s.sum(1, keepdims=True, dtype=np.uint64) - s
        of_part = np.repeat(np.arange(rows), parts)
        part = np.arange(len(of_part)) - np.repeat(np.cumsum(parts) - parts, parts)
        tag = (band[of_part].astype(np.uint64) << np.uint64(40)) + part.astype(np.uint64) * np.uint64(N2)
        tag = tag[:, None] + np.arange(N2, dtype=np.uint64)
        sig = mix64(s + mix64(tag + covered.astype(np.uint64) * BASE)).ravel()
        owner, covered = np.repeat(of_part, N2), covered.ravel()
        key = (owner.astype(np.uint64) << np.uint64(44)) | (np.minimum(covered, 4095).astype(np.uint64) << np.uint64(32)) | (sig >> np.uint64(32))
        order = np.argsort(key, kind="stable")
        n_sig = parts * N2
        rank = np.arange(total) - np.repeat(np.cumsum(n_sig) - n_sig, n_sig)
        keep = order[rank >= bands.slack[band][owner[order]]]
        out.append(sig[keep])
        at.append(owner[keep])
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(at)


def fingerprints(g: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(set size, class as two 64-bit integers) of each row; rows without elements have size 0."""
    sizes = np.bincount(row, minlength=rows)
    fp = np.zeros((rows, 2), np.uint64)
    some = sizes > 0
    if some.any():
        first = (np.cumsum(sizes) - sizes)[some]
        for i, salt in enumerate((np.uint64(0), np.uint64(0xA0761D6478BD642F))):
            fp[some, i] = mix64(np.add.reduceat(mix64(g ^ salt), first) + sizes[some].astype(np.uint64) * BASE)
    return sizes, fp


def _class_column(fp: np.ndarray, none: np.ndarray) -> pa.Array:
    """Classes as Arrow binaries of 16 bytes; null where none."""
    offsets = np.arange(len(fp) + 1, dtype=np.int32) * 16
    valid = pa.py_buffer(np.packbits(~none, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.binary(), len(fp), [valid, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(fp))])


def _short(fp: np.ndarray) -> np.ndarray:
    return (fp[:, 0] & np.uint64(_SHORT)).astype(np.int64)


def _classes(docs: DataFrame, text: str, n: int) -> DataFrame:
    """docs with n_shingles, class and short, the lower 40 bits of its first half."""

    def make(col: pa.Array):
        sizes, fps = [], []
        for i, j, raw, off in text_blocks(col):
            a, b = fingerprints(*shingles(raw, off, n), j - i)
            sizes.append(a)
            fps.append(b)
        sizes, fps = np.concatenate(sizes), np.concatenate(fps)
        return [sizes, _class_column(fps, sizes == 0), _short(fps)]

    return annotate(docs, text, [("n_shingles", "long"), ("class", "binary"), ("short", "long")], make)


class _Seen:
    """The classes that a task has met lately; forgotten as a whole when there are too many, so memory is bounded."""

    def __init__(self, most: int = 1 << 20):
        self.most, self.held = most, set()

    def new(self, fp: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(fp), bool)
        for x in np.flatnonzero(sizes):
            if (c := fp[x].tobytes()) not in self.held:
                if len(self.held) >= self.most:
                    self.held.clear()
                self.held.add(c)
                out[x] = True
        return out


def _packed(docs: DataFrame, text: str, n: int, percent: int, fine: int) -> DataFrame:
    """(fine, packed): signatures and classes of a map task, by fine range of signature hashes; a class once a task."""

    def run(batches):
        drop_state(__name__)
        seen = _Seen()
        sigs, fps, held = [], [], 0

        def sent():
            s, f = np.concatenate(sigs), np.concatenate(fps)
            order = np.argsort(s)
            s, f = s[order], f[order]
            # the upper half of the hash times the number of ranges, without overflow
            r = ((s >> np.uint64(32)) * np.uint64(fine) >> np.uint64(32)).astype(np.int64)
            cut = np.flatnonzero(np.diff(r)) + 1
            begin, end = np.concatenate([[0], cut]), np.concatenate([cut, [len(s)]])
            rec = np.empty(len(s), SENT)
            rec["low"], rec["high"] = s.astype(np.uint32), (s >> np.uint64(32)).astype(np.uint16)
            rec["class_low"], rec["class_high"] = f.astype(np.uint32), (f >> 32).astype(np.uint8)
            blobs = [rec[a:b].tobytes() for a, b in zip(begin, end)]
            return pa.RecordBatch.from_arrays([pa.array(r[begin], pa.int32()), pa.array(blobs, pa.binary())], names=["fine", "packed"])

        for b in batches:
            for i, j, raw, off in text_blocks(b.column(text)):
                g, row = shingles(raw, off, n)
                sizes, fp = fingerprints(g, row, j - i)
                take = seen.new(fp, sizes)[row]
                s, at = signatures(g[take], row[take], j - i, percent)
                if len(s):
                    sigs.append(s)
                    fps.append(_short(fp)[at])
                    held += len(s)
                if held >= GATHERED:
                    yield sent()
                    sigs, fps, held = [], [], 0
        if held:
            yield sent()

    return docs.select(text).mapInArrow(run, "fine int, packed binary")


def _shared(s: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, class) of the hashes s that several of the classes f share, each distinct set of classes once."""
    order = np.argsort(s)
    s, f = s[order], f[order]
    several = np.zeros(len(s), bool)
    same = s[1:] == s[:-1]
    several[1:] |= same
    several[:-1] |= same
    s, f = s[several], f[several]
    order = np.lexsort((f, s))
    s, f = s[order], f[order]
    once = np.ones(len(s), bool)
    once[1:] = (s[1:] != s[:-1]) | (f[1:] != f[:-1])  # a class sent by several map tasks
    s, f = s[once], f[once]
    if not len(s):
        return np.zeros(0, np.int64), f
    begin = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    n = np.diff(np.append(begin, len(s)))
    name = mix64(np.add.reduceat(mix64(f.astype(np.uint64)), begin)) + n.astype(np.uint64)
    keep = np.zeros(len(begin), bool)
    keep[np.unique(name, return_index=True)[1]] = True
    keep &= n > 1
    member = np.repeat(keep, n)
    return np.repeat(name, n)[member].astype(np.int64), f[member]


def _buckets(packed: DataFrame, tasks: int, each: int) -> DataFrame:
    """(bucket, short): the classes (40 bits of each) that share a signature, each distinct bucket of a fine range once."""

    def run(batches):
        drop_state(__name__)
        blobs: list[np.ndarray] = []
        now = None

        def found():
            rec = np.concatenate(blobs)
            blobs.clear()
            s = rec["low"] + (rec["high"].astype(np.uint64) << np.uint64(32))
            bucket, f = _shared(s, (rec["class_low"] + (rec["class_high"].astype(np.uint64) << np.uint64(32))).astype(np.int64))
            for i in range(0, len(f), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + (1 << 17)]) for x in (bucket, f)], names=["bucket", "short"])

        for b in batches:
            for r, blob in zip(b.column("fine").to_pylist(), b.column("packed")):
                if r != now and blobs:
                    yield from found()
                now = r
                blobs.append(np.frombuffer(blob.as_buffer(), SENT).copy())
        if blobs:
            yield from found()

    dealt = packed.repartitionById(tasks, F.floor(F.col("fine") / each).cast("int"))
    return dealt.sortWithinPartitions("fine").mapInArrow(run, "bucket long, short long")


def _folded(parts: DataFrame, column: str, none: np.ndarray, fold, fan: int = 16) -> np.ndarray:
    """The arrays in a binary column, one a task, of the kind and length of `none`, folded into one: by `fan` at each level."""
    kind = none.dtype

    def run(batches):
        whole = None
        for b in batches:
            for blob in b.column(0):
                part = np.frombuffer(blob.as_buffer(), kind)
                whole = part.copy() if whole is None else fold(whole, part, out=whole)
        if whole is not None:
            yield pa.RecordBatch.from_arrays([pa.array([whole.tobytes()], pa.binary())], names=[column])

    n = parts.rdd.getNumPartitions()
    while n > fan:
        n = -(-n // fan)
        parts = parts.repartition(n).mapInArrow(run, f"{column} binary")
    whole = none.copy()
    for r in parts.collect():
        fold(whole, np.frombuffer(r[0], kind), out=whole)
    return whole


def _bitmap(slots: DataFrame, bits: int) -> np.ndarray:
    """The bitmap (packed) of a column of slots below bits: each task makes one slice of it."""
    width = max(1 << 16, bits >> 8)

    def run(batches):
        whole: dict[int, np.ndarray] = {}
        for b in batches:
            at = b.column("slot").to_numpy()
            for part in np.unique(at // width):
                whole.setdefault(int(part), np.zeros(width, bool))[at[at // width == part] % width] = True
        if whole:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(whole), pa.int32()), pa.array([np.packbits(x).tobytes() for x in whole.values()], pa.binary())],
                names=["part", "bits"]
            )

    slices = -(-bits // width)
    parts = slots.repartitionById(slices, F.floor(F.col("slot") / width).cast("int")).mapInArrow(run, "part int, bits binary")
    out = np.zeros(slices * width // 8, np.uint8)
    for r in parts.collect():
        out[r.part * width // 8 : (r.part + 1) * width // 8] = np.frombuffer(r.bits, np.uint8)
    return out


def _fetched(rows: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """wanted (class, short, head, ...) with the text of each class, from rows (id, text).

    The bitmap holds the heads' ids and the classes. A row with an id passes by it, a row without one is looked at; of
    those, rows whose class passes too travel, one a class and task.
    """
    spark = rows.sparkSession
    bits = 1 << 16
    while bits < min(MOST_BITS, 2 * BITS_EACH * wanted.count()):
        bits *= 2
    of_id = F.pmod(F.xxhash64("id"), F.lit(bits)).alias("slot")
    slots = wanted.filter("head is not null").select(F.col("head").alias("id")).select(of_id).union(wanted.select((F.col("short") % bits).alias("slot")))
    shipped = spark.sparkContext.broadcast(_bitmap(slots, bits))

    def held(at: np.ndarray) -> np.ndarray:
        return (shipped.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1

    def passing(batches):
        drop_state(__name__)
        seen = _Seen()
        for b in batches:
            at = b.column("slot")
            texts = b.column("text").filter(pa.array(held(at.fill_null(0).to_numpy(zero_copy_only=False)) | at.is_null().to_numpy(zero_copy_only=False)))
            for i, j, raw, off in text_blocks(texts):
                sizes, fp = fingerprints(*shingles(raw, off, n), j - i)
                take = np.flatnonzero(seen.new(fp, sizes) & held(_short(fp) % bits))
                if len(take):
                    yield pa.RecordBatch.from_arrays(
                        [_class_column(fp[take], np.zeros(len(take), bool)), texts.slice(i, j - i).take(pa.array(take))],
                        names=["class", "text"]
                    )

    found = rows.select(F.when(F.col("id").isNotNull(), of_id).alias("slot"), "text").mapInArrow(passing, "class binary, text string")
    return found.join(wanted, "class").dropDuplicates(["class"])


def _nearest(buckets: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b): each class a with the most central other class b that leads one of its buckets.

    Centrality is the number of fellows over all buckets, so the text that a group of near copies was made from leads.
    """
    rows = buckets.count()
    sizes = buckets.groupBy("bucket").agg(F.count("*").alias("n"))
    central = spread_join(buckets, sizes, "bucket", rows=rows).groupBy("class").agg(F.sum("n").alias("rank"))
    ranked = scratch.written(buckets.join(central, "class").select("bucket", "class", "rank"), "ranked")
    lead = ranked.groupBy("bucket").agg(F.max(F.struct("rank", "class")).alias("lead"))
    own = spread_join(ranked, lead, "bucket", rows=rows).filter(F.col("lead.class") != F.col("class"))
    out = scratch.written(own.groupBy(F.col("class").alias("a")).agg(F.max("lead").alias("lead")).select("a", F.col("lead.class").alias("b")), "nearest")
    scratch.free(ranked)
    return out


def _crossing(opened: DataFrame, n: int, percent: int, scratch: Scratch) -> DataFrame:
    """(a, b): the pairs of numbers in opened (no, root, text) whose classes may link and have different roots.

    Two sets that link share an element within their first size - ceil(percent * size / 100) + 1 in any one order of all
    elements. An element counts only where enough of both sets comes after it. The order is from rare to common by a
    sketch of COUNTERS counters, so that what near copies that do not link have in common comes last. The sketch's size is
    fixed; however full it is, the order stays one order.
    """
    spark = opened.sparkSession

    def count(batches):
        c = np.zeros(COUNTERS, np.int64)
        for b in batches:
            for _, _, raw, off in text_blocks(b.column("text")):
                c += np.bincount((shingles(raw, off, n)[0] % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary())], names=["n"])

    whole = _folded(opened.select("text").mapInArrow(count, "n binary"), "n", np.zeros(COUNTERS, np.int64), np.add)
    shipped = spark.sparkContext.broadcast(np.minimum(whole, 2**31 - 1).astype(np.int32))

    def first(batches):
        for b in batches:
            for i, j, raw, off in text_blocks(b.column("text")):
                g, row = shingles(raw, off, n)
                order = np.lexsort((g, shipped.value[(g % np.uint64(COUNTERS)).astype(np.int64)], row))
                g, row = g[order], row[order]
                size = np.bincount(row, minlength=j - i)
                place = np.arange(len(g)) - (np.cumsum(size) - size)[row]
                keep = place < (size - -(-percent * size // 100) + 1)[row]
                row, columns = row[keep], (g[keep].astype(np.int64), size[row[keep]], place[keep])
                own = b.slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [own.column(c).take(pa.array(row)) for c in ("no", "root")] + [pa.array(c) for c in columns],
                    names=["no", "root", "element", "n", "at"]
                )

    prefixes = opened.select("no", F.xxhash64("root").alias("root"), "text").mapInArrow(first, "no long, root long, element long, n long, at long")
    every = scratch.written(prefixes, "prefixes")
    shared = every.groupBy("element").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("element")
    rows = scratch.written(every.join(shared, "element", "left_semi"), "prefixes")
    scratch.free(every)
    x = rows.select("element", F.col("no").alias("x"), F.col("root").alias("rx"), F.col("n").alias("nx"), F.col("at").alias("ax"))
    y = rows.select("element", F.col("no").alias("y"), F.col("root").alias("ry"), F.col("n").alias("ny"), F.col("at").alias("ay"))
    # at the first element that two sets share, what follows in either must still hold the whole overlap that a link needs
    near = (100 + percent) * F.least(F.col("nx") - F.col("ax"), F.col("ny") - F.col("ay")) >= percent * (F.col("nx") + F.col("ny"))
    pairs = x.join(y, "element").filter((F.col("rx") < F.col("ry")) & near).select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()
    pairs = scratch.written(pairs, "pairs")
    scratch.free(rows)
    return pairs


def _linked(pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """(a, b) of the rows (a, b, x, y) whose texts x and y have sets that link."""

    def sets(col: pa.Array) -> list[np.ndarray]:
        out = []
        for i, j, raw, off in text_blocks(col):
            g, row = shingles(raw, off, n)
            cut = np.searchsorted(row, np.arange(j - i + 1))
            out += [g[a:b] for a, b in zip(cut[:-1], cut[1:])]
        return out

    def links(p: np.ndarray, q: np.ndarray) -> bool:
        if len(p) > len(q):
            p, q = q, p
        if not len(p) or 100 * len(p) < percent * len(q):
            return False
        common = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum())
        return 100 * common >= percent * (len(p) + len(q) - common)

    def run(batches):
        drop_state(__name__)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                codes = b.column("b").dictionary_encode().indices.to_numpy()
                first = np.unique(codes, return_index=True)[1]  # a leader's text once
                ys = sets(b.column("y").take(pa.array(first)))
                keep = [links(p, ys[c]) for p, c in zip(sets(b.column("x")), codes)]
                yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    kind = dict(pairs.dtypes)["a"]
    return pairs.select("a", "b", "x", "y").mapInArrow(run, f"a {kind}, b {kind}")


def _components(docs: DataFrame, n: int, percent: int, key: str, text: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(id, n_shingles, class, mark) of each row of docs, and (class, root, head, mark, rows, component) of each class.

    head is the smallest id of a class, mark the smallest row_marks of the rows with both; component is the smallest id of
    all classes with its root.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), F.struct(*row_marks(docs)).alias("mark"))
    written = scratch.written
    sized = written(_classes(rows, "text", n).drop("text"), "classes")
    least = F.min(F.struct(F.col("id").isNull().alias("no"), "id", "mark")).alias("h")
    heads = sized.filter(F.col("class").isNotNull()).groupBy("class").agg(
        least, F.min("short").alias("short"), F.min("n_shingles").alias("n"), F.count("*").alias("rows")
    )
    heads = written(heads.select("class", "short", "n", "rows", F.col("h.id").alias("head"), F.col("h.mark").alias("mark")), "heads")
    # a set of n elements has fewer than n signatures in both its bands, but for the least of sets
    one = heads.agg(F.sum(F.col("n") + 24).alias("signatures"), F.count("*").alias("classes")).first()
    total = one.signatures or 0
    fine = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE))
    each = -(-fine // MOST_TASKS)
    tasks = -(-fine // each)
    shorts = written(_buckets(_packed(rows, "text", n, percent, fine), tasks, each).distinct(), "shorts")
    release(spark)
    buckets = written(shorts.join(heads.select("short", "class"), "short").select("bucket", "class"), "buckets")
    scratch.free(shorts)
    nearest = _nearest(buckets, scratch)
    followers = nearest.groupBy("b").agg(F.ceil(F.count("*") / FOLLOWERS).cast("int").alias("groups"))
    to = spread_join(nearest, followers, "b", rows=one.classes).select(F.col("a").alias("class"), "b", F.pmod(F.xxhash64("a"), F.col("groups")).cast("int").alias("turn"))
    wanted = buckets.select("class").distinct().join(heads.select("class", "short", "head"), "class").join(to, "class", "left").join(
        followers.withColumnRenamed("b", "class"), "class", "left"
    )
    wanted = written(wanted, "wanted")
    texts = written(_fetched(rows.select("id", "text"), wanted, n).select("class", "text", "b", "turn", "groups"), "texts")
    scratch.free(wanted)
    release(spark)
    x = texts.filter("b is not null").select(F.col("class").alias("a"), "b", "turn", F.col("text").alias("x"))
    y = texts.filter("groups is not null").select(
        F.col("class").alias("b"), F.col("text").alias("y"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("turn")
    )
    with small_batches(spark):
        links = written(_linked(x.join(y, ["b", "turn"]), n, percent), "links")
    release(spark)
    roots = components(links, scratch=scratch)
    placed = written(
        buckets.join(roots.withColumnRenamed("node", "class"), "class", "left").select("bucket", "class", F.coalesce("root", "class").alias("root")),
        "placed"
    )
    scratch.free(buckets)
    several = placed.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("bucket")
    left = placed.join(several, "bucket", "left_semi").select("class", "root").distinct()
    opened = written(texts.select("class", "text", "b").join(left, "class").withColumn("no", F.monotonically_increasing_id()), "opened")
    scratch.free(placed, texts)
    release(spark)
    pairs = _crossing(opened, n, percent, scratch)
    release(spark)
    names = opened.select("no", "class")
    known = opened.select("no", F.col("b").alias("class")).join(names.withColumnRenamed("no", "to"), "class").select(
        F.greatest("no", "to").alias("a"), F.least("no", "to").alias("b")
    )
    x, y = opened.select(F.col("no").alias("a"), F.col("text").alias("x")), opened.select(F.col("no").alias("b"), F.col("text").alias("y"))
    with small_batches(spark):
        more = written(_linked(pairs.join(known, ["a", "b"], "left_anti").join(y, "b").join(x, "a"), n, percent), "more")
    more = more.join(names.toDF("a", "u"), "a").join(names.toDF("b", "v"), "b").select(F.col("u").alias("a"), F.col("v").alias("b"))
    more = written(more, "links")
    scratch.free(opened, pairs)
    release(spark)
    if not more.isEmpty():
        roots = components(links.union(more), scratch=scratch)
    rooted = heads.join(roots.withColumnRenamed("node", "class"), "class", "left").select(
        "class", F.coalesce("root", "class").alias("root"), "head", "mark", "rows"
    )
    smallest = rooted.groupBy("root").agg(F.min("head").alias("component"))
    return sized, spread_join(rooted, smallest, "root", rows=one.classes).select("class", "root", "head", "mark", "rows", "component")


def jaccard_components(docs: DataFrame, n: int, percent: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id) of each row of docs: sets of n words, links from percent similarity on.

    component_id is the smallest key that a row reaches by links, its own included.
    """
    scratch = Scratch(docs.sparkSession)
    sized, named = _components(docs, n, percent, key, text, scratch)
    named = scratch.written(named.select("class", "component"), "named")
    return scratch.result(
        spread_join(sized, named, "class", "left").select(F.col("id").alias(key), "n_shingles", F.coalesce("component", "id").alias("component_id")),
        "components"
    )


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), 4, 85)


def unique_rows(docs: DataFrame, n: int, percent: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near copies in docs: the one with the smallest key; without any key, one of them.

    Groups are those of texts: rows of one key with texts that do not link are of different groups. Among rows alike in
    set and key the one with the smallest row_marks stays, so reruns agree. Rows without words are of no group and all stay.
    """
    scratch = Scratch(docs.sparkSession)
    _, named = _components(docs, n, percent, key, text, scratch)
    first = named.groupBy("root").agg(F.min(F.struct(F.col("head").isNull().alias("no"), "head", "class", "mark")).alias("f"))
    keep = scratch.result(first.select(F.col("f.mark.m1").alias("_m1"), F.col("f.mark.m2").alias("_m2")), "keep")
    columns = [F.col(c).alias(f"_{i}") for i, c in enumerate(docs.columns)]
    back = [F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns)]
    words = F.coalesce(F.rlike(text, F.lit(r"[^\x20\x09-\x0D]")), F.lit(False))
    m1, m2 = row_marks(docs)

    def one_a_task(batches):
        """Each pair of marks once a task, so that no number of repeated rows goes to one place."""
        drop_state(__name__)
        seen: set[tuple[int, int]] = set()
        for b in batches:
            take = []
            for i, pair in enumerate(zip(b.column("_m1").to_pylist(), b.column("_m2").to_pylist())):
                if pair not in seen:
                    if len(seen) >= 1 << 20:
                        seen.clear()
                    seen.add(pair)
                    take.append(i)
            yield b.take(pa.array(take, pa.int64())) if len(take) < b.num_rows else b

    worded = docs.filter(words).select(*columns, m1.alias("_m1"), m2.alias("_m2"))
    groups = worded.mapInArrow(one_a_task, worded.schema).join(keep, ["_m1", "_m2"], "left_semi").dropDuplicates(["_m1", "_m2"])
    return groups.select(*back).unionByName(docs.filter(~words))


def unique_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one row of each group of near copies (5 words, 80 percent), see unique_rows."""
    return unique_rows(docs, 5, 80)
