"""Row-order analytics: latest per key, ranking, gaps, runs and velocity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row a key: the first by order."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def top_per_key(df: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    """The rows of rank 1..n within a key, ties included, with that rank."""
    return df.withColumn("rank", F.rank().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= n)


def ranked(df: DataFrame, keys: list[str], *order: Column, tiles: int = 4) -> DataFrame:
    """row_number, rank, dense_rank and ntile within a key."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumns(
        {"row_number": F.row_number().over(w), "rank": F.rank().over(w), "dense_rank": F.dense_rank().over(w), "tile": F.ntile(tiles).over(w)}
    )


def since_last(df: DataFrame, key: str, at: str, *ties: str) -> DataFrame:
    """Seconds since the key's row before; null for its first."""
    w = W.partitionBy(key).orderBy(at, *ties)
    gap = F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.lag(at).over(w).cast("timestamp"))
    return df.withColumn("seconds_since_last", gap / F.lit(1_000_000.0))


def high_pairs(df: DataFrame, key: str, at: str, value: str, least: float, within: str, ties: str, pairs: int = 2) -> DataFrame:
    """Keys with at least `pairs` rows that are high, followed by a high row of the key within the interval.

    Two rows of look-ahead are compared; the pairs need not adjoin each other.
    """
    w = W.partitionBy(key).orderBy(at, ties)
    hit = df.withColumns({"_v": F.lead(value).over(w), "_t": F.lead(at).over(w)}).filter(
        (F.col(value) > least) & (F.col("_v") > least) & (F.col("_t") <= F.col(at) + F.expr(f"INTERVAL {within}"))
    )
    return hit.groupBy(key).agg(F.count("*").alias("n_pairs")).filter(F.col("n_pairs") >= pairs)


def high_runs(df: DataFrame, key: str, at: str, value: str, least: float, within: str, ties: str, length: int = 3) -> DataFrame:
    """Runs of at least `length` consecutive high rows of a key, none later than the interval after the one before."""
    w = W.partitionBy(key).orderBy(at, ties)
    high = F.col(value) > least
    goes_on = high & (F.lag(value).over(w) > least) & (F.col(at) <= F.lag(at).over(w) + F.expr(f"INTERVAL {within}"))
    marked = df.withColumn("_new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn(
        "_run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    ).filter(high)
    return marked.groupBy(key, "_run").agg(
        F.min(at).alias("run_start"), F.max(at).alias("run_end"), F.count("*").alias("n_rows")
    ).filter(F.col("n_rows") >= length).drop("_run")


def velocity(df: DataFrame, key: str, at: str, place: str, within: str, ties: str) -> DataFrame:
    """Rows whose key was somewhere else at its row before, within the interval."""
    w = W.partitionBy(key).orderBy(at, ties)
    moved = df.withColumns({f"previous_{place}": F.lag(place).over(w), "_t": F.lag(at).over(w)})
    return moved.filter((F.col(place) != F.col(f"previous_{place}")) & (F.col(at) <= F.col("_t") + F.expr(f"INTERVAL {within}"))).drop("_t")


def window_sums(df: DataFrame, at: str, by: list[str], value: str, width: str, slide: str | None = None) -> DataFrame:
    """Count and sum of tumbling or sliding event-time windows; the same for a batch and, with a watermark, a stream."""
    w = F.window(at, width, slide) if slide else F.window(at, width)
    out = df.groupBy(w.alias("w"), *by).agg(F.count("*").alias("n_events"), F.sum(F.col(value).cast("decimal(18,2)")).cast("double").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "n_events", "total")
