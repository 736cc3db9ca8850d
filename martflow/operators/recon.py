"""Source-to-target reconciliation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def control_totals(source: DataFrame, target: DataFrame, amount: str, key: str, tolerance: float = 0.01) -> DataFrame:
    """One row: rows, sum and distinct keys of both sides, and whether they agree."""
    totals = lambda df, p: df.agg(
        F.count("*").alias(f"{p}_rows"), F.sum(F.col(amount).cast(MONEY)).cast("double").alias(f"{p}_sum"),
        F.count_distinct(key).alias(f"{p}_keys")
    )
    both = totals(source, "source").crossJoin(totals(target, "target"))  # one row each
    same = (F.col("source_rows") == F.col("target_rows")) & (
        F.abs(F.coalesce("source_sum", F.lit(0.0)) - F.coalesce("target_sum", F.lit(0.0))) <= tolerance
    ) & (F.col("source_keys") == F.col("target_keys"))
    return both.withColumn("is_reconciled", same)


def daily_totals(source: DataFrame, target: DataFrame, day: str, amount: str) -> DataFrame:
    """(day, source_sum, target_sum, difference) of the days whose sums differ."""
    by = lambda df, n: df.groupBy(F.to_date(day).alias("day")).agg(F.sum(F.col(amount).cast(MONEY)).alias(n))
    both = by(source, "s").join(by(target, "t"), "day", "full")
    gap = F.coalesce("s", F.lit(0).cast(MONEY)) - F.coalesce("t", F.lit(0).cast(MONEY))
    return both.select(
        "day", F.col("s").cast("double").alias("source_sum"), F.col("t").cast("double").alias("target_sum"),
        gap.cast("double").alias("difference")
    ).filter("difference <> 0")


def missing(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Source rows whose key the target lacks."""
    return source.join(target.select(*keys), keys, "left_anti")


def row_status(source: DataFrame, target: DataFrame, keys: list[str], compare: list[str]) -> DataFrame:
    """(keys, status) of every key of either side: missing_in_target, missing_in_source, mismatch or ok."""
    s, t = source.select(*keys, *compare).withColumn("_s", F.lit(True)).alias("s"), target.select(*keys, *compare).withColumn("_t", F.lit(True)).alias("t")
    on = reduce(Column.__and__, [F.col(f"s.{k}") == F.col(f"t.{k}") for k in keys])
    differ = reduce(Column.__or__, [~F.col(f"s.{c}").eqNullSafe(F.col(f"t.{c}")) for c in compare], F.lit(False))
    status = F.when(F.col("_t").isNull(), "missing_in_target").when(F.col("_s").isNull(), "missing_in_source").when(differ, "mismatch").otherwise("ok")
    return s.join(t, on, "full").select(*[F.coalesce(f"s.{k}", f"t.{k}").alias(k) for k in keys], status.alias("status"))


def content_hash(df: DataFrame, columns: list[str]) -> DataFrame:
    """(n_rows, checksum): a sum of row hashes, whatever their order."""
    return df.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(F.xxhash64(*columns).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("checksum"))


def hash_match(source: DataFrame, target: DataFrame, columns: list[str]) -> DataFrame:
    """(source_rows, target_rows, is_equal) by content_hash."""
    s, t = content_hash(source, columns), content_hash(target, columns)
    both = s.select(F.col("n_rows").alias("source_rows"), F.col("checksum").alias("_s")).crossJoin(
        t.select(F.col("n_rows").alias("target_rows"), F.col("checksum").alias("_t"))
    )
    return both.select("source_rows", "target_rows", (F.col("_s") == F.col("_t")).alias("is_equal"))


def orphan_facts(facts: DataFrame, dims: dict[str, tuple[str, DataFrame, str]]) -> DataFrame:
    """(dimension, n_orphans): facts whose key a dimension lacks, {name: (fact column, dimension, key)}."""
    parts = [
        facts.join(d.select(F.col(k).alias(c)), c, "left_anti").agg(F.lit(name).alias("dimension"), F.count("*").alias("n_orphans")) for name,
        (c, d, k) in dims.items()
    ]
    return reduce(DataFrame.unionByName, parts)
