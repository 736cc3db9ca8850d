"""Facts: projection, surrogate lookups, late data and grain."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martflow.operators.dimensions import UNKNOWN_KEY


def project(source: DataFrame, mapping: dict[str, str], keep: list[str], loaded: Column) -> DataFrame:
    """Measures and degenerate dimensions renamed, {fact: source}, the natural keys in keep, and load_timestamp."""
    return source.select(*[F.col(s).alias(f) for f, s in mapping.items()], *[c for c in keep if c not in mapping], loaded.alias("load_timestamp"))


def _lookup(facts: DataFrame, dim: DataFrame, natural: dict[str, str], key: str, name: str, extra: Column | None) -> DataFrame:
    on = reduce(Column.__and__, [F.col(f"f.{f}") == F.col(f"d.{d}") for f, d in natural.items()])
    joined = facts.alias("f").join(dim.alias("d"), on if extra is None else on & extra, "left")
    return joined.select("f.*", F.coalesce(F.col(f"d.{key}"), F.lit(UNKNOWN_KEY)).cast("long").alias(name))


def lookup_current(facts: DataFrame, dim: DataFrame, natural: dict[str, str], key: str, name: str | None = None, scd_type: int = 2) -> DataFrame:
    """Each fact with its member's current surrogate key, or -1. natural: {fact column: dimension column}.

    Only keys and the flag are read of the dimension; Spark broadcasts it where its size allows.
    """
    d = dim.filter("is_current") if scd_type == 2 else dim
    return _lookup(facts, d.select(key, *natural.values()), natural, key, name or key, None)


def lookup_as_of(facts: DataFrame, dim: DataFrame, natural: dict[str, str], key: str, day: str, name: str | None = None) -> DataFrame:
    """Each fact with the surrogate key of the version valid on its day, or -1: closed intervals, a null end is open."""
    d = dim.select(key, *natural.values(), "effective_date", "end_date")
    valid = (F.col(f"f.{day}") >= F.col("d.effective_date")) & (F.col(f"f.{day}") <= F.coalesce(F.col("d.end_date"), F.lit("9999-12-31").cast("date")))
    return _lookup(facts, d, natural, key, name or key, valid)


def load(facts: DataFrame, lookups: list[dict]) -> DataFrame:
    """All lookups in turn: each a dict of the arguments of lookup_current, or with `day` those of lookup_as_of."""
    return reduce(lambda f, how: (lookup_as_of if "day" in how else lookup_current)(f, **how), lookups, facts)


def split_late(facts: DataFrame, day: str, watermark) -> tuple[DataFrame, DataFrame]:
    """(on time, late) by business day against a watermark."""
    w = F.lit(watermark).cast("timestamp_ntz")
    return facts.filter(F.col(day) >= w), facts.filter(F.col(day) < w)


def union_late(on_time: DataFrame, late: DataFrame, day: str, watermark, grace_days: int) -> DataFrame:
    """Both parts again, late ones within the grace window only, marked by is_late."""
    w = F.lit(watermark).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(grace_days)} DAYS")
    return on_time.withColumn("is_late", F.lit(False)).unionByName(late.filter(F.col(day) >= w).withColumn("is_late", F.lit(True)))


def to_grain(facts: DataFrame, unit: str, day: str, by: list[str], sums: list[str]) -> DataFrame:
    """Facts rolled up to days, months or years: sums of the measures and the number of transactions."""
    period = F.date_trunc(unit, F.col(day)).cast("date").alias("period")
    return facts.groupBy(*by, period).agg(*[F.sum(F.col(c).cast("decimal(18,2)")).cast("double").alias(c) for c in sums], F.count("*").alias("n_transactions"))
