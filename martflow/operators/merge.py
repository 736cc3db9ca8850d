"""Keyed merges as pure functions: target and batch in, the new target out.

All of them join by plain equality, so rows with a null key match nothing: the target's stay, the batch's are added.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def replace_by_key(target: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Group replacement: target rows whose key is in the batch go, and all rows of the batch, duplicates too, come in."""
    return target.join(batch.select(*keys).distinct(), keys, "left_anti").unionByName(batch)


def _matched(target: DataFrame, batch: DataFrame, keys: list[str], newer: str | None) -> DataFrame:
    b = batch.select(*[F.col(c).alias(f"_b_{c}") for c in batch.columns], F.lit(True).alias("_hit"))
    on = reduce(Column.__and__, [F.col(k) == F.col(f"_b_{k}") for k in keys])
    take = F.col("_hit").isNotNull()
    if newer:
        take = take & (F.col(f"_b_{newer}") > F.col(newer))
    cols = [F.when(take, F.col(f"_b_{c}")).otherwise(F.col(c)).alias(c) if c in batch.columns and c not in keys else F.col(c) for c in target.columns]
    return target.join(b, on, "left").select(*cols)


def upsert(target: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Update the matched, insert the others. The batch must hold one row a key (see latest_per_key)."""
    return _matched(target, batch, keys, None).unionByName(insert_rows(target, batch, keys), allowMissingColumns=True)


def upsert_if_newer(target: DataFrame, batch: DataFrame, keys: list[str], updated: str) -> DataFrame:
    """Upsert in which a matched row changes only if the batch's is later by `updated`."""
    return _matched(target, batch, keys, updated).unionByName(insert_rows(target, batch, keys), allowMissingColumns=True)


def insert_rows(target: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of the batch whose key the target lacks."""
    return batch.join(target.select(*keys).distinct(), keys, "left_anti")


def new_rows(target: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """The batch's rows whose key the target lacks, one a key: the least by all columns. Null keys are all new."""
    new = insert_rows(target, batch, keys)
    named = new.filter(reduce(Column.__and__, [F.col(k).isNotNull() for k in keys]))
    rest = new.filter(reduce(Column.__or__, [F.col(k).isNull() for k in keys]))
    first = named.groupBy(*keys).agg(F.min(F.struct(*[c for c in new.columns if c not in keys])).alias("_r"))
    return first.select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in new.columns]).unionByName(rest)


def insert_only(target: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Idempotent append: a key enters once; of several new rows of a key, the least by all columns."""
    return target.unionByName(new_rows(target, batch, keys))


def delete_version(target: DataFrame, batch: DataFrame, version: str, value: str) -> DataFrame:
    """All target rows of one version give way to the batch."""
    return target.filter(~F.col(version).eqNullSafe(F.lit(value))).unionByName(batch)


def merge_metrics(target: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """One row: exact counts of replace_by_key, and the estimates inserted_est and updated_est made from totals alone."""
    hit = target.join(batch.select(*keys).distinct(), keys, "left_semi")
    one = lambda df, name: df.agg(F.count("*").alias(name))
    out = one(target, "rows_before").crossJoin(one(batch, "rows_read")).crossJoin(one(hit, "rows_deleted"))
    after = F.col("rows_before") - F.col("rows_deleted") + F.col("rows_read")
    out = out.withColumn("rows_after", after)
    out = out.withColumn("inserted_est", F.greatest(F.col("rows_after") - F.col("rows_before"), F.lit(0).cast("long")))
    return out.withColumn("updated_est", F.greatest(F.col("rows_read") - F.col("inserted_est"), F.lit(0).cast("long")))
