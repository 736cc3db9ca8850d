"""Join strategies that Spark does not pick by itself: salting, hot-key split, buckets, last-known-value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A side is broadcast only if its plan's size estimate is at most this.
MOST_BROADCAST = 64 << 20


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of a frame's size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """df with a broadcast hint if its estimated size allows, else as it is."""
    return F.broadcast(df) if plan_bytes(df) <= most else df


def broadcast_join(facts: DataFrame, dim: DataFrame, on: list[str], how: str = "inner", most: int = MOST_BROADCAST) -> DataFrame:
    return facts.join(broadcast_if_small(dim, most), on, how)


def salted_join(left: DataFrame, right: DataFrame, on: list[str], salts: int, row: list[str], how: str = "inner") -> DataFrame:
    """An equi-join (inner or left) whose keys are spread over `salts` tasks.

    The left side's salt is a hash of its own columns `row`, so a task that runs again deals the same; the right side
    is repeated for each salt. Null keys match nothing, as in the plain join.
    """
    if how not in ("inner", "left"):
        raise ValueError("only inner and left joins can be salted on the left side")
    s = left.withColumn("_salt", F.pmod(F.xxhash64(*row), F.lit(salts)).cast("int"))
    r = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return s.join(r, [*on, "_salt"], how).drop("_salt")


def hot_keys(df: DataFrame, on: list[str], least: int) -> DataFrame:
    """The keys with more than `least` rows."""
    return df.groupBy(*on).agg(F.count("*").alias("_n")).filter(F.col("_n") > least).select(*on)


def hot_key_split_join(facts: DataFrame, dim: DataFrame, on: list[str], least: int, how: str = "left", most: int = MOST_BROADCAST) -> DataFrame:
    """Rows of hot keys meet their (few) dimension rows by broadcast, the rest by a shuffle; equal to the plain join.

    At most rows / least keys are hot; their dimension rows are broadcast only if estimated small enough.
    """
    hot = hot_keys(facts, on, least)
    few = broadcast_if_small(dim.join(broadcast_if_small(hot, most), on, "left_semi"), most)
    return facts.join(broadcast_if_small(hot, most), on, "left_semi").join(few, on, how).unionByName(
        facts.join(broadcast_if_small(hot, most), on, "left_anti").join(dim, on, how)
    )


def repartitioned_join(left: DataFrame, right: DataFrame, on: list[str], n: int, how: str = "inner") -> DataFrame:
    """Both sides dealt to n partitions by key first, for a join whose result is used by that key again."""
    return left.repartition(n, *on).join(right.repartition(n, *on), on, how)


def write_bucketed(df: DataFrame, name: str, on: list[str], n: int) -> DataFrame:
    """df as a table bucketed and sorted by key; two such tables join without a shuffle."""
    df.write.bucketBy(n, *on).sortBy(*on).mode("overwrite").format("parquet").saveAsTable(name)
    return df.sparkSession.table(name)


def bucketed_join(spark: SparkSession, left: str, right: str, on: list[str], how: str = "inner") -> DataFrame:
    return spark.table(left).join(spark.table(right).hint("merge"), on, how)


def last_known(facts: DataFrame, rates: DataFrame, by: list[str], at: str, rate_at: str, values: list[str]) -> DataFrame:
    """Each fact with the latest values of its key at or before its time (null before the first): an as-of join.

    Both sides are merged by key and time and the last value carried forward: one shuffle, no range join. Rates of the
    same key and time are reduced to the greatest.
    """
    latest = rates.groupBy(*by, rate_at).agg(F.max(F.struct(*values)).alias("_v"))
    r = latest.select(
        *by, F.col(rate_at).alias("_at"), F.lit(0).alias("_kind"), "_v",
        F.lit(None).cast(facts.select(F.struct("*")).schema[0].dataType).alias("_f")
    )
    f = facts.select(
        *by, F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(latest.schema["_v"].dataType).alias("_v"),
        F.struct("*").alias("_f")
    )
    w = W.partitionBy(*by).orderBy("_at", "_kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    both = r.unionByName(f).withColumn("_v", F.last("_v", ignorenulls=True).over(w)).filter("_kind = 1")
    return both.select("_f.*", *[F.col(f"_v.{v}").alias(v) for v in values])


def date_range_join(facts: DataFrame, ranges: DataFrame, on: Column, day: Column, first: Column, last: Column, how: str = "inner") -> DataFrame:
    """An equi-join with a closed interval: the key is shuffled, the interval filters."""
    return facts.join(ranges, on & (day >= first) & (day <= last), how)
