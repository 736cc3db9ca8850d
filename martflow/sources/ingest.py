"""Readers: delimited files under a contract, JSON payloads, incremental reads, streams, and a JDBC builder."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WIDE = T.DecimalType(38, 18)


def clean_name(name: str) -> str:
    """Lower case; what lies between runs of letters and digits becomes one underscore."""
    return "_".join(re.findall(r"[a-z0-9]+", name.lower()))


def normalized(df: DataFrame) -> DataFrame:
    """df under cleaned names, in one projection; two columns of one name are an error."""
    names = [clean_name(c) for c in df.columns]
    if twice := sorted({n for n in names if names.count(n) > 1}):
        raise ValueError(f"columns fall together: {twice}")
    return df.toDF(*names)


def with_decimals(df: DataFrame, keys: list[str]) -> DataFrame:
    """Doubles that are no keys as DECIMAL(38,18); what overflows it is null (see quarantine)."""
    return df.select(
        *[
            F.col(f.name).try_cast(WIDE).alias(f.name) if isinstance(f.dataType, T.DoubleType) and f.name not in keys else F.col(f.name) for f in df.schema.fields
        ]
    )


def with_audit(df: DataFrame, run_at: Column, file_name: Column | None = None) -> DataFrame:
    """run_date and file_name; by default the file that Spark read the row from."""
    return df.withColumns({"run_date": run_at, "file_name": F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1) if file_name is None else file_name})


def with_lineage(df: DataFrame, ingested: Column, job: str, system: str, run_id: str) -> DataFrame:
    return df.withColumns({"_ingested_at": ingested, "_job_name": F.lit(job), "_source_system": F.lit(system), "_pipeline_run_id": F.lit(run_id)})


def read_csv(spark: SparkSession, path: str, keys: list[str], run_at: Column, contract: T.StructType | None = None) -> DataFrame:
    """A file with a header under its contract (one pass), or with inferred types (two passes) where none is known."""
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"')
    raw = reader.schema(contract).csv(path) if contract else reader.option("inferSchema", True).csv(path)
    named = with_audit(raw, run_at)
    return with_decimals(normalized(named), keys)


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None, where: str | None = None, merge: bool = False) -> DataFrame:
    """A Parquet scan; the filter and the columns reach it."""
    df = spark.read.option("mergeSchema", merge).parquet(path)
    df = df.filter(where) if where else df
    return df.select(*columns) if columns else df


def read_jdbc(spark: SparkSession, url: str, query: str, partition: Mapping[str, str] | None = None, **options: str):
    """A JDBC scan of a query; partition: partitionColumn, lowerBound, upperBound, numPartitions."""
    reader = spark.read.format("jdbc").option("url", url)
    if partition:
        return reader.option("dbtable", f"({query}) q").options(**partition, **options).load()
    return reader.option("query", query).options(**options).load()


def parse_json(df: DataFrame, column: str, schema: str) -> DataFrame:
    """The fields of a JSON text column as columns of their own."""
    return df.withColumn("_data", F.from_json(F.col(column).cast("string"), schema)).select(*[c for c in df.columns if c != column], "_data.*")


def after_key(df: DataFrame, key: str, mark) -> DataFrame:
    """Rows above a monotone key's high-water mark; the comparison is pushed to the scan."""
    return df if mark is None else df.filter(F.col(key) > F.lit(mark))


def after_time(df: DataFrame, column: str, mark: Column | None, lookback_days: int = 0) -> DataFrame:
    """Rows above a time mark less a look-back window."""
    return df if mark is None else df.filter(F.col(column) > mark - F.expr(f"INTERVAL {int(lookback_days)} DAYS"))


def next_mark(df: DataFrame, column: str, mark):
    """The mark to store once the load has succeeded: never lower than before."""
    m = df.agg(F.max(column).alias("m")).first().m
    return mark if m is None else m if mark is None else max(m, mark)


def partition_of_day(df: DataFrame, day: str) -> DataFrame:
    """The rows of one year=/month=/day= partition; other partitions are not read."""
    y, m, d = map(int, day.split("-"))
    return df.filter((F.col("year") == y) & (F.col("month") == m) & (F.col("day") == d))


def dated(df: DataFrame, column: str) -> DataFrame:
    """year, month and day columns to partition by."""
    return df.withColumns({"year": F.year(column), "month": F.month(column), "day": F.dayofmonth(column)})
