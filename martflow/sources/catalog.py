"""Tables of Spark's catalogs: created from a schema, grown and appended by name, and joined across catalogs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from martflow.operators.schema import create_table_ddl
from martflow.sources.store import SnapshotTable


def create_table(spark: SparkSession, name: str, schema: T.StructType, keys: list[str] = (), using: str = "parquet") -> DataFrame:
    """A table of a schema, if there is none."""
    if not spark.catalog.tableExists(name):
        spark.sql(create_table_ddl(name, schema, list(keys), using))
    return spark.table(name)


def append(df: DataFrame, name: str, by: list[str] = ()) -> DataFrame:
    """df's rows added to a table by name; the catalog learns columns and partitions that are new.

    The first call creates the table, partitioned by `by`. Columns that df lacks are null.
    """
    spark = df.sparkSession
    if not spark.catalog.tableExists(name):
        df.write.format("parquet").partitionBy(*by).saveAsTable(name)
        return spark.table(name)
    have = spark.table(name).schema
    new = [f for f in df.schema.fields if f.name not in have.names]
    if new:
        spark.sql(f"ALTER TABLE {name} ADD COLUMNS ({', '.join(f'{f.name} {f.dataType.simpleString()}' for f in new)})")
        spark.catalog.refreshTable(name)
    whole = spark.table(name)
    spark.createDataFrame([], whole.schema).unionByName(df, allowMissingColumns=True).select(*whole.columns).write.insertInto(name)
    return spark.table(name)


def resolve(spark: SparkSession, name: str) -> DataFrame:
    """A table by catalog name (catalog.database.table or less), or the current version of a snapshot table by path."""
    return SnapshotTable(spark, name).read() if "/" in name else spark.table(name)


def federated_join(spark: SparkSession, left: str, right: str, on: list[str], how: str = "inner") -> DataFrame:
    """Two tables of any two catalogs, or a lake path and a warehouse table, joined in one plan."""
    return resolve(spark, left).join(resolve(spark, right), on, how)
