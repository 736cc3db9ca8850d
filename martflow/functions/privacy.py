"""Column-level privacy transforms, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martflow.operators.dimensions import numbered


def mask_last(c: Column, keep: int = 4, fill: str = "*") -> Column:
    """All but the last `keep` characters replaced; values of at most `keep` characters are masked whole."""
    n = F.length(c)
    return F.when(n <= keep, F.repeat(F.lit(fill), n)).otherwise(F.concat(F.repeat(F.lit(fill), n - keep), F.right(c, F.lit(keep))))


def hashed(c: Column, salt: str = "") -> Column:
    """SHA-256 in hexadecimal; null stays null."""
    return F.sha2(F.concat(F.lit(salt), c), 256)


def encrypted(c: Column, key: Column) -> Column:
    """AES-GCM, base64; a fresh vector for each value."""
    return F.base64(F.aes_encrypt(c.cast("binary"), key))


def decrypted(c: Column, key: Column) -> Column:
    return F.aes_decrypt(F.unbase64(c), key).cast("string")


def vault(df: DataFrame, column: str, known: DataFrame | None = None) -> DataFrame:
    """(value, token) for every distinct value: known tokens stay, new values are numbered on from the largest."""
    values = df.select(F.col(column).alias("value")).filter(F.col("value").isNotNull()).distinct()
    if known is None:
        return numbered(values, "token", ["value"]).select("value", "token")
    new = values.join(known, "value", "left_anti")
    return known.select("value", "token").unionByName(numbered(new, "token", ["value"], after=known.agg(F.max("token").alias("k"))).select("value", "token"))


def tokenized(df: DataFrame, column: str, tokens: DataFrame) -> DataFrame:
    """df with column replaced by its token."""
    t = tokens.select(F.col("value").alias("_value"), F.col("token").alias("_token"))
    names = [F.col("_token").alias(column) if c == column else F.col(c) for c in df.columns]
    return df.join(t, F.col(column) == F.col("_value"), "left").select(*names)


def detokenized(df: DataFrame, column: str, tokens: DataFrame) -> DataFrame:
    t = tokens.select(F.col("value").alias("_value"), F.col("token").alias("_token"))
    names = [F.col("_value").alias(column) if c == column else F.col(c) for c in df.columns]
    return df.join(t, F.col(column) == F.col("_token"), "left").select(*names)


def erased(df: DataFrame, keys: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    """Right to be forgotten: the rows of keys stay, their personal columns are null."""
    mark = keys.select(*on).distinct().withColumn("_gone", F.lit(True))
    return df.join(mark, on, "left").select(*[F.when(F.col("_gone"), None).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


def soft_deleted(df: DataFrame, keys: DataFrame, on: list[str], at: Column) -> DataFrame:
    """The rows of keys marked as deleted at a time (deleted_at); a row that is marked keeps its first mark."""
    mark = keys.select(*on).distinct().withColumn("_gone", F.lit(True))
    before = F.col("deleted_at") if "deleted_at" in df.columns else F.lit(None).cast("timestamp")
    out = df.join(mark, on, "left").withColumn("deleted_at", F.coalesce(before, F.when(F.col("_gone"), at)))
    return out.select(*[c for c in df.columns if c != "deleted_at"], "deleted_at")


def live(df: DataFrame) -> DataFrame:
    """The rows that are not marked as deleted."""
    return df.filter("deleted_at IS NULL")


#: The zones of a warehouse, in the order in which data goes through them.
LAYERS = ("raw", "curated", "reporting")


def layer_path(root: str, layer: str, table: str) -> str:
    if layer not in LAYERS:
        raise ValueError(f"a layer is one of {', '.join(LAYERS)}, not {layer!r}")
    return f"{root.rstrip('/')}/{layer}/{table}"
