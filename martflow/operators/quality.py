"""Data-quality checks. Each is one row: check_name, table_name, column_name, check_type, expected, actual, passed."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martflow.functions.timefn import datediff_boundary, ratio

RESULT = "check_name string, table_name string, column_name string, check_type string, expected string, actual string, passed boolean"


#: The results table: a row a check and run.
RESULTS = f"run_id string, {RESULT}, details string, checked_at timestamp"


class CheckFailed(ValueError):
    pass


def _row(one: DataFrame, name: str, table: str, column: str, kind: str, expected: str, actual: Column, passed: Column) -> DataFrame:
    return one.select(
        F.lit(name).alias("check_name"), F.lit(table).alias("table_name"), F.lit(column).alias("column_name"),
        F.lit(kind).alias("check_type"), F.lit(expected).alias("expected"), actual.cast("string").alias("actual"), passed.alias("passed")
    )


def nulls(df: DataFrame, table: str, column: str) -> DataFrame:
    one = df.agg(F.count_if(F.col(column).isNull()).alias("n"))
    return _row(one, f"null_check_{column}", table, column, "NULL", "0", F.col("n"), F.col("n") == 0)


def duplicates(df: DataFrame, table: str, keys: list[str]) -> DataFrame:
    """How many key groups have more than one row."""
    one = df.groupBy(*keys).agg(F.count("*").alias("c")).agg(F.count_if(F.col("c") > 1).alias("n"))
    return _row(one, "duplicate_check", table, ",".join(keys), "DUPLICATE", "0", F.col("n"), F.col("n") == 0)


def row_count(df: DataFrame, table: str, least: int, most: int) -> DataFrame:
    one = df.agg(F.count("*").alias("n"))
    return _row(one, "row_count_check", table, "*", "ROW_COUNT", f"{least}-{most}", F.col("n"), F.col("n").between(least, most))


def freshness(df: DataFrame, table: str, column: str, hours: int, now: Column) -> DataFrame:
    """Hour boundaries since the latest value; an empty table fails with NO DATA."""
    one = df.agg(F.max(column).alias("m")).select(datediff_boundary("hour", F.col("m"), now).alias("h"))
    return _row(
        one, f"freshness_check_{column}", table, column, "FRESHNESS", f"<= {hours}",
        F.coalesce(F.col("h").cast("string"), F.lit("NO DATA")), F.coalesce(F.col("h") <= hours, F.lit(False))
    )


def referential(child: DataFrame, parent: DataFrame, table: str, column: str, parent_column: str) -> DataFrame:
    """Child rows with a key that the parent lacks; null keys are no violation."""
    lost = child.filter(F.col(column).isNotNull()).join(parent.select(F.col(parent_column).alias(column)).distinct(), column, "left_anti")
    one = lost.agg(F.count("*").alias("n"))
    return _row(one, f"fk_check_{column}", table, column, "REFERENTIAL", "0", F.col("n"), F.col("n") == 0)


def rules(df: DataFrame, table: str, positive: list[str] = (), complete: list[str] = (), unique: list[str] = (), most_missing: float = 1.0) -> DataFrame:
    """Positivity, completeness (percent missing below most_missing) and uniqueness of columns, all but the last in one pass."""
    aggs = [F.count_if(F.col(c) <= 0).alias(f"p_{c}") for c in positive] + [F.count_if(F.col(c).isNull()).alias(f"m_{c}") for c in complete]
    one = df.agg(F.count("*").alias("n"), *aggs)
    parts = [_row(one, f"positive_{c}", table, c, "POSITIVE", "0", F.col(f"p_{c}"), F.col(f"p_{c}") == 0) for c in positive]
    for c in complete:
        pct = F.coalesce(ratio(F.col(f"m_{c}"), F.col("n"), 100, 4), F.lit(0.0))
        parts.append(_row(one, f"complete_{c}", table, c, "COMPLETENESS", f"< {most_missing}", F.col(f"m_{c}"), pct < most_missing))
    parts += [
        duplicates(
            df.filter(F.col(c).isNotNull()), table, [c]
        ).withColumn("check_name", F.lit(f"unique_{c}")).withColumn("check_type", F.lit("UNIQUE")) for c in unique
    ]
    return reduce(DataFrame.unionByName, parts)


def expectations(df: DataFrame, table: str, between: dict[str, tuple], matches: dict[str, str]) -> DataFrame:
    """Values within bounds, and texts that match a pattern; nulls are left to completeness. One pass."""
    aggs = [
        F.count_if(~F.col(c).between(*b)).alias(f"b_{c}") for c, b in between.items()
    ] + [F.count_if(~F.col(c).rlike(p)).alias(f"r_{c}") for c, p in matches.items()]
    one = df.agg(*aggs)
    parts = [_row(one, f"between_{c}", table, c, "BETWEEN", f"{b[0]}..{b[1]}", F.col(f"b_{c}"), F.col(f"b_{c}") == 0) for c, b in between.items()]
    parts += [_row(one, f"regex_{c}", table, c, "REGEX", p, F.col(f"r_{c}"), F.col(f"r_{c}") == 0) for c, p in matches.items()]
    return reduce(DataFrame.unionByName, parts)


def key_null_guard(df: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with all keys, rows that lack one)."""
    lacks = reduce(Column.__or__, [F.col(k).isNull() for k in keys])
    return df.filter(~lacks), df.filter(lacks)


def logged(results: DataFrame, run_id: str, at: Column) -> DataFrame:
    """Check results as rows of the results table, with details in words."""
    details = F.concat(F.col("check_type"), F.lit(": expected "), F.col("expected"), F.lit(", found "), F.coalesce("actual", F.lit("nothing")))
    return results.select(F.lit(run_id).alias("run_id"), *results.columns, details.alias("details"), at.cast("timestamp").alias("checked_at"))


def require(results: DataFrame) -> None:
    """Raise if any check failed, naming up to 20 of them."""
    bad = results.filter(~F.col("passed")).select("check_name", "table_name", "actual").limit(20).collect()
    if bad:
        raise CheckFailed("; ".join(f"{r.table_name}.{r.check_name}: {r.actual}" for r in bad))


def dashboard(results: DataFrame, checked: str, now: Column, days: int = 7) -> DataFrame:
    """Checks of the last days by table and type: total, passed, failed, pass rate in percent."""
    recent = results.filter(F.col(checked) >= now - F.expr(f"INTERVAL {int(days)} DAYS"))
    by = recent.groupBy("table_name", "check_type").agg(F.count("*").alias("total_checks"), F.count_if(F.col("passed")).alias("passed_checks"))
    return by.withColumn("failed_checks", F.col("total_checks") - F.col("passed_checks")).withColumn(
        "pass_rate", ratio(F.col("passed_checks"), F.col("total_checks"), 100, 1)
    )


def within_errors(bad: DataFrame, total: DataFrame, table: str, most: float) -> DataFrame:
    """Whether quarantined rows are at most `most` percent of all."""
    one = bad.agg(F.count("*").alias("b")).crossJoin(total.agg(F.count("*").alias("n")))
    pct = F.coalesce(ratio(F.col("b"), F.col("n"), 100, 4), F.lit(0.0))
    return _row(one, "error_threshold", table, "*", "ERRORS", f"<= {most}", F.col("b"), pct <= most)


def trailer(df: DataFrame, table: str, rows: int, amount: str | None = None, total=None) -> DataFrame:
    """A file's trailer against its rows: their number and, if given, the sum of a column, both exact (two decimals)."""
    one = df.agg(F.count("*").alias("n"), *([F.sum(F.col(amount).cast("decimal(38,2)")).cast("decimal(38,2)").alias("s")] if amount else []))
    out = _row(one, "trailer_rows", table, "*", "TRAILER", str(rows), F.col("n"), F.col("n") == rows)
    if amount:
        told = Decimal(str(total)).quantize(Decimal("0.01"))
        out = out.unionByName(
            _row(
                one, f"trailer_{amount}", table, amount, "TRAILER", str(told), F.col("s"),
                F.coalesce(F.col("s") == F.lit(told).cast("decimal(38,2)"), F.lit(False))
            )
        )
    return out
