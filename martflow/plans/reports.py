"""Star queries over a dimensional model, as functions of frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martflow.functions.timefn import ratio

MONEY = "decimal(18,2)"


def money(c: Column | str) -> Column:
    """An exact sum of amounts, as a double."""
    return F.sum((F.col(c) if isinstance(c, str) else c).cast("decimal(38,4)")).cast("double")


def totals_by(facts: DataFrame, dim: DataFrame, on: Column, by: list[Column], measures: dict[str, Column]) -> DataFrame:
    """Measures summed by attributes of a dimension."""
    return facts.join(dim, on).groupBy(*by).agg(*[money(c).alias(n) for n, c in measures.items()])


def by_version(facts: DataFrame, by: list[Column], version: str, value: Column, names: dict[str, str]) -> DataFrame:
    """One summed column for each version, {column: version}: conditional aggregation in one pass."""
    return facts.groupBy(*by).agg(*[money(F.when(F.col(version) == v, value).otherwise(F.lit(0).cast(MONEY))).alias(n) for n, v in names.items()])


def variance(df: DataFrame, actual: str, plan: str, name: str = "variance") -> DataFrame:
    """Actual less plan, absolute and in percent of plan (null where plan is 0)."""
    gap = F.round(F.col(actual) - F.col(plan), 2)
    return df.withColumns({name: gap, f"{name}_pct": ratio(F.col(actual) - F.col(plan), F.col(plan), 100, 1)})


def last_in_period(df: DataFrame, period: Column, entity: list[str], at: str, value: str) -> DataFrame:
    """A semi-additive measure: each entity's last value in a period, then summed over entities."""
    last = df.groupBy(period.alias("period"), *entity).agg(F.max_by(F.col(value), F.col(at)).alias("v"))
    return last.groupBy("period").agg(F.sum("v").alias(value))


def effective_rate(df: DataFrame, by: list[str], revenue: Column, base: Column, digits: int = 6) -> DataFrame:
    """A ratio of sums, never an average of ratios."""
    out = df.groupBy(*by).agg(money(revenue).alias("revenue"), money(base).alias("base"))
    return out.withColumn("effective_rate", ratio(F.col("revenue"), F.col("base"), 1, digits))
