"""Dimensions: projection, slowly changing types 0 to 4, surrogate keys, seeds and integrity checks.

Every function takes the load date as an argument and returns a new frame. Surrogate keys come from a range partitioning
by the order columns, written once, and a prefix sum over its partition counts: no window over all rows in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from martflow.sources.scratch import materialised

SCD_COLUMNS = ["effective_date", "end_date", "is_current", "version"]
#: Load times of a version's first and last writing; a dimension may do without them.
STAMPS = ["created_date", "updated_date"]
UNKNOWN_KEY = -1


def project(source: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Rename source columns to dimension columns, {dimension: source}, one row for each distinct combination."""
    return source.select(*[(F.col(s) if s in source.columns else F.lit(None).cast("string")).alias(d) for d, s in mapping.items()]).distinct()


def stamped(df: DataFrame, as_of, loaded: Column | None = None) -> DataFrame:
    """df as first versions from as_of on; with a load time, created_date and updated_date too."""
    block = {"effective_date": F.lit(as_of).cast("date"), "end_date": F.lit(None).cast("date"), "is_current": F.lit(True), "version": F.lit(1)}
    return df.withColumns(block | ({} if loaded is None else {c: loaded for c in STAMPS}))


def numbered(df: DataFrame, key: str, order: list[str], after: DataFrame | None = None) -> DataFrame:
    """df with key: 1, 2, ... in the order of `order` (nulls first, ties by all columns), counted on from after's only value.

    Rows are range-partitioned, sorted and written once with their place in their partition; a partition's offset is the
    sum of the counts before it. Counts and rows come from that one writing: range bounds are sampled, so a second
    partitioning of the same rows might differ. The driver holds one count a partition.
    """
    cols = [F.col(c).asc_nulls_first() for c in [*order, *[c for c in df.columns if c not in order]]]
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = df.repartitionByRange(n, *cols).sortWithinPartitions(*cols).withColumn("_at", F.monotonically_increasing_id())
    ranged = materialised(placed)
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    counts = ranged.groupBy(part.alias("p")).agg(F.count("*").alias("n"))
    if after is not None:
        counts = counts.unionByName(after.select(F.lit(-1).cast("long").alias("p"), F.coalesce(F.first(after.columns[0]), F.lit(0)).cast("long").alias("n")))
    found = {r.p: r.n for r in counts.collect()}
    starts, before = [], found.pop(-1, 0)
    for p in range(max(found, default=-1) + 1):
        starts.append(before)
        before += found.get(p, 0)
    start = F.get(F.lit(starts or [0]).cast("array<bigint>"), part.cast("int"))
    return ranged.select((start + place + 1).alias(key), *df.columns)


def changed(attributes: list[str], left: str = "b", right: str = "c") -> Column:
    """Whether any attribute differs between two aliases, null-safe; no attributes: never."""
    return reduce(Column.__or__, [~F.col(f"{left}.{a}").eqNullSafe(F.col(f"{right}.{a}")) for a in attributes], F.lit(False))


def attribute_hash(attributes: list[str]) -> Column:
    """SHA-256 over trimmed, lower-cased text of the attributes; null is told from empty."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.concat(F.lit("v"), F.lower(F.trim(F.col(a).cast("string")))), F.lit("n")) for a in attributes]), 256)


def one_per_key(batch: DataFrame, natural: list[str], order: Column | None = None) -> DataFrame:
    """One row a natural key: the greatest by order (then by all columns)."""
    rest = [c for c in batch.columns if c not in natural]
    ranked = F.max(F.struct(*([order.alias("_o")] if order is not None else []), *rest)).alias("_r") if rest or order is not None else F.count("*").alias("_r")
    return batch.groupBy(*natural).agg(ranked).select(*[F.col(c) if c in natural else F.col(f"_r.{c}").alias(c) for c in batch.columns])


def _on(natural: list[str], a: str, b: str) -> Column:
    return reduce(Column.__and__, [F.col(f"{a}.{k}") == F.col(f"{b}.{k}") for k in natural])


def _largest(dim: DataFrame, key: str, after: DataFrame | None) -> DataFrame:
    return dim.agg(F.max(key).alias("k")) if after is None else after


def scd2(
    dim: DataFrame, batch: DataFrame, key: str, natural: list[str], tracked: list[str], as_of, order: Column | None = None,
    loaded: Column | None = None, after: DataFrame | None = None
) -> DataFrame:
    """Type 2: a changed member's version of the day ends the day before as_of and a new version takes its place.

    * The batch is reduced to one row a natural key; attributes it lacks are carried over from the version of the day.
    * The version of the day is the last that began on as_of or before and has not ended by then; a version without a
      start date has always been. That is the current version unless the batch is late. The new version takes over its
      end and its flag: a late change is put into the history and later versions stay as they are.
    * A row that already began on as_of is overwritten in place.
    * A key without a version of the day comes back with its largest version + 1, valid until its next version begins.
    * New versions are numbered on from the largest of their member, new members from 1.
    * Surrogate keys go on from the largest: new versions first, then new members, each in the order of all columns. Where
      dim is only a part of the dimension (all rows of the batch's members), after holds the largest key of the whole.
    * A dimension with created_date and updated_date gets the load time there: both in new rows, the second in changed ones.
    Running the same batch again on the same day changes nothing. No row of dim is ever dropped.
    """
    names = [c for c in dim.columns if c not in (key, *SCD_COLUMNS, *STAMPS)]
    stamps = [c for c in STAMPS if c in dim.columns]
    loaded = F.current_timestamp() if loaded is None else loaded
    kinds = {f.name: f.dataType for f in dim.schema.fields}
    day = F.lit(as_of).cast("date")
    b = one_per_key(batch.select(*[c for c in names if c in batch.columns]), natural, order)
    began = F.col("effective_date").isNull() | (F.col("effective_date") <= day)
    version = F.struct(
        F.coalesce("effective_date", F.lit("0001-01-01").cast("date")).alias("_start"), "version", key, "effective_date", "end_date",
        "is_current", *[c for c in names if c not in natural]
    )
    known = dim.join(b.select(*natural), natural, "left_semi").groupBy(*natural).agg(
        F.max("version").alias("_last"), F.max(F.when(began, version)).alias("_v"), F.min(F.when(~began, F.col("effective_date"))).alias("_next"))
    valid = F.col("_v").isNotNull() & (F.coalesce(F.col("_v.end_date"), F.lit("9999-12-31").cast("date")) >= day)
    found = b.join(known, natural, "left").withColumn("_valid", valid)
    moved = reduce(Column.__or__, [~F.col(t).eqNullSafe(F.col(f"_v.{t}")) for t in tracked if t in b.columns and t not in natural], F.lit(False))
    merged = [F.col(c) if c in b.columns else F.when(F.col("_valid"), F.col(f"_v.{c}")).cast(kinds[c]).alias(c) for c in names]
    found = found.filter(~F.col("_valid") | moved).select(
        *merged, "_valid", "_last", "_v", "_next",
        F.coalesce(F.col("_valid") & (F.col("_v.effective_date") == day), F.lit(False)).alias("_again")
    )

    hit = found.filter("_valid").select(F.col(f"_v.{key}").alias(key), "_again", F.struct(*names).alias("_new"))
    joined = dim.join(hit, key, "left")
    ended, over = F.coalesce(~F.col("_again"), F.lit(False)), F.coalesce(F.col("_again"), F.lit(False))
    change = {c: F.when(over, F.col(f"_new.{c}").cast(kinds[c])).otherwise(F.col(c)) for c in names if c not in natural}
    change |= {
        "end_date": F.when(ended, F.date_sub(day, 1)).otherwise(F.col("end_date")),
        "is_current": F.when(ended, F.lit(False)).otherwise(F.col("is_current"))
    }
    change |= {c: F.when(ended | over, loaded).otherwise(F.col(c)).cast(kinds[c]) for c in stamps if c == "updated_date"}
    old = joined.select(*[change[c].alias(c) if c in change else F.col(c) for c in dim.columns])

    until = F.when(F.col("_valid"), F.col("_v.end_date")).otherwise(F.date_sub("_next", 1))
    current = F.when(F.col("_valid"), F.col("_v.is_current")).otherwise(F.col("_next").isNull())
    todo = found.filter(~F.col("_again")).select(
        (~F.col("_valid")).cast("int").alias("_group"), *names, (F.coalesce("_last", F.lit(0)) + 1).alias("version"),
        until.alias("end_date"), current.alias("is_current")
    )
    added = numbered(todo, key, ["_group", *names], after=_largest(dim, key, after)).withColumns({"effective_date": day, **{c: loaded for c in stamps}})
    return old.unionByName(added.select(*[F.col(c).cast(kinds[c]).alias(c) for c in dim.columns]))


def scd1(dim: DataFrame, batch: DataFrame, key: str, natural: list[str], after: DataFrame | None = None) -> DataFrame:
    """Type 1: matched members take the batch's attributes, nulls too; new members get keys after the largest."""
    names = [c for c in dim.columns if c != key]
    b = one_per_key(batch.select(*[c for c in names if c in batch.columns]), natural)
    hit = b.withColumn("_hit", F.lit(True))
    cols = [
        F.when(F.col("b._hit"), F.col(f"b.{c}")).otherwise(F.col(f"d.{c}")).alias(c) if c in b.columns and c not in natural else F.col(f"d.{c}").alias(c) for c in dim.columns
    ]
    old = dim.alias("d").join(hit.alias("b"), _on(natural, "d", "b"), "left").select(*cols)
    new = b.join(dim.select(*natural).distinct(), natural, "left_anti")
    new = numbered(new, key, [c for c in names if c in b.columns], after=_largest(dim, key, after))
    return old.unionByName(new, allowMissingColumns=True)


def scd0(dim: DataFrame, batch: DataFrame, key: str, natural: list[str], after: DataFrame | None = None) -> DataFrame:
    """Type 0: known members never change; new members are added."""
    new = one_per_key(batch, natural).join(dim.select(*natural).distinct(), natural, "left_anti")
    return dim.unionByName(numbered(new, key, [c for c in dim.columns if c in batch.columns], after=_largest(dim, key, after)))


def scd3(dim: DataFrame, batch: DataFrame, natural: list[str], attribute: str) -> DataFrame:
    """Type 3: the value before the last change stands in previous_<attribute>."""
    prev = f"previous_{attribute}"
    d = dim if prev in dim.columns else dim.withColumn(prev, F.lit(None).cast(dim.schema[attribute].dataType))
    b = one_per_key(batch.select(*natural, attribute), natural).withColumn("_hit", F.lit(True))
    moved = F.col("b._hit") & ~F.col(f"b.{attribute}").eqNullSafe(F.col(f"d.{attribute}"))
    cols = [
        F.when(moved, F.col(f"b.{c}")).otherwise(F.col(f"d.{c}")).alias(c) if c == attribute else F.when(moved, F.col(f"d.{attribute}")).otherwise(F.col(f"d.{c}")).alias(c) if c == prev else F.col(f"d.{c}").alias(c) for c in d.columns
    ]
    return d.alias("d").join(b.alias("b"), _on(natural, "d", "b"), "left").select(*cols)


def scd4(dim: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Type 4: (current members, their history) of a type 2 dimension."""
    return dim.filter("is_current").drop("end_date", "is_current"), dim.filter(~F.col("is_current"))


def inferred_members(facts: DataFrame, dim: DataFrame, key: str, natural: list[str]) -> DataFrame:
    """Placeholder members for natural keys that facts name and the dimension lacks."""
    missing = facts.select(*natural).dropna().distinct().join(dim.select(*natural), natural, "left_anti")
    return numbered(missing, key, natural, after=dim.agg(F.max(key).alias("k"))).withColumn("is_inferred", F.lit(True))


def dim_date(spark: SparkSession, first: str, last: str, fiscal_start: int = 1) -> DataFrame:
    """One row a day with 23 columns: keys, names, week, month, quarter, year, fiscal, flags and neighbouring keys."""
    key = lambda c: F.date_format(c, "yyyyMMdd").cast("int")
    d = F.col("full_date")
    fiscal = F.add_months(d, (13 - fiscal_start) % 12)
    fixed = F.date_format(d, "MM-dd").isin("01-01", "07-04", "12-25")
    return spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("full_date")).select(
        key(d).alias("date_key"), d, (F.weekday(d) + 1).alias("day_of_week"), F.date_format(d, "EEEE").alias("day_name"), F.dayofmonth(d).alias("day_of_month"), F.dayofyear(d).alias("day_of_year"),
        F.weekofyear(d).alias("week_of_year"), F.month(d).alias("month_number"), F.date_format(d, "MMMM").alias("month_name"), F.quarter(d).alias("quarter_number"), F.year(d).alias("year_number"),
        F.date_format(d, "yyyy-MM").alias("year_month"), F.quarter(fiscal).alias("fiscal_quarter"), F.year(fiscal).alias("fiscal_year"), (F.weekday(d) >= 5).alias("is_weekend"), fixed.alias("is_holiday"),
        (d == F.last_day(d)).alias("is_month_end"), F.trunc(d, "month").alias("month_start"), F.last_day(d).alias("month_end"), key(F.date_sub(d, 1)).alias("prior_day_key"), key(F.date_add(d, 1)).alias("next_day_key"),
        key(F.add_months(d, -1)).alias("prior_month_key"), key(F.add_months(d, -12)).alias("prior_year_key"),
    )


def dim_version(spark: SparkSession) -> DataFrame:
    """The fixed planning versions."""
    rows = [(1, "ACTUAL", "Actual", 1), (2, "PLAN", "Plan", 2), (3, "FORECAST", "Forecast", 3), (4, "REFORECAST", "Reforecast", 4)]
    return spark.createDataFrame(rows, "version_key int, version_code string, version_name string, display_order int")


def scd2_integrity(dim: DataFrame, natural: list[str]) -> DataFrame:
    """One row a fault: members without exactly one current row, and versions that overlap the next."""
    by = dim.groupBy(*natural).agg(F.sum(F.col("is_current").cast("int")).cast("long").alias("n"))
    current = by.filter("n <> 1").select(*natural, F.lit("current_rows").alias("fault"), "n")
    w = W.partitionBy(*natural).orderBy("effective_date", "version")
    over = dim.withColumn("_next", F.lead("effective_date").over(w)).filter(F.coalesce("end_date", F.lit("9999-12-31").cast("date")) >= F.col("_next"))
    return current.unionByName(over.groupBy(*natural).agg(F.count("*").alias("n")).select(*natural, F.lit("overlap").alias("fault"), "n"))
