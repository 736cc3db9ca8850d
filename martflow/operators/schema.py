"""Schema contracts: type maps, reconciliation with a target, widening, ambiguity and quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Warehouse type names by Spark type.
DDL = {
    "string": "VARCHAR(256)", "int": "INTEGER", "smallint": "SMALLINT", "bigint": "BIGINT", "float": "REAL", "double": "DOUBLE PRECISION",
    "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "binary": "VARBYTE"
}
#: Spark types by warehouse type name.
SPARK = {
    "varchar": T.StringType(), "char": T.StringType(), "character varying": T.StringType(), "text": T.StringType(), "int": T.IntegerType(), "integer": T.IntegerType(), "int4": T.IntegerType(), "smallint": T.ShortType(), "int2": T.ShortType(), "bigint": T.LongType(), "int8": T.LongType(),
    "real": T.FloatType(), "float4": T.FloatType(), "float": T.DoubleType(), "float8": T.DoubleType(), "double precision": T.DoubleType(), "decimal": T.DecimalType(38, 18), "numeric": T.DecimalType(38, 18), "boolean": T.BooleanType(), "bool": T.BooleanType(), "date": T.DateType(),
    "timestamp": T.TimestampNTZType(), "timestamp without time zone": T.TimestampNTZType(), "varbyte": T.BinaryType(),
}
DEFAULTS = {"string": "", "int": 0, "smallint": 0, "bigint": 0, "float": 0.0, "double": 0.0, "boolean": False, "binary": bytearray()}
INTEGERS = [("smallint", 2**15 - 1), ("int", 2**31 - 1), ("bigint", 2**63 - 1)]
MOST_VARCHAR = 65_535


def warehouse_type(t: T.DataType) -> str:
    if isinstance(t, T.DecimalType):
        return f"DECIMAL({t.precision},{t.scale})"
    return DDL.get(t.simpleString(), "VARCHAR(256)")


def spark_type(name: str) -> T.DataType:
    base, _, args = name.lower().partition("(")
    if base.strip() in ("decimal", "numeric") and args:
        p, _, s = args.rstrip(")").partition(",")
        return T.DecimalType(int(p), int(s or 0))
    return SPARK.get(base.strip(), T.StringType())


def length_of(field: T.StructField) -> int | None:
    """The warehouse length of a text column, kept in its metadata."""
    return (field.metadata or {}).get("max_length")


def with_lengths(schema: T.StructType, lengths: dict[str, int], default: int = 256) -> T.StructType:
    """The schema whose text columns carry a length: that of lengths, or their own, or the default."""
    out = []
    for f in schema.fields:
        known = {k: v for k, v in (f.metadata or {}).items() if k != "max_length"}
        text = {"max_length": lengths.get(f.name) or length_of(f) or default} if isinstance(f.dataType, T.StringType) else {}
        out.append(T.StructField(f.name, f.dataType, f.nullable, known | text))
    return T.StructType(out)


def alter_lengths(schema: T.StructType, lengths: dict[str, int]) -> T.StructType:
    """The schema with text columns grown to lengths; a column never shrinks, nor grows over MOST_VARCHAR."""
    return with_lengths(schema, {f.name: min(max(lengths.get(f.name, 0), length_of(f) or 256), MOST_VARCHAR) for f in schema.fields})


def column_metadata(spark, schema: T.StructType) -> DataFrame:
    """(column_name, data_type, max_length, is_nullable) of a table's schema, in order."""
    rows = [
        (i + 1, f.name, warehouse_type(f.dataType).partition("(")[0] if length_of(f) else warehouse_type(f.dataType), length_of(f), f.nullable) for i,
        f in enumerate(schema.fields)
    ]
    return spark.createDataFrame(rows, "ordinal int, column_name string, data_type string, max_length int, is_nullable boolean")


def create_table_ddl(table: str, schema: T.StructType, keys: list[str], using: str | None = None) -> str:
    """CREATE TABLE of a frame's schema; keys are NOT NULL. In warehouse types, or in Spark's own for a table `using` a source."""
    kind = (lambda t: t.simpleString()) if using else warehouse_type
    cols = ", ".join(f"{f.name} {kind(f.dataType)}{' NOT NULL' if f.name in keys else ''}" for f in schema.fields)
    return f"CREATE TABLE {table} ({cols})" + (f" USING {using}" if using else "")


def grown(target: T.StructType, df: DataFrame) -> T.StructType:
    """The target's schema, wide enough for df: texts as long as its longest (plus 10), integers of its least and largest.

    One pass over df. An integer grows to the smallest type that holds both; a text not over MOST_VARCHAR.
    """
    have = set(df.columns)
    texts = {f.name: length_of(f) or 256 for f in target.fields if f.name in have and isinstance(f.dataType, T.StringType)}
    whole = {
        f.name: f.dataType.simpleString() for f in target.fields if f.name in have and f.dataType.simpleString() in dict(INTEGERS) and isinstance(
            df.schema[f.name].dataType, T.IntegralType
        )
    }
    if not texts and not whole:
        return target
    need = {r.column_name: r.needed_type for r in widen_report(df, texts, whole).collect()}
    lengths = {c: int(t[8:-1]) for c, t in need.items() if c in texts}
    out = alter_lengths(target, lengths)
    return T.StructType(
        [T.StructField(f.name, spark_type(need[f.name]) if f.name in whole and f.name in need else f.dataType, f.nullable, f.metadata) for f in out.fields]
    )


def default_for(t: T.DataType) -> Column:
    if isinstance(t, T.DecimalType):
        return F.lit(0).cast(t)
    return F.lit(DEFAULTS.get(t.simpleString())).cast(t)


def backfill(df: DataFrame, target: T.StructType, policy: str = "default") -> DataFrame:
    """df with the target's columns that it lacks: the type's default value, or null (policy="null")."""
    have = set(df.columns)
    return df.withColumns(
        {f.name: default_for(f.dataType) if policy == "default" else F.lit(None).cast(f.dataType) for f in target.fields if f.name not in have}
    )


def widened(target: T.StructType, df: DataFrame) -> T.StructType:
    """The target's schema with the columns that only df has added, nullable."""
    have = {f.name for f in target.fields}
    return T.StructType([*target.fields, *[T.StructField(f.name, f.dataType, True, f.metadata) for f in df.schema.fields if f.name not in have]])


def align(df: DataFrame, target: T.StructType, policy: str = "default") -> DataFrame:
    """df in the target's columns, order and types, after backfill; columns the target lacks are dropped."""
    full = backfill(df, target, policy)
    return full.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in target.fields])


def widen_report(df: DataFrame, varchar: dict[str, int], integers: dict[str, str]) -> DataFrame:
    """(column, current, needed) of the columns that must grow, in one pass: text lengths, and integer ranges by min and max."""
    aggs = [F.coalesce(F.max(F.length(c)), F.lit(0)).cast("long").alias(f"len_{c}") for c in varchar]
    aggs += [f(c).cast("decimal(38,0)").alias(f"{n}_{c}") for c in integers for n, f in (("min", F.min), ("max", F.max))]
    one = df.agg(*aggs)
    rows = []
    for c, n in varchar.items():
        need = F.least(F.col(f"len_{c}") + 10, F.lit(MOST_VARCHAR))
        rows.append(
            F.struct(
                F.lit(c).alias("column_name"), F.lit(f"varchar({n})").alias("current_type"),
                F.when(F.col(f"len_{c}") > n, F.concat(F.lit("varchar("), need.cast("string"), F.lit(")"))).alias("needed_type")
            )
        )
    order = [t for t, _ in INTEGERS]
    for c, t in integers.items():
        need = F.lit("bigint")
        for name, most in reversed(INTEGERS[:-1]):
            need = F.when((F.col(f"max_{c}") <= most) & (F.col(f"min_{c}") >= -most - 1), name).otherwise(need)
        need = F.when(F.col(f"max_{c}").isNull(), t).otherwise(need)
        grows = F.array_position(F.array(*map(F.lit, order)), need) > order.index(t) + 1
        rows.append(F.struct(F.lit(c).alias("column_name"), F.lit(t).alias("current_type"), F.when(grows, need).alias("needed_type")))
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*").filter("needed_type is not null")


def contract_diff(spark, old: T.StructType, new: T.StructType, keys: list[str], lengths: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """(column, change, is_breaking): additions and text growth are safe; removals, type changes and key changes break."""
    a, b, lengths = {f.name: f for f in old.fields}, {f.name: f for f in new.fields}, lengths or {}
    rows = [(c, "key_removed" if c in keys else "removed", True) for c in a if c not in b]
    rows += [(c, "added" if f.nullable else "added_not_null", not f.nullable) for c, f in b.items() if c not in a]
    for c in a:
        if c in b and a[c].dataType != b[c].dataType:
            rows.append((c, f"{'key_' if c in keys else ''}type {a[c].dataType.simpleString()} -> {b[c].dataType.simpleString()}", True))
        elif c in b and c in lengths and lengths[c][0] != lengths[c][1]:
            rows.append((c, "varchar_grown" if lengths[c][1] > lengths[c][0] else "varchar_shrunk", lengths[c][1] < lengths[c][0]))
    return spark.createDataFrame(rows, "column_name string, change string, is_breaking boolean")


def type_guard(df: DataFrame, target: T.StructType) -> DataFrame:
    """(column, source_type, target_type, n_values) of text columns that would land in numeric ones with values; one pass."""
    numeric = (T.NumericType,)
    bad = [
        (
            f.name, df.schema[f.name].dataType, f.dataType
        ) for f in target.fields if f.name in df.columns and isinstance(f.dataType, numeric) and not isinstance(df.schema[f.name].dataType, numeric)
    ]
    if not bad:
        return df.sparkSession.createDataFrame([], "column_name string, source_type string, target_type string, n_values long")
    one = df.agg(*[F.count(c).alias(c) for c, *_ in bad])
    rows = [
        F.struct(
            F.lit(c).alias("column_name"), F.lit(s.simpleString()).alias("source_type"), F.lit(t.simpleString()).alias("target_type"),
            F.col(c).alias("n_values")
        ) for c,
        s, t in bad
    ]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*").filter("n_values > 0")


def choice_cast(df: DataFrame, column: str, kind: str) -> DataFrame:
    """The column in one type; what does not fit is null."""
    return df.withColumn(column, F.col(column).try_cast(kind))


def choice_columns(df: DataFrame, column: str, kinds: list[str]) -> DataFrame:
    """One column for each type, <column>_<type>, each holding the values that fit it and no type before."""
    out, taken = {}, F.lit(False)
    for k in kinds:
        value = F.col(column).try_cast(k)
        out[f"{column}_{k}"] = F.when(~taken, value)
        taken = taken | value.isNotNull()
    return df.withColumns(out).drop(column)


def choice_struct(df: DataFrame, column: str, kinds: list[str]) -> DataFrame:
    """The column as a struct of one field for each type."""
    return df.withColumn(column, F.struct(*[F.col(column).try_cast(k).alias(k) for k in kinds]))


def choice_project(df: DataFrame, column: str, kind: str) -> DataFrame:
    """The rows whose value fits the type, cast."""
    return choice_cast(df.filter(F.col(column).try_cast(kind).isNotNull()), column, kind)


def apply_mapping(df: DataFrame, mapping: list[tuple[str, str, str, str]]) -> DataFrame:
    """Rename, cast and reorder: (source, source type, target, target type)."""
    return df.select(*[F.col(s).try_cast(t).alias(n) for s, _, n, t in mapping])


def flatten(df: DataFrame, sep: str = "_") -> DataFrame:
    """Struct fields as columns of their own, to any depth."""
    while any(isinstance(f.dataType, T.StructType) for f in df.schema.fields):
        df = df.select(
            *[
                c for f in df.schema.fields for c in (
                    [
                        F.col(f"`{f.name}`.`{g.name}`").alias(f"{f.name}{sep}{g.name}") for g in f.dataType.fields
                    ] if isinstance(f.dataType, T.StructType) else [F.col(f"`{f.name}`")]
                )
            ]
        )
    return df


def relationalize(df: DataFrame, key: str) -> dict[str, DataFrame]:
    """{"root": scalars, column: (key, index, element)}: every array column as a table of its own."""
    flat = flatten(df)
    arrays = [f.name for f in flat.schema.fields if isinstance(f.dataType, T.ArrayType)]
    return {"root": flat.drop(*arrays)} | {a: flatten(flat.select(key, F.posexplode(a).alias("index", "element"))) for a in arrays}


def unbox(df: DataFrame, column: str, schema: str) -> DataFrame:
    """A text column of JSON as a struct."""
    return df.withColumn(column, F.from_json(column, schema))


def drop_null_columns(df: DataFrame) -> DataFrame:
    """Without the columns that hold no value at all; one pass."""
    n = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns]).first()
    return df.select(*[c for c in df.columns if n[c]])


def split_rows(df: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """(rows that meet the condition, the others); unknown counts as not met."""
    met = F.coalesce(condition, F.lit(False))
    return df.filter(met), df.filter(~met)


def split_fields(df: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    return df.select(*columns), df.select(*[c for c in df.columns if c not in columns])


def quarantine(df: DataFrame, kinds: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(good rows cast, bad rows as they came with reason): a row is bad if a value is present and does not fit its type."""
    bad = {c: F.col(c).isNotNull() & F.col(c).try_cast(t).isNull() for c, t in kinds.items()}
    reason = F.array_join(F.filter(F.array(*[F.when(b, F.lit(c)) for c, b in bad.items()]), lambda x: x.isNotNull()), ",")
    marked = df.withColumn("reason", reason)
    good = marked.filter("reason = ''").drop("reason").withColumns({c: F.col(c).cast(t) for c, t in kinds.items()})
    return good, marked.filter("reason <> ''")
