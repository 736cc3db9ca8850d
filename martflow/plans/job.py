"""A file's way through: route, read, reconcile, merge, dimensions, facts, checks, audit, lifecycle."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martflow.config import DimSpec, FactSpec, JobSpec, find_job
from martflow.functions.timefn import date_key
from martflow.operators import audit, dimensions, facts, merge, quality, schema
from martflow.sources import ingest
from martflow.sources.store import SnapshotTable, lifecycle_path, move


@dataclass
class Outcome:
    outcome: str
    run_id: str | None = None
    version: int | None = None
    metrics: dict | None = None
    model_error: str | None = None
    moved_to: str | None = None


class Warehouse:
    """Snapshot tables under one root."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def table(self, name: str) -> SnapshotTable:
        return SnapshotTable(self.spark, f"{self.root}/{name}")

    def calendar(self, first: date, last: date) -> SnapshotTable:
        """dim_date with all days of the years from first to last; years that it lacks are added."""
        table = self.table("dim_date")
        have = set() if not table.exists() else {r[0] for r in table.read().select("year_number").distinct().collect()}
        for y in sorted(set(range(first.year, last.year + 1)) - have):
            table.append(dimensions.dim_date(self.spark, f"{y}-01-01", f"{y}-12-31"))
        return table

    def versions(self) -> SnapshotTable:
        """dim_version with its fixed rows."""
        table = self.table("dim_version")
        if not table.exists():
            table.write(dimensions.dim_version(self.spark))
        return table


def load_dimension(house: Warehouse, spec: DimSpec, batch: DataFrame, as_of) -> int:
    """The batch into a dimension of any type; the first load creates it. Only buckets with members of the batch are written."""
    table, rows = house.table(spec.dimension_table), dimensions.project(batch, spec.column_mappings)
    rows, _ = quality.key_null_guard(rows, spec.natural_keys)
    if not table.exists():
        first = dimensions.one_per_key(rows, spec.natural_keys)
        first = dimensions.stamped(first, as_of, F.current_timestamp()) if spec.scd_type == 2 else first
        return table.merge(dimensions.numbered(first, spec.key, list(spec.column_mappings)), spec.natural_keys, lambda _, new: new)
    after = table.read().agg(F.max(spec.key).alias("k"))

    def change(dim: DataFrame, new: DataFrame) -> DataFrame:
        if spec.scd_type == 2:
            return dimensions.scd2(dim, new, spec.key, spec.natural_keys, spec.scd_attributes, as_of, after=after)
        if spec.scd_type == 1:
            return dimensions.scd1(dim, new, spec.key, spec.natural_keys, after=after)
        grown = dimensions.scd0(dim, new, spec.key, spec.natural_keys, after=after)
        return dimensions.scd3(grown, new, spec.natural_keys, spec.scd_attributes[0]) if spec.scd_type == 3 else grown

    return table.merge(rows, spec.natural_keys, change)


def _fixed(house: Warehouse, name: str, batch: DataFrame, day: str) -> DataFrame:
    """A dimension to look up in; the calendar and the versions are made where they lack."""
    if name == "dim_version":
        return house.versions().read()
    if name == "dim_date" and day in batch.columns:
        one = batch.agg(F.min(F.col(day).cast("date")).alias("a"), F.max(F.col(day).cast("date")).alias("b")).first()
        if one.a is not None:
            return house.calendar(one.a, one.b).read()
    return house.table(name).read()


def load_fact(house: Warehouse, spec: FactSpec, dims: dict[str, DimSpec], batch: DataFrame, loaded) -> int:
    """The batch's facts with their surrogate keys; facts of the same degenerate dimensions are replaced.

    Natural keys are read under their dimension's names or the feed's; a date_key that the feed lacks is its business day
    as yyyyMMdd. A lookup with as_of takes the version that was valid on that column's day, others the current one.
    """
    source = {n: F.col(n) for n in batch.columns}
    for d in dims.values():
        source |= {n: F.col(s) for n, s in d.column_mappings.items() if n not in source and s in source}
    if "date_key" not in source and spec.date_column in source:
        source["date_key"] = date_key(F.col(spec.date_column).cast("date"))
    used = {k for look in spec.dimension_lookups for k in (*look["natural_keys"], *filter(None, [look.get("as_of")]))}
    if lost := sorted(k for k in used if k not in source):
        raise ValueError(f"{spec.fact_table}: the feed has no {', '.join(lost)}")
    found = batch.withColumns(
        {f"_n_{k}": source[k].cast("date") if any(k == look.get("as_of") for look in spec.dimension_lookups) else source[k] for k in used}
    )
    rows = facts.project(found, spec.mapping, [f"_n_{k}" for k in sorted(used)], loaded)
    for look in spec.dimension_lookups:
        dim = _fixed(house, look["dimension"], batch, spec.date_column)
        kind = dims[look["dimension"]].scd_type if look["dimension"] in dims else 2 if "is_current" in dim.columns else 1
        natural = {f"_n_{k}": k for k in look["natural_keys"]}
        if look.get("as_of"):
            rows = facts.lookup_as_of(rows, dim, natural, look["surrogate_key"], f"_n_{look['as_of']}")
        else:
            rows = facts.lookup_current(rows, dim, natural, look["surrogate_key"], scd_type=kind)
    rows = rows.drop(*[f"_n_{k}" for k in used])
    table = house.table(spec.fact_table)
    if not spec.degenerate_dimensions:
        return table.append(rows)
    return table.merge(rows, spec.degenerate_dimensions, lambda old, new: merge.replace_by_key(old.select(*new.columns), new, spec.degenerate_dimensions))


def load_base(table: SnapshotTable, batch: DataFrame, keys: list[str]) -> tuple[DataFrame, dict, int]:
    """The batch into its table by group replacement: (the batch in the table's columns, counts, version).

    New columns are added, texts and integers of the table grow where the batch needs it, and text that would land in a
    numeric column is an error. Only the buckets that the batch touches are written.
    """
    if not table.exists():
        n = batch.count()
        counts = {"rows_read": n, "rows_deleted": 0, "rows_after": n, "inserted_est": n, "updated_est": 0}
        return batch, counts, table.merge(batch, keys, lambda _, new: new, counts, schema=schema.grown(schema.with_lengths(batch.schema, {}), batch))
    base = table.current()
    wide = schema.grown(schema.widened(table.schema(), batch), batch)
    if bad := schema.type_guard(batch, wide).collect():
        raise ValueError("; ".join(f"{r.column_name}: {r.source_type} does not go into {r.target_type}" for r in bad))
    rows = schema.align(batch, wide)
    counts = merge.merge_metrics(table.read(), rows, keys).first().asDict()
    change = lambda old, new: merge.replace_by_key(schema.align(old, wide, policy="null"), new, keys)
    return rows, counts, table.merge(rows, keys, change, counts, expect=base, schema=wide)


def run_job(
    spark: SparkSession, house: Warehouse, root: str, path: str, jobs: list[JobSpec], models: dict | None = None,
    now: datetime | None = None, checks=None
) -> Outcome:
    """One file, from arrival to archive.

    The base load is one atomic version of its table. A failure of the model part, or of the move to the archive, keeps
    the base load and is told in the audit row; a failure before that moves the file to unprocessed, writes a FAILED row
    and is raised, whatever becomes of the move. Results of checks are added to data_quality_results.
    """
    now = now or datetime.now()
    stamp, name = now.strftime("%Y%m%d%H%M%S"), path.rstrip("/").rsplit("/", 1)[-1]
    job, outcome = find_job(jobs, path)
    if outcome != "triggered":
        return Outcome(outcome, moved_to=move(spark, path, lifecycle_path(root, name, "not_configured", stamp)))
    run_id = str(uuid.uuid4())
    again = audit.retry(attempts=3, base=0.1)
    put = again(lambda row: house.table("job_sts").append(row))
    entry = {"run_id": run_id, "job_id": job.job_id, "run_start_ts": now, "source_filename": name, "target_table": job.target_table}
    batch = None
    try:
        batch = ingest.read_csv(spark, path, job.upsert_keys, F.lit(now)).persist()
        table = house.table(job.target_table)
        rows, counts, version = load_base(table, batch, job.upsert_keys)
    except Exception as e:
        said = str(e)
        try:
            move(spark, path, lifecycle_path(root, name, "failed", stamp))
        except Exception as m:
            said = f"{said[:3000]}; the file stays: {m}"
        put(
            audit.log_row(
                spark, **entry, run_end_ts=datetime.now(), records_read=0, records_updated=0, records_inserted=0, status="FAILED",
                error_message=said[:4000]
            )
        )
        if batch is not None:
            batch.unpersist()
        raise
    errors, target = [], None
    try:
        dims, fact_specs = (models or {}).get(job.target_table, ([], []))
        for d in dims:
            load_dimension(house, d, rows, now.date())
        for f in fact_specs:
            load_fact(house, f, {d.dimension_table: d for d in dims}, rows, F.lit(now))
        if checks is not None:
            found = quality.logged(checks(table.read()), run_id, F.lit(now))
            again(lambda: house.table("data_quality_results").append(found))()
            quality.require(found)
    except Exception as e:
        errors.append(f"model: {e}")
    try:
        target = move(spark, path, lifecycle_path(root, name, "archive", stamp))
    except Exception as e:
        errors.append(f"archive: {e}")
    error = "; ".join(errors)[:4000] or None
    put(
        audit.log_row(
            spark, **entry, run_end_ts=datetime.now(), records_read=counts["rows_read"], records_updated=counts["updated_est"],
            records_inserted=counts["inserted_est"], status="SUCCESS", error_message=error
        )
    )
    batch.unpersist()
    return Outcome("loaded", run_id, version, counts, error, target)
