"""Job audit: log rows, history, summary, health, purging, log analytics, routing and the file ledger."""

from __future__ import annotations

import json
import logging
import random
import time
import uuid
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from martflow.functions.timefn import datediff_boundary, ratio

JOB_LOG = "run_id string, job_id string, run_start_ts timestamp, run_end_ts timestamp, source_filename string, target_table string, records_read long, records_updated long, records_inserted long, status string, error_message string"


def log_row(spark: SparkSession, **values) -> DataFrame:
    """One row of the job log; what is not given is null, run_id a fresh uuid."""
    names = [c.split()[0] for c in JOB_LOG.split(", ")]
    return spark.createDataFrame([tuple(({"run_id": str(uuid.uuid4())} | values).get(n) for n in names)], JOB_LOG)


def history(log: DataFrame) -> DataFrame:
    """The log with its duration in second boundaries."""
    return log.withColumn("duration_seconds", datediff_boundary("second", F.col("run_start_ts"), F.col("run_end_ts")))


def summary(log: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """By job: runs, successes, failures, success rate in percent, average seconds, rows, last run; of the last days."""
    recent = history(log.filter(F.col("run_start_ts") >= now - F.expr(f"INTERVAL {int(days)} DAYS")))
    ok, bad = F.count_if(F.col("status") == "SUCCESS"), F.count_if(F.col("status") == "FAILED")
    by = recent.groupBy("job_id").agg(
        F.count("*").alias("total_runs"), ok.alias("successful_runs"), bad.alias("failed_runs"),
        F.round(F.avg("duration_seconds"), 1).alias("avg_duration_seconds"), F.sum("records_read").alias("total_records"),
        F.max("run_start_ts").alias("last_run_ts")
    )
    return by.withColumn("success_rate", ratio(F.col("successful_runs"), F.col("total_runs"), 100, 1))


def active_tables(log: DataFrame, now: Column, days: int) -> DataFrame:
    return log.filter((F.col("status") == "SUCCESS") & (F.col("run_start_ts") >= now - F.expr(f"INTERVAL {int(days)} DAYS"))).select("target_table").distinct()


def purge(log: DataFrame, at: str, now: Column, days: int) -> tuple[DataFrame, DataFrame]:
    """(rows to keep, one row with the number purged)."""
    old = F.col(at) < now - F.expr(f"INTERVAL {int(days)} DAYS")
    return log.filter(~F.coalesce(old, F.lit(False))), log.agg(F.count_if(old).alias("n_purged"))


def table_health(stats: DataFrame) -> DataFrame:
    """stats (table_name, unsorted, stats_off) with what each table needs."""
    need = F.when(F.col("unsorted") > 20, "NEEDS VACUUM").when(F.col("stats_off") > 10, "NEEDS ANALYZE").otherwise("OK")
    return stats.withColumn("health_status", need)


def outcome_counts(lines: DataFrame, message: str = "message") -> DataFrame:
    """How often each outcome occurs in router log lines that hold outcome=<word>."""
    found = lines.select(F.regexp_extract(message, r"outcome=(\w+)", 1).alias("outcome")).filter("outcome <> ''")
    return found.groupBy("outcome").agg(F.count("*").alias("n"))


def unconfigured_files(lines: DataFrame, message: str = "message") -> DataFrame:
    """How often files went to each place for want of a configuration."""
    found = lines.filter(F.contains(message, F.lit("outcome=not_configured"))).select(
        F.regexp_extract(message, r"moved_to=(\S+)", 1).alias("moved_to")
    ).filter("moved_to <> ''")
    return found.groupBy("moved_to").agg(F.count("*").alias("n"))


def daily_stats(log: DataFrame) -> DataFrame:
    """By day: successful runs, average and largest duration and row count."""
    by = history(log.filter("status = 'SUCCESS'")).groupBy(F.to_date("run_start_ts").alias("day"))
    return by.agg(
        F.count("*").alias("n_success"), F.round(F.avg("duration_seconds"), 2).alias("avg_duration"),
        F.max("duration_seconds").alias("max_duration"), F.round(F.avg("records_read"), 2).alias("avg_records"),
        F.max("records_read").alias("max_records")
    )


def error_tail(log: DataFrame, n: int = 100) -> DataFrame:
    """The last n failures: a top-k, no full sort."""
    return log.filter("status = 'FAILED'").orderBy(F.desc("run_start_ts"), "run_id").limit(n)


def route_files(files: DataFrame, jobs: DataFrame, path: str = "path") -> DataFrame:
    """files (path) with the job of their base name (in any case) and the outcome: triggered, inactive or not_configured.

    jobs: source_file_name, job_id, is_active. Of several jobs for a name the first by job_id counts.
    """
    low = lambda c: F.lower(F.trim(c))
    known = jobs.groupBy(low(F.element_at(F.split("source_file_name", "/"), -1)).alias("_name")).agg(F.min(F.struct("job_id", "is_active")).alias("_j"))
    base = F.element_at(F.split(path, "/"), -1)
    outcome = F.when(F.col("_j").isNull(), "not_configured").when(~F.coalesce(F.col("_j.is_active"), F.lit(False)), "inactive").otherwise("triggered")
    return files.withColumn("_name", low(base)).join(known, "_name", "left").select(
        *files.columns, F.col("_j.job_id").alias("job_id"), outcome.alias("outcome")
    )


def pending_files(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """files (key, etag) without a DONE entry for the same content in the ledger (key, etag, status)."""
    return files.join(ledger.filter("status = 'DONE'").select("key", "etag"), ["key", "etag"], "left_anti")


def route_by_pattern(files: DataFrame, rules: DataFrame, path: str = "path") -> DataFrame:
    """files (path) with the job of the first rule that fits: rules (priority, kind, pattern, job_id), kind prefix or regex.

    Prefixes fit the start of the whole path, patterns any part of its base name, both in any case. Rules are a
    configuration: as many rows as jobs. No rule: job_id is null and the outcome not_configured.
    """
    low, base = F.lower(F.trim(F.col(path))), F.lower(F.element_at(F.split(path, "/"), -1))
    fits = F.when(F.col("kind") == "prefix", F.startswith(low, F.lower("pattern"))).otherwise(F.rlike(base, F.lower("pattern")))
    known = F.broadcast(rules.select("priority", "kind", "pattern", F.col("job_id").alias("_job")))
    hits = files.select(path).distinct().join(known, fits).groupBy(path).agg(F.min(F.struct("priority", "_job")).alias("_r"))
    out = files.join(hits, path, "left").select(*[F.col(c) for c in files.columns], F.col("_r._job").alias("job_id"))
    return out.withColumn("outcome", F.when(F.col("job_id").isNull(), "not_configured").otherwise("triggered"))


def health(spark: SparkSession, tables: dict) -> DataFrame:
    """table_health of snapshot tables by name, from their own statistics."""
    rows = [(n, s["rows"], s["bytes"], s["files"], float(s["unsorted"]), float(s["stats_off"])) for n, s in ((n, t.stats()) for n, t in tables.items())]
    return table_health(spark.createDataFrame(rows, "table_name string, rows long, bytes long, files int, unsorted double, stats_off double"))


class JsonFormatter(logging.Formatter):
    """One JSON object a line; extra fields under `fields`."""

    def format(self, record: logging.LogRecord) -> str:
        out = {
            "ts": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime(record.created)), "level": record.levelname, "msg": record.getMessage(),
            **getattr(record, "fields", {})
        }
        return json.dumps(out, default=str)


def run_logger(run_id: str, path: str) -> logging.Logger:
    """A logger that writes JSON lines to a file of its run."""
    log = logging.getLogger(f"martflow.{run_id}")
    log.setLevel(logging.INFO)
    handler = logging.FileHandler(path)
    handler.setFormatter(JsonFormatter())
    log.addHandler(handler)
    log.propagate = False
    return log


def retry(attempts: int = 3, base: float = 5, most: float = 120, on: tuple = (Exception,), jitter: float = 0.0, sleep=time.sleep):
    """Run again after a failure: waits min(base * 2 ** (n - 1), most) seconds after the n-th."""

    def wrap(f):
        @wraps(f)
        def run(*args, **kwargs):
            for n in range(1, attempts + 1):
                try:
                    return f(*args, **kwargs)
                except on:
                    if n == attempts:
                        raise
                    sleep(min(base * 2 ** (n - 1), most) * (1 + jitter * random.random()))

        return run

    return wrap
