import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from martflow import config
from martflow.operators import quality
from martflow.plans import job as J
from martflow.sources.store import Conflict, SnapshotTable, refresh, write_csv_single

JOBS = json.dumps([
    {"job_id": "J1", "source_file_name": "Funds.csv", "target_table": "funds", "upsert_keys": ["fund_code", "report_date"], "glue_job": "data_model"},
    {"job_id": "J2", "source_file_name": "off.csv", "target_table": "off", "upsert_keys": ["a"], "is_active": False},
])
MODELS = json.dumps([{
    "source_table": "funds",
    "dimensions": [
        {
            "dimension_table": "dim_fund", "natural_keys": ["code"], "scd_type": 2, "scd_attributes": ["name"],
            "column_mappings": {"code": "fund_code", "name": "fund_name"}
        }
    ],
    "facts": [
        {
            "fact_table": "fact_aum",
            "dimension_lookups": [{"dimension": "dim_fund", "natural_keys": ["code"], "surrogate_key": "fund_key"}], "measures": ["aum"],
            "degenerate_dimensions": ["tx"], "degenerate_mappings": {"tx": "transaction_id"}
        }
    ],
}])


def test_snapshots(spark, tmp_path):
    t = SnapshotTable(spark, f"file://{tmp_path}/t")
    assert not t.exists() and t.current() is None
    one = spark.createDataFrame([(1,), (2,)], "a int")
    assert t.write(one, now=100.0) == 1
    assert t.update(lambda d: d.withColumn("a", F.col("a") * 10), {"n": 2}) == 2
    assert sorted(r.a for r in t.read().collect()) == [10, 20] and sorted(
        r.a for r in t.read(version=1).collect()
    ) == [1, 2] and t.read(as_of=150.0).count() == 2
    with pytest.raises(Conflict):
        t.write(one, expect=1)
    t.tag("audit", 1)
    assert t.rollback(1) == 3 and sorted(r.a for r in t.read().collect()) == [1, 2]
    assert t.compact(1) == 4 and t.stats()["files"] == 1 and t.stats()["rows"] == 2
    assert t.vacuum(keep=1) == [2, 3] and t.read(tag="audit").count() == 2
    with pytest.raises(LookupError):
        t.read(version=2)
    assert refresh(t, one.limit(1)) == 5 and t.read().count() == 1


def test_a_failed_write_leaves_the_table(spark, tmp_path):
    t = SnapshotTable(spark, f"file://{tmp_path}/t")
    t.write(spark.range(3).toDF("a"))
    with pytest.raises(Exception):
        t.update(lambda d: d.select(F.raise_error(F.lit("no")).alias("a")))
    assert t.current() == 1 and t.read().count() == 3


def put(tmp_path, name, text):
    p = tmp_path / "in" / name
    p.parent.mkdir(exist_ok=True)
    p.write_text(text)
    return f"file://{p}"


def run(spark, tmp_path, path, day, checks=None):
    house = J.Warehouse(spark, f"file://{tmp_path}/wh")
    return house, J.run_job(spark, house, f"file://{tmp_path}/data", path, config.jobs(JOBS), config.models(MODELS), dt.datetime(2024, 1, day, 12), checks)


CSV = "Fund Code,Fund Name,Report Date,Aum,Transaction Id\nF1,One,2024-01-01,10.5,TX-1\nF2,Two,2024-01-01,20,TX-2\n"


def test_a_file_from_arrival_to_archive(spark, tmp_path):
    house, out = run(spark, tmp_path, put(tmp_path, "FUNDS.csv", CSV), 1)
    assert (out.outcome, out.version, out.model_error) == ("loaded", 1, None) and "/archive/2024/01/01/FUNDS_20240101120000.csv" in out.moved_to
    again = CSV.replace("One", "Uno").replace("Transaction Id", "Transaction Id,Region").replace("TX-1\n", "TX-1,EU\n").replace("TX-2\n", "TX-2,US\n")
    house, out = run(spark, tmp_path, put(tmp_path, "funds.csv", again), 9)
    funds = house.table("funds").read()
    assert "region" in funds.columns and funds.count() == 2 and out.metrics["rows_deleted"] == 2
    dim = house.table("dim_fund").read()
    assert sorted((r.fund_key, r.code, r.name, r.version, r.is_current) for r in dim.collect()) == [
        (1, "F1", "One", 1, False), (2, "F2", "Two", 1, True), (3, "F1", "Uno", 2, True)
    ]
    fact = house.table("fact_aum").read()
    assert sorted((r.tx, float(r.aum), r.fund_key) for r in fact.collect()) == [("TX-1", 10.5, 3), ("TX-2", 20.0, 2)]
    log = house.table("job_sts").read()
    assert log.filter("status = 'SUCCESS' AND error_message IS NULL").count() == 2 and log.select("run_id").distinct().count() == 2
    # an old layout comes again: the column that it lacks gets its default, nothing is dropped
    house, out = run(spark, tmp_path, put(tmp_path, "funds.csv", CSV), 10)
    assert sorted(r.region for r in house.table("funds").read().collect()) == ["", ""]


def test_outcomes(spark, tmp_path):
    _, out = run(spark, tmp_path, put(tmp_path, "unknown.csv", CSV), 1)
    assert out.outcome == "not_configured" and out.moved_to.endswith("/new_files/unknown.csv")
    _, out = run(spark, tmp_path, put(tmp_path, "OFF.csv", "a\n1\n"), 1)
    assert out.outcome == "inactive"
    bad = put(tmp_path, "funds.csv", "A b,a_b\n1,2\n")
    with pytest.raises(ValueError):
        run(spark, tmp_path, bad, 2)
    house = J.Warehouse(spark, f"file://{tmp_path}/wh")
    assert house.table("job_sts").read().first().status == "FAILED"
    assert (tmp_path / "data" / "unprocessed" / "funds.csv").exists()


def test_a_failed_model_keeps_the_base_load(spark, tmp_path):
    house, out = run(spark, tmp_path, put(tmp_path, "funds.csv", CSV), 1, checks=lambda df: quality.row_count(df, "funds", 100, 200))
    assert out.outcome == "loaded" and "row_count" in out.model_error and house.table("funds").read().count() == 2
    assert "row_count" in house.table("job_sts").read().first().error_message


def test_configs_are_checked():
    with pytest.raises(config.ConfigError, match="unknown"):
        config.jobs('[{"job_id": "a", "nope": 1}]')
    with pytest.raises(config.ConfigError, match="missing"):
        config.jobs('[{"job_id": "a"}]')
    with pytest.raises(config.ConfigError, match="unmapped"):
        config.models('[{"source_table": "t", "dimensions": [{"dimension_table": "dim_x", "natural_keys": ["k"], "column_mappings": {"a": "b"}}]}]')
    with pytest.raises(config.ConfigError, match="identifier"):
        config.views('[{"view_name": "v; drop table x", "source_table": "t", "definition": "SELECT 1"}]')
    two = config.views(
        '[{"view_name": "v", "source_table": "t", "definition": "SELECT 1"}, {"view_name": "v", "source_table": "t", "definition": "SELECT * '
        'FROM {source_table}"}]'
    )
    assert two["v"].sql() == "SELECT * FROM t"
    assert config.DimSpec("dim_fund", ["k"], {"k": "k"}).key == "fund_key"


def test_single_csv(spark, tmp_path):
    write_csv_single(spark.createDataFrame([('a "b"', 1)], "s string, n int"), str(tmp_path / "x"))
    assert len(list((tmp_path / "x").glob("*.csv"))) == 1
