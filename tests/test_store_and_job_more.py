import datetime as dt
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martflow import config
from martflow.operators import audit, joins, merge, quality, schema
from martflow.plans import job as J
from martflow.sources import catalog, ingest, store
from martflow.sources.marks import Marks, incremental
from martflow.sources.scratch import checkpoint_dir
from martflow.sources.store import Conflict, SnapshotTable
from martflow.streaming import stream

D = dt.date


def files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def test_a_merge_leaves_untouched_files_in_place(spark, tmp_path):
    t = SnapshotTable(spark, f"file://{tmp_path}/t")
    t.merge(spark.range(1000).select("id", F.col("id").alias("v")), ["id"], lambda _, new: new, buckets=16)
    before = files(tmp_path)
    t.merge(spark.createDataFrame([(7, -1)], "id long, v long"), ["id"], lambda old, new: merge.upsert(old, new, ["id"]))
    after = files(tmp_path)
    assert before.items() <= after.items() and len(after) <= len(before) + 2
    old = {p for d in json.loads((tmp_path / "t/_log/1.json").read_text())["parts"].values() for p in d}
    new = {p for d in json.loads((tmp_path / "t/_log/2.json").read_text())["parts"].values() for p in d}
    assert len(old - new) == 1 and len(old & new) == len(old) - 1
    assert t.read().count() == 1000 and t.read().filter("id = 7").first().v == -1 and t.read(version=1).filter("id = 7").first().v == 7
    before = files(tmp_path)
    t.insert_only(spark.createDataFrame([(7, 5), (2000, 1), (2000, 2), (None, 3)], "id long, v long"), ["id"])
    assert before.items() <= files(tmp_path).items() and t.read().count() == 1002 and t.read().filter("id = 2000").first().v == 1
    assert t.merge(spark.createDataFrame([], "id long, v long"), ["id"], lambda old, new: old) == 3
    # a key keeps its bucket when its type grows
    t.merge(
        spark.createDataFrame([("7", 9)], "id string, v long"), ["id"], lambda old,
        new: merge.replace_by_key(old, new.select(F.col("id").cast("long"), "v"), ["id"])
    )
    assert t.read().filter("id = 7").collect()[0].v == 9 and t.read().count() == 1002


def test_appends_and_new_columns(spark, tmp_path):
    t = SnapshotTable(spark, f"file://{tmp_path}/t")
    t.append(spark.createDataFrame([(1, "a")], "i int, s string"))
    before = files(tmp_path)
    t.append(spark.createDataFrame([(2, "b", 0.5)], "i int, s string, x double"))
    assert before.items() <= files(tmp_path).items()
    assert sorted(map(tuple, t.read().collect())) == [(1, "a", None), (2, "b", 0.5)] and t.read(version=1).columns == ["i", "s"]
    t.alter(schema.alter_lengths(T.StructType([T.StructField("i", T.LongType()), *t.schema().fields[1:]]), {"s": 900}))
    t.append(spark.createDataFrame([(3_000_000_000, "c", None)], "i long, s string, x double"))
    assert {r.i for r in t.read().collect()} == {1, 2, 3_000_000_000} and schema.length_of(t.schema()["s"]) == 900
    assert [tuple(r) for r in schema.column_metadata(spark, t.schema()).collect()][:2] == [(1, "i", "BIGINT", None, True), (2, "s", "VARCHAR", 900, True)]


def test_a_killed_writer_leaves_nothing(spark, tmp_path, monkeypatch):
    t = SnapshotTable(spark, f"file://{tmp_path}/t")
    t.write(spark.range(3).toDF("a"))
    # killed while it writes its commit: an empty file lies aside
    (tmp_path / "t" / "_log" / ".2.json.dead").write_text("")
    (tmp_path / "t" / "v=2-dead").mkdir()
    assert t.current() == 1 and t.read().count() == 3
    # another writer commits between this one's start and its commit
    first = t._commit

    def late(*args, **kwargs):
        monkeypatch.setattr(t, "_commit", first)
        SnapshotTable(spark, t.path).append(spark.range(3, 4).toDF("a"))
        return first(*args, **kwargs)

    monkeypatch.setattr(t, "_commit", late)
    with pytest.raises(Conflict):
        t.update(lambda d: d)
    assert t.current() == 2 and t.read().count() == 4
    # any other error is told as it is
    monkeypatch.setattr(t, "_write_text", lambda *a, **k: (_ for _ in ()).throw(OSError("disk")))
    with pytest.raises(OSError, match="disk"):
        t.append(spark.range(1).toDF("a"))


def test_branches(spark, tmp_path):
    t = SnapshotTable(spark, f"file://{tmp_path}/t")
    t.write(spark.range(3).toDF("a"))
    b = t.on_branch("audit")
    b.append(spark.range(3, 5).toDF("a"))
    b.append(spark.range(5, 6).toDF("a"))
    assert (t.read().count(), t.on_branch("audit").read().count()) == (3, 6)
    assert t.fast_forward("audit") == 2 and t.read().count() == 6
    c = t.on_branch("late")
    t.append(spark.range(1).toDF("a"))
    c.append(spark.range(1).toDF("a"))
    with pytest.raises(Conflict):
        t.fast_forward("late")
    t.vacuum(keep=1)
    assert t.on_branch("late").read().count() == 7 and t.on_branch("audit").read().count() == 6


def test_statistics_health_and_maintenance(spark, tmp_path):
    t = SnapshotTable(spark, f"file://{tmp_path}/t")
    for i in range(4):
        t.append(spark.createDataFrame([(i, None if i else "x")], "a int, b string"))
    row = audit.health(spark, {"t": t}).first()
    assert (row.rows, row.unsorted, row.stats_off, row.health_status) == (4, 75.0, 100.0, "NEEDS VACUUM")
    assert store.maintain([t], keep=2) == {t.path: ["compacted", "analyzed", "vacuumed"]}
    stats = json.loads((tmp_path / "t" / "_stats.json").read_text())
    assert stats["rows"] == 4 and stats["columns"]["b"] == {"nulls": 3, "distinct": 1, "min": "x", "max": "x"} and stats["columns"]["a"]["max"] == "3"
    assert audit.health(spark, {"t": t}).first().health_status == "OK" and store.maintain([t], keep=2) == {t.path: []}


def test_moves_find_a_free_name(spark, tmp_path):
    for i in range(3):
        (tmp_path / "a.csv").write_text(str(i))
        assert store.move(spark, f"file://{tmp_path}/a.csv", f"file://{tmp_path}/out/a.csv").endswith(("out/a.csv", "out/a-1.csv", "out/a-2.csv")[i])
    assert sorted(p.name for p in (tmp_path / "out").glob("*.csv")) == ["a-1.csv", "a-2.csv", "a.csv"]


def test_part_files(spark, tmp_path):
    store.write_csv_single(spark.range(3), f"file://{tmp_path}/x")
    found = store.part_file(spark, f"file://{tmp_path}/x")
    assert found.endswith(".csv") and spark.read.option("header", True).csv(found).count() == 3
    spark.range(2).write.parquet(f"file://{tmp_path}/y")
    assert "part-" in store.part_file(spark, f"file://{tmp_path}/y")
    (tmp_path / "z").mkdir()
    with pytest.raises(FileNotFoundError):
        store.part_file(spark, f"file://{tmp_path}/z")


def test_checkpoint_folder(spark, monkeypatch):
    class Context:
        master = "spark://somewhere"

        def getConf(self):
            return {}

    class Conf(dict):
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="share"):
        checkpoint_dir(Session())
    assert checkpoint_dir(spark)


# ---- the job

JOBS = json.dumps([{"job_id": "J1", "source_file_name": "s3://bucket/data/in/Funds.csv", "target_table": "funds", "upsert_keys": ["transaction_id"]}])
MODELS = json.dumps([{"source_table": "funds", "dimensional_model": {
    "dimensions": [
        {
            "dimension_table": "dim_fund", "natural_keys": ["code"], "scd_type": 2, "scd_attributes": ["name"],
            "column_mappings": {"code": "fund_code", "name": "fund_name"}
        }
    ],
    "facts": [{"fact_table": "fact_aum", "measures": ["aum"], "degenerate_dimensions": ["transaction_id"], "dimension_lookups": [
        {"dimension": "dim_fund", "natural_keys": ["code"], "surrogate_key": "fund_key", "as_of": "report_date"},
        {"dimension": "dim_date", "natural_keys": ["date_key"], "surrogate_key": "date_key"},
        {"dimension": "dim_version", "natural_keys": ["version_code"], "surrogate_key": "version_key"}]}]}}])
HEAD = "Fund Code,Fund Name,Report Date,Aum,Transaction Id,Version Code\n"


def run(spark, tmp_path, rows, day, checks=None):
    p = tmp_path / "in" / "funds.csv"
    p.parent.mkdir(exist_ok=True)
    p.write_text(HEAD + rows)
    house = J.Warehouse(spark, f"file://{tmp_path}/wh")
    return house, J.run_job(
        spark, house, f"file://{tmp_path}/data", f"file://{p}", config.jobs(JOBS), config.models(MODELS), dt.datetime(2024, 1, day, 12),
        checks
    )


def test_facts_by_day_and_growing_columns(spark, tmp_path):
    checks = lambda df: quality.row_count(df, "funds", 1, 3)
    house, out = run(spark, tmp_path, "F1,One,2024-01-01,10,TX-1,ACTUAL\nF2,Two,2024-01-02,20,TX-2,PLAN\n", 1, checks)
    assert out.model_error is None
    assert {f.name: f.dataType.simpleString() for f in house.table("funds").schema().fields}["aum"] == "int"
    # F1 is renamed on the 9th; a value outgrows int, a name its length; a fact of the 5th still belongs to the first version
    house, out = run(spark, tmp_path, f"F1,{'U' * 300},2024-01-05,3000000000,TX-3,ACTUAL\nF1,{'U' * 300},2024-01-09,7,TX-4,NONE\n", 9, checks)
    assert "row_count_check" in out.model_error
    kinds = house.table("funds").schema()
    assert kinds["aum"].dataType.simpleString() == "bigint" and schema.length_of(kinds["fund_name"]) == 310 and schema.length_of(kinds["fund_code"]) == 256
    assert sorted(r.aum for r in house.table("funds").read().collect()) == [7, 10, 20, 3_000_000_000]
    fact = sorted((r.transaction_id, int(r.aum), r.fund_key, r.date_key, r.version_key) for r in house.table("fact_aum").read().collect())
    assert fact == [("TX-1", 10, 1, 20240101, 1), ("TX-2", 20, 2, 20240102, 2), ("TX-3", 3_000_000_000, 1, 20240105, 1), ("TX-4", 7, 3, 20240109, -1)]
    assert house.table("dim_date").read().count() == 366
    results = house.table("data_quality_results").read()
    assert sorted(r.passed for r in results.collect()) == [False, True] and "expected 1-3, found 4" in results.filter("not passed").first().details
    # text into a numeric column is refused; the first error is what the log tells, although the file's place is taken
    for _ in range(2):
        with pytest.raises(ValueError, match="aum"):
            run(spark, tmp_path, "F1,One,2024-01-09,many,TX-5,ACTUAL\n", 10)
    assert "aum" in house.table("job_sts").read().filter("status = 'FAILED'").first().error_message
    assert sorted(p.name for p in (tmp_path / "data" / "unprocessed").glob("*.csv")) == ["funds-1.csv", "funds.csv"]


def test_errors_of_moves_do_not_hide_others(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(J, "move", lambda *a: (_ for _ in ()).throw(OSError("no move")))
    house, out = run(spark, tmp_path, "F1,One,2024-01-01,10,TX-1,ACTUAL\n", 1)
    assert out.outcome == "loaded" and "archive: no move" in out.model_error and house.table("funds").read().count() == 1
    with pytest.raises(ValueError, match="aum"):
        run(spark, tmp_path, "F1,One,2024-01-09,many,TX-5,ACTUAL\n", 10)
    log = house.table("job_sts").read().filter("status = 'FAILED'").first()
    assert "aum" in log.error_message and "no move" in log.error_message


# ---- incremental loads


def test_marks(spark, tmp_path):
    marks, got = Marks(spark, f"file://{tmp_path}/marks"), []
    df = spark.range(10)
    load = lambda new: got.append(sorted(r.id for r in new.collect()))
    assert incremental(marks, "a", df.filter("id < 5"), "id", load) == 5 and marks.get("a") == 4
    with pytest.raises(RuntimeError):
        incremental(marks, "a", df, "id", lambda new: (_ for _ in ()).throw(RuntimeError()))
    assert marks.get("a") == 4
    assert incremental(marks, "a", df, "id", load) == 5 and incremental(marks, "a", df, "id", load) == 0
    marks.reset("a", 7)
    marks.pause("a")
    assert incremental(marks, "a", df, "id", load) == incremental(marks, "a", df, "id", load) == 2 and marks.paused("a") and marks.get("a") == 7
    marks.resume("a")
    assert incremental(marks, "a", df, "id", load) == 2 and marks.get("a") == 9
    marks.reset("a")
    assert marks.get("a") is None and got == [[0, 1, 2, 3, 4], [5, 6, 7, 8, 9], [8, 9], [8, 9], [8, 9]]
    days = spark.createDataFrame([(D(2024, 1, i),) for i in range(1, 5)], "d date")
    assert incremental(marks, "d", days, "d", lambda x: x.count()) == 4 and marks.get("d") == D(2024, 1, 4)
    assert incremental(marks, "d", days, "d", lambda x: x.count(), lookback_days=2) == 2


def test_a_day_reads_its_partition_alone(spark, tmp_path):
    df = spark.range(100).select("id", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 10).cast("int")).alias("d"))
    store.append_partitioned(ingest.dated(df, "d"), str(tmp_path / "p"), ["year", "month", "day"])
    one = ingest.partition_of_day(ingest.read_parquet(spark, str(tmp_path / "p")), "2024-01-03")
    assert one.count() == 10 and all("day=3" in f for f in one.inputFiles() if "day=3/" in f)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "day" in plan.split("PartitionFilters: [")[1].split("]")[0]
    few = ingest.read_parquet(spark, str(tmp_path / "p"), ["id"], "id > 90")
    assert few.columns == ["id"] and few.count() == 9 and "GreaterThan(id,90)" in few._jdf.queryExecution().executedPlan().toString()


# ---- what else a session offers


def test_catalog_tables(spark):
    for name in ("mf_made", "mf_sink", "mf_other"):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    try:
        made = catalog.create_table(spark, "mf_made", T.StructType([T.StructField("k", T.IntegerType()), T.StructField("s", T.StringType())]), ["k"])
        assert made.columns == ["k", "s"] and catalog.create_table(spark, "mf_made", made.schema).count() == 0
        catalog.append(spark.createDataFrame([(1, "a")], "k int, p string"), "mf_sink", ["p"])
        catalog.append(spark.createDataFrame([(2, 0.5, "b")], "k int, x double, p string"), "mf_sink")
        out = catalog.append(spark.createDataFrame([("a", 3)], "p string, k int"), "mf_sink")
        assert sorted((r.k, r.x, r.p) for r in out.collect()) == [(1, None, "a"), (2, 0.5, "b"), (3, None, "a")]
        assert {r.partition for r in spark.sql("SHOW PARTITIONS mf_sink").collect()} == {"p=a", "p=b"}
    finally:
        for name in ("mf_made", "mf_sink"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_federated_join(spark, tmp_path):
    SnapshotTable(spark, f"file://{tmp_path}/lake").write(spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"))
    spark.createDataFrame([(1, 10)], "k int, n int").createOrReplaceTempView("warehouse_side")
    assert [tuple(r) for r in catalog.federated_join(spark, f"file://{tmp_path}/lake", "warehouse_side", ["k"]).collect()] == [(1, "x", 10)]
    assert store.drop_view(spark, "warehouse_side") and not store.drop_view(spark, "warehouse_side")


def test_skew_joins_are_split_by_adaptive_execution(spark):
    conf = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2"
    }
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        left = spark.range(0, 60_000, numPartitions=6).select(
            F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("id")).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("pad")
        )
        out = left.join(spark.range(60_000).withColumnRenamed("id", "k"), "k")
        out.write.format("noop").mode("overwrite").save()
        rows = out.collect()
        assert len(rows) == 60_000 and "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k in conf:
            spark.conf.unset(k)


def test_lineage_fields_ranges_and_logs(spark, tmp_path):
    df = spark.createDataFrame([(1, D(2024, 1, 5)), (2, D(2024, 3, 1))], "k int, d date")
    out = ingest.with_lineage(df, F.lit("2024-01-01").cast("timestamp"), "load", "crm", "r1").first()
    assert (out._job_name, out._source_system, out._pipeline_run_id) == ("load", "crm", "r1")
    a, b = schema.split_fields(df, ["k"])
    assert (a.columns, b.columns) == (["k"], ["d"])
    spans = spark.createDataFrame([(1, D(2024, 1, 1), D(2024, 1, 31), "jan")], "id int, a date, b date, name string")
    hit = joins.date_range_join(df, spans, F.col("k") == F.col("id"), F.col("d"), F.col("a"), F.col("b"), "left")
    assert sorted((r.k, r.name) for r in hit.collect()) == [(1, "jan"), (2, None)]
    log = audit.run_logger("r1", str(tmp_path / "run.jsonl"))
    log.info("loaded", extra={"fields": {"rows": 3}})
    line = json.loads((tmp_path / "run.jsonl").read_text())
    assert line["msg"] == "loaded" and line["rows"] == 3
    reader = ingest.read_jdbc
    with pytest.raises(Exception, match="(?i)driver|jdbc"):
        reader(spark, "jdbc:none://x", "SELECT 1", {"partitionColumn": "k", "lowerBound": "0", "upperBound": "9", "numPartitions": "2"})


def test_rocksdb_state(spark, tmp_path):
    key = "spark.sql.streaming.stateStore.providerClass"
    stream.use_rocksdb(spark)
    try:
        spark.range(20).select((F.col("id") % 3).alias("k")).write.parquet(str(tmp_path / "in"))
        got = []
        counts = stream.files(spark, str(tmp_path / "in"), "k long").groupBy("k").count()
        stream.start(counts, lambda b, _: got.extend(map(tuple, b.collect())), str(tmp_path / "cp"), "complete").awaitTermination(120)
        assert sorted(got) == [(0, 7), (1, 7), (2, 6)]
    finally:
        spark.conf.unset(key)


def test_dimensions_write_their_touched_buckets_alone(spark, tmp_path):
    house = J.Warehouse(spark, f"file://{tmp_path}/wh")
    for kind in (0, 1, 2, 3):
        spec = config.DimSpec(f"dim_d{kind}", ["code"], {"code": "c", "name": "n"}, kind, ["name"])
        one = spark.range(300).select(F.concat(F.lit("k"), "id").alias("c"), F.lit("old").alias("n"))
        J.load_dimension(house, spec, one, D(2024, 1, 1))
        before = files(tmp_path / "wh" / f"dim_d{kind}")
        two = spark.createDataFrame([("k7", "new"), ("fresh", "new")], "c string, n string")
        J.load_dimension(house, spec, two, D(2024, 2, 1))
        assert before.items() <= files(tmp_path / "wh" / f"dim_d{kind}").items()
        log = house.table(f"dim_d{kind}").log()
        kept = {p for d in log[0]["parts"].values() for p in d} & {p for d in log[1]["parts"].values() for p in d}
        assert len(kept) >= len(log[0]["parts"]) - 2
        dim = house.table(f"dim_d{kind}").read()
        keys = [r[0] for r in dim.select(spec.key).collect()]
        assert sorted(keys) == list(range(1, 302 + (kind == 2)))
        assert {r.name for r in dim.filter("code = 'k7'").collect()} == {0: {"old"}, 1: {"new"}, 2: {"old", "new"}, 3: {"new"}}[kind]
