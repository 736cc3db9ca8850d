"""Small golden cases and properties of merges, dimensions, facts, schema, quality, joins and time."""

import datetime as dt
import uuid
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martflow.functions import privacy
from martflow.functions.timefn import datediff_boundary
from martflow.operators import audit, dimensions, facts, joins, merge, quality, recon, schema, windows
from martflow.sources import ingest

D = dt.date
DIM = "fund_key long, code string, name string, fee double, effective_date date, end_date date, is_current boolean, version int"
QUICK = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def rows(df, *by):
    return [tuple(r) for r in df.orderBy(*(by or df.columns)).collect()]


# ---- merges


def test_replace_by_key_is_group_replacement(spark):
    t = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "k string, v int")
    s = spark.createDataFrame([("a", 9), ("a", 9), (None, 5), ("c", 6)], "k string, v int")
    assert sorted(rows(merge.replace_by_key(t, s, ["k"])), key=str) == sorted([("a", 9), ("a", 9), ("b", 3), (None, 4), (None, 5), ("c", 6)], key=str)


@QUICK
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 9)), max_size=12), st.lists(st.tuples(st.integers(0, 6), st.integers(0, 9)), max_size=12))
def test_merge_properties(spark, t, s):
    t, s = spark.createDataFrame(t, "k int, v int"), spark.createDataFrame(s, "k int, v int")
    once = merge.replace_by_key(t, s, ["k"])
    assert rows(merge.replace_by_key(once, s, ["k"])) == rows(once)
    ins = merge.insert_only(t, s, ["k"])
    assert rows(merge.insert_only(ins, s, ["k"])) == rows(ins)
    m = merge.merge_metrics(t, s, ["k"]).first()
    assert m.rows_after == once.count() and m.rows_read == s.count()


def test_upsert_and_newer(spark):
    t = spark.createDataFrame([(1, "a", 10), (2, "b", 10), (3, None, 10)], "k int, v string, at int")
    s = spark.createDataFrame([(1, None, 11), (2, "x", 9), (4, "n", 1)], "k int, v string, at int")
    assert rows(merge.upsert(t, s, ["k"])) == [(1, None, 11), (2, "x", 9), (3, None, 10), (4, "n", 1)]
    assert rows(merge.upsert_if_newer(t, s, ["k"], "at")) == [(1, None, 11), (2, "b", 10), (3, None, 10), (4, "n", 1)]


# ---- dimensions


def seed(spark):
    return spark.createDataFrame(
        [
            (1, "F1", "One", 0.5, D(2024, 1, 1), None, True, 1), (2, "F2", "Two", 0.6, D(2024, 1, 1), None, True, 1),
            (3, "F3", "Three", None, D(2024, 1, 1), None, True, 1)
        ],
        DIM
    )


def step(dim, batch, day, tracked=("name", "fee")):
    return dimensions.scd2(dim, batch, "fund_key", ["code"], list(tracked), day)


def test_scd2_three_days(spark):
    b = lambda *r: spark.createDataFrame(r, "code string, name string, fee double")
    day2 = step(seed(spark), b(("F1", "Uno", 0.5), ("F2", "Two", 0.6), ("F4", "Four", 0.1)), "2024-01-15")
    assert rows(day2, "fund_key")[3:] == [(4, "F1", "Uno", 0.5, D(2024, 1, 15), None, True, 2), (5, "F4", "Four", 0.1, D(2024, 1, 15), None, True, 1)]
    assert rows(day2, "fund_key")[0] == (1, "F1", "One", 0.5, D(2024, 1, 1), D(2024, 1, 14), False, 1)
    again = step(day2, b(("F1", "Uno", 0.5), ("F4", "Four", 0.1)), "2024-01-15")
    assert rows(again) == rows(day2)  # B6: the same batch on the same day
    day3 = step(day2, b(("F1", "One", 0.5)), "2024-02-01")  # a value that flips back is a third version
    assert rows(day3.filter("code = 'F1'"), "version")[2] == (6, "F1", "One", 0.5, D(2024, 2, 1), None, True, 3)
    assert dimensions.scd2_integrity(day3, ["code"]).count() == 0


def test_b7_two_rows_of_one_key(spark):
    two = spark.createDataFrame([("F9", "a", 1.0), ("F9", "b", 2.0)], "code string, name string, fee double")
    out = dimensions.scd2(seed(spark), two, "fund_key", ["code"], ["name"], "2024-03-01", order=F.col("fee"))
    assert rows(out.filter("code = 'F9'").select("name", "version")) == [("b", 1)]


def test_b8_missing_attributes_are_carried_over(spark):
    out = step(seed(spark), spark.createDataFrame([("F1", "New")], "code string, name string"), "2024-03-01")
    assert rows(out.filter("code = 'F1' AND is_current").select("name", "fee")) == [("New", 0.5)]


def test_b9_null_differs_from_text(spark):
    out = step(
        seed(spark).withColumn("name", F.when(F.col("code") != "F1", F.col("name"))),
        spark.createDataFrame([("F1", "__NULL__", 0.5), ("F3", "Three", None)], "code string, name string, fee double"), "2024-03-01"
    )
    assert rows(out.filter("version = 2").select("code")) == [("F1",)]


def test_b10_second_change_of_a_day_overwrites(spark):
    b = lambda n: spark.createDataFrame([("F1", n, 0.5)], "code string, name string, fee double")
    out = step(step(seed(spark), b("x"), "2024-03-01"), b("y"), "2024-03-01")
    assert rows(out.filter("code = 'F1'").select("version", "name", "end_date")) == [(1, "One", D(2024, 2, 29)), (2, "y", None)]


def test_b26_a_closed_member_comes_back(spark):
    closed = seed(spark).withColumn("is_current", F.col("code") != "F2").withColumn("end_date", F.when(F.col("code") == "F2", F.lit("2024-01-31").cast("date")))
    out = step(closed, spark.createDataFrame([("F2", "Two", 0.6)], "code string, name string, fee double"), "2024-03-01")
    assert rows(out.filter("code = 'F2' AND is_current").select("fund_key", "version")) == [(4, 2)]


@QUICK
@given(st.lists(st.lists(st.tuples(st.sampled_from("abcd"), st.sampled_from(["x", "y", None])), max_size=5), min_size=1, max_size=3))
def test_scd2_invariants(spark, batches):
    dim = spark.createDataFrame([], "k long, code string, v string, effective_date date, end_date date, is_current boolean, version int")
    for i, b in enumerate(batches):
        dim = spark.createDataFrame(
            dimensions.scd2(dim, spark.createDataFrame(b, "code string, v string"), "k", ["code"], ["v"], f"2024-0{i + 1}-01").collect(),
            dim.schema
        )
    keys = [r.k for r in dim.collect()]
    assert sorted(keys) == list(range(1, len(keys) + 1))
    assert dimensions.scd2_integrity(dim, ["code"]).count() == 0


def test_scd1_without_attributes_and_with_nulls(spark):
    dim = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k long, code string, v string")
    out = dimensions.scd1(dim, spark.createDataFrame([("a", None), ("c", "z")], "code string, v string"), "k", ["code"])
    assert rows(out) == [(1, "a", None), (2, "b", "y"), (3, "c", "z")]
    keys_only = dimensions.scd1(dim.drop("v"), spark.createDataFrame([("a",), ("c",)], "code string"), "k", ["code"])  # B11
    assert rows(keys_only) == [(1, "a"), (2, "b"), (3, "c")]


def test_numbering_is_dense_over_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(13)
    assert rows(dimensions.numbered(df, "k", ["v"])) == [(i + 1, i) for i in range(1000)]


# ---- facts


def test_lookups_do_not_change_row_counts(spark):
    dim = step(seed(spark), spark.createDataFrame([("F1", "Uno", 0.5)], "code string, name string, fee double"), "2024-01-15")
    f = spark.createDataFrame(
        [("F1", D(2024, 1, 14)), ("F1", D(2024, 1, 15)), ("F2", D(2023, 1, 1)), ("zz", D(2024, 1, 1)), (None, None)],
        "code string, day date"
    )
    assert [r.fund_key for r in facts.lookup_as_of(f, dim, {"code": "code"}, "fund_key", "day").collect()] == [1, 4, -1, -1, -1]
    assert sorted(r.fund_key for r in facts.lookup_current(f, dim, {"code": "code"}, "fund_key").collect()) == [-1, -1, 2, 4, 4]


# ---- schema


def test_align_defaults_and_new_columns(spark):
    target = T.StructType(
        [T.StructField("a", T.IntegerType()), T.StructField("d", T.DateType()), T.StructField("m", T.DecimalType(18, 2)), T.StructField("s", T.ShortType())]
    )
    df = spark.createDataFrame([(1, "new")], "a int, extra string")
    assert rows(schema.align(df, target)) == [(1, None, Decimal("0.00"), 0)]
    assert schema.widened(target, df).names == ["a", "d", "m", "s", "extra"]  # B1: columns that only the source has are added
    assert rows(schema.backfill(df, target, "null")) == [(1, "new", None, None, None)]


@pytest.mark.parametrize(
    ("name", "kind"),
    [
        ("smallint", "smallint"), ("REAL", "float"), ("numeric(10,2)", "decimal(10,2)"), ("decimal", "decimal(38,18)"),
        ("varchar(20)", "string"), ("weird", "string"), ("timestamp", "timestamp_ntz")
    ]
)
def test_types(name, kind):
    assert schema.spark_type(name).simpleString() == kind


def test_b16_integers_grow_to_the_smallest_that_holds(spark):
    df = spark.createDataFrame([(5_000_000_000, "x" * 300)], "n long, s string")
    assert rows(schema.widen_report(df, {"s": 256}, {"n": "smallint"})) == [("n", "smallint", "bigint"), ("s", "varchar(256)", "varchar(310)")]
    low = spark.createDataFrame([(-(2**63),)], "n long")
    assert schema.widen_report(low, {}, {"n": "int"}).first().needed_type == "bigint"
    assert schema.widen_report(df.limit(0), {"s": 10}, {"n": "smallint"}).count() == 0


def test_ddl():
    s = T.StructType([T.StructField("k", T.LongType()), T.StructField("m", T.DecimalType(18, 2)), T.StructField("a", T.ArrayType(T.StringType()))])
    assert schema.create_table_ddl("t", s, ["k"]) == "CREATE TABLE t (k BIGINT NOT NULL, m DECIMAL(18,2), a VARCHAR(256))"


def test_flatten_unbox_drop_nulls(spark):
    df = spark.createDataFrame([(1, (2, (3,)), '{"z": 5}', None)], "a int, s struct<b:int,t:struct<c:int>>, j string, n string")
    assert schema.flatten(df).columns == ["a", "s_b", "s_t_c", "j", "n"]
    assert schema.unbox(df, "j", "z int").select("j.z").first().z == 5
    assert schema.drop_null_columns(df).columns == ["a", "s", "j"]


# ---- ingest


def test_clean_names(spark):
    assert ingest.clean_name("  Total $ (USD)__x ") == "total_usd_x"
    with pytest.raises(ValueError, match="fall together"):
        ingest.normalized(spark.createDataFrame([(1, 2)], ["A b", "a_b"]))


def test_csv(spark, tmp_path):
    (tmp_path / "f.csv").write_text('Fund Code,Rate,"Day"\n"a ""q"" b",0.25,2024-01-02\n,,\n')
    df = ingest.read_csv(spark, str(tmp_path / "f.csv"), ["fund_code"], F.lit("2024-01-01").cast("timestamp"))
    assert [(f.name, f.dataType.simpleString()) for f in df.schema.fields][:3] == [("fund_code", "string"), ("rate", "decimal(38,18)"), ("day", "date")]
    assert [(r.fund_code, r.rate, r.day, r.file_name) for r in df.collect()] == [
        ('a "q" b', Decimal("0.25"), D(2024, 1, 2), "f.csv"), (None, None, None, "f.csv")
    ]


def test_marks(spark):
    df = spark.createDataFrame([(1,), (5,)], "id int")
    assert ingest.after_key(df, "id", None).count() == 2 and rows(ingest.after_key(df, "id", 1)) == [(5,)]
    assert ingest.next_mark(df, "id", 9) == 9 and ingest.next_mark(df, "id", None) == 5 and ingest.next_mark(df.limit(0), "id", 3) == 3


# ---- quality, recon, audit


def test_checks_on_empty_tables(spark):
    e = spark.createDataFrame([], "a int, t timestamp")
    assert quality.freshness(e, "x", "t", 1, F.lit("2024-01-01").cast("timestamp")).first()[5:] == ("NO DATA", False)
    assert quality.nulls(e, "x", "a").first().passed and quality.rules(e, "x", positive=["a"], complete=["a"]).filter("NOT passed").count() == 0
    with pytest.raises(quality.CheckFailed, match="row_count"):
        quality.require(quality.row_count(e, "x", 1, 2))


def test_thresholds_and_trailers(spark):
    df = spark.createDataFrame([("1", 2.5), ("x", 1.0), (None, None)], "a string, v double")
    good, bad = schema.quarantine(df, {"a": "int"})
    assert good.count() == 2 and rows(bad.select("a", "reason")) == [("x", "a")]
    assert not quality.within_errors(bad, df, "t", 10).first().passed and quality.within_errors(bad, df, "t", 34).first().passed
    assert [r.passed for r in quality.trailer(df, "t", 3, "v", 3.5).collect()] == [True, True]
    assert [r.passed for r in quality.trailer(df, "t", 4, "v", 3.0).collect()] == [False, False]


def test_recon_with_nulls(spark):
    a = spark.createDataFrame([(1, None), (2, 1.0), (3, 2.0)], "k int, v double")
    b = spark.createDataFrame([(1, None), (2, 2.0), (4, 1.0)], "k int, v double")
    assert rows(recon.row_status(a, b, ["k"], ["v"])) == [(1, "ok"), (2, "mismatch"), (3, "missing_in_target"), (4, "missing_in_source")]
    assert recon.hash_match(a, a.repartition(3), ["k", "v"]).first().is_equal and not recon.hash_match(a, b, ["k", "v"]).first().is_equal
    assert recon.control_totals(a.limit(0), b.limit(0), "v", "k").first().is_reconciled


def test_retry():
    waits, n = [], []

    @audit.retry(attempts=3, base=5, most=8, sleep=waits.append)
    def f():
        n.append(1)
        raise OSError

    with pytest.raises(OSError):
        f()
    assert len(n) == 3 and waits == [5, 8]


# ---- joins


@QUICK
@given(
    st.lists(st.one_of(st.integers(0, 4), st.none()), max_size=25), st.lists(st.one_of(st.integers(0, 5), st.none()), max_size=8),
    st.integers(1, 5), st.integers(0, 6)
)
def test_skew_joins_equal_the_plain_one(spark, left, right, salts, least):
    a = spark.createDataFrame(list(enumerate(left)), "i int, k int")
    b = spark.createDataFrame(list(enumerate(right)), "j int, k int").select("k", "j")
    for how in ("inner", "left"):
        plain = sorted(rows(a.join(b, "k", how)), key=str)
        assert sorted(rows(joins.salted_join(a, b, ["k"], salts, ["i"], how)), key=str) == plain
        assert sorted(rows(joins.hot_key_split_join(a, b, ["k"], least, how)), key=str) == plain


def test_plans(spark):
    a, b = spark.range(1000).withColumn("k", F.col("id") % 10), spark.range(10).select(F.col("id").alias("k"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(joins.broadcast_join(a, b, ["k"]))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert "BroadcastHashJoin" in plan(joins.broadcast_join(a, b, ["k"]))
        assert "BroadcastHashJoin" not in plan(joins.broadcast_join(a, b, ["k"], most=0))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    one, two = (f"tb_{uuid.uuid4().hex[:12]}" for _ in range(2))
    joins.write_bucketed(a, one, ["k"], 4)
    joins.write_bucketed(b, two, ["k"], 4)
    p = plan(joins.bucketed_join(spark, one, two, ["k"]))
    assert "SortMergeJoin" in p and "Exchange" not in p


def test_last_known(spark):
    f = spark.createDataFrame([("a", 5, "x"), ("a", 1, "y"), ("b", 9, "z"), (None, 3, "n")], "k string, t int, id string")
    r = spark.createDataFrame([("a", 2, 1.0), ("a", 5, 2.0), ("a", 6, 3.0), ("c", 1, 9.0)], "k string, at int, rate double")
    assert sorted((x.id, x.rate) for x in joins.last_known(f, r, ["k"], "t", "at", ["rate"]).collect()) == [("n", None), ("x", 2.0), ("y", None), ("z", None)]


# ---- windows, time, privacy


def test_boundaries(spark):
    r = spark.createDataFrame(
        [
            (dt.datetime(2024, 1, 1, 10, 59), dt.datetime(2024, 1, 1, 11, 1)),
            (dt.datetime(1969, 12, 31, 23, 59), dt.datetime(1970, 1, 1, 0, 0)), (None, dt.datetime(2024, 1, 1))
        ],
        "a timestamp_ntz, b timestamp_ntz"
    )
    assert [
        tuple(x) for x in r.select(*[datediff_boundary(u, F.col("a"), F.col("b")) for u in ("second", "hour", "day", "year")]).collect()
    ] == [(120, 1, 0, 0), (60, 1, 1, 1), (None,) * 4]


def test_runs_need_neighbours(spark):
    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    e = spark.createDataFrame(
        [(1, 1, t(0), 9.0), (2, 1, t(1), 9.0), (3, 1, t(2), 1.0), (4, 1, t(3), 9.0), (5, 1, t(4), 9.0), (6, 1, t(5), 9.0)],
        "i int, u int, ts timestamp, v double"
    )
    assert rows(windows.high_pairs(e, "u", "ts", "v", 5, "1 HOUR", "i")) == [(1, 3)]
    assert [r.n_rows for r in windows.high_runs(e, "u", "ts", "v", 5, "1 HOUR", "i").collect()] == [3]


def test_privacy(spark):
    df = spark.createDataFrame([(1, "12345678"), (2, "123"), (3, None)], "i int, c string")
    assert [r[0] for r in df.select(privacy.mask_last(F.col("c"))).collect()] == ["****5678", "***", None]
    v = privacy.vault(df, "c")
    more = privacy.vault(df.union(spark.createDataFrame([(9, "000")], "i int, c string")), "c", v)
    assert set(rows(v)) < set(rows(more)) and more.agg(F.max("token")).first()[0] == 3
    assert sorted(rows(privacy.detokenized(privacy.tokenized(df, "c", v), "c", v)), key=str) == sorted(rows(df), key=str)


def test_keys_are_dense_whatever_spark_reuses(spark):
    """Keys do not rest on two readings of a sampled range partitioning."""
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        df = spark.range(1_000_000, numPartitions=7).select(((F.col("id") * 7919) % 1_000_003).alias("v"), (F.col("id") % 3).alias("w")).repartition(5)
        got = dimensions.numbered(df, "k", ["w", "v"], after=spark.range(41, 42).toDF("k"))
        assert tuple(got.agg(F.min("k"), F.max("k"), F.count_distinct("k"), F.count("*")).first()) == (42, 1_000_041, 1_000_000, 1_000_000)
        prev = got.filter("k in (42, 43, 500000, 500001, 1000040, 1000041)").orderBy("k").select("w", "v").collect()
        assert prev == sorted(prev)
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    assert dimensions.numbered(spark.range(0).toDF("v"), "k", ["v"]).count() == 0


DIM2 = "k long, code string, v string, effective_date date, end_date date, is_current boolean, version int"


def test_scd2_late_batches_go_into_the_history(spark):
    d = dt.date
    dim = spark.createDataFrame([
        (1, "a", "x", d(2024, 1, 1), d(2024, 1, 31), False, 1), (2, "a", "y", d(2024, 2, 1), None, True, 2),
        (3, "b", "x", None, None, True, 1), (4, "c", "x", d(2024, 3, 1), None, True, 1), (
            5, "d", "x", d(2024, 1, 1), d(2024, 1, 10), False, 1
        ), (6, None, "x", d(2024, 1, 1), None, True, 1),
    ], DIM2)
    batch = spark.createDataFrame([("a", "late"), ("b", "late"), ("c", "early"), ("d", "back"), ("e", "new")], "code string, v string")
    out = dimensions.scd2(dim, batch, "k", ["code"], ["v"], "2024-01-15")
    got = sorted((tuple(r) for r in out.collect()), key=lambda r: r[0])
    assert got == [
        (1, "a", "x", d(2024, 1, 1), d(2024, 1, 14), False, 1), (2, "a", "y", d(2024, 2, 1), None, True, 2),
        (3, "b", "x", None, d(2024, 1, 14), False, 1), (4, "c", "x", d(2024, 3, 1), None, True, 1), (
            5, "d", "x", d(2024, 1, 1), d(2024, 1, 10), False, 1
        ), (6, None, "x", d(2024, 1, 1), None, True, 1),
        (7, "a", "late", d(2024, 1, 15), d(2024, 1, 31), False, 3), (8, "b", "late", d(2024, 1, 15), None, True, 2),
        (
            9, "c", "early", d(2024, 1, 15), d(2024, 2, 29), False, 2
        ), (10, "d", "back", d(2024, 1, 15), None, True, 2), (11, "e", "new", d(2024, 1, 15), None, True, 1),
    ]
    once = spark.createDataFrame(out.collect(), DIM2)
    again = dimensions.scd2(once, batch, "k", ["code"], ["v"], "2024-01-15")
    assert sorted(map(tuple, again.collect()), key=lambda r: r[0]) == got


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 6), st.lists(st.tuples(st.sampled_from("abc"), st.sampled_from("xyz")), max_size=3)), max_size=4))
def test_scd2_never_loses_a_member(spark, batches):
    """Batches in any order of days: keys stay, intervals do not overlap, no member has two current rows."""
    dim = spark.createDataFrame([(1, "a", "x", dt.date(2024, 3, 1), None, True, 1), (2, "b", "x", None, None, True, 1)], DIM2)
    for month, rows in batches:
        new = spark.createDataFrame(
            dimensions.scd2(dim, spark.createDataFrame(rows, "code string, v string"), "k", ["code"], ["v"], f"2024-0{month}-15").collect(),
            DIM2
        )
        assert {r.k for r in dim.collect()} <= {r.k for r in new.collect()}
        dim = new
    faults = dimensions.scd2_integrity(dim.filter("effective_date is not null"), ["code"])
    assert faults.filter("fault = 'overlap'").count() == 0 and dim.filter("is_current").groupBy("code").count().filter("count > 1").count() == 0


def test_scd2_stamps(spark):
    t1, t2 = F.lit("2024-01-01 10:00:00").cast("timestamp"), F.lit("2024-02-01 10:00:00").cast("timestamp")
    dim = dimensions.stamped(spark.createDataFrame([(1, "a", "x"), (2, "b", "x")], "k long, code string, v string"), "2024-01-01", t1)
    out = dimensions.scd2(dim, spark.createDataFrame([("a", "y")], "code string, v string"), "k", ["code"], ["v"], "2024-02-01", loaded=t2)
    assert sorted((r.k, r.created_date.month, r.updated_date.month) for r in out.collect()) == [(1, 1, 2), (2, 1, 1), (3, 2, 2)]
