"""One query for each operator, on the driver's tables, with the same in DuckDB's SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martflow.functions import privacy
from martflow.functions.timefn import date_key, datediff_boundary, ratio
from martflow.operators import audit, dimensions, facts, joins, merge, quality, recon, schema, windows
from martflow.plans import reports
from martflow.sources import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
C = F.col


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def tab(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---- merge family: a target and a batch with changed (key % 10 = 0) and new (key + 10,000,000) rows


def _line_batch(t: DataFrame) -> DataFrame:
    base = t.filter("l_orderkey % 10 = 0")
    changed = base.filter("l_linenumber <= 3").withColumn("l_quantity", C("l_quantity") + 1)
    return changed.unionByName(base.withColumn("l_orderkey", C("l_orderkey") + 10_000_000))


_LINES = """t AS (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem),
b AS (SELECT l_orderkey, l_linenumber, l_quantity + 1 AS l_quantity, l_extendedprice FROM t WHERE l_orderkey % 10 = 0 AND l_linenumber <= 3
 UNION ALL SELECT l_orderkey + 10000000, l_linenumber, l_quantity, l_extendedprice FROM t WHERE l_orderkey % 10 = 0)"""


def _lines(spark, d):
    t = tab(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return t, _line_batch(t)


@query(
    f"WITH {_LINES} SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.l_orderkey = t.l_orderkey AND b.l_linenumber = t.l_linenumber) UNION ALL SELECT * FROM b"
)
def merge_replace_by_key(spark, d):
    return merge.replace_by_key(*_lines(spark, d), ["l_orderkey", "l_linenumber"])


@query(f"""WITH {_LINES}, x AS (SELECT (SELECT count(*) FROM t) AS rows_before, (SELECT count(*) FROM b) AS rows_read,
 (SELECT count(*) FROM t WHERE EXISTS (SELECT 1 FROM b WHERE b.l_orderkey = t.l_orderkey AND b.l_linenumber = t.l_linenumber)) AS rows_deleted)
SELECT *, rows_before - rows_deleted + rows_read AS rows_after, greatest(rows_read - rows_deleted, 0) AS inserted_est, greatest(rows_read -
  greatest(rows_read - rows_deleted, 0), 0) AS updated_est FROM x""")
def merge_metrics(spark, d):
    return merge.merge_metrics(*_lines(spark, d), ["l_orderkey", "l_linenumber"])


def _orders(spark, d):
    o = tab(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    base = o.filter("o_orderkey % 10 = 0")
    later = base.withColumns(
        {"o_orderstatus": F.lit("X"), "o_orderdate": F.expr("o_orderdate + CASE WHEN o_orderkey % 20 = 0 THEN INTERVAL 5 DAYS ELSE INTERVAL -5 DAYS END")}
    )
    return o, later.unionByName(base.withColumn("o_orderkey", C("o_orderkey") + 10_000_000))


_ORDERS = """o AS (SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderdate FROM orders),
b AS (SELECT o_orderkey, 'X' AS o_orderstatus, o_totalprice, o_orderdate + CASE WHEN o_orderkey % 20 = 0 THEN INTERVAL 5 DAY ELSE INTERVAL (-5) DAY
  END AS o_orderdate FROM o WHERE o_orderkey % 10 = 0
 UNION ALL SELECT o_orderkey + 10000000, o_orderstatus, o_totalprice, o_orderdate FROM o WHERE o_orderkey % 10 = 0)"""


@query(f"WITH {_ORDERS} SELECT * FROM b UNION ALL SELECT * FROM o WHERE o_orderkey NOT IN (SELECT o_orderkey FROM b)")
def merge_upsert(spark, d):
    return merge.upsert(*_orders(spark, d), ["o_orderkey"])


@query(f"""WITH {_ORDERS} SELECT coalesce(o.o_orderkey, b.o_orderkey) AS o_orderkey,
 CASE WHEN o.o_orderkey IS NULL OR b.o_orderdate > o.o_orderdate THEN b.o_orderstatus ELSE o.o_orderstatus END AS o_orderstatus,
 CASE WHEN o.o_orderkey IS NULL OR b.o_orderdate > o.o_orderdate THEN b.o_totalprice ELSE o.o_totalprice END AS o_totalprice,
 CASE WHEN o.o_orderkey IS NULL OR b.o_orderdate > o.o_orderdate THEN b.o_orderdate ELSE o.o_orderdate END AS o_orderdate FROM o FULL JOIN b ON
  o.o_orderkey = b.o_orderkey""")
def merge_if_newer(spark, d):
    return merge.upsert_if_newer(*_orders(spark, d), ["o_orderkey"], "o_orderdate")


def _events(spark, d):
    e = tab(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    old = e.filter("event_id % 3 <> 0")
    return old, e.filter("event_id % 2 = 0").unionByName(e.filter("event_id % 6 = 0").withColumn("value", C("value") + 1))


@query("""WITH old AS (SELECT event_id, user_id, event_type, value FROM events WHERE event_id % 3 <> 0),
n AS (SELECT event_id, user_id, event_type, value FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, user_id, event_type, value + 1 FROM
  events WHERE event_id % 6 = 0)
SELECT * FROM old UNION ALL SELECT event_id, user_id, event_type, min(value) AS value FROM n WHERE event_id NOT IN (SELECT event_id FROM old) GROUP BY ALL""")
def merge_insert_only(spark, d):
    return merge.insert_only(*_events(spark, d), ["event_id"])


@query(
    "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT o_orderkey + 10000000, 'P' FROM orders WHERE o_orderkey % 7 = 0"
)
def merge_delete_version(spark, d):
    o = tab(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    batch = o.filter("o_orderkey % 7 = 0").select((C("o_orderkey") + 10_000_000).alias("o_orderkey"), F.lit("P").alias("o_orderstatus"))
    return merge.delete_version(o, batch, "o_orderstatus", "P")


# ---- dimensions: customers as first loaded, then a batch with moved, unchanged and new members

_DAY0, _DAY1 = "2024-01-01", "2024-02-01"


def _customers(spark, d):
    return tab(spark, d, "customer").select(
        C("c_custkey").alias("customer_id"), C("c_name").alias("name"), C("c_mktsegment").alias("segment"),
        C("c_nationkey").alias("nation_id")
    )


def _batch(spark, d):
    c = _customers(spark, d)
    moved = F.when(C("customer_id") % 7 == 0, "MOVED").when(C("customer_id") % 11 == 0, F.lit(None)).otherwise(C("segment"))
    old = c.filter("customer_id % 2 = 1 OR customer_id % 7 = 0").withColumn("segment", moved)
    return old.unionByName(c.filter("customer_id % 20 = 0").withColumn("customer_id", C("customer_id") + 10_000_000))


def _dim(spark, d):
    return dimensions.numbered(dimensions.stamped(_customers(spark, d), _DAY0), "customer_key", ["customer_id"])


_DIM = """src AS (SELECT c_custkey AS customer_id, c_name AS name, c_mktsegment AS segment, c_nationkey AS nation_id FROM customer),
dim AS (SELECT row_number() OVER (ORDER BY customer_id) AS customer_key, src.*, DATE '2024-01-01' AS effective_date, CAST(NULL AS DATE) AS end_date,
  TRUE AS is_current, 1 AS version FROM src),
b AS (SELECT customer_id, name, CASE WHEN customer_id % 7 = 0 THEN 'MOVED' WHEN customer_id % 11 = 0 THEN NULL ELSE segment END AS segment, nation_id
  FROM src WHERE customer_id % 2 = 1 OR customer_id % 7 = 0
 UNION ALL SELECT customer_id + 10000000, name, segment, nation_id FROM src WHERE customer_id % 20 = 0),
chg AS (SELECT b.*, d.customer_key AS old_key, d.version AS v FROM b JOIN dim d USING (customer_id) WHERE b.segment IS DISTINCT FROM d.segment OR
  b.nation_id IS DISTINCT FROM d.nation_id),
mx AS (SELECT max(customer_key) AS k FROM dim),
scd2 AS (SELECT d.customer_key, d.customer_id, d.name, d.segment, d.nation_id, d.effective_date, CASE WHEN c.old_key IS NOT NULL THEN DATE
  '2024-01-31' ELSE d.end_date END AS end_date, c.old_key IS NULL AS is_current, d.version FROM dim d LEFT JOIN chg c ON d.customer_key = c.old_key
 UNION ALL SELECT k + row_number() OVER (ORDER BY g, customer_id), customer_id, name, segment, nation_id, DATE '2024-02-01', NULL, TRUE, version
 FROM (SELECT 0 AS g, customer_id, name, segment, nation_id, v + 1 AS version FROM chg UNION ALL SELECT 1, customer_id, name, segment, nation_id, 1
  FROM b WHERE customer_id NOT IN (SELECT customer_id FROM dim)), mx)"""


def _scd2(spark, d):
    return dimensions.scd2(_dim(spark, d), _batch(spark, d), "customer_key", ["customer_id"], ["segment", "nation_id"], _DAY1)


@query(f"WITH {_DIM} SELECT * FROM scd2")
def scd2_apply(spark, d):
    return _scd2(spark, d)


@query(f"WITH {_DIM} SELECT * FROM scd2")
def scd2_rerun_same_day(spark, d):
    return dimensions.scd2(_scd2(spark, d), _batch(spark, d), "customer_key", ["customer_id"], ["segment", "nation_id"], _DAY1)


@query(f"""WITH {_DIM}, late AS (SELECT customer_id, 'LATE' AS segment FROM src WHERE customer_id % 3 = 0 UNION ALL SELECT customer_id + 10000000,
  'LATE' FROM src WHERE customer_id % 60 = 0 UNION ALL SELECT customer_id + 20000000, 'LATE' FROM src WHERE customer_id % 50 = 0),
v AS (SELECT s.* FROM scd2 s JOIN late USING (customer_id) WHERE DATE '2024-01-15' BETWEEN effective_date AND coalesce(end_date, DATE '9999-12-31')),
n AS (SELECT customer_id, max(version) AS m, min(effective_date) FILTER (effective_date > DATE '2024-01-15') AS nx FROM scd2 GROUP BY 1),
todo AS (SELECT v.customer_id IS NULL AS g, l.customer_id, v.name, l.segment, v.nation_id, CASE WHEN v.customer_id IS NULL THEN n.nx - 1 ELSE
  v.end_date END AS end_date, CASE WHEN v.customer_id IS NULL THEN n.nx IS NULL ELSE v.is_current END AS is_current, coalesce(n.m, 0) + 1 AS version
 FROM late l LEFT JOIN v USING (customer_id) LEFT JOIN n USING (customer_id))
SELECT s.customer_key, s.customer_id, s.name, s.segment, s.nation_id, s.effective_date, CASE WHEN v.customer_key IS NULL THEN s.end_date ELSE DATE
  '2024-01-14' END AS end_date, s.is_current AND v.customer_key IS NULL AS is_current, s.version FROM scd2 s LEFT JOIN v USING (customer_key)
UNION ALL SELECT (SELECT max(customer_key) FROM scd2) + row_number() OVER (ORDER BY g, customer_id), customer_id, name, segment, nation_id, DATE
  '2024-01-15', CAST(end_date AS DATE), is_current, version FROM todo""")
def scd2_late_batch(spark, d):
    """A batch that is back-dated between two loads: into the history of known members, of members that began later, and new ones."""
    c = tab(spark, d, "customer").select(C("c_custkey").alias("customer_id"))
    ids = c.filter("customer_id % 3 = 0").union(
        c.filter("customer_id % 60 = 0").select(C("customer_id") + 10_000_000)
    ).union(c.filter("customer_id % 50 = 0").select(C("customer_id") + 20_000_000))
    return dimensions.scd2(_scd2(spark, d), ids.withColumn("segment", F.lit("LATE")), "customer_key", ["customer_id"], ["segment", "nation_id"], "2024-01-15")


@query(f"WITH {_DIM} SELECT customer_id, segment FROM chg")
def scd2_change_detect(spark, d):
    b, c = _batch(spark, d).alias("b"), _dim(spark, d).alias("c")
    return b.join(c, "customer_id").filter(dimensions.changed(["segment", "nation_id"])).select("customer_id", "b.segment")


@query(
    f"""WITH {_DIM} SELECT b.customer_id FROM b JOIN dim d USING (customer_id) WHERE coalesce('v' || lower(trim(b.segment)), 'n') <> coalesce('v' ||
  lower(trim(d.segment)), 'n')"""
)
def scd2_hash_detect(spark, d):
    h = dimensions.attribute_hash(["segment"])
    b, c = _batch(spark, d).select("customer_id", h.alias("hb")), _dim(spark, d).select("customer_id", h.alias("hc"))
    return b.join(c, "customer_id").filter("hb <> hc").select("customer_id")


@query(f"""WITH {_DIM}, bad AS (SELECT customer_id, effective_date, CASE WHEN customer_id % 7 = 0 THEN NULL ELSE end_date END AS end_date, is_current
  OR customer_id % 7 = 0 AS is_current, version FROM scd2),
n AS (SELECT *, lead(effective_date) OVER (PARTITION BY customer_id ORDER BY effective_date, version) AS nx FROM bad)
SELECT customer_id, 'current_rows' AS fault, count(*) FILTER (is_current) AS n FROM bad GROUP BY customer_id HAVING count(*) FILTER (is_current) <> 1
UNION ALL SELECT customer_id, 'overlap', count(*) FROM n WHERE coalesce(end_date, DATE '9999-12-31') >= nx GROUP BY customer_id""")
def scd2_integrity(spark, d):
    """Integrity faults after every seventh member's end dates are lost."""
    bad = _scd2(spark, d).withColumns(
        {"end_date": F.when(C("customer_id") % 7 == 0, None).otherwise(C("end_date")), "is_current": C("is_current") | (C("customer_id") % 7 == 0)}
    )
    return dimensions.scd2_integrity(bad, ["customer_id"])


_DIM1 = """src AS (SELECT c_custkey AS customer_id, c_name AS name, c_mktsegment AS segment, c_nationkey AS nation_id FROM customer),
dim AS (SELECT row_number() OVER (ORDER BY customer_id) AS customer_key, * FROM src),
b AS (SELECT customer_id, name, CASE WHEN customer_id % 7 = 0 THEN 'MOVED' WHEN customer_id % 11 = 0 THEN NULL ELSE segment END AS segment, nation_id
  FROM src WHERE customer_id % 2 = 1 OR customer_id % 7 = 0
 UNION ALL SELECT customer_id + 10000000, name, segment, nation_id FROM src WHERE customer_id % 20 = 0),
fresh AS (SELECT (SELECT max(customer_key) FROM dim) + row_number() OVER (ORDER BY customer_id) AS customer_key, * FROM b WHERE customer_id NOT IN
  (SELECT customer_id FROM dim))"""


def _dim1(spark, d):
    return dimensions.numbered(_customers(spark, d), "customer_key", ["customer_id"])


@query(
    f"WITH {_DIM1} SELECT customer_key, d.customer_id, d.name, CASE WHEN b.customer_id IS NOT NULL THEN b.segment ELSE d.segment END AS segment, d.nation_id FROM dim d LEFT JOIN b USING (customer_id) UNION ALL SELECT * FROM fresh"
)
def scd1_apply(spark, d):
    return dimensions.scd1(_dim1(spark, d), _batch(spark, d), "customer_key", ["customer_id"])


@query(f"WITH {_DIM1} SELECT * FROM dim UNION ALL SELECT * FROM fresh")
def scd0_apply(spark, d):
    return dimensions.scd0(_dim1(spark, d), _batch(spark, d), "customer_key", ["customer_id"])


@query(
    f"WITH {_DIM1} SELECT customer_key, d.customer_id, d.name, CASE WHEN b.customer_id IS NOT NULL THEN b.segment ELSE d.segment END AS segment, d.nation_id, CASE WHEN b.customer_id IS NOT NULL AND b.segment IS DISTINCT FROM d.segment THEN d.segment END AS previous_segment FROM dim d LEFT JOIN b USING (customer_id)"
)
def scd3_apply(spark, d):
    return dimensions.scd3(_dim1(spark, d), _batch(spark, d), ["customer_id"], "segment")


@query(f"WITH {_DIM} SELECT customer_key, customer_id, name, segment, nation_id, effective_date, version FROM scd2 WHERE is_current")
def scd4_current(spark, d):
    return dimensions.scd4(_scd2(spark, d))[0]


@query(f"WITH {_DIM} SELECT * FROM scd2 WHERE NOT is_current")
def scd4_history(spark, d):
    return dimensions.scd4(_scd2(spark, d))[1]


@query("SELECT DISTINCT c_mktsegment AS segment, c_nationkey AS nation_id, CAST(NULL AS VARCHAR) AS manager FROM customer")
def dimension_project(spark, d):
    return dimensions.project(tab(spark, d, "customer"), {"segment": "c_mktsegment", "nation_id": "c_nationkey", "manager": "c_manager"})


@query("SELECT row_number() OVER (ORDER BY s_nationkey, s_name, s_suppkey) AS supplier_key, s_nationkey, s_name, s_suppkey FROM supplier")
def surrogate_keys(spark, d):
    return dimensions.numbered(tab(spark, d, "supplier").select("s_nationkey", "s_name", "s_suppkey"), "supplier_key", ["s_nationkey", "s_name"])


@query(
    "SELECT row_number() OVER (ORDER BY l_partkey, l_orderkey, l_linenumber, l_suppkey) AS line_key, l_partkey, l_orderkey, l_linenumber, "
    "l_suppkey FROM lineitem"
)
def surrogate_keys_large(spark, d):
    """A key for every line, after a shuffle whose rows come in any order."""
    lines = tab(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey").repartition(7)
    return dimensions.numbered(lines, "line_key", ["l_partkey", "l_orderkey"])


@query("""WITH dim AS (SELECT row_number() OVER (ORDER BY c_custkey) AS customer_key, c_custkey FROM customer WHERE c_custkey % 10 <> 3),
lost AS (SELECT DISTINCT o_custkey AS c_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM dim))
SELECT (SELECT max(customer_key) FROM dim) + row_number() OVER (ORDER BY c_custkey) AS customer_key, c_custkey, TRUE AS is_inferred FROM lost""")
def inferred_members(spark, d):
    dim = dimensions.numbered(tab(spark, d, "customer").filter("c_custkey % 10 <> 3").select("c_custkey"), "customer_key", ["c_custkey"])
    return dimensions.inferred_members(tab(spark, d, "orders").select(C("o_custkey").alias("c_custkey")), dim, "customer_key", ["c_custkey"])


@query("""WITH s AS (SELECT CAST(unnest(generate_series(DATE '2020-01-01', DATE '2030-12-31', INTERVAL 1 DAY)) AS DATE) AS x)
SELECT CAST(strftime(x, '%Y%m%d') AS INTEGER) AS date_key, x AS full_date, CAST(isodow(x) AS INTEGER) AS day_of_week, dayname(x) AS day_name,
  CAST(day(x) AS INTEGER) AS day_of_month, CAST(dayofyear(x) AS INTEGER) AS day_of_year,
CAST(weekofyear(x) AS INTEGER) AS week_of_year, CAST(month(x) AS INTEGER) AS month_number, monthname(x) AS month_name, CAST(quarter(x) AS INTEGER) AS
  quarter_number, CAST(year(x) AS INTEGER) AS year_number, strftime(x, '%Y-%m') AS year_month,
CAST(quarter(x + INTERVAL 3 MONTH) AS INTEGER) AS fiscal_quarter, CAST(year(x + INTERVAL 3 MONTH) AS INTEGER) AS fiscal_year, isodow(x) >= 6 AS
  is_weekend, strftime(x, '%m-%d') IN ('01-01', '07-04', '12-25') AS is_holiday, x = last_day(x) AS is_month_end,
CAST(date_trunc('month', x) AS DATE) AS month_start, last_day(x) AS month_end, CAST(strftime(x - INTERVAL 1 DAY, '%Y%m%d') AS INTEGER) AS
  prior_day_key, CAST(strftime(x + INTERVAL 1 DAY, '%Y%m%d') AS INTEGER) AS next_day_key,
CAST(strftime(x - INTERVAL 1 MONTH, '%Y%m%d') AS INTEGER) AS prior_month_key, CAST(strftime(x - INTERVAL 12 MONTH, '%Y%m%d') AS INTEGER) AS
  prior_year_key FROM s""")
def dim_date(spark, d):
    return dimensions.dim_date(spark, "2020-01-01", "2030-12-31", fiscal_start=10)


@query(
    "SELECT * FROM (VALUES (1, 'ACTUAL', 'Actual', 1), (2, 'PLAN', 'Plan', 2), (3, 'FORECAST', 'Forecast', 3), (4, 'REFORECAST', "
    "'Reforecast', 4)) v(version_key, version_code, version_name, display_order)"
)
def dim_version(spark, d):
    return dimensions.dim_version(spark)


# ---- facts


def _fact_days(spark, d):
    """Orders dealt over January to March 2024 by their key."""
    return tab(spark, d, "orders").select(
        "o_orderkey", C("o_custkey").alias("customer_id"), C("o_totalprice").alias("amount"),
        F.date_add(F.lit("2024-01-01").cast("date"), (C("o_orderkey") % 80).cast("int")).alias("day")
    )


_FACTS = "f AS (SELECT o_orderkey, o_custkey AS customer_id, o_totalprice AS amount, DATE '2024-01-01' + CAST(o_orderkey % 80 AS INTEGER) AS day FROM orders)"


@query(
    f"WITH {_DIM}, {_FACTS} SELECT f.*, coalesce(customer_key, -1) AS customer_key FROM f LEFT JOIN scd2 s ON f.customer_id = s.customer_id AND is_current AND s.customer_id % 9 <> 0"
)
def fact_load_current(spark, d):
    return facts.load(
        _fact_days(spark, d),
        [{"dim": _scd2(spark, d).filter("customer_id % 9 <> 0"), "natural": {"customer_id": "customer_id"}, "key": "customer_key"}]
    )


@query(
    f"WITH {_DIM}, {_FACTS} SELECT f.*, coalesce(customer_key, -1) AS customer_key FROM f LEFT JOIN scd2 s ON f.customer_id = s.customer_id AND f.day BETWEEN s.effective_date AND coalesce(s.end_date, DATE '9999-12-31')"
)
def fact_load_asof(spark, d):
    return facts.lookup_as_of(_fact_days(spark, d), _scd2(spark, d), {"customer_id": "customer_id"}, "customer_key", "day")


@query(
    "SELECT l_orderkey AS order_number, l_quantity AS units, CAST(year(l_shipdate) * 10000 + month(l_shipdate) * 100 + day(l_shipdate) AS "
    "INTEGER) AS date_key, TIMESTAMP '2024-01-01 00:00:00' AS load_timestamp FROM lineitem"
)
def fact_project(spark, d):
    t = tab(spark, d, "lineitem").withColumn("date_key", date_key(C("l_shipdate")))
    return facts.project(t, {"order_number": "l_orderkey", "units": "l_quantity"}, ["date_key"], F.lit("2024-01-01").cast("timestamp_ntz"))


_LATE = "SELECT event_id, ts FROM events WHERE ts {} TIMESTAMP '2024-01-15 00:00:00'"


@query(_LATE.format("<"))
def late_fact_split(spark, d):
    return facts.split_late(tab(spark, d, "events").select("event_id", "ts"), "ts", "2024-01-15")[1]


@query("SELECT event_id, ts, ts < TIMESTAMP '2024-01-15 00:00:00' AS is_late FROM events WHERE ts >= TIMESTAMP '2024-01-12 00:00:00'")
def late_fact_union(spark, d):
    return facts.union_late(*facts.split_late(tab(spark, d, "events").select("event_id", "ts"), "ts", "2024-01-15"), "ts", "2024-01-15", 3)


_GRAIN = "SELECT o_custkey, CAST(date_trunc('{}', o_orderdate) AS DATE) AS period, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS o_totalprice, count(*) AS n_transactions FROM orders GROUP BY ALL"


@query(_GRAIN.format("day"))
def grain_daily(spark, d):
    return facts.to_grain(tab(spark, d, "orders"), "day", "o_orderdate", ["o_custkey"], ["o_totalprice"])


@query(_GRAIN.format("month"))
def grain_monthly(spark, d):
    return facts.to_grain(tab(spark, d, "orders"), "month", "o_orderdate", ["o_custkey"], ["o_totalprice"])


# ---- quality and reconciliation


def _holes(spark, d):
    return tab(spark, d, "orders").withColumn("o_orderpriority", F.when(C("o_orderkey") % 13 != 0, C("o_orderpriority")))


def _check_sql(name, table, column, kind, expected, actual, passed, source):
    return f"SELECT '{name}' AS check_name, '{table}' AS table_name, '{column}' AS column_name, '{kind}' AS check_type, '{expected}' AS expected, CAST({actual} AS VARCHAR) AS actual, {passed} AS passed FROM ({source})"


_NULLS = _check_sql(
    "null_check_o_orderpriority", "orders", "o_orderpriority", "NULL", "0", "n", "n = 0",
    "SELECT count(*) AS n FROM orders WHERE o_orderkey % 13 = 0"
)
_DUPS = _check_sql(
    "duplicate_check", "lineitem", "l_orderkey,l_linenumber", "DUPLICATE", "0", "n", "n = 0",
    "SELECT count(*) AS n FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)"
)
_COUNT = _check_sql("row_count_check", "orders", "*", "ROW_COUNT", "1-1000000000", "n", "n BETWEEN 1 AND 1000000000", "SELECT count(*) AS n FROM orders")
_FRESH = _check_sql(
    "freshness_check_ts", "events", "ts", "FRESHNESS", "<= 24", "coalesce(CAST(h AS VARCHAR), 'NO DATA')", "coalesce(h <= 24, FALSE)",
    "SELECT date_diff('hour', max(ts), TIMESTAMP '2024-02-01 10:30:00') AS h FROM events"
)
_REF = _check_sql(
    "fk_check_o_custkey", "orders", "o_custkey", "REFERENTIAL", "0", "n", "n = 0",
    "SELECT count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 3)"
)


def _results(spark, d):
    o = tab(spark, d, "orders")
    return [
        quality.nulls(_holes(spark, d), "orders", "o_orderpriority"), quality.duplicates(
            tab(spark, d, "lineitem"), "lineitem", ["l_orderkey", "l_linenumber"]
        ), quality.row_count(o, "orders", 1, 1_000_000_000),
        quality.freshness(tab(spark, d, "events"), "events", "ts", 24, F.lit("2024-02-01 10:30:00").cast("timestamp")), quality.referential(
            o, tab(spark, d, "customer").filter("c_custkey % 10 <> 3"), "orders", "o_custkey", "c_custkey"
        ),
    ]


for _i, (_n, _s) in enumerate({"dq_nulls": _NULLS, "dq_duplicates": _DUPS, "dq_row_count": _COUNT, "dq_freshness": _FRESH, "dq_referential": _REF}.items()):
    QUERIES[_n], ORACLE_SQL[_n] = (lambda spark, d, i=_i: _results(spark, d)[i]), _s


@query(f"""WITH r AS ({_NULLS} UNION ALL {_DUPS} UNION ALL {_COUNT} UNION ALL {_FRESH} UNION ALL {_REF}), x AS (SELECT table_name, check_type, passed
  FROM r, range(3) g(i))
SELECT table_name, check_type, count(*) AS total_checks, count(*) FILTER (passed) AS passed_checks, count(*) FILTER (NOT passed) AS failed_checks,
  round(CAST(100.0 AS DOUBLE) * count(*) FILTER (passed) / count(*), 1) AS pass_rate FROM x GROUP BY ALL""")
def dq_dashboard(spark, d):
    """Five checks logged on five days, of which three fall within the last week."""
    from functools import reduce

    logged = reduce(DataFrame.unionByName, _results(spark, d)).crossJoin(
        spark.range(5).select(F.expr("timestampadd(DAY, -3 * cast(id as int), timestamp'2024-02-01 00:00:00')").alias("check_ts"))
    )
    return quality.dashboard(logged, "check_ts", F.lit("2024-02-01").cast("timestamp"), 7)


@query("""WITH o AS (SELECT o_orderkey, o_totalprice - 2000 AS o_totalprice, CASE WHEN o_orderkey % 13 <> 0 THEN o_orderpriority END AS p FROM orders)
SELECT 'positive_o_totalprice' AS check_name, 'orders' AS table_name, 'o_totalprice' AS column_name, 'POSITIVE' AS check_type, '0' AS expected,
  CAST(count(*) FILTER (o_totalprice <= 0) AS VARCHAR) AS actual, count(*) FILTER (o_totalprice <= 0) = 0 AS passed FROM o
UNION ALL SELECT 'complete_o_orderpriority', 'orders', 'o_orderpriority', 'COMPLETENESS', '< 1.0', CAST(count(*) FILTER (p IS NULL) AS VARCHAR),
  100.0 * count(*) FILTER (p IS NULL) / count(*) < 1 FROM o
UNION ALL SELECT 'unique_o_orderkey', 'orders', 'o_orderkey', 'UNIQUE', '0', CAST(count(*) FILTER (n > 1) AS VARCHAR), count(*) FILTER (n > 1) = 0
  FROM (SELECT count(*) AS n FROM o GROUP BY o_orderkey)""")
def dq_rules(spark, d):
    o = _holes(spark, d).withColumn("o_totalprice", C("o_totalprice") - 2000)
    return quality.rules(o, "orders", positive=["o_totalprice"], complete=["o_orderpriority"], unique=["o_orderkey"])


@query("""SELECT 'between_l_discount' AS check_name, 'lineitem' AS table_name, 'l_discount' AS column_name, 'BETWEEN' AS check_type, '0.01..0.09' AS
  expected, CAST(count(*) FILTER (NOT l_discount BETWEEN 0.01 AND 0.09) AS VARCHAR) AS actual, count(*) FILTER (NOT l_discount BETWEEN 0.01 AND 0.09)
  = 0 AS passed FROM lineitem
UNION ALL SELECT 'regex_l_returnflag', 'lineitem', 'l_returnflag', 'REGEX', '^[ARN]$', CAST(count(*) FILTER (NOT regexp_matches(l_returnflag,
  '^[ARN]$')) AS VARCHAR), count(*) FILTER (NOT regexp_matches(l_returnflag, '^[ARN]$')) = 0 FROM lineitem""")
def dq_expectations(spark, d):
    return quality.expectations(tab(spark, d, "lineitem"), "lineitem", {"l_discount": (0.01, 0.09)}, {"l_returnflag": "^[ARN]$"})


@query("""WITH r AS (SELECT 'null_check_o_orderpriority' AS check_name, count(*) FILTER (o_orderkey % 13 = 0) AS n FROM orders UNION ALL SELECT
  'duplicate_check', 0)
SELECT 'run-1' AS run_id, check_name, 'orders' AS table_name, CASE check_name WHEN 'duplicate_check' THEN 'o_orderkey' ELSE 'o_orderpriority' END AS
  column_name, CASE check_name WHEN 'duplicate_check' THEN 'DUPLICATE' ELSE 'NULL' END AS check_type,
'0' AS expected, CAST(n AS VARCHAR) AS actual, n = 0 AS passed, CASE check_name WHEN 'duplicate_check' THEN 'DUPLICATE' ELSE 'NULL' END ||
  ': expected 0, found ' || n AS details, TIMESTAMP '2024-02-01' AS checked_at FROM r""")
def dq_results_table(spark, d):
    """Checks as rows of the results table, with their run and details."""
    o = _holes(spark, d)
    found = quality.nulls(o, "orders", "o_orderpriority").unionByName(quality.duplicates(o, "orders", ["o_orderkey"]))
    return quality.logged(found, "run-1", F.lit("2024-02-01").cast("timestamp")).withColumn("checked_at", C("checked_at").cast("timestamp_ntz"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 13 = 0")
def key_null_guard(spark, d):
    return quality.key_null_guard(_holes(spark, d), ["o_orderkey", "o_orderpriority"])[1].select("o_orderkey", "o_custkey")


def _both(spark, d):
    s = tab(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    t = s.filter("o_orderkey % 50 <> 0").withColumn("o_totalprice", C("o_totalprice") + F.when(C("o_orderkey") % 77 == 0, 1.0).otherwise(0.0))
    return s, t.unionByName(s.filter("o_orderkey % 500 = 1").withColumn("o_orderkey", -C("o_orderkey")))


_BOTH = """s AS (SELECT o_orderkey, o_totalprice, o_orderdate FROM orders), t AS (SELECT o_orderkey, o_totalprice + CASE WHEN o_orderkey % 77 = 0
  THEN 1.0 ELSE 0.0 END::DOUBLE AS o_totalprice, o_orderdate FROM s WHERE o_orderkey % 50 <> 0
 UNION ALL SELECT -o_orderkey, o_totalprice, o_orderdate FROM s WHERE o_orderkey % 500 = 1)"""


@query(f"""WITH {_BOTH}, a AS (SELECT count(*) AS source_rows, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS source_sum, count(DISTINCT
  o_orderkey) AS source_keys FROM s),
b AS (SELECT count(*) AS target_rows, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS target_sum, count(DISTINCT o_orderkey) AS target_keys FROM t)
SELECT *, source_rows = target_rows AND abs(source_sum - target_sum) <= 0.01 AND source_keys = target_keys AS is_reconciled FROM a, b""")
def recon_control_totals(spark, d):
    return recon.control_totals(*_both(spark, d), "o_totalprice", "o_orderkey")


@query(f"""WITH {_BOTH}, a AS (SELECT CAST(o_orderdate AS DATE) AS day, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS x FROM s GROUP BY 1), b AS
  (SELECT CAST(o_orderdate AS DATE) AS day, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS y FROM t GROUP BY 1)
SELECT day, CAST(x AS DOUBLE) AS source_sum, CAST(y AS DOUBLE) AS target_sum, CAST(coalesce(x, 0) - coalesce(y, 0) AS DOUBLE) AS difference FROM a
  FULL JOIN b USING (day) WHERE coalesce(x, 0) <> coalesce(y, 0)""")
def recon_daily_totals(spark, d):
    return recon.daily_totals(*_both(spark, d), "o_orderdate", "o_totalprice")


@query(f"WITH {_BOTH} SELECT o_orderkey, o_totalprice FROM s WHERE o_orderkey NOT IN (SELECT o_orderkey FROM t)")
def recon_missing(spark, d):
    return recon.missing(*_both(spark, d), ["o_orderkey"]).select("o_orderkey", "o_totalprice")


@query(
    f"WITH {_BOTH} SELECT coalesce(s.o_orderkey, t.o_orderkey) AS o_orderkey, CASE WHEN t.o_orderkey IS NULL THEN 'missing_in_target' WHEN s.o_orderkey IS NULL THEN 'missing_in_source' WHEN s.o_totalprice IS DISTINCT FROM t.o_totalprice THEN 'mismatch' ELSE 'ok' END AS status FROM s FULL JOIN t ON s.o_orderkey = t.o_orderkey"
)
def recon_full_outer(spark, d):
    return recon.row_status(*_both(spark, d), ["o_orderkey"], ["o_totalprice"])


@query(
    f"WITH {_BOTH} SELECT (SELECT count(*) FROM s) AS source_rows, (SELECT count(*) FROM t) AS target_rows, NOT EXISTS (SELECT * FROM s EXCEPT ALL SELECT * FROM t) AND NOT EXISTS (SELECT * FROM t EXCEPT ALL SELECT * FROM s) AS is_equal"
)
def recon_hash(spark, d):
    return recon.hash_match(*_both(spark, d), ["o_orderkey", "o_totalprice", "o_orderdate"])


@query(
    "SELECT 'part' AS dimension, (SELECT count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)) AS "
    "n_orphans UNION ALL SELECT 'supplier', (SELECT count(*) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE "
    "s_suppkey % 4 <> 0))"
)
def orphan_facts(spark, d):
    return recon.orphan_facts(
        tab(spark, d, "lineitem"),
        {
            "part": ("l_partkey", tab(spark, d, "part").filter("p_size > 5"), "p_partkey"),
            "supplier": ("l_suppkey", tab(spark, d, "supplier").filter("s_suppkey % 4 <> 0"), "s_suppkey")
        }
    )


# ---- schema


@query("SELECT c_custkey, c_name, CAST(0 AS DOUBLE) AS c_credit, '' AS c_note, CAST(NULL AS DATE) AS c_since, FALSE AS c_vip FROM customer")
def schema_backfill(spark, d):
    target = T.StructType(
        [
            T.StructField("c_custkey", T.LongType()), T.StructField("c_name", T.StringType()), T.StructField("c_credit", T.DoubleType()),
            T.StructField("c_note", T.StringType()), T.StructField("c_since", T.DateType()), T.StructField("c_vip", T.BooleanType())
        ]
    )
    return schema.align(tab(spark, d, "customer"), target)


@query(
    "SELECT s_suppkey, s_name, CAST(NULL AS DOUBLE) AS s_rating FROM supplier WHERE s_suppkey % 2 = 1 UNION ALL SELECT s_suppkey, s_name, "
    "CAST(s_nationkey AS DOUBLE) FROM supplier WHERE s_suppkey % 2 = 0"
)
def schema_add_columns(spark, d):
    """An old load without a column and a new one with it, in the widened schema."""
    s = tab(spark, d, "supplier")
    old = s.filter("s_suppkey % 2 = 1").select("s_suppkey", "s_name")
    new = s.filter("s_suppkey % 2 = 0").select("s_suppkey", "s_name", C("s_nationkey").cast("double").alias("s_rating"))
    wide = schema.widened(old.schema, new)
    return schema.align(old, wide, policy="null").unionByName(schema.align(new, wide))


@query("""WITH m AS (SELECT max(length(c_name)) AS n, max(c_custkey * 100) AS k FROM customer)
SELECT 'c_name' AS column_name, 'varchar(10)' AS current_type, 'varchar(' || least(n + 10, 65535) || ')' AS needed_type FROM m WHERE n > 10
UNION ALL SELECT 'k', 'smallint', CASE WHEN k <= 2147483647 THEN 'int' ELSE 'bigint' END FROM m WHERE k > 32767""")
def widen_report(spark, d):
    c = tab(spark, d, "customer").select("c_name", "c_mktsegment", (C("c_custkey") * 100).alias("k"), C("c_nationkey").alias("j"))
    return schema.widen_report(c, {"c_name": 10, "c_mktsegment": 256}, {"k": "smallint", "j": "int"})


@query("""WITH m AS (SELECT max(length(c_name)) AS n, max(c_custkey * 100) AS k FROM customer)
SELECT 1 AS ordinal, 'c_name' AS column_name, 'VARCHAR' AS data_type, CAST(CASE WHEN n > 10 THEN least(n + 10, 65535) ELSE 10 END AS INTEGER) AS
  max_length, TRUE AS is_nullable FROM m
UNION ALL SELECT 2, 'c_mktsegment', 'VARCHAR', 256, TRUE UNION ALL SELECT 3, 'k', CASE WHEN k <= 32767 THEN 'SMALLINT' WHEN k <= 2147483647 THEN
  'INTEGER' ELSE 'BIGINT' END, NULL, TRUE FROM m UNION ALL SELECT 4, 'j', 'INTEGER', NULL, TRUE""")
def widen_applied(spark, d):
    """A table's columns after they have grown for a batch: texts in length, integers in type."""
    c = tab(spark, d, "customer").select("c_name", "c_mktsegment", (C("c_custkey") * 100).alias("k"), C("c_nationkey").alias("j"))
    kinds = {"c_name": T.StringType(), "c_mktsegment": T.StringType(), "k": T.ShortType(), "j": T.IntegerType()}
    target = schema.with_lengths(T.StructType([T.StructField(n, t) for n, t in kinds.items()]), {"c_name": 10})
    return schema.column_metadata(spark, schema.grown(target, c))


@query(
    "SELECT * FROM (VALUES ('c_acctbal', 'type double -> string', TRUE), ('c_mktsegment', 'removed', TRUE), ('c_new', 'added', FALSE), "
    "('c_name', 'varchar_grown', FALSE), ('c_custkey', 'key_type bigint -> int', TRUE)) v(column_name, change, is_breaking)"
)
def contract_diff(spark, d):
    old = tab(spark, d, "customer")
    new = old.drop("c_mktsegment").withColumns(
        {"c_acctbal": C("c_acctbal").cast("string"), "c_new": F.lit(None).cast("int"), "c_custkey": C("c_custkey").cast("int")}
    )
    return schema.contract_diff(spark, old.schema, new.schema, ["c_custkey"], {"c_name": (50, 60)})


@query("SELECT 'k' AS column_name, 'string' AS source_type, 'int' AS target_type, (SELECT count(*) FROM events) AS n_values")
def type_guard_report(spark, d):
    e = tab(spark, d, "events").select(F.get_json_object("props", "$.k").alias("k"), "event_type", F.lit(None).cast("string").alias("nothing"))
    return schema.type_guard(
        e,
        T.StructType([T.StructField("k", T.IntegerType()), T.StructField("event_type", T.StringType()), T.StructField("nothing", T.DoubleType())])
    )


def _mixed(spark, d):
    """Texts that hold integers, decimals and words in turn."""
    k = F.get_json_object("props", "$.k")
    return tab(spark, d, "events").select(
        "event_id",
        F.when(C("event_id") % 3 == 0, k).when(C("event_id") % 3 == 1, F.concat(k, F.lit(".5"))).otherwise(C("event_type")).alias("v")
    )


_MIXED = "x AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN props->>'$.k' WHEN event_id % 3 = 1 THEN (props->>'$.k') || '.5' ELSE event_type END AS v, event_id % 3 AS m FROM events)"


@query(f"WITH {_MIXED} SELECT event_id, CASE WHEN m <> 2 THEN CAST(v AS DOUBLE) END AS v FROM x")
def resolve_choice_cast(spark, d):
    return schema.choice_cast(_mixed(spark, d), "v", "double")


@query(
    f"WITH {_MIXED} SELECT event_id, CASE WHEN m = 0 THEN CAST(v AS BIGINT) END AS v_bigint, CASE WHEN m = 1 THEN CAST(v AS DOUBLE) END AS v_double, CASE WHEN m = 2 THEN v END AS v_string FROM x"
)
def resolve_choice_make_cols(spark, d):
    return schema.choice_columns(_mixed(spark, d), "v", ["bigint", "double", "string"])


@query(
    f"WITH {_MIXED} SELECT event_id, CASE WHEN m = 0 THEN CAST(v AS BIGINT) END AS as_bigint, CASE WHEN m <> 2 THEN CAST(v AS DOUBLE) END AS as_double FROM x"
)
def resolve_choice_make_struct(spark, d):
    return schema.choice_struct(_mixed(spark, d), "v", ["bigint", "double"]).select(
        "event_id", C("v.bigint").alias("as_bigint"), C("v.double").alias("as_double")
    )


@query(f"WITH {_MIXED} SELECT event_id, CAST(v AS DOUBLE) AS v FROM x WHERE m <> 2")
def resolve_choice_project(spark, d):
    return schema.choice_project(_mixed(spark, d), "v", "double")


@query(f"WITH {_MIXED} SELECT event_id, v, 'v' AS reason FROM x WHERE m = 2")
def quarantine_split(spark, d):
    return schema.quarantine(_mixed(spark, d), {"v": "double"})[1]


@query(
    "SELECT 'error_threshold' AS check_name, 'events' AS table_name, '*' AS column_name, 'ERRORS' AS check_type, '<= 40.0' AS expected, "
    "CAST(count(*) FILTER (event_id % 3 = 2) AS VARCHAR) AS actual, 100.0 * count(*) FILTER (event_id % 3 = 2) / count(*) <= 40 AS passed "
    "FROM events"
)
def error_threshold(spark, d):
    x = _mixed(spark, d)
    return quality.within_errors(schema.quarantine(x, {"v": "double"})[1], x, "events", 40.0)


@query("""WITH o AS (SELECT count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(38,2))) AS t FROM orders)
SELECT CASE i WHEN 0 THEN 'trailer_rows' ELSE 'trailer_o_totalprice' END AS check_name, 'orders' AS table_name, CASE i WHEN 0 THEN '*' ELSE
  'o_totalprice' END AS column_name, 'TRAILER' AS check_type,
CASE i WHEN 0 THEN CAST(n + 1 AS VARCHAR) ELSE CAST(t AS VARCHAR) END AS expected, CASE i WHEN 0 THEN CAST(n AS VARCHAR) ELSE CAST(t AS VARCHAR) END
  AS actual, i = 1 AS passed FROM o, range(2) g(i)""")
def trailer_check(spark, d):
    """All orders against a trailer with their sum and one row too many."""
    o = tab(spark, d, "orders")
    told = o.agg(F.count("*").alias("n"), F.sum(C("o_totalprice").cast("decimal(38,2)")).alias("t")).first()
    return quality.trailer(o, "orders", told.n + 1, "o_totalprice", told.t)


@query(
    "SELECT c_custkey, o_orderkey, c_custkey IS NULL AS no_customer FROM customer FULL JOIN (SELECT CASE WHEN o_custkey % 3 = 0 THEN "
    "o_custkey + 10000000 ELSE o_custkey END AS k, o_orderkey FROM orders) o ON c_custkey = k"
)
def full_outer_join(spark, d):
    """Whole tables; a third of the customers' orders name customers that there are not."""
    o = tab(spark, d, "orders").select(F.when(C("o_custkey") % 3 == 0, C("o_custkey") + 10_000_000).otherwise(C("o_custkey")).alias("k"), "o_orderkey")
    return tab(spark, d, "customer").join(o, C("c_custkey") == C("k"), "full").select("c_custkey", "o_orderkey", C("c_custkey").isNull().alias("no_customer"))


@query("SELECT a.n_name AS name, b.n_name AS neighbour FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def self_join(spark, d):
    n = tab(spark, d, "nation")
    return n.alias("a").join(
        n.alias("b"), (C("a.n_regionkey") == C("b.n_regionkey")) & (C("a.n_nationkey") < C("b.n_nationkey"))
    ).select(C("a.n_name").alias("name"), C("b.n_name").alias("neighbour"))


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def semi_join(spark, d):
    return tab(spark, d, "orders").join(
        tab(spark, d, "customer").filter("c_mktsegment = 'BUILDING'"), C("o_custkey") == C("c_custkey"), "left_semi"
    ).select("o_custkey").distinct()


@query("SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark, d):
    return tab(spark, d, "customer").select(C("c_nationkey").alias("nation")).union(tab(spark, d, "supplier").select("s_nationkey")).distinct()


@query(f"WITH {_MIXED} SELECT event_id, CAST(v AS DOUBLE) AS v FROM x WHERE m <> 2")
def quarantine_good(spark, d):
    return schema.quarantine(_mixed(spark, d), {"v": "double"})[0]


@query("SELECT c_custkey AS cust_key, c_name AS cust_name, c_mktsegment AS mkt_segment FROM customer")
def normalise_names(spark, d):
    return ingest.normalized(
        tab(spark, d, "customer").select(C("c_custkey").alias("Cust Key"), C("c_name").alias("__Cust--Name "), C("c_mktsegment").alias("mkt.Segment"))
    )


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, CAST(c_nationkey AS BIGINT) AS nation FROM customer")
def apply_mapping(spark, d):
    return schema.apply_mapping(tab(spark, d, "customer"), [("c_custkey", "bigint", "id", "string"), ("c_nationkey", "int", "nation", "bigint")])


@query("SELECT event_id, CAST(props->>'$.k' AS INTEGER) AS k FROM events")
def json_parse(spark, d):
    return ingest.parse_json(tab(spark, d, "events").select("event_id", "props"), "props", "k int")


@query("SELECT event_id, i AS index, x AS element FROM (SELECT event_id, unnest(range(CAST(event_id % 4 AS BIGINT))) AS i, event_type AS x FROM events)")
def relationalize(spark, d):
    e = tab(spark, d, "events").select("event_id", F.array_repeat("event_type", (C("event_id") % 4).cast("int")).alias("tags"))
    return schema.relationalize(e, "event_id")["tags"].withColumn("index", C("index").cast("long"))


@query("SELECT event_id, user_id FROM events WHERE value > 50")
def split_rows(spark, d):
    return schema.split_rows(tab(spark, d, "events"), C("value") > 50)[0].select("event_id", "user_id")


# ---- reports

_NET = "CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))"


def _net():
    return C("l_extendedprice").cast("decimal(18,2)") * (1 - C("l_discount").cast("decimal(4,2)"))


@query(
    f"SELECT p_brand, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, o_orderstatus, CAST(sum({_NET}) AS DOUBLE) AS revenue, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS units FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE o_orderdate >= DATE '1997-01-01' GROUP BY ALL"
)
def aum_by_family_month(spark, d):
    o = tab(spark, d, "orders").filter("o_orderdate >= date'1997-01-01'")
    j = tab(spark, d, "lineitem").join(o, C("l_orderkey") == C("o_orderkey"))
    return reports.totals_by(
        j, tab(spark, d, "part"), C("l_partkey") == C("p_partkey"),
        [C("p_brand"), F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"), C("o_orderstatus")],
        {"revenue": _net(), "units": C("l_quantity")}
    )


_PLAN = "SELECT c_mktsegment, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS actual, CAST(sum(CASE WHEN o_orderstatus = 'P' THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS plan, CAST(sum(CASE WHEN o_orderstatus = 'O' THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS forecast FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1"


def _versions(spark, d):
    j = tab(spark, d, "orders").join(tab(spark, d, "customer"), C("o_custkey") == C("c_custkey"))
    return reports.by_version(j, [C("c_mktsegment")], "o_orderstatus", C("o_totalprice").cast("decimal(18,2)"), {"actual": "F", "plan": "P", "forecast": "O"})


@query(
    f"SELECT c_mktsegment, actual, plan, round(actual - plan, 2) AS variance, round(100.0::DOUBLE * (actual - plan) / plan, 1) AS variance_pct FROM ({_PLAN})"
)
def budget_vs_actual(spark, d):
    return reports.variance(_versions(spark, d).drop("forecast"), "actual", "plan")


@query(
    f"SELECT *, round(actual - plan, 2) AS vs_plan, round(100.0::DOUBLE * (actual - plan) / plan, 1) AS vs_plan_pct, round(actual - forecast, 2) AS vs_forecast, round(100.0::DOUBLE * (actual - forecast) / forecast, 1) AS vs_forecast_pct FROM ({_PLAN})"
)
def plan_forecast_variance(spark, d):
    return reports.variance(reports.variance(_versions(spark, d), "actual", "plan", "vs_plan"), "actual", "forecast", "vs_forecast")


@query(
    "SELECT period, CAST(sum(v) AS BIGINT) AS headcount FROM (SELECT CAST(date_trunc('month', ts) AS DATE) AS period, user_id, "
    "arg_max(event_id % 10, ts) AS v FROM events GROUP BY 1, 2) GROUP BY 1"
)
def headcount_trend(spark, d):
    """A user's last level of the month, summed over users: not added over time."""
    e = tab(spark, d, "events").withColumn("headcount", C("event_id") % 10)
    return reports.last_in_period(e, F.date_trunc("month", "ts").cast("date"), ["user_id"], "ts", "headcount")


@query(
    f"WITH {_DIM}, {_FACTS}, k AS (SELECT f.*, customer_key FROM f JOIN scd2 s ON f.customer_id = s.customer_id AND f.day BETWEEN s.effective_date AND coalesce(s.end_date, DATE '9999-12-31')) SELECT segment, CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS total FROM k JOIN scd2 USING (customer_key) WHERE is_current GROUP BY 1"
)
def fund_performance_current(spark, d):
    """Totals over current rows only: facts of versions that have ended do not count."""
    f = facts.lookup_as_of(
        _fact_days(spark, d), _scd2(spark, d), {"customer_id": "customer_id"}, "customer_key", "day"
    ).select("amount", C("customer_key").alias("k"))
    return reports.totals_by(f, _scd2(spark, d).filter("is_current"), C("k") == C("customer_key"), [C("segment")], {"total": C("amount")})


@query(
    f"WITH {_DIM}, {_FACTS}, k AS (SELECT f.*, customer_key FROM f JOIN scd2 s ON f.customer_id = s.customer_id AND f.day BETWEEN s.effective_date AND coalesce(s.end_date, DATE '9999-12-31')) SELECT segment, version, CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS total FROM k JOIN scd2 USING (customer_key) WHERE day <= DATE '2024-02-10' GROUP BY 1, 2"
)
def point_in_time(spark, d):
    f = facts.lookup_as_of(
        _fact_days(spark, d), _scd2(spark, d), {"customer_id": "customer_id"}, "customer_key", "day"
    ).filter("day <= date'2024-02-10'").select("amount", C("customer_key").alias("k"))
    return reports.totals_by(f, _scd2(spark, d), C("k") == C("customer_key"), [C("segment"), C("version")], {"total": C("amount")})


@query(f"WITH {_DIM} SELECT * FROM scd2")
def dimension_history(spark, d):
    """Every member's versions in order."""
    return _scd2(spark, d).orderBy("customer_id", "version")


@query(
    "SELECT c_name, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS spend FROM orders JOIN customer ON o_custkey = c_custkey "
    "WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31' GROUP BY 1"
)
def customer_spend_range(spark, d):
    o = tab(spark, d, "orders").filter("o_orderdate BETWEEN timestamp_ntz'1996-01-01' AND timestamp_ntz'1996-12-31'")
    return reports.totals_by(o, tab(spark, d, "customer"), C("o_custkey") == C("c_custkey"), [C("c_name")], {"spend": C("o_totalprice")})


@query(
    "SELECT o_custkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS "
    "spend FROM orders GROUP BY 1, 2"
)
def monthly_customer_spend(spark, d):
    return tab(spark, d, "orders").groupBy(
        "o_custkey", F.date_trunc("month", "o_orderdate").cast("date").alias("month")
    ).agg(reports.money("o_totalprice").alias("spend"))


@query(
    f"SELECT y, CAST(coalesce(revenue, 0) AS DOUBLE) AS revenue, CAST(coalesce(expense, 0) AS DOUBLE) AS expense, CAST(coalesce(revenue, 0) - coalesce(expense, 0) AS DOUBLE) AS profit FROM (SELECT CAST(year(l_shipdate) AS INTEGER) AS y, sum({_NET}) AS revenue, sum(CAST(l_quantity AS DECIMAL(18,2))) AS expense FROM lineitem GROUP BY 1)"
)
def profit_summary(spark, d):
    by = tab(spark, d, "lineitem").groupBy(F.year("l_shipdate").alias("y")).agg(
        F.sum(_net()).alias("r"), F.sum(C("l_quantity").cast("decimal(18,2)")).alias("e")
    )
    return by.select("y", C("r").cast("double").alias("revenue"), C("e").cast("double").alias("expense"), (C("r") - C("e")).cast("double").alias("profit"))


@query(
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS "
    "DECIMAL(4,2)) AS DOUBLE) AS fee FROM lineitem"
)
def fee_revenue(spark, d):
    return tab(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
        (C("l_extendedprice").cast("decimal(18,2)") * C("l_tax").cast("decimal(4,2)")).cast("double").alias("fee")
    )


@query(
    f"SELECT l_returnflag, CAST(sum({_NET}) AS DOUBLE) AS revenue, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS base, round(CAST(sum({_NET}) AS DOUBLE) / CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE), 6) AS effective_rate FROM lineitem GROUP BY 1"
)
def effective_fee_rate(spark, d):
    return reports.effective_rate(tab(spark, d, "lineitem"), ["l_returnflag"], _net(), C("l_extendedprice"))


@query(
    "SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n_orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue FROM orders GROUP BY 1"
)
def daily_revenue_view(spark, d):
    """Through a view made from a template."""
    from martflow.config import ViewSpec
    from martflow.sources.store import create_view

    view = ViewSpec(
        "v_daily_revenue", "orders_src",
        "SELECT cast(o_orderdate AS date) AS day, count(*) AS n_orders, cast(sum(cast(o_totalprice AS decimal(18,2))) AS double) AS revenue "
        "FROM {source_table} GROUP BY 1"
    )
    return create_view(spark, view, tab(spark, d, "orders"))


# ---- windows


@query("""WITH w AS (SELECT *, lead(value) OVER o AS v, lead(ts) OVER o AS t FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, count(*) AS n_pairs FROM w WHERE value > 60 AND v > 60 AND t <= ts + INTERVAL 1 DAY GROUP BY 1 HAVING count(*) >= 2""")
def fraud_consecutive_high(spark, d):
    return windows.high_pairs(tab(spark, d, "events"), "user_id", "ts", "value", 60, "1 DAY", "event_id")


@query("""WITH w AS (SELECT *, CASE WHEN value > 60 AND lag(value) OVER o > 60 AND ts <= lag(ts) OVER o + INTERVAL 1 DAY THEN 0 ELSE 1 END AS brk
  FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM w)
SELECT user_id, min(ts) AS run_start, max(ts) AS run_end, count(*) AS n_rows FROM r WHERE value > 60 GROUP BY user_id, run HAVING count(*) >= 3""")
def fraud_consecutive_strict(spark, d):
    return windows.high_runs(tab(spark, d, "events"), "user_id", "ts", "value", 60, "1 DAY", "event_id")


@query("SELECT event_id, user_id, value FROM events WHERE value > 100")
def fraud_threshold(spark, d):
    return tab(spark, d, "events").filter(C("value") > 100).select("event_id", "user_id", "value")


@query("SELECT event_id, value, c_name, c_mktsegment FROM events LEFT JOIN customer ON user_id = c_custkey WHERE value > 100")
def fraud_enriched(spark, d):
    from martflow.streaming.stream import enriched, filtered

    return enriched(
        filtered(tab(spark, d, "events"), "value", 100), tab(spark, d, "customer").withColumnRenamed("c_custkey", "user_id"), ["user_id"]
    ).select("event_id", "value", "c_name", "c_mktsegment")


@query("""WITH w AS (SELECT event_id, user_id, ts, event_type, lag(event_type) OVER o AS previous_event_type, lag(ts) OVER o AS t FROM events WINDOW
  o AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, user_id, ts, event_type, previous_event_type FROM w WHERE event_type <> previous_event_type AND ts <= t + INTERVAL 2 HOUR""")
def velocity_check(spark, d):
    return windows.velocity(tab(spark, d, "events").select("event_id", "user_id", "ts", "event_type"), "user_id", "ts", "event_type", "2 HOURS", "event_id")


@query(
    "SELECT o_custkey, o_orderkey, o_totalprice, rank FROM (SELECT *, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS rank "
    "FROM orders) WHERE rank <= 3"
)
def top_txn_per_account(spark, d):
    return windows.top_per_key(
        tab(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], 3, F.desc("o_totalprice")
    ).withColumn("rank", C("rank").cast("long"))


@query(
    "SELECT event_id, user_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1000000.0::DOUBLE AS "
    "seconds_since_last FROM events"
)
def time_since_last_event(spark, d):
    return windows.since_last(tab(spark, d, "events"), "user_id", "ts", "event_id").select("event_id", "user_id", "seconds_since_last")


@query(
    "SELECT user_id, event_id, ts, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r "
    "FROM events) WHERE r = 1"
)
def dedup_latest(spark, d):
    return windows.latest_per_key(tab(spark, d, "events").select("user_id", "event_id", "ts", "event_type"), ["user_id"], F.desc("ts"), F.desc("event_id"))


@query(
    "SELECT c_custkey, row_number() OVER w AS row_number, rank() OVER w AS rank, dense_rank() OVER w AS dense_rank, ntile(4) OVER w AS tile "
    "FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey)"
)
def ntile_buckets(spark, d):
    r = windows.ranked(tab(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), ["c_nationkey"], C("c_acctbal"), C("c_custkey"))
    return r.select("c_custkey", *[C(c).cast("long").alias(c) for c in ("row_number", "rank", "dense_rank", "tile")])


# ---- joins

_JOINED = "SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, l_quantity, p_brand FROM lineitem {} JOIN part ON l_partkey = p_partkey {}"


def _line_part(spark, d):
    return tab(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", C("l_partkey"), "l_quantity"
    ), tab(spark, d, "part").select(C("p_partkey").alias("l_partkey"), "p_brand")


@query(_JOINED.format("", ""))
def broadcast_join(spark, d):
    return joins.broadcast_join(*_line_part(spark, d), ["l_partkey"])


@query(_JOINED.format("LEFT", "AND p_size > 10"))
def salted_join(spark, d):
    line, part = _line_part(spark, d)
    part = tab(spark, d, "part").filter("p_size > 10").select(C("p_partkey").alias("l_partkey"), "p_brand")
    return joins.salted_join(line, part, ["l_partkey"], 8, ["l_orderkey", "l_linenumber"], "left")


@query(_JOINED.format("LEFT", "AND p_size > 10"))
def hot_key_split_join(spark, d):
    line, _ = _line_part(spark, d)
    part = tab(spark, d, "part").filter("p_size > 10").select(C("p_partkey").alias("l_partkey"), "p_brand")
    return joins.hot_key_split_join(line, part, ["l_partkey"], 35)


@query(_JOINED.format("", ""))
def repartition_join(spark, d):
    line, part = _line_part(spark, d)
    return joins.repartitioned_join(line, part, ["l_partkey"], 16)


@query("SELECT count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def bucketed_join(spark, d):
    """Two bucketed tables, joined without a shuffle; the tables are dropped again."""
    line = tab(spark, d, "lineitem").select(C("l_orderkey").alias("k"), "l_linenumber")
    orders = tab(spark, d, "orders").select(C("o_orderkey").alias("k"), "o_totalprice")
    run = uuid.uuid4().hex[:12]  # a session without a shared catalog may find the folders of another's tables
    names = [f"martflow_lines_{run}", f"martflow_orders_{run}"]
    try:
        for df, name in zip((line, orders), names):
            joins.write_bucketed(df, name, ["k"], 8)
        out = joins.bucketed_join(spark, *names, ["k"]).agg(F.count("*").alias("n"), reports.money("o_totalprice").alias("total"))
        return spark.createDataFrame(out.collect(), out.schema)
    finally:
        for name in names:
            spark.sql(f"DROP TABLE IF EXISTS {name}")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')")
def anti_join_orphans(spark, d):
    return recon.missing(
        tab(spark, d, "orders").select("o_orderkey", C("o_custkey").alias("c_custkey")),
        tab(spark, d, "customer").filter("c_mktsegment <> 'BUILDING'"), ["c_custkey"]
    ).select("o_orderkey", C("c_custkey").alias("o_custkey"))


@query("""WITH r AS (SELECT event_type, ts AS at, max(value) AS rate FROM events WHERE event_id % 5 = 0 GROUP BY 1, 2), f AS (SELECT event_id,
  event_type, ts FROM events WHERE event_id % 5 <> 0)
SELECT f.*, r.rate FROM f ASOF LEFT JOIN r ON f.event_type = r.event_type AND f.ts >= r.at""")
def fx_asof(spark, d):
    e = tab(spark, d, "events")
    rates = e.filter("event_id % 5 = 0").select("event_type", C("ts").alias("at"), C("value").alias("rate"))
    return joins.last_known(e.filter("event_id % 5 <> 0").select("event_id", "event_type", "ts"), rates, ["event_type"], "ts", "at", ["rate"])


# ---- event time, in batch (the streams are held against these in tests)

_WINDOW = "SELECT {} AS window_start, {} + INTERVAL {} MINUTE AS window_end, event_type, count(*) AS n_events, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM {} GROUP BY ALL"


@query(_WINDOW.format("time_bucket(INTERVAL 5 MINUTE, ts)", "time_bucket(INTERVAL 5 MINUTE, ts)", 5, "events"))
def tumbling_window_agg(spark, d):
    return windows.window_sums(tab(spark, d, "events"), "ts", ["event_type"], "value", "5 minutes")


@query(
    "SELECT s AS window_start, s + INTERVAL 10 MINUTE AS window_end, event_type, count(*) AS n_events, CAST(sum(CAST(value AS DECIMAL(18,2))) "
    "AS DOUBLE) AS total FROM (SELECT *, time_bucket(INTERVAL 2 MINUTE, ts) - i * INTERVAL 2 MINUTE AS s FROM events, range(5) g(i)) GROUP BY "
    "ALL"
)
def sliding_window_agg(spark, d):
    return windows.window_sums(tab(spark, d, "events"), "ts", ["event_type"], "value", "10 minutes", "2 minutes")


@query("""WITH w AS (SELECT user_id, time_bucket(INTERVAL 60 MINUTE, ts) AS hour, count(*) AS n FROM events GROUP BY ALL), late AS (SELECT user_id,
  time_bucket(INTERVAL 60 MINUTE, ts) AS hour, count(*) AS n FROM events WHERE event_id % 10 <> 0 GROUP BY ALL)
SELECT * FROM w WHERE hour < TIMESTAMP '2024-01-20' UNION ALL SELECT * FROM late WHERE hour >= TIMESTAMP '2024-01-20'""")
def lambda_reconcile(spark, d):
    """The batch layer up to a day, the speed layer (which lacks some events) where the batch layer has nothing yet."""
    from martflow.streaming.stream import lambda_view

    e = tab(spark, d, "events")
    window = F.window("ts", "60 minutes").alias("w")
    by = lambda df: df.groupBy("user_id", window).agg(F.count("*").alias("n")).select("user_id", C("w.start").alias("hour"), "n")
    batch = by(e).filter(C("hour") < F.lit("2024-01-20").cast("timestamp_ntz"))
    return lambda_view(batch, by(e.filter("event_id % 10 <> 0")), ["user_id", "hour"])


@query("""WITH b AS (SELECT user_id, time_bucket(INTERVAL 60 MINUTE, ts) AS hour, count(*) AS n, max(event_id) AS seen FROM events WHERE event_id %
  10 <> 0 AND ts < TIMESTAMP '2024-01-20' GROUP BY ALL),
s AS (SELECT user_id, time_bucket(INTERVAL 60 MINUTE, ts) AS hour, count(*) AS n, max(event_id) AS seen FROM events WHERE ts >= TIMESTAMP
  '2024-01-10' GROUP BY ALL)
SELECT user_id, hour, CASE WHEN s.seen > b.seen OR b.seen IS NULL THEN s.n ELSE b.n END AS n, CASE WHEN s.seen > b.seen OR b.seen IS NULL THEN s.seen
  ELSE b.seen END AS seen FROM b FULL JOIN s USING (user_id, hour)""")
def lambda_merge(spark, d):
    """A batch layer that lacks some events, merged with a speed layer: new windows are added, changed ones replaced."""
    from martflow.streaming.stream import lambda_merge

    e, ntz = tab(spark, d, "events"), lambda x: F.lit(x).cast("timestamp_ntz")
    by = lambda df: df.groupBy("user_id", F.window("ts", "60 minutes").alias("w")).agg(
        F.count("*").alias("n"), F.max("event_id").alias("seen")
    ).select("user_id", C("w.start").alias("hour"), "n", "seen")
    return lambda_merge(
        by(e.filter("event_id % 10 <> 0").filter(C("ts") < ntz("2024-01-20"))), by(e.filter(C("ts") >= ntz("2024-01-10"))),
        ["user_id", "hour"], "seen"
    )


@query("SELECT event_id, ts FROM events WHERE ts > TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 2 DAY")
def incremental_watermark(spark, d):
    return ingest.after_time(tab(spark, d, "events").select("event_id", "ts"), "ts", F.lit("2024-01-20").cast("timestamp_ntz"), 2)


@query("SELECT event_id, user_id FROM events WHERE event_id > 9000")
def incremental_key(spark, d):
    return ingest.after_key(tab(spark, d, "events").select("event_id", "user_id"), "event_id", 9000)


@query(
    "SELECT event_id, year, month, day FROM (SELECT event_id, CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month, "
    "CAST(day(ts) AS INTEGER) AS day FROM events) WHERE day = 7"
)
def incremental_partition(spark, d):
    return ingest.partition_of_day(ingest.dated(tab(spark, d, "events").select("event_id", "ts"), "ts"), "2024-01-07").drop("ts")


# ---- audit: a job log made from events


def _log(spark, d):
    e = tab(spark, d, "events")
    return e.select(
        C("event_id").cast("string").alias("run_id"), C("event_type").alias("job_id"), C("ts").alias("run_start_ts"), F.expr(
            "ts + make_dt_interval(0, 0, 0, event_id % 900)"
        ).alias("run_end_ts"), F.concat("event_type", F.lit(".csv")).alias("source_filename"), F.concat(
            F.lit("t"), (C("user_id") % 12).cast("string")
        ).alias("target_table"),
        (C("event_id") % 1000).alias("records_read"), F.lit(0).cast("long").alias("records_updated"), (C("event_id") % 1000).alias("records_inserted"), F.when(C("event_id") % 6 == 0, "FAILED").otherwise("SUCCESS").alias("status"), F.lit(None).cast("string").alias("error_message"),
    )


_LOG = "log AS (SELECT CAST(event_id AS VARCHAR) AS run_id, event_type AS job_id, ts AS run_start_ts, ts + to_seconds(CAST(event_id % 900 AS INTEGER)) AS run_end_ts, 't' || (user_id % 12) AS target_table, event_id % 1000 AS records_read, CASE WHEN event_id % 6 = 0 THEN 'FAILED' ELSE 'SUCCESS' END AS status FROM events)"


def _now():
    return F.lit("2024-01-31").cast("timestamp_ntz")


@query(f"WITH {_LOG} SELECT run_id, job_id, status, date_diff('second', run_start_ts, run_end_ts) AS duration_seconds FROM log")
def job_history(spark, d):
    return audit.history(_log(spark, d)).select("run_id", "job_id", "status", "duration_seconds")


@query(f"""WITH {_LOG} SELECT job_id, count(*) AS total_runs, count(*) FILTER (status = 'SUCCESS') AS successful_runs, count(*) FILTER (status =
  'FAILED') AS failed_runs, round(avg(date_diff('second', run_start_ts, run_end_ts)), 1) AS avg_duration_seconds, CAST(sum(records_read) AS BIGINT)
  AS total_records,
max(run_start_ts) AS last_run_ts, round(100.0::DOUBLE * count(*) FILTER (status = 'SUCCESS') / count(*), 1) AS success_rate FROM log WHERE
  run_start_ts >= TIMESTAMP '2024-01-31' - INTERVAL 14 DAY GROUP BY 1""")
def job_summary(spark, d):
    return audit.summary(_log(spark, d), _now(), 14)


@query(f"WITH {_LOG} SELECT DISTINCT target_table FROM log WHERE status = 'SUCCESS' AND run_start_ts >= TIMESTAMP '2024-01-31' - INTERVAL 2 DAY")
def active_tables(spark, d):
    return audit.active_tables(_log(spark, d), _now(), 2)


@query(f"WITH {_LOG} SELECT run_id FROM log WHERE run_start_ts >= TIMESTAMP '2024-01-31' - INTERVAL 10 DAY")
def purge_old_audit(spark, d):
    return audit.purge(_log(spark, d), "run_start_ts", _now(), 10)[0].select("run_id")


@query(
    "SELECT n_name AS table_name, CAST(n_nationkey AS INTEGER) AS unsorted, CAST(n_nationkey % 13 AS INTEGER) AS stats_off, CASE WHEN "
    "n_nationkey > 20 THEN 'NEEDS VACUUM' WHEN n_nationkey % 13 > 10 THEN 'NEEDS ANALYZE' ELSE 'OK' END AS health_status FROM nation"
)
def table_health(spark, d):
    return audit.table_health(
        tab(spark, d, "nation").select(
            C("n_name").alias("table_name"), C("n_nationkey").alias("unsorted"), (C("n_nationkey") % 13).cast("int").alias("stats_off")
        )
    )


def _messages(spark, d):
    outcome = F.when(C("event_id") % 5 == 0, "not_configured").when(C("event_id") % 5 == 1, "inactive").otherwise("triggered")
    return tab(spark, d, "events").select(
        F.concat(
            F.lit("file=x outcome="), outcome,
            F.when(C("event_id") % 5 == 0, F.concat(F.lit(" moved_to=data/new_files/"), "event_type")).otherwise("")
        ).alias("message")
    )


@query("SELECT CASE event_id % 5 WHEN 0 THEN 'not_configured' WHEN 1 THEN 'inactive' ELSE 'triggered' END AS outcome, count(*) AS n FROM events GROUP BY 1")
def log_outcome_counts(spark, d):
    return audit.outcome_counts(_messages(spark, d))


@query("SELECT 'data/new_files/' || event_type AS moved_to, count(*) AS n FROM events WHERE event_id % 5 = 0 GROUP BY 1")
def log_unconfigured(spark, d):
    return audit.unconfigured_files(_messages(spark, d))


@query(
    f"WITH {_LOG} SELECT CAST(run_start_ts AS DATE) AS day, count(*) AS n_success, round(avg(date_diff('second', run_start_ts, run_end_ts)), 2) AS avg_duration, max(date_diff('second', run_start_ts, run_end_ts)) AS max_duration, round(avg(records_read), 2) AS avg_records, max(records_read) AS max_records FROM log WHERE status = 'SUCCESS' GROUP BY 1"
)
def log_daily_stats(spark, d):
    return audit.daily_stats(_log(spark, d))


@query(f"WITH {_LOG} SELECT run_id, job_id, run_start_ts FROM log WHERE status = 'FAILED' ORDER BY run_start_ts DESC, run_id LIMIT 100")
def log_error_tail(spark, d):
    return audit.error_tail(_log(spark, d)).select("run_id", "job_id", "run_start_ts")


@query(
    f"WITH {_LOG} SELECT CAST(run_start_ts AS DATE) AS day, round(avg(records_read), 2) AS avg_records, max(records_read) AS max_records FROM log WHERE status = 'SUCCESS' GROUP BY 1"
)
def log_records_daily(spark, d):
    return audit.daily_stats(_log(spark, d)).select("day", "avg_records", "max_records")


@query(
    """SELECT 'data/in/' || CASE WHEN event_id % 2 = 0 THEN upper(event_type) ELSE event_type END || '.csv' AS path, CASE WHEN event_type IN
  ('click', 'view') THEN 'job_' || event_type END AS job_id, CASE event_type WHEN 'click' THEN 'triggered' WHEN 'view' THEN 'inactive' ELSE
  'not_configured' END AS outcome FROM events"""
)
def route_files(spark, d):
    files = tab(spark, d, "events").select(
        F.concat(F.lit("data/in/"), F.when(C("event_id") % 2 == 0, F.upper("event_type")).otherwise(C("event_type")), F.lit(".csv")).alias("path")
    )
    jobs = spark.createDataFrame(
        [("Click.csv", "job_click", True), ("view.csv ", "job_view", False)], "source_file_name string, job_id string, is_active boolean"
    )
    return audit.route_files(files, jobs)


@query("""SELECT path, CASE WHEN starts_with(path, 'in/click/') THEN 'clicks' WHEN regexp_matches(path, '_[0-9]*7\\.csv$') THEN 'sevens' WHEN
  starts_with(path, 'in/view/') THEN 'views' END AS job_id,
CASE WHEN starts_with(path, 'in/click/') OR starts_with(path, 'in/view/') OR regexp_matches(path, '_[0-9]*7\\.csv$') THEN 'triggered' ELSE
  'not_configured' END AS outcome FROM (SELECT 'in/' || event_type || '/file_' || event_id || '.csv' AS path FROM events)""")
def route_by_pattern(spark, d):
    files = tab(spark, d, "events").select(F.concat(F.lit("in/"), "event_type", F.lit("/file_"), C("event_id").cast("string"), F.lit(".csv")).alias("path"))
    rules = [(1, "prefix", "IN/click/", "clicks"), (2, "regex", r"_[0-9]*7\.csv$", "sevens"), (3, "prefix", "in/view/", "views")]
    return audit.route_by_pattern(files, spark.createDataFrame(rules, "priority int, kind string, pattern string, job_id string"))


@query("SELECT event_type || event_id AS key, CAST(event_id AS VARCHAR) AS etag FROM events WHERE event_id % 3 <> 0 OR event_id % 9 = 0")
def file_ledger(spark, d):
    files = tab(spark, d, "events").select(
        F.concat("event_type", C("event_id").cast("string")).alias("key"), C("event_id").cast("string").alias("etag"), "event_id"
    )
    ledger = files.filter("event_id % 3 = 0").select("key", "etag", F.when(C("event_id") % 9 == 0, "FAILED").otherwise("DONE").alias("status"))
    return audit.pending_files(files.select("key", "etag"), ledger)


# ---- privacy and scalar functions


@query("SELECT c_custkey, c_name, CASE WHEN c_custkey % 7 = 0 THEN TIMESTAMP '2024-02-01' END AS deleted_at FROM customer WHERE c_custkey % 14 <> 0")
def soft_delete(spark, d):
    """Customers marked as deleted; those of an earlier day are no longer live."""
    c = tab(spark, d, "customer").select("c_custkey", "c_name")
    before = privacy.live(privacy.soft_deleted(c, c.filter("c_custkey % 14 = 0"), ["c_custkey"], F.lit("2024-01-01").cast("timestamp"))).drop("deleted_at")
    return privacy.soft_deleted(
        before, c.filter("c_custkey % 7 = 0"), ["c_custkey"], F.lit("2024-02-01").cast("timestamp")
    ).withColumn("deleted_at", C("deleted_at").cast("timestamp_ntz"))


@query("SELECT o_orderkey, o_totalprice, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def two_catalog_join(spark, d):
    """A table of the session's catalog joined with one that another name resolves to."""
    from martflow.sources import catalog

    tab(spark, d, "orders").select("o_orderkey", "o_totalprice", C("o_custkey").alias("k")).createOrReplaceTempView("martflow_lake_orders")
    tab(spark, d, "customer").select("c_name", C("c_custkey").alias("k")).createOrReplaceGlobalTempView("martflow_customers")
    return catalog.federated_join(spark, "martflow_lake_orders", "global_temp.martflow_customers", ["k"]).select("o_orderkey", "o_totalprice", "c_name")


@query("SELECT c_custkey, repeat('*', length(c_name) - 4) || right(c_name, 4) AS masked FROM customer")
def pii_mask(spark, d):
    return tab(spark, d, "customer").select("c_custkey", privacy.mask_last(C("c_name")).alias("masked"))


@query("SELECT c_custkey, sha256('salt' || c_name) AS hashed FROM customer")
def pii_hash(spark, d):
    return tab(spark, d, "customer").select("c_custkey", privacy.hashed(C("c_name"), "salt").alias("hashed"))


@query("SELECT c_custkey, dense_rank() OVER (ORDER BY c_mktsegment) AS c_mktsegment FROM customer")
def pii_tokenize(spark, d):
    c = tab(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return privacy.tokenized(c, "c_mktsegment", privacy.vault(c, "c_mktsegment"))


@query("SELECT c_custkey, c_mktsegment FROM customer")
def pii_detokenize(spark, d):
    c = tab(spark, d, "customer").select("c_custkey", "c_mktsegment")
    v = privacy.vault(c, "c_mktsegment")
    return privacy.detokenized(privacy.tokenized(c, "c_mktsegment", v), "c_mktsegment", v)


@query("SELECT c_custkey, c_name FROM customer")
def aes_round_trip(spark, d):
    key = F.lit("0123456789abcdef")
    return tab(spark, d, "customer").select("c_custkey", privacy.decrypted(privacy.encrypted(C("c_name"), key), key).alias("c_name"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN c_name END AS c_name FROM customer")
def pii_erasure(spark, d):
    c = tab(spark, d, "customer").select("c_custkey", "c_name")
    return privacy.erased(c, c.filter("c_custkey % 5 = 0"), ["c_custkey"], ["c_name"])


@query(
    "SELECT event_id, date_diff('hour', ts, TIMESTAMP '2024-02-01 10:30:00') AS hours, date_diff('day', ts, TIMESTAMP '2024-02-01 10:30:00') "
    "AS days, date_diff('month', ts, TIMESTAMP '2024-02-01 10:30:00') AS months FROM events"
)
def datediff_boundaries(spark, d):
    now = F.lit("2024-02-01 10:30:00").cast("timestamp_ntz")
    return tab(spark, d, "events").select("event_id", *[datediff_boundary(u, C("ts"), now).alias(f"{u}s") for u in ("hour", "day", "month")])


@query(
    "SELECT l_returnflag, round(100.0::DOUBLE * count(*) FILTER (l_discount = 0) / nullif(count(*) FILTER (l_tax = 0.99), 0), 1) AS none, "
    "round(100.0::DOUBLE * count(*) FILTER (l_discount = 0) / count(*), 1) AS pct FROM lineitem GROUP BY 1"
)
def safe_ratio(spark, d):
    by = tab(spark, d, "lineitem").groupBy("l_returnflag").agg(
        F.count_if(C("l_discount") == 0).alias("a"), F.count_if(C("l_tax") == 0.99).alias("b"), F.count("*").alias("n")
    )
    return by.select("l_returnflag", ratio(C("a"), C("b"), 100, 1).alias("none"), ratio(C("a"), C("n"), 100, 1).alias("pct"))


@query("SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 10")
def top_keys(spark, d):
    return tab(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l_partkey").limit(10)


@query(f"""WITH {_DIM}, f AS (SELECT o_custkey AS customer_id, o_totalprice AS amount, CAST(date_trunc('month', o_orderdate) AS DATE) AS month FROM
  orders), k AS (SELECT f.*, s.customer_key FROM f LEFT JOIN scd2 s ON f.customer_id = s.customer_id AND is_current)
SELECT s.segment, month, CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS revenue FROM k JOIN scd2 s USING (customer_key) GROUP BY 1, 2""")
def flagship(spark, d):
    """Customers as a type 2 dimension in two loads, orders with their current surrogate keys, revenue by segment and month."""
    dim = _scd2(spark, d)
    orders = tab(spark, d, "orders").select(
        C("o_custkey").alias("customer_id"), C("o_totalprice").alias("amount"),
        F.date_trunc("month", "o_orderdate").cast("date").alias("month")
    )
    f = facts.lookup_current(orders, dim, {"customer_id": "customer_id"}, "customer_key").select("amount", "month", C("customer_key").alias("k"))
    return reports.totals_by(f, dim, C("k") == C("customer_key"), [C("segment"), C("month")], {"revenue": C("amount")})


# ---- scans and filters


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
def not_in_list(spark, d):
    return tab(spark, d, "customer").filter(~C("c_mktsegment").isin("BUILDING", "MACHINERY")).select("c_custkey", "c_mktsegment")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'F'")
def parquet_scan(spark, d):
    """Two columns and two filters, all of which reach the scan."""
    return ingest.read_parquet(spark, f"{d}/orders.parquet", ["o_orderkey", "o_totalprice"], "o_totalprice > 100000 AND o_orderstatus = 'F'")


@query(
    "SELECT l_orderkey, l_quantity, CAST(CAST(CAST(l_extendedprice AS VARCHAR) AS DECIMAL(38,18)) AS VARCHAR) AS price FROM lineitem"
)
def decimal_cast(spark, d):
    """Doubles that are no keys become decimals; the key stays as it is."""
    lines = tab(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice")
    return ingest.with_decimals(lines, ["l_quantity"]).select("l_orderkey", "l_quantity", C("l_extendedprice").cast("string").alias("price"))


@query(
    "SELECT n_name, TIMESTAMP '2024-02-01' AS _ingested_at, 'nightly' AS _job_name, 'erp' AS _source_system, 'run-1' AS _pipeline_run_id, "
    "DATE '2024-02-01' AS run_date, 'nation.csv' AS file_name FROM nation"
)
def lineage_columns(spark, d):
    """Where rows come from: lineage and audit columns."""
    marked = ingest.with_lineage(tab(spark, d, "nation").select("n_name"), F.lit("2024-02-01").cast("timestamp_ntz"), "nightly", "erp", "run-1")
    return ingest.with_audit(marked, F.lit("2024-02-01").cast("date"), F.lit("nation.csv"))


@query(f"WITH {_DIM}, {_FACTS} SELECT o_orderkey, segment, version FROM f LEFT JOIN scd2 s ON f.customer_id = s.customer_id "
       "AND f.day BETWEEN s.effective_date AND coalesce(s.end_date, DATE '9999-12-31')")
def date_range_join(spark, d):
    """Facts with the attributes of the version that was valid on their day."""
    dim = _scd2(spark, d).select(C("customer_id").alias("id"), "segment", "version", "effective_date", F.coalesce("end_date", F.lit("9999-12-31").cast("date")).alias("until"))
    hit = joins.date_range_join(_fact_days(spark, d), dim, C("customer_id") == C("id"), C("day"), C("effective_date"), C("until"), "left")
    return hit.select("o_orderkey", "segment", "version")


@query("SELECT o_orderkey, CAST(strftime(day, '%Y%m%d') AS INTEGER) AS date_key, full_date IS NOT NULL AS known FROM "
       "(SELECT o_orderkey, DATE '2024-01-01' + CAST(o_orderkey % 80 AS INTEGER) AS day FROM orders) f "
       "LEFT JOIN (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-02-29', INTERVAL 1 DAY)) AS DATE) AS full_date) ON day = full_date")
def fact_date_key(spark, d):
    """A business day's key, and whether the calendar knows it."""
    days = dimensions.dim_date(spark, "2024-01-01", "2024-02-29").select("date_key", "full_date")
    keyed = _fact_days(spark, d).select("o_orderkey", date_key(C("day")).alias("date_key"))
    return keyed.join(days, "date_key", "left").select("o_orderkey", "date_key", C("full_date").isNotNull().alias("known"))
