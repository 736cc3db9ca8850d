"""High-water marks of incremental loads: a mark moves only once its load has succeeded."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martflow.sources.ingest import after_key, after_time
from martflow.sources.store import SnapshotTable

_READ = {
    "int": int, "float": float, "str": str, "Decimal": Decimal, "date": dt.date.fromisoformat, "datetime": dt.datetime.fromisoformat,
    "NoneType": lambda _: None
}


class Marks:
    """Marks by load name, in a snapshot table: a row for each change, the last one counts."""

    SCHEMA = "name string, kind string, value string, paused boolean, seq long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.table = spark, SnapshotTable(spark, path)

    def _last(self, name: str):
        if not self.table.exists():
            return None
        return self.table.read().filter(F.col("name") == name).orderBy(F.desc("seq")).first()

    def _put(self, name: str, value, paused: bool) -> None:
        last = self._last(name)
        text = value.isoformat() if isinstance(value, (dt.date, dt.datetime)) else str(value)
        self.table.append(self.spark.createDataFrame([(name, type(value).__name__, text, paused, (last.seq if last else 0) + 1)], self.SCHEMA))

    def get(self, name: str):
        last = self._last(name)
        return _READ[last.kind](last.value) if last else None

    def paused(self, name: str) -> bool:
        last = self._last(name)
        return bool(last and last.paused)

    def advance(self, name: str, value) -> None:
        self._put(name, value, False)

    def reset(self, name: str, value=None) -> None:
        """Start again from the beginning, or from value."""
        self._put(name, value, self.paused(name))

    def pause(self, name: str) -> None:
        """Loads go on from the same mark each time until resume."""
        self._put(name, self.get(name), True)

    def resume(self, name: str) -> None:
        self._put(name, self.get(name), False)


def incremental(marks: Marks, name: str, df: DataFrame, column: str, load: Callable[[DataFrame], object], lookback_days: int = 0) -> int:
    """load() what lies above the mark of `name`, then advance it to the largest value loaded; the number of rows loaded.

    A failing load leaves the mark. A paused mark stays where it is, whatever is loaded. With look-back days (column a
    time) rows shortly before the mark come again, so load must be idempotent.
    """
    mark = marks.get(name)
    new = after_time(df, column, None if mark is None else F.lit(mark), lookback_days) if lookback_days else after_key(df, column, mark)
    one = new.agg(F.count("*").alias("n"), F.max(column).alias("m")).first()
    if not one.n:
        return 0
    load(new.filter(F.col(column) <= F.lit(one.m)))  # rows that arrive meanwhile wait for the next run
    if not marks.paused(name):
        marks.advance(name, one.m if mark is None else max(one.m, mark))
    return one.n
