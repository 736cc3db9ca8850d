"""Structured Streaming: sources, watermarked windows, idempotent sinks, stream-static enrichment."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from martflow.operators.joins import broadcast_if_small
from martflow.operators.merge import upsert_if_newer
from martflow.operators.windows import window_sums
from martflow.sources.store import SnapshotTable


def kafka(spark: SparkSession, servers: str, topic: str, starting: str = "latest", per_trigger: int | None = None, fail_on_loss: bool = False) -> DataFrame:
    """A topic as a stream; needs Spark's Kafka package on the class path."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", starting).option("failOnDataLoss", fail_on_loss)
    return (reader.option("maxOffsetsPerTrigger", per_trigger) if per_trigger else reader).load()


def files(spark: SparkSession, path: str, schema, per_trigger: int | None = None, kind: str = "parquet") -> DataFrame:
    """A folder's files as a stream; per_trigger caps the files of one batch, which bounds the load, not the result."""
    reader = spark.readStream.format(kind).schema(schema)
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).load(path)


def windowed(events: DataFrame, at: str, by: list[str], value: str, width: str, slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Count and sum by event-time window; a window is final once the watermark has passed its end.

    Watermarks need the zoned type: other event times are read in the session's zone, which should be UTC.
    """
    kind = events.schema[at].dataType
    out = window_sums(events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay), at, by, value, width, slide)
    return out.withColumns({c: F.col(c).cast(kind) for c in ("window_start", "window_end")})


def filtered(events: DataFrame, value: str, least: float) -> DataFrame:
    return events.filter(F.col(value) > least)


def enriched(events: DataFrame, static: DataFrame, on: list[str]) -> DataFrame:
    """Events with the columns of a static table, broadcast where it is small."""
    return events.join(broadcast_if_small(static), on, "left")


def start(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", every: str | None = None) -> StreamingQuery:
    """Run a stream into a batch function: once over what there is, or every so often. Restarts go on from the checkpoint."""
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def merge_sink(table: SnapshotTable, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """A sink that adds each key once: a batch that comes again changes nothing. Nothing that is there is written again."""

    def sink(batch: DataFrame, _: int) -> None:
        table.insert_only(batch, keys)

    return sink


def file_sink(df: DataFrame, path: str, checkpoint: str, kind: str = "parquet", by: list[str] = ()) -> StreamingQuery:
    writer = df.writeStream.format(kind).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True)
    return (writer.partitionBy(*by) if by else writer).start(path)


def lambda_view(batch: DataFrame, speed: DataFrame, keys: list[str]) -> DataFrame:
    """The batch layer's rows, and the speed layer's for keys that the batch layer does not have yet."""
    return batch.unionByName(speed.join(batch.select(*keys), keys, "left_anti"))


def lambda_merge(batch: DataFrame, speed: DataFrame, keys: list[str], updated: str) -> DataFrame:
    """Both layers' windows: the speed layer adds those that the batch layer lacks and replaces those that it has newer."""
    return upsert_if_newer(batch, speed, keys, updated)


def use_rocksdb(spark: SparkSession) -> None:
    """State in RocksDB on local disk instead of the executors' heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
