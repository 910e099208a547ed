"""Event-time aggregations as streams, written so that replays give the same table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType


def read_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """New files of a parquet table as a stream."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}.parquet*")


#: How late rows may come; state of older windows is dropped.
LATE = "2 days"


_EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def _timed(events: DataFrame, late: str) -> tuple[DataFrame, Column]:
    """``events`` with a watermark, and the start of their windows ``w`` in the type of ``ts``.

    Watermarks need instants: wall-clock times are taken as instants of UTC and given back as wall-clock times.
    """
    start = F.col("w.start")
    if isinstance(events.schema["ts"].dataType, TimestampNTZType):
        events = events.withColumn("ts", F.timestamp_micros(F.expr(f"timestampdiff(MICROSECOND, {_EPOCH}, ts)")))
        start = F.expr(f"timestampadd(MICROSECOND, unix_micros(w.start), {_EPOCH})")
    return events.withWatermark("ts", late), start.alias("start")


def tumbling(events: DataFrame, width: str = "1 day", late: str = LATE) -> DataFrame:
    """Counts and sums of each event type and window."""
    own, start = _timed(events, late)
    counted = own.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value") + 1e-9, 2).alias("total"))
    return counted.select(start, "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "24 hours", step: str = "6 hours", late: str = LATE) -> DataFrame:
    own, start = _timed(events, late)
    return own.groupBy(F.window("ts", width, step).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(start, "n")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    return events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def drain(result: DataFrame, path: str, keys: list[str], buckets: int = 16) -> DataFrame:
    """Run a streaming aggregation over all files there are, and give the table of its rows.

    Each trigger's changed rows replace those with their keys; a batch writes
    the buckets of its keys anew and publishes them together, so readers never
    see a table in parts, a replay changes nothing, and old files go.  Rows
    later than the watermark are lost to an aggregation; ``store.daily`` takes
    them however late.
    """
    from quantloom.streaming.store import Store

    table = Store(result.sparkSession, f"{path}/out", result.schema, keys, F.pmod(F.xxhash64(*keys), F.lit(buckets)))
    query = result.writeStream.outputMode("update").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(lambda batch, n: table.upsert(batch, n)).start()
    query.awaitTermination()
    return table.read()


def deduplicated(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark."""
    return _timed(events, late)[0].dropDuplicatesWithinWatermark([key])
