"""Keyed tables that streams keep: only the parts that a batch touches are rewritten."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.sources.versions import Pointer

_PART = "__part"


class Store:
    """Rows with unique keys in parts (a function of the row), published by a pointer from part to folder.

    A batch rewrites the parts that it touches and points to them; the others
    stay as they are.  A batch that was published already changes nothing, so
    a replay after a restart is harmless, and folders that nothing points to
    are deleted.
    """

    def __init__(self, spark: SparkSession, path: str, schema, keys: list[str], part: Column) -> None:
        self.spark, self.path, self.schema, self.keys, self.part = spark, path.rstrip("/"), schema, keys, part
        self.pointer = Pointer(spark, path)

    def _state(self) -> dict:
        return self.pointer.read() or {"batch": -1, "parts": {}}

    def read(self, parts: list[str] | None = None) -> DataFrame:
        held = self._state()["parts"]
        paths = sorted({held[p] for p in (held if parts is None else parts) if p in held})
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{p}" for p in paths])

    def _publish(self, rows: DataFrame, touched: list[str], batch: int) -> None:
        """Write the touched parts anew and point to them; parts without rows are no more."""
        state, name = self._state(), f"data/{batch}-{uuid.uuid4().hex}"
        rows.withColumn(_PART, self.part.cast("string")).repartition(_PART).write.partitionBy(_PART).parquet(f"{self.path}/{name}")
        made = {f.split("=", 1)[1] for f in self.pointer.folders(name) if f.startswith(_PART + "=")}
        parts = {p: f for p, f in state["parts"].items() if p not in touched} | {p: f"{name}/{_PART}={p}" for p in made}
        n = (self.pointer.last() or 0) + 1
        if not self.pointer.write(n, {"batch": batch, "parts": parts, "before": state["parts"]}):
            raise RuntimeError("another writer keeps this table")
        used = {f.split("/")[1] for f in (*parts.values(), *state["parts"].values())}
        for old in self.pointer.folders("data"):
            if old not in used:
                self.pointer.delete(f"data/{old}")

    def touched(self, rows: DataFrame) -> list[str]:
        """The parts of some rows: as many at most as the table has or gets."""
        return [r[0] for r in rows.select(self.part.cast("string")).distinct().collect()]

    def upsert(self, rows: DataFrame, batch: int) -> list[str]:
        """Rows replace those with their keys; the parts that were touched, none if the batch was published before."""
        if self._state()["batch"] >= batch:
            return []
        touched = self.touched(rows)
        if touched:
            old = self.read(touched)
            self._publish(old.join(rows.select(*self.keys), self.keys, "left_anti").unionByName(rows.select(*old.columns)), touched, batch)
        return touched

    def replace(self, rows: DataFrame, touched: list[str], batch: int) -> None:
        """Whole parts anew."""
        if touched and self._state()["batch"] < batch:
            self._publish(rows, touched, batch)


def newer(rows: DataFrame, stored: DataFrame, entity: str, ts: str) -> DataFrame:
    """The rows beyond their entity's stored high-watermark (entity, high); all rows of an unknown entity."""
    high = stored.select(F.col(entity).alias("__e"), F.col("high").alias("__high"))
    return rows.join(high, F.col(entity) == F.col("__e"), "left").where(F.col("__high").isNull() | (F.col(ts) > F.col("__high"))).drop("__e", "__high")


def pull(stream: DataFrame, path: str, *, entity: str, ts: str, key: str, buckets: int = 16) -> DataFrame:
    """Take new files of ``stream`` and append what is beyond each entity's high-watermark; the table of all rows taken.

    Watermarks are a table of their own, a row for each entity, of which a
    batch rewrites the buckets of its entities.  A batch's rows go to parts of
    their own before its watermarks move, under the batch's number, so a
    replay writes the same rows again and none twice.
    """
    spark = stream.sparkSession
    marks = Store(spark, f"{path}/marks", f"{entity} {stream.schema[entity].dataType.simpleString()}, high {stream.schema[ts].dataType.simpleString()}", [entity], F.pmod(F.xxhash64(entity), F.lit(buckets)))

    def take(batch: DataFrame, n: int) -> None:
        if marks._state()["batch"] >= n:
            return
        new = newer(batch, marks.read(), entity, ts).dropDuplicates([key])
        new.write.mode("overwrite").parquet(f"{path}/taken/batch={n}")
        kept = spark.read.schema(stream.schema).parquet(f"{path}/taken/batch={n}")
        marks.upsert(kept.groupBy(entity).agg(F.max(ts).alias("high")), n)

    query = stream.writeStream.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(take).start()
    query.awaitTermination()
    found = Pointer(spark, path).folders("taken")
    return spark.read.schema(stream.schema).parquet(*[f"{path}/taken/{f}" for f in sorted(found)]) if found else spark.createDataFrame([], stream.schema)


def daily(stream: DataFrame, path: str, *, key: str = "event_id", ts: str = "ts") -> DataFrame:
    """Counts and sums of each event type and day, whatever the order in which files come.

    A batch's events are upserted into their days; the aggregates of these
    days are made anew from all their events.  So a late file, however late,
    or one that repeats events gives what a batch job over all files gives.
    """
    spark = stream.sparkSession
    events = Store(spark, f"{path}/events", stream.schema, [key], F.to_date(ts))
    shape = "start date, event_type string, n long, total double"
    out = Store(spark, f"{path}/daily", shape, ["start", "event_type"], F.col("start"))

    def merge(batch: DataFrame, n: int) -> None:
        one = batch.dropDuplicates([key])
        touched = events.upsert(one, n) or events.touched(one)
        own = events.read(touched).groupBy(F.to_date(ts).alias("start"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value") + 1e-9, 2).alias("total"))
        out.replace(own, touched, n)

    query = stream.writeStream.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(merge).start()
    query.awaitTermination()
    return out.read()
