"""Table operators: scans, alignment, upserts, watermarks and normalisers of semi-structured sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def register(spark: SparkSession, folder: str, names: list[str]) -> None:
    """Parquet tables of a folder as temporary views."""
    for name in names:
        spark.read.parquet(f"{folder}/{name}.parquet").createOrReplaceTempView(name)


def read_or_empty(spark: SparkSession, name: str, schema: StructType) -> DataFrame:
    """A table or view, or an empty frame of the schema if there is none."""
    return spark.table(name) if spark.catalog.tableExists(name) else spark.createDataFrame([], schema)


def align(df: DataFrame, schema: StructType) -> DataFrame:
    """The schema's columns in its order: missing ones NULL, others dropped, values cast where they can be."""
    return df.select(*[(F.col(f.name).try_cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields])


def upsert(old: DataFrame, batch: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Old rows whose keys the batch lacks, and the batch's last row of each key by ``order``.  NULL keys never match."""
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last(order)))
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    new = align(batch.withColumn("__r", last).where((F.col("__r") == 1) | ~known).drop("__r"), old.schema)
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def watermark_filter(incoming: DataFrame, stored: DataFrame, key: str, time: str) -> DataFrame:
    """Incoming rows that are newer than their key's newest stored row."""
    high = stored.groupBy(key).agg(F.max(time).alias("__high"))
    return incoming.join(high, key, "left").where(F.col("__high").isNull() | (F.col(time) > F.col("__high"))).drop("__high")


def pivot_flows(long: DataFrame, kinds: list[str]) -> DataFrame:
    """date, symbol and a net value column for each investor kind."""
    return long.groupBy("date", "symbol").pivot("investor", kinds).agg(F.sum("net"))


def with_deltas(balances: DataFrame, value: str, steps: tuple[int, ...] = (1, 5, 20)) -> DataFrame:
    """Differences to earlier rows of the market, where the source gave none."""
    spec = Window.partitionBy("market").orderBy("date")
    out = balances
    for n in steps:
        given = F.col(f"delta_{n}") if f"delta_{n}" in balances.columns else F.lit(None).cast("double")
        out = out.withColumn(f"delta_{n}", F.coalesce(given, F.round(F.col(value) - F.lag(value, n).over(spec) + 1e-9, 2)))
    return out


def failure_rows(df: DataFrame, step: str, source: str, bad) -> DataFrame:
    """Dead-letter rows for what a step could not use."""
    return df.where(bad).select(F.lit(step).alias("step"), F.lit(source).alias("source"), F.to_json(F.struct("*")).alias("row"))


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    df.write.mode("overwrite").format(fmt).save(path)


def read_delimited(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """CSV files with a header row; values that do not fit the schema are NULL."""
    return spark.read.option("header", True).option("mode", "PERMISSIVE").schema(schema).csv(path)


def html_cells(pages: DataFrame, html: str, tag: str) -> DataFrame:
    """Every element of a tag as a row: its place in the page and its text without inner markup."""
    found = F.regexp_extract_all(F.col(html), F.lit(f"(?s)<{tag}[^>]*>(.*?)</{tag}>"), 1)
    return pages.select("*", F.posexplode(found).alias("place", "cell")).drop(html).withColumn("cell", F.trim(F.regexp_replace("cell", "<[^>]+>", "")))
