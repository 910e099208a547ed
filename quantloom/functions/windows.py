"""Window expressions: ranks with average ties, rolling frames with minimum periods, runs and drawdowns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from quantloom.sources.staging import staged


def by(*keys: str) -> WindowSpec:
    return Window.partitionBy(*keys)


def series(key: str = "symbol", order: str = "date") -> WindowSpec:
    return Window.partitionBy(key).orderBy(order)


def pct_rank(x: Column, *keys: str, ascending: bool = True) -> Column:
    """Average-tie rank over the number of non-NULL values; NULL for NULL."""
    spec = Window.partitionBy(*keys).orderBy(x.asc_nulls_last() if ascending else x.desc_nulls_last())
    ties = F.count(F.lit(1)).over(spec.rangeBetween(Window.currentRow, Window.currentRow))  # one sort for rank and ties
    return F.when(x.isNotNull(), (F.rank().over(spec) + (ties - 1) / 2.0) / F.count(x).over(Window.partitionBy(*keys)))


def with_pooled_ranks(df: DataFrame, **ranks: str) -> DataFrame:
    """``df`` with each new column as the average-tie rank of a column over all rows, by the number of its values.

    No task orders all rows: values are counted first, ordered within range
    partitions, and each partition starts after the counts of those before it.
    """
    for name, column in ranks.items():
        values = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
        placed = staged(values.repartitionByRange("__v").select("__v", "__n", F.spark_partition_id().alias("__part")), "ranked-values")
        parts = placed.groupBy("__part").agg(F.sum("__n").alias("__size"), F.min("__v").alias("__low"))
        order = Window.orderBy("__low")  # a row for each partition
        starts = parts.select("__part", (F.sum("__size").over(order) - F.col("__size")).alias("__start"), F.sum("__size").over(Window.partitionBy()).alias("__all"))
        upto = F.sum("__n").over(Window.partitionBy("__part").orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        place = placed.withColumn("__upto", upto).join(starts, "__part").select("__v", ((F.col("__start") + F.col("__upto") - (F.col("__n") - 1) / 2.0) / F.col("__all")).alias(name))
        df = df.join(place, F.col(column) == F.col("__v"), "left").drop("__v")
    return df


def rolling(agg, x: Column, n: int, least: int | None = None, key: str = "symbol", order: str = "date") -> Column:
    """An aggregate over the last n rows; NULL with fewer than ``least`` (n) values."""
    frame = series(key, order).rowsBetween(-(n - 1), 0)
    return F.when(F.count(x).over(frame) >= (n if least is None else least), agg(x).over(frame))


def change(x: Column, n: int, key: str = "symbol", order: str = "date") -> Column:
    """x over its value n rows before, minus 1."""
    return F.try_divide(x, F.lag(x, n).over(series(key, order))) - 1


def compounded(r: Column, spec: WindowSpec) -> Column:
    """Running product of 1 + r."""
    return F.exp(F.sum(F.log1p(r)).over(spec.rowsBetween(Window.unboundedPreceding, 0)))


def drawdown(level: Column, spec: WindowSpec) -> Column:
    """Level over its running maximum, minus 1."""
    return level / F.max(level).over(spec.rowsBetween(Window.unboundedPreceding, 0)) - 1


def run_length(flag: Column, key: str = "symbol", order: str = "date") -> Column:
    """Rows since the flag last was false (0 where it is)."""
    spec = series(key, order).rowsBetween(Window.unboundedPreceding, 0)
    place = F.row_number().over(series(key, order))
    last_false = F.max(F.when(~flag, place)).over(spec)
    return F.when(flag, place - F.coalesce(last_false, F.lit(0))).otherwise(0)


def first_rank(x: Column, *keys: str, tie: str = "symbol", ascending: bool = False) -> Column:
    """Ranks without ties, NULLs last, the tie column in ascending order."""
    return F.row_number().over(Window.partitionBy(*keys).orderBy(x.asc_nulls_last() if ascending else x.desc_nulls_last(), tie))
