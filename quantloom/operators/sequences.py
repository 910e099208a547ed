"""Sequences for models: split by dates, normalised by what the training dates show."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.windows import series


def split_ends(frame: DataFrame, train: float = 0.70, valid: float = 0.15) -> DataFrame:
    """One row: train_end and valid_end, the last dates of the first two parts of the frame's dates."""
    days = frame.select("date").where("date is not null").distinct()
    numbered = days.select("date", F.row_number().over(Window.orderBy("date")).alias("i"), F.count(F.lit(1)).over(Window.partitionBy()).alias("n"))  # a row for each date
    end = lambda share: F.greatest(F.lit(1), F.least(F.col("n"), F.floor(F.col("n") * share + 1e-9)))
    last = lambda share: F.max(F.when(F.col("i") == end(share), F.col("date")))
    return numbered.agg(last(train).alias("train_end"), last(train + valid).alias("valid_end"))


def normaliser(frame: DataFrame, columns: list[str], ends: DataFrame) -> DataFrame:
    """One row: the median and the deviation (1 where it is 0) of each column over the training dates alone."""
    known = frame.join(F.broadcast(ends)).where("date <= train_end")
    spread = lambda c: F.stddev_pop(c)
    return known.agg(*[F.coalesce(F.median(c), F.lit(0.0)).alias(f"__m_{c}") for c in columns], *[F.coalesce(F.nullif(spread(c), F.lit(0.0)), F.lit(1.0)).alias(f"__s_{c}") for c in columns])


def sequences(frame: DataFrame, columns: list[str], lookback: int, *, label: str, train: float = 0.70, valid: float = 0.15) -> DataFrame:
    """date, symbol, label, split, sequence_start and the last ``lookback`` labelled rows, normalised, oldest first; only full ones.

    A missing value counts as the training median.  The split is that of the
    sequence's last date; a sequence may reach back into the part before.
    """
    own = frame.where(F.col(label).isNotNull() & F.col("date").isNotNull()).withColumns({c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c).cast("double")) for c in columns})
    ends = split_ends(own, train, valid)
    fitted = own.join(F.broadcast(ends)).join(F.broadcast(normaliser(own, columns, ends)))  # one row each
    scaled = F.array(*[(F.coalesce(F.col(c), F.col(f"__m_{c}")) - F.col(f"__m_{c}")) / F.col(f"__s_{c}") for c in columns])
    window = series().rowsBetween(-(lookback - 1), 0)
    split = F.when(F.col("date") <= F.col("train_end"), "train").when(F.col("date") <= F.col("valid_end"), "valid").otherwise("test")
    out = fitted.select("date", "symbol", F.col(label).alias("label"), split.alias("split"), F.min("date").over(window).alias("sequence_start"), F.collect_list(scaled).over(window).alias("sequence"))
    return out.where(F.size("sequence") == lookback)
