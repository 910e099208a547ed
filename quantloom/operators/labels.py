"""Forward-return labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.columns import rounded
from quantloom.functions.windows import compounded, first_rank, pct_rank, series


def equal_weight_index(prices: DataFrame) -> DataFrame:
    """date, close: equal-weight index on the date grid, from 100.

    A symbol's change counts only if it traded on the grid's date before.  The
    running product orders dates, one row each; symbols never meet there.
    """
    days = prices.select("date").distinct().select("date", F.row_number().over(Window.orderBy("date")).alias("day"))
    own = prices.join(days, "date")
    previous, day = F.lag("close").over(series()), F.lag("day").over(series())
    step = own.withColumn("r", F.when(day == F.col("day") - 1, F.col("close") / previous - 1))
    mean = step.groupBy("date").agg(F.coalesce(rounded(F.avg("r"), 10), F.lit(0.0)).alias("r"))
    return mean.select("date", rounded(100 * compounded(F.col("r"), Window.orderBy("date"))).alias("close"))


def forward_drawdown(h: int):
    """Least close over its running maximum, minus 1, over rows t..t+h; NULL if the path is cut."""
    path = F.collect_list("close").over(series().rowsBetween(0, h))
    start = F.struct(F.lit(0.0).alias("top"), F.lit(0.0).alias("worst"))

    def step(a, x):
        top = F.greatest(a["top"], x)
        return F.struct(top.alias("top"), F.least(a["worst"], x / top - 1).alias("worst"))

    return F.when(F.size(path) == h + 1, F.aggregate(path, start, step)["worst"])


def forward_labels(prices: DataFrame, index: DataFrame, h: int, share: float = 0.2, drawdown: bool = True) -> DataFrame:
    """future, benchmark and excess return h rows ahead, their rank and the top and bottom fifth of each date.

    A missing excess return gives false flags, not NULL ones.
    """
    bench = index.select("date", (F.lead("close", h).over(Window.orderBy("date")) / F.col("close") - 1).alias("b"))
    path = rounded(forward_drawdown(h)) if drawdown else F.lit(None).cast("double")
    own = prices.select("date", "symbol", rounded(F.lead("close", h).over(series()) / F.col("close") - 1).alias("future_return"), path.alias("max_drawdown_forward"))
    own = own.join(bench, "date", "left").withColumn("benchmark_return", rounded(F.col("b"))).withColumn("excess_return", rounded(F.col("future_return") - F.col("benchmark_return"))).drop("b")
    n = F.count("excess_return").over(Window.partitionBy("date"))
    most = F.greatest(F.lit(1), F.ceil(n * F.lit(share)))
    has = F.col("excess_return").isNotNull()
    top, low = first_rank(F.col("excess_return"), "date"), first_rank(F.col("excess_return"), "date", ascending=True)
    return own.select("*", rounded(pct_rank(F.col("excess_return"), "date")).alias("rank_quantile"), (has & (top <= most)).alias("is_top20pct"), (has & (low <= most)).alias("is_bottom20pct"))
