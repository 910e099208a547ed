"""The universe of symbols: who is eligible, who is taken, and a publication that is whole or does not happen."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.sources.versions import Published


def judged(symbols: DataFrame, metrics: DataFrame, prices: DataFrame, excluded: DataFrame, *, least_rows: int) -> DataFrame:
    """Every symbol with market_cap, rows and why it is not eligible: excluded, without market value, short history, or NULL."""
    latest = metrics.groupBy("symbol").agg(F.max_by("market_cap", "date").alias("market_cap"))
    history = prices.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"))
    listed = excluded.select("symbol").distinct().withColumn("__out", F.lit(True))
    own = symbols.join(latest, "symbol", "left").join(history, "symbol", "left").join(listed, "symbol", "left")
    why = F.when(F.col("__out"), "excluded").when(F.col("market_cap").isNull(), "no_market_value").when(F.coalesce("rows", F.lit(0)) < least_rows, "short_history")
    return own.withColumn("why", why).drop("__out")


def choose(symbols: DataFrame, metrics: DataFrame, prices: DataFrame, excluded: DataFrame, *, per_market: int, least_rows: int = 100) -> DataFrame:
    """symbol, market, rank of the largest eligible symbols of each market."""
    own = judged(symbols, metrics, prices, excluded, least_rows=least_rows).where("why is null")
    place = F.row_number().over(Window.partitionBy("market").orderBy(F.desc("market_cap"), "symbol"))
    return own.withColumn("rank", place).where(F.col("rank") <= per_market).select("symbol", "market", "rank")


def commit(spark: SparkSession, path: str, universe: DataFrame, counts: dict[str, int]) -> DataFrame:
    """Publish a universe that has exactly so many symbols of each market, no other market, no symbol twice and ranks without a gap.

    Otherwise sources.versions.Refused is raised and readers keep the universe before.
    """
    checks = {f"{m}: {n} symbols": F.count_if(F.col("market") == m) == n for m, n in counts.items()}
    checks["no other market"] = F.count_if(~F.coalesce(F.col("market").isin(*counts), F.lit(False))) == 0
    checks["no symbol twice"] = F.count_distinct("symbol") == F.count(F.lit(1))
    checks["ranks without a gap"] = (F.count_distinct("market", "rank") == F.count(F.lit(1))) & (F.min("rank") == 1) & (F.max("rank") == max(counts.values()))
    return Published(spark, path).publish(universe, checks)
