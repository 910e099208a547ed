"""Canonical tables over the driver's data, and the registered queries."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decisions, explain, features, market, outlook, primitives, records, rules, serving, signals  # noqa: F401
from .panel import Panel
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "Panel", "entry_query"]


def entry_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 symbols with the best momentum score on the latest date."""
    from quantloom.operators.features import price_features

    scored = price_features(Panel(spark, sf_dir).prices).select("date", "symbol", "close", "momentum_score", "liquidity_score", "risk_score")
    latest = scored.agg(F.max("date").alias("date"))
    return scored.join(F.broadcast(latest), "date").orderBy(F.desc_nulls_last("momentum_score"), "symbol").limit(20)
