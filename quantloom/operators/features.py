"""Point-in-time features of a daily panel: price, market, flow, and the composed matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.functions.columns import clip, rounded, row_mean
from quantloom.functions.windows import change, pct_rank, rolling, run_length, series

RETURNS, GAPS, VOLS = (21, 63, 126, 252), (20, 60, 120, 250), (20, 60)
RET, GAP, VOL = ([f"ret_{n}d" for n in RETURNS], [f"ma_gap_{n}d" for n in GAPS], [f"volatility_{n}d" for n in VOLS])
FLOW_SPANS = (1, 5, 20, 60)


def prepare_prices(raw: DataFrame) -> DataFrame:
    """One row for each (date, symbol) with a positive price; adj_close else close.

    Of rows that repeat a date and symbol the largest close counts.
    """
    price = F.coalesce(*[F.col(c).try_cast("double") for c in ("adj_close", "close") if c in raw.columns])
    own = raw.withColumn("date", F.col("date").try_cast("date")).withColumn("close", price).where("date is not null and symbol is not null and close > 0 and not isnan(close)")
    return own.groupBy("date", "symbol").agg(*[F.max_by(c, "close").alias(c) for c in own.columns if c not in ("date", "symbol")])


def time_features(prices: DataFrame) -> DataFrame:
    """Per-symbol features: returns, average gaps, volatilities, liquidity, 52-week high, RSI."""
    c = F.col("close")
    one = prices.withColumn("ret1", change(c, 1)).withColumn("step", c - F.lag(c).over(series()))
    one = one.withColumn("gain", F.when(F.col("step") > 0, F.col("step")).otherwise(F.when(F.col("step").isNotNull(), 0.0))).withColumn("loss", F.when(F.col("step") < 0, -F.col("step")).otherwise(F.when(F.col("step").isNotNull(), 0.0)))
    gain, loss = rolling(F.avg, F.col("gain"), 14), rolling(F.avg, F.col("loss"), 14)
    rs = F.try_divide(gain, F.when(loss > 1e-12, loss))
    return one.select(
        "date", "symbol", "close",
        *[rounded(change(c, n)).alias(f"ret_{n}d") for n in RETURNS],
        *[rounded(F.try_divide(c, rolling(F.avg, c, n)) - 1).alias(f"ma_gap_{n}d") for n in GAPS],
        *[rounded(rolling(F.stddev_samp, F.col("ret1"), n) * (252.0**0.5)).alias(f"volatility_{n}d") for n in VOLS],
        rounded(F.try_divide(F.col("volume"), rolling(F.avg, F.col("volume"), 20))).alias("volume_ratio_20d"),
        rounded(rolling(F.avg, F.col("trading_value"), 20), 2).alias("trading_value_ma20"),
        rounded(F.try_divide(c, rolling(F.max, c, 252, 60)) - 1).alias("close_to_52w_high"),
        rounded(F.coalesce(100 - 100 / (1 + rs), F.lit(50.0))).alias("rsi_14"),
    )


def cross_features(features: DataFrame) -> DataFrame:
    """Cross-section scores of a date: momentum, volatility, liquidity, base risk."""
    rank = lambda col, up=True: rounded(pct_rank(F.col(col), "date", ascending=up))
    ranked = features.select("*", *[rank(x).alias(f"__{x}") for x in RET], rank("volatility_60d", False).alias("volatility_score"), rank("volatility_60d").alias("__risk"), rank("trading_value_ma20").alias("liquidity_score"))
    heat = clip((F.col("rsi_14") - 70) / 30)
    out = ranked.withColumn("momentum_score", rounded(row_mean(*[F.col(f"__{x}") for x in RET])))
    out = out.withColumn("risk_score", rounded(row_mean(F.col("__risk"), 1 - F.col("liquidity_score"), heat)))
    return out.drop(*[f"__{x}" for x in RET], "__risk")


def price_features(prices: DataFrame) -> DataFrame:
    return cross_features(time_features(prices))


def with_horizons(features: DataFrame, horizons: dict[str, int]) -> DataFrame:
    """Every row once for each horizon: an explode, after all other work."""
    pairs = F.array(*[F.struct(F.lit(n).alias("horizon"), F.lit(d).alias("horizon_days")) for n, d in horizons.items()])
    return features.select("*", F.explode(pairs).alias("__h")).select(*features.columns, "__h.horizon", "__h.horizon_days")


def market_features(metrics: DataFrame) -> DataFrame:
    """Size, value and quality scores of a date; missing parts count as 0.5."""
    rank = lambda x, up=True: pct_rank(x, "date", ascending=up)
    positive = lambda c: F.when(F.col(c) > 0, F.col(c))
    part = metrics.select(
        "date", "symbol", rank(F.col("market_cap")).alias("cap"), rank(positive("per"), False).alias("per"), rank(positive("pbr"), False).alias("pbr"),
        rank(F.col("dividend_yield")).alias("div"), rank(F.col("eps")).alias("eps"), rank(F.col("bps")).alias("bps"),
    )
    fill = lambda x: rounded(clip(F.coalesce(x, F.lit(0.5))))
    return part.select("date", "symbol", fill(F.col("cap")).alias("size_score"), fill(row_mean(F.col("per"), F.col("pbr"), F.col("div"))).alias("value_score"), fill(row_mean(F.col("eps"), F.col("bps"))).alias("quality_score"))


def flow_features(flows: DataFrame, prices: DataFrame, metrics: DataFrame) -> DataFrame:
    """Rolling net flows of three investor kinds, buying streaks and a supply-demand score."""
    kinds = ("foreign", "institution", "retail")
    own = flows.join(metrics.select("date", "symbol", "market_cap"), ["date", "symbol"], "left").join(traded_value(prices), ["date", "symbol"], "left")
    net = lambda k: F.col(f"{k}_net_value")
    sums = own.select("*", *[rounded(rolling(F.sum, net(k), n, 1), 2).alias(f"{k}_net_{n}d") for k in kinds for n in FLOW_SPANS], *[run_length(F.coalesce(net(k) > 0, F.lit(False))).cast("long").alias(f"{k}_buy_days") for k in ("foreign", "institution")])
    ratio = sums.withColumn("foreign_to_cap", rounded(F.try_divide(F.col("foreign_net_20d"), F.col("market_cap")))).withColumn("institution_to_value", rounded(F.try_divide(F.col("institution_net_20d"), F.col("value_20d"))))
    ratio = ratio.withColumn("retail_overheat", rounded(F.try_divide(F.greatest(F.col("retail_net_20d"), F.lit(0.0)), F.col("value_20d"))))
    rank = lambda c: F.coalesce(pct_rank(F.col(c), "date"), F.lit(0.5))
    score = 0.45 * rank("foreign_to_cap") + 0.45 * rank("institution_to_value") + 0.10 * (1 - rank("retail_overheat"))
    return ratio.withColumn("supply_demand_score", rounded(score)).drop("market_cap", "value_20d", *[f"{k}_net_value" for k in kinds])


def traded_value(prices: DataFrame, n: int = 20) -> DataFrame:
    """Sum of traded value over the last n price rows, by exact date."""
    return prices.select("date", "symbol", rounded(rolling(F.sum, F.col("trading_value"), n, 1), 2).alias(f"value_{n}d"))


FACTORS = {"momentum_score": 0.27, "supply_demand_score": 0.18, "value_score": 0.14, "quality_score": 0.09, "liquidity_score": 0.09, "consensus_score": 0.05, "upside_score": 0.03, "reliability_score": 0.02, "sentiment_score": 0.04}
RISK_WEIGHT = 0.09


def feature_matrix(prices: DataFrame, metrics: DataFrame, flows: DataFrame, consensus: DataFrame | None = None) -> DataFrame:
    """Price, market, flow (and as-of consensus) features of each price row, factors filled with 0.5.

    The final risk score averages base risk, retail overheating and 1 - supply-demand.
    """
    from quantloom.operators.analyst import attach_consensus

    keys = ["date", "symbol"]
    own = price_features(prices).join(market_features(metrics), keys, "left").join(flow_features(flows, prices, metrics), keys, "left")
    own = attach_consensus(own, consensus) if consensus is not None else own
    neutral = ["momentum_score", "supply_demand_score", "value_score", "quality_score", "liquidity_score", "consensus_score", "upside_score", "reliability_score", "sentiment_score"]
    known = set(own.columns)
    own = own.withColumns({c: F.coalesce(F.col(c), F.lit(0.5)) if c in known else F.lit(0.5) for c in neutral})
    risk = row_mean(F.col("risk_score"), clip(F.col("retail_overheat")), 1 - F.col("supply_demand_score"))
    return own.withColumn("risk_score", rounded(F.coalesce(risk, F.lit(0.5))))


def factor_baseline(matrix: DataFrame) -> DataFrame:
    """The deterministic factor model: probability from weighted factors, return from ranked 63-day momentum."""
    from functools import reduce

    prob = reduce(lambda a, b: a + b, [F.lit(w) * F.col(c) for c, w in FACTORS.items()]) + RISK_WEIGHT * (1 - F.col("risk_score"))
    return matrix.select("date", "symbol", rounded(clip(prob)).alias("pred_prob_top20"), rounded(pct_rank(F.coalesce(F.col("ret_63d"), F.lit(0.0)), "date")).alias("pred_return"))


def sequences(features: DataFrame, columns: list[str], lookback: int) -> DataFrame:
    """date, symbol and the last ``lookback`` rows of the columns, oldest first; only full ones."""
    frame = series().rowsBetween(-(lookback - 1), 0)
    seq = F.collect_list(F.array(*[F.coalesce(F.col(c), F.lit(0.0)) for c in columns])).over(frame)
    return features.select("date", "symbol", seq.alias("sequence")).where(F.size("sequence") == lookback)

#: Signals whose memory is short; models of horizons from LONG_HORIZON days leave them out.
SHORT_MEMORY = ("overseas_", "social_", "news_", "sector_link_")
LONG_HORIZON = 126


def columns_for(horizon_days: int, columns: list[str]) -> list[str]:
    """The feature columns that a horizon's model may use."""
    return [c for c in columns if horizon_days < LONG_HORIZON or not c.startswith(SHORT_MEMORY)]
