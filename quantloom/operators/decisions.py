"""Scores, flags, recommendations, portfolios and backtests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.columns import rounded, rule_array, weighted
from quantloom.functions.windows import compounded, drawdown, first_rank, pct_rank, with_pooled_ranks

SCORE = {"pred_prob_top20": 0.30, "return_rank": 0.20, "momentum_score": 0.15, "supply_demand_score": 0.15, "value_score": 0.10, "quality_score": 0.10, "risk_score": -0.20}


def score(predictions: DataFrame, matrix: DataFrame, weights: dict[str, float] = SCORE) -> DataFrame:
    """Weighted score of predictions joined with their features; missing factors count 0.5."""
    own = predictions.join(matrix, ["date", "symbol"])
    own = own.withColumn("return_rank", rounded(pct_rank(F.col("pred_return"), "date")))
    return own.withColumn("final_score", rounded(weighted(weights)))


def exclusion_flags(scored: DataFrame, least_value: float = 20000.0) -> DataFrame:
    """exclusions and risks: names of the rules that a row meets."""
    out = rule_array((F.col("trading_value_ma20") < least_value, "illiquid"), (F.col("volatility_60d") > 8, "volatile"), (F.col("close") < 101, "low_price"), (F.col("trading_value_ma20").isNull(), "short_history"))
    risk = rule_array((F.col("rsi_14") >= 60, "overbought"), (F.col("rsi_14") <= 40, "oversold"), (F.col("risk_score") >= 0.7, "high_risk"))
    own = scored.withColumn("exclusions", out)
    return own.withColumn("risks", F.concat(risk, F.transform("exclusions", lambda x: F.concat(F.lit("exclude:"), x))))


def reasons(least: int = 3, most: int = 5) -> Column:
    """Reasons of a row by ordered thresholds, padded and cut to the wanted number."""
    found = rule_array((F.col("momentum_score") >= 0.7, "strong momentum"), (F.col("supply_demand_score") >= 0.7, "net buying"), (F.col("value_score") >= 0.7, "cheap"), (F.col("quality_score") >= 0.7, "quality"), (F.col("risk_score") <= 0.3, "low risk"), (F.col("consensus_score") >= 0.6, "upgrades"))
    spare = F.array(F.lit("model score"), F.lit("factor balance"), F.lit("diversification"))
    padded = F.when(F.size(found) < least, F.concat(found, F.slice(spare, F.lit(1), F.lit(least) - F.size(found)))).otherwise(found)
    return F.slice(padded, 1, most)


def recommendations(scored: DataFrame, k: int = 10) -> DataFrame:
    """The k best unflagged rows of the latest date, ranked, with reasons."""
    flagged = exclusion_flags(scored)
    latest = flagged.agg(F.max("date").alias("date"))
    own = flagged.join(F.broadcast(latest), "date").where(F.size("exclusions") == 0)  # latest: one row
    top = own.withColumn("rank", first_rank(F.col("final_score"), "date").cast("long")).where(F.col("rank") <= k)
    return top.select("date", "symbol", "rank", "final_score", F.array_join(reasons(), ",").alias("reasons"), F.array_join("risks", ",").alias("risks"))


def period_last(dates: DataFrame, unit: str) -> DataFrame:
    """The last date of each day, week, month or quarter."""
    if unit == "D":
        return dates.select("date").distinct()
    name = {"W": "week", "M": "month", "Q": "quarter"}[unit]
    return dates.groupBy(F.trunc("date", name).alias("__p")).agg(F.max("date").alias("date")).select("date")


def topk_backtest(scored: DataFrame, *, k: int, cost_bps: float = 30.0, unit: str = "M", by: str = "final_score") -> DataFrame:
    """One row a rebalance date: gross, turnover, net, excess and compounded equity of the k best.

    Turnover is the share of new names, 1 at first.  Dates without a known
    forward return are left out before names are compared.
    """
    days = period_last(scored, unit)
    own = scored.join(days, "date", "left_semi").where("future_return is not null")
    top = own.withColumn("__r", first_rank(F.col(by), "date")).where(F.col("__r") <= k)
    each = top.groupBy("date").agg(rounded(F.avg("future_return"), 9).alias("gross"), rounded(F.avg("benchmark_return"), 9).alias("bench"), F.collect_set("symbol").alias("held"), rounded(F.avg(F.col("is_top20pct").cast("double"))).alias("precision"))
    time = Window.orderBy("date")  # rebalance dates: one row each
    before = F.lag("held").over(time)
    turnover = F.when(before.isNull(), 1.0).otherwise(F.least(F.lit(1.0), F.size(F.array_except("held", before)) / F.lit(float(k))))
    net = each.withColumn("turnover", turnover).withColumn("net", F.col("gross") - F.col("turnover") * cost_bps / 10000.0)
    net = net.withColumn("excess", F.col("net") - F.col("bench")).withColumn("__e", compounded(F.col("net"), time))
    return net.select("date", rounded(F.col("gross")).alias("gross"), rounded(F.col("turnover")).alias("turnover"), rounded(F.col("net")).alias("net"), rounded(F.col("excess")).alias("excess"), rounded(F.log("__e")).alias("log_equity"), rounded(drawdown(F.col("__e"), time)).alias("drawdown"), "precision")


def backtest_metrics(runs: DataFrame) -> DataFrame:
    """One row: periods, mean and deviation of net returns, Sharpe ratio a year, worst drawdown, hits, turnover."""
    per_year = 365.25 / F.avg("gap")
    own = runs.withColumn("gap", F.datediff("date", F.lag("date").over(Window.orderBy("date"))))
    return own.agg(
        F.count(F.lit(1)).alias("periods"), rounded(F.avg("net")).alias("mean_net"), rounded(F.stddev_pop("net")).alias("std_net"), rounded(F.try_divide(F.avg("net"), F.stddev_pop("net")) * F.sqrt(per_year), 4).alias("sharpe"),
        rounded(F.min("drawdown")).alias("max_drawdown"), rounded(F.avg((F.col("excess") > 0).cast("double"))).alias("hit_ratio"), rounded(F.avg("turnover")).alias("mean_turnover"), rounded(F.avg("excess")).alias("mean_excess"), rounded(F.avg("precision")).alias("mean_precision"),
    )


def gate(candidate: DataFrame, baseline: DataFrame, *, excess: float = 0.01, hit: float = 0.03, worse: float = 0.02, turnover: float = 1.30) -> DataFrame:
    """accepted and the first failed check of a candidate's metrics against a baseline's."""
    b = baseline.select(*[F.col(c).alias(f"b_{c}") for c in ("mean_excess", "hit_ratio", "max_drawdown", "mean_turnover")])
    own = candidate.join(F.broadcast(b))  # one row each
    failed = rule_array(
        (F.col("mean_excess") - F.col("b_mean_excess") < excess, "excess"), (F.col("hit_ratio") - F.col("b_hit_ratio") < hit, "hit_ratio"),
        (F.col("b_max_drawdown") - F.col("max_drawdown") > worse, "drawdown"), (F.col("mean_turnover") > turnover * F.col("b_mean_turnover"), "turnover"),
    )
    return own.select((F.size(failed) == 0).alias("accepted"), F.coalesce(F.get(failed, F.lit(0)), F.lit("passed")).alias("reason"))


def long_short(scored: DataFrame, *, longs: int = 3, shorts: int = 2, gross: float = 1.0) -> DataFrame:
    """Legs of each date and market: the best names, then the worst of the others, weighted evenly."""
    # one pass: the second rank puts the names of the first leg last
    up = scored.withColumn("__up", first_rank(F.col("final_score"), "date", "market"))
    last = Window.partitionBy("date", "market").orderBy(F.col("__up") <= longs, F.col("final_score").asc_nulls_last(), "symbol")
    place = up.withColumn("__low", F.row_number().over(last))
    side = F.when(F.col("__up") <= longs, "long").when(F.col("__low") <= shorts, "short")
    legs = place.withColumn("side", side).where("side is not null").withColumn("rank", F.when(F.col("side") == "long", F.col("__up")).otherwise(F.col("__low")))
    n = F.count(F.lit(1)).over(Window.partitionBy("date", "market", "side"))
    return legs.select("date", "market", "symbol", "side", F.col("rank").cast("long").alias("rank"), rounded(F.when(F.col("side") == "long", gross / n).otherwise(-gross / n)).alias("weight"), "future_return")


def long_short_backtest(legs: DataFrame, *, cost_bps: float = 30.0) -> DataFrame:
    """One row a date and market: spread of the legs, turnover of signed names, net and compounded equity.

    A net loss of everything or more adds nothing to the logarithm of equity.
    """
    signed = F.concat("side", F.lit(":"), "symbol")
    mean = lambda side: F.avg(F.when(F.col("side") == side, F.col("future_return")))
    each = legs.groupBy("date", "market").agg(rounded(mean("long") - mean("short"), 9).alias("spread"), F.collect_set(signed).alias("held")).where("spread is not null")
    time = Window.partitionBy("market").orderBy("date")
    before = F.lag("held").over(time)
    changed = F.size(F.array_except("held", before)) + F.size(F.array_except(before, F.col("held")))
    turnover = F.when(before.isNull(), 1.0).otherwise(changed / (2.0 * F.size("held")))
    net = each.withColumn("turnover", rounded(turnover)).withColumn("net", F.col("spread") - F.col("turnover") * cost_bps / 10000.0)
    return net.select("date", "market", rounded(F.col("spread")).alias("spread"), "turnover", rounded(F.col("net")).alias("net"), rounded(F.sum(F.log1p(F.when(F.col("net") > -1, F.col("net")))).over(time)).alias("log_equity"))


def capped_portfolio(names: DataFrame, *, cap: float = 0.15, sector_cap: float = 0.30, cash: float = 0.10) -> DataFrame:
    """Score-proportional weights, cut by name, then scaled down by sector; the rest is cash."""
    raw = F.col("final_score") / F.sum("final_score").over(Window.partitionBy("date")) * (1 - cash)
    own = names.withColumn("__w", F.least(raw, F.lit(cap)))
    in_sector = F.sum("__w").over(Window.partitionBy("date", "sector"))
    w = F.when(in_sector > sector_cap, F.col("__w") * sector_cap / in_sector).otherwise(F.col("__w"))
    own = own.withColumn("weight", rounded(w, 4))
    return own.select("date", "symbol", "sector", "weight", rounded(1 - F.sum("weight").over(Window.partitionBy("date")), 4).alias("cash"))


def backtest_results(scored: DataFrame, horizon_days: int) -> DataFrame:
    """rank_no by date, hit and outperformance flags, and the calendar target date."""
    rank = first_rank(F.col("final_score"), "date").cast("long")
    own = scored.where("future_return is not null").withColumn("rank_no", rank)
    flag = lambda c: F.coalesce(c, F.lit(False))
    return own.select("date", "symbol", "rank_no", F.date_add("date", horizon_days).alias("target_date"), "pred_return", "future_return", flag(F.col("future_return") > 0).alias("is_hit"), flag(F.col("future_return") > F.col("benchmark_return")).alias("is_outperform"), (F.col("rank_no") <= 5).alias("is_top"))


def performance(results: DataFrame) -> DataFrame:
    """One row: hit and win rates, mean and median return, rank correlation of prediction and outcome."""
    own = with_pooled_ranks(results, __a="pred_return", __b="future_return")
    return own.agg(
        F.count(F.lit(1)).alias("n"), rounded(F.avg(F.col("is_hit").cast("double"))).alias("hit_rate"), rounded(F.avg(F.col("is_outperform").cast("double"))).alias("win_rate"), rounded(F.avg("future_return")).alias("mean_return"),
        rounded(F.median("future_return")).alias("median_return"), rounded(F.avg(F.when(F.col("is_top"), F.col("is_hit").cast("double")))).alias("top_precision"), rounded(F.corr("__a", "__b"), 5).alias("rank_ic"),
    )


MODEL = ("model_name", "model_version", "horizon", "horizon_days")


def performance_by_model(results: DataFrame, top: int = 20) -> DataFrame:
    """Each model, version and horizon: rates, means and rank correlation of its results, and the path of its portfolios.

    A portfolio is the mean return of the ``top`` best of a date; the path has
    every ``horizon_days``-th one, so that none overlaps the next.  Drawdown is
    that of the path's product; the Sharpe ratio is NULL with fewer than two
    portfolios or without spread.
    """
    own = results.where("actual_return is not null")
    best = own.where(F.col("rank_no") <= top)
    ranked = own.withColumns({"__a": pct_rank(F.col("pred_return"), *MODEL), "__b": pct_rank(F.col("actual_return"), *MODEL)})
    share = lambda c: F.avg(F.col(c).cast("double"))
    whole = ranked.groupBy(*MODEL).agg(
        F.max("prediction_date").alias("eval_date"), F.count(F.lit(1)).alias("sample_count"), rounded(share("is_hit")).alias("hit_ratio"), rounded(F.avg(F.when(F.col("rank_no") <= top, F.col("is_hit").cast("double")))).alias("precision_top"),
        rounded(F.avg("actual_return")).alias("avg_actual"), rounded(F.avg("benchmark_return")).alias("avg_benchmark"), rounded(F.avg("excess_return")).alias("avg_excess"), rounded(F.median("actual_return")).alias("median_actual"),
        rounded(share("is_outperform")).alias("win_rate"), rounded(F.corr("__a", "__b"), 5).alias("rank_ic"),
    )
    daily = best.groupBy(*MODEL, "prediction_date").agg(F.avg("actual_return").alias("r"))
    time = Window.partitionBy(*MODEL).orderBy("prediction_date")  # a row for each date
    path = daily.withColumn("i", F.row_number().over(time) - 1).where(F.col("i") % F.greatest(F.lit(1), F.col("horizon_days")) == 0)
    path = path.withColumn("level", compounded(F.col("r"), time)).withColumn("fall", drawdown(F.col("level"), time))
    spread = F.stddev_pop("r")
    sharpe = F.when((F.count("r") >= 2) & (spread > 1e-8), F.avg("r") / spread * F.sqrt(252.0 / F.greatest(F.lit(1), F.col("horizon_days"))))
    paths = path.groupBy(*MODEL).agg(F.count("r").alias("n_portfolios"), rounded(F.min("fall")).alias("mdd"), rounded(sharpe, 4).alias("sharpe"))
    return whole.join(paths, list(MODEL), "left")


def price_gap(predictions: DataFrame, prices: DataFrame, *, days: int) -> DataFrame:
    """Entry and target closes on or after their dates, the realised return, its gap to the prediction, and a status."""
    from quantloom.operators.asof import asof_join

    px = prices.select("symbol", "date", "close")
    own = predictions.select(F.col("date").alias("asof_date"), "symbol", "pred_return")
    entry = asof_join(own, px, key="symbol", left_on="asof_date", right_on="date", take=["close"], forward=True).withColumnsRenamed({"close": "entry", "matched_at": "entry_date"})
    due = asof_join(entry.withColumn("due", F.date_add("asof_date", days)), px, key="symbol", left_on="due", right_on="date", take=["close"], forward=True).withColumnsRenamed({"close": "target", "matched_at": "target_date"})
    realised = rounded(F.try_divide(F.col("target"), F.col("entry")) - 1)
    status = F.when(F.col("entry").isNull(), "missing_price").when(F.col("target").isNull(), "pending").otherwise("completed")
    return due.select("asof_date", "symbol", "pred_return", "entry", "target", status.alias("status"), realised.alias("realised"), rounded(realised - F.col("pred_return")).alias("gap"), F.coalesce(F.signum(realised) == F.signum("pred_return"), F.lit(False)).alias("direction_hit"))


def random_scores(scored: DataFrame, seed: int) -> DataFrame:
    """``scored`` with random_score in [0, 1): a number of the seed, date and symbol, so that reruns and partitions agree."""
    name = F.concat_ws("|", F.lit(str(seed)), F.date_format("date", "yyyy-MM-dd"), "symbol")
    return scored.withColumn("random_score", F.conv(F.substring(F.md5(name.cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0)


def forecast_band(latest: DataFrame, results: DataFrame, *, horizon_days: int, expected: str = "expected", actual: str = "future_return") -> DataFrame:
    """``latest`` rows (close, the expected return, volatility_60d) with band, band_source and the base, upside and downside price.

    The band is the root mean squared error of past predictions (one number);
    without any, the volatility of the horizon; within 0 and 1.  A rise widens
    only the upper price, a fall only the lower one.
    """
    error = F.col(expected) - F.col(actual)
    past = results.agg(F.sqrt(F.avg(error * error)).alias("__rmse"))  # one row
    own = latest.join(F.broadcast(past))
    volatility = F.col("volatility_60d") * (horizon_days / 252.0) ** 0.5
    known = F.coalesce("__rmse", volatility)
    band = F.when(known.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), known)))
    source = F.when(F.col("__rmse").isNotNull(), "backtest_rmse").when(volatility.isNotNull(), "volatility_60d")
    price = lambda r: F.col("close") * (1 + r)
    wide, r = F.coalesce(band, F.lit(0.0)), F.col(expected)
    own = own.withColumns({"band": band, "band_source": source, "base_price": price(r), "upside_price": price(F.greatest(r, F.lit(0.0)) + wide), "downside_price": price(F.least(r, F.lit(0.0)) - wide)})
    return own.drop("__rmse")
