"""Links between the domestic market and markets abroad that closed before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.columns import centred_score, clip, row_mean
from quantloom.operators.asof import Latest, carry, latest_by_day


def sector_link(domestic: DataFrame, abroad: DataFrame, proxies: DataFrame, *, recent: int = 60, spread: int = 20, least: int = 5) -> DataFrame:
    """Each date and sector of ``domestic`` (date, sector, r) with its proxies abroad, as known the day before.

    ``abroad`` has trade_date, symbol, return_1d, return_5d; ``proxies`` sector
    and symbol.  The proxies' mean returns and their distance from the last
    ``spread`` means in deviations; beta, correlation and agreement over the
    last ``recent`` dates that both sides have; the impact score.  What fewer
    than ``least`` dates show is NULL (agreement: a half).
    """
    mean = abroad.join(proxies, "symbol").groupBy("sector", "trade_date").agg(F.avg("return_1d").alias("sector_return"), F.avg("return_5d").alias("sector_return_5d")).where("sector_return is not null")
    time = Window.partitionBy("sector").orderBy("trade_date")
    last, x = time.rowsBetween(-(spread - 1), 0), F.col("sector_return")
    deviation = F.stddev_pop(x).over(last)
    known = mean.withColumn("zscore", F.when((F.count(x).over(last) >= least) & (deviation > 1e-9), (x - F.avg(x).over(last)) / deviation))

    both = domestic.where("r is not null").join(mean.select("sector", F.col("trade_date").alias("date"), "sector_return"), ["sector", "date"])
    frame, y = Window.partitionBy("sector").orderBy("date").rowsBetween(-(recent - 1), 0), F.col("r")
    enough, vx, vy = F.count(x).over(frame) >= least, F.var_pop(x).over(frame), F.var_pop(y).over(frame)
    covariance = F.covar_pop(x, y).over(frame)
    common = both.select(
        "sector", "date", F.count(x).over(frame).alias("n_common"), F.when(enough & (vx > 1e-12), covariance / vx).alias("beta"), F.when(enough & (vx > 1e-24) & (vy > 1e-24), covariance / F.sqrt(vx) / F.sqrt(vy)).alias("corr"),
        F.when(enough, F.avg((F.signum(x) == F.signum(y)).cast("double")).over(frame)).alias("agreement"),
    )
    feeds = {"abroad": Latest(known, "trade_date", ["sector_return", "sector_return_5d", "zscore"], 1), "common": Latest(common, "date", ["n_common", "beta", "corr", "agreement"], 1)}
    out = carry(domestic, key="sector", on="date", latest=feeds).withColumn("agreement", F.coalesce("agreement", F.lit(0.5)))
    return out.withColumn("sector_impact", sector_impact(F.col("sector_return"), F.col("zscore"), F.col("corr"), F.col("agreement"))).drop("common_at")


def sector_impact(ret: Column, zscore: Column, corr: Column, agreement: Column) -> Column:
    """The weights of return, distance, correlation and agreement."""
    return clip(0.45 * centred_score(ret, 0.04) + 0.25 * centred_score(zscore, 3.0) + 0.15 * (0.5 + 0.25 * clip(F.coalesce(corr, F.lit(0.0)), -1.0)) + 0.15 * clip(agreement))


#: What the link reads: a leveraged and a plain fund on the domestic market, two broad indexes abroad and the currency.
ROLES = ("lever", "fund", "broad", "growth", "currency")


def fund_link(days: DataFrame, bars: DataFrame, snapshots: DataFrame, roles: dict[str, str], local: DataFrame, *, factor: float = 3.0, shock: float = -0.02, flow_span: float = 2e11) -> DataFrame:
    """Each date with the funds abroad, the local market of the day, and the impact score.

    ``bars`` (trade_date, symbol, return_1d, volume_ratio) count up to the day
    before, ``snapshots`` (day, symbol, change_rate, at) up to the date itself;
    a snapshot with a rate, if there is any, goes before the bars.  ``local``
    has date, index_a, index_b, stock_a, stock_b (returns of the day),
    foreign_net, institution_net, retail_net and, if known, news (0 to 1).
    """
    taken = snapshots.withColumnRenamed("at", "snapshot_time")
    asked = days.select("date", F.explode(F.array(*[F.lit(roles[r]) for r in ROLES])).alias("symbol"))
    own = carry(asked, key="symbol", on="date", latest={"bar": Latest(bars, "trade_date", ["return_1d", "volume_ratio"], 1), "snapshot": Latest(taken, "day", ["snapshot_time", "change_rate"])})
    of = lambda role, c: F.max(F.when(F.col("symbol") == roles[role], c))
    live = F.col("change_rate").isNotNull()
    value = F.coalesce("change_rate", "return_1d")
    wide = own.groupBy("date").agg(
        *[of(r, value).alias(f"{r}_return") for r in ROLES], of("lever", F.col("volume_ratio")).alias("lever_volume_ratio"), of("lever", F.when(live, F.col("snapshot_at")).otherwise(F.col("bar_at"))).alias("signal_date"),
        of("lever", F.when(live, "snapshot").when(F.col("return_1d").isNotNull(), "bar")).alias("signal_source"),
    )
    out = wide.join(local, "date", "left")
    out = out.withColumns({"spread": F.col("lever_return") - F.col("fund_return"), "drift": F.col("lever_return") - factor * F.col("fund_return")})
    low = F.least("index_a", "index_b")
    news = F.col("news") if "news" in local.columns else F.lit(None).cast("double")
    return out.withColumn("shock", F.coalesce(low <= shock, F.lit(False))).withColumn("impact", fund_impact(flow_span, news))


def fund_impact(flow_span: float, news: Column) -> Column:
    """The weights of seven parts and the returns that span their scores; a missing part is neutral."""
    score = lambda c, span: centred_score(F.col(c), span)
    parts = (
        (0.20, score("fund_return", 0.025)), (0.15, row_mean(score("index_a", 0.025), score("index_b", 0.03))), (0.20, row_mean(score("stock_a", 0.03), score("stock_b", 0.03))), (0.15, score("foreign_net", flow_span)),
        (0.10, centred_score(-F.col("currency_return"), 0.01)), (0.10, row_mean(score("broad_return", 0.02), score("growth_return", 0.025))), (0.10, F.coalesce(news, F.lit(0.5))),
    )
    return clip(sum((w * x for w, x in parts), F.lit(0.0)))


def regime_by_day(days: DataFrame, bars: DataFrame, roles: dict[str, tuple[str, str]], limits: dict[str, float] | None = None, *, lag_days: int = 0) -> DataFrame:
    """The regime of each date from the last row of every series at or before it."""
    from quantloom.operators.rules import regime_row

    return regime_row(latest_by_day(days, bars, roles, on="trade_date", lag_days=lag_days), limits)
