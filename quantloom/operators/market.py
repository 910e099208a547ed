"""Text signals, cross-market links, regimes, outlooks and explanations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.columns import centred_score, clip, norm_cdf, rounded
from quantloom.functions.windows import change, rolling


def social_signal(posts: DataFrame, asof: str) -> DataFrame:
    """One row a ticker: 24 hours to ``asof`` against the 24 before; later posts never count."""
    t = F.lit(asof).cast("timestamp")
    age = (F.unix_seconds(t) - F.unix_seconds(F.col("ts").cast("timestamp"))) / 3600.0
    own = posts.withColumn("age", age).where((F.col("age") >= 0) & (F.col("age") < 48))
    now = F.col("age") < 24
    weight = F.when(now, F.col("source_weight"))
    one = own.groupBy("ticker").agg(
        F.count_if(now).alias("n24"), F.count_if(~now).alias("n_before"), F.count_if(F.col("age") < 1).alias("n1"), F.try_divide(F.sum(weight * (0.65 * (F.col("sentiment") + 1) / 2 + 0.35 * F.col("urgency"))), F.sum(weight)).alias("weighted"),
        F.avg(F.when(now, F.col("urgency"))).alias("urgency"), F.count_distinct(F.when(now, F.col("duplicate_key"))).alias("keys"),
    )
    delta = clip(F.when(F.col("n_before") > 0, (F.col("n24") - F.col("n_before")) / F.col("n_before")).otherwise(F.col("n24").cast("double")), -1, 10)
    copies = 1 - F.try_divide(F.col("keys"), F.col("n24"))
    heat = 0.45 * F.least(F.lit(1.0), F.col("n24") / 20.0) + 0.30 * F.coalesce("weighted", F.lit(0.5)) + 0.15 * F.coalesce("urgency", F.lit(0.0)) + 0.10 * (1 - F.coalesce(copies, F.lit(0.0)))
    return one.select("ticker", "n24", "n1", rounded(delta).alias("delta"), rounded(F.col("weighted")).alias("weighted"), rounded(heat).alias("attention"))


def news_signal(news: DataFrame, sentiment: Column, days: int = 3) -> DataFrame:
    """Market and per-symbol article measures of the last ``days`` dates of each publication date."""
    own = news.withColumn("s", sentiment).withColumn("u", (F.col("s") + 1) / 2)
    scoped = own.select(F.explode(F.array(F.lit("market"), F.col("symbol"))).alias("scope"), "pub_date", "u")
    daily = scoped.groupBy("scope", "pub_date").agg(F.count(F.lit(1)).alias("n"), F.sum("u").alias("s"), F.count_if(F.col("u") <= 0.45).alias("neg"), F.count_if(F.col("u") >= 0.6).alias("pos"))
    day = F.datediff("pub_date", F.lit("1970-01-01").cast("date"))
    frame = Window.partitionBy("scope").orderBy(day).rangeBetween(-(days - 1), 0)
    n = F.sum("n").over(frame)
    return daily.select("scope", "pub_date", n.alias("n"), rounded(F.sum("s").over(frame) / n).alias("sentiment"), rounded(F.sum("neg").over(frame) / n).alias("negative"), rounded(F.sum("pos").over(frame) / n).alias("positive"))


def daily_bars(bars: DataFrame) -> DataFrame:
    """Returns over 1, 5 and 20 rows and the 20-row volatility (at least 5) of each symbol."""
    c = F.col("close")
    own = bars.withColumn("ret1", change(c, 1, order="trade_date"))
    ret = lambda n: rounded(change(c, n, order="trade_date")).alias(f"return_{n}d")
    return own.select("trade_date", "symbol", "close", ret(1), ret(5), ret(20), rounded(rolling(F.stddev_samp, F.col("ret1"), 20, 5, order="trade_date")).alias("volatility_20d"))


def overseas_link(domestic: DataFrame, foreign: DataFrame) -> DataFrame:
    """Each domestic date and benchmark with the last foreign day before it: spread, 60-row correlation, beta and agreement, impact."""
    from quantloom.operators.asof import asof_join

    one = F.lit("x")
    time = Window.partitionBy("benchmark").orderBy("date")
    dom = domestic.withColumn("r", F.col("close") / F.lag("close").over(time) - 1).withColumn("k", one)
    right = foreign.select(one.alias("k"), "trade_date", F.col("return_1d").alias("f"))
    own = asof_join(dom, right, key="k", left_on="date", right_on="trade_date", take=["f"], lag_days=1)
    frame = time.rowsBetween(-60, -1)
    x, y = F.when(F.col("r").isNotNull(), F.col("f")), F.when(F.col("f").isNotNull(), F.col("r"))
    enough = F.count(x).over(frame) >= 5
    agree = F.avg((F.signum(x) == F.signum(y)).cast("double")).over(frame)
    own = own.select("date", "benchmark", "r", "f", "matched_at", F.when(enough, F.corr(x, y).over(frame)).alias("corr"), F.when(enough, F.try_divide(F.covar_pop(x, y).over(frame), F.var_pop(x).over(frame))).alias("beta"), F.when(enough, agree).alias("agree"))
    impact = 0.45 * centred_score(F.col("f"), 0.5) + 0.25 * F.coalesce(clip(0.5 + F.col("beta") / 4), F.lit(0.5)) + 0.15 * (0.5 + 0.25 * F.coalesce("corr", F.lit(0.0))) + 0.15 * F.coalesce("agree", F.lit(0.5))
    return own.select("date", "benchmark", "matched_at", rounded(F.col("r") - F.col("f")).alias("spread"), rounded(F.col("corr"), 5).alias("corr"), rounded(F.col("beta"), 4).alias("beta"), rounded(F.col("agree")).alias("agreement"), rounded(impact, 4).alias("impact"))


def regime(bars: DataFrame) -> DataFrame:
    """Points and regime of each trade date from threshold signals on the regions' returns."""
    r = lambda s, c: F.max(F.when(F.col("symbol") == s, F.col(c)))
    day = bars.groupBy("trade_date").agg(*[r(f"R{i}", "return_1d").alias(f"r{i}") for i in range(5)], r("R0", "volatility_20d").alias("v0"))
    hit = lambda cond, points: F.when(cond, points).otherwise(0)
    points = hit(F.col("r0") <= -0.3, 20) + hit(F.col("r1") <= -0.3, 25) + hit(F.col("r2") <= -0.3, 25) + hit(F.col("r3") <= -0.3, 15) + hit(F.col("r4") <= -0.3, 10) + hit(F.col("v0") >= 0.5, 10)
    own = day.withColumn("points", F.least(F.lit(100), points))
    name = F.when(F.col("points") >= 70, "panic").when(F.col("points") >= 45, "risk_off").when(F.col("points") >= 20, "neutral").otherwise("risk_on")
    cap = F.when(F.col("points") >= 70, 0.50).when(F.col("points") >= 45, 0.30).when(F.col("points") >= 20, 0.15).otherwise(0.05)
    return own.select("trade_date", F.col("points").cast("long").alias("points"), name.alias("regime"), cap.alias("adjustment"))


CAUSES = (("foreign_sell", "f < -0.2", 0.3), ("wide_spread", "abs_spread > 0.5", 0.25), ("weak_link", "corr < 0", 0.2), ("drop", "r < -0.2", 0.25))


def causes(links: DataFrame) -> Column:
    """Causes whose rule holds, by impact and then rule order."""
    found = F.filter(F.array(*[F.when(F.expr(rule), F.struct(F.lit(-w).alias("w"), F.lit(i).alias("i"), F.lit(n).alias("n"))) for i, (n, rule, w) in enumerate(CAUSES)]), lambda x: x.isNotNull())
    return F.transform(F.slice(F.array_sort(found), 1, 5), lambda x: x["n"])


def breadth(prices: DataFrame, symbols: DataFrame) -> DataFrame:
    """Shares of rising symbols and mean change of each date and market."""
    own = prices.withColumn("r", change(F.col("close"), 1)).join(symbols.select("symbol", "market"), "symbol")
    up = lambda c: F.avg(F.when(F.col("r").isNotNull(), (c).cast("double")))
    return own.groupBy("date", "market").agg(rounded(up(F.col("r") > 0)).alias("up_share"), rounded(up(F.col("r") < -0.02)).alias("down_share"), rounded(F.avg("r")).alias("mean_return"))


def outlook_dataset(index: DataFrame, breadths: DataFrame) -> DataFrame:
    """Index features, breadth and next return of each market and date."""
    time = Window.partitionBy("market").orderBy("date")
    own = index.select("date", F.col("benchmark").alias("market"), "close")
    c = F.col("close")
    ret = lambda n: c / F.lag("close", n).over(time) - 1
    own = own.withColumn("r1", ret(1)).withColumn("r5", ret(5))
    std = rolling(F.stddev_samp, F.col("r1"), 20, 5, key="market")
    own = own.select("date", "market", rounded(F.col("r1")).alias("return_1d"), rounded(F.col("r5")).alias("return_5d"), rounded(std).alias("volatility_20d"), rounded(c / rolling(F.avg, c, 20, 5, key="market") - 1).alias("ma_gap_20d"), rounded(F.lead("close").over(time) / c - 1).alias("label"))
    return own.join(breadths, ["date", "market"], "left")


FEATURES = ("return_1d", "return_5d", "volatility_20d", "ma_gap_20d", "up_share")


def ridge(dataset: DataFrame, columns: tuple[str, ...] = FEATURES, alpha: float = 1.0, least: int = 8) -> DataFrame:
    """market, intercept, coefficients, residual deviation and rows of a closed-form ridge fit on z-scores.

    The normal equations come from one aggregation of sums and products, so
    only a few numbers a market reach the solver.
    """
    own = dataset.where("label is not null").select("market", *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in columns], "label")
    names = [*columns, "label"]
    aggs = [F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s_{c}") for c in names]]
    aggs += [F.sum(F.col(a) * F.col(b)).alias(f"p_{a}_{b}") for i, a in enumerate(names) for b in names[i:]]
    sums = own.groupBy("market").agg(*aggs)

    def solve(batches):
        import numpy as np
        import pandas as pd

        for frame in batches:
            rows = []
            for row in frame.to_dict("records"):
                n, k = row["n"], len(columns)
                if n < least:
                    continue
                mean = np.array([row[f"s_{c}"] for c in names]) / n
                cov = np.array([[row.get(f"p_{a}_{b}", row.get(f"p_{b}_{a}")) for b in names] for a in names]) / n - np.outer(mean, mean)
                sd = np.sqrt(np.maximum(np.diag(cov)[:k], 0.0))
                sd[sd == 0] = 1.0
                xx, xy = cov[:k, :k] / np.outer(sd, sd), cov[:k, k] / sd
                w = np.linalg.solve(n * xx + alpha * np.eye(k), n * xy)
                resid = cov[k, k] - 2 * w @ xy + w @ xx @ w
                coef = w / sd
                rows.append((row["market"], int(n), float(mean[k] - coef @ mean[:k]), [float(x) for x in coef], float(np.sqrt(max(resid, 0.0)))))
            yield pd.DataFrame(rows, columns=["market", "n", "intercept", "coefficients", "residual"])

    return sums.mapInPandas(solve, "market string, n long, intercept double, coefficients array<double>, residual double")


def forecast(mu: Column, sigma: Column) -> tuple[Column, Column, Column]:
    """P(up), P(shock below -2 %), direction of a normal outlook with a bounded deviation."""
    s = clip(sigma, 0.006, 0.5)
    up, shock = 1 - norm_cdf(-mu / s), norm_cdf((F.lit(-0.02) - mu) / s)
    return up, shock, F.when((mu >= 0.005) & (up >= 0.56), "up").when((mu <= -0.005) & (up <= 0.44), "down").otherwise("flat")


def moves(prices: DataFrame) -> DataFrame:
    """Last close of each symbol against the one before and 21 rows before."""
    back = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))
    own = prices.withColumn("back", back).where("back in (1, 2, 22)")
    at = lambda n: F.max(F.when(F.col("back") == n, F.col("close")))
    return own.groupBy("symbol").agg(F.max("date").alias("date"), rounded(F.try_divide(at(1), at(2)) - 1).alias("move"), rounded(F.try_divide(at(1), at(22)) - 1).alias("move_21"))


def refresh_universe(symbols: DataFrame, metrics: DataFrame, prices: DataFrame, *, per_market: int = 8, least_rows: int = 100) -> DataFrame:
    """Every symbol with its status: excluded, or ranked by latest market value within its market and taken while places last."""
    latest = metrics.groupBy("symbol").agg(F.max_by("market_cap", "date").alias("market_cap"))
    history = prices.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"))
    own = symbols.join(latest, "symbol", "left").join(history, "symbol", "left")
    why = F.when(F.col("market_cap").isNull(), "no_market_value").when(F.coalesce("rows", F.lit(0)) < least_rows, "short_history")
    place = F.row_number().over(Window.partitionBy("market", F.col("why").isNull()).orderBy(F.desc_nulls_last("market_cap"), "symbol"))
    own = own.withColumn("why", why).withColumn("place", place)
    status = F.coalesce("why", F.when(F.col("place") <= per_market, "taken").otherwise("spare"))
    return own.select("symbol", "market", status.alias("status"), F.when(F.col("why").isNull(), F.col("place")).cast("long").alias("place"))
