"""The dataset of market outlooks: two horizons, index features, breadth and daily feeds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.windows import change, rolling
from quantloom.operators.asof import Trailing, carry

#: Values that stand in for a feed's missing ones; all other features are 0.
NEUTRAL = {
    "risk": 50.0, "cash": 0.15, "semiconductor_score": 50.0, "futures_score": 50.0, "fund_impact": 0.5, "social_sentiment": 0.5, "news_sentiment": 0.5, "feed_sentiment_3d": 0.5, "up_probability": 0.5, "down_probability": 0.5,
}
HORIZONS = ("TODAY", "WEEK")


def index_features(index: DataFrame) -> DataFrame:
    """date, market, close and the index's returns, deviations and gaps to its means (over 5 and 20 rows, of 2 and 5 at least)."""
    key, c = "market", F.col("close")
    own = index.withColumn("return_1d", change(c, 1, key=key))
    return own.select(
        "date", "market", "close", "return_1d", *[change(c, n, key=key).alias(f"return_{n}d") for n in (5, 20)],
        *[rolling(F.stddev_samp, F.col("return_1d"), n, least, key=key).alias(f"volatility_{n}d") for n, least in ((5, 2), (20, 5))],
        *[(c / rolling(F.avg, c, n, least, key=key) - 1).alias(f"ma_gap_{n}d") for n, least in ((5, 2), (20, 5))],
    )


def _friday(day: Column) -> Column:
    """The Friday on or after a day."""
    return F.date_add(day, F.pmod(F.lit(4) - F.weekday(day), F.lit(7)))


def _next_weekday(day: Column) -> Column:
    return F.date_add(day, F.when(F.weekday(day) == 4, 3).when(F.weekday(day) == 5, 2).otherwise(1))


def targets(rows: DataFrame) -> DataFrame:
    """Every (date, market) row once for each horizon, with target_date and label_return.

    TODAY asks for the market's next date; WEEK for its last date up to the
    Friday of the week (from a Friday on: of the next week), or the next date.
    The latest date of all has weekdays of the calendar for targets and no
    label; a market's last date before that has no row.
    """
    time = Window.partitionBy("market").orderBy(F.datediff("date", F.lit("1970-01-01").cast("date")))
    week = time.rangeBetween(1, 7)
    end = _friday(F.date_add("date", 1))
    last = rows.agg(F.max("date").alias("__last"))  # one row
    near = F.collect_list(F.struct("date", "close")).over(week)  # of a week at most
    inside = F.array_max(F.filter(near, lambda x: x["date"] <= end))
    after = F.struct(F.lead("date").over(time).alias("date"), F.lead("close").over(time).alias("close"))
    after = F.when(after["date"].isNotNull(), after)
    tomorrow = _next_weekday(F.col("date"))
    known = rows.join(F.broadcast(last)).withColumns({"__next": after, "__week": F.coalesce(inside, after)})
    final = F.col("date") == F.col("__last")
    pick = lambda name, seen, made: F.struct(F.lit(name).alias("horizon"), F.when(final, made).otherwise(F.col(seen)["date"]).alias("target_date"), F.when(~final, F.col(seen)["close"]).alias("target_close"))
    each = known.withColumn("__t", F.explode(F.array(pick("TODAY", "__next", tomorrow), pick("WEEK", "__week", _friday(tomorrow)))))
    out = each.select(*rows.columns, "__t.*").where("target_date is not null")
    return out.withColumn("label_return", F.when(F.col("close") != 0, F.col("target_close") / F.col("close") - 1)).drop("target_close")


def news_feed(days: DataFrame, articles: DataFrame, *, on: str, sentiment: Column, feed: Column, negative: Column) -> DataFrame:
    """Articles of each date, and of one curated feed over one and three days with its negative ones.

    In the feed's mean negative articles weigh twice, positive ones (0.6 or more) three quarters.
    """
    s, weight = F.coalesce(sentiment, F.lit(0.5)), F.when(F.col("__neg"), 2.0).when(F.col("__s") >= 0.6, 0.75).otherwise(1.0)
    own = articles.select(F.col(on).alias("date"), s.alias("__s"), feed.alias("__x"), ((s <= 0.45) | negative).alias("__neg"))
    x = lambda c: F.sum(F.when(F.col("__x"), c).otherwise(F.lit(0.0)))
    daily = own.groupBy("date").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("__s").alias("s"), x(F.lit(1.0)).alias("x"), x(F.col("__neg").cast("double")).alias("bad"), x(F.col("__s") * weight).alias("xs"), x(weight).alias("xw"))
    one = F.lit(0).alias("k")
    feeds = {
        "day": Trailing(daily.withColumn("k", one), "date", 1, {"news_count": (F.sum, "n"), "__s": (F.sum, "s"), "feed_count": (F.sum, "x")}),
        "three": Trailing(daily.withColumn("k", one), "date", 3, {"feed_count_3d": (F.sum, "x"), "feed_negative_3d": (F.sum, "bad"), "__xs": (F.sum, "xs"), "__xw": (F.sum, "xw")}),
    }
    seen = carry(days.select("date", one), key="k", on="date", trailing=feeds)  # a row for each day on either side
    count = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return seen.select(
        "date", count("news_count").alias("news_count"), F.coalesce(F.try_divide("__s", "news_count"), F.lit(0.5)).alias("news_sentiment"), *[count(c).alias(c) for c in ("feed_count", "feed_count_3d", "feed_negative_3d")],
        F.least(F.lit(1.0), count("feed_negative_3d") * 2 / 3).alias("feed_attention_3d"), F.coalesce(F.try_divide("__xs", "__xw"), F.lit(0.5)).alias("feed_sentiment_3d"),
    )


def together(feeds: list[DataFrame], keys: list[str]) -> DataFrame:
    """Feeds with a row for each key side by side: one shuffle, however many feeds there are."""
    parts = [f.select(*keys, F.struct(*[c for c in f.columns if c not in keys]).alias(f"__{i}")) for i, f in enumerate(feeds)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    wide = rows.groupBy(*keys).agg(*[F.max(f"__{i}").alias(f"__{i}") for i in range(len(feeds))])
    return wide.select(*keys, *[F.col(f"__{i}.{c}").alias(c) for i, f in enumerate(feeds) for c in f.columns if c not in keys])


def outlook_rows(index: DataFrame, by_market: list[DataFrame], by_date: list[DataFrame]) -> DataFrame:
    """The dataset: targets of the index's features with all feeds, features filled with neutral values."""
    own = targets(index_features(index))
    wide = own.join(together(by_market, ["date", "market"]), ["date", "market"], "left").join(together(by_date, ["date"]), "date", "left")
    frame = ("date", "market", "close", "horizon", "target_date", "label_return")
    return wide.select(*frame, *[F.coalesce(F.col(c).cast("double"), F.lit(NEUTRAL.get(c, 0.0))).alias(c) for c in wide.columns if c not in frame])
