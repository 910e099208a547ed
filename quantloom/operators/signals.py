"""Signals of posts and articles: measures of a day or a few, for the market, symbols and tickers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.columns import clip

# Weights of a ticker's final signal, and of the market's and a ticker's attention (mentions, weighted mood, urgency, originality).
SIGNAL = {"mentions": 0.25, "sentiment": 0.20, "weighted": 0.20, "momentum": 0.20, "urgency": 0.10, "risk": -0.15, "copies": -0.10}
ATTENTION = {"ticker": (0.45, 0.30, 0.15, 0.10), "market": (0.45, 0.25, 0.20, 0.10)}
# Themes that count for the chip and the macro score of posts, and for those of articles and their flow score.
CHIPS, POST_MACRO, NEWS_MACRO, FLOW = ("SEMICONDUCTOR", "AI"), ("RATE", "ENERGY", "CRYPTO", "DEFENSE"), ("RATE", "ENERGY", "MACRO"), ("FLOW", "PENSION_FLOW")
# How negative and positive articles weigh in the adjusted mood, and from which mood on they are such.
NEGATIVE_WEIGHT, POSITIVE_WEIGHT, NEGATIVE_FROM, POSITIVE_FROM = 2.0, 0.75, 0.45, 0.60


def _any(themes: Column, names: tuple[str, ...]) -> Column:
    return F.arrays_overlap(F.coalesce(themes, F.array().cast("array<string>")), F.array(*map(F.lit, names)))


def _hits(themes: Column, names: tuple[str, ...]) -> Column:
    return F.size(F.filter(F.coalesce(themes, F.array().cast("array<string>")), lambda t: F.upper(t).isin(*names)))


def post_measures(kind: str, cap: int = 10, clipped: bool = True) -> dict[str, Column]:
    """Aggregates of posts with sentiment (0 to 1), urgency, source_weight, duplicate_key, risks and themes (arrays).

    A mood outside 0 to 1 weighs in as the nearer bound, or without ``clipped`` as it is.
    """
    n = F.count(F.lit(1))
    weight, mood, haste = clip(F.coalesce("source_weight", F.lit(0.5)), 0, 2), F.coalesce("sentiment", F.lit(0.5)), clip(F.coalesce("urgency", F.lit(0.0)))
    mood = clip(mood) if clipped else mood
    key = F.nullif("duplicate_key", F.lit(""))
    copies = F.when(F.count(key) > 0, 1 - F.count_distinct(key) / F.count(key)).otherwise(0.0)
    weighted = F.coalesce(F.try_divide(F.sum(weight * (0.65 * mood + 0.35 * haste)), F.sum(weight)), F.lit(0.5))
    sentiment, urgency = F.coalesce(F.avg("sentiment"), F.lit(0.5)), F.coalesce(F.avg("urgency"), F.lit(0.0))
    risk = F.least(F.lit(1.0), F.sum(F.coalesce(F.size("risks"), F.lit(0))) / n)
    mentions = F.least(F.lit(1.0), n / float(cap))
    a = ATTENTION[kind]
    attention = clip(a[0] * mentions + a[1] * weighted + a[2] * urgency + a[3] * (1 - copies))
    share = lambda names: clip(F.sum(_hits(F.col("themes"), names)) / n)
    return {"n24": n, "mentions": mentions, "sentiment": sentiment, "urgency": urgency, "weighted": weighted, "copies": copies, "risk": risk, "attention": attention, "chips": share(CHIPS), "macro": share(POST_MACRO)}


def ticker_signals(mentions: DataFrame, asof: str, momentum: DataFrame, *, weights: dict[str, float] | None = None, cap: int = 10, clipped: bool = True) -> DataFrame:
    """One row for each ticker named in the 24 hours to ``asof``: counts, change, measures and the final signal; later posts never count.

    ``mentions`` has ticker, ts and what ``post_measures`` reads; ``momentum``
    ticker and momentum (0 to 1), a half where it is not known.
    """
    w = {**SIGNAL, **(weights or {})}
    at = F.lit(asof).cast("timestamp")
    age = (F.unix_seconds(at) - F.unix_seconds(F.col("ts").cast("timestamp"))) / 3600.0
    own = mentions.withColumn("__age", age).where((F.col("__age") >= 0) & (F.col("__age") < 48))
    before = own.where(F.col("__age") >= 24).groupBy("ticker").agg(F.count(F.lit(1)).alias("__before"))
    one = own.where(F.col("__age") < 24).groupBy("ticker").agg(F.count_if(F.col("__age") < 1).alias("n1"), *[x.alias(c) for c, x in post_measures("ticker", cap, clipped).items()])
    both = one.join(before, "ticker", "left").join(momentum.select("ticker", F.col("momentum").alias("__m")), "ticker", "left")
    change = F.when(F.col("__before") > 0, (F.col("n24") - F.col("__before")) / F.col("__before")).otherwise(F.col("n24").cast("double"))
    both = both.withColumns({"delta": clip(change, -1, 10), "momentum": F.coalesce("__m", F.lit(0.5))})
    return both.withColumn("signal", clip(sum((F.lit(x) * F.col(c) for c, x in w.items()), F.lit(0.0)))).drop("__before", "__m")


def market_days(posts: DataFrame, *, shift_hours: int = 9, cap: int = 10, clipped: bool = True) -> DataFrame:
    """One row for each local date with posts: their measures, and chip and macro shares of their themes."""
    day = F.to_date(F.col("ts") + F.expr(f"interval {shift_hours} hours"))
    return posts.groupBy(day.alias("date")).agg(*[x.alias(c) for c, x in post_measures("market", cap, clipped).items()])


def article_signals(articles: DataFrame, *, days: int = 3, feed: Column | None = None, least_sources: int = 5) -> DataFrame:
    """One row for each scope and date with an article in the last ``days`` dates: all measures of these articles.

    ``articles`` has scope, date, source, category, sentiment (0 to 1),
    urgency, risk, themes and negative (by words).  An article is negative by
    words or mood, else positive by mood; in the adjusted mood negative ones
    weigh twice, positive ones three quarters.  Days are summed before the
    dates of a scope are looked at together.
    """
    s = F.coalesce("sentiment", F.lit(0.5))
    bad = F.coalesce("negative", F.lit(False)) | (s <= NEGATIVE_FROM)
    weight = F.when(bad, NEGATIVE_WEIGHT).when(s >= POSITIVE_FROM, POSITIVE_WEIGHT).otherwise(1.0)
    x = F.coalesce(feed if feed is not None else F.lit(False), F.lit(False))
    one = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    category = F.lower("category")
    parts = {
        "n": F.lit(1.0), "s": F.col("sentiment"), "s_n": one(F.col("sentiment").isNotNull()), "u": F.col("urgency"), "u_n": one(F.col("urgency").isNotNull()), "r": F.col("risk"), "r_n": one(F.col("risk").isNotNull()),
        "chips": one(_any(F.col("themes"), CHIPS)), "macro": one(_any(F.col("themes"), NEWS_MACRO)) + one(category == "macro"), "flow": one(_any(F.col("themes"), FLOW)) + one(category == "flow"), "bad": one(bad),
        "w": weight, "sw": s * weight, "x": one(x), "x_bad": one(x & bad), "x_w": F.when(x, weight), "x_sw": F.when(x, s * weight),
    }
    own = articles.select("scope", "date", "source", *[p.alias(f"__{c}") for c, p in parts.items()])
    daily = own.groupBy("scope", "date").agg(*[F.sum(f"__{c}").alias(f"__{c}") for c in parts], F.collect_set(F.nullif(F.trim("source"), F.lit(""))).alias("__sources"))  # sources are few
    # each date that one of the last days' articles reaches
    reached = daily.select("scope", F.explode(F.transform(F.sequence(F.lit(0), F.lit(days - 1)), lambda i: F.date_add("date", i.cast("int")))).alias("date")).distinct().join(daily, ["scope", "date"], "left")
    frame = Window.partitionBy("scope").orderBy(F.datediff("date", F.lit("1970-01-01").cast("date"))).rangeBetween(-(days - 1), 0)
    t = {c: F.coalesce(F.sum(f"__{c}").over(frame), F.lit(0.0)) for c in parts}
    today = lambda c: F.coalesce(F.col(f"__{c}"), F.lit(0.0))
    mean = lambda a, b, default: F.coalesce(F.try_divide(t[a], t[b]), F.lit(default))
    n = t["n"]
    sources = F.size(F.array_distinct(F.flatten(F.collect_list("__sources").over(frame))))
    return reached.select(
        "scope", "date", today("n").alias("n_1d"), n.alias("n_3d"), mean("s", "s_n", 0.5).alias("sentiment"), mean("u", "u_n", 0.0).alias("urgency"), mean("r", "r_n", 0.0).alias("risk"), F.least(F.lit(1.0), n / 10).alias("attention"),
        *[F.least(F.lit(1.0), t[c] / n).alias(f"{c}_score") for c in ("chips", "macro", "flow")], t["bad"].alias("negative_n"), (t["bad"] / n).alias("negative_ratio"), F.least(F.lit(1.0), t["bad"] * NEGATIVE_WEIGHT / 3).alias("negative_attention"),
        mean("sw", "w", 0.5).alias("adjusted_sentiment"), F.least(F.lit(1.0), sources / float(least_sources)).alias("diversity"), today("x").alias("feed_n_1d"), t["x"].alias("feed_n_3d"), t["x_bad"].alias("feed_negative_n"),
        F.least(F.lit(1.0), t["x_bad"] * NEGATIVE_WEIGHT / 3).alias("feed_negative_attention"), mean("x_sw", "x_w", 0.5).alias("feed_adjusted_sentiment"),
    )
