"""Why a symbol or a market moved: rules over what was known that day, each with its evidence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.text import has
from quantloom.operators.asof import Trailing, carry

THRESHOLD = 0.02


@dataclass(frozen=True)
class Rule:
    """A reason: how much it weighs, when it holds (SQL over the context), and the context's columns that show it."""

    score: float
    name: str
    kind: str
    when: str
    shows: tuple[str, ...]


# Scores, thresholds and order of the rules.
RULES = (
    Rule(0.76, "sector_abroad_weak", "sector", "down and sector_return <= -0.015", ("sector_return", "sector_impact")),
    Rule(0.62, "sector_abroad_strong", "sector", "up and (sector_return >= 0.015 or sector_impact >= 0.65)", ("sector_return", "sector_impact")),
    Rule(0.80, "funds_abroad_weak", "fund", "down and (lever_return <= -0.03 or fund_return <= -0.01)", ("lever_return", "fund_return")),
    Rule(0.62, "funds_abroad_friendly", "fund", "up and (fund_impact >= 0.70 or fund_return >= 0.01)", ("fund_impact", "fund_return")),
    Rule(0.92, "tech_abroad_falls", "tech", "down and (is_chip or is_market) and (tech_low <= -0.015 or macro_chip)", ("tech_low",)),
    Rule(0.68, "posts_alarm", "posts", "down and posts_bad", ("posts_n",)),
    Rule(0.58, "posts_cheer", "posts", "up and posts_good", ("posts_n",)),
    Rule(0.82, "tech_abroad_rises", "tech", "up and is_chip and tech_high >= 0.015", ("tech_high",)),
    Rule(0.86, "foreign_selling", "flow", "down and (foreign_1 < 0 or foreign_5 < 0)", ("foreign_1", "foreign_5")),
    Rule(0.82, "foreign_buying", "flow", "up and (foreign_1 > 0 or foreign_5 > 0)", ("foreign_1", "foreign_5")),
    Rule(0.74, "institutions_selling", "flow", "down and (institution_1 < 0 or pension_5 < 0)", ("institution_1", "pension_5")),
    Rule(0.72, "institutions_buying", "flow", "up and (institution_1 > 0 or pension_5 > 0)", ("institution_1", "pension_5")),
    Rule(0.70, "regime_risk", "regime", "down and (risk >= 45 or n_signals > 0)", ("risk", "n_signals")),
    Rule(0.58, "regime_risk_on", "regime", "up and regime = 'risk_on'", ("risk",)),
    Rule(0.66, "currency_weak", "currency", "down and (currency_return >= 0.004 or macro_currency or signal_currency)", ("currency_return",)),
    Rule(0.62, "leverage_in_news", "structure", "down and macro_leverage", ("macro_n",)),
    Rule(0.60, "profit_taking", "momentum", "down and ret_21d >= 0.10", ("ret_21d",)),
    Rule(0.55, "rebound", "momentum", "up and ret_21d <= -0.08", ("ret_21d",)),
    Rule(0.64, "own_news_bad", "news", "down and news_n > 0 and (news_sentiment < 0.45 or news_bad)", ("news_n", "news_sentiment")),
    Rule(0.64, "own_news_good", "news", "up and news_n > 0 and (news_sentiment > 0.55 or news_good)", ("news_n", "news_sentiment")),
    Rule(0.58, "selling_in_news", "macro", "down and macro_selling", ("macro_n",)),
    Rule(0.50, "risk_appetite_in_news", "macro", "up and macro_appetite", ("macro_n",)),
)

#: The context that the rules read, with the type of a column that is missing.
CONTEXT = {
    **dict.fromkeys(("sector_return", "sector_impact", "lever_return", "fund_return", "fund_impact", "tech_low", "tech_high", "foreign_1", "foreign_5", "institution_1", "pension_5", "risk", "currency_return", "ret_21d", "news_sentiment"), "double"),
    **dict.fromkeys(("n_signals", "posts_n", "macro_n", "news_n", "up_count", "down_count"), "long"),
    **dict.fromkeys(("is_chip", "macro_chip", "macro_currency", "signal_currency", "macro_leverage", "macro_selling", "macro_appetite", "posts_bad", "posts_good", "news_bad", "news_good"), "boolean"),
    "regime": "string",
}


def tail_sums(flows: DataFrame, columns: list[str], windows: tuple[int, ...] = (1, 5, 20), days: int = 45, *, key: str = "symbol") -> DataFrame:
    """Sums of the last rows of each key, as far as they are at most ``days`` days old; NULL without a value.

    Both frames end at the row, so their common part is the shorter one.
    """
    order = Window.partitionBy(key).orderBy(F.datediff("date", F.lit("1970-01-01").cast("date")))
    recent = order.rangeBetween(-days, 0)
    held = F.count(F.lit(1)).over(recent)
    out = {}
    for c in columns:
        for n in windows:
            out[f"{c}_{n}"] = F.when(held <= n, F.sum(c).over(recent)).otherwise(F.sum(c).over(order.rowsBetween(-(n - 1), 0)))
    return flows.select(key, "date", *[x.alias(name) for name, x in out.items()])


def keyword_hits(days: DataFrame, articles: DataFrame, groups: dict[str, Column], *, on: str, order: list[Column], window: int = 14, most: int = 40) -> DataFrame:
    """For each date: n, the articles of the last ``window`` days and the date, ``most`` at most, and whether one of these is in each group.

    The newest articles count, of one day by ``order``.  Each day keeps the
    first place at which a group occurs; that place and the articles of the
    days after it say whether it is among the newest ones.  So articles are
    reduced by day before days are looked at together.
    """
    place = F.row_number().over(Window.partitionBy(on).orderBy(*order))
    placed = articles.select(F.col(on).alias("date"), place.alias("__r"), *[g.alias(f"__{name}") for name, g in groups.items()])
    daily = placed.groupBy("date").agg(F.count(F.lit(1)).alias("__n"), *[F.min(F.when(F.col(f"__{name}"), F.col("__r"))).alias(f"__{name}") for name in groups])
    time = Window.orderBy(F.datediff("date", F.lit("1970-01-01").cast("date")))  # a row for each day
    all_days = days.select("date").unionByName(daily.select("date")).distinct().join(daily, "date", "left")
    upto = F.sum(F.coalesce("__n", F.lit(0))).over(time.rowsBetween(Window.unboundedPreceding, 0))
    counted = all_days.withColumn("__upto", upto)
    frame = time.rangeBetween(-window, 0)
    near = lambda name: F.coalesce(F.min(F.col(f"__{name}") - F.col("__upto")).over(frame) <= most - F.col("__upto"), F.lit(False))
    n = F.least(F.lit(most).cast("long"), F.coalesce(F.sum("__n").over(frame), F.lit(0)))
    return counted.select("date", n.alias("n"), *[near(name).alias(name) for name in groups]).join(days.select("date").distinct(), "date", "left_semi")


def any_word(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | has(text, w)
    return out


def own_news(rows: DataFrame, articles: DataFrame, *, on: str, sentiment: Column, bad: Column, good: Column, window: int = 14) -> DataFrame:
    """``rows`` with news_n, news_sentiment (mean, 0 to 1), news_bad and news_good of their symbol's articles of the last days."""
    daily = articles.select("symbol", on, sentiment.alias("s"), bad.cast("int").alias("bad"), good.cast("int").alias("good"))
    aggs = {"news_n": (F.count, "bad"), "news_sentiment": (F.avg, "s"), "__bad": (F.max, "bad"), "__good": (F.max, "good")}
    own = carry(rows, key="symbol", on="date", trailing={"news": Trailing(daily, on, window + 1, aggs)})
    flag = lambda c: F.coalesce(F.col(c) == 1, F.lit(False))
    return own.withColumns({"news_bad": flag("__bad"), "news_good": flag("__good")}).drop("__bad", "__good")


def explained(rows: DataFrame, *, threshold: float = THRESHOLD, most: int = 5, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``rows`` with direction, triggered, primary, n_reasons, reasons, evidence and confidence.

    ``rows`` have scope (symbol or market), move, for markets ``index_return``,
    and whatever of CONTEXT is known; a missing column is NULL and a condition
    over NULL does not hold.  A market is triggered by a fall of its index, a
    symbol by a move either way.  ``evidence`` holds the move, for markets its
    breadth and index, and the values behind the ``most`` strongest reasons;
    equal scores keep the order of the rules.  ``reasons`` names all of them.
    """
    context = {c: (F.col(c) if c in rows.columns else F.lit(None)).cast(t) for c, t in CONTEXT.items()}
    move = F.col("move")
    market = F.col("scope") == "market"
    index = F.col("index_return") if "index_return" in rows.columns else F.lit(None).cast("double")
    direction = F.when(move.isNull(), "UNKNOWN").when(move >= THRESHOLD, "UP").when(move <= -THRESHOLD, "DOWN").otherwise("FLAT")
    triggered = F.when(market & index.isNotNull(), index <= -threshold).otherwise(F.coalesce(F.abs(move) >= threshold, F.lit(False)))
    flat = rows.select("*", *[x.alias(c) for c, x in context.items() if c not in rows.columns]).withColumns({"direction": direction, "triggered": triggered})
    flat = flat.withColumns({"down": F.col("direction") == "DOWN", "up": F.col("direction") == "UP", "is_market": market})

    value = lambda c: F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value"))
    note = lambda kind, *cs: F.struct(F.lit(kind).alias("kind"), F.array(*map(value, cs)).alias("shows"))
    made = [F.when(F.expr(r.when), F.struct(F.lit(-r.score).alias("weight"), F.lit(i).alias("place"), F.lit(r.name).alias("reason"), note(r.kind, *r.shows).alias("note"))) for i, r in enumerate(rules)]
    found = F.array_sort(F.filter(F.array(*made), lambda x: x.isNotNull()))
    flat = flat.withColumn("__found", F.filter(found, lambda x: F.col("triggered")))
    n = F.size("__found")
    calm = F.when(move.isNull(), "no_price").when(market & index.isNotNull(), "no_market_shock").otherwise("no_move")
    primary = F.when(~F.col("triggered"), calm).when(n == 0, "price_alone").otherwise(F.get("__found", F.lit(0))["reason"])
    confidence = F.when(~F.col("triggered"), F.when(move.isNull(), 0.1).otherwise(0.25)).when(n == 0, 0.35).otherwise(F.least(F.lit(0.95), 0.42 + 0.12 * n + F.least(F.abs(move), F.lit(0.08))))
    base = F.array(note("price", "move"))
    wide = F.array(note("price", "move"), note("breadth", "up_count", "down_count"))
    shown = F.concat(F.when(market, wide).otherwise(base), F.transform(F.slice("__found", 1, most), lambda x: x["note"]))
    out = flat.withColumns({"primary": primary, "n_reasons": n, "reasons": F.transform("__found", lambda x: x["reason"]), "evidence": shown, "confidence": confidence})
    return out.select(*rows.columns, "direction", "triggered", "primary", "n_reasons", "reasons", "evidence", "confidence")
