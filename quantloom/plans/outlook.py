"""The outlook dataset over the canonical tables: two horizons, breadth of features and predictions, four daily feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.functions import text as T
from quantloom.functions.columns import rounded
from quantloom.operators import features, outlook

from .explain import BAD, FUNDS, REGIME_ASOF, _funds, _regimes, _words, any_word
from .features import ALL, BASE, matrix
from .market import BARS
from .primitives import SENT
from .registry import query
from .rules import REGIME

FEED = "src1"
BREADTH = ("up_share_21d", "momentum_avg", "risk_avg", "up_probability", "down_probability", "return_avg")
DAILY = ("lever_return", "fund_return", "spread", "fund_impact", "currency_return", "risk", "cash", "semiconductor_score", "futures_score", "social_sentiment", "social_risk", "social_theme", "news_count", "news_sentiment", "feed_count", "feed_count_3d", "feed_negative_3d", "feed_attention_3d", "feed_sentiment_3d")
INDEX = ("return_1d", "return_5d", "return_20d", "volatility_5d", "volatility_20d", "ma_gap_5d", "ma_gap_20d")


def _breadth(p):
    mat = matrix(p)
    own = mat.join(p.symbols.select("symbol", "market"), "symbol")
    by = lambda df, *aggs: df.groupBy("date", "market").agg(*aggs)
    seen = by(own, F.avg((F.coalesce("ret_21d", F.lit(0.0)) > 0).cast("double")).alias("up_share_21d"), F.avg("momentum_score").alias("momentum_avg"), F.avg("risk_score").alias("risk_avg"))
    pred = features.factor_baseline(mat).join(p.symbols.select("symbol", "market"), "symbol")
    prob = F.coalesce("pred_prob_top20", F.lit(0.5))
    return [seen, by(pred, F.avg(prob).alias("up_probability"), F.avg(1 - prob).alias("down_probability"), F.avg(F.coalesce("pred_return", F.lit(0.0))).alias("return_avg"))]


def _daily(p):
    days = p.prices.select("date").distinct()
    funds = _funds(p).select("date", "lever_return", "fund_return", "spread", F.col("impact").alias("fund_impact"), "currency_return")
    regime = _regimes(p, days).select("date", "risk", "cash", "semiconductor_score", "futures_score")
    unit = (F.col("sentiment") + 1) / 2
    social = p.dated_posts.groupBy(F.col("day").alias("date")).agg(
        F.try_divide(F.sum(F.col("source_weight") * unit), F.sum("source_weight")).alias("social_sentiment"), F.avg((F.col("channel") == "error").cast("double")).alias("social_risk"), F.avg((F.col("channel") == "purchase").cast("double")).alias("social_theme"),
    )
    text = F.col("text")
    news = outlook.news_feed(days, p.dated_news, on="day", sentiment=T.unit_sentiment(T.sentiment(text)), feed=F.col("source") == FEED, negative=any_word(text, BAD))
    return [funds, regime, social, news]


_ROUND = ", ".join(f"round(coalesce({c}::DOUBLE, {outlook.NEUTRAL.get(c, 0.0)}::DOUBLE) + 1e-9, 6) AS {c}" for c in (*INDEX, *BREADTH, *DAILY))
_ROLL = "(PARTITION BY benchmark ORDER BY date ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"
DATASET = f"""
u0 AS (SELECT date, benchmark AS market, benchmark, close, close / lag(close) OVER t - 1 AS return_1d, close / lag(close, 5) OVER t - 1 AS return_5d, close / lag(close, 20) OVER t - 1 AS return_20d FROM idx WINDOW t AS (PARTITION BY benchmark ORDER BY date)),
u1 AS (SELECT *, CASE WHEN count(return_1d) OVER a >= 2 THEN stddev_samp(return_1d) OVER a END AS volatility_5d, CASE WHEN count(return_1d) OVER b >= 5 THEN stddev_samp(return_1d) OVER b END AS volatility_20d, close / CASE WHEN count(close) OVER a >= 2 THEN avg(close) OVER a END - 1 AS ma_gap_5d, close / CASE WHEN count(close) OVER b >= 5 THEN avg(close) OVER b END - 1 AS ma_gap_20d
  FROM u0 WINDOW a AS {_ROLL.format(4)}, b AS {_ROLL.format(19)}),
u2 AS (SELECT *, date + CASE isodow(date) WHEN 5 THEN 7 WHEN 6 THEN 6 WHEN 7 THEN 5 ELSE 5 - isodow(date) END::INT AS friday, date + CASE isodow(date) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END::INT AS tomorrow, date = (SELECT max(date) FROM idx) AS final FROM u1),
u3 AS (SELECT *, (SELECT min(x.date) FROM idx x WHERE x.benchmark = u2.market AND x.date > u2.date) AS nx, (SELECT max(x.date) FROM idx x WHERE x.benchmark = u2.market AND x.date > u2.date AND x.date <= u2.friday) AS wk FROM u2),
u4 AS (SELECT *, 'TODAY' AS horizon, CASE WHEN final THEN tomorrow ELSE nx END AS target_date FROM u3 UNION ALL
  SELECT *, 'WEEK', CASE WHEN final THEN tomorrow + ((5 - isodow(tomorrow) + 7) % 7)::INT ELSE coalesce(wk, nx) END FROM u3),
u5 AS (SELECT u4.*, CASE WHEN NOT final THEN x.close / u4.close - 1 END AS label_return FROM u4 LEFT JOIN idx x ON x.benchmark = u4.market AND x.date = u4.target_date WHERE target_date IS NOT NULL),
v1 AS (SELECT date, market, avg((coalesce(ret_21d, 0) > 0)::INT::DOUBLE) AS up_share_21d, avg(momentum_score) AS momentum_avg, avg(risk_score) AS risk_avg FROM mat JOIN sym USING (symbol) GROUP BY date, market),
v2 AS (SELECT date, market, avg(coalesce(pred_prob_top20, 0.5)) AS up_probability, avg(1 - coalesce(pred_prob_top20, 0.5)) AS down_probability, avg(coalesce(pred_return, 0.0)) AS return_avg FROM pred JOIN sym USING (symbol) GROUP BY date, market),
v3 AS (SELECT DATE '1995-01-02' + CAST(message_id * 37 % 2500 AS INT) AS date, sum(source_weight * (sentiment + 1) / 2) / sum(source_weight) AS social_sentiment, avg((channel = 'error')::INT::DOUBLE) AS social_risk, avg((channel = 'purchase')::INT::DOUBLE) AS social_theme FROM posts GROUP BY 1),
v4 AS (SELECT *, s <= 0.45 OR bad AS neg FROM (SELECT DATE '1995-01-02' + CAST(article_id * 37 % 2500 AS INT) AS day, ({SENT} + 1) / 2 AS s, {_words(BAD)} AS bad, source = '{FEED}' AS x FROM news)),
v5 AS (SELECT rd.date, count(*) FILTER (v4.day = rd.date) AS news_count, avg(s) FILTER (v4.day = rd.date) AS news_sentiment, count(*) FILTER (v4.day = rd.date AND x) AS feed_count, count(*) FILTER (x) AS feed_count_3d, count(*) FILTER (x AND neg) AS feed_negative_3d,
  sum(s * CASE WHEN neg THEN 2.0::DOUBLE WHEN s >= 0.6 THEN 0.75::DOUBLE ELSE 1.0::DOUBLE END) FILTER (x) / nullif(sum(CASE WHEN neg THEN 2.0::DOUBLE WHEN s >= 0.6 THEN 0.75::DOUBLE ELSE 1.0::DOUBLE END) FILTER (x), 0) AS feed_sentiment_3d FROM rd LEFT JOIN v4 ON v4.day <= rd.date AND v4.day > rd.date - 3 GROUP BY rd.date),
v6 AS (SELECT u5.date, u5.market, u5.close, horizon, target_date, label_return, {", ".join(f"u5.{c}" for c in INDEX)}, v1.* EXCLUDE (date, market), v2.* EXCLUDE (date, market), fl.lever_return, fl.fund_return, fl.spread, fl.impact AS fund_impact, fl.currency_return,
  rr.risk, CASE WHEN rr.risk >= 70 THEN 0.5 WHEN rr.risk >= 45 THEN 0.3 WHEN rr.risk >= 20 THEN 0.15 WHEN rr.risk IS NOT NULL THEN 0.05 END AS cash, rr.semiconductor_score, rr.futures_score, v3.* EXCLUDE (date), v5.* EXCLUDE (date), least(1.0, feed_negative_3d * 2.0 / 3) AS feed_attention_3d
  FROM u5 LEFT JOIN v1 ON v1.date = u5.date AND v1.market = u5.market LEFT JOIN v2 ON v2.date = u5.date AND v2.market = u5.market LEFT JOIN fl ON fl.date = u5.date LEFT JOIN rr ON rr.date = u5.date LEFT JOIN v3 ON v3.date = u5.date LEFT JOIN v5 ON v5.date = u5.date)
"""


@query("o02_outlook_rows", f"SELECT date, market, close, horizon, target_date, round(label_return + 1e-9, 6) AS label_return, {_ROUND} FROM v6", *ALL, BASE, BARS, FUNDS, REGIME, REGIME_ASOF, DATASET)
def o02(p):
    index = p.index.select("date", F.col("benchmark").alias("market"), "close")
    own = outlook.outlook_rows(index, _breadth(p), _daily(p))
    return own.select("date", "market", "close", "horizon", "target_date", rounded(F.col("label_return")).alias("label_return"), *[rounded(F.col(c)).alias(c) for c in (*INDEX, *BREADTH, *DAILY)])
