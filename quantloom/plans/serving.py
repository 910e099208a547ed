"""Queries over models, serving views, loaders and the remaining signals."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quantloom.functions import text as T
from quantloom.functions.columns import clip, rounded, rule_array
from quantloom.functions.windows import first_rank
from quantloom.operators import decisions as D
from quantloom.operators import features, market, models

from .decisions import CTES, RES, labelled, scored
from .features import ALL, BASE, FEAT, LABELS, _rank, label_frame, matrix
from .market import BARS, BREADTH, LINK, MOVES
from .primitives import SENT, _hits
from .registry import query


def _latest(df, col="date"):
    return df.join(F.broadcast(df.agg(F.max(col).alias(col))), col)  # one row


@query("s07_modelling_set", "SELECT date, symbol, pred_prob_top20, excess_return, is_top20pct FROM pred JOIN lab USING (date, symbol)", *ALL, BASE, LABELS)
def s07(p):
    return features.factor_baseline(matrix(p)).join(label_frame(p), ["date", "symbol"]).select("date", "symbol", "pred_prob_top20", "excess_return", "is_top20pct")


@query("s08_prediction_set", "SELECT date, symbol, coalesce(name, symbol) AS name, pred_return, future_return FROM pred LEFT JOIN lab USING (date, symbol) LEFT JOIN sym USING (symbol)", *ALL, BASE, LABELS)
def s08(p):
    own = features.factor_baseline(matrix(p)).join(label_frame(p).select("date", "symbol", "future_return"), ["date", "symbol"], "left").join(p.symbols, "symbol", "left")
    return own.select("date", "symbol", F.coalesce("name", "symbol").alias("name"), "pred_return", "future_return")


@query("s09_latest_features", "SELECT date, symbol, momentum_score, risk_score FROM feat WHERE date = (SELECT max(date) FROM feat)", FEAT)
def s09(p):
    return _latest(features.price_features(p.prices)).select("date", "symbol", "momentum_score", "risk_score")


@query("s11_report_ids", "SELECT o_orderkey, sha1(concat_ws('|', o_orderstatus, CAST(o_custkey AS VARCHAR), substr(o_orderpriority, 1, 1))) AS report_id, TRY_CAST(regexp_replace(o_orderpriority, '[^0-9]', '', 'g') AS INT) AS rating FROM orders")
def s11(p):
    own = p.table("orders")
    return own.select("o_orderkey", F.sha1(F.concat_ws("|", "o_orderstatus", F.col("o_custkey").cast("string"), F.substring("o_orderpriority", 1, 1)).cast("binary")).alias("report_id"), F.regexp_replace("o_orderpriority", "[^0-9]", "").try_cast("int").alias("rating"))


@query("s16_feed_articles", "SELECT source, substr(sha256(lower(url)), 1, 16) AS article_id, min(page_id) AS page_id FROM (SELECT page_id, url, regexp_extract(url, '^(https?)', 1) AS source FROM pages) GROUP BY source, lower(url)")
def s16(p):
    own = p.table("pages").select("page_id", "url", F.regexp_extract("url", "^(https?)", 1).alias("source"), F.lower("url").alias("link"))
    return own.groupBy("source", "link").agg(F.min("page_id").alias("page_id")).select("source", F.substring(F.sha2(F.col("link").cast("binary"), 256), 1, 16).alias("article_id"), "page_id")


@query("s17_stripped_titles", "SELECT page_id, trim(regexp_replace(regexp_extract(html, '<h1>(.*?)</h1>', 1), '<[^>]+>', '', 'g')) AS title FROM pages")
def s17(p):
    return p.table("pages").select("page_id", F.trim(F.regexp_replace(F.regexp_extract("html", "<h1>(.*?)</h1>", 1), "<[^>]+>", "")).alias("title"))


@query("s24_failures", "SELECT 'convert' AS step, 'events' AS source, count(*) AS n FROM events WHERE TRY_CAST(event_type AS DOUBLE) IS NULL AND event_type = 'error'")
def s24(p):
    from quantloom.sources.tables import failure_rows

    bad = F.col("event_type").try_cast("double").isNull() & (F.col("event_type") == "error")
    return failure_rows(p.table("events"), "convert", "events", bad).groupBy("step", "source").agg(F.count(F.lit(1)).alias("n"))


@query("f19_attach_daily", "SELECT px.date, px.symbol, coalesce(impact, 0.5) AS impact FROM px JOIN sym USING (symbol) LEFT JOIN link ON link.date = px.date AND benchmark = market", BARS, LINK)
def f19(p):
    link = market.overseas_link(p.index, market.daily_bars(p.world).where("symbol = 'R0'")).select("date", F.col("benchmark").alias("market"), "impact")
    own = p.prices.join(p.symbols, "symbol").join(link, ["date", "market"], "left")
    return own.select("date", "symbol", F.coalesce("impact", F.lit(0.5)).alias("impact"))


@query("f20_attach_news", "SELECT s.pub_date, s.symbol, coalesce(a.u, b.u, 0.5) AS score FROM (SELECT DISTINCT pub_date, lpad(CAST(k AS VARCHAR), 6, '0') AS symbol FROM news, range(0, 25) r(k)) s LEFT JOIN (SELECT pub_date, symbol, round(avg((" + SENT + " + 1) / 2) + 1e-9, 6) AS u FROM news GROUP BY ALL) a USING (pub_date, symbol) LEFT JOIN (SELECT pub_date, round(avg((" + SENT + " + 1) / 2) + 1e-9, 6) AS u FROM news GROUP BY ALL) b USING (pub_date)")
def f20(p):
    own = p.news.select("pub_date", "symbol", ((T.sentiment(F.col("text")) + 1) / 2).alias("u"))
    grid = own.select("pub_date").distinct().select("pub_date", F.explode(F.sequence(F.lit(0), F.lit(24))).alias("k")).select("pub_date", F.lpad(F.col("k").cast("string"), 6, "0").alias("symbol"))
    stock, day = own.groupBy("pub_date", "symbol").agg(rounded(F.avg("u")).alias("a")), own.groupBy("pub_date").agg(rounded(F.avg("u")).alias("b"))
    return grid.join(stock, ["pub_date", "symbol"], "left").join(day, "pub_date", "left").select("pub_date", "symbol", F.coalesce("a", "b", F.lit(0.5)).alias("score"))


@query("g01_mentions", "SELECT message_id, channel, ticker, sha256(channel || '|' || message_id || '|' || ticker) AS mention_id FROM posts")
def g01(p):
    return p.posts.select("message_id", "channel", "ticker", F.sha2(F.concat_ws("|", "channel", F.col("message_id").cast("string"), "ticker").cast("binary"), 256).alias("mention_id"))


@query("g04_short_momentum", f"SELECT symbol, round({_rank('m', 'm IS NULL AND false')} + 1e-9, 6) AS score FROM (SELECT symbol, max(close) FILTER (b = 1) / coalesce(max(close) FILTER (b = 6), max(close) FILTER (b = n)) - 1 AS m FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS b, count(*) OVER (PARTITION BY symbol) AS n FROM px) GROUP BY symbol)")
def g04(p):
    from quantloom.functions.windows import pct_rank

    own = p.prices.withColumn("b", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("symbol")))
    at = lambda c: F.max(F.when(c, F.col("close")))
    own = own.groupBy("symbol").agg((at(F.col("b") == 1) / F.coalesce(at(F.col("b") == 6), at(F.col("b") == F.col("n"))) - 1).alias("m"))
    return own.select("symbol", rounded(pct_rank(F.col("m"))).alias("score"))


@query("g05_market_social_days", "SELECT CAST(ts + INTERVAL 9 HOUR AS DATE) AS local_date, count(*) AS n, round(sum(source_weight * sentiment) / sum(source_weight) + 1e-9, 6) AS sentiment, round(avg(urgency) + 1e-9, 6) AS urgency FROM posts GROUP BY 1")
def g05(p):
    own = p.posts.withColumn("local_date", F.to_date(F.col("ts") + F.expr("interval 9 hours")))
    return own.groupBy("local_date").agg(F.count(F.lit(1)).alias("n"), rounded(F.sum(F.col("source_weight") * F.col("sentiment")) / F.sum("source_weight")).alias("sentiment"), rounded(F.avg("urgency")).alias("urgency"))


@query("g07_article_flags", f"SELECT doc_id, (len({_hits(T.RISKS)}) > 0 OR u <= 0.45) AS negative, NOT (len({_hits(T.RISKS)}) > 0 OR u <= 0.45) AND u >= 0.6 AS positive FROM (SELECT doc_id, text, ({SENT} + 1) / 2 AS u FROM documents)")
def g07(p):
    u = (T.sentiment(F.col("text")) + 1) / 2
    negative = (F.size(T.hits(F.col("text"), T.RISKS)) > 0) | (u <= 0.45)
    return p.table("documents").select("doc_id", negative.alias("negative"), (~negative & (u >= 0.6)).alias("positive"))


@query("g11_overlay_gate", "SELECT benchmark, n, CASE WHEN n >= 100 AND mean_agreement >= 0.45 AND abs(mean_corr) >= 0.02 THEN 0.15::DOUBLE WHEN n >= 100 AND mean_agreement >= 0.45 THEN 0.05::DOUBLE ELSE 0.0 END AS weight FROM (SELECT benchmark, count(corr) AS n, avg(agreement) AS mean_agreement, avg(corr) AS mean_corr FROM link GROUP BY benchmark)", BARS, LINK)
def g11(p):
    own = market.overseas_link(p.index, market.daily_bars(p.world).where("symbol = 'R0'"))
    own = own.groupBy("benchmark").agg(F.count("corr").alias("n"), F.avg("agreement").alias("a"), F.avg("corr").alias("c"))
    base = (F.col("n") >= 100) & (F.col("a") >= 0.45)
    return own.select("benchmark", "n", F.when(base & (F.abs("c") >= 0.02), 0.15).when(base, 0.05).otherwise(0.0).alias("weight"))


_NEU = ["momentum_score", "supply_demand_score"]
_WO = " + ".join(f"{w}::DOUBLE * greatest(0.0, least(1.0, {c}))" for c, w in D.SCORE.items() if c not in _NEU)


@query("g16_ablation", f"SELECT date, symbol, delta, moved, CASE WHEN abs(delta) >= 0.05 OR moved >= 5 THEN 'high' WHEN abs(delta) >= 0.02 OR moved >= 2 THEN 'medium' ELSE 'low' END AS level FROM (SELECT date, symbol, round(final_score - wo + 1e-9, 6) AS delta, abs(row_number() OVER (PARTITION BY date ORDER BY final_score DESC, symbol) - row_number() OVER (PARTITION BY date ORDER BY wo DESC, symbol)) AS moved FROM (SELECT *, round({_WO} + 0.15::DOUBLE + 1e-9, 6) AS wo FROM sc))", *CTES)
def g16(p):
    return models.ablation(scored(p), D.SCORE, _NEU)


@query("m04_prediction_scores", f"SELECT date, symbol, round(greatest(a, 1 - a) + 1e-9, 6) AS confidence, round(greatest(0.0, least(1.0, 0.6::DOUBLE * a + 0.4::DOUBLE * k)) + 1e-9, 6) AS long_score, round(greatest(0.0, least(1.0, 0.6::DOUBLE * (1 - a) + 0.4::DOUBLE * (1 - k))) + 1e-9, 6) AS short_score FROM (SELECT date, symbol, pred_prob_top20 AS a, {_rank('pred_return')} AS k FROM pred)", *ALL, BASE)
def m04(p):
    own = features.factor_baseline(matrix(p)).select("date", "symbol", "pred_return", F.col("pred_prob_top20").alias("prob_top"), (1 - F.col("pred_prob_top20")).alias("prob_bottom"))
    return models.prediction_scores(own)


@query("m05_evaluation", f"""SELECT n, rank_ic, rmse, precision FROM (SELECT count(*) AS n, round(corr(a, b) + 1e-9, 5) AS rank_ic, round(sqrt(avg((pred_return - excess_return) ** 2)) + 1e-9, 5) AS rmse FROM (SELECT *, {_rank('pred_prob_top20', 'excess_return IS NULL')} AS a, {_rank('excess_return', 'excess_return IS NULL')} AS b FROM ev)),
(SELECT round(avg(p) + 1e-9, 6) AS precision FROM (SELECT date, avg(is_top20pct::INT::DOUBLE) AS p FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY pred_prob_top20 DESC, symbol) AS r FROM ev) WHERE r <= 5 GROUP BY date))""", *ALL, BASE, LABELS, "ev AS (SELECT date, symbol, pred_prob_top20, pred_return, excess_return, is_top20pct FROM pred JOIN lab USING (date, symbol) WHERE excess_return IS NOT NULL)")
def m05(p):
    own = features.factor_baseline(matrix(p)).join(label_frame(p).select("date", "symbol", "excess_return", "is_top20pct"), ["date", "symbol"])
    return models.evaluate(own, 5)


@query("m08_ranked_predictions", "SELECT date, symbol, row_number() OVER (PARTITION BY date ORDER BY pred_prob_top20 DESC, symbol) AS rank FROM pred", *ALL, BASE)
def m08(p):
    return features.factor_baseline(matrix(p)).select("date", "symbol", first_rank(F.col("pred_prob_top20"), "date").cast("long").alias("rank"))


_TREE = ["ret_21d", "ma_gap_20d", "volatility_20d", "rsi_14"]


def _training(p):
    keep = ["date", "symbol", "excess_return", "is_top20pct", "is_bottom20pct"]
    return p.keep("training", lambda: features.time_features(p.prices).select("date", "symbol", *_TREE).join(label_frame(p).select(*keep), ["date", "symbol"]))


_WALK = {"step": 21, "least_dates": 504, "embargo": 21, "least_train_dates": 252, "least_train_rows": 1000}


@query("m01_m03_walk_forward")
def m01(p):
    return models.walk_forward(_training(p), _TREE, **_WALK)


@query("m02_walk_forward_metrics")
def m02(p):
    own = _training(p)
    return models.window_metrics(models.walk_forward_windows(own, _TREE, **_WALK), own, 5)


@query("m01_validation_metrics")
def m01_valid(p):
    own = _training(p)
    _, held = models.train_model(own, _TREE)
    truth = own.select("date", "symbol", "excess_return", "is_top20pct")
    return models.evaluate(held.withColumnRenamed("prob_top", "pred_prob_top20").join(truth, ["date", "symbol"]), 5)


_CENT = [[(-1.0) ** (i * j % 3) * 0.1 for j in range(64)] for i in range(4)]
_DIST = ", ".join("list_sum([(embedding[j]::DOUBLE - [" + ", ".join(map(str, c)) + "][j]::DOUBLE) ** 2 for j in range(1, 65)])" for c in _CENT)


@query("m15_fixed_centroids", f"SELECT vec_id, (list_position(d, list_min(d)) - 1)::INT AS cluster, round(sqrt(list_min(d)) + 1e-6, 4) AS distance FROM (SELECT vec_id, [{_DIST}] AS d FROM embeddings)")
def m15(p):
    return models.nearest_centroid(p.table("embeddings"), _CENT).select("vec_id", "cluster", F.round(F.col("distance") + 1e-6, 4).alias("distance"))


@query("m15_kmeans")
def m15k(p):
    return models.clusters(_latest(features.time_features(p.prices)), _TREE, k=3).select("symbol", "cluster")


_CLUSTER = ["momentum_score", "volatility_60d", "size_score", "liquidity_score", "ret_21d", "ret_126d"]


@query("m15_stock_clusters")
def m15_best(p):
    """Clusters of the latest date's symbols, the best of 20 starts, with labels by their centroids."""
    own = features.price_features(p.prices).join(features.market_features(p.metrics).select("date", "symbol", "size_score"), ["date", "symbol"], "left")
    rows, found = models.best_clusters(_latest(own).select("symbol", *_CLUSTER), _CLUSTER)
    held = [(r.cluster, r.centroid) for r in found.orderBy("cluster").collect()]  # a row for each cluster
    names = models.cluster_labels({c: [v[i] for _, v in held] for i, c in enumerate(_CLUSTER)}) if held else []
    table = p.spark.createDataFrame([(c, n) for (c, _), n in zip(held, names, strict=True)], "cluster int, label string")
    return rows.join(F.broadcast(table), "cluster").join(found.select("cluster", "members"), "cluster").select("symbol", "cluster", "label", "members", rounded(F.col("distance")).alias("distance"))


@query("o04_trailing_news", f"SELECT d.pub_date AS asof, count(n.article_id) AS n, round(avg(u) + 1e-9, 6) AS sentiment FROM (SELECT DISTINCT pub_date FROM news) d LEFT JOIN (SELECT article_id, pub_date, ({SENT} + 1) / 2 AS u FROM news) n ON n.pub_date <= d.pub_date AND n.pub_date > d.pub_date - 3 GROUP BY 1")
def o04(p):
    from quantloom.operators.asof import trailing_join

    own = p.news.select(F.lit("all").alias("k"), "pub_date", "article_id", ((T.sentiment(F.col("text")) + 1) / 2).alias("u"))
    asof = own.select("k", F.col("pub_date").alias("asof")).distinct()
    return trailing_join(asof, own, key="k", left_on="asof", right_on="pub_date", days=3, aggs=[F.count("article_id").alias("n"), rounded(F.avg("u")).alias("sentiment")]).drop("k")


@query("o08_exposure_range", "SELECT date, market, round(greatest(0.0, least(1.0, 0.5 + return_5d)) + 1e-9, 6) AS centre, round(volatility_20d * 1.25::DOUBLE + 1e-9, 6) AS width FROM od WHERE return_5d IS NOT NULL", BREADTH)
def o08(p):
    own = market.outlook_dataset(p.index, market.breadth(p.prices, p.symbols)).where("return_5d is not null")
    return own.select("date", "market", rounded(clip(0.5 + F.col("return_5d"))).alias("centre"), rounded(F.col("volatility_20d") * 1.25).alias("width"))


@query("x02_tail_sums", "SELECT * FROM tl", MOVES)
def x02(p):
    own = p.flows.withColumn("b", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))).where("b <= 20")
    return own.groupBy("symbol").agg(*[rounded(F.sum(f"{k}_net_value"), 2).alias(f"{k}_20") for k in ("foreign", "retail")])


@query("x03_index_trigger", "SELECT benchmark, date, round(r + 1e-9, 6) AS move, coalesce(r <= -0.02, false) AS triggered FROM (SELECT *, close / lag(close) OVER (PARTITION BY benchmark ORDER BY date) - 1 AS r, row_number() OVER (PARTITION BY benchmark ORDER BY date DESC) AS b FROM idx) WHERE b = 1")
def x03(p):
    spec = Window.partitionBy("benchmark")
    own = p.index.withColumn("r", F.col("close") / F.lag("close").over(spec.orderBy("date")) - 1).withColumn("b", F.row_number().over(spec.orderBy(F.desc("date")))).where("b = 1")
    return own.select("benchmark", "date", rounded(F.col("r")).alias("move"), F.coalesce(F.col("r") <= -0.02, F.lit(False)).alias("triggered"))


@query("x08_data_status", "SELECT source, n, CASE WHEN n = 0 THEN 'not_collected' WHEN n < 1000 THEN 'partial_ready' ELSE 'ready' END AS status FROM (SELECT 'prices' AS source, count(*) AS n FROM px UNION ALL SELECT 'reports', count(*) FROM rep UNION ALL SELECT 'regions', count(*) FROM region)")
def x08(p):
    own = None
    for name, df in (("prices", p.prices), ("reports", p.reports), ("regions", p.table("region"))):
        part = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("source"), "n")
        own = part if own is None else own.unionByName(part)
    return own.select("source", "n", F.when(F.col("n") == 0, "not_collected").when(F.col("n") < 1000, "partial_ready").otherwise("ready").alias("status"))


@query("d02_latest_rows", "SELECT symbol, name, final_score, future_return, pred_return FROM sc JOIN sym USING (symbol) LEFT JOIN lab USING (date, symbol) WHERE date = (SELECT max(date) FROM sc)", *CTES)
def d02(p):
    own = _latest(scored(p)).join(p.symbols, "symbol").join(label_frame(p).select("date", "symbol", "future_return"), ["date", "symbol"], "left")
    return own.select("symbol", "name", "final_score", "future_return", "pred_return")


@query("d03_universe_view", "SELECT symbol, name, market, close, market_cap, foreign_net_value FROM sym LEFT JOIN (SELECT symbol, arg_max(close, date) AS close FROM px GROUP BY symbol) USING (symbol) LEFT JOIN (SELECT symbol, arg_max(market_cap, date) AS market_cap FROM met GROUP BY symbol) USING (symbol) LEFT JOIN (SELECT symbol, arg_max(foreign_net_value, date) AS foreign_net_value FROM flow GROUP BY symbol) USING (symbol)")
def d03(p):
    own = p.symbols
    for df, c in ((p.prices, "close"), (p.metrics, "market_cap"), (p.flows, "foreign_net_value")):
        own = own.join(df.groupBy("symbol").agg(F.max_by(c, "date").alias(c)), "symbol", "left")
    return own.select("symbol", "name", "market", "close", "market_cap", "foreign_net_value")


@query("d05_position_summary", "SELECT sector, count(*) AS n, round(avg(final_score) + 1e-9, 6) AS mean_score, round(max(final_score) + 1e-9, 6) AS best FROM sc JOIN sym USING (symbol) WHERE date = (SELECT max(date) FROM sc) GROUP BY sector", *CTES)
def d05(p):
    own = _latest(scored(p)).join(p.symbols.select("symbol", "sector"), "symbol")
    return own.groupBy("sector").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("final_score")).alias("mean_score"), rounded(F.max("final_score")).alias("best"))


@query("d06_report_list", "SELECT report_id, report_date, symbol, broker, target FROM rep ORDER BY report_date DESC, report_id DESC LIMIT 20")
def d06(p):
    return p.reports.select("report_id", "report_date", "symbol", "broker", "target").orderBy(F.desc("report_date"), F.desc("report_id")).limit(20)


@query("d07_backtest_by_sector", "SELECT sector, count(*) AS n, round(avg(is_hit::INT::DOUBLE) + 1e-9, 6) AS hit_rate, round(avg(future_return) + 1e-9, 6) AS mean_return FROM res JOIN sym USING (symbol) WHERE rank_no <= 10 GROUP BY sector", *CTES, RES)
def d07(p):
    own = D.backtest_results(labelled(p), 30).where("rank_no <= 10").join(p.symbols.select("symbol", "sector"), "symbol")
    return own.groupBy("sector").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg(F.col("is_hit").cast("double"))).alias("hit_rate"), rounded(F.avg("future_return")).alias("mean_return"))


@query("d08_prediction_history", "SELECT date, 'production' AS model, pred_prob_top20 AS value FROM pred WHERE symbol = '000003' UNION ALL SELECT date, 'shadow', momentum_score FROM feat WHERE symbol = '000003' AND momentum_score IS NOT NULL", *ALL, BASE)
def d08(p):
    m = matrix(p)
    live = features.factor_baseline(m).where("symbol = '000003'").select("date", F.lit("production").alias("model"), F.col("pred_prob_top20").alias("value"))
    shadow = features.price_features(p.prices).where("symbol = '000003' and momentum_score is not null").select("date", F.lit("shadow").alias("model"), F.col("momentum_score").alias("value"))
    return live.unionByName(shadow)


@query("d09_chart", "SELECT date, open, high, low, close, volume FROM px WHERE symbol = '000003' ORDER BY date DESC LIMIT 260")
def d09(p):
    return p.prices.where("symbol = '000003'").select("date", "open", "high", "low", "close", "volume").orderBy(F.desc("date")).limit(260)


@query("d11_latest_markets", "SELECT symbol, trade_date, close, return_1d FROM bars JOIN (SELECT symbol, max(trade_date) AS trade_date FROM bars GROUP BY symbol) USING (symbol, trade_date)", BARS)
def d11(p):
    own = market.daily_bars(p.world).withColumn("r", F.rank().over(Window.partitionBy("symbol").orderBy(F.desc("trade_date"))))
    return own.where("r = 1").select("symbol", "trade_date", "close", "return_1d")


@query("d15_legs_by_market", "SELECT market, string_agg(symbol, ',' ORDER BY final_score DESC, symbol) AS symbols, count(*) AS n FROM sc JOIN sym USING (symbol) WHERE date = (SELECT max(date) FROM sc) GROUP BY market", *CTES)
def d15(p):
    own = _latest(scored(p)).join(p.symbols.select("symbol", "market"), "symbol")
    names = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("final_score")).alias("s"), "symbol"))), lambda x: x["symbol"])
    return own.groupBy("market").agg(F.array_join(names, ",").alias("symbols"), F.count(F.lit(1)).alias("n"))


@query("b10_side_risks", "SELECT date, symbol, array_to_string([x for x in [CASE WHEN rsi_14 >= 55 THEN 'long_overbought' END, CASE WHEN rsi_14 <= 45 THEN 'short_oversold' END, CASE WHEN trading_value_ma20 < 50000 THEN 'thin' END] if x IS NOT NULL], ',') AS risks FROM feat", FEAT)
def b10(p):
    rules = rule_array((F.col("rsi_14") >= 55, "long_overbought"), (F.col("rsi_14") <= 45, "short_oversold"), (F.col("trading_value_ma20") < 50000, "thin"))
    return features.price_features(p.prices).select("date", "symbol", F.array_join(rules, ",").alias("risks"))


@query("b03_attach_forward_returns", "SELECT px.date, px.symbol, future_return, coalesce(is_top20pct, false) AS is_top FROM px LEFT JOIN lab USING (date, symbol)", LABELS)
def b03(p):
    own = p.prices.select("date", "symbol").join(label_frame(p).select("date", "symbol", "future_return", "is_top20pct"), ["date", "symbol"], "left")
    return own.select("date", "symbol", "future_return", F.coalesce("is_top20pct", F.lit(False)).alias("is_top"))


@query("b14_model_gate", "SELECT hit_rate >= 0.5 AND mean_return > 0 AS accepted, CASE WHEN hit_rate >= 0.5 AND mean_return > 0 THEN 0.1::DOUBLE ELSE 0.0 END AS weight, concat_ws(',', CASE WHEN n < 100 THEN 'few' END, CASE WHEN hit_rate < 0.5 THEN 'hit_rate' END, CASE WHEN mean_return <= 0 THEN 'return' END) AS reasons FROM (SELECT count(*) AS n, avg(is_hit::INT::DOUBLE) AS hit_rate, avg(future_return) AS mean_return FROM res WHERE rank_no <= 5)", *CTES, RES)
def b14(p):
    own = D.backtest_results(labelled(p), 30).where("rank_no <= 5").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("is_hit").cast("double")).alias("h"), F.avg("future_return").alias("r"))
    good = (F.col("h") >= 0.5) & (F.col("r") > 0)
    why = rule_array((F.col("n") < 100, "few"), (F.col("h") < 0.5, "hit_rate"), (F.col("r") <= 0, "return"))
    return own.select(good.alias("accepted"), F.when(good, 0.1).otherwise(0.0).alias("weight"), F.array_join(why, ",").alias("reasons"))


@query("u03_universe_validation", "SELECT market, count(*) AS n, count(*) = count(DISTINCT symbol) AS unique_symbols, count(*) = 10 AS has_ten FROM sym GROUP BY market")
def u03(p):
    one = p.symbols.groupBy("market", "symbol").agg(F.count(F.lit(1)).alias("c"))
    return one.groupBy("market").agg(F.sum("c").alias("n"), (F.max("c") == 1).alias("unique_symbols"), (F.sum("c") == 10).alias("has_ten"))


@query("u04_symbol_sync", "SELECT s_suppkey AS k, coalesce(c_name, s_name) AS name FROM supplier LEFT JOIN customer ON s_suppkey = c_custkey UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def u04(p):
    old, new = p.table("supplier").select(F.col("s_suppkey").alias("k"), "s_name"), p.table("customer").select(F.col("c_custkey").alias("k"), "c_name")
    updated = old.join(new, "k", "left").select("k", F.coalesce("c_name", "s_name").alias("name"))
    return updated.unionByName(new.join(old, "k", "left_anti").select("k", F.col("c_name").alias("name")))


@query("s10_html_cells", "SELECT page_id, (place - 1)::INT AS place, trim(regexp_replace(cell, '<[^>]+>', '', 'g')) AS cell FROM (SELECT page_id, unnest(c) AS cell, generate_subscripts(c, 1) AS place FROM (SELECT page_id, regexp_extract_all(html, '(?s)<li[^>]*>(.*?)</li>', 1) AS c FROM pages))")
def s10(p):
    from quantloom.sources.tables import html_cells

    return html_cells(p.table("pages").select("page_id", "html"), "html", "li")


@query("f21_attach_sector", "SELECT px.date, px.symbol, coalesce(r, 0.0) AS sector_return FROM px JOIN sym USING (symbol) LEFT JOIN (SELECT date, sector, round(avg(r) + 1e-9, 6) AS r FROM (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS r FROM px) JOIN sym USING (symbol) GROUP BY date, sector) s ON s.date = px.date AND s.sector = sym.sector")
def f21(p):
    from quantloom.functions.windows import change

    own = p.prices.withColumn("r", change(F.col("close"), 1)).join(p.symbols.select("symbol", "sector"), "symbol")
    mean = own.groupBy("date", "sector").agg(rounded(F.avg("r")).alias("m"))
    return own.join(mean, ["date", "sector"], "left").select("date", "symbol", F.coalesce("m", F.lit(0.0)).alias("sector_return"))


_KNOWN = ["ret_21d", "rsi_14", "volatility_60d", "overseas_impact"]
_HORIZONS = {"1M": 21, "3M": 63, "6M": 126, "12M": 252}


@query(
    "f23_horizon_columns",
    " UNION ALL ".join(
        f"SELECT symbol, '{h}' AS horizon, {len(features.columns_for(d, _KNOWN))} AS n_columns, sum({' + '.join(f'({c} IS NOT NULL)::INT' for c in features.columns_for(d, _KNOWN))})::BIGINT AS filled FROM hx GROUP BY symbol"
        for h, d in _HORIZONS.items()
    ),
    FEAT, BARS, LINK, "hx AS (SELECT feat.*, impact AS overseas_impact FROM feat LEFT JOIN (SELECT * FROM link WHERE benchmark = 'MAIN') USING (date))",
)
def f23(p):
    link = market.overseas_link(p.index, market.daily_bars(p.world).where("symbol = 'R0'")).where("benchmark = 'MAIN'").select("date", F.col("impact").alias("overseas_impact"))
    own = features.time_features(p.prices).join(link, "date", "left")
    filled = lambda cols: F.sum(sum((F.col(c).isNotNull().cast("int") for c in cols), F.lit(0))).cast("long")
    named = {h: features.columns_for(d, _KNOWN) for h, d in _HORIZONS.items()}
    one = own.groupBy("symbol").agg(F.array(*[F.struct(F.lit(h).alias("horizon"), F.lit(len(cols)).alias("n_columns"), filled(cols).alias("filled")) for h, cols in named.items()]).alias("h"))
    return one.select("symbol", F.inline("h"))


@query("g08_context_flags", "SELECT message_id, array_to_string(list_sort(list_distinct(list_concat([channel], [x for x in [CASE WHEN urgency >= 0.6 THEN 'urgent' END, CASE WHEN sentiment < 0 THEN 'negative' END] if x IS NOT NULL]))), ',') AS flags FROM posts")
def g08(p):
    more = rule_array((F.col("urgency") >= 0.6, "urgent"), (F.col("sentiment") < 0, "negative"))
    return p.posts.select("message_id", F.array_join(F.array_sort(F.array_union(F.array("channel"), more)), ",").alias("flags"))


@query("g17_outlook_ablation", "SELECT date, market, round(0.35::DOUBLE * (up_share - 0.5) + 1e-9, 6) AS delta, CASE WHEN abs(round(0.35::DOUBLE * (up_share - 0.5) + 1e-9, 6)) >= 0.05 THEN 'high' WHEN abs(round(0.35::DOUBLE * (up_share - 0.5) + 1e-9, 6)) >= 0.02 THEN 'medium' ELSE 'low' END AS level FROM od JOIN br USING (date, market) WHERE up_share IS NOT NULL", BREADTH)
def g17(p):
    own = market.outlook_dataset(p.index, market.breadth(p.prices, p.symbols)).where("up_share is not null")
    delta = rounded(0.35 * (F.col("up_share") - 0.5))
    return own.select("date", "market", delta.alias("delta"), F.when(F.abs(delta) >= 0.05, "high").when(F.abs(delta) >= 0.02, "medium").otherwise("low").alias("level"))


@query("m09_registry_upsert", "SELECT broker AS model, max(report_id) AS version, count(*) AS runs FROM rep GROUP BY broker")
def m09(p):
    return p.reports.groupBy(F.col("broker").alias("model")).agg(F.max("report_id").alias("version"), F.count(F.lit(1)).alias("runs"))


@query("x04_contexts", "SELECT sym.symbol, market, p.close, r.target FROM sym LEFT JOIN (SELECT symbol, arg_max(close, date) AS close FROM px GROUP BY symbol) p USING (symbol) LEFT JOIN (SELECT symbol, arg_max(target, report_date * 1) AS target FROM (SELECT symbol, target, date_diff('day', DATE '1970-01-01', report_date) * 10000000 + report_id AS report_date FROM rep) GROUP BY symbol) r USING (symbol)")
def x04(p):
    price = p.prices.groupBy("symbol").agg(F.max_by("close", "date").alias("close"))
    report = p.reports.groupBy("symbol").agg(F.max_by("target", F.struct("report_date", "report_id")).alias("target"))
    return p.symbols.select("symbol", "market").join(price, "symbol", "left").join(report, "symbol", "left")


@query("o10_outlook_list", "SELECT market, date, return_5d FROM od WHERE return_5d IS NOT NULL ORDER BY date DESC, CASE market WHEN 'MAIN' THEN 0 ELSE 1 END LIMIT 10", BREADTH)
def o10(p):
    own = market.outlook_dataset(p.index, market.breadth(p.prices, p.symbols)).where("return_5d is not null")
    return own.select("market", "date", "return_5d").orderBy(F.desc("date"), F.when(F.col("market") == "MAIN", 0).otherwise(1)).limit(10)


@query("d01_snapshot", "SELECT 'prices' AS section, count(*) AS n, max(date) AS latest FROM px UNION ALL SELECT 'reports', count(*), max(report_date) FROM rep UNION ALL SELECT 'flows', count(*), max(date) FROM flow UNION ALL SELECT 'news', count(*), max(pub_date) FROM news")
def d01(p):
    part = lambda name, df, c: df.agg(F.count(F.lit(1)).alias("n"), F.max(c).alias("latest")).select(F.lit(name).alias("section"), "n", "latest")
    return part("prices", p.prices, "date").unionByName(part("reports", p.reports, "report_date")).unionByName(part("flows", p.flows, "date")).unionByName(part("news", p.news, "pub_date"))


@query("d14_ordered_explanations", "SELECT symbol, move FROM mv ORDER BY abs(move) DESC, symbol LIMIT 12", MOVES)
def d14(p):
    return market.moves(p.prices).select("symbol", "move").orderBy(F.desc(F.abs("move")), "symbol").limit(12)


@query("d13_today", "SELECT market, count(*) AS n, round(avg(move) + 1e-9, 6) AS mean_move, max(date) AS date FROM mv JOIN sym USING (symbol) GROUP BY market", MOVES)
def d13(p):
    own = market.moves(p.prices).join(p.symbols.select("symbol", "market"), "symbol")
    return own.groupBy("market").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("move")).alias("mean_move"), F.max("date").alias("date"))
