"""Queries over scores, recommendations, portfolios and backtests."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.functions.columns import rounded
from quantloom.operators import decisions as D
from quantloom.operators import features

from .features import ALL, BASE, LABELS, _rank, label_frame, matrix
from .registry import query

_SC = " + ".join(f"{w}::DOUBLE * greatest(0.0, least(1.0, {c}))" for c, w in D.SCORE.items())
SCORED = f"""
sc0 AS (SELECT mat.*, pred_prob_top20, pred_return FROM pred JOIN mat USING (date, symbol)),
sc1 AS (SELECT *, round({_rank('pred_return')} + 1e-9, 6) AS return_rank FROM sc0),
sc AS (SELECT *, round({_SC} + 1e-9, 6) AS final_score FROM sc1),
scl AS (SELECT sc.*, future_return, benchmark_return, is_top20pct, market, sector FROM sc JOIN lab USING (date, symbol) JOIN sym USING (symbol))
"""
CTES = (*ALL, BASE, LABELS, SCORED)


def scored(p):
    m = matrix(p)
    return D.score(features.factor_baseline(m), m)


def labelled(p):
    """Scores with labels, staged once for every query on the same files."""
    return p.keep("labelled", lambda: _labelled(p))


def _labelled(p):
    keep = ["date", "symbol", "future_return", "benchmark_return", "is_top20pct"]
    from quantloom.operators import labels

    lab = labels.forward_labels(p.prices, labels.equal_weight_index(p.prices), 21, drawdown=False).select(*keep)
    return scored(p).join(lab, ["date", "symbol"]).join(p.symbols.select("symbol", "market", "sector"), "symbol")


@query("m10_scored_predictions", "SELECT date, symbol, return_rank, final_score FROM sc", *CTES)
def m10(p):
    return scored(p).select("date", "symbol", "return_rank", "final_score")


def _names(*rules: tuple[str, str]) -> str:
    return "[x for x in [" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for c, n in rules) + "] if x IS NOT NULL]"


_EX = _names(("trading_value_ma20 < 20000", "illiquid"), ("volatility_60d > 8", "volatile"), ("close < 101", "low_price"), ("trading_value_ma20 IS NULL", "short_history"))
_RK = _names(("rsi_14 >= 60", "overbought"), ("rsi_14 <= 40", "oversold"), ("risk_score >= 0.7", "high_risk"))
FLAGS = f"fl AS (SELECT *, {_EX} AS ex, list_concat({_RK}, ['exclude:' || x for x in {_EX}]) AS rk FROM sc)"


@query("m11_m12_flags", "SELECT date, symbol, array_to_string(ex, ',') AS exclusions, array_to_string(rk, ',') AS risks FROM fl", *CTES, FLAGS)
def m11(p):
    return D.exclusion_flags(scored(p)).select("date", "symbol", F.array_join("exclusions", ",").alias("exclusions"), F.array_join("risks", ",").alias("risks"))


_RS = _names(("momentum_score >= 0.7", "strong momentum"), ("supply_demand_score >= 0.7", "net buying"), ("value_score >= 0.7", "cheap"), ("quality_score >= 0.7", "quality"), ("risk_score <= 0.3", "low risk"), ("consensus_score >= 0.6", "upgrades"))


@query("m13_m14_recommendations", f"""SELECT date, symbol, rank, final_score, array_to_string(list_slice(CASE WHEN len(rs) < 3 THEN list_concat(rs, list_slice(['model score', 'factor balance', 'diversification'], 1, 3 - len(rs))) ELSE rs END, 1, 5), ',') AS reasons, array_to_string(rk, ',') AS risks
FROM (SELECT *, {_RS} AS rs, row_number() OVER (ORDER BY final_score DESC, symbol) AS rank FROM fl WHERE date = (SELECT max(date) FROM sc) AND len(ex) = 0) WHERE rank <= 10""", *CTES, FLAGS)
def m13(p):
    return D.recommendations(scored(p))


@query("m16_equal_weights", "SELECT date, symbol, round(1.0 / count(*) OVER (PARTITION BY date) + 1e-9, 6) AS weight FROM px")
def m16(p):
    from quantloom.functions.windows import by

    return p.prices.select("date", "symbol", rounded(1.0 / F.count(F.lit(1)).over(by("date"))).alias("weight"))


@query("m17_capped_portfolio", """SELECT date, symbol, sector, weight, round(1 - sum(weight) OVER (PARTITION BY date) + 1e-9, 4) AS cash FROM (SELECT date, symbol, sector, round(CASE WHEN s > 0.3 THEN w * 0.3::DOUBLE / s ELSE w END + 1e-9, 4) AS weight FROM (SELECT *, sum(w) OVER (PARTITION BY date, sector) AS s FROM (
SELECT date, symbol, sector, least(final_score / sum(final_score) OVER (PARTITION BY date) * 0.9::DOUBLE, 0.15::DOUBLE) AS w FROM sc JOIN sym USING (symbol))))""", *CTES)
def m17(p):
    own = scored(p).join(p.symbols.select("symbol", "sector"), "symbol")
    return D.capped_portfolio(own)


def _bt(by: str, tag: str = "") -> str:
    return f"""
pl{tag} AS (SELECT max(date) AS date FROM sc GROUP BY date_trunc('month', date)),
tk{tag} AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY {by} DESC NULLS LAST, symbol) AS r FROM scl WHERE date IN (SELECT date FROM pl{tag}) AND future_return IS NOT NULL),
b0{tag} AS (SELECT date, round(avg(future_return) + 1e-9, 9) AS gross, round(avg(benchmark_return) + 1e-9, 9) AS bench, list(DISTINCT symbol) AS held, round(avg(is_top20pct::INT::DOUBLE) + 1e-9, 6) AS precision FROM tk{tag} WHERE r <= 5 GROUP BY date),
b1{tag} AS (SELECT *, lag(held) OVER (ORDER BY date) AS before FROM b0{tag}),
b2{tag} AS (SELECT *, CASE WHEN before IS NULL THEN 1.0::DOUBLE ELSE least(1.0, len([x for x in held if NOT list_contains(before, x)]) / 5.0::DOUBLE) END AS turnover FROM b1{tag}),
b3{tag} AS (SELECT *, gross - turnover * 30.0::DOUBLE / 10000.0::DOUBLE AS net FROM b2{tag}),
b4{tag} AS (SELECT *, net - bench AS excess, exp(sum(ln(1 + net)) OVER (ORDER BY date)) AS e FROM b3{tag}),
bt{tag} AS (SELECT date, round(gross + 1e-9, 6) AS gross, round(turnover + 1e-9, 6) AS turnover, round(net + 1e-9, 6) AS net, round(excess + 1e-9, 6) AS excess, round(ln(e) + 1e-9, 6) AS log_equity, round(e / max(e) OVER (ORDER BY date) - 1 + 1e-9, 6) AS drawdown, precision FROM b4{tag}),
mx{tag} AS (SELECT count(*) AS periods, round(avg(net) + 1e-9, 6) AS mean_net, round(stddev_pop(net) + 1e-9, 6) AS std_net, round(avg(net) / nullif(stddev_pop(net), 0) * sqrt(365.25::DOUBLE / avg(gap)) + 1e-9, 4) AS sharpe, round(min(drawdown) + 1e-9, 6) AS max_drawdown,
  round(avg((excess > 0)::INT::DOUBLE) + 1e-9, 6) AS hit_ratio, round(avg(turnover) + 1e-9, 6) AS mean_turnover, round(avg(excess) + 1e-9, 6) AS mean_excess, round(avg(precision) + 1e-9, 6) AS mean_precision
  FROM (SELECT *, date_diff('day', lag(date) OVER (ORDER BY date), date) AS gap FROM bt{tag}))
"""


BT, BT2 = _bt("final_score"), _bt("momentum_score", "_b")


@query("b01_topk_backtest", "SELECT * FROM bt", *CTES, BT)
def b01(p):
    return D.topk_backtest(labelled(p), k=5)


@query("b02_rebalance_dates", "SELECT max(date) AS date FROM px GROUP BY date_trunc('quarter', date)")
def b02(p):
    return D.period_last(p.prices, "Q")


@query("b04_backtest_metrics", "SELECT * FROM mx", *CTES, BT)
def b04(p):
    return D.backtest_metrics(D.topk_backtest(labelled(p), k=5))


@query("b05_baseline_comparison", "SELECT 'model' AS run, * FROM mx UNION ALL SELECT 'momentum', * FROM mx_b", *CTES, BT, BT2)
def b05(p):
    own = labelled(p)
    runs = [(name, D.backtest_metrics(D.topk_backtest(own, k=5, by=by))) for name, by in (("model", "final_score"), ("momentum", "momentum_score"))]
    a, b = (m.withColumn("run", F.lit(name)) for name, m in runs)
    return a.unionByName(b)


BT3 = _bt("random_score", "_r").replace("scl", "scr")
RANDOM = "scr AS (SELECT *, ('0x' || substr(md5('42|' || strftime(date, '%Y-%m-%d') || '|' || symbol), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS random_score FROM scl)"


@query("b05_random_baseline", "SELECT 'model' AS run, * FROM mx UNION ALL SELECT 'factor', * FROM mx_b UNION ALL SELECT 'random', * FROM mx_r", *CTES, RANDOM, BT, BT2, BT3)
def b05_random(p):
    """The model, a factor alone and a seeded random choice."""
    own = D.random_scores(labelled(p), 42)
    runs = [D.backtest_metrics(D.topk_backtest(own, k=5, by=by)).withColumn("run", F.lit(name)) for name, by in (("model", "final_score"), ("factor", "momentum_score"), ("random", "random_score"))]
    return runs[0].unionByName(runs[1]).unionByName(runs[2])


@query("b06_gate", """SELECT len(f) = 0 AS accepted, coalesce(f[1], 'passed') AS reason FROM (SELECT [x for x in [CASE WHEN a.mean_excess - b.mean_excess < 0.01 THEN 'excess' END, CASE WHEN a.hit_ratio - b.hit_ratio < 0.03 THEN 'hit_ratio' END,
CASE WHEN b.max_drawdown - a.max_drawdown > 0.02 THEN 'drawdown' END, CASE WHEN a.mean_turnover > 1.3 * b.mean_turnover THEN 'turnover' END] if x IS NOT NULL] AS f FROM mx a, mx_b b)""", *CTES, BT, BT2)
def b06(p):
    own = labelled(p)
    return D.gate(*(D.backtest_metrics(D.topk_backtest(own, k=5, by=by)) for by in ("final_score", "momentum_score")))


LS = """
u0 AS (SELECT *, row_number() OVER (PARTITION BY date, market ORDER BY final_score DESC, symbol) AS r FROM scl),
u1 AS (SELECT *, row_number() OVER (PARTITION BY date, market ORDER BY final_score, symbol) AS r2 FROM u0 WHERE r > 3),
u2 AS (SELECT date, market, symbol, 'long' AS side, r AS rank, future_return FROM u0 WHERE r <= 3 UNION ALL SELECT date, market, symbol, 'short', r2, future_return FROM u1 WHERE r2 <= 2),
ls AS (SELECT date, market, symbol, side, rank, round(CASE WHEN side = 'long' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END / count(*) OVER (PARTITION BY date, market, side) + 1e-9, 6) AS weight, future_return FROM u2),
v0 AS (SELECT date, market, round(avg(future_return) FILTER (side = 'long') - avg(future_return) FILTER (side = 'short') + 1e-9, 9) AS spread, list(DISTINCT side || ':' || symbol) AS held FROM ls WHERE date IN (SELECT max(date) FROM sc GROUP BY date_trunc('month', date)) GROUP BY date, market),
v1 AS (SELECT *, lag(held) OVER (PARTITION BY market ORDER BY date) AS before FROM v0 WHERE spread IS NOT NULL),
v2 AS (SELECT *, round(CASE WHEN before IS NULL THEN 1.0 ELSE (len([x for x in held if NOT list_contains(before, x)]) + len([x for x in before if NOT list_contains(held, x)])) / (2.0::DOUBLE * len(held)) END + 1e-9, 6) AS turnover FROM v1),
v3 AS (SELECT *, spread - turnover * 30.0::DOUBLE / 10000.0::DOUBLE AS net FROM v2)
"""


@query("b07_b08_long_short", "SELECT * FROM ls", *CTES, LS)
def b07(p):
    return D.long_short(labelled(p))


@query("b09_long_short_backtest", "SELECT date, market, round(spread + 1e-9, 6) AS spread, turnover, round(net + 1e-9, 6) AS net, round(sum(ln(CASE WHEN net > -1 THEN 1 + net END)) OVER (PARTITION BY market ORDER BY date) + 1e-9, 6) AS log_equity FROM v3", *CTES, LS)
def b09(p):
    own = labelled(p)
    return D.long_short_backtest(D.long_short(own.join(D.period_last(own, "M"), "date", "left_semi")))


@query("b11_up_down", "SELECT date, market, symbol, CASE side WHEN 'long' THEN 'up' ELSE 'down' END AS direction, rank FROM ls WHERE date = (SELECT max(date) FROM ls)", *CTES, LS)
def b11(p):
    legs = D.long_short(labelled(p))
    latest = legs.agg(F.max("date").alias("date"))
    return legs.join(F.broadcast(latest), "date").select("date", "market", "symbol", F.when(F.col("side") == "long", "up").otherwise("down").alias("direction"), "rank")


RES = """
res AS (SELECT date, symbol, row_number() OVER (PARTITION BY date ORDER BY final_score DESC, symbol) AS rank_no, date + 30 AS target_date, pred_return, future_return, coalesce(future_return > 0, false) AS is_hit, coalesce(future_return > benchmark_return, false) AS is_outperform,
  row_number() OVER (PARTITION BY date ORDER BY final_score DESC, symbol) <= 5 AS is_top FROM scl WHERE future_return IS NOT NULL)
"""


@query("b12_backtest_results", "SELECT * FROM res", *CTES, RES)
def b12(p):
    return D.backtest_results(labelled(p), 30)


@query("b13_performance", f"""SELECT count(*) AS n, round(avg(is_hit::INT::DOUBLE) + 1e-9, 6) AS hit_rate, round(avg(is_outperform::INT::DOUBLE) + 1e-9, 6) AS win_rate, round(avg(future_return) + 1e-9, 6) AS mean_return, round(median(future_return) + 1e-9, 6) AS median_return,
round(avg(is_hit::INT::DOUBLE) FILTER (is_top) + 1e-9, 6) AS top_precision, round(corr(a, b) + 1e-9, 5) AS rank_ic FROM (SELECT *, {_rank('pred_return', 'is_hit IS NULL')} AS a, {_rank('future_return', 'is_hit IS NULL')} AS b FROM res WHERE rank_no <= 10)""", *CTES, RES)
def b13(p):
    return D.performance(D.backtest_results(labelled(p), 30).where("rank_no <= 10"))


_VERSIONS = {"combined": ("v1", "final_score"), "momentum": ("v2", "momentum_score")}
MODELS = "pm AS (" + " UNION ALL ".join(
    f"""SELECT '{m}' AS model_name, '{v}' AS model_version, '1M' AS horizon, 21 AS horizon_days, date AS prediction_date, symbol, {c} AS pred_return, future_return AS actual_return, benchmark_return, future_return - benchmark_return AS excess_return,
  coalesce(future_return > 0, false) AS is_hit, coalesce(future_return > benchmark_return, false) AS is_outperform, row_number() OVER (PARTITION BY date ORDER BY {c} DESC NULLS LAST, symbol) AS rank_no FROM scl WHERE future_return IS NOT NULL"""
    for m, (v, c) in _VERSIONS.items()
) + ")"
_MODEL = "model_name, model_version, horizon, horizon_days"
PATHS = f"""
pr0 AS (SELECT *, {_rank('pred_return', 'model_name')} AS a, {_rank('actual_return', 'model_name')} AS b FROM pm),
pr1 AS (SELECT {_MODEL}, max(prediction_date) AS eval_date, count(*) AS sample_count, round(avg(is_hit::INT::DOUBLE) + 1e-9, 6) AS hit_ratio, round(avg(is_hit::INT::DOUBLE) FILTER (rank_no <= 5) + 1e-9, 6) AS precision_top, round(avg(actual_return) + 1e-9, 6) AS avg_actual, round(avg(benchmark_return) + 1e-9, 6) AS avg_benchmark,
  round(avg(excess_return) + 1e-9, 6) AS avg_excess, round(median(actual_return) + 1e-9, 6) AS median_actual, round(avg(is_outperform::INT::DOUBLE) + 1e-9, 6) AS win_rate, round(corr(a, b) + 1e-9, 5) AS rank_ic FROM pr0 GROUP BY ALL),
pr2 AS (SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY prediction_date) - 1 AS i FROM (SELECT {_MODEL}, prediction_date, avg(actual_return) AS r FROM pm WHERE rank_no <= 5 GROUP BY ALL)),
pr3 AS (SELECT *, exp(sum(ln(1 + r)) OVER (PARTITION BY model_name ORDER BY prediction_date)) AS level FROM pr2 WHERE i % 21 = 0),
pr4 AS (SELECT *, level / max(level) OVER (PARTITION BY model_name ORDER BY prediction_date) - 1 AS fall FROM pr3),
pr5 AS (SELECT {_MODEL}, count(r) AS n_portfolios, round(min(fall) + 1e-9, 6) AS mdd, round(avg(r) / stddev_pop(r) * sqrt(12.0::DOUBLE) + 1e-9, 4) AS sharpe FROM pr4 GROUP BY ALL)
"""


@query("b13_performance_by_model", f"SELECT * FROM pr1 JOIN pr5 USING ({_MODEL})", *CTES, MODELS, PATHS)
def b13_models(p):
    return model_results(p)


def model_results(p):
    """Performance of two models: the combined score, and momentum alone."""
    from functools import reduce

    from quantloom.functions.windows import first_rank

    own = labelled(p).where("future_return is not null")
    flag = lambda c: F.coalesce(c, F.lit(False))
    one = lambda m, v, c: own.select(
        F.lit(m).alias("model_name"), F.lit(v).alias("model_version"), F.lit("1M").alias("horizon"), F.lit(21).alias("horizon_days"), F.col("date").alias("prediction_date"), "symbol", F.col(c).alias("pred_return"),
        F.col("future_return").alias("actual_return"), "benchmark_return", (F.col("future_return") - F.col("benchmark_return")).alias("excess_return"), flag(F.col("future_return") > 0).alias("is_hit"),
        flag(F.col("future_return") > F.col("benchmark_return")).alias("is_outperform"), first_rank(F.col(c), "date").alias("rank_no"),
    )
    return D.performance_by_model(reduce(lambda a, b: a.unionByName(b), [one(m, v, c) for m, (v, c) in _VERSIONS.items()]), top=5)


GAP = """
g0 AS (SELECT date AS asof_date, symbol, pred_return FROM pred),
g1 AS (SELECT g0.*, q.close AS entry FROM g0 ASOF LEFT JOIN (SELECT symbol AS s, date AS d, close FROM px) q ON symbol = s AND asof_date <= d),
g2 AS (SELECT g1.*, q.close AS target FROM g1 ASOF LEFT JOIN (SELECT symbol AS s, date AS d, close FROM px) q ON symbol = s AND asof_date + 30 <= d),
gap AS (SELECT asof_date, symbol, pred_return, entry, target, CASE WHEN entry IS NULL THEN 'missing_price' WHEN target IS NULL THEN 'pending' ELSE 'completed' END AS status, round(target / nullif(entry, 0) - 1 + 1e-9, 6) AS realised,
  round(round(target / nullif(entry, 0) - 1 + 1e-9, 6) - pred_return + 1e-9, 6) AS gap, coalesce(sign(round(target / nullif(entry, 0) - 1 + 1e-9, 6)) = sign(pred_return), false) AS direction_hit FROM g2)
"""


def _gap(p):
    return D.price_gap(features.factor_baseline(matrix(p)), p.prices, days=30)


@query("b15_price_gap", "SELECT * FROM gap", *ALL, BASE, GAP)
def b15(p):
    return _gap(p)


@query("b16_price_gap_summary", "SELECT status, count(*) AS n, round(avg(abs(gap)) + 1e-9, 6) AS mae, round(avg(gap) + 1e-9, 6) AS bias, round(avg(direction_hit::INT::DOUBLE) + 1e-9, 6) AS accuracy FROM gap GROUP BY status", *ALL, BASE, GAP)
def b16(p):
    return _gap(p).groupBy("status").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg(F.abs("gap"))).alias("mae"), rounded(F.avg("gap")).alias("bias"), rounded(F.avg(F.col("direction_hit").cast("double"))).alias("accuracy"))


@query(
    "b17_forecast_band",
    """SELECT date, symbol, 'backtest_rmse' AS band_source, round(b + 1e-9, 6) AS band, round(close * (1 + e) + 1e-9, 4) AS base_price, round(close * (1 + greatest(e, 0.0) + b) + 1e-9, 4) AS upside_price, round(close * (1 + least(e, 0.0) - b) + 1e-9, 4) AS downside_price
FROM (SELECT *, pred_return / 10 AS e FROM sc WHERE date = (SELECT max(date) FROM sc)), (SELECT greatest(0.0, least(1.0, sqrt(avg((pred_return / 10 - future_return) ** 2)))) AS b FROM scl)""",
    *CTES,
)
def b17_band(p):
    """The latest predictions with the band of their past errors."""
    own = scored(p).withColumn("expected", F.col("pred_return") / 10)
    latest = own.join(F.broadcast(own.agg(F.max("date").alias("date"))), "date")  # one row
    out = D.forecast_band(latest, labelled(p).withColumn("expected", F.col("pred_return") / 10), horizon_days=21)
    return out.select("date", "symbol", "band_source", rounded(F.col("band")).alias("band"), *[rounded(F.col(c), 4).alias(c) for c in ("base_price", "upside_price", "downside_price")])


@query("b17_price_forecast", "SELECT date, symbol, round(close * (1 + pred_return / 10) + 1e-9, 4) AS expected, round(close * (1 + pred_return / 10 + b) + 1e-9, 4) AS upside, round(close * (1 + pred_return / 10 - b) + 1e-9, 4) AS downside FROM (SELECT *, coalesce(greatest(0.0, least(1.0, CASE WHEN volatility_60d IS NOT NULL THEN volatility_60d * sqrt(21 / 252.0::DOUBLE) / 10 END)), 0.1) AS b FROM sc WHERE date = (SELECT max(date) FROM sc))", *CTES)
def b17(p):
    from quantloom.functions.columns import clip

    own = scored(p)
    own = own.join(F.broadcast(own.agg(F.max("date").alias("date"))), "date")
    band = F.coalesce(clip(F.col("volatility_60d") * (21 / 252.0) ** 0.5 / 10), F.lit(0.1))
    price = lambda r: rounded(F.col("close") * (1 + r), 4)
    mid = F.col("pred_return") / 10
    return own.select("date", "symbol", price(mid).alias("expected"), price(mid + band).alias("upside"), price(mid - band).alias("downside"))


@query("d04_top_upside", f"SELECT symbol, combined, row_number() OVER (ORDER BY combined DESC, symbol) AS rank FROM (SELECT symbol, round(0.6::DOUBLE * greatest(0.0, least(1.0, pred_prob_top20)) + 0.4::DOUBLE * {_rank('pred_return')} + 1e-9, 6) AS combined FROM pred WHERE date = (SELECT max(date) FROM pred)) ORDER BY rank LIMIT 20", *ALL, BASE)
def d04(p):
    from quantloom.functions.columns import clip
    from quantloom.functions.windows import first_rank, pct_rank

    own = features.factor_baseline(matrix(p))
    own = own.join(F.broadcast(own.agg(F.max("date").alias("date"))), "date")
    own = own.withColumn("combined", rounded(0.6 * clip(F.col("pred_prob_top20")) + 0.4 * pct_rank(F.col("pred_return"), "date")))
    return own.select("symbol", "combined", first_rank(F.col("combined"), "date").cast("long").alias("rank")).orderBy("rank").limit(20)
