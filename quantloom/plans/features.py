"""Queries over features, labels, analysts and joins in time."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.functions.columns import rounded
from quantloom.operators import analyst, asof, features, labels

from .registry import query

_W = "OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"


def _roll(agg: str, x: str, n: int, least: int | None = None) -> str:
    w = _W.format(n - 1)
    return f"CASE WHEN count({x}) {w} >= {n if least is None else least} THEN {agg}({x}) {w} END"


def _rank(x: str, part: str = "date", up: bool = True) -> str:
    order = "ASC" if up else "DESC"
    return f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY {part} ORDER BY {x} {order} NULLS LAST) + (count(*) OVER (PARTITION BY {part}, {x}) - 1) / 2.0::DOUBLE) / count({x}) OVER (PARTITION BY {part}) END"


def _mean(*xs: str) -> str:
    return "((" + " + ".join(f"coalesce({x}, 0.0)" for x in xs) + ") / nullif(" + " + ".join(f"({x} IS NOT NULL)::INT" for x in xs) + ", 0))"


_R = [f"ret_{n}d" for n in features.RETURNS]
_S = "(PARTITION BY symbol ORDER BY date)"
FEAT = f"""
f0 AS (SELECT *, close / lag(close) OVER {_S} - 1 AS ret1, close - lag(close) OVER {_S} AS step FROM px),
f1 AS (SELECT *, CASE WHEN step > 0 THEN step WHEN step IS NOT NULL THEN 0.0 END AS gain, CASE WHEN step < 0 THEN -step WHEN step IS NOT NULL THEN 0.0 END AS loss FROM f0),
f2 AS (SELECT date, symbol, close,
  {", ".join(f"round(close / lag(close, {n}) OVER {_S} - 1 + 1e-9, 6) AS ret_{n}d" for n in features.RETURNS)},
  {", ".join(f"round(close / ({_roll('avg', 'close', n)}) - 1 + 1e-9, 6) AS ma_gap_{n}d" for n in features.GAPS)},
  {", ".join(f"round(({_roll('stddev_samp', 'ret1', n)}) * sqrt(252.0::DOUBLE) + 1e-9, 6) AS volatility_{n}d" for n in features.VOLS)},
  round(volume / nullif({_roll('avg', 'volume', 20)}, 0) + 1e-9, 6) AS volume_ratio_20d, round({_roll('avg', 'trading_value', 20)} + 1e-9, 2) AS trading_value_ma20,
  round(close / ({_roll('max', 'close', 252, 60)}) - 1 + 1e-9, 6) AS close_to_52w_high, {_roll('avg', 'gain', 14)} AS g, {_roll('avg', 'loss', 14)} AS l FROM f1),
f3 AS (SELECT * EXCLUDE (g, l), round(coalesce(100 - 100 / (1 + g / CASE WHEN l > 1e-12 THEN l END), 50.0) + 1e-9, 6) AS rsi_14 FROM f2),
f4 AS (SELECT *, {", ".join(f"round({_rank(x)} + 1e-9, 6) AS k_{x}" for x in _R)}, round({_rank('volatility_60d', up=False)} + 1e-9, 6) AS volatility_score,
  round({_rank('volatility_60d')} + 1e-9, 6) AS k_risk, round({_rank('trading_value_ma20')} + 1e-9, 6) AS liquidity_score FROM f3),
feat AS (SELECT * EXCLUDE ({", ".join(f"k_{x}" for x in _R)}, k_risk), round({_mean(*[f"k_{x}" for x in _R])} + 1e-9, 6) AS momentum_score,
  round({_mean('k_risk', '(1 - liquidity_score)', '(CASE WHEN rsi_14 IS NOT NULL THEN greatest(0.0, least(1.0, (rsi_14 - 70) / 30)) END)')} + 1e-9, 6) AS risk_score FROM f4)
"""

_PARTS = {
    "f02_returns": _R,
    "f03_ma_gaps": features.GAP,
    "f04_volatility": features.VOL,
    "f05_liquidity_windows": ["volume_ratio_20d", "trading_value_ma20"],
    "f06_close_to_high": ["close_to_52w_high"],
    "f07_rsi_14": ["rsi_14"],
    "f08_momentum_score": ["momentum_score"],
    "f09_volatility_liquidity_scores": ["volatility_score", "liquidity_score"],
    "f10_risk_score": ["risk_score"],
}
for _name, _cols in _PARTS.items():
    query(_name, f"SELECT date, symbol, {', '.join(_cols)} FROM feat", FEAT)(lambda p, cols=_cols: features.price_features(p.prices).select("date", "symbol", *cols))


@query("f01_price_features", "SELECT feat.*, horizon, horizon_days FROM feat, (VALUES ('1M', 21), ('3M', 63)) h(horizon, horizon_days)", FEAT)
def f01(p):
    return features.with_horizons(features.price_features(p.prices), {"1M": 21, "3M": 63})


MARKET = f"""
m0 AS (SELECT date, symbol, {_rank('market_cap')} AS cap, {_rank('CASE WHEN per > 0 THEN per END', up=False)} AS per, {_rank('CASE WHEN pbr > 0 THEN pbr END', up=False)} AS pbr,
  {_rank('dividend_yield')} AS div, {_rank('eps')} AS eps, {_rank('bps')} AS bps FROM met),
mfeat AS (SELECT date, symbol, round(coalesce(cap, 0.5) + 1e-9, 6) AS size_score, round(coalesce({_mean('per', 'pbr', 'div')}, 0.5) + 1e-9, 6) AS value_score, round(coalesce({_mean('eps', 'bps')}, 0.5) + 1e-9, 6) AS quality_score FROM m0)
"""


@query("f11_market_features", "SELECT * FROM mfeat", MARKET)
def f11(p):
    return features.market_features(p.metrics)


def _run(x: str) -> str:
    return f"CASE WHEN {x} > 0 THEN row_number() OVER {_S} - coalesce(max(CASE WHEN NOT coalesce({x} > 0, false) THEN rn END) OVER {_S}, 0) ELSE 0 END"


_K = ("foreign", "institution", "retail")
FLOW = f"""
tv AS (SELECT date, symbol, round({_roll('sum', 'trading_value', 20, 1)} + 1e-9, 2) AS value_20d FROM px),
w0 AS (SELECT *, row_number() OVER {_S} AS rn FROM flow),
w1 AS (SELECT date, symbol, {", ".join(f"round({_roll('sum', f'{k}_net_value', n, 1)} + 1e-9, 2) AS {k}_net_{n}d" for k in _K for n in features.FLOW_SPANS)},
  {_run('foreign_net_value')} AS foreign_buy_days, {_run('institution_net_value')} AS institution_buy_days FROM w0),
w2 AS (SELECT w1.*, round(foreign_net_20d / nullif(market_cap, 0) + 1e-9, 6) AS foreign_to_cap, round(institution_net_20d / nullif(value_20d, 0) + 1e-9, 6) AS institution_to_value, round(greatest(retail_net_20d, 0.0) / nullif(value_20d, 0) + 1e-9, 6) AS retail_overheat
  FROM w1 LEFT JOIN met USING (date, symbol) LEFT JOIN tv USING (date, symbol)),
ffeat AS (SELECT *, round(0.45::DOUBLE * coalesce({_rank('foreign_to_cap')}, 0.5) + 0.45::DOUBLE * coalesce({_rank('institution_to_value')}, 0.5) + 0.10::DOUBLE * (1 - coalesce({_rank('retail_overheat')}, 0.5)) + 1e-9, 6) AS supply_demand_score FROM w2)
"""


@query("f12_flow_features", "SELECT * FROM ffeat", FLOW)
def f12(p):
    return features.flow_features(p.flows, p.prices, p.metrics)


@query("f13_traded_value", "SELECT * FROM tv", FLOW)
def f13(p):
    return features.traded_value(p.prices)


_UP = "(target / nullif(price, 0) - 1) * 100"
TARGET = f"""
t0 AS (SELECT *, round((target / nullif(previous_target, 0) - 1) * 100 + 1e-9, 6) AS target_change_pct, round({_UP} + 1e-9, 6) AS upside_pct FROM rep),
tfeat AS (SELECT report_id, report_date, symbol, broker, analyst, price, target, target_change_pct, upside_pct, coalesce(target_change_pct >= 5, false) AS is_upgrade, coalesce(target_change_pct <= -5, false) AS is_downgrade, previous_target IS NULL AS is_new,
  coalesce(upside_pct >= 30, false) AS is_high_upside, coalesce(upside_pct >= 70, false) AS is_extreme,
  round(coalesce(greatest(0.0, least(1.0, (upside_pct + 20) / 80)), 0.5) * CASE WHEN coalesce(upside_pct >= 70, false) THEN 0.75::DOUBLE ELSE 1.0::DOUBLE END + 1e-9, 6) AS upside_score FROM t0)
"""


@query("f14_target_features", "SELECT * FROM tfeat", TARGET)
def f14(p):
    return analyst.target_features(p.reports)


_MONTHS = (0, *analyst.MONTHS)
OUT = f"""
o0 AS (SELECT report_id, symbol, report_date, analyst, broker, price, target, m, CAST(report_date + to_months(m::INT) AS DATE) AS due FROM rep, (SELECT unnest([{", ".join(map(str, _MONTHS))}]) AS m)),
o1 AS (SELECT o0.*, b.close, b.d, x.level FROM o0 ASOF LEFT JOIN (SELECT symbol AS s, date AS d, close FROM px) b ON symbol = s AND due <= d ASOF LEFT JOIN (SELECT date AS bd, close AS level FROM idx WHERE benchmark = 'MAIN') x ON due <= bd),
o2 AS (SELECT report_id, symbol, report_date, analyst, broker, price, target, {", ".join(f"max(close) FILTER (m = {m}) AS price_{m}m, max(level) FILTER (m = {m}) AS level_{m}" for m in _MONTHS)}, coalesce(max(d) FILTER (m = 0), report_date) AS base_date, coalesce(max(close) FILTER (m = 0), price) AS base FROM o1 GROUP BY report_id, symbol, report_date, analyst, broker, price, target),
dd AS (SELECT report_id, {", ".join(f"min(close / top - 1) FILTER (date <= CAST(report_date + INTERVAL {m} MONTH AS DATE)) AS fall_{m}" for m in analyst.DRAWDOWN)} FROM (
  SELECT report_id, report_date, date, close, max(close) OVER (PARTITION BY report_id ORDER BY date) AS top FROM o2 JOIN px USING (symbol) WHERE date >= base_date AND date <= CAST(report_date + INTERVAL 6 MONTH AS DATE)) GROUP BY report_id),
th AS (SELECT report_id, min(date) AS target_hit_date FROM rep JOIN px USING (symbol) WHERE date > report_date AND date <= CAST(report_date + INTERVAL 24 MONTH AS DATE) AND high >= target GROUP BY report_id),
outc AS (SELECT report_id, symbol, report_date, analyst, broker, price, target, base, {", ".join(f"price_{m}m, round(price_{m}m / base - 1 + 1e-9, 6) AS return_{m}m" for m in analyst.MONTHS)},
  {", ".join(f"round(level_{m} / level_0 - 1 + 1e-9, 6) AS benchmark_return_{m}m, round((price_{m}m / base - 1) - (level_{m} / level_0 - 1) + 1e-9, 6) AS excess_return_{m}m" for m in analyst.EXCESS)},
  {", ".join(f"round(fall_{m} + 1e-9, 6) AS max_drawdown_{m}m" for m in analyst.DRAWDOWN)}, target_hit_date, date_diff('day', report_date, target_hit_date)::INT AS target_hit_days,
  {", ".join(f"coalesce(target_hit_date <= CAST(report_date + INTERVAL {m} MONTH AS DATE), false) AS target_hit_{m}m" for m in (6, 12))} FROM o2 LEFT JOIN dd USING (report_id) LEFT JOIN th USING (report_id))
"""


def _outcomes(p):
    return analyst.outcomes(p.reports, p.prices, p.index.where("benchmark = 'MAIN'"))


@query("f15_analyst_outcomes", "SELECT * FROM outc", OUT)
def f15(p):
    return _outcomes(p)


_DIR = "avg((coalesce(target / nullif(price, 0) - 1 >= 0, false) = coalesce(return_{}m >= 0, false))::INT::DOUBLE)"
SCORES = f"""
a1 AS (SELECT *, target / nullif(price_12m, 0) - 1 AS error FROM outc),
a2 AS (SELECT analyst, broker, count(*) AS n_reports, count(*) FILTER (report_date >= (SELECT max(report_date) FROM outc) - 365) AS n_recent, round(sqrt(avg(error * error)) + 1e-9, 6) AS rmse, round(avg(abs(error)) + 1e-9, 6) AS mae, round(avg(error) + 1e-9, 6) AS bias, round(stddev_pop(error) + 1e-9, 6) AS error_std,
  {", ".join(f"round({_DIR.format(m)} + 1e-9, 6) AS direction_{m}m, round(avg(target_hit_{m}m::INT::DOUBLE) + 1e-9, 6) AS hit_rate_{m}m, round(avg(excess_return_{m}m) + 1e-9, 6) AS avg_excess_{m}m" for m in (6, 12))} FROM a1 GROUP BY analyst, broker HAVING count(*) >= 5),
ascore AS (SELECT *, round(greatest(0.0, least(1.0, 0.30::DOUBLE * coalesce(direction_12m, 0.5) + 0.15::DOUBLE * coalesce(direction_6m, 0.5) + 0.20::DOUBLE * coalesce(hit_rate_12m, 0.0) + 0.10::DOUBLE * coalesce(hit_rate_6m, 0.0)
  + 0.15::DOUBLE * CASE WHEN avg_excess_12m IS NULL THEN 0.5 ELSE greatest(0.0, least(1.0, (avg_excess_12m + 0.2) / 0.4)) END + 0.10::DOUBLE * (1 - CASE WHEN mae IS NULL THEN 0.5 ELSE greatest(0.0, least(1.0, mae / 0.5)) END))) + 1e-9, 6) AS reliability FROM a2 WHERE n_recent > 0)
"""


@query("f16_analyst_scores", "SELECT * FROM ascore", OUT, SCORES)
def f16(p):
    return analyst.analyst_scores(_outcomes(p), reports=p.reports)


_W90, _W30 = ("OVER (PARTITION BY symbol ORDER BY report_date RANGE BETWEEN INTERVAL {} DAYS PRECEDING AND CURRENT ROW)".format(n) for n in (89, 29))
CONS = f"""
c0 AS (SELECT DISTINCT symbol, report_date, count(*) {_W90} AS n90, count(*) {_W30} AS n30, round(avg(target) {_W90}, 9) AS m90, round(avg(target) {_W30}, 9) AS m30, max(target) {_W90} AS target_max, min(target) {_W90} AS target_min,
  round(coalesce(stddev_samp(target) {_W90}, 0.0) + 1e-9, 4) AS target_std, sum(is_upgrade::INT) {_W30} AS up30, sum(is_downgrade::INT) {_W30} AS down30 FROM tfeat),
cons AS (SELECT symbol, report_date, n90, n30, round(m90 + 1e-9, 6) AS target_mean, target_max, target_min, target_std, up30::BIGINT AS up30, down30::BIGINT AS down30, round(m30 / m90 - 1 + 1e-9, 6) AS momentum,
  round(greatest(0.0, least(1.0, 0.7::DOUBLE * ((up30 - down30)::DOUBLE / greatest(n30, 1) + 1) / 2 + 0.3::DOUBLE * (m30 / m90 - 1 + 0.2::DOUBLE) / 0.4::DOUBLE)) + 1e-9, 6) AS consensus_score FROM c0)
"""


@query("f17_consensus_history", "SELECT * FROM cons", TARGET, CONS)
def f17(p):
    return analyst.consensus(p.reports)


@query(
    "f17_consensus_measures",
    f"""SELECT DISTINCT symbol, report_date, round(m + 1e-9, 4) AS target_median, round(buy + 1e-9, 6) AS buy_ratio, round(a / last.price * 100 - 100 + 1e-9, 4) AS upside_pct, new30::BIGINT AS new30, round(net30 / n30::DOUBLE + 1e-9, 6) AS revision_balance FROM (
SELECT symbol, report_date, list_median(list(target) {_W90}) AS m, avg(CASE WHEN rating IS NOT NULL THEN (rating = 'Buy')::INT::DOUBLE END) {_W90} AS buy, round(avg(target) {_W90}, 9) AS a, max({{'d': report_date, 'i': report_id, 'price': price}}) {_W90} AS last, sum(is_new::INT) {_W30} AS new30, sum(is_upgrade::INT - is_downgrade::INT) {_W30} AS net30, count(*) {_W30} AS n30
FROM tfeat JOIN (SELECT report_id, rating FROM rep) USING (report_id))""",
    TARGET,
)
def f17_more(p):
    return analyst.consensus_measures(p.reports)


ATT = """
att AS (SELECT px.date, px.symbol, px.close, coalesce(c.consensus_score, 0.5) AS consensus_score, round(CASE WHEN c.target_mean IS NULL THEN 0.5 ELSE greatest(0.0, least(1.0, ((c.target_mean / px.close - 1) * 100 + 20) / 80)) END + 1e-9, 6) AS upside_score
  FROM px ASOF LEFT JOIN (SELECT symbol AS s, report_date AS d, consensus_score, target_mean FROM cons) c ON px.symbol = c.s AND px.date >= c.d)
"""


@query("f18_attach_consensus", "SELECT * FROM att", TARGET, CONS, ATT)
def f18(p):
    return analyst.attach_consensus(p.prices.select("date", "symbol", "close"), analyst.consensus(p.reports))


_N = {"momentum_score": "f.momentum_score", "supply_demand_score": "w.supply_demand_score", "value_score": "m.value_score", "quality_score": "m.quality_score", "liquidity_score": "f.liquidity_score", "consensus_score": "a.consensus_score", "upside_score": "a.upside_score"}
MATRIX = f"""
x0 AS (SELECT f.date, f.symbol, f.close, f.ret_21d, f.ret_63d, f.volatility_60d, f.rsi_14, f.trading_value_ma20, {", ".join(f"coalesce({v}, 0.5) AS {k}" for k, v in _N.items())}, 0.5::DOUBLE AS reliability_score, 0.5::DOUBLE AS sentiment_score, f.risk_score AS r0, w.retail_overheat
  FROM feat f LEFT JOIN mfeat m USING (date, symbol) LEFT JOIN ffeat w USING (date, symbol) LEFT JOIN att a USING (date, symbol)),
mat AS (SELECT * EXCLUDE (r0, retail_overheat), round(coalesce({_mean('r0', '(CASE WHEN retail_overheat IS NOT NULL THEN greatest(0.0, least(1.0, retail_overheat)) END)', '(1 - supply_demand_score)')}, 0.5) + 1e-9, 6) AS risk_score FROM x0)
"""
MATRIX_COLUMNS = ["date", "symbol", "close", "ret_21d", "ret_63d", "volatility_60d", "rsi_14", "trading_value_ma20", *_N, "reliability_score", "sentiment_score", "risk_score"]
ALL = (FEAT, MARKET, FLOW, TARGET, CONS, ATT, MATRIX)


def matrix(p):
    """The feature matrix, staged once for every query on the same files."""
    return p.keep("matrix", lambda: _matrix(p))


def _matrix(p):
    return features.feature_matrix(p.prices, p.metrics, p.flows, analyst.consensus(p.reports)).select(*MATRIX_COLUMNS)


@query("f22_feature_matrix", "SELECT * FROM mat", *ALL)
def f22(p):
    return _matrix(p)


_PROB = " + ".join(f"{w}::DOUBLE * {c}" for c, w in features.FACTORS.items()) + f" + {features.RISK_WEIGHT}::DOUBLE * (1 - risk_score)"
BASE = f"""
pred AS (SELECT date, symbol, round(greatest(0.0, least(1.0, {_PROB})) + 1e-9, 6) AS pred_prob_top20, round({_rank('coalesce(ret_63d, 0.0)')} + 1e-9, 6) AS pred_return FROM mat)
"""


@query("m06_factor_baseline", "SELECT * FROM pred", *ALL, BASE)
def m06(p):
    return features.factor_baseline(matrix(p))


@query("f24_sequences", f"""SELECT date, symbol, len(s)::BIGINT AS steps, round(list_sum(s) + 1e-9, 6) AS total FROM (SELECT date, symbol, array_agg(rsi_14) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS s FROM feat) WHERE len(s) = 10""", FEAT)
def f24(p):
    seq = features.sequences(features.time_features(p.prices), ["rsi_14"], 10)
    return seq.select("date", "symbol", F.size("sequence").cast("long").alias("steps"), rounded(F.aggregate(F.flatten("sequence"), F.lit(0.0), lambda a, x: a + x)).alias("total"))


def _labels(h: int) -> str:
    return f"""
days AS (SELECT date, row_number() OVER (ORDER BY date) AS day FROM (SELECT DISTINCT date FROM px)),
e0 AS (SELECT date, symbol, CASE WHEN lag(day) OVER {_S} = day - 1 THEN close / lag(close) OVER {_S} - 1 END AS r FROM px JOIN days USING (date)),
e1 AS (SELECT date, coalesce(round(avg(r) + 1e-9, 10), 0.0) AS r FROM e0 GROUP BY date),
ewi AS (SELECT date, round(100 * exp(sum(ln(1 + r)) OVER (ORDER BY date)) + 1e-9, 6) AS close FROM e1),
lb AS (SELECT date, lead(close, {h}) OVER (ORDER BY date) / close - 1 AS b FROM ewi),
l0 AS (SELECT date, symbol, round(lead(close, {h}) OVER {_S} / close - 1 + 1e-9, 6) AS future_return, array_agg(close) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN CURRENT ROW AND {h} FOLLOWING) AS path FROM px),
l1 AS (SELECT date, symbol, future_return, round(CASE WHEN len(path) = {h + 1} THEN list_min([path[i] / list_max(path[1:i]) - 1 for i in range(1, {h + 2})]) END + 1e-9, 6) AS max_drawdown_forward, round(b + 1e-9, 6) AS benchmark_return FROM l0 LEFT JOIN lb USING (date)),
l2 AS (SELECT *, round(future_return - benchmark_return + 1e-9, 6) AS excess_return FROM l1),
lab AS (SELECT *, round({_rank('excess_return')} + 1e-9, 6) AS rank_quantile,
  excess_return IS NOT NULL AND row_number() OVER (PARTITION BY date ORDER BY excess_return DESC NULLS LAST, symbol) <= greatest(1, ceil(count(excess_return) OVER (PARTITION BY date) * 0.2::DOUBLE)) AS is_top20pct,
  excess_return IS NOT NULL AND row_number() OVER (PARTITION BY date ORDER BY excess_return ASC NULLS LAST, symbol) <= greatest(1, ceil(count(excess_return) OVER (PARTITION BY date) * 0.2::DOUBLE)) AS is_bottom20pct FROM l2)
"""


LABELS = _labels(21)


def label_frame(p, h: int = 21):
    return labels.forward_labels(p.prices, labels.equal_weight_index(p.prices), h)


@query("l01_forward_labels", "SELECT * EXCLUDE (max_drawdown_forward) FROM lab", LABELS)
def l01(p):
    return labels.forward_labels(p.prices, labels.equal_weight_index(p.prices), 21, drawdown=False).drop("max_drawdown_forward")


@query("l02_equal_weight_index", "SELECT date, round(ln(close) + 1e-9, 6) AS log_close FROM ewi", LABELS)
def l02(p):
    return labels.equal_weight_index(p.prices).select("date", rounded(F.log("close")).alias("log_close"))


@query("l03_forward_drawdown", "SELECT date, symbol, max_drawdown_forward FROM lab", LABELS)
def l03(p):
    return p.prices.select("date", "symbol", rounded(labels.forward_drawdown(21)).alias("max_drawdown_forward"))


@query("l04_named_benchmark_labels", f"""SELECT px.date, px.symbol, round(lead(px.close, 21) OVER (PARTITION BY px.symbol ORDER BY px.date) / px.close - 1 + 1e-9, 6) AS future_return, round(b.b + 1e-9, 6) AS benchmark_return FROM px LEFT JOIN (SELECT date, lead(close, 21) OVER (ORDER BY date) / close - 1 AS b FROM idx WHERE benchmark = 'MAIN') b USING (date)""")
def l04(p):
    return labels.forward_labels(p.prices, p.index.where("benchmark = 'MAIN'"), 21, drawdown=False).select("date", "symbol", "future_return", "benchmark_return")


_RIGHT = "(SELECT symbol AS s, report_date AS d, max(target) AS target FROM rep GROUP BY ALL)"


def _targets(p):
    return p.reports.groupBy("symbol", "report_date").agg(F.max("target").alias("target"))


_ASOF = {
    "j04_asof_backward": ("px.date >= r.d", {}),
    "j05_asof_lagged": ("px.date - 1 >= r.d", {"lag_days": 1}),
    "j06_first_on_or_after": ("px.date <= r.d", {"forward": True}),
    "j07_last_before": ("px.date > r.d", {"strict": True}),
}
for _name, (_cond, _kw) in _ASOF.items():

    @query(_name, f"SELECT px.date, px.symbol, r.d AS matched_at, r.target FROM px ASOF LEFT JOIN {_RIGHT} r ON px.symbol = r.s AND {_cond}")
    def _asof(p, kw=_kw):
        return asof.asof_join(p.prices.select("date", "symbol"), _targets(p), key="symbol", left_on="date", right_on="report_date", take=["target"], **kw)


@query("j08_trailing_range", "SELECT px.date, px.symbol, count(r.report_id) AS n, round(avg(r.target) + 1e-9, 6) AS target_mean FROM px LEFT JOIN rep r ON px.symbol = r.symbol AND r.report_date <= px.date AND r.report_date > px.date - 30 GROUP BY px.date, px.symbol")
def j08(p):
    right = p.reports.select("symbol", "report_date", "report_id", "target")
    return asof.trailing_join(p.prices.select("date", "symbol"), right, key="symbol", left_on="date", right_on="report_date", days=30, aggs=[F.count("report_id").alias("n"), rounded(F.avg("target")).alias("target_mean")])


_SEQ = ("rsi_14", "ret_21d", "ma_gap_20d")
SPLIT = f"""
sq0 AS (SELECT f.date, f.symbol, {", ".join(f"f.{c}" for c in _SEQ)}, l.is_top20pct AS label FROM feat f JOIN lab l USING (date, symbol) WHERE l.is_top20pct IS NOT NULL),
sq1 AS (SELECT max(date) FILTER (i = greatest(1, least(n, floor(n * 0.7 + 1e-9)))) AS train_end, max(date) FILTER (i = greatest(1, least(n, floor(n * 0.85 + 1e-9)))) AS valid_end FROM (SELECT date, row_number() OVER (ORDER BY date) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM sq0))),
sq2 AS (SELECT {", ".join(f"coalesce(median({c}), 0.0) AS m_{c}, coalesce(nullif(stddev_pop({c}), 0.0), 1.0) AS s_{c}" for c in _SEQ)} FROM sq0, sq1 WHERE date <= train_end),
sq3 AS (SELECT date, symbol, label, CASE WHEN date <= train_end THEN 'train' WHEN date <= valid_end THEN 'valid' ELSE 'test' END AS split, min(date) OVER w AS sequence_start, count(*) OVER w AS steps, {" + ".join(f"sum((coalesce({c}, m_{c}) - m_{c}) / s_{c}) OVER w" for c in _SEQ)} AS total
  FROM sq0, sq1, sq2 WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
"""


@query("f24_split_sequences", "SELECT date, symbol, label, split, sequence_start, steps, round(total + 1e-9, 5) AS total FROM sq3 WHERE steps = 10", FEAT, LABELS, SPLIT)
def f24_split(p):
    from quantloom.operators import sequences

    own = features.time_features(p.prices).select("date", "symbol", *_SEQ).join(label_frame(p).select("date", "symbol", "is_top20pct"), ["date", "symbol"])
    seq = sequences.sequences(own, list(_SEQ), 10, label="is_top20pct")
    return seq.select("date", "symbol", "label", "split", "sequence_start", F.size("sequence").cast("long").alias("steps"), rounded(F.aggregate(F.flatten("sequence"), F.lit(0.0), lambda a, x: a + x), 5).alias("total"))
