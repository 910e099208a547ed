"""Queries over the rule tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.functions.columns import rounded
from quantloom.functions.windows import by, change, series
from quantloom.operators import analyst, features
from quantloom.operators import decisions as D
from quantloom.operators import market as M
from quantloom.operators import rules as R
from quantloom.sources import tables as S

from .decisions import BT, BT2, CTES, labelled
from .features import FEAT, FLOW, OUT, SCORES
from .market import BARS, CREDIT, _credit
from .registry import query

LIMITS = {"min_trading_value_20d": 20000.0, "max_volatility_20d": 8.0, "credit_balance_change_20d": 0.05}


def _names(*rules: tuple[str, str]) -> str:
    return "[x for x in [" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for c, n in rules) + "] if x IS NOT NULL]"


_EXCLUDED = _names(
    ("coalesce(trading_value_ma20, 0) < 20000", "low_liquidity"), ("managed", "managed_stock"), ("suspended", "trading_suspended"), ("age < 180", "newly_listed"), ("volatility_20d > 8", "high_volatility"), ("ret_5d > 0.45", "short_term_spike"),
    ("credit > 0.05 AND retail_overheat > 0.7", "retail_credit_overheat"), ("shorts > 0.5 AND foreign_net_5d < 0", "short_foreign_sell_risk"),
)
_RISKS = _names(("risk_score >= 0.8", "volatility_or_liquidity"), ("rsi_14 >= 70", "overbought"), ("coalesce(liquidity_score, 1) < 0.2", "thin"), ("retail_overheat > 0.7", "retail_overheat"), ("foreign_net_5d < 0 AND institution_net_5d < 0", "joint_selling"))
FLAGGED = """
y0 AS (SELECT date, symbol, close / lag(close, 5) OVER s - 1 AS ret_5d, date_diff('day', min(date) OVER (PARTITION BY symbol), date) AS age, volume = 1 AS suspended, CAST(symbol AS INT) = 13 AS managed FROM px WINDOW s AS (PARTITION BY symbol ORDER BY date)),
y1 AS (SELECT date, symbol, share - lag(share, 5) OVER (PARTITION BY symbol ORDER BY date) AS shorts FROM (SELECT date, symbol, abs(retail_net_value) / nullif(trading_value, 0) AS share FROM flow JOIN px USING (date, symbol))),
y2 AS (SELECT date, delta_20 / nullif(balance - delta_20, 0) AS credit FROM cd WHERE market = 'O'),
y AS (SELECT * FROM feat JOIN ffeat USING (date, symbol) JOIN y0 USING (date, symbol) JOIN y1 USING (date, symbol) LEFT JOIN y2 USING (date))
"""


@query("m11_m12_all_flags", f"SELECT date, symbol, array_to_string({_EXCLUDED}, ',') AS exclusions, array_to_string(list_concat({_RISKS}, ['exclude:' || x for x in {_EXCLUDED}]), ',') AS risks FROM y", FEAT, FLOW, CREDIT, FLAGGED)
def m11_all(p):
    keys = ["date", "symbol"]
    px = p.prices.select(
        *keys, change(F.col("close"), 5).alias("ret_5d"), F.datediff("date", F.min("date").over(by("symbol"))).alias("listing_age_days"),
        (F.col("volume") == 1).alias("is_suspended"), (F.col("symbol").cast("int") == 13).alias("is_managed"),
    )
    share = p.facts.select(*keys, F.try_divide(F.abs("retail_net_value"), F.col("trading_value")).alias("share"))
    shorts = share.select(*keys, (F.col("share") - F.lag("share", 5).over(series())).alias("short_ratio_change_5d"))
    credit = S.with_deltas(_credit(p), "balance").where("market = 'O'").select("date", F.try_divide(F.col("delta_20"), F.col("balance") - F.col("delta_20")).alias("credit_balance_change_20d"))
    flows = features.flow_features(p.flows, p.prices, p.metrics).withColumnRenamed("retail_overheat", "retail_overheat_score")
    own = features.price_features(p.prices).join(flows, keys).join(px, keys).join(shorts, keys).join(credit, "date", "left")
    return R.with_flags(own, LIMITS).select(*keys, F.array_join("exclusions", ",").alias("exclusions"), F.array_join("risks", ",").alias("risks"))


_REGION = {"etf": "R0", "broad": "R1", "growth": "R2", "fx": "R3", "leader_a": "R4"}
CAUSED = f"""
z0 AS (SELECT trade_date AS date, {", ".join(f"max(return_1d) FILTER (symbol = '{s}') AS {n}" for n, s in _REGION.items())}, max(return_5d) FILTER (symbol = 'R4') AS leader_b FROM bars GROUP BY trade_date),
z1 AS (SELECT date, round(sum(foreign_net_value) + 1e-9, 2) AS foreign_net FROM flow GROUP BY date),
z2 AS (SELECT date, min(r) AS index_low FROM (SELECT date, round(close / lag(close) OVER (PARTITION BY benchmark ORDER BY date) - 1 + 1e-9, 6) AS r FROM idx) GROUP BY date),
z AS (SELECT * FROM z0 JOIN z1 USING (date) JOIN z2 USING (date))
"""
_CAUSED = ", ".join(f"CASE WHEN {rule.format(foreign=50000.0)} THEN {{'w': {-w}::DOUBLE, 'i': {i}, 'n': '{n}'}} END" for i, (n, rule, w) in enumerate(R.CAUSES))


@query("g10_all_causes", f"SELECT date, array_to_string([x.n for x in list_slice(list_sort([x for x in [{_CAUSED}] if x IS NOT NULL]), 1, 5)], ',') AS causes FROM z", BARS, CAUSED)
def g10_all(p):
    bars = M.daily_bars(p.world)
    at = lambda s, c: F.max(F.when(F.col("symbol") == s, F.col(c)))
    day = bars.groupBy(F.col("trade_date").alias("date")).agg(*[at(s, "return_1d").alias(n) for n, s in _REGION.items()], at("R4", "return_5d").alias("leader_b"))
    net = p.flows.groupBy("date").agg(rounded(F.sum("foreign_net_value"), 2).alias("foreign_net"))
    low = p.index.withColumn("r", rounded(change(F.col("close"), 1, key="benchmark"))).groupBy("date").agg(F.min("r").alias("index_low"))
    own = day.join(net, "date").join(low, "date")
    return own.select("date", F.array_join(R.move_causes(50000.0), ",").alias("causes"))


_LIMIT = {"fear_level": 112.0, "rate_rise": 100.0}
_SIG = {"broad": ("R0", "return_1d"), "growth": ("R1", "return_1d"), "chips": ("R2", "return_1d"), "fear": ("R3", "close"), "fear_change": ("R3", "return_1d"), "fx": ("R4", "return_1d"), "futures": ("R1", "return_5d")}
_HOLD = {n: f"coalesce({c} {'<=' if at < 0 else '>='} {_LIMIT.get(n, at)}, false)" for n, c, at, _, _ in R.SIGNALS}
_PART = ", ".join(" + ".join(f"CASE WHEN {_HOLD[n]} THEN {k} ELSE 0 END" for n, _, _, k, q in R.SIGNALS if q == part) + f" AS {part}_score" for part in R.PARTS)
REGIME = f"""
q0 AS (SELECT *, round((close - lag(close) OVER (PARTITION BY symbol ORDER BY trade_date)) * 100 + 1e-9, 4) AS bp FROM bars),
q1 AS (SELECT trade_date, {", ".join(f"max({c}) FILTER (symbol = '{s}') AS {n}" for n, (s, c) in _SIG.items())}, max(bp) FILTER (symbol = 'R4') AS rate_bp FROM q0 GROUP BY trade_date),
q2 AS (SELECT *, {_PART}, {_names(*[(h, n) for n, h in _HOLD.items()])} AS signals FROM q1),
q3 AS (SELECT *, {" + ".join(f"{x}_score" for x in R.PARTS)} AS risk FROM q2)
"""


@query("g14_regime_signals", f"SELECT trade_date, {', '.join(f'{x}_score' for x in R.PARTS)}, risk, CASE WHEN risk >= 70 THEN 'panic' WHEN risk >= 45 THEN 'risk_off' WHEN risk >= 20 THEN 'neutral' ELSE 'risk_on' END AS regime, CASE WHEN risk >= 70 THEN 0.5::DOUBLE WHEN risk >= 45 THEN 0.3::DOUBLE WHEN risk >= 20 THEN 0.15::DOUBLE ELSE 0.05::DOUBLE END AS cash, array_to_string(signals, ',') AS signals FROM q3", BARS, REGIME)
def g14_all(p):
    bars = M.daily_bars(p.world)
    step = F.col("close") - F.lag("close").over(series(order="trade_date"))
    own = bars.withColumn("bp", rounded(step * 100, 4))
    at = lambda s, c: F.max(F.when(F.col("symbol") == s, F.col(c)))
    day = own.groupBy("trade_date").agg(*[at(s, c).alias(n) for n, (s, c) in _SIG.items()], at("R4", "bp").alias("rate_bp"))
    out = R.regime_row(day, _LIMIT)
    return out.select("trade_date", *[f"{x}_score" for x in R.PARTS], "risk", "regime", "cash", F.array_join("signals", ",").alias("signals"))


def _summary(tag: str = "") -> str:
    return f"""
es{tag} AS (SELECT count(*) AS periods, round(CASE WHEN date_diff('day', min(date), max(date)) > 0 THEN exp(arg_max(log_equity, date) / (date_diff('day', min(date), max(date)) / 365.25::DOUBLE)) - 1 END + 1e-9, 4) AS cagr, round(min(drawdown) + 1e-9, 6) AS mdd,
  round(CASE WHEN stddev_pop(net) > 1e-12 THEN avg(net) / stddev_pop(net) * sqrt(CASE WHEN median(gap) > 0 THEN 365.25::DOUBLE / median(gap) ELSE 12.0 END) END + 1e-9, 4) AS sharpe, round(avg((net > 0)::INT::DOUBLE) + 1e-9, 6) AS hit_ratio,
  round(avg(excess) + 1e-9, 6) AS avg_excess, round(avg(turnover) + 1e-9, 6) AS avg_turnover, round(avg(net) + 1e-9, 6) AS avg_net FROM (SELECT *, date_diff('day', lag(date) OVER (ORDER BY date), date) AS gap FROM bt{tag}))
"""


def _runs(p, by: str = "final_score"):
    return D.topk_backtest(labelled(p), k=5, by=by)


@query("b04_equity_summary", "SELECT * FROM es", *CTES, BT, _summary())
def b04_all(p):
    return R.equity_summary(_runs(p))


@query(
    "b06_gate_decision",
    """SELECT len(f) = 0 AS accepted, coalesce(f[1], 'accepted') AS reason, round(x + 1e-9, 6) AS excess_gain, round(h + 1e-9, 6) AS hit_gain, round(d + 1e-9, 6) AS mdd_worsening, round(t + 1e-9, 6) AS turnover_ratio, CASE WHEN len(f) = 0 THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END AS production_weight FROM (
SELECT *, [y for y in [CASE WHEN x < 0.01 THEN 'excess' END, CASE WHEN h < 0.03 THEN 'hit_ratio' END, CASE WHEN d > 0.02 THEN 'drawdown' END, CASE WHEN t > 1.3 THEN 'turnover' END, CASE WHEN c < 0 THEN 'cost_adjusted' END] if y IS NOT NULL] AS f FROM (
SELECT a.avg_excess - b.avg_excess AS x, a.hit_ratio - b.hit_ratio AS h, b.mdd - a.mdd AS d, a.avg_turnover / greatest(b.avg_turnover, 1e-6) AS t, a.avg_net - b.avg_net AS c FROM es a, es_b b))""",
    *CTES, BT, BT2, _summary(), _summary("_b"),
)
def b06_all(p):
    return R.gate_decision(R.equity_summary(_runs(p)), R.equity_summary(_runs(p, "momentum_score")))


@query(
    "m09_model_registry",
    """SELECT r.broker AS model_name, r.model_type, coalesce(d.status, 'experimental') AS status, coalesce(d.weight, 0.0) AS production_weight, CASE WHEN d.status IS NULL THEN true ELSE d.status <> 'accepted' END AS shadow_mode, d.reason AS fail_reason, coalesce(d.metrics, r.n::VARCHAR) AS metrics_json, coalesce(d.at, r.at) AS updated_at
FROM (SELECT broker, 'consensus' AS model_type, count(*) AS n, max(report_date) AS at FROM rep GROUP BY broker) r
LEFT JOIN (SELECT broker, CASE WHEN q >= 0.5 THEN 'accepted' ELSE 'rejected' END AS status, CASE WHEN q >= 0.5 THEN 0.05::DOUBLE ELSE 0.0 END AS weight, CASE WHEN q < 0.5 THEN 'reliability' END AS reason, CASE WHEN q >= 0.5 THEN k::VARCHAR END AS metrics, DATE '2002-01-01' AS at
  FROM (SELECT broker, avg(reliability) AS q, count(*) AS k FROM ascore GROUP BY broker HAVING count(*) >= 2)) d USING (broker)""",
    OUT, SCORES,
)
def m09_all(p):
    shape = "model_name string, model_type string, status string, production_weight double, shadow_mode boolean, fail_reason string, metrics_json string, updated_at date"
    none = F.lit(None).cast("string")
    entry = lambda n, at: [F.col("broker").alias("model_name"), F.lit("consensus").alias("model_type"), F.lit("experimental").alias("status"), F.lit(0.0).alias("production_weight"), F.lit(True).alias("shadow_mode"), none.alias("fail_reason"), n.cast("string").alias("metrics_json"), at.alias("updated_at")]
    first = p.reports.groupBy("broker").agg(F.min("report_date").alias("at")).select(*entry(F.lit(0), F.col("at")))
    latest = p.reports.groupBy("broker").agg(F.count(F.lit(1)).alias("n"), F.max("report_date").alias("at")).select(*entry(F.col("n"), F.col("at")))
    registry = R.register(R.register(p.spark.createDataFrame([], shape), first), latest)
    scores = analyst.analyst_scores(analyst.outcomes(p.reports, p.prices, p.index.where("benchmark = 'MAIN'")), reports=p.reports).groupBy("broker").agg(F.avg("reliability").alias("q"), F.count(F.lit(1)).alias("k")).where("k >= 2")
    good = F.col("q") >= 0.5
    decided = scores.select(
        F.col("broker").alias("model_name"), F.when(good, "accepted").otherwise("rejected").alias("status"), F.when(good, 0.05).otherwise(0.0).alias("production_weight"),
        F.when(~good, "reliability").alias("fail_reason"), F.when(good, F.col("k").cast("string")).alias("metrics_json"), F.lit("2002-01-01").cast("date").alias("updated_at"),
    )
    return R.update_status(registry, decided)


@query("s22_macro_series", "SELECT event_id, CAST(ts AS DATE) AS trade_date, event_type AS symbol, value AS close FROM events WHERE event_type <> 'error' AND value IS NOT NULL")
def s22(p):
    raw = p.table("events").select("event_id", F.to_date("ts").alias("trade_date"), F.col("event_type").alias("symbol"), F.when(F.col("event_type") == "error", ".").otherwise(F.col("value").cast("string")).alias("value"))
    return R.macro_series(raw)


@query("s13_merged_metrics", """SELECT m.date, m.symbol, market_cap, coalesce(m.target, s.target) AS target, coalesce(m.n, s.n) AS n FROM (SELECT date, symbol, market_cap, f.target, f.n FROM met FULL JOIN (SELECT report_date AS date, symbol, max(target) AS target, count(*) AS n FROM rep GROUP BY ALL) f USING (date, symbol)) m
ASOF LEFT JOIN (SELECT report_date AS d, symbol AS k, max(target) AS target, count(*) AS n FROM rep GROUP BY ALL) s ON k = m.symbol AND m.date >= d""")
def s13(p):
    found = p.reports.groupBy(F.col("report_date").alias("date"), "symbol").agg(F.max("target").alias("target"), F.count(F.lit(1)).alias("n"))
    return R.merged_metrics(p.metrics.select("date", "symbol", "market_cap"), found, found, ["target", "n"])
