"""Rule tables at full width: flags, causes, regime signals, equity summaries, gates and the model registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.columns import rounded, rule_array

# Limits of the exclusion rules.
LIMITS = {
    "min_trading_value_20d": 1_000_000_000.0, "min_listing_age_days": 180.0, "max_volatility_20d": 1.2, "max_ret_5d": 0.45,
    "retail_overheat_score": 0.7, "credit_balance_change_20d": 0.3, "short_ratio_change_5d": 0.5,
}


def _number(df: DataFrame, name: str, default: float) -> Column:
    """A column as a number; the default where it is missing or NULL."""
    return F.coalesce(F.col(name).cast("double"), F.lit(default)) if name in df.columns else F.lit(default)


def _flag(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name).cast("boolean"), F.lit(False)) if name in df.columns else F.lit(False)


def with_flags(rows: DataFrame, limits: dict[str, float] | None = None) -> DataFrame:
    """``rows`` with exclusions (8 rules) and risks (5 rules, then the exclusions marked as such), in order of the rules."""
    own, n = {**LIMITS, **(limits or {})}, lambda name, default=0.0: _number(rows, name, default)
    exclusions = rule_array(
        (n("trading_value_ma20") < own["min_trading_value_20d"], "low_liquidity"),
        (_flag(rows, "is_managed"), "managed_stock"),
        (_flag(rows, "is_suspended"), "trading_suspended"),
        (n("listing_age_days", float("inf")) < own["min_listing_age_days"], "newly_listed"),
        (n("volatility_20d") > own["max_volatility_20d"], "high_volatility"),
        (n("ret_5d") > own["max_ret_5d"], "short_term_spike"),
        ((n("credit_balance_change_20d") > own["credit_balance_change_20d"]) & (n("retail_overheat_score") > own["retail_overheat_score"]), "retail_credit_overheat"),
        ((n("short_ratio_change_5d") > own["short_ratio_change_5d"]) & (n("foreign_net_5d") < 0), "short_foreign_sell_risk"),
    )
    risks = rule_array(
        (n("risk_score") >= 0.8, "volatility_or_liquidity"),
        (n("rsi_14") >= 70, "overbought"),
        (n("liquidity_score", 1.0) < 0.2, "thin"),
        (n("retail_overheat_score") > 0.7, "retail_overheat"),
        ((n("foreign_net_5d") < 0) & (n("institution_net_5d") < 0), "joint_selling"),
    )
    return rows.withColumn("exclusions", exclusions).withColumn("risks", F.concat(risks, F.transform("exclusions", lambda x: F.concat(F.lit("exclude:"), x))))


# Causes of a move, their conditions and impacts.
CAUSES = (
    ("semiconductor", "leader_a > 0.02 or leader_b > 0.02", 0.20),
    ("etf_sync", "etf > 0.01", 0.20),
    ("foreign_flow", "foreign_net > {foreign}", 0.15),
    ("currency", "fx < -0.003", 0.10),
    ("overseas_risk_on", "broad > 0.005 and growth > 0.005", 0.10),
    ("market_shock", "index_low <= -0.02", 0.20),
    ("etf_sync_down", "etf < -0.01", 0.18),
    ("currency_down", "fx > 0.003", 0.10),
)


def move_causes(foreign: float = 100_000_000_000.0, most: int = 5) -> Column:
    """Names of the causes that hold, by impact, then in order of the rules; at most five."""
    made = [F.when(F.expr(rule.format(foreign=foreign)), F.struct(F.lit(-w).alias("w"), F.lit(i).alias("i"), F.lit(name).alias("n"))) for i, (name, rule, w) in enumerate(CAUSES)]
    return F.transform(F.slice(F.array_sort(F.filter(F.array(*made), lambda x: x.isNotNull())), 1, most), lambda x: x["n"])


# Regime signals as (name, column, limit, points, part); a limit below zero counts falls, one above zero rises.
SIGNALS = (
    ("broad_fall", "broad", -0.02, 20, "equity"), ("growth_fall", "growth", -0.03, 25, "equity"), ("chip_fall", "chips", -0.04, 25, "semiconductor"),
    ("fear_level", "fear", 25.0, 15, "volatility"), ("fear_rise", "fear_change", 0.20, 10, "volatility"), ("rate_rise", "rate_bp", 10.0, 10, "rate"),
    ("currency_fall", "fx", 0.01, 10, "fx"), ("futures_fall", "futures", -0.01, 10, "futures"),
)
PARTS = ("equity", "semiconductor", "volatility", "rate", "fx", "futures")


def regime_row(day: DataFrame, limits: dict[str, float] | None = None) -> DataFrame:
    """``day`` with points of each part, their sum, the regime, its cash ratio and the signals that hold."""
    limit = {name: at for name, _, at, _, _ in SIGNALS} | (limits or {})
    holds = {name: (F.col(c) <= limit[name]) if at < 0 else (F.col(c) >= limit[name]) for name, c, at, _, _ in SIGNALS}
    zero = F.lit(0)
    parts = {part: sum((F.when(holds[name], points).otherwise(0) for name, _, _, points, p in SIGNALS if p == part), zero) for part in PARTS}
    own = day.withColumns({f"{part}_score": x for part, x in parts.items()})
    own = own.withColumn("risk", sum((F.col(f"{part}_score") for part in PARTS), zero))
    step = lambda *values: F.when(F.col("risk") >= 70, values[0]).when(F.col("risk") >= 45, values[1]).when(F.col("risk") >= 20, values[2]).otherwise(values[3])
    return own.withColumn("regime", step("panic", "risk_off", "neutral", "risk_on")).withColumn("cash", step(0.50, 0.30, 0.15, 0.05)).withColumn("signals", rule_array(*[(holds[name], name) for name, *_ in SIGNALS]))


def equity_summary(runs: DataFrame, *keys: str) -> DataFrame:
    """One row for each key: periods, growth a year, worst drawdown, Sharpe ratio by the median gap, hits, excess and turnover.

    Without a known gap a year has 12 periods; fewer than two periods have no growth.
    """
    time = Window.partitionBy(*keys).orderBy("date")  # rebalance dates: one row each
    own = runs.withColumn("gap", F.datediff("date", F.lag("date").over(time)))
    gap = F.median("gap")
    per_year = F.when(gap > 0, 365.25 / gap).otherwise(12.0)
    years = F.datediff(F.max("date"), F.min("date")) / 365.25
    spread = F.stddev_pop("net")
    return own.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("periods"),
        rounded(F.when(years > 0, F.exp(F.max_by("log_equity", "date") / years) - 1), 4).alias("cagr"),
        rounded(F.min("drawdown")).alias("mdd"),
        rounded(F.when(spread > 1e-12, F.avg("net") / spread * F.sqrt(per_year)), 4).alias("sharpe"),
        rounded(F.avg((F.col("net") > 0).cast("double"))).alias("hit_ratio"),
        rounded(F.avg("excess")).alias("avg_excess"),
        rounded(F.avg("turnover")).alias("avg_turnover"),
        rounded(F.avg("net")).alias("avg_net"),
    )


# What a candidate must reach against its baseline.
GATE = {"excess": 0.01, "hit": 0.03, "mdd": 0.02, "turnover": 1.30, "cost": 0.0}


def gate_decision(candidate: DataFrame, baseline: DataFrame, limits: dict[str, float] | None = None) -> DataFrame:
    """accepted, the first failed of five checks, the gains, and the production weight."""
    own = {**GATE, **(limits or {})}
    cols = ["avg_excess", "hit_ratio", "mdd", "avg_turnover", "avg_net"]
    both = candidate.select(*cols).join(F.broadcast(baseline.select(*[F.col(c).alias(f"b_{c}") for c in cols])))  # one row each
    n = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    gain = {c: n(c) - n(f"b_{c}") for c in ("avg_excess", "hit_ratio", "avg_net")}
    worse, ratio = n("b_mdd") - n("mdd"), n("avg_turnover") / F.greatest(n("b_avg_turnover"), F.lit(1e-6))
    failed = rule_array(
        (gain["avg_excess"] < own["excess"], "excess"), (gain["hit_ratio"] < own["hit"], "hit_ratio"), (worse > own["mdd"], "drawdown"),
        (ratio > own["turnover"], "turnover"), (gain["avg_net"] < own["cost"], "cost_adjusted"),
    )
    return both.select(
        (F.size(failed) == 0).alias("accepted"), F.coalesce(F.get(failed, F.lit(0)), F.lit("accepted")).alias("reason"), rounded(gain["avg_excess"]).alias("excess_gain"), rounded(gain["hit_ratio"]).alias("hit_gain"),
        rounded(worse).alias("mdd_worsening"), rounded(ratio).alias("turnover_ratio"), F.when(F.size(failed) == 0, 0.05).otherwise(0.0).alias("production_weight"),
    )


# The least number of samples, how much worse a drawdown may be, and the weight of an accepted model.
LEAST_SAMPLES, WORSE_DRAWDOWN, SUGGESTED_WEIGHT, MOST_WEIGHT = 200, 1.2, 0.1, 0.3


def gatekeeper(performance: DataFrame, baseline: str, least: int = LEAST_SAMPLES) -> DataFrame:
    """``performance`` with gate_status, production_weight and reasons: each model against the baseline model of its horizon.

    The baseline's latest row counts; horizons without one have no decision.
    A missing measure counts as 0, a missing rank correlation rejects nothing.
    """
    cols = ("precision_top", "avg_excess", "mdd")
    latest = F.row_number().over(Window.partitionBy("horizon").orderBy(F.desc("eval_date"), F.desc("model_version")))
    base = performance.where(F.col("model_name") == baseline).withColumn("__n", latest).where("__n = 1").select("horizon", *[F.coalesce(c, F.lit(0.0)).alias(f"__{c}") for c in cols])
    n = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    own = performance.join(base, "horizon")
    failed = rule_array(
        (n("sample_count") < least, "few_samples"), (n("precision_top") < F.col("__precision_top"), "precision"), (n("avg_excess") < F.col("__avg_excess"), "excess"), (F.col("rank_ic") < 0, "rank_correlation"),
        (n("mdd") < F.col("__mdd") * WORSE_DRAWDOWN, "drawdown"),
    )
    is_base, suggested = F.col("model_name") == baseline, F.col("suggested_weight") if "suggested_weight" in performance.columns else F.lit(None).cast("double")
    own = own.withColumn("reasons", F.when(is_base, F.array(F.lit("baseline"))).otherwise(failed))
    status = F.when(is_base, "production").when(F.size(failed) > 0, "rejected").otherwise("accepted")
    weight = F.when(is_base, 1.0).when(F.size(failed) > 0, 0.0).otherwise(F.least(F.coalesce(suggested, F.lit(SUGGESTED_WEIGHT)), F.lit(MOST_WEIGHT)))
    return own.withColumns({"gate_status": status, "production_weight": weight}).drop(*[f"__{c}" for c in cols])


def register(registry: DataFrame, entries: DataFrame, keys: tuple[str, ...] = ("model_name",)) -> DataFrame:
    """The registry with entries added or, by key, replaced; of several entries with a key the latest counts."""
    latest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("updated_at"), F.desc(F.xxhash64(*entries.columns))))
    one = entries.withColumn("__r", latest).where("__r = 1").drop("__r")
    return registry.join(one, list(keys), "left_anti").unionByName(one.select(*registry.columns))


def update_status(registry: DataFrame, decisions: DataFrame) -> DataFrame:
    """Status, weight, reason and time of the decided models; metrics only where a decision has some."""
    new = decisions.select("model_name", *[F.col(c).alias(f"__{c}") for c in ("status", "production_weight", "fail_reason", "metrics_json", "updated_at")])
    both = registry.join(new, "model_name", "left")
    decided = F.col("__status").isNotNull()
    put = {c: F.when(decided, F.col(f"__{c}")).otherwise(F.col(c)) for c in ("status", "production_weight", "fail_reason", "updated_at")}
    put["metrics_json"] = F.coalesce("__metrics_json", "metrics_json")
    put["shadow_mode"] = F.when(decided, F.col("__status") != "accepted").otherwise(F.col("shadow_mode"))
    return both.select(*[put[c].alias(c) if c in put else F.col(c) for c in registry.columns])


def macro_series(raw: DataFrame, value: str = "value") -> DataFrame:
    """Observations with a number; the marker for a missing one, or anything else, drops the row."""
    return raw.withColumn("close", F.col(value).try_cast("double")).where("close is not null and not isnan(close)").drop(value)


def merged_metrics(caps: DataFrame, fundamentals: DataFrame, snapshots: DataFrame, columns: list[str]) -> DataFrame:
    """Market values and fundamentals by date and symbol, from either side; what is missing comes from the symbol's snapshot.

    Dated snapshots count from their date on, the last one up to a row's date; undated ones hold for all dates.
    """
    from quantloom.operators.asof import Latest, carry

    both = caps.join(fundamentals, ["date", "symbol"], "full_outer")
    own = snapshots.select("symbol", *(["date"] if "date" in snapshots.columns else []), *[F.col(c).alias(f"__{c}") for c in columns])
    if "date" in snapshots.columns:
        known = carry(both, key="symbol", on="date", latest={"snapshot": Latest(own.withColumnRenamed("date", "__at"), "__at", [f"__{c}" for c in columns])})
    else:
        known = both.join(own, "symbol", "left")
    return known.select("date", "symbol", *[c for c in caps.columns if c not in ("date", "symbol")], *[F.coalesce(c, f"__{c}").alias(c) for c in columns])
