"""Rule tables, pooled ranks, table operators and streams on small fixtures."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quantloom.functions.windows import with_pooled_ranks
from quantloom.operators import rules
from quantloom.sources import tables
from quantloom.streaming import events


def test_pooled_ranks_match_a_plain_ranking(spark):
    rng = random.Random(4)
    values = [(i, None if i % 11 == 0 else rng.choice([float(rng.randint(0, 30)), 7.0, 7.0])) for i in range(400)]
    got = {r.k: r.rank for r in with_pooled_ranks(spark.createDataFrame(values, "k int, x double").repartition(5), rank="x").collect()}
    known = [x for _, x in values if x is not None]
    want = {k: None if x is None else (sum(y < x for y in known) + (sum(y == x for y in known) + 1) / 2) / len(known) for k, x in values}
    assert len(got) == 400 and all(got[k] == (None if w is None else pytest.approx(w)) for k, w in want.items())
    assert with_pooled_ranks(spark.createDataFrame([], "x double"), rank="x").count() == 0


def test_flags_of_each_rule(spark):
    calm = {"trading_value_ma20": 2e9, "is_managed": False, "is_suspended": None, "listing_age_days": None, "volatility_20d": None, "ret_5d": 0.1, "credit_balance_change_20d": 0.4, "retail_overheat_score": 0.1, "short_ratio_change_5d": 0.6, "foreign_net_5d": 1.0, "institution_net_5d": -1.0, "risk_score": 0.1, "rsi_14": 50.0, "liquidity_score": None}
    cases = [
        ({}, "", ""), ({"trading_value_ma20": None}, "low_liquidity", "exclude:low_liquidity"), ({"is_managed": True, "is_suspended": True}, "managed_stock,trading_suspended", "exclude:managed_stock,exclude:trading_suspended"),
        ({"listing_age_days": 10.0, "volatility_20d": 1.3, "ret_5d": 0.5}, "newly_listed,high_volatility,short_term_spike", "exclude:newly_listed,exclude:high_volatility,exclude:short_term_spike"),
        ({"retail_overheat_score": 0.8}, "retail_credit_overheat", "retail_overheat,exclude:retail_credit_overheat"), ({"foreign_net_5d": -1.0}, "short_foreign_sell_risk", "joint_selling,exclude:short_foreign_sell_risk"),
        ({"risk_score": 0.8, "rsi_14": 70.0, "liquidity_score": 0.1}, "", "volatility_or_liquidity,overbought,thin"),
    ]
    shape = ", ".join(f"{c} {'boolean' if c.startswith('is_') else 'double'}" for c in calm)
    rows = spark.createDataFrame([tuple((calm | change).values()) for change, _, _ in cases], shape).coalesce(1)
    got = [(",".join(r.exclusions), ",".join(r.risks)) for r in rules.with_flags(rows).collect()]
    assert got == [(a, b) for _, a, b in cases]
    bare = rules.with_flags(spark.createDataFrame([(1,)], "x int")).first()
    assert bare.exclusions == ["low_liquidity"] and bare.risks == ["exclude:low_liquidity"]


def test_causes_are_sorted_by_impact(spark):
    row = spark.createDataFrame([(0.03, 0.0, -0.02, 2e11, 0.01, 0.01, 0.01, -0.03)], "leader_a double, leader_b double, etf double, foreign_net double, fx double, broad double, growth double, index_low double")
    assert row.select(rules.move_causes().alias("c")).first().c == ["semiconductor", "market_shock", "etf_sync_down", "foreign_flow", "overseas_risk_on"]


def test_regime_of_a_panic_and_of_a_calm_day(spark):
    shape = "broad double, growth double, chips double, fear double, fear_change double, rate_bp double, fx double, futures double"
    days = spark.createDataFrame([(-0.03, -0.04, -0.05, 30.0, 0.3, 12.0, 0.02, -0.02), (0.0, 0.0, 0.0, 15.0, 0.0, 0.0, 0.0, 0.0), (None,) * 8], shape).coalesce(1)
    got = [(r.risk, r.regime, r.cash, len(r.signals)) for r in rules.regime_row(days).collect()]
    assert got == [(125, "panic", 0.5, 8), (0, "risk_on", 0.05, 0), (0, "risk_on", 0.05, 0)]


def test_registry_replaces_and_updates(spark):
    shape = "model_name string, model_type string, status string, production_weight double, shadow_mode boolean, fail_reason string, metrics_json string, updated_at date"
    day = dt.date(2024, 1, 1)
    entry = lambda name, metrics, at: (name, "trees", "experimental", 0.0, True, None, metrics, at)
    one = rules.register(spark.createDataFrame([entry("a", "old", day), entry("b", "b", day)], shape), spark.createDataFrame([entry("a", "new", day), entry("a", "newest", dt.date(2024, 2, 1)), entry("c", "c", day)], shape))
    assert {r.model_name: r.metrics_json for r in one.collect()} == {"a": "newest", "b": "b", "c": "c"}
    decided = spark.createDataFrame([("a", "accepted", 0.05, None, None, day), ("c", "rejected", 0.0, "excess", "m", day)], "model_name string, status string, production_weight double, fail_reason string, metrics_json string, updated_at date")
    got = {r.model_name: (r.status, r.production_weight, r.shadow_mode, r.metrics_json) for r in rules.update_status(one, decided).collect()}
    assert got == {"a": ("accepted", 0.05, False, "newest"), "b": ("experimental", 0.0, True, "b"), "c": ("rejected", 0.0, True, "m")}


def test_equity_summary_and_gate(spark):
    import math

    day = dt.date(2024, 1, 31)
    net = [0.10, -0.05, 0.02]
    equity = [sum(math.log(1 + x) for x in net[: i + 1]) for i in range(3)]
    runs = spark.createDataFrame([(day + dt.timedelta(days=30 * i), net[i], 0.01, 0.5, equity[i], [0.0, -0.05, -0.031][i]) for i in range(3)], "date date, net double, excess double, turnover double, log_equity double, drawdown double")
    s = rules.equity_summary(runs).first()
    mean, sd = sum(net) / 3, (sum((x - sum(net) / 3) ** 2 for x in net) / 3) ** 0.5
    assert s.periods == 3 and s.mdd == -0.05 and s.hit_ratio == pytest.approx(0.666667) and s.sharpe == pytest.approx(mean / sd * (365.25 / 30) ** 0.5, abs=1e-4)
    assert s.cagr == pytest.approx(math.exp(equity[-1] * 365.25 / 60) - 1, abs=1e-4)
    one = rules.equity_summary(runs.limit(1)).first()
    assert one.cagr is None and one.sharpe is None
    same = rules.gate_decision(rules.equity_summary(runs), rules.equity_summary(runs)).first()
    assert not same.accepted and same.reason == "excess" and same.production_weight == 0
    better = rules.gate_decision(rules.equity_summary(runs), rules.equity_summary(runs.withColumn("excess", F.lit(-0.01)).withColumn("net", F.lit(-0.01)))).first()
    assert better.accepted and better.reason == "accepted" and better.production_weight == 0.05


def test_missing_markers_and_snapshots(spark):
    raw = spark.createDataFrame([("a", "1.5"), ("b", "."), ("c", None), ("d", "NaN"), ("e", "x")], "s string, value string")
    assert [(r.s, r.close) for r in rules.macro_series(raw).collect()] == [("a", 1.5)]
    caps = spark.createDataFrame([(1, "x", 5.0), (2, "y", 6.0)], "date int, symbol string, cap double")
    found = spark.createDataFrame([(1, "x", 0.5), (3, "z", 0.7)], "date int, symbol string, eps double")
    last = spark.createDataFrame([("y", 9.0)], "symbol string, eps double")
    assert sorted(rules.merged_metrics(caps, found, last, ["eps"]).collect()) == [(1, "x", 5.0, 0.5), (2, "y", 6.0, 9.0), (3, "z", None, 0.7)]


def test_tables_and_delimited_files(spark, tmp_path):
    shape = StructType.fromDDL("a int, b string")
    assert tables.read_or_empty(spark, "no_such_table", shape).count() == 0
    tables.write_table(spark.createDataFrame([(1, "x")], shape), str(tmp_path / "t.parquet"))
    tables.register(spark, str(tmp_path), ["t"])
    assert tables.read_or_empty(spark, "t", shape).collect() == [(1, "x")]
    (tmp_path / "d.csv").write_text("a,b\n1,x\nq,y\n")
    assert sorted(tables.read_delimited(spark, str(tmp_path / "d.csv"), shape).collect(), key=str) == [(1, "x"), (None, "y")]


def test_stream_upserts_late_rows_and_restarts(spark, tmp_path):
    shape = "event_id long, ts timestamp, event_type string, value double"
    at = lambda day, hour: dt.datetime(2024, 1, day, hour)
    first = [(1, at(1, 3), "view", 1.0), (2, at(1, 9), "view", 2.0), (3, at(2, 1), "click", 3.0)]
    second = [(4, at(1, 20), "view", 4.0), (5, at(3, 5), "view", 5.0)]  # the first row is late
    spark.createDataFrame(first, shape).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    read = lambda: events.tumbling(events.read_stream(spark, str(tmp_path), "events"))
    show = lambda df: sorted((r.start.day, r.event_type, r.n, r.total) for r in df.collect())
    assert show(events.drain(read(), str(tmp_path / "s"), ["start", "event_type"])) == [(1, "view", 2, 3.0), (2, "click", 1, 3.0)]
    spark.createDataFrame(second, shape).coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    assert show(events.drain(read(), str(tmp_path / "s"), ["start", "event_type"])) == [(1, "view", 3, 7.0), (2, "click", 1, 3.0), (3, "view", 1, 5.0)]


def test_stream_deduplicates_within_the_watermark(spark, tmp_path):
    shape = "event_id long, ts timestamp, event_type string, value double"
    rows = [(1, dt.datetime(2024, 1, 1, 3), "view", 1.0), (1, dt.datetime(2024, 1, 1, 3, 20), "view", 1.0), (2, dt.datetime(2024, 1, 1, 4), "view", 2.0)]
    spark.createDataFrame(rows, shape).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    own = events.deduplicated(events.read_stream(spark, str(tmp_path), "events"))
    query = own.writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.event_id for r in spark.table("once").collect()) == [1, 2]


def test_walk_forward_learns_and_never_looks_ahead(spark):
    from quantloom.operators import models

    rng = random.Random(6)
    day = dt.date(2020, 1, 1)
    rows = []
    for i in range(60):
        for k in range(8):
            x = rng.uniform(-1, 1)
            rows.append((day + dt.timedelta(days=i), f"s{k}", x, x * 0.1, x > 0.6, False))
    own = spark.createDataFrame(rows, "date date, symbol string, x double, excess_return double, is_top20pct boolean, is_bottom20pct boolean")
    out = models.walk_forward(own, ["x"], step=15, least_dates=30, embargo=5).collect()
    assert len({r.date for r in out}) == 30 and len(out) == 240 and all((r.date - r.trained_to).days >= 6 for r in out)
    x = {(r[0], r[1]): r[2] for r in rows}
    assert all(r.prob_bottom == 0 for r in out)  # no training row has the class
    right = [(r.prob_top > 0.5) == (x[r.date, r.symbol] > 0.6) for r in out]
    assert sum(right) > 0.9 * len(right)
    assert models.walk_forward(own, ["x"], least_dates=100).count() == 0
    _, held = models.train_model(own, ["x"])
    assert {r.date for r in held.select("date").distinct().collect()} == {day + dt.timedelta(days=i) for i in range(48, 60)}
