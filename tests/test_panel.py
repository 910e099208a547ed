"""Hand-made cases, look-ahead guards and twins of the panel operators."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from quantloom.functions.columns import clip, nearest_horizon, norm_cdf, row_mean, zfill
from quantloom.functions.windows import pct_rank, run_length
from quantloom.operators import decisions, features, labels, market
from quantloom.operators.asof import asof_join, trailing_join
from quantloom.sources import tables

D0 = dt.date(2024, 1, 1)


def day(i):
    return D0 + dt.timedelta(days=i)


def panel(spark, n=80, symbols=("000001", "000002", "000003"), tweak=lambda s, i, c: c):
    rows = [(day(i), s, float(tweak(s, i, 100 + i * (k + 1) + 7 * math.sin(i + k))), 1000.0 + i, 1e5 + 10 * i * (k + 1)) for k, s in enumerate(symbols) for i in range(n)]
    return spark.createDataFrame(rows, "date date, symbol string, close double, volume double, trading_value double")


def by_key(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def test_scalar_rules(spark):
    row = spark.range(1).select(
        clip(F.lit(None).cast("double")).alias("a"), clip(F.lit(3.0)).alias("b"), row_mean(F.lit(None).cast("double"), F.lit(1.0), F.lit(2.0)).alias("c"), zfill(F.lit("1234567"), 6).alias("d"), zfill(F.lit("12"), 6).alias("e"),
        norm_cdf(F.lit(1.96)).alias("f"), nearest_horizon(F.lit(100)).alias("g"), row_mean(F.lit(None).cast("double")).alias("h"),
    ).first()
    assert (row.a, row.b, row.c, row.d, row.e, row.g, row.h) == (None, 1.0, 1.5, "1234567", "000012", "6M", None)
    assert row.f == pytest.approx(0.9750021, abs=1e-6)


def test_pct_rank_averages_ties_and_skips_nulls(spark):
    rows = [(1, 5.0), (2, 1.0), (3, 5.0), (4, None), (5, 3.0)]
    got = {r.k: r.p for r in spark.createDataFrame(rows, "k int, x double").select("k", pct_rank(F.col("x")).alias("p")).collect()}
    assert got == {1: 0.875, 2: 0.25, 3: 0.875, 4: None, 5: 0.5}


def test_run_length(spark):
    rows = [(day(i), "a", f) for i, f in enumerate([True, True, False, True, True, True])]
    got = [r.n for r in spark.createDataFrame(rows, "date date, symbol string, f boolean").select("date", run_length(F.col("f")).alias("n")).orderBy("date").collect()]
    assert got == [1, 2, 0, 1, 2, 3]


@pytest.mark.parametrize(("kw", "want"), [({}, [None, 1, 1, 2]), ({"strict": True}, [None, None, 1, 1]), ({"forward": True}, [1, 1, 2, 2]), ({"forward": True, "strict": True}, [1, 2, 2, None]), ({"lag_days": 1}, [None, None, 1, 1])])
def test_asof_join(spark, kw, want):
    left = spark.createDataFrame([("k", day(i)) for i in (0, 1, 2, 3)], "key string, at date")
    right = spark.createDataFrame([("k", day(1), 1), ("k", day(3), 2), ("other", day(0), 9)], "key string, on date, v int")
    got = [r.v for r in asof_join(left, right, key="key", left_on="at", right_on="on", take=["v"], **kw).orderBy("at").collect()]
    assert got == want


def test_trailing_join_matches_brute_force(spark):
    left = [("k", day(i)) for i in range(0, 60, 7)]
    right = [("k", day(i * i % 61), i) for i in range(40)]
    out = trailing_join(spark.createDataFrame(left, "key string, at date"), spark.createDataFrame(right, "key string, on date, v int"), key="key", left_on="at", right_on="on", days=10, aggs=[F.count("v").alias("n"), F.sum("v").alias("s")])
    got = {r["at"]: (r.n, r.s) for r in out.collect()}
    for _, at in left:
        inside = [v for _, on, v in right if at - dt.timedelta(days=10) < on <= at]
        assert got[at] == (len(inside), sum(inside) if inside else None)


def test_features_never_look_ahead(spark):
    before = by_key(features.time_features(panel(spark)), "symbol", "date")
    after = by_key(features.time_features(panel(spark, tweak=lambda s, i, c: c * 3 if i > 50 else c)), "symbol", "date")
    assert all(before[k] == after[k] for k in before if k[1] <= day(50))
    assert any(before[k] != after[k] for k in before)


def test_rsi_of_a_monotone_rise_is_neutral(spark):
    rows = [(day(i), "a", 100.0 + i, 1.0, 1.0) for i in range(20)]
    got = features.time_features(spark.createDataFrame(rows, "date date, symbol string, close double, volume double, trading_value double"))
    assert {r.rsi_14 for r in got.collect()} == {50.0}


def test_row_order_does_not_matter(spark):
    a = by_key(features.price_features(panel(spark, 70)), "symbol", "date")
    b = by_key(features.price_features(panel(spark, 70).orderBy(F.rand(3))), "symbol", "date")
    assert a == b


def test_labels_by_hand(spark):
    closes = {"000001": [100, 80, 120, 130, 125, 140], "000002": [100, 105, 110, 90, 95, 100]}
    rows = [(day(i), s, float(c), 1.0, 1.0) for s, cs in closes.items() for i, c in enumerate(cs)]
    prices = spark.createDataFrame(rows, "date date, symbol string, close double, volume double, trading_value double")
    index = spark.createDataFrame([(day(i), 100.0 + i) for i in range(6)], "date date, close double")
    got = by_key(labels.forward_labels(prices, index, 2), "symbol", "date")["000001", D0]
    assert (got.future_return, got.benchmark_return, got.excess_return, got.max_drawdown_forward) == pytest.approx((0.2, 0.02, 0.18, -0.2), abs=1e-6)
    assert got.is_top20pct and not got.is_bottom20pct
    last = by_key(labels.forward_labels(prices, index, 2), "symbol", "date")["000001", day(5)]
    assert last.excess_return is None and last.is_top20pct is False


def test_index_skips_gaps(spark):
    rows = [(day(0), "a", 100.0), (day(1), "a", 110.0), (day(0), "b", 100.0), (day(2), "b", 300.0), (day(2), "a", 121.0)]
    got = [r.close for r in labels.equal_weight_index(spark.createDataFrame(rows, "date date, symbol string, close double")).orderBy("date").collect()]
    assert got == pytest.approx([100.0, 110.0, 121.0], abs=1e-5)


def test_topk_backtest_turnover_and_cost(spark):
    rows = [(day(0), "a", 0.9, 0.10), (day(0), "b", 0.5, 0.0), (day(40), "a", 0.1, 0.0), (day(40), "b", 0.8, 0.02)]
    own = spark.createDataFrame(rows, "date date, symbol string, final_score double, future_return double").withColumn("benchmark_return", F.lit(0.0)).withColumn("is_top20pct", F.col("final_score") > 0.5)
    got = decisions.topk_backtest(own, k=1).orderBy("date").collect()
    assert [r.turnover for r in got] == [1.0, 1.0]
    assert [r.net for r in got] == pytest.approx([0.097, 0.017], abs=1e-6)
    assert math.exp(got[1].log_equity) == pytest.approx(1.097 * 1.017, abs=1e-4)


def test_long_short_legs_are_disjoint(spark):
    rows = [(day(i % 3), m, f"{m}{k}", (k * 7 % 10) / 10) for i in range(3) for m in "AB" for k in range(6)]
    own = spark.createDataFrame(rows, "date date, market string, symbol string, final_score double").withColumn("future_return", F.lit(0.01))
    legs = decisions.long_short(own).collect()
    longs, shorts = ({(r.date, r.symbol) for r in legs if r.side == s} for s in ("long", "short"))
    assert not longs & shorts and len(longs) == 18 and len(shorts) == 12
    assert sum(r.weight for r in legs) == pytest.approx(0, abs=1e-4)


def test_capped_portfolio(spark):
    rows = [(D0, f"s{i}", "one", 0.9 - i / 100) for i in range(5)]
    got = decisions.capped_portfolio(spark.createDataFrame(rows, "date date, symbol string, sector string, final_score double")).collect()
    assert sum(r.weight for r in got) <= 0.3001 and got[0].cash >= 0.6999


def test_later_posts_do_not_count(spark):
    rows = [("T1", dt.datetime(2024, 1, 2, h), 0.5, 0.3, 1.0, "k") for h in (1, 5)]
    schema = "ticker string, ts timestamp, sentiment double, urgency double, source_weight double, duplicate_key string"
    now = market.social_signal(spark.createDataFrame(rows, schema), "2024-01-02 06:00:00").collect()
    later = [*rows, ("T1", dt.datetime(2024, 1, 2, 7), -1.0, 1.0, 1.0, "z")]
    assert market.social_signal(spark.createDataFrame(later, schema), "2024-01-02 06:00:00").collect() == now and now[0].n24 == 2


def test_upsert_replaces_once_and_null_keys_never_match(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k long, v string")
    batch = spark.createDataFrame([(2, "x", 0), (2, "y", 0), (3, "z", 0), (None, "n", 0)], "k long, v string, extra int")
    got = sorted((str(r.k), r.v) for r in tables.upsert(old, batch, ["k"], "v").collect())
    assert got == [("1", "a"), ("2", "y"), ("3", "z"), ("None", "c"), ("None", "n")]


def test_refresh_takes_the_largest_of_each_market(spark):
    symbols = spark.createDataFrame([(f"s{i}", "A" if i < 4 else "B") for i in range(6)], "symbol string, market string")
    metrics = spark.createDataFrame([(D0, f"s{i}", float(i)) for i in range(5)], "date date, symbol string, market_cap double")
    prices = spark.createDataFrame([(day(d), f"s{i}") for i in range(6) for d in range(3 if i else 1)], "date date, symbol string")
    got = {r.symbol: (r.status, r.place) for r in market.refresh_universe(symbols, metrics, prices, per_market=2, least_rows=2).collect()}
    assert got == {"s0": ("short_history", None), "s1": ("spare", 3), "s2": ("taken", 2), "s3": ("taken", 1), "s4": ("taken", 1), "s5": ("no_market_value", None)}


def test_ridge_solves_the_normal_equations(spark):
    rows = [("m", day(i), float(i % 7), float(i % 5), 0.2 * (i % 7) - 0.1 * (i % 5) + 0.03 * (i % 3)) for i in range(60)]
    out = market.ridge(spark.createDataFrame(rows, "market string, date date, a double, b double, label double"), ("a", "b"), alpha=1e-6).first()
    assert out.n == 60 and out.coefficients == pytest.approx([0.2, -0.1], abs=0.01) and out.residual < 0.05


def test_entry_points_agree(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    rows = entry.entry(spark).collect()
    assert 0 < len(rows) <= 20


@pytest.mark.parametrize("name", ["f08_momentum_score", "j04_asof_backward", "b01_topk_backtest", "st05_tumbling_stream", "x06_x07_explanations"])
def test_twins_agree(spark, name):
    import duckdb

    from quantloom.plans import ORACLES, QUERIES

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    df = QUERIES[name](spark, folder)
    cur = con.execute(ORACLES[name])
    names = [c[0] for c in cur.description]
    same = lambda v: round(v, 9) if isinstance(v, float) else v
    want = sorted((tuple(map(same, r)) for r in cur.fetchall()), key=str)
    assert sorted((tuple(same(r[c]) for c in names) for r in df.collect()), key=str) == want
