"""Analyst outcomes, outlook targets and feeds against plain Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quantloom.operators import analyst, outlook

DAY = dt.date(2020, 1, 1)
day = lambda n: DAY + dt.timedelta(days=n)


def months(d, m):
    y, k = divmod(d.month - 1 + m, 12)
    first = dt.date(d.year + y, k + 1, 1)
    last = (dt.date(d.year + y + (k + 1) // 12, (k + 1) % 12 + 1, 1) - dt.timedelta(days=1)).day
    return first.replace(day=min(d.day, last))


def test_outcomes(spark):
    rng = random.Random(4)
    prices, level = [], {}
    for s in ("a", "b"):
        x = 100.0
        for n in sorted(rng.sample(range(40, 900), 420)):
            x *= 1 + rng.gauss(0, 0.02)
            prices.append((day(n), s, x * (1 + abs(rng.gauss(0, 0.01))), x))
    for n in sorted(rng.sample(range(900), 500)):
        level[day(n)] = 50 + rng.random()
    reports = [(i, rng.choice(["a", "b", "none"]), day(rng.randint(0, 880)), "x", "y", rng.choice([95.0, 105.0, None]), rng.choice([80.0, 101.0, 115.0, 140.0, None, 0.0])) for i in range(160)]
    reports += [(200, "a", dt.date(2020, 8, 31), "x", "y", 100.0, 100.0), (201, "a", dt.date(2020, 2, 29), "x", "y", 100.0, 120.0)]
    got = analyst.outcomes(
        spark.createDataFrame(reports, "report_id int, symbol string, report_date date, analyst string, broker string, price double, target double"), spark.createDataFrame(prices, "date date, symbol string, high double, close double"),
        spark.createDataFrame(list(level.items()), "date date, close double"),
    ).collect()
    assert sorted(r.report_id for r in got) == sorted(r[0] for r in reports)
    by = {r.report_id: r for r in got}
    hits = 0
    near = lambda v: None if v is None else pytest.approx(v, abs=1.1e-6)
    for i, s, d, _, _, price, target in reports:
        own, r = sorted(p[0:1] + p[2:] for p in prices if p[1] == s), by[i]
        first = lambda t, own=own: next(((x[0], x[2]) for x in own if x[0] >= t), (None, None))
        mark = lambda t: next((level[x] for x in sorted(level) if x >= t), None)
        at, base = first(d)
        at, base = (at, base) if base else (d, price)
        assert r.base == near(base)
        for m in analyst.MONTHS:
            p = first(months(d, m))[1]
            ret = p / base - 1 if p and base else None
            assert (r[f"price_{m}m"], r[f"return_{m}m"]) == (near(p), near(ret))
            if m in analyst.EXCESS:
                b = mark(months(d, m)) / mark(d) - 1 if mark(months(d, m)) else None
                assert (r[f"benchmark_return_{m}m"], r[f"excess_return_{m}m"]) == (near(b), near(ret - b if None not in (ret, b) else None))
        for m in analyst.DRAWDOWN:
            path, top, worst = [x[2] for x in own if at <= x[0] <= months(d, m)], 0.0, 0.0
            for c in path:
                top = max(top, c)
                worst = min(worst, c / top - 1)
            assert r[f"max_drawdown_{m}m"] == near(worst if path else None)
        hit = next((x[0] for x in own if d < x[0] <= months(d, 24) and target and x[1] >= target), None)
        assert (r.target_hit_date, r.target_hit_days, r.target_hit_6m, r.target_hit_12m) == (hit, hit and (hit - d).days, bool(hit and hit <= months(d, 6)), bool(hit and hit <= months(d, 12)))
        hits += hit is not None
    assert 20 < hits < len(reports)


def test_outcomes_are_found_once_for_the_reports_of_a_day(spark):
    rows = [(i, "a", day(i % 2), "x", "y", 100.0, 101.0 + i) for i in range(20)]
    prices = [(day(n), "a", 100.0 + n + 0.5, 100.0 + n) for n in range(0, 800, 3)]
    made = analyst.outcomes(
        spark.createDataFrame(rows, "report_id int, symbol string, report_date date, analyst string, broker string, price double, target double"), spark.createDataFrame(prices, "date date, symbol string, high double, close double"),
        spark.createDataFrame([(day(0), 1.0)], "date date, close double"),
    )
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if ("Generate" in x or "Window" in x) and "report_id" in x]  # no report meets months or blocks by itself
    for r in made.collect():
        assert r.target_hit_date == next(d for d, _, high, _ in prices if d > r.report_date and high >= r.target)


def test_consensus_measures_against_plain_python(spark):
    rng = random.Random(5)
    rows = [(i, day(rng.choice([0, 1, 2, 50, 88, 89, 90, 91, 179, 180, 300]) - 7), rng.choice(["a", "b", None]), "x", "y", rng.choice([90.0, 110.0]), rng.choice([80.0, 95.5, 101.25, None, 140.0]), rng.choice(["Buy", "Hold", None]), rng.choice([None, 90.0])) for i in range(150)]
    reports = spark.createDataFrame(rows, "report_id long, report_date date, symbol string, broker string, analyst string, price double, target double, rating string, previous_target double")
    made = analyst.consensus_measures(reports)
    got = {(r.symbol, r.report_date): r for r in made.collect()}
    assert len(got) == made.count() and set(got) == {(r[2], r[1]) for r in rows}
    assert "collect_list" not in made._jdf.queryExecution().optimizedPlan().toString()  # no window is written out
    near = lambda v: None if v is None else pytest.approx(v, abs=1.1e-4)
    for (s, d), r in got.items():
        own = [x for x in rows if x[2] == s and 0 <= (d - x[1]).days < 90]
        targets, ratings = sorted(x[6] for x in own if x[6] is not None), [x[7] == "Buy" for x in own if x[7]]
        price, n = max((x[1], x[0], x[5]) for x in own)[2], len(targets)
        assert r.target_median == near((targets[(n - 1) // 2] + targets[n // 2]) / 2 if n else None) and r.buy_ratio == near(sum(ratings) / len(ratings) if ratings else None)
        assert r.upside_pct == near(sum(targets) / n / price * 100 - 100 if n else None)
        assert r.new30 == sum(x[8] is None for x in own if (d - x[1]).days < 30)


def test_reliability_defaults(spark):
    shape = "analyst string, broker string, report_date date, target double, price double, price_12m double, return_6m double, return_12m double, target_hit_6m boolean, target_hit_12m boolean, excess_return_6m double, excess_return_12m double"
    rows = [("a", "b", day(700), 120.0, 100.0, None, None, None, False, False, None, None)] * 5 + [("old", "b", day(0), 120.0, 100.0, 100.0, 0.1, 0.1, True, True, 0.1, 0.2)] * 5 + [("few", "b", day(700), 120.0, 100.0, 100.0, 0.1, 0.1, True, True, 0.1, 0.2)] * 4
    rows += [("good", "b", day(690), 120.0, 100.0, 120.0, 0.1, 0.2, True, True, 0.1, 0.2)] * 6
    got = {r.analyst: r for r in analyst.analyst_scores(spark.createDataFrame(rows, shape)).collect()}
    assert set(got) == {"a", "good"}
    assert got["a"].reliability == pytest.approx(0.15 * 0.5 + 0.10 * 0.5)  # an upside without a return is no right direction
    assert got["good"].reliability == pytest.approx(0.30 + 0.15 + 0.20 + 0.10 + 0.15 + 0.10) and got["good"].n_recent == 6


def test_targets_of_both_horizons(spark):
    dates = [d for n in range(60) if (d := day(n)).weekday() < 5 and n % 11 != 4] + [day(61 if day(61).weekday() > 4 else 63)]
    rows = [("m", d, 100.0 + i) for i, d in enumerate(dates)] + [("short", d, 50.0) for d in dates[:9]]
    got = outlook.targets(spark.createDataFrame(rows, "market string, date date, close double")).collect()
    by = {(r.market, r.date, r.horizon): r for r in got}
    assert len(by) == len(got) == 2 * (len(dates) + 8)
    for market, own in (("m", dates), ("short", dates[:9])):
        close = {d: c for m, d, c in rows if m == market}
        for d in own[:-1]:
            later = [x for x in own if x > d]
            friday = d + dt.timedelta(days=(4 - d.weekday()) % 7 or 7)
            week = [x for x in later if x <= friday]
            for horizon, want in (("TODAY", later[0]), ("WEEK", week[-1] if week else later[0])):
                r = by[market, d, horizon]
                assert (r.target_date, r.label_return) == (want, pytest.approx(close[want] / close[d] - 1))
    last = dates[-1]
    assert by["m", last, "TODAY"].label_return is None and by["m", last, "TODAY"].target_date.weekday() < 5 and by["m", last, "WEEK"].target_date.weekday() == 4


def test_feeds_side_by_side_and_neutral_values(spark):
    a = spark.createDataFrame([(day(0), 1.0), (day(1), None)], "date date, risk double")
    b = spark.createDataFrame([(day(1), 2.0), (day(2), 3.0)], "date date, fund_impact double")
    both = outlook.together([a, b], ["date"])
    assert both._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted(map(tuple, both.collect())) == [(day(0), 1.0, None), (day(1), None, 2.0), (day(2), None, 3.0)]
    index = spark.createDataFrame([(day(n), "m", 100.0 + n) for n in (0, 1, 2, 5)], "date date, market string, close double")
    empty = spark.createDataFrame([], "date date, market string, up_probability double")
    got = {(r.date, r.horizon): r for r in outlook.outlook_rows(index, [empty], [a, b]).collect()}
    assert got[day(1), "TODAY"].risk == 50.0 and got[day(0), "WEEK"].fund_impact == 0.5 and got[day(2), "TODAY"].fund_impact == 3.0 and got[day(0), "TODAY"].up_probability == 0.5 and got[day(0), "TODAY"].return_1d == 0.0


def test_news_feed(spark):
    rng = random.Random(8)
    rows = [(day(rng.randint(0, 20)), rng.choice([None, 0.2, 0.5, 0.7]), rng.random() < 0.4, rng.random() < 0.2) for _ in range(60)]
    days = [day(n) for n in range(0, 25, 2)]
    df = spark.createDataFrame(rows, "at date, s double, x boolean, bad boolean")
    got = {r.date: r for r in outlook.news_feed(spark.createDataFrame([(d,) for d in days], "date date"), df, on="at", sentiment=F.col("s"), feed=F.col("x"), negative=F.col("bad")).collect()}
    assert sorted(got) == days
    for d in days:
        one = [0.5 if s is None else s for t, s, _, _ in rows if t == d]
        feed = [(s, s <= 0.45 or bad) for t, s, bad in ((t, 0.5 if s is None else s, bad) for t, s, x, bad in rows if x) if d - dt.timedelta(days=2) <= t <= d]
        w = [2.0 if neg else 0.75 if s >= 0.6 else 1.0 for s, neg in feed]
        n_bad = sum(neg for _, neg in feed)
        want = (len(one), sum(one) / len(one) if one else 0.5, len(feed), n_bad, min(1.0, n_bad * 2 / 3), sum(s * x for (s, _), x in zip(feed, w, strict=True)) / sum(w) if feed else 0.5)
        r = got[d]
        assert (r.news_count, r.news_sentiment, r.feed_count_3d, r.feed_negative_3d, r.feed_attention_3d, r.feed_sentiment_3d) == pytest.approx(want)
