"""Explanation rules one by one, and the joins and windows behind them against plain Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quantloom.operators import explain as E
from quantloom.operators import links as L
from quantloom.operators.asof import Latest, Trailing, carry, latest_by_day

DAY = dt.date(2020, 1, 1)
day = lambda n: DAY + dt.timedelta(days=n)
rng = random.Random(5)

#: For each rule a context that only it (of its kind and direction) reads; the rest is NULL.
HOLDS = {
    "sector_abroad_weak": {"sector_return": -0.015}, "sector_abroad_strong": {"sector_impact": 0.65}, "funds_abroad_weak": {"lever_return": -0.03}, "funds_abroad_friendly": {"fund_impact": 0.7},
    "tech_abroad_falls": {"is_chip": True, "tech_low": -0.015}, "posts_alarm": {"posts_bad": True}, "posts_cheer": {"posts_good": True}, "tech_abroad_rises": {"is_chip": True, "tech_high": 0.015},
    "foreign_selling": {"foreign_5": -1.0}, "foreign_buying": {"foreign_1": 1.0}, "institutions_selling": {"pension_5": -1.0}, "institutions_buying": {"institution_1": 1.0},
    "regime_risk": {"risk": 45.0}, "regime_risk_on": {"regime": "risk_on"}, "currency_weak": {"currency_return": 0.004}, "leverage_in_news": {"macro_leverage": True}, "profit_taking": {"ret_21d": 0.1}, "rebound": {"ret_21d": -0.08},
    "own_news_bad": {"news_n": 2, "news_sentiment": 0.4}, "own_news_good": {"news_n": 1, "news_good": True}, "selling_in_news": {"macro_selling": True}, "risk_appetite_in_news": {"macro_appetite": True},
}
FIELDS = ["scope", "name", "move", "index_return", *E.CONTEXT]
SCHEMA = "scope string, name string, move double, index_return double, " + ", ".join(f"{c} {t}" for c, t in E.CONTEXT.items())


def frame(spark, rows):
    return spark.createDataFrame([tuple({"scope": "symbol", **r}.get(c) for c in FIELDS) for r in rows], SCHEMA)


def test_every_rule_holds_alone_and_shows_its_values(spark):
    assert set(HOLDS) == {r.name for r in E.RULES} and len(E.RULES) == 22
    rows = []
    for r in E.RULES:
        sign = -1 if r.when.startswith("down") else 1
        rows += [{"name": r.name, "move": sign * 0.05, **HOLDS[r.name]}, {"name": f"other {r.name}", "move": -sign * 0.05, **HOLDS[r.name]}]
    got = {x.name: x for x in E.explained(frame(spark, rows)).collect()}
    for r in E.RULES:
        own = got[r.name]
        assert own.reasons == [r.name] and own.primary == r.name and own.triggered
        assert own.confidence == pytest.approx(0.42 + 0.12 + 0.05)
        assert [e.kind for e in own.evidence] == ["price", r.kind]
        assert [(s.name, s.value) for s in own.evidence[1].shows] == [(c, None if HOLDS[r.name].get(c) is None else float(HOLDS[r.name][c])) for c in r.shows]
        assert r.name not in got[f"other {r.name}"].reasons


def test_order_cut_fallbacks_and_triggers(spark):
    every = {k: v for c in HOLDS.values() for k, v in c.items()} | {"foreign_1": -1.0, "institution_1": -1.0, "sector_return": -0.02, "ret_21d": 0.2}
    rows = [
        {"name": "all", "move": -0.3, **every}, {"name": "none", "move": 0.02}, {"name": "calm", "move": 0.0199, "foreign_1": 1.0}, {"name": "unpriced", "foreign_1": 1.0},
        {"name": "market falls", "scope": "market", "move": -0.02, "index_return": -0.02, "tech_low": -0.02, "up_count": 3, "down_count": 9}, {"name": "market rises", "scope": "market", "move": 0.09, "index_return": 0.09, "foreign_1": 1.0},
        {"name": "market unknown", "scope": "market"}, {"name": "market of symbols", "scope": "market", "move": 0.05, "foreign_1": 1.0},
    ]
    got = {x.name: x for x in E.explained(frame(spark, rows)).collect()}
    own = got["all"]
    scores = {r.name: r.score for r in E.RULES}
    assert [scores[n] for n in own.reasons] == sorted((scores[n] for n in own.reasons), reverse=True) and own.n_reasons > 8
    assert own.reasons.index("funds_abroad_weak") < own.reasons.index("sector_abroad_weak") and len(own.evidence) == 6 and own.confidence == 0.95
    by = lambda n: (got[n].primary, got[n].triggered, got[n].confidence, got[n].direction)
    assert by("none") == ("price_alone", True, 0.35, "UP")
    assert by("calm") == ("no_move", False, 0.25, "FLAT")
    assert by("unpriced") == ("no_price", False, 0.1, "UNKNOWN")
    assert by("market rises") == ("no_market_shock", False, 0.25, "UP") and got["market rises"].reasons == []
    assert by("market unknown") == ("no_price", False, 0.1, "UNKNOWN")
    assert got["market falls"].primary == "tech_abroad_falls" and [e.kind for e in got["market falls"].evidence] == ["price", "breadth", "tech"]
    assert got["market of symbols"].triggered and got["market of symbols"].reasons == ["foreign_buying"]


def test_missing_columns_and_empty_tables(spark):
    bare = spark.createDataFrame([("symbol", -0.1), ("market", None)], "scope string, move double")
    assert sorted(r.primary for r in E.explained(bare).collect()) == ["no_price", "price_alone"]
    assert E.explained(bare.where("false")).collect() == []


def test_tail_sums(spark):
    rows = [(s, day(d), rng.choice([None, 1.0, -2.0, 5.0])) for s in "ab" for d in sorted(rng.sample(range(300), 90))]
    got = E.tail_sums(spark.createDataFrame(rows, "symbol string, date date, x double"), ["x"], (1, 5, 20), 45).collect()
    assert len(got) == len(rows)
    for r in got:
        seen = sorted((d, v) for s, d, v in rows if s == r.symbol and r.date - dt.timedelta(days=45) <= d <= r.date)
        for n in (1, 5, 20):
            values = [v for _, v in seen[-n:] if v is not None]
            assert r[f"x_{n}"] == (sum(values) if values else None)


def test_keyword_hits_among_the_newest(spark):
    articles = [(i, day(rng.randint(0, 60)), rng.random() < 0.05) for i in range(300)] + [(999, day(80), True)]
    days = [day(d) for d in range(0, 100, 3)]
    df = spark.createDataFrame(articles, "id int, at date, hit boolean")
    got = {r.date: r for r in E.keyword_hits(spark.createDataFrame([(d,) for d in days], "date date"), df, {"hit": F.col("hit")}, on="at", order=[F.desc("id")], window=14, most=20).collect()}
    assert sorted(got) == days
    for d in days:
        near = sorted(((t, i, h) for i, t, h in articles if d - dt.timedelta(days=14) <= t <= d), reverse=True)[:20]
        assert (got[d].n, got[d].hit) == (len(near), any(h for *_, h in near))


def test_carry_of_several_feeds(spark):
    left = [(k, day(d), i) for i, (k, d) in enumerate((k, rng.randint(0, 90)) for k in ["a", "b", "c", None] for _ in range(25))]
    one = [(k, day(rng.randint(0, 90)), rng.randint(0, 9)) for k in "ab" for _ in range(20)]
    two = [(k, day(rng.randint(0, 90)), rng.choice([None, 1.5, 2.5])) for k in "bc" for _ in range(20)]
    frames = [spark.createDataFrame(r, f"k string, {c}") for r, c in ((left, "date date, i int"), (one, "on1 date, x int"), (two, "on2 date, y double"))]
    feeds = {"one": Latest(frames[1], "on1", ["x"]), "two": Latest(frames[2], "on2", ["y"], 1)}
    got = carry(frames[0], key="k", on="date", latest=feeds, trailing={"sum": Trailing(frames[1], "on1", 10, {"s": (F.sum, "x"), "n": (F.count, "x")})})
    rows = got.collect()
    assert sorted(r.i for r in rows) == list(range(len(left)))
    for r in rows:
        before = [(t, x) for k, t, x in one if k == r.k and t <= r.date]
        assert (r.one_at, r.x) == (max(before) if before else (None, None))
        late = [(t, y is not None, y) for k, t, y in two if k == r.k and t < r.date]
        assert (r.two_at, r.y) == ((max(late)[0], max(late)[2]) if late else (None, None))
        near = [x for k, t, x in one if k == r.k and r.date - dt.timedelta(days=9) <= t <= r.date]
        assert (r.s, r.n) == (sum(near) if near else None, len(near))
    exchanges = carry(frames[0].hint("x"), key="k", on="date", latest=feeds)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert exchanges == 1


def test_latest_by_day_and_sector_link_know_nothing_of_the_day(spark):
    bars = spark.createDataFrame([(day(0), "x", 1.0), (day(3), "x", 2.0), (day(1), "y", 7.0)], "trade_date date, symbol string, r double")
    days = spark.createDataFrame([(day(d),) for d in range(5)], "date date")
    got = {r.date: (r.a, r.b) for r in latest_by_day(days, bars, {"a": ("x", "r"), "b": ("y", "r")}, on="trade_date").collect()}
    assert got == {day(0): (1.0, None), day(1): (1.0, 7.0), day(2): (1.0, 7.0), day(3): (2.0, 7.0), day(4): (2.0, 7.0)}
    domestic = spark.createDataFrame([(day(d), "s", rng.gauss(0, 0.01)) for d in range(80)], "date date, sector string, r double")
    world = [(day(d), "p", rng.gauss(0, 0.01), 0.0) for d in range(80)]
    proxies = spark.createDataFrame([("s", "p")], "sector string, symbol string")
    run = lambda w: {r.date: (r.sector_return, r.zscore, r.beta, r.corr, r.agreement, r.n_common, r.sector_impact) for r in L.sector_link(domestic, spark.createDataFrame(w, "trade_date date, symbol string, return_1d double, return_5d double"), proxies).collect()}
    before, after = run(world), run([(d, s, r if d < day(60) else 0.5, x) for d, s, r, x in world])
    assert all(before[day(d)] == after[day(d)] for d in range(61)) and before[day(61)] != after[day(61)]
    assert before[day(79)][5] == 60 and before[day(4)][1] is None and before[day(6)][1] is not None


def test_snapshot_goes_before_the_bar_and_parts_are_neutral_without_data(spark):
    days = spark.createDataFrame([(day(d),) for d in range(4)], "date date")
    bars = spark.createDataFrame([(day(0), "L", 0.06, 1.5), (day(2), "L", -0.03, 0.5), (day(0), "F", 0.01, None)], "trade_date date, symbol string, return_1d double, volume_ratio double")
    snaps = spark.createDataFrame([(1, day(3), "L", 0.09)], "at long, day date, symbol string, change_rate double")
    local = spark.createDataFrame([(day(0), None, None, None, None, None, None, None), (day(1), -0.02, 0.01, None, None, 1e11, None, None)], "date date, index_a double, index_b double, stock_a double, stock_b double, foreign_net double, institution_net double, retail_net double")
    got = {r.date: r for r in L.fund_link(days, bars, snaps, dict(zip(L.ROLES, "LFBGC", strict=True)), local).collect()}
    assert got[day(0)].lever_return is None and got[day(0)].impact == pytest.approx(0.5) and not got[day(0)].shock
    assert got[day(1)].drift == pytest.approx(0.03) and got[day(1)].signal_source == "bar" and got[day(1)].shock
    assert got[day(1)].impact == pytest.approx(0.5 + 0.2 * 0.2 + 0.15 * (-0.4 + 1 / 6) / 2 + 0.15 * 0.25)
    assert (got[day(3)].lever_return, got[day(3)].signal_source, got[day(3)].signal_date, got[day(3)].lever_volume_ratio) == (0.09, "snapshot", day(3), 0.5)
