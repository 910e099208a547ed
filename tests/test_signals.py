"""Signals of posts and articles, and the gate of models, on small tables."""

import datetime as dt

import pytest

from quantloom.operators import rules, signals

POST = "ticker string, ts timestamp, sentiment double, urgency double, source_weight double, duplicate_key string, risks array<string>, themes array<string>"
at = lambda h: dt.datetime(2024, 1, 10, 12) - dt.timedelta(hours=h)


def test_ticker_signals_and_no_future_posts(spark):
    rows = [("A", at(0.5), 0.8, 0.2, 1.0, "k1", ["x"], ["AI"]), ("A", at(3), 0.4, None, 9.0, "k1", None, ["rate"]), ("A", at(30), 0.1, 1.0, 1.0, "k", [], []), ("B", at(1.5), None, None, None, "", [], None), ("C", at(40), 1.0, 1.0, 1.0, "z", [], [])]
    later = [("A", at(-1), 0.0, 1.0, 2.0, "k9", ["r"] * 9, []), ("D", at(-0.01), 1.0, 1.0, 1.0, "z", [], [])]
    momentum = spark.createDataFrame([("A", 0.9)], "ticker string, momentum double")
    run = lambda data: {r.ticker: r.asDict() for r in signals.ticker_signals(spark.createDataFrame(data, POST), "2024-01-10 12:00:00", momentum).collect()}
    got = run(rows)
    assert got == run(rows + later) and set(got) == {"A", "B"}
    a = got["A"]
    weighted = (1 * (0.65 * 0.8 + 0.35 * 0.2) + 2 * (0.65 * 0.4)) / 3
    assert (a["n24"], a["n1"], a["delta"], a["copies"], a["risk"]) == (2, 1, 1.0, 0.5, 0.5)
    assert a["weighted"] == pytest.approx(weighted) and a["attention"] == pytest.approx(0.45 * 0.2 + 0.3 * weighted + 0.15 * 0.2 + 0.1 * 0.5)
    assert a["signal"] == pytest.approx(0.25 * 0.2 + 0.2 * 0.6 + 0.2 * weighted + 0.2 * 0.9 + 0.1 * 0.2 - 0.15 * 0.5 - 0.1 * 0.5)
    assert (a["chips"], a["macro"]) == (0.5, 0.5)
    b = got["B"]
    assert (b["sentiment"], b["urgency"], b["copies"], b["momentum"], b["delta"]) == (0.5, 0.0, 0.0, 0.5, 1.0)


def test_moods_above_one_weigh_in_as_they_are_where_wanted(spark):
    posts = spark.createDataFrame([("A", at(1), 1.2, 0.6, 1.0, "k1", [], []), ("A", at(2), 0.5, 0.0, 1.0, "k2", [], [])], POST)
    momentum = spark.createDataFrame([], "ticker string, momentum double")
    for clipped, mood in ((True, 1.0), (False, 1.2)):
        want = (0.65 * mood + 0.35 * 0.6 + 0.65 * 0.5) / 2
        assert signals.ticker_signals(posts, "2024-01-10 12:00:00", momentum, clipped=clipped).first()["weighted"] == pytest.approx(want)
        assert signals.market_days(posts, clipped=clipped).first()["weighted"] == pytest.approx(want)


def test_article_signals_reach_days_without_articles(spark):
    d = lambda n: dt.date(2024, 1, n)
    rows = [("m", d(1), "s1", "macro", 0.9, 0.5, None, ["AI"], False), ("m", d(1), "s2", None, 0.3, None, 0.2, None, None), ("m", d(2), "x", "FLOW", None, 0.1, 0.4, ["RATE"], True), ("m", d(9), " ", "", 0.5, 0.0, 0.0, [], False)]
    df = spark.createDataFrame(rows, "scope string, date date, source string, category string, sentiment double, urgency double, risk double, themes array<string>, negative boolean")
    from pyspark.sql import functions as F

    got = {r.date.day: r for r in signals.article_signals(df, feed=F.col("source") == "x").collect()}
    assert sorted(got) == [1, 2, 3, 4, 9, 10, 11]
    r = got[3]
    assert (r.n_1d, r.n_3d, r.negative_n, r.feed_n_1d, r.feed_n_3d, r.feed_negative_n) == (0, 3, 2, 0, 1, 1)
    assert r.sentiment == pytest.approx(0.6) and r.urgency == pytest.approx(0.3) and r.risk == pytest.approx(0.3) and r.diversity == pytest.approx(0.6)
    assert r.adjusted_sentiment == pytest.approx((0.9 * 0.75 + 0.3 * 2 + 0.5 * 2) / 4.75) and r.macro_score == pytest.approx(2 / 3) and r.flow_score == pytest.approx(1 / 3) and r.chips_score == pytest.approx(1 / 3)
    assert got[9].diversity == 0.0 and got[4].n_3d == 1 and got[9].feed_adjusted_sentiment == 0.5


def test_gate_against_the_baseline_of_the_horizon(spark):
    shape = "model_name string, model_version string, horizon string, eval_date date, sample_count long, precision_top double, avg_excess double, rank_ic double, mdd double, suggested_weight double"
    day = dt.date(2024, 1, 1)
    good = (300, 0.6, 0.02, 0.1, -0.1)
    base = [("base", "1", "1M", day, 300, 0.5, 0.01, 0.0, -0.1, None), ("base", "0", "1M", dt.date(2023, 1, 1), 300, 0.9, 0.9, 0.0, 0.0, None)]
    change = lambda i, v: tuple(v if j == i else x for j, x in enumerate(good))
    cases = {"good": good, "few_samples": change(0, 199), "precision": change(1, 0.4), "excess": change(2, 0.0), "rank_correlation": change(3, -0.1), "drawdown": change(4, -0.13), "unknown": change(3, None), "near": change(4, -0.12)}
    rows = base + [(n, "1", "1M", day, *v, 0.5 if n == "near" else None) for n, v in cases.items()] + [("alone", "1", "6M", day, *good, None), ("all", "1", "1M", day, 1, 0.0, None, -1.0, -9.0, None)]
    got = {(r.model_name, r.model_version): r for r in rules.gatekeeper(spark.createDataFrame(rows, shape), "base").collect()}
    assert ("alone", "1") not in got and got["base", "1"].gate_status == "production" and got["base", "1"].production_weight == 1.0
    for n in cases:
        r = got[n, "1"]
        assert (r.gate_status, r.reasons) == (("rejected", [n]) if n in ("few_samples", "precision", "excess", "rank_correlation", "drawdown") else ("accepted", [])), n
    assert got["good", "1"].production_weight == 0.1 and got["near", "1"].production_weight == 0.3 and got["all", "1"].reasons == ["few_samples", "precision", "excess", "rank_correlation", "drawdown"]
