"""Records in payloads, published tables, stores of streams, sequences, clusters and grouped performance."""

import datetime as dt
import email.utils
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.operators import decisions, models, sequences, universe
from quantloom.sources import records as R
from quantloom.sources.versions import Published, Refused
from quantloom.streaming import store

DAY = dt.date(2020, 1, 1)
day = lambda n: DAY + dt.timedelta(days=n)


def test_records_of_nested_payloads(spark):
    item = {"basDt": "20240102", "n": 3, "x": None}
    payloads = [
        json.dumps({"response": {"header": {"code": 0}, "body": {"items": {"item": [item, 7, {"a": [1]}]}}}}), json.dumps([item, "x"]), json.dumps({"data": [], "result": {"records": [item]}}), json.dumps(item), json.dumps({}),
        "<r><a><item><basDt>1</basDt><b/></item></a><item><c>é &amp; x</c></item></r>", "<r><item>", "{broken", "", None, "[" * 5000,
    ]
    got = [r.r for r in spark.createDataFrame(list(enumerate(payloads)), "i int, p string").select("i", R.records(F.col("p")).alias("r")).orderBy("i").collect()]
    one = {"basDt": "20240102", "n": "3", "x": None}
    assert got == [[one, {"a": "[1]"}], [one], [one], [one], [], [{"basDt": "1", "b": None}, {"c": "é & x"}], [], [], [], [], []]


def test_credit_balances(spark):
    rows = [{"기준일": f"2024-01-{i + 1:02d}", "시장구분": "유가증권", "loanBalance": f"{1000 + i * i:,}", "증감": "5" if i == 3 else None} for i in range(8)]
    rows += [{"date": "20240101", "market": " kq ", "crdLoanBal": "12%"}, {"date": "20240101", "market": "KQ", "crdLoanBal": "13"}, {"date": "x", "market": "KQ"}, {"date": "20240102", "market": "NYSE", "crdLoanBal": "1"}]
    got = {(r.date, r.market): r for r in R.credit_balances(spark.createDataFrame([(1, json.dumps({"data": rows}))], "payload_id int, payload string")).collect()}
    assert len(got) == 9 and got[dt.date(2024, 1, 1), "KOSDAQ"].balance == 13
    k = [got[dt.date(2024, 1, i + 1), "KOSPI"] for i in range(8)]
    assert [r.delta_1 for r in k] == [None, 1, 3, 5, 7, 9, 11, 13] and k[6].delta_5 == 35 and k[7].delta_20 is None


def test_mail_dates(spark):
    texts = ["Mon, 02 Jan 2006 15:04:05 +0900", "2 Jan 2006 15:04 GMT", "Tue, 31 Dec 2024 23:30:00 -0530", "Fri, 1 Mar 2024 00:00:01 EST", "Wed, 05 Jun 2024 1:02:03 Z", "05 Jun 2024 01:02:03"]
    want = [(t.astimezone(dt.UTC).replace(tzinfo=None) if t.tzinfo else t) for t in map(email.utils.parsedate_to_datetime, texts)]
    got = [r[0] for r in spark.createDataFrame(list(enumerate([*texts, "never", "", None, "40 Foo 2020 1:2:3 +0000"])), "i int, t string").orderBy("i").select(R.mail_date(F.col("t"))).collect()]
    assert got == [*want, None, None, None, None]


def test_feed_entries(spark):
    item = lambda title, link, guid="", date="Mon, 02 Jan 2006 15:04:05 GMT": f"<item><title>{title}</title>{f'<link>{link}</link>' if link else ''}<guid>{guid}</guid><pubDate>{date}</pubDate><description>x &lt;b&gt;y&lt;/b&gt;\n z</description></item>"
    one = "<rss><channel>" + item("A &amp;lt; B", "http://a/1") + item("again", "HTTP://A/1") + item("", "http://a/2") + item("no link", None, "http://g/1") + item("neither", None, "id7", "?") + item("late", "http://a/9") + "</channel></rss>"
    got = {r.title: r for r in R.feed_entries(spark.createDataFrame([("f1", "s", one), ("f2", "s", one), ("f3", "t", "broken")], "feed_id string, source string, payload string"), most=5).collect()}
    assert set(got) == {"A < B", "no link", "neither"}
    assert got["A < B"].summary == "x y z" and got["no link"].link == "http://g/1" and got["neither"].link is None and got["neither"].pub_date is None
    assert got["A < B"].pub_date == dt.datetime(2006, 1, 2, 15, 4, 5) and len(got["A < B"].article_id) == 64


def test_feed_titles_keep_their_blanks_where_wanted(spark):
    payload = "<rss><item><title>&lt;b&gt;Notes&lt;/b&gt; &amp;amp;  7 </title><guid>g7</guid></item><item><title>  </title><guid>g8</guid></item></rss>"
    feeds = spark.createDataFrame([("f", "s", payload)], "feed_id string, source string, payload string")
    titles = lambda **how: [r.title for r in R.feed_entries(feeds, **how).collect()]
    assert titles(trim_titles=False) == ["Notes & 7 "] and titles() == ["Notes & 7"]


def test_search_articles_take_one_python_step(spark):
    payload = '{"items": [{"title": " <b>&quot;A&quot;</b> &amp;gt; B ", "description": null, "link": "http://a", "pubDate": "Mon, 02 Jan 2006 15:04:05 GMT"}]}'
    made = R.search_articles(spark.createDataFrame([("s", payload)], "symbol string, payload string"))
    assert made._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert [(r.title, r.description, r.link) for r in made.collect()] == [('"A" &gt; B', "", "http://a")]


def test_tickers_with_marks(spark):
    from quantloom.functions import text as T

    texts = {"$AB #C (D) e": "AB,C,D", "Y$$ ##Q $$R S$": "", "a$T U.V": "U,V", "ñW X#Z": "W"}
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.array_join(T.tickers(F.col("t"), pattern=T.MARKED_TICKER), ",")).collect()
    assert dict(map(tuple, got)) == texts


def test_published_versions_are_whole_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "universe")
    symbols = spark.createDataFrame([(f"s{i}", "M" if i < 6 else "G") for i in range(10)], "symbol string, market string")
    metrics = spark.createDataFrame([(day(d), f"s{i}", float(i * 10 + d)) for i in range(9) for d in range(2)], "date date, symbol string, market_cap double")
    prices = spark.createDataFrame([(day(d), f"s{i}") for i in range(10) for d in range(3 if i == 0 else 20)], "date date, symbol string")
    excluded = spark.createDataFrame([("s5",)], "symbol string")
    chosen = universe.choose(symbols, metrics, prices, excluded, per_market=3, least_rows=10)
    assert sorted(map(tuple, chosen.collect())) == [("s2", "M", 3), ("s3", "M", 2), ("s4", "M", 1), ("s6", "G", 3), ("s7", "G", 2), ("s8", "G", 1)]
    assert {r.symbol: r.why for r in universe.judged(symbols, metrics, prices, excluded, least_rows=10).collect() if r.why} == {"s0": "short_history", "s5": "excluded", "s9": "no_market_value"}
    table = Published(spark, path)
    assert table.current() is None
    universe.commit(spark, path, chosen, {"M": 3, "G": 3})
    first = sorted(map(tuple, table.current().collect()))
    folders = set((tmp_path / "universe").glob("v-*"))
    for bad in (chosen.limit(5), chosen.unionByName(chosen.limit(1)), chosen.withColumn("market", F.lit("X")), chosen.withColumn("rank", F.col("rank") + 1), chosen.where("false")):
        with pytest.raises(Refused):
            universe.commit(spark, path, bad, {"M": 3, "G": 3})
        assert sorted(map(tuple, table.current().collect())) == first and set((tmp_path / "universe").glob("v-*")) == folders
    reader = table.current()
    for n in range(3):
        universe.commit(spark, path, chosen.withColumn("run", F.lit(n)), {"M": 3, "G": 3})
        if n == 0:
            assert reader.count() == 6  # a reader of the version before is not disturbed
    assert {r.run for r in table.current().collect()} == {2} and len(set((tmp_path / "universe").glob("v-*"))) == 2


EVENTS = "event_id long, user_id long, ts timestamp, event_type string, value double"


def put(spark, folder, n, rows):
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(str(folder / "events.parquet"))


def plain_daily(rows):
    out = {}
    for r in {r[0]: r for r in rows}.values():
        n, total = out.get((r[2].date(), r[3]), (0, 0.0))
        out[r[2].date(), r[3]] = (n + 1, total + r[4])
    return {k: (n, pytest.approx(t, abs=0.01)) for k, (n, t) in out.items()}


def test_late_files_and_restarts_give_the_batch_table(spark, tmp_path):
    rng = random.Random(2)
    make = lambda i, d: (i, i % 4, dt.datetime(2024, 1, 1) + dt.timedelta(days=d, minutes=rng.randint(0, 1400)), rng.choice("ab"), rng.random())
    files = [[make(i, 30 + i % 5) for i in range(100)], [make(100 + i, i % 3) for i in range(60)], [make(200 + i, 60) for i in range(20)]]
    files[1] += files[0][:10]  # repeated rows, and a file that is weeks late
    folder, at, seen = tmp_path / "in", str(tmp_path / "out"), []
    folder.mkdir()
    for n, rows in enumerate(files):
        put(spark, folder, n, rows)
        seen += rows
        stream = spark.readStream.schema(EVENTS).parquet(str(folder / "events.parquet*"))
        got = {(r.start, r.event_type): (r.n, r.total) for r in store.daily(stream, at).collect()}
        assert got == plain_daily(seen)
    parts = {p.name.split("=")[1]: p for p in (tmp_path / "out/events/data").glob("*/__part=*")}
    held = store.Store(spark, f"{at}/events", EVENTS, ["event_id"], F.to_date("ts"))
    assert held._state()["batch"] == 2 and len(held._state()["parts"]) == 9 and len(parts) == 9
    used = {f.split("/")[1] for f in held._state()["parts"].values()}
    assert len({p.parent.name for p in (tmp_path / "out/events/data").glob("*/__part=*")} - used) <= 1  # what nothing points to goes
    again = store.daily(spark.readStream.schema(EVENTS).parquet(str(folder / "events.parquet*")), at)  # nothing new
    assert {(r.start, r.event_type): (r.n, r.total) for r in again.collect()} == plain_daily(seen)


def test_only_touched_parts_are_written_and_batches_once(spark, tmp_path):
    table = store.Store(spark, str(tmp_path / "t"), "k long, v string", ["k"], F.col("k") % 5)
    rows = lambda *x: spark.createDataFrame(list(x), "k long, v string")
    assert table.read().count() == 0
    table.upsert(rows(*[(i, "a") for i in range(20)]), 0)
    before = dict(table._state()["parts"])
    assert sorted(table.upsert(rows((3, "b"), (103, "b")), 1)) == ["3"]
    after = table._state()["parts"]
    assert {p for p in after if after[p] != before[p]} == {"3"}
    assert table.upsert(rows((3, "c")), 1) == []  # a replay
    got = {r.k: r.v for r in table.read().collect()}
    assert got == {**{i: "a" for i in range(20)}, 3: "b", 103: "b"}
    assert {r.k for r in table.read(["3"]).collect()} == {3, 8, 13, 18, 103}


def test_pull_beyond_the_stored_watermark(spark, tmp_path):
    at = lambda d: dt.datetime(2024, 1, 1) + dt.timedelta(days=d)
    row = lambda i, u, d: (i, u, at(d), "a", 1.0)
    folder = tmp_path / "in"
    folder.mkdir()
    read = lambda: spark.readStream.schema(EVENTS).parquet(str(folder / "events.parquet*"))
    run = lambda: sorted(r.event_id for r in store.pull(read(), str(tmp_path / "out"), entity="user_id", ts="ts", key="event_id").collect())
    put(spark, folder, 0, [row(1, 1, 5), row(2, 1, 6), row(3, 2, 1), row(3, 2, 1)])
    assert run() == [1, 2, 3]
    put(spark, folder, 1, [row(4, 1, 6), row(5, 1, 7), row(6, 2, 2), row(7, 3, 0)])
    assert run() == [1, 2, 3, 5, 6, 7] and run() == [1, 2, 3, 5, 6, 7]


def test_sequences_are_normalised_by_training_dates_alone(spark):
    rng = random.Random(1)
    rows = [(day(d), s, rng.choice([None, float("nan"), *[rng.gauss(5, 2)] * 5]), 1.0 if rng.random() < 0.3 else None if rng.random() < 0.1 else 0.0) for d in range(40) for s in ("a", "b")]
    run = lambda data: {(r.date, r.symbol): r for r in sequences.sequences(spark.createDataFrame(data, "date date, symbol string, x double, y double"), ["x"], 3, label="y").collect()}
    got = run(rows)
    dates = sorted({r[0] for r in rows if r[3] is not None})
    end, valid = dates[int(len(dates) * 0.7 + 1e-9) - 1], dates[int(len(dates) * 0.85 + 1e-9) - 1]
    seen = [r[2] for r in rows if r[3] is not None and r[0] <= end and r[2] is not None and r[2] == r[2]]
    median, spread = float(np.median(seen)), float(np.std(seen))
    for s in ("a", "b"):
        own = sorted((r for r in rows if r[1] == s and r[3] is not None), key=lambda r: r[0])
        for i in range(2, len(own)):
            r = got[own[i][0], s]
            want = [((median if x is None or x != x else x) - median) / spread for _, _, x, _ in own[i - 2 : i + 1]]
            assert [v[0] for v in r.sequence] == pytest.approx(want) and r.sequence_start == own[i - 2][0]
            assert r.split == ("train" if r.date <= end else "valid" if r.date <= valid else "test")
    assert len(got) == sum(r[3] is not None for r in rows) - 4
    other = run([(d, s, 1e6 if d > end else x, y) for d, s, x, y in rows])
    assert all(other[k].sequence == r.sequence for k, r in got.items() if r.split == "train")


def test_clusters_of_several_starts(spark):
    rng = np.random.default_rng(3)
    hearts = rng.standard_normal((4, 3)) * 8
    rows = [(f"s{i}", *[float(v) if rng.random() > 0.03 else None for v in hearts[i % 4] + rng.standard_normal(3) * 0.3]) for i in range(120)]
    df = spark.createDataFrame(rows, "symbol string, a double, b double, c double").repartition(3)
    assigned, found = models.best_clusters(df, ["a", "b", "c"], k=4, restarts=6)
    got = {r.symbol: (r.cluster, r.distance) for r in assigned.collect()}
    whole = [i for i in range(120) if None not in rows[i]]
    assert len(got) == 120 and len({(got[f"s{i}"][0], i % 4) for i in whole}) == 4
    assert sum(r.members for r in found.collect()) == 120 and [r.cluster for r in found.orderBy(F.desc("members"), "cluster").collect()] == [0, 1, 2, 3]
    again = {r.symbol: r.cluster for r in models.best_clusters(df.repartition(2), ["a", "b", "c"], k=4, restarts=6)[0].collect()}
    assert again == {s: c for s, (c, _) in got.items()}
    assert models.best_clusters(df.where("false"), ["a", "b", "c"])[0].count() == 0
    centres = {"momentum_score": [0.9, 0.1, 0.2, 0.3, 0.4], "volatility_60d": [0.5, 0.1, 0.9, 0.8, 0.7], "size_score": [0.1, 0.9, 0.2, 0.3, 0.1], "liquidity_score": [0.1, 0.2, 0.9, 0.3, 0.4], "ret_21d": [0, 0, 0, 0.2, 0.1], "ret_126d": [1, 1, 1, 0.1, 0.3]}
    assert models.cluster_labels(centres) == ["high_momentum", "calm_large", "liquid", "recovering", "high_momentum"]


def test_performance_of_each_model(spark):
    rng = random.Random(4)
    shape = "model_name string, model_version string, horizon string, horizon_days int, prediction_date date, symbol string, rank_no int, pred_return double, actual_return double, benchmark_return double, excess_return double, is_hit boolean, is_outperform boolean"
    rows = [(m, v, "1M", h, day(d), f"s{k}", k + 1, -float(k), r, 0.01, r - 0.01, r > 0, r > 0.01) for m, v, h in (("a", "1", 5), ("a", "2", 3), ("b", "1", 50)) for d in range(31) for k in range(6) for r in [rng.gauss(0.01, 0.1)]]
    rows += [("a", "1", "1M", 5, day(99), "s9", 1, 0.0, None, None, None, None, None)]
    got = {(r.model_name, r.model_version): r for r in decisions.performance_by_model(spark.createDataFrame(rows, shape), top=2).collect()}
    assert len(got) == 3
    for (m, v), r in got.items():
        own = [x for x in rows if x[:2] == (m, v) and x[8] is not None]
        h = own[0][3]
        path = [np.mean([x[8] for x in own if x[4] == day(d) and x[6] <= 2]) for d in range(31)][::h]
        level = np.cumprod(1 + np.array(path))
        assert r.n_portfolios == len(path) and r.mdd == pytest.approx(float((level / np.maximum.accumulate(level) - 1).min()), abs=2e-6)
        assert r.sharpe == (None if len(path) < 2 else pytest.approx(np.mean(path) / np.std(path) * np.sqrt(252 / h), abs=2e-4))
        assert r.sample_count == len(own) and r.median_actual == pytest.approx(np.median([x[8] for x in own]), abs=2e-6) and r.eval_date == day(30)
