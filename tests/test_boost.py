"""Boosting of all windows at once against a plain fit of each window, row by row."""

import datetime as dt
import math
import random

import numpy as np
import pytest

from quantloom.operators import boost, models

DAY = dt.date(2020, 1, 1)
SHAPE = "date date, symbol string, x double, z double, excess_return double, is_top20pct boolean, is_bottom20pct boolean"


def panel(spark, dates=40, symbols=9, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(dates):
        for k in range(symbols):
            x, z = rng.choice([None, float("nan"), *[rng.gauss(0, 1)] * 6]), rng.gauss(0, 1)
            y = (x if x is not None and x == x else 0.0) * 0.05 + (0.03 if z > 0.5 else 0) + rng.gauss(0, 0.01)
            rows.append((DAY + dt.timedelta(days=i), f"s{k}", x, z, None if rng.random() < 0.05 else y, y > 0.05, y < -0.05))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, SHAPE).repartition(3)


def plain(rows, end, edges, s):
    """One window: lists, a loop for every node and split."""
    train = [r for r in rows if r["idx"] < end and r["excess_return"] is not None and r["is_top20pct"] is not None]
    bins = lambda r: [boost.MISSING if r[c] is None or not math.isfinite(r[c]) else sum(e < r[c] for e in edges[j]) for j, c in enumerate(("x", "z"))]
    fill = []
    for j in range(2):
        seen = sorted(b[j] for b in map(bins, train) if b[j] != boost.MISSING)
        counts, total = 0, len(seen)
        for b in range(s.bins):
            counts += seen.count(b)
            if counts >= total / 2:
                fill.append(b)
                break
    full = lambda r: [fill[j] if b == boost.MISSING else b for j, b in enumerate(bins(r))]
    models_ = []
    for k, target in enumerate(boost.TARGETS):
        own = [(full(r), float(r[target])) for r in train if r[target] is not None]
        mean = sum(y for _, y in own) / len(own)
        start = mean if k == 0 else math.log(mean / (1 - mean))
        margins, trees = [start] * len(own), []
        for _ in range(s.rounds):
            grads = [(m - y, 1.0) if k == 0 else ((p := 1 / (1 + math.exp(-m))) - y, p * (1 - p)) for (_, y), m in zip(own, margins, strict=True)]

            def grow(at, depth, own=own, grads=grads):
                g, h = (sum(grads[i][n] for i in at) for n in (0, 1))
                best, gain = None, boost.LEAST_GAIN
                for j in range(2) if depth else ():
                    for b in range(s.bins):
                        left = [i for i in at if own[i][0][j] <= b]
                        lg, lh = (sum(grads[i][n] for i in left) for n in (0, 1))
                        if lh < s.least or h - lh < s.least:
                            continue
                        got = lg**2 / (lh + s.l2) + (g - lg) ** 2 / (h - lh + s.l2) - g**2 / (h + s.l2)
                        if got > gain + boost.LEAST_GAIN / 10:
                            best, gain = (j, b, left), got
                if best is None:
                    return -s.rate * g / (h + s.l2)
                j, b, left = best
                inside = set(left)
                return j, b, grow(left, depth - 1), grow([i for i in at if i not in inside], depth - 1)

            tree = grow(list(range(len(own))), s.depth)
            trees.append(tree)
            margins = [m + walk(tree, x) for m, (x, _) in zip(margins, own, strict=True)]
        models_.append((start, trees))
    return full, models_


def walk(tree, x):
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


@pytest.mark.parametrize("group", [128, 2])
def test_every_window_equals_its_plain_fit(spark, group, monkeypatch):
    monkeypatch.setattr(boost, "GROUP", group)
    s = boost.Settings(rounds=3, depth=2, bins=8, least=2.0)
    own = panel(spark)
    days, dates = boost.numbered_days(own)
    rows = boost.prepared(own, ["x", "z"], days)
    ends, starts, stops = [15, 20, 31], [18, 25, 33], [25, 33, 40]
    forest = boost.fit(rows, ["x", "z"], ends, s)
    local = [r.asDict() for r in rows.collect()]
    number = {(r["date"], r["symbol"]): r for r in local}
    got = boost.predict(rows, forest, starts, stops).collect()
    assert len(got) == 9 * 22
    fits = [plain(local, e, forest.edges, s) for e in ends]
    for r in got:
        full, targets = fits[r.window]
        x = full(number[r.date, r.symbol])
        want = [start + sum(walk(t, x) for t in trees) for start, trees in targets]
        assert r.pred_return == pytest.approx(want[0], abs=1e-9)
        assert (r.prob_top, r.prob_bottom) == (pytest.approx(1 / (1 + math.exp(-want[1])), abs=1e-9), pytest.approx(1 / (1 + math.exp(-want[2])), abs=1e-9))
    assert forest.rows.tolist() == [sum(x["idx"] < e and x["excess_return"] is not None for x in local) for e in ends]


def test_later_rows_change_nothing_before_them(spark):
    own = panel(spark, dates=60)
    from pyspark.sql import functions as F

    late = F.col("date") >= F.lit(DAY + dt.timedelta(days=45))
    other = own.withColumn("x", F.when(late, F.lit(9.0)).otherwise(F.col("x"))).withColumn("excess_return", F.when(late, F.lit(1.0)).otherwise(F.col("excess_return")))
    options = {"step": 7, "least_dates": 24, "embargo": 4, "settings": boost.Settings(rounds=2)}
    run = lambda df: {(r.date, r.symbol): (r.pred_return, r.prob_top, r.trained_to) for r in models.walk_forward(df, ["x", "z"], **options).collect()}
    a, b = run(own), run(other)
    early = {k for k in a if (k[0] - DAY).days < 45}
    assert len(a) == 36 * 9 and all(a[k][2] == b[k][2] and abs(a[k][0] - b[k][0]) < 1e-12 for k in early) and any(a[k] != b[k] for k in a)


def test_windows_metrics_and_limits(spark):
    own = panel(spark, dates=60)
    options = {"step": 10, "least_dates": 20, "embargo": 3, "settings": boost.Settings(rounds=4)}
    trained = models.walk_forward_windows(own, ["x", "z"], **options)
    got = models.window_metrics(trained, own, 3).orderBy("window").collect()
    assert [r.window for r in got] == [0, 1, 2, 3]
    assert all(r.rank_ic > 0.4 and r.rmse < r.spread for r in got), got
    share = sum(bool(r.is_top20pct) for r in own.collect()) / own.count()
    assert all(r.precision > 1.5 * share for r in got), (share, got)
    truth = {(r.date, r.symbol): r for r in own.collect()}
    scored = [(p, truth[p.date, p.symbol].excess_return) for p in trained.predictions.collect() if p.trained_to == got[0].trained_to]
    errors = [(p.pred_return - y) ** 2 for p, y in scored if y is not None]
    assert got[0].n_scored == len(errors) and got[0].rmse == pytest.approx(math.sqrt(np.mean(errors)))
    assert models.walk_forward(own, ["x"], least_dates=20, least_train_rows=10**6).count() == 0
    assert models.walk_forward(own.where("false"), ["x"]).count() == 0
    few = models.walk_forward_windows(own, ["x", "z"], least_train_dates=30, **options)
    assert few.windows.count() == 2
