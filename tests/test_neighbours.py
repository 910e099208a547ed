"""Neighbours by inverted lists against brute force, with copies, ties, nulls and large lists."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.operators import neighbours


def table(spark, seed=1, n=500):
    rng = np.random.default_rng(seed)
    heart = rng.standard_normal((6, 8)) * 3
    rows = [(i, (heart[i % 6] + rng.standard_normal(8)).astype(np.float32).tolist(), int(rng.integers(0, 3))) for i in range(n)]
    rows += [(1000 + i, rows[7][1], rows[7][2]) for i in range(150)]  # copies
    rows += [(2000, None, 1), (2001, [None] * 8, 1), (None, rows[3][1], 0), (2002, rows[9][1], None), (2003, rows[5][1], 77)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("h", F.lit(1)).repartition(4), rows


def plain(rows, k):
    good = [(i, np.array(v, np.float64), g) for i, v, g in rows if i is not None and v is not None and None not in v]
    out = {}
    for i, v, g in good:
        if i % 20 == 0:
            near = sorted((float(np.sqrt(((v - w) ** 2).sum())), j) for j, w, o in good if o == g and j != i and g is not None)
            out[i] = near[:k]
    return out


@pytest.mark.parametrize(("probes", "block"), [(1, 4096), (3, 16), (100, 50)])
def test_exact_search(spark, monkeypatch, probes, block):
    monkeypatch.setattr(neighbours, "BLOCK", block)
    df, rows = table(spark)
    want = plain(rows, 10)
    got = {}
    for r in neighbours.nearest(df, df.where("vec_id % 20 = 0").select("vec_id"), 10, probes=probes).collect():
        got.setdefault(r.vec_id, []).append((r.place, r.distance, r.peer))
    assert set(got) == {i for i, near in want.items() if near}
    for i, near in want.items():
        own = [(d, p) for _, d, p in sorted(got.get(i, []))]
        assert [p for _, p in own] == [p for _, p in near], i
        assert np.allclose([d for d, _ in own], [d for d, _ in near], atol=1e-9)


def test_probes_alone_reach_the_recall(spark):
    df, rows = table(spark, seed=4)
    want = {i: {p for _, p in near} for i, near in plain(rows, 10).items()}
    got = {}
    for r in neighbours.nearest(df, df.where("vec_id % 20 = 0").select("vec_id"), 10, probes=8, exact=False).collect():
        got.setdefault(r.vec_id, set()).add(r.peer)
    assert np.mean([len(got.get(i, set()) & near) / len(near) for i, near in want.items() if near]) >= 0.9


def test_copies_come_in_order_and_tables_may_be_empty(spark):
    df, rows = table(spark)
    asked = spark.createDataFrame([(1040,)], "vec_id long")
    assert [r.peer for r in neighbours.nearest(df, asked, 4).orderBy("place").collect()] == [7, 1000, 1001, 1002]
    assert neighbours.nearest(df.where("false"), asked, 4).collect() == []
    assert neighbours.nearest(df, asked.where("false"), 4).collect() == []
