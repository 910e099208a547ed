"""Whitening against numpy's eigenvectors of the whole covariance, over nulls, odd lengths, ties and repeats."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.llm import whiten

rng = np.random.default_rng(2)


def table(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return df.select("*", *[F.lit(1).alias(c) for c in ("id", "v", "component", "n", "i", "part")]).repartition(5)


def clean(rows):
    return [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]


def check(spark, rows, k, block=None):
    good = clean(rows)
    x = np.floor(64 * np.array([np.float32(v) for _, v in good]).astype(float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    c = (n * x - s) / n
    e, w = np.linalg.eigh(c.T @ c / n)
    e, w = e[::-1], w[:, ::-1]
    got = whiten.whiten(table(spark, rows), components=k, block=block).collect()
    assert len(got) == n * min(k, x.shape[1])
    assert {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-8
    share = {r.component: r.explained for r in got}
    assert sorted(share) == list(range(1, min(k, x.shape[1]) + 1))
    for j, v in share.items():
        assert v == pytest.approx(e[j - 1] / e.sum(), rel=1e-9)
    deviation = sorted((i, int(((n * r - s) ** 2).sum())) for (i, _), r in zip(good, x, strict=True) if i is not None)
    assert sorted({(r.vec_id, r.deviation) for r in got if r.vec_id is not None}) == sorted(set(deviation))
    z = c @ (w / np.sqrt(np.maximum(e, 1e-300)))
    for j in share:
        want = sorted((i, abs(v)) for (i, _), v in zip(good, z[:, j - 1], strict=True) if i is not None)
        have = sorted((r.vec_id, abs(r.whitened)) for r in got if r.component == j and r.vec_id is not None)
        assert np.allclose(want, have, rtol=1e-6, atol=1e-7)
        one = [r.whitened for r in got if r.component == j]
        assert abs(np.mean(one)) < 1e-9 and np.var(one) == pytest.approx(1, abs=1e-8)


def vectors(n, d, seed=0):
    own = np.random.default_rng(seed)
    return own.standard_normal((n, d)) * np.geomspace(4, 0.3, d) + own.standard_normal(d)


def test_whole_space_in_one_pass_with_hostile_rows(spark):
    rows = [(i, v.tolist()) for i, v in enumerate(vectors(400, 12))]
    rows += [(5, rows[5][1]), (5, rows[5][1]), (None, rows[9][1]), (900, None), (901, [None] + [0.0] * 11), (902, [float("nan")] * 12), (903, [float("inf")] + [0.0] * 11)]
    check(spark, rows, 32)
    check(spark, rows, 3)


@pytest.mark.parametrize("block", [8, 12])
def test_block_smaller_than_the_space(spark, block):
    rows = [(i, v.tolist()) for i, v in enumerate(vectors(500, 40, 3))]
    check(spark, rows, 5, block)


def test_passes_are_certified_and_slow_blocks_widened(spark):
    flat = np.random.default_rng(5).standard_normal((600, 48)).astype(np.float32)  # no gap between eigenvalues
    df = table(spark, [(i, v.tolist()) for i, v in enumerate(flat)])
    model = whiten.fit(df, components=4, block=6)
    assert model.passes > 1 and (model.residuals <= 1e-12 * model.values[0] * 10).all()
    steep = whiten.fit(table(spark, [(i, v.tolist()) for i, v in enumerate(np.random.default_rng(6).standard_normal((300, 48)) * np.geomspace(1000, 0.1, 48))]), components=4, block=12)
    assert 1 < steep.passes < 12 and (steep.residuals <= 1e-12 * steep.values[0]).all()


def test_other_lengths_and_tables_without_variance(spark):
    rows = [(i, [float(i), 1.0]) for i in range(6)] + [(10, [1.0]), (11, []), (12, [1.0, 2.0, 3.0])]
    got = whiten.whiten(table(spark, rows)).collect()
    assert {r.component for r in got} == {1} and {r.vec_id for r in got} == set(range(6)) and got[0].n == 6
    for few in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 4, [(1, None)], [(1, [])]):
        out = whiten.whiten(table(spark, few))
        assert out.collect() == [] and out.columns == got[0].__fields__


def test_long_arithmetic_is_exact():
    x = np.array([[3, 1 << 61], [5, 7]])
    sums = [8, (1 << 61) + 7]
    d = whiten.deviations(x, 2, sums)
    assert [list(map(int, r)) for r in d] == [[-2, (1 << 61) - 7], [2, 7 - (1 << 61)]]
    assert whiten.squares(d) == [None, None] and whiten.squares(whiten.deviations(x[:, :1], 2, [8])) == [4, 4]
