"""Gradient boosting of many expanding training windows at once.

Every window has its own trees, but all windows grow them in the same passes.
In a pass each task sums gradients by window, target, node, feature and bin;
the sums of a window meet in one task, which chooses its splits; the driver
gets the splits alone.  A pass grows one level of one tree of every window, so
the number of jobs is rounds times depth for each GROUP of windows, however
many dates or rows there are.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.sources.staging import staged

#: Windows that grow together: a task holds their histograms.
GROUP = 128
#: Rows that a task looks at together.
ROWS = 1024
MISSING = 255
#: Targets: the excess return by squared error, two classes by their log-odds.
TARGETS = ("excess_return", "is_top20pct", "is_bottom20pct")
#: Smaller gains are rounding.
LEAST_GAIN = 1e-9


@dataclass(frozen=True)
class Settings:
    rounds: int = 10
    depth: int = 3
    rate: float = 0.3
    bins: int = 32
    l2: float = 1.0
    least: float = 5.0  #: weight (hessian) of a child


@dataclass
class Forest:
    """The windows' starts, bins, fill bins and trees; arrays have a row for each window."""

    columns: list[str]
    ends: np.ndarray  # the number of dates that each window trains on
    edges: np.ndarray  # (features, bins - 1)
    fill: np.ndarray  # (windows, features): the bin of the median
    start: np.ndarray  # (windows, targets): mean, log-odds
    constant: np.ndarray  # (windows, targets): the class that all or no rows have, else NaN
    rows: np.ndarray  # training rows of each window
    settings: Settings = field(default_factory=Settings)
    feature: np.ndarray = None  # (windows, targets, rounds, inner nodes)
    split: np.ndarray = None  # the last bin that goes left
    value: np.ndarray = None  # (windows, targets, rounds, leaves)

    def parts(self) -> tuple:
        return self.ends, self.edges, self.fill, self.start, self.constant, self.feature, self.split, self.value, self.settings.depth


def _binned(batch, at: int, edges: np.ndarray) -> np.ndarray:
    """Bins of a batch's feature columns from place ``at`` on; MISSING for NULL, NaN and infinities."""
    out = np.empty((batch.num_rows, len(edges)), np.uint8)
    for f, own in enumerate(edges):
        x = batch.column(at + f).to_numpy(zero_copy_only=False).astype(np.float64)
        out[:, f] = np.where(np.isfinite(x), np.searchsorted(own, x, "left"), MISSING)
    return out


def _seen(x: np.ndarray, fill: np.ndarray) -> np.ndarray:
    """(row, window, feature): the bins, a missing one as the window's fill."""
    return np.where(x[:, None, :] == MISSING, fill[None].astype(np.uint8), x[:, None, :])


def _leaf(seen: np.ndarray, feature: np.ndarray, split: np.ndarray, levels: int) -> np.ndarray:
    """The node, counted from the left, that each (row, window, target) reaches after so many levels of one tree (window, target, node)."""
    n, w, f = seen.shape
    k, inner = feature.shape[1:]
    flat, features, splits = seen.ravel(), feature.astype(np.int32).ravel(), split.astype(np.uint8).ravel()
    tree = (np.arange(w * k, dtype=np.int32) * inner).reshape(1, w, k)
    bins = (np.arange(n * w, dtype=np.int32) * f).reshape(n, w, 1)
    node = np.zeros((n, w, k), np.int32)
    for level in range(levels):
        place = tree + ((1 << level) - 1) + node
        node = 2 * node + (flat.take(bins + features.take(place)) > splits.take(place))
    return node


def _margins(seen, start, feature, split, value, rounds, depth):
    """Sums of the trees so far, for every (row, window, target)."""
    out = np.repeat(start[None], len(seen), 0)
    w, k = start.shape
    leaves = value.shape[-1]
    tree = (np.arange(w * k, dtype=np.int32) * leaves).reshape(1, w, k)
    for t in range(rounds):
        out += value[:, :, t].ravel().take(tree + _leaf(seen, feature[:, :, t], split[:, :, t], depth))
    return out


def _labels(batch, at: int) -> np.ndarray:
    """Targets of a batch as doubles, NaN where NULL."""
    return np.stack([batch.column(at + k).cast("double").to_numpy(zero_copy_only=False).astype(np.float64) for k in range(len(TARGETS))], 1)


def _prepared(dataset: DataFrame, columns: list[str], days: DataFrame) -> DataFrame:
    """idx (the date's number), the targets, the features; rows without label only serve prediction."""
    kept = [F.col(c).cast("double").alias(c) for c in (*TARGETS, *columns)]
    return dataset.join(days, "date").select("date", "symbol", F.col("idx").cast("int").alias("idx"), *kept)


def _counted(rows: DataFrame, columns: list[str], ends: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bin counts (windows, features, bins) and for each target rows and sum (windows, targets, 2) of every window's training rows."""
    w, f, b, k = len(ends), len(edges), edges.shape[1] + 1, len(TARGETS)

    def run(batches):
        import pyarrow as pa

        bins, sums = np.zeros((w, f, b)), np.zeros((w, k, 2))
        for batch in batches:
            idx, y, x = batch.column(2).to_numpy(), _labels(batch, 3), _binned(batch, 3 + k, edges)
            first = np.searchsorted(ends, idx, "right")
            own = (first < w) & np.isfinite(y[:, :2]).all(axis=1)
            first, y, x = first[own], y[own], x[own]
            for j in range(f):
                seen = x[:, j] != MISSING
                np.add.at(bins, (first[seen], j, x[seen, j]), 1)
            for j in range(k):
                known = np.isfinite(y[:, j])
                np.add.at(sums, (first[known], j, 0), 1)
                np.add.at(sums, (first[known], j, 1), y[known, j])
        whole = np.concatenate((bins.reshape(w, -1), sums.reshape(w, -1)), 1)
        used = np.flatnonzero(whole.any(axis=1))
        yield pa.record_batch([pa.array(used, pa.int32()), pa.array([whole[i].tobytes() for i in used], pa.binary())], names=["window", "v"])

    out = np.zeros((w, f * b + k * 2))
    for window, v in added(rows.mapInArrow(run, "window int, v binary")):
        out[window] += v
    out = out.cumsum(axis=0)  # a window trains on all that the windows before it do
    return out[:, : f * b].reshape(w, f, b), out[:, f * b :].reshape(w, k, 2)


def added(parts: DataFrame, then=None, schema: str = "window int, v binary"):
    """Vectors of equal windows added in one task each, in a fixed order; ``then`` may reduce a sum further before it is collected."""
    plain = then or (lambda window, total: [(window, total.tobytes())])

    def add(batches):
        import pandas as pd

        total: dict[int, np.ndarray] = {}
        for frame in batches:
            for window, v in zip(frame["window"], frame["v"], strict=True):
                own = np.frombuffer(v)
                total[window] = total[window] + own if window in total else own
        names = [x.split()[0] for x in schema.split(", ")]
        yield pd.DataFrame([row for window, own in total.items() for row in plain(window, own)], columns=names)

    ordered = parts.withColumn("h", F.xxhash64("v")).repartition("window").sortWithinPartitions("window", "h").drop("h")
    got = ordered.mapInPandas(add, schema).collect()  # a row for each window, or for each of its nodes
    return [(r.window, np.frombuffer(r.v)) for r in got] if then is None else got


def _level(rows: DataFrame, forest: Forest, group: slice, t: int, level: int):
    """The best split of every node of a level of tree ``t``: rows of (window, target, node, feature, split, and left and whole sums)."""
    s, windows = forest.settings, np.arange(group.start, group.stop)
    ends, edges, fill, start, constant = forest.ends[group], forest.edges, forest.fill, forest.start[group], forest.constant[group]
    feature, split, value = forest.feature[group, :, : t + 1], forest.split[group, :, : t + 1], forest.value[group, :, :t]
    w, k, f, b, nodes = len(ends), len(TARGETS), len(edges), edges.shape[1] + 1, 1 << level
    own_fill = fill[windows]
    sent = rows.sparkSession.sparkContext.broadcast((ends, edges, own_fill, start, constant, feature, split, value))  # trees of at most GROUP windows
    rounds, depth, least, l2 = t, s.depth, s.least, s.l2

    def run(batches):
        import pyarrow as pa

        ends, edges, fill, start, constant, feature, split, value = sent.value
        total = np.zeros((w, k, nodes, f, b, 2))
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                y = _labels(batch, 3)
                idx = batch.column(2).to_numpy()
                mine = np.isfinite(y[:, :2]).all(axis=1) & (idx < ends[-1])
                if not mine.any():
                    continue
                x, y, idx = _binned(batch, 3 + k, edges)[mine], y[mine], idx[mine]
                low = int(np.searchsorted(ends, idx.min(), "right"))  # windows before train on none of these rows
                seen, own = _seen(x, fill[low:]), slice(low, None)
                m = _margins(seen, start[own], feature[own], split[own], value[own], rounds, depth)
                node = _leaf(seen, feature[own, :, rounds], split[own, :, rounds], level)
                trains = (idx[:, None] < ends[None, own])[:, :, None] & np.isfinite(y)[:, None, :] & np.isnan(constant)[None, own]
                goal = np.nan_to_num(y)[:, None, :]
                p = 1.0 / (1.0 + np.exp(-np.clip(m[:, :, 1:], -60, 60)))
                g = np.concatenate((m[:, :, :1], p), 2) - goal
                h = np.concatenate((np.ones((*p.shape[:2], 1)), p * (1 - p)), 2)
                place = ((np.arange(w - low, dtype=np.int32)[None, :, None] * k + np.arange(k, dtype=np.int32)[None, None, :]) * nodes + node) * (f * b)
                on = np.flatnonzero(trains.ravel())
                gs, hs, place = g.ravel()[on], h.ravel()[on], place.ravel()[on]
                flat = total[own].reshape(-1, 2)
                for j in range(f):
                    cell = place + j * b + np.repeat(seen[:, :, j].ravel(), k)[on]
                    flat[:, 0] += np.bincount(cell, gs, len(flat))
                    flat[:, 1] += np.bincount(cell, hs, len(flat))
        used = np.flatnonzero(total.any(axis=(1, 2, 3, 4, 5)))
        yield pa.record_batch([pa.array(used, pa.int32()), pa.array([total[i].tobytes() for i in used], pa.binary())], names=["window", "v"])

    def best(window, v):
        hist = v.reshape(k, nodes, f, b, 2)
        left = hist.cumsum(axis=3)
        whole = left[:, :, :, -1:]
        right = whole - left
        worth = lambda x: x[..., 0] ** 2 / (x[..., 1] + l2)
        gain = worth(left) + worth(right) - worth(whole)
        gain = np.where((left[..., 1] >= least) & (right[..., 1] >= least), gain, -np.inf)
        for target in range(k):
            for node in range(nodes):
                own = gain[target, node]
                top = float(own.max())
                hit = np.argwhere(own >= top - LEAST_GAIN)[0] if top > LEAST_GAIN else None  # the first of equal ones
                all_g, all_h = (float(x) for x in whole[target, node, 0, 0])
                lg, lh = (float(x) for x in left[target, node, hit[0], hit[1]]) if hit is not None else (all_g, all_h)
                yield int(window), target, node, int(hit[0]) if hit is not None else 0, int(hit[1]) if hit is not None else MISSING, lg, lh, all_g, all_h

    schema = "window int, target int, node int, feature int, split int, left_g double, left_h double, all_g double, all_h double"
    got = added(rows.mapInArrow(run, "window int, v binary"), best, schema)
    sent.destroy()
    return got


def fit(rows: DataFrame, columns: list[str], ends: list[int], settings: Settings | None = None) -> Forest:
    """Trees of every window; window i trains on labelled rows of the first ``ends[i]`` dates (ascending).

    Bins are quantiles of the first window's rows, so no window sees later
    data in them.  A missing value counts as its window's median.
    """
    s = settings or Settings()
    ends = np.array(ends, np.int64)
    probs = [i / s.bins for i in range(1, s.bins)]
    first = rows.where((F.col("idx") < int(ends[0])) & F.col(TARGETS[0]).isNotNull())
    finite = lambda c: F.when(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c))
    got = first.agg(*[F.percentile_approx(finite(c), probs, 10_000).alias(c) for c in columns]).first()
    edges = np.array([got[c] if got[c] is not None else [0.0] * len(probs) for c in columns], np.float64)
    bins, sums = _counted(rows, columns, ends, edges)
    below = bins.cumsum(axis=2)
    fill = (below < below[:, :, -1:] / 2).sum(axis=2)
    n, total = sums[..., 0], sums[..., 1]
    mean = np.divide(total, n, out=np.full(n.shape, np.nan), where=n > 0)
    constant, start = np.full(n.shape, np.nan), mean.copy()
    for k in (1, 2):
        flat = np.isnan(mean[:, k]) | (mean[:, k] <= 0) | (mean[:, k] >= 1)
        constant[:, k] = np.where(flat, np.where(np.isnan(mean[:, k]), -1.0, mean[:, k]), np.nan)  # -1: not known at all
        with np.errstate(divide="ignore", invalid="ignore"):
            start[:, k] = np.where(flat, 0.0, np.log(mean[:, k] / (1 - mean[:, k])))
    start = np.nan_to_num(start)
    w, inner, leaves = len(ends), (1 << s.depth) - 1, 1 << s.depth
    shape = (w, len(TARGETS), s.rounds)
    forest = Forest(columns, ends, edges, fill, start, constant, n[:, 0].astype(np.int64), s, np.zeros((*shape, inner), np.int64), np.full((*shape, inner), MISSING), np.zeros((*shape, leaves)))
    for low in range(0, w, GROUP):
        group = slice(low, min(low + GROUP, w))
        for t in range(s.rounds):
            for level in range(s.depth):
                for r in _level(rows, forest, group, t, level):
                    at, place = (low + r.window, r.target, t), (1 << level) - 1 + r.node
                    forest.feature[(*at, place)], forest.split[(*at, place)] = r.feature, r.split
                    step = lambda g, h: -s.rate * g / (h + s.l2)
                    # a node's value stands in all leaves below it until they get their own
                    span = leaves >> (level + 1)
                    lo = r.node * 2 * span
                    forest.value[(*at, slice(lo, lo + span))] = step(r.left_g, r.left_h)
                    forest.value[(*at, slice(lo + span, lo + 2 * span))] = step(r.all_g - r.left_g, r.all_h - r.left_h) if r.split != MISSING else step(r.all_g, r.all_h)
    return forest


def predict(rows: DataFrame, forest: Forest, starts: list[int], stops: list[int]) -> DataFrame:
    """date, symbol, window, pred_return, prob_top, prob_bottom of rows whose date's number is in [starts[i], stops[i]) of a window i."""
    sent = rows.sparkSession.sparkContext.broadcast(forest.parts())
    starts, stops, k = np.array(starts), np.array(stops), len(TARGETS)

    def run(batches):
        import pyarrow as pa

        ends, edges, fill, start, constant, feature, split, value, depth = sent.value
        for batch in batches:
            idx = batch.column(2).to_numpy()
            window = np.searchsorted(starts, idx, "right") - 1
            asked = np.flatnonzero((window >= 0) & (idx < stops[np.maximum(window, 0)]))
            if not len(asked):
                continue
            x, window, out = _binned(batch, 3 + k, edges)[asked], window[asked], np.empty((len(asked), k))
            for w in np.unique(window):
                own, one = window == w, slice(w, w + 1)
                out[own] = _margins(_seen(x[own], fill[one]), start[one], feature[one], split[one], value[one], feature.shape[2], depth)[:, 0]
            for j in (1, 2):
                p, flat = 1.0 / (1.0 + np.exp(-np.clip(out[:, j], -60, 60))), constant[window, j]
                out[:, j] = np.where(np.isnan(flat), p, flat)
            known = pa.array(asked)
            probs = [pa.array(np.where(out[:, j] < 0, np.nan, out[:, j]), from_pandas=True) for j in (1, 2)]
            yield pa.record_batch([batch.column(0).take(known), batch.column(1).take(known), pa.array(window, pa.int32()), pa.array(out[:, 0]), *probs], names=["date", "symbol", "window", "pred_return", "prob_top", "prob_bottom"])

    return rows.mapInArrow(run, "date date, symbol string, window int, pred_return double, prob_top double, prob_bottom double")


def numbered_days(dataset: DataFrame) -> tuple[DataFrame, list]:
    """(date, idx) of the dates in order, and the dates: a row for each date."""
    days = [r.date for r in dataset.select("date").where("date is not null").distinct().orderBy("date").collect()]
    return dataset.sparkSession.createDataFrame([(d, i) for i, d in enumerate(days)], "date date, idx int"), days


def prepared(dataset: DataFrame, columns: list[str], days: DataFrame) -> DataFrame:
    """``dataset`` as the passes read it, written once: they all scan it.  Rows stand by date, so that a task's blocks leave out early windows."""
    return staged(_prepared(dataset, columns, days).repartition("symbol", "date").sortWithinPartitions("idx"), "boosting-rows")
