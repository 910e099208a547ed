"""Trained models: walk-forward boosted trees, clusters, evaluation and ablation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions.columns import clip, rounded
from quantloom.functions.windows import first_rank, pct_rank, with_pooled_ranks
from quantloom.operators import boost


@dataclass(frozen=True)
class Trained:
    """Predictions (date, symbol, pred_return, prob_top, prob_bottom, trained_to) and each window's number of training rows."""

    predictions: DataFrame
    windows: DataFrame


def _windows(dataset: DataFrame, columns: list[str], cuts: list[tuple[int, int, int]], days: DataFrame, dates: list, settings: boost.Settings | None, least_rows: int) -> Trained:
    """Predictions of every (training dates, first date, last date + 1) window from the trees fitted for it."""
    spark = dataset.sparkSession
    shape = "window int, trained_to date, first date, last date, n_train long"
    rows = boost.prepared(dataset, columns, days)
    forest = boost.fit(rows, columns, [c[0] for c in cuts], settings) if cuts else None
    known = [(i, dates[end - 1], dates[start], dates[stop - 1], int(forest.rows[i])) for i, (end, start, stop) in enumerate(cuts) if forest.rows[i] >= least_rows]
    windows = spark.createDataFrame(known, shape)
    if not known:
        none = F.lit(None).cast("double")
        empty = dataset.where("false").select("date", "symbol", none.alias("pred_return"), none.alias("prob_top"), none.alias("prob_bottom"), F.col("date").alias("trained_to"))
        return Trained(empty, windows)
    found = boost.predict(rows, forest, [c[1] for c in cuts], [c[2] for c in cuts])
    out = found.join(F.broadcast(windows.select("window", "trained_to")), "window")  # a row for each window
    return Trained(out.select("date", "symbol", "pred_return", "prob_top", "prob_bottom", "trained_to"), windows)


def train_model(dataset: DataFrame, columns: list[str], share: float = 0.2, settings: boost.Settings | None = None) -> tuple[boost.Forest, DataFrame]:
    """Trees fitted on all labelled rows, and what those of the earlier dates predict for the last share of dates; both grow together."""
    days, dates = boost.numbered_days(dataset)
    cut = min(max(1, int(len(dates) * (1 - share))), len(dates) - 1)
    rows = boost.prepared(dataset, columns, days)
    forest = boost.fit(rows, columns, [cut, len(dates)], settings)
    return forest, boost.predict(rows, forest, [cut, len(dates)], [len(dates), len(dates)]).drop("window")


def walk_forward_windows(
    dataset: DataFrame, columns: list[str], *, step: int = 21, least_dates: int = 504, embargo: int = 21, least_train_dates: int = 1, least_train_rows: int = 1, settings: boost.Settings | None = None
) -> Trained:
    """Predictions of every date after the first ``least_dates``, each from trees fitted before its window of ``step`` dates, and the windows.

    Training expands: a window has seen all dates but the ``embargo`` ones
    before it, whose labels reach into it.  Windows with fewer training dates
    or rows than wanted give no predictions.  All windows are fitted together.
    """
    days, dates = boost.numbered_days(dataset)
    cuts = [(start - embargo, start, min(start + step, len(dates))) for start in range(least_dates, len(dates), step) if start - embargo >= least_train_dates]
    return _windows(dataset, columns, cuts, days, dates, settings, least_train_rows)


def walk_forward(dataset: DataFrame, columns: list[str], **options) -> DataFrame:
    """The predictions of ``walk_forward_windows``."""
    return walk_forward_windows(dataset, columns, **options).predictions


def window_metrics(trained: Trained, dataset: DataFrame, k: int) -> DataFrame:
    """Each window with rows scored, precision of the k best of a date, rank correlation and error, and whether it beats the window's mean."""
    own = trained.predictions.join(dataset.where("excess_return is not null").select("date", "symbol", "excess_return", "is_top20pct"), ["date", "symbol"])
    own = own.withColumn("__r", first_rank(F.col("prob_top"), "date"))
    own = own.withColumns({"__a": pct_rank(F.col("prob_top"), "trained_to"), "__b": pct_rank(F.col("excess_return"), "trained_to")})
    error = F.col("pred_return") - F.col("excess_return")
    best = own.where(F.col("__r") <= k).groupBy("trained_to", "date").agg(F.avg(F.col("is_top20pct").cast("double")).alias("p")).groupBy("trained_to").agg(F.avg("p").alias("precision"))
    each = own.groupBy("trained_to").agg(F.count(F.lit(1)).alias("n_scored"), F.corr("__a", "__b").alias("rank_ic"), F.sqrt(F.avg(error * error)).alias("rmse"), F.stddev_pop("excess_return").alias("spread"))
    return trained.windows.join(each, "trained_to", "left").join(best, "trained_to", "left").select("window", "trained_to", "first", "last", "n_train", "n_scored", "precision", "rank_ic", "rmse", "spread")


def prediction_scores(predictions: DataFrame) -> DataFrame:
    """confidence, long and short scores from two class probabilities and the ranked return."""
    rank = pct_rank(F.col("pred_return"), "date")
    long = clip(0.6 * F.col("prob_top") + 0.4 * rank)
    short = clip(0.6 * F.col("prob_bottom") + 0.4 * (1 - rank))
    confidence = F.greatest(F.col("prob_top"), 1 - F.col("prob_top"))
    return predictions.select("date", "symbol", rounded(confidence).alias("confidence"), rounded(long).alias("long_score"), rounded(short).alias("short_score"))


def evaluate(predictions: DataFrame, k: int) -> DataFrame:
    """One row: mean precision of the k best of each date, rank correlation and error against the excess return."""
    own = predictions.where("excess_return is not null").withColumn("__r", first_rank(F.col("pred_prob_top20"), "date"))
    each = own.where(F.col("__r") <= k).groupBy("date").agg(F.avg(F.col("is_top20pct").cast("double")).alias("p"))
    ranked = with_pooled_ranks(own, __a="pred_prob_top20", __b="excess_return")
    error = F.col("pred_return") - F.col("excess_return")
    whole = ranked.agg(F.count(F.lit(1)).alias("n"), rounded(F.corr("__a", "__b"), 5).alias("rank_ic"), rounded(F.sqrt(F.avg(error * error)), 5).alias("rmse"))
    return whole.join(F.broadcast(each.agg(rounded(F.avg("p")).alias("precision"))))  # one row each


def nearest_centroid(rows: DataFrame, centroids: list[list[float]], vector: str = "embedding") -> DataFrame:
    """The nearest of a few fixed centroids to each row, and its distance; the first of equally near ones."""

    def gap(c: list[float]) -> Column:
        return F.aggregate(F.zip_with(F.col(vector), F.array(*map(F.lit, c)), lambda x, y: F.pow(x.cast("double") - y, F.lit(2.0))), F.lit(0.0), lambda a, x: a + x)

    best = F.array_min(F.array(*[F.struct(gap(c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centroids)]))
    return rows.withColumn("__b", best).withColumn("cluster", F.col("__b.i")).withColumn("distance", F.sqrt("__b.d")).drop("__b")


def clusters(rows: DataFrame, columns: list[str], k: int = 5, seed: int = 42) -> DataFrame:
    """K-means clusters over median-filled, standardised columns."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler

    filled = [f"{c}__f" for c in columns]
    model = Pipeline(
        stages=[Imputer(strategy="median", inputCols=columns, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="__v"), StandardScaler(inputCol="__v", outputCol="__x", withMean=True), KMeans(featuresCol="__x", predictionCol="cluster", k=k, seed=seed)]
    ).fit(rows)
    return model.transform(rows).drop("__v", "__x", *filled)


# Quantiles of the centroids that a cluster must reach for its label, in order of the rules.
LABELS = ("high_momentum", "calm_large", "liquid", "recovering", "mixed")


def cluster_labels(centres: dict[str, list[float]]) -> list[str]:
    """Labels of clusters by their centroids (feature -> value for each cluster): the first rule that holds."""
    import numpy as np

    c = {k: np.array(v, float) for k, v in centres.items()}
    q = lambda name, share: np.quantile(c[name], share)
    rules = (
        c["momentum_score"] >= q("momentum_score", 0.75), (c["volatility_60d"] <= q("volatility_60d", 0.35)) & (c["size_score"] >= q("size_score", 0.5)), c["liquidity_score"] >= q("liquidity_score", 0.75), c["ret_21d"] > c["ret_126d"],
    )
    return [next((name for name, holds in zip(LABELS, rules, strict=False) if holds[i]), LABELS[-1]) for i in range(len(c["momentum_score"]))]


#: Rows that the first centres are drawn from, and rounds until the restarts must have settled.
START_ROWS, MOST_ROUNDS = 4_096, 40


def best_clusters(rows: DataFrame, columns: list[str], *, key: str = "symbol", k: int = 5, restarts: int = 20, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(key, cluster, distance) of every row, and the clusters: number, members, raw centroids; the best of several starts.

    Missing values are the column's median, columns are standardised.  All
    restarts move together: a round is one pass over the rows, in which a task
    adds up the members of every centre of every restart.  Starts are drawn far
    apart from at most START_ROWS rows.  Clusters are numbered by size, then by
    centroid; a row between two centres goes to the first.
    """
    import numpy as np

    medians = [F.coalesce(F.median(c), F.lit(0.5)).alias(c) for c in columns]
    filled = rows.join(F.broadcast(rows.agg(*[m.alias(f"__m_{c}") for m, c in zip(medians, columns, strict=True)])))  # one row
    filled = filled.select(key, *[F.coalesce(F.col(c).cast("double"), F.col(f"__m_{c}")).alias(c) for c in columns])
    got = filled.agg(*[F.avg(c).alias(f"a_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    mean = np.array([got[f"a_{c}"] if got[f"a_{c}"] is not None else 0.0 for c in columns])
    scale = np.array([got[f"s_{c}"] or 1.0 for c in columns])
    points = boost.staged(filled.select(key, F.array(*[(F.col(c) - float(m)) / float(s) for c, m, s in zip(columns, mean, scale, strict=True)]).alias("x")), "cluster-points")
    first = np.array([r.x for r in points.orderBy(F.xxhash64(key), key).limit(START_ROWS).collect()])
    shape = f"{key} {rows.schema[key].dataType.simpleString()}, cluster int, distance double"
    if not len(first):
        return rows.sparkSession.createDataFrame([], shape), rows.sparkSession.createDataFrame([], "cluster int, members long, centroid array<double>")
    rng = np.random.default_rng(seed)
    k = min(k, len(np.unique(first, axis=0)))
    starts = []
    for _ in range(restarts):
        chosen = [first[rng.integers(len(first))]]
        while len(chosen) < k:
            far = np.min([((first - c) ** 2).sum(axis=1) for c in chosen], axis=0)
            chosen.append(first[rng.choice(len(first), p=far / far.sum())])
        starts.append(chosen)
    centres, spark = np.array(starts), rows.sparkSession

    def sums(centres):
        """(restarts, k, columns + 2): sums, members and squared distances."""
        sent = spark.sparkContext.broadcast(centres)  # restarts x k centres

        def run(batches):
            import pyarrow as pa

            c = sent.value
            total = np.zeros((len(c), c.shape[1], c.shape[2] + 2))
            for batch in batches:
                if batch.num_rows:
                    x = np.array(batch.column(1).to_pylist())
                    for r in range(len(c)):
                        far = ((x[:, None, :] - c[r][None]) ** 2).sum(axis=2)
                        near = far.argmin(axis=1)
                        np.add.at(total[r], near, np.column_stack((x, np.ones(len(x)), far[np.arange(len(x)), near])))
            yield pa.record_batch([pa.array(np.arange(len(c), dtype=np.int32)), pa.array([t.tobytes() for t in total], pa.binary())], names=["window", "v"])

        out = np.zeros((len(centres), centres.shape[1], centres.shape[2] + 2))
        for r, v in boost.added(points.mapInArrow(run, "window int, v binary")):
            out[r] += v.reshape(out[r].shape)
        sent.destroy()
        return out

    for _ in range(MOST_ROUNDS):
        found = sums(centres)
        n = found[:, :, -2:-1]
        after = np.where(n > 0, found[:, :, :-2] / np.maximum(n, 1), centres)
        if np.allclose(after, centres, atol=1e-12):
            break
        centres = after
    best = int(found[:, :, -1].sum(axis=1).argmin())
    members = found[best, :, -2].astype(int)
    order = sorted(range(len(members)), key=lambda i: (-members[i], centres[best, i].tolist()))
    final = centres[best][order]

    def assign(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column(1).to_pylist())
                far = np.sqrt(((x[:, None, :] - final[None]) ** 2).sum(axis=2))
                near = far.argmin(axis=1)
                yield pa.record_batch([batch.column(0), pa.array(near.astype(np.int32)), pa.array(far[np.arange(len(x)), near])], names=[key, "cluster", "distance"])

    summary = [(i, int(members[j]), [float(v) for v in centres[best, j] * scale + mean]) for i, j in enumerate(order)]
    return points.mapInArrow(assign, shape), spark.createDataFrame(summary, "cluster int, members long, centroid array<double>")


def ablation(scored: DataFrame, weights: dict[str, float], neutral: list[str]) -> DataFrame:
    """Score and rank with and without some factors, and how much they matter."""
    from quantloom.functions.columns import weighted

    own = scored.withColumn("without", rounded(weighted({c: w for c, w in weights.items() if c not in neutral}) + sum(w * 0.5 for c, w in weights.items() if c in neutral)))
    own = own.withColumn("delta", rounded(F.col("final_score") - F.col("without")))
    moved = F.abs(first_rank(F.col("final_score"), "date") - first_rank(F.col("without"), "date"))
    own = own.withColumn("moved", moved.cast("long"))
    level = F.when((F.abs("delta") >= 0.05) | (F.col("moved") >= 5), "high").when((F.abs("delta") >= 0.02) | (F.col("moved") >= 2), "medium").otherwise("low")
    return own.select("date", "symbol", "delta", "moved", level.alias("level"))
