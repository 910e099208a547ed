"""Nearest neighbours by inverted lists, with an exact second pass.

Equal vectors count once, with their smallest ids.  Centroids are fitted on a
bounded sample; every vector goes to the list of its nearest one.  A search
first probes the lists nearest to the query.  The k-th distance found there
bounds what other lists can hold: by the triangle inequality only lists, and in
them only members, whose distance from the centroid allows a nearer vector are
looked at.  Lists and queries meet in blocks of bounded size, so neither a
large list nor a frequent vector falls to one task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors that the centroids are fitted on, and rounds of the fit.
SAMPLE, ROUNDS, MOST_LISTS = 4_096, 8, 256
#: Members, and queries, of a list that meet in one group.
BLOCK = 4_096
#: Lists that are probed first.
PROBES = 8
SALTS = 64


def distinct_vectors(rows: DataFrame, k: int, *, vec_id: str, vector: str, group: str) -> DataFrame:
    """(g, h, v, ids, asked): each different vector of a group with its k + 1 smallest ids, and the smallest asked ones' flag.

    Copies are reduced by salt first, then together.  Rows without id or with
    a vector that is null or holds nulls are left out.
    """
    own = rows.where(F.col(vec_id).isNotNull() & F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull()))
    own = own.select(F.col(group).cast("string").alias("g"), F.col(vec_id).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    own = own.withColumns({"h": F.xxhash64("v"), "salt": F.pmod(F.xxhash64("id"), F.lit(SALTS))})
    place = F.row_number().over(Window.partitionBy("g", "h", "v", "salt").orderBy("id"))
    few = own.withColumn("r", place).where(F.col("r") <= k + 1).groupBy("g", "h", "v").agg(F.array_sort(F.collect_set("id")).alias("ids"))  # SALTS * (k + 1) at most
    return few.select("g", "h", "v", F.slice("ids", 1, k + 1).alias("ids"))


def centroids(points: DataFrame, lists: int | None = None, seed: int = 3) -> np.ndarray:
    """K-means centres of at most SAMPLE vectors, those with the smallest hashes."""
    got = [r.v for r in points.select("v", F.xxhash64("h").alias("o")).orderBy("o").limit(SAMPLE).collect()]
    if not got:
        return np.zeros((0, 0))
    x = np.array(got)
    n = min(len(x), lists or max(1, int(len(x) ** 0.5)), MOST_LISTS)
    c = x[np.random.default_rng(seed).permutation(len(x))[:n]]
    for _ in range(ROUNDS):
        near = _squares(x, c).argmin(axis=1)
        c = np.stack([x[near == i].mean(axis=0) if (near == i).any() else c[i] for i in range(n)])
    return c


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None] - 2 * x @ y.T, 0.0)


def _listed(points: DataFrame, c: np.ndarray, most: int | None, schema: str) -> DataFrame:
    """Each point with its nearest lists and their distances, the nearest first."""
    sent = points.sparkSession.sparkContext.broadcast(c)  # MOST_LISTS vectors

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.array(batch.column(batch.schema.names.index("v")).to_pylist())
            d = np.sqrt(_squares(x, sent.value))
            order = np.argsort(d, axis=1, kind="stable")[:, :most]
            yield pa.record_batch([*batch.columns, pa.array(order.tolist(), pa.list_(pa.int32())), pa.array(np.take_along_axis(d, order, 1).tolist(), pa.list_(pa.float64()))], names=[*batch.schema.names, "lists", "away"])

    return points.mapInArrow(run, schema + ", lists array<int>, away array<double>")


def _met(asked: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """(q, h, d): the k + 1 nearest members of each group of blocks for each of its queries."""

    def run(key, left, right):
        import pandas as pd

        if left.empty or right.empty:
            return pd.DataFrame({"q": [], "h": [], "d": []}).astype({"q": "int64", "h": "int64", "d": "float64"})
        y, away, names, out = np.stack(right["v"]), right["r"].to_numpy(), right["h"].to_numpy(), []
        for at in range(0, len(left), 256):
            own = left.iloc[at : at + 256]
            x = np.stack(own["v"])
            d = _squares(x, y)
            bound = own["bound"].to_numpy()[:, None]
            d = np.where(np.abs(own["c"].to_numpy()[:, None] - away[None]) <= bound * (1 + 1e-9) + 1e-9, d, np.inf)
            best = np.argpartition(d, min(k + 4, d.shape[1] - 1), axis=1)[:, : k + 5]
            exact = np.sqrt(((x[:, None, :] - y[best]) ** 2).sum(axis=2))
            seen = np.isfinite(np.take_along_axis(d, best, 1))
            q = np.repeat(own["q"].to_numpy(), best.shape[1]).reshape(best.shape)
            out.append(pd.DataFrame({"q": q[seen], "h": names[best[seen]], "d": exact[seen]}))
        return pd.concat(out)

    keys = ["g", "list", "mb", "qb"]
    return asked.groupby(*keys).cogroup(members.groupby(*keys)).applyInPandas(run, "q long, h long, d double")


def nearest(rows: DataFrame, asked: DataFrame, k: int, *, vec_id: str = "vec_id", vector: str = "embedding", group: str = "label", probes: int = PROBES, lists: int | None = None, exact: bool = True, keep=None) -> DataFrame:
    """vec_id, peer, distance, place: the k nearest other rows of its group for every asked row, ties by id.

    ``asked`` holds the ids to look for.  Without ``exact`` only ``probes``
    lists are searched.  ``keep`` stages a table that is read again.
    """
    keep = keep or (lambda df, name: df)
    points = keep(distinct_vectors(rows, k, vec_id=vec_id, vector=vector, group=group), "vectors")
    c = centroids(points, lists)
    spark = rows.sparkSession
    if not len(c):
        return rows.where("false").select(F.col(vec_id), F.col(vec_id).alias("peer"), F.lit(0.0).alias("distance"), F.lit(0).alias("place"))
    base = "g string, h long, v array<double>, ids array<long>"
    held = _listed(points.select("g", "h", "v", F.col("ids").cast("array<long>").alias("ids")), c, 1, base).select("g", "h", "v", "ids", F.get("lists", F.lit(0)).alias("list"), F.get("away", F.lit(0)).alias("r"))
    held = keep(held, "lists")
    sizes = held.groupBy("g", "list").agg(F.count(F.lit(1)).alias("n"), F.max("r").alias("radius"), F.min("r").alias("core"))
    sizes = keep(sizes.withColumn("mbs", F.ceil(F.col("n") / BLOCK).cast("int")), "list-sizes")

    wanted = rows.join(asked.select(F.col(vec_id)).distinct(), vec_id, "left_semi").where(F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull()))
    own = wanted.select(F.col(group).cast("string").alias("g"), F.col(vec_id).cast("long").alias("id"), F.xxhash64(F.col(vector).cast("array<double>")).alias("h"), F.col(vector).cast("array<double>").alias("v"))
    queries = keep(_listed(own.groupBy("g", "h").agg(F.first("v").alias("v")), c, None, "g string, h long, v array<double>").withColumn("q", F.xxhash64("g", "h")), "queries")

    def search(pairs: DataFrame) -> DataFrame:
        """``pairs`` (g, q, v, list, c, bound) against the lists' members."""
        n = pairs.groupBy("g", "list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("qbs"))
        both = sizes.join(n, ["g", "list"]).select("g", "list", "mbs", "qbs")
        left = pairs.join(both, ["g", "list"]).select("g", "list", F.pmod("q", "qbs").cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.col("mbs") - 1)).alias("mb"), "q", "v", "c", "bound")
        right = held.join(both, ["g", "list"]).select("g", "list", F.pmod("h", "mbs").cast("int").alias("mb"), F.explode(F.sequence(F.lit(0), F.col("qbs") - 1)).alias("qb"), "h", "v", "r")
        return _met(left, right, k)

    spread = queries.select("g", "q", "v", F.posexplode(F.arrays_zip("lists", "away")).alias("rank", "x")).select("g", "q", "v", "rank", F.col("x.lists").alias("list"), F.col("x.away").alias("c"))
    found = keep(search(spread.where(F.col("rank") < probes).withColumn("bound", F.lit(float("inf")))), "probed")
    if exact:
        # copies count: the bound is the distance at which k + 1 rows are reached
        near = found.join(held.select("h", "g", F.size("ids").alias("copies")), "h").join(queries.select("q", F.col("g").alias("qg")), "q").where("g = qg")
        upto = F.sum("copies").over(Window.partitionBy("q").orderBy("d", "h").rowsBetween(Window.unboundedPreceding, 0))
        bound = near.withColumn("u", upto).where(F.col("u") >= k + 1).groupBy("q").agg(F.min("d").alias("bound"))
        rest = spread.where(F.col("rank") >= probes).join(bound, "q", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf")))).join(sizes.select("g", "list", "radius", "core"), ["g", "list"])
        slack = F.col("bound") * (1 + 1e-9) + 1e-9
        rest = rest.where((F.col("c") - F.col("radius") <= slack) & (F.col("core") - F.col("c") <= slack)).drop("radius", "core")
        found = found.unionByName(search(rest))
    best = F.row_number().over(Window.partitionBy("q").orderBy("d", "h"))
    short = found.withColumn("p", best).where(F.col("p") <= k + 1).drop("p")
    peers = short.join(held.select("h", F.col("g").alias("hg"), "ids"), "h").join(queries.select("q", "g"), "q").where("hg = g").select("q", "d", F.explode("ids").alias("peer"))
    near = own.select("id", F.xxhash64("g", "h").alias("q")).distinct().join(peers, "q").where("id <> peer")
    place = F.row_number().over(Window.partitionBy("id").orderBy("d", "peer"))
    out = near.withColumn("place", place).where(F.col("place") <= k)
    return out.select(F.col("id").alias(vec_id), "peer", F.col("d").alias("distance"), "place")
