"""As-of and range joins: union both sides, carry the right side along the order, keep the left side.

One shuffle on the key and linear work, whatever the number of matches.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, *, key: str, left_on: str, right_on: str, take: list[str], forward: bool = False, strict: bool = False, lag_days: int = 0) -> DataFrame:
    """Each left row with the nearest right row at or before it (``forward``: at or after).

    ``strict`` leaves out equal times.  ``lag_days`` asks for right rows at
    least so many days earlier.  Of right rows that share key and time, the
    one with the largest ``take`` values counts.  Without a match ``take`` and
    the matched time are NULL.
    """
    at = F.date_add(F.col(right_on), lag_days) if lag_days else F.col(right_on)
    one = right.groupBy(F.col(key).alias("__k"), at.alias("__t")).agg(F.max(F.struct(F.col(right_on).alias("__m"), *take)).alias("__r"))
    cols = left.columns
    # at equal times a right row must come before a left row to be seen by it
    mine, theirs = (0, 1) if strict else (1, 0)
    if forward:
        mine, theirs = theirs, mine
    l = left.select(F.col(key).alias("__k"), F.col(left_on).alias("__t"), F.lit(mine).alias("__o"), F.struct(*cols).alias("__l"), F.lit(None).cast(one.schema["__r"].dataType).alias("__r"))
    r = one.select("__k", "__t", F.lit(theirs).alias("__o"), F.lit(None).cast(l.schema["__l"].dataType).alias("__l"), "__r")
    order = [F.col("__t").desc(), F.col("__o").desc()] if forward else [F.col("__t"), F.col("__o")]
    spec = Window.partitionBy("__k").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    both = l.unionByName(r).withColumn("__hit", F.last("__r", ignorenulls=True).over(spec))
    return both.where("__l is not null").select("__l.*", F.col("__hit.__m").alias("matched_at"), *[F.col(f"__hit.{c}").alias(c) for c in take])


def trailing_join(left: DataFrame, right: DataFrame, *, key: str, left_on: str, right_on: str, days: int, aggs: list) -> DataFrame:
    """Aggregates of right rows in (t - days, t] for each left row's date t.

    The right side goes once to each bucket of ``days`` that a window can
    reach, so the join is an equi-join; rows without a match are kept.
    """
    bucket = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01").cast("date")) / days)
    r = right.select("*", F.explode(F.array(bucket(F.col(right_on)), bucket(F.col(right_on)) + 1)).alias("__b"))
    l = left.select(key, left_on).distinct().withColumn("__b", bucket(F.col(left_on)))
    r = r.withColumnRenamed(key, "__k").withColumnRenamed(right_on, "__t")
    cond = (l["__b"] == r["__b"]) & (l[key] == r["__k"]) & (r["__t"] <= l[left_on]) & (r["__t"] > F.date_sub(l[left_on], days))
    return l.join(r, cond, "left").groupBy(key, left_on).agg(*aggs)


@dataclass(frozen=True)
class Latest:
    """Columns of a feed's last row at or before a date, ``lag_days`` earlier at least; equal times: the largest values."""

    rows: DataFrame
    on: str
    take: list[str]
    lag_days: int = 0


@dataclass(frozen=True)
class Trailing:
    """Sums, counts or other aggregates (new name -> function of a column, column) of a feed's rows of the last ``days`` days, the date's included."""

    rows: DataFrame
    on: str
    days: int
    aggs: dict[str, tuple] = field(default_factory=dict)


def _day(c: Column) -> Column:
    return F.datediff(c, F.lit("1970-01-01").cast("date"))


def carry(left: DataFrame, *, key: str, on: str, latest: dict[str, Latest] | None = None, trailing: dict[str, Trailing] | None = None) -> DataFrame:
    """``left`` with what every feed knows of its key at its date, in one shuffle and one sort, however many feeds there are.

    All rows go to their key and stand by day; of one day the feeds' rows come
    first.  A latest feed adds its ``take`` columns and ``<name>_at``, a
    trailing one its aggregates; both are NULL (counts 0) where nothing was
    seen yet.  Feeds have the key under the same name.
    """
    latest, trailing = latest or {}, trailing or {}
    cols = left.columns
    rows = left.select(F.col(key).alias("__k"), _day(F.col(on)).alias("__d"), F.lit(1).alias("__o"), F.struct(*cols).alias("__l"))
    for name, feed in latest.items():
        own = feed.rows.select(F.col(key).alias("__k"), (_day(F.col(feed.on)) + feed.lag_days).alias("__d"), F.lit(0).alias("__o"), F.struct(F.col(feed.on).alias("at"), *feed.take).alias(f"__{name}"))
        rows = rows.unionByName(own, allowMissingColumns=True)
    for name, feed in trailing.items():
        used = sorted({c for _, c in feed.aggs.values()})
        own = feed.rows.select(F.col(key).alias("__k"), _day(F.col(feed.on)).alias("__d"), F.lit(0).alias("__o"), *[F.col(c).alias(f"__{name}_{c}") for c in used])
        rows = rows.unionByName(own, allowMissingColumns=True)
    order = Window.partitionBy("__k").orderBy("__d", "__o", *[f"__{name}" for name in latest])
    seen = order.rowsBetween(Window.unboundedPreceding, 0)
    more = {f"__{name}": F.last(f"__{name}", ignorenulls=True).over(seen) for name in latest}
    for name, feed in trailing.items():
        frame = Window.partitionBy("__k").orderBy("__d").rangeBetween(-(feed.days - 1), 0)
        more |= {f"__{name}_{out}": agg(F.col(f"__{name}_{c}")).over(frame) for out, (agg, c) in feed.aggs.items()}
    known = rows.select("__l", *[x.alias(c) for c, x in more.items()]).where("__l is not null")
    picked = [x for name, feed in latest.items() for x in (F.col(f"__{name}.at").alias(f"{name}_at"), *[F.col(f"__{name}.{c}").alias(c) for c in feed.take])]
    return known.select("__l.*", *picked, *[F.col(f"__{name}_{out}").alias(out) for name, feed in trailing.items() for out in feed.aggs])


def latest_by_day(days: DataFrame, rows: DataFrame, wanted: dict[str, tuple[str, str]], *, on: str, key: str = "symbol", lag_days: int = 0) -> DataFrame:
    """A row for each date with, under each wanted name, a column of one key's last row at or before it.

    Each key goes through the dates on its own; dates and wanted keys are few.
    """
    keys = sorted({k for k, _ in wanted.values()})
    take = sorted({c for _, c in wanted.values()})
    asked = days.select("date", F.explode(F.array(*map(F.lit, keys))).alias(key))
    known = carry(asked, key=key, on="date", latest={"row": Latest(rows.where(F.col(key).isin(*keys)), on, take, lag_days)})
    return known.groupBy("date").agg(*[F.max(F.when(F.col(key) == k, F.col(c))).alias(name) for name, (k, c) in wanted.items()])
