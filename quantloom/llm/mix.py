"""Mixing sources to target weights by systematic sampling.

Within a source every document expects target / source size copies.  Prefix
sums of the expected copies, plus one random offset a source, emit a document
once for each integer boundary that its share of the line crosses.  Documents
stand in order of size class, so neighbours are of like size and the words
taken come near the target.  The prefix sum is taken in two levels, within
(source, size class, salt) and over those groups' counts, so that no task
orders a whole source.  A class has as many salts as its rows need, and equal
rows are counted before they meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

WEIGHTS, SHARE, MAX_COPIES = (3.0, 1.0, 2.0), 1.5, 2.0
#: Rows of a source and size class that share a salt, on average.
SALT_ROWS = 5_000
TOKEN_BREAK = r"[\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    """Number of words between ASCII white space; null: 0."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), TOKEN_BREAK), "")).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """source, source_size, target, copies: water filling over the (few) sources.

    Sources in code-point order, null last, take the weights in turn.  A source
    is full at ``most`` times its size; the sources fill up in order of
    most * size / weight, and the level of the others follows from two sums.
    """
    cap = F.lit(most) * F.col("source_size")
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weighed = sizes.select("source", "source_size", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1).alias("w"), cap.alias("cap"))
    weighed = weighed.withColumn("fill", F.col("cap") / F.col("w"))
    filled = Window.orderBy("fill", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everyone = Window.partitionBy()
    left = F.lit(share) * F.sum("source_size").over(everyone) - F.coalesce(F.sum("cap").over(filled), F.lit(0.0))
    level = left / (F.sum("w").over(everyone) - F.coalesce(F.sum("w").over(filled), F.lit(0.0)))
    # the level settles at the first source that it does not fill; if it fills all, at the last
    level = weighed.withColumn("level", level)
    top = F.coalesce(F.min(F.when(F.col("level") <= F.col("fill"), F.struct("fill", "level"))).over(everyone)["level"], F.lit(float("inf")))
    out = level.withColumn("target", F.least("cap", F.col("w") * top))
    return out.select("source", "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("copies"))


def offset_of(source: Column, seed: int) -> Column:
    """A random number in [0, 1) for each source and seed, the same on every run."""
    return F.conv(F.substring(F.md5(F.coalesce(F.concat(F.lit(f"{seed}:"), source), F.lit(f"{seed}/")).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE, max_copies: float = MAX_COPIES, salt_rows: int = SALT_ROWS, seed: int = 7,
) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken of every row.

    Null sources are one source, the last; null and empty texts have size 0 and
    may be emitted without adding words.  Rows that repeat an id are told apart
    by their text, and each is drawn on its own; equal rows take places beside
    each other.  A source whose texts are all empty has target 0.  An empty
    table gives an empty one.  Ids are of any type that casts to string.  Other
    columns are ignored.
    """
    name = F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text), F.lit(""))).cast("binary"))
    own = docs.select(F.col(doc_id).alias("id"), F.col(source).alias("source"), size_of(F.col(text)).alias("size"), name.alias("name"))
    # size class: a quarter of a doubling
    own = stage(own.groupBy("source", F.floor(F.log2(F.col("size") + 1) * 4 + 1e-9).cast("int").alias("class"), "name", "id", "size").agg(F.count(F.lit(1)).alias("n")), "sizes")
    classes = own.groupBy("source", "class").agg(F.sum("n").alias("c_rows"), F.sum(F.col("n") * F.col("size")).alias("c_words"))
    same = lambda a, b, cols: [a[c].eqNullSafe(b[c]) for c in cols]
    rule = stage(classes.select(F.col("source").alias("c_source"), F.col("class").alias("c_class"), F.ceil(F.col("c_rows") / salt_rows).cast("long").alias("salts"), "c_words"), "classes")
    hashed = F.conv(F.substring("name", 1, 8), 16, 10).cast("long")
    salted = own.join(rule, own["source"].eqNullSafe(rule["c_source"]) & (own["class"] == rule["c_class"])).select("id", "source", "size", "class", "name", "n", F.pmod(hashed, F.col("salts")).alias("salt"))
    plan = targets(rule.groupBy(F.col("c_source").alias("source")).agg(F.sum("c_words").alias("source_size")), weights, share, max_copies)
    groups = salted.groupBy("source", "class", "salt").agg(F.sum("n").alias("g_rows"))
    place = Window.partitionBy("source").orderBy("class", "salt").rowsBetween(Window.unboundedPreceding, -1)
    placed = groups.withColumn("before", F.coalesce(F.sum("g_rows").over(place), F.lit(0)))
    ruled = placed.join(plan, same(placed, plan, ["source"])).select(placed["source"].alias("g_source"), F.col("class").alias("g_class"), F.col("salt").alias("g_salt"), "before", "source_size", "target", "copies")
    upto = F.sum("n").over(Window.partitionBy("source", "class", "salt").orderBy("name", "size").rowsBetween(Window.unboundedPreceding, 0))
    ranked = salted.withColumn("last", upto)
    both = ranked.join(ruled, ranked["source"].eqNullSafe(ruled["g_source"]) & (ranked["class"] == ruled["g_class"]) & (ranked["salt"] == ruled["g_salt"]))
    ranks = F.explode(F.sequence(F.col("last") - F.col("n") + 1, F.col("last"))).alias("rank")
    each = both.select("id", "source", "size", "source_size", "target", "copies", "before", ranks).withColumn("rank", F.col("before") + F.col("rank"))
    u = offset_of(F.col("source"), seed)
    crossed = (F.floor(F.col("rank") * F.col("copies") + u) - F.floor((F.col("rank") - 1) * F.col("copies") + u)).cast("long")
    return each.select(F.col("id").alias(doc_id), "source", "size", "source_size", "target", crossed.alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))
