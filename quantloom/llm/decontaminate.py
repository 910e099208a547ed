"""Benchmark decontamination: prefix-filtered set join of word shingles, verified over item-sized windows.

Everything here is DataFrame functions.  An item's windows are 13 consecutive
words (an item of fewer words is one window).  A window is the set of its word
shingles; a text that contains the window contains all of them, so its rarest
shingle over the corpus is a sufficient prefix.  Texts are exploded to shingle
positions, joined with those prefixes only, and each candidate is verified
word by word at the position that the prefix fixes.

The windows are broadcast in blocks of at most ``block_windows`` windows and
``block_bytes`` bytes of words (a proven bound); more windows mean more passes
over the texts, never a larger broadcast.  Windows have numbers; the items
that hold a window are a table of their own, which meets the documents only
after those with the same windows have become one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, stage, unstage

#: Outside A-Z, a-z, 0-9 and anything beyond ASCII; the same splits before and after lower-casing.
WORD_BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW, SHINGLE, BLOCK_WINDOWS, BLOCK_BYTES = 13, 4, 100_000, 32 << 20
#: A text is contaminated if at least one word in twenty is hit.
PER_HIT = 20


def words_of(text: Column, lower: bool = True) -> Column:
    text = F.coalesce(text, F.lit(""))
    return F.array_remove(F.split(ascii_lower(text) if lower else text, WORD_BREAK), "")


def item_windows(items: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """Distinct (item, win, len): the windows of each item and their numbers of words."""
    words = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item"), words_of(F.col(text)).alias("words"))
    cut = words.where(F.size("words") > 0).withColumn("len", F.least(F.size("words"), F.lit(window)))
    cut = cut.select("item", "len", "words", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("len"))).alias("s"))
    return cut.select("item", "len", F.slice("words", F.col("s") + 1, F.col("len")).alias("win")).distinct()


def _positions(docs: DataFrame, k: int) -> DataFrame:
    """A row for each shingle of k words: position p and hash h; the words ride along inside the stage."""
    at = docs.select("*", F.posexplode_outer("words").alias("p", "w")).where(F.col("p") + k <= F.size("words"))
    return at.withColumn("h", F.xxhash64(F.slice("words", F.col("p") + 1, F.lit(k)))).drop("w")


def window_hits(docs: DataFrame, windows: DataFrame, blocks: int = 1) -> DataFrame:
    """Occurrences of windows in ``docs`` (key columns and words): key columns, s, len, wid."""
    keys = [c for c in docs.columns if c != "words"]
    kinds = [r.k for r in windows.select("k").distinct().collect()]  # at most SHINGLE values
    found = []
    for k in kinds:
        for b in range(blocks):
            own = windows.where((F.col("k") == k) & (F.pmod(F.xxhash64("win"), F.lit(blocks)) == b))
            grams = own.select("win", F.explode(F.sequence(F.lit(0), F.col("len") - k)).alias("off")).withColumn("h", F.xxhash64(F.slice("win", F.col("off") + 1, F.lit(k))))
            rare = _positions(docs, k).select("h").join(F.broadcast(grams.select("h").distinct()), "h", "left_semi").groupBy("h").agg(F.count(F.lit(1)).alias("n"))
            seen = stage(rare, "shingle-counts")
            # a window with a shingle that no text has cannot occur
            prefix = grams.join(seen, "h", "left").groupBy("win").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "off", "h")).alias("first"))
            prefix = prefix.where("first.n > 0").select("win", "first.off", "first.h").join(own, "win")
            prefix = stage(prefix.select("h", "off", "len", "win", "wid"), "window-prefixes")
            start = F.col("p") - F.col("off")
            same = (start >= 0) & (start + F.col("len") <= F.size("words")) & (F.slice("words", F.greatest(start + 1, F.lit(1)), F.col("len")) == F.col("win"))
            found.append(_positions(docs, k).join(F.broadcast(prefix), "h").where(same).select(*keys, start.alias("s"), "len", "wid"))
    if not found:
        return docs.select(*keys, F.lit(0).alias("s"), F.lit(0).alias("len"), F.lit(0).cast("long").alias("wid")).where("false")
    return reduce(DataFrame.unionByName, found)


def contamination(
    docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, shingle: int = SHINGLE, per_hit: int = PER_HIT, block_windows: int = BLOCK_WINDOWS, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """doc_id, text_hash, n_words, n_hit, n_items, items_sha256 and contaminated of every row.

    A null or empty text has no words and is clean.  Rows that repeat both id
    and text repeat their result.  An item without words never hits; an item
    without id has the id "null".  Without items every row is clean; an empty
    table gives an empty one.  Other columns of ``docs`` and ``items`` are
    ignored, whatever their names.
    """
    pairs = stage(item_windows(items, item_id, item_text, window), "item-windows")
    own = pairs.select("win", "len").distinct()
    windows = stage(own.select("win", "len", F.least("len", F.lit(shingle)).alias("k"), F.monotonically_increasing_id().alias("wid")), "windows")
    size = windows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(F.array_join("win", " "))), F.lit(0)).alias("bytes")).first()
    blocks = max(1, -(-size["n"] // block_windows), -(-size["bytes"] // block_bytes))
    base = docs.select(F.col(doc_id).alias("__id"), F.xxhash64(F.col(text)).alias("__h"), F.col(text).alias("__t"))
    hits = stage(window_hits(base.select("__id", "__h", words_of(F.col("__t")).alias("words")), windows, blocks), "window-hits")
    order = Window.partitionBy("__id", "__h").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    spans = hits.groupBy("__id", "__h", "s").agg(F.max("len").alias("len"), F.collect_set("wid").alias("wids"))  # a place starts at most ``window`` windows
    end = F.col("s") + F.col("len")
    fresh = F.greatest(F.lit(0), end - F.greatest(F.col("s"), F.coalesce(F.max(end).over(order), F.col("s"))))
    # a document's windows are at most its own places; documents with the same ones share one list of items
    each = spans.select("__id", "__h", fresh.alias("fresh"), "wids").groupBy("__id", "__h").agg(F.sum("fresh").cast("long").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("wids")))).alias("wids"))
    each = stage(each.withColumn("set", F.sha2(F.array_join(F.col("wids").cast("array<string>"), ",").cast("binary"), 256)), "documents-hit")
    held = pairs.join(windows.select("win", "wid"), "win").select("wid", "item")
    sets = each.groupBy("set").agg(F.first("wids").alias("wids")).select("set", F.explode("wids").alias("wid")).join(held, "wid").groupBy("set").agg(F.sort_array(F.collect_set("item")).alias("items"))
    listed = stage(sets.select("set", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256")), "item-lists")
    unstage(pairs, windows, hits)
    hit = each.join(listed, "set").select(F.col("__id").alias("h_id"), F.col("__h").alias("h_h"), "n_hit", "n_items", "items_sha256")
    own = base.select("__id", "__h", F.size(words_of(F.col("__t"), lower=False)).cast("long").alias("n_words"))
    both = own.join(hit, own["__id"].eqNullSafe(hit["h_id"]) & (own["__h"] == hit["h_h"]), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return both.select(
        F.col("__id").alias(doc_id), F.col("__h").alias("text_hash"), "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"), ((n_hit > 0) & (n_hit * per_hit >= F.col("n_words"))).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, **kw) -> DataFrame:
    """``docs`` without contaminated rows, columns as given.

    Rows are judged by id and text, so repeated rows go or stay together; rows
    without words stay.  Without items every row stays; an empty table gives an
    empty one.
    """
    doc_id, text = kw.get("doc_id", "doc_id"), kw.get("text", "text")
    bad = contamination(docs, items, **kw).where("contaminated").select(F.col(doc_id).alias("__bad"), F.col("text_hash").alias("__bad_h")).distinct()
    return docs.join(bad, F.col(doc_id).eqNullSafe(F.col("__bad")) & (F.xxhash64(F.col(text)) == F.col("__bad_h")), "left_anti")
