"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed into dictionary phrases, each the longest known phrase and
one character more.  Texts that compress well against each other share
phrases, so the share of equal minimum hashes of two phrase sets estimates a
compression-like likeness.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SpanHasher

#: Minimum hashes of a signature, of which 16 bits each are kept.
HASHES = 64
BLOCK_PHRASES = 512
#: Bucket bounds that a row is compared with at once.
BLOCK_BOUNDS = 64
NO_ID = -(1 << 63)
_rng = np.random.default_rng(20240229)
_A = _rng.integers(0, 1 << 31, (HASHES, 1), np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 1 << 32, (HASHES, 1), np.uint32)


def parse(text: str, at: int, known: set[str]) -> tuple[list[int], list[str]]:
    """Ends of the new phrases of text[at:], and the phrases, which become known.

    A phrase is the longest known one and one character more; what is left at
    the end is a known phrase.
    """
    ends: list[int] = []
    new: list[str] = []
    phrase, i = "", at
    for c in text[at:] if at else text:
        i += 1
        phrase += c
        if phrase not in known:
            known.add(phrase)
            new.append(phrase)
            ends.append(i)
            phrase = ""
    return ends, new


def signature(text: str, at: int, ends: list[int], hasher: SpanHasher, into: np.ndarray | None = None) -> np.ndarray:
    """The least of each of HASHES hash functions over the phrases from ``at`` to each end; of none: all bits set."""
    best = np.full(HASHES, (1 << 32) - 1, np.uint32) if into is None else into.copy()
    if not ends:
        return best
    points = np.frombuffer(text[at : ends[-1]].encode("utf-32-le", "surrogatepass"), np.uint32)
    stops = np.array(ends, np.int64) - at
    h = (hasher.spans(hasher.prefix(points), np.concatenate(([0], stops[:-1])), stops) >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(h), BLOCK_PHRASES):
        np.minimum(best, (h[i : i + BLOCK_PHRASES] * _A + _B).min(axis=1), out=best)
    return best


def short(sig: np.ndarray) -> np.ndarray:
    return (sig >> np.uint32(16)).astype(">u2")


def fingerprint(text: str | None, hasher: SpanHasher | None = None) -> np.ndarray:
    text = text or ""
    return short(signature(text, 0, parse(text, 0, set())[0], hasher or SpanHasher()))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def both(text: str, cut: int, tail: str, hasher: SpanHasher | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of ``text`` and of text[:cut] + tail.

    Phrases that end before the cut are parsed once; those of the first tail
    are forgotten before the second one is parsed.
    """
    hasher, known = hasher or SpanHasher(), set()
    shared, _ = parse(text[:cut], 0, known)
    at = shared[-1] if shared else 0
    sig = signature(text, 0, shared, hasher)
    own, new = parse(text, at, known)
    known.difference_update(new)
    edited = text[:cut] + tail
    other, _ = parse(edited, at, known)
    return short(signature(text, at, own, hasher, sig)), short(signature(edited, at, other, hasher, sig))


def prints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars and fingerprint (hex) of every row; null counts as empty, equal texts have equal fingerprints."""

    def run(batches):
        import pyarrow as pa

        hasher = SpanHasher()
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array([fingerprint(t, hasher).tobytes().hex() for t in texts])], names=["id", "n_chars", "fingerprint"])

    return docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("t")).mapInArrow(run, "id long, n_chars long, fingerprint string").withColumnRenamed("id", doc_id)


def _bounds(docs: DataFrame, parts: int) -> list[tuple[int, int]]:
    """(key, h) at which buckets begin: quantiles of the keys; a key that is several quantiles is cut by its texts' hashes."""
    at = [i / parts for i in range(1, parts)] or [0.5]
    keys = Counter(b for b in docs.agg(F.percentile_approx("key", at, 10_000).alias("q")).first()["q"] or [] if b is not None)
    whole = 1 << 64
    return sorted((key, -(whole >> 1) + (whole * i // n if n > 1 else 0)) for key, n in keys.items() for i in range(n))


def _with_next(docs: DataFrame, parts: int) -> DataFrame:
    """bucket, ahead, id, key, h, t: rows in ascending order within buckets, each bucket followed by the next one's first row.

    Rows stand in order of key, then of the hash of their text.  Bucket bounds
    and each bucket's first place are a few numbers for each partition.  Texts
    move once; a bucket's first row moves twice.
    """
    bounds = _bounds(docs, parts)
    place = lambda k, h: F.struct(F.lit(k).cast("long").alias("key"), F.lit(h).cast("long").alias("h"))
    mine = F.struct("key", "h")
    before = lambda places: F.size(F.filter(F.array(*places), lambda b: b <= mine))
    bucket = F.lit(0)
    if bounds:  # the block of bounds first, then the place in it
        blocks = [bounds[i : i + BLOCK_BOUNDS] for i in range(0, len(bounds), BLOCK_BOUNDS)]
        block = before([place(*b[0]) for b in blocks])
        within = F.when(F.lit(False), 0)
        for i, own in enumerate(blocks, 1):
            within = within.when(F.col("block") == i, before([place(*x) for x in own]))
        docs = docs.withColumn("block", block)
        bucket = F.when(F.col("block") == 0, 0).otherwise((F.col("block") - 1) * BLOCK_BOUNDS + within)
    dealt = docs.withColumn("bucket", bucket.cast("int"))
    heads = {r["bucket"]: r["head"] for r in dealt.groupBy("bucket").agg(F.min(mine).alias("head")).collect()}
    order = sorted(heads)
    n = len(bounds) + 1
    # few rows: a head for each bucket, and the bucket before it
    rows = [(b, heads[b]["key"], heads[b]["h"], order[i - 1]) for i, b in enumerate(order)]
    first = docs.sparkSession.createDataFrame(rows, "b int, b_key long, b_h long, back int") if rows else None
    if first is None:
        return dealt.select("bucket", F.lit(False).alias("ahead"), "id", "key", "h", "t")
    known = dealt.join(F.broadcast(first), F.col("bucket") == F.col("b"))  # a row for each bucket
    is_head = (F.col("key") == F.col("b_key")) & (F.col("h") == F.col("b_h"))
    places = F.array(F.struct(F.col("bucket"), F.lit(False).alias("ahead")), F.when(is_head, F.struct(F.col("back").alias("bucket"), F.lit(True).alias("ahead"))))
    out = known.select(F.explode(F.filter(places, lambda p: p.isNotNull())).alias("place"), "id", "key", "h", "t").select("place.bucket", "place.ahead", "id", "key", "h", "t")
    return out.repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket", "ahead", "key", "h", "t")


def edit_likeness(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """Fingerprints of every row and of its edited text, and their likeness, also to the next row's.

    The edited text has its last quarter (rounded down) replaced by as many
    first characters of the next row, or all it has, in ascending order of id,
    after the last the first.  Ids are whole numbers.  Rows without id come
    first; rows that repeat an id stand in order of a hash of their text.  Null
    counts as empty; an empty table gives an empty one.  Other columns are
    ignored.
    """
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("h", F.xxhash64("t"))
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches):
        import pyarrow as pa

        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        hasher = SpanHasher()
        waiting = last = None  # the row that still needs its next one; the one before with its fingerprints
        out = []

        def close(row, tail_text):
            """The row's results but for near_next; its own fingerprint completes the row before."""
            i, t = row
            k = len(t) // 4
            tail = tail_text[:k]
            mine, edited = both(t, len(t) - k, tail, hasher)
            sha = hashlib.sha256((t[: len(t) - k] + tail).encode("utf-8", "surrogatepass")).hexdigest()
            return mine, [i, len(t), sha, mine.tobytes().hex(), edited.tobytes().hex(), likeness(mine, edited)]

        def follow(mine):
            nonlocal last
            if last is not None:
                out.append([*last[1], likeness(last[0], mine)])
                last = None

        for batch in batches:
            for ahead, i, t in zip(*(batch.column(c).to_pylist() for c in (1, 2, 5)), strict=True):
                if ahead and waiting is None:
                    continue  # further rows that repeat the next bucket's first place
                if waiting is not None:
                    done = close(waiting, t)
                    follow(done[0])
                    last, waiting = done, None
                if ahead:
                    follow(fingerprint(t, hasher))
                else:
                    waiting = (i, t)
                if len(out) >= 1000:
                    yield pa.record_batch([pa.array([r[c] for r in out], k) for c, k in enumerate(kinds)], names=names)
                    out.clear()
        yield pa.record_batch([pa.array([r[c] for r in out], k) for c, k in enumerate(kinds)], names=names)

    schema = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return _with_next(own, parts).mapInArrow(run, schema).withColumnRenamed("id", doc_id)
