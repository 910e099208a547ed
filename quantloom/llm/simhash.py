"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within 4 bits of each other have a common variant within 2
bits of each.  Every distinct fingerprint emits its variants; fingerprints
that meet on a variant are within the radius.  The variants shuffle by their
leading bits: a fingerprint is sent once to each leading value that any of its
variants has, and the receiving task writes out the variants below that value.
That moves 137 short rows a fingerprint instead of 2,081.  A leading value
with too many fingerprints is dealt anew by more leading bits; at 64 bits at
most 2,081 fingerprints can meet.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remembered, stage, unstage
from .components import components, local_roots

RADIUS, SHINGLE, SEED = 4, 4, 42
#: Leading bits that the variants shuffle by, at first and for values with more than BLOCK_ROWS fingerprints.
LEADING, BLOCK_ROWS = (16, 32, 64), 100_000
#: Variants that a task holds at once.
BLOCK_VARIANTS = 2_000_000
#: Shingles that are counted at once.
BLOCK_SHINGLES = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64 bits, each set if it is set in over half of the shingles' XXH64; no words: 0."""
    words = (text or "").encode().lower().split()  # bytes: ASCII letters and ASCII white space only
    n = max(len(words) - shingle + 1, 1 if words else 0)
    if not n:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[:n].tolist()
    stops = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, BLOCK_SHINGLES):
        h = np.array([digest(joined[a:b], seed) for a, b in zip(starts[at : at + BLOCK_SHINGLES], stops[at : at + BLOCK_SHINGLES], strict=False)], ">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """id, fp (the 64 bits as a signed long) and h (the text's hash) of every row; null or empty text has fp 0."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            fps = np.array([fingerprint(t, shingle, seed) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.record_batch([batch.column(0), pa.array(fps.view(np.int64)), batch.column(2)], names=["id", "fp", "h"])

    return docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("t"), F.xxhash64(text).alias("h")).mapInArrow(run, "id long, fp long, h long")


@remembered(64)
def masks(bits: int, weight: int) -> np.ndarray:
    """All values of so many bits with at most so many of them set, by weight."""
    return np.array([sum(1 << i for i in c) for w in range(weight + 1) for c in combinations(range(bits), w)], np.uint64)


def _meet(keys: np.ndarray, fps: np.ndarray, lead: int, half: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (larger, root) of a spanning forest over the fingerprints that meet on a variant below one of the keys."""
    low = 64 - lead
    own = fps if lead == 64 else fps >> np.uint64(low) << np.uint64(low)
    top = keys if lead == 64 else keys << np.uint64(low)
    left = half - np.bitwise_count(own ^ top).astype(np.int64)
    found, at = [], []
    for r in range(half + 1):
        rows = np.flatnonzero(left == r)
        if len(rows):
            m = masks(low, r)
            tail = fps[rows] ^ own[rows]
            found.append(((tail[:, None] ^ m[None, :]) | top[rows][:, None]).ravel())
            at.append(np.repeat(rows, len(m)))
    variants, at = np.concatenate(found), np.concatenate(at)
    order = np.argsort(variants, kind="stable")
    variants, at = variants[order], at[order]
    first = np.concatenate(([True], variants[1:] != variants[:-1]))
    head = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
    a, b = fps[at], fps[at[head]]
    met = a != b
    a, b = a[met], b[met]
    near = np.bitwise_count(a ^ b) <= 2 * half  # holds by the triangle inequality; verified all the same
    return local_roots(a[near], b[near])


def _variants(keys: np.ndarray, fps: np.ndarray, lead: int, half: int) -> int:
    """How many variants the rows have below their keys."""
    left = half - np.bitwise_count(fps >> np.uint64(64 - lead) ^ keys).astype(np.int64)
    size = np.array([len(masks(64 - lead, r)) for r in range(half + 1)])
    return int(size[left[left >= 0]].sum())


def _meet_in_passes(keys: np.ndarray, fps: np.ndarray, lead: int, half: int, most: int):
    """``_meet`` with at most so many variants at once: more are taken in passes over the next four bits of the variants."""
    if not len(keys):
        return
    if lead == 64 or _variants(keys, fps, lead, half) <= most:
        yield _meet(keys, fps, lead, half)
        return
    after = lead + 4
    top = fps >> np.uint64(64 - after)
    for low in range(16):
        own = keys << np.uint64(4) | np.uint64(low)
        reached = np.bitwise_count(top ^ own) <= half
        yield from _meet_in_passes(own[reached], fps[reached], after, half, most)


def _meet_all(lead: int, half: int, most: int = BLOCK_VARIANTS):
    """Reads rows sorted by (key, fp), in blocks of whole keys; ``most`` bounds the variants that a task holds."""

    def run(batches):
        import pyarrow as pa

        def out(keys, fps):
            for a, b in _meet_in_passes(keys, fps, lead, half, most):
                yield pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        rows = max(1, most // len(masks(64 - lead, half)) * 8)  # most rows are a bit or two away and have few variants
        keys, fps = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        for batch in batches:
            keys = np.concatenate((keys, batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)))
            fps = np.concatenate((fps, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)))
            while len(keys) > rows:
                cut = int(np.searchsorted(keys.view(np.int64), keys.view(np.int64)[rows], "left")) or int(np.searchsorted(keys.view(np.int64), keys.view(np.int64)[0], "right"))
                if cut == len(keys):
                    break
                yield from out(keys[:cut], fps[:cut])
                keys, fps = keys[cut:], fps[cut:]
        yield from out(keys, fps)

    return run


def _dealt(fps: DataFrame, lead: int, half: int) -> DataFrame:
    """(key, fp): a row for each leading value that variants of fp have."""
    shift = 64 - lead
    flips = masks(lead, half).view(np.int64).tolist()
    top = F.shiftrightunsigned("fp", shift) if shift else F.col("fp")
    return fps.select(top.alias("top"), "fp").select(F.explode(F.array(*[F.lit(x).cast("long") for x in flips])).alias("flip"), "top", "fp").select(F.col("top").bitwiseXOR(F.col("flip")).alias("key"), "fp")


def links(fps: DataFrame, radius: int = RADIUS, leading: tuple[int, ...] = LEADING, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Links (a, b) that connect the same distinct fingerprints as all pairs within the radius do.

    Each task's links are a spanning forest of what met there, so a dense group
    of near copies gives a link or so for each member and task, not all pairs.
    """
    half, rest, found = radius // 2, fps, []
    for i, lead in enumerate(leading):
        dealt = _dealt(rest, lead, half)
        if i:
            dealt = dealt.join(hot.withColumnRenamed("key", "hot"), F.shiftrightunsigned(dealt["key"], lead - leading[i - 1]) == F.col("hot"), "left_semi")
        hot = None
        if lead < 64:
            crowded = stage(dealt.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block_rows).select("key"), "crowded")
            if crowded.limit(1).count():
                hot = crowded
        cool = dealt.join(hot, "key", "left_anti") if hot is not None else dealt
        found.append(cool.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_meet_all(lead, half), "a long, b long"))
        if hot is None:
            break
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out.distinct()


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable) and text_hash of every row.

    Ids are whole numbers.  Null and empty texts have the fingerprint zero,
    linked like any other.  Equal rows give equal rows; an empty table gives an
    empty one.  A null id takes no part in the smallest id; it
    is null only in a component without any id.  Other columns are ignored.
    """
    own = stage(fingerprints(docs, doc_id=doc_id, text=text, shingle=shingle), "fingerprints")
    fps = stage(own.groupBy("fp").agg(F.min("id").alias("first")), "distinct-fingerprints")
    linked = stage(links(fps.select("fp"), radius), "links")
    roots = components(linked)
    root = F.coalesce("root", "fp")
    grouped = stage(fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", root.alias("root")), "grouped")
    least = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = stage(grouped.join(least, "root").select(F.col("fp").alias("c_fp"), "component_id"), "classes")
    unstage(fps, linked, roots, grouped)
    return own.join(classes, own["fp"] == F.col("c_fp")).select(F.col("id").alias(doc_id), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", F.col("h").alias("text_hash"))
