"""Shared pieces of the corpus operators: staging tables, text columns, byte-level word hashing."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# --- staging ---------------------------------------------------------------


_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a temporary one only for unset local sessions."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if "dir" not in _local:
        _local["dir"] = "file://" + tempfile.mkdtemp(prefix="quantloom-stage-")
    return _local["dir"]


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def unstage(*frames: DataFrame) -> None:
    """Delete staged tables that nothing will read again."""
    for df in frames:
        if path := getattr(df, "_staged_path", None):
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


# --- memory inside tasks ------------------------------------------------------


def remembered(most: int):
    """A function that keeps its last results, so many at most.

    A plain closure: unlike ``lru_cache`` objects it travels by value, so that
    executors without the package can run it.
    """

    def wrap(fn):
        kept: dict = {}

        def call(*args):
            if args not in kept:
                if len(kept) >= most:
                    kept.pop(next(iter(kept)))
                kept[args] = fn(*args)
            return kept[args]

        call.__doc__ = fn.__doc__
        return call

    return wrap


# --- text columns (JVM side) ------------------------------------------------


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else.

    ``lower`` does that by itself for texts whose other characters have no
    lower-case form; the rest take the slower character map.
    """
    plain = (F.octet_length(text) == F.char_length(text)) | ~text.rlike(r"[\p{Lu}\p{Lt}\p{Nl}\p{So}&&[^A-Z]]")
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


# --- byte-level words (inside tasks) ----------------------------------------

SLICE_BYTES = 1 << 20
_P, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1
_P_INV = pow(_P, -1, 1 << 64)


def _table() -> tuple[np.ndarray, np.ndarray]:
    word = np.zeros(256, bool)
    word[48:58] = word[65:91] = word[97:123] = True
    word[128:] = True
    low = np.arange(256, dtype=np.uint8)
    low[65:91] += 32
    return word, low


IS_WORD, LOWERED = _table()


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.ones(max(n, 1), np.uint64)
    size = 1
    while size < n:
        step = min(size, n - size)
        out[size : size + step] = out[:step] * np.uint64(pow(base, size, 1 << 64))
        size += step
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that low bits of a hash depend on all of it."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class SpanHasher:
    """Hashes of many spans of one byte buffer, from one prefix sum of a polynomial modulo 2**64."""

    def __init__(self) -> None:
        self._pow, self._inv = powers(_P, 1 << 16), powers(_P_INV, 1 << 16)

    def prefix(self, buf: np.ndarray) -> np.ndarray:
        if len(buf) >= len(self._pow):
            n = 2 * len(buf) + 1
            self._pow, self._inv = powers(_P, n), powers(_P_INV, n)
        out = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * self._pow[: len(buf)], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((prefix[ends] - prefix[starts]) * self._inv[starts] + (ends - starts).astype(np.uint64))


def text_slices(column, limit: int = SLICE_BYTES):
    """Arrow strings as runs of whole texts: (first row, byte buffer, start of each text and the end).

    A run holds about ``limit`` bytes, or one longer text.  Null counts as empty.
    """
    import pyarrow as pa

    column = column.fill_null("") if column.null_count else column
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if not n:
        return
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
        yield row, raw[at[row] : at[stop]], at[row : stop + 1] - at[row]
        row = stop


def text_pieces(column, limit: int = SLICE_BYTES):
    """Like ``text_slices``, but a longer text comes in several runs of at most ``limit`` bytes, each with its row's number.

    Pieces are cut where a word starts, or anywhere in a word longer than a piece.
    """
    for row, raw, bounds in text_slices(column, limit):
        if len(raw) <= limit or len(bounds) > 2:
            yield row, raw, bounds
            continue
        at = 0
        while at < len(raw):
            stop = min(at + limit, len(raw))
            if stop < len(raw):
                inside = IS_WORD[raw[at : stop + 1]]
                starts = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
                stop = at + int(starts[-1]) if len(starts) else stop
            yield row, raw[at:stop], np.array([0, stop - at])
            at = stop


def word_spans(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words (letters, digits, anything beyond ASCII) and the text of each; none spans two texts."""
    inside = IS_WORD[buf]
    before = np.zeros(len(buf), bool)
    before[1:] = inside[:-1]
    after = np.zeros(len(buf), bool)
    after[:-1] = inside[1:]
    cut = bounds[(bounds > 0) & (bounds < len(buf))]
    before[cut] = False
    after[cut - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(bounds, starts, "right") - 1
