"""Line dedup with two Bloom filters, once seen and twice seen.

Pass 1 hashes every line's key.  Each task notes which filter bits it saw once
and which more often, as sorted bit numbers cut into shards; each shard's
notes meet in one task, which sets a bit of the twice-seen filter if two notes
(or one note twice) have it.  The filter has a fixed number of bits, so its
broadcast is bounded; more lines than bits only make more lines suspected.
Pass 2 sends the digests of suspected lines alone through a shuffle, which
confirms the repeats exactly and chooses the document that keeps them.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, unstage

MIN_CHARS, MIN_DOCS = 40, 5
#: Bits of each Bloom filter (32 MB) and the shards that it is built in.
FILTER_BITS, SHARDS = 1 << 28, 64
#: Repeated lines whose digests and keepers (24 bytes each) are broadcast; more take a shuffle join.
BROADCAST_LINES = 500_000
SPACE = " \t\n\v\f\r"
NO_ID = -(1 << 63)


def line_key(line: str) -> bytes:
    """The line without ASCII white space at both ends, A-Z lower-cased."""
    return line.strip(SPACE).encode().lower()


def _keys(text: str | None, min_chars: int) -> set[bytes]:
    """Distinct keys of at least so many code points."""
    found = set()
    for line in (text or "").split("\n"):
        if len(line) >= min_chars and len(key := line.strip(SPACE)) >= min_chars:
            found.add(key.encode().lower())
    return found


def _bit(key: bytes, bits: int) -> int:
    return xxhash.xxh3_64_intdigest(key) & (bits - 1)


def digest(key: bytes) -> bytes:
    return hashlib.sha256(key).digest()[:16]


def _note(bit_numbers: np.ndarray) -> bytes:
    return zlib.compress(np.diff(bit_numbers, prepend=np.uint32(0)).astype(np.uint32).tobytes(), 1)


def _read(note: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(note), np.uint32), dtype=np.uint32)


def _seen(docs: DataFrame, min_chars: int, bits: int, shards: int) -> DataFrame:
    """(shard, once, twice): what each task saw, as packed bit numbers within the shard."""
    per_shard = bits // shards

    def run(batches):
        import pyarrow as pa

        def notes(chunks):
            at, n = np.unique(np.concatenate(chunks), return_counts=True)
            cuts = np.searchsorted(at, np.arange(shards + 1, dtype=np.uint64) * np.uint64(per_shard))
            rows = []
            for s, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                if i < j:
                    own = (at[i:j] - np.uint64(s * per_shard)).astype(np.uint32)
                    rows.append((s, _note(own), _note(own[n[i:j] > 1])))
            return pa.RecordBatch.from_pylist([dict(zip(("shard", "once", "twice"), r, strict=True)) for r in rows], schema=schema)

        schema = pa.schema([("shard", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])
        chunks, held = [], 0
        for batch in batches:
            own = [_bit(k, bits) for t in batch.column(0).to_pylist() for k in _keys(t, min_chars)]
            chunks.append(np.array(own, np.uint64))
            held += len(own)
            if held > 4_000_000:
                yield notes(chunks)
                chunks, held = [], 0
        if held:
            yield notes(chunks)

    return docs.select("t").mapInArrow(run, "shard int, once binary, twice binary")


def twice_seen(docs: DataFrame, min_chars: int, bits: int = FILTER_BITS, shards: int = SHARDS) -> DataFrame:
    """(shard, twice): the twice-seen filter's bits, packed and compressed; a bit of the filter is at most a bit here."""
    per_shard = bits // shards

    def run(batches):
        import pyarrow as pa

        once, twice = {}, {}
        for batch in batches:
            for s, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if s not in once:
                    once[s], twice[s] = np.zeros(per_shard, bool), np.zeros(per_shard, bool)
                a, b = _read(a), _read(b)
                twice[s][a[once[s][a]]] = True
                twice[s][b] = True
                once[s][a] = True
        rows = [(s, zlib.compress(np.packbits(x).tobytes(), 1)) for s, x in twice.items()]
        yield pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["shard", "twice"])

    return _seen(docs, min_chars, bits, shards).repartition(shards, "shard").mapInArrow(run, "shard int, twice binary")


def _suspects(docs: DataFrame, twice: list[tuple[int, bytes]], min_chars: int, bits: int, shards: int) -> DataFrame:
    """(key, id): digests of lines that the filter suspects, once a row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(twice)
    per_shard = bits // shards

    def run(batches):
        import pyarrow as pa

        suspected = np.zeros((shards, -(-per_shard // 8)), np.uint8)
        for s, packed in sent.value:
            suspected[s] = np.frombuffer(zlib.decompress(packed), np.uint8)
        for batch in batches:
            keys, ids = [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = list(_keys(t, min_chars))
                if own:
                    at = np.array([_bit(k, bits) for k in own], np.int64)
                    place = at % per_shard
                    hit = np.flatnonzero(suspected[at // per_shard, place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1)
                    keys += [digest(own[j]) for j in hit]
                    ids += [i] * len(hit)
            yield pa.record_batch([pa.array(keys, pa.binary()), pa.array(ids, pa.int64())], names=["key", "id"])

    return docs.mapInArrow(run, "key binary, id long")


def repeated_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, bits: int = FILTER_BITS, shards: int = SHARDS) -> tuple[DataFrame, DataFrame]:
    """(key, keeper) of every line to drop, and (key, id) of all suspected lines, both staged."""
    own = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text).alias("t"))
    twice = [(r.shard, bytes(r.twice)) for r in twice_seen(own, min_chars, bits, shards).collect()]  # at most `bits` bits
    suspects = stage(_suspects(own, twice, min_chars, bits, shards).distinct(), "suspected-lines")
    counted = suspects.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keeper"))
    return stage(counted.where(F.col("n") >= min_docs).select("key", "keeper"), "repeated-lines"), suspects


def _split(i: int, text: str | None, lost: dict[bytes, int], min_chars: int) -> tuple[int, str]:
    """Number of lines, and the text without the lines that i loses."""
    lines = (text or "").split("\n")
    kept = []
    for line in lines:
        if len(line) >= min_chars and len(key := line.strip(SPACE)) >= min_chars and lost.get(digest(key.encode().lower()), i) != i:
            continue
        kept.append(line)
    return len(lines), len(lines) - len(kept), "\n".join(kept)


def dedup_lines(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
    bits: int = FILTER_BITS, shards: int = SHARDS, broadcast_lines: int = BROADCAST_LINES,
) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_text of every row.

    Keys of at least min_chars code points in at least min_docs documents lose
    their lines except in the largest doc_id that holds them; there all stay.
    Rows that repeat an id are one document when documents are counted; all
    rows without id are one document, which sorts first.  Null and empty texts
    have one empty line, never dropped.  Ids are whole numbers; others fail as
    the cast to long does.  An empty table gives an empty one.  Other columns
    are ignored.
    """
    repeated, suspects = repeated_lines(docs, doc_id=doc_id, text=text, min_chars=min_chars, min_docs=min_docs, bits=bits, shards=shards)
    own = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text).alias("t"), F.col(doc_id).isNotNull().alias("has_id"))
    schema = "id long, n_lines long, n_dropped long, kept_text string, has_id boolean"

    def rows(batch, lost_of):
        import pyarrow as pa

        ids = batch.column(0).to_pylist()
        out = [_split(i, t, lost_of(i, k), min_chars) for k, (i, t) in enumerate(zip(ids, batch.column(1).to_pylist(), strict=True))]
        return pa.record_batch([batch.column(0), *(pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.string()))), batch.column(2)], names=["id", "n_lines", "n_dropped", "kept_text", "has_id"])

    if repeated.count() <= broadcast_lines:
        sent = docs.sparkSession.sparkContext.broadcast([(bytes(r.key), r.keeper) for r in repeated.collect()])

        def run(batches):
            lost = dict(sent.value)
            for batch in batches:
                yield rows(batch, lambda i, k: lost)

        out = own.mapInArrow(run, schema)
    else:
        # each document with the lines that it loses: as many at most as it has
        losses = suspects.join(repeated, "key").where("id <> keeper").groupBy("id").agg(F.collect_list("key").alias("lost"))

        def run(batches):
            for batch in batches:
                lost = batch.column(3).to_pylist()
                yield rows(batch, lambda i, k: dict.fromkeys(lost[k] or (), None))

        out = own.join(losses, "id", "left").select("id", "t", "has_id", "lost").mapInArrow(run, schema)
    return out.select(F.when(F.col("has_id"), F.col("id")).alias(doc_id), "n_lines", "n_dropped", "kept_text")


def without_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", n_chars: str = "n_chars", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """``docs`` with the kept text and its length; columns and rows as given, a null text stays null.

    Lines go as in ``dedup_lines``: ids are whole numbers, rows without one are
    one document, rows that repeat an id are one too.  An empty table gives an
    empty one.
    """
    repeated, suspects = repeated_lines(docs, doc_id=doc_id, text=text, min_chars=min_chars, min_docs=min_docs)
    key = F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID))
    few = repeated.count() <= broadcast_lines
    if few:
        sent = docs.sparkSession.sparkContext.broadcast([(bytes(r.key), r.keeper) for r in repeated.collect()])
        given = docs.withColumn("__k", key).withColumn("__lost", F.lit(None).cast("array<binary>"))
    else:
        losses = suspects.join(repeated, "key").where("id <> keeper").groupBy("id").agg(F.collect_list("key").alias("__lost")).withColumnRenamed("id", "__k")
        given = docs.withColumn("__k", key).join(losses, "__k", "left").select(*docs.columns, "__k", "__lost")
    at = docs.columns.index(text)

    def run(batches):
        import pyarrow as pa

        lost = dict(sent.value) if few else {}
        for batch in batches:
            ids, texts, own = (batch.column(c).to_pylist() for c in (len(batch.columns) - 2, at, len(batch.columns) - 1))
            kept = [None if t is None else _split(i, t, lost if few else dict.fromkeys(o or (), None), min_chars)[2] for i, t, o in zip(ids, texts, own, strict=True)]
            cols = batch.columns[:-2]
            cols[at] = pa.array(kept, pa.string())
            yield pa.record_batch(cols, names=batch.schema.names[:-2])

    out = given.mapInArrow(run, docs.schema)
    return out.withColumn(n_chars, F.char_length(text).cast(docs.schema[n_chars].dataType)) if n_chars in docs.columns else out
