"""Token counts through a digest cache.

Counts are stored by the digest of a text's normalised content and the digest
of the tokenizer's version.  A run joins the corpus' digests to the stored
ones, encodes each distinct missing content once, appends the new counts to the
cache and joins every row to its count.  Text moves through a shuffle only if
its content is missing, and once from each task however often it occurs.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, stage, unstage

LIMIT = 2048
#: Missing digests (40 bytes each) that are broadcast; more take a shuffle join.
BROADCAST_MISSES = 200_000
#: Contents with more rows than this, and than one in so many of all rows, are joined by broadcast: HOT_SHARE contents at most.
HOT_ROWS, HOT_SHARE = 256, 100_000
#: Bytes of a text, and words that a task remembers, at once; a longer word is not remembered.
SLICE_BYTES, MEMO_WORDS, MEMO_BYTES = 1 << 20, 300_000, 64
_SPACE = re.compile(rb"[ \t\n\v\f\r]")


@dataclass(frozen=True)
class Vocabulary:
    """A tokenizer file: its content (sent to the tasks, some MB), its kind, and what its tokens do not depend on.

    ``spaces_drop``: white space only separates words, so runs of ASCII white
    space are one space and words can be counted apart.  ``case_drops``: ASCII
    texts without ``<|`` (special strings) count like their lower-case form.
    """

    content: bytes
    kind: str
    spaces_drop: bool = False
    case_drops: bool = False

    @classmethod
    def load(cls, path: str, *, spaces_drop: bool = False, case_drops: bool = False) -> Vocabulary:
        """``.json`` for the library tokenizers, ``.model`` for sentencepiece."""
        kind = os.path.splitext(path)[1][1:]
        if kind not in ("json", "model"):
            raise ValueError(f"no tokenizer library for {path}")
        with open(path, "rb") as f:
            return cls(f.read(), kind, spaces_drop, case_drops)

    @property
    def version(self) -> str:
        """The digest of the file, the library's version and how content is normalised."""
        library = __import__("tokenizers" if self.kind == "json" else "sentencepiece").__version__
        return hashlib.sha256(self.content + f"|{self.kind}|{library}|{self.spaces_drop:d}{self.case_drops:d}".encode()).hexdigest()


def normalised(text: Column, spaces_drop: bool, case_drops: bool) -> Column:
    """The content of a text as far as the tokenizer tells texts apart; null is empty."""
    t = F.coalesce(text, F.lit(""))
    if spaces_drop:
        t = F.trim(F.regexp_replace(t, r"[ \t\n\x0B\f\r]+", " "))
    if case_drops:
        t = F.when((F.octet_length(t) == F.char_length(t)) & ~F.contains(t, F.lit("<|")), F.lower(t)).otherwise(t)
    return t


def counter(content: bytes, kind: str, spaces_drop: bool, memo_words: int = MEMO_WORDS):
    """A function from a text to its number of tokens: no begin, end, truncation or padding; special strings as the library's default."""
    if kind == "model":
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_proto=content)
        return lambda text: len(own.encode(text, num_threads=1))
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    own = Tokenizer.from_buffer(content)
    own.no_truncation()
    own.no_padding()
    if not spaces_drop:
        return lambda text: len(own.encode_batch_fast([text], add_special_tokens=False)[0].ids)
    memo: dict[bytes, int] = {}

    def some(words: list[bytes]) -> int:
        missing = list(set(words).difference(memo))
        found = dict(zip(missing, (len(e.ids) for e in own.encode_batch_fast([w.decode() for w in missing], add_special_tokens=False)), strict=True)) if missing else {}
        if len(memo) < memo_words:
            memo.update(found if max(map(len, found), default=0) <= MEMO_BYTES else {w: n for w, n in found.items() if len(w) <= MEMO_BYTES})
        if not found:
            return sum(map(memo.__getitem__, words))
        return sum(found[w] if w in found else memo[w] for w in words)

    def count(text: str) -> int:
        raw, at, total = text.encode(), 0, 0
        while at < len(raw):
            stop = at + SLICE_BYTES
            if stop < len(raw):
                space = _SPACE.search(raw, stop)
                stop = space.start() if space else len(raw)
            total += some(raw[at:stop].split())  # by ASCII white space
            at = stop
        return total

    return count


# --- the cache ----------------------------------------------------------------


def cached(spark: SparkSession, path: str, version: str) -> DataFrame | None:
    """digest and n_tokens of the contents stored for a version, one row each; None if nothing is stored."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/tokenizer={version}")
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return None
    stored = spark.read.schema("digest binary, n_tokens long").parquet(f"{path}/tokenizer={version}")
    return stored.groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))  # two runs at a time may both have stored a content


def _once(batches):
    """Each digest's first row in the task."""
    import pyarrow as pa

    seen: set[bytes] = set()
    for batch in batches:
        rows = []
        for i, d in enumerate(batch.column(0).to_pylist()):
            if d not in seen:
                seen.add(d)
                rows.append(i)
        if rows:
            yield batch.take(pa.array(rows))


def _encode(sent):
    def run(batches):
        import pyarrow as pa

        count = counter(*sent.value)
        for batch in _once(batches):
            yield pa.record_batch([batch.column(0), pa.array([count(t) for t in batch.column(1).to_pylist()], pa.int64())], names=["digest", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, vocabulary: Vocabulary, cache: str, *, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT, broadcast_misses: int = BROADCAST_MISSES, hot_rows: int = HOT_ROWS) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row; new counts are appended to the table at ``cache``.

    Null texts count as empty: no bytes, no tokens.  Texts of any length are
    taken whole.  Repeated rows and copies are encoded once and come out
    repeatedly; ids may be null or equal.  An empty table gives an empty one
    and stores nothing.  Other columns are ignored.
    """
    spark = docs.sparkSession
    content = normalised(F.col(text), vocabulary.spaces_drop, vocabulary.case_drops)
    digest = F.unhex(F.sha2(content, 256)).alias("digest")
    keys = stage(docs.select(F.col(doc_id).alias("id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), digest), "token-keys")
    distinct = stage(keys.groupBy("digest").agg(F.count(F.lit(1)).alias("rows")), "token-digests")

    version = vocabulary.version
    known = cached(spark, cache, version)
    missing = distinct.select("digest")
    if known is not None:
        missing = stage(missing.join(known, "digest", "left_anti"), "token-misses")
    if misses := missing.count():
        texts = docs.select(digest, content.alias("content"))
        few = known is not None and misses <= broadcast_misses
        if few:
            texts = texts.join(F.broadcast(missing), "digest", "left_semi")  # a checked number of rows
        texts = texts.mapInArrow(_once, "digest binary, content string").repartition("digest")
        if known is not None and not few:
            texts = texts.join(missing.hint("shuffle_hash"), "digest", "left_semi")
        sent = spark.sparkContext.broadcast((vocabulary.content, vocabulary.kind, vocabulary.spaces_drop))
        found = texts.mapInArrow(_encode(sent), "digest binary, n_tokens long")
        found.write.mode("append").parquet(f"{cache}/tokenizer={version}")
        known = cached(spark, cache, version)
    if known is None:
        known = spark.createDataFrame([], "digest binary, n_tokens long")

    counts = stage(distinct.join(known, "digest").select(F.col("digest").alias("d"), "rows", "n_tokens"), "token-counts")
    total = counts.agg(F.sum("rows")).first()[0] or 0
    bar = max(hot_rows, total // HOT_SHARE)
    hot = F.broadcast(counts.where(F.col("rows") > bar).select("d", "n_tokens"))  # fewer than HOT_SHARE rows
    cool = counts.where(F.col("rows") <= bar).select("d", "n_tokens")
    own = keys.join(hot, F.col("digest") == F.col("d"), "left")
    frequent = own.where("d is not null").select("id", "n_bytes", "n_tokens")
    rest = own.where("d is null").select("id", "n_bytes", "digest").join(cool, F.col("digest") == F.col("d")).select("id", "n_bytes", "n_tokens")
    unstage(distinct, missing)
    return frequent.unionByName(rest).select(F.col("id").alias(doc_id), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def new_cache(spark: SparkSession) -> str:
    """A path in the shared folder for a cache that starts empty."""
    return f"{shared_dir(spark)}/token-cache-{uuid.uuid4().hex}"
