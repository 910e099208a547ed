"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades are ordered (toxic < poor < good).  One weight vector over hashed text
features is shared by all thresholds: P(grade <= k) = sigmoid(t_k - w.x) with
t_0 < t_1 < ...  The sum over thresholds gives the expected grade, the last
one the tail probability P(good), by which documents are selected.

Features are the distinct words of the whole text, their first 4 and 5 bytes,
and the characters between words, hashed to 2**20 places.  The model is fitted
on at most TRAIN_ROWS labelled documents with at most TRAIN_PLACES feature
places in all, chosen by a hash of their id; it is a fixed number of floats,
whatever the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructType

from .common import LOWERED, SpanHasher, stage, text_pieces, unstage, word_spans

#: The documented bounds on labelled rows that the fit reads, and on their feature places (4 bytes each).
TRAIN_ROWS, TRAIN_PLACES = 12_000, 24_000_000
BITS, GRADES, EPOCHS, BATCH, RATE, L1, LEAST_DOCS = 20, 3, 10, 64, 0.3, 1.5e-3, 3
#: Small sets are passed over until the fit has seen so many rows.
LEAST_SEEN = 100_000
#: Documents stay if P(good) reaches this.
MIN_GOOD = 0.5
PREFIXES = (4, 5)


def features(column, bits: int = BITS):
    """Arrow strings to (places, bounds): the distinct feature places of each text, one text after the other."""
    hasher, mask = SpanHasher(), np.uint64((1 << bits) - 1)
    places, counts, last = [], [], -1
    for row, raw, bounds in text_pieces(column):
        buf = LOWERED[raw]
        starts, ends, of = word_spans(raw, bounds)
        prefix = hasher.prefix(buf)
        hashed, owner = [hasher.spans(prefix, starts, ends)], [of]
        for k in PREFIXES:
            long = ends - starts >= k
            s = starts[long]
            hashed.append(hasher.spans(prefix, s, s + k) ^ np.uint64(k << 40 | 1 << 19))
            owner.append(of[long])
        # between words, and before the first and after the last one of each text
        gap_from = np.concatenate((bounds[:-1], ends))
        gap_of = np.concatenate((np.arange(len(bounds) - 1), of))
        order = np.argsort(gap_from * 2 + (np.arange(len(gap_from)) >= len(bounds) - 1), kind="stable")
        gap_from, gap_of = gap_from[order], gap_of[order]
        next_start = np.append(starts, len(buf))[np.searchsorted(starts, gap_from, "left")]
        gap_to = np.minimum(next_start, bounds[gap_of + 1])
        some = gap_to > gap_from
        hashed.append(hasher.spans(prefix, gap_from[some], gap_to[some]) ^ np.uint64(1 << 18))
        owner.append(gap_of[some])
        h = np.concatenate(hashed) & mask
        pairs = np.unique((np.concatenate(owner).astype(np.uint64) << np.uint64(bits)) | h)
        own = (pairs & mask).astype(np.int32)
        if row == last:  # a further piece of a long text
            places[-1] = np.union1d(places[-1], own)
            counts[-1] = np.array([len(places[-1])])
        else:
            places.append(own)
            counts.append(np.bincount((pairs >> np.uint64(bits)).astype(np.int64), minlength=len(bounds) - 1))
        last = row
    if not places:
        return np.zeros(0, np.int32), np.zeros(1, np.int64)
    return np.concatenate(places), np.concatenate(([0], np.cumsum(np.concatenate(counts))))


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


@dataclass(frozen=True)
class Ordinal:
    """Fitted weights (float32, 2**bits) and ascending thresholds."""

    weights: np.ndarray
    thresholds: np.ndarray
    bits: int = BITS

    def score(self, places: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0.0], np.cumsum(self.weights[places], dtype=np.float64)))
        return total[bounds[1:]] - total[bounds[:-1]]

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for each text and threshold k."""
        return 1.0 - _sigmoid(self.thresholds[None, :] - scores[:, None])


def fit(rows: list[tuple[int, np.ndarray]], bits: int = BITS, grades: int = GRADES, epochs: int = EPOCHS, rate: float = RATE, l1: float = L1, least: int = LEAST_DOCS, seed: int = 5) -> Ordinal | None:
    """AdaGrad with soft thresholding over (grade, places); None without rows."""
    if not rows:
        return None
    common = np.bincount(np.concatenate([x for _, x in rows]), minlength=1 << bits) >= least
    rows = [(y, x[common[x]]) for y, x in rows]
    rng = np.random.default_rng(seed)
    w, g2 = np.zeros(1 << bits), np.full(1 << bits, 1e-3)
    first, gaps, t2 = -2.0, np.full(grades - 2, 0.5), np.full(grades - 1, 1e-3)
    y_all = np.array([y for y, _ in rows])
    for _ in range(max(epochs, LEAST_SEEN // len(rows))):
        order = rng.permutation(len(rows))
        for b in range(0, len(rows), BATCH):
            own = order[b : b + BATCH]
            idx = [rows[i][1] for i in own]
            lens = np.array([len(x) for x in idx])
            flat, doc, y = np.concatenate(idx), np.repeat(np.arange(len(own)), lens), y_all[own]
            s = np.bincount(doc, w[flat], len(own))
            cuts = np.concatenate(([-np.inf], first + np.concatenate(([0.0], np.cumsum(np.exp(gaps)))), [np.inf]))
            hi, lo = _sigmoid(cuts[y + 1] - s), _sigmoid(cuts[y] - s)
            p = np.maximum(hi - lo, 1e-9)
            ds = (1.0 - hi - lo) / len(own)
            up, down = -hi * (1 - hi) / p / len(own), lo * (1 - lo) / p / len(own)
            dt = np.array([up[y == k].sum() + down[y == k + 1].sum() for k in range(grades - 1)])
            at, back = np.unique(flat, return_inverse=True)
            g = np.bincount(back, ds[doc], len(at))
            g2[at] += g * g
            pace = rate / np.sqrt(g2[at])
            moved = w[at] - pace * g
            w[at] = np.sign(moved) * np.maximum(np.abs(moved) - pace * l1, 0.0)
            # the first threshold moves all; each gap is positive by its logarithm
            dp = np.concatenate(([dt.sum()], [dt[k:].sum() * np.exp(gaps[k - 1]) for k in range(1, grades - 1)]))
            t2 += dp * dp
            step = 0.1 * dp / np.sqrt(t2)
            first, gaps = first - step[0], gaps - step[1:]
    return Ordinal(w.astype(np.float32), first + np.concatenate(([0.0], np.cumsum(np.exp(gaps)))), bits)


def grade_of(quality: str = "quality", toxic: str = "toxic"):
    """0 toxic, 1 poor, 2 good; null if a rating is missing."""
    return F.when(F.col(toxic) > 0, 0).when(F.col(toxic).isNotNull() & F.col(quality).isNotNull(), F.when(F.col(quality) > 0, 2).otherwise(1)).cast("int")


def train(
    docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", quality: str = "quality", toxic: str = "toxic",
    rows: int = TRAIN_ROWS, places: int = TRAIN_PLACES,
) -> Ordinal | None:
    """A model from at most ``rows`` graded documents with at most ``places`` feature places; None if there is none.

    Documents are taken in order of a hash of their id while both bounds hold.
    One with several grades counts with the lowest; of several texts with one
    id, that with the smallest hash counts.
    """
    graded = labels.select(F.col(doc_id).alias("id"), grade_of(quality, toxic).alias("grade")).where("id is not null and grade is not null")
    chosen = graded.groupBy("id").agg(F.min("grade").alias("grade")).orderBy(F.xxhash64("id"), "id").limit(rows)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found, bounds = features(batch.column(1))
            own = [found[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(own, pa.binary()), batch.column(3)], names=["id", "grade", "places", "h"])

    own = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t"))
    kind = docs.schema[doc_id].dataType.simpleString()
    found = own.join(F.broadcast(chosen), "id")  # the broadcast has at most `rows` rows
    seen = found.select("id", "t", "grade", F.xxhash64("t").alias("h")).mapInArrow(run, f"id {kind}, grade int, places binary, h long")
    one = seen.groupBy("id").agg(F.min(F.struct("h", "grade", "places")).alias("r")).select("id", "r.grade", "r.places")
    kept = stage(one, "graded-places")
    before = F.sum(F.octet_length("places")).over(Window.orderBy(F.xxhash64("id"), "id"))  # at most `rows` rows
    within = kept.select("id", before.alias("n")).where(F.col("n") <= 4 * places).select("id")
    got = sorted(((r.id, r.grade, bytes(r.places)) for r in kept.join(within, "id").collect()), key=lambda r: r[0])
    unstage(kept)
    return fit([(g, np.frombuffer(p, np.int32)) for _, g, p in got if p])


def _graded(docs: DataFrame, model: Ordinal | None, text: str, min_good: float) -> DataFrame:
    """``docs`` with __expected, __good and __keep."""
    if model is None:
        none = F.lit(None).cast("double")
        return docs.select("*", none.alias("__expected"), none.alias("__good"), F.lit(True).alias("__keep"))
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds, model.bits))  # 2**bits floats
    at = docs.columns.index(text)

    def run(batches):
        import pyarrow as pa

        own = Ordinal(*sent.value)
        for batch in batches:
            tails = own.tails(own.score(*features(batch.column(at), own.bits)))
            more = [pa.array(tails.sum(axis=1)), pa.array(tails[:, -1]), pa.array(tails[:, -1] >= min_good)]
            yield pa.record_batch([*batch.columns, *more], names=[*batch.schema.names, "__expected", "__good", "__keep"])

    schema = StructType([*docs.schema.fields]).add("__expected", DoubleType()).add("__good", DoubleType()).add("__keep", BooleanType())
    return docs.mapInArrow(run, schema)


def grade(docs: DataFrame, model: Ordinal | None, *, doc_id: str = "doc_id", text: str = "text", min_good: float = MIN_GOOD) -> DataFrame:
    """doc_id, expected_grade, p_good and keep of every row.

    Null and empty texts are scored by the thresholds alone; a tie with
    ``min_good`` is kept.  Without a model (no labels) the scores are null and
    every row is kept.  Rows are judged one by one, so repeated rows repeat
    their result; an empty table gives an empty one.  Other columns are ignored.
    """
    own = _graded(docs.select(doc_id, text), model, text, min_good)
    return own.select(doc_id, F.col("__expected").alias("expected_grade"), F.col("__good").alias("p_good"), F.col("__keep").alias("keep"))


def select_good(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_good: float = MIN_GOOD) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps; all columns as given, whatever their names.

    Rows are judged one by one: repeated rows stay or go together, null and
    empty texts by the thresholds alone.  Without graded documents every row
    stays; an empty table gives an empty one.
    """
    model = train(docs, labels, doc_id=doc_id, text=text)
    return _graded(docs, model, text, min_good).where("__keep").select(*docs.columns)
