"""Embedding whitening by matrix-free block subspace iteration.

The covariance is never formed from the rows at large.  Each Spark pass
multiplies it with a block Q: tasks compute X'(XQ) on their centred rows, the
sums meet by matrix row, and the driver takes the QR and Rayleigh-Ritz steps on
matrices of dimension x block.  Passes go on until the residuals of all wanted
components certify them; a block that converges too slowly is widened, in the
end to the whole space, where one pass is exact.  Two further passes measure
the whitened rows' covariance and write the rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPONENTS, SCALE, SHIFT = 32, 64, 1_000_000
#: A component is certified if |V w - e w| is at most this share of the largest eigenvalue.
TOLERANCE = 1e-12
#: Passes that a block may still need by its rate before it is widened, and those after which it is the whole space.
MORE_PASSES, MAX_PASSES = 8, 30
#: Components with a smaller share of the largest eigenvalue have no variance to speak of.
NO_VARIANCE = 1e-12
#: Vectors that are written out at once.
OUT_ROWS = 4_096
#: Entries times scale must be below this in size to have a long.
LARGEST = float(1 << 62)


def longs(column, size: int, scale: int = SCALE, shift: int = SHIFT) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the rows of an Arrow list column that are whole vectors of that size, and their entries as longs."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    right = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), size), False).to_numpy(zero_copy_only=False))
    flat = column.take(pa.array(right)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, size)
    scaled = np.asarray(flat, np.float64) * float(scale)  # null entries came as NaN
    whole = (np.abs(scaled) < LARGEST).all(axis=1)
    return right[whole], np.floor(scaled[whole]).astype(np.int64) + shift


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n*x - S, exact: longs, or Python's integers where longs would not do."""
    if len(x) and n * max(abs(int(x.min())), abs(int(x.max()))) + max(map(abs, sums), default=0) >= 1 << 62:
        x = x.astype(object)
        return n * x - np.array(sums, object)[None, :]
    return n * x - np.array(sums, np.int64)[None, :]


def squares(d: np.ndarray) -> list[int | None]:
    """Exact sums of squares by row; None beyond a long."""
    if not len(d):
        return []
    if d.dtype != object and int(np.abs(d).max()) ** 2 * d.shape[1] < 1 << 63:
        return (d * d).sum(axis=1).tolist()
    found = [sum(int(v) ** 2 for v in row) for row in d]
    return [v if v < 1 << 63 else None for v in found]


def _centred(d: np.ndarray, n: int) -> np.ndarray:
    return (d / n).astype(np.float64)


# --- passes -------------------------------------------------------------------


def _gathered(vectors: DataFrame, work, rows: int, width: int) -> np.ndarray:
    """The sum over all tasks of the (rows x width) matrix that ``work`` makes of a task's batches.

    Each task sends its matrix by rows; the rows of one number meet in one
    task, which adds them one by one, in the order of the tasks.  The driver
    gets the sum alone.
    """

    def part(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        number, total = TaskContext.get().partitionId(), work(batches)
        if total is not None:
            values = pa.array([r.tobytes() for r in total], pa.binary())
            yield pa.record_batch([pa.array(np.arange(rows)), pa.array(np.full(rows, number)), values], names=["i", "part", "v"])

    def add(batches):
        import pyarrow as pa

        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                own = np.frombuffer(v)
                total[i] = total[i] + own if i in total else own
        if total:
            yield pa.record_batch([pa.array(list(total), pa.int64()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["i", "v"])

    parts = vectors.mapInArrow(part, "i long, part long, v binary")
    added = parts.repartition("i").sortWithinPartitions("i", "part").mapInArrow(add, "i long, v binary")
    out = np.zeros((rows, width))
    for r in added.collect():  # rows x width numbers, whatever the table
        out[r.i] += np.frombuffer(r.v)
    return out


def _totals(vectors: DataFrame, size: int, scale: int, shift: int) -> tuple[int, list[int]]:
    """How many vectors there are, and the exact sum of each dimension."""

    def run(batches):
        import pyarrow as pa

        n, high, low = 0, np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            _, x = longs(batch.column(0), size, scale, shift)
            n, high, low = n + len(x), high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)
        if n:
            yield pa.record_batch([pa.array(np.arange(size)), pa.array(np.full(size, n)), pa.array(high), pa.array(low)], names=["i", "n", "high", "low"])

    wide = [F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("n", "high", "low")]
    got = vectors.mapInArrow(run, "i long, n long, high long, low long").groupBy("i").agg(*wide).orderBy("i").collect()  # a row for each dimension
    return int(got[0].n) if got else 0, [(int(r.high) << 32) + int(r.low) for r in got]


def _size(vectors: DataFrame, scale: int) -> int:
    """The commonest length of the whole vectors; of equally common ones the largest."""
    fit = F.forall("v", lambda e: F.coalesce(F.abs(e.cast("double")) * scale < LARGEST, F.lit(False)))
    got = vectors.where(F.col("v").isNotNull() & fit).groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return got["size"] if got else 0


@dataclass(frozen=True)
class Whitening:
    """What the passes found: the fit list's count and sums, components as columns, their eigenvalues, the trace, the residuals."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    residuals: np.ndarray
    passes: int
    scale: int = SCALE
    shift: int = SHIFT

    @property
    def size(self) -> int:
        return len(self.sums)


def fit(vectors: DataFrame, *, vector: str = "embedding", components: int = COMPONENTS, block: int | None = None, scale: int = SCALE, shift: int = SHIFT, tolerance: float = TOLERANCE, seed: int = 11) -> Whitening | None:
    """The leading components of the vectors' covariance, each certified by its residual; None without vectors.

    The block has ``block`` columns at first, twice the components by default.
    Reads ``vectors`` once for each pass; stage a costly plan before.
    """
    own = vectors.select(F.col(vector).alias("v"))
    size = _size(own, scale)
    n, sums = _totals(own, size, scale, shift) if size else (0, [])
    if not n:
        return None
    rng = np.random.default_rng(seed)
    width = min(size, block or 2 * components)
    q = np.linalg.qr(rng.standard_normal((size, width)))[0]
    last = np.inf
    for passes in range(1, 10 * MAX_PASSES):
        sent = own.sparkSession.sparkContext.broadcast(q)  # dimension x block numbers

        def work(batches, sent=sent):
            block, total = sent.value, None
            for batch in batches:
                _, x = longs(batch.column(0), size, scale, shift)
                if len(x):
                    c = _centred(deviations(x, n, sums), n)
                    more = np.vstack((c.T @ (c @ block), np.concatenate(([np.einsum("ij,ij->", c, c)], np.zeros(block.shape[1] - 1)))))
                    total = more if total is None else total + more
            return total

        got = _gathered(own, work, size + 1, q.shape[1]) / n
        sent.destroy()
        y, trace = got[:-1], float(got[-1, 0])
        small = q.T @ y
        e, u = np.linalg.eigh((small + small.T) / 2)
        e, u = e[::-1], u[:, ::-1]
        w, yu = q @ u, y @ u
        want = min(components, size)
        residuals = np.linalg.norm(yu - w * e, axis=0)[:want]
        worst = float(residuals.max()) / max(float(e[0]), 1e-300)
        if q.shape[1] == size or worst <= tolerance:
            some = e[:want] > NO_VARIANCE * e[0]
            w = w[:, :want][:, some]
            w = w * np.sign(w[np.abs(w).argmax(axis=0), np.arange(w.shape[1])])
            return Whitening(n, sums, w, e[:want][some], trace, residuals[some], passes, scale, shift)
        rate = worst / last
        slow = passes >= MAX_PASSES or np.isfinite(last) and (rate >= 1 or np.log(tolerance / worst) / np.log(rate) > MORE_PASSES)
        last = worst
        if slow:  # a wider block; in the end it spans the space
            wider = size if passes >= MAX_PASSES else min(size, 2 * q.shape[1])
            yu, last = np.hstack((yu, rng.standard_normal((size, wider - q.shape[1])) * max(float(e[0]), 1.0))), np.inf
        q = np.linalg.qr(yu)[0]
    raise RuntimeError("the components did not settle")


def identity_error(vectors: DataFrame, model: Whitening, *, vector: str = "embedding") -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity."""
    own, k = vectors.select(F.col(vector).alias("v")), len(model.values)
    if not k:
        return 0.0
    n, sums, size, scale, shift = model.n, model.sums, model.size, model.scale, model.shift
    basis = model.vectors / np.sqrt(model.values)

    def work(batches):
        total = None
        for batch in batches:
            _, x = longs(batch.column(0), size, scale, shift)
            if len(x):
                z = _centred(deviations(x, n, sums), n) @ basis
                total = z.T @ z if total is None else total + z.T @ z
        return total

    return float(np.abs(_gathered(own, work, k, k) / n - np.eye(k)).max())


def whiten(vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT, block: int | None = None) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each vector and component.

    An entry c counts as floor(scale*c) + shift.  Vectors that are null or hold
    null or non-finite entries (or such without a long) are dropped; so are
    those of another length than the commonest (of equally common ones the
    longest), which have no place in the space.  Repeated rows count and come
    out repeatedly; ids may be null or equal.  Components without variance
    (fewer different vectors than components, constant dimensions) are left
    out, so one vector or equal ones give no row, like an empty table.
    ``deviation`` is null where it is beyond a long.  Other columns are ignored.
    """
    model = fit(vectors, vector=vector, components=components, scale=scale, shift=shift, block=block)
    kind = vectors.schema[vec_id].dataType.simpleString()
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    own = vectors.select(F.col(vec_id).alias("id"), F.col(vector).alias("v"))
    if model is None or not len(model.values):
        return own.where("false").mapInArrow(lambda batches: iter(()), schema).withColumnRenamed("id", vec_id)
    error = identity_error(vectors, model, vector=vector)
    n, sums, size, share = model.n, model.sums, model.size, model.values / model.trace
    basis, k = model.vectors / np.sqrt(model.values), len(model.values)

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for at in range(0, whole.num_rows, OUT_ROWS):
                batch = whole.slice(at, OUT_ROWS)
                rows, x = longs(batch.column(1), size, scale, shift)
                if not len(rows):
                    continue
                d = deviations(x, n, sums)
                ids = batch.column(0).take(pa.array(np.repeat(rows, k)))
                off = pa.array(squares(d), pa.int64()).take(pa.array(np.repeat(np.arange(len(rows)), k)))
                m = len(rows) * k
                yield pa.record_batch(
                    [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))), pa.array(np.full(m, n)), off, pa.array((_centred(d, n) @ basis).ravel()), pa.array(np.tile(share, len(rows))), pa.array(np.full(m, error))],
                    names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return own.mapInArrow(run, schema).withColumnRenamed("id", vec_id)
