"""Masked pseudo-likelihood of documents under a bidirectional window network and the corpus's own contexts.

Every token is masked in turn and predicted from both sides.  A network reads
the classes of the two words on each side and predicts the token's class;
within the class, corpus counts predict the word.  On this prior stand the
exact counts of the whole corpus: how often the word stood between this left
and this right word elsewhere.  The prior and the counts join as a Dirichlet
prediction, and a document's score is the sum of its tokens' conditional
log-probabilities.

What is gathered grows with the corpus.  Word counts and counts of (left,
word, right) are shuffled tables over every token of every document.  Words
with at least one in VOCABULARY of all tokens (so at most VOCABULARY words)
are known to the network: the most frequent have classes of their own, the
others are clustered by the words that they stand beside.  Rarer words share
classes by their endings.  Only the network's weights are of fixed size; they
are trained in numpy inside the tasks, each on masked tokens of its own
documents, and averaged.

Tokens travel packed: a task sends its tokens by context to as many shards as
the corpus needs, and each shard sends back what the counts change in each
document.  Contexts and pairs of context and word with over one in HEAVY of
all tokens are listed (at most HEAVY each): tokens of a listed pair are scored
where they are, other tokens of a listed context are dealt by word, so no
shard depends on one context.
"""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWERED, SpanHasher, mix, stage, text_pieces, unstage, word_spans

#: A word is known to the network, a context or pair is listed, with one in so many tokens.
VOCABULARY, HEAVY = 1 << 15, 1 << 16
#: Classes: the edge of a document, the most frequent words, clusters of known words, endings of rare words.
EDGE, TOP, CLUSTERS, RARE, HIDDEN = 0, 31, 24, 8, 32
CLASSES = 1 + TOP + CLUSTERS + RARE
SIDES = (-2, -1, 1, 2)
#: Training: every token is masked in one of the rounds, which take turns, in batches; small tasks repeat theirs.
ROUNDS, BATCH, RATE, LEAST_SEEN, SEED = 2, 512, 0.1, 50_000, 11
#: Weight of the network's prediction beside the corpus's contexts, in tokens.
PRIOR = 1.0
#: Tokens that a shard holds on average, and that a task packs at once.
SHARD_TOKENS, PACK_TOKENS = 2_000_000, 1_000_000
#: Steps of a log-probability as it travels.
FINE = 2048.0
#: Cells of a count vector that travel in one row, and groups of tasks that are added up apart.
CHUNK, LANES = 1 << 12, 64
#: Partitions for each shard, so that few shards share one.
PARTITIONS = 6
SELF, CORPUS, QUERY = 0, 1, 2
PARTS = (("e", (len(SIDES), CLASSES, HIDDEN)), ("b", (HIDDEN,)), ("w", (HIDDEN, CLASSES)), ("c", (CLASSES,)))


def tokens(column):
    """Whole texts as (first row, number of texts, hash of each word, its ending's class, its text)."""
    hasher, held = SpanHasher(), None
    for row, raw, bounds in text_pieces(column):
        low = LOWERED[raw]
        starts, ends, of = word_spans(raw, bounds)
        words = hasher.spans(hasher.prefix(low), starts, ends)
        last, before = low[ends - 1].astype(np.int64), np.where(ends - starts > 1, low[np.maximum(ends - 2, 0)], 0)
        tail = ((last * 31 + before) % RARE).astype(np.uint8)
        if held and held[0] == row:  # a further piece of a long text
            held[2].append(words)
            held[3].append(tail)
            continue
        if held:
            yield _joined(held)
        held = (row, len(bounds) - 1, [words], [tail], of)
    if held:
        yield _joined(held)


def _joined(held):
    row, n, words, tail, of = held
    words = np.concatenate(words)
    return row, n, words, np.concatenate(tail), of if len(of) == len(words) else np.zeros(len(words), np.int64)


def beside(values: np.ndarray, of: np.ndarray, step: int, edge) -> np.ndarray:
    """The value so many tokens on in the same text; ``edge`` beyond it."""
    out, k = np.full(len(of), edge, values.dtype), abs(step)
    if len(of) > k:
        same = of[k:] == of[:-k]
        if step < 0:
            out[k:][same] = values[:-k][same]
        else:
            out[:-k][same] = values[k:][same]
    return out


def contexts(words: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of (left word, right word), and of that pair with the word between."""
    left, right = beside(words, of, -1, np.uint64(0)), beside(words, of, 1, np.uint64(0))
    context = mix(left * np.uint64(0x9E3779B97F4A7C15) + mix(right + np.uint64(0x632BE59BD9B4E019)))
    return context, mix(context * np.uint64(0xD6E8FEB86659FD93) + words)


@dataclass(frozen=True)
class Model:
    """Known words, classes, listed contexts and pairs, and the network."""

    total: int
    words: np.ndarray  # sorted hashes of known words
    word_class: np.ndarray
    inside: np.ndarray  # log P(word | class)
    rare: np.ndarray  # log P(word | class) of each ending's class
    heavy: np.ndarray  # sorted hashes of listed contexts and pairs
    heavy_n: np.ndarray
    net: dict[str, np.ndarray]

    def plain(self) -> tuple:
        """The parts alone: a broadcast of them needs no package where it is read."""
        return tuple(getattr(self, f.name) for f in fields(self))

    def classes(self, words: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The class of each word and log P(word | class)."""
        own, first = tail.astype(np.int64), 1 + TOP + CLUSTERS
        if not len(self.words):
            return first + own, self.rare[own]
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        known = self.words[at] == words
        return np.where(known, self.word_class[at], first + own), np.where(known, self.inside[at], self.rare[own])

    def listed(self, hashes: np.ndarray) -> np.ndarray:
        """Tokens of each hash in the corpus; 0 if it is not listed."""
        if not len(self.heavy):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.heavy, hashes), len(self.heavy) - 1)
        return np.where(self.heavy[at] == hashes, self.heavy_n[at], 0)

    def predicted(self, words: np.ndarray, tail: np.ndarray, of: np.ndarray) -> np.ndarray:
        """The network's log-probability of each token, masked."""
        cls, inside = self.classes(words, tail)
        window = np.stack([beside(cls, of, s, EDGE) for s in SIDES], 1)
        out = np.empty(len(words))
        for a in range(0, len(words), 1 << 14):
            z = forward(self.net, window[a : a + (1 << 14)])[1]
            top = z.max(axis=1, keepdims=True)
            own = z[np.arange(len(z)), cls[a : a + (1 << 14)]] - top[:, 0]
            out[a : a + (1 << 14)] = own - np.log(np.exp(z - top).sum(axis=1))
        return out + inside


def forward(net: dict[str, np.ndarray], window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hidden values and class logits."""
    hidden = net["b"] + net["e"][0][window[:, 0]]
    for k in range(1, len(SIDES)):
        hidden += net["e"][k][window[:, k]]
    np.tanh(hidden, out=hidden)
    return hidden, hidden @ net["w"] + net["c"]


def descend(net: dict[str, np.ndarray], window: np.ndarray, target: np.ndarray, passes: int, seed: int = SEED) -> dict[str, np.ndarray]:
    """The network after so many passes of AdaGrad over (window, class)."""
    net, rng, one = {k: v.copy() for k, v in net.items()}, np.random.default_rng(seed), np.eye(CLASSES, dtype=np.float32)
    seen = {k: np.full(v.shape, 1e-2, np.float32) for k, v in net.items()}
    for _ in range(passes):
        order = rng.permutation(len(target))
        for a in range(0, len(order), BATCH):
            own = order[a : a + BATCH]
            x = window[own]
            hidden, dz = forward(net, x)
            dz -= dz.max(axis=1, keepdims=True)
            np.exp(dz, out=dz)
            dz /= dz.sum(axis=1, keepdims=True)
            dz[np.arange(len(own)), target[own]] -= 1
            dh = (dz @ net["w"].T) * (1 - hidden * hidden)
            grad = {"e": np.stack([one[x[:, k]].T @ dh for k in range(len(SIDES))]), "b": dh.sum(axis=0), "w": hidden.T @ dz, "c": dz.sum(axis=0)}
            for k, g in grad.items():
                g /= len(own)
                seen[k] += g * g
                net[k] -= RATE * g / np.sqrt(seen[k])
    return net


def masked(step: int, n: int) -> np.ndarray:
    """Which of n tokens a round trains on: the rounds together on each one once."""
    return np.arange(step, n, ROUNDS)


def _flat(net: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([net[k].ravel() for k, _ in PARTS])


def _shaped(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, shape in PARTS:
        n = int(np.prod(shape))
        out[k] = flat[at : at + n].reshape(shape).astype(np.float32)
        at += n
    return out


def _summed(docs: DataFrame, cells: int, task) -> np.ndarray:
    """The sum of each task's vector of so many cells, added by chunk; ``task`` turns runs of tokens into one vector."""

    def count(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        lane = TaskContext.get().partitionId() % LANES
        total = task(run for batch in batches for run in tokens(batch.column(0)))
        for c in range(0, cells, CHUNK):
            at = np.flatnonzero(total[c : c + CHUNK])
            if len(at):
                yield pa.record_batch([pa.array([c // CHUNK], pa.int32()), pa.array([lane], pa.int32()), pa.array([at.astype(np.int16).tobytes()], pa.binary()), pa.array([total[c + at].tobytes()], pa.binary())], names=["chunk", "lane", "at", "n"])

    def add_lanes(batches):
        import pyarrow as pa

        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for c, lane, at, n in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                sums.setdefault((c, lane), np.zeros(CHUNK))[np.frombuffer(at, np.int16)] += np.frombuffer(n, np.float64)
        every = np.arange(CHUNK).astype(np.int16).tobytes()
        yield pa.record_batch([pa.array([c for c, _ in sums], pa.int32()), pa.array([every] * len(sums), pa.binary()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["chunk", "at", "n"])

    def add(batches):
        import pyarrow as pa

        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, at, n in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                sums.setdefault(c, np.zeros(CHUNK))[np.frombuffer(at, np.int16)] += np.frombuffer(n, np.float64)
        yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["chunk", "n"])

    out = np.zeros(-(-cells // CHUNK) * CHUNK)
    lanes = docs.mapInArrow(count, "chunk int, lane int, at binary, n binary").repartition("chunk", "lane").mapInArrow(add_lanes, "chunk int, at binary, n binary")
    parts = lanes.repartition("chunk").mapInArrow(add, "chunk int, n binary")  # LANES rows for each chunk
    for r in parts.toLocalIterator():  # so many cells, whatever the corpus
        out[r.chunk * CHUNK : r.chunk * CHUNK + CHUNK] = np.frombuffer(r.n, np.float64)
    return out[:cells]


def counts(docs: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """(hash, tail, n) of every word; with tail -1, of contexts and pairs that a task saw often: none of the others is heavy.

    A context or pair with one in ``heavy`` of all tokens has that share in a
    task's tokens at least once.
    """

    def run(batches):
        import pyarrow as pa

        def pack(parts):
            words, tail, context, pair = (np.concatenate(x) for x in zip(*parts, strict=True))
            least = max(2, -(-len(words) // heavy))
            found = []
            own, first, n = np.unique(words, return_index=True, return_counts=True)
            found.append((own, tail[first].astype(np.int32), n))
            for h in (context, pair):
                own, n = np.unique(h, return_counts=True)
                own, n = own[n >= least], n[n >= least]
                found.append((own, np.full(len(own), -1, np.int32), n))
            h, tail, n = (np.concatenate(x) for x in zip(*found, strict=True))
            return pa.record_batch([pa.array(h.view(np.int64)), pa.array(tail), pa.array(n.astype(np.int64))], names=["hash", "tail", "n"])

        parts, held = [], 0
        for batch in batches:
            for _, _, words, tail, of in tokens(batch.column(0)):
                parts.append((words, tail, *contexts(words, of)))
                held += len(words)
                if held >= 4 * PACK_TOKENS:
                    yield pack(parts)
                    parts, held = [], 0
        if held:
            yield pack(parts)

    return docs.mapInArrow(run, "hash long, tail int, n long").groupBy("hash", "tail").agg(F.sum("n").alias("n"))


def clusters(profiles: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """The cluster of each profile (counts of neighbours): k-means on square roots of shares, begun at the first k."""
    x = np.sqrt(profiles / np.maximum(profiles.sum(axis=1, keepdims=True), 1)).astype(np.float32)
    if len(x) <= k:
        return np.arange(len(x))
    at, centre = np.zeros(len(x), np.int64), x[:k].copy()
    for _ in range(rounds):
        at = (x @ centre.T - (centre**2).sum(axis=1) / 2).argmax(axis=1)
        for c in range(k):
            if (at == c).any():
                centre[c] = x[at == c].mean(axis=0)
    return at


def fit(docs: DataFrame, *, text: str = "text", vocabulary: int = VOCABULARY, heavy: int = HEAVY) -> Model:
    """Counts of the whole corpus, classes of its words, and the network trained on it."""
    own = docs.select(F.col(text).alias("t"))
    table = stage(counts(own, heavy), "word-counts")
    total = table.where("tail >= 0").agg(F.sum("n")).first()[0] or 0
    known = F.col("n") * vocabulary >= total
    top = table.where((F.col("tail") >= 0) & known).orderBy(F.desc("n"), "hash").collect()  # at most `vocabulary` rows
    rare = {r.tail: (r.types, r.tokens) for r in table.where((F.col("tail") >= 0) & ~known).groupBy("tail").agg(F.count(F.lit(1)).alias("types"), F.sum("n").alias("tokens")).collect()}
    listed = [r.hash for r in table.where((F.col("tail") < 0) & (F.col("n") * heavy >= total)).select("hash").collect()]  # at most 2 * `heavy` rows
    unstage(table)
    by_count = np.array([r.hash for r in top], np.int64).view(np.uint64)
    n = np.array([r.n for r in top], np.int64)
    order = np.argsort(by_count)
    words, rank = by_count[order], order
    listed = np.sort(np.array(listed, np.int64).view(np.uint64))

    def neighbours(runs):
        """For each known word, its left and right neighbours among the most frequent words; then the listed hashes."""
        width = TOP + 2
        out = np.zeros(len(words) * 2 * width + len(listed))
        for _, _, w, _, of in runs:
            at = np.minimum(np.searchsorted(words, w), max(len(words) - 1, 0))
            place = np.where(words[at] == w, rank[at], len(words)) if len(words) else np.zeros(len(w), np.int64)
            name = np.where(place < TOP, place + 1, TOP + 1)
            for side, step in enumerate((-1, 1)):
                cell = (place * 2 + side) * width + beside(name, of, step, 0)
                cell = cell[place < len(words)]
                out[: len(words) * 2 * width] += np.bincount(cell, minlength=len(words) * 2 * width)
            for h in contexts(w, of) if len(listed) else ():
                at = np.minimum(np.searchsorted(listed, h), len(listed) - 1)
                out[len(words) * 2 * width :] += np.bincount(at[listed[at] == h], minlength=len(listed))
        return out

    seen = _summed(own, len(words) * 2 * (TOP + 2) + len(listed), neighbours) if total else np.zeros(0)
    cut = len(words) * 2 * (TOP + 2)
    profiles = seen[:cut].reshape(len(words), 2 * (TOP + 2))
    by_rank = np.concatenate((1 + np.arange(min(TOP, len(n))), 1 + TOP + clusters(profiles[TOP:], CLUSTERS))).astype(np.int64)
    mass = np.bincount(by_rank, n, CLASSES) if len(n) else np.zeros(CLASSES)
    inside = np.log(n / mass[by_rank]) if len(n) else np.zeros(0)
    types = np.array([rare.get(t, (0, 0))[0] for t in range(RARE)])
    mass[1 + TOP + CLUSTERS :] = [rare.get(t, (0, 0))[1] for t in range(RARE)]
    rng = np.random.default_rng(SEED)
    net = {k: (rng.standard_normal(shape) * (0.1 if len(shape) > 1 else 0)).astype(np.float32) for k, shape in PARTS}
    net["c"] = np.log((mass + 0.5) / (mass.sum() + 0.5 * CLASSES)).astype(np.float32)
    model = Model(total, words, by_rank[rank] if len(n) else np.zeros(0, np.int64), inside[rank] if len(n) else np.zeros(0), -np.log(types + 1.0), listed, seen[cut:].astype(np.int64), net)
    for step in range(ROUNDS if total else 0):
        sent = docs.sparkSession.sparkContext.broadcast(model.plain())  # known words and weights: bounded

        def learn(runs, sent=sent, step=step):
            own, xs, ys, kept, n = Model(*sent.value), [], [], None, 0
            start = own.net
            for _, _, w, tail, of in runs:
                cls, _ = own.classes(w, tail)
                at = masked(step, len(w))
                xs.append(np.stack([beside(cls, of, s, EDGE)[at] for s in SIDES], 1))
                ys.append(cls[at])
                if sum(map(len, ys)) >= LEAST_SEEN * 4:
                    start = descend(start, np.concatenate(xs), np.concatenate(ys), 1)
                    n += sum(map(len, ys))
                    xs, ys, kept = [], [], True
            rest = sum(map(len, ys))
            if rest:
                start = descend(start, np.concatenate(xs), np.concatenate(ys), 1 if kept else min(20, max(1, LEAST_SEEN // rest)))
                n += rest
            return np.append(_flat(start) * float(n), float(n))

        size = sum(int(np.prod(s)) for _, s in PARTS) + 1
        sums = _summed(own, size, learn)
        if sums[-1]:
            model = replace(model, net=_shaped(sums[:-1] / sums[-1]))
    return model


def _sent(docs: DataFrame, model, role: int, shards: int, doc_id: str, text: str, kind: str) -> DataFrame:
    """Packed tokens by shard, and a row of documents for each pack.

    mode 0: by context (40 bits of it and 24 of the word); mode 1: of a listed
    context, by pair; mode 2: the pack's documents with the network's sums.
    """

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        own, part, serial = Model(*model.value), TaskContext.get().partitionId(), 0
        types = [pa.int32(), pa.int32(), pa.string(), pa.binary(), None, pa.list_(pa.int64()), pa.list_(pa.float64())]

        def pack(parts, ids, sizes, base):
            nonlocal serial
            name, serial = f"{role}-{part}-{serial}", serial + 1
            rows = []
            words, tail, of = (np.concatenate(x) for x in zip(*parts, strict=True))
            context, pair = contexts(words, of)
            logp = own.predicted(words, tail, of) if role != CORPUS else np.zeros(len(words))
            total = np.bincount(of, logp, len(ids))
            c_n, p_n = own.listed(context), own.listed(pair)
            if role != CORPUS:  # a listed pair's tokens are scored here
                here = (c_n > 0) & (p_n > 0)
                less = 1 if role == SELF else 0
                p = np.exp(logp[here])
                total += np.bincount(of[here], np.log((p_n[here] - less + PRIOR * p) / (c_n[here] - less + PRIOR)) - logp[here], len(ids))
            fine = np.minimum(np.round(-logp * FINE), 65535).astype("<u2")
            for mode, wanted, key in ((0, c_n == 0, context), (1, (c_n > 0) & (p_n == 0), pair)):
                at = np.flatnonzero(wanted)
                shard = (key[at] % np.uint64(shards)).astype(np.int64)
                at = at[np.argsort(shard, kind="stable")]
                shard = np.sort(shard)
                cuts = np.append(np.flatnonzero(np.diff(shard, prepend=-1)), len(at))
                code = (context >> np.uint64(24) << np.uint64(24)) | (words & np.uint64((1 << 24) - 1)) if mode == 0 else pair
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    i = at[a:b]
                    body = code[i].tobytes() + of[i].astype("<u2").tobytes() + fine[i].tobytes() + (c_n[i].astype("<i8").tobytes() if mode else b"")
                    rows.append((int(shard[a]), mode, name, body, None, None, None))
            if role != CORPUS:
                rows.append((serial % shards, 2, name, None, ids, sizes, (total + np.array(base)).tolist()))
            return pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["key", "mode", "pack", "body", "ids", "sizes", "sums"])

        parts, ids, sizes, base, held = [], [], [], [], 0
        for batch in batches:
            types[4] = pa.list_(batch.column(0).type)
            names = batch.column(0).to_pylist()
            for row, k, words, tail, of in tokens(batch.column(1)):
                parts.append((words, tail, of + len(ids)))
                ids += names[row : row + k]
                sizes += np.bincount(of, minlength=k).tolist()
                base += [0.0] * k
                held += len(words)
                if held >= PACK_TOKENS or len(ids) > 30_000:  # a run has at most 30,000 texts: places in a pack stay below 2**16
                    yield pack(parts, ids, sizes, base)
                    parts, ids, sizes, base, held = [], [], [], [], 0
        if ids:
            yield pack(parts, ids, sizes, base)

    own = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t"))
    return own.mapInArrow(run, f"key int, mode int, pack string, body binary, ids array<{kind}>, sizes array<long>, sums array<double>")


def changes(mode: int, bodies: list[tuple[str, bytes]]) -> list[tuple[str, bytes]]:
    """What the counts of one shard change: (pack, places and differences of log-probability) for packs that are scored."""
    each = 20 if mode else 12
    sizes = [len(b) // each for _, b in bodies]
    take = lambda b, n, at, kind: np.frombuffer(b, kind, n, at)
    code = np.concatenate([take(b, n, 0, "<u8") for (_, b), n in zip(bodies, sizes, strict=True)])
    place = np.concatenate([take(b, n, 8 * n, "<u2") for (_, b), n in zip(bodies, sizes, strict=True)])
    logp = np.concatenate([take(b, n, 10 * n, "<u2") for (_, b), n in zip(bodies, sizes, strict=True)]) / -FINE
    role = np.repeat([int(p[0]) for p, _ in bodies], sizes)
    counted = (role != QUERY).astype(np.int64)
    own, at = np.unique(code, return_inverse=True)
    n_pair = np.bincount(at, counted, len(own)).astype(np.int64)[at]
    if mode == 0:
        own, at = np.unique(code >> np.uint64(24), return_inverse=True)
        n_context = np.bincount(at, counted, len(own)).astype(np.int64)[at]
    else:
        n_context = np.concatenate([take(b, n, 12 * n, "<i8") for (_, b), n in zip(bodies, sizes, strict=True)])
    less = (role == SELF).astype(np.int64)
    n_pair, n_context = n_pair - less, n_context - less
    p = np.exp(logp)
    change = np.log((n_pair + PRIOR * p) / (n_context + PRIOR)) - logp
    wanted = (n_context > 0) & (role != CORPUS)
    out, a = [], 0
    for (pack, _), n in zip(bodies, sizes, strict=True):
        own = np.flatnonzero(wanted[a : a + n]) + a
        a += n
        if len(own):
            out.append((pack, place[own].tobytes() + change[own].astype("<f4").tobytes()))
    return out


def _scored(sent: DataFrame, shards: int, kind: str) -> DataFrame:
    schema = f"pack string, body binary, ids array<{kind}>, sizes array<long>, sums array<double>"

    def judge(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        names = ["pack", "body", "ids", "sizes", "sums"]

        def close(key, bodies):
            rows = changes(key[1], bodies)
            return pa.record_batch([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary()), *(pa.nulls(len(rows), t) for t in types)], names=names)

        now, bodies, types = None, [], None
        for batch in batches:
            types = [batch.column(k).type for k in (4, 5, 6)]
            for key, mode, pack, body in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if mode == 2:
                    continue
                if (key, mode) != now:
                    if bodies:
                        yield close(now, bodies)
                    now, bodies = (key, mode), []
                bodies.append((pack, body))
            documents = batch.filter(pc.equal(batch.column(1), 2))
            yield pa.record_batch([documents.column(k) for k in range(2, 7)], names=names)
        if bodies:
            yield close(now, bodies)

    def add(batches):
        import pyarrow as pa

        def close(rows):
            documents = next((r for r in rows if r[2] is not None), None)
            if documents is None:
                return None
            total = np.array(documents[4], np.float64)
            for _, body, ids, _, _ in rows:
                if ids is None:
                    n = len(body) // 6
                    total += np.bincount(np.frombuffer(body, "<u2", n), np.frombuffer(body, "<f4", n, 2 * n), len(total))
            return pa.record_batch([pa.array(documents[2], id_type), pa.array(documents[3], pa.int64()), pa.array(total)], names=["id", "n_tokens", "log_likelihood"])

        now, rows, id_type = None, [], None
        for batch in batches:
            id_type = batch.column(2).type.value_type
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != now:
                    if rows and (done := close(rows)) is not None:
                        yield done
                    now, rows = row[0], []
                rows.append(row)
        if rows and (done := close(rows)) is not None:
            yield done

    parts = min(shards * PARTITIONS, 20_000)
    judged = sent.repartition(parts, "key", "mode").sortWithinPartitions("key", "mode", "pack").mapInArrow(judge, schema)
    return judged.repartition(parts, "pack").sortWithinPartitions("pack").mapInArrow(add, f"id {kind}, n_tokens long, log_likelihood double")


def score(docs: DataFrame, model: Model, corpus: DataFrame | None = None, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, log_likelihood (a sum) and mean_log_likelihood of every row.

    ``corpus`` is what the model was fitted on; without it, ``docs`` is, and
    each token is judged by the other tokens' contexts.  Null and empty texts
    have no tokens: sum 0, mean null.  Equal texts have equal scores, up to
    rounding.  An empty table gives an empty one.  Other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model.plain())  # bounded by VOCABULARY and HEAVY
    kind = docs.schema[doc_id].dataType.simpleString()
    shards = max(1, -(-model.total // SHARD_TOKENS))
    rows = _sent(docs, sent, SELF if corpus is None else QUERY, shards, doc_id, text, kind)
    if corpus is not None:
        rows = rows.unionByName(_sent(corpus.select(F.lit(None).cast(kind).alias(doc_id), text), sent, CORPUS, shards, doc_id, text, kind))
    out = _scored(rows, shards, kind)
    return out.select(F.col("id").alias(doc_id), "n_tokens", "log_likelihood", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")).alias("mean_log_likelihood"))


def pseudo_likelihood(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``score`` of every row of ``docs`` under the model that is fitted on all of them."""
    return score(docs, fit(docs, text=text), doc_id=doc_id, text=text)
