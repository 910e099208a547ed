"""Language-model scores against a plain recount, and against unigrams on held-out text."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quantloom.llm import common, lmscore

rng = random.Random(17)
VOCAB = ["".join(rng.choice("abcdefé") for _ in range(rng.randint(2, 6))) for _ in range(700)]
VOCAB = sorted(set(VOCAB))
FOLLOW = {w: rng.sample(VOCAB, 4) for w in VOCAB}
LOW = {i: i + 32 for i in range(65, 91)}


def chain(n):
    out = [rng.choice(VOCAB)]
    while len(out) < n:
        out.append(rng.choice(FOLLOW[out[-1]]))
    return out


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


LINE = "this line stands in very many documents of this corpus"
ROWS = [(i, " ".join(chain(rng.randint(1, 90)))) for i in range(120)]
ROWS += [(200 + i, f"{' '.join(chain(6))} {LINE}. {' '.join(chain(5))}") for i in range(60)]
ROWS += [(300, None), (301, ""), (302, " . "), (303, "Word"), (304, " ".join(chain(9000))), (None, ROWS[3][1]), (5, ROWS[4][1]), (5, ROWS[4][1]), (None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string").select("*", *[F.lit(7).alias(c) for c in ("id", "t", "key", "mode", "pack", "n_tokens", "sums")]).repartition(5)


def plain_scores(model, corpus, rows, own):
    """Sums over tokens of the Dirichlet prediction, by counting words."""
    def triples(text):
        w = ["", *words(text), ""]
        return [(w[k - 1], w[k + 1], w[k]) for k in range(1, len(w) - 1)]

    pairs = Counter(x for _, t in corpus for x in triples(t))
    sides = Counter(x[:2] for _, t in corpus for x in triples(t))
    out = []
    for i, t in rows:
        ((_, _, h, tail, of),) = lmscore.tokens(pa.array([t or ""]))
        logp = model.predicted(h, tail, of)
        total = sum(np.log((pairs[x] - own + lmscore.PRIOR * np.exp(p)) / (sides[x[:2]] - own + lmscore.PRIOR)) for x, p in zip(triples(t), logp, strict=True))
        out.append((str(i), len(h), total))
    return sorted(out)


@pytest.mark.parametrize(("heavy", "shard"), [(1 << 16, 2_000_000), (400, 700)])
def test_scores_match_a_recount(spark, docs, monkeypatch, heavy, shard):
    """Whole and split shards, with and without listed contexts and pairs."""
    monkeypatch.setattr(lmscore, "SHARD_TOKENS", shard)
    model = lmscore.fit(docs, heavy=heavy)
    assert model.total == sum(len(words(t)) for _, t in ROWS)
    if heavy == 400:
        assert len(model.heavy) >= 10 and model.heavy_n.max() >= 50
    got = lmscore.score(docs, model).collect()
    want = plain_scores(model, ROWS, ROWS, 1)
    assert len(got) == len(ROWS)
    for a, b in zip(sorted((str(r.doc_id), r.n_tokens, r.log_likelihood) for r in got), want, strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], abs=0.002 * b[1] + 1e-9)
    assert all((r.mean_log_likelihood is None) == (r.n_tokens == 0) for r in got)
    fresh = [(i, " ".join(chain(30)) + f" {LINE} unseen{i}") for i in range(20)]
    table = spark.createDataFrame(fresh, "doc_id long, text string")
    other = lmscore.score(table, model, docs).collect()
    for a, b in zip(sorted((str(r.doc_id), r.n_tokens, r.log_likelihood) for r in other), plain_scores(model, ROWS, fresh, 0), strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], abs=0.002 * b[1] + 1e-9)


def test_predictions_are_probabilities(docs):
    model = lmscore.fit(docs)
    z = lmscore.forward(model.net, np.array([[0, 3, 5, 60], [1, 1, 1, 1]]))[1]
    p = np.exp(z - z.max(axis=1, keepdims=True))
    assert (p > 0).all()
    for c in np.unique(model.word_class):
        assert np.exp(model.inside[model.word_class == c]).sum() == pytest.approx(1)
    assert len(model.words) > lmscore.CLASSES and len(np.unique(model.word_class)) > lmscore.TOP + 5


def test_held_out_text_beats_unigrams_and_order_matters(spark):
    seen = [(i, " ".join(chain(80))) for i in range(600)]
    table = spark.createDataFrame(seen, "doc_id long, text string").repartition(4)
    model = lmscore.fit(table)
    held = [chain(60) for _ in range(60)]
    mixed = [rng.sample(x, len(x)) for x in held]
    both = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(held + mixed)], "doc_id long, text string")
    s = {r.doc_id: r.mean_log_likelihood for r in lmscore.score(both, model, table).collect()}
    n = Counter(w for _, t in seen for w in words(t))
    total = sum(n.values())
    unigram = np.mean([np.log((n[w] + 1) / (total + len(n) + 1)) for x in held for w in x])
    assert len(n) > 4 * lmscore.CLASSES
    assert np.mean([s[i] for i in range(60)]) > unigram + 0.5
    assert np.mean([s[i] > s[60 + i] for i in range(60)]) > 0.95
    alone = []
    for x in held:
        ((_, _, h, tail, of),) = lmscore.tokens(pa.array([" ".join(x)]))
        alone.append(model.predicted(h, tail, of).mean())
    assert np.mean(alone) > unigram + 0.02  # the network by itself


def test_documents_that_occur_twice_score_apart(spark):
    rows = [(i, " ".join(rng.choices(VOCAB, k=60))) for i in range(300)]
    rows += [(1000 + i, t) for i, t in rows[:30]]
    s = {r.doc_id: r.mean_log_likelihood for r in lmscore.pseudo_likelihood(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    twice = [s[i] for i in range(30)] + [s[1000 + i] for i in range(30)]
    assert min(twice) > max(s[i] for i in range(30, 300)) and all(s[i] == pytest.approx(s[1000 + i], abs=1e-6) for i in range(30))


def test_long_texts_in_pieces(monkeypatch):
    text = " ".join(chain(5000))
    whole = list(lmscore.tokens(pa.array(["a b", text, None])))
    monkeypatch.setattr(lmscore, "text_pieces", lambda c: common.text_pieces(c, 300))
    parts = list(lmscore.tokens(pa.array(["a b", text, None])))
    assert np.array_equal(np.concatenate([x[2] for x in whole]), np.concatenate([x[2] for x in parts])) and sum(x[1] for x in parts) == 3


def test_empty_table(spark, docs):
    assert lmscore.pseudo_likelihood(docs.where("false")).count() == 0
    assert lmscore.pseudo_likelihood(spark.createDataFrame([(1, None)], "doc_id string, text string")).collect()[0].log_likelihood == 0


def test_rounds_train_on_every_token_once():
    for n in (0, 1, 7, 100):
        assert sorted(np.concatenate([lmscore.masked(step, n) for step in range(lmscore.ROUNDS)]).tolist()) == list(range(n))
