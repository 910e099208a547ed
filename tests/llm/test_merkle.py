"""The hash trees against a plain level-by-level version, over null groups and ids, ties, repeats and lone rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quantloom.llm import merkle

rng = random.Random(8)


def rows():
    out = [(i, rng.choice(["en", "en", "en", "de", None]), rng.choice(["a", None, "é"]), rng.choice([None, 5, 1 << 40]), rng.choice([None, "", "täxt", "x" * i])) for i in range(300)]
    out += [(7, "en", "a", 1, "same id")] * 3 + [(None, "en", None, None, None)] * 2 + [(None, None, "b", 3, "t"), (5, "lone", "a", 1, "one"), (-4, "pair", "a", 1, "z"), (9, "pair", "a", 9, "y"), (1 << 60, "", "a", (1 << 63) - 1, "long " * 30000)]
    return out


SCHEMA = "doc_id long, lang string, source string, n_chars long, text string"


def h(*nodes):
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def leaf(doc_id, lang, source, n_chars, text):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def levels(nodes):
    out = [nodes]
    while len(nodes) > 1:
        nodes = [h(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
        out.append(nodes)
    return out


def plain(data):
    groups = defaultdict(list)
    for r in data:
        groups[r[1]].append(r)
    trees = {}
    for g, own in groups.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, bytes.fromhex(leaf(*r))))
        trees[g] = levels([leaf(*r) for r in own])
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    upper = levels([trees[g][-1][0] for g in names])
    out = []
    for at, g in enumerate(names):
        for i, r in enumerate(groups[g]):
            path = [(row, i >> k) for k, row in enumerate(trees[g][:-1])] + [(row, at >> k) for k, row in enumerate(upper[:-1])]
            shown = leaf(r[0], r[1], r[2], r[3] + 1, r[4]) if r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 else leaf(*r)
            siblings = []
            for row, k in path:
                pair = [shown]
                if (k ^ 1) < len(row):
                    siblings.append(row[k ^ 1])
                    pair = [row[k ^ 1], shown] if k & 1 else [shown, row[k ^ 1]]
                shown = h(*pair)
            root = upper[-1][0]
            out.append((r[0], leaf(*r), trees[g][-1][0], root, h(*siblings), shown, shown == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("bits", [1, 2, 5, 12])
def test_against_plain_trees(spark, bits):
    docs = spark.createDataFrame(rows(), SCHEMA).select("*", *[F.lit(1).alias(c) for c in ("g", "pos", "n", "node", "tie", "at", "proof", "top")]).repartition(5)
    got = sorted((tuple(r) for r in merkle.tamper_check(docs, bits=bits).collect()), key=str)
    assert got == plain([tuple(r) for r in rows_of(docs)])
    assert {r[6] for r in got} == {True, False}


def rows_of(docs):
    return docs.select("doc_id", "lang", "source", "n_chars", "text").collect()


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 9])
def test_small_tables(spark, n):
    data = [(i, "en" if i % 2 else None, "s", i, "t") for i in range(n)]
    docs = spark.createDataFrame(data, SCHEMA)
    assert sorted((tuple(r) for r in merkle.tamper_check(docs, bits=1).collect()), key=str) == plain(data)


def test_reruns_agree_whatever_the_layout(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    runs = [sorted(map(tuple, merkle.tamper_check(docs.repartition(k), bits=3).collect()), key=str) for k in (1, 7)]
    assert runs[0] == runs[1]


def test_walk_returns_root_and_siblings():
    leaves = [hashlib.sha256(bytes([i])).digest() for i in range(11)]
    root, proofs = merkle.walk(leaves, 4)
    assert root.hex() == levels([x.hex() for x in leaves])[-1][0]
    assert all(merkle.climb(x, i, p) == root for i, (x, p) in enumerate(zip(leaves, proofs, strict=True)))
    assert merkle.climb(leaves[3], 2, proofs[2]) != root
