"""Merkle manifest of a dataset: a hash tree for each group of rows, and one over the groups' roots.

Rows of a group stand in a fixed order; every two consecutive nodes become
their digest, a lone last one becomes its own, until one node is left.  The
tree is cut into aligned blocks of 2**BLOCK_BITS nodes.  A task walks a block
by postorder recursion: it returns the digest of each subtree and, while it
unwinds, appends the sibling's digest to the proofs of the leaves below.  The
blocks' roots are the nodes of the next, much smaller, traversal.  Proofs come
back down the same way, from a block's root to the rows of the block, so that
no join key has more rows than a block.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StructType

from .common import stage, unstage

#: Levels of the tree that one task walks in one go.
BLOCK_BITS = 12
#: Rows that are folded back at once.
FOLD_ROWS = 2_000


def digest_of(*nodes: bytes) -> bytes:
    """The digest of one or two nodes: their hexadecimal texts, one after the other."""
    return hashlib.sha256("".join(x.hex() for x in nodes).encode()).digest()


def walk(leaves: list[bytes], height: int) -> tuple[bytes, list[list[bytes | None]]]:
    """The root of a subtree of so many levels and each leaf's siblings from below; None where a node stood alone."""
    proofs: list[list[bytes | None]] = [[] for _ in leaves]

    def fold(lo: int, levels: int) -> bytes:
        if not levels:
            return leaves[lo]
        mid, end = lo + (1 << levels - 1), min(lo + (1 << levels), len(leaves))
        left = fold(lo, levels - 1)
        if mid >= end:
            for own in proofs[lo:end]:
                own.append(None)
            return digest_of(left)
        right = fold(mid, levels - 1)
        for own in proofs[lo:mid]:
            own.append(right)
        for own in proofs[mid:end]:
            own.append(left)
        return digest_of(left, right)

    return fold(0, height), proofs


def climb(leaf: bytes, at: int, siblings: list[bytes | None]) -> bytes:
    """The root that a leaf at place ``at`` and its siblings give."""
    for s in siblings:
        leaf = digest_of(leaf) if s is None else digest_of(s, leaf) if at & 1 else digest_of(leaf, s)
        at >>= 1
    return leaf


# --- places -------------------------------------------------------------------


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (with a group column g) with n, the rows of their group, and pos, their place in it from 0 on.

    Rows are sorted by range partitions; a place is the row's number in its
    partition plus the counts of the group's rows in the partitions before.
    No group is gathered.  Null groups and null order values come first.
    """
    by = ["g", *order]
    own = stage(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id()), "merkle-sorted")
    runs = own.groupBy("g", F.shiftright("at", 33).alias("part")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"))
    group = Window.partitionBy("g")  # of a group, one row for each partition that it touches
    before = F.coalesce(F.sum("rows").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(F.col("g").alias("r_g"), "part", (before - F.col("first")).alias("shift"), F.sum("rows").over(group).alias("n"))
    joined = own.join(runs, F.col("g").eqNullSafe(F.col("r_g")) & (F.shiftright("at", 33) == F.col("part")))
    out = stage(joined.select(*rows.columns, (F.col("at") + F.col("shift")).alias("pos"), "n"), "merkle-placed")
    unstage(own)
    return out


# --- traversal ----------------------------------------------------------------


def _walk_blocks(bits: int):
    """Reads rows sorted by block and place; adds proof, and top (the block's root) on each block's first row."""

    def run(batches):
        import pyarrow as pa

        def done(table: pa.Table):
            pos, n, nodes = table["pos"].to_numpy(), table["n"].to_numpy(), table["node"].to_pylist()
            starts = np.flatnonzero(pos & (1 << bits) - 1 == 0)
            proofs, tops = [], [None] * len(pos)
            for a, b in zip(starts, [*starts[1:], len(pos)], strict=True):
                height = min(int(n[a] - 1).bit_length(), bits)
                tops[a], own = walk(nodes[a:b], height)
                proofs += own
            table = table.append_column("proof", pa.array(proofs, pa.list_(pa.binary()))).append_column("top", pa.array(tops, pa.binary()))
            yield from table.to_batches()

        pending = None
        for batch in batches:
            if not batch.num_rows:
                continue
            own = pa.Table.from_batches([batch])
            pending = own if pending is None else pa.concat_tables([pending, own])
            cut = int(np.flatnonzero(pending["pos"].to_numpy() & (1 << bits) - 1 == 0)[-1])  # the last block may go on
            if cut:
                yield from done(pending.slice(0, cut))
                pending = pending.slice(cut)
        if pending is not None:
            yield from done(pending)

    return run


def traverse(nodes: DataFrame, bits: int = BLOCK_BITS) -> tuple[list[DataFrame], DataFrame]:
    """Every level of blocks of the trees over ``nodes`` (g, pos, n, node, more), and the groups' roots (g, node)."""
    levels, cur = [], nodes
    most = nodes.agg(F.max("n")).first()[0] or 1
    while True:
        schema = StructType([*cur.schema.fields]).add("proof", ArrayType(BinaryType())).add("top", BinaryType())
        dealt = cur.withColumn("block", F.shiftright("pos", bits)).repartition("g", "block").sortWithinPartitions("g", "block", "pos").drop("block")
        levels.append(stage(dealt.mapInArrow(_walk_blocks(bits), schema), "merkle-level"))
        cur = levels[-1].where("top is not null").select("g", F.shiftright("pos", bits).alias("pos"), (F.shiftright(F.col("n") - 1, bits) + 1).alias("n"), F.col("top").alias("node"))
        most = (most - 1 >> bits) + 1
        if most == 1:
            return levels, cur.select("g", "node")


def _down(levels: list[DataFrame], above: DataFrame, bits: int) -> DataFrame:
    """The lowest level with whole proofs and the columns of ``above``, which has a row for each group (column g)."""
    extra = [c for c in above.columns if c != "g"]
    upper = above.select(F.col("g").alias("u_g"), F.lit(0).cast("long").alias("u_pos"), F.array().cast("array<binary>").alias("u_proof"), *extra)
    for level in reversed(levels):
        held = level.join(upper, F.col("g").eqNullSafe(F.col("u_g")) & (F.shiftright("pos", bits) == F.col("u_pos")))
        whole = held.withColumn("proof", F.concat("proof", "u_proof"))
        upper = whole.select(F.col("g").alias("u_g"), F.col("pos").alias("u_pos"), F.col("proof").alias("u_proof"), *extra)
    return whole.drop("u_g", "u_pos", "u_proof", "top")


# --- the operator ---------------------------------------------------------------


def leaf_of(*fields: Column) -> Column:
    """The digest (binary) of fields, each ``-`` if null, else its UTF-8 byte count, a colon and the value."""
    texts = [f.cast("string") for f in fields]
    return F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256))


def manifest(docs: DataFrame, *, leaf: Column, group: str = "lang", doc_id: str = "doc_id", carry: dict[str, Column] | None = None, bits: int = BLOCK_BITS) -> DataFrame:
    """doc_id, leaf, pos, proof, group_pos, above, subroot, root and the ``carry`` columns of every row.

    ``leaf`` is a binary column, the row's digest.  In a group rows ascend by
    ``doc_id``, null first, then by leaf; equal rows have places of their own.
    ``proof`` lists the siblings from the row to its group's subroot, ``above``
    those from there to the root, null where a node stood alone; ``pos`` and
    ``group_pos`` say which side each node was on.  Groups ascend bytewise, a
    null group first.  A lone row is its group's subroot, a lone subroot the
    root.  Null and empty texts are what ``leaf`` makes of them.  An empty
    table gives an empty manifest.  Other columns are ignored, whatever their
    names.
    """
    carry = carry or {}
    named = {f"c{i}": c.alias(f"c{i}") for i, c in enumerate(carry.values())}
    rows = docs.select(F.col(group).cast("string").alias("g"), F.col(doc_id).alias("id"), leaf.alias("node"), *named.values())
    own = stage(rows.withColumn("tie", F.monotonically_increasing_id()), "merkle-leaves")
    levels, subroots = traverse(placed(own, ["id", "node", "tie"]).drop("tie"), bits)
    unstage(own)

    tops = stage(subroots.select(F.lit("").alias("g"), F.col("g").alias("name"), "node"), "merkle-subroots")
    over, root = traverse(placed(tops, ["name"]), bits)
    top = root.select(F.col("g"), F.col("node").alias("root"))  # one row
    groups = _down(over, top, bits).select(F.col("name").alias("g"), F.col("pos").alias("group_pos"), F.col("proof").alias("above"), F.col("node").alias("subroot"), "root")
    groups = stage(groups, "merkle-groups")
    unstage(tops, *over)

    out = _down(levels, groups, bits)
    kept = [F.col(k).alias(name) for k, name in zip(named, carry, strict=True)]
    return out.select(F.col("id").alias(doc_id), F.col("g").alias(group), F.col("node").alias("leaf"), "pos", "proof", "group_pos", "above", "subroot", "root", *kept)


def verify(proofs: DataFrame, *, presented: str = "leaf") -> DataFrame:
    """``proofs`` (of ``manifest``) with proof_sha256, folded_root (both hexadecimal) and verified.

    ``presented`` is the digest that is folded with the siblings; a null one
    gives a null root that is not verified.
    """
    names = proofs.columns
    at = {c: names.index(c) for c in ("pos", "proof", "group_pos", "above", "root", presented)}

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for start in range(0, whole.num_rows, FOLD_ROWS):
                batch = whole.slice(start, FOLD_ROWS)
                value = {c: batch.column(i).to_pylist() for c, i in at.items()}
                hashes, folded, good = [], [], []
                for leaf, pos, low, g_pos, high, root in zip(*(value[c] for c in (presented, "pos", "proof", "group_pos", "above", "root")), strict=True):
                    hashes.append(hashlib.sha256("".join(s.hex() for s in (*low, *high) if s is not None).encode()).hexdigest())
                    top = None if leaf is None else climb(climb(leaf, pos, low), g_pos, high)
                    folded.append(top and top.hex())
                    good.append(top == root)
                yield pa.record_batch([*batch.columns, pa.array(hashes, pa.string()), pa.array(folded, pa.string()), pa.array(good, pa.bool_())], names=[*names, "proof_sha256", "folded_root", "verified"])

    schema = StructType([*proofs.schema.fields]).add("proof_sha256", "string").add("folded_root", "string").add("verified", "boolean")
    return proofs.mapInArrow(run, schema)


def tamper_check(docs: DataFrame, *, doc_id: str = "doc_id", source: str = "source", lang: str = "lang", n_chars: str = "n_chars", text: str = "text", bits: int = BLOCK_BITS) -> DataFrame:
    """The manifest of ``docs`` and what becomes of each row's proof if some rows are presented with one character too many.

    Returns doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.
    Where 7 divides the crc32 of the id, n_chars is presented with 1 added, a
    null stays; rows without id are presented as they are.
    """
    fields = lambda n: (F.col(doc_id), F.col(source), F.col(lang), n, F.col(text))
    chars = F.col(n_chars)
    tampered = F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 7 == 0, F.lit(False)) & chars.isNotNull()
    leaf = leaf_of(*fields(chars))
    shown = F.when(tampered, leaf_of(*fields(chars.cast("decimal(20,0)") + 1)))
    out = verify(manifest(docs, leaf=leaf, group=lang, doc_id=doc_id, carry={"shown": shown}, bits=bits).withColumn("shown", F.coalesce("shown", "leaf")), presented="shown")
    hexed = [F.lower(F.hex(c)).alias(c) for c in ("leaf", "subroot", "root")]
    return out.select(doc_id, *hexed, "proof_sha256", "folded_root", "verified")
