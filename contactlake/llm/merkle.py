"""Merkle manifest of a table: digests, roots and membership proofs by time-forward processing.

Nodes are labelled level by level, so every node comes after its children.  A sweep takes nodes
by rising label and sends each digest forward to its parent through a priority queue ordered by
label; the reversed sweep takes them by falling label and sends every child the proof suffix
above it.  The queue is external: messages within a block of neighbouring leaves stay in a
task's heap of bounded size, messages that leave the block are rows of a table, which the next
tier reads in the order of their labels.
"""
from __future__ import annotations

import hashlib
import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactlake.llm.tables import on_workers, prefix_sums, stage
from contactlake.session import BROADCAST_MAX_ROWS

# Leaves of a block are at most fan_out ** levels; a task's heap holds no more messages than that.
BLOCK_LEAVES = 4096
_PROOF = "ARRAY<STRUCT<before: STRING, after: STRING>>"


def digest(text: str) -> str:
    """Lowercase hex sha256 of ASCII text."""
    return hashlib.sha256(text.encode()).hexdigest()


def field(value: Column) -> Column:
    """A value with its length in front: '-' if null, else UTF-8 byte count, ':', value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    """Digest of a row from its values."""
    return F.sha2(F.concat(*map(field, values)), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof lead to."""
    return F.aggregate(proof, leaf, lambda d, s: F.sha2(F.concat(s["before"], d, s["after"]), 256))


def block_levels(leaves: int, fan_out: int = 2) -> int:
    """Levels of a block of at most ``leaves`` leaves, one at least."""
    levels, size = 1, fan_out
    while size * fan_out <= leaves:
        levels, size = levels + 1, size * fan_out
    return levels


def climb(nodes: int, levels: int, fan_out: int) -> int:
    """Levels to go up from ``nodes`` neighbours until one is left, at most ``levels``."""
    up = 0
    while nodes > 1 and up < levels:
        nodes, up = -(-nodes // fan_out), up + 1
    return up


class Block:
    """A subtree over neighbouring nodes, labelled from its leaves up."""

    def __init__(self, leaves: list[str], levels: int, fan_out: int):
        self.fan_out = fan_out
        self.first = [0]
        size = len(leaves)
        for _ in range(levels):
            self.first.append(self.first[-1] + size)
            size = -(-size // fan_out)
        self.end = [*self.first[1:], self.first[-1] + size]
        self.root = self.end[-1] - 1
        self.digests = self._forward(leaves)

    def _forward(self, leaves: list[str]) -> list[str]:
        """Digests by label: children send theirs to the parent's label."""
        out = [*leaves, *[""] * (self.root + 1 - len(leaves))]
        level, queue = 0, []
        for label in range(self.root):
            if label == self.end[level]:
                level += 1
            if level:
                # all messages of this label are in front
                parts = []
                while queue and queue[0][0] == label:
                    parts.append(heapq.heappop(queue)[2])
                out[label] = digest("".join(parts))
            parent = self.first[level + 1] + (label - self.first[level]) // self.fan_out
            heapq.heappush(queue, (parent, label, out[label]))
        if queue:
            out[self.root] = digest("".join(heapq.heappop(queue)[2] for _ in range(len(queue))))
        return out

    def backward(self, suffix: tuple) -> list[tuple]:
        """Proof suffixes of the leaves: a parent sends its own, behind the siblings, to each child."""
        out: list[tuple] = [()] * self.end[0]
        queue = [(-self.root, suffix)]
        level = len(self.first) - 1
        while queue:
            label, above = heapq.heappop(queue)
            label = -label
            while label < self.first[level]:
                level -= 1
            if not level:
                out[label] = above
                continue
            lo = self.first[level - 1] + (label - self.first[level]) * self.fan_out
            hi = min(lo + self.fan_out, self.end[level - 1])
            run = self.digests[lo:hi]
            for k in range(hi - lo):
                heapq.heappush(queue, (-(lo + k), (("".join(run[:k]), "".join(run[k + 1:])), *above)))
        return out


def _proofs(lists: list[tuple]) -> pa.Array:
    steps = [s for p in lists for s in p]
    at = [0]
    for p in lists:
        at.append(at[-1] + len(p))
    pairs = pa.StructArray.from_arrays([pa.array([s[0] for s in steps], pa.string()), pa.array([s[1] for s in steps], pa.string())],
                                       names=["before", "after"])
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pairs)


def _grow(nodes: DataFrame, most: int, levels: int, fan_out: int) -> list[DataFrame]:
    """Tiers of staged nodes (g, pos, nodes, digest): the given ones first, at last one node a tree."""
    width = fan_out ** levels

    def run(table):
        table = table.sort_by("pos")
        g, n = table.column("g")[0].as_py(), table.column("nodes")[0].as_py()
        top = Block(table.column("digest").to_pylist(), climb(n, levels, fan_out), fan_out)
        return pa.table({"g": pa.array([g], pa.int64()), "pos": pa.array([table.column("pos")[0].as_py() // width], pa.int64()),
                         "nodes": pa.array([-(-n // width)], pa.int64()), "digest": [top.digests[top.root]]})

    tiers = [nodes]
    while most > 1:
        most = -(-most // width)
        blocks = tiers[-1].select("g", "pos", "nodes", "digest", F.expr(f"pos div {width}").alias("_block"))
        tiers.append(stage(blocks.groupBy("g", "_block").applyInArrow(run, "g LONG, pos LONG, nodes LONG, digest STRING")))
    return tiers


def _sink(tiers: list[DataFrame], suffixes: DataFrame, levels: int, fan_out: int, names: list[str]) -> DataFrame:
    """The first tier's rows with ``proof``, from the suffixes (g, pos, proof) of the last tier's nodes.

    ``names`` are columns of the first tier to keep beside g, pos and digest.
    """
    width = fan_out ** levels

    def run(table, above):
        table = table.sort_by("pos")
        block = Block(table.column("digest").to_pylist(), climb(table.column("nodes")[0].as_py(), levels, fan_out), fan_out)
        suffix = tuple((s["before"], s["after"]) for s in above.column("proof")[0].as_py())
        return table.drop_columns(["nodes", "_block"]).append_column("proof", _proofs(block.backward(suffix)))

    for k in range(len(tiers) - 2, -1, -1):
        kept = ["g", "pos", "digest", *(names if k == 0 else [])]
        low = tiers[k].select(*kept, "nodes", F.expr(f"pos div {width}").alias("_block"))
        above = suffixes.select("g", "pos", "proof")
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in low.select(*kept).schema) + f", proof {_PROOF}"
        suffixes = low.groupBy("g", "_block").cogroup(above.groupBy("g", "pos")).applyInArrow(run, schema)
        if k:
            suffixes = stage(suffixes)
    return suffixes


def merkle_manifest(rows: DataFrame, group_col: str, order_col: str, leaf_col: str, fan_out: int = 2,
                    block_leaves: int = BLOCK_LEAVES, keep: tuple = ()) -> tuple[DataFrame, DataFrame, str | None]:
    """Leaves with their proofs, the subroot of every group, and the root.

    ``rows`` has a digest in ``leaf_col``.  Within a group leaves ascend by ``order_col``, nulls
    first, ties by digest; while several nodes remain, every ``fan_out`` consecutive ones (the last
    run may be shorter, even one) become the digest of their joined hex text.  Subroots in the
    order of their groups (null first, bytewise) become the root in the same way.

    Leaves: ``group_col``, ``order_col``, ``leaf_col``, ``keep``, subroot and proof, one entry a level
    from the leaf to the root: the siblings in front of the path and behind it, each joined.  Subroots:
    ``group_col``, leaves (long), subroot.  Repeated rows are leaves each.  An empty table has
    neither leaves nor subroots, and the root is None.

    A group with most of all rows is cut into blocks like any other; a task holds one block.
    Only counts, one row a partition and the root reach the driver.
    """
    levels = block_levels(block_leaves, fan_out)
    names = list(dict.fromkeys([group_col, order_col, leaf_col, *keep]))
    own = rows.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(names)), F.lit(1).alias("_one"))
    group, leaf = f"c{names.index(group_col)}", f"c{names.index(leaf_col)}"
    placed, _, _ = prefix_sums(own, [group, f"c{names.index(order_col)}", leaf], "_one")
    groups, _, found = prefix_sums(placed.groupBy(group).agg(F.count("*").alias("nodes")), [group], "nodes")
    groups = stage(groups.withColumnRenamed("before", "_start").withColumnRenamed("place", "g"))
    side = F.broadcast(groups) if found <= BROADCAST_MAX_ROWS else groups
    side = side.withColumnRenamed(group, "_group")
    leaves = stage(placed.drop("before", "_one").join(side, F.col(group).eqNullSafe(F.col("_group")))
                   .select("g", (F.col("place") - F.col("_start")).alias("pos"), "nodes", F.col(leaf).alias("digest"),
                           *[f"c{i}" for i in range(len(names))]))
    tiers = _grow(on_workers(leaves), groups.agg(F.max("nodes")).first()[0] or 0, levels, fan_out)

    # the subroots are the leaves of one more tree, in the order of their groups
    subroots = stage(tiers[-1].select(F.lit(0).cast("long").alias("g"), F.col("g").alias("pos"),
                                      F.lit(found).cast("long").alias("nodes"), "digest"))
    upper = _grow(subroots, found, levels, fan_out)
    root = upper[-1].first()
    suffixes = upper[-1].select("g", "pos", F.array().cast(_PROOF).alias("proof"))
    if len(upper) > 1:
        suffixes = _sink(upper, suffixes, levels, fan_out, [])
    suffixes = stage(suffixes.select(F.col("pos").alias("g"), F.lit(0).cast("long").alias("pos"), "proof"))

    kept = [f"c{i}" for i in range(len(names))]
    if len(tiers) > 1:
        proved = _sink(tiers, suffixes, levels, fan_out, kept)
    else:
        proved = leaves.join(suffixes.drop("pos"), "g")
    tops = subroots.select(F.col("pos").alias("_g"), F.col("digest").alias("subroot"))
    tops = F.broadcast(tops) if found <= BROADCAST_MAX_ROWS else tops
    out = (proved.join(tops, F.col("g") == F.col("_g"))
           .select(*(F.col(c).alias(n) for c, n in zip(kept, names)), "subroot", "proof"))
    summary = (groups.join(tops, F.col("g") == F.col("_g"))
               .select(F.col(group).alias(group_col), F.col("nodes").alias("leaves"), "subroot"))
    return out, summary, root and root.digest


def document_manifest(docs: DataFrame, tampered: Column | None = None, fan_out: int = 2,
                      block_leaves: int = BLOCK_LEAVES) -> DataFrame:
    """doc_id, leaf, subroot, root, proof and told_leaf of every document; groups are languages.

    A leaf is the digest of doc_id, source, lang, n_chars and text, each with its length in front
    and '-' for null.  ``told_leaf`` is the leaf again with 1 added to n_chars where ``tampered`` holds,
    else the leaf.  Null ids stand first in their language; other columns are ignored.
    """
    parts = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    told = [*parts[:3], F.col("n_chars") + 1, parts[4]]
    changed = F.when(tampered, leaf_digest(*told)) if tampered is not None else F.lit(None).cast("string")
    rows = docs.select("doc_id", "lang", leaf_digest(*parts).alias("leaf"), changed.alias("told"))
    out, _, root = merkle_manifest(rows, "lang", "doc_id", "leaf", fan_out, block_leaves, keep=("told",))
    return out.select("doc_id", "leaf", "subroot", F.lit(root).cast("string").alias("root"), "proof",
                      F.coalesce("told", "leaf").alias("told_leaf"))
