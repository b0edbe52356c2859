"""Merkle manifests against a plain tree over sorted lists."""
import hashlib
import zlib

import pytest
from helpers import no_documents, odd_documents, odd_rows
from pyspark.sql import functions as F

from contactlake.llm import merkle
from contactlake.llm.merkle import Block, climb, digest


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_tree(leaves, k=2):
    """Root and, for each leaf, [(siblings before, siblings after), ...]."""
    proofs, owner = [[] for _ in leaves], [[i] for i in range(len(leaves))]
    while len(leaves) > 1:
        nodes, owners = [], []
        for lo in range(0, len(leaves), k):
            run = leaves[lo:lo + k]
            for j in range(len(run)):
                for i in owner[lo + j]:
                    proofs[i].append(("".join(run[:j]), "".join(run[j + 1:])))
            nodes.append(digest("".join(run)))
            owners.append([i for o in owner[lo:lo + k] for i in o])
        leaves, owner = nodes, owners
    return leaves[0], proofs


def plain_manifest(rows, k=2):
    """Sorted (doc_id, leaf, subroot, root, proof, told_leaf, folded) of (doc_id, source, lang, n_chars, text) rows."""
    groups = {}
    for i, s, lang, n, t in rows:
        leaf = digest_any(field(i) + field(s) + field(lang) + field(n) + field(t))
        bad = i is not None and zlib.crc32(str(i).encode()) % 7 == 0
        told = digest_any(field(i) + field(s) + field(lang) + field(n if n is None else n + 1) + field(t)) if bad else leaf
        groups.setdefault(lang, []).append((i is not None, i, leaf, told))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_tree([r[2] for r in sorted(groups[g])], k) for g in order}
    root, above = plain_tree([trees[g][0] for g in order], k)
    out = []
    for g, up in zip(order, above):
        sub, proofs = trees[g]
        for (_, i, leaf, told), proof in zip(sorted(groups[g]), proofs):
            path, d = [*proof, *up], told
            for a, b in path:
                d = digest(a + d + b)
            out.append((i, leaf, sub, root, path, told, d))
    return sorted(out, key=repr)


def digest_any(text):
    return hashlib.sha256(text.encode()).hexdigest()


def spark_manifest(docs, k=2, block=4096):
    bad = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    out = merkle.document_manifest(docs, bad, fan_out=k, block_leaves=block).withColumn(
        "folded", merkle.fold(F.col("told_leaf"), F.col("proof")))
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, [tuple(s) for s in r.proof], r.told_leaf, r.folded)
                   for r in out.collect()), key=repr)


@pytest.mark.parametrize("k", [2, 3, 5])
@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 9, 17, 26])
def test_block(n, k):
    leaves = [digest(str(i)) for i in range(n)]
    block = Block(leaves, climb(n, 99, k), k)
    root, proofs = plain_tree(leaves, k)
    assert block.digests[block.root] == root
    assert [list(p) for p in block.backward(())] == proofs


def test_short_block_goes_up_with_the_tree():
    # the only node of a later block is hashed alone on every level below the top
    block = Block([digest("x")], 2, 2)
    assert block.digests[block.root] == digest(digest(digest("x")))
    assert block.backward((("a", ""),)) == [(("", ""), ("", ""), ("a", ""))]


@pytest.mark.parametrize("k,block", [(2, 4096), (2, 4), (3, 3), (2, 2)])
def test_manifest(spark, k, block):
    rows = [(i * 3 % 41, f"s{i % 3}", ["en", "de", None, "é", "z"][i * i % 5], i if i % 4 else None, f"text {i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id LONG, source STRING, lang STRING, n_chars LONG, text STRING")
    assert spark_manifest(docs.repartition(5), k, block) == plain_manifest(rows, k)


def test_many_groups(spark):
    rows = [(i, "s", f"g{i % 30}", 1, None) for i in range(95)]
    docs = spark.createDataFrame(rows, "doc_id LONG, source STRING, lang STRING, n_chars LONG, text STRING")
    assert spark_manifest(docs, block=4) == plain_manifest(rows)


def test_odd_rows(spark):
    rows = [(r[0], r[3], r[2], r[4], r[1]) for r in odd_rows()]
    assert spark_manifest(odd_documents(spark)) == plain_manifest(rows)
    assert spark_manifest(no_documents(spark)) == []


def test_one_row(spark):
    docs = spark.createDataFrame([(1, None, None, None, None)], "doc_id LONG, source STRING, lang STRING, n_chars LONG, text STRING")
    (out,) = spark_manifest(docs)
    leaf = digest("1:1----")
    assert out == (1, leaf, leaf, leaf, [], leaf, leaf)


def test_subroots(spark):
    rows = spark.createDataFrame([("a", 1, digest("1")), ("a", 2, digest("2")), (None, 1, digest("3"))], "g STRING, o INT, l STRING")
    leaves, groups, root = merkle.merkle_manifest(rows, "g", "o", "l")
    a = digest(digest("1") + digest("2"))
    assert sorted(map(tuple, groups.collect()), key=repr) == sorted([("a", 2, a), (None, 1, digest("3"))], key=repr)
    assert root == digest(digest("3") + a)
    assert leaves.columns == ["g", "o", "l", "subroot", "proof"]


def test_query_with_sql(spark):
    import oracle

    from contactlake.llm.queries import QUERIES, SQL

    con = oracle.connect("/root/testdata/sf0.001")
    assert oracle.compare(spark, con, "/root/testdata/sf0.001", QUERIES["op11_merkle"], SQL["op11_merkle"]) == []
