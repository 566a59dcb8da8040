"""Merkle manifest: against a plain in-memory tree, with small blocks so that every kind of round occurs."""
import zlib
from collections import defaultdict
from hashlib import sha256

from impressa.llm.merkle_manifest import PersistentTree, copied_above, manifest, version_nodes
from tests.llm.util import edge_docs, no_docs


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, n_chars):
    doc_id, text, lang, source, _ = row
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def up(nodes):
    """All levels of a tree, bottom first."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i:i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def brute(rows):
    trees = defaultdict(list)
    for row in rows:
        trees[row[2]].append((row[0] is not None, row[0] or 0, leaf_of(row, row[4]), row))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    levels = {g: up([x[2] for x in sorted(trees[g], key=lambda x: x[:3])]) for g in langs}
    over = up([levels[g][-1][0] for g in langs])
    out = []
    for rank, g in enumerate(langs):
        for pos, (_, _, leaf, row) in enumerate(sorted(trees[g], key=lambda x: x[:3])):
            hit = row[0] is not None and row[4] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            siblings, now = [], leaf_of(row, row[4] + 1) if hit else leaf
            for tables, at in ((levels[g], pos), (over, rank)):
                for nodes in tables[:-1]:
                    run = nodes[at // 2 * 2:at // 2 * 2 + 2]
                    other = run[1 - at % 2:2 - at % 2] if len(run) == 2 else []
                    siblings += other
                    now = H(now) if not other else H(now, other[0]) if at % 2 == 0 else H(other[0], now)
                    at //= 2
            out.append((row[0], leaf, levels[g][-1][0], over[-1][0], H(*siblings), now))
    return sorted(out, key=str)


COLS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root")


def test_edges_against_a_plain_tree(spark):
    docs = edge_docs(spark, [(i, f"text {i}", "fr" if i % 3 else "it", "z", i) for i in range(20, 53)])
    rows = [tuple(r) for r in docs.collect()]
    got = sorted((tuple(r[c] for c in COLS) for r in manifest(docs.withColumn("pos", docs.n_chars), 2).collect()), key=str)
    assert got == brute(rows)


def test_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    got = manifest(docs, 3).collect()
    assert sorted((tuple(r[c] for c in COLS) for r in got), key=str) == brute(rows)
    for r in got:
        hit = zlib.crc32(str(r.doc_id).encode()) % 7 == 0
        assert (r.folded_root == r.root) is not hit and (r.copied is not None) is hit


def test_empty_and_single(spark):
    assert manifest(no_docs(spark)).count() == 0
    one = manifest(no_docs(spark).union(spark.createDataFrame([(3, "a", None, None, None)], no_docs(spark).schema))).collect()[0]
    assert one.leaf == one.subroot == one.root == one.folded_root and one.proof_sha256 == H()


def test_versions_share_every_untouched_node():
    leaves = [H(str(i)) for i in range(11)]
    tree = PersistentTree(leaves, 4)
    old = len(tree.digest)
    before = list(zip(tree.digest, tree.left, tree.right))
    roots = [tree.put(at, H("new", str(at))) for at in range(11)]
    assert len(tree.digest) == old + 11 * 5 and before == list(zip(tree.digest, tree.left, tree.right))[:old]
    for at, root in enumerate(roots):
        changed = leaves[:at] + [H("new", str(at))] + leaves[at + 1:]
        assert tree.digest[root] == up(changed)[-1][0]
        # another leaf of the version is the very node of the first tree
        assert tree.way((at + 5) % 11, root)[-1] == (at + 5) % 11
        assert copied_above(changed[at], tree.path(at)) == [tree.digest[n] for n in tree.way(at, root)[::-1]]


def test_version_nodes(spark):
    docs = spark.createDataFrame([(i, f"t{i}", "en", "s", i) for i in range(40)], no_docs(spark).schema)
    hit = [i for i in range(40) if zlib.crc32(str(i).encode()) % 7 == 0]
    got = version_nodes(docs, 2).groupBy("doc_id").count().collect()
    assert hit and sorted((r[0], r[1]) for r in got) == [(i, 7) for i in hit]  # a leaf and six levels; one language adds none
