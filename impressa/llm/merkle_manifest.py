"""Merkle dataset manifest: hash trees per language under one root, with persistent path-copied versions.

Every document is a leaf; a language's leaves in doc_id order form a binary tree whose top is its
subroot, and the subroots form the tree of the root (``H`` is SHA-256 over hex digests).  A tampered
leaf does not rebuild anything: it makes a *version*, a new chain of copied ancestors that points to
the untouched sibling nodes of the original tree (``PersistentTree.put``).

Distribution: leaves are numbered inside their language by a range sort and per-partition offsets,
cut into aligned blocks of ``2 ** BLOCK_BITS`` leaves, and each block is one small tree in one task.
Block roots are the leaves of the next round, so a round shrinks the table by that factor; the
languages' subroots go through the same rounds as one more group.  Going back down, every block gets
the siblings of its root's way up (at most some dozens of digests), so a version that has copied its
ancestors inside its block goes on copying above it from its own row, however many versions there are.
No group is larger than a block.

Defined cases: a null column is ``-`` in the leaf; a null lang is its own tree and comes first; null
doc_ids come first in their tree and are never tampered with; equal doc_ids are ordered by leaf digest,
equal rows keep separate leaves; a lone leaf is its own subroot; an empty table has no rows; other
columns are ignored.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from impressa.llm.registry import query, table
from impressa.session import stored

BLOCK_BITS = 12  # leaves of a block: 4,096, some 10 digests and rows of 150 bytes each
LOCAL_BITS = 33  # monotonically_increasing_id = partition id << 33 | row number in partition
LEFT, RIGHT, LONE = "<", ">", "="  # where a path's sibling stands; LONE: the node is alone in its run


def _digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


class PersistentTree:
    """A binary hash tree whose nodes are never changed; ``put`` returns the root of a new version.

    Nodes are numbers into ``digest``, ``left`` and ``right`` (-1: no child).  A run of one child is
    a node with that child on the left.  Only the nodes on the way to the changed leaf are copied.
    """

    def __init__(self, leaves: list[str], levels: int):
        self.digest, self.left, self.right = list(leaves), [-1] * len(leaves), [-1] * len(leaves)
        self.levels = levels
        row = list(range(len(leaves)))
        for _ in range(levels):
            row = [self._node(row[i], row[i + 1] if i + 1 < len(row) else -1) for i in range(0, len(row), 2)]
        self.root = row[0]

    def _node(self, a: int, b: int) -> int:
        self.digest.append(_digest(self.digest[a], self.digest[b]) if b >= 0 else _digest(self.digest[a]))
        self.left.append(a)
        self.right.append(b)
        return len(self.digest) - 1

    def way(self, at: int, root: int | None = None) -> list[int]:
        """The nodes from the root (first) down to the leaf at position ``at``."""
        node = self.root if root is None else root
        out = [node]
        for level in range(self.levels - 1, -1, -1):
            node = self.right[node] if at >> level & 1 else self.left[node]
            out.append(node)
        return out

    def path(self, at: int) -> list[str]:
        """The siblings of the way up from the leaf, each marked by its place."""
        down = self.way(at)
        out = []
        for parent, child in zip(down[-2::-1], down[:0:-1]):
            a, b = self.left[parent], self.right[parent]
            out.append(LONE if b < 0 else RIGHT + self.digest[b] if child == a else LEFT + self.digest[a])
        return out

    def put(self, at: int, leaf: str) -> int:
        """The root of a version in which the leaf at ``at`` is ``leaf``; ``levels`` + 1 nodes are new."""
        down = self.way(at)
        self.digest.append(leaf)
        self.left.append(-1)
        self.right.append(-1)
        new = len(self.digest) - 1
        for parent, child in zip(down[-2::-1], down[:0:-1]):
            a, b = self.left[parent], self.right[parent]
            new = self._node(new, b) if child == a else self._node(a, new)
        return new


def copied_above(digest: str, path: list[str]) -> list[str]:
    """The digests of a version's copied ancestors: of the node itself, then one per path entry."""
    out = [digest]
    for step in path:
        side, sibling = step[0], step[1:]
        out.append(_digest(out[-1]) if side == LONE else _digest(out[-1], sibling) if side == RIGHT else _digest(sibling, out[-1]))
    return out


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(docs: DataFrame) -> DataFrame:
    """(tree, doc_id, leaf, tampered): leaf digests and, where the tampering reaches one, the other leaf."""
    def leaf(n_chars):
        return F.sha2(F.concat(*[_field(c) for c in (F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))]), 256)

    n = F.col("n_chars")
    hit = (F.crc32(F.col("doc_id").cast("string")) % 7 == 0) & n.isNotNull()
    return docs.select(F.coalesce(F.concat(F.lit("="), "lang"), F.lit("-")).alias("tree"),
                       F.col("doc_id").cast("long").alias("doc_id"), leaf(n).alias("leaf"),
                       F.when(hit, leaf(n.cast("decimal(20,0)") + 1)).alias("tampered"))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (tree, ...) with ``pos`` (0.. in ``order`` inside the tree) and ``size`` (leaves of the tree)."""
    keys = [F.asc_nulls_first(c) for c in ["tree", *order, "_row"]]
    kept = stored(rows.withColumn("_row", F.monotonically_increasing_id()))  # equal rows stay apart; the sort may sample
    ranged = stored(kept.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_mid", F.monotonically_increasing_id()))
    pid = F.shiftrightunsigned("_mid", LOCAL_BITS)
    # one row per partition and tree: a tree's rows are one run of a partition
    runs = ranged.groupBy("tree", pid.alias("_pid")).agg(F.min("_mid").alias("_first"), F.count("*").alias("_n"))
    whole = Window.partitionBy("tree")
    before = F.sum("_n").over(whole.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("tree", "_pid", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"),
                       F.sum("_n").over(whole).alias("size"))
    return ranged.withColumn("_pid", pid).join(runs, ["tree", "_pid"]) \
        .withColumn("pos", F.col("_mid") + F.col("_shift")).drop("_mid", "_pid", "_shift", "_row")


NODE = "tree string, pos long, size long, digest string"


PATH = "tree string, pos long, path array<string>"


def _block(t: pa.Table, bits: int) -> tuple[PersistentTree, pa.Table]:
    """A block's tree; near the top of a tree a block has only the levels that its tree still has."""
    t = t.sort_by("pos")
    return PersistentTree(t["digest"].to_pylist(), min(bits, (t["size"][0].as_py() - 1).bit_length())), t


def _roots(bits: int):
    def run(t: pa.Table) -> pa.Table:
        tree, t = _block(t, bits)
        size = t["size"][0].as_py()
        return pa.table({"tree": [t["tree"][0].as_py()], "pos": [t["pos"][0].as_py() >> bits],
                         "size": [((size - 1) >> tree.levels) + 1], "digest": [tree.digest[tree.root]]}, pa.schema(
            [("tree", pa.string()), ("pos", pa.int64()), ("size", pa.int64()), ("digest", pa.string())]))
    return run


def _paths(bits: int):
    def run(t: pa.Table, above: pa.Table) -> pa.Table:
        tree, t = _block(t, bits)
        top = above["path"][0].as_py()
        return pa.table({"tree": t["tree"], "pos": t["pos"], "path": [tree.path(i) + top for i in range(len(t))]},
                        pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("path", pa.list_(pa.string()))]))
    return run


def _blocks(nodes: DataFrame, bits: int):
    return nodes.groupBy("tree", F.shiftright("pos", bits).alias("block"))


def rounds(nodes: DataFrame, bits: int = BLOCK_BITS) -> list[DataFrame]:
    """The node tables (tree, pos, size, digest) of every round, from the leaves to one node per tree."""
    out = [nodes]
    while (out[-1].agg(F.max("size")).first()[0] or 0) > 1:
        out.append(stored(_blocks(out[-1], bits).applyInArrow(_roots(bits), NODE)))
    return out


def paths_down(tables: list[DataFrame], top: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """(tree, pos, path) of the blocks of ``tables[0]``'s round, where ``top`` (tree, path) continues at the trees' roots."""
    path = top.select("tree", F.lit(0).cast("long").alias("pos"), "path")
    for nodes in tables[:0:-1]:
        path = _blocks(nodes, bits).cogroup(path.groupBy("tree", "pos")).applyInArrow(_paths(bits), PATH)
    return path


PROVEN = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, copied array<string>"


def _prove(bits: int):
    def prove(t: pa.Table, above: pa.Table) -> pa.Table:
        """Every leaf's proof against the untouched tree, and the root of its own version if it is tampered with."""
        tree, t = _block(t, bits)
        top = above["path"][0].as_py()
        upward = copied_above(tree.digest[tree.root], top)
        subroot, root = upward[(t["size"][0].as_py() - 1).bit_length() - tree.levels], upward[-1]
        proof, folded, copied = [], [], []
        for at, (leaf, tampered) in enumerate(zip(t["leaf"].to_pylist(), t["tampered"].to_pylist())):
            path = tree.path(at)
            proof.append(_digest(*[s[1:] for s in path + top]))
            if tampered is None:
                folded.append(copied_above(leaf, path + top)[-1])
                copied.append(None)
            else:
                inside = [tree.digest[node] for node in tree.way(at, tree.put(at, tampered))[::-1]]
                copied.append(inside + copied_above(inside[-1], top)[1:])
                folded.append(copied[-1][-1])
        n = len(t)
        return pa.table({"doc_id": t["doc_id"], "leaf": t["leaf"], "subroot": pa.array([subroot] * n, pa.string()),
                         "root": pa.array([root] * n, pa.string()), "proof_sha256": proof, "folded_root": folded,
                         "copied": pa.array(copied, pa.list_(pa.string()))})
    return prove


def manifest(docs: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """One row per document: ``leaf``, ``subroot``, ``root``, ``proof_sha256`` of the untouched trees, ``folded_root``
    (the root over the tampered, else the original, leaf) and ``copied``, the digests of the nodes that the
    leaf's version owns, from the leaf to its root (null where nothing was tampered with)."""
    trees = rounds(numbered(leaves(docs), ["doc_id", "leaf"]).withColumn("digest", F.col("leaf")), bits)
    names = numbered(trees[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), ["name"])
    over = rounds(names, bits)
    # concat: a new column, as a table of one round is joined to itself
    start = paths_down(over, over[-1].select(F.concat("tree", F.lit("")).alias("tree"), F.array().cast("array<string>").alias("path")), bits)
    subpaths = _blocks(names, bits).cogroup(start.groupBy("tree", "pos")).applyInArrow(_paths(bits), PATH)
    top = names.select("name", "pos").join(subpaths.select("pos", "path"), "pos").select(F.concat("name", F.lit("")).alias("tree"), "path")
    return _blocks(trees[0], bits).cogroup(paths_down(trees, top, bits).groupBy("tree", "pos")).applyInArrow(_prove(bits), PROVEN)


def version_nodes(docs: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """(doc_id, height, digest): the nodes that each version owns; all others it shares with the untouched trees."""
    return manifest(docs, bits).where(F.col("copied").isNotNull()) \
        .select("doc_id", F.posexplode("copied").alias("height", "digest"))


# The same trees in DuckDB: levels by a recursive query, proofs by list folds.  Its two lists are CRC-32's table
# (from the polynomial 0xEDB88320) and the siblings of every leaf.
OP11_SQL = """
WITH RECURSIVE crc AS MATERIALIZED (
  SELECT list_transform(range(256), lambda i: list_reduce([i::BIGINT] || [k::BIGINT FOR k IN range(8)],
         lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END)) AS tbl),
src AS (
  SELECT doc_id, lang, n_chars,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
           || coalesce(strlen(lang) || ':' || lang, '-') AS head,
         coalesce(strlen(text) || ':' || text, '-') AS tail,
         xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
             lambda a, c: xor(a >> 8, tbl[(xor(a, c) & 255) + 1])), 4294967295::BIGINT) % 7 = 0 AS hit
  FROM documents, crc),
leaves AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM (
    SELECT doc_id, lang, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
           CASE WHEN hit THEN sha256(head || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || tail) END AS other
    FROM src)),
low AS (
  SELECT 0 AS lvl, lang, pos, leaf AS d, count(*) OVER (PARTITION BY lang) AS n FROM leaves
  UNION ALL
  SELECT lvl + 1, lang, pos // 2, sha256(string_agg(d, '' ORDER BY pos)), (n + 1) // 2
  FROM low WHERE n > 1 GROUP BY lvl, lang, pos // 2, n),
tops AS MATERIALIZED (
  SELECT lang, d AS subroot, lvl AS depth, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos FROM low WHERE n = 1),
high AS (
  SELECT 0 AS lvl, pos, subroot AS d, count(*) OVER () AS n FROM tops
  UNION ALL
  SELECT lvl + 1, pos // 2, sha256(string_agg(d, '' ORDER BY pos)), (n + 1) // 2 FROM high WHERE n > 1 GROUP BY lvl, pos // 2, n),
steps AS (
  SELECT l.doc_id, l.leaf, l.lang, l.pos, s.lvl AS lvl, CASE WHEN s.pos % 2 = 1 THEN '>' ELSE '<' END AS side, s.pos AS sib, t.depth
  FROM leaves l JOIN tops t ON l.lang IS NOT DISTINCT FROM t.lang
  JOIN low s ON s.lang IS NOT DISTINCT FROM l.lang AND s.lvl < t.depth AND s.pos = xor(l.pos >> s.lvl, 1)),
folds AS (
  SELECT lang, pos, list(step ORDER BY lvl) AS steps FROM (
    SELECT st.lang, st.pos, st.lvl, st.side || w.d AS step FROM steps st
      JOIN low w ON w.lang IS NOT DISTINCT FROM st.lang AND w.lvl = st.lvl AND w.pos = st.sib
    UNION ALL
    SELECT l.lang, l.pos, k.lvl, '=' FROM leaves l JOIN tops t ON l.lang IS NOT DISTINCT FROM t.lang
      JOIN (SELECT DISTINCT lang, lvl, n FROM low) k ON k.lang IS NOT DISTINCT FROM l.lang AND k.lvl < t.depth
        AND xor(l.pos >> k.lvl, 1) >= k.n
    UNION ALL
    SELECT l.lang, l.pos, 1000 + h.lvl, CASE WHEN h.pos % 2 = 1 THEN '>' ELSE '<' END || h.d
    FROM leaves l JOIN tops t ON l.lang IS NOT DISTINCT FROM t.lang JOIN high h ON h.n > 1 AND h.pos = xor(t.pos >> h.lvl, 1)
    UNION ALL
    SELECT l.lang, l.pos, 1000 + k.lvl, '=' FROM leaves l JOIN tops t ON l.lang IS NOT DISTINCT FROM t.lang
      JOIN (SELECT DISTINCT lvl, n FROM high WHERE n > 1) k ON xor(t.pos >> k.lvl, 1) >= k.n)
  GROUP BY lang, pos)
SELECT l.doc_id, l.leaf, t.subroot, r.d AS root,
       sha256(coalesce(list_reduce([''] || list_transform(f.steps, lambda s: substr(s, 2)), lambda a, s: a || s), '')) AS proof_sha256,
       list_reduce([coalesce(l.other, l.leaf)] || coalesce(f.steps, []), lambda a, s:
         CASE s[1] WHEN '=' THEN sha256(a) WHEN '>' THEN sha256(a || substr(s, 2)) ELSE sha256(substr(s, 2) || a) END) AS folded_root,
       folded_root = root AS verified
FROM leaves l JOIN tops t ON l.lang IS NOT DISTINCT FROM t.lang
JOIN (SELECT d FROM high WHERE n = 1) r ON true
LEFT JOIN folds f ON f.lang IS NOT DISTINCT FROM l.lang AND f.pos = l.pos
"""


@query("op11_persistent_merkle_manifest", OP11_SQL)
def op11(spark, sf_dir):
    return manifest(table(spark, sf_dir, "documents")).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
