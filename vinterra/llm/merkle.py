"""Merkle manifest of a dataset, kept as a postorder append log.

Every row is a leaf, every value of the group column has a tree over its leaves in id order, and one
more tree joins the roots of the groups.  A node is the hash of its children (two, or the one that is
left at the end of a level).

1. Leaves are digests of the rows' fields, computed by Spark and numbered per tree without a
   one-partition window.
2. Aligned builders: ``2**levels`` leaves from a multiple of that number are one block.  Its builder
   writes the nodes in the order in which they are completed, which is their postorder, as one packed
   segment; the last entry is the block's top.  The tops are the leaves of the next round, until a tree
   has one block: a handful of rounds, whatever the size, and a large tree is spread over many blocks.
3. A node's place in the log has a closed form.  Before leaf ``j`` is written, the ``j`` leaves and
   all subtrees completed over them have been: ``2j - popcount(j)`` entries.  So a node of height
   ``h`` whose last leaf is ``j`` stands ``h`` entries further, and siblings are addressed, not searched.
4. Proofs are cut from the segments from the top round downwards: a block's own path is continued by
   its leaves' siblings within the block, in one cogrouped pass per round.

``audit`` folds a proof from the leaf as the row reads now and compares it with the manifest's root.

Defined results: a null field has its own encoding, so null and empty differ; rows with a null group
are a tree of their own, before all others; null ids come first; rows with equal ids follow each
other by leaf digest, and equal rows have equal leaves; an empty table gives an empty result; columns
that are not fields are not read; texts of any length are hashed whole.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vinterra.llm.common import written
from vinterra.operators.encode import consecutive_index

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: A block has 2**LEVELS leaves; its segment takes 64 bytes a leaf.
LEVELS = 12
#: The tree over the roots of the groups; group trees are named "n" (null) or "v" and the value.
TOP = "top"


def node_hash(children: str) -> str:
    """Hash of the hex digests of a node's children, one after the other."""
    return hashlib.sha256(children.encode()).hexdigest()


def leaf_digest(fields: list[Column]) -> Column:
    """SHA-256 of the fields: ``-`` for null, else byte length, a colon and the value."""
    text = [f.cast("string") for f in fields]
    coded = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]
    return F.unhex(F.sha2(F.concat(*coded).cast("binary"), 256))


def height_of(n: int) -> int:
    """Levels above the leaves of a tree of ``n`` leaves."""
    return (n - 1).bit_length()


def postorder(leaves: list[str], height: int) -> list[str]:
    """Nodes of a tree of ``height`` levels over ``leaves``, in the order in which they are completed."""
    log, complete = [], []  # complete: subtrees whose right sibling has not come yet
    for i, node in enumerate(leaves):
        log.append(node)
        while i & 1:
            node, i = node_hash(complete.pop() + node), i >> 1
            log.append(node)
        complete.append(node)
    last = ""  # the node of the level below that the end of the leaves left open
    for h in range(height):
        if len(leaves) >> h & 1:
            last = node_hash(complete.pop() + last)
        elif last:
            last = node_hash(last)
        else:
            continue
        log.append(last)
    return log


def positions(h: int, i: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    """Place of node ``i`` of level ``h`` in the log of a tree over ``n`` leaves."""
    last = ((i + 1) << h) - 1
    full = 2 * last - np.bitwise_count(last) + h
    trailing = np.bitwise_count((n & -n) - 1).astype(np.int64)
    cut = 2 * n - np.bitwise_count(n) + np.maximum(h - 1 - trailing, 0)
    return np.where(last < n, full, cut)


def siblings(n: int, height: int) -> np.ndarray:
    """Per level and leaf, the place of the sibling on the leaf's path, or -1 where it has none."""
    out = np.full((height, n), -1, np.int64)
    leaf = np.arange(n, dtype=np.int64)
    for h in range(height):
        other = (leaf >> h) ^ 1
        out[h] = np.where(other << h < n, positions(h, other, np.int64(n)), -1)
    return out


def fold(leaf: str, path: bytes) -> str:
    """Root that follows from a leaf and its path of ``side, digest`` steps (side ``-``: no sibling)."""
    at = 0
    while at < len(path):
        side = path[at : at + 1]
        other = "" if side == b"-" else path[at + 1 : at + 33].hex()
        at += 1 if side == b"-" else 33
        leaf = node_hash(other + leaf if side == b"<" else leaf + other)
    return leaf


def path_digest(path: bytes) -> str:
    """SHA-256 of the hex digests of a path's siblings."""
    at, held = 0, []
    while at < len(path):
        if path[at : at + 1] == b"-":
            at += 1
        else:
            held.append(path[at + 1 : at + 33])
            at += 33
    return hashlib.sha256(b"".join(held).hex().encode()).hexdigest()


@dataclass
class Forest:
    """Hash trees: per round the segments ``tree, block, n, total, nodes, top``; ``roots``: ``tree, root``.

    ``n`` counts the tree's nodes on the round's lowest level, ``total`` its leaves.
    """

    rounds: list[DataFrame]
    roots: DataFrame
    levels: int


def build(leaves: DataFrame, levels: int = LEVELS) -> Forest:
    """Trees over ``leaves``: ``tree, j`` (0 .. n - 1), ``n, digest``."""
    size = 1 << levels

    def segment(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("j")
        n, total = rows["n"][0].as_py(), rows["total"][0].as_py()
        log = postorder([d.hex() for d in rows["digest"].to_pylist()], height_of(n) if n <= size else levels)
        out = {"tree": [key[0].as_py()], "block": [key[1].as_py()], "n": [n], "total": [total], "nodes": [bytes.fromhex("".join(log))], "top": [bytes.fromhex(log[-1])]}
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))})

    schema = "tree string, block long, n long, total long, nodes binary, top binary"
    rounds, level = [], leaves.select("tree", "j", "n", F.col("n").alias("total"), "digest")
    while True:
        blocks = level.withColumn("block", F.shiftright("j", levels)).groupBy("tree", "block").applyInArrow(segment, schema)
        rounds.append(written(blocks, "merkle-segments"))
        whole = F.col("n") <= size
        tops = rounds[-1].where(~whole)
        if not tops.take(1):
            break
        level = tops.select("tree", F.col("block").alias("j"), F.ceil(F.col("n") / F.lit(size)).alias("n"), "total", F.col("top").alias("digest"))
    roots = rounds[0].where(whole).select("tree", F.col("top").alias("root"))
    for r in rounds[1:]:
        roots = roots.unionByName(r.where(whole).select("tree", F.col("top").alias("root")))
    return Forest(rounds, roots, levels)


def append_log(forest: Forest) -> DataFrame:
    """``tree, pos, level, idx, digest``: every node at its place in its tree's log, without gaps."""
    levels = forest.levels

    def entries(base_level):
        def unpack(batches):
            for batch in batches:
                for tree, block, n, total, nodes in zip(*(batch.column(c).to_pylist() for c in ("tree", "block", "n", "total", "nodes"))):
                    first, m = block << levels, min(1 << levels, n - (block << levels))
                    height = height_of(n) if n <= 1 << levels else levels
                    for h in range(0 if base_level == 0 else 1, height + 1):  # a round's lowest level is the tops of the one before
                        i = np.arange(-(-m >> h), dtype=np.int64)
                        local, above = positions(h, i, np.int64(m)), base_level + h
                        place = positions(above, i + (first >> h), np.int64(total))
                        digests = [nodes[32 * p : 32 * p + 32] for p in local.tolist()]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([tree] * len(i)), pa.array(place), pa.array([above] * len(i), pa.int32()), pa.array(i + (first >> h)), pa.array(digests, pa.binary())],
                            ["tree", "pos", "level", "idx", "digest"],
                        )

        return unpack

    logs = [r.mapInArrow(entries(k * levels), "tree string, pos long, level int, idx long, digest binary") for k, r in enumerate(forest.rounds)]
    out = logs[0]
    for more in logs[1:]:
        out = out.unionByName(more)
    return out


def _paths_in_block(m: int, height: int, nodes: bytes, rest: bytes, wanted: list[int]) -> list[bytes]:
    """Whole path of the wanted leaves of a block, whose own path is ``rest``."""
    at = siblings(m, height)
    out = []
    for i in wanted:
        steps = [b"-" if p < 0 else (b"<" if i >> h & 1 else b">") + nodes[32 * p : 32 * p + 32] for h, p in enumerate(at[:, i].tolist())]
        out.append(b"".join(steps) + rest)
    return out


def _cogrouped(wanted: DataFrame, segments: DataFrame, levels: int, finish, schema: str) -> DataFrame:
    """``finish(rows, paths, segment)`` of each block's wanted leaves (column ``j``)."""
    size = 1 << levels

    def extract(rows: pa.Table, segment: pa.Table) -> pa.Table:
        seg = {c: segment[c][0].as_py() for c in segment.column_names}
        first = seg["block"] * size
        m, height = min(size, seg["n"] - first), height_of(seg["n"]) if seg["n"] <= size else levels
        paths = _paths_in_block(m, height, seg["nodes"], seg["path"], [j - first for j in rows["j"].to_pylist()])
        return finish(rows, paths, seg)

    keyed = wanted.withColumn("block", F.shiftright("j", levels)).groupBy("tree", "block")
    return keyed.cogroup(segments.groupBy("tree", "block")).applyInArrow(extract, schema)


def proofs(forest: Forest, above: DataFrame, wanted: DataFrame, finish, schema: str) -> DataFrame:
    """``finish`` of the ``wanted`` leaves (``tree, j`` and more) with their paths.

    ``above``: ``tree, path`` and more columns, the path of each tree's root, which goes with its segments.
    """
    size = 1 << forest.levels
    more = [c for c in above.columns if c not in ("tree", "path")]

    def plain(rows: pa.Table, paths: list[bytes], seg: dict) -> pa.Table:
        held = [pa.array([seg[c]] * len(paths), pa.binary()) for c in more]
        return pa.Table.from_arrays([rows["tree"], rows["j"], pa.array(paths, pa.binary()), *held], ["tree", "block", "path", *more])

    known = None
    for k in reversed(range(len(forest.rounds))):
        segments = forest.rounds[k].drop("total", "top")
        pathed = segments.where(F.col("n") <= size).join(above, "tree")
        if known is not None:
            pathed = pathed.unionByName(segments.where(F.col("n") > size).join(known, ["tree", "block"]))
        if k == 0:
            return _cogrouped(wanted, pathed, forest.levels, finish, schema)
        below = forest.rounds[k - 1].where(F.col("n") > size).select("tree", F.col("block").alias("j"))
        columns = "".join(f", {c} binary" for c in more)
        known = written(_cogrouped(below, pathed, forest.levels, plain, f"tree string, block long, path binary{columns}"), "merkle-paths")


@dataclass
class Manifest:
    """Leaves (``tree, j, n, id, digest, found``), group trees, and the tree over their roots."""

    leaves: DataFrame
    groups: Forest
    top: Forest
    subroots: DataFrame


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``j``, the place in its tree, and ``n``, the tree's leaves."""
    placed = consecutive_index(rows, ["tree", *order], "at")
    trees = written(placed.groupBy("tree").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")), "merkle-trees")
    return placed.join(trees, "tree").withColumn("j", F.col("at") - F.col("first")).drop("at", "first")


def manifest(
    docs: DataFrame,
    id_col: str = "doc_id",
    group_col: str = "lang",
    fields: tuple[str, ...] = FIELDS,
    found: dict[str, Column] | None = None,
    where_found: Column | None = None,
    levels: int = LEVELS,
) -> Manifest:
    """Manifest of ``docs``; ``found`` replaces fields by what is found later in rows of ``where_found``."""
    now = [F.col(f"`{c}`") for c in fields]
    later = [(found or {}).get(c, F.col(f"`{c}`")) for c in fields]
    rows = docs.select(
        F.coalesce(F.concat(F.lit("v"), F.col(f"`{group_col}`").cast("string")), F.lit("n")).alias("tree"),
        F.col(f"`{id_col}`").alias("id"),
        leaf_digest(now).alias("digest"),
        (F.when(where_found, leaf_digest(later)) if found else F.lit(None).cast("binary")).alias("found"),
        F.monotonically_increasing_id().alias("row"),  # equal rows: spread over the ranges
    )
    leaves = written(_numbered(written(rows, "merkle-rows"), ["id", "digest", "row"]).drop("row"), "merkle-leaves")
    groups = build(leaves, levels)
    subroots = written(_numbered(groups.roots.select(F.lit(TOP).alias("tree"), F.col("tree").alias("group"), F.col("root").alias("digest")), ["group"]), "merkle-subroots")
    return Manifest(leaves, groups, build(subroots, levels), subroots)


def audit(m: Manifest, id_name: str = "doc_id") -> DataFrame:
    """Per row: ``leaf, subroot, root, proof_sha256``, the root folded from the row as found, and whether it is the manifest's."""
    binary = ["path", "subroot", "root"]

    def group_paths(rows: pa.Table, paths: list[bytes], seg: dict) -> pa.Table:
        columns = [rows["group"], pa.array(paths, pa.binary()), rows["digest"], pa.array([seg["root"]] * len(paths), pa.binary())]
        return pa.Table.from_arrays(columns, ["tree", *binary])

    def checked(rows: pa.Table, paths: list[bytes], seg: dict) -> pa.Table:
        subroot, root = seg["subroot"].hex(), seg["root"].hex()
        leaf, found = rows["digest"].to_pylist(), rows["found"].to_pylist()
        folded = [fold((now or was).hex(), path) for was, now, path in zip(leaf, found, paths)]
        n = len(paths)
        columns = [
            rows["id"], pa.array([x.hex() for x in leaf]), pa.array([subroot] * n), pa.array([root] * n),
            pa.array([path_digest(p) for p in paths]), pa.array(folded), pa.array([f == root for f in folded]),
        ]
        return pa.Table.from_arrays(columns, [id_name, "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    none = m.top.roots.select("tree", F.lit(b"").alias("path"), "root")
    above = written(proofs(m.top, none, m.subroots, group_paths, "tree string, path binary, subroot binary, root binary"), "merkle-group-paths")
    id_type = m.leaves.schema["id"].dataType.simpleString()
    result = f"`{id_name}` {id_type}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return proofs(m.groups, above, m.leaves, checked, result)


def _coded(column: str) -> str:
    value = f"CAST({column} AS VARCHAR)"
    return f"coalesce(strlen({value}) || ':' || {value}, '-')"


def _leaf_sql(n_chars: str) -> str:
    return "sha256(" + " || ".join(_coded(n_chars if c == "n_chars" else c) for c in FIELDS) + ")"


ORACLE = f"""
WITH RECURSIVE crc AS (
  SELECT *, xor(list_reduce(
    list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ord(c)::BIGINT),
    lambda a, b: list_reduce(range(8), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END, xor(a, b)),
    4294967295::BIGINT), 4294967295::BIGINT) AS c
  FROM documents),
l AS (
  SELECT doc_id, lang, {_leaf_sql("n_chars")} AS h,
    CASE WHEN c % 7 = 0 THEN {_leaf_sql("(n_chars::HUGEINT + 1)")} END AS later
  FROM crc),
r AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS j, count(*) OVER (PARTITION BY lang) AS n
  FROM l),
t(lang, lvl, j, h, n) AS (
  SELECT lang, 0::BIGINT, j, h, n FROM r
  UNION ALL
  SELECT lang, lvl + 1, j // 2, sha256(string_agg(h, '' ORDER BY j)), (n + 1) // 2 FROM t WHERE n > 1 GROUP BY lang, lvl, j // 2, n),
s AS (
  SELECT lang, h, lvl AS top, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS j, count(*) OVER () AS n FROM t WHERE n = 1),
u(lvl, j, h, n) AS (
  SELECT 0::BIGINT, j, h, n FROM s
  UNION ALL
  SELECT lvl + 1, j // 2, sha256(string_agg(h, '' ORDER BY j)), (n + 1) // 2 FROM u WHERE n > 1 GROUP BY lvl, j // 2, n),
low AS (
  SELECT r.lang, r.j, t.lvl, t.j < (r.j >> t.lvl) AS before, t.h
  FROM r JOIN t ON t.lang IS NOT DISTINCT FROM r.lang AND t.j = xor(r.j >> t.lvl, 1)),
high AS (
  SELECT s.lang, u.lvl, u.j < (s.j >> u.lvl) AS before, u.h FROM s JOIN u ON u.j = xor(s.j >> u.lvl, 1)),
root AS (SELECT h, lvl AS top FROM u WHERE n = 1),
steps AS (
  SELECT r.lang, r.j, g.lvl, low.before, coalesce(low.h, '') AS h
  FROM r JOIN s ON s.lang IS NOT DISTINCT FROM r.lang, LATERAL (SELECT unnest(range(s.top)) AS lvl) g
  LEFT JOIN low ON low.lang IS NOT DISTINCT FROM r.lang AND low.j = r.j AND low.lvl = g.lvl
  UNION ALL
  SELECT r.lang, r.j, s.top + g.lvl, high.before, coalesce(high.h, '')
  FROM r JOIN s ON s.lang IS NOT DISTINCT FROM r.lang, LATERAL (SELECT unnest(range((SELECT top FROM root))) AS lvl) g
  LEFT JOIN high ON high.lang IS NOT DISTINCT FROM r.lang AND high.lvl = g.lvl),
p AS (
  SELECT lang, j, sha256(string_agg(h, '' ORDER BY lvl)) AS proof,
    list({{'before': coalesce(before, false), 'h': h}} ORDER BY lvl) AS path
  FROM steps GROUP BY lang, j),
f AS (
  SELECT r.doc_id, r.h AS leaf, s.h AS subroot, root.h AS root, coalesce(p.proof, sha256('')) AS proof_sha256,
    coalesce(list_reduce(p.path, lambda a, x: {{'before': false, 'h': CASE WHEN x.before THEN sha256(x.h || a.h) ELSE sha256(a.h || x.h) END}},
      {{'before': false, 'h': coalesce(r.later, r.h)}}).h, coalesce(r.later, r.h)) AS folded_root
  FROM r JOIN s ON s.lang IS NOT DISTINCT FROM r.lang CROSS JOIN root
  LEFT JOIN p ON p.lang IS NOT DISTINCT FROM r.lang AND p.j = r.j)
SELECT *, folded_root = root AS verified FROM f
"""
