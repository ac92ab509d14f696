"""N-gram Jaccard join: MinHash candidates, Bayesian pruning, exact verification.

Two texts are linked if the Jaccard similarity of their sets of five-word shingles is at least 0.8.

1. Equal texts become one node (an aggregation by text digest), so copies never form pairs.
2. MinHash values of a node are cut into ``BANDS`` bands of ``ROWS``.  A pair at the threshold agrees
   in no band with a probability below 1e-6.  Of buckets with the same members only one is kept.
3. Buckets become blocks of about ``BLOCK`` nodes, and block pairs are compared in one task each: a
   hot bucket spreads over many tasks, none holds it whole, and pairs never become rows.  A pair is
   looked at only in its first common band.
4. Bayesian pruning: further MinHash values, independent of the bands, are compared ``STEP`` at a
   time.  With a uniform prior, the similarity has a Beta posterior; a pair is dropped as soon as
   the probability of at least 0.8 is below ``TOLERANCE``.
5. Survivors travel as packed index pairs, one row per block pair, and are verified on the texts
   themselves: shared shingles are counted exactly, as strings.
6. Each block pair reports links per node and a spanning star of what it joined; components come
   from alternating large-star and small-star steps over these few edges.

Defined results: null text equals the empty text; a text of one to four words is one shingle; texts
without a word have no link, but are copies of each other; a null id counts as larger than any
other; repeated rows are copies; an empty table gives an empty result; extra columns are carried by
``keep_one`` and not read by ``links``.
"""

from __future__ import annotations

from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vinterra.llm.common import written
from vinterra.llm.words_np import Hasher, mix

SHINGLE = 5
THRESHOLD = Fraction(4, 5)
BANDS, ROWS = 20, 3
VALUES, STEP = 96, 16
TOLERANCE = 1e-6
BLOCK = 512
NO_ID = (1 << 63) - 1


def least_matches(step: int = STEP, values: int = VALUES, threshold: Fraction = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """After each ``step`` values: the fewest matches with P(similarity >= threshold) >= tolerance.

    With a uniform prior and ``m`` of ``n`` matches that posterior is P(Binomial(n + 1, t) <= m).
    """
    t = float(threshold)
    out = []
    for n in range(step, values + 1, step):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return out


class Signer:
    """MinHash values of the shingles of a text."""

    def __init__(self):
        self.hasher = Hasher()
        seed = mix(np.arange(1, 2 * (BANDS * ROWS + VALUES) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        seed = (seed >> np.uint64(32)).astype(np.uint32)
        self.a = (seed[::2] | np.uint32(1))[:, None]
        self.b = seed[1::2][:, None]

    def sign(self, text: bytes):
        """``(band keys, further values)``, or None for a text without a word."""
        words, _ = self.hasher.words(np.frombuffer(text, np.uint8))
        if not len(words):
            return None
        shingles = self.hasher.windows(words, min(SHINGLE, len(words)))
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        least = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        for i in range(0, len(x), 1024):
            np.minimum(least, (x[None, i : i + 1024] * self.a + self.b).min(axis=1), out=least)
        rows = least[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
        key = np.arange(BANDS, dtype=np.uint64)
        for r in range(ROWS):
            key = mix(key + rows[:, r] + np.uint64(0x9E3779B97F4A7C15))
        return key.view(np.int64), least[BANDS * ROWS :]


def text_digest(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("d"),
        text_digest(F.col(text_col)).alias("node"),
        F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"),
    )


def _signed(rows: DataFrame) -> DataFrame:
    """``node, d, bands, sig`` of every row (null bands: no words)."""

    def sign(batches):
        signer = Signer()
        for batch in batches:
            signed = [signer.sign(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("node"),
                    batch.column("d"),
                    pa.array([s and s[0] for s in signed], pa.list_(pa.int64())),
                    pa.array([s and s[1].tobytes() for s in signed], pa.binary()),
                ],
                ["node", "d", "bands", "sig"],
            )

    return rows.mapInArrow(sign, "node binary, d long, bands array<long>, sig binary")


GROUP = ("band", "key", "lo", "hi")


def by_group(batches, n_keys: int = len(GROUP)):
    """Yield ``(key, table)`` for each run of rows with equal leading key columns, across batches."""
    held, key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[:n_keys]], axis=1)
        edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for a, b in zip(edges, edges[1:]):
            this = tuple(keys[a].tolist())
            if held and this != key:
                yield key, pa.Table.from_batches(held)
                held = []
            key = this
            held.append(batch.slice(a, b - a))
    if held:
        yield key, pa.Table.from_batches(held)


def surviving_pairs(bands: np.ndarray, sig: np.ndarray, band: int, left: np.ndarray, right: np.ndarray, need: list[int]):
    """Index pairs whose first common band is ``band`` and that Bayesian pruning does not drop."""
    fresh = ~(bands[left, :band] == bands[right, :band]).any(axis=1)
    left, right = left[fresh], right[fresh]
    matches = np.zeros(len(left), np.int32)
    for k, least in enumerate(need):
        part = sig[:, k * STEP : (k + 1) * STEP]
        matches += (part[left] == part[right]).sum(axis=1, dtype=np.int32)
        stay = matches >= least
        left, right, matches = left[stay], right[stay], matches[stay]
        if not len(left):
            break
    return left, right


def _compared(members: DataFrame) -> DataFrame:
    """Per block pair with survivors: its nodes and packed index pairs."""
    need = least_matches()

    def compare(batches):
        for key, t in by_group(batches):
            band, _, lo, hi = key
            bands = t["bands"].combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
            sig = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint32).reshape(-1, VALUES)
            block = t["block"].to_numpy()
            if lo == hi:
                left, right = np.triu_indices(len(block), 1)
            else:
                one, two = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
                left, right = np.repeat(one, len(two)), np.tile(two, len(one))
            left, right = surviving_pairs(bands, sig, band, left, right, need)
            if not len(left):
                continue
            used, packed = np.unique(np.concatenate([left, right]), return_inverse=True)
            nodes = t["node"].take(pa.array(used)).to_pylist()
            pairs = packed.astype(np.int32).reshape(2, -1).tobytes()
            columns = [pa.array([k], pa.int64()) for k in key]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([nodes], pa.list_(pa.binary())), pa.array([pairs], pa.binary())], [*GROUP, "nodes", "pairs"])

    grouped = members.repartition(*GROUP).sortWithinPartitions(*GROUP)
    return grouped.mapInArrow(compare, "band long, key long, lo long, hi long, nodes array<binary>, pairs binary")


def shingles(text: bytes) -> set[bytes]:
    words = text.split()
    if len(words) < SHINGLE:
        return {b" ".join(words)} if words else set()
    return {b" ".join(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)}


def shared_counts(sets: list[set], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Size of the intersection of each pair of sets."""
    if len(left) <= 4 * len(sets):
        return np.array([len(sets[a] & sets[b]) for a, b in zip(left.tolist(), right.tolist())], np.int64)
    # many pairs among few texts: products of 0/1 matrices over the shingles that occur twice
    codes: dict[bytes, int] = {}
    ids = [np.fromiter((codes.setdefault(g, len(codes)) for g in s), np.int64, len(s)) for s in sets]
    row = np.repeat(np.arange(len(sets)), [len(i) for i in ids])
    col = np.concatenate(ids)
    often = np.bincount(col, minlength=len(codes)) > 1
    new = np.cumsum(often) - 1
    keep = often[col]
    row, col = row[keep], new[col[keep]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    width = max(64, (8 << 20) // len(sets))
    total = np.zeros((len(sets), len(sets)), np.int64)
    for start in range(0, int(often.sum()), width):
        a, b = np.searchsorted(col, [start, start + width])
        m = np.zeros((len(sets), width), np.float32)
        m[row[a:b], col[a:b] - start] = 1
        total += (m @ m.T).astype(np.int64)
    return total[left, right]


def stars(n: int, left: np.ndarray, right: np.ndarray) -> list[int]:
    """Smallest member of the component of each of ``n`` items."""
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in zip(left.tolist(), right.tolist()):
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def _verified(survivors: DataFrame, texts: DataFrame) -> DataFrame:
    """``node, n_links, root``: exact links per block pair, and the root of each node's local component."""
    p, q = THRESHOLD.numerator, THRESHOLD.denominator

    def verify(batches):
        for _, t in by_group(batches):
            data = t["data"].to_pylist()
            left, right = np.frombuffer(data[0], np.int32).reshape(2, -1)
            nodes, sets = t["node"].to_pylist()[1:], [shingles(x) for x in data[1:]]
            size = np.array([len(s) for s in sets], np.int64)
            shared = shared_counts(sets, left, right)
            # shared / (a + b - shared) >= p / q
            linked = (p + q) * shared >= p * (size[left] + size[right])
            left, right = left[linked], right[linked]
            count = np.bincount(np.concatenate([left, right]), minlength=len(nodes))
            root = stars(len(nodes), left, right)
            out = [(nodes[i], int(count[i]), nodes[root[i]]) for i in np.flatnonzero(count)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.binary(), pa.int64(), pa.binary()))], ["node", "n_links", "root"])

    held = survivors.select(*GROUP, F.posexplode("nodes").alias("ord", "node")).join(texts, "node")
    rows = held.select(*GROUP, "ord", "node", F.col("text").alias("data")).unionByName(
        survivors.select(*GROUP, F.lit(-1).alias("ord"), F.lit(None).cast("binary").alias("node"), F.col("pairs").alias("data"))
    )
    return rows.repartition(*GROUP).sortWithinPartitions(*GROUP, "ord").mapInArrow(verify, "node binary, n_links long, root binary")


def _are_stars(edges: DataFrame) -> bool:
    forked = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    chained = edges.select(F.col("b").alias("a")).join(edges.select("a"), "a", "left_semi")
    return not forked.select("a").unionAll(chained).take(1)


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of all nodes in ``edges (a, b)``: the root is the smallest of the component.

    Alternating large-star and small-star steps; each ends in a written table.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()
    e = written(e, "component-edges")
    while not _are_stars(e):
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        large = written(large, "component-large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").unionAll(low.select("a", F.col("m").alias("b")))
        e = written(small.distinct(), "component-edges")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def node_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per different text: ``node, d`` (smallest id), ``class_d, class_node`` (of its class), ``n_links``."""
    rows = _rows(docs, id_col, text_col)
    signed = _signed(rows)
    nodes = written(signed.groupBy("node").agg(F.min("d").alias("d"), F.first("bands").alias("bands"), F.first("sig").alias("sig")), "jaccard-nodes")
    in_bands = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    marks = [F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")]
    buckets = in_bands.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"), *marks).where("n > 1")
    # buckets with the same members are the same work: the first band does it
    first = buckets.groupBy("n", "x", "y").agg(F.min(F.struct("band", "key")).alias("b")).select("b.band", "b.key", "n")
    first = written(first, "jaccard-buckets")
    n_blocks = F.ceil(F.col("n") / BLOCK)
    held = in_bands.join(first, ["band", "key"]).select("band", "key", "node", F.pmod(F.xxhash64("node"), n_blocks).alias("block"), n_blocks.alias("n_blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)).alias("other")
    held = held.select("band", "key", "node", "block", other).select(
        F.col("band").cast("long").alias("band"), "key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "node", "block"
    )
    members = held.join(nodes.select("node", "bands", "sig"), "node").select(*GROUP, "node", "block", "bands", "sig")
    survivors = written(_compared(members), "jaccard-survivors")
    wanted = survivors.select(F.explode("nodes").alias("node")).distinct().join(nodes.select("node", "d"), "node")
    texts = rows.join(wanted, ["node", "d"]).dropDuplicates(["node", "d"]).select("node", "text")
    verified = written(_verified(survivors, texts), "jaccard-links")
    n_links = verified.groupBy("node").agg(F.sum("n_links").alias("n_links"))
    comps = components(verified.select(F.col("node").alias("a"), F.col("root").alias("b")))
    comps = comps.join(nodes.select("node", "d"), "node")
    chiefs = comps.groupBy("root").agg(F.min(F.struct("d", "node")).alias("chief"))
    linked = comps.join(chiefs, "root").join(n_links, "node").select("node", "chief", "n_links")
    linked = written(linked, "jaccard-classes")
    return nodes.select("node", "d").join(linked, "node", "left").select(
        "node",
        "d",
        F.coalesce("chief.d", "d").alias("class_d"),
        F.coalesce("chief.node", "node").alias("class_node"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, class_id, copy_of, n_links``.

    ``class_id``: smallest id of its near-duplicate class (texts connected by links);
    ``copy_of``: smallest id with the same text; ``n_links``: different texts linked to its text.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_digest(F.col(text_col)).alias("node"))
    classes = node_classes(docs, id_col, text_col)
    known = lambda c: F.nullif(F.col(c), F.lit(NO_ID))
    return rows.join(classes, "node").select("doc_id", known("class_d").alias("class_id"), known("d").alias("copy_of"), F.col("n_links").cast("long").alias("n_links"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each near-duplicate class (the smallest id), with all its columns."""
    classes = node_classes(docs, id_col, text_col)
    chiefs = written(classes.where("node = class_node").select("node", "d"), "jaccard-chiefs")
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("d"),
        text_digest(F.col(text_col)).alias("node"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
    )
    return rows.join(chiefs, ["node", "d"]).dropDuplicates(["node", "d"]).select("doc.*")


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
k AS (SELECT t, min(doc_id) AS r FROM d GROUP BY t),
w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM k),
s AS (
  SELECT DISTINCT r, array_to_string(w[p : p + least(len(w), 5) - 1], ' ') AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS p FROM w WHERE len(w) > 0)),
c AS (SELECT r, count(*) AS n FROM s GROUP BY r),
x AS (SELECT a.r AS a, b.r AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY ALL),
l AS (SELECT a, b FROM x JOIN c p ON p.r = a JOIN c q ON q.r = b WHERE 9 * i >= 4 * (p.n + q.n)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
v(r, m) AS (SELECT r, r FROM k UNION SELECT e.b, v.m FROM v JOIN e ON e.a = v.r WHERE v.m < e.b),
z AS (SELECT r, min(m) AS class_id FROM v GROUP BY r),
n AS (SELECT a AS r, count(*) AS n_links FROM e GROUP BY a)
SELECT doc_id, class_id, k.r AS copy_of, coalesce(n_links, 0)::BIGINT AS n_links
FROM d JOIN k USING (t) JOIN z USING (r) LEFT JOIN n USING (r)
"""
