"""Near-duplicate grouping with SuperMinHash signatures.

A document's set is its distinct five-word shingles, lower-cased; two documents are linked if the
Jaccard similarity of their sets is at least 0.85, and linked documents are one component.

1. Equal texts are one node.  SuperMinHash gives every shingle a random permutation of the signature's
   slots; its ``j``-th slot gets rank ``j`` plus a random fraction, and a slot keeps the least value.
   Ranks are spread over all slots instead of drawn independently, so estimates vary less.  All
   shingles take their first rank, then their second and so on, until no slot can fall any further:
   long texts stop after one or two ranks.
2. Banding: slots agree in one of ``BANDS`` bands of ``ROWS``; a pair at the threshold fails in all of
   them with a probability of about 4e-7.
3. First verification: every node is compared with its most central partner, the one whose buckets are
   the largest.  In a group of copies edited from one text that is the text, so one round joins most of
   the group, and its buckets hold little more to compare.
4. Second verification: where a bucket still spans components, its nodes are dealt to blocks, and a pair
   of blocks that spans components is one group of a task.  Pairs whose signatures agree too little are
   dropped; the others are compared, most agreement first, and a union-find over the components skips
   pairs that are joined already.
5. Links are confirmed on the full sets of shingles, as strings.  Components of the confirmed links come
   from large-star and small-star steps over one edge per union.

No link between different components is lost: a pair is only left out when its ends are joined already.

Defined results: null and empty texts and texts without a word have an empty set, no links and are
their own component; with one to four words the whole sequence is the one shingle; texts of any length
are read whole; repeated rows and rows that share an id are documents of their own, linked by their
texts only; a null id is no id: the component takes the smallest id of the others, and is null, with
all its rows kept, if there is none; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vinterra.llm.common import written
from vinterra.llm.jaccard_join import by_group, components, text_digest
from vinterra.llm.words_np import Hasher, mix

SHINGLE = 5
#: Linked: 100 * intersection >= 85 * union.
PERCENT = 85
BANDS, ROWS = 20, 4
SLOTS = BANDS * ROWS
#: A linked pair agrees in fewer slots with at most this probability.
TOLERANCE = 1e-9
BLOCK = 256
#: Copies of a text, and partners of a node, are dealt to so many keys.
SALTS = 64
CHUNK = 2048
_STEP = np.uint64(0x9E3779B97F4A7C15)


def least_agreement(slots: int = SLOTS, percent: int = PERCENT, tolerance: float = TOLERANCE) -> int:
    """Fewest slots in which linked pairs agree, but for ``tolerance``."""
    t, total, m = percent / 100, 0.0, -1
    while total < tolerance:
        m += 1
        total += comb(slots, m) * t**m * (1 - t) ** (slots - m)
    return m


def super_minhash(elements: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """Signature of a set of 64-bit hashes: per slot, the least ``rank << 25 | fraction`` (32 bits)."""
    least = np.full(slots, 0xFFFFFFFF, np.uint32)
    for start in range(0, len(elements), CHUNK):
        state = elements[start : start + CHUNK].copy()
        rows = np.arange(len(state))
        order = np.tile(np.arange(slots, dtype=np.uint8), (len(state), 1))
        for rank in range(slots):
            if int(least.max()) >> 25 < rank:
                break  # every slot holds a lower rank: nothing drawn from here on can be less
            state = mix(state + _STEP)
            pick = rank + ((state >> np.uint64(32)) * np.uint64(slots - rank) >> np.uint64(32)).astype(np.int64)
            slot = order[rows, pick]
            order[rows, pick] = order[:, rank]
            value = (state & np.uint64(0x1FFFFFF)).astype(np.uint32) | np.uint32(rank << 25)
            np.minimum.at(least, slot, value)
    return least


def shingles(text: bytes) -> set:
    """Distinct shingles of a text, as tuples of words."""
    w = text.lower().split()
    if len(w) < SHINGLE:
        return {tuple(w)} if w else set()
    return set(zip(*(w[k:] for k in range(SHINGLE))))


class Signer:
    """Set size, band keys and signature of a text."""

    def __init__(self):
        self.hasher = Hasher()

    def sign(self, text: bytes):
        size = len(shingles(text))
        if not size:
            return 0, None, None
        words, _ = self.hasher.words(np.frombuffer(text.lower(), np.uint8))
        least = super_minhash(np.unique(self.hasher.windows(words, min(SHINGLE, len(words)))))
        rows = least.reshape(BANDS, ROWS).astype(np.uint64)
        key = np.arange(BANDS, dtype=np.uint64)
        for r in range(ROWS):
            key = mix(key + rows[:, r] + _STEP)
        return size, key.view(np.int64), least.tobytes()


def linked(a: set, b: set) -> bool:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < PERCENT * len(large):
        return False
    shared = len(small & large)
    return 100 * shared >= PERCENT * (len(a) + len(b) - shared)


class UnionFind:
    def __init__(self):
        self.parent = {}

    def find(self, x):
        root = x
        while (up := self.parent.get(root, root)) != root:
            root = up
        while x != root:
            self.parent[x], x = root, self.parent.get(x, x)
        return root

    def union(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
        return a != b


def _signed(rows: DataFrame) -> DataFrame:
    """``id, node, salt, n_shingles, bands, sig`` of rows with ``id, node, salt, text``."""

    def sign(batches):
        signer = Signer()
        for batch in batches:
            signed = [signer.sign(t.as_py()) for t in batch.column("text")]
            sizes, bands, sigs = zip(*signed) if signed else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("node"), batch.column("salt"), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())],
                ["id", "node", "salt", "n_shingles", "bands", "sig"],
            )

    return rows.mapInArrow(sign, "id long, node binary, salt int, n_shingles long, bands array<long>, sig binary")


def with_group(rows: DataFrame, keys: list[str], *aggs, where: str = "true") -> DataFrame:
    """``rows`` (with a ``node``) and the aggregates of their group by ``keys``.

    The aggregates are joined by key and salt, for the salts that occur in the group: never more rows
    than the group has, and a hot group is met in ``SALTS`` tasks.
    """
    rows = rows.withColumn("salt_", F.pmod(F.xxhash64("node", F.lit(3)), F.lit(SALTS)).cast("int"))
    groups = rows.groupBy(*keys).agg(F.bit_or(salt_bit("salt_")).alias("salts_"), *aggs).where(where)
    return rows.join(groups.withColumn("salt_", each_salt("salts_")).drop("salts_"), [*keys, "salt_"]).drop("salt_")


def salt_bit(salt: str) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.col(salt))


def each_salt(bits: str) -> Column:
    return F.explode(F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda s: F.getbit(bits, s) == 1))


def _partners(shared: DataFrame) -> DataFrame:
    """``node, hub``: each node's most central partner.

    The slots of a text from which others were edited agree with most of them, so its buckets are the
    large ones.  Centrality is the sum of a node's bucket sizes.
    """
    central = shared.groupBy("node").agg(F.sum("n").alias("score"))
    scored = written(shared.drop("n").join(central, "node"), "super-scored")
    hubs = with_group(scored, ["band", "key"], F.max(F.struct("score", "node")).alias("hub"))
    return hubs.groupBy("node").agg(F.max("hub").getField("node").alias("hub")).where("hub != node")


def _first_links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Links ``a, b`` among ``pairs (node, hub)``: the hub's set is built once a task, its partners stream by."""
    salt = F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("long")
    partners = pairs.select(F.xxhash64("hub").alias("key"), salt.alias("salt"), "hub", "node")
    hubs = partners.select("key", "salt", "hub").distinct().select("key", "salt", "hub", F.col("hub").alias("node"))
    rows = hubs.withColumn("ord", F.lit(0)).unionByName(partners.withColumn("ord", F.lit(1))).join(texts, "node")

    def verify(batches):
        hub, held = None, set()
        for batch in batches:
            a, b = [], []
            for h, node, order, text in zip(*(batch.column(c) for c in ("hub", "node", "ord", "text"))):
                if order.as_py() == 0:
                    hub, held = h.as_py(), shingles(text.as_py())
                elif linked(held, shingles(text.as_py())):
                    a.append(node.as_py())
                    b.append(hub)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    # a hub comes before its partners
    return rows.repartition("key", "salt").sortWithinPartitions("key", "salt", "hub", "ord").mapInArrow(verify, "a binary, b binary")


GROUP = ("band", "key", "lo", "hi")


def _bucket_members(shared: DataFrame, signs: DataFrame, comps: DataFrame) -> DataFrame:
    """Members of the buckets that span components, for each pair of blocks they are compared in.

    Blocks hold nodes of one component where it has enough of them, so that a large component is met
    by the bucket's other nodes and not by itself.
    """
    held = shared.select("node", "band", "key").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    marks = [F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")]
    held = with_group(held, ["band", "key"], F.count(F.lit(1)).alias("n"), F.min("comp").alias("c"), F.max("comp").alias("d"), *marks, where="c != d")
    # buckets of the same members are the same work: the first band does it
    held = held.drop("c", "d").withColumn("bucket", F.struct("band", "key"))
    firsts = held.groupBy("n", "x", "y").agg(F.min("bucket").alias("first"))
    firsts = written(firsts.select("first.band", "first.key"), "super-buckets")
    held = with_group(held.drop("bucket").join(firsts, ["band", "key"], "left_semi"), ["band", "key", "comp"], F.count(F.lit(1)).alias("n_comp"))
    deal = lambda n: F.pmod(F.xxhash64("node", F.lit(2)), F.ceil(n / BLOCK))
    block = F.when(F.col("n_comp") >= BLOCK, F.xxhash64("comp", deal(F.col("n_comp")))).otherwise(deal(F.col("n")))
    held = written(held.select(F.col("band").cast("long").alias("band"), "key", "node", "comp", block.alias("block")), "super-members")
    blocks = held.groupBy("band", "key", "block").agg(F.min("comp").alias("c"), F.max("comp").alias("d"))
    one, two = (blocks.select("band", "key", F.col("block").alias(b), F.col("c").alias(f"c_{b}"), F.col("d").alias(f"d_{b}")) for b in ("lo", "hi"))
    spans = F.least("c_lo", "c_hi") != F.greatest("d_lo", "d_hi")
    pairs = one.join(two, ["band", "key"]).where((F.col("lo") <= F.col("hi")) & spans).select(*GROUP)
    sides = pairs.withColumn("block", F.explode(F.array_distinct(F.array("lo", "hi"))))
    return held.join(sides, ["band", "key", "block"]).join(signs.select("node", "bands", "sig"), "node").select(*GROUP, "node", "comp", "block", "bands", "sig")


def _candidates(members: DataFrame) -> DataFrame:
    """Per pair of blocks: its nodes and the index pairs across components, most agreement first."""
    least = least_agreement()

    def compare(batches):
        for key, t in by_group(batches):
            band, _, lo, hi = key
            bands = t["bands"].combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
            sig = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint32).reshape(-1, SLOTS)
            block, codes = t["block"].to_numpy(), {}
            comp = np.array([codes.setdefault(c, len(codes)) for c in t["comp"].to_pylist()])
            one, two = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
            left, right, agree = [], [], []
            for k, i in enumerate(one.tolist()):
                others = two[k + 1 :] if lo == hi else two
                others = others[comp[others] != comp[i]]
                others = others[~(bands[others, :band] == bands[i, :band]).any(axis=1)]  # a pair belongs to its first band
                same = (sig[others] == sig[i]).sum(axis=1)
                near = same >= least
                right.append(others[near])
                left.append(np.full(int(near.sum()), i))
                agree.append(same[near])
            left, right, agree = (np.concatenate(x) for x in (left, right, agree))
            if len(left):
                order = np.argsort(-agree, kind="stable")
                used, packed = np.unique(np.concatenate([left[order], right[order]]), return_inverse=True)
                columns = [pa.array([k], pa.int64()) for k in key]
                held = [pa.array([t[c].take(pa.array(used)).to_pylist()], pa.list_(pa.binary())) for c in ("node", "comp")]
                yield pa.RecordBatch.from_arrays([*columns, *held, pa.array([packed.astype(np.int32).tobytes()], pa.binary())], [*GROUP, "nodes", "comps", "pairs"])

    grouped = members.repartition(*GROUP).sortWithinPartitions(*GROUP)
    return grouped.mapInArrow(compare, "band long, key long, lo long, hi long, nodes array<binary>, comps array<binary>, pairs binary")


class HeldSets:
    """Sets of shingles of a few texts at a time, bounded by their number of shingles."""

    def __init__(self, texts: list[bytes], limit: int = 400_000):
        self.texts, self.limit, self.sets, self.size = texts, limit, {}, 0

    def __getitem__(self, i: int) -> set:
        if i not in self.sets:
            new = shingles(self.texts[i])
            if self.size + len(new) > self.limit:
                self.sets, self.size = {}, 0
            self.sets[i], self.size = new, self.size + len(new)
        return self.sets[i]


def _second_links(candidates: DataFrame, texts: DataFrame) -> DataFrame:
    """One link ``a, b`` per union of components within a pair of blocks."""
    ends = candidates.select(*GROUP, F.posexplode(F.arrays_zip("nodes", "comps")).alias("ord", "end"))
    ends = ends.select(*GROUP, "ord", F.col("end.nodes").alias("node"), F.col("end.comps").alias("comp")).join(texts, "node")
    none = F.lit(None).cast("binary")
    rows = ends.select(*GROUP, "ord", "node", "comp", F.col("text").alias("data")).unionByName(
        candidates.select(*GROUP, F.lit(-1).alias("ord"), none.alias("node"), none.alias("comp"), F.col("pairs").alias("data"))
    )

    def verify(batches):
        for _, t in by_group(batches):
            data, node, comp = (t[c].to_pylist() for c in ("data", "node", "comp"))
            sets, joined, a, b = HeldSets(data[1:]), UnionFind(), [], []
            for i, j in np.frombuffer(data[0], np.int32).reshape(2, -1).T.tolist():
                if joined.find(comp[i + 1]) != joined.find(comp[j + 1]) and linked(sets[i], sets[j]):
                    joined.union(comp[i + 1], comp[j + 1])
                    a.append(node[i + 1])
                    b.append(node[j + 1])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    return rows.repartition(*GROUP).sortWithinPartitions(*GROUP, "ord").mapInArrow(verify, "a binary, b binary")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(f"`{text_col}`")
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_digest(text).alias("node"), F.coalesce(text, F.lit("")).cast("binary").alias("text"))


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(rows, nodes)``: ``id, node, salt, n_shingles`` of every document, and per different text
    ``node, id, salts, comp, chief`` (its smallest id, the salts of its rows, its component and the smallest id of that)."""
    rows = _rows(docs, id_col, text_col)
    signed = written(_signed(rows.withColumn("salt", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(SALTS)).cast("int"))), "super-signed")
    nodes = signed.groupBy("node").agg(F.min("id").alias("id"), F.bit_or(salt_bit("salt")).alias("salts"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    nodes = written(nodes, "super-nodes")
    signs = nodes.where(F.col("bands").isNotNull())
    in_bands = signs.select("node", F.posexplode("bands").alias("band", "key"))
    shared = written(with_group(in_bands, ["band", "key"], F.count(F.lit(1)).alias("n"), where="n > 1"), "super-shared")
    met = shared.select("node").distinct().join(nodes.select("node", "id"), "node").select(F.col("node").alias("met"), F.col("id").alias("met_id"))
    chosen = rows.join(met, (F.col("node") == F.col("met")) & F.col("id").eqNullSafe(F.col("met_id")))
    texts = written(chosen.groupBy("node").agg(F.first("text").alias("text")), "super-texts")
    first = written(_first_links(written(_partners(shared), "super-partners"), texts), "super-first-links")
    comps = written(components(first).select("node", F.col("root").alias("comp")), "super-first-components")
    candidates = written(_candidates(_bucket_members(shared, signs, comps)), "super-candidates")
    second = written(_second_links(candidates, texts), "super-second-links")
    comps = components(first.unionAll(second)).select("node", F.col("root").alias("comp"))
    classes = written(nodes.select("node", "id", "salts").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "super-classes")
    return signed.select("id", "node", "salt", "n_shingles"), with_group(classes, ["comp"], F.min("id").alias("chief"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``doc_id, n_shingles, component_id, kept``."""
    rows, nodes = grouped(docs, id_col, text_col)
    # one row per text and salt of its copies: a text of very many copies is met in many tasks
    spread = nodes.select("node", "chief", each_salt("salts").alias("salt"))
    component = F.when(F.col("n_shingles") == 0, F.col("id")).otherwise(F.col("chief"))
    return rows.join(spread, ["node", "salt"]).select(F.col("id").alias("doc_id"), "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))



ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
k AS (SELECT array_to_string(w, ' ') AS t, any_value(w) AS w, min(doc_id) AS r FROM w WHERE len(w) > 0 GROUP BY t),
s AS (
  SELECT DISTINCT r, array_to_string(w[p : p + least(len(w), 5) - 1], ' ') AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS p FROM k)),
c AS (SELECT r, count(*) AS n FROM s GROUP BY r),
x AS (SELECT a.r AS a, b.r AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY ALL),
l AS (SELECT a, b FROM x JOIN c p ON p.r = a JOIN c q ON q.r = b WHERE 100 * i >= 85 * (p.n + q.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
v(r, m) AS (SELECT r, r FROM k UNION SELECT e.b, v.m FROM v JOIN e ON e.a = v.r WHERE v.m < e.b),
z AS (SELECT r, min(m) AS m FROM v GROUP BY r)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(m, doc_id) AS component_id, doc_id = coalesce(m, doc_id) AS kept
FROM w LEFT JOIN k ON k.t = array_to_string(w.w, ' ') AND len(w.w) > 0 LEFT JOIN c USING (r) LEFT JOIN z USING (r)
"""
