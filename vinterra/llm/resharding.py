"""Resharding by minimum-cost flow: move the fewest bytes from old shards to new capacities.

1. Every row belongs to an old shard and, by a hash of its id and text, to one of
   ``blocks_per_shard`` blocks of it.  One aggregation gives bytes and rows per block.
2. The block table (old shards x blocks, both parameters, so bounded) goes to the driver.  A
   minimum-cost flow from old shard sizes to new capacities, where a byte that stays in the
   shard of the same number costs 0 and one that moves costs 1, gives the bytes to send from
   each old shard to each new one.  Blocks, the largest first, fill these amounts.
3. The bounded plan (block -> new shard) is broadcast to the rows.  Only shards that gain or lose a
   block are written again; the rest keep their files.

The rows of a shard are dealt by a second hash of id and text to file groups of about ``file_bytes``,
however large the shard is.  Slots of a shard follow the file group, then id and text; or, if an order
is given, that order.  Both are counted: rows per (shard, group or stretch of the order), their running
sum, and a row number inside each.

Law ``bytes``: capacities are equal in bytes, and shards differ from them by about a block.

Defined results: a null text has size 1; a null id or shard key is a value like any other;
repeated rows each get a slot of their own (rows equal in id and text stay in one block and one file
group, which are then larger by them); an empty table gives an empty layout; other columns are carried
inside the ``doc`` struct, so their names cannot clash.
"""

from __future__ import annotations

import math
from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vinterra.llm.common import scratch_path, written

FILE_BYTES = 32 << 20
BLOCKS_PER_SHARD = 1024


def row_bytes(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus one."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(1)


def text_crc32(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def min_cost_flow(supply: list[int], capacity: list[int], cost) -> list[list[int]]:
    """Cheapest shipment of all supplies within the capacities (successive shortest paths).

    ``cost(i, j)`` is the price of one unit from supply ``i`` to capacity ``j``.
    """
    n, m = len(supply), len(capacity)
    if sum(supply) > sum(capacity):
        raise ValueError("the new capacities hold less than the old shards")
    source, sink = n + m, n + m + 1
    graph: list[list[int]] = [[] for _ in range(n + m + 2)]
    head: list[int] = []
    room: list[int] = []
    price: list[int] = []

    def edge(a: int, b: int, units: int, each: int) -> None:
        for u, v, r, p in ((a, b, units, each), (b, a, 0, -each)):
            graph[u].append(len(head))
            head.append(v)
            room.append(r)
            price.append(p)

    for i, s in enumerate(supply):
        edge(source, i, s, 0)
    first = len(head)
    for i in range(n):
        for j in range(m):
            edge(i, n + j, supply[i], cost(i, j))
    for j, c in enumerate(capacity):
        edge(n + j, sink, c, 0)
    left = sum(supply)
    while left:
        dist = [math.inf] * len(graph)
        came = [-1] * len(graph)
        dist[source] = 0
        queue, queued = deque([source]), {source}
        while queue:
            u = queue.popleft()
            queued.discard(u)
            for e in graph[u]:
                if room[e] and dist[u] + price[e] < dist[head[e]]:
                    dist[head[e]], came[head[e]] = dist[u] + price[e], e
                    if head[e] not in queued:
                        queued.add(head[e])
                        queue.append(head[e])
        units, v = left, sink
        while v != source:
            units, v = min(units, room[came[v]]), head[came[v] ^ 1]
        v = sink
        while v != source:
            room[came[v]] -= units
            room[came[v] ^ 1] += units
            v = head[came[v] ^ 1]
        left -= units
    return [[room[first + 2 * (i * m + j) + 1] for j in range(m)] for i in range(n)]


def equal_capacities(total: int, n_new: int) -> list[int]:
    return [total // n_new + (j < total % n_new) for j in range(n_new)]


def plan_transfers(blocks: list[tuple[int, int, int]], n_new: int, capacity: list[int] | None = None) -> dict[tuple[int, int], int]:
    """``(old shard, block, bytes)`` -> new shard of each block, moving the fewest bytes."""
    old = sorted({b[0] for b in blocks})
    by_old = {o: sorted((b for b in blocks if b[0] == o), key=lambda b: (-b[2], b[1])) for o in old}
    supply = [sum(b[2] for b in by_old[o]) for o in old]
    flow = min_cost_flow(supply, capacity or equal_capacities(sum(supply), n_new), lambda i, j: int(old[i] != j))
    out: dict[tuple[int, int], int] = {}
    carry = [0] * n_new  # what rounding to blocks has left open per new shard
    for i in sorted(range(len(old)), key=lambda i: -supply[i]):
        need = [flow[i][j] + carry[j] if flow[i][j] else None for j in range(n_new)]
        open_to = [j for j in range(n_new) if need[j] is not None]
        for o, b, size in by_old[old[i]]:
            j = max(open_to, key=lambda j: (need[j], old[i] == j, -j))
            out[o, b] = j
            need[j] -= size
        for j in open_to:
            carry[j] = need[j]
    return out


def reshard(
    docs: DataFrame,
    old_shard: Column,
    n_old: int,
    n_new: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str | None = None,
    capacity: list[int] | None = None,
    blocks_per_shard: int = BLOCKS_PER_SHARD,
    file_bytes: int = FILE_BYTES,
    order: tuple[Column, Column] | None = None,
) -> DataFrame:
    """Rewrite the affected shards as ``shard=N/`` folders of Parquet files and read the layout back.

    ``old_shard`` gives 0 .. ``n_old`` - 1.  Columns: ``doc`` (struct of all columns), ``shard``,
    ``slot``, ``old_shard``, ``moved``.  Shards that neither gain nor lose a block are not
    written: their rows come from ``docs``.

    ``order``: a stretch (equal for some thousand neighbouring rows, never null) and the place inside
    it; the slots of every shard, and the rows of its files, then follow this order.
    """
    spark = docs.sparkSession
    ordered = [c.alias(n) for c, n in zip(order or (), ("stretch", "place"))]
    base = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
        F.pmod(old_shard, F.lit(n_old)).cast("int").alias("old_shard"),
        F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(blocks_per_shard)).cast("int").alias("block"),
        row_bytes(F.col(text_col)).alias("row_bytes"),
        *ordered,
    )
    sizes = base.groupBy("old_shard", "block").agg(F.sum("row_bytes").alias("b")).collect()
    to = plan_transfers([(r.old_shard, r.block, r.b) for r in sizes], n_new, capacity)
    touched = {s for (o, _), j in to.items() if j != o for s in (o, j)}
    groups = max(1, math.ceil(sum(r.b for r in sizes) / n_new / file_bytes))
    plan = [(o, b, j) for (o, b), j in sorted(to.items())]

    def planned(rows: list[tuple]) -> DataFrame:
        return F.broadcast(spark.createDataFrame(rows, "old_shard int, block int, shard int"))

    if not order:
        group = F.pmod(F.xxhash64(F.lit("file group"), F.col(f"doc.`{id_col}`"), F.col(f"doc.`{text_col}`")), F.lit(groups))
        base = base.withColumn("stretch", group)
    counts = base.select("old_shard", "block", "stretch").join(planned(plan), ["old_shard", "block"])
    counts = counts.groupBy("shard", "stretch").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("n").over(before), F.lit(0))
    if not order:
        files = written(counts.select("shard", "stretch", first.alias("start")), "shard-files")
    else:
        of_shard = F.sum("n").over(Window.partitionBy("shard"))
        stretches = written(
            counts.select("shard", "stretch", first.alias("start"), F.floor(first * groups / of_shard).cast("int").alias("part")), "shard-stretches"
        )

    def placed_in_order(rows: list[tuple]) -> DataFrame:
        # a shuffle by (shard, part of its slots); the window sorts the rows of each file by slot
        w = Window.partitionBy("shard", "part", "stretch").orderBy("place")
        spots = base.join(planned(rows), ["old_shard", "block"]).join(stretches, ["shard", "stretch"])
        return spots.repartition("shard", "part").select(
            "doc",
            "shard",
            (F.col("start") + F.row_number().over(w) - 1).cast("long").alias("slot"),
            "old_shard",
            (F.col("shard") != F.col("old_shard")).alias("moved"),
        )

    def placed(rows: list[tuple]) -> DataFrame:
        if order:
            return placed_in_order(rows)
        # a shuffle by (shard, file group) lays out the files; the join and the window reuse it
        w = Window.partitionBy("shard", "stretch").orderBy(F.col(f"doc.`{id_col}`"), text_crc32(F.col(f"doc.`{text_col}`")))
        dealt = base.join(planned(rows), ["old_shard", "block"]).repartition("shard", "stretch")
        return dealt.join(files, ["shard", "stretch"]).select(
            "doc",
            "shard",
            (F.col("start") + F.row_number().over(w) - 1).cast("long").alias("slot"),
            "old_shard",
            (F.col("shard") != F.col("old_shard")).alias("moved"),
        )

    changed = placed([r for r in plan if r[2] in touched])
    path = path or scratch_path(spark, "shards")
    changed.write.partitionBy("shard").parquet(path)
    out = spark.read.schema(changed.schema).parquet(path).select(*changed.columns)
    kept = [r for r in plan if r[2] not in touched]
    return out.unionByName(placed(kept)) if kept else out


def layout_digest(layout: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document, from the shards as they were written."""
    text = F.col(f"doc.`{text_col}`")
    return layout.select(
        F.col(f"doc.`{id_col}`").alias("doc_id"),
        row_bytes(text).alias("size"),
        text_crc32(text).cast("long").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "old_shard",
        "moved",
    )
