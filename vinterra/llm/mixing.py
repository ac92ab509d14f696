"""Mixing sources to target weights by Pfair scheduling.

The rows of a source are cut into blocks.  Block ``i`` (from 0) of a source with weight ``w`` has
release time ``floor(i / w)`` and deadline ``ceil((i + 1) / w)`` in slots; in each slot the
released block with the earliest deadline runs.  At every slot each source is then less than one
block away from its share.

Weights are taken as the exact fractions that the given numbers are, so no source drifts from its
target however long the schedule is.  The driver holds the weights and one waiting block per source
and writes the slots of all blocks, in pieces, as a table that the rows are joined to.  It takes a step
per block, and one per source left whenever a source runs out.  When a source runs out, a new phase begins with the remaining weights in proportion; sources of weight 0 come
after all others; nothing is dropped or repeated.

With a ``resolution``, weights are first rounded to multiples of ``1 / resolution`` (``quantised``);
``period_slots`` and ``phases`` give the repeating schedule of such weights.

Ranks inside a source come from hash buckets: a count per (source, bucket), their running sum, and
a row number inside each bucket, so a source with a third of all rows is spread over all tasks.

Defined results: null is a source like any other; rows equal in id and source are interchangeable
and take neighbouring places; an empty table gives an empty schedule; extra columns are carried in
the ``doc`` struct by ``interleave`` and left out by ``schedule``.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vinterra.llm.common import scratch_path

BLOCK_ROWS = 64
RESOLUTION = 1000
RANK_BUCKETS = 1024
#: Blocks of the schedule that the driver holds at a time.
PIECE_BLOCKS = 100_000
#: Rows of a file that ``stored_order`` counts together.
STRETCH_ROWS = 4096


def quantised(weights: dict[str, float], resolution: int = RESOLUTION) -> dict[str, int]:
    """Weights as positive whole numbers that add up to ``resolution`` (largest remainders)."""
    total = sum(weights.values())
    spare = resolution - len(weights)
    if spare < 0:
        raise ValueError(f"{len(weights)} sources need a resolution of at least as much")
    exact = {s: spare * w / total for s, w in weights.items()}
    out = {s: 1 + int(x) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s))[: resolution - sum(out.values())]:
        out[s] += 1
    return out


def period_slots(q: dict[str, int]) -> list[str]:
    """Source of each slot of one period: earliest deadline first among released blocks."""
    n = sum(q.values())
    waiting = [(0, s, 0) for s in q]  # (release, source, block)
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    out = []
    for t in range(n):
        while waiting and waiting[0][0] <= t:
            _, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-((i + 1) * n // -q[s]), s, i))
        _, s, i = heapq.heappop(ready)
        out.append(s)
        if i + 1 < q[s]:
            heapq.heappush(waiting, ((i + 1) * n // q[s], s, i + 1))
    return out


def phases(blocks: dict[str, int], weights: dict[str, float], resolution: int = RESOLUTION) -> list[tuple]:
    """Rows ``(source, phase, first block, blocks, q, period, first slot, slots in the period)``.

    A phase lasts until one of its sources has no block left.
    """
    left = {s: n for s, n in blocks.items() if n}
    done = dict.fromkeys(left, 0)
    slot, rows, phase = 0, [], 0
    while left:
        n = max(resolution, 2 * len(left))
        q = quantised({s: weights[s] for s in left}, n)
        order = period_slots(q)
        at: dict[str, list[int]] = {s: [] for s in left}
        for t, s in enumerate(order):
            at[s].append(t)
        full = min(left[s] // q[s] for s in left)
        rest = {s: left[s] - full * q[s] for s in left}
        cut = 0 if min(rest.values()) == 0 else min(at[s][r - 1] + 1 for s, r in rest.items() if r <= q[s])
        length = full * n + cut
        for s in sorted(left):
            used = full * q[s] + sum(t < cut for t in at[s])
            if used:
                rows.append((s, phase, done[s], used, q[s], n, slot, at[s]))
            done[s] += used
            left[s] -= used
        left = {s: k for s, k in left.items() if k}
        slot += length
        phase += 1
    return rows


def stream_key(source: Column) -> Column:
    """Name of the stream of a source; never null."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))


def _ranked(base: DataFrame, buckets: int) -> DataFrame:
    """``base`` (stream, bucket, id, tie, ...) with its 0-based ``rank`` in the stream."""
    w = Window.partitionBy("stream", "bucket")
    counts = base.groupBy("stream", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("stream").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("stream", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    numbered = base.withColumn("rn", F.row_number().over(w.orderBy("id", "tie")))
    return numbered.join(starts, ["stream", "bucket"]).withColumn("rank", F.col("start") + F.col("rn") - 1).drop("rn", "start")


def whole_weights(weights: dict[str, float]) -> dict[str, int]:
    """Whole numbers in exactly the proportion of ``weights``."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    unit = math.lcm(*(x.denominator for x in exact.values()))
    out = {s: int(x * unit) for s, x in exact.items()}
    common = math.gcd(*out.values())
    return {s: w // common for s, w in out.items()}


def block_slots(blocks: dict[str, int], weights: dict[str, float]) -> Iterator[tuple]:
    """Rows ``(source, phase, block, weight, release, deadline, slot)`` of every block, in slot order.

    A phase lasts until one of its sources has no block left.
    """
    if any(not 0 <= weights[s] < math.inf for s, n in blocks.items() if n):
        raise ValueError("weights must be finite and not negative")
    left = {s: n for s, n in blocks.items() if n}
    done = dict.fromkeys(left, 0)
    begin = phase = 0
    # whole numbers once for all phases: only their proportions count
    q = whole_weights({s: weights[s] for s in left if weights[s]} or dict.fromkeys(left, 1)) if left else {}
    while left:
        if not q:  # sources of weight 0 are left
            q = dict.fromkeys(left, 1)
        n = sum(q.values())
        waiting: list[tuple[int, str, int]] = []  # (release, source, block of the phase)
        ready = [(-(n // -k), s, 0, 0) for s, k in q.items()]  # every first block is released at 0
        heapq.heapify(ready)
        t, last = 0, False
        while not last:
            while waiting and waiting[0][0] <= t:
                release, s, i = heapq.heappop(waiting)
                heapq.heappush(ready, (-((i + 1) * n // -q[s]), s, i, release))
            deadline, s, i, release = heapq.heappop(ready)
            yield s, phase, done[s], q[s] / n, begin + release, begin + deadline, begin + t
            done[s] += 1
            left[s] -= 1
            last = not left[s]
            heapq.heappush(waiting, ((i + 1) * n // q[s], s, i + 1))
            t += 1
        del left[s]  # one source runs out at a time
        del q[s]
        begin += t
        phase += 1


def _written_blocks(spark: SparkSession, rows: Iterator[tuple]) -> DataFrame:
    """The rows of ``block_slots`` as a table in the shared folder, written in pieces of bounded size."""
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
    schema = pa.schema(list(zip(("stream", "phase", "block", "weight", "release", "deadline", "slot"), kinds)))
    path = scratch_path(spark, "mix-blocks")
    more = True
    while more:
        piece = list(islice(rows, PIECE_BLOCKS))
        columns = zip(*piece) if piece else [[]] * len(kinds)
        table = pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], schema=schema)
        out = spark.createDataFrame(table)
        out.coalesce(1).write.mode("append").parquet(path)
        more = len(piece) == PIECE_BLOCKS
    return spark.read.schema(out.schema).parquet(path)


def _scheduled(base: DataFrame, weights, block_rows: int, resolution: int | None, buckets: int) -> DataFrame:
    spark = base.sparkSession
    streams = base.groupBy("stream").agg(F.count(F.lit(1)).alias("n")).collect()  # a mixture names its sources
    rows = {r.stream: r.n for r in streams}
    wanted = weights(rows) if callable(weights) else {s: weights[None if s == "null" else s[1:]] for s in rows}
    if resolution and wanted:
        wanted = quantised(wanted, resolution)
    slots = _written_blocks(spark, block_slots({s: -(-n // block_rows) for s, n in rows.items()}, wanted))
    ranked = _ranked(base, buckets).withColumn("block", F.floor(F.col("rank") / block_rows).cast("long"))
    # one row per block: the planner broadcasts it or shuffles both sides, by its written size
    return ranked.join(slots, ["stream", "block"]).select(
        *ranked.columns, "weight", "phase", "release", "deadline", "slot"
    ).withColumn("in_block", (F.col("rank") - F.col("block") * block_rows).cast("int"))


def root_weights(rows: dict[str, int]) -> dict[str, float]:
    """Weights by the square root of the row counts: large sources count less than their size."""
    return {s: math.sqrt(n) for s, n in rows.items()}


def schedule(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    weights=root_weights,
    block_rows: int = BLOCK_ROWS,
    resolution: int | None = None,
    buckets: int = RANK_BUCKETS,
) -> DataFrame:
    """One row per document: ``doc_id, source, weight, phase, block, release, deadline, slot, in_block``.

    ``weights``: a dict from source to weight, or a function from the streams' row counts to weights.
    They are kept exactly unless a ``resolution`` to round them to is given.
    The training order is by ``(slot, in_block)``.
    """
    base = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        stream_key(F.col(source_col)).alias("stream"),
        F.pmod(F.xxhash64(F.col(id_col)), F.lit(buckets)).alias("bucket"),
        F.lit(0).alias("tie"),
    )
    out = _scheduled(base, weights, block_rows, resolution, buckets)
    return out.select(
        F.col("id").alias("doc_id"), "source", "weight", "phase", "block", "release", "deadline", "slot", "in_block"
    )


def interleave(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    weights=root_weights,
    block_rows: int = BLOCK_ROWS,
    resolution: int | None = None,
    buckets: int = RANK_BUCKETS,
) -> DataFrame:
    """``docs`` with its own columns in training order (range-sorted by slot)."""
    every = [F.col(f"`{c}`") for c in docs.columns]
    base = docs.select(
        F.col(id_col).alias("id"),
        stream_key(F.col(source_col)).alias("stream"),
        F.pmod(F.xxhash64(F.col(id_col)), F.lit(buckets)).alias("bucket"),
        F.xxhash64(*every).alias("tie"),
        F.struct(*every).alias("doc"),
    )
    out = _scheduled(base, weights, block_rows, resolution, buckets)
    return out.orderBy("slot", "in_block").select("doc.*")


def stored_order() -> tuple[Column, Column]:
    """``(stretch, place)`` of a row in the files that a sorted table was written to.

    Spark numbers the files of a write by task (``part-N``) and, within a task, by ``-cN``; a scan packs
    files by size, so the order has to come from these names and the row numbers.  Only for
    DataFrames that read such files.
    """
    name, row = F.col("_metadata.file_name"), F.col("_metadata.row_index")
    number = lambda pattern: F.lpad(F.regexp_extract(name, pattern, 1), 12, "0")
    file = F.when(name.rlike(r"^part-\d+"), F.concat(number(r"^part-(\d+)"), number(r"-c(\d+)\."))).otherwise(name)
    run = F.floor(row / STRETCH_ROWS).cast("string")
    return F.concat_ws("/", file, F.lpad(run, 12, "0")), row
