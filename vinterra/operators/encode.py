"""Exact consecutive indexes and category codes without a single-partition window.

``row_number()`` over a window without ``partitionBy`` moves every row into
one task.  ``consecutive_index`` gives the same 0-based index distributed:

1. range-partition and sort by the order keys, checkpoint (fixes partition
   boundaries and row order even if an executor is lost later);
2. ``monotonically_increasing_id`` then encodes (partition id, position in
   partition) -- both exact after the checkpoint;
3. per-partition counts (one row per partition) give prefix offsets, joined
   back by partition id.  Only that tiny table is broadcast; its size is the
   number of partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vinterra.session import as_table, cut_lineage

_PID_SHIFT = 33  # monotonically_increasing_id = partition_id << 33 | row position


def consecutive_index(df: DataFrame, order: Sequence[str | Column], idx_col: str = "_idx") -> DataFrame:
    """Append a 0-based index following ``order`` (ties broken by the order of
    the remaining sort keys you pass -- pass a unique key last for determinism)."""
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = cut_lineage(df.repartitionByRange(*order_cols).sortWithinPartitions(*order_cols))
    mid = F.monotonically_increasing_id()
    tagged = ranged.withColumn("_mid", mid).withColumns(
        {"_pid": F.shiftright(F.col("_mid"), _PID_SHIFT)}
    ).withColumn("_local", F.col("_mid") - F.shiftleft(F.col("_pid"), _PID_SHIFT))
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_pid",
        (F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_off"),
    )
    out = tagged.join(F.broadcast(offsets), "_pid")
    return out.withColumn(idx_col, F.col("_off") + F.col("_local")).drop("_mid", "_pid", "_local", "_off")


def dense_codes(values: DataFrame, order: Sequence[str], value_col: str = "value", code_col: str = "code") -> DataFrame:
    """Codes 0..k-1 over the distinct non-null ``value_col`` ordered by ``order``
    (binary string order = Python code-point order)."""
    distinct = values.where(F.col(value_col).isNotNull()).select(*dict.fromkeys([value_col, *order])).distinct()
    idx = consecutive_index(distinct, [*order, value_col], code_col)
    return idx.select(value_col, code_col)


def grouped_codes(
    values: DataFrame, group_col: str, value_col: str, order: Sequence[str] | None = None, code_col: str = "code"
) -> DataFrame:
    """Codes restarting at 0 inside every group (e.g. one vocabulary per column),
    still without partitioning a window by the (possibly huge) group."""
    order = list(order or [value_col])
    distinct = values.where(F.col(value_col).isNotNull()).select(*dict.fromkeys([group_col, value_col, *order])).distinct()
    idx = consecutive_index(distinct, [group_col, *order, value_col], "_g_idx")
    # one row per group; its measured size decides how the few starts reach the many values
    starts = as_table(idx.groupBy(group_col).agg(F.min("_g_idx").alias("_g_start")), "group-starts")
    return idx.join(starts, group_col).select(
        group_col, value_col, (F.col("_g_idx") - F.col("_g_start")).alias(code_col)
    )
