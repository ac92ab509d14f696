"""Crawl concatenation, dedupe, sort, value counts, top share, histogram
(U1, W1-W3, A7, A8, A11).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vinterra.session import cut_lineage


def concat_intervals(df: DataFrame, intervals: Sequence[tuple[float, float]], price: str = "price") -> DataFrame:
    """One copy of a row per (overlapping) price interval containing it,
    tagged with ``interval_id`` -- a generator instead of a union of N scans."""
    arr = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi"))
                    for i, (lo, hi) in enumerate(intervals)])
    hit = F.filter(arr, lambda s: (F.col(price) >= s["lo"]) & (F.col(price) <= s["hi"]))
    return df.withColumn("interval_id", F.explode(F.transform(hit, lambda s: s["id"])))


def keep_first(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key in ``order`` (NULL keys compare equal).

    Rows are numbered once (a checkpoint fixes the numbers); the smallest
    ``(order, number)`` per key is a partial aggregate over the key and order
    columns alone, so a key holding a third of the rows is reduced inside each
    map task, and the other columns -- of any type, VARIANT too -- only meet the
    surviving numbers in a semi-join.
    """
    numbered = cut_lineage(df).withColumn("_row", F.monotonically_increasing_id())
    best = numbered.groupBy(*key).agg(F.min(F.struct(*order, "_row")).alias("_best")).select("_best._row")
    return numbered.join(best, "_row", "left_semi").drop("_row")


def sort_by_price(df: DataFrame, price: str = "price", ties: Sequence[str] = ()) -> DataFrame:
    """Ascending price, missing prices last; explicit tie keys make it stable."""
    return df.orderBy(F.col(price).asc_nulls_last(), *[F.col(c).asc() for c in ties])


def value_counts(df: DataFrame, col: str, sort: str = "key") -> DataFrame:
    """Non-null counts per value, sorted by value (``key``) or count desc."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    if sort == "key":
        return counts.orderBy(col)
    return counts.orderBy(F.col("n").desc(), F.col(col))


def running_sums(df: DataFrame, order: Sequence[Column], sums: dict[str, str]) -> DataFrame:
    """Exact cumulative sums ``{value column: output column}`` in one global order without a
    single-partition window: range partitions (sorted and checkpointed once) get per-partition
    totals and prefix offsets from a table with one row per partition."""
    ranged = cut_lineage(df.repartitionByRange(*order).withColumn("_pid", F.spark_partition_id()))
    w = Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumns({f"_local_{o}": F.sum(v).over(w) for v, o in sums.items()})
    totals = ranged.groupBy("_pid").agg(*[F.sum(v).alias(f"_tot_{o}") for v, o in sums.items()])
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_pid", *[F.coalesce(F.sum(f"_tot_{o}").over(before), F.lit(0)).alias(f"_off_{o}") for o in sums.values()])
    out = local.join(F.broadcast(offsets), "_pid")  # one row per partition
    out = out.withColumns({o: F.col(f"_off_{o}") + F.col(f"_local_{o}") for o in sums.values()})
    return out.drop("_pid", *[f"{x}_{o}" for o in sums.values() for x in ("_local", "_off")])


def running_sum(df: DataFrame, order: Sequence[Column], value: str, out: str = "running") -> DataFrame:
    """One cumulative sum, see ``running_sums``."""
    return running_sums(df, order, {value: out})


def top_share(df: DataFrame, col: str, share: float = 0.9) -> DataFrame:
    """Values by count desc (ties by value) whose cumulative share of rows
    stays <= ``share``; the value crossing the threshold is excluded.  The
    total is a scalar subquery (one value), not a join."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    total = counts.select(F.sum("n")).scalar()
    run = running_sum(counts, [F.col("n").desc(), F.col(col).asc()], "n", "cum_n")
    return run.select(col, "n", "cum_n", (F.col("cum_n") / total).alias("cum_share")).where(
        F.col("cum_share") <= F.lit(share)
    )


def histogram(df: DataFrame, col: str, bins: int = 50) -> DataFrame:
    """``bins`` equal-width bins between min and max (last bin closed),
    zero-filled.  Min and max come from one scalar subquery."""
    # both passes (range, then counts) read one materialised column instead of
    # recomputing the input's lineage twice
    vals = cut_lineage(df.where(F.col(col).isNotNull() & ~F.isnan(col)).select(F.col(col).cast("double").alias("_x")))
    stats = vals.select(F.struct(F.min("_x").alias("lo"), F.max("_x").alias("hi"))).scalar()  # one pass, reused
    lo, hi = stats["lo"], stats["hi"]
    width = hi - lo
    idx = F.when(width > 0, F.least(F.floor((F.col("_x") - lo) / width * F.lit(bins)), F.lit(bins - 1))).otherwise(
        F.lit(0)
    )
    counted = vals.groupBy(idx.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    edges = grid.select(
        "bin",
        (lo + width * F.col("bin") / F.lit(bins)).alias("bin_lo"),
        (lo + width * (F.col("bin") + 1) / F.lit(bins)).alias("bin_hi"),
    ).where(hi.isNotNull())
    return edges.join(counted, "bin", "left").select("bin", "bin_lo", "bin_hi", F.coalesce("n", F.lit(0)).alias("n"))
