"""Helpers shared by the training-data operators.

Row identity: an operator that has to find a row again after a shuffle uses
``(doc_id, xxhash64(text))``, compared null-safe.  Rows equal in both get the same result, so
repeated rows need no row number, and a null id is a value like any other.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vinterra.session import ensure_checkpoint_dir

#: Words of a text: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


#: Folders handed out by ``scratch_path`` and not yet dropped.
_scratch: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    _scratch.append(f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _scratch[-1]


def scratch_mark() -> int:
    """Mark for ``drop_scratch``: tables written before it stay."""
    return len(_scratch)


def drop_scratch(spark: SparkSession, mark: int = 0, keep: DataFrame | None = None) -> None:
    """Delete the tables written since ``mark`` but those that ``keep`` reads.

    For jobs that have stored their result: DataFrames that still read such a table can no longer run.
    """
    used = keep.inputFiles() if keep is not None else []
    for path in _scratch[mark:]:
        name = path.rsplit("/", 1)[1]
        if not any(f"/{name}/" in f for f in used):
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
            _scratch.remove(path)


def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again.

    Cuts lineage, survives lost executors, and gives the planner the real size, so that it
    broadcasts the table only when that is below ``spark.sql.autoBroadcastJoinThreshold``.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words(text: Column | str) -> Column:
    """Array of the words of a text (null text: empty array)."""
    return F.array_remove(F.split(F.coalesce(text if isinstance(text, Column) else F.col(text), F.lit("")), SPACE), "")


def same_row(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = ("doc_id", "text_key")) -> Column:
    """Null-safe equality of the row identity columns of two tables."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[k])
    return cond


def record_batches(rows: Iterable[tuple], schema: pa.Schema, max_rows: int = 2000, max_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Small Arrow batches of result rows, so that a task never holds the results of a whole input batch."""

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)

    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if hasattr(x, "__len__"))
        if len(held) >= max_rows or size >= max_bytes:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()
    del held
    pa.default_memory_pool().release_unused()  # workers are reused: give back what this task took
