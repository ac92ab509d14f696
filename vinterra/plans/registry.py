"""Registry of named queries: key -> (Spark builder, DuckDB oracle SQL or None).

Builders take ``(spark, sf_dir)`` and return a lazy DataFrame over the whole
given tables.  A ``None`` oracle means the result is not expressible in plain
SQL (model fits, hash-seeded splits); those keys are checked by invariants in
``tests/`` instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Builder = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Builder] = {}
_ORACLES: dict[str, str] = {}

DIGITS = 6


def query(key: str, sql: str | None = None):
    """Decorator registering a builder under ``key`` with its oracle SQL."""

    def deco(fn: Builder) -> Builder:
        if key in _QUERIES:
            raise ValueError(f"duplicate query key {key}")
        _QUERIES[key] = fn
        if sql is not None:
            _ORACLES[key] = _expand_round(sql)
        return fn

    return deco


def queries() -> dict[str, Builder]:
    _load_all()
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    _load_all()
    return dict(_ORACLES)


_SCALE = 10.0**DIGITS
_ROUND_LIMIT = 1e9


def round_half_up(c) -> "F.Column":
    """``floor(x * 1e6 + 0.5) / 1e6`` -- IEEE operations that Spark and DuckDB
    evaluate bit-identically (their ``round`` functions differ on halves).
    Values beyond 1e9, infinities and NaN are passed through."""
    x = c.cast("double")
    return F.when(F.abs(x) < F.lit(_ROUND_LIMIT), F.floor(x * F.lit(_SCALE) + F.lit(0.5)) / F.lit(_SCALE)).otherwise(x)


def rounded(df: DataFrame) -> DataFrame:
    """Round every DOUBLE/FLOAT column so float summation order cannot change a hash."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(round_half_up(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def _expand_round(sql: str) -> str:
    """Rewrite ``round(E, 6)`` in oracle SQL to the same formula as ``round_half_up``."""
    out, i = [], 0
    while True:
        j = sql.find("round(", i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        if j > 0 and (sql[j - 1].isalnum() or sql[j - 1] == "_"):
            out.append(sql[i : j + 6])
            i = j + 6
            continue
        depth, k = 0, j + 5
        while True:
            ch = sql[k]
            depth += ch == "("
            depth -= ch == ")"
            if depth == 0:
                break
            k += 1
        inner = sql[j + 6 : k]
        head, sep, tail = inner.rpartition(",")
        if sep and tail.strip() == str(DIGITS):
            e = _expand_round(head)
            out.append(sql[i:j])
            out.append(
                f"(CASE WHEN abs({e}) < {_ROUND_LIMIT} THEN floor(({e}) * {_SCALE} + 0.5) / {_SCALE} ELSE ({e}) END)"
            )
        else:
            out.append(sql[i : k + 1])
        i = k + 1


def sql_str(s: str) -> str:
    """SQL string literal (quotes doubled; backslashes passed through to RE2)."""
    return "'" + s.replace("'", "''") + "'"


def _load_all() -> None:
    # Importing the modules registers their queries.
    from vinterra.plans import (  # noqa: F401
        q_io,
        q_ml,
        q_pages,
        q_prep,
        q_scoring,
        q_spatial,
        q_tables,
        q_text,
        q_weather,
    )
