"""Modelling-table preparation.

One DataFrame carries every split in a ``split`` column, so each statistic
(means, vocabularies, class counts) is one grouped aggregate over it and is
attached back with a join against a table whose size is the number of
splits / categories -- never a driver loop over rows.

Random choices use ``md5(seed:key)`` as the shuffle order: deterministic,
seedable, computed JVM-side and reproducible by any SQL engine.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vinterra.functions._cols import null_safe_join
from vinterra.functions.numbers import clean_model_input, coerce_numeric, target_to_int
from vinterra.operators.encode import consecutive_index, grouped_codes
from vinterra.session import as_table

# --- fixed values --------------------------------------------------------------------
MISSING_TOKEN = "__MISSING__"
DEFAULT_SEED = 100
DEFAULT_VALID_FRAC = 0.2
# bytes of a column's codes up to which they go to every executor, and of a code besides its value
BROADCAST_BYTES = 4 << 20
CODE_BYTES = 64
# ------------------------------------------------------------------------------------------


def shuffle_key(key, seed: int = DEFAULT_SEED) -> Column:
    """Seeded pseudo-random order of rows."""
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), k.cast("string")))


# M1 ---------------------------------------------------------------------------------------
def infer_roles(schema: T.StructType, target: str, num_cols: Sequence[str] | None = None,
                cat_cols: Sequence[str] | None = None, exclude: Sequence[str] = ("split",)) -> tuple[list[str], list[str]]:
    """Numeric = every column but categorical, target and ``exclude`` when only
    categorical columns are given; by type when neither is given; both given -> as is."""
    if num_cols is not None:
        return list(num_cols), list(cat_cols or [])
    if cat_cols is None:
        raise ValueError("give the numeric or the categorical columns")
    taken = {target, *cat_cols, *exclude} if cat_cols else set(schema.names)
    return [f.name for f in schema if f.name not in taken], list(cat_cols)


def infer_roles_by_type(schema: T.StructType, target: str, exclude: Sequence[str] = ("split",)) -> tuple[list[str], list[str]]:
    """String columns are categorical, numeric columns numeric (object dtype rule)."""
    num, cat = [], []
    for f in schema.fields:
        if f.name == target or f.name in exclude:
            continue
        if isinstance(f.dataType, T.StringType):
            cat.append(f.name)
        elif isinstance(f.dataType, T.NumericType):
            num.append(f.name)
    return num, cat


# S2 ---------------------------------------------------------------------------------------
def split_target(df: DataFrame, target: str) -> tuple[DataFrame, Column]:
    """Features without the target, and the target as INT (raises on NULL at run time)."""
    y = F.when(F.col(target).isNull(), F.raise_error(F.lit(f"NULL in target column {target}"))).otherwise(
        F.col(target).cast("int")
    )
    return df.drop(target), y


# M2 ---------------------------------------------------------------------------------------
def assign_split(df: DataFrame, key: str, valid_frac: float = DEFAULT_VALID_FRAC, seed: int = DEFAULT_SEED,
                 split_col: str = "split", exact: bool = True) -> DataFrame:
    """Existing ``split`` column: kept (only ``train``/``valid`` rows).  Otherwise
    an exact-size seeded sample: the first ``round(n * (1 - valid_frac))`` rows
    in shuffle order are ``train``, the rest ``valid``.  With ``exact=False`` a row is ``valid``
    where the first 32 bits of its seeded hash fall below ``valid_frac``: sizes vary by chance, but
    there is no shuffle and a row keeps its split when the table grows."""
    if split_col in df.columns:
        return df.where(F.col(split_col).isin("train", "valid"))
    if not exact:
        share = F.conv(F.substring(shuffle_key(key, seed), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
        return df.withColumn(split_col, F.when(share < F.lit(valid_frac), "valid").otherwise("train"))
    n = df.select(F.count(F.lit(1))).scalar()
    n_train = F.bround(n * F.lit(1.0 - valid_frac), 0)
    ordered = consecutive_index(df, [shuffle_key(key, seed), F.col(key)], "_pos")
    return ordered.withColumn(split_col, F.when(F.col("_pos") < n_train, "train").otherwise("valid")).drop("_pos")


# M3 / M4 ----------------------------------------------------------------------------------
def impute_mean(df: DataFrame, num_cols: Sequence[str], split_col: str = "split", fit_on: str = "self") -> DataFrame:
    """Coerce to numbers (P6) and fill NULLs with a mean: each split's own mean
    (``fit_on='self'``, the reference behaviour) or the ``train`` mean."""
    coerced = df.withColumns({c: coerce_numeric(c) for c in num_cols})
    if fit_on == "train":
        train = coerced.where(F.col(split_col) == "train")
        means = train.select(F.struct(*[F.avg(c).alias(c) for c in num_cols])).scalar()  # one pass over train
        return coerced.withColumns({c: F.coalesce(F.col(c), means[c]) for c in num_cols})
    # one row per split value (a handful), broadcast back to the rows
    means = coerced.groupBy(split_col).agg(*[F.avg(c).alias(f"_mean_{c}") for c in num_cols])
    joined = coerced.join(F.broadcast(means), split_col, "left")
    filled = joined.withColumns({c: F.coalesce(F.col(c), F.col(f"_mean_{c}")) for c in num_cols})
    return filled.drop(*[f"_mean_{c}" for c in num_cols])


# M5 ---------------------------------------------------------------------------------------
def clean_numeric(df: DataFrame, num_cols: Sequence[str], clamp: bool = True) -> DataFrame:
    from vinterra.functions.numbers import zero_non_finite

    fn = clean_model_input if clamp else zero_non_finite
    return df.withColumns({c: fn(c) for c in num_cols})


# M7 ---------------------------------------------------------------------------------------
def cast_target(df: DataFrame, target: str) -> DataFrame:
    return df.withColumn(target, target_to_int(target))


# W5 ---------------------------------------------------------------------------------------
def _stack(df: DataFrame, cols: Sequence[str], as_text: Column | None = None) -> DataFrame:
    """(column, value) pairs for the given columns, one row per cell (no columns: no rows)."""
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, value string")
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])
    return df.select(F.explode(cells).alias("_c")).select("_c.column", "_c.value")


def sorted_mapping(df: DataFrame, cat_cols: Sequence[str]) -> DataFrame:
    """Per column, codes 0..k-1 over the sorted distinct non-null values.
    Returns ``(column, value, code)``."""
    return grouped_codes(_stack(df, cat_cols), "column", "value")


# M6 / J9 ----------------------------------------------------------------------------------
def _codes_by_column(mapping: DataFrame, cols: Sequence[str]) -> dict[str, DataFrame]:
    """``(_v, _code)`` per column from a written mapping, hinted by its counted size: a few codes are
    broadcast, so that a frequent value is not one task's; a vocabulary that grows with the rows is merged.
    The planner would go by the size of the compressed files."""
    if not cols:
        return {}
    size = F.sum(F.octet_length("value") + F.lit(CODE_BYTES))
    held = mapping.where(F.col("column").isin(*cols)).groupBy("column").agg((size <= BROADCAST_BYTES).alias("few"))
    few = {r["column"]: r["few"] for r in held.collect()}  # one row per encoded column
    return {
        c: mapping.where(F.col("column") == c).select(F.col("value").alias("_v"), F.col("code").alias("_code"))
        .hint("broadcast" if few.get(c, True) else "merge")
        for c in cols
    }


def encode_with_mapping(df: DataFrame, mapping: DataFrame, cat_cols: Sequence[str], missing: str = MISSING_TOKEN,
                        unknown: int = 0, suffix: str = "") -> DataFrame:
    """NULL -> ``missing`` token, then the code from ``mapping``; values not in
    the mapping (the token included) get ``unknown``.  The mapping is written
    once, so each column's join is a broadcast or a shuffle by its counted size."""
    codes = _codes_by_column(as_table(mapping, "category-codes"), cat_cols)
    out = df
    for c in cat_cols:
        m = codes[c]
        key = F.coalesce(F.col(c).cast("string"), F.lit(missing))
        out = out.withColumn("_k", key).join(m, F.col("_k") == F.col("_v"), "left")
        out = out.withColumn(c + suffix, F.coalesce(F.col("_code"), F.lit(unknown)).cast("long")).drop("_k", "_v", "_code")
    return out


# W6 ---------------------------------------------------------------------------------------
def first_seen_mapping(df: DataFrame, cat_cols: Sequence[str], order: Sequence[str],
                       existing: DataFrame | None = None) -> DataFrame:
    """Codes by first appearance of ``str(value)`` (NULL is the text "None")
    in ``order``; with ``existing`` (column, value, code) the mapping is
    extended: new values get ``size(existing column) + rank`` in first-seen order."""
    missing = [c for c in cat_cols if c not in df.columns]
    if missing:
        raise KeyError(f"Categorical column '{missing[0]}' not found in data.")
    if not cat_cols:
        none = df.sparkSession.createDataFrame([], "column string, value string, code long")
        return none if existing is None else existing.select("column", "value", "code")
    cells = F.array(
        *[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit("None")).alias("value")) for c in cat_cols]
    )
    ord_struct = F.struct(*[F.col(o) for o in order])
    stacked = df.select(ord_struct.alias("_ord"), F.explode(cells).alias("_c")).select("_ord", "_c.column", "_c.value")
    first = stacked.groupBy("column", "value").agg(F.min("_ord").alias("_first"))
    if existing is not None:
        first = first.join(existing.select("column", "value").hint("merge"), ["column", "value"], "left_anti")
    coded = grouped_codes(first, "column", "value", order=["_first"])
    if existing is None:
        return coded
    base = existing.groupBy("column").agg(F.count(F.lit(1)).alias("_base"))
    shifted = coded.join(base, "column", "left").select(
        "column", "value", (F.col("code") + F.coalesce("_base", F.lit(0))).alias("code")
    )
    return existing.select("column", "value", "code").unionByName(shifted)


# A12 / A13 --------------------------------------------------------------------------------
def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Per class: count, ``total / count`` and sklearn's balanced ``total / (k * count)``."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = counts.select(F.sum("n")).scalar()
    k = counts.select(F.count(F.lit(1))).scalar()
    return counts.select(label, "n", (total / F.col("n")).alias("weight"), (total / (k * F.col("n"))).alias("balanced_weight"))


def class_count(df: DataFrame, label: str = "label") -> DataFrame:
    """Distinct non-null labels, and the ``max + 1`` variant."""
    return df.agg(F.count_distinct(label).alias("n_classes"), (F.max(label) + 1).alias("n_classes_max_plus_one"))


# A14 --------------------------------------------------------------------------------------
def category_widths(df: DataFrame, cat_cols: Sequence[str]) -> DataFrame:
    """Per categorical column: vocabulary size and embedding widths
    (MLP: ``int(max(4, sqrt(v) // 2))``; tabular nets: ``max(8, int(sqrt(v)))``)."""
    vocab = _stack(df, cat_cols).where(F.col("value").isNotNull()).groupBy("column").agg(F.count_distinct("value").alias("vocab"))
    root = F.sqrt(F.col("vocab").cast("double"))
    return vocab.select(
        "column", "vocab",
        F.greatest(F.lit(4.0), F.floor(root / 2).cast("double")).cast("int").alias("width_mlp"),
        F.greatest(F.lit(8), F.floor(root).cast("int")).alias("width_tab"),
    )


def mlp_width(vocab: int) -> int:
    return int(max(4, math.sqrt(vocab) // 2))


def tab_width(vocab: int) -> int:
    return max(8, int(math.sqrt(vocab)))


# M9 ---------------------------------------------------------------------------------------
def ordinal_codes(df: DataFrame, mapping: DataFrame, cat_cols: Sequence[str], unknown: int = -1, suffix: str = "_ord") -> DataFrame:
    """Codes of a written ``(column, value, code)`` mapping; unseen -> ``unknown``, NULL stays NULL."""
    codes = _codes_by_column(mapping, cat_cols)
    out = df
    for c in cat_cols:
        m = codes[c]
        out = out.join(m, F.col(c).cast("string") == F.col("_v"), "left")
        code = F.when(F.col(c).isNotNull(), F.coalesce(F.col("_code"), F.lit(unknown)))
        out = out.withColumn(c + suffix, code.cast("long")).drop("_v", "_code")
    return out


def ordinal_encode(train: DataFrame, df: DataFrame, cat_cols: Sequence[str], unknown: int = -1, suffix: str = "_ord") -> DataFrame:
    """Sorted categories learnt on ``train``; unseen -> ``unknown``, NULL stays NULL."""
    return ordinal_codes(df, as_table(sorted_mapping(train, cat_cols), "category-codes"), cat_cols, unknown, suffix)


def one_hot_cells(train: DataFrame, df: DataFrame, cat_cols: Sequence[str], key: str) -> DataFrame:
    """One-hot encoding as ``(key, column, value)`` cells holding 1: the category of each row that
    ``train`` knows; unseen and NULL values have no cell (all zeros)."""
    known = _stack(train, cat_cols).where(F.col("value").isNotNull()).distinct()
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cat_cols])
    rows = df.select(key, F.explode(cells).alias("_c")).select(key, "_c.column", "_c.value")
    return rows.join(known.hint("merge"), ["column", "value"], "left_semi").select(key, "column", "value")


# M10 --------------------------------------------------------------------------------------
def standardize(train: DataFrame, df: DataFrame, num_cols: Sequence[str], suffix: str = "") -> DataFrame:
    """``(x - mean) / std`` with the population std of ``train`` (1 where std is 0),
    statistics as scalar subqueries."""
    stats = train.select(F.struct(*[F.avg(c).alias(f"m_{c}") for c in num_cols],
                                  *[F.stddev_pop(c).alias(f"s_{c}") for c in num_cols])).scalar()  # one pass
    out = df
    for c in num_cols:
        mean, std = stats[f"m_{c}"], stats[f"s_{c}"]
        safe = F.when(std == 0, F.lit(1.0)).otherwise(std)
        out = out.withColumn(c + suffix, (F.col(c) - mean) / safe)
    return out


# M14 --------------------------------------------------------------------------------------
def stratified_folds(df: DataFrame, label: str, key: str, k: int = 5, seed: int = DEFAULT_SEED,
                     fold_col: str = "fold") -> DataFrame:
    """Within each class, rows in seeded shuffle order get folds 0..k-1 round
    robin: class proportions kept, fold sizes per class differ by at most one.
    The rank inside a class is ``global index - class start`` -- no window
    partitioned by the (two-valued, huge) label."""
    idx = consecutive_index(df, [F.col(label), shuffle_key(key, seed), F.col(key)], "_gi")
    starts = idx.groupBy(label).agg(F.min("_gi").alias("_start"))
    # rows without a label are a class of their own
    return null_safe_join(idx, starts, [label]).withColumn(
        fold_col, F.pmod(F.col("_gi") - F.col("_start"), F.lit(k)).cast("int")
    ).drop("_gi", "_start")
