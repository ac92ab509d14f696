"""Engineered features (P13-P16) as a registry of Column builders.

Divisions use ``try_divide`` so a zero denominator gives NULL under ANSI mode
instead of failing the job; NULL later becomes 0 in model inputs (M5), which
is where an infinite value ends up in the reference too.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: feature ids, output names and inputs -----------------------
# A heat_to_rain_ratio     GDD / (rain_June + rain_SepOct + 1)
# B diurnal_range_summer   TX_summer - TM_summer
# C hot_day_intensity      hot_days / (TX_summer + 1)
# D frost_risk_index       frost_days_Apr / (avg_TM_Apr + 1)
# E price_per_heat_unit    price / (GDD + 1)
# I log_price              log1p(price)
# J region_station_id      region * 1000 + station   (integer codes)
# ---------------------------------------------------------------------------


def _c(name: str) -> Column:
    return F.col(name).cast("double")


def _ratio(num: Column, den: Column) -> Column:
    return F.try_divide(num, den)


NUMERIC_FEATURES: dict[str, tuple[str, Callable[[], Column]]] = {
    "A": ("heat_to_rain_ratio", lambda: _ratio(_c("GDD"), _c("rain_June") + _c("rain_SepOct") + F.lit(1.0))),
    "B": ("diurnal_range_summer", lambda: _c("TX_summer") - _c("TM_summer")),
    "C": ("hot_day_intensity", lambda: _ratio(_c("hot_days"), _c("TX_summer") + F.lit(1.0))),
    "D": ("frost_risk_index", lambda: _ratio(_c("frost_days_Apr"), _c("avg_TM_Apr") + F.lit(1.0))),
    "E": ("price_per_heat_unit", lambda: _ratio(_c("price"), _c("GDD") + F.lit(1.0))),
    "I": ("log_price", lambda: F.log1p(_c("price"))),
}

CATEGORICAL_FEATURES: dict[str, tuple[str, Callable[[], Column]]] = {
    "J": ("region_station_id", lambda: F.col("region").cast("long") * F.lit(1000) + F.col("station").cast("long")),
}


def numeric_feature(fid: str) -> Column:
    if fid not in NUMERIC_FEATURES:
        raise ValueError(f"Unsupported numeric feature: {fid}")
    name, build = NUMERIC_FEATURES[fid]
    return build().alias(name)


def categorical_feature(fid: str) -> Column:
    if fid not in CATEGORICAL_FEATURES:
        raise ValueError(f"Unsupported categorical feature: {fid}")
    name, build = CATEGORICAL_FEATURES[fid]
    return build().alias(name)


def add_engineered_features(
    df: DataFrame, num_cols: Sequence[str], cat_cols: Sequence[str], feature_ids: Sequence[str]
) -> tuple[DataFrame, list[str], list[str]]:
    """Append requested features (numeric ids first, then categorical, each in
    request order); ids in neither registry are ignored.  One projection over the
    whole table -- splits travel as a ``split`` column, not as separate frames."""
    num_ids = [f for f in feature_ids if f in NUMERIC_FEATURES]
    cat_ids = [f for f in feature_ids if f in CATEGORICAL_FEATURES]
    new_cols = [numeric_feature(f) for f in num_ids] + [categorical_feature(f) for f in cat_ids]
    out = df.select("*", *new_cols) if new_cols else df
    return (
        out,
        list(num_cols) + [NUMERIC_FEATURES[f][0] for f in num_ids],
        list(cat_cols) + [CATEGORICAL_FEATURES[f][0] for f in cat_ids],
    )


def drop_numeric_columns(df: DataFrame, num_cols: Sequence[str], drop_list: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Remove numeric feature columns named in ``drop_list``."""
    drop = [c for c in num_cols if c in set(drop_list)]
    return df.drop(*drop), [c for c in num_cols if c not in set(drop_list)]
