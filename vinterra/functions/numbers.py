"""Dirty-number parsing and numeric coercion.

NULL is the one missing-value marker: NaN is turned into NULL at the boundary
(``nan_to_null``) because ``avg`` over a NaN is NaN while ``avg`` skips NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vinterra.functions._cols import as_col

# --- fixed values -----------------------------------------------------------
# Minus-like characters read as a minus sign when ``strict=False``:
#   U+2013 EN DASH, U+2212 MINUS SIGN
MINUS_LOOKALIKES = "–−"
# Clamp applied to model inputs after NaN/Inf are zeroed.
CLAMP_ABS = 1e6
# ---------------------------------------------------------------------------

# What a decimal text parser accepts: optional sign, digits with optional
# fraction (or a bare fraction), optional exponent, surrounding whitespace,
# and the infinity spellings.  Spark's own cast also takes "1d" or "2019f";
# pandas does not, so the cast is guarded by this pattern.
_DECIMAL_TEXT = r"^\s*[+-]?(?:(?:\p{Nd}+\.?\p{Nd}*|\.\p{Nd}+)(?:[eE][+-]?\p{Nd}+)?|(?i:inf|infinity))\s*$"


def nan_to_null(c) -> Column:
    col = as_col(c)
    return F.when(F.isnan(col), F.lit(None).cast("double")).otherwise(col)


def coerce_numeric(c) -> Column:
    """Text or number to DOUBLE, NULL when unparsable (``"N.V."`` -> NULL)."""
    txt = as_col(c).cast("string")
    parsed = F.when(txt.rlike(_DECIMAL_TEXT), F.trim(txt).try_cast("double"))
    return nan_to_null(parsed)


def parse_dirty_number(c, strict: bool = False) -> Column:
    """P5: keep digits, '.' and '-' only, then parse; NULL when nothing numeric is left.

    ``strict=True`` deletes an en-dash/minus-sign like the reference does (so
    ``"–0.1555"`` becomes +0.1555); the default reads it as a minus.
    """
    txt = as_col(c).cast("string")
    if not strict:
        txt = F.translate(txt, MINUS_LOOKALIKES, "-" * len(MINUS_LOOKALIKES))
    kept = F.regexp_replace(txt, r"[^\p{Nd}.\-]+", "")
    return coerce_numeric(kept)


def clean_model_input(c) -> Column:
    """M5: NaN, +Inf, -Inf and NULL become 0, then clamp to +-1e6."""
    col = as_col(c).cast("double")
    bad = col.isNull() | F.isnan(col) | (F.abs(col) == F.lit(float("inf")))
    zeroed = F.when(bad, F.lit(0.0)).otherwise(col)
    return F.greatest(F.least(zeroed, F.lit(CLAMP_ABS)), F.lit(-CLAMP_ABS))


def zero_non_finite(c) -> Column:
    """M5 without the clamp (``clean_tensor_nan``)."""
    col = as_col(c).cast("double")
    bad = col.isNull() | F.isnan(col) | (F.abs(col) == F.lit(float("inf")))
    return F.when(bad, F.lit(0.0)).otherwise(col)


def target_to_int(c) -> Column:
    """M7: numeric-or-0, truncated towards zero, as BIGINT."""
    return F.coalesce(coerce_numeric(c), F.lit(0.0)).cast("long")
