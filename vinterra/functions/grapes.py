"""Dominant list item from a Python-literal list of dicts.

The crawl stores grapes as ``"[{'seo_name': 'merlot', ...}, ...]"``.  The JVM
JSON reader parses it once Python's ``None/True/False`` are spelled the JSON
way -- outside of quoted strings only -- and single quotes are allowed; text
after the closing bracket makes it no list.  An array column is accepted
directly.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vinterra.functions._cols import as_col

_QUOTED = r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\""
_MARK = "\x00"
_ITEM_SCHEMA = "array<struct<seo_name:string>>"


def dominant_item(c, key: str = "seo_name") -> Column:
    """First element's ``key`` of a list literal; NULL for null, ``[]``, non-lists,
    malformed text, a first element that is not a dict, or a missing key."""
    col = as_col(c)
    schema = _ITEM_SCHEMA.replace("seo_name", key)
    txt = col.cast("string")
    jsonish = txt
    for name, word in (("None", "null"), ("True", "true"), ("False", "false")):
        jsonish = F.regexp_replace(jsonish, rf"({_QUOTED})|\b{name}\b", f"$1{_MARK}{word}")
        # the mark stands before a replaced word, and after a quoted string that stays
        jsonish = F.regexp_replace(jsonish, rf"({_QUOTED}){_MARK}{word}", "$1")
        jsonish = F.replace(jsonish, F.lit(_MARK), F.lit(""))
    parsed = F.from_json(jsonish, schema, {"allowSingleQuotes": "true", "mode": "PERMISSIVE"})
    first = F.try_element_at(parsed, F.lit(1))
    return F.when(txt.rlike(r"(?s)^\s*\[\s*\{.*\]\s*$"), first[key])


def dominant_item_from_array(c, key: str = "seo_name") -> Column:
    """Same rule when the grapes already are an ``array<struct>`` column (Q12)."""
    col = as_col(c)
    return F.try_element_at(col, F.lit(1))[key]


def dominant_item_any(df_schema: T.StructType, name: str, key: str = "seo_name") -> Column:
    """Pick the string or array form from the schema at plan time."""
    field = df_schema[name]
    if isinstance(field.dataType, T.ArrayType):
        return dominant_item_from_array(name, key)
    return dominant_item(name, key)
