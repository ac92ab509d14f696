"""Scalar text / number queries (P1-P7) over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from vinterra.functions.grapes import dominant_item
from vinterra.functions.numbers import coerce_numeric, parse_dirty_number
from vinterra.functions.text import (
    PUNCT_TO_SPACE,
    WORD_CLASS,
    WS_CLASS,
    _regex_escape_class,
    clean_name,
    light_key,
    normalize_text,
    slugify,
)
from vinterra.plans import standins
from vinterra.plans.registry import query, rounded, sql_str
from vinterra.sources.tables import table

_RUN = sql_str("[\\-" + _regex_escape_class(PUNCT_TO_SPACE) + WS_CLASS + "]+")
_EDGE = sql_str("^[" + WS_CLASS + "]+|[" + WS_CLASS + "]+$")


def _normalize_sql(expr: str, null_as_empty: bool = True) -> str:
    core = f"trim(regexp_replace(lower({expr}), {_RUN}, ' ', 'g'))"
    return f"coalesce({core}, '')" if null_as_empty else core


def _drop_years_sql(expr: str) -> str:
    # Python's word boundary via tokens: a whole word equal to 19xx/20xx is removed.
    tokens = f"regexp_extract_all({expr}, {sql_str('[' + WORD_CLASS + ']+|[^' + WORD_CLASS + ']+')})"
    keep = "list_transform(" + tokens + ", lambda t: CASE WHEN regexp_full_match(t, '(19|20)\\p{Nd}{2}') THEN '' ELSE t END)"
    return f"array_to_string({keep}, '')"


# P1 -------------------------------------------------------------------------------
@query(
    "text_normalize",
    f"SELECT doc_id, {_normalize_sql('text')} AS text_norm FROM documents",
)
def text_normalize(spark, d):
    return table(spark, d, "documents").select("doc_id", normalize_text("text").alias("text_norm"))


# P2 -------------------------------------------------------------------------------
@query(
    "name_clean",
    f"SELECT doc_id, {_normalize_sql(_drop_years_sql('lower(text)'))} AS name_clean FROM documents",
)
def name_clean(spark, d):
    return table(spark, d, "documents").select("doc_id", clean_name("text").alias("name_clean"))


# P4 -------------------------------------------------------------------------------
@query(
    "region_slug",
    f"""SELECT DISTINCT replace(lower(regexp_replace(p_name, {_EDGE}, '', 'g')), ' ', '-') AS slug
        FROM part WHERE p_name IS NOT NULL""",
)
def region_slug(spark, d):
    names = table(spark, d, "part").select("p_name").where(F.col("p_name").isNotNull()).distinct()
    return names.select(slugify("p_name").alias("slug")).distinct()


# P3 -------------------------------------------------------------------------------
_KEY_INPUT_SQL = "'  ' || p_brand || '-' || p_name || ' '"


@query(
    "key_light",
    f"""SELECT p_partkey,
               replace(lower(regexp_replace({_KEY_INPUT_SQL}, {_EDGE}, '', 'g')), '-', ' ') AS key_light
        FROM part""",
)
def key_light(spark, d):
    p = table(spark, d, "part")
    raw = F.concat(F.lit("  "), F.col("p_brand"), F.lit("-"), F.col("p_name"), F.lit(" "))
    return p.select("p_partkey", light_key(raw).alias("key_light"))


# P5 -------------------------------------------------------------------------------
# Dirty coordinate text derived from account balances: en-dash minus, a narrow
# no-break space suffix, a currency prefix, plain values and unusable text.
def _dirty_text_spark():
    v = F.format_string("%.2f", F.abs(F.col("c_acctbal")))
    sign = F.when(F.col("c_acctbal") < 0, F.lit("–")).otherwise(F.lit(""))
    k = F.pmod(F.col("c_custkey"), F.lit(5))
    return (
        F.when(k == 0, F.concat(sign, v))
        .when(k == 1, F.concat(F.format_string("%.2f", F.col("c_acctbal")), F.lit("\u202f")))
        .when(k == 2, F.concat(F.lit("EUR "), F.format_string("%.2f", F.col("c_acctbal"))))
        .when(k == 3, F.lit("n/a"))
        .otherwise(F.format_string("%.2f", F.col("c_acctbal")))
    )


_DIRTY_TEXT_SQL = """CASE c_custkey % 5
    WHEN 0 THEN (CASE WHEN c_acctbal < 0 THEN '–' ELSE '' END) || printf('%.2f', abs(c_acctbal))
    WHEN 1 THEN printf('%.2f', c_acctbal) || '\u202f'
    WHEN 2 THEN 'EUR ' || printf('%.2f', c_acctbal)
    WHEN 3 THEN 'n/a'
    ELSE printf('%.2f', c_acctbal) END"""


def _parse_sql(expr: str) -> str:
    kept = f"regexp_replace({expr}, '[^\\p{{Nd}}.\\-]+', '', 'g')"
    return f"CASE WHEN regexp_full_match({kept}, '[+-]?(\\p{{Nd}}+\\.?\\p{{Nd}}*|\\.\\p{{Nd}}+)') THEN TRY_CAST({kept} AS DOUBLE) END"


@query(
    "dirty_number",
    f"""WITH t AS (SELECT c_custkey, {_DIRTY_TEXT_SQL} AS raw FROM customer)
        SELECT c_custkey, raw,
               round({_parse_sql("replace(replace(raw, '–', '-'), '−', '-')")}, 6) AS value,
               round({_parse_sql('raw')}, 6) AS value_strict
        FROM t""",
)
def dirty_number(spark, d):
    c = table(spark, d, "customer").select("c_custkey", _dirty_text_spark().alias("raw"))
    return rounded(
        c.select(
            "c_custkey",
            "raw",
            parse_dirty_number("raw").alias("value"),
            parse_dirty_number("raw", strict=True).alias("value_strict"),
        )
    )


# P6 -------------------------------------------------------------------------------
@query(
    "numeric_coerce",
    f"""WITH {standins.WINES_SQL}
        SELECT wine_id, vintage,
               CASE WHEN regexp_full_match(vintage, '\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?\\s*')
                    THEN TRY_CAST(trim(vintage) AS DOUBLE) END AS vintage_num
        FROM wines""",
)
def numeric_coerce(spark, d):
    w = standins.wines(spark, d)
    return w.select("wine_id", "vintage", coerce_numeric("vintage").alias("vintage_num"))


# P7 -------------------------------------------------------------------------------
@query(
    "dominant_item",
    f"""WITH {standins.WINES_SQL}
        SELECT wine_id, {standins.DOMINANT_SQL} AS grape FROM wines""",
)
def dominant_item_q(spark, d):
    w = standins.wines(spark, d)
    return w.select("wine_id", dominant_item("cepages").alias("grape"))
