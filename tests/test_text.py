"""P1-P7 scalar functions (fixtures of the reference's text/merge tests)."""

import math

import pytest
from pyspark.sql import functions as F

from vinterra.functions.grapes import dominant_item
from vinterra.functions.numbers import clean_model_input, coerce_numeric, parse_dirty_number, target_to_int
from vinterra.functions.text import clean_name, light_key, normalize_text, slugify, title_case


def _col(spark, values, fn, schema="v string"):
    df = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in df.select(fn("v")).collect()]


def test_normalize_string_fixture(spark):
    assert _col(spark, [" Château-du-Test !! ", None, "Hello--World"], normalize_text) == [
        "château du test", "", "hello world"]


def test_normalize_keeps_null_when_asked(spark):
    assert _col(spark, [None, "A-b"], lambda c: normalize_text(c, null_as_empty=False)) == [None, "a b"]


def test_normalize_unicode_whitespace_and_quotes(spark):
    assert _col(spark, ["l’abbé (rouge)   [2]"], normalize_text) == ["l abbé rouge 2"]


def test_clean_wine_name_fixture(spark):
    assert _col(spark, ["Wine 2019", "1995 Château-Test", ""], clean_name) == ["wine", "château test", ""]


def test_clean_wine_name_word_boundaries(spark):
    # a year glued to letters is not a word; 2019x neither; 1899 is not 19xx/20xx
    assert _col(spark, ["é2019 Cuvée 2019x 1899 2021"], clean_name) == ["é2019 cuvée 2019x 1899"]


def test_light_key_keeps_punctuation(spark):
    assert _col(spark, ["  Saint-Émilion, Grand Cru "], light_key) == ["saint émilion, grand cru"]


def test_slug(spark):
    assert _col(spark, ["  Haut Médoc "], slugify) == ["haut-médoc"]


def test_title_case_like_python(spark):
    assert _col(spark, ["haut-médoc du  RHÔNE"], title_case) == ["haut-médoc du  RHÔNE".title()]


def test_dirty_numbers(spark):
    vals = ["–0.1555", "4.7075 ", "N.V.", "1.2.3", "EUR 12.5", None]
    assert _col(spark, vals, parse_dirty_number) == [-0.1555, 4.7075, None, None, 12.5, None]
    # strict reproduces the reference: the en dash is deleted
    assert _col(spark, vals[:2], lambda c: parse_dirty_number(c, strict=True)) == [0.1555, 4.7075]


def test_numeric_coercion_is_pandas_like(spark):
    vals = ["2019", " 12 ", "1e3", "1d", "2019f", "N.V.", "", "-.5"]
    assert _col(spark, vals, coerce_numeric) == [2019.0, 12.0, 1000.0, None, None, None, None, -0.5]


def test_dominant_grape_fixture(spark):
    vals = [
        "[{'seo_name': 'merlot', 'x': 1}, {'seo_name': 'cabernet'}]",
        "[{'seo_name': 'chardonnay', 'flag': True, 'n': None}]",
        "[]",
        "not a list",
        None,
        "[{'wrong_key': 'nope'}]",
    ]
    assert _col(spark, vals, dominant_item) == ["merlot", "chardonnay", None, None, None, None]


def test_dominant_grape_first_not_a_dict(spark):
    assert _col(spark, ["['merlot']", "{'seo_name': 'x'}"], dominant_item) == [None, None]


def test_clean_model_input(spark):
    df = spark.createDataFrame([(1.0, float("nan")), (float("inf"), float("-inf")), (2e7, None)], "a double, b double")
    out = df.select(clean_model_input("a").alias("a"), clean_model_input("b").alias("b")).collect()
    assert [tuple(r) for r in out] == [(1.0, 0.0), (0.0, 0.0), (1e6, 0.0)]


def test_target_cast(spark):
    assert _col(spark, ["1", "0.9", "n/a", None, "2"], target_to_int) == [1, 0, 0, 0, 2]


def test_dominant_item_leaves_quoted_words_alone(spark):
    vals = ["[{'seo_name': 'None'}]", "[{'seo_name': 'a True b', 'x': None}]", "[{'x': None, 'seo_name': \"it's False\"}]",
            "[{'seo_name': 'x'}] junk", "[{'seo_name': None}]", "[{'ok': True, 'seo_name': 'y'}, {'seo_name': 'z'}]"]
    assert _col(spark, vals, dominant_item) == ["None", "a True b", "it's False", None, None, "y"]
