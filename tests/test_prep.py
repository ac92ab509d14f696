"""M1-M10, M14, W5, W6, A12-A14 (fixtures of the data-module tests + invariants)."""

import math

import pytest
from pyspark.sql import functions as F

from vinterra.operators.prep import (
    assign_split,
    category_widths,
    class_count,
    class_weights,
    clean_numeric,
    encode_with_mapping,
    first_seen_mapping,
    impute_mean,
    infer_roles,
    mlp_width,
    ordinal_encode,
    sorted_mapping,
    split_target,
    standardize,
    stratified_folds,
    tab_width,
)

TRAIN = [(1.0, "A", 0), (2.5, "B", 1), (None, "A", 1), (float("inf"), None, 0), (float("-inf"), "C", 1)]
TEST = [(0.5, "A", 0), (1.5, "C", 1)]
SCHEMA = "feature_num double, feature_cat string, label int"


def test_roles(spark):
    df = spark.createDataFrame(TRAIN, SCHEMA)
    assert infer_roles(df.schema, "label", cat_cols=["feature_cat"]) == (["feature_num"], ["feature_cat"])
    with pytest.raises(ValueError):
        infer_roles(df.schema, "label")


def test_codes_in_vocab_and_unknown_zero(spark):
    tr = spark.createDataFrame(TRAIN, SCHEMA)
    te = spark.createDataFrame(TEST + [(0.1, "Z", 0)], SCHEMA)
    mapping = sorted_mapping(tr, ["feature_cat"])
    assert sorted((r.value, r.code) for r in mapping.collect()) == [("A", 0), ("B", 1), ("C", 2)]
    enc = encode_with_mapping(te, mapping, ["feature_cat"]).collect()
    assert sorted(r.feature_cat for r in enc) == [0, 0, 2]  # "Z" unknown -> 0
    enc_tr = encode_with_mapping(tr, mapping, ["feature_cat"]).collect()
    assert all(0 <= r.feature_cat < 3 for r in enc_tr)  # NULL -> missing token -> 0


def test_imputation_inf_rule(spark):
    tr = spark.createDataFrame([(r[0], r[1], r[2], "train") for r in TRAIN], SCHEMA + ", split string")
    out = clean_numeric(impute_mean(tr, ["feature_num"]), ["feature_num"]).collect()
    # +Inf and -Inf make the mean NaN: the NULL is filled with NaN, then zeroed
    assert [r.feature_num for r in out] == [1.0, 2.5, 0.0, 0.0, 0.0]


def test_impute_per_split(spark):
    df = spark.createDataFrame([(1.0, "train"), (3.0, "train"), (None, "train"), (10.0, "test"), (None, "test")], "x double, split string")
    out = [(r.split, r.x) for r in impute_mean(df, ["x"]).collect()]
    assert ("train", 2.0) in out and ("test", 10.0) in out
    out_tr = [(r.split, r.x) for r in impute_mean(df, ["x"], fit_on="train").collect()]
    assert ("test", 2.0) in out_tr


def test_exact_split_sizes(spark):
    df = spark.range(101).withColumnRenamed("id", "k")
    s = assign_split(df, "k", 0.2, 100)
    counts = {r.split: r["count"] for r in s.groupBy("split").count().collect()}
    assert counts == {"train": round(101 * 0.8), "valid": 101 - round(101 * 0.8)}
    assert assign_split(df, "k", 0.0, 100).where("split = 'valid'").count() == 0


def test_existing_split_column(spark):
    df = spark.createDataFrame([(1, "train"), (2, "valid"), (3, "other")], "k int, split string")
    assert sorted(r.k for r in assign_split(df, "k").collect()) == [1, 2]


def test_split_target_rejects_null(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, None)], "f double, label int")
    x, y = split_target(df, "label")
    assert x.columns == ["f"]
    with pytest.raises(Exception):
        df.select(y).collect()


def test_first_seen_mapping_fixture(spark):
    df = spark.createDataFrame([(0, "Bordeaux", "red", 2019), (1, "Alsace", "white", 2019), (2, "Bordeaux", "red", 2020),
                                (3, "Rhone", "red", 2021)], "i int, region string, grape string, year int")
    m = first_seen_mapping(df, ["region", "grape", "year"], ["i"])
    sizes = {r.column: r["count"] for r in m.groupBy("column").count().collect()}
    assert sizes["region"] == 3 and sizes["grape"] == 2
    codes = {(r.column, r.value): r.code for r in m.collect()}
    assert codes[("grape", "red")] == 0 and codes[("grape", "white")] == 1
    new = spark.createDataFrame([(0, "Bordeaux"), (1, "Jura")], "i int, region string")
    ext = {r.value: r.code for r in first_seen_mapping(new, ["region"], ["i"], existing=m.where("column = 'region'")).collect()}
    assert ext["Jura"] == 3 and ext["Bordeaux"] == codes[("region", "Bordeaux")]
    with pytest.raises(KeyError):
        first_seen_mapping(df, ["missing"], ["i"])


def test_class_weights_and_count(spark):
    df = spark.createDataFrame([(0,), (0,), (0,), (1,)], "label int")
    w = {r.label: (r.weight, r.balanced_weight) for r in class_weights(df).collect()}
    assert w[0] == (4 / 3, 4 / 6) and w[1] == (4.0, 2.0)
    assert tuple(class_count(df).first()) == (2, 2)


def test_widths(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "x")], "c1 string, c2 string")
    w = {r.column: (r.vocab, r.width_mlp, r.width_tab) for r in category_widths(df, ["c1", "c2"]).collect()}
    assert w["c1"] == (3, mlp_width(3), tab_width(3)) and w["c2"] == (2, 4, 8)
    assert tab_width(100) == 10 and mlp_width(400) == 10


def test_ordinal_unknown_minus_one(spark):
    tr = spark.createDataFrame([("b",), ("a",)], "c string")
    te = spark.createDataFrame([("a",), ("z",)], "c string")
    assert sorted(r.c_ord for r in ordinal_encode(tr, te, ["c"]).collect()) == [-1, 0]


def test_standardize_population_std(spark):
    tr = spark.createDataFrame([(1.0,), (3.0,)], "x double")
    assert [r.x for r in standardize(tr, tr, ["x"]).collect()] == [-1.0, 1.0]


def test_stratified_folds_balanced(spark):
    df = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(103)], "k int, label int")
    f = stratified_folds(df, "label", "k", 5, 100)
    per = f.groupBy("label", "fold").count().collect()
    for lab in (0, 1):
        sizes = [r["count"] for r in per if r.label == lab]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1
    assert f.count() == 103


def test_zero_categorical_columns(spark):
    df = spark.createDataFrame([(1.0,)], "x double")
    assert encode_with_mapping(df, sorted_mapping(df.withColumn("c", F.lit("a")), ["c"]), []).columns == ["x"]


def test_rows_without_a_label_get_folds(spark):
    from vinterra.operators.prep import stratified_folds

    df = spark.createDataFrame([(i, None if i % 3 == 0 else i % 2) for i in range(30)], "id int, label int")
    got = stratified_folds(df, "label", "id", 5).collect()
    assert sorted(r.id for r in got) == list(range(30))
    assert sorted(r.fold for r in got if r.label is None) == [f for f in range(5) for _ in range(2)]


def test_no_categorical_columns(spark):
    from vinterra.operators.prep import encode_with_mapping, first_seen_mapping, sorted_mapping

    df = spark.createDataFrame([(1, "a")], "id int, c string")
    assert sorted_mapping(df, []).collect() == [] and first_seen_mapping(df, [], ["id"]).collect() == []
    known = first_seen_mapping(df, ["c"], ["id"])
    assert [tuple(r) for r in first_seen_mapping(df, [], ["id"], existing=known).collect()] == [("c", "a", 0)]
    assert encode_with_mapping(df, sorted_mapping(df, []), []).collect() == df.collect()


def test_hash_split_is_stable_and_near_its_share(spark):
    from vinterra.operators.prep import assign_split

    df = spark.range(4000).withColumnRenamed("id", "k")
    one = {r.k: r.split for r in assign_split(df, "k", 0.2, exact=False).collect()}
    more = {r.k: r.split for r in assign_split(spark.range(8000).withColumnRenamed("id", "k"), "k", 0.2, exact=False).collect()}
    assert all(more[k] == s for k, s in one.items())
    assert 0.17 < sum(s == "valid" for s in one.values()) / 4000 < 0.23
    plan = assign_split(df, "k", 0.2, exact=False)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_one_hot_cells_leave_out_unseen_and_missing(spark):
    from vinterra.operators.prep import one_hot_cells, ordinal_encode

    train = spark.createDataFrame([("b",), ("a",), (None,)], "c string")
    test = spark.createDataFrame([(1, "a"), (2, "zz"), (3, None)], "id int, c string")
    assert [tuple(r) for r in one_hot_cells(train, test, ["c"], "id").collect()] == [(1, "c", "a")]
    assert {r.id: r.c_ord for r in ordinal_encode(train, test, ["c"]).collect()} == {1: 0, 2: -1, 3: None}


def test_codes_are_joined_by_their_counted_size(spark, monkeypatch):
    from vinterra.operators import prep

    rows = [(i, f"v{i:03}", "ab"[i % 2]) for i in range(200)] + [(200, None, "new"), (201, "v007", None)]
    train, every = (spark.createDataFrame(x, "k int, many string, few string") for x in (rows[:200], rows))
    for limit, joins in ((prep.BROADCAST_BYTES, (2, 0)), (1000, (1, 1)), (0, (0, 2))):
        monkeypatch.setattr(prep, "BROADCAST_BYTES", limit)
        coded = encode_with_mapping(every, sorted_mapping(train, ["many", "few"]), ["many", "few"])
        ordinal = ordinal_encode(train, every, ["many", "few"])
        for out in (coded, ordinal):
            found = out.collect()
            plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
            assert (plan.count("BroadcastHashJoin"), plan.count("SortMergeJoin")) == joins
            got = {r.k: (r.many, r.few) if out is coded else (r.many_ord, r.few_ord) for r in found}
            assert all(got[i] == (i, i % 2) for i in range(200))
            assert (got[200], got[201]) == (((0, 0), (7, 0)) if out is coded else ((None, -1), (7, None)))


def test_known_categories_are_merged(spark, tmp_out):
    from vinterra.operators.prep import one_hot_cells

    spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "a")], "k int, c string").write.parquet(f"{tmp_out}/t")
    t = spark.read.parquet(f"{tmp_out}/t")
    out = one_hot_cells(t.where("k < 2"), t, ["c"], "k")
    assert sorted(tuple(r) for r in out.collect()) == [(1, "c", "a"), (4, "c", "a")]
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
