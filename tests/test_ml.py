"""Pipelines, grids, a metric floor, persistence."""

import os

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from data_dirs import SF01
from vinterra.operators import prep
from vinterra.operators.evaluate import evaluate_metrics
from vinterra.operators.ml import (
    build_search,
    cross_val_accuracy,
    ensemble_search,
    first_trees,
    fold_features,
    grid_size,
    make_estimator,
    make_mlp_preprocessor,
    make_preprocessor,
    param_maps,
    probability_of,
    replicate_to_balance,
    save_model,
    with_balanced_weight,
)
from vinterra.plans.q_prep import model_table


@pytest.fixture(scope="module")
def data(spark):
    m = model_table(spark, SF01).cache()
    return with_balanced_weight(m.where("set = 'train'")), m.where("set = 'test'")


def test_grid_sizes_and_random_cap(spark):
    assert grid_size("lr") == 5 and grid_size("rf") == 24 and grid_size("xgb") == 243 and grid_size("hgb") == 4
    est = make_estimator("lr", weight_sum=200.0)
    lr = param_maps("lr", est, "grid", weight_sum=200.0)
    # the inverse penalty counts against the sum of the losses: 1 / (C * sum of weights)
    assert sorted(m[est.regParam] for m in lr) == pytest.approx([1 / (c * 200) for c in (100, 10, 1, 0.1, 0.01)])
    assert len(param_maps("lr", est, "random", n_iter=200, weight_sum=200.0)) == 5
    assert len(param_maps("lr", est, "random", n_iter=2, weight_sum=200.0)) == 2
    assert len(param_maps("lr", est, "bogus", weight_sum=200.0)) == 5          # unknown search type -> grid
    rf = make_estimator("rf")
    assert {m[rf.maxDepth] for m in param_maps("rf", rf)} == {30, 5, 10, 20}
    assert len(param_maps("xgb", make_estimator("xgb"), "grid")) == 3 ** 5


def test_estimators_per_key(spark):
    lr = make_estimator("lr", weight_sum=50.0)
    assert (lr.getMaxIter(), lr.getRegParam(), lr.getStandardization()) == (1000, 1 / 50, False)
    with pytest.raises(ValueError):
        make_estimator("lr")
    assert (make_estimator("rf").getNumTrees(), make_estimator("rf").getMaxDepth()) == (200, 30)
    x = make_estimator("xgb")
    assert (x.getMaxIter(), x.getMaxDepth(), x.getStepSize(), x.getSubsamplingRate()) == (200, 3, 0.1, 0.8)
    assert make_estimator("unknown").getWeightCol() == "weight"


def test_missing_column_fails(spark):
    df = spark.createDataFrame([(1.0, 0)], "GDD double, label int")
    with pytest.raises(Exception):
        Pipeline(stages=make_preprocessor("rf")).fit(df)


def test_rf_metric_floor_and_save(spark, data, tmp_out):
    train, test = data
    model = Pipeline(stages=make_preprocessor("rf") + [make_estimator("rf")]).fit(train)
    scored = model.transform(test).select(F.col("label").alias("y_true"), F.col("prediction").cast("int").alias("y_pred"),
                                          probability_of().alias("y_proba"))
    r = evaluate_metrics(scored).first()
    assert r.auc > 0.9  # the label is a price threshold and price is a feature
    path = os.path.join(tmp_out, "rf")
    save_model(model, path)
    assert PipelineModel.load(path).transform(test).count() == test.count()


def test_lr_pipeline_with_population_scaler_saves(spark, data, tmp_out):
    train, test = data
    model = Pipeline(stages=make_preprocessor("lr") + [make_estimator("lr", weight_sum=float(train.count()))]).fit(train)
    path = os.path.join(tmp_out, "lr")
    save_model(model, path)
    again = PipelineModel.load(path).transform(test).select("prediction").collect()
    assert [r.prediction for r in again] == [r.prediction for r in model.transform(test).select("prediction").collect()]


def test_search_no_grid_returns_pipeline(spark):
    assert isinstance(build_search("rf", grid_search=False), Pipeline)


def test_unseen_and_missing_categories_are_minus_one(spark):
    train = spark.createDataFrame([(1.0, "b"), (3.0, "a"), (None, "b")], "x double, c string")
    test = spark.createDataFrame([(1, 2.0, "a"), (2, None, "zz"), (3, 2.0, None)], "id int, x double, c string")
    out = Pipeline(stages=make_preprocessor("rf", ["x"], ["c"])).fit(train).transform(test)
    assert {r.id: r.features.toArray().tolist() for r in out.collect()} == {1: [2.0, 0.0], 2: [2.0, -1.0], 3: [2.0, -1.0]}
    onehot = Pipeline(stages=make_preprocessor("lr", ["x"], ["c"])).fit(train).transform(test)
    assert [r.features.toArray().tolist()[1:] for r in onehot.orderBy("id").collect()] == [[1.0, 0.0], [0.0, 0.0], [0.0, 0.0]]


def test_cross_validation_counts_validation_rows_once(spark):
    # nine rows of one class and one of the other in each fold: always answering the majority gives 0.9
    rows = [(i, 0.0, int(i % 10 == 0), i // 10) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, x double, label int, fold int")
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    stages = [VectorAssembler(inputCols=["x"], outputCol="features")]
    est = RandomForestClassifier(labelCol="label", numTrees=1, maxDepth=1, seed=1)
    model, got = cross_val_accuracy(stages, est, df)
    assert sorted((t, f) for t, f, _ in got) == [(0, f) for f in range(4)]
    assert all(a in (0.1, 0.9) for _, _, a in got) and model.transform(df).count() == 40
    with pytest.raises(ValueError):
        cross_val_accuracy(stages, est, df.limit(0))


def test_rows_without_a_label_stay(spark):
    df = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, None)], "id int, label int")
    assert {r.id: r.weight for r in with_balanced_weight(df).collect()} == {1: 0.75, 2: 0.75, 3: 1.5, 4: None}
    assert sorted(r.id for r in replicate_to_balance(df).collect()) == [1, 2, 3, 3, 4]


@pytest.fixture(scope="module")
def views(spark):
    import random

    rng = random.Random(2)
    rows = []
    for i in range(300):
        x, y = rng.uniform(-1, 1), rng.uniform(-1, 1)
        rows.append((x, None if i % 37 == 0 else y, "ab"[i % 2], int(x * y + rng.gauss(0, 0.15) > 0), i % 3))
    df = with_balanced_weight(spark.createDataFrame(rows, "x double, y double, c string, label int, fold int")).coalesce(1).cache()
    return fold_features(df, make_preprocessor("rf", ["x", "y"], ["c"])).cache()


def test_every_fold_has_its_own_statistics(views):
    held = views.collect()
    assert len(held) == 900 and {(r.fold, r.part) for r in held} == {(f, p) for f in range(3) for p in ("train", "valid")}
    for f in range(3):
        train = [r.y for r in held if r.fold == f and r.part == "train" and r.y is not None]
        filled = {r.features[1] for r in held if r.fold == f and r.y is None}
        assert len(filled) == 1 and filled.pop() == pytest.approx(sum(train) / len(train))


def test_first_trees_of_boosting_are_a_smaller_fit(views):
    train, valid = views.where("fold = 0 and part = 'train'"), views.where("fold = 0 and part = 'valid'")
    est = make_estimator("xgb").setMaxIter(6)
    part = first_trees(est.fit(train), 4).transform(valid).select("rawPrediction").collect()
    assert part == make_estimator("xgb").setMaxIter(4).fit(train).transform(valid).select("rawPrediction").collect()


def test_first_trees_of_a_forest_are_their_votes(views):
    train, valid = views.where("fold = 0 and part = 'train'"), views.where("fold = 0 and part = 'valid'")
    model = make_estimator("rf").setNumTrees(7).setMaxDepth(4).fit(train)
    small = first_trees(model, 3)
    assert len(small.trees) == 3
    for r in small.transform(valid).limit(20).collect():
        votes = [t.predictProbability(r.features)[1] for t in model.trees[:3]]
        assert r.probability[1] == pytest.approx(sum(votes) / 3)


@pytest.mark.parametrize("key", ["rf", "xgb", "hgb"])
def test_search_shares_fits_and_keeps_its_candidates(views, key, monkeypatch):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    import vinterra.operators.ml as ml

    candidates = [{"n_estimators": n, "max_depth": d} for n in (2, 5) for d in (2, 3)]
    fits, kind = [], type(make_estimator(key))
    fit = kind._fit
    monkeypatch.setattr(kind, "_fit", lambda self, df: fits.append(1) or fit(self, df))
    got = {(c, f): auc for c, f, auc in ensemble_search(key, views, candidates, parallelism=4)}
    assert len(got) == 12 and len(fits) == 6  # two depths in three folds
    monkeypatch.undo()
    if key != "rf":  # separate fits give the same
        est = make_estimator(key).setMaxIter(2).setMaxDepth(3)
        model = est.fit(views.where("fold = 1 and part = 'train'"))
        auc = BinaryClassificationEvaluator(labelCol="label", numBins=0).evaluate(model.transform(views.where("fold = 1 and part = 'valid'")))
        assert got[1, 1] == pytest.approx(auc)
    assert all(0.4 < auc <= 1 for auc in got.values())
    assert len(ml.grid_candidates("rf")) == 24 and len(ml.grid_candidates("xgb", 200)) == 200 and len(ml.grid_candidates("hgb", 200)) == 4


def test_ordinal_codes_stay_a_table(spark, tmp_out, monkeypatch):
    # the distinct values of a column that grows with the rows are neither collected nor kept in the plan's metadata
    train = spark.createDataFrame([(float(i), f"v{i:03d}", i % 2) for i in range(300)], "x double, c string, label int")
    test = spark.createDataFrame([(0, 1.0, "v000"), (1, 1.0, "v299"), (2, 1.0, "new"), (3, 1.0, None)], "i int, x double, c string")
    want = {0: 0.0, 1: 299.0, 2: -1.0, 3: -1.0}
    codes = lambda df: {r["i"]: r["c__ord"] for r in df.select("i", "c__ord").collect()}
    for stages in (make_preprocessor("rf", ["x"], ["c"]), make_mlp_preprocessor(["x"], ["c"])[0]):
        model = Pipeline(stages=stages).fit(train)
        out = model.transform(test)
        assert codes(out) == want and len(out.schema.json()) < 3000
    path = os.path.join(tmp_out, "codes")
    save_model(model, path)
    assert codes(PipelineModel.load(path).transform(test)) == want
    monkeypatch.setattr(prep, "BROADCAST_BYTES", 100)  # a vocabulary that is not small is merged
    out = model.transform(test)
    assert codes(out) == want and "SortMergeJoin" in out._jdf.queryExecution().executedPlan().toString()


def test_one_hot_slots_are_not_named_in_the_plan(spark, tmp_out):
    rows = [(i, float(i), f"c{i % 40:02d}", int(i % 3 == 0), 1.0) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, x double, c string, label int, weight double")
    model = Pipeline(stages=make_preprocessor("lr", ["x"], ["c"]) + [make_estimator("lr", weight_sum=200.0)]).fit(df)
    out = model.transform(df)
    assert all(len(str(f.metadata)) < 100 for f in out.schema)  # it held a name per category
    assert out.schema["features"].metadata["ml_attr"]["num_attrs"] == 41
    assert [r.features.indices.tolist() for r in out.orderBy("id").limit(3).collect()] == [[0, 1], [0, 2], [0, 3]]
    path = os.path.join(tmp_out, "onehot")
    save_model(model, path)
    score = lambda m: [r.p for r in m.transform(df).orderBy("id").select(probability_of().alias("p")).collect()]
    assert score(PipelineModel.load(path)) == score(model)


def test_search_prepares_each_fold_once(spark, monkeypatch):
    from pyspark.ml.tuning import CrossValidator
    from vinterra.operators import ml

    rows = [(float(i % 17), "abc"[i % 3], int((i * 7) % 17 + i % 3 > 8), 1.0, i % 5) for i in range(200)]
    df = spark.createDataFrame(rows, "x double, c string, label int, weight double, fold int").coalesce(1)
    monkeypatch.setattr(ml, "make_preprocessor", lambda key, make=make_preprocessor: make(key, ["x"], ["c"]))
    fits = []
    scaled = ml.PopulationScaler._fit
    monkeypatch.setattr(ml.PopulationScaler, "_fit", lambda self, d: fits.append(1) or scaled(self, d))
    cv = build_search("lr", weight_sum=160.0)
    got = cv.fit(df)
    assert len(fits) == 6  # five folds and the last fit; one per candidate and fold before
    assert got.avgMetrics == pytest.approx(CrossValidator._fit(cv, df).avgMetrics, abs=1e-6)
    with pytest.raises(ValueError):
        cv.fit(df.where("fold < 4"))


def test_forest_keeps_the_node_of_each_row(spark, views):
    est = make_estimator("rf")
    assert est.getCacheNodeIds()
    train, small = views.where("fold = 0 and part = 'train'"), {est.numTrees: 5}
    trees = [est.fit(train, {**small, est.cacheNodeIds: c}).toDebugString.split("\n", 1)[1] for c in (True, False)]
    assert trees[0] == trees[1]
