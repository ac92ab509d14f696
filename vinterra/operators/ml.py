"""Model training as ``pyspark.ml`` pipelines.

The fits are distributed by ``pyspark.ml`` itself; this module only builds
stages, parameter grids and cross-validation around the modelling table.
Differences to the reference's single-machine libraries are explicit below.
"""

from __future__ import annotations

import itertools
import random
from collections.abc import Sequence
from functools import partial, reduce
from multiprocessing.pool import ThreadPool

from pyspark import SparkContext, inheritable_thread_target, keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassificationModel,
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCol, HasOutputCols
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vinterra.functions._cols import null_safe_join
from vinterra.operators.prep import class_weights, ordinal_codes, sorted_mapping
from vinterra.session import as_table, cut_lineage

# --- fixed values: production column contract and model settings ----------------------
NUM_FEATURES = [
    "GDD", "TM_summer", "TX_summer", "temp_amp_summer", "hot_days", "rainy_days_summer",
    "rain_June", "rain_SepOct", "frost_days_Apr", "avg_TM_Apr", "price",
]
CAT_FEATURES = ["cepages", "region"]
RANDOM_STATE = 100
CV_FOLDS = 5
MLP_HIDDEN = [128, 64]
# Parameter grids by model key: the parameters that have a Spark counterpart.
PARAM_GRIDS = {
    "lr": {"C": [0.01, 0.1, 1.0, 10.0, 100.0], "penalty": ["l2"]},
    "rf": {"n_estimators": [100, 300, 600], "max_depth": [None, 5, 10, 20], "max_features": ["sqrt"],
           "min_samples_leaf": [1, 4], "bootstrap": [True]},
    "xgb": {"n_estimators": [80, 100, 120], "max_depth": [2, 3, 4], "learning_rate": [0.03, 0.05, 0.07],
            "subsample": [0.7, 0.8, 0.9], "colsample_bytree": [0.7, 0.8, 0.9]},
    "hgb": {"learning_rate": [0.05, 0.1], "max_depth": [3, 5]},
}
SPARK_MAX_DEPTH = 30   # Spark trees cannot be unbounded; "None" maps to the maximum
# ---------------------------------------------------------------------------------------------


class _ScalerParams(HasInputCols, HasOutputCols):
    means = Param(Params._dummy(), "means", "column means", typeConverter=TypeConverters.toListFloat)
    stds = Param(Params._dummy(), "stds", "column population std devs", typeConverter=TypeConverters.toListFloat)


class PopulationScaler(Estimator, _ScalerParams, DefaultParamsReadable, DefaultParamsWritable):
    """``(x - mean) / std`` with the population std (``StandardScaler`` in
    ``pyspark.ml`` divides by the sample std).  Statistics: one aggregate."""

    @keyword_only
    def __init__(self, inputCols=None, outputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "PopulationScalerModel":
        cols = self.getInputCols()
        row = dataset.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
                          *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)]).first()
        model = PopulationScalerModel()
        model._set(inputCols=cols, outputCols=self.getOutputCols(),
                   means=[float(row[f"m{i}"] or 0.0) for i in range(len(cols))],
                   stds=[float(row[f"s{i}"] or 0.0) or 1.0 for i in range(len(cols))])
        return model


class PopulationScalerModel(Model, _ScalerParams, DefaultParamsReadable, DefaultParamsWritable):
    def __init__(self):
        super().__init__()

    def _transform(self, dataset: DataFrame) -> DataFrame:
        ins, outs = self.getInputCols(), self.getOutputCols()
        ms, ss = self.getOrDefault(self.means), self.getOrDefault(self.stds)
        return dataset.withColumns({o: (F.col(i) - F.lit(m)) / F.lit(sd) for i, o, m, sd in zip(ins, outs, ms, ss)})


class OrdinalIndexer(Estimator, HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Sorted ordinal codes as plain numbers without nominal metadata; unseen and NULL values are -1.

    ``StringIndexer`` collects the distinct values and repeats them in the metadata of every plan, all in
    the driver; here they are numbered by Spark and stay a table."""

    @keyword_only
    def __init__(self, inputCols=None, outputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "OrdinalIndexerModel":
        cols = self.getInputCols()
        model = OrdinalIndexerModel(as_table(sorted_mapping(dataset, cols), "category-codes"))
        return model._set(inputCols=cols, outputCols=self.getOutputCols())


class OrdinalIndexerModel(Model, HasInputCols, HasOutputCols, MLReadable, MLWritable):
    """``codes``: the table ``(column, value, code)``; it is saved with the model."""

    def __init__(self, codes: DataFrame | None = None):
        super().__init__()
        self.codes = codes

    def _transform(self, dataset: DataFrame) -> DataFrame:
        ins, outs = self.getInputCols(), self.getOutputCols()
        coded = ordinal_codes(dataset, self.codes, ins, suffix="__code")
        return coded.withColumns(
            {o: F.coalesce(F.col(f"{i}__code"), F.lit(-1)).cast("double") for i, o in zip(ins, outs)}
        ).drop(*[f"{i}__code" for i in ins])

    def write(self) -> "_CodesWriter":
        return _CodesWriter(self)

    @classmethod
    def read(cls) -> "_CodesReader":
        return _CodesReader(cls)


class _CodesWriter(DefaultParamsWriter):
    def saveImpl(self, path: str) -> None:
        super().saveImpl(path)
        self.instance.codes.write.parquet(f"{path.rstrip('/')}/codes")


class _CodesReader(DefaultParamsReader):
    def load(self, path: str) -> OrdinalIndexerModel:
        model = super().load(path)
        model.codes = self.sparkSession.read.parquet(f"{path.rstrip('/')}/codes")
        return model


class _OneHotParams(HasInputCols, HasOutputCol):
    codeCols = Param(Params._dummy(), "codeCols", "columns of category codes, -1 for none", typeConverter=TypeConverters.toListString)
    sizes = Param(Params._dummy(), "sizes", "categories of each code column", typeConverter=TypeConverters.toListInt)


class OneHotAssembler(Estimator, _OneHotParams, DefaultParamsReadable, DefaultParamsWritable):
    """Numbers followed by a 0/1 slot per category, as a sparse vector; the code -1 has no slot.

    ``OneHotEncoder`` and ``VectorAssembler`` name every slot in the metadata of every plan; here the vector
    has its length only."""

    @keyword_only
    def __init__(self, inputCols=None, codeCols=None, outputCol=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "OneHotAssemblerModel":
        cols = self.getOrDefault(self.codeCols)
        top = dataset.agg(*[F.max(c).alias(f"c{i}") for i, c in enumerate(cols)]).first() if cols else []
        model = OneHotAssemblerModel()
        return model._set(inputCols=self.getInputCols(), codeCols=cols, outputCol=self.getOutputCol(),
                          sizes=[0 if t is None else int(t) + 1 for t in top])


class OneHotAssemblerModel(Model, _OneHotParams, DefaultParamsReadable, DefaultParamsWritable):
    def __init__(self):
        super().__init__()

    def _transform(self, dataset: DataFrame) -> DataFrame:
        numbers, codes, sizes = self.getInputCols(), self.getOrDefault(self.codeCols), self.getOrDefault(self.sizes)
        n = len(numbers)
        starts = [n + sum(sizes[:i]) for i in range(len(sizes))]
        width, places = n + sum(sizes), list(range(n))

        @F.udf(VectorUDT())
        def assembled(x, code):
            at = [start + int(c) for start, c, size in zip(starts, code, sizes) if 0 <= c < size]
            return SparseVector(width, places + at, [float("nan") if v is None else v for v in x] + [1.0] * len(at))

        doubles = lambda cols: F.array(*[F.col(c).cast("double") for c in cols]).cast("array<double>")
        return dataset.withColumn(self.getOutputCol(), assembled(doubles(numbers), doubles(codes)).alias("v", metadata={"ml_attr": {"num_attrs": width}}))


# M11 ------------------------------------------------------------------------------------------
def make_preprocessor(model_key: str, num_cols: Sequence[str] = NUM_FEATURES, cat_cols: Sequence[str] = CAT_FEATURES,
                      features: str = "features") -> list:
    """``lr``: mean imputation + population scaling + one-hot (unknown -> all
    zeros); other keys: mean imputation + sorted ordinal codes.  Missing input
    columns fail at fit time, as in the reference."""
    imputed = [f"{c}__imp" for c in num_cols]
    stages: list = [Imputer(inputCols=list(num_cols), outputCols=imputed, strategy="mean")]
    if model_key == "lr":
        idx = [f"{c}__idx" for c in cat_cols]
        scaled = [f"{c}__z" for c in num_cols]
        stages += [
            OrdinalIndexer(inputCols=list(cat_cols), outputCols=idx),
            PopulationScaler(inputCols=imputed, outputCols=scaled),
            OneHotAssembler(inputCols=scaled, codeCols=idx, outputCol=features),
        ]
    else:
        # ordinal codes as plain numbers (no nominal metadata): trees split on
        # them like on any number, as with an ordinal encoder
        ordinal = [f"{c}__ord" for c in cat_cols]
        stages += [
            OrdinalIndexer(inputCols=list(cat_cols), outputCols=ordinal),
            VectorAssembler(inputCols=imputed + ordinal, outputCol=features, handleInvalid="keep"),
        ]
    return stages


def make_mlp_preprocessor(num_cols: Sequence[str] = NUM_FEATURES, cat_cols: Sequence[str] = CAT_FEATURES,
                          features: str = "features") -> tuple[list, int]:
    """Network inputs: imputed numbers and ordinal category codes, all scaled
    with the population std.  Returns (stages, number of features)."""
    imputed = [f"{c}__imp" for c in num_cols]
    ordinal = [f"{c}__ord" for c in cat_cols]
    scaled = [f"{c}__z" for c in imputed + ordinal]
    stages = [
        Imputer(inputCols=list(num_cols), outputCols=imputed, strategy="mean"),
        OrdinalIndexer(inputCols=list(cat_cols), outputCols=ordinal),
        PopulationScaler(inputCols=imputed + ordinal, outputCols=scaled),
        VectorAssembler(inputCols=scaled, outputCol=features, handleInvalid="keep"),
    ]
    return stages, len(scaled)


# M12 ------------------------------------------------------------------------------------------
def ridge(c: float, weight_sum: float) -> float:
    """Spark's ``regParam`` for an inverse penalty ``c`` on the *sum* of weighted losses: Spark
    penalises their weighted mean, so it is ``1 / (c * sum of weights)``."""
    return 1.0 / (c * weight_sum)


def make_estimator(model_key: str, label: str = "label", weight: str = "weight", features: str = "features", weight_sum: float | None = None):
    """``lr`` logistic regression (balanced weights, 1000 iterations, C = 1, which needs the sum of
    the training weights -- the row count, for balanced ones); ``rf`` 200-tree forest (balanced,
    depth 30, the deepest Spark grows); ``xgb`` 200 boosted depth-3 trees, step 0.1,
    row/feature subsampling 0.8; anything else: boosted trees with balanced
    weights (histogram boosting's defaults: 100 iterations, step 0.1)."""
    common = {"labelCol": label, "featuresCol": features}
    if model_key == "lr":
        if weight_sum is None:
            raise ValueError("lr needs weight_sum, the sum of the training weights")
        return LogisticRegression(maxIter=1000, weightCol=weight, regParam=ridge(1.0, weight_sum), standardization=False, **common)
    if model_key == "rf":
        # rows keep their node of each tree: without, every level walks all rows through all trees from the root
        return RandomForestClassifier(numTrees=200, maxDepth=SPARK_MAX_DEPTH, weightCol=weight, seed=RANDOM_STATE, cacheNodeIds=True, **common)
    if model_key == "xgb":
        return GBTClassifier(maxIter=200, stepSize=0.1, maxDepth=3, subsamplingRate=0.8,
                             featureSubsetStrategy="0.8", seed=RANDOM_STATE, **common)
    return GBTClassifier(maxIter=100, stepSize=0.1, maxDepth=5, weightCol=weight, seed=RANDOM_STATE, **common)


def with_balanced_weight(df: DataFrame, label: str = "label", weight: str = "weight") -> DataFrame:
    """sklearn's ``class_weight='balanced'`` as a column: n / (k * count(class))."""
    w = class_weights(df, label).select(label, F.col("balanced_weight").alias(weight))
    return null_safe_join(df, w, [label], "left")  # rows without a label keep a NULL weight


# M13 ------------------------------------------------------------------------------------------
def _spark_params(model_key: str, est, weight_sum: float | None = None, grid: dict | None = None) -> dict:
    """Search grid -> {Spark Param: values}, unsupported parameters dropped."""
    grid = grid or PARAM_GRIDS.get(model_key, PARAM_GRIDS["hgb"])
    out: dict = {}
    for name, values in grid.items():
        if name == "C":
            out[est.regParam] = [ridge(v, weight_sum) for v in values]
        elif name == "penalty":
            out[est.elasticNetParam] = [0.0 if v == "l2" else 1.0 for v in values]
        elif name == "n_estimators":
            out[est.numTrees if model_key == "rf" else est.maxIter] = list(values)
        elif name == "max_depth":
            out[est.maxDepth] = [SPARK_MAX_DEPTH if v is None else v for v in values]
        elif name == "max_features":
            out[est.featureSubsetStrategy] = list(values)
        elif name == "min_samples_leaf":
            out[est.minInstancesPerNode] = list(values)
        elif name == "bootstrap":
            out[est.bootstrap] = list(values)
        elif name == "learning_rate":
            out[est.stepSize] = list(values)
        elif name == "subsample":
            out[est.subsamplingRate] = list(values)
        elif name == "colsample_bytree":
            out[est.featureSubsetStrategy] = [str(v) for v in values]
    return out


def param_maps(model_key: str, est, search_type: str = "grid", n_iter: int = 50, seed: int = RANDOM_STATE,
               weight_sum: float | None = None) -> list:
    """Full grid, or ``min(n_iter, grid size)`` maps drawn without replacement
    (seeded) for ``search_type='random'``; any other type means grid."""
    params = _spark_params(model_key, est, weight_sum)
    builder = ParamGridBuilder()
    for p, vals in params.items():
        builder = builder.addGrid(p, vals)
    grid = builder.build()
    if search_type == "random":
        rng = random.Random(seed)
        return rng.sample(grid, min(n_iter, len(grid)))
    return grid


class FoldSearch(CrossValidator):
    """``CrossValidator`` of a pipeline whose last stage alone is searched: every fold's preprocessing is fitted
    once and its features are written once for all parameter maps.  Without a fold column, Spark's own search."""

    def _fit(self, dataset: DataFrame) -> CrossValidatorModel:
        pipe, maps, evaluator, fold_col = self.getEstimator(), self.getEstimatorParamMaps(), self.getEvaluator(), self.getFoldCol()
        *stages, est = pipe.getStages()
        if not fold_col or not all(p.parent == est.uid for m in maps for p in m):
            return super()._fit(dataset)
        views = as_table(fold_features(dataset, stages, fold_col, est.getFeaturesCol()), "fold-features", "fold", "part")
        folds = sorted(r[0] for r in views.select("fold").distinct().collect())
        if folds != list(range(self.getNumFolds())):
            raise ValueError(f"rows of all folds 0 to {self.getNumFolds() - 1} are needed, found {folds}")

        def scored(job):
            fold, chosen = job
            part = lambda name: views.where((F.col("fold") == fold) & (F.col("part") == name))
            return evaluator.evaluate(est.fit(part("train"), chosen).transform(part("valid")))

        with ThreadPool(min(self.getParallelism(), len(maps))) as pool:
            rows = pool.map(inheritable_thread_target(dataset.sparkSession)(scored), [(f, m) for f in folds for m in maps], chunksize=1)
        mean = [sum(rows[t :: len(maps)]) / len(folds) for t in range(len(maps))]
        best = (max if evaluator.isLargerBetter() else min)(range(len(maps)), key=lambda t: mean[t])
        return self._copyValues(CrossValidatorModel(pipe.fit(dataset, maps[best]), mean))


def build_search(model_key: str, grid_search: bool = True, search_type: str = "grid", n_iter: int = 50,
                 fold_col: str | None = "fold", parallelism: int = 4, label: str = "label", weight_sum: float | None = None):
    """Pipeline (preprocessing + estimator), optionally wrapped in a 5-fold
    ROC-AUC cross-validated search (``foldCol`` = the stratified folds).  ``weight_sum`` is that of
    the rows a fold trains on; only ``lr`` uses it."""
    est = make_estimator(model_key, label=label, weight_sum=weight_sum)
    pipe = Pipeline(stages=make_preprocessor(model_key) + [est])
    if not grid_search:
        return pipe
    evaluator = BinaryClassificationEvaluator(labelCol=label, metricName="areaUnderROC", numBins=0)
    cv = FoldSearch(estimator=pipe, estimatorParamMaps=param_maps(model_key, est, search_type, n_iter, weight_sum=weight_sum),
                    evaluator=evaluator, numFolds=CV_FOLDS, parallelism=parallelism, seed=RANDOM_STATE)
    if fold_col:
        cv = cv.setFoldCol(fold_col)
    return cv


def fold_features(df: DataFrame, stages: list, fold_col: str = "fold", features: str = "features", parallelism: int = CV_FOLDS) -> DataFrame:
    """Every fold's view of ``df``: all rows with ``part`` (``valid`` in the fold, else ``train``) and the
    ``features`` of preprocessing ``stages`` fitted on the fold's training rows, once for all models."""
    folds = [r[0] for r in df.select(fold_col).distinct().orderBy(fold_col).collect()]  # a handful
    if not folds:
        raise ValueError("cross-validation needs at least one row")

    def prepared(fold):
        out = Pipeline(stages=stages).fit(df.where(F.col(fold_col) != fold)).transform(df)
        part = F.when(F.col(fold_col) == fold, "valid").otherwise("train").alias("part")
        kept = [F.col(c) for c in df.columns if c not in ("fold", "part", features)]
        return out.select(F.lit(int(fold)).alias("fold"), part, *kept, features)

    with ThreadPool(parallelism) as pool:
        views = pool.map(inheritable_thread_target(df.sparkSession)(prepared), folds)
    return reduce(DataFrame.unionByName, views)


def first_trees(model, k: int):
    """The ensemble of a forest's or boosted model's first ``k`` trees.

    Boosting adds trees one after the other, so this is the model that a fit of ``k`` trees gives; the
    trees of a forest are drawn alike, so it is a forest of ``k`` trees (not the same trees as a separate
    fit, which draws its samples in another order)."""
    boosted = isinstance(model, GBTClassificationModel)
    context, java = SparkContext._active_spark_context, model._java_obj
    jvm = context._jvm.org.apache.spark.ml
    kind = jvm.regression.DecisionTreeRegressionModel if boosted else jvm.classification.DecisionTreeClassificationModel
    trees, all_trees = context._gateway.new_array(kind, k), java.trees()
    for i in range(k):
        trees[i] = all_trees[i]
    if boosted:
        weights = context._gateway.new_array(context._jvm.double, k)
        for i, w in enumerate(model.treeWeights[:k]):
            weights[i] = w
        out = GBTClassificationModel(jvm.classification.GBTClassificationModel(java.uid(), trees, weights, model.numFeatures, model.numClasses))
    else:
        out = RandomForestClassificationModel(jvm.classification.RandomForestClassificationModel(java.uid(), trees, model.numFeatures, model.numClasses))
    return out.setFeaturesCol(model.getFeaturesCol())


def ensemble_search(model_key: str, views: DataFrame, candidates: list[dict], label: str = "label", parallelism: int = 8) -> list[tuple]:
    """Rows ``(candidate, fold, auc)`` of tree ensembles over the ``fold_features`` of all folds.

    Candidates (dicts by names of the search grid) that differ in the number of trees only share one fit
    with the most trees, whose first trees are scored for the others.  A fold without both classes
    among its validation rows has no AUC (NULL)."""
    views = as_table(views, "fold-features", "fold", "part")
    folds = [r[0] for r in views.select("fold").distinct().orderBy("fold").collect()]
    evaluator = BinaryClassificationEvaluator(labelCol=label, metricName="areaUnderROC", numBins=0)
    est = make_estimator(model_key, label=label)
    trees = est.numTrees if model_key == "rf" else est.maxIter
    groups: dict[tuple, list[int]] = {}
    for i, c in enumerate(candidates):
        groups.setdefault(tuple(sorted((n, v) for n, v in c.items() if n != "n_estimators" and v is not None)), []).append(i)

    def scored(job):
        fold, members = job
        params = {n: [v] for n, v in candidates[members[0]].items()}
        size = {i: candidates[i].get("n_estimators", est.getOrDefault(trees)) for i in members}
        chosen = {p: v[0] for p, v in _spark_params(model_key, est, grid=params).items()}
        model = est.fit(views.where((F.col("fold") == fold) & (F.col("part") == "train")), {**chosen, trees: max(size.values())})
        valid = views.where((F.col("fold") == fold) & (F.col("part") == "valid"))
        both = valid.agg(F.count_distinct(label)).first()[0] > 1
        return [(i, fold, evaluator.evaluate(first_trees(model, min(k, len(model.treeWeights))).transform(valid)) if both else None) for i, k in size.items()]

    jobs = [(fold, members) for members in groups.values() for fold in folds]
    with ThreadPool(parallelism) as pool:
        rows = pool.map(inheritable_thread_target(views.sparkSession)(scored), jobs)
    return sorted(r for found in rows for r in found)


def grid_candidates(model_key: str, n_iter: int | None = None, seed: int = RANDOM_STATE) -> list[dict]:
    """The search grid's combinations as dicts, or ``n_iter`` of them drawn without replacement."""
    grid = PARAM_GRIDS.get(model_key, PARAM_GRIDS["hgb"])
    out = [dict(zip(grid, values)) for values in itertools.product(*grid.values())]
    return out if n_iter is None or n_iter >= len(out) else random.Random(seed).sample(out, n_iter)


# M15 ------------------------------------------------------------------------------------------
def replicate_to_balance(df: DataFrame, label: str = "label") -> DataFrame:
    """The MLP has no ``weightCol``: rows of class c are repeated
    ``round(weight_c / min weight)`` times (distributed ``explode``)."""
    w = class_weights(df, label).select(label, "balanced_weight")
    wmin = w.select(F.min("balanced_weight")).scalar()
    reps = F.greatest(F.round(F.col("balanced_weight") / wmin).cast("int"), F.lit(1))
    # rows without a label stay once
    j = df.join(w, label, "left").withColumn("balanced_weight", F.coalesce("balanced_weight", wmin))
    return j.withColumn("_rep", F.explode(F.array_repeat(F.lit(1), reps))).drop("_rep", "balanced_weight")


def make_mlp(n_features: int, label: str = "label", features: str = "features", max_iter: int = 200,
             hidden: Sequence[int] = MLP_HIDDEN, n_classes: int = 2) -> MultilayerPerceptronClassifier:
    """Hidden layers [128, 64]; Spark's layers are sigmoid (not ReLU), no dropout."""
    return MultilayerPerceptronClassifier(layers=[n_features, *hidden, n_classes], maxIter=max_iter, seed=RANDOM_STATE,
                                          labelCol=label, featuresCol=features)


# M16 ------------------------------------------------------------------------------------------
def cross_val_accuracy(pipeline_stages: list, estimator, df: DataFrame, fold_col: str = "fold", label: str = "label",
                       param_maps_: list | None = None, parallelism: int = 4):
    """Validation accuracy over the folds of ``fold_col``: ``(best model, rows (trial, fold, accuracy))``.

    Classes are balanced by replicating *training* rows only; every validation row counts once.
    ``parallelism`` fits run at a time.  The trial with the best mean is fitted again on all rows.
    Raises on an empty input."""
    if df.isEmpty():
        raise ValueError("cross-validation needs at least one row")
    pipe = Pipeline(stages=list(pipeline_stages) + [estimator])
    evaluator = MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy")
    maps = param_maps_ or [{}]
    folds = [r[0] for r in df.select(fold_col).distinct().orderBy(fold_col).collect()]  # a handful
    train = {f: cut_lineage(replicate_to_balance(df.where(F.col(fold_col) != f), label)) for f in folds}

    def accuracy(fold, trial):
        model = pipe.fit(train[fold], maps[trial])
        return trial, int(fold), float(evaluator.evaluate(model.transform(df.where(F.col(fold_col) == fold))))

    inherit = inheritable_thread_target(df.sparkSession)
    jobs = [inherit(partial(accuracy, f, t)) for t in range(len(maps)) for f in folds]
    with ThreadPool(parallelism) as pool:
        rows = pool.map(lambda job: job(), jobs)
    mean = [sum(r[2] for r in rows if r[0] == t) / len(folds) for t in range(len(maps))]
    best = max(range(len(maps)), key=lambda t: (mean[t], -t))
    return pipe.fit(cut_lineage(replicate_to_balance(df, label)), maps[best]), rows


# W7 -------------------------------------------------------------------------------------------
def feature_names(df: DataFrame, features: str = "features") -> list[str]:
    """Slot names from the assembler's ML attribute metadata."""
    meta = df.schema[features].metadata.get("ml_attr", {})
    names: dict[int, str] = {}
    for group in meta.get("attrs", {}).values():
        for a in group:
            names[a["idx"]] = a.get("name", f"f{a['idx']}")
    size = meta.get("num_attrs", len(names))
    return [names.get(i, f"f{i}") for i in range(size)]


def top_importances(spark, model, names: Sequence[str], k: int = 10) -> DataFrame:
    """Top-k feature importances (descending, ties by index) -- the vector has
    one entry per feature, so it is small by construction."""
    imp = model.featureImportances.toArray().tolist()
    rows = [(i, names[i] if i < len(names) else f"f{i}", float(v)) for i, v in enumerate(imp)]
    df = spark.createDataFrame(rows, "idx int, feature string, importance double")
    return df.orderBy(F.col("importance").desc(), "idx").limit(k)


# S10 ------------------------------------------------------------------------------------------
def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_pipeline_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def probability_of(col: str = "probability", cls: int = 1):
    return vector_to_array(F.col(col))[cls]


def grid_size(model_key: str) -> int:
    grid = PARAM_GRIDS.get(model_key, PARAM_GRIDS["hgb"])
    return len(list(itertools.product(*grid.values())))
