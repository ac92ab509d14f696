"""Evaluation queries.

Scored rows: labelled documents (``labels.quality``) with a score that is a
fixed function of ``n_chars``; per fold ``f`` a different such function.
Logits: component ``i`` of ``embeddings.embedding`` adds to class ``i % 10``.
Training histories: ``events`` by user fold and day.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from vinterra.operators.evaluate import (
    MIN_RECALL,
    accuracy_f1,
    argmax,
    best_epoch,
    classification_report,
    confusion_counts,
    cross_entropy,
    cross_val_mean,
    evaluate_metrics,
    focal_loss,
    fold_ensemble,
    fold_mean_history,
    model_comparison,
    precision_floor_threshold,
    roc_auc,
    softmax,
)
from vinterra.operators.prep import class_weights, stratified_folds
from vinterra.plans.registry import query, rounded
from vinterra.sources.tables import table

K = 5
SEED = 100
N_CLASSES = 10


def _score(f: int | None = None):
    mult = 7919 if f is None else 7919 + 104729 * f
    return (F.pmod(F.col("n_chars") * mult + F.col("doc_id") * 31, F.lit(1000))).cast("double") / 1000.0


def _score_sql(f: int | None = None) -> str:
    mult = 7919 if f is None else 7919 + 104729 * f
    return f"(CAST((n_chars * {mult} + doc_id * 31) % 1000 AS DOUBLE) / 1000.0)"


def scored_docs(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    lab = table(spark, d, "labels").select("doc_id", F.col("quality").alias("y_true"))
    s = docs.join(lab, "doc_id").withColumn("y_proba", _score())
    return s.withColumn("y_pred", (F.col("y_proba") >= 0.5).cast("int"))


_SCORED_SQL = f"""sc AS (
  SELECT d.doc_id, d.n_chars, l.quality AS y_true, {_score_sql()} AS y_proba,
         CAST({_score_sql()} >= 0.5 AS INTEGER) AS y_pred
  FROM documents d JOIN labels l USING (doc_id))"""


def _auc_sql(src: str, group: str = "") -> str:
    g = f"{group}, " if group else ""
    part = f"PARTITION BY {group} " if group else ""
    return f"""(SELECT {g}sum(pos * (cn - neg + neg / 2.0)) / (sum(pos) * sum(neg)) AS auc FROM (
      SELECT {g}pos, neg, sum(neg) OVER ({part}ORDER BY score ROWS UNBOUNDED PRECEDING) AS cn FROM (
        SELECT {g}y_proba AS score, count_if(y_true = 1) AS pos, count_if(y_true <> 1) AS neg FROM {src} GROUP BY {g}y_proba))
      {('GROUP BY ' + group) if group else ''})"""


# E1-E3 ---------------------------------------------------------------------------------------
@query(
    "accuracy_f1_auc",
    f"""WITH {_SCORED_SQL},
        af AS (SELECT avg(CAST(y_true = y_pred AS DOUBLE)) AS accuracy,
                      CASE WHEN 2 * count_if(y_true = 1 AND y_pred = 1) + count_if(y_true = 0 AND y_pred = 1) + count_if(y_true = 1 AND y_pred = 0) > 0
                           THEN 2.0 * count_if(y_true = 1 AND y_pred = 1) / (2 * count_if(y_true = 1 AND y_pred = 1) + count_if(y_true = 0 AND y_pred = 1) + count_if(y_true = 1 AND y_pred = 0))
                           ELSE 0.0 END AS f1 FROM sc)
        SELECT round(accuracy, 6) AS accuracy, round(f1, 6) AS f1, round((SELECT auc FROM {_auc_sql('sc')}), 6) AS auc FROM af""",
)
def accuracy_f1_auc(spark, d):
    return rounded(evaluate_metrics(scored_docs(spark, d)))


# E4 ------------------------------------------------------------------------------------------
@query(
    "confusion",
    f"""WITH {_SCORED_SQL}
        SELECT CAST(count_if(y_true = 0 AND y_pred = 0) AS BIGINT) AS tn, CAST(count_if(y_true = 0 AND y_pred = 1) AS BIGINT) AS fp,
               CAST(count_if(y_true = 1 AND y_pred = 0) AS BIGINT) AS fn, CAST(count_if(y_true = 1 AND y_pred = 1) AS BIGINT) AS tp FROM sc""",
)
def confusion(spark, d):
    return confusion_counts(scored_docs(spark, d))


# logits ----------------------------------------------------------------------------------------
def logits_table(spark, d, n: int = N_CLASSES):
    """Logits of ``n`` classes from all components: component ``i`` adds to class ``i % n``."""
    e = table(spark, d, "embeddings")
    part = lambda c: F.filter("embedding", lambda x, i: i % n == c)
    lg = F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda c: F.aggregate(part(c), F.lit(0.0), lambda acc, x: acc + x.cast("double")),
    )
    return e.select("vec_id", F.col("label").cast("int").alias("label"), lg.alias("logits"))


def _logits_sql(n: int = N_CLASSES) -> str:
    return f"""lg AS (
  SELECT vec_id, CAST(label AS INTEGER) AS label, lgt, list_max(lgt) AS m
  FROM (SELECT vec_id, label, list_transform(range({n}), lambda c:
          list_sum(list_transform(range(c + 1, len(embedding) + 1, {n}), lambda i: CAST(embedding[i] AS DOUBLE)))) AS lgt FROM embeddings))"""


_LSE_SQL = "(m + ln(list_sum(list_transform(lgt, lambda x: exp(x - m)))))"


# E5 ------------------------------------------------------------------------------------------
@query(
    "class_report",
    f"""WITH {_logits_sql()},
        p AS (SELECT label AS y, CAST(list_position(lgt, m) - 1 AS INTEGER) AS yhat FROM lg),
        cl AS (SELECT y AS c FROM p UNION SELECT yhat FROM p),
        per AS (
          SELECT c, count_if(p.y = c AND p.yhat = c) AS tp, count_if(p.y = c) AS support, count_if(p.yhat = c) AS predicted
          FROM cl, p GROUP BY c),
        pr AS (SELECT c, tp, support,
                      CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS precision,
                      CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall FROM per),
        f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM pr)
        SELECT CAST(c AS VARCHAR) AS "row", round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
               CAST(support AS BIGINT) AS support FROM f
        UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(tp) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f
        UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM f
        UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
                         round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f""",
)
def class_report(spark, d):
    lg = logits_table(spark, d).select(F.col("label").alias("y_true"), argmax("logits").alias("y_pred"))
    return rounded(classification_report(lg))


# E6 ------------------------------------------------------------------------------------------
def _fold_scores(spark, d):
    """Validation scores: every labelled document is scored in its own fold by
    that fold's scoring function."""
    base = stratified_folds(scored_docs(spark, d).select("doc_id", "n_chars", "y_true"), "y_true", "doc_id", K, SEED)
    score = F.lit(None).cast("double")
    for f in range(K):
        score = F.when(F.col("fold") == f, _score(f)).otherwise(score)
    return base.withColumn("y_proba", score)


_FOLDS_SQL = f"""{_SCORED_SQL},
fo AS (SELECT doc_id, n_chars, y_true,
              CAST((row_number() OVER (PARTITION BY y_true ORDER BY md5('{SEED}:' || CAST(doc_id AS VARCHAR)), doc_id) - 1) % {K} AS INTEGER) AS fold
       FROM sc),
fs AS (SELECT doc_id, y_true, fold, CASE {' '.join(f'WHEN fold = {f} THEN {_score_sql(f)}' for f in range(K))} END AS y_proba FROM fo),
cnt AS (SELECT fold, y_proba AS score, count_if(y_true = 1) AS pos, count_if(y_true <> 1) AS neg FROM fs GROUP BY 1, 2),
cur AS (SELECT fold, score,
               sum(pos) OVER (PARTITION BY fold ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp,
               sum(neg) OVER (PARTITION BY fold ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS fp,
               sum(pos) OVER (PARTITION BY fold) AS p FROM cnt),
pc AS (SELECT fold, score, tp / (tp + fp) AS precision, CASE WHEN p > 0 THEN tp / p ELSE 1.0 END AS recall FROM cur),
best AS (SELECT fold, score, precision, recall,
                row_number() OVER (PARTITION BY fold ORDER BY precision DESC, score) AS rn FROM pc WHERE recall >= {MIN_RECALL}),
thr AS (SELECT k.fold, coalesce(b.score, 0.5) AS threshold, b.precision, b.recall
        FROM (SELECT DISTINCT fold FROM fs) k LEFT JOIN best b ON b.fold = k.fold AND b.rn = 1)"""


def _thresholds(spark, d):
    return precision_floor_threshold(_fold_scores(spark, d), group=["fold"])


@query(
    "pr_threshold",
    f"""WITH {_FOLDS_SQL}
        SELECT fold, round(threshold, 6) AS threshold, round(precision, 6) AS precision, round(recall, 6) AS recall FROM thr""",
)
def pr_threshold(spark, d):
    return rounded(_thresholds(spark, d).select("fold", "threshold", "precision", "recall"))


# M18 / E7 ------------------------------------------------------------------------------------
@query(
    "fold_ensemble",
    f"""WITH {_FOLDS_SQL},
        med AS (SELECT median(threshold) AS t FROM thr),
        pm AS (SELECT doc_id, ({' + '.join(_score_sql(f) for f in range(K))}) / {K}.0 AS p_mean FROM sc)
        SELECT doc_id, round(p_mean, 6) AS p_mean, round(med.t, 6) AS threshold, CAST(p_mean >= med.t AS INTEGER) AS y_pred
        FROM pm, med""",
)
def fold_ensemble_q(spark, d):
    docs = scored_docs(spark, d).select("doc_id", "n_chars")
    per_fold = docs.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(K - 1))))
    score = F.lit(None).cast("double")
    for f in range(K):
        score = F.when(F.col("fold") == f, _score(f)).otherwise(score)
    test_scores = per_fold.withColumn("y_proba", score)
    return rounded(fold_ensemble(test_scores, _thresholds(spark, d), "doc_id"))


# Histories from events --------------------------------------------------------
def history(spark, d):
    e = table(spark, d, "events")
    fold = F.pmod(F.col("user_id"), F.lit(K)).cast("int")
    epoch = F.dayofmonth("ts")
    tr = F.col("event_type").isin("view", "click")
    h = e.groupBy(fold.alias("fold"), epoch.alias("epoch")).agg(
        F.avg(F.when(tr, F.col("value"))).alias("train_acc"), F.avg(F.when(~tr, F.col("value"))).alias("valid_acc")
    )
    return h.withColumn("model", F.lit("mlp"))


_HIST_SQL = f"""hist AS (
  SELECT * FROM (
    SELECT 'mlp' AS model, CAST(user_id % {K} AS INTEGER) AS fold, CAST(dayofmonth(ts) AS INTEGER) AS epoch,
           avg(CASE WHEN event_type IN ('view', 'click') THEN value END) AS train_acc,
           avg(CASE WHEN event_type NOT IN ('view', 'click') THEN value END) AS valid_acc
    FROM events GROUP BY 2, 3))"""


@query(
    "fold_history",
    f"""WITH {_HIST_SQL}
        SELECT model, epoch, count(*) AS n_folds, round(avg(train_acc), 6) AS train_acc, round(avg(valid_acc), 6) AS valid_acc
        FROM hist GROUP BY model, epoch""",
)
def fold_history(spark, d):
    return rounded(fold_mean_history(history(spark, d)))


_BEST_SQL = f"""{_HIST_SQL},
best AS (SELECT model, fold, arg_min(epoch, (-valid_acc, epoch)) AS best_epoch, max(valid_acc) AS best_value
         FROM hist WHERE valid_acc IS NOT NULL GROUP BY model, fold)"""


@query(
    "best_epoch",
    f"WITH {_BEST_SQL} SELECT model, fold, best_epoch, round(best_value, 6) AS best_value FROM best",
)
def best_epoch_q(spark, d):
    h = history(spark, d).where(F.col("valid_acc").isNotNull())
    return rounded(best_epoch(h))


@query(
    "cv_mean",
    f"WITH {_BEST_SQL} SELECT model, round(avg(best_value), 6) AS mean_best, count(*) AS n_folds FROM best GROUP BY model",
)
def cv_mean(spark, d):
    h = history(spark, d).where(F.col("valid_acc").isNotNull())
    return rounded(cross_val_mean(best_epoch(h)))


# E9 ------------------------------------------------------------------------------------------
def _event_scores(spark, d):
    e = table(spark, d, "events")
    score = F.get_json_object("props", "$.k").cast("double") / 100.0
    return e.select(
        F.col("event_type").alias("model"), (F.col("value") > 100).cast("int").alias("y_true"), score.alias("y_proba")
    ).withColumn("y_pred", (F.col("y_proba") >= 0.5).cast("int"))


@query(
    "model_compare",
    f"""WITH ev AS (SELECT event_type AS model, CAST(value > 100 AS INTEGER) AS y_true,
                           CAST(json_extract(props, '$.k') AS DOUBLE) / 100.0 AS y_proba FROM events),
        es AS (SELECT *, CAST(y_proba >= 0.5 AS INTEGER) AS y_pred FROM ev),
        af AS (SELECT model, avg(CAST(y_true = y_pred AS DOUBLE)) AS accuracy,
                      count_if(y_true = 1 AND y_pred = 1) AS tp, count_if(y_true = 0 AND y_pred = 1) AS fp,
                      count_if(y_true = 1 AND y_pred = 0) AS fn FROM es GROUP BY model),
        au AS {_auc_sql('es', 'model')}
        SELECT af.model, round(accuracy, 6) AS accuracy,
               round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0.0 END, 6) AS f1,
               round(au.auc, 6) AS auc
        FROM af JOIN au USING (model)""",
)
def model_compare(spark, d):
    s = _event_scores(spark, d)
    af = accuracy_f1(s, group=["model"])
    au = roc_auc(s, group=["model"])
    wide = af.join(au, "model")
    long = wide.select("model", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
                                                   for m in ("accuracy", "f1", "auc")])))
    return rounded(model_comparison(long, metrics=["accuracy", "f1", "auc"]))


# E10 -----------------------------------------------------------------------------------------
@query(
    "log_loss",
    f"""WITH {_logits_sql()},
        w AS (SELECT label, (SELECT count(*) FROM lg) / count(*) AS weight FROM lg GROUP BY label),
        ce AS (SELECT lg.label, -(lgt[lg.label + 1] - {_LSE_SQL}) AS ce, w.weight FROM lg JOIN w USING (label))
        SELECT round(sum(weight * ce) / sum(weight), 6) AS log_loss FROM ce""",
)
def log_loss(spark, d):
    lg = logits_table(spark, d)
    w = class_weights(lg, "label").select("label", "weight")
    j = lg.join(w, "label")
    return rounded(j.agg((F.sum(F.col("weight") * cross_entropy("logits", "label")) / F.sum("weight")).alias("log_loss")))


# E11 -----------------------------------------------------------------------------------------
@query(
    "focal_loss",
    f"""WITH {_logits_sql(2)},
        t AS (SELECT label % 2 AS t, -(lgt[label % 2 + 1] - {_LSE_SQL}) AS ce FROM lg),
        f AS (SELECT CASE WHEN t = 0 THEN 1.0 ELSE 0.8 END * pow(1.0 - exp(-ce), 2.0) * ce AS loss FROM t)
        SELECT round(avg(loss), 6) AS loss_mean, round(sum(loss), 6) AS loss_sum FROM f""",
)
def focal_loss_q(spark, d):
    lg = logits_table(spark, d, 2).withColumn("t", F.pmod(F.col("label"), F.lit(2)))
    loss = focal_loss("logits", "t")
    return rounded(lg.agg(F.avg(loss).alias("loss_mean"), F.sum(loss).alias("loss_sum")))


# E12 -----------------------------------------------------------------------------------------
@query(
    "softmax_argmax",
    f"""WITH {_logits_sql()}
        SELECT vec_id, round(exp(lgt[2] - m) / list_sum(list_transform(lgt, lambda x: exp(x - m))), 6) AS p1,
               CAST(list_position(lgt, m) - 1 AS INTEGER) AS y_pred FROM lg""",
)
def softmax_argmax(spark, d):
    lg = logits_table(spark, d)
    return rounded(lg.select("vec_id", F.element_at(softmax("logits"), 2).alias("p1"), argmax("logits").alias("y_pred")))
