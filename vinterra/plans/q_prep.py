"""Modelling-table preparation queries.

The modelling table is the ratings x climate merge with the production column
contract (11 numeric + categorical columns), a label derived from the price,
some missing values, and a ``set`` column (``test`` for every fifth wine).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from vinterra.operators.climate import CLIMATE_COLUMNS
from vinterra.operators.ml import CAT_FEATURES, NUM_FEATURES
from vinterra.operators.prep import (
    DEFAULT_SEED,
    DEFAULT_VALID_FRAC,
    assign_split,
    cast_target,
    category_widths,
    class_count,
    class_weights,
    clean_numeric,
    encode_with_mapping,
    first_seen_mapping,
    impute_mean,
    one_hot_cells,
    ordinal_encode,
    sorted_mapping,
    standardize,
    stratified_folds,
)
from vinterra.plans.q_weather import MAX_KM, _MERGE_SQL_CTES, merged_table
from vinterra.plans.registry import query, rounded
from vinterra.session import as_table

LABEL_PRICE = 150000.0
K_FOLDS = 5


def model_table(spark, d):
    m = merged_table(spark, d)
    k = F.col("wine_id")
    nulled = {
        "cepages": F.when(F.pmod(k, F.lit(29)) == 0, F.lit(None).cast("string")).otherwise(F.col("cepages")),
        "TM_summer": F.when(F.pmod(k, F.lit(23)) == 0, F.lit(None).cast("double")).otherwise(F.col("TM_summer")),
        "price": F.when(F.pmod(k, F.lit(19)) == 0, F.lit(None).cast("double")).otherwise(F.col("price")),
    }
    return m.select(
        "wine_id", "region", "station",
        *[nulled.get(c, F.col(c)).alias(c) for c in ["cepages", *NUM_FEATURES]],
        (F.col("price") > F.lit(LABEL_PRICE)).cast("int").alias("label"),
        F.when(F.pmod(k, F.lit(5)) == 0, "test").otherwise("train").alias("set"),
    )


def stored_model(spark, d):
    """``model_table`` written once, for jobs that read it more than once (a mapping and the rows, or a
    range partitioning, which samples its input first)."""
    return as_table(model_table(spark, d), "model")


_MODEL_SQL = _MERGE_SQL_CTES.replace("__R__", str(MAX_KM)) + f""",
model AS (
  SELECT wine_id, region, station, CASE WHEN wine_id % 29 = 0 THEN NULL ELSE cepages END AS cepages,
         {', '.join('CASE WHEN wine_id % 23 = 0 THEN NULL ELSE TM_summer END AS TM_summer' if c == 'TM_summer' else c for c in CLIMATE_COLUMNS)},
         CASE WHEN wine_id % 19 = 0 THEN NULL ELSE price END AS price,
         CAST(price > {LABEL_PRICE} AS INTEGER) AS label,
         CASE WHEN wine_id % 5 = 0 THEN 'test' ELSE 'train' END AS "set"
  FROM merged)"""

_SPLIT_SQL = f"""{_MODEL_SQL},
ordr AS (
  SELECT wine_id, row_number() OVER (ORDER BY md5('{DEFAULT_SEED}:' || CAST(wine_id AS VARCHAR)), wine_id) - 1 AS pos,
         count(*) OVER () AS n
  FROM model WHERE "set" = 'train'),
splits AS (
  SELECT wine_id, CASE WHEN pos < round_even(n * {1.0 - DEFAULT_VALID_FRAC}, 0) THEN 'train' ELSE 'valid' END AS split FROM ordr
  UNION ALL SELECT wine_id, 'test' FROM model WHERE "set" = 'test'),
ms AS (SELECT m.*, s.split FROM model m JOIN splits s USING (wine_id))"""


def _split_table(spark, d):
    m = model_table(spark, d)
    train = assign_split(m.where(F.col("set") == "train"), "wine_id", DEFAULT_VALID_FRAC, DEFAULT_SEED)
    test = m.where(F.col("set") == "test").withColumn("split", F.lit("test"))
    return train.unionByName(test)


# M2 ---------------------------------------------------------------------------------------
@query("split_assign", f"WITH {_SPLIT_SQL} SELECT wine_id, split FROM splits WHERE split <> 'test'")
def split_assign(spark, d):
    m = stored_model(spark, d).where(F.col("set") == "train")
    return assign_split(m, "wine_id", DEFAULT_VALID_FRAC, DEFAULT_SEED).select("wine_id", "split")


# M3 ---------------------------------------------------------------------------------------
_IMPUTED_SQL = f"""{_SPLIT_SQL},
imp AS (
  SELECT wine_id, split, {', '.join(f'coalesce({c}, avg({c}) OVER (PARTITION BY split)) AS {c}' for c in NUM_FEATURES)}
  FROM ms)"""


@query(
    "impute_mean",
    f"WITH {_IMPUTED_SQL} SELECT wine_id, split, round(price, 6) AS price, round(TM_summer, 6) AS TM_summer, round(GDD, 6) AS GDD FROM imp",
)
def impute_mean_q(spark, d):
    out = impute_mean(_split_table(spark, d), NUM_FEATURES, "split")
    return rounded(out.select("wine_id", "split", "price", "TM_summer", "GDD"))


# M5 ---------------------------------------------------------------------------------------
def _clean_sql(c: str) -> str:
    x = f"CAST({c} AS DOUBLE)"
    zero = f"CASE WHEN {x} IS NULL OR isnan({x}) OR isinf({x}) THEN 0.0 ELSE {x} END"
    return f"greatest(least({zero}, 1000000.0), -1000000.0)"


@query(
    "clean_numeric",
    f"WITH {_IMPUTED_SQL} SELECT wine_id, {', '.join(f'round({_clean_sql(c)}, 6) AS {c}' for c in NUM_FEATURES)} FROM imp",
)
def clean_numeric_q(spark, d):
    out = clean_numeric(impute_mean(_split_table(spark, d), NUM_FEATURES, "split"), NUM_FEATURES)
    return rounded(out.select("wine_id", *NUM_FEATURES))


# W5 + M6 + J9 -----------------------------------------------------------------------------
def _sorted_map_sql(c: str) -> str:
    return (f"SELECT '{c}' AS col, v, row_number() OVER (ORDER BY v) - 1 AS code "
            f"FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM model WHERE \"set\" = 'train' AND {c} IS NOT NULL)")


@query(
    "encode_sorted",
    f"""WITH {_MODEL_SQL}, mp AS ({' UNION ALL '.join(_sorted_map_sql(c) for c in CAT_FEATURES)})
        SELECT m.wine_id, {', '.join(f'CAST(coalesce(m{i}.code, 0) AS BIGINT) AS {c}' for i, c in enumerate(CAT_FEATURES))}
        FROM model m {' '.join(f"LEFT JOIN mp m{i} ON m{i}.col = '{c}' AND m{i}.v = coalesce(CAST(m.{c} AS VARCHAR), '__MISSING__')" for i, c in enumerate(CAT_FEATURES))}""",
)
def encode_sorted(spark, d):
    m = stored_model(spark, d)
    mapping = sorted_mapping(m.where(F.col("set") == "train"), CAT_FEATURES)
    return encode_with_mapping(m, mapping, CAT_FEATURES).select("wine_id", *CAT_FEATURES)


# W6 ---------------------------------------------------------------------------------------
_FS_COLS = ["cepages", "region", "station"]


def _first_seen_sql(c: str) -> str:
    v = f"coalesce(CAST({c} AS VARCHAR), 'None')"
    return (f"SELECT '{c}' AS col, v, row_number() OVER (ORDER BY fs, fw, v) - 1 AS code FROM ("
            f"SELECT {v} AS v, min(CASE WHEN \"set\" = 'train' THEN 0 ELSE 1 END) AS fs, "
            f"arg_min(wine_id, (CASE WHEN \"set\" = 'train' THEN 0 ELSE 1 END, wine_id)) AS fw FROM model GROUP BY 1)")


@query(
    "encode_first_seen",
    f"""WITH {_MODEL_SQL}, mp AS ({' UNION ALL '.join(_first_seen_sql(c) for c in _FS_COLS)})
        SELECT m.wine_id, {', '.join(f'CAST(m{i}.code AS BIGINT) AS {c}' for i, c in enumerate(_FS_COLS))}
        FROM model m {' '.join(f"JOIN mp m{i} ON m{i}.col = '{c}' AND m{i}.v = coalesce(CAST(m.{c} AS VARCHAR), 'None')" for i, c in enumerate(_FS_COLS))}""",
)
def encode_first_seen(spark, d):
    m = stored_model(spark, d)
    first = first_seen_mapping(m.where(F.col("set") == "train"), _FS_COLS, ["wine_id"])
    extended = first_seen_mapping(m.where(F.col("set") == "test"), _FS_COLS, ["wine_id"], existing=first)
    keyed = m.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in _FS_COLS})
    return encode_with_mapping(keyed, extended, _FS_COLS).select("wine_id", *_FS_COLS)


# M7 ---------------------------------------------------------------------------------------
@query(
    "target_cast",
    f"""WITH {_MODEL_SQL},
        t AS (SELECT wine_id, CASE WHEN wine_id % 31 = 0 THEN 'n/a' WHEN wine_id % 31 = 1 THEN '1.7'
                                  ELSE CAST(label AS VARCHAR) END AS label_text FROM model)
        SELECT wine_id, CAST(trunc(coalesce(CASE WHEN regexp_full_match(label_text, '\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?\\s*')
                                          THEN TRY_CAST(trim(label_text) AS DOUBLE) END, 0.0)) AS BIGINT) AS label
        FROM t""",
)
def target_cast(spark, d):
    m = model_table(spark, d)
    k = F.col("wine_id")
    txt = F.when(F.pmod(k, F.lit(31)) == 0, "n/a").when(F.pmod(k, F.lit(31)) == 1, "1.7").otherwise(F.col("label").cast("string"))
    return cast_target(m.select("wine_id", txt.alias("label")), "label")


# A12 --------------------------------------------------------------------------------------
@query(
    "class_weights",
    f"""WITH {_MODEL_SQL}, c AS (SELECT label, count(*) AS n FROM model WHERE "set" = 'train' AND label IS NOT NULL GROUP BY label)
        SELECT label, n, round((SELECT sum(n) FROM c) / n, 6) AS weight,
               round((SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n), 6) AS balanced_weight FROM c""",
)
def class_weights_q(spark, d):
    return rounded(class_weights(model_table(spark, d).where(F.col("set") == "train")))


# A13 --------------------------------------------------------------------------------------
@query(
    "class_count",
    f"""WITH {_MODEL_SQL} SELECT count(DISTINCT label) AS n_classes, max(label) + 1 AS n_classes_max_plus_one
        FROM model WHERE "set" = 'train'""",
)
def class_count_q(spark, d):
    return class_count(model_table(spark, d).where(F.col("set") == "train"))


# A14 --------------------------------------------------------------------------------------
_W_COLS = ["cepages", "region", "station"]


@query(
    "category_widths",
    f"""WITH {_MODEL_SQL},
        v AS ({' UNION ALL '.join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS vocab FROM model WHERE \"set\" = 'train'" for c in _W_COLS)})
        SELECT "column", vocab, CAST(greatest(4.0, floor(sqrt(vocab) / 2)) AS INTEGER) AS width_mlp,
               CAST(greatest(8, CAST(floor(sqrt(vocab)) AS INTEGER)) AS INTEGER) AS width_tab FROM v""",
)
def category_widths_q(spark, d):
    return category_widths(model_table(spark, d).where(F.col("set") == "train"), _W_COLS)


# M9 ---------------------------------------------------------------------------------------
@query(
    "onehot_ordinal",
    f"""WITH {_MODEL_SQL}, mp AS ({' UNION ALL '.join(_sorted_map_sql(c) for c in CAT_FEATURES)})
        SELECT m.wine_id, {', '.join(f'CAST(CASE WHEN m.{c} IS NULL THEN NULL ELSE coalesce(m{i}.code, -1) END AS BIGINT) AS {c}_ord' for i, c in enumerate(CAT_FEATURES))}
        FROM model m {' '.join(f"LEFT JOIN mp m{i} ON m{i}.col = '{c}' AND m{i}.v = CAST(m.{c} AS VARCHAR)" for i, c in enumerate(CAT_FEATURES))}
        WHERE m."set" = 'test'""",
)
def onehot_ordinal(spark, d):
    m = stored_model(spark, d)
    train, test = m.where(F.col("set") == "train"), m.where(F.col("set") == "test")
    return ordinal_encode(train, test, CAT_FEATURES).select("wine_id", *[f"{c}_ord" for c in CAT_FEATURES])


@query(
    "onehot_cells",
    f"""WITH {_MODEL_SQL}, mp AS ({' UNION ALL '.join(_sorted_map_sql(c) for c in CAT_FEATURES)})
        {' UNION ALL '.join(f"SELECT wine_id, '{c}' AS column, v AS value FROM model JOIN mp ON col = '{c}' AND v = CAST({c} AS VARCHAR) WHERE set = 'test'" for c in CAT_FEATURES)}""".replace(
        "AS column", 'AS "column"').replace("WHERE set", 'WHERE "set"'),
)
def onehot_cells(spark, d):
    m = stored_model(spark, d)
    return one_hot_cells(m.where(F.col("set") == "train"), m.where(F.col("set") == "test"), CAT_FEATURES, "wine_id")


# M10 --------------------------------------------------------------------------------------
_Z_COLS = ["price", "GDD", "hot_days", "TM_summer"]


@query(
    "standardize",
    f"""WITH {_MODEL_SQL},
        tr AS (SELECT * FROM model WHERE "set" = 'train'),
        st AS (SELECT {', '.join(f'avg({c}) AS mean_{c}' for c in _Z_COLS)} FROM tr),
        imp AS (SELECT m.wine_id, m."set", {', '.join(f'coalesce(m.{c}, st.mean_{c}) AS {c}' for c in _Z_COLS)} FROM model m, st),
        sd AS (SELECT {', '.join(f'avg({c}) AS mu_{c}, stddev_pop({c}) AS sd_{c}' for c in _Z_COLS)} FROM imp WHERE "set" = 'train')
        SELECT wine_id, {', '.join(f'round(({c} - mu_{c}) / CASE WHEN sd_{c} = 0 THEN 1.0 ELSE sd_{c} END, 6) AS {c}' for c in _Z_COLS)}
        FROM imp, sd WHERE "set" = 'test'""",
)
def standardize_q(spark, d):
    m = stored_model(spark, d).select("wine_id", "set", *_Z_COLS)
    imp = impute_mean(m.withColumn("split", F.col("set")), _Z_COLS, "split", fit_on="train")
    train = imp.where(F.col("set") == "train")
    out = standardize(train, imp.where(F.col("set") == "test"), _Z_COLS)
    return rounded(out.select("wine_id", *_Z_COLS))


# M14 --------------------------------------------------------------------------------------
@query(
    "kfold",
    f"""WITH {_MODEL_SQL}
        SELECT wine_id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY md5('{DEFAULT_SEED}:' || CAST(wine_id AS VARCHAR)), wine_id) - 1) % {K_FOLDS} AS INTEGER) AS fold
        FROM model WHERE "set" = 'train'""",
)
def kfold(spark, d):
    m = stored_model(spark, d).where(F.col("set") == "train").select("wine_id", "label")
    return stratified_folds(m, "label", "wine_id", K_FOLDS, DEFAULT_SEED).select("wine_id", "label", "fold")
