"""Reader, writer and guard queries.

Each writes a table derived from the given ones below the session's checkpoint
folder with the writer under test, reads it back and returns the rows, so the
oracle is the plain SQL of the table.
"""

from __future__ import annotations

import uuid

from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from vinterra.operators.climate import CLIMATE_COLUMNS
from vinterra.operators.coords import cast_coords
from vinterra.operators.merge import merge_ratings_with_yearly_weather
from vinterra.operators.ml import load_pipeline_model, make_estimator, make_preprocessor, probability_of, save_model
from vinterra.operators.polygons import read_geojson, with_clean_name
from vinterra.operators.prep import encode_with_mapping, infer_roles, infer_roles_by_type, sorted_mapping, split_target
from vinterra.plans import standins
from vinterra.plans.q_ml import _train_test
from vinterra.plans.q_prep import CAT_FEATURES, _MODEL_SQL, model_table
from vinterra.plans.q_spatial import _POLYS_SQL, polygons
from vinterra.plans.q_text import _normalize_sql
from vinterra.plans.q_weather import _MERGE_COLS, _MERGE_SQL_CTES, WIDE_KM, _merge_view
from vinterra.plans.registry import query, rounded
from vinterra.session import ensure_checkpoint_dir
from vinterra.sources import io
from vinterra.sources.tables import table


def _folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# S7 -> S1 -------------------------------------------------------------------------------------
@query("csv_round_trip", f"WITH {standins.WINES_SQL} SELECT wine_id, Wine, vintage, region, cepages FROM wines")
def csv_round_trip(spark, d):
    path = _folder(spark, "csv")
    io.write_csv(standins.wines(spark, d).select("wine_id", "Wine", "vintage", "region", "cepages"), path)
    return io.read_csv(spark, path, "wine_id long, Wine string, vintage string, region string, cepages string")


# S8 -> S2 -------------------------------------------------------------------------------------
@query(
    "parquet_target",
    f"""WITH {_MODEL_SQL} SELECT wine_id, region, CAST(label AS INTEGER) AS target, "set" FROM model WHERE label IS NOT NULL""",
)
def parquet_target(spark, d):
    path = _folder(spark, "parquet")
    io.write_parquet(model_table(spark, d).where("label IS NOT NULL"), path, ["set"])
    features, target = split_target(spark.read.parquet(path), "label")
    return spark.read.parquet(path).select("wine_id", "region", target.alias("target"), "set").where(
        F.lit("label" not in features.columns)
    )


# S3 -------------------------------------------------------------------------------------------
@query(
    "weather_files",
    f"""WITH {standins.WEATHER_SQL} SELECT station, CAST(year AS INTEGER) AS year, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude,
        hot_days FROM weather""",
)
def weather_files(spark, d):
    """Two folders of yearly tables, one per spelling of the coordinates, read as one."""
    path = _folder(spark, "weather")
    w = standins.weather(spark, d)
    odd = F.pmod(F.col("year"), F.lit(2)) == 1
    short = w.where(odd).withColumnsRenamed({"latitude": "lat", "longitude": "lon"})
    short = short.withColumns({"lat": F.col("lat").cast("string"), "lon": F.col("lon").cast("string")})
    full = w.where(~odd).withColumns({"latitude": F.col("latitude").cast("string"), "longitude": F.col("longitude").cast("string")})
    for part in (short, full):
        part.write.mode("append").partitionBy("year").parquet(path)
    out = io.read_weather(spark, path)
    return rounded(out.select("station", F.col("year").cast("int").alias("year"), "latitude", "longitude", "hot_days"))


# S3 -> J4: yearly tables of which only the years of the rated wines are opened
_SPAN = (standins.YEAR_RANGE[0] + 2, standins.YEAR_RANGE[1] - 2)


@query(
    "merge_weather_years",
    f"""WITH {_MERGE_SQL_CTES.replace('__R__', str(WIDE_KM))}
        SELECT {_MERGE_COLS} FROM merged WHERE year >= {_SPAN[0]} AND year < {_SPAN[1]}""",
)
def merge_weather_years(spark, d):
    path = _folder(spark, "weather")
    w = standins.weather(spark, d)
    io.write_parquet(w, path, ["year"])
    weather = io.read_weather(spark, path, schema=w.schema)
    return _merge_view(
        merge_ratings_with_yearly_weather(standins.wines(spark, d), standins.regions(spark, d), weather, max_km=WIDE_KM, year_range=_SPAN)
    )


# S9 -> S6 -------------------------------------------------------------------------------------
_GEOJSON_SQL = f"""WITH {_POLYS_SQL}
        SELECT poly_id, signe, CASE WHEN denom IS NOT NULL THEN {_normalize_sql('CAST(denom AS VARCHAR)')} END AS denom_clean,
               CAST(len(rings) AS INTEGER) AS n_rings, CAST(list_sum([len(r) for r in rings]) AS INTEGER) AS n_points,
               round(list_max([p.x for p in rings[1]]), 6) AS max_x, round(list_min([p.y for p in rings[1]]), 6) AS min_y
        FROM polys"""


def _geojson_digest(back):
    back = with_clean_name(back)
    shell = F.get("rings", 0)
    return rounded(back.select(
        F.col("poly_id").cast("long").alias("poly_id"), "signe", "denom_clean", F.size("rings").alias("n_rings"),
        F.size(F.flatten("rings")).alias("n_points"),
        F.array_max(F.transform(shell, lambda p: p["x"])).alias("max_x"), F.array_min(F.transform(shell, lambda p: p["y"])).alias("min_y"),
    ))


@query("geojson_round_trip", _GEOJSON_SQL)
def geojson_round_trip(spark, d):
    path = _folder(spark, "geojson")
    io.write_geojson_lines(polygons(spark, d), path, ["poly_id", "denom", "signe"])
    return _geojson_digest(read_geojson(spark, path, lines=True, props=["poly_id", "denom", "signe"]))


@query("geojson_collections", _GEOJSON_SQL)
def geojson_collections(spark, d):
    """Standard FeatureCollections of some hundred polygons each; tasks cut the features out of the text."""
    path = _folder(spark, "geojson")
    features = io.geojson_features(polygons(spark, d), ["poly_id", "denom", "signe"], keep=["poly_id"])
    members = features.groupBy(F.floor(F.col("poly_id") / 500)).agg(F.array_join(F.collect_list("value"), ", ").alias("all"))
    document = F.concat(F.lit('{"type": "FeatureCollection", "features": ['), "all", F.lit("]}"))
    members.select(document.alias("value")).write.text(path)
    return _geojson_digest(read_geojson(spark, path, props=["poly_id", "denom", "signe"]))


# S10 ------------------------------------------------------------------------------------------
@query("model_saved")
def model_saved(spark, d):
    """Scores of a saved and loaded model next to those of the model in memory."""
    train, test = _train_test(spark, d)
    model = Pipeline(stages=make_preprocessor("lr") + [make_estimator("lr", weight_sum=train.agg(F.sum("weight")).first()[0])]).fit(train)
    path = _folder(spark, "model")
    save_model(model, path)
    score = lambda m, name: m.transform(test).select("wine_id", probability_of().alias(name))
    return rounded(score(model, "p1").join(score(load_pipeline_model(path), "p1_loaded"), "wine_id"))


# P8 -------------------------------------------------------------------------------------------
_COORD_TEXT_SQL = """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN CAST(c_acctbal AS VARCHAR) WHEN 1 THEN c_name WHEN 2 THEN '' ELSE CAST(c_custkey AS VARCHAR) END AS latitude,
       CASE WHEN c_custkey % 3 = 0 THEN 'east' ELSE CAST(c_nationkey AS VARCHAR) END AS longitude FROM customer"""


@query(
    "coord_cast",
    f"""SELECT c_custkey, round(TRY_CAST(latitude AS DOUBLE), 6) AS latitude, round(TRY_CAST(longitude AS DOUBLE), 6) AS longitude
        FROM ({_COORD_TEXT_SQL})""",
)
def coord_cast(spark, d):
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    kind = F.pmod(k, F.lit(4))
    lat = F.when(kind == 0, F.col("c_acctbal").cast("string")).when(kind == 1, F.col("c_name")).when(kind == 2, "").otherwise(k.cast("string"))
    lon = F.when(F.pmod(k, F.lit(3)) == 0, "east").otherwise(F.col("c_nationkey").cast("string"))
    return rounded(cast_coords(c.select("c_custkey", lat.alias("latitude"), lon.alias("longitude"))))


# M1, M8 ---------------------------------------------------------------------------------------
@query(
    "column_roles",
    f"""WITH {_MODEL_SQL}, n AS (SELECT count(*) AS n_rows FROM model)
        SELECT rule, role, name, n_rows FROM n, (
          SELECT 'by type' AS rule, 'num' AS role, unnest(['wine_id', {', '.join(f"'{c}'" for c in [*CLIMATE_COLUMNS, 'price'])}]) AS name
          UNION ALL SELECT 'by type', 'cat', unnest(['region', 'station', 'cepages'])
          UNION ALL SELECT 'categorical given', 'num', unnest(['wine_id', 'station', {', '.join(f"'{c}'" for c in [*CLIMATE_COLUMNS, 'price'])}])
          UNION ALL SELECT 'categorical given', 'cat', unnest(['cepages', 'region']))""",
)
def column_roles(spark, d):
    """Roles of the modelling table's columns by both rules (read from its schema), with its rows."""
    m = model_table(spark, d)
    rules = {
        "by type": infer_roles_by_type(m.schema, "label", exclude=("set",)),
        "categorical given": infer_roles(m.schema, "label", cat_cols=CAT_FEATURES, exclude=("set",)),
    }
    rows = [(rule, role, c) for rule, roles in rules.items() for role, cols in zip(("num", "cat"), roles) for c in cols]
    return spark.createDataFrame(rows, "rule string, role string, name string").withColumn("n_rows", m.select(F.count(F.lit(1))).scalar())


@query("no_categories", f"WITH {_MODEL_SQL} SELECT wine_id, label FROM model")
def no_categories(spark, d):
    """Encoding with an empty list of categorical columns leaves every row as it is."""
    m = model_table(spark, d).select("wine_id", "label")
    return encode_with_mapping(m, sorted_mapping(m, []), [])
