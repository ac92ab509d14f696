"""Standard GeoJSON files in many tasks (S6): features are cut out of the text, not parsed as one row.

A FeatureCollection is one JSON document, often one line, so a JSON reader takes a file as one row.  Here
the file is read as text pieces that end at ``}``, which Spark's text source splits like lines.  Where a
piece begins -- inside a string or not, and in how many open objects -- follows from the pieces before
it: the parity of their quotes, then the balance of their braces outside strings.  Both are running sums,
taken per split first (one row per split decides where each begins), so no task sees more than a split.
A feature is the run of pieces from the brace that opens the second object to its end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vinterra.session import as_table

#: A run without braces, strings taken whole.
_STRING = r'"(?:[^"\\]|\\.)*"'
_PLAIN = rf'(?s)^(?:[^{{"]|{_STRING})*'


def _running(df: DataFrame, value: Column, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over all pieces before, in the order of the file."""
    df = as_table(df.withColumn("_v", value), "geojson-pieces")  # the pieces are read twice below
    splits = df.groupBy("file", "split").agg(F.sum("_v").alias("_total"))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select("file", "split", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("file", "split").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    return df.join(starts, ["file", "split"]).withColumn(name, F.col("_start") + F.coalesce(F.sum("_v").over(inside), F.lit(0))).drop("_v", "_start")


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """``properties, geometry`` (JSON texts) of every feature of the FeatureCollections under ``path``."""
    pieces = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row"), F.col("value").alias("text")
    )
    # escaped characters cannot open or close anything, and never stand at the end of a piece
    plain = F.regexp_replace("text", r"(?s)\\.", "")
    pieces = _running(pieces.withColumn("quotes", F.length(plain) - F.length(F.translate(plain, '"', ""))), F.col("quotes"), "quoted")
    in_string = F.col("quoted") % 2 == 1
    outside = F.regexp_replace(F.concat(F.when(in_string, F.lit('"')).otherwise(F.lit("")), F.regexp_replace("text", r"(?s)\\.", "")), r'(?s)"[^"]*("|$)', "")
    opened = F.length(outside) - F.length(F.translate(outside, "{", ""))
    ends_in_string = (F.col("quoted") + F.col("quotes")) % 2 == 1
    pieces = pieces.withColumn("change", opened - F.when(ends_in_string, F.lit(0)).otherwise(F.lit(1)))
    pieces = _running(pieces, F.col("change"), "depth")
    # a feature ends where the depth falls back to that of the collection
    closes = (F.col("depth") + F.col("change") <= 1) & ~ends_in_string
    pieces = _running(pieces.withColumn("closes", closes), F.when(F.col("closes"), F.lit(1)).otherwise(F.lit(0)), "feature")
    begin = lambda text: F.regexp_replace(text, _PLAIN, "")
    text = (
        F.when((F.col("depth") >= 2) | in_string, F.col("text"))
        .when(F.col("depth") == 1, begin(F.col("text")))
        .otherwise(begin(F.substring(begin(F.col("text")), 2, 1 << 30)))
    )
    part = F.struct("split", "row", text.alias("text"))
    whole = pieces.groupBy("file", "feature").agg(F.max("closes").alias("closed"), F.array_sort(F.collect_list(part)).alias("parts")).where("closed")
    features = whole.select(F.concat(F.array_join(F.transform("parts", lambda x: x["text"]), "}"), F.lit("}")).alias("json"))
    parsed = features.select(F.from_json("json", "type string, properties string, geometry string").alias("f")).where("f.type = 'Feature'")
    return parsed.select("f.properties", "f.geometry")
