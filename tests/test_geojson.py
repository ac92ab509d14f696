"""Features of standard GeoJSON files, cut out by tasks that each see a part of the file."""

import json
import random

import pytest

from vinterra.operators.polygons import read_geojson
from vinterra.sources.geojson import read_features

ODD = ['plain', 'a "quoted" } brace {', "back\\slash \\\" {{", "}{", "üñï } \n new", "", '\\', '{"type":"Feature"}']


def collection(rng, n, extra=True):
    feats = []
    for i in range(n):
        box = [[[i, 0], [i + 1, 0], [i + 1, 1], [i, 0]]]
        geometry = {"type": "Polygon", "coordinates": box} if i % 3 else {"type": "MultiPolygon", "coordinates": [box, box]}
        feature = {"type": "Feature", "properties": {"denom": rng.choice(ODD), "id": i, "deep": {"a": {"b": [{}, {"c": "}"}]}}}, "geometry": geometry}
        if i % 4 == 1:  # another order of keys, and members beside them
            feature = {"id": {"x": "{"}, "geometry": geometry, "properties": feature["properties"], "type": "Feature"}
        feats.append(feature)
    out = {"type": "FeatureCollection", "name": "a { in a name", "crs": {"type": "name", "properties": {"name": "urn:}"}}, "features": feats}
    return out if extra else {"features": feats, "type": "FeatureCollection"}


def found(df):
    return sorted(json.dumps([json.loads(r.properties), json.loads(r.geometry)], sort_keys=True) for r in df.collect())


def wanted(*docs):
    return sorted(json.dumps([f["properties"], f["geometry"]], sort_keys=True) for d in docs for f in d["features"])


@pytest.mark.parametrize("indent", [None, 1])
def test_any_split_gives_all_features(spark, tmp_path, indent):
    rng = random.Random(3)
    docs = [collection(rng, 120), collection(rng, 1, extra=False), {"type": "FeatureCollection", "features": []}]
    for k, doc in enumerate(docs):
        (tmp_path / f"{k}.geojson").write_text(json.dumps(doc, indent=indent, ensure_ascii=k == 0))
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("64", "700", "10m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            feats = read_features(spark, str(tmp_path))
            assert found(feats) == wanted(*docs)
            if size == "700":
                assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 20
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_parts_and_names(spark, tmp_path):
    doc = collection(random.Random(5), 9)
    (tmp_path / "x.geojson").write_text(json.dumps(doc))
    got = read_geojson(spark, str(tmp_path), props=["denom", "id"])
    rows = sorted((int(r.id), r.part, r.denom, len(r.rings[0])) for r in got.collect())
    assert rows == [(i, p, f["properties"]["denom"], 4) for i, f in enumerate(doc["features"]) for p in range(1 if i % 3 else 2)]


def test_a_cut_off_file_keeps_its_whole_features(spark, tmp_path):
    doc = collection(random.Random(7), 6)
    text = json.dumps(doc)
    (tmp_path / "x.geojson").write_text(text[: text.rindex('"type": "Feature"') + 5])
    assert 4 <= read_features(spark, str(tmp_path)).count() <= 5
