"""One JSON document in many byte ranges."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from thermogrid.sources import readers as R
from thermogrid.sources.documents import split_members


def features(n):
    odd = ['plain', 'a "quoted" } brace', "{[", "back\\slash\\\\", "]}]}\"", "é\n ", '"geometry"', "\\"]
    return [{"type": "Feature", "properties": {"k": i, "name": odd[i % len(odd)] * (1 + i % 5), "deep": {"a": [{"b": "}"}]}}, "geometry": None if i % 11 == 0 else {"type": "Point", "coordinates": [i, 0.5]}} for i in range(n)]


@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("size", ["300b", "4k", "64m"])
def test_ranges_of_one_document(spark, tmp_path, indent, size):
    want = features(150)
    head = {"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "urn:} {"}}, "bbox": [1, 2], "features": want, "after": {"x": [1]}}
    (tmp_path / "one.geojson").write_text(json.dumps(head, indent=indent, ensure_ascii=False) + "\n")
    (tmp_path / "two.geojson").write_text(json.dumps({"features": want[:3], "type": "FeatureCollection"}))
    (tmp_path / "none.geojson").write_text('{"type": "FeatureCollection", "features": []}')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        got = sorted((json.loads(r.text) for r in split_members(spark, str(tmp_path)).collect() if '"Feature"' in r.text), key=lambda x: x["properties"]["k"])
        assert got == sorted(want + want[:3], key=lambda x: x["properties"]["k"])
        rows = R.read_geojson_document(spark, str(tmp_path), "k: bigint, name: string")
        assert rows.count() == 153 and rows.where("geom_type IS NULL").count() == 15
        if size == "300b":
            assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 50
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_a_geometry_without_a_feature_is_an_error(spark, tmp_path):
    (tmp_path / "x.geojson").write_text('{"type": "FeatureCollection", "features": [{"type": "Feat", "geometry": null, "properties": {}}]}')
    with pytest.raises(Exception, match="not a GeoJSON feature"):
        R.read_geojson_document(spark, str(tmp_path), "k: bigint").select(F.col("geom_type")).collect()
