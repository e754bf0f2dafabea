"""File scans with explicit schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from thermogrid.operators.keyed import union_all
from thermogrid.sources.documents import split_members

__all__ = ["read_csv_columns", "read_geojson", "read_geojson_document", "read_layer", "clean_layer", "bounding_box"]

_GEOMETRY = "struct<type: string, coordinates: string>"


def read_csv_columns(spark: SparkSession, path: str, schema: str, columns: Sequence[str], key: str) -> DataFrame:
    """CSV scan of a few columns; the key comes back as text."""
    df = spark.read.schema(schema).option("header", True).csv(path).select(*columns)
    return df.withColumn(key, F.col(key).cast("string"))


def read_geojson(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """Features of GeoJSON collections that hold one feature per line: properties, geometry type, coordinates as text.

    Spark splits such files, so large layers should be stored this way (write_geojson_lines does) or as Parquet; a collection in
    any other layout is for read_geojson_document. A feature with a null geometry stays, with nulls. The lines that
    open and close the collection are known by their form; any other line that is no feature is an error, not a loss.
    """
    feature = f"struct<type: string, properties: struct<{properties}>, geometry: {_GEOMETRY}>"
    bare = F.rtrim(F.trim(F.regexp_replace("value", "[\\t\\r]+$", "")), F.lit(","))
    lines = spark.read.text(path).select(bare.alias("line"))
    frame = F.col("line").rlike(r'^(\{\s*("type"\s*:\s*"FeatureCollection"\s*,)?.*"features"\s*:\s*\[|[\[\]{}\s]*)$')
    parsed = lines.where(~frame).select(F.from_json("line", feature).alias("f"), "line")
    broken = F.raise_error(F.concat(F.lit("not a GeoJSON feature: "), F.substring("line", 1, 80)))
    checked = F.when(F.col("f.type") == "Feature", F.col("f")).otherwise(broken.cast(feature))
    return _feature_columns(parsed.select(checked.alias("f")))


def read_geojson_document(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """Features of FeatureCollections that are one document each, compact or over many lines, whatever their size: see split_members.

    Objects at the same depth that are no features (in `crs`, say) have no geometry and are left out; one that has a geometry and is
    no feature, or that is broken, is an error, not a loss.
    """
    feature = f"struct<type: string, properties: struct<{properties}>, geometry: {_GEOMETRY}>"
    parsed = split_members(spark, path).select(F.from_json("text", feature).alias("f"), "text")
    broken = F.raise_error(F.concat(F.lit("not a GeoJSON feature: "), F.substring("text", 1, 80)))
    # The error is part of the condition, not of the columns: Spark may run a caller's filter on the columns first.
    is_feature = F.when(F.col("f.type") == "Feature", F.lit(True)).when(F.col("text").contains('"geometry"'), broken.cast("boolean")).otherwise(F.lit(False))
    return _feature_columns(parsed.where(is_feature).select("f"))


def _feature_columns(features: DataFrame) -> DataFrame:
    return features.select("f.properties.*", F.col("f.geometry.type").alias("geom_type"), F.col("f.geometry.coordinates").alias("coordinates"))


def read_layer(spark: SparkSession, candidates: Sequence[str]) -> DataFrame | None:
    """Every candidate table of a layer that exists, merged; None when there is none. Each path counts once."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def exists(path: str) -> bool:
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(conf).exists(p)

    found = [p for p in dict.fromkeys(candidates) if exists(p)]
    return union_all([spark.read.parquet(p) for p in found]) if found else None


def clean_layer(features: DataFrame, coords: str = "coords", geom_type: str = "geom_type") -> DataFrame:
    """Drop null and empty geometries; close polygon rings that are open."""
    present = features.where(F.col(coords).isNotNull() & (F.size(coords) > 0))
    first, last = F.element_at(coords, 1), F.element_at(coords, -1)
    is_open = (F.col(geom_type) == "Polygon") & ((first["x"] != last["x"]) | (first["y"] != last["y"]))
    return present.withColumn(coords, F.when(is_open, F.concat(coords, F.slice(coords, 1, 1))).otherwise(F.col(coords)))


def bounding_box(cells: DataFrame, xmin: float, ymin: float, xmax: float, ymax: float, half: tuple[float, float], limit: int | None = None, x: str = "lon", y: str = "lat") -> DataFrame:
    """Cells whose rectangle meets a box, by id: all of them, or the first `limit` if one is asked for. The test reaches the scan."""
    if limit is not None and limit < 1:
        raise ValueError("a limit is at least 1")
    meets = F.col(x).between(xmin - half[0], xmax + half[0]) & F.col(y).between(ymin - half[1], ymax + half[1])
    found = cells.where(meets).orderBy("grid_id")
    return found if limit is None else found.limit(limit)
