"""Writers. All of them write in parallel, one file per task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

__all__ = ["write_csv", "geojson_features", "write_geojson_lines", "write_report", "append_new_rows", "write_layers"]


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def square_ring(left: Column, bottom: Column, right: Column, top: Column) -> Column:
    corner = lambda x, y: F.array(x, y)
    return F.array(F.array(corner(left, bottom), corner(right, bottom), corner(right, top), corner(left, top), corner(left, bottom)))


def geojson_features(df: DataFrame, properties: Sequence[str], ring: Column) -> DataFrame:
    """One GeoJSON feature text per row."""
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(*properties).alias("properties"),
        F.struct(F.lit("Polygon").alias("type"), ring.alias("coordinates")).alias("geometry"),
    )
    return df.select(F.to_json(feature).alias("value"))


def write_geojson_lines(features: DataFrame, path: str) -> None:
    features.write.mode("overwrite").text(path)


def write_report(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").json(path)


def write_layers(layers: DataFrame, path: str) -> None:
    layers.write.mode("overwrite").partitionBy("layer").parquet(path)


def append_new_rows(new_rows: DataFrame, path: str) -> None:
    new_rows.write.mode("append").parquet(path)
