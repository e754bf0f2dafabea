"""Nested payloads to flat rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from thermogrid import constants as K
from thermogrid.functions import column_to_surface, compact_date, flag_to_null, safe_name
from thermogrid.operators.keyed import first_by_priority

__all__ = [
    "daily_parameters", "daily_arrays", "measurements_wide", "column_density_points", "merge_providers",
    "scene_catalogue", "tag_layers", "tree_points",
]


def daily_parameters(payloads: DataFrame, text: str, parameters: Sequence[str]) -> DataFrame:
    """{"parameter": {name: {yyyymmdd: value}}} to one row per date; the missing flag becomes null, units are converted."""
    doc = F.from_json(text, "properties struct<parameter: map<string, map<string, double>>>")
    long = payloads.select(F.explode(doc["properties"]["parameter"]).alias("name", "series")).select("name", F.explode("series").alias("day", "value"))

    def column(p: str):
        value = flag_to_null(F.max(F.when(F.lower("name") == p, F.col("value"))), K.WEATHER_MISSING_FLAG)
        factor = K.WEATHER_UNIT_FACTORS.get(p)
        return (value * F.lit(factor) if factor else value).alias(p)

    return long.groupBy(compact_date("day").alias("date")).agg(*[column(p) for p in parameters])


def daily_arrays(payloads: DataFrame, text: str) -> DataFrame:
    """Parallel arrays per day to rows, renamed; radiation sums become mean watts."""
    from thermogrid.functions import radiation_to_watts

    fields = ", ".join(f"{n}: array<double>" for n in K.DAILY_ARRAY_NAMES)
    doc = F.from_json(text, f"daily struct<time: array<string>, {fields}>")
    # A parameter the provider left out becomes an empty array, since arrays_zip of a null is null.
    listed = [F.col("_d").getField(n) for n in K.DAILY_ARRAY_NAMES]
    zipped = F.arrays_zip(F.col("_d.time").alias("time"), *[
        F.coalesce(a, F.array().cast("array<double>")).alias(n) for a, n in zip(listed, K.DAILY_ARRAY_NAMES)
    ])
    rows = payloads.select(doc["daily"].alias("_d")).select(F.explode(zipped).alias("z")).where(F.col("z.time").isNotNull())
    out = [F.col(f"z.{n}").alias(new) for n, new in K.DAILY_ARRAY_NAMES.items() if new != "solar_radiation"]
    return rows.select(F.to_date("z.time").alias("date"), *out, radiation_to_watts("z.shortwave_radiation_sum").alias("solar_radiation"))


def measurements_wide(payloads: DataFrame, text: str) -> DataFrame:
    """Measurement lists to one wide row per measurement; unknown parameters and rows without value or place go."""
    item = ("struct<parameter: struct<name: string>, value: double, locationId: bigint, location: string, "
            "coordinates: struct<latitude: double, longitude: double>, datetime: struct<utc: string>>")
    doc = F.from_json(text, f"results array<{item}>")
    names = F.create_map(*[F.lit(v) for pair in K.MEASUREMENT_NAMES.items() for v in pair])
    rows = payloads.select(F.explode(doc["results"]).alias("r")).select("r.*").withColumn("pollutant", names[F.lower("parameter.name")])
    known = rows.where(
        F.col("pollutant").isNotNull() & F.col("value").isNotNull()
        & F.col("coordinates.latitude").isNotNull() & F.col("coordinates.longitude").isNotNull()
    )
    return known.select(
        F.coalesce(F.col("locationId").cast("string"), F.col("location")).alias("station_id"),
        F.col("coordinates.latitude").alias("lat"), F.col("coordinates.longitude").alias("lon"),
        F.to_timestamp("datetime.utc").alias("observed_at"),
        *[F.when(F.col("pollutant") == p, F.col("value")).alias(p) for p in K.POLLUTANTS],
    )


def column_density_points(pixels: DataFrame, gas: str, density: str, qa: str) -> DataFrame:
    """Satellite column pixels to surface points: good quality, inside the box, positive and finite."""
    x0, y0, x1, y1 = K.COLUMN_BBOX
    good = (F.col(qa) >= 50) & F.col("lon").between(x0, x1) & F.col("lat").between(y0, y1)
    v = F.col(density)
    usable = (v > 0) & (v < F.lit(float("inf"))) & ~F.isnan(v)
    return pixels.where(good & usable).withColumn(gas, column_to_surface(density, gas))


def merge_providers(providers: Sequence[DataFrame], tie: str = "station_id") -> DataFrame:
    """Observations of all providers; one per place (4 decimals), the provider named first wins."""
    keyed = [p.withColumns({"_lat": F.rint(F.col("lat") * 1e4), "_lon": F.rint(F.col("lon") * 1e4)}) for p in providers]
    return first_by_priority(keyed, ["_lat", "_lon"], [tie]).drop("_lat", "_lon")


def scene_catalogue(documents: DataFrame, text: str) -> DataFrame:
    """Catalogue documents with nested statistics to one row per acquisition."""
    stats = "struct<mean_lst_c: double, min_lst_c: double, max_lst_c: double>"
    item = f"struct<date: string, scene_id: string, cloud_cover_pct: double, season: string, valid_pixel_fraction: double, lst_stats: {stats}>"
    doc = F.from_json(text, f"source string, observations array<{item}>")
    o = documents.select(F.explode(doc["observations"]).alias("o"))
    return o.select(
        F.to_date("o.date").alias("date"), F.coalesce("o.scene_id", F.lit("unknown")).alias("scene_id"),
        F.coalesce("o.cloud_cover_pct", F.lit(0.0)).alias("cloud_cover"), F.coalesce("o.season", F.lit("unknown")).alias("season"),
        F.coalesce("o.valid_pixel_fraction", F.lit(0.0)).alias("valid_pixel_fraction"),
        F.col("o.lst_stats.mean_lst_c").alias("mean_lst"), F.col("o.lst_stats.min_lst_c").alias("min_lst"), F.col("o.lst_stats.max_lst_c").alias("max_lst"),
    )


def tag_layers(features: DataFrame, tags: Sequence[str], labels: dict[tuple[str, str], str] | None = None) -> DataFrame:
    """One layer per (tag, value) plus all_<tag>, rows without repeats. `labels` gives friendly layer names."""
    others = [c for c in features.columns if c not in tags]
    long = features.unpivot(others, list(tags), "tag", "tag_value").where(F.trim("tag_value") != "")
    value = F.lower(F.trim("tag_value"))
    name = F.concat_ws("_", F.col("tag"), value)
    for (tag, v), label in (labels or {}).items():
        name = F.when((F.col("tag") == tag) & (value == v), F.lit(label)).otherwise(name)
    named = long.select(*others, F.explode(F.array(safe_name(name), F.concat(F.lit("all_"), safe_name("tag")))).alias("layer"))
    return named.dropDuplicates()


def tree_points(points: DataFrame, rows: DataFrame, areas: DataFrame, step_m: float = 40.0) -> DataFrame:
    """Single trees, tree rows sampled about every `step_m`, and wood or scrub centroids, in one point layer."""
    from thermogrid.functions import polyline_length_m, vertex_centroid

    single = points.select(F.col("lon"), F.col("lat"), F.lit("tree").alias("kind"))
    lines = rows.where(F.size("coords") >= 2).withColumn("_n", F.greatest(F.lit(2), F.floor(polyline_length_m("coords") / F.lit(step_m)).cast("int")))
    spread = lines.select("coords", "_n", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_k"))
    at = F.col("_k") / F.greatest(F.lit(1), F.col("_n") - 1) * (F.size("coords") - 1)
    seg = F.least(F.floor(at).cast("int"), F.size("coords") - 2)
    placed = spread.select("coords", seg.alias("_i"), (at - seg).alias("_f"))
    a, b = F.element_at("coords", F.col("_i") + 1), F.element_at("coords", F.col("_i") + 2)
    sampled = placed.select(
        (a["x"] + (b["x"] - a["x"]) * F.col("_f")).alias("lon"), (a["y"] + (b["y"] - a["y"]) * F.col("_f")).alias("lat"),
        F.lit("tree_row").alias("kind"),
    )
    natural = F.lower("natural")
    c = vertex_centroid("coords")
    woods = areas.where(natural.isin("wood", "scrub", "tree") & (F.size("coords") > 0)).select(
        c["x"].alias("lon"), c["y"].alias("lat"), F.concat(F.lit("natural_"), natural).alias("kind"))
    return single.unionByName(sampled).unionByName(woods)
