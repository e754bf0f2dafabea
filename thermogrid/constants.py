"""Fixed values. They must stay as they are: results depend on every one of them."""

from __future__ import annotations

import math

# --- Physical and geodetic constants (fixed values) ---
EARTH_RADIUS_M = 6_371_000.0
WALK_SPEED_KMH = 4.8
KELVIN_OFFSET = 273.15
LST_SCALE_MUL = 0.00341802
LST_SCALE_ADD = 149.0
QA_CLOUD_MASK = 0b11111
REFLECTANCE_SCALE = 0.0001
M_PER_DEG_LAT = math.pi * EARTH_RADIUS_M / 180.0
REFERENCE_LATITUDE = 20.26
M_PER_DEG_LNG = M_PER_DEG_LAT * math.cos(math.radians(REFERENCE_LATITUDE))
CELL_SIZE_M = 100.0
UTM_ZONE_45N = 45

# --- Class breaks and labels (fixed values) ---
GREEN_COVER_NDVI = 0.30
VEG_DENSITY_BREAKS = [0.10, 0.20, 0.40, 0.60]
VEG_DENSITY_LABELS = ["Very Low", "Low", "Moderate", "High", "Very High"]
LANDCOVER_WATER_NDVI = 0.05
LANDCOVER_BUILTUP_NDVI = 0.15
LANDCOVER_BARE_NDVI = 0.30
LANDCOVER_LABELS = {1: "Water", 2: "Vegetation", 3: "Built-up", 4: "Bare Land"}
HEAT_FIXED_BREAKS_C = [20.0, 25.0, 30.0, 35.0, 40.0]
HEAT_QUANTILES = [0.15, 0.35, 0.55, 0.75, 0.90]
HEAT_LABELS = ["Very Cool", "Cool", "Moderate", "Warm", "Hot", "Very Hot"]
AQI_UPPER_BOUNDS = [("Good", 50), ("Satisfactory", 100), ("Moderate", 200), ("Poor", 300), ("Very Poor", 400)]
AQI_LOWER_BOUNDS = [("Good", 0), ("Satisfactory", 51), ("Moderate", 101), ("Poor", 201), ("Very Poor", 301), ("Severe", 401)]
ASPECT_DIRECTIONS = ["N", "NE", "E", "SE", "S", "SW", "W", "NW"]

# --- Sub-index bands: (low, high, index low, index high); CO in mg/m3, the rest in ug/m3 (fixed values) ---
AQI_BANDS = {
    "pm25": [(0, 30, 0, 50), (31, 60, 51, 100), (61, 90, 101, 200), (91, 120, 201, 300), (121, 250, 301, 400), (251, None, 401, 500)],
    "pm10": [(0, 50, 0, 50), (51, 100, 51, 100), (101, 250, 101, 200), (251, 350, 201, 300), (351, 430, 301, 400), (431, None, 401, 500)],
    "no2": [(0, 40, 0, 50), (41, 80, 51, 100), (81, 180, 101, 200), (181, 280, 201, 300), (281, 400, 301, 400), (401, None, 401, 500)],
    "so2": [(0, 40, 0, 50), (41, 80, 51, 100), (81, 380, 101, 200), (381, 800, 201, 300), (801, 1600, 301, 400), (1601, None, 401, 500)],
    "co": [(0, 1.0, 0, 50), (1.1, 2.0, 51, 100), (2.1, 10.0, 101, 200), (10.1, 17.0, 201, 300), (17.1, 34.0, 301, 400), (34.1, None, 401, 500)],
    "o3": [(0, 50, 0, 50), (51, 100, 51, 100), (101, 168, 101, 200), (169, 208, 201, 300), (209, 748, 301, 400), (749, None, 401, 500)],
}
POLLUTANTS = ["pm25", "pm10", "no2", "so2", "co", "o3"]
MEASUREMENT_NAMES = {"pm25": "pm25", "pm2.5": "pm25", "pm10": "pm10", "no2": "no2", "so2": "so2", "co": "co", "o3": "o3"}
MOLAR_MASS = {"no2": 46.0055, "so2": 64.066, "co": 28.01, "o3": 47.998}
BOUNDARY_LAYER_M = 1000.0
COLUMN_BBOX = (85.7, 20.0, 86.0, 20.5)
DAILY_ARRAY_NAMES = {
    "temperature_2m_max": "temperature_max",
    "temperature_2m_min": "temperature_min",
    "temperature_2m_mean": "temperature_mean",
    "relative_humidity_2m_mean": "humidity",
    "wind_speed_10m_max": "wind_speed",
    "surface_pressure_mean": "pressure",
    "precipitation_sum": "precipitation",
    "cloud_cover_mean": "cloud_cover",
    "shortwave_radiation_sum": "solar_radiation",
}

# --- Seasons (fixed values) ---
METEO_SEASONS = {"DJF": [12, 1, 2], "MAM": [3, 4, 5], "JJA": [6, 7, 8], "SON": [9, 10, 11]}
LOCAL_SEASONS = {"winter": [12, 1, 2], "pre_monsoon": [3, 4, 5], "monsoon": [6, 7, 8, 9], "post_monsoon": [10, 11]}

# --- Weather (fixed values) ---
WEATHER_MISSING_FLAG = -999.0
WEATHER_UNIT_FACTORS = {"ps": 10.0, "allsky_sfc_sw_dwn": 1000.0 / 24.0}

# --- Road and land-use vocabularies (fixed values) ---
MOTOR_ROADS = [
    "motorway", "trunk", "primary", "secondary", "tertiary", "unclassified", "residential", "service",
    "living_street", "pedestrian", "primary_link", "secondary_link", "tertiary_link", "trunk_link",
    "motorway_link", "construction", "raceway", "bus_guideway",
]
MAJOR_ROADS = [
    "motorway", "trunk", "primary", "secondary", "tertiary",
    "primary_link", "secondary_link", "tertiary_link", "trunk_link", "motorway_link",
]
LANDUSE_GROUPS = {
    "Residential": ["residential"],
    "Commercial": ["commercial", "retail", "garages", "depot", "port", "harbour"],
    "Industrial": ["industrial", "quarry", "landfill", "brownfield"],
    "Institutional": ["education", "religious", "military"],
    "Agriculture": ["farmland", "farmyard", "agriculture", "orchard", "vineyard", "greenhouse_horticulture", "greenfield", "allotments"],
    "Green": ["forest", "grass", "meadow", "recreation_ground", "cemetery", "village_green"],
    "Railway": ["railway"],
}
TREE_NATURAL = ["tree", "tree_row", "wood", "scrub"]

# --- Weights of the composite indices (fixed values) ---
PROXIMITY_REF_M = 500.0
RATIO_EPS = 1e-6
HVI_WEIGHTS = {"impervious": 0.30, "low_green": 0.25, "building_density": 0.20, "road_exposure": 0.15, "low_ndvi": 0.10}
NDVI_SCALE_QUANTILES = [0.02, 0.98]
MAX_MISSING_PCT = 50.0
LEAKAGE_CORRELATION = 0.99
MAX_CATEGORICAL_VALUES = 12

# --- Scenario features: clamping bounds (fixed values; None means open) ---
FEATURE_BOUNDS = {
    "green_cover": (0.0, 100.0),
    "lc_vegetation_pct": (0.0, 100.0),
    "lc_builtup_pct": (0.0, 100.0),
    "lc_water_pct": (0.0, 100.0),
    "lc_bare_pct": (0.0, 100.0),
    "green_space_pct": (0.0, 100.0),
    "veg_density": (0.0, 100.0),
    "tree_density": (0.0, 100.0),
    "building_coverage_pct": (0.0, 100.0),
    "impervious_ratio": (0.0, 100.0),
    "mean_ndvi": (-1.0, 1.0),
    "max_ndvi": (-1.0, 1.0),
    "min_ndvi": (-1.0, 1.0),
    "hvi": (0.0, 1.0),
    "tree_count": (0.0, None),
    "building_count": (0.0, None),
    "dist_to_park": (1.0, None),
    "dist_to_water": (1.0, None),
    "green_to_built": (0.0, None),
    "veg_cooling": (0.0, None),
    "cooling_distance": (0.0, None),
}

# --- The seven standard scenarios: feature -> (kind, value) (fixed values) ---
SCENARIOS = {
    "increase_green_10": {
        "green_cover": ("add", 10.0), "mean_ndvi": ("add", 0.06), "max_ndvi": ("add", 0.03),
        "lc_vegetation_pct": ("add", 5.0), "veg_density": ("add", 5.0), "green_space_pct": ("add", 5.0),
        "tree_count": ("add", 10.0), "tree_density": ("add", 5.0), "green_to_built": ("mul", 1.20),
        "veg_cooling": ("mul", 1.15), "lc_builtup_pct": ("add", -5.0), "impervious_ratio": ("add", -5.0),
        "hvi": ("add", -0.03),
    },
    "increase_green_20": {
        "green_cover": ("add", 20.0), "mean_ndvi": ("add", 0.12), "max_ndvi": ("add", 0.06),
        "lc_vegetation_pct": ("add", 10.0), "veg_density": ("add", 10.0), "green_space_pct": ("add", 10.0),
        "tree_count": ("add", 20.0), "tree_density": ("add", 10.0), "green_to_built": ("mul", 1.40),
        "veg_cooling": ("mul", 1.30), "lc_builtup_pct": ("add", -10.0), "impervious_ratio": ("add", -10.0),
        "hvi": ("add", -0.06),
    },
    "decrease_buildings_10": {
        "building_coverage_pct": ("mul", 0.9), "building_density": ("mul", 0.9), "building_count": ("mul", 0.9),
        "lc_builtup_pct": ("mul", 0.9), "impervious_ratio": ("mul", 0.9), "hvi": ("add", -0.02),
        "green_to_built": ("mul", 1.10),
    },
    "decrease_buildings_20": {
        "building_coverage_pct": ("mul", 0.8), "building_density": ("mul", 0.8), "building_count": ("mul", 0.8),
        "lc_builtup_pct": ("mul", 0.8), "impervious_ratio": ("mul", 0.8), "hvi": ("add", -0.04),
        "green_to_built": ("mul", 1.20),
    },
    "increase_trees": {
        "tree_count": ("add", 50.0), "tree_density": ("add", 10.0), "mean_ndvi": ("add", 0.04),
        "veg_density": ("add", 5.0), "green_cover": ("add", 5.0), "veg_cooling": ("mul", 1.10),
    },
    "increase_parks": {
        "dist_to_park": ("mul", 0.75), "cooling_distance": ("mul", 1.15), "green_space_pct": ("add", 5.0),
        "green_to_built": ("mul", 1.10),
    },
    "increase_water": {
        "dist_to_water": ("mul", 0.75), "lc_water_pct": ("add", 2.0), "cooling_distance": ("mul", 1.10),
    },
}

# --- Interventions: what one full unit of strength does, and how much strength is one unit (fixed values) ---
INTERVENTIONS = {
    "tree_planting": {"unit": 50.0, "range": (0.0, None), "steps": dict(SCENARIOS["increase_trees"])},
    "cool_roof": {"unit": 100.0, "range": (0.0, 100.0), "steps": {
        "impervious_ratio": ("add", -5.0), "building_coverage_pct": ("add", -3.0), "hvi": ("add", -0.03), "veg_cooling": ("mul", 1.10)}},
    "green_corridor": {"unit": 50.0, "range": (0.0, None), "steps": {
        "green_space_pct": ("add", 8.0), "mean_ndvi": ("add", 0.03), "green_to_built": ("mul", 1.15), "veg_cooling": ("mul", 1.15), "dist_to_park": ("mul", 0.90)}},
}

# --- Where each model feature comes from: feature -> (source, status) (fixed values) ---
_OSM = "STATIC_GIS"
FEATURE_PROVENANCE = {
    "building_count": ("OpenStreetMap buildings", _OSM),
    "building_coverage_pct": ("OpenStreetMap buildings", _OSM),
    "building_density": ("OpenStreetMap buildings", _OSM),
    "road_density": ("OpenStreetMap roads", _OSM),
    "dist_to_major_road": ("OpenStreetMap roads", _OSM),
    "tree_count": ("OpenStreetMap trees", _OSM),
    "tree_density": ("OpenStreetMap trees", _OSM),
    "green_space_pct": ("OpenStreetMap green spaces", _OSM),
    "dist_to_park": ("OpenStreetMap parks", _OSM),
    "dist_to_water": ("OpenStreetMap water bodies", _OSM),
    "mean_slope": ("DEM terrain data", _OSM),
    "mean_ndvi": ("Sentinel-2 (satellite)", "LATEST_OBSERVATION"),
    "green_cover": ("Sentinel-2 (satellite)", "LATEST_OBSERVATION"),
    "veg_density": ("Sentinel-2 (satellite)", "LATEST_OBSERVATION"),
    "land_cover_class": ("Sentinel-2 (satellite)", "LATEST_OBSERVATION"),
    "mean_aqi": ("OpenWeather Air Pollution", "LIVE"),
    "mean_pm25": ("OpenWeather Air Pollution", "LIVE"),
    "impervious_ratio": ("OSM built-up analysis", "LATEST_OBSERVATION"),
    "green_to_built": ("OSM land use analysis", "LATEST_OBSERVATION"),
    "cooling_distance": ("greenery and buildings", "DERIVED"),
    "veg_cooling": ("vegetation indices", "DERIVED"),
    "hvi": ("weighted features", "DERIVED"),
}
ACTIONABLE_FEATURES = [
    "impervious_ratio", "mean_pm25", "mean_ndvi", "green_cover", "building_coverage_pct",
    "tree_density", "dist_to_park", "mean_lst", "land_cover_class", "hvi",
]
