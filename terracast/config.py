"""Fixed values shared by all operators."""
from __future__ import annotations

from dataclasses import dataclass, field

# ---- fixed values: table contracts -------------------------------------------------
OBSERVATION_REQUIRED = ["station_id", "timestamp", "latitude", "longitude"]
OBSERVATION_OPTIONAL = ["temperature", "humidity", "rainfall", "pressure", "wind_speed", "station_elevation"]
FORECAST_REQUIRED = ["forecast_issue_time", "valid_time", "lead_time", "latitude", "longitude"]
FORECAST_OPTIONAL = ["temperature", "humidity", "rainfall", "wind_speed", "pressure"]
WEATHER_VARIABLES = ["temperature", "humidity", "rainfall", "pressure", "wind_speed"]

# ---- fixed values: quality limits (inclusive) --------------------------------------
HARD_LIMITS = {
    "temperature": (-60.0, 60.0),
    "humidity": (0.0, 100.0),
    "rainfall": (0.0, 1000.0),
    "pressure": (870.0, 1085.0),
    "wind_speed": (0.0, 200.0),
}
SOFT_LIMITS = {
    "temperature": (-10.0, 52.0),
    "humidity": (5.0, 100.0),
    "rainfall": (0.0, 500.0),
    "pressure": (940.0, 1060.0),
    "wind_speed": (0.0, 100.0),
}
COUNTRY_BOUNDS = {"lat_min": 6.0, "lat_max": 38.0, "lon_min": 68.0, "lon_max": 98.0}
MISSING_WARN_PCT = 10.0
MISSING_FAIL_PCT = 50.0
DEFAULT_RAIN = 0.0
DEFAULT_ELEVATION = 350.0

# ---- fixed values: baselines, splits, thresholds -----------------------------------
LAPSE_RATE = -0.0065
QUANTILE_LEVELS = 100
RAIN_THRESHOLDS = {"rain_1mm": 1.0, "rain_10mm": 10.0, "rain_25mm": 25.0}
LEADS = [24, 48, 72]
ALPHA = 0.2
RELIABILITY_WIDTHS = {"temperature": (3.0, 5.0), "humidity": (20.0, 40.0)}
HIGH_STATION_M = 500.0
SHIFT_LIMIT = 10.0
MIN_CELLS = 3
DECISION_THRESHOLD = 0.5
NO_WATER_M = 99999.0
ALL_SPLITS = ["TRAIN", "CALIBRATION", "TEST"]

# ---- fixed values: grid and raster -------------------------------------------------
CELL_M = 1000.0
BBOX_PAD_DEG = 0.02
RASTER_STEP_M = 30.0
WINDOW_RADIUS = 5
FLAT_SLOPE_DEG = 0.1
LANDCOVER_CLASSES = {10: "Tree cover", 20: "Shrubland", 30: "Grassland", 40: "Cropland", 50: "Built-up", 80: "Water"}
LANDCOVER_FRACTIONS = {"tree": 10, "shrub": 20, "grass": 30, "cropland": 40, "builtup": 50, "water": 80}
GRID_COVERAGE = {"lat_min": 10.30, "lat_max": 11.30, "lon_min": 76.70, "lon_max": 77.20}

# ---- fixed values: model inputs ----------------------------------------------------
FORECAST_FEATURES = ["forecast_temperature", "forecast_humidity", "forecast_rainfall", "lead_time_hours"]
GEO_FEATURES = [
    "elevation_mean", "elevation_std", "elevation_range", "slope_mean", "slope_std", "aspect_sin", "aspect_cos",
    "tri_mean", "tri_std", "landcover_fraction_tree", "landcover_fraction_shrub", "landcover_fraction_grass",
    "landcover_fraction_cropland", "landcover_fraction_builtup", "landcover_fraction_water",
    "distance_to_nearest_water", "distance_to_forecast_grid_m",
]
TIME_FEATURES = ["day_of_year_sin", "day_of_year_cos", "month"]
FORBIDDEN_FEATURES = [
    "station_id", "station_group", "latitude_obs", "longitude_obs", "observed_temperature", "observed_humidity",
    "observed_rainfall", "residual_temperature", "residual_humidity", "b0_temperature", "b0_humidity",
    "b1_temperature", "b1_humidity", "b3_temperature", "b3_humidity",
]


@dataclass(frozen=True)
class SplitWindows:
    """Chronological split ends, inclusive; a date-only end means that midnight."""

    train_end: str = "2024-03-31 00:00:00"
    calibration_end: str = "2024-04-30 00:00:00"


@dataclass(frozen=True)
class BoostParams:
    """Boosted tree settings."""

    trees: int = 100
    depth: int = 5
    rate: float = 0.05
    row_share: float = 0.8
    column_share: str = "0.8"
    min_rows: int = 10
    seed: int = 42


REGRESSION_BOOST = BoostParams()
RAIN_BOOST = BoostParams(depth=4)


@dataclass(frozen=True)
class SourceSpec:
    """What a raw source must bring."""

    name: str
    required: list = field(default_factory=list)
    optional: list = field(default_factory=list)
    mapping: dict = field(default_factory=dict)
    extensions: tuple = ("csv",)
    provenance: str = "UNVERIFIED"


OBSERVATIONS = SourceSpec("observations", OBSERVATION_REQUIRED, OBSERVATION_OPTIONAL)
FORECASTS = SourceSpec("forecasts", FORECAST_REQUIRED, FORECAST_OPTIONAL)
