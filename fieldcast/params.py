"""Default thresholds and names. Every operator takes them as arguments."""

# They must equal the published model's for equal results.
MIN_DURATION_HRS = 0.08
MAX_DURATION_HRS = 5.0
MAX_OBSERVERS = 10
PROTOCOLS = ("P21", "P22")
TRAVELING_PROTOCOL = "P22"
NON_SPECIES_PREFIX = "y00"
CELL_DEGREES = 0.25
MIN_DETECTIONS = 200
MIN_PER_HOUR = 50
RIDGE_C = 1.0
TEST_SHARE = 0.25
SEED = 0
LAG_DAYS = 7
WINDOW_DAYS = 7
FEED_CAP = 200
CHUNK_DAYS = 15
CALLS_PER_DAY = 110
FORECAST_HOURS = tuple(range(6, 21))
FORECAST_DAYS = 7
REFERENCE_HOUR = 10
REFERENCE_DURATION_HRS = 0.5
REFERENCE_WIND = 12.0
MEDIAN_WEATHER = {"wind_max": 12.0, "temp_mean": 18.0, "precip_sum": 0.0, "cloud_mean": 60.0}
EXTENT = {"lat_min": 40.19, "lat_max": 40.68, "lon_min": -80.34, "lon_max": -79.69}
POOLED_SITE = "PERSONAL"
CAL_GOOD = 0.03
CAL_BAD = 0.08
CATEGORICAL = ("hr", "week", "site")
NUMERIC = (
    "log_dur", "log_dist", "n_observers", "traveling",
    "wind_max", "temp_mean", "precip_sum", "cloud_mean",
)
SCALAR_TERMS = ("intercept",) + NUMERIC
USABLE_LICENCES = (
    "cc0", "cc-by", "cc-by-sa", "cc-by-nd", "cc-by-nc", "cc-by-nc-sa", "cc-by-nc-nd",
)
WEEKS_IN_YEAR = 53
EARTH_KM = 6371.0088
SITE_SNAP_KM = 0.2
NEARBY_KM = 25.0
# how long a shared answer about a place holds
ANSWER_DAYS = 3
