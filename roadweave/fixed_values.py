"""Fixed values.

Everything in this file is a given of the traffic domain being served: road and
district lists, code tables, thresholds, label texts.  Results must use exactly
these values, so they are stated here as plain text and nowhere else.
"""

# --- fixed values: monitored roads as seeded in the location dimension ---------
# (name, lat, lon, district, road class)
SEED_ROADS = [
    ("Tahrir Square", 30.0444, 31.2357, "Downtown", "Square"),
    ("Nasr City Ring Road", 30.0626, 31.3417, "Nasr City", "Highway"),
    ("October Bridge", 30.0603, 31.2446, "Downtown", "Bridge"),
    ("El-Rawda St", 30.015822, 31.223920, "Old Cairo", "Main Road"),
    ("Maadi Corniche", 29.957459, 31.250348, "Maadi", "Corniche"),
    ("El-Gomhoreya St", 30.0499, 31.2466, "Downtown", "Main Road"),
    ("El-Gaish St", 30.052268, 31.254252, "Downtown", "Main Road"),
    ("Salah Salem Road", 30.0396, 31.2657, "Heliopolis", "Highway"),
    ("Ramses St", 30.052613, 31.237925, "Downtown", "Main Road"),
    ("Talaat Harb St", 30.0506, 31.2404, "Downtown", "Main Road"),
    ("El Haram St", 30.015433, 31.214553, "Giza", "Main Road"),
    ("Nile Corniche", 30.047107, 31.231616, "Downtown", "Corniche"),
    ("26th of July Corridor", 30.063321, 31.167581, "Mohandessin", "Highway"),
    ("Gamal Abd El-Nasser Rd", 30.051973, 31.216775, "Dokki", "Main Road"),
    ("Shobra St", 30.092088, 31.245208, "Shobra", "Main Road"),
    ("Abdulaziz Al Saud St", 30.023352, 31.223223, "Old Cairo", "Main Road"),
    ("Al Manial St", 30.012794, 31.224867, "Manial", "Main Road"),
    ("Al Malik Al Mozafar St", 30.014387, 31.223665, "Old Cairo", "Main Road"),
    ("Amro Ibn Al Aas St", 30.013521, 31.229385, "Old Cairo", "Main Road"),
    ("Magra El-Eyoun St", 30.020851, 31.240715, "Old Cairo", "Main Road"),
    ("Autostorad St", 29.997227, 31.278652, "Maadi", "Highway"),
    ("El-Qobba Bridge", 30.100566, 31.305483, "El-Qobba", "Bridge"),
    ("King Faisal St", 30.004008, 31.174183, "Giza", "Main Road"),
    ("Ring Road", 29.999456, 31.119034, "Giza", "Highway"),
    ("Ahmed Oraby St", 30.062267, 31.212831, "Dokki", "Main Road"),
]

# --- fixed values: district rectangles, first match in this order wins ---------
# (district, lat min, lat max, lon min, lon max), bounds inclusive
DISTRICT_BOXES = [
    ("Maadi", 29.9200, 30.0050, 31.2400, 31.3000),
    ("Giza", 29.9500, 30.0700, 31.1000, 31.2200),
    ("Heliopolis", 30.0800, 30.1300, 31.2700, 31.3600),
    ("Shobra", 30.0700, 30.1050, 31.2200, 31.2700),
    ("Nasr City", 30.0300, 30.0800, 31.2550, 31.3600),
    ("Manial", 30.0050, 30.0290, 31.2200, 31.2280),
    ("Old Cairo", 30.0050, 30.0300, 31.2280, 31.2550),
    ("Downtown Cairo", 30.0300, 30.0700, 31.2200, 31.2600),
]

# --- fixed values: known points for the nearest-point fallback, first wins ties -
# (name, lat, lon, district)
KNOWN_POINTS = [
    ("Tahrir Square", 30.0444, 31.2357, "Downtown Cairo"),
    ("Talaat Harb St", 30.0506, 31.2404, "Downtown Cairo"),
    ("Ramses St", 30.052613, 31.237925, "Downtown Cairo"),
    ("El-Gomhoreya St", 30.0499, 31.2466, "Downtown Cairo"),
    ("Nile Corniche", 30.047107, 31.231616, "Downtown Cairo"),
    ("October Bridge", 30.0603, 31.2446, "Downtown Cairo"),
    ("El-Gaish St", 30.052268, 31.254252, "Downtown Cairo"),
    ("El Haram St", 30.015433, 31.214553, "Giza"),
    ("26th of July Corridor", 30.063321, 31.167581, "Giza"),
    ("King Faisal St", 30.004008, 31.174183, "Giza"),
    ("Ring Road", 29.999456, 31.119034, "Giza"),
    ("Ahmed Oraby St", 30.062267, 31.212831, "Giza"),
    ("Gamal Abd El-Nasser Rd", 30.051973, 31.216775, "Giza"),
    ("El-Rawda St", 30.015822, 31.223920, "Manial"),
    ("Al Manial St", 30.012794, 31.224867, "Manial"),
    ("Al Malik Al Mozafar St", 30.014387, 31.223665, "Manial"),
    ("Abdulaziz Al Saud St", 30.023352, 31.223223, "Manial"),
    ("Amro Ibn Al Aas St", 30.013521, 31.229385, "Old Cairo"),
    ("Magra El-Eyoun St", 30.020851, 31.240715, "Old Cairo"),
    ("Nasr City Ring Road", 30.0626, 31.3417, "Nasr City"),
    ("Salah Salem Road", 30.0396, 31.2657, "Nasr City"),
    ("Maadi Corniche", 29.957459, 31.250348, "Maadi"),
    ("Autostorad St", 29.997227, 31.278652, "Maadi"),
    ("Shobra St", 30.092088, 31.245208, "Shobra"),
    ("El-Qobba Bridge", 30.100566, 31.305483, "Heliopolis"),
]

# --- fixed values: area in which the rectangles are consulted at all -----------
METRO_AREA = (29.5, 30.5, 30.5, 32.0)
EARTH_RADIUS_KM = 6371.0

# --- fixed values: weather dimension -------------------------------------------
# (condition, temperature range, rain level, visibility impact)
SEED_WEATHER = [
    ("Clear", "Hot (25-35°C)", "None", "Good"),
    ("Clouds", "Mild (15-25°C)", "None", "Good"),
    ("Rain", "Mild (15-25°C)", "Moderate", "Reduced"),
    ("Drizzle", "Mild (15-25°C)", "Light", "Good"),
    ("Thunderstorm", "Mild (15-25°C)", "Heavy", "Poor"),
    ("Sand", "Hot (25-35°C)", "None", "Poor"),
    ("Dust", "Hot (25-35°C)", "None", "Poor"),
    ("Fog", "Mild (15-25°C)", "None", "Poor"),
    ("Mist", "Mild (15-25°C)", "None", "Reduced"),
    ("Haze", "Hot (25-35°C)", "None", "Reduced"),
    ("Smoke", "Hot (25-35°C)", "None", "Poor"),
    ("Snow", "Cold (<15°C)", "None", "Poor"),
]

# --- fixed values: time dimension ----------------------------------------------
DAY_NAMES = ["Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday"]
# (first hour, last hour, label)
TIME_PERIODS = [
    (0, 5, "Late Night"),
    (6, 6, "Early Morning"),
    (7, 9, "Morning Rush"),
    (10, 15, "Midday"),
    (16, 19, "Evening Rush"),
    (20, 23, "Night"),
]
# (first hour, last hour, code) of the model feature
TIME_PERIOD_CODES = [(0, 5, 0), (6, 9, 1), (10, 14, 2), (15, 19, 3), (20, 23, 4)]
RUSH_HOURS = [(7, 9), (16, 19)]
FORECAST_RUSH_HOURS = [7, 8, 9, 15, 16, 17, 18, 19]

# --- fixed values: congestion classes ------------------------------------------
LEVELS = ["Free Flow", "Moderate", "Heavy", "Severe", "Closed"]
LEVEL_FLOORS = [(0.75, "Free Flow"), (0.50, "Moderate"), (0.25, "Heavy")]
EDA_LEVELS = ["Free Flow", "Light", "Moderate", "Heavy", "Severe", "Unknown"]
EDA_LEVEL_FLOORS = [(0.80, "Free Flow"), (0.60, "Light"), (0.40, "Moderate"), (0.20, "Heavy")]
SEVERITY_RANK = {"Severe": 0, "Closed": 1, "Heavy": 2, "Moderate": 3, "Free Flow": 4}

# --- fixed values: functional road classes -------------------------------------
ROAD_TYPES = {
    "FRC0": "Motorway / Freeway",
    "FRC1": "Major Road",
    "FRC2": "Other Major Road",
    "FRC3": "Secondary Road",
    "FRC4": "Local Road",
    "FRC5": "Local Road (minor)",
    "FRC6": "Local Road (very minor)",
}

# --- fixed values: incident codes ----------------------------------------------
INCIDENT_TYPES = {
    0: "Unknown",
    1: "Accident",
    2: "Fog",
    3: "Dangerous Conditions",
    4: "Rain",
    5: "Ice",
    6: "Jam",
    7: "Lane Closed",
    8: "Road Closed",
    9: "Road Works",
    10: "Wind",
    11: "Flooding",
    14: "Broken Down Vehicle",
}
DELAY_MAGNITUDES = {0: "Unknown", 1: "Minor", 2: "Moderate", 3: "Major", 4: "Undefined"}

# --- fixed values: polling schedule in local hours ------------------------------
# (from hour, before hour, seconds, label)
POLL_SCHEDULE = [
    (7, 10, 600, "morning rush"),
    (10, 16, 1200, "midday"),
    (16, 19, 600, "evening rush"),
    (19, 23, 1200, "evening"),
    (23, 24, 1800, "night"),
    (0, 7, 1800, "night"),
]
POLL_DEFAULT = (600, "default")
POLL_TIMEZONE = "Africa/Cairo"

# --- fixed values: data quality -------------------------------------------------
QUALITY_LAT = (29.85, 30.20)
QUALITY_LON = (31.05, 31.45)
DEDUCTIONS = {"fatal": 50, "critical": 30, "warning": 15, "info": 5}
PASS_SCORE = 50
WARN_SCORE = 80
STALE_MINUTES = 10
CHECK_LABELS = {
    "required_fields": "Missing required fields",
    "speed_sanity": "Unrealistic speed values",
    "free_flow_sanity": "Invalid free-flow speed",
    "closure_consistency": "Closure flag inconsistencies",
    "coordinates": "Coordinates outside Cairo",
    "freshness": "Stale readings",
    "weather_sanity": "Weather data issues",
}

# --- fixed values: statistics used when no document is available ----------------
FALLBACK_STATS = {
    "avg_speed": 24.0,
    "avg_free_flow_speed": 34.0,
    "avg_congestion_ratio": 0.71,
    "avg_delay_seconds": 160.0,
}

# --- fixed values: weather defaults of the feature row (NULL and 0 are replaced) -
WEATHER_DEFAULTS = {"weather_temp": 25.0, "weather_humid": 40, "weather_wind": 3.0, "weather_rain": 0.0}

# --- fixed values: forecasting ----------------------------------------------------
LAG_ROWS = {"10min": 1, "30min": 3, "1hr": 6, "1day": 144}
HORIZON_MINUTES = {"20min": 20, "30min": 30, "60min": 60}
WARM_ROWS = 144
BUFFER_ROWS = 145
BACKFILL_ROWS = 150
BACKFILL_HOURS = 48
CONGESTION_FEATURES = [
    "current_speed", "free_flow_speed", "congestion_ratio", "speed_drop_pct", "delay_seconds",
    "speed_deviation", "hour", "day_of_week", "is_weekend", "is_rush_hour", "time_period", "month",
    "temperature", "humidity", "wind_speed", "rain_mm", "is_raining", "frc_encoded",
    "district_target_encoded", "loc_avg_speed", "loc_avg_congestion", "is_slow_road", "confidence",
]
ANOMALY_FEATURES = [
    "current_speed", "free_flow_speed", "congestion_ratio", "speed_drop_pct", "delay_seconds",
    "speed_deviation", "hour", "is_rush_hour", "rain_mm", "wind_speed", "loc_avg_speed",
    "loc_avg_congestion",
]
FORECAST_FEATURES = [
    "current_speed", "free_flow_speed", "congestion_ratio", "speed_drop_pct", "delay_seconds",
    "speed_lag_10min", "speed_lag_30min", "speed_lag_1hr", "speed_lag_1day",
    "ratio_lag_10min", "ratio_lag_30min", "ratio_lag_1hr", "ratio_lag_1day",
    "speed_trend_30min", "ratio_trend_30min", "congestion_buildup_1hr", "buildup_acceleration",
    "hour", "day_of_week", "is_weekend", "is_rush_hour", "month", "temperature", "humidity",
    "wind_speed", "rain_mm", "is_raining", "frc_encoded", "district_encoded", "requested_lat",
    "requested_lon", "confidence",
]

# --- fixed values: alerts and incident matching -----------------------------------
COOLDOWN_MINUTES = 10
CITY_ALERT_PLACE = "Cairo (All Roads)"
INCIDENT_RADIUS_DEG = 0.002
SNAPSHOT_CACHE_SECONDS = 240

# --- fixed values: weather advisories, first matching condition wins ---------------
# (conditions, text, severity); the rain rules come before these
CONDITION_ADVISORIES = [
    (["Clear"], "☀️ Clear skies → normal traffic conditions", "free"),
    (["Clouds"], "☁️ Cloudy skies → normal traffic conditions", "free"),
    (["Fog", "Mist"], "🌫️ Low visibility → drivers slowing down, expect mild delays", "moderate"),
    (["Haze"], "🌫️ Hazy conditions → reduced visibility, drive carefully", "moderate"),
    (["Dust", "Sand"], "🏜️ Dust/Sand storm → poor visibility, expect significant delays", "heavy"),
    (["Smoke"], "💨 Smoky conditions → reduced visibility, expect delays", "heavy"),
    (["Drizzle"], "🌦️ Light drizzle → roads may be slippery, mild delays", "moderate"),
    (["Snow"], "❄️ Snow detected → rare for Cairo, expect major disruption", "severe"),
]
