"""Table schemas, column names and fixed values shared by every operator."""

from pyspark.sql import types as T

# --- fixed values: column names of the daily activity files, in file order ---
RAW_COLUMNS = ["datetime", "CellID", "countrycode", "smsin", "smsout", "callin", "callout", "internet"]

# --- fixed values: raw name -> canonical name ---
CANONICAL_NAMES = {
    "datetime": "timestamp",
    "CellID": "grid_id",
    "countrycode": "country_code",
    "smsin": "sms_in",
    "smsout": "sms_out",
    "callin": "call_in",
    "callout": "call_out",
    "internet": "internet_activity",
}

# --- fixed values: column names ---
MEASURES = ["sms_in", "sms_out", "call_in", "call_out", "internet_activity"]
RAW_MEASURES = ["smsin", "smsout", "callin", "callout", "internet"]
CELL_HOUR = ["grid_id", "timestamp"]
CALENDAR = ["date", "hour", "day_of_week"]
TOTALS = ["total_sms", "total_calls", "total_activity"]

# --- fixed values: the daily file glob; the city code keeps other cities' files out ---
DAILY_FILE_GLOB = "sms-call-internet-mi-*.csv"

# --- fixed values: hourly timestamps per daily file ---
HOURS_PER_FILE = 24

# --- fixed values: alert rules ---
HIGH_MULTIPLIER = 2.0
DROP_FRACTION = 0.25
SPIKE_MULTIPLIER = 2.0
FLOOR_PERCENTILE = 0.25

# --- fixed values: alert type -> severity; anything else is MEDIUM ---
SEVERITY = {"HIGH_ACTIVITY": "HIGH", "ACTIVITY_SPIKE": "MEDIUM", "ACTIVITY_DROP": "LOW"}
SEVERITY_RANK = {"HIGH": 3, "MEDIUM": 2, "LOW": 1}
RISING_ALERTS = ["HIGH_ACTIVITY", "ACTIVITY_SPIKE"]

# --- fixed values: anomaly directions at +50 % / -50 % of the baseline ---
ANOMALY_CUT = 0.50

# --- fixed values: model features, label threshold, risk levels, model name ---
FEATURES = ["avg_activity", "activity_growth", "active_hours", "peak_ratio", "variability", "internet_share"]
HIGH_ACTIVITY_THRESHOLD = 1186.8269
RISK_HIGH, RISK_MEDIUM = 0.66, 0.33
MODEL_VERSION = "ml3-logistic-regression-v1"
TRAIN_FRACTION = 0.8

# --- fixed values: status texts of the service queries ---
DEFAULT_HOTSPOT_REASON = "Highest activity for the selected hour."
NO_ANOMALY_DIRECTION = "NO_ANOMALY_RECORD"
ATTENTION_TEXT = "Investigate grid %d: predicted activity risk is %s (%s). ML4 status is %s with anomaly score %s. %s"
NO_ANOMALY_REASON = "No ML4 anomaly record is available for this grid and hour."

# --- fixed values: schemas of files and tables ---
RAW_SCHEMA = T.StructType(
    [
        T.StructField("datetime", T.StringType()),
        T.StructField("CellID", T.IntegerType()),
        T.StructField("countrycode", T.IntegerType()),
    ]
    + [T.StructField(name, T.DoubleType()) for name in RAW_MEASURES]
)

LOOKUP_SCHEMA = "grid_id long, geometry_json string, centroid_lon double, centroid_lat double"

ALERT_SCHEMA = (
    "grid_id long, timestamp timestamp, alert_type string, current_activity double, "
    "baseline_activity double, reason string"
)

AUDIT_SCHEMA = "timestamp timestamp, filename string, status string, reason string"

RUN_STATUS_SCHEMA = (
    "run_id string, timestamp timestamp, overall_status string, rows_in long, rows_rejected long, "
    "nulls_handled long, rows_published long, as_of_reason string, reason string, task_status map<string,string>"
)
