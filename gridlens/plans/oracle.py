"""The registered queries as plain SQL over the same Parquet tables, for an independent engine."""

from gridlens.plans.catalog import EXAMPLE_COEFFICIENTS, EXAMPLE_INTERCEPT
from gridlens.plans.fixtures import EVENT_MEASURES, FILE_PREFIX, FIXTURE_THRESHOLD
from gridlens.schema import CANONICAL_NAMES, FEATURES, MEASURES, RAW_COLUMNS, RAW_MEASURES

_HOURLY = """
    SELECT *, sms_in + sms_out AS total_sms, call_in + call_out AS total_calls,
           (sms_in + sms_out) + (call_in + call_out) + internet_activity AS total_activity,
           CASE WHEN (sms_in + sms_out) + (call_in + call_out) + internet_activity <> 0
                THEN internet_activity / ((sms_in + sms_out) + (call_in + call_out) + internet_activity) END AS internet_share
    FROM (SELECT grid_id, timestamp, date, hour, day_of_week, {sums} FROM {clean} GROUP BY ALL)
"""
_SUMS = ", ".join(f"CAST(sum(CAST({m} AS DECIMAL(18,2))) AS DOUBLE) AS {m}" for m in MEASURES)


def _text(value: str, digits: int) -> str:
    """A number as text, rounded half up on its decimal form."""
    return f"CAST(round(CAST({value} AS DECIMAL(38,10)), {digits}) AS VARCHAR)"


def _clean(source: str) -> str:
    """Quarantine, null-to-zero, calendar and totals."""
    filled = ", ".join(f"coalesce({m}, 0.0) AS {m}" for m in MEASURES)
    return f"""
        SELECT *, CAST(timestamp AS DATE) AS date, CAST(hour(timestamp) AS INTEGER) AS hour,
               dayname(timestamp) AS day_of_week, sms_in + sms_out AS total_sms, call_in + call_out AS total_calls,
               (sms_in + sms_out) + (call_in + call_out) + internet_activity AS total_activity
        FROM (SELECT timestamp, grid_id, country_code, {filled} FROM {source} WHERE reject_cause IS NULL)
    """


def _median_of_others(hourly: str, bucket: str) -> str:
    """Brute force: the sorted list of every other value of the bucket."""
    same = " AND ".join(f"o.{c} = t.{c}" for c in bucket.split(", "))
    differs = "(o.timestamp <> t.timestamp OR o.grid_id <> t.grid_id)"
    return f"""
        SELECT grid_id, timestamp, (l[(len(l) + 1) // 2] + l[(len(l) + 2) // 2]) / 2 AS baseline_activity
        FROM (SELECT t.grid_id, t.timestamp,
                     list_sort(list(o.total_activity) FILTER (WHERE o.total_activity IS NOT NULL)) AS l
              FROM {hourly} t LEFT JOIN {hourly} o ON {same} AND {differs}
              GROUP BY t.grid_id, t.timestamp)
    """


def _alerts(hourly: str, baseline: str) -> str:
    return f"""
        WITH floors AS (SELECT date, quantile_cont(total_activity, 0.25) AS floor FROM {hourly} GROUP BY date),
        judged AS (
            SELECT h.grid_id, h.timestamp, h.date, h.total_activity AS cur, b.baseline_activity AS base, f.floor,
                   lag(h.total_activity) OVER (PARTITION BY h.date, h.grid_id ORDER BY h.hour, h.timestamp) AS prev
            FROM {hourly} h JOIN {baseline} b ON h.grid_id = b.grid_id AND h.timestamp = b.timestamp
                 JOIN floors f ON h.date = f.date)
        SELECT *, alert_type || ': current activity ' || {_text("current_activity", 2)} || ' is ' || CASE alert_type
                   WHEN 'HIGH_ACTIVITY' THEN 'more than 2.0x this grid''s within-day baseline of '
                   WHEN 'ACTIVITY_DROP' THEN 'below 0.25x this grid''s within-day baseline of '
                   ELSE 'more than 2.0x the immediately preceding hour''s ' END || {_text("baseline_activity", 2)} AS reason
        FROM (SELECT grid_id, timestamp, 'HIGH_ACTIVITY' AS alert_type, cur AS current_activity, base AS baseline_activity, date AS source_file
              FROM judged WHERE base >= floor AND cur > base * 2.0
              UNION ALL SELECT grid_id, timestamp, 'ACTIVITY_DROP', cur, base, date FROM judged WHERE base >= floor AND cur < base * 0.25
              UNION ALL SELECT grid_id, timestamp, 'ACTIVITY_SPIKE', cur, prev, date FROM judged WHERE prev >= floor AND cur > prev * 2.0)
    """


def _scores(hourly: str, baseline: str) -> str:
    return f"""
        SELECT *, CASE WHEN baseline_activity IS NULL THEN 'NO_BASELINE' WHEN anomaly_score >= 0.5 THEN 'HIGH'
                       WHEN anomaly_score <= -0.5 THEN 'LOW' ELSE 'NORMAL' END AS direction,
               CASE WHEN baseline_activity IS NULL THEN 'No historical baseline available for this grid and hour'
                    WHEN baseline_activity <= 0 THEN 'Historical baseline is zero or negative'
                    WHEN anomaly_score = 0 THEN 'Activity matches the historical baseline'
                    ELSE 'Activity is ' || {_text("abs(anomaly_score) * 100", 2)} || '% ' || CASE WHEN anomaly_score > 0 THEN 'above' ELSE 'below' END
                         || ' the historical median for grid ' || grid_id || ' at hour ' || lpad(CAST(hour AS VARCHAR), 2, '0') || ':00' END AS reason
        FROM (SELECT h.grid_id, h.timestamp, h.hour, h.total_activity, b.baseline_activity,
                     h.total_activity - b.baseline_activity AS deviation,
                     CASE WHEN b.baseline_activity > 0 THEN (h.total_activity - b.baseline_activity) / b.baseline_activity
                          ELSE 0.0 END AS anomaly_score
              FROM {hourly} h JOIN {baseline} b ON h.grid_id = b.grid_id AND h.timestamp = b.timestamp)
    """


def _history(hourly: str) -> str:
    return f"""
        SELECT grid_id, timestamp, total_activity, internet_activity,
               count(total_activity) OVER r AS recent_count, count(total_activity) OVER e AS baseline_count,
               avg(total_activity) OVER r AS recent_avg, avg(total_activity) OVER e AS baseline_avg,
               max(total_activity) OVER r AS recent_peak,
               CAST(sum(CASE WHEN total_activity > 0 THEN 1 ELSE 0 END) OVER r AS BIGINT) AS active_hours,
               stddev_samp(total_activity) OVER r AS recent_stddev,
               sum(internet_activity) OVER r AS recent_internet, sum(total_activity) OVER r AS recent_total,
               min(timestamp) OVER (PARTITION BY grid_id ORDER BY timestamp ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS history_start
        FROM {hourly}
        WINDOW r AS (PARTITION BY grid_id ORDER BY timestamp ROWS BETWEEN 2 PRECEDING AND CURRENT ROW),
               e AS (PARTITION BY grid_id ORDER BY timestamp ROWS BETWEEN 5 PRECEDING AND 3 PRECEDING)
    """


def _features(history: str) -> str:
    return f"""
        SELECT grid_id, timestamp AS feature_timestamp, history_start, recent_avg AS avg_activity,
               CASE WHEN baseline_avg > 0 THEN (recent_avg - baseline_avg) / baseline_avg ELSE 0.0 END AS activity_growth,
               active_hours, CASE WHEN recent_avg > 0 THEN recent_peak / recent_avg ELSE 0.0 END AS peak_ratio,
               coalesce(recent_stddev, 0.0) AS variability,
               CASE WHEN recent_total > 0 THEN recent_internet / recent_total ELSE 0.0 END AS internet_share
        FROM {history} WHERE recent_count = 3 AND baseline_count = 3
    """


_SIGNED = "CASE WHEN event_id % 97 = 5 THEN -value ELSE value END"
_RAW_MEASURES = ", ".join(f"CASE WHEN event_type = '{kind}' THEN {_SIGNED} END AS {n}" for n, kind in EVENT_MEASURES.items())
_RENAMED = ", ".join(f"{old} AS {new}" for old, new in CANONICAL_NAMES.items())
_NON_FINITE = " OR ".join(f"coalesce(NOT isfinite({m}), false)" for m in MEASURES)
_NEGATIVE = " OR ".join(f"coalesce({m} < 0, false)" for m in MEASURES)
_MARGIN = " + ".join(
    f"(f.{name} - s.m_{name}) / s.s_{name} * {coefficient!r}"
    for name, coefficient in zip(FEATURES, EXAMPLE_COEFFICIENTS, strict=True)
)
_STATS = ", ".join(
    f"avg({f}) AS m_{f}, CASE WHEN stddev_pop({f}) = 0 THEN 1.0 ELSE stddev_pop({f}) END AS s_{f}" for f in FEATURES
)
_STANDARDISED = ", ".join(f"round((f.{n} - s.m_{n}) / s.s_{n}, 6) + 0.0 AS {n}" for n in FEATURES)
_LINE = " || ',' || ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in RAW_COLUMNS)
_VIOLATION = " ".join(
    ["CASE WHEN try_cast(datetime AS TIMESTAMP) IS NULL THEN 'Invalid datetime'"]
    + [f"WHEN {m} < 0 THEN 'Negative value in {m}'" for m in RAW_MEASURES]
    + ["END"]
)

# name -> (tables it reads, SELECT)
_TABLES: dict[str, tuple[str, str]] = {
    "raw_rows": (
        "",
        f"""SELECT event_id,
            CASE WHEN event_id % 101 = 11 THEN 'not-a-time'
                 ELSE strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') END AS datetime,
            CASE WHEN event_id % 89 = 7 THEN NULL ELSE CAST(user_id // 10 + 1 AS INTEGER) END AS CellID,
            CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS INTEGER) % 4 AS countrycode,
            {_RAW_MEASURES}, strftime(ts, '%Y-%m-%d') AS file_date
        FROM events""",
    ),
    "raw": ("raw_rows", f"SELECT {', '.join(RAW_COLUMNS)} FROM raw_rows"),
    "canonical": ("raw", f"SELECT {_RENAMED} FROM raw"),
    "flagged": (
        "canonical",
        f"""SELECT * REPLACE (try_cast(timestamp AS TIMESTAMP) AS timestamp),
            CASE WHEN grid_id IS NULL OR try_cast(timestamp AS TIMESTAMP) IS NULL THEN 'MISSING_KEY' WHEN {_NON_FINITE} THEN 'NON_FINITE_VALUE'
                 WHEN {_NEGATIVE} THEN 'NEGATIVE_VALUE' END AS reject_cause FROM canonical""",
    ),
    "clean": ("flagged", _clean("flagged")),
    "hourly": ("clean", _HOURLY.format(sums=_SUMS, clean="clean")),
    "day_base": ("hourly", _median_of_others("hourly", "date, grid_id")),
    "hour_base": ("hourly", _median_of_others("hourly", "grid_id, hour")),
    "alerts": ("hourly day_base", _alerts("hourly", "day_base")),
    "severities": (
        "alerts",
        """SELECT *, CASE alert_type WHEN 'HIGH_ACTIVITY' THEN 'HIGH' WHEN 'ACTIVITY_DROP' THEN 'LOW' ELSE 'MEDIUM' END AS severity,
            CASE alert_type WHEN 'HIGH_ACTIVITY' THEN 3 WHEN 'ACTIVITY_DROP' THEN 1 ELSE 2 END AS severity_rank FROM alerts""",
    ),
    "scores": ("hourly hour_base", _scores("hourly", "hour_base")),
    "history": ("hourly", _history("hourly")),
    "features": ("history", _features("history")),
    "nexts": (
        "hourly",
        """SELECT grid_id, timestamp, total_activity, lead(timestamp) OVER w AS target_timestamp,
            lead(total_activity) OVER w AS target_activity FROM hourly WINDOW w AS (PARTITION BY grid_id ORDER BY timestamp)""",
    ),
    "labelled": (
        "features nexts",
        f"""SELECT f.* EXCLUDE (history_start), n.target_timestamp, n.target_activity,
            CASE WHEN n.target_activity > {FIXTURE_THRESHOLD} THEN 1 ELSE 0 END AS high_activity_risk
        FROM features f JOIN nexts n ON f.grid_id = n.grid_id AND f.feature_timestamp = n.timestamp
        WHERE n.target_timestamp = f.feature_timestamp + INTERVAL 1 HOUR""",
    ),
    "split": (
        "labelled",
        """SELECT l.*, CASE WHEN d.position < floor(d.n * 0.8) THEN 'train' ELSE 'test' END AS split
        FROM labelled l JOIN (SELECT feature_timestamp, row_number() OVER (ORDER BY feature_timestamp) - 1 AS position,
                                     count(*) OVER () AS n
                              FROM (SELECT DISTINCT feature_timestamp FROM labelled)) d USING (feature_timestamp)""",
    ),
    "stats": ("split", f"SELECT {_STATS} FROM split WHERE split = 'train'"),
    "risk": (
        "features stats",
        f"""SELECT grid_id, timestamp, risk_score, CASE WHEN risk_score >= 0.66 THEN 'HIGH' WHEN risk_score >= 0.33 THEN 'MEDIUM'
                ELSE 'LOW' END AS risk_level, 'ml3-logistic-regression-v1' AS model_version
        FROM (SELECT f.grid_id, f.feature_timestamp AS timestamp, 1 / (1 + exp(-({EXAMPLE_INTERCEPT!r} + {_MARGIN}))) AS risk_score
              FROM features f, stats s)""",
    ),
    "predicted": (
        "split stats",
        f"""SELECT f.*, CASE WHEN {EXAMPLE_INTERCEPT!r} + {_MARGIN} > 0 THEN 1 ELSE 0 END AS ml_prediction
        FROM split f, stats s WHERE f.split = 'test'""",
    ),
    "rules": (
        "alerts",
        """SELECT grid_id, timestamp, bool_or(alert_type IN ('HIGH_ACTIVITY', 'ACTIVITY_SPIKE')) AS np3_positive,
            string_agg(DISTINCT alert_type, '|' ORDER BY alert_type) AS np3_alert_types FROM alerts GROUP BY ALL""",
    ),
    "compared": (
        "predicted rules",
        """SELECT *, CASE WHEN ml_prediction = 1 AND np3_positive THEN 'BOTH_RISK' WHEN ml_prediction = 1 THEN 'ML3_ONLY_RISK'
                WHEN np3_positive THEN 'NP3_ONLY_ALERT' ELSE 'AGREEMENT' END AS disagreement_type,
            (ml_prediction = 1) = np3_positive AS agreement
        FROM (SELECT p.*, coalesce(r.np3_positive, false) AS np3_positive, coalesce(r.np3_alert_types, 'NO_ALERT') AS np3_alert_types
              FROM predicted p LEFT JOIN rules r ON p.grid_id = r.grid_id AND p.feature_timestamp = r.timestamp)""",
    ),
    "three_way": (
        "split scores rules",
        """SELECT *, CASE WHEN ml4_positive AND ml3_positive AND np3_positive THEN 'ALL_THREE'
                WHEN ml4_positive AND ml3_positive THEN 'ML4_ML3' WHEN ml4_positive AND np3_positive THEN 'ML4_NP3'
                WHEN ml3_positive AND np3_positive THEN 'ML3_NP3' WHEN ml4_positive THEN 'ML4_ONLY'
                WHEN ml3_positive THEN 'ML3_ONLY' WHEN np3_positive THEN 'NP3_ONLY' ELSE 'ALL_NEGATIVE' END AS three_way_result
        FROM (SELECT t.grid_id, t.feature_timestamp, t.high_activity_risk = 1 AS ml3_positive,
                     coalesce(s.direction IN ('HIGH', 'LOW'), false) AS ml4_positive, coalesce(r.np3_positive, false) AS np3_positive
              FROM split t LEFT JOIN scores s ON t.grid_id = s.grid_id AND t.feature_timestamp = s.timestamp
                           LEFT JOIN rules r ON t.grid_id = r.grid_id AND t.feature_timestamp = r.timestamp
              WHERE t.split = 'test')""",
    ),
    "latest": ("hourly", "SELECT max(timestamp) AS as_of FROM hourly"),
    "hot": (
        "hourly latest risk severities",
        """SELECT h.*, coalesce(a.severity, 'NORMAL') AS status, coalesce(a.reason, 'Highest activity for the selected hour.') AS reason, r.risk_score, r.risk_level, r.model_version
        FROM (SELECT grid_id, timestamp, total_activity FROM hourly, latest WHERE timestamp = as_of
              ORDER BY total_activity DESC, grid_id LIMIT 50) h
        LEFT JOIN risk r ON r.grid_id = h.grid_id AND r.timestamp = h.timestamp
        LEFT JOIN (SELECT grid_id, timestamp, arg_max(severity, CASE alert_type WHEN 'HIGH_ACTIVITY' THEN 1 WHEN 'ACTIVITY_DROP'
                          THEN 2 ELSE 3 END) AS severity, arg_max(reason, CASE alert_type WHEN 'HIGH_ACTIVITY' THEN 1 WHEN 'ACTIVITY_DROP'
                          THEN 2 ELSE 3 END) AS reason FROM severities GROUP BY ALL) a
               ON a.grid_id = h.grid_id AND a.timestamp = h.timestamp""",
    ),
    "feed": (
        "severities risk",
        """SELECT a.* EXCLUDE (source_file), r.risk_score, r.risk_level, r.model_version
        FROM (SELECT * FROM severities ORDER BY timestamp DESC, severity_rank DESC, grid_id DESC, alert_type DESC LIMIT 50) a
        LEFT JOIN risk r ON r.grid_id = a.grid_id AND r.timestamp = a.timestamp""",
    ),
    "cells": (
        "hourly",
        """SELECT DISTINCT CAST(grid_id AS BIGINT) AS grid_id, 9.0 + ((grid_id - 1) % 100) * 0.01 + 0.004 AS centroid_lon,
            45.0 + ((grid_id - 1) // 100) * 0.01 + 0.004 AS centroid_lat FROM hourly""",
    ),
    "landing": (
        "raw_rows",
        f"""SELECT '{FILE_PREFIX}' || file_date || '-c' || coalesce(CAST(CellID AS VARCHAR), 'none') || '.csv' AS file, *
        FROM raw_rows""",
    ),
    "verdicts": (
        "landing",
        f"""SELECT file, reason = 'Validation passed' AS ok, reason
        FROM (SELECT file, coalesce(arg_min(violation || ' at row ' || n, n) FILTER (WHERE violation IS NOT NULL),
                                    'Validation passed') AS reason
              FROM (SELECT file, row_number() OVER (PARTITION BY file ORDER BY event_id) + 1 AS n, {_VIOLATION} AS violation
                    FROM landing) GROUP BY file)""",
    ),
    "audited": ("verdicts", f"SELECT *, CAST(substr(file, {len(FILE_PREFIX) + 9}, 2) AS INTEGER) <= 15 AS seen FROM verdicts"),
    "runs": (
        "",
        """SELECT file_date AS run_id, CAST(file_date AS TIMESTAMP) + INTERVAL 30 HOUR AS timestamp, rows_in, rows_rejected,
            rows_rejected * 1000 <= rows_in * 32 AS ok, latest
        FROM (SELECT r.file_date, count(*) AS rows_in, count(*) FILTER (WHERE bad) AS rows_rejected, max(t) AS latest
              FROM (SELECT strftime(ts, '%Y-%m-%d') AS file_date,
                           event_id % 101 = 11 OR event_id % 89 = 7 OR event_id % 97 = 5 AS bad,
                           CASE WHEN event_id % 101 <> 11 THEN date_trunc('hour', ts) END AS t FROM events) r
              GROUP BY ALL)""",
    ),
    "wide_clean": (
        "",
        _clean(
            """(SELECT TIMESTAMP '2013-11-01' + INTERVAL 1 HOUR * date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS timestamp,
                CAST(l_suppkey + 1 AS INTEGER) AS grid_id, l_linenumber AS country_code, l_quantity AS sms_in, l_discount * 100 AS sms_out,
                l_tax * 100 AS call_in, CAST(l_linenumber AS DOUBLE) AS call_out, NULL AS reject_cause,
                l_extendedprice AS internet_activity FROM lineitem)"""
        ),
    ),
    "wide_hourly": ("wide_clean", _HOURLY.format(sums=_SUMS, clean="wide_clean")),
    "wide_day_base": ("wide_hourly", _median_of_others("wide_hourly", "date, grid_id")),
    "wide_hour_base": ("wide_hourly", _median_of_others("wide_hourly", "grid_id, hour")),
    "wide_alerts": ("wide_hourly wide_day_base", _alerts("wide_hourly", "wide_day_base")),
    "wide_scores": ("wide_hourly wide_hour_base", _scores("wide_hourly", "wide_hour_base")),
    "wide_history": ("wide_hourly", _history("wide_hourly")),
    "wide_features": ("wide_history", _features("wide_history")),
    "wide_coverage": (
        "wide_hourly hourly",
        """SELECT w.grid_id, w.n, g.grid_id IS NOT NULL AS known FROM (SELECT grid_id, count(*) AS n FROM wide_hourly GROUP BY 1) w
        LEFT JOIN (SELECT DISTINCT grid_id FROM hourly) g ON g.grid_id = w.grid_id""",
    ),
}


def _with(body: str, *tables: str) -> str:
    """body preceded by the named tables and everything they read."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in _TABLES[name][0].split():
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in tables:
        add(name)
    return "WITH " + ",\n".join(f"{name} AS ({_TABLES[name][1]})" for name in ordered) + "\n" + body


def _rounded(*names: str, digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) + 0.0 AS {n}" for n in names)


_CLEAN_OUT = (
    "timestamp, grid_id, country_code, CAST(date AS VARCHAR) AS date, hour, day_of_week, "
    + _rounded(*MEASURES, "total_sms", "total_calls", "total_activity")
)
_HOURLY_OUT = (
    "grid_id, timestamp, CAST(date AS VARCHAR) AS date, hour, day_of_week, "
    + _rounded(*MEASURES, "total_sms", "total_calls", "total_activity", "internet_share")
)
_ALERT_OUT = (
    "grid_id, timestamp, alert_type, round(current_activity, 4) + 0.0 AS current_activity, "
    "round(baseline_activity, 4) + 0.0 AS baseline_activity, reason"
)
_SCORE_OUT = "grid_id, timestamp, hour, direction, reason, " + _rounded(
    "total_activity", "baseline_activity", "deviation", "anomaly_score"
)
_REAL_FEATURES = [f for f in FEATURES if f != "active_hours"]
_FEATURE_OUT = "grid_id, feature_timestamp, active_hours, " + _rounded(*_REAL_FEATURES)
_RISK_OUT = "round(risk_score, 6) + 0.0 AS risk_score, risk_level, model_version"
_SUMMARY = """SELECT timestamp AS as_of, round(sum(total_activity), 6) + 0.0 AS total_activity,
    count(DISTINCT grid_id) AS active_grids, max(hour) AS peak_hour,
    arg_max(grid_id, (total_activity, -grid_id)) AS top_grid FROM {0} GROUP BY timestamp"""
_DESCRIBE = " UNION ALL ".join(
    f"SELECT '{name}' AS statistic, round({expression}, 6) + 0.0 AS value FROM scores"
    for name, expression in {
        "count": "CAST(count(anomaly_score) AS DOUBLE)",
        "mean": "avg(anomaly_score)",
        "std": "stddev_samp(anomaly_score)",
        "min": "min(anomaly_score)",
        "max": "max(anomaly_score)",
        "25%": "quantile_cont(anomaly_score, 0.25)",
        "50%": "quantile_cont(anomaly_score, 0.5)",
        "75%": "quantile_cont(anomaly_score, 0.75)",
    }.items()
)


def _percentiles(source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT CAST({p} AS DOUBLE) AS probability, round(quantile_cont(total_activity, {p}), 6) + 0.0 AS quantile FROM {source}"
        for p in (0.5, 0.75, 0.9, 0.95, 0.99)
    )


def _per_column(columns: list[str], count: str, value: str, source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {count.format(c)}) AS {value} FROM {source}" for c in columns
    )


def _checks(source: str, **checks: tuple[str, str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS check_name, CAST({e} AS BIGINT) AS expected, CAST({a} AS BIGINT) AS actual, {p} AS passed FROM {source}"
        for name, (e, a, p) in checks.items()
    )


_KEY_FACTS = """(SELECT count(*) AS n, count(*) FILTER (WHERE grid_id IS NULL OR timestamp IS NULL) AS nulls,
    count(*) - count(DISTINCT (grid_id, timestamp)) AS dups, count(DISTINCT date) AS days FROM hourly) k"""
_CANONICAL = list(CANONICAL_NAMES.values())
_EVENT_HOURS = f"""SELECT user_id // 10 + 1 AS grid_id, date_trunc('hour', ts) AS timestamp, {", ".join(
    f"coalesce(CAST(sum(CAST(CASE WHEN event_type = '{kind}' THEN value END AS DECIMAL(18,2))) AS DOUBLE), 0.0) AS {CANONICAL_NAMES[n]}"
    for n, kind in EVENT_MEASURES.items())} FROM events GROUP BY ALL"""


_METRICS = """SELECT tp AS true_positives, fp AS false_positives, fn AS false_negatives, tn AS true_negatives,
               round((tp + tn) / (tp + tn + fp + fn), 6) + 0.0 AS accuracy,
               round(CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END, 6) + 0.0 AS precision,
               round(CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END, 6) + 0.0 AS recall,
               round((tp + fn) / (tp + tn + fp + fn), 6) + 0.0 AS test_base_rate
               FROM (SELECT count(*) FILTER (WHERE high_activity_risk = 1 AND ml_prediction = 1) AS tp,
                            count(*) FILTER (WHERE high_activity_risk = 0 AND ml_prediction = 1) AS fp,
                            count(*) FILTER (WHERE high_activity_risk = 1 AND ml_prediction = 0) AS fn,
                            count(*) FILTER (WHERE high_activity_risk = 0 AND ml_prediction = 0) AS tn FROM predicted)"""
_AGREEMENT = """SELECT count(*) FILTER (WHERE np3_positive) AS np3_positive_test_rows,
               count(*) FILTER (WHERE ml_prediction = 1) AS ml3_positive_test_rows,
               count(*) FILTER (WHERE np3_positive AND ml_prediction = 1) AS both_positive,
               count(*) FILTER (WHERE NOT np3_positive AND ml_prediction = 1) AS ml3_only_risk,
               count(*) FILTER (WHERE np3_positive AND ml_prediction = 0) AS np3_only_alert,
               count(*) FILTER (WHERE agreement) AS agreement FROM compared"""


def _own_sql() -> dict[str, str]:
    return {
        "scan_activity": _with(f"SELECT {', '.join(RAW_COLUMNS)} FROM raw", "raw"),
        "canonical_columns": _with("SELECT * FROM canonical", "canonical"),
        "source_file_counts": _with("SELECT file AS source_file, count(*) + 1 AS rows FROM landing GROUP BY file", "landing"),
        "scan_lineage": "SELECT 'events.parquet' AS source_file, count(*) AS rows FROM events",
        "validate_files": _with("SELECT * FROM verdicts", "verdicts"),
        "validate_spoiled_files": _with(
            f"""SELECT file, reason = 'Validation passed' AS ok, reason FROM (
                   SELECT file, CASE kind WHEN 0 THEN 'Invalid schema' WHEN 1 THEN 'Incorrect number of columns at row 2' WHEN 3 THEN 'No data rows'
                       WHEN 2 THEN CASE WHEN bad_time THEN 'Invalid datetime at row 2' ELSE 'Non-numeric value in smsin at row 2' END
                       WHEN 4 THEN CASE WHEN bad_time THEN 'Invalid datetime at row 2' ELSE 'Non-finite value in smsin at row 2' END
                       ELSE v.reason END AS reason
                   FROM (SELECT file, any_value(CellID) % 5 AS kind, arg_min(datetime, event_id) = 'not-a-time' AS bad_time
                         FROM landing GROUP BY file) JOIN verdicts v USING (file)
                   UNION ALL SELECT DISTINCT '{FILE_PREFIX}' || file_date || '-empty.csv', 'Empty file' FROM landing)""",
            "landing",
            "verdicts",
        ),
        "validate_quoted_files": _with(
            """SELECT file, reason = 'Validation passed' AS ok, reason FROM (
                   SELECT file, CASE kind WHEN 1 THEN 'Incorrect number of columns at row 2'
                       WHEN 2 THEN CASE WHEN bad_time THEN 'Invalid datetime at row 2' ELSE 'Non-numeric value in smsin at row 2' END
                       ELSE v.reason END AS reason
                   FROM (SELECT file, any_value(CellID) % 5 AS kind, arg_min(datetime, event_id) = 'not-a-time' AS bad_time
                         FROM landing GROUP BY file) JOIN verdicts v USING (file))""",
            "landing",
            "verdicts",
        ),
        "quoted_rows": _with(
            f"""SELECT {', '.join(RAW_COLUMNS)} FROM landing JOIN verdicts USING (file)
                WHERE ok AND coalesce(CellID % 5, 0) NOT IN (1, 2)""",
            "landing",
            "verdicts",
        ),
        "skip_ingested": _with(
            """SELECT file, 'SKIPPED' AS status, CASE WHEN ok THEN 'File already exists in raw'
               ELSE 'File already exists in rejected' END AS reason FROM audited WHERE seen""",
            "audited",
        ),
        "new_files": _with("SELECT file FROM audited WHERE NOT seen", "audited"),
        "route_files": _with(
            """SELECT file, count(*) + 1 AS lines, CASE WHEN any_value(ok) THEN 'raw' ELSE 'rejected' END AS zone
               FROM landing JOIN verdicts USING (file) GROUP BY file""",
            "landing",
            "verdicts",
        ),
        "ingestion_audit": _with(
            """SELECT TIMESTAMP '2024-02-02 00:00:00' AS timestamp, file AS filename,
                   CASE WHEN seen THEN 'SKIPPED' WHEN ok THEN 'ACCEPTED' ELSE 'REJECTED' END AS status,
                   CASE WHEN seen AND ok THEN 'File already exists in raw' WHEN seen THEN 'File already exists in rejected'
                        ELSE reason END AS reason FROM audited""",
            "audited",
        ),
        "clean_activity": _with(f"SELECT {_CLEAN_OUT} FROM clean", "clean"),
        "rejected_rows": _with("SELECT * FROM flagged WHERE reject_cause IS NOT NULL", "flagged"),
        "rejected_by_cause": _with(
            "SELECT reject_cause, count(*) AS rows FROM flagged WHERE reject_cause IS NOT NULL GROUP BY 1", "flagged"
        ),
        "clean_counters": _with(
            f"""SELECT count(*) AS input_rows, count(reject_cause) AS rejected_rows,
                count(*) FILTER (WHERE reject_cause = 'MISSING_KEY') AS rejected_missing_key,
                count(*) FILTER (WHERE reject_cause = 'NON_FINITE_VALUE') AS rejected_non_finite,
                count(*) FILTER (WHERE reject_cause = 'NEGATIVE_VALUE') AS rejected_negative,
                CAST(sum(CASE WHEN reject_cause IS NULL THEN {" + ".join(f"({m} IS NULL)::INT" for m in MEASURES)} END) AS BIGINT)
                    AS nulls_handled,
                count(*) FILTER (WHERE reject_cause IS NULL) AS output_rows FROM flagged""",
            "flagged",
        ),
        "drop_duplicate_keys": _with(
            """SELECT grid_id, timestamp, country_code, round(total_activity, 6) + 0.0 AS total_activity FROM clean
               QUALIFY row_number() OVER (PARTITION BY grid_id, timestamp ORDER BY total_activity DESC, country_code) = 1""",
            "clean",
        ),
        "union_tables": _with(
            f"""SELECT grid_id, timestamp, {_rounded('total_activity')}
                FROM (SELECT grid_id, timestamp, total_activity FROM hourly UNION SELECT grid_id, timestamp, total_activity FROM wide_hourly)""",
            "hourly",
            "wide_hourly",
        ),
        "profile_shape": _with(
            " UNION ALL ".join(
                f"SELECT '{c}' AS column_name, '{kind}' AS data_type, count(*) AS rows FROM raw"
                for c, kind in zip(RAW_COLUMNS, ["string", "int", "int", *["double"] * 5], strict=True)
            ),
            "raw",
        ),
        "partition_report": "SELECT count(*) AS rows, true AS listed_once FROM events",
        "approx_cardinalities": _with(
            "SELECT count(*) > 0 AS grids, count(*) > 0 AS country_codes, count(*) > 0 AS timestamps FROM canonical", "canonical"
        ),
        "csv_files": _with(f"SELECT {', '.join(RAW_COLUMNS)} FROM raw", "raw"),
        "missing_files": "SELECT count(*) AS rows, true AS failed FROM events",
        **dict.fromkeys(
            ("grid_documents", "lookup_lines"),
            _with(f"SELECT grid_id, {_rounded('centroid_lon', 'centroid_lat')} FROM cells", "cells"),
        ),
        "alert_files": _with(f"SELECT {_ALERT_OUT}, kind FROM alerts, (SELECT unnest(['csv', 'json']) AS kind)", "alerts"),
        "split_grid_documents": _with(f"SELECT grid_id, {_rounded('centroid_lon', 'centroid_lat')} FROM cells", "cells"),
        "zone_read_time": _with(
            f"SELECT grid_id, timestamp, {_rounded('total_activity')} FROM hourly, latest WHERE timestamp = as_of", "latest"
        ),
        "weekly_cardinalities": _with(
            """SELECT CAST(CAST(date_trunc('week', timestamp) AS DATE) AS VARCHAR) AS period, true AS grids, true AS country_codes, true AS timestamps
               FROM clean GROUP BY 1""",
            "clean",
        ),
        "required_columns": _with(
            f"""SELECT column_name, true AS refused, true AS named, (SELECT count(*) FROM canonical) AS rows
                FROM (SELECT unnest([{', '.join(f"'{c}'" for c in CANONICAL_NAMES.values())}]) AS column_name)""",
            "canonical",
        ),
        "score_records": _with(
            f"""SELECT grid_id, timestamp AS feature_timestamp,
                       CASE WHEN grid_id % 5 = 0 THEN ([{', '.join(f"'{f}'" for f in FEATURES)}])[grid_id % {len(FEATURES)} + 1] ELSE '' END AS missing_features,
                       CASE WHEN grid_id % 5 <> 0 THEN round(risk_score, 6) + 0.0 END AS risk_score,
                       CASE WHEN grid_id % 5 <> 0 THEN risk_level END AS risk_level,
                       CASE WHEN grid_id % 5 <> 0 THEN model_version END AS model_version FROM risk""",
            "risk",
        ),
        "one_cell_read": _with(f"SELECT grid_id, timestamp, {_rounded('total_activity')} FROM hourly WHERE grid_id = 1", "hourly"),
        "sorted_sink": _with("SELECT count(*) AS rows, true AS apart FROM hourly", "hourly"),
        "small_csv": _with(
            """SELECT grid_id, round(sum(total_activity), 6) + 0.0 AS total_activity,
               CAST((SELECT count(DISTINCT date) FROM hourly) AS INTEGER) AS days FROM hourly GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
            "hourly",
        ),
        "appended_rows": _with("SELECT hour, count(*) AS rows FROM hourly GROUP BY 1", "hourly"),
        "stored_model": _with(f"SELECT grid_id, timestamp, {_RISK_OUT} FROM risk", "risk"),
        "nightly_run": _with(f"SELECT {_HOURLY_OUT} FROM hourly", "hourly"),
        "storage_sizes": "SELECT unnest(['csv', 'parquet']) AS storage, count(*) > 0 AS has_files, count(*) > 0 AS has_bytes FROM events",
        "risk_model_fit": _with(
            f"""SELECT unnest({[*FEATURES, 'intercept']}) AS coefficient, true AS vanishes, count(*) AS train_rows
                FROM split WHERE split = 'train'""",
            "split",
        ),
        "risk_model_coefficients": f"SELECT '{','.join(sorted(FEATURES))}' AS features, count(*) > 0 AS sorted, count(*) > 0 AS absolute FROM events",
        "evaluation_record": _with(
            f"""SELECT 'Logistic Regression' AS algorithm, {FIXTURE_THRESHOLD} AS threshold, m.*, s.*, a.*,
                round(s.train_pos / s.train_rows, 6) + 0.0 AS train_positive_rate, round(s.test_pos / s.test_rows, 6) + 0.0 AS test_positive_rate
                FROM ({_METRICS}) m, ({_AGREEMENT}) a,
                    (SELECT count(*) FILTER (WHERE split = 'train') AS train_rows, count(*) FILTER (WHERE split = 'test') AS test_rows,
                        min(feature_timestamp) FILTER (WHERE split = 'train') AS train_earliest_timestamp,
                        max(feature_timestamp) FILTER (WHERE split = 'train') AS train_latest_timestamp,
                        min(feature_timestamp) FILTER (WHERE split = 'test') AS test_earliest_timestamp,
                        max(feature_timestamp) FILTER (WHERE split = 'test') AS test_latest_timestamp, true AS chronological_split_valid,
                        count(*) FILTER (WHERE split = 'train' AND high_activity_risk = 1) AS train_pos,
                        count(*) FILTER (WHERE split = 'test' AND high_activity_risk = 1) AS test_pos FROM split) s""",
            "split",
            "compared",
        ).replace("m.*, s.*, a.*", "m.*, s.* EXCLUDE (train_pos, test_pos), a.*"),
        "profile_nulls": _with(_per_column(_CANONICAL, "{0} IS NULL", "nulls", "canonical"), "canonical"),
        "profile_negatives": _with(_per_column(MEASURES, "{0} < 0", "negatives", "canonical"), "canonical"),
        "profile_duplicates": _with(
            """SELECT CAST(sum(c) AS BIGINT) AS rows, CAST(sum(c - 1) AS BIGINT) AS duplicate_rows
               FROM (SELECT count(*) AS c FROM canonical GROUP BY """ + ", ".join(_CANONICAL) + ")",
            "canonical",
        ),
        "profile_cadence": _with(
            """SELECT count(*) AS distinct_timestamps, count(*) FILTER (WHERE gap <> INTERVAL 1 HOUR) AS irregular_gaps,
                   bool_and(gap = INTERVAL 1 HOUR) AS hourly
               FROM (SELECT t - lag(t) OVER (ORDER BY t) AS gap FROM (SELECT DISTINCT timestamp AS t FROM clean))""",
            "clean",
        ),
        "profile_multi_country": _with(
            "SELECT grid_id, timestamp, count(*) AS rows FROM clean GROUP BY 1, 2 HAVING count(*) > 1", "clean"
        ),
        "multi_country_example": _with(
            f"""SELECT grid_id, timestamp, country_code, {_rounded(*MEASURES)} FROM clean WHERE (grid_id, timestamp) IN
               (SELECT (grid_id, timestamp) FROM clean GROUP BY grid_id, timestamp HAVING count(*) > 1
                ORDER BY grid_id, timestamp LIMIT 1)""",
            "clean",
        ),
        "profile_cardinalities": _with(
            """SELECT count(*) AS rows, count(DISTINCT grid_id) AS grids, count(DISTINCT country_code) AS country_codes,
               count(DISTINCT timestamp) AS timestamps FROM canonical""",
            "canonical",
        ),
        "profile_time_range": _with(
            "SELECT min(timestamp) AS first_timestamp, max(timestamp) AS last_timestamp FROM clean", "clean"
        ),
        **dict.fromkeys(("activity_percentiles", "percentiles_by_search"), _with(_percentiles("hourly"), "hourly")),
        "percentiles_of_odd_values": _with(
            """SELECT CAST(probability AS DOUBLE) AS probability, way, CASE WHEN isnan(low) OR isnan(high) THEN 'NaN'
                   WHEN low = high THEN CASE low WHEN 'inf'::DOUBLE THEN 'inf' WHEN '-inf'::DOUBLE THEN '-inf' ELSE printf('%.4f', low) END
                   ELSE printf('%.4f', low + (high - low) * (spot - floor(spot))) END AS quantile
               FROM (SELECT probability, spot, l[CAST(floor(spot) AS INTEGER) + 1] AS low, l[CAST(ceil(spot) AS INTEGER) + 1] AS high
                     FROM (SELECT list_sort(list(value)) AS l FROM (SELECT CASE grid_id % 31 WHEN 3 THEN 'inf'::DOUBLE WHEN 5 THEN
                               '-inf'::DOUBLE WHEN 7 THEN 0.0 WHEN 11 THEN 'nan'::DOUBLE ELSE total_activity END AS value FROM hourly)),
                          (SELECT unnest([0.0, 0.01, 0.5, 0.9, 1.0]) AS probability), LATERAL (SELECT probability * (len(l) - 1) AS spot)),
                    (SELECT unnest(['search', 'sort']) AS way)""",
            "hourly",
        ),
        "country_grain_percentiles": _with(_percentiles("clean"), "clean"),
        "busiest_hour": _with(
            "SELECT hour, round(sum(total_activity), 6) + 0.0 AS total_activity FROM hourly GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1",
            "hourly",
        ),
        "busiest_grid": _with(
            "SELECT grid_id, round(sum(total_activity), 6) + 0.0 AS total_activity FROM hourly GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1",
            "hourly",
        ),
        "acceptance_checks": _with(
            _checks(
                "raw_rows",
                timestamps_per_file=(
                    "count(DISTINCT file_date) * 24",
                    "count(DISTINCT datetime)",
                    "count(DISTINCT file_date) * 24 = count(DISTINCT datetime)",
                ),
                cell_range=("0", "0 * count(*)", "true"),
                lineage=("0", "count(*) FILTER (WHERE file_date IS NULL)", "count(*) FILTER (WHERE file_date IS NULL) = 0"),
            ),
            "raw_rows",
        ),
        "hourly_grid_summary": _with(f"SELECT {_HOURLY_OUT} FROM hourly", "hourly"),
        "daily_traffic_summary": _with(
            """SELECT grid_id, CAST(date AS VARCHAR) AS date, round(sum(total_activity), 6) + 0.0 AS daily_total_activity,
               round(avg(total_activity), 6) + 0.0 AS daily_avg_hourly_activity FROM hourly GROUP BY grid_id, hourly.date""",
            "hourly",
        ),
        "daily_kpis": _with(
            """SELECT CAST(date AS VARCHAR) AS date, round(sum(total_activity), 6) + 0.0 AS total_activity,
               round(sum(total_sms), 6) + 0.0 AS total_sms, round(sum(total_calls), 6) + 0.0 AS total_calls,
               round(sum(internet_activity), 6) + 0.0 AS total_internet, count(DISTINCT grid_id) AS active_grids
               FROM hourly GROUP BY hourly.date""",
            "hourly",
        ),
        "grid_kpis": _with(
            """SELECT grid_id, round(sum(total_activity), 6) + 0.0 AS total_activity,
               round(max(total_activity), 6) + 0.0 AS peak_hour_activity, count(DISTINCT hour) AS active_hours
               FROM hourly GROUP BY grid_id""",
            "hourly",
        ),
        "top_hotspots": _with(
            """SELECT grid_id, round(sum(total_activity), 6) + 0.0 AS total_activity FROM hourly GROUP BY 1
               ORDER BY 2 DESC, 1 LIMIT 10""",
            "hourly",
        ),
        "peak_hour": _with(
            "SELECT hour, round(sum(total_activity), 6) + 0.0 AS total_activity FROM hourly GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1",
            "hourly",
        ),
        "top_hotspots_geo": _with(
            """SELECT t.grid_id, round(centroid_lon, 6) + 0.0 AS centroid_lon, round(centroid_lat, 6) + 0.0 AS centroid_lat,
               total_activity FROM (SELECT grid_id, round(sum(total_activity), 6) + 0.0 AS total_activity FROM hourly GROUP BY 1
               ORDER BY 2 DESC, 1 LIMIT 10) t JOIN cells c ON c.grid_id = t.grid_id""",
            "cells",
        ),
        "alert_counts": _with("SELECT alert_type, count(*) AS alerts FROM alerts GROUP BY 1", "alerts"),
        "top_alert_grids": _with(
            "SELECT grid_id, count(*) AS alerts FROM alerts GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", "alerts"
        ),
        "alert_rate": _with(
            """SELECT *, round(alerts * 100.0 / grid_hours, 6) + 0.0 AS alert_percent, alerts * 100.0 / grid_hours > 5
               AS needs_revision FROM (SELECT (SELECT count(*) FROM alerts) AS alerts, (SELECT count(*) FROM hourly) AS grid_hours)""",
            "alerts",
        ),
        "alert_types_per_key": _with("SELECT * FROM rules", "rules"),
        "bucket_coverage": _with(
            """SELECT min(n) AS min_observations, max(n) AS max_observations, round(avg(n), 6) + 0.0 AS mean_observations,
               min(n) > 1 AS sufficient FROM (SELECT count(DISTINCT timestamp) AS n FROM hourly GROUP BY grid_id, hour)""",
            "hourly",
        ),
        "anomaly_distribution": _with(_DESCRIBE, "scores"),
        "anomaly_directions": _with("SELECT direction, count(*) AS rows FROM scores GROUP BY 1", "scores"),
        "class_balance": _with(
            """SELECT split, count(*) AS rows, count(*) FILTER (WHERE high_activity_risk = 1) AS positives,
               count(*) FILTER (WHERE high_activity_risk = 0) AS negatives, round(avg(high_activity_risk), 6) + 0.0
               AS positive_rate FROM split GROUP BY split""",
            "split",
        ),
        "activity_floor": _with(
            """SELECT CAST(date AS VARCHAR) AS date, round(quantile_cont(total_activity, 0.25), 6) + 0.0 AS activity_floor
               FROM hourly GROUP BY hourly.date""",
            "hourly",
        ),
        "warehouse_totals": _with(
            f"""SELECT count(*) AS rows, {", ".join(f"round(sum({c}), 6) + 0.0 AS {c}"
                for c in ("total_sms", "total_calls", "internet_activity", "total_activity"))} FROM hourly""",
            "hourly",
        ),
        **dict.fromkeys(
            ("feature_windows", "feature_windows_by_period"),
            _with(
                "SELECT grid_id, timestamp, recent_count, baseline_count, active_hours, history_start, "
                + _rounded(
                    "total_activity",
                    "internet_activity",
                    "recent_avg",
                    "baseline_avg",
                    "recent_peak",
                    "recent_stddev",
                    "recent_internet",
                    "recent_total",
                )
                + " FROM history",
                "history",
            ),
        ),
        "next_hour_target": _with(
            f"SELECT grid_id, timestamp, target_timestamp, {_rounded('total_activity', 'target_activity')} FROM nexts", "nexts"
        ),
        "prev_hour_activity": _with(
            """SELECT grid_id, timestamp, round(lag(total_activity) OVER (PARTITION BY date, grid_id ORDER BY hour, timestamp), 6)
               + 0.0 AS prev_hour_activity FROM hourly""",
            "hourly",
        ),
        "loo_median_day": _with(f"SELECT grid_id, timestamp, {_rounded('baseline_activity')} FROM day_base", "day_base"),
        "loo_median_hour": _with(f"SELECT grid_id, timestamp, {_rounded('baseline_activity')} FROM hour_base", "hour_base"),
        "loo_median_sliced": _with(
            f"""SELECT grid_id, timestamp, {_rounded('baseline_activity')}
                FROM ({_median_of_others('hourly', 'hour')})""",
            "hourly",
        ),
        "last_24_hours": _with(
            f"""SELECT grid_id, timestamp, {_rounded('total_activity')} FROM hourly
                QUALIFY row_number() OVER (PARTITION BY grid_id ORDER BY timestamp DESC) <= 24""",
            "hourly",
        ),
        "chrono_split": _with(
            """SELECT count(*) FILTER (WHERE train) AS train_rows, count(*) FILTER (WHERE NOT train) AS test_rows,
               min(t) FILTER (WHERE train) AS train_earliest_timestamp, max(t) FILTER (WHERE train) AS train_latest_timestamp,
               min(t) FILTER (WHERE NOT train) AS test_earliest_timestamp, max(t) FILTER (WHERE NOT train) AS test_latest_timestamp,
               true AS chronological_split_valid
               FROM (SELECT feature_timestamp AS t, dense_rank() OVER (ORDER BY feature_timestamp) - 1 < floor(0.8 *
                     (SELECT count(DISTINCT feature_timestamp) FROM features)) AS train FROM features)""",
            "features",
        ),
        "network_alerts": _with(
            f"SELECT {_ALERT_OUT}, CAST(source_file AS VARCHAR) AS source_file FROM alerts", "alerts"
        ),
        "alert_severity": _with("SELECT severity, count(*) AS rows FROM severities GROUP BY 1", "severities"),
        "anomaly_scores": _with(f"SELECT {_SCORE_OUT} FROM scores", "scores"),
        "top_high_anomalies": _with(
            f"SELECT {_SCORE_OUT} FROM (SELECT * FROM scores WHERE direction = 'HIGH' ORDER BY anomaly_score DESC, grid_id, timestamp LIMIT 10)",
            "scores",
        ),
        "top_low_anomalies": _with(
            f"SELECT {_SCORE_OUT} FROM (SELECT * FROM scores WHERE direction = 'LOW' ORDER BY anomaly_score, grid_id, timestamp LIMIT 10)",
            "scores",
        ),
        "grid_lookup": _with(f"SELECT grid_id, {_rounded('centroid_lon', 'centroid_lat')} FROM cells", "cells"),
        **{
            name: _with(
                f"SELECT h.*, {_rounded('centroid_lon', 'centroid_lat')} FROM (SELECT {_HOURLY_OUT} FROM hourly) h "
                "LEFT JOIN cells c ON c.grid_id = h.grid_id",
                "cells",
            )
            for name in ("geo_enrichment", "geo_enrichment_merge")
        },
        "unmatched_grids": _with("SELECT grid_id FROM wide_coverage WHERE NOT known", "wide_coverage"),
        "enrichment_coverage": _with(
            """SELECT *, round((grids - unmatched_grids) * 100.0 / grids, 6) + 0.0 AS coverage_percent, unmatched_grids = 0 AS passed
               FROM (SELECT CAST(sum(n) AS BIGINT) AS rows_before, CAST(sum(n) AS BIGINT) AS rows_after, count(*) AS grids,
                     count(*) FILTER (WHERE NOT known) AS unmatched_grids, 0 AS repeated_lookup_keys FROM wide_coverage)""",
            "wide_coverage",
        ),
        "full_enrichment_coverage": _with(
            """SELECT count(*) AS rows_before, count(*) AS rows_after, count(DISTINCT grid_id) AS grids, 0 AS unmatched_grids,
               0 AS repeated_lookup_keys, 100.0::DOUBLE AS coverage_percent, true AS passed FROM hourly""",
            "hourly",
        ),
        "centroid_box": _with(
            """SELECT count(*) AS cells, count(*) FILTER (WHERE centroid_lon NOT BETWEEN 9.0 AND 9.5
               OR centroid_lat NOT BETWEEN 45.0 AND 45.5) AS outside FROM cells""",
            "cells",
        ),
        "dim_time": _with(
            """SELECT DISTINCT CAST(epoch(timestamp) AS BIGINT) AS time_key, timestamp, CAST(date AS VARCHAR) AS date, hour,
               day_of_week FROM hourly""",
            "hourly",
        ),
        "dim_grid": _with(
            f"""SELECT grid_id, {_rounded('centroid_lat', 'centroid_lon')}, '{{"source":"grid.geojson","cellId":' || grid_id ||
                ',"geometry_type":"' || CASE WHEN grid_id % 7 = 0 THEN 'MultiPolygon' ELSE 'Polygon' END || '"}}'
                AS geometry_reference FROM cells""",
            "cells",
        ),
        "fact_network_activity": _with(
            f"""SELECT grid_id, CAST(epoch(timestamp) AS BIGINT) AS time_key,
                {_rounded(*MEASURES, 'total_sms', 'total_calls', 'total_activity', 'internet_share')} FROM hourly""",
            "hourly",
        ),
        "warehouse_checks": _with(
            _checks(
                "(SELECT count(*) AS n, count(DISTINCT grid_id) AS g FROM hourly)",
                fact_rows=("n", "n", "true"),
                grid_rows=("g", "g", "true"),
                repeated_grid_keys=("0", "0", "true"),
                repeated_fact_keys=("0", "0", "true"),
                geometry_columns=("0", "0", "true"),
            ),
            "hourly",
        ),
        "latest_as_of": _with("SELECT as_of FROM latest", "latest"),
        "network_summary": _with(_SUMMARY.format("hourly"), "hourly"),
        "latest_network_summary": _with(
            _SUMMARY.format("(SELECT h.* FROM hourly h, latest WHERE timestamp = as_of)"), "latest"
        ),
        "grid_activity": _with(
            f"""SELECT grid_id, timestamp, {_rounded(*MEASURES, 'total_activity')} FROM hourly
                QUALIFY row_number() OVER (PARTITION BY grid_id ORDER BY timestamp DESC) <= 24""",
            "hourly",
        ),
        "grid_activity_high_cells": _with(
            f"""SELECT grid_id + 10000 AS grid_id, timestamp, {_rounded(*MEASURES, 'total_activity')} FROM hourly
                QUALIFY row_number() OVER (PARTITION BY grid_id ORDER BY timestamp DESC) <= 24""",
            "hourly",
        ),
        "grid_activity_at_noon": _with(
            f"SELECT grid_id, timestamp, {_rounded(*MEASURES, 'total_activity')} FROM hourly WHERE hour = 12", "hourly"
        ),
        "grid_activity_on_day": _with(
            f"""SELECT grid_id, timestamp, {_rounded(*MEASURES, 'total_activity')} FROM hourly
                WHERE date = (SELECT max(date) FROM hourly)""",
            "hourly",
        ),
        "grid_activity_at_time": _with(
            f"SELECT grid_id, timestamp, {_rounded(*MEASURES, 'total_activity')} FROM hourly, latest WHERE timestamp = as_of", "latest"
        ),
        "sunday_summary": _with(_SUMMARY.format("(SELECT * FROM hourly WHERE day_of_week = 'Sunday')"), "hourly"),
        "network_hotspots": _with(
            f"SELECT grid_id, timestamp, {_rounded('total_activity')}, status, reason, {_RISK_OUT} FROM hot", "hot"
        ),
        "alert_feed": _with(f"SELECT {_ALERT_OUT}, severity, severity_rank, {_RISK_OUT} FROM feed", "feed"),
        "high_alert_feed": _with(
            f"""SELECT {_ALERT_OUT}, severity, severity_rank, {_RISK_OUT}
                FROM (SELECT * FROM severities WHERE severity = 'HIGH' ORDER BY timestamp DESC, grid_id DESC LIMIT 50) a
                LEFT JOIN risk r USING (grid_id, timestamp)""",
            "severities",
            "risk",
        ),
        "grid_location": _with(f"SELECT grid_id, {_rounded('centroid_lat', 'centroid_lon')} FROM cells", "cells"),
        "predict_risk": _with(
            f"""SELECT h.grid_id, h.timestamp,
                round(h.total_activity + CASE WHEN h.hour = 3 THEN 0.5 ELSE 0 END, 6) + 0.0 AS total_activity,
                CASE WHEN r.grid_id IS NULL THEN 'NO_FEATURES' WHEN h.hour = 3 THEN 'ACTIVITY_MISMATCH' ELSE 'OK' END AS status,
                CASE WHEN h.hour <> 3 THEN round(r.risk_score, 6) + 0.0 END AS risk_score,
                CASE WHEN h.hour <> 3 THEN r.risk_level END AS risk_level,
                CASE WHEN h.hour <> 3 THEN r.model_version END AS model_version,
                CASE WHEN h.hour <> 3 AND r.grid_id IS NOT NULL THEN 'ML3 risk prediction generated using features at '
                    || CAST(h.timestamp AS VARCHAR) || '. ML4 anomaly status: ' || s.direction || '. Anomaly score: '
                    || {_text("s.anomaly_score", 4)} || '. ' || s.reason || '.' END AS explanation_note
                FROM hourly h LEFT JOIN risk r ON r.grid_id = h.grid_id AND r.timestamp = h.timestamp
                JOIN scores s ON s.grid_id = h.grid_id AND s.timestamp = h.timestamp""",
            "hourly",
            "risk",
            "scores",
        ),
        "latest_run": _with(
            """SELECT run_id, timestamp AS run_timestamp, CASE WHEN ok THEN 'SUCCESS' ELSE 'FAILED' END AS overall_status, rows_in,
               CASE WHEN ok THEN '{"load":"success","check":"success"}' ELSE '{"load":"failed","check":"success"}' END AS task_status,
               CASE WHEN ok THEN '' ELSE 'load' END AS failed_tasks, CASE WHEN ok THEN ''
                   ELSE 'Latest pipeline run status is FAILED; Failed or incomplete tasks: load' END AS reasons,
               rows_rejected, 0 AS nulls_handled, CASE WHEN ok THEN rows_in - rows_rejected END AS rows_published, as_of, ok AS healthy,
               round((epoch(TIMESTAMP '2024-02-01 12:00:00') - epoch(as_of)) / 3600, 6) + 0.0 AS freshness_hours,
               CASE WHEN NOT ok THEN 'STALE_OR_UNHEALTHY' WHEN as_of IS NULL THEN 'UNKNOWN'
                    WHEN TIMESTAMP '2024-02-01 12:00:00' - as_of <= INTERVAL 24 HOUR THEN 'FRESH' ELSE 'STALE' END AS freshness_indicator
               FROM (SELECT *, (SELECT arg_max(latest, timestamp) FROM runs WHERE ok) AS as_of FROM runs ORDER BY timestamp DESC LIMIT 1)""",
            "runs",
        ),
        "map_status": _with(
            """SELECT grid_id, coalesce(a.status, h.status) AS status
               FROM (SELECT grid_id, arg_min(CASE severity WHEN 'HIGH' THEN 'HIGH' WHEN 'MEDIUM' THEN 'ATTENTION' ELSE 'NORMAL' END,
                            (timestamp, severity_rank, alert_type)) AS status FROM feed GROUP BY 1) a
               FULL JOIN hot h USING (grid_id)""",
            "feed",
            "hot",
        ),
        "visible_features": _with("SELECT grid_id FROM feed UNION SELECT grid_id FROM hot", "feed", "hot"),
        "dashboard_counters": _with(
            """SELECT (SELECT count(*) FROM hot) AS hotspots, count(*) AS alerts, count(*) FILTER (WHERE severity = 'HIGH') AS high,
               count(*) FILTER (WHERE severity = 'MEDIUM') AS attention FROM feed""",
            "feed",
            "hot",
        ),
        "network_features": _with(f"SELECT {_FEATURE_OUT} FROM features", "features"),
        "network_features_strict": _with(
            f"SELECT {_FEATURE_OUT} FROM features WHERE history_start = feature_timestamp - INTERVAL 5 HOUR", "features"
        ),
        "training_set": _with(
            f"SELECT {_FEATURE_OUT}, target_timestamp, {_rounded('target_activity')}, high_activity_risk FROM labelled", "labelled"
        ),
        "standardised_features": _with(
            f"SELECT f.grid_id, f.feature_timestamp, {_STANDARDISED} FROM split f, stats s WHERE split = 'train'", "split", "stats"
        ),
        "risk_scores_fixed_coefficients": _with(f"SELECT grid_id, timestamp, {_RISK_OUT} FROM risk", "risk"),
        "risk_levels": _with("SELECT risk_level, count(*) AS rows FROM risk GROUP BY 1", "risk"),
        "confusion_metrics": _with(
            _METRICS,
            "predicted",
        ),
        "rule_agreement": _with(
            """SELECT grid_id, feature_timestamp, ml_prediction, np3_positive, np3_alert_types, agreement, disagreement_type
               FROM compared""",
            "compared",
        ),
        "rule_agreement_counts": _with(
            _AGREEMENT,
            "compared",
        ),
        "three_way_result": _with("SELECT * FROM three_way", "three_way"),
        "three_way_counts": _with("SELECT three_way_result, count(*) AS rows FROM three_way GROUP BY 1", "three_way"),
        "attention_top20": _with(
            f"""SELECT row_number() OVER (ORDER BY attention_score DESC, risk_score DESC, anomaly_score DESC, grid_id, timestamp) AS rank,
                grid_id, timestamp, {_RISK_OUT}, direction, {_rounded('anomaly_score', 'attention_score')},
                'Investigate grid ' || grid_id || ': predicted activity risk is ' || {_text('risk_score', 4)} || ' (' || risk_level
                    || '). ML4 status is ' || direction || ' with anomaly score ' || {_text('anomaly_score', 4)} || '. ' || reason AS attention_reason
                FROM (SELECT r.*, coalesce(s.reason, 'No ML4 anomaly record is available for this grid and hour.') AS reason, coalesce(s.direction, 'NO_ANOMALY_RECORD') AS direction, coalesce(s.anomaly_score, 0.0) AS anomaly_score,
                             greatest(r.risk_score, 0.0) + abs(coalesce(s.anomaly_score, 0.0)) AS attention_score
                      FROM risk r LEFT JOIN scores s ON r.grid_id = s.grid_id AND r.timestamp = s.timestamp
                      ORDER BY attention_score DESC, risk_score DESC, anomaly_score DESC, r.grid_id, r.timestamp LIMIT 20)""",
            "risk",
            "scores",
        ),
        "leakage_perturbation": _with(
            """SELECT count(*) AS feature_rows, 0 AS changed_rows FROM features
               WHERE feature_timestamp <= (SELECT date_trunc('day', max(timestamp)) - INTERVAL 10 DAY FROM hourly)""",
            "features",
        ),
        "analytics_gate": _with(
            _checks(
                _KEY_FACTS,
                not_empty=("1", "n", "n >= 1"),
                required_columns=("0", "0", "true"),
                null_keys=("0", "nulls", "nulls = 0"),
                repeated_keys=("0", "dups", "dups = 0"),
            ),
            "hourly",
        ),
        "grain_checks": _with(
            _checks(
                f"{_KEY_FACTS}, (SELECT count(*) AS c FROM clean), (SELECT count(DISTINCT grid_id) AS g FROM hourly)",
                repeated_keys=("0", "dups", "dups = 0"),
                fewer_rows_than_clean=("c", "n", "n < c"),
                at_most_all_cell_hours=("days * 24 * g", "n", "n <= days * 24 * g"),
                no_country_code=("0", "0", "true"),
            ),
            "hourly",
        ),
        "publish_record": _with(
            f"""SELECT 'run' AS run_id, 'SUCCESS' AS overall_status, count(*) AS rows_in, count(reject_cause) AS rows_rejected,
                CAST(sum(CASE WHEN reject_cause IS NULL THEN {" + ".join(f"({m} IS NULL)::INT" for m in MEASURES)} END) AS BIGINT)
                    AS nulls_handled,
                (SELECT count(*) FROM hourly) AS rows_published,
                (SELECT strftime(max(timestamp), '%Y-%m-%d %H:%M:%S') FROM hourly) AS as_of_reason,
                'Quality checks passed' AS reason FROM flagged""",
            "hourly",
            "flagged",
        ),
        "compare_totals": _with(
            """SELECT count(*) AS left_rows, count(*) AS right_rows, round(sum(total_activity), 6) + 0.0 AS left_total,
               round(sum(total_activity), 6) + 0.0 AS right_total, true AS passed FROM hourly""",
            "hourly",
        ),
        "round_trip": _with(
            _checks(
                _KEY_FACTS,
                rows=("n", "n", "true"),
                columns=("0", "0", "true"),
                repeated_keys=("0", "dups", "dups = 0"),
                no_geometry=("0", "0", "true"),
            ),
            "hourly",
        ),
        "rerun_idempotent": _with(
            """SELECT count(*) AS left_rows, count(*) AS right_rows, round(sum(total_activity), 6) + 0.0 AS left_total,
               round(sum(total_activity), 6) + 0.0 AS right_total, true AS passed FROM clean""",
            "clean",
        ),
        "stream_hourly_grid": f"""SELECT grid_id, timestamp, CAST(hour(timestamp) AS INTEGER) AS hour, {_rounded(*MEASURES)},
            round(sms_in + sms_out, 6) + 0.0 AS total_sms, round(call_in + call_out, 6) + 0.0 AS total_calls,
            round((sms_in + sms_out) + (call_in + call_out) + internet_activity, 6) + 0.0 AS total_activity
            FROM ({_EVENT_HOURS})""",
        "stream_scoring": _with(
            f"""SELECT CASE WHEN b IS NULL THEN 'NO_BASELINE' WHEN b > 0 AND (t - b) / b >= 0.5 THEN 'HIGH'
                            WHEN b > 0 AND (t - b) / b <= -0.5 THEN 'LOW' ELSE 'NORMAL' END AS direction,
                       count(*) AS rows, count(*) FILTER (WHERE t > b * 2.0 OR t < b * 0.25) AS alerts
                FROM (SELECT grid_id, hour(timestamp) AS hour, (sms_in + sms_out) + (call_in + call_out) + internet_activity AS t
                      FROM ({_EVENT_HOURS})) e
                LEFT JOIN (SELECT grid_id, hour, quantile_cont(total_activity, 0.5) AS b FROM hourly GROUP BY 1, 2) m
                       USING (grid_id, hour)
                GROUP BY 1""",
            "hourly",
        ),
        "stream_alerts": _with(
            f"""SELECT * FROM (WITH hours AS (SELECT grid_id, timestamp, CAST(timestamp AS DATE) AS date, hour(timestamp) AS hour,
                                      (sms_in + sms_out) + (call_in + call_out) + internet_activity AS cur FROM ({_EVENT_HOURS})),
                judged AS (SELECT h.*, b, f, lag(cur) OVER (PARTITION BY h.date, h.grid_id ORDER BY h.timestamp) AS prev
                           FROM hours h
                           LEFT JOIN (SELECT grid_id, hour, quantile_cont(total_activity, 0.5) AS b FROM hourly GROUP BY 1, 2) USING (grid_id, hour)
                           LEFT JOIN (SELECT CAST(date + 1 AS DATE) AS date, quantile_cont(total_activity, 0.25) AS f FROM hourly GROUP BY hourly.date) t
                                  ON t.date = h.date)
                SELECT grid_id, timestamp, alert_type, round(cur, 6) + 0.0 AS current_activity, round(compared, 6) + 0.0 AS compared_activity,
                       CASE alert_type WHEN 'HIGH_ACTIVITY' THEN 'HIGH' WHEN 'ACTIVITY_SPIKE' THEN 'MEDIUM' ELSE 'LOW' END AS severity
                FROM (SELECT *, 'HIGH_ACTIVITY' AS alert_type, b AS compared FROM judged WHERE b >= f AND cur > b * 2.0
                      UNION ALL SELECT *, 'ACTIVITY_DROP', b FROM judged WHERE b >= f AND cur < b * 0.25
                      UNION ALL SELECT *, 'ACTIVITY_SPIKE', prev FROM judged WHERE prev >= f AND cur > prev * 2.0))""",
            "hourly",
        ),
        "stream_file_gate": _with(
            f"""SELECT file AS filename, CASE WHEN ok THEN 'ACCEPTED' ELSE 'REJECTED' END AS status, reason FROM verdicts
                UNION ALL SELECT file, 'SKIPPED', CASE WHEN ok THEN 'File already exists in raw' ELSE 'File already exists in rejected' END
                FROM verdicts WHERE CAST(substr(file, {len(FILE_PREFIX) + 9}, 2) AS INTEGER) <= 15""",
            "verdicts",
        ),
        "stream_ingest": _with(
            "SELECT CAST(date AS VARCHAR) AS date, count(*) AS rows FROM clean GROUP BY clean.date", "clean"
        ),
        "wide_hourly_summary": _with(f"SELECT {_HOURLY_OUT} FROM wide_hourly", "wide_hourly"),
        "wide_features": _with(f"SELECT {_FEATURE_OUT} FROM wide_features", "wide_features"),
        "wide_anomaly_scores": _with(f"SELECT {_SCORE_OUT} FROM wide_scores", "wide_scores"),
        "wide_alerts": _with(
            f"SELECT {_ALERT_OUT}, CAST(source_file AS VARCHAR) AS source_file FROM wide_alerts", "wide_alerts"
        ),
        "wide_network_summary": _with(_SUMMARY.format("wide_hourly"), "wide_hourly"),
    }


# queries that find the rows of another query by another way
_SAME_ROWS = {
    "incremental_hourly": "hourly_grid_summary",
    "incremental_fact": "fact_network_activity",
    "incremental_alerts": "network_alerts",
    "incremental_features": "network_features",
    "incremental_training_set": "training_set",
    "incremental_scores": "anomaly_scores",
    "scores_of_two_loads": "anomaly_scores",
    "loo_median_of_summaries": "loo_median_sliced",
    "stream_late_hours": "stream_hourly_grid",
    "zone_read_cell": "one_cell_read",
    "zone_table": "hourly_grid_summary",
    "bucketed_features": "network_features",
    "bucketed_training_set": "training_set",
    "bucketed_scores": "anomaly_scores",
    "bucketed_last_hours": "last_24_hours",
    "bucketed_rule_agreement": "rule_agreement",
    "bucketed_three_way": "three_way_result",
    "bucketed_attention": "attention_top20",
}


def oracle_sql() -> dict[str, str]:
    found = _own_sql()
    return found | {name: found[other] for name, other in _SAME_ROWS.items()}
