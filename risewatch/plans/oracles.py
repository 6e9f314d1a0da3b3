"""The same queries as SQL over the event table, for checking.

Folds are written as recursive queries that visit each series row by row, which is nothing like how the
Spark side works.
"""

from __future__ import annotations

from risewatch.functions.channels import channel_rows

# Stated here again, so that a wrong value on the Spark side does not agree with itself.
EVENT_CHANNELS = {
    "view": "T_motTemp_Lft", "click": "BatTemp", "signup": "BatCharState", "purchase": "TSteerAngle", "error": "Key1State",
}
EVENT_SIGNAL_TYPES = {"view": "SORTER", "click": "PICKER", "purchase": "DMS"}


def _case(column: str, table: dict[str, str], other: str = "NULL") -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items())
    return f"CASE {column} {whens} ELSE {other} END"


CHANNEL = _case("event_type", EVENT_CHANNELS)
SIGNAL_TYPE = _case("event_type", EVENT_SIGNAL_TYPES, "upper(event_type)")
ROUTE = _case("event_type", {"view": "sorter", "click": "picker", "purchase": "dms"})

SIGNALS = f"""
SELECT user_id AS id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS "timestamp", {SIGNAL_TYPE} AS "signalType",
       CAST(floor(value) AS INTEGER) AS value, 'p' || CAST(user_id AS VARCHAR) AS "producerId"
FROM events
"""

HOURS = """
SELECT event_type AS truck, date_trunc('hour', ts) AS window_start,
       date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, ts, value, event_id
FROM events
"""

SLIDING = """
SELECT event_type AS truck, time_bucket(INTERVAL 15 MINUTE, ts) - k * INTERVAL 15 MINUTE AS window_start,
       time_bucket(INTERVAL 15 MINUTE, ts) - k * INTERVAL 15 MINUTE + INTERVAL 1 HOUR AS window_end, ts, value, event_id
FROM events, (VALUES (0), (1), (2), (3)) AS s(k)
"""


def _window_chain(source: str) -> str:
    """CTEs: ``found`` has one row per (truck, window) with alerts, ``src`` the windowed readings."""
    return f"""
WITH RECURSIVE src AS ({source}),
r AS (SELECT *, row_number() OVER (PARTITION BY truck, window_start ORDER BY ts, value) AS rn FROM src),
chain AS (
  SELECT truck, window_start, window_end, rn, value AS low, 0 AS hit FROM r WHERE rn = 1
  UNION ALL
  SELECT r.truck, r.window_start, r.window_end, r.rn,
         CASE WHEN r.value - c.low > 10 OR r.value < c.low THEN r.value ELSE c.low END,
         CASE WHEN r.value - c.low > 10 THEN 1 ELSE 0 END
  FROM chain c JOIN r ON r.truck = c.truck AND r.window_start = c.window_start AND r.rn = c.rn + 1
),
found AS (
  SELECT truck, window_start, window_end, CAST(sum(hit) AS INTEGER) AS alerts
  FROM chain GROUP BY ALL HAVING sum(hit) > 0
)
"""


def _windows(source: str) -> str:
    return _window_chain(source) + """
SELECT f.truck, f.window_start, f.window_end, f.alerts, count(*) AS n_values,
       min(s.ts) AS first_ts, max(s.ts) AS last_ts
FROM found f JOIN src s ON s.truck = f.truck AND s.window_start = f.window_start
GROUP BY f.truck, f.window_start, f.window_end, f.alerts
"""


HOUR_CHAIN = """
WITH RECURSIVE r AS (
  SELECT event_type AS truck, ts, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, value) AS rn
  FROM events
),
chain AS (
  SELECT truck, rn, ts AS low_ts, value AS low_value,
         CAST(NULL AS TIMESTAMP) AS min_ts, CAST(NULL AS DOUBLE) AS min_value, ts AS max_ts, value AS max_value
  FROM r WHERE rn = 1
  UNION ALL
  SELECT r.truck, r.rn,
         CASE WHEN date_sub('hour', c.low_ts, r.ts) >= 1
                OR (r.ts > c.low_ts AND (r.value - c.low_value > 10 OR r.value < c.low_value))
              THEN r.ts ELSE c.low_ts END,
         CASE WHEN date_sub('hour', c.low_ts, r.ts) >= 1
                OR (r.ts > c.low_ts AND (r.value - c.low_value > 10 OR r.value < c.low_value))
              THEN r.value ELSE c.low_value END,
         CASE WHEN date_sub('hour', c.low_ts, r.ts) < 1 AND r.ts > c.low_ts AND r.value - c.low_value > 10
              THEN c.low_ts END,
         CASE WHEN date_sub('hour', c.low_ts, r.ts) < 1 AND r.ts > c.low_ts AND r.value - c.low_value > 10
              THEN c.low_value END,
         r.ts, r.value
  FROM chain c JOIN r ON r.truck = c.truck AND r.rn = c.rn + 1
),
alert AS (SELECT truck, min_ts, min_value, max_ts, max_value FROM chain WHERE min_ts IS NOT NULL),
history AS (
  SELECT event_type AS truck, date_trunc('millisecond', ts) AS time, arg_max(value, event_id) AS value
  FROM events GROUP BY 1, 2
)
"""

STATS = f"""
SELECT id, time_bucket(INTERVAL 5 MINUTE, CAST("timestamp" AS TIMESTAMP)) AS aggregate,
       count(*) AS count, round(avg(value), 6) AS avg, min(value) AS min, max(value) AS max,
       CAST(sum(value) AS BIGINT) AS sum
FROM ({SIGNALS}) GROUP BY 1, 2
"""

RECORDS = f"""
SELECT user_id AS id, date_trunc('second', ts) AS "timestamp", {SIGNAL_TYPE} AS "signalType",
       CAST(floor(value) AS INTEGER) AS value, 'p' || CAST(user_id AS VARCHAR) AS "producerId"
FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, date_trunc('second', ts) ORDER BY event_id DESC) = 1
"""

READING_POINTS = f"""
SELECT {CHANNEL} AS measurement, event_type AS truck, 'job' AS jenkins_job, 'cluster' AS cluster_id,
       date_trunc('millisecond', ts) AS time, round(arg_max(value, event_id), 2) AS value
FROM events GROUP BY 1, 2, 3, 4, 5
"""

WINDOW_ALERT_POINTS = _window_chain(HOURS) + """
SELECT 'icd_alert_lift_motor_temp' AS measurement, f.truck,
       date_trunc('millisecond', (SELECT max(s.ts) FROM src s
                                  WHERE s.truck = f.truck AND s.window_start = f.window_start)) AS time,
       CAST(f.alerts AS DOUBLE) AS value
FROM found f
"""

STATEFUL_ALERT_POINTS = HOUR_CHAIN + """
SELECT 'icd_stateful_alert' AS measurement, truck, 'max_alert' AS alert_mode, CAST(NULL AS VARCHAR) AS time_mode,
       CAST(NULL AS VARCHAR) AS temp, date_trunc('millisecond', max_ts) AS time, round(max_value, 2) AS value FROM alert
UNION ALL
SELECT 'icd_stateful_alert', truck, 'min_alert', NULL, NULL, date_trunc('millisecond', min_ts), round(min_value, 2)
FROM alert
UNION ALL
SELECT 'icd_stateful_alert', truck, 'diff_temp', NULL, NULL, date_trunc('millisecond', max_ts),
       round(max_value - min_value, 2) FROM alert
UNION ALL
SELECT 'icd_stateful_alert_time', truck, NULL, 'rise_time', NULL, date_trunc('millisecond', max_ts),
       CAST(epoch_us(max_ts) // 1000 - epoch_us(min_ts) // 1000 AS DOUBLE) FROM alert
UNION ALL
SELECT DISTINCT 'icd_recorded_temp', h.truck, NULL, NULL, 'T_motTemp_Lft', h.time, round(h.value, 2)
FROM alert a JOIN history h
  ON h.truck = a.truck AND h.time >= a.max_ts - INTERVAL 1 HOUR AND h.time <= a.max_ts
"""

_RANGES = ", ".join(f"('{name}', {low}, {high}, '{unit}')" for name, low, high, unit in channel_rows())

ORACLES: dict[str, str] = {
    "parse_signals": SIGNALS,
    "parse_readings": f"""
SELECT event_type AS truck, ts AS at, {CHANNEL} AS channel, value, 'C°' AS unit FROM events
""",
    "json_roundtrip": """
SELECT event_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events
""",
    "channel_filter": f"""
SELECT event_type AS truck, ts AS at, {CHANNEL} AS channel, value
FROM events WHERE {CHANNEL} = 'T_motTemp_Lft'
""",
    "dedup_signals": f"""
SELECT DISTINCT id, "timestamp", "signalType", value, "producerId"
FROM ({SIGNALS} UNION ALL {SIGNALS})
""",
    "route_signals": f"""
SELECT {ROUTE} AS topic, CAST(CAST(floor(value) AS INTEGER) AS VARCHAR) AS value, user_id AS id,
       strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS "timestamp"
FROM events WHERE event_type IN ('view', 'click', 'purchase')
""",
    "topic_counts": "SELECT event_type AS topic, count(*) AS count FROM events GROUP BY 1",
    "signal_stats_5m": STATS,
    "persist_signals": RECORDS,
    "partition_by_index": "SELECT CAST(event_id % 16 AS INTEGER) AS number, count(*) AS n FROM events GROUP BY 1",
    "anomaly_windows": _windows(HOURS),
    "anomaly_windows_sliding": _windows(SLIDING),
    "rising_prefix_alerts": """
WITH RECURSIVE r AS (
  SELECT event_type AS truck, date_trunc('day', ts) AS window_start, ts, value,
         row_number() OVER (PARTITION BY event_type, date_trunc('day', ts) ORDER BY ts, value) AS rn,
         min(value) OVER (PARTITION BY event_type, date_trunc('day', ts)) AS lowest
  FROM events
),
chain AS (
  SELECT truck, window_start, CAST(0 AS BIGINT) AS rn, lowest AS level, CAST(0 AS BIGINT) AS alert, false AS hit,
         CAST(NULL AS TIMESTAMP) AS max_ts, CAST(NULL AS DOUBLE) AS max_value
  FROM r WHERE rn = 1
  UNION ALL
  SELECT r.truck, r.window_start, r.rn,
         CASE WHEN r.value - c.level >= 10 THEN r.value ELSE c.level END,
         c.alert + CASE WHEN r.value - c.level >= 10 THEN 1 ELSE 0 END,
         r.value - c.level >= 10, r.ts, r.value
  FROM chain c JOIN r ON r.truck = c.truck AND r.window_start = c.window_start AND r.rn = c.rn + 1
)
SELECT truck, window_start, alert, max_ts, max_value, rn AS prefix_length FROM chain WHERE hit
""",
    "encode_window_alerts": _window_chain(HOURS) + """,
placed AS (
  SELECT s.*, f.alerts, row_number() OVER w - 1 AS position, count(*) OVER (PARTITION BY s.truck, s.window_start) AS size
  FROM found f JOIN src s ON s.truck = f.truck AND s.window_start = f.window_start
  WINDOW w AS (PARTITION BY s.truck, s.window_start ORDER BY s.ts, s.value, s.event_id)
)
SELECT truck, window_start, window_end, CAST(any_value(alerts) AS BIGINT) AS alerts,
       CAST(position // 1000 AS INTEGER) AS part, CAST((any_value(size) + 999) // 1000 AS INTEGER) AS parts,
       CAST(count(*) AS INTEGER) AS n, min(ts) AS first_ts, max(ts) AS last_ts, round(sum(value), 2) AS total
FROM placed GROUP BY truck, window_start, window_end, position // 1000
""",
    "stateful_alerts": HOUR_CHAIN + "SELECT truck, min_ts, min_value, max_ts, max_value FROM alert",
    "stateful_alerts_lookback": HOUR_CHAIN + """
SELECT a.truck, a.max_ts, count(h.time) AS n, round(coalesce(sum(h.value), 0), 2) AS total,
       min(h.time) AS first_time, max(h.time) AS last_time
FROM alert a LEFT JOIN history h
  ON h.truck = a.truck AND h.time >= a.max_ts - INTERVAL 1 HOUR AND h.time <= a.max_ts
GROUP BY a.truck, a.max_ts
""",
    "encode_stateful_alerts": HOUR_CHAIN + """
SELECT truck AS message_key, truck, min_ts, min_value, max_ts, max_value, 0 AS n FROM alert
""",
    "encode_stateful_alerts_full": HOUR_CHAIN + """,
brought AS (
  SELECT h.truck, h.time, h.value, min(a.max_ts) AS max_ts
  FROM history h JOIN alert a ON a.truck = h.truck AND a.max_ts >= h.time
  GROUP BY ALL HAVING min(a.max_ts) - INTERVAL 1 HOUR <= h.time
),
placed AS (
  SELECT a.truck, a.max_ts, b.time, b.value,
         row_number() OVER (PARTITION BY a.truck, a.max_ts ORDER BY b.time) - 1 AS position,
         count(b.time) OVER (PARTITION BY a.truck, a.max_ts) AS size
  FROM alert a LEFT JOIN brought b ON b.truck = a.truck AND b.max_ts = a.max_ts
)
SELECT truck AS message_key, max_ts, CAST(position // 1000 AS INTEGER) AS part,
       CAST(greatest(1, (any_value(size) + 999) // 1000) AS INTEGER) AS parts,
       CAST(count(time) AS INTEGER) AS n, round(coalesce(sum(value), 0), 2) AS total
FROM placed GROUP BY truck, max_ts, position // 1000
""",
    "reading_points": READING_POINTS,
    "window_alert_points": WINDOW_ALERT_POINTS,
    "stateful_alert_points": STATEFUL_ALERT_POINTS,
    "spike_filter": """
SELECT event_id, event_type AS truck, ts AS at, value FROM events
QUALIFY coalesce(abs(value - lag(value) OVER (PARTITION BY event_type ORDER BY ts, value)) < 25, true)
    AND coalesce(abs(value - lead(value) OVER (PARTITION BY event_type ORDER BY ts, value)) < 25, true)
""",
    "series_gaps": """
SELECT event_id, truck, gap_ms, coalesce(gap_ms > 900000, false) AS is_gap
FROM (
  SELECT event_id, event_type AS truck,
         epoch_us(ts) // 1000
           - epoch_us(lag(ts) OVER (PARTITION BY event_type ORDER BY ts, value)) // 1000 AS gap_ms
  FROM events
)
""",
    "channel_range_check": f"""
SELECT event_id, e.channel, e.value, d.unit AS expected_unit,
       CASE WHEN d.low IS NULL THEN 'unknown' WHEN d.low = 0 AND d.high = 0 THEN 'unbounded'
            WHEN e.value < d.low THEN 'low' WHEN e.value > d.high THEN 'high' ELSE 'ok' END AS range_status
FROM (SELECT *, {CHANNEL} AS channel FROM events) e
LEFT JOIN (VALUES {_RANGES}) AS d(channel, low, high, unit) ON d.channel = e.channel
""",
    "history_range": """
SELECT event_type AS truck, ts, value FROM events
WHERE ts > TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-01-20 12:00:00' ORDER BY ts
""",
    "stream_anomaly_windows": f"""
SELECT truck, window_start, window_end, alerts, CAST(n_values AS INTEGER) AS n_values FROM ({_windows(HOURS)})
""",
    "stream_stateful_alerts": HOUR_CHAIN + """
SELECT a.truck, a.min_ts, a.min_value, a.max_ts, a.max_value, CAST(count(*) AS INTEGER) AS n,
       round(sum(e.value), 2) AS total
FROM alert a JOIN events e
  ON e.event_type = a.truck AND e.ts >= a.max_ts - INTERVAL 1 HOUR AND e.ts <= a.max_ts
GROUP BY ALL
""",
    "stream_stateful_messages": HOUR_CHAIN + "SELECT truck, min_ts, min_value, max_ts, max_value FROM alert",
    "stream_dedup": SIGNALS,
    "stream_consume": SIGNALS,
    "stream_from_offsets": f"""
SELECT * FROM (
  SELECT event_type AS topic, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS "offset", user_id AS id,
         strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS "timestamp", {SIGNAL_TYPE} AS "signalType",
         CAST(floor(value) AS INTEGER) AS value, 'p' || CAST(user_id AS VARCHAR) AS "producerId"
  FROM events
) WHERE topic <> 'error' AND (topic <> 'view' OR "offset" >= 120)
""",
    "stream_route_to_log": f"""
SELECT id, "timestamp", "signalType", value, "producerId",
       CASE "signalType" WHEN 'SORTER' THEN 'sorter' WHEN 'PICKER' THEN 'picker' WHEN 'DMS' THEN 'dms' END AS topic
FROM ({SIGNALS}) WHERE "signalType" IN ('SORTER', 'PICKER', 'DMS')
""",
    "stream_route": f"""
SELECT id, "timestamp", "signalType", value, "producerId",
       CASE "signalType" WHEN 'SORTER' THEN 'sorter' WHEN 'PICKER' THEN 'picker' WHEN 'DMS' THEN 'dms' END AS topic
FROM ({SIGNALS}) WHERE "signalType" IN ('SORTER', 'PICKER', 'DMS')
""",
    "stream_topic_counts": "SELECT event_type AS topic, count(*) AS count FROM events GROUP BY 1",
    "stream_signal_stats": STATS,
    "stream_persist_signals": RECORDS,
    "stream_reading_points": READING_POINTS,
    "stream_truck_points": f"SELECT * FROM ({READING_POINTS}) WHERE measurement = 'T_motTemp_Lft'",
    "stream_window_alert_points": WINDOW_ALERT_POINTS,
    "stream_stateful_alert_points": STATEFUL_ALERT_POINTS,
}
