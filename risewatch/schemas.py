"""All record shapes, declared once."""

from __future__ import annotations

from pyspark.sql import types as T

LOG = T.StructType([
    T.StructField("key", T.BinaryType()),
    T.StructField("value", T.BinaryType()),
    T.StructField("topic", T.StringType()),
    T.StructField("partition", T.IntegerType()),
    T.StructField("offset", T.LongType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("timestampType", T.IntegerType()),
])

SIGNAL = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("signalType", T.StringType()),
    T.StructField("value", T.IntegerType()),
    T.StructField("producerId", T.StringType()),
])

# The statistics job reads signals that need not carry a type.
UNTYPED_SIGNAL = T.StructType([f for f in SIGNAL if f.name != "signalType"])

READING = T.StructType([
    T.StructField("truck", T.StringType()),
    T.StructField("_timestamp", T.TimestampType()),
    T.StructField("channel", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("unit", T.StringType()),
])

# The point loader's readings carry no unit.
UNITLESS_READING = T.StructType([f for f in READING if f.name != "unit"])

SAMPLE = T.StructType([
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("value", T.DoubleType()),
])

WINDOW_ALERT = T.StructType([
    T.StructField("processing_time", T.TimestampType()),
    T.StructField("truck", T.StringType()),
    T.StructField("alert_time", T.StructType([
        T.StructField("start", T.TimestampType()),
        T.StructField("end", T.TimestampType()),
    ])),
    T.StructField("alerts", T.LongType()),
    T.StructField("values", T.ArrayType(T.StructType([
        T.StructField("_timestamp", T.TimestampType()),
        T.StructField("value", T.DoubleType()),
    ]))),
    T.StructField("part", T.IntegerType()),
    T.StructField("parts", T.IntegerType()),
])

STATEFUL_ALERT = T.StructType([
    T.StructField("truck", T.StringType()),
    T.StructField("min", SAMPLE),
    T.StructField("max", SAMPLE),
    T.StructField("measurements", T.ArrayType(SAMPLE, containsNull=False)),
    T.StructField("part", T.IntegerType()),
    T.StructField("parts", T.IntegerType()),
])

EVENT = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])

# Fixed value: the one channel the alert jobs watch.
WATCHED_CHANNEL = "T_motTemp_Lft"

# JSON timestamps are written with microseconds so that a round trip is exact.
JSON_OPTIONS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
