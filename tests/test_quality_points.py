import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from risewatch.functions.channels import channel_rows
from risewatch.operators import alerts, lookback, parsing, points, quality
from risewatch.sources.tables import history_range

T0 = datetime(2018, 1, 1, tzinfo=timezone.utc)
READINGS = "truck string, _timestamp timestamp, channel string, value double"


def readings(spark, rows):
    return spark.createDataFrame([(k, T0 + timedelta(seconds=s), "T_motTemp_Lft", float(v)) for k, s, v in rows], READINGS)


@pytest.mark.parametrize("values, kept", [
    ((0, -40, 0), False), ((22, 20, 30), False), ((20, 10, 10), False), ((22, 20, 26), True), ((22, 20, 29), True)])
@pytest.mark.parametrize("spacing", [1, 500, 5000])
def test_spikes(spark, values, kept, spacing):
    df = readings(spark, [("H", i * spacing, v) for i, v in enumerate(values)])
    middle = T0 + timedelta(seconds=spacing)
    left = [r for r in quality.without_spikes(df, 10).collect() if r._timestamp.replace(tzinfo=timezone.utc) == middle]
    assert bool(left) is kept
    assert quality.without_spikes(df, 10, send_all=True).count() == 3


@pytest.mark.parametrize("span", [1, 20, 3000])
def test_neighbours_do_not_depend_on_ranges(spark, span):
    """Down to a series that holds half of all rows within one second."""
    rng = random.Random(1)
    rows = [(k, rng.randrange(0, span if k == "a" else 3000), rng.randrange(0, 50)) for k in "ab" for _ in range(200)]
    got = quality.with_neighbours(readings(spark, rows)).collect()
    pairs = [(r.truck, r._timestamp, r.value, r.prev and r.prev.value, r.next and r.next.value) for r in got]
    want = []
    for k in "ab":
        series = sorted((s, float(v)) for kk, s, v in rows if kk == k)
        values = [v for _, v in series]
        for i, v in enumerate(values):
            want.append((k, v, values[i - 1] if i else None, values[i + 1] if i + 1 < len(values) else None))
    # Equal readings are interchangeable, so compare as multisets.
    assert sorted(map(str, [(k, v, p, n) for k, _, v, p, n in pairs])) == sorted(map(str, want))


def test_a_dense_second_is_spread_and_rows_without_place_stay(spark):
    rows = [("H", 1 + i / 10_000, i % 7) for i in range(5000)] + [(None, 1, 2), ("H", 1, 3)]
    df = readings(spark, rows).withColumn("_timestamp", F.when(F.col("value") != 3, F.col("_timestamp")))
    got = quality.with_neighbours(df)
    assert got.count() == len(rows)
    assert got.where("(truck IS NULL OR _timestamp IS NULL) AND (prev IS NOT NULL OR next IS NOT NULL)").count() == 0
    assert quality.without_spikes(df, 100).count() == len(rows)


def test_gaps(spark):
    df = readings(spark, [("H", 0, 1), ("H", 10, 1), ("H", 10.5, 1), ("I", 3, 1)])
    got = {(r.truck, r.gap_ms, r.is_gap) for r in quality.series_gaps(df, 500).collect()}
    assert got == {("H", None, False), ("H", 10000, True), ("H", 500, False), ("I", None, False)}
    assert not any(r.is_gap for r in quality.series_gaps(df, 0).collect())


def test_channel_ranges(spark):
    rows = [("T_motTemp_Lft", 0.0), ("T_motTemp_Lft", 120.5), ("TSteerAngle", -121.0), ("SpLim", 1e9), ("none", 1.0)]
    df = spark.createDataFrame([("H", T0, c, v) for c, v in rows], READINGS)
    got = {(r.channel, r.value): (r.range_status, r.expected_unit) for r in quality.channel_range_check(df).collect()}
    assert [got[r] for r in rows] == [("ok", "C°"), ("high", "C°"), ("low", "deg"), ("unbounded", ""), ("unknown", None)]
    assert len(channel_rows()) == len({r[0] for r in channel_rows()}) == 55


def test_history_range_excludes_its_bounds(spark):
    df = readings(spark, [("H", s, s) for s in (3, 1, 2, 4)])
    got = history_range(df, T0 + timedelta(seconds=1), T0 + timedelta(seconds=4)).collect()
    assert [r.value for r in got] == [2.0, 3.0]


def stateful(spark, rows):
    return spark.createDataFrame(
        [(k, T0 + timedelta(seconds=a), float(x), T0 + timedelta(seconds=b), float(y)) for k, a, x, b, y in rows],
        "truck string, min_ts timestamp, min_value double, max_ts timestamp, max_value double")


@pytest.fixture(scope="module")
def look(spark):
    rng = random.Random(5)
    history = sorted({(k, rng.randrange(0, 20000)) for k in "abc" for _ in range(150)} | {("a", 3600), ("a", 7200)})
    history = [(k, s, float(i % 17)) for i, (k, s) in enumerate(history)]
    found = [(k, s - 5, 1, s, 30) for k, s, _ in history if k != "c" and rng.random() < 0.2]
    found += [("a", 0, 1, 7200, 30), ("d", 0, 1, 50, 30)]
    found = sorted({(k, s): (k, a, x, s, y) for k, a, x, s, y in found}.values())
    h = spark.createDataFrame([(k, T0 + timedelta(seconds=s), v) for k, s, v in history],
                              "truck string, time timestamp, value double")
    spans = {(k, s): [(t, v) for kk, t, v in history if kk == k and s - 3600 <= t <= s] for k, _, _, s, _ in found}
    return stateful(spark, found), h, spans


def seconds(ts):
    return None if ts is None else int((ts.replace(tzinfo=timezone.utc) - T0).total_seconds())


def test_lookback_summary(look):
    found, history, spans = look
    got = {(r.truck, seconds(r.max_ts)): (r.n, r.total, seconds(r.first_time), seconds(r.last_time))
           for r in lookback.lookback_stats(found, history).collect()}
    assert got == {
        k: (len(s), sum(v for _, v in s), s[0][0] if s else None, s[-1][0] if s else None) for k, s in spans.items()}


def test_lookback_lists(look):
    found, history, spans = look
    got = {(r.truck, seconds(r.max_ts)): [(seconds(m.timestamp), m.value) for m in r.measurements]
           for r in lookback.with_measurements(found, history).collect()}
    assert got == spans


@pytest.mark.parametrize("per_message", [3, 1000])
def test_new_measurements_bring_each_reading_once(look, per_message, monkeypatch):
    monkeypatch.setattr(alerts, "PER_MESSAGE", per_message)
    found, history, spans = look
    got = lookback.with_new_measurements(found, history).collect()
    sent = [(r.truck, seconds(m.timestamp), m.value) for r in got for m in r.measurements]
    assert sorted(sent) == sorted({(k, t, v) for (k, _), s in spans.items() for t, v in s})
    assert max(len(r.measurements) for r in got) <= per_message
    assert {(r.truck, seconds(r.max_ts)) for r in got} == set(spans)
    for key in spans:
        parts = sorted((r.part, r.parts, len(r.measurements)) for r in got if (r.truck, seconds(r.max_ts)) == key)
        assert [p[0] for p in parts] == list(range(parts[0][1]))  # all parts are there, and numbered
        assert all(n == per_message for _, _, n in parts[:-1])
    times = [seconds(m.timestamp) for r in sorted(got, key=lambda r: (r.truck, r.max_ts, r.part)) if r.truck == "a" for m in r.measurements]
    assert times == sorted(times)


def test_a_missing_series_has_its_look_back(spark):
    found = stateful(spark, [(None, 0, 5, 3, 20)])
    history = spark.createDataFrame([(None, T0 + timedelta(seconds=s), float(s)) for s in range(3)],
                                    "truck string, time timestamp, value double")
    assert [r.n for r in lookback.lookback_stats(found, history).collect()] == [3]
    assert [len(r.measurements) for r in lookback.with_measurements(found, history).collect()] == [3]
    assert [len(r.measurements) for r in lookback.with_new_measurements(found, history).collect()] == [3]


def test_alert_becomes_four_points_and_one_per_measurement(spark):
    found = stateful(spark, [("H", 0, 5, 3, 20)])
    history = spark.createDataFrame([("H", T0 + timedelta(seconds=s), float(s)) for s in range(3)],
                                    "truck string, time timestamp, value double")
    log = alerts.encode_stateful_alerts(lookback.with_measurements(found, history)).withColumn(
        "timestamp", F.current_timestamp())
    got = points.stateful_alert_points(parsing.parse_stateful_alerts(log), "j", "c").collect()
    assert len(got) == 4 + 3
    by_tag = {r.tags.get("alert_mode") or r.tags.get("time_mode"): (r.measurement, seconds(r.time), r.value)
              for r in got if "temp" not in r.tags}
    assert by_tag == {
        "max_alert": ("icd_stateful_alert", 3, 20.0), "min_alert": ("icd_stateful_alert", 0, 5.0),
        "diff_temp": ("icd_stateful_alert", 3, 15.0), "rise_time": ("icd_stateful_alert_time", 3, 3000.0)}
    assert all(r.tags["truck"] == "H" and r.tags["jenkins_job"] == "j" and r.tags["cluster_id"] == "c" for r in got)


def test_later_point_replaces_earlier(spark):
    df = readings(spark, [("H", 0.0001, 1), ("H", 0.0002, 2), ("H", 1, 3)]).withColumn("offset", F.col("value"))
    stored = points.latest_points(points.reading_points(df, keep=("offset",)), "offset").collect()
    assert sorted((seconds(r.time), r.value) for r in stored) == [(0, 2.0), (1, 3.0)]
    assert all(r.tags == {"truck": "H"} for r in stored)


@pytest.mark.parametrize("size", [2, 3, 4, 5, 6, 7, 12])
def test_parts_at_sizes_around_the_limit(spark, monkeypatch, size):
    monkeypatch.setattr(alerts, "PER_MESSAGE", 3)
    df = readings(spark, [("H", i, 50 * i) for i in range(size)])
    messages = alerts.encode_window_alerts(alerts.window_alert_values(alerts.window_alerts(df, 10), df))
    log = messages.withColumn("timestamp", F.current_timestamp())
    rows = parsing.parse_log(log, parsing.schemas.WINDOW_ALERT).collect()
    found = sorted((r.part, r.parts, r.alerts, [v.value for v in r["values"]]) for r in rows)
    values = [50.0 * i for i in range(size)]
    assert found == [(i, -(-size // 3), size - 1, values[3 * i : 3 * i + 3]) for i in range(-(-size // 3))]
    # However many parts there are, an alert is one point.
    assert [r.value for r in points.window_alert_points(parsing.parse_window_alerts(log)).collect()] == [size - 1]


@pytest.mark.parametrize("per_message", [3, 1000])
def test_window_messages_hold_every_reading(spark, per_message, monkeypatch):
    monkeypatch.setattr(alerts, "PER_MESSAGE", per_message)
    df = readings(spark, [("H", i, 5 * i + 5) for i in range(7)] + [("I", i, 1) for i in range(5)] +
                  [(None, i, 50 * i) for i in range(2)])
    found = alerts.window_alerts(df, 10)
    assert sorted((str(r.truck), r.alerts, r.n_values) for r in found.collect()) == [("H", 2, 7), ("None", 1, 2)]
    messages = alerts.window_alert_values(found, df)
    sizes = messages.groupBy("truck").agg(F.sum(F.size("values")).alias("n"), F.count("*").alias("m")).collect()
    assert sorted((str(r.truck), r.n) for r in sizes) == [("H", 7), ("None", 2)]
    if per_message == 1000:
        assert all(r.m == 1 for r in sizes)
    live = alerts.live_window_alerts(df, 10, watermark=None)
    assert sorted((str(r.truck), r.alerts, len(r["values"])) for r in live.collect()) == [("H", 2, 7), ("None", 1, 2)]
    log = alerts.encode_window_alerts(live).withColumn("timestamp", F.current_timestamp())
    back = parsing.parse_window_alerts(log).where("truck = 'H'").head()
    assert (back.alerts, seconds(back.start), seconds(back.end)) == (2, 0, 3600)


def test_sliding_windows(spark):
    df = readings(spark, [("H", 3500, 5), ("H", 3700, 50)])
    got = alerts.window_alerts(df, 10, "60 minutes", "30 minutes").collect()
    assert [(seconds(r.window_start), seconds(r.window_end), r.alerts) for r in got] == [(1800, 5400, 1)]
