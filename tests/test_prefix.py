"""The lows that enter ranges, by pointer jumping, against the row-by-row fold."""

import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from risewatch.operators import prefix, rises
from risewatch.operators.rises import Rise, rise_alerts, rise_counts, rise_folds, rise_steps

T0 = datetime(2018, 1, 1, tzinfo=timezone.utc)
HOUR = 3_600_000_000


@pytest.fixture
def jumping(monkeypatch):
    monkeypatch.setattr(rises, "SERIAL_ROWS", -1)


def plain(rows, rise):
    """Per series its alerts and closing low."""
    out = {}
    by = {}
    for truck, at, value in rows:
        by.setdefault(truck, []).append((at, value))
    for truck, series in by.items():
        series.sort()
        low, alerts = series[0], []
        for t, v in series[1:]:
            if rise.expire_us is not None and t - low[0] >= rise.expire_us:
                low = (t, v)
            elif rise.strict_time and t <= low[0]:
                continue
            elif v - low[1] > rise.threshold:
                alerts.append((*low, t, v))
                low = (t, v)
            elif v < low[1]:
                low = (t, v)
        out[truck] = (alerts, low)
    return out


def frame(spark, rows):
    return spark.createDataFrame([(k, T0 + timedelta(microseconds=t), v) for k, t, v in rows], "truck string, _timestamp timestamp, value double")


def series(kind, n, seed, step):
    r = random.Random(seed)
    if kind == "constant":
        return [(i * step, 5.0) for i in range(n)]
    if kind == "idle":
        return [(i * step, r.choice([5.0, 5.25, 6.0, 9.0])) for i in range(n)]
    if kind == "climb":
        return [(i * step, i * 9.0 / n) for i in range(n)]
    if kind == "saw":
        return [(i * step, float(i % 37)) for i in range(n)]
    if kind == "ties":
        return [(i // 50 * step, r.choice([1.0, 8.0, 12.0, 30.0])) for i in range(n)]
    return [(i * step, r.uniform(0, 30)) for i in range(n)]


@pytest.mark.parametrize("kind, step", [
    ("constant", 1_000_000), ("constant", 120_000_000), ("idle", 120_000_000), ("climb", 1_000_000), ("ties", 1_000_000), ("wild", 120_000_000)])
def test_stateful_alerts_equal_the_fold(spark, jumping, kind, step):
    rise = Rise(10.0, HOUR, True)
    rows = [("hot", t, v) for t, v in series(kind, 1500, 1, step)]
    rows += [(None, t, v) for t, v in series("idle", 400, 2, step)] + [(f"k{i}", i, 1.0) for i in range(30)]
    want = plain(rows, rise)
    steps = rise_steps(frame(spark, rows), ["truck"], threshold=10, expire="1 hour", strict_time=True, partitions=9).collect()
    micros = lambda t: round((t.replace(tzinfo=timezone.utc) - T0) / timedelta(microseconds=1))
    got = {k: ([], []) for k in want}
    for r in steps:
        if r.closing:
            got[r.truck][1].append((micros(r.low_ts), r.low_value))
        else:
            got[r.truck][0].append((micros(r.low_ts), r.low_value, micros(r.max_ts), r.max_value))
    assert {k: (sorted(a), c) for k, (a, c) in got.items()} == {k: (a, [c]) for k, (a, c) in want.items()}


@pytest.mark.parametrize("kind", ["climb", "saw", "ties"])
def test_counts_and_folds_equal_the_fold(spark, jumping, kind):
    rise = Rise(10.0)
    rows = [("hot", t, v) for t, v in series(kind, 1500, 1, 1_000_000)] + [("b", 5, 1.0), ("b", 7, 50.0)]
    want = plain(rows, rise)
    df = frame(spark, rows)
    counts = {r.truck: r.alerts for r in rise_counts(df, ["truck"], threshold=10, partitions=9).collect()}
    assert counts == {k: len(a) for k, (a, _) in want.items() if a}
    folds = {r.truck: (r.alerts, r.low_value, r.n_values) for r in rise_folds(df, ["truck"], threshold=10, partitions=9).collect()}
    assert folds == {k: (len(a), low[1], sum(r[0] == k for r in rows)) for k, (a, low) in want.items()}


def test_both_ways_agree_on_the_events(spark, sf_dir, monkeypatch):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.lit("all").alias("truck"), F.col("ts").cast("timestamp").alias("_timestamp"), "value")
    found = []
    for most in (-1, 1 << 40):
        monkeypatch.setattr(rises, "SERIAL_ROWS", most)
        found.append(sorted(map(str, rise_alerts(rows, ["truck"], threshold=10, expire="1 hour", strict_time=True, partitions=40).collect())))
    assert found[0] == found[1] and found[0]


def test_an_idle_dense_series_sends_few_rows_to_any_task(spark, jumping):
    """200,000 readings of one value, ten a second: every one is an entry, and none meets another.

    Rows go to tasks by range, and nothing puts the ranges of one series together.
    """
    n, ranges = 200_000, 400
    tables = spark.range(n).select(
        F.lit("hot").alias("k0"), F.floor(F.col("id") / (n // ranges)).alias("place"), F.lit(False).alias("sure"),
        (F.col("id") * 100_000).alias("t1"), F.lit(5.0).alias("v1"), (F.col("id") * 100_000).alias("t0"), F.lit(5.0).alias("v0"),
    )
    places, taken = prefix.paths(tables, ["k0"], prefix.Reaction(10.0, HOUR, True))
    assert len(places) == ranges
    # 20,000 seconds in all: the low is given up after each hour.
    assert [(t, v) for _, t, v in taken[("hot",)]] == [(h * HOUR, 5.0) for h in range(6)]
    groups = tables.groupBy("k0", "place").count()
    assert groups.agg(F.max("count")).first()[0] <= n // 100


def test_a_range_met_by_very_many_lows_is_copied(spark, jumping, monkeypatch):
    monkeypatch.setattr(prefix, "LOWS_PER_TASK", 50)
    rise = Rise(10.0, HOUR, True)
    rows = [("hot", t, v) for t, v in series("constant", 900, 1, 1_000_000)] + [("hot", 3 * HOUR + i, 40.0 - i) for i in range(20)]
    want = plain(rows, rise)
    steps = rise_steps(frame(spark, rows), ["truck"], threshold=10, expire="1 hour", strict_time=True, partitions=9).collect()
    assert [r.low_value for r in steps if r.closing] == [want["hot"][1][1]]


def test_first_reacting_equals_a_search_one_by_one():
    r = np.random.default_rng(4)
    for reaction in (prefix.Reaction(1.5, None, False), prefix.Reaction(1.5, 40, True), prefix.Reaction(0.1, 7, True)):
        rise = Rise(reaction.threshold, reaction.expire_us, reaction.strict_time)
        for _ in range(60):
            times = np.sort(r.integers(0, 30, r.integers(1, 25)))
            values = r.integers(0, 60, len(times)) / 10
            t0 = times[0] - r.integers(0, 40, 50)
            v0 = r.integers(0, 60, 50) / 10
            got = prefix.first_reacting(reaction, times, values, t0, v0)
            want = [next((i for i, (t, v) in enumerate(zip(times, values)) if rise.reacts((a, b), t, v)), len(times)) for a, b in zip(t0, v0)]
            assert got.tolist() == want
