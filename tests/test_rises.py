"""The distributed rise operators against plain row-by-row folds, on awkward series."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from risewatch.functions import rises as column_rises
from risewatch.operators.rises import PossibleLows, Rise, rise_alerts, rise_steps, rising_alerts

T0 = datetime(2018, 1, 1, tzinfo=timezone.utc)
HOUR = 3_600_000_000


def brute_windowed(rows, threshold):
    low, alerts = rows[0][1], []
    for t, v in rows:
        if v - low > threshold:
            alerts.append((t, v))
            low = v
        if v < low:
            low = v
    return alerts


def brute_stateful(rows, threshold):
    low, alerts = rows[0], []
    for t, v in rows:
        if (t - low[0]) // HOUR < 1:
            if v - low[1] > threshold and t > low[0]:
                alerts.append((*low, t, v))
                low = (t, v)
            if t > low[0] and v < low[1]:
                low = (t, v)
        else:
            low = (t, v)
    return alerts


def brute_rising(rows, threshold):
    level, out = min(v for _, v in rows), []
    for i, (t, v) in enumerate(rows, 1):
        if v - level >= threshold:
            level = v
            out.append((t, v, i))
    return out


def series(kind, n, rng):
    t, v, rows = 0, 50.0, []
    for _ in range(n):
        t += rng.choice([0, 1, 60, 600, 3600, 3601]) * 1_000_000 if kind != "dense" else 1_000_000
        if kind == "noise":
            v = rng.expovariate(1 / 50)
        elif kind == "flat":
            v = 20.0
        elif kind == "steps":
            v = float(rng.randrange(0, 6) * 5)
        elif kind == "climb":
            v += rng.random()
        else:
            v += rng.choice([-3.0, -1.0, 0.0, 1.0, 3.5])
        rows.append((t, v))
    return sorted(rows)


KINDS = ["noise", "flat", "steps", "climb", "walk", "dense"]


@pytest.fixture(scope="module")
def many(spark):
    rng = random.Random(7)
    data = {k: series(k, 400, rng) for k in KINDS}
    data["one"] = [(0, 1.0)]
    data["hot"] = series("walk", 3000, rng)
    rows = [(k, T0 + timedelta(microseconds=t), v) for k, s in data.items() for t, v in s]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "truck string, _timestamp timestamp, value double")
    return data, df.repartition(5).cache()


def micros(column):
    return (F.unix_micros(column) - int(T0.timestamp() * 1_000_000)).alias(column)


@pytest.mark.parametrize("partitions", [1, 3, 60])
def test_windowed_fold_is_the_same_for_any_number_of_ranges(many, partitions):
    data, df = many
    got = rise_alerts(df, ["truck"], threshold=10, partitions=partitions)
    got = sorted(map(tuple, got.select("truck", micros("max_ts"), "max_value").collect()))
    assert got == sorted((k, *a) for k, s in data.items() for a in brute_windowed(s, 10))


@pytest.mark.parametrize("partitions", [1, 3, 60])
def test_hour_fold_is_the_same_for_any_number_of_ranges(many, partitions):
    data, df = many
    got = rise_alerts(
        df, ["truck"], threshold=10, expire="1 hour", strict_time=True, partitions=partitions
    ).select("truck", micros("min_ts"), "min_value", micros("max_ts"), "max_value")
    assert sorted(map(tuple, got.collect())) == sorted(
        (k, *a) for k, s in data.items() for a in brute_stateful(s, 10)
    )


@pytest.mark.parametrize("partitions", [1, 3, 60])
def test_rising_prefixes_are_the_same_for_any_number_of_ranges(many, partitions):
    data, df = many
    got = rising_alerts(df, ["truck"], threshold=10, partitions=partitions)
    got = got.select("truck", micros("max_ts"), "max_value", "prefix_length").collect()
    assert sorted(map(tuple, got)) == sorted((k, *a) for k, s in data.items() for a in brute_rising(s, 10))


def test_null_keys_are_one_series_and_unusable_rows_are_left_out(spark):
    rows = [(None, 0, 5.0), (None, 1, 20.0), ("a", 0, 5.0), ("a", 1, None), ("a", None, 99.0),
            ("a", 2, float("nan")), ("a", 3, 16.0)]
    df = spark.createDataFrame(
        [(k, None if s is None else T0 + timedelta(seconds=s), v) for k, s, v in rows],
        "truck string, _timestamp timestamp, value double",
    )
    got = rise_alerts(df, ["truck"], threshold=10, partitions=3).select("truck", "min_value", "max_value")
    assert sorted(map(tuple, got.collect()), key=str) == [("a", 5.0, 16.0), (None, 5.0, 20.0)]


def follow(rise, low, rows, alerts):
    """Follow a low and append (low, reading) per alert."""
    found: list = []
    low = rise.follow(low, [t for t, _ in rows], [v for _, v in rows], found)
    alerts += [(t0, v0, *rows[i]) for i, t0, v0 in found]
    return low


def cut_into_ranges(rise, rows, cuts):
    """What the two passes do with one series, in plain Python: alerts, and how many readings were pending."""
    alerts, pending, low = [], 0, None
    for start, end in zip([0, *cuts], [*cuts, len(rows)]):
        if start == end:
            continue
        possible, needed, settled = PossibleLows(rise, rows[start][0]), [], None
        for i in range(start, end):
            needed += possible.add(*rows[i])
            settled = possible.settled()
            if settled:
                break
        needed = sorted(needed + possible.rest())
        pending += len(needed)
        if low is None:
            low, needed = needed[0], needed[1:]
        low = follow(rise, low, needed, alerts)
        if settled:
            low = follow(rise, settled, rows[i + 1 : end], alerts)
    return alerts, pending


@pytest.mark.parametrize("rise", [Rise(10.0), Rise(10.0, HOUR, True)])
@pytest.mark.parametrize("kind", [*KINDS, "calm", "ties"])
def test_cutting_a_series_anywhere_changes_nothing(rise, kind):
    rng = random.Random(kind)
    for _ in range(300):
        n = rng.choice([5, 40, 200])
        if kind == "calm":
            rows = [(i * rng.choice([1, 1_000_000, 200_000_000]), 20 + 5 * rng.random()) for i in range(n)]
        elif kind == "ties":
            rows = [(i // 3 * 900_000_000, float(rng.randrange(0, 30, 6))) for i in range(n)]
        else:
            rows = series(kind, n, rng)
        rows.sort()
        cuts = sorted(rng.randrange(0, n + 1) for _ in range(rng.choice([0, 1, 5, 30])))
        whole: list = []
        follow(rise, rows[0], rows[1:], whole)
        got, _ = cut_into_ranges(rise, rows, cuts)
        part = slice(None) if rise.expire_us else slice(1, None)  # equal lows are told apart only with expiry
        assert [a[part] for a in got] == [a[part] for a in whole]


def test_calm_and_noisy_series_leave_little_pending():
    rng = random.Random(11)
    for spread in (5, 100):
        rows = [(i * 1000, spread * rng.random()) for i in range(20_000)]
        for rise in (Rise(10.0), Rise(10.0, HOUR, True)):
            _, pending = cut_into_ranges(rise, rows, list(range(0, 20_000, 2_000)))
            assert pending < 400


def rise_rows(spark, values, seconds=None):
    seconds = seconds or range(len(values))
    return spark.createDataFrame(
        [("H", T0 + timedelta(seconds=s), float(v)) for s, v in zip(seconds, values)],
        "truck string, _timestamp timestamp, value double",
    )


RISE = [5, 10, 15, 20, 25, 30, 35]


@pytest.mark.parametrize("values, count", [(RISE, 2), ([*RISE, 5], 2), ([5, 15], 0), ([5, 15.1], 1)])
def test_golden_windowed(spark, values, count):
    df = rise_rows(spark, values)
    assert rise_alerts(df, ["truck"], threshold=10).count() == count
    folded = df.groupBy("truck").agg(column_rises.ordered_values("_timestamp", "value").alias("values"))
    row = folded.select(column_rises.rise_count(F.col("values"), 10).alias("n"), F.size("values").alias("s")).head()
    assert (row.n, row.s) == (count, len(values))


@pytest.mark.parametrize("values, seconds, pairs", [
    (RISE, None, [(5, 20), (20, 35)]),
    ([5, 20, 50, 70, 100, 200], [0, 1, 3660, 3720, 3900, 7800], [(5, 20), (50, 70), (70, 100)]),
    ([5, 15], None, []),
    ([5, 50], [0, 3599.999], [(5, 50)]),
    ([5, 50], [0, 3600], []),
    ([5, 50], [0, 0], []),
])
def test_golden_stateful(spark, values, seconds, pairs):
    got = rise_alerts(rise_rows(spark, values, seconds), ["truck"], threshold=10, expire="1 hour", strict_time=True)
    assert sorted((r.min_value, r.max_value) for r in got.collect()) == pairs


@pytest.mark.parametrize("values, lengths", [(RISE, [3, 5, 7]), ([5, 15], [2]), ([9, 5, 14.9], [])])
def test_golden_rising_prefix(spark, values, lengths):
    df = rise_rows(spark, values)
    got = rising_alerts(df, ["truck"], threshold=10).orderBy("alert").collect()
    assert [r.prefix_length for r in got] == lengths
    folded = df.groupBy("truck").agg(column_rises.ordered_values("_timestamp", "value").alias("values"))
    prefixes = folded.select(column_rises.rising_prefixes(F.col("values"), 10).alias("p")).head().p
    assert [len(p) for p in prefixes] == lengths
    assert [[r.value for r in p] for p in prefixes] == [values[:n] for n in lengths]


@pytest.mark.parametrize("kind", ["constant", "two levels", "slow climb"])
def test_idle_sensors_hand_over_one_row_per_possible_low(kind):
    """At one reading a second and an hour's expiry, whatever the range's length; and each row is right."""
    rng, rise, n = random.Random(2), Rise(10.0, HOUR, True), 20_000
    value = {"constant": lambda i: 20.0, "two levels": lambda i: 20.0 + (rng.random() < 0.3), "slow climb": lambda i: i / 5000}[kind]
    rows = [(i * 1_000_000, value(i)) for i in range(n)]
    possible = PossibleLows(rise, 0)
    for t, v in rows:
        possible.add(t, v)
        if possible.settled():
            break
    table = possible.leaving()
    assert len(table) <= 3601
    for low in [(-1, 15.0), (-1_800_000_000, 20.5), (-HOUR + 1, 20.0), (-HOUR + 5_000_000, 19.0), (-2 * HOUR, 1.0)]:
        want = rise.follow(low, [t for t, _ in rows], [v for _, v in rows], [])
        entry = next((r for r in sorted(table, key=lambda r: r[2:]) if rise.reacts(low, *r[2:])), None)
        assert possible.settled() or (entry[:2] if entry else low) == want


def test_closing_lows_are_where_the_fold_stands(many):
    data, df = many
    for partitions in (1, 7, 60):
        steps = rise_steps(df, ["truck"], threshold=10, expire="1 hour", strict_time=True, partitions=partitions)
        got = {r.truck: (r.low_ts, r.low_value) for r in steps.where("closing").select("truck", micros("low_ts"), "low_value").collect()}
        for k, rows in data.items():
            low = Rise(10.0, HOUR, True).follow(rows[0], [t for t, _ in rows], [v for _, v in rows], [])
            assert got[k] == low
        assert len(got) == len(data)
