"""Window alerts batch by batch, and the store of readings behind them and the stateful alerts."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from risewatch.operators import alerts
from risewatch.streaming import sinks
from risewatch.streaming.stateful import read_alerts, stateful_alert_writer
from risewatch.streaming.store import ReadingStore
from risewatch.streaming.windows import read_window_alerts, window_alert_writer

T0 = datetime(2018, 1, 1, tzinfo=timezone.utc)
SCHEMA = "truck string, _timestamp timestamp, value double"


def frame(spark, rows):
    return spark.createDataFrame([(k, None if s is None else T0 + timedelta(seconds=s), v) for k, s, v in rows], SCHEMA)


def some(n, seed):
    r = random.Random(seed)
    rows = [(r.choice(["A", "A", "A", "B", None]), r.randrange(0, 4 * 3600), r.choice([0.0, 4.0, 11.0, 30.0])) for _ in range(n)]
    return rows + [("A", 5, None), ("A", None, 1.0), ("B", 7, float("nan"))]


COLUMNS = ["truck", "window_start", "window_end", "alerts", "n_values", "first_ts", "last_ts"]


def collected(df):
    return sorted(map(str, df.select(COLUMNS).collect()))


@pytest.mark.parametrize("order, slide", [("time", None), ("any", "15 minutes")])
def test_batches_equal_the_table_in_any_order(spark, tmp_path, order, slide):
    rows = some(400, 1)  # three batches
    if order == "time":
        rows.sort(key=lambda r: r[1] or 0)
    write = window_alert_writer(str(tmp_path), 10, slide=slide, lateness=None)
    for n in range(3):
        write(frame(spark, rows[n * 135 : (n + 1) * 135]), n)
    want = alerts.window_alerts(frame(spark, rows), 10, "60 minutes", slide)
    assert collected(read_window_alerts(spark, str(tmp_path))) == collected(want)


def test_windows_keep_a_row_and_no_list(spark, tmp_path):
    write = window_alert_writer(str(tmp_path), 10)
    write(frame(spark, [("A", s, float(s % 50)) for s in range(3000)]), 0)
    write(frame(spark, [("A", s, float(s % 50)) for s in range(3000, 3500)]), 1)
    kept = spark.read.parquet(f"{tmp_path}/windows/batch=1")
    assert kept.count() == 1 and not any("array" in t or "struct" in t for _, t in kept.dtypes)
    assert [(r.alerts, r.n_values) for r in read_window_alerts(spark, str(tmp_path)).collect()] == [(3500 // 50 * 4, 3500)]


def test_a_batch_in_time_reads_none_of_the_earlier_ones(spark, tmp_path, monkeypatch):
    write = window_alert_writer(str(tmp_path), 10)
    write(frame(spark, [("A", s, 5.0) for s in range(20)]), 0)
    monkeypatch.setattr(ReadingStore, "between", None)
    write(frame(spark, [("A", s, 5.0 + s) for s in range(20, 60)]), 1)
    with pytest.raises(TypeError):
        write(frame(spark, [("A", 3, 1.0)]), 2)


def test_late_readings_closed_windows_and_a_repeated_batch(spark, tmp_path):
    sent = {}
    write = window_alert_writer(str(tmp_path), 10, publish=lambda df, n: sent.update({n: df.collect()}))
    write(frame(spark, [("A", 60, 5.0), ("A", 120, 30.0)]), 0)
    for _ in range(2):  # as after a failure
        write(frame(spark, [("A", 90, 20.0), ("A", 3 * 3600, 1.0)]), 1)  # falls between the two
    # 5, 20, 30: an alert at 20, and 30 is no more than 10 above it.
    assert [(r.alerts, r.n_values) for r in read_window_alerts(spark, str(tmp_path)).collect()] == [(1, 3)]
    write(frame(spark, [("A", 100, 99.0), ("A", 3 * 3600 + 1, 50.0)]), 2)  # the first hour is closed by now
    found = {r.window_start.hour: (r.alerts, r.n_values) for r in read_window_alerts(spark, str(tmp_path)).collect()}
    assert found == {0: (1, 3), 3: (1, 2)}
    assert [len(rows) for rows in sent.values()] == [1, 1, 1]


@pytest.mark.parametrize("mode, want", [("update", [1, 1]), ("append", [0, 1]), ("complete", [1, 2])])
def test_modes(spark, tmp_path, mode, want):
    sent = []
    write = window_alert_writer(str(tmp_path), 10, mode=mode, publish=lambda df, _: sent.append(df.count()))
    write(frame(spark, [("A", 0, 5.0), ("A", 60, 50.0)]), 0)
    write(frame(spark, [("A", 3 * 3600, 5.0), ("A", 3 * 3600 + 5, 50.0)]), 1)
    assert sent == want
    with pytest.raises(ValueError):
        window_alert_writer("unused", 10, mode="never")


def test_nothing_in_a_batch(spark, tmp_path):
    sent = []
    write = window_alert_writer(str(tmp_path), 10, publish=lambda df, _: sent.append(df.count()))
    write(frame(spark, [("A", None, 1.0)]), 0)
    write(frame(spark, []), 1)
    assert sent == [0, 0] and read_window_alerts(spark, str(tmp_path)).count() == 0


def test_a_new_checkpoint_gives_its_own_windows(spark, tmp_path):
    for run, value in (("b", 50.0), ("a", 70.0)):
        write = window_alert_writer(str(tmp_path), 10, run=run)
        write(frame(spark, [("A", 0, 5.0), ("A", 60, value)]), 0)
    write(frame(spark, [("A", 90, 99.0)]), 1)
    assert [(r.alerts, r.n_values) for r in read_window_alerts(spark, str(tmp_path)).collect()] == [(2, 3)]


# The store

def stored(spark, hour):
    return spark.createDataFrame([("A", T0 + timedelta(hours=hour), 1.0)], "truck string, time timestamp, value double")


def test_folders_do_not_grow_with_the_number_of_batches(spark, tmp_path):
    store = ReadingStore(spark, str(tmp_path))
    for n in range(50):
        before = store.index(n - 1).newest
        index = store.append(stored(spark, n), n, None if before is None else before - 3 * 3_600_000_000)
    assert len(index.folders) == 5
    assert len(list((tmp_path / "data").iterdir())) <= 7 and len(list((tmp_path / "index").glob("*.json"))) <= 4
    first = index.newest - 3_600_000_000
    assert len(store.between(index, first).inputFiles()) == 2 and store.between(index, first).count() == 2


def test_a_repeated_append_replaces_itself(spark, tmp_path):
    store = ReadingStore(spark, str(tmp_path))
    store.append(stored(spark, 0), 0)
    for _ in range(2):
        index = store.append(stored(spark, 1), 1)
    assert [f.batch for f in index.folders] == [0, 1] and store.between(index).count() == 2
    assert store.index(7).folders == () and store.between(store.index(7)).count() == 0


# Stateful alerts

def test_a_quiet_batch_reads_no_history(spark, tmp_path, monkeypatch):
    sent = []
    write = stateful_alert_writer(str(tmp_path), 10, publish=lambda df, _: sent.append(df.count()))
    write(frame(spark, [("A", s, 5.0) for s in range(20)]), 0)
    monkeypatch.setattr(ReadingStore, "between", None)
    write(frame(spark, [("A", 30, 6.0)]), 1)
    assert sent == [0, 0]
    with pytest.raises(TypeError):
        write(frame(spark, [("A", 40, 60.0)]), 2)


def test_a_new_checkpoint_on_the_same_path_gives_its_own_alerts(spark, tmp_path):
    for run, values in (("b", [5.0, 50.0, 5.0, 70.0]), ("a", [1.0, 20.0])):
        write = stateful_alert_writer(str(tmp_path), 10, run=run)
        for n, value in enumerate(values):
            write(frame(spark, [("A", n, value)]), n)
    assert [(r.min_value, r.max_value) for r in read_alerts(spark, str(tmp_path)).collect()] == [(1.0, 20.0)]
    # The old run goes on from its own lows, and does not come back.
    stateful_alert_writer(str(tmp_path), 10, run="b")(frame(spark, [("A", 9, 99.0)]), 4)
    assert [(r.min_value, r.max_value) for r in read_alerts(spark, str(tmp_path)).collect()] == [(1.0, 20.0)]


def test_look_back_history_skips_folders_out_of_reach(spark, tmp_path):
    write = stateful_alert_writer(str(tmp_path), 10)
    for n in range(4):
        write(frame(spark, [("A", n * 7200, 5.0), ("A", n * 7200 + 9, 50.0)]), n)
    store = ReadingStore(spark, f"{tmp_path}/history")
    index = store.index(3)
    assert len(index.folders) == 4
    rows = store.between(index, index.newest - 3_600_000_000)
    assert all("batch=3" in f for f in rows.inputFiles()) and rows.agg(F.count("value")).first()[0] == 2
