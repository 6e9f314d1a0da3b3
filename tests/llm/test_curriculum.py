"""The curriculum against a plain version."""

import hashlib
import math
import random
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from risewatch.llm import curriculum
from risewatch.llm.curriculum import Schedule, mix, per_document
from risewatch.llm.queries import op12_curriculum
from tests.llm.helpers import DOCS

WEIGHTS = (3, 1, 2)
#: The total weight of each schedule by time x, and its share asked for by then.
ASKED = (lambda x: (4 * x - x * x) / 3, lambda x: x * x, lambda x: x)


def words(text):
    return len(re.findall("[^\x20\x09-\x0D]+", text or ""))


def targets(sizes, weights, budget=Fraction(3, 2), most=2):
    """Share by weight, cap, and share the excess again."""
    left, open_, given = budget * sum(sizes), set(range(len(sizes))), {}
    while open_:
        unit = Fraction(left, sum(weights[s] for s in open_))
        above = {s for s in open_ if unit * weights[s] > most * sizes[s]}
        if not above:
            return {**given, **{s: unit * weights[s] for s in open_}}
        given |= {s: Fraction(most * sizes[s]) for s in above}
        left -= sum(most * sizes[s] for s in above)
        open_ -= above
    return given


def brute(rows):
    """Per document (doc_id, size, source_size, target, taken), and all taken (time, source, place, turn, words)."""
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is None, (s or "").encode()))
    by = {s: sorted(((r[0], words(r[1])) for r in rows if r[3] == s),
                    key=lambda d: (d[0] is not None, hashlib.md5(str(d[0]).encode()).hexdigest(), d)) for s in sources}
    sizes = [sum(n for _, n in by[s]) for s in sources]
    want = targets(sizes, [WEIGHTS[k % 3] for k in range(len(sources))])
    out, taken = [], []
    for k, source in enumerate(sources):
        demand = math.floor(want[k])
        place = [0] * len(by[source])
        start = 0
        for turn in range(2):
            for i, (_, n) in enumerate(by[source]):
                now = max(0, min(n, demand - start))
                if now:
                    taken.append((start / demand, k, i, turn, now))
                place[i] += now
                start += n
        out += [(d, n, sizes[k], float(want[k]), t) for (d, n), t in zip(by[source], place)]
    return sorted(out, key=str), taken


COLUMNS = ["doc_id", "size", "source_size", "target", "taken"]


def agrees(df, rows):
    got = df.collect()
    want, taken = brute(rows)
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got), key=str) == want
    assert sum(r.taken for r in got) == sum(t[-1] for t in taken)
    assert all((r.first_token is None) == (r.taken == 0) and r.taken <= 2 * r.size for r in got)


def test_whole_table_equals_plain_version(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    agrees(op12_curriculum(spark, sf_dir), rows)


def table(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def some(sizes, seed=3):
    r = random.Random(seed)
    return [(s * 1000 + i, " ".join("w" * 2 for _ in range(r.choice([0, 1, 5, 40]))), "en", f"s{s:02}", 1) for s, n in enumerate(sizes) for i in range(n)]


@pytest.mark.parametrize("sizes", [[], [1], [0, 9], [400, 3, 3, 3], [5] * 12, [1, 300, 300, 1]])
def test_targets_of_all_shapes(spark, sizes):
    rows = some(sizes)
    random.Random(1).shuffle(rows)
    agrees(per_document(mix(table(spark, rows), _schedules())), rows)


def _schedules():
    return (Schedule(((0, 4), (1, 2))), Schedule(((0, 0), (1, 2))), Schedule(((0, 2), (1, 2))))


def test_nulls_ties_repeats_and_clashing_columns(spark):
    rows = [(i, t, None, s, None) for s in (None, "", "é", "z", "\U0001F600") for i, t in (
        (None, None), (None, "a b"), (7, "c\x0bd\te f"), (7, "c\x0bd\te f"), (7, "x"), (-3, "w " * 3000), (8, ""))]
    given = table(spark, rows).withColumns({"size": F.lit("x"), "_t": F.lit(1), "turn": F.lit(2), "time": F.lit(3), "_run": F.lit(4)})
    agrees(per_document(mix(given, _schedules())), rows)


def test_reruns_and_layouts_agree(spark):
    docs = table(spark, some([50, 20, 30]))
    first = sorted(map(tuple, mix(docs.repartition(3), _schedules(), carry=["text"]).collect()), key=str)
    assert first == sorted(map(tuple, mix(docs.orderBy(F.desc("doc_id")), _schedules(), carry=["text"]).collect()), key=str)


def test_positions_follow_the_schedules(spark, tmp_path):
    """Places ascend with time, offsets are gapless, and by any time each source has been asked for its share."""
    docs = table(spark, [(s * 1000 + i, "w w w", "en", f"s{s}", 1) for s in range(3) for i in range(400)])
    mixed = mix(docs, _schedules(), carry=["source"])
    rows = sorted(mixed.collect(), key=lambda r: r.place)
    assert [r.place for r in rows] == list(range(len(rows)))
    taken = [r for r in rows if r.words]
    assert rows[: len(taken)] == taken and [r.time for r in taken] == sorted(r.time for r in taken)
    start = 0
    for r in taken:
        assert r.token_start == start
        start += r.words
    for k in range(3):
        own = [r for r in taken if r.row_source == k]
        demand = math.floor(own[0].target)
        for number, r in enumerate(own):
            assert ASKED[k](r.time) == pytest.approx(3 * number / demand, abs=1e-9)
    curriculum.write(mixed, str(tmp_path / "mix"))
    places = []
    for file in sorted((tmp_path / "mix").glob("*.parquet")):
        places += [r.place for r in spark.read.parquet(str(file)).collect()]
    assert places == [r.place for r in taken]


def test_schedules_of_several_pieces(spark):
    schedule = Schedule(((0, 1), (0.25, 1), (0.5, 0), (0.75, 0), (1, 4)))
    shares = [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.8, 0.99, 1.0]
    found = spark.createDataFrame([(s,) for s in shares], "s double").select("s", schedule.time_of(F.col("s")).alias("t")).collect()
    for share, time in found:
        steps = 20000
        weight = lambda x: next(v + (w - v) * (x - a) / (b - a) for (a, v), (b, w) in zip(schedule.knots, schedule.knots[1:]) if x <= b)
        area = sum(weight((i + 0.5) * time / steps) for i in range(steps)) * time / steps
        assert area / float(schedule.weight) == pytest.approx(share, abs=1e-6)
    for bad in (((0, 1),), ((0, 0), (1, 0)), ((0, -1), (1, 2)), ((0, 1), (0.9, 1))):
        with pytest.raises(ValueError):
            Schedule(bad)
