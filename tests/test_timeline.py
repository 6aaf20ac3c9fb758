"""Sliced computations against plain Python on small tables, with slices short enough to cut everywhere."""

import random

import pytest
from pyspark.sql import functions as F

from notelake.operators import timeline as tl
from notelake.operators.segment import frame_runs


def times(seed, n=300, tracks=3, step=40):
    rng = random.Random(seed)
    rows = []
    for k in range(tracks):
        t = 0
        for i in range(n):
            t += rng.choice([0, 1, 5, 10, step])
            rows.append((k, k * 1000 + i, t, rng.randrange(50, 60)))
    return rows


def table(spark, rows):
    return spark.createDataFrame(rows, "track_id long, id long, t long, midi int")


@pytest.mark.parametrize("width", [25, 100, 10_000])
def test_running_matches_a_walk(spark, width):
    rows = times(1)
    out = tl.running(
        table(spark, rows), ["t", "id"], width, total=tl.Run("sum", F.col("midi")), top=tl.Run("max", F.col("midi"), inclusive=False),
        prev=tl.previous("id"), nxt=tl.following("id"), odd=tl.Run("last", F.when(F.col("midi") % 2 == 1, F.col("id")), inclusive=False))
    got = {(r.track_id, r.id): (r.total, r.top, r.prev and r.prev.id, r.nxt and r.nxt.id, r.odd) for r in out.collect()}
    for k in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == k), key=lambda r: (r[2], r[1]))
        total, top, odd = 0, None, None
        for i, r in enumerate(mine):
            total += r[3]
            want = (total, top, mine[i - 1][1] if i else None, mine[i + 1][1] if i + 1 < len(mine) else None, odd)
            assert got[(k, r[1])] == want
            top = r[3] if top is None else max(top, r[3])
            odd = r[1] if r[3] % 2 else odd


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("seed", range(3))
def test_anchored_groups_do_not_depend_on_slices(spark, seed, strict):
    rows = times(seed, step=12)
    want = {}
    for k in {r[0] for r in rows}:
        anchor = None
        for t in sorted({r[2] for r in rows if r[0] == k}):
            if anchor is None or (t - anchor >= 30 if strict else t - anchor > 30):
                anchor = t
            want[(k, t)] = anchor
    for width in (61, 200, 100_000):
        got = {(r.track_id, r.t): r.anchor_t for r in tl.anchor_times(table(spark, rows), 30, "t", width, strict=strict).collect()}
        assert got == want, width


@pytest.mark.parametrize("tol", [1, 2])
def test_drift_runs_do_not_depend_on_slices(spark, tol):
    rng = random.Random(tol)
    rows, v = [], 60
    for f in range(600):
        v += rng.choice([-1, 0, 0, 1])
        if rng.random() > 0.04:
            rows.append((1, f, v))
    want, anchor, start, last = {}, None, None, None
    for _, f, v in rows:
        if anchor is None or f - last > 1 or abs(v - anchor) > tol:
            anchor, start = v, f
        want[f], last = start, f
    df = spark.createDataFrame(rows, "track_id long, frame long, midi int")
    for width in (3, 16, 4096):
        assert {r.frame: r.run_frame for r in tl.drift_runs(df, tol, width=width).collect()} == want, width


def test_gap_groups_and_frame_runs(spark):
    rows = times(4)
    want = {}
    for k in {r[0] for r in rows}:
        last, start = None, None
        for r in sorted((r for r in rows if r[0] == k), key=lambda r: (r[2], r[1])):
            if last is None or r[2] - last > 10:
                start = (r[2], r[1])
            want[r[1]], last = start, r[2]
    for width in (11, 77, 10_000):
        got = tl.group_gap(table(spark, rows), 10, "t", "id", width)
        assert {r.id: (r.grp_t, r.grp_id) for r in got.collect()} == want
    frames = spark.createDataFrame([(1, f, f // 7) for f in range(100) if f % 10], "track_id long, frame long, midi long")
    runs = {r.frame: r.run_frame for r in frame_runs(frames, ["midi"], width=4).collect()}
    assert runs[8] == 7 and runs[11] == 11 and runs[13] == 11 and runs[14] == 14 and runs[21] == 21


def test_interval_groups_and_quantile(spark):
    rng = random.Random(9)
    rows = [(1, i, rng.randrange(5000), rng.randrange(1, 60)) for i in range(200)]
    df = spark.createDataFrame(rows, "track_id long, id long, s long, d long").withColumn("e", F.col("s") + F.col("d"))
    want, reach, start = {}, None, None
    for _, i, s, d in sorted(rows, key=lambda r: (r[2], r[1])):
        if reach is None or s > reach + 5:
            start = i
        want[i], reach = start, max(reach or 0, s + d)
    got = tl.interval_groups(df, "s", "e", "id", 5, width=100)
    assert {r.id: r.grp_id for r in got.collect()} == want
    values = sorted(r[3] for r in rows)
    for q in (0.0, 0.05, 0.5, 1.0):
        at = q * (len(values) - 1)
        low = int(at)
        exact = values[low] + (values[min(low + 1, len(values) - 1)] - values[low]) * (at - low)
        assert tl.group_quantile(df, ["track_id"], "d", q, 7.0).first().quantile == pytest.approx(exact)


def test_range_join_borders(spark):
    left = spark.createDataFrame([(1, 0), (1, 50), (1, 100)], "track_id long, a long")
    right = spark.createDataFrame([(1, 50), (1, 51), (1, 99), (2, 50)], "track_id long, b long")
    got = sorted((r.a, r.b) for r in tl.range_join(left, right, "a", "b", 1, 50).collect())
    assert got == [(0, 50), (50, 50), (50, 51), (50, 99), (100, 99)]


def test_empty_and_single_row(spark):
    empty = table(spark, [])
    assert tl.anchor_times(empty, 30, "t").count() == 0 and tl.running(empty, ["t", "id"], x=tl.previous("id")).count() == 0
    one = table(spark, [(1, 1, 5, 60)])
    assert [tuple(r) for r in tl.anchor_times(one, 30, "t").collect()] == [(1, 5, 5)]
