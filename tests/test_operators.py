"""Operators with choices that depend on earlier choices, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from notelake.functions import scalars as sc
from notelake.functions.dims import tuning_notes
from notelake.operators import matching as mt
from notelake.operators import positions as pos
from notelake.operators import spectral as sp
from notelake.operators import theory as th


def notes(seed, n=150, span=4000):
    rng = random.Random(seed)
    return sorted((1, i, rng.randrange(span), rng.randrange(10, 80), rng.randrange(40, 89)) for i in range(n))


NOTES = "track_id long, note_id long, start_us long, dur_us long, midi int"


def test_matching_is_the_greedy_one(spark):
    rng = random.Random(3)
    det = [(1, i, rng.randrange(3000), 100, rng.choice([60, 61])) for i in range(120)]
    tru = [(1, i, rng.randrange(3000), 100, rng.choice([60, 61])) for i in range(120)]
    used, want = set(), {}
    for _, i, s, _, m in sorted(tru, key=lambda r: (r[2], r[1])):
        best = min(((abs(d[2] - s), d[2], d[1]) for d in det if d[4] == m and abs(d[2] - s) <= 50 and d[1] not in used), default=None)
        if best:
            used.add(best[2])
            want[i] = best[2]
    truth = spark.createDataFrame(tru, NOTES).withColumnRenamed("note_id", "truth_id")
    got = mt.match_truth(truth, spark.createDataFrame(det, NOTES), 50, 0.0)
    rows = {r.truth_id: r.note_id for r in got.collect()}
    assert rows == want and len(set(rows.values())) == len(rows)
    # found and missed add up to the truth
    assert len(rows) + mt.unmatched(truth, got, ["track_id", "truth_id"]).count() == len(tru)


def test_sweep_meets_notes_once_and_copies_only_pairs(spark, monkeypatch):
    rng = random.Random(8)
    cuts = [0.2, 0.5, 0.8]
    det = [(1 + i % 2, i, rng.randrange(3000), 100, 60 + i % 2, rng.choice([0.1, 0.3, 0.6, 0.9, None]), rng.choice(["a", "b", None])) for i in range(160)]
    tru = [(1 + i % 2, i, rng.randrange(3000), 100, 60 + i % 2) for i in range(90)]
    seen = []
    plain = mt.range_join

    def watched(left, right, *rest, **named):
        seen.append((left.count(), right.count()))
        return plain(left, right, *rest, **named)

    monkeypatch.setattr(mt, "range_join", watched)
    truth = spark.createDataFrame(tru, NOTES).withColumnRenamed("note_id", "truth_id")
    detected = spark.createDataFrame(det, NOTES + ", confidence double, method string")
    got = {(r.method, r.cut): (r.n_truth, r.n_det, r.tp) for r in mt.sweep_best(truth, detected, cuts, 50).collect()}
    want = {}
    for method in "ab":
        for cut in cuts:
            mine, used = [d for d in det if d[6] == method and d[5] is not None and d[5] >= cut], set()
            for track, _, s, _, m in sorted(tru, key=lambda r: (r[2], r[1])):
                best = min(((abs(d[2] - s), d[2], d[1]) for d in mine if d[0] == track and d[4] == m and abs(d[2] - s) <= 50 and d[1] not in used), default=None)
                used |= {best[2]} if best else set()
            want[method, cut] = (len(tru), len(mine), len(used))
    assert got == want and seen == [(len(tru), len(det))]
    assert mt.sweep_best(truth.limit(0), detected, cuts).count() == 0


def test_density_needs_no_join_and_no_large_task(spark):
    from notelake.operators import windows as win
    rng = random.Random(4)
    sizes = {1: 1, 2: 2, 3: 9, 4: 70, 5: 131}
    frames = [(k, f) for k, n in sizes.items() for f in range(n) if n < 20 or f % 13 != 7]
    onsets = [r for r in frames if rng.random() < 0.4] + [(4, 7), (9, 1), (3, 2), (3, 2), (None, 1), (4, None)]
    schema = "track_id long, frame long"
    out = win.note_density(spark.createDataFrame(frames, schema), spark.createDataFrame(onsets, schema), 8, width=16)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Repartition" in plan
    got = {(r.track_id, r.frame): r.density for r in out.collect()}
    want = {}
    for k, n in sizes.items():
        mine = [f for t, f in frames if t == k]
        raw = {f: sum((k, g) in onsets for g in mine if f - 4 <= g <= f + 3) / ((min(n, f + 4) - max(0, f - 4)) * 0.02322) for f in mine}
        slots = [(f, raw[f]) for f in mine] + [(-1 - f, raw[f]) for f in mine if f < 2] + [(2 * n - 1 - f, raw[f]) for f in mine if f >= n - 2]
        for f in mine:
            near = [x for g, x in slots if abs(g - f) <= 2]
            want[k, f] = sum(near) / len(near)
    assert got == pytest.approx(want)


@pytest.mark.parametrize("policy", ["basic", "heuristic"])
def test_positions_do_not_depend_on_slices(spark, policy):
    rows = notes(5)
    tuning = tuning_notes("standard")
    want, prev = {}, None
    for _, i, _, _, m in sorted(rows, key=lambda r: (r[2], r[1])):
        options = [(s, m - o) for s, o in enumerate(tuning) if 0 <= m - o <= 24]
        if not options:
            continue

        def score(o):
            s, f = o
            x = (3 if f <= 5 else 1 if f <= 12 else 0) - f * 0.2 + [0.5, 0.8, 1.0, 1.0, 0.8, 0.5][s] * 3
            if prev:
                jump, cross = abs(f - prev[1]), abs(s - prev[0])
                x -= (jump * (0.5 if jump > 4 else 0.2) + cross * 0.8) if policy == "basic" else jump * 0.3 + cross * 0.5
            return round(x, 9)

        prev = options[0] if len(options) == 1 else max(options, key=lambda o: (score(o), o[0], o[1]))
        want[i] = prev
    for width in (60, 700, 100_000):
        got = pos.assign_positions(spark.createDataFrame(rows, NOTES), policy, width=width)
        assert {r.note_id: (r.string, r.fret) for r in got.collect()} == want, width


def test_spaced_peaks(spark):
    rng = random.Random(8)
    curve = [rng.randrange(6) / 5 for _ in range(200)]
    peaks, i = [], 1
    while i < len(curve) - 1:
        j = i
        while j + 1 < len(curve) and curve[j + 1] == curve[i]:
            j += 1
        if j + 1 < len(curve) and curve[i - 1] < curve[i] > curve[j + 1] and curve[i] >= 0.3:
            peaks.append((i + j) // 2)
        i = j + 1
    kept = []
    for p in sorted(peaks, key=lambda p: (curve[p], p), reverse=True):
        if all(abs(p - k) >= 7 for k in kept):
            kept.append(p)
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(curve)], "track_id long, frame long, v double")
    for width in (10, 1000):
        assert sorted(r.frame for r in sp.peak_pick(df, "v", 0.3, 7, width=width).collect()) == sorted(kept)


def test_frame_peaks_and_candidates(spark):
    mags = [0.0, 0.2, 1.0, 0.1, 0.9, 0.1, 0.5, 0.1, 0.8, 0.0, 0.3, 0.0]
    spec = spark.createDataFrame([(1, 0, mags)], "track_id long, frame long, mags array<double>")
    # peaks 2, 4, 6, 8, 10; from the highest with spacing 3: 2, then 8, then 5 is none, 4 and 6 and 10 are too near
    assert sp.polyphony(spec, 0, 12, 0.2, 3).first().n == 2
    got = sp.spectral_candidates(spec, 100, 1100, 0.1, 12, 100.0).orderBy("pos").collect()
    # 200 Hz is MIDI 55; 400 and 800 are octaves above it, 600 is 19 above, 1000 is 28 above and stays
    assert [(r.midi, r.frequency) for r in got] == [(55, 200.0), (83, 1000.0)]


def plain_peaks(xs):
    out, i = [], 1
    while i < len(xs) - 1:
        j = i
        while j + 1 < len(xs) and xs[j + 1] == xs[i]:
            j += 1
        if xs[i - 1] < xs[i] and j + 1 < len(xs) and xs[j + 1] < xs[i]:
            out.append(((i + j) // 2 + 1, xs[i]))
        i = j + 1
    return out


def test_even_tops_count_once(spark):
    rng = random.Random(3)
    lists = [[float(rng.randrange(4)) for _ in range(rng.randrange(12))] for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(lists)), "k long, xs array<double>").repartition(3)
    got = {r.k: [(p.i, p.m) for p in r.ps] for r in df.select("k", sp.array_peaks(F.col("xs")).alias("ps")).collect()}
    assert got == {k: plain_peaks(xs) for k, xs in enumerate(lists)}
    spec = spark.createDataFrame([(1, 0, [0.0, 1.0, 1.0, 1.0, 0.0, 0.5, 0.0]), (1, 1, [0.0, 0.0, 1e-4, 0.9, 0.0, 0.0, 0.0])], "track_id long, frame long, mags array<double>")
    assert {r.frame: r.n for r in sp.polyphony(spec, 0, 7, 0.2, 2).collect()} == {0: 2, 1: 1}
    rows = [(r.frame, r.frequency, round(r.level, 3), round(r.confidence, 3)) for r in sp.level_candidates(spec, 50, 1000, hz_step=100.0).orderBy("frame", "pos").collect()]
    assert rows == [(1, 300.0, -0.915, 1.0)]  # in frame 0 the bins above the threshold begin with the even top, which is no peak then


def test_key_scale_and_text(spark):
    scale = [(1, i, i * 100, 100, m) for i, m in enumerate([60, 62, 64, 65, 67, 69, 71, 60, 67, 64])]
    flat = [(2, 100 + i, i, 100, 60 + i) for i in range(12)]
    got = {r.track_id: (r.root, r["mode"], r.confidence) for r in th.detect_key(spark.createDataFrame(scale + flat, NOTES)).collect()}
    assert got[1][:2] == (0, "major") and got[2] == (0, "major", 0.0)
    row = spark.createDataFrame([("F#3", "Bbm", "C major", "H9")], "a string, b string, c string, d string").select(
        sc.parse_note("a").alias("a"), sc.parse_key("b").alias("b"), sc.parse_key("c").alias("c"), sc.parse_note("d").alias("d")).first()
    assert row.a == 54 and tuple(row.b) == (10, "minor") and tuple(row.c) == (0, "major") and row.d is None
    # a tie goes to the lower pitch class number: F# in C major goes down to F
    assert th.snap_shift(6, [0, 2, 4, 5, 7, 9, 11], "nearest") == -1 and th.snap_shift(6, [0, 2, 4, 5, 7, 9, 11], "up") == 1
    # a note exactly between two grid lines goes to the even one
    half = spark.range(1).select(sc.quantize_us(F.lit(62_500), 120).alias("a"), sc.quantize_us(F.lit(187_500), 120).alias("b")).first()
    assert (half.a, half.b) == (0.0, 250_000.0)


def test_unknown_tuning():
    assert tuning_notes("40, 45,50,55,59,64") == tuning_notes("standard")
    with pytest.raises(ValueError):
        tuning_notes("banjo")
