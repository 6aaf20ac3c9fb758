"""Trills, string choice and agreement of methods against plain loops."""

import math
import random

import pytest

from notelake.operators import chained as ch
from notelake.operators import fingering as fing
from notelake.operators import techniques as tq


def curve(rng, n):
    base, step, every = rng.uniform(45, 80), rng.choice([0.4, 1, 1.5, 2, 3, 3.4, 5]), rng.choice([1, 2, 3, 5])
    return [0.0 if rng.random() < 0.05 else base + (step if i // every % 2 else 0) + rng.gauss(0, 0.05) + rng.choice([0] * 14 + [-0.9, 0.9]) for i in range(n)]


def plain_trill(xs, dur, fret):
    v = [x for x in xs if x > 0]
    if len(v) < 15 or dur < 0.25 or max(v) == min(v):
        return None
    low, high = min(v), max(v)
    n = max(int((high - low) / 0.25) + 1, 4)
    hist = [0] * n
    for x in v:
        hist[min(int((x - low) / (high - low) * n), n - 1)] += 1
    w = [math.exp(-2 * k * k) for k in range(-2, 3)]
    padded = hist[1::-1] + hist + hist[:-3:-1]
    s = [round(sum(a * b for a, b in zip(w, padded[i:i + 5], strict=True)) / sum(w), 9) for i in range(n)]
    tops, i = [], 1
    while i < n - 1:
        j = i
        while j + 1 < n and s[j + 1] == s[i]:
            j += 1
        if s[i - 1] < s[i] and j + 1 < n and s[j + 1] < s[i] and s[i] >= 0.25 * max(s):
            tops.append((s[i], (i + j) // 2))
        i = j + 1
    if len(tops) < 2:
        return None
    (_, a), (_, b) = sorted(tops)[-2:]
    interval = abs(a - b) * (high - low) / n
    mean = sum(v) / len(v)
    sides = [(x > 0) - (x < 0) for x in (round(x - mean, 9) for x in v)]
    rate = sum(p != q for p, q in zip(sides, sides[1:], strict=False)) / dur
    if not (0.8 <= round(interval, 9) <= 3.5 and 10 <= rate <= 35):
        return None
    return round(interval, 6), round(rate, 6), fret + round(round(interval, 9)), round(min(1.0, rate / 20), 6)


@pytest.mark.parametrize("width", [7, 4096])
def test_trills(spark, width):
    rng = random.Random(2)
    curves, notes, want = [], [], {}
    for note in range(120):
        n = rng.choice([10, 20, 40, 80])
        xs, dur = curve(rng, n), n * 0.02
        curves += [(note % 3, note, note * 100 + i, x) for i, x in enumerate(xs)]
        notes.append((note % 3, note, round(dur * 1e6), 7))
        if found := plain_trill(xs, dur, 7):
            want[note] = found
    got = tq.trills(spark.createDataFrame(curves, "track_id long, note_id long, frame long, pitch double").repartition(5),
                    spark.createDataFrame(notes, "track_id long, note_id long, dur_us long, fret int"), width).collect()
    assert {r.note_id: (round(r.interval, 6), round(r.rate, 6), r.target_fret, round(r.confidence, 6)) for r in got} == want and len(want) > 10


def plain_strings(rows):
    out, opens = {}, [40, 45, 50, 55, 59, 64]
    cent = [(200, 600), (300, 800), (400, 1000), (600, 1400), (800, 1800), (1000, 2500)]
    band = [(100, 400), (150, 500), (200, 600), (300, 800), (400, 1000), (500, 1200)]
    gauss = lambda x, low, high: math.exp(-0.5 * ((x - (low + high) / 2) / (high - low)) ** 2)
    for track in {r[0] for r in rows}:
        before = None
        for _, note, _, midi, look in sorted((r for r in rows if r[0] == track), key=lambda r: (r[2], r[1])):
            places = [(s, midi - m) for s, m in enumerate(opens) if 0 <= midi - m <= 24]
            if not places:
                out[note] = (-1, -1, 0.0, "none")
                continue
            if len(places) == 1:
                out[note] = (*places[0], 0.95, "unique")
            else:
                scored = []
                for s, f in places:
                    total = 0.0
                    if look:
                        c, b, a, u = look
                        total += 0.35 * gauss(c, *(x * (1 + f * 0.02) for x in cent[s])) + 0.15 * gauss(b, *(x * (1 - f * 0.01) for x in band[s]))
                        total += 0.2 * math.exp(-2 * ((a / u if u > 0 else 1.0) - (1.3 - 0.05 * s)) ** 2)
                    ease = 1.1 if f <= 5 else 1.0 if f <= 12 else 0.85
                    if before:
                        far, across = abs(f - before[1]), abs(s - before[0])
                        ease *= (0.7 if far > 5 else 0.85 if far > 3 else 1) * (0.8 if across > 2 else 0.9 if across > 1 else 1)
                    scored.append((total + 0.3 * ease, (s, f)))
                ranked = sorted(scored, key=lambda x: -x[0])
                out[note] = (*ranked[0][1], max(0.3, min(0.95, 0.5 + (ranked[0][0] - ranked[1][0]) * 2)), "spectral")
            if out[note][2] > 0.5:
                before = out[note][:2]
    return out


@pytest.mark.parametrize("block", [3, 64])
def test_string_choice(spark, block):
    rng = random.Random(4)
    rows = []
    for note in range(200):
        look = (rng.uniform(200, 2500), rng.uniform(100, 1200), rng.uniform(300, 2000), rng.choice([0.0, rng.uniform(300, 2000)])) if rng.random() < 0.8 else None
        rows.append((note % 3, note, note * 90_000, rng.randrange(34, 92), look))
    notes = spark.createDataFrame([r[:4] for r in rows], "track_id long, note_id long, start_us long, midi int").repartition(3)
    shapes = spark.createDataFrame([(r[0], r[1], *r[4]) for r in rows if r[4]], "track_id long, note_id long, centroid double, bandwidth double, attack double, sustain double")
    got = {r.note_id: (r.string, r.fret, round(r.confidence, 9), r.method) for r in fing.score_strings(notes, shapes, width=700_000, block=block).collect()}
    assert got == {n: (s, f, round(c, 9), m) for n, (s, f, c, m) in plain_strings(rows).items()}


def plain_groups(rows, order):
    groups, member = {}, {}
    for method in order:
        for track, note, t, midi, _ in sorted((r for r in rows if r[4] == method), key=lambda r: (r[0], r[2], r[1])):
            for key, (k_track, k_t, k_midi) in groups.items():
                if k_track == track and abs(k_t - t) <= 50_000 and abs(k_midi - midi) <= 1:
                    member[note] = key
                    break
            else:
                groups[note] = (track, t, midi)
                member[note] = note
    return member


@pytest.mark.parametrize("width", [120_000, 10_000_000])
def test_agreement_of_methods(spark, width):
    rng = random.Random(5)
    rows = [(n % 2, n, rng.randrange(0, 2_000_000) // 10_000 * 10_000, rng.choice([60, 60, 61, 62, 63, 70]), rng.choice(["yin", "hps", "cqt", "other"])) for n in range(500)]
    df = spark.createDataFrame(rows, "track_id long, note_id long, start_us long, midi int, method string").repartition(4)
    order = ["hps", "yin", "cqt"]
    want = plain_groups(rows, order)
    got = {r.note_id: r.group for r in ch.agreement_groups(df, order, width=width).collect()}
    assert got == want and len(set(want.values())) < len(want)
    agreed = ch.method_agreement(df, order, width=width)
    names = {}
    for note, group in want.items():
        names.setdefault(group, set()).add(rows[note][4])
    assert {r.group: r.methods for r in agreed.collect()} == {g: ", ".join(sorted(m)) for g, m in names.items()}
    assert sum(r.n_groups for r in ch.agreement_counts(agreed).collect()) == len(names)


def test_agreement_of_short_islands_is_that_of_the_rounds(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(n % 4, n, rng.randrange(0, 8_000_000) // 10_000 * 10_000, rng.choice([60, 60, 61, 62, 63]), rng.choice(["yin", "hps", "cqt"])) for n in range(400)]
    odd = [(4, 1000 + n // 2 * (n % 3), 20_000 * n, 60 + n % 3 if n % 7 else None, ["yin", "hps"][n % 2]) for n in range(40)] + [(4, None, 5_000, 61, "yin"), (None, 7, 5, 60, "yin"), (5, 8, None, 60, "yin")]
    kind = "track_id long, note_id long, start_us long, midi int, method string"
    order = ["hps", "yin", "cqt"]
    found = lambda df, **how: sorted(map(repr, ch.agreement_groups(df, order, width=700_000, **how).collect()))
    every = spark.createDataFrame(rows + odd, kind).repartition(4)
    assert found(every) == found(every, short=0) == found(every, short=20)
    # where all islands are short there are no rounds
    clean = spark.createDataFrame(rows, kind).repartition(4)
    want = plain_groups(rows, order)
    monkeypatch.setattr(ch, "fold_islands", None)
    assert {r.note_id: r.group for r in ch.agreement_groups(clean, order, width=700_000).collect()} == want


def test_trill_tops_of_a_wide_histogram():
    # 1200 quarter semitones: the tops are found in one go over the histogram, not by searching it anew from every bin
    assert tq._two_tops(1200, [10, 700, 1199], [9, 4, 10]) == (10, 700)  # the highest one, at the end, is no top
    assert tq._two_tops(1200, [10, 700], [9, 1]) is None
