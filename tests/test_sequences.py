"""Licks, island folds and the decoder against brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from notelake.operators import chained as ch
from notelake.operators import decode as dec
from notelake.operators import licks as lk
from notelake.operators.sequence import library


def melody(seed, n=70):
    rng = random.Random(seed)
    out, t, m = [], 0, 60
    for i in range(n):
        t += rng.randrange(50, 300)
        m = min(72, max(60, m + rng.choice([-3, -2, -2, 2, 2, 3, 0])))
        out.append((1, i, t, rng.randrange(20, 500), m, round(rng.random(), 2)))
    return out


SCHEMA = "track_id long, note_id long, start_us long, dur_us long, midi int, confidence double"


def test_licks(spark):
    rows = melody(2)
    midi = [r[4] for r in rows]
    found = []
    for start in range(len(midi) - 3):
        for o, (_, steps) in enumerate(library()):
            if len(steps) < 4:
                continue
            heard = [m - midi[start] for m in midi[start:start + len(steps) + 2]]
            used, hits = set(), []
            for p in steps:
                best = min(((abs(d - p), i) for i, d in enumerate(heard) if abs(d - p) <= 1 and i not in used), default=None)
                if best:
                    used.add(best[1])
                    hits.append(best[1])
            score = len(hits) / len(steps)
            if score >= 0.7:
                places = {next(k for k, p in enumerate(steps) if abs(heard[i] - p) <= 1) for i in hits}
                found.append((round(score * (1 - (len(steps) - len(places)) / len(steps) * 0.3), 9), -start, -o, start + len(heard)))
    kept, taken = [], set()
    for c, s, o, stop in sorted(found, reverse=True):
        span = set(range(-s, stop))
        if not span & taken:
            taken |= span
            kept.append((-s, stop, -o, c))
    df = spark.createDataFrame(rows, SCHEMA)
    raw = lk.lick_matches(df, 0.7, width=1000, block=16)
    assert raw.count() == len(found)
    got = [(r["first"], r["last"], r["ord"], round(r["confidence"], 9)) for r in lk.resolve_overlaps(raw).collect()]
    assert sorted(got) == sorted(kept) and kept


def surest_lick(midi, threshold=0.7):
    """(confidence, start, number, steps, score, missing) of the best lick in one phrase by plain loops."""
    best = None
    for start in range(len(midi) - 3):
        for o, (_, steps) in enumerate(library()):
            if len(steps) < 4:
                continue
            heard = [m - midi[start] for m in midi[start:start + len(steps) + 2]]
            hits = []
            for p in steps:
                near = min(((abs(d - p), i) for i, d in enumerate(heard) if abs(d - p) <= 1 and i not in hits), default=None)
                if near:
                    hits.append(near[1])
            if len(hits) / len(steps) >= threshold:
                places = {next(k for k, p in enumerate(steps) if abs(heard[i] - p) <= 1) for i in hits}
                lacks = [midi[start] + p for k, p in enumerate(steps) if k not in places]
                score = len(hits) / len(steps)
                found = (round(score * (1 - len(lacks) / len(steps) * 0.3), 9), -start, -o, steps, score, lacks)
                best = max(best, found, key=lambda x: x[:3]) if best else found
    return best


@pytest.mark.parametrize("width,block", [(1000, 16), (10**7, 4096)])
def test_licks_by_phrase_equal_plain_loops(spark, width, block):
    rows = [r[:4] + (r[4] + (12 if r[1] % 6 == 4 else 0),) + r[5:] for r in melody(7)]
    at = max(r[2] + r[3] for r in rows) + 500
    rows += [(1, 1000 + i, at + 100 * i, 90, m, 0.5) for i, m in enumerate([60, 63, 77, 67, 70, 72])]  # the third note an octave up
    parts, end = [], None
    for n, r in enumerate(rows):
        if end is None or r[2] - end > 60:
            parts.append((n, []))
        parts[-1][1].append(r)
        end = r[2] + r[3]
    want, moved = [], {r[1]: (r[4], r[5]) for r in rows}
    for first, part in parts:
        best = surest_lick([r[4] for r in part]) if len(part) >= 4 else None
        if best:
            _, start, o, steps, score, lacks = best
            root = part[-start][4]
            want.append((first, len(part), part[0][2], part[-1][2] + part[-1][3], first - start, -o, round(score, 9), lacks))
            for r, p in zip(part, steps, strict=False):
                if abs(r[4] - (root + p)) == 12:
                    moved[r[1]] = (root + p, r[5] * 0.9)
    phrases = lk.numbered_phrases(spark.createDataFrame(rows, SCHEMA), 60, width)
    licks = lk.phrase_licks(phrases, width=width, block=block)
    got = [(r["phrase"], r["n_notes"], r["start_us"], r["end_us"], r["first"], r["ord"], round(r["score"], 9), r["missing"]) for r in licks.collect()]
    assert len(want) > 3 and sorted(got) == sorted(want)
    corrected = lk.corrected_phrases(phrases, licks)
    out = {r["note_id"]: (r["midi"], r["confidence"]) for r in corrected.collect()}
    assert out == moved and any(moved[r[1]][0] != r[4] for r in rows)
    total = lk.lick_coverage(corrected, licks).collect()
    changes = sum(moved[r[1]][0] != r[4] for r in rows) + sum(bool(w[7]) for w in want)
    assert [tuple(r)[:4] for r in total] == [(1, len(rows), len(want), changes)] and total[0]["coverage"] == pytest.approx(sum(w[1] for w in want) / len(rows))


@pytest.mark.parametrize("width", [400, 3000, 10**6])
def test_overlap_folds_do_not_depend_on_slices(spark, width):
    rows = melody(4, 120)
    want = []
    for _, i, s, d, m, c in rows:
        note = [i, s, s + d, m, c]
        if want and min(want[-1][2], note[2]) - max(want[-1][1], s) > 0:
            last = want[-1]
            if last[3] == m:
                last[2], last[4] = max(last[2], note[2]), max(last[4], c)
            elif c > last[4]:
                want[-1] = note
        else:
            want.append(note)
    got = ch.dedupe_overlaps(spark.createDataFrame(rows, SCHEMA), width).orderBy("start_us").collect()
    assert [[r.note_id, r.start_us, r.end_us, r.midi, r.confidence] for r in got] == want


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    prior, trans, emit = np.log(rng.random(4)), np.log(rng.random((4, 4))), np.log(rng.random((5, 4)))
    path, total = dec.viterbi(prior, trans, emit)

    def value(p):
        return prior[p[0]] + sum(trans[a, b] for a, b in zip(p, p[1:])) + sum(emit[t, s] for t, s in enumerate(p))

    best = max(itertools.product(range(4), repeat=5), key=value)
    assert tuple(path) == best and total == pytest.approx(value(best))


def test_decoder_mends_an_octave_error(spark):
    frames = [(1, f, 440.0 if f != 5 else 880.0, 0.9) for f in range(12)]
    priors = spark.createDataFrame([(1, m, 1 / 49) for m in range(40, 89)], "track_id long, midi int, p double")
    stay = [(a, b, 0.9 if a == b else 0.1 / 48) for a in range(40, 89) for b in range(40, 89)]
    model = spark.createDataFrame(stay, "a int, b int, p double")
    df = spark.createDataFrame(frames, "track_id long, frame long, hz double, confidence double")
    got = dec.decode_hmm(df, priors, model, width=4).collect()
    assert {r.midi for r in got} == {69} and len(got) == 12
    notes = df.select("track_id", F.col("frame").alias("note_id"), (F.col("frame") * 1000).alias("start_us"), F.expr("if(hz > 500, 81, 69)").alias("midi"), "hz", "confidence")
    changed = [r.note_id for r in dec.refine_notes(notes, priors, model).filter("changed").collect()]
    assert changed == [5]


def test_decoder_slices_equal_one_plain_pass(spark):
    rng = np.random.default_rng(5)
    n = 3000
    rows = [(1, int(f), float(440 * 2 ** (rng.normal(0, 1))), float(rng.random())) for f in range(n)]  # no pause at all
    prior = rng.random(49)
    trans = rng.random((49, 49)) ** 4
    trans /= trans.sum(axis=1, keepdims=True)
    df = spark.createDataFrame(rows, "track_id long, frame long, hz double, confidence double")
    priors = spark.createDataFrame([(1, m + 40, float(p)) for m, p in enumerate(prior)], "track_id long, midi int, p double")
    model = spark.createDataFrame([(a + 40, b + 40, float(trans[a, b])) for a in range(49) for b in range(49)], "a int, b int, p double")
    emit = dec._emission(np.array([r[2] for r in rows]), np.array([r[3] for r in rows]))
    path, total = dec.viterbi(np.log(prior), np.log(np.maximum(trans, 1e-10)), emit)
    for width in (370, 5000):
        got = sorted(dec.decode_hmm(df, priors, model, width=width).collect(), key=lambda r: r.frame)
        assert [r.midi - 40 for r in got] == path.tolist()
        assert {r.first for r in got} == {0} and got[0].log_p == pytest.approx(total)


def test_decoder_works_on_many_tracks_in_few_calls(spark):
    """Tracks of one slice are decoded side by side: no grouped call per slice, and each gets the path of one plain pass; others may be of any length."""
    rng = np.random.default_rng(6)
    sizes = {k: int(n) for k, n in enumerate([1, 7, 7, 3, 90, 33, 64, 65, *rng.integers(1, 60, 90)])}
    rows = [(k, f, float(440 * 2 ** rng.normal(0, 1)), float(rng.random())) for k, n in sizes.items() for f in range(n)]
    trans = rng.random((49, 49)) ** 4
    df = spark.createDataFrame(rows, "track_id long, frame long, hz double, confidence double").repartition(3)
    prior = {k: rng.random(49) for k in sizes}
    priors = spark.createDataFrame([(k, m + 40, float(p)) for k, ps in prior.items() for m, p in enumerate(ps)], "track_id long, midi int, p double")
    model = spark.createDataFrame([(a + 40, b + 40, float(trans[a, b])) for a in range(49) for b in range(49)], "a int, b int, p double")
    out = dec.decode_hmm(df, priors, model, width=32)
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {}
    for r in sorted(out.collect(), key=lambda r: (r.track_id, r.frame)):
        got.setdefault(r.track_id, []).append((r.midi - 40, r.log_p))
    for k in sizes:
        mine = [r for r in rows if r[0] == k]
        emit = dec._emission(np.array([r[2] for r in mine]), np.array([r[3] for r in mine]))
        path, total = dec.viterbi(np.log(prior[k]), np.log(np.maximum(trans, 1e-10)), emit)
        assert [m for m, _ in got[k]] == path.tolist() and got[k][0][1] == pytest.approx(total)


def test_riffs_equal_a_plain_search(spark):
    rng = random.Random(9)
    tune = [(i, t, 60 + rng.choice([0, 2, 4])) for i, t in enumerate(sorted(rng.choices(range(0, 60_000_000, 500_000), k=70)))]
    df = spark.createDataFrame([(1, i, t, m) for i, t, m in tune], "track_id long, note_id long, start_us long, midi int")
    want, seen = [], set()
    for length in range(3, 9):
        for a in range(len(tune) - length + 1):
            steps = lambda k, n=length: [(tune[k + i + 1][2] - tune[k + i][2], tune[k + i + 1][1] - tune[k + i][1]) for i in range(n - 1)]
            found = [a] + [b for b in range(a + length, len(tune) - length + 1) if all(
                p == q and (t <= 0 or abs(u - t) * 10 <= t) for (p, t), (q, u) in zip(steps(a), steps(b), strict=True))]
            times = tuple(tune[k][1] for k in found)
            if len(found) > 1 and times not in seen:
                seen.add(times)
                want.append((a, length, len(found)))
    from notelake.operators.sequence import repeated_riffs
    got = repeated_riffs(df, 3, 8, block=16, width=7_000_000).collect()
    assert want and sorted((r["first"], r["length"], r["n"]) for r in got) == sorted(want)


def test_riffs_of_3_to_16_notes_equal_a_plain_search(spark):
    rng = random.Random(11)
    tune = [(500_000 * i, 60 + rng.choice([0, 2, 4])) for i in range(20)]
    tune = tune + [(t + 15_000_000, m) for t, m in tune] + [(40_000_000 + 700_000 * i, 60 + i % 2) for i in range(40)]
    df = spark.createDataFrame([(1, i, t, m) for i, (t, m) in enumerate(tune)], "track_id long, note_id long, start_us long, midi int")
    best = {}
    for length in range(3, 17):
        for a in range(len(tune) - length + 1):
            steps = lambda k, n=length: [(tune[k + i + 1][1] - tune[k + i][1], tune[k + i + 1][0] - tune[k + i][0]) for i in range(n - 1)]
            found = [a] + [b for b in range(a + length, len(tune) - length + 1) if all(
                p == q and (t <= 0 or abs(u - t) * 10 <= t) for (p, t), (q, u) in zip(steps(a), steps(b), strict=True))]
            if len(found) > 1:
                best.setdefault(tuple(tune[k][0] for k in found), (a, length, len(found)))
    import notelake.plans.shapes  # noqa: F401 - registers the query
    from notelake.operators.sequence import repeated_riffs
    from notelake.plans.registry import ORACLE, QUERIES
    got = repeated_riffs(df, block=16, width=7_000_000).collect()
    assert {n for _, n, _ in best.values()} == set(range(3, 17)) and sorted((r["first"], r["length"], r["n"]) for r in got) == sorted(best.values())
    found = {r["length"] for r in QUERIES["repeated_riffs"](spark, "/root/testdata/sf0.001").select("length").distinct().collect()}
    assert "repeated_riffs" in ORACLE and 3 in found


def test_riffs_meet_once_and_are_not_broadcast(spark):
    from notelake.operators.sequence import repeated_riffs
    df = spark.createDataFrame([(1, i, 500_000 * i, 60 + i % 3) for i in range(30)], "track_id long, note_id long, start_us long, midi int")
    plan = repeated_riffs(df, 3, 16)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in plan  # the copies of the later sequences: their files say little of their number
