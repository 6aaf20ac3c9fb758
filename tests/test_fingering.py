"""Fingerings against plain passes over whole tracks, for several slice widths; cheapest paths also against all paths of tiny tracks."""

import itertools
import random

import pytest

from notelake.operators import fingering as fing
from notelake.operators.chains import MIN_PLUS, THEN, compose

OPENS = [40, 45, 50, 55, 59, 64]
NOTES = "track_id long, note_id long, start_us long, midi int"
TABS = "track_id long, note_id long, start_us long, midi int, string int, fret int"


def places(midi):
    return [(s, midi - m) for s, m in enumerate(OPENS) if 0 <= midi - m <= 24]


def made(seed, tracks=3, n=60, chords=True):
    rng = random.Random(seed)
    rows, note = [], 0
    for track in range(tracks):
        t = 0
        for _ in range(n):
            t += rng.choice([20_000, 60_000, 80_000, 300_000])
            for _ in range(rng.choice([1, 1, 2, 3, 4]) if chords else 1):
                rows.append((track, note, t, rng.choice([rng.randrange(36, 95), rng.randrange(40, 65)])))
                note += 1
    return rows


def grouped(rows):
    out = {}
    for track, note, t, midi in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        groups = out.setdefault(track, [])
        if not groups or t - groups[-1][0] > 50_000:
            groups.append((t, []))
        groups[-1][1].append((note, midi))
    return out


def plain_chords(rows):
    out = {}
    for groups in grouped(rows).values():
        before = []
        for _, chord in groups:
            known = [(note, midi, places(midi)) for note, midi in chord if places(midi)]
            if len(chord) == 1:
                if known:
                    note, _, options = known[0]

                    def cost(p):
                        c = p[1] * 0.1
                        if before:
                            c += abs(p[1] - before[-1][1]) * 0.5 + abs(p[0] - before[-1][0]) * 0.2
                        return c + ((p[1] - 12) * 0.3 if p[1] > 12 else 0)

                    out[note] = min(options, key=cost)
                    before = [out[note]]
                continue
            best = None
            for combo in itertools.product(*[o for _, _, o in known]) if known else []:
                frets = [f for _, f in combo]
                if len({s for s, _ in combo}) < len(combo) or max(frets) - min(frets) > 5:
                    continue
                c = sum(frets) / len(frets) * 0.2 + (max(frets) - min(frets)) * 0.5
                if before:
                    c += abs(sum(frets) / len(frets) - sum(f for _, f in before) / len(before)) * 0.3
                if best is None or c < best[0]:
                    best = (c, combo)
            if best:
                chosen = {note: p for (note, _, _), p in zip(known, best[1], strict=True)}
            else:
                chosen, used = {}, set()
                for note, _, options in sorted(known, key=lambda k: k[1]):
                    for p in options:
                        if p[0] not in used:
                            chosen[note] = p
                            used.add(p[0])
                            break
            out |= chosen
            before = list(chosen.values())
    return out


def note_cost(p, last, hand, gap):
    string, fret = p
    c = -0.5 * (6 - fret) if 1 <= fret <= 5 else -1.5 if fret == 0 else 0.1 * (fret - 12) if fret > 12 else 0.0
    if hand is not None and fret:
        c += 2.0 * max(hand - fret, fret - hand - 4, 0) / 4
    if last:
        across, along = abs(string - last[0]), abs(fret - last[1]) if fret and last[1] else 0
        c += {0: 0.2, 1: -0.3}.get(across, 0.5 * (across - 1)) + 1.5 * max(along - 5, 0)
        if 0 < gap < 100_000 and (across > 1 or along > 3):
            c *= 1.5
    return c - {3: 0.15, 4: 0.25, 5: 0.2}.get(string, 0.0)


def hand_of(cand):
    return min((f for _, f in cand.values() if f), default=None)


def chord_cost(cand, hand):
    frets = [f for _, f in cand.values() if f]
    c = 10.0 * max(max(frets) - min(frets) - 4, 0) if frets else 0.0
    if hand is not None and frets:
        c += 2.0 * abs(min(frets) - hand) / 4
    if len(cand) > 1:
        at = sorted(cand.values())
        c -= 0.5 * (frets.count(min(frets, default=-1)) >= 2)
        c += sum(0.5 * (b[0] - a[0] - 1) for a, b in itertools.pairwise(at) if b[0] - a[0] > 2 and a[1] and b[1])
    return c + sum(note_cost(p, None, hand, 0) for p in cand.values())


def candidates(chord):
    options = [places(m) for _, m in chord]
    if len(chord) == 1:
        return [{0: p} for p in options[0]] or [{}]
    found = []
    for combo in itertools.product(*options):
        frets = [f for _, f in combo if f]
        if len({s for s, _ in combo}) == len(combo) and frets and max(frets) - min(frets) <= 4:
            found.append(dict(enumerate(combo)))
    if found:
        return found
    rest, used = {}, set()
    for i, each in enumerate(options):
        for p in each:
            if p[0] not in used:
                rest[i] = p
                used.add(p[0])
                break
    return [rest]


def step_cost(groups, i, before, cand):
    hand = hand_of(before)
    c = chord_cost(cand, hand)
    last = list(before.values())[-1] if before else None
    if before and cand:
        c += 0.5 * sum(note_cost(p, last, hand, groups[i][0] - groups[i - 1][0]) for p in cand.values())
    mine = list(cand.values())[-1] if cand else None
    for k, (_, chord) in enumerate(groups[i + 1:i + 4], 1):
        reachable = [note_cost(p, mine, hand_of(cand), 0) for _, m in chord for p in places(m)]
        c += 0.5**k * min(reachable) if reachable else 0.0
    return round(c * 1e6)


def plain_path(rows):
    out = {}
    for groups in grouped(rows).values():
        lists = [candidates(chord) for _, chord in groups]
        cost, back = [round(chord_cost(c, None) * 1e6) for c in lists[0]], []
        for i in range(1, len(groups)):
            total = [[cost[k] + step_cost(groups, i, b, c) for k, b in enumerate(lists[i - 1])] for c in lists[i]]
            back.append([t.index(min(t)) for t in total])
            cost = [min(t) for t in total]
        j = cost.index(min(cost))
        for i in range(len(groups) - 1, -1, -1):
            out |= {groups[i][1][k][0]: p for k, p in lists[i][j].items()}
            j = back[i - 1][j] if i else j
    return out


def found(df):
    return {r.note_id: (r.string, r.fret) for r in df.collect()}


@pytest.mark.parametrize("block", [4, 50])
def test_resolved_chords(spark, block):
    rows = made(1)
    assert found(fing.resolve_chords(spark.createDataFrame(rows, NOTES).repartition(3), width=500_000, block=block)) == plain_chords(rows)


@pytest.mark.parametrize("block", [3, 40])
def test_cheapest_path(spark, block):
    rows = made(2, tracks=2, n=35)
    assert found(fing.optimal_fingering(spark.createDataFrame(rows, NOTES).repartition(3), width=500_000, block=block)) == plain_path(rows)


def test_a_track_of_one_slice_is_gone_through_once(spark, monkeypatch):
    """No table of costs or ways is made for tracks of one slice, and none for slices whose table nothing reads."""
    from notelake.operators import chains

    plain, sizes = chains.compose, []

    def watched(tables, *rest, **named):
        sizes.append(sorted((r.track_id, r.n) for r in tables.collect()))
        return plain(tables, *rest, **named)

    monkeypatch.setattr(chains, "compose", watched)
    rows = [(0, k, 100_000 * k, 45 + k) for k in range(3)] + [(1, 10 + k, 100_000 * k, 45 + k) for k in range(9)]
    assert found(fing.optimal_fingering(spark.createDataFrame(rows, NOTES), block=4)) == plain_path(rows)
    assert sizes == [[(1, 0), (1, 1)], [(1, 1), (1, 2)]]


def test_cheapest_path_over_all_paths(spark):
    rows = made(3, tracks=6, n=4)
    got = found(fing.optimal_fingering(spark.createDataFrame(rows, NOTES), block=2))
    for track, groups in grouped(rows).items():
        def whole(path, groups=groups):
            return round(chord_cost(path[0], None) * 1e6) + sum(step_cost(groups, i, path[i - 1], path[i]) for i in range(1, len(path)))

        least = min(map(whole, itertools.product(*[candidates(c) for _, c in groups])))
        taken = [{k: got[note] for k, (note, _) in enumerate(chord) if note in got} for _, chord in groups]
        assert whole(taken) == least, track


@pytest.mark.parametrize("block", [3, 64])
@pytest.mark.parametrize("policy", ["near", "solo", "rhythm", "mixed"])
def test_single_notes_by_policy(spark, block, policy):
    rows, want = made(7, n=80, chords=False), {}
    for track in {r[0] for r in rows}:
        before = None
        for _, note, _, midi in sorted((r for r in rows if r[0] == track), key=lambda r: (r[2], r[1])):
            scored = []
            for string, fret in places(midi):
                far, across = (abs(fret - before[1]), abs(string - before[0])) if before else (None, None)
                if policy == "near":
                    score = -(fret * 0.1 + (far * 0.5 + across * 0.2 if before else 0) + max(fret - 12, 0) * 0.3)
                    tie = -string
                else:
                    strings, low, high, up = {"solo": ([3, 4, 5], 5, 22, 0.7), "rhythm": (range(6), 0, 12, 0), "mixed": (range(6), 0, 22, 0.3)}[policy]
                    score = 5 * (string in strings) + 2 * (low <= fret <= high)
                    score += max(fret - low, 0) / (high - low + 1) * up * 4 if up else max(12 - fret, 0) * 0.1
                    if before:
                        score += (2 - far * 0.3 if far <= 3 else -far * 0.2) + (1 if across <= 1 else -across * 0.5)
                    tie = string
                scored.append((round(score, 9), tie, (string, fret)))
            if scored:
                before = want[note] = max(scored)[2]
    assert found(fing.place_notes(spark.createDataFrame(rows, NOTES).repartition(3), policy, width=500_000, block=block)) == want


def tabbed(seed):
    rng = random.Random(seed)
    return [(*r, *rng.choice(places(r[3]))) for r in made(seed, n=120, chords=False) if places(r[3])]


def reach(a, b):
    return 0.0 if not a or not b else abs(a - b) * 0.2 * 1.5 if abs(a - b) <= 4 else 2.0 + abs(a - b) * 0.3 + 5.0


def plain_smooth(rows, sweeps=3):
    out = {}
    for track in {r[0] for r in rows}:
        tab = [[r[1], r[4], r[5]] for r in sorted(rows, key=lambda r: (r[2], r[1])) if r[0] == track]
        for _ in range(sweeps):
            moves = 0
            for (_, _, left), here, (_, _, right) in zip(tab, tab[1:], tab[2:], strict=False):
                left = tab[tab.index(here) - 1][2]
                if not here[2]:
                    continue
                best, least = None, reach(left, here[2]) + reach(here[2], right)
                for p in places(OPENS[here[1]] + here[2]):
                    c = reach(left, p[1]) + reach(p[1], right)
                    if p != (here[1], here[2]) and c < least - 0.1:
                        best, least = p, c
                if best:
                    here[1:] = best
                    moves += 1
            if not moves:
                break
        out |= {n: (s, f) for n, s, f in tab}
    return out


@pytest.mark.parametrize("block", [3, 100])
def test_smoothing_sweeps(spark, block):
    rows = tabbed(4) + [(9, 10_000 + i, i * 10, 64, 5, 0) for i in range(7)] + [(10, 20_000, 5, 50, 1, 5)]
    got = fing.smooth_positions(spark.createDataFrame(rows, TABS).repartition(3), width=500_000, block=block)
    assert found(got) == plain_smooth(rows) and found(got) != {r[1]: r[4:] for r in rows}
    assert got.count() == len(rows)


def plain_lower(rows):
    out = {}
    ok = lambda a, b, gap: not a or not b or not ((gap < 50_000 and abs(a - b) > 5) or (abs(a - b) > 12 and gap < 100_000))
    for track in {r[0] for r in rows}:
        tab = sorted((r for r in rows if r[0] == track), key=lambda r: (r[2], r[1]))
        for i, (_, note, t, midi, string, fret) in enumerate(tab):
            near = [r[5] for r in tab[max(0, i - 4):i + 5] if r[5]]
            out[note] = (string, fret)
            if len(places(midi)) < 2 or not near:
                continue
            scored = []
            for p in places(midi):
                s = ((7 - p[1]) * 2 if p[1] <= 7 else 7 - p[1]) + 5 * (p[1] == 0) - abs(p[1] - sum(near) / len(near)) * 0.3
                if i and not ok(out[tab[i - 1][1]][1], p[1], t - tab[i - 1][2]):
                    s -= 10
                if i + 1 < len(tab) and not ok(p[1], tab[i + 1][5], tab[i + 1][2] - t):
                    s -= 5
                scored.append(s)
            out[note] = places(midi)[scored.index(max(scored))]
    return out


@pytest.mark.parametrize("block", [5, 100])
def test_lower_frets(spark, block):
    rows = tabbed(6) + [(9, 10_000 + i, i * 10, 64, 5, 0) for i in range(7)]
    assert found(fing.prefer_lower_frets(spark.createDataFrame(rows, TABS).repartition(3), width=500_000, block=block)) == plain_lower(rows)


def test_composition(spark):
    rows = [(t, n, [(n + 1) % 3, 2, 0]) for t, size in ((1, 9), (2, 1)) for n in range(size)]
    tables = spark.createDataFrame(rows, "track_id long, n long, table array<int>")
    want = {}
    for t, n, f in rows:
        want[t, n] = [f[x] for x in want[t, n - 1]] if n else f
    assert {(r.track_id, r.n): r.table for r in compose(tables, THEN).collect()} == want
    costs = spark.createDataFrame([(1, 0, [[1, 5]]), (1, 1, [[2, 9], [0, 1]]), (1, 2, [[3], [1]])], "track_id long, n long, table array<array<long>>")
    assert [r.table for r in compose(costs, MIN_PLUS).orderBy("n").collect()] == [[[1, 5]], [[3, 6]], [[6]]]


def test_empty_tracks(spark):
    assert fing.resolve_chords(spark.createDataFrame([], NOTES)).count() == 0
    assert fing.optimal_fingering(spark.createDataFrame([], NOTES)).count() == 0
    assert fing.smooth_positions(spark.createDataFrame([], TABS)).count() == 0
    assert fing.prefer_lower_frets(spark.createDataFrame([], TABS)).count() == 0


def test_a_batch_of_slices_is_read_slice_by_slice():
    import pyarrow as pa

    from notelake.operators.chains import rows_of
    batch = pa.RecordBatch.from_pydict({"track_id": [1, 2], "n": [0, 0], "items": [[{"rn": 0}], [{"rn": 0}, {"rn": 1}]]})
    rows = rows_of(batch)
    assert next(rows) == [1, 0, [{"rn": 0}]] and next(rows)[2] == [{"rn": 0}, {"rn": 1}] and next(rows, None) is None
