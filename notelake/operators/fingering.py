"""Fingerings that look at chords, neighbours and the way ahead: chord resolution, cheapest paths, smoothing and low positions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notelake.functions.dims import NUM_FRETS, tuning_notes
from notelake.operators.chains import Path, Rule, blocks, cheapest_along, choose_along
from notelake.operators.timeline import SLICE_US, group_anchored
from notelake.session import checkpointed

BLOCK = 512
CHORD_US = 50_000
Position = tuple[int, int]

# What a fingering costs.
REACH = 4
MOVE = 2.0
LOW_FRET = 0.5
OPEN_STRING = 1.5
HIGH_FRET = 0.1
NEXT_STRING = 0.3
SKIPPED_STRING = 0.5
SAME_STRING = 0.2
FAR_FRETS = 5
FAR = 1.5
FAST_US = 100_000
FAST = 1.5
BEND_STRINGS = {3: 0.3, 4: 0.5, 5: 0.4}
AHEAD = 3
DISCOUNT = 0.5
#: Costs are whole multiples of this, so sums do not depend on their order and slices give what one pass gives.
UNIT = 1e-6


def places(midi: int, tuning: Sequence[int]) -> list[Position]:
    """All (string, fret) of a pitch, low string first."""
    return [(s, midi - m) for s, m in enumerate(tuning) if 0 <= midi - m <= NUM_FRETS]


def combinations(options: list[list[Position]], reach: int, open_counts: bool) -> list[list[Position]]:
    """Choices of one place for each note on distinct strings and within ``reach`` frets, pruned while they grow.

    Open strings count for the reach only with ``open_counts``; without it, at least one note must be fretted.
    """
    out: list[list[Position]] = []
    if len(options) > max((s for o in options for s, _ in o), default=-1) + 1:
        return out

    def grow(i: int, held: list[Position], low: int, high: int) -> None:
        if i == len(options):
            if open_counts or high > 0:
                out.append(list(held))
            return
        for string, fret in options[i]:
            if any(string == s for s, _ in held):
                continue
            counts = open_counts or fret > 0
            low2, high2 = (min(low, fret), max(high, fret)) if counts else (low, high)
            if high2 - low2 <= reach or high2 < 0:
                grow(i + 1, [*held, (string, fret)], low2, high2)

    grow(0, [], NUM_FRETS + 1, -1)
    return out


def _first_free(options: list[list[Position]]) -> dict[int, Position]:
    """The lowest free string for each note in turn; notes for which none is left have no place."""
    out: dict[int, Position] = {}
    for i, each in enumerate(options):
        free = [p for p in each if all(p[0] != s for s, _ in out.values())]
        if free:
            out[i] = free[0]
    return out


def chord_groups(notes: DataFrame, tol: int = CHORD_US, width: int = SLICE_US) -> DataFrame:
    """(track_id, t_us, notes): notes that start within ``tol`` of the first of their group, in order of start and id."""
    rows = group_anchored(notes.select("track_id", "note_id", "start_us", "midi"), tol, "start_us", width)
    note = F.struct("start_us", "note_id", F.col("midi").cast("int").alias("midi"))
    return rows.groupBy("track_id", F.col("anchor_t").alias("t_us")).agg(F.array_sort(F.collect_list(note)).alias("notes"))


def _placed_schema(notes: DataFrame) -> T.StructType:
    return T.StructType([notes.schema["track_id"], notes.schema["note_id"], T.StructField("string", T.IntegerType()), T.StructField("fret", T.IntegerType())])


# --- chords resolved one after the other -------------------------------------------------------------------------
def resolve_chords(
    notes: DataFrame, tuning: str | Sequence[int] = "standard", tol: int = CHORD_US, reach: int = 5, width: int = SLICE_US, block: int = BLOCK
) -> DataFrame:
    """(string, fret) of every note that finds a place; notes of a chord are placed together.

    A chord takes distinct strings within ``reach`` frets, at low and close frets and near the mean fret of the group before; where that is impossible,
    each of its notes in order of pitch takes its lowest free string. A single note stays near the note before. Notes outside the range
    have no place and, when alone, do not count as the group before. The first of equal choices wins, low strings first.
    """
    opens = tuning_notes(tuning)

    def options(items: list[dict], i: int) -> list[list[tuple[int, Position]]]:
        chord = [(k, places(n["midi"], opens)) for k, n in enumerate(items[i]["notes"])]
        playable = [(k, o) for k, o in chord if o]
        if len(chord) == 1:
            return [[(0, p)] for p in playable[0][1]]
        if not playable:
            return [[]]
        found = combinations([o for _, o in playable], reach, True)
        if found:
            return [[(k, p) for (k, _), p in zip(playable, c, strict=True)] for c in found]
        by_pitch = sorted(playable, key=lambda ko: items[i]["notes"][ko[0]]["midi"])
        return [[(by_pitch[j][0], p) for j, p in _first_free([o for _, o in by_pitch]).items()]]

    def choose(items: list[dict], i: int, before: list[tuple[int, Position]] | None) -> int:
        mine = options(items, i)
        if len(items[i]["notes"]) == 1:
            def score(option):
                (string, fret), cost = option[0][1], 0.0
                cost += fret * 0.1
                if before:
                    cost += abs(fret - before[-1][1][1]) * 0.5 + abs(string - before[-1][1][0]) * 0.2
                return cost + (fret - 12) * 0.3 if fret > 12 else cost
        else:
            def score(option):
                if not option:
                    return 0.0
                frets = [f for _, (_, f) in option]
                mean = sum(frets) / len(frets)
                cost = mean * 0.2 + (max(frets) - min(frets)) * 0.5
                if before:
                    cost += abs(mean - sum(f for _, (_, f) in before) / len(before)) * 0.3
                return cost
        costs = [score(o) for o in mine]
        return costs.index(min(costs))

    def emit(items: list[dict], i: int, option: list[tuple[int, Position]], before: object) -> list[tuple]:
        return [(items[i]["notes"][k]["note_id"], *p) for k, p in option]

    groups = chord_groups(notes, tol, width)
    playable = F.exists("notes", lambda n: n["midi"].between(min(opens), max(opens) + NUM_FRETS) & F.exists(
        F.array(*[F.lit(m) for m in opens]), lambda m: (n["midi"] - m).between(0, NUM_FRETS)))
    groups = groups.filter((F.size("notes") > 1) | playable)
    placed = choose_along(blocks(groups, ["t_us"], block, 1, 0, width), Rule(options, choose, emit), _placed_schema(notes))
    return notes.join(placed, ["track_id", "note_id"])


# --- single notes one after the other ----------------------------------------------------------------------------
# Preferred strings, fret range and pull towards upper frets of each kind of section.
SECTIONS = {
    "solo": ((3, 4, 5), 5, 22, 0.7),
    "rhythm": ((0, 1, 2, 3, 4, 5), 0, 12, 0.0),
    "mixed": ((0, 1, 2, 3, 4, 5), 0, 22, 0.3),
}


def _near_score(place: Position, before: Position | None) -> float:
    score = place[1] * 0.1
    if before is not None:
        score += abs(place[1] - before[1]) * 0.5 + abs(place[0] - before[0]) * 0.2
    return -(score + (place[1] - 12) * 0.3 if place[1] > 12 else score)


def _section_score(place: Position, before: Position | None, section: str) -> float:
    strings, low, high, upward = SECTIONS[section]
    string, fret = place
    score = 5.0 if string in strings else 0.0
    if upward > 0:
        score += (fret - low) / (high - low + 1) * upward * 4.0 if fret >= low else 0.0
    else:
        score += (12 - fret) * 0.1 if fret <= 12 else 0.0
    score += 2.0 if low <= fret <= high else 0.0
    if before is not None:
        along, across = abs(fret - before[1]), abs(string - before[0])
        score += 2.0 - along * 0.3 if along <= 3 else -along * 0.2
        score += 1.0 if across <= 1 else -across * 0.5
    return score


def place_notes(
    notes: DataFrame, policy: str = "near", tuning: str | Sequence[int] = "standard", width: int = SLICE_US, block: int = BLOCK
) -> DataFrame:
    """(string, fret) of every playable note in order of start and id, each weighed against the place taken by the note before.

    ``near`` wants low frets and short ways, the first of equal places wins; ``solo``, ``rhythm`` and ``mixed`` want the strings and frets of such a section, the highest string of
    equal places wins. Notes outside the range are left out and do not count as the note before.
    """
    opens = tuning_notes(tuning)
    if policy != "near" and policy not in SECTIONS:
        raise ValueError(f"unknown policy {policy!r}")

    def choose(items: list[dict], i: int, before: Position | None) -> int:
        mine = places(items[i]["midi"], opens)
        if policy == "near":
            return max(range(len(mine)), key=lambda k: (round(_near_score(mine[k], before), 9), -k))
        return max(range(len(mine)), key=lambda k: (round(_section_score(mine[k], before, policy), 9), mine[k]))

    rule = Rule(lambda items, i: places(items[i]["midi"], opens), choose, lambda items, i, place, before: [(items[i]["note_id"], *place)])
    rows = notes.select("track_id", "start_us", "note_id", F.col("midi").cast("int").alias("midi"))
    rows = rows.filter(F.exists(F.array(*[F.lit(m) for m in opens]), lambda m: (F.col("midi") - m).between(0, NUM_FRETS)))
    return notes.join(choose_along(blocks(rows, ["start_us", "note_id"], block, 1, 0, width), rule, _placed_schema(notes)), ["track_id", "note_id"])


# --- the cheapest path over all groups ---------------------------------------------------------------------------
def _note_cost(string, fret, last_string, last_fret, hand, gap_us: int) -> np.ndarray:
    """Cost of a place after the last one (string -1: none) with the hand at a fret (-1: nowhere); arrays broadcast."""
    cost = np.where((fret >= 1) & (fret <= 5), -LOW_FRET * (6 - fret), 0.0) - OPEN_STRING * (fret == 0) + HIGH_FRET * np.maximum(fret - 12, 0)
    away = np.where((fret == 0) | (hand < 0), 0, np.maximum(np.maximum(hand - fret, fret - hand - REACH), 0))
    cost = cost + MOVE * away / 4
    across = np.abs(string - last_string)
    along = np.where((fret > 0) & (last_fret > 0), np.abs(fret - last_fret), 0)
    step = np.where(across == 1, -NEXT_STRING, np.where(across > 1, SKIPPED_STRING * (across - 1), SAME_STRING)) + FAR * np.maximum(along - FAR_FRETS, 0)
    known = last_string >= 0
    cost = cost + np.where(known, step, 0.0)
    if 0 < gap_us < FAST_US:
        cost = np.where(known & ((across > 1) | (along > 3)), cost * FAST, cost)
    bend = np.array([BEND_STRINGS.get(s, 0.0) for s in range(32)])
    return cost - bend[string] * 0.5


def _units(cost: np.ndarray) -> np.ndarray:
    return np.rint(cost / UNIT).astype(np.int64)


class Group:
    """The candidates of one group and what they cost."""

    def __init__(self, item: dict, opens: Sequence[int]):
        self.t = item["t_us"]
        options = [places(n["midi"], opens) for n in item["notes"]]
        if len(options) == 1:
            self.candidates = [{0: p} for p in options[0]]
        else:
            self.candidates = [dict(enumerate(c)) for c in combinations(options, REACH, False)]
            if not self.candidates and (rest := _first_free(options)):
                self.candidates = [rest]
        self.candidates = self.candidates or [{}]
        self.all_places = np.array([p for o in options for p in o] or np.empty((0, 2)), dtype=np.int64)
        at = [list(c.values()) for c in self.candidates]
        self.places = np.array(at, dtype=np.int64).reshape(len(at), -1, 2)  # candidate, note, (string, fret)
        strings, frets = self.places[:, :, 0], self.places[:, :, 1]
        fretted = np.where(frets > 0, frets, NUM_FRETS + 1)
        self.hand = np.where((frets > 0).any(axis=1), fretted.min(axis=1, initial=NUM_FRETS + 1), -1)
        last = self.places[:, -1] if self.places.shape[1] else np.full((len(at), 2), -1)
        self.last_string, self.last_fret = last[:, 0], last[:, 1]
        span = np.where(self.hand >= 0, frets.max(axis=1, initial=0) - self.hand, 0)
        self.shape = 10.0 * np.maximum(span - REACH, 0)
        if self.places.shape[1] > 1:
            self.shape = self.shape - 0.5 * ((frets == self.hand[:, None]).sum(axis=1) >= 2)
            order = np.argsort(strings, axis=1)
            s, f = np.take_along_axis(strings, order, 1), np.take_along_axis(frets, order, 1)
            wide = np.diff(s, axis=1)
            self.shape = self.shape + (0.5 * (wide - 1) * ((wide > 2) & (f[:, :-1] > 0) & (f[:, 1:] > 0))).sum(axis=1)

    def _chord(self, hand: np.ndarray) -> np.ndarray:
        """Cost of each candidate (second axis) with the hand at each of ``hand`` (first axis)."""
        strings, frets = self.places[None, :, :, 0], self.places[None, :, :, 1]
        each = _note_cost(strings, frets, np.int64(-1), np.int64(-1), hand[:, None, None], 0).sum(axis=2)
        moved = (hand[:, None] >= 0) & (self.hand[None, :] >= 0)
        return self.shape + each + np.where(moved, MOVE * np.abs(self.hand[None, :] - hand[:, None]) / 4, 0.0)

    def first(self) -> np.ndarray:
        return _units(self._chord(np.full(1, -1)))

    def after(self, before: Group, ahead: list[Group]) -> np.ndarray:
        """Cost from each candidate of the group before to each own, with what the next groups will cost from here."""
        cost = self._chord(before.hand)
        if before.places.shape[1] and self.places.shape[1]:
            strings, frets = self.places[None, :, :, 0], self.places[None, :, :, 1]
            lead = [a[:, None, None] for a in (before.last_string, before.last_fret, before.hand)]
            cost = cost + 0.5 * _note_cost(strings, frets, *lead, self.t - before.t).sum(axis=2)
        later = np.zeros(len(self.candidates))
        for k, group in enumerate(ahead[:AHEAD], 1):
            if len(group.all_places):
                s, f = group.all_places[None, :, 0], group.all_places[None, :, 1]
                later += DISCOUNT**k * _note_cost(s, f, self.last_string[:, None], self.last_fret[:, None], self.hand[:, None], 0).min(axis=1)
        return _units(cost + later)


def optimal_fingering(
    notes: DataFrame, tuning: str | Sequence[int] = "standard", tol: int = CHORD_US, width: int = SLICE_US, block: int = BLOCK
) -> DataFrame:
    """(string, fret) of every note on the cheapest path over all groups of a track.

    A group's candidates are all places of a single note, or all combinations of a chord on distinct strings within four frets (the lowest free string of
    each note where there are none). A step costs hand moves, stretches, jumps, skipped strings and haste, less bonuses for
    low and open positions, and looks three groups ahead with a discount. Of equal paths the one with the earlier candidates from its end on is taken.
    Notes that no string holds have no row.
    """
    opens = tuning_notes(tuning)
    pieces = blocks(chord_groups(notes, tol, width), ["t_us"], block, 1, AHEAD, width)

    def emit(items: list[dict], groups: list[Group], i: int, k: int) -> list[tuple]:
        return [(items[i]["notes"][note]["note_id"], *p) for note, p in groups[i].candidates[k].items()]

    path = Path(
        prepare=lambda items: [Group(item, opens) for item in items], first=lambda groups: groups[0].first(),
        after=lambda groups, i: groups[i].after(groups[i - 1], groups[i + 1:]), emit=emit)
    return notes.join(cheapest_along(pieces, path, _placed_schema(notes)), ["track_id", "note_id"])


# --- changes to given tabs ---------------------------------------------------------------------------------------
def _reach(from_fret: int, to_fret: int) -> float:
    """Effort of a move of a tenth of a second; open strings are free."""
    if from_fret == 0 or to_fret == 0:
        return 0.0
    far = abs(to_fret - from_fret)
    # fixed values: frets in reach, effort per fret, of a shift and of one without time for it
    return far * 0.2 * 1.5 if far <= 4 else 2.0 + far * 0.3 + 5.0


def _playable(from_fret: int, to_fret: int, gap_us: int) -> bool:
    far = abs(to_fret - from_fret)
    return from_fret == 0 or to_fret == 0 or not ((gap_us < 50_000 and far > 5) or (far > 12 and gap_us < 100_000))


def _tabs(tabs: DataFrame) -> DataFrame:
    return tabs.select("track_id", "start_us", "note_id", F.col("string").cast("int").alias("string"), F.col("fret").cast("int").alias("fret"))


def smooth_positions(
    tabs: DataFrame, tuning: str | Sequence[int] = "standard", sweeps: int = 3, width: int = SLICE_US, block: int = BLOCK
) -> DataFrame:
    """``tabs`` with string and fret moved where that saves effort to both neighbours, in up to ``sweeps`` sweeps from left to right.

    A choice sees its left neighbour already changed and its right one not yet. Open strings, the first and the last note stay, and so does a
    place that no other beats by more than 0.1. A track in which a sweep changes nothing is done.
    """
    opens = tuning_notes(tuning)

    def options(items: list[dict], i: int) -> list[Position]:
        here = (items[i]["string"], items[i]["fret"])
        if i == 0 or i == len(items) - 1 or here[1] == 0:
            return [here]
        return [here, *[p for p in places(opens[here[0]] + here[1], opens) if p != here]]

    def choose(items: list[dict], i: int, before: Position | None) -> int:
        mine = options(items, i)
        if len(mine) == 1 or before is None:
            return 0
        cost = lambda p: _reach(before[1], p[1]) + _reach(p[1], items[i + 1]["fret"])
        best, least = 0, cost(mine[0])
        for k, p in enumerate(mine[1:], 1):
            if cost(p) < least - 0.1:
                best, least = k, cost(p)
        return best

    def emit(items: list[dict], i: int, option: Position, before: Position | None) -> list[tuple]:
        return [(items[i]["note_id"], *option, option != (items[i]["string"], items[i]["fret"]))]

    schema = T.StructType([*_placed_schema(tabs), T.StructField("moved", T.BooleanType())])
    open_tracks, done = _tabs(tabs), []
    for _ in range(sweeps):
        # two neighbours before: the first own item's left one must not look like the track's first
        moved = choose_along(blocks(open_tracks, ["start_us", "note_id"], block, 2, 1, width), Rule(options, choose, emit), schema)
        moved = checkpointed(open_tracks.select("track_id", "start_us", "note_id").join(moved, ["track_id", "note_id"]))
        changing = moved.filter("moved").select("track_id").distinct()
        done.append(moved.join(changing, "track_id", "left_anti").drop("moved"))
        open_tracks = checkpointed(moved.join(changing, "track_id", "left_semi").drop("moved"))
        if open_tracks.isEmpty():
            break
    out = open_tracks
    for rows in done:
        out = out.unionByName(rows)
    return tabs.drop("string", "fret").join(out.drop("start_us"), ["track_id", "note_id"])


def prefer_lower_frets(
    tabs: DataFrame, tuning: str | Sequence[int] = "standard", below: int = 7, around: int = 4, width: int = SLICE_US, block: int = BLOCK
) -> DataFrame:
    """``tabs`` (with ``midi``) with string and fret chosen anew for low frets, near the mean fret of ``around`` old places on each side.

    The left neighbour counts as newly chosen, the right one as it was; moves that a hand cannot make in time cost 10 and 5. Notes with at most one place stay, and so do
    notes among open strings only, which have no mean. The first of equal places wins.
    """
    opens = tuning_notes(tuning)

    def options(items: list[dict], i: int) -> list[Position]:
        here = (items[i]["string"], items[i]["fret"])
        found = places(items[i]["midi"], opens)
        return [here] if len(found) <= 1 else found if here in found else [*found, here]

    def choose(items: list[dict], i: int, before: Position | None) -> int:
        mine, item = options(items, i), items[i]
        near = [x["fret"] for x in items[max(0, i - around):i + around + 1] if x["fret"] > 0]
        found = places(item["midi"], opens)
        if len(found) <= 1 or not near:
            return mine.index((item["string"], item["fret"]))
        mean = sum(near) / len(near)
        best, most = 0, float("-inf")
        for k, (_, fret) in enumerate(found):
            score = (below - fret) * 2 if fret <= below else below - fret
            score += 5 if fret == 0 else 0
            score -= abs(fret - mean) * 0.3
            if before is not None and not _playable(before[1], fret, item["start_us"] - items[i - 1]["start_us"]):
                score -= 10
            if i + 1 < len(items) and not _playable(fret, items[i + 1]["fret"], items[i + 1]["start_us"] - item["start_us"]):
                score -= 5
            if score > most:
                best, most = k, score
        return best

    def emit(items: list[dict], i: int, option: Position, before: Position | None) -> list[tuple]:
        return [(items[i]["note_id"], *option)]

    rows = tabs.select("track_id", "start_us", "note_id", *[F.col(c).cast("int").alias(c) for c in ("midi", "string", "fret")])
    pieces = blocks(rows, ["start_us", "note_id"], block, around, max(around, 1), width)
    return tabs.drop("string", "fret").join(choose_along(pieces, Rule(options, choose, emit), _placed_schema(tabs)), ["track_id", "note_id"])


# --- string choice from spectra ----------------------------------------------------------------------------------
# Centroid and bandwidth of each open string in Hz, brightness of the attack against the sustain, weights.
CENTROID_HZ = [(200, 600), (300, 800), (400, 1000), (600, 1400), (800, 1800), (1000, 2500)]
BANDWIDTH_HZ = [(100, 400), (150, 500), (200, 600), (300, 800), (400, 1000), (500, 1200)]
ATTACK_RATIO = [1.3, 1.25, 1.2, 1.15, 1.1, 1.05]
WEIGHTS = {"centroid": 0.35, "bandwidth": 0.15, "attack": 0.20, "context": 0.30}


def _spectral_score(item: dict, place: Position) -> float:
    """How well a note's mean spectrum fits a place; a note without spectrum scores nothing here."""
    string, fret = place
    if item["centroid"] is None or string >= len(CENTROID_HZ):
        return 0.0

    def fit(value: float, bounds: tuple[int, int], factor: float) -> float:
        low, high = bounds[0] * factor, bounds[1] * factor
        return float(np.exp(-0.5 * ((value - (low + high) / 2) / (high - low)) ** 2))

    ratio = item["attack"] / item["sustain"] if item["sustain"] > 0 else 1.0
    return (WEIGHTS["centroid"] * fit(item["centroid"], CENTROID_HZ[string], 1 + fret * 0.02)
            + WEIGHTS["bandwidth"] * fit(item["bandwidth"], BANDWIDTH_HZ[string], 1 - fret * 0.01)
            + WEIGHTS["attack"] * float(np.exp(-2.0 * (ratio - ATTACK_RATIO[string]) ** 2)))


def _ease(place: Position, before: Position | None) -> float:
    score = 1.1 if place[1] <= 5 else 1.0 if place[1] <= 12 else 0.85
    if before is not None:
        along, across = abs(place[1] - before[1]), abs(place[0] - before[0])
        score *= 0.7 if along > 5 else 0.85 if along > 3 else 1.0
        score *= 0.8 if across > 2 else 0.9 if across > 1 else 1.0
    return score


def score_strings(
    notes: DataFrame, shapes: DataFrame, tuning: str | Sequence[int] = "standard", width: int = SLICE_US, block: int = BLOCK
) -> DataFrame:
    """(track_id, note_id, string, fret, confidence, method) of every note, by its spectrum and by ease of play after the last sure choice.

    ``shapes`` (track_id, note_id, centroid, bandwidth, attack, sustain) comes from ``spectral.note_shape``. Each place of a note is weighed by centroid,
    bandwidth and attack ratio, which shift with the fret, and by ease after the place before; the margin over the second best gives the confidence. A choice
    of confidence above 0.5 becomes the place before. Notes with one place are ``unique`` (0.95), notes outside the range ``none`` (string and fret -1).
    """
    opens = tuning_notes(tuning)
    anywhere: list[Position | None] = [None, *[(s, f) for s in range(len(opens)) for f in range(NUM_FRETS + 1)]]
    index = {p: k for k, p in enumerate(anywhere)}

    def predict(item: dict, before: Position | None) -> tuple[int, int, float, str]:
        found = places(item["midi"], opens)
        if len(found) <= 1:
            return (*found[0], 0.95, "unique") if found else (-1, -1, 0.0, "none")
        scores = [_spectral_score(item, p) + WEIGHTS["context"] * _ease(p, before) for p in found]
        best, second = sorted(scores, reverse=True)[:2]
        return (*found[scores.index(best)], max(0.3, min(0.95, 0.5 + (best - second) * 2)), "spectral")

    def choose(items: list[dict], i: int, before: Position | None) -> int:
        string, fret, confidence, _ = predict(items[i], before)
        return index[string, fret] if confidence > 0.5 else index[before]  # the last sure place is kept

    def emit(items: list[dict], i: int, option: Position | None, before: Position | None) -> list[tuple]:
        return [(items[i]["note_id"], *predict(items[i], before))]

    looks = shapes.select("track_id", "note_id", *[F.col(c).cast("double").alias(c) for c in ("centroid", "bandwidth", "attack", "sustain")])
    rows = notes.select("track_id", "start_us", "note_id", F.col("midi").cast("int").alias("midi")).join(looks, ["track_id", "note_id"], "left")
    schema = T.StructType([*_placed_schema(notes), T.StructField("confidence", T.DoubleType()), T.StructField("method", T.StringType())])
    return choose_along(blocks(rows, ["start_us", "note_id"], block, 1, 0, width), Rule(lambda items, i: anywhere, choose, emit), schema)
