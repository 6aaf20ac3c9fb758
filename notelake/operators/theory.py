"""Keys, scales, chords, genre priors, rhythm."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notelake.functions.dims import CHORDS, MAJOR_PROFILE, MINOR_PROFILE, OPEN_SHAPES, SCALES, dim_shape
from notelake.functions.genres import GENRE_SCALES, GENRES, RUN_SCALES, Genre
from notelake.functions.scalars import pc_name, pitch_class
from notelake.operators.timeline import (
    SLICE_US, following, group_anchored, group_quantile, halo, previous, range_join, row_index, running, slice_window,
)

LOW, HIGH = 40, 88


def histogram(notes: DataFrame, weight: Column, keys: Sequence[str] = ("track_id",), midi: str = "midi") -> DataFrame:
    """Twelve pitch-class sums per track as an array; one pass with map-side sums, no matter how long a track is."""
    pc = pitch_class(F.col(midi))
    sums = [F.coalesce(F.sum(F.when(pc == i, weight)), F.lit(0)).cast("double") for i in range(12)]
    return notes.groupBy(*keys).agg(F.array(*sums).alias("hist"), F.count("*").alias("n_notes"))


def literal_table(names: str, rows: Sequence[Sequence]) -> Column:
    """A literal array of structs, parsed in one go."""
    def cell(x) -> str:
        if isinstance(x, (list, tuple)):
            return "array(" + ", ".join(cell(y) for y in x) + ")"
        if isinstance(x, str):
            return f"'{x}'"
        return f"{x!r}D" if isinstance(x, float) else str(x)

    cols = names.split()
    return F.expr("array(" + ", ".join("struct(" + ", ".join(f"{cell(v)} as {c}" for c, v in zip(cols, r)) + ")" for r in rows) + ")")


def with_key(df: DataFrame, hist: str = "hist", name: str = "k") -> DataFrame:
    """Add the best correlated key as struct(root, mode, confidence); C major at 0 for a constant histogram.

    Correlation with a fixed profile needs one weighted sum of the twelve values; the other sums are shared by all
    24 profiles. Plain expressions, so they compile.
    """
    at = [f"{hist}[{pc}]" for pc in range(12)]
    rows = df.withColumn("_sum", F.expr(" + ".join(at))).withColumn("_sq", F.expr(" + ".join(f"{x} * {x}" for x in at)))
    rows = rows.withColumn("_spread", F.sqrt(12 * F.col("_sq") - F.col("_sum") * F.col("_sum")))
    keys = []
    for root in range(12):
        for m, (mode, profile) in enumerate([("major", MAJOR_PROFILE), ("minor", MINOR_PROFILE)]):
            dot = " + ".join(f"{at[(root + i) % 12]} * {float(p)!r}D" for i, p in enumerate(profile))
            s1, s2 = sum(profile), sum(p * p for p in profile)
            corr = f"(12 * ({dot}) - _sum * {s1!r}D) / (_spread * {math.sqrt(12 * s2 - s1 * s1)!r}D)"
            keys.append(f"struct({corr} as c, {-(2 * root + m)} as o, {root} as root, '{mode}' as mode)")
    rows = rows.withColumn("_varies", F.expr(f"_sum > 0 and array_max({hist}) > array_min({hist})"))
    best = F.expr(f"case when _varies then greatest({', '.join(keys)}) end")
    rows = rows.withColumn("_best", best)
    none = F.struct(F.lit(0).alias("root"), F.lit("major").alias("mode"), F.lit(0.0).alias("confidence"))
    key = F.struct(F.col("_best.root").alias("root"), F.col("_best.mode").alias("mode"), F.col("_best.c").alias("confidence"))
    return rows.withColumn(name, F.when(F.col("_varies"), key).otherwise(none)).drop("_sum", "_sq", "_spread", "_varies", "_best")


def detect_key(notes: DataFrame, weight: Column | None = None, min_notes: int = 0) -> DataFrame:
    """Key per track; below ``min_notes`` the first note decides: A, E and D suggest minor, anything else C major."""
    hist = histogram(notes, F.col("dur_us") if weight is None else weight)
    out = with_key(hist)
    if min_notes:
        first = notes.groupBy("track_id").agg(F.min_by(pitch_class("midi"), F.struct("start_us", "note_id")).alias("pc"))
        minor = F.col("pc").isin(9, 4, 2)
        short = F.struct(F.when(minor, F.col("pc")).otherwise(0).alias("root"), F.when(minor, "minor").otherwise("major").alias("mode"),
                         F.lit(0.5).alias("confidence"))
        out = out.join(first, "track_id").withColumn("k", F.when(F.col("n_notes") < min_notes, short).otherwise(F.col("k")))
    return out.select("track_id", "k.root", "k.mode", "k.confidence", "n_notes")


def detect_key_simple(notes: DataFrame) -> DataFrame:
    """The heaviest pitch class is the root; major when its major third weighs at least its minor third."""
    hist = histogram(notes, F.col("dur_us"))
    root = F.array_position("hist", F.array_max("hist")).cast("int") - 1
    at = lambda shift: F.element_at("hist", F.pmod(F.col("root") + shift, F.lit(12)).cast("int") + 1)
    total = F.aggregate("hist", F.lit(0.0), lambda a, x: a + x)
    return hist.withColumn("root", root).select(
        "track_id", "root", F.when(at(4) >= at(3), "major").otherwise("minor").alias("mode"),
        F.when(total > 0, at(0) / total).otherwise(0.0).alias("confidence"),
    )


def scale_mask(steps: Sequence[int], root: int = 0) -> int:
    return sum(1 << ((root + s) % 12) for s in set(steps))


def in_scale(midi: Column, root: Column, scale: str | Sequence[int]) -> Column:
    steps = SCALES[scale] if isinstance(scale, str) else scale
    return F.array_contains(F.array(*[F.lit(s) for s in steps]), F.pmod(midi - root, F.lit(12)).cast("int"))


def snap_shift(pc: int, steps: Sequence[int], direction: str) -> int:
    """Semitones from a pitch class (relative to the root's scale tones ``steps``, absolute) to the snapped one."""
    tones = sorted({s % 12 for s in steps})
    if pc in tones:
        return 0
    if direction == "down":
        return -min((pc - s) % 12 for s in tones)
    if direction == "up":
        return min((s - pc) % 12 for s in tones)
    # equal distances go to the lower pitch class number
    _, tone = min((min((s - pc) % 12, (pc - s) % 12), s) for s in tones)
    up, down = (tone - pc) % 12, (pc - tone) % 12
    return up if up <= down else -down


def snap_to_scale(midi: Column, root: Column, scale: str, direction: str = "nearest") -> Column:
    """MIDI number moved to the scale, by a literal table of 12 roots x 12 pitch classes (no join)."""
    table = F.array(*[
        F.array(*[F.lit(snap_shift(pc, [r + s for s in SCALES[scale]], direction)) for pc in range(12)]) for r in range(12)
    ])
    return (midi + F.element_at(F.element_at(table, root.cast("int") + 1), pitch_class(midi) + 1)).cast("int")


def constrain_to_key(notes: DataFrame, min_notes: int = 8, allow_passing: bool = False, passing_us: int = 100_000) -> DataFrame:
    """Each note kept (in scale, or a short passing tone) or moved to the scale of its track's key."""
    keys = detect_key(notes, min_notes=min_notes).select("track_id", "root", "mode")
    rows = notes.join(keys, "track_id")
    major = F.col("mode") == "major"
    fits = F.when(major, in_scale(F.col("midi"), F.col("root"), "major")).otherwise(in_scale(F.col("midi"), F.col("root"), "natural_minor"))
    snapped = F.when(major, snap_to_scale(F.col("midi"), F.col("root"), "major")).otherwise(
        snap_to_scale(F.col("midi"), F.col("root"), "natural_minor"))
    passing = F.lit(allow_passing) & (F.col("dur_us") <= passing_us)
    fate = F.when(fits, "in_scale").when(passing, "passing").otherwise("snapped")
    return rows.withColumn("fate", fate).withColumn("new_midi", F.when(F.col("fate") == "snapped", snapped).otherwise(F.col("midi")))


def constrain_stats(constrained: DataFrame) -> DataFrame:
    moved = F.col("fate") == "snapped"
    return constrained.groupBy("track_id").agg(
        F.count("*").alias("total"), F.count_if(F.col("fate") == "in_scale").alias("in_scale"),
        F.count_if(F.col("fate") == "passing").alias("passing"), F.count_if(moved).alias("snapped"),
        F.avg(F.when(moved, F.abs(F.col("new_midi") - F.col("midi")))).alias("mean_snap"),
    )


def base_transition(a: Column, b: Column) -> Column:
    """Unnormalised musical preference for moving from pitch ``a`` to ``b``."""
    d = F.abs(b - a)
    return (
        F.when(d == 0, 0.3).when(d <= 2, 0.6 / 4).when(d <= 4, 0.1).when(d <= 7, 0.05).when(d == 12, 0.08)
        .when(d <= 12, 0.02 * F.exp(-0.1 * (d - 7))).otherwise(1e-4)
    )


def transition_model(notes: DataFrame, smoothing: float = 0.01, width: int = SLICE_US) -> DataFrame:
    """P(to | from) over the corpus: counts with Laplace smoothing, half and half with the musical preference."""
    rows = notes.withColumn("m", F.greatest(F.lit(LOW), F.least(F.lit(HIGH), F.col("midi"))))
    rows = running(rows, ["start_us", "note_id"], width, nxt=following("m"))
    counts = rows.filter("nxt is not null").groupBy(F.col("m").alias("a"), F.col("nxt.m").alias("b")).agg(F.count("*").alias("n"))
    pitches = notes.sparkSession.range(LOW, HIGH + 1).select(F.col("id").cast("int").alias("a"))
    grid = pitches.withColumn("b", F.explode(F.sequence(F.lit(LOW), F.lit(HIGH))))  # 49 x 49 rows, fixed
    by_a = Window.partitionBy("a")
    full = grid.join(counts, ["a", "b"], "left").na.fill(0, ["n"])
    full = full.withColumn("base", base_transition(F.col("a"), F.col("b")))
    full = full.withColumn("base", F.col("base") / F.sum("base").over(by_a)).withColumn("total", F.sum("n").over(by_a))
    learned = (F.col("n") + smoothing) / (F.col("total") + smoothing * (HIGH - LOW + 1))
    return full.select("a", "b", "n", F.when(F.col("total") > 0, 0.5 * learned + 0.5 * F.col("base")).otherwise(F.col("base")).alias("p"))


def note_prior(keys: DataFrame) -> DataFrame:
    """Prior over MIDI 40-88 for each track's key: profile, raised for scale tones, root and fifth."""
    rel = F.pmod(F.col("midi") - F.col("root"), F.lit(12)).cast("int")
    major = F.col("mode") == "major"

    def pick(profile: Sequence[float], scale: str) -> Column:
        total = sum(profile)
        values = [p / total * (3.0 if i in SCALES[scale] else 1.0) for i, p in enumerate(profile)]
        return F.element_at(F.array(*[F.lit(v) for v in values]), rel + 1)

    raw = F.when(major, pick(MAJOR_PROFILE, "major")).otherwise(pick(MINOR_PROFILE, "natural_minor"))
    raw = raw * F.when(rel == 0, 1.5).otherwise(1.0) * F.when(rel == 7, 1.2).otherwise(1.0)
    rows = keys.withColumn("midi", F.explode(F.sequence(F.lit(LOW), F.lit(HIGH)))).withColumn("raw", raw)
    return rows.withColumn("p", F.col("raw") / F.sum("raw").over(Window.partitionBy("track_id"))).select("track_id", "midi", "p")


def interval_stats(notes: DataFrame, width: int = SLICE_US) -> DataFrame:
    rows = running(notes, ["start_us", "note_id"], width, nxt=following("midi")).filter("nxt is not null")
    rows = rows.withColumn("d", F.col("nxt.midi") - F.col("midi")).withColumn("a", F.abs("d"))
    share = lambda cond: F.avg(cond.cast("double"))
    return rows.groupBy("track_id").agg(
        F.count("*").alias("n"), F.avg("a").alias("mean_interval"), F.stddev_pop("a").alias("std_interval"), F.max("a").alias("max_interval"),
        share(F.col("a") <= 2).alias("stepwise"), share(F.col("a") > 4).alias("leap"), share(F.col("d") == 0).alias("repeat"),
        share(F.col("d") > 0).alias("up"), share(F.col("d") < 0).alias("down"),
        F.array(*[F.count_if(F.col("a") == i) for i in range(13)]).alias("histogram"),
    )


def suggest_scale(hists: DataFrame, genre: str) -> DataFrame:
    """Genre scale whose prior x root prior x in-scale weight share is best over the 12 roots."""
    g: Genre = GENRES[genre]
    options = literal_table("prior vec o scale", [
        (float(w * g.roots.get(root, 1.0)), [1.0 if scale_mask(GENRE_SCALES[name], root) >> pc & 1 else 0.0 for pc in range(12)], -12 * i - root, name)
        for i, (name, w) in enumerate(g.scales.items()) if name in GENRE_SCALES for root in range(12)
    ])
    total = F.aggregate("hist", F.lit(0.0), lambda a, x: a + x)
    rows = hists.withColumn("total", total)
    inside = lambda t: F.aggregate(F.zip_with("hist", t["vec"], lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    # scores are compared to 12 places, so sums taken in another order do not decide between equals
    scored = F.transform(options, lambda t: F.struct(
        F.round(F.when(F.col("total") > 0, t["prior"] * inside(t) / F.col("total")).otherwise(t["prior"]), 12).alias("score"),
        t["o"].alias("o"), t["scale"].alias("scale")))
    return rows.withColumn("b", F.array_max(scored)).select("track_id", "b.scale", F.least(F.lit(1.0), F.col("b.score") / 2).alias("confidence"))


def adjust_confidence(midi: Column, confidence: Column, genre: str, root: int = 0) -> Column:
    weights = F.array(*[F.lit(w) for w in GENRES[genre].pitch_weights(root)])
    return F.least(F.lit(1.0), confidence * (0.7 + 0.3 * F.element_at(weights, pitch_class(midi) + 1)))


def genre_adjust(candidates: DataFrame, keys: Sequence[str], genre: str, root: int = 0) -> DataFrame:
    """Candidates with genre-adjusted confidence, ranked inside ``keys`` (a frame or a note: a handful of rows)."""
    rows = candidates.withColumn("adjusted", adjust_confidence(F.col("midi"), F.col("confidence"), genre, root))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("adjusted"), "cand_id")))


def adjust_technique(technique: Column, confidence: Column, genre: str) -> Column:
    table = GENRES[genre].techniques
    factor = F.lit(1.0) if not table else F.coalesce(
        F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), technique), F.lit(1.0))
    return F.least(F.lit(1.0), confidence * factor)


def genre_filter_by_tempo(notes: DataFrame, tempos: DataFrame, genre: str) -> DataFrame:
    """Drop notes shorter than the genre's shortest; half as long again when the track's tempo is implausible."""
    g = GENRES[genre]
    odd = (F.col("tempo") < g.tempo[0] * 0.7) | (F.col("tempo") > g.tempo[1] * 1.3)
    return notes.join(tempos, "track_id").filter(F.col("dur_us") >= F.when(odd, g.min_dur_us * 1.5).otherwise(float(g.min_dur_us)))


def apply_genre(notes: DataFrame, genre: str) -> DataFrame:
    """Per track: suggested scale, and mean confidence before and after the genre adjustment."""
    hist = histogram(notes, F.col("dur_us") / 1e6 * F.col("confidence"))
    means = notes.groupBy("track_id").agg(
        F.avg("confidence").alias("before"), F.avg(adjust_confidence(F.col("midi"), F.col("confidence"), genre)).alias("after"))
    return suggest_scale(hist, genre).join(means, "track_id")


def _bits(mask: Column) -> Column:
    return F.bit_count(mask)


def match_scale(groups: DataFrame) -> DataFrame:
    """(…, mask of pitch classes) to the scale and root with the best (inside - outside / 2) / distinct."""
    n = _bits(F.col("mask"))
    options = [(name, root, scale_mask(steps, root)) for name, steps in RUN_SCALES.items() for root in range(12)]
    table = literal_table("m o scale root", [(m, -i, name, root) for i, (name, root, m) in enumerate(options)])
    inside = lambda t: _bits(F.col("mask").bitwiseAND(t["m"]))
    best = F.array_max(F.transform(table, lambda t: F.struct(
        ((inside(t) - (n - inside(t)) * 0.5) / n).alias("score"), t["o"].alias("o"), t["scale"].alias("scale"), t["root"].alias("root"))))
    return groups.withColumn("b", best).filter("b.score > 0").withColumn("scale", F.col("b.scale")).withColumn(
        "root", F.col("b.root")).withColumn("score", F.col("b.score")).drop("b")


def pc_mask(midi: Column) -> Column:
    return F.bit_or(F.call_function("shiftleft", F.lit(1), pitch_class(midi)))


def identify_chords(notes: DataFrame, tol_us: int = 50_000, min_score: float = 0.5, width: int = SLICE_US) -> DataFrame:
    """Chords of anchored groups: (matched/template) x (matched/played) over every root played and every template."""
    groups = group_anchored(notes, tol_us, "start_us", width).groupBy("track_id", "anchor_t").agg(
        F.count("*").alias("n_notes"), pc_mask(F.col("midi")).alias("mask"), F.avg("confidence").alias("c"),
        (F.max(F.col("start_us") + F.col("dur_us")) - F.min("start_us")).alias("dur_us"),
    )
    groups = groups.withColumn("n_pcs", _bits(F.col("mask"))).filter("n_notes >= 2 and n_pcs >= 2")
    table = literal_table("root o quality size m bit", [
        (root, -(root * 100 + i), suffix, len(steps), scale_mask([s for s in steps if s < 12], root), 1 << root)
        for root in range(12) for i, (suffix, steps) in enumerate(CHORDS)
    ])
    played = F.filter(table, lambda t: F.col("mask").bitwiseAND(t["bit"]) != 0)
    hit = lambda t: _bits(F.col("mask").bitwiseAND(t["m"]))
    scored = F.transform(played, lambda t: F.struct(
        F.when(hit(t) >= 2, (hit(t) / t["size"]) * (hit(t) / F.col("n_pcs"))).otherwise(0.0).alias("score"), t["o"].alias("o"),
        t["root"].alias("root"), t["quality"].alias("quality")))
    # one element exploded: a filter on the column would be moved below it and score every template a second time
    groups = groups.withColumn("b", F.explode(F.filter(F.array(F.array_max(scored)), lambda b: b["score"] >= min_score)))
    return groups.select(
        "track_id", F.col("anchor_t").alias("start_us"), "dur_us", "b.root", "b.quality",
        F.concat(pc_name(F.col("b.root")), F.col("b.quality")).alias("name"), (F.col("c") * F.col("b.score")).alias("confidence"), "n_notes",
    )


def chord_shapes(chords: DataFrame, tabs: DataFrame, tol_us: int = 50_000) -> DataFrame:
    """Open shape of each chord: at least 60 % of the strings the shape plays, root letters equal, first shape wins."""
    spark = chords.sparkSession
    played = {s: [int(f) for f in v.split() if f != "x"] for s, v in OPEN_SHAPES.items()}
    # a shape's root is its name without the m and 7 marks, so every shape here starts with its letter
    info = [(s, i, len(v), any(v.count(f) > 1 for f in v if f > 0)) for i, (s, v) in enumerate(played.items())]
    shapes = dim_shape(spark).join(spark.createDataFrame(info, "shape string, o int, size int, is_barre boolean"), "shape")
    c = chords.select("track_id", F.col("start_us").alias("chord_us"), F.substring("name", 1, 1).alias("letter"))
    near = range_join(c, tabs.select("track_id", "start_us", "note_id", "string", "fret"), "chord_us", "start_us", tol_us, tol_us)
    held = near.groupBy("track_id", "chord_us", "letter", "string").agg(
        F.max_by("fret", F.struct("start_us", "note_id")).alias("fret"), F.count("*").alias("n"))
    sized = held.withColumn("total", F.sum("n").over(Window.partitionBy("track_id", "chord_us")))  # six rows at most
    hits = sized.filter("total >= 2").join(F.broadcast(shapes), ["string", "fret"]).filter(F.substring("shape", 1, 1) == F.col("letter"))
    scored = hits.groupBy("track_id", "chord_us", "shape", "o", "size", "is_barre").agg(F.count("*").alias("hits")).filter(
        F.col("hits") / F.col("size") >= 0.6)
    return scored.groupBy("track_id", "chord_us").agg(F.min_by(F.struct("shape", "is_barre", "hits", "size"), "o").alias("b")).select(
        "track_id", F.col("chord_us").alias("start_us"), "b.shape", "b.is_barre", "b.hits", "b.size")


def chord_summary(chords: DataFrame, first: int = 16) -> DataFrame:
    """Count per chord name, and its places among the first chords of the track (1-based, comma separated)."""
    head = chords.withColumn("pos", F.row_number().over(Window.partitionBy("track_id").orderBy("start_us"))).filter(F.col("pos") <= first)
    places = head.groupBy("track_id", "name").agg(F.array_join(F.array_sort(F.collect_list("pos")), ",").alias("places"))
    return chords.groupBy("track_id", "name").agg(F.count("*").alias("n")).join(places, ["track_id", "name"], "left")


def time_signature(beats: DataFrame) -> DataFrame:
    """(track_id, pos, strength) to 3, 4 or 6 beats per bar by the downbeat's lead over the other positions."""
    span = beats.groupBy("track_id").agg(F.min("strength").alias("lo"), F.max("strength").alias("hi"), F.count("*").alias("n"))
    rows = beats.join(span, "track_id").withColumn("x", (F.col("strength") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1e-10))
    rows = rows.withColumn("per", F.explode(F.array(F.lit(3), F.lit(4), F.lit(6)))).filter(F.floor(F.col("n") / F.col("per")) >= 2)
    means = rows.groupBy("track_id", "per", F.pmod("pos", F.col("per")).alias("at")).agg(F.avg("x").alias("x"), F.first("n").alias("n"))
    scores = means.groupBy("track_id", "per").agg(
        (F.max(F.when(F.col("at") == 0, F.col("x"))) - F.avg(F.when(F.col("at") != 0, F.col("x")))).alias("score"), F.first("n").alias("n"))
    best = scores.groupBy("track_id").agg(F.max_by("per", F.struct("score", -F.col("per"))).alias("per"), F.first("n").alias("n"))
    out = span.select("track_id", "n").join(best.select("track_id", "per"), "track_id", "left")
    per = F.when((F.col("n") < 8) | F.col("per").isNull(), 4).otherwise(F.col("per"))
    return out.select("track_id", "n", per.alias("beats"), F.when(per == 6, 8).otherwise(4).alias("unit"))


def tempo_from_beats(beats: DataFrame, width: int = SLICE_US) -> DataFrame:
    """(track_id, method, t_us) to the tempo of the most even estimator: 60 / median gap, confidence 1 - std / median."""
    keys = ["track_id", "method"]
    rows = running(beats, ["t_us"], width, keys, prev=previous("t_us")).withColumn("gap", F.col("t_us") - F.col("prev.t_us"))
    med = group_quantile(rows, keys, "gap", 0.5, width, "median")
    spread = rows.filter("gap is not null").groupBy(*keys).agg(F.stddev_pop("gap").alias("std"), F.count("*").alias("n"))
    out = med.join(spread, keys).filter("median > 0 and n >= 2").select(
        *keys, (60e6 / F.col("median")).alias("tempo"), F.greatest(F.lit(0.0), 1 - F.col("std") / F.col("median")).alias("confidence"))
    return out.groupBy("track_id").agg(F.max_by(F.struct("method", "tempo", "confidence"), F.struct("confidence", "method")).alias("b")).select(
        "track_id", "b.method", "b.tempo", "b.confidence")


def detect_swing(notes: DataFrame, beat_us: int, min_pairs: int = 4, width: int = SLICE_US) -> DataFrame:
    """Long-short pairs that fill a beat: mean long/short ratio, swing when it lies in (1.3, 2.5)."""
    rows = halo(notes.select("track_id", "note_id", "start_us"), "start_us", width, after=int(1.2 * beat_us) + 1)
    w = slice_window(["track_id"], "start_us", "note_id")
    g1 = F.lead("start_us").over(w) - F.col("start_us")
    g2 = F.lead("start_us", 2).over(w) - F.lead("start_us").over(w)
    rows = rows.withColumn("g1", g1).withColumn("g2", g2).filter("_own")
    fits = (F.col("g1") > 0.3 * beat_us) & (F.col("g1") < 0.7 * beat_us) & (F.col("g1") + F.col("g2") > 0.8 * beat_us) & (
        F.col("g1") + F.col("g2") < 1.2 * beat_us) & (F.col("g1") > F.col("g2"))
    ratio = F.when(fits, F.col("g1") / F.greatest(F.col("g2"), F.lit(1000)))
    stats = rows.groupBy("track_id").agg(F.count("*").alias("n"), F.count(ratio).alias("pairs"), F.avg(ratio).alias("r"))
    enough = (F.col("n") >= 2 * min_pairs) & (F.col("pairs") >= min_pairs) & (F.col("r") > 1.3) & (F.col("r") < 2.5)
    return stats.select("track_id", "pairs", F.coalesce(enough, F.lit(False)).alias("has_swing"),
                        F.when(enough, F.col("r")).otherwise(1.0).alias("ratio"))


def triplets(notes: DataFrame, beat_us: int, tol: float = 0.15, width: int = SLICE_US) -> DataFrame:
    """Three notes a third of a beat apart; found triplets do not share notes, earlier ones win."""
    third = beat_us / 3
    rows = row_index(notes.select("track_id", "note_id", "start_us"), ["start_us", "note_id"], width)
    rows = halo(rows, "start_us", width, after=beat_us)
    w = slice_window(["track_id"], "start_us", "note_id")
    for i in (1, 2):
        rows = rows.withColumn(f"id{i + 1}", F.lead("note_id", i).over(w)).withColumn(f"t{i + 1}", F.lead("start_us", i).over(w))
    g1, g2 = F.col("t2") - F.col("start_us"), F.col("t3") - F.col("t2")
    ratio = g1 / F.greatest(g2, F.lit(1000))
    ok = (F.abs(g1 - third) / third < tol) & (F.abs(g2 - third) / third < tol) & (ratio > 0.8) & (ratio < 1.2)
    starts = rows.filter("_own").filter(ok)
    kept = group_anchored(starts.drop("_s", "_own"), 2, "rn", 4096)
    return kept.filter("rn = anchor_t").select("track_id", F.col("note_id").alias("id1"), "id2", "id3")
