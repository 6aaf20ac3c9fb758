"""Joins by time range, interval and frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notelake.functions.genres import RUN_SCALES
from notelake.operators.positions import fold_to_range
from notelake.operators.timeline import (
    BLOCK_ROWS, SLICE_US, Run, drift_runs, group_anchored, range_join, running, slice_of,
)

HOP_US = 23_220
HARMONICS = [12, 19, 24, 28, 31]
# Pitch limits per section type.
SECTION_LIMITS = {"solo": (55, 88), "rhythm": (40, 76)}


def interval_join(points: DataFrame, spans: DataFrame, t: str, start: str, end: str, width: int = SLICE_US, how: str = "inner") -> DataFrame:
    """Points inside half-open spans: spans are copied to the slices they cover, then an equi-join on (track, slice)."""
    s = spans.withColumn("_b", F.explode(F.sequence(slice_of(F.col(start), width), slice_of(F.greatest(F.col(start), F.col(end) - 1), width))))
    s = s.withColumnRenamed("track_id", "_k").withColumnRenamed("_b", "_c")
    p = points.withColumn("_b", slice_of(F.col(t), width))
    on = (F.col("track_id") == F.col("_k")) & (F.col("_b") == F.col("_c")) & (F.col(t) >= F.col(start)) & (F.col(t) < F.col(end))
    return p.join(s, on, how).drop("_b", "_c", "_k")


def align_detectors(contours: DataFrame, low: int = 40, high: int = 88) -> DataFrame:
    """(track_id, method, frame, frequency, confidence) of several detectors, cut to the shortest one's length and to the range."""
    ends = contours.groupBy("track_id", "method").agg(F.max("frame").alias("last")).groupBy("track_id").agg(F.min("last").alias("last"))
    rows = contours.filter("frequency > 0").withColumn("midi", F.bround(69 + 12 * F.log2(F.col("frequency") / 440.0)).cast("int"))
    return rows.filter(F.col("midi").between(low, high)).join(ends, "track_id").filter("frame <= last").drop("last")


def notes_in_sections(notes: DataFrame, sections: DataFrame, width: int = SLICE_US) -> DataFrame:
    """Each note with the first section it starts in, its pitch folded into the section's range."""
    s = sections.select("track_id", F.col("start_us").alias("s_start"), F.col("end_us").alias("s_end"), "label")
    hit = interval_join(notes, s, "start_us", "s_start", "s_end", width)
    first = hit.groupBy("track_id", "note_id").agg(F.min_by("label", F.struct("s_start", "s_end")).alias("label"))
    rows = notes.join(first, ["track_id", "note_id"], "left")
    folded = F.when(F.col("label") == "solo", fold_to_range(F.col("midi"), *SECTION_LIMITS["solo"])).when(
        F.col("label") == "rhythm", fold_to_range(F.col("midi"), *SECTION_LIMITS["rhythm"])).when(
        F.col("label").isNotNull(), fold_to_range(F.col("midi"), 40, 88)).otherwise(F.col("midi"))
    return rows.withColumn("new_midi", folded)


def onset_detail_near(onsets: DataFrame, details: DataFrame, within_us: int = 50_000) -> DataFrame:
    """First detail within reach of each onset, and whether any of them is legato."""
    d = details.select("track_id", F.col("t_us").alias("d_us"), F.col("detail_id"), "is_legato", "strength")
    near = range_join(onsets.select("track_id", "onset_id", "t_us"), d, "t_us", "d_us", within_us, within_us)
    return near.groupBy("track_id", "onset_id").agg(
        F.min_by(F.struct("detail_id", "strength"), F.struct("d_us", "detail_id")).alias("d"), F.bool_or("is_legato").alias("near_legato")
    ).select("track_id", "onset_id", "d.detail_id", "d.strength", "near_legato")


def _ahead(onsets: DataFrame, frames: DataFrame, first: int, count: int) -> DataFrame:
    """Frames ``first`` .. ``first + count - 1`` after each onset: an equi-join on exploded frame numbers."""
    keep = [c for c in onsets.columns if c not in ("midi", "confidence", "frame")]
    reach = onsets.select(*keep).withColumn("frame", F.explode(F.sequence(F.col("onset_frame") + first, F.col("onset_frame") + first + count - 1)))
    return reach.join(frames.select("track_id", "frame", "midi", F.col("confidence").alias("f_conf")), ["track_id", "frame"])


def pitch_at_onset(
    onsets: DataFrame, frames: DataFrame, vote: bool = False, min_conf: float = 0.3, min_dur_us: int = 50_000, low: int = 36, high: int = 90
) -> DataFrame:
    """Pitch of the five frames from an onset: the most confident frame, or the commonest pitch with its mean confidence.

    ``onsets``: (track_id, onset_id, onset_frame, dur_us, is_legato); legato onsets pass with lower thresholds.
    """
    near = _ahead(onsets, frames, 0, 5).filter("midi > 0")
    keys = ["track_id", "onset_id", "dur_us", "is_legato"]
    if vote:
        per = near.groupBy(*keys, "midi").agg(F.count("*").alias("n"), F.avg("f_conf").alias("c"), F.min("frame").alias("seen"))
        best = per.groupBy(*keys).agg(F.min_by(F.struct("midi", "c"), F.struct(-F.col("n"), F.col("seen"))).alias("b"))
    else:
        best = near.groupBy(*keys).agg(F.min_by(F.struct("midi", F.col("f_conf").alias("c")), F.struct(-F.col("f_conf"), F.col("frame"))).alias("b"))
    conf_cut = F.when(F.col("is_legato"), min_conf * 0.6).otherwise(min_conf)
    dur_cut = F.when(F.col("is_legato"), min_dur_us * 0.7).otherwise(float(min_dur_us))
    return best.select("track_id", "onset_id", "dur_us", "is_legato", "b.midi", F.col("b.c").alias("confidence")).filter(
        (F.col("confidence") >= conf_cut) & (F.col("dur_us") >= dur_cut) & F.col("midi").between(low, high))


def attack_vs_sustain(attacks: DataFrame, frames: DataFrame, boost: float = 0.3, start_us: int = 50_000, end_us: int = 250_000) -> DataFrame:
    """Attack pitch against the median of the sustain frames; equal pitches gain confidence."""
    f = frames.filter("is_voiced").select("track_id", F.col("t_us").alias("f_us"), F.col("midi").alias("f_midi"))
    shifted = attacks.withColumn("from_us", F.col("t_us") + start_us)
    near = range_join(shifted, f, "from_us", "f_us", 0, end_us - start_us)
    mid = near.groupBy("track_id", "onset_id").agg(F.percentile("f_midi", 0.5).alias("m")).withColumn("sustain_midi", F.bround("m").cast("int"))
    rows = attacks.join(mid.drop("m"), ["track_id", "onset_id"], "left")
    d = F.abs(F.col("midi") - F.col("sustain_midi"))
    label = F.when(d.isNull(), "none").when(d == 0, "same").when(d == 12, "octave").when(d <= 2, "close").otherwise("diff")
    return rows.withColumn("label", label).withColumn(
        "confidence", F.when(d == 0, F.least(F.lit(1.0), F.col("confidence") + boost)).otherwise(F.col("confidence")))


def chord_members(chords: DataFrame, notes: DataFrame, within_us: int = 50_000) -> DataFrame:
    """Notes starting less than ``within_us`` from a chord's start and before its end."""
    c = chords.select("track_id", F.col("start_us").alias("chord_us"), (F.col("start_us") + F.col("dur_us")).alias("chord_end"), "name")
    near = range_join(c, notes.select("track_id", "note_id", "start_us"), "chord_us", "start_us", within_us - 1, within_us - 1)
    return near.filter("start_us < chord_end").groupBy("track_id", "chord_us", "name").agg(F.array_sort(F.collect_list("note_id")).alias("note_ids"))


def overlapping_notes(notes: DataFrame, apart: int = 2, width: int = 500_000) -> DataFrame:
    """Pairs that sound together and lie more than ``apart`` semitones apart, each pair listed from both sides."""
    a = notes.select("track_id", F.col("note_id").alias("a_id"), F.col("start_us").alias("a_start"), (F.col("start_us") + F.col("dur_us")).alias("a_end"), F.col("midi").alias("a_midi"))
    b = notes.select("track_id", "note_id", "start_us", "midi")
    pairs = interval_join(b, a, "start_us", "a_start", "a_end", width)
    later = (F.col("start_us") > F.col("a_start")) | ((F.col("start_us") == F.col("a_start")) & (F.col("note_id") > F.col("a_id")))
    pairs = pairs.filter(later & (F.abs(F.col("midi") - F.col("a_midi")) > apart)).select("track_id", "a_id", "note_id")
    both = pairs.unionByName(pairs.select("track_id", F.col("note_id").alias("a_id"), F.col("a_id").alias("note_id")))
    return both.select("track_id", F.col("a_id").alias("note_id"), F.col("note_id").alias("other_id"))


def drop_harmonics(notes: DataFrame, tol_us: int = 50_000, width: int = SLICE_US) -> DataFrame:
    """Notes of an anchored group that lie a harmonic interval above a lower one of it are dropped."""
    rows = group_anchored(notes, tol_us, "start_us", width, strict=True)
    # a group is shorter than a slice: its pitches meet its rows in one shuffle
    group = Window.partitionBy("track_id", "anchor_t")
    below = F.array(*[F.col("midi") - h for h in HARMONICS])
    high = F.coalesce(F.arrays_overlap(F.collect_set("midi").over(group), below), F.lit(False))
    return rows.withColumn("_high", high).filter("not _high").drop("_high")


def dedupe_against(new: DataFrame, existing: DataFrame, within_ms: int = 50) -> DataFrame:
    """New notes without an existing one of the same pitch closer than ``within_ms``; times rounded to milliseconds."""
    n = new.withColumn("ms", F.bround(F.col("start_us") / 1000).cast("bigint"))
    e = existing.select("track_id", "midi", F.bround(F.col("start_us") / 1000).cast("bigint").alias("e_ms")).distinct()
    return range_join(n, e, "ms", "e_ms", within_ms - 1, within_ms - 1, ["track_id", "midi"], "left_anti").drop("ms")


def sample_attack_pitch(
    onsets: DataFrame, frames: DataFrame, settle: int = 2, count: int = 5, min_conf: float = 0.3, low: int = 40, high: int = 88
) -> DataFrame:
    """Pitch with the largest confidence sum in the frames after the attack settles; weak frames only where no sure one exists."""
    near = _ahead(onsets, frames, settle, count).filter("midi > 0")
    sure = near.groupBy("track_id", "onset_id").agg((F.max("f_conf") >= min_conf).alias("any_sure"))
    near = near.join(sure, ["track_id", "onset_id"]).filter(~F.col("any_sure") | (F.col("f_conf") >= min_conf)).filter(F.col("midi").between(low, high))
    per = near.groupBy("track_id", "onset_id", "midi").agg(
        F.sum("f_conf").alias("s"), F.max("f_conf").alias("c"), F.count("*").alias("n"), F.min("frame").alias("seen"),
        F.floor(F.percentile("frame", 0.5)).alias("sample_frame"))
    # sums are compared to 9 places, so the order of addition does not decide between equals
    best = per.groupBy("track_id", "onset_id").agg(F.min_by(F.struct("midi", "c", "n", "sample_frame"), F.struct(-F.round("s", 9), F.col("seen"))).alias("b"))
    return best.select("track_id", "onset_id", "b.midi", F.least(F.lit(1.0), F.col("b.c") + F.least(F.lit(0.2), F.col("b.n") * 0.05)).alias("confidence"), "b.sample_frame")


def sustained_uncovered(
    notes: DataFrame, frames: DataFrame, min_conf: float = 0.3, min_frames: int = 3, min_dur_us: int = 50_000, hop_us: int = HOP_US, width: int = BLOCK_ROWS
) -> DataFrame:
    """Frames no note covers, in runs within two semitones of the run's first pitch: commonest pitch, mean confidence."""
    first = F.ceil(F.col("start_us") / hop_us).cast("bigint")
    stop = F.ceil((F.col("start_us") + F.col("dur_us")) / hop_us).cast("bigint")
    covered = notes.select("track_id", first.alias("a"), stop.alias("b")).filter("b > a").select(
        "track_id", F.explode(F.sequence(F.col("a"), F.col("b") - 1)).alias("frame")).distinct()
    ends = frames.groupBy("track_id").agg(F.max("frame").alias("last"))
    free = frames.filter((F.col("midi") > 0) & (F.col("confidence") >= min_conf)).join(covered, ["track_id", "frame"], "left_anti")
    runs = free.join(drift_runs(free, 2, width=width), ["track_id", "frame"])
    votes = runs.groupBy("track_id", "run_frame", "midi").agg(F.count("*").alias("n"), F.sum("confidence").alias("c"), F.min("frame").alias("seen"))
    out = votes.groupBy("track_id", "run_frame").agg(
        F.min_by("midi", F.struct(-F.col("n"), F.col("seen"))).alias("midi"), F.sum("n").alias("n_frames"), (F.sum("c") / F.sum("n")).alias("confidence"))
    out = out.filter(F.col("n_frames") >= min_frames).join(ends, "track_id")
    # a run ends at the next frame, or at the last frame where the track stops
    length = F.least(F.col("run_frame") + F.col("n_frames"), F.col("last")) - F.col("run_frame")
    return out.select("track_id", "run_frame", "midi", "n_frames", "confidence", (length * hop_us).alias("dur_us")).filter(F.col("dur_us") >= min_dur_us)


def pitch_between_onsets(onsets: DataFrame, frames: DataFrame, width: int = BLOCK_ROWS) -> DataFrame:
    """Frames from each onset to the next: whole part of the median voiced pitch and mean confidence of all frames."""
    marks = onsets.select("track_id", "frame").distinct().withColumn("mark", F.lit(True))
    rows = frames.join(marks, ["track_id", "frame"], "left")
    rows = running(rows, ["frame"], width, onset=Run("last", F.when(F.col("mark"), F.col("frame")))).filter("onset is not null")
    return rows.groupBy("track_id", "onset").agg(
        F.floor(F.percentile(F.when(F.col("midi") > 0, F.col("midi")), 0.5)).alias("midi"), F.avg("confidence").alias("confidence"),
        F.count("*").alias("n_frames")).filter("midi is not null")


def with_frame(onsets: DataFrame, hop_us: int = HOP_US) -> DataFrame:
    return onsets.withColumn("onset_frame", F.floor(F.col("t_us") / hop_us).cast("bigint"))


def fill_scale_gaps(rows: DataFrame, scales: DataFrame, frames: DataFrame, hop_us: int = HOP_US) -> DataFrame:
    """Scale notes missing between pitch neighbours of a run, where the frame at their expected time sounds within a semitone.

    ``rows``: notes with (track_id, first_id of the run, start_us, end_us, midi); ``scales``: (track_id, first_id, scale, root).
    """
    w = Window.partitionBy("track_id", "first_id").orderBy("midi", "start_us", "end_us")
    pairs = rows.select("track_id", "first_id", "midi", "start_us", "end_us", *[F.lead(c).over(w).alias(f"n_{c}") for c in ("midi", "start_us", "end_us")])
    pairs = pairs.withColumn("gap", F.col("n_midi") - F.col("midi")).filter("gap > 2").join(scales, ["track_id", "first_id"])
    steps = F.create_map(*[x for name, s in RUN_SCALES.items() for x in (F.lit(name), F.array(*[F.lit(i) for i in s]))])
    want = pairs.withColumn("off", F.explode(F.sequence(F.lit(1), F.col("gap") - 1))).withColumn("want", F.col("midi") + F.col("off"))
    want = want.filter(F.array_contains(F.try_element_at(steps, F.col("scale")), F.pmod(F.col("want") - F.col("root"), F.lit(12)).cast("int")))
    at = F.col("end_us") + (F.col("n_start_us") - F.col("end_us")) * (F.col("off") / F.col("gap"))
    want = want.withColumn("at_us", at).withColumn("stop_us", F.col("at_us") + (F.col("n_end_us") - F.col("n_start_us")) / F.col("gap"))
    want = want.withColumn("frame", F.floor(F.col("at_us") / hop_us).cast("bigint"))
    heard = frames.filter("midi > 0").select("track_id", "frame", F.col("midi").alias("f_midi"), F.col("confidence").alias("f_conf"))
    return want.join(heard, ["track_id", "frame"]).filter(F.abs(F.col("f_midi") - F.col("want")) <= 1).select(
        "track_id", "first_id", F.col("want").alias("midi"), F.col("at_us").alias("start_us"), F.col("stop_us").alias("end_us"), (F.col("f_conf") * 0.7).alias("confidence"))
