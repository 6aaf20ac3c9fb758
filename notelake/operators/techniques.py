"""Playing techniques between and on notes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notelake.functions.dims import NUM_FRETS, tuning_notes
from notelake.operators.segment import tremolo_notes
from notelake.operators.timeline import SLICE_US, following, halo, previous, running
from notelake.session import checkpointed

ORDER = ["start_us", "note_id"]


def _with_next(tabs: DataFrame, *cols: str, width: int) -> DataFrame:
    rows = tabs.withColumn("end_us", F.col("start_us") + F.col("dur_us"))
    return running(rows, ORDER, width, nxt=following("start_us", "midi", "string", "fret", *cols))


def hammer_pull(tabs: DataFrame, max_gap_us: int = 150_000, width: int = SLICE_US) -> DataFrame:
    """A legato note close after another pitch makes the note *before* it a hammer-on or pull-off source."""
    rows = _with_next(tabs, "is_legato", width=width)
    d = F.col("nxt.midi") - F.col("midi")
    hit = F.col("nxt.is_legato") & (F.col("nxt.start_us") - F.col("end_us") <= max_gap_us) & (d != 0)
    return rows.filter(hit).select(
        "track_id", "note_id", F.when(d > 0, "hammer_on").otherwise("pull_off").alias("technique"), F.col("nxt.fret").alias("target_fret"),
        F.when(F.col("nxt.string") == F.col("string"), 0.9).otherwise(0.7).alias("confidence"))


def slides(tabs: DataFrame, max_gap_us: int = 80_000, low: int = 2, high: int = 12, width: int = SLICE_US) -> DataFrame:
    """Same string, close, 2 to 12 semitones, next note plucked, and the note's last pitch (``end_pitch``) on the way.

    Without an end pitch a note under 200 ms counts.
    """
    rows = _with_next(tabs, "is_legato", width=width)
    d, end, to = F.col("nxt.midi") - F.col("midi"), F.col("end_pitch"), F.col("nxt.midi")
    between = F.when(d > 0, (end >= F.col("midi")) & (end <= to + 0.5)).otherwise((end >= to - 0.5) & (end <= F.col("midi")))
    on_way = F.when(end.isNotNull(), between).otherwise(F.col("dur_us") < 200_000)
    hit = (F.col("nxt.string") == F.col("string")) & (F.col("nxt.start_us") - F.col("end_us") <= max_gap_us) & F.abs(d).between(low, high)
    return rows.filter(hit & ~F.col("nxt.is_legato") & on_way).select(
        "track_id", "note_id", F.when(d > 0, "slide_up").otherwise("slide_down").alias("technique"), F.col("nxt.fret").alias("target_fret"), F.lit(0.8).alias("confidence"))


def link_technique(tabs: DataFrame, width: int = SLICE_US) -> DataFrame:
    """Export rule by the note before on the same string: hammer or pull to 4 semitones within 80 ms, then slide within 50 ms."""
    rows = tabs.withColumn("end_us", F.col("start_us") + F.col("dur_us"))
    rows = running(rows, ORDER, width, prev=previous("end_us", "midi", "string"))
    gap, d = F.col("start_us") - F.col("prev.end_us"), F.col("midi") - F.col("prev.midi")
    kind = F.when(F.col("prev.string") == F.col("string"), F.when((gap < 80_000) & d.between(1, 4), "hammer-on").when(
        (gap < 80_000) & d.between(-4, -1), "pull-off").when((gap < 50_000) & (F.abs(d) >= 2), "slide"))
    return rows.withColumn("technique", kind).withColumn("technique_target", F.when(kind.isNotNull(), F.col("fret"))).drop("prev", "end_us")


def highest_fret(midi: Column, tuning: str = "standard") -> Column:
    frets = [F.when((midi - m).between(0, NUM_FRETS), midi - m) for m in tuning_notes(tuning)]
    return F.greatest(*frets)


def tap_candidates(notes: DataFrame, min_interval: int = 7, min_fret: int = 10, weak: float = 0.4, width: int = SLICE_US) -> DataFrame:
    """Wide leaps and high frets scored as taps; needs ``is_legato`` and ``attack_strength``. ``valid`` applies the three rules."""
    rows = running(notes, ORDER, width, prev=previous("midi"), nxt=following("midi"))
    back = F.coalesce(F.abs(F.col("midi") - F.col("prev.midi")), F.lit(0))
    ahead = F.coalesce(F.abs(F.col("nxt.midi") - F.col("midi")), F.lit(0))
    rows = rows.withColumn("back", back).withColumn("ahead", ahead).withColumn("fret", highest_fret(F.col("midi")))
    high_leap = (F.col("fret") >= min_fret) & (F.col("ahead") >= min_interval)
    rows = rows.filter(F.col("fret").isNotNull() & ((F.col("back") >= min_interval) | high_leap))
    wide = F.greatest("back", "ahead")
    conf = (
        F.when(wide >= 12, 0.4).when(wide >= 7, 0.2).otherwise(0.0)
        + F.when(F.col("fret") >= 15, 0.3).when(F.col("fret") >= 12, 0.2).when(F.col("fret") >= 10, 0.1).otherwise(0.0)
        + F.when(F.col("is_legato"), 0.2).otherwise(0.0) + F.when(F.col("attack_strength") < weak, 0.2).otherwise(0.0)
    )
    rows = rows.withColumn("confidence", F.round(conf, 6))
    rule = ((F.col("back") >= min_interval) & (F.col("attack_strength") < weak)) | high_leap | (F.col("is_legato") & (F.col("back") >= 10))
    return rows.withColumn("valid", (F.col("confidence") >= 0.4) & rule).drop("prev", "nxt")


def duration_to_next(onsets: DataFrame, track_ends: DataFrame | None = None, tail_us: int = 500_000, width: int = SLICE_US) -> DataFrame:
    """Time to the next onset; the last one lasts to the track's end, or ``tail_us`` without one."""
    rows = running(onsets, ["t_us", "onset_id"], width, nxt=following("t_us"))
    if track_ends is None:
        return rows.withColumn("dur_us", F.coalesce(F.col("nxt.t_us") - F.col("t_us"), F.lit(tail_us))).drop("nxt")
    rows = rows.join(track_ends, "track_id", "left")
    last = F.coalesce(F.col("end_us") - F.col("t_us"), F.lit(tail_us))
    return rows.withColumn("dur_us", F.coalesce(F.col("nxt.t_us") - F.col("t_us"), last)).drop("nxt", "end_us")


def tap_patterns(taps: DataFrame, notes: DataFrame, reach_us: int = 500_000, min_len: int = 3, width: int = SLICE_US) -> DataFrame:
    """A tap and up to three later notes, each within ``reach_us`` of the one before; arpeggio, sequence or mixed.

    Notes at the tap's own time do not count. A note without a fret ends the chain.
    """
    all_notes = notes.select("track_id", "note_id", "start_us", "midi", highest_fret(F.col("midi")).alias("fret"))
    rows = halo(all_notes, "start_us", width, after=3 * reach_us)
    ahead = Window.partitionBy("track_id", "_s").orderBy("start_us").rangeBetween(1, 3 * reach_us)
    later = F.collect_list(F.struct(F.col("start_us").alias("t"), "note_id", "midi", "fret")).over(ahead)
    rows = rows.withColumn("later", F.slice(F.array_sort(later), 1, 3)).filter("_own").drop("_s", "_own")
    step = (
        f"aggregate(later, struct(start_us as t, array(midi) as ms, true as open), (acc, x) -> "
        f"if(acc.open and x.t - acc.t <= {reach_us} and x.fret is not null, struct(x.t as t, concat(acc.ms, array(x.midi)) as ms, true as open), "
        "struct(acc.t as t, acc.ms as ms, false as open))).ms"
    )
    rows = rows.join(taps.select("track_id", "note_id", "confidence"), ["track_id", "note_id"]).withColumn("ms", F.expr(step))
    rows = rows.filter(F.size("ms") >= min_len).withColumn("ds", F.expr("transform(sequence(2, size(ms)), i -> element_at(ms, i) - element_at(ms, i - 1))"))
    sizes = F.size(F.array_distinct(F.transform(F.filter("ds", lambda d: d != 0), lambda d: F.abs(d))))
    falls = F.size(F.filter("ds", lambda d: d < 0))
    kind = F.when(sizes <= 2, "arpeggio").when(falls >= F.size("ds") - 1, "sequence").otherwise("mixed")
    return rows.select("track_id", "note_id", F.size("ms").alias("n"), kind.alias("kind"), F.array_join(F.col("ms").cast("array<string>"), "-").alias("pitches"), "confidence")


def best_technique(notes: DataFrame, detections: DataFrame) -> DataFrame:
    """Per note the detected technique of highest confidence, else normal with 1 - the best rejected confidence.

    ``detections``: (track_id, note_id, technique, confidence, detected, ord), one row per classifier.
    """
    best = detections.groupBy("track_id", "note_id").agg(
        F.max_by("technique", F.when(F.col("detected"), F.struct("confidence", -F.col("ord")))).alias("found"),
        F.max(F.when(F.col("detected"), F.col("confidence"))).alias("top"), F.max("confidence").alias("most"))
    return notes.join(best, ["track_id", "note_id"], "left").select(
        "track_id", "note_id", F.coalesce("found", F.lit("normal")).alias("technique"), F.coalesce("top", 1 - F.coalesce("most", F.lit(0.0))).alias("confidence"))


def bends(curves: DataFrame, least: float = 0.3) -> DataFrame:
    """Notes whose smoothed pitch rises ``least`` semitones and more above its start, with the top after the first tenth.

    ``curves``: (track_id, note_id, frame, pitch, fret), voiced frames only. The curve is smoothed by a Gaussian of one
    frame, mirrored at its ends; a note's frames are few, so they are held as an array.
    """
    raw = [math.exp(-0.5 * k * k) for k in range(-4, 5)]
    weights = [x / sum(raw) for x in raw]
    rows = curves.groupBy("track_id", "note_id", "fret").agg(F.array_sort(F.collect_list(F.struct("frame", "pitch"))).alias("c")).select(
        "track_id", "note_id", "fret", F.col("c.pitch").alias("x")).filter(F.size("x") >= 3)
    n = F.size("x")

    def mirrored(i: Column) -> Column:
        m = F.pmod(i, 2 * n)
        return F.get("x", F.when(m >= n, 2 * n - 1 - m).otherwise(m))

    smooth = F.transform(F.sequence(F.lit(0), n - 1), lambda i: sum((mirrored(i + k - 4) * w for k, w in enumerate(weights)), F.lit(0.0)))
    rows = rows.withColumn("s", smooth)
    # the first top to 9 places, so sums taken in another order do not decide between equals
    s9 = F.transform("s", lambda v: F.round(v, 9))
    bend = F.array_max("s") - F.get("s", F.lit(0))
    rows = rows.withColumn("bend", bend).withColumn("top", F.array_position(s9, F.array_max(s9)) - 1)
    return rows.filter((F.col("bend") >= least) & (F.col("top") > n * 0.1)).select(
        "track_id", "note_id", "bend", (F.col("fret") + F.bround("bend")).cast("int").alias("target_fret"), F.least(F.lit(1.0), F.col("bend") / 2).alias("confidence"))


def _two_tops(n: int, bins: list[int], counts: list[int]) -> tuple[int, int] | None:
    """Bins of the two highest tops of a smoothed histogram of ``n`` bins, if there are two."""
    h = np.zeros(n)
    for k, c in zip(bins, counts, strict=True):
        if 0 <= k < n:
            h[k] = c
    raw, s, at = [math.exp(-2.0 * k * k) for k in range(-2, 3)], np.zeros(n), np.arange(n)
    for k, w in enumerate(raw):
        m = (at + k - 2) % (2 * n)
        s = s + h[np.where(m >= n, 2 * n - 1 - m, m)] * (w / sum(raw))
    s = np.round(s, 9)  # so sums taken in another order do not decide between equals
    # even stretches: where each begins, and the next one after it
    begin = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    height, end = s[begin], np.r_[begin[1:], n]
    is_top = np.zeros(len(begin), bool)
    is_top[1:-1] = (height[1:-1] > height[:-2]) & (height[1:-1] > height[2:]) & (height[1:-1] >= 0.25 * s.max())
    tops = sorted(zip(height[is_top].tolist(), ((begin + end - 1) // 2)[is_top].tolist(), strict=True), reverse=True)
    return (tops[0][1], tops[1][1]) if len(tops) > 1 else None


def _highest_tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of notes with the columns ``n_bins``, ``bins`` and ``counts`` at their end; the notes with two tops, the bins of these instead of the histogram."""
    for batch in batches:
        found = [_two_tops(*(c[i].as_py() for c in batch.columns[-3:])) for i in range(batch.num_rows)]
        rows = [i for i, tops in enumerate(found) if tops]
        kept = batch.take(pa.array(rows, pa.int64()))
        tops = [pa.array([found[i][k] for i in rows], pa.int32()) for k in range(2)]
        yield pa.RecordBatch.from_arrays([*kept.columns[:-2], *tops], names=[*batch.schema.names[:-2], "top", "second"])


def trills(curves: DataFrame, notes: DataFrame, width: int = 4096) -> DataFrame:
    """Notes of a quarter second or more that alternate fast between two pitch centres 0.8 to 3.5 semitones apart.

    ``curves``: (track_id, note_id, frame, pitch) with pitch 0 where there is none; ``notes``: (track_id, note_id, dur_us, fret). The centres are the two highest tops of the
    note's histogram of quarter semitones, smoothed by a Gaussian of half a bin mirrored at its ends; tops reach a quarter of the highest, an even top counts
    once and one at an end not at all, of equal tops the later ones count. The curve crosses its mean 10 to 35 times a second. Histograms
    and crossings are counted over frames in any number of tasks; a note is held only as its histogram, which the range of pitches bounds.
    """
    key = ["track_id", "note_id"]
    voiced = curves.filter("pitch > 0").select(*key, "frame", F.col("pitch").cast("double").alias("pitch"))
    stats = voiced.groupBy(*key).agg(F.count("*").alias("n"), F.min("pitch").alias("low"), F.max("pitch").alias("high"), F.avg("pitch").alias("mean"))
    stats = stats.filter("n >= 15 and high > low").withColumn("n_bins", F.greatest(F.floor((F.col("high") - F.col("low")) / 0.25).cast("int") + 1, F.lit(4)))
    stats = checkpointed(stats.join(notes.filter("dur_us >= 250000").select(*key, "dur_us", "fret"), key))
    rows = voiced.join(stats.select(*key, "low", "high", "mean", "n_bins"), key)
    place = F.least(F.floor((F.col("pitch") - F.col("low")) / (F.col("high") - F.col("low")) * F.col("n_bins")).cast("int"), F.col("n_bins") - 1)
    bins = rows.groupBy(*key, place.alias("bin")).agg(F.count("*").alias("c")).groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("bin", "c"))).alias("held"))
    side = running(rows.withColumn("side", F.signum(F.round(F.col("pitch") - F.col("mean"), 9))).select(*key, "frame", "side"), ["frame"], width, key, before=previous("side"))
    crossed = side.groupBy(*key).agg(F.count_if(F.col("side") != F.col("before.side")).alias("crossings"))
    found = stats.join(bins, key).join(crossed, key).select(
        *key, "dur_us", "fret", "low", "high", "crossings", "n_bins", F.map_keys("held").alias("bins"), F.map_values("held").alias("counts"))
    tops = [T.StructField(c, T.IntegerType()) for c in ("top", "second")]
    found = found.mapInArrow(_highest_tops, T.StructType([*found.schema.fields[:-2], *tops]))
    interval = F.abs(F.col("top") - F.col("second")) * (F.col("high") - F.col("low")) / F.col("n_bins")
    rate = F.col("crossings") / (F.col("dur_us") / 1e6)
    return found.withColumns({"interval": interval, "rate": rate}).filter(F.round("interval", 9).between(0.8, 3.5) & F.col("rate").between(10, 35)).select(
        *key, "interval", "rate", (F.col("fret") + F.bround(F.round("interval", 9)).cast("int")).alias("target_fret"), F.least(F.lit(1.0), F.col("rate") / 20).alias("confidence"))


def annotate_techniques(
    tabs: DataFrame, bend_rows: DataFrame, min_fret: int = 10, min_interval: int = 7, width: int = SLICE_US, trill_rows: DataFrame | None = None
) -> DataFrame:
    """One technique per note, by precedence: hammer or pull, bend, slide, trill, tremolo on notes still free; a tap may
    replace a hammer or pull.

    ``tabs`` carry string, fret, is_legato, end_pitch and attack_strength; ``bend_rows`` come from ``bends``, ``trill_rows`` from ``trills``.
    """
    keys = ["track_id", "note_id"]
    named = lambda df, n: df.select(*keys, F.struct("technique", "target_fret", "confidence").alias(n))
    bent = bend_rows.select(*keys, F.lit("bend").alias("technique"), "target_fret", "confidence")
    steps = [hammer_pull(tabs, width=width), bent, slides(tabs, width=width)]
    if trill_rows is not None:
        steps.append(trill_rows.select(*keys, F.lit("trill").alias("technique"), "target_fret", "confidence"))
    names = [f"t{i}" for i in range(1, len(steps) + 1)]
    rows = tabs
    for df, n in zip(steps, names, strict=True):
        rows = rows.join(named(df, n), keys, "left")
    rows = checkpointed(rows.withColumn("t", F.coalesce(*names)).drop(*names))
    shake = tremolo_notes(rows, width=width, skip=F.col("t").isNotNull()).select(
        *keys, F.struct(F.lit("tremolo").alias("technique"), F.lit(None).cast("int").alias("target_fret"), F.least(F.lit(1.0), F.col("rate") / 15).alias("confidence")).alias("t4"))
    rows = rows.join(shake, keys, "left").withColumn("t", F.coalesce("t", "t4")).drop("t4")
    rows = running(rows, ORDER, width, prev=previous("midi"), nxt=following("midi", "fret"))
    soft = (F.col("attack_strength") < 0.5) | F.col("is_legato")
    down = (F.col("midi") - F.col("nxt.midi")) >= min_interval
    up = F.coalesce((F.col("midi") - F.col("prev.midi")) >= min_interval, F.lit(False))
    free = F.col("t").isNull() | F.col("t.technique").isin("hammer_on", "pull_off")
    tap = F.col("nxt").isNotNull() & free & (F.col("fret") >= min_fret) & soft & (down | up)
    tapped = F.struct(F.lit("tap").alias("technique"), F.col("nxt.fret").alias("target_fret"), F.when(F.col("is_legato"), 0.8).otherwise(0.6).alias("confidence"))
    rows = rows.withColumn("t", F.when(F.coalesce(tap, F.lit(False)), tapped).otherwise(F.col("t")))
    return rows.select(*keys, F.coalesce("t.technique", F.lit("none")).alias("technique"), "t.target_fret", F.coalesce("t.confidence", F.lit(0.0)).alias("confidence"))
