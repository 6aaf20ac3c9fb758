"""Window operators on frames: smoothing, continuity, gaps, density, fast regions, legato onsets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notelake.operators.timeline import BLOCK_ROWS, following, group_anchored, halo, range_join, running, slice_window

HOP_US = 23_220


def _near(low: int, high: int, keys: Sequence[str] = ("track_id",), order: str = "frame"):
    return Window.partitionBy(*keys, "_s").orderBy(order).rangeBetween(low, high)


def _middle(values: Column) -> Column:
    """Median of a short array, null when empty."""
    s, n = F.array_sort(values), F.size(values)
    at = lambda i: F.element_at(s, i.cast("int"))
    return F.when(n > 0, (at(F.floor((n + 1) / 2)) + at(F.floor((n + 2) / 2))) / 2)


def median_smooth(frames: DataFrame, k: int = 5, value: str = "midi", width: int = BLOCK_ROWS) -> DataFrame:
    """Running median of ``k`` frames, unvoiced ones and the outside counting as 0; only voiced frames change."""
    k += 1 - k % 2
    half = k // 2
    rows = halo(frames, "frame", width, before=half, after=half)
    seen = F.collect_list(F.col(value).cast("double")).over(_near(-half, half))
    padded = F.concat(seen, F.array_repeat(F.lit(0.0), F.lit(k) - F.size(seen)))
    smooth = F.element_at(F.array_sort(padded), half + 1)
    rows = rows.withColumn("smooth", F.when(F.col(value) > 0, smooth).otherwise(F.col(value).cast("double")))
    conf = F.sum("confidence").over(_near(-half, half)) / k
    rows = rows.withColumn("smooth_conf", conf).filter("_own").drop("_s", "_own")
    short = frames.groupBy("track_id").agg((F.count("*") < k).alias("short"))
    return rows.join(short, "track_id").withColumn(
        "smooth_conf", F.when(F.col("short"), F.col("confidence")).otherwise(F.col("smooth_conf"))).drop("short")


def continuity_check(
    frames: DataFrame, reach: int = 5, max_jump: int = 12, low: int = 40, high: int = 88, width: int = BLOCK_ROWS
) -> DataFrame:
    """Frames far from the median of their neighbours are invalid unless an octave shift brings them close."""
    rows = halo(frames.withColumn("m", F.when(F.col("midi") > 0, F.col("midi"))), "frame", width, before=reach, after=reach)
    around = F.concat(F.collect_list("m").over(_near(-reach, -1)), F.collect_list("m").over(_near(1, reach)))
    rows = rows.withColumn("mid", F.floor(_middle(around)).cast("int")).filter("_own").drop("_s", "_own")
    jump = F.abs(F.col("m") - F.col("mid")) > max_jump
    down, up = F.abs(F.col("m") - 12 - F.col("mid")) <= 3, F.abs(F.col("m") + 12 - F.col("mid")) <= 3
    fixed = F.when(jump & down, F.col("m") - 12).when(jump & up, F.col("m") + 12).otherwise(F.col("m"))
    moved = jump & (down | up)
    ok = ~F.coalesce(jump, F.lit(False)) | F.coalesce(moved, F.lit(False))
    rows = rows.withColumn("new_midi", F.coalesce(fixed, F.lit(0))).withColumn(
        "new_conf", F.when(F.col("m").isNull(), 0.0).when(moved, F.col("confidence") * 0.8).otherwise(F.col("confidence")))
    return rows.withColumn("is_valid", F.col("m").isNotNull() & ok & F.col("new_midi").between(low, high)).drop("m", "mid")


def fill_gaps(frames: DataFrame, max_gap: int = 3, mode: str = "constant", width: int = BLOCK_ROWS) -> DataFrame:
    """Short invalid stretches between pitches at most two semitones apart: their mean, a line in Hz (``linear``) or in midi (``midi``).

    ``frames``: one row per frame with midi and is_valid.
    """
    rows = halo(frames, "frame", width, before=max_gap, after=max_gap)
    good = F.when(F.col("is_valid") & (F.col("midi") > 0), F.struct("frame", "midi"))
    rows = rows.withColumn("a", F.last(good, True).over(_near(-max_gap, -1))).withColumn("b", F.first(good, True).over(_near(1, max_gap)))
    rows = rows.filter("_own").drop("_s", "_own")
    gap = F.col("b.frame") - F.col("a.frame") - 1
    empty = ~F.col("is_valid") | (F.col("midi") == 0)
    fill = F.coalesce(empty & (gap <= max_gap) & (F.abs(F.col("a.midi") - F.col("b.midi")) <= 2), F.lit(False))
    hz = lambda m: F.lit(440.0) * F.pow(F.lit(2.0), (m - 69) / 12.0)
    own = F.when(F.col("midi") > 0, hz(F.col("midi"))).otherwise(0.0)
    rows = rows.withColumn("filled", fill)
    if mode == "constant":
        new = F.bround((F.col("a.midi") + F.col("b.midi")) / 2)
        return rows.withColumn("midi", F.when(F.col("filled"), new).otherwise(F.col("midi")).cast("int")).withColumn(
            "is_valid", F.col("is_valid") | F.col("filled")).withColumn(
            "confidence", F.when(F.col("filled"), 0.5).otherwise(F.col("confidence"))).drop("a", "b")
    t = (F.col("frame") - F.col("a.frame")) / (gap + 1)
    if mode == "midi":
        line = hz(F.col("a.midi") + (F.col("b.midi") - F.col("a.midi")) * t)
    elif mode == "linear":
        line = hz(F.col("a.midi")) * (1 - t) + hz(F.col("b.midi")) * t
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return rows.withColumn("frequency", F.when(F.col("filled"), line).otherwise(own)).withColumn(
        "confidence", F.when(F.col("filled"), 0.3).otherwise(F.col("confidence"))).drop("a", "b")


def note_density(
    frames: DataFrame, onsets: DataFrame, window: int = 20, fast: float = 8.0, slow: float = 4.0, hop_us: int = HOP_US, width: int = BLOCK_ROWS
) -> DataFrame:
    """Onsets per second in a centred window of frames, averaged over five frames mirrored at the ends; fast and slow flags."""
    half = window // 2
    # frames, onsets and the end of each track meet in one shuffle, in slices that reach far enough for both windows
    kind = lambda df, k, frame="frame", n="cast(null as bigint)": df.selectExpr("track_id", f"cast({frame} as bigint) as frame", f"{k} as kind", f"{n} as n")
    ends = frames.groupBy("track_id").agg((F.max("frame") + 1).cast("bigint").alias("n"))
    rows = kind(frames, 0).unionByName(kind(onsets, 1)).unionByName(kind(ends, 2, "n - 1", "n")).filter("track_id is not null")
    # a fixed number of partitions, so none is merged with others into one large task
    parts = int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = halo(rows, "frame", width, before=half + 2, after=half + 2).repartition(parts, "track_id", "_s")
    # the end is known in the slices it reaches; elsewhere it changes nothing
    rows = rows.withColumn("hit", F.max(F.when(F.col("kind") < 2, F.col("kind"))).over(_near(0, 0)))
    rows = rows.withColumn("n", F.max("n").over(Window.partitionBy("track_id", "_s"))).filter("kind = 0").drop("kind")
    length = F.least(F.col("n"), F.col("frame") + half) - F.greatest(F.lit(0), F.col("frame") - half)
    rows = rows.withColumn("raw", F.sum("hit").over(_near(-half, half - 1)) / (length * hop_us / 1e6))
    # two mirrored frames on either end
    head = F.when(F.col("frame") < 2, -1 - F.col("frame"))
    tail = F.when(F.col("frame") >= F.col("n") - 2, 2 * F.col("n") - 1 - F.col("frame"))
    wide = rows.withColumn("frame", F.explode(F.array_compact(F.array(F.col("frame"), head, tail))))
    wide = wide.withColumn("density", F.avg("raw").over(_near(-2, 2))).filter("_own and frame >= 0 and (n is null or frame < n)")
    return wide.select("track_id", "frame", "density", (F.col("density") > fast).alias("is_fast"), (F.col("density") < slow).alias("is_slow"))


def fast_regions(frames: DataFrame, size: int = 12, width: int = BLOCK_ROWS) -> DataFrame:
    """Windows of ``size`` frames, mostly voiced, with three steps of 1 to 5 semitones: all their frames are fast."""
    n = frames.groupBy("track_id").agg((F.max("frame") + 1).alias("n"))
    rows = halo(frames.join(n, "track_id"), "frame", width, before=size, after=size)
    w = Window.partitionBy("track_id", "_s").orderBy("frame")
    step = F.coalesce(F.abs(F.col("midi") - F.lag("midi").over(w)), F.lit(0))
    rows = rows.withColumn("change", step.between(1, 5).cast("int"))
    ahead = _near(0, size - 1)
    hot = (F.sum("change").over(ahead) >= 3) & (F.avg(F.col("is_voiced").cast("double")).over(ahead) > 0.7) & (F.col("frame") < F.col("n") - size)
    rows = rows.withColumn("hot", hot.cast("int"))
    rows = rows.withColumn("is_fast", F.max("hot").over(_near(-(size - 1), 0)) == 1)
    return rows.filter("_own").drop("_s", "_own", "change", "hot", "n")


def legato_onsets(
    frames: DataFrame, min_frames: int = 3, base: float = 0.3, fast: float = 0.15, low_attack: float = 0.3, width: int = BLOCK_ROWS
) -> DataFrame:
    """Voiced pitch changes with a weak attack, or any change in a fast region; accepted ones keep ``min_frames`` apart.

    Needs ``onset_env``, ``attack_env`` and ``is_fast``. The spacing counts from the last accepted onset, so the
    accepted ones are the anchors of the strict grouping of candidate frames.
    """
    n = frames.groupBy("track_id").agg((F.max("frame") + 1).alias("n"))
    rows = halo(frames.join(n, "track_id"), "frame", width, before=1)
    w = Window.partitionBy("track_id", "_s").orderBy("frame")
    change = F.coalesce(F.abs(F.col("midi") - F.lag("midi").over(w)), F.lit(0)) >= 0.5
    rows = rows.withColumn("change", change).filter("_own").drop("_s", "_own")
    weak = F.col("attack_env") < low_attack
    legato = F.col("change") & weak
    quick = F.col("is_fast") & ((F.col("onset_env") > F.when(F.col("is_fast"), fast).otherwise(base)) | F.col("change"))
    inner = F.col("frame").between(1, F.col("n") - 2)
    cands = rows.filter(F.col("is_voiced") & inner & (legato | quick)).select(
        "track_id", "frame", "n", F.when(legato, F.least(F.lit(1.0), F.col("confidence") + 0.2)).otherwise(F.col("confidence")).alias("onset_conf"))
    return group_anchored(cands, min_frames, "frame", width, strict=True).filter("frame = anchor_t").drop("anchor_t")


def legato_jumps(
    frames: DataFrame, onsets: DataFrame, least: float = 1.5, quiet: float = 0.3, apart: int = 5, width: int = BLOCK_ROWS
) -> DataFrame:
    """Frames in which the pitch jumps by ``least`` semitones without an attack (``energy`` below ``quiet``) and no onset is nearer than ``apart`` frames.

    ``frames``: (track_id, frame, midi, energy), ``onsets``: (track_id, frame). A track's first and last frame are none. Only jumps meet the onsets.
    """
    n = frames.groupBy("track_id").agg((F.max("frame") + 1).alias("n"))
    rows = halo(frames.select("track_id", "frame", "midi", "energy"), "frame", width, before=1)
    jump = F.abs(F.col("midi") - F.lag("midi").over(slice_window(["track_id"], "frame")))
    rows = rows.withColumn("jump", jump).filter("_own").filter((F.col("jump") >= least) & (F.col("energy") < quiet)).join(n, "track_id")
    rows = rows.filter(F.col("frame").between(1, F.col("n") - 2)).select("track_id", "frame", F.lit(0.6).alias("confidence"), F.col("energy").alias("attack_strength"))
    marks = onsets.select("track_id", F.col("frame").alias("o_frame"))
    near = range_join(rows, marks, "frame", "o_frame", apart - 1, apart - 1).select("track_id", "frame").distinct()
    return rows.join(near, ["track_id", "frame"], "left_anti")


def legato_notes(
    onsets: DataFrame, frames: DataFrame, min_frames: int = 3, max_frames: int = 80, low: int = 40, high: int = 88, width: int = BLOCK_ROWS
) -> DataFrame:
    """Accepted onsets to notes: up to the next onset, pitch = median of the first ten voiced frames."""
    rows = running(onsets, ["frame"], width, nxt=following("frame"))
    end = F.coalesce(F.col("nxt.frame"), F.least(F.col("frame") + max_frames, F.col("n") - 1))
    rows = rows.withColumn("end", end)
    fits, longer = F.col("end") - F.col("frame") >= min_frames, F.col("frame") + min_frames
    rows = rows.filter(fits | (longer < F.col("n"))).withColumn("end", F.when(fits, F.col("end")).otherwise(longer))
    rows = rows.select("track_id", F.col("frame").alias("onset"), "end", "onset_conf",
                       F.explode(F.sequence(F.col("frame"), F.least(F.col("frame") + 10, F.col("end")) - 1)).alias("frame"))
    heard = frames.filter("midi > 0").select("track_id", "frame", "midi", "confidence")
    out = rows.join(heard, ["track_id", "frame"]).groupBy("track_id", "onset", "end", "onset_conf").agg(
        F.percentile("midi", 0.5).alias("median"), F.avg("confidence").alias("c"))
    out = out.withColumn("midi", F.bround("median").cast("int")).filter(F.col("midi").between(low, high))
    return out.select("track_id", F.col("onset").alias("frame"), F.col("end").alias("stop"), "midi", (F.col("c") * F.col("onset_conf")).alias("confidence"))


def note_offsets(
    onsets: DataFrame, frames: DataFrame, min_frames: int = 4, max_ring: int = 172, window: int = 5, spread: float = 2.0,
    decay: float = 0.1, floor: float = 0.01, width: int = BLOCK_ROWS,
) -> DataFrame:
    """Where each onset's note ends: (track_id, onset_id, frame, offset_frame, method, confidence).

    ``onsets`` has track_id, onset_id and frame, ``frames`` one row per frame with rms and pitch (in semitones, 0 without one).
    A note ends at the earliest of: level under ``decay`` of its peak or under ``floor``; a pitch that is gone or spreads over more than
    ``spread`` semitones within ``window`` frames; the next onset; ``max_ring`` frames. Nothing ends it within ``min_frames``. An
    onset reads at most ``max_ring`` frames, so the rows of one onset are bounded.
    """
    heard = F.when(F.col("pitch") > 0, F.col("pitch"))
    near = slice_window(["track_id"], "frame").rowsBetween(0, window - 1)
    f = halo(frames.select("track_id", "frame", "rms", "pitch"), "frame", width, after=window - 1)
    f = f.withColumn("loose", (F.count(heard).over(near) < window // 2) | F.coalesce(F.stddev_pop(heard).over(near) > spread, F.lit(False)))
    f = f.filter("_own").select("track_id", F.col("frame").alias("at"), "rms", (F.col("pitch") > 0).alias("heard"), "loose")
    ends = frames.groupBy("track_id").agg(F.max("frame").alias("last"))
    rows = running(onsets.select("track_id", "frame", "onset_id"), ["frame", "onset_id"], width, nxt=following("frame"))
    rows = rows.withColumn("nxt", F.col("nxt.frame")).join(ends, "track_id")
    stop = F.least(F.col("last"), F.col("frame") + max_ring, F.coalesce(F.col("nxt") + max_ring // 2, F.col("last")))
    rows = rows.withColumn("stop", stop)
    late = rows.filter("frame > last").select("track_id", "onset_id", "frame", (F.col("frame") + 5).alias("offset_frame"), F.lit("fallback").alias("method"), F.lit(0.3).alias("confidence"))
    note = ["track_id", "onset_id", "frame", "nxt", "last", "stop"]
    reach = rows.filter("frame <= last").withColumn("at", F.explode(F.sequence("frame", "stop"))).join(f, ["track_id", "at"])
    i = F.col("at") - F.col("frame")
    reach = reach.withColumn("peak", F.max(F.when(i < 10, F.col("rms"))).over(Window.partitionBy("track_id", "onset_id")))
    quiet = (i >= min_frames) & ((F.col("rms") < F.col("peak") * decay) | (F.col("rms") < floor))
    loose = (i >= min_frames) & (F.col("at") <= F.col("stop") - window) & F.col("loose")
    found = reach.groupBy(*note, "peak").agg(
        F.bool_or("heard").alias("heard"), F.min(F.when(quiet, F.col("at"))).alias("quiet"), F.min(F.when(loose, F.col("at"))).alias("loose"))
    reasons = [("energy_decay", F.col("quiet"), 0.8), ("pitch_change", F.when(F.col("heard"), F.col("loose")), 0.7), ("next_onset", F.col("nxt"), 0.6),
               ("max_ring", F.least(F.col("frame") + max_ring, F.col("last")), 0.4)]
    options = F.array(*[F.struct(at.alias("at"), F.lit(n).alias("n"), F.lit(name).alias("method"), F.lit(c).alias("c")) for n, (name, at, c) in enumerate(reasons)])
    first = F.array_min(F.filter(options, lambda x: x["at"] >= F.col("frame") + min_frames))
    least = F.struct((F.col("frame") + min_frames).alias("at"), F.lit(9).alias("n"), F.lit("min_duration").alias("method"), F.lit(0.5).alias("c"))
    silent = F.struct((F.col("frame") + min_frames).alias("at"), F.lit(9).alias("n"), F.lit("silence").alias("method"), F.lit(0.7).alias("c"))
    found = found.withColumn("end", F.when(F.col("peak") < floor, silent).otherwise(F.coalesce(first, least)))
    out = found.select("track_id", "onset_id", "frame", F.col("end.at").alias("offset_frame"), F.col("end.method").alias("method"), F.col("end.c").alias("confidence"))
    return out.unionByName(late)


def pitch_trend(frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per note (``keys``): slope in semitones per second, spread, total change and turns of direction of its frames."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy("frame")  # a note's frames: bounded by the note's length
    rows = frames.withColumn("d", F.signum(F.col("pitch") - F.lag("pitch").over(w)))
    moving = rows.withColumn("turn", F.coalesce(F.col("d") * F.lag("d").over(w) < 0, F.lit(False)).cast("int"))
    return moving.groupBy(*keys).agg(
        F.count("*").alias("n"), F.regr_slope("pitch", F.col("t_us") / 1e6).alias("slope"), F.stddev_pop("pitch").alias("std"),
        (F.max_by("pitch", "frame") - F.min_by("pitch", "frame")).alias("change"), F.sum("turn").alias("turns"))


def dive_bombs(trend: DataFrame) -> DataFrame:
    """Rows of ``pitch_trend`` (with ``dur_s``, the length in seconds) that fall steeply, far and without turning back.

    Adds drop (semitones) and confidence, which blends steepness (15 semitones a second count full), drop (an octave counts full)
    and smoothness; rows over 0.6 are kept.
    """
    drop = F.abs("slope") * F.col("dur_s")
    smooth = 1 - F.least(F.lit(1.0), F.col("turns") / F.greatest(F.lit(2), F.floor(F.col("dur_s") * 3)))
    blend = 0.3 * F.least(F.lit(1.0), F.abs("slope") / 15.0) + 0.35 * F.least(F.lit(1.0), drop / 12.0) + 0.35 * smooth
    rows = trend.withColumn("drop", drop).withColumn("smooth", smooth).withColumn("confidence", blend)
    return rows.filter("slope <= -3 and drop >= 4 and smooth >= 0.5 and confidence > 0.6").drop("smooth")
