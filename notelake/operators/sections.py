"""Analysis windows of a track, their class, and bars with rests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelake.functions.scalars import clip
from notelake.operators.difficulty import hopping
from notelake.operators.positions import note_value, rest_value
from notelake.operators.timeline import SLICE_US, previous, range_join, running


def section_features(frames: DataFrame, window_us: int = 1_000_000, hop_us: int = 23_220) -> DataFrame:
    """Half-overlapping windows of frames (t_us, hz, onset, n_peaks, centroid, rms): medians, densities and means."""
    rows = hopping(frames, window_us, "t_us")
    n = F.count("*")
    return rows.groupBy("track_id", "win_us").agg(
        F.coalesce(F.percentile(F.when(F.col("hz") > 0, F.col("hz")), 0.5), F.lit(0.0)).alias("hz"),
        (F.count_if(F.col("onset")) / (n * hop_us / 1e6)).alias("density"), F.avg((F.col("n_peaks") > 1).cast("double")).alias("polyphony"),
        F.avg("centroid").alias("centroid"), F.avg("rms").alias("energy"))


# Limits of the solo score and the weights of its four parts.
LIMITS = {"hz": (400.0, 250.0), "density": (2.0, 3.0), "polyphony": (0.2, 0.4), "centroid": (1000.0, 1500.0)}
WEIGHTS = {"hz": 0.3, "density": 0.25, "polyphony": 0.25, "centroid": 0.2}


def classify_windows(windows: DataFrame) -> DataFrame:
    """Solo, rhythm, mixed or silence from pitch, density, polyphony and brightness."""
    def part(name: str, slack: float = 1.0) -> Column:
        low, high = LIMITS[name]
        return clip((F.col(name) - low) / (high - low + slack), 0, 1)

    parts = {"hz": F.when(F.col("hz") > 0, part("hz")).otherwise(0.5), "density": part("density"), "polyphony": 1 - part("polyphony", 0.01), "centroid": part("centroid")}
    rows = windows.withColumn("solo", sum((parts[k] * w for k, w in WEIGHTS.items()), F.lit(0.0)))
    label = F.when(F.col("energy") < 0.01, "silence").when(F.col("solo") >= 0.6, "solo").when(F.col("solo") <= 0.4, "rhythm").otherwise("mixed")
    conf = F.when(label == "silence", 1.0).when(label == "solo", F.col("solo")).when(label == "rhythm", 1 - F.col("solo")).otherwise(0.5)
    return rows.select("track_id", F.col("win_us").alias("t_us"), label.alias("label"), conf.alias("confidence"))


def backtrack_onset(onsets: DataFrame, levels: DataFrame, reach_us: int = 50_000) -> DataFrame:
    """Each onset moved to the quietest frame of the ``reach_us`` before it, the earliest of equals."""
    lv = levels.select("track_id", F.col("t_us").alias("f_us"), "rms")
    near = range_join(onsets.select("track_id", "onset_id", "t_us"), lv, "t_us", "f_us", reach_us, 0)
    best = near.groupBy("track_id", "onset_id").agg(F.min_by("f_us", F.struct("rms", "f_us")).alias("back_us"))
    return onsets.join(best, ["track_id", "onset_id"], "left").withColumn("back_us", F.coalesce("back_us", "t_us"))


def bars_with_rests(notes: DataFrame, tempo: int, per_bar: int = 4, min_beats: float = 0.25, width: int = SLICE_US) -> DataFrame:
    """Notes and rests of each bar: a rest fills a gap after the element *before* it in the bar, or after the last one."""
    beat = 60_000_000 / tempo
    bar = beat * per_bar
    rows = notes.select("track_id", "note_id", "start_us", "dur_us").withColumn("bar", F.floor(F.col("start_us") / bar).cast("bigint"))
    keys = ["track_id", "bar"]
    rows = rows.withColumn("end_us", F.col("start_us") + F.col("dur_us"))
    rows = running(rows, ["start_us", "note_id"], max(width, int(bar) + 1), keys, prev=previous("end_us"))
    since = F.coalesce(F.col("prev.end_us").cast("double"), F.col("bar") * bar)
    value = note_value(F.col("dur_us") / beat)
    elements = rows.select(*keys, F.lit("note").alias("kind"), F.col("start_us").cast("double").alias("at_us"), value["value"].alias("value"),
                           ((F.col("start_us") - F.col("bar") * bar) / beat).alias("beat"))

    def rests(df: DataFrame, gap: Column, at: Column) -> DataFrame:
        r = df.withColumn("gap", gap / beat).withColumn("at_us", at).filter(F.col("gap") >= min_beats)
        return r.select(*keys, F.lit("rest").alias("kind"), "at_us", rest_value(F.col("gap"))["value"].alias("value"), ((F.col("at_us") - F.col("bar") * bar) / beat).alias("beat"))

    between = rests(rows, F.col("start_us") - since, since)
    last = rows.groupBy(*keys).agg(F.max_by("end_us", F.struct("start_us", "note_id")).cast("double").alias("end_us"))
    after = rests(last, (F.col("bar") + 1) * bar - F.col("end_us"), F.col("end_us"))
    return elements.unionByName(between).unionByName(after)
