"""Spectral features of frames, notes and tracks.

Bins arrive long, one row per (track, frame, bin). A frame's spectrum is of fixed size, so ``spectra`` holds it as an
array and everything inside a frame is array arithmetic without a shuffle; steps between frames are windows over
slices of frames.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notelake.functions.dims import tuning_notes
from notelake.operators.segment import mark_groups
from notelake.operators.timeline import BLOCK_ROWS, Run, following, group_quantile, halo, previous, running, slice_window
from notelake.session import checkpointed

EPS = 1e-10
# Frequency bands in Hz.
BANDS = {"sub_bass": (20, 80), "bass": (80, 250), "low_mids": (250, 500), "mids": (500, 2000), "upper_mids": (2000, 4000),
         "highs": (4000, 8000), "air": (8000, 20000)}


def spectra(bins: DataFrame) -> DataFrame:
    """(track_id, frame, mags): the spectrum of each frame in bin order."""
    return bins.groupBy("track_id", "frame").agg(F.array_sort(F.collect_list(F.struct("bin", "mag"))).alias("b")).select(
        "track_id", "frame", F.col("b.mag").alias("mags"))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def _weighted(a: Column, weight) -> Column:
    """Sum of ``weight(bin) * value`` over an array."""
    return _sum(F.transform(a, lambda x, i: x * weight(i)))


def band_energy(bins: DataFrame) -> DataFrame:
    """Share of the mean spectrum in seven bands, and mids against lows and mids."""
    mean = bins.groupBy("track_id", "bin", "hz").agg(F.avg("mag").alias("m"))
    part = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("m"))), F.lit(0.0))
    total = F.sum("m") + EPS
    mid, low = part(F.col("hz").between(800, 3000)), part((F.col("hz") >= 80) & (F.col("hz") < 800))
    fizz, ref = part(F.col("hz").between(4000, 8000)), part(F.col("hz").between(200, 1000))
    return mean.groupBy("track_id").agg(
        *[(part((F.col("hz") >= a) & (F.col("hz") < b)) / total).alias(n) for n, (a, b) in BANDS.items()],
        F.when(low < EPS, 0.0).otherwise(mid / (low + mid + EPS)).alias("mid_ratio"),
        F.when(ref < EPS, 0.0).otherwise(F.least(F.lit(1.0), fizz / ref / 0.2)).alias("fizz"))


def crest_factor(samples: DataFrame) -> DataFrame:
    """Peak over RMS in dB; 20 for silence."""
    rms = F.sqrt(F.avg(F.col("x") * F.col("x")))
    return samples.groupBy("track_id").agg(F.when(rms < EPS, 20.0).otherwise(20 * F.log10(F.max(F.abs("x")) / rms)).alias("crest"))


def spectral_shape(spec: DataFrame, hz_step: float = 175.0, roll: float = 0.85) -> DataFrame:
    """Centroid, bandwidth, rolloff and flatness per frame."""
    m = F.col("mags")
    total = _sum(m)
    rows = spec.withColumn("total", total).withColumn(
        "centroid", F.when(F.col("total") > 0, _weighted(m, lambda i: i * hz_step) / F.col("total")).otherwise(0.0))
    spread = _weighted(m, lambda i: F.pow(i * hz_step - F.col("centroid"), 2))
    reach = F.aggregate(
        m, F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")),
        lambda a, x: F.struct((a["s"] + x).alias("s"), (a["n"] + F.when(a["s"] + x < roll * F.col("total"), 1).otherwise(0)).alias("n")))
    power = F.transform(m, lambda x: F.greatest(F.lit(EPS), x * x))
    flat = F.exp(_sum(F.transform(power, lambda p: F.ln(p))) / F.size(m)) / (_sum(power) / F.size(m))
    return rows.select(
        "track_id", "frame", "centroid", F.when(F.col("total") > 0, F.sqrt(spread / F.col("total"))).otherwise(0.0).alias("bandwidth"),
        (reach["n"] * hz_step).alias("rolloff"), flat.alias("flatness"))


def brightness_profile(shape: DataFrame) -> DataFrame:
    mean = F.avg("centroid")
    return shape.groupBy("track_id").agg(
        mean.alias("mean_centroid"), F.stddev_pop("centroid").alias("std_centroid"),
        F.when(mean > 1500, "bright").when(mean > 800, "neutral").otherwise("warm").alias("category"))


def note_shape(shape: DataFrame, notes: DataFrame, attack_frames: int = 3) -> DataFrame:
    """Mean shape over each note's frames, and centroid of its attack and sustain.

    ``notes``: (track_id, note_id, first_frame, n_frames).
    """
    rows = notes.withColumn("frame", F.explode(F.sequence(F.col("first_frame"), F.col("first_frame") + F.col("n_frames") - 1)))
    rows = rows.join(shape, ["track_id", "frame"])
    head = F.col("frame") <= F.col("first_frame") + attack_frames
    mean = F.avg("centroid")
    return rows.groupBy("track_id", "note_id").agg(
        mean.alias("centroid"), F.avg("bandwidth").alias("bandwidth"), F.avg("rolloff").alias("rolloff"), F.avg("flatness").alias("flatness"),
        F.coalesce(F.avg(F.when(head, F.col("centroid"))), mean).alias("attack"), F.coalesce(F.avg(F.when(~head, F.col("centroid"))), mean).alias("sustain"))


def track_scaled(rows: DataFrame, value: str) -> DataFrame:
    """``value`` divided by its maximum in the track (plus a tiny constant)."""
    top = rows.groupBy("track_id").agg(F.max(value).alias("_top"))
    return rows.join(top, "track_id").withColumn(value, F.col(value) / (F.col("_top") + EPS)).drop("_top")


def _before(rows: DataFrame, width: int, **cols: str) -> DataFrame:
    """Value of each column in the previous frame; the first frame of a track is dropped."""
    out = halo(rows, "frame", width, before=1)
    w = slice_window(["track_id"], "frame")
    for new, old in cols.items():
        out = out.withColumn(new, F.lag(old).over(w))
    return out.filter("_own").drop("_s", "_own").filter(F.col(next(iter(cols))).isNotNull())


def spectral_flux(spec: DataFrame, width: int = BLOCK_ROWS, low_bin: int = 0, high_bin: int | None = None) -> DataFrame:
    """Rise over the previous frame summed over bins, scaled per track."""
    top = F.size("mags") if high_bin is None else F.lit(high_bin)
    m = F.slice("mags", F.lit(low_bin + 1), F.greatest(top - low_bin, F.lit(0)))
    rows = _before(spec.select("track_id", "frame", m.alias("mags")), width, prev="mags")
    rise = _sum(F.zip_with("mags", "prev", lambda a, b: F.greatest(F.lit(0.0), a - b)))
    return track_scaled(rows.select("track_id", "frame", rise.alias("flux")), "flux")


def hfc_onset(spec: DataFrame, width: int = BLOCK_ROWS) -> DataFrame:
    """Rise of the bin-weighted sum, scaled per track."""
    rows = _before(spec.select("track_id", "frame", _weighted(F.col("mags"), lambda i: i + 1).alias("h")), width, prev="h")
    return track_scaled(rows.select("track_id", "frame", F.greatest(F.lit(0.0), F.col("h") - F.col("prev")).alias("hfc")), "hfc")


def _rms(spec: DataFrame) -> DataFrame:
    return spec.select("track_id", "frame", F.sqrt(_sum(F.transform("mags", lambda x: x * x)) / F.size("mags")).alias("rms"))


def energy_onset(spec: DataFrame, width: int = BLOCK_ROWS) -> DataFrame:
    """Rise of log(1 + 100 rms), scaled per track."""
    rows = _before(_rms(spec).withColumn("l", F.log1p(F.col("rms") * 100)), width, prev="l")
    return track_scaled(rows.select("track_id", "frame", F.greatest(F.lit(0.0), F.col("l") - F.col("prev")).alias("energy")), "energy")


def legato_score(spec: DataFrame, sensitivity: float = 0.4, hz_step: float = 175.0, width: int = BLOCK_ROWS) -> DataFrame:
    """Large change of the standardised centroid with a small change of level."""
    shape = spectral_shape(spec, hz_step).select("track_id", "frame", "centroid").join(_rms(spec), ["track_id", "frame"])
    stats = shape.groupBy("track_id").agg(F.avg("centroid").alias("mu"), F.stddev_pop("centroid").alias("sd"))
    rows = shape.join(stats, "track_id").withColumn("z", (F.col("centroid") - F.col("mu")) / (F.col("sd") + EPS))
    rows = _before(rows, width, pz="z", pr="rms")
    rows = rows.select("track_id", "frame", F.abs(F.col("z") - F.col("pz")).alias("dz"), F.abs(F.col("rms") - F.col("pr")).alias("dr"))
    rows = track_scaled(rows, "dr")
    score = F.when((F.col("dz") > 0.5) & (F.col("dr") < sensitivity), F.col("dz") * (1 - F.col("dr"))).otherwise(0.0)
    rows = rows.select("track_id", "frame", score.alias("score"))
    top = rows.groupBy("track_id").agg(F.max("score").alias("_top"))
    return rows.join(top, "track_id").withColumn("score", F.when(F.col("_top") > 0, F.col("score") / F.col("_top")).otherwise(F.col("score"))).drop("_top")


def whiten(bins: DataFrame, relaxation: float = 0.9, floor: float = 0.01) -> DataFrame:
    """Magnitudes flattened by the inverse of each bin's mean over the track."""
    mean = bins.groupBy("track_id", "bin").agg((F.lit(1.0) / F.greatest(F.avg("mag") + EPS, F.lit(floor))).alias("f"))
    top = mean.groupBy("track_id").agg(F.max("f").alias("t"))
    filt = mean.join(top, "track_id").select("track_id", "bin", (F.col("f") / F.col("t")).alias("f"))
    return bins.join(filt, ["track_id", "bin"]).withColumn("white", F.col("mag") * (1 - relaxation + relaxation * F.col("f"))).drop("f")


def harmonic_product(spec: DataFrame, n_harmonics: int = 5, low_hz: float = 65.0, high_hz: float = 1200.0, hz_step: float = 175.0) -> DataFrame:
    """Product of the spectrum and its decimations; the peak bin in range is the fundamental."""
    def times_decimated(a: Column, h: int) -> Column:
        n = F.floor(F.size("mags") / h).cast("int")
        return F.transform(a, lambda x, i: F.when((n >= 10) & (i < n), x * F.get("mags", i * h)).otherwise(x))

    hps = F.col("mags")
    for h in range(2, n_harmonics + 1):
        hps = times_decimated(hps, h)
    low = max(1, int(low_hz / hz_step))
    high = F.least(F.size("mags") - 1, F.lit(int(high_hz / hz_step)))
    region = F.slice("hps", low + 1, high - low)
    rows = spec.withColumn("hps", hps).withColumn("best", F.array_max(region))
    at = F.array_position(region, F.col("best")).cast("int") - 1 + low
    top = F.array_max("hps")
    return rows.select("track_id", "frame", (at * hz_step).alias("hz"), F.when(top > 0, F.col("best") / top).otherwise(0.0).alias("strength"))


def _energy(mags: Column, hz: Column, hz_step: float, tol: float = 0.03) -> Column:
    """Largest magnitude within the tolerance of a frequency; 0 outside the spectrum."""
    n = F.size(mags)
    reach = F.greatest(F.lit(1), F.floor(hz * tol / hz_step).cast("int"))
    target = F.floor(hz / hz_step).cast("int")
    first, last = F.greatest(F.lit(0), target - reach), F.least(n, target + reach + 1)
    return F.when((hz > 0) & (hz <= n * hz_step) & (first < last), F.array_max(F.slice(mags, first + 1, F.greatest(F.lit(0), last - first)))).otherwise(0.0)


def harmonic_energies(mags: Column, hz: Column, hz_step: float = 175.0, n_harmonics: int = 5) -> Column:
    """Energies at the 1st to (n + 1)-th harmonic; null beyond the spectrum."""
    steps = F.sequence(F.lit(1), F.lit(n_harmonics + 1))
    return F.transform(steps, lambda h: F.when((h == 1) | (hz * h <= F.size(mags) * hz_step), _energy(mags, hz * h, hz_step)))


def harmonic_score(energies: Column, hz: Column, nyquist: Column, n_harmonics: int = 5, min_ratio: float = 0.1) -> Column:
    """Share of harmonics present, with bonuses for the 2nd and 3rd."""
    fund = F.get(energies, F.lit(0))
    ratio = lambda h: F.get(energies, F.lit(h - 1)) / (fund + EPS)
    found = F.size(F.filter(F.slice(energies, 2, n_harmonics), lambda e: e / (fund + EPS) >= min_ratio))
    expected = F.greatest(F.lit(1), F.least(F.lit(n_harmonics), F.floor(nyquist / hz).cast("int") - 1))
    both = ratio(3).isNotNull()
    second = F.when(both & (ratio(2) > 0.15), 0.15).otherwise(0.0)
    third = F.when(both & (ratio(3) > 0.1), 0.1).otherwise(0.0)
    return F.when(fund > 0, F.least(F.lit(1.0), F.least(F.lit(1.0), found / expected + second) + third)).otherwise(0.0)


def mean_spectra(spec: DataFrame, width: int = BLOCK_ROWS) -> DataFrame:
    """Each frame's spectrum averaged with its neighbours' (two at the ends of a track)."""
    rows = halo(spec, "frame", width, before=1, after=1)
    w = slice_window(["track_id"], "frame")
    near = F.filter(F.array(F.lag("mags").over(w), F.col("mags"), F.lead("mags").over(w)), lambda a: a.isNotNull())
    rows = rows.withColumn("near", near).filter("_own").drop("_s", "_own")
    total = F.aggregate(F.slice("near", 2, 2), F.element_at("near", 1), lambda s, a: F.zip_with(s, a, lambda x, y: x + y))
    return rows.select("track_id", "frame", F.transform(total, lambda x: x / F.size("near")).alias("mags"))


def octave_correct(
    notes: DataFrame, spec: DataFrame, min_hz: float = 73.0, max_hz: float = 1400.0, hz_step: float = 175.0, width: int = BLOCK_ROWS,
    tuning: str | Sequence[int] | None = None,
) -> DataFrame:
    """Notes (track_id, note_id, frame, hz) checked against half, third and double their frequency by harmonic support.

    With a ``tuning``, a note does not move down to a pitch below its lowest string, and is not tried at another fraction then.
    """
    rows = notes.join(mean_spectra(spec, width), ["track_id", "frame"])
    m, hz = F.col("mags"), F.col("hz")
    tones = {"own": hz, "half": hz / 2, "third": hz / 3, "twice": hz * 2}
    for name, f in tones.items():
        rows = rows.withColumn(f"e_{name}", harmonic_energies(m, f, hz_step))
    rows = rows.withColumn("nyquist", F.size(m) * hz_step).drop("mags")
    for name, f in tones.items():
        rows = rows.withColumn(name, harmonic_score(F.col(f"e_{name}"), f, F.col("nyquist")))
    energy, up_energy = F.get("e_own", F.lit(0)), F.get("e_twice", F.lit(0))
    second = F.when(F.get("e_half", F.lit(0)) > 0, F.get("e_half", F.lit(1)) / (F.get("e_half", F.lit(0)) + EPS))
    half = F.when(hz / 2 >= min_hz, F.col("half") + F.when(second > 0.5, 0.2).otherwise(0.0))
    rows = rows.withColumn("half_score", half)
    take_half = F.coalesce(F.col("half_score") > F.col("own") + 0.15, F.lit(False))
    rows = rows.withColumn("take_half", take_half).withColumn("best", F.when(F.col("take_half"), F.col("half_score")).otherwise(F.col("own")))
    take_third = (hz / 3 >= min_hz) & (F.col("third") > F.col("best") + 0.2)
    if tuning is not None:
        low = F.bround(69 + 12 * F.log2(F.when(take_third, hz / 3).otherwise(hz / 2) / 440.0)) < min(tuning_notes(tuning))
        rows = rows.withColumn("third_now", take_third & ~low).withColumn("take_half", F.col("take_half") & ~take_third & ~low)
        take_third = F.col("third_now")
    up = (hz * 2 <= max_hz) & (hz < 100) & (F.col("twice") >= F.col("own") - 0.1) & (up_energy / (energy + EPS) > 0.3)
    fixed = F.when(take_third, hz / 3).when(F.col("take_half"), hz / 2).when(up, hz * 2).otherwise(hz)
    move = F.when(take_third, "third").when(F.col("take_half"), "half").when(up, "double").otherwise("keep")
    return rows.select("track_id", "note_id", "hz", F.col("own").alias("score"), fixed.alias("fixed_hz"), move.alias("move"))


def power_chord(tones: DataFrame, spec: DataFrame, low_hz: float = 65.0, hz_step: float = 175.0, window: int = 3) -> DataFrame:
    """(track_id, frame, hz): a strong fifth above makes it a power chord; else a strong root a fifth below does."""
    rows = tones.join(spec, ["track_id", "frame"])
    n = F.size("mags")

    def region(f: Column) -> Column:
        b = F.floor(f / hz_step).cast("int")
        first = F.greatest(F.lit(0), b - window)
        return F.array_max(F.slice("mags", first + 1, F.least(n, b + window + 1) - first))

    hz = F.col("hz")
    fifth, root, own = F.floor(hz * 1.5 / hz_step).cast("int"), F.floor(hz / 1.5 / hz_step).cast("int"), F.floor(hz / hz_step).cast("int")
    strong = (hz > 0) & (fifth > 0) & (fifth < n) & (region(hz * 1.5) > 0.4 * region(hz))
    current = F.when((own > 0) & (own < n), F.element_at("mags", F.greatest(F.lit(1), own + 1))).otherwise(0.0)
    below = (hz > 0) & (root > 0) & (hz / 1.5 >= low_hz) & (region(hz / 1.5) > 0.3 * current)
    strong, below = F.coalesce(strong, F.lit(False)), F.coalesce(below, F.lit(False))
    return rows.select("track_id", "frame", "hz", (strong | below).alias("is_power"), F.when(~strong & below, hz / 1.5).otherwise(hz).alias("root_hz"))


def intermod_products(
    tones: DataFrame, spec: DataFrame, n_harmonics: int = 8, threshold: float = 0.3, low_hz: float = 65.0, high_hz: float = 1200.0, hz_step: float = 175.0
) -> DataFrame:
    """Sums and differences of strong harmonics that are themselves present; pairs of at most ``n_harmonics`` per frame."""
    rows = tones.join(spec, ["track_id", "frame"]).withColumn("top", F.array_max("mags"))
    steps = F.sequence(F.lit(1), F.lit(n_harmonics))
    rows = rows.withColumn("strong", F.filter(steps, lambda h: _energy(F.col("mags"), F.col("hz") * h, hz_step) / F.col("top") > threshold))
    pairs = F.flatten(F.transform("strong", lambda a: F.flatten(F.transform(
        F.filter("strong", lambda b: b > a), lambda b: F.array(F.col("hz") * a + F.col("hz") * b, F.abs(F.col("hz") * a - F.col("hz") * b))))))
    there = lambda f: F.get("mags", F.floor(f / hz_step).cast("int")) > threshold * F.col("top")
    ok = F.filter(pairs, lambda f: f.between(low_hz, high_hz) & (F.floor(f / hz_step) > 0) & F.coalesce(there(f), F.lit(False)))
    return rows.select("track_id", "frame", F.array_distinct(F.transform(ok, lambda f: F.round(f, 6))).alias("products"))


def combine_odf(odf: DataFrame, threshold: float = 0.3, attack_threshold: float = 0.2) -> DataFrame:
    """Four onset curves blended 0.3/0.2/0.35/0.15, rescaled per track, with the methods above 80 % of their threshold."""
    blend = F.col("flux") * 0.3 + F.col("hfc") * 0.2 + F.col("attack") * 0.35 + F.col("energy") * 0.15
    rows = track_scaled(odf.withColumn("odf", blend), "odf")
    cut = {"flux": threshold, "hfc": threshold, "attack": attack_threshold, "energy": threshold}
    names = F.array_compact(F.array(*[F.when(F.col(c) > t * 0.8, F.lit(c)) for c, t in cut.items()]))
    return rows.withColumn("methods", names)


def peak_pick(
    curve: DataFrame, value: str, height: float, distance: int, keys: Sequence[str] = ("track_id",), order: str = "frame", width: int = BLOCK_ROWS
) -> DataFrame:
    """Local maxima of at least ``height`` (a plateau counts once, in its middle), higher ones first, none nearer than ``distance``.

    Going from the highest down is done in rounds: a peak that beats all others in reach stays and removes them. Each
    round settles every local winner at once.
    """
    keys = list(keys)
    rows = halo(checkpointed(curve.select(*keys, order, value)), order, width, before=1)
    w = slice_window(keys, order)
    rows = rows.withColumn("new", F.coalesce((F.col(value) != F.lag(value).over(w)) | (F.col(order) != F.lag(order).over(w) + 1), F.lit(True)))
    rows = rows.filter("_own").drop("_s", "_own")
    rows = mark_groups(rows, [order], F.col("new"), width, keys, "flat")
    flats = rows.groupBy(*keys, F.col(f"flat.{order}").alias("first")).agg(F.max(order).alias("last"), F.max(value).alias(value))
    flats = running(flats, ["first"], width, keys, prev=previous("last", value), nxt=following("first", value))
    top = (F.col(value) > F.col(f"prev.{value}")) & (F.col(value) > F.col(f"nxt.{value}")) & (F.col("prev.last") + 1 == F.col("first")) & (
        F.col("nxt.first") - 1 == F.col("last"))
    peaks = flats.filter(top & (F.col(value) >= height)).select(*keys, F.floor((F.col("first") + F.col("last")) / 2).cast("bigint").alias(order), value)
    if distance <= 1:
        return peaks
    peaks = checkpointed(peaks.withColumn("kept", F.lit(False)))
    rank = F.struct(value, order)
    while True:
        # twice the reach: a neighbour in reach must itself see all its neighbours
        rows = halo(peaks, order, max(width, distance), before=2 * (distance - 1), after=2 * (distance - 1))
        near = Window.partitionBy(*keys, "_s").orderBy(order).rangeBetween(-(distance - 1), distance - 1)
        rows = rows.withColumn("best", F.max(rank).over(near)).withColumn("wins", rank == F.col("best"))
        rows = rows.withColumn("beaten", F.max(F.when(F.col("wins"), rank)).over(near) > rank)
        state = rows.filter("_own and not coalesce(beaten, false)").select(*keys, order, value, F.col("wins").alias("kept"))
        peaks = checkpointed(state)
        if peaks.filter("not kept").isEmpty():
            return peaks.drop("kept")


def array_peaks(xs: Column) -> Column:
    """Local maxima of an array as an array of struct(m, i), i from 1, in one pass.

    An even top counts once, in its middle; a value at an end, or an even stretch that reaches it, is none. This is the rule of ``peak_pick``.
    """
    none = F.array().cast("array<struct<m:double,i:int>>")
    start = F.struct(F.lit(None).cast("double").alias("x"), F.lit(0).alias("since"), F.lit(False).alias("rising"), F.lit(0).alias("i"), none.alias("out"))

    def step(s: Column, x: Column) -> Column:
        i, same = s["i"] + 1, F.coalesce(s["x"] == x, F.lit(False))
        top = F.struct(s["x"].alias("m"), F.floor((s["since"] + s["i"]) / 2).cast("int").alias("i"))
        falls = s["rising"] & F.coalesce(x < s["x"], F.lit(False))
        return F.struct(
            x.cast("double").alias("x"), F.when(same, s["since"]).otherwise(i).alias("since"), F.when(same, s["rising"]).otherwise(F.coalesce(x > s["x"], F.lit(False))).alias("rising"),
            i.alias("i"), F.when(falls, F.concat(s["out"], F.array(top))).otherwise(s["out"]).alias("out"))

    return F.aggregate(xs, start, step, lambda s: s["out"])


def spaced(peaks: Column, distance: int) -> Column:
    """Peaks from the highest down (of equals the later one first), without those nearer than ``distance`` to a kept one."""
    ranked = F.sort_array(peaks, asc=False)
    return F.aggregate(ranked, F.slice(ranked, 1, 0), lambda acc, p: F.when(
        F.exists(acc, lambda q: F.abs(q["i"] - p["i"]) < distance), acc).otherwise(F.concat(acc, F.array(p))))


def frame_peaks(mags: Column, height: float, distance: int) -> Column:
    """Peaks inside one spectrum as an array of struct(m, i): relative height, greedy spacing from the highest down."""
    top = F.array_max(mags)
    peaks = F.filter(array_peaks(F.transform(mags, lambda x: x / top)), lambda p: p["m"] >= height)
    return F.when((top >= EPS) & (F.size(mags) >= 3), spaced(peaks, distance)).otherwise(F.array().cast("array<struct<m:double,i:int>>"))


def polyphony(spec: DataFrame, low_bin: int, high_bin: int, height: float = 0.2, distance: int = 5) -> DataFrame:
    """Peaks per frame in a range of bins, at most six."""
    rows = spec.withColumn("part", F.slice("mags", low_bin + 1, high_bin - low_bin))
    return rows.select("track_id", "frame", F.least(F.lit(6), F.size(frame_peaks(F.col("part"), height, distance))).alias("n"))


def spectral_candidates(
    spec: DataFrame, low_hz: float = 75.0, high_hz: float = 1400.0, height: float = 0.1, top: int = 12, hz_step: float = 175.0, distance: int = 1
) -> DataFrame:
    """Per frame the strongest peaks as candidates of distinct pitch, none 12, 19 or 24 above one already kept."""
    first, last = int(low_hz / hz_step), int(high_hz / hz_step) + 1
    peaks = F.slice(frame_peaks(F.slice("mags", first + 1, last - first), height, distance), 1, top)
    rows = spec.select("track_id", "frame", peaks.alias("ps"))
    named = F.transform("ps", lambda p: F.struct(
        F.bround(69 + 12 * F.log2((p["i"] - 1 + first) * hz_step / 440.0)).cast("int").alias("midi"), ((p["i"] - 1 + first) * hz_step).alias("hz"), p["m"].alias("m")))
    rows = rows.withColumn("cs", named)
    keep = F.aggregate("cs", F.slice("cs", 1, 0), lambda acc, c: F.when(
        F.exists(acc, lambda k: (c["midi"] - k["midi"]).isin(0, 12, 19, 24)), acc).otherwise(F.concat(acc, F.array(c))))
    return rows.select("track_id", "frame", F.posexplode(keep).alias("pos", "c")).select(
        "track_id", "frame", "pos", "c.midi", F.col("c.hz").alias("frequency"), F.col("c.m").alias("confidence"))


def level_candidates(
    spec: DataFrame, low_hz: float = 75.0, high_hz: float = 1400.0, threshold: float = -40.0, top: int = 5, distance: int = 3, hz_step: float = 175.0
) -> DataFrame:
    """Per frame the strongest peaks by level: (track_id, frame, pos, frequency, level, confidence).

    Levels are decibels below the loudest bin of the track, at least -80. Bins in range and above ``threshold`` are looked at as if they were next to each
    other; peaks keep ``distance`` of them apart, and two bins or fewer are all peaks. The confidence is the level's place between the threshold and the frame's loudest bin.
    """
    loudest = spec.groupBy("track_id").agg(F.max(F.array_max("mags")).alias("_ref"))
    level = lambda x: F.greatest(F.lit(-80.0), 20 * F.log10(F.greatest(x, F.lit(1e-5)) / F.greatest("_ref", F.lit(1e-5))))
    rows = spec.join(loudest, "track_id").withColumn("db", F.transform("mags", level)).withColumn("loud", F.array_max("db"))
    hz = lambda i: i * hz_step
    held = F.filter(F.transform("db", lambda x, i: F.struct(x.alias("m"), i.cast("int").alias("bin"))), lambda p: hz(p["bin"]).between(low_hz, high_hz) & (p["m"] >= threshold))
    rows = rows.withColumn("held", held)
    every = F.transform("held", lambda p, i: F.struct(p["m"].cast("double").alias("m"), (i + 1).cast("int").alias("i")))
    peaks = F.when(F.size("held") > 2, spaced(array_peaks(F.col("held.m")), distance)).otherwise(F.sort_array(every, asc=False))
    rows = rows.withColumn("ps", F.slice(peaks, 1, top)).select("track_id", "frame", "held", "loud", F.posexplode("ps").alias("pos", "p"))
    share = (F.col("p.m") - threshold) / (F.col("loud") - threshold + 1e-6)
    return rows.select(
        "track_id", "frame", "pos", hz(F.get("held", F.col("p.i") - 1)["bin"]).alias("frequency"), F.col("p.m").alias("level"),
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), share)).alias("confidence"))


def quality_metrics(bins: DataFrame, samples: DataFrame, flatness: DataFrame, flux: DataFrame) -> DataFrame:
    """DC offset, dynamic range, flatness, energy share in the guitar band and transient clarity per track."""
    dc = samples.groupBy("track_id").agg(F.abs(F.avg("x")).alias("dc_offset"))
    tops = bins.groupBy("track_id").agg(
        F.max("mag").alias("top"),
        (100 * F.sum(F.when(F.col("hz").between(80, 5000), F.col("mag") * F.col("mag")).otherwise(0.0)) / (F.sum(F.col("mag") * F.col("mag")) + EPS)).alias("guitar_pct"))
    level = 20 * F.log10(F.greatest(F.lit(1e-5), F.col("mag")) / F.greatest(F.lit(1e-5), F.col("top")))
    levels = bins.join(tops, "track_id").select("track_id", F.greatest(level, F.lit(-80.0)).alias("db"))
    floor = group_quantile(levels, ["track_id"], "db", 0.05, 0.5, "p5")
    flat = flatness.groupBy("track_id").agg(F.avg("flatness").alias("flatness"))
    clear = flux.groupBy("track_id").agg((F.max("flux") / (F.avg("flux") + EPS)).alias("clarity"))
    return dc.join(tops, "track_id").join(floor, "track_id").join(flat, "track_id").join(clear, "track_id").select(
        "track_id", "dc_offset", (-F.col("p5")).alias("dynamic_range"), "flatness", "guitar_pct", "clarity")


def normalize(samples: DataFrame, target_db: float = -3.0) -> DataFrame:
    """Samples without their mean (``centred``) and scaled to a peak of ``target_db`` (``scaled``)."""
    stats = samples.groupBy("track_id").agg(F.avg("x").alias("mu"), F.max(F.abs("x")).alias("peak"))
    gain = F.when(F.col("peak") < EPS, 1.0).otherwise(10 ** (target_db / 20) / F.col("peak"))
    return samples.join(stats, "track_id").withColumn("centred", F.col("x") - F.col("mu")).withColumn("scaled", F.col("x") * gain).drop("mu", "peak")


def gate_gain(levels: DataFrame, threshold: float, ratio: float, smooth: int, width: int = BLOCK_ROWS) -> DataFrame:
    """Gain below a level threshold, averaged over a centred window of rows clipped at the ends of the track."""
    cut = 1.0 / ratio
    gain = F.when(F.col("rms") < threshold, cut + (1 - cut) * (F.col("rms") / threshold)).otherwise(1.0)
    half = smooth // 2
    rows = halo(levels.withColumn("g", gain), "frame", width, before=half, after=half)
    near = Window.partitionBy("track_id", "_s").orderBy("frame").rangeBetween(-half, half)
    return rows.withColumn("gain", F.avg("g").over(near)).filter("_own").drop("_s", "_own", "g")


def rms_levels(spec: DataFrame) -> DataFrame:
    return _rms(spec)


def transient_strength(samples: DataFrame, onsets: DataFrame, window: int = 512, width: int = 16 * BLOCK_ROWS) -> DataFrame:
    """RMS after an onset over RMS before it, capped at 10 and scaled to 1; rolling sums in one pass over the samples."""
    rows = halo(samples, "idx", width, before=window, after=window)
    w = Window.partitionBy("track_id", "_s").orderBy("idx")
    sq = F.col("x") * F.col("x")
    rows = rows.withColumn("before", F.sqrt(F.avg(sq).over(w.rangeBetween(-window, -1)))).withColumn("after", F.sqrt(F.avg(sq).over(w.rangeBetween(0, window - 1))))
    rows = rows.filter("_own").select("track_id", "idx", F.coalesce("before", F.lit(0.0)).alias("before"), "after")
    return onsets.join(rows, ["track_id", "idx"]).withColumn(
        "strength", F.when(F.col("before") > 0, F.least(F.col("after") / F.col("before"), F.lit(10.0)) / 10).otherwise(F.least(F.col("after") * 100, F.lit(1.0))))


# Class scores added per feature, as (upper limit, {class: points}) ladders; the last has no limit.
CLASSES = ["clean", "light_overdrive", "medium_drive", "high_gain", "fuzz"]
LADDERS = {
    "crest": [(6, {"fuzz": 0.3, "high_gain": 0.1}), (9, {"high_gain": 0.3, "medium_drive": 0.1}), (12, {"medium_drive": 0.3, "light_overdrive": 0.1}),
              (15, {"light_overdrive": 0.3, "clean": 0.1}), (None, {"clean": 0.4})],
    "mid_ratio": [(0.35, {"clean": 0.2}), (0.45, {"light_overdrive": 0.2}), (0.55, {"medium_drive": 0.2}), (None, {"high_gain": 0.2, "fuzz": 0.1})],
    "fizz": [(0.15, {"clean": 0.2}), (0.3, {"light_overdrive": 0.2}), (0.5, {"medium_drive": 0.2}), (0.7, {"high_gain": 0.2}), (None, {"fuzz": 0.3})],
    "density": [(0.2, {"clean": 0.15}), (0.4, {"light_overdrive": 0.15}), (0.6, {"medium_drive": 0.15}), (None, {"high_gain": 0.15, "fuzz": 0.1})],
    "bass_clarity": [(0.3, {"high_gain": 0.1, "fuzz": 0.05}), (0.5, {"medium_drive": 0.1}), (0.7, {"light_overdrive": 0.1}), (None, {"clean": 0.1})],
    "intermod": [(0.1, {"clean": 0.1}), (0.25, {"light_overdrive": 0.1}), (0.4, {"medium_drive": 0.1}), (None, {"high_gain": 0.1, "fuzz": 0.1})],
}
CLOSED = {"crest", "bass_clarity"}  # a value equal to the limit stays below it
METHOD_FOR = {"clean": "pyin", "light_overdrive": "pyin", "medium_drive": "hps", "high_gain": "hps", "fuzz": "autocorrelation"}


def distortion_class(features: DataFrame) -> DataFrame:
    """Five class scores from six feature ladders; the best class with its share, raised when it is above 0.6."""
    def points(kind: str) -> Column:
        total = F.lit(0.0)
        for name, steps in LADDERS.items():
            col, c = None, F.col(name)
            for limit, scores in steps:
                add = F.lit(float(scores.get(kind, 0.0)))
                if limit is None:
                    col = add if col is None else col.otherwise(add)
                else:
                    cond = c <= limit if name in CLOSED else c < limit
                    col = F.when(cond, add) if col is None else col.when(cond, add)
            total = total + col
        return total

    rows = features
    for kind in CLASSES:
        rows = rows.withColumn(kind, F.round(points(kind), 9))
    best = F.greatest(*[F.struct(F.col(k).alias("s"), F.lit(-i).alias("o"), F.lit(k).alias("kind")) for i, k in enumerate(CLASSES)])
    rows = rows.withColumn("best", best).withColumn("share", F.col("best.s") / sum((F.col(k) for k in CLASSES[1:]), F.col(CLASSES[0])))
    conf = F.when(F.col("best.s") > 0.6, F.least(F.lit(1.0), F.col("share") * 1.2)).otherwise(F.col("share"))
    method = F.create_map(*[F.lit(x) for kv in METHOD_FOR.items() for x in kv])
    return rows.select("track_id", F.col("best.kind").alias("kind"), conf.alias("confidence"), F.element_at(method, F.col("best.kind")).alias("method"))


def distortion_features(bins: DataFrame, samples: DataFrame, flatness: DataFrame, hz_step: float = 175.0) -> DataFrame:
    """Inputs of ``distortion_class`` from a track's mean spectrum and samples."""
    mean = bins.groupBy("track_id", "bin").agg(F.avg("mag").alias("mag"))
    spec = mean.groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("bin", "mag"))).alias("b")).select("track_id", F.col("b.mag").alias("mags"))
    inside = lambda a, b: F.slice("mags", int(-(-a // hz_step)) + 1, int(b // hz_step) - int(-(-a // hz_step)) + 1)
    bass = inside(80, 250)
    p = F.transform(bass, lambda x: x / (_sum(bass) + EPS))
    entropy = -_sum(F.transform(p, lambda x: x * F.ln(x + EPS)))
    clear = F.when((F.size(bass) == 0) | (F.array_max(bass) < EPS), 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (
        0.6 * (1 - entropy / (F.ln(F.size(bass).cast("double")) + EPS)) + 0.4 * F.least(F.lit(1.0), F.size(frame_peaks(bass, 0.3, 1)) * 0.3)))))
    peaks = F.size(frame_peaks(inside(100, 5000), 0.05, 5))
    density = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (peaks - 10) / 30.0))
    flat = flatness.groupBy("track_id").agg(F.avg("flatness").alias("intermod"))
    return spec.select("track_id", clear.alias("bass_clarity"), density.alias("density")).join(band_energy(bins).select("track_id", "mid_ratio", "fizz"), "track_id").join(
        crest_factor(samples), "track_id").join(flat, "track_id")


def before_after_quality(before: DataFrame, after: DataFrame) -> DataFrame:
    """Counts, mean confidence and pitch stability of two runs (track_id, start_us, note_id, midi), and the pitches gained and lost.

    Stability is the deviation of the steps from note to note, for tracks of more than ten notes; others have 0.
    """
    def stats(df: DataFrame, p: str) -> DataFrame:
        rows = running(df.select("track_id", "start_us", "note_id", "midi", "confidence"), ["start_us", "note_id"], prev=Run("last", F.col("midi"), inclusive=False))
        spread = F.when(F.count("*") > 10, F.stddev_pop(F.col("midi") - F.col("prev")))
        return rows.groupBy("track_id").agg(F.count("*").alias(f"{p}_n"), F.avg("confidence").alias(f"{p}_conf"), spread.alias(f"{p}_spread"))

    a, b = before.select("track_id", "midi"), after.select("track_id", "midi")
    count = lambda df, name: df.groupBy("track_id").agg(F.count("*").alias(name))
    out = stats(before, "before").join(stats(after, "after"), "track_id", "full")
    for df, name in ((b.subtract(a), "gained"), (a.subtract(b), "lost"), (a.intersect(b), "common")):
        out = out.join(count(df, name), "track_id", "left")
    return out.na.fill(0)
