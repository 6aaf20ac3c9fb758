"""Spectral feature queries over the bins and samples tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from notelake.operators import spectral as sp
from notelake.plans.registry import register
from notelake.plans.segment import FRAME_SLICE
from notelake.sources import adapters as src

STEP = 175


def _spec(spark, sf):
    return sp.spectra(src.bins(spark, sf))


def _bands_sql(a, b, close=False):
    return f"coalesce(sum(m) FILTER (hz >= {a} AND hz {'<=' if close else '<'} {b}), 0)"


BAND_SQL = f"""_mean AS (SELECT track_id, bin, hz, avg(mag) AS m FROM bins GROUP BY ALL),
    bands AS (SELECT track_id, {', '.join(f"{_bands_sql(a, b)} / (sum(m) + 1e-10) AS {n}" for n, (a, b) in sp.BANDS.items())},
      {_bands_sql(800, 3000, True)} / ({_bands_sql(80, 800)} + {_bands_sql(800, 3000, True)} + 1e-10) AS mid_ratio,
      least(1.0, {_bands_sql(4000, 8000, True)} / {_bands_sql(200, 1000, True)} / 0.2) AS fizz FROM _mean GROUP BY track_id)"""
register("band_energy", lambda spark, sf: sp.band_energy(src.bins(spark, sf)), "track_id " + " ".join(f"{n}~" for n in sp.BANDS) + " mid_ratio~ fizz~", "bins",
         BAND_SQL + ", result AS (SELECT * FROM bands)")
CREST_SQL = "crest AS (SELECT track_id, CASE WHEN sqrt(avg(x * x)) < 1e-10 THEN 20 ELSE 20 * log10(max(abs(x)) / sqrt(avg(x * x))) END AS crest FROM samples GROUP BY ALL)"
register("crest_factor", lambda spark, sf: sp.crest_factor(src.samples(spark, sf)), "track_id crest~", "samples", CREST_SQL + ", result AS (SELECT * FROM crest)")
SHAPE_SQL = """_c AS (SELECT track_id, frame, sum(hz * mag) / sum(mag) AS centroid, sum(mag) AS total, exp(avg(ln(greatest(1e-10, mag * mag)))) / avg(greatest(1e-10, mag * mag)) AS flatness FROM bins GROUP BY ALL),
    _cum AS (SELECT track_id, frame, hz, sum(mag) OVER (PARTITION BY track_id, frame ORDER BY bin) AS cum FROM bins),
    _ro AS (SELECT track_id, frame, min(hz) FILTER (cum >= 0.85e0 * total) AS rolloff FROM _cum JOIN _c USING (track_id, frame) GROUP BY ALL),
    _bw AS (SELECT track_id, frame, sqrt(sum(pow(hz - centroid, 2) * mag) / any_value(total)) AS bandwidth FROM bins JOIN _c USING (track_id, frame) GROUP BY ALL),
    shape AS (SELECT * FROM _c JOIN _ro USING (track_id, frame) JOIN _bw USING (track_id, frame))"""


def _shape(spark, sf):
    return sp.spectral_shape(_spec(spark, sf), STEP)


register("spectral_shape", _shape, "track_id frame centroid~ bandwidth~ rolloff~ flatness~", "bins", SHAPE_SQL + ", result AS (SELECT * FROM shape)")
register("brightness_profile", lambda spark, sf: sp.brightness_profile(_shape(spark, sf)), "track_id mean_centroid~ std_centroid~ category$", "bins",
         SHAPE_SQL + """, result AS (SELECT track_id, avg(centroid) AS mean_centroid, stddev_pop(centroid) AS std_centroid,
             CASE WHEN avg(centroid) > 1500 THEN 'bright' WHEN avg(centroid) > 800 THEN 'neutral' ELSE 'warm' END AS category FROM shape GROUP BY ALL)""")
register(
    "note_shape", lambda spark, sf: sp.note_shape(_shape(spark, sf), _spec(spark, sf).filter("frame % 6 = 0").selectExpr("track_id", "frame as note_id", "frame as first_frame", "6L as n_frames")),
    "track_id note_id centroid~ bandwidth~ rolloff~ flatness~ attack~ sustain~", "bins",
    SHAPE_SQL + """, result AS (SELECT track_id, frame // 6 * 6 AS note_id, avg(centroid) AS centroid, avg(bandwidth) AS bandwidth, avg(rolloff) AS rolloff, avg(flatness) AS flatness,
        coalesce(avg(centroid) FILTER (frame % 6 <= 3), avg(centroid)) AS attack, coalesce(avg(centroid) FILTER (frame % 6 > 3), avg(centroid)) AS sustain FROM shape GROUP BY track_id, frame // 6 * 6)""",
)
FLUX_SQL = """_fl AS (SELECT track_id, frame, mag - lag(mag) OVER (PARTITION BY track_id, bin ORDER BY frame) AS d FROM bins),
    _fs AS (SELECT track_id, frame, sum(greatest(0, d)) AS v FROM _fl WHERE d IS NOT NULL GROUP BY ALL),
    flux AS (SELECT track_id, frame, v / (max(v) OVER (PARTITION BY track_id) + 1e-10) AS flux FROM _fs)"""
register("spectral_flux", lambda spark, sf: sp.spectral_flux(_spec(spark, sf), FRAME_SLICE), "track_id frame flux~", "bins", FLUX_SQL + ", result AS (SELECT * FROM flux)")
HFC_SQL = """_h AS (SELECT track_id, frame, sum(mag * (bin + 1)) AS h, sqrt(avg(mag * mag)) AS rms, ln(1 + 100 * sqrt(avg(mag * mag))) AS l FROM bins GROUP BY ALL),
    _hd AS (SELECT *, greatest(0, h - lag(h) OVER w) AS dh, greatest(0, l - lag(l) OVER w) AS dl, lag(h) OVER w AS ph FROM _h WINDOW w AS (PARTITION BY track_id ORDER BY frame)),
    hfc AS (SELECT track_id, frame, dh / (max(dh) OVER p + 1e-10) AS hfc, dl / (max(dl) OVER p + 1e-10) AS energy FROM _hd WHERE ph IS NOT NULL WINDOW p AS (PARTITION BY track_id))"""
register("hfc_onset", lambda spark, sf: sp.hfc_onset(_spec(spark, sf), FRAME_SLICE), "track_id frame hfc~", "bins", HFC_SQL + ", result AS (SELECT * FROM hfc)")
register("energy_onset", lambda spark, sf: sp.energy_onset(_spec(spark, sf), FRAME_SLICE), "track_id frame energy~", "bins", HFC_SQL + ", result AS (SELECT * FROM hfc)")
register(
    "legato_score", lambda spark, sf: sp.legato_score(_spec(spark, sf), 0.4, STEP, FRAME_SLICE), "track_id frame score~", "bins",
    """_q AS (SELECT track_id, frame, sum(hz * mag) / sum(mag) AS c, sqrt(avg(mag * mag)) AS rms FROM bins GROUP BY ALL),
    _z AS (SELECT *, (c - avg(c) OVER p) / (stddev_pop(c) OVER p + 1e-10) AS z FROM _q WINDOW p AS (PARTITION BY track_id)),
    _d AS (SELECT track_id, frame, abs(z - lag(z) OVER w) AS dz, abs(rms - lag(rms) OVER w) AS dr FROM _z WINDOW w AS (PARTITION BY track_id ORDER BY frame)),
    _n AS (SELECT track_id, frame, dz, dr / (max(dr) OVER (PARTITION BY track_id) + 1e-10) AS dr FROM _d WHERE dz IS NOT NULL),
    _s AS (SELECT track_id, frame, CASE WHEN dz > 0.5 AND dr < 0.4 THEN dz * (1 - dr) ELSE 0 END AS s FROM _n),
    result AS (SELECT track_id, frame, CASE WHEN max(s) OVER p > 0 THEN s / max(s) OVER p ELSE s END AS score FROM _s WINDOW p AS (PARTITION BY track_id))""",
)
register(
    "whiten", lambda spark, sf: sp.whiten(src.bins(spark, sf)), "track_id frame bin white~", "bins",
    """_f AS (SELECT track_id, bin, 1.0 / greatest(avg(mag) + 1e-10, 0.01) AS f FROM bins GROUP BY ALL),
    _n AS (SELECT track_id, bin, f / max(f) OVER (PARTITION BY track_id) AS f FROM _f),
    result AS (SELECT b.track_id, frame, b.bin, mag * (0.1 + 0.9 * f) AS white FROM bins b JOIN _n USING (track_id, bin))""",
)


def _hps(spark, sf):
    return sp.harmonic_product(_spec(spark, sf), 5, 65, 1200, STEP)


HPS_SQL = """_sp AS (SELECT track_id, frame, list(mag ORDER BY bin) AS m FROM bins GROUP BY ALL),
    _hp AS (SELECT track_id, frame, i, m[i + 1] * CASE WHEN i < 32 THEN m[2 * i + 1] ELSE 1 END * CASE WHEN i < 21 THEN m[3 * i + 1] ELSE 1 END
            * CASE WHEN i < 16 THEN m[4 * i + 1] ELSE 1 END * CASE WHEN i < 12 THEN m[5 * i + 1] ELSE 1 END AS p FROM _sp, range(0, 64) r(i)),
    hps AS (SELECT track_id, frame, arg_max(i, (p, -i)) FILTER (i BETWEEN 1 AND 5) * 175.0 AS hz, max(p) FILTER (i BETWEEN 1 AND 5) / max(p) AS strength FROM _hp GROUP BY track_id, frame)"""
register("harmonic_product", _hps, "track_id frame hz~ strength~", "bins", HPS_SQL + ", result AS (SELECT * FROM hps)")


def _tones(spark, sf):
    return _spec(spark, sf).selectExpr("track_id", "frame", "frame as note_id", "cast(80 + (frame * 37) % 1100 as double) as hz")


def energy_sql(m, f):
    b, r = f"CAST(floor(({f}) / 175e0) AS INT)", f"greatest(1, CAST(floor(({f}) * 3e-2 / 175e0) AS INT))"
    return f"CASE WHEN ({f}) <= 64 * 175 AND greatest(0, {b} - {r}) < least(64, {b} + {r} + 1) THEN list_max({m}[greatest(0, {b} - {r}) + 1 : least(64, {b} + {r} + 1)]) ELSE 0 END"


def score_sql(f):
    """LATERAL body: (score, second) of frequency ``f`` on spectrum ``m``."""
    ratios = ", ".join(f"CASE WHEN ({f}) * {h} <= 11200 THEN ({energy_sql('m', f'({f}) * {h}')}) / (e0 + 1e-10) END AS r{h}" for h in range(2, 7))
    found = " + ".join(f"coalesce(r{h} >= 0.1, false)::INT" for h in range(2, 7))
    return f"""(SELECT CASE WHEN e0 > 0 THEN s2 ELSE 0 END AS score, CASE WHEN e0 > 0 THEN coalesce(r2, 0) ELSE 0 END AS second FROM (
        SELECT *, CASE WHEN r3 IS NOT NULL AND r3 > 0.1 THEN least(1.0, s1 + 0.1) ELSE s1 END AS s2 FROM (
        SELECT *, CASE WHEN r3 IS NOT NULL AND r2 > 0.15 THEN least(1.0, s0 + 0.15) ELSE s0 END AS s1 FROM (
        SELECT *, ({found}) / greatest(1, least(5, CAST(floor(11200 / ({f})) AS INT) - 1)) AS s0 FROM (
        SELECT *, {ratios} FROM (SELECT {energy_sql('m', f)} AS e0))))))"""


OCT_SQL = f"""_sp AS (SELECT track_id, bin, frame, avg(mag) OVER (PARTITION BY track_id, bin ORDER BY frame ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS mag FROM bins),
    _ms AS (SELECT track_id, frame, list(mag ORDER BY bin) AS m, CAST(80 + (frame * 37) % 1100 AS DOUBLE) AS hz FROM _sp GROUP BY track_id, frame),
    _os AS (SELECT t.*, o.score AS os, h.score + CASE WHEN h.second > 0.5 THEN 0.2 ELSE 0 END AS hs, d.score AS ts, u.score AS us,
                   {energy_sql('m', 'hz * 2')} AS ue, {energy_sql('m', 'hz')} AS oe
            FROM _ms t, LATERAL {score_sql('hz')} o, LATERAL {score_sql('hz / 2')} h, LATERAL {score_sql('hz / 3')} d, LATERAL {score_sql('hz * 2')} u),
    _o1 AS (SELECT *, hz / 2 >= 73 AND hs > os + 0.15 AS th FROM _os),
    _o2 AS (SELECT *, hz / 3 >= 73 AND ts > CASE WHEN th THEN hs ELSE os END + 0.2 AS tt FROM _o1),
    _o3 AS (SELECT *, CASE WHEN tt THEN 'third' WHEN th THEN 'half' WHEN hz * 2 <= 1400 AND hz < 100 AND us >= os - 0.1 AND ue / (oe + 1e-10) > 0.3 THEN 'double' ELSE 'keep' END AS move FROM _o2)"""
register(
    "octave_correct", lambda spark, sf: sp.octave_correct(_tones(spark, sf), _spec(spark, sf), 73, 1400, STEP, FRAME_SLICE), "track_id note_id score~ fixed_hz~ move$", "bins",
    OCT_SQL + """, result AS (SELECT track_id, frame AS note_id, os AS score, move, CASE move WHEN 'third' THEN hz / 3 WHEN 'half' THEN hz / 2 WHEN 'double' THEN hz * 2 ELSE hz END AS fixed_hz FROM _o3)""",
)
register(
    "octave_correct_tuning", lambda spark, sf: sp.octave_correct(_tones(spark, sf), _spec(spark, sf), 20, 1400, STEP, FRAME_SLICE, "standard"), "track_id note_id score~ fixed_hz~ move$", "bins",
    OCT_SQL.replace("hz / 2 >= 73", "hz / 2 >= 20").replace("hz / 3 >= 73", "hz / 3 >= 20").replace("FROM _o2)", """FROM (
        SELECT * REPLACE (tt AND NOT low AS tt, th AND NOT tt AND NOT low AS th) FROM (SELECT *, round_even(69 + 12 * log2(CASE WHEN tt THEN hz / 3 ELSE hz / 2 END / 440), 0) < 40 AS low FROM _o2)))""")
    + """, result AS (SELECT track_id, frame AS note_id, os AS score, move, CASE move WHEN 'third' THEN hz / 3 WHEN 'half' THEN hz / 2 WHEN 'double' THEN hz * 2 ELSE hz END AS fixed_hz FROM _o3)""",
)


def region_sql(f):
    b = f"CAST(floor(({f}) / 175e0) AS INT)"
    return f"list_max(m[greatest(0, {b} - 3) + 1 : least(64, {b} + 4)])"


register(
    "power_chord", lambda spark, sf: sp.power_chord(_tones(spark, sf).drop("note_id"), _spec(spark, sf), 65, STEP), "track_id frame hz~ is_power! root_hz~", "bins",
    f"""_ms AS (SELECT track_id, frame, list(mag ORDER BY bin) AS m, CAST(80 + (frame * 37) % 1100 AS DOUBLE) AS hz FROM bins GROUP BY track_id, frame),
    _p AS (SELECT *, floor(hz * 1.5 / 175) BETWEEN 1 AND 63 AND {region_sql('hz * 1.5')} > 4e-1 * {region_sql('hz')} AS a,
             floor(hz / 1.5 / 175) > 0 AND hz / 1.5 >= 65 AND {region_sql('hz / 1.5')} > 3e-1 * CASE WHEN floor(hz / 175) > 0 THEN m[CAST(floor(hz / 175) AS INT) + 1] ELSE 0 END AS b FROM _ms),
    result AS (SELECT *, a OR b AS is_power, CASE WHEN NOT a AND b THEN hz / 1.5 ELSE hz END AS root_hz FROM _p)""",
)


def _odf(spark, sf):
    s = _spec(spark, sf)
    keys = ["track_id", "frame"]
    return sp.spectral_flux(s, FRAME_SLICE).join(sp.hfc_onset(s, FRAME_SLICE), keys).join(sp.energy_onset(s, FRAME_SLICE), keys).withColumn("attack", F.expr("cast((frame % 7) / 7 as double)"))


ODF_SQL = FLUX_SQL + "," + HFC_SQL + """,
    _ob AS (SELECT track_id, frame, flux, hfc, energy, (frame % 7) / 7 AS attack, flux * 0.3 + hfc * 0.2 + (frame % 7) / 7 * 0.35 + energy * 0.15 AS o FROM flux JOIN hfc USING (track_id, frame)),
    odf AS (SELECT *, o / (max(o) OVER (PARTITION BY track_id) + 1e-10) AS odf FROM _ob)"""
register(
    "combine_odf", lambda spark, sf: sp.combine_odf(_odf(spark, sf)).withColumn("methods", F.array_join("methods", ",")), "track_id frame odf~ methods$", "bins",
    ODF_SQL + """, result AS (SELECT track_id, frame, odf, concat_ws(',', CASE WHEN flux > 0.24 THEN 'flux' END, CASE WHEN hfc > 0.24 THEN 'hfc' END, CASE WHEN attack > 0.16 THEN 'attack' END,
        CASE WHEN energy > 0.24 THEN 'energy' END) AS methods FROM odf)""",
)
register(
    "peak_pick", lambda spark, sf: sp.peak_pick(sp.combine_odf(_odf(spark, sf)), "odf", 0.3, 2, width=FRAME_SLICE), "track_id frame odf~", "bins",
    ODF_SQL + """, _l AS (SELECT *, lag(odf) OVER w AS a, lead(odf) OVER w AS b FROM odf WINDOW w AS (PARTITION BY track_id ORDER BY frame)),
    result AS (SELECT * FROM _l WHERE odf > a AND odf > b AND odf >= 0.3)""",
)
# with a spacing that drops peaks: walk down from the highest, keeping the list of kept frames
register(
    "peak_pick_spaced", lambda spark, sf: sp.peak_pick(sp.combine_odf(_odf(spark, sf)), "odf", 0.2, 6, width=FRAME_SLICE), "track_id frame odf~", "bins",
    ODF_SQL + """, _l AS (SELECT *, lag(odf) OVER w AS a, lead(odf) OVER w AS b FROM odf WINDOW w AS (PARTITION BY track_id ORDER BY frame)),
    _pk AS (SELECT track_id, frame, odf, row_number() OVER (PARTITION BY track_id ORDER BY odf DESC, frame DESC) AS rn FROM _l WHERE odf > a AND odf > b AND odf >= 0.2),
    _wk AS (SELECT track_id, rn, [frame] AS kept FROM _pk WHERE rn = 1
            UNION ALL SELECT p.track_id, p.rn, CASE WHEN len(list_filter(w.kept, lambda k: abs(k - p.frame) < 6)) > 0 THEN w.kept ELSE list_append(w.kept, p.frame) END
            FROM _wk w JOIN _pk p ON p.track_id = w.track_id AND p.rn = w.rn + 1),
    _fin AS (SELECT track_id, unnest(arg_max(kept, rn)) AS frame FROM _wk GROUP BY track_id),
    result AS (SELECT p.* FROM _pk p JOIN _fin USING (track_id, frame))""", recursive=True,
)
def spaced_sql(distance: int, value: str = "m", place: str = "i") -> str:
    """Kept places of a group's peaks, from the highest down, as a list of one-element lists."""
    ranked = f"list_transform(list({place} ORDER BY {value} DESC, {place} DESC), lambda x: [x])"
    return f"list_reduce({ranked}, lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: abs(k - x[1]) < {distance})) > 0 THEN acc ELSE acc || x END)"


register(
    "polyphony", lambda spark, sf: sp.polyphony(_spec(spark, sf), 1, 9), "track_id frame n", "bins",
    f"""_r AS (SELECT track_id, frame, bin, mag / max(mag) OVER (PARTITION BY track_id, frame) AS m FROM bins WHERE bin BETWEEN 1 AND 8),
    _l AS (SELECT *, lag(m) OVER w AS a, lead(m) OVER w AS b FROM _r WINDOW w AS (PARTITION BY track_id, frame ORDER BY bin)),
    _k AS (SELECT track_id, frame, least(6, len({spaced_sql(5, "m", "bin")})) AS n FROM _l WHERE m > a AND m > b AND m >= 0.2e0 GROUP BY track_id, frame),
    result AS (SELECT f.track_id, f.frame, coalesce(n, 0) AS n FROM (SELECT DISTINCT track_id, frame FROM bins) f LEFT JOIN _k USING (track_id, frame))""",
)
register(
    "spectral_candidates", lambda spark, sf: sp.spectral_candidates(_spec(spark, sf), 75, 5000), "track_id frame pos midi frequency~ confidence~", "bins",
    """_r AS (SELECT track_id, frame, bin, hz, mag / max(mag) OVER (PARTITION BY track_id, frame) AS m FROM bins WHERE bin BETWEEN 0 AND 28),
    _l AS (SELECT *, lag(m) OVER w AS a, lead(m) OVER w AS b FROM _r WINDOW w AS (PARTITION BY track_id, frame ORDER BY bin)),
    _p AS (SELECT *, CAST(round_even(69 + 12 * log2(hz / 440), 0) AS INT) AS midi, row_number() OVER (PARTITION BY track_id, frame ORDER BY m DESC, bin DESC) AS rk FROM _l WHERE m > a AND m > b AND m >= 0.1e0),
    _k AS (SELECT track_id, frame, list_reduce(list_transform(list({'p': midi, 'hz': hz, 'm': m} ORDER BY rk), lambda x: [x]), lambda acc, x:
             CASE WHEN len(list_filter(acc, lambda k: x[1].p - k.p IN (0, 12, 19, 24))) > 0 THEN acc ELSE acc || x END) AS ks FROM _p WHERE rk <= 12 GROUP BY track_id, frame),
    _u AS (SELECT track_id, frame, generate_subscripts(ks, 1) AS j, ks FROM _k),
    result AS (SELECT track_id, frame, j - 1 AS pos, ks[j].p AS midi, ks[j].hz AS frequency, ks[j].m AS confidence FROM _u)""",
)
register(
    "level_candidates", lambda spark, sf: sp.level_candidates(_spec(spark, sf), 75, 8000), "track_id frame pos frequency~ level~ confidence~", "bins",
    f"""_t AS (SELECT track_id, max(mag) AS ref FROM bins GROUP BY ALL),
    _d AS (SELECT track_id, frame, bin, hz, greatest(-80, 20 * log10(greatest(mag, 1e-5) / greatest(ref, 1e-5))) AS m FROM bins JOIN _t USING (track_id)),
    _x AS (SELECT *, max(m) OVER (PARTITION BY track_id, frame) AS loud FROM _d),
    _h AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY track_id, frame) AS n, lag(m) OVER w AS a, lead(m) OVER w AS b FROM _x WHERE hz BETWEEN 75 AND 8000 AND m >= -40
           WINDOW w AS (PARTITION BY track_id, frame ORDER BY bin)),
    _k AS (SELECT track_id, frame, flatten([{spaced_sql(3)}]) AS ks FROM _h WHERE n > 2 AND m > a AND m > b GROUP BY track_id, frame),
    _q AS (SELECT _h.* FROM _h LEFT JOIN _k USING (track_id, frame) WHERE n <= 2 OR list_contains(ks, i)),
    result AS (SELECT track_id, frame, row_number() OVER (PARTITION BY track_id, frame ORDER BY m DESC, i DESC) - 1 AS pos, hz AS frequency, m AS level,
                      least(1.0, greatest(0.0, (m + 40) / (loud + 40 + 1e-6))) AS confidence FROM _q QUALIFY pos < 5)""",
)
register(
    "quality_metrics", lambda spark, sf: sp.quality_metrics(src.bins(spark, sf), src.samples(spark, sf), _shape(spark, sf), sp.spectral_flux(_spec(spark, sf), FRAME_SLICE)),
    "track_id dc_offset~ dynamic_range~ flatness~ guitar_pct~ clarity~", "bins samples",
    SHAPE_SQL + "," + FLUX_SQL + """,
    _t AS (SELECT track_id, max(mag) AS top, 100 * sum(CASE WHEN hz BETWEEN 80 AND 5000 THEN mag * mag ELSE 0 END) / (sum(mag * mag) + 1e-10) AS guitar_pct FROM bins GROUP BY ALL),
    _db AS (SELECT track_id, -quantile_cont(greatest(20 * log10(greatest(1e-5, mag) / greatest(1e-5, top)), -80), 0.05) AS dynamic_range FROM bins JOIN _t USING (track_id) GROUP BY ALL),
    _dc AS (SELECT track_id, abs(avg(x)) AS dc_offset FROM samples GROUP BY ALL), _ff AS (SELECT track_id, avg(flatness) AS flatness FROM shape GROUP BY ALL),
    _cl AS (SELECT track_id, max(flux) / (avg(flux) + 1e-10) AS clarity FROM flux GROUP BY ALL),
    result AS (SELECT * FROM _t JOIN _db USING (track_id) JOIN _dc USING (track_id) JOIN _ff USING (track_id) JOIN _cl USING (track_id))""",
)
register(
    "normalize", lambda spark, sf: sp.normalize(src.samples(spark, sf)), "track_id idx centred~ scaled~", "samples",
    "result AS (SELECT track_id, idx, x - avg(x) OVER p AS centred, x * pow(10, -0.15) / max(abs(x)) OVER p AS scaled FROM samples WINDOW p AS (PARTITION BY track_id))",
)
register(
    "gate_gain", lambda spark, sf: sp.gate_gain(sp.rms_levels(_spec(spark, sf)), 0.125, 4.0, 5, FRAME_SLICE), "track_id frame gain~", "bins",
    """_r AS (SELECT track_id, frame, sqrt(avg(mag * mag)) AS r FROM bins GROUP BY ALL), _g AS (SELECT *, CASE WHEN r < 0.125 THEN 0.25 + 0.75 * (r / 0.125) ELSE 1 END AS g FROM _r),
    result AS (SELECT track_id, frame, avg(g) OVER (PARTITION BY track_id ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS gain FROM _g)""",
)
register(
    "transient_strength",
    lambda spark, sf: sp.transient_strength(src.samples(spark, sf), src.onset_samples(spark, sf), 32, 1024), "track_id idx strength~", "samples",
    """_w AS (SELECT track_id, idx, sqrt(avg(x * x) OVER (PARTITION BY track_id ORDER BY idx ROWS BETWEEN 32 PRECEDING AND 1 PRECEDING)) AS b,
                  sqrt(avg(x * x) OVER (PARTITION BY track_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND 31 FOLLOWING)) AS a FROM samples),
    result AS (SELECT track_id, idx, CASE WHEN coalesce(b, 0) > 0 THEN least(a / b, 10) / 10 ELSE least(a * 100, 1) END AS strength FROM _w WHERE idx % 50 = 0)""",
)


def _features(spark, sf):
    return sp.distortion_features(src.bins(spark, sf), src.samples(spark, sf), _shape(spark, sf), STEP)


register(
    "distortion_features", _features, "track_id bass_clarity~ density~ mid_ratio~ fizz~ crest~ intermod~", "bins samples",
    BAND_SQL + "," + CREST_SQL + "," + SHAPE_SQL + f""",
    _bs AS (SELECT track_id, m / (sum(m) OVER (PARTITION BY track_id) + 1e-10) AS p, m FROM _mean WHERE hz BETWEEN 80 AND 250),
    _en AS (SELECT track_id, CASE WHEN max(m) < 1e-10 THEN 0.5 ELSE greatest(0.0, least(1.0, 0.6 * (1 - -sum(p * ln(p + 1e-10)) / (ln(count(*)) + 1e-10)))) END AS bass_clarity FROM _bs GROUP BY track_id),
    _r AS (SELECT track_id, bin, m / max(m) OVER (PARTITION BY track_id) AS m FROM _mean WHERE hz BETWEEN 100 AND 5000),
    _l AS (SELECT *, lag(m) OVER w AS a, lead(m) OVER w AS b FROM _r WINDOW w AS (PARTITION BY track_id ORDER BY bin)),
    _k AS (SELECT track_id, len({spaced_sql(5, "m", "bin")}) AS n FROM _l WHERE m > a AND m > b AND m >= 0.05e0 GROUP BY track_id),
    _f AS (SELECT track_id, avg(flatness) AS intermod FROM shape GROUP BY track_id),
    result AS (SELECT track_id, bass_clarity, greatest(0.0, least(1.0, (coalesce(n, 0) - 10) / 30.0)) AS density, mid_ratio, fizz, crest, intermod
               FROM bands JOIN crest USING (track_id) JOIN _en USING (track_id) JOIN _f USING (track_id) LEFT JOIN _k USING (track_id))""",
)


def _ladder_sql(kind):
    parts = []
    for name, steps in sp.LADDERS.items():
        whens = " ".join(f"WHEN {name} {'<=' if name in sp.CLOSED else '<'} {lim} THEN {pts.get(kind, 0)}" for lim, pts in steps if lim is not None)
        parts.append(f"CASE {whens} ELSE {steps[-1][1].get(kind, 0)} END")
    return "round(CAST(" + " + ".join(parts) + " AS DOUBLE), 9)"


_FEAT = """_ft AS (SELECT user_id AS track_id, count(*) AS n, avg(value) AS v, stddev_pop(value) AS s FROM events GROUP BY ALL),
    feat AS (SELECT track_id, v % 18 AS crest, v / 100 AS mid_ratio, s / 80 AS fizz, (n % 10) / 10 AS density, (n % 7) / 7 AS bass_clarity, (n % 5) / 10 AS intermod FROM _ft)"""


def _event_features(spark, sf):
    e = src.table(spark, sf, "events").groupBy(F.col("user_id").alias("track_id")).agg(F.count("*").alias("n"), F.avg("value").alias("v"), F.stddev_pop("value").alias("s"))
    return e.selectExpr("track_id", "v % 18 as crest", "v / 100 as mid_ratio", "s / 80 as fizz", "(n % 10) / 10 as density", "(n % 7) / 7 as bass_clarity", "(n % 5) / 10 as intermod")


register(
    "distortion_class", lambda spark, sf: sp.distortion_class(_event_features(spark, sf)), "track_id kind$ confidence~ method$", "",
    _FEAT + f""", _pt AS (SELECT track_id, {', '.join(f'{_ladder_sql(k)} AS {k}' for k in sp.CLASSES)} FROM feat),
    _un AS (UNPIVOT _pt ON {', '.join(sp.CLASSES)} INTO NAME kind VALUE s),
    _bk AS (SELECT track_id, kind, s, sum(s) OVER (PARTITION BY track_id) AS t, list_position({sp.CLASSES}, kind) AS o FROM _un),
    _b1 AS (SELECT * FROM _bk QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY s DESC, o) = 1),
    result AS (SELECT track_id, kind, CASE WHEN s > 0.6 THEN least(1.0, s / t * 1.2) ELSE s / t END AS confidence,
        CASE kind WHEN 'clean' THEN 'pyin' WHEN 'light_overdrive' THEN 'pyin' WHEN 'fuzz' THEN 'autocorrelation' ELSE 'hps' END AS method FROM _b1)""",
)
register(
    "before_after_quality", lambda spark, sf: sp.before_after_quality(src.notes(spark, sf).filter("method = 'pyin'"), src.notes(spark, sf).filter("method = 'cqt'")),
    "track_id before_n before_conf~ before_spread~ after_n after_conf~ after_spread~ gained lost common", "notes",
    """_d AS (SELECT *, midi - lag(midi) OVER (PARTITION BY track_id, method ORDER BY start_us, note_id) AS step FROM notes),
    _a AS (SELECT track_id, count(*) AS before_n, avg(confidence) AS before_conf, CASE WHEN count(*) > 10 THEN stddev_pop(step) END AS before_spread FROM _d WHERE method = 'pyin' GROUP BY ALL),
    _b AS (SELECT track_id, count(*) AS after_n, avg(confidence) AS after_conf, CASE WHEN count(*) > 10 THEN stddev_pop(step) END AS after_spread FROM _d WHERE method = 'cqt' GROUP BY ALL),
    _s AS (SELECT track_id, midi, bool_or(method = 'pyin') AS p, bool_or(method = 'cqt') AS c FROM notes GROUP BY ALL),
    _c AS (SELECT track_id, count(*) FILTER (c AND NOT p) AS gained, count(*) FILTER (p AND NOT c) AS lost, count(*) FILTER (p AND c) AS common FROM _s GROUP BY ALL),
    result AS (SELECT track_id, coalesce(before_n, 0) AS before_n, coalesce(before_conf, 0) AS before_conf, coalesce(before_spread, 0) AS before_spread, coalesce(after_n, 0) AS after_n,
               coalesce(after_conf, 0) AS after_conf, coalesce(after_spread, 0) AS after_spread, gained, lost, common FROM _a FULL JOIN _b USING (track_id) LEFT JOIN _c USING (track_id))""",
)
