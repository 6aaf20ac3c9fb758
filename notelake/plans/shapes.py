"""Sequence, section and decoder queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from notelake.operators import decode as dec
from notelake.operators import sections as sec
from notelake.operators import segment as seg
from notelake.operators import sequence as sq
from notelake.operators import theory as th
from notelake.operators import voting as vote
from notelake.operators.positions import NOTE_VALUES
from notelake.operators.timeline import Run, running
from notelake.plans.registry import register
from notelake.plans.segment import _LEGATO, FRAME_SLICE, NOTE_SLICE
from notelake.plans.theory import _values
from notelake.plans.voting import _VOTES_SQL, _frame_votes
from notelake.sources import adapters as src

_RUN = _LEGATO.replace("FROM notes", "FROM (SELECT * REPLACE (40 + midi % 12 AS midi) FROM notes)")


def _runs(spark, sf):
    rows = seg.mark_legato_runs(src.notes(spark, sf).withColumn("midi", F.expr("cast(40 + midi % 12 as int)")), 100_000, NOTE_SLICE)
    return rows.withColumn("first_id", F.col("run.note_id")).drop("run", "starts")


register(
    "sequence_profile",
    lambda spark, sf: sq.sequence_profile(running(_runs(spark, sf), ["start_us", "note_id"], NOTE_SLICE, rn=Run("sum", F.lit(1).cast("bigint"))), ["track_id", "first_id"])
    .withColumn("shape", F.coalesce("shape", F.lit("-"))),
    "track_id first_id n range direction$ avg_interval~ max_interval is_chromatic! has_octave_jump! likely_pentatonic! shape$", "notes",
    _RUN + """, _q AS (SELECT *, CASE WHEN go THEN d END AS i FROM _n),
    _s AS (SELECT track_id, arg_min(note_id, (start_us, note_id)) AS first_id, list(i ORDER BY start_us, note_id) FILTER (i IS NOT NULL) AS ds, count(*) AS n, max(midi) - min(midi) AS range,
             arg_max(midi, (start_us, note_id)) - arg_min(midi, (start_us, note_id)) AS net, avg(abs(i)) AS avg_interval, max(abs(i)) AS max_interval FROM _q GROUP BY track_id, g HAVING count(*) >= 2),
    result AS (SELECT *, CASE WHEN net > 0 THEN 'ascending' WHEN net < 0 THEN 'descending' ELSE 'mixed' END AS direction,
        len(list_filter(ds, lambda x: abs(x) > 1)) = 0 AS is_chromatic, len(list_filter(ds, lambda x: abs(x) = 12)) > 0 AS has_octave_jump,
        len(list_filter(ds, lambda x: abs(x) NOT IN (0, 2, 3, 4, 5, 7, 9, 10, 12))) = 0 AS likely_pentatonic,
        CASE WHEN n < 3 THEN '-' WHEN len(list_filter(ds, lambda x: x NOT BETWEEN 0 AND 3)) = 0 THEN 'ascending_scale' WHEN len(list_filter(ds, lambda x: x NOT BETWEEN -3 AND 0)) = 0 THEN 'descending_scale'
             WHEN len(list_filter(ds, lambda x: abs(x) NOT IN (3, 4, 5))) = 0 THEN 'arpeggio' WHEN len(list_filter(ds, lambda x: x = 0)) > n // 2 THEN 'pedal_tone'
             WHEN len(list_filter(ds, lambda x: abs(x) = 12)) > 0 THEN 'octave_jump' ELSE '-' END AS shape FROM _s)""",
)
_LIB = [(name, i, j, v) for i, (name, steps) in enumerate(sq.library()) for j, v in enumerate(steps)]
register(
    "similar_patterns", lambda spark, sf: sq.similar_patterns(sq.run_heads(_runs(spark, sf), ["track_id", "first_id"], 13, NOTE_SLICE)),
    "track_id first_id ord pattern$ score~", "notes",
    _RUN + f""", _lib AS (SELECT * FROM {_values(_LIB, 'pattern, ord, j, v')}),
    _ll AS (SELECT ord, pattern, count(*) AS len FROM _lib GROUP BY ALL),
    _i AS (SELECT track_id, g, first_value(note_id) OVER w AS first_id, midi - first_value(midi) OVER w AS x, row_number() OVER w - 1 AS j FROM _n WINDOW w AS (PARTITION BY track_id, g ORDER BY start_us, note_id)),
    _cn AS (SELECT track_id, g, first_id, least(count(*), 13) AS n FROM _i GROUP BY ALL),
    _m AS (SELECT track_id, g, ord, count(*) FILTER (abs(x - v) <= 1) AS hits FROM _i JOIN _lib USING (j) GROUP BY ALL),
    result AS (SELECT track_id, first_id, ord, pattern, hits / least(n, len) AS score FROM _m JOIN _cn USING (track_id, g) JOIN _ll USING (ord) WHERE least(n, len) >= 3 AND hits / least(n, len) >= 0.6)""",
)


def _section_frames(spark, sf):
    return src.frames(spark, sf).select(
        "track_id", "t_us", F.expr("if(is_voiced, 440D * pow(2D, (midi - 69) / 12D), 0D)").alias("hz"), F.expr("event_id % 6 = 0").alias("onset"),
        F.expr("event_id % 3").alias("n_peaks"), F.expr("cast(800 + event_id % 1500 as double)").alias("centroid"), (F.col("confidence") / 20).alias("rms"))


_SEC = """_w AS (SELECT track_id, k * 500000 AS win_us, coalesce(median(CASE WHEN is_voiced THEN 440 * pow(2, (midi - 69) / 12.0) END), 0) AS hz,
       count(*) FILTER (event_id % 6 = 0) / (count(*) * 0.02322) AS density, avg((event_id % 3 > 1)::INT) AS polyphony, avg(800 + event_id % 1500) AS centroid, avg(confidence / 20) AS energy
       FROM frames JOIN range(0, 400) r(k) ON t_us >= k * 500000 AND t_us < k * 500000 + 1000000 GROUP BY track_id, k)"""
register("section_features", lambda spark, sf: sec.section_features(_section_frames(spark, sf)), "track_id win_us hz~ density~ polyphony~ centroid~ energy~", "frames",
         _SEC + ", result AS (SELECT * FROM _w)")


def _ramp(name, slack=1.0):
    low, high = sec.LIMITS[name]
    return f"greatest(0, least(1, ({name} - {low}) / ({high} - {low} + {slack})))"


register(
    "classify_windows", lambda spark, sf: sec.classify_windows(sec.section_features(_section_frames(spark, sf))), "track_id t_us label$ confidence~", "frames",
    _SEC + f""", _s AS (SELECT *, {sec.WEIGHTS['hz']} * CASE WHEN hz > 0 THEN {_ramp('hz')} ELSE 0.5 END + {sec.WEIGHTS['density']} * {_ramp('density')}
        + {sec.WEIGHTS['polyphony']} * (1 - {_ramp('polyphony', 0.01)}) + {sec.WEIGHTS['centroid']} * {_ramp('centroid')} AS solo FROM _w),
    result AS (SELECT track_id, win_us AS t_us, CASE WHEN energy < 0.01 THEN 'silence' WHEN solo >= 0.6 THEN 'solo' WHEN solo <= 0.4 THEN 'rhythm' ELSE 'mixed' END AS label,
        CASE WHEN energy < 0.01 THEN 1 WHEN solo >= 0.6 THEN solo WHEN solo <= 0.4 THEN 1 - solo ELSE 0.5 END AS confidence FROM _s)""",
)
register(
    "backtrack_onset",
    lambda spark, sf: sec.backtrack_onset(src.onset_frames(spark, sf).select("track_id", F.col("event_id").alias("onset_id"), (F.col("t_us") + 7000).alias("t_us")),
                                          src.frames(spark, sf).select("track_id", "t_us", F.col("confidence").alias("rms"))),
    "onset_id t_us back_us", "frames",
    """result AS (SELECT o.event_id AS onset_id, o.t_us + 7000 AS t_us, arg_min(f.t_us, (f.confidence, f.t_us)) AS back_us FROM frames o JOIN frames f
       ON f.track_id = o.track_id AND f.t_us BETWEEN o.t_us + 7000 - 50000 AND o.t_us + 7000 WHERE o.event_id % 6 = 0 GROUP BY o.event_id, o.t_us)""",
)
register(
    "bars_with_rests", lambda spark, sf: sec.bars_with_rests(src.notes(spark, sf), 240, width=NOTE_SLICE), "track_id bar kind$ at_us~ value$ beat~", "notes",
    f"""_v AS (SELECT * FROM {_values([(n, i, b) for i, (n, b) in enumerate(NOTE_VALUES)], 'value, o, b')}),
    _nb AS (SELECT *, start_us // 1000000 AS bar, start_us + dur_us AS end_us FROM notes),
    _p AS (SELECT *, coalesce(lag(end_us) OVER w, bar * 1000000) AS since, lead(start_us) OVER w IS NULL AS fin FROM _nb WINDOW w AS (PARTITION BY track_id, bar ORDER BY start_us, note_id)),
    _r AS (SELECT track_id, bar, since AS at_us, (start_us - since) / 250000 AS gap FROM _p UNION ALL SELECT track_id, bar, end_us, ((bar + 1) * 1000000 - end_us) / 250000 FROM _p WHERE fin),
    _nv AS (SELECT track_id, bar, start_us, value FROM _p, _v QUALIFY row_number() OVER (PARTITION BY note_id ORDER BY abs(dur_us / 250000 - b::DOUBLE) / b::DOUBLE, o) = 1),
    result AS (SELECT track_id, bar, 'note' AS kind, start_us AS at_us, value, (start_us - bar * 1000000) / 250000 AS beat FROM _nv
       UNION ALL SELECT track_id, bar, 'rest', at_us, CASE WHEN gap >= 3.2 THEN 'whole' WHEN gap >= 1.6 THEN 'half' WHEN gap >= 0.8 THEN 'quarter' WHEN gap >= 0.4 THEN 'eighth' ELSE 'sixteenth' END,
              (at_us - bar * 1000000) / 250000 FROM _r WHERE gap >= 0.25)""",
)
register(
    "merge_frame_candidates", lambda spark, sf: vote.merge_frame_candidates(_frame_votes(spark, sf)), "track_id frame g n frequency~ midi~ confidence~", "frames",
    _VOTES_SQL + """, _o AS (SELECT *, row_number() OVER (PARTITION BY track_id, frame ORDER BY midi, method) AS rn FROM _f),
    _h AS (SELECT track_id, frame, rn, midi AS a, 1 AS g FROM _o WHERE rn = 1
           UNION ALL SELECT o.track_id, o.frame, o.rn, CASE WHEN o.midi - h.a > 1 THEN o.midi ELSE h.a END, h.g + (o.midi - h.a > 1)::INT
           FROM _h h JOIN _o o ON o.track_id = h.track_id AND o.frame = h.frame AND o.rn = h.rn + 1),
    result AS (SELECT o.track_id, o.frame, g, count(*) AS n, sum(frequency * confidence) / sum(confidence) AS frequency, sum(midi * confidence) / sum(confidence) AS midi, max(confidence) AS confidence
               FROM _o o JOIN _h h ON h.track_id = o.track_id AND h.frame = o.frame AND h.rn = o.rn GROUP BY o.track_id, o.frame, g)""", recursive=True,
)


def _models(spark, sf):
    f = src.frames(spark, sf)
    a = f.select("track_id", F.lit("a").alias("method"), "t_us", F.col("midi").cast("double").alias("pitch"), "confidence")
    b = f.filter("event_id % 3 = 0").select("track_id", F.lit("b").alias("method"), (F.col("t_us") + 5000).alias("t_us"), (F.col("midi") + 1.0).alias("pitch"), (F.col("confidence") * 0.5).alias("confidence"))
    return a.unionByName(b)


register(
    "combine_contours", lambda spark, sf: vote.combine_contours(_models(spark, sf), width=1_000_000), "track_id t_us pitch~ confidence~", "frames",
    """_a AS (SELECT track_id, t_us, midi::DOUBLE AS p, confidence AS q FROM frames), _b AS (SELECT track_id, t_us + 5000 AS t, midi + 1.0 AS p, confidence * 0.5 AS q FROM frames WHERE event_id % 3 = 0),
    _l AS (SELECT a.*, b.t AS t1, b.p AS p1, b.q AS q1 FROM _a a ASOF LEFT JOIN _b b ON a.track_id = b.track_id AND a.t_us >= b.t),
    _r AS (SELECT l.*, b.t AS t2, b.p AS p2, b.q AS q2 FROM _l l ASOF LEFT JOIN _b b ON l.track_id = b.track_id AND l.t_us < b.t),
    _i AS (SELECT track_id, t_us, p, q, CASE WHEN t1 IS NULL THEN p2 WHEN t2 IS NULL THEN p1 ELSE p1 + (p2 - p1) * ((t_us - t1) / (t2 - t1)) END AS pb,
                  CASE WHEN t1 IS NULL THEN q2 WHEN t2 IS NULL THEN q1 ELSE q1 + (q2 - q1) * ((t_us - t1) / (t2 - t1)) END AS qb FROM _r),
    _wa AS (SELECT track_id, avg(q) AS wa FROM _a GROUP BY ALL), _wb AS (SELECT track_id, avg(q) AS wb FROM _b GROUP BY ALL),
    result AS (SELECT track_id, t_us, (p * wa * q + coalesce(pb * wb * qb, 0)) / (q * wa + coalesce(qb * wb, 0) + 1e-8) AS pitch, (q * wa + coalesce(qb * wb, 0)) / (wa + coalesce(wb, 0)) AS confidence
               FROM _i JOIN _wa USING (track_id) LEFT JOIN _wb USING (track_id))""",
)


def _decoded(spark, sf):
    f = src.frames(spark, sf).filter("is_voiced")
    priors = th.note_prior(th.detect_key(f.filter("confidence > 0.3"), F.col("confidence")))
    model = th.transition_model(f.select("track_id", F.col("frame").alias("note_id"), F.col("t_us").alias("start_us"), "midi"), width=2_000_000)
    return dec.decode_hmm(f.select("track_id", "frame", F.expr("440D * pow(2D, (midi - 69) / 12D)").alias("hz"), "confidence"), priors, model, width=FRAME_SLICE)


def _refined(spark, sf):
    f = src.notes(spark, sf)
    priors = th.note_prior(th.detect_key(f))
    out = dec.refine_notes(f.withColumn("hz", F.expr("440D * pow(2D, (midi - 69) / 12D + ((note_id % 61) - 30) / 1200D)")), priors, th.transition_model(f, width=NOTE_SLICE), width=NOTE_SLICE)
    return out.groupBy("track_id").agg(F.count("*").alias("n"), F.count_if(F.col("changed")).alias("changed"))


register("refine_notes", _refined, "track_id n changed")
register("decode_hmm", _decoded, "track_id frame first midi log_p~")


# --- bends, missing scale notes, intermodulation ----------------------------------------------------------------
from notelake.operators import joins as jn  # noqa: E402
from notelake.operators import spectral as sp  # noqa: E402
from notelake.operators import techniques as tq  # noqa: E402
from notelake.plans.spectral import _spec, _tones, energy_sql  # noqa: E402


def _curves(spark, sf):
    return src.frames(spark, sf).filter("is_voiced").select("track_id", F.expr("frame div 8").alias("note_id"), "frame", F.expr("midi + (event_id % 10) / 10D").alias("pitch"), F.expr("cast(3 as int)").alias("fret"))


register(
    "bends", lambda spark, sf: tq.bends(_curves(spark, sf)), "track_id note_id bend~ target_fret confidence~", "frames",
    """_x AS (SELECT track_id, frame // 8 AS note_id, midi + (event_id % 10) / 10 AS x, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY track_id, frame // 8) AS n FROM frames WHERE is_voiced
             WINDOW w AS (PARTITION BY track_id, frame // 8 ORDER BY frame)),
    _k AS (SELECT k, exp(-0.5 * k * k) AS e FROM range(-4, 5) r(k)), _kw AS (SELECT k, e / sum(e) OVER () AS w FROM _k),
    _m AS (SELECT a.track_id, a.note_id, a.i, n, w, (i + k + 4 * n) % (2 * n) AS m FROM _x a, _kw WHERE n >= 3),
    _s AS (SELECT _m.track_id, _m.note_id, _m.i, any_value(_m.n) AS n, sum(w * b.x) AS s FROM _m JOIN _x b ON b.track_id = _m.track_id AND b.note_id = _m.note_id
             AND b.i = CASE WHEN m >= _m.n THEN 2 * _m.n - 1 - m ELSE m END GROUP BY _m.track_id, _m.note_id, _m.i),
    _b AS (SELECT track_id, note_id, any_value(n) AS n, max(s) - arg_min(s, i) AS bend, arg_max(i, (round(s, 9), -i)) AS at_i FROM _s GROUP BY track_id, note_id),
    result AS (SELECT track_id, note_id, bend, 3 + round_even(bend, 0) AS target_fret, least(1.0, bend / 2) AS confidence FROM _b WHERE bend >= 0.3 AND at_i > n * 0.1)""",
)


def _scaled_runs(spark, sf):
    rows = _runs(spark, sf)
    masks = rows.groupBy("track_id", "first_id").agg(F.count("*").alias("n"), th.pc_mask(F.col("midi")).alias("mask")).filter("n >= 4")
    return rows, th.match_scale(masks).select("track_id", "first_id", "scale", "root")


register(
    "fill_scale_gaps",
    lambda spark, sf: jn.fill_scale_gaps(*_scaled_runs(spark, sf), src.frames(spark, sf).withColumn("midi", F.expr("if(midi > 0, midi - 12, 0)"))),
    "track_id first_id midi start_us~ end_us~ confidence~",
)
register(
    "intermod_products", lambda spark, sf: sp.intermod_products(_tones(spark, sf).drop("note_id").withColumn("hz", F.expr("hz / 3 + 60")), _spec(spark, sf), 8, 0.3, 65, 1200, 175).withColumn(
        "n", F.size("products")).withColumn("total", F.aggregate("products", F.lit(0.0), lambda a, x: a + x)),
    "track_id frame n total~", "bins",
    f"""_ms AS (SELECT track_id, frame, list(mag ORDER BY bin) AS m, max(mag) AS top, CAST(80 + (frame * 37) % 1100 AS DOUBLE) / 3 + 60 AS hz FROM bins GROUP BY track_id, frame),
    _h AS (SELECT track_id, frame, m, top, hz * h AS f, h FROM _ms, range(1, 9) r(h) WHERE ({energy_sql('m', 'hz * h')}) / top > 0.3),
    _p AS (SELECT a.track_id, a.frame, a.m, a.top, unnest([a.f + b.f, abs(a.f - b.f)]) AS f FROM _h a JOIN _h b ON a.track_id = b.track_id AND a.frame = b.frame AND a.h < b.h),
    _q AS (SELECT DISTINCT track_id, frame, round(f, 6) AS f FROM _p WHERE f BETWEEN 65 AND 1200 AND floor(f / 175) BETWEEN 1 AND 63 AND m[CAST(floor(f / 175) AS INT) + 1] > 0.3 * top),
    _r AS (SELECT track_id, frame, count(*) AS n, sum(f) AS total FROM _q GROUP BY ALL),
    result AS (SELECT track_id, frame, coalesce(n, 0) AS n, coalesce(total, 0) AS total FROM _ms LEFT JOIN _r USING (track_id, frame))""",
)

_RES = ["ultra_fast", "fast", "medium", "slow"]


def _resolutions(spark, sf):
    c = src.candidates(spark, sf)
    p = c.filter("cand_id % 5 <> 0").select("track_id", "cand_id", "t_us", F.expr("cast(60 + (cand_id div 7) % 2 as int)").alias("midi"), "confidence",
                                            F.element_at(F.array(*[F.lit(r) for r in _RES]), F.expr("cast(cand_id % 4 + 1 as int)")).alias("resolution"))
    d = c.filter("cand_id % 5 = 0").groupBy("track_id", "t_us").agg((F.min("cand_id") % 3 == 0).alias("is_fast"), (F.min("cand_id") % 3 == 1).alias("is_slow"))
    return p, d


register(
    "fuse_resolutions", lambda spark, sf: vote.fuse_resolutions(*_resolutions(spark, sf), tol_us=2_000, min_dur_us=1_000, min_conf=0.2, width=100_000),
    "track_id midi start_us~ end_us~ confidence~ n", "candidates",
    f"""_p AS (SELECT track_id, cand_id, t_us, 60 + (cand_id // 7) % 2 AS midi, confidence, cand_id % 4 AS r FROM candidates WHERE cand_id % 5 <> 0),
    _d AS (SELECT track_id, t_us, min(cand_id) % 3 AS k FROM candidates WHERE cand_id % 5 = 0 GROUP BY ALL),
    _a AS (SELECT p.*, d.k AS ka FROM _p p ASOF LEFT JOIN _d d ON p.track_id = d.track_id AND p.t_us <= d.t_us),
    _b AS (SELECT a.*, coalesce(ka, d.k) AS k FROM _a a ASOF LEFT JOIN _d d ON a.track_id = d.track_id AND a.t_us >= d.t_us),
    _w AS (SELECT *, [1.2e0, 1.0e0, 0.9e0, 0.8e0][r + 1] * CASE k WHEN 0 THEN [1.5e0, 1.5e0, 0.8e0, 0.5e0][r + 1] WHEN 1 THEN [0.7e0, 0.7e0, 1.2e0, 1.5e0][r + 1] ELSE 1 END AS w,
             coalesce(t_us - lag(t_us) OVER (PARTITION BY track_id ORDER BY t_us, cand_id) > 2000, true) AS s FROM _b),
    _g AS (SELECT *, sum(s::INT) OVER (PARTITION BY track_id ORDER BY t_us, cand_id) AS g FROM _w),
    _v AS (SELECT track_id, g, midi, sum(w * confidence) AS vote, avg(confidence) AS c, min((t_us, cand_id)) AS seen, sum(t_us) AS t, count(*) AS n FROM _g GROUP BY ALL),
    _l AS (SELECT track_id, g, arg_min(midi, (-round(vote, 9), seen)) AS midi, arg_min(c, (-round(vote, 9), seen)) AS c, sum(t) / sum(n) AS t FROM _v GROUP BY track_id, g),
    _c AS (SELECT *, coalesce(midi <> lag(midi) OVER (PARTITION BY track_id ORDER BY g), true) AS s FROM _l),
    _h AS (SELECT *, sum(s::INT) OVER (PARTITION BY track_id ORDER BY g) AS h FROM _c),
    _k AS (SELECT *, row_number() OVER (PARTITION BY track_id, h ORDER BY g) AS i, count(*) OVER (PARTITION BY track_id, h) AS m FROM _h),
    _n AS (SELECT track_id, h, any_value(midi) AS midi, min(t) AS start_us, max(t) AS end_us, sum(c * pow(0.5, m - i + CASE WHEN i = 1 THEN 0 ELSE 1 END)) AS confidence, count(*) AS n FROM _k GROUP BY track_id, h),
    result AS (SELECT * FROM _n WHERE end_us - start_us >= 1000 AND confidence >= 0.2)""",
)


# --- riffs ------------------------------------------------------------------------------------------------------
def _melody(spark, sf):
    """Notes on a grid of half seconds and within a third, so that sequences come back."""
    return src.notes(spark, sf).withColumn("start_us", F.expr("start_us div 500000 * 500000")).withColumn("midi", F.expr("cast(60 + midi % 3 as int)"))


register(
    "repeated_riffs", lambda spark, sf: sq.repeated_riffs(_melody(spark, sf), 3, 16, width=NOTE_SLICE).withColumn(
        "occurrences", F.array_join(F.transform("occurrences", lambda x: (F.round(x * 100)).cast("bigint").cast("string")), ",")),
    "track_id first length n occurrences$", "notes",
    """_m AS (SELECT track_id, note_id, start_us // 500000 * 500000 AS t, 60 + midi % 3 AS m FROM notes),
    _r AS (SELECT *, row_number() OVER w - 1 AS rn, list(m) OVER (w ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING) AS ms, list(t) OVER (w ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING) AS ts,
                  count(*) OVER (PARTITION BY track_id) AS nt FROM _m WINDOW w AS (PARTITION BY track_id ORDER BY t, note_id)),
    _l AS (SELECT track_id, rn, t, l, ms, ts FROM _r, range(3, 17) g(l) WHERE l <= len(ms) AND l <= nt // 2 AND nt >= 6),
    _g AS (SELECT track_id, rn, t, l, list_transform(range(1, l), lambda i: ms[i + 1] - ms[i]) AS d, list_transform(range(1, l), lambda i: ts[i + 1] - ts[i]) AS s FROM _l),
    _h AS (SELECT a.track_id, a.rn, a.l, a.t, b.rn AS brn, b.t AS bt FROM _g a JOIN _g b ON a.track_id = b.track_id AND a.l = b.l AND a.d = b.d AND b.rn >= a.rn + a.l
           WHERE len(list_filter(range(1, a.l), lambda i: a.s[i] > 0 AND abs(b.s[i] - a.s[i]) * 10 > a.s[i])) = 0),
    _o AS (SELECT track_id, rn AS first, l AS length, count(*) + 1 AS n,
                  CAST(CAST(round(min(t) / 1e4) AS BIGINT) AS VARCHAR) || ',' || string_agg(CAST(CAST(round(bt / 1e4) AS BIGINT) AS VARCHAR), ',' ORDER BY brn) AS occurrences FROM _h GROUP BY ALL),
    result AS (SELECT * FROM _o QUALIFY row_number() OVER (PARTITION BY track_id, occurrences ORDER BY length, first) = 1)""",
)

