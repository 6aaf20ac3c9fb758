"""Frame window, technique and export queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from notelake.operators import export as ex
from notelake.operators import techniques as tq
from notelake.operators import windows as win
from notelake.plans.registry import anchored_sql, register
from notelake.plans.segment import FRAME_SLICE, NOTE_SLICE
from notelake.plans.tabs import STATIC, _static
from notelake.plans.theory import CHORDS_SQL, _chords
from notelake.operators import positions as pos
from notelake.sources import adapters as src

register(
    "median_smooth", lambda spark, sf: win.median_smooth(src.frames(spark, sf), 5, width=FRAME_SLICE), "track_id frame smooth~ smooth_conf~", "frames",
    """_w AS (SELECT *, list(midi) OVER w AS ms, sum(confidence) OVER w / 5 AS sc, count(*) OVER (PARTITION BY track_id) AS n FROM frames
              WINDOW w AS (PARTITION BY track_id ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
       result AS (SELECT track_id, frame, CASE WHEN midi > 0 THEN list_sort(list_concat(ms, list_resize([]::BIGINT[], 5 - len(ms), 0)))[3] ELSE midi END AS smooth,
                  CASE WHEN n < 5 THEN confidence ELSE sc END AS smooth_conf FROM _w)""",
)
CONT_SQL = """_nb AS (SELECT a.track_id, a.frame, median(b.midi) AS med FROM frames a JOIN frames b ON a.track_id = b.track_id AND b.midi > 0
              AND b.frame BETWEEN a.frame - 5 AND a.frame + 5 AND b.frame <> a.frame GROUP BY ALL),
    _ct AS (SELECT f.*, CAST(trunc(med) AS INT) AS mid FROM frames f LEFT JOIN _nb USING (track_id, frame)),
    _cj AS (SELECT *, coalesce(midi > 0 AND abs(midi - mid) > 12, false) AS jump FROM _ct),
    _ck AS (SELECT *, jump AND abs(midi - 12 - mid) <= 3 AS dn, jump AND NOT abs(midi - 12 - mid) <= 3 AND abs(midi + 12 - mid) <= 3 AS up FROM _cj),
    cont AS (SELECT track_id, frame, CASE WHEN dn THEN midi - 12 WHEN up THEN midi + 12 ELSE midi END AS new_midi,
             CASE WHEN midi = 0 THEN 0 WHEN dn OR up THEN confidence * 0.8 ELSE confidence END AS new_conf,
             midi > 0 AND (NOT jump OR dn OR up) AND CASE WHEN dn THEN midi - 12 WHEN up THEN midi + 12 ELSE midi END BETWEEN 40 AND 88 AS is_valid FROM _ck)"""


def _continuity(spark, sf, jump=12):
    return win.continuity_check(src.frames(spark, sf), 5, jump, width=FRAME_SLICE)


register("continuity_check", lambda spark, sf: _continuity(spark, sf, 7), "track_id frame new_midi new_conf~ is_valid!", "frames",
         CONT_SQL.replace("> 12, false", "> 7, false") + ", result AS (SELECT * FROM cont)")


def _gappy(spark, sf):
    f = _continuity(spark, sf, 7)
    return f.select("track_id", "frame", F.col("new_midi").alias("midi"), F.col("new_conf").alias("confidence"), "is_valid")


_FILL = CONT_SQL.replace("> 12, false", "> 7, false") + """,
    _fa AS (SELECT *, CASE WHEN is_valid AND new_midi > 0 THEN frame END AS g FROM cont),
    _fb AS (SELECT *, max(g) OVER (PARTITION BY track_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a,
                   min(g) OVER (PARTITION BY track_id ORDER BY frame ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS b FROM _fa),
    _fc AS (SELECT t.*, x.new_midi AS am, y.new_midi AS bm, coalesce(t.g IS NULL AND b - a - 1 <= {gap} AND abs(x.new_midi - y.new_midi) <= 2, false) AS filled
            FROM _fb t LEFT JOIN cont x ON x.track_id = t.track_id AND x.frame = t.a LEFT JOIN cont y ON y.track_id = t.track_id AND y.frame = t.b)"""
register(
    "fill_gaps", lambda spark, sf: win.fill_gaps(_gappy(spark, sf), 3, "constant", FRAME_SLICE), "track_id frame midi confidence~ is_valid! filled!", "frames",
    _FILL.format(gap=3) + """, result AS (SELECT track_id, frame, CASE WHEN filled THEN round_even((am + bm) / 2, 0) ELSE new_midi END AS midi,
        CASE WHEN filled THEN 0.5 ELSE new_conf END AS confidence, is_valid OR filled AS is_valid, filled FROM _fc)""",
)
register(
    "fill_gaps_linear", lambda spark, sf: win.fill_gaps(_gappy(spark, sf), 5, "linear", FRAME_SLICE), "track_id frame frequency~ confidence~ filled!", "frames",
    _FILL.format(gap=5) + """, result AS (SELECT track_id, frame, filled, CASE WHEN filled THEN 0.3 ELSE new_conf END AS confidence,
        CASE WHEN filled THEN 440 * pow(2, (am - 69) / 12.0) * (1 - (frame - a) / (b - a)) + 440 * pow(2, (bm - 69) / 12.0) * ((frame - a) / (b - a))
             WHEN new_midi > 0 THEN 440 * pow(2, (new_midi - 69) / 12.0) ELSE 0 END AS frequency FROM _fc)""",
)
register(
    "fill_gaps_midi", lambda spark, sf: win.fill_gaps(_gappy(spark, sf), 5, "midi", FRAME_SLICE), "track_id frame frequency~ confidence~ filled!", "frames",
    _FILL.format(gap=5) + """, result AS (SELECT track_id, frame, filled, CASE WHEN filled THEN 0.3 ELSE new_conf END AS confidence,
        CASE WHEN filled THEN 440 * pow(2, (am + (bm - am) * ((frame - a) / (b - a)) - 69) / 12.0)
             WHEN new_midi > 0 THEN 440 * pow(2, (new_midi - 69) / 12.0) ELSE 0 END AS frequency FROM _fc)""",
)
register(
    "note_density",
    lambda spark, sf: win.note_density(src.frames(spark, sf), src.onset_frames(spark, sf), 20, width=FRAME_SLICE),
    "track_id frame density~ is_fast! is_slow!", "frames",
    """_n AS (SELECT track_id, max(frame) + 1 AS n FROM frames GROUP BY ALL),
       _d AS (SELECT f.track_id, f.frame, n, sum((event_id % 6 = 0)::INT) OVER (PARTITION BY f.track_id ORDER BY f.frame ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING)
              / ((least(n, f.frame + 10) - greatest(0, f.frame - 10)) * 0.02322) AS raw FROM frames f JOIN _n USING (track_id)),
       _m AS (SELECT track_id, frame AS slot, n, raw FROM _d UNION ALL SELECT track_id, -1 - frame, n, raw FROM _d WHERE frame < 2
              UNION ALL SELECT track_id, 2 * n - 1 - frame, n, raw FROM _d WHERE frame >= n - 2),
       _s AS (SELECT track_id, slot AS frame, n, avg(raw) OVER (PARTITION BY track_id ORDER BY slot ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS density FROM _m),
       result AS (SELECT *, density > 8 AS is_fast, density < 4 AS is_slow FROM _s WHERE frame >= 0 AND frame < n)""",
)
FAST_SQL = """_fn AS (SELECT track_id, max(frame) + 1 AS n FROM frames GROUP BY ALL),
    _fd AS (SELECT f.*, n, coalesce(abs(midi - lag(midi) OVER (PARTITION BY f.track_id ORDER BY frame)), 0) AS d FROM frames f JOIN _fn USING (track_id)),
    _fh AS (SELECT *, frame < n - 12 AND sum((d BETWEEN 1 AND 5)::INT) OVER w >= 3 AND avg(is_voiced::INT) OVER w > 0.7 AS hot FROM _fd
            WINDOW w AS (PARTITION BY track_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING)),
    fast AS (SELECT *, bool_or(hot) OVER (PARTITION BY track_id ORDER BY frame ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS is_fast FROM _fh)"""


def _fast(spark, sf):
    return win.fast_regions(src.frames(spark, sf), 12, FRAME_SLICE)


register("fast_regions", _fast, "track_id frame is_fast!", "frames", FAST_SQL + ", result AS (SELECT * FROM fast)")


def _legato(spark, sf):
    f = _fast(spark, sf).withColumn("onset_env", F.expr("cast((event_id % 7) / 10 as double)")).withColumn(
        "attack_env", F.expr("cast((event_id % 10) / 10 as double)"))
    return win.legato_onsets(f, 3, width=FRAME_SLICE), f


LEGATO_SQL = FAST_SQL + """,
    _lc AS (SELECT *, d >= 0.5 AND (event_id % 10) / 10 < 0.3 AS leg FROM fast
            WHERE is_voiced AND frame BETWEEN 1 AND n - 2
              AND ((d >= 0.5 AND (event_id % 10) / 10 < 0.3) OR (is_fast AND ((event_id % 7) / 10 > 0.15 OR d >= 0.5)))),""" + anchored_sql(
    "_lc", 3, "frame", "frame", strict=True) + """,
    lon AS (SELECT track_id, frame, n, CASE WHEN leg THEN least(1.0, confidence + 0.2) ELSE confidence END AS onset_conf FROM grouped WHERE frame = anchor_t)"""
register("legato_onsets", lambda spark, sf: _legato(spark, sf)[0], "track_id frame onset_conf~", "frames", LEGATO_SQL + ", result AS (SELECT * FROM lon)", recursive=True)
register(
    "legato_notes", lambda spark, sf: win.legato_notes(*_legato(spark, sf), width=FRAME_SLICE), "track_id frame stop midi confidence~", "frames",
    LEGATO_SQL + """, _le AS (SELECT *, coalesce(lead(frame) OVER (PARTITION BY track_id ORDER BY frame), least(frame + 80, n - 1)) AS e FROM lon),
    _lf AS (SELECT * REPLACE (CASE WHEN e - frame < 3 THEN frame + 3 ELSE e END AS e) FROM _le WHERE e - frame >= 3 OR frame + 3 < n),
    _lg AS (SELECT o.track_id, o.frame, any_value(e) AS stop, any_value(onset_conf) AS oc, round_even(median(f.midi), 0) AS midi, avg(f.confidence) AS c
            FROM _lf o JOIN frames f ON f.track_id = o.track_id AND f.midi > 0 AND f.frame >= o.frame AND f.frame < least(o.frame + 10, e) GROUP BY o.track_id, o.frame),
    result AS (SELECT *, c * oc AS confidence FROM _lg WHERE midi BETWEEN 40 AND 88)""", recursive=True,
)


def _jumps(spark, sf):
    f = src.frames(spark, sf).withColumn("energy", F.expr("(event_id % 10) / 10D"))
    return win.legato_jumps(f, f.filter("event_id % 6 = 0"), width=FRAME_SLICE)


register(
    "legato_jumps", _jumps, "track_id frame confidence~ attack_strength~", "frames",
    """_n AS (SELECT track_id, max(frame) + 1 AS n FROM frames GROUP BY ALL),
    _j AS (SELECT *, (event_id % 10) / 10 AS energy, abs(midi - lag(midi) OVER (PARTITION BY track_id ORDER BY frame)) AS jump FROM frames),
    result AS (SELECT track_id, frame, 0.6 AS confidence, energy AS attack_strength FROM _j JOIN _n USING (track_id) WHERE jump >= 1.5 AND energy < 0.3 AND frame BETWEEN 1 AND n - 2
               AND NOT EXISTS (SELECT 1 FROM frames o WHERE o.track_id = _j.track_id AND o.event_id % 6 = 0 AND abs(o.frame - _j.frame) < 5))""",
)


def _trend(spark, sf):
    f = src.frames(spark, sf).filter("is_voiced").withColumn("note", F.expr("frame div 8")).withColumn("pitch", F.col("midi").cast("double"))
    return win.pitch_trend(f, ["track_id", "note"]).filter("n >= 3")


_TREND = """_p AS (SELECT track_id, frame // 8 AS note, frame, t_us, midi, sign(midi - lag(midi) OVER w) AS d FROM frames WHERE is_voiced
              WINDOW w AS (PARTITION BY track_id, frame // 8 ORDER BY frame)),
       _t AS (SELECT *, coalesce(d * lag(d) OVER (PARTITION BY track_id, note ORDER BY frame) < 0, false) AS turn FROM _p),
       trend AS (SELECT track_id, note, count(*) AS n, regr_slope(midi, t_us / 1e6) AS slope, stddev_pop(midi) AS std, arg_max(midi, frame) - arg_min(midi, frame) AS change,
                  sum(turn::INT) AS turns FROM _t GROUP BY ALL HAVING count(*) >= 3)"""
register("pitch_trend", _trend, "track_id note n slope~ std~ change~ turns", "frames", _TREND + ", result AS (SELECT * FROM trend)")
register(
    "dive_bombs", lambda spark, sf: win.dive_bombs(_trend(spark, sf).withColumn("dur_s", F.lit(8 * 0.02322))), "track_id note drop~ confidence~", "frames",
    _TREND + """, _d AS (SELECT *, abs(slope) * (8 * 0.02322e0) AS dr, 1 - least(1.0, turns / 2.0) AS smooth FROM trend),
    result AS (SELECT track_id, note, dr AS drop, 0.3e0 * least(1.0, abs(slope) / 15.0) + 0.35e0 * least(1.0, dr / 12.0) + 0.35e0 * smooth AS confidence FROM _d
               WHERE slope <= -3 AND dr >= 4 AND smooth >= 0.5 AND 0.3e0 * least(1.0, abs(slope) / 15.0) + 0.35e0 * least(1.0, dr / 12.0) + 0.35e0 * smooth > 0.6)""",
)

# --- techniques -------------------------------------------------------------------------------------------------
def _tabs(spark, sf):
    return _static(spark, sf).withColumn("is_legato", F.expr("note_id % 4 = 0")).withColumn(
        "end_pitch", F.expr("if(note_id % 2 = 0, midi + (note_id % 5 - 1) * 1.5D, null)")).withColumn("attack_strength", F.expr("cast((note_id % 9) / 10 as double)"))


_TAB = STATIC + """, tb AS (SELECT *, note_id % 4 = 0 AS leg, CASE WHEN note_id % 2 = 0 THEN midi + (note_id % 5 - 1) * 1.5 END AS ep, (note_id % 9) / 10 AS att FROM tabs),
    tn AS (SELECT *, lead(start_us) OVER w - start_us - dur_us AS gap, lead(midi) OVER w - midi AS d, lead(midi) OVER w AS nm, lead(leg) OVER w AS nl,
                  lead(string) OVER w AS ns, lead(fret) OVER w AS nf FROM tb WINDOW w AS (PARTITION BY track_id ORDER BY start_us, note_id))"""
register(
    "hammer_pull", lambda spark, sf: tq.hammer_pull(_tabs(spark, sf), width=NOTE_SLICE), "note_id technique$ target_fret confidence~", "notes",
    _TAB + """, result AS (SELECT note_id, CASE WHEN d > 0 THEN 'hammer_on' ELSE 'pull_off' END AS technique, nf AS target_fret, CASE WHEN ns = string THEN 0.9 ELSE 0.7 END AS confidence
               FROM tn WHERE nl AND gap <= 150000 AND d <> 0)""",
)
register(
    "slides", lambda spark, sf: tq.slides(_tabs(spark, sf), width=NOTE_SLICE), "note_id technique$ target_fret confidence~", "notes",
    _TAB + """, result AS (SELECT note_id, CASE WHEN d > 0 THEN 'slide_up' ELSE 'slide_down' END AS technique, nf AS target_fret, 0.8 AS confidence FROM tn
      WHERE ns = string AND gap <= 80000 AND abs(d) BETWEEN 2 AND 12 AND NOT nl AND CASE WHEN ep IS NULL THEN dur_us < 200000
            WHEN d > 0 THEN ep BETWEEN midi AND nm + 0.5 ELSE ep BETWEEN nm - 0.5 AND midi END)""",
)
_LINK = STATIC + """, _lp AS (SELECT *, lag(string) OVER w AS ps, midi - lag(midi) OVER w AS d, start_us - lag(start_us + dur_us) OVER w AS gap FROM tabs
        WINDOW w AS (PARTITION BY track_id ORDER BY start_us, note_id)),
    linked AS (SELECT *, CASE WHEN ps <> string OR ps IS NULL THEN NULL WHEN gap < 80000 AND d BETWEEN 1 AND 4 THEN 'hammer-on' WHEN gap < 80000 AND d BETWEEN -4 AND -1 THEN 'pull-off'
               WHEN gap < 50000 AND abs(d) >= 2 THEN 'slide' END AS technique FROM _lp)"""
register("link_technique", lambda spark, sf: tq.link_technique(_static(spark, sf), NOTE_SLICE).filter("technique is not null"),
         "note_id technique$ technique_target", "notes", _LINK + ", result AS (SELECT *, fret AS technique_target FROM linked WHERE technique IS NOT NULL)")
_TAP = """_tp AS (SELECT *, note_id % 4 = 0 AS leg, (note_id % 9) / 10 AS att, coalesce(abs(midi - lag(midi) OVER w), 0) AS back, coalesce(abs(lead(midi) OVER w - midi), 0) AS ahead,
                   CASE WHEN midi - 40 BETWEEN 0 AND 24 THEN midi - 40 WHEN midi - 45 BETWEEN 0 AND 24 THEN midi - 45 WHEN midi - 50 BETWEEN 0 AND 24 THEN midi - 50
                        WHEN midi - 55 BETWEEN 0 AND 24 THEN midi - 55 WHEN midi - 59 BETWEEN 0 AND 24 THEN midi - 59 WHEN midi - 64 BETWEEN 0 AND 24 THEN midi - 64 END AS fret
            FROM notes WINDOW w AS (PARTITION BY track_id ORDER BY start_us, note_id)),
    _tc AS (SELECT *, round(CASE WHEN greatest(back, ahead) >= 12 THEN 0.4 WHEN greatest(back, ahead) >= 7 THEN 0.2 ELSE 0 END
              + CASE WHEN fret >= 15 THEN 0.3 WHEN fret >= 12 THEN 0.2 WHEN fret >= 10 THEN 0.1 ELSE 0 END + CASE WHEN leg THEN 0.2 ELSE 0 END + CASE WHEN att < 0.4 THEN 0.2 ELSE 0 END, 6) AS conf
            FROM _tp WHERE fret IS NOT NULL AND (back >= 7 OR (fret >= 10 AND ahead >= 7))),
    taps AS (SELECT *, conf >= 0.4 AND ((back >= 7 AND att < 0.4) OR (fret >= 10 AND ahead >= 7) OR (leg AND back >= 10)) AS valid FROM _tc)"""


def _taps(spark, sf):
    return tq.tap_candidates(_tabs(spark, sf).drop("string", "fret"), 7, 10, width=NOTE_SLICE)


register("tap_candidates", _taps, "note_id fret back ahead confidence~ valid!", "notes", _TAP + ", result AS (SELECT * REPLACE (conf AS confidence) FROM taps)")
register(
    "tap_patterns", lambda spark, sf: tq.tap_patterns(_taps(spark, sf).filter("valid"), src.notes(spark, sf), 60_000, width=NOTE_SLICE), "note_id n kind$ pitches$ confidence~", "notes",
    _TAP + """,
    _pl AS (SELECT t.note_id, t.midi AS m0, t.start_us AS t0, t.conf, n.start_us AS t, n.midi AS m, row_number() OVER (PARTITION BY t.note_id ORDER BY n.start_us, n.note_id) AS k
            FROM taps t JOIN notes n ON n.track_id = t.track_id AND n.start_us > t.start_us AND n.start_us <= t.start_us + 180000 WHERE valid),
    _pg AS (SELECT *, t - coalesce(lag(t) OVER (PARTITION BY note_id ORDER BY k), t0) AS g FROM _pl WHERE k <= 3),
    _pb AS (SELECT *, max((g > 60000)::INT) OVER (PARTITION BY note_id ORDER BY k) AS broken FROM _pg),
    _pc AS (SELECT note_id, any_value(conf) AS confidence, list_concat([any_value(m0)], list(m ORDER BY k)) AS ms FROM _pb WHERE broken = 0 GROUP BY ALL HAVING count(*) >= 2),
    _pd AS (SELECT *, list_transform(range(2, len(ms) + 1), lambda i: ms[i] - ms[i - 1]) AS ds FROM _pc),
    result AS (SELECT note_id, len(ms) AS n, confidence, array_to_string(ms, '-') AS pitches,
               CASE WHEN len(list_distinct(list_transform(list_filter(ds, lambda d: d <> 0), lambda d: abs(d)))) <= 2 THEN 'arpeggio'
                    WHEN len(list_filter(ds, lambda d: d < 0)) >= len(ds) - 1 THEN 'sequence' ELSE 'mixed' END AS kind FROM _pd)""",
)
register(
    "duration_to_next", lambda spark, sf: tq.duration_to_next(src.notes(spark, sf).select("track_id", F.col("note_id").alias("onset_id"), F.col("start_us").alias("t_us")), width=NOTE_SLICE),
    "onset_id dur_us", "notes", "result AS (SELECT note_id AS onset_id, coalesce(lead(start_us) OVER (PARTITION BY track_id ORDER BY start_us, note_id) - start_us, 500000) AS dur_us FROM notes)",
)


def _classified(spark, sf):
    n = src.notes(spark, sf)
    kinds = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(t).alias("technique"), F.expr(f"cast((note_id * {7 + 4 * i}) % 100 / 100 as double)").alias("confidence"),
                               F.expr(f"(note_id * {7 + 4 * i}) % 100 > 60").alias("detected")) for i, t in enumerate(["pinch", "natural", "dive"])])
    return n, n.filter("note_id % 5 <> 0").select("track_id", "note_id", F.inline(kinds))


register(
    "best_technique", lambda spark, sf: tq.best_technique(*_classified(spark, sf)), "note_id technique$ confidence~", "notes",
    "_k AS (" + " UNION ALL ".join(f"SELECT note_id, {i} AS o, '{t}' AS t, (note_id * {7 + 4 * i}) % 100 / 100 AS c FROM notes WHERE note_id % 5 <> 0" for i, t in enumerate(["pinch", "natural", "dive"])) + """),
    _b AS (SELECT note_id, arg_max(t, (c, -o)) FILTER (c > 0.6) AS t, max(c) FILTER (c > 0.6) AS top, max(c) AS most FROM _k GROUP BY ALL),
    result AS (SELECT n.note_id, coalesce(t, 'normal') AS technique, coalesce(top, 1 - coalesce(most, 0)) AS confidence FROM notes n LEFT JOIN _b USING (note_id))""",
)

# --- export -----------------------------------------------------------------------------------------------------
def _extents(spark, sf):
    return src.notes_dense(spark, sf).groupBy("track_id").agg(F.max(F.expr("start_us + dur_us")).alias("dur_us"))


_EXT = "ext AS (SELECT track_id, max(start_us + dur_us) AS dur_us FROM notes_dense GROUP BY ALL)"
_BEATS = _EXT + """, bt AS (SELECT track_id, k * 125000 AS t_us, k % 4 + 1 AS beat, k // 4 + 1 AS measure, k % 4 = 0 AS is_downbeat FROM ext, range(0, 1000) r(k) WHERE k * 125000 < dur_us),
    ms AS (SELECT track_id, measure, min(t_us) AS start_us, least(measure * 500000, any_value(dur_us)) AS end_us, count(*) AS beats FROM bt JOIN ext USING (track_id) GROUP BY track_id, measure)"""
register("beats", lambda spark, sf: ex.beats(_extents(spark, sf), 480), "track_id t_us beat measure is_downbeat!", "notes_dense", _BEATS + ", result AS (SELECT * FROM bt)")
register("measures", lambda spark, sf: ex.measures(_extents(spark, sf), 480), "track_id measure start_us end_us beats", "notes_dense", _BEATS + ", result AS (SELECT * FROM ms)")


def _timeline(spark, sf):
    tabs = pos.static_position(src.notes_dense(spark, sf)).withColumn("technique", F.expr("if(note_id % 3 = 0, 'bend', null)"))
    t = _extents(spark, sf)
    rows = ex.timeline(tabs, _chords(spark, sf), ex.beats(t, 480), ex.measures(t, 480))
    return rows.withColumn("data", F.expr("array_join(transform(array_sort(map_entries(data)), e -> concat(e.key, '=', e.value)), ' ')"))


register(
    "timeline", _timeline, "track_id t_us prio type$ ord data$", "notes_dense",
    CHORDS_SQL + "," + STATIC.replace("FROM notes n", "FROM notes_dense n") + "," + _BEATS + """, result AS (
      SELECT track_id, start_us AS t_us, 1 AS prio, 'note_on' AS type, note_id AS ord, 'fret=' || fret || ' midi=' || midi || ' note_id=' || note_id || ' string=' || string AS data FROM tabs
      UNION ALL SELECT track_id, start_us + dur_us, 1, 'note_off', note_id, 'note_id=' || note_id FROM tabs
      UNION ALL SELECT track_id, start_us, 1, 'technique', note_id, 'note_id=' || note_id || ' technique=bend' FROM tabs WHERE note_id % 3 = 0
      UNION ALL SELECT track_id, start_us, 1, 'chord_start', start_us, 'name=' || name FROM chords
      UNION ALL SELECT track_id, start_us + dur_us, 1, 'chord_end', start_us, 'name=' || name FROM chords
      UNION ALL SELECT track_id, t_us, 1, 'beat', t_us, 'beat=' || beat || ' downbeat=' || is_downbeat || ' measure=' || measure FROM bt
      UNION ALL SELECT track_id, start_us, 0, 'measure', measure, 'beats=' || beats || ' number=' || measure FROM ms)""", recursive=True,
)
register(
    "tab_grid", lambda spark, sf: ex.tab_grid(_static(spark, sf)), "track_id line string cells$", "notes",
    STATIC + """, _c AS (SELECT track_id, string, start_us // 125000 AS slot, arg_max(fret, (start_us, note_id)) AS fret FROM tabs GROUP BY ALL),
    _z AS (SELECT track_id, max(start_us + dur_us) // 125000 + 1 AS slots FROM tabs GROUP BY ALL),
    _g AS (SELECT track_id, s AS slot, st AS string FROM _z, range(0, 500) a(s), range(0, 6) b(st) WHERE s < slots),
    result AS (SELECT track_id, slot // 16 AS line, string, string_agg(CASE WHEN fret IS NULL THEN '-' WHEN fret < 10 THEN fret::VARCHAR ELSE '(' || fret || ')' END, '' ORDER BY slot) AS cells
               FROM _g LEFT JOIN _c USING (track_id, string, slot) GROUP BY ALL)""",
)
register(
    "note_distribution", lambda spark, sf: ex.note_distribution(src.notes(spark, sf)).select(F.coalesce("track_id", F.lit(-1)).alias("track_id"), F.coalesce("pc", F.lit(-1)).alias("pc"), "n", "level"),
    "track_id pc n level", "notes",
    "result AS (SELECT coalesce(track_id, -1) AS track_id, coalesce(midi % 12, -1) AS pc, count(*) AS n, grouping_id(track_id, midi % 12) AS level FROM notes GROUP BY CUBE (track_id, midi % 12))",
)
register(
    "polyphony_histogram", lambda spark, sf: ex.polyphony_histogram(src.notes_dense(spark, sf)), "track_id size n", "notes_dense",
    """_c AS (SELECT track_id, round_even(start_us / 50000, 0) AS cell, count(*) AS size FROM notes_dense GROUP BY ALL),
       result AS (SELECT track_id, size, count(*) AS n FROM _c GROUP BY ALL)""",
)
register(
    "top_notes", lambda spark, sf: ex.top_notes(src.notes(spark, sf), 10), "track_id midi n rank", "notes",
    """_c AS (SELECT track_id, midi, count(*) AS n FROM notes GROUP BY ALL),
       result AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY n DESC, midi) AS rank FROM _c) WHERE rank <= 10)""",
)


def _annotated_all(spark, sf):
    tabs = _tabs(spark, sf)
    bent = tabs.filter("note_id % 13 = 0").select("track_id", "note_id", (F.col("fret") + 2).alias("target_fret"), F.lit(0.5).alias("confidence"))
    shaken = tabs.filter("note_id % 17 = 0").select("track_id", "note_id", (F.col("fret") + 1).alias("target_fret"), F.lit(0.7).alias("confidence"))
    return tq.annotate_techniques(tabs.withColumn("midi", F.expr("55 + midi % 16")), bent, width=NOTE_SLICE, trill_rows=shaken)


register(
    "annotate_techniques", lambda spark, sf: _annotated_all(spark, sf).withColumn("target_fret", F.coalesce("target_fret", F.lit(-1))), "note_id technique$ target_fret confidence~", "notes",
    _TAB.replace("FROM tabs)", "FROM (SELECT * REPLACE (55 + midi % 16 AS midi), midi AS midi0 FROM tabs))").replace("THEN midi + (note_id % 5 - 1)", "THEN midi0 + (note_id % 5 - 1)") + """,
    _t3 AS (SELECT *, CASE WHEN nl AND gap <= 150000 AND d > 0 THEN 'hammer_on' WHEN nl AND gap <= 150000 AND d < 0 THEN 'pull_off' WHEN note_id % 13 = 0 THEN 'bend'
        WHEN ns = string AND gap <= 80000 AND abs(d) BETWEEN 2 AND 12 AND NOT nl AND CASE WHEN ep IS NULL THEN dur_us < 200000 WHEN d > 0 THEN ep BETWEEN midi AND nm + 0.5 ELSE ep BETWEEN nm - 0.5 AND midi END
        THEN CASE WHEN d > 0 THEN 'slide_up' ELSE 'slide_down' END WHEN note_id % 17 = 0 THEN 'trill' END AS t FROM tn),
    _o AS (SELECT *, start_us + dur_us AS end_us, row_number() OVER (PARTITION BY track_id ORDER BY start_us, note_id) AS rn FROM _t3),
    _g AS (SELECT track_id, rn, midi AS a, rn AS g, end_us, dur_us, t FROM _o WHERE rn = 1
           UNION ALL SELECT o.track_id, o.rn, CASE WHEN b THEN o.midi ELSE x.a END, CASE WHEN b THEN o.rn ELSE x.g END, o.end_us, o.dur_us, o.t
           FROM _g x JOIN _o o ON o.track_id = x.track_id AND o.rn = x.rn + 1,
                LATERAL (SELECT o.t IS NOT NULL OR x.t IS NOT NULL OR abs(o.midi - x.a) > 1 OR o.start_us - x.end_us > 80000 OR x.dur_us > 150000 AS b)),
    _r AS (SELECT o.track_id, x.g, count(*) / ((arg_max(o.end_us, o.rn) - min(o.start_us)) / 1e6) AS rate FROM _o o JOIN _g x ON o.track_id = x.track_id AND o.rn = x.rn
           GROUP BY o.track_id, x.g HAVING count(*) >= 3 AND arg_max(o.end_us, o.rn) > min(o.start_us)),
    _t4 AS (SELECT o.*, CASE WHEN o.t IS NULL AND rate >= 8 THEN 'tremolo' ELSE o.t END AS t4, rate FROM _o o JOIN _g x USING (track_id, rn) LEFT JOIN _r ON _r.track_id = o.track_id AND _r.g = x.g),
    _t5 AS (SELECT *, coalesce((t4 IS NULL OR t4 IN ('hammer_on', 'pull_off')) AND nm IS NOT NULL AND fret >= 10 AND (att < 0.5 OR leg)
              AND (midi - nm >= 7 OR coalesce(midi - lag(midi) OVER (PARTITION BY track_id ORDER BY start_us, note_id) >= 7, false)), false) AS tap FROM _t4),
    result AS (SELECT note_id, CASE WHEN tap THEN 'tap' ELSE coalesce(t4, 'none') END AS technique,
        CASE WHEN tap THEN nf WHEN t4 IN ('hammer_on', 'pull_off', 'slide_up', 'slide_down') THEN nf WHEN t4 = 'bend' THEN fret + 2 WHEN t4 = 'trill' THEN fret + 1 ELSE -1 END AS target_fret,
        CASE WHEN tap THEN CASE WHEN leg THEN 0.8 ELSE 0.6 END WHEN t4 IN ('hammer_on', 'pull_off') THEN CASE WHEN ns = string THEN 0.9 ELSE 0.7 END WHEN t4 = 'bend' THEN 0.5 WHEN t4 = 'trill' THEN 0.7
             WHEN t4 IN ('slide_up', 'slide_down') THEN 0.8 WHEN t4 = 'tremolo' THEN least(1.0, rate / 15) ELSE 0 END AS confidence FROM _t5)""", recursive=True,
)


def _offsets(spark, sf):
    f = src.frames(spark, sf).withColumn("rms", F.expr("confidence * (60 - frame % 60) / 60D")).withColumn("pitch", F.expr("cast(midi as double)"))
    return win.note_offsets(src.onset_frames(spark, sf).withColumnRenamed("event_id", "onset_id"), f, spread=2.05, width=FRAME_SLICE)


register(
    "note_offsets", _offsets, "track_id onset_id offset_frame method$ confidence~", "frames",
    """_f AS (SELECT track_id, frame, confidence * (60 - frame % 60) / 60e0 AS rms, midi::DOUBLE AS pitch FROM frames),
    _w AS (SELECT *, count(*) FILTER (pitch > 0) OVER w AS nv, stddev_pop(CASE WHEN pitch > 0 THEN pitch END) OVER w AS sd FROM _f
           WINDOW w AS (PARTITION BY track_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
    _n AS (SELECT track_id, max(frame) AS last FROM _f GROUP BY ALL),
    _o AS (SELECT track_id, event_id AS onset_id, frame AS fr, lead(frame) OVER (PARTITION BY track_id ORDER BY frame) AS nxt FROM frames WHERE event_id % 6 = 0),
    _s AS (SELECT *, least(last, fr + 172, coalesce(nxt + 86, last)) AS stop FROM _o JOIN _n USING (track_id)),
    _j AS (SELECT s.*, frame - fr AS i, rms, pitch, nv, sd FROM _s s JOIN _w w ON w.track_id = s.track_id AND w.frame BETWEEN fr AND stop),
    _p AS (SELECT *, max(rms) FILTER (i < 10) OVER (PARTITION BY onset_id) AS peak FROM _j),
    _a AS (SELECT track_id, onset_id, fr, nxt, last, max(peak) AS peak, bool_or(pitch > 0) AS heard, min(fr + i) FILTER (i >= 4 AND (rms < peak * 0.1e0 OR rms < 0.01e0)) AS e,
                  min(fr + i) FILTER (i >= 4 AND fr + i <= stop - 5 AND (nv < 2 OR sd > 2.05)) AS p FROM _p GROUP BY ALL),
    _b AS (SELECT track_id, onset_id, fr, peak, e, CASE WHEN heard THEN p END AS p, CASE WHEN nxt >= fr + 4 THEN nxt END AS x, CASE WHEN least(fr + 172, last) >= fr + 4 THEN least(fr + 172, last) END AS r FROM _a),
    _c AS (SELECT *, least(e, p, x, r) AS best FROM _b),
    result AS (SELECT track_id, onset_id, CASE WHEN peak < 0.01e0 OR best IS NULL THEN fr + 4 ELSE best END AS offset_frame,
               CASE WHEN peak < 0.01e0 THEN 'silence' WHEN best IS NULL THEN 'min_duration' WHEN best = e THEN 'energy_decay' WHEN best = p THEN 'pitch_change' WHEN best = x THEN 'next_onset' ELSE 'max_ring' END AS method,
               CASE WHEN peak < 0.01e0 THEN 0.7 WHEN best IS NULL THEN 0.5 WHEN best = e THEN 0.8 WHEN best = p THEN 0.7 WHEN best = x THEN 0.6 ELSE 0.4 END AS confidence FROM _c)""",
)
