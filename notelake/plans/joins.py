"""Range, interval and frame join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from notelake.operators import joins as jn
from notelake.operators import segment as seg
from notelake.plans.registry import anchored_sql, register
from notelake.plans.segment import CAND_SLICE, FRAME_SLICE, NOTE_SLICE
from notelake.plans.theory import CHORDS_SQL, _chords
from notelake.sources import adapters as src

_DET = [("pyin", "true", "0"), ("yin", "frame < 60", "12"), ("cqt", "event_id % 3 <> 0", "24")]


def _contours(spark, sf):
    f = src.frames(spark, sf)
    table = F.array(*[F.struct(F.lit(m).alias("method"), F.expr(k).alias("keep"), F.expr(f"if(is_voiced, 440D * pow(2D, (midi + {up} - 69) / 12D), 0D)").alias("frequency")) for m, k, up in _DET])
    return f.select("track_id", "frame", "confidence", F.inline(table)).filter("keep").drop("keep")


register(
    "align_detectors", lambda spark, sf: jn.align_detectors(_contours(spark, sf)), "track_id method$ frame midi confidence~", "frames",
    "_c AS (" + " UNION ALL ".join(f"SELECT track_id, '{m}' AS method, frame, is_voiced, midi + {up} AS midi, confidence FROM frames WHERE {k}" for m, k, up in _DET) + """),
    _l AS (SELECT track_id, min(m) AS last FROM (SELECT track_id, method, max(frame) AS m FROM _c GROUP BY ALL) GROUP BY ALL),
    result AS (SELECT * FROM _c JOIN _l USING (track_id) WHERE is_voiced AND midi BETWEEN 40 AND 88 AND frame <= last)""",
)


def _sections(spark, sf):
    w = src.notes(spark, sf).groupBy("track_id", F.expr("start_us div 100000 * 100000").alias("t_us")).agg(
        F.when(F.count("*") >= 4, "solo").otherwise("rhythm").alias("label"), F.avg("confidence").alias("confidence"))
    return seg.label_runs(w, 200_000, 100_000, NOTE_SLICE)


_SECT = """_w AS (SELECT track_id, start_us // 100000 * 100000 AS t_us, CASE WHEN count(*) >= 4 THEN 'solo' ELSE 'rhythm' END AS label FROM notes GROUP BY ALL),
       _f AS (SELECT *, coalesce(label <> lag(label) OVER (PARTITION BY track_id ORDER BY t_us), true) AS s FROM _w),
       _n AS (SELECT *, sum(CAST(s AS INT)) OVER (PARTITION BY track_id ORDER BY t_us) AS g FROM _f),
       _s AS (SELECT track_id, min(t_us) AS s_us, max(t_us) AS l_us, min(label) AS label FROM _n GROUP BY track_id, g),
       sect AS (SELECT * FROM (SELECT *, coalesce(lead(s_us) OVER (PARTITION BY track_id ORDER BY s_us), l_us + 100000) AS e_us FROM _s) WHERE e_us - s_us >= 200000)"""
register(
    "notes_in_sections", lambda spark, sf: jn.notes_in_sections(src.notes(spark, sf), _sections(spark, sf), NOTE_SLICE).withColumn("label", F.coalesce("label", F.lit("-"))),
    "note_id label$ new_midi", "notes",
    _SECT + """, _j AS (SELECT n.note_id, midi, label FROM notes n LEFT JOIN sect s ON s.track_id = n.track_id AND start_us >= s_us AND start_us < e_us),
    result AS (SELECT note_id, coalesce(label, '-') AS label, CASE WHEN label = 'solo' AND midi < 55 THEN midi + 12 * CAST(ceil((55 - midi) / 12) AS INT)
               WHEN label = 'rhythm' AND midi > 76 THEN midi - 12 * CAST(ceil((midi - 76) / 12) AS INT) ELSE midi END AS new_midi FROM _j)""",
)


def _onsets(spark, sf):
    n = src.notes(spark, sf)
    return n.select("track_id", F.col("note_id").alias("onset_id"), F.col("start_us").alias("t_us"), "midi", "confidence", "dur_us", F.expr("note_id % 6 = 0").alias("is_legato"))


def _details(spark, sf):
    n = src.notes(spark, sf).filter("note_id % 2 = 1")
    return n.select("track_id", F.col("note_id").alias("detail_id"), F.col("start_us").alias("t_us"), F.expr("note_id % 3 = 0").alias("is_legato"), F.col("confidence").alias("strength"))


register(
    "onset_detail_near", lambda spark, sf: jn.onset_detail_near(_onsets(spark, sf).filter("onset_id % 2 = 0"), _details(spark, sf)), "onset_id detail_id strength~ near_legato!", "notes",
    """result AS (SELECT o.note_id AS onset_id, arg_min(d.note_id, (d.start_us, d.note_id)) AS detail_id, arg_min(d.confidence, (d.start_us, d.note_id)) AS strength,
       bool_or(d.note_id % 3 = 0) AS near_legato FROM notes o JOIN notes d ON o.track_id = d.track_id AND abs(d.start_us - o.start_us) <= 50000
       WHERE o.note_id % 2 = 0 AND d.note_id % 2 = 1 GROUP BY ALL)""",
)


def _framed(spark, sf):
    # frames span less time than notes, so onsets are brought to their time scale
    return jn.with_frame(_onsets(spark, sf).withColumn("t_us", F.expr("t_us div 4")))


_ON = "_on AS (SELECT track_id, note_id AS onset_id, start_us // 4 AS t_us, start_us // 4 // 23220 AS fr, midi, confidence, dur_us, note_id % 6 = 0 AS leg FROM notes)"
_CUT = "c >= CASE WHEN leg THEN 0.3e0 * 0.6e0 ELSE 0.3e0 END AND dur_us >= CASE WHEN leg THEN 50000 * 0.7 ELSE 50000 END AND midi BETWEEN 36 AND 90"
register(
    "pitch_at_onset", lambda spark, sf: jn.pitch_at_onset(_framed(spark, sf), src.frames(spark, sf)), "onset_id midi confidence~", "notes frames",
    _ON + f""", _b AS (SELECT o.onset_id, dur_us, leg, f.midi, f.confidence AS c FROM _on o JOIN frames f ON f.track_id = o.track_id AND f.frame BETWEEN fr AND fr + 4 AND f.midi > 0
               QUALIFY row_number() OVER (PARTITION BY onset_id ORDER BY f.confidence DESC, frame) = 1),
    result AS (SELECT onset_id, midi, c AS confidence FROM _b WHERE {_CUT})""",
)
register(
    "pitch_at_onset_vote", lambda spark, sf: jn.pitch_at_onset(_framed(spark, sf), src.frames(spark, sf), True), "onset_id midi confidence~", "notes frames",
    _ON + f""", _b AS (SELECT o.onset_id, dur_us, leg, f.midi, avg(f.confidence) AS c, count(*) AS n, min(frame) AS seen FROM _on o
               JOIN frames f ON f.track_id = o.track_id AND f.frame BETWEEN fr AND fr + 4 AND f.midi > 0 GROUP BY o.onset_id, dur_us, leg, f.midi QUALIFY row_number() OVER (PARTITION BY o.onset_id ORDER BY count(*) DESC, min(frame)) = 1),
    result AS (SELECT onset_id, midi, c AS confidence FROM _b WHERE {_CUT})""",
)
register(
    "attack_vs_sustain",
    lambda spark, sf: jn.attack_vs_sustain(_framed(spark, sf).withColumn("midi", F.expr("55 + midi % 24")), src.frames(spark, sf)).withColumn("sustain_midi", F.coalesce("sustain_midi", F.lit(0))),
    "onset_id sustain_midi label$ confidence~", "notes frames",
    _ON + """, _m AS (SELECT onset_id, round_even(median(f.midi), 0) AS s FROM _on o JOIN frames f ON f.track_id = o.track_id AND is_voiced AND f.t_us BETWEEN o.t_us + 50000 AND o.t_us + 250000 GROUP BY ALL),
    _d AS (SELECT onset_id, s, confidence AS c, abs(55 + midi % 24 - s) AS d FROM _on LEFT JOIN _m USING (onset_id)),
    result AS (SELECT onset_id, coalesce(s, 0) AS sustain_midi, CASE WHEN d IS NULL THEN 'none' WHEN d = 0 THEN 'same' WHEN d = 12 THEN 'octave' WHEN d <= 2 THEN 'close' ELSE 'diff' END AS label,
               CASE WHEN d = 0 THEN least(1.0, c + 0.3) ELSE c END AS confidence FROM _d)""",
)
register(
    "chord_members", lambda spark, sf: jn.chord_members(_chords(spark, sf), src.notes_dense(spark, sf)).withColumn("note_ids", F.array_join(F.col("note_ids").cast("array<string>"), ",")),
    "track_id chord_us name$ note_ids$", "notes_dense",
    CHORDS_SQL + """, result AS (SELECT c.track_id, c.start_us AS chord_us, name, string_agg(note_id, ',' ORDER BY note_id) AS note_ids FROM chords c JOIN notes_dense n
        ON n.track_id = c.track_id AND abs(n.start_us - c.start_us) < 50000 AND n.start_us < c.start_us + c.dur_us GROUP BY ALL)""", recursive=True,
)
register(
    "overlapping_notes", lambda spark, sf: jn.overlapping_notes(src.notes(spark, sf)), "track_id note_id other_id", "notes",
    """_p AS (SELECT a.track_id, a.note_id AS x, b.note_id AS y FROM notes a JOIN notes b ON a.track_id = b.track_id AND b.start_us < a.start_us + a.dur_us
              AND (b.start_us, b.note_id) > (a.start_us, a.note_id) AND abs(a.midi - b.midi) > 2),
       result AS (SELECT track_id, x AS note_id, y AS other_id FROM _p UNION ALL SELECT track_id, y, x FROM _p)""",
)
register(
    "drop_harmonics", lambda spark, sf: jn.drop_harmonics(src.notes_dense(spark, sf), width=CAND_SLICE), "track_id note_id", "notes_dense",
    anchored_sql("notes_dense", 50_000, "start_us", "note_id", strict=True) + """,
    result AS (SELECT track_id, note_id FROM grouped g WHERE NOT EXISTS (SELECT 1 FROM grouped o WHERE o.track_id = g.track_id AND o.anchor_t = g.anchor_t
               AND g.midi - o.midi IN (12, 19, 24, 28, 31)))""", recursive=True,
)
register(
    "dedupe_against", lambda spark, sf: jn.dedupe_against(src.notes(spark, sf).filter("note_id % 3 = 0"), src.notes(spark, sf).filter("note_id % 3 <> 0")),
    "track_id note_id", "notes",
    """result AS (SELECT track_id, note_id FROM notes n WHERE note_id % 3 = 0 AND NOT EXISTS (SELECT 1 FROM notes e WHERE e.note_id % 3 <> 0 AND e.track_id = n.track_id AND e.midi = n.midi
        AND abs(round_even(n.start_us / 1000, 0) - round_even(e.start_us / 1000, 0)) < 50))""",
)
register(
    "sample_attack_pitch", lambda spark, sf: jn.sample_attack_pitch(_framed(spark, sf), src.frames(spark, sf)), "onset_id midi confidence~ sample_frame", "notes frames",
    _ON + """, _c AS (SELECT o.onset_id, f.midi, f.frame, f.confidence AS c FROM _on o JOIN frames f ON f.track_id = o.track_id AND f.frame BETWEEN fr + 2 AND fr + 6 AND f.midi > 0),
    _v AS (SELECT *, max(c) OVER (PARTITION BY onset_id) AS m FROM _c),
    _p AS (SELECT onset_id, midi, sum(c) AS s, max(c) AS c, count(*) AS n, min(frame) AS seen, floor(median(frame)) AS sample_frame FROM _v WHERE (m < 0.3 OR c >= 0.3) AND midi BETWEEN 40 AND 88 GROUP BY ALL),
    result AS (SELECT onset_id, midi, least(1.0, c + least(0.2, n * 0.05)) AS confidence, sample_frame FROM _p QUALIFY row_number() OVER (PARTITION BY onset_id ORDER BY round(s, 9) DESC, seen) = 1)""",
)
register(
    "sustained_uncovered",
    lambda spark, sf: jn.sustained_uncovered(src.notes(spark, sf).withColumn("start_us", F.expr("start_us div 4")).withColumn("dur_us", F.expr("dur_us div 9")), src.frames(spark, sf), 0.1, width=FRAME_SLICE),
    "track_id run_frame midi n_frames confidence~ dur_us", "notes frames",
    """_cv AS (SELECT track_id, start_us // 4 AS a, start_us // 4 + dur_us // 9 AS b FROM notes),
    _fr AS (SELECT * FROM frames f WHERE midi > 0 AND confidence >= 0.1 AND NOT EXISTS (SELECT 1 FROM _cv c WHERE c.track_id = f.track_id AND f.t_us >= a AND f.t_us < b)),
    _o AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY frame) AS rn FROM _fr),
    _g AS (SELECT track_id, rn, frame, midi AS a, frame AS r FROM _o WHERE rn = 1
           UNION ALL SELECT o.track_id, o.rn, o.frame, CASE WHEN o.frame - g.frame > 1 OR abs(o.midi - g.a) > 2 THEN o.midi ELSE g.a END,
                  CASE WHEN o.frame - g.frame > 1 OR abs(o.midi - g.a) > 2 THEN o.frame ELSE g.r END FROM _g g JOIN _o o ON o.track_id = g.track_id AND o.rn = g.rn + 1),
    _r AS (SELECT o.*, g.r FROM _o o JOIN _g g ON g.track_id = o.track_id AND g.rn = o.rn),
    _m AS (SELECT track_id, r, midi, count(*) AS n, min(frame) AS seen FROM _r GROUP BY ALL),
    _t AS (SELECT track_id, r, arg_min(midi, (-n, seen)) AS midi FROM _m GROUP BY ALL),
    _l AS (SELECT track_id, max(frame) AS last FROM frames GROUP BY ALL),
    _a AS (SELECT track_id, r, count(*) AS n_frames, avg(confidence) AS confidence FROM _r GROUP BY ALL HAVING count(*) >= 3),
    result AS (SELECT track_id, r AS run_frame, midi, n_frames, confidence, (least(r + n_frames, last) - r) * 23220 AS dur_us FROM _a JOIN _t USING (track_id, r) JOIN _l USING (track_id)
               WHERE (least(r + n_frames, last) - r) * 23220 >= 50000)""", recursive=True,
)
register(
    "pitch_between_onsets", lambda spark, sf: jn.pitch_between_onsets(src.onset_frames(spark, sf), src.frames(spark, sf), FRAME_SLICE),
    "track_id onset midi confidence~ n_frames", "frames",
    """_s AS (SELECT *, max(CASE WHEN event_id % 6 = 0 THEN frame END) OVER (PARTITION BY track_id ORDER BY frame) AS onset FROM frames),
       result AS (SELECT track_id, onset, floor(median(midi) FILTER (midi > 0)) AS midi, avg(confidence) AS confidence, count(*) AS n_frames FROM _s WHERE onset IS NOT NULL
                  GROUP BY ALL HAVING count(*) FILTER (midi > 0) > 0)""",
)
