"""Grouping and segmentation queries over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from notelake.operators import segment as seg
from notelake.operators import timeline as tl
from notelake.plans.registry import anchored_sql, register
from notelake.sources import adapters as src

# The adapters press a month of events into 0.6 s or 6 s per track, so slices are short to keep their row count usual.
CAND_SLICE = 100_000
NOTE_SLICE = 1_000_000
FRAME_SLICE = 64


def _anchored(strict):
    def plan(spark, sf):
        rows = tl.group_anchored(src.candidates(spark, sf), 30_000, width=CAND_SLICE, strict=strict)
        return rows.groupBy("track_id", "anchor_t").agg(F.count("*").alias("n"), F.min("cand_id").alias("first_id"))
    return plan


for _name, _strict in (("group_anchored", False), ("group_anchored_strict", True)):
    register(
        _name, _anchored(_strict), "track_id anchor_t n first_id", "candidates",
        anchored_sql("candidates", 30_000, strict=_strict) + """,
        result AS (SELECT track_id, anchor_t, count(*) AS n, min(cand_id) AS first_id FROM grouped GROUP BY ALL)""",
        recursive=True,
    )

register(
    "group_gap",
    lambda spark, sf: tl.group_gap(src.candidates(spark, sf), 30_000, width=CAND_SLICE)
    .groupBy("track_id", "grp_t", "grp_id").agg(F.count("*").alias("n"), F.max("t_us").alias("last_t")),
    "track_id grp_t grp_id n last_t", "candidates",
    """_f AS (SELECT *, coalesce(t_us - lag(t_us) OVER w > 30000, true) AS s FROM candidates
              WINDOW w AS (PARTITION BY track_id ORDER BY t_us, cand_id)),
       _n AS (SELECT *, sum(CAST(s AS INT)) OVER (PARTITION BY track_id ORDER BY t_us, cand_id) AS g FROM _f),
       result AS (SELECT track_id, min(t_us) AS grp_t, arg_min(cand_id, (t_us, cand_id)) AS grp_id, count(*) AS n,
                         max(t_us) AS last_t FROM _n GROUP BY track_id, g)""",
)

register(
    "phrases",
    lambda spark, sf: seg.phrases(src.notes(spark, sf), 100_000, 3, NOTE_SLICE),
    "track_id first_id n start_us end_us", "notes",
    """_f AS (SELECT *, start_us + dur_us AS end_us,
                     coalesce(start_us - lag(start_us + dur_us) OVER w > 100000, true) AS s FROM notes
              WINDOW w AS (PARTITION BY track_id ORDER BY start_us, note_id)),
       _n AS (SELECT *, sum(CAST(s AS INT)) OVER (PARTITION BY track_id ORDER BY start_us, note_id) AS g FROM _f),
       result AS (SELECT track_id, arg_min(note_id, (start_us, note_id)) AS first_id, count(*) AS n,
                  min(start_us) AS start_us, max(end_us) AS end_us FROM _n GROUP BY track_id, g HAVING count(*) >= 3)""",
)

_RUNS = """_f AS (SELECT *, coalesce(frame - lag(frame) OVER w = 1 AND midi = lag(midi) OVER w, false) AS go
              FROM frames WHERE is_voiced AND midi > 0 WINDOW w AS (PARTITION BY track_id ORDER BY frame)),
       _n AS (SELECT *, sum(CASE WHEN go THEN 0 ELSE 1 END) OVER (PARTITION BY track_id ORDER BY frame) AS g FROM _f)"""
for _name, _next in (("frames_to_notes_exact", True), ("frames_to_notes_exact_last_frame", False)):
    register(
        _name,
        lambda spark, sf, nxt=_next: seg.frames_to_notes_exact(src.frames(spark, sf), 3, nxt, width=FRAME_SLICE),
        "track_id run_frame midi start_us dur_us n_frames confidence~", "frames",
        _RUNS + f""",
       result AS (SELECT track_id, min(frame) AS run_frame, min(midi) AS midi, min(t_us) AS start_us,
                  max(t_us) - min(t_us) + {23220 if _next else 0} AS dur_us, count(*) AS n_frames,
                  avg(confidence) AS confidence FROM _n GROUP BY track_id, g HAVING count(*) >= 3)""",
    )

register(
    "frames_to_notes_drift",
    lambda spark, sf: seg.frames_to_notes_drift(src.frames(spark, sf), 1, 40_000, FRAME_SLICE),
    "track_id run_frame midi start_us dur_us n_frames confidence~", "frames",
    """_o AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY frame) AS rn FROM frames
              WHERE is_voiced AND midi > 0),
       _g AS (SELECT track_id, rn, frame, midi AS a, frame AS r FROM _o WHERE rn = 1
              UNION ALL
              SELECT o.track_id, o.rn, o.frame,
                     CASE WHEN o.frame - g.frame > 1 OR abs(o.midi - g.a) > 1 THEN o.midi ELSE g.a END,
                     CASE WHEN o.frame - g.frame > 1 OR abs(o.midi - g.a) > 1 THEN o.frame ELSE g.r END
              FROM _g g JOIN _o o ON o.track_id = g.track_id AND o.rn = g.rn + 1),
       result AS (SELECT o.track_id, g.r AS run_frame, min(g.a) AS midi, min(o.t_us) AS start_us,
                  max(o.t_us) - min(o.t_us) AS dur_us, count(*) AS n_frames, avg(o.confidence) AS confidence
                  FROM _o o JOIN _g g ON o.track_id = g.track_id AND o.rn = g.rn
                  GROUP BY o.track_id, g.r HAVING max(o.t_us) - min(o.t_us) >= 40000)""",
    recursive=True,
)

register(
    "voiced_regions",
    lambda spark, sf: seg.voiced_regions(src.frames(spark, sf), width=FRAME_SLICE),
    "track_id run_frame pitch~ start_us dur_us n_frames confidence~", "frames",
    """_f AS (SELECT *, coalesce(frame - lag(frame) OVER w = 1, false) AS go
              FROM frames WHERE is_voiced AND midi > 0 AND confidence > 0.3 WINDOW w AS (PARTITION BY track_id ORDER BY frame)),
       _n AS (SELECT *, sum(CASE WHEN go THEN 0 ELSE 1 END) OVER (PARTITION BY track_id ORDER BY frame) AS g FROM _f),
       result AS (SELECT track_id, min(frame) AS run_frame, median(midi) AS pitch, min(t_us) AS start_us,
                  max(t_us) - min(t_us) AS dur_us, count(*) AS n_frames, avg(confidence) AS confidence
                  FROM _n GROUP BY track_id, g HAVING count(*) >= 2)""",
)

register(
    "merge_same_pitch",
    lambda spark, sf: seg.merge_same_pitch(src.notes(spark, sf), 30_000, NOTE_SLICE),
    "track_id midi start_us note_id end_us confidence~ n", "notes",
    """_f AS (SELECT *, start_us + dur_us AS end_us, max(start_us + dur_us) OVER (PARTITION BY track_id, midi
                     ORDER BY start_us, note_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM notes),
       _n AS (SELECT *, sum(CASE WHEN start_us <= e + 30000 THEN 0 ELSE 1 END)
                     OVER (PARTITION BY track_id, midi ORDER BY start_us, note_id) AS g FROM _f),
       result AS (SELECT track_id, midi, min(start_us) AS start_us, arg_min(note_id, (start_us, note_id)) AS note_id,
                  max(end_us) AS end_us, max(confidence) AS confidence, count(*) AS n FROM _n GROUP BY track_id, midi, g)""",
)

register(
    "merge_adjacent_same_pitch",
    lambda spark, sf: seg.merge_adjacent_same_pitch(src.notes(spark, sf).withColumn("midi", F.expr("midi % 3 + 60")), 30_000, NOTE_SLICE),
    "track_id midi start_us note_id end_us confidence~ n", "notes",
    """_p AS (SELECT track_id, note_id, start_us, start_us + dur_us AS end_us, midi % 3 + 60 AS midi, confidence FROM notes),
       _o AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY start_us, note_id) AS rn FROM _p),
       _g AS (SELECT track_id, rn, midi, end_us AS e, rn AS g FROM _o WHERE rn = 1
              UNION ALL
              SELECT o.track_id, o.rn, o.midi,
                     CASE WHEN o.midi = g.midi AND o.start_us - g.e < 30000 THEN greatest(g.e, o.end_us) ELSE o.end_us END,
                     CASE WHEN o.midi = g.midi AND o.start_us - g.e < 30000 THEN g.g ELSE o.rn END
              FROM _g g JOIN _o o ON o.track_id = g.track_id AND o.rn = g.rn + 1),
       result AS (SELECT o.track_id, min(o.midi) AS midi, min(o.start_us) AS start_us,
                  arg_min(o.note_id, o.rn) AS note_id, max(o.end_us) AS end_us, max(o.confidence) AS confidence, count(*) AS n
                  FROM _o o JOIN _g g ON o.track_id = g.track_id AND o.rn = g.rn GROUP BY o.track_id, g.g)""",
    recursive=True,
)

register(
    "label_runs",
    lambda spark, sf: seg.label_runs(
        src.notes(spark, sf).groupBy("track_id", F.expr("start_us div 100000 * 100000").alias("t_us"))
        .agg(F.when(F.count("*") >= 4, "solo").otherwise("rhythm").alias("label"), F.avg("confidence").alias("confidence")),
        200_000, 100_000, NOTE_SLICE),
    "track_id start_us end_us label$ confidence~", "notes",
    """_w AS (SELECT track_id, start_us // 100000 * 100000 AS t_us, CASE WHEN count(*) >= 4 THEN 'solo' ELSE 'rhythm' END AS label,
                     avg(confidence) AS confidence FROM notes GROUP BY ALL),
       _f AS (SELECT *, coalesce(label <> lag(label) OVER (PARTITION BY track_id ORDER BY t_us), true) AS s FROM _w),
       _n AS (SELECT *, sum(CAST(s AS INT)) OVER (PARTITION BY track_id ORDER BY t_us) AS g FROM _f),
       _s AS (SELECT track_id, min(t_us) AS start_us, max(t_us) AS last_us, min(label) AS label, avg(confidence) AS confidence
              FROM _n GROUP BY track_id, g),
       _e AS (SELECT *, coalesce(lead(start_us) OVER (PARTITION BY track_id ORDER BY start_us), last_us + 100000) AS end_us FROM _s),
       result AS (SELECT * FROM _e WHERE end_us - start_us >= 200000)""",
)

register(
    "merge_overlapping",
    lambda spark, sf: seg.merge_overlapping(
        src.notes(spark, sf).selectExpr("track_id", "note_id as id", "start_us", "start_us + dur_us as end_us",
                                                          "confidence as score", "method as reason"), NOTE_SLICE),
    "track_id start_us end_us score~ n reason$", "notes",
    """_i AS (SELECT track_id, note_id, start_us, start_us + dur_us AS end_us, confidence, method FROM notes),
       _f AS (SELECT *, max(end_us) OVER (PARTITION BY track_id ORDER BY start_us, note_id
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM _i),
       _n AS (SELECT *, sum(CASE WHEN start_us < e THEN 0 ELSE 1 END) OVER (PARTITION BY track_id ORDER BY start_us, note_id) AS g FROM _f),
       result AS (SELECT track_id, min(start_us) AS start_us, max(end_us) AS end_us, max(confidence) AS score, count(*) AS n,
                  string_agg(DISTINCT method, '; ' ORDER BY method) AS reason FROM _n GROUP BY track_id, g)""",
)

_LEGATO = """_f AS (SELECT *, start_us + dur_us AS end_us, midi - lag(midi) OVER w AS d,
                     start_us - lag(start_us + dur_us) OVER w AS gap FROM notes
              WINDOW w AS (PARTITION BY track_id ORDER BY start_us, note_id)),
       _c AS (SELECT *, coalesce(gap < 100000 AND abs(d) BETWEEN 1 AND 7, false) AS go FROM _f),
       _n AS (SELECT *, sum(CASE WHEN go THEN 0 ELSE 1 END) OVER (PARTITION BY track_id ORDER BY start_us, note_id) AS g FROM _c)"""
register(
    "legato_runs",
    lambda spark, sf: seg.legato_runs(src.notes(spark, sf).withColumn("midi", F.expr("40 + midi % 12")), 100_000, 4, NOTE_SLICE),
    "track_id first_id n start_us direction$ confidence~ notes_per_second~", "notes",
    _LEGATO.replace("FROM notes", "FROM (SELECT * REPLACE (40 + midi % 12 AS midi) FROM notes)") + """,
       _r AS (SELECT track_id, arg_min(note_id, (start_us, note_id)) AS first_id, count(*) AS n, min(start_us) AS start_us,
                     count(*) FILTER (go AND d > 0) AS up, count(*) FILTER (go AND d < 0) AS down, avg(confidence) AS confidence,
                     (arg_max(end_us, (start_us, note_id)) - min(start_us)) / 1e6 AS dur
              FROM _n GROUP BY track_id, g HAVING count(*) >= 4),
       result AS (SELECT *, CASE WHEN up > down * 2 THEN 'ascending' WHEN down > up * 2 THEN 'descending' ELSE 'mixed' END AS direction,
                  CASE WHEN dur > 0 THEN n / dur ELSE 0 END AS notes_per_second FROM _r)""",
)

register(
    "three_per_string",
    lambda spark, sf: seg.three_per_string(src.notes(spark, sf).withColumn("midi", F.expr("40 + midi % 12")), 100_000, 4, NOTE_SLICE),
    "track_id first_id n threes groups is_3nps!", "notes",
    _LEGATO.replace("FROM notes", "FROM (SELECT * REPLACE (40 + midi % 12 AS midi) FROM notes)") + """,
       _m AS (SELECT *, sum(CASE WHEN go AND abs(d) <= 3 THEN 0 ELSE 1 END) OVER (PARTITION BY track_id ORDER BY start_us, note_id) AS p FROM _n),
       _p AS (SELECT track_id, g, p, count(*) AS size, min((start_us, note_id)) AS f FROM _m GROUP BY ALL),
       _r AS (SELECT track_id, min(f)[2] AS first_id, sum(size) AS n, count(*) FILTER (size = 3) AS threes, count(*) AS groups
              FROM _p GROUP BY track_id, g HAVING sum(size) >= 4),
       result AS (SELECT *, n >= 6 AND threes >= groups // 2 AS is_3nps FROM _r)""",
)

register(
    "tremolo_sections",
    lambda spark, sf: seg.tremolo_sections(src.notes(spark, sf).withColumn("midi", F.expr("60 + midi % 4")), width=NOTE_SLICE),
    "track_id first_id n base_midi start_us end_us rate~ confidence~", "notes",
    """_p AS (SELECT track_id, note_id, start_us, dur_us, start_us + dur_us AS end_us, 60 + midi % 4 AS midi FROM notes),
       _o AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY start_us, note_id) AS rn FROM _p),
       _g AS (SELECT track_id, rn, midi AS a, rn AS g, end_us, dur_us FROM _o WHERE rn = 1
              UNION ALL
              SELECT o.track_id, o.rn, CASE WHEN b THEN o.midi ELSE x.a END, CASE WHEN b THEN o.rn ELSE x.g END, o.end_us, o.dur_us
              FROM _g x JOIN _o o ON o.track_id = x.track_id AND o.rn = x.rn + 1,
                   LATERAL (SELECT abs(o.midi - x.a) > 1 OR o.start_us - x.end_us > 80000 OR x.dur_us > 150000 AS b)),
       _r AS (SELECT o.track_id, arg_min(o.note_id, o.rn) AS first_id, count(*) AS n, min(x.a) AS base_midi, min(o.start_us) AS start_us,
                     arg_max(o.end_us, o.rn) AS end_us FROM _o o JOIN _g x ON o.track_id = x.track_id AND o.rn = x.rn
              GROUP BY o.track_id, x.g HAVING count(*) >= 3),
       _q AS (SELECT *, n / ((end_us - start_us) / 1e6) AS rate FROM _r WHERE end_us > start_us),
       result AS (SELECT *, least(1.0, rate / 15) AS confidence FROM _q WHERE rate >= 8)""",
    recursive=True,
)


def _presence(spark, sf):
    frames = src.frames(spark, sf).filter("is_voiced")
    # two pitches per frame: the tracked one, and a drone on every frame that is not a multiple of five
    both = frames.select("track_id", "frame", "midi", "confidence").unionByName(
        frames.filter("frame % 5 <> 0 and midi <> 50").select("track_id", "frame", F.lit(50).alias("midi"), F.lit(0.5).alias("confidence")))
    return both, src.frames(spark, sf).groupBy("track_id").agg((F.max("frame") + 1).alias("n_frames"))


register(
    "poly_frames_to_notes",
    lambda spark, sf: seg.poly_frames_to_notes(*_presence(spark, sf), min_frames=2, width=FRAME_SLICE),
    "track_id midi start_us dur_us confidence~", "frames",
    """_p AS (SELECT track_id, frame, midi, confidence FROM frames WHERE is_voiced
              UNION ALL SELECT track_id, frame, 50, 0.5 FROM frames WHERE is_voiced AND frame % 5 <> 0),
       _f AS (SELECT *, frame - row_number() OVER (PARTITION BY track_id, midi ORDER BY frame) AS g FROM _p),
       result AS (SELECT track_id, midi, min(frame) * 23220 AS start_us, count(*) * 23220 AS dur_us, arg_min(confidence, frame) AS confidence
                  FROM _f GROUP BY track_id, midi, g HAVING count(*) >= 2)""",
)


def _primary(spark, sf):
    f = src.frames(spark, sf).withColumn("frequency", F.expr("if(is_voiced, 440D * pow(2D, (midi - 69) / 12D), 0D)"))
    return f, f.filter("event_id % 3 <> 0").withColumn("frequency", F.expr("frequency * 2.5D"))


register(
    "coalesce_detectors",
    lambda spark, sf: seg.coalesce_detectors(*_primary(spark, sf)),
    "track_id frame frequency~ confidence~", "frames",
    """_p AS (SELECT *, CASE WHEN is_voiced THEN 440.0 * pow(2.0, (midi - 69) / 12.0) ELSE 0 END AS f1 FROM frames),
       _l AS (SELECT track_id, max(frame) AS last FROM _p WHERE event_id % 3 <> 0 GROUP BY track_id),
       _j AS (SELECT *, CASE WHEN f1 > 0 AND confidence > 0.5 THEN 1
                     WHEN event_id % 3 <> 0 AND f1 * 2.5 > 0 AND f1 * 2.5 BETWEEN 75 AND 1400 THEN 2
                     WHEN f1 > 0 THEN 3 ELSE 4 END AS c FROM _p JOIN _l USING (track_id) WHERE frame <= last),
       result AS (SELECT track_id, frame, CASE c WHEN 1 THEN f1 WHEN 2 THEN f1 * 2.5 WHEN 3 THEN f1 ELSE 0 END AS frequency,
                  CASE c WHEN 1 THEN confidence WHEN 2 THEN 0.5 WHEN 3 THEN greatest(0.3, confidence) ELSE 0 END AS confidence FROM _j)""",
)

register(
    "activations_to_notes",
    lambda spark, sf: seg.activations_to_notes(
        src.bins(spark, sf).selectExpr("track_id", "frame", "21 + bin as midi", "least(1D, mag * 4) as p"), 0.5, width=FRAME_SLICE),
    "track_id midi start_us dur_us confidence~", "bins",
    """_f AS (SELECT track_id, 21 + bin AS midi, frame, least(1.0, mag * 4) AS p FROM bins),
       _a AS (SELECT *, frame - row_number() OVER (PARTITION BY track_id, midi ORDER BY frame) AS g FROM _f WHERE p > 0.5 AND midi BETWEEN 40 AND 88),
       result AS (SELECT track_id, midi, min(frame) * 23220 AS start_us, count(*) * 23220 AS dur_us, max(p) AS confidence
                  FROM _a GROUP BY track_id, midi, g)""",
)


def _heads(spark, sf):
    b = src.bins(spark, sf).withColumn("string", F.expr("least(bin div 10, 5)"))
    n = b.groupBy("track_id").agg((F.max("frame") + 1).alias("n_frames"))
    heads = b.groupBy("track_id", "frame", "string").agg(
        F.max(F.col("mag") * 2).alias("onset"), F.max_by(F.expr("bin - 10 * string"), F.expr("struct(mag, -bin)")).alias("fret_class"))
    return heads.join(n, "track_id").withColumn("open_midi", F.expr("element_at(array(40, 45, 50, 55, 59, 64), cast(string as int) + 1)"))


register(
    "string_head_to_notes",
    lambda spark, sf: seg.string_head_to_notes(_heads(spark, sf), width=FRAME_SLICE),
    "track_id string midi start_us dur_us confidence~", "bins",
    """_h AS (SELECT track_id, frame, least(bin // 10, 5) AS string, max(mag * 2) AS onset, arg_max(bin - 10 * least(bin // 10, 5), (mag, -bin)) AS c FROM bins
              GROUP BY ALL),
       _n AS (SELECT track_id, max(frame) + 1 AS nf FROM bins GROUP BY ALL),
       _l AS (SELECT _h.*, nf, lead(frame) OVER (PARTITION BY track_id, string ORDER BY frame) AS nx FROM _h JOIN _n USING (track_id) WHERE onset > 0.5),
       result AS (SELECT track_id, string, [40, 45, 50, 55, 59, 64][string + 1] + c - 1 AS midi, frame * 23220 AS start_us,
                  (least(coalesce(nx, nf), frame + 50, nf) - frame) * 23220 AS dur_us, onset AS confidence FROM _l WHERE c > 0)""",
)

register(
    "merge_consecutive", lambda spark, sf: seg.merge_consecutive(src.notes_dense(spark, sf), 20_000, 1, NOTE_SLICE), "track_id note_id midi start_us end_us confidence~ n", "notes_dense",
    """_o AS (SELECT *, start_us + dur_us AS end_us, row_number() OVER (PARTITION BY track_id ORDER BY start_us, midi, note_id) AS rn FROM notes_dense),
    _g AS (SELECT track_id, rn, midi AS a, rn AS g, end_us FROM _o WHERE rn = 1
           UNION ALL SELECT o.track_id, o.rn, CASE WHEN b THEN o.midi ELSE x.a END, CASE WHEN b THEN o.rn ELSE x.g END, o.end_us
           FROM _g x JOIN _o o ON o.track_id = x.track_id AND o.rn = x.rn + 1, LATERAL (SELECT abs(o.midi - x.a) > 1 OR o.start_us - x.end_us > 20000 AS b)),
    result AS (SELECT o.track_id, arg_min(note_id, o.rn) AS note_id, arg_min(midi, o.rn) AS midi, min(start_us) AS start_us, arg_max(o.end_us, o.rn) AS end_us, max(confidence) AS confidence, count(*) AS n
               FROM _o o JOIN _g x USING (track_id, rn) GROUP BY o.track_id, x.g)""", recursive=True,
)
