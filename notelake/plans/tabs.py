"""Position, playability and difficulty queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from notelake.operators import difficulty as dif
from notelake.operators import positions as pos
from notelake.operators import theory as th
from notelake.plans.registry import register
from notelake.plans.segment import NOTE_SLICE
from notelake.plans.theory import STATIC_SQL, _values, key_sql
from notelake.functions.dims import SCALES, TUNINGS
from notelake.sources import adapters as src

STATIC = STATIC_SQL.format(source="notes")


def _static(spark, sf):
    return pos.static_position(src.notes(spark, sf))


def _basic(spark, sf, policy="basic"):
    return pos.assign_positions(src.notes(spark, sf), policy, width=NOTE_SLICE)


register(
    "fret_options", lambda spark, sf: pos.fret_options(src.notes(spark, sf), "drop_d"), "note_id string fret", "notes",
    f"""_tun AS (SELECT * FROM {_values(list(enumerate(TUNINGS['drop_d'])), 'string, open')}),
        result AS (SELECT note_id, string, midi - open AS fret FROM notes JOIN _tun ON midi - open BETWEEN 0 AND 24)""",
)
register("static_position", _static, "note_id string fret", "notes", STATIC + ", result AS (SELECT * FROM tabs)")
register(
    "hand_position", lambda spark, sf: _static(spark, sf).select("note_id", pos.hand_position(F.col("fret")).alias("place"), pos.fret_base(F.col("fret")).alias("base")),
    "note_id place base", "notes",
    STATIC + """, result AS (SELECT note_id, CASE WHEN fret = 0 THEN 0 WHEN fret <= 4 THEN 1 WHEN fret <= 7 THEN 5 WHEN fret <= 11 THEN 9 ELSE 12 END AS place,
        greatest(1, CAST(floor((fret - 1) / 4) AS INT) * 4 + 1) AS base FROM tabs)""",
)


def assign_sql(source: str, near: str, name: str) -> str:
    """CTE ``{name}``: notes placed one after the other."""
    base = "(CASE WHEN fret <= 5 THEN 3e0 WHEN fret <= 12 THEN 1e0 ELSE 0e0 END) - fret * 2e-1 + [5e-1, 8e-1, 1e0, 1e0, 8e-1, 5e-1][string + 1] * 3"
    return f"""_tn{name} AS (SELECT * FROM {_values(list(enumerate(TUNINGS['standard'])), 'string, open')}),
    _pl{name} AS (SELECT track_id, note_id, start_us, row_number() OVER (PARTITION BY track_id ORDER BY start_us, note_id) AS rn, os FROM (
        SELECT track_id, note_id, any_value(start_us) AS start_us, list(struct_pack(string := string, fret := midi - open)) AS os
        FROM {source} JOIN _tn{name} ON midi - open BETWEEN 0 AND 24 GROUP BY track_id, note_id)),
    _as{name} AS (
        SELECT track_id, rn, note_id, b.string AS string, b.fret AS fret FROM _pl{name} p, LATERAL (SELECT arg_max(struct_pack(string := string, fret := fret), (score, string, fret)) AS b
            FROM (SELECT o.string AS string, o.fret AS fret, {base.replace('fret', 'o.fret').replace('string', 'o.string')} AS score FROM (SELECT unnest(p.os) AS o))) WHERE rn = 1
        UNION ALL
        SELECT p.track_id, p.rn, p.note_id, b.string, b.fret FROM _as{name} a JOIN _pl{name} p ON p.track_id = a.track_id AND p.rn = a.rn + 1,
            LATERAL (SELECT arg_max(struct_pack(string := string, fret := fret), (score, string, fret)) AS b
            FROM (SELECT o.string AS string, o.fret AS fret, {base.replace('fret', 'o.fret').replace('string', 'o.string')} - {near} AS score FROM (SELECT unnest(p.os) AS o)))),
    {name} AS (SELECT n.*, a.string, a.fret FROM _as{name} a JOIN {source} n USING (track_id, note_id))"""


_NEAR_BASIC = "(CASE WHEN abs(o.fret - a.fret) > 4 THEN abs(o.fret - a.fret) * 5e-1 ELSE abs(o.fret - a.fret) * 2e-1 END) - abs(o.string - a.string) * 8e-1"
_NEAR_HEUR = "abs(o.fret - a.fret) * 3e-1 - abs(o.string - a.string) * 5e-1"
BASIC = assign_sql("notes", _NEAR_BASIC, "basic")
register("assign_positions", _basic, "track_id note_id string fret", "notes", BASIC + ", result AS (SELECT * FROM basic)", recursive=True)
register(
    "compare_assignments", lambda spark, sf: pos.compare_assignments(_basic(spark, sf), _basic(spark, sf, "heuristic")),
    "track_id total agree differ one_sided", "notes",
    BASIC + "," + assign_sql("notes", _NEAR_HEUR, "heur") + """, result AS (SELECT a.track_id, count(*) AS total,
        count(*) FILTER (a.string = b.string AND a.fret = b.fret) AS agree, count(*) FILTER (a.string <> b.string OR a.fret <> b.fret) AS differ, 0 AS one_sided
        FROM basic a JOIN heur b USING (track_id, note_id) GROUP BY ALL)""", recursive=True,
)


register(
    "assignment_differences", lambda spark, sf: pos.assignment_differences(_basic(spark, sf), _basic(spark, sf, "heuristic").filter("note_id % 50 <> 0")).fillna({"side": "-", "b_string": -1, "b_fret": -1}),
    "track_id note_id a_string a_fret b_string b_fret side$", "notes",
    BASIC + "," + assign_sql("notes", _NEAR_HEUR, "heur") + """, result AS (SELECT a.track_id, a.note_id, a.string AS a_string, a.fret AS a_fret, coalesce(b.string, -1) AS b_string, coalesce(b.fret, -1) AS b_fret,
        CASE WHEN b.string IS NULL THEN 'a' ELSE '-' END AS side
        FROM basic a LEFT JOIN (SELECT * FROM heur WHERE note_id % 50 <> 0) b USING (track_id, note_id) WHERE a.string IS DISTINCT FROM b.string OR a.fret IS DISTINCT FROM b.fret)""", recursive=True,
)


def _runs(spark, sf):
    notes = src.notes(spark, sf)
    return pos.compare_note_runs(notes, notes.filter("confidence >= 0.5"), th.detect_key(notes))


register(
    "compare_note_runs", _runs, "track_id a_n a_low a_high a_confidence~ a_outside b_n b_low b_high b_confidence~ b_outside", "notes",
    key_sql("notes", "dur_us") + f""",
    _sn AS (SELECT n.*, NOT list_contains(CASE WHEN mode = 'major' THEN {SCALES['major']} ELSE {SCALES['natural_minor']} END, (midi - root + 24) % 12) AS outside FROM notes n JOIN _key USING (track_id)),
    _sa AS (SELECT track_id, count(*) AS a_n, min(midi) AS a_low, max(midi) AS a_high, avg(confidence) AS a_confidence, count(*) FILTER (outside) AS a_outside FROM _sn GROUP BY track_id),
    _sb AS (SELECT track_id, count(*) AS b_n, min(midi) AS b_low, max(midi) AS b_high, avg(confidence) AS b_confidence, count(*) FILTER (outside) AS b_outside FROM _sn WHERE confidence >= 0.5 GROUP BY track_id),
    result AS (SELECT * FROM _sa FULL JOIN _sb USING (track_id))""",
)


def fingering_sql(source: str, prefix: str) -> str:
    return f"""(SELECT track_id, coalesce(avg(fret) FILTER (fret > 0), 0) AS {prefix}_avg_fret, max(fret) AS {prefix}_max_fret,
        count(*) FILTER (fret = 0) AS {prefix}_open_strings, coalesce(avg(abs(fret - pf)) FILTER (fret > 0 AND pf > 0), 0) AS {prefix}_avg_fret_jump,
        coalesce(max(abs(fret - pf)) FILTER (fret > 0 AND pf > 0), 0) AS {prefix}_max_fret_jump, coalesce(avg(abs(string - ps)), 0) AS {prefix}_avg_string_jump
        FROM (SELECT *, lag(fret) OVER w AS pf, lag(string) OVER w AS ps FROM {source} WINDOW w AS (PARTITION BY track_id ORDER BY start_us, note_id)) GROUP BY ALL)"""


_FN = ["avg_fret", "max_fret", "open_strings", "avg_fret_jump", "max_fret_jump", "avg_string_jump"]
register(
    "compare_fingerings", lambda spark, sf: pos.compare_fingerings(_static(spark, sf), _basic(spark, sf), NOTE_SLICE),
    "track_id " + " ".join(f"a_{n}~ b_{n}~ gain_{n}~" for n in _FN), "notes",
    STATIC + "," + BASIC + f""", result AS (SELECT *, {', '.join(f'a_{n} - b_{n} AS gain_{n}' for n in _FN)}
        FROM {fingering_sql('tabs', 'a')} JOIN {fingering_sql('basic', 'b')} USING (track_id))""", recursive=True,
)
register(
    "position_usage", lambda spark, sf: pos.position_usage(_static(spark, sf), NOTE_SLICE),
    "track_id fretted shifts avg_fret~ max_fret min_fret avg_jump~ max_jump main_base n_blocks", "notes",
    STATIC + """, _f AS (SELECT *, greatest(1, CAST(floor((fret - 1) / 4) AS INT) * 4 + 1) AS base FROM tabs WHERE fret > 0),
    _l AS (SELECT *, lag(fret) OVER w AS pf, lag(base) OVER w AS pb FROM _f WINDOW w AS (PARTITION BY track_id ORDER BY start_us, note_id)),
    _s AS (SELECT track_id, count(*) AS fretted, count(*) FILTER (abs(base - pb) >= 4) AS shifts, avg(fret) AS avg_fret, max(fret) AS max_fret, min(fret) AS min_fret,
           coalesce(avg(abs(fret - pf)), 0) AS avg_jump, coalesce(max(abs(fret - pf)), 0) AS max_jump, count(DISTINCT base) AS n_blocks FROM _l GROUP BY ALL),
    _b AS (SELECT track_id, base, count(*) AS n, min((start_us, note_id)) AS seen FROM _f GROUP BY ALL),
    _p AS (SELECT track_id, base AS main_base FROM _b QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY n DESC, seen) = 1),
    result AS (SELECT * FROM _s JOIN _p USING (track_id))""",
)
register(
    "playable_transitions", lambda spark, sf: pos.playable_transitions(_static(spark, sf), width=NOTE_SLICE), "note_id playable!", "notes",
    STATIC + """, _l AS (SELECT *, abs(fret - lag(fret) OVER w) AS j, start_us - lag(start_us) OVER w AS g, lag(fret) OVER w AS pf FROM tabs
        WINDOW w AS (PARTITION BY track_id ORDER BY start_us, note_id)),
    result AS (SELECT note_id, pf IS NULL OR fret = 0 OR pf = 0 OR NOT ((g < 50000 AND j > 5) OR (j > 12 AND g < 100000)) AS playable FROM _l)""",
)
register(
    "infer_hand_position", lambda spark, sf: pos.infer_hand_position(src.notes(spark, sf)), "track_id base root pattern$", "notes",
    f"""_tun AS (SELECT * FROM {_values(list(enumerate(TUNINGS['standard'])), 'string, open')}),
    _h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY start_us, note_id) AS pos FROM notes) WHERE pos <= 8),
    _o AS (SELECT _h.*, string, midi - open AS fret FROM _h JOIN _tun ON midi - open BETWEEN 0 AND 24),
    _b AS (SELECT track_id, greatest(1, fret // 4 * 4) AS base, count(*) AS n, min((pos, string)) AS seen FROM _o WHERE fret > 0 GROUP BY ALL),
    _p AS (SELECT track_id, base FROM _b QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY n DESC, seen) = 1),
    _c AS (SELECT track_id, midi % 12 AS root, count(*) AS n, min(pos) AS seen FROM _h GROUP BY ALL),
    _r AS (SELECT track_id, root FROM _c QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY n DESC, seen) = 1),
    _s AS (SELECT _o.track_id, max(fret) - min(fret) AS span FROM _o JOIN _p USING (track_id) WHERE fret BETWEEN base AND base + 4 GROUP BY ALL),
    result AS (SELECT track_id, coalesce(base, 0) AS base, root, CASE WHEN base IS NULL THEN 'open' WHEN span <= 3 THEN 'pentatonic_box' WHEN span <= 5 THEN 'three_per_string' ELSE 'generic' END AS pattern
               FROM _r LEFT JOIN _p USING (track_id) LEFT JOIN _s USING (track_id))""",
)
register(
    "position_asof",
    lambda spark, sf: pos.position_asof(src.notes(spark, sf), _static(spark, sf).filter("note_id % 10 = 0 and fret > 0").select(
        "track_id", (F.col("start_us") + 1000).alias("t_us"), pos.fret_base(F.col("fret")).alias("base")).groupBy("track_id", "t_us").agg(F.max("base").alias("base")), NOTE_SLICE).withColumn("base", F.coalesce("base", F.lit(-1))),
    "track_id note_id base", "notes",
    STATIC + """, _p AS (SELECT track_id, start_us + 1000 AS t_us, max(greatest(1, CAST(floor((fret - 1) / 4) AS INT) * 4 + 1)) AS base FROM tabs WHERE note_id % 10 = 0 AND fret > 0 GROUP BY ALL),
    result AS (SELECT n.track_id, note_id, coalesce(base, -1) AS base FROM notes n ASOF LEFT JOIN _p p ON n.track_id = p.track_id AND n.start_us >= p.t_us)""",
)

# --- difficulty -------------------------------------------------------------------------------------------------
_TECH = "['hammer_on', 'pull_off', 'bend', 'slide', 'vibrato', 'trill', 'tremolo'][note_id % 7 + 1]"


def _annotated(spark, sf):
    names = F.array(*[F.lit(t) for t in dif.TECHNIQUES])
    return _static(spark, sf).withColumn("technique", F.when(F.expr("note_id % 3 = 0"), F.element_at(names, F.expr("cast(note_id % 7 + 1 as int)"))))


SPAN_SQL = STATIC + """, spans AS (SELECT *, coalesce(max(CASE WHEN fret > 0 THEN fret END) OVER w - min(CASE WHEN fret > 0 THEN fret END) OVER w, 0) AS span,
        CASE WHEN fret = 0 THEN 0 WHEN fret <= 4 THEN 1 WHEN fret <= 7 THEN 5 WHEN fret <= 11 THEN 9 ELSE 12 END AS place FROM tabs
        WINDOW w AS (PARTITION BY track_id ORDER BY start_us RANGE BETWEEN 500000 PRECEDING AND 500000 FOLLOWING)),
    ext AS (SELECT track_id, max(start_us) - min(start_us) AS total_us FROM tabs GROUP BY ALL)"""
SPEED_SQL = """_gap AS (SELECT track_id, start_us - lag(start_us) OVER (PARTITION BY track_id ORDER BY start_us, note_id) AS g FROM tabs),
    _fl AS (SELECT track_id, max(1e6 / g) FILTER (g >= 20000) AS m, avg(1e6 / g) FILTER (g >= 20000) AS a FROM _gap GROUP BY ALL),
    _hop AS (SELECT t.track_id, w.k * 500000 AS win_us, count(*) AS n FROM tabs t JOIN range(0, 100) w(k) ON t.start_us >= w.k * 500000 AND t.start_us < w.k * 500000 + 1000000 GROUP BY ALL),
    _fw AS (SELECT track_id, max(n / ((least(win_us + 1000000, total_us) - win_us) / 1e6)) AS f FROM _hop JOIN ext USING (track_id) WHERE win_us < total_us GROUP BY ALL),
    speed AS (SELECT track_id, coalesce(m, 0) AS max_nps, coalesce(a, 0) AS avg_nps, CASE WHEN m IS NULL THEN 0 ELSE coalesce(f, 0) END AS fastest_nps
              FROM _fl LEFT JOIN _fw USING (track_id))"""
register("fret_span", lambda spark, sf: dif.fret_span(_static(spark, sf), width=NOTE_SLICE), "note_id span", "notes", SPAN_SQL + ", result AS (SELECT * FROM spans)")
register("speed", lambda spark, sf: dif.speed(_static(spark, sf), width=NOTE_SLICE), "track_id max_nps~ avg_nps~ fastest_nps~", "notes",
         SPAN_SQL + "," + SPEED_SQL + ", result AS (SELECT * FROM speed)")
PASSAGE_SQL = SPAN_SQL + """,
    _pl AS (SELECT *, lag(start_us) OVER w AS pu, place <> lag(place) OVER w AS moved FROM spans WINDOW w AS (PARTITION BY track_id ORDER BY start_us, note_id)),
    _pw AS (SELECT t.track_id, w.k * 1000000 AS win_us, count(*) AS n, (max(start_us) - min(start_us)) / 1e6 AS len, max(span) AS ms,
                   count(*) FILTER (pu >= w.k * 1000000 AND moved) AS sh
            FROM _pl t JOIN range(0, 100) w(k) ON t.start_us >= w.k * 1000000 AND t.start_us < w.k * 1000000 + 2000000 GROUP BY ALL HAVING count(*) >= 3),
    _pn AS (SELECT *, CASE WHEN len > 0 THEN n / len END AS nps FROM _pw JOIN ext USING (track_id) WHERE win_us < total_us),
    _ps AS (SELECT *, concat_ws('; ', CASE WHEN nps >= 10 THEN printf('Fast passage (%.1f notes/sec)', nps) WHEN nps >= 6 THEN printf('Moderate speed (%.1f notes/sec)', nps) END,
                 CASE WHEN ms >= 5 THEN printf('Wide stretch (%d frets)', ms) END, CASE WHEN sh >= 3 THEN printf('Multiple position shifts (%d)', sh) END) AS reason,
                 greatest(CASE WHEN nps >= 10 THEN least(1.0, nps / 15) WHEN nps >= 6 THEN nps / 15 END, CASE WHEN ms >= 5 THEN least(1.0, ms / 7) END,
                          CASE WHEN sh >= 3 THEN least(1.0, sh / 5) END) AS score FROM _pn),
    wins AS (SELECT track_id, win_us AS start_us, win_us + 2000000 AS end_us, n, score, reason FROM _ps WHERE score >= 0.4),
    _pe AS (SELECT *, max(end_us) OVER (PARTITION BY track_id ORDER BY start_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM wins),
    _pg AS (SELECT *, sum(CASE WHEN start_us < e THEN 0 ELSE 1 END) OVER (PARTITION BY track_id ORDER BY start_us) AS g FROM _pe),
    _pm AS (SELECT track_id, min(start_us) AS start_us, max(end_us) AS end_us, max(score) AS score, count(*) AS n_windows, string_agg(reason, '; ' ORDER BY start_us) AS reason
            FROM _pg GROUP BY track_id, g),
    passages AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY score DESC, start_us) AS rank FROM _pm) WHERE rank <= 10)"""


def _windows(spark, sf):
    return dif.window_scores(_static(spark, sf), width=NOTE_SLICE)


register("difficult_windows", _windows, "track_id start_us end_us n score~ reason$", "notes", PASSAGE_SQL + ", result AS (SELECT * FROM wins)")
register("difficult_passages", lambda spark, sf: dif.difficult_passages(_windows(spark, sf), width=NOTE_SLICE),
         "track_id rank start_us end_us score~ n_windows reason$", "notes", PASSAGE_SQL + ", result AS (SELECT * FROM passages)")
TECH_SQL = f"""_an AS (SELECT *, CASE WHEN note_id % 3 = 0 THEN {_TECH} END AS technique FROM tabs),
    tech AS (SELECT track_id, count(*) AS n_notes, {', '.join(f"count(*) FILTER (technique = '{t}') AS {t}" for t in dif.TECHNIQUES)},
             count(technique) / count(*) * 100 AS density FROM _an GROUP BY ALL)"""
register("technique_stats", lambda spark, sf: dif.technique_stats(_annotated(spark, sf)), "track_id n_notes " + " ".join(dif.TECHNIQUES) + " density~", "notes",
         STATIC + "," + TECH_SQL + ", result AS (SELECT * FROM tech)")
register(
    "practice_sections",
    lambda spark, sf: dif.practice_sections(dif.difficult_passages(_windows(spark, sf), width=NOTE_SLICE), dif.technique_stats(_annotated(spark, sf))),
    "track_id ord start_us end_us focus$ level$ tips$", "notes",
    PASSAGE_SQL + "," + TECH_SQL + """, result AS (
        SELECT track_id, rank AS ord, start_us, end_us, trim(split_part(reason, ';', 1)) AS focus, CASE WHEN score > 0.7 THEN 'advanced' ELSE 'intermediate' END AS level,
               concat_ws(', ', CASE WHEN contains(reason, 'Fast') THEN 'slow metronome, raise tempo step by step' END,
                         CASE WHEN contains(lower(reason), 'stretch') THEN 'finger stretches, thumb position' END,
                         CASE WHEN contains(lower(reason), 'position') THEN 'isolate the shift, guide fingers' END) AS tips FROM passages WHERE rank <= 5
        UNION ALL SELECT track_id, 101, 0, 0, 'Bend accuracy practice', 'intermediate', 'tuner, whole and half steps, vibrato at the peak' FROM tech WHERE bend > 2
        UNION ALL SELECT track_id, 102, 0, 0, 'Legato technique', 'intermediate', 'hammer strength, quick pull-offs, one string first' FROM tech WHERE hammer_on + pull_off > 3)""",
)


def ladder_sql(x: str, low: float, mid: float, high: float, over: float) -> str:
    return (f"CASE WHEN {x} <= {low} THEN {x} / {low} * 25 WHEN {x} <= {mid} THEN 25 + ({x} - {low}) / ({mid} - {low}) * 25 "
            f"WHEN {x} <= {high} THEN 50 + ({x} - {mid}) / ({high} - {mid}) * 25 ELSE least(100.0, 75 + ({x} - {high}) / {over} * 25) END")


register(
    "difficulty_report", lambda spark, sf: dif.difficulty_report(_static(spark, sf), _annotated(spark, sf), NOTE_SLICE),
    "track_id n max_fret max_span avg_span~ n_positions shifts string_changes max_nps~ speed_rating~ technique_rating~ stretch_rating~ position_rating~ score~ level$", "notes",
    SPAN_SQL + "," + SPEED_SQL + "," + TECH_SQL + f""",
    _pl AS (SELECT *, lag(place) OVER w AS pp, lag(string) OVER w AS ps FROM spans WINDOW w AS (PARTITION BY track_id ORDER BY start_us, note_id)),
    _bs AS (SELECT track_id, count(*) AS n, max(fret) AS max_fret, max(span) AS max_span, avg(span) AS avg_span, count(DISTINCT place) AS n_positions,
                   count(*) FILTER (place <> pp) AS shifts, count(*) FILTER (string <> ps) AS string_changes FROM _pl GROUP BY ALL),
    _rt AS (SELECT *, {ladder_sql('greatest(max_nps, fastest_nps)', 3.0, 6.0, 10.0, 5.0)} AS speed_rating,
              least(100.0, (density * 2 + ({' + '.join(f'{t} * {w}' for t, w in dif.COMPLEXITY.items())}) / n * 100) / 2) AS technique_rating,
              ({ladder_sql('max_span', 3, 4, 5, 3.0)}) * 0.7 + least(100.0, avg_span / 4 * 50) * 0.3 AS stretch_rating,
              least(100.0, shifts / n * 500) * 0.6 + (CASE WHEN n_positions <= 3 THEN n_positions / 3 * 25 WHEN n_positions <= 5 THEN 25 + (n_positions - 3) / 2 * 25
                ELSE least(100.0, 50 + (n_positions - 5) / 5 * 50) END) * 0.4 AS position_rating FROM _bs JOIN speed USING (track_id) JOIN tech USING (track_id)),
    _sc AS (SELECT *, speed_rating * 0.35 + technique_rating * 0.25 + stretch_rating * 0.2 + position_rating * 0.2 AS score FROM _rt),
    result AS (SELECT *, CASE WHEN score < 25 THEN 'beginner' WHEN score < 50 THEN 'intermediate' WHEN score < 75 THEN 'advanced' ELSE 'expert' END AS level FROM _sc)""",
)
