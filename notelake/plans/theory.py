"""Scalar, key, scale, chord, genre and rhythm queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from notelake.functions import scalars as sc
from notelake.functions.dims import CHORDS, MAJOR_PROFILE, MINOR_PROFILE, NOTE_NAMES, OPEN_SHAPES, SCALES, TUNINGS
from notelake.functions.genres import GENRE_SCALES, GENRES, RUN_SCALES
from notelake.operators import positions as pos
from notelake.operators import segment as seg
from notelake.operators import theory as th
from notelake.plans.registry import anchored_sql, register
from notelake.plans.segment import _LEGATO, CAND_SLICE, NOTE_SLICE
from notelake.sources import adapters as src


def _values(rows, names: str) -> str:
    cell = lambda x: f"'{x}'" if isinstance(x, str) else str(x)
    return "(VALUES " + ", ".join("(" + ", ".join(cell(x) for x in r) + ")" for r in rows) + f") AS v({names})"


SCALE_SQL = f"_scale AS (SELECT * FROM {_values([(n, s) for n, steps in SCALES.items() for s in steps], 'scale, step')})"
PROFILE_SQL = "_profile AS (SELECT * FROM " + _values(
    [(r, m, o, (r + i) % 12, p) for r in range(12) for o, (m, prof) in enumerate([("major", MAJOR_PROFILE), ("minor", MINOR_PROFILE)]) for i, p in enumerate(prof)],
    "root, mode, o, pc, p") + ")"


def key_sql(source: str, weight: str, where: str = "true") -> str:
    """CTE ``_key``: best key per track of ``source``."""
    return PROFILE_SQL + f""",
    _hist AS (SELECT track_id, r.pc, coalesce(sum(CASE WHEN s.midi % 12 = r.pc THEN {weight} END), 0) AS h
              FROM (SELECT * FROM {source} WHERE {where}) s, range(12) r(pc) GROUP BY ALL),
    _corr AS (SELECT track_id, root, mode, o, corr(h::DOUBLE, p::DOUBLE) AS c, max(h) - min(h) AS spread FROM _hist JOIN _profile USING (pc) GROUP BY ALL),
    _best AS (SELECT * FROM _corr QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY c DESC, root, o) = 1),
    _key AS (SELECT track_id, CASE WHEN spread > 0 THEN root ELSE 0 END AS root, CASE WHEN spread > 0 THEN mode ELSE 'major' END AS mode,
                    CASE WHEN spread > 0 THEN c ELSE 0 END AS confidence FROM _best)"""


SNAP_SQL = SCALE_SQL + """,
    _snap AS (SELECT scale, root, pc, CASE WHEN min(up) = 0 THEN 0 ELSE arg_min(CASE WHEN up <= 12 - up THEN up ELSE up - 12 END, (least(up, 12 - up), tone)) END AS near,
                     min(up) AS above, -min((12 - up) % 12) AS below
              FROM (SELECT scale, root, pc, (root + step) % 12 AS tone, ((root + step) % 12 - pc + 12) % 12 AS up
                    FROM _scale, range(12) a(root), range(12) b(pc)) GROUP BY ALL)"""

register(
    "pitch_scalars",
    lambda spark, sf: src.candidates(spark, sf).select(
        "cand_id", sc.midi_to_hz("midi").alias("hz"), sc.hz_to_midi("frequency").alias("back"), sc.cents("frequency", sc.midi_to_hz("midi")).alias("cents"),
        sc.db("confidence").alias("db"), sc.db_to_linear(sc.db("confidence")).alias("linear")),
    "cand_id hz~ back cents~ db~ linear~", "candidates",
    """result AS (SELECT cand_id, 440 * pow(2, (midi - 69) / 12.0) AS hz, round_even(69 + 12 * log2(frequency / 440), 0) AS back,
                  1200 * log2(frequency / (440 * pow(2, (midi - 69) / 12.0))) AS cents, 20 * log10(confidence) AS db, confidence AS linear FROM candidates)""",
)
register(
    "note_names",
    lambda spark, sf: src.notes(spark, sf).select("note_id", sc.note_name("midi").alias("name"), sc.pitch_class("midi").alias("pc"), sc.octave("midi").alias("octave")),
    "note_id name$ pc octave", "notes",
    f"result AS (SELECT note_id, {NOTE_NAMES}[midi % 12 + 1] || (midi // 12 - 1) AS name, midi % 12 AS pc, midi // 12 - 1 AS octave FROM notes)",
)
register(
    "parse_note",
    lambda spark, sf: src.notes(spark, sf).select("note_id", sc.parse_note(sc.note_name("midi")).alias("parsed"), sc.parse_note(F.lower(sc.note_name("midi"))).alias("lower")),
    "note_id parsed lower", "notes", "result AS (SELECT note_id, midi AS parsed, midi AS lower FROM notes)",
)
register(
    "parse_key",
    lambda spark, sf: src.notes(spark, sf).withColumn("text", F.concat(
        sc.pc_name(sc.pitch_class("midi")), F.element_at(F.array(*[F.lit(x) for x in ("", "m", " minor", " major")]), F.expr("cast(note_id % 4 + 1 as int)"))))
    .withColumn("k", sc.parse_key("text")).select("note_id", "text", "k.root", "k.mode"),
    "note_id text$ root mode$", "notes",
    f"""result AS (SELECT note_id, {NOTE_NAMES}[midi % 12 + 1] || ['', 'm', ' minor', ' major'][note_id % 4 + 1] AS text, midi % 12 AS root,
                   CASE WHEN note_id % 4 IN (1, 2) THEN 'minor' ELSE 'major' END AS mode FROM notes)""",
)
register(
    "in_range",
    lambda spark, sf: src.notes(spark, sf).select("note_id", *pos.in_range(F.col("midi") - 5, "standard", True, "strict"), *pos.in_range(F.col("midi") - 5, "standard", False, "loose")),
    "note_id strict! strict_reason$ loose! loose_reason$", "notes",
    """result AS (SELECT note_id, midi - 5 >= 40 AS strict, CASE WHEN midi - 5 < 40 THEN 'below lowest string' ELSE 'valid' END AS strict_reason,
                  midi - 5 >= 38 AS loose, CASE WHEN midi - 5 < 38 THEN 'too low' ELSE 'valid' END AS loose_reason FROM notes)""",
)
for _dir, _col in (("nearest", "near"), ("up", "above"), ("down", "below")):
    register(
        f"snap_to_scale_{_dir}",
        lambda spark, sf, d=_dir: src.notes(spark, sf).withColumn("root", F.expr("cast(track_id % 12 as int)")).select(
            "note_id", *[th.snap_to_scale(F.col("midi"), F.col("root"), s, d).alias(s) for s in ("major", "pentatonic_minor", "blues")],
            th.in_scale(F.col("midi"), F.col("root"), "dorian").alias("in_dorian")),
        "note_id major pentatonic_minor blues in_dorian!", "notes",
        SNAP_SQL + f""",
        _j AS (SELECT note_id, scale, midi + {_col} AS m, {_col} AS d FROM notes JOIN _snap ON root = track_id % 12 AND pc = midi % 12
               WHERE scale IN ('major', 'pentatonic_minor', 'blues', 'dorian')),
        result AS (SELECT note_id, max(m) FILTER (scale = 'major') AS major, max(m) FILTER (scale = 'pentatonic_minor') AS pentatonic_minor,
                   max(m) FILTER (scale = 'blues') AS blues, max(d) FILTER (scale = 'dorian') = 0 AS in_dorian FROM _j GROUP BY ALL)""",
    )
register(
    "quantize",
    lambda spark, sf: src.notes(spark, sf).select("note_id", sc.quantize_us("start_us", 120, 16, 0.33).alias("q_start"),
                                                  sc.quantize_us(F.col("start_us") + F.col("dur_us"), 120, 16, 0.33).alias("q_end")).withColumn(
        "q_dur", F.greatest(F.lit(10000.0), F.col("q_end") - F.col("q_start"))),
    "note_id q_start~ q_end~ q_dur~", "notes",
    """_g AS (SELECT note_id, round_even(start_us / 125000.0, 0) AS a, round_even((start_us + dur_us) / 125000.0, 0) AS b FROM notes),
       _q AS (SELECT note_id, a * 125000.0 + CASE WHEN a % 2 = 1 THEN 125000 * 0.33 ELSE 0 END AS q_start,
                     b * 125000.0 + CASE WHEN b % 2 = 1 THEN 125000 * 0.33 ELSE 0 END AS q_end FROM _g),
       result AS (SELECT *, greatest(10000.0, q_end - q_start) AS q_dur FROM _q)""",
)
register(
    "note_values", lambda spark, sf: src.notes(spark, sf).withColumn("beats", F.expr("dur_us / 50000D")).select(
        "note_id", pos.note_value(F.col("beats"))["value"].alias("value"), pos.note_value(F.col("beats"))["error"].alias("error"),
        pos.rest_value(F.col("beats"))["value"].alias("rest"), pos.rest_value(F.col("beats"))["remaining"].alias("remaining")),
    "note_id value$ error~ rest$ remaining~", "notes",
    f"""_v AS (SELECT * FROM {_values([(n, i, b) for i, (n, b) in enumerate(pos.NOTE_VALUES)], 'value, o, b')}),
       _r AS (SELECT * FROM {_values([(n, b) for n, b in pos.REST_VALUES], 'rest, b')}),
       _n AS (SELECT note_id, dur_us / 50000 AS beats FROM notes),
       _a AS (SELECT note_id, beats, value, abs(beats - b::DOUBLE) / b::DOUBLE AS error FROM _n, _v
              QUALIFY row_number() OVER (PARTITION BY note_id ORDER BY abs(beats - b::DOUBLE) / b::DOUBLE, o) = 1),
       _z AS (SELECT note_id, arg_max(rest, b) AS rest, max(b)::DOUBLE AS rb FROM _n, _r WHERE beats >= b::DOUBLE * 0.8 GROUP BY ALL),
       result AS (SELECT _a.note_id, value, error, coalesce(rest, 'sixteenth') AS rest, CASE WHEN rb IS NULL THEN 0 ELSE greatest(0, beats - rb) END AS remaining
                  FROM _a LEFT JOIN _z USING (note_id))""",
)
register(
    "fold_to_range", lambda spark, sf: src.notes(spark, sf).select("note_id", pos.fold_to_range(F.col("midi"), 52, 60).alias("folded"),
                                                                 pos.fold_to_range(F.col("midi"), 55, 79).alias("wide")),
    "note_id folded wide", "notes",
    """_f AS (SELECT note_id, midi, CASE WHEN midi < 52 THEN midi + 12 * CAST(ceil((52 - midi) / 12.0) AS INT) ELSE midi END AS a,
                     CASE WHEN midi < 55 THEN midi + 12 * CAST(ceil((55 - midi) / 12.0) AS INT) ELSE midi END AS b FROM notes),
       result AS (SELECT note_id, greatest(52, CASE WHEN a > 60 THEN a - 12 * CAST(ceil((a - 60) / 12.0) AS INT) ELSE a END) AS folded,
                  greatest(55, CASE WHEN b > 79 THEN b - 12 * CAST(ceil((b - 79) / 12.0) AS INT) ELSE b END) AS wide FROM _f)""",
)

# --- keys -------------------------------------------------------------------------------------------------------
register(
    "detect_key", lambda spark, sf: th.detect_key(src.notes(spark, sf)), "track_id root mode$ confidence~", "notes",
    key_sql("notes", "dur_us") + ", result AS (SELECT * FROM _key)",
)
register(
    "detect_key_short_tracks", lambda spark, sf: th.detect_key(src.notes(spark, sf), min_notes=70), "track_id root mode$ confidence~ n_notes", "notes",
    key_sql("notes", "dur_us") + """,
    _first AS (SELECT track_id, count(*) AS n_notes, arg_min(midi % 12, (start_us, note_id)) AS pc FROM notes GROUP BY ALL),
    result AS (SELECT track_id, n_notes, CASE WHEN n_notes >= 70 THEN root WHEN pc IN (9, 4, 2) THEN pc ELSE 0 END AS root,
        CASE WHEN n_notes >= 70 THEN mode WHEN pc IN (9, 4, 2) THEN 'minor' ELSE 'major' END AS mode,
        CASE WHEN n_notes >= 70 THEN confidence ELSE 0.5 END AS confidence FROM _key JOIN _first USING (track_id))""",
)
register(
    "detect_key_frames", lambda spark, sf: th.detect_key(src.frames(spark, sf).filter("is_voiced and confidence > 0.3"), F.col("confidence")),
    "track_id root mode$ confidence~", "frames",
    key_sql("frames", "confidence", "is_voiced AND confidence > 0.3") + ", result AS (SELECT * FROM _key)",
)
register(
    "detect_key_simple", lambda spark, sf: th.detect_key_simple(src.notes(spark, sf)), "track_id root mode$ confidence~", "notes",
    """_h AS (SELECT track_id, pc, coalesce(sum(dur_us) FILTER (midi % 12 = pc), 0) AS h FROM notes, range(12) r(pc) GROUP BY ALL),
       _r AS (SELECT track_id, arg_max(pc, (h, -pc)) AS root, max(h) AS m, sum(h) AS t FROM _h GROUP BY ALL),
       result AS (SELECT _r.track_id, root, m / t AS confidence, CASE WHEN a.h >= b.h THEN 'major' ELSE 'minor' END AS mode FROM _r
                  JOIN _h a ON a.track_id = _r.track_id AND a.pc = (root + 4) % 12 JOIN _h b ON b.track_id = _r.track_id AND b.pc = (root + 3) % 12)""",
)
_CONSTRAIN_SQL = key_sql("notes", "dur_us") + "," + SNAP_SQL + """,
    _c AS (SELECT n.*, near, CASE WHEN near = 0 THEN 'in_scale' WHEN dur_us <= 60000 THEN 'passing' ELSE 'snapped' END AS fate
           FROM notes n JOIN _key k USING (track_id) JOIN _snap s ON s.root = k.root AND s.pc = midi % 12
                AND s.scale = CASE WHEN mode = 'major' THEN 'major' ELSE 'natural_minor' END)"""


def _constrained(spark, sf):
    return th.constrain_to_key(src.notes(spark, sf), 1, True, 60_000)


register("constrain_to_key", lambda spark, sf: _constrained(spark, sf), "note_id fate$ new_midi", "notes",
         _CONSTRAIN_SQL + ", result AS (SELECT note_id, fate, CASE WHEN fate = 'snapped' THEN midi + near ELSE midi END AS new_midi FROM _c)")
register("constrain_stats", lambda spark, sf: th.constrain_stats(_constrained(spark, sf)), "track_id total in_scale passing snapped mean_snap~", "notes",
         _CONSTRAIN_SQL + """, result AS (SELECT track_id, count(*) AS total, count(*) FILTER (fate = 'in_scale') AS in_scale,
             count(*) FILTER (fate = 'passing') AS passing, count(*) FILTER (fate = 'snapped') AS snapped,
             avg(abs(near)) FILTER (fate = 'snapped') AS mean_snap FROM _c GROUP BY ALL)""")
_BASE = """CASE WHEN d = 0 THEN 0.3 WHEN d <= 2 THEN 0.15 WHEN d <= 4 THEN 0.1 WHEN d <= 7 THEN 0.05 WHEN d = 12 THEN 0.08
           WHEN d <= 12 THEN 0.02 * exp(-0.1 * (d - 7)) ELSE 0.0001 END"""
register(
    "transition_model", lambda spark, sf: th.transition_model(src.notes(spark, sf), width=NOTE_SLICE), "a b n p~", "notes",
    f"""_l AS (SELECT midi AS a, lead(midi) OVER (PARTITION BY track_id ORDER BY start_us, note_id) AS b FROM notes),
       _n AS (SELECT a, b, count(*) AS n FROM _l WHERE b IS NOT NULL GROUP BY ALL),
       _g AS (SELECT a, b, abs(a - b) AS d FROM range(40, 89) x(a), range(40, 89) y(b)),
       _b AS (SELECT a, b, {_BASE} AS base FROM _g),
       _f AS (SELECT a, b, coalesce(n, 0) AS n, base / sum(base) OVER (PARTITION BY a) AS base, sum(coalesce(n, 0)) OVER (PARTITION BY a) AS t FROM _b LEFT JOIN _n USING (a, b)),
       result AS (SELECT a, b, n, CASE WHEN t > 0 THEN 0.5 * (n + 0.01) / (t + 0.49) + 0.5 * base ELSE base END AS p FROM _f)""",
)
register(
    "note_prior", lambda spark, sf: th.note_prior(th.detect_key(src.notes(spark, sf))), "track_id midi p~", "notes",
    key_sql("notes", "dur_us") + "," + SCALE_SQL + """,
    _m AS (SELECT track_id, k.root, k.mode, midi, midi % 12 AS pc FROM _key k, range(40, 89) r(midi)),
    _w AS (SELECT track_id, midi, p * CASE WHEN EXISTS (SELECT 1 FROM _scale s WHERE s.scale = CASE WHEN m.mode = 'major' THEN 'major' ELSE 'natural_minor' END
               AND (m.root + step) % 12 = m.pc) THEN 3 ELSE 1 END * CASE WHEN m.pc = m.root THEN 1.5 ELSE 1 END
               * CASE WHEN m.pc = (m.root + 7) % 12 THEN 1.2 ELSE 1 END AS w
           FROM _m m JOIN _profile f ON f.root = m.root AND f.mode = m.mode AND f.pc = m.pc),
    result AS (SELECT track_id, midi, w::DOUBLE / sum(w::DOUBLE) OVER (PARTITION BY track_id) AS p FROM _w)""",
)
register(
    "interval_stats",
    lambda spark, sf: th.interval_stats(src.notes(spark, sf), NOTE_SLICE).withColumn("histogram", F.array_join(F.col("histogram").cast("array<string>"), ",")),
    "track_id n mean_interval~ std_interval~ max_interval stepwise~ leap~ repeat~ up~ down~ histogram$", "notes",
    """_l AS (SELECT track_id, lead(midi) OVER (PARTITION BY track_id ORDER BY start_us, note_id) - midi AS d FROM notes),
       result AS (SELECT track_id, count(*) AS n, avg(abs(d)) AS mean_interval, stddev_pop(abs(d)) AS std_interval, max(abs(d)) AS max_interval,
         avg((abs(d) <= 2)::INT) AS stepwise, avg((abs(d) > 4)::INT) AS leap, avg((d = 0)::INT) AS repeat, avg((d > 0)::INT) AS up, avg((d < 0)::INT) AS down, """
    + " || ',' || ".join(f"count(*) FILTER (abs(d) = {i})" for i in range(13)) + " AS histogram FROM _l WHERE d IS NOT NULL GROUP BY ALL)",
)

# --- genres -----------------------------------------------------------------------------------------------------
def suggest_sql(genre: str, weight: str) -> str:
    g = GENRES[genre]
    rows = [(name, i * 12 + r, r, s, w * g.roots.get(r, 1.0)) for i, (name, w) in enumerate((n, w) for n, w in g.scales.items() if n in GENRE_SCALES)
            for r in range(12) for s in GENRE_SCALES[name]]
    return f"""_opt AS (SELECT * FROM {_values(rows, 'scale, o, root, step, prior')}),
    _h AS (SELECT track_id, midi % 12 AS pc, sum({weight}) AS w FROM notes GROUP BY ALL), _t AS (SELECT track_id, sum(w) AS t FROM _h GROUP BY ALL),
    _s AS (SELECT track_id, scale, o, any_value(prior)::DOUBLE * sum(w) / any_value(t) AS score FROM _h JOIN _t USING (track_id) JOIN _opt ON (root + step) % 12 = pc GROUP BY ALL),
    _sug AS (SELECT track_id, scale, least(1.0, score / 2) AS confidence FROM _s QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY round(score, 12) DESC, o) = 1)"""


for _genre in ("metal", "rock", "blues"):
    register(
        f"suggest_scale_{_genre}", lambda spark, sf, g=_genre: th.suggest_scale(th.histogram(src.notes(spark, sf), F.col("dur_us")), g),
        "track_id scale$ confidence~", "notes", suggest_sql(_genre, "dur_us") + ", result AS (SELECT * FROM _sug)")
_PW = GENRES["blues"].pitch_weights()
register(
    "genre_adjust",
    lambda spark, sf: th.genre_adjust(src.candidates(spark, sf), ["track_id", "t_us"], "blues").withColumn(
        "technique_conf", th.adjust_technique(F.when(F.expr("cand_id % 2 = 0"), "bend").otherwise("tapping"), F.col("confidence"), "blues")),
    "cand_id adjusted~ rank technique_conf~", "candidates",
    f"""_a AS (SELECT *, least(1.0, confidence * (0.7 + 0.3 * {_PW}[midi % 12 + 1]::DOUBLE)) AS adjusted FROM candidates),
       result AS (SELECT cand_id, adjusted, row_number() OVER (PARTITION BY track_id, t_us ORDER BY adjusted DESC, cand_id) AS rank,
                  least(1.0, confidence * CASE WHEN cand_id % 2 = 0 THEN 2.0 ELSE 1.0 END) AS technique_conf FROM _a)""",
)
register(
    "apply_genre", lambda spark, sf: th.apply_genre(src.notes(spark, sf), "blues"), "track_id scale$ confidence~ before~ after~", "notes",
    suggest_sql("blues", "dur_us / 1e6 * confidence") + f""",
    _m AS (SELECT track_id, avg(confidence) AS before, avg(least(1.0, confidence * (0.7 + 0.3 * {_PW}[midi % 12 + 1]::DOUBLE))) AS after FROM notes GROUP BY ALL),
    result AS (SELECT * FROM _sug JOIN _m USING (track_id))""",
)
register(
    "genre_filter_by_tempo",
    lambda spark, sf: th.genre_filter_by_tempo(src.notes(spark, sf), src.notes(spark, sf).groupBy("track_id").agg((F.count("*") * 2.0).alias("tempo")), "blues"),
    "track_id note_id dur_us", "notes",
    """_t AS (SELECT track_id, count(*) * 2 AS tempo FROM notes GROUP BY ALL),
       result AS (SELECT track_id, note_id, dur_us FROM notes JOIN _t USING (track_id)
                  WHERE dur_us >= CASE WHEN tempo < 60 * 0.7 OR tempo > 150 * 1.3 THEN 90000 ELSE 60000 END)""",
)
_RS = [(n, i * 12 + r, r, (r + s) % 12) for i, (n, steps) in enumerate(RUN_SCALES.items()) for r in range(12) for s in steps]
register(
    "match_scale",
    lambda spark, sf: th.match_scale(
        seg.mark_legato_runs(src.notes(spark, sf).withColumn("midi", F.expr("40 + midi % 12")), 100_000, NOTE_SLICE).groupBy("track_id", "run").agg(
            F.count("*").alias("n"), th.pc_mask(F.col("midi")).alias("mask")).filter("n >= 4").select("track_id", F.col("run.note_id").alias("first_id"), "n", "mask")),
    "track_id first_id n scale$ root score~", "notes",
    _LEGATO.replace("FROM notes", "FROM (SELECT * REPLACE (40 + midi % 12 AS midi) FROM notes)") + f""",
    _o AS (SELECT * FROM {_values(_RS, 'scale, o, root, pc')}),
    _r AS (SELECT track_id, g, arg_min(note_id, (start_us, note_id)) AS first_id, count(*) AS n, count(DISTINCT midi % 12) AS d FROM _n GROUP BY ALL HAVING count(*) >= 4),
    _d AS (SELECT DISTINCT track_id, g, midi % 12 AS pc FROM _n),
    _i AS (SELECT track_id, g, scale, o, root, count(*) AS m FROM _d JOIN _o USING (pc) GROUP BY ALL),
    result AS (SELECT _r.track_id, first_id, n, scale, root, (m - (d - m) * 0.5) / d AS score FROM _r JOIN _i USING (track_id, g) WHERE (m - (d - m) * 0.5) > 0
               QUALIFY row_number() OVER (PARTITION BY _r.track_id, g ORDER BY m DESC, o) = 1)""",
)

# --- chords -----------------------------------------------------------------------------------------------------
_CH = [(s, i, len(steps), t) for i, (s, steps) in enumerate(CHORDS) for t in steps]
CHORDS_SQL = anchored_sql("notes_dense", 50_000, "start_us", "note_id") + f""",
    _t AS (SELECT * FROM {_values(_CH, 'quality, ord, size, step')}),
    _gr AS (SELECT track_id, anchor_t, count(*) AS n_notes, count(DISTINCT midi % 12) AS n_pcs, avg(confidence) AS c, max(start_us + dur_us) - min(start_us) AS dur_us
            FROM grouped GROUP BY ALL HAVING count(*) >= 2 AND count(DISTINCT midi % 12) >= 2),
    _pc AS (SELECT DISTINCT track_id, anchor_t, midi % 12 AS pc FROM grouped),
    _hit AS (SELECT r.track_id, r.anchor_t, r.pc AS root, quality, ord, size, count(*) AS m FROM _pc r JOIN _pc p USING (track_id, anchor_t)
             JOIN _t ON step = (p.pc - r.pc + 12) % 12 GROUP BY ALL HAVING count(*) >= 2),
    chords AS (SELECT _gr.track_id, anchor_t AS start_us, dur_us, n_notes, root, quality, {NOTE_NAMES}[root + 1] || quality AS name,
                      c * ((m / size) * (m / n_pcs)) AS confidence FROM _hit JOIN _gr USING (track_id, anchor_t) WHERE (m / size) * (m / n_pcs) >= 0.5
               QUALIFY row_number() OVER (PARTITION BY _gr.track_id, anchor_t ORDER BY (m / size) * (m / n_pcs) DESC, root, ord) = 1)"""


def _chords(spark, sf):
    return th.identify_chords(src.notes_dense(spark, sf), width=CAND_SLICE)


register("identify_chords", _chords, "track_id start_us dur_us root quality$ name$ confidence~ n_notes", "notes_dense",
         CHORDS_SQL + ", result AS (SELECT * FROM chords)", recursive=True)
register(
    "chord_summary", lambda spark, sf: th.chord_summary(_chords(spark, sf)), "track_id name$ n places$", "notes_dense",
    CHORDS_SQL + """, _p AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY start_us) AS pos FROM chords),
    result AS (SELECT track_id, name, count(*) AS n, string_agg(CASE WHEN pos <= 16 THEN pos END, ',' ORDER BY pos) AS places FROM _p GROUP BY ALL)""", recursive=True,
)
_SH = [(s, i, st, int(f), sum(x != "x" for x in v.split()), str(any(v.split().count(x) > 1 for x in v.split() if x not in ("x", "0"))).lower())
       for i, (s, v) in enumerate(OPEN_SHAPES.items()) for st, f in enumerate(v.split()) if f != "x"]
STATIC_SQL = f"""_tun AS (SELECT * FROM {_values(list(enumerate(TUNINGS['standard'])), 'string, open')}),
    tabs AS (SELECT n.*, string, midi - open AS fret FROM {{source}} n JOIN _tun ON midi - open BETWEEN 0 AND 24
             QUALIFY row_number() OVER (PARTITION BY note_id ORDER BY (midi - open) * 0.5 + abs(string - 2.5) * 0.3, string) = 1)"""
register(
    "chord_shapes", lambda spark, sf: th.chord_shapes(_chords(spark, sf), pos.static_position(src.notes_dense(spark, sf))),
    "track_id start_us shape$ is_barre! hits size", "notes_dense",
    CHORDS_SQL + "," + STATIC_SQL.format(source="notes_dense") + f""",
    _sh AS (SELECT * FROM {_values(_SH, 'shape, o, string, fret, size, is_barre')}),
    _near AS (SELECT c.track_id, c.start_us, left(c.name, 1) AS letter, string, fret, t.start_us AS ts, note_id,
                     count(*) OVER (PARTITION BY c.track_id, c.start_us) AS total
              FROM chords c JOIN tabs t ON t.track_id = c.track_id AND abs(t.start_us - c.start_us) <= 50000),
    _held AS (SELECT * FROM _near WHERE total >= 2 QUALIFY row_number() OVER (PARTITION BY track_id, start_us, string ORDER BY ts DESC, note_id DESC) = 1),
    _m AS (SELECT track_id, start_us, shape, o, size, is_barre = 'true' AS is_barre, count(*) AS hits FROM _held JOIN _sh USING (string, fret)
           WHERE left(shape, 1) = letter GROUP BY ALL HAVING count(*) / size >= 0.6),
    result AS (SELECT * FROM _m QUALIFY row_number() OVER (PARTITION BY track_id, start_us ORDER BY o) = 1)""", recursive=True,
)

# --- rhythm -----------------------------------------------------------------------------------------------------
from notelake.operators.timeline import row_index  # noqa: E402


def _beats(spark, sf):
    cells = src.notes(spark, sf).groupBy("track_id", F.expr("start_us div 100000").alias("cell")).agg(F.avg("confidence").alias("strength"))
    return row_index(cells, ["cell"], 16, name="pos")


register(
    "time_signature", lambda spark, sf: th.time_signature(_beats(spark, sf)), "track_id n beats unit", "notes",
    """_c AS (SELECT track_id, start_us // 100000 AS cell, avg(confidence) AS strength FROM notes GROUP BY ALL),
       _b AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY cell) - 1 AS pos, count(*) OVER p AS n,
                     (strength - min(strength) OVER p) / (max(strength) OVER p - min(strength) OVER p + 1e-10) AS x FROM _c WINDOW p AS (PARTITION BY track_id)),
       _m AS (SELECT track_id, n, per, pos % per AS slot, avg(x) AS x FROM _b, (VALUES (3), (4), (6)) v(per) WHERE n // per >= 2 GROUP BY ALL),
       _s AS (SELECT track_id, n, per, max(x) FILTER (slot = 0) - avg(x) FILTER (slot <> 0) AS score FROM _m GROUP BY ALL),
       _w AS (SELECT track_id, arg_max(per, (round(score, 12), -per)) AS per FROM _s GROUP BY ALL),
       _t AS (SELECT track_id, count(*) AS n FROM _c GROUP BY ALL),
       _r AS (SELECT track_id, n, CASE WHEN n < 8 OR per IS NULL THEN 4 ELSE per END AS beats FROM _t LEFT JOIN _w USING (track_id)),
       result AS (SELECT *, CASE WHEN beats = 6 THEN 8 ELSE 4 END AS unit FROM _r)""",
)
register(
    "tempo_from_beats",
    lambda spark, sf: th.tempo_from_beats(src.notes(spark, sf).select("track_id", "method", F.col("start_us").alias("t_us")).distinct(), NOTE_SLICE),
    "track_id method$ tempo~ confidence~", "notes",
    """_d AS (SELECT DISTINCT track_id, method, start_us FROM notes),
       _g AS (SELECT track_id, method, start_us - lag(start_us) OVER (PARTITION BY track_id, method ORDER BY start_us) AS gap FROM _d),
       _s AS (SELECT track_id, method, median(gap) AS med, stddev_pop(gap) AS std FROM _g WHERE gap IS NOT NULL GROUP BY ALL HAVING count(*) >= 2),
       _c AS (SELECT track_id, method, 60e6 / med AS tempo, greatest(0, 1 - std / med) AS confidence FROM _s WHERE med > 0),
       result AS (SELECT * FROM _c QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY confidence DESC, method DESC) = 1)""",
)
register(
    "detect_swing", lambda spark, sf: th.detect_swing(src.notes(spark, sf), 100_000, 2, NOTE_SLICE), "track_id pairs has_swing! ratio~", "notes",
    """_g AS (SELECT track_id, lead(start_us) OVER w - start_us AS g1, lead(start_us, 2) OVER w - lead(start_us) OVER w AS g2 FROM notes
              WINDOW w AS (PARTITION BY track_id ORDER BY start_us, note_id)),
       _r AS (SELECT track_id, CASE WHEN g1 > 30000 AND g1 < 70000 AND g1 + g2 > 80000 AND g1 + g2 < 120000 AND g1 > g2 THEN g1 / greatest(g2, 1000) END AS r FROM _g),
       _s AS (SELECT track_id, count(*) AS n, count(r) AS pairs, avg(r) AS m FROM _r GROUP BY ALL),
       result AS (SELECT track_id, pairs, coalesce(n >= 4 AND pairs >= 2 AND m > 1.3 AND m < 2.5, false) AS has_swing,
                  CASE WHEN n >= 4 AND pairs >= 2 AND m > 1.3 AND m < 2.5 THEN m ELSE 1 END AS ratio FROM _s)""",
)
register(
    "triplets", lambda spark, sf: th.triplets(src.notes(spark, sf), 90_000, 0.5, NOTE_SLICE), "track_id id1 id2 id3", "notes",
    """_l AS (SELECT track_id, note_id AS id1, lead(note_id) OVER w AS id2, lead(note_id, 2) OVER w AS id3, lead(start_us) OVER w - start_us AS g1,
                     lead(start_us, 2) OVER w - lead(start_us) OVER w AS g2, row_number() OVER w AS rn FROM notes
              WINDOW w AS (PARTITION BY track_id ORDER BY start_us, note_id)),
       _v AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY rn) AS k FROM _l
              WHERE abs(g1 - 30000) / 30000 < 0.5 AND abs(g2 - 30000) / 30000 < 0.5 AND g1 / greatest(g2, 1000) > 0.8 AND g1 / greatest(g2, 1000) < 1.2),
       _g AS (SELECT track_id, k, rn AS a FROM _v WHERE k = 1
              UNION ALL SELECT v.track_id, v.k, CASE WHEN v.rn - g.a > 2 THEN v.rn ELSE g.a END FROM _g g JOIN _v v ON v.track_id = g.track_id AND v.k = g.k + 1),
       result AS (SELECT v.track_id, id1, id2, id3 FROM _v v JOIN _g g ON g.track_id = v.track_id AND g.k = v.k WHERE v.rn = g.a)""", recursive=True,
)
