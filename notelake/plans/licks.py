"""Lick queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from notelake.operators import licks as lk
from notelake.operators.sequence import library
from notelake.operators.timeline import row_index
from notelake.plans.registry import register
from notelake.plans.segment import NOTE_SLICE
from notelake.session import checkpointed
from notelake.sources import adapters as src


def _melody(spark, sf):
    """Notes brought into a fifth, so that licks occur."""
    return src.notes(spark, sf).withColumn("midi", F.expr("cast(60 + midi % 8 as int)"))


def _matches(spark, sf):
    return lk.resolve_overlaps(lk.lick_matches(_melody(spark, sf), 0.85, width=NOTE_SLICE, block=64, undominated=True))


def _numbered(spark, sf):
    return row_index(_melody(spark, sf), ["start_us", "note_id"], NOTE_SLICE)


register("match_licks", _matches, "track_id first last root ord lick$ score~ confidence~")
register("correct_with_licks", lambda spark, sf: lk.correct_with_licks(_numbered(spark, sf).withColumn("midi", F.expr("midi + if(note_id % 5 = 0, 12, 0)")), _matches(spark, sf)),
         "track_id note_id midi new_midi lick$")
register("lick_annotations", lambda spark, sf: lk.lick_annotations(_matches(spark, sf), _numbered(spark, sf)), "track_id lick$ start_us end_us score~ confidence~")


# --- licks by phrase --------------------------------------------------------------------------------------------
_GAP = 100_000


def _phrases(spark, sf):
    """Numbered phrases, every fifth note an octave up."""
    raised = _melody(spark, sf).withColumn("midi", F.expr("midi + if(note_id % 5 = 0, 12, 0)"))
    return lk.numbered_phrases(raised, _GAP, NOTE_SLICE)


def _phrase_licks(spark, sf):
    phrases = checkpointed(_phrases(spark, sf))
    return phrases, lk.phrase_licks(phrases, 0.7, width=NOTE_SLICE, block=64)


_LIBRARY = ", ".join(f"({i}, '{name}', {steps})" for i, (name, steps) in enumerate(library()) if len(steps) >= 4)
PHRASE_SQL = f"""_n AS (SELECT track_id, note_id, start_us, start_us + dur_us AS end_us, confidence, 60 + midi % 8 + CASE WHEN note_id % 5 = 0 THEN 12 ELSE 0 END AS midi FROM notes),
    _r AS (SELECT *, row_number() OVER w - 1 AS rn, lag(end_us) OVER w AS e FROM _n WINDOW w AS (PARTITION BY track_id ORDER BY start_us, note_id)),
    phrases AS (SELECT *, max(CASE WHEN e IS NULL OR start_us - e > {_GAP} THEN rn END) OVER (PARTITION BY track_id ORDER BY rn) AS phrase FROM _r),
    _a AS (SELECT track_id, phrase, rn, midi, list(midi) OVER (PARTITION BY track_id, phrase ORDER BY rn ROWS BETWEEN CURRENT ROW AND 14 FOLLOWING) AS ms FROM phrases),
    _d AS (SELECT *, list_transform(ms, lambda m: CAST(m - midi AS INTEGER)) AS ds FROM _a WHERE len(ms) >= 4),
    _lib(ord, lick, steps) AS (VALUES {_LIBRARY}),
    _t AS (SELECT track_id, phrase, rn, midi, ms, ord, lick, steps, ds[1:len(steps) + 2] AS ds,
                  list_reduce(list_prepend([]::INTEGER[], list_transform(steps, lambda s: [CAST(s AS INTEGER)])), lambda acc, x: list_concat(acc, list_transform(list_sort(list_filter(
                    list_transform(range(1, least(len(steps) + 2, len(ds)) + 1), lambda i: [abs(ds[i] - x[1]), CAST(i AS INTEGER)]),
                    lambda z: z[1] <= 1 AND NOT list_contains(acc, z[2])))[1:1], lambda z: z[2]))) AS taken
           FROM _d, _lib),
    _p AS (SELECT *, len(taken) / len(steps) AS score, list_distinct(list_transform(taken, lambda t: list_position(list_transform(steps, lambda s: abs(ds[t] - s) <= 1), true))) AS placed
           FROM _t WHERE len(taken) / len(steps) >= 0.7),
    _c AS (SELECT *, score * (1 - (1 - len(placed) / len(steps)) * 0.3) AS lick_confidence FROM _p),
    _best AS (SELECT * FROM _c QUALIFY row_number() OVER (PARTITION BY track_id, phrase ORDER BY round(lick_confidence, 9) DESC, rn, ord) = 1),
    _span AS (SELECT track_id, phrase, count(*) AS n_notes, min(start_us) AS start_us, arg_max(end_us, rn) AS end_us FROM phrases GROUP BY ALL HAVING count(*) >= 4),
    found AS (SELECT s.*, b.rn AS first, b.ord, b.lick, b.score, b.lick_confidence, b.steps, b.midi AS root, list_filter(range(1, len(steps) + 1), lambda i: NOT list_contains(placed, i)) AS lacks
              FROM _span s JOIN _best b USING (track_id, phrase)),
    moved AS (SELECT p.track_id, p.note_id, p.rn, p.midi AS old_midi, p.confidence, f.lick, CASE WHEN abs(p.midi - (f.root + f.steps[p.rn - p.phrase + 1])) = 12 THEN f.root + f.steps[p.rn - p.phrase + 1] END AS want
              FROM phrases p LEFT JOIN found f USING (track_id, phrase))"""
register(
    "phrase_licks", lambda spark, sf: _phrase_licks(spark, sf)[1].withColumn("missing", F.array_join("missing", ",")),
    "track_id phrase n_notes start_us end_us first root ord lick$ score~ confidence~ missing$", "notes",
    PHRASE_SQL + """, result AS (SELECT *, lick_confidence AS confidence, array_to_string(list_transform(lacks, lambda i: root + steps[i]), ',') AS missing FROM found)""",
)
register(
    "corrected_phrases", lambda spark, sf: lk.corrected_phrases(*_phrase_licks(spark, sf)),
    "track_id note_id midi confidence~ lick$", "notes",
    PHRASE_SQL + """, result AS (SELECT track_id, note_id, coalesce(want, old_midi) AS midi, CASE WHEN want IS NULL THEN confidence ELSE confidence * 0.9 END AS confidence,
                                        CASE WHEN want IS NOT NULL THEN lick END AS lick FROM moved)""",
)


def _coverage(spark, sf):
    phrases, found = _phrase_licks(spark, sf)
    found = checkpointed(found)
    return lk.lick_coverage(lk.corrected_phrases(phrases, found), found)


register(
    "lick_coverage", _coverage, "track_id n_notes n_licks n_corrections coverage~", "notes",
    PHRASE_SQL + """, _m AS (SELECT track_id, count(*) AS n_notes, count(want) AS n_moved FROM moved GROUP BY ALL),
    _f AS (SELECT track_id, count(*) AS n_licks, count(*) FILTER (len(lacks) > 0) AS n_lacking, sum(n_notes) AS n_covered FROM found GROUP BY ALL),
    result AS (SELECT _m.track_id, _m.n_notes, coalesce(n_licks, 0) AS n_licks, n_moved + coalesce(n_lacking, 0) AS n_corrections, coalesce(n_covered, 0) / _m.n_notes AS coverage
               FROM _m LEFT JOIN _f USING (track_id))""",
)
