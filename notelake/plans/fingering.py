"""Fingering queries: chords resolved together, cheapest paths, smoothed positions and low frets."""

from __future__ import annotations

from notelake.functions.dims import TUNINGS
from notelake.operators import chained as ch
from notelake.operators import decode as dec
from notelake.operators import fingering as fing
from notelake.operators import spectral as sp
from notelake.operators import techniques as tq
from notelake.plans.registry import register
from notelake.plans.segment import FRAME_SLICE, NOTE_SLICE
from notelake.plans.spectral import _spec
from notelake.plans.tabs import STATIC, _static
from notelake.plans.theory import _values
from notelake.sources import adapters as src

# Chords and whole paths are held against plain loops and all paths of small tracks (tests/test_fingering.py); SQL has no way to state them.
register("resolve_chords", lambda spark, sf: fing.resolve_chords(src.notes_dense(spark, sf), width=NOTE_SLICE), "track_id note_id string fret")
register("optimal_fingering", lambda spark, sf: fing.optimal_fingering(src.notes_dense(spark, sf), width=NOTE_SLICE), "track_id note_id string fret")

OPTIONS = f"""_tn AS (SELECT * FROM {_values(list(enumerate(TUNINGS['standard'])), 'string, open')}),
    _op AS (SELECT note_id, list({{'s': string, 'f': midi - open}} ORDER BY string) AS os FROM notes JOIN _tn ON midi - open BETWEEN 0 AND 24 GROUP BY note_id)"""


_NEAR = "-(o.f * 1e-1 + {step}) - (CASE WHEN o.f > 12 THEN (o.f - 12) * 3e-1 ELSE 0e0 END)"
_NEAR_STEP = "(abs(o.f - q.before.f) * 5e-1 + abs(o.s - q.before.s) * 2e-1)"
_SOLO = "(CASE WHEN o.s >= 3 THEN 5e0 ELSE 0e0 END) + (CASE WHEN o.f >= 5 THEN (o.f - 5) / 18e0 * 7e-1 * 4e0 ELSE 0e0 END) + (CASE WHEN o.f BETWEEN 5 AND 22 THEN 2e0 ELSE 0e0 END) + {step}"
_SOLO_STEP = """(CASE WHEN abs(o.f - q.before.f) <= 3 THEN 2e0 - abs(o.f - q.before.f) * 3e-1 ELSE -abs(o.f - q.before.f) * 2e-1 END)
    + (CASE WHEN abs(o.s - q.before.s) <= 1 THEN 1e0 ELSE -abs(o.s - q.before.s) * 5e-1 END)"""


def _place_sql(score: str, step: str, better: str) -> str:
    """CTE ``result``: one note after the other; scores to 9 places, so sums taken in another order do not decide between equals."""
    best = lambda how: (f"list_reduce(list_transform(q.os, lambda o: {{'c': round({score.format(step=how)}, 9), 's': o.s, 'f': o.f}}), "  # noqa: E731
                        f"lambda a, b: CASE WHEN b.c {better} a.c THEN b ELSE a END)")
    return f"""_pl AS (SELECT track_id, note_id, os, row_number() OVER (PARTITION BY track_id ORDER BY start_us, note_id) AS rn FROM notes JOIN _op USING (note_id)),
    _pr AS (SELECT q.track_id, q.rn, q.note_id, {best('0e0')} AS p FROM _pl q WHERE rn = 1
            UNION ALL SELECT q.track_id, q.rn, q.note_id, {best(step)} FROM (SELECT l.*, r.p AS before FROM _pr r JOIN _pl l ON l.track_id = r.track_id AND l.rn = r.rn + 1) q),
    result AS (SELECT track_id, note_id, p.s AS string, p.f AS fret FROM _pr)"""


for _policy, _sql in (("near", _place_sql(_NEAR, _NEAR_STEP, ">")), ("solo", _place_sql(_SOLO, _SOLO_STEP, ">="))):
    register(f"place_notes_{_policy}", lambda spark, sf, policy=_policy: fing.place_notes(src.notes(spark, sf), policy, width=NOTE_SLICE),
             "track_id note_id string fret", "notes", OPTIONS + "," + _sql, recursive=True)


def _far(a: str, b: str, gap: str) -> str:
    return f"({a} > 0 AND {b} > 0 AND (({gap} < 50000 AND abs({b} - {a}) > 5) OR (abs({b} - {a}) > 12 AND {gap} < 100000)))"


def _lower(before: str) -> str:
    score = (f"(CASE WHEN o.f <= 7 THEN (7 - o.f) * 2 ELSE 7 - o.f END) + (CASE WHEN o.f = 0 THEN 5 ELSE 0 END) - abs(o.f - mean) * 3e-1 "
             f"- (CASE WHEN {_far(before, 'o.f', 'pg')} THEN 10 ELSE 0 END) - (CASE WHEN {_far('o.f', 'nf', 'ng')} THEN 5 ELSE 0 END)")
    best = f"list_reduce(list_transform(os, lambda o: {{'c': {score}, 's': o.s, 'f': o.f}}), lambda a, b: CASE WHEN b.c > a.c THEN b ELSE a END)"
    return f"CASE WHEN len(os) <= 1 OR mean IS NULL THEN {{'c': 0e0, 's': string, 'f': fret}} ELSE {best} END"


register(
    "prefer_lower_frets", lambda spark, sf: fing.prefer_lower_frets(_static(spark, sf), width=NOTE_SLICE), "track_id note_id string fret", "notes",
    STATIC + "," + OPTIONS + f""",
    _lt AS (SELECT *, row_number() OVER w AS rn, avg(CASE WHEN fret > 0 THEN fret END) OVER (w ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS mean,
                   lead(fret) OVER w AS nf, lead(start_us) OVER w - start_us AS ng, start_us - lag(start_us) OVER w AS pg FROM tabs
            WINDOW w AS (PARTITION BY track_id ORDER BY start_us, note_id)),
    _lp AS (SELECT _lt.track_id, rn, note_id, string, fret, mean, nf, ng, pg, os FROM _lt JOIN _op USING (note_id)),
    _lo AS (SELECT track_id, rn, note_id, {_lower('0')} AS p FROM _lp WHERE rn = 1
            UNION ALL SELECT q.track_id, q.rn, q.note_id, {_lower('q.before')} FROM (
                SELECT l.*, r.p.f AS before FROM _lo r JOIN _lp l ON l.track_id = r.track_id AND l.rn = r.rn + 1) q),
    result AS (SELECT track_id, note_id, p.s AS string, p.f AS fret FROM _lo)""", recursive=True,
)


def _reach(a: str, b: str) -> str:
    return f"(CASE WHEN {a} = 0 OR {b} = 0 THEN 0e0 WHEN abs({b} - {a}) <= 4 THEN abs({b} - {a}) * 2e-1 * 15e-1 ELSE 2e0 + abs({b} - {a}) * 3e-1 + 5e0 END)"


def _sweep(source: str, name: str) -> str:
    cost = lambda f: f"{_reach('q.before', f)} + {_reach(f, 'q.nf')}"
    others = "list_filter(q.os, lambda o: o.s <> q.string OR o.f <> q.fret)"
    options = f"list_prepend({{'c': {cost('q.fret')}, 's': q.string, 'f': q.fret}}, list_transform({others}, lambda o: {{'c': {cost('o.f')}, 's': o.s, 'f': o.f}}))"
    best = f"list_reduce({options}, lambda a, b: CASE WHEN b.c < a.c - 1e-1 THEN b ELSE a END)"
    return f"""_n{name} AS (SELECT t.track_id, note_id, start_us, string, fret, os, row_number() OVER w AS rn, lead(fret) OVER w AS nf FROM {source} t JOIN _op USING (note_id)
            WINDOW w AS (PARTITION BY t.track_id ORDER BY start_us, note_id)),
    _r{name} AS (SELECT track_id, rn, note_id, start_us, {{'c': 0e0, 's': string, 'f': fret}} AS p FROM _n{name} WHERE rn = 1
            UNION ALL SELECT q.track_id, q.rn, q.note_id, q.start_us, CASE WHEN q.nf IS NULL OR q.fret = 0 THEN {{'c': 0e0, 's': q.string, 'f': q.fret}} ELSE {best} END
            FROM (SELECT l.*, r.p.f AS before FROM _r{name} r JOIN _n{name} l ON l.track_id = r.track_id AND l.rn = r.rn + 1) q),
    {name} AS (SELECT track_id, note_id, start_us, p.s AS string, p.f AS fret FROM _r{name})"""


register(
    "smooth_positions", lambda spark, sf: fing.smooth_positions(_static(spark, sf), width=NOTE_SLICE), "track_id note_id string fret", "notes",
    STATIC + "," + OPTIONS + "," + _sweep("tabs", "sweep1") + "," + _sweep("sweep1", "sweep2") + "," + _sweep("sweep2", "sweep3")
    + ", result AS (SELECT * FROM sweep3)", recursive=True,
)


def _strings(spark, sf):
    """Notes of six frames each, with the spectra scaled into the range of strings."""
    spec = _spec(spark, sf)
    notes = spec.filter("frame % 6 = 0").selectExpr(
        "track_id", "frame as note_id", "frame as first_frame", "6L as n_frames", "frame * 23220 as start_us", "cast(38 + frame * 7 % 50 as int) as midi")
    return fing.score_strings(notes, sp.note_shape(sp.spectral_shape(spec, 25.0), notes))


# these three are held against plain loops in tests/test_fingering.py and tests/test_sequences.py
register("score_strings", _strings, "track_id note_id string fret confidence~ method$")
register("method_agreement", lambda spark, sf: ch.method_agreement(src.notes_dense(spark, sf), sorted(src.METHODS.values()), width=NOTE_SLICE),
         "track_id group start_us midi n_methods methods$")
register("agreement_counts", lambda spark, sf: ch.agreement_counts(ch.method_agreement(src.notes_dense(spark, sf), sorted(src.METHODS.values()), width=NOTE_SLICE)),
         "track_id n_methods n_groups")


def _trills(spark, sf):
    """Notes of 32 frames that go between two pitches at a pace set by their number."""
    frames = src.frames(spark, sf).selectExpr(
        "track_id", "frame div 32 as note_id", "frame", "if(is_voiced, 60 + if(frame div (1 + (frame div 32) % 3) % 2 = 0, 0D, 1 + (frame div 32) % 4 * 0.75D) + (event_id % 5) / 50D + case frame % 8 when 1 then -1.2D when 6 then 1.2D else 0D end, 0D) as pitch")
    notes = frames.select("track_id", "note_id").distinct().selectExpr("track_id", "note_id", "32 * 23220L as dur_us", "cast(5 as int) as fret")
    return tq.trills(frames, notes)


register(
    "trills", _trills, "track_id note_id interval~ rate~ target_fret confidence~", "frames",
    """_v AS (SELECT track_id, frame // 32 AS note_id, frame, 60 + (CASE WHEN frame // (1 + (frame // 32) % 3) % 2 = 0 THEN 0e0 ELSE 1 + (frame // 32) % 4 * 0.75e0 END) + (event_id % 5) / 50e0 + CASE frame % 8 WHEN 1 THEN -1.2e0 WHEN 6 THEN 1.2e0 ELSE 0e0 END AS p FROM frames WHERE is_voiced),
    _st AS (SELECT track_id, note_id, count(*) AS n, min(p) AS lo, max(p) AS hi, avg(p) AS mean FROM _v GROUP BY ALL HAVING count(*) >= 15 AND max(p) > min(p)),
    _nb AS (SELECT *, greatest(CAST(floor((hi - lo) / 0.25e0) AS INT) + 1, 4) AS nb FROM _st),
    _hi AS (SELECT track_id, note_id, least(CAST(floor((p - lo) / (hi - lo) * nb) AS INT), nb - 1) AS bin, count(*) AS c FROM _v JOIN _nb USING (track_id, note_id) GROUP BY ALL),
    _hb AS (SELECT _nb.track_id, _nb.note_id, nb, b AS bin, coalesce(c, 0) AS c FROM _nb JOIN range(0, 600) r(b) ON b < nb LEFT JOIN _hi ON _hi.track_id = _nb.track_id AND _hi.note_id = _nb.note_id AND _hi.bin = b),
    _k AS (SELECT k, exp(-2e0 * k * k) / sum(exp(-2e0 * k * k)) OVER () AS w FROM range(-2, 3) q(k)),
    _m AS (SELECT track_id, note_id, nb, bin, w, (bin + k + 4 * nb) % (2 * nb) AS m FROM _hb, _k),
    _s AS (SELECT _m.track_id, _m.note_id, _m.bin, any_value(_m.nb) AS nb, round(sum(w * o.c), 9) AS s FROM _m JOIN _hb o ON o.track_id = _m.track_id AND o.note_id = _m.note_id
             AND o.bin = CASE WHEN m >= _m.nb THEN 2 * _m.nb - 1 - m ELSE m END GROUP BY _m.track_id, _m.note_id, _m.bin),
    _e AS (SELECT *, CASE WHEN s = lag(s) OVER w THEN 0 ELSE 1 END AS fresh, max(s) OVER (PARTITION BY track_id, note_id) AS top FROM _s WINDOW w AS (PARTITION BY track_id, note_id ORDER BY bin)),
    _r AS (SELECT *, sum(fresh) OVER (PARTITION BY track_id, note_id ORDER BY bin) AS g FROM _e),
    _p AS (SELECT track_id, note_id, g, any_value(s) AS s, any_value(top) AS top, (min(bin) + max(bin)) // 2 AS mid FROM _r GROUP BY ALL),
    _q AS (SELECT *, s > lag(s) OVER w AND s > lead(s) OVER w AS peak FROM _p WINDOW w AS (PARTITION BY track_id, note_id ORDER BY g)),
    _t AS (SELECT track_id, note_id, list(mid ORDER BY s DESC, mid DESC) AS mids FROM _q WHERE peak AND s >= 0.25e0 * top GROUP BY ALL HAVING count(*) >= 2),
    _z AS (SELECT track_id, note_id, frame, sign(round(p - mean, 9)) AS z FROM _v JOIN _nb USING (track_id, note_id)),
    _y AS (SELECT track_id, note_id, count(*) FILTER (z <> b) AS x FROM (SELECT *, lag(z) OVER (PARTITION BY track_id, note_id ORDER BY frame) AS b FROM _z) GROUP BY ALL),
    _a AS (SELECT track_id, note_id, abs(mids[1] - mids[2]) * (hi - lo) / nb AS interval, x / (32 * 23220 / 1e6) AS rate FROM _t JOIN _nb USING (track_id, note_id) JOIN _y USING (track_id, note_id)),
    result AS (SELECT *, 5 + CAST(round_even(round(interval, 9), 0) AS INT) AS target_fret, least(1.0, rate / 20) AS confidence FROM _a WHERE round(interval, 9) BETWEEN 0.8e0 AND 3.5e0 AND rate BETWEEN 10 AND 35)""",
)


def _with_silence(spark, sf):
    """Frames with a second candidate an octave off; one frame in seventeen is unvoiced, some have silence as a second choice."""
    frames = src.frames(spark, sf)
    one = frames.selectExpr("track_id", "frame", "midi + (event_id % 7 - 3) / 10D as midi", "440D * pow(2D, (midi - 69) / 12D) as frequency", "confidence", "is_voiced")
    two = frames.filter("is_voiced").selectExpr(
        "track_id", "frame", "midi + 12D * (event_id % 3 - 1) as midi", "440D * pow(2D, (midi - 69) / 12D + event_id % 3 - 1) as frequency", "1 - confidence as confidence", "event_id % 5 <> 0 as is_voiced")
    return dec.smooth_path(dec.decode_with_silence(one.unionByName(two), width=FRAME_SLICE), width=FRAME_SLICE)


register("decode_with_silence", _with_silence, "track_id frame midi frequency~ confidence~ is_voiced! filled!")
