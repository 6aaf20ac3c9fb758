"""Ensemble voting and detector comparison queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from notelake.functions.dims import METHOD_WEIGHTS, ONSET_WEIGHTS
from notelake.operators import voting as vote
from notelake.plans.registry import anchored_sql, register
from notelake.plans.segment import CAND_SLICE
from notelake.sources import adapters as src


def case_sql(values: dict[str, float], column: str = "method") -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + " ELSE 1.0 END"


def _clusters(spark, sf):
    return vote.pitch_clusters(src.candidates(spark, sf), width=CAND_SLICE)


CLUSTERS_SQL = anchored_sql("candidates", 30_000) + f""",
    _w AS (SELECT *, CAST({case_sql(METHOD_WEIGHTS)} AS DOUBLE) * confidence AS w FROM grouped),
    _m AS (SELECT track_id, anchor_t, midi, avg(frequency) AS f FROM _w GROUP BY ALL),
    _l AS (SELECT *, coalesce(midi - lag(midi) OVER g = 1 AND abs(1200 * log2(f / lag(f) OVER g)) <= 50, false) AS linked,
                  row_number() OVER g AS pos FROM _m WINDOW g AS (PARTITION BY track_id, anchor_t ORDER BY midi)),
    _b AS (SELECT *, max(CASE WHEN linked THEN NULL ELSE pos END) OVER (PARTITION BY track_id, anchor_t ORDER BY midi) AS run_at FROM _l),
    clustered AS (SELECT _w.*, CASE WHEN (pos - run_at) % 2 = 1 THEN midi - 1 ELSE midi END AS base_midi
                  FROM _w JOIN _b USING (track_id, anchor_t, midi))"""
CONSENSUS_SQL = CLUSTERS_SQL + """,
    _c AS (SELECT track_id, anchor_t, base_midi, count(*) AS n, sum(w) AS sw, round_even(sum(w * midi) / sum(w), 0) AS midi, min(t_us) AS start_us,
                  max(t_us) + 23220 AS end_us, sum(w * frequency) / sum(w) AS frequency, sum(w * confidence) / sum(w) AS c,
                  count(DISTINCT method) AS votes, string_agg(DISTINCT method, ',' ORDER BY method) AS methods,
                  CASE WHEN count(*) > 1 THEN 1200 * log2(max(frequency) / min(frequency)) ELSE 0 END AS pitch_spread
           FROM clustered GROUP BY ALL),
    consensus AS (SELECT *, least(1.0, c * (1 + (votes - 2) * 0.1)) AS confidence FROM _c WHERE votes >= 2 AND sw / n >= 1.5 / votes)"""
NOTES_SQL = CONSENSUS_SQL + """,
    _e AS (SELECT *, max(end_us) OVER (PARTITION BY track_id, midi ORDER BY start_us, anchor_t, base_midi
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM consensus),
    _n AS (SELECT *, sum(CASE WHEN start_us <= e + 30000 THEN 0 ELSE 1 END)
                  OVER (PARTITION BY track_id, midi ORDER BY start_us, anchor_t, base_midi) AS g FROM _e),
    merged AS (SELECT track_id, midi, min(start_us) AS start_us, max(end_us) AS end_us, sum(confidence * votes) / sum(votes) AS confidence,
                  sum(frequency * votes) / sum(votes) AS frequency, max(votes) AS votes, max(pitch_spread) AS pitch_spread,
                  count(*) AS n_merged FROM _n GROUP BY track_id, midi, g),
    ensemble AS (SELECT * FROM merged WHERE confidence >= 0.5 AND end_us - start_us >= 50000)"""

register(
    "cluster_by_pitch", lambda spark, sf: _clusters(spark, sf),
    "track_id anchor_t midi base_midi n mean_freq~", "candidates",
    CLUSTERS_SQL + """, result AS (SELECT track_id, anchor_t, midi, base_midi, count(*) AS n, avg(frequency) AS mean_freq
                                   FROM clustered GROUP BY ALL)""", recursive=True,
)
register(
    "consensus",
    lambda spark, sf: vote.consensus(_clusters(spark, sf)).withColumn("methods", F.array_join("methods", ",")),
    "track_id anchor_t base_midi midi start_us end_us frequency~ confidence~ votes methods$ pitch_spread~", "candidates",
    CONSENSUS_SQL + ", result AS (SELECT * FROM consensus)", recursive=True,
)
register(
    "ensemble_notes", lambda spark, sf: vote.ensemble_notes(src.candidates(spark, sf), width=CAND_SLICE),
    "track_id midi start_us end_us confidence~ frequency~ votes pitch_spread~ n_merged", "candidates",
    NOTES_SQL + ", result AS (SELECT * FROM ensemble)", recursive=True,
)
register(
    "ensemble_note_counts",
    lambda spark, sf: vote.ensemble_notes(src.candidates(spark, sf), width=CAND_SLICE).groupBy("track_id").agg(
        F.count("*").alias("n_notes"), F.avg("confidence").alias("mean_confidence"), F.max("votes").alias("max_votes")),
    "track_id n_notes mean_confidence~ max_votes", "candidates",
    NOTES_SQL + """, result AS (SELECT track_id, count(*) AS n_notes, avg(confidence) AS mean_confidence, max(votes) AS max_votes
                    FROM ensemble GROUP BY ALL)""", recursive=True,
)

_ONSET_METHODS = ["spectral_flux", "complex_domain", "hfc", "energy", "attack"]


def _onsets(spark, sf):
    names = F.array(*[F.lit(m) for m in _ONSET_METHODS])
    return src.candidates(spark, sf).select(
        "track_id", "cand_id", "t_us", F.col("confidence").alias("strength"), F.element_at(names, F.expr("cast(cand_id % 5 + 1 as int)")).alias("method"),
        F.expr("cand_id % 11 = 0").alias("is_legato"))


register(
    "vote_onsets",
    lambda spark, sf: vote.vote_onsets(_onsets(spark, sf), width=CAND_SLICE).withColumn("methods", F.array_join("methods", ",")),
    "track_id anchor_t t_us~ confidence~ is_legato! methods$ attack_strength~", "candidates",
    f"""_on AS (SELECT track_id, cand_id, t_us, confidence AS strength, cand_id % 11 = 0 AS leg,
                  {_ONSET_METHODS}[cand_id % 5 + 1] AS method FROM candidates),""" + anchored_sql("_on", 30_000) + f""",
    _w AS (SELECT *, CAST({case_sql(ONSET_WEIGHTS)} AS DOUBLE) AS w FROM grouped),
    _v AS (SELECT track_id, anchor_t, sum(w * t_us) / sum(w) AS t_us, bool_or(method = 'attack') AS a, bool_or(leg) AS l,
                  count(DISTINCT method) AS u, string_agg(DISTINCT method, ',' ORDER BY method) AS methods,
                  coalesce(max(strength) FILTER (method = 'attack'), 0) AS attack_strength FROM _w GROUP BY ALL),
    result AS (SELECT *, least(1.0, (u + CASE WHEN a THEN 0.5 ELSE 0 END) / 5) AS confidence, l AND NOT a AS is_legato
               FROM _v WHERE u + CASE WHEN a THEN 0.5 ELSE 0 END >= 2 OR a)""", recursive=True,
)


# Four detectors read each frame; three of them may drop out or be a few semitones off, by fixed rules of the event id.
_VOTE_DETECTORS = ["pyin", "cqt", "piptrack", "yin"]
_VOTE_WEIGHTS = {"pyin": 1.0, "cqt": 0.9, "piptrack": 0.7, "yin": 1.1}
_SPREAD = [("pyin", "true", "0", "confidence"), ("cqt", "event_id % 3 <> 0", "event_id % 5 - 2", "confidence * 0.9"),
           ("piptrack", "event_id % 4 <> 0", "event_id % 7 - 3", "confidence * 0.8"),
           ("yin", "event_id % 5 <> 0", "event_id % 2", "confidence * 0.7")]


def _frame_votes(spark, sf):
    f = src.frames(spark, sf).filter("is_voiced")
    table = F.array(*[F.struct(F.lit(m).alias("method"), F.expr(keep).alias("keep"), F.expr(f"midi + {off}").alias("m"),
                               F.expr(f"cast({conf} as double)").alias("c")) for m, keep, off, conf in _SPREAD])
    rows = f.select("track_id", "frame", F.inline(table)).filter("keep")
    return rows.select("track_id", "frame", "method", F.col("m").alias("midi"), F.col("c").alias("confidence"),
                       F.expr("440D * pow(2D, (m - 69) / 12D)").alias("frequency"))


_VOTES_SQL = "_v AS (" + " UNION ALL ".join(
    f"SELECT track_id, frame, {i} AS ord, '{m}' AS method, midi + {off} AS midi, CAST({conf} AS DOUBLE) AS confidence FROM frames WHERE is_voiced AND {keep}"
    for i, (m, keep, off, conf) in enumerate(_SPREAD, 1)) + """),
    _f AS (SELECT *, 440.0 * pow(2.0, (midi - 69) / 12.0) AS frequency FROM _v)"""
register(
    "vote_frames",
    lambda spark, sf: vote.vote_frames(_frame_votes(spark, sf), _VOTE_DETECTORS, _VOTE_WEIGHTS),
    "track_id frame midi frequency~ confidence~ votes", "frames",
    _VOTES_SQL + f""",
    _r AS (SELECT *, row_number() OVER (PARTITION BY track_id, frame ORDER BY ord) AS rn FROM _f),
    _h AS (SELECT track_id, frame, rn, [midi] AS heads, 1 AS g FROM _r WHERE rn = 1
           UNION ALL
           SELECT r.track_id, r.frame, r.rn, CASE WHEN p IS NULL THEN list_append(h.heads, r.midi) ELSE h.heads END,
                  coalesce(p, len(h.heads) + 1)
           FROM _h h JOIN _r r ON r.track_id = h.track_id AND r.frame = h.frame AND r.rn = h.rn + 1,
                LATERAL (SELECT min(i) AS p FROM range(1, 6) t(i) WHERE i <= len(h.heads) AND abs(r.midi - h.heads[i]) <= 1)),
    _j AS (SELECT _r.*, _h.g, confidence * CAST({case_sql(_VOTE_WEIGHTS)} AS DOUBLE) AS w FROM _r JOIN _h USING (track_id, frame, rn)),
    _g AS (SELECT track_id, frame, g, arg_min(midi, rn) AS midi, count(*) AS votes, sum(w) AS sw, sum(w * frequency) AS swf,
                  avg(confidence) AS confidence, max(confidence) AS mc FROM _j GROUP BY ALL),
    _s AS (SELECT *, CASE WHEN votes >= 2 THEN votes + sw * 0.5 WHEN mc >= 0.7 THEN 0 END AS score FROM _g),
    result AS (SELECT *, swf / (sw + 1e-10) AS frequency FROM _s WHERE score IS NOT NULL
               QUALIFY row_number() OVER (PARTITION BY track_id, frame ORDER BY score DESC, g) = 1)""", recursive=True,
)

_EST = [("hps", "-12 * (event_id % 3 - 1)"), ("yin", "0"), ("cepstrum", "event_id % 2"), ("autocorr", "-(event_id % 2)")]


def _estimates(spark, sf):
    f = src.frames(spark, sf).filter("is_voiced")
    table = F.array(*[F.struct(F.lit(m).alias("method"), F.lit(i).alias("ord"), F.expr(f"midi + {off}").alias("m"))
                      for i, (m, off) in enumerate(_EST)])
    return f.select("track_id", "frame", F.inline(table)).select(
        "track_id", "frame", "method", "ord", F.col("m").alias("midi"), F.expr("440D * pow(2D, (m - 69) / 12D)").alias("frequency"))


register(
    "attack_consensus", lambda spark, sf: vote.attack_consensus(_estimates(spark, sf), ["track_id", "frame"]),
    "track_id frame midi frequency~ votes confidence~", "frames",
    "_e AS (" + " UNION ALL ".join(
        f"SELECT track_id, frame, {i} AS ord, '{m}' AS method, midi + ({off}) AS midi FROM frames WHERE is_voiced" for i, (m, off) in enumerate(_EST)) + """),
    _g AS (SELECT track_id, frame, midi, count(*) AS n, min(ord) AS o, bool_or(method = 'hps') AS h FROM _e GROUP BY ALL),
    _x AS (SELECT *, EXISTS (SELECT 1 FROM _g b WHERE a.h AND b.track_id = a.track_id AND b.frame = a.frame AND b.midi = a.midi + 12 AND b.n >= a.n) AS swap FROM _g a),
    result AS (SELECT *, n AS votes, 440.0 * pow(2.0, (midi - 69) / 12.0) AS frequency, 0.3 + 0.7 * n / 4 AS confidence FROM _x
               QUALIFY row_number() OVER (PARTITION BY track_id, frame ORDER BY swap DESC, n DESC, o) = 1)""",
)
register(
    "bin_consensus", lambda spark, sf: vote.bin_consensus(src.notes_dense(spark, sf).withColumn("midi", F.expr("midi % 5 + 60")).withColumn(
        "frequency", F.expr("cast(400 + note_id % 50 as double)")).withColumn("level", F.expr("cast(note_id % 90 as double)"))),
    "track_id midi cell n start_us~ end_us~ frequency~ level~ confidence~", "notes_dense",
    """_c AS (SELECT track_id, midi % 5 + 60 AS midi, start_us // 50000 AS cell, count(*) AS n, avg(start_us) AS start_us,
                  avg(start_us + dur_us) AS end_us, avg(confidence) AS c, avg(400 + note_id % 50) AS frequency, max(note_id % 90) AS level FROM notes_dense GROUP BY 1, 2, 3),
       result AS (SELECT *, least(1.0, c * (1 + 0.2 * (n - 1))) AS confidence FROM _c)""",
)
register(
    "detector_stats", lambda spark, sf: vote.detector_stats(src.candidates(spark, sf).withColumn("dur_us", F.expr("10000 + cand_id % 7000")).withColumn("frequency", F.expr("if(cand_id % 17 = 0, 0D, frequency)"))),
    "track_id method$ n voiced~ mean_dur_us~ min_hz~ max_hz~ mean_hz~ mean_conf~ rate~", "candidates",
    """_u AS (SELECT * REPLACE (CASE WHEN cand_id % 17 = 0 THEN 0 ELSE frequency END AS frequency) FROM candidates),
       result AS (SELECT track_id, method, count(*) AS n, avg((frequency > 0)::INT) AS voiced, avg(10000 + cand_id % 7000) AS mean_dur_us, min(frequency) AS min_hz, max(frequency) AS max_hz, avg(frequency) AS mean_hz,
                  avg(confidence) AS mean_conf, CASE WHEN max(t_us) > min(t_us) THEN count(*) / ((max(t_us) - min(t_us)) / 1e6) END AS rate
                  FROM _u GROUP BY ALL)""",
)
register(
    "detector_sets", lambda spark, sf: vote.method_sets(src.notes(spark, sf), "pyin", "cqt"),
    "track_id midi side$", "notes",
    """_s AS (SELECT DISTINCT track_id, midi, method FROM notes WHERE method IN ('pyin', 'cqt')),
       result AS (SELECT track_id, midi, CASE WHEN count(*) = 2 THEN 'both' ELSE min(method) END AS side FROM _s GROUP BY ALL)""",
)
