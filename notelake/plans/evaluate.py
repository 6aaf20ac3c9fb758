"""Matching against truth, metrics and leaderboards."""

from __future__ import annotations

from pyspark.sql import functions as F

from notelake.operators import matching as mt
from notelake.plans.registry import register
from notelake.sources import adapters as src

METHODS = ["cqt", "hps", "piptrack", "pyin", "yin"]


def _pair(spark, sf):
    return src.truth(spark, sf), src.notes(spark, sf)


def _by_method(spark, sf):
    truth = src.truth(spark, sf).withColumn("method", F.explode(F.array(*[F.lit(m) for m in METHODS])))
    return truth, src.notes(spark, sf)


def greedy_sql(key: str, pairs: str, who: str, turn: str, what: str, taste: str) -> str:
    """CTE ``picked``: rows of ``pairs`` chosen one by one in order of ``turn`` inside each ``key``."""
    return f"""
    _p AS (SELECT {key} AS _k, {who} AS _w, min({turn}) AS _t, list({what} ORDER BY {taste}, {what}) AS _cs FROM {pairs} GROUP BY ALL),
    _q AS (SELECT *, row_number() OVER (PARTITION BY _k ORDER BY _t, _w) AS _rn FROM _p),
    _r AS (SELECT _k, _rn, _w, _cs[1] AS pick, [_cs[1]] AS used FROM _q WHERE _rn = 1
           UNION ALL
           SELECT q._k, q._rn, q._w, c, CASE WHEN c IS NULL THEN r.used ELSE list_append(r.used, c) END
           FROM _r r JOIN _q q ON q._k = r._k AND q._rn = r._rn + 1,
                LATERAL (SELECT list_filter(q._cs, lambda x: NOT list_contains(r.used, x))[1] AS c)),
    picked AS (SELECT p.* FROM _r JOIN {pairs} p ON {key} = _k AND {who} = _w AND {what} = pick)"""


def pairs_sql(key: str, truth: str, det: str, iou: float) -> str:
    overlap = "least(t.start_us + t.dur_us, d.start_us + d.dur_us) - greatest(t.start_us, d.start_us)"
    union = "greatest(t.start_us + t.dur_us, d.start_us + d.dur_us) - least(t.start_us, d.start_us)"
    cut = f"AND greatest(0, {overlap}) >= {iou} * ({union})" if iou else ""
    return f"""pairs AS (SELECT t.*, d.note_id, d.start_us AS d_start, d.start_us - t.start_us AS onset_error_us,
                  d.start_us + d.dur_us - t.start_us - t.dur_us AS offset_error_us, abs(d.start_us - t.start_us) AS score
           FROM {truth} t JOIN {det} d ON {key} AND t.midi = d.midi AND abs(d.start_us - t.start_us) <= 50000 {cut})"""


MATCH_SQL = pairs_sql("t.track_id = d.track_id", "truth", "notes", 0.3) + "," + greedy_sql(
    "track_id", "pairs", "truth_id", "start_us", "note_id", "score, d_start")

register(
    "match_truth", lambda spark, sf: mt.match_truth(*_pair(spark, sf)),
    "track_id midi truth_id note_id onset_error_us offset_error_us", "truth",
    MATCH_SQL + ", result AS (SELECT * FROM picked)", recursive=True,
)
register(
    "match_truth_by_detection", lambda spark, sf: mt.match_truth_by_detection(*_pair(spark, sf)),
    "track_id note_id truth_id cents_error time_error_us", "truth",
    """pairs AS (SELECT d.track_id, d.note_id, t.truth_id, t.start_us AS t_start, d.start_us AS start_us, (d.midi - t.midi) * 100 AS cents_error,
              d.start_us - t.start_us AS time_error_us, abs(d.start_us - t.start_us) AS score
       FROM notes d JOIN truth t ON t.track_id = d.track_id AND abs(d.start_us - t.start_us) <= 100000 AND abs(d.midi - t.midi) <= 2),"""
    + greedy_sql("track_id", "pairs", "note_id", "start_us", "truth_id", "score, t_start") + ", result AS (SELECT * FROM picked)",
    recursive=True,
)


def _unmatched(spark, sf):
    truth, det = _pair(spark, sf)
    got = mt.match_truth(truth, det)
    miss = mt.unmatched(truth, got, ["track_id", "truth_id"]).select("track_id", F.lit("missed").alias("side"), F.col("truth_id").alias("id"))
    extra = mt.unmatched(det, got, ["track_id", "note_id"]).select("track_id", F.lit("extra").alias("side"), F.col("note_id").alias("id"))
    return miss.unionByName(extra)


register(
    "unmatched", _unmatched, "track_id side$ id", "truth",
    MATCH_SQL + """, result AS (
        SELECT track_id, 'missed' AS side, truth_id AS id FROM truth WHERE truth_id NOT IN (SELECT truth_id FROM picked)
        UNION ALL SELECT track_id, 'extra', note_id FROM notes WHERE note_id NOT IN (SELECT note_id FROM picked))""", recursive=True,
)


def _results(spark, sf):
    truth, det = _by_method(spark, sf)
    keys = ["track_id", "method"]
    return mt.note_metrics(truth, det, mt.match_truth(truth, det, keys=keys), keys)


RESULTS_SQL = f"""_tm AS (SELECT truth.*, m.method FROM truth, (SELECT unnest({METHODS}) AS method) m),""" + pairs_sql(
    "t.track_id = d.track_id AND t.method = d.method", "_tm", "notes", 0.3).replace("AS score", "AS score, (t.track_id, t.method) AS tk") + "," + greedy_sql(
    "tk", "pairs", "truth_id", "start_us", "note_id", "score, d_start") + """,
    _a AS (SELECT track_id, method, count(*) AS n_truth FROM _tm GROUP BY ALL),
    _b AS (SELECT track_id, method, count(*) AS n_det FROM notes GROUP BY ALL),
    _h AS (SELECT track_id, method, count(*) AS tp, avg(abs(onset_error_us) / 1000.0) AS mo, stddev_pop(abs(onset_error_us) / 1000.0) AS so,
                  avg(abs(offset_error_us) / 1000.0) AS mf FROM picked GROUP BY ALL),
    _m AS (SELECT track_id, method, coalesce(n_truth, 0) AS n_truth, coalesce(n_det, 0) AS n_det, coalesce(tp, 0) AS tp, coalesce(mo, 0) AS mean_onset_ms,
                  coalesce(so, 0) AS std_onset_ms, coalesce(mf, 0) AS mean_offset_ms
           FROM _a FULL JOIN _b USING (track_id, method) LEFT JOIN _h USING (track_id, method)),
    _s AS (SELECT *, n_det - tp AS fp, n_truth - tp AS fn, CASE WHEN n_det > 0 THEN tp / n_det ELSE 0 END AS p,
                  CASE WHEN n_truth > 0 THEN tp / n_truth ELSE 0 END AS r FROM _m),
    results AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM _s)"""
register(
    "note_metrics", _results,
    "track_id method$ n_truth n_det tp fp fn p~ r~ f1~ mean_onset_ms~ std_onset_ms~ mean_offset_ms~", "truth",
    RESULTS_SQL + ", result AS (SELECT * FROM results)", recursive=True,
)
register(
    "leaderboard", lambda spark, sf: mt.leaderboard(_results(spark, sf)),
    "method$ n_cases mean_p~ std_p~ mean_r~ std_r~ mean_f1~ std_f1~ overall_p~ overall_r~ mean_onset_ms~ tp fp fn", "truth",
    RESULTS_SQL + """, result AS (SELECT method, count(*) AS n_cases, avg(p) AS mean_p, stddev_pop(p) AS std_p, avg(r) AS mean_r, stddev_pop(r) AS std_r,
        avg(f1) AS mean_f1, stddev_pop(f1) AS std_f1, sum(tp) / sum(tp + fp) AS overall_p, sum(tp) / sum(tp + fn) AS overall_r,
        coalesce(avg(mean_onset_ms) FILTER (mean_onset_ms > 0), 0) AS mean_onset_ms, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn
        FROM results GROUP BY ALL)""", recursive=True,
)
_CATEGORY = "['single', 'pure', 'seq', 'chord', 'edge'][track_id % 5 + 1]"
register(
    "leaderboard_by_category",
    lambda spark, sf: mt.leaderboard_by_category(_results(spark, sf).withColumn("category", F.expr(
        "element_at(array('single', 'pure', 'seq', 'chord', 'edge'), cast(track_id % 5 + 1 as int))"))),
    "category$ method$ level n mean_f1~ best_method$", "truth",
    RESULTS_SQL + f""", _c AS (SELECT *, {_CATEGORY} AS category FROM results),
      _k AS (SELECT category, method, avg(f1) AS mean_f1, count(*) AS n, grouping_id(category, method) AS level FROM _c GROUP BY ROLLUP (category, method)),
      _z AS (SELECT category, method AS best_method FROM _k WHERE level = 0
             QUALIFY row_number() OVER (PARTITION BY category ORDER BY mean_f1 DESC, method) = 1),
      result AS (SELECT * FROM _k LEFT JOIN _z USING (category))""", recursive=True,
)
register(
    "sweep_best", lambda spark, sf: mt.sweep_best(*_pair(spark, sf), [0.2, 0.3, 0.4, 0.5]),
    "method$ cut~ n_truth n_det tp f1~ is_best!", "truth",
    f"""_cut AS (SELECT unnest([0.2, 0.3, 0.4, 0.5])::DOUBLE AS cut),
    _tm AS (SELECT truth.*, m.method, cut FROM truth, (SELECT unnest({METHODS}) AS method) m, _cut),
    _dm AS (SELECT notes.*, cut FROM notes, _cut WHERE cut <= confidence),""" + pairs_sql(
        "t.track_id = d.track_id AND t.method = d.method AND t.cut = d.cut", "_tm", "_dm", 0).replace(
        "AS score", "AS score, (t.track_id, t.method, t.cut) AS tk") + "," + greedy_sql(
        "tk", "pairs", "truth_id", "start_us", "note_id", "score, d_start") + """,
    _f AS (SELECT method, cut, n_truth, coalesce(n_det, 0) AS n_det, coalesce(tp, 0) AS tp FROM (SELECT method, cut, count(*) AS n_truth FROM _tm GROUP BY ALL)
           LEFT JOIN (SELECT method, cut, count(*) AS n_det FROM _dm GROUP BY ALL) USING (method, cut)
           LEFT JOIN (SELECT method, cut, count(*) AS tp FROM picked GROUP BY ALL) USING (method, cut)),
    _g AS (SELECT *, CASE WHEN tp > 0 THEN 2 * tp / (n_det + n_truth) ELSE 0 END AS f1 FROM _f),
    result AS (SELECT *, row_number() OVER (ORDER BY f1 DESC, method, cut) = 1 AS is_best FROM _g)""", recursive=True,
)
