"""Queries whose state runs along islands of notes."""

from __future__ import annotations

from pyspark.sql import functions as F

from notelake.functions.dims import METHOD_WEIGHTS
from notelake.operators import chained as ch
from notelake.plans.registry import register
from notelake.plans.voting import case_sql
from notelake.sources import adapters as src

register(
    "dedupe_overlaps", lambda spark, sf: ch.dedupe_overlaps(src.notes(spark, sf).withColumn("midi", F.expr("cast(60 + midi % 3 as int)")), 400_000),
    "track_id note_id start_us end_us midi confidence~", "notes",
    """_o AS (SELECT track_id, note_id, start_us AS s, start_us + dur_us AS e, 60 + midi % 3 AS m, confidence AS c, row_number() OVER (PARTITION BY track_id ORDER BY start_us, note_id) AS rn FROM notes),
    _f AS (SELECT track_id, rn, note_id AS id, s, e, m, c, false AS push, 0::BIGINT AS pid, 0::BIGINT AS ps, 0::BIGINT AS pe, 0::BIGINT AS pm, 0::DOUBLE AS pc FROM _o WHERE rn = 1
           UNION ALL
           SELECT o.track_id, o.rn, CASE WHEN k IN (1, 2) THEN f.id ELSE o.note_id END, CASE WHEN k IN (1, 2) THEN f.s ELSE o.s END,
                  CASE k WHEN 1 THEN greatest(f.e, o.e) WHEN 2 THEN f.e ELSE o.e END, CASE WHEN k IN (1, 2) THEN f.m ELSE o.m END,
                  CASE k WHEN 1 THEN greatest(f.c, o.c) WHEN 2 THEN f.c ELSE o.c END, k = 4, f.id, f.s, f.e, f.m, f.c
           FROM _f f JOIN _o o ON o.track_id = f.track_id AND o.rn = f.rn + 1,
                LATERAL (SELECT CASE WHEN least(f.e, o.e) - greatest(f.s, o.s) <= 0 THEN 4 WHEN f.m = o.m THEN 1 WHEN o.c > f.c THEN 3 ELSE 2 END AS k)),
    _z AS (SELECT track_id, max(rn) AS rn FROM _o GROUP BY ALL),
    result AS (SELECT track_id, pid AS note_id, ps AS start_us, pe AS end_us, pm AS midi, pc AS confidence FROM _f WHERE push
               UNION ALL SELECT track_id, id, s, e, m, c FROM _f JOIN _z USING (track_id, rn))""", recursive=True,
)
register(
    "consensus_notes", lambda spark, sf: ch.consensus_notes(src.notes_dense(spark, sf).withColumn("midi", F.expr("cast(60 + midi % 6 as int)")), 4_000, width=20_000),
    "track_id cluster n votes confidence~ midi start_us~ end_us~", "notes_dense",
    f"""_o AS (SELECT track_id, note_id, start_us AS s, start_us + dur_us AS e, 60 + midi % 6 AS m, confidence AS c, method, row_number() OVER (PARTITION BY track_id ORDER BY start_us, note_id) AS rn FROM notes_dense),
    _f AS (SELECT track_id, rn, note_id AS cl, [s] AS ts, [m] AS ms FROM _o WHERE rn = 1
           UNION ALL SELECT o.track_id, o.rn, CASE WHEN k THEN f.cl ELSE o.note_id END, CASE WHEN k THEN list_append(f.ts, o.s) ELSE [o.s] END, CASE WHEN k THEN list_append(f.ms, o.m) ELSE [o.m] END
           FROM _f f JOIN _o o ON o.track_id = f.track_id AND o.rn = f.rn + 1,
                LATERAL (SELECT coalesce(bool_or(o.s - f.ts[i] <= 4000 AND abs(o.m - f.ms[i]) <= 1), false) AS k FROM range(1, 100) r(i) WHERE i <= len(f.ts))),
    _w AS (SELECT o.*, cl, c * CAST({case_sql(METHOD_WEIGHTS)} AS DOUBLE) AS w FROM _o o JOIN _f USING (track_id, rn)),
    result AS (SELECT track_id, cl AS "cluster", count(*) AS n, count(DISTINCT method) AS votes, max(c) AS confidence, round_even(sum(m * w) / sum(w), 0) AS midi, sum(s * w) / sum(w) AS start_us,
               sum(e * w) / sum(w) AS end_us FROM _w GROUP BY track_id, cl HAVING count(DISTINCT method) >= 2 OR (count(*) = 1 AND max(c) > 0.8))""", recursive=True,
)
