"""The same operators over the large note table (one row per line item)."""

from __future__ import annotations

from pyspark.sql import functions as F

from notelake.operators import difficulty as dif
from notelake.operators import joins as jn
from notelake.operators import segment as seg
from notelake.operators import theory as th
from notelake.plans.registry import anchored_sql, register
from notelake.plans.theory import key_sql
from notelake.sources import adapters as src

_NOTES = """_nb AS (SELECT l_partkey AS track_id, (date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) % 500) * 500000 AS start_us,
       CAST(10000 + l_quantity * 4000 AS BIGINT) AS dur_us, 40 + CAST(floor(l_extendedprice) AS BIGINT) % 49 AS midi, l_orderkey, l_linenumber, l_extendedprice FROM lineitem),
    nb AS (SELECT track_id, start_us, dur_us, midi, row_number() OVER (PARTITION BY track_id ORDER BY start_us, l_orderkey, l_linenumber, l_extendedprice) - 1 AS note_id FROM _nb)"""


def _big(spark, sf):
    return src.notes_big(spark, sf).withColumn("confidence", F.lit(0.5))


register(
    "big_merge_same_pitch", lambda spark, sf: seg.merge_same_pitch(_big(spark, sf), 2_000_000), "track_id midi start_us note_id end_us n", "",
    _NOTES + """, _f AS (SELECT *, start_us + dur_us AS end_us, max(start_us + dur_us) OVER (PARTITION BY track_id, midi ORDER BY start_us, note_id
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM nb),
    _n AS (SELECT *, sum(CASE WHEN start_us <= e + 2000000 THEN 0 ELSE 1 END) OVER (PARTITION BY track_id, midi ORDER BY start_us, note_id) AS g FROM _f),
    result AS (SELECT track_id, midi, min(start_us) AS start_us, arg_min(note_id, (start_us, note_id)) AS note_id, max(end_us) AS end_us, count(*) AS n FROM _n GROUP BY track_id, midi, g)""",
)
register(
    "big_phrases", lambda spark, sf: seg.phrases(_big(spark, sf), 300_000, 3), "track_id first_id n start_us end_us", "",
    _NOTES + """, _f AS (SELECT *, start_us + dur_us AS end_us, coalesce(start_us - lag(start_us + dur_us) OVER w > 300000, true) AS s FROM nb
              WINDOW w AS (PARTITION BY track_id ORDER BY start_us, note_id)),
    _n AS (SELECT *, sum(CAST(s AS INT)) OVER (PARTITION BY track_id ORDER BY start_us, note_id) AS g FROM _f),
    result AS (SELECT track_id, arg_min(note_id, (start_us, note_id)) AS first_id, count(*) AS n, min(start_us) AS start_us, max(end_us) AS end_us FROM _n GROUP BY track_id, g HAVING count(*) >= 3)""",
)
register(
    "big_interval_stats", lambda spark, sf: th.interval_stats(_big(spark, sf)), "track_id n mean_interval~ std_interval~ max_interval stepwise~", "",
    _NOTES + """, _l AS (SELECT track_id, lead(midi) OVER (PARTITION BY track_id ORDER BY start_us, note_id) - midi AS d FROM nb),
    result AS (SELECT track_id, count(*) AS n, avg(abs(d)) AS mean_interval, stddev_pop(abs(d)) AS std_interval, max(abs(d)) AS max_interval, avg((abs(d) <= 2)::INT) AS stepwise
               FROM _l WHERE d IS NOT NULL GROUP BY ALL)""",
)
register(
    "big_detect_key", lambda spark, sf: th.detect_key(_big(spark, sf)), "track_id n_notes confidence~", "",
    _NOTES + "," + key_sql("nb", "dur_us") + """, _c AS (SELECT track_id, count(*) AS n_notes FROM nb GROUP BY ALL),
    result AS (SELECT track_id, n_notes, confidence FROM _key JOIN _c USING (track_id))""",
)
register(
    "big_speed", lambda spark, sf: dif.speed(_big(spark, sf)), "track_id max_nps~ avg_nps~", "",
    _NOTES + """, _g AS (SELECT track_id, start_us - lag(start_us) OVER (PARTITION BY track_id ORDER BY start_us, note_id) AS g FROM nb),
    result AS (SELECT track_id, coalesce(max(1e6 / g) FILTER (g >= 20000), 0) AS max_nps, coalesce(avg(1e6 / g) FILTER (g >= 20000), 0) AS avg_nps FROM _g GROUP BY ALL)""",
)
register(
    "big_drop_harmonics", lambda spark, sf: jn.drop_harmonics(_big(spark, sf), 500_000), "track_id note_id", "",
    _NOTES + "," + anchored_sql("nb", 500_000, "start_us", "note_id", strict=True) + """,
    result AS (SELECT track_id, note_id FROM grouped g WHERE NOT EXISTS (SELECT 1 FROM grouped o WHERE o.track_id = g.track_id AND o.anchor_t = g.anchor_t
               AND g.midi - o.midi IN (12, 19, 24, 28, 31)))""", recursive=True,
)
