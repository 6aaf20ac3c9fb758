"""Note-shaped tables derived from the generic test tables, and the same definitions as SQL text for checking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.operators.timeline import row_index
from notelake.session import checkpointed

EPOCH_US = 1_704_067_200_000_000  # 2024-01-01 UTC
DAY_US = 86_400_000_000
METHODS = {"click": "pyin", "view": "cqt", "error": "hps", "signup": "yin", "purchase": "piptrack"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _method() -> str:
    return "case event_type " + " ".join(f"when '{k}' then '{v}'" for k, v in METHODS.items()) + " end"


def _timed(events: DataFrame) -> DataFrame:
    return events.withColumn("e_us", F.expr(f"unix_micros(cast(ts as timestamp)) - {EPOCH_US}"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _timed(table(spark, sf_dir, "events"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates_of(table(spark, sf_dir, "events"))


def candidates_of(events: DataFrame) -> DataFrame:
    """Candidates from events, a table or a stream."""
    return _timed(events).selectExpr(
        "user_id as track_id", "event_id as cand_id", "e_us div 4320000 as t_us",
        "cast(52 + floor(value) % 3 as int) as midi", "cast(get_json_object(props, '$.k') as int) as k",
        "cast((1 + event_id % 100) / 100 as double) as confidence", f"{_method()} as method",
    ).withColumn(
        "frequency", F.expr("440D * pow(2D, (midi - 69) / 12D + ((k % 61) - 30) / 1200D)")
    ).drop("k")


def notes(spark: SparkSession, sf_dir: str, squeeze: int = 432000) -> DataFrame:
    return _events(spark, sf_dir).selectExpr(
        "user_id as track_id", "event_id as note_id", f"e_us div {squeeze} as start_us",
        "10000 + (event_id * 7919) % 190000 as dur_us", "cast(40 + floor(value) % 49 as int) as midi",
        "cast((1 + event_id % 100) / 100 as double) as confidence", f"{_method()} as method",
    )


def notes_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes(spark, sf_dir, 4320000)


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes(spark, sf_dir).filter("note_id % 4 <> 0").selectExpr(
        "track_id", "note_id as truth_id",
        "greatest(start_us + ((note_id % 41) - 20) * 3000, 0) as start_us", "dur_us",
        "cast(midi + if(note_id % 7 = 0, 1, 0) as int) as midi",
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checkpointed(_frames(spark, sf_dir))


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).selectExpr(
        "user_id as track_id", "event_id", "e_us", "value",
        "cast((1 + event_id % 100) / 100 as double) as confidence", f"{_method()} as method",
    )
    rows = row_index(rows, ["e_us", "event_id"], width=2 * DAY_US, name="frame")
    return rows.withColumn("is_voiced", F.expr("event_id % 17 <> 0")).selectExpr(
        "track_id", "frame", "frame * 23220 as t_us", "event_id", "is_voiced", "confidence", "method",
        "cast(if(is_voiced, 55 + ((frame div 5) * 7 + track_id) % 12 + if(event_id % 23 = 0, 12, 0), 0) as int) as midi",
    )


def onset_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The onsets that go with ``frames``: one event in six."""
    return frames(spark, sf_dir).filter("event_id % 6 = 0")


def onset_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The onsets that go with ``samples``: every fiftieth place."""
    return samples(spark, sf_dir).filter("idx % 50 = 0").select("track_id", "idx")


def _spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").selectExpr("cast(label as bigint) as track_id", "vec_id", "embedding")
    return checkpointed(row_index(vectors, ["vec_id"], width=4096, name="frame"))


def bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spectrum(spark, sf_dir).selectExpr("track_id", "frame", "posexplode(embedding) as (bin, v)").selectExpr(
        "track_id", "frame", "bin", "cast(175 * bin as double) as hz", "abs(cast(v as double)) as mag"
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spectrum(spark, sf_dir).selectExpr("track_id", "frame", "posexplode(embedding) as (bin, v)").selectExpr(
        "track_id", "frame * 64 + bin as idx", "cast(v as double) as x"
    )


def notes_big(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr(
        "l_partkey as track_id", "(datediff(l_shipdate, date'1970-01-01') % 500) * 500000L as start_us",
        "cast(10000 + l_quantity * 4000 as bigint) as dur_us", "cast(40 + floor(l_extendedprice) % 49 as int) as midi",
        "l_orderkey", "l_linenumber", "l_extendedprice",
    )
    order = ["start_us", "l_orderkey", "l_linenumber", "l_extendedprice"]
    return checkpointed(row_index(rows, order, name="note_id").select("track_id", "note_id", "start_us", "dur_us", "midi"))


# ---------------------------------------------------------------------------------------------------------------
# The same tables as SQL, to be put after WITH.
_E = f"(epoch_us(ts) - {EPOCH_US})"
_CONF = "cast((1 + event_id % 100) / 100 as double)"
SQL = {
    "candidates": f"""candidates AS (
      SELECT user_id AS track_id, event_id AS cand_id, {_E} // 4320000 AS t_us, m AS midi, {_CONF} AS confidence,
             {_method()} AS method, 440.0 * pow(2.0, (m - 69) / 12.0 + ((k % 61) - 30) / 1200.0) AS frequency
      FROM (SELECT *, cast(52 + floor(value)::BIGINT % 3 AS INTEGER) AS m,
                   cast(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))""",
    "notes": f"""notes AS (
      SELECT user_id AS track_id, event_id AS note_id, {_E} // 432000 AS start_us,
             10000 + (event_id * 7919) % 190000 AS dur_us, cast(40 + floor(value)::BIGINT % 49 AS INTEGER) AS midi,
             {_CONF} AS confidence, {_method()} AS method FROM events)""",
    "notes_dense": f"""notes_dense AS (
      SELECT user_id AS track_id, event_id AS note_id, {_E} // 4320000 AS start_us,
             10000 + (event_id * 7919) % 190000 AS dur_us, cast(40 + floor(value)::BIGINT % 49 AS INTEGER) AS midi,
             {_CONF} AS confidence, {_method()} AS method FROM events)""",
    "truth": """truth AS (
      SELECT track_id, note_id AS truth_id, greatest(start_us + ((note_id % 41) - 20) * 3000, 0) AS start_us, dur_us,
             midi + CASE WHEN note_id % 7 = 0 THEN 1 ELSE 0 END AS midi FROM notes WHERE note_id % 4 <> 0)""",
    "frames": f"""frames AS (
      SELECT track_id, frame, frame * 23220 AS t_us, event_id, is_voiced, confidence, method,
             CASE WHEN is_voiced THEN 55 + ((frame // 5) * 7 + track_id) % 12
                  + CASE WHEN event_id % 23 = 0 THEN 12 ELSE 0 END ELSE 0 END AS midi
      FROM (SELECT user_id AS track_id, event_id, event_id % 17 <> 0 AS is_voiced, {_CONF} AS confidence,
                   {_method()} AS method,
                   row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame FROM events))""",
    "bins": """bins AS (
      SELECT track_id, frame, i - 1 AS bin, cast(175 * (i - 1) AS DOUBLE) AS hz, abs(cast(embedding[i] AS DOUBLE)) AS mag
      FROM (SELECT cast(label AS BIGINT) AS track_id, embedding,
                   row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame FROM embeddings),
           range(1, 65) r(i))""",
    "samples": """samples AS (
      SELECT track_id, frame * 64 + i - 1 AS idx, cast(embedding[i] AS DOUBLE) AS x
      FROM (SELECT cast(label AS BIGINT) AS track_id, embedding,
                   row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame FROM embeddings),
           range(1, 65) r(i))""",
}


def with_tables(*names: str, recursive: bool = False) -> str:
    """``WITH`` clause defining the named tables (``truth`` needs ``notes`` before it)."""
    wanted = [n for n in SQL if n in names or (n == "notes" and "truth" in names)]
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(SQL[n] for n in wanted)
