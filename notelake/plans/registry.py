"""Registry of the checked queries: a DataFrame plan and, where one can be written, its SQL twin.

Output columns are declared once for both sides: ``name`` is a bigint, ``name~`` a double rounded to 6 places
(after adding 1.37e-9, so that means ending in an exact half round alike in both engines),
``name$`` a string and ``name!`` a boolean.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.sources.adapters import with_tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def _column(spec: str) -> Column:
    name, mark = (spec[:-1], spec[-1]) if spec[-1] in "~$!" else (spec, "")
    c = F.col(name)
    if mark == "~":
        return (F.round(c.cast("double") + F.lit(1.37e-9), 6) + F.lit(0.0)).alias(name)
    return c.cast({"$": "string", "!": "boolean", "": "bigint"}[mark]).alias(name)


def _sql_column(spec: str) -> str:
    name, mark = (spec[:-1], spec[-1]) if spec[-1] in "~$!" else (spec, "")
    if mark == "~":
        return f"round(CAST({name} AS DOUBLE) + 1.37e-9, 6) + 0.0 AS {name}"
    return f"CAST({name} AS {dict([('$', 'VARCHAR'), ('!', 'BOOLEAN'), ('', 'BIGINT')])[mark]}) AS {name}"


def register(
    name: str, plan: Query, columns: str, tables: str = "", sql: str | None = None, recursive: bool = False
) -> None:
    """``sql`` is a list of CTEs (no WITH), the last one named ``result``; ``tables`` are adapter tables it uses."""
    if name in QUERIES:
        raise ValueError(f"query {name} registered twice")
    specs = columns.split()
    QUERIES[name] = lambda spark, sf_dir: plan(spark, sf_dir).select(*[_column(s) for s in specs])
    if sql is not None:
        head = with_tables(*tables.split(), recursive=recursive) if tables else ("WITH RECURSIVE" if recursive else "WITH")
        glue = ",\n" if tables else " "
        ORACLE[name] = f"{head}{glue}{sql.strip()}\nSELECT {', '.join(_sql_column(s) for s in specs)} FROM result"


def anchored_sql(source: str, tol: int, t: str = "t_us", id: str = "cand_id", strict: bool = False, key: str = "track_id") -> str:
    """CTE ``grouped``: rows of ``source`` with ``anchor_t``, walking each track row by row."""
    op = ">=" if strict else ">"
    return f"""
    _o AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {t}, {id}) AS _rn FROM {source}),
    _g AS (SELECT {key} AS _k, _rn, {t} AS anchor_t FROM _o WHERE _rn = 1
           UNION ALL
           SELECT _g._k, _o._rn, CASE WHEN _o.{t} - _g.anchor_t {op} {tol} THEN _o.{t} ELSE _g.anchor_t END
           FROM _g JOIN _o ON _o.{key} = _g._k AND _o._rn = _g._rn + 1),
    grouped AS (SELECT _o.*, _g.anchor_t FROM _o JOIN _g ON _o.{key} = _g._k AND _o._rn = _g._rn)"""
