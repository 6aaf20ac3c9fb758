"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.session import checkpoint_dir

HOT_SHARE = 1000
#: Words and white space of the shingle and size contracts: ASCII white space only.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


_WRITTEN: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared checkpoint folder, deleted like those of ``stored``."""
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared checkpoint folder and read back.

    This cuts the lineage like a checkpoint, but later plans know the real size and read only the columns they need, which
    matters for tables that rounds of joins are built on. The folders are deleted when the program ends, or by ``drop_stored``.
    """
    spark = df.sparkSession
    path = scratch(spark, "stored")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored() -> None:
    """Delete what ``stored`` has written so far; results that still read it must have been used."""
    while _WRITTEN:
        spark, path = _WRITTEN.pop()
        try:
            jvm = spark._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        except (Py4JError, OSError, AttributeError):
            return  # the session has ended before


atexit.register(drop_stored)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the rows of an Arrow batch of this session, so that batches of long texts stay small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def hot_groups(groups: DataFrame, size: str, total: int) -> DataFrame:
    """Groups that hold at least one row in HOT_SHARE of ``total``: at most HOT_SHARE of them, so they may be broadcast."""
    return groups.filter(F.col(size) * HOT_SHARE >= max(total, 1))


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Left join of rows to one row per group, where one group may hold a third of the rows.

    Hot groups are met by a broadcast of proven size, their rows are not shuffled. The others meet by a shuffle on ``key``.
    ``groups`` should be stored, it is read twice; ``rows`` is evaluated for each of the two ways.
    """
    values = [c for c in groups.columns if c != key]
    hot = hot_groups(groups, size, total)
    marked = rows.join(F.broadcast(hot.select(key, F.struct(*values).alias("_hot"))), key, "left")
    near = marked.filter(F.col("_hot").isNotNull()).select(*rows.columns, *[F.col(f"_hot.{v}").alias(v) for v in values])
    cold = groups.filter(F.col(size) * HOT_SHARE < max(total, 1))
    far = marked.filter(F.col("_hot").isNull()).select(*rows.columns).join(cold, key, "left")
    return near.unionByName(far.select(*rows.columns, *values))


def fields(struct: str, schema_names: Sequence[str], but: Sequence[str] = ()) -> list[Column]:
    """The columns carried inside ``struct``, without those that a result column of the same name replaces."""
    return [F.col(f"{struct}.`{n}`").alias(n) for n in schema_names if n not in but]
