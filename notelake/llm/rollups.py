"""Token totals by source, language and tokenizer version, maintained from deltas.

The table of totals is additive: a batch of changes is turned into signed rows (a deleted or replaced count leaves with -1, an
inserted or replacing one enters with +1), summed per key, and appended as one small delta. The totals are the sum of all
committed deltas, so no earlier row is ever rewritten and a document that moves between sources leaves one and enters the other.

A batch is committed under its id by Spark's own write, which publishes the folder ``batch=<id>`` with a success marker at the
end. A batch whose marker exists is not applied again; one that broke off has no marker and is written anew. ``compact`` folds
the committed deltas into one, remembers their ids and publishes the fold in the same way.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notelake.llm.common import small_batches
from notelake.llm.packing import Encoder

KEYS = ["source", "lang", "version"]
IMAGE = "source string, lang string, version string, tokens long"
TOTALS = "source string, lang string, version string, docs long, tokens long"


def with_counts(rows: DataFrame, wanted: dict[str, tuple[str, str]]) -> DataFrame:
    """``rows`` without the counted text columns and with one long column per entry: name to (text column, path of the vocabulary).

    Several texts of one row, or one text under several vocabularies, are counted in one pass, so that a change's images before
    and after it come from the same row and no join by id is needed. A null text has a null count, an empty one 0. Very long texts
    are counted whole, repeated rows each for itself, an empty table gives an empty result, columns named like a count are replaced.
    """
    small_batches(rows.sparkSession)
    texts = list(dict.fromkeys(text for text, _ in wanted.values()))
    others = [c for c in rows.columns if c not in texts and c not in wanted]
    paths = list(dict.fromkeys(path for _, path in wanted.values()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = {path: Encoder(path) for path in paths}
        for batch in batches:
            columns = {text: batch.column(len(others) + i).to_pylist() for i, text in enumerate(texts)}
            counts = [pa.array([None if t is None else len(encoders[path](t)) if t else 0 for t in columns[text]], pa.int64())
                      for text, path in wanted.values()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(others)], *counts], names=[*others, *wanted])

    schema = T.StructType([*[rows.schema[c] for c in others], *[T.StructField(name, T.LongType()) for name in wanted]])
    return rows.select(*others, *[F.col(t).cast("string").alias(t) for t in texts]).mapInArrow(count, schema)


def token_counts(docs: DataFrame, versions: dict[str, str], text: str = "text") -> DataFrame:
    """``docs`` with ``version`` and ``tokens``, one row for each tokenizer version (name to the path of its vocabulary).

    Null and empty texts have no tokens. Very long texts are counted whole and repeated rows each for itself. Columns named version
    or tokens are replaced. An empty table gives an empty result.
    """
    names = [f"_count_{i}" for i in range(len(versions))]
    held = docs.drop("version", "tokens")
    counted = with_counts(held, {n: (text, path) for n, path in zip(names, versions.values(), strict=True)})
    others = [c for c in held.columns if c != text]
    each = F.array(*[F.struct(F.lit(v).alias("version"), F.coalesce(n, F.lit(0)).alias("tokens")) for v, n in zip(versions, names, strict=True)])
    return counted.select(*others, F.explode(each).alias("_c")).select(*others, F.col("_c.version").alias("version"), F.col("_c.tokens").alias("tokens"))


def image(source: str = "source", lang: str = "lang", version: str = "version", tokens: str = "tokens") -> Column:
    """The struct that a change holds of a document before or after it."""
    return F.struct(F.col(source).alias("source"), F.col(lang).alias("lang"), F.col(version).alias("version"), F.col(tokens).alias("tokens"))


def inserts(counted: DataFrame) -> DataFrame:
    """Changes that add every row of ``counted`` (source, lang, version, tokens); further columns are ignored, repeated rows count each."""
    return counted.select(F.lit(None).cast(f"struct<{IMAGE.replace(' ', ':').replace(',:', ',')}>").alias("before"), image().alias("after"))


def deletes(counted: DataFrame) -> DataFrame:
    """Changes that take every row of ``counted`` out; the rows must have been added before, else totals fall below zero."""
    return counted.select(image().alias("before"), F.lit(None).cast(f"struct<{IMAGE.replace(' ', ':').replace(',:', ',')}>").alias("after"))


def delta(changes: DataFrame) -> DataFrame:
    """Signed sums per key of changes with ``before`` and ``after`` images; a null image is an insert or a delete.

    Null sources, languages and versions are keys like any other, null token counts are 0. Sums of zero are left out.
    """
    side = lambda name, sign: changes.filter(F.col(name).isNotNull()).select(
        *[F.col(f"{name}.{k}") for k in KEYS], F.lit(sign).cast("long").alias("docs"), (F.coalesce(F.col(f"{name}.tokens"), F.lit(0)) * sign).alias("tokens"))
    signed = side("after", 1).unionByName(side("before", -1))
    return signed.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).filter("docs != 0 or tokens != 0")


class Rollup:
    """Totals below ``folder``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _committed(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{self.folder}/{name}/_SUCCESS"))

    def _folders(self, prefix: str) -> list[str]:
        if not self._fs.exists(self._path(self.folder)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.folder))]
        return sorted(n for n in names if n.startswith(prefix) and self._committed(n))

    def batches(self) -> list[str]:
        """Ids of the batches that count, those folded by ``compact`` included."""
        return sorted({*self._folded(), *(n.removeprefix("batch=") for n in self._folders("batch="))})

    def _fold(self) -> str | None:
        return max(self._folders("fold="), key=lambda n: int(n.removeprefix("fold=")), default=None)

    def _folded(self) -> set[str]:
        fold = self._fold()
        return {r[0] for r in self.spark.read.parquet(f"{self.folder}/{fold}/ids").collect()} if fold else set()

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Apply a batch once; False if its id has been applied before.

        One writer at a time: two sessions that commit the same id at once could both write it. An empty batch counts as applied.
        """
        if not re.fullmatch(r"[A-Za-z0-9_-]+", batch_id):
            raise ValueError("a batch id holds letters, digits, - and _")
        if self._committed(f"batch={batch_id}") or batch_id in self._folded():
            return False
        delta(changes).write.mode("overwrite").parquet(f"{self.folder}/batch={batch_id}")
        return True

    def _open(self) -> list[str]:
        folded = self._folded()
        return [n for n in self._folders("batch=") if n.removeprefix("batch=") not in folded]

    def totals(self) -> DataFrame:
        """source, lang, version, docs and tokens over all committed batches; keys without documents are left out."""
        fold = self._fold()
        paths = [f"{self.folder}/{n}" for n in self._open()] + ([f"{self.folder}/{fold}/totals"] if fold else [])
        if not paths:
            return self.spark.createDataFrame([], TOTALS)
        deltas = self.spark.read.schema(TOTALS).parquet(*paths)
        sums = deltas.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.filter("docs != 0 or tokens != 0")

    def compact(self) -> None:
        """Fold all committed deltas into one; the marker of the new fold is written last, so a broken fold does not count."""
        number = int((self._fold() or "fold=0").removeprefix("fold=")) + 1
        target, ids = f"{self.folder}/fold={number}", self.batches()
        self.totals().write.mode("overwrite").parquet(f"{target}/totals")
        self.spark.createDataFrame([(i,) for i in ids], "id string").write.mode("overwrite").parquet(f"{target}/ids")
        self._fs.create(self._path(f"{target}/_SUCCESS")).close()
