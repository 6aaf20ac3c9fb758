"""The corpus pipeline: language ID, exact dedup, near-duplicate removal, mixing and packing of ``documents``.

Each stage takes what the stage before it kept, written as Parquet and read again. All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from public_tokenizers import path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.llm import exact_dedup, langid, mixing, near_dedup, packing
from notelake.llm.common import stored


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, and those in which no language reaches a score of 0.4, go."""
    return langid.identified(docs, 0.4)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of identical texts stays."""
    return exact_dedup.distinct_documents(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles with a similarity of 0.8 or more stays."""
    return near_dedup.distinct_documents(docs, 5, 80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for, none to two times."""
    return mixing.mixed_documents(docs, weights=(3, 1, 2), share=1.5, most=2.0)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the packed sequences; a document that was mixed in twice is packed twice."""
    pieces = packing.tokenized_pieces(docs, path("byte_bpe_50k.json"), 1024, 2)
    return packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), 1024)


STAGES = [("language ID", language), ("exact dedup", exact), ("near-duplicates", near), ("mixing", mix), ("packing", pack)]
#: Language ID by a trained model and the mix by balanced sampling can't be stated in SQL; tests hold the stages against plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = stored(docs)
    return docs
