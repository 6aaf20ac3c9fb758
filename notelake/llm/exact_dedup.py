"""Exact deduplication by two passes of Bloom filtering, with DataFrame functions only.

Pass 1 gives each text ``HASHES`` bit positions and counts how many rows hit each position; positions hit at least twice form
the filter, a bitmap in blocks of 4 KB. Pass 2 looks every row up in the broadcast filter. A row with a position that nobody
else has is certainly unique and passes straight through, without a shuffle. Only the remaining rows are grouped by digest.
The filter never decides alone: a row that it flags wrongly forms a group of one.

The filter takes ``BITS_PER_ROW`` bits a row, at least 2^16 and at most ``max_bits`` (2^27, 16 MB). Beyond that size it flags
more unique rows, whose digests (not texts) are then shuffled as well; the result does not change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from notelake.llm.common import HOT_SHARE, fields, hot_groups, text_or_empty
from notelake.session import checkpointed

HASHES = 2
BITS_PER_ROW = 16
BLOCK = 32_768  # bits of a bitmap block of the built-in bitmap functions


def filter_bits(rows: int, max_bits: int = 1 << 27) -> int:
    bits = 1 << 16
    while bits < BITS_PER_ROW * rows and bits < max_bits:
        bits *= 2
    return bits


def _position(digest: str, k: int, bits: int) -> Column:
    return F.xxhash64(F.col(digest), F.lit(k)).bitwiseAND(F.lit(bits - 1)) + 1  # built-in blocks start at position 1


def repeated_positions(digests: DataFrame, bits: int) -> DataFrame:
    """Pass 1: the blocks (block, bitmap) of positions that at least two rows hit; at most ``bits / 8`` bytes in all."""
    hits = digests.select(F.explode(F.array(*[_position("digest", k, bits) for k in range(HASHES)])).alias("position"))
    return _blocks(hits.groupBy("position").count().filter("count > 1"))


def positions_of(digests: DataFrame, bits: int) -> DataFrame:
    """The blocks of an ordinary Bloom filter that holds all ``digest`` values; the same bound on its size."""
    return _blocks(digests.select(F.explode(F.array(*[_position("digest", k, bits) for k in range(HASHES)])).alias("position")))


def _blocks(positions: DataFrame) -> DataFrame:
    return positions.groupBy(F.bitmap_bucket_number("position").alias("block")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("position")).alias("bitmap")
    )


def _is_set(bitmap: str, position: Column) -> Column:
    at = F.bitmap_bit_position(position)
    byte = F.conv(F.hex(F.substring(F.col(bitmap), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))


def flagged(rows: DataFrame, blocks: DataFrame, bits: int) -> DataFrame:
    """Pass 2: adds ``maybe``, false for rows whose digest certainly occurs once."""
    small = F.broadcast(blocks)
    for k in range(HASHES):
        small_k = small.select(F.col("block").alias(f"_block{k}"), F.col("bitmap").alias(f"_bitmap{k}"))
        rows = rows.withColumn(f"_block{k}", F.bitmap_bucket_number(_position("digest", k, bits)))
        rows = rows.join(F.broadcast(small_k), f"_block{k}", "left")
    hit = [_is_set(f"_bitmap{k}", _position("digest", k, bits)) for k in range(HASHES)]
    maybe = hit[0]
    for h in hit[1:]:
        maybe = maybe & h
    return rows.withColumn("maybe", maybe).drop(*[f"_{n}{k}" for k in range(HASHES) for n in ("block", "bitmap")])


def annotate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", max_bits: int = 1 << 27, carry: bool = True) -> DataFrame:
    """All rows of ``docs`` with keep_id, group_size, kept and text_sha256.

    Of the rows with identical text (null counts as empty) the one with the largest ``doc_id`` stays; a null id is smaller than
    any other. Where that id itself occurs on several rows of the group, exactly one of these stays (which one is arbitrary).
    Empty texts form a group like any other. ``carry=False`` returns the id and the four result columns only. A column of
    ``docs`` named like a result column is replaced. An empty table gives an empty result.
    """
    names = docs.columns if carry else [doc_id]
    digest = F.sha2(text_or_empty(text), 256)
    rows = docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("row"), F.col(doc_id).alias("id"), digest.alias("digest"))
    ids = docs.select(F.col(doc_id).alias("id"), digest.alias("digest"))
    total = docs.count()
    bits = filter_bits(total, max_bits)
    blocks = checkpointed(repeated_positions(ids.select("digest"), bits))
    by_id = flagged(ids, blocks, bits).filter("maybe").groupBy("digest", "id").agg(F.count("*").alias("n"))
    groups = by_id.groupBy("digest").agg(
        F.max("id").alias("keep"), F.sum("n").alias("size"), F.max(F.struct("id", "n")).getField("n").alias("twins")
    ).filter("size > 1")
    groups = checkpointed(groups)
    own = {"keep": F.col("id"), "size": F.lit(1).cast("long"), "twins": F.lit(1).cast("long")}
    hot = hot_groups(groups, "size", total).select("digest", F.struct("keep", "size", "twins").alias("hot"))
    marked = flagged(rows, blocks, bits).join(F.broadcast(hot), "digest", "left")
    straight = marked.filter("not maybe or hot is not null").select(
        "row", "id", "digest", *[F.when(F.col("hot").isNotNull(), F.col(f"hot.{k}")).otherwise(v).alias(k) for k, v in own.items()]
    )
    cold = groups.filter(F.col("size") * HOT_SHARE < max(total, 1)).withColumn("found", F.lit(True))
    met = marked.filter("maybe and hot is null").select("row", "id", "digest").join(cold, "digest", "left")
    met = met.select("row", "id", "digest", *[F.when(F.col("found"), F.col(k)).otherwise(v).alias(k) for k, v in own.items()])
    out = straight.unionByName(met).withColumn("kept", F.col("id").eqNullSafe(F.col("keep")))
    if not groups.filter("twins > 1").isEmpty():
        one = W.partitionBy("digest").orderBy("id")
        twins = out.filter("kept and twins > 1").withColumn("kept", F.row_number().over(one) == 1)
        out = out.filter("not kept or twins <= 1").unionByName(twins)
    return out.select(
        *fields("row", names, ("keep_id", "group_size", "kept", "text_sha256")), F.col("keep").alias("keep_id"),
        F.col("size").alias("group_size"), "kept", F.col("digest").alias("text_sha256"),
    )


def distinct_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns."""
    lead = docs.select(F.struct(*[F.col(f"`{n}`") for n in docs.columns]).alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return annotate(lead).filter("kept").select(*fields("row", docs.columns))
