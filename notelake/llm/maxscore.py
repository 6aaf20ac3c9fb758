"""Exact top-k search by inner product over vectors of whole numbers, with MaxScore inside shards.

A dimension of a query is a term. Within a shard a term adds at least ``min(w * high, w * low)`` and at most the greater of the two;
their difference is the term's bound. A block of queries takes the terms from the largest bounds down. The non-essential terms of a
query are the longest tail whose bounds together cannot lift a vector at the worst end everywhere to the k-th best score so far: a
vector that has nothing in any essential term cannot enter. Essential postings are traversed for the whole shard, by products of
matrices; a vector whose score so far plus the most of the terms left stays under the k-th best leaves, and only the others are probed
further. A few vectors of the shard in full give a first threshold and say after how many terms probing pays.

Shards and blocks of queries have fixed sizes and meet in cells, each a group of shards and a group of blocks. A task holds the blocks
of a cell with their k best, which rise from shard to shard, and one shard. The k best of the cells are merged per query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from notelake.llm.common import small_batches, stored

SHARD, QUERIES, BATCH, STEP = 4096, 2048, 256, 8
FEW, PROBE = 128, 1000  # vectors of a shard for the first threshold; probing a pair takes as long as so many terms in a product of matrices
GROUPS, HELD = 32, 32 << 20  # groups of shards where there are few cores; bytes of queries that a task holds
EXACT, SINGLE = 2.0**53, 2.0**24  # whole numbers up to here are exact as doubles and as single floats
SIZES = ("i1", "i2", "i4", "f8")


class Best:
    """The k best scores and ids of each query, ties to the smaller id; a score of -inf where there are fewer."""

    def __init__(self, n: int, k: int) -> None:
        self.score, self.ids = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Candidates (query, score, id) take their places."""
        last = self.score[query, -1]
        better = (score > last) | ((score == last) & (ids < self.ids[query, -1]))
        query, score, ids = query[better], score[better], ids[better]
        if not len(query):
            return
        k = self.score.shape[1]
        met = np.unique(query)
        query, score, ids = (np.concatenate(x) for x in (
            (query, np.repeat(met, k)), (score, self.score[met].ravel()), (ids, self.ids[met].ravel())))
        order = np.lexsort((ids, -score, query))
        first = order[np.searchsorted(query[order], met)[:, None] + np.arange(k)]
        self.score[met], self.ids[met] = score[first], ids[first]


def meet(ids: np.ndarray, shard: np.ndarray, query_ids: np.ndarray | None, queries: np.ndarray, best: Best) -> None:
    """The vectors of a shard take their places among the best of a block of queries; those with a query's own id take no part in it."""
    k, width = best.score.shape[1], shard.shape[1]
    shard, queries = shard.astype(np.float64), queries.astype(np.float64)
    high, low = shard.max(axis=0), shard.min(axis=0)
    terms = np.argsort(-(np.abs(queries) * (high - low)).sum(axis=0), kind="stable")
    shard, queries, high, low = shard[:, terms], queries[:, terms], high[terms], low[terms]
    none = np.zeros((len(queries), 1))
    least = np.hstack([none, np.cumsum(np.minimum(queries * high, queries * low), axis=1)])  # least[:, i]: of the terms before i
    left = np.hstack([np.cumsum(np.maximum(queries * high, queries * low)[:, ::-1], axis=1)[:, ::-1], none])  # left[:, i]: the most of the terms from i on
    if math.sqrt((shard * shard).sum(axis=1).max() * (queries * queries).sum(axis=1).max()) < SINGLE:  # no sum of products is larger
        shard, queries = shard.astype(np.float32), queries.astype(np.float32)
    few = slice(None, None, max(1, len(ids) // FEW))
    for a in range(0, len(queries), BATCH):
        part = slice(a, a + BATCH)
        asked, most = queries[part].T, left[part]
        # the k-th best of a few vectors is a first threshold; full scores of vectors of the shard can only raise it
        threshold = best.score[part, -1]
        score = (shard[few] @ asked).astype(np.float64)
        if query_ids is not None:
            score[ids[few][:, None] == query_ids[part]] = -np.inf
        if len(score) >= k:
            threshold = np.maximum(threshold, np.partition(score, -k, axis=0)[-k])
        essential = min(int((least[part] + most >= threshold[:, None]).sum(axis=1).max()), width)
        for border in range(max(1, essential), width, STEP):
            if (shard[few, :border] @ asked[:border] >= threshold - most[:, border]).mean() * PROBE <= width - border:
                break
        else:
            border = width
        score = shard[:, :border] @ asked[:border]

        def alive(border: int) -> np.ndarray:
            # rounding to single floats keeps the order, so it drops no vector
            return np.flatnonzero(score >= (threshold - most[:, border]).astype(score.dtype))  # noqa: B023

        pairs = alive(border)
        if border < width and len(pairs) * 4 > score.size:
            score += shard[:, border:] @ asked[border:]
            border = width
            pairs = alive(border)
        row, query = np.divmod(pairs, score.shape[1])
        if query_ids is not None:
            row, query = (x[ids[row] != query_ids[part][query]] for x in (row, query))
        total = score[row, query].astype(np.float64)
        for c in range(0, len(row) if border < width else 0, SHARD):
            some = slice(c, c + SHARD)
            total[some] += np.einsum("ij,ij->i", shard[row[some], border:], queries[a + query[some], border:])
        best.add(a + query, total, ids[row])


def top_k(ids: np.ndarray, shard: np.ndarray, query_id: int | None, query: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The k best (score, id) of a shard for one query, ties to the smaller id; rows with the query's own id take no part."""
    best = Best(1, k)
    if len(ids):
        meet(ids, shard, None if query_id is None else np.array([query_id]), query[None], best)
    return [(int(s), int(i)) for s, i in zip(best.score[0], best.ids[0], strict=True) if s > -np.inf]


def _packed(vectors: DataFrame, size: int, scale: float) -> DataFrame:
    """Blocks of about ``size`` vectors: n, width, ids and the components, row by row, little-endian and of the smallest ``kind`` that holds them."""
    schema = "n long, width long, largest double, kind string, ids binary, data binary"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def out(width: int) -> pa.RecordBatch:
            ids, rows = zip(*held.pop(width), strict=True)
            data = np.concatenate(rows) if rows else np.empty((0, width))
            keys = np.concatenate(ids)
            largest = float(np.abs(data).max(initial=0.0))
            kind = next(s for s in SIZES if s == "f8" or largest <= np.iinfo(s).max)
            return pa.RecordBatch.from_arrays(
                [pa.array([len(keys)]), pa.array([width]), pa.array([largest]), pa.array([kind]), pa.array([keys.astype("<i8").tobytes()], pa.binary()),
                 pa.array([data.astype(f"<{kind}").tobytes()], pa.binary())], names=["n", "width", "largest", "kind", "ids", "data"])

        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            if not len(ids):
                continue
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            widths = lists.value_lengths().to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.cumsum(widths)])
            keys = ids.to_numpy(zero_copy_only=False)
            for width in np.unique(widths):
                rows = np.flatnonzero(widths == width)
                data = np.floor(scale * values[(starts[rows][:, None] + np.arange(width)).ravel()]).reshape(len(rows), width)
                for a in range(0, len(rows), size):
                    block = held.setdefault(int(width), [])
                    block.append((keys[rows[a:a + size]], data[a:a + size]))
                    if sum(len(b[0]) for b in block) >= size:
                        yield out(int(width))
        for width in list(held):
            yield out(width)

    return vectors.mapInArrow(pack, schema)


def nearest(
    vectors: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0, vec_id: str = "vec_id", embedding: str = "embedding"
) -> DataFrame:
    """query_id, rank (int, from 1), vec_id and score (long) of the k best rows for each query.

    Components are ``floor(scale * x)``. Queries are the rows whose id is divisible by ``every``, candidates all rows but those
    with the query's own id. Vectors that are null or hold null or non-finite components, and rows without an id, take no part.
    A vector of another width than the query is read as if padded by zeros. Repeated rows are candidates each; a query that is
    repeated as a whole is answered once, and different vectors under one id are answered each. Empty vectors score 0.
    """
    spark = vectors.sparkSession
    small_batches(spark, SHARD)
    x = F.transform(F.col(embedding), lambda v: v.cast("double"))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), x.alias("x")).filter(
        F.col("vec_id").isNotNull() & F.col("x").isNotNull() & F.forall("x", lambda v: v.isNotNull() & (F.abs(v) < F.lit(float("inf"))) & ~F.isnan(v)))
    shards = stored(_packed(rows, SHARD, scale))
    asked = rows.filter(F.col("vec_id") % every == 0).distinct()
    n_shards, largest, widest = shards.agg(F.count("*"), F.max("largest"), F.max("width")).first()
    if n_shards and largest * largest * widest >= EXACT:
        raise ValueError("components too large for exact sums")
    blocks = stored(_packed(asked.repartition(max(1, math.ceil(asked.count() / QUERIES))), QUERIES, scale))
    size = blocks.agg(F.sum(F.length("data") + F.length("ids"))).first()[0] or 0
    # Every shard meets every block in one cell. Shards are copied once per group of blocks and blocks once per group of shards, whose
    # number does not grow with the tables, so nothing grows with their product and nothing is sent to the driver.
    groups = min(max(1, n_shards), max(GROUPS, 4 * spark.sparkContext.defaultParallelism))
    block_groups = max(1, math.ceil(size / HELD))

    def dealt(df: DataFrame, kind: int, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        place = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n_own)).cast("int")
        df = df.withColumn(own, place).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))))
        return df.select("shards", "blocks", F.lit(kind).alias("shard"), "width", "kind", "ids", "data")

    cells = dealt(blocks, 0, "blocks", block_groups, "shards", groups).unionAll(dealt(shards, 1, "shards", groups, "blocks", block_groups))
    cells = cells.repartitionById(groups * block_groups, F.col("shards") * block_groups + F.col("blocks")).sortWithinPartitions("shard")

    def results(block: tuple[np.ndarray, np.ndarray, Best]) -> pa.RecordBatch:
        ids, queries, best = block
        keys = [int.from_bytes(xxhash.xxh64_digest(np.trim_zeros(q, "b").tobytes()), "big", signed=True) for q in queries.astype("<f8")]
        query, at = np.nonzero(best.score > -np.inf)
        columns = (ids[query], np.array(keys, np.int64)[query], best.ids[query, at], best.score[query, at].astype(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "query", "vec_id", "score"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, Best]] = []
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                ids = np.frombuffer(row["ids"], "<i8")
                data = np.frombuffer(row["data"], f"<{row['kind']}").reshape(len(ids), row["width"])
                if not row["shard"]:  # the blocks come first
                    held.append((ids, data, Best(len(ids), k)))
                    continue
                for q_ids, queries, best in held:
                    width = max(data.shape[1], queries.shape[1])
                    shard, block = (np.pad(v, ((0, 0), (0, width - v.shape[1]))) for v in (data, queries))
                    meet(ids, shard, q_ids, block, best)
        yield from map(results, held)

    found = cells.mapInArrow(search, "query_id long, query long, vec_id long, score long")
    best = W.partitionBy("query_id", "query").orderBy(F.col("score").desc(), "vec_id")
    merged = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return merged.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
