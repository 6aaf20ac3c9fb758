"""Byte-level BPE encoding and decoding by a segment tree over byte positions.

A text is split by the pre-tokenizing pattern, and each match is encoded by itself. A match that is a token is that token. Otherwise its
bytes are the leaves of a segment tree: the leaf of a live position holds the rank of the pair that the token beginning there forms with
the next one, and every inner node the smallest rank below it, the leftmost of equals. The root names the next merge. A merge
joins two live neighbours and changes three leaves (the pair's own, that of the swallowed token, that of the token before), each a
logarithmic point update, so a match of n bytes costs n log n whatever it looks like: a run of a million equal letters is no special case.

Every row is encoded on its own, so there is no shuffle and nothing grows with the table. Ids of matches are remembered within a worker up
to a bound. Vocabularies are files of the installed tokenizers, given by their path and opened inside the tasks.
"""

from __future__ import annotations

import base64
import functools
import unicodedata
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notelake.llm.common import small_batches

NONE = 1 << 62
CACHE = 600_000
#: Longer matches are encoded anew each time, so that the remembered ones stay small.
CACHED_BYTES = 64
FLUSH = 8_000_000  # bytes in one output batch


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank from a file with a base64 token and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge_bytes(piece: bytes, ranks: dict[bytes, int], longest: int) -> list[int]:
    """Ranks of the tokens of ``piece``: the pair of lowest rank, leftmost of equals, is merged until no pair is a token."""
    n = len(piece)
    bits = max(n - 1, 1).bit_length()
    size, mask = 1 << bits, (1 << bits) - 1
    rank_of = ranks.get
    ends = list(range(1, n + 1))  # where the token that begins at a position ends
    before = list(range(-1, n - 1))  # where the live token before it begins
    # the position parts equal ranks, so the smallest key of a subtree is that of its leftmost pair of lowest rank
    tree = [NONE] * size + [NONE if (rank := rank_of(piece[i:i + 2])) is None else rank << bits | i for i in range(n - 1)]
    tree += [NONE] * (2 * size - len(tree))
    for node in range(size - 1, 0, -1):
        left, right = tree[2 * node], tree[2 * node + 1]
        tree[node] = left if left < right else right
    while (root := tree[1]) != NONE:
        at = root & mask
        swallowed = ends[at]
        middle = ends[at] = ends[swallowed]
        back = before[at]
        changes = [(swallowed, NONE)] if tree[size + swallowed] != NONE else []
        key = NONE
        if middle < n:
            before[middle] = at
            if ends[middle] - at <= longest and (rank := rank_of(piece[at:ends[middle]])) is not None:
                key = rank << bits | at
        changes.append((at, key))
        if back >= 0:
            key = NONE
            if middle - back <= longest and (rank := rank_of(piece[back:middle])) is not None:
                key = rank << bits | back
            if tree[size + back] != key:
                changes.append((back, key))
        for leaf, key in changes:
            node = size + leaf
            tree[node] = key
            while node > 1:
                other = tree[node ^ 1]
                node >>= 1
                if other < key:
                    key = other
                if tree[node] == key:
                    break
                tree[node] = key
    out, at = [], 0
    while at < n:
        out.append(ranks[piece[at:ends[at]]])
        at = ends[at]
    return out


@functools.cache
def newer_characters() -> str:
    """Letters and numbers of the ``regex`` module's Unicode version that the library's older version does not know.

    The library shows how it splits: with a token for a head and the first byte of what follows, both in one piece give that token.
    """
    import tiktoken
    from public_tokenizers import PATTERN

    ranks = {bytes([b]): b for b in range(256)} | {bytes([head, b]): 256 + 256 * k + b for k, head in enumerate(b"a1") for b in range(256)}
    split = tiktoken.Encoding("split", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    held = [c for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn"]
    return "".join(c for c in held if all(split.encode_ordinary(head + c)[0] < 256 for head in "a1"))


class Encoder:
    """Ids of whole texts under one vocabulary."""

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        missing = [b for b in range(256) if bytes([b]) not in self.ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks {len(missing)} of the 256 bytes")
        self.longest = max(map(len, self.ranks))
        self.find = regex.compile(pattern)
        newer = newer_characters()
        self.newer = frozenset(newer)
        self.as_other = dict.fromkeys(map(ord, newer), "\ufdd0")
        self.known: dict[str, bytes] = {}

    def pieces(self, text: str) -> list[str]:
        if not text.isascii() and not self.newer.isdisjoint(text):
            return [text[m.start():m.end()] for m in self.find.finditer(text.translate(self.as_other))]
        return self.find.findall(text)

    def piece(self, text: str) -> bytes:
        raw = text.encode("utf-8", "replace")
        rank = self.ranks.get(raw)
        ids = array("I", [rank] if rank is not None else merge_bytes(raw, self.ranks, self.longest)).tobytes()
        if len(raw) <= CACHED_BYTES:
            if len(self.known) >= CACHE:
                self.known.clear()
            self.known[text] = ids
        return ids

    def __call__(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        known, piece = self.known.get, self.piece
        return b"".join([known(p) or piece(p) for p in self.pieces(text)])


@functools.lru_cache(maxsize=1)
def _encoder(path: str, pattern: str) -> Encoder:
    """One encoder per worker process, so later tasks find the matches that earlier ones have met."""
    return Encoder(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens`` (long) and ``ids`` (binary, little-endian unsigned 32-bit integers) in place of ``text``.

    A null text is empty and has no ids. Strings of special tokens are ordinary text. Texts are encoded whole, however long; rows that
    repeat are encoded each for itself; all other columns are kept, nulls included, but columns named n_tokens or ids are replaced. An
    empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    others = [c for c in docs.columns if c not in (text, "n_tokens", "ids")]
    schema = T.StructType([*[docs.schema[c] for c in others], T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, pattern)
        for batch in batches:
            begin, out, held = 0, [], 0

            def flush(end: int) -> pa.RecordBatch:
                counts = pa.array([len(ids) // 4 for ids in out], pa.int64())
                held_columns = [c.slice(begin, end - begin) for c in batch.columns[:-1]]  # noqa: B023 - called at once
                return pa.RecordBatch.from_arrays([*held_columns, counts, pa.array(out, pa.binary())], names=schema.names)  # noqa: B023

            for i, value in enumerate(batch.column(batch.num_columns - 1)):
                out.append(encoder(value.as_py() or ""))
                held += len(out[-1])
                if held > FLUSH:
                    yield flush(i + 1)
                    begin, out, held = i + 1, [], 0
            if out:
                yield flush(batch.num_rows)

    return docs.select(*others, F.col(text).cast("string").alias(text)).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded`` (binary), the bytes of all tokens of ``ids`` in a row.

    Null ids decode to nothing. Unknown ids are an error. Columns are kept, one named decoded is replaced; an empty table stays empty.
    """
    others = [c for c in encoded.columns if c != "decoded"]
    schema = T.StructType([*[encoded.schema[c] for c in others], T.StructField("decoded", T.BinaryType())])
    place = others.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = {rank: token for token, rank in read_ranks(path).items()}
        for batch in batches:
            texts = []
            for value in batch.column(place):
                numbers = array("I")
                numbers.frombytes(value.as_py() or b"")
                texts.append(b"".join([tokens[i] for i in numbers]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], names=schema.names)

    return encoded.select(*others).mapInArrow(run, schema)
