"""Ids against the tiktoken library, exact round trips, and the pattern's classes over all code points."""

import base64
import hashlib
from array import array
from collections import Counter

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from public_tokenizers import PATTERN, path

from notelake.llm import byte_bpe
from notelake.llm.queries import QUERIES, table

VOCABULARY = path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(VOCABULARY, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return byte_bpe.Encoder(VOCABULARY, PATTERN)


def test_ids_equal_the_library(library, encoder):
    @settings(max_examples=300, deadline=None)
    @given(st.text(st.characters(exclude_categories=("Cs",)), max_size=60) | st.text("aab \n'sé1!", max_size=80))
    def run(text):
        ids = array("I")
        ids.frombytes(encoder(text))
        assert ids.tolist() == library.encode_ordinary(text)

    run()
    for text in ("", " " * 5000, "a" * 3001, "ab" * 2500, "\x00" * 999, "é" * 2000, "<|endoftext|>", "x\r\n\r\n  y", "it's 'Twas", "日本語" * 700, "🎸" * 300):
        assert array("I", library.encode_ordinary(text)).tobytes() == encoder(text)


def test_a_long_match_takes_n_log_n(encoder):
    ids = encoder("ab" * 100_000 + "c" * 100_000)
    assert len(ids) and byte_bpe.merge_bytes(b"", encoder.ranks, encoder.longest) == []


def test_classes_of_the_pattern_over_all_code_points(encoder):
    """The library splits where this module's pattern does: a merge of a character with the first byte of the next shows one piece."""
    ranks = {bytes([b]): b for b in range(256)}
    for head in b"a1!\n":
        for lead in range(256):
            ranks[bytes([head, lead])] = len(ranks)
    split = tiktoken.Encoding("split", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    for code in [*range(0xD800), *range(0xE000, 0x110000)]:
        for head in "a1!":
            text = head + chr(code)
            assert (split.encode_ordinary(text)[0] >= 256) == (len(encoder.pieces(text)) == 1), hex(code)


def test_query_equals_the_library(spark, library):
    sf = "/root/testdata/sf0.001"
    got = Counter(tuple(r) for r in QUERIES["op13_byte_bpe"](spark, sf).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())
    want = Counter()
    for r in table(spark, sf, "documents").collect():
        ids = library.encode_ordinary(r.text or "")
        want[r.doc_id, len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()] += 1
    assert got == want


def test_edges(spark, edge_docs, no_docs, library):
    clash = edge_docs.withColumnRenamed("kept", "ids").withColumnRenamed("row", "decoded")
    out = byte_bpe.decode(byte_bpe.encode(clash, VOCABULARY, PATTERN), VOCABULARY)
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "decoded", "n_tokens", "ids"] or set(out.columns) >= {"doc_id", "ids", "n_tokens", "decoded"}
    got = Counter((r.doc_id, r.n_tokens, bytes(r.decoded)) for r in out.collect())
    assert got == Counter((r.doc_id, len(library.encode_ordinary(r.text or "")), (r.text or "").encode()) for r in edge_docs.collect())
    assert byte_bpe.decode(byte_bpe.encode(no_docs, VOCABULARY, PATTERN), VOCABULARY).count() == 0
    with pytest.raises(Exception, match="."):
        byte_bpe.decode(spark.createDataFrame([(bytearray(b"\xff\xff\xff\xff"),)], "ids binary"), VOCABULARY).collect()
