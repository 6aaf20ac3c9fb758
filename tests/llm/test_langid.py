"""Marginals against enumeration, held-out accuracy, code-switched text and edge cases."""

import itertools
import zlib

import duckdb
import numpy as np
import pytest

from notelake.llm import langid


def test_marginals_equal_enumeration(monkeypatch):
    monkeypatch.setattr(langid, "BLOCK", 3)
    rng = np.random.default_rng(1)
    lengths = [1, 2, 3, 4, 7, 8]
    scores, moves = rng.normal(size=(sum(lengths), 3)) * 2, rng.normal(size=(3, 3))
    got = langid.marginals(scores, lengths, moves)
    expected = np.zeros((3, 3))
    at = 0
    for n in lengths:
        part = scores[at:at + n]
        want, total, pairs = np.zeros((n, 3)), 0.0, np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=n):
            w = np.exp(sum(part[k, y] for k, y in enumerate(path)) + sum(moves[a, b] for a, b in itertools.pairwise(path)))
            total += w
            for k, y in enumerate(path):
                want[k, y] += w
            for a, b in itertools.pairwise(path):
                pairs[a, b] += w
        assert got[at:at + n] == pytest.approx(want / total)
        expected += pairs / total
        at += n
    assert langid._expected_moves(scores, lengths, moves) == pytest.approx(expected)


def test_words_cover_the_whole_text():
    assert langid.words_of("Déjà-vu: 12 x² ½ Ünder_score don't") == ["déjà", "vu", "x", "ünder", "score", "don", "t"]
    assert "".join(langid.words_of("a" * 100)) == "a" * 100


@pytest.fixture(scope="module")
def corpus(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return df, langid.train(df, per_language=60)


def test_held_out_accuracy(corpus):
    df, model = corpus
    got = langid.predict(df.select("doc_id", "lang", "text"), model).withColumn("held", langid.held_out()).collect()
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held and r.lang and r.lang_pred != "und"]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_switches_are_found(spark, corpus):
    _, model = corpus
    texts = duckdb.sql("select lang, text from '/root/testdata/sf0.01/documents.parquet' where length(text) > 1500 order by doc_id").fetchall()
    one = {lang: text for lang, text in texts}
    mixed = " ".join(" ".join(one[lang].split()[:40]) for lang in ("en", "fr", "de"))
    runs = langid.label_words(spark.createDataFrame([(1, mixed)], "doc_id long, text string"), model).first().runs
    long_runs = [r.lang for r in runs if r.words >= 15]
    assert long_runs == ["en", "fr", "de"]


def test_edges(spark, edge_docs, no_docs, corpus):
    model = langid.train(edge_docs)
    got = langid.predict(edge_docs.select("doc_id", "text"), model).collect()
    assert {r.lang_pred for r in got if not r.text or not r.text.strip()} == {"und"}
    nothing = langid.train(no_docs)
    assert {(r.lang_pred, r.score) for r in langid.predict(edge_docs.select("doc_id", "text"), nothing).collect()} == {("und", 0.0)}
    assert langid.predict(no_docs, corpus[1]).count() == 0
    numbers = spark.createDataFrame([(1, "12 34 ... !"), (2, None)], "doc_id long, text string")
    assert {r.lang_pred for r in langid.predict(numbers, corpus[1]).collect()} == {"und"}
    stay = langid.identified(edge_docs)
    assert stay.schema == edge_docs.schema and stay.count() < edge_docs.count()
