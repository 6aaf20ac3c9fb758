"""Totals from deltas against counting the final state anew."""

from collections import Counter

import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

from notelake.llm import rollups
from notelake.llm.queries import TOKENIZERS, QUERIES, table

COUNTED = "doc_id long, source string, lang string, version string, tokens long"


def state(rows):
    out = Counter()
    tokens = Counter()
    for _, source, lang, version, n in rows:
        out[source, lang, version] += 1
        tokens[source, lang, version] += n or 0
    return {(*k, out[k], tokens[k]) for k in out}


def totals(rollup):
    return {tuple(r) for r in rollup.totals().collect()}


def test_deltas_equal_a_full_count(spark, tmp_path):
    df = lambda rows: spark.createDataFrame(rows, COUNTED)
    first = [(i, f"s{i % 3}" if i % 7 else None, "en" if i % 2 else None, "v1", i) for i in range(60)] + [(60, "s0", "en", "v1", None)]
    rollup = rollups.Rollup(spark, f"file://{tmp_path}/r")
    assert totals(rollup) == set()
    assert rollup.commit("b1", rollups.inserts(df(first)))
    assert totals(rollup) == state(first)
    gone, moved = first[:10], first[10:20]
    after = [(i, "s9", lang, "v2", 2 * n) for i, _, lang, _, n in moved]
    pairs = [((s, la, v, n), (s2, la2, v2, n2)) for (_, s, la, v, n), (_, s2, la2, v2, n2) in zip(moved, after, strict=True)]
    image = "struct<source:string,lang:string,version:string,tokens:bigint>"
    revised = spark.createDataFrame(pairs, f"before {image}, after {image}")
    change = rollups.deletes(df(gone)).unionByName(revised)
    assert rollup.commit("b2", change)
    final = first[20:] + after
    assert totals(rollup) == state(final)
    assert not rollup.commit("b2", change) and not rollup.commit("b1", rollups.inserts(df(first)))  # a replay changes nothing
    assert totals(rollup) == state(final)
    rollup.compact()
    assert totals(rollup) == state(final) and not rollup.commit("b2", change) and rollup.batches() == ["b1", "b2"]
    assert rollup.commit("b3", rollups.deletes(df(final)))
    assert totals(rollup) == set()
    rollup.compact()
    assert totals(rollup) == set() and rollup.batches() == ["b1", "b2", "b3"]


def test_a_broken_batch_does_not_count(spark, tmp_path):
    rollup = rollups.Rollup(spark, f"file://{tmp_path}/r")
    rows = spark.createDataFrame([(1, "a", "en", "v", 5)], COUNTED)
    rollup.commit("x", rollups.inserts(rows))
    (tmp_path / "r" / "batch=x" / "_SUCCESS").unlink()
    assert totals(rollup) == set()
    assert rollup.commit("x", rollups.inserts(rows))
    assert totals(rollup) == {("a", "en", "v", 1, 5)}
    with pytest.raises(ValueError):
        rollup.commit("../x", rollups.inserts(rows))


def test_counts_of_edge_documents(edge_docs, no_docs):
    versions = {"bytes": path("byte_bpe_50k.json")}
    tokenizer = Tokenizer.from_file(versions["bytes"])
    got = rollups.token_counts(edge_docs, versions).collect()
    want = Counter((r.doc_id, len(tokenizer.encode(r.text or "", add_special_tokens=False).ids)) for r in edge_docs.collect())
    assert Counter((r.doc_id, r.tokens) for r in got) == want
    assert rollups.token_counts(no_docs, versions).count() == 0


def recount(docs, toxic):
    """Totals of the final state: toxic documents gone, texts trimmed, all but English ones under the second vocabulary."""
    import base64

    import tiktoken
    from public_tokenizers import PATTERN

    first = Tokenizer.from_file(TOKENIZERS["byte_bpe_50k"])
    with open(TOKENIZERS["byte_bpe_multi_50k"], "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    second = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    out, tokens = Counter(), Counter()
    for r in docs:
        if r.doc_id is not None and r.doc_id in toxic:
            continue
        key = (r.source, r.lang, "byte_bpe_50k" if r.lang == "en" else "byte_bpe_multi_50k")
        text = (r.text or "").strip(" \t\n\x0b\x0c\r")
        out[key] += 1
        tokens[key] += len(first.encode(text, add_special_tokens=False).ids if r.lang == "en" else second.encode_ordinary(text))
    return {(*k, out[k], tokens[k]) for k in out}


def test_query_equals_a_full_recount(spark):
    sf = "/root/testdata/sf0.001"
    toxic = {r[0] for r in table(spark, sf, "labels").filter("toxic = 1").select("doc_id").collect()}
    got = {tuple(r) for r in QUERIES["op4_token_rollups"](spark, sf).collect()}
    assert got == recount(table(spark, sf, "documents").collect(), toxic)


def test_query_with_null_and_repeated_ids(spark, edge_docs, tmp_path):
    more = spark.createDataFrame([(3, "  trimmed  ", "en", "a"), (3, "  trimmed  ", "en", "a"), (3, "other\n", "fr", "a"), (None, " x ", None, None), (2, "toxic ", "en", "a")],
                                 "doc_id long, text string, lang string, source string")
    docs = edge_docs.select(*more.columns).unionByName(more)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(2, 1), (2, 1), (3, 0), (None, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert {tuple(r) for r in QUERIES["op4_token_rollups"](spark, str(tmp_path)).collect()} == recount(docs.collect(), {2})


def test_counts_of_several_texts(spark, edge_docs, no_docs):
    wanted = {"n": ("text", TOKENIZERS["byte_bpe_50k"]), "row": ("kept", TOKENIZERS["byte_bpe_multi_50k"]), "m": ("text", path("word_bpe_49k.json"))}
    got = rollups.with_counts(edge_docs, wanted)
    assert got.columns == ["doc_id", "lang", "source", "n_chars", "n", "row", "m"] and got.count() == edge_docs.count()
    assert got.filter("doc_id = 2").first()["n"] is None and got.filter("doc_id = 1").first()["n"] == 0 and got.filter("doc_id = 3").first()["m"] == 3
    assert rollups.with_counts(no_docs, wanted).count() == 0
    clash = rollups.token_counts(edge_docs.withColumnRenamed("row", "tokens").withColumnRenamed("kept", "version"), {"v": TOKENIZERS["byte_bpe_50k"]})
    assert {r.version for r in clash.collect()} == {"v"}
