"""The pipeline's stages one by one against plain loops, each on what the one before it kept."""

from collections import Counter

import corpus_pipeline
from notelake.llm import langid
from tests_llm_brute import near_groups, word_count

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "exact dedup", "near-duplicates", "mixing", "packing"]
    language, exact, near, mix, pack = (f for _, f in corpus_pipeline.STAGES)

    one = language(spark, docs, SF).cache()
    model = langid.train(docs)
    want = {r.doc_id for r in langid.predict(docs.select("doc_id", "text"), model).collect() if r.lang_pred != "und" and r.score >= 0.4}
    assert one.schema == docs.schema and {r["doc_id"] for r in rows_of(one)} == want
    assert len(want) >= 0.97 * docs.count()

    two = exact(spark, one, SF).cache()
    last = {}
    for r in rows_of(one):
        last[r["text"] or ""] = max(last.get(r["text"] or "", -1), r["doc_id"])
    assert two.schema == docs.schema and Counter(r["doc_id"] for r in rows_of(two)) == Counter(last.values())

    three = near(spark, two, SF).cache()
    groups = near_groups([(r["doc_id"], r["text"]) for r in rows_of(two)], 5)
    assert three.schema == docs.schema and sorted(r["doc_id"] for r in rows_of(three)) == sorted({low for low in groups.values()})

    four = mix(spark, three, SF).cache()
    times = Counter(r["doc_id"] for r in rows_of(four))
    size = {r["doc_id"]: word_count(r["text"]) for r in rows_of(three)}
    assert four.schema == docs.schema and set(times) <= set(size) and max(times.values()) <= 2
    taken = sum(size[i] * n for i, n in times.items())
    assert abs(taken / (1.5 * sum(size.values())) - 1) < 0.15  # small sources round by whole documents

    five = pack(spark, four, SF).collect()
    assert Counter(r.doc_id for r in five if r.piece == 0) == times
    used = Counter()
    for r in five:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 1024 and len(used) <= 1.02 * sum(used.values()) / 1024 + 1


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
