"""The checked queries of this subpackage and the SQL twins of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from public_tokenizers import PATTERN, path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.llm import byte_bpe, chat, collocations, exact_dedup, langid, maxscore, mixing, near_dedup, packing, pii, repair, rollups, warc
from notelake.llm.common import scratch, stored, table, text_or_empty

#: The tokenizer versions that token totals are kept by, the older one first.
TOKENIZERS = {"byte_bpe_50k": path("byte_bpe_50k.json"), "byte_bpe_multi_50k": path("byte_bpe_multi_50k.tiktoken")}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep


@query("op1_best_fit_packing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.tokenized_pieces(table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"), 1024, 2)
    return packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), 1024)


@query("op2_prefix_target_chat", r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))),
formatted AS (
  SELECT *, role = 'assistant' AS reply, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC NULLS LAST, role DESC, text DESC) = 1 AS final,
         sum(15 + length(replace(replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'), ':', '\:'))
             + length(replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>')))
           OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS chars
  FROM turns),
joined AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
         coalesce(string_agg(CASE WHEN reply THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '') AS loss,
         sum(CASE WHEN reply OR final THEN chars ELSE 0 END) AS formatted_chars, count(*) FILTER (WHERE reply OR final) AS n_examples
  FROM formatted GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST(formatted_chars AS BIGINT) AS formatted_chars, n_examples
FROM joined""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    strange = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", strange), (-7, 1, "assistant", strange)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(chat.examples(turns))


@query("op3_language_crf")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs.select("doc_id", "text"), langid.train(docs))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


@query("op4_token_rollups")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after four batches: all documents enter under the first vocabulary; those labelled toxic leave; texts with blanks at an
    end are trimmed and counted anew; documents in other languages than English move to the second vocabulary.

    The first batch is sent twice, which changes nothing. Images before and after a change come from one row, so null and repeated
    ids do no harm; ids serve for the labels only.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    trimmed = F.btrim("text", F.lit("\x20\t\n\x0b\x0c\r"))
    abroad = ~F.col("lang").eqNullSafe(F.lit("en"))
    docs = docs.withColumn("trimmed", F.when(trimmed != F.col("text"), trimmed)).withColumn("moved", F.when(abroad, F.coalesce("trimmed", text_or_empty())))
    first, second = TOKENIZERS
    counted = rollups.with_counts(docs.withColumn("text", text_or_empty()), {
        "tokens": ("text", TOKENIZERS[first]), "after_trim": ("trimmed", TOKENIZERS[first]), "after_move": ("moved", TOKENIZERS[second])})
    toxic = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id", F.lit(True).alias("toxic")).distinct()
    counted = stored(counted.join(toxic, "doc_id", "left").drop("doc_id").withColumns({"first": F.lit(first), "second": F.lit(second)}))
    clean = counted.filter("toxic is null")
    image = lambda version, tokens, name: rollups.image(version=version, tokens=tokens).alias(name)
    rollup = rollups.Rollup(spark, scratch(spark, "rollup"))
    for batch in ("load", "load"):
        rollup.commit(batch, rollups.inserts(counted.withColumnRenamed("first", "version")))
    rollup.commit("toxic", rollups.deletes(counted.filter("toxic").withColumnRenamed("first", "version")))
    rollup.commit("trimmed", clean.filter("after_trim is not null").select(image("first", "tokens", "before"), image("first", "after_trim", "after")))
    now = clean.withColumn("now", F.coalesce("after_trim", "tokens"))
    rollup.commit("moved", now.filter("after_move is not null").select(image("first", "now", "before"), image("second", "after_move", "after")))
    rollup.compact()
    return rollup.totals()


@query("op5_exact_dedup", """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.annotate(table(spark, sf_dir, "documents"), carry=False)


@query("op8_source_mixing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(mixing.sized(table(spark, sf_dir, "documents")), (3, 1, 2), 1.5, 2.0)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "times")


@query("op6_warc_round_trip", """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + list_sum(list_transform(range(0, 5), lambda b:
         ((strpos('0123456789abcdef', substr(h, CAST(1 + (5 * i + b) // 4 AS INTEGER), 1)) - 1) >> CAST(3 - (5 * i + b) % 4 AS INTEGER)) % 2
         * CAST(2 ** (4 - b) AS BIGINT))) AS INTEGER), 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM d""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = scratch(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), target)
    return warc.read(spark, target).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op7_maxscore_search", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.x AS DOUBLE[]), CAST(c.x AS DOUBLE[])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.nearest(table(spark, sf_dir, "embeddings"), 5, 50, 256.0)


@query("op9_pii_boosting")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find(table(spark, sf_dir, "documents")))


@query("op10_near_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents"), 4, 80).select("doc_id", "n_shingles", "component_id", "kept")


@query("op13_byte_bpe")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = path("byte_bpe_multi_50k.tiktoken")
    encoded = byte_bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary, PATTERN)
    return byte_bpe.decode(encoded, vocabulary).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op12_collocations", r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, ws, unnest(range(1, 6)) AS k FROM w),
f AS (SELECT lang, k, phrase, count(*) AS a FROM (
        SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase FROM g) GROUP BY ALL),
n AS (SELECT lang, sum(a) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND a >= 100),
i AS (SELECT lang, inner_phrase, max(a) AS inside FROM (
        SELECT lang, a, unnest(flatten(list_transform(range(2, k), lambda m: list_transform(range(1, k - m + 2), lambda j: array_to_string(ws[j:j + m - 1], ' '))))) AS inner_phrase
        FROM c) GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN i ON i.lang = c.lang AND i.inner_phrase = c.phrase WHERE inside IS NULL OR 100 * inside < 100 * a),
cuts AS (SELECT *, array_to_string(ws[1:cut], ' ') AS x, array_to_string(ws[cut + 1:], ' ') AS y FROM (SELECT *, unnest(range(1, k)) AS cut FROM kept)),
s AS (SELECT cuts.lang, cuts.phrase, cuts.a, l.a AS l, r.a AS r, CAST(n.n AS BIGINT) AS n, cut,
             CAST((1000::HUGEINT * cuts.a * CAST(n.n AS HUGEINT)) // (l.a::HUGEINT * r.a) AS BIGINT) AS score
      FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = x JOIN f r ON r.lang = cuts.lang AND r.phrase = y JOIN n ON n.lang = cuts.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM b
QUALIFY rank <= 2000""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), 100, 5, 2000, 100)


def damaged(turns: DataFrame) -> DataFrame:
    """Turns with one of five faults, chosen by a checksum of conversation and turn; nulls of role, text and key become one space."""
    known = turns.select("conv_id", "turn", *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")])
    shown = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    fault = F.crc32(F.concat(shown[0], F.lit(":"), shown[1])) % 20
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = known.withColumn("fault", fault).filter("fault != 0").withColumns({"text": text, "role": F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))})
    return rows.withColumn("_copy", F.explode(F.expr("sequence(1, if(fault = 3, 2, 1))"))).drop("_copy", "fault")


@query("op11_conversation_repair", r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(0, 256), lambda i: list_reduce(list_prepend(i, range(0, 8)), lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
bad AS (SELECT src.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(k, ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
                                      lambda c, b: xor(c >> 8, t[1 + xor(c & 255, b)])), 4294967295) % 20 AS fault FROM src, crc),
rows_after AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
         CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE fault WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) FROM bad)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i, rtrim(text, E'\x20\t\n\x0b\x0c\r') AS stripped FROM rows_after),
f AS (SELECT *, stripped = '' AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS dup,
             right(stripped, 1) NOT IN ('.', '!', '?') AS cut, left(role, 1) AS ini, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS ini0 FROM o),
g AS (SELECT *, blank OR dup AS gone, CASE WHEN cut THEN 5 ELSE 0 END AS pen FROM f),
counts AS (
  SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup AND NOT blank) AS duplicate,
         count(*) FILTER (cut AND NOT blank AND NOT dup) AS truncated, count(*) FILTER (ini0 IS NOT NULL AND ini0 || ini NOT IN ('su', 'ua', 'au')) AS illegal
  FROM g GROUP BY conv_id),
dp AS (
  SELECT conv_id, n AS i, {'c': 0, 'a': '', 'o': []::VARCHAR[]} AS v0, {'c': 10, 'a': 'II', 'o': ['user:', 'assistant:']} AS v1, {'c': 5, 'a': 'I', 'o': ['assistant:']} AS v2,
         {'c': 0, 'a': '', 'o': []::VARCHAR[]} AS v3 FROM counts
  UNION ALL
  SELECT conv_id, i, list_sort([w0, {'c': w2.c + 5, 'a': 'I' || w2.a, 'o': list_prepend('user:', w2.o)}, {'c': w3.c + 10, 'a': 'II' || w3.a, 'o': ['user:', 'assistant:'] || w3.o}])[1],
         list_sort([w1, {'c': w2.c + 5, 'a': 'I' || w2.a, 'o': list_prepend('user:', w2.o)}, {'c': w3.c + 10, 'a': 'II' || w3.a, 'o': ['user:', 'assistant:'] || w3.o}])[1],
         list_sort([w2, {'c': w3.c + 5, 'a': 'I' || w3.a, 'o': list_prepend('assistant:', w3.o)}])[1], list_sort([w3, {'c': w2.c + 5, 'a': 'I' || w2.a, 'o': list_prepend('user:', w2.o)}])[1]
  FROM (
    SELECT r.conv_id, r.i - 1 AS i,
      list_sort([{'c': v0.c + 2, 'a': 'D' || v0.a, 'o': v0.o}, {'c': v1.c + pen + CASE WHEN gone OR ini <> 's' THEN 100000000 ELSE 0 END, 'a': 'K' || v1.a, 'o': list_prepend(role || ':' || text, v1.o)},
        {'c': v2.c + pen + CASE WHEN gone OR ini <> 'u' THEN 100000000 ELSE 0 END, 'a': 'K' || v2.a, 'o': list_prepend(role || ':' || text, v2.o)},
        {'c': v2.c + pen + CASE WHEN gone THEN 100000000 ELSE 1 END, 'a': 'R' || v2.a, 'o': list_prepend('user:' || text, v2.o)}])[1] AS w0,
      list_sort([{'c': v1.c + 2, 'a': 'D' || v1.a, 'o': v1.o}, {'c': v2.c + pen + CASE WHEN gone OR ini <> 'u' THEN 100000000 ELSE 0 END, 'a': 'K' || v2.a, 'o': list_prepend(role || ':' || text, v2.o)},
        {'c': v2.c + pen + CASE WHEN gone THEN 100000000 ELSE 1 END, 'a': 'R' || v2.a, 'o': list_prepend('user:' || text, v2.o)}])[1] AS w1,
      list_sort([{'c': v2.c + 2, 'a': 'D' || v2.a, 'o': v2.o}, {'c': v3.c + pen + CASE WHEN gone OR ini <> 'a' THEN 100000000 ELSE 0 END, 'a': 'K' || v3.a, 'o': list_prepend(role || ':' || text, v3.o)},
        {'c': v3.c + pen + CASE WHEN gone THEN 100000000 ELSE 1 END, 'a': 'R' || v3.a, 'o': list_prepend('assistant:' || text, v3.o)}])[1] AS w2,
      list_sort([{'c': v3.c + 2, 'a': 'D' || v3.a, 'o': v3.o}, {'c': v2.c + pen + CASE WHEN gone OR ini <> 'u' THEN 100000000 ELSE 0 END, 'a': 'K' || v2.a, 'o': list_prepend(role || ':' || text, v2.o)},
        {'c': v2.c + pen + CASE WHEN gone THEN 100000000 ELSE 1 END, 'a': 'R' || v2.a, 'o': list_prepend('user:' || text, v2.o)}])[1] AS w3
    FROM dp r JOIN g ON g.conv_id IS NOT DISTINCT FROM r.conv_id AND g.i = r.i)),
best AS (SELECT c.*, CAST(v0.c AS BIGINT) AS cost, v0.a AS audit, sha256(array_to_string(v0.o, chr(10))) AS h FROM dp JOIN counts c ON c.conv_id IS NOT DISTINCT FROM dp.conv_id WHERE i = 0)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM a.conv_id""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = repair.report(damaged(turns)).withColumnRenamed("conv_id", "_id")
    every = turns.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("_id")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
