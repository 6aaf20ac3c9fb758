"""Personal data by candidate generation and gradient boosting, with DataFrame functions and Spark's own trees only.

Generators propose spans of high recall that may overlap: the four base patterns, and wider ones (addresses spelled with
"at" and "dot", numbers in any grouping, dotted quads with other separators). A span's place comes from the gaps that splitting by
the same pattern leaves, summed along the text. Base spans that pass their check (octets, Luhn, number of digits) are always
selected. Boosted trees then score the wide candidates that overlap no base span and could pass the check of their kind.

No span outside the base patterns has a label, so the positives are base spans in their own context, spelled in the ways that only
the wide generators match (``_respelled``). Against them stand the wide candidates that overlap no base span: certain
negatives where the check of the kind fails, otherwise unlabelled and of weight ``UNLABELLED``, as some of them are personal
data. Features that tell the plain spelling of this table's base spans (digits and lengths of addresses) are masked, and half of
the spellings follow a hint word of their kind, so that a table without such words does not make them speak against a span. For
each kind the threshold is calibrated on spans that the trees have not seen, as the lowest score from which at least
``PRECISION`` of the weight is positive, with as many spans spelled otherwise as respelling makes from the table's base spans.
Unlabelled spans count by ``UNLABELLED`` there too: counted in full, the personal data among them would keep themselves from being added.
A table without base spans of a kind adds none of that kind.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from notelake.llm.common import stored, text_or_empty

KINDS = ["email", "ip", "card", "phone"]
EMAIL, IP, CARD, PHONE = range(4)
#: The base patterns, with possessive repeats: Java runs other repeated groups by recursion, which long runs would overflow. ``\G`` (the end of the last match) or a look-behind keeps each attempt at the start of a run, which finds
#: the same leftmost matches and stays linear in runs that lead nowhere.
BASE = [
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?:\G|(?<![0-9]))[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]
#: Wider generators and the kinds that they propose a span for.
WIDE = [
    (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64}+ ?(?:@|\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{2,64}+(?: ?(?:\.|\(dot\)|\[dot\]| dot ) ?[A-Za-z0-9-]{2,64}+)++", [EMAIL]),
    (r"(?<![0-9])[0-9]{1,3}(?:[.,:_] ?[0-9]{1,3}){3}(?![0-9])", [IP]),
    (r"(?<![0-9A-Za-z])[+(]?[0-9](?:[\x20().\/-]{0,2}+[0-9]){8,}+", [CARD, PHONE]),
]
PRECISION = 0.98
BALANCE = 20_000
#: How lists of four numbers are written; an address in this spelling stands among the negatives, and so does a phone number of
#: digits only that no hint word precedes.
LIST = ", "
#: Weight of a candidate that may be personal data or not.
UNLABELLED = 0.1
FEATURES = [
    "f_email", "f_ip", "f_card", "f_phone", "f_chars", "f_digits", "f_separators", "f_blanks", "f_commas", "f_plus", "f_at", "f_dots", "f_groups", "f_luhn", "f_octets",
    "f_card_digits", "f_phone_digits", "f_marked_at", "f_word_at", "f_spelled_dot", "f_blank_dot", "f_upper_dot", "f_before_blank", "f_after_blank",
    "f_before_digit", "f_after_digit", "f_before_letter", "f_hint",
]


def _proposals(text: str) -> list[Column]:
    """For each generator an array of (gen, kind, ord, gap, match, before, after)."""
    has_digit = F.col(text).rlike("[0-9]")
    at = F.contains(text, F.lit("@"))
    spelled = F.col(text).rlike(r"[(\[]at[)\]]| at ")
    when = [at, has_digit & F.contains(text, F.lit(".")), has_digit, F.contains(text, F.lit("+"))]
    gens = [(p, [k], w) for k, (p, w) in enumerate(zip(BASE, when, strict=True))]
    gens += [(p, kinds, at | spelled if kinds == [EMAIL] else has_digit) for p, kinds in WIDE]
    out = []
    for g, (pattern, kinds, worth) in enumerate(gens):
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        gaps = F.split(text, pattern, -1)

        def spans(found: Column, gaps: Column, g: int = g, kinds: list[int] = kinds) -> Column:
            return F.flatten(F.transform(F.arrays_zip(found.alias("m"), F.slice(gaps, 1, F.size(found)).alias("b"), F.slice(gaps, 2, F.size(found)).alias("a")),
                                         lambda x, i: F.array(*[F.struct(
                                             F.lit(g).alias("gen"), F.lit(k).alias("kind"), i.alias("ord"), F.char_length(x["b"]).alias("gap"), x["m"].alias("match"),
                                             F.right(x["b"], F.lit(24)).alias("before"), F.left(x["a"], F.lit(8)).alias("after")) for k in kinds])))

        out.append(F.when(worth, spans(found, gaps)))
    return out


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.char_length(digits)
    value = lambda i: F.substr(digits, n - i, F.lit(1)).cast("int") * (1 + i % 2)
    worth = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(value(i) > 9, value(i) - 9).otherwise(value(i)))
    return F.when(n > 0, F.aggregate(worth, F.lit(0), lambda s, x: s + x) % 10 == 0).otherwise(False)


def _octets(match: Column) -> Column:
    """Whether all parts between other characters are numbers up to 255."""
    parts = F.filter(F.split(F.regexp_replace(match, "[^0-9]+", " "), " "), lambda p: p != "")
    short = F.transform(parts, lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    return F.forall(short, lambda p: (F.char_length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(999)) <= 255))


def _respelled(match: Column, digits: Column, kind: Column) -> Column:
    """A valid base span in the spellings that only the wide generator of its kind matches."""
    local, host = F.substring_index(match, "@", 1), F.substring_index(match, "@", -1)
    ats = [(" (at) ", " (dot) "), ("(at)", "(dot)"), ("[at]", "[dot]"), (" [at] ", " [dot] "), (" at ", " dot "), (" at ", "."), (" (at) ", "."), ("[at]", "."), (" @ ", ".")]
    national = lambda by: F.regexp_replace(F.right(digits, F.lit(10)), "^(...)(...)(....)$", by)
    ways = {
        EMAIL: [F.concat(local, F.lit(a), F.replace(host, F.lit("."), F.lit(d))) for a, d in ats],
        IP: [F.replace(match, F.lit("."), F.lit(by)) for by in (",", ":", "_", ". ", LIST)],
        CARD: [F.regexp_replace(digits, "(....)(?=.)", f"$1{by}") for by in (".", "/", "  ", "- ")],
        PHONE: [digits, F.substring(match, 2, 1000), F.regexp_replace(match, r"^\+[0-9]{1,3}[\x20.-]?(?=\(|[0-9])", ""), *[national(f"$1{by}$2{by}$3") for by in "-. /"],
                national("($1) $2-$3"), F.concat(F.lit("+"), F.regexp_replace(digits, "^([0-9]+)(...)(...)(....)$", "$1/$2/$3/$4")),
                F.regexp_replace(digits, "^([0-9]+)(...)(...)(....)$", "$1-$2-$3-$4")],
    }
    out = F.array().cast("array<string>")
    for pattern, kinds in WIDE:
        for k in kinds:
            whole = F.filter(F.array(*ways[k]), lambda s: s.rlike(f"^(?:{pattern})$"))  # noqa: B023 - called at once
            out = F.when(kind == k, whole).otherwise(out)
    return F.array_distinct(out)


def _possible(kind: Column, n_digits: Column, passes: Column, octets: Column) -> Column:
    """Whether a span passes the check of its kind."""
    return F.coalesce(F.when(kind == EMAIL, True).when(kind == IP, octets).when(kind == CARD, n_digits.between(14, 19) & passes).when(
        kind == PHONE, n_digits.between(10, 15)), F.lit(False))


def candidates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per proposed span and one row per document: doc_id, tkey, gen, kind, start, end (code points), base, planted, contrast, possible, seen and features.

    Rows that repeat id and text are told by ``copies``; the document's own row has a null ``gen``. Rows that are ``planted`` hold
    another spelling of the base span at their place and are for training only, ``contrast`` ones as negatives.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text_or_empty(text)).alias("tkey"), text_or_empty(text).alias("text"))
    arrays = rows.select("doc_id", "tkey", *[p.alias(f"g{i}") for i, p in enumerate(_proposals("text"))])
    none = F.array()
    every = F.concat(*[F.coalesce(F.col(f"g{i}"), none.cast(arrays.schema[f"g{i}"].dataType)) for i in range(len(BASE) + len(WIDE))])
    spans = arrays.select("doc_id", "tkey", F.explode_outer(F.concat(F.array(F.lit(None).cast(arrays.schema["g0"].dataType.elementType)), every)).alias("s"))
    spans = spans.groupBy("doc_id", "tkey", F.col("s.gen").alias("gen"), F.col("s.kind").alias("kind"), F.col("s.ord").alias("ord")).agg(
        F.count("*").alias("copies"), F.first("s.gap").alias("gap"), F.first("s.match").alias("match"), F.first("s.before").alias("before"), F.first("s.after").alias("after"))
    along = W.partitionBy("doc_id", "tkey", "gen", "kind").orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    size = F.char_length("match")
    end = F.sum(F.col("gap") + size).over(along)
    spans = spans.withColumn("end", end.cast("long")).withColumn("start", F.col("end") - size)
    checks = lambda when: {
        "digits": when("digits", F.regexp_replace("match", "[^0-9]", "")), "n_digits": when("n_digits", F.char_length("digits")),
        "luhn": when("luhn", F.when(F.col("n_digits") <= 30, luhn(F.col("digits"))).otherwise(False)), "octets": when("octets", _octets(F.col("match")))}
    for name, value in checks(lambda _, value: value).items():
        spans = spans.withColumn(name, value)
    possible = _possible(F.col("kind"), F.col("n_digits"), F.col("luhn"), F.col("octets"))
    spans = spans.withColumn("base", F.coalesce((F.col("gen") < len(BASE)) & possible, F.lit(False)))
    # a base span stays and each of its spellings follows it, as if the wide generator had proposed it there
    way = lambda s, planted: F.struct(s.alias("match"), F.lit(planted).alias("planted"))
    ways = F.when(F.col("base"), F.transform(_respelled(F.col("match"), F.col("digits"), F.col("kind")), lambda s: way(s, True)))
    ways = F.concat(F.array(way(F.col("match"), False)), F.coalesce(ways, F.array().cast("array<struct<match:string,planted:boolean>>")))
    spans = spans.withColumn("_way", F.explode(ways)).withColumns({"match": F.col("_way.match"), "planted": F.col("_way.planted")}).drop("_way")
    for name, value in checks(lambda old, value: F.when(F.col("planted"), value).otherwise(F.col(old))).items():
        spans = spans.withColumn(name, value)
    of_kind = [next(len(BASE) + i for i, (_, kinds) in enumerate(WIDE) if k in kinds) for k in range(len(KINDS))]
    spans = spans.withColumns({"base": F.col("base") & ~F.col("planted"), "possible": possible, "gen": F.when(
        F.col("planted"), F.element_at(F.array(*[F.lit(g) for g in of_kind]), F.col("kind") + 1)).otherwise(F.col("gen"))})
    return _seen(_features(spans))


def _features(spans: DataFrame) -> DataFrame:
    count = lambda pattern: F.regexp_count("match", F.lit(pattern)).cast("double")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    before, after = F.right("before", F.lit(1)), F.left("after", F.lit(1))
    hint = lambda words: flag(F.lower("before").rlike(words))
    number = lambda c: F.when(F.col("kind") != EMAIL, c)  # noqa: E731 - what an address holds besides its spelling differs from table to table
    address = lambda pattern: flag((F.col("kind") == EMAIL) & F.col("match").rlike(pattern))
    values = {
        **{f"f_{k}": flag(F.col("kind") == i) for i, k in enumerate(KINDS)},
        "f_chars": F.when(F.col("kind").isin(CARD, PHONE), F.least(F.char_length("match"), F.lit(100)).cast("double")), "f_digits": number(F.least("n_digits", F.lit(40)).cast("double")),
        "f_separators": number(count(r"[\x20().,:/_-]")), "f_blanks": number(count(r"\x20")), "f_commas": number(count(",")), "f_plus": flag(F.startswith("match", F.lit("+"))), "f_at": address("@"), "f_dots": number(count(r"\.")),
        "f_groups": number(count("[0-9]+")), "f_luhn": number(flag(F.col("luhn"))), "f_octets": number(flag(F.col("octets"))),
        "f_card_digits": number(flag(F.col("n_digits").between(14, 19))), "f_phone_digits": number(flag(F.col("n_digits").between(10, 15))),
        "f_marked_at": address(r"[(\[]at[)\]]"), "f_word_at": address(" at "), "f_spelled_dot": address(r" dot |[(\[]dot[)\]]"),
        "f_blank_dot": address(r"\. | \."), "f_upper_dot": address(r"\. ?[A-Z]"),
        "f_before_blank": flag((before == "") | before.rlike(r"\s")), "f_after_blank": flag((after == "") | after.rlike(r"\s")),
        "f_before_digit": flag(before.rlike("[0-9]")), "f_after_digit": flag(after.rlike("[0-9]")), "f_before_letter": flag(before.rlike(r"\p{L}")),
        "f_hint": F.when(F.col("planted") & (F.pmod(F.xxhash64("match"), F.lit(2)) == 0), 1.0).otherwise(F.element_at(F.array(
            hint("mail|contact|write"), hint(r"\bip\b|host|server|addr"), hint("card|visa|credit|karte|carte|tarjeta"), hint("tel|phone|call|fax|mobil")), F.col("kind") + 1)),
    }
    bare = (F.col("kind") == PHONE) & F.col("match").rlike("^[0-9]+$") & (values["f_hint"] == 0)
    contrast = F.col("planted") & ((F.col("kind") == IP) & F.contains("match", F.lit(LIST)) | bare)
    return spans.select("doc_id", "tkey", "gen", "kind", "copies", "start", "end", "base", "planted", contrast.alias("contrast"), "possible", *[F.coalesce(v, F.lit(0.0)).alias(k) for k, v in values.items()])


def _seen(spans: DataFrame) -> DataFrame:
    """Adds ``seen``, whether a base span (of any kind) overlaps."""
    by = W.partitionBy("doc_id", "tkey")  # both frames grow from their start: a frame that shrinks is summed anew for every row
    behind = F.max(F.when(F.col("base"), F.col("end"))).over(by.orderBy("start").rangeBetween(W.unboundedPreceding, 0))
    ahead = F.min(F.when(F.col("base"), F.col("start"))).over(by.orderBy(F.col("start").desc()).rangeBetween(W.unboundedPreceding, 0))
    return spans.withColumn("seen", F.coalesce(behind > F.col("start"), F.lit(False)) | F.coalesce(ahead < F.col("end"), F.lit(False)))


def fit(spans: DataFrame, balance: int = BALANCE, seed: int = 1):
    """(model, {kind: threshold}) from all wide candidates; None where they are all alike.

    Candidates with equal features are one row with their number. In training those of a label and kind weigh ``balance`` / 8 candidates together at most.
    """
    known = spans.filter((F.col("gen") >= len(BASE)) & F.when(F.col("planted"), F.col("possible")).otherwise(~F.col("seen"))).withColumn("label", (F.col("planted") & ~F.col("contrast")).cast("double"))
    weight = F.when(~F.col("planted") & F.col("possible"), UNLABELLED).otherwise(1.0)
    place = F.pmod(F.xxhash64("doc_id", "tkey", "start"), F.lit(2))  # all spellings of one span on one side
    same = ["kind", "label", "possible", "weight", "place", *FEATURES]
    alike = known.withColumns({"weight": weight, "place": place}).groupBy(*same).agg(F.count("*").alias("stands_for"))
    chosen = stored(alike.sortWithinPartitions(*same))
    sizes = {(r["label"], r["kind"]): r["n"] for r in chosen.groupBy("label", "kind").agg(F.sum("stands_for").alias("n")).collect()}
    if len({label for label, _ in sizes}) < 2:
        return None
    share = F.lit(0.0)
    for (label, kind), n in sizes.items():
        share = F.when((F.col("label") == label) & (F.col("kind") == kind), F.lit(min(1.0, balance / 2 / len(KINDS) / n))).otherwise(share)
    chosen = chosen.withColumn("stands", F.col("weight") * F.col("stands_for")).withColumn("weight", F.col("stands") * share)
    trees = GBTClassifier(labelCol="label", featuresCol="features", weightCol="weight", maxIter=16, maxDepth=5, stepSize=0.3, seed=seed, maxBins=64, cacheNodeIds=False)
    train, calibrate = chosen.filter("place != 0"), chosen.filter("place = 0 and possible")  # only these can be added
    if train.select("label").distinct().count() < 2:
        return None
    model = Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), trees]).fit(train)
    bins = _scored(calibrate, model).groupBy("kind", F.floor(F.col("score") * 100).alias("bin")).agg(
        F.sum(F.col("label") * F.col("stands")).alias("hits"), F.sum("stands").alias("n")).collect()
    limits = {}
    for kind in range(len(KINDS)):
        hits = n = 0.0
        for row in sorted((r for r in bins if r["kind"] == kind), key=lambda r: -r["bin"]):
            hits, n = hits + row["hits"], n + row["n"]
            if row["bin"] >= 50 and hits > 0 and hits >= PRECISION * n:
                limits[kind] = row["bin"] / 100
    return model, limits


def _scored(spans: DataFrame, model) -> DataFrame:
    return model.transform(spans).withColumn("score", vector_to_array("probability").getItem(1)).drop("features", "rawPrediction", "probability", "prediction")


def find(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, tkey and spans, an array of (start, kind, end, base, score) by start, kind and end.

    ``kind`` is a place in KINDS, ends are exclusive, places count code points. Null texts are empty and have no spans. Rows that
    repeat id and text each get their row. An empty table gives an empty result.
    """
    spans = stored(candidates(docs, text, doc_id))
    base = spans.filter("gen is null or base").withColumn("score", F.lit(1.0))
    fitted = fit(spans)
    if fitted and fitted[1]:
        model, limits = fitted
        rest = _scored(spans.filter((F.col("gen") >= len(BASE)) & F.expr("possible and not planted and not seen")), model)
        over = reduce(lambda a, b: a | b, [(F.col("kind") == k) & (F.col("score") >= t) for k, t in limits.items()])
        base = base.unionByName(rest.filter(over).select(*base.columns))
    span = F.when(F.col("gen").isNotNull(), F.struct("start", "kind", "end", "base", "score"))
    found = base.groupBy("doc_id", "tkey").agg(
        F.max(F.when(F.col("gen").isNull(), F.col("copies"))).alias("copies"), F.array_sort(F.array_distinct(F.collect_list(span))).alias("spans"))
    each = F.explode(F.sequence(F.lit(1), F.col("copies")))
    return found.withColumn("_copy", each).select("doc_id", "tkey", "spans")


def digests(found: DataFrame) -> DataFrame:
    """doc_id, counts and digest of the base spans, all spans as text (kind:start:end, comma-joined) and n_added."""
    name = lambda s: F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["kind"] + 1)
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")
    of_kind = lambda k: lambda s: s["base"] & (s["kind"] == k)  # noqa: E731 - a second argument would be taken as the index
    base = F.filter("spans", lambda s: s["base"])
    return found.select(
        "doc_id", *[F.size(F.filter("spans", of_kind(k))).cast("long").alias(f"n_{n}") for k, n in enumerate(KINDS)],
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_added"))


def redacted(docs: DataFrame, found: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with every span of ``find`` replaced by its kind in brackets; spans that overlap the one before are covered by it."""
    marks = found.dropDuplicates(["doc_id", "tkey"]).select(F.col("doc_id").alias("_id"), F.col("tkey").alias("_tkey"), "spans")
    names = [c for c in docs.columns if c != text]
    rows = docs.withColumn("_key", F.xxhash64(text_or_empty(text)))
    met = rows.join(marks, rows[doc_id].eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_tkey")))
    name = lambda s: F.concat(F.lit("["), F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["kind"] + 1), F.lit("]"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    part = lambda a, b: F.substring(F.col(text), (a + 1).cast("int"), (b - a).cast("int"))
    done = F.aggregate("spans", start, lambda acc, s: F.when(s["start"] < acc["at"], F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))).otherwise(
        F.struct(s["end"].alias("at"), F.concat(acc["out"], part(acc["at"], s["start"]), name(s)).alias("out"))))
    tail = F.substring(F.col(text), (F.col("_done.at") + 1).cast("int"), F.char_length(text))
    return met.withColumn("_done", done).select(*names, F.when(F.col(text).isNotNull(), F.concat(F.col("_done.out"), tail)).alias(text)).select(*docs.columns)
