"""Sanitising personal data by information theory, with DataFrame functions only.

Personal data of four kinds are found by pattern and are the protected entities. The words of a text outside them are terms
that may reveal them: over all documents it is counted how many hold a term, an entity, and both together, anywhere in
the text. A term discloses an entity when their pointwise mutual information is at least `threshold` of the
entity's information content, and at least `support` documents show both. Entities are replaced by their class, and
disclosing terms at each place of every document that holds the entity.

As no term is in more of the entity's documents than there are, a term of n_term documents can only disclose when
n_term <= n ** (1 - threshold) * n_entity ** threshold; pairs beyond that are not formed, which changes no result.

Spans are code points, end exclusive, sorted by start and kind. Patterns match leftmost and without overlap within
a kind; a match that fails its check (parts of an ip, digits of a phone, Luhn sum of a card) is dropped and not tried again.

Defined cases: null texts are empty and have no span; rows that agree in id and text are judged alike; entities are told apart by kind
and text; copies of a document count as documents; spans of different kinds may overlap, and overlapping ones are
replaced together by the first one's class; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomshift.llm.common import Scratch, columns, fresh

# fixed values: kinds in their order, with patterns that find what the stated ones find. A match begins where the last
# one ended (\G) or where its first run of characters begins, and runs are possessive, so texts are read once.
KINDS = ["email", "ip", "card", "phone"]
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?+[0-9]){11,}+"  # shorter ones fail the check anyway
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TERM = r"\p{L}[\p{L}\p{N}]++"
BLOCK = 256   # matches added up together
PAIRED = 1000  # entities of one document that meet its terms in one place
FREQUENT = 10_000  # most frequent terms, whose counts are broadcast so that none is a hot key

SPANS = "array<struct<start:long,kind:int,end:long,value:string>>"


def luhn(digits: Column) -> Column:
    """Whether the digits pass the check sum of card numbers."""
    signs = F.reverse(F.split(digits, ""))
    def worth(sign: Column, at: Column) -> Column:
        double = sign.cast("int") * (1 + at % 2)
        return F.when(double > 9, double - 9).otherwise(double)
    total = F.aggregate(F.transform(signs, worth), F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def passes(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda part: (F.length(F.ltrim(part, F.lit("0"))) <= 2)
                        | ((F.length(F.ltrim(part, F.lit("0"))) == 3) & (F.ltrim(part, F.lit("0")) <= "255")))
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def bound(value: Column, use) -> Column:
    """`use` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def summed(lengths: Column) -> Column:
    """(at, found) of (before, own) pairs: what they add up to, and where each one's own part begins."""
    return F.aggregate(
        lengths, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<long>").alias("found")),
        lambda acc, x: F.struct((acc["at"] + x["before"] + x["own"]).alias("at"), F.concat(acc["found"], F.array(acc["at"] + x["before"])).alias("found")))


def starts(matches: Column, pieces: Column) -> Column:
    """Begin of each match: what lies between matches and the matches before it, added up. Sums are taken in blocks, so that
    texts with very many matches stay cheap."""
    lengths = F.zip_with(pieces, matches, lambda p, m: F.struct(
        F.length(p).cast("long").alias("before"), F.coalesce(F.length(m), F.lit(0)).cast("long").alias("own")))

    def blocks(all_: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / BLOCK).cast("int"))
        return F.transform(numbers, lambda b: summed(F.slice(all_, b * BLOCK + 1, F.lit(BLOCK))))

    def joined(each: Column) -> Column:
        offsets = summed(F.transform(each, lambda e: F.struct(F.lit(0).cast("long").alias("before"), e["at"].alias("own"))))["found"]
        return F.flatten(F.zip_with(each, offsets, lambda e, o: F.transform(e["found"], lambda s: s + o)))

    return F.when(F.size(matches) > 0, bound(bound(lengths, blocks), joined)).otherwise(F.array().cast("array<long>"))


def checked(k: int, kind: str) -> Column:
    """Spans of one kind that pass its check."""
    begins = F.col(f"_s{k}")
    spans = F.transform(F.col(f"_m{k}"), lambda m, i: F.struct(
        F.get(begins, i).alias("start"), F.lit(k).alias("kind"), (F.get(begins, i) + F.length(m)).alias("end"), m.alias("value")))
    return F.filter(spans, lambda s: passes(kind, s["value"]))


def base_spans(docs: DataFrame, text_col: str) -> DataFrame:
    """Adds _spans, the checked spans of all kinds in order."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    needs = {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike("[0-9][ -]?[0-9]"), "phone": text.contains("+")}
    for k, (kind, pattern) in enumerate(zip(KINDS, [EMAIL, IP, CARD, PHONE], strict=True)):
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        docs = docs.withColumn(f"_m{k}", F.when(needs[kind], found).otherwise(F.array().cast("array<string>")))
    for k, pattern in enumerate([EMAIL, IP, CARD, PHONE]):
        docs = docs.withColumn(f"_p{k}", F.when(F.size(f"_m{k}") > 0, F.split(text, pattern, -1)).otherwise(F.array().cast("array<string>")))
    for k in range(4):
        docs = docs.withColumn(f"_s{k}", starts(F.col(f"_m{k}"), F.col(f"_p{k}")))
    docs = docs.withColumn("_spans", F.array_sort(F.concat(*[checked(k, kind) for k, kind in enumerate(KINDS)])).cast(SPANS))
    return docs.drop(*[f"_{x}{k}" for x in "mps" for k in range(4)])


def blanked(text: Column, spans: Column) -> Column:
    """The text with as many blanks in place of each span, so that terms keep their places."""
    def step(acc: Column, s: Column) -> Column:
        begin, end = F.greatest(acc["at"], s["start"]), F.greatest(acc["at"], s["end"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(
            F.substring(text, (acc["at"] + 1).cast("int"), (begin - acc["at"]).cast("int")),
            F.repeat(F.lit(" "), (end - begin).cast("int")))).alias("out"))
    kept = F.aggregate(spans, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out")), step)
    return bound(kept, lambda k: F.concat(F.array_join(k["out"], ""), F.substring(text, (k["at"] + 1).cast("int"), F.greatest(F.length(text), F.lit(1)))))


def term_spans(text: Column, base: Column, wanted: Column) -> Column:
    """Every place outside the base spans where the text holds a term of `wanted`."""
    def places(clear: Column) -> Column:
        found = F.regexp_extract_all(clear, F.lit(TERM), F.lit(0))
        begins = starts(found, F.split(clear, TERM, -1))
        spans = F.zip_with(found, begins, lambda m, s: F.struct(
            s.alias("start"), F.lit(4).alias("kind"), (s + F.length(m)).alias("end"), F.lower(m).alias("value")))
        return F.filter(spans, lambda s: F.array_contains(wanted, s["value"])).cast(SPANS)
    return F.when(F.size(wanted) > 0, bound(blanked(text, base), places)).otherwise(F.array().cast(SPANS))


def disclosing(rows: DataFrame, texts: DataFrame, threshold: float, support: int, scratch: Scratch) -> DataFrame:
    """(_no, _wanted): the terms to replace in each document. `rows` (_no, _entities, _terms) holds the documents with
    entities, `texts` (text) every document."""
    n = texts.count()
    most = F.lit(float(n)) ** F.lit(1 - threshold) * F.col("n_entity") ** F.lit(threshold) * F.lit(1 + 1e-9)
    # a document of many entities is dealt out by entity
    parts = F.ceil(F.size("_entities") / PAIRED).cast("int")
    entities = rows.select("_no", parts.alias("parts"), F.explode("_entities").alias("entity"))
    entities = entities.select("_no", "entity", F.pmod(F.xxhash64("entity"), "parts").cast("int").alias("salt"))
    of_entity = entities.groupBy("entity").agg(F.count("*").alias("n_entity"))
    of_entity = scratch.store(of_entity.filter((F.col("n_entity") >= support) & (F.col("n_entity") < n)).withColumn("most", most))
    entities = scratch.store(entities.join(of_entity, "entity"))
    of_term = (texts.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0)))).alias("term"))
               .groupBy("term").agg(F.count("*").alias("n_term")).filter(F.col("n_term") >= support))
    of_term = scratch.store(of_term)
    frequent = scratch.store(of_term.orderBy(F.desc("n_term"), "term").limit(FREQUENT))
    # the terms of each document that can disclose one of its entities
    upto = entities.groupBy("_no").agg(F.max("most").alias("upto"))
    held = rows.select("_no", "_terms", parts.alias("parts")).join(upto, "_no").select("_no", "upto", "parts", F.explode("_terms").alias("term"))
    often = held.join(F.broadcast(frequent), "term")
    seldom = held.join(F.broadcast(frequent.select("term")), "term", "left_anti").join(of_term, "term")
    terms = scratch.store(often.unionByName(seldom).filter(F.col("n_term") <= F.col("upto")).drop("upto"))
    dealt = terms.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    pairs = entities.join(dealt, ["_no", "salt"]).filter(F.col("n_term") <= F.col("most"))
    both = pairs.groupBy("entity", "term", "n_entity", "n_term").agg(F.count("*").alias("n_both")).filter(F.col("n_both") >= support)
    shared = F.log2(F.lit(float(n)) * F.col("n_both") / (F.col("n_term") * F.col("n_entity")))
    content = F.log2(F.lit(float(n)) / F.col("n_entity"))
    revealing = scratch.store(both.filter(shared / content >= threshold).select("entity", "term"))
    wanted = pairs.join(revealing, ["entity", "term"]).groupBy("_no").agg(F.collect_set("term").alias("_wanted"))
    wanted = scratch.store(wanted)
    scratch.drop(of_entity, entities, of_term, frequent, terms, revealing)
    return wanted


def listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in [*KINDS, "term"]])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def replaced(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its class; overlapping spans by the first one's."""
    classes = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    kept = F.aggregate(
        spans, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out")),
        lambda acc, s: F.when(s["start"] >= acc["at"], F.struct(
            s["end"].alias("at"),
            F.concat(acc["out"], F.array(
                F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")),
                # a disclosing term is generalised to a name if it is written as one, and removed if not
                F.when(s["kind"] < 4, F.element_at(classes, F.least(s["kind"], F.lit(3)) + 1))
                .when(F.substring(text, (s["start"] + 1).cast("int"), F.lit(1)).rlike(r"\p{Lu}"), "[NAME]").otherwise(""))).alias("out"))
        ).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))))
    return F.concat(F.array_join(kept["out"], ""), F.substring(text, (kept["at"] + 1).cast("int"), F.greatest(F.length(text), F.lit(1))))


def text_key(id_col: str, text_col: str) -> Column:
    return F.md5(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.coalesce(text_col, F.lit(""))).cast("binary"))


def found_by_key(docs: DataFrame, id_col: str, text_col: str, threshold: float, support: int) -> DataFrame:
    """(_key, base, wanted) of the documents with entities, one row per id and text: their spans, and the terms to replace."""
    scratch = Scratch(docs.sparkSession, "pii")
    rows = base_spans(docs.select(text_key(id_col, text_col).alias("_key"), F.col(text_col).alias("_text")), "_text")
    names = F.array(*[F.lit(k) for k in KINDS])
    entities = F.transform("_spans", lambda s: F.concat(F.element_at(names, s["kind"] + 1), F.lit(":"), s["value"]))
    words = F.regexp_extract_all(blanked(F.col("_text"), F.col("_spans")), F.lit(TERM), F.lit(0))
    rows = scratch.store(rows.filter(F.size("_spans") > 0).select(
        F.monotonically_increasing_id().alias("_no"), "_key", "_spans", F.array_distinct(entities).alias("_entities"),
        F.array_distinct(F.transform(words, F.lower)).alias("_terms")))
    wanted = disclosing(rows, docs.select(F.coalesce(text_col, F.lit("")).alias("text")), threshold, support, scratch)
    # rows of one key agree
    out = scratch.store(rows.select("_no", "_key", "_spans").join(wanted, "_no", "left").groupBy("_key").agg(
        F.first("_spans").alias("base"), F.coalesce(F.first("_wanted"), F.array().cast("array<string>")).alias("wanted")))
    scratch.drop(rows, wanted)
    return out


def marked(docs: DataFrame, rows: DataFrame, keep: list[str], id_col: str, text_col: str, threshold: float, support: int) -> tuple[DataFrame, str, str]:
    """The columns `keep`, the text, and a struct of base and all spans (null without entities), with the names of both."""
    key, info, text = fresh(rows, "_key"), fresh(rows, "_found"), fresh(rows, "_text")
    found = found_by_key(docs, id_col, text_col, threshold, support).select(F.col("_key").alias(key), F.struct("base", "wanted").alias(info))
    joined = docs.select(*keep, F.col(text_col).alias(text), text_key(id_col, text_col).alias(key)).join(found, key, "left").drop(key)
    base = F.col(f"{info}.base")
    spans = F.array_sort(F.concat(base, term_spans(F.col(text), base, F.col(f"{info}.wanted"))))
    return joined.withColumn(info, F.when(F.col(info).isNotNull(), F.struct(base.alias("base"), spans.alias("spans")))), text, info


def detect(docs: DataFrame, keep: list[str], id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, support: int = 2) -> DataFrame:
    """The columns `keep` with base (spans of the four kinds) and spans (these and the disclosing terms, kind 4)."""
    none = F.array().cast(SPANS)
    rows = docs.select(*keep)
    all_, _, info = marked(docs, rows, keep, id_col, text_col, threshold, support)
    return all_.select(*columns(rows, ("base", "spans")), F.coalesce(f"{info}.base", none).alias("base"), F.coalesce(f"{info}.spans", none).alias("spans"))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, support: int = 2) -> DataFrame:
    """The documents with entities and disclosing terms replaced; their other columns stay."""
    all_, text, info = marked(docs, docs, columns(docs), id_col, text_col, threshold, support)
    clean = F.when(F.col(info).isNotNull(), replaced(F.col(text), F.col(f"{info}.spans"))).otherwise(F.col(text))
    return all_.withColumn(text_col, clean).select(*columns(docs))
