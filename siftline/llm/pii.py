"""Personal data: base spans by pattern, and terms that disclose them by corpus statistics.

A term discloses a protected entity if the corpus says so. Entities are exact strings and what they
share: an email's domain, the beginning of a number, the kind. p(entity) is the share of distinct texts
with the entity, and p(entity | term) is estimated by the other texts, smoothed by p(entity):
(both - 1 + p(entity)) / n_term. pmi = log2(p(entity | term) / p(entity)) is the information that the
term gives about the entity, and at ic(entity) = -log2 p(entity) it gives the entity away. Terms whose
pmi reaches ALPHA * ic are spans wherever they stand, in all texts. Terms count in whole texts, outside
of emails; equal texts count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import cut, found, let, of_kind, rows_of, running, span_text

# Kinds in the contract's order and their patterns. Runs that cannot give anything
# back are possessive; a run is tried only where it begins or where the last match ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
BASE = ("email", "ip", "card", "phone")
TERM = "term"

#: Share of an entity's information that a term must give.
ALPHA = 0.8
#: Terms (a string of letters each) and texts (a hash and what is asked of it) that are broadcast at most; more of them are joined by a shuffle.
BROADCAST_TERMS = 100_000
#: Term spans (24 bytes each) that are broadcast at most, so that copies of one text needn't meet in a task.
BROADCAST_SPANS = 500_000
#: Code points of a block that sanitise() takes a text apart into.
BLOCK = 512
#: A term: a run of letters.
WORD = r"\p{L}{3,}+"

SPAN = "struct<start:bigint,order:int,end:bigint,kind:string>"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    def total(d: Column) -> Column:
        def add(a: Column, i: Column) -> Column:
            x = F.substring(d, F.length(d) - i, F.lit(1)).try_cast("int") * (i % 2 + 1)
            return a + x - F.when(x > 9, 9).otherwise(0)

        return F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), add)

    return let(_digits(m), lambda d: F.when(F.length(d).between(13, 19), total(d) % 10 == 0).otherwise(False))


def _parts(m: Column) -> Column:
    def small(p: Column) -> Column:
        bare = F.regexp_replace(p, "^0+", "")
        return (F.length(bare) <= 3) & (F.coalesce(bare.try_cast("int"), F.lit(0)) <= 255)

    return F.forall(F.split(m, r"\."), small)


def kinds_of(text: Column) -> dict[str, Column]:
    """Matches of each base kind that hold, as array<struct<start,end,m>>."""
    return {
        "email": found(text, EMAIL, "@"),
        "ip": F.filter(found(text, IP, "."), lambda s: _parts(s["m"])),
        "card": F.filter(found(text, CARD), lambda s: _luhn(s["m"])),
        "phone": F.filter(found(text, PHONE, "+"), lambda s: F.length(_digits(s["m"])).between(9, 15)),
    }


def _entities(kind: str, spans: Column) -> Column:
    """Entities of each span: the kind, the string, and what strings share."""

    def of(s: Column) -> Column:
        m = F.lower(s["m"])
        if kind == "email":
            wider = F.array(F.substring_index(m, "@", -1))
        elif kind == "ip":
            wider = F.array(F.substring_index(m, ".", 2), F.substring_index(m, ".", 3))
        else:
            wider = F.array(F.substring(_digits(m), 1, 4), F.substring(_digits(m), 1, 6))
        return F.concat(F.array(F.lit(kind), F.concat(F.lit(f"{kind}:"), m)), F.transform(wider, lambda x: F.concat(F.lit(f"{kind}~"), x)))

    return F.flatten(F.transform(spans, of))


def _outside(text: Column) -> Column:
    """The text with its emails blanked, code point by code point, so that places stay."""

    def blanked(ms: Column) -> Column:
        size = lambda i: F.coalesce(F.length(F.get(ms, i)), F.lit(0))
        return F.array_join(F.transform(F.split(text, EMAIL, -1), lambda gap, i: F.concat(gap, F.repeat(F.lit(" "), size(i)))), "")

    return F.when(F.contains(text, F.lit("@")), let(F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0)), blanked)).otherwise(text)


def _terms(text: Column) -> Column:
    """The distinct terms of a text, outside of emails."""
    return F.array_distinct(F.regexp_extract_all(F.lower(_outside(text)), F.lit(WORD), F.lit(0)))


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_TERMS else df


def _common(n_term: DataFrame) -> DataFrame:
    """The terms of the largest counts, as many as may be broadcast: all from the least power of two on that leaves no more."""
    power = F.floor(F.log2("n_term")).cast("int")
    rows = {r["p"]: r["n"] for r in n_term.groupBy(power.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    least, so_far = 63, 0
    while least > 0 and so_far + rows.get(least - 1, 0) <= BROADCAST_TERMS:
        least -= 1
        so_far += rows.get(least, 0)
    return n_term.where(F.col("n_term") >= F.lit(1 << least)).toDF("c", "n_common")


def telling(own: DataFrame, spans: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """(term, entity) of terms that give an entity away. own: text, h; spans: h, entities and terms of each row.

    Entities that the same texts hold are one, that of the least name. Terms of all texts are counted by partial
    sums before any shuffle. Only the terms of texts with an entity meet entities, and a term that stands in more
    texts than any term telling of the entity can is left out before: with all of an entity's texts, pmi reaches
    the threshold at n_term <= (n_entity - 1 + p) * p ** (alpha - 1) and no further.
    """
    n = float(max(spans.select("h").distinct().count(), 1))
    copies = cut(spans.groupBy("h").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1").withColumnRenamed("h", "c"))
    # Each row of a repeated text counts as a share of one, so that no pairs of text and term are shuffled.
    weighted = own.join(_few(copies), F.col("h") == F.col("c"), "left").withColumn("w", 1 / F.coalesce("copies", F.lit(1)))
    counted = weighted.select("w", rows_of(_terms(F.col("text")), "term")).where("term IS NOT NULL").groupBy("term").agg(F.round(F.sum("w")).cast("long").alias("n_term"))
    n_term = cut(counted.where("n_term > 1"))
    with_some = spans.where(F.size("entities") > 0)
    holds = cut(with_some.select("h", F.explode("entities").alias("entity")).distinct())
    # Where one text alone shows an entity, or a pair, no other text tells of it: its pmi is at most 0.
    holders = (F.bit_xor(F.xxhash64("h")).alias("x"), F.bit_xor(F.xxhash64("h", F.lit(1))).alias("y"))
    supported = holds.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"), *holders).where("n_entity > 1")
    p = F.col("n_entity") / n
    most = (F.col("n_entity") - 1 + p) * F.pow(p, F.lit(alpha - 1)) * (1 + 1e-9)
    entities = cut(supported.groupBy("n_entity", "x", "y").agg(F.min("entity").alias("entity")).select("entity", F.struct("entity", "n_entity", most.alias("most")).alias("e")))
    asked = holds.join(entities, "entity").groupBy("h").agg(F.collect_list("e").alias("es"))
    near = with_some.select("h", "terms").dropDuplicates(["h"]).join(asked, "h").select("es", F.explode("terms").alias("term"))
    known = near.join(F.broadcast(_common(n_term)), F.col("term") == F.col("c"), "left")
    rare = F.filter("es", lambda e: F.col("n_common").isNull() | (F.col("n_common") <= e["most"]))
    pairs = known.select("term", rows_of(rare, "e")).where("e IS NOT NULL").groupBy("e.entity", "e.n_entity", "term").agg(F.count(F.lit(1)).alias("both"))
    return (
        pairs.where("both > 1")
        .join(n_term, "term")
        .withColumn("ic", -F.log2(p))
        .withColumn("pmi", F.log2((F.col("both") - 1 + p) / F.col("n_term") / p))
        .where((F.col("ic") > 0) & (F.col("pmi") >= alpha * F.col("ic")))
        .select("term", "entity")
    )


def protect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = ALPHA) -> DataFrame:
    """One row (id, spans) for each input row: base spans by kind, then start, then term spans.

    Null text has no spans; repeated rows get equal results and count once in the statistics; null
    ids are kept; an empty table gives an empty result; further columns are ignored. Terms stand
    outside of emails, and the other kinds have no letters, so no term span lies in a base span.
    """
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("h", F.md5(F.col("text").cast("binary")))
    text = F.col("text")
    with_kinds = own.select("id", "h", "text", *[v.alias(k) for k, v in kinds_of(text).items()])
    some = F.lit(False)
    for k in BASE:
        some = some | (F.size(k) > 0)
    spans = cut(
        with_kinds.select(
            "id",
            "h",
            F.concat(*[of_kind(F.col(k), i, k) for i, k in enumerate(BASE)]).alias("base"),
            F.array_distinct(F.concat(*[_entities(k, F.col(k)) for k in BASE])).alias("entities"),
            F.when(some, _terms(text)).alias("terms"),
        )
    )
    terms = cut(telling(own, spans, alpha).select("term").distinct())
    told = own.select("h", rows_of(_terms(text), "term")).join(_few(terms), "term", "left_semi")
    marked = cut(told.groupBy("h").agg(F.collect_set("term").alias("ts")).withColumnRenamed("h", "g"))
    at = own.join(_few(marked), F.col("h") == F.col("g")).select(
        F.col("h").alias("hh"),
        F.transform(
            F.filter(found(_outside(text), WORD), lambda w: F.array_contains("ts", F.lower(w["m"]))),
            lambda w: F.struct(w["start"].alias("start"), F.lit(len(BASE)).alias("order"), w["end"].alias("end"), F.lit(TERM).alias("kind")),
        ).alias("terms"),
    )
    at = cut(at.dropDuplicates(["hh"]))
    n_spans = at.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    joined = spans.select("id", "h", "base").join(F.broadcast(at) if n_spans <= BROADCAST_SPANS else at, F.col("h") == F.col("hh"), "left")
    return joined.select(F.col("id").alias(id_col), F.concat("base", F.coalesce("terms", F.array().cast(f"array<{SPAN}>"))).alias("spans"))


def _pieces(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets. Spans that overlap are one, named after the first."""
    upto = lambda s: running(F.transform(s, lambda x: x["end"]), F.greatest)

    def merged(s: Column) -> Column:
        first = lambda ends: F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (x["start"] >= F.get(ends, i - 1)), F.struct(x["start"].alias("start"), x["kind"].alias("kind"), i.alias("i")))), lambda x: x.isNotNull())
        return let(upto(s), lambda ends: let(first(ends), lambda fs: F.transform(fs, lambda f, k: F.struct(f["start"].alias("start"), F.get(ends, F.coalesce(F.get(fs, k + 1)["i"] - 1, F.size(s) - 1)).alias("end"), f["kind"].alias("kind")))))

    def rebuilt(blocks: Column) -> Column:
        def part(start: Column, end: Column) -> Column:
            """Of the text, from its blocks, so that no step walks the text from its beginning."""
            b = F.floor(start / BLOCK).cast("int")
            some = F.transform(F.slice(blocks, b + 1, F.floor(end / BLOCK).cast("int") - b + 1), lambda x: x)
            return F.substring(F.array_join(some, ""), (start - b * BLOCK + 1).cast("int"), (end - start).cast("int"))

        def joined(m: Column) -> Column:
            end_of = lambda k: F.coalesce(F.get(m, k)["end"], F.lit(0).cast("long"))
            each = F.transform(m, lambda x, k: F.concat(part(end_of(k - 1), x["start"]), F.lit("["), F.upper(x["kind"]), F.lit("]")))
            last = end_of(F.size(m) - 1)
            return F.concat(F.array_join(each, ""), part(last, F.length(text).cast("long")))

        return let(merged(spans), joined)

    return F.when(F.size(spans) == 0, text).otherwise(let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}+"), F.lit(0)), rebuilt))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, clean_text) for each input row: each base span generalised to its kind in brackets, each disclosing term removed to [TERM].

    Null text becomes an empty one; rows that share an id keep texts of their own.
    """
    key = F.md5(F.col("text").cast("binary"))
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("k", key)
    each = own.dropDuplicates(["k"])  # spans depend on the text alone
    marked = protect(each, "k", "text").toDF("g", "spans")
    both = own.join(marked, F.col("k") == F.col("g"))
    return both.select(F.col("id").alias(id_col), _pieces(F.col("text"), F.array_sort("spans")).alias("clean_text"))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns for each row of documents."""
    base = lambda: F.filter("spans", lambda s: s["kind"] != TERM)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return protect(docs).select(
        "doc_id",
        *[count(k) for k in BASE],
        F.sha2(span_text(base()), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
        count(TERM),
    )
