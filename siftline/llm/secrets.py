"""Secret scans over an incremental blob ledger.

Each version of a text is addressed by its content (SHA-256). A blob is scanned once for a
rule version; what the ledger already holds is not read again. Findings are joined back to
every path (here: document) that carries the blob. The ledger is a folder of Parquet files, one
sub-folder for each rule version, to which every scan appends.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.sources import storage

from .base import cut, found, of_kind, shared_dir, span_text


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    value_group: int  # the group whose length counts
    least: int  # code points in it


# The base rules' keywords, prefixes and lengths. Greedy runs that cannot give
# anything back are possessive, so that no text costs more than linear time.
BASE = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)""", 1, 6),
    # A run that is too short holds no match in any part of it, so the least length can stand in the pattern.
    Rule("access", r"AKIA[A-Z0-9]{16,}+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}+", 0, 24),
)
# Kinds that this scanner adds: private key headers and tokens with a vendor's prefix.
ADDED = (
    Rule("pem", r"-----BEGIN (?:(?!PRIVATE KEY-----)[A-Z]++ )*+PRIVATE KEY-----", 0, 1),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]++", 0, 40),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]++", 0, 15),
    Rule("jwt", r"(?:\G|(?<![A-Za-z0-9_-]))eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++", 0, 30),
)
RULES = BASE + ADDED
VERSION = "v1"
#: Rows to scan, or rows to leave out, are broadcast up to so many (about 100 bytes each); with more of both, texts are shuffled.
BROADCAST_BLOBS = 200_000
#: Blobs with findings that are broadcast at most, so that copies of one blob needn't meet in a task.
BROADCAST_FINDINGS = 50_000
SPANS = "array<struct<start:bigint,order:int,end:bigint,kind:string>>"
LEDGER = f"blob string, spans {SPANS}"


def spans_of(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """All findings of one text, by start, then kind as listed."""
    def long_enough(rule: Rule) -> Column:
        if rule.value_group:
            test = lambda s: F.length(F.regexp_extract(s["m"], rule.pattern, rule.value_group)) >= rule.least
        else:
            test = lambda s: F.length(s["m"]) >= rule.least
        return F.filter(found(text, rule.pattern), test)

    each = [of_kind(long_enough(rule), order, rule.kind) for order, rule in enumerate(rules)]
    return F.array_sort(F.concat(*each))


def rules_version(rules: tuple[Rule, ...] = RULES, version: str = VERSION) -> str:
    """What the ledger calls these rules; other rules have another name, whatever their version says."""
    return f"{version}-{hashlib.sha256(repr(rules).encode()).hexdigest()[:12]}"


def read_ledger(spark: SparkSession, ledger: str, rule_version: str) -> DataFrame:
    """(blob, spans) of the blobs that a ledger has under a rule version; a blob may stand there twice, with the same spans."""
    at = f"{ledger}/rule_version={rule_version}"
    rows = spark.read.schema(LEDGER).parquet(at) if storage.exists(spark, at) else spark.createDataFrame([], LEDGER)
    return rows.select("blob", "spans")


def append(rows: DataFrame, ledger: str, rule_version: str) -> None:
    """Add scanned blobs (blob, spans). Each row is a whole scan, so what a lost append leaves behind is true as well."""
    rows.select("blob", "spans").write.mode("append").parquet(f"{ledger}/rule_version={rule_version}")


def _to_scan(own: DataFrame, keys: DataFrame, unseen: DataFrame) -> DataFrame:
    """The rows of own that carry an unseen blob, one id for each. The shorter of two lists is broadcast: rows to scan, or rows to leave out."""
    same = (F.col("blob") == F.col("b")) & F.col("id").eqNullSafe(F.col("i"))
    wanted = unseen.select(F.col("blob").alias("b"), F.col("carrier").alias("i"))
    if unseen.count() <= BROADCAST_BLOBS:
        return own.join(F.broadcast(wanted), same, "left_semi")
    others = cut(keys.join(wanted, same, "left_anti").distinct())
    if others.count() <= BROADCAST_BLOBS:
        return own.join(F.broadcast(others.toDF("i", "b")), same, "left_anti")
    return own.join(wanted, same, "left_semi")


def scan(
    docs: DataFrame,
    ledger: str,
    rules: tuple[Rule, ...] = RULES,
    version: str = VERSION,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Findings by document: one row (id, blob, spans) for each input row. What is scanned goes to the ledger, a folder.

    Null text counts as empty; repeated rows and equal texts share one scan; null ids are kept; an
    empty table gives an empty result; further columns are ignored. The ledger holds (blob, spans)
    under each rule version; a blob that it has isn't scanned again, under other rules it is.
    """
    spark, name = docs.sparkSession, rules_version(rules, version)
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    own = own.withColumn("blob", F.sha2("text", 256))
    keys = cut(own.select("id", "blob"))
    # One carrier per blob; it alone is scanned.
    carriers = keys.groupBy("blob").agg(F.min("id").alias("carrier"))
    unseen = cut(carriers.join(read_ledger(spark, ledger, name).select("blob"), "blob", "left_anti"))
    append(_to_scan(own, keys, unseen).select("blob", spans_of(F.col("text"), rules).alias("spans")), ledger, name)
    seen = cut(read_ledger(spark, ledger, name).where(F.size("spans") > 0).join(keys.select("blob"), "blob", "left_semi").dropDuplicates(["blob"]))
    seen = F.broadcast(seen) if seen.count() <= BROADCAST_FINDINGS else seen
    empty = F.array().cast(SPANS)
    return keys.join(seen, "blob", "left").select(F.col("id").alias(id_col), "blob", F.coalesce("spans", empty).alias("spans"))


def digest(docs: DataFrame, ledger: str | None = None) -> DataFrame:
    """The contract's columns for each row of documents. Without a ledger a new one is begun in the shared folder."""
    findings = scan(docs, ledger or f"{shared_dir(docs.sparkSession)}/ledger-{uuid.uuid4().hex}")
    base = [r.kind for r in BASE]
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return findings.select(
        "doc_id",
        *[count(k) for k in base],
        F.sha2(span_text(F.filter("spans", lambda s: s["kind"].isin(*base))), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
        "blob",
    )
