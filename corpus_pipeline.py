"""A training-data pipeline over documents: each stage's result is written and read again as the next one's documents."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm import decontaminate, jaccard, linededup, packing, quality, simhash
from siftline.llm.base import shared_dir, table
from siftline.sources import storage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
OTHERS = ("lang", "source", "n_chars")


# Within a stage a document is its id and its text's hash, so that rows that share an id or have none are told apart. Rows of
# equal ids and texts are one document: they stay or go together. Ids may be null, texts null, empty or very long; an empty
# table gives an empty result; columns beyond those of documents are left out.
def _h() -> Column:
    return F.xxhash64("text")


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of docs whose (id, hash of the text) isn't in gone (i, h)."""
    return docs.select(*COLUMNS).join(gone, (_h() == F.col("h")) & F.col("doc_id").eqNullSafe(F.col("i")), "left_anti")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learned list reject go; null and empty texts are among them. Each row is judged on its own."""
    judged = quality.judge(docs, table(spark, sf_dir, "labels"), keep=("text", *OTHERS))
    return judged.where("kept").select("doc_id", *[F.col(f"kept_columns.{c}").alias(c) for c in ("text", *OTHERS)])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go; a document that they leave nothing of goes, too. Null texts and texts of white space that lose nothing stay."""
    done = linededup.dedup_lines(docs, keep=OTHERS)
    left = done.where((F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
    n_chars = F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("text"))
    return left.select("doc_id", "text", "lang", "source", n_chars.cast("long").alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the least id (null ids last), then of the least hash.

    Linked are texts within SimHash's 2 bits, and texts whose five-word shingles have a Jaccard similarity of 0.8 or more
    (see jaccard); no such link is lost, though only links between groups that others leave apart are looked for in all pairs.
    Null texts and texts without words aren't duplicates of each other.
    """
    key = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("i"), _h().alias("h"))
    with storage.shuffles_deleted(spark):
        groups = simhash.near_duplicates(docs.select(key.alias("key"), "text"), "key", more=jaccard.links(docs))
    return _without(docs, groups.where((F.col("fp") != 0) & (F.col("key") != F.col("component_id"))).select("key.i", "key.h"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Null texts hold none."""
    key = F.struct(F.col("doc_id").alias("i"), _h().alias("h"))
    return _without(docs, decontaminate.contained(docs.select(key.alias("key"), "text"), table(spark, sf_dir, "benchmark"), "key").select("key.i", "key.h").distinct())


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 tokens. A null text is one end id; each row is a document of its own."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing_stage),
]

# A tokenizer's ids, a learned list and SimHash components aren't SQL; tests/llm has brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    at = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        with storage.cuts_deleted(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}-{name}")
        docs = spark.read.parquet(f"{at}/{k}-{name}")
        if k:
            storage.delete(spark, f"{at}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
