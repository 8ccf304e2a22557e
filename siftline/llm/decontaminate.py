"""Benchmark decontamination: short items inside long documents, by size-partitioned MinHash sketches.

An item is reported where a document holds at least THRESHOLD of its n word shingles, so at most
floor((1 - THRESHOLD) n) are missing. Items are partitioned by size, each partition up to twice its least
size. An item's MinHash sketch is the smallest hashes of its shingles, as many as may be missing at the
partition's largest size and a share more; a document is a candidate if it hits more of the sketch than
may be missing, and if it has as many shingles as the item needs at all. However long the document is,
nothing is lost. Candidates are verified by exact containment over the shingles themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import cut, let, rows_of

WIDTH, THRESHOLD = 5, 0.8
#: Sketches and items are broadcast if they have at most so many rows and shingles, as counted; beyond, joins shuffle.
BROADCAST_ROWS = 500_000
#: Documents to verify whose keys are broadcast at most (16 bytes each), so that only their texts are shuffled; beyond, all texts are.
BROADCAST_DOCS = 500_000
#: A sketch is longer by this share of its partition's largest size, so that a document must hit more of it.
SPARE = 1 / 16
#: Bits of the table that shingles pass before a shuffle: at most 32 MB to broadcast, however many items there are.
BITS = 1 << 28
WORD = r"[\p{L}\p{N}]++"


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _hashes(text: Column) -> Column:
    """Hashes of all shingles of a text; a text of fewer words is one shingle."""

    def of(w: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(w) - WIDTH), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WIDTH)]))
        short = F.array(F.xxhash64(*[F.get(w, F.lit(k)) for k in range(WIDTH)]))
        return F.when(F.size(w) == 0, F.array().cast("array<bigint>")).when(F.size(w) < WIDTH, short).otherwise(each)

    return let(_words(text), of)


def _shingles(text: Column) -> Column:
    """The distinct shingles themselves."""

    def of(w: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(w) - WIDTH), lambda i: F.concat_ws(" ", *[F.get(w, i + k) for k in range(WIDTH)]))
        short = F.array(F.array_join(w, " "))
        return F.when(F.size(w) == 0, F.array().cast("array<string>")).when(F.size(w) < WIDTH, short).otherwise(F.array_distinct(each))

    return let(_words(text), of)


def _sized(shingles: Column, name: str) -> Column:
    """A row (shingle, number of shingles) for each; the number goes with the element, so that no row carries the array."""
    return F.inline_outer(let(shingles, lambda s: F.transform(s, lambda x: F.struct(x.alias("shingle"), F.size(s).alias(name)))))


def sketches(items: DataFrame, threshold: float) -> DataFrame:
    """(item, need, least, shingle) of each item's sketch: hits needed, least size of a document. items: item, text."""
    sets = items.select("item", F.array_sort(F.array_distinct(_hashes(F.col("text")))).alias("h")).where(F.size("h") > 0)
    missing = lambda n: F.floor((1 - threshold) * n + 1e-9).cast("int")
    largest = F.pow(F.lit(2), F.floor(F.log2(F.size("h"))) + 1) - 1  # of the item's partition
    length = F.least(missing(largest) + 1 + F.floor(largest * SPARE).cast("int"), F.size("h"))
    return sets.select(
        "item",
        (length - missing(F.size("h"))).alias("need"),
        (F.size("h") - missing(F.size("h"))).alias("least"),
        F.explode(F.slice("h", F.lit(1), length)).alias("shingle"),
    )


def _bitmap(shingles: DataFrame) -> DataFrame:
    """(bucket, bits): a table of BITS bits, in which those of the shingles are set. It has at most BITS / 2 ** 15 rows of 4 KB."""
    bit = F.pmod(F.xxhash64("shingle"), F.lit(BITS))
    return shingles.select(bit.alias("bit")).groupBy(F.shiftright("bit", 15).alias("bucket")).agg(F.bitmap_construct_agg(F.col("bit") % (1 << 15)).alias("bits"))


def _maybe_in(each: DataFrame, bitmap: DataFrame) -> DataFrame:
    """The rows of each whose shingle's bit is set, so that others never reach a shuffle."""
    bit = F.pmod(F.xxhash64("shingle"), F.lit(BITS))
    place = F.col("_bit") % (1 << 15)
    byte = F.conv(F.hex(F.substring(F.col("bits"), F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = each.withColumn("_bit", bit).join(F.broadcast(bitmap), F.shiftright("_bit", 15) == F.col("bucket"))
    return held.where(F.getbit(byte, F.col("_bit") % 8) == 1).select(*each.columns)


def _meet(each: DataFrame, other: DataFrame, on: Column | str, few: bool) -> DataFrame:
    """each joined to the shingles of other: broadcast if they are few, else by a shuffle of the rows that a bitmap lets through."""
    return each.join(F.broadcast(other), on) if few else _maybe_in(each, cut(_bitmap(other))).join(other, on)


def contained(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """(id, item, n_item, n_shared, containment) of each document and item with a containment of at least the threshold.

    Words are runs of letters and digits, lower-cased; shingles are distinct. Null texts have none
    and match nothing; an item of fewer than five words is one shingle of them all and is found in a
    text of the same words only. Repeated rows are reported once; null ids are ordinary ids, and texts
    that share an id are judged each on its own; items that repeat an id count as one item each; empty
    tables give an empty result; further columns are ignored.
    """
    items = benchmark.select(F.col(item_col).alias("own_item"), F.col(item_text_col).alias("text")).distinct()
    items = items.withColumn("item", F.xxhash64("own_item", "text"))
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("h"))
    sketch = cut(sketches(items, threshold))
    parts = cut(items.select("item", "own_item", _sized(_shingles(F.col("text")), "n_item")).where(F.col("shingle").isNotNull()))
    few = sketch.count() <= BROADCAST_ROWS and parts.count() <= BROADCAST_ROWS
    # A text has no more words, and shingles, than half its bytes and a half: n is no less than the document's size.
    n = F.floor((F.octet_length("text") + 1) / 2).alias("n")
    each = own.select("id", "h", n, rows_of(_hashes(F.col("text")), "shingle"))
    met = _meet(each, sketch, "shingle", few).where(F.col("n") >= F.col("least")).select("id", "h", "item", "need", "shingle").distinct()
    hits = met.groupBy("id", "h", "item", "need").agg(F.count(F.lit(1)).alias("hit")).where(F.col("hit") >= F.col("need"))
    keys = cut(hits.select(F.col("id").alias("i"), F.col("h").alias("hh")).distinct())
    same = F.col("id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("hh"))
    found = own.join(F.broadcast(keys) if keys.count() <= BROADCAST_DOCS else keys, same, "left_semi").dropDuplicates(["id", "h"])
    held = _meet(found.select("id", "h", rows_of(_shingles(F.col("text")), "shingle")), parts, "shingle", few)
    shared = held.groupBy("id", "h", "item", "own_item", "n_item").agg(F.count(F.lit(1)).alias("n_shared"))
    return shared.where(F.col("n_shared") >= F.ceil(F.lit(threshold) * F.col("n_item") - 1e-9)).select(
        F.col("id").alias(id_col),
        F.col("own_item").alias(item_col),
        F.col("n_item").cast("long").alias("n_item"),
        "n_shared",
        (F.col("n_shared") / F.col("n_item")).alias("containment"),
    )


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contained(docs, benchmark)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark
), ds AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)
), bs AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM b WHERE len(w) > 0)
), n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id)
SELECT doc_id, item_id, any_value(n_item)::BIGINT AS n_item, count(*)::BIGINT AS n_shared,
  count(*)::DOUBLE / any_value(n_item) AS containment
FROM ds JOIN bs USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id HAVING 5 * count(*) >= 4 * any_value(n_item)
"""
