"""Size-balanced shards by sampled splitters.

Records are ordered by (content hash, id as a string, row): equal texts lie side by side, and every key is
distinct, so a hot text can be cut anywhere. Size-weighted key samples give quantile boundaries
of many ranges; ranges that turn out overfull are divided again by samples of their own. Exact
sizes of the ranges and running sums inside each give every record its place in the whole order,
and equal slices of the total size are the shards.
"""

from __future__ import annotations

import bisect
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import cut

#: Sampled keys for each range; with 64, a range's size has a standard error of about an eighth.
PER_RANGE = 64
#: Ranges: one for each ROWS_PER_RANGE records, within these limits.
ROWS_PER_RANGE, LEAST_RANGES, MOST_RANGES = 4_000, 64, 1024
#: A range of over so many times the mean size is divided again, in at most ROUNDS rounds.
OVERFULL, ROUNDS = 2.0, 3

KEY = ("h", "id", "row")


def _sample(narrow: DataFrame, total: int, wanted: int) -> list[tuple[tuple, float]]:
    """Keys drawn with a chance in proportion to size: about ``wanted`` of them, however many rows there are."""
    share = F.least(F.lit(1.0), F.col("size") * F.lit(float(wanted)) / F.lit(float(max(total, 1))))
    chance = F.pmod(F.xxhash64(F.lit("draw"), *KEY), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = narrow.where(chance < share).select(*KEY, (F.col("size") / share).alias("weight")).collect()
    return sorted(((r["h"], r["id"], r["row"]), float(r["weight"])) for r in drawn)


def _quantiles(drawn: Sequence[tuple[tuple, float]], pieces: int) -> list[tuple]:
    total, so_far, out = sum(w for _, w in drawn), 0.0, []
    for key, weight in drawn:
        so_far += weight
        if so_far * pieces >= (len(out) + 1) * total and len(out) < pieces - 1:
            out.append(key)
    return out


def _range_of(bounds: list[tuple]) -> Column:
    """The number of boundaries at or below a record's key, as a balanced tree of comparisons."""
    key = F.struct(*KEY)

    def node(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        h, i, r = bounds[mid]
        at = F.struct(F.lit(h).alias("h"), F.lit(i).alias("id"), F.lit(r).cast("long").alias("row"))
        return F.when(key < at, node(lo, mid)).otherwise(node(mid + 1, hi))

    return node(0, len(bounds))


def splitters(narrow: DataFrame, total: int, ranges: int) -> tuple[list[tuple], dict[int, tuple[int, int]]]:
    """(boundaries, {range: (size, rows)}). narrow: h, id, row, size."""
    bounds = _quantiles(_sample(narrow, total, ranges * PER_RANGE), ranges)
    for k in range(ROUNDS + 1):
        sums = narrow.groupBy(_range_of(bounds).alias("range")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows"))
        sizes = {r["range"]: (r["size"], r["rows"]) for r in sums.collect()}
        full = {k: v for k, v in sizes.items() if v[0] > OVERFULL * total / ranges and v[1] > 1}
        if not full or k == ROUNDS:
            return bounds, sizes
        within = narrow.where(_range_of(bounds).isin(*full))
        weight = sum(v[0] for v in full.values())
        drawn = _sample(within, weight, max(PER_RANGE, int(PER_RANGE * 2 * weight * ranges / total)))
        more: set[tuple] = set()
        for r, (size, _) in full.items():
            own = [x for x in drawn if bisect.bisect_right(bounds, x[0]) == r]
            more |= set(_quantiles(own, max(2, round(2 * size * ranges / total))))
        if not more - set(bounds):
            return bounds, sizes
        bounds = sorted(set(bounds) | more)
    raise AssertionError


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, size, text_crc32, shard, slot) for each input row; law: sizes near equal.

    size is the text's UTF-8 bytes plus 1 (null text: 1, checksum 0). A record goes to the shard
    that holds the middle of its bytes in the whole order, so shards differ by a record's size at
    most. slot counts from 0 in each shard without gaps. Repeated rows and null ids are ordinary
    records; ids of any type are kept; an empty table gives an empty result; further columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = cut(
        docs.select(
            F.md5(text.cast("binary")).alias("h"),
            F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
            F.monotonically_increasing_id().alias("row"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.col(id_col).alias("own_id"),
        )
    )
    total, n = narrow.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    ranges = max(LEAST_RANGES, min(MOST_RANGES, n // ROWS_PER_RANGE))
    bounds, sizes = splitters(narrow, total, ranges)
    # Where each range begins, in bytes and rows: one row for each range, at most about 2 * MOST_RANGES.
    begins, at_size, at_row = [], 0, 0
    for r in sorted(sizes):
        begins.append((r, at_size, at_row))
        at_size, at_row = at_size + sizes[r][0], at_row + sizes[r][1]
    begin = docs.sparkSession.createDataFrame(begins, "range int, at_size long, at_row long")
    inside = Window.partitionBy("range").orderBy(*KEY)
    placed = (
        narrow.withColumn("range", _range_of(bounds))
        .withColumn("upto", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("nth", F.row_number().over(inside))
        .join(F.broadcast(begin), "range")
        .withColumn("middle", F.col("at_size") + F.col("upto") - F.col("size") / 2)
        .withColumn("shard", F.least(F.lit(shards - 1), F.floor(F.col("middle") * shards / F.lit(float(max(total, 1))))).cast("int"))
        .withColumn("place", F.col("at_row") + F.col("nth") - 1)
    )
    placed = cut(placed.select("own_id", "size", "text_crc32", "shard", "place"))
    first = placed.groupBy("shard").agg(F.min("place").alias("first"))  # one row for each shard
    return placed.join(F.broadcast(first), "shard").select(
        F.col("own_id").alias(id_col), "size", "text_crc32", "shard", (F.col("place") - F.col("first")).alias("slot")
    )


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns for each row of documents."""
    return shard(docs).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
