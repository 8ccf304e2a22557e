"""Index updates from a stream of changed files: each micro-batch is an incremental update."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from siftline.operators import index as ix
from siftline.sources import storage


def apply_changes(root: str, changes: DataFrame) -> ix.BuildStats | None:
    """Put changed files, (path, mtime, size, content), into the index; null content removes.

    The newest row of a path counts, of equal times the one with the greatest content hash (a removal has none and is
    the least). A row that isn't newer than what the index has, or than the removal that it remembers, changes
    nothing, whichever batch it comes in; None if no row does. Rows without a path are left out; a null time is 0.
    """
    with storage.cuts_deleted(changes.sparkSession):
        return _apply_changes(root, changes)


def _apply_changes(root: str, changes: DataFrame) -> ix.BuildStats | None:
    spark, started = changes.sparkSession, time.perf_counter()
    if not storage.exists(spark, f"{root}/CURRENT"):
        empty = spark.createDataFrame([], "path string, mtime long, size long, content binary")
        ix.build(spark, root, empty)
    index = ix.Index.open(spark, root)
    rank = F.struct(F.coalesce("mtime", F.lit(0)).cast("long").alias("mtime"), ix._hash(F.col("content")).alias("content_hash"))
    row = F.struct("size", F.col("content").cast("binary").alias("content"))
    newest = changes.where(F.col("path").isNotNull()).select("path", rank.alias("rank"), row.alias("row")).groupBy("path").agg(F.max("rank").alias("rank"), F.max_by("row", "rank").alias("row"))
    had = index.cache().join(changes.select("path").distinct(), "path", "left_semi").groupBy("path").agg(F.max(F.struct("mtime", "content_hash")).alias("had"))
    new = storage.cut(newest.join(had, "path", "left").where(F.col("had").isNull() | (F.col("rank") > F.col("had"))).select("path", "rank.mtime", "row.size", "row.content"))
    if new.isEmpty():
        return None
    size = F.coalesce("size", F.octet_length("content")).cast("long")
    touched = new.where(F.col("content").isNotNull()).withColumn("size", size)
    removed = new.where(F.col("content").isNull()).select("path", "mtime")
    return ix._apply(spark, root, index, new.select("path"), touched, removed, started, lambda _: None)


def index_stream(changes: DataFrame, root: str, checkpoint: str) -> DataStreamWriter:
    """A writer that keeps the index at root up to date; start() it. A batch that is replayed changes nothing."""
    return changes.writeStream.foreachBatch(lambda batch, _: apply_changes(root, batch) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True)
