"""Corpora from tables: each row is a file whose path is its key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def table_corpus(df: DataFrame, keys: list[str], text: str, mtime: Column | None = None) -> DataFrame:
    """corpus(path, mtime, size, content, *keys). Keys are joined by a slash; null text counts as empty."""
    content = F.coalesce(F.col(text), F.lit(""))
    path = F.concat_ws("/", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    return df.select(
        path.alias("path"),
        (F.lit(0) if mtime is None else mtime).cast("long").alias("mtime"),
        F.octet_length(content).cast("long").alias("size"),
        content.alias("content"),
        *[F.col(k).alias(f"key_{k}") for k in keys],
    )


def indexable(corpus: DataFrame, name: str, max_size: int, binary_extensions: tuple[str, ...]) -> DataFrame:
    """The scanner's row filters on a table: size, NUL in the first 512 bytes, extension of ``name``."""
    extension = F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1))
    head = F.substring(F.col("content").cast("binary"), 1, 512)
    return corpus.where(
        F.col("size").between(1, max_size)
        & ~extension.isin(*[e.lower() for e in binary_extensions])
        & (F.position(F.lit(b"\0"), head) == 0)
    )
