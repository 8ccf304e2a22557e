"""SQL functions of the gram index."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, LongType

from .ngrams import covering, fold, gram_hash, gram_hashes


@pandas_udf(ArrayType(LongType()))
def sparse_ngrams(content: pd.Series) -> pd.Series:
    """Distinct gram hashes of a binary's folded bytes, sorted as unsigned; none for null."""
    return content.map(lambda x: gram_hashes(fold(bytes(x))) if x is not None else [])


@pandas_udf(ArrayType(LongType()))
def covering_ngrams(literal: pd.Series) -> pd.Series:
    """Hashes of the grams that a text with this literal must have."""
    return literal.map(lambda x: sorted({gram_hash(g) for g in covering(fold(bytes(x)))}) if x is not None else [])


def register(spark: SparkSession) -> None:
    spark.udf.register("sparse_ngrams", sparse_ngrams)
    spark.udf.register("covering_ngrams", covering_ngrams)
