"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.sources import storage


#: A table of fewer files than cores and less than so much for each core is dealt over all of them: one row group is one task.
SPREAD_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return storage.spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"), SPREAD_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one is made only where none is named."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if named is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="siftline-checkpoint-"))
    return named or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise a narrow frame in the shared folder; it survives lost executors."""
    shared_dir(df.sparkSession)
    return storage.cut(df)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value once, so that lambdas inside ``body`` do not evaluate it for each element."""
    return F.transform(F.array(value), body)[0]


def running(numbers: Column, step: Callable[[Column, Column], Column] = lambda a, x: a + x) -> Column:
    """Inclusive running sums (or greatest values, from 0) of an array, by those of blocks, so that long arrays stay cheap.

    Blocks of the cube root of twice the length make n elements cost about n to the power of 4/3.
    """
    total = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda a, x: step(a, x))

    def with_sums(d: Column, b: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.ceil(F.size(d) / b).cast("int") - 1)
        sums = F.transform(blocks, lambda k: total(F.slice(d, k * b + 1, b)))
        return let(
            sums,
            lambda s: let(
                F.transform(blocks, lambda k: total(F.slice(s, F.lit(1), k))),
                lambda before: F.transform(
                    d, lambda x, i: step(F.get(before, F.floor(i / b).cast("int")), total(F.slice(d, i - i % b + 1, i % b + 1)))
                ),
            ),
        )

    width = lambda d: F.greatest(F.lit(4), F.ceil(F.cbrt(2 * F.size(d)))).cast("int")
    return let(
        numbers, lambda d: F.when(F.size(d) == 0, F.array().cast("array<bigint>")).otherwise(let(width(d), lambda b: with_sums(d, b)))
    )


def rows_of(array: Column, name: str) -> Column:
    """A row for each element. Where there is none, one null row, which an inner join or a filter drops: a plain explode
    would compute the array a second time, for a filter on its size."""
    return F.explode_outer(array).alias(name)


def found(text: Column, pattern: str, part: str = "") -> Column:
    """All leftmost non-overlapping matches, as array<struct<start,end,m>>; offsets in code points, end exclusive.

    part: a string that every match has, which is cheaper to look for.
    """

    def placed(m: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        steps = let(
            gaps,
            lambda g: F.transform(
                m,
                lambda x, i: (F.length(F.get(g, i)) + F.when(i > 0, F.length(F.get(m, i - 1))).otherwise(0)).cast("long"),
            ),
        )
        return let(
            running(steps),
            lambda at: F.transform(
                m,
                lambda x, i: F.struct(
                    F.get(at, i).alias("start"), (F.get(at, i) + F.length(x)).alias("end"), x.alias("m")
                ),
            ),
        )

    none = F.array().cast("array<struct<start:bigint,end:bigint,m:string>>")
    return F.when(
        (F.contains(text, F.lit(part)) & text.rlike(pattern)) if part else text.rlike(pattern),
        let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed),
    ).otherwise(none)


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def of_kind(spans: Column, order: int, kind: str) -> Column:
    return F.transform(
        spans,
        lambda s: F.struct(
            s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind")
        ),
    )
