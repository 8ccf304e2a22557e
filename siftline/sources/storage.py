"""Small files and folders in any store that Hadoop's file systems reach."""

from __future__ import annotations

import contextlib
import tempfile
import threading
import time
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession


def path_of(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = path_of(spark, path)
    return fs.exists(p)


def read_text(spark: SparkSession, path: str) -> str:
    p, fs = path_of(spark, path)
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Write beside, then rename over: readers see the old file or the new one."""
    jvm = spark.sparkContext._jvm
    p, fs = path_of(spark, path)
    beside, _ = path_of(spark, f"{path}.{uuid.uuid4().hex}")
    stream = fs.create(beside)
    stream.write(bytearray(text.encode()))
    stream.close()
    kind = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(
        fs.makeQualified(beside), fs.makeQualified(p), options
    )


def delete(spark: SparkSession, path: str) -> None:
    p, fs = path_of(spark, path)
    fs.delete(p, True)


def delete_quietly(spark: SparkSession, path: str, tell: Callable[[str], None], tries: int = 3) -> None:
    """Delete what nothing needs any more; where that fails, it is told and left to a later time."""
    for k in range(tries):
        try:
            delete(spark, path)
            return
        except Exception as e:
            if k == tries - 1:
                tell(f"{path} couldn't be deleted: {e}")
            time.sleep(0.1 * (k + 1))


def children(spark: SparkSession, path: str) -> list[str]:
    p, fs = path_of(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def size_of(spark: SparkSession, path: str) -> int:
    p, fs = path_of(spark, path)
    return fs.getContentSummary(p).getLength()


def measure(spark: SparkSession, path: str) -> list[int]:
    """[files, bytes] of a folder; [0, 0] without it."""
    p, fs = path_of(spark, path)
    if not fs.exists(p):
        return [0, 0]
    summary = fs.getContentSummary(p)
    return [summary.getFileCount(), summary.getLength()]


def spread(df: DataFrame, bytes_per_core: int) -> DataFrame:
    """Rows read from fewer files than there are cores, and less than so much for each, dealt over all cores; else as they are."""
    spark = df.sparkSession
    files, cores = df.inputFiles(), spark.sparkContext.defaultParallelism
    if 0 < len(files) < cores and sum(size_of(spark, f) for f in files) < cores * bytes_per_core:
        return df.repartition(2 * cores)
    return df


_cuts = threading.local()


def cut(df: DataFrame) -> DataFrame:
    """Materialise a narrow frame in the shared folder; it survives lost executors."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(work_dir(df.sparkSession))
    out = df.checkpoint(eager=True)
    if getattr(_cuts, "made", None) is not None:
        file = out._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
        _cuts.made += [file.get()] if file.isDefined() else []
    return out


@contextlib.contextmanager
def cuts_deleted(spark: SparkSession) -> Iterator[None]:
    """What cut() writes within, in this thread, is deleted at the end. A result must have been written by then."""
    before, _cuts.made = getattr(_cuts, "made", None), []
    try:
        yield
    finally:
        for path in _cuts.made:
            delete_quietly(spark, path, lambda _: None)
        _cuts.made = before


@contextlib.contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """What a query shuffles within is deleted at its end, not when the driver collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


_work: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it; a local one only on a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _work:
        _work[app] = tempfile.mkdtemp(prefix="siftline-")
    return _work[app]
