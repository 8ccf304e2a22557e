"""The index: sparse-gram postings of a corpus as Parquet tables, in immutable segments behind a pointer.

<root>/CURRENT names the live version; v<N>/MANIFEST.json lists its segments, their sizes and counts, and
  dead         segment, file_id        files of a segment that changed or went later
  dead_counts  gram, n                 how many of a gram's postings are dead
segments/s<N>/ holds
  grams     file_id, path, mtime, size, content_hash, n_grams, chunk, nth   one row for each row of the corpus
  files     file_id, path, mtime, size                        one row for each path, sorted by file_id
  postings  chunk, gram, n, ids                               one row for each gram of a chunk, by gram; the chunk's files stand there, too
  counts    gram, n                                           files of each gram, sorted in each of some ranges
A chunk is some files that one task indexed, with the places in it (nth, coded as distances) of the files that have a gram.
So no posting is shuffled, and one takes about two bytes; a lookup reads the pages of each chunk that can have the gram.
An update writes a segment of what changed; when there are many segments or many dead files, all live rows
become one segment. Chunks are bounded, so that a gram that all files have is spread over many of them. Rows of the
corpus that share a path are one file, which has the grams of all of them.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass
from functools import cached_property, partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions import ngrams
from siftline.plans.planner import QueryPlan, decompose
from siftline.sources import storage

from .search import file_id, verify

FORMAT = 3
#: With more candidates than this share of the files, postings aren't worth the join; the corpus is scanned.
SCAN_SHARE = 0.6
#: Candidates are broadcast, up to so many (8 bytes each); texts are never shuffled to meet them. With more, the corpus is scanned.
BROADCAST_IDS = 4_000_000
#: Up to so many postings, as counted before they are read, are intersected by the driver instead, without a shuffle.
DRIVER_POSTINGS = 50_000
#: Up to so many candidates stand in the filter itself; more are broadcast as a table.
LISTED_IDS = 200
#: In an index of so many files, candidates that the driver knows are also looked up by the corpus's own key, so that its row groups can be left out.
KEYED_FILES, KEYED_IDS = 1_000_000, 1_000
#: Counts of so many grams (16 bytes each) are kept by the driver of an open index; those of larger ones are looked up.
HELD_GRAMS = 2_000_000
#: The rarest grams of a branch that are looked up. Any of them would do; further ones only narrow.
GRAMS_PER_BRANCH = 8
#: Changed paths and dead files that are broadcast at most (a path each); more of them are joined by a shuffle.
BROADCAST_PATHS = 200_000
#: With more segments, or a larger share of dead files, an update writes all live rows as one segment.
MOST_SEGMENTS, MOST_DEAD = 8, 0.3
#: A corpus of fewer and smaller input files than this for each core is spread over all cores to be indexed.
SPREAD_BYTES = 32 << 20

#: Counts are summed by ranges of grams, one after the other, of about so many postings each, and so many ranges at most.
COUNTED, COUNT_RANGES = 64_000_000, 16
#: Files whose places in chunks are broadcast at most (24 bytes each).
BROADCAST_PLACES = 1_000_000
#: Hashes in order are distances of few bits: no dictionaries, but pages that code such.
CODED = {"parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "false", "compression": "zstd"}

TABLES = {
    "grams": "file_id long, path string, mtime long, size long, content_hash string, n_grams int, chunk long, nth int",
    "files": "file_id long, path string, mtime long, size long",
    "postings": "chunk long, gram long, n int, ids binary",
    "counts": "gram long, n long",
}
DEAD, DEAD_COUNTS = "segment string, file_id long", "gram long, n long"
#: The size that the row of a removed path has; it has no grams and is no file, but tells late changes apart.
REMOVED = -1


class CorruptIndex(RuntimeError):
    pass


@dataclass(frozen=True)
class BuildStats:
    files: int
    bytes_read: int
    ngrams: int
    postings: int
    index_bytes: int
    reused_files: int
    seconds: float


def _hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def _chunks(corpus: DataFrame) -> DataFrame:
    """Rows of CHUNK_SCHEMA. corpus may have reused and content_hash."""
    reused = F.col("reused") if "reused" in corpus.columns else F.lit(False).alias("reused")
    keep = [file_id(F.col("path")).alias("file_id"), "path", "mtime", "size", _hash(F.col("content")).alias("content_hash"), reused]
    return corpus.select(*keep, F.col("content").cast("binary").alias("content")).mapInArrow(ngrams.chunks_of_batches, ngrams.CHUNK_SCHEMA)


def _together(corpus: DataFrame, repeated: DataFrame) -> DataFrame:
    """The corpus with the rows of each repeated path beside each other."""
    paths = _few(repeated)
    more = corpus.join(paths, "path", "left_semi").repartition("path").sortWithinPartitions("path")
    return corpus.join(paths, "path", "left_anti").unionByName(more)


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_PATHS else df


def _read(spark: SparkSession, schema: str, *paths: str) -> DataFrame:
    """Pages are checked against their checksums, so that damage is an error and never a lost match."""
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("parquet.page.verify-checksum.enabled", "true").parquet(*paths)


def _sorted(df: DataFrame, *by: str) -> DataFrame:
    return df.repartitionByRange(*by).sortWithinPartitions(*by)


def _write_segment(
    spark: SparkSession, root: str, name: str, corpus: DataFrame | None, tell: Callable[[str], None], kept: DataFrame | None = None, removed: DataFrame | None = None
) -> dict:
    """Write a segment of a corpus, rows of CHUNK_SCHEMA that are kept, and removed paths (rows of the grams table); what the manifest says of it."""
    with storage.shuffles_deleted(spark):
        at = f"{root}/segments/{name}"
        tell(f"writing postings to {at}")

        def write(rows: DataFrame | None) -> DataFrame:
            rows = kept if rows is None else rows if kept is None else rows.unionByName(kept)
            storage.delete(spark, f"{at}/postings")
            rows.write.options(**CODED).option("parquet.block.size", 32 << 20).parquet(f"{at}/postings")
            return spark.read.schema(ngrams.CHUNK_SCHEMA).parquet(f"{at}/postings").where("nth IS NOT NULL")

        rows = write(None if corpus is None else _chunks(corpus))
        if corpus is not None:
            repeated = storage.cut(rows.groupBy("path").agg(F.count_distinct("chunk", "nth").alias("n")).where("n > 1").select("path"))
            if not repeated.isEmpty():
                rows = write(_chunks(_together(corpus, repeated)))
        tell("writing files")
        held = rows.select(*[c.split()[0] for c in TABLES["grams"].split(", ")], "reused")
        (held if removed is None else held.unionByName(removed.select(held.columns))).write.parquet(f"{at}/grams")
        live = spark.read.parquet(f"{at}/grams").where(F.col("size") != REMOVED)
        read, most = live.agg(F.coalesce(F.sum(F.when(~F.col("reused"), F.col("size"))), F.lit(0)), F.coalesce(F.sum("n_grams"), F.lit(0))).first()
        paths = live.groupBy("file_id", "path").agg(F.max("mtime").alias("mtime"), F.sum("size").alias("size"), F.min("reused").alias("reused"))
        _sorted(paths, "file_id").write.parquet(f"{at}/files")
        files, reused = spark.read.parquet(f"{at}/files").agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("reused").cast("long")), F.lit(0))).first()
        tell("counting")
        each, k = _read(spark, TABLES["postings"], f"{at}/postings"), min(COUNT_RANGES, most // COUNTED + 1)
        for i in range(k):
            low, high = ((j << 64) // k - (1 << 63) for j in (i, i + 1))
            some = each.where(F.col("gram").between(low, high - 1)).select("gram", "n").repartition("gram").groupBy("gram").agg(F.sum("n").cast("long").alias("n"))
            some.sortWithinPartitions("gram").write.mode("append").options(**CODED).parquet(f"{at}/counts")
        ngrams_, n_postings = spark.read.parquet(f"{at}/counts").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        tables = {t: storage.measure(spark, f"{at}/{t}") for t in TABLES}
        return {"name": name, "files": files, "reused": reused, "read": read, "ngrams": ngrams_, "postings": n_postings, "tables": tables}


def _names(spark: SparkSession, root: str) -> tuple[str, str]:
    """Names of a version and a segment that nothing has yet, be it left by a build that failed."""
    after = lambda folder, letter: letter + str(1 + max([int(x[1:]) for x in storage.children(spark, folder) if x[:1] == letter and x[1:].isdigit()], default=0))
    return after(root, "v"), after(f"{root}/segments", "s")


def _publish(spark: SparkSession, root: str, version: str, manifest: dict, tell: Callable[[str], None]) -> None:
    """Point to a version that is written; the one before stays for readers that have it open."""
    before = _current(spark, root)
    storage.replace_text(spark, f"{root}/{version}/MANIFEST.json", json.dumps({"format": FORMAT} | manifest))
    storage.replace_text(spark, f"{root}/CURRENT", version)
    tell(f"published {version}")
    used = {s["name"] for s in manifest["segments"]}
    try:
        used |= {s["name"] for s in json.loads(storage.read_text(spark, f"{root}/{before}/MANIFEST.json"))["segments"]} if before else set()
    except Exception:  # what can't be read has no readers
        before = None
    gone = [f"{root}/{v}" for v in storage.children(spark, root) if v[:1] == "v" and v[1:].isdigit() and v not in (version, before)]
    gone += [f"{root}/segments/{s}" for s in storage.children(spark, f"{root}/segments") if s not in used]
    for path in gone:
        storage.delete_quietly(spark, path, tell)


def _current(spark: SparkSession, root: str) -> str | None:
    if not storage.exists(spark, f"{root}/CURRENT"):
        return None
    name = storage.read_text(spark, f"{root}/CURRENT").strip()
    return name if name.startswith("v") and name[1:].isdigit() else None


def _whole(spark: SparkSession, root: str, corpus: DataFrame, started: float, tell: Callable[[str], None], **more: DataFrame | None) -> BuildStats:
    """Publish a version of one segment."""
    version, name = _names(spark, root)
    s = _write_segment(spark, root, name, corpus, tell, **more)
    size = sum(t[1] for t in s["tables"].values())
    stats = BuildStats(s["files"], s["read"], s["ngrams"], s["postings"], size, s["reused"], time.perf_counter() - started)
    _publish(spark, root, version, asdict(stats) | {"segments": [s], "dead": 0}, tell)
    return stats


def build(spark: SparkSession, root: str, corpus: DataFrame, progress: Callable[[str], None] | None = None) -> BuildStats:
    """Index a corpus(path, mtime, size, content) from nothing. Rows that share a path are one file."""
    with storage.cuts_deleted(spark):
        return _whole(spark, root, storage.spread(corpus, SPREAD_BYTES), time.perf_counter(), progress or (lambda _: None))


def update(
    spark: SparkSession,
    root: str,
    corpus: DataFrame,
    always_hash: bool = False,
    progress: Callable[[str], None] | None = None,
    listing: DataFrame | None = None,
    contents: Callable[[DataFrame], DataFrame] | None = None,
) -> BuildStats:
    """Index a corpus again, using what the live version has.

    A path whose rows have the same times and sizes as before is left as it is, without reading its content. Rows
    of other paths are indexed anew; those of a content that the path had before count as reused, not as read.
    Paths that went are left out. Without a readable version this is a full build. listing: (path, mtime, size)
    of the corpus, where it can be had for less; contents: makes rows of a corpus from some of the listing's.
    """
    started = time.perf_counter()
    with storage.cuts_deleted(spark):
        return _update(spark, root, corpus, always_hash, progress, listing, contents, started)


def _update(
    spark: SparkSession, root: str, corpus: DataFrame, always_hash: bool, progress: Callable[[str], None] | None,
    listing: DataFrame | None, contents: Callable[[DataFrame], DataFrame] | None, started: float,
) -> BuildStats:
    try:
        index = Index.open(spark, root)
    except (FileNotFoundError, CorruptIndex):
        return build(spark, root, corpus, progress)
    # One row for each path and side; repeated rows count.
    mark = [F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("mtime", "size").cast("decimal(38,0)")).alias("sum")]
    here = (corpus if listing is None else listing).groupBy("path").agg(*mark)
    had = index.cache().where(F.col("size") != REMOVED).groupBy("path").agg(*mark)
    both = here.alias("a").join(had.alias("b"), "path", "full")
    same = F.lit(not always_hash) & F.col("a.n").eqNullSafe(F.col("b.n")) & F.col("a.sum").eqNullSafe(F.col("b.sum"))
    changed = storage.cut(both.where(~same).select("path", F.col("a.n").isNotNull().alias("here")))
    own = corpus if contents is None or listing is None else listing
    touched = own.join(_few(changed.where("here").select("path")), "path", "left_semi")
    touched = touched if own is corpus else contents(touched)
    return _apply(spark, root, index, changed.select("path"), touched, None, started, progress or (lambda _: None))


def _apply(
    spark: SparkSession, root: str, index: Index, changed: DataFrame, touched: DataFrame, removed: DataFrame | None, started: float, tell: Callable[[str], None]
) -> BuildStats:
    """Publish a version in which the rows of changed paths are those of touched; removed: (path, mtime) to remember."""
    paths = _few(changed)
    old = index.cache().join(paths, "path", "left_semi")
    known = old.where(F.col("size") != REMOVED).select("path", F.col("content_hash").alias("_had")).distinct()
    hashed = touched.withColumn("_hash", _hash(F.col("content")))
    corpus = hashed.join(known.withColumnRenamed("path", "_path"), (F.col("path") == F.col("_path")) & (F.col("_hash") == F.col("_had")), "left")
    corpus = corpus.select("path", "mtime", "size", "content", F.col("_had").isNotNull().alias("reused"))
    marks = None
    if removed is not None:
        marks = removed.select(file_id(F.col("path")).alias("file_id"), "path", "mtime", F.lit(REMOVED).cast("long").alias("size"), F.lit(None).cast("string").alias("content_hash"))
        marks = marks.select("*", F.lit(0).alias("n_grams"), F.lit(None).cast("long").alias("chunk"), F.lit(None).cast("int").alias("nth"), F.lit(True).alias("reused"))
    m = index.manifest
    gone = storage.cut(old.select("segment", "file_id", "size").distinct())
    n_gone = gone.where(F.col("size") != REMOVED).select("file_id").distinct().count()
    if len(m["segments"]) + 1 > MOST_SEGMENTS or m["dead"] + n_gone > MOST_DEAD * max(m["files"], 1):
        cache = index.cache()
        kept = cache.join(paths, "path", "left_anti")
        before = kept.where(F.col("size") == REMOVED).withColumn("reused", F.lit(True)).drop("segment")
        marks = before if marks is None else marks.unionByName(before.select(marks.columns))
        return _whole(spark, root, corpus, started, tell, kept=index.kept(kept.where(F.col("size") != REMOVED)), removed=marks)
    version, name = _names(spark, root)
    s = _write_segment(spark, root, name, corpus, tell, removed=marks)
    at = f"{root}/{version}"
    index.dead().unionByName(gone.select("segment", "file_id").distinct()).write.parquet(f"{at}/dead")
    lost = storage.cut(index.grams_of(old.where(F.col("size") != REMOVED)).select("file_id", "gram").distinct().groupBy("gram").agg(F.count(F.lit(1)).alias("n")))
    index.dead_counts().unionByName(lost).groupBy("gram").agg(F.sum("n").alias("n")).write.parquet(f"{at}/dead_counts")
    more = _read(spark, TABLES["counts"], f"{root}/segments/{name}/counts")
    # Only grams of what changed can come or go.
    asked = storage.cut(more.select("gram").unionByName(lost.select("gram")).distinct())
    before = index.counts().join(_few(asked), "gram", "left_semi")
    signed = before.select("gram", "n", F.lit(0).alias("change")).unionByName(more.select("gram", F.lit(0).alias("n"), F.col("n").alias("change"))).unionByName(lost.select("gram", F.lit(0).alias("n"), (-F.col("n")).alias("change")))
    each = signed.groupBy("gram").agg(F.sum("n").alias("n"), F.sum("change").alias("change"))
    came = each.agg(F.coalesce(F.sum((F.col("n") + F.col("change") > 0).cast("long") - (F.col("n") > 0).cast("long")), F.lit(0))).first()[0]
    n_lost = lost.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    files = m["files"] - n_gone + s["files"]
    segments = [*m["segments"], s]
    extra = {t: storage.measure(spark, f"{at}/{t}") for t in ("dead", "dead_counts")}
    size = sum(t[1] for x in segments for t in x["tables"].values()) + sum(t[1] for t in extra.values())
    stats = BuildStats(files, s["read"], m["ngrams"] + came, m["postings"] - n_lost + s["postings"], size, files - s["files"] + s["reused"], time.perf_counter() - started)
    _publish(spark, root, version, asdict(stats) | {"segments": segments, "dead": m["dead"] + n_gone, "extra": extra}, tell)
    return stats


@dataclass(frozen=True)
class Index:
    spark: SparkSession
    root: str
    version: str
    manifest: dict

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> Index:
        """FileNotFoundError without an index, CorruptIndex for one that can't be trusted: each table must have the files and bytes that the manifest says."""
        if not storage.exists(spark, f"{root}/CURRENT"):
            raise FileNotFoundError(root)
        version = _current(spark, root)
        at = f"{root}/{version}"
        if version is None or not storage.exists(spark, f"{at}/MANIFEST.json"):
            raise CorruptIndex(f"{root}: the live version isn't there")
        try:
            manifest = json.loads(storage.read_text(spark, f"{at}/MANIFEST.json"))
            if manifest["format"] != FORMAT:
                raise CorruptIndex(f"{at}: another format")
            tables = {f"{root}/segments/{s['name']}/{t}": s["tables"][t] for s in manifest["segments"] for t in TABLES}
            tables |= {f"{at}/{t}": size for t, size in manifest.get("extra", {}).items()}
        except CorruptIndex:
            raise
        except Exception as e:
            raise CorruptIndex(f"{at}: {e}") from e
        for path, size in tables.items():
            if storage.measure(spark, path) != size:
                raise CorruptIndex(f"{path}: not as it was written")
        return cls(spark, root, version, manifest)

    def _segments(self, table: str) -> list[str]:
        return [f"{self.root}/segments/{s['name']}/{table}" for s in self.manifest["segments"]]

    def _extra(self, table: str, schema: str) -> DataFrame:
        return _read(self.spark, schema, *([f"{self.root}/{self.version}/{table}"] if "extra" in self.manifest else []))

    def dead(self) -> DataFrame:
        return self._extra("dead", DEAD)

    def dead_counts(self) -> DataFrame:
        return self._extra("dead_counts", DEAD_COUNTS)

    def _live(self, table: str) -> DataFrame:
        """The rows of a table that has file_id, and their segment, without those of dead files."""
        out = None
        for s, path in zip(self.manifest["segments"], self._segments(table), strict=True):
            one = _read(self.spark, TABLES[table], path).withColumn("segment", F.lit(s["name"]))
            out = one if out is None else out.unionByName(one)
        return out.join(_few(self.dead()), ["segment", "file_id"], "left_anti") if "extra" in self.manifest else out

    def _chunk_rows(self, grams: list[int] | None = None) -> DataFrame:
        """The postings of all segments, as they are stored, dead files' among them; grams: only of these."""
        rows = _read(self.spark, TABLES["postings"], *self._segments("postings")).where(F.col("gram").isNotNull())
        return rows if grams is None else rows.where(F.col("gram").isin(grams))  # reaches the pages' ranges

    def _places(self) -> DataFrame:
        """(chunk, nth, file_id) of live files."""
        return self.cache().where(F.col("nth").isNotNull()).select("chunk", "nth", "file_id").distinct()

    def _named(self, rows: DataFrame) -> DataFrame:
        """(gram, file_id) of stored postings."""
        each = rows.mapInArrow(ngrams.places_of_batches, "chunk long, nth int, gram long")
        places = self._places()
        return each.join(F.broadcast(places) if self.file_count() <= BROADCAST_PLACES else places, ["chunk", "nth"]).select("gram", "file_id")

    def grams_of(self, rows: DataFrame) -> DataFrame:
        """(chunk, nth, file_id, gram) of some rows of cache()."""
        own = storage.cut(rows.select("chunk", "nth", "file_id").distinct())
        each, wanted = self._chunk_rows(), None
        if own.count() <= BROADCAST_PATHS:
            few = own.select("chunk", "nth").toPandas()
            wanted = {int(c): np.array(g, np.int64) for c, g in few.groupby("chunk")["nth"]}
            each = each.join(F.broadcast(own.select("chunk").distinct()), "chunk", "left_semi")
        places = each.mapInArrow(partial(ngrams.places_of_batches, wanted=wanted), "chunk long, nth int, gram long")
        return places.join(F.broadcast(own) if wanted is not None else own, ["chunk", "nth"])

    def kept(self, rows: DataFrame) -> DataFrame:
        """Rows of CHUNK_SCHEMA of some rows of cache(): chunks without their other files."""
        own = storage.cut(rows)
        all_ = _read(self.spark, TABLES["grams"], *self._segments("grams")).where(F.col("nth").isNotNull()).select("chunk", "nth").distinct()
        dead = all_.join(own.select("chunk", "nth"), ["chunk", "nth"], "left_anti")
        schema = "chunk long, gram long, n int, ids binary"

        def without(chunk: pa.Table, gone: pa.Table) -> pa.Table:
            return ngrams.grams_without(chunk, gone.column("nth").to_numpy()) if chunk.num_rows else chunk

        grams = self._chunk_rows().groupBy("chunk").cogroup(dead.groupBy("chunk")).applyInArrow(without, schema)
        docs = own.withColumn("reused", F.lit(True)).drop("segment")
        return docs.unionByName(grams, allowMissingColumns=True).select(*[c.split()[0] for c in ngrams.CHUNK_SCHEMA.split(", ")])

    @cached_property
    def _postings(self) -> DataFrame:
        return self._named(self._chunk_rows())

    @cached_property
    def _held_counts(self) -> tuple[np.ndarray, np.ndarray]:
        """The counts of all segments by gram."""
        rows = self._counts.toArrow()
        gram, n = (rows.column(c).to_numpy() for c in ("gram", "n"))
        order = np.argsort(gram, kind="stable")
        return gram[order], n[order]

    @cached_property
    def _counts(self) -> DataFrame:
        return _read(self.spark, TABLES["counts"], *self._segments("counts"))

    def cache(self) -> DataFrame:
        """The live rows of the grams table, and their segment."""
        return self._live("grams")

    def files(self) -> DataFrame:
        return self._live("files").select("file_id", "path", "mtime", "size")

    def grams(self) -> DataFrame:
        """(path, mtime, size, content_hash, grams) of each row of the corpus; grams are the file's."""
        rows = self.cache().where(F.col("size") != REMOVED)
        each = self._chunk_rows().mapInArrow(ngrams.places_of_batches, "chunk long, nth int, gram long")
        sets = each.groupBy("chunk", "nth").agg(F.sort_array(F.collect_list("gram")).alias("grams"))
        held = F.coalesce("grams", F.array().cast("array<bigint>")).alias("grams")
        return rows.join(sets, ["chunk", "nth"], "left").select("path", "mtime", "size", "content_hash", held)

    def rows(self) -> DataFrame:
        """(path, mtime, size, content_hash, n_grams) of each row of the corpus."""
        return self.cache().where(F.col("size") != REMOVED).select("path", "mtime", "size", "content_hash", "n_grams")

    def postings(self, grams: list[int] | None = None) -> DataFrame:
        """(gram, file_id), of some grams or all."""
        return self._postings if grams is None else self._named(self._chunk_rows(grams))

    def file_count(self) -> int:
        return self.manifest["files"]

    def ngram_count(self) -> int:
        return self.manifest["ngrams"]

    def posting_count(self) -> int:
        return self.manifest["postings"]

    def has_ngram(self, gram: int) -> bool:
        return not self.postings([gram]).isEmpty()

    def postings_of(self, gram: int) -> DataFrame:
        """(file_id) of one gram, in order."""
        return self.postings([gram]).select("file_id").orderBy("file_id")

    def counts(self) -> DataFrame:
        """(gram, n): live files of each gram."""
        if "extra" not in self.manifest:
            return self._counts
        both = self._counts.unionByName(self.dead_counts().select("gram", (-F.col("n")).alias("n")))
        return both.groupBy("gram").agg(F.sum("n").alias("n")).where("n > 0")

    def file_path(self, id_: int) -> str | None:
        row = self.files().where(F.col("file_id") == id_).first()
        return row and row["path"]

    def file_meta(self, id_: int) -> tuple[int, int] | None:
        """(mtime, size)."""
        row = self.files().where(F.col("file_id") == id_).first()
        return row and (row["mtime"], row["size"])

    def frequencies(self, plan: QueryPlan) -> dict[int, int]:
        """Files of each gram of a plan, dead ones included; grams that the index lacks are left out. A plan's grams are bounded by its limits."""
        grams = sorted({g for side in plan.sides for branch in side for g in branch.grams})
        if not grams:
            return {}
        if sum(s["ngrams"] for s in self.manifest["segments"]) <= HELD_GRAMS:
            held, n = self._held_counts
            each = ((g, int(n[np.searchsorted(held, g) : np.searchsorted(held, g, "right")].sum())) for g in grams)
            return {g: k for g, k in each if k}
        found = self._counts.where(F.col("gram").isin(grams)).groupBy("gram").agg(F.sum("n").alias("n"))
        return {r["gram"]: r["n"] for r in found.collect()}

    def bound(self, plan: QueryPlan, frequency: dict[int, int] | None = None) -> int:
        """No more candidates than this: the rarest gram of each branch bounds it, and the better side the plan."""
        if plan.unconstrained:
            return self.file_count()
        n = self.frequencies(plan) if frequency is None else frequency
        return min(sum(min(n.get(g, 0) for g in branch.grams) for branch in side) for side in plan.sides)

    def _few_candidates(self, plan: QueryPlan, n: dict[int, int]) -> np.ndarray | None:
        """The candidates, intersected by the driver, if that takes few postings; else None."""
        sides = []
        for side in plan.sides:
            branches, cost = [], 0
            for branch in side:
                rarest = sorted(branch.grams, key=lambda g: n.get(g, 0))[:GRAMS_PER_BRANCH]
                if n.get(rarest[0], 0):  # else no file has all of them
                    used = [g for k, g in enumerate(rarest) if k == 0 or n[g] <= 4 * n[rarest[0]]]
                    branches.append(used)
                    cost += sum(n[g] for g in used)
            if not branches:
                return np.zeros(0, np.int64)
            sides.append((cost, branches))
        sides.sort(key=lambda s: s[0])
        # The cheaper side bounds the candidates; the other one is looked up, too, where that is cheap.
        taken = [b for k, (cost, b) in enumerate(sides) if k == 0 or cost <= DRIVER_POSTINGS // 2]
        grams = {g for branches in taken for b in branches for g in b}
        if sum(n[g] for g in grams) > DRIVER_POSTINGS:
            return None
        few = self._chunk_rows(sorted(grams)).toArrow().combine_chunks()
        if not few.num_rows:
            return np.zeros(0, np.int64)
        n_each = few.column("n").to_numpy().astype(np.int64)
        chunks, at = np.unique(few.column("chunk").to_numpy(), return_inverse=True)
        ids = np.repeat(at.astype(np.int64), n_each) << 32 | ngrams.decoded(few.column("ids").chunk(0), n_each)
        gram = np.repeat(few.column("gram").to_numpy(), n_each)
        held = {g: np.unique(ids[gram == g]) for g in grams}
        each = [reduce(np.union1d, (reduce(np.intersect1d, (held[g] for g in b)) for b in branches)) for branches in taken]
        found = reduce(np.intersect1d, each)
        if not len(found):
            return np.zeros(0, np.int64)
        named = self.spark.createDataFrame(pa.table({"chunk": chunks[found >> 32], "nth": pa.array(found & 0xFFFFFFFF, pa.int32())}))
        places = self.cache().where(F.col("chunk").isin(chunks[np.unique(found >> 32)].tolist())) if len(chunks) <= LISTED_IDS else self.cache()
        return np.unique(places.join(F.broadcast(named), ["chunk", "nth"], "left_semi").select("file_id").toArrow().column("file_id").to_numpy())

    def candidates(self, plan: QueryPlan, frequency: dict[int, int] | None = None) -> DataFrame | None:
        """(file_id) of files that may match; None: any may. A file is there if each constrained side has a branch all of whose grams looked up it has."""
        sides = plan.sides
        if not sides:
            return None
        n = self.frequencies(plan) if frequency is None else frequency
        rows = []
        for s, side in enumerate(sides):
            for b, branch in enumerate(side):
                rarest = sorted(branch.grams, key=lambda g: n.get(g, 0))[:GRAMS_PER_BRANCH]
                if n.get(rarest[0], 0):  # else no file has all of them
                    rows += [(s, b, g, len(rarest)) for g in rarest]
        wanted = self.spark.createDataFrame(rows, "side int, branch int, gram long, n int")
        few = self.postings(sorted({r[2] for r in rows}))
        # One shuffle, by file; both groupings below it are served by that.
        held = few.join(F.broadcast(wanted), "gram").repartition("file_id").groupBy("file_id", "side", "branch", "n").agg(F.count_distinct("gram").alias("have"))
        whole = held.where(F.col("have") == F.col("n"))
        return whole.groupBy("file_id").agg(F.count_distinct("side").alias("sides")).where(F.col("sides") == len(sides)).select("file_id")

    def _by_key(self, corpus: DataFrame, ids: np.ndarray) -> DataFrame:
        """The corpus without row groups that its key rules out, where it has one key and that is a whole number."""
        keys = [f for f in corpus.schema if f.name.startswith("key_")]
        if self.file_count() < KEYED_FILES or len(ids) > KEYED_IDS or len(keys) != 1 or keys[0].dataType.simpleString() not in ("int", "bigint", "smallint", "tinyint"):
            return corpus
        paths = [r["path"] for r in self.files().where(F.col("file_id").isin(ids.tolist())).select("path").collect()]
        named = [int(p) for p in paths if p]
        key = F.col(keys[0].name)
        return corpus.where(key.isin(named) | key.isNull() if "" in paths else key.isin(named))

    def prune(self, corpus: DataFrame, plan: QueryPlan, path: Column | None = None, scan_share: float = SCAN_SHARE) -> DataFrame:
        """The candidates of a corpus, or all of it where that costs less. scan_share above 1 asks for the candidates."""
        if plan.unconstrained:
            return corpus
        frequency = self.frequencies(plan)
        most = self.bound(plan, frequency)
        if most == 0:
            return corpus.where(F.lit(False))
        if most > BROADCAST_IDS or most > scan_share * self.file_count():
            return corpus
        ids = self._few_candidates(plan, frequency)
        if ids is not None:
            corpus = self._by_key(corpus, ids) if path is None else corpus
        named = corpus.withColumn("_file_id", file_id(F.col("path") if path is None else path))
        if ids is not None and len(ids) <= LISTED_IDS:
            return named.where(F.col("_file_id").isin(ids.tolist())).drop("_file_id")
        if ids is not None:
            found = self.spark.createDataFrame(pa.table({"_file_id": ids}))
        else:
            found = self.candidates(plan, frequency).withColumnRenamed("file_id", "_file_id")
        return named.join(F.broadcast(found), "_file_id", "left_semi").drop("_file_id")


def search(
    index: Index, corpus: DataFrame, pattern: str, ignore_case: bool = False, keep: list[str] | None = None, scan_share: float = SCAN_SHARE, **options: bool
) -> DataFrame:
    """All matching lines of the indexed corpus, as brute() finds them."""
    plan = decompose(pattern, ignore_case)
    return verify(index.prune(corpus, plan, scan_share=scan_share), plan, keep or ["path"], **options)
