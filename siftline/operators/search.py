"""Exact search: candidates, line verification, submatches and output formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.plans.planner import QueryPlan, decompose
from siftline.sources.tree import text_of

#: Ranges of paths that are numbered at once at most, rows in each, and paths in the sample that bounds them, about.
RANGES, RANGE_ROWS, RANGE_SAMPLE = 256, 10_000, 20_000
#: Marks around matches; a line that has the first pair gets the second.
MARKS = (("﷐", "﷑"), ("﷒", "﷓"))


def file_id(path: Column) -> Column:
    """An id that needs no global numbering and stays when files come and go. Paths that share one
    are candidates together, which verification sorts out."""
    return F.xxhash64(path)


def file_ids(corpus: DataFrame) -> DataFrame:
    """The corpus with a dense file_id from 0 in the order of path, null paths last.

    Ranges have fixed bounds, so that they hold the same rows when they are counted and when they are numbered; no task sees all rows.
    """
    spark = corpus.sparkSession
    paths = corpus.select("path").where(F.col("path").isNotNull())
    n = paths.count()
    some = paths.where(F.pmod(F.xxhash64("path"), F.lit(n // RANGE_SAMPLE + 1)) == 0).distinct()
    sample = sorted((r["path"] for r in some.collect()), key=str.encode)
    k = min(RANGES, n // RANGE_ROWS + 1, len(sample) + 1)
    bounds = [sample[i * len(sample) // k] for i in range(1, k)]

    def part(low: int, high: int) -> Column:
        """How many bounds aren't beyond path, which is low to high."""
        mid = (low + high) // 2
        return F.lit(low) if low == high else F.when(F.col("path") < bounds[mid], part(low, mid)).otherwise(part(mid + 1, high))

    ranged = corpus.withColumn("_part", F.when(F.col("path").isNull(), len(bounds) + 1).otherwise(part(0, len(bounds))))
    offsets, at = [], 0
    for r in sorted(ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()):
        offsets.append((r["_part"], at))
        at += r["n"]
    offset = spark.createDataFrame(offsets, "_part int, _offset long")  # a row for each range
    nth = F.row_number().over(Window.partitionBy("_part").orderBy("path")).cast("long")
    return ranged.withColumn("_nth", nth).join(F.broadcast(offset), "_part").withColumn("file_id", F.col("_offset") + F.col("_nth") - 1).drop("_part", "_nth", "_offset")


def lines(corpus: DataFrame, keep: list[str]) -> DataFrame:
    """(*keep, line_number, line): split at \\n alone; a text that ends in \\n has an empty last line."""
    text = text_of(F.col("content"))
    # A plain posexplode would split every text a second time, for a filter on the number of lines.
    each = corpus.select(*keep, F.posexplode_outer(F.split(text, "\n", -1)).alias("_pos", "line"))
    return each.where(F.col("_pos").isNotNull()).select(*keep, (F.col("_pos") + 1).alias("line_number"), "line")


def submatches(line: Column, java: str) -> Column:
    """array<struct<start,end>> of non-overlapping matches, in bytes of the line's UTF-8.

    An empty match right behind another match is none.
    """

    def marked(marks: tuple[str, str]) -> Column:
        opened, closed = marks
        parts = F.split(F.regexp_replace(line, java, f"{opened}$0{closed}"), opened, -1)

        def step(a: Column, part: Column) -> Column:
            size = F.octet_length(F.substring_index(part, closed, 1))
            gap = F.octet_length(part) - size - len(closed.encode())
            start, end = a["at"], a["at"] + size
            follows = (size == 0) & (start == a["end"])
            return F.struct(
                (end + gap).alias("at"),
                F.when(follows, a["end"]).otherwise(end).alias("end"),
                F.when(follows, a["out"]).otherwise(F.concat(a["out"], F.array(F.struct(start.alias("start"), end.alias("end"))))).alias("out"),
            )

        first = F.struct(F.octet_length(F.get(parts, 0)).alias("at"), F.lit(-1).alias("end"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))
        return F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), first, step, lambda a: a["out"])

    return F.when(line.rlike("[" + "".join(MARKS[0]) + "]"), marked(MARKS[1])).otherwise(marked(MARKS[0]))


def verify(corpus: DataFrame, plan: QueryPlan, keep: list[str], with_submatches: bool = False, compat_precheck: bool = False) -> DataFrame:
    """Matching lines: (*keep, line_number, line[, submatches]).

    compat_precheck also asks that the pattern matches the text as a whole, as anchors then mean its ends.
    """
    if compat_precheck:
        corpus = corpus.where(text_of(F.col("content")).rlike(plan.java))
    found = lines(corpus, keep).where(F.col("line").rlike(plan.java))
    return found.withColumn("submatches", submatches(F.col("line"), plan.java)) if with_submatches else found


def brute(corpus: DataFrame, pattern: str, ignore_case: bool = False, keep: list[str] | None = None, **options: bool) -> DataFrame:
    """All matching lines of a corpus without an index."""
    return verify(corpus, decompose(pattern, ignore_case), keep or ["path"], **options)


def in_order(matches: DataFrame) -> DataFrame:
    return matches.orderBy("path", "line_number")


def json_escape(text: Column) -> Column:
    """Quotes, backslashes and control characters; the rest stays as it is."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    named = {"\n": "\\n", "\r": "\\r", "\t": "\\t"}
    rare = out
    for code in range(32):
        rare = F.replace(rare, F.lit(chr(code)), F.lit(named.get(chr(code), f"\\u{code:04x}")))
    return F.when(out.rlike(r"[\x00-\x1f]"), rare).otherwise(out)


def json_lines(matches: DataFrame) -> DataFrame:
    """(json): keys path, line_number, line, submatches, without spaces. matches has submatches."""
    each = F.transform(
        "submatches", lambda s: F.concat(F.lit('{"start":'), s["start"].cast("string"), F.lit(',"end":'), s["end"].cast("string"), F.lit("}"))
    )
    return matches.select(
        F.concat(
            F.lit('{"path":"'), json_escape(F.col("path")), F.lit('","line_number":'), F.col("line_number").cast("string"),
            F.lit(',"line":"'), json_escape(F.col("line")), F.lit('","submatches":['), F.array_join(each, ","), F.lit("]}"),
        ).alias("json")
    )


def text_lines(matches: DataFrame) -> DataFrame:
    """(text): path:line:text."""
    return matches.select(F.concat_ws(":", "path", F.col("line_number").cast("string"), "line").alias("text"))
