"""Line deduplication by overlapping three-line windows.

Lines end at \\n, and a long one behind a punctuation mark and a space, too, as soon as it has LONG code
points, so that a passage within a long line has windows of its own. The windows of three consecutive
lines are hashed (128 bits). A window that stands elsewhere earlier, in the order of (id, text, position),
is a later occurrence; the lines under later occurrences go, overlapping ones merged. Shuffled are
hashes and positions; texts go to the shuffle once, with the merged ranges of their document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import let

WIDTH, LONG = 3, 40
#: A line with what ends it.
LINE = rf"[^\n]{{{LONG},}}?[.!?,;:] |[^\n]*\n|[^\n]+"
#: What ends a line is no part of it where lines are compared.
ENDS = " \n"


def _lines(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(LINE), F.lit(0))


def _windows(text: Column) -> Column:
    """array<struct<pos,a,b>> of windows with something other than white space in them."""

    def hashed(lines: Column) -> Column:
        part = lambda i: [F.get(lines, i + k) for k in range(WIDTH)]
        all_of = F.transform(
            F.sequence(F.lit(0), F.size(lines) - WIDTH),
            lambda i: F.when(
                F.concat(*part(i)).rlike(r"\S"),
                F.struct(i.alias("pos"), F.xxhash64(*part(i)).alias("a"), F.xxhash64(F.lit(1), *part(i)).alias("b")),
            ),
        )
        return F.filter(all_of, lambda w: w.isNotNull())

    none = F.array().cast("array<struct<pos:int,a:bigint,b:bigint>>")
    bare = F.transform(_lines(text), lambda x: F.rtrim(x, F.lit(ENDS)))
    return let(bare, lambda lines: F.when(F.size(lines) < WIDTH, none).otherwise(hashed(lines)))


def _without(lines: Column, starts: Column) -> Column:
    """The lines outside [start, start + WIDTH) of the sorted starts."""
    first = F.filter(starts, lambda p, i: (i == 0) | (p - F.get(starts, i - 1) > WIDTH))
    last = F.filter(starts, lambda p, i: F.coalesce(F.get(starts, i + 1) - p > WIDTH, F.lit(True)))
    # What is kept begins at 0 and after each merged range, and ends before the next range or with the text.
    return let(
        F.concat(F.array(F.lit(0)), F.transform(last, lambda p: p + WIDTH)),
        lambda begins: let(
            F.concat(first, F.array(F.size(lines))),
            lambda ends: F.flatten(F.transform(begins, lambda b, i: F.slice(lines, b + 1, F.get(ends, i) - b))),
        ),
    )


def _of(text_col: str) -> Column:
    """What tells rows of one id, or without an id, apart."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def later(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, h, starts): sorted window positions of later occurrences, for documents (id and hash of the text) that have some. Null ids come last."""
    each = docs.select(F.col(id_col).alias("key"), _of(text_col).alias("h"), F.inline_outer(_windows(F.coalesce(F.col(text_col), F.lit("")))))
    each = each.where(F.col("pos").isNotNull())  # inline would compute the windows a second time, for a filter on their number
    place = F.struct(F.col("key").isNull().alias("last"), "key", "h", "pos")
    # First places of windows that stand twice; where that is one place of a repeated row, no place is later.
    firsts = each.groupBy("a", "b").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("a", "b", "first")
    again = each.join(firsts, ["a", "b"]).where(place > F.col("first"))
    return again.groupBy("key", "h").agg(F.sort_array(F.collect_set("pos")).alias("starts"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, text, n_lines, n_removed, *keep) for each input row.

    Lines are compared exactly, but for spaces and line ends behind them. Texts of fewer than three
    lines, null texts and windows of white space alone lose nothing; null text stays null. Rows of
    equal ids and texts are one document, so a repeated row isn't a later occurrence of itself; other
    rows that share an id, or have none, are documents in the order of their texts' hashes. Ids are of
    any type that has an order. A document all of whose lines stand earlier elsewhere gets an empty
    text. An empty table gives an empty result; columns other than ``keep`` are ignored.
    """
    gone = later(docs, id_col, text_col)
    own = docs.select(
        F.col(id_col).alias("own_id"),
        _of(text_col).alias("own_h"),
        F.col(text_col).alias("own_text"),
        F.struct(F.lit(0).alias("_"), *[F.col(c) for c in keep]).alias("others"),
    )
    rows = own.join(gone, (F.col("own_h") == F.col("h")) & F.col("own_id").eqNullSafe(F.col("key")), "left")
    done = rows.select(
        "own_id",
        "others",
        let(
            _lines(F.coalesce("own_text", F.lit(""))),
            lambda ls: F.when(
                F.col("starts").isNull(),
                F.struct(F.col("own_text").alias("text"), F.size(ls).alias("n"), F.lit(0).alias("gone")),
            ).otherwise(
                let(
                    _without(ls, F.col("starts")),
                    lambda kept: F.struct(F.array_join(kept, "").alias("text"), F.size(ls).alias("n"), (F.size(ls) - F.size(kept)).alias("gone")),
                )
            ),
        ).alias("r"),
    )
    return done.select(
        F.col("own_id").alias(id_col),
        F.col("r.text").alias(text_col),
        F.col("r.n").cast("long").alias("n_lines"),
        F.col("r.gone").cast("long").alias("n_removed"),
        *[F.col(f"others.{c}").alias(c) for c in keep],
    )


def digest(docs: DataFrame) -> DataFrame:
    return dedup_lines(docs)


ORACLE = f"""
WITH lines AS (
  SELECT doc_id, regexp_extract_all(text, '{LINE}') AS ls FROM documents WHERE text IS NOT NULL
), one AS (
  SELECT doc_id, unnest(range(len(ls))) AS i, unnest(ls) AS raw, len(ls) AS n FROM lines
), win AS (
  SELECT doc_id, i, rtrim(raw, ' ' || chr(10)) AS line, n,
    lead(rtrim(raw, ' ' || chr(10)), 1) OVER w AS l2, lead(rtrim(raw, ' ' || chr(10)), 2) OVER w AS l3
  FROM one WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), ranked AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY line, l2, l3 ORDER BY doc_id, i) AS nth
  FROM win WHERE i + 3 <= n AND regexp_matches(line || l2 || l3, '\\S')
), gone AS (
  SELECT DISTINCT doc_id, i + k AS i FROM ranked, (SELECT unnest([0, 1, 2]) AS k) WHERE nth > 1
), kept AS (
  SELECT one.doc_id, count(*) AS n_kept, string_agg(raw, '' ORDER BY one.i) AS text
  FROM one ANTI JOIN gone ON one.doc_id = gone.doc_id AND one.i = gone.i GROUP BY one.doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
  coalesce(len(l.ls), 0)::BIGINT AS n_lines, (coalesce(len(l.ls), 0) - coalesce(k.n_kept, 0))::BIGINT AS n_removed
FROM documents d LEFT JOIN lines l USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""
