"""Links between texts whose five-word shingles have a Jaccard similarity of at least 4/5, each verified exactly.

Shingles stand in one order for all texts: those that a sample finds in many texts last, else by hash. Two texts
that are similar enough share one of the first floor(n / 5) + 1 shingles of each (its prefix; a longer one does as
well), so similar texts meet at a prefix shingle. There a text is compared with a hub, not with all others: the text
at hand whose prefix shingles are shared most, which in a group of near copies is the one with the fewest changes.
A text takes the hub that it meets most often; those that aren't similar to theirs go on to the next round without
that hub. So most links cost no more than the texts. The rest is exact: of texts that meet and that no links connect
so far, each pair is looked at. Prefixes are longer by n // EXTRA, so similar texts share 1 + n // EXTRA of their
shingles (n: of the smaller), and pairs that do are verified. In a group of near copies that is few against many.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import cut, rows_of
from .decontaminate import _hashes
from .simhash import components

#: The least similarity, as a fraction.
OVER, UNDER = 4, 5
#: A prefix is longer by n // EXTRA shingles, so that hubs and how often they are met say more, and that similar texts share more than one.
EXTRA = 10
#: Rounds of hubs.
ROUNDS = 3
#: One text of so many is in the sample; a shingle in at least so many of its texts stands last, up to so many shingles.
SAMPLE, COMMON, LISTED = 16, 4, 100_000
#: Pairs to verify (16 bytes each) that are broadcast at most; beyond, texts are shuffled to meet them.
BROADCAST_PAIRS = 500_000


def common(texts: DataFrame) -> np.ndarray:
    """Sorted hashes of shingles that many texts hold. Only the order depends on them. texts: h, text."""
    some = texts.where(F.pmod("h", F.lit(SAMPLE)) == 0).dropDuplicates(["h"])
    each = some.select(rows_of(F.array_distinct(_hashes(F.col("text"))), "s")).where("s IS NOT NULL")
    often = each.groupBy("s").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON)
    return np.sort(np.array([r["s"] for r in often.orderBy(F.desc("n"), "s").limit(LISTED).collect()], np.int64))


def prefix(hashes: np.ndarray, last: np.ndarray) -> tuple[int, np.ndarray]:
    """(number of distinct shingles, those of the prefix in order) of a text's shingle hashes."""
    s = np.unique(hashes)
    if len(last):
        at = np.searchsorted(last, s)
        late = last[np.minimum(at, len(last) - 1)] == s
        s = np.concatenate([s[~late], s[late]])
    return len(s), s[: len(s) * (UNDER - OVER) // UNDER + 1 + len(s) // EXTRA]


def _meetings(own: DataFrame) -> DataFrame:
    """(h, n, s, c) of each text and prefix shingle that other texts have, too; c: how much the text's shingles are shared."""
    last = common(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for h, s in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                hashes = s.values.to_numpy(zero_copy_only=False)
                if len(hashes):
                    out.append((h, *prefix(hashes, last)))
            cols = [pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.list_(pa.int64())))]
            yield pa.record_batch(cols, ["h", "n", "first"])

    sets = own.select("h", _hashes(F.col("text")).alias("s")).mapInArrow(run, "h long, n long, first array<long>").dropDuplicates(["h"])
    each = cut(sets).select("h", "n", F.explode("first").alias("s"))
    shared = each.groupBy("s").agg(F.count(F.lit(1)).alias("g")).where("g > 1")
    met = cut(each.join(shared, "s"))
    length = F.floor(F.col("n") * (UNDER - OVER) / UNDER) + 1 + F.floor(F.col("n") / EXTRA)  # of the prefix; what no other text has counts as 0
    return met.join(met.groupBy("h", "n").agg((F.sum(F.round(F.ln("g") * 1_000_000).cast("long")) / length).alias("c")), ["h", "n"]).select("h", "n", "s", "c")


def _similar(own: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) that are similar enough."""
    few = F.broadcast if pairs.count() <= BROADCAST_PAIRS else (lambda df: df)
    asked = pairs.select(F.col("a").alias("k")).unionByName(pairs.select(F.col("b").alias("k"))).distinct()
    some = own.join(few(asked), F.col("h") == F.col("k")).dropDuplicates(["h"])
    sets = cut(some.select("h", F.array_distinct(_hashes(F.col("text"))).alias("s")))
    x = sets.join(few(pairs), F.col("h") == F.col("a")).select("a", "b", F.col("s").alias("as"))
    y = sets.select(F.col("h").alias("y"), F.col("s").alias("ys"))
    shared = F.size(F.array_intersect("as", "ys"))
    return x.join(y, F.col("b") == F.col("y")).where(shared * UNDER >= (F.size("as") + F.size("ys") - shared) * OVER).select("a", "b")


def _rest(own: DataFrame, met: DataFrame, found: DataFrame) -> DataFrame:
    """(a, b): a link between any two groups that links of found leave apart and that have similar texts."""
    each = met.select("h", "n", "s").join(components(found).withColumnRenamed("node", "h"), "h", "left")
    each = cut(each.select("h", "n", "s", F.coalesce("root", "h").alias("root")))
    mixed = each.groupBy("s").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most").select("s")
    open_ = each.join(mixed, "s", "left_semi")
    x, y = (open_.select("s", *[F.col(c).alias(f"{c}{k}") for c in ("h", "n", "root")]) for k in (1, 2))
    small, large = F.least("n1", "n2"), F.greatest("n1", "n2")
    across = x.join(y, "s").where((F.col("root1") < F.col("root2")) & (small * UNDER >= large * OVER))
    times = across.groupBy("h1", "h2", "root1", "root2", small.alias("n")).agg(F.count(F.lit(1)).alias("times"))
    asked = cut(times.where(F.col("times") > F.floor(F.col("n") / EXTRA)).select(F.col("h1").alias("a"), F.col("h2").alias("b"), "root1", "root2"))
    similar = _similar(own, asked.select("a", "b")).join(asked, ["a", "b"])
    return similar.groupBy("root1", "root2").agg(F.min(F.struct("a", "b")).alias("link")).select("link.a", "link.b")


def links(docs: DataFrame, text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """(a, b): hashes (xxhash64) of two different texts that are similar enough; links that connect all texts that such pairs connect.

    Words are runs of letters and digits, lower-cased; a text of fewer than five is one shingle. Null texts and
    texts without words are similar to none; repeated texts count once; an empty table gives an empty result.
    """
    own = docs.where(F.col(text_col).isNotNull()).select(F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    met_all = left = cut(_meetings(own))
    out = None
    for _ in range(rounds):
        hubs = left.groupBy("s").agg(F.max(F.struct("c", "h", "n")).alias("hub"))
        met = left.join(hubs, "s").where(F.col("h") != F.col("hub.h"))
        small, large = F.least("n", "hub.n"), F.greatest("n", "hub.n")
        asked = met.where(small * UNDER >= large * OVER).groupBy("h", F.col("hub.h").alias("b")).agg(F.count(F.lit(1)).alias("times"))
        pairs = cut(asked.groupBy(F.col("h").alias("a")).agg(F.max_by("b", F.struct("times", "b")).alias("b")))
        found = cut(_similar(own, pairs))
        out = found if out is None else out.unionByName(found)
        left = cut(met.select("h", "n", "s", "c").join(found.select(F.col("a").alias("h")), "h", "left_anti"))
    return out.unionByName(cut(_rest(own, met_all, out)))
