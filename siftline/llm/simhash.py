"""SimHash near-duplicates by anchor-point covering.

The fingerprint's first 46 bits are two blocks of 23, each covered by the perfect binary Golay
code: every block value lies within 3 bits of exactly one codeword, its anchor. A fingerprint's
home is its pair of anchors. It is replicated to every pair of anchors that the home of a
fingerprint within the threshold can be, that is to every anchor within covering radius plus
threshold that such a neighbour decodes to. So two fingerprints within the threshold meet at the
home of either, and fingerprints are compared at the homes only. This holds for all inputs: no
link is lost. Equal fingerprints are one node; what an anchor's group yields is a spanning forest
of its links, not all its pairs. Connected components follow by alternating star contraction.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .base import cut

THRESHOLD = 2
SEED = 42
#: Bits of a block; generator polynomial of the cyclic Golay code [23, 12].
BLOCK_BITS, GENERATOR = 23, 0xC75
#: Anchors' members are compared in blocks of at most so many pairs.
PAIRS = 2_000_000
#: With more members, an anchor's comparisons are split by the bits that no anchor has.
DENSE = 4_096
MAX_ROUNDS = 60

_UPPER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_SPACES = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")
_TABLE = bytes(_SPACES[c] if _SPACES[c] != c else _UPPER[c] for c in range(256))


def fingerprint(text: str | None, width: int = 3, seed: int = SEED) -> int:
    """The 64-bit SimHash of a text's word shingles, as an unsigned integer; 0 without words.

    Splitting is at space, tab, LF, VT, FF and CR alone; on UTF-8 bytes, no other byte is one of these.
    """
    words = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split(b" ")
    words = [w for w in words if w]
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    digest = xxhash.xxh64_intdigest
    if n == 1:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(width))))
    h = np.fromiter((digest(s, seed) for s in shingles), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):  # blocks: a very long text needs no large array of bits
        ones += np.unpackbits(h[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp) for each input row; fp holds the bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known: dict[str | None, int] = {}
            out = []
            for t in b.column(1).to_pylist():
                if (f := known.get(t)) is None:
                    f = known[t] = fingerprint(t, width)
                out.append(f)
            yield pa.record_batch([b.column(0), pa.array(np.array(out, np.uint64).view(np.int64))], ["id", "fp"])

    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, f"id {own.schema['id'].dataType.simpleString()}, fp long")


@cache
def _decode() -> np.ndarray:
    """The anchor (codeword) of each block value."""
    words = np.zeros(1, np.uint32)
    for k in range(12):  # all combinations of shifted generators
        words = np.concatenate([words, words ^ np.uint32(GENERATOR << k)])
    out = np.zeros(1 << BLOCK_BITS, np.uint32)
    out[words] = words
    bits = np.uint32(1) << np.arange(BLOCK_BITS, dtype=np.uint32)
    for i in range(BLOCK_BITS):  # every value is one codeword with up to three bits turned
        out[words ^ bits[i]] = words
        for j in range(i):
            out[words ^ bits[i] ^ bits[j]] = words
            for k in range(j):
                out[words ^ bits[i] ^ bits[j] ^ bits[k]] = words
    return out


@cache
def _turns() -> tuple[np.ndarray, ...]:
    """Block masks of 0, 1 and 2 bits."""
    one = np.uint32(1) << np.arange(BLOCK_BITS, dtype=np.uint32)
    i, j = np.triu_indices(BLOCK_BITS, 1)
    return np.zeros(1, np.uint32), one, one[i] | one[j]


def _near(values: np.ndarray, d: int) -> np.ndarray:
    """Anchors of all block values within d bits; a row for each value, sorted, repeats kept."""
    masks = np.concatenate(_turns()[: d + 1])
    return np.sort(_decode()[values[:, None] ^ masks], axis=1)


def _first(a: np.ndarray) -> np.ndarray:
    out = np.ones(a.shape, bool)
    out[:, 1:] = a[:, 1:] != a[:, :-1]
    return out


def replicas(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row of fp, is home) of every copy."""
    u = fp.view(np.uint64)
    low = (u & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.uint32)
    high = ((u >> np.uint64(BLOCK_BITS)) & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.uint32)
    keys, rows = [], []
    for d in range(THRESHOLD + 1):  # up to d turned bits in the low block, the rest in the high one
        a, b = _near(low, d), _near(high, THRESHOLD - d)
        fa, fb = _first(a), _first(b)
        for r in range(0, len(u)):
            x, y = a[r, fa[r]].astype(np.int64), b[r, fb[r]].astype(np.int64)
            k = ((x[:, None] << BLOCK_BITS) | y).ravel()
            keys.append(k)
            rows.append(np.full(len(k), r))
    key, row = np.concatenate(keys), np.concatenate(rows)
    order = np.lexsort((key, row))
    key, row = key[order], row[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    key, row = key[new], row[new]
    home = (_decode()[low].astype(np.int64) << BLOCK_BITS) | _decode()[high].astype(np.int64)
    return key, row, key == home[row]


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


class Forest:
    """Disjoint sets over 0..n-1, joined by arrays of pairs; each set's least member is its root."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while True:
            ra, rb = root[a], root[b]
            open_ = ra != rb
            if not open_.any():
                return
            a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root[:] = up


def _links(fp: np.ndarray, home: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links at one anchor."""
    forest, u = Forest(len(fp)), fp.view(np.uint64)

    def compare(some: np.ndarray) -> None:
        homes = some[home[some]]
        step = max(1, PAIRS // max(len(some), 1))
        for at in range(0, len(homes), step):
            h = homes[at : at + step]
            i, j = np.nonzero(_bits(u[h][:, None] ^ u[some]) <= threshold)
            forest.join(h[i], some[j])

    if len(fp) <= DENSE:
        compare(np.arange(len(fp)))
    else:  # of three parts of the bits that no anchor has, two turned bits leave one as it is
        for k in range(threshold + 1):
            part = (u >> np.uint64(2 * BLOCK_BITS + 6 * k)) & np.uint64(63)
            order = np.argsort(part, kind="stable")
            for some in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
                compare(some)
    k = np.flatnonzero(forest.root != np.arange(len(fp)))
    return fp[k], fp[forest.root[k]]


def _many(anchor: np.ndarray, fp: np.ndarray, home: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of many whole anchors, sorted by anchor."""
    new = np.ones(len(anchor), bool)
    new[1:] = anchor[1:] != anchor[:-1]
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(anchor)))
    homes = np.add.reduceat(home.astype(np.int64), start)
    a, b = [], []
    large = np.flatnonzero((size > 64) & (homes > 0))
    for g in large:
        s = slice(start[g], start[g] + size[g])
        x, y = _links(fp[s], home[s], threshold)
        a.append(x)
        b.append(y)
    group = np.repeat(np.arange(len(start)), size)
    h = np.flatnonzero(home & (size[group] <= 64) & (size[group] > 1))
    reach = size[group[h]]
    i = np.repeat(h, reach)
    j = np.repeat(start[group[h]] - np.concatenate([[0], np.cumsum(reach)[:-1]]), reach) + np.arange(reach.sum()) if len(h) else i
    u = fp.view(np.uint64)
    near = (i != j) & (_bits(u[i] ^ u[j]) <= threshold)
    a.append(fp[i[near]])
    b.append(fp[j[near]])
    return np.concatenate(a), np.concatenate(b)


def links(distinct: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(a, b) of linked fingerprints: enough of them to connect all that are linked. distinct: one row per fp."""
    if not 0 <= threshold <= THRESHOLD:
        raise ValueError("the anchors are laid for at most 2 bits")

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps = batch["fp"].to_numpy(np.int64)
            for at in range(0, len(fps), 2_000):
                fp = fps[at : at + 2_000]
                key, row, home = replicas(fp)
                yield pd.DataFrame({"anchor": key, "fp": fp[row], "home": home})

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []  # rows of the last anchor, which may go on in the next batch
        for batch in batches:
            now = [batch["anchor"].to_numpy(np.int64), batch["fp"].to_numpy(np.int64), batch["home"].to_numpy(bool)]
            if held and (now[0] == held[0][0][0]).all():
                for x, y in zip(held, now, strict=True):
                    x.append(y)
                continue
            if held:
                now = [np.concatenate([*x, y]) for x, y in zip(held, now, strict=True)]
            last = int(np.searchsorted(now[0], now[0][-1]))
            held = [[x[last:]] for x in now]
            if last:
                a, b = _many(*(x[:last] for x in now), threshold)
                yield pd.DataFrame({"a": a, "b": b})
        if held:
            a, b = _many(*(np.concatenate(x) for x in held), threshold)
            yield pd.DataFrame({"a": a, "b": b})

    # Fingerprints are narrow and each makes many replicas: an explicit number keeps them from being coalesced by their own size.
    tasks = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread_out = distinct.select("fp").repartition(tasks, "fp").mapInPandas(spread, "anchor long, fp long, home boolean")
    met = spread_out.repartition("anchor").sortWithinPartitions("anchor")
    found = met.mapInPandas(compare, StructType([StructField("a", LongType()), StructField("b", LongType())]))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes of (a, b), root being the least node reachable, by alternating stars.

    Each round every node hands its larger neighbours to its least one (large star), then its smaller
    ones (small star), until the edges are stars. Leaves of a hot centre are rows of a join, never one
    task's group.
    """

    def star(pairs: DataFrame) -> DataFrame:
        """pairs (u, v): each v of u, and u, goes to u's least."""
        least = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        return pairs.join(least, "u").select("v", "u", "m")

    e = cut(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    for _ in range(MAX_ROUNDS):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = star(both).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = star(large)
        e = cut(
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(small.select("u", F.col("m").alias("v")))
            .where(F.col("u") != F.col("v"))
            .distinct()
        )
        mark = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, threshold: int = THRESHOLD, more: DataFrame | None = None
) -> DataFrame:
    """(id, fp, component_id) for each input row; component_id: least id reachable over links of at most threshold bits.

    more: further links (a, b) of texts; a text's name is the id's field h, so ids are structs then.

    Null and empty texts have the fingerprint 0 and link like any other; ids are of any type that has
    an order; null ids get a component, but are never its id (null where a component has no other);
    repeated rows get equal results; an empty table gives an empty result; further columns are ignored.
    """
    rows = cut(fingerprints(docs, id_col, text_col, width))
    distinct = cut(rows.groupBy("fp").agg(F.min("id").alias("least")))
    edges = links(distinct, threshold)
    if more is not None:
        names = rows.select("id.h", "fp").distinct()
        pairs = more.join(names.toDF("a", "fa"), "a").join(names.toDF("b", "fb"), "b")
        edges = edges.unionByName(pairs.select(F.col("fa").alias("a"), F.col("fb").alias("b")))
    roots = components(edges)
    grouped = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    ids = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    of = grouped.join(ids, "root").select(F.col("fp").alias("f"), "component_id")
    return rows.join(of, F.col("fp") == F.col("f"), "left").select(F.col("id").alias(id_col), "fp", "component_id")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns for each row of documents."""
    return near_duplicates(docs).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
