"""Packing by minimum bin slack.

A document's ids are cut into full windows and one remainder. Remainders are counted by length
(at most WINDOW - 1 lengths, whatever the input), and the packing is planned on the counts: the
longest length left seeds a window, a bitset subset-sum over the lengths left, each within its
count, finds the fill closest to the window, and backtracking says how many of each length it
takes; the window is repeated as often as the counts allow. A length whose best fill leaves more
than SLACK is cut at the powers of two of its length instead; such pieces fill windows without a
gap, and the last ones make sequences of a power of two, which aren't padded. Every piece then
finds its place from its rank among the pieces of its length. Only counts go to the driver.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import cut
from .tokens import WordTokenizer

WINDOW = 4096
END_ID = 2
#: Tokens that a window may lack before its seed's length is cut.
SLACK = 10


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def fill(counts: dict[int, int], target: int) -> dict[int, int]:
    """How many of each length come closest to target without passing it."""
    if target <= 0:
        return {}
    reach, all_bits, goal = 1, (1 << (target + 1)) - 1, 1 << target
    steps: list[tuple[int, int, int]] = []  # (reach before, length, copies taken together)
    for length in sorted((n for n in counts if n <= target), reverse=True):
        left, part = min(counts[length], target // length), 1
        while left and not reach & goal:
            part = min(part, left)
            wider = (reach | reach << (length * part)) & all_bits
            if wider != reach:
                steps.append((reach, length, part))
                reach = wider
            left -= part
            part *= 2
        if reach & goal:
            break
    at, out = reach.bit_length() - 1, Counter()
    for before, length, part in reversed(steps):
        if not before >> at & 1:
            out[length] += part
            at -= length * part
    return dict(out)


@dataclass
class Plan:
    """places: (length, first rank, end of ranks, first sequence, pieces of the length in a sequence, first offset).
    cuts: (length, first rank, end of ranks), and starts: {(length, size of piece): place in the run of cut pieces}."""

    places: list[tuple[int, int, int, int, int, int]]
    cuts: list[tuple[int, int, int]]
    starts: dict[tuple[int, int], int]
    cut_base: int
    cut_total: int


def powers(length: int) -> list[int]:
    return [1 << k for k in reversed(range(length.bit_length())) if length >> k & 1]


def plan(counts: dict[int, int], window: int = WINDOW, slack: int = SLACK) -> Plan:
    """counts: pieces of each length, full windows too."""
    left = {n: c for n, c in counts.items() if c > 0}
    used: Counter[int] = Counter()
    out = Plan([], [], {}, 0, 0)
    if full := left.pop(window, 0):
        out.places.append((window, 0, full, 0, 1, 0))
    sequence = full
    while left:
        seed = max(left)
        left[seed] -= 1
        need = Counter(fill({n: c for n, c in left.items() if c}, window - seed))
        left[seed] += 1
        need[seed] += 1
        total = sum(n * c for n, c in need.items())
        if window - total > slack:
            out.cuts.append((seed, used[seed], used[seed] + left.pop(seed)))
            continue
        times, offset = min(left[n] // c for n, c in need.items()), 0
        for n in sorted(need, reverse=True):
            out.places.append((n, used[n], used[n] + times * need[n], sequence, need[n], offset))
            offset += n * need[n]
            used[n] += times * need[n]
            left[n] -= times * need[n]
            if not left[n]:
                del left[n]
        sequence += times
    out.cut_base = sequence
    for size in (1 << k for k in reversed(range(window.bit_length()))):
        for length, lo, hi in out.cuts:
            if length & size and size < window:
                out.starts[length, size] = out.cut_total
                out.cut_total += size * (hi - lo)
    return out


def tail(at: np.ndarray, p: Plan, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of places in the run of cut pieces; its last part makes sequences of powers of two."""
    whole = p.cut_total // window * window
    sequence, offset = p.cut_base + at // window, at % window
    begin = whole
    for k, size in enumerate(powers(p.cut_total - whole)):
        inside = (at >= begin) & (at < begin + size)
        sequence, offset = np.where(inside, p.cut_base + whole // window + k, sequence), np.where(inside, at - begin, offset)
        begin += size
    return sequence, offset


PIECES = "id {}, doc_tokens long, start long, length int, crc long, part int, nth long, cut_crcs array<long>"


def pieces(docs: DataFrame, id_col: str, text_col: str, path: str) -> DataFrame:
    """Full windows and remainders of all documents, each numbered among those of its length in its partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, seen, part = _tokenizer(path), Counter(), TaskContext.get().partitionId()
        end = np.array([END_ID], "<u4").tobytes()
        for b in batches:
            own, rows = [], []
            for k, t in enumerate(b.column(1).to_pylist()):
                ids = tokenizer.text(t or "") + end
                n = len(ids) // 4
                for at in range(0, n, WINDOW):
                    length = min(WINDOW, n - at)
                    piece, crcs, done = memoryview(ids)[4 * at : 4 * (at + length)], [], 0
                    for size in powers(length) if length < WINDOW else ():
                        crcs.append(zlib.crc32(piece[4 * done : 4 * (done + size)]))
                        done += size
                    own.append(k)
                    rows.append((n, at, length, zlib.crc32(piece), part, seen[length], crcs))
                    seen[length] += 1
            columns = map(pa.array, list(zip(*rows, strict=True)) or [()] * 7, _KINDS)
            yield pa.record_batch([b.column(0).take(pa.array(own, pa.int64())), *columns], _NAMES)

    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, PIECES.format(own.schema["id"].dataType.simpleString()))


_NAMES = [c.split()[0] for c in PIECES.split(", ")]
_KINDS = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
_TOKENIZERS: dict[str, WordTokenizer] = {}


def _tokenizer(path: str) -> WordTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


OUT = "id {}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_OUT = [c.split()[0] for c in OUT.split(", ")]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of each piece.

    Null and empty texts are documents of the end id alone; repeated rows are documents of their
    own; ids of any type are kept, null ones too; an empty table gives an empty result; further
    columns are ignored.
    """
    # The rows are narrow: no ids, but checksums of the piece and of what it would be cut into.
    cutout = cut(pieces(docs, id_col, text_col, path or vocabulary()))
    by_part = cutout.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = by_part.withColumn(
        "before", F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    )
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most WINDOW rows
    p = plan(counts)
    shared = docs.sparkSession.sparkContext.broadcast((p, np.array(sorted(p.places), np.int64).reshape(-1, 6), np.array(sorted(p.cuts), np.int64).reshape(-1, 3)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, places, cuts = shared.value
        key = lambda length, rank: length.astype(np.int64) << 48 | rank
        place_keys, cut_keys = key(places[:, 0], places[:, 1]), key(cuts[:, 0], cuts[:, 1])
        for b in batches:
            doc_tokens, start, length, crc, rank = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("doc_tokens", "start", "length", "crc", "rank"))
            at = np.searchsorted(place_keys, key(length, rank), "right") - 1
            row = places[np.maximum(at, 0)] if len(places) else np.zeros((len(rank), 6), np.int64)
            found = (at >= 0) & (row[:, 0] == length) & (rank < row[:, 2])
            nth, per = rank - row[:, 1], np.maximum(row[:, 4], 1)
            own = np.flatnonzero(found)
            columns = [c[own] for c in (start, length, crc, doc_tokens, row[:, 3] + nth // per, row[:, 5] + nth % per * length)]
            if len(own) < len(rank):
                crcs, rows, rest = b.column("cut_crcs"), [], np.flatnonzero(~found)
                first = cuts[np.searchsorted(cut_keys, key(length[rest], rank[rest]), "right") - 1, 1]
                for i, lo in zip(rest.tolist(), first.tolist(), strict=True):
                    n, done = int(length[i]), 0
                    for size, c in zip(powers(n), crcs[i].as_py(), strict=True):
                        rows.append((i, start[i] + done, size, c, doc_tokens[i], p.starts[n, size] + (int(rank[i]) - lo) * size))
                        done += size
                more = np.array(rows, np.int64)
                sequence, offset = tail(more[:, 5], p)
                own = np.concatenate([own, more[:, 0]])
                columns = [np.concatenate(x) for x in zip(columns, [*more[:, 1:5].T, sequence, offset], strict=True)]
            yield pa.record_batch([b.column("id").take(pa.array(own, pa.int64())), *map(pa.array, columns)], _OUT)

    ranked = (
        cutout.join(before.select("length", "part", "before"), ["length", "part"])
        .select("id", "doc_tokens", "start", "length", "crc", "cut_crcs", (F.col("before") + F.col("nth")).alias("rank"))
    )
    return ranked.mapInArrow(place, OUT.format(cutout.schema["id"].dataType.simpleString())).withColumnRenamed("id", id_col)


def digest(docs: DataFrame) -> DataFrame:
    return pack(docs)
