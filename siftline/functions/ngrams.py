"""Sparse n-grams: the pieces of a text that an index holds, and those of a literal that it is asked for.

Every pair of neighbouring bytes has a weight. A stretch of a text is a gram if each pair inside
it is lighter than the pairs at both of its ends; three bytes always are. Which stretches are grams
depends on their own bytes only, so a literal's grams are grams of every text that holds it. Texts
and literals are folded (ASCII) before, since weights depend on case.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Multipliers of the pair weight, basis and prime of FNV-1a, lengths of grams.
PAIR_1, PAIR_2 = 0xC6A4A7935BD1E995, 0x228876A7198B743
FNV_BASIS, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
SHORTEST, LONGEST = 3, 16


def _weights() -> np.ndarray:
    first, second = np.arange(256, dtype=np.uint64)[:, None], np.arange(256, dtype=np.uint64)
    with np.errstate(over="ignore"):
        mixed = first * np.uint64(PAIR_1) + second * np.uint64(PAIR_2)
        mixed = mixed + (~mixed >> np.uint64(47))
    return mixed.astype(np.uint32).ravel()


WEIGHTS = _weights()


def fold(text: bytes) -> bytes:
    return text.lower()  # on bytes: A-Z alone


def _pair_weights(text: bytes) -> np.ndarray:
    b = np.frombuffer(text, np.uint8).astype(np.int64)
    return WEIGHTS[b[:-1] << 8 | b[1:]]


def gram_hash(gram: bytes) -> int:
    """FNV-1a, as a signed long."""
    h = FNV_BASIS
    for b in gram:
        h = (h ^ b) * FNV_PRIME & 0xFFFFFFFFFFFFFFFF
    return h - (1 << 64) if h >> 63 else h


def spans(text: bytes, longest: int | None = LONGEST) -> list[tuple[int, int]]:
    """(start, end) of every gram, by length, then start."""
    w, out = _pair_weights(text) if len(text) > 1 else np.zeros(0, np.uint32), []
    inside = np.zeros(max(len(w) - 1, 0), np.uint32)
    for d in range(1, min(len(w), (longest or len(text)) - 1)):
        if d > 1:
            inside = np.maximum(inside[:-1], w[d - 1 : -1])
        lower = np.minimum(w[:-d], w[d:])
        hit = inside < lower if d > 1 else np.ones(len(lower), bool)
        out += [(int(i), int(i) + d + 2) for i in np.flatnonzero(hit)]
    return out


def gram_hashes(text: bytes) -> np.ndarray:
    """Distinct hashes of a folded text's grams, sorted; at most LONGEST - 2 passes, each over the places where a longer gram can still begin."""
    if len(text) < SHORTEST:
        return np.zeros(0, np.int64)
    b = np.frombuffer(text, np.uint8).astype(np.uint64)
    w, prime = _pair_weights(text), np.uint64(FNV_PRIME)
    h = (((np.uint64(FNV_BASIS) ^ b[:-2]) * prime ^ b[1:-1]) * prime ^ b[2:]) * prime  # of the three bytes at each place
    found, at = [h], np.flatnonzero(w[1:] < w[:-1])
    h, own, inside = h[at], w[at], w[at + 1]
    for d in range(2, min(len(w), LONGEST - 1)):
        if d > 2:  # what is inside only gets heavier
            inside = np.maximum(inside, w[at + (d - 1)])
            on = np.flatnonzero(inside < own)
            at, h, own, inside = at[on], h[on], own[on], inside[on]
        k = np.searchsorted(at, len(w) - d)
        at, h, own, inside = at[:k], h[:k], own[:k], inside[:k]
        h = (h ^ b[at + (d + 1)]) * prime
        found.append(h[inside < w[at + d]])
    grams = np.concatenate(found)
    grams.sort()
    return grams[np.append(True, grams[1:] != grams[:-1])].view(np.int64)


def covering(literal: bytes, longest: int = LONGEST) -> list[bytes]:
    """Few grams that together cover a folded literal: a stretch that is no gram is split at its first heaviest pair."""
    if len(literal) < SHORTEST:
        return []
    w = _pair_weights(literal).tolist()
    out, todo = [], [(0, len(w) - 1)]
    while todo:
        i, j = todo.pop()
        inner = w[i + 1 : j]
        if j - i + 2 <= longest and (not inner or max(inner) < min(w[i], w[j])):
            out.append(literal[i : j + 2])
        else:
            m = i + 1 + inner.index(max(inner))
            todo += [(m, j), (i, m)]
    return out


#: Postings of a chunk, about, and of the range of grams that is sorted at once.
CHUNK, SORTED = 24_000_000, 1_000_000
#: Rows of a chunk: one for each row of a corpus (nth: its file's place in the chunk), then one for each gram (ids: places of n files).
CHUNK_SCHEMA = "chunk long, nth int, file_id long, path string, mtime long, size long, content_hash string, n_grams int, reused boolean, gram long, n int, ids binary"
_TYPES = (pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.bool_(), pa.int64(), pa.int32(), pa.binary())
_NAMES = [c.split()[0] for c in CHUNK_SCHEMA.split(", ")]


def _batch(n: int, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.record_batch([columns[c].cast(t) if c in columns else pa.nulls(n, t) for c, t in zip(_NAMES, _TYPES, strict=True)], _NAMES)


def encoded(places: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, where each list begins and the last ends) of lists of ascending places, one after the other; first: where lists begin.

    A place is its distance from the one before, seven bits a byte, the lowest first, the last byte without the top bit.
    """
    d = np.diff(places, prepend=0)
    d[first] = places[first]
    size = np.ones(len(d), np.int64)
    for k in range(1, 5):
        size += d >= 1 << 7 * k
    at = np.cumsum(size) - size
    total = int(at[-1] + size[-1]) if len(d) else 0
    out = np.empty(total, np.uint8)
    for k in range(int(size.max(initial=1))):
        more = np.flatnonzero(size > k) if k else slice(None)
        out[at[more] + k] = (d[more] >> 7 * k & 127) | np.where(size[more] > k + 1, 128, 0)
    return out, np.append(at[first], total)


def decoded(ids: pa.Array, n: np.ndarray) -> np.ndarray:
    """The places of all rows, one after the other."""
    ids = ids.cast(pa.binary())
    offsets = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1]
    b = np.frombuffer(ids.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    end = np.flatnonzero(b < 128)
    start = np.append(0, end[:-1] + 1)[: len(end)]
    d = (b[start] & 127).astype(np.int64)
    for k in range(1, int((end - start).max(initial=0)) + 1):
        more = np.flatnonzero(end - start >= k)
        d[more] |= (b[start[more] + k].astype(np.int64) & 127) << 7 * k
    first = np.cumsum(n) - n
    total = np.cumsum(d)
    return total - np.repeat(total[first] - d[first], n)


def places_of_batches(batches: Iterator[pa.RecordBatch], wanted: dict[int, np.ndarray] | None = None, most: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: (chunk, nth, gram) of rows (chunk, gram, n, ids); wanted: the places asked for in each chunk, else all."""
    for batch in batches:
        ends = np.cumsum(batch.column("n").to_numpy())
        at = 0
        while at < batch.num_rows:  # no more than about `most` rows at once, or one list
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            some = batch.slice(at, upto - at)
            at = upto
            n = some.column("n").to_numpy().astype(np.int64)
            nth = decoded(some.column("ids"), n)
            chunk, gram = (np.repeat(some.column(c).to_numpy(), n) for c in ("chunk", "gram"))
            if wanted is not None:
                kept = np.zeros(len(nth), bool)
                for c in np.unique(chunk):
                    kept[chunk == c] = np.isin(nth[chunk == c], wanted.get(int(c), ()))
                chunk, nth, gram = chunk[kept], nth[kept], gram[kept]
            yield pa.record_batch([pa.array(chunk), pa.array(nth, pa.int32()), pa.array(gram)], ["chunk", "nth", "gram"])


def grams_without(rows: pa.Table, dead: np.ndarray) -> pa.Table:
    """A chunk's rows (chunk, gram, n, ids) without the places in dead, by gram."""
    rows = rows.take(pa.array(np.argsort(rows.column("gram").to_numpy()))).combine_chunks()
    n = rows.column("n").to_numpy().astype(np.int64)
    ids = rows.column("ids").combine_chunks()
    nth = decoded(ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids, n) if len(n) else np.zeros(0, np.int64)
    live = ~np.isin(nth, dead)
    left = np.bincount(np.repeat(np.arange(len(n)), n)[live], minlength=len(n))
    rows, nth, left = rows.filter(pa.array(left > 0)), nth[live], left[left > 0]
    data, offsets = encoded(nth, np.cumsum(left) - left)
    return pa.table({"chunk": rows.column("chunk"), "gram": rows.column("gram"), "n": pa.array(left, pa.int32()), "ids": _lists(data, offsets)})


def _lists(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


class _Grams:
    """Grams of a chunk's files, in order, one file after the other.

    One array for all of them goes back to the system at once; many small ones would stay with a worker that is used again.
    """

    def __init__(self) -> None:
        self.held, self.ends = np.empty(CHUNK + CHUNK // 8, np.int64), [0]

    def add(self, grams: np.ndarray, same: bool) -> None:
        """A file's grams, as gram_hashes() gives them; same: more of the last file."""
        middle = np.searchsorted(grams.view(np.uint64), np.uint64(1 << 63))  # unsigned order; as signed longs, the upper half comes first
        halves = [grams[middle:], grams[:middle]]
        if same:
            halves = [np.unique(np.concatenate([self.held[self.ends[-2] : self.ends[-1]], grams]))]
            self.ends.pop()
        at = self.ends[-1]
        upto = at + sum(map(len, halves))
        if upto > len(self.held):
            more = np.empty(upto + CHUNK // 8, np.int64)
            more[:at] = self.held[:at]
            self.held = more
        for half in halves:
            self.held[at : at + len(half)] = half
            at += len(half)
        self.ends.append(upto)

    def __len__(self) -> int:
        return len(self.ends) - 1


def _gram_rows(chunk: int, grams: _Grams) -> Iterator[pa.RecordBatch]:
    """The rows of each gram of a chunk, in order."""
    parts = grams.ends[-1] // SORTED + 1
    edges = np.array([(k << 64) // parts - (1 << 63) for k in range(1, parts)], np.int64)
    files = [grams.held[a:b] for a, b in zip(grams.ends, grams.ends[1:], strict=False)]
    cuts = np.array([np.concatenate([[0], np.searchsorted(g, edges), [len(g)]]) for g in files], np.int64).reshape(-1, parts + 1)
    for k in range(parts):
        lens = cuts[:, k + 1] - cuts[:, k]
        if not lens.any():
            continue
        gram = np.concatenate([g[a:b] for g, a, b in zip(files, cuts[:, k], cuts[:, k + 1], strict=True)])
        order = np.argsort(gram)
        gram, place = gram[order], np.repeat(np.arange(len(files)), lens)[order]
        new = np.append(True, gram[1:] != gram[:-1])
        place = np.sort((np.cumsum(new) << 32) | place) & 0xFFFFFFFF  # ascending within each gram
        first = np.flatnonzero(new)
        data, offsets = encoded(place, first)
        n = np.diff(np.append(first, len(gram)))
        yield _batch(len(first), {"chunk": pa.array(np.full(len(first), chunk)), "gram": pa.array(gram[first]), "n": pa.array(n), "ids": _lists(data, offsets)})


def chunks_of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: chunks of rows (file_id, path, mtime, size, content_hash, reused, content). Neighbours of one path are one file."""
    keep = ["file_id", "path", "mtime", "size", "content_hash", "reused"]
    chunk, files, last = uuid.uuid4().int >> 65, _Grams(), None
    for batch in batches:
        contents, paths = batch.column("content").cast(pa.binary()), batch.column("path").to_pylist()
        at, nth, counts = 0, [], []

        def rows(batch=batch, nth=nth, counts=counts):
            of = batch.slice(at, len(nth))
            return _batch(len(nth), {c: of.column(c) for c in keep} | {"chunk": pa.array(np.full(len(nth), chunk)), "nth": pa.array(nth, pa.int32()), "n_grams": pa.array(counts, pa.int32())})

        for content, path in zip(contents, paths, strict=True):
            if files.ends[-1] >= CHUNK and path != last:
                if nth:
                    yield rows()
                yield from _gram_rows(chunk, files)
                at += len(nth)
                nth.clear()
                counts.clear()
                del files  # before there are others
                chunk, files = uuid.uuid4().int >> 65, _Grams()
            grams = gram_hashes(fold(content.as_py())) if content.is_valid else np.zeros(0, np.int64)
            files.add(grams, len(files) > 0 and path == last)
            nth.append(len(files) - 1)
            counts.append(len(grams))
            last = path
        if nth:
            yield rows()
    yield from _gram_rows(chunk, files)
