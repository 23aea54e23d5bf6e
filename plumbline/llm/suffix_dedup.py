"""Exact removal of repeated byte strings over range-partitioned, locally sorted suffixes.

A byte goes when it lies in a string of ``length`` (100) bytes that also starts
earlier: in a document of smaller id, or earlier in the same one.

Sorting every suffix would move each text a hundred times, so suffixes are
thinned without losing a match:

1. In every window of ``length`` bytes the leftmost smallest ``seed``-byte
   gram (by hash) is its anchor (about 1 byte in 26 is one).  Equal windows have
   equal anchors at equal offsets, so only anchors whose gram repeats matter.
   They are found by hash; a false match of hashes only keeps a suffix too many.
2. Suffixes at those anchors carry their bytes - all that a window on the anchor
   reaches - and are range-partitioned by sampled splitters over (leading bytes
   with some bits of the gram's hash, document, position).  A bucket is read in
   runs of bounded size; a run is sorted by a multikey quicksort on the bytes.  Of suffixes with
   equal bytes the first stands for all, the others are repeats as a whole; where
   the gram's surroundings differ, the windows are sorted in the same way and
   compared with their predecessors.
3. A gram that a splitter or the end of a run cuts is not decided there: its
   windows are range-partitioned anew, by splitters over (all their bytes,
   document, position), so a string with any share of the rows spans buckets, and
   each bucket's first window is compared with the last of the bucket before.
4. Repeats become intervals per document, and the text is cut.

Every decision compares bytes.  Nothing is capped or sampled but the splitters,
which only steer the balance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialise, release
from .wordgrams import _TABLE, byte_chunks, mix64, powers, text_bytes

COPY_BITS = 40
HASH_BITS = np.uint64(24)
SMALL_SORT = 4096


@dataclass(frozen=True)
class SuffixParams:
    """length: bytes of a repeat; seed: bytes of an anchor's gram; bucket_bytes:
    text per bucket, as far as most_buckets allow; per_bucket: sampled keys per
    splitter (the driver holds at most most_buckets x per_bucket of them);
    run_bytes: suffixes that a task sorts at once."""

    length: int = 100
    seed: int = 50
    bucket_bytes: int = 4 << 20
    least_buckets: int = 96
    most_buckets: int = 1 << 16
    per_bucket: int = 32
    run_bytes: int = 16 << 20

    @property
    def reach(self) -> int:
        """Most bytes of a window before its anchor."""
        return self.length - self.seed

    @property
    def width(self) -> int:
        """Most bytes that the windows on one anchor reach."""
        return self.length + self.reach

    def buckets(self, n_bytes: int, least: int) -> int:
        return min(self.most_buckets, max(least, n_bytes // self.bucket_bytes))


class Windows:
    """Rolling hashes, windows and anchors of a run of documents end to end."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, p: SuffixParams):
        self.p, self.raw, self.offsets, n = p, raw, offsets, len(raw)
        up, self.down = powers(max(n, 1))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_TABLE[raw] * up, out=self.sums[1:])
        sizes = np.diff(offsets)
        long = np.flatnonzero(sizes >= p.length)
        many = sizes[long] - p.length + 1
        #: every window's start and its document's row
        self.start = np.repeat(offsets[long] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        self.row = np.repeat(long, many)
        if not len(self.start):
            self.anchor = np.zeros(0, np.int64)
            return
        width = p.length - p.seed + 1
        grams = self.hash(np.arange(n - p.seed + 1), p.seed)
        # 32 bits of hash over 32 bits of position: the smallest is the leftmost smallest gram
        key = (grams >> np.uint64(32) << np.uint64(32)) | np.arange(len(grams), dtype=np.uint64)
        pad = np.full(-len(key) % width, np.uint64(2**64 - 1))
        block = np.concatenate((key, pad)).reshape(-1, width)
        ahead = np.minimum.accumulate(block, axis=1).ravel()
        behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(behind[self.start], ahead[self.start + width - 1])
        self.anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)

    def hash(self, at: np.ndarray, size) -> np.ndarray:
        """Hash of the ``size`` bytes at each position."""
        return mix64((self.sums[at + size] - self.sums[at]) * self.down[at])

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct anchors: position, document's row, start of the first window and number of windows."""
        if not len(self.anchor):
            none = np.zeros(0, np.int64)
            return none, none, none, none
        first = np.flatnonzero(np.concatenate(([True], (self.anchor[1:] != self.anchor[:-1]) | (self.row[1:] != self.row[:-1]))))
        return self.anchor[first], self.row[first], self.start[first], np.diff(first, append=len(self.anchor))

    def reached(self, start: np.ndarray, many: np.ndarray) -> np.ndarray:
        """The bytes that windows reach, one row each of ``width`` bytes, zero beyond."""
        padded = np.concatenate((self.raw, np.zeros(self.p.width, np.uint8)))
        rows = np.lib.stride_tricks.sliding_window_view(padded, self.p.width)[start]
        rows[np.arange(self.p.width) >= (many + self.p.length - 1)[:, None]] = 0
        return rows


def _refined(keys: list[np.ndarray], order: np.ndarray, depth: int) -> np.ndarray:
    """A short range's order: sort on one key, then only runs of ties on the next."""
    same = np.ones(len(order), bool)
    same[:1] = False
    for key in keys[depth:]:
        rows = np.flatnonzero(same | np.append(same[1:], False))
        if not len(rows):
            break
        run, word = np.cumsum(~same)[rows], key[order[rows]]
        apart = (word[1:] != word[:-1]) & (run[1:] == run[:-1])
        if apart.any():  # only runs that hold different words
            mixed = np.zeros(run[-1] + 1, bool)
            mixed[run[1:][apart]] = True
            k = mixed[run]
            rows, run, word = rows[k], run[k], word[k]
            order[rows] = order[rows][np.lexsort((word, run))]
            word = key[order]
            same[1:] &= word[1:] == word[:-1]
    return order


def multikey_quicksort(keys: list[np.ndarray]) -> np.ndarray:
    """Order of rows by several keys.

    A range is parted in three around a pivot of the key at its depth; the rows
    equal to the pivot go on with the next key, the others with the same one.
    """
    order = np.arange(len(keys[0]))
    todo = [(0, len(order), 0)]
    while todo:
        a, b, depth = todo.pop()
        if b - a < 2 or depth == len(keys):
            continue
        rows = order[a:b]
        if b - a <= SMALL_SORT:
            order[a:b] = _refined(keys, rows.copy(), depth)
            continue
        word = keys[depth][rows]
        sample = np.sort(word[:: max(1, len(word) // 31)])
        pivot = sample[len(sample) // 2]
        low, high = word < pivot, word > pivot
        m, n = a + int(low.sum()), b - int(high.sum())
        order[a:b] = np.concatenate((rows[low], rows[~(low | high)], rows[high]))
        todo += [(a, m, depth), (m, n, depth + 1), (n, b, depth)]
    return order


def big_endian(rows: np.ndarray) -> list[np.ndarray]:
    """Columns of 8-byte words of a byte matrix, so that words compare as the bytes do."""
    wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    wide[:, : rows.shape[1]] = rows
    return list(np.ascontiguousarray(wide.view(">u8").astype(np.uint64).T))


def unequal(keys: list[np.ndarray]) -> np.ndarray:
    """Whether each row of sorted keys differs from the one before."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    return new


def splitters(sample: list[np.ndarray], buckets: int) -> list[np.ndarray]:
    """``buckets`` - 1 keys that cut the sorted sample evenly."""
    order = multikey_quicksort(sample)
    at = (np.arange(1, buckets) * len(order)) // buckets if len(order) else np.zeros(0, np.int64)
    return [k[order[at]] for k in sample]


def bucket_of(keys: list[np.ndarray], cuts: list[np.ndarray]) -> np.ndarray:
    """Number of splitters at or below each key, in lexicographic order."""
    low = np.searchsorted(cuts[0], keys[0], "left")
    high = np.searchsorted(cuts[0], keys[0], "right")
    rows = np.flatnonzero(low < high)  # keys whose first part is a splitter's: bisection on all parts
    while len(rows):
        at = (low[rows] + high[rows]) // 2
        over, tie = np.zeros(len(rows), bool), np.ones(len(rows), bool)
        for k, c in zip(keys[1:], cuts[1:], strict=True):
            over |= tie & (k[rows] > c[at])
            tie &= k[rows] == c[at]
        above = over | tie
        low[rows[above]], high[rows[~above]] = at[above] + 1, at[~above]
        rows = rows[low[rows] < high[rows]]
    return low.astype(np.int32)


def _at_cut(bucket: np.ndarray, key: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Whether a row's first key part is that of the splitter on either side of its bucket."""
    if not len(cuts):
        return np.zeros(len(bucket), bool)
    below, above = np.clip(bucket - 1, 0, None), np.minimum(bucket, len(cuts) - 1)
    return (bucket > 0) & (key == cuts[below]) | (bucket < len(cuts)) & (key == cuts[above])


SEED = "bucket int, g long, doc long, pos long"
SUFFIX = "bucket int, key long, doc long, pos long, shape int, bytes binary"
WINDOW = "bucket int, bytes binary, doc long, pos long"


def _documents(batch: pa.RecordBatch, p: SuffixParams) -> Iterator[tuple[np.ndarray, np.ndarray, Windows, np.ndarray]]:
    """(doc ids, copies shifted into positions, windows, rows of the batch) of runs of documents."""
    column = batch.column("text")
    ids, copies = batch.column("doc").to_numpy(), batch.column("copy").to_numpy().astype(np.int64) << COPY_BITS
    for a, b in byte_chunks(column):
        raw, offsets = text_bytes(column.slice(a, b - a), lower=False)
        yield ids[a:b], copies[a:b], Windows(raw, offsets, p), np.arange(a, b)


def _batch(schema: str, *columns: np.ndarray) -> pa.RecordBatch:
    names = [c.split()[0] for c in schema.split(", ")]
    made = []
    for column in columns:
        if column.ndim == 2:  # a byte matrix: one binary value per row
            offsets = np.arange(len(column) + 1, dtype=np.int32) * column.shape[1]
            column = pa.Array.from_buffers(pa.binary(), len(column), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(column))])
        made.append(pa.array(column.view(np.int64)) if isinstance(column, np.ndarray) and column.dtype == np.uint64 else pa.array(column) if isinstance(column, np.ndarray) else column)
    return pa.RecordBatch.from_arrays(made, names)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Byte matrix of a column of binary values of one length."""
    return np.frombuffer(column.buffers()[2], np.uint8, len(column) * width, column.offset * width).reshape(-1, width) if len(column) else np.zeros((0, width), np.uint8)


def _seed_maker(p: SuffixParams, cuts: list[np.ndarray] | None):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, copies, w, _ in _documents(batch, p):
                at, row, _, _ = w.anchors()
                if len(at):
                    g, doc, pos = w.hash(at, p.seed), ids[row], copies[row] + at - w.offsets[row]
                    yield _batch(SEED, bucket_of([g, doc, pos], cuts) if cuts else np.zeros(len(g), np.int32), g, doc, pos)

    return make


def _repeated_seeds(cuts: list[np.ndarray]):
    """(doc, pos) of grams that occur again or that a splitter cuts, from a stream sorted by gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, again = None, False  # the last row so far, and whether it equals the one before
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(c).to_numpy() for c in ("bucket", "g", "doc", "pos")]
            if held is not None:
                columns = [np.concatenate((h, c)) for h, c in zip(held, columns, strict=True)]
            bucket, g, doc, pos = columns
            same = g[1:] == g[:-1]
            live = np.append(same, False) | np.concatenate(([again], same)) | _at_cut(bucket, g.view(np.uint64), cuts[0])
            held, again = [c[-1:] for c in columns], bool(same[-1]) if len(same) else again
            yield pa.RecordBatch.from_arrays([pa.array(doc[:-1][live[:-1]]), pa.array(pos[:-1][live[:-1]])], ["doc", "pos"])
        if held is not None and (again or _at_cut(held[0], held[1].view(np.uint64), cuts[0])[0]):
            yield pa.RecordBatch.from_arrays([pa.array(held[2]), pa.array(held[3])], ["doc", "pos"])

    return run


def _suffix_maker(p: SuffixParams, cuts: list[np.ndarray] | None):
    """Suffixes at the anchors whose positions (with the copy in the high bits) are listed in ``open``."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = batch.column("open")
            for ids, copies, w, rows in _documents(batch, p):
                marked = np.zeros(w.offsets[-1] + 1, bool)
                for k, row in enumerate(rows):
                    marked[w.offsets[k] + (listed[int(row)].values.to_numpy() & (1 << COPY_BITS) - 1)] = True
                anchors = w.anchors()
                take = marked[anchors[0]]
                at, row, start, many = (x[take] for x in anchors)
                for a in range(0, len(at), 1 << 14):
                    k = slice(a, a + (1 << 14))
                    reached = w.reached(start[k], many[k])
                    before = at[k] - start[k]
                    place = np.arange(len(reached))[:, None]
                    [lead] = big_endian(reached[place, before[:, None] + np.arange(8)])
                    doc, pos = ids[row[k]], copies[row[k]] + start[k] - w.offsets[row[k]]
                    # one word, so that the engine sorts by radix: five leading bytes, then hash bits that keep grams apart
                    key = lead >> HASH_BITS << HASH_BITS | w.hash(at[k], p.seed) >> (np.uint64(64) - HASH_BITS)
                    bucket = bucket_of([key, doc, pos], cuts) if cuts else np.zeros(len(doc), np.int32)
                    yield _batch(SUFFIX, bucket, key, doc, pos, (before << 8 | many[k]).astype(np.int32), reached)

    return make


def _runs(batches: Iterator[pa.RecordBatch], p: SuffixParams) -> Iterator[tuple[pa.RecordBatch, bool]]:
    """Runs of a stream sorted by key, with whether a run is part of one key's rows.

    A run holds all rows of its keys, and at most ``run_bytes``; a key with more rows is cut.
    """
    most = max(1, p.run_bytes // p.width)
    parts, held, cut = [], 0, False
    for batch in chain(batches, [None]):
        if batch is not None:
            if batch.num_rows:
                parts.append(batch)
                held += batch.num_rows
            if held <= most:
                continue
        if not parts:
            return
        table = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        ends = np.append(np.flatnonzero(unequal([table.column("key").to_numpy()])), table.num_rows)
        full = len(ends) - 1 - (batch is not None)  # keys that are here as a whole, but for the first one's start
        k = 0
        while k < full:
            to = int(np.searchsorted(ends, ends[k] + most, "right")) - 1
            if (k == 0 and cut) or to <= k:
                yield from ((table.slice(a, min(most, ends[k + 1] - a)), True) for a in range(ends[k], ends[k + 1], most))
                k += 1
            else:
                to = min(to, full)
                yield table.slice(ends[k], ends[to] - ends[k]), False
                k = to
        cut = cut and not full
        rest = table.slice(ends[full]) if batch is not None else table.slice(0, 0)
        if rest.num_rows > most:
            yield from ((rest.slice(a, most), True) for a in range(0, rest.num_rows, most))
            rest, cut = rest.slice(0, 0), True
        parts, held = [rest] if rest.num_rows else [], rest.num_rows


FOUND = "doc long, pos long, size long, shape int, bytes binary"


def _found(doc: np.ndarray, pos: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
    n = len(doc)
    return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(pos), pa.array(size.astype(np.int64)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], ["doc", "pos", "size", "shape", "bytes"])


def _window_words(flat: np.ndarray, at: np.ndarray, length: int) -> list[np.ndarray]:
    """Words of the ``length`` bytes at each place of a flat byte array."""
    return big_endian(np.lib.stride_tricks.sliding_window_view(flat, length)[at])


def _repeated_windows(flat, at, many, doc, pos, group, p: SuffixParams, most: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Repeated windows of suffixes that share a gram, joined to spans; ``group`` ascends."""
    edges = np.append(np.flatnonzero(np.diff(group, prepend=group[0] - 1)), len(group))
    total = np.concatenate(([0], np.cumsum(many)))
    k = 0
    while k < len(edges) - 1:  # whole groups, some ``most`` windows at a time
        to = max(k + 1, int(np.searchsorted(total[edges], total[edges[k]] + most, "right")) - 1)
        rows = np.arange(edges[k], edges[to])
        k = to
        row = np.repeat(rows, many[rows])
        step = np.arange(len(row)) - np.repeat(total[rows] - total[rows[0]], many[rows])
        words = _window_words(flat, at[row] + step, p.length)
        order = multikey_quicksort([*words, doc[row], pos[row] + step])
        again = np.zeros(len(row), bool)
        again[order] = ~unequal([w[order] for w in words])
        hit = np.flatnonzero(again)
        if not len(hit):
            continue
        first = np.flatnonzero(np.concatenate(([True], (np.diff(hit) != 1) | (row[hit[1:]] != row[hit[:-1]]))))
        size = np.diff(np.append(first, len(hit))) - 1 + p.length
        yield _found(doc[row[hit[first]]], pos[row[hit[first]]] + step[hit[first]], size)


def _suffix_sorter(p: SuffixParams, cuts: list[np.ndarray]):
    """Spans of repeats, and the suffixes that are not decided here (with their bytes)."""
    lead, wide = 56, 256  # the anchor's left side is padded to whole words, and rows to one length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, part in _runs(batches, p):
            yield from decide(table, part)

    def decide(table: pa.RecordBatch, part: bool) -> Iterator[pa.RecordBatch]:
        doc, pos, shape = (table.column(c).to_numpy() for c in ("doc", "pos", "shape"))
        key = table.column("key").to_numpy().view(np.uint64)
        reached = _matrix(table.column("bytes"), p.width)
        open_ = np.ones(len(doc), bool) if part else _at_cut(table.column("bucket").to_numpy(), key, cuts[0])
        before, many = (shape >> 8).astype(np.int64), (shape & 255).astype(np.int64)
        rows = np.zeros((len(doc), wide), np.uint8)
        rows[:, lead : lead + p.width] = reached
        flat, base = rows.reshape(-1), np.arange(len(doc)) * wide
        right = _window_words(flat, base + lead + before, p.length)
        words = [*right, *_window_words(flat, base + before, lead)]
        order = multikey_quicksort([*words, shape, doc, pos])
        sorted_ = [w[order] for w in words]
        new = unequal([*sorted_, shape[order]])
        # the gram alone: its whole words and the rest of the last one
        gram = right[: p.seed // 8] + ([right[p.seed // 8] >> np.uint64(64 - 8 * (p.seed % 8))] if p.seed % 8 else [])
        group = np.cumsum(unequal([w[order] for w in gram])) - 1
        kinds = np.bincount(group, new)[group]
        again = order[~new]
        yield _found(doc[again], pos[again], many[again] + p.length - 1)
        undecided = order[new & open_[order]]
        if len(undecided):
            yield _batch(FOUND, doc[undecided], pos[undecided], np.zeros(len(undecided), np.int64), shape[undecided], reached[undecided])
        here = new & ~open_[order] & (kinds > 1)
        rows_here = order[here]
        if len(rows_here):
            yield from _repeated_windows(flat, base[rows_here] + lead, many[rows_here], doc[rows_here], pos[rows_here], group[here], p)

    return run


def _window_maker(p: SuffixParams, cuts: list[np.ndarray] | None):
    """All windows of undecided suffixes."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1 << 12):
                rows = batch.slice(a, 1 << 12)
                many = rows.column("shape").to_numpy() & 255
                flat = _matrix(rows.column("bytes"), p.width).reshape(-1)
                row = np.repeat(np.arange(rows.num_rows), many)
                step = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                strings = np.lib.stride_tricks.sliding_window_view(flat, p.length)[row * p.width + step]
                doc, pos = rows.column("doc").to_numpy()[row], rows.column("pos").to_numpy()[row] + step
                bucket = bucket_of([*big_endian(strings), doc, pos], cuts) if cuts else np.zeros(len(row), np.int32)
                yield _batch(WINDOW, bucket, strings, doc, pos)

    return make


EDGE = "doc long, pos long, edge int, first binary, last binary"


def _window_sorter(p: SuffixParams):
    """Repeated windows (edge null), and each bucket's first window with its first and last string (edge = bucket), from a sorted stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # bucket and string of the last row
        edge = None  # [doc, pos, bucket, first string] of the current bucket

        def edges(rows):
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in EDGE.split(", ")])

        for batch in batches:
            if not batch.num_rows:
                continue
            bucket, doc, pos = (batch.column(c).to_numpy() for c in ("bucket", "doc", "pos"))
            strings = _matrix(batch.column("bytes"), p.length)
            same = np.concatenate(([held is not None and held == (bucket[0], strings[0].tobytes())], (strings[1:] == strings[:-1]).all(axis=1) & (bucket[1:] == bucket[:-1])))
            n = int(same.sum())
            yield pa.RecordBatch.from_arrays([pa.array(doc[same]), pa.array(pos[same]), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], [c.split()[0] for c in EDGE.split(", ")])
            done = []
            for k in np.flatnonzero(np.diff(bucket, prepend=held[0] if held else -1)).tolist():
                if edge:
                    done.append((*edge, strings[k - 1].tobytes() if k else held[1]))
                edge = (int(doc[k]), int(pos[k]), int(bucket[k]), strings[k].tobytes())
            held = (bucket[-1], strings[-1].tobytes())
            if done:
                yield edges(done)
        if edge:
            yield edges([(*edge, held[1])])

    return run


def _merger(p: SuffixParams):
    """Merged intervals per (doc, copy) from a stream of windows sorted by doc and position."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # last, unfinished document: (doc, copy, starts, ends)
        for batch in batches:
            if not batch.num_rows:
                continue
            doc, pos, size = batch.column("doc").to_numpy(), batch.column("pos").to_numpy(), batch.column("size").to_numpy()
            copy, start = pos >> COPY_BITS, pos & (1 << COPY_BITS) - 1
            new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (copy[1:] != copy[:-1])))
            cuts = [*np.flatnonzero(new).tolist(), len(doc)]
            out = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                s, e = start[a:b], np.maximum.accumulate(start[a:b] + size[a:b])
                fresh = np.concatenate(([True], s[1:] > e[:-1]))
                at = np.flatnonzero(fresh)
                s, e = s[at], e[np.append(at[1:] - 1, len(e) - 1)]
                if held and held[:2] == (doc[a], copy[a]):
                    s, e = np.concatenate((held[2], s)), np.concatenate((held[3], e))
                elif held:
                    out.append(held)
                held = (doc[a], copy[a], s, e)
            if out:
                yield rows(out)
        if held:
            yield rows([held])

    def rows(out):
        return pa.RecordBatch.from_arrays(
            [
                pa.array([int(x[0]) for x in out], pa.int64()),
                pa.array([int(x[1]) for x in out], pa.int32()),
                pa.array([np.stack((x[2], x[3])).astype("<i8").tobytes() for x in out], pa.binary()),
            ],
            ["doc", "copy", "spans"],
        )

    return merge


CUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cutter(with_text: bool):
    names = [c.split()[0] for c in CUT.split(", ")] + ["kept"] * with_text

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, spans in zip(batch.column("doc_id"), batch.column("text"), batch.column("spans"), strict=True):
                raw = text.as_buffer() if text.is_valid else pa.py_buffer(b"")
                data, n_removed, n_spans, parts, at = memoryview(raw), 0, 0, [], 0
                if spans.is_valid:
                    s, e = np.frombuffer(spans.as_buffer(), "<i8").reshape(2, -1)
                    stop = np.maximum.accumulate(e)
                    fresh = np.flatnonzero(np.concatenate(([True], s[1:] > stop[:-1])))
                    s, e = s[fresh], stop[np.append(fresh[1:] - 1, len(stop) - 1)]
                    n_removed, n_spans = int((e - s).sum()), len(s)
                    for a, b in zip(s.tolist(), e.tolist(), strict=True):
                        parts.append(data[at:a])
                        at = b
                parts.append(data[at:])
                digest = hashlib.sha256()
                for part in parts:
                    digest.update(part)
                rows.append((doc_id.as_py(), len(data), n_removed, n_spans, digest.hexdigest(), *([b"".join(parts)] if with_text else [])))
            if rows:
                kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)], names)

    return cut


def _sampled(rows: DataFrame, names: list[str], p: SuffixParams, buckets: int) -> list[np.ndarray]:
    """Splitters from at most ``per_bucket`` keys for each bucket."""
    rows, columns = rows.select(*names).limit(p.per_bucket * buckets).toArrow(), []
    for name in names:
        if name == "bytes":
            columns += big_endian(_matrix(rows.column(name).combine_chunks() if rows.num_rows else pa.array([], pa.binary()), p.length))
        else:
            values = rows.column(name).to_numpy()
            columns.append(values.view(np.uint64) if name in ("g", "key") else values)
    return splitters(columns, buckets)


def _share(share: float, *columns: str):
    """A share of the rows by the hash of some columns."""
    return F.pmod(F.xxhash64(F.lit(9), *columns), F.lit(1 << 20)) < max(1, int(min(1.0, share) * (1 << 20)))


def _thinned(wanted: int, there: int) -> tuple[float, int]:
    """Share of the documents, and one in how many of a document's keys, for a sample of ``wanted`` of some ``there`` keys.

    Few keys of many documents: a string's share of the sample is then near its share of all.
    """
    one_in = min(64, max(1, there // max(wanted, 1)))
    return one_in * wanted / max(there, 1), one_in


def remove_repeats(docs: DataFrame, params: SuffixParams | None = None, with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row of ``docs`` (doc_id, text);
    with ``with_text`` also the kept bytes (cuts may fall inside a character).

    A null text is empty; a null doc_id counts as smaller than any other; rows
    that share a doc_id are ordered by their text; texts shorter than
    ``length`` keep every byte; more columns are ignored; an empty table gives
    no rows.
    """
    p = params or SuffixParams()
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    slim = slim.withColumn("doc", F.coalesce("doc_id", F.lit(-(1 << 63))))
    many = slim.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc")
    if many.isEmpty():
        keyed = slim.withColumn("copy", F.lit(0))
    else:  # repeated ids are numbered; the rest is left where it is
        many = materialise(many, "suffix-ids")
        numbered = slim.join(many, "doc", "left_semi").withColumn("copy", F.row_number().over(Window.partitionBy("doc").orderBy("text")) - 1)
        keyed = slim.join(many, "doc", "left_anti").withColumn("copy", F.lit(0)).unionByName(numbered)
    total = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = p.buckets(total, p.least_buckets)
    parts = min(buckets, max(int(spark.conf.get("spark.sql.shuffle.partitions")), buckets // 4))
    texts = keyed.select("doc", "copy", "text")

    # 1. anchors whose gram repeats; about 1 byte in 25 is an anchor
    wanted = p.per_bucket * buckets
    share, one_in = _thinned(wanted // 2, total // 25)
    sample = texts.filter(_share(share, "doc")).mapInArrow(_seed_maker(p, None), SEED).filter(_share(1 / one_in, "doc", "pos"))
    cuts = _sampled(sample, ["g", "doc", "pos"], p, buckets)
    seeds = texts.mapInArrow(_seed_maker(p, cuts), SEED).repartition(parts, "bucket").sortWithinPartitions("g")
    repeated = materialise(seeds.mapInArrow(_repeated_seeds(cuts), "doc long, pos long"), "suffix-seeds")
    copy = F.shiftright("pos", COPY_BITS).cast("int").alias("copy")
    listed = materialise(repeated.select("doc", copy, "pos").groupBy("doc", "copy").agg(F.collect_list("pos").alias("open")), "suffix-anchors")
    release(repeated)
    n_open = listed.agg(F.sum(F.size("open"))).first()[0] or 0

    # 2. suffixes at those anchors; documents for the splitters are at most as many as the keys wanted
    share, one_in = _thinned(wanted // 2, n_open)
    few = F.filter("open", lambda x: F.pmod(F.xxhash64(F.lit(9), "doc", x), F.lit(one_in)) == 0).alias("open")
    picked = listed.filter(_share(share, "doc")).select("doc", "copy", few).filter(F.size("open") > 0).limit(wanted)
    sample = texts.join(F.broadcast(picked), ["doc", "copy"]).mapInArrow(_suffix_maker(p, None), SUFFIX)
    cuts = _sampled(sample, ["key", "doc", "pos"], p, buckets)
    marked = texts.join(listed.hint("merge"), ["doc", "copy"])  # sizes are not bounded: no broadcast
    suffixes = marked.mapInArrow(_suffix_maker(p, cuts), SUFFIX).repartition(parts, "bucket").sortWithinPartitions("key")
    found = materialise(suffixes.mapInArrow(_suffix_sorter(p, cuts), FOUND), "suffix-found")
    release(listed)

    # 3. windows of the grams that a cut parts
    undecided = found.filter("bytes IS NOT NULL").select("doc", "pos", "shape", "bytes")
    n_rows, n_windows = undecided.agg(F.count(F.lit(1)), F.sum(F.col("shape").bitwiseAND(F.lit(255)))).first()
    spans = found.filter("bytes IS NULL").select("doc", "pos", "size")
    if n_rows:
        few = p.buckets(n_windows * p.length, min(parts, n_rows))
        share, one_in = _thinned(p.per_bucket * few // 2, n_windows)
        sample = undecided.filter(_share(share, "doc", "pos")).mapInArrow(_window_maker(p, None), WINDOW).filter(_share(1 / one_in, "doc", "pos"))
        cuts = _sampled(sample, ["bytes", "doc", "pos"], p, few)
        windows = undecided.mapInArrow(_window_maker(p, cuts), WINDOW).repartition(min(few, parts), "bucket").sortWithinPartitions("bucket", "bytes", "doc", "pos")
        windows = materialise(windows.mapInArrow(_window_sorter(p), EDGE), "suffix-windows")
        # one row per bucket, at most ``most_buckets``: a bucket's first window repeats if the bucket before ends with the same string
        ends = windows.filter("edge IS NOT NULL").withColumn("ahead", F.lag("last").over(Window.orderBy("edge")))
        across = ends.filter("first = ahead").select("doc", "pos")
        size = F.lit(p.length).cast("long").alias("size")
        spans = spans.unionByName(windows.filter("edge IS NULL").select("doc", "pos", size)).unionByName(across.select("doc", "pos", size))

    # 4. intervals per document
    spans = spans.withColumn("copy", F.shiftright("pos", COPY_BITS))
    merged = spans.repartition("doc", "copy").sortWithinPartitions("doc", "pos").mapInArrow(_merger(p), "doc long, copy int, spans binary")
    merged = materialise(merged, "suffix-spans")
    release(found)
    joined = keyed.join(merged.hint("merge"), ["doc", "copy"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_cutter(with_text), CUT + ", kept binary" * with_text)


def op5_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Remove repeated 100-byte strings from all of ``documents``."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
