"""Hashed words and word n-grams of Arrow text columns, vectorised over bytes.

A word is a maximal run of bytes other than ASCII white space in the
lower-cased text.  Its hash is a polynomial over a random byte table modulo
2**64, taken from prefix sums, so no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

NGRAM = 5
CHUNK_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_rng = np.random.default_rng(20240607)
_TABLE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit (splitmix64's constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    if len(_powers.get("up", ())) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def text_bytes(column: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows end to end and the rows' offsets; a null row is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if lower:
        column = pc.utf8_lower(column)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def byte_chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes; a longer row is a range of its own."""
    ends = np.cumsum(np.maximum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), 1))
    at = 0
    while at < len(ends):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
        yield at, to
        at = to


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of every row, end to end, and the rows' offsets into them."""
    raw, offsets = text_bytes(column, lower=True)
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    space = _SPACE[raw]
    edge = np.ones(n + 1, bool)
    edge[1:] = np.append(space, True)[: n]
    inner = offsets[(offsets > 0) & (offsets < n)]
    edge[inner] = True
    starts = np.flatnonzero(edge[:n] & ~space)
    close = np.ones(n, bool)
    close[:-1] = space[1:]
    close[inner - 1] = True
    ends = np.flatnonzero(close & ~space) + 1
    up, down = powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_TABLE[raw] * up, out=sums[1:])
    hashes = mix64((sums[ends] - sums[starts]) * down[starts])
    return hashes, np.searchsorted(starts, offsets).astype(np.int64)


def ngrams(words: np.ndarray, offsets: np.ndarray, n: int = NGRAM) -> tuple[np.ndarray, np.ndarray]:
    """Hashed word n-grams of every row and the rows' offsets.

    A row of 1 to n-1 words has one gram of all its words; an empty row has none.
    """
    counts = np.diff(offsets)
    total = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    out = np.concatenate(([0], np.cumsum(total)))
    mult = np.uint64(0xD6E8FEB86659FD93)
    acc = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for k in range(n if len(acc) else 0):
        acc = acc * mult + words[k : k + len(acc)]
    grams = np.zeros(out[-1], np.uint64)
    full = np.flatnonzero(counts >= n)
    if len(full):
        sizes = total[full]
        at = np.repeat(offsets[full] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        to = np.repeat(out[full] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        grams[to] = acc[at]
    for row in np.flatnonzero((counts > 0) & (counts < n)):
        h = int(counts[row])
        for w in words[offsets[row] : offsets[row + 1]].tolist():
            h = (h * int(mult) + w) & (1 << 64) - 1
        grams[out[row]] = h
    return mix64(grams), out
