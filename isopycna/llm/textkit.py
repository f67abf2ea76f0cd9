"""Word hashing over whole Arrow batches, shared by the text operators.

A word is a run of bytes outside ``\\x20\\x09-\\x0D`` after A-Z are lower-cased;
every other byte, of any script, is kept.  Words are hashed to 64 bits without
a Python loop over words: bytes are mapped through a fixed random table,
weighted by powers of an odd base, and a prefix sum turns every word into one
subtraction.  Nulls count as empty texts.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at once; bounds the memory of a worker.
CHUNK_BYTES = 1_000_000

U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15)
BASE_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Hash of the token that ends a document.
END = U64(0x5851F42D4C957F2D)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


#: Every ASCII character that is neither a letter nor a digit separates words, for operators that ignore punctuation.
MARKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def _byte_table() -> np.ndarray:
    table = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
    table[ord("A") : ord("Z") + 1] = table[ord("a") : ord("z") + 1]
    return table


_TABLE = _byte_table()
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1), base, np.uint64)
        steps[0] = 1
        _powers[kind] = have = np.multiply.accumulate(steps)
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit integers."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U64(33))
    h = h * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


def release() -> None:
    """Give freed memory back to the system; workers live on from task to task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def lean(run: Callable) -> Callable:
    """``run``, a function of batches, releasing memory after each batch and at the end."""

    def watched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch
            del batch
            release()

    def lean_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(watched(batches))
        release()

    return lean_run


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; one long text makes a range of its own."""
    offsets = offsets_of(texts)
    n, row = len(texts), 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end
        row = end


def offsets_of(texts: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    raw = texts.buffers()[1]
    if raw is None or len(texts) == 0:
        return np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(raw, kind, len(texts) + 1, texts.offset * np.dtype(kind).itemsize).astype(np.int64)


def filled(texts) -> pa.Array:
    """One contiguous string array without nulls."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    return texts.fill_null("") if texts.null_count else texts


def word_hashes(texts: pa.Array, first: int, last: int, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of rows ``first`` to ``last`` in order, and each row's bounds in them.

    ``between`` tells the bytes that separate words.
    """
    h, bounds, _, _ = word_places(texts, first, last, between)
    return h, bounds


def word_places(texts: pa.Array, first: int, last: int, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As ``word_hashes``, and where each word starts and ends, in bytes from the start of row ``first``."""
    offsets = offsets_of(texts)[first : last + 1]
    lo, hi = int(offsets[0]), int(offsets[-1])
    rows = last - first
    data = texts.buffers()[2]
    if hi == lo or data is None:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64), none, none
    raw = np.frombuffer(data, np.uint8, hi - lo, lo)
    offsets = offsets - lo
    inner = offsets[:-1][offsets[:-1] < hi - lo]
    solid = ~between[raw]
    breaks = np.zeros(hi - lo + 1, bool)
    breaks[inner] = True
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | breaks[1:-1]
    starts = np.flatnonzero(begins)
    stops = solid.copy()
    stops[:-1] &= ~solid[1:] | breaks[1:-1]
    ends = np.flatnonzero(stops) + 1
    n = hi - lo
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(_TABLE[raw] * _power("up", BASE, n)[:n], out=total[1:])
    h = (total[ends] - total[starts]) * _power("down", BASE_INVERSE, n)[starts]
    return mix(h), np.searchsorted(starts, offsets), starts, ends


def shingles(words: np.ndarray, bounds: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's runs of ``width`` words, with repeats, and each row's bounds in them.

    A row with fewer words, but at least one, has the whole sequence as its only shingle.
    """
    counts = np.diff(bounds)
    n = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    out_bounds = np.concatenate([[0], np.cumsum(n)])
    if not len(words):
        return np.zeros(0, np.uint64), out_bounds
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    h = np.zeros(len(words), np.uint64)
    for k in range(width):
        h = h * U64(0xD1342543DE82EF95) + padded[k : k + len(words)]
    long = np.repeat(counts >= width, counts)
    place = np.arange(len(words)) - np.repeat(bounds[:-1], counts)
    keep = long & (place < np.repeat(n, counts))
    short = np.flatnonzero((counts > 0) & (counts < width))
    for r in short:
        value = U64(0)
        with np.errstate(over="ignore"):
            for w in words[bounds[r] : bounds[r + 1]]:
                value = mix(np.array([value * U64(0xD1342543DE82EF95) + w + U64(counts[r])]))[0]
        h[bounds[r]] = value
        keep[bounds[r]] = True
    return mix(h[keep]), out_bounds
