"""Vectorised text primitives for Arrow batches: chunking, word bounds and hashes of byte spans and of word sequences.

Everything works on the UTF-8 bytes of an Arrow string column without making Python strings.  A chunk is a run of whole
texts of about ``CHUNK`` bytes; a text is never cut, so a longer one is a chunk of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
U = np.uint64
#: Sequences of items are hashed as polynomials over the field of this many elements, in which no pattern makes bases alike.
PRIME = U((1 << 61) - 1)
_BASE = 0x1B873593CC9E2D51 % int(PRIME)
#: Spans of more bytes than this are hashed one by one.
LONG = 256

#: The ASCII white space of the word pattern ``[^\x20\x09-\x0D]+``.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: A-Z to a-z, all other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & PRIME) + (x >> U(61))
    return np.where(x >= PRIME, x - PRIME, x)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo PRIME of numbers below it."""
    a1, a0, b1, b0 = a >> U(31), a & U((1 << 31) - 1), b >> U(31), b & U((1 << 31) - 1)
    mid = a1 * b0 + a0 * b1
    return _reduced(U(2) * a1 * b1 + (mid >> U(30)) + ((mid & U((1 << 30) - 1)) << U(31)) + a0 * b0)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo PRIME."""
    if len(_powers[0]) < n:
        for k, b in enumerate((_BASE, pow(_BASE, -1, int(PRIME)))):
            p = _powers[k]
            while len(p) < n:
                p = np.concatenate((p, _times(p, np.full(1, pow(b, len(p), int(PRIME)), U))))
            _powers[k] = p
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that all bits depend on all bits."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


@dataclass
class Chunk:
    lo: int  # first row of the batch
    hi: int
    buf: np.ndarray  # bytes of rows lo..hi
    offs: np.ndarray  # hi - lo + 1 offsets into buf
    null: np.ndarray

    def __len__(self) -> int:
        return self.hi - self.lo


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[Chunk]:
    """Runs of whole texts of the column; a null is an empty text with its flag set."""
    if pa.types.is_large_string(column.type):
        width = np.int64
    else:
        column, width = column.cast(pa.string()), np.int32
    n = len(column)
    null = np.asarray(column.is_null()) if column.null_count else np.zeros(n, bool)
    if column.null_count:
        column = column.fill_null("")
    _, o, data = column.buffers()
    offs = np.frombuffer(o, width)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield Chunk(lo, hi, raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], null[lo:hi])
        lo = hi


def bytes_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of each span's bytes and their number, eight bytes at a step; different seeds give independent hashes."""
    size = (end - start).astype(np.int64)
    out = mix((size.astype(U) + U(1)) * U(0xD6E8FEB86659FD93) + U(seed * 0x9E3779B97F4A7C15 % (1 << 64)))
    eight = np.ndarray(len(buf) + 1, "<u8", np.concatenate((buf, np.zeros(8, np.uint8))), strides=(1,))
    live = np.flatnonzero((size > 0) & (size <= LONG))
    at, left, h = start[live], size[live], out[live]
    while len(live):
        v = eight[at]
        short = left < 8
        v[short] &= (U(1) << (left[short].astype(U) * U(8))) - U(1)
        h = mix(h * U(0xFF51AFD7ED558CCD) + v)
        out[live] = h
        on = left > 8
        live, at, left, h = live[on], at[on] + 8, left[on] - 8, h[on]
    key = seed.to_bytes(8, "little")
    for k in np.flatnonzero(size > LONG).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(buf[start[k] : end[k]].tobytes(), digest_size=8, key=key).digest(), "little")
    return out


def item_sums(items: np.ndarray) -> np.ndarray:
    """Prefix sums of a sequence of 64-bit items such as word hashes, from which ``span_hash`` reads the hash of any span."""
    pw, _ = powers(len(items) + 1)
    out = np.zeros((2, len(items) + 1), U)
    term = _times(_reduced(items), pw[: len(items)])
    np.cumsum(term & U(0xFFFFFFFF), out=out[0, 1:])
    np.cumsum(term >> U(32), out=out[1, 1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the span's items and their number; equal spans have equal hashes wherever they stand."""
    _, inv = powers(sums.shape[1])
    low, high = sums[:, end] - sums[:, start]
    h = _times(_reduced(_times(_reduced(high), np.full(1, 1 << 32, U)) + _reduced(low)), inv[start])
    return mix(h + (end - start).astype(U) * U(0xD6E8FEB86659FD93))


def word_bounds(buf: np.ndarray, offs: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and for each text (and one more) the index of its first word."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    inside = ~space[buf]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offs)


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The concatenation of the ranges starts[i] .. starts[i] + counts[i]."""
    counts = counts.astype(np.int64)
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - (np.cumsum(counts) - counts), counts)
    return shift + np.arange(total)


def text_of(c: Chunk, k: int) -> bytes:
    return c.buf[c.offs[k] : c.offs[k + 1]].tobytes()
