"""Vectorised byte and word primitives shared by the operators.

Texts arrive as Arrow batches; every routine works on one flat byte buffer with
document offsets, so a batch costs a fixed number of numpy passes however many
documents it holds. Null texts count as empty.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Text that one round of numpy passes takes; its arrays are eight times as large and should stay near the cache.
BLOCK_BYTES = 1 << 18

#: ASCII white space that separates words: space, tab, LF, VT, FF, CR.
SPACE_WORD = np.ones(256, bool)
SPACE_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

#: ASCII letters, digits and every byte of a non-ASCII character.
ALNUM_WORD = np.zeros(256, bool)
ALNUM_WORD[0x30:0x3A] = True
ALNUM_WORD[0x41:0x5B] = True
ALNUM_WORD[0x61:0x7B] = True
ALNUM_WORD[0x80:] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document offsets (starting at 0) of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def blocks(offsets: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Document ranges [a, b) of about ``size`` bytes each; a longer document is a range of its own."""
    out, a, n = [], 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1
        b = min(n, max(a + 1, b))
        out.append((a, b))
        a = b
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, in place where it can be."""
    h = h.astype(U64, copy=True)
    h ^= h >> U64(30)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def unmix(h: np.ndarray) -> np.ndarray:
    """The values that ``mix`` turns into ``h``: it is a bijection."""
    h = h.astype(U64, copy=True)
    h ^= (h >> U64(31)) ^ (h >> U64(62))
    h *= U64(pow(0x94D049BB133111EB, -1, 1 << 64))
    h ^= (h >> U64(27)) ^ (h >> U64(54))
    h *= U64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    h ^= (h >> U64(30)) ^ (h >> U64(60))
    return h


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


@lru_cache(maxsize=2)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, U64)
    done = 1
    factor = base
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * U64(factor)
        factor = factor * factor % (1 << 64)
        done *= 2
    return out


def powers(base: int, n: int) -> np.ndarray:
    size = 1 << max(16, (max(n, 1) - 1).bit_length())
    return _powers(base, size)[:n]


@lru_cache(maxsize=2)
def _byte_values(lower: bool) -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93))
    return values[LOWER] if lower else values


def prefix_hash(data: np.ndarray, lower: bool = False) -> np.ndarray:
    """Prefix sums of the polynomial hash (modulo 2**64) of all bytes; one longer than the data.

    For rolling grams of well under 512 bytes that are compared byte by byte later: from 1,024 bytes on, unlike spans
    can be built that share this hash. Whole words go through ``word_hashes``.
    """
    out = np.zeros(len(data) + 1, U64)
    v = _byte_values(lower)[data]
    v *= powers(_BASE, len(data))
    np.cumsum(v, out=out[1:])
    return out


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the words before each document (one longer than the documents)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = table[data]
    edge = np.empty(n + 1, bool)
    edge[0], edge[n] = inside[0], inside[-1]
    np.not_equal(inside[1:], inside[:-1], out=edge[1:n])
    cuts = np.unique(offsets[(offsets > 0) & (offsets < n)])
    cuts = cuts[inside[cuts] & inside[cuts - 1]]  # a word ends and another starts at such a document's edge
    at = np.flatnonzero(edge)
    if len(cuts):
        at = np.sort(np.concatenate([at, cuts, cuts]), kind="stable")
    starts, ends = at[0::2], at[1::2]
    return starts, ends, np.searchsorted(starts, offsets, "left")


#: Longest word that is hashed in numpy, eight bytes a pass; longer ones are digested one by one.
LONG_WORD = 64
_LOW_BYTES = np.array([(1 << 8 * i) - 1 for i in range(9)], U64)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hashes of byte spans, the same for the same bytes wherever they stand.

    Eight bytes at a time go through a bijective mixer, so spans of up to eight bytes and equal length never collide;
    spans over ``LONG_WORD`` bytes have the first 64 bits of their BLAKE2b digest.
    """
    if lower:
        data = LOWER[data]
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    at_byte = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    size = ends - starts
    h = mix(size.astype(U64) * U64(0xA0761D6478BD642F) + U64(0x9E3779B97F4A7C15))
    todo = np.flatnonzero(size <= LONG_WORD)
    for done in range(0, LONG_WORD, 8):
        todo = todo[size[todo] > done]
        if not len(todo):
            break
        chunk = at_byte[starts[todo] + done] & _LOW_BYTES[np.minimum(size[todo] - done, 8)]
        h[todo] = mix(h[todo] ^ chunk) + U64(0xD6E8FEB86659FD93)
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def gram_hashes(h: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Hashes of all runs of ``size`` consecutive values (runs across documents included); each seed is a function of its own."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    c = (0x8CB92BA72F3D8DD7 + seed * 0x9E3779B97F4A7C16) % (1 << 64) | 1
    for i in range(size):
        out += h[i : i + n] * U64(c)
        c = (c * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) % (1 << 64) | 1
    return mix(out)


def distinct(keys: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of (key, check) pairs: the first place of each distinct one, in ascending order, and which one each place has."""
    by = np.lexsort((check, keys))
    new = np.ones(len(by), bool)
    new[1:] = (keys[by[1:]] != keys[by[:-1]]) | (check[by[1:]] != check[by[:-1]])
    which = np.empty(len(by), np.int64)
    which[by] = np.cumsum(new) - 1
    return by[new], which


def inside_documents(word_offsets: np.ndarray, size: int) -> np.ndarray:
    """For each position that starts a run of ``size`` words, whether the run stays in one document."""
    n = int(word_offsets[-1])
    ok = np.ones(max(0, n - size + 1), bool)
    for back in range(1, size):
        at = word_offsets[1:-1] - back
        ok[at[(at >= 0) & (at < len(ok))]] = False
    return ok


def cover(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Mask of the positions inside any [start, start + length)."""
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, starts, 1)
    np.add.at(d, np.minimum(starts + length, n), -1)
    return np.cumsum(d[:-1]) > 0


def planes(values: np.ndarray) -> bytes:
    """64-bit values as eight byte planes, so that the shuffle's codec removes the empty ones."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unplanes(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw, np.uint8).reshape(8, -1)
    return np.ascontiguousarray(b.T).view("<u8").ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys as planes of their differences."""
    return planes(np.diff(keys, prepend=U64(0)))


def unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(unplanes(raw), dtype=U64)


def texts_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A string column from a flat buffer."""
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))).cast(pa.string())
