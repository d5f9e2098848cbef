"""Vectorised text primitives over many documents at once.

A slice of documents is one byte buffer with offsets.  Words, shingles and
windows are found with whole-buffer numpy operations; polynomial prefix hashes
give the hash of any substring in constant time.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
#: The inverse of BASE modulo 2**64.
BASE_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SLICE_BYTES = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i below n."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, SLICE_BYTES + 1)
        for name, base in (("up", BASE), ("down", BASE_INVERSE)):
            out = np.full(size, base, dtype=U)
            out[0] = U(1)
            _powers[name] = np.multiply.accumulate(out)
    return _powers["up"][:n], _powers["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: spreads differences over all 64 bits."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def _return_memory() -> None:
    """Makes a worker give freed arrays back to the system at once.

    Workers are kept from task to task; by default the C library and Arrow
    keep the largest arrays' memory for them, which adds up on an executor.
    """
    if "settled" in _powers:
        return
    _powers["settled"] = np.zeros(0)
    try:
        mallopt = ctypes.CDLL(None).mallopt
    except (OSError, AttributeError):  # another C library
        return
    mallopt(-3, 1 << 20)  # from 1 MB on, allocations are mappings of their own
    mallopt(-1, 1 << 22)  # and the heap's end is trimmed
    pa.set_memory_pool(pa.system_memory_pool())


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of a batch whose texts together stay near ``limit`` bytes (one longer text is a part of its own)."""
    _return_memory()
    data, offsets = buffers(batch.column(batch.schema.get_field_index(column)))
    first = 0
    while first < batch.num_rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(batch.num_rows, max(last, first + 1))
        yield batch.slice(first, last - first), data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, every other byte as it is."""
    return _LOWER[data]


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of True that stay within one document."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cuts = offsets[1:-1]
    cuts = cuts[cuts < n]
    edge = np.empty(n + 1, dtype=bool)
    edge[0] = inside[0]
    np.not_equal(inside[1:], inside[:-1], out=edge[1:n])
    edge[n] = inside[-1]
    split = cuts[(cuts > 0)]
    split = split[inside[split] & inside[split - 1]]
    at = np.flatnonzero(edge)
    starts, ends = at[::2], at[1::2]
    if len(split):
        split = np.unique(split)
        starts, ends = np.sort(np.concatenate([starts, split])), np.sort(np.concatenate([ends, split]))
    return starts, ends


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of ``[^\\x20\\x09-\\x0D]+`` words, and for each document the index of its first word (with a final total)."""
    starts, ends = runs(~_SEPARATOR[data], offsets)
    return starts, ends, np.searchsorted(starts, offsets)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] = sum of (byte + 1) * BASE**k over i <= k < j."""
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, dtype=U)
    np.cumsum((data.astype(U) + U(1)) * up, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Position-free hash of each [start, end) and its length."""
    _, down = powers(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every lower-cased word, and each document's first word's index."""
    starts, ends, first = words(data, offsets)
    return span_hash(prefix_hash(lower(data)), starts, ends), first


def shingle_hashes(hashes: np.ndarray, first: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of ``width`` words within a document and their first indexes by document.

    A document with fewer words but at least one has one shingle, its whole
    sequence; a document without words has none.
    """
    n = np.diff(first)
    count = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(count)])
    begin = np.repeat(first[:-1], count) + (np.arange(at[-1]) - np.repeat(at[:-1], count))
    length = np.minimum(np.repeat(n, count), width)
    out = length.astype(U) * U(0xA0761D6478BD642F)
    for i in range(width):
        ok = i < length
        step = mix(out * U(0xE7037ED1A0B428DB) + hashes[np.where(ok, begin + i, 0)]) if len(hashes) else out
        out = np.where(ok, step, out)
    return out, at
