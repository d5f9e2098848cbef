"""Compact blocks: many small records of one destination as one row.

A record of a few bytes costs a JVM row several times its size.  Tasks sort
their records by destination and send one binary row to each, with numbers as
compressed byte planes; so shuffles carry little more than the information.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F


def prime(n: int) -> int:
    """The least prime from n on: ids with a common factor still spread over that many parts."""
    while n < 2 or any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


#: Text of a part.  The number of parts so follows the input, not the session's partitions.
PART_BYTES = 8 << 20


def parts_for(source: DataFrame, text_col: str = "text", least: int = 11) -> int:
    """Into how many parts to deal the texts (and what is found in them) so that a part has about ``PART_BYTES``."""
    total = source.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
    return prime(max(least, -(-total // PART_BYTES)))


def squeeze(x: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x)


def expand(x: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(x)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, each as compressed byte planes."""
    n = len(arrays[0])
    body = [squeeze(np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(n, x.dtype.itemsize).T).tobytes()) for x in arrays]
    return np.array([n, len(arrays), *map(len, body)], dtype=np.int64).tobytes() + b"".join(body)


def unpack(raw: bytes, *dtypes) -> list[np.ndarray]:
    n, k = (int(x) for x in np.frombuffer(raw, np.int64, 2))
    out, at = [], 16 + 8 * k
    for size, dtype in zip(np.frombuffer(raw, np.int64, k, 16).tolist(), dtypes, strict=True):
        dtype = np.dtype(dtype)
        planes = np.frombuffer(expand(raw[at : at + size]), np.uint8).reshape(dtype.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(dtype))
        at += size
    return out


def delta(x: np.ndarray) -> np.ndarray:
    """First differences, for sorted arrays to compress; np.cumsum undoes it."""
    return np.diff(x, prepend=x.dtype.type(0))


def by_value(key: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(value, indexes) for each distinct value."""
    order = np.argsort(key, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(key[order])) + 1) if len(order) else []:
        yield int(key[part[0]]), part


def rows(kinds, keys, payloads) -> pa.RecordBatch:
    return pa.record_batch([pa.array(kinds, pa.int32()), pa.array(keys, pa.int64()), pa.array(payloads, pa.binary())], ["kind", "key", "payload"])


VECTOR_ROWS = "chunk int, salt int, payload binary"


def vector_rows(x: np.ndarray, salt: int, chunk: int = 1 << 13, dtype=None) -> pa.RecordBatch:
    """A dense vector as rows of chunks, to be summed by ``sum_vectors``."""
    parts = [x[i : i + chunk] for i in range(0, len(x), chunk)]
    return pa.record_batch([pa.array(range(len(parts)), pa.int32()), pa.array([salt] * len(parts), pa.int32()), pa.array([squeeze(p.astype(dtype or x.dtype).tobytes()) for p in parts], pa.binary())], ["chunk", "salt", "payload"])


def sum_vectors(vectors: DataFrame, dtype=np.int64, merge=np.add) -> np.ndarray:
    """The sum (or other merger) of all tasks' vectors, in two levels so that no task reads more than a fraction of them; the result has a vector's size."""

    def add(table: pa.Table) -> pa.Table:
        total = None
        for raw in table["payload"]:
            x = np.frombuffer(expand(raw.as_py()), dtype)
            total = x.copy() if total is None else merge(total, x)
        return pa.table([table["chunk"].slice(0, 1), pa.array([-1], pa.int32()), pa.array([squeeze(total.tobytes())], pa.binary())], names=["chunk", "salt", "payload"])

    some = vectors.groupBy("chunk", "salt").applyInArrow(add, VECTOR_ROWS)
    found = {r.chunk: np.frombuffer(expand(bytes(r.payload)), dtype) for r in some.groupBy("chunk").applyInArrow(add, VECTOR_ROWS).select("chunk", "payload").collect()}
    return np.concatenate([found[i] for i in sorted(found)]) if found else np.zeros(0, dtype)


BLOOM_BITS = (16, 27)


class Bloom:
    """Membership of 64-bit ids, without false negatives, in at most 16 MB.

    It goes before a join to keep most rows out of its shuffle; the join stays
    exact.  With more ids than the bound holds it lets more rows through.
    """

    def __init__(self, ids: DataFrame, bits_each: int = 16):
        bits = min(max((bits_each * ids.count()).bit_length(), BLOOM_BITS[0]), BLOOM_BITS[1])

        def mark(batches):
            own = np.zeros(1 << (bits - 3), dtype=np.uint8)
            for batch in batches:
                for at in _places(batch.column(0).to_numpy(zero_copy_only=False), bits):
                    np.bitwise_or.at(own, at >> 3, (1 << (at & 7)).astype(np.uint8))
            yield vector_rows(own, int(own.sum()) & 15, 1 << 16)

        table = sum_vectors(ids.mapInArrow(mark, VECTOR_ROWS), np.uint8, np.bitwise_or)
        self.bits, self.table = bits, table if len(table) else np.zeros(1 << (bits - 3), np.uint8)

    def has(self, ids: np.ndarray) -> np.ndarray:
        found = np.ones(len(ids), dtype=bool)
        for at in _places(ids, self.bits):
            found &= (self.table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return found


def _places(ids: np.ndarray, bits: int):
    from .textkernel import mix

    h = mix(ids.astype(np.int64).view(np.uint64) + np.uint64(1))
    yield (h >> np.uint64(64 - bits)).astype(np.int64)
    yield (h & np.uint64((1 << bits) - 1)).astype(np.int64)
