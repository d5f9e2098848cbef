"""Exact top-k search in binary codes by incremental multi-index hashing.

A vector's code has one bit for each dimension, set where the value is
positive, in as many words of 64 bits as the longest vector needs.  A block of
codes is indexed by each segment of 16 bits.  A query looks up its own
segments, then segments one bit away, and so on; found codes are verified by
their full Hamming distance.  With S segments, after radius r in the first a
of them and r - 1 in the others every code within ``S * r + a - 1`` has been
found, so the search stops, query by query, when its k-th verified distance is
below the first distance not covered: the result is exact, with ties by id.

Scale: codes are packed into blocks of bounded size, each indexed once for a
group of at most ``BLOCK_QUERIES`` queries; every pair of a block and a group
is a row of its own, so work spreads whatever the number of blocks, and each
pair returns at most k rows for a query.  Queries are a stated set against all
rows, so the pairs grow with the product of both; a query reads few codes of a
block.  Copies of one vector are one code, with its k + 1 smallest ids only.

Edge cases: rows without id or without a vector (null or empty) are neither
indexed nor queries; missing and null dimensions count as not positive; very
long vectors have longer codes; of rows that repeat an id the one with the
smallest code counts; a query with fewer than k others gets all; an empty
table gives an empty result; other columns, also of clashing names, are
ignored.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .packing import pack, unpack
from .scratch import Scratch

WORD_BITS, WIDTH = 64, 16
SEGMENTS = WORD_BITS // WIDTH
BLOCK_CODES = 1 << 17
BLOCK_QUERIES = 4096
#: Rows of blocks and groups that there should be at least, for tasks to share.
LEAST_PAIRS = 32
_U = np.uint64
_MASKS = {r: np.array([sum(1 << b for b in c) for c in combinations(range(WIDTH), r)] or [0], dtype=np.int64) for r in range(5)}


def masks(radius: int) -> np.ndarray:
    """All segment differences of ``radius`` bits."""
    if radius not in _MASKS:
        _MASKS[radius] = np.flatnonzero(np.bitwise_count(np.arange(1 << WIDTH)) == radius)
    return _MASKS[radius]


def code_of(vector: Column, words: int) -> Column:
    """The signs of a vector, ``words`` numbers of 64 bits."""
    bit = lambda w, i: F.when(F.get(vector, F.lit(w * WORD_BITS + i)) > 0, F.shiftleft(F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))
    return F.array(*(reduce(lambda a, b: a.bitwiseOR(b), (bit(w, i) for i in range(WORD_BITS))) for w in range(words)))


def distances(codes: np.ndarray, code: np.ndarray) -> np.ndarray:
    return np.bitwise_count(codes ^ code).sum(axis=1, dtype=np.int64)


class Index:
    """Distinct codes, a row of words each, by segment value."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.segments = codes, codes.shape[1] * SEGMENTS
        self.by, self.bounds = [], []
        for s in range(self.segments):
            value = self.segment(codes, s)
            order = np.argsort(value, kind="stable")
            self.by.append(order)
            self.bounds.append(np.searchsorted(value[order], np.arange((1 << WIDTH) + 1)))

    @staticmethod
    def segment(codes: np.ndarray, s: int) -> np.ndarray:
        return ((codes[:, s // SEGMENTS] >> _U(WIDTH * (s % SEGMENTS))) & _U((1 << WIDTH) - 1)).astype(np.int64)

    def probe(self, code: np.ndarray, s: int, radius: int) -> np.ndarray:
        """Places of the codes whose segment s is ``radius`` bits from the query's."""
        wanted = self.segment(code, s) ^ masks(radius)
        low, n = self.bounds[s][wanted], self.bounds[s][wanted + 1] - self.bounds[s][wanted]
        hit = n > 0
        low, n = low[hit], n[hit]
        return self.by[s][np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())] if len(n) else self.by[s][:0]


def search(index: Index, first_id: np.ndarray, ids: np.ndarray, query_id: int, code: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The k nearest (distance, id) of a block, the query's own id left out."""
    code = code[None]
    seen, distance = np.zeros(0, np.int64), np.zeros(0, np.int64)
    best: list[tuple[int, int]] = []
    for radius in range(WIDTH + 1):
        for s in range(index.segments):
            fresh = np.setdiff1d(index.probe(code, s, radius), seen, assume_unique=False)
            if len(fresh):
                seen, distance = np.concatenate([seen, fresh]), np.concatenate([distance, distances(index.codes[fresh], code)])
                near = np.arange(len(seen))
                if len(seen) > k:  # codes beyond the k-th nearest have no id among the k
                    near = np.flatnonzero(distance <= np.partition(distance, k)[k])
                best = sorted((int(distance[c]), i) for c in near.tolist() for i in ids[first_id[seen[c]] : first_id[seen[c] + 1]].tolist() if i != query_id)[:k]
            covered = index.segments * radius + s  # every code up to this distance has been found
            if len(seen) == len(index.codes) or len(best) == k and best[-1][0] <= covered:
                return best
    return best


def _codes(column: pa.ChunkedArray | pa.Array, words: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).view(_U).reshape(-1, words)


def _firsts(codes: np.ndarray) -> np.ndarray:
    """Where each distinct code begins, of sorted ones."""
    return np.flatnonzero(np.concatenate([[True], (codes[1:] != codes[:-1]).any(axis=1)]))


def _packer(k: int, words: int):
    def read(table: pa.Table) -> pa.Table:
        ids, codes = table["id"].to_numpy(), _codes(table["code"], words)
        order = np.lexsort((ids, *codes.T))
        ids, codes = ids[order], codes[order]
        new = _firsts(codes)
        place = np.arange(len(ids)) - np.repeat(new, np.diff(np.append(new, len(ids))))
        few = place <= k  # one more than k, for the query's own
        return pa.table([table["block"].slice(0, 1), pa.array([pack(ids[few], *codes[few].T)], pa.binary())], names=["block", "payload"])

    return read


def _searcher(k: int, words: int):
    def read(batches):
        held, index = None, None
        for batch in batches:
            rows = []
            for block, raw, queries in zip(batch.column("block").to_pylist(), batch.column("payload"), batch.column("queries").to_pylist()):
                if held != block:
                    ids, *codes = unpack(raw.as_py(), np.int64, *[_U] * words)
                    codes = np.stack(codes, axis=1)
                    new = _firsts(codes)
                    held, index, first = block, Index(codes[new]), np.append(new, len(codes))
                for q in queries:
                    rows += [(q["id"], i, d) for d, i in search(index, first, ids, q["id"], np.array(q["code"], np.int64).view(_U), k)]
            yield pa.record_batch([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], ["query_id", "neighbor_id", "distance"])

    return read


def nearest(vectors: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, neighbor_id, distance)``: the k nearest others, by Hamming distance and id, of the rows where ``queries`` holds."""
    scratch = Scratch(vectors.sparkSession, "mih")
    usable = vectors.where(F.col(id_col).isNotNull() & (F.size(vector_col) > 0))
    longest = usable.agg(F.max(F.size(vector_col))).first()[0] or 1
    words = -(-longest // WORD_BITS)
    one = usable.select(F.col(id_col).cast("long").alias("id"), code_of(F.col(vector_col), words).alias("code"), F.coalesce(queries, F.lit(False)).alias("asks"))
    coded = scratch.save(one.groupBy("id").agg(F.min("code").alias("code"), F.max("asks").alias("asks")), "codes")
    n_blocks = max(1, -(-coded.count() * words // BLOCK_CODES))
    asking = coded.where("asks").count()
    n_groups = max(1, -(-asking // BLOCK_QUERIES), min(asking // 64, -(-LEAST_PAIRS // n_blocks)))
    blocks = coded.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n_blocks))).groupBy("block").applyInArrow(_packer(k, words), "block long, payload binary")
    group = F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(n_groups))
    # Queries of a group are about BLOCK_QUERIES, so the list is bounded.
    asked = coded.where("asks").groupBy(group.alias("group")).agg(F.collect_list(F.struct("id", "code")).alias("queries"))
    every = asked.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))))
    pairs = every.join(scratch.save(blocks, "blocks"), "block").repartition(n_blocks * n_groups, "block", "group")
    found = pairs.select("block", "payload", "queries").mapInArrow(_searcher(k, words), "query_id long, neighbor_id long, distance long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "neighbor_id"))
    return found.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k).select("query_id", "rank", "neighbor_id", "distance")


#: The same rows by brute force in DuckDB's SQL.
ORACLE_SQL = """
WITH coded AS (SELECT DISTINCT vec_id, embedding FROM {embeddings} WHERE vec_id IS NOT NULL AND len(embedding) > 0),
pairs AS (
  SELECT q.vec_id AS query_id, e.vec_id AS neighbor_id,
         CAST(list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda x: CASE WHEN (x[1] > 0) <> (x[2] > 0) THEN 1 ELSE 0 END)) AS BIGINT) AS distance
  FROM coded q JOIN coded e ON q.vec_id <> e.vec_id
  WHERE q.vec_id % 50 = 0
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM pairs)
SELECT query_id, rank, neighbor_id, distance FROM ranked WHERE rank <= 10
"""
