"""Quality by importance resampling: a ratio of hashed n-gram models, sampled by Gumbel top-k.

Two generative models draw, for each hashed unigram and bigram, how often a
document has it: one of target documents (labelled good), one of all.  Under
Poisson rates the log weight of a document is the sum of the log ratios of
its n-grams' rates, each as often as it occurs, less a constant of all
documents.  Rates are estimated by documents that have the n-gram, so that a
burst in one counts once.

The target model is smoothed towards the raw one by a spike and slab: an
n-gram's ratio is 1 but with probability ``TELLING``, and then Gamma-distributed
with mean 1.  The log ratio is the posterior's, ``P(slab) * log((count + SHAPE)
/ (expected + SHAPE))``: near 0 for what chance explains, full for what it
doesn't, without a threshold, at every size of the tables.  An n-gram is hashed
into two tables and the ratio nearer to 0 counts, so a collision with a
telling n-gram in one of them does no harm.

Documents below the floor are rejected.  The floor is calibrated on one in
``CALIBRATION`` target documents, which the models do not see: at most
``REJECTED_GOOD`` of them lie below it, and where they are too few to tell, it
lies as far below the least as that is below the median.  Of the others a sample without
replacement, in proportion to the weights, is the top k of log weight plus
Gumbel noise.  ``accepted``, the filter, takes as many documents as lie above
the floor, by log weight plus Gumbel noise whose scale is ``NOISE`` of the way
from the floor to the median.

Tokens are runs of letters and digits, lower-cased, and runs of punctuation.

Bounds: the models are fitted and calibrated on at most ``max_target`` labelled
rows (the first by a hash of the id); the raw model counts every document.  A
task sends its counts by bucket for either model; no document moves.

Edge cases: null and empty texts have no n-grams, weight 0, and are accepted,
as the floor is never above 0; very long ones are counted whole; without
labels every weight is 0 and nothing is rejected; repeated rows get equal
weights and keys, and rows that tie with the k-th are selected with it; null
ids are weighted like others; an empty table gives an empty result; labels
without a document and other columns, also of clashing names, are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import textkernel as K
from .packing import VECTOR_ROWS, sum_vectors, vector_rows
from .scratch import Scratch, bound_batches

BITS = 20
BUCKETS = 1 << BITS
MAX_TARGET = 50_000
TELLING, SHAPE = 1e-3, 0.5
CALIBRATION = 5
REJECTED_GOOD = 0.005
NOISE = 0.02
#: A histogram's bins when the k-th key is searched for, and rows that may then be sorted at once.
BINS, FEW = 4096, 10_000
_U = np.uint64
_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MARK = ~_WORD & ~_SPACE


def ngrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each document's distinct n-grams as buckets of the two tables, how often each occurs, and each document's first index."""
    docs = len(offsets) - 1
    word_starts, word_ends = K.runs(_WORD[data], offsets)
    mark_starts, mark_ends = K.runs(_MARK[data], offsets)
    starts, ends = np.concatenate([word_starts, mark_starts]), np.concatenate([word_ends, mark_ends])
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], ends[order]
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(docs + 1, np.int64)
    h = K.span_hash(K.prefix_hash(K.lower(data)), starts, ends)
    doc = np.searchsorted(offsets, starts, side="right") - 1
    pair = K.mix(h[:-1] * _U(0x9E3779B97F4A7C15) + h[1:])
    inside = doc[:-1] == doc[1:]
    hashes = np.concatenate([h, pair[inside]])
    owner = np.concatenate([doc, doc[:-1][inside]]).astype(_U)
    # 44 bits of an n-gram behind the document's number in its slice.
    keys = np.sort((owner << _U(44)) | (hashes >> _U(20)))
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    times = np.diff(np.append(new, len(keys)))
    keys = keys[new]
    first = np.searchsorted(keys, np.arange(docs + 1, dtype=_U) << _U(44))
    return (keys & _U(BUCKETS - 1)).astype(np.int64), ((keys >> _U(BITS)) & _U(BUCKETS - 1)).astype(np.int64), times, first


def _counter(batches):
    """Documents by bucket: both tables of all and of the target, and how many documents there are."""
    total, size = np.zeros((4, BUCKETS), dtype=np.int32), np.zeros(2, dtype=np.int32)
    for batch in batches:
        for part, data, offsets in K.slices(batch):
            target = np.array(part.column(part.schema.get_field_index("target")).to_pylist(), dtype=bool)
            one, two, _, first = ngrams(data, offsets)
            wanted = np.repeat(target, np.diff(first))
            for row, buckets in enumerate((one, two, one[wanted], two[wanted])):
                total[row] += np.bincount(buckets, minlength=BUCKETS).astype(np.int32)
            size += [len(target), int(target.sum())]
    if size[0]:
        yield vector_rows(np.concatenate([total.reshape(-1), size]), int(total[0].sum()) & 255, 1 << 16, np.int64)


def ratios(raw: np.ndarray, target: np.ndarray, n_raw: int, n_target: int, telling: float = TELLING, shape: float = SHAPE) -> np.ndarray:
    """Log ratio of each bucket's rates under the spike and slab."""
    out = np.zeros(len(raw), np.float32)
    seen = np.flatnonzero(raw > 0) if n_raw and n_target else []
    if not len(seen):
        return out
    count, expected = target[seen].astype(np.float64), raw[seen] * (n_target / n_raw)
    values, place = np.unique(count, return_inverse=True)
    rising = np.array([math.lgamma(v + shape) - math.lgamma(shape) for v in values])[place]
    # Log of the count's likelihood under the slab (negative binomial) over that under the spike (Poisson).
    slab = rising + shape * np.log(shape / (shape + expected)) - count * np.log(shape + expected) + expected
    odds = np.log(telling / (1 - telling)) + slab
    out[seen] = np.log((count + shape) / (expected + shape)) / (1 + np.exp(-np.clip(odds, -60, 60)))
    return out


def _weights(table: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of distinct n-grams and log weight of each document."""
    one, two, times, first = ngrams(data, offsets)
    a, b = table[0][one], table[1][two]
    running = np.concatenate([[0.0], np.cumsum(np.where(np.abs(a) < np.abs(b), a, b).astype(np.float64) * times)])
    return np.diff(first), np.round(running[first[1:]] - running[first[:-1]], 6)


def _weigher(table: np.ndarray):
    def read(batches):
        for batch in batches:
            for part, data, offsets in K.slices(batch):
                n, weight = _weights(table, data, offsets)
                yield pa.record_batch([part.column(0), pa.array(n), pa.array(weight)], ["doc_id", "n_ngrams", "log_weight"])

    return read


@dataclass
class Model:
    table: np.ndarray
    floor: float
    median: float


def floor_of(weights: list[float], rejected: float = REJECTED_GOOD) -> tuple[float, float]:
    """The floor, and the median, for weights of good documents that the models have not seen."""
    if not weights:
        return float("-inf"), 0.0
    ordered = sorted(weights)
    k, median = int(rejected * (len(ordered) + 1)), ordered[len(ordered) // 2]
    # Rounded away from what a document may weigh; never above 0, where nothing speaks for or against a document.
    return min(ordered[k - 1] if k else 2 * ordered[0] - median, 0.0) - 1e-6, median


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_target: int = MAX_TARGET) -> Model:
    """The two tables of log ratios, and the floor.  ``labels``: ``doc_id`` of target documents."""
    bound_batches(docs.sparkSession)
    chosen = labels.select(F.col("doc_id").cast("long").alias("_target")).where("_target is not null").distinct().orderBy(F.xxhash64("_target"), "_target").limit(max_target)
    apart = F.pmod(F.xxhash64(F.lit(2), "_target"), F.lit(CALIBRATION)) == 0
    # At most max_target ids of 8 bytes.
    source = docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).cast("long").alias("doc_id"))
    flagged = source.join(F.broadcast(chosen.where(~apart)), F.col("doc_id") == F.col("_target"), "left")
    total = sum_vectors(flagged.select("text", F.col("_target").isNotNull().alias("target")).mapInArrow(_counter, VECTOR_ROWS))
    if not len(total):
        return Model(np.zeros((2, BUCKETS), np.float32), float("-inf"), 0.0)
    counts, (n_raw, n_target) = total[:-2].reshape(4, BUCKETS), total[-2:]
    table = np.stack([ratios(counts[i], counts[2 + i], int(n_raw), int(n_target)) for i in range(2)])
    held = source.join(F.broadcast(chosen.where(apart)), F.col("doc_id") == F.col("_target")).select("doc_id", "text")
    # One weight for each of the at most max_target ids.
    weights = held.mapInArrow(_weigher(table), "doc_id long, n_ngrams long, log_weight double").groupBy("doc_id").agg(F.min("log_weight").alias("w")).collect()
    return Model(table, *floor_of([r.w for r in weights] if n_target else []))


def weigh(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_ngrams, log_weight, accepted)`` for every row."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = source.mapInArrow(_weigher(model.table), "doc_id long, n_ngrams long, log_weight double")
    return found.withColumn("accepted", F.col("log_weight") >= F.lit(model.floor))


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_target: int = MAX_TARGET, seed: int = 1) -> DataFrame:
    """The rows, with all their columns, that a Gumbel top-k takes, k being how many lie above the floor."""
    scratch = Scratch(docs.sparkSession, "quality")
    model = fit(docs, labels, id_col, text_col, max_target)
    weight = next(name for name in (f"_weight{i}" for i in range(len(docs.columns) + 1)) if name not in {c.lower() for c in docs.columns})

    def add(batches):
        for batch in batches:
            for part, data, offsets in K.slices(batch, text_col):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(_weights(model.table, data, offsets)[1])], names=[*part.schema.names, weight])

    weighed = docs.mapInArrow(add, StructType([*docs.schema.fields, StructField(weight, DoubleType())]))
    scale = NOISE * (model.median - model.floor) if model.floor > float("-inf") else 0.0
    noise = scale * gumbel(F.struct(F.col(id_col), F.xxhash64(F.col(text_col))), seed)
    held = scratch.save(weighed, "weighed")
    k = held.where(F.col(weight) >= model.floor).count()
    keyed = held.select(*(F.col(f"`{c}`") for c in docs.columns), (F.col(weight) + noise).alias(weight))
    least = kth_largest(keyed.select(F.col(weight).alias("key")), k)
    return keyed.where(F.col(weight) >= F.lit(least if least is not None else float("inf"))).drop(weight)


def gumbel(id_column: Column, seed: int) -> Column:
    """A Gumbel variate fixed by id and seed."""
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), id_column), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(uniform))


def kth_largest(keys: DataFrame, k: int) -> float | None:
    """The k-th largest of ``key``, by histograms of falling width; None if there are fewer."""
    low, high, n = keys.agg(F.min("key"), F.max("key"), F.count("key")).first()
    if n < k or k <= 0:
        return None
    above = 0
    while n > FEW and high > low:
        width = (high - low) / BINS
        place = F.least(F.floor((F.col("key") - low) / width), F.lit(BINS - 1))
        bins = keys.where(F.col("key").between(low, high)).groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).orderBy(F.desc("bin")).collect()
        for b in bins:
            if above + b.n >= k:
                break
            above += b.n
        if b.n == n:
            break
        low, high, n = b.low, b.high, b.n
    rows = keys.where(F.col("key").between(low, high)).select("key").orderBy(F.desc("key")).limit(k - above).agg(F.min("key")).first()
    return rows[0]


def resample(docs: DataFrame, labels: DataFrame, share: float = 0.5, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", max_target: int = MAX_TARGET) -> DataFrame:
    """``weigh`` with ``key`` and ``selected``: the top ``share`` of the accepted rows by log weight plus Gumbel noise."""
    scratch = Scratch(docs.sparkSession, "resampling")
    weighed = weigh(docs, fit(docs, labels, id_col, text_col, max_target), id_col, text_col)
    keyed = scratch.save(weighed.withColumn("key", F.col("log_weight") + gumbel(F.col("doc_id"), seed)), "keyed")
    taken = keyed.where("accepted").select("key")
    least = kth_largest(taken, int(taken.count() * share))
    return keyed.withColumn("selected", F.col("accepted") & (F.col("key") >= F.lit(least if least is not None else float("inf"))))
