"""Scores of a log-bilinear neural language model trained by noise-contrastive estimation.

Tokens are lower-cased words and one end for each document.  The model is
neural over classes: every frequent token is a class of its own, the rest fall
into classes by how they are spelt (which tells languages and punctuation
apart), and inside those a word has its smoothed share of the class.  The next
class is scored by a context vector, the sum of one embedding for each of the
two classes before, against an output embedding and bias.

Training sees every training token.  Documents are dealt by a hash of id and
text into parts of about ``PART_BYTES`` of text; a part, in the order of ids
and texts and with its number as seed, takes noise-contrastive steps in numpy
from one start, with batched matrix products, and the parts' parameters are
averaged by tokens, in integers.  So the model is a function of the rows, not
of files, partitions or the order of tasks.  Noise comes from the exact class
frequencies.  Scoring is normalised: one matrix product gives the normaliser of
every context.

Scale: word counts are exact; tasks send packed distinct words to hash
buckets.  To score, a part asks the buckets for the counts of its distinct
words and gets them back in the order it asked, so what moves is the texts,
once to train and once to score, and a few bytes for each distinct word of a
part.  What reaches the driver are totals, the ``top`` tokens and the
parameters; broadcast are the parameters and the normalisers, (top + REST + 2)
squared numbers of 4 bytes, 18 MB.

Edge cases: null and empty texts have one token, the end; very long ones are
scored whole, and a text longer than a part is one; a corpus without training
documents scores with empty counts; words that tie in count are ranked by
hash; repeated rows count as often as they occur; a null id counts as the
empty text in the split; an empty table gives an empty result; other columns,
also of clashing names, are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textkernel as K
from .packing import VECTOR_ROWS, by_value, pack, parts_for, prime, sum_vectors, unpack, vector_rows
from .scratch import Scratch

TOP = 2047
REST = 64
DIM = 32
NOISE = 32
BATCH = 2048
RATE = 0.15
FLUSH = 1 << 22
#: Parameters are averaged as integers of this fraction.
FRACTION = 1 << 16
#: Tokens that count one in the average.
GRAIN = 1 << 10
END_HASH = np.uint64(0x5EED0E2D0C5A11ED)
_U = np.uint64


def held_out(doc_id, modulus: int = 7, remainder: int = 2) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % modulus == remainder


def read_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of lower-cased words, their spelling classes, and each document's first word."""
    low = K.lower(data)
    starts, ends, first = K.words(data, offsets)
    if not len(starts):
        return np.zeros(0, _U), np.zeros(0, np.uint8), first
    final, before = low[ends - 1].astype(np.int64), low[np.maximum(ends - 2, starts)].astype(np.int64)
    return K.span_hash(K.prefix_hash(low), starts, ends), ((final * 37 + before * 11) % REST).astype(np.uint8), first


def merge(h: np.ndarray, n: np.ndarray, rest: np.ndarray):
    """Distinct hashes, ascending, with summed counts."""
    order = np.argsort(h, kind="stable")
    h, n, rest = h[order], n[order], rest[order]
    new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    return h[new], np.add.reduceat(n, new) if len(new) else n, rest[new]


# --- counts ------------------------------------------------------------------


def _count_reader(buckets: int, split):
    def flush(held):
        h, n, rest = merge(*(np.concatenate(x) for x in zip(*held)))
        keys, payloads = [], []
        for bucket, i in by_value((h % _U(buckets)).astype(np.int64)):
            keys.append(bucket)
            payloads.append(pack(h[i], n[i], rest[i]))
        return pa.record_batch([pa.array(keys, pa.int64()), pa.array(payloads, pa.binary())], ["bucket", "payload"])

    def read(batches):
        held, size = [], 0
        for batch in batches:
            batch = batch.filter(pa.array([not split(d) for d in batch.column(0).to_pylist()], pa.bool_()))
            for part, data, offsets in K.slices(batch):
                h, rest, _ = read_words(data, offsets)
                one = merge(np.append(h, END_HASH), np.append(np.ones(len(h), np.int64), part.num_rows), np.append(rest, np.uint8(0)))
                held.append(one)
                size += len(one[0])
                if size >= FLUSH:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return read


COUNTS = "bucket long, payload binary, n long, v long, ends long, rest_n array<long>, rest_v array<long>, top array<struct<n:long,h:long,rest:int>>"


def _count_merger(top: int):
    def read(table: pa.Table) -> pa.Table:
        h, n, rest = merge(*(np.concatenate(x) for x in zip(*[unpack(x.as_py(), _U, np.int64, np.uint8) for x in table["payload"]])))
        spelt = h != END_HASH
        best = np.flatnonzero(spelt)[np.lexsort((h[spelt], -n[spelt]))[:top]]
        rest_n = np.bincount(rest[spelt], weights=n[spelt].astype(float), minlength=REST).astype(np.int64)
        rest_v = np.bincount(rest[spelt], minlength=REST)
        tops = [{"n": int(n[i]), "h": int(h[i].astype(np.int64)), "rest": int(rest[i])} for i in best]
        return pa.table([table["bucket"].slice(0, 1), pa.array([pack(h, n)], pa.binary()), pa.array([int(n.sum())]), pa.array([len(h)]), pa.array([int(n[~spelt].sum())]), pa.array([rest_n.tolist()]), pa.array([rest_v.tolist()]), pa.array([tops], pa.list_(pa.struct([("n", pa.int64()), ("h", pa.int64()), ("rest", pa.int32())])))], names=["bucket", "payload", "n", "v", "ends", "rest_n", "rest_v", "top"])

    return read


@dataclass
class Vocabulary:
    """Corpus totals and the classes: 0 the end, then the frequent tokens, then the spelling classes; of bounded size."""

    tokens: int
    types: int
    ends: int
    hashes: np.ndarray  # of the frequent tokens, ascending
    class_n: np.ndarray
    rest_n: np.ndarray
    rest_v: np.ndarray

    @property
    def classes(self) -> int:
        return 1 + len(self.hashes) + REST

    def class_of(self, h: np.ndarray, rest: np.ndarray) -> np.ndarray:
        out = rest.astype(np.int64) + 1 + len(self.hashes)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            out = np.where(self.hashes[at] == h, at + 1, out)
        return out


def vocabulary(counts: DataFrame, top: int) -> Vocabulary:
    sums = [F.sum("n"), F.sum("v"), F.sum("ends"), *(F.sum(F.col(c)[i]) for c in ("rest_n", "rest_v") for i in range(REST))]
    n, v, ends, *rest = (int(x or 0) for x in counts.agg(*sums).first())
    best = counts.select(F.explode("top").alias("t")).select("t.n", "t.h", "t.rest").orderBy(F.desc("n"), "h").limit(top).collect()
    best.sort(key=lambda r: np.int64(r.h).astype(np.uint64))
    rest_n, rest_v = np.array(rest[:REST]), np.array(rest[REST:])
    for r in best:
        rest_n[r.rest] -= r.n
        rest_v[r.rest] -= 1
    frequent = np.array([r.n for r in best], np.int64)
    return Vocabulary(n, v, ends, np.array([r.h for r in best], np.int64).view(_U), np.concatenate([[ends], frequent, rest_n]), rest_n, rest_v)


# --- model -------------------------------------------------------------------


def sequence(classes: np.ndarray, first: np.ndarray, n_classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(target, class before, class before that, first token of each document) with an end for each document; contexts start with ``n_classes``."""
    docs = len(first) - 1
    out = np.zeros(len(classes) + docs, dtype=np.int64)
    owner = np.repeat(np.arange(docs), np.diff(first))
    out[np.arange(len(classes)) + owner] = classes
    begin = first[:-1] + np.arange(docs)
    one, two = np.roll(out, 1), np.roll(out, 2)
    one[begin] = n_classes
    two[begin] = n_classes
    second = begin[np.diff(first) > 0] + 1
    two[second] = n_classes
    return out, one, two, begin


def start(n_classes: int, frequency: np.ndarray, dim: int = DIM, seed: int = 7) -> np.ndarray:
    """One vector of all parameters: two context tables, the output table, and the biases at the unigram distribution."""
    rng = np.random.default_rng(seed)
    share = (frequency + 1) / (frequency + 1).sum()
    return np.concatenate([rng.normal(0, 0.1, 2 * (n_classes + 1) * dim), rng.normal(0, 0.1, n_classes * dim), np.log(share)]).astype(np.float32)


def tables(theta: np.ndarray, n_classes: int, dim: int = DIM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    a, b = (n_classes + 1) * dim, n_classes * dim
    return theta[:a].reshape(-1, dim), theta[a : 2 * a].reshape(-1, dim), theta[2 * a : 2 * a + b].reshape(-1, dim), theta[2 * a + b :]


def _scatter(into: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    order = np.argsort(rows, kind="stable")
    sorted_ = rows[order]
    new = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
    into[sorted_[new]] += np.add.reduceat(values[order], new, axis=0)


class Trainer:
    """Noise-contrastive steps with shared noise samples and Adagrad."""

    def __init__(self, theta: np.ndarray, noise: np.ndarray, dim: int = DIM, seed: int = 0):
        self.theta, self.n = theta.copy(), len(noise)
        self.views = tables(self.theta, self.n, dim)
        self.square = np.full_like(self.theta, 1e-2)
        self.log_noise = np.log(noise * NOISE).astype(np.float32)
        self.cumulative, self.rng, self.tokens = np.cumsum(noise), np.random.default_rng(seed), 0

    def step(self, target: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        first, second, out, bias = self.views
        grad = np.zeros_like(self.theta)
        g_first, g_second, g_out, g_bias = tables(grad, self.n, first.shape[1])
        drawn = np.minimum(np.searchsorted(self.cumulative, self.rng.random(NOISE)), self.n - 1)
        q = first[one] + second[two]
        hit = out[target]
        pull = 1 / (1 + np.exp((q * hit).sum(axis=1) + bias[target] - self.log_noise[target]))
        push = -1 / (1 + np.exp(-(q @ out[drawn].T + bias[drawn] - self.log_noise[drawn])))
        dq = pull[:, None] * hit + push @ out[drawn]
        _scatter(g_first, one, dq)
        _scatter(g_second, two, dq)
        _scatter(g_out, np.concatenate([target, drawn]), np.concatenate([pull[:, None] * q, push.T @ q]))
        g_bias += np.bincount(target, pull, self.n) + np.bincount(drawn, push.sum(axis=0), self.n)
        grad /= len(target)
        self.square += grad * grad * len(target)
        self.theta += RATE * grad * np.sqrt(len(target)) / np.sqrt(self.square)
        self.tokens += len(target)


def _texts(table: pa.Table):
    """The rows of a part, in the order of ids and texts."""
    for batch in table.select(["doc_id", "text"]).sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks().to_batches():
        yield from K.slices(batch)


def _trainer(theta: np.ndarray, words: Vocabulary, split):
    noise = (words.class_n + 1) / (words.class_n + 1).sum()

    def train(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        trainer = Trainer(theta, noise, seed=part)
        for batch, data, offsets in _texts(table.filter(pa.array([not split(d) for d in table["doc_id"].to_pylist()], pa.bool_()))):
            h, rest, first = read_words(data, offsets)
            target, one, two, _ = sequence(words.class_of(h, rest), first, words.classes)
            for k in trainer.rng.permutation(-(-len(target) // BATCH)):
                i = slice(k * BATCH, (k + 1) * BATCH)
                trainer.step(target[i], one[i], two[i])
        weight = -(-trainer.tokens // GRAIN)
        held = np.append(np.round(trainer.theta.astype(np.float64) * FRACTION).astype(np.int64) * weight, weight)
        return pa.Table.from_batches([vector_rows(held, part & 255)])

    return train


@dataclass
class Model:
    """What scoring needs; of bounded size."""

    words: Vocabulary
    theta: np.ndarray


def log_probabilities(theta: np.ndarray, n_classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(by class before, by class before that, normaliser of every context), natural logarithms, biases in the first."""
    first, second, out, bias = (x.astype(np.float64) for x in tables(theta, n_classes))
    a, b = first @ out.T + bias, second @ out.T
    top_a, top_b = a.max(axis=1, keepdims=True), b.max(axis=1, keepdims=True)
    return a, b, np.log(np.exp(a - top_a) @ np.exp(b - top_b).T) + top_a + top_b.T



# --- scores ------------------------------------------------------------------


def _distinct(table: pa.Table) -> np.ndarray:
    found = [np.unique(read_words(data, offsets)[0]) for _, data, offsets in _texts(table)]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, _U)


def _asker(buckets: int):
    def ask(table: pa.Table) -> pa.Table:
        h = _distinct(table)
        keys, payloads = [], []
        for bucket, i in by_value((h % _U(buckets)).astype(np.int64)):
            keys.append(bucket)
            payloads.append(pack(h[i]))
        part = table["part"][0].as_py()
        return pa.table([pa.array(keys, pa.int64()), pa.array([part] * len(keys), pa.int64()), pa.array(payloads, pa.binary())], names=["bucket", "part", "payload"])

    return ask


def _answer(asked: pa.Table, counts: pa.Table) -> pa.Table:
    known = [unpack(x.as_py(), _U, np.int64) for x in counts["payload"]]
    h, n = known[0] if known else (np.zeros(0, _U), np.zeros(0, np.int64))
    payloads = []
    for raw in asked["payload"]:
        (wanted,) = unpack(raw.as_py(), _U)
        at = np.minimum(np.searchsorted(h, wanted), max(len(h) - 1, 0))
        payloads.append(pack(np.where(h[at] == wanted, n[at], 0) if len(h) else np.zeros(len(wanted), np.int64)))
    return pa.table([asked["part"], asked["bucket"], pa.array(payloads, pa.binary())], names=["part", "bucket", "payload"])


OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scorer(model, buckets: int, split):
    """``model``: a broadcast of the words, both tables of logarithms' factors and the normalisers."""

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        words, theta, normal = model.value
        first_table, second_table, out_table, bias = tables(theta, words.classes)
        h = _distinct(left)
        c = np.zeros(len(h), np.int64)
        answers = {b: unpack(p.as_py(), np.int64)[0] for b, p in zip(right["bucket"].to_pylist(), right["payload"])}
        for bucket, i in by_value((h % _U(buckets)).astype(np.int64)):
            c[i] = answers[bucket]
        whole = np.log10(words.tokens + words.types + 1)
        share = np.log10(np.concatenate([np.ones(words.classes - REST), words.rest_n + words.rest_v + 1]))
        frequent = words.classes - REST
        out = []
        for part, data, offsets in _texts(left):
            own, rest, first = read_words(data, offsets)
            target, one, two, begin = sequence(words.class_of(own, rest), first, words.classes)
            count = np.full(len(target), words.ends, np.int64)
            spelt = np.ones(len(target), dtype=bool)
            spelt[np.append(begin[1:], len(target)) - 1] = False
            count[spelt] = c[np.searchsorted(h, own)]
            log_count = np.log10(count + 1)
            logit = np.einsum("ij,ij->i", first_table[one] + second_table[two], out_table[target]) + bias[target]
            probability = (logit.astype(np.float64) - normal[one, two]) / np.log(10) + np.where(target >= frequent, log_count - share[target], 0)
            ids = part.column(0).to_pylist()
            out.append((ids, [split(d) for d in ids], np.diff(np.append(begin, len(target))), np.add.reduceat((count > 0).astype(np.int64), begin), np.add.reduceat(log_count - whole, begin), np.add.reduceat(probability, begin)))
        ids, held, n, known, base, scores = ([y for x in column for y in x] for column in zip(*out)) if out else ([],) * 6
        return pa.table([pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array([words.tokens] * len(ids), pa.int64()), pa.array(base, pa.float64()), pa.array(scores, pa.float64())], names=[x.split()[0] for x in OUT.split(", ")])

    return score


def fit(parted: DataFrame, counts: DataFrame, split, top: int, passes: int) -> Model:
    """``parted(part, doc_id, text)`` and its word counts -> the model."""
    words = vocabulary(counts, top)
    theta = start(words.classes, words.class_n)
    for _ in range(passes):
        summed = sum_vectors(parted.groupBy("part").applyInArrow(_trainer(theta, words, split), VECTOR_ROWS))
        if len(summed) and summed[-1]:
            theta = (summed[:-1] / (float(summed[-1]) * FRACTION)).astype(np.float32)
    return Model(words, theta)


def prepare(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", split=held_out, top: int = TOP, passes: int = 1):
    """(documents dealt into parts, word counts by bucket, number of buckets, model)."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    parts = parts_for(source)
    # A bucket's words, distinct in the whole corpus, are fewer than a part's text.
    buckets = prime(max(11, parts // 8))
    counts = source.mapInArrow(_count_reader(buckets, split), "bucket long, payload binary").groupBy("bucket").applyInArrow(_count_merger(top), COUNTS)
    counts = scratch.save(counts, "counts")
    parted = source.withColumn("part", F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).cast("long"))
    return parted, counts, buckets, fit(parted, counts, split, top, passes)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", split=held_out, top: int = TOP, passes: int = 1) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for every row.

    The model and the counts learn from the rows for which ``split`` is false.
    """
    spark = docs.sparkSession
    parted, counts, buckets, model = prepare(docs, Scratch(spark, "nce"), id_col, text_col, split, top, passes)
    normal = log_probabilities(model.theta, model.words.classes)[2].astype(np.float32)
    known = spark.sparkContext.broadcast((model.words, model.theta, normal))
    dealt = parted.groupBy("part")
    asked = dealt.applyInArrow(_asker(buckets), "bucket long, part long, payload binary")
    answers = asked.groupBy("bucket").cogroup(counts.select("bucket", "payload").groupBy("bucket")).applyInArrow(_answer, "part long, bucket long, payload binary")
    return dealt.cogroup(answers.groupBy("part")).applyInArrow(_scorer(known, buckets, split), OUT)
