"""Substring dedup over sliding spans of sentences.

Every run of two and every run of three consecutive sentences, from each
sentence on, is hashed; equal runs meet by hash, and sentences covered by any
run that is not the first of its kind (by document id, then place) are
removed.  A repeated passage of two or more whole sentences is so covered from
end to end, wherever it stands, while a common sentence between others is left
alone.  Runs of fewer than ``min_words`` words ("Yes.  No.") are not passages.

A sentence ends at a word that ends in ``.``, ``!`` or ``?``, or at a line
break; runs compare words without case and spacing.

Scale: what moves is one packed record for each run and the texts once; a
task merges equal runs before they move, so a passage that every document has
is one record for each task.  Records are dealt into as many buckets, and
texts into as many parts, as follows from the bytes.

Edge cases: null, empty and word-free texts have no sentences; very long ones
are one row and cut whole; where documents tie (rows that share an id) the
first by place, then by check sum, is kept; repeated rows (equal id and text)
count as one document and get equal results; an empty table gives an empty
result; rows without id are left out; other columns, also of clashing names,
are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textkernel as K
from .packing import by_value, delta, pack, parts_for, rows as packed_rows, unpack
from .scratch import bound_batches

#: Sentences of a run.
RUNS = (2, 3)
MIN_WORDS = 10
FLUSH = 1 << 21
SPANS, RANGES = 0, 1
_U = np.uint64


def sentences(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Sentences as word ranges: first, last (exclusive), begin (byte), doc; hashes and count of words before by word."""
    starts, ends, first_word = K.words(data, offsets)
    n = len(starts)
    if not n:
        none = np.zeros(0, np.int64)
        return {"first": none, "last": none, "begin": none, "doc": none, "running": np.zeros(1, _U)}
    hashes = K.span_hash(K.prefix_hash(K.lower(data)), starts, ends)
    final = data[ends - 1]
    stop = (final == 46) | (final == 33) | (final == 63)
    newlines = np.concatenate([[0], np.cumsum(data == 10)])
    stop[:-1] |= newlines[starts[1:]] > newlines[ends[:-1]]
    stop[first_word[1:][first_word[1:] > 0] - 1] = True
    last = np.flatnonzero(stop) + 1
    first = np.concatenate([[0], last[:-1]])
    up, _ = K.powers(n + 1)
    running = np.zeros(n + 1, dtype=_U)
    np.cumsum(hashes * up[:n], out=running[1:])
    return {"first": first, "last": last, "begin": starts[first], "doc": np.searchsorted(first_word, first, side="right") - 1, "running": running}


def spans(s: dict[str, np.ndarray], min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(from sentence, to sentence inclusive) of every run, and their hashes."""
    first, last, doc = s["first"], s["last"], s["doc"]
    a = np.concatenate([np.arange(max(0, len(first) - n + 1)) for n in RUNS])
    b = a + np.repeat(RUNS, [max(0, len(first) - n + 1) for n in RUNS]) - 1
    inside = doc[a] == doc[b]
    a, b = a[inside], b[inside]
    words = last[b] - first[a]
    a, b, words = (x[words >= min_words] for x in (a, b, words))
    _, down = K.powers(len(s["running"]))
    h = K.mix((s["running"][last[b]] - s["running"][first[a]]) * down[first[a]] + words.astype(_U) * _U(0xD6E8FEB86659FD93))
    return a, b, h


def _range_rows(doc, a, b, check, parts):
    keys, payloads = [], []
    for part, i in by_value(np.mod(doc, parts)):
        i = i[np.argsort(doc[i], kind="stable")]
        keys.append(part)
        payloads.append(pack(delta(doc[i]), a[i].astype(np.uint32), b[i].astype(np.uint32), check[i].astype(np.uint32)))
    return keys, payloads


def _late(h, doc, a, b, check):
    """Order of the spans by hash, document and place, and which of them are not the first of their kind (an equal row's count as the same)."""
    order = np.lexsort((check, b, a, doc, h))
    new = np.concatenate([[True], h[order][1:] != h[order][:-1]])
    first = order[new][np.cumsum(new) - 1]
    return order, (doc[order] != doc[first]) | (a[order] != a[first]) | (b[order] != b[first]) | (check[order] != check[first])


def _span_reader(buckets: int, parts: int, min_words: int):
    def flush(held):
        doc, a, b, h, check = (np.concatenate(x) for x in zip(*held))
        order, late = _late(h, doc, a, b, check)
        i = order[late]
        keys, payloads = _range_rows(doc[i], a[i], b[i], check[i], parts)
        yield packed_rows([RANGES] * len(keys), keys, payloads)
        i = order[~late]
        keys, payloads = [], []
        for bucket, j in by_value((h[i] % _U(buckets)).astype(np.int64)):
            j = i[j]
            j = j[np.lexsort((a[j], doc[j]))]
            keys.append(bucket)
            payloads.append(pack(delta(doc[j]), a[j].astype(np.uint32), (b[j] - a[j]).astype(np.uint32), check[j].astype(np.uint32), h[j]))
        yield packed_rows([SPANS] * len(keys), keys, payloads)

    def read(batches):
        held, n = [], 0
        for batch in batches:
            for part, data, offsets in K.slices(batch):
                s = sentences(data, offsets)
                a, b, h = spans(s, min_words)
                doc = s["doc"]
                first = np.searchsorted(doc, np.arange(part.num_rows))
                crc = np.array([zlib.crc32(data[offsets[i] : offsets[i + 1]]) for i in range(part.num_rows)], np.int64)
                d = doc[a] if len(a) else a
                held.append((np.array(part.column(0).to_pylist(), np.int64)[d], a - first[d], b - first[d], h, crc[d]))
                n += len(a)
                if n >= FLUSH:
                    yield from flush(held)
                    held, n = [], 0
        if n:
            yield from flush(held)

    return read


_SPAN_TYPES = (np.int64, np.uint32, np.uint32, np.uint32, _U)
_RANGE_TYPES = (np.int64, np.uint32, np.uint32, np.uint32)


def _repeat_reader(parts: int):
    def read(table: pa.Table) -> pa.Table:
        keys, payloads, held = [], [], []
        for kind, key, raw in zip(table["kind"].to_pylist(), table["key"].to_pylist(), table["payload"]):
            if kind == RANGES:
                keys.append(key)
                payloads.append(raw.as_py())
            else:
                doc, a, size, check, h = unpack(raw.as_py(), *_SPAN_TYPES)
                held.append((np.cumsum(doc), a.astype(np.int64), a.astype(np.int64) + size, check, h))
        if held:
            doc, a, b, check, h = (np.concatenate(x) for x in zip(*held))
            order, late = _late(h, doc, a, b, check)
            i = order[late]
            more, packed = _range_rows(doc[i], a[i], b[i], check[i], parts)
            keys, payloads = keys + more, payloads + packed
        return pa.table([pa.array(keys, pa.int64()), pa.array(payloads, pa.binary())], names=["part", "payload"])

    return read


OUT = "doc_id long, n_sentences long, n_removed long, n_removed_bytes long, kept string"


def _finish(left: pa.Table, right: pa.Table) -> pa.Table:
    found = [unpack(x.as_py(), *_RANGE_TYPES) for x in right["payload"]]
    none = np.zeros(0, np.int64)
    doc, a, b, check = (np.concatenate(x).astype(np.int64) for x in zip(*[(np.cumsum(d), *r) for d, *r in found])) if found else (none,) * 4
    order = np.argsort(doc, kind="stable")
    doc, a, b, check = doc[order], a[order], b[order], check[order]
    out = []
    for batch in left.to_batches():
        for part, data, offsets in K.slices(batch.select(["doc_id", "text"])):
            s = sentences(data, offsets)
            bounds = np.searchsorted(s["doc"], np.arange(part.num_rows + 1))
            for i, d in enumerate(part.column(0).to_pylist()):
                raw, n = data[offsets[i] : offsets[i + 1]], int(bounds[i + 1] - bounds[i])
                own = slice(np.searchsorted(doc, d), np.searchsorted(doc, d, side="right"))
                gone = np.zeros(n + 1, dtype=np.int64)
                if own.start < own.stop:
                    mine = check[own] == zlib.crc32(raw)
                    np.add.at(gone, a[own][mine], 1)
                    np.add.at(gone, b[own][mine] + 1, -1)
                gone = np.cumsum(gone[:-1]) > 0
                keep = np.ones(len(raw), dtype=bool)
                begin = np.append(s["begin"][bounds[i] : bounds[i + 1]] - offsets[i], len(raw))
                for k in np.flatnonzero(gone):
                    keep[begin[k] : begin[k + 1]] = False
                out.append((d, n, int(gone.sum()), int(len(raw) - keep.sum()), raw[keep].tobytes().decode("utf-8", "replace")))
    return pa.table([pa.array([r[i] for r in out], pa.string() if i == 4 else pa.int64()) for i in range(5)], names=["doc_id", "n_sentences", "n_removed", "n_removed_bytes", "kept"])


def remove_repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``(doc_id, n_sentences, n_removed, n_removed_bytes, kept)`` for every row with an id; ``kept`` is the text that stays."""
    bound_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    buckets = parts_for(source)
    found = source.mapInArrow(_span_reader(buckets, buckets, min_words), "kind int, key long, payload binary")
    bucket = F.when(F.col("kind") == SPANS, F.col("key")).otherwise(F.pmod(F.xxhash64("payload"), F.lit(buckets)))
    ranges = found.groupBy(bucket.alias("bucket")).applyInArrow(_repeat_reader(buckets), "part long, payload binary")
    parted = source.withColumn("part", F.pmod("doc_id", F.lit(buckets)).cast("long")).groupBy("part")
    return parted.cogroup(ranges.groupBy("part")).applyInArrow(_finish, OUT)
