"""Exact substring dedup over bytes with a hash-compared suffix sort.

Removed is every byte covered by a ``length``-byte string that also starts in
a document with a smaller id.  Sorting every suffix of a corpus means moving
every suffix, so the sort is sparse:

1. *Anchors.*  In every string of ``length`` bytes the smallest hashed k-gram
   is its anchor (winnowing), so equal strings have equal anchors at equal
   offsets.  Consecutive strings with one anchor form a span.
2. *Repeats.*  Packed (anchor, span hash, document, position) blocks meet by
   anchor and are sorted by span hash.  A span that a smaller document has too
   is flagged with the place of its first occurrence; where the spans of one
   anchor differ, the first of each goes on to the suffix sort.
3. *Suffix sort.*  The suffixes of those spans are mergesorted; two suffixes
   are compared by a binary search over polynomial prefix hashes for their
   common extension.  Runs that agree on ``length`` bytes are verified byte by
   byte, and all but the smallest document's strings are removed.
4. *Verification.*  Flagged spans that follow each other along one diagonal
   are one stretch; its bytes go to the part of the first document and are
   compared with it there.  What differs stays.  So nothing is removed on the
   word of a hash.
5. *Cutting.*  Removed ranges meet their documents again.

Scale: what moves is about a seventh of the text as anchor blocks, the text
once, the repeated text once, and the spans that need sorting.  Parts have a
bounded share of the bytes, however many partitions the session or the files
have.  Within a task equal spans are merged before they move, and an anchor
with very many different spans is dealt out by single strings, so no group is
bounded by one task.  Texts longer than a slice are processed in overlapping
pieces.

Edge cases: null texts are empty; texts shorter than ``length`` stay whole;
rows with one id do not remove each other's text (repeated rows get equal
results); an empty table gives an empty result; rows without id are left out;
columns other than the id and the text are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textkernel as K
from .packing import by_value as _by, delta as _delta, expand as _expand, pack, parts_for, rows as _rows, squeeze as _squeeze, unpack
from .scratch import bound_batches

LENGTH = 50
GRAM = 20
FLUSH = 1 << 21
#: Anchors with more different spans than this are dealt out string by string.
HOT_SPANS = 4096
FULL, SORT, SORT_HOT = 1, 2, 3
_INDEX_BITS = np.uint64(22)
_INDEX_MASK = np.uint64((1 << 22) - 1)
_U = np.uint64


def pieces(ids: list[int], data: np.ndarray, offsets: np.ndarray, length: int):
    """(ids, bases, data, offsets): documents, long ones as pieces that overlap by ``length`` - 1 bytes."""
    if len(data) <= 2 * K.SLICE_BYTES:
        yield ids, np.zeros(len(ids), np.int64), data, offsets
        return
    for i, doc in enumerate(ids):
        whole = data[offsets[i] : offsets[i + 1]]
        for base in range(0, max(1, len(whole) - length + 1), K.SLICE_BYTES):
            part = whole[base : base + K.SLICE_BYTES + length - 1]
            yield [doc], np.array([base]), part, np.array([0, len(part)])


def spans(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """Spans of strings with one anchor: doc (index), at (anchor), lo and hi (first and last start), a and s (hashes)."""
    n, width = len(data), length - gram + 1
    if n < length:
        return {k: np.zeros(0, _U if k in "as" else np.int64) for k in ("doc", "at", "lo", "hi", "a", "s")}
    prefix = K.prefix_hash(data)
    _, down = K.powers(n + 1)
    grams = K.mix((prefix[gram:] - prefix[:-gram]) * down[: n + 1 - gram])
    keyed = (grams & ~_INDEX_MASK) | np.arange(len(grams), dtype=_U)
    least, have = keyed, 1
    while have * 2 <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < width:
        least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
    chosen = (least & _INDEX_MASK).astype(np.int64)  # of each string by its start
    fits = np.ones(len(chosen), dtype=bool)
    for end in offsets[1:-1]:  # strings that would cross into the next document
        fits[max(0, end - length + 1) : end] = False
    starts = np.flatnonzero(fits)
    if not len(starts):
        return spans(data[:0], offsets[:1])
    chosen = chosen[starts]
    new = np.flatnonzero(np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    last = np.concatenate([new[1:] - 1, [len(starts) - 1]])
    lo, hi, at = starts[new], starts[last], chosen[new]
    s = K.mix(K.span_hash(prefix, lo, hi + length) + (at - lo).astype(_U) * _U(0x9E3779B97F4A7C15))
    return {"doc": np.searchsorted(offsets, lo, side="right") - 1, "at": at, "lo": lo, "hi": hi, "a": grams[at], "s": s}


ANCHORS, FLAGS = 0, 1
#: Document, position, check, flag; of a whole span also the first document that has it and how far back it lies there.
_FLAG_TYPES = (np.int64, np.uint32, np.uint16, np.uint8, np.int64, np.int64)


def _flag_rows(doc, at, check, flag, first, back, parts: int):
    keys, payloads = [], []
    for part, i in _by(np.mod(doc, parts)):
        i = i[np.lexsort((at[i], doc[i]))]
        keys.append(part)
        payloads.append(pack(_delta(doc[i]), _delta(at[i].astype(np.uint32)), check[i], flag[i], first[i], back[i]))
    return keys, payloads


def _read_flags(raw: bytes):
    doc, at, check, flag, first, back = unpack(raw, *_FLAG_TYPES)
    return np.cumsum(doc), np.cumsum(at, dtype=np.uint32).astype(np.int64), check, flag, first, back


# --- 1: anchors --------------------------------------------------------------


def _anchor_reader(buckets: int, parts: int, length: int, gram: int):
    def flush(held):
        doc, at, a, s = (np.concatenate(x) for x in zip(*held))
        pair = K.mix(a ^ (s * _U(0x9E3779B97F4A7C15)))
        ordered = np.sort(pair)
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        keep = np.ones(len(doc), dtype=bool)
        if len(twice):  # of equal spans only the smallest document's need to move
            i = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, pair), len(twice) - 1)] == pair)
            i = i[np.lexsort((doc[i], pair[i]))]
            new = np.concatenate([[True], pair[i][1:] != pair[i][:-1]])
            least = i[new][np.cumsum(new) - 1]
            later = doc[i] > doc[least]
            late, least = i[later], least[later]
            keep[late] = False
            keys, payloads = _flag_rows(doc[late], at[late], (s[late] >> _U(16)).astype(np.uint16), np.full(len(late), FULL, np.uint8), doc[least], at[late] - at[least], parts)
            yield _rows([FLAGS] * len(keys), keys, payloads)
        doc, at, a, s = doc[keep], at[keep], a[keep], s[keep]
        keys, payloads = [], []
        for bucket, i in _by((a % _U(buckets)).astype(np.int64)):
            i = i[np.lexsort((at[i], doc[i]))]
            planes = np.stack([a[i] >> _U(24), s[i] >> _U(16)], axis=1).view(np.uint8).reshape(len(i), 16)
            keys.append(bucket)
            payloads.append(pack(_delta(doc[i]), _delta(at[i].astype(np.uint32))) + planes[:, [0, 1, 2, 3, 4, 8, 9, 10, 11, 12, 13]].tobytes())
        yield _rows([ANCHORS] * len(keys), keys, payloads)

    def read(batches):
        held, n = [], 0
        for batch in batches:
            for part, data, offsets in K.slices(batch):
                for ids, bases, piece, at in pieces(part.column(0).to_pylist(), data, offsets, length):
                    x = spans(piece, at, length, gram)
                    held.append((np.array(ids, np.int64)[x["doc"]], x["at"] - at[x["doc"]] + bases[x["doc"]], x["a"], x["s"]))
                    n += len(x["at"])
                    if n >= FLUSH:
                        yield from flush(held)
                        held, n = [], 0
        if n:
            yield from flush(held)

    return read


# --- 2: repeats --------------------------------------------------------------


def _repeat_reader(parts: int):
    def read(table: pa.Table) -> pa.Table:
        docs, ats, hashes, through = [], [], [], []
        for kind, key, raw in zip(table["kind"].to_pylist(), table["key"].to_pylist(), table["payload"]):
            raw = raw.as_py()
            if kind == FLAGS:
                through.append((key, raw))
                continue
            n = int(np.frombuffer(raw, np.int64, 1)[0])
            doc, at = unpack(raw[: len(raw) - 11 * n], np.int64, np.uint32)
            docs.append(np.cumsum(doc))
            ats.append(np.cumsum(at, dtype=np.uint32))
            hashes.append(np.frombuffer(raw, np.uint8, 11 * n, len(raw) - 11 * n).reshape(n, 11))
        keys, payloads = [k for k, _ in through], [p for _, p in through]
        if docs:
            doc, at, raw = np.concatenate(docs), np.concatenate(ats), np.concatenate(hashes)
            wide = np.zeros((len(raw), 16), np.uint8)
            wide[:, [0, 1, 2, 3, 4]] = raw[:, :5]
            wide[:, [8, 9, 10, 11, 12, 13]] = raw[:, 5:]
            a, s = wide.view(_U).reshape(-1, 2).T
            a, s = np.ascontiguousarray(a), np.ascontiguousarray(s)
            del wide, raw, docs, ats, hashes
            order = np.argsort(a, kind="stable")
            again = np.empty(len(a), dtype=bool)
            same = a[order][1:] == a[order][:-1]
            again[order] = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            doc, at, a, s = doc[again], at[again], a[again], s[again]
            order = np.lexsort((doc, s, a))
            doc, at, a, s = doc[order], at[order], a[order], s[order]
        else:
            a = np.zeros(0, _U)
        if len(a):
            new_a = np.concatenate([[True], a[1:] != a[:-1]])
            new_s = new_a | np.concatenate([[True], s[1:] != s[:-1]])
            group, run = np.cumsum(new_a) - 1, np.cumsum(new_s) - 1
            least = np.flatnonzero(new_s)[run]
            full = doc > doc[least]
            kinds = np.bincount(group[new_s])  # different spans of each anchor
            apart = np.maximum.reduceat(doc, np.flatnonzero(new_a)) > np.minimum.reduceat(doc, np.flatnonzero(new_a))
            flag = np.where(full, FULL, np.where((kinds[group] > 1) & apart[group], np.where(kinds[group] > HOT_SPANS, SORT_HOT, SORT), 0)).astype(np.uint8)
            i = np.flatnonzero(flag)
            back = np.where(full, at.astype(np.int64) - at[least], 0)
            more_keys, more = _flag_rows(doc[i], at[i], s[i].astype(np.uint16), flag[i], np.where(full, doc[least], 0)[i], back[i], parts)
            keys, payloads = keys + more_keys, payloads + more
        return pa.table([pa.array(keys, pa.int64()), pa.array(payloads, pa.binary())], names=["part", "payload"])

    return read


# --- 3: suffix sort ----------------------------------------------------------


def common_extension(prefix: np.ndarray, x: np.ndarray, y: np.ndarray, limit: int) -> np.ndarray:
    """Length of the longest common prefix, up to ``limit``, of the suffixes at x and at y, by binary search over hashes."""
    _, down = K.powers(len(prefix))
    out = np.zeros(len(x), dtype=np.int64)
    step = 1 << (limit.bit_length() - 1)
    while step:
        try_ = out + step <= limit
        i, j = x + out, y + out
        i, j = np.where(try_, i, x), np.where(try_, j, y)
        same = (prefix[i + step] - prefix[i]) * down[i] == (prefix[j + step] - prefix[j]) * down[j]
        out += np.where(try_ & same, step, 0)
        step >>= 1
    return out


def _less(data, prefix, x, y, limit, or_equal):
    extension = common_extension(prefix, x, y, limit)
    ended = extension >= limit
    at = np.where(ended, 0, extension)
    return np.where(ended, or_equal, data[x + at] < data[y + at])


def sort_suffixes(data: np.ndarray, prefix: np.ndarray, start: np.ndarray, group: np.ndarray, limit: int) -> np.ndarray:
    """Order of suffixes by (group, first ``limit`` bytes): a stable bottom-up mergesort of all groups side by side.

    ``group`` is already ascending.  On each level every suffix finds its rank
    in the sibling run by binary search.
    """
    order = np.arange(len(start))
    if not len(start):
        return order
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.append(first, len(group)))
    first_of, size_of = np.repeat(first, size), np.repeat(size, size)
    run = 1
    while run < size.max():
        live = np.flatnonzero(size_of > run)
        within = live - first_of[live]
        pair = within // (2 * run) * (2 * run)
        left = within - pair < run
        end = size_of[live]
        low = np.where(left, np.minimum(pair + run, end), pair)
        high = np.where(left, np.minimum(pair + 2 * run, end), np.minimum(pair + run, end))
        base = low.copy()
        mine = start[order[live]]
        open_ = low < high
        while open_.any():
            k = np.flatnonzero(open_)
            mid = (low[k] + high[k]) // 2
            other = start[order[first_of[live[k]] + mid]]
            # Left elements stay before equal right ones: stable.
            before = _less(data, prefix, other, mine[k], limit, ~left[k])
            low[k] = np.where(before, mid + 1, low[k])
            high[k] = np.where(before, high[k], mid)
            open_ = low < high
        rank = np.where(left, within + (low - base), within - run + (low - base))
        moved = order.copy()
        moved[first_of[live] + rank] = order[live]
        order = moved
        run *= 2
    return order


def repeated_strings(data: np.ndarray, start: np.ndarray, group: np.ndarray, doc: np.ndarray, length: int) -> np.ndarray:
    """Which strings of ``length`` bytes also start in a smaller document of the same group."""
    out = np.zeros(len(start), dtype=bool)
    if not len(start):
        return out
    prefix = K.prefix_hash(data)
    # Only strings whose hash comes up again in their group can be repeated.
    h = K.span_hash(prefix, start, start + length) ^ group
    ordered = np.sort(h)
    twice = ordered[:-1][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return out
    order = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, h), len(twice) - 1)] == h)
    order = order[np.argsort(group[order], kind="stable")]
    order = order[sort_suffixes(data, prefix, start[order], group[order], length)]
    at, g = start[order], group[order]
    same = (g[1:] == g[:-1]) & (common_extension(prefix, at[1:], at[:-1], length) >= length)
    i = np.flatnonzero(same)
    for k in range(0, len(i), 1 << 18):  # equal hashes are checked byte by byte
        j = i[k : k + (1 << 18)]
        for b in range(length):
            same[j] &= data[at[j + 1] + b] == data[at[j] + b]
    new = np.flatnonzero(np.concatenate([[True], ~same]))
    least = np.minimum.reduceat(doc[order], new)
    out[order] = doc[order] > np.repeat(least, np.diff(np.append(new, len(order))))
    return out


# --- 3 and 4: documents ------------------------------------------------------

SPANS, RANGES, STRETCHES = 0, 1, 2
_STRETCH_TYPES = (np.int64, np.int64, np.int64, np.uint32, np.uint32, np.uint32)  # first document, its begin, document, begin, size, text check
_SPAN_TYPES = (_U, np.int64, np.uint32, np.uint32, np.uint8, np.uint8)  # anchor, document, text check, first start, anchor's place, bytes
_RANGE_TYPES = (np.int64, np.uint32, np.uint32, np.uint32)  # document, begin, size, text check


def _merge(begin: np.ndarray, end: np.ndarray, first: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ranges with ascending ends: those that overlap or touch and lie as far back in one first document, as one."""
    new = np.concatenate([[True], (begin[1:] > end[:-1]) | (first[1:] != first[:-1]) | (back[1:] != back[:-1])])
    return begin[new], end[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(end) - 1]])], first[new], back[new]


def _equal_stretches(a: np.ndarray, b: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and size of the maximal runs of at least ``length`` equal bytes."""
    begin, end = K.runs(a == b, np.array([0, len(a)]))
    long = end - begin >= length
    return begin[long], (end - begin)[long]


def _range_rows(doc, begin, size, check, parts: int):
    keys, payloads = [], []
    for part, i in _by(np.mod(doc, parts)):
        keys.append(part)
        payloads.append(pack(_delta(doc[i]), begin[i].astype(np.uint32), size[i].astype(np.uint32), check[i].astype(np.uint32)))
    return keys, payloads


def _pack_spans(a, doc, check, lo, place, size, body: bytes) -> bytes:
    head = pack(a, doc, check.astype(np.uint32), lo.astype(np.uint32), place.astype(np.uint8), size.astype(np.uint8))
    return np.int64(len(head)).tobytes() + head + _squeeze(body)


def _gather(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> bytes:
    """The bytes of [begin, begin + size), one after another."""
    at = np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    return data[at].tobytes()


def _text(value) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), np.uint8) if value.is_valid else np.zeros(0, np.uint8)


def _meeting(buckets: int, length: int, gram: int):
    """Flagged documents of a part: ranges that are settled, and spans to sort."""

    def read(left: pa.Table, right: pa.Table) -> pa.Table:
        ranges, sort, single, stretches = [], [], [], []  # settled; whole spans; single strings; to be verified
        flags = [_read_flags(x.as_py()) for x in right["payload"]]
        if flags:
            doc, at, check, flag, first, back = (np.concatenate(x) for x in zip(*flags))
            order = np.lexsort((at, doc))
            doc, at, check, flag, first, back = doc[order], at[order], check[order], flag[order], first[order], back[order]
            for d, value in zip(left["doc_id"].to_pylist(), left["text"]):
                own = slice(np.searchsorted(doc, d), np.searchsorted(doc, d, side="right"))
                if own.start == own.stop:
                    continue
                raw = _text(value)
                crc = zlib.crc32(raw)
                for _, bases, piece, cuts in pieces([d], raw, np.array([0, len(raw)]), length):
                    base = int(bases[0])
                    x = spans(piece, cuts, length, gram)
                    if not len(x["at"]):
                        continue
                    k = np.minimum(np.searchsorted(x["at"] + base, at[own]), len(x["at"]) - 1)
                    hit = (x["at"][k] + base == at[own]) & ((x["s"][k] >> _U(16)).astype(np.uint16) == check[own])
                    k, f = k[hit], flag[own][hit]
                    j, i = np.unique(k[f == FULL], return_index=True)
                    if len(j):
                        i = np.flatnonzero(hit)[f == FULL][i]
                        b, e, one, far = _merge(x["lo"][j], x["hi"][j] + length, first[own][i], back[own][i])
                        stretches.append((one, b + base - far, np.full(len(b), d), b + base, e - b, np.full(len(b), crc), np.frombuffer(_gather(piece, b, e - b), np.uint8)))
                    j = np.unique(k[f == SORT])
                    if len(j):
                        size = x["hi"][j] - x["lo"][j] + length
                        sort.append((x["a"][j], np.full(len(j), d), np.full(len(j), crc), x["lo"][j] + base, x["at"][j] - x["lo"][j], size, np.frombuffer(_gather(piece, x["lo"][j], size), np.uint8)))
                    j = np.unique(k[f == SORT_HOT])
                    if len(j):
                        count = x["hi"][j] - x["lo"][j] + 1
                        s = np.repeat(x["lo"][j] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
                        h = K.span_hash(K.prefix_hash(piece), s, s + length)
                        single.append((h, np.full(len(s), d), np.full(len(s), crc), s + base, np.frombuffer(_gather(piece, s, np.full(len(s), length)), np.uint8).reshape(len(s), length)))
        kinds, keys, payloads = [], [], []
        if single:  # one string for each document that is the first to have it here
            h, d, crc, s, body = (np.concatenate(x) for x in zip(*single))
            order = np.lexsort((d, h))
            h, d, crc, s, body = h[order], d[order], crc[order], s[order], body[order]
            new = np.concatenate([[True], h[1:] != h[:-1]])
            least = np.flatnonzero(new)[np.cumsum(new) - 1]
            late = (d > d[least]) & (body == body[least]).all(axis=1)
            ranges.append((d[late], s[late], np.full(late.sum(), length), crc[late]))
            sort.append((h[~late], d[~late], crc[~late], s[~late], np.zeros((~late).sum(), np.int64), np.full((~late).sum(), length), body[~late].reshape(-1)))
        if sort:
            a, d, crc, lo, place, size, body = (np.concatenate(x) for x in zip(*sort))
            begin = np.concatenate([[0], np.cumsum(size)])
            for bucket, i in _by((K.mix(a) % _U(buckets)).astype(np.int64)):
                kinds.append(SPANS)
                keys.append(bucket)
                payloads.append(_pack_spans(a[i], d[i], crc[i], lo[i], place[i], size[i], _gather(body, begin[i], size[i])))
        if stretches:
            one, place, d, b, size, crc, body = (np.concatenate(x) for x in zip(*stretches))
            begin = np.concatenate([[0], np.cumsum(size)])
            for part, i in _by(np.mod(one, buckets)):
                head = pack(one[i], place[i], d[i], b[i].astype(np.uint32), size[i].astype(np.uint32), crc[i].astype(np.uint32))
                kinds.append(STRETCHES)
                keys.append(part)
                payloads.append(np.int64(len(head)).tobytes() + head + _squeeze(_gather(body, begin[i], size[i])))
        if ranges:
            more, packed = _range_rows(*(np.concatenate(x) for x in zip(*ranges)), buckets)
            kinds, keys, payloads = kinds + [RANGES] * len(more), keys + more, payloads + packed
        return pa.table([pa.array(kinds, pa.int32()), pa.array(keys, pa.int64()), pa.array(payloads, pa.binary())], names=["kind", "key", "payload"])

    return read


def _verified(texts: dict[int, list[np.ndarray]], stretches: list[bytes], length: int):
    """Ranges of the stretches that are equal, byte by byte, to the first document's."""
    out = []
    for raw in stretches:
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        body, at = np.frombuffer(_expand(raw[8 + n :]), np.uint8), 0
        for one, place, doc, begin, size, check in zip(*(x.tolist() for x in unpack(raw[8 : 8 + n], *_STRETCH_TYPES))):
            own, at = body[at : at + size], at + size
            for text in texts.get(one, ()):  # several where rows share an id
                low, high = max(0, -place), min(size, len(text) - place)
                if high - low < length:
                    continue
                there = text[place + low : place + high]
                if np.array_equal(own[low:high], there):
                    out.append((doc, begin + low, high - low, check))
                else:
                    out += [(doc, begin + low + b, n, check) for b, n in zip(*(x.tolist() for x in _equal_stretches(own[low:high], there, length)))]
    return out


def _settler(parts: int, length: int):
    """The suffix sort of a bucket's spans, and what a part's documents are the first to have."""

    def read(left: pa.Table, right: pa.Table) -> pa.Table:
        held, bodies, stretches, keys, payloads = [], [], [], [], []
        for kind, key, raw in zip(right["kind"].to_pylist(), right["key"].to_pylist(), right["payload"]):
            raw = raw.as_py()
            if kind == RANGES:
                keys.append(key)
                payloads.append(raw)
                continue
            if kind == STRETCHES:
                stretches.append(raw)
                continue
            n = int(np.frombuffer(raw, np.int64, 1)[0])
            held.append(unpack(raw[8 : 8 + n], *_SPAN_TYPES))
            bodies.append(np.frombuffer(_expand(raw[8 + n :]), np.uint8))
        if stretches:
            texts: dict[int, list[np.ndarray]] = {}
            for d, value in zip(left["doc_id"].to_pylist(), left["text"]):
                texts.setdefault(d, []).append(_text(value))
            found = _verified(texts, stretches, length)
            if found:
                more, packed = _range_rows(*(np.array(x, np.int64) for x in zip(*sorted(found))), parts)
                keys, payloads = keys + more, payloads + packed
        if held:
            a, doc, check, lo, place, size = (np.concatenate(x) for x in zip(*held))
            data, size = np.concatenate(bodies), size.astype(np.int64)
            begin = np.concatenate([[0], np.cumsum(size)[:-1]])
            count = size - length + 1
            owner = np.repeat(np.arange(len(a)), count)
            k = np.arange(len(owner)) - np.repeat(np.concatenate([[0], np.cumsum(count)[:-1]]), count)
            group = K.mix(a[owner] + (place[owner].astype(np.int64) - k).astype(_U) * _U(0x9E3779B97F4A7C15))
            i = np.flatnonzero(repeated_strings(data, begin[owner] + k, group, doc[owner], length))
            if len(i):  # neighbouring strings of one span as one range
                new = np.concatenate([[True], (owner[i][1:] != owner[i][:-1]) | (k[i][1:] != k[i][:-1] + 1)])
                first, last = i[new], i[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(i) - 1]])]
                o = owner[first]
                more, packed = _range_rows(doc[o], lo[o].astype(np.int64) + k[first], k[last] - k[first] + length, check[o], parts)
                keys, payloads = keys + more, payloads + packed
        return pa.table([pa.array(keys, pa.int64()), pa.array(payloads, pa.binary())], names=["part", "payload"])

    return read


def _cut(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[int, int, int, str]:
    if not len(begin):
        return len(raw), 0, 0, hashlib.sha256(raw).hexdigest()
    delta = np.zeros(len(raw) + 1, dtype=np.int32)
    np.add.at(delta, begin, 1)
    np.add.at(delta, end, -1)
    gone = np.cumsum(delta[:-1]) > 0
    rises = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return len(raw), int(gone.sum()), rises, hashlib.sha256(raw[~gone].tobytes()).hexdigest()


OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _finish(left: pa.Table, right: pa.Table) -> pa.Table:
    """All documents of a part, cut."""
    found = [unpack(x.as_py(), *_RANGE_TYPES) for x in right["payload"]]
    none = np.zeros(0, np.int64)
    doc, begin, size, check = (np.concatenate(x).astype(np.int64) for x in zip(*[(np.cumsum(d), b, n, c) for d, b, n, c in found])) if found else (none, none, none, none)
    order = np.argsort(doc, kind="stable")
    doc, begin, size, check = doc[order], begin[order], size[order], check[order]
    rows = []
    for d, value in zip(left["doc_id"].to_pylist(), left["text"]):
        raw = _text(value)
        own = slice(np.searchsorted(doc, d), np.searchsorted(doc, d, side="right"))
        b, e = none, none
        if own.start < own.stop:
            mine = check[own] == zlib.crc32(raw)
            b, e = begin[own][mine], (begin[own] + size[own])[mine]
        rows.append((d, *_cut(raw, b, e)))
    return pa.table([pa.array([r[i] for r in rows], pa.int64() if i < 4 else pa.string()) for i in range(5)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` for every row with an id.

    One lazy plan: each time that documents meet their flags, stretches or
    ranges they come from the same shuffle, so texts move once.
    """
    bound_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    buckets = parts_for(source)
    anchors = source.mapInArrow(_anchor_reader(buckets, buckets, length, gram), "kind int, key long, payload binary")
    # What a task settled by itself rides along to any bucket.
    bucket = F.when(F.col("kind") == ANCHORS, F.col("key")).otherwise(F.pmod(F.xxhash64("payload"), F.lit(buckets)))
    flags = anchors.groupBy(bucket.alias("bucket")).applyInArrow(_repeat_reader(buckets), "part long, payload binary")
    parted = source.withColumn("part", F.pmod("doc_id", F.lit(buckets)).cast("long")).groupBy("part")
    met = parted.cogroup(flags.groupBy("part")).applyInArrow(_meeting(buckets, length, gram), "kind int, key long, payload binary")
    bucket = F.when(F.col("kind") != RANGES, F.col("key")).otherwise(F.pmod(F.xxhash64("payload"), F.lit(buckets)))
    ranges = parted.cogroup(met.groupBy(bucket.alias("part"))).applyInArrow(_settler(buckets, length), "part long, payload binary")
    return parted.cogroup(ranges.groupBy("part")).applyInArrow(_finish, OUT)


#: The same rows by brute force in DuckDB's SQL: every string of 50 bytes, in hexadecimal.
ORACLE_SQL = r"""
WITH texts AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM {documents}
), strings AS MATERIALIZED (
  SELECT doc_id, i, substr(h, CAST(2 * i + 1 AS BIGINT), 100) AS s FROM texts, LATERAL (SELECT unnest(range(0, n - 49)) AS i) WHERE n >= 50
), late AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS first FROM strings) WHERE first < doc_id
), runs AS (
  SELECT doc_id, min(i) AS low, max(i) + 50 AS high FROM (
    SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (
      SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new FROM late))
  GROUP BY doc_id, run
), pieces AS (
  SELECT r.doc_id, low, high, coalesce(lag(high) OVER (PARTITION BY r.doc_id ORDER BY low), 0) AS since FROM runs r
), cut AS (
  SELECT p.doc_id, sum(high - low) AS n_removed, count(*) AS n_spans, max(high) AS last, string_agg(substr(t.h, CAST(2 * since + 1 AS BIGINT), CAST(2 * (low - since) AS BIGINT)), '' ORDER BY low) AS head
  FROM pieces p JOIN texts t ON t.doc_id = p.doc_id GROUP BY p.doc_id
)
SELECT t.doc_id, CAST(t.n AS BIGINT) AS n_bytes, CAST(coalesce(c.n_removed, 0) AS BIGINT) AS n_removed, coalesce(c.n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(c.head, '') || substr(t.h, CAST(2 * coalesce(c.last, 0) + 1 AS BIGINT)))) AS kept_sha256
FROM texts t LEFT JOIN cut c ON c.doc_id = t.doc_id
"""
