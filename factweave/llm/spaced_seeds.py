"""Benchmark decontamination with spaced seeds.

A seed is a fixed mask over consecutive tokens that looks at some positions
and ignores the others, so a hit survives a changed word at an ignored one.
Hashes of every masked window of the test items are joined with those of every
masked window of every document; each hit names a diagonal, along which item
and document are aligned token by token, and the longest stretch of that
alignment that is equal enough is reported when it is long enough.

Recall: at the default share of 0.8 no placing of the changed tokens hides a
stretch of 12 tokens or more from the four masks of weight 5, nor a shorter
item of 5 tokens or more from the four of weight 4; items of up to 4 tokens
allow no change and are looked for as a whole.  So the result is what
comparing along every diagonal gives.

Scale: items of equal tokens are one class.  The documents are read twice:
first a Bloom filter of bounded size lets through the places whose hash an
item may have, and only these places, no texts, go to the join; then documents
that have a diagonal are read again, and each diagonal carries just the tokens
along it to be verified.  Both joins are plain shuffle joins that adaptive
execution can split (or broadcasts below ``BROADCAST_BYTES``), so a passage
that a third of all documents have costs them a row each; two texts only meet
where they share a seed.

Edge cases: null and empty documents and items have no hits; very long ones
are taken whole (a diagonal is one row of 8 bytes a token of the item); of
equally long stretches the one with most equal tokens, then the last in the
document is reported; repeated items and documents are each reported, also
those that share an id or have none; an empty table on either side gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textkernel as K
from .packing import Bloom
from .scratch import Scratch

#: Fixed masks of weight 5: 1 looks at a token, 0 ignores it.
MASKS = ("11111", "1101011", "11011001", "101100011")
#: For items that are shorter than the least overlap, down to 5 tokens; below, the item itself is the mask.
SHORT_MASKS = ("1111", "11101", "11011", "10111")
WHOLE_MASKS = ("1", "11", "111", "1111")
MIN_OVERLAP = 12
MIN_EQUAL = 0.8
#: Item seeds and classes below this are broadcast.
BROADCAST_BYTES = 4 << 20
#: Bits of the Bloom filter for an item seed: one place in 250,000 passes by chance while its 16 MB hold that many.
BLOOM_BITS_EACH = 1024
_U = np.uint64
_TOKEN = np.zeros(256, dtype=bool)
_TOKEN[48:58] = _TOKEN[65:91] = _TOKEN[97:123] = _TOKEN[128:] = True


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of lower-cased runs of letters and digits, and each text's first token's index."""
    starts, ends = K.runs(_TOKEN[data], offsets)
    return K.span_hash(K.prefix_hash(K.lower(data)), starts, ends), np.searchsorted(starts, offsets)


def masked(hashes: np.ndarray, mask: str, number: int) -> np.ndarray:
    """Hash of the looked-at tokens of every window; windows may cross texts, callers drop those."""
    n = len(hashes) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, _U)
    out = np.full(n, number + 1, dtype=_U)
    for i, looked in enumerate(mask):
        if looked == "1":
            out = (out ^ hashes[i : i + n]) * _U(0x9E3779B97F4A7C15)
            out ^= out >> _U(29)
    return K.mix(out)


def longest_stretch(equal: np.ndarray, share: Fraction) -> tuple[int, int]:
    """The longest stretch [i, j) of which ``share`` is equal; of several, the one with most equal, and of those the last."""
    score = np.where(equal, share.denominator - share.numerator, -share.numerator)
    total = np.concatenate([[0], np.cumsum(score)])
    count = np.concatenate([[0], np.cumsum(equal)])
    # A stretch keeps the share where its sum is not negative: the last end for each start is the last that reaches its sum.
    reach = np.maximum.accumulate(total[::-1])[::-1]
    end = np.searchsorted(-reach, -total, side="right") - 1
    length = end - np.arange(len(total))
    longest = np.flatnonzero(length == length.max())
    most = count[end[longest]] - count[longest]
    i = int(longest[most == most.max()][-1])
    return i, int(end[i])


def masks_of(size: int, min_overlap: int = MIN_OVERLAP) -> tuple[tuple[str, int], ...]:
    """The masks that find an item of ``size`` tokens, with their numbers."""
    numbered = [(m, i) for i, m in enumerate(MASKS + SHORT_MASKS + WHOLE_MASKS)]
    if size >= max(min_overlap, max(map(len, MASKS))):
        return tuple(numbered[:4])
    return tuple(numbered[4:8]) if size >= 5 else tuple(numbered[7 + size : 8 + size])


def _item_tokens(batches):
    for batch in batches:
        for part, data, offsets in K.slices(batch):
            hashes, first = tokens(data, offsets)
            own = [hashes[a:b].tobytes() for a, b in zip(first[:-1], first[1:])]
            yield pa.record_batch([part.column(0), pa.array(own, pa.binary()), pa.array(np.diff(first).astype(np.int32))], ["item_id", "tokens", "n"])


def _seeder(min_overlap: int):
    def seed(batches):
        for batch in batches:
            seeds, places, owners = [], [], []
            for cls, raw in zip(batch.column("cls").to_pylist(), batch.column("tokens")):
                hashes = np.frombuffer(raw.as_py(), _U)
                for mask, number in masks_of(len(hashes), min_overlap):
                    h = masked(hashes, mask, number)
                    seeds.append(h)
                    places.append(np.arange(len(h)))
                    owners.append(np.full(len(h), cls, np.int64))
            if seeds:
                yield pa.record_batch([pa.array(np.concatenate(seeds).view(np.int64)), pa.array(np.concatenate(owners)), pa.array(np.concatenate(places).astype(np.int32))], ["seed", "cls", "item_place"])

    return seed


def _prober(wanted: Bloom, masks: tuple[tuple[str, int], ...]):
    """Places of documents whose seed an item may have."""

    def probe(batches):
        for batch in batches:
            for part, data, offsets in K.slices(batch):
                hashes, first = tokens(data, offsets)
                uid = part.column(0).to_numpy(zero_copy_only=False)
                for mask, number in masks:
                    h = masked(hashes, mask, number)
                    at = np.flatnonzero(wanted.has(h.view(np.int64)))
                    doc = np.searchsorted(first, at, side="right") - 1
                    inside = at + len(mask) <= first[doc + 1]
                    at, doc = at[inside], doc[inside]
                    if len(at):
                        yield pa.record_batch([pa.array(h[at].view(np.int64)), pa.array(uid[doc]), pa.array((at - first[doc]).astype(np.int32))], ["seed", "uid", "place"])

    return probe


def _doc_tokens(batches):
    for batch in batches:
        for part, data, offsets in K.slices(batch):
            hashes, first = tokens(data, offsets)
            yield pa.record_batch([part.column(0), pa.array([hashes[a:b].tobytes() for a, b in zip(first[:-1], first[1:])], pa.binary())], ["uid", "tokens"])


FOUND = "uid long, cls long, overlap int, equal int, doc_token int, item_token int"


def _verifier(min_overlap: int, share: float):
    exact = Fraction(str(share))

    def verify(batches):
        for batch in batches:
            out = []
            for uid, cls, n, doc_low, item_low, doc, item in zip(*(batch.column(c).to_pylist() for c in ("uid", "cls", "n", "doc_low", "item_low")), batch.column("doc"), batch.column("item")):
                same = np.frombuffer(doc.as_buffer(), _U) == np.frombuffer(item.as_buffer(), _U)
                s, e = longest_stretch(same, exact)
                if e - s >= min(min_overlap, n):
                    out.append((uid, cls, e - s, int(same[s:e].sum()), doc_low + s, item_low + s))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
            yield pa.record_batch([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], [c.split()[0] for c in FOUND.split(", ")])

    return verify


def overlaps(source: DataFrame, items: DataFrame, scratch: Scratch, min_overlap: int = MIN_OVERLAP, min_equal: float = MIN_EQUAL) -> DataFrame:
    """``source(uid, text)`` and ``items(cls, tokens, n)`` -> the longest stretch of every document and class that overlap."""
    bounded = lambda df, n, size: F.broadcast(df) if n * size <= BROADCAST_BYTES else df
    seeds = scratch.save(items.select("cls", "tokens").mapInArrow(_seeder(min_overlap), "seed long, cls long, item_place int"), "seeds")
    sizes = items.agg(F.sum(F.octet_length("tokens")), F.collect_set(F.least("n", F.lit(min_overlap)))).first()  # at most min_overlap sizes
    masks = tuple(sorted({m for n in sizes[1] for m in masks_of(n, min_overlap)}, key=lambda m: m[1]))
    wanted = Bloom(seeds.select("seed"), BLOOM_BITS_EACH)
    hits = source.mapInArrow(_prober(wanted, masks), "seed long, uid long, place int")
    met = hits.join(bounded(seeds, seeds.count(), 24), "seed")
    diagonals = scratch.save(met.select("uid", "cls", (F.col("place") - F.col("item_place")).alias("shift")).distinct(), "diagonals")
    ids = scratch.save(diagonals.select("uid").distinct(), "ids")
    texts = source.join(bounded(ids, ids.count(), 8), "uid", "left_semi").dropDuplicates(["uid"])
    texts = texts.mapInArrow(_doc_tokens, "uid long, tokens binary")
    # Along a diagonal the difference of places is constant.
    low, tall = F.greatest("shift", F.lit(0)), F.col("shift") + F.col("n")
    sliced = diagonals.join(bounded(items.select("cls", "n"), items.count(), 16), "cls").join(texts, "uid")
    sliced = sliced.select("uid", "cls", "n", low.alias("doc_low"), (low - F.col("shift")).alias("item_low"), F.expr("substring(tokens, 8 * greatest(shift, 0) + 1, 8 * (shift + n - greatest(shift, 0)))").alias("doc")).where("octet_length(doc) > 0")
    both = sliced.join(bounded(items.select("cls", "tokens"), 1, sizes[0] or 0), "cls")
    both = both.select("uid", "cls", "n", "doc_low", "item_low", "doc", F.expr("substring(tokens, 8 * item_low + 1, octet_length(doc))").alias("item"))
    found = both.mapInArrow(_verifier(min_overlap, min_equal), FOUND)
    best = found.groupBy("uid", "cls").agg(F.max(F.struct("overlap", "equal", "doc_token", "item_token")).alias("best"))
    return scratch.save(best.select("uid", "cls", "best.*"), "overlaps")


def _prepared(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, scratch: Scratch):
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("uid", F.xxhash64("doc_id", "text"))
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text")).where("text is not null")
    held = scratch.save(items.mapInArrow(_item_tokens, "item_id long, tokens binary, n int").where("n > 0").withColumn("cls", F.xxhash64("tokens")), "items")
    return source, held, scratch.save(held.groupBy("cls").agg(F.first("tokens").alias("tokens"), F.first("n").alias("n")), "classes")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_overlap: int = MIN_OVERLAP, min_equal: float = MIN_EQUAL) -> DataFrame:
    """One row for each document and test item that overlap: the longest stretch of at least ``min_overlap`` tokens
    (or the whole of a shorter item) of which at least ``min_equal`` are equal, with its places."""
    scratch = Scratch(docs.sparkSession, "seeds")
    source, items, classes = _prepared(docs, benchmark, id_col, text_col, item_col, item_text_col, scratch)
    best = overlaps(source.select("uid", "text"), classes, scratch, min_overlap, min_equal)
    scratch.keep("items", "overlaps")
    named = source.select("doc_id", "uid").join(best, "uid").join(items.select("item_id", "cls", F.col("n").alias("item_tokens")), "cls")
    return named.select("doc_id", "item_id", *(F.col(c).cast("long").alias(c) for c in ("overlap", "equal", "doc_token", "item_token", "item_tokens")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_overlap: int = MIN_OVERLAP, min_equal: float = MIN_EQUAL) -> DataFrame:
    """The documents, with all their columns, that overlap no test item."""
    scratch = Scratch(docs.sparkSession, "seeds")
    source, _, classes = _prepared(docs, benchmark, id_col, text_col, item_col, item_text_col, scratch)
    hits = overlaps(source.select("uid", "text"), classes, scratch, min_overlap, min_equal).select(F.col("uid").alias("__hit")).distinct()
    scratch.keep("overlaps")
    return docs.join(hits, F.xxhash64(docs[id_col].cast("long"), docs[text_col].cast("string")) == hits["__hit"], "left_anti")


#: The same rows by brute force in DuckDB's SQL: every stretch of every diagonal with enough equal tokens.
ORACLE_SQL = r"""
WITH doc_tokens AS MATERIALIZED (
  SELECT doc_id, unnest(t) AS token, generate_subscripts(t, 1) - 1 AS p, len(t) AS n
  FROM (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM {documents})
), item_tokens AS MATERIALIZED (
  SELECT item_id, unnest(t) AS token, generate_subscripts(t, 1) - 1 AS p, len(t) AS n
  FROM (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM {benchmark})
), diagonals AS MATERIALIZED (
  SELECT d.doc_id, i.item_id, d.p - i.p AS shift, any_value(i.n) AS n FROM doc_tokens d JOIN item_tokens i ON i.token = d.token
  GROUP BY d.doc_id, i.item_id, d.p - i.p HAVING 5 * count(*) >= 4 * least(12, any_value(i.n))
), cells AS (
  SELECT g.doc_id, g.item_id, g.shift, g.n, i.p, CASE WHEN d.token = i.token THEN 1 ELSE 0 END AS same
  FROM diagonals g JOIN item_tokens i ON i.item_id = g.item_id JOIN doc_tokens d ON d.doc_id = g.doc_id AND d.p = i.p + g.shift
), summed AS MATERIALIZED (
  SELECT *, sum(same) OVER w AS equal, sum(5 * same - 4) OVER w AS score FROM cells WINDOW w AS (PARTITION BY doc_id, item_id, shift ORDER BY p)
), stretches AS (
  SELECT b.doc_id, b.item_id, b.n, b.p - a.p + 1 AS overlap, CAST(b.equal - a.equal + a.same AS BIGINT) AS equal, a.p + a.shift AS doc_token, a.p AS item_token
  FROM summed a JOIN summed b ON b.doc_id = a.doc_id AND b.item_id = a.item_id AND b.shift = a.shift AND b.p >= a.p
  WHERE b.score >= a.score - 5 * a.same + 4 AND b.p - a.p + 1 >= least(12, b.n)
)
SELECT doc_id, item_id, overlap, equal, doc_token, item_token, item_tokens FROM (
  SELECT doc_id, item_id, overlap, equal, doc_token, item_token, n AS item_tokens, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY overlap DESC, equal DESC, doc_token DESC, item_token DESC) AS k FROM stretches) WHERE k = 1
"""
