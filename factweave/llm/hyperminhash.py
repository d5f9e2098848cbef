"""Near-duplicate documents with HyperMinHash registers.

Every document's distinct word shingles are dealt to ``REGISTERS`` buckets; a
bucket keeps the leading-zero count of its smallest hash and the bits that
follow (the mantissa).  Bands of registers propose pairs, the registers'
collision-corrected Jaccard estimate drops hopeless ones, and the full shingle
sets confirm the rest.

Large groups: documents with equal sets are one class from the start.  In a
band's bucket each member is first paired with one pivot only, and confirmed
links are contracted.  Buckets that still hold several components are compared
pair by pair when they are small (a constant bound); members of larger ones
meet in an exact prefix join of their shingle sets: rarest shingles first, a
pair that reaches the threshold must share one of the first few, and how few
follows from the sizes that meet.  A family of n near copies whose own edits
are rare shingles so costs about n pairs, and no pair of different sets that
shares a bucket is left uncompared unless both are already in one component.

Recall: at the threshold 0.85 a pair misses all 25 bands of 5 registers with
probability below 1e-6.

Edge cases: null, empty and word-free texts have an empty set, no links and
are kept; a very long text is one set, whole; repeated rows and other equal sets
are one class, whose smallest id stands for it; an empty table gives an empty
result; columns other than the id and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import textkernel as K
from .components import connected_components
from .packing import Bloom
from .scratch import Scratch

REGISTERS = 128
REGISTER_BITS = 7
MANTISSA_BITS = 10
BAND_ROWS = 5
BANDS = REGISTERS // BAND_ROWS
#: Buckets up to this many members are compared pair by pair.
SMALL_BUCKET = 32
PROBES = 256
EMPTY = np.uint16(0xFFFF)
_U = np.uint64


def registers(shingles: np.ndarray) -> np.ndarray:
    """HyperMinHash registers of a sorted array of distinct 64-bit hashes."""
    out = np.full(REGISTERS, EMPTY, dtype=np.uint16)
    if len(shingles):
        bucket, first = np.unique(shingles >> _U(64 - REGISTER_BITS), return_index=True)
        rest = shingles[first] << _U(REGISTER_BITS)  # sorted, so the first of a bucket is its smallest
        rest |= _U((1 << REGISTER_BITS) - 1)
        zeros = 63 - np.floor(np.log2(rest.astype(np.float64))).astype(np.int64)
        zeros = np.where((rest << np.maximum(zeros, 0).astype(_U)) >> _U(63) == 1, np.maximum(zeros, 0), zeros + 1)
        mantissa = (rest << (zeros + 1).astype(_U)) >> _U(64 - MANTISSA_BITS)
        out[bucket.astype(np.int64)] = (np.minimum(zeros, 62).astype(np.uint16) << MANTISSA_BITS) | mantissa.astype(np.uint16)
    return out


def collision_chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """How often the minima of two unrelated sets of n and m values share a register.

    The smallest of k uniform values lies in [2**-(z+1), 2**-z), and so has z
    leading zeros, with probability exp(-k / 2**(z+1)) - exp(-k / 2**z); both
    counts have to agree, and then the mantissa's bits.
    """
    z = np.arange(63)
    each = []
    for size in (n, m):
        k = np.asarray(size, np.float64)[:, None] / REGISTERS
        filled = np.maximum(-np.expm1(-k), 1e-300)
        each.append((np.exp(-k * 2.0 ** -(z + 1)) - np.exp(-k * 2.0**-z)) / filled)
    return (each[0] * each[1]).sum(axis=1) * 2.0**-MANTISSA_BITS


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray | None = None, m: np.ndarray | None = None) -> np.ndarray:
    """Jaccard estimates of rows of registers, corrected for the collisions that sets of n and m values have by chance."""
    filled = (a != EMPTY) | (b != EMPTY)
    total = filled.sum(axis=1)
    share = ((a == b) & filled).sum(axis=1) / np.maximum(total, 1)
    chance = collision_chance(n, m) if n is not None and m is not None else (1 / 3) * 2.0**-MANTISSA_BITS
    return np.clip((share - chance) / (1 - chance), 0, 1)


def _probe_table() -> np.ndarray:
    at = np.arange(REGISTERS * PROBES, dtype=_U) + _U(1)
    return (K.mix(at * _U(0x9E3779B97F4A7C15)) % _U(REGISTERS)).astype(np.int64).reshape(REGISTERS, PROBES)


_PROBE = _probe_table()


def densified(regs: np.ndarray) -> np.ndarray:
    """Every empty register takes the value of the first filled one on its own fixed probe path.

    So a small set's bands hold as many values as a large one's, and a common
    passage alone does not make a key.
    """
    filled = regs != EMPTY
    if filled.all() or not filled.any():
        return regs
    out = regs.copy()
    holes = np.flatnonzero(~filled)
    path = _PROBE[holes]
    hit = filled[path]
    found = path[np.arange(len(holes)), hit.argmax(axis=1)]
    out[holes] = np.where(hit.any(axis=1), regs[found], regs[np.flatnonzero(filled)[0]])
    return out


def band_keys(regs: np.ndarray) -> list[int]:
    """A 64-bit key for every band."""
    rows = densified(regs)[: BANDS * BAND_ROWS].reshape(BANDS, BAND_ROWS).astype(_U)
    key = np.arange(1, BANDS + 1, dtype=_U)
    for i in range(BAND_ROWS):
        key = K.mix(key * _U(0x9E3779B97F4A7C15) + rows[:, i])
    return key.view(np.int64).tolist()


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray]]:
    for part, data, offsets in K.slices(batch):
        shingles, at = K.shingle_hashes(*K.word_hashes(data, offsets), width)
        for i, doc in enumerate(part.column(0).to_pylist()):
            yield doc, np.unique(shingles[at[i] : at[i + 1]])


def _signature_reader(width: int):
    def read(batches):
        for batch in batches:
            ids, n, sig, regs = [], [], [], []
            for doc, s in _sets(batch, width):
                ids.append(doc)
                n.append(len(s))
                sig.append(K.mix(s).sum(dtype=_U).tobytes() + K.mix(s ^ _U(0x5851F42D4C957F2D)).sum(dtype=_U).tobytes())
                regs.append(registers(s).tobytes())
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), pa.array(regs, pa.binary())], ["doc_id", "n_shingles", "sig", "regs"])

    return read


def _band_reader(batches):
    for batch in batches:
        ids, keys = [], []
        for doc, raw in zip(batch.column("doc_id").to_pylist(), batch.column("regs")):
            own = band_keys(np.frombuffer(raw.as_buffer(), dtype=np.uint16))
            ids += [doc] * len(own)
            keys += own
        yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(ids, pa.int64())], ["key", "id"])


def _promising(floor: float):
    def read(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS) for c in ("ra", "rb"))
            ok = pa.array(estimate(a, b, *(batch.column(c).to_numpy() for c in ("na", "nb"))) >= floor)
            yield pa.record_batch([batch.column("u").filter(ok), batch.column("v").filter(ok)], ["u", "v"])

    return read


def _wanted(bloom: Bloom):
    def read(batches):
        for batch in batches:
            yield batch.filter(pa.array(bloom.has(batch.column(0).to_numpy(zero_copy_only=False))))

    return read


def _set_reader(width: int):
    def read(batches):
        for batch in batches:
            ids, sets = [], []
            for doc, s in _sets(batch, width):
                ids.append(doc)
                sets.append(s.tobytes())
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], ["id", "shingles"])

    return read


def _confirm(num: int, den: int):
    def read(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb")):
                a, b = (np.frombuffer(s.as_buffer(), dtype=_U) for s in (x, y))
                if len(a) > len(b):
                    a, b = b, a
                if den * len(a) < num * len(b):
                    keep.append(False)
                    continue
                at = np.searchsorted(b, a)
                both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
                keep.append(den * both >= num * (len(a) + len(b) - both))
            yield pa.record_batch([batch.column(c).filter(pa.array(keep, pa.bool_())) for c in ("u", "v")], ["u", "v"])

    return read


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: tuple[int, int] = (85, 100), slack: float = 0.15) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row.

    Linked are documents whose sets of ``width``-word shingles have a Jaccard
    similarity of at least ``threshold`` (a fraction, compared in integers).
    ``slack`` is how far below the threshold an estimate may fall before the
    sets are no longer compared: five standard errors of 128 registers.
    Rows whose id is null are left out.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "hyperminhash")
    num, den = threshold
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    signed = scratch.save(source.mapInArrow(_signature_reader(width), "doc_id long, n_shingles long, sig binary, regs binary"), "signatures")
    whole = signed.where("n_shingles > 0")
    # One class for equal sets: the digest has 128 bits and the size goes with it.
    classes = scratch.save(whole.groupBy("sig", "n_shingles").agg(F.min_by(F.struct("doc_id", "regs"), "doc_id").alias("r")).select("r.doc_id", "sig", "n_shingles", "r.regs"), "classes")
    buckets = classes.select("doc_id", "regs").mapInArrow(_band_reader, "key long, id long")
    crowded = buckets.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    held = scratch.save(buckets.join(crowded, "key"), "buckets0")

    regs = classes.select("doc_id", "regs", "n_shingles")
    numbers = count()

    def confirmed(pairs: DataFrame, name: str, estimated: bool = True) -> DataFrame:
        near = pairs
        if estimated:
            both = pairs.join(regs.select(F.col("doc_id").alias("u"), F.col("regs").alias("ra"), F.col("n_shingles").alias("na")), "u").join(regs.select(F.col("doc_id").alias("v"), F.col("regs").alias("rb"), F.col("n_shingles").alias("nb")), "v")
            near = both.select("u", "v", "ra", "rb", "na", "nb").mapInArrow(_promising(num / den - slack), "u long, v long")
        near = scratch.save(near, f"near_{name}")
        sets = scratch.save(_sets_of(near.select(F.col("u").alias("doc_id")).union(near.select("v"))), f"sets_{name}")
        both = near.join(sets.select(F.col("id").alias("v"), F.col("shingles").alias("sb")), "v").join(sets.select(F.col("id").alias("u"), F.col("shingles").alias("sa")), "u")
        found = scratch.save(both.select("u", "v", "sa", "sb").mapInArrow(_confirm(num, den), "u long, v long"), f"links_{name}")
        scratch.drop(f"sets_{name}")
        return found

    def _sets_of(ids: DataFrame) -> DataFrame:
        ids = scratch.save(ids.distinct(), f"wanted{next(numbers)}")
        return source.mapInArrow(_wanted(Bloom(ids)), "doc_id long, text string").join(ids, "doc_id", "left_semi").mapInArrow(_set_reader(width), "id long, shingles binary")

    pivot = held.groupBy("key").agg(F.min("id").alias("p"))
    stars = held.join(pivot, "key").where("id <> p").select(F.col("p").alias("u"), F.col("id").alias("v")).distinct()
    links = confirmed(stars, "star")
    joined = connected_components(links, scratch, "cc0_")
    mixed = scratch.save(_mixed(held, joined), "mixed")
    small = mixed.where(F.col("n") <= SMALL_BUCKET)
    other = small.select("key", F.col("id").alias("v"), F.col("component").alias("other"))
    pairs = small.select("key", F.col("id").alias("u"), "component").join(other, "key").where("u < v and component <> other").select("u", "v").distinct()
    links = links.union(confirmed(pairs, "small"))
    large = mixed.where(F.col("n") > SMALL_BUCKET).select(F.col("id").alias("doc_id"), "component").distinct()
    if not large.isEmpty():
        joined = connected_components(links, scratch, "cc1_")
        large = large.select("doc_id").join(joined.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("component"))
        sets = scratch.save(_sets_of(large.select("doc_id")).dropDuplicates(["id"]), "sets_large")
        tokens = sets.mapInArrow(_explode, "id long, n long, token long")
        pairs = _prefix_pairs(tokens.join(large.withColumnRenamed("doc_id", "id"), "id"), num, den)
        links = links.union(confirmed(scratch.save(pairs, "pairs_large"), "large", estimated=False))
    joined = scratch.save(connected_components(links, scratch, "cc2_"), "joined")
    scratch.keep("signatures", "classes", "joined")

    label = joined.select(F.col("id").alias("rep"), "component")
    named = classes.select(F.col("doc_id").alias("rep"), F.col("sig").alias("csig"), F.col("n_shingles").alias("cn")).join(label, "rep", "left").select("csig", "cn", F.coalesce("component", "rep").alias("component"))
    out = signed.select("doc_id", "n_shingles", "sig").join(named, (F.col("sig") == F.col("csig")) & (F.col("n_shingles") == F.col("cn")), "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def _mixed(buckets: DataFrame, joined: DataFrame) -> DataFrame:
    """``(key, id, component, n)``: members of the buckets that hold several components."""
    members = buckets.join(joined, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    several = members.groupBy("key").agg(F.count("*").alias("n"), F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b")
    return members.join(several.select("key", "n"), "key")


def _explode(batches):
    for batch in batches:
        sets = [np.frombuffer(x.as_buffer(), dtype=_U) for x in batch.column("shingles")]
        n = np.array([len(s) for s in sets], dtype=np.int64)
        token = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
        yield pa.record_batch([pa.array(np.repeat(np.array(batch.column("id").to_pylist(), np.int64), n)), pa.array(np.repeat(n, n)), pa.array(token)], ["id", "n", "token"])


def _prefix_pairs(tokens: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs that may reach the threshold, of different components, by an exact prefix join.

    With tokens in ascending frequency, a pair that shares at least ``need``
    of them shares one whose place leaves room for that many in both sets.
    The least size that meets at a token bounds ``need`` from below before
    anything is paired, and tokens with one component left are dropped.
    """
    need = lambda x, y: f"ceil({num} * ({x} + {y}) / {num + den})"
    frequency = tokens.groupBy("token").agg(F.count("*").alias("df"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("df", "token"))
    rows = tokens.join(frequency, "token").withColumn("place", place).where(F.expr(f"place <= n - ceil({num} * n / {den}) + 1 and df > 1"))
    least = rows.groupBy("token").agg(F.min("n").alias("least"))
    rows = rows.join(least, "token").where(F.expr(f"n - place + 1 >= {need('n', f'greatest(least, ceil({num} * n / {den}))')}")).select("token", "id", "n", "place", "component")
    several = rows.groupBy("token").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("token")
    rows = rows.join(several, "token", "left_semi")
    x, y = rows.alias("x"), rows.alias("y")
    fits = F.expr(f"x.token = y.token and x.id < y.id and x.component <> y.component and least(x.n - x.place, y.n - y.place) + 1 >= {need('x.n', 'y.n')}")
    return x.join(y, fits).select(F.col("x.id").alias("u"), F.col("y.id").alias("v")).distinct()


#: The same rows by brute force in DuckDB's SQL: all pairs that share a shingle.
ORACLE_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM {documents}
), shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] END) AS s FROM words)
), sizes AS MATERIALIZED (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS MATERIALIZED (
  SELECT u, v FROM (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id) p
  JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v WHERE 100 * p.n >= 85 * (x.n + y.n - p.n)
), reach AS (
  SELECT u, v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON l.u = r.v
), least AS (
  SELECT u, min(v) AS v FROM reach GROUP BY u
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, least(d.doc_id, coalesce(l.v, d.doc_id)) AS component_id, least(d.doc_id, coalesce(l.v, d.doc_id)) = d.doc_id AS kept
FROM {documents} d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN least l ON l.u = d.doc_id
"""
