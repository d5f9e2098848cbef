"""Mixing sources to target weights by entropy balancing, with DataFrame operations only.

Document rates (expected copies) stay as close as they can, in relative
entropy, to one copy each while every source's words add up to its target and
no rate exceeds ``cap``.  A document's entropy counts ``size / tilt`` times,
its tilt being ``STEPS`` + floor(``STEPS`` * log2(size)); so by the dual the
rate is an exponential tilt, ``least(cap, exp(multiplier * tilt))``: a source
that has to grow repeats its long documents rather than its short ones, and
one that has to shrink keeps the short ones.

The convex dual has one multiplier for each source.  Its gradient (words taken
less target) and curvature are sums over the source's documents.  Documents of
one source and tilt share a rate, so they are pre-aggregated to a row each, at
most ``STEPS`` for every doubling of the size however many documents there
are; a source's rows are one list of bounded length, and all its Newton steps
run in one expression, each kept inside the bracket of the root.  Steps start
with the whole bracket and halve it where Newton leaves it, so they converge.

Rates become copies by systematic rounding inside small hash buckets of a
source (so a source with a third of all rows is many windows, none large).
What a bucket's whole copies miss of its share is made up by one or a few
partial copies, so each source meets its target to within half a word for
every thousand documents, and nothing is taken more than ``cap`` times.

Edge cases: a null text has no words, a null source is a source of its own
(last in order), empty texts are taken zero times, very long ones are counted
whole, ties in size are broken by a digest of the id, repeated rows are mixed
like others, an empty table gives an empty result, other columns, also of
clashing names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
BUCKET_ROWS = 1024
#: Tilts for every doubling of a size.
STEPS = 8
#: Newton steps; with brackets halved in between, more than doubles can tell apart.
NEWTON_STEPS = 60
#: Rates are counted in these.
UNIT = 1_000_000_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def capped_targets(sources: DataFrame, share: float, cap: float, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``(source, source_size)`` -> with ``target``: ``share`` of all words dealt by weight, none above ``cap`` times its size.

    Weights repeat over the sources in code point order, null last.  Dealing
    the excess again until none is left is water filling: with sources ordered
    by the level at which they fill up, the final level is the first one that
    the remaining sources do not reach.  One row for each source, not document.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    full = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    ranked = sources.withColumn("weight", weight).select("*", F.lit(share) * F.sum("source_size").over(every).alias("all_words"), F.coalesce(F.sum("source_size").over(full), F.lit(0)).alias("filled"), (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(full), F.lit(0))).alias("open_weight"))
    level = (F.lit(share) * F.sum("source_size").over(every) - F.lit(cap) * F.col("filled")) / F.col("open_weight")
    levels = ranked.withColumn("level", level)
    reached = F.when(F.col("level") * F.col("weight") <= F.lit(cap) * F.col("source_size"), F.col("level"))
    final = levels.withColumn("final", F.max(reached).over(every))
    target = F.least(F.lit(cap) * F.col("source_size"), F.coalesce(F.col("final") * F.col("weight"), F.lit(cap) * F.col("source_size")))
    return final.select("source", "source_size", target.cast("double").alias("target"))


def tilt_of(size: Column) -> Column:
    """Steps of the logarithm of a size; 0 for no words."""
    return F.when(size > 0, STEPS + F.floor(STEPS * F.log2(size) + 1e-9)).otherwise(0).cast("long")


def multiplier(mass: str, target: str, cap: float) -> Column:
    """The root of the dual's gradient for ``mass``, an array of ``(tilt, words)``; null where no finite one is needed (target at or above the cap) or possible (target 0).

    State of a step: bracket and place.  The gradient grows with the multiplier;
    below a tilt of 1 step nothing lies, so the bracket's ends are safe.
    """
    taken = f"aggregate({mass}, 0D, (a, m) -> a + m.words * least({cap}D, exp(s.at * m.tilt)))"
    slope = f"aggregate({mass}, 0D, (a, m) -> a + if(exp(s.at * m.tilt) < {cap}D, m.words * m.tilt * exp(s.at * m.tilt), 0D))"
    low, high = "if(s.g < 0D, s.at, s.low)", "if(s.g < 0D, s.high, s.at)"
    newton = "s.at - s.g / s.c"
    start = f"named_struct('low', -50D, 'high', ln({cap}D) / {STEPS}, 'at', 0D)"
    step = (
        f"aggregate(array(named_struct('low', s.low, 'high', s.high, 'at', s.at, 'g', {taken} - {target}, 'c', {slope})), s, (z, s) -> "
        f"named_struct('low', {low}, 'high', {high}, 'at', if(s.g = 0D, s.at, if(s.c > 0D and {newton} > {low} and {newton} < {high}, {newton}, ({low} + {high}) / 2))))"
    )
    solved = f"aggregate(sequence(1, {NEWTON_STEPS}), {start}, (s, i) -> {step}, s -> s.at)"
    whole = f"aggregate({mass}, 0D, (a, m) -> a + m.words) * {cap}D"
    return F.expr(f"case when {target} > 0D and {target} < {whole} then {solved} end")


def entropy_balance(mass: DataFrame, targets: DataFrame, cap: float) -> DataFrame:
    """``mass(source, tilt, words)`` and ``targets(source, target)`` -> ``(source, tilt, rate)``, rates in billionths.

    A source whose target is at the cap has the cap as its rate; one with target 0 has 0.
    """
    lists = mass.where("tilt > 0").groupBy("source").agg(F.sort_array(F.collect_list(F.struct(F.col("tilt").cast("double").alias("tilt"), F.col("words").cast("double").alias("words")))).alias("mass"))
    held = lists.alias("m").join(targets.alias("t"), F.expr("m.source <=> t.source")).select("t.source", "t.target", "m.mass")
    solved = held.withColumn("multiplier", multiplier("mass", "target", cap))
    each = solved.select("source", "target", "multiplier", F.explode("mass.tilt").alias("tilt"))
    rate = F.when(F.col("multiplier").isNotNull(), F.least(F.lit(cap), F.exp(F.col("multiplier") * F.col("tilt")))).when(F.col("target") > 0, F.lit(cap)).otherwise(0.0)
    return each.select("source", F.col("tilt").cast("long").alias("tilt"), F.round(rate * UNIT).cast("long").alias("rate"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``(doc_id, source, size, source_size, target, rate, copies, taken)`` for every row.

    ``taken`` is in words: ``copies`` whole copies and perhaps one partial one.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    sized = scratch.save(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size")), "sized")
    sized = sized.withColumn("tilt", tilt_of(F.col("size")))
    mass = scratch.save(sized.groupBy("source", "tilt").agg(F.sum("size").alias("words"), F.count("*").alias("n")), "mass")
    sources = mass.groupBy("source").agg(F.sum("words").alias("source_size"), F.sum("n").alias("n_docs"))
    targets = scratch.save(capped_targets(sources.select("source", "source_size"), share, cap, weights), "targets")
    rates = mass.select("source", "tilt").alias("m").join(entropy_balance(mass, targets, cap).alias("e"), F.expr("m.source <=> e.source and m.tilt = e.tilt"), "left").select("m.source", "m.tilt", F.coalesce("e.rate", F.lit(0).cast("long")).alias("rate"))
    rates = rates.alias("r").join(targets.alias("t"), F.expr("r.source <=> t.source")).join(sources.alias("n"), F.expr("n.source <=> r.source"))
    rates = scratch.save(rates.select("r.source", "r.tilt", "t.source_size", "t.target", "r.rate", F.ceil(F.col("n.n_docs") / BUCKET_ROWS).alias("buckets")), "rates")
    scratch.keep("sized", "rates")

    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    bucket = F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") % F.col("buckets")
    placed = sized.alias("d").join(rates.alias("r"), F.expr("d.source <=> r.source and d.tilt = r.tilt")).select("d.doc_id", "d.source", "d.size", "r.source_size", "r.target", "r.rate", "r.buckets", digest.alias("digest")).withColumn("bucket", bucket)
    part = Window.partitionBy("source", "bucket")
    order = part.orderBy(F.desc("size"), "digest", "doc_id")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # Running sums of the rates, in whole billionths: a document gets a copy for each half unit that its share passes.
    upto, past = F.sum("rate").over(order.rowsBetween(Window.unboundedPreceding, 0)), F.coalesce(F.sum("rate").over(before), F.lit(0))
    passed = lambda x: F.floor((x + UNIT // 2) / F.lit(UNIT)).cast("long")
    whole = placed.withColumn("copies", passed(upto) - passed(past))
    whole = whole.withColumn("whole", F.col("copies") * F.col("size")).withColumn("room", (F.lit(cap) * F.col("size")).cast("long") - F.col("whole"))
    owed = whole.withColumn("owed", F.expr(f"cast((sum(rate * size) over (partition by source, bucket) + {UNIT // 2}) div {UNIT} as long)") - F.sum("whole").over(part))
    owed = owed.withColumn("room_before", F.coalesce(F.sum("room").over(before), F.lit(0))).withColumn("whole_before", F.coalesce(F.sum("whole").over(before), F.lit(0)))
    nothing = F.lit(0).cast("long")
    more = F.greatest(nothing, F.least("room", F.col("owed") - F.col("room_before")))
    less = F.greatest(nothing, F.least("whole", -F.col("owed") - F.col("whole_before")))
    taken = F.col("whole") + more - less
    return owed.select("doc_id", "source", "size", "source_size", "target", (F.col("rate") / UNIT).alias("rate"), F.coalesce(F.try_divide(taken, F.col("size")).cast("long"), nothing).alias("copies"), taken.alias("taken"))


#: The same rows in DuckDB's SQL: the root of the dual by bisection.
ORACLE_SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, size, CASE WHEN size > 0 THEN 8 + CAST(floor(8 * log2(size) + 1e-9) AS BIGINT) ELSE 0 END AS tilt
  FROM (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM {documents})
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n_docs FROM sized GROUP BY source
), weighted AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM sources
), levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - 2.0::DOUBLE * coalesce(sum(source_size) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM weighted
  WINDOW before AS (ORDER BY source_size::DOUBLE / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source, source_size, n_docs, least(2.0::DOUBLE * source_size, coalesce(max(CASE WHEN level * weight <= 2.0::DOUBLE * source_size THEN level END) OVER () * weight, 2.0::DOUBLE * source_size)) AS target
  FROM levels
), mass AS (
  SELECT source, list({{'tilt': tilt::DOUBLE, 'words': words::DOUBLE}} ORDER BY tilt) AS mass
  FROM (SELECT source, tilt, sum(size) AS words FROM sized WHERE size > 0 GROUP BY source, tilt) GROUP BY source
), steps AS (
  SELECT t.source, t.target, m.mass, -50.0::DOUBLE AS low, ln(2.0::DOUBLE) / 8 AS high, 0 AS n
  FROM targets t JOIN mass m ON t.source IS NOT DISTINCT FROM m.source WHERE t.target > 0 AND t.target < 2.0::DOUBLE * t.source_size
  UNION ALL
  SELECT source, target, mass, CASE WHEN taken < target THEN middle ELSE low END, CASE WHEN taken < target THEN high ELSE middle END, n + 1
  FROM (SELECT *, (low + high) / 2 AS middle, list_sum(list_transform(mass, lambda x: x.words * least(2.0::DOUBLE, exp((low + high) / 2 * x.tilt)))) AS taken FROM steps WHERE n < 80)
), solved AS (
  SELECT source, (low + high) / 2 AS multiplier FROM steps WHERE n = 80
), rates AS (
  SELECT t.*, CAST(ceil(n_docs / 1024.0) AS BIGINT) AS buckets, multiplier FROM targets t LEFT JOIN solved s ON t.source IS NOT DISTINCT FROM s.source
), placed AS (
  SELECT d.doc_id, d.source, d.size, r.source_size, r.target, md5(CAST(d.doc_id AS VARCHAR)) AS digest,
         CASE WHEN size = 0 OR target = 0 THEN 0 WHEN multiplier IS NULL THEN 2000000000 ELSE CAST(round(least(2.0::DOUBLE, exp(multiplier * tilt)) * 1000000000) AS BIGINT) END AS rate,
         CAST('0x' || substr(md5(CAST(d.doc_id AS VARCHAR)), 1, 8) AS BIGINT) % r.buckets AS bucket
  FROM sized d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source
), summed AS (
  SELECT *, CAST(sum(rate) OVER (PARTITION BY source, bucket ORDER BY size DESC, digest, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS upto,
         row_number() OVER (PARTITION BY source, bucket ORDER BY size DESC, digest, doc_id) AS nth
  FROM placed
), wholes AS (
  SELECT *, ((upto + 500000000) // 1000000000 - (upto - rate + 500000000) // 1000000000) * size AS whole FROM summed
), owed AS (
  SELECT *, 2 * size - whole AS room,
         CAST((sum(rate * size) OVER (PARTITION BY source, bucket) + 500000000) // 1000000000 AS BIGINT) - CAST(sum(whole) OVER (PARTITION BY source, bucket) AS BIGINT) AS owed,
         coalesce(sum(2 * size - whole) OVER before, 0) AS room_before, coalesce(sum(whole) OVER before, 0) AS whole_before
  FROM wholes
  WINDOW before AS (PARTITION BY source, bucket ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
)
SELECT doc_id, size, source_size, target,
       CAST(whole + greatest(0, least(room, owed - room_before)) - greatest(0, least(whole, -owed - whole_before)) AS BIGINT) AS taken
FROM owed
"""
