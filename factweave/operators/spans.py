"""Lines, spans and order: range joins, as-of lookups and window shapes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import contains_all, contains_any, count_of, trim_all


def matching(texts: DataFrame, text: str, any_of: list[str] = (), all_of: list[str] = (), none_of: list[str] = ()) -> DataFrame:
    """Rows whose text has any of, all of and none of some literals."""
    t = F.col(text)
    test = F.lit(True)
    if any_of:
        test = test & contains_any(t, list(any_of))
    if all_of:
        test = test & contains_all(t, list(all_of))
    if none_of:
        test = test & ~contains_any(t, list(none_of))
    return texts.where(test)


def gated(rows: DataFrame, gate: DataFrame, key: str, keep: bool = True) -> DataFrame:
    """Rows whose file passes (or, with ``keep`` false, fails) a file-level gate."""
    return rows.join(gate.select(key), key, "left_semi" if keep else "left_anti")


def enclosing(points: DataFrame, spans: DataFrame, key: str, at: str, first: str, last: str, order: list, width: Column | None = None, bin_of=lambda x: x) -> DataFrame:
    """Each point with the first span of its key, in the given order, that holds it; points without one are left out.

    With ``width`` and ``bin_of`` (a number of a place) the line is cut into
    bins of that width and a span stands in each bin it touches, so a point
    meets only spans near it; without, all of its key's.
    """
    columns = [F.col(f"p.{c}") for c in points.columns] + [F.col(f"s.{c}").alias(c) for c in spans.columns if c not in points.columns]
    on = F.col(f"p.{key}") == F.col(f"s.{key}")
    p, s = points, spans
    if width is not None:
        p = points.withColumn("_bin", F.floor(bin_of(F.col(at)) / width))
        s = spans.withColumn("_bin", F.explode(F.sequence(F.floor(bin_of(F.col(first)) / width), F.floor(bin_of(F.col(last)) / width))))
        on &= F.col("p._bin") == F.col("s._bin")
    held = p.alias("p").join(s.alias("s"), on).where(F.col(f"p.{at}").between(F.col(f"s.{first}"), F.col(f"s.{last}"))).select(*columns)
    window = Window.partitionBy(*points.columns).orderBy(*order)
    return held.withColumn("_n", F.row_number().over(window)).where("_n = 1").drop("_n")


def positions(lines: DataFrame, key: str, at: str, text: str, literal: str) -> DataFrame:
    """``(key, line, column, length)`` of every place of a literal, columns from 1."""
    parts = F.split(F.col(text), F.lit("\\Q" + literal + "\\E"))
    before = F.expr("transform(sequence(1, size(_p) - 1), i -> aggregate(slice(_p, 1, i), 0, (a, x) -> a + length(x)) + (i - 1) * " + str(len(literal)) + " + 1)")
    found = lines.where(F.col(text).contains(literal)).select(key, F.col(at).alias("line"), parts.alias("_p"))
    return found.select(key, "line", F.explode(before).alias("column"), F.lit(len(literal)).alias("length"))


def last_before(lines: DataFrame, key: str, at: str, is_start: Column, value: Column, name: str) -> DataFrame:
    """As-of lookup: for each line the value of the last line up to it that is a start."""
    window = Window.partitionBy(key).orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.withColumn(name, F.last(F.when(is_start, value), ignorenulls=True).over(window))


def previous_non_blank(lines: DataFrame, key: str = "file_id", at: str = "line_no", text: str = "text") -> DataFrame:
    window = Window.partitionBy(key).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    trimmed = trim_all(F.col(text))
    return lines.withColumn("previous", F.last(F.when(trimmed != "", trimmed), ignorenulls=True).over(window))


def running_depth(lines: DataFrame, key: str, at: str, text: str, opening: str, closing: str) -> DataFrame:
    """Depth after each line: openings less closings so far."""
    window = Window.partitionBy(key).orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.withColumn("depth", F.sum(count_of(F.col(text), opening) - count_of(F.col(text), closing)).over(window))


def brace_regions(lines: DataFrame, is_start: Column, key: str = "file_id", at: str = "line_no", text: str = "text") -> DataFrame:
    """``(key, start_line, end_line)``: from each starting line to where its brace closes.

    The region ends at the first line from the start on whose depth is back at
    what it was before, once a brace has been opened.
    """
    deep = running_depth(lines, key, at, text, "{", "}").withColumn("before", F.col("depth") - count_of(F.col(text), "{") + count_of(F.col(text), "}"))
    starts = deep.where(is_start).select(F.col(key).alias("_k"), F.col(at).alias("start_line"), F.col("before").alias("base"))
    opened = count_of(F.col(text), "{") > 0
    ends = deep.where((count_of(F.col(text), "}") > 0) | opened)
    held = starts.join(ends, (F.col("_k") == F.col(key)) & (F.col(at) >= F.col("start_line")) & (F.col("depth") <= F.col("base")) & (count_of(F.col(text), "}") > 0))
    return held.groupBy(F.col("_k").alias(key), "start_line").agg(F.min(at).alias("end_line"))


def in_rest(lines: DataFrame, key: str, at: str, test: Column, name: str) -> DataFrame:
    """Whether any later line of the key passes the test."""
    window = Window.partitionBy(key).orderBy(at).rowsBetween(1, Window.unboundedFollowing)
    return lines.withColumn(name, F.coalesce(F.bool_or(test).over(window), F.lit(False)))


def before_after(steps: DataFrame, keys: list[str], at: str, first: Column, then: Column) -> DataFrame:
    """Keys where some ``first`` step comes before some ``then`` step: the earliest first and the latest then.

    One aggregate with two conditional extremes in place of a self-join.
    """
    found = steps.groupBy(*keys).agg(F.min(F.when(first, F.col(at))).alias("first_at"), F.max(F.when(then, F.col(at))).alias("then_at"))
    return found.where("first_at < then_at")


def with_context(lines: DataFrame, key: str, at: str, text: str, k: int) -> DataFrame:
    """Each line with up to k lines before and after it."""
    window = Window.partitionBy(key).orderBy(at).rowsBetween(-k, k)
    return lines.withColumn("context", F.array_join(F.collect_list(text).over(window), "\n"))


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))
