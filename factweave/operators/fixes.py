"""Fixes: edits for findings, the choice between overlapping ones, and their application."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

EDITS = "file_id long, fix_id long, start_line int, end_line int, replacement string, confidence double"


def suggested(found: DataFrame, lines: DataFrame) -> DataFrame:
    """Edits for the kinds of finding that have one: guards and checks that the reported line gets."""
    at = found.join(lines.select("file_id", F.col("line_no").cast("int").alias("line"), "text"), ["file_id", "line"])
    t = F.col("text")
    reentrancy = F.regexp_replace(t, r"\)\s*(public|external)", ") $1 nonReentrant")
    access = F.regexp_replace(t, r"\)\s*(public|external)", ") $1 onlyOwner")
    zero = F.concat(t, F.lit(" require("), F.regexp_extract("message", r": (\w+)", 1), F.lit(' != address(0), "zero address");'))
    unchecked = F.concat(F.regexp_extract(t, r"^\s*", 0), F.lit("(bool success, ) = "), F.ltrim(t), F.lit(" require(success);"))
    order = F.regexp_replace(t, r"(\w+)\s*/\s*(\w+)\s*\*\s*(\w+)", "$1 * $3 / $2")
    kinds = {"classic-reentrancy": (reentrancy, 0.8), "missing-access-modifiers": (access, 0.7), "missing-zero-address-check": (zero, 0.6), "unchecked-external-call": (unchecked, 0.7), "division-before-multiplication": (order, 0.9)}
    new, sure = F.lit(None).cast("string"), F.lit(None).cast("double")
    for name, (edit, confidence) in kinds.items():
        new, sure = F.when(F.col("detector_id") == name, edit).otherwise(new), F.when(F.col("detector_id") == name, F.lit(confidence)).otherwise(sure)
    out = at.select("file_id", F.xxhash64("file_id", "line", "detector_id").alias("fix_id"), F.col("line").alias("start_line"), F.col("line").alias("end_line"), new.alias("replacement"), sure.alias("confidence"), t.alias("old"))
    return out.where("replacement is not null and replacement <> old").drop("old")


def without_conflicts(edits: DataFrame) -> DataFrame:
    """Of edits that overlap, directly or through others, the one with the most confidence (then the first)."""
    by_start = Window.partitionBy("file_id").orderBy("start_line", "fix_id")
    reach = F.max("end_line").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    groups = edits.withColumn("_new", F.when(reach.isNull() | (F.col("start_line") > reach), 1).otherwise(0)).withColumn("_group", F.sum("_new").over(by_start))
    best = Window.partitionBy("file_id", "_group").orderBy(F.desc("confidence"), "start_line", "fix_id")
    return groups.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n", "_new", "_group")


def applied(sources: DataFrame, edits: DataFrame) -> DataFrame:
    """``(file_id, content)`` of the edited files; edits go in from the bottom up."""

    def apply(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in left[left.content.notna()].itertuples():
            lines = row.content.split("\n")
            for e in right.sort_values("start_line", ascending=False).itertuples():
                lines[e.start_line - 1 : e.end_line] = e.replacement.split("\n")
            out.append((row.file_id, "\n".join(lines)))
        return pd.DataFrame(out, columns=["file_id", "content"])

    chosen = without_conflicts(edits).select(F.col("file_id").alias("_file"), "fix_id", "start_line", "end_line", "replacement")
    touched = sources.select("file_id", "content").join(chosen.select("_file").distinct(), F.col("file_id") == F.col("_file"), "left_semi")
    return touched.groupBy("file_id").cogroup(chosen.groupBy("_file")).applyInPandas(apply, "file_id long, content string")
