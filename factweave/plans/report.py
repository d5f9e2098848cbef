"""Sinks of findings: JSON, text, diagnostics, and a table of results that is only brought up to date."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.scales import SEVERITIES, severity_ord
from ..operators import findings as fd
from .planner import Options, analyze


def as_json(findings: DataFrame) -> DataFrame:
    """One JSON document a row; ``df.write.text`` makes a file of lines of it."""
    return findings.select(F.to_json(F.struct(*findings.columns)).alias("value"))


def critical_files(findings: DataFrame) -> DataFrame:
    """``(path)`` of every file with a critical finding, sorted."""
    return findings.where("severity = 'Critical'").select("path").distinct().orderBy("path")


def write_report(findings: DataFrame, path: str | None = None, form: str = "json") -> None:
    """The report as a folder of text files, ``json`` (a finding a line) or ``text``; without a path on standard output."""
    if form not in ("json", "text"):
        raise ValueError(f"no such form: {form}")
    if path is None:
        print(as_text(findings) if form == "text" else "\n".join(r.value for r in as_json(findings).toLocalIterator()))
    elif form == "json":
        as_json(findings).write.mode("overwrite").text(path)
    else:
        spark = findings.sparkSession
        spark.createDataFrame([(as_text(findings),)], "value string").write.mode("overwrite").text(path)


#: What identifies a finding in a golden file.
GOLDEN = ("path", "line", "detector_id", "severity")


def write_golden(findings: DataFrame, path: str) -> None:
    """What later runs are compared with: one sorted JSON line for each distinct finding."""
    findings.select(*GOLDEN).distinct().orderBy(*GOLDEN).write.mode("overwrite").json(path)


def against_golden(findings: DataFrame, path: str, tolerance: int = 0) -> DataFrame:
    """``(path, line, detector_id, severity, change)``: findings that are ``missing`` or ``added``, lines within ``tolerance`` being the same."""
    golden = findings.sparkSession.read.schema(findings.select(*GOLDEN).schema).json(path)
    own = findings.select(*GOLDEN).distinct()
    same = F.expr(f"a.path = b.path and a.detector_id = b.detector_id and a.severity = b.severity and abs(a.line - b.line) <= {tolerance}")
    missing = golden.alias("a").join(own.alias("b"), same, "left_anti").withColumn("change", F.lit("missing"))
    return missing.union(own.alias("a").join(golden.alias("b"), same, "left_anti").withColumn("change", F.lit("added")))


def summary(findings: DataFrame) -> dict:
    """Counts for each severity (with zeros), distinct rules, files with critical findings (their number, and the first 100; ``critical_files`` names all), score and band; of bounded size."""
    n = {r.severity: r["count"] for r in findings.groupBy("severity").count().collect()}
    counts = {s: n.get(s, 0) for s in SEVERITIES}
    risk = min(10.0, 5 * counts["Critical"] + 3 * counts["High"] + 1.5 * counts["Medium"] + 0.5 * counts["Low"])
    critical = critical_files(findings)
    files = [r.path for r in critical.limit(100).collect()]
    return {"by_severity": counts, "detectors": findings.select("detector_id").distinct().count(), "critical_files": files, "n_critical_files": critical.count(), "risk": risk, "band": "none" if risk == 0 else "low" if risk < 3 else "medium" if risk < 6 else "high"}


def as_text(findings: DataFrame, limit: int = 200) -> str:
    """A report for a terminal: the first ``limit`` findings, worst first, and the summary."""
    rows = findings.orderBy(severity_ord(F.col("severity")).desc(), "path", "line", "detector_id").limit(limit).collect()
    total = summary(findings)
    lines = [f"{r.severity.upper():8} {r.path}:{r.line} {r.detector_id}: {r.message}" for r in rows]
    return "\n".join([*lines, "", ", ".join(f"{s} {n}" for s, n in reversed(total["by_severity"].items())), f"risk {total['risk']:g} ({total['band']})"])


def diagnostics(findings: DataFrame) -> DataFrame:
    """The shape editors take: 0-based lines and severities 1 to 4."""
    level = F.greatest(F.lit(1), F.lit(4) - severity_ord(F.col("severity")))
    return findings.select(F.col("path").alias("uri"), F.struct(F.struct((F.col("line") - 1).alias("line"), F.lit(0).alias("character")).alias("start"), F.struct(F.col("line").alias("line"), F.lit(0).alias("character")).alias("end")).alias("range"), level.alias("severity"), F.col("detector_id").alias("code"), "message")


def config_hash(options: Options) -> str:
    """Of everything that changes a result."""
    return hashlib.sha256(json.dumps(asdict(options), sort_keys=True, default=str).encode()).hexdigest()


def refresh(sources: DataFrame, results_path: str, options: Options | None = None) -> DataFrame:
    """Analyses the files that a results table does not have at their present content and configuration, appends them, and returns all current results."""
    options = options or Options()
    spark, key = sources.sparkSession, config_hash(options)
    current = sources.select("path", "content_hash")
    stored = _results(spark, results_path)
    todo = sources
    if stored is not None:
        todo = sources.join(stored.where(F.col("config") == key).select("path", "content_hash").distinct(), ["path", "content_hash"], "left_anti")
    found = analyze(todo, options)
    # A file without findings has one row without rule, so that it counts as done.
    todo.select("path", "content_hash").join(found, "path", "left").withColumn("config", F.lit(key)).write.mode("append").parquet(results_path)
    return _results(spark, results_path).where(F.col("config") == key).join(current, ["path", "content_hash"], "left_semi").where("detector_id is not null").drop("config")


def _results(spark: SparkSession, path: str) -> DataFrame | None:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def validated(findings: DataFrame, expected: DataFrame, tolerance: int = 5) -> DataFrame:
    """Precision, recall and F1 of each rule against ``expected(path, detector_id, exp_id, line_lo, line_hi)``, one finding for one expectation."""
    actual = findings.select("path", "detector_id", "line", F.xxhash64("path", "detector_id", "line").alias("act_id"))
    hits = fd.greedy_matches(expected, actual, ["path", "detector_id"], tolerance)
    predicted = actual.join(hits.select("act_id"), "act_id", "left_semi").select("detector_id", F.lit(True).alias("p"), F.lit(True).alias("a"))
    wrong = actual.join(hits.select("act_id"), "act_id", "left_anti").select("detector_id", F.lit(True).alias("p"), F.lit(False).alias("a"))
    missed = expected.join(hits.select("path", "detector_id", "exp_id"), ["path", "detector_id", "exp_id"], "left_anti").select("detector_id", F.lit(False).alias("p"), F.lit(True).alias("a"))
    return fd.precision_recall(predicted.union(wrong).union(missed), ["detector_id"], "p", "a")
