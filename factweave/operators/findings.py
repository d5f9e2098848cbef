"""What happens to findings: selection, filters, caps, deduplication, scores, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scales import SEVERITIES, confidence_ord, severity_ord


def at_least(findings: DataFrame, severity: str = "Info", confidence: str = "Low") -> DataFrame:
    return findings.where((severity_ord(F.col("severity")) >= SEVERITIES.index(severity)) & (confidence_ord(F.col("confidence")) >= confidence_ord(F.lit(confidence))))


def of_categories(rules: DataFrame, categories: list[str]) -> DataFrame:
    """Rules that share a category with the list; all for an empty list."""
    return rules.where(F.arrays_overlap("categories", F.array(*map(F.lit, categories)))) if categories else rules


def enabled(findings: DataFrame, on: DataFrame | None = None, off: DataFrame | None = None) -> DataFrame:
    """Findings of the rules in ``on(detector_id)``, if given, and not in ``off``."""
    if on is not None:
        findings = findings.join(on, "detector_id", "left_semi")
    return findings if off is None else findings.join(off, "detector_id", "left_anti")


def worst_first(findings: DataFrame, order: list) -> DataFrame:
    """Sorted by severity, the worst first, then by ``order``."""
    return findings.orderBy(severity_ord(F.col("severity")).desc(), *order)


def ranked(findings: DataFrame, keys: list[str], order: list) -> DataFrame:
    """``rank`` of each finding among its keys', by severity, then confidence, the worst first, then by ``order``."""
    by = Window.partitionBy(*keys).orderBy(severity_ord(F.col("severity")).desc(), confidence_ord(F.col("confidence")).desc(), *order)
    return findings.withColumn("rank", F.row_number().over(by))


def capable(rules: DataFrame, available: list[str]) -> DataFrame:
    """Rules all of whose ``requires`` are available; null asks for nothing."""
    return rules.where(F.coalesce(F.size(F.array_except("requires", F.array(*map(F.lit, available)).cast("array<string>"))) == 0, F.lit(True)))


def capped(findings: DataFrame, keys: list[str], order: list, limit: int = 3) -> DataFrame:
    """The first ``limit`` of each group in the given order."""
    return findings.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= limit).drop("_n")


def first_of(findings: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row of each key, the first in a total order (message and place do not matter)."""
    return capped(findings, keys, order, 1)


def first_of_bucket(findings: DataFrame, keys: list[str], line: str, rank: Column, order: list, width: int = 10) -> DataFrame:
    """One row of each key and ``width`` lines: the highest rank, then the first."""
    return first_of(findings.withColumn("_b", F.floor(F.col(line) / width)), [*keys, "_b"], [rank.desc(), *order]).drop("_b")


#: Rules whose id holds one of these words are deduplicated by class and bucket of lines.
MEV_WORDS, VALIDATION_WORDS = ("mev", "sandwich", "front-run"), ("parameter", "validation")


def deduplicated_enhanced(findings: DataFrame, file: str, order: list, width: int = 10) -> DataFrame:
    """First of each rule, file and line; then, of MEV and of validation rules, the most severe of each bucket of lines."""
    rule = F.col("detector_id").cast("string")
    group = F.when(rule.rlike("|".join(MEV_WORDS)), "mev").when(rule.rlike("|".join(VALIDATION_WORDS)), "validation")
    once = first_of(findings, ["detector_id", file, "line"], order).withColumn("_class", group)
    chosen = first_of_bucket(once.where("_class is not null"), [file, "_class"], "line", severity_ord(F.col("severity")), order, width)
    return once.where("_class is null").unionByName(chosen).drop("_class")


def distinct_rules(findings: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, n_detectors, n)``."""
    return findings.groupBy(*keys).agg(F.count_distinct("detector_id").alias("n_detectors"), F.count("*").alias("n"))


def by_origin(findings: DataFrame, dependency: Column) -> DataFrame:
    """``(origin, severity, n)``, findings in dependencies apart from those in the project's own files."""
    return findings.groupBy(F.when(dependency, "dep").otherwise("src").alias("origin"), "severity").agg(F.count("*").alias("n"))


def counts_with_zeros(findings: DataFrame, column: str, domain: DataFrame) -> DataFrame:
    """``domain(column, ...)`` with the number of findings, 0 where there are none."""
    return domain.join(findings.groupBy(column).agg(F.count("*").alias("_c")), column, "left").select(*domain.columns, F.coalesce("_c", F.lit(0)).alias("n"))


def risk_score(findings: DataFrame, keys: list[str]) -> DataFrame:
    """min(10, 5 critical + 3 high + 1.5 medium + 0.5 low) and its band."""
    n = lambda s: F.count_if(F.col("severity") == s)
    scored = findings.groupBy(*keys).agg(F.least(F.lit(10.0), 5.0 * n("Critical") + 3.0 * n("High") + 1.5 * n("Medium") + 0.5 * n("Low")).alias("risk"))
    return scored.withColumn("band", F.when(F.col("risk") == 0, "none").when(F.col("risk") < 3, "low").when(F.col("risk") < 6, "medium").otherwise("high"))


def matched_with_tolerance(expected: DataFrame, actual: DataFrame, keys: list[str], tolerance: int = 5) -> DataFrame:
    """``expected(keys, exp_id, line_lo, line_hi)`` against ``actual(keys, act_id, line)``: pairs within the range widened by the tolerance."""
    near = actual.alias("a").join(expected.alias("e"), [F.col(f"a.{k}") == F.col(f"e.{k}") for k in keys] + [F.col("a.line").between(F.col("e.line_lo") - tolerance, F.col("e.line_hi") + tolerance)])
    return near.select(*(F.col(f"e.{k}").alias(k) for k in keys), "e.exp_id", "a.act_id", "a.line")


def greedy_matches(expected: DataFrame, actual: DataFrame, keys: list[str], tolerance: int = 5) -> DataFrame:
    """``(keys, exp_id, act_id)``: expectations in order, each taking the first actual finding that is still free.

    The order matters, so the few findings of one key are matched together;
    many keys share a task's group.
    """
    import pandas as pd

    schema = ", ".join([*(f"{k} {dict(expected.dtypes)[k]}" for k in keys), "exp_id long, act_id long"])

    def match(e, a):
        out, found = [], {}
        for row in a.sort_values("_act_id").itertuples(index=False, name=None):
            found.setdefault(row[: len(keys)], []).append([row[-2], row[-1], True])
        for x in e.sort_values("exp_id").itertuples():
            key = tuple(getattr(x, k) for k in keys)
            for near in found.get(key, ()):
                if near[2] and x.line_lo - tolerance <= near[0] <= x.line_hi + tolerance:
                    near[2] = False
                    out.append((*key, x.exp_id, near[1]))
                    break
        return pd.DataFrame(out, columns=[*keys, "exp_id", "act_id"])

    share = F.pmod(F.xxhash64(*keys), F.lit(4 * int(expected.sparkSession.conf.get("spark.sql.shuffle.partitions")))).alias("share")
    # Names of its own for one side: both may come from one table.
    actual = actual.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("line").alias("_line"), F.col("act_id").alias("_act_id"))
    other = F.pmod(F.xxhash64(*(f"_{k}" for k in keys)), F.lit(4 * int(expected.sparkSession.conf.get("spark.sql.shuffle.partitions")))).alias("_share")
    return expected.select(*keys, "exp_id", "line_lo", "line_hi").groupBy(share).cogroup(actual.groupBy(other)).applyInPandas(match, schema)


def precision_recall(labelled: DataFrame, keys: list[str], predicted: str, actual: str) -> DataFrame:
    """Counts, precision, recall and F1 of two boolean columns; 0 where undefined."""
    p, a = F.col(predicted), F.col(actual)
    counted = labelled.groupBy(*keys).agg(F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & a).alias("fn"))
    ratio = lambda x, y: F.coalesce(F.try_divide(x, y), F.lit(0.0))
    precision, recall = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counted.select(*keys, "tp", "fp", "fn", F.round(precision, 9).alias("precision"), F.round(recall, 9).alias("recall"), F.round(ratio(2 * precision * recall, precision + recall), 9).alias("f1"))


def exit_code(findings: DataFrame, fail_at: str = "High") -> int:
    """1 if any finding reaches the severity."""
    return int(not at_least(findings, fail_at).isEmpty())


def rolled_up(findings: DataFrame, keys: list[str], line: str, message: str) -> DataFrame:
    """One row of each key: its first line, how many sites, and their messages in line order."""
    sites = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(line, message))), lambda x: x[message]), "; ")
    return findings.groupBy(*keys).agg(F.min(line).alias("line"), F.count("*").alias("sites"), sites.alias("messages"))
