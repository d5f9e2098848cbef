"""Taint by lines: what a line brings in, where it goes and what makes it safe, with the tables that weigh and name it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import contains_any

# Fixed values, in the order in which they are tried: role, literals.
SOURCES = (
    ("MessageSender", ("msg.sender",)), ("TransactionOrigin", ("tx.origin",)), ("MessageData", ("msg.data",)), ("MessageValue", ("msg.value",)), ("BlockTimestamp", ("block.timestamp", "now")),
    ("BlockNumber", ("block.number",)), ("BlockHash", ("blockhash",)), ("ExternalCall", ("call(", "delegatecall(")),
)
SINKS = (("ExternalCall", ("call(", "delegatecall(")), ("SelfDestruct", ("selfdestruct",)), ("EtherTransfer", ("transfer(", "send(")), ("TokenApproval", ("approve(",)))
SANITIZERS = (("RequireStatement", ("require(",)), ("AssertStatement", ("assert(",)), ("RevertStatement", ("revert(",)), ("AccessControl", ("onlyOwner", "onlyAdmin")))
KINDS = {"BlockTimestamp": "TimeDependent", "BlockNumber": "TimeDependent", "BlockHash": "TimeDependent", "ExternalCall": "ExternalCall"}
#: How much taint an operation leaves.
ATTENUATION = (("=", 1.0), ("+", 0.9), ("-", 0.9), ("*", 0.8), ("/", 0.8), ("==", 0.3), ("!=", 0.3), ("&&", 0.5), ("||", 0.5), ("keccak256", 0.1), ("call", 0.7))
SANITIZER_FACTORS = {"RequireStatement": 0.7, "AccessControl": 0.5, "BoundsCheck": 0.8}
VULNERABILITIES = (
    ("UserInput", "ExternalCall", "Unvalidated External Call"), ("UserInput", "StateModification", "Unvalidated State Change"), ("ExternalCall", "StateModification", "External Data State Change"),
    ("TimeDependent", "StateModification", "Time-dependent State Change"), ("UserInput", "EtherTransfer", "Unvalidated Ether Transfer"),
)
OTHERWISE = "Data Flow Vulnerability"


def _first(text: Column, roles) -> Column:
    return F.coalesce(*(F.when(contains_any(text, list(literals)), F.lit(role)) for role, literals in roles))


def roles(lines: DataFrame, table: tuple, text: str = "text") -> DataFrame:
    """Lines that have a role, with ``role``: the first of ``table(role, literals)`` that fits."""
    return lines.withColumn("role", _first(F.col(text), table)).where("role is not null")


def classified(lines: DataFrame, text: str = "text", several: bool = False) -> DataFrame:
    """Lines with ``source``, ``sink`` and ``sanitizer``: the first role that fits or, with ``several``, arrays of all."""
    t = F.col(text)
    if several:
        every = lambda roles: F.filter(F.array(*(F.when(contains_any(t, list(x)), F.lit(role)) for role, x in roles)), lambda r: r.isNotNull())
        return lines.select("*", every(SOURCES).alias("source"), every(SINKS).alias("sink"), every(SANITIZERS).alias("sanitizer"))
    writes = F.when(t.contains("=") & ~t.contains("=="), "StateModification")
    return lines.select("*", _first(t, SOURCES).alias("source"), F.coalesce(_first(t, SINKS), writes).alias("sink"), _first(t, SANITIZERS).alias("sanitizer"))


def kind_of(source: Column) -> Column:
    return F.when(source.isNotNull(), reduce(lambda out, x: F.when(source == x[0], F.lit(x[1])).otherwise(out), KINDS.items(), F.lit("UserInput")))


def attenuations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ATTENUATION), "operation string, factor double")


def remaining(steps: DataFrame, keys: list[str], operation: str) -> DataFrame:
    """What is left along each path: the product of its operations' factors, 1 for unknown ones."""
    table = F.broadcast(attenuations(steps.sparkSession))
    logs = steps.join(table, steps[operation] == table["operation"], "left").groupBy(*keys).agg(F.sum(F.ln(F.coalesce("factor", F.lit(1.0)))).alias("_s"))
    return logs.select(*keys, F.round(F.exp("_s"), 9).alias("remaining"))


def named(flows: DataFrame, kind: str = "kind", sink: str = "sink") -> DataFrame:
    """Flows with the vulnerability and severity of their kind and sink."""
    table = F.broadcast(flows.sparkSession.createDataFrame(list(VULNERABILITIES), "_kind string, _sink string, vulnerability string"))
    joined = flows.join(table, (F.col(kind) == F.col("_kind")) & (F.col(sink) == F.col("_sink")), "left").drop("_kind", "_sink")
    pair = lambda k, s: (F.col(kind) == k) & (F.col(sink) == s)
    severity = F.when(pair("UserInput", "SelfDestruct"), "Critical").when(pair("UserInput", "ExternalCall") | pair("ExternalCall", "StateModification"), "High")
    severity = severity.when(pair("UserInput", "EtherTransfer") | (F.col(kind) == "TimeDependent"), "Medium").otherwise("Low")
    return joined.withColumn("vulnerability", F.coalesce("vulnerability", F.lit(OTHERWISE))).withColumn("severity", severity)
