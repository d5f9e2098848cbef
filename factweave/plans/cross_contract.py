"""Rules over several contracts: who calls whom, and what follows from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import contains_any
from ..operators import findings as fd, graph
from .planner import Facts

# Fixed values.
STANDARD = ("erc20", "erc721", "erc1155", "erc4626", "openzeppelin")
UPGRADEABLE = ("upgradeable", "proxy", "delegatecall", "implementation")
PRIVILEGED = ("onlyowner", "selfdestruct", "delegatecall", "mint(", "burn(", "upgradeto", "setowner")
SYNCHRONISED = ("event", "emit", "callback", "sync", "notify", "update")
MANY_STATEMENTS, LEAST_TRUST, MAX_HOPS = 20, 0.3, 3


def interactions(facts: Facts) -> DataFrame:
    """``(src, dst, function, line)``: a call through a state variable, parameter or cast whose type is a known contract."""
    names = facts.contracts.select(F.col("contract").alias("dst")).distinct()
    typed = facts.state.join(names, F.col("type") == F.col("dst")).select("file_id", "contract_ord", F.col("name").alias("receiver"), "dst")
    called = facts.statements.select("file_id", "contract_ord", "contract", "function", "line", F.explode(F.regexp_extract_all("text", F.lit(r"\b(\w+)(?:\([^()]*\))?\.\w+\s*[({]"), F.lit(1))).alias("receiver"))
    through = called.join(typed, ["file_id", "contract_ord", "receiver"]).select(F.col("contract").alias("src"), "dst", "function", "line")
    cast = called.join(names, F.col("receiver") == F.col("dst")).select(F.col("contract").alias("src"), "dst", "function", "line")
    return through.union(cast).where("src <> dst").distinct()


def trust(facts: Facts) -> DataFrame:
    """``(contract, trust)``."""
    low = F.lower("text")
    size = facts.statements.groupBy("file_id", "contract_ord").agg(F.count("*").alias("n"))
    found = facts.contracts.join(size, ["file_id", "contract_ord"], "left")
    return found.select("contract", graph.trust_score(contains_any(low, list(STANDARD)), F.coalesce("n", F.lit(0)) > MANY_STATEMENTS, contains_any(low, list(UPGRADEABLE))).alias("trust"), contains_any(low, list(PRIVILEGED)).alias("privileged"), contains_any(low, list(SYNCHRONISED)).alias("synchronised"))


def findings(facts: Facts, max_cycle: int = 6) -> DataFrame:
    """``(detector_id, severity, contract, message)`` of the five rules, worst first, then by rule, contract and message."""
    calls = interactions(facts)
    edges = calls.select("src", "dst").distinct()
    row = lambda df, name, severity, contract, message: df.select(F.lit(name).alias("detector_id"), F.lit(severity).alias("severity"), contract.alias("contract"), message.alias("message"))
    cycles = graph.simple_cycles(edges, max_cycle)
    path = F.array_join("path", " > ")
    # Rings of more contracts than are enumerated: a component with a contract that lies on none of the cycles.
    rings = graph.strongly_connected(edges, [])
    named = cycles.select(F.explode("path").alias("node")).distinct()
    wide = rings.join(rings.join(named, "node", "left_anti").select("scc").distinct(), "scc", "left_semi").groupBy("scc").agg(F.array_sort(F.collect_set("node")).alias("path"))
    t = trust(facts)
    weak = edges.join(t.where(F.col("trust") < LEAST_TRUST).select(F.col("contract").alias("dst")), "dst").join(t.where("privileged").select(F.col("contract").alias("src")), "src")
    names = facts.state.select(F.col("contract").alias("owner"), "name")
    shared = graph.shared_names(names, t.where("not synchronised").select(F.col("contract").alias("owner")))
    several = calls.groupBy("src", "function").agg(F.count_distinct("dst").alias("n"), F.array_join(F.array_sort(F.collect_set("dst")), ", ").alias("all")).where("n > 1")
    found = [
        row(cycles, "circular-dependency", "High", F.col("path")[0], path),
        row(wide, "circular-dependency", "High", F.col("path")[0], F.array_join("path", ", ")),
        row(weak, "trust-boundary-violation", "High", F.col("src"), F.col("dst")),
        row(shared, "state-inconsistency", "Medium", F.col("a"), F.concat_ws(": ", "b", "name")),
        row(several, "atomicity-violation", "High", F.col("src"), F.concat_ws(": ", "function", "all")),
        row(cycles.where(F.col("length") <= MAX_HOPS), "cross-contract-reentrancy", "Critical", F.col("path")[0], path),
    ]
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return fd.worst_first(out.distinct(), ["detector_id", "contract", "message"])
