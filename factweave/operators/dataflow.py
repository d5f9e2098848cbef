"""Data-flow analyses over ``blocks(func, node, defines, uses)`` and ``edges(func, src, dst)``.

Each is solved by function, in one shuffle; the same analyses as rounds over
whole relations (``local=False``) are for graphs that no worker holds, and
for checking one against the other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..plans.fixpoint import closure, least
from .graph import solved_locally


def _flow(blocks: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks and edges of a function in one stream of rows."""
    none = F.lit(None).cast("string")
    kind = dict(edges.dtypes)["src"]
    return blocks.select(*keys, F.col("node").alias("src"), F.lit(None).cast(kind).alias("dst"), F.col("defines").cast("string").alias("defines"), F.col("uses").cast("string").alias("uses")).unionByName(edges.select(*keys, "src", "dst", none.alias("defines"), none.alias("uses")))


def _parts(group) -> tuple[dict, dict, list]:
    """Definition and use of each block, and the edges."""
    own = group[group.dst.isna()]
    named = lambda c: {n: v for n, v in zip(own.src, own[c]) if isinstance(v, str)}
    return named("defines"), named("uses"), list(group.loc[group.dst.notna(), ["src", "dst"]].itertuples(index=False, name=None))


def _spread(start: set, step) -> set:
    known, todo = set(start), list(start)
    while todo:
        for x in step(todo.pop()):
            if x not in known:
                known.add(x)
                todo.append(x)
    return known


def reaching_definitions(blocks: DataFrame, edges: DataFrame, keys: list[str], local: bool = True) -> DataFrame:
    """``(keys, def_node, var, node)``: the definition of var in def_node reaches the entry of node.

    A definition leaves its own block, and any block it reaches that does not
    define the same variable.
    """
    if local:

        def solve(group):
            defines, _, flow = _parts(group)
            succ: dict = {}
            for a, b in flow:
                succ.setdefault(a, []).append(b)
            start = {(d, v, n) for d, v in defines.items() for n in succ.get(d, ())}
            return _spread(start, lambda x: [(x[0], x[1], n) for n in succ.get(x[2], ())] if defines.get(x[2]) != x[1] else [])

        kind = dict(blocks.dtypes)["node"]
        return solved_locally(_flow(blocks, edges, keys), keys, {"def_node": kind, "var": "string", "node": kind}, solve)
    e = edges.select(*keys, F.col("src").alias("node"), F.col("dst").alias("_to"))
    kills = blocks.select(*keys, "node", F.col("defines").alias("_kill"))
    out = blocks.where("defines is not null").select(*keys, F.col("node").alias("def_node"), F.col("defines").alias("var"), "node")
    start = out.join(e, [*keys, "node"]).select(*keys, "def_node", "var", F.col("_to").alias("node"))

    def step(d):
        alive = d.join(kills, [*keys, "node"]).where("_kill is null or _kill <> var")
        return alive.join(e, [*keys, "node"]).select(*keys, "def_node", "var", F.col("_to").alias("node"))

    return closure(start, step)


def live_variables(blocks: DataFrame, edges: DataFrame, keys: list[str], local: bool = True) -> DataFrame:
    """``(keys, node, var)``: var is live at the entry of node; uses come before the block's definition."""
    if local:

        def solve(group):
            defines, uses, flow = _parts(group)
            pred: dict = {}
            for a, b in flow:
                pred.setdefault(b, []).append(a)
            return _spread(set(uses.items()), lambda x: [(p, x[1]) for p in pred.get(x[0], ()) if defines.get(p) != x[1]])

        return solved_locally(_flow(blocks, edges, keys), keys, {"node": dict(blocks.dtypes)["node"], "var": "string"}, solve)
    e = edges.select(*keys, F.col("dst").alias("node"), F.col("src").alias("_from"))
    start = blocks.where("uses is not null").select(*keys, "node", F.col("uses").alias("var"))
    kills = blocks.select(*keys, F.col("node").alias("_from"), F.col("defines").alias("_kill"))
    return closure(start, lambda d: d.join(e, [*keys, "node"]).join(kills, [*keys, "_from"]).where("_kill is null or _kill <> var").select(*keys, F.col("_from").alias("node"), "var"))


def def_use(blocks: DataFrame, reaching: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, def_node, use_node, var)``."""
    uses = blocks.where("uses is not null").select(*keys, "node", F.col("uses").alias("var"))
    return reaching.join(uses, [*keys, "node", "var"]).select(*keys, "def_node", F.col("node").alias("use_node"), "var")


def dead_definitions(blocks: DataFrame, chains: DataFrame, keys: list[str]) -> DataFrame:
    defs = blocks.where("defines is not null").select(*keys, F.col("node").alias("def_node"), F.col("defines").alias("var"))
    return defs.join(chains, [*keys, "def_node", "var"], "left_anti")


def uninitialized_uses(blocks: DataFrame, reaching: DataFrame, keys: list[str]) -> DataFrame:
    """Uses that no definition reaches."""
    uses = blocks.where("uses is not null").select(*keys, "node", F.col("uses").alias("var"))
    return uses.join(reaching, [*keys, "node", "var"], "left_anti")


def multiply_used(chains: DataFrame, keys: list[str]) -> DataFrame:
    return chains.groupBy(*keys, "def_node").agg(F.count("*").alias("n_uses")).where("n_uses > 1")


def multiply_defined(chains: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, use_node, var, n_defs)``: uses that more than one definition reaches."""
    return chains.groupBy(*keys, "use_node", "var").agg(F.count_distinct("def_node").alias("n_defs")).where("n_defs > 1")


def def_use_paths(chains: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, def_node, use_node, hops)``: the least number of chains from a definition over further ones to a use."""
    e = chains.select(*keys, F.col("def_node").alias("use_node"), F.col("use_node").alias("_to")).distinct()
    start = chains.select(*keys, "def_node", "use_node").distinct().select("*", F.lit(1).alias("hops"))
    return least(start, lambda d: d.join(e, [*keys, "use_node"]).select(*keys, "def_node", F.col("_to").alias("use_node"), (F.col("hops") + 1).alias("hops")), [*keys, "def_node", "use_node"], "hops")


def def_use_statistics(blocks: DataFrame, chains: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, n_defs, n_uses, n_chains, n_dead, max_uses)``; keys without blocks have no row."""
    own = blocks.groupBy(*keys).agg(F.count("defines").alias("n_defs"), F.count("uses").alias("n_uses"))
    each = chains.groupBy(*keys, "def_node", "var").agg(F.count("*").alias("_n")).groupBy(*keys).agg(F.sum("_n").alias("n_chains"), F.count("*").alias("_used"), F.max("_n").alias("max_uses"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return own.join(each, keys, "left").select(*keys, "n_defs", "n_uses", zero("n_chains").alias("n_chains"), (F.col("n_defs") - zero("_used")).alias("n_dead"), zero("max_uses").alias("max_uses"))


def interference(live: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of variables that are live at one point."""
    other = live.select(*keys, "node", F.col("var").alias("other"))
    return live.join(other, [*keys, "node"]).where("var < other").select(*keys, "var", "other").distinct()


def register_pressure(live: DataFrame, keys: list[str]) -> DataFrame:
    return live.groupBy(*keys, "node").agg(F.count("*").alias("n_live")).groupBy(*keys).agg(F.max("n_live").alias("pressure"))


def tainted(chains: DataFrame, sources: DataFrame, sanitizers: DataFrame, keys: list[str], factor: float = 0.9) -> DataFrame:
    """``(keys, source, node, hops, confidence)``: taint along def-use edges, stopped by sanitizers, the confidence falling by ``factor`` a hop."""
    e = chains.select(*keys, F.col("def_node").alias("node"), F.col("use_node").alias("_to")).distinct()
    blocked = sanitizers.select(*keys, F.col("node").alias("_to"))
    e = e.join(blocked, [*keys, "_to"], "left_anti")
    start = sources.select(*keys, F.col("node").alias("source"), "node", F.lit(0).alias("hops"))
    found = least(start, lambda d: d.join(e, [*keys, "node"]).select(*keys, "source", F.col("_to").alias("node"), (F.col("hops") + 1).alias("hops")), [*keys, "source", "node"], "hops")
    return found.withColumn("confidence", F.round(F.pow(F.lit(factor), F.col("hops")), 9))


def violations(taint: DataFrame, sinks: DataFrame, keys: list[str]) -> DataFrame:
    """Sinks that taint reaches, with the most confident source."""
    return taint.join(sinks.select(*keys, "node"), [*keys, "node"], "left_semi").groupBy(*keys, F.col("node").alias("sink")).agg(F.max("confidence").alias("confidence"), F.count("*").alias("n_sources"))


def false_positive_likelihood(path_length, factors):
    """0.1, or 0.3 for a path of more than ten steps, times each sanitizer's factor, within 0.01 and 0.9."""
    base = F.lit(0.1) + F.when(path_length > 10, 0.2).otherwise(0.0)
    return F.greatest(F.lit(0.01), F.least(F.lit(0.9), F.aggregate(factors, base, lambda acc, x: acc * x)))


def instruction_mix(instructions: DataFrame, opcodes: list[str], keys: list[str], opcode: str = "opcode") -> DataFrame:
    """How many of each opcode there are, a column each."""
    return instructions.groupBy(*keys).agg(*(F.count_if(F.col(opcode) == o).alias(o) for o in opcodes))


def call_graph(instructions: DataFrame, calls: list[str], keys: list[str]) -> DataFrame:
    """``(keys, callee, n)`` of the instructions whose opcode calls."""
    return instructions.where(F.col("opcode").isin(calls)).groupBy(*keys, "callee").agg(F.count("*").alias("n"))


def visible_symbols(scopes: DataFrame, symbols: DataFrame) -> DataFrame:
    """``(scope_id, name, symbol_id)``: the innermost symbol of each name along ``scopes(scope_id, parent_id)``."""
    up = scopes.select(F.col("scope_id").alias("at"), F.col("parent_id").alias("_up")).where("_up is not null")
    chain = least(scopes.select("scope_id", F.col("scope_id").alias("at"), F.lit(0).alias("depth")), lambda d: d.join(up, "at").select("scope_id", F.col("_up").alias("at"), (F.col("depth") + 1).alias("depth")), ["scope_id", "at"], "depth")
    held = chain.join(symbols.select(F.col("scope_id").alias("at"), "name", "symbol_id"), "at")
    return held.groupBy("scope_id", "name").agg(F.min_by("symbol_id", F.struct("depth", "symbol_id")).alias("symbol_id"))


def resolved_overloads(calls: DataFrame, candidates: DataFrame, converts: DataFrame) -> DataFrame:
    """``calls(call_id, name, arguments)`` and ``candidates(symbol_id, name, parameters)`` -> ``(call_id, symbol_id, cost, ambiguous)``.

    Candidates take as many arguments; an argument of the parameter's type
    costs 0 and one that ``converts(source, target)`` allows costs 1.  The
    cheapest wins; where several cost as much the call is ambiguous and the
    least symbol is named.  Calls that nothing takes are left out.

    Prices depend on types alone, so each list of arguments is priced once
    against each list of parameters of its name; calls and candidates that
    share a name never meet row by row.
    """
    signatures = candidates.groupBy("name", "parameters").agg(F.min("symbol_id").alias("symbol_id"), F.count("*").alias("_n"))
    forms = calls.select("name", "arguments").distinct()
    fit = forms.join(signatures, "name").where("size(arguments) = size(parameters)")
    form = ["name", "arguments"]
    pairs = fit.select(*form, "parameters", "symbol_id", "_n", F.explode_outer(F.arrays_zip("arguments", "parameters")).alias("_p")).withColumns({"source": F.col("_p.arguments"), "target": F.col("_p.parameters")})
    known = converts.select("source", "target", F.lit(1).alias("_one")).distinct()
    cost = F.when(F.col("_p").isNull() | (F.col("source") == F.col("target")), 0).otherwise(F.col("_one"))
    priced = pairs.join(known, ["source", "target"], "left").groupBy(*form, "parameters", "symbol_id", "_n").agg(F.sum(cost).alias("cost"), F.count_if(cost.isNull()).alias("_bad")).where("_bad = 0")
    taken = priced.groupBy(*form, "cost").agg(F.min("symbol_id").alias("symbol_id"), F.sum("_n").alias("_n"))
    # The cheapest of a form; a call id that comes with several forms takes the cheapest of all.
    best = taken.groupBy(*form).agg(F.min_by(F.struct("cost", "symbol_id", "_n"), "cost").alias("_best")).select(*form, "_best.*")
    held = calls.join(best, form).groupBy("call_id", "cost").agg(F.min("symbol_id").alias("symbol_id"), F.sum("_n").alias("_n"))
    return held.groupBy("call_id").agg(F.min_by(F.struct("symbol_id", "cost", (F.col("_n") > 1).alias("ambiguous")), "cost").alias("_best")).select("call_id", "_best.*")
