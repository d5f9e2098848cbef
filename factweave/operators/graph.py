"""Graph relations over ``edges(func, src, dst)``; func is any list of keys, and none for whole-program graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..plans.fixpoint import closure, least


def reachable(edges: DataFrame, start: DataFrame, keys: list[str], node: str = "node", local: bool | None = None) -> DataFrame:
    """``(keys, node)`` reached from the start nodes, those included; by function where there are keys, else by rounds over the whole graph."""
    if bool(keys) if local is None else local:
        return solved_locally(_with_entries(edges, start, keys, node), keys, {node: dict(edges.dtypes)["src"]}, lambda group: [(n,) for n in _flood(*_successors(group))])
    e = edges.select(*keys, F.col("src").alias(node), F.col("dst").alias("_to"))
    return closure(start.select(*keys, node), lambda d: d.join(e, [*keys, node]).select(*keys, F.col("_to").alias(node)))


def reach_pairs(edges: DataFrame, keys: list[str], local: bool | None = None) -> DataFrame:
    """``(keys, src, dst)`` with a path of at least one edge."""
    if bool(keys) if local is None else local:
        kind = dict(edges.dtypes)["src"]

        def solve(group):
            _, succ = _successors(group)
            return [(s, d) for s in succ for d in _flood(succ[s], succ)]

        return solved_locally(edges.select(*keys, "src", "dst"), keys, {"src": kind, "dst": kind}, solve)
    e = edges.select(*keys, F.col("src").alias("dst"), F.col("dst").alias("_to"))
    return closure(edges.select(*keys, "src", "dst"), lambda d: d.join(e, [*keys, "dst"]).select(*keys, "src", F.col("_to").alias("dst")))


def unreachable(nodes: DataFrame, edges: DataFrame, start: DataFrame, keys: list[str]) -> DataFrame:
    return nodes.select(*keys, "node").join(reachable(edges, start, keys), [*keys, "node"], "left_anti")


def degrees(nodes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    out = edges.groupBy(*keys, F.col("src").alias("node")).agg(F.count("*").alias("out_degree"))
    into = edges.groupBy(*keys, F.col("dst").alias("node")).agg(F.count("*").alias("in_degree"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return nodes.join(out, [*keys, "node"], "left").join(into, [*keys, "node"], "left").select(*keys, "node", zero("in_degree"), zero("out_degree"))


def metrics(nodes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """Nodes, edges, cyclomatic number max(0, E - N + 2), decision points and estimated paths 2 ** decisions."""
    d = degrees(nodes, edges, keys).groupBy(*keys).agg(F.count("*").alias("n_nodes"), F.sum("out_degree").alias("n_edges"), F.count_if(F.col("out_degree") > 1).alias("decisions"))
    return d.select("*", F.greatest(F.lit(0), F.col("n_edges") - F.col("n_nodes") + 2).alias("cyclomatic"), F.pow(F.lit(2.0), F.col("decisions")).alias("paths"))


def mergeable(nodes: DataFrame, edges: DataFrame, entry: DataFrame, keys: list[str]) -> DataFrame:
    """Nodes, not entries, whose one predecessor has no other successor, with at most one successor."""
    d = degrees(nodes, edges, keys)
    only = edges.join(d.where("in_degree = 1 and out_degree <= 1").select(*keys, F.col("node").alias("dst")), [*keys, "dst"]).join(d.where("out_degree = 1").select(*keys, F.col("node").alias("src")), [*keys, "src"])
    return only.select(*keys, F.col("dst").alias("node")).join(entry.select(*keys, "node"), [*keys, "node"], "left_anti")


def solved_locally(rows: DataFrame, keys: list[str], columns: dict[str, str], solve) -> DataFrame:
    """Runs ``solve(group)`` on every function's rows; it yields tuples of the columns.

    Functions are small, so a whole-graph analysis runs where their rows meet,
    in one shuffle; many functions share a task's group.
    """
    import pandas as pd

    types = dict(rows.dtypes)
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), *(f"{c} {t}" for c, t in columns.items())])

    def each(pdf):
        out = [(*(None if k is None or k != k else k for k in key), *row) for key, group in pdf.groupby(keys, sort=False, dropna=False) for row in solve(group)]
        return pd.DataFrame(out, columns=[*keys, *columns], dtype=object)

    share = F.pmod(F.xxhash64(*keys), F.lit(4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))).alias("share")
    return rows.groupBy(share).applyInPandas(each, schema)


def _successors(group) -> tuple[set, dict]:
    """Start nodes (rows without source) and successor sets."""
    start = set(group.dst[group.src.isna()])
    succ: dict = {}
    for s, d in group.loc[group.src.notna(), ["src", "dst"]].itertuples(index=False, name=None):
        succ.setdefault(s, set()).add(d)
    return start, succ


def _with_entries(edges: DataFrame, entry: DataFrame, keys: list[str], node: str = "node") -> DataFrame:
    kind = dict(edges.dtypes)["src"]
    return edges.select(*keys, "src", "dst").unionByName(entry.select(*keys, F.lit(None).cast(kind).alias("src"), F.col(node).alias("dst")))


def _local(columns: str):
    def wrap(solve):
        def run(nodes: DataFrame, edges: DataFrame, entry: DataFrame, keys: list[str]) -> DataFrame:
            kind = dict(nodes.dtypes)["node"]
            return solved_locally(_with_entries(edges, entry, keys), keys, {c: kind for c in columns.split()}, lambda group: solve(*_successors(group)))

        run.__doc__ = solve.__doc__
        return run

    return wrap


def _flood(start, succ: dict) -> set:
    seen, todo = set(start), list(start)
    while todo:
        for n in succ.get(todo.pop(), ()):
            if n not in seen:
                seen.add(n)
                todo.append(n)
    return seen


def _postorder(start: set, succ: dict) -> list:
    """Nodes by depth-first search from the start nodes, those that end first first."""
    out, seen = [], set()
    for root in start:
        if root in seen:
            continue
        seen.add(root)
        todo = [(root, iter(succ.get(root, ())))]
        while todo:
            node, rest = todo[-1]
            for n in rest:
                if n not in seen:
                    seen.add(n)
                    todo.append((n, iter(succ.get(n, ()))))
                    break
            else:
                todo.pop()
                out.append(node)
    return out


def _immediate(start: set, succ: dict) -> dict:
    """Immediate dominator of each reached node, None for those without one: nodes meet along the tree so far, in reverse postorder."""
    order = _postorder(start, succ)
    number = {n: i for i, n in enumerate(order)}
    pred: dict = {}
    for s in order:
        for d in succ.get(s, ()):
            pred.setdefault(d, []).append(s)
    root = len(order)  # stands before every start node
    above = {n: root for n in start}

    def meet(a, b):
        while a != b:
            while a < b:
                a = above[order[a]]
            while b < a:
                b = above[order[b]]
        return a

    changed = True
    while changed:
        changed = False
        for n in reversed(order):
            if n in start:
                continue
            new = None
            for p in pred[n]:
                if p in above:
                    new = number[p] if new is None else meet(new, number[p])
            if above.get(n) != new:
                above[n], changed = new, True
    return {n: None if above[n] == root else order[above[n]] for n in order}


def _dominator_sets(start: set, succ: dict) -> dict:
    up = _immediate(start, succ)
    dom: dict = {}
    for n in up:
        path = []
        while n is not None and n not in dom:
            path.append(n)
            n = up[n]
        held = dom[n] if n is not None else frozenset()
        for x in reversed(path):
            held = dom[x] = held | {x}
    return dom


@_local("dominator node")
def dominators(start, succ):
    """``(keys, dominator, node)``, nodes dominating themselves; only what the entry reaches."""
    return [(d, n) for n, ds in _dominator_sets(start, succ).items() for d in ds]


@_local("idom node")
def immediate_dominators(start, succ):
    """``(keys, idom, node)``: the deepest strict dominator."""
    return [(d, n) for n, d in _immediate(start, succ).items() if d is not None]


@_local("node frontier")
def dominance_frontier(start, succ):
    """``(keys, node, frontier)``: nodes where the node's dominance ends."""
    dom = _dominator_sets(start, succ)
    return sorted({(d, n) for p in dom for n in succ.get(p, ()) for d in dom[p] if d not in dom[n] - {n}}, key=str)


@_local("src dst")
def back_edges(start, succ):
    """Edges whose target dominates their source."""
    dom = _dominator_sets(start, succ)
    return [(s, d) for s in dom for d in succ.get(s, ()) if d in dom[s]]


@_local("header node")
def natural_loops(start, succ):
    """``(keys, header, node)``: what reaches a back edge's source without passing its header."""
    dom = _dominator_sets(start, succ)
    pred: dict = {}
    for s in dom:
        for d in succ.get(s, ()):
            pred.setdefault(d, set()).add(s)
    out = set()
    for s in dom:
        for h in succ.get(s, ()):
            if h in dom[s]:
                body, todo = {h, s}, [s] if s != h else []
                while todo:
                    for p in pred.get(todo.pop(), ()):
                        if p not in body:
                            body.add(p)
                            todo.append(p)
                out |= {(h, n) for n in body}
    return sorted(out, key=str)


def post_dominators(nodes: DataFrame, edges: DataFrame, exits: DataFrame, keys: list[str]) -> DataFrame:
    """Dominators of the reversed graph."""
    return dominators(nodes, edges.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst")), exits, keys)


def control_dependence(nodes: DataFrame, edges: DataFrame, exits: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, node, on)``: a branch in ``on`` decides whether ``node`` runs; the dominance frontier of the reversed graph."""
    back = edges.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst"))
    return dominance_frontier(nodes, back, exits, keys).withColumnRenamed("frontier", "on")


@_local("reducible")
def _reducible(start, succ):
    dom = _dominator_sets(start, succ)
    forward = {s: [d for d in succ.get(s, ()) if d not in dom[s]] for s in dom}
    place = {n: i for i, n in enumerate(_postorder(start, forward))}
    return [("yes" if all(place[s] > place[d] for s in dom for d in forward[s]) else "no",)]


def reducible(nodes: DataFrame, edges: DataFrame, entry: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, reducible)``: whether what is left without the back edges has no cycle."""
    return _reducible(nodes.withColumn("node", F.col("node").cast("string")), edges, entry, keys).withColumn("reducible", F.col("reducible") == "yes")


def dominator_statistics(idoms: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, n_dominated, height, max_children)`` of the dominator tree; ``idoms(keys, idom, node)``."""

    def solve(group):
        up = dict(zip(group.dst, group.src))
        depth: dict = {}
        for n in up:
            path = []
            while n in up and n not in depth:
                path.append(n)
                n = up[n]
            for x in reversed(path):
                depth[x] = depth.get(up[x], 0) + 1
        return [(len(up), max(depth.values(), default=0), int(group.src.value_counts().max()))]

    tree = idoms.select(*keys, F.col("idom").alias("src"), F.col("node").alias("dst"))
    return solved_locally(tree, keys, {"n_dominated": "long", "height": "long", "max_children": "long"}, solve)


def loop_depth(loops: DataFrame, keys: list[str]) -> DataFrame:
    """In how many loops each node lies."""
    return loops.groupBy(*keys, "node").agg(F.count_distinct("header").alias("depth"))


def trimmed(edges: DataFrame, keys: list[str], max_rounds: int = 10_000) -> DataFrame:
    """The edges between nodes that have an edge in and an edge out, again and again: what lies on a cycle or between two."""
    from ..plans.fixpoint import deleted, written

    held = written(edges.select(*keys, "src", "dst").distinct())
    n = held.count()
    for _ in range(max_rounds):
        out = held.select(*keys, F.col("src").alias("dst")).distinct()
        into = held.select(*keys, F.col("dst").alias("src")).distinct()
        before, held = held, written(held.join(out, [*keys, "dst"], "left_semi").join(into, [*keys, "src"], "left_semi").select(*keys, "src", "dst"))
        deleted(before)
        left = held.count()
        if left == n:
            return held
        n = left
    raise RuntimeError("no fixpoint within the allowed rounds")


def strongly_connected(edges: DataFrame, keys: list[str], local: bool | None = None) -> DataFrame:
    """``(keys, node, scc)``: the least node of those that reach each other; nodes on no cycle are left out.

    By function where there are keys; a whole graph by trimming and colouring:
    every node takes the least node that reaches it as its colour, and the
    nodes of a colour that reach its namesake back are its component.  Those
    go, and rounds follow for the rest.  No pairs of nodes are formed.
    """
    if bool(keys) if local is None else local:
        kind = dict(edges.dtypes)["src"]

        def solve(group):
            _, succ = _successors(group)
            reach = {n: _flood(succ[n], succ) for n in succ}
            return [(n, min(m for m in reach[n] if n in reach.get(m, ()))) for n in reach if n in reach[n]]

        return solved_locally(edges.select(*keys, "src", "dst"), keys, {"node": kind, "scc": kind}, solve)
    from ..plans.fixpoint import deleted, written

    rest, out = trimmed(edges, keys), None
    while not rest.isEmpty():
        nodes = rest.select(*keys, F.col("src").alias("node")).union(rest.select(*keys, F.col("dst").alias("node"))).distinct()
        along = rest.select(*keys, F.col("src").alias("node"), F.col("dst").alias("_to"))
        colour = least(nodes.select("*", F.col("node").alias("scc")), lambda d: d.join(along, [*keys, "node"]).select(*keys, F.col("_to").alias("node"), "scc"), [*keys, "node"], "scc")  # noqa: B023
        # Back along edges within one colour, from its namesake.
        same = rest.join(colour.withColumnRenamed("node", "src"), [*keys, "src"]).join(colour.select(*keys, F.col("node").alias("dst"), F.col("scc").alias("_scc")), [*keys, "dst"]).where("scc = _scc")
        back = written(same.select(*keys, "scc", F.col("dst").alias("node"), F.col("src").alias("_to")))
        found = closure(colour.where("node = scc").select(*keys, "scc", "node"), lambda d: d.join(back, [*keys, "scc", "node"]).select(*keys, "scc", F.col("_to").alias("node")))  # noqa: B023
        found = written(found.select(*keys, "node", "scc"))
        out = found if out is None else out.union(found)
        gone = found.select(*keys, "node")
        left = rest.join(gone.withColumnRenamed("node", "src"), [*keys, "src"], "left_anti").join(gone.withColumnRenamed("node", "dst"), [*keys, "dst"], "left_anti")
        before, rest = rest, trimmed(left.select(*keys, "src", "dst"), keys)
        deleted(before, back)
    if out is None:
        return rest.select(*keys, F.col("src").alias("node"), F.col("dst").alias("scc"))
    # A component of one node is on a cycle only by an edge to itself.
    several = out.groupBy(*keys, "scc").agg(F.count("*").alias("_n")).where("_n > 1").select(*keys, "scc")
    alone = edges.where("src = dst").select(*keys, F.col("src").alias("scc")).distinct()
    return out.join(several.union(alone).distinct(), [*keys, "scc"], "left_semi").select(*keys, "node", "scc")


def shortest_paths(edges: DataFrame, start: DataFrame, keys: list[str], node: str = "node") -> DataFrame:
    """``(keys, node, hops)`` from the nearest start node."""
    e = edges.select(*keys, F.col("src").alias(node), F.col("dst").alias("_to"))
    return least(start.select(*keys, node, F.lit(0).alias("hops")), lambda d: d.join(e, [*keys, node]).select(*keys, F.col("_to").alias(node), (F.col("hops") + 1).alias("hops")), [*keys, node], "hops")


def topological_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node, level)``: the longest chain of dependencies below a node; nodes on or behind a cycle have none.

    Kahn's rounds: each settles the nodes all of whose dependencies are settled.
    """
    from ..plans.fixpoint import written

    open_ = written(nodes.select("node").distinct())
    edges = written(edges.select("src", "dst").where("src <> dst").distinct().union(edges.select("src", "dst").where("src = dst").distinct()))
    out, level = None, 0
    while True:
        blocked = edges.join(open_.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node")).distinct()
        ready = written(open_.join(blocked, "node", "left_anti").select("node", F.lit(level).alias("level")))
        if ready.isEmpty():
            return ready if out is None else out
        out = ready if out is None else out.union(ready)
        open_, level = written(open_.join(ready, "node", "left_anti")), level + 1


def simple_cycles(edges: DataFrame, max_length: int) -> DataFrame:
    """``(path, length)`` of simple cycles of up to ``max_length`` nodes, each once, written from its least node.

    Paths only grow through nodes above their first, so each cycle is found in
    one rotation and nothing is enumerated twice.
    """
    e = edges.select(F.col("src").alias("_last"), F.col("dst").alias("_to")).where("_last <> _to").distinct()
    paths = e.where("_to > _last").select(F.array("_last", "_to").alias("path"), F.col("_to").alias("_last"))
    out = None
    for length in range(2, max_length + 1):
        grown = paths.join(e, "_last")
        closed = grown.where(F.col("_to") == F.col("path")[0]).select("path", F.lit(length).alias("length"))
        out = closed if out is None else out.union(closed)
        paths = grown.where((F.col("_to") > F.col("path")[0]) & ~F.array_contains("path", F.col("_to"))).select(F.array_append("path", F.col("_to")).alias("path"), F.col("_to").alias("_last"))
    return out


def interaction_metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes, edges, density and average degree of a directed graph."""
    n, e = nodes.agg(F.count("*").alias("n_nodes")), edges.agg(F.count("*").alias("n_edges"))
    density = F.coalesce(F.try_divide(F.col("n_edges"), F.col("n_nodes") * (F.col("n_nodes") - 1)), F.lit(0.0))
    return n.join(e, F.lit(True)).select("n_nodes", "n_edges", F.round(density, 9).alias("density"), F.round(F.coalesce(F.try_divide(2 * F.col("n_edges"), F.col("n_nodes")), F.lit(0.0)), 9).alias("avg_degree"))


def shared_names(held: DataFrame, quiet: DataFrame) -> DataFrame:
    """``held(owner, name)`` -> ``(a, b, name)`` with a before b, both holding the name; only pairs whose a is in ``quiet(owner)``."""
    first = held.join(quiet.select("owner").distinct(), "owner", "left_semi").select(F.col("owner").alias("a"), "name").distinct()
    return first.join(held.select(F.col("owner").alias("b"), "name").distinct(), "name").where("a < b").select("a", "b", "name")


def trust_score(standard, complex_, upgradeable):
    """0.5, with 0.2 more for a standard interface, 0.3 less for complex state and 0.1 less for an upgradeable contract, within 0 and 1."""
    score = F.lit(0.5) + F.when(standard, 0.2).otherwise(0.0) - F.when(complex_, 0.3).otherwise(0.0) - F.when(upgradeable, 0.1).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 6)


def ancestors(inherits: DataFrame) -> DataFrame:
    """``(child, ancestor, depth)``: the shortest way up to every ancestor."""
    e = inherits.select(F.col("child").alias("ancestor"), F.col("parent").alias("_up"))
    first = inherits.select("child", F.col("parent").alias("ancestor"), F.lit(1).alias("depth"))
    return least(first, lambda d: d.join(e, "ancestor").select("child", F.col("_up").alias("ancestor"), (F.col("depth") + 1).alias("depth")), ["child", "ancestor"], "depth")


def lowest_common_ancestor(up: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs(a, b)`` with their common ancestor of least summed depth (then least id); pairs without one are left out."""
    a, b = (up.select(F.col("child").alias(x), "ancestor", F.col("depth").alias(f"d{x}")) for x in "ab")
    both = pairs.join(a, "a").join(b, ["b", "ancestor"])
    best = Window.partitionBy("a", "b").orderBy(F.col("da") + F.col("db"), "ancestor")
    return both.withColumn("_n", F.row_number().over(best)).where("_n = 1").select("a", "b", F.col("ancestor").alias("lca"))


def linearized(up: DataFrame) -> DataFrame:
    """``(child, chain)``: the contract itself, then its ancestors by name."""
    return up.groupBy("child").agg(F.concat(F.array("child"), F.array_sort(F.collect_set("ancestor"))).alias("chain"))


def invalidated(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """Changed files and all that depend on them: reachability against the direction of import."""
    return reachable(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), changed, [])


def descendants(up: DataFrame) -> DataFrame:
    """``(parent, n_descendants, depth)``: how many inherit from it, and over how many steps at most; ``up`` as ``ancestors`` returns it."""
    return up.where("child <> ancestor").groupBy(F.col("ancestor").alias("parent")).agg(F.count("*").alias("n_descendants"), F.max("depth").alias("depth"))


def inheritance_cycles(inherits: DataFrame) -> DataFrame:
    """Contracts that inherit from themselves over any number of steps."""
    return strongly_connected(inherits.select(F.col("child").alias("src"), F.col("parent").alias("dst")), []).select(F.col("node").alias("child"))


def inheritance_statistics(inherits: DataFrame, up: DataFrame) -> DataFrame:
    """One row: contracts, edges, roots, leaves and the deepest chain."""
    nodes = inherits.select("child").union(inherits.select("parent")).distinct()
    roots = nodes.join(inherits.select("child"), "child", "left_anti")
    leaves = nodes.join(inherits.select(F.col("parent").alias("child")), "child", "left_anti")
    counts = [nodes.agg(F.count("*").alias("n_contracts")), inherits.agg(F.count("*").alias("n_edges")), roots.agg(F.count("*").alias("n_roots")), leaves.agg(F.count("*").alias("n_leaves")), up.agg(F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth"))]
    out = counts[0]
    for c in counts[1:]:
        out = out.join(c, F.lit(True))  # one row each
    return out


def diameter(edges: DataFrame) -> DataFrame:
    """The longest of the shortest paths between two nodes, 0 without any; all pairs, so for graphs of contracts, not of functions."""
    e = edges.select(F.col("src").alias("node"), F.col("dst").alias("_to")).distinct()
    start = e.select(F.col("node").alias("origin"), F.col("_to").alias("node")).select("*", F.lit(1).alias("hops"))
    hops = least(start, lambda d: d.join(e, "node").select("origin", F.col("_to").alias("node"), (F.col("hops") + 1).alias("hops")), ["origin", "node"], "hops")
    return hops.where("origin <> node").agg(F.coalesce(F.max("hops"), F.lit(0)).alias("diameter"))


def reanalysis_queue(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """``(node, hops, place)``: changed files first, then what depends on them, the nearest first; ties by node."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    near = shortest_paths(back, changed, [])
    # Places run on over levels: counts of the levels before, and a number within each.
    levels = near.groupBy("hops").agg(F.count("*").alias("_n"))
    before = levels.alias("a").join(levels.alias("b"), F.expr("b.hops < a.hops"), "left").groupBy("a.hops").agg(F.coalesce(F.sum("b._n"), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("hops").orderBy("node"))
    return near.join(before, "hops").select("node", "hops", (F.col("_before") + within).alias("place"))
