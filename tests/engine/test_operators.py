"""Graph, data-flow and report operators on small fixtures: the cases that the test tables do not have."""

import random

import pytest
from pyspark.sql import functions as F

from factweave.operators import dataflow, findings as fd, fixes, graph, spans
from factweave.plans import cross_contract, fixpoint, report
from factweave.plans.planner import Facts, Options, analyze
from factweave.sources import parser, scan


def components(edges):
    reach = {a: set() for e in edges for a in e}
    for a, b in edges:
        reach[a].add(b)
    for k in reach:
        for a in reach:
            if k in reach[a]:
                reach[a] |= reach[k]
    return {(n, min(m for m in reach[n] if n in reach[m])) for n in reach if n in reach[n]}


def test_components_without_pairs_equal_brute_force(spark):
    rng = random.Random(4)
    edges = {(rng.randrange(40), rng.randrange(40)) for _ in range(48)} | {(50, 51), (51, 52), (52, 50), (52, 53), (60, 60), (70, 71)}
    e = spark.createDataFrame(sorted(edges), "src long, dst long")
    assert {tuple(r) for r in graph.strongly_connected(e, []).collect()} == components(edges)
    keyed = e.withColumn("func", F.lit(1))
    assert {(r.node, r.scc) for r in graph.strongly_connected(keyed, ["func"]).collect()} == components(edges)
    assert {(r.node, r.scc) for r in graph.strongly_connected(keyed, ["func"], local=False).collect()} == components(edges)
    assert graph.strongly_connected(e.limit(0), []).count() == 0


def test_closures_are_compacted(spark, monkeypatch):
    monkeypatch.setattr(fixpoint, "COMPACT", 3)
    chain = spark.createDataFrame([(i, i + 1) for i in range(20)], "src long, dst long")
    got = graph.reach_pairs(chain, [])
    assert got.count() == 210 and len(got.inputFiles()) <= 4 * 8


def test_functions_without_a_key_are_analysed(spark):
    e = spark.createDataFrame([(None, 0, 1), (None, 1, 2), (7, 0, 3)], "func long, src long, dst long")
    entry = spark.createDataFrame([(None, 0), (7, 0)], "func long, node long")
    assert {tuple(r) for r in graph.reachable(e, entry, ["func"]).collect()} == {(None, 0), (None, 1), (None, 2), (7, 0), (7, 3)}


def test_dominators_of_a_long_function(spark):
    n = 1500
    e = spark.createDataFrame([(1, i, i + 1) for i in range(n)] + [(1, n, 0)], "func long, src long, dst long")
    nodes, entry = spark.range(n + 1).select(F.lit(1).cast("long").alias("func"), F.col("id").alias("node")), spark.createDataFrame([(1, 0)], "func long, node long")
    idoms = graph.immediate_dominators(nodes, e, entry, ["func"])
    assert {(r.idom, r.node) for r in idoms.collect()} == {(i, i + 1) for i in range(n)}
    assert tuple(graph.dominator_statistics(idoms, ["func"]).first()) == (1, n, n, 1)


def test_control_dependence_and_reducibility(spark):
    nodes = spark.createDataFrame([(f, i) for f in (1, 2) for i in range(5)], "func long, node long")
    e = [(1, 0, 1), (1, 0, 2), (1, 1, 3), (1, 2, 3), (1, 3, 4), (2, 0, 1), (2, 0, 2), (2, 1, 2), (2, 2, 1), (2, 2, 3)]
    edges, entry = spark.createDataFrame(e, "func long, src long, dst long"), nodes.where("node = 0")
    exits = spark.createDataFrame([(1, 4), (2, 3)], "func long, node long")
    on = {(r.func, r.node, r["on"]) for r in graph.control_dependence(nodes, edges, exits, ["func"]).collect()}
    assert {x for x in on if x[0] == 1} == {(1, 1, 0), (1, 2, 0)} and (2, 1, 0) in on and (2, 1, 2) in on
    assert {tuple(r) for r in graph.reducible(nodes, edges, entry, ["func"]).collect()} == {(1, True), (2, False)}


def test_inheritance_cycles_and_queue(spark):
    inherits = spark.createDataFrame([("A", "B"), ("B", "C"), ("C", "A"), ("D", "A")], "child string, parent string")
    assert {r.child for r in graph.inheritance_cycles(inherits).collect()} == {"A", "B", "C"}
    imports = spark.createDataFrame([(2, 1), (3, 2), (4, 1), (9, 8)], "src long, dst long")
    got = {tuple(r) for r in graph.reanalysis_queue(imports, spark.createDataFrame([(1,)], "node long")).collect()}
    assert got == {(1, 0, 1), (2, 1, 2), (4, 1, 3), (3, 2, 4)}
    assert graph.diameter(imports).first()[0] == 2 and graph.diameter(imports.limit(0)).first()[0] == 0


def test_overloads(spark):
    calls = spark.createDataFrame([(1, "f", ["a", "b"]), (2, "f", ["b"]), (3, "f", []), (4, "g", ["a"]), (5, "f", ["c"])], "call_id long, name string, arguments array<string>")
    candidates = spark.createDataFrame([(10, "f", ["a", "b"]), (11, "f", ["b", "b"]), (12, "f", ["c"]), (13, "f", ["d"]), (14, "f", [])], "symbol_id long, name string, parameters array<string>")
    converts = spark.createDataFrame([("a", "b"), ("b", "c"), ("b", "d")], "source string, target string")
    got = {tuple(r) for r in dataflow.resolved_overloads(calls, candidates, converts).collect()}
    assert got == {(1, 10, 0, False), (2, 12, 1, True), (3, 14, 0, False), (5, 12, 0, False)}


def test_overloads_are_priced_by_signature(spark):
    """Calls and candidates that share a name and types are one row each; a null argument is taken by nothing, a candidate named twice is ambiguous."""
    calls = spark.createDataFrame([(i, "f", ["a", "b"] if i % 2 else ["b", "b"]) for i in range(40)] + [(40, "f", [None, "b"]), (41, "g", ["a"])], "call_id long, name string, arguments array<string>")
    candidates = spark.createDataFrame([(100 + i, "f", ["b", "b"]) for i in range(30)] + [(99, "f", ["a", "c"]), (200, "g", ["a"]), (200, "g", ["a"])], "symbol_id long, name string, parameters array<string>")
    converts = spark.createDataFrame([("a", "b"), ("b", "c")], "source string, target string")
    got = {tuple(r) for r in dataflow.resolved_overloads(calls, candidates, converts).collect()}
    assert got == {(i, 99 if i % 2 else 100, i % 2, True) for i in range(40)} | {(41, 200, 0, True)}


def test_binned_range_join_equals_the_plain_one(spark):
    points = spark.createDataFrame([(i % 3, i * 7 % 50) for i in range(60)], "k long, at long").distinct()
    held = spark.createDataFrame([(i, i % 3, i * 5 % 45, i * 5 % 45 + i % 13) for i in range(40)], "id long, k long, first long, last long")
    plain, binned = (spans.enclosing(points, held, "k", "at", "first", "last", ["first", "id"], width) for width in (None, F.lit(4)))
    rows = {tuple(r) for r in plain.collect()}
    assert rows and rows == {tuple(r) for r in binned.select(plain.columns).collect()}


def test_positions_and_capabilities(spark):
    lines = spark.createDataFrame([(1, 1, "ab xab"), (1, 2, None), (1, 3, "ababab"), (2, 1, "")], "file long, line_no long, text string")
    assert {tuple(r) for r in spans.positions(lines, "file", "line_no", "text", "ab").collect()} == {(1, 1, 1, 2), (1, 1, 5, 2), (1, 3, 1, 2), (1, 3, 3, 2), (1, 3, 5, 2)}
    rules = spark.createDataFrame([("a", ["x"]), ("b", ["x", "y"]), ("c", []), ("d", None)], "id string, requires array<string>")
    assert {r.id for r in fd.capable(rules, ["x"]).collect()} == {"a", "c", "d"}


def as_sources(spark, *files):
    return scan.as_sources(spark.createDataFrame([(f"{n}.sol", t) for n, t in files], "path string, content string"))


def test_rings_of_many_contracts(spark):
    n = 8
    facts = Facts(as_sources(spark, *((f"c{i}", f"contract C{i} {{ C{(i + 1) % n} next; function go() external {{ next.go(); emit E(); }} }}") for i in range(n))))
    found = [r for r in cross_contract.findings(facts).collect() if r.detector_id == "circular-dependency"]
    assert [r.message for r in found] == [", ".join(f"C{i}" for i in range(n))]


def test_declared_errors_are_not_syntax_errors(spark):
    rows = list(parser.parse(1, "contract A { error Bad(uint x); function f() external { revert Bad(1); } }"))
    assert {r["kind"] for r in rows if r.get("name") == "Bad"} == {"custom_error"} and not any(r["kind"] == "error" for r in rows)


def test_thresholds_are_options(spark):
    body = "\n".join("        x = x + 1;" for _ in range(20))
    sources = as_sources(spark, ("a", f"contract A {{\n    uint x;\n    function f() external {{\n{body}\n    }}\n}}"))
    found = lambda **o: {r.detector_id for r in analyze(sources, Options(lint=True, enable=("function-too-long",), **o)).collect()}
    assert found() == set() and found(parameters={"max_function_lines": 10}) == {"function-too-long"}


def test_reports_and_golden_files(spark, tmp_path, capsys):
    found = spark.createDataFrame([("a.sol", 3, "r1", "High", "m"), ("b.sol", 9, "r2", "Critical", "n")], "path string, line int, detector_id string, severity string, message string")
    report.write_golden(found, str(tmp_path / "golden"))
    assert report.against_golden(found, str(tmp_path / "golden")).count() == 0
    moved = found.withColumn("line", F.col("line") + F.when(F.col("path") == "a.sol", 2).otherwise(0))
    assert {(r.path, r.line, r.change) for r in report.against_golden(moved, str(tmp_path / "golden")).collect()} == {("a.sol", 3, "missing"), ("a.sol", 5, "added")}
    assert report.against_golden(moved, str(tmp_path / "golden"), tolerance=2).count() == 0
    for form in ("json", "text"):
        report.write_report(found, str(tmp_path / form), form)
        assert "b.sol" in "".join(r.value for r in spark.read.text(str(tmp_path / form)).collect())
    report.write_report(found)
    assert capsys.readouterr().out.count("a.sol") == 1
    assert [r.path for r in report.critical_files(found).collect()] == ["b.sol"]
    with pytest.raises(ValueError):
        report.write_report(found, form="xml")


def test_edits_of_files_without_text(spark):
    sources = spark.createDataFrame([(1, None), (2, "a\nb")], "file_id long, content string")
    edits = spark.createDataFrame([(1, 1, 1, 1, "x", 0.5), (2, 2, 2, 2, "x", 0.5)], fixes.EDITS)
    assert {tuple(r) for r in fixes.applied(sources, edits).collect()} == {(2, "a\nx")}


def test_unchecked_calls(spark):
    bad = "function a(address t) external { t.call(''); }\n function b(address t) external { verifier.staticcall(''); total = 1; }\n"
    good = "function c(address t) external { (bool success, ) = t.call(''); require(success); t.send(1); }\n function d(address t) external returns (bool) { return t.send(1); }\n function e() external { members.call(''); }\n function g(address t) external { t.call(''); emit Sent(t); }\n"
    files = ("a", f"contract A {{ uint total; {bad}{good} }}"), ("b", f"contract B {{ using SafeERC20 for IERC20; {bad} }}"), ("c", f"library C {{ {bad} }}"), ("d", f"contract MockD {{ {bad} }}")
    found = analyze(as_sources(spark, *files), Options(enable=("unchecked-external-call",), cap=None)).collect()
    assert {(r.path, r.message.split(".")[0]) for r in found} == {("a.sol", "t"), ("a.sol", "verifier")}
