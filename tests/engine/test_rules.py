import pytest
from pyspark.sql import functions as F

from factweave.operators import dataflow, fixes, graph
from factweave.plans import cross_contract, report
from factweave.plans.catalogue import RULES
from factweave.plans.planner import SPECIAL, Facts, Options, analyze, select_rules
from factweave.sources import scan
from factweave.streaming import reanalysis

WEAK = """pragma solidity ^0.8.20;
import {Gone} from "./g.sol";
contract Weak {
    mapping(address => uint256) public balances;
    address owner;
    uint256[] items;

    function take(uint256 amount) external {
        msg.sender.call("");
        balances[msg.sender] = amount;
    }
    /// documented
    function setOwner(address o) external { owner = o; }
    function at(uint256 i) external view returns (uint256) { return items[i]; }
    function pay() external payable {
        for (uint256 i = 1; i < 2; i++) {
            balances[msg.sender] += msg.value * 777;
        }
    }
    function who() public { require(tx.origin == owner); }
    function price() external returns (int256 p) {
        (, p, , , ) = feed.latestRoundData();
    }
    function initialize() public { owner = msg.sender; }
}
"""
SAFE = """pragma solidity ^0.8.20;
contract Safe {
    mapping(address => uint256) public balances;
    /// takes
    function take(uint256 amount) external nonReentrant {
        balances[msg.sender] -= amount;
        (bool ok, ) = msg.sender.call("");
        require(ok);
    }
    // comment about latestRoundData and tx.origin ==
}
"""


def sources(spark, *files):
    return scan.as_sources(spark.createDataFrame(list(files), "path string, content string"))


@pytest.fixture(scope="module")
def found(spark):
    return analyze(sources(spark, ("src/Weak.sol", WEAK), ("src/Safe.sol", SAFE), ("src/Empty.sol", ""), ("src/Null.sol", None)), Options(lint=True)).cache()


def test_catalogue_is_whole():
    assert len(RULES) == len({r.id for r in RULES}) == 81
    assert {r.id for r in RULES if r.level == "special"} == set(SPECIAL)
    severity = [r.severity for r in RULES]
    assert [severity.count(s) for s in ("High", "Critical", "Medium", "Info", "Low")] == [35, 20, 19, 4, 3]


def test_rules_find_what_they_should(found):
    weak = {(r.detector_id, r.line) for r in found.where("path like '%Weak%'").collect()}
    assert {
        ("classic-reentrancy", 8), ("unchecked-external-call", 9), ("missing-access-modifiers", 13), ("missing-zero-address-check", 13), ("array-bounds-check", 14), ("l2-msg-value-in-loop", 17),
        ("magic-number", 17), ("tx-origin-authentication", 20), ("chainlink-stale-price", 22), ("unused-import", 2), ("missing-natspec", 8), ("oracle-staleness-heartbeat", 3),
    } <= weak
    assert ("missing-natspec", 13) not in weak


def test_rules_leave_safe_code_alone(found):
    assert found.where("path not like '%Weak%'").count() == 0


def test_selection_prunes_before_planning():
    assert {r.id for r in select_rules(Options(categories=("Lint",), lint=True))} == {r.id for r in RULES if r.lint}
    assert not any(r.lint for r in select_rules(Options()))
    assert [r.id for r in select_rules(Options(enable=("magic-number",), lint=True))] == ["magic-number"]
    assert all(r.severity == "Critical" for r in select_rules(Options(severity="Critical")))


def test_cap_and_suppression(spark):
    many = "contract Many {\n" + "".join(f"    function f{i}() public {{ require(tx.origin == o); }}\n" for i in range(6)) + "}\n"
    src = sources(spark, ("src/Many.sol", many), ("src/test/Many.t.sol", many.replace("public", "public onlyOwner")))
    only = ("tx-origin-authentication",)
    assert sorted(r.line for r in analyze(src, Options(enable=only)).collect()) == [2, 2, 3, 3, 4, 4]
    assert analyze(src, Options(enable=only, cap=None)).count() == 12
    assert analyze(src, Options(enable=only, cap=None, suppress=True)).count() == 6


def test_findings_do_not_depend_on_other_files(spark, found):
    alone = analyze(sources(spark, ("src/Weak.sol", WEAK)), Options(lint=True))
    assert sorted(map(tuple, alone.drop("categories").collect()), key=str) == sorted(map(tuple, found.drop("categories").collect()), key=str)


def test_reports(found):
    total = report.summary(found)
    assert total["by_severity"]["Critical"] >= 2 and total["risk"] == 10 and total["band"] == "high" and len(total["critical_files"]) == 1
    assert "CRITICAL" in report.as_text(found) and report.as_json(found).first().value.startswith('{"path"')
    assert report.diagnostics(found).where("severity not between 1 and 4").count() == 0


def test_results_are_brought_up_to_date(spark, tmp_path):
    path, one = str(tmp_path / "results"), ("src/Weak.sol", WEAK)
    first = report.refresh(sources(spark, one, ("src/Safe.sol", SAFE)), path).count()
    files = spark.read.parquet(path).count()
    assert report.refresh(sources(spark, one, ("src/Safe.sol", SAFE)), path).count() == first
    assert spark.read.parquet(path).count() == files
    assert report.refresh(sources(spark, ("src/Weak.sol", SAFE.replace("Safe", "Weak"))), path).count() == 0
    assert report.config_hash(Options()) != report.config_hash(Options(lint=True))


def test_validation(spark, found):
    expected = spark.createDataFrame([("src/Weak.sol", "classic-reentrancy", 1, 10, 10), ("src/Safe.sol", "classic-reentrancy", 2, 5, 5)], "path string, detector_id string, exp_id long, line_lo int, line_hi int")
    got = report.validated(found.where("detector_id = 'classic-reentrancy'"), expected).first()
    assert (got.tp, got.fp, got.fn, got.precision, got.recall) == (1, 0, 1, 1.0, 0.5)


def test_fixes(spark, found):
    src = sources(spark, ("src/Weak.sol", WEAK))
    rows = found.where("path = 'src/Weak.sol' and detector_id in ('classic-reentrancy', 'missing-access-modifiers', 'unchecked-external-call')").join(src.select("path", "file_id"), "path")
    edits = fixes.suggested(rows, scan.lines_of(src))
    content = fixes.applied(src, edits).first().content
    assert "external nonReentrant {" in content and "external onlyOwner {" in content and "(bool success, ) = msg.sender.call" in content
    assert content.count("\n") == WEAK.count("\n")
    clash = spark.createDataFrame([(1, 1, 1, 3, "a", 0.5), (1, 2, 3, 5, "b", 0.9), (1, 3, 7, 7, "c", 0.1)], fixes.EDITS)
    assert {r.fix_id for r in fixes.without_conflicts(clash).collect()} == {2, 3}


def test_cross_contract_rules(spark):
    a = "contract A { B b; uint total; function go() external { b.run(); C(x).stop(); } }"
    b = "contract B { A a; uint total; function run() external { a.go(); } }"
    c = "contract C { function stop() external { emit E(); } }"
    facts = Facts(sources(spark, ("a", a), ("b", b), ("c", c)))
    assert {(r.src, r.dst) for r in cross_contract.interactions(facts).collect()} == {("A", "B"), ("A", "C"), ("B", "A")}
    got = {(r.detector_id, r.contract, r.message) for r in cross_contract.findings(facts).collect()}
    assert got == {("circular-dependency", "A", "A > B"), ("cross-contract-reentrancy", "A", "A > B"), ("state-inconsistency", "A", "B: total"), ("atomicity-violation", "A", "go: B, C")}


def test_local_and_relational_fixpoints_agree(spark):
    edges = [(f, a, b) for f in range(6) for a, b in ((0, 1), (1, 2), (2, 1), (1, 3), (3, 4), (4, 0)) if (f + a + b) % 5]
    e = spark.createDataFrame(edges, "func long, src long, dst long")
    n = spark.createDataFrame([(f, i) for f in range(6) for i in range(5)], "func long, node long")
    entry = n.where("node = 0")
    reached = {tuple(r) for r in graph.reachable(e, entry, ["func"]).collect()}
    assert {tuple(r) for r in graph.reachable(e, entry, ["func"], local=False).collect()} == reached
    pairs, flow = graph.reach_pairs(e, ["func"]), n.select("func", "node", F.when(F.col("node") % 2 == 0, "x").otherwise("y").alias("defines"), F.when(F.col("node") > 2, "x").alias("uses"))
    assert {tuple(r) for r in pairs.collect()} == {tuple(r) for r in graph.reach_pairs(e, ["func"], local=False).collect()}
    for analysis in (dataflow.reaching_definitions, dataflow.live_variables):
        local = {tuple(r) for r in analysis(flow, e, ["func"]).collect()}
        assert local and local == {tuple(r) for r in analysis(flow, e, ["func"], local=False).collect()}
    assert {(r.func, r.node) for r in graph.dominators(n, e, entry, ["func"]).collect()} == reached
    assert {tuple(r) for r in graph.unreachable(n, e, entry, ["func"]).collect()} == {(f, i) for f in range(6) for i in range(5)} - reached
    hops = {(r.func, r.node) for r in graph.shortest_paths(e, entry, ["func"]).collect()}
    assert hops == reached


def test_post_dominators_and_likelihood(spark):
    n = spark.createDataFrame([(1, i) for i in range(4)], "func long, node long")
    e = spark.createDataFrame([(1, 0, 1), (1, 0, 2), (1, 1, 3), (1, 2, 3)], "func long, src long, dst long")
    got = {(r.dominator, r.node) for r in graph.post_dominators(n, e, n.where("node = 3"), ["func"]).collect()}
    assert got == {(3, i) for i in range(4)} | {(i, i) for i in range(3)}
    v = spark.range(1).select(dataflow.false_positive_likelihood(F.lit(11), F.array(F.lit(0.5), F.lit(0.01))).alias("x")).first().x
    assert v == 0.01


def test_changes_are_reanalysed(spark, tmp_path):
    import json

    folder = tmp_path / "in"
    folder.mkdir()
    rows = [{"path": "a.sol", "version": 1, "content": WEAK}, {"path": "a.sol", "version": 2, "content": SAFE}, {"path": "b.sol", "version": 7, "content": WEAK}]
    (folder / "one.json").write_text("\n".join(map(json.dumps, rows)))
    seen = []
    query = reanalysis.watch(spark, str(folder), lambda found, batch: seen.extend((r.path, r.version) for r in found.collect()), str(tmp_path / "check"))
    query.awaitTermination()
    assert set(seen) == {("b.sol", 7)}


def test_rules_are_evaluated_once(spark):
    """Capped and lint rules share one pass, and the sources are worked out once, whatever reads them."""
    found = analyze(sources(spark, ("a", "contract A { uint x; function f() public { x = 17; } }")), Options(lint=True))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("magic-number AS detector_id") == 1
    assert "sha2" not in plan


def test_rules_need_no_join_of_files(spark):
    """Findings are made where a file is parsed: only the rules' own table is joined, and a file that comes twice does not fill its cap."""
    many = "contract Many {\n" + "".join(f"    function f{i}() public {{ require(tx.origin == o); }}\n" for i in range(4)) + "}\n"
    found = analyze(sources(spark, ("a", many), ("a", many)), Options(lint=True))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1
    assert sorted(r.line for r in found.where("detector_id = 'tx-origin-authentication'").collect()) == [2, 2, 3, 3, 4, 4]
