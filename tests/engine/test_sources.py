import json

import pytest
from pyspark.sql import functions as F

from factweave.functions import text, types
from factweave.sources import explorer, lowering, parser, project, scan

BANK = """pragma solidity ^0.8.24;
import {A, B as C} from "./lib/a.sol";
import * as D from "d.sol";
// contract Fake {
contract Bank is Base, Own(1) {
    mapping(address => uint256) public balances;
    uint256 total;
    event Paid(uint256 a);
    modifier only() { require(msg.sender == owner); _; }
    constructor() payable { owner = msg.sender; }
    function withdraw(uint256 amount) external only returns (bool) {
        require(balances[msg.sender] >= amount, "a { b");
        (bool ok, ) = msg.sender.call{value: amount}("");
        for (uint256 i = 0; i < 3; i++) {
            if (i == 1) { continue; } else { total += i; }
        }
        balances[msg.sender] -= amount;
        return ok;
    }
    receive() external payable {}
}
interface I { function f() external view; }
"""


def test_strippers_keep_lines_and_strings():
    source = 'a // "x\nb = "// no { comment"; /* c\nd */ e'
    assert text.strip_comments_text(source) == 'a      \nb = "// no { comment";     \n     e'
    assert text.clean_source_text(source).count("\n") == source.count("\n")
    assert "{" not in text.clean_source_text(source)
    assert text.strip_comments_text(None) is None


def test_lines_and_versions(spark):
    df = spark.createDataFrame([(1, "a\r\n\r\nb\r\n"), (2, "x"), (3, "")], "file_id long, content string")
    assert [(r.file_id, r.line_no, r.text) for r in scan.lines_of(df).orderBy("file_id", "line_no").collect()] == [(1, 1, "a"), (1, 2, ""), (1, 3, "b"), (2, 1, "x"), (3, 1, "")]
    v = spark.createDataFrame([("^0.8.24",), (">=0.4 <0.9",), ("none",)], "v string").select(text.version(F.col("v")).alias("s")).collect()
    assert [None if r.s is None else tuple(r.s) for r in v] == [(0, 8, 24), (0, 4, 0), None]


def test_scan_excludes_and_marks_tests(spark, tmp_path):
    for name in ("src/A.sol", "src/test/B.sol", "node_modules/C.sol", "src/D.t.sol", "src/e.txt"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("contract X {}\n")
    found = scan.read_sources(spark, str(tmp_path), exclude=("node_modules",))
    assert {(r.path.rsplit("/", 1)[1], r.is_test) for r in found.collect()} == {("A.sol", False), ("B.sol", True), ("D.t.sol", True)}
    assert scan.with_dependencies(found, found).count() == 4


def test_projects(tmp_path):
    assert project.load_config(str(tmp_path))["framework"] == "plain"
    (tmp_path / "foundry.toml").write_text('[profile.default]\nsrc = "contracts"\nlibs = ["lib", "dep"]\nsolc = "0.8.20"\nremappings = ["@oz/=lib/oz/"]\n')
    (tmp_path / "remappings.txt").write_text("ds/=lib/ds/\n")
    assert {k: v for k, v in project.load_config(str(tmp_path)).items() if k != "exclude"} == {"framework": "foundry", "src": "contracts", "libs": ["lib", "dep"], "solc": "0.8.20", "remappings": {"@oz/": "lib/oz/", "ds/": "lib/ds/"}}
    (tmp_path / "foundry.toml").unlink()
    (tmp_path / "hardhat.config.js").write_text('module.exports = { solidity: { version: "0.8.19" }, paths: { sources: "./src" } }')
    found = project.load_config(str(tmp_path))
    assert (found["framework"], found["solc"], found["src"]) == ("hardhat", "0.8.19", "src")


def test_imports_and_their_resolution(spark):
    lines = scan.lines_of(scan.as_sources(spark.createDataFrame([("src/Bank.sol", BANK)], "path string, content string")))
    got = {r.path: (r.kind, r.alias, [tuple(s) for s in r.symbols or []]) for r in project.imports_of(lines).collect()}
    assert got == {"./lib/a.sol": ("named", None, [("A", None), ("B", "C")]), "d.sol": ("wildcard", "D", [])}
    imports = spark.createDataFrame([("src/x/Bank.sol", p) for p in ("./a.sol", "../b.sol", "@oz/c.sol", "@oz/sub/d.sol", "e.sol", "f", "nowhere.sol")], "importer string, path string")
    files = spark.createDataFrame([(p,) for p in ("src/x/a.sol", "src/b.sol", "lib/oz/c.sol", "lib/sub/d.sol", "lib/e.sol", "f.sol")], "path string")
    remappings = spark.createDataFrame([("@oz/", "lib/oz/"), ("@oz/sub/", "lib/sub/")], "prefix string, target string")
    found = {r.path: r.imported for r in project.resolve_imports(imports, files, remappings, ["lib"]).collect()}
    assert found == {"./a.sol": "src/x/a.sol", "../b.sol": "src/b.sol", "@oz/c.sol": "lib/oz/c.sol", "@oz/sub/d.sol": "lib/sub/d.sol", "e.sol": "lib/e.sol", "f": "f.sol", "nowhere.sol": None}


def test_parser_reads_declarations():
    rows = list(parser.parse(1, BANK))
    kinds = [(r["kind"], r["name"]) for r in rows if r["kind"] not in ("statement",)]
    assert kinds == [("contract", "Bank"), ("state", "balances"), ("state", "total"), ("event", "Paid"), ("modifier", "only"), ("function", "constructor"), ("function", "withdraw"), ("function", "receive"), ("contract", "I"), ("function", "f")]
    bank, withdraw = rows[0], next(r for r in rows if r["name"] == "withdraw" and r["kind"] == "function")
    assert bank["bases"] == ["Base", "Own"] and bank["start_line"] == 5
    assert (withdraw["start_line"], withdraw["end_line"], withdraw["visibility"], withdraw["modifiers"]) == (11, 19, "external", ["only"])
    steps = [r["opcode"] for r in rows if r["kind"] == "statement" and r["name"] == "withdraw"]
    assert steps == ["require", "extcall", "loop", "branch", "break", "branch", "sstore", "sstore", "return"]


def test_parser_survives_anything():
    for source in (None, "", "contract {", "contract A { function f( }", "}}}{{{", BANK[:200], BANK[50:400]):
        assert isinstance(list(parser.parse(1, source)), list)
    assert any(r["kind"] == "error" for r in parser.parse(1, "contract A { function f() public {"))


def test_lowering_makes_blocks_and_edges(spark):
    sources = scan.as_sources(spark.createDataFrame([("Bank.sol", BANK)], "path string, content string"))
    found = parser.facts(sources)
    rows = lowering.lowered(parser.statements_of(found).where("function = 'withdraw'")).cache()
    edges = {(r.src, r.dst, r.edge_type) for r in lowering.cfg_edges(rows).collect()}
    # 0 entry; 1 loop header, 2 body, 3 exit; 4 join, 5 and 6 the arms
    assert edges == {(0, 1, "Unconditional"), (1, 2, "True"), (1, 3, "False"), (2, 5, "True"), (5, 1, "Unconditional"), (2, 6, "False"), (6, 4, "Unconditional"), (4, 1, "Back")}
    writes = {(r.opcode, r.defines) for r in lowering.instructions(rows).collect() if r.defines}
    assert {("sstore", "balances"), ("sstore", "total")} <= writes
    assert lowering.cfg_nodes(rows).count() == 7


def test_defines_and_uses():
    assert lowering.defines_uses("x = y + z") == ("x", ["y", "z"])
    assert lowering.defines_uses("x += y") == ("x", ["x", "y"])
    assert lowering.defines_uses("uint256 x = f(y)") == ("x", ["y"])
    assert lowering.defines_uses("a[i] = b") == ("a", ["a", "b", "i"])
    assert lowering.defines_uses("require(x == y)") == (None, ["x", "y"])


def test_explorer_addresses(spark):
    tx = "0x" + "ab" * 32
    assert explorer.parse_url(f"https://www.etherscan.io/tx/{tx}") == ("etherscan.io", "tx", tx)
    for bad in ("https://example.com/tx/" + tx, "https://etherscan.io/address/0x12"):
        with pytest.raises(ValueError):
            explorer.parse_url(bad)
    several = "{" + json.dumps({"sources": {"A.sol": {"content": "contract A {}"}}}) + "}"
    answers = {"eth_getTransactionByHash": json.dumps({"result": {"to": "0x" + "cd" * 20}}), "getsourcecode": json.dumps({"result": [{"SourceCode": several, "ContractName": "A"}]})}
    got = explorer.fetch(spark, f"https://etherscan.io/tx/{tx}", lambda url: next(v for k, v in answers.items() if k in url))
    assert [(r.path, r.content) for r in got.collect()] == [("A.sol", "contract A {}")]


def test_types():
    assert types.canonical("uint [ 3 ]") == "uint256[3]"
    assert [types.size_in_bytes(t) for t in ("uint8", "address payable", "bytes4", "uint128[2]", "string")] == [1, 20, 4, 32, 32]
    assert types.compatibility("uint8", "uint") == "implicit" and types.compatibility("uint", "uint8") == "explicit"
    assert types.compatibility("uint8", "int16") == "implicit" and types.compatibility("bool", "uint8") == "incompatible"
    assert types.common_type("uint16", "uint8") == "uint16" and types.common_type("bool", "string") is None
    assert types.is_value_type("bytes32") and not types.is_value_type("uint[]")
