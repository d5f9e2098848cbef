"""Statements to instructions, basic blocks and control-flow edges.

One pass over each function's statements, in a task of its own share of
functions.  Block 0 is the entry; a loop makes a header, a body and an exit, a
branch its arms and a join; what follows a return, a revert, a break or a
continue is a block that nothing enters.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, functions as F

KEYS = ["file_id", "contract_ord", "func_ord"]
INSTRUCTIONS = "file_id long, contract_ord int, func_ord int, kind string, block int, idx int, opcode string, line int, defines string, uses array<string>, dst int, edge string"
_NAME = re.compile(r"(?<![\w.\"'])[A-Za-z_]\w*")
_KEYWORDS = set("if else for while do return require assert revert emit new delete true false memory storage calldata uint uint256 int int256 address bool bytes bytes32 string mapping msg block tx this abi type unchecked assembly try catch".split())
_ASSIGN = re.compile(r"^(?:[\w.]+(?:\[[^\]]*\])*\s+)*?(?:(?:memory|storage|calldata)\s+)?(\w+)(?:\s*[\[.][^=;]*)?\s*((?:[-+*/%|&^]|<<|>>)?=)(?!=)(.*)$", re.S)
TERMINAL = ("return", "revert", "selfdestruct")


def defines_uses(text: str) -> tuple[str | None, list[str]]:
    """The variable a statement writes, and those it reads."""
    names = lambda s: sorted({n for n in _NAME.findall(s) if n not in _KEYWORDS and not re.search(rf"\b{n}\s*\(", s)})
    head = re.sub(r"^(for|while|if|else if)\s*\(", "", text) if re.match(r"(for|while|if|else)", text) else text
    if (m := _ASSIGN.match(head)) and not re.match(r"(if|while|else)", text):
        partly = "[" in head.split("=")[0] or len(m[2]) > 1
        return m[1], names(m[3] + (" " + head.split("=")[0] if partly else ""))
    if m := re.match(r"(?:\+\+|--)?\s*(\w+)\s*(?:\+\+|--)?$", text):
        return (m[1] if "++" in text or "--" in text else None), names(text)
    return None, names(text)


def lower(rows: list[dict]) -> tuple[list[dict], list[tuple[int, int, str]]]:
    """Instructions and edges of one function; rows have idx, depth, opcode, line and text in order."""
    out: list[dict] = []
    edges: list[tuple[int, int, str]] = []
    counter = [0]

    def block() -> int:
        counter[0] += 1
        return counter[0]

    def put(at: int, row: dict, op: str | None = None) -> None:
        defines, uses = defines_uses(row["text"])
        out.append({"block": at, "idx": len(out), "opcode": op or row["opcode"], "line": row["line"], "defines": defines, "uses": uses})

    def run(i: int, depth: int, at: int, loop: tuple[int, int] | None) -> tuple[int, int, bool]:
        """Lowers from row i what is at least this deep; (next row, block, whether the flow goes on)."""
        going = True
        while i < len(rows) and rows[i]["depth"] >= depth:
            row = rows[i]
            if not going:
                at, going = block(), True
            if row["opcode"] == "loop":
                header, body, leave = block(), block(), block()
                edges.append((at, header, "Unconditional"))
                put(header, row, "condbranch")
                edges.extend([(header, body, "True"), (header, leave, "False")])
                i, last, open_ = run(i + 1, depth + 1, body, (header, leave))
                if open_:
                    edges.append((last, header, "Back"))
                at = leave
            elif row["opcode"] == "branch" and i + 1 < len(rows) and rows[i + 1]["depth"] > depth:
                put(at, row, "condbranch")
                join, from_, ends = block(), at, []
                while True:
                    arm = block()
                    edges.append((from_, arm, "True"))
                    i, last, open_ = run(i + 1, depth + 1, arm, loop)
                    ends += [last] * open_
                    if i >= len(rows) or rows[i]["depth"] != depth or not rows[i]["text"].startswith("else"):
                        edges.append((from_, join, "False"))
                        break
                    if not re.match(r"else\s+if", rows[i]["text"]):
                        arm = block()
                        edges.append((from_, arm, "False"))
                        i, last, open_ = run(i + 1, depth + 1, arm, loop)
                        ends += [last] * open_
                        break
                    test = block()
                    edges.append((from_, test, "False"))
                    put(test, rows[i], "condbranch")
                    from_ = test
                edges.extend((e, join, "Unconditional") for e in ends)
                at = join
            elif row["opcode"] == "break" and loop:
                put(at, row)
                edges.append((at, loop[row["text"].startswith("break")], "Unconditional"))
                going, i = False, i + 1
            elif row["depth"] > depth:  # a bare block, unchecked or assembly
                i, at, going = run(i, depth + 1, at, loop)
            else:
                put(at, row)
                if row["opcode"] == "branch" and re.search(r"\b(return|revert)\b", row["text"]):
                    after = block()
                    edges.append((at, after, "False"))
                    at = after
                going = row["opcode"] not in TERMINAL
                i += 1
        return i, at, going

    run(0, 0, 0, None)
    return out, edges


def _lower_all(pdf: pd.DataFrame) -> pd.DataFrame:
    rows = []
    for key, group in pdf.sort_values("idx").groupby(KEYS, sort=True):
        head = dict(zip(KEYS, key))
        found, edges = lower(group.to_dict("records"))
        blocks = {0} | {r["block"] for r in found} | {b for e in edges for b in e[:2]}
        rows += [head | {"kind": "instr"} | r for r in found]
        rows += [head | {"kind": "edge", "block": a, "dst": b, "edge": e} for a, b, e in edges]
        rows += [head | {"kind": "block", "block": b} for b in sorted(blocks)]
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in INSTRUCTIONS.split(", ")])
    for c in ("block", "idx", "line", "dst"):
        out[c] = out[c].astype("Int32")
    return out.astype(object).where(out.notna(), None)


def lowered(statements: DataFrame) -> DataFrame:
    """The tagged rows of all functions; many small functions share a task's group."""
    share = F.pmod(F.xxhash64(*KEYS), F.lit(4 * int(statements.sparkSession.conf.get("spark.sql.shuffle.partitions")))).alias("share")
    return statements.select(*KEYS, "idx", "depth", "opcode", "line", "text").groupBy(share).applyInPandas(_lower_all, INSTRUCTIONS)


def instructions(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'instr'").select(*KEYS, "block", "idx", "opcode", "line", "defines", "uses")


def cfg_edges(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'edge'").select(*KEYS, F.col("block").alias("src"), F.col("dst"), F.col("edge").alias("edge_type"))


def cfg_nodes(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'block'").select(*KEYS, F.col("block").alias("node"))
