"""Types of the analysed language as canonical text: size, kind and compatibility."""

from __future__ import annotations

import re

LEVELS = ("incompatible", "explicit", "implicit", "identical")
_ALIAS = {"uint": "uint256", "int": "int256", "byte": "bytes1", "fixed": "fixed128x18", "ufixed": "ufixed128x18"}


def canonical(name: str) -> str:
    name = re.sub(r"\s+", " ", name.strip())
    base, array = re.match(r"([^\[]*)(.*)", name, re.S).groups()
    base = base.strip().removesuffix(" payable")
    return _ALIAS.get(base, base) + array.replace(" ", "")


def is_value_type(name: str) -> bool:
    return bool(re.fullmatch(r"bool|address|u?int\d+|bytes\d+|u?fixed\d+x\d+", canonical(name)))


def size_in_bytes(name: str) -> int:
    """Bytes in storage; a slot for what lives elsewhere."""
    name = canonical(name)
    if m := re.fullmatch(r"(.*)\[(\d+)\]", name):
        return size_in_bytes(m[1]) * int(m[2])
    if m := re.fullmatch(r"u?int(\d+)", name):
        return int(m[1]) // 8
    if m := re.fullmatch(r"bytes(\d+)", name):
        return int(m[1])
    return {"bool": 1, "address": 20}.get(name, 32)


def compatibility(source: str, target: str) -> str:
    """How a value of one type becomes another."""
    a, b = canonical(source), canonical(target)
    if a == b:
        return "identical"
    x, y = (re.fullmatch(r"(u?int|bytes)(\d+)", t) for t in (a, b))
    if x and y:
        if x[1] == y[1]:
            return "implicit" if int(x[2]) <= int(y[2]) else "explicit"
        if {x[1], y[1]} == {"uint", "int"}:
            return "implicit" if x[1] == "uint" and int(x[2]) < int(y[2]) else "explicit"
        return "explicit" if size_in_bytes(a) == size_in_bytes(b) else "incompatible"
    if {a, b} in ({"address", "uint160"}, {"address", "bytes20"}, {"string", "bytes"}):
        return "explicit"
    return "incompatible"


def common_type(a: str, b: str) -> str | None:
    """The type both convert to without being told."""
    if compatibility(a, b) in ("identical", "implicit"):
        return canonical(b)
    return canonical(a) if compatibility(b, a) == "implicit" else None
