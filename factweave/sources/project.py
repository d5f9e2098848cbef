"""Projects: framework, configuration, remappings, imports and their resolution."""

from __future__ import annotations

import os
import re
import tomllib

from pyspark.sql import DataFrame, functions as F


def detect_framework(root: str) -> str:
    """``foundry``, ``hardhat`` or ``plain``, by the configuration file in the project's root."""
    names = set(os.listdir(root)) if os.path.isdir(root) else set()
    if "foundry.toml" in names:
        return "foundry"
    return "hardhat" if names & {"hardhat.config.js", "hardhat.config.ts", "hardhat.config.cjs"} else "plain"


def load_config(root: str) -> dict:
    """Source folder, library folders, remappings, compiler version and excluded folders."""
    kind = detect_framework(root)
    out = {"framework": kind, "src": "contracts" if kind == "hardhat" else "src" if kind == "foundry" else ".", "libs": ["node_modules"] if kind == "hardhat" else ["lib"], "remappings": {}, "solc": None, "exclude": ["node_modules", "artifacts", "cache", "out", ".git"]}
    if kind == "foundry":
        with open(os.path.join(root, "foundry.toml"), "rb") as f:
            profile = tomllib.load(f).get("profile", {}).get("default", {})
        out |= {"src": profile.get("src", "src"), "libs": profile.get("libs", ["lib"]), "solc": profile.get("solc_version", profile.get("solc"))}
        entries = list(profile.get("remappings", []))
        extra = os.path.join(root, "remappings.txt")
        if os.path.exists(extra):
            with open(extra) as f:
                entries += f.read().split()
        out["remappings"] = dict(e.split("=", 1) for e in entries if "=" in e)
    elif kind == "hardhat":
        name = next(n for n in ("hardhat.config.js", "hardhat.config.ts", "hardhat.config.cjs") if os.path.exists(os.path.join(root, n)))
        with open(os.path.join(root, name)) as f:
            text = f.read()
        if m := re.search(r"""solidity\s*:\s*(?:\{[^}]*?version\s*:\s*)?["']([\d.^~]+)["']""", text, re.S):
            out["solc"] = m[1]
        if m := re.search(r"""sources\s*:\s*["']([^"']+)["']""", text):
            out["src"] = m[1].removeprefix("./")
    return out


def imports_of(lines: DataFrame, key: str = "file_id") -> DataFrame:
    """``(key, line_no, kind, path, alias, symbols)`` of import lines of any of the four forms."""
    t, quoted = F.trim("text"), r"[\"']([^\"']+)[\"']"
    forms = {"named": rf"^import\s*\{{([^}}]*)\}}\s*from\s*{quoted}", "wildcard": rf"^import\s*\*\s*as\s+(\w+)\s+from\s*{quoted}", "aliased": rf"^import\s*{quoted}\s*as\s+(\w+)", "simple": rf"^import\s*{quoted}"}
    kind = F.coalesce(*(F.when(t.rlike(p), F.lit(k)) for k, p in forms.items()))
    path = F.coalesce(*(F.when(t.rlike(p), F.regexp_extract(t, p, 1 if k in ("simple", "aliased") else 2)) for k, p in forms.items()))
    alias = F.coalesce(F.when(t.rlike(forms["wildcard"]), F.regexp_extract(t, forms["wildcard"], 1)), F.when(t.rlike(forms["aliased"]), F.regexp_extract(t, forms["aliased"], 2)))
    symbols = F.when(t.rlike(forms["named"]), F.transform(F.split(F.regexp_extract(t, forms["named"], 1), ","), lambda x: F.struct(F.regexp_extract(x, r"^\s*(\w+)", 1).alias("name"), F.nullif(F.regexp_extract(x, r"\bas\s+(\w+)", 1), F.lit("")).alias("alias"))))
    return lines.select(key, "line_no", kind.alias("kind"), path.alias("path"), alias.alias("alias"), symbols.alias("symbols")).where("kind is not null")


def remap(imports: DataFrame, remappings: DataFrame) -> DataFrame:
    """``imports(.., path)`` with ``remapped``: the longest matching prefix replaced by its target, null without a match.

    ``remappings(prefix, target)`` is a project's short list.
    """
    hit = imports.join(F.broadcast(remappings), F.col("path").startswith(F.col("prefix")), "left")
    best = hit.groupBy(*imports.columns).agg(F.max_by(F.struct("prefix", "target"), F.struct(F.length("prefix"), F.col("prefix"))).alias("best"))
    return best.select(*imports.columns, F.expr("best.target || substring(path, length(best.prefix) + 1)").alias("remapped"))


def normalise(path):
    """Removes ``./`` and one level after another of ``x/..``."""
    out = F.regexp_replace(path, r"(^|/)(\./)+", "$1")
    for _ in range(4):
        out = F.regexp_replace(out, r"(^|/)(?!\.\.(?:/|$))[^/]+/\.\.(/|$)", "$1")
    return out


def resolve_imports(imports: DataFrame, files: DataFrame, remappings: DataFrame, libs: list[str], extension: str = ".sol") -> DataFrame:
    """``imports(importer, path)`` with ``imported``: remapped, else relative, else in a library, else from the root, else with the extension added.

    Every way is one left join on the file's path; the first that hits wins.
    """
    mapped = remap(imports, remappings)
    folder = F.regexp_replace("importer", r"[^/]*$", "")
    ways = [F.col("remapped"), F.when(F.col("path").startswith("."), normalise(F.concat(folder, "path")))]
    ways += [F.concat(F.lit(f"{lib}/"), "path") for lib in libs] + [normalise(F.col("path"))]
    ways += [F.when(~F.col("path").endswith(extension), F.concat(w, F.lit(extension))) for w in (ways[1], ways[-1])]
    out = mapped.withColumn("imported", F.lit(None).cast("string"))
    for i, way in enumerate(ways):
        known = files.select(F.col("path").alias(f"_p{i}"))
        out = out.withColumn(f"_w{i}", way).join(known, F.col(f"_w{i}") == F.col(f"_p{i}"), "left").withColumn("imported", F.coalesce("imported", f"_p{i}")).drop(f"_w{i}", f"_p{i}")
    return out.drop("remapped")
