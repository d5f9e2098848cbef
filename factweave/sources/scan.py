"""Scans: source files, dependencies, their lines, and per-file facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import split_lines, trim_all

TEST_PATHS = r"(\.t\.[a-z]+$|/tests?/|(^|/)Test[^/]*$|(^|/)test_[^/]*$)"


def is_test_path(path: Column) -> Column:
    return path.rlike(TEST_PATHS)


def read_sources(spark: SparkSession, paths: str | list[str], glob: str = "*.sol", exclude: tuple[str, ...] = (), origin: str = "src") -> DataFrame:
    """``sources(file_id, path, content, content_hash, origin, is_test)`` of every file below the paths whose directories are not excluded."""
    found = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("wholetext", "true").text(paths)
    return as_sources(found.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content")), origin, exclude)


def as_sources(files: DataFrame, origin: str = "src", exclude: tuple[str, ...] = ()) -> DataFrame:
    """The same from any ``(path, content)`` rows."""
    for name in exclude:
        files = files.where(~F.col("path").contains(f"/{name}/"))
    return files.select(F.xxhash64("path").alias("file_id"), "path", "content", F.sha2("content", 256).alias("content_hash"), F.lit(origin).alias("origin"), is_test_path(F.col("path")).alias("is_test"))


def with_dependencies(sources: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Sources of a project and of its libraries, those without their tests."""
    return sources.unionByName(dependencies.where(~F.col("is_test")).withColumn("origin", F.lit("dep")))


def lines_of(texts: DataFrame, key: str = "file_id", text: str = "content") -> DataFrame:
    """``(key, line_no, text)`` with 1-based lines."""
    return texts.select(key, F.posexplode(split_lines(F.col(text))).alias("pos", "text")).select(key, (F.col("pos") + 1).cast("long").alias("line_no"), "text")


def file_stats(lines: DataFrame, key: str, contract_prefixes: list[str], function_prefixes: list[str]) -> DataFrame:
    """Lines, characters, bytes and declarations of each file, by how lines begin."""
    begins = lambda prefixes: F.count_if(F.expr(" or ".join(f"startswith(t, '{p}')" for p in prefixes))).alias
    return (
        lines.withColumn("t", trim_all(F.col("text")))
        .groupBy(key)
        .agg(F.count("*").alias("n_lines"), F.sum(F.length("text")).alias("n_chars"), F.sum(F.octet_length("text")).alias("n_bytes"), begins(contract_prefixes)("n_contracts"), begins(function_prefixes)("n_functions"))
    )


def declarations(lines: DataFrame, key: str, prefixes: list[str]) -> DataFrame:
    """``(key, line_no, kind, name)`` of lines that begin with a prefix and a name."""
    begins = "|".join(p.replace(".", r"\.") for p in prefixes)
    kind = F.regexp_extract("text", rf"^\s*({begins}) +(\w+)", 1)
    return lines.select(key, "line_no", kind.alias("kind"), F.regexp_extract("text", rf"^\s*({begins}) +(\w+)", 2).alias("name")).where("kind <> ''")
