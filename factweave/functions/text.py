"""Text functions as column expressions, and the string-aware strippers as Arrow functions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType


def split_lines(text: Column) -> Column:
    """Lines as most languages see them: a final line end is no line of its own and carriage returns are dropped."""
    return F.split(F.regexp_replace(text, r"\r?\n$", ""), r"\r?\n")


def trim_all(text: Column) -> Column:
    """Trims every kind of white space, not only blanks."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def is_comment(line: Column) -> Column:
    trimmed = trim_all(line)
    return trimmed.startswith("//") | trimmed.startswith("*") | trimmed.startswith("/*")


def contains_any(text: Column, literals: list[str]) -> Column:
    """An OR of literal tests, or one alternation when there are many."""
    if not literals:
        return F.lit(False)
    if len(literals) > 24:
        return text.rlike("|".join(re.escape(x) for x in literals))
    out = text.contains(literals[0])
    for x in literals[1:]:
        out = out | text.contains(x)
    return out


def contains_all(text: Column, literals: list[str]) -> Column:
    out = F.lit(True)
    for x in literals:
        out = out & text.contains(x)
    return out


def count_of(text: Column, literal: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(literal), F.lit("")))) / len(literal)).cast("long")


#: One token of source text: strings first, so that comment marks inside them stay.
_PIECES = re.compile(r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|//[^\n]*|/\*.*?(?:\*/|\Z)', re.S)


def strip_comments_text(source: str | None) -> str | None:
    """Comments become white space of the same line count; strings stay."""
    if source is None:
        return None
    return _PIECES.sub(lambda m: re.sub(r"[^\n]", " ", m[0]) if m[0][0] == "/" else m[0], source)


def strip_strings_text(source: str | None) -> str | None:
    """The insides of string literals become white space; comments are taken as code."""
    if source is None:
        return None
    return re.sub(r'"((?:\\.|[^"\\\n])*)"|\'((?:\\.|[^\'\\\n])*)\'', lambda m: m[0][0] + " " * (len(m[0]) - 2) + m[0][-1], source)


def clean_source_text(source: str | None) -> str | None:
    return strip_strings_text(strip_comments_text(source))


def _vectorised(f):
    @F.pandas_udf(StringType())
    def g(text: pd.Series) -> pd.Series:
        return text.map(f, na_action="ignore")

    return g


strip_comments = _vectorised(strip_comments_text)
strip_strings = _vectorised(strip_strings_text)
clean_source = _vectorised(clean_source_text)


def version(text: Column) -> Column:
    """``major.minor.patch`` as a struct that compares in order; null where there is none."""
    part = lambda i: F.try_to_number(F.regexp_extract(text, r"(\d+)\.(\d+)(?:\.(\d+))?", i), F.lit("999999")).cast("int")
    return F.when(text.rlike(r"\d+\.\d+"), F.struct(part(1).alias("major"), part(2).alias("minor"), F.coalesce(part(3), F.lit(0)).alias("patch")))
