"""Regular-expression fragments with the meaning they have in the operators' specification, where it differs from Java's.

White space includes NBSP, every space separator and U+FEFF; word boundaries are ASCII; the end is the absolute end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WS_CHARS = r"\t\n\x0B\f\r    -     　﻿"
WS = f"[{WS_CHARS}]"
START = "(?<![A-Za-z0-9_])"
END = "(?![A-Za-z0-9_])"


def trim(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{WS}+|{WS}+\z", "")


def squeeze(c: Column) -> Column:
    """Runs of white space become one space; ends are trimmed."""
    return trim(F.regexp_replace(c, f"{WS}+", " "))


def rounded(c: Column) -> Column:
    """Halves go up."""
    return F.floor(c + 0.5)


def utf16_length(c: Column) -> Column:
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is evaluated once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def rebuild(c: Column, pattern: str, replacement: Callable[[Column], Column]) -> Column:
    """Every match of the pattern replaced by a function of it; what lies between stays."""
    between = F.split(c, pattern, -1)
    matches = F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), lambda m: replacement(m))
    paired = F.zip_with(between, matches, lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))))
    return F.array_join(paired, "")
