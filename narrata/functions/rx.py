"""Regex helpers: replacement by a function of the match, Unicode trimming, and the dialects of Java and RE2."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Java: \w, \s and \b by Unicode; case folding by Unicode too where (?i) is used.
U = "(?U)"
#: White space as Python's str.strip and \s take it; \x1c-\x1f are not in Java's class.
WHITE = r"\s\x1c-\x1f"


def sub(x: Column, pattern: str, by: str) -> Column:
    """regexp_replace with a Unicode-aware pattern."""
    return F.regexp_replace(x, U + pattern, by)


def sub_with(x: Column, pattern: str, f: Callable[[Column], Column]) -> Column:
    """Every match of pattern becomes f(match): the text between matches and the matches are zipped and joined."""
    gaps, hits = F.split(x, U + pattern, -1), F.regexp_extract_all(x, F.lit(U + pattern), F.lit(0))
    return F.array_join(F.zip_with(gaps, F.transform(hits, f), lambda g, h: F.concat(g, F.coalesce(h, F.lit("")))), "")


def strip(x: Column, chars: str = WHITE) -> Column:
    return F.regexp_replace(x, rf"{U}\A[{chars}]+|[{chars}]+\z", "")


def group(x: Column, pattern: str, i: int) -> Column:
    return F.regexp_extract(x, U + pattern, i)


def count_of(x: Column, chars: str) -> Column:
    """How many characters of x are in a class."""
    return F.length(F.regexp_replace(x, rf"{U}[^{chars}]", ""))
