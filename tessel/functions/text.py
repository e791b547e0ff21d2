"""Text helpers on columns; white space is that of Python's ``str.strip`` for ASCII."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+\z", "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+\z", "")


def collapse(text: Column) -> Column:
    """Runs of white space as one space, ends stripped."""
    return strip(F.regexp_replace(text, r"\s+", " "))


def clip(text: Column, size: int = 100) -> Column:
    """At most ``size`` characters, an ellipsis after what was cut."""
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("…"))).otherwise(text)


def unquote(text: Column) -> Column:
    """Quotes of either kind removed from both ends."""
    return F.regexp_replace(text, "^['\"]+|['\"]+$", "")


def lines(text: Column) -> Column:
    """Lines of a text; a final line end makes no further line, an empty text has none."""
    split = F.split(text, "\r\n?|\n")
    ends = F.rlike(text, F.lit("(\r\n?|\n)\\z"))
    return (
        F.when(text == "", F.array().cast("array<string>"))
        .when(ends, F.slice(split, F.lit(1), F.size(split) - 1))
        .otherwise(split)
    )


def indent(line: Column) -> Column:
    """Leading white space characters; a tab counts one."""
    return F.length(line) - F.length(F.regexp_replace(line, r"^\s+", ""))


def count_of(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def first_line_of(text: Column, key: Column) -> Column:
    """Line (from 0) of the first occurrence of ``key``; 0 where it doesn't occur."""
    at = F.position(key, text)
    return F.when(at > 0, count_of(F.substring(text, F.lit(1), at - 1), "\n")).otherwise(F.lit(0))
