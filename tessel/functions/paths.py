"""Path arithmetic on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def base_name(path: Column) -> Column:
    """What follows the last slash."""
    return F.substring_index(path, "/", -1)


def dir_name(path: Column) -> Column:
    """What precedes the last slash; empty where there is none."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def extension(path: Column) -> Column:
    """Extension with its dot, as written; leading dots of a name start no extension."""
    return F.regexp_extract(base_name(path), r"^\.*[^.].*?(\.[^.]*)$", 1)


def stem(path: Column) -> Column:
    """The base name without its extension."""
    name, ext = base_name(path), extension(path)
    return F.substring(name, F.lit(1), F.length(name) - F.length(ext))


def dotted_last(name: Column) -> Column:
    """What follows the last dot of a qualified name."""
    return F.substring_index(name, ".", -1)


def normalize(path: Column) -> Column:
    """``.``, ``..`` and doubled slashes folded, like a POSIX path normaliser; an empty path is ``.``."""
    rooted = path.startswith("/")
    empty = F.array().cast("array<string>")

    def step(acc: Column, part: Column) -> Column:
        top = F.element_at(acc, -1)
        climb = (part == "..") & (F.size(acc) > 0) & (F.coalesce(top, F.lit("..")) != "..")
        return (
            F.when((part == "") | (part == "."), acc)
            .when(climb, F.slice(acc, F.lit(1), F.size(acc) - 1))
            .when((part == "..") & rooted, acc)
            .otherwise(F.concat(acc, F.array(part)))
        )

    def fold(acc: Column, part: Column) -> Column:
        # element_at fails on an empty array, so the empty case is taken apart
        return F.when(
            F.size(acc) == 0,
            F.when((part == "") | (part == ".") | ((part == "..") & rooted), acc).otherwise(F.concat(acc, F.array(part))),
        ).otherwise(step(acc, part))

    joined = F.array_join(F.aggregate(F.split(path, "/"), empty, fold), "/")
    return F.when(rooted, F.concat(F.lit("/"), joined)).when(joined == "", F.lit(".")).otherwise(joined)
