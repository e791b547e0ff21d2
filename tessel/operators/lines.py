"""Windows over the lines of texts: frames, bodies, sections and comments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessel.functions import text as T


def exploded(texts: DataFrame, text_col: str, *keys: str) -> DataFrame:
    """One row ``(keys, ln, line)`` per line, counted from 0; null texts have none."""
    return texts.select(*keys, F.posexplode(T.lines(F.col(text_col))).alias("ln", "line"))


def frame(all_lines: Column, start: Column, before: int = 10, after: int = 30) -> Column:
    """Lines ``[start - before, start + after)`` joined, right-stripped, with one final line end.

    A slice of the text's own array: no explosion and no shuffle.
    """
    low = F.greatest(F.lit(0), start - before)
    high = F.least(F.size(all_lines), start + after)
    part = F.when(high > low, F.slice(all_lines, low + 1, high - low)).otherwise(F.array().cast("array<string>"))
    return F.concat(T.rstrip(F.array_join(part, "\n")), F.lit("\n"))


def body_end_by_indent(all_lines: Column, start: Column, reach: int = 200) -> Column:
    """End (exclusive) of a body that ends before the next non-blank line not deeper than its first."""
    base = T.indent(F.get(all_lines, start))
    high = F.least(F.size(all_lines), start + reach)
    later = F.when(high > start + 1, F.slice(all_lines, start + 2, high - start - 1)).otherwise(F.array().cast("array<string>"))
    flags = F.transform(later, lambda x: (T.strip(x) != "") & (T.indent(x) <= base))
    at = F.array_position(flags, True)
    return F.when(at > 0, (start + at).cast("int")).otherwise(high)


def body_end_by_braces(all_lines: Column, start: Column, reach: int = 300, default: int = 30) -> Column:
    """End (exclusive) of a body that ends on the line where the braces opened since ``start`` are closed.

    The first place where the running balance is zero again after an opening brace decides, also inside a
    line; strings and comments are not special. Without one the default window counts.
    """
    high = F.least(F.size(all_lines), start + reach)
    part = F.when(high > start, F.slice(all_lines, start + 1, high - start)).otherwise(F.array().cast("array<string>"))
    marks = F.split(F.regexp_replace(F.array_join(part, "\n"), r"[^{}\n]", ""), "")
    state = F.struct(
        F.lit(0).alias("depth"), F.lit(False).alias("open"), F.lit(0).alias("line"), F.lit(-1).alias("end")
    )

    def step(s: Column, c: Column) -> Column:
        depth = s["depth"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)
        opened = s["open"] | (c == "{")
        closed = (s["end"] < 0) & (c == "}") & opened & (depth == 0)
        return F.struct(
            depth.alias("depth"), opened.alias("open"), (s["line"] + F.when(c == "\n", 1).otherwise(0)).alias("line"),
            F.when(closed, s["line"]).otherwise(s["end"]).alias("end"),
        )

    end = F.aggregate(marks, state, step)["end"]
    return F.when(end >= 0, (start + end + 1).cast("int")).otherwise(F.least(F.size(all_lines), start + default))


# The patterns of the key-value reader. RE2 and Java agree on them; ASCII classes stand for \w.
SECTION = r"^\[([^\]]+)\]"
ENTRY = r"^([A-Za-z0-9_][A-Za-z0-9_.@/-]*)\s*[=:]\s*(.*)"


def key_values(texts: DataFrame, text_col: str, *keys: str) -> DataFrame:
    """Entries of key-value texts: ``(keys, kind, name, line, signature, docstring)``.

    ``kind`` is ``section`` or ``entry``. A section holds for the keys after it (last value carried forward
    over the lines); a comment belongs to an entry on the very next line (lag). Other non-blank lines are
    entries named by their first 60 characters.
    """
    rows = exploded(texts, text_col, *keys).withColumn("line_text", T.strip(F.col("line")))
    order = Window.partitionBy(*keys).orderBy("ln")
    t = F.col("line_text")
    comment = t.rlike("^[#;]")
    section = F.regexp_extract(t, SECTION, 1)
    key, value = F.regexp_extract(t, ENTRY, 1), F.regexp_extract(t, ENTRY, 2)
    marked = (
        rows.withColumn("comment", F.when(comment, T.strip(F.regexp_replace(t, "^[#;]+", ""))))
        .withColumn("head", F.when(~comment & (section != ""), section))
        .withColumn("key", F.when(~comment & (section == ""), F.nullif(key, F.lit(""))))
        .withColumn("value", T.unquote(T.strip(value)))
        .withColumn("in_section", F.last("head", ignorenulls=True).over(order))
        .withColumn("above", F.lag("comment").over(order))
    )
    named = F.when(F.col("in_section").isNotNull(), F.concat("in_section", F.lit("."), "key")).otherwise(F.col("key"))
    kind = F.when(F.col("head").isNotNull(), "section").otherwise("entry")
    name = F.coalesce(F.col("head"), named, F.substring(t, 1, 60))
    signature = F.when(F.col("head").isNotNull(), F.lit("")).otherwise(
        F.coalesce(F.concat("key", F.lit(" = "), T.clip(F.col("value"))), F.substring(t, 1, 120))
    )
    doc = F.when(F.col("key").isNotNull(), F.coalesce("above", F.lit(""))).otherwise(F.lit(""))
    return marked.where(~comment & (t != "")).select(
        *keys, kind.alias("kind"), name.alias("name"), F.col("ln").alias("line"), signature.alias("signature"), doc.alias("docstring")
    )


# Words that open no function, and the heads of shell functions, aliases, source and include lines.
SHELL_KEYWORDS = (
    "if", "while", "for", "case", "until", "do", "then", "else", "elif", "fi", "done", "esac", "in", "select", "time", "coproc",
)
SHELL_WORD = r"^function\s+([A-Za-z0-9_][A-Za-z0-9_.-]*)\s*(?:\(\s*\))?\s*\{"
SHELL_BARE = r"^([A-Za-z0-9_][A-Za-z0-9_.-]*)\s*\(\s*\)\s*\{"
SHELL_ALIAS = r"^alias\s+([A-Za-z0-9_][A-Za-z0-9_.-]*)\s*=\s*(?:'([^']*)'|\"([^\"]*)\"|(\S+))"
SHELL_SOURCE = r"^(?:source|\.)\s+(['\"]?)(.*?)\1\s*$"
CONFIG_INCLUDE = r"(?i)^(?:include(?:path|optional)?\s+|source\s+|\.\s+)(\S+)"


def shell_symbols(texts: DataFrame, text_col: str, *keys: str) -> DataFrame:
    """Functions and aliases of shell texts: ``(keys, name, line, signature, docstring)``; lines from 0.

    Both function forms, the keyword form first, once per name; aliases each. The comment is the run of ``#``
    lines above, blank lines skipped. Pure windows over lines.
    """
    rows = exploded(texts, text_col, *keys)
    order = Window.partitionBy(*keys).orderBy("ln")
    line, bare = F.col("line"), T.strip(F.col("line"))
    noted = (
        rows.withColumn("note", F.when(bare.startswith("#"), T.strip(F.substring(bare, 2, 1_000_000))))
        .withColumn("stop", F.when(~bare.startswith("#") & (bare != ""), F.col("ln")))
        .withColumn("since", F.last("stop", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    )
    block = Window.partitionBy(*keys, "since").orderBy("ln").rowsBetween(Window.unboundedPreceding, -1)
    docs = noted.withColumn("doc", F.array_join(F.collect_list("note").over(block), " "))
    form, plain, alias = SHELL_WORD, SHELL_BARE, SHELL_ALIAS
    word, short, name = (F.regexp_extract(line, p, 1) for p in (form, plain, alias))
    value = F.coalesce(*(F.nullif(F.regexp_extract(line, alias, g), F.lit("")) for g in (2, 3, 4)), F.lit(""))
    kinds = (
        F.when(word != "", F.struct(F.lit(1).alias("rank"), word.alias("name"), T.strip(F.regexp_replace(F.regexp_extract(line, form, 0), r"\{+$", "")).alias("signature")))
        .when((short != "") & ~short.isin(*SHELL_KEYWORDS), F.struct(F.lit(2).alias("rank"), short.alias("name"), T.strip(F.regexp_replace(F.regexp_extract(line, plain, 0), r"\{+$", "")).alias("signature")))
        .when(name != "", F.struct(F.lit(3).alias("rank"), F.concat(F.lit("alias:"), name).alias("name"), F.concat(F.lit("alias "), name, F.lit("='"), value, F.lit("'")).alias("signature")))
    )
    found = docs.withColumn("k", kinds).where(F.col("k").isNotNull())
    first = Window.partitionBy(*keys, "k.name", F.col("k.rank") == 3).orderBy("k.rank", "ln")
    kept = found.withColumn("nth", F.row_number().over(first)).where((F.col("nth") == 1) | (F.col("k.rank") == 3))
    return kept.select(*keys, "k.name", F.col("ln").alias("line"), "k.signature", F.col("doc").alias("docstring"))


def shell_imports(texts: DataFrame, text_col: str, *keys: str) -> DataFrame:
    """``(keys, line, import)`` of ``source`` and ``.`` lines, quotes removed."""
    rows = exploded(texts, text_col, *keys)
    got = F.regexp_extract("line", SHELL_SOURCE, 2)
    return rows.select(*keys, F.col("ln").alias("line"), T.strip(got).alias("import")).where(F.col("import") != "")


def config_imports(texts: DataFrame, text_col: str, *keys: str) -> DataFrame:
    """``(keys, line, import)`` of include and source lines of configuration texts, quotes removed."""
    rows = exploded(texts, text_col, *keys)
    got = F.regexp_extract("line", CONFIG_INCLUDE, 1)
    return rows.select(*keys, F.col("ln").alias("line"), T.unquote(got).alias("import")).where(F.col("import") != "")
