"""Queries of the training-data operators, and their SQL where DuckDB can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessel.llm import credentials, docs, handwritten, hidden_text, leakage, neighbours, repetition, splitting, syntax, tokens
from tessel.session import spread, table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Paths of generated, minified, vendored and data files."""
    return p1_kinds(spark, sf).where("kind IS NOT NULL").select("file_path").distinct()


def p1_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Every source file with its kind and measures."""
    return handwritten.classify_files(spread(table(spark, sf, "source_files").select("path", "rel_path", "content")))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of live rows of which one is among the 5 most similar of the other."""
    return neighbours.similar_pairs(table(spark, sf, "vector_store"))


def p2_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """The 5 most similar rows of every live row, with their similarity."""
    return neighbours.similar_rows(table(spark, sf, "vector_store"))


def _sources(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "source_files").select("path", "content"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Functions whose documentation is not trivial."""
    return p3_pairs(spark, sf).select("file_path", "ord")


def p3_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Functions with their documentation; trivial and missing documentation left out."""
    return docs.documented_functions(table(spark, sf, "function_info"), _sources(spark, sf))


def p3_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Functions found in the sources by lexing, with their lines and attached comments."""
    return docs.function_spans(_sources(spark, sf))


def p3_located(spark: SparkSession, sf: str) -> DataFrame:
    """Functions of the table at whose line lexing finds a function."""
    functions = table(spark, sf, "function_info").select("file_path", "ord", "line").distinct()
    python = F.lower("file_path").rlike(r"\.py[wi]?$")
    at = functions.withColumn("first", F.when(python, F.col("line") - 1).otherwise(F.col("line")))
    return at.join(p3_spans(spark, sf).select("file_path", "first").distinct(), ["file_path", "first"], "left_semi").select("file_path", "ord")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that had to be split."""
    return p4_pieces(spark, sf).where("piece = 1").select("id").distinct()


def p4_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """The pieces of oversized rows."""
    return splitting.split_items(table(spark, sf, "vector_store"))


def p4_rebuilt(spark: SparkSession, sf: str) -> DataFrame:
    """Oversized rows put together again from their pieces, and whether every piece keeps the limits."""
    pieces = p4_pieces(spark, sf).distinct()
    order = Window.partitionBy("id").orderBy("piece")
    before = F.lag(F.col("start") + F.length("content")).over(order)
    own = pieces.withColumn("overlap", F.coalesce(before - F.col("start"), F.lit(0)))
    fits = (F.length("content") <= splitting.LIMIT) & F.col("overlap").between(0, splitting.OVERLAP)
    part = F.struct("piece", F.expr("substring(content, overlap + 1)").alias("text"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["text"]), "")
    return own.groupBy("id").agg(F.md5(whole).alias("content"), F.bool_and(fits).alias("fits"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Files that do not parse in the language of their name."""
    return p5_faults(spark, sf).select("file_path").distinct()


def p5_faults(spark: SparkSession, sf: str) -> DataFrame:
    """Faulty files with the cost, kind and place of their least repair."""
    return syntax.unparsable_files(spread(table(spark, sf, "source_files").select("path", "content")))


def p5_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Share of files that do not parse, per repository and language."""
    return syntax.fault_rates(table(spark, sf, "source_files"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Languages other than English that a row's comments and strings hold a sentence of."""
    rows = spread(table(spark, sf, "vector_store").select("id", "content"))
    return hidden_text.hidden_texts(rows).select("id", "nl_lang").distinct()


def p6_texts(spark: SparkSession, sf: str) -> DataFrame:
    """The sentences themselves, English ones included."""
    return hidden_text.hidden_texts(spread(table(spark, sf, "vector_store").select("id", "content")), english=True)


def p6_docstrings(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences in docstrings of functions."""
    functions = table(spark, sf, "function_info").select(F.struct("file_path", "ord").alias("key"), "docstring")
    return hidden_text.hidden_texts(functions, "key", "docstring").select("id.*", "nl_lang", "text").distinct()


def p6_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Share of each file that is text in a language."""
    return hidden_text.language_shares(table(spark, sf, "vector_store"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """Lines on which a credential's value starts."""
    return p7_places(spark, sf).select("id", "line_no").distinct()


def p7_places(spark: SparkSession, sf: str) -> DataFrame:
    """Every credential with its kind, place and proof."""
    return credentials.find_credentials(spread(table(spark, sf, "vector_store").select("id", "content")))


def p7_redacted(spark: SparkSession, sf: str) -> DataFrame:
    """The texts that hold credentials, with the values replaced."""
    return credentials.redact_credentials(table(spark, sf, "vector_store"))


def p7_rescan(spark: SparkSession, sf: str) -> DataFrame:
    """Credentials found once more in the redacted texts; there must be none."""
    return credentials.find_credentials(p7_redacted(spark, sf)).select("id", "line_no")


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Token ids of every document."""
    return tokens.encode_corpus(spread(table(spark, sf, "documents").select("doc_id", "text")))


def p8_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Every text decoded again from its token ids."""
    return tokens.decode_corpus(p8_ids(spark, sf)).select("doc_id", F.md5("text").alias("text"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents holding at least 13 consecutive words of an evaluation item."""
    return p9_matches(spark, sf).where(F.col("longest_run") >= leakage.WINDOW).select("doc_id", "item_id")


def p9_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Aligned pairs of documents and evaluation items."""
    return leakage.leaked_items(spread(table(spark, sf, "documents").select("doc_id", "text")), table(spark, sf, "eval_items"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with at least 30 % repeated words."""
    return repetition.repeated_documents(spread(table(spark, sf, "documents").select("doc_id", "text")))


def p10_fertility(spark: SparkSession, sf: str) -> DataFrame:
    """Fertility figures and repeated share of every document."""
    return repetition.measure_repetition(spread(table(spark, sf, "documents").select("doc_id", "text")))


def p10_shares(spark: SparkSession, sf: str) -> DataFrame:
    """The share of repeated words of every document."""
    return p10_fertility(spark, sf).select("doc_id", "n_words", F.round("repeated_share", 6).alias("repeated_share")).distinct()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (p1_found, p1_kinds, p2_found, p2_neighbours, p3_found, p3_pairs, p3_spans, p3_located, p4_found, p4_pieces, p4_rebuilt, p5_found, p5_faults, p5_rates, p6_found, p6_texts, p6_docstrings, p6_shares, p7_found, p7_places, p7_redacted, p7_rescan, p8_ids, p8_texts, p9_found, p9_matches, p10_found, p10_fertility, p10_shares)
    }


_WORDS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+')"
_COSINE = """
WITH live AS (SELECT id, namespace, project_id, CAST(embedding AS DOUBLE[]) AS e FROM (
    SELECT * FROM vector_store QUALIFY row_number() OVER (PARTITION BY namespace, project_id, chunk_id ORDER BY created_at DESC NULLS LAST, id DESC) = 1)
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
near AS (SELECT a.id, b.id AS neighbour, round(list_cosine_similarity(a.e, b.e), 6) AS similarity FROM live a JOIN live b
    ON a.namespace = b.namespace AND a.project_id = b.project_id AND a.id <> b.id
    QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY round(list_cosine_similarity(a.e, b.e), 6) DESC, b.id) <= 5)
"""
_REPEATED = f"""
WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS l FROM documents),
g AS (SELECT doc_id, i, array_to_string(l[i:i + 7], ' ') AS gram FROM (SELECT doc_id, l, unnest(range(1, len(l) - 6)) AS i FROM w)),
again AS (SELECT doc_id, i FROM g QUALIFY row_number() OVER (PARTITION BY doc_id, gram ORDER BY i) > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM again) GROUP BY 1),
s AS (SELECT DISTINCT doc_id, len(l) AS n_words, coalesce(n, 0) / greatest(len(l), 1) AS share FROM w LEFT JOIN c USING (doc_id))
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": _COSINE + "SELECT DISTINCT least(id, neighbour) AS id_a, greatest(id, neighbour) AS id_b FROM near",
        "p2_neighbours": _COSINE + "SELECT * FROM near",
        "p3_located": "SELECT DISTINCT file_path, ord FROM function_info",
        "p4_found": "SELECT id FROM vector_store WHERE length(content) > 1500 GROUP BY id",
        "p4_rebuilt": "SELECT DISTINCT id, md5(content) AS content, true AS fits FROM vector_store WHERE length(content) > 1500",
        "p7_rescan": "SELECT id, CAST(1 AS INTEGER) AS line_no FROM vector_store WHERE false",
        "p8_texts": "SELECT doc_id, md5(coalesce(text, '')) AS text FROM documents",
        "p10_found": _REPEATED + "SELECT doc_id FROM s WHERE share >= 0.3",
        "p10_shares": _REPEATED + "SELECT doc_id, n_words, round(share, 6) AS repeated_share FROM s",
    }
