"""Markdown structure: sections, tables, paragraphs and atomic spans, with character offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import text as X


def line_rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, pos, line, start, stop, total): lines with their offsets; stop counts the line break. ids are unique.

    A line's offset is a running sum over its document's lines, linear in their number, and lies in the partitioning by id that sections and spans need anyway.
    """
    lines = F.split(X.text_of(F.col(text_col)), "\n", -1)
    rows = df.select(F.col(id_col).alias("id"), F.length(X.text_of(F.col(text_col))).alias("total"), F.posexplode(lines).alias("pos", "line"))
    before = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)).cast("int"))
    return rows.select("id", "pos", "line", "start", F.least(F.col("start") + F.length("line") + 1, F.col("total")).alias("stop"), "total")


def heading_sections(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, ordinal, level, title, start_char, end_char): each heading up to the next one. What stands before the first
    heading is '(preamble)' if not blank; a text without headings is one '(document)'; an empty text has no section.
    """
    heading = r"^(#{1,6})[ \t]+(.+?)[ \t]*$"
    lines = line_rows(df, id_col, text_col)
    heads = lines.where(F.col("line").rlike(heading)).select(
        "id", "total", F.length(F.regexp_extract("line", heading, 1)).alias("level"), F.regexp_extract("line", heading, 2).alias("title"), F.col("start").alias("start_char")
    )
    first = heads.groupBy("id").agg(F.min("start_char").alias("first"))
    docs = df.select(F.col(id_col).alias("id"), X.text_of(F.col(text_col)).alias("text")).where("length(text) > 0").join(first, "id", "left")
    before = F.when(F.col("first").isNull(), F.col("text")).otherwise(F.expr("substring(text, 1, first)"))
    opening = docs.where(F.col("first").isNull() | (F.trim(F.regexp_replace(before, r"\s+", " ")) != "")).select(
        "id", F.length("text").alias("total"), F.lit(0).alias("level"),
        F.when(F.col("first").isNull(), "(document)").otherwise("(preamble)").alias("title"), F.lit(0).alias("start_char"),
    )
    w = Window.partitionBy("id").orderBy("start_char")
    return opening.unionByName(heads).select(
        "id", (F.row_number().over(w) - 1).alias("ordinal"), "level", "title", "start_char",
        F.coalesce(F.lead("start_char").over(w), F.col("total")).alias("end_char"),
    )


def _runs(lines: DataFrame, inside) -> DataFrame:
    """(id, start_char, end_char) of maximal runs of lines for which inside holds."""
    marked = lines.withColumn("in", inside)
    w = Window.partitionBy("id").orderBy("pos")
    grouped = marked.withColumn("run", F.row_number().over(w) - F.row_number().over(Window.partitionBy("id", "in").orderBy("pos")))
    return grouped.where("in").groupBy("id", "run").agg(F.min("start").alias("start_char"), F.max("stop").alias("end_char")).drop("run")


def _is_table(line):
    return (F.trim(line) != "") & F.contains(line, F.lit("|"))


def table_spans(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Runs of consecutive lines that aren't blank and have a pipe."""
    return _runs(line_rows(df, id_col, text_col), _is_table(F.col("line")))


def paragraph_spans(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Runs of lines that are neither blank nor of a table, without the last line's break where a blank line and another one follow."""
    lines = line_rows(df, id_col, text_col)
    w = Window.partitionBy("id").orderBy("pos")
    lines = lines.withColumns({"next": F.lead("line").over(w), "more": F.lead("pos", 2).over(w).isNotNull()})
    blank_after = F.col("more") & (F.trim("next") == "")
    lines = lines.withColumn("stop", F.when(blank_after, F.col("start") + F.length("line")).otherwise(F.col("stop")))
    return _runs(lines, (F.trim("line") != "") & ~_is_table(F.col("line")))


def atomic_spans(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Tables and paragraphs, tagged by kind; they don't overlap."""
    tables = table_spans(df, id_col, text_col).withColumn("kind", F.lit("table"))
    return tables.unionByName(paragraph_spans(df, id_col, text_col).withColumn("kind", F.lit("paragraph")))
