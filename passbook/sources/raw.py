"""Raw rows from page text and extracted tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from passbook.functions.text import collapse, filled, strip


def text_rows(pages: DataFrame, *keys: str) -> DataFrame:
    """pages(keys, text): (keys, row_number from 1, cells), one row for each line that isn't blank; two blanks or a tab part cells."""
    cell_parts = F.transform(F.filter(F.split(strip("line"), r"\s{2,}|\t+"), lambda c: strip(c) != ""), lambda c: strip(c))
    out = pages.select(*keys, F.posexplode(F.split(filled("text"), r"\R")).alias("_at", "line")).where(strip("line") != "")
    n = F.row_number().over(Window.partitionBy(*keys).orderBy("_at"))
    return out.select(*keys, n.alias("row_number"), F.when(F.size(cell_parts) == 0, F.array(strip("line"))).otherwise(cell_parts).alias("cells"))


def rectangular(rows: DataFrame, *keys: str) -> DataFrame:
    """rows with cells filled up with '' to their document's widest row."""
    width = F.max(F.size("cells")).over(Window.partitionBy(*keys))
    return rows.withColumn("_w", width).withColumn("cells", F.concat("cells", F.array_repeat(F.lit(""), F.col("_w") - F.size("cells")))).drop("_w")


def clean_cells(cells: Column) -> Column:
    return F.transform(cells, lambda c: collapse(filled(c)))


def clean_table(rows: DataFrame) -> DataFrame:
    """rows with white space in cells collapsed, and without rows of blank cells."""
    return rows.withColumn("cells", clean_cells(F.col("cells"))).where(F.exists("cells", lambda c: c != ""))


def choose_rows(tables: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows of tables(doc_id, page, table_no, row_no, cells), and of texts(doc_id, page, row_number, cells) on pages without tables, numbered in reading order."""
    pages = tables.select("doc_id", "page").distinct()
    rest = texts.join(pages.hint("shuffle_hash"), ["doc_id", "page"], "left_anti").select("doc_id", "page", F.lit(0).alias("table_no"), F.col("row_number").alias("row_no"), "cells")
    both = tables.select("doc_id", "page", "table_no", "row_no", "cells").unionByName(rest)
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "table_no", "row_no"))
    return both.withColumn("row_number", n)


def usable_tables(tables: DataFrame) -> DataFrame:
    """(doc_id, page, table_no) of tables with a row of three cells or more."""
    return tables.where(F.size("cells") >= 3).select("doc_id", "page", "table_no").distinct()


def pages_without_text(pages: DataFrame, tables: DataFrame) -> DataFrame:
    """Pages that have neither text nor tables, which need recognition."""
    return pages.where(strip(filled("text")) == "").join(tables.select("doc_id", "page").distinct().hint("shuffle_hash"), ["doc_id", "page"], "left_anti")


_CONTROLS = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"


def repaired_xml(payload: Column) -> Column:
    """struct(text, repairs): XML text in which forbidden characters and references to them are blanks."""
    number = r"0*(?:[0-8]|1[124-9]|2[0-9]|3[01]|11|12|55(?:29[6-9]|[3-9][0-9]{2})|5[67][0-9]{3}|6553[45])"
    hexed = r"[xX]0*(?:[0-8bBcCeEfF]|1[0-9a-fA-F]|[dD][89a-fA-F][0-9a-fA-F]{2}|[fF]{3}[eEfF])"
    reference = f"&#(?:{number}|{hexed});"
    n = F.regexp_count(payload, F.lit(reference)) + F.regexp_count(payload, F.lit(_CONTROLS))
    return F.struct(F.regexp_replace(F.regexp_replace(payload, reference, " "), _CONTROLS, " ").alias("text"), n.alias("repairs"))
