"""Bank templates: detection by keywords and lookup by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passbook.functions.text import collapse, strip
from passbook.operators.literals import candidates
from passbook.sources.steps import small, written

#: Characters at a statement's beginning where a keyword counts most.
HEADER_CHARS = 2000


def detect(documents: DataFrame, templates: DataFrame) -> DataFrame:
    """documents(doc_id, text) and templates(pos, template_id, detection_keywords): (doc_id, template_id) of the best template.

    Most keywords in the beginning, then most in all, then the longest keyword, then the first
    template. Keywords of up to three letters or digits must stand alone. Documents without one are left out.
    An index of the keywords says which of them a document may hold; only those are looked for in it.
    """
    words = templates.select("pos", "template_id", F.explode("detection_keywords").alias("raw")).withColumn("word", collapse(F.lower("raw"))).where("word <> ''")
    text = F.regexp_replace(F.lower("text"), r"(?U)\s+", " ")
    docs = documents.select("doc_id", text.alias("t"))
    maybe = written(candidates(docs.select(F.col("doc_id").alias("key"), F.col("t").alias("text")), words).withColumnRenamed("key", "doc_id"), "maybe")
    docs = docs.withColumn("head", F.substring("t", 1, HEADER_CHARS)).join(maybe.hint("shuffle_hash"), "doc_id")
    alone = (F.length("word") <= 3) & F.col("word").rlike("^[\\p{L}\\p{N}]+$")
    border = F.concat(F.lit("(?<![a-z0-9])"), "word", F.lit("(?![a-z0-9])"))
    inside = lambda c: F.when(alone, F.regexp_like(F.col(c), border)).otherwise(F.contains(F.col(c), F.col("word")))
    hits = docs.join(small(words), "word").where(inside("t")).select("doc_id", "pos", "template_id", inside("head").alias("early"), F.length("raw").alias("n"))
    scored = hits.groupBy("doc_id", "pos", "template_id").agg(F.count_if("early").alias("early"), F.count("*").alias("all"), F.max("n").alias("n"))
    return scored.groupBy("doc_id").agg(F.max_by("template_id", F.struct("early", "all", "n", -F.col("pos"))).alias("template_id"))


def by_bank(names: DataFrame, templates: DataFrame) -> DataFrame:
    """names(bank_name) with template_id: the first template of that bank, whatever the case; null if there is none."""
    first = templates.groupBy(F.lower("bank_name").alias("_key")).agg(F.min_by("template_id", "pos").alias("template_id"))
    return names.withColumn("_key", F.lower(strip("bank_name"))).join(first, "_key", "left").select(*names.columns, "template_id")
