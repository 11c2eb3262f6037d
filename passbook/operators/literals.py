"""Which texts may hold which of many words: an index of each word's rarest string of four characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passbook.sources.steps import small, written

#: Characters of an index entry; shorter words are entries themselves. Characters of a piece of a long text.
GRAM, PIECE = 4, 4096
#: Index entries up to which each text is asked for them all; with more, its own strings are looked up.
FEW = 64


def grams(text: Column | str, n: int | Column) -> Column:
    """A text's strings of n characters, one for each place; none if it is shorter."""
    c = F.col(text) if isinstance(text, str) else text
    if isinstance(n, int):
        # one pass; a substring at each place would count the characters before it each time
        return F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{n}}}))"), 1)
    return F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substr(c, i, n))).otherwise(F.array().cast("array<string>"))


def candidates(texts: DataFrame, words: DataFrame) -> DataFrame:
    """(key, word) of texts(key, text) and the distinct words(word), at least those where the text contains the word.

    A word is looked for where the entry occurs that fewest words share, so no text meets every word.
    A few entries are looked for in each text as they are. With more, texts are cut to pieces that overlap by an entry, and only keys travel with the entries. Empty words are
    left out. The caller joins the text again and decides.
    """
    known = words.select("word").where("word <> ''").distinct().withColumn("n", F.least(F.length("word"), F.lit(GRAM)))
    held = written(known.select("word", "n", F.explode(F.array_distinct(grams("word", F.col("n")))).alias("gram")), "grams")
    often = held.groupBy("gram").agg(F.count("*").alias("k"))
    rare = written(held.join(often.hint("merge"), "gram").groupBy("word").agg(F.min_by("gram", F.struct("k", "gram")).alias("gram")), "rare")
    entries = [r.gram for r in rare.select("gram").distinct().limit(FEW + 1).collect()]
    if len(entries) <= FEW:
        held = F.array_compact(F.array(*(F.when(F.contains("text", F.lit(g)), F.lit(g)) for g in entries))) if entries else F.array().cast("array<string>")
        return texts.select("key", F.explode(held).alias("gram")).join(small(rare), "gram").select("key", "word").distinct()
    sizes = [r.n for r in held.select("n").distinct().collect()]  # 1 to GRAM
    count = F.ceil(F.length("text") / PIECE).cast("int")
    pieces = texts.select("key", F.explode(F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), count - 1)), lambda i: F.substr("text", i * PIECE + 1, F.lit(PIECE + GRAM - 1)))).alias("piece"))
    found = F.array_distinct(F.flatten(F.array(*(grams("piece", n) for n in sizes)))) if sizes else F.array().cast("array<string>")
    return pieces.select("key", F.explode(found).alias("gram")).join(small(rare), "gram").select("key", "word").distinct()
