"""Document fingerprints by SpotSigs, in DataFrame functions alone.

A common word is an anchor; the two content words that follow it (other common words in between
are skipped) form with it a signature. A run of common words counts as its last one. Three content
words in a row, which no anchor parts, are a signature as well, so that lists of words have some; each
signature follows from the words around it alone. A text with neither is one signature. The set of hashed signatures is a text's fingerprint, and the Jaccard index of two
sets their likeness. Near pairs are found in partitions by set length: a set can only match sets
whose length differs by less than the threshold allows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from passbook.llm.common import shuffle_partitions, stored

# fixed values: frequent function words
ANCHORS = {
    "en": "the of and a to in is it that for was on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if".split(),
    "de": "der die und das ist den von zu mit sich des auf ein eine dem nicht auch es an als im war bei aus".split(),
    "fr": "le la les de et des un une du en que est pour qui dans par sur au plus ne se pas il elle".split(),
    "es": "el los las del y que una con por su no se lo al como más pero sus ya o este sí porque esta".split(),
}


def _words(text: Column) -> Column:
    """Words in lower case between single blanks, with a blank at either end."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[\s\p{Punct}]+", " ")), F.lit(" "))


def signatures(text: Column) -> Column:
    """The sorted distinct hashes of a text's signatures; a null text counts as empty and has one, like any without words."""
    anchors = "|".join(sorted({w for ws in ANCHORS.values() for w in ws}))
    words = _words(F.coalesce(text, F.lit("")))
    # no group repeats in these patterns, as each turn of one would take stack
    marked = F.regexp_replace(words, f" ({anchors})(?= )", "\x01$1")
    chain, row = "\x01(?=([^ \x01]+ [^ \x01]+(?:\x01[^ ]*)? [^ \x01]+))", " (?=([^ \x01]+ [^ \x01]+ [^ \x01]+))"
    # a transform over an array of one, so that what is used twice is made once
    both = F.transform(F.array(marked), lambda m: F.array_join(F.concat(F.regexp_extract_all(m, F.lit(chain), 1), F.regexp_extract_all(m, F.lit(row), 1)), "\n"))
    plain = F.transform(both, lambda t: F.regexp_replace(t, "\x01[^ \n]+", ""))
    hashed = F.transform(plain, lambda t: F.array_sort(F.array_distinct(F.transform(F.split(F.when(t == "", words).otherwise(t), "\n"), lambda s: F.xxhash64(s)))))
    return F.get(hashed, F.lit(0))


def fingerprint(sigs: Column) -> Column:
    """A digest of a set of signatures."""
    return F.sha2(F.array_join(sigs.cast("array<string>"), ","), 256)


def likeness(a: Column, b: Column) -> Column:
    """Jaccard index of two sets of signatures."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def with_next(docs: DataFrame, carried: list[str], extend: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """extend(docs) with next: a struct of the carried columns and of those that extend adds, of the next row by descending doc_id; the last row's is the first row.

    Rows lie in buckets of neighbouring ids, so a row's next one is in its bucket or, for a bucket's
    last row, heads the next bucket that has rows. Null ids come last; equal ids are ordered by a hash of the
    carried columns, then by these, and an id that many rows have is parted by that hash. Of a single row
    the next is itself. extend adds what follows from the carried columns.
    """
    spark = docs.sparkSession
    n = 4 * max(16, shuffle_partitions(spark))
    coarse = min(n, 256)
    fine = -(-n // coarse)
    # at most 257 cut points; between two of them a bucket is a fixed share
    found, nulls, total = docs.agg(F.percentile_approx("doc_id", [i / coarse for i in range(coarse + 1)], 10_000), F.count_if(F.col("doc_id").isNull()), F.count("*")).first()
    every_cut = [int(c) for c in found or []]
    cuts = sorted(set(every_cut))
    # an id that is several cut points has about so many shares of the rows
    hot = {c: every_cut.count(c) * fine for c in cuts if every_cut.count(c) > 2}
    at, turn = F.col("doc_id"), F.xxhash64(*carried)
    part = lambda n: F.least(F.lit(n - 1), F.floor((turn / 2.0**64 + 0.5) * n).cast("int"))
    bucket = F.lit(0).cast("long")
    if cuts:
        low = F.array(*(F.lit(c).cast("long") for c in cuts))
        k = F.greatest(F.lit(1), F.size(F.filter(low, lambda c: c <= at)))
        begin, end = F.get(low, k - 1), F.coalesce(F.get(low, k), F.get(low, k - 1) + 1)
        share = F.least(F.lit(fine - 1), F.greatest(F.lit(0), F.floor((at - begin) / (end - begin) * fine)))
        bucket = F.coalesce(k.cast("long") * fine + share, F.lit(-1).cast("long"))
    # rows of a hot id come below the other ids of their bucket
    of_hot = F.when(at.isNull(), part(max(1, -(-nulls * n // max(1, total)))))
    for c, shares in hot.items():
        of_hot = of_hot.when(at == c, part(shares))
    rows = docs.withColumn("_turn", turn).withColumn("_bucket", bucket * (1 << 20) + of_hot.otherwise((1 << 20) - 1))
    order = F.struct(F.coalesce(at, F.lit(-(2**63))).alias("i"), F.col("_turn").alias("t"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(carried)))
    heads = stored(rows.groupBy("_bucket").agg(F.max(order).alias("_head")), "heads")
    numbers = heads.select("_bucket")
    heads = extend(heads.select("_bucket", *(F.col(f"_head.c{i}").alias(c) for i, c in enumerate(carried))))
    values = [c for c in heads.columns if c != "_bucket"]
    heads = heads.select("_bucket", F.struct(*values).alias("_head"))
    # one window over the buckets' numbers alone, of which there are but some for each partition
    every = Window.orderBy("_bucket")
    last = F.last("_bucket").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    before = numbers.select("_bucket", F.coalesce(F.lag("_bucket").over(every), last).alias("_before"))
    heads = before.join(heads.withColumnRenamed("_bucket", "_before").hint("shuffle_hash"), "_before").select("_bucket", F.col("_head").alias("_over"))
    w = Window.partitionBy("_bucket").orderBy(F.coalesce(at, F.lit(-(2**63))).desc(), F.desc("_turn"), *(F.col(c).desc() for c in carried))
    # what extend adds is made behind the shuffle, so that the carried columns alone move
    led = extend(rows.repartition("_bucket")).withColumn("_lead", F.lead(F.struct(*values)).over(w))
    return led.join(heads.hint("shuffle_hash"), "_bucket", "left").withColumn("next", F.coalesce("_lead", "_over")).drop("_bucket", "_turn", "_lead", "_over")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text): doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last third (floor of n_chars / 3 code points) replaced by the first as
    many (or all) of the next document's by descending id. Null texts count as empty.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(rows, ["text"], lambda df: df.withColumn("sigs", signatures(F.col("text")))).withColumn("n_chars", F.length("text").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), F.col("n_chars").cast("int") - third), F.substr(F.col("next.text"), F.lit(1), third))
    rows = rows.withColumn("edited", edited).withColumn("edited_sigs", signatures(F.col("edited")))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("sigs")).alias("fingerprint"),
        fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        likeness(F.col("sigs"), F.col("next.sigs")).alias("near_next"),
    )


#: Sets of one prefix signature that meet each other in one group of the join; more are dealt into blocks.
BLOCK = 256


def near_pairs(docs: DataFrame, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(members(doc_id, class), pairs(a, b, likeness)): texts of equal fingerprints are a class, and pairs link classes of likeness percent / 100 or more, a < b.

    Of two sets that match, the prefixes (the first length - ceil(percent * length / 100) + 1 signatures by rarity)
    share a signature. Signatures that no other set has come first in that order and match nothing, so they are counted
    and left behind: a set with more of them than its prefix has places has no partner, and the others go on with their shared
    ones. The join looks for a shared signature in the prefixes; what lies behind it in both sets must suffice for the
    likeness, which holds for a matching pair at the first one that it shares.
    Set lengths are cut at powers of 100 / percent, so a set's partners that are as long or longer lie in its own
    partition or the next. The sets of a signature that many have are dealt into blocks, and each two blocks meet in a
    group of their own. Sets go by a number until the end, as a fingerprint is longer than its set's prefix.
    """
    rows = docs.select("doc_id", signatures(F.col("text")).alias("sigs")).withColumn("class", fingerprint(F.col("sigs")))
    rows = stored(rows.withColumn("id", F.monotonically_increasing_id()), "spots")
    classes = rows.groupBy("class").agg(F.min("id").alias("id"), F.first("sigs").alias("sigs"))
    held = classes.select("id", F.size("sigs").alias("n"), F.explode("sigs").alias("sig"))
    # a set has a signature once, so no group is larger than the number of sets
    shared = held.withColumn("times", F.count("*").over(Window.partitionBy("sig"))).where("times > 1")
    least = F.ceil(F.col("n") * percent / 100).cast("int")
    sets = shared.groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("times", "sig"))).alias("s")).where(F.size("s") >= least)
    sets = stored(sets.select("id", "n", F.transform("s", lambda x: x["sig"]).alias("s")), "sets")
    part = F.floor(F.log(100 / percent, F.col("n").cast("double"))).cast("int")
    own = F.col("n") - F.size("s")
    keys = sets.select("id", "n", part.alias("part"), own.alias("own"), F.posexplode(F.slice("s", F.lit(1), F.col("n") - least + 1 - own)).alias("at", "sig"))
    keys = keys.select("id", "n", "part", (F.col("own") + F.col("at")).alias("at"), "sig").withColumn("held", F.count("*").over(Window.partitionBy("sig")))
    blocks = F.ceil(F.col("held") / BLOCK).cast("int")
    dealt = stored(keys.where("held > 1").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int")), "prefixes")
    each = F.sequence(F.lit(0), F.col("blocks") - 1)
    # the shorter set is on the left (of equal lengths the lesser number), so a pair meets once in a signature
    left = dealt.select(F.col("id").alias("x"), F.col("n").alias("nx"), F.col("at").alias("ax"), "sig", F.col("block").alias("i"), F.explode(each).alias("j"), "part")
    left = left.withColumn("part", F.explode(F.array("part", F.col("part") + 1)))
    right = dealt.select(F.col("id").alias("y"), F.col("n").alias("ny"), F.col("at").alias("ay"), "sig", "part", F.col("block").alias("j"), F.explode(each).alias("i"))
    found = left.join(right.hint("merge"), ["sig", "part", "i", "j"]).where(F.struct("nx", "x") < F.struct("ny", "y")).where(F.col("nx") * 100 >= F.col("ny") * percent)
    behind = F.least(F.col("nx") - F.col("ax"), F.col("ny") - F.col("ay"))
    found = stored(found.where(behind * (100 + percent) >= (F.col("nx") + F.col("ny")) * percent).select("x", "y").distinct(), "candidates")
    side = lambda c: sets.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("s").alias(f"s{c}")).hint("merge")
    both = F.size(F.array_intersect("sx", "sy"))
    pairs = found.join(side("x"), "x").join(side("y"), "y").select("x", "y", (both / (F.col("nx") + F.col("ny") - both)).alias("likeness")).where(F.col("likeness") * 100 >= percent)
    name = lambda c: rows.select(F.col("id").alias(c), F.col("class").alias(f"c{c}")).hint("merge")
    pairs = stored(pairs, "alike").join(name("x"), "x").join(name("y"), "y")
    return rows.select("doc_id", "class"), pairs.select(F.least("cx", "cy").alias("a"), F.greatest("cx", "cy").alias("b"), "likeness")


def near_classes(docs: DataFrame, percent: int = 80) -> DataFrame:
    """docs(doc_id, text): doc_id, class (the fingerprint) and n_links: other classes whose likeness is percent / 100 or more. One row for each row of docs."""
    members, pairs = near_pairs(docs, percent)
    links = pairs.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count("*").alias("n_links"))
    return members.join(links.hint("shuffle_hash"), "class", "left").select("doc_id", "class", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
