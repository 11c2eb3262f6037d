"""Matching of descriptions to ledgers: saved rules, exact, keyword, substring, normalised, fuzzy, suspense.

A match depends on the description alone, so tiers run on distinct descriptions, each on what the
tiers before have left. Ledgers and rules are dimensions whose size is checked before a broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from passbook.functions.text import basic_normalize, collapse, filled, meaningful_tokens, normalize
from passbook.functions.values import is_bank_or_cash, voucher_type
from passbook.functions.vocabulary import SUSPENSE
from passbook.operators.duplicates import text_ratio
from passbook.operators.literals import FEW, candidates, grams
from passbook.sources.steps import BROADCAST_CHARS, BROADCAST_ROWS, fits, partitions, small, written


def prepared(ledgers: DataFrame) -> DataFrame:
    """ledgers(pos, name, parent_group) with the forms that the tiers compare."""
    basic = basic_normalize("name")
    return ledgers.select("pos", "name", is_bank_or_cash(F.col("parent_group")).alias("own"), basic.alias("basic"), meaningful_tokens(basic).alias("tokens"), normalize("name").alias("norm"))


def _last_by_basic(ledgers: DataFrame) -> DataFrame:
    return ledgers.groupBy("basic").agg(F.max_by("name", "pos").alias("ledger"))


def usable_rules(rules: DataFrame) -> DataFrame:
    """Enabled rules whose pattern compiles. Rules are few: they are read to the driver once, and too many raise."""
    rows = rules.where("enabled").limit(BROADCAST_ROWS + 1).collect()
    if len(rows) > BROADCAST_ROWS:
        raise ValueError(f"more than {BROADCAST_ROWS} rules")

    def fine(r) -> bool:
        if r.match_type != "Regex":
            return True
        try:  # the engine that will run it judges it
            return rules.sparkSession._jvm.java.util.regex.Pattern.compile(f"(?i){r.pattern}") is not None
        except IllegalArgumentException:
            return False

    return rules.sparkSession.createDataFrame([r for r in rows if fine(r)], rules.schema)


def by_rule(descriptions: DataFrame, rules: DataFrame, ledgers: DataFrame) -> DataFrame:
    """descriptions(description) that a rule matches whose ledger exists, with the first such rule by priority, then age."""
    r = usable_rules(rules)
    target = r.withColumn("basic", basic_normalize("ledger_name")).join(small(_last_by_basic(ledgers)), "basic")
    target = target.select(F.trim("pattern").alias("pattern"), "match_type", "ledger", F.col("id").alias("rule_id"), F.col("voucher_type").alias("override"), "priority", "created_at")
    target = written(target, "rules")
    source = collapse(F.col("description"))
    low, want, kind = F.lower(source), F.lower(F.col("pattern")), F.col("match_type")
    # a literal is looked up: an exact one as it is, others by an index of their rarest characters
    texts = written(descriptions.withColumn("low", low), "texts")
    literal = target.where("match_type <> 'Regex'").withColumn("word", want)
    found = [texts.join(small(literal.where("match_type = 'Exact'").withColumnRenamed("word", "low")), "low").drop("low")]
    inside = literal.where("match_type <> 'Exact' and word <> ''")
    maybe = candidates(texts.select(F.col("description").alias("key"), F.col("low").alias("text")), inside).withColumnRenamed("key", "description")
    held = F.when(kind == "Starts with", F.col("low").startswith(F.col("word"))).otherwise(F.contains("low", "word"))
    found.append(maybe.join(texts.hint("merge"), "description").join(small(inside), "word").where(held).drop("low", "word"))
    # expressions, and empty patterns, which every text holds, are tried on each; their number is bounded
    scan = target.where("match_type = 'Regex' or (match_type <> 'Exact' and pattern = '')")
    tried = F.when(kind == "Regex", F.regexp_like(source, F.concat(F.lit("(?i)"), "pattern"))).otherwise(True)
    if scan.limit(1).count():
        found.append(descriptions.join(F.broadcast(usable_odd(scan)), tried))
    found = reduce(DataFrame.unionByName, [f.select("description", *target.columns) for f in found])
    first = F.row_number().over(Window.partitionBy("description").orderBy("priority", "created_at", "rule_id"))
    return found.withColumn("_n", first).where("_n = 1").select("description", "ledger", F.lit(100).alias("confidence"), F.lit("Saved Rule").alias("method"), "rule_id", "override")


def _tier(found: DataFrame, confidence, method: str) -> DataFrame:
    return found.select("description", "ledger", F.lit(confidence).cast("int").alias("confidence") if isinstance(confidence, int) else confidence.alias("confidence"), F.lit(method).alias("method"), F.lit(None).cast("string").alias("rule_id"), F.lit(None).cast("string").alias("override"))


def by_exact(descriptions: DataFrame, ledgers: DataFrame) -> DataFrame:
    """Descriptions that equal a ledger's name in basic form; of equal names the last wins."""
    # never null (and no form has a question mark), so that the join needs no test for it, which would make the form a second time
    form = F.coalesce(basic_normalize("description"), F.lit("?"))
    found = descriptions.withColumn("basic", form).join(small(_last_by_basic(ledgers)), "basic")
    return _tier(found, 100, "Exact ledger name")


def by_keyword(descriptions: DataFrame, ledgers: DataFrame) -> DataFrame:
    """Descriptions that hold all meaningful words of a ledger; most letters, then the first ledger, win.

    A join on words and a count of those that agree, so that no description meets every ledger. Of a
    description the words that ledgers have are kept, and each distinct list of them is matched once.
    """
    basic = basic_normalize("description")
    words = F.array_distinct(F.split(F.regexp_replace(basic, "&", " "), " +"))
    plain = ledgers.where(~F.exists("tokens", lambda t: F.contains(t, F.lit("&"))) & (F.size("tokens") > 0))
    weight = F.aggregate("tokens", F.lit(0), lambda acc, t: acc + F.length(t))
    held = plain.select("pos", F.col("name").alias("ledger"), weight.alias("weight"), F.size(F.array_distinct("tokens")).alias("n"), F.explode(F.array_distinct("tokens")).alias("word"))
    held = written(held, "held")
    known = held.select("word").distinct()
    few = [r.word for r in known.limit(FEW + 1).collect()]
    if len(few) <= FEW:
        lists = descriptions.select("description", F.array_intersect(words, F.array(*map(F.lit, few)).cast("array<string>")).alias("words"))
    else:
        single = descriptions.select("description", F.explode(words).alias("word")).join(small(known), "word")
        lists = single.groupBy("description").agg(F.collect_set("word").alias("words"))
    # lists without words are written as well, as a filter would make each list twice
    lists = written(lists.select("description", F.array_sort("words").alias("words")), "lists").where(F.size("words") > 0)
    hits = lists.select("words").distinct().select("words", F.explode("words").alias("word")).join(small(held), "word")
    hits = hits.groupBy("words", "pos", "ledger", "weight", "n").agg(F.count("*").alias("k")).where("k = n")
    first = F.max(F.struct("weight", "back", "ledger")).alias("b")
    best = written(hits.withColumn("back", -F.col("pos")).groupBy("words").agg(first), "best")
    best = lists.join(small(best.select("words", "b.*")), "words").select("description", "weight", "back", "ledger")
    # names with an ampersand inside a word are matched as a pattern; there are few
    odd = ledgers.where(F.exists("tokens", lambda t: F.contains(t, F.lit("&")))).select("pos", F.col("name").alias("ledger"), weight.alias("weight"), "tokens")
    if odd.limit(1).count():
        whole = descriptions.withColumn("basic", basic).join(F.broadcast(usable_odd(odd)), F.forall("tokens", lambda t: F.regexp_like(F.col("basic"), F.concat(F.lit(r"\b\Q"), t, F.lit(r"\E\b")))))
        best = best.unionByName(whole.select("description", "weight", (-F.col("pos")).alias("back"), "ledger")).groupBy("description").agg(first).select("description", "b.ledger")
    return _tier(best, 94, "Keyword")


def usable_odd(odd: DataFrame) -> DataFrame:
    if not fits(odd):
        raise ValueError(f"more than {BROADCAST_ROWS} rows or {BROADCAST_CHARS} characters to scan for")
    return odd


def by_substring(descriptions: DataFrame, ledgers: DataFrame) -> DataFrame:
    """Descriptions that hold a ledger's name of four characters or more; the longest, then the first, wins."""
    names = ledgers.where(F.length("basic") >= 4).groupBy("basic").agg(F.min_by("name", "pos").alias("ledger"), F.min("pos").alias("pos"))
    # a name is looked for where its four characters that fewest names share occur
    held = names.select("basic", "ledger", "pos", F.explode(F.array_distinct(grams("basic", 4))).alias("gram"))
    often = held.groupBy("gram").agg(F.count("*").alias("k"))
    held = held.join(often.hint("merge"), "gram").groupBy("basic", "ledger", "pos").agg(F.min_by("gram", F.struct("k", "gram")).alias("gram"))
    texts = descriptions.withColumn("d", basic_normalize("description")).select("description", "d", F.explode(F.array_distinct(grams("d", 4))).alias("gram"))
    found = texts.join(small(held), "gram").where(F.contains(F.col("d"), F.col("basic")))
    best = found.groupBy("description").agg(F.max_by("ledger", F.struct(F.length("basic"), -F.col("pos"))).alias("ledger"))
    return _tier(best, 88, "Substring")


def by_normalized(descriptions: DataFrame, ledgers: DataFrame) -> DataFrame:
    """Descriptions that equal a ledger's name without noise and blanks; the first ledger wins."""
    bare = lambda c: F.regexp_replace(c, " ", "")
    names = ledgers.groupBy(bare("norm").alias("bare")).agg(F.min_by("name", "pos").alias("ledger"))
    found = descriptions.withColumn("bare", bare(normalize("description"))).join(small(names), "bare")
    return _tier(found, 84, "Normalized text")


def by_fuzzy(descriptions: DataFrame, ledgers: DataFrame, threshold: int = 78) -> DataFrame:
    """Descriptions whose best ratio with a ledger's name reaches the threshold (1 to 100); the first of equals wins.

    Distinct normal forms are compared once. A ratio r of two texts with n characters together leaves
    (1 - r) * n of them unmatched, which part at least r * n / 2 matched pairs into as many runs and one;
    so the texts share (1.5 * r - 1) * n - 1 pairs of neighbours or more. Where that is one or more, the
    join is on these: of a description's pairs, rarest first, as many are looked up as must hold a
    shared one. Other descriptions, which are short or have a low threshold, are joined by letters. Of the
    pairs found only those whose lengths and counts of characters let the ratio reach the threshold are compared.
    """
    threshold = max(1, min(100, threshold))
    r = (threshold - 0.5) / 100  # half a point below the threshold rounds up to it
    names = written(ledgers.groupBy("norm").agg(F.min_by("name", "pos").alias("ledger"), F.min("pos").alias("pos")), "names")
    # written, as what makes the descriptions would run again for each use below
    texts = written(descriptions.withColumn("d", normalize("description")), "texts")
    d = texts.select("d").distinct().withColumn("least", F.ceil(F.length("d") * (2 / (2 - r) * (1.5 * r - 1)) - 1 - 1e-6))
    posts = names.select("norm", F.explode(F.array_distinct(grams("norm", 2))).alias("gram"))
    often = posts.groupBy("gram").agg(F.count("*").alias("k"))
    asked = d.where("least >= 1").select("d", "least", F.explode(grams("d", 2)).alias("gram")).join(small(often), "gram", "left")
    asked = asked.groupBy("d", "least").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("k", F.lit(0)).alias("k"), "gram"))).alias("gs"))
    asked = asked.select("d", F.explode(F.array_distinct(F.slice("gs", F.lit(1), F.greatest(F.lit(0), F.size("gs") - F.col("least").cast("int") + 1)))).alias("g")).select("d", "g.gram")
    near = asked.join(small(posts), "gram").select("d", "norm")
    every = _by_letters(written(d.where("least < 1").select("d"), "short"), names.select("norm"), r)
    n, m = F.length("d"), F.length("norm")
    bound = 2 * F.least(n, m) >= r * (n + m) - 1e-6
    letters = lambda c: F.sort_array(F.split(F.col(c), ""))
    shared = n + m - F.size(F.array_union(_numbered(letters("d")), _numbered(letters("norm"))))
    pairs = near.unionByName(every).distinct().where(bound).where((n + m == 0) | (2 * shared >= r * (n + m) - 1e-6))
    pairs = written(pairs, "pairs").join(small(names), "norm")
    scored = pairs.withColumn("score", F.bround(text_ratio("d", "norm") * 100).cast("int")).where(F.col("score") >= threshold)
    best = scored.groupBy("d").agg(F.max_by(F.struct("ledger", "score"), F.struct("score", -F.col("pos"))).alias("b"))
    found = texts.join(best.hint("merge"), "d").select("description", "b.ledger", F.col("b.score").alias("score"))
    return _tier(found, F.col("score"), "Fuzzy")


def _by_letters(texts: DataFrame, names: DataFrame, r: float) -> DataFrame:
    """(d, norm) of texts(d) and names(norm) that share so many characters, repeats counted, that their ratio may be r; an equi-join.

    A ratio of r needs r / 2 of both lengths as shared characters. Let each side list its characters, numbered
    among their equals, the rarest first: if a list of n shares t with another, the first n - t + 1 of either hold a
    shared one. So a text looks up, for each length that a name may have, as many of its first characters, and
    a name is found under its first ones with that length. Two empty texts are equal.
    """
    letters = lambda c: _numbered(F.sort_array(F.split(F.col(c), "")))
    held = names.where("norm <> ''").select("norm", F.length("norm").alias("m"), F.explode(letters("norm")).alias("letter"))
    often = written(held.groupBy("letter").agg(F.count("*").alias("k")), "letters")

    def ordered(df: DataFrame, of: str, size: str) -> DataFrame:
        """Each text's numbered characters by rarity, with their places from 0."""
        ranked = df.join(small(often), "letter", "left").groupBy(of, size).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("k", F.lit(0)).alias("k"), "letter"))).alias("ls"))
        return ranked.select(of, size, F.posexplode("ls").alias("at", "l")).select(of, size, "at", "l.letter")

    n, m = F.col("n"), F.col("m")
    need = F.greatest(F.lit(1), F.ceil(r * (n + m) / 2 - 1e-6)).cast("int")
    lengths = F.sequence(F.greatest(F.lit(1), F.ceil(n * r / (2 - r) - 1e-6).cast("int")), F.floor(n * (2 - r) / r + 1e-6).cast("int"))
    most = names.agg(F.max(F.length("norm"))).first()[0] or 0
    asked = ordered(texts.where("d <> ''").select("d", F.length("d").alias("n"), F.explode(letters("d")).alias("letter")), "d", "n")
    asked = asked.select("d", "n", "at", "letter", F.explode(F.filter(lengths, lambda x: x <= most)).alias("m")).where(F.col("at") <= n - need).withColumnRenamed("at", "d_at")
    # the least that a name of m characters may share, with the shortest text
    few = F.greatest(F.lit(1), F.ceil(r * (m + F.ceil(m * r / (2 - r) - 1e-6)) / 2 - 1e-6)).cast("int")
    posts = ordered(held, "norm", "m").where(F.col("at") <= m - few)
    found = asked.join(posts.hint("merge"), ["letter", "m"]).where(F.col("at") <= m - need).select("d", "norm")
    empty = texts.where("d = ''").join(names.where("norm = ''").limit(1).hint("broadcast"), F.lit(True)).select("d", "norm")
    return found.unionByName(empty)


def _numbered(characters: Column) -> Column:
    """Each of a sorted array's characters with its turn among its equals, so that sets of them count repeats."""
    return F.transform(characters, lambda c, i: F.concat(c, (i - F.array_position(characters, c)).cast("string")))


def match(descriptions: DataFrame, ledgers: DataFrame, rules: DataFrame, threshold: int = 78, suspense: str = SUSPENSE) -> DataFrame:
    """Of each distinct description: ledger, confidence, method, rule_id and override (a rule's voucher type).

    What each tier finds and what it leaves is written, so that the next ones and the result read it instead of matching again.
    """
    left = written(descriptions.select("description").distinct().repartition(partitions(descriptions.sparkSession)), "descriptions")
    names = prepared(ledgers)
    tiers = []
    for tier in (lambda d: by_rule(d, rules, names), lambda d: by_exact(d, names), lambda d: by_keyword(d, names), lambda d: by_substring(d, names), lambda d: by_normalized(d, names), lambda d: by_fuzzy(d, names, threshold)):
        found = written(tier(left), "tier")
        tiers.append(found)
        left = written(left.join(found.select("description"), "description", "left_anti"), "left")
    known = [r.ledger for r in _last_by_basic(names).where(F.col("basic") == basic_normalize(F.lit(suspense))).collect()]
    out = _tier(left.withColumn("ledger", F.lit(known[0] if known else suspense)), 0, "Default suspense")
    for t in tiers:
        out = out.unionByName(t)
    return out


def apply(transactions: DataFrame, ledgers: DataFrame, rules: DataFrame, bank_ledger: str, threshold: int = 78, suspense: str = SUSPENSE) -> DataFrame:
    """transactions with ledgers, confidence, method, rule and voucher type on every row that is not ignored."""
    rows = transactions.withColumn("_d", filled("description"))
    found = match(rows.where(~F.col("ignored")).select(F.col("_d").alias("description")), ledgers, rules, threshold, suspense)
    own = ledgers.groupBy(F.lower("name").alias("_key")).agg(F.max_by(is_bank_or_cash(F.col("parent_group")), "pos").alias("_own"))
    bank = [r["_own"] for r in own.where(F.col("_key") == bank_ledger.lower()).collect()]
    found = found.withColumn("_key", F.lower("ledger")).join(small(own), "_key", "left").withColumnRenamed("description", "_d")
    out = rows.join(found.hint("merge"), "_d", "left")
    on = ~F.col("ignored")
    overridden = F.col("override").isNotNull() & (F.col("override") != "Unassigned")
    kind = F.when(overridden, F.col("override")).otherwise(voucher_type(F.col("_d"), F.col("debit_amount"), F.col("_own"), F.lit(bank[0] if bank else None).cast("boolean")))
    put = lambda c, v: F.when(on, v).otherwise(F.col(c))
    new = {
        "bank_ledger": put("bank_ledger", F.lit(bank_ledger)),
        "opposite_ledger": put("opposite_ledger", F.col("ledger")),
        "matching_confidence": put("matching_confidence", F.col("confidence")),
        "matching_method": put("matching_method", F.col("method")),
        "matching_rule_id": put("matching_rule_id", filled("rule_id")),
        "voucher_type": put("voucher_type", kind),
    }
    return out.withColumns(new).select(*transactions.columns)
