"""Duplicate pairs, fuzzy names and literals against loops over all pairs."""

import random
from datetime import date, timedelta
from decimal import Decimal
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from passbook.functions.text import duplicate_text, normalize
from passbook.operators import duplicates, ledgers, literals, templates
from passbook.plans import bindings

SF = "/root/testdata/sf0.001"
STATEMENT = "session_id string, row_number int, id string, transaction_date date, debit_amount decimal(28,2), credit_amount decimal(28,2), reference_number string, description string, balance decimal(28,2), duplicate_status string, ignored boolean"


def scored(rows, texts, threshold):
    out = []
    for x in rows:
        for y in rows:
            if x[0] != y[0] or (x[1], x[2]) >= (y[1], y[2]) or x[10] or y[10] or y[9] == "Confirmed unique":
                continue
            points = 30 * (x[3] is not None and x[3] == y[3])
            side = lambda r: ("D", r[4]) if r[4] else ("C", r[5])
            points += 30 * (side(x) == side(y) and side(x)[1] != 0)
            points += 20 * (texts[x[6]] != "" and texts[x[6]] == texts[y[6]])
            points += 5 * (x[8] is not None and x[8] == y[8])
            ratio = SequenceMatcher(None, texts[x[7]], texts[y[7]]).ratio()
            points += 15 if ratio >= 0.9 else 10 if ratio >= 0.7 else 0
            if points >= threshold:
                out.append((x[0], x[2], y[2], points))
    return sorted(out)


def rows_of(rng, n):
    one = lambda: rng.choice(["UPI shop 12", "UPI shop 13", "daily fee", "daily  FEE!", "", "something else", "somethin else"])
    out = []
    for i in range(n):
        hot = rng.random() < 0.6
        day = date(2024, 1, 31) if hot else rng.choice([None, date(2024, 1, 1) + timedelta(rng.randrange(3))])
        amount = Decimal("25.00") if hot else Decimal(rng.choice([0, 10, 20]))
        debit = rng.random() < 0.7
        out.append(("s1" if hot else rng.choice(["s1", "s2"]), i // 3, f"id{i:04}", day, amount if debit else Decimal(0), Decimal(0) if debit else amount, rng.choice(["", "R-1", "r 1", "R2"]), one(), rng.choice([None, Decimal(1), Decimal(2)]), rng.choice(["None", "Suspected", "Confirmed unique", "Confirmed duplicate"]), rng.random() < 0.1))
    return out


@pytest.mark.parametrize("threshold", [40, 55, 75, 90])
def test_pairs_with_a_hot_key_equal_brute_force(spark, monkeypatch, threshold):
    monkeypatch.setattr(duplicates, "BLOCK_ROWS", 16)
    rows = rows_of(random.Random(threshold), 150)
    df = spark.createDataFrame(rows, STATEMENT)
    texts = {r[0]: r[1] for r in df.select("description", duplicate_text("description")).union(df.select("reference_number", duplicate_text("reference_number"))).collect()}
    got = sorted(tuple(r) for r in duplicates.pairs(df, threshold).select("session_id", "original_id", "duplicate_id", "score").collect())
    assert got == scored(rows, texts, threshold) and got


@pytest.mark.parametrize("threshold", [71, 78, 83])
def test_pairs_of_a_hot_key_meet_by_reference_or_text(spark, monkeypatch, threshold):
    monkeypatch.setattr(duplicates, "BLOCK_ROWS", 16)
    rows = rows_of(random.Random(threshold), 150)
    df = spark.createDataFrame(rows, STATEMENT)
    texts = {r[0]: r[1] for r in df.select("description", duplicate_text("description")).union(df.select("reference_number", duplicate_text("reference_number"))).collect()}
    got = sorted(tuple(r) for r in duplicates.pairs(df, threshold).select("session_id", "original_id", "duplicate_id", "score").collect())
    assert got == scored(rows, texts, threshold) and got


def test_rows_of_a_hot_key_without_a_common_text_or_reference_do_not_meet(spark):
    n = 1300  # 26 texts of one letter: of 844,350 pairs 31,850 have the same text
    fee = [("s", i, f"id{i}", date(2024, 1, 31), Decimal(25), Decimal(0), "", chr(97 + i % 26) * 20, None, "None", False) for i in range(n)]
    rows = duplicates._sided(spark.createDataFrame(fee, STATEMENT))
    few, hot = duplicates._parted(rows)
    assert few.count() == 0 and hot.count() == n
    assert duplicates.met(hot, 75, F.lit(True)).count() == 26 * (50 * 49 // 2)


def test_a_hot_key_spreads_over_groups(spark):
    n = 5000
    rows = spark.range(n).selectExpr("string(id % 1) as session_id", "cast(id as int) as row_number", "string(id) as id", "date_add(date'2024-01-31', cast(id % 1 as int)) as day", "false as unique")
    hot = duplicates.triangles(rows, ["session_id", "day"], ~F.col("unique"))
    plan = hot._jdf.queryExecution().executedPlan().toString()
    assert "l_block" in plan and "NestedLoop" not in plan
    # each pair once, in groups of at most two blocks
    per = hot.groupBy(F.floor(F.col("l_row_number") / 1000), F.floor(F.col("r_row_number") / 1000)).count().collect()
    assert sum(r["count"] for r in per) == n * (n - 1) // 2
    assert hot.select("l_id", "r_id").where("cast(l_id as int) % 997 = 0").distinct().count() == sum(n - 1 - i for i in range(0, n, 997))


def _fees(spark, n):
    """Fees of one day whose balances are seven and whose texts are one letter, with two that are alike."""
    texts = [chr(97 + i) * 20 for i in range(12)] + ["daily fee", "daily fees"]
    fee = [("s", i, f"id{i}", date(2024, 1, 31), Decimal(25), Decimal(0), f"R{i % 9}" if i % 5 else "", texts[i % 14], Decimal(i % 7), "None", False) for i in range(n)]
    return spark.createDataFrame(fee, STATEMENT)


def test_pairs_of_a_hot_key_are_made_by_all_partitions_from_short_rows(spark):
    df = _fees(spark, 1000)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        found = duplicates.pairs(df, 75).select("original_id", "duplicate_id", "score")
        spark.sparkContext.setJobGroup("pairs", "pairs")
        found.write.format("noop").mode("overwrite").save()
        tracker = spark.sparkContext.statusTracker()
        stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("pairs") for s in tracker.getJobInfo(j).stageIds]
        # few bytes make many pairs: adaptive execution must not put them in a few tasks
        assert max(s.numTasks for s in stages if s) >= 32
        # texts, references and the key's columns stay out of the rows that meet; sums are checked for each pair, so there are none
        hot = duplicates._parted(duplicates._sided(df))[1]
        plan = duplicates.met(hot, 75, F.lit(True)).select("l_id", "r_id", "_score")._jdf.queryExecution().optimizedPlan().toString()
        assert "l_amount" not in plan and "r_transaction_date" not in plan and "_points" not in plan
    finally:
        spark.sparkContext.setJobGroup("rest", "rest")
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("threshold", [71, 75, 80, 81, 96])
def test_reasons_of_a_hot_key_equal_those_of_a_cold_one(spark, monkeypatch, threshold):
    columns = ("session_id", "original_id", "original_row", "duplicate_id", "duplicate_row", "score", "reasons")
    df = _fees(spark, 160)
    cold = sorted(map(str, duplicates.pairs(df, threshold).select(*columns).collect()))
    monkeypatch.setattr(duplicates, "BLOCK_ROWS", 24)
    assert sorted(map(str, duplicates.pairs(df, threshold).select(*columns).collect())) == cold and cold


@pytest.mark.parametrize("threshold", [1, 30, 50, 78, 95, 100])
def test_fuzzy_equals_every_pair(spark, threshold):
    rng = random.Random(threshold)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(0, 7)))
    names = sorted({f"{word()} {word()}".strip() for _ in range(40)} | {"red bolt", "blue bolt", "Ä"})
    texts = sorted({word() for _ in range(40)} | {f"{word()} {word()}" for _ in range(20)} | {"", "rad bolt", "b", "upi", "red bolt 7"})
    dim = ledgers.prepared(spark.createDataFrame([(i + 1, n, "") for i, n in enumerate(names)], "pos int, name string, parent_group string"))
    df = spark.createDataFrame([(t,) for t in texts], "description string")
    norm = {r[0]: r[1] for r in df.select("description", normalize("description")).union(dim.select("name", "norm")).collect()}
    want = []
    for t in texts:
        best = max(((round(SequenceMatcher(None, norm[t], norm[n]).ratio() * 100), -i, n) for i, n in enumerate(names)))
        if best[0] >= threshold:
            want.append((t, best[2], best[0]))
    got = ledgers.by_fuzzy(df, dim, threshold)
    assert sorted(tuple(r) for r in got.select("description", "ledger", "confidence").collect()) == sorted(want)


@pytest.mark.parametrize("threshold", [50, 78])
def test_fuzzy_over_the_tables_equals_every_pair(spark, threshold):
    dim, df = ledgers.prepared(bindings.ledgers(spark, SF)), bindings.typos(spark, SF)
    names = [(r.pos, r.name, r.norm) for r in dim.orderBy("pos").collect()]
    want = {}
    for t, d in ((r[0], r[1]) for r in df.select("description", normalize("description")).collect()):
        score, _, name = max((round(SequenceMatcher(None, d, n).ratio() * 100), -pos, name) for pos, name, n in names)
        if score >= threshold:
            want[t] = (name, score)
    got = {r.description: (r.ledger, r.confidence) for r in ledgers.by_fuzzy(df, dim, threshold).collect()}
    assert got == want and len(got) > 20 and len({s for _, s in got.values()}) > 5


def test_no_scan_of_names(spark):
    """No part of the fuzzy join meets every name, however low the threshold."""
    dim = ledgers.prepared(bindings.ledgers(spark, SF))
    plan = ledgers._by_letters(spark.createDataFrame([("abc",)], "d string"), dim.select("norm"), 0.3)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and plan.count("NestedLoop") <= 1  # the one for two empty texts


def test_literal_candidates_hold_every_hit(spark):
    rng = random.Random(6)
    word = lambda n: "".join(rng.choices("abc é", k=n))
    texts = [word(rng.randint(0, 60)) for _ in range(60)] + ["", "x" * 9000 + "needle" + "y" * 10, "z" * 4093 + "across the border"]
    words = sorted({word(rng.randint(1, 9)) for _ in range(50)} | {"", "needle", "across the border", "é"})
    got = {tuple(r) for r in literals.candidates(spark.createDataFrame(list(enumerate(texts)), "key int, text string"), spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    assert {(i, w) for i, t in enumerate(texts) for w in words if w and w in t} <= got
    assert len(got) < len(texts) * len(words) / 2


def test_rules_of_every_kind_equal_brute_force(spark):
    rng = random.Random(7)
    kinds = ["Contains", "Exact", "Starts with", "Regex"]
    rules = [(f"R{i}", "".join(rng.choices(["ab", "b ", "C", "d", "."], k=rng.randint(0, 3))), kinds[i % 4], "Bolt", None, rng.randrange(5), i, True) for i in range(60)]
    rules.append(("bad", "(", "Regex", "Bolt", None, 0, 0, True))
    df = spark.createDataFrame(rules, "id string, pattern string, match_type string, ledger_name string, voucher_type string, priority int, created_at int, enabled boolean")
    texts = sorted({"".join(rng.choices(["AB", "b ", "c", "d", " "], k=rng.randint(0, 4))) for _ in range(80)})
    import re

    want = {}
    for t in texts:
        source = re.sub(r"\s+", " ", t).strip()
        hits = []
        for i, p, kind, _, _, prio, at, _ in rules[:-1]:
            p = p.strip()
            low = source.lower()
            ok = {"Contains": p.lower() in low, "Exact": p.lower() == low, "Starts with": low.startswith(p.lower())}.get(kind)
            if re.search(p, source, re.I) if kind == "Regex" else ok:
                hits.append((prio, at, i))
        if hits:
            want[t] = min(hits)[2]
    dim = ledgers.prepared(spark.createDataFrame([(1, "Bolt", "")], "pos int, name string, parent_group string"))
    got = {r.description: r.rule_id for r in ledgers.by_rule(spark.createDataFrame([(t,) for t in texts], "description string"), df, dim).collect()}
    assert got == want


def test_template_detection_has_no_nested_loop(spark):
    docs = spark.createDataFrame([(1, "The Apache License"), (2, "mit"), (3, "smith"), (4, "")], "doc_id long, text string")
    found = templates.detect(docs, bindings.templates(spark))
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r.doc_id: r.template_id for r in found.collect()} == {1: "apache", 2: "mit"}
