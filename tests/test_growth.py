"""Shuffles, passes and files that must not grow faster than the input."""

from pyspark.sql import functions as F

from passbook.functions import text
from passbook.operators import layout, ledgers, literals
from passbook.plans import bindings
from passbook.sources import xml

SF = "/root/testdata/sf0.001"


def same(a, b):
    assert a.exceptAll(b.select(*a.columns)).count() == 0 and b.select(*a.columns).exceptAll(a).count() == 0


def exchanges(df):
    df.sparkSession.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        df.sparkSession.conf.set("spark.sql.adaptive.enabled", "true")
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]


def test_words_of_documents_stay_with_their_document(spark):
    assert len(exchanges(layout.line_text(layout.lines(bindings.words(spark, SF))))) == 1
    assert len(exchanges(bindings.words(spark, SF).groupBy("doc_id", "page", "top").agg(layout.joined_words()))) == 1


def test_words_of_statements_are_made_in_one_pass(spark):
    words = bindings.page_words(spark, SF)
    same(words, bindings.bound(spark, SF, bindings.STMT_WORDS))
    found = exchanges(layout.lines(words))
    assert len(found) == 2  # events by user, then events by document; no words


def test_plain_forms_from_one_base(spark):
    rows = spark.createDataFrame([("a /& b&",), ("&",), (" / X//y & z",), (None,), ("",), ("É-1/2&3",)], "t string").withColumn("base", text.plain_base("t"))
    got = rows.select(text.plain_form("base", "/"), text.plain_form("base", ""), text.plain_form("base", "&")).collect()
    assert got == rows.select(text.normalize_header("t"), text.normalize_table_header("t"), text.basic_normalize("t")).collect()


def test_strings_of_a_text_take_one_pass(spark):
    rows = spark.createDataFrame([("a\nb\U0001f600cd",), ("abc",), (None,), ("",)], "t string")
    assert [r[0] for r in rows.select(literals.grams("t", 4)).collect()] == [["a\nb\U0001f600", "\nb\U0001f600c", "b\U0001f600cd"], [], None, []]
    assert "substring" not in rows.select(literals.grams("t", 4))._jdf.queryExecution().executedPlan().toString()


def test_few_and_many_entries_find_the_same_words(spark, monkeypatch):
    texts = bindings.lines(spark, SF).select(F.col("doc_id").alias("key"), "text")
    words = spark.createDataFrame([("de",), ("the",), ("license",), ("x",), ("nothing like it",)], "word string")
    few = literals.candidates(texts, words).where(F.col("word") != "")
    monkeypatch.setattr(literals, "FEW", 0)
    same(few, literals.candidates(texts, words))


def test_elements_are_read_piece_by_piece(spark, tmp_path):
    head = "<C>" + "".join(f'<COMPANY NAME="n{i}"><GUID>G{i}</GUID></COMPANY>\n' for i in range(300))
    (tmp_path / "a.xml").write_text(head + '<company name="low"><GUID>x</GUID></company><COMPANY NAME="self"/>\n<COMPANY><NAME>cut off</NAME>')
    (tmp_path / "b.xml").write_text("<COMPANY><NAME>last &#4; one</NAME></COMPANY>")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        pieces = xml._pieces(spark, f"file://{tmp_path}", "</COMPANY>")
        assert pieces.count() == 302 and pieces.agg(F.max(F.length("text"))).first()[0] < 200
        got = xml._entities(spark, f"file://{tmp_path}", "COMPANY", ["GUID"]).orderBy("path", "at").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [r.name for r in got if r.name.startswith("n")] == [f"n{i}" for i in range(300)]
    assert {r.name for r in got} - {f"n{i}" for i in range(300)} == {"low", "self", "last one"}


def test_responses_of_a_table_equal_those_of_files(spark, tmp_path):
    one = "<R><CREATED>2</CREATED><ERRORS>1</ERRORS><LINEERROR>bad &amp; x</LINEERROR>&#4;<LASTVCHID>7</LASTVCHID></R>"
    (tmp_path / "r.xml").write_text(one)
    rows = spark.createDataFrame([("p", one)], "path string, raw string")
    same(xml.responses(spark, f"file://{tmp_path}").drop("path"), xml.stored_responses(rows).drop("path"))


def test_descriptions_are_made_once_for_the_fuzzy_tier(spark):
    made = spark.sparkContext.accumulator(0)

    def count(d):
        made.add(len(d))
        return d

    given = spark.createDataFrame([("red bolt",), ("blu gear",), ("zz",), ("x",), ("",)], "d string")
    given = given.select(F.pandas_udf(count, "string")("d").alias("description"))
    names = ledgers.prepared(spark.createDataFrame([(1, "red bolts", ""), (2, "blue gear", "")], "pos int, name string, parent_group string"))
    assert {r.description: r.ledger for r in ledgers.by_fuzzy(given, names).collect()} == {"red bolt": "red bolts", "blu gear": "blue gear"}
    assert made.value == 5


def test_tiers_read_what_is_left(spark, monkeypatch):
    plans = []
    keep = ledgers.by_fuzzy
    monkeypatch.setattr(ledgers, "by_fuzzy", lambda d, *a: (plans.append(d._jdf.queryExecution().executedPlan().toString()), keep(d, *a))[1])
    names = spark.createDataFrame([(1, "Red Bolt", ""), (2, "Suspense A/c", "")], "pos int, name string, parent_group string")
    rules = spark.createDataFrame([], "id string, pattern string, match_type string, ledger_name string, voucher_type string, priority int, enabled boolean, created_at int")
    got = ledgers.match(spark.createDataFrame([("red bolt",), ("UPI/RED BOLT/1",), ("redd bolt",), ("?",), (None,)], "description string"), names, rules)
    assert {r.description: r.method for r in got.collect()} == {"red bolt": "Exact ledger name", "UPI/RED BOLT/1": "Keyword", "redd bolt": "Fuzzy", "?": "Default suspense", None: "Default suspense"}
    assert len(plans) == 1 and "Join" not in plans[0]


def test_few_and_many_words_find_the_same_ledgers(spark, monkeypatch):
    names = spark.createDataFrame([(1, "Red Bolt", ""), (2, "Bolt Red", ""), (3, "Bolt", ""), (4, "A&B Bolt", ""), (5, "Red Red Gear", ""), (6, "??", ""), (7, "zinc bank", "")], "pos int, name string, parent_group string")
    texts = ["a red bolt", "bolt", "a&b bolt", "A & B bolt", "gear red", "Zinc", "redbolt", "", None, "red&bolt"]
    df = spark.createDataFrame([(t,) for t in texts], "description string")
    few = ledgers.by_keyword(df, ledgers.prepared(names)).select("description", "ledger")
    assert {tuple(r) for r in few.collect()} == {("a red bolt", "Red Bolt"), ("bolt", "Bolt"), ("a&b bolt", "A&B Bolt"), ("A & B bolt", "Bolt"), ("gear red", "Red Red Gear"), ("Zinc", "zinc bank"), ("red&bolt", "Red Bolt")}
    monkeypatch.setattr(ledgers, "FEW", 0)
    same(few, ledgers.by_keyword(df, ledgers.prepared(names)).select("description", "ledger"))
