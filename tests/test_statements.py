"""Small statements with known results."""

import random
import xml.etree.ElementTree as ET
from datetime import date
from decimal import Decimal
from difflib import SequenceMatcher
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from passbook.functions import text, values
from passbook.operators import duplicates, layout, ledgers, parsing, review, summaries, templates, validation, vouchers
from passbook.sources import raw, tables
from passbook.sources import xml as xml_source

D = Decimal


def rows(spark, *cells):
    return spark.createDataFrame([("d", i + 1, list(c)) for i, c in enumerate(cells)], "doc_id string, row_number int, cells array<string>")


def test_split_debit_and_credit(spark):
    head = ["Transaction Date", "Particulars", "Ref No", "Withdrawal", "Deposit", "Balance"]
    r = rows(
        spark, head, ["01/07/2026", "UPI/DEMO/TRADING", "UTR001", "1,250.50", "", "8,749.50"], ["02/07/2026", "Interest credit", "", "", "12.75", "8,762.25"], head,
        ["", "Closing Balance", "", "", "", "8,762.25"], ["not-a-date", "Malformed", "", "10", "", ""],
    )
    m = parsing.suggest_mapping(r)
    got = m.first()
    assert (got.transaction_date, got.description, got.reference_number, got.debit, got.credit, got.balance, got.header_row) == (0, 1, 2, 3, 4, 5, 0)
    good, bad = parsing.parse(r, m)
    good = good.orderBy("row_number").collect()
    assert [(g.transaction_date, g.debit_amount, g.credit_amount, g.voucher_type) for g in good] == [(date(2026, 7, 1), D("1250.50"), D(0), "Payment"), (date(2026, 7, 2), D(0), D("12.75"), "Receipt")]
    assert [(b.row_number, b.message) for b in bad.collect()] == [(6, "Row 6: invalid transaction date 'not-a-date'")]


def test_one_amount_column_and_continuation(spark):
    r = rows(spark, ["Date", "Narration", "Amount", "DR/CR"], ["03-07-2026", "Cheque payment", "500.00", "DR"], ["04-07-2026", "NEFT receipt", "800.00", "CR"], ["05-07-2026", "Negative debit", "-15.00", ""])
    good = parsing.parse(r, parsing.suggest_mapping(r))[0].orderBy("row_number").collect()
    assert [(g.debit_amount, g.credit_amount) for g in good] == [(D(500), D(0)), (D(0), D(800)), (D(15), D(0))]
    r = rows(spark, ["Date", "Narration", "Debit", "Credit", "Balance"], ["01/07/2026", "UPI PAYMENT TO", "1,250.50", "", "8,749.50"], ["", "DEMO TRADERS UTR001", "", "", ""], ["02/07/2026", "INTEREST", "", "12.75", "8,762.25"])
    good, bad = parsing.parse(r, parsing.suggest_mapping(r))
    good = good.orderBy("row_number").collect()
    assert len(good) == 2 and good[0].description == good[0].narration == "UPI PAYMENT TO DEMO TRADERS UTR001" and bad.count() == 0


def test_mapping_claims_and_templates(spark):
    m = parsing.suggest_mapping(rows(spark, ["Value Date", "Transaction Date", "Narration", "Debit"])).first()
    assert (m.value_date, m.transaction_date, m.description, m.debit) == (0, 1, 2, 3)
    only = validation.mapping_errors(parsing.suggest_mapping(rows(spark, ["Date", "Narration"]))).first()
    assert only.errors == ["Map Debit/Credit columns or a single Amount column."]
    r = rows(spark, ["x", "y", "z"], ["Wann", "Was", "Soll"], ["31.12.2025", "Miete", "5"])
    ddl = "doc_id string, column_aliases map<string,array<string>>, mapping struct<" + ",".join(f"{f}:int" for f in [*parsing.FIELDS, "header_row"]) + ",date_format:string>"
    t = spark.createDataFrame([("d", {"transaction_date": ["Wann"], "description": ["Was"]}, {"debit": 2, "header_row": 1, "date_format": "%d.%m.%Y"})], ddl)
    m = parsing.suggest_mapping(r, t)
    got = m.first()
    assert (got.transaction_date, got.description, got.debit, got.header_row, got.date_format) == (0, 1, 2, 1, "%d.%m.%Y")
    good = parsing.parse(r, m, formats=["%d.%m.%Y"])[0].collect()
    assert [(g.transaction_date, g.description, g.debit_amount) for g in good] == [(date(2025, 12, 31), "Miete", D(5))]


def test_cleanup_and_ignored_phrases(spark):
    r = rows(spark, ["Date", "Narration", "Debit"], ["1/1/2026", "A  to  B 123", "5"], ["1/1/2026", "my total", "6"], ["1/1/2026", "Total Gas", "7"])
    m = parsing.suggest_mapping(r).withColumns({"cleanup_rules": F.expr(r"array(named_struct('pattern', r'(\w) to (\w)', 'replacement', r'\2-\1'), named_struct('pattern', r' \d+$', 'replacement', ''))"), "ignore_phrases": F.array(F.lit("My Total"))})
    assert [g.description for g in parsing.parse(r, m)[0].collect()] == ["B-A"]


@pytest.mark.parametrize(
    "raw_,value,error",
    [("1,23,456.78", "123456.78", 0), ("₹ 250.5", "250.50", 0), ("(1,000.00)", "-1000.00", 0), ("-42", "-42.00", 0), ("-", "0.00", 0), (None, "0.00", 0), ("Infinity", None, 1), ("FINANCE 10", None, 1), ("0.125", "0.12", 0), ("Rs. 500", "0.50", 0), ("Rs. 500.00", None, 1), ("500-", None, 1), ("  7 ", "7.00", 0)],
)
def test_amounts(spark, raw_, value, error):
    got = spark.createDataFrame([(raw_,)], "t string").select(values.parse_decimal("t").alias("v")).first().v
    assert (got.value, got.error) == (D(value) if value else None, bool(error))


@pytest.mark.parametrize("t,day", [("01/07/2026", date(2026, 7, 1)), ("07/13/2026", date(2026, 7, 13)), ("1-Jul-26", date(2026, 7, 1)), ("2 JAN 2026", date(2026, 1, 2)), ("3.4.26", date(2026, 4, 3)), ("2026-07-01", date(2026, 7, 1)), ("01/07/2026 11:14 AM", date(2026, 7, 1)), ("31/02/2026", None), ("", None), ("x", None)])
def test_dates(spark, t, day):
    assert spark.createDataFrame([(t,)], "t string").select(values.parse_date("t").alias("d")).first().d == day


def test_redaction(spark):
    df = spark.createDataFrame([("Account 123456789012 and ref 1234; pay person.name@bank",)], "t string")
    assert df.select(text.redact("t").alias("t")).first().t == "Account ••••••••9012 and ref 1234; pay pe***@bank"
    assert spark.createDataFrame([("UPI/abc@okhdfc/DEMO/123456789012",)], "t string").select(text.normalize("t").alias("t")).first().t == "demo"


BASE = dict(
    session_id="s", row_number=1, id="a", transaction_date=date(2026, 7, 1), value_date=None, description="UPI DEMO TRADERS", reference_number="UTR001", cheque_number="", debit_amount=D("1250.50"), credit_amount=D(0), balance=D("8749.50"), voucher_type="Payment",
    bank_ledger="", opposite_ledger="", narration="", tally_voucher_number="", matching_confidence=0, matching_method="", matching_rule_id="", import_status="Not exported", import_message="", validation_status="Valid", validation_message="", duplicate_status="None", duplicate_of="", ignored=False, created_at=None,
)
DDL = (
    "session_id string, row_number long, id string, transaction_date date, value_date date, description string, reference_number string, cheque_number string, debit_amount decimal(28,2), credit_amount decimal(28,2), balance decimal(28,2), voucher_type string, "
    "bank_ledger string, opposite_ledger string, narration string, tally_voucher_number string, matching_confidence int, matching_method string, matching_rule_id string, import_status string, import_message string, validation_status string, validation_message string, duplicate_status string, duplicate_of string, ignored boolean, created_at timestamp_ntz"
)


def transactions(spark, *changes):
    return spark.createDataFrame([tuple((BASE | {"row_number": i + 1, "id": f"t{i}"} | c)[k] for k in BASE) for i, c in enumerate(changes)], DDL)


def score(a, b):
    norm = lambda s: " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in s.lower()).split())
    out = 30 * (a["transaction_date"] is not None and a["transaction_date"] == b["transaction_date"])
    side = lambda x: ("D", x["debit_amount"]) if x["debit_amount"] else ("C", x["credit_amount"])
    out += 30 * (side(a) == side(b) and side(a)[1] != 0)
    out += 20 * (norm(a["reference_number"]) != "" and norm(a["reference_number"]) == norm(b["reference_number"]))
    ratio = SequenceMatcher(None, norm(a["description"]), norm(b["description"])).ratio()
    return out + (15 if ratio >= 0.9 else 10 if ratio >= 0.7 else 0) + 5 * (a["balance"] is not None and a["balance"] == b["balance"])


def test_duplicate_pairs_query_has_all_pairs_from_75(spark, monkeypatch):
    from passbook.plans import catalogue

    rng = random.Random(3)
    changes = [dict(debit_amount=D(rng.choice([5, 6])), reference_number=rng.choice(["", "r1"]), description=rng.choice(["demo shop one", "demo shop two", "rent"]), balance=rng.choice([None, D(1)])) for _ in range(40)]
    full = [BASE | {"id": f"t{i}"} | c for i, c in enumerate(changes)]
    want = {(a["id"], b["id"]): s for i, a in enumerate(full) for b in full[i + 1 :] if (s := score(a, b)) >= 75}
    df = transactions(spark, *changes).repartition(3)
    monkeypatch.setattr(catalogue.b, "statements", lambda spark, sf_dir: df)
    got = catalogue.queries()["j11_duplicate_pairs_75"](spark, "").collect()
    assert {(r.original_id, r.duplicate_id): r.score for r in got} == want
    assert len(got) == len(want) and {75, 80, 100} <= set(want.values())


@pytest.mark.parametrize("threshold", [40, 55, 75])
def test_duplicate_pairs_equal_brute_force(spark, threshold):
    rng = random.Random(threshold)
    changes = [
        dict(transaction_date=rng.choice([None, date(2026, 7, 1), date(2026, 7, 2)]), debit_amount=D(d := rng.choice([0, 5, 6])), credit_amount=D(0 if d else rng.choice([0, 5])), reference_number=rng.choice(["", "r-1", "R 1", "r2"]),
             description=rng.choice(["", "demo shop one", "demo shop two", "rent"]), balance=rng.choice([None, D(1), D(2)]), ignored=rng.random() < 0.1, duplicate_status=rng.choice(["None", "None", "Suspected", "Confirmed unique", "Confirmed duplicate"]))
        for _ in range(40)
    ]
    full = [BASE | {"id": f"t{i}"} | c for i, c in enumerate(changes)]
    want = {(a["id"], b["id"]): s for i, a in enumerate(full) for b in full[i + 1 :] if not a["ignored"] and not b["ignored"] and b["duplicate_status"] != "Confirmed unique" and (s := score(a, b)) >= threshold}
    df = transactions(spark, *changes).repartition(3)
    found = duplicates.pairs(df, threshold)
    assert {(r.original_id, r.duplicate_id): r.score for r in found.collect()} == want
    last = {b: a for a, b in sorted(want, key=lambda p: int(p[0][1:]))}
    for r in duplicates.mark(df, found).collect():
        was = full[int(r.id[1:])]["duplicate_status"]
        assert r.duplicate_status == ("Suspected" if r.id in last and was != "Confirmed duplicate" else "None" if was == "Suspected" else was)
        assert r.duplicate_of == (last[r.id] if r.id in last and was != "Confirmed duplicate" else "")


LEDGERS = [("Cash", "Cash-in-Hand"), ("Demo Bank A/c", "Bank Accounts"), ("Demo Traders", "Sundry Creditors"), ("Suspense A/c", "Suspense A/c")]


def dimension(spark):
    return spark.createDataFrame([(i + 1, n, p) for i, (n, p) in enumerate(LEDGERS)], "pos int, name string, parent_group string")


def rules(spark, *given):
    return spark.createDataFrame(list(given), "id string, pattern string, match_type string, ledger_name string, voucher_type string, priority int, enabled boolean, use_count int, created_at int")


def test_ledger_cascade(spark):
    r = rules(spark, ("r1", "SPECIAL", "Contains", "cash", "Contra", 5, True, 0, 1), ("r2", "(", "Regex", "Cash", "Unassigned", 1, True, 0, 1), ("r3", "special", "Contains", "Nobody", "Unassigned", 0, True, 0, 1))
    want = {
        "a special one": ("Cash", 100, "Saved Rule"), "Demo Traders": ("Demo Traders", 100, "Exact ledger name"), "PAY TO DEMO TRADERS VIA UPI": ("Demo Traders", 94, "Keyword"), "XCASHX": ("Cash", 88, "Substring"),
        "DEMOTRADERS": ("Demo Traders", 84, "Normalized text"), "Demmo Tradrs": ("Demo Traders", 91, "Fuzzy"), "UNRELATED MERCHANT XYZ": ("Suspense A/c", 0, "Default suspense"),
    }
    df = spark.createDataFrame([(d,) for d in want], "description string")
    got = {m.description: m for m in ledgers.match(df, dimension(spark), r, 78).collect()}
    best = round(SequenceMatcher(None, "demmo tradrs", "demo traders").ratio() * 100)
    for d, (l, c, how) in want.items():
        assert (got[d].ledger, got[d].confidence, got[d].method) == (l, best if how == "Fuzzy" else c, how), d
    t = transactions(spark, {"description": "a special one"}, {"description": "NEFT TRANSFER CASH"}, {"description": "demo traders", "ignored": True}, {"description": "Annual fee", "debit_amount": D(0), "credit_amount": D(3)})
    out = {x.id: x for x in ledgers.apply(t, dimension(spark), r, "Demo Bank A/c").collect()}
    assert [out[f"t{i}"].voucher_type for i in range(4)] == ["Contra", "Contra", "Payment", "Payment"]
    assert out["t2"].opposite_ledger == "" and out["t0"].matching_rule_id == "r1"
    uses = tables.count_rule_uses(r, spark.createDataFrame(list(out.values()), DDL))
    assert {x.id: x.use_count for x in uses.collect()} == {"r1": 1, "r2": 0, "r3": 0}


def test_validation_and_reconciliation(spark):
    t = validation.review(transactions(spark, {}, {"debit_amount": D(0)}, {"ignored": True}, {"opposite_ledger": "Cash", "matching_confidence": 90}))
    got = {r.id: (r.validation_status, r.validation_message) for r in t.collect()}
    assert got["t0"] == ("Warning", "Opposite ledger is unmatched") and got["t2"] == ("Warning", "Ignored by user") and got["t3"] == ("Valid", "Ready")
    assert got["t1"] == ("Invalid", "Missing amount; Payment voucher must contain a debit/withdrawal; Opposite ledger is unmatched")
    one = summaries.reconcile(transactions(spark, {}), spark.createDataFrame([("s", D(10000), D("8749.50"))], "session_id string, opening_balance decimal(28,2), closing_balance decimal(28,2)")).first()
    assert (one.expected_closing_balance, one.difference) == (D("8749.50"), D(0))
    with pytest.raises(ValueError):
        validation.exportable(transactions(spark, {}), "Co")
    assert {r.message for r in validation.export_issues(transactions(spark, {}), " ").collect()} == {"Tally company is not selected"}


def test_vouchers_balance_and_xml(spark, tmp_path):
    t = transactions(spark, {"bank_ledger": "Bank & Co", "opposite_ledger": "A<B", "narration": "n"}, {"bank_ledger": "Bank", "opposite_ledger": "C", "debit_amount": D(0), "credit_amount": D(250), "voucher_type": "Receipt", "reference_number": "", "transaction_date": date(2026, 8, 2)})
    e = vouchers.entries(t)
    assert {r.transaction_id: r.balanced for r in vouchers.balances(e).collect()} == {"t0": True, "t1": True}
    got = {(r.transaction_id, r.entry_no): (r.ledger_name, r.amount, r.deemed_positive, r.allocation and r.allocation.name) for r in e.collect()}
    assert got[("t0", 2)] == ("Bank & Co", D("1250.50"), False, "UTR001") and got[("t1", 2)] == ("Bank", D(-250), True, None) and got[("t1", 1)] == ("C", D(250), False, None)
    messages = vouchers.grouped(t, "month").select("id", "group_key").join(vouchers.voucher_xml(t), "id")
    xml_source.write_vouchers(messages, "Demo & Sons", f"{tmp_path}/out")
    files = [f for f in Path(f"{tmp_path}/out").rglob("part-*")]
    assert {f.parent.parent.name for f in files} == {"group_key=2026-07", "group_key=2026-08"}
    first = ET.fromstring(next(f for f in files if "2026-07" in str(f)).read_text())
    assert first.find(".//SVCURRENTCOMPANY").text == "Demo & Sons" and first.find(".//PARTYLEDGERNAME").text == "A<B"
    assert [x.text for x in first.findall(".//ALLLEDGERENTRIES.LIST/AMOUNT")] == ["-1250.50", "1250.50"] and first.find(".//VOUCHERNUMBER").text == "BST-20260701-00001"


def test_import_outcome_after_a_lost_connection(spark):
    r = spark.createDataFrame([("b", 1, "x", 1, 0, 0, 0, 0, 0, "", None), ("b", 2, "y", 0, 0, 1, 0, 0, 0, "Invalid ledger", None), ("b", 3, "z", 0, 0, 0, 0, 0, 0, "", "timeout"), ("b", 4, "w", 1, 0, 0, 0, 0, 0, "", None)],
                              "batch_id string, position int, id string, created int, altered int, errors int, exceptions int, ignored int, cancelled int, message string, connection_error string")
    out = vouchers.import_outcome(r)
    assert [(x.id, x.import_status, x.message) for x in out.orderBy("position").collect()] == [("x", "Imported", ""), ("y", "Failed", "Invalid ledger"), ("z", "Failed", "timeout"), ("w", "Failed", "Import stopped: timeout")]
    got = summaries.import_totals(out).first()
    assert (got.total_vouchers, got.created, got.failed, got.messages) == (4, 1, 3, ["Invalid ledger", "timeout", "Import stopped: timeout"])


def test_xml_sources(spark, tmp_path):
    p = tmp_path / "l.xml"
    p.write_text('<ENVELOPE><DESC><LEDGER>4</LEDGER></DESC><COLLECTION><LEDGER NAME="Zed  &amp; Co"><PARENT>Bank&#4;Accounts</PARENT><GUID>g1</GUID></LEDGER><LEDGER><NAME>\x0balpha</NAME></LEDGER><LEDGER NAME="ALPHA"/><VOUCHERTYPE NAME="Payment"/><VOUCHERTYPE NAME="contra"/></COLLECTION></ENVELOPE>')
    assert [tuple(r) for r in xml_source.ledgers(spark, str(p)).orderBy("pos").collect()] == [(1, "alpha", "", ""), (2, "Zed & Co", "Bank Accounts", "g1")]
    assert [r.name for r in xml_source.voucher_types(spark, str(p)).collect()] == ["contra", "Payment"]
    q = tmp_path / "r.xml"
    q.write_text("<RESPONSE><CREATED>1</CREATED><ALTERED>x</ALTERED><ERRORS>2</ERRORS><LASTVCHID>77</LASTVCHID><LINEERROR>a &lt; b</LINEERROR><LINEERROR> c </LINEERROR></RESPONSE>")
    r = xml_source.responses(spark, str(q)).first()
    assert (r.created, r.altered, r.errors, r.last_id, r.messages, r.succeeded) == (1, 0, 2, "77", ["a < b", "c"], False)
    fixed = spark.createDataFrame([("a&#4;b&#38;c\x0b&#x1F;&#65534;&#x41;&#55296;",)], "t string").select(raw.repaired_xml(F.col("t")).alias("x")).first().x
    assert (fixed.text, fixed.repairs) == ("a b&#38;c   &#x41; ", 5)


def test_templates(spark, tmp_path):
    t = spark.createDataFrame([(1, "sbi", "State Bank", ["SBI"]), (2, "kotak", "Kotak", ["KKBK", "Kotak Mahindra Bank"]), (3, "union", "Union Bank", ["Union Bank"])], "pos int, template_id string, bank_name string, detection_keywords array<string>")
    docs = spark.createDataFrame([(1, "IFSC KKBK0009290 NEFT SBIN525198721413"), (2, "Statement of Union  Bank " + "filler words " * 200 + "Beneficiary Bank KOTAK MAHINDRA BANK"), (3, "nothing"), (4, None)], "doc_id long, text string")
    assert {r.doc_id: r.template_id for r in templates.detect(docs, t).collect()} == {1: "kotak", 2: "union"}
    assert [r.template_id for r in templates.by_bank(spark.createDataFrame([(" kotak ",), ("x",)], "bank_name string"), t).orderBy("bank_name").collect()] == ["kotak", None]
    (tmp_path / "a.json").write_text('{"template_id": "one", "bank_name": "One", "mapping": {"debit": 3}}')
    (tmp_path / "b.json").write_text('{"defaults": {"ignore_phrases": ["x"], "mapping": {"header_row": 2, "debit": 1}}, "templates": [{"template_id": "two", "bank_name": "Two", "mapping": {"debit": 4}}, {"template_id": "one", "bank_name": "Uno"}]}')
    (tmp_path / "c.json").write_text("{bad")
    got = {r.template_id: r for r in tables.load_templates(spark, str(tmp_path)).collect()}
    assert (got["two"].mapping.debit, got["two"].mapping.header_row, got["two"].ignore_phrases) == (4, 2, ["x"]) and (got["one"].bank_name, got["one"].mapping.debit) == ("Uno", 1)


def words(spark, *given):
    return spark.createDataFrame([("d", 1, t, float(x), float(y)) for t, x, y in given], "doc_id string, page int, text string, x0 double, top double")


HEAD = [("Date", 10, 50), ("Particulars", 80, 50), ("Withdrawal", 200, 51), ("Deposit", 280, 50), ("Balance", 360, 50.5)]


def test_lines_are_anchored_at_their_first_word(spark):
    w = words(spark, ("a", 10, 10), ("b", 20, 11.5), ("c", 30, 12.5), ("d", 5, 14), (" ", 1, 1))
    assert {r.text: r.line for r in layout.lines(w).collect()} == {"a": 1, "b": 1, "c": 2, "d": 2}
    assert [r.text for r in layout.line_text(layout.lines(w)).orderBy("line").collect()] == ["a b", "d c"]


def test_recognised_rows_and_date_bands(spark):
    body = [("01/08/2026", 10, 70), ("UPI", 80, 70), ("shop", 100, 70), ("17.70", 200, 70), ("99", 360, 70), ("more", 80, 80), ("02/08/2026", 10, 90), ("Interest", 82, 88.5), ("5", 280, 90), ("104", 360, 90)]
    w = words(spark, *HEAD, *body)
    got = [r.cells for r in layout.recognised_rows(w).orderBy("line").collect()]
    assert got[0] == ["Transaction Date", "Particulars", "Withdrawals", "Deposits", "Balance Amount"] and got[1] == ["01/08/2026", "UPI shop", "17.70", "", "99"] and got[2] == ["", "more", "", "", ""]
    head = layout.headers(layout.lines(w))
    bands = [r.cells for r in layout.date_rows(w, head).orderBy("band").collect()]
    assert bands == [["01/08/2026", "UPI shop more", "17.70", "", "99"], ["02/08/2026", "Interest", "", "5", "104"]]


def test_serial_bands_and_rectangles(spark):
    head = [("SlNo", 5, 50), ("Date", 30, 50), ("Particulars", 100, 50), ("Debit", 200, 50), ("Credit", 280, 50), ("Balance", 360, 50)]
    w = words(spark, *head, ("1", 5, 70), ("23-04-2025", 30, 70), ("UPI/", 100, 69), ("reference", 100, 80), ("5", 200, 70), ("2", 5, 100), ("24-04-2025", 30, 100), ("x", 280, 100), ("auto", 150, 100), ("generated", 170, 100), ("Statement", 30, 130), ("generated", 60, 130), ("on", 90, 130), ("3", 5, 140))
    h = layout.headers(layout.lines(w))
    assert [r.cells for r in layout.serial_rows(w, h).orderBy("band").collect()] == [["1", "23-04-2025", "UPI/ reference", "5", "", ""], ["2", "24-04-2025", "auto generated", "", "x", ""]]
    rects = spark.createDataFrame([("d", 1, 0.0, 500.0, 66.0, 90.0), ("d", 1, 0.0, 500.0, 96.0, 110.0), ("d", 1, 0.0, 90.0, 96.0, 110.0), ("d", 1, 0.0, 500.0, 125.0, 135.0)], "doc_id string, page int, x0 double, x1 double, top double, bottom double")
    assert [r.cells[:3] for r in layout.rectangle_rows(w, rects, h).orderBy("top").collect()] == [["1", "23-04-2025", "UPI/ reference"], ["2", "24-04-2025", "auto generated"]]


def test_headers_are_carried_and_projected(spark):
    pages = spark.createDataFrame([("d", 1), ("d", 2), ("d", 3), ("e", 1)], "doc_id string, page int")
    found = layout.headers(layout.lines(words(spark, *HEAD).withColumn("page", F.lit(2))))
    got = {(r.doc_id, r.page): (r.own, r.top) for r in layout.carried_headers(pages, found).collect()}
    assert got == {("d", 2): (True, 50.0), ("d", 3): (False, None)}
    r = spark.createDataFrame([("d", ["b", "a"], ["2", "1"])], "doc_id string, labels array<string>, cells array<string>")
    t = spark.createDataFrame([("d", ["a", "c", "b"])], "doc_id string, labels array<string>")
    assert layout.projected(r, t).first().cells == ["1", "", "2"]
    checks = spark.createDataFrame([(["Date", "Narration", "Debit"],), (["Date", "Narration"],)], "c array<string>").select(layout.is_header_row(F.col("c")).alias("x")).collect()
    assert [c.x for c in checks] == [True, False]


def test_recognised_text(spark):
    w = spark.createDataFrame([("d", 1, 2, "b", 5.0, 20.0, 80.0), ("d", 1, 2, "a", 1.0, 21.0, 60.0), ("d", 1, 1, "top", 1.0, 1.0, -1.0)], "doc_id string, page int, line int, text string, x0 double, top double, confidence double")
    got = layout.recognised_text(w).first()
    assert (got.text, got.confidence) == ("top\na b", 70.0)


def test_text_rows_and_choice(spark):
    pages = spark.createDataFrame([("d", 1, "a  b\tc\n\n  x "), ("d", 2, "t"), ("d", 3, None)], "doc_id string, page int, text string")
    t = raw.text_rows(pages, "doc_id", "page")
    assert [(r.page, r.row_number, r.cells) for r in t.orderBy("page", "row_number").collect()] == [(1, 1, ["a", "b", "c"]), (1, 2, ["x"]), (2, 1, ["t"])]
    tab = spark.createDataFrame([("d", 2, 1, 1, ["q", "r", "s"])], "doc_id string, page int, table_no int, row_no int, cells array<string>")
    assert [(r.row_number, r.cells) for r in raw.choose_rows(tab, t).orderBy("row_number").collect()] == [(1, ["a", "b", "c"]), (2, ["x"]), (3, ["q", "r", "s"])]
    assert [r.page for r in raw.pages_without_text(pages, tab).collect()] == [3]


def test_corrections(spark):
    c = spark.createDataFrame([("a", "balance", ""), ("a", "debit_amount", "(5)"), ("a", "debit_amount", "inf"), ("a", "transaction_date", "2026-02-30"), ("a", "value_date", ""), ("a", "voucher_type", "Nope"), ("a", "narration", " x ")], "id string, field string, value string")
    got = [(r.field, r.money, r.day, r.text, r.error) for r in review.typed_corrections(c).collect()]
    assert got == [("balance", None, None, None, None), ("debit_amount", D(-5), None, None, None), ("debit_amount", None, None, None, "Invalid amount: inf"), ("transaction_date", None, None, None, "Invalid date: 2026-02-30"), ("value_date", None, None, None, None), ("voucher_type", None, None, "Nope", "Unknown voucher type: Nope"), ("narration", None, None, "x", None)]


@pytest.mark.parametrize("threshold", [40, 60, 70, 78, 90, 100])
def test_fuzzy_equals_brute_force(spark, threshold):
    import random
    from difflib import SequenceMatcher

    rng = random.Random(threshold)
    base = ["".join(rng.choice("abcde ") for _ in range(rng.randint(1, 24))).strip() or "a" for _ in range(40)]

    def worn(t):
        t = list(t)
        for _ in range(rng.randrange(5)):
            k = rng.randrange(len(t) + 1)
            t[k : k + rng.randrange(2)] = rng.choice(["", "a", "f"])
        return "".join(t).strip()

    names = list(dict.fromkeys(" ".join(b.split()) for b in base if b.split()))
    texts = list(dict.fromkeys([" ".join(worn(b).split()) for b in base * 3] + ["", "x"]))
    table = spark.createDataFrame([(i, n, n) for i, n in enumerate(names)], "pos int, name string, norm string")
    got = {r.description: (r.ledger, r.confidence) for r in ledgers.by_fuzzy(spark.createDataFrame([(t,) for t in texts], "description string"), table, threshold).collect()}
    want = {}
    for t in texts:
        scored = [(round(SequenceMatcher(None, t, n).ratio() * 100), -i, n) for i, n in enumerate(names)]
        best = max(scored)
        if best[0] >= threshold:
            want[t] = (best[2], best[0])
    assert got == want


def test_rules_that_only_another_engine_knows(spark):
    names = dimension(spark)
    given = rules(spark, ("R1", "(?P<x>demo)", "Regex", "Cash", "Unassigned", 1, True, 0, 1), ("R2", "demo", "Contains", "Cash", "Unassigned", 2, True, 0, 1))
    got = ledgers.match(spark.createDataFrame([("pay demo",)], "description string"), names, given).first()
    assert got.rule_id == "R2"


def test_date_sections(spark):
    head = [("DATE", 10), ("PARTICULARS", 80), ("CHQ.NO.", 300), ("WITHDRAWALS", 380), ("DEPOSITS", 470), ("BALANCE", 560)]
    at = lambda top, *ws: [(t, float(x), float(top)) for t, x in ws]
    given = [
        *at(100, *head), *at(120, ("01-07-2026", 10), ("NEFT", 80), ("in", 115), ("R1", 300), ("500.00", 470), ("1,500.00Cr", 560)), *at(132, ("UTR", 80), ("X", 110)),
        *at(150, ("02-07-2026", 10), ("PAID", 80), ("R2", 300), ("200.00", 380), ("1,300.00Cr", 560)), *at(180, ("Cumulative", 80), ("Totals:", 145)), *at(190, ("03-07-2026", 10)),
        *at(300, *head), *at(310, ("rest", 80)), *at(320, ("03-07-2026", 10), ("CASH", 80), ("300.00", 470)), *at(350, ("see", 80), ("finacle.ubi.com", 145)), *at(360, ("04-07-2026", 10)),
    ]
    w = spark.createDataFrame([("d", 1, *g) for g in given], "doc_id string, page int, text string, x0 double, top double")
    got = [(r.section, r.band, r.cells) for r in layout.section_rows(w).orderBy("section", "band").collect()]
    labels = ["Date", "Particulars", "Cheque Number", "Withdrawals", "Deposits", "Balance Amount"]
    assert got == [
        (0, -1, labels), (0, 1, ["01-07-2026", "NEFT in UTR X", "R1", "", "500.00", "1,500.00Cr"]), (0, 2, ["02-07-2026", "PAID", "R2", "200.00", "", "1,300.00Cr"]),
        (1, -1, labels), (1, 0, ["", "rest", "", "", "", ""]), (1, 1, ["03-07-2026", "CASH", "", "", "300.00", ""]),
    ]
    # low first header: what is above it belongs to a section of its own; a page line moves its beginning
    low = [*at(20, ("Transaction", 80), ("details", 120), ("page", 160)), *at(30, ("left", 80)), *at(40, ("05-07-2026", 10), ("A", 80)), *at(300, *head), *at(310, ("not", 80)), *at(320, ("06-07-2026", 10), ("B", 80))]
    w = spark.createDataFrame([("d", 1, *g) for g in low], "doc_id string, page int, text string, x0 double, top double")
    got = [(r.section, r.band, r.cells[1]) for r in layout.section_rows(w).orderBy("section", "band").collect()]
    assert got == [(0, -1, "Particulars"), (0, 0, "left"), (0, 1, "A"), (1, -1, "Particulars"), (1, 0, "not"), (1, 1, "B")]
    # a serial column or two date words are another layout's
    for extra in ([("SlNo", 0)], [("Date", 640)]):
        w = spark.createDataFrame([("d", 1, *g) for g in [*at(100, *head, *extra), *at(120, ("01-07-2026", 10), ("A", 80))]], "doc_id string, page int, text string, x0 double, top double")
        assert layout.section_rows(w).collect() == []


def test_templates_are_deleted_unless_built_in(spark):
    from passbook.sources import tables

    t = spark.createDataFrame([("a",), ("b",)], "template_id string")
    assert [r[0] for r in tables.delete_template(t, "a", ["b"]).collect()] == ["b"]
    with pytest.raises(ValueError):
        tables.delete_template(t, "b", ["b"])


def test_lines_equal_a_loop_over_pages(spark):
    """Heights that creep, jump, repeat or agree, against the rule word by word."""
    import random

    rng = random.Random(4)
    given = []
    for p in range(40):
        top = 0.0
        for i in range(rng.randint(1, 40)):
            top += rng.choice([0.0, 0.0, 0.5, 1.5, 2.0, 2.5, 12.0])
            given.append(("d", p, rng.choice("abc"), float(rng.randrange(50)), top))
    want = {}
    for p in range(40):
        anchor, n = None, 0
        for d, _, text, x, top in sorted((g for g in given if g[1] == p), key=lambda g: (g[4], g[3], g[2])):
            if anchor is None or top - anchor > layout.LINE_GAP:
                anchor, n = top, n + 1
            want.setdefault((p, x, top, text), []).append(n)
    rng.shuffle(given)
    got = {}
    for r in layout.lines(spark.createDataFrame(given, "doc_id string, page int, text string, x0 double, top double")).collect():
        got.setdefault((r.page, r.x0, r.top, r.text), []).append(r.line)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_a_page_of_very_many_words(spark):
    rows = spark.range(50_000).selectExpr("'d' as doc_id", "0 as page", "'w' as text", "double(id % 10) as x0", "double(id div 10) * 12 as top")
    lined = layout.lines(rows)
    assert lined.agg({"line": "max"}).first()[0] == 5000 and lined.count() == 50_000


def test_two_digit_years(spark):
    from passbook.functions.values import parse_date

    texts = ["1-Jul-85", "31/12/99", "01/01/76", "01/01/75", "29/02/00", "29/02/72", "1/1/2026", "29/02/23"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] and str(r[0]) for r in rows.select(parse_date("t")).collect()]
    assert got == ["1985-07-01", "1999-12-31", "1976-01-01", "2075-01-01", "2000-02-29", "2072-02-29", "2026-01-01", None]
    assert [str(r[0]) for r in rows.where("t = '01/01/75'").select(parse_date("t", reference_year=1990)).collect()] == ["1975-01-01"]
    by_format = spark.createDataFrame([("01/02/68",), ("01/02/69",), ("29/02/72",), ("31/12/99",), ("x",)], "t string")
    assert [r[0] and str(r[0]) for r in by_format.select(parse_date("t", "%d/%m/%y")).collect()] == ["2068-02-01", "1969-02-01", "1972-02-29", "1999-12-31", None]
