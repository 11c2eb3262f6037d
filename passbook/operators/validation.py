"""Checks of transactions, with statuses and messages in a fixed order."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passbook.functions.text import filled, has_control, is_numeric_reference, strip
from passbook.functions.values import signed_amounts


def _some(*found: Column) -> Column:
    """The messages that apply, in order."""
    return F.filter(F.array(*found), lambda m: m.isNotNull())


def _say(when: Column, message: str) -> Column:
    return F.when(when, F.lit(message))


def _blank(c: str) -> Column:
    return strip(filled(c)) == ""


def _ledger_errors(bank_missing: str, opposite_missing: str) -> list[Column]:
    bank, opposite = strip(filled("bank_ledger")), strip(filled("opposite_ledger"))
    return [
        _say(bank == "", bank_missing),
        _say((bank != "") & is_numeric_reference(bank), "Bank ledger must be a Tally ledger name, not a numeric index"),
        F.when(opposite == "", F.lit(opposite_missing))
        .when(is_numeric_reference(opposite), F.lit("Opposite ledger must be a Tally ledger name, not a numeric index"))
        .when(F.lower(opposite) == F.lower(bank), F.lit("Bank and opposite ledgers cannot be the same")),
    ]


def _outside(start: date | None, end: date | None) -> Column:
    day = F.col("transaction_date")
    out = F.lit(False)
    if start:
        out = out | (day < F.lit(start))
    if end:
        out = out | (day > F.lit(end))
    return F.coalesce(out, F.lit(False))


def _suspense() -> Column:
    return F.contains(F.lower(filled("opposite_ledger")), F.lit("suspense"))


def review(transactions: DataFrame, start: date | None = None, end: date | None = None, require_ledgers: bool = False) -> DataFrame:
    """transactions with validation_status and validation_message for review: errors first, then warnings."""
    d, c = F.col("debit_amount"), F.col("credit_amount")
    kind = F.col("voucher_type")
    no_ledger = _blank("opposite_ledger")
    errors = _some(
        _say(F.col("transaction_date").isNull(), "Invalid or missing date"),
        _say((d < 0) | (c < 0), "Negative amount is in the wrong normalized column"),
        F.when((d != 0) & (c != 0), F.lit("Both debit and credit are entered")).when((d == 0) & (c == 0), F.lit("Missing amount")),
        F.when(kind == "Unassigned", F.lit("Missing voucher type"))
        .when((kind == "Payment") & (d == 0), F.lit("Payment voucher must contain a debit/withdrawal"))
        .when((kind == "Receipt") & (c == 0), F.lit("Receipt voucher must contain a credit/deposit")),
        *(_ledger_errors("Missing bank ledger", "Missing opposite ledger") if require_ledgers else []),
        _say(has_control(filled("description")) | has_control(filled("narration")) | has_control(filled("reference_number")), "Contains an invalid XML control character"),
    )
    warnings = _some(
        _say(_outside(start, end), "Transaction is outside the selected period"),
        _say(_blank("description"), "Missing description"),
        *([] if require_ledgers else [_say(no_ledger, "Opposite ledger is unmatched")]),
        _say(~no_ledger & ((F.col("matching_confidence") == 0) | _suspense()), "Unmatched ledger uses Suspense a/c"),
        F.when(F.col("duplicate_status") == "Suspected", F.lit("Possible duplicate")).when(F.col("duplicate_status") == "Confirmed duplicate", F.lit("Confirmed duplicate")),
    )
    out = transactions.withColumns({"_e": errors, "_w": warnings})
    said = F.concat_ws("; ", "_e", "_w")
    status = F.when(F.col("ignored"), "Warning").when(F.size("_e") > 0, "Invalid").when(F.size("_w") > 0, "Warning").otherwise("Valid")
    message = F.when(F.col("ignored"), "Ignored by user").when(said == "", "Ready").otherwise(said)
    return out.withColumns({"validation_status": status, "validation_message": message}).drop("_e", "_w")


def export_issues(transactions: DataFrame, company: str, start: date | None = None, end: date | None = None) -> DataFrame:
    """(id, row_number, position, severity, message) of what stands against exporting each row that is not ignored."""
    active = transactions.where(~F.col("ignored"))
    d, c, kind = F.col("debit_amount"), F.col("credit_amount"), F.col("voucher_type")
    signed = signed_amounts(d, c)
    texts = ("description", "narration", "reference_number", "cheque_number")
    control = F.lit(False)
    for t in texts:
        control = control | has_control(filled(t))
    if not company.strip():
        errors, warnings = F.array(F.lit("Tally company is not selected")), F.array().cast("array<string>")
    else:
        errors = _some(
            F.when(F.col("transaction_date").isNull(), F.lit("Invalid or missing transaction date")).when(_outside(start, end), F.lit("Transaction is outside the selected export period")),
            F.when((d < 0) | (c < 0), F.lit("A normalized debit or credit amount is negative"))
            .when((d != 0) & (c != 0), F.lit("Both debit and credit are entered"))
            .when((d == 0) & (c == 0), F.lit("Voucher amount is zero or missing")),
            *_ledger_errors("Bank ledger is missing", "Opposite ledger is missing"),
            F.when(~kind.isin("Payment", "Receipt", "Contra"), F.lit("Voucher type is missing or unsupported"))
            .when((kind == "Payment") & (d == 0), F.lit("Payment voucher must contain a debit/withdrawal"))
            .when((kind == "Receipt") & (c == 0), F.lit("Receipt voucher must contain a credit/deposit")),
            _say(control, "Contains an XML-forbidden control character"),
            _say(signed["bank"] + signed["opposite"] != 0, "Voucher debit and credit totals are unbalanced"),
        )
        warnings = _some(
            F.when(F.col("duplicate_status") == "Confirmed duplicate", F.lit("Confirmed duplicate has not been ignored or marked unique"))
            .when(F.col("duplicate_status") == "Suspected", F.lit("Possible duplicate has not been confirmed")),
            _say((F.col("matching_confidence") == 0) | _suspense(), "Unmatched ledger uses Suspense a/c"),
            _say(F.col("import_status") == "Imported", "Voucher was previously imported"),
        )
    marked = lambda found, severity: F.transform(found, lambda m: F.struct(F.lit(severity).alias("severity"), m.alias("message")))
    issues = F.concat(marked(errors, "Error"), marked(warnings, "Warning"))
    return active.select("id", "row_number", F.posexplode(issues).alias("position", "issue")).select("id", "row_number", "position", "issue.severity", "issue.message")


def exportable(transactions: DataFrame, company: str, start: date | None = None, end: date | None = None, strict: bool = True) -> DataFrame:
    """Rows without an error that are not ignored. strict: any error, or no row left, raises; one count decides."""
    wrong = export_issues(transactions, company, start, end).where("severity = 'Error'").select("id").distinct()
    if strict:
        n = wrong.count()
        if n:
            raise ValueError(f"export blocked: {n} invalid transaction(s)")
    good = transactions.where(~F.col("ignored")).join(wrong, "id", "left_anti")
    if strict and not good.limit(1).count():
        raise ValueError("no valid transaction to export")
    return good


def rule_errors(rules: DataFrame) -> DataFrame:
    """rules with errors array<string>."""
    ledger = strip(filled("ledger_name"))
    return rules.withColumn(
        "errors",
        _some(
            _say(_blank("pattern"), "Rule pattern is required."),
            F.when(ledger == "", F.lit("Ledger name is required.")).when(is_numeric_reference(ledger), F.lit("Ledger must be an actual Tally ledger name, not a numeric index.")),
            _say(~F.col("priority").between(0, 9999), "Priority must be between 0 and 9999."),
        ),
    )


def mapping_errors(mappings: DataFrame) -> DataFrame:
    """mappings with errors array<string> about columns that must be mapped."""
    return mappings.withColumn(
        "errors",
        _some(
            _say(F.col("transaction_date").isNull(), "Transaction Date must be mapped."),
            _say(F.col("description").isNull(), "Description must be mapped."),
            _say(F.col("debit").isNull() & F.col("credit").isNull() & F.col("amount").isNull(), "Map Debit/Credit columns or a single Amount column."),
        ),
    )
