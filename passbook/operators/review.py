"""Filters, corrections and status changes of a review, as set operations over all sessions."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from passbook.functions.text import filled, is_numeric_reference, strip
from passbook.functions.values import MONEY, is_bank_or_cash, parse_decimal
from passbook.functions.vocabulary import VOUCHER_TYPES
from passbook.operators.order import Ranged, ranged

_SEQ = ("row_number", "created_at", "id")


def _unmatched() -> Column:
    return (filled("opposite_ledger") == "") | (F.col("matching_confidence") == 0)


def apply_filters(
    transactions: DataFrame,
    search: str = "",
    direction: str = "All",
    voucher: str = "All",
    match: str = "All",
    validation: str = "All",
    duplicate: str = "All",
    start: date | None = None,
    end: date | None = None,
    status: str = "All",
) -> DataFrame:
    """The rows that every given filter keeps; with a date bound, rows without a date drop out."""
    out = transactions
    if search.strip():
        text = F.lower(F.concat_ws(" ", *(filled(c) for c in ("description", "reference_number", "opposite_ledger", "narration"))))
        out = out.where(F.contains(text, F.lit(search.strip().lower())))
    if direction in ("Debit", "Credit"):
        out = out.where(F.col(f"{direction.lower()}_amount") != 0)
    if voucher not in ("All", "All vouchers"):
        out = out.where(F.col("voucher_type") == voucher)
    if match in ("Matched", "Unmatched"):
        out = out.where(_unmatched() if match == "Unmatched" else ~_unmatched() & (F.col("matching_confidence") > 0))
    if validation in ("Valid", "Warning", "Error", "Invalid"):
        out = out.where(F.col("validation_status") == ("Invalid" if validation == "Error" else validation))
    if duplicate == "Duplicates":
        out = out.where(F.col("duplicate_status").isin("Suspected", "Confirmed duplicate"))
    elif duplicate == "Unique":
        out = out.where(F.col("duplicate_status") == "Confirmed unique")
    if start:
        out = out.where(F.col("transaction_date") >= F.lit(start))
    if end:
        out = out.where(F.col("transaction_date") <= F.lit(end))
    by_status = {
        "Possible duplicates": F.col("duplicate_status") == "Suspected",
        "Invalid": F.col("validation_status") == "Invalid",
        "Unmatched": _unmatched(),
        "Ignored": F.col("ignored"),
        "Failed import": F.col("import_status") == "Failed",
    }
    return out.where(by_status[status]) if status in by_status else out


def to_export(transactions: DataFrame, failed_only: bool = False, ids: DataFrame | None = None, skip_imported: bool = True) -> DataFrame:
    """Rows that are not ignored and not yet imported; only failed ones, or only those of ids, if asked for."""
    out = transactions.where(~F.col("ignored"))
    if failed_only:
        out = out.where("import_status = 'Failed'")
    if skip_imported:
        out = out.where("import_status <> 'Imported'")
    return keep_ids(out, ids) if ids is not None else out


def keep_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    return rows.join(ids.select("id"), "id", "left_semi").select(*rows.columns)


def drop_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    return rows.join(ids.select("id"), "id", "left_anti").select(*rows.columns)


def display_status(transactions: DataFrame) -> DataFrame:
    """transactions with the one status that a review shows."""
    v = F.col("validation_status")
    return transactions.withColumn(
        "display_status",
        F.when(F.col("import_status") == "Failed", "Import failed")
        .when(F.col("duplicate_status").isin("Suspected", "Confirmed duplicate"), "Duplicate")
        .when(F.col("ignored"), "Ignored")
        .when(v == "Invalid", "Error")
        .when(_unmatched(), "Unmatched")
        .when(v == "Warning", "Warning")
        .when(v == "Valid", "Valid")
        .otherwise("Not checked"),
    )


def row_class(transactions: DataFrame) -> DataFrame:
    return transactions.withColumn(
        "row_class",
        F.when(F.col("ignored"), "ignored")
        .when((F.col("validation_status") == "Invalid") | (F.col("import_status") == "Failed"), "invalid")
        .when(F.col("duplicate_status").isin("Suspected", "Confirmed duplicate"), "duplicate")
        .when(_unmatched(), "unmatched")
        .when(F.col("matching_confidence") < 85, "medium")
        .otherwise(""),
    )


def typed_corrections(corrections: DataFrame) -> DataFrame:
    """corrections(id, field, value) with money, day, text and error: what the value is under the field's type.

    Money is read as statements print it, and a blank balance is null; dates are yyyy-MM-dd, and a
    blank value date is null; a voucher type must be known; other text is stripped.
    """
    field, value = F.col("field"), strip(filled("value"))
    amount = parse_decimal(value)
    is_money = field.isin("debit_amount", "credit_amount", "balance")
    is_date = field.isin("transaction_date", "value_date")
    empty = ((field == "balance") | (field == "value_date")) & (value == "")
    day = F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(value, F.lit("yyyy-MM-dd")).cast("date"))
    error = (
        F.when(empty, None)
        .when(is_money & amount["error"], F.concat(F.lit("Invalid amount: "), value))
        .when(is_date & day.isNull(), F.concat(F.lit("Invalid date: "), value))
        .when((field == "voucher_type") & ~value.isin(*VOUCHER_TYPES), F.concat(F.lit("Unknown voucher type: "), value))
    )
    return corrections.select(
        "id", "field", "value", F.when(is_money & ~empty, amount["value"]).cast(MONEY).alias("money"), F.when(is_date & ~empty, day).alias("day"), F.when(~is_money & ~is_date, value).alias("text"), error.alias("error")
    )


def bulk_update(transactions: DataFrame, ids: DataFrame, ledger: str | None = None, voucher_type: str | None = None, ignored: bool | None = None) -> DataFrame:
    """transactions with the given values on the rows of ids; a ledger is set by hand (confidence 100) or cleared."""
    chosen = ids.select("id").distinct().withColumn("_on", F.lit(True))
    out = transactions.join(chosen, "id", "left")
    on = F.coalesce("_on", F.lit(False))
    put = lambda c, v: F.when(on, F.lit(v)).otherwise(F.col(c))
    new: dict[str, Column] = {}
    if ledger is not None:
        name = ledger.strip()
        new |= {"opposite_ledger": put("opposite_ledger", name), "matching_confidence": put("matching_confidence", 100 if name else 0), "matching_method": put("matching_method", "Manual" if name else "")}
    if voucher_type is not None:
        new["voucher_type"] = put("voucher_type", voucher_type)
    if ignored is not None:
        new["ignored"] = put("ignored", ignored)
    return out.withColumns(new).select(*transactions.columns)


def set_duplicate_status(transactions: DataFrame, ids: DataFrame, status: str) -> DataFrame:
    """transactions with a duplicate status on the rows of ids; None and Confirmed unique clear what they copy."""
    out = transactions.join(ids.select("id").distinct().withColumn("_on", F.lit(True)), "id", "left")
    on = F.coalesce("_on", F.lit(False))
    new = {"duplicate_status": F.when(on, F.lit(status)).otherwise(F.col("duplicate_status"))}
    if status in ("None", "Confirmed unique"):
        new["duplicate_of"] = F.when(on, "").otherwise(F.col("duplicate_of"))
    return out.withColumns(new).select(*transactions.columns)


def clone(transactions: DataFrame, ids: DataFrame) -> DataFrame:
    """Copies of the rows of ids, numbered on from each session's count, with ids of their own and fresh import state."""
    counts = transactions.groupBy("session_id").agg(F.count("*").alias("_n"))
    picked = keep_ids(transactions, ids).join(counts, "session_id")
    turn = F.row_number().over(Window.partitionBy("session_id").orderBy("row_number", "id"))
    new = picked.withColumn("_row", (F.col("_n") + turn).cast("long"))
    new = new.withColumns({"id": F.sha2(F.concat_ws("|", "id", F.lit("clone"), "_row"), 256), "row_number": F.col("_row"), "import_status": F.lit("Not exported"), "tally_voucher_number": F.lit(""), "duplicate_status": F.lit("None"), "duplicate_of": F.lit("")})
    return new.select(*transactions.columns)


def quarantine_rules(rules: DataFrame) -> DataFrame:
    """rules whose ledger is but a number keep it as legacy_ledger_reference and lose it."""
    bad = strip(filled("ledger_name")).rlike("^[0-9]+$")
    return rules.withColumns({"legacy_ledger_reference": F.when(bad, F.trim("ledger_name")).otherwise(""), "ledger_name": F.when(bad, "").otherwise(F.col("ledger_name"))})


def quarantine_transactions(transactions: DataFrame) -> DataFrame:
    """Likewise for transactions, whose match and validation start over."""
    bad = strip(filled("opposite_ledger")).rlike("^[0-9]+$")
    put = lambda c, v: F.when(bad, F.lit(v)).otherwise(F.col(c))
    return transactions.withColumns(
        {
            "legacy_opposite_ledger_reference": F.when(bad, F.trim("opposite_ledger")).otherwise(""),
            "opposite_ledger": put("opposite_ledger", ""),
            "matching_confidence": put("matching_confidence", 0),
            "matching_method": put("matching_method", "Legacy rule needs ledger reassignment"),
            "validation_status": put("validation_status", "Unchecked"),
            "validation_message": put("validation_message", "Legacy ledger reference needs reassignment"),
        }
    )


def bank_ledger_candidates(ledgers: DataFrame) -> DataFrame:
    """Ledgers under a bank or cash group, or all of them where there are none."""
    own = ledgers.where(is_bank_or_cash(F.col("parent_group")))
    none = own.limit(1).agg((F.count("*") == 0).alias("_none"))
    return own.unionByName(ledgers.join(F.broadcast(none.where("_none")), F.lit(True), "left_semi"))


def canonical_ledgers(selected: DataFrame, ledgers: DataFrame) -> DataFrame:
    """selected(name) with ledger, the spelling that the ledger table has, or error; later ledgers of one name win."""
    from passbook.functions.text import normalize_ledger_name

    raw = strip(filled("name"))
    known = ledgers.where((strip(filled("name")) != "") & ~is_numeric_reference(filled("name")))
    known = known.groupBy(normalize_ledger_name("name").alias("_key")).agg(F.max_by(F.trim("name"), "pos").alias("ledger"))
    out = selected.withColumn("_key", normalize_ledger_name(raw)).join(known, "_key", "left")
    wrong = (
        F.when(raw.isin("", "Legacy rule needs ledger reassignment"), F.lit("Select a Tally ledger name."))
        .when(is_numeric_reference(raw), F.lit("A numeric ledger index is invalid. Select the actual Tally ledger name."))
        .when(F.col("ledger").isNull(), F.lit("The ledger is not present in the selected Tally company."))
    )
    return out.select(*selected.columns, F.when(wrong.isNull(), F.col("ledger")).alias("ledger"), wrong.alias("error"))


#: Rows up to a page's end that one task may gather; pages further on are read from ranges.
NEAR_ROWS = 10_000


def sorted_pages(transactions: DataFrame, by: str) -> Ranged:
    """All rows in ascending order of a column, nulls last, ties in statement order, sorted once; its pages read only the ranges that hold them."""
    return ranged(transactions, F.col(by).asc_nulls_last(), F.col("session_id"), *map(F.col, _SEQ))


def sorted_page(transactions: DataFrame, by: str, page: int, size: int = 100) -> DataFrame:
    """Page (from 0) of all rows in that order. For many pages take sorted_pages, which sorts once."""
    if (page + 1) * size <= NEAR_ROWS:
        return transactions.orderBy(F.col(by).asc_nulls_last(), "session_id", *_SEQ).offset(page * size).limit(size)
    return sorted_pages(transactions, by).page(page, size)


def page_count(transactions: DataFrame, size: int = 100) -> DataFrame:
    return transactions.groupBy("session_id").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / size)).cast("long").alias("pages"))


def session_page(transactions: DataFrame, page: int, size: int = 100) -> DataFrame:
    """The same page of every session at once."""
    n = F.row_number().over(Window.partitionBy("session_id").orderBy(*_SEQ))
    return transactions.withColumn("_n", n).where(F.col("_n").between(page * size + 1, (page + 1) * size)).drop("_n")


def upsert(current: DataFrame, changes: DataFrame, keep: tuple[str, ...] = ("session_id", "created_at")) -> DataFrame:
    """current with the rows of changes by id: new ones are added, others replaced but for the columns in keep."""
    old, new = current.alias("o"), changes.alias("n")
    both = old.join(new, F.col("o.id") == F.col("n.id"), "full_outer")
    has = F.col("n.id").isNotNull()
    pick = lambda c: F.coalesce(f"o.{c}", f"n.{c}") if c in keep or c == "id" else F.when(has, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return both.select(*(pick(c).alias(c) for c in current.columns))
