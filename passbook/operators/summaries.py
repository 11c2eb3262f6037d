"""Sums and counts of statements, matches, issues and imports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passbook.functions.text import filled, strip
from passbook.functions.values import MONEY
from passbook.operators.order import ranged
from passbook.sources.steps import small


def _order() -> Column:
    return F.struct("row_number", "id")


def _active() -> Column:
    return ~F.col("ignored")


def _total(c: str, when: Column | None = None) -> Column:
    value = F.col(c) if when is None else F.when(when, F.col(c))
    return F.coalesce(F.sum(value), F.lit(0)).cast(MONEY)


def _count(when: Column) -> Column:
    return F.count_if(F.coalesce(when, F.lit(False)))


def unmatched() -> Column:
    ledger = strip(filled("opposite_ledger"))
    return (ledger == "") | (F.col("matching_confidence") == 0) | F.contains(F.lower(ledger), F.lit("suspense"))


def validation_summary(transactions: DataFrame) -> DataFrame:
    status = F.col("validation_status")
    return transactions.groupBy("session_id").agg(_count(status == "Valid").alias("valid"), _count(status == "Warning").alias("warnings"), _count(status == "Invalid").alias("invalid"))


def reconcile(transactions: DataFrame, openings: DataFrame | None = None) -> DataFrame:
    """Per session the totals of active rows, and with openings(session_id, opening_balance, closing_balance) the difference.

    Without a closing balance the last balance that a row has is the statement's.
    """
    last = F.max_by("balance", F.when(F.col("balance").isNotNull(), _order()))
    sums = transactions.where(_active()).groupBy("session_id").agg(_total("debit_amount").alias("total_debit"), _total("credit_amount").alias("total_credit"), last.alias("_last"))
    if openings is None:
        none = F.lit(None).cast(MONEY)
        sums = sums.withColumns({"opening_balance": none, "closing_balance": none})
    else:
        sums = openings.select("session_id", "opening_balance", "closing_balance").join(sums, "session_id", "left").fillna(0, ["total_debit", "total_credit"])
    expected = (F.col("opening_balance") + F.col("total_credit") - F.col("total_debit")).cast(MONEY)
    closing = F.coalesce("closing_balance", "_last").cast(MONEY)
    return sums.select("session_id", "opening_balance", "total_debit", "total_credit", expected.alias("expected_closing_balance"), closing.alias("statement_closing_balance"), (closing - expected).cast(MONEY).alias("difference"))


def statement_summary(transactions: DataFrame) -> DataFrame:
    """Per session: counts, totals, opening (from the first active row) and closing balance, and what needs attention."""
    first = F.min_by(F.struct("balance", "debit_amount", "credit_amount"), _order())
    errors = F.col("validation_status") == "Invalid"
    sums = transactions.where(_active()).groupBy("session_id").agg(
        F.count("*").alias("transactions"),
        _total("debit_amount").alias("debit"),
        _total("credit_amount").alias("credit"),
        first.alias("_first"),
        F.max_by("balance", F.when(F.col("balance").isNotNull(), _order())).alias("closing"),
        _count(unmatched()).alias("unmatched"),
        _count(errors).alias("errors"),
        _count(F.col("duplicate_status").isin("Suspected", "Confirmed duplicate")).alias("duplicates"),
    )
    opening = (F.col("_first.balance") + F.col("_first.debit_amount") - F.col("_first.credit_amount")).cast(MONEY)
    return sums.select("session_id", "transactions", "debit", "credit", opening.alias("opening"), "closing", "unmatched", "errors", "duplicates", (F.col("transactions") - F.col("errors")).alias("valid"))


def match_counts(matched: DataFrame) -> DataFrame:
    method = F.col("matching_method")
    suspense = method == "Default suspense"
    return matched.where(_active()).groupBy("session_id").agg(_count(~suspense).alias("matched"), _count(suspense).alias("suspense"), _count(filled("matching_rule_id") != "").alias("rules"))


def rule_uses(matched: DataFrame) -> DataFrame:
    """(matching_rule_id, uses) of the rules that matched rows of this run."""
    return matched.where(_active() & (filled("matching_rule_id") != "")).groupBy("matching_rule_id").agg(F.count("*").alias("uses"))


def with_uses(rules: DataFrame, uses: DataFrame) -> DataFrame:
    """rules with their use counts raised."""
    more = uses.select(F.col("matching_rule_id").alias("id"), "uses")
    return rules.join(more, "id", "left").withColumn("use_count", F.col("use_count") + F.coalesce("uses", F.lit(0))).drop("uses").select(*rules.columns)


def issue_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("severity").agg(F.count("*").alias("issues"))


def import_totals(responses: DataFrame) -> DataFrame:
    """Per batch: what was created, altered, left out and failed, and the messages in their order.

    The messages are one array a batch; import_messages gives those of batches of any size as rows.
    """
    said = F.array_sort(F.collect_list(F.when(filled("message") != "", F.struct("position", "message"))))
    return responses.groupBy("batch_id").agg(
        F.count("*").alias("total_vouchers"),
        F.sum("created").alias("created"),
        F.sum("altered").alias("altered"),
        F.sum(F.col("ignored") + F.col("cancelled")).alias("ignored"),
        F.sum(F.col("errors") + F.col("exceptions")).alias("errors"),
        _count(F.col("import_status") == "Failed").alias("failed"),
        F.transform(said, lambda m: m["message"]).alias("messages"),
    )


def import_messages(responses: DataFrame) -> DataFrame:
    """(batch_id, n, message): the messages of each batch in their order, numbered from 1; a row each, so a batch may have any number."""
    said = responses.where(filled("message") != "").select("batch_id", "position", "message")
    placed = ranged(said, F.col("batch_id"), F.col("position"), F.col("message")).numbered("n")
    first = placed.groupBy("batch_id").agg((F.min("n") - 1).alias("_before"))
    return placed.join(small(first), "batch_id").select("batch_id", (F.col("n") - F.col("_before")).alias("n"), "message")


def export_summary(transactions: DataFrame) -> DataFrame:
    """Per session: active rows and their totals, and the ignored rows."""
    return transactions.groupBy("session_id").agg(
        _count(_active()).alias("transactions"), _total("debit_amount", _active()).alias("total_debit"), _total("credit_amount", _active()).alias("total_credit"), _count(F.col("ignored")).alias("ignored")
    )


def unmatched_count(transactions: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    rows = transactions.where(_active())
    rows = rows.join(ids.select("id").distinct(), "id", "left_semi") if ids is not None else rows
    return rows.groupBy("session_id").agg(_count(unmatched()).alias("unmatched"))


def first_by_name(rows: DataFrame, name: str, pos: str) -> DataFrame:
    """One row for each name, whatever its case: the first by pos, as min_by keeps it."""
    kept = F.min_by(F.struct(*rows.columns), F.col(pos))
    return rows.groupBy(F.lower(name).alias("_key")).agg(kept.alias("_row")).select("_row.*")
