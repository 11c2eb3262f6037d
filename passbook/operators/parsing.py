"""From raw statement rows to typed transactions: mapping discovery, row filters, continuation lines, parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from passbook.functions.text import collapse, filled, normalize_header, strip
from passbook.functions.values import MONEY, normalize_parsed, parse_date, parse_decimal
from passbook.functions.vocabulary import COLUMN_ALIASES, FIELDS, IGNORE_TERMS
from passbook.sources.steps import partitions

#: Rows of a document among which its header is sought.
HEADER_ROWS = 30
_ALIAS_ARRAY = "array<struct<field:int,name:string,alias:string>>"


def first_rows(rows: DataFrame, n: int = HEADER_ROWS) -> DataFrame:
    return rows.where(F.col("row_number") <= n)


def built_in_aliases() -> Column:
    return F.array(*(F.struct(F.lit(i).alias("field"), F.lit(f).alias("name"), F.lit(a).alias("alias")) for i, f in enumerate(FIELDS) for a in COLUMN_ALIASES[f])).cast(_ALIAS_ARRAY)


def template_aliases(aliases: Column) -> Column:
    """A template's map of field to aliases in the form of built_in_aliases; unknown fields are left out."""

    def entry(i: int, f: str):
        return lambda a: F.struct(F.lit(i).alias("field"), F.lit(f).alias("name"), normalize_header(a).alias("alias"))

    parts = [F.transform(F.coalesce(F.try_element_at(aliases, F.lit(f)), F.array().cast("array<string>")), entry(i, f)) for i, f in enumerate(FIELDS)]
    return F.concat(*parts).cast(_ALIAS_ARRAY)


def _claims(cells: Column, aliases: Column) -> Column:
    """For each field the index of the cell that claims it, or -1; cells claim from left to right, one field each."""

    def wanted(cell: Column, i: Column) -> Column:
        norm = normalize_header(filled(cell))
        exact = F.array_sort(F.transform(F.filter(aliases, lambda a: a["alias"] == norm), lambda a: a["field"]))
        inside = F.filter(aliases, lambda a: (F.length(a["alias"]) > 3) & F.contains(norm, a["alias"]))
        partial = F.sort_array(F.transform(inside, lambda a: F.struct(F.length(a["alias"]).alias("n"), a["name"].alias("name"), a["field"].alias("field"))), asc=False)
        return F.struct(i.alias("i"), exact.alias("exact"), partial.alias("partial"))

    def claim(state: Column, x: Column) -> Column:
        free = lambda f: F.get(state, f) < 0
        one = F.coalesce(F.get(F.filter(x["exact"], free), F.lit(0)), F.get(F.filter(x["partial"], lambda p: free(p["field"])), F.lit(0))["field"])
        return F.when(one.isNull(), state).otherwise(F.transform(state, lambda v, k: F.when(k == one, x["i"]).otherwise(v)))

    return F.aggregate(F.transform(cells, wanted), F.array_repeat(F.lit(-1), len(FIELDS)), claim)


def suggest_mapping(rows: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """rows(doc_id, row_number from 1, cells): one mapping a document, from the header row that scores best (the first of equals).

    Fields are cell indexes from 0, or null; header_row counts from 0; score is what the row reached.
    templates(doc_id, column_aliases map, mapping struct of the fields with header_row and
    date_format): its aliases count too, and its indexes, where the document is wide enough, win.
    """
    head = first_rows(rows)
    if templates is not None:
        head = head.join(templates.select("doc_id", template_aliases(F.col("column_aliases")).alias("_extra")), "doc_id", "left")
        aliases = F.concat(built_in_aliases(), F.coalesce("_extra", F.array().cast(_ALIAS_ARRAY)))
    else:
        aliases = built_in_aliases()
    at = {f: i for i, f in enumerate(FIELDS)}
    has = lambda f: F.get("_c", F.lit(at[f])) >= 0
    scored = head.withColumn("_c", _claims(F.col("cells"), aliases))
    score = F.size(F.filter("_c", lambda v: v >= 0)) + F.when(has("transaction_date"), 2).otherwise(0) + F.when(has("debit") | has("credit") | has("amount"), 2).otherwise(0)
    scored = scored.select("doc_id", "row_number", "_c", score.alias("score"))
    best = scored.groupBy("doc_id").agg(F.max_by(F.struct("_c", "row_number", "score"), F.struct("score", -F.col("row_number"))).alias("b"))
    fields = {f: F.get("b._c", F.lit(i)) for f, i in at.items()}
    out = best.select("doc_id", *(F.when(v >= 0, v).cast("int").alias(f) for f, v in fields.items()), (F.col("b.row_number") - 1).cast("int").alias("header_row"), F.lit("AUTO").alias("date_format"), F.col("b.score").alias("score"))
    if templates is None:
        return out
    size = rows.groupBy("doc_id").agg(F.max(F.size("cells")).alias("_wide"), F.max("row_number").alias("_long"))
    out = out.join(size, "doc_id").join(templates.select("doc_id", F.col("mapping").alias("_m")), "doc_id", "left")
    fits = lambda f: F.when(F.col(f"_m.{f}") < F.col("_wide"), F.col(f"_m.{f}"))
    any_saved = F.coalesce(*(fits(f) for f in FIELDS)).isNotNull()
    saved_row = F.when(any_saved & (F.col("_m.header_row") >= 0) & (F.col("_m.header_row") < F.col("_long")), F.col("_m.header_row"))
    saved_format = F.when(F.col("_m.date_format") != "AUTO", F.col("_m.date_format"))
    return out.select("doc_id", *(F.coalesce(fits(f), f).cast("int").alias(f) for f in FIELDS), F.coalesce(saved_row, "header_row").cast("int").alias("header_row"), F.coalesce(saved_format, "date_format").alias("date_format"), "score")


def cell(cells: Column, index: Column) -> Column:
    """The stripped cell at an index; '' where there is none."""
    return strip(filled(F.get(cells, index)))


def cleanup(text: Column, rules: Column | None = None) -> Column:
    """White space collapsed, then each rule's pattern replaced in order, stripped after each; rules: array of (pattern, replacement)."""
    out = collapse(text)
    if rules is None:
        return out
    used = F.filter(F.coalesce(rules, F.array().cast("array<struct<pattern:string,replacement:string>>")), lambda r: filled(r["pattern"]) != "")
    return F.aggregate(used, out, lambda acc, r: strip(F.regexp_replace(acc, r["pattern"], F.regexp_replace(filled(r["replacement"]), r"\\(\d)", r"\$$1"))))


def is_header_like(cells: Column) -> Column:
    """Whether two cells or more are built-in aliases."""
    known = sorted({a for v in COLUMN_ALIASES.values() for a in v})
    # most cells hold no letter, and need no normal form
    return F.size(F.filter(cells, lambda c: F.when(filled(c).rlike("[A-Za-z]"), normalize_header(filled(c)).isin(*known)).otherwise(False))) >= 2


def data_rows(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rows below their document's header that are neither blank, nor repeated headers, nor opening, closing and total lines.

    The columns of mapping (one row a document) are added. ignore_phrases array<string> in it adds terms.
    """
    # rows are dealt by document before the costly expressions; windows and groups above keep that
    joined = rows.repartition(partitions(rows.sparkSession), "doc_id").join(mapping, "doc_id")
    some = F.exists("cells", lambda c: strip(filled(c)) != "")
    described = collapse(F.lower(cell(F.col("cells"), F.col("description"))))
    terms = F.array(*map(F.lit, IGNORE_TERMS))
    if "ignore_phrases" in mapping.columns:
        terms = F.concat(terms, F.transform(F.coalesce("ignore_phrases", F.array().cast("array<string>")), lambda t: strip(F.lower(t))))
    met = F.exists(terms, lambda t: (described == t) | described.startswith(F.concat(t, F.lit(" "))))
    # columns inside a lambda alone don't keep a condition above the join, so both sides' stand before it too
    ignored = F.when(F.size("cells") + F.coalesce("description", F.lit(0)) >= 0, met).otherwise(False)
    return joined.where((F.col("row_number") > F.col("header_row") + 1) & some & ~is_header_like(F.col("cells")) & ~ignored)


def _dates(text: str, at: int, formats: list[str]) -> Column:
    """A text's date by its row's format; the automatic one is already in days."""
    auto, out = F.get("days", F.lit(at)), None
    for f in formats:
        out = (F if out is None else out).when(F.col("date_format") == f, parse_date(text, f))
    return out.otherwise(auto) if formats else auto


def parse(rows: DataFrame, mapping: DataFrame, formats: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(transactions, warnings) of rows(doc_id, row_number, cells) under mapping, one row a document as suggest_mapping gives it.

    A row without date and amounts continues the last accepted row before it. Warnings
    (doc_id, row_number, message) tell what is wrong with each other row that can't be read.
    formats: the explicit date formats that occur in mapping. Optional columns of mapping:
    ignore_phrases, cleanup_rules, multiline boolean, joiner string.
    """
    have = set(mapping.columns)
    rules = F.col("cleanup_rules") if "cleanup_rules" in have else None
    multiline = F.coalesce("multiline", F.lit(True)) if "multiline" in have else F.lit(True)
    joiner = F.coalesce("joiner", F.lit(" ")) if "joiner" in have else F.lit(" ")
    of = lambda f: cell(F.col("cells"), F.col(f))
    base = data_rows(rows, mapping).select(
        "doc_id", "row_number", "date_format", multiline.alias("multiline"), joiner.alias("joiner"), cleanup(of("description"), rules).alias("clean"), of("description").alias("raw_description"),
        of("transaction_date").alias("date_text"), of("value_date").alias("value_text"), of("debit").alias("debit_text"), of("credit").alias("credit_text"), of("amount").alias("amount_text"),
        of("dr_cr").alias("direction_text"), of("balance").alias("balance_text"), of("reference_number").alias("reference"), of("cheque_number").alias("cheque_number"),
    )
    formats = [f for f in formats or [] if f != "AUTO"]
    continues = F.col("multiline") & (F.col("date_text") == "") & (F.col("raw_description") != "") & (F.concat("debit_text", "credit_text", "amount_text") == "")
    texts = [F.col(c) for c in ("debit_text", "credit_text", "amount_text", "balance_text")]
    # amounts and dates are parsed once for all cells: an expression for each would outgrow what Spark compiles
    base = base.withColumns({"parsed": F.transform(F.array(*texts), parse_decimal), "days": F.transform(F.array("date_text", "value_text"), lambda t: parse_date(t))})
    typed = base.withColumns(
        {
            "continues": continues,
            "day": _dates("date_text", 0, formats),
            "sums": normalize_parsed(F.col("parsed"), *texts[:3], F.col("direction_text")),
            "left": F.get("parsed", F.lit(3)),
            "value_day": _dates("value_text", 1, formats),
        }
    )
    quoted = lambda c: F.concat(F.lit("'"), c, F.lit("'"))
    explicit = F.col("date_format") != "AUTO"
    mismatch = lambda c: F.concat(F.lit("date "), quoted(F.col(c)), F.lit(" does not match "), F.col("date_format"))
    error = F.coalesce(
        F.when(F.col("day").isNull(), F.when(explicit & (F.col("date_text") != ""), mismatch("date_text")).otherwise(F.concat(F.lit("invalid transaction date "), quoted(F.col("date_text"))))),
        F.col("sums.error"),
        F.when((F.col("balance_text") != "") & F.col("left.error"), F.concat(F.lit("Invalid amount: "), "balance_text")),
        F.when(explicit & (F.col("value_text") != "") & F.col("value_day").isNull(), mismatch("value_text")),
    )
    typed = typed.withColumn("error", error)
    before = Window.partitionBy("doc_id").orderBy("row_number").rowsBetween(Window.unboundedPreceding, -1)
    accepted = F.col("error").isNull() & ~F.col("continues")
    anchored = typed.withColumn("anchor", F.last(F.when(accepted, F.col("row_number")), ignorenulls=True).over(before))
    joins = F.col("continues") & F.col("anchor").isNotNull()
    anchored = anchored.withColumn("joins", joins).withColumn("anchor", F.when(joins, F.col("anchor")).otherwise(F.col("row_number")))
    warnings = anchored.where("not joins and error is not null").select("doc_id", "row_number", F.concat(F.lit("Row "), "row_number", F.lit(": "), "error").alias("message"))

    own = ["row_number", "day", "value_day", "value_text", "clean", "reference", "cheque_number", "sums", "left", "balance_text", "joiner"]
    good = anchored.where("joins or error is null")
    merged = good.groupBy("doc_id", "anchor").agg(
        F.max_by(F.struct(*own), F.when(~F.col("joins"), F.col("row_number"))).alias("t"),
        F.array_sort(F.collect_list(F.when(F.col("joins"), F.struct("row_number", "clean", "reference")))).alias("more"),
    )
    start = F.when(F.col("t.clean") == "", F.lit("(No description)")).otherwise(F.col("t.clean"))
    described = F.aggregate(F.filter("more", lambda m: m["clean"] != ""), start, lambda acc, m: strip(F.concat(acc, F.col("t.joiner"), m["clean"])))
    grown = F.exists("more", lambda m: m["clean"] != "")
    referred = F.aggregate(F.filter("more", lambda m: m["reference"] != ""), F.col("t.reference"), lambda acc, m: F.when(F.contains(acc, m["reference"]), acc).otherwise(strip(F.concat(acc, F.lit(" "), m["reference"]))))
    transactions = merged.select(
        F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), F.col("t.row_number").cast("string")), 256).alias("id"),
        "doc_id",
        F.col("t.row_number").alias("row_number"),
        F.col("t.day").alias("transaction_date"),
        F.when(F.col("t.value_text") != "", F.col("t.value_day")).alias("value_date"),
        described.alias("description"),
        referred.alias("reference_number"),
        F.col("t.cheque_number").alias("cheque_number"),
        F.col("t.sums.debit").alias("debit_amount"),
        F.col("t.sums.credit").alias("credit_amount"),
        F.when(F.col("t.balance_text") != "", F.col("t.left.value")).cast(MONEY).alias("balance"),
        F.when(F.col("t.sums.debit") != 0, "Payment").otherwise("Receipt").alias("voucher_type"),
        F.when(grown, described).otherwise(F.col("t.clean")).alias("narration"),
    )
    return transactions, warnings


def attach_session(transactions: DataFrame, session: Column) -> DataFrame:
    """transactions of a parse as rows of a session, with the defaults of every other column."""
    none = F.lit("")
    return transactions.withColumns(
        {
            "session_id": session, "bank_ledger": none, "opposite_ledger": none, "tally_voucher_number": none, "matching_confidence": F.lit(0), "matching_method": none, "matching_rule_id": none,
            "import_status": F.lit("Not exported"), "import_message": none, "imported_at": F.lit(None).cast("timestamp_ntz"), "validation_status": F.lit("Valid"), "validation_message": none,
            "duplicate_status": F.lit("None"), "duplicate_of": none, "ignored": F.lit(False),
        }
    )
