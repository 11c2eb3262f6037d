"""Amounts, dates and other values from statement text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from passbook.functions.text import filled, strip
from passbook.functions.vocabulary import EMPTY_AMOUNTS

MONEY = "decimal(28,2)"


def zero() -> Column:
    return F.lit("0.00").cast(MONEY)


def parse_decimal(c: Column | str) -> Column:
    """struct(value decimal(28,2), error boolean) of an amount as banks print it.

    Null and empty markers are 0.00; brackets at both ends make it negative; text with nan or inf
    in it, or of whose digits, points and signs no number can be made, is an error. Halves round to even.
    """
    raw = strip(filled(c))
    low = F.lower(raw)
    cleaned = F.regexp_replace(raw, r"[^0-9.\-]", "")
    number = cleaned.try_cast("decimal(38,10)")
    rounded = F.bround(number, 2).cast(MONEY)
    signed = F.when(raw.startswith("(") & raw.endswith(")"), -F.abs(rounded)).otherwise(rounded)
    nothing = low.isin(*EMPTY_AMOUNTS)
    named = F.contains(low, F.lit("nan")) | F.contains(low, F.lit("inf"))
    blank = cleaned.isin("", "-", ".", "-.")
    value = F.when(nothing, zero()).when(named, F.lit(None).cast(MONEY)).when(blank, zero()).otherwise(signed)
    return F.struct(value.alias("value"), (~nothing & (named | (~blank & signed.isNull()))).alias("error"))


def format_decimal(c: Column | str) -> Column:
    """Two decimal places without grouping; '' for null."""
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast(MONEY).cast("string"), F.lit(""))


# fixed values: months' names
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]

_TIME = r"(?: (?:(?:[01]?\d|2[0-3]):[0-5]\d(?::[0-5]\d)?|(?:0?[1-9]|1[0-2]):[0-5]\d [AaPp][Mm]))?$"
_MONTH = r"(0?[1-9]|1[0-2])"
#: Shapes that are read where no format is given, and where their year, month and day stand: day first, then month first, then ISO and month names.
_SHAPES = [
    (r"^(\d{1,2})([-/.])" + _MONTH + r"\2(\d{4}|\d{2})" + _TIME, ("$4", "$3", "$1")),
    (r"^" + _MONTH + r"([-/.])(\d{1,2})\2(\d{4}|\d{2})" + _TIME, ("$4", "$1", "$3")),
    (r"^(\d{4})-(\d{1,2})-(\d{1,2})" + _TIME, ("$1", "$2", "$3")),
    (r"^(\d{1,2})([-/. ])([A-Za-z]{3,9})\2(\d{4}|\d{2})" + _TIME, ("$4", "$3", "$1")),
    (r"^([A-Za-z]{3,9}) (\d{1,2}), (\d{4})" + _TIME, ("$3", "$1", "$2")),
]

#: Codes of the other convention for date formats, which templates use.
STRPTIME = {"%d": "dd", "%m": "MM", "%Y": "yyyy", "%y": "yy", "%b": "MMM", "%B": "MMMM", "%H": "HH", "%M": "mm", "%S": "ss", "%I": "hh", "%p": "a"}


def java_format(code: str) -> str:
    """A format with % codes as Spark's datetime pattern; single digits are read too."""
    for a, b in STRPTIME.items():
        code = code.replace(a, b)
    return code.replace("dd", "d").replace("MM", "M").replace("MMM", "MMM") if "MMM" not in code else code.replace("dd", "d")


#: The year around which two-digit years lie where no format is given; fixed, so that a rerun reads the same.
REFERENCE_YEAR = 2026


def parse_date(c: Column | str, date_format: str = "AUTO", reference_year: int = REFERENCE_YEAR) -> Column:
    """The date of a text by one format, or by its shape: day first, else month first, ISO, or with a month's name.

    A year of two digits is the one from 50 years before the reference year to 49 after it; by a format's %y it is
    1969 to 2068. A time of day may follow. Null if nothing fits, there is no such day, or the text is empty.
    """
    raw = strip(filled(c))
    if date_format and date_format != "AUTO":
        found = F.try_to_timestamp(raw, F.lit(java_format(date_format))).cast("date")
        # Spark reads two digits as 2000 to 2099
        return F.when(F.year(found) > 2068, F.add_months(found, -1200)).otherwise(found) if "%y" in date_format else found
    oldest = reference_year - 50
    names = {n: i + 1 for i, full in enumerate(MONTHS) for n in (full, full[:3])} | {"sept": 9}
    number = F.create_map(*(F.lit(x) for n, i in names.items() for x in (n, str(i))))

    def ordered(t: Column) -> Column:
        """Year, month and day with lines between them; null if no shape fits."""
        out = None
        for pattern, order in _SHAPES:
            out = (F if out is None else out).when(t.rlike(pattern), F.regexp_replace(t, pattern, "-".join(order)))
        return out

    def day(ymd: Column) -> Column:
        year, month = F.get(ymd, F.lit(0)), F.lower(F.get(ymd, F.lit(1)))
        year = F.when(F.length(year) == 2, (oldest + F.pmod(year.try_cast("int") - oldest, F.lit(100))).cast("string")).otherwise(year)
        month = F.when(month.rlike("^[a-z]"), F.try_element_at(number, month)).otherwise(month)
        return F.concat(year, F.lit("-"), month, F.lit("-"), F.get(ymd, F.lit(2))).try_cast("date")

    # a transform over an array of one gives what is used several times a name
    return F.get(F.transform(F.transform(F.array(raw), lambda t: F.split(ordered(t), "-")), day), F.lit(0))


def normalize_amounts(debit: Column, credit: Column, amount: Column, direction: Column) -> Column:
    """struct(debit, credit, error string) of split or single amount cells.

    Split cells win; else a direction cell (or a trailing DR or CR), or the sign, says which side
    an amount is on, and debit is asked first.
    """
    return normalize_parsed(F.array(parse_decimal(debit), parse_decimal(credit), parse_decimal(amount)), debit, credit, amount, direction)


def normalize_parsed(parsed: Column, debit: Column, credit: Column, amount: Column, direction: Column) -> Column:
    """normalize_amounts where debit, credit and amount are parsed already, as the first three of an array."""
    d, c, a = (F.get(parsed, F.lit(i)) for i in range(3))
    dv, cv, av = d["value"], c["value"], a["value"]
    split = (dv != 0) | (cv != 0)
    has = strip(filled(amount)) != ""
    marked = F.regexp_replace(F.upper(filled(amount)), r"\.", "")
    tail = F.regexp_extract(marked, r"(DR|CR)\s*$", 1)
    way = F.trim(F.regexp_replace(F.upper(F.when(filled(direction) != "", direction).otherwise(tail)), r"\.", ""))
    sign = F.regexp_extract(filled(amount), r"^\s*(?:[^0-9+\-]*\s*)?([+\-])", 1)
    to_debit = way.startswith("D") | (av < 0) | (sign == "-")
    to_credit = way.startswith("C") | (sign == "+")
    single = ~split & has
    out_d = F.when(split, F.abs(dv)).when(single & to_debit, F.abs(av)).otherwise(zero())
    out_c = F.when(split, F.abs(cv)).when(single & ~to_debit & to_credit, F.abs(av)).otherwise(zero())
    bad = lambda x, raw: F.when(x["error"], F.concat(F.lit("Invalid amount: "), strip(raw)))
    error = F.coalesce(
        bad(d, debit),
        bad(c, credit),
        F.when(single, bad(a, amount)),
        F.when(single & ~to_debit & ~to_credit, F.lit("amount direction is neither DR nor CR")),
        F.when((out_d != 0) & (out_c != 0), F.lit("both debit and credit have values")),
        F.when((out_d == 0) & (out_c == 0), F.lit("transaction has no amount")),
    )
    return F.struct(out_d.cast(MONEY).alias("debit"), out_c.cast(MONEY).alias("credit"), error.alias("error"))


def looks_like_date(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).rlike(r"^(?:\d{1,2}[-/.][A-Za-z]{3}[-/.]\d{2,4}|\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4})$")


def channel(description: Column, cheque: Column) -> Column:
    """Of an exported voucher: Cheque with a cheque number, else the first transfer word, else Others."""
    up = F.upper(filled(description))
    out = F.when(filled(cheque) != "", F.lit("Cheque"))
    for name in ("UPI", "NEFT", "IMPS", "RTGS"):
        out = out.when(F.contains(up, F.lit(name)), F.lit(name))
    return out.otherwise("Others")


def shown_channel(description: Column) -> Column:
    """The first transfer word in a description, in title case, else Other."""
    up = F.upper(filled(description))
    names = ["UPI", "NEFT", "IMPS", "RTGS", "CHEQUE", "CASH"]
    return F.coalesce(*(F.when(F.contains(up, F.lit(n)), F.lit(n.title())) for n in names), F.lit("Other"))


def voucher_number(existing: Column, day: Column, row: Column, id_: Column) -> Column:
    """The number a voucher has, else BST, its day and its row (or the start of its id for row 0)."""
    padded = F.when(F.length(row.cast("string")) >= 5, row.cast("string")).otherwise(F.lpad(row.cast("string"), 5, "0"))
    suffix = F.when(F.coalesce(row, F.lit(0)) != 0, padded).otherwise(F.upper(F.element_at(F.split(id_, "-"), 1)))
    made = F.concat(F.lit("BST-"), F.date_format(day, "yyyyMMdd"), F.lit("-"), suffix)
    return F.when(strip(filled(existing)) != "", strip(existing)).otherwise(made)


def signed_amounts(debit: Column, credit: Column) -> Column:
    """struct(bank, opposite): a withdrawal is positive on the bank's side, a deposit negative."""
    bank = F.when(debit != 0, F.abs(debit)).when(credit != 0, -F.abs(credit)).otherwise(zero()).cast(MONEY)
    return F.struct(bank.alias("bank"), (-bank).cast(MONEY).alias("opposite"))


def is_bank_or_cash(parent: Column) -> Column:
    return F.regexp_replace(F.lower(filled(parent)), "[^a-z0-9]+", "").rlike("bankaccounts|bankod|cashinhand")


def voucher_type(description: Column, debit: Column, opposite_own: Column, bank_own: Column) -> Column:
    """Payment, Receipt or Contra; opposite_own and bank_own: whether the ledgers are bank or cash (null: unknown)."""
    from passbook.functions.vocabulary import BANK_CHARGE_TERMS, INTEREST_CHARGED_TERMS, INTEREST_RECEIVED_TERMS

    low = F.lower(filled(description))
    any_of = lambda terms: low.rlike("|".join(terms))
    return (
        F.when(any_of(BANK_CHARGE_TERMS), F.lit("Payment"))
        .when(any_of(INTEREST_RECEIVED_TERMS), F.lit("Receipt"))
        .when(any_of(INTEREST_CHARGED_TERMS), F.lit("Payment"))
        .when(F.coalesce(opposite_own, F.lit(False)) & F.coalesce(bank_own, F.lit(True)), F.lit("Contra"))
        .when(debit != 0, F.lit("Payment"))
        .otherwise("Receipt")
    )
