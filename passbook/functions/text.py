"""Text functions on columns: trimming, header and ledger normal forms, redaction, file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from passbook.functions.vocabulary import NOISE_PATTERNS, STOP_WORDS

# fixed values: the code points that Unicode calls white space
_WHITE = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(c: Column | str) -> Column:
    """Without white space at either end, Unicode blanks and tabs included."""
    return F.btrim(_col(c), F.lit(_WHITE))


def collapse(c: Column | str) -> Column:
    """With each run of white space as one blank, and none at the ends."""
    return F.trim(F.regexp_replace(_col(c), r"(?U)\s+", " "))


def filled(c: Column | str) -> Column:
    """'' for null."""
    return F.coalesce(_col(c), F.lit(""))


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _plain(c: Column | str, keep: str) -> Column:
    return F.trim(F.regexp_replace(F.lower(_col(c)), f"[^a-z0-9{keep}]+", " "))


def normalize_header(c: Column | str) -> Column:
    """Lower-case letters, digits and slashes; anything else is one blank."""
    return _plain(c, "/")


def normalize_table_header(c: Column | str) -> Column:
    """Lower-case letters and digits; anything else is one blank."""
    return _plain(c, "")


def duplicate_text(c: Column | str) -> Column:
    """The form in which references and descriptions are compared for duplicates."""
    return _plain(c, "")


def basic_normalize(c: Column | str) -> Column:
    """Lower-case letters, digits and ampersands; anything else is one blank."""
    return _plain(c, "&")


def plain_base(c: Column | str) -> Column:
    """What the forms above have in common, before their ends are trimmed; where several are wanted, plain_form makes each of it at little cost."""
    return F.regexp_replace(F.lower(_col(c)), "[^a-z0-9/&]+", " ")


def plain_form(base: Column | str, keep: str) -> Column:
    """Of plain_base the form that keeps '/', '&' or none of them: normalize_header, basic_normalize, normalize_table_header."""
    base, drop = _col(base), "".join(c for c in "/&" if c not in keep)
    return F.trim(F.when(base.rlike(f"[{drop}]"), F.regexp_replace(base, f" *[{drop}][ {drop}]*", " ")).otherwise(base))


def normalize(c: Column | str) -> Column:
    """A description without transfer words, addresses, reference codes, dates and long numbers."""
    out = F.lower(_col(c))
    for pattern in NOISE_PATTERNS:
        out = F.regexp_replace(out, pattern, " ")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def meaningful_tokens(c: Column | str) -> Column:
    """Of a basic-normalised name: words of three characters or more that are no stop words."""
    return F.filter(F.split(_col(c), " "), lambda t: (F.length(t) >= 3) & ~t.isin(*STOP_WORDS))


def normalize_ledger_name(c: Column | str) -> Column:
    return F.lower(collapse(c))


def is_numeric_reference(c: Column | str) -> Column:
    """Whether a ledger name is but a number, as a leaked index is."""
    return strip(c).rlike(r"^\p{Nd}+$")


def mask_account_numbers(c: Column | str) -> Column:
    """Runs of 8 to 18 digits with bullets for all but the last four."""
    out = _col(c)
    for n in range(8, 19):
        out = F.regexp_replace(out, f"(?<![0-9])[0-9]{{{n - 4}}}([0-9]{{4}})(?![0-9])", "•" * (n - 4) + "$1")
    return out


def redact(c: Column | str) -> Column:
    """Account numbers masked, and addresses with @ cut to two characters of their name."""
    return F.regexp_replace(mask_account_numbers(c), r"(?i)\b([a-z0-9._-]{2})[a-z0-9._-]*@([a-z][a-z0-9.-]+)\b", "$1***@$2")


def strip_control(c: Column | str) -> Column:
    """Without characters that XML forbids."""
    return F.regexp_replace(_col(c), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def has_control(c: Column | str) -> Column:
    return _col(c).rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]")


def safe_filename(c: Column | str) -> Column:
    """Letters, digits, dots, lines and hyphens, with none of ._ at the ends."""
    return F.btrim(F.regexp_replace(strip(c), r"[^\w.-]+", "_"), F.lit("._"))


def to_messages(c: Column | str) -> Column:
    """A list of messages as JSON text."""
    return F.to_json(_col(c))


def from_messages(c: Column | str) -> Column:
    return F.from_json(_col(c), "array<string>")
