"""Aliases, terms and patterns that results depend on."""

# fixed values: header aliases of each field, in the order in which fields are tried
COLUMN_ALIASES = {
    "transaction_date": ["date", "transaction date", "txn date", "tran date", "posting date"],
    "value_date": ["value date", "val date"],
    "description": ["description", "narration", "particulars", "transaction details", "remarks"],
    "reference_number": ["reference", "reference number", "ref no", "transaction id", "utr number", "utr"],
    "cheque_number": ["cheque number", "cheque no", "chq no", "instrument no"],
    "debit": ["debit", "withdrawal", "withdrawals", "debit amount", "withdrawal amount", "dr"],
    "credit": ["credit", "deposit", "deposits", "credit amount", "deposit amount", "cr"],
    "amount": ["amount", "transaction amount", "txn amount"],
    "dr_cr": ["dr cr", "dr/cr", "type", "transaction type"],
    "balance": ["balance", "closing balance", "available balance", "running balance"],
}
FIELDS = list(COLUMN_ALIASES)

# fixed values: descriptions that are no transactions
IGNORE_TERMS = ["opening balance", "closing balance", "brought forward", "carried forward", "total", "page total", "statement summary"]

# fixed values: amounts that mean nothing
EMPTY_AMOUNTS = ["", "-", "--", "na", "n/a", "nil", "none"]

# fixed values: what is no part of a payee's name, in the order in which it is removed
NOISE_PATTERNS = [
    r"\b(?:upi|neft|imps|rtgs|ach|ecs|pos|atm|txn|trf|transfer)\b",
    r"\b[a-z0-9._%+-]+@[a-z0-9.-]+\b",
    r"\b(?:utr|rrn|ref|chq|cheque)\s*[:#-]?\s*[a-z0-9-]+\b",
    r"\b\d{1,2}[-/]\d{1,2}[-/]\d{2,4}\b",
    r"\b\d{7,}\b",
    r"[^a-z0-9& ]+",
]
STOP_WORDS = ["account", "limited", "ltd", "private", "pvt", "payment", "receipt", "bank"]

# fixed values: descriptions that decide a voucher's type
BANK_CHARGE_TERMS = ["bank charge", "service charge", "sms charge", "annual fee", "commission"]
INTEREST_RECEIVED_TERMS = ["interest credit", "interest received", "int paid", "credit interest"]
INTEREST_CHARGED_TERMS = ["interest charged", "debit interest", "loan interest", "od interest"]

VOUCHER_TYPES = ["Unassigned", "Payment", "Receipt", "Contra"]
SUSPENSE = "Suspense A/c"
