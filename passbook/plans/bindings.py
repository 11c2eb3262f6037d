"""The driver's tables seen as statements, ledgers and payments, in SQL that Spark and the oracle both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passbook.operators.order import ranged

_MONEY = "DECIMAL(28,2)"

#: One transaction an event: a session is a user, and remainders of the event's number vary what can vary.
STMT = f"""
SELECT CAST(user_id AS STRING) AS session_id, event_id AS row_number, 'T' || CAST(event_id AS STRING) AS id,
    CASE WHEN event_id % 97 = 5 THEN NULL ELSE CAST(ts AS DATE) END AS transaction_date,
    CASE WHEN event_id % 3 = 0 THEN CAST(ts AS DATE) END AS value_date,
    CASE WHEN event_id % 101 = 7 THEN '' WHEN event_type = 'purchase' THEN 'UPI/SHOP ' || CAST(user_id % 40 AS STRING) || '/' || CAST(event_id AS STRING)
        WHEN event_type = 'error' THEN 'SMS charge ' || props WHEN event_type = 'signup' THEN 'NEFT credit ' || props
        WHEN event_type = 'view' THEN 'Interest received' ELSE 'Cheque deposit' END AS description,
    CASE WHEN event_id % 2 = 0 THEN 'REF-' || CAST(event_id % 500 AS STRING) ELSE '' END AS reference_number,
    CASE WHEN event_id % 11 = 0 THEN 'CHQ' || CAST(event_id AS STRING) ELSE '' END AS cheque_number,
    CASE WHEN event_type IN ('purchase', 'error') THEN CAST(value AS {_MONEY}) WHEN event_id % 89 = 1 THEN CAST(1 AS {_MONEY}) ELSE CAST(0 AS {_MONEY}) END AS debit_amount,
    CASE WHEN event_type IN ('purchase', 'error') OR event_id % 83 = 2 THEN CAST(0 AS {_MONEY}) ELSE CAST(value AS {_MONEY}) END AS credit_amount,
    CASE WHEN event_id % 4 <> 1 THEN CAST(event_id * 3 AS {_MONEY}) END AS balance,
    CASE WHEN event_id % 29 = 3 THEN 'Unassigned' WHEN event_id % 31 = 4 THEN 'Contra' WHEN event_type IN ('purchase', 'error') THEN 'Payment' ELSE 'Receipt' END AS voucher_type,
    CASE WHEN event_id % 23 = 2 THEN '' ELSE 'Demo Bank A/c' END AS bank_ledger,
    CASE event_id % 7 WHEN 0 THEN '' WHEN 1 THEN 'Suspense A/c' WHEN 2 THEN '169' WHEN 3 THEN 'demo bank a/c' ELSE 'Ledger ' || CAST(user_id % 9 AS STRING) END AS opposite_ledger,
    CASE WHEN event_id % 5 = 0 THEN 'note ' || props ELSE '' END AS narration,
    CASE WHEN event_id % 19 = 0 THEN 'V' || CAST(event_id AS STRING) ELSE '' END AS tally_voucher_number,
    CAST((event_id % 5) * 25 AS INT) AS matching_confidence,
    CASE WHEN event_id % 5 = 0 THEN 'Default suspense' ELSE 'Keyword' END AS matching_method,
    CASE WHEN event_id % 6 = 0 THEN 'R' || CAST(event_id % 4 AS STRING) ELSE '' END AS matching_rule_id,
    CASE event_id % 8 WHEN 0 THEN 'Imported' WHEN 1 THEN 'Failed' WHEN 2 THEN 'Exported' ELSE 'Not exported' END AS import_status,
    CASE event_id % 10 WHEN 0 THEN 'Invalid' WHEN 1 THEN 'Warning' WHEN 2 THEN 'Unchecked' ELSE 'Valid' END AS validation_status,
    '' AS validation_message,
    CASE event_id % 9 WHEN 0 THEN 'Suspected' WHEN 1 THEN 'Confirmed duplicate' WHEN 2 THEN 'Confirmed unique' ELSE 'None' END AS duplicate_status,
    '' AS duplicate_of, event_id % 13 = 0 AS ignored, ts AS created_at
FROM events"""

#: Raw cells: date, narration, reference, debit, credit, amount, direction and balance as text, two places a transaction.
RAW = """
SELECT session_id AS doc_id, 2 * row_number + 10 AS row_number,
    CASE WHEN event_id % 53 = 9 THEN 'not a date' WHEN event_id % 3 = 0 THEN d || '/' || m || '/' || y WHEN event_id % 3 = 1 THEN d || '-' || m || '-' || y ELSE d || '.' || m || '.' || y END AS c0,
    CASE WHEN event_id % 59 = 3 THEN 'Closing Balance' ELSE 'Pay  to ' || event_type || ' ' || CAST(event_id AS STRING) END AS c1,
    CASE WHEN event_id % 2 = 0 THEN 'R' || CAST(event_id AS STRING) ELSE '' END AS c2,
    CASE WHEN event_id % 4 = 0 THEN a WHEN event_id % 61 = 8 THEN '1.2.3' ELSE '' END AS c3,
    CASE WHEN event_id % 4 = 1 THEN '1,' || '0' || a ELSE '' END AS c4,
    CASE WHEN event_id % 4 = 2 THEN '(' || a || ')' WHEN event_id % 4 = 3 THEN a ELSE '' END AS c5,
    CASE WHEN event_id % 8 = 3 THEN 'Cr.' WHEN event_id % 8 = 7 THEN 'DR' ELSE '' END AS c6,
    CASE WHEN event_id % 5 = 0 THEN 'Rs ' || a ELSE '' END AS c7
FROM (SELECT *, CAST(user_id AS STRING) AS session_id, event_id AS row_number, CAST(day(ts) AS STRING) AS d, CAST(month(ts) AS STRING) AS m, CAST(year(ts) AS STRING) AS y,
    CAST(CAST(value AS DECIMAL(18,2)) AS STRING) AS a FROM events) AS e
UNION ALL
SELECT CAST(user_id AS STRING), 2 * event_id + 11, '', 'more ' || CAST(event_id AS STRING), CASE WHEN event_id % 14 = 0 THEN 'X' || CAST(event_id AS STRING) ELSE '' END, '', '', '', '', ''
FROM events WHERE event_id % 7 = 0"""

_NAMES = """
    SELECT p_name AS name, CASE WHEN min(p_type) = 'ECONOMY' THEN 'Bank Accounts' WHEN min(p_type) = 'SMALL' THEN 'Cash-in-Hand' ELSE 'Sundry Creditors' END AS parent_group FROM part GROUP BY p_name
    UNION ALL SELECT 'Suspense A/c', 'Suspense A/c' UNION ALL SELECT 'UPI', 'Misc'"""

#: Ledgers: a name for each part name, by position.
LEDGERS = f"SELECT CAST(row_number() OVER (ORDER BY lower(name), name) AS INT) AS pos, name, parent_group, name AS guid FROM ({_NAMES}) AS x"

#: Payments: descriptions that name a part in several ways.
PAYMENTS = """
SELECT DISTINCT CASE l_orderkey % 6 WHEN 0 THEN p_name WHEN 1 THEN 'UPI/' || upper(p_name) || '/' || CAST(1000000 + l_orderkey AS STRING) WHEN 2 THEN replace(p_name, ' ', '')
    WHEN 3 THEN 'PAID ' || p_name || ' STORE' WHEN 4 THEN 'NEFT ' || CAST(l_orderkey % 90 AS STRING) || ' zz' ELSE 'Rule ' || CAST(l_orderkey % 7 AS STRING) || ' x' END AS description
FROM lineitem JOIN part ON l_partkey = p_partkey"""


#: Events as rows of statements of 40 rows a page: what each cell shows, and its height on the page.
EVENT_ROWS = """
SELECT *, CAST(floor(k / 40.0) AS INT) AS page, CAST(k % 40 AS INT) AS i, CAST(100 + 20 * (k % 40) AS DOUBLE) AS y, CAST(k + 1 AS STRING) AS serial,
    CASE WHEN event_type IN ('purchase', 'error') THEN a ELSE '' END AS w, CASE WHEN event_type IN ('purchase', 'error') THEN '' ELSE a END AS c, CAST(event_id AS STRING) || '.00' AS bal,
    CASE WHEN event_id % 3 = 0 THEN 'ref' || CAST(event_id AS STRING) ELSE '' END AS ref, event_type || CASE WHEN event_id % 17 = 0 THEN ' generated' ELSE '' END AS narr
FROM (SELECT CAST(user_id AS STRING) AS doc_id, event_id, event_type, CAST(day(ts) AS STRING) || '-' || CAST(month(ts) AS STRING) || '-' || CAST(year(ts) AS STRING) AS d,
    CAST(CAST(value AS DECIMAL(18,2)) AS STRING) AS a, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INT) AS k FROM events) AS k"""

#: Their words: a header and a footer on each page, references on a line of their own, and a carried line on odd pages.
STMT_WORDS = f"""
WITH e AS ({EVENT_ROWS}), p AS (SELECT DISTINCT doc_id, page FROM e), h AS (SELECT * FROM (VALUES ('SlNo', 10, 80), ('Date', 60, 80), ('Particulars', 150, 80), ('Withdrawals', 330, 80), ('Deposits', 410, 80), ('Balance', 490, 80),
    ('Cumulative', 150, 995), ('totals', 210, 995), ('Statement', 60, 1010), ('generated', 150, 1010), ('on', 200, 1010), ('777', 10, 1030)) AS v(text, x0, top))
SELECT doc_id, page, serial AS text, CAST(10 AS DOUBLE) AS x0, y AS top FROM e UNION ALL SELECT doc_id, page, d, CAST(60 AS DOUBLE), y FROM e UNION ALL SELECT doc_id, page, event_type, CAST(150 AS DOUBLE), y FROM e
UNION ALL SELECT doc_id, page, 'generated', CAST(200 AS DOUBLE), y FROM e WHERE event_id % 17 = 0 UNION ALL SELECT doc_id, page, ref, CAST(150 AS DOUBLE), y + 9 FROM e WHERE ref <> ''
UNION ALL SELECT doc_id, page, a, CAST(CASE WHEN w <> '' THEN 330 ELSE 410 END AS DOUBLE), y FROM e UNION ALL SELECT doc_id, page, bal, CAST(490 AS DOUBLE), y FROM e
UNION ALL SELECT doc_id, page, text, CAST(x0 AS DOUBLE), CAST(top AS DOUBLE) FROM p CROSS JOIN h UNION ALL SELECT doc_id, page, 'carried', CAST(150 AS DOUBLE), CAST(90 AS DOUBLE) FROM p WHERE page % 2 = 1"""

#: Statements whose rows have copies: of some events a second, third and fourth row with longer descriptions, other references and balances. An event has an amount of its own.
COPIES = f"""
SELECT session_id, row_number * 4 + k AS row_number, id || '-' || CAST(k AS STRING) AS id, transaction_date, CAST(row_number + 1 AS {_MONEY}) AS debit_amount, CAST(0 AS {_MONEY}) AS credit_amount,
    CASE WHEN k IN (0, 2) OR row_number % 3 = 0 THEN reference_number ELSE '' END AS reference_number,
    CASE k WHEN 2 THEN description || ' ' || repeat('x', CAST(row_number % 9 AS INT)) WHEN 3 THEN description || ' ' || repeat('x', CAST(3 + row_number % 23 AS INT)) ELSE description END AS description,
    CASE WHEN k = 3 THEN balance + 1 ELSE balance END AS balance, duplicate_status, ignored
FROM (SELECT s.*, k FROM ({STMT}) AS s, (VALUES (0), (1), (2), (3)) AS v(k)) AS x WHERE k = 0 OR row_number % (3 + 2 * k) = 0"""

#: One fee of one day on many rows of one session: descriptions are one letter, again and again.
FEES = f"""
SELECT 'fees' AS session_id, event_id AS row_number, 'T' || CAST(event_id AS STRING) AS id, DATE '2024-01-31' AS transaction_date, CAST(25 AS {_MONEY}) AS debit_amount, CAST(0 AS {_MONEY}) AS credit_amount,
    'F' || CAST(floor(event_id / 20) % 50 AS STRING) AS reference_number, repeat(substr('abcdefghijklmnopqrstuvwxyz', CAST(1 + floor(event_id / 20) % 26 AS INT), 1), 20) AS description,
    CAST(user_id AS {_MONEY}) AS balance, CASE WHEN event_id % 140 = 0 THEN 'Confirmed unique' ELSE 'None' END AS duplicate_status, event_id % 260 = 0 AS ignored
FROM events WHERE event_id % 20 = 0"""

#: Payments whose part names have lost, changed or gained letters.
TYPOS = """
SELECT DISTINCT CASE l_orderkey % 7 WHEN 0 THEN substr(p_name, 1, 3) || substr(p_name, 5) WHEN 1 THEN p_name || 's' WHEN 2 THEN substr(p_name, 1, 2) || 'zq' || substr(p_name, 5) WHEN 3 THEN 'x' || p_name || ' yy'
    WHEN 4 THEN substr(p_name, 3) WHEN 5 THEN substr(p_name, 1, 3) ELSE replace(p_name, 'l', 'll') || CAST(l_orderkey % 40 AS STRING) END AS description
FROM lineitem JOIN part ON l_partkey = p_partkey"""

#: Corrections of single fields, good and bad.
CORRECTIONS = """
SELECT 'T' || CAST(event_id AS STRING) AS id, CASE event_id % 5 WHEN 0 THEN 'debit_amount' WHEN 1 THEN 'balance' WHEN 2 THEN 'value_date' WHEN 3 THEN 'voucher_type' ELSE 'narration' END AS field,
    CASE event_id % 7 WHEN 0 THEN '' WHEN 1 THEN '12.50' WHEN 2 THEN '2024-02-30' WHEN 3 THEN 'Contra' WHEN 4 THEN '2024-01-05' WHEN 5 THEN ' x ' ELSE '1.2.3' END AS value FROM events"""

#: Dates as statements write them, and the day that is meant.
DATE_TEXTS = """
SELECT event_id, CASE WHEN event_id % 9 = 8 THEN NULL ELSE CAST(ts AS DATE) END AS day,
    CASE event_id % 9 WHEN 0 THEN d || '/' || m || '/' || y WHEN 1 THEN CASE WHEN length(d) = 2 AND d > '12' THEN m || '/' || d || '/' || y ELSE d || '/' || m || '/' || y END WHEN 2 THEN d || ' ' || mon || ' ' || y WHEN 3 THEN y || '-' || m || '-' || d
        WHEN 4 THEN d || '-' || upper(mon) || '-' || substr(y, 3, 2) WHEN 5 THEN d || '.' || m || '.' || y || ' 23:59' WHEN 6 THEN mon || ' ' || d || ', ' || y WHEN 7 THEN d || '-' || m || '-' || substr(y, 3, 2) || ' 9:05 pm' ELSE '31/02/' || y END AS text
FROM (SELECT event_id, ts, CAST(day(ts) AS STRING) AS d, CAST(month(ts) AS STRING) AS m, CAST(year(ts) AS STRING) AS y, substr('JanFebMarAprMayJunJulAugSepOctNovDec', CAST(3 * month(ts) - 2 AS INT), 3) AS mon FROM events) AS x"""


#: Days of 1950 to 2049 written with two digits for the year, in two shapes.
TWO_DIGITS = """
SELECT event_id, k, CASE WHEN event_id % 2 = 0 THEN dd || '/' || mm || '/' || yy ELSE dd || '-' || mon || '-' || yy END AS text, dd || '/' || mm || '/' || yy AS plain, dd, mm, CAST(yy AS INT) AS yy
FROM (SELECT event_id, CAST(event_id % 100 AS INT) AS k, lpad(CAST(1 + event_id % 28 AS STRING), 2, '0') AS dd, lpad(CAST(1 + event_id % 12 AS STRING), 2, '0') AS mm, lpad(CAST((event_id + 50) % 100 AS STRING), 2, '0') AS yy,
    substr('JanFebMarAprMayJunJulAugSepOctNovDec', CAST(3 * (event_id % 12) + 1 AS INT), 3) AS mon FROM events) AS x"""


def bound(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The rows of a query above over events."""
    return _bound(spark, sf_dir, sql, "events")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bound(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    for t in tables:
        sql = sql.replace(f"FROM {t} ", f"FROM {{{t}}} ").replace(f"FROM {t})", f"FROM {{{t}}})").replace(f"JOIN {t} ", f"JOIN {{{t}}} ")
        sql = sql[: -len(t)] + f"{{{t}}}" if sql.endswith(f"FROM {t}") else sql
    return spark.sql(sql, **{t: _table(spark, sf_dir, t) for t in tables})


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bound(spark, sf_dir, STMT, "events").withColumn("import_message", F.lit(""))


def copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bound(spark, sf_dir, COPIES, "events")


def fees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bound(spark, sf_dir, FEES, "events")


def typos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bound(spark, sf_dir, TYPOS, "lineitem", "part")


def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _bound(spark, sf_dir, RAW, "events")
    return rows.select("doc_id", "row_number", F.array(*(f"c{i}" for i in range(8))).alias("cells"))


def raw_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = raw_rows(spark, sf_dir).select("doc_id").distinct()
    at = {"transaction_date": 0, "value_date": None, "description": 1, "reference_number": 2, "cheque_number": None, "debit": 3, "credit": 4, "amount": 5, "dr_cr": 6, "balance": 7, "header_row": 5}
    return docs.select("doc_id", *(F.lit(v).cast("int").alias(k) for k, v in at.items()), F.lit("AUTO").alias("date_format"))


def ledgers(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ranged(_bound(spark, sf_dir, _NAMES, "part"), F.lower("name"), F.col("name")).numbered("pos")
    return names.select(F.col("pos").cast("int").alias("pos"), "name", "parent_group", F.col("name").alias("guid"))


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bound(spark, sf_dir, PAYMENTS, "lineitem", "part")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with text whose commas are wide gaps, so that lines fall into cells."""
    return _table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", ", ", "  ").alias("text"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of documents as if set on pages of 50 lines: 12 units a line, 40 a word, with a little jitter in height."""
    # whole texts move, and their words stay with them: a group or window of a document's words needs no shuffle then
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text").repartition("doc_id")
    at = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("l", "line"))
    w = at.select("doc_id", "l", F.posexplode(F.split("line", " ")).alias("i", "text")).where(F.trim("text") != "")
    return w.select("doc_id", F.floor(F.col("l") / 50).cast("int").alias("page"), "text", (F.col("i") * 40.0).alias("x0"), (F.col("l") % 50 * 12.0 + F.col("i") % 3 * 0.5).alias("top"))


#: What stands on each page besides its rows: text, x0 and top.
_PAGE = [("SlNo", 10, 80), ("Date", 60, 80), ("Particulars", 150, 80), ("Withdrawals", 330, 80), ("Deposits", 410, 80), ("Balance", 490, 80), ("Cumulative", 150, 995), ("totals", 210, 995), ("Statement", 60, 1010), ("generated", 150, 1010), ("on", 200, 1010), ("777", 10, 1030)]


def page_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of STMT_WORDS, made of each event's row in one pass: events move, and their words stay with them. A page's own words come with its first row."""
    rows = bound(spark, sf_dir, EVENT_ROWS).repartition("doc_id")
    y, number = F.col("y"), lambda x: F.lit(x).cast("double")
    word = lambda text, x0, top: F.struct(text.alias("text"), (number(x0) if isinstance(x0, int) else x0).alias("x0"), (number(top) if isinstance(top, int) else top).alias("top"))
    own = [
        word(F.col("serial"), 10, y), word(F.col("d"), 60, y), word(F.col("event_type"), 150, y), F.when(F.col("event_id") % 17 == 0, word(F.lit("generated"), 200, y)), F.when(F.col("ref") != "", word(F.col("ref"), 150, y + 9)),
        word(F.col("a"), F.when(F.col("w") != "", number(330)).otherwise(number(410)), y), word(F.col("bal"), 490, y),
    ]
    first, page = F.col("i") == 0, F.array(*(word(F.lit(t), x0, top) for t, x0, top in _PAGE))
    carried = F.when(first & (F.col("page") % 2 == 1), word(F.lit("carried"), 150, 90))
    words = F.concat(F.array_compact(F.array(*own, carried)), F.when(first, page).otherwise(F.slice(page, 1, 0)))
    return rows.select("doc_id", "page", F.explode(words).alias("z")).select("doc_id", "page", "z.text", "z.x0", "z.top")


def templates(spark: SparkSession) -> DataFrame:
    rows = [(1, "apache", "Apache Bank", ["apache license"]), (2, "mit", "Mit Bank", ["mit", "MIT License"]), (3, "gnu", "Gnu Bank", ["GNU  General", "gnu"]), (4, "the", "The Bank", ["the"]), (5, "de", "De Bank", ["de", "que"])]
    return spark.createDataFrame(rows, "pos int, template_id string, bank_name string, detection_keywords array<string>")
