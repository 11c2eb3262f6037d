"""Stored tables of sessions, transactions, rules, import history and templates, as snapshots in folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passbook.functions.text import filled, strip, strip_control
from passbook.functions.values import format_decimal
from passbook.operators import review, summaries, validation

_TEMPLATE = (
    "template_id string, bank_name string, detection_keywords array<string>, column_aliases map<string,array<string>>, cleanup_rules array<struct<pattern:string,replacement:string>>, ignore_phrases array<string>, "
    "multiline_narration struct<enabled:boolean,joiner:string>, mapping struct<transaction_date:int,value_date:int,description:int,reference_number:int,cheque_number:int,debit:int,credit:int,amount:int,dr_cr:int,balance:int,header_row:int,date_format:string>"
)


def load_templates(spark: SparkSession, path: str) -> DataFrame:
    """Bank templates of JSON files that hold one each, or defaults and a list: an entry's values win over the defaults.

    Mappings are merged key by key; of equal ids the last file (by name) and entry wins; files that
    are no JSON are left out. pos is the template's place by file and entry.
    """
    fields = [f.split(" ", 1)[0].strip() for f in _TEMPLATE.replace("map<string,array<string>>", "map").split(", ") if " " in f]
    schema = f"{_TEMPLATE}, defaults struct<{_typed(_TEMPLATE)}>, templates array<struct<{_typed(_TEMPLATE)}>>, _bad string"
    files = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    files = files.withColumn("_file", F.col("_metadata.file_path")).where("_bad is null")
    top = F.struct(*fields)
    rows = files.select("_file", "defaults", F.posexplode(F.coalesce("templates", F.array(top))).alias("_at", "t"))
    keys = ["transaction_date", "value_date", "description", "reference_number", "cheque_number", "debit", "credit", "amount", "dr_cr", "balance", "header_row", "date_format"]
    mapping = F.struct(*(F.coalesce(f"t.mapping.{k}", f"defaults.mapping.{k}", *([F.lit(0)] if k == "header_row" else [F.lit("AUTO")] if k == "date_format" else [])).alias(k) for k in keys))
    merged = rows.select("_file", "_at", *(F.coalesce(f"t.{f}", f"defaults.{f}").alias(f) for f in fields if f != "mapping"), mapping.alias("mapping")).where("template_id is not null")
    last = merged.groupBy("template_id").agg(F.max_by(F.struct(*merged.columns), F.struct("_file", "_at")).alias("r")).select("r.*")
    return last.withColumn("pos", F.struct("_file", "_at")).drop("_file", "_at")


def _typed(ddl: str) -> str:
    return ", ".join(f"{p.split(' ', 1)[0]}:{p.split(' ', 1)[1]}" if " " in p and ":" not in p.split(" ", 1)[0] else p for p in ddl.split(", "))


#: fixed values: names that no template of a user's own may have
GENERIC = ("automatic", "generic", "generic bank")


def _mapping_keys(templates: DataFrame) -> list[str]:
    return [f.name for f in templates.schema["mapping"].dataType.fields]


def save_mappings(templates: DataFrame, corrected: DataFrame, built_in: list[str]) -> DataFrame:
    """templates with corrected(template_id, bank_name, mapping); keywords, aliases and cleanup of earlier ones stay.

    Rows with a generic, empty or built-in name are left out; rejected_mappings gives them.
    """
    fine = corrected.join(rejected_mappings(corrected, built_in).select("template_id"), "template_id", "left_anti")
    new = fine.select("template_id", strip("bank_name").alias("bank_name"), "mapping")
    both = templates.alias("o").join(new.alias("n"), F.col("o.template_id") == F.col("n.template_id"), "full_outer")
    pick = {c: F.coalesce(f"n.{c}", f"o.{c}") if c in ("template_id", "bank_name", "mapping") else F.col(f"o.{c}") for c in templates.columns}
    return both.select(*(v.alias(c) for c, v in pick.items()))


def rejected_mappings(corrected: DataFrame, built_in: list[str]) -> DataFrame:
    """corrected(template_id, bank_name, ...) whose name is empty, generic or a built-in template's."""
    name = F.lower(strip(filled("bank_name")))
    return corrected.where((name == "") | name.isin(*GENERIC, *(b.lower() for b in built_in)))


def save_template(templates: DataFrame, template_id: str, bank: str, mapping: DataFrame, built_in: list[str]) -> DataFrame:
    """templates with a corrected mapping (one row) under an id, as save_mappings; generic and built-in names raise."""
    name = bank.strip()
    if not name or name.lower() in GENERIC or name.lower() in {b.lower() for b in built_in}:
        raise ValueError("choose a bank name of your own for the template")
    new = mapping.select(F.lit(template_id).alias("template_id"), F.lit(name).alias("bank_name"), F.struct(*(F.col(c).alias(c) for c in _mapping_keys(templates))).alias("mapping"))
    return save_mappings(templates, new, [])


def delete_template(templates: DataFrame, template_id: str, built_in: list[str]) -> DataFrame:
    """templates without the one of an id; the id of a built-in one raises, an unknown id changes nothing."""
    if template_id in built_in:
        raise ValueError("a built-in template can't be deleted")
    return templates.where(F.col("template_id") != template_id)


def start_session(sessions: DataFrame | None, session_id: str, path: str, bank: str, spark: SparkSession) -> DataFrame:
    """sessions with one more, now."""
    one = spark.range(1).select(F.lit(session_id).alias("id"), F.lit(path).alias("source_path"), F.lit(bank).alias("bank_name"), F.current_timestamp().cast("timestamp_ntz").alias("created_at"))
    return one if sessions is None else sessions.unionByName(one)


def save_snapshot(current: DataFrame, changes: DataFrame, path: str) -> None:
    """A new snapshot of current with changes by id, in a folder that must not exist; it rewrites every row.

    A table that changes often lies in buckets (passbook.sources.versions): versions.change(changes, path) rewrites
    those that the changes touch. save_rules, save_history and save_mappings can be its merge.
    """
    review.upsert(current, changes).write.mode("errorifexists").parquet(path)


def list_session(transactions: DataFrame, session_id: str) -> DataFrame:
    return transactions.where(F.col("session_id") == session_id).orderBy("row_number", "created_at", "id")


def list_rules(rules: DataFrame, enabled_only: bool = False) -> DataFrame:
    return (rules.where("enabled") if enabled_only else rules).orderBy("priority", "created_at")


def save_rules(rules: DataFrame, changes: DataFrame) -> DataFrame:
    """rules with valid changes by id; an invalid change raises, which one count decides."""
    if validation.rule_errors(changes).where(F.size("errors") > 0).limit(1).count():
        raise ValueError("a rule is not valid")
    return review.upsert(rules, changes, keep=("created_at", "use_count"))


def count_rule_uses(rules: DataFrame, matched: DataFrame) -> DataFrame:
    return summaries.with_uses(rules, summaries.rule_uses(matched))


def save_history(history: DataFrame, batches: DataFrame) -> DataFrame:
    """history with batches by id; counters and messages are updated, company and time stay."""
    return review.upsert(history, batches, keep=("company_name", "created_at"))


def recent_imports(history: DataFrame, n: int = 20) -> DataFrame:
    return history.orderBy(F.desc("created_at"), "id").limit(max(1, n))


REVIEW_COLUMNS = [
    "row_number", "transaction_date", "value_date", "description", "reference_number", "cheque_number", "debit_amount", "credit_amount", "balance", "voucher_type", "bank_ledger", "opposite_ledger", "narration",
    "tally_voucher_number", "matching_confidence", "matching_method", "matching_rule_id", "validation_status", "validation_message", "duplicate_status", "duplicate_of", "import_status", "import_message",
]


def review_table(transactions: DataFrame) -> DataFrame:
    """The 23 columns of a review export with the session: text without control characters, money with two places."""
    kinds = dict(transactions.dtypes)

    def shown(c: str):
        if kinds[c].startswith("decimal"):
            return format_decimal(c).alias(c)
        return strip_control(filled(c)).alias(c) if kinds[c] == "string" else F.col(c)

    return transactions.select("session_id", *(shown(c) for c in REVIEW_COLUMNS))


def export_review(transactions: DataFrame, path: str) -> None:
    """The review table and its summary as two folders of CSV with headers."""
    review_table(transactions).write.mode("overwrite").option("header", True).csv(f"{path}/transactions")
    summaries.export_summary(transactions).write.mode("overwrite").option("header", True).csv(f"{path}/summary")


def template_slug(bank: str) -> str:
    """A template's id from its bank's name."""
    import re

    return re.sub(r"[^a-z0-9]+", "_", bank.strip().lower()).strip("_")


