"""A corpus pipeline of five of the operators, each stage written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passbook.llm import bpe, mixing, neardup, suffix_dedup, toxicity
from passbook.llm.common import stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


#: Rows of a batch that goes to a Python worker; texts are long, and a worker holds a batch whole.
BATCH_ROWS = 1000


def _batches(spark: SparkSession) -> None:
    """Keeps what workers and executors hold of texts at once small, as large batches bring nothing here."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a classifier, trained on the labelled ones that are not held out, doesn't call toxic."""
    _batches(spark)
    weights = toxicity.train(docs, table(spark, sf_dir, "labels").where(~toxicity.held_out()))
    return toxicity.score(docs, weights).where("predicted = 0").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group of near copies (5-word shingles, 0.8)."""
    _batches(spark)
    return neardup.deduplicated(docs).select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their strings of 200 bytes that start more than once; n_chars follows the text."""
    _batches(spark)
    return suffix_dedup.cut_repeats(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def sample_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample by probabilities that are calibrated to flattened shares of sources, languages and topics."""
    _batches(spark)
    return mixing.mixed(docs).where("kept").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their ids, n_tokens and whether the ids decode to the text."""
    _batches(spark)
    import public_tokenizers

    out = bpe.encode_texts(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    same = F.col("decoded") == F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return out.select(*COLUMNS, "ids", F.size("ids").cast("long").alias("n_tokens"), same.alias("decodes"))


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("mixing", sample_mix),
    ("byte_bpe", encode),
]

#: The stages train, join by hash and encode, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs, name)
    return docs
