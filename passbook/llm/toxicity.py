"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are its distinct words (whole, and cut to stems, so that unseen inflections
count), pairs of neighbours and pairs with one word between them, hashed into a fixed table.
Training sees a bounded sample of labelled rows: at most `max_rows`, half of them toxic if there
are so many, chosen by a hash of the id. Per-coordinate learning rates and L1 leave a sparse weight
vector of at most 2**bits entries, which travels with the scoring tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passbook.llm.common import stored, trimmed
from passbook.llm.words import mix, word_hashes


@dataclass(frozen=True)
class Ftrl:
    """Parameters of the fit; max_rows bounds the sample and so the one task that fits it."""

    bits: int = 20
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 1.5
    l2: float = 1.0
    epochs: int = 4
    toxic_weight: float = 3.0
    max_rows: int = 12_000
    seed: int = 7


#: The bias where nothing was learnt: no text is called toxic.
UNTRAINED = -5.0
#: Bytes that are left of a word as its stem.
STEMS = (5, 7)


def features(texts: list[bytes], bits: int) -> Iterator[np.ndarray]:
    """Each text's distinct hashed words, bigrams and one-word skip-grams."""
    w, counts = word_hashes(texts, plain=True, stems=STEMS)
    shift = np.uint64(64 - bits)
    two, skip = np.uint64(0x9DDFEA08EB382D69), np.uint64(0xC2B2AE3D27D4EB4F)
    at = 0
    for m in counts.tolist():
        own, stems = w[0, at : at + m], w[1:, at : at + m]
        at += m
        stems = mix(stems ^ np.arange(1, len(stems) + 1, dtype=np.uint64)[:, None]).ravel()
        found = np.concatenate([own, stems, mix(own[:-1] * two + own[1:]), mix(own[:-2] * skip + own[2:])])
        yield np.unique((found >> shift).astype(np.uint32))


def packed(texts: pa.ChunkedArray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts' features in one array and where each text's begin and end: hashes of few texts are held at a time."""
    parts, sizes = [], [0]
    for lo in range(0, len(texts), 256):
        found = list(features([t or b"" for t in texts.slice(lo, 256).cast(pa.binary()).to_pylist()], bits))
        parts.append(np.concatenate(found))
        sizes += map(len, found)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint32)), np.cumsum(sizes)


def fit(found: np.ndarray, ends: np.ndarray, y: np.ndarray, p: Ftrl) -> np.ndarray:
    """Weights (the last is the bias) after FTRL-proximal passes over the rows, packed as above, in shuffled order."""
    size = (1 << p.bits) + 1
    z, n = np.zeros(size), np.zeros(size)
    z_bias = n_bias = 0.0
    rng = np.random.default_rng(p.seed)

    def weights(z, n):
        return np.where(np.abs(z) <= p.l1, 0.0, -(z - np.sign(z) * p.l1) / ((p.beta + np.sqrt(n)) / p.alpha + p.l2))

    for _ in range(p.epochs):
        for i in rng.permutation(len(y)).tolist():
            f = found[ends[i] : ends[i + 1]].astype(np.int64)
            zf, nf = z[f], n[f]
            wf = weights(zf, nf)
            w_bias = -z_bias / ((p.beta + n_bias**0.5) / p.alpha)
            g = 1 / (1 + np.exp(-np.clip(wf.sum() + w_bias, -35, 35))) - y[i]
            g = g * p.toxic_weight if y[i] else g
            # the features of a long text share its step, or one text would move thousands of weights at once
            gf = g / max(1.0, (len(f) / 200) ** 0.5)
            s = (np.sqrt(nf + gf * gf) - np.sqrt(nf)) / p.alpha
            z[f] = zf + gf - s * wf
            n[f] = nf + gf * gf
            s_bias = ((n_bias + g * g) ** 0.5 - n_bias**0.5) / p.alpha
            z_bias += g - s_bias * w_bias
            n_bias += g * g
    out = weights(z, n)
    out[-1] = -z_bias / ((p.beta + n_bias**0.5) / p.alpha)
    return out


def train(docs: DataFrame, labels: DataFrame, p: Ftrl = Ftrl()) -> DataFrame:
    """docs(doc_id, text) and labels(doc_id, toxic): the nonzero weights as (feature, weight); feature 2**bits is the bias.

    The sample is drawn from the labels alone, at most p.max_rows ids, so its join with the texts
    is a broadcast of a proven size. Null ids and labels are left out, of an id's labels the
    greatest counts, null texts count as empty, and of an id's texts the least counts.
    Without labelled texts there are no weights.
    """
    known = stored(labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg((F.max("toxic") == 1).cast("int").alias("toxic")), "labels")
    sums = known.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first()
    h = F.pmod(F.xxhash64("doc_id", F.lit(p.seed)), F.lit(1 << 32))

    def drawn(toxic: int, count: int, most: int) -> DataFrame:
        # the threshold leaves some more than are wanted, so no partition sends more than its share
        share = (most + 6 * most**0.5 + 20) / max(1, count)
        return known.where((F.col("toxic") == toxic) & (h < int(min(1.0, share) * (1 << 32)))).orderBy(h, "doc_id").limit(most)

    chosen = drawn(1, sums[0] or 0, p.max_rows // 2).unionByName(drawn(0, sums[1] or 0, p.max_rows - p.max_rows // 2))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))

    def run(sample: pa.Table) -> pa.Table:
        sample = sample.sort_by("doc_id")
        # texts go to this task rather than their features, which are several times larger
        w = fit(*packed(sample.column("text"), p.bits), sample.column("toxic").to_numpy().astype(np.float64), p)
        at = np.flatnonzero(w)
        return pa.table({"feature": at, "weight": w[at]})

    # one group of at most max_rows rows, by the parameter above
    fitted = rows.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(trimmed(run), "feature long, weight double")
    return stored(fitted, "toxicity")


def score(docs: DataFrame, weights: DataFrame, p: Ftrl = Ftrl(), threshold: float = 0.5) -> DataFrame:
    """docs with score (0 to 1, higher: likelier toxic) and predicted (1 if score >= threshold).

    Null and empty texts have no features and get the bias alone; without weights every text gets a low score. Columns of docs named score or
    predicted are replaced; others stay.
    """
    # at most 2**bits + 1 rows by construction
    got = weights.toPandas()
    table = np.zeros((1 << p.bits) + 1, np.float32)
    table[got["feature"].to_numpy(np.int64)] = got["weight"].to_numpy(np.float32)
    if not len(got):
        table[-1] = UNTRAINED
    at = np.flatnonzero(table)
    shared = docs.sparkSession.sparkContext.broadcast((at, table[at]))
    own = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    src = docs.select(*own)
    schema = T.StructType([*src.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, value = shared.value
        table = np.zeros((1 << p.bits) + 1, np.float32)
        table[at] = value
        bias = float(table[-1])
        for whole in batches:
            for lo in range(0, max(whole.num_rows, 1), 512):
                b = whole.slice(lo, 512)
                texts = [t or b"" for t in b.column("text").cast(pa.binary()).to_pylist()]
                z = [bias + float(table[f].sum(dtype=np.float64)) for f in features(texts, p.bits)]
                s = 1 / (1 + np.exp(-np.clip(np.array(z, np.float64), -35, 35)))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in own), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names=schema.names)

    return src.mapInArrow(trimmed(run), schema)


def held_out() -> F.Column:
    """Whether a row is kept from training: crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
