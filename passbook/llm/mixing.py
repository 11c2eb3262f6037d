"""Mixing sources to target weights by iterative proportional fitting.

Token weights are summed in cells of source, language and topic. Raking multiplies the cells until
the sums over each of the three agree with target shares; the result divided by the cell's own
weight calibrates the probability with which a document of the cell is kept. Whether it is kept
follows from a hash of its id and text, so a rerun keeps the same documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passbook.llm.common import apart, spare, stored, trimmed
from passbook.llm.words import word_hashes

DIMENSIONS = ("source", "lang", "topic")


@dataclass(frozen=True)
class Mix:
    """flatten: a marginal's target shares are its own shares to this power; budget: tokens to keep, as a share of all.

    Cells are raked on the driver up to max_cells of them and by Spark jobs beyond; shortest: bytes of a topic's word at least.
    """

    flatten: float = 0.8
    budget: float = 0.9
    rounds: int = 30
    tolerance: float = 1e-6
    topics: int = 12
    shortest: int = 6
    max_cells: int = 50_000
    seed: int = 5


def measured(docs: DataFrame, p: Mix) -> DataFrame:
    """docs with n_tokens (its words) and topic: the bucket of its most frequent long word, -1 without one.

    Null texts have no words. A column of docs with one of these names is replaced.
    """
    own = [c for c in docs.columns if c.lower() not in ("n_tokens", "topic")]
    src = docs.select(*own)
    schema = T.StructType([*src.schema.fields, T.StructField("n_tokens", T.LongType()), T.StructField("topic", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, max(1, whole.num_rows), 512):
                b = whole.slice(lo, 512)
                w, counts = word_hashes([t or b"" for t in b.column("text").cast(pa.binary()).to_pylist()], plain=True, stems=(p.shortest - 1,))
                topics, at = [], 0
                for m in counts.tolist():
                    own_, short = w[0, at : at + m], w[1, at : at + m]
                    at += m
                    long = np.sort(own_[own_ != short])  # a word that its stem doesn't exhaust
                    if not len(long):
                        topics.append(-1)
                        continue
                    first = np.flatnonzero(np.r_[True, long[1:] != long[:-1]])
                    most = np.diff(np.r_[first, len(long)]).argmax()
                    topics.append(int(long[first[most]] % np.uint64(p.topics)))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in own), pa.array(counts), pa.array(topics, pa.int32())], names=schema.names)

    return src.mapInArrow(trimmed(run), schema)


def own_targets(cells: DataFrame, p: Mix) -> dict[str, DataFrame]:
    """Target shares (value, share) of each marginal: its shares of all tokens, flattened."""
    out = {}
    for d in DIMENSIONS:
        sums = cells.groupBy(F.col(d).alias("value")).agg(F.sum("weight").alias("w")).where("w > 0")
        sums = sums.withColumn("share", F.pow("w", F.lit(p.flatten)))
        whole = sums.agg(F.sum("share")).first()[0] or 1.0
        out[d] = sums.select("value", (F.col("share") / whole).alias("share"))
    return out


def _rake_numpy(cells: list[tuple], targets: dict[str, dict], p: Mix) -> np.ndarray:
    w = np.array([c[3] for c in cells], float)
    sides = []
    for k, d in enumerate(DIMENSIONS):
        values = {v: i for i, v in enumerate({c[k] for c in cells})}
        sides.append((np.array([values[c[k]] for c in cells]), np.array([targets[d].get(v, 0.0) for v in values])))
    total = w.sum()
    for _ in range(p.rounds):
        for at, share in sides:
            sums = np.bincount(at, w, len(share))
            w = w * np.divide(share * total, sums, out=np.zeros_like(sums), where=sums > 0)[at]
        gaps = [np.abs(np.bincount(at, w, len(share))[share > 0] / (share[share > 0] * total) - 1).max(initial=0) for at, share in sides]
        if max(gaps) < p.tolerance:
            break
    return w


def rake(cells: DataFrame, targets: dict[str, DataFrame], p: Mix) -> DataFrame:
    """cells(source, lang, topic, weight) with fitted: the weight raked to the targets' shares of all weight.

    A value without a target gets nothing, a target without weight stays unmet. Null values are a
    value of their own.
    """
    spark = cells.sparkSession
    some = cells.limit(p.max_cells + 1).count()
    if some <= p.max_cells:  # a proven size
        rows = [tuple(r) for r in cells.select(*DIMENSIONS, "weight").collect()]
        shares = {d: {r.value: r.share for r in targets[d].collect()} for d in DIMENSIONS}
        fitted = _rake_numpy(rows, shares, p).tolist() if rows else []
        schema = T.StructType([*(cells.schema[d] for d in DIMENSIONS), T.StructField("weight", T.DoubleType()), T.StructField("fitted", T.DoubleType())])
        return spark.createDataFrame([(*r[:3], float(r[3]), f) for r, f in zip(rows, fitted)], schema)
    total = cells.agg(F.sum("weight")).first()[0]
    now = cells.withColumn("fitted", F.col("weight").cast("double"))
    held = {d: stored(targets[d], "targets") for d in DIMENSIONS}
    for _ in range(p.rounds):
        for d in DIMENSIONS:
            sums = now.groupBy(F.col(d).alias("value")).agg(F.sum("fitted").alias("sum"))
            factor = sums.join(held[d].withColumnRenamed("value", "v"), F.col("value").eqNullSafe(F.col("v")), "left")
            factor = factor.select("value", F.when(F.col("sum") > 0, F.coalesce("share", F.lit(0.0)) * total / F.col("sum")).otherwise(0.0).alias("factor"))
            now = now.join(apart(factor), F.col(d).eqNullSafe(F.col("value")), "left").select(*DIMENSIONS, "weight", (F.col("fitted") * F.col("factor")).alias("fitted"))
        now = stored(now, "raked")
        gaps = [now.groupBy(d).agg(F.sum("fitted").alias("s")).join(held[d], F.col(d).eqNullSafe(F.col("value"))).agg(F.max(F.abs(F.col("s") / (F.col("share") * total) - 1))) for d in DIMENSIONS]
        if max(g.first()[0] or 0 for g in gaps) < p.tolerance:
            break
    return now.select(*DIMENSIONS, F.col("weight").cast("double").alias("weight"), "fitted")


def _scale(cells: DataFrame, budget: float) -> float:
    """The factor c for which sum(weight * min(1, c * fitted / weight)) meets the budget, by bisection in one sum for 64 factors at a time."""
    low, high = 0.0, 1.0
    whole = cells.agg(F.sum("weight"), F.max(F.when(F.col("fitted") > 0, F.col("weight") / F.col("fitted")))).first()
    if not whole[0]:
        return 0.0
    high = float(whole[1] or 1.0)
    goal = budget * whole[0]
    for _ in range(4):
        tries = np.linspace(low, high, 65)[1:]
        sums = cells.agg(*(F.sum(F.least("weight", F.col("fitted") * float(c))) for c in tries)).first()
        above = [i for i, s in enumerate(sums) if s >= goal]
        if not above:
            return high
        i = above[0]
        low, high = (low if i == 0 else float(tries[i - 1])), float(tries[i])
    return high


def mixed(docs: DataFrame, p: Mix = Mix(), targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """docs(doc_id, text, lang, source, ...) with n_tokens, topic, weight (fitted over own), probability, repeats and kept.

    A cell whose fitted weight exceeds what it has is kept whole; repeats says how often a kept document
    counts (1, or more in such a cell), so that kept tokens times repeats have the raked shares.

    targets: (value, share) for source, lang and topic; by default the own shares, flattened.
    Documents without words have weight, probability and repeats 1 and are kept. One row for each row of docs;
    equal rows share one decision. Columns of docs with the names of new ones are replaced.
    """
    new = ("weight", "probability", "repeats", "kept")
    docs = docs.select(*(c for c in docs.columns if c.lower() not in new))
    rows = measured(docs, p)
    cells = stored(rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("weight")).where("weight > 0"), "cells")
    fitted = stored(rake(cells, targets or own_targets(cells, p), p), "fitted")
    c = _scale(fitted, p.budget)
    ratio = F.col("fitted") / F.col("weight")
    # the table of cells is read back from a file, so that Spark knows its size
    cell = [*DIMENSIONS, "ratio", "rate", "repeats"]
    names = dict(zip(cell, spare(rows.columns, *(f"cell_{c}" for c in cell))))
    of_cell = {"ratio": ratio, "rate": F.least(F.lit(1.0), ratio * c), "repeats": F.greatest(F.lit(1.0), ratio * c)}
    rates = fitted.select(*((of_cell[k] if k in of_cell else F.col(k)).alias(v) for k, v in names.items()))
    same = [F.col(d).eqNullSafe(F.col(names[d])) for d in DIMENSIONS]
    u = F.pmod(F.xxhash64("doc_id", "text", F.lit(p.seed)), F.lit(1 << 40)) / float(1 << 40)
    # few cells go to every task; more of them are joined by a shuffle in which hot cells can be split
    few = rates.limit(p.max_cells + 1).count() <= p.max_cells
    out = (rows if few else apart(rows)).join(F.broadcast(rates) if few else apart(rates).hint("merge"), same[0] & same[1] & same[2], "left")
    empty = F.col("n_tokens") == 0
    weight, rate, repeats = (F.when(empty, 1.0).otherwise(F.coalesce(names[x], F.lit(y))) for x, y in (("ratio", 0.0), ("rate", 0.0), ("repeats", 1.0)))
    return out.select(*rows.columns, weight.alias("weight"), rate.alias("probability"), repeats.alias("repeats"), (u < rate).alias("kept"))
