"""Exact top-k search over vectors as documents whose terms are components, by MaxScore.

Each component is a term; its impact is the component's integer value. Vectors lie in shards. In a
shard the range of a term's impacts bounds what it adds to a query's score. Terms are split by
these bounds: the essential ones are the widest, as few as leave the others too narrow to lift a
candidate from its least score to the k-th best so far. Essential postings are traversed for a run
of candidates at a time; the other terms are probed, widest first, only while a candidate can still
reach the k-th best score, which rises from run to run. Vectors are dense, so a term's postings are
a column of impacts that names every candidate. The k best of all shards are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from passbook.llm.common import stored

#: Impacts of a shard; queries and candidates that are scored at once, and candidates that give the first threshold: bound what one task holds.
IMPACTS, QUERIES, RUN, FIRST = 1 << 19, 128, 2048, 256
#: Terms that are probed before candidates are dropped again.
STEP = 8
#: Below any score.
_NONE = -(1 << 62)


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, impacts array<long>): floor(scale * x), at most 2**63 - 1 in magnitude; vectors that are null or hold null or non-finite components are left out."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = vectors.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & ~bad)
    return good.select("vec_id", F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("impacts"))


def _matrix(col: pa.Array, width: int) -> np.ndarray:
    """Rows of a list array, each gone on in zeros to the width."""
    lengths = np.asarray(col.value_lengths(), np.int64)
    out = np.zeros((len(col), width), np.int64)
    at = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[np.repeat(np.arange(len(col)), lengths), at] = np.asarray(col.flatten(), np.int64)
    return out


class Shard:
    """Candidates of one shard, in order of their ids, with their terms' postings and bounds."""

    def __init__(self, ids: np.ndarray, impacts: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.impacts = ids[order], impacts[order]
        self.low, self.high = self.impacts.min(axis=0), self.impacts.max(axis=0)
        self.postings = {np.dtype(np.int64): np.ascontiguousarray(self.impacts.T)}
        self.postings[np.dtype(np.float64)] = self.postings[np.dtype(np.int64)].astype(np.float64)

    def search(self, q: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, vec_id, score) of the k best candidates for each row of q, whose ids (own) are no candidates; ties to smaller ids."""
        n, width = self.impacts.shape
        span = np.maximum(np.abs(self.low), np.abs(self.high))
        # products of doubles are exact, and fast, while every sum fits 53 bits
        kind = np.dtype(np.float64) if float(np.abs(q).max(initial=0)) * float(span.max(initial=0)) * max(1, width) < 2**53 else np.dtype(np.int64)
        q, postings = q.astype(kind), self.postings[kind]
        most, least = np.maximum(q * self.low, q * self.high), np.minimum(q * self.low, q * self.high)
        order = np.argsort(least - most, axis=1, kind="stable")
        rows = np.arange(len(q))[:, None]

        def rest(x: np.ndarray) -> np.ndarray:
            """Of each query the sums over its terms from the j-th widest on."""
            return np.concatenate([np.cumsum(x[rows, order][:, ::-1], axis=1)[:, ::-1], np.zeros((len(q), 1), kind)], axis=1)

        can_add, spread, floor = rest(most), rest(most - least), least.sum(axis=1)
        rank = np.empty_like(order)
        rank[rows, order] = np.arange(width)
        terms = np.concatenate([order, np.full((len(q), STEP), width)], axis=1)  # the last term stands for none
        q_more = np.concatenate([q, np.zeros((len(q), 1), kind)], axis=1)
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, kind))
        bar = np.full(len(q), _NONE, kind)
        for lo in range(0, n, RUN) if n <= FIRST else [0, *range(FIRST, n, RUN)]:
            hi = min(n, lo + RUN) if lo or n <= FIRST else FIRST
            essential = (floor[:, None] + spread >= bar[:, None]).sum(axis=1).clip(max=width)
            score = (q * (rank < essential[:, None])) @ postings[:, lo:hi]
            who, which = np.nonzero((score + can_add[np.arange(len(q)), essential][:, None] >= bar[:, None]) & (self.ids[lo:hi] != own[:, None]))
            score, which, at = score[who, which], which + lo, essential[who]
            while True:
                open_ = at < width
                if not open_.any():
                    break
                for j in range(STEP):
                    t = terms[who, at + j]
                    score += q_more[who, t] * np.where(t < width, postings[np.minimum(t, width - 1), which], 0)
                at = np.minimum(at + STEP, width)
                stay = score + can_add[who, at] >= bar[who]
                who, which, score, at = who[stay], which[stay], score[stay], at[stay]
            best = self._kept(np.concatenate([best[0], who]), np.concatenate([best[1], self.ids[which]]), np.concatenate([best[2], score]), k)
            count = np.bincount(best[0], minlength=len(q))
            full = count == k
            bar[full] = best[2][np.cumsum(count)[full] - 1]
        return best[0], best[1], best[2].astype(np.int64)

    @staticmethod
    def _kept(who: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((ids, -score, who))
        who, ids, score = who[order], ids[order], score[order]
        place = np.arange(len(who)) - np.searchsorted(who, who)
        return who[place < k], ids[place < k], score[place < k]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """vectors and queries (vec_id, impacts): query_id, rank (from 1), vec_id, score of each query's k best inner products.

    A query's own vec_id is no candidate; fewer than k candidates give fewer rows; ties go to the
    smaller vec_id. Vectors of different lengths are compared as if the shorter went on in zeros.
    Rows that repeat a vec_id count once, with their least impacts. Impacts whose scores could exceed
    62 bits raise ValueError, so that none wraps. A task holds one shard and streams the queries through it.
    """
    v = stored(vectors.groupBy("vec_id").agg(F.min("impacts").alias("impacts")), "vectors")
    q = stored(queries.groupBy("vec_id").agg(F.min("impacts").alias("impacts")), "queries")
    largest = F.max(F.greatest(F.array_max("impacts").cast("double"), -F.array_min("impacts").cast("double")))
    sizes = [df.agg(F.count("*"), F.max(F.size("impacts")), largest).first() for df in (v, q)]
    width = max(1, *(int(s[1] or 0) for s in sizes))
    if width * (sizes[0][2] or 0.0) * (sizes[1][2] or 0.0) >= 2**62:
        raise ValueError("impacts are so large that scores may not fit 62 bits")
    shards = max(1, -(-sizes[0][0] * width // IMPACTS))
    shard = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")
    rows = v.select(shard.alias("shard"), F.lit(0).alias("kind"), "vec_id", "impacts")
    asks = q.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), "vec_id", "impacts")
    dealt = rows.unionByName(asks).repartition(shards, "shard").sortWithinPartitions("shard", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, index = None, [], None

        def answers(ids: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
            for lo in range(0, len(ids), QUERIES):
                who, found, score = index.search(x[lo : lo + QUERIES], ids[lo : lo + QUERIES], k)
                yield pa.RecordBatch.from_arrays([pa.array(ids[lo : lo + QUERIES][who]), pa.array(found), pa.array(score)], names=["query_id", "vec_id", "score"])

        for b in batches:
            shard, kind, ids = (np.asarray(b.column(i)) for i in range(3))
            x = _matrix(b.column(3), width)
            # candidates of a shard come first, then the queries
            cuts = np.flatnonzero((shard[1:] != shard[:-1]) | (kind[1:] != kind[:-1])) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)]):
                if lo == hi:
                    continue
                if shard[lo] != number:
                    number, held, index = shard[lo], [], None
                if kind[lo] == 0:
                    held.append((ids[lo:hi], x[lo:hi]))
                elif held or index:
                    if index is None:
                        index, held = Shard(np.concatenate([i for i, _ in held]), np.concatenate([m for _, m in held])), []
                    yield from answers(ids[lo:hi].astype(np.int64), x[lo:hi])

    best = dealt.mapInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
