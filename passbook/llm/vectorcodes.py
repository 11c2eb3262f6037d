"""Vector code compression: each part of a vector becomes the index of its nearest codebook entry.

Codebooks are found by Lloyd's rounds over members that stay where they are. A member is one part of
one vector; it lies with the owner of its (position, entry, salt), a file of a stored table. Owners
sum their resident members to update the entries. Then each member looks for its nearest entry again:
those that keep their entry are written where they are, without a shuffle, and only the others
migrate to the owner of their new entry. An entry with many members has as many salts as make its owners
no larger than others. What the driver sees is the codebooks and one sum for each entry and component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passbook.llm.common import apart, discard, shuffle_partitions, spare, stored, written


@dataclass(frozen=True)
class Codes:
    """Vectors in `parts` equal parts, each coded by one of `entries` (256 at most); components are floor(scale * x)."""

    parts: int = 4
    entries: int = 256
    rounds: int = 4
    scale: int = 1024

    def __post_init__(self):
        if not 1 <= self.entries <= 256 or self.parts < 1 or self.rounds < 0:
            raise ValueError("entries must be 1 to 256, parts 1 or more, rounds 0 or more")


#: Integer components stay below this in magnitude, so that members are 4 bytes a component and squared distances fit 64 bits.
MOST = 1 << 28
#: Labels whose sums go to every task; more of them are joined by a shuffle.
LABELS = 50_000
#: Members that are compared with a codebook at once.
STEP = 4096


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of x the index of the nearest row of book (the lower among equals), and their squared distance."""
    at, far = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    width = x.shape[1]
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    kind = np.float64 if 4 * most * most * max(1, width) < 2**53 else np.int64  # sums of doubles are exact there, and fast
    c = book.astype(kind)
    own = (c * c).sum(axis=1)
    for lo in range(0, len(x), STEP):
        part = x[lo : lo + STEP].astype(kind)
        d = own - 2 * (part @ c.T)
        best = d.argmin(axis=1)
        at[lo : lo + STEP] = best
        far[lo : lo + STEP] = (d[np.arange(len(part)), best] + (part * part).sum(axis=1)).astype(np.int64)
    return at, far


def quantised(vectors: DataFrame, p: Codes) -> DataFrame:
    """vectors with a column x for the embedding: floor(scale * component); rows whose vector is null or holds null or non-finite components are left out."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = vectors.where(F.col("embedding").isNotNull() & ~bad)
    most = good.select(F.max(F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double")))))).first()[0]
    if most and most * p.scale >= MOST:
        raise ValueError(f"a component of {most} is too large: its integer must stay below {MOST}")
    return good.select("vec_id", "label", F.transform("embedding", lambda x: F.floor(x.cast("double") * p.scale).cast("int")).alias("x"))


def _flat(col: pa.Array, width: int) -> np.ndarray:
    return np.asarray(col.flatten(), np.int64).reshape(len(col), width)


class _Members:
    """The stored members: tables of (position, entry, tag, part), of which the first holds residents and the second the last migrants."""

    def __init__(self, width: int, p: Codes):
        self.width, self.p, self.tables, self.paths = width, p, [], []

    def every(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.tables)

    def replace(self, *dfs: tuple[DataFrame, str]) -> None:
        """Takes newer tables and deletes the older ones, which nothing reads any more."""
        old, self.tables, self.paths = self.paths, [d for d, _ in dfs], [x for _, x in dfs]
        for path in set(old) - set(self.paths):
            discard(self.tables[0].sparkSession, path)


_MEMBER = "position int, entry int, tag int, part array<int>"


def _salted(members: DataFrame, counts: np.ndarray, n: int) -> DataFrame:
    """members at the owners of their (position, entry, salt): an entry has a salt for each quarter of a partition's fair share."""
    share = max(1, int(counts.sum()) // (4 * n))
    salts = F.lit((np.maximum(1, -(-counts // share))).ravel().tolist())
    many = F.get(salts, F.col("position") * counts.shape[1] + F.col("entry"))
    return members.withColumn("salt", F.pmod("tag", many).cast("int")).repartition(n, "position", "entry", "salt").drop("salt")


def _sums(members: DataFrame, p: Codes, width: int) -> list:
    """(position, entry, j, total, count): owners add up their members, then the salts' sums meet."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((p.parts * p.entries, width), np.int64), np.zeros(p.parts * p.entries, np.int64)
        for b in batches:
            slot = np.asarray(b.column(0), np.int64) * p.entries + np.asarray(b.column(1), np.int64)
            np.add.at(total, slot, _flat(b.column(3), width))
            count += np.bincount(slot, minlength=len(count))
        at = np.flatnonzero(count)
        cols = [pa.array((at // p.entries).astype(np.int32)), pa.array((at % p.entries).astype(np.int32)), pa.array(count[at]), pa.array(list(total[at]), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(cols, names=["position", "entry", "count", "total"])

    sums = members.mapInArrow(own, "position int, entry int, count long, total array<long>")
    each = sums.select("position", "entry", "count", F.posexplode_outer("total").alias("j", "total"))
    return each.groupBy("position", "entry", "j").agg(F.sum("total").alias("total"), F.sum("count").alias("count")).collect()


def _updated(books: np.ndarray, sums: list) -> tuple[np.ndarray, np.ndarray]:
    """Codebooks with entries moved to floor(sum / count), and each entry's count; unused entries stay."""
    books, counts = books.copy(), np.zeros(books.shape[:2], np.int64)
    for r in sums:
        counts[r.position, r.entry] = r["count"]
        if r.j is not None:
            books[r.position, r.entry, r.j] = r.total // r["count"]
    return books, counts


def codebooks(kept: DataFrame, p: Codes = Codes()) -> np.ndarray:
    """kept(vec_id, x): the final codebooks, (parts, entries, components); entries are fewer where there are fewer rows.

    The first codebooks are the parts of the rows of least vec_id (null ids last; equal ids by x).
    """
    spark = kept.sparkSession
    heads = kept.select("vec_id", "x").orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(p.entries).collect()
    whole = len(heads[0].x)
    if whole % p.parts:
        raise ValueError(f"vectors of {whole} components have no {p.parts} equal parts")
    width = whole // p.parts
    books = np.array([r.x for r in heads], np.int64).reshape(len(heads), p.parts, width).transpose(1, 0, 2).copy()
    p = Codes(p.parts, len(heads), p.rounds, p.scale)
    if not p.rounds:
        return books
    n = shuffle_partitions(spark)
    shown = spark.sparkContext.broadcast(books)

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, tag = _flat(b.column(1), whole), np.asarray(b.column(0), np.int32)
            for i in range(p.parts):
                own = np.ascontiguousarray(x[:, i * width : (i + 1) * width])
                entry = nearest(own, shown.value[i])[0].astype(np.int32)
                offsets = pa.array(np.arange(len(own) + 1) * width, pa.int32())
                part = pa.ListArray.from_arrays(offsets, pa.array(own.ravel().astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), i, np.int32)), pa.array(entry), pa.array(tag), part], names=["position", "entry", "tag", "part"])

    # the tag is a random draw that stays with the row, so that equal vectors spread as well
    tagged = kept.select(F.shiftright(F.xxhash64("vec_id", F.monotonically_increasing_id()), 33).cast("int").alias("tag"), "x")
    path = written(tagged.mapInArrow(enter, _MEMBER), "members")
    entered = spark.read.schema(_MEMBER).parquet(path)
    counts = np.zeros((p.parts, p.entries), np.int64)
    for r in entered.groupBy("position", "entry").agg(F.count("*").alias("n")).collect():
        counts[r.position, r.entry] = r.n
    members = _Members(width, p)
    members.replace((entered, path))
    path = written(_salted(entered, counts, n), "owners")
    members.replace((spark.read.schema(_MEMBER).parquet(path), path))
    for turn in range(p.rounds):
        books, counts = _updated(books, _sums(members.every(), p, width))
        if turn == p.rounds - 1:
            break
        shown = spark.sparkContext.broadcast(books)

        def look(batches: Iterator[pa.RecordBatch], shown=shown) -> Iterator[pa.RecordBatch]:
            for b in batches:
                position, entry, x = np.asarray(b.column(0)), np.asarray(b.column(1)), _flat(b.column(3), width)
                now = entry.copy()
                for i in np.unique(position).tolist():
                    at = np.flatnonzero(position == i)
                    now[at] = nearest(x[at], shown.value[i])[0]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(now), b.column(2), b.column(3), pa.array((now != entry).astype(np.int32))], names=["position", "entry", "tag", "part", "moved"])

        path = written(members.every().mapInArrow(look, f"{_MEMBER}, moved int"), "residents", ("moved",))
        both = spark.read.schema(f"{_MEMBER}, moved int").parquet(path)
        moved = written(_salted(both.where("moved = 1").drop("moved"), counts, n), "migrants")
        members.replace((both.where("moved = 0").drop("moved"), path), (spark.read.schema(_MEMBER).parquet(moved), moved))
    members.replace(*[(kept, "")])
    return books


def compressed(vectors: DataFrame, p: Codes = Codes()) -> DataFrame:
    """vectors(vec_id, embedding, label): vec_id, code, error, label_error and codebooks_sha256 of each row whose vector is whole.

    code: the entries' indexes in the order of parts, two hex digits each. error: squared distances to
    them, added up. label_error: the errors of all rows with the same label (null is a label). Rows that
    repeat a vec_id are coded each. All kept vectors must have one length, which parts divides; else, and
    for components whose integers reach 2**28, it raises ValueError. No kept rows give no rows.
    """
    spark = vectors.sparkSession
    if "label" not in {c.lower() for c in vectors.columns}:
        vectors = vectors.withColumn("label", F.lit(None).cast("int"))
    kept = stored(quantised(vectors, p), "vectors")
    least, whole = kept.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    coded = T.StructType([kept.schema["vec_id"], kept.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    if least is None:
        return spark.createDataFrame([], T.StructType([coded[0], *coded[2:], T.StructField("label_error", T.LongType()), T.StructField("codebooks_sha256", T.StringType())]))
    if least != whole:
        raise ValueError(f"vectors have {least} to {whole} components")
    books = codebooks(kept, p)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    shown = spark.sparkContext.broadcast(books)
    width = whole // p.parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, codes, error = _flat(b.column(2), whole), np.zeros((b.num_rows, p.parts), np.uint8), np.zeros(b.num_rows, np.int64)
            for i in range(p.parts):
                entry, far = nearest(x[:, i * width : (i + 1) * width], shown.value[i])
                codes[:, i] = entry
                error += far
            text = codes.tobytes().hex()
            step = 2 * p.parts
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([text[k : k + step] for k in range(0, len(text), step)], pa.string()), pa.array(error)], names=coded.names)

    rows = stored(kept.mapInArrow(run, coded), "codes")
    (own,) = spare(rows.columns, "group")
    sums = stored(rows.groupBy(F.col("label").alias(own)).agg(F.sum("error").alias("label_error")), "labels")
    few = sums.limit(LABELS + 1).count() <= LABELS
    both = (rows if few else apart(rows)).join(F.broadcast(sums) if few else apart(sums).hint("shuffle_hash"), F.col("label").eqNullSafe(F.col(own)))
    return both.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
