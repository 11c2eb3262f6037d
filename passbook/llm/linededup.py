"""Line dedup: repeated lines are found by ranges of their hashes, and each document gets a bitmap of the lines that it keeps.

A record says where a document holds one key: the key's 128-bit hash, the document and the line
numbers. Records are cut into ranges and sorted by hash, then document; a task streams its range
with one key's run open at a time. Ranges are cut between documents too, so a key that a third of
all documents hold fills several ranges. What a range cannot decide alone, which are the runs at
its two ends, it returns with their counts of documents, two for each range; these are summed and decide the rest.
Texts are not shuffled with the records, and decisions come back as compressed bitmaps.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passbook.llm.common import shuffle_partitions, spare, stored


@dataclass(frozen=True)
class Lines:
    """Keys of `points` code points or more that `documents` documents hold lose their lines: all of them, or with first all but the first.

    First is the least (doc_id, hash of the text, line number). With documents=1 and first, lines
    that repeat within one document go as well.
    """

    documents: int = 2
    points: int = 1
    first: bool = True

    def __post_init__(self):
        if self.documents < 1 or self.points < 0:
            raise ValueError("documents must be 1 or more, points 0 or more")


#: Stands for a null doc_id in records.
_NO_ID = -(2**63)


def _identity(docs: DataFrame) -> tuple[Column, Column]:
    """What tells rows apart: the id, and a hash of the text. Rows that agree in both are one document."""
    return F.coalesce(docs["doc_id"].cast("long"), F.lit(_NO_ID)), F.xxhash64(F.coalesce(docs["text"], F.lit("")))


def _points(key: bytes) -> int:
    return sum(x & 0xC0 != 0x80 for x in key)


def places(text: bytes, points: int) -> tuple[dict[bytes, list[int]], int]:
    """The line numbers of each key of a text, and its count of lines."""
    found: dict[bytes, list[int]] = {}
    lines = text.split(b"\n")
    for i, line in enumerate(lines):
        key = line.strip().lower()  # of bytes: the blanks \x20 and \x09-\x0D, and A-Z alone
        if len(key) >= 4 * points or _points(key) >= points:
            found.setdefault(key, []).append(i)
    return found, len(lines)


_RECORD = "hi long, lo long, doc long, tag long, n_lines int, at binary"


def _records(docs: DataFrame, p: Lines) -> DataFrame:
    """docs(doc, tag, text): one record for each key of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                b = whole.slice(lo, 512)
                hashes, row, n_lines, at = [], [], [], []
                for i, text in enumerate(b.column(2).cast(pa.binary()).to_pylist()):
                    found, n = places(text, p.points)
                    for key, lines in found.items():
                        hashes.append(xxhash.xxh3_128_digest(key))
                        row.append(i)
                        n_lines.append(n)
                        at.append(np.array(lines, "<i4").tobytes())
                h = np.frombuffer(b"".join(hashes), ">i8").astype(np.int64).reshape(-1, 2)
                row = np.array(row, np.int64)
                cols = [h[:, 0].copy(), h[:, 1].copy(), b.column(0).to_numpy()[row], b.column(1).to_numpy()[row]]
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(n_lines, pa.int32()), pa.array(at, pa.binary())], names=["hi", "lo", "doc", "tag", "n_lines", "at"])

    return docs.mapInArrow(run, _RECORD)


class _Sweep:
    """Streams the records of one range; the first and the last key's run may go on in neighbouring ranges.

    Rows out have kind 0: lines that go; 1 and 2: lines that go if their key's documents, counted over
    all ranges, suffice (2: the key's first line has been taken out); 3: such a key's count of documents
    in this range, and the first of them.
    """

    def __init__(self, p: Lines):
        self.p = p
        self.key, self.last, self.edge = None, None, True
        self.docs, self.held, self.head = 0, [], None
        self.out: list[tuple] = []

    def close(self, end: bool) -> None:
        """The open run is over, or (end) the range is."""
        if self.key is not None and (self.edge or end):
            self.out.extend((2, *r) for r in self.held if r[5])
            self.out.append((3, *self.key, *self.head, self.docs, b""))
        self.held = []
        self.edge &= self.key is None

    def add(self, r: tuple) -> None:
        """r: (hi, lo, doc, tag, n_lines, at), in order."""
        key, who = r[:2], r[2:4]
        if key != self.key:
            self.close(False)
            self.key, self.last, self.docs, self.head = key, None, 0, who
        if who == self.last:
            return  # a row that repeats a document
        self.last = who
        self.docs += 1
        if self.edge:  # what came before, and how much, is known when all ranges are
            self.out.append((1, *r))
            return
        if self.docs == 1 and self.p.first:
            r = (*r[:5], r[5][4:])
        if self.docs < self.p.documents:
            self.held.append(r)
            return
        self.out.extend((0, *x) for x in (*self.held, r) if x[5])
        self.held = []


_SWEPT = "kind int, hi long, lo long, doc long, tag long, n int, at binary"


def _swept(records: DataFrame, p: Lines) -> DataFrame:
    def rows(out: list[tuple]) -> pa.RecordBatch:
        types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 7, types)], names=["kind", "hi", "lo", "doc", "tag", "n", "at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep = _Sweep(p)
        for b in batches:
            for r in zip(*(b.column(i).to_pylist() for i in range(6))):
                sweep.add(r)
            yield rows(sweep.out)
            sweep.out = []
        sweep.close(True)
        yield rows(sweep.out)

    return records.mapInArrow(run, _SWEPT)


def dropped_lines(docs: DataFrame, p: Lines = Lines()) -> DataFrame:
    """(doc, tag, keep, n_dropped) of documents that lose lines: keep is a zlib-compressed bitmap, a bit for each line, the first line's the highest of the first byte."""
    doc, tag = _identity(docs)
    rows = docs.select(doc.alias("doc"), tag.alias("tag"), F.coalesce("text", F.lit("")).alias("text"))
    records = stored(_records(rows, p), "lines")
    ranged = records.repartitionByRange(shuffle_partitions(docs.sparkSession), "hi", "lo", "doc", "tag").sortWithinPartitions("hi", "lo", "doc", "tag")
    swept = stored(_swept(ranged, p), "swept")
    # two rows for each range at most
    ends = swept.where("kind = 3").groupBy("hi", "lo").agg(F.sum("n").alias("docs"), F.min(F.struct("doc", "tag")).alias("head")).where(F.col("docs") >= p.documents)
    open_ = swept.where("kind in (1, 2)").join(F.broadcast(ends), ["hi", "lo"])
    is_head = F.lit(p.first) & (F.col("kind") == 1) & (F.col("doc") == F.col("head.doc")) & (F.col("tag") == F.col("head.tag"))
    open_ = open_.select("doc", "tag", "n", F.when(is_head, F.expr("substring(at, 5)")).otherwise(F.col("at")).alias("at"))
    gone = swept.where("kind = 0").select("doc", "tag", "n", "at").unionByName(open_).where(F.length("at") > 0)
    lists = gone.groupBy("doc", "tag").agg(F.max("n").alias("n_lines"), F.collect_list("at").alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, n_dropped = [], []
            for n, at in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                bits = np.ones(n, bool)
                bits[np.frombuffer(b"".join(at), "<i4")] = False
                n_dropped.append(int(n - bits.sum()))
                keep.append(zlib.compress(np.packbits(bits).tobytes(), 1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keep, pa.binary()), pa.array(n_dropped, pa.int64())], names=["doc", "tag", "keep", "n_dropped"])

    return lists.mapInArrow(run, "doc long, tag long, keep binary, n_dropped long")


def keep_bitmaps(docs: DataFrame, p: Lines = Lines()) -> DataFrame:
    """(doc_id, text_hash, n_lines, n_dropped, keep) of each row of docs(doc_id, text), without texts.

    keep is the compressed bitmap of dropped_lines, null where every line stays. Text and id are
    hashed as in text_hash = xxhash64(text); a null text counts as empty and is one empty line.
    """
    doc, tag = _identity(docs)
    text = F.coalesce("text", F.lit(""))
    n_lines = (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")
    rows = docs.select(docs["doc_id"], doc.alias("doc"), tag.alias("tag"), n_lines.alias("n_lines"))
    both = rows.join(dropped_lines(docs, p).hint("shuffle_hash"), ["doc", "tag"], "left")
    return both.select("doc_id", F.col("tag").alias("text_hash"), "n_lines", F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"), "keep")


def kept_lines(raw: bytes, keep: bytes | None) -> tuple[bytes, int]:
    """The lines of a text that a bitmap keeps, joined by line feeds, and how many there were."""
    lines = raw.split(b"\n")
    if keep is None:
        return raw, len(lines)
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))[: len(lines)].tolist()
    return b"\n".join([x for x, k in zip(lines, bits) if k]), len(lines)


def cut_lines(docs: DataFrame, p: Lines = Lines(), digest: bool = False) -> DataFrame:
    """docs(doc_id, text, ...) with text without its repeated lines, and n_lines (before) and n_dropped.

    A line's key is the line with the blanks \\x20 and \\x09-\\x0D stripped at both ends and A-Z
    lower-cased. Null and empty texts are one empty line (a null text stays null unless its line goes).
    Rows that agree in doc_id and text are one document and lose the same lines; other rows of one id,
    or without id, are documents of their own. With digest, text gives way to kept_sha256 and only doc_id
    of the other columns stays. Columns named like a new one are replaced.
    """
    new = {"n_lines": T.LongType(), "n_dropped": T.LongType()} | ({"kept_sha256": T.StringType()} if digest else {})
    own = ["doc_id"] if digest else [c for c in docs.columns if c.lower() not in new]
    doc_name, tag_name, text_name, keep_name = spare(docs.columns, "doc", "tag", "body", "keep")
    doc, tag = _identity(docs)
    src = docs.select(*own, doc.alias(doc_name), tag.alias(tag_name), *([docs["text"].alias(text_name)] if digest else []))
    marks = dropped_lines(docs, p).select(F.col("doc").alias(doc_name), F.col("tag").alias(tag_name), F.col("keep").alias(keep_name))
    both = src.join(marks.hint("shuffle_hash"), [doc_name, tag_name], "left").select(*own, *([text_name] if digest else []), keep_name)
    schema = T.StructType([*(src.schema[c] for c in own), *(T.StructField(c, t) for c, t in new.items())])
    at = -1 if digest else own.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                b = whole.slice(lo, 256)
                n_lines, n_dropped, left = [], [], []
                texts = b.column(len(own) if digest else at).cast(pa.binary()).to_pylist()
                for t, keep in zip(texts, b.column(b.num_columns - 1).to_pylist()):
                    kept, n = kept_lines(t or b"", keep)
                    n_lines.append(n)
                    n_dropped.append(0 if keep is None else n - _ones(keep, n))
                    left.append(hashlib.sha256(kept).hexdigest() if digest else None if t is None and keep is None else kept.decode())
                cols = [b.column(i) for i in range(len(own))]
                if not digest:
                    cols[at] = pa.array(left, pa.string())
                cols += [pa.array(c, pa.int64()) for c in (n_lines, n_dropped)] + ([pa.array(left, pa.string())] if digest else [])
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return both.mapInArrow(run, schema)


def _ones(keep: bytes, n: int) -> int:
    return int(np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))[:n].sum())
