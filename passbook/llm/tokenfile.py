"""Token-ID files: shards of raw ids, with a minimal perfect hash from document keys to offsets.

The files are a Parquet folder of shard rows in ascending order of doc_id. A shard holds the ids of
neighbouring documents as raw little-endian integers (2 bytes where the vocabulary allows, else
4), and an index: a minimal perfect hash of the keys gives a slot, which stores a 32-bit fingerprint
of the key, the document's offset and its length. A key is a doc_id and, for ids that repeat in a
shard, which of them it is. Spark writes and reads the folder, so it may lie in any store.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passbook.llm import pretokens
from passbook.llm.bpe import PerfectHash, read_file
from passbook.llm.common import run_dir, shuffle_partitions
from passbook.llm.words import mix

#: Bytes of ids after which a shard is closed; bounds memory, never results.
SHARD_BYTES = 4 << 20

SCHEMA = "part int, seq int, before long, n_ids long, n_docs int, first long, last long, width int, keys binary, missing binary, index binary, slots binary, payload binary"
#: What a slot stores.
_SLOT = np.dtype([("fingerprint", "<u4"), ("offset", "<u8"), ("length", "<u4")])


@lru_cache(maxsize=1)
def library_kinds() -> np.ndarray:
    """The kind of each code point by the tokenizers library's own patterns."""
    from tokenizers import Regex, pre_tokenizers

    def matches(pattern: str, text: str) -> str:
        cut = pre_tokenizers.Split(Regex(f"{pattern}+"), "removed", invert=True)
        return "".join(piece for lo in range(0, len(text), 4096) for piece, _ in cut.pre_tokenize_str(text[lo : lo + 4096]))

    return pretokens.kinds(matches)


class Encoder:
    """Ids by the tokenizers library; each distinct pre-token goes through it once for as long as it is remembered.

    That gives the ids of whole texts for byte-level tokenizers without normaliser, which encode
    pre-tokens apart. With any other, and for texts that hold an added token, the library gets whole texts.
    plain: special tokens' strings in a text are ordinary text.
    """

    def __init__(self, content: bytes, kinds: bytes | None = None, plain: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(content.decode())
        self.library.encode_special_tokens = plain
        spec = json.loads(content)
        pre = spec.get("pre_tokenizer") or {}
        self.apart = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer")
        self.added = [x["content"] for x in spec.get("added_tokens", [])]
        self.size = self.library.get_vocab_size()
        if self.apart:
            # the same tokenizer for text that is split already, and the bytes of each id (a character of an entry is a byte)
            self.merger = Tokenizer.from_str(json.dumps(spec | {"pre_tokenizer": pre | {"use_regex": False}}))
            vocabulary = self.library.get_vocab(with_added_tokens=True)
            self.bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
            self.bytes[list(vocabulary.values())] = [len(t) for t in vocabulary]
            self.memory = pretokens.Memory(np.frombuffer(kinds, np.uint8) if kinds else library_kinds(), self._learn)

    def _learn(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        flat = np.array(self.merger.encode_batch_fast([pieces], is_pretokenized=True, add_special_tokens=False)[0].ids, np.uint32)
        # a piece's ids end where their bytes do
        ends = np.searchsorted(np.cumsum(self.bytes[flat]), np.cumsum([len(p.encode()) for p in pieces])) + 1
        return flat, np.diff(ends, prepend=0)

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        whole = [not self.apart or any(a in t for a in self.added) for t in texts]
        split = self.memory.encode([t for t, w in zip(texts, whole) if not w]) if self.apart else iter(())
        for t, w in zip(texts, whole):
            yield np.array(self.library.encode(t, add_special_tokens=False).ids, np.uint32) if w else next(split)


@lru_cache(maxsize=2)
def _encoder(content: bytes, kinds: bytes) -> Encoder:
    return Encoder(content, kinds)


def _hashes(keys: np.ndarray, missing: np.ndarray) -> np.ndarray:
    """A distinct hash of each key of a shard, which are sorted: of the id, and which of equal ids it is."""
    new = np.r_[True, (keys[1:] != keys[:-1]) | (missing[1:] != missing[:-1])]
    turn = np.arange(len(keys)) - np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))
    return key_hash(keys, turn, missing)


def key_hash(keys: np.ndarray, turn: np.ndarray, missing: np.ndarray) -> np.ndarray:
    return mix(keys.view(np.uint64) ^ mix(turn.astype(np.uint64) * np.uint64(2) + missing.astype(np.uint64) + np.uint64(1)))


class _Shard:
    def __init__(self, width: int):
        self.width, self.keys, self.missing, self.ids, self.bytes = width, [], [], [], 0

    def add(self, key: int | None, ids: np.ndarray) -> None:
        self.keys.append(key or 0)
        self.missing.append(key is None)
        self.ids.append(ids)
        self.bytes += len(ids) * self.width

    def row(self, part: int, seq: int, before: int) -> dict:
        keys, missing = np.array(self.keys, np.int64), np.array(self.missing)
        lengths = np.array([len(x) for x in self.ids], np.int64)
        h = _hashes(keys, missing)
        index = PerfectHash(h)
        slots = np.zeros(len(keys), _SLOT)
        at = index.slots(h)
        slots["fingerprint"][at] = _fingerprint(h)
        slots["offset"][at] = np.cumsum(lengths) - lengths
        slots["length"][at] = lengths
        known = keys[~missing]
        return {
            "part": part, "seq": seq, "before": before, "n_ids": int(lengths.sum()), "n_docs": len(keys),
            "first": int(known[0]) if len(known) else None, "last": int(known[-1]) if len(known) else None, "width": self.width,
            "keys": keys.astype("<i8").tobytes(), "missing": np.packbits(missing).tobytes(), "index": index.to_bytes(),
            "slots": slots.tobytes(), "payload": np.concatenate(self.ids).astype(f"<u{self.width}").tobytes(),
        }


def _fingerprint(h: np.ndarray) -> np.ndarray:
    return (mix(h + np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def write(docs: DataFrame, tokenizer_path: str, end_id: int | None = 0, path: str | None = None) -> str:
    """Writes the ids of docs(doc_id, text) in ascending doc_id order (null ids first); the folder's path.

    Each document ends with end_id (None: nothing is added). Null texts count as empty. Rows that
    repeat a doc_id are each written, in the order of their texts, and may lie in several shards; a
    document always lies in one.
    """
    spark = docs.sparkSession
    content = spark.sparkContext.broadcast(read_file(spark, tokenizer_path))
    kinds = spark.sparkContext.broadcast(library_kinds().tobytes())  # a megabyte
    path = path or f"{run_dir(spark)}/ids-{uuid.uuid4().hex}"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.substring("text", 1, 64).alias("begin"))
    # how texts begin parts the rows of one id, or of none, over several ranges
    rows = rows.repartitionByRange(shuffle_partitions(spark), "doc_id", "begin").sortWithinPartitions("doc_id", "text").drop("begin")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(content.value, kinds.value)
        width = 2 if max(encoder.size, (end_id or 0) + 1) <= 1 << 16 else 4
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        schema = pa.schema([(f.split()[0], {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[f.split()[1]]) for f in SCHEMA.split(", ")])
        shard = _Shard(width)

        def closed() -> pa.RecordBatch:
            nonlocal shard, seq, before
            row = shard.row(part, seq, before)
            seq, before, shard = seq + 1, before + row["n_ids"], _Shard(width)
            return pa.RecordBatch.from_pylist([row], schema)

        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                b = whole.slice(lo, 512)
                for key, ids in zip(b.column(0).to_pylist(), encoder.encode([t or "" for t in b.column(1).to_pylist()])):
                    shard.add(key, ids if end_id is None else np.append(ids, np.uint32(end_id)))
                    if shard.bytes >= SHARD_BYTES:
                        yield closed()
        if shard.keys:
            yield closed()

    rows.mapInArrow(run, SCHEMA).write.option("compression", "zstd").option("parquet.block.size", str(16 << 20)).parquet(path)
    return path


class Reader:
    """Keyed access to one shard: constant time from a key to its ids."""

    def __init__(self, row: dict):
        self.index = PerfectHash.from_bytes(row["index"])
        self.slots = np.frombuffer(row["slots"], _SLOT)
        self.ids = np.frombuffer(row["payload"], f"<u{row['width']}")
        self.keys = np.frombuffer(row["keys"], "<i8").astype(np.int64)
        self.missing = np.unpackbits(np.frombuffer(row["missing"], np.uint8))[: len(self.keys)].astype(bool)

    def places(self, h: np.ndarray) -> np.ndarray:
        """The slot of each key hash; -1 where the stored fingerprint says that the key isn't there."""
        at = self.index.slots(h)
        return np.where((at >= 0) & (self.slots["fingerprint"][np.maximum(at, 0)] == _fingerprint(h)), at, -1) if len(self.slots) else np.full(len(h), -1)

    def get(self, slot: int) -> np.ndarray:
        s = self.slots[slot]
        return self.ids[int(s["offset"]) : int(s["offset"]) + int(s["length"])]


def _starts(files: DataFrame) -> dict[int, int]:
    """Ids before each part; one number for each partition that was written."""
    totals = sorted(files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    out, at = {}, 0
    for part, n in totals:
        out[part], at = at, at + n
    return out


def summary(spark: SparkSession, path: str) -> DataFrame:
    """Of each document in the files, through its key: doc_id, start (ids before it), n_tokens and ids_crc32."""
    files = spark.read.schema(SCHEMA).parquet(path)
    starts = spark.sparkContext.broadcast(_starts(files))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in (x for i in range(b.num_rows) for x in b.slice(i, 1).to_pylist()):
                shard = Reader(row)
                at = shard.places(_hashes(shard.keys, shard.missing))
                base = starts.value[row["part"]] + row["before"]
                crc = [zlib.crc32(shard.get(s).astype("<u4").tobytes()) for s in at.tolist()]
                cols = [pa.array(shard.keys, mask=shard.missing), pa.array(base + shard.slots["offset"][at].astype(np.int64)), pa.array(shard.slots["length"][at].astype(np.int64)), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # a batch of shard rows is bounded by the shards' own size
    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def fetch(spark: SparkSession, path: str, keys: list[int]) -> DataFrame:
    """(doc_id, ids) of the keys that the files hold, the first of equal ids in each shard; only shards whose range holds a key are read."""
    files = spark.read.schema(SCHEMA).parquet(path)
    wanted = np.unique(np.array(keys, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in (x for i in range(b.num_rows) for x in b.slice(i, 1).to_pylist()):
                shard = Reader(row)
                near = wanted[(wanted >= row["first"]) & (wanted <= row["last"])]
                at = shard.places(key_hash(near, np.zeros(len(near)), np.zeros(len(near))))
                good = at >= 0
                ids = [shard.get(s).astype(np.int64).tolist() for s in at[good].tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(near[good]), pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "ids"])

    if not len(wanted):
        return spark.createDataFrame([], "doc_id long, ids array<long>")
    inside = files.where((F.col("last") >= int(wanted[0])) & (F.col("first") <= int(wanted[-1])))
    return inside.mapInArrow(run, "doc_id long, ids array<long>")
