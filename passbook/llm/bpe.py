"""Byte-level BPE by two tiers: a minimal perfect hash over the vocabulary, and merges by a heap over linked bytes.

A text is cut by the pretokenising pattern. A pre-token that is a vocabulary entry resolves in
the minimal perfect hash; any other is merged from single bytes, lowest rank first and leftmost
among equals, by a heap over a doubly linked list.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from passbook.llm import pretokens
from passbook.llm.common import spare, trimmed


class PerfectHash:
    """Minimal perfect hash of keys, given as distinct 64-bit hashes: keys that collide at a level go on to the next one.

    Each level is a bit array with two bits for each key left; a key alone on its bit is placed
    there, and its slot is the number of bits set before it. Keys that were not given may land
    on any slot, so callers compare what is stored there.
    """

    def __init__(self, left: np.ndarray):
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        if len(np.unique(left)) != len(left):
            raise ValueError("keys repeat")
        while len(left):
            size = 2 * len(left) + 1
            spot = self._spot(left, len(self.levels), size)
            alone = np.bincount(spot, minlength=size) == 1
            self._add(alone)
            left = left[~alone[spot]]

    def _add(self, alone: np.ndarray) -> None:
        base = self.levels[-1][2][-1] if self.levels else 0
        self.levels.append((len(alone), alone, base + np.concatenate([[0], np.cumsum(alone)])))

    def to_bytes(self) -> bytes:
        """Each level's count of bits as 4 bytes, then its bits."""
        return b"".join(size.to_bytes(4, "little") + np.packbits(alone).tobytes() for size, alone, _ in self.levels)

    @classmethod
    def from_bytes(cls, raw: bytes) -> PerfectHash:
        out, at = cls(np.zeros(0, np.uint64)), 0
        while at < len(raw):
            size = int.from_bytes(raw[at : at + 4], "little")
            end = at + 4 + (size + 7) // 8
            out._add(np.unpackbits(np.frombuffer(raw[at + 4 : end], np.uint8))[:size].astype(bool))
            at = end
        return out

    @staticmethod
    def _spot(h: np.ndarray, level: int, size: int) -> np.ndarray:
        h = (h ^ np.uint64(level * 0x9E3779B97F4A7C15 & (2**64 - 1))) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
        return (h % np.uint64(size)).astype(np.int64)

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each xxh3_64 hash; -1 where no level has its bit."""
        out = np.full(len(hashes), -1, np.int64)
        open_ = np.arange(len(hashes))
        for level, (size, alone, before) in enumerate(self.levels):
            if not len(open_):
                break
            spot = self._spot(hashes[open_], level, size)
            hit = alone[spot]
            out[open_[hit]] = before[spot[hit]]
            open_ = open_[~hit]
        return out


def read_ranks(content: bytes) -> dict[bytes, int]:
    """The ranks of a tiktoken vocabulary file."""
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in content.splitlines() if x.strip())}


def pair_ranks(ranks: dict[bytes, int]) -> dict[int, int]:
    """For each two ids (the first times 2**32, plus the second) whose bytes together are an entry: its rank."""
    out = {}
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
            if a is not None and b is not None:
                out[a << 32 | b] = rank
    return out


def merge(ids: list[int], pairs: dict[int, int]) -> tuple[int, ...]:
    """Merges a pre-token's byte ids: always the pair of lowest rank first, the leftmost among equals."""
    n = len(ids)
    rank = [pairs.get(a << 32 | b, -1) for a, b in zip(ids, ids[1:])] + [-1]
    heap = [r << 32 | i for i, r in enumerate(rank) if r >= 0]
    if not heap:
        return tuple(ids)
    heapify(heap)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while heap:
        x = heappop(heap)
        i = x & 0xFFFFFFFF
        r = x >> 32
        if rank[i] != r:
            continue  # one of the two parts has changed since
        j = after[i]
        k = after[j]
        ids[i], ids[j], rank[j], after[i] = r, -1, -1, k
        if k < n:
            before[k] = i
            rank[i] = new = pairs.get(r << 32 | ids[k], -1)
            if new >= 0:
                heappush(heap, new << 32 | i)
        else:
            rank[i] = -1
        h = before[i]
        if h >= 0:
            rank[h] = new = pairs.get(ids[h] << 32 | r, -1)
            if new >= 0:
                heappush(heap, new << 32 | h)
    return tuple([i for i in ids if i >= 0])


@lru_cache(maxsize=1)
def library_kinds() -> np.ndarray:
    """The kind of each code point by the tiktoken library's own patterns."""
    import tiktoken

    def matches(pattern: str, text: str) -> str:
        # what a pattern leaves out of a text, the library leaves out of its ids
        of = tiktoken.Encoding("kinds", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        return bytes(of.encode_ordinary(text)).decode()

    return pretokens.kinds(matches)


class Codec:
    """Encodes and decodes with one vocabulary; holds the perfect hash and a bounded memory of resolved pre-tokens.

    Pre-tokens of pretokens.PATTERN are split as the tiktoken library splits them; those of other patterns by the
    regex module, whose version of Unicode may differ.
    """

    def __init__(self, vocabulary: bytes, pattern: str):
        ranks = read_ranks(vocabulary)
        tokens = list(ranks)
        hashes = np.array([xxhash.xxh3_64_intdigest(t) for t in tokens], np.uint64)
        self.table = PerfectHash(hashes)
        slot = self.table.slots(hashes)
        self.entry: list[bytes] = [b""] * len(tokens)
        self.id_at: list[int] = [0] * len(tokens)
        for t, s in zip(tokens, slot.tolist()):
            self.entry[s], self.id_at[s] = t, ranks[t]
        self.pairs = pair_ranks(ranks)
        self.byte = [ranks[bytes([i])] for i in range(256)]
        most = max(ranks.values()) + 1
        #: Of each id its bytes, and its number in decimal.
        self.token: list[bytes] = [b""] * most
        for t, i in ranks.items():
            self.token[i] = t
        self.decimal = [b"%d" % i for i in range(most)]
        self.memory = pretokens.Memory(library_kinds(), self._resolve) if pattern == pretokens.PATTERN else None
        self.split = regex.compile(pattern).findall

    def _resolve(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens: by the perfect hash if they are entries, else by merges."""
        raw = [p.encode() for p in pieces]
        slots = self.table.slots(np.array([xxhash.xxh3_64_intdigest(p) for p in raw], np.uint64)).tolist()
        entry, id_at, pairs, byte = self.entry, self.id_at, self.pairs, self.byte
        found = [(id_at[s],) if s >= 0 and entry[s] == p else merge([byte[x] for x in p], pairs) for p, s in zip(raw, slots)]
        return np.fromiter(chain.from_iterable(found), np.uint32), np.array([len(x) for x in found], np.int64)

    def encode_all(self, texts: list[str]) -> Iterator[np.ndarray]:
        if self.memory:
            yield from self.memory.encode(texts)
        else:
            for t in texts:
                yield self._resolve(self.split(t))[0]

    def encode(self, text: str) -> list[int]:
        return next(self.encode_all([text])).tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


@lru_cache(maxsize=2)
def _codec(vocabulary: bytes, pattern: str) -> Codec:
    return Codec(vocabulary, pattern)


OUT = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())])


def read_file(spark: SparkSession, path: str) -> bytes:
    """A vocabulary file (about a megabyte), by Spark's own reader if the driver can't open it."""
    try:
        with open(path, "rb") as f:
            return f.read()
    except OSError:
        return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def encode_texts(docs: DataFrame, vocabulary_path: str, pattern: str, digest: bool = False, keep: list[str] | None = None) -> DataFrame:
    """docs with ids array<int> and decoded binary, or with digest n_tokens, ids_sha256 and decoded_sha256 instead.

    A null text counts as empty; empty texts have no ids. Columns of docs stay (keep: only these);
    a column of docs with the name of a new one is dropped. The vocabulary (a fixed file of about
    a megabyte) travels with the tasks.
    """
    spark = docs.sparkSession
    vocabulary = spark.sparkContext.broadcast(read_file(spark, vocabulary_path))
    new = ["n_tokens long", "ids_sha256 string", "decoded_sha256 string"] if digest else ["ids array<int>", "decoded binary"]
    names = {x.split()[0] for x in new}
    own = [c for c in (keep if keep is not None else docs.columns) if c.lower() not in names]
    (at,) = ["text"] if "text" in own else spare(own, "body")
    src = docs.select(*own, *([] if "text" in own else [docs["text"].alias(at)]))
    schema = T.StructType([src.schema[c] for c in own] + [f for x in new for f in T._parse_datatype_string(x).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(vocabulary.value, pattern)
        sha = hashlib.sha256
        for whole in batches:
            for lo in range(0, max(whole.num_rows, 1), 512):
                b = whole.slice(lo, 512)
                found = codec.encode_all([t or "" for t in b.column(at).to_pylist()])
                if digest:
                    made: list[list] = [[], [], []]
                    for ids in found:
                        x = ids.tolist()
                        made[0].append(len(x))
                        made[1].append(sha(b",".join(map(codec.decimal.__getitem__, x))).hexdigest())
                        made[2].append(sha(codec.decode(x)).hexdigest())
                    cols = [pa.array(c, t) for c, t in zip(made, (pa.int64(), pa.string(), pa.string()))]
                else:
                    flat = list(found)
                    offsets = np.cumsum([0, *map(len, flat)])
                    values = pa.array(np.concatenate([*flat, np.zeros(0, np.uint32)]).astype(np.int32))
                    cols = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values), pa.array([codec.decode(x.tolist()) for x in flat], pa.binary())]
                yield pa.RecordBatch.from_arrays([b.column(c) for c in own] + cols, names=schema.names)

    return src.mapInArrow(trimmed(run), schema)
