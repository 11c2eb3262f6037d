"""Cross-tokenizer alignment: two tokenizers' tokens meet on the bytes of a text, and pairs of ids are counted over the corpus.

Two tokens link where their bytes overlap. A task aligns its documents block by block; a block's
records (pair of ids, document, links) are sorted side-major, that is by B's id and then A's, dealt
into radices of B's id, and kept as zstd-compressed runs in the shared folder. Runs of one radix meet
in a k-way heap merge that sums each pair; where they are too many for one task, groups of runs are
merged first, so a pair that every document holds costs one record a run. In side-major order all pairs
of a B id come together, so its maximum is known when they end. Then each run meets its radix's
counts once more and gives back what they add to its documents: one packed array for each block and radix.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passbook.llm import pretokens
from passbook.llm.bpe import read_file
from passbook.llm.common import stored, written
from passbook.llm.tokenfile import Encoder, library_kinds

#: Bytes of texts that are aligned at once; links and documents of a block: bound memory, never results.
CHUNK, BLOCK_LINKS, BLOCK_DOCS = 1 << 18, 1 << 21, 1 << 15
#: B's ids are dealt into so many radices; pairs of a slice of a run; compressed bytes of runs that one task merges.
RADICES, SLICE, MERGE_BYTES = 64, 4096, 24 << 20
#: Bits of a document's number in its block.
_DOC_BITS = 15
#: sentencepiece writes a space so.
_SPACE = "▁"


# --- tokens and their bytes ------------------------------------------------------------------------


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level entry stands for: itself where it prints in Latin-1, else the next free one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteLevel:
    """Ids of a byte-level tokenizer and each id's bytes; special tokens' strings are plain text."""

    def __init__(self, content: bytes, kinds: bytes | None = None):
        self.encoder = Encoder(content, kinds, plain=True)
        vocabulary, byte_of = self.encoder.library.get_vocab(with_added_tokens=True), _byte_of()
        self.size = max(vocabulary.values()) + 1
        self.token = [b""] * self.size
        for entry, i in vocabulary.items():
            self.token[i] = bytes(byte_of[c] for c in entry) if all(c in byte_of for c in entry) else entry.encode()

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        return self.encoder.encode(texts)


class _Words(pretokens.Memory):
    """Runs of spaces with what follows them: no piece reaches beyond, if none holds a space after another sign."""

    cut = re.compile(f"(?<=[^ {_SPACE}]) ")

    def __init__(self, learn: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]):
        super().__init__(np.zeros(0, np.uint8), learn)

    def split(self, points: np.ndarray, ends: np.ndarray) -> np.ndarray:
        blank = (points == 0x20) | (points == ord(_SPACE))
        begin = blank & ~np.r_[False, blank[:-1]]
        begin[0] = True
        begin[ends[ends < len(points)]] = True
        return np.flatnonzero(begin)


class Pieces:
    """Ids of a sentencepiece model and each id's bytes.

    Words are encoded once for as long as they are remembered, which gives the ids of whole texts
    where the model doesn't normalise and no piece holds a space after another sign; a model for which that
    doesn't hold gets whole texts.
    """

    def __init__(self, content: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=content)
        self.size = self.library.get_piece_size()
        pieces = [self.library.id_to_piece(i) for i in range(self.size)]
        self.token = [bytes([int(p[3:5], 16)]) if self.library.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.space = self.library.piece_to_id(_SPACE)
        probe = "".join(map(chr, [*range(1, 0xD800), *range(0xE000, 0x110000)])) + "é  a 가 "
        kept = self.library.normalize(probe) == _SPACE + probe.replace(" ", _SPACE)
        self.apart = kept and not any(_SPACE in p.lstrip(_SPACE) for p in pieces) and pieces[self.space] == _SPACE
        self.memory = _Words(self._learn)

    def _learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # the library puts a space before each text, so a word's own first one is taken off; it gives an empty text no ids
        found = self.library.encode([w[1:] for w in words], num_threads=1)
        found = [f if len(w) > 1 else [self.space] for w, f in zip(words, found)]
        return np.array([i for f in found for i in f], np.uint32), np.array([len(f) for f in found], np.int64)

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text that a space begins; the library gets the text without it."""
        if self.apart:
            yield from self.memory.encode(texts)
        else:
            for ids in self.library.encode([t[1:] for t in texts], num_threads=1):
                yield np.array(ids, np.uint32)


class Aligner:
    """Aligns texts of two tokenizers, given as their ids and the bytes of each id."""

    def __init__(self, a: ByteLevel, b: Pieces):
        self.a, self.b = a, b
        self.a_length, self.b_length = (np.array([len(t) for t in x.token], np.int64) for x in (a, b))
        # a token's number and what follows it: another one of its side in the group, the other side, the next group
        self.word = [x for i in range(a.size) for x in (b"%d," % i, b"%d|" % i)] + [x for i in range(b.size) for x in (b"%d," % i, b"%d;" % i)]
        self.a_bits, self.b_bits = (max(1, (x.size - 1).bit_length()) for x in (a, b))
        if self.a_bits + self.b_bits + _DOC_BITS + RADICES.bit_length() > 63:
            raise ValueError("the vocabularies are too large for keys of 63 bits")

    def key(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Side-major keys of pairs: B's radix, B's id, A's id."""
        b = b.astype(np.int64)
        return ((b % RADICES) << self.b_bits | b) << self.a_bits | a.astype(np.int64)

    def align(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """(n_a, n_b, n_groups, n_links) of each text; its groups; and the text and the pair's key of each link.

        Texts without tokens, and those whose joined tokens aren't a space and the text, have none of them.
        """
        stats, groups = np.zeros((len(texts), 4), np.int64), [""] * len(texts)
        none = np.zeros(0, np.int64)
        full = [i for i, t in enumerate(texts) if t]
        spaced = [" " + texts[i] for i in full]
        row, a, b, sizes = [], [], [], []
        for i, t, x, y in zip(full, spaced, self.a.encode(spaced), self.b.encode(spaced)):
            raw = t.encode()
            if b"".join(map(self.a.token.__getitem__, x.tolist())) == raw and b"".join(map(self.b.token.__getitem__, y.tolist())) == raw:
                row.append(i)
                a.append(x)
                b.append(y)
                sizes.append(len(raw))
        if not row:
            return stats, groups, none, none
        row = np.array(row)
        n_a, n_b = (np.array([len(x) for x in side], np.int64) for side in (a, b))
        a, b = np.concatenate(a).astype(np.int64), np.concatenate(b).astype(np.int64)
        # texts side by side; both sides' tokens end at the same byte of each text
        total = sum(sizes)
        a_end, b_end = np.zeros(total + 1, bool), np.zeros(total + 1, bool)
        a_end[np.cumsum(self.a_length[a])] = True
        b_end[np.cumsum(self.b_length[b])] = True
        cut = np.flatnonzero(a_end | b_end)
        at_a, at_b = a_end[cut], b_end[cut]
        both = at_a & at_b
        # between two cuts lies the overlap of one token of A with one of B: a link
        text = np.searchsorted(np.cumsum(sizes), cut, side="left")
        link_a, link_b = a[np.cumsum(at_a) - at_a], b[np.cumsum(at_b) - at_b]
        stats[row] = np.stack([n_a, n_b, np.bincount(text[both], minlength=len(row)), np.bincount(text, minlength=len(row))], axis=1)
        group = np.cumsum(both) - both
        of_a, of_b = group[at_a], group[at_b]
        words = np.zeros(len(a) + len(b), np.int64)
        words[np.arange(len(a)) + np.searchsorted(of_b, of_a, side="left")] = 2 * a + both[at_a]
        words[np.arange(len(b)) + np.searchsorted(of_a, of_b, side="right")] = 2 * self.a.size + 2 * b + both[at_b]
        words = list(map(self.word.__getitem__, words.tolist()))
        end = np.cumsum(n_a + n_b).tolist()
        for i, lo, hi in zip(row.tolist(), [0, *end], end):
            groups[i] = b"".join(words[lo:hi])[:-1].decode()
        return stats, groups, row[text], self.key(link_a, link_b)


@lru_cache(maxsize=1)
def _aligner(a: bytes, kinds: bytes, b: bytes) -> Aligner:
    return Aligner(ByteLevel(a, kinds), Pieces(b))


# --- runs ---------------------------------------------------------------------------------------------


def _packed(x: np.ndarray) -> bytes:
    """Numbers by planes of their bytes, compressed."""
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes(), 1)


def _unpacked(raw: bytes, kind: str) -> np.ndarray:
    kind = np.dtype(kind)
    planes = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(kind.itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def pack_run(keys: np.ndarray, counts: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """A run's sorted keys (each slice's first, then differences) and their counts, slice by slice."""
    out: tuple[list, list] = ([], [])
    for lo in range(0, len(keys), SLICE):
        part = keys[lo : lo + SLICE]
        out[0].append(_packed(np.diff(part, prepend=0)))
        out[1].append(_packed(counts[lo : lo + SLICE].astype(np.int64)))
    return out


def open_run(keys: list[bytes], counts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for k, c in zip(keys, counts):
        yield np.cumsum(_unpacked(k, "<i8")), _unpacked(c, "<i8")


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(counts, first)


def merge_runs(runs: list[Iterator[tuple[np.ndarray, np.ndarray]]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """K-way merge of sorted runs: each key once, with the sum of its counts. One slice of each run is open.

    One heap has the runs by their next key, another by the last key of their open slice; the least of
    those bounds what can be given out.
    """
    open_: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    heads: list[tuple[int, int]] = []
    lasts: list[tuple[int, int]] = []

    def load(i: int) -> None:
        found = next(runs[i], None)
        if found is not None:
            open_[i] = found
            heappush(heads, (int(found[0][0]), i))
            heappush(lasts, (int(found[0][-1]), i))

    for i in range(len(runs)):
        load(i)
    while heads:
        bound = lasts[0][0]
        while lasts and lasts[0][0] <= bound:
            heappop(lasts)
        parts, over = [], []
        while heads and heads[0][0] <= bound:
            i = heappop(heads)[1]
            keys, counts = open_[i]
            to = int(np.searchsorted(keys, bound, side="right"))
            parts.append((keys[:to], counts[:to]))
            if to < len(keys):
                open_[i] = keys[to:], counts[to:]
                over.append(i)
            else:
                load(i)
                # a slice begins above its run's last one, and so above the bound
        for i in over:
            heappush(heads, (int(open_[i][0][0]), i))
        yield _summed(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))


class _Block:
    """Records of some documents: the pair's key with the document's number below it, and how many links."""

    def __init__(self, number: int):
        self.number, self.docs, self.links, self.parts = number, 0, 0, []

    def add(self, text: np.ndarray, key: np.ndarray, docs: int) -> None:
        found, n = np.unique(key << _DOC_BITS | (text + self.docs), return_counts=True)
        self.parts.append((found, n))
        self.docs += docs
        self.links += len(found)

    def runs(self, a_bits: int, b_bits: int) -> Iterator[tuple]:
        """(radix, keys, totals, docs, held): of each radix the run of pairs and their sums, and how many of which documents hold each."""
        if not self.parts or not self.links:
            return
        record, n = _summed(np.concatenate([r for r, _ in self.parts]), np.concatenate([c for _, c in self.parts]))
        key, doc = record >> _DOC_BITS, (record & ((1 << _DOC_BITS) - 1)).astype(np.uint16)
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        pairs, totals, times = key[first], np.add.reduceat(n, first), np.diff(np.r_[first, len(key)])
        radix = pairs >> (a_bits + b_bits)
        for r in np.unique(radix).tolist():
            lo, hi = np.searchsorted(radix, [r, r + 1]).tolist()
            s, e = int(first[lo]), int(first[hi]) if hi < len(first) else len(key)
            keys, counts = pack_run(pairs[lo:hi], totals[lo:hi])
            held = [_packed(times[lo:hi].astype("<u4")), _packed(doc[s:e].astype("<u2")), _packed(n[s:e].astype("<u4"))]
            yield r, keys, counts, self.docs, held


_RUN = "radix int, block long, docs int, keys array<binary>, totals array<binary>, held array<binary>"
_STATS = ("n_a", "n_b", "n_groups", "n_links")


def _runs(docs: DataFrame, a_path: str, b_path: str, digest: bool) -> tuple[DataFrame, DataFrame, Aligner]:
    """(rows, runs): of each row of docs its own columns in a struct, block and number in it, counts and groups; and the blocks' runs."""
    spark = docs.sparkSession
    content = [spark.sparkContext.broadcast(x) for x in (read_file(spark, a_path), library_kinds().tobytes(), read_file(spark, b_path))]
    others = [c for c in docs.columns if c != "text"] or [F.lit(None).cast("int").alias("none")]
    src = docs.select(F.struct(*others).alias("own"), "text")
    made = T._parse_datatype_string(f"number int, {', '.join(f'{c} long' for c in _STATS)}, groups string, {_RUN}")
    schema = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("own", src.schema["own"].dataType), *made.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(*(c.value for c in content))
        part, blocks = TaskContext.get().partitionId(), 0
        block = _Block(part << 32)
        shape = None

        def of_runs() -> Iterator[pa.RecordBatch]:
            nonlocal block, blocks
            for r, keys, totals, n, held in block.runs(aligner.a_bits, aligner.b_bits):
                given = {"kind": 1, "radix": r, "block": block.number, "docs": n, "keys": keys, "totals": totals, "held": held}
                yield pa.RecordBatch.from_pylist([given], shape)
            blocks += 1
            block = _Block(part << 32 | blocks)

        for whole in batches:
            if shape is None:
                several = pa.list_(pa.binary())
                shape = pa.schema([("kind", pa.int32()), ("own", whole.schema.field(0).type), ("number", pa.int32()), *((c, pa.int64()) for c in _STATS), ("groups", pa.string()), ("radix", pa.int32()), ("block", pa.int64()), ("docs", pa.int32()), ("keys", several), ("totals", several), ("held", several)])
            lengths = np.cumsum([len(t) for t in whole.column(1).cast(pa.binary()).fill_null(b"").to_pylist()])
            lo = 0
            while lo < whole.num_rows:
                # as many rows as make a chunk, one at least
                before = int(lengths[lo - 1]) if lo else 0
                hi = min(max(lo + 1, int(np.searchsorted(lengths, before + CHUNK))), lo + 1024, whole.num_rows)
                b = whole.slice(lo, hi - lo)
                stats, groups, text, key = aligner.align(b.column(1).to_pylist())
                if digest:
                    groups = [g and hashlib.sha256(g.encode()).hexdigest() for g in groups]
                n = b.num_rows
                empty = [pa.nulls(n, shape.field(c).type) for c in ("docs", "keys", "totals", "held")]
                cols = [pa.array(np.zeros(n, np.int32)), b.column(0), pa.array(np.arange(block.docs, block.docs + n, dtype=np.int32)), *(pa.array(stats[:, i].copy()) for i in range(4)), pa.array(groups, pa.string()), pa.nulls(n, pa.int32()), pa.array(np.full(n, block.number)), *empty]
                yield pa.RecordBatch.from_arrays(cols, schema=shape)
                block.add(text, key, n)
                if block.links >= BLOCK_LINKS or block.docs + 1024 > BLOCK_DOCS:
                    yield from of_runs()
                lo = hi
        if block.docs:
            yield from of_runs()

    path = written(src.mapInArrow(run, schema), "aligned", ("kind",))
    both = spark.read.schema(schema).parquet(path)
    rows = both.where("kind = 0").select("own", "block", "number", *_STATS, "groups")
    return rows, both.where("kind = 1").select(*(x.split()[0] for x in _RUN.split(", "))), _aligner(*(c.value for c in content))


def _sizes(runs: DataFrame) -> dict[int, int]:
    """Compressed bytes of each radix's runs."""
    size = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + F.length(x))
    return {r.radix: r.size for r in runs.groupBy("radix").agg(F.sum(size("keys") + size("totals")).alias("size")).collect()}


def _salted(runs: DataFrame, sizes: dict[int, int], by: str) -> DataFrame:
    """runs with a salt: a radix has as many as make its groups fit one task."""
    salts = F.lit([max(1, -(-sizes.get(r, 0) // MERGE_BYTES)) for r in range(RADICES)])
    return runs.withColumn("salt", F.pmod(F.xxhash64(by), F.get(salts, F.col("radix"))).cast("int"))


def _merged(runs: DataFrame) -> DataFrame:
    """One run for each (radix, salt)."""

    def run(table: pa.Table) -> pa.Table:
        held = [open_run(k.as_py(), t.as_py()) for k, t in zip(table.column("keys"), table.column("totals"))]
        keys, totals, rest = [], [], (np.zeros(0, np.int64), np.zeros(0, np.int64))
        for k, c in merge_runs(held):
            rest = np.concatenate([rest[0], k]), np.concatenate([rest[1], c])
            to = len(rest[0]) // SLICE * SLICE
            for out, packed in zip((keys, totals), pack_run(rest[0][:to], rest[1][:to])):
                out += packed
            rest = rest[0][to:], rest[1][to:]
        for out, packed in zip((keys, totals), pack_run(*rest)):
            out += packed
        return pa.table([pa.array([table.column("radix")[0].as_py()], pa.int32()), pa.array([table.column("block")[0].as_py()]), pa.array([keys], pa.list_(pa.binary())), pa.array([totals], pa.list_(pa.binary()))], names=["radix", "block", "keys", "totals"])

    return runs.select("radix", "salt", "block", "keys", "totals").groupBy("radix", "salt").applyInArrow(run, "radix int, block long, keys array<binary>, totals array<binary>")


def _best(keys: np.ndarray, totals: np.ndarray, a_bits: int) -> np.ndarray:
    """Whether each pair's count is the highest of its B id; keys are sorted, so an id's pairs lie together."""
    b = keys >> a_bits
    first = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
    return totals == np.repeat(np.maximum.reduceat(totals, first), np.diff(np.r_[first, len(b)]))


def _counts(runs: DataFrame) -> DataFrame:
    """(radix, keys, totals): one run of each radix, with every pair's count over the corpus."""
    now, before = runs, None
    while True:
        sizes = _sizes(now)
        most = max(sizes.values(), default=0)
        if most <= MERGE_BYTES or (before and sum(sizes.values()) > 0.7 * before):
            break  # it fits one task, or what is left are distinct pairs, which the vocabularies bound
        before = sum(sizes.values())
        now = stored(_merged(_salted(now, sizes, "block")), "merged")
    return stored(_merged(now.withColumn("salt", F.lit(0))), "counts")


def aligned(docs: DataFrame, a_path: str, b_path: str, digest: bool = False) -> DataFrame:
    """docs(text, ...): its other columns, n_a, n_b, n_groups, groups, n_links, n_best and count_sum of each row.

    A: a byte-level tokenizer over a space and the text; B: a sentencepiece model over the text. Byte
    offsets where tokens of both end cut them into groups, written `a1,a2|b1;a3|b2,b3`. A link is a pair of
    tokens whose bytes overlap; a pair of ids counts the links that hold it in all rows. n_best: links whose
    count is the highest of their B id (ties included); count_sum: the counts of all links, added up.
    Null and empty texts, and texts that either side's tokens don't spell, have zeros and ''. With digest,
    groups_sha256 stands for groups ('' stays). Rows that repeat count each. Columns named like a new one are replaced.
    A task holds one block's records and one row's tokens.
    """
    new = ["n_a", "n_b", "n_groups", "groups_sha256" if digest else "groups", "n_links", "n_best", "count_sum"]
    docs = docs.select(*(c for c in docs.columns if c.lower() not in new))
    rows, runs, aligner = _runs(docs, a_path, b_path, digest)
    a_bits = aligner.a_bits
    counts = _counts(runs)
    # the runs' other part, by which salts are dealt, is about as large as its records
    held = F.aggregate("held", F.lit(0).cast("long"), lambda s, x: s + F.length(x))
    sizes = {r.radix: r.size for r in runs.groupBy("radix").agg(F.sum(held).alias("size")).collect()}
    salts = F.lit([max(1, -(-sizes.get(r, 0) // MERGE_BYTES)) for r in range(RADICES)])
    dealt = _salted(runs, sizes, "block")
    copies = counts.select("radix", F.explode(F.sequence(F.lit(0), F.get(salts, F.col("radix")) - 1)).alias("salt"), F.lit(None).cast("long").alias("block"), F.lit(None).cast("int").alias("docs"), "keys", "totals", F.lit(None).cast("array<binary>").alias("held"))
    both = dealt.drop("totals").withColumn("totals", F.lit(None).cast("array<binary>")).unionByName(copies)

    def back(table: pa.Table) -> pa.Table:
        known = [i for i, b in enumerate(table.column("block").to_pylist()) if b is None][0]
        keys, totals = (np.concatenate(x) for x in zip(*open_run(table.column("keys")[known].as_py(), table.column("totals")[known].as_py())))
        best = _best(keys, totals, a_bits)
        out: list[list] = [[], [], []]
        for i in range(table.num_rows):
            if i == known:
                continue
            own = np.concatenate([np.cumsum(_unpacked(k, "<i8")) for k in table.column("keys")[i].as_py()])
            times, doc, n = (_unpacked(x, k) for x, k in zip(table.column("held")[i].as_py(), ("<u4", "<u2", "<u4")))
            at = np.repeat(np.searchsorted(keys, own), times)
            n, size = n.astype(np.int64), table.column("docs")[i].as_py()
            sums, hits = np.zeros(size, np.int64), np.zeros(size, np.int64)
            np.add.at(sums, doc, n * totals[at])
            np.add.at(hits, doc, n * best[at])
            for c, v in zip(out, (table.column("block")[i].as_py(), _packed(sums), _packed(hits))):
                c.append(v)
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())], names=["block", "sums", "hits"])

    added = both.groupBy("radix", "salt").applyInArrow(back, "block long, sums binary, hits binary")

    def total(table: pa.Table) -> pa.Table:
        sums, hits = (sum(_unpacked(x, "<i8") for x in table.column(c).to_pylist()) for c in ("sums", "hits"))
        return pa.table([pa.array(np.full(len(sums), table.column("block")[0].as_py())), pa.array(np.arange(len(sums), dtype=np.int32)), pa.array(hits), pa.array(sums)], names=["block", "number", "n_best", "count_sum"])

    each = added.groupBy("block").applyInArrow(total, "block long, number int, n_best long, count_sum long")
    out = rows.join(each.hint("shuffle_hash"), ["block", "number"], "left")
    zero = F.lit(0).cast("long")
    return out.select("own.*", "n_a", "n_b", "n_groups", F.col("groups").alias(new[3]), "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"))


def pair_counts(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(b, a, count, best): of every pair of ids that a link in docs(text, ...) holds, how many do, and whether that is the highest count of b."""
    _, runs, aligner = _runs(docs.select("text"), a_path, b_path, True)
    a_bits, b_bits = aligner.a_bits, aligner.b_bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, t in zip(b.column(1), b.column(2)):
                keys, totals = (np.concatenate(x) for x in zip(*open_run(k.as_py(), t.as_py())))
                cols = [keys >> a_bits & ((1 << b_bits) - 1), keys & ((1 << a_bits) - 1), totals, _best(keys, totals, a_bits)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["b", "a", "count", "best"])

    return _counts(runs).select("radix", "keys", "totals").mapInArrow(run, "b long, a long, count long, best boolean")
