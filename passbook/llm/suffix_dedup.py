"""Suffix-array dedup: removes every byte that lies in a string of `window` bytes that starts more than once.

Suffix arrays of a whole corpus would not fit a shard, nor could shards be merged pairwise. So
anchors sieve first: a window's anchor is its `gram`-byte substring of least hash. Equal windows
have equal anchors at equal places, so a window whose anchor starts only once can't repeat. The
run of windows of one anchor is a segment. Segments with equal bytes repeat as wholes; the
distinct segments of an anchor that has several go to one shard, where a suffix array
(Larsson-Sadakane refinement) and common prefixes (Kasai) find the windows that repeat. An
anchor with more than `hot` distinct segments is spread over the shards; then each shard's sorted
windows are merged by ranges, with binary search in the others' lists.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passbook.llm.common import apart, spare, stored, trimmed
from passbook.llm.words import mix, powers, prefix_sums

#: Bytes of text hashed at once; window starts of one call stay below 2**20.
CHUNK = 1 << 17
#: A suffix array takes less than this: a rank pair and a position share 63 bits.
MOST = 1 << 21


@dataclass(frozen=True)
class Repeats:
    """window: bytes of a repeated string; gram: bytes of an anchor; hot: distinct segments of an anchor in one shard."""

    window: int = 200
    gram: int = 48
    hot: int = 500
    shard_bytes: int = 1 << 20

    def __post_init__(self):
        if not 1 <= self.gram <= self.window or self.window - self.gram + 1 > 256:
            raise ValueError("a segment has at most 256 starts: window - gram must be 0 to 255")


# --- anchors -----------------------------------------------------------------------------------


def _least(key: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbouring values."""
    span = 1
    while 2 * span <= width:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    return np.minimum(key[: len(key) - (width - span)], key[width - span :]) if width > span else key


def segments(data: np.ndarray, ends: np.ndarray, p: Repeats) -> tuple[np.ndarray, ...]:
    """Of texts side by side (ends: where each ends): (text, first start, last start, anchor, bytes' hash) of each segment."""
    n = len(data) - p.window + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    sums = prefix_sums(data)
    _, down = powers(len(data) + 1)
    grams = len(data) - p.gram + 1
    h = mix((sums[p.gram :] - sums[:-p.gram]) * down[:grams])
    low = np.uint64((1 << 20) - 1)
    key = _least((h & ~low) | np.arange(grams, dtype=np.uint64), p.window - p.gram + 1)
    anchor = (key & low).astype(np.int64)
    text = np.searchsorted(ends, np.arange(n), side="right")
    whole = np.arange(n) + p.window <= ends[text]
    start = np.flatnonzero(whole)
    if not len(start):
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    a = anchor[start]
    cut = np.flatnonzero(a[1:] != a[:-1]) + 1
    first, last = start[np.r_[0, cut]], start[np.r_[cut, len(start)] - 1]
    a = a[np.r_[0, cut]]
    stop = last + p.window
    own = (sums[stop] - sums[first]) * down[first]
    own = mix(own ^ mix((stop - first).astype(np.uint64) << np.uint64(20) | (a - first).astype(np.uint64)))
    return text[first], first, last, h[a], own


def _chunks(texts: list[bytes], p: Repeats) -> Iterator[tuple[list[int], list[int], bytes]]:
    """(text, offset in it) and the bytes of batches of texts; a long text comes in chunks that share window - 1 bytes."""
    ids, offsets, parts, size = [], [], [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - p.window + 1), CHUNK):
            part = t[at : at + CHUNK + p.window - 1]
            if len(part) < p.window:
                continue
            if size and size + len(part) > 2 * CHUNK:
                yield ids, offsets, parts
                ids, offsets, parts, size = [], [], [], 0
            ids.append(i)
            offsets.append(at)
            parts.append(part)
            size += len(part)
    if parts:
        yield ids, offsets, parts


#: A segment's place in its text: its first start, and in 8 bits its count of starts less one.
def _place(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    return first << 8 | count - 1


def _occurrences(docs: DataFrame, p: Repeats) -> DataFrame:
    """docs(doc_id, tag: hash of the text, text): (doc_id, tag, place, anchor, seg) of every segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                b = whole.slice(lo, 1024)
                doc, tag = b.column(0).to_numpy(), b.column(1).to_numpy()
                texts = b.column(2).cast(pa.binary()).to_pylist()
                for ids, offsets, parts in _chunks(texts, p):
                    ends = np.cumsum([len(x) for x in parts])
                    t, first, last, anchor, seg = segments(np.frombuffer(b"".join(parts), np.uint8), ends, p)
                    row, begin = np.array(ids)[t], np.array(offsets)[t] - np.r_[0, ends[:-1]][t]
                    cols = [doc[row], tag[row], _place(first + begin, last - first + 1), anchor.view(np.int64), seg.view(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["doc_id", "tag", "place", "anchor", "seg"])

    return docs.mapInArrow(trimmed(run), "doc_id long, tag long, place long, anchor long, seg long")


# --- suffix arrays -------------------------------------------------------------------------------


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Positions in the order of their suffixes, by Larsson-Sadakane refinement; fewer than 2**21 bytes.

    Starts from 5-byte prefixes; each round sorts only groups that are not yet settled, by the rank
    of the position as far ahead as is sorted.
    """
    n = len(data)
    if n >= MOST:
        raise ValueError("too long for one suffix array")
    low = np.uint64(MOST - 1)
    padded = np.zeros(n + 4, np.uint64)
    padded[:n] = data
    key = np.zeros(n, np.uint64)
    for j in range(5):
        key = key << np.uint64(8) | padded[j : j + n]
    key = np.sort(key << np.uint64(21) | np.arange(n, dtype=np.uint64))
    sa = (key & low).astype(np.int64)
    new = np.r_[True, key[1:] >> np.uint64(21) != key[:-1] >> np.uint64(21)]
    ranks = np.zeros(n + 1, np.uint64)  # of a group: the place of its first member, from 1
    place = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    ranks[sa] = place + 1
    reach = 5
    while True:
        alone = new & np.r_[new[1:], True]
        open_ = np.flatnonzero(~alone)
        if not len(open_):
            break
        at = sa[open_]
        ahead = ranks[np.minimum(at + reach, n)]
        key = np.sort(ranks[at] << np.uint64(42) | ahead << np.uint64(21) | at.astype(np.uint64))
        at = (key & low).astype(np.int64)
        sa[open_] = at
        fresh = np.r_[True, key[1:] >> np.uint64(21) != key[:-1] >> np.uint64(21)]
        new[open_] |= fresh
        ranks[at] = np.maximum.accumulate(np.where(fresh, open_, 0)) + 1
        reach *= 2
    return sa


def common_prefixes(data: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """For each place in sa the bytes (up to `most`) shared with the place before: Kasai's walk, in many lanes at once.

    A lane walks neighbouring positions of the text; what one shares less a byte is where the next begins.
    """
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = data
    words = np.lib.stride_tricks.as_strided(padded, (n + 1, 8), (1, 1))
    words = np.ascontiguousarray(words).view("<u8").ravel()
    step = max(1, min(n, 512))
    lanes = np.arange(0, n, step)
    shared, h = np.zeros(n, np.int64), np.zeros(len(lanes), np.int64)
    for k in range(step):
        i = lanes[: int(np.searchsorted(lanes, n - k))] + k
        j = before[i]
        g = np.maximum(h[: len(i)] - 1, 0)
        g[j < 0] = 0
        open_ = np.flatnonzero((j >= 0) & (g < most))
        while len(open_):
            a, b = i[open_] + g[open_], j[open_] + g[open_]
            inside = (a < n) & (b < n)
            open_, a, b = open_[inside], a[inside], b[inside]
            diff = words[a] ^ words[b]
            same = diff == 0
            low = diff & (~diff + np.uint64(1))  # the least bit that differs
            gain = np.where(same, 8, np.log2(np.where(same, 1, low).astype(np.float64)).astype(np.int64) >> 3)
            gain = np.minimum(gain, n - np.maximum(a, b))
            g[open_] += gain
            open_ = open_[same & (g[open_] < most)]
        h[: len(i)] = g
        shared[i] = g
    out = np.minimum(shared[sa], most)
    out[0] = 0
    return out


def repeated(parts: list[bytes], p: Repeats) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each window start in distinct segments: (segment, start, class of equal windows), in suffix order."""
    data = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.array([len(x) for x in parts])
    sa = suffix_array(data)
    lcp = common_prefixes(data, sa, p.window)
    group = np.cumsum(lcp < p.window)
    ends = np.cumsum(sizes)
    part = np.searchsorted(ends, sa, side="right")
    start = sa - (ends - sizes)[part]
    good = start + p.window <= sizes[part]
    return part[good], start[good], np.unique(group[good], return_inverse=True)[1]


def _shard(p: Repeats):
    """Of a shard's segments (anchor, seg, spread, bytes): rows of kind 0, a segment's repeated starts, and of kind 1,
    for spread anchors, the shard's distinct windows by ranges of their digests."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("anchor", "seg", "ranges", "bytes"))))
        out: list[tuple] = []
        at = 0
        while at < len(rows):
            # as many whole anchors as one array takes
            size, to, cut = 0, at, at
            while to < len(rows) and size + len(rows[to][3]) < MOST:
                size += len(rows[to][3])
                to += 1
                if to == len(rows) or rows[to][0] != rows[to - 1][0]:
                    cut = to
            if cut == at:  # an anchor's segments exceed an array only where it is spread, and those are merged below
                cut = to
            own, at = rows[at:cut], cut
            part, start, same = repeated([r[3] for r in own], p)
            times = np.bincount(same)
            hit = times[same] > 1
            order = np.argsort(part[hit], kind="stable")
            hp, hs = part[hit][order], start[hit][order].astype(np.int16)
            for i, s in zip(np.unique(hp).tolist(), np.split(hs, np.flatnonzero(np.diff(hp)) + 1)):
                out.append((0, own[i][0], own[i][1], 0, s.tobytes(), b""))
            spread = np.array([r[2] for r in own])
            if spread.any():
                lead = np.r_[True, same[1:] != same[:-1]] & (spread[part] > 0)
                blocks: dict[tuple, list] = {}
                for i, s, t in zip(part[lead].tolist(), start[lead].tolist(), times[same[lead]].tolist()):
                    a, g, n, raw = own[i]
                    d = xxhash.xxh3_128_digest(raw[s : s + p.window])
                    blocks.setdefault((a, int.from_bytes(d[:4], "big") * n >> 32), []).append((d, g if t == 1 else 0, s if t == 1 else -1))
                for (a, r), found in blocks.items():
                    found.sort()
                    refs = np.array([(g, s) for _, g, s in found], np.int64)
                    out.append((1, a, 0, r, b"".join(d for d, _, _ in found), refs.tobytes()))
        cols = list(zip(*out)) if out else [[]] * 6
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=["kind", "anchor", "seg", "range", "data", "refs"])

    return run, "kind int, anchor long, seg long, range int, data binary, refs binary"


def merged(table: pa.Table) -> pa.Table:
    """Of one range of a spread anchor: the starts of windows that other shards hold too, by binary search in their sorted lists."""
    pairs = [np.frombuffer(x, ">u8").astype(np.uint64).reshape(-1, 2) for x in table.column("data").to_pylist()]
    refs = [np.frombuffer(x, np.int64).reshape(-1, 2) for x in table.column("refs").to_pylist()]
    anchor = table.column("anchor")[0].as_py()
    # digests as pairs of numbers: a sorted list of first halves is searched, then the second halves decide
    every = np.concatenate(pairs)
    order = np.lexsort((every[:, 1], every[:, 0]))
    every = every[order]
    starts = every[np.r_[True, (every[1:] != every[:-1]).any(axis=1)]]
    first = starts[:, 0]
    found: dict[int, list[int]] = {}
    held = np.zeros(len(starts), np.int64)
    spots = []
    for run in pairs:
        lo = np.searchsorted(first, run[:, 0])
        while (step := (starts[np.minimum(lo, len(starts) - 1)] != run).any(axis=1)).any():
            lo = lo + step  # equal first halves
        held[lo] += 1
        spots.append(lo)
    for lo, ref in zip(spots, refs):
        for seg, s in ref[(held[lo] > 1) & (ref[:, 1] >= 0)].tolist():
            found.setdefault(seg, []).append(s)
    rows = [(0, anchor, seg, 0, np.array(sorted(s), np.int16).tobytes(), b"") for seg, s in found.items()]
    cols = list(zip(*rows)) if rows else [[]] * 6
    return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=["kind", "anchor", "seg", "range", "data", "refs"])


# --- the corpus -----------------------------------------------------------------------------------


def _bytes_of(docs: DataFrame, carriers: DataFrame, p: Repeats) -> DataFrame:
    """carriers(doc_id, tag, held: array of (anchor, seg, place, ranges, shard)) with the bytes of each segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "seg", "ranges", "shard", "bytes"]
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                b = whole.slice(lo, 256)
                made: list[list] = [[], [], [], [], []]
                for text, held in zip(b.column(0).cast(pa.binary()).to_pylist(), b.column(1).to_pylist()):
                    for x in held:
                        first, count = x["place"] >> 8, (x["place"] & 255) + 1
                        for c, v in zip(made, (x["anchor"], x["seg"], x["ranges"], x["shard"], text[first : first + count + p.window - 1])):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(made, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))], names=names)

    both = docs.join(carriers.hint("shuffle_hash"), ["doc_id", "tag"]).select("text", "held")
    return both.mapInArrow(trimmed(run), "anchor long, seg long, ranges int, shard int, bytes binary")


def _starts(docs: DataFrame, p: Repeats) -> DataFrame:
    """(doc_id, tag, held): for each document with repeated windows the places and starts; null starts mean all of a place's.

    Rows that repeat a document count in `times`, but each place is held once.
    """
    occ = stored(_occurrences(docs, p), "occurrences")
    seen = occ.groupBy("anchor").agg(F.count("*").alias("times"), F.min("seg").alias("lo"), F.max("seg").alias("hi"))
    seen = seen.where("times > 1").select("anchor", (F.col("lo") != F.col("hi")).alias("mixed"))
    again = stored(occ.join(apart(seen), "anchor"), "repeats")

    # the distinct segments of anchors that have several, each with one occurrence that carries its bytes
    kinds = again.where("mixed").groupBy("anchor", "seg").agg(F.count("*").alias("times"), F.min(F.struct("doc_id", "tag", "place")).alias("at"))
    kinds = stored(kinds, "kinds")
    counts = kinds.groupBy("anchor").agg(F.count("*").alias("distinct"))
    total = kinds.agg(F.sum(F.col("at.place").bitwiseAND(255) + p.window)).first()[0] or 0
    shards = max(1, -(-total // p.shard_bytes))
    spread = F.col("distinct") > p.hot
    ranges = F.when(spread, F.greatest(F.lit(1), (F.col("distinct") / p.hot).cast("int"))).otherwise(0)
    shard = F.when(spread, F.pmod(F.xxhash64("anchor", "seg"), F.lit(shards))).otherwise(F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    held = F.struct("anchor", "seg", F.col("at.place").alias("place"), ranges.cast("int").alias("ranges"), shard.cast("int").alias("shard"))
    carriers = kinds.join(apart(counts), "anchor").select(F.col("at.doc_id").alias("doc_id"), F.col("at.tag").alias("tag"), held.alias("held")).groupBy("doc_id", "tag").agg(F.collect_list("held").alias("held"))
    run, schema = _shard(p)
    arrays = stored(_bytes_of(docs, carriers, p).groupBy("shard").applyInArrow(trimmed(run), schema), "arrays")
    across = arrays.where("kind = 1").groupBy("anchor", "range").applyInArrow(merged, schema)
    inside = arrays.where("kind = 0").unionByName(across).groupBy("anchor", "seg").agg(F.collect_list("data").alias("starts"))
    some = kinds.select("anchor", "seg", "times").join(inside.hint("shuffle_hash"), ["anchor", "seg"], "left").where("times > 1 or starts is not null").select("anchor", "seg", F.when(F.col("times") <= 1, F.col("starts")).alias("starts"))
    some = stored(some, "starts")

    whole = again.where("not mixed").select("doc_id", "tag", "place", F.lit(None).cast("array<binary>").alias("starts"))
    part = again.where("mixed").select("doc_id", "tag", "place", "anchor", "seg").join(some.hint("shuffle_hash"), ["anchor", "seg"]).select("doc_id", "tag", "place", "starts")
    # sets are made before the shuffle, so the copies of a repeated row don't meet in one task
    return whole.unionByName(part).groupBy("doc_id", "tag").agg(F.collect_set(F.struct("place", "starts")).alias("held"))


def _spans(held: list[dict] | None, n: int, p: Repeats) -> np.ndarray:
    """Begin and end of each maximal removed run."""
    if not held:
        return np.zeros((0, 2), np.int64)
    found = []
    for x in held:
        first, count = x["place"] >> 8, (x["place"] & 255) + 1
        if x["starts"] is None:
            found.append(np.array([[first, first + count - 1 + p.window]]))
            continue
        s = np.unique(np.concatenate([np.frombuffer(y, np.int16) for y in x["starts"]])).astype(np.int64) + first
        cut = np.flatnonzero(np.diff(s) > p.window) + 1
        found.append(np.stack([s[np.r_[0, cut]], s[np.r_[cut, len(s)] - 1] + p.window], axis=1))
    every = np.concatenate(found)
    every = every[np.argsort(every[:, 0], kind="stable")]
    far = np.maximum.accumulate(every[:, 1])
    cut = np.flatnonzero(every[1:, 0] > far[:-1]) + 1
    return np.stack([every[np.r_[0, cut], 0], np.minimum(far[np.r_[cut, len(far)] - 1], n)], axis=1)


def cut_repeats(docs: DataFrame, p: Repeats = Repeats(), digest: bool = False) -> DataFrame:
    """docs with text without its repeated bytes, and n_bytes, n_removed and n_spans (maximal removed runs).

    Matches lie within one document; strings are judged on the input. Null texts count as empty
    (and stay null). With digest, text gives way to kept_sha256 of the bytes that are left, and
    only doc_id of the other columns stays; else a character is removed only if all its bytes are.
    Rows that repeat a document repeat all its strings; they cost time linear in their bytes. Columns named like a new one are replaced.
    """
    new = {"n_bytes": T.LongType(), "n_removed": T.LongType(), "n_spans": T.LongType()} | ({"kept_sha256": T.StringType()} if digest else {})
    own = ["doc_id"] if digest else [c for c in docs.columns if c.lower() not in new]
    at = own.index("text") if not digest else -1
    tag = F.xxhash64(F.coalesce("text", F.lit(""))).alias("tag")
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc_id")
    texts = docs.where("text is not null").select(key, tag, "text")
    id_, tag_, held_, text_ = spare(docs.columns, "id", "tag", "held", "body")
    held = _starts(texts, p).select(F.col("doc_id").alias(id_), F.col("tag").alias(tag_), F.col("held").alias(held_))
    src = docs.select(*own, *([docs["text"].alias(text_)] if digest else []), key.alias(id_), tag.alias(tag_))
    both = src.join(held.hint("shuffle_hash"), [id_, tag_], "left").select(*own, *([text_] if digest else []), held_)
    schema = T.StructType([*(src.schema[c] for c in own), *(T.StructField(c, t) for c, t in new.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, max(1, whole.num_rows), 256):
                b = whole.slice(lo, 256)
                n_bytes, n_removed, n_spans, left = [], [], [], []
                texts = b.column(len(own) if digest else at).cast(pa.binary()).to_pylist()
                for t, h in zip(texts, b.column(b.num_columns - 1).to_pylist()):
                    raw = t or b""
                    spans = _spans(h, len(raw), p).tolist()
                    n_bytes.append(len(raw))
                    n_removed.append(sum(e - s for s, e in spans))
                    n_spans.append(len(spans))
                    if not digest:
                        spans = [(_up(raw, s), _down(raw, e)) for s, e in spans]
                    parts, to = [], 0
                    for s, e in spans:
                        parts.append(raw[to:s])
                        to = e
                    kept = b"".join([*parts, raw[to:]])
                    left.append(hashlib.sha256(kept).hexdigest() if digest else None if t is None else kept.decode())
                cols = [b.column(i) for i in range(len(own))]
                if not digest:
                    cols[at] = pa.array(left, pa.string())
                cols += [pa.array(c, pa.int64()) for c in (n_bytes, n_removed, n_spans)] + ([pa.array(left, pa.string())] if digest else [])
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return both.mapInArrow(trimmed(run), schema)


def _up(raw: bytes, at: int) -> int:
    """The first place from at on where a character begins."""
    while at < len(raw) and raw[at] & 0xC0 == 0x80:
        at += 1
    return at


def _down(raw: bytes, at: int) -> int:
    """The last place up to at where a character begins or the text ends."""
    while at < len(raw) and raw[at] & 0xC0 == 0x80:
        at -= 1
    return at
