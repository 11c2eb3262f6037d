"""Near-duplicates: chosen-path set similarity join over word shingles.

Equal sets are one class. Each independent tree branches the classes by one minwise token after
another; only nodes that are still large branch further. A small node is compared exhaustively.
A large node links its members to a pivot, at every depth, so a family of many copies costs one
pair a member, and nodes of one tree share pivots and so pairs; in a large leaf, those that are left outside the node's main component are then
compared with all the others there, on full sets, block by block. A sketch of the minwise tokens sieves the pairs (it loses a
pair at the threshold with probability below `odds`), and every link is confirmed on the full sets.
A pair of similarity s shares all nodes of a tree with probability s**depth, whatever else they hold, and is
then compared in one of them. There are as many trees as make (1 - s**depth)**trees at most `odds` at the threshold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passbook.llm.common import apart, shuffle_partitions, spare, stored, trimmed
from passbook.llm.components import components
from passbook.llm.words import mix, set_digest, shingles


@dataclass(frozen=True)
class Join:
    """k-word shingles; sets link if 100 * intersection >= percent * union."""

    k: int = 5
    percent: int = 80
    depth: int = 4
    small: int = 12
    seed: int = 11
    odds: float = 1e-7

    @property
    def trees(self) -> int:
        """Trees that all part a pair at the threshold with probability `odds` at most, however large its nodes are."""
        apart = 1 - (self.percent / 100) ** self.depth
        return max(1, math.ceil(math.log(self.odds) / math.log(apart))) if apart else 1

    @property
    def tokens(self) -> int:
        return self.trees * self.depth

    @property
    def sieve(self) -> int:
        """Equal minwise tokens that a pair at the threshold has but for `odds` at most (a binomial's lower tail)."""
        s, n = self.percent / 100, self.tokens
        least, below = 0, (1 - s) ** n
        while least < n and below <= self.odds:
            least += 1
            below += math.comb(n, least) * s**least * (1 - s) ** (n - least)
        return max(1, least)


def minwise(hashes: np.ndarray, p: Join) -> np.ndarray:
    """The least hash under each of p.tokens orders of the shingles."""
    seeds = mix(np.arange(p.seed, p.seed + p.tokens, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out = np.empty(p.tokens, np.uint64)
    step = max(1, (1 << 14) // len(hashes))
    for lo in range(0, p.tokens, step):
        x = (hashes[None, :] ^ seeds[lo : lo + step, None]) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        out[lo : lo + step] = x.min(axis=1)
    return mix(out)


def _keyed(docs: DataFrame) -> DataFrame:
    """(null, rid, tk, text): a document's rows told apart by whether the id is null, the id (or for null the hash) and a hash of the text."""
    return docs.select(*(c.alias(n) for n, c in _key().items()), "text")


def _key() -> dict[str, Column]:
    known, hashed = F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit("")))
    return {"null": known.isNull().cast("int"), "rid": F.coalesce(known, hashed), "tk": hashed}


def signatures(docs: DataFrame, p: Join) -> DataFrame:
    """(null, rid, tk, n_shingles, digest of the set, tokens: its minwise tokens as array<long>) of each row of docs."""
    schema = "null int, rid long, tk long, n_shingles long, digest binary, tokens array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                b = whole.slice(lo, 512)
                n, digests, tokens, offsets = [], [], [], [0]
                for h in shingles([t or b"" for t in b.column(3).cast(pa.binary()).to_pylist()], p.k):
                    n.append(len(h))
                    digests.append(set_digest(h))
                    if len(h):
                        tokens.append(minwise(h, p).view(np.int64))
                    offsets.append(offsets[-1] + (p.tokens if len(h) else 0))
                flat = pa.array(np.concatenate(tokens) if tokens else np.zeros(0, np.int64))
                cols = [*b.columns[:3], pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)]
                yield pa.RecordBatch.from_arrays(cols, names=["null", "rid", "tk", "n_shingles", "digest", "tokens"])

    return _keyed(docs).mapInArrow(trimmed(run), schema)


def _sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame, p: Join) -> DataFrame:
    """(id, set as bytes) of the wanted classes, made again from the text that stands for each."""
    # read back from a file, so that Spark knows the ids' size and moves the texts only if they are many
    of = stored(classes.join(wanted, "id", "left_semi").select("id", "digest", "at.*"), "wanted")
    # the ids alone are few bytes, so that most often only the texts that are wanted move
    texts = _keyed(docs).join(stored(of.select("rid").distinct(), "ids"), "rid", "left_semi").join(of, ["null", "rid", "tk"])
    # a second hash keeps two texts of one id apart that share the first; the set's digest then says which is wanted
    texts = texts.withColumn("more", F.xxhash64("text", F.lit(1))).dropDuplicates(["null", "rid", "tk", "more"]).select("id", "digest", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                b = whole.slice(lo, 512)
                rows = list(shingles([t or b"" for t in b.column(2).cast(pa.binary()).to_pylist()], p.k))
                good = [set_digest(h) == d for h, d in zip(rows, b.column(1).to_pylist())]
                sets = [h.tobytes() for h, g in zip(rows, good) if g]
                yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(good, pa.bool_())), pa.array(sets, pa.binary())], names=["id", "hashes"])

    return texts.mapInArrow(trimmed(run), "id long, hashes binary")


def _sized(n: str, m: str, p: Join) -> Column:
    """Whether sets of these sizes may link."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * p.percent


def _alike(a: str, b: str, p: Join) -> Column:
    """Whether two sketches and sizes may belong to a linked pair."""
    equal = F.size(F.filter(F.zip_with(f"{a}.tokens", f"{b}.tokens", lambda x, y: x == y), lambda x: x))
    return _sized(f"{a}.n", f"{b}.n", p) & (equal >= p.sieve)


def _confirmed(pairs: DataFrame, sets: DataFrame, p: Join) -> DataFrame:
    """The pairs (a, b) whose full sets link."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("hashes").alias("y")), "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                same = len(x) + len(y) - len(np.union1d(x, y))
                good.append(100 * same >= p.percent * (len(x) + len(y) - same))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


#: Bytes of sets in a block of outsiders and in a block of members, and rows in either.
BLOCKS, BLOCK_ROWS = (2 << 20, 6 << 20), 512


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each left set with each right set."""
    counts = np.zeros((len(left), len(right)), np.float32)
    l_row, r_row = (np.repeat(np.arange(len(x)), [len(y) for y in x]) for x in (left, right))
    both, code = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    lc, rc = code[: len(l_row)], code[len(l_row) :]
    lo, ro = np.argsort(lc, kind="stable"), np.argsort(rc, kind="stable")
    lc, l_row, rc, r_row = lc[lo], l_row[lo], rc[ro], r_row[ro]
    ln, rn = np.bincount(lc, minlength=len(both)), np.bincount(rc, minlength=len(both))
    ls, rs = np.cumsum(ln) - ln, np.cumsum(rn) - rn
    work = ln.astype(np.int64) * rn
    # few pairs hold a shingle: count them one by one; many do: as products of 0/1 matrices
    few = np.flatnonzero((work > 0) & (work <= 64))
    if len(few):
        k = np.repeat(few, work[few])
        at = np.arange(len(k)) - np.repeat(np.cumsum(work[few]) - work[few], work[few])
        np.add.at(counts, (l_row[ls[k] + at // rn[k]], r_row[rs[k] + at % rn[k]]), 1)
    many = np.flatnonzero(work > 64)
    for lo_ in range(0, len(many), 1024):
        cols = many[lo_ : lo_ + 1024]
        place = np.full(len(both), -1)
        place[cols] = np.arange(len(cols))
        a, b = np.zeros((len(left), len(cols)), np.float32), np.zeros((len(right), len(cols)), np.float32)
        for m, c, r in ((a, lc, l_row), (b, rc, r_row)):
            at = place[c]
            m[r[at >= 0], at[at >= 0]] = 1
        counts += a @ b.T
    return counts.astype(np.int64)


def _across(held: DataFrame, p: Join) -> DataFrame:
    """held(node, id, c: component, outside, hashes): links (a, b) of each node's outsiders with its members of other components.

    Both are dealt into blocks of bounded bytes, and a task compares one block with another.
    """
    size = F.length("hashes")
    outside = F.col("outside")
    sums = held.groupBy("node").agg(F.sum(F.when(outside, size)).alias("o"), F.sum(size).alias("m"), F.count_if(outside).alias("o_rows"), F.count("*").alias("m_rows"))
    sums = sums.select("node", *(F.ceil(F.greatest(F.col(c) / n, F.col(f"{c}_rows") / BLOCK_ROWS)).cast("int").alias(c) for c, n in zip("om", BLOCKS)))
    rows = held.join(apart(sums), "node")
    split = lambda c, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = rows.where("outside").select("node", "id", "c", "hashes", F.lit(0).alias("side"), split("o", 1).alias("ob"), every("m").alias("mb"))
    right = rows.select("node", "id", "c", "hashes", F.lit(1).alias("side"), every("o").alias("ob"), split("m", 2).alias("mb"))

    def run(table: pa.Table) -> pa.Table:
        side, ids, c = (table.column(x).to_numpy() for x in ("side", "id", "c"))
        sets = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
        l, r = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        a = b = np.zeros(0, np.int64)
        if len(l) and len(r):
            same = shared_counts([sets[i] for i in l], [sets[i] for i in r])
            n = np.array([len(x) for x in sets])
            good = (100 * same >= p.percent * (n[l][:, None] + n[r][None, :] - same)) & (c[l][:, None] != c[r][None, :])
            i, j = np.nonzero(good)
            a, b = np.minimum(ids[l[i]], ids[r[j]]), np.maximum(ids[l[i]], ids[r[j]])
        return pa.table({"a": a, "b": b})

    # dealt by block, as the rows still lie by node
    both = left.unionByName(right).repartition(shuffle_partitions(held.sparkSession), "node", "ob", "mb")
    return both.groupBy("node", "ob", "mb").applyInArrow(run, "a long, b long").distinct()


def _nodes(classes: DataFrame, p: Join) -> tuple[DataFrame, DataFrame]:
    """(node, id) of small nodes of at least two classes, and (tree, node, depth, id, n) of the large ones.

    A node's key is a hash of its tree and of the minwise tokens on the path to it.
    """
    at = F.explode(F.sequence(F.lit(0), F.lit(p.trees - 1))).alias("tree")
    # a row carries the tokens of its own tree alone
    level = classes.select("id", "n", "tokens", at).select("id", "n", "tree", F.slice("tokens", F.col("tree") * p.depth + 1, F.lit(p.depth)).alias("path"))
    level = level.select("id", "n", "tree", "path", F.xxhash64("tree", F.get("path", F.lit(0))).alias("node"))
    small, large = [], []
    for depth in range(1, p.depth + 1):
        sizes = level.groupBy("node").agg(F.count("*").alias("size")).where("size > 1")
        kept = stored(level.join(apart(sizes), "node"), "nodes")
        small.append(kept.where(F.col("size") <= p.small).select("node", "id"))
        above = kept.where(F.col("size") > p.small)
        large.append(above.select("tree", "node", F.lit(depth).alias("depth"), "id", "n"))
        level = above.select("id", "n", "tree", "path", F.xxhash64("node", F.get("path", F.lit(depth))).alias("node"))

    def union(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for x in parts[1:]:
            out = out.unionByName(x)
        return out

    return union(small), union(large)


def _classified(docs: DataFrame, p: Join) -> DataFrame:
    """(null, rid, tk, n_shingles, head) of each row of docs; head is the (null, rid, tk) that stands for its component, null for an empty set.

    Classes of equal sets have numbers of their own, so that an id that repeats with other texts is in several.
    """
    rows = stored(signatures(docs, p), "signatures")
    classes = rows.where("n_shingles > 0").groupBy("digest").agg(F.min(F.struct("null", "rid", "tk")).alias("at"), F.first("n_shingles").alias("n"), F.first("tokens").alias("tokens"))
    classes = stored(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    sketch = classes.select("id", "n", "tokens")
    small, large = _nodes(sketch, p)
    # the sieve counts equal tokens by their low 16 bits: chance can add a pair, but lose none
    sketch = stored(sketch.withColumn("tokens", F.transform("tokens", lambda x: (x.bitwiseAND(F.lit(0xFFFF)) - 0x8000).cast("short"))), "sketch")

    # small nodes: at most p.small members, every pair of them
    member = small.join(sketch, "id").select("node", F.struct("id", "n", "tokens").alias("m"))
    lists = member.groupBy("node").agg(F.collect_list("m").alias("ms"))
    pairs = lists.select(F.explode("ms").alias("l"), "ms").select("l", F.explode("ms").alias("r")).where("l.id < r.id").where(_alike("l", "r", p))
    near = pairs.select(F.col("l.id").alias("a"), F.col("r.id").alias("b"))
    # large nodes of every depth: each member with a pivot, the first in an order of the tree's own, so that a node
    # and the nodes below it that hold its pivot share their pairs
    pivots = large.groupBy("node", "depth").agg(F.min_by(F.struct("id", "n"), F.xxhash64("tree", "id")).alias("pivot"))
    spokes = large.join(apart(pivots), ["node", "depth"]).where(F.col("id") != F.col("pivot.id")).where(_sized("n", "pivot.n", p))
    spokes = spokes.select(F.least("id", "pivot.id").alias("a"), F.greatest("id", "pivot.id").alias("b")).distinct()
    left, right = sketch.select(F.col("id").alias("a"), F.struct("n", "tokens").alias("l")), sketch.select(F.col("id").alias("b"), F.struct("n", "tokens").alias("r"))
    spokes = spokes.join(left, "a").join(right, "b").where(_alike("l", "r", p)).select("a", "b")
    pairs = stored(near.unionByName(spokes).distinct(), "pairs")

    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).union(large.where(F.col("depth") == p.depth).select("id")).distinct()
    sets = stored(_sets(docs, classes, wanted, p), "sets")
    links = stored(_confirmed(pairs, sets, p), "links")
    found = components(links)

    # large leaves: members outside the node's main component, against all that are not in theirs
    leaf = large.where(F.col("depth") == p.depth).select("node", "id").join(found.select(F.col("node").alias("id"), "component"), "id", "left").select("node", "id", F.coalesce("component", "id").alias("c"))
    leaf = stored(leaf, "leaves")
    main = leaf.groupBy("node", "c").agg(F.count("*").alias("k")).groupBy("node").agg(F.max_by("c", F.struct("k", "c")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    if main.limit(1).count():
        held = leaf.join(apart(main), "node").join(sets.select("id", "hashes"), "id").select("node", "id", "c", (F.col("c") != F.col("main")).alias("outside"), "hashes")
        more = stored(_across(stored(held, "held"), p), "links")
        found = components(links.unionByName(more))

    heads = classes.select("digest", "id", "at")
    linked = stored(heads.join(stored(found, "found").select(F.col("node").alias("id"), "component"), "id"), "linked")
    least = linked.groupBy("component").agg(F.min("at").alias("head"))
    linked = linked.join(apart(least), "component").select("id", "head")
    named = heads.join(linked, "id", "left").select("digest", F.coalesce("head", "at").alias("head"))
    return rows.select("null", "rid", "tk", "n_shingles", "digest").join(named, "digest", "left").drop("digest")


def clusters(docs: DataFrame, p: Join = Join()) -> DataFrame:
    """docs(doc_id, text): doc_id, n_shingles, component_id (the least doc_id that links reach) and kept.

    One row for each row of docs. Null, empty and blank texts have an empty set and link with
    nothing: their component is their own id. Repeated rows and texts with equal sets are one
    class, so all but the least id are dropped; rows that repeat the id of a component are each
    kept. An id that repeats with other texts takes part with each of them. Rows with a null id take
    part; a component of such rows alone has no id (null), and they are kept.
    """
    known = F.when(F.col("null") == 0, F.col("rid"))
    component = F.when(F.col("n_shingles") > 0, F.when(F.col("head.null") == 0, F.col("head.rid"))).otherwise(known)
    out = _classified(docs, p).select(known.alias("doc_id"), "n_shingles", component.alias("component_id"))
    return out.select("*", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("doc_id").isNull() & F.col("component_id").isNull()).alias("kept"))


def deduplicated(docs: DataFrame, p: Join = Join()) -> DataFrame:
    """One row of each component of docs, that of least id (then of least text's hash; null ids come last); columns as in docs.

    Rows with an empty set are all kept, repeated ones too.
    """
    own = _key()
    key = spare(docs.columns, *own)
    rows = _classified(docs, p).where("n_shingles > 0")
    verdicts = rows.groupBy(*(F.col(c).alias(k) for c, k in zip(own, key))).agg(F.count("*").alias("times"), F.first("head").alias("head"))
    verdicts = verdicts.withColumn("gone", F.struct(*key) != F.struct("head.null", "head.rid", "head.tk")).where("gone or times > 1").select(*key, "gone")
    verdicts = stored(verdicts, "gone")
    keyed = docs.withColumns(dict(zip(key, own.values())))
    left = keyed.join(verdicts.where("gone").select(*key), key, "left_anti")
    again = verdicts.where("not gone").select(*key)
    if again.limit(1).count():
        left = left.join(again, key, "left_anti").unionByName(left.join(again, key, "left_semi").dropDuplicates(key))
    return left.select(*docs.columns)
