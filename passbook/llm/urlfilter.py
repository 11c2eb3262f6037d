"""URL filters: sort-merge range join of urls with nested host and path rules.

A canonical key is the host with its labels reversed, each ended by byte 1, then byte 2 and the
path. A rule's host is then a prefix, and so an interval of keys; two such intervals nest or are
apart. Keys are cut into ranges; a rule goes to each range that its interval meets, a url to one.
Each range is swept in key order with a stack of the rules whose interval is open; a url is judged
by the open rules whose path begins its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passbook.llm.common import shuffle_partitions, spare

#: Keys that are sampled for the cuts of the ranges (about as many as this), and the characters of each that count; bound what the driver sees.
SAMPLE, SHOWN = 20_000, 256


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    at = F.instr(url, "://")
    rest = F.regexp_extract(F.substr(url, at + 3), r"^([^/?#]*)", 1)
    return F.when(at > 0, F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise("")


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty for null or without ://."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.regexp_extract(F.substr(url, at + 3), r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def _reversed(host: Column) -> Column:
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "\x01"), F.lit("\x01")))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """pages with host, path, rule (host + path, else null) and verdict (the rule's, else default).

    rules(host, path, verdict): a rule fits its host and all subdomains where the url's path starts
    with its own; the longest rule (host and path together, then host) wins, and among equal rules
    the least verdict. Null parts of a rule count as empty; a rule with an empty host fits every
    url. Null urls and urls without :// have empty host and path. One row for each row of pages;
    its columns with the names of new ones are replaced.
    """
    spark = pages.sparkSession
    new = ["host", "path", "rule", "verdict"]
    own = [c for c in pages.columns if c.lower() not in new]
    n = 2 * max(64, shuffle_partitions(spark))
    src = pages.select(*own, host_of(pages[url]).alias("host"), path_of(pages[url]).alias("path"))
    key_, range_, kind_, lo_, hi_ = spare(src.columns + new, "key", "range", "kind", "lo", "hi")
    # the path, the url's hash and a draw break up hosts that hold many rows; none of them leaves the host's interval
    spread = F.hex(F.xxhash64(pages[url], F.rand(7)))
    keyed = src.withColumn(key_, F.concat(_reversed(F.col("host")), F.lit("\x02"), F.col("path"), F.lit("\x02"), spread))
    known = rules.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("host", "path", "verdict"))).groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    known = known.withColumn("host", F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).withColumn(key_, _reversed(F.col("host")))

    rows = pages.count()
    some = keyed if rows <= SAMPLE else keyed.sample(fraction=SAMPLE / rows, seed=3)
    got = sorted(r[0] for r in some.select(F.substring(key_, 1, SHOWN)).collect())
    cuts = sorted({got[i * len(got) // n] for i in range(1, n)}) if got else []
    shared = spark.sparkContext.broadcast(cuts)

    def ranged(last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from bisect import bisect_right

            for b in batches:
                keys = [k or "" for k in b.column(b.schema.get_field_index(key_)).to_pylist()]
                lo = [bisect_right(shared.value, k) for k in keys]
                cols = [*b.columns, pa.array(lo, pa.int32())]
                if last:  # the end of a rule's interval: no key begins with its prefix and byte 3
                    cols.append(pa.array([bisect_right(shared.value, k[:-1] + "\x03") if k else len(shared.value) for k in keys], pa.int32()))
                yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names, lo_, *([hi_] if last else [])])

        return run

    lo, hi = T.StructField(lo_, T.IntegerType()), T.StructField(hi_, T.IntegerType())
    urls = keyed.mapInArrow(ranged(False), T.StructType([*keyed.schema.fields, lo])).withColumnRenamed(lo_, range_).withColumn(kind_, F.lit(1))
    spans = known.mapInArrow(ranged(True), T.StructType([*known.schema.fields, lo, hi])).withColumn(range_, F.explode(F.sequence(lo_, hi_))).drop(lo_, hi_).withColumn(kind_, F.lit(0))
    both = urls.unionByName(spans, allowMissingColumns=True)
    swept = both.repartition(n, range_).sortWithinPartitions(range_, key_, kind_)
    schema = T.StructType([*src.schema.fields, T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])
    order = [*own, "host", "path"]

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[tuple[str, list[tuple[int, int, str, str, str]]]] = []
        at = None
        for b in batches:
            cols = {c: b.column(b.schema.get_field_index(c)).to_pylist() for c in (range_, key_, kind_, "host", "path", "verdict")}
            keep, rule, verdict = [], [], []
            for i, (r, k, kind, host, path, v) in enumerate(zip(*cols.values())):
                if r != at:
                    stack, at = [], r
                while stack and not k.startswith(stack[-1][0]):
                    stack.pop()
                if kind == 0:
                    if not stack or stack[-1][0] != k:
                        stack.append((k, []))
                    stack[-1][1].append((len(host) + len(path), len(host), host, path, v))
                    continue
                # a host may hold the bytes that part labels in keys, so the rule's host is looked for in it
                best = max((x for _, level in stack for x in level if path.startswith(x[3]) and (not x[2] or host == x[2] or host.endswith("." + x[2]))), default=None)
                keep.append(i)
                rule.append(best and best[2] + best[3])
                verdict.append(best[4] if best else default)
            rows = b.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(rows.column(rows.schema.get_field_index(c)) for c in order), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=schema.names)

    return swept.mapInArrow(sweep, schema)
