"""Places of rows in one order of a whole table, by ranges: no task sees more than its own range.

Rows are cut into ranges of the order and sorted within each, written once, and counted; a row's
number is its place in its range and the rows of the ranges before, of which there is one number a range.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passbook.sources.steps import partitions, spare, written


@dataclass(frozen=True)
class Ranged:
    """rows: with the columns part (the range) and at (the place in it, from 0); before: of each range the rows of those before it."""

    rows: DataFrame
    part: str
    at: str
    before: list[int]
    total: int

    def numbered(self, name: str) -> DataFrame:
        """The rows with a number from 1 in place of range and place."""
        number = F.get(F.lit(self.before), F.col(self.part)) + F.col(self.at) + 1 if self.before else F.lit(None).cast("long")
        return self.rows.withColumn(name, number).drop(self.part, self.at)

    def page(self, page: int, size: int) -> DataFrame:
        """Page (from 0) of so many rows, in order; only the ranges that hold it are read."""
        lo, hi = page * size, min((page + 1) * size, self.total)
        ends = [*self.before[1:], self.total]
        held = [i for i, (s, e) in enumerate(zip(self.before, ends)) if s < hi and lo < e]
        (number,) = spare(self.rows.columns, "number")
        found = self.rows.where(F.col(self.part).isin(held) if held else F.lit(False))
        at = F.get(F.lit(self.before), F.col(self.part)) + F.col(self.at) if self.before else F.lit(0)
        return found.withColumn(number, at).where(F.col(number).between(lo, hi - 1)).orderBy(number).drop(number, self.part, self.at)


def ranged(df: DataFrame, *order: Column) -> Ranged:
    """df in the given order, which should leave no ties, as ties come in any order."""
    part, at = spare(df.columns, "part", "at")
    n = partitions(df.sparkSession)
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id())
    # the id has the partition in its upper bits, and counts rows below
    placed = placed.withColumn(part, F.shiftright(at, 33).cast("int")).withColumn(at, F.col(at).bitwiseAND((1 << 33) - 1))
    rows = written(placed, "ranged", (part,))
    counts = {r[part]: r["count"] for r in rows.groupBy(part).count().collect()}
    before, total = [], 0
    for i in range(max(counts, default=-1) + 1):
        before.append(total)
        total += counts.get(i, 0)
    return Ranged(rows, part, at, before, total)
