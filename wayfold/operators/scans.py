"""Prefix scans along ordered groups, of which one may hold any share of all rows.

A window over a group is one task, however long the group. Here rows are dealt in ranges of
(group, order) instead, so a long group spans many ranges. Each range is worked through by
itself, what a range hands on (its last row, its count, its running maximum) is one
row for each group and range, these are scanned along each group's ranges, and each range is
finished with what it was handed. A group has as many such rows as there are ranges at most.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.operators.durable import durable


class Ranges:
    """``rows`` of ``df``, written once with the range that each is in (``__range``).

    ``within``: the window of a group's rows of one range, in order. Rows that are equal in
    ``by`` and ``order`` are told apart by their other plain columns, so that they need not
    share a range. ``ranges``: how many (Spark's number of shuffle partitions where it is left out)."""

    def __init__(self, df: DataFrame, by: Sequence[str], order: Sequence[str], ranges: int | None = None):
        self.by, self.order = list(by), list(order)
        plain = [f.name for f in df.schema.fields if f.name not in (*by, *order) and "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
        keys = [*by, *order, "__tie"]
        tied = df.withColumn("__tie", F.xxhash64(*plain) if plain else F.lit(0).cast("long"))
        dealt = tied.repartitionByRange(ranges, *keys) if ranges else tied.repartitionByRange(*keys)
        self.rows = durable(dealt.withColumn("__range", F.spark_partition_id()), "ranges")
        self.keys = [*by, "__range"]
        self.within = Window.partitionBy(*self.keys).orderBy(*order, "__tie")
        self.along = Window.partitionBy(*by).orderBy("__range")
        self.before = self.along.rowsBetween(Window.unboundedPreceding, -1)

    def handed(self, **parts: Column) -> DataFrame:
        """One row for each group and range, with aggregates over its rows."""
        return self.rows.groupBy(*self.keys).agg(*(c.alias(k) for k, c in parts.items()))

    def last(self, *columns: str) -> Column:
        """An aggregate: the columns of a range's last row."""
        return F.max_by(F.struct(*columns), F.struct(*self.order, "__tie"))

    def finished(self, rows: DataFrame, handed: DataFrame) -> DataFrame:
        """``rows`` with what their ranges were handed. Both are dealt by group and range
        alike, so rows move once for the window and the join."""
        other = handed.withColumnsRenamed({k: f"__of_{k}" for k in self.keys})
        same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in self.keys))
        return rows.join(other.hint("shuffle_hash"), same, "left").drop(*(f"__of_{k}" for k in self.keys))


def with_previous(df: DataFrame, by: Sequence[str], order: Sequence[str], columns: Sequence[str], ranges: int | None = None) -> DataFrame:
    """``__previous``: a struct of the columns of the row before in its group, null for the first."""
    r = Ranges(df, by, order, ranges)
    carry = r.handed(__last=r.last(*columns)).withColumn("__carried", F.lag("__last").over(r.along)).drop("__last")
    rows = r.rows.withColumn("__previous", F.lag(F.struct(*columns)).over(r.within))
    out = r.finished(rows, carry).withColumn("__previous", F.coalesce("__previous", "__carried"))
    return out.drop("__carried", "__range", "__tie")


def queued(df: DataFrame, by: Sequence[str], order: Sequence[str], at: str, gap: int, name: str, ranges: int | None = None) -> DataFrame:
    """``name``: each row at its own ``at``, or ``gap`` after the row before, whichever is later.

    go(i) = max over j <= i of at(j) + (i - j) * gap, a running maximum of at(j) - j * gap. Within a
    range rows are numbered from 1; a range hands on its count and its maximum, which is shifted by the rows before it."""
    r = Ranges(df, by, order, ranges)
    rows = r.rows.withColumn("__n", F.row_number().over(r.within).cast("long"))
    rows = rows.withColumn("__most", F.max(F.col(at) - F.col("__n") * gap).over(r.within))
    sums = rows.groupBy(*r.keys).agg(F.max("__n").alias("__count"), F.max("__most").alias("__top"))
    sums = sums.withColumn("__before", F.coalesce(F.sum("__count").over(r.before), F.lit(0)))
    sums = sums.withColumn("__high", F.max(F.col("__top") - F.col("__before") * gap).over(r.before)).drop("__count", "__top")
    out = r.finished(rows, sums)
    most = F.greatest(F.col("__most") - F.col("__before") * gap, F.col("__high"))
    return out.withColumn(name, most + (F.col("__before") + F.col("__n")) * gap).drop("__n", "__most", "__before", "__high", "__range", "__tie")
