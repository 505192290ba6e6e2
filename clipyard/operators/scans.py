"""Running values over the rows of a key in order, for keys of any size.

A window by key holds all rows of the key in one task. Where a key has more rows than MOST, the rows are cut into ranges
of (key, order) instead: each range is scanned by itself, in parallel, and what the ranges of a key before it (after it,
backwards) come to is carried in. A border between two ranges parts one key at most, so the carried rows are no more
than two for each range: small enough to broadcast, whatever the table.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipyard.sources.tables import scratch

#: Rows of one key that a task may hold.
MOST = 2_000_000


@dataclass(frozen=True)
class Scan:
    """A running "sum", "max" or "last" (that is not null) of value. own: the row itself counts. back: from the end, so that "last" is the next one."""

    kind: str
    value: Column
    own: bool = True
    back: bool = False

    def over(self, x: Column, w: Window) -> Column:
        if self.kind == "last":
            return F.last(x, ignorenulls=True).over(w)
        return {"sum": F.sum, "max": F.max}[self.kind](x).over(w)

    def frame(self, key: list[str], order: list[str], own: bool) -> Window:
        """From the first row on; backwards, from the last one in the opposite order, since Spark goes through a frame that ends with the last row anew for each row."""
        by = [F.desc_nulls_last(c) if self.back else F.asc_nulls_first(c) for c in order]
        return Window.partitionBy(*key).orderBy(*by).rowsBetween(Window.unboundedPreceding, 0 if own else -1)

    def total(self, order: list[str]) -> Column:
        """The value that a whole range comes to."""
        if self.kind == "last":
            place = F.when(self.value.isNotNull(), F.struct(*order))
            return (F.min_by if self.back else F.max_by)(self.value, place)
        return {"sum": F.sum, "max": F.max}[self.kind](self.value)

    def joined(self, own: Column, carried: Column) -> Column:
        return F.coalesce(own, carried) if self.kind == "last" else F.greatest(own, carried) if self.kind == "max" else F.coalesce(own, F.lit(0)) + F.coalesce(carried, F.lit(0))


@dataclass(frozen=True)
class Ordered:
    """Rows of keys in order (ascending, nulls first), cut in ranges if some key is large. Rows equal in key and order keep no order among themselves."""

    rows: DataFrame
    key: list[str]
    order: list[str]
    cut: bool

    def scan(self, **scans: Scan) -> Ordered:
        """With a column for each scan; a sum over no rows is 0, the others null."""
        group = [*self.key, "range_"] if self.cut else self.key
        local = self.rows.withColumns({name: s.over(s.value, s.frame(group, self.order, s.own)) for name, s in scans.items()})
        if not self.cut:
            return replace(self, rows=local.withColumns({name: F.coalesce(name, F.lit(0)) for name, s in scans.items() if s.kind == "sum"}))
        split = self._split().select(*self.key)
        totals = self.rows.join(F.broadcast(split), self._same(self.rows, split), "left_semi").groupBy(*group).agg(*(s.total(self.order).alias(f"{name}_t") for name, s in scans.items()))
        carried = totals.select(*(F.col(c).alias(f"{c}_c") for c in group), *(s.over(F.col(f"{name}_t"), s.frame(self.key, ["range_"], False)).alias(f"{name}_c") for name, s in scans.items()))
        same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"{c}_c")) for c in group))
        both = local.join(F.broadcast(carried), same, "left")  # two rows a range at most
        return replace(self, rows=both.withColumns({name: s.joined(F.col(name), F.col(f"{name}_c")) for name, s in scans.items()}).drop(*(f"{c}_c" for c in (*group, *scans))))

    def with_columns(self, **columns: Column) -> Ordered:
        return replace(self, rows=self.rows.withColumns(columns))

    def result(self) -> DataFrame:
        return self.rows.drop("range_")

    def _split(self) -> DataFrame:
        """Keys in more than one range, which can only be first or last in theirs."""
        ends = self.rows.groupBy("range_").agg(F.min(F.struct(*self.key)).alias("a"), F.max(F.struct(*self.key)).alias("b"))
        return ends.select("range_", F.explode(F.array_distinct(F.array("a", "b"))).alias("k")).groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k.*")

    def _same(self, a: DataFrame, b: DataFrame) -> Column:
        return reduce(lambda x, y: x & y, (a[c].eqNullSafe(b[c]) for c in self.key))


def ordered(df: DataFrame, key: list[str], order: list[str], most: int | None = None, ranges: int | None = None) -> Ordered:
    """df for scans by key in order. Keys of up to `most` rows (MOST) are windows; if any has more, all rows are dealt into `ranges` ranges of (key, order) (as Spark sees fit, where not given) and written, so that the cuts stand."""
    largest = df.groupBy(*key).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if largest <= (MOST if most is None else most):
        return Ordered(df, key, order, False)
    by = [F.col(c) for c in (*key, *order)]
    dealt = df.repartitionByRange(ranges, *by) if ranges else df.repartitionByRange(*by)
    return Ordered(scratch(dealt.withColumn("range_", F.spark_partition_id()), "ranges"), key, order, True)


def numbered(df: DataFrame, key: list[str], order: list[str], name: str, most: int | None = None, ranges: int | None = None) -> DataFrame:
    """df with `name`: each row's place from 0 among those of its key, in an order without ties."""
    return ordered(df, key, order, most, ranges).scan(**{name: Scan("sum", F.lit(1).cast("long"), own=False)}).result()
