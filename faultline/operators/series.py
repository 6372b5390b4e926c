"""Ordered windows over series that one task can't hold.

A series is the rows of one key in an order. If the longest has more than `rows` rows, all rows are
dealt by ranges of (key, order) and written, so that each part is a run of consecutive rows. Windows
then work within parts; what a part needs of those before it (sums, minima, the last row) comes
from one row for each key and part. So a single long series runs in as many tasks as it has parts,
and short ones stay together.

The order must tell the rows of a series apart where results depend on it; rows of equal order lie
in one part. Null keys are a key of their own; nulls come first in the order.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from faultline.sources.scratch import saved

#: Rows that one task may order.
PART_ROWS = 1 << 20
#: Parts of fewer rows are made up to this number; a longer table has larger ones, of PART_ROWS at most, so that their number does not grow as the rows do.
SMALL_PARTS = 512

Of = dict[str, tuple[str, Column]]


def _plus(a: Column, b: Column) -> Column:
    return F.coalesce(a + b, a, b)


#: kind -> (the aggregate of rows, the aggregate of parts, how two of them meet)
KINDS: dict[str, tuple[Callable, Callable, Callable]] = {
    "sum": (F.sum, F.sum, _plus),
    "count": (F.count, F.sum, _plus),
    "min": (F.min, F.min, F.least),
    "max": (F.max, F.max, F.greatest),
    "xor": (F.bit_xor, F.bit_xor, lambda a, b: F.coalesce(a.bitwiseXOR(b), a, b)),
}


def fits(df: DataFrame, keys: list[str], rows: int = PART_ROWS) -> bool:
    """Whether no key has more rows than one task may hold."""
    return df.count() <= rows or (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0) <= rows


@dataclass(frozen=True)
class Series:
    """rows has __key and __part beside its own columns."""

    rows: DataFrame
    order: list[str]
    split: bool

    @property
    def plain(self) -> DataFrame:
        return self.rows.drop("__key", "__part")

    def _window(self) -> W:
        return W.partitionBy("__key", "__part").orderBy(*self.order)

    def _with(self, whole: list[Column], before: Callable[[W], dict[str, Column]], columns: dict[str, Column]) -> Series:
        """Adds columns that may use those of `before`, windows over a key's parts in order."""
        parts = self.rows.groupBy("__key", "__part").agg(*whole)
        carried = parts.select(F.col("__key").alias("__k"), F.col("__part").alias("__p"), *[c.alias(n) for n, c in before(W.partitionBy("__key").orderBy("__part")).items()])
        met = self.rows.join(carried, (F.col("__key") == F.col("__k")) & (F.col("__part") == F.col("__p"))).withColumns(columns)
        return replace(self, rows=met.drop("__k", "__p", *before(W.partitionBy("__key").orderBy("__part"))))

    def running(self, of: Of) -> Series:
        """Aggregates from a series' first row to each row; of: name -> (kind, column)."""
        own = self._window().rowsBetween(W.unboundedPreceding, 0)
        here = {name: KINDS[kind][0](c).over(own) for name, (kind, c) in of.items()}
        if not self.split:
            return replace(self, rows=self.rows.withColumns(here))
        whole = [KINDS[kind][0](c).alias(name) for name, (kind, c) in of.items()]
        before = lambda w: {f"__{name}": KINDS[kind][1](name).over(w.rowsBetween(W.unboundedPreceding, -1)) for name, (kind, _) in of.items()}
        return self._with(whole, before, {name: KINDS[kind][2](F.col(f"__{name}"), here[name]) for name, (kind, _) in of.items()})

    def shifted(self, of: dict[str, Column], ahead: bool = False) -> Series:
        """The value in the row before (ahead: after); null at a series' end."""
        shift, edge, pick = (F.lead, F.desc, F.min_by) if ahead else (F.lag, F.asc, F.max_by)
        here = {name: shift(c).over(self._window()) for name, c in of.items()}
        if not self.split:
            return replace(self, rows=self.rows.withColumns(here))
        place = F.struct(*[F.struct(F.col(c).isNotNull(), F.col(c)) for c in self.order])  # nulls first, as in the window
        outer = W.partitionBy("__key", "__part").orderBy(*[edge(c) for c in self.order])
        whole = [pick(F.struct(c.alias("v")), place).alias(name) for name, c in of.items()]
        before = lambda w: {f"__{name}": shift(name).over(w) for name in of}
        at_edge = F.row_number().over(outer) == 1
        return self._with(whole, before, {name: F.when(at_edge, F.col(f"__{name}.v")).otherwise(here[name]) for name in of})

    def whole(self, of: dict[str, Column]) -> Series:
        """Aggregates of each whole series, in every row."""
        if not self.split:
            return replace(self, rows=self.rows.withColumns({name: c.over(W.partitionBy("__key", "__part")) for name, c in of.items()}))
        sums = self.rows.groupBy("__key").agg(*[c.alias(name) for name, c in of.items()])
        return replace(self, rows=self.rows.join(sums, "__key"))

    def with_columns(self, of: dict[str, Column]) -> Series:
        return replace(self, rows=self.rows.withColumns(of))


def series(df: DataFrame, keys: list[str], order: list[str], rows: int = PART_ROWS) -> Series:
    """df as series of each value of `keys` (none: a single one), cut into parts if the longest has over `rows` rows."""
    marked = df.withColumn("__key", F.struct(*keys) if keys else F.struct(F.lit(0).alias("all")))
    if fits(marked, ["__key"], rows):
        return Series(marked.withColumn("__part", F.lit(0)), order, False)
    n = df.count()
    dealt = marked.repartitionByRange(max(min(math.ceil(n / rows), SMALL_PARTS), math.ceil(n / max(rows, PART_ROWS))), *keys, *order)
    return Series(saved(dealt.withColumn("__part", F.spark_partition_id()), "series"), order, True)
