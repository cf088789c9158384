"""Places, running sums and last known values in a total order, without sorting a table, or one key's rows, in one task.

Rows are dealt into ranges of (keys, order) and checkpointed, since dealing them again could cut them elsewhere. Each
range is scanned by itself and takes over what the ranges before it leave: one row per range and key, so a key that
holds most rows is spread over as many tasks as it fills ranges.
"""

from __future__ import annotations

import functools
import operator
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sitegrain.session import checkpointed


class Ordered:
    """A table dealt into ranges of its keys and order; ``df`` holds the rows, and ``part`` names the range's column."""

    def __init__(self, df: DataFrame, by: list[str], order: list[str]) -> None:
        self.by, self.order, self.part = by, order, f"part_{uuid.uuid4().hex}"
        self.df = checkpointed(df.repartitionByRange(*by, *order).withColumn(self.part, F.spark_partition_id()))

    def with_columns(self, columns: dict[str, Column]) -> Ordered:
        return self._of(self.df.withColumns(columns))

    def _of(self, df: DataFrame) -> Ordered:
        new = object.__new__(Ordered)
        new.by, new.order, new.part, new.df = self.by, self.order, self.part, df
        return new

    def running(self, sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, before: bool = False) -> Ordered:
        """Adds sums and last non-null values over a key's rows up to each row, or up to the one before it."""
        sums, lasts = sums or {}, lasts or {}
        own, mark = {n: f"own_{n}" for n in [*sums, *lasts]}, uuid.uuid4().hex
        df = self.df.withColumns({own[n]: c for n, c in {**sums, **lasts}.items()})
        place = F.struct(*self.order)
        left = df.groupBy(self.part, *self.by).agg(
            *[F.sum(own[n]).alias(n) for n in sums], *[F.max_by(own[n], F.when(F.col(own[n]).isNotNull(), place)).alias(n) for n in lasts]
        )
        earlier = W.partitionBy(*self.by).orderBy(self.part).rowsBetween(W.unboundedPreceding, -1)
        carried = left.select(
            *[F.col(c).alias(f"{c}_{mark}") for c in [self.part, *self.by]],
            *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"{n}_{mark}") for n in sums],
            *[F.last(n, True).over(earlier).alias(f"{n}_{mark}") for n in lasts],
        )
        here = W.partitionBy(self.part, *self.by).orderBy(*self.order).rowsBetween(W.unboundedPreceding, -1 if before else 0)
        df = df.withColumns({n: F.sum(own[n]).over(here) for n in sums} | {n: F.last(own[n], True).over(here) for n in lasts})
        same = functools.reduce(operator.and_, [F.col(c).eqNullSafe(F.col(f"{c}_{mark}")) for c in [self.part, *self.by]])
        df = df.join(carried, same).withColumns(
            {n: F.coalesce(n, F.lit(0)) + F.col(f"{n}_{mark}") for n in sums} | {n: F.coalesce(n, f"{n}_{mark}") for n in lasts}
        )
        return self._of(df.drop(*own.values(), *[f"{c}_{mark}" for c in [self.part, *self.by, *own]]))

    def rows(self) -> DataFrame:
        return self.df.drop(self.part)


def numbered(df: DataFrame, name: str, *keys: Column) -> DataFrame:
    """Adds the place (from 1) of each row in the order of the keys.

    Each range is counted and sorted by itself, and starts where the counts of those before it end. Rows whose keys are
    all equal share a range and are numbered in any order.
    """
    part = f"part_{uuid.uuid4().hex}"
    dealt = checkpointed(df.repartitionByRange(*keys).withColumn(part, F.spark_partition_id()))
    before = W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    starts = dealt.groupBy(part).agg(F.count("*").alias("n")).select(part, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(f"{part}_start"))
    place = F.row_number().over(W.partitionBy(part).orderBy(*keys)).cast("long")
    return dealt.withColumn(name, place).join(starts, part).withColumn(name, F.col(name) + F.col(f"{part}_start")).drop(part, f"{part}_start")


def asof_join(left: DataFrame, right: DataFrame, by: list[str], order: list[str], ties: bool = True) -> DataFrame:
    """Each row of the left with the last row of the right that is not after it, in order, within the same keys.

    Both have the columns ``by`` and ``order``; the right's others are added (null where nothing comes before). A row of
    the right at the same place counts with ``ties``, else only those before. Nulls come first in the order.
    """
    keys = [*by, *order]
    added = [c for c in right.columns if c not in keys]
    told = F.struct(*added)
    first = F.lit(0 if ties else 1)
    rows = left.select(*keys, F.lit(1 if ties else 0).alias("asof_side"), F.struct(*left.columns).alias("asof_row"), F.lit(None).cast(right.select(told.alias("x")).schema["x"].dataType).alias("asof_told"))
    news = right.select(*keys, first.alias("asof_side"), F.lit(None).cast(rows.schema["asof_row"].dataType).alias("asof_row"), told.alias("asof_told"))
    scanned = Ordered(rows.unionByName(news), by, [*order, "asof_side"]).running(lasts={"asof_last": F.col("asof_told")})
    return scanned.rows().filter("asof_row IS NOT NULL").select("asof_row.*", *[F.col(f"asof_last.{c}").alias(c) for c in added])
